"""Entity scans with declared schemas, and the batch-wise sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns and types of the entity tables.
SCHEMAS = {
    "classes": "id string, name string, created_at timestamp",
    "students": "id string, class_id string, name string, registration_number string, curso string, created_at timestamp",
    "exams": "id string, class_id string, name string, is_practical boolean, layout_manifest_json string, created_at timestamp",
    "exam_questions": "id string, exam_id string, question_number int, question_text string, expected_answer string, correction_criteria string, max_score double, page_number int, box_x double, box_y double, box_w double, box_h double",
    "upload_batches": "id string, exam_id string, user_id string, file_url string, status string, total_pages int, created_at timestamp",
    "student_results": "id string, batch_id string, student_id string, identity_source string, physical_page int, detected_student_name string, detected_registration string, warnings array<string>, page_number int, total_score double, status string, created_at timestamp",
    "question_scores": "id string, student_result_id string, question_id string, ai_score double, ai_justification string, final_score double, professor_comment string, extracted_answer_text string, ocr_provider string, ocr_confidence double, grading_confidence double, requires_manual_review boolean, manual_review_reason string, criteria_met array<string>, criteria_missing array<string>, source_page_number int, source_question_number int, transcription_confidence double, warnings array<string>",
    "visual_exam_runs": "id string, user_id string, filename string, status string, pages_processed int, vision_model_used string, text_model_used string, created_at timestamp, updated_at timestamp, error string",
    "visual_exam_answers": "id string, run_id string, student_name string, registration string, detected_student_code string, class_name string, page_number int, question_number int, prompt_detected string, answer_transcription string, reading_confidence string, ocr_confidence double, reading_notes string, image_region string, score double, max_score double, verdict string, justification string, detected_concepts array<string>, missing_concepts array<string>, needs_human_review boolean, review_reason string, raw_vision_json string, raw_grading_json string, created_at timestamp",
}


def load_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Entity tables with their declared schemas; columns a file lacks read as null."""
    return {n: spark.read.schema(SCHEMAS[n]).parquet(f"{folder}/{n}.parquet") for n in names or SCHEMAS}


def overwrite_batches(df: DataFrame, path: str, key: str = "batch_id") -> None:
    """Rewrite only the batches that df holds; running it again gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def reprocess(df: DataFrame, batches: DataFrame, path: str, key: str = "batch_id") -> None:
    """S9 with its guard: batches that are being processed are left as they are."""
    free = batches.where("status <> 'PROCESSING'").select(batches["id"].alias(key))
    overwrite_batches(df.join(free, key, "left_semi"), path, key)
