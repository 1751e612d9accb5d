"""Review queue and decisions, table to table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import first_filled
from .scores import KEY, batch_status, pending_results, student_totals


def review_queue(results: DataFrame, scores: DataFrame, batches: DataFrame, n: int = 1) -> DataFrame:
    """O1: the head of the review queue: newest batch, then page, then id; settled results and those without status don't queue."""
    open_ = pending_results(results, scores).where(~F.col("status").isin("REVIEWED", "AUTO_APPROVED"))
    joined = open_.join(batches.select(F.col("id").alias("batch_id"), F.col("created_at").alias("batch_at")), "batch_id")
    return joined.orderBy(F.desc_nulls_last("batch_at"), "page_number", "id").limit(n).select("id", "batch_id", "page_number", "status")


def latest_updates(updates: DataFrame) -> DataFrame:
    """The last update of each (result, question) by (ts, event_id)."""
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("ts"), F.desc("event_id")))
    return updates.withColumn("_p", place).where("_p = 1").drop("_p")


def apply_score_updates(scores: DataFrame, updates: DataFrame) -> DataFrame:
    """M1: final score and comment set, review cleared; several updates of one score: the last counts."""
    last = latest_updates(updates).select(*KEY, F.col("final_score").alias("_f"), F.col("comment").alias("_c"), F.lit(True).alias("_u"))
    joined = scores.join(last, list(KEY), "left")
    hit = F.coalesce("_u", F.lit(False))
    return joined.select(
        *[c for c in scores.columns if c not in ("final_score", "requires_manual_review")],
        F.when(hit, F.col("_f")).otherwise(F.col("final_score")).alias("final_score"),
        (F.col("requires_manual_review") & ~hit).alias("requires_manual_review"), F.col("_c").alias("professor_comment"),
    )


def after_updates(results: DataFrame, updated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M1's follow-up: totals per result and status per batch; result statuses stay."""
    return student_totals(updated), batch_status(results, updated)


def apply_approvals(results: DataFrame, scores: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M2: pending scores of approved results get final := coalesce(final, ai) and are cleared; the results become REVIEWED."""
    ids = approvals.select("student_result_id").distinct().withColumn("_a", F.lit(True))
    joined = scores.join(ids, "student_result_id", "left")
    hit = F.coalesce("_a", F.lit(False)) & F.col("requires_manual_review")
    new = joined.withColumn("final_score", F.when(hit, F.coalesce("final_score", "ai_score")).otherwise(F.col("final_score")))
    new = new.withColumn("requires_manual_review", F.col("requires_manual_review") & ~hit).select(*scores.columns)
    seen = results.join(ids.withColumnRenamed("student_result_id", "id"), "id", "left")
    status = F.when(F.col("_a"), "REVIEWED").otherwise(F.col("status"))
    return seen.withColumn("status", status).select(*results.columns), new


def patch_answers(answers: DataFrame, patches: DataFrame) -> DataFrame:
    """M3: answers patched by (run, page, question): texts where given, score and flag always, an empty reason is none.

    patches(run_id, page_number, question_number, new_text, new_score, new_review, new_reason) holds one row per key.
    """
    key = ["run_id", "page_number", "question_number"]
    joined = answers.join(patches.withColumn("_p", F.lit(True)), key, "left")
    hit = F.coalesce("_p", F.lit(False))
    return joined.select(
        *[c for c in answers.columns if c not in ("answer_transcription", "score", "needs_human_review")],
        F.coalesce("new_text", "answer_transcription").alias("answer_transcription"),
        F.when(hit, F.col("new_score")).otherwise(F.col("score")).alias("score"),
        F.when(hit, F.col("new_review")).otherwise(F.col("needs_human_review")).alias("needs_human_review"), first_filled(F.col("new_reason")).alias("review_reason"),
    )


def upsert_roster(students: DataFrame, incoming: DataFrame) -> DataFrame:
    """M4: students after a roster load, with `change` inserted, updated or same; the last line of a key counts.

    incoming(class_id, registration_number, name, curso, line_no). New rows have no id yet.
    """
    key = ["class_id", "registration_number"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("line_no")))
    new = incoming.withColumn("_p", place).where("_p = 1").select(*key, F.col("name").alias("_n"), F.col("curso").alias("_c"), F.lit(True).alias("_i"))
    joined = students.join(new, key, "full")
    differs = F.col("_i") & (~F.col("_n").eqNullSafe(F.col("name")) | ~F.col("_c").eqNullSafe(F.col("curso")))
    change = F.when(F.col("id").isNull(), "inserted").when(F.coalesce(differs, F.lit(False)), "updated").otherwise("same")
    pick = lambda n, o: F.when(F.coalesce("_i", F.lit(False)), F.col(n)).otherwise(F.col(o))
    return joined.select("id", *key, pick("_n", "name").alias("name"), pick("_c", "curso").alias("curso"), change.alias("change"))


def roster_counts(upserted: DataFrame) -> DataFrame:
    return upserted.agg(F.count_if(F.col("change") == "inserted").alias("inserted"), F.count_if(F.col("change") == "updated").alias("updated"))


def upsert(dim: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """M5: incoming rows replace those of the same key."""
    return dim.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def delete_exams(keys: DataFrame, exams: DataFrame, questions: DataFrame, batches: DataFrame, results: DataFrame, scores: DataFrame) -> dict[str, DataFrame]:
    """What stays of each table when exams(exam_id) go with all that hangs on them."""
    gone_batches = batches.join(keys, "exam_id", "left_semi").select(F.col("id").alias("batch_id"))
    gone_results = results.join(gone_batches, "batch_id", "left_semi").select(F.col("id").alias("student_result_id"))
    return {
        "exams": exams.join(keys.withColumnRenamed("exam_id", "id"), "id", "left_anti"), "questions": questions.join(keys, "exam_id", "left_anti"),
        "batches": batches.join(keys, "exam_id", "left_anti"), "results": results.join(gone_batches, "batch_id", "left_anti"),
        "scores": scores.join(gone_results, "student_result_id", "left_anti"),
    }


def delete_classes(keys: DataFrame, students: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Students of classes(class_id) go; their results stay without a student."""
    gone = students.join(keys, "class_id", "left_semi").select(F.col("id").alias("student_id"), F.lit(True).alias("_g"))
    kept = results.join(gone, "student_id", "left").withColumn("student_id", F.when(F.col("_g").isNull(), F.col("student_id"))).select(*results.columns)
    return students.join(keys, "class_id", "left_anti"), kept
