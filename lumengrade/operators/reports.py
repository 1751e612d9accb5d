"""Report, listing and history tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import identity_key
from ..functions.messages import friendly_reason, warning_code, warning_message, warning_stage
from ..functions.values import first_filled, quarter, strip


def result_detail(results: DataFrame, scores: DataFrame, questions: DataFrame, students: DataFrame) -> DataFrame:
    """Each result with its scores nested in question order; scores of unknown questions drop out.

    scores(student_result_id, question_id, ...), questions(id, question_number, max_score).
    """
    q = questions.select(F.col("id").alias("question_id"), F.col("question_number").alias("_n"), "max_score")
    item = F.struct(F.col("_n").alias("question_number"), "ai_score", "final_score", "max_score")
    nested = scores.join(q, "question_id").groupBy("student_result_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    who = students.select(F.col("id").alias("student_id"), "name", "registration_number")
    return results.join(nested, F.col("id") == F.col("student_result_id")).join(who, "student_id", "left").select("id", "name", "registration_number", "items")


def export_rows(results: DataFrame, students: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per result with the defaults of nameless pages."""
    s = students.select(F.col("id").alias("student_id"), "name", "registration_number", "class_id", "curso", F.lit(True).alias("_s"))
    c = classes.select(F.col("id").alias("class_id"), F.col("name").alias("turma"))
    joined = results.join(s, "student_id", "left").join(c, "class_id", "left")
    page = F.col("page_number").cast("string")
    return joined.select(
        F.col("id").alias("student_result_id"),
        F.coalesce("name", F.concat(F.lit("Aluno (pág. "), page, F.lit(")"))).alias("student_name"),
        F.coalesce("registration_number", F.concat(F.lit("P"), page)).alias("registration_number"),
        F.coalesce("curso", F.lit("")).alias("curso"), F.coalesce("turma", F.when(F.col("_s"), F.lit("—")).otherwise(F.lit(""))).alias("turma"),
    )


def exam_summary(exams: DataFrame, questions: DataFrame) -> DataFrame:
    """Exams with their number of questions, 0 when none."""
    n = questions.groupBy("exam_id").agg(F.count("*").alias("n"))
    return exams.join(n, exams["id"] == n["exam_id"], "left").select("id", F.coalesce("n", F.lit(0)).alias("question_count"))


def class_summary(classes: DataFrame, students: DataFrame) -> DataFrame:
    """Classes by name with their number of students."""
    n = students.groupBy("class_id").agg(F.count("*").alias("n"))
    return classes.join(n, classes["id"] == n["class_id"], "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("student_count")).orderBy("name", "id")


def batch_history(batches: DataFrame, results: DataFrame, scores: DataFrame, user_id: int | None = None) -> DataFrame:
    """Per batch of a user: students, scores and pending scores."""
    mine = batches if user_id is None else batches.where(F.col("user_id") == user_id)
    per_result = scores.groupBy("student_result_id").agg(F.count("*").alias("n"), F.count_if("requires_manual_review").alias("p"))
    per = results.select("id", "batch_id").join(per_result, F.col("id") == F.col("student_result_id"), "left").groupBy("batch_id")
    per = per.agg(F.count("*").alias("students"), F.coalesce(F.sum("n"), F.lit(0)).alias("scores"), F.coalesce(F.sum("p"), F.lit(0)).alias("pending"))
    joined = mine.join(per, mine["id"] == per["batch_id"], "left")
    return joined.select(F.col("id").cast("string").alias("id"), "created_at", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("students", "scores", "pending")])


def run_history(answers: DataFrame) -> DataFrame:
    """Per run: distinct identities, answers and pending answers."""
    key = identity_key(F.col("detected_student_code"), F.col("registration"), F.col("student_name"), F.col("page_number"))
    return answers.groupBy("run_id").agg(F.countDistinct(key).alias("students"), F.count("*").alias("scores"), F.count_if("needs_human_review").alias("pending"))


def history(batches: DataFrame, runs: DataFrame, limit: int = 50) -> DataFrame:
    """UN1 / O2: both histories in one shape, newest first, missing times last; limit within 1..200."""
    shape = ["kind", "id", "created_at", "students", "scores", "pending"]
    both = batches.withColumn("kind", F.lit("batch")).select(*shape).unionByName(runs.withColumn("kind", F.lit("visual")).select(*shape))
    return both.orderBy(F.desc_nulls_last("created_at"), "kind", "id").limit(min(200, max(1, limit)))


def history_totals(rows: DataFrame) -> DataFrame:
    """A10: items, items with something pending, students in all."""
    return rows.agg(F.count("*").alias("items"), F.count_if(F.col("pending") > 0).alias("with_pending"), F.sum("students").alias("students"))


def run_rows(answers: DataFrame, reasons: int = 5) -> DataFrame:
    """Answers grouped by identity: first name, registration, last score per question summed, any review, first reasons.

    answers(run_id, page_number, question_number, id, student_name, registration, detected_student_code, score, needs_human_review, reason).
    """
    key = identity_key(F.col("detected_student_code"), F.col("registration"), F.col("student_name"), F.col("page_number"))
    keyed = answers.withColumn("student_key", key)
    order = F.struct("page_number", "question_number", "id")
    last = keyed.where("score is not null").groupBy("run_id", "student_key", "question_number").agg(F.max_by("score", order).alias("s"))
    total = last.groupBy("run_id", "student_key").agg(F.sum("s").alias("total"))
    # The first reasons are picked before anything is gathered.
    place = F.row_number().over(Window.partitionBy("run_id", "student_key").orderBy("page_number", "question_number", "id"))
    said = keyed.where(strip(F.coalesce("reason", F.lit(""))) != "").withColumn("_p", place).where(F.col("_p") <= reasons)
    said = said.groupBy("run_id", "student_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_p", "reason"))), lambda x: x["reason"]), "; ").alias("reasons"))
    per = keyed.groupBy("run_id", "student_key").agg(
        F.min_by(F.nullif(strip("student_name"), F.lit("")), F.when(strip("student_name") != "", order)).alias("student_name"),
        F.min_by("registration", F.when(first_filled(F.col("registration")).isNotNull(), order)).alias("registration"),
        F.bool_or("needs_human_review").alias("needs_review"), F.count("*").alias("answers"),
    )
    joined = per.join(said, ["run_id", "student_key"], "left").join(total, ["run_id", "student_key"], "left")
    return joined.withColumns({"reasons": F.coalesce("reasons", F.lit("")), "total": F.coalesce("total", F.lit(0.0))})


def classify_warnings(df: DataFrame) -> DataFrame:
    """df(batch_id, warning) with code, stage and message."""
    code = warning_code(F.col("warning"))
    return df.withColumn("code", code).withColumn("stage", warning_stage(F.col("code"))).withColumn("message", warning_message(F.col("code"), F.col("warning")))


def warning_counts(df: DataFrame) -> DataFrame:
    """Warnings per batch, code and stage."""
    return classify_warnings(df).groupBy("batch_id", "code", "stage").agg(F.count("*").alias("n"))


def run_summary(pages: DataFrame, answers: DataFrame, most: int | None = 20) -> DataFrame:
    """Per run: pages, first non-empty models by page, fallbacks, the errors of the first `most` pages that have one (None: of all), how many have one,
    SUCCESS or FAILED. A run may be any share of the table: errors are dealt out by range and joined part by part, so that what comes together is the text returned.

    pages(run_id, page_number, vision_model, fallback_used, error), answers(run_id, page_number, question_number, text_model).
    """
    filled = lambda c: F.nullif(c, F.lit(""))
    per = pages.groupBy("run_id").agg(
        F.count("*").alias("pages_processed"), F.min_by(filled("vision_model"), F.when(filled("vision_model").isNotNull(), F.col("page_number"))).alias("vision_model"),
        F.count_if("fallback_used").alias("fallback_pages"), F.count_if(filled("error").isNotNull()).alias("errors"),
    )
    order = ["page_number", "error"]
    said = pages.where(filled("error").isNotNull()).select("run_id", *order)
    said = top_n(said, ["run_id"], order, most) if most is not None else said.repartitionByRange("run_id", *order)
    joined_by = lambda place, text: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*place, text))), lambda x: x[text]), " | ")
    said = said.withColumn("_part", F.spark_partition_id()).groupBy("run_id", "_part").agg(joined_by(order[:1], "error").alias("_text"), F.min(F.struct(*order)).alias("_at"))
    said = said.groupBy("run_id").agg(joined_by(["_at", "_part"], "_text").alias("e"))
    text = answers.groupBy("run_id").agg(F.min_by(filled("text_model"), F.when(filled("text_model").isNotNull(), F.struct("page_number", "question_number"))).alias("text_model"))
    joined = per.join(said, "run_id", "left").join(text, "run_id", "left")
    return joined.withColumn("error", F.coalesce("e", F.lit(""))).drop("e").withColumn("status", F.when(F.col("errors") == 0, "SUCCESS").otherwise("FAILED"))


def report_details(rows: DataFrame) -> DataFrame:
    """S7, question detail: rows with a friendly reason; low is a confidence under 0.70, empty a blank text."""
    reason = friendly_reason(
        F.col("warnings"), F.col("error"), strip(F.coalesce("text", F.lit(""))) == "", F.coalesce(F.col("confidence") < 0.70, F.lit(False))
    )
    return rows.withColumn("review_text", reason)


def report_summary(export: DataFrame, marks: DataFrame, status: DataFrame) -> DataFrame:
    """S7, summary: export rows with mark and status."""
    return export.join(marks, "student_result_id", "left").join(status.select(F.col("id").alias("student_result_id"), "status"), "student_result_id", "left")


def report_reviews(details: DataFrame) -> DataFrame:
    """S7, reviews needed: detail rows that ask for review."""
    return details.where("needs_review")


def report_wide(scores: DataFrame, numbers: list[int]) -> DataFrame:
    """One row per result with a column per question and the total; the question list is given, so no extra job runs."""
    s = F.coalesce("final_score", "ai_score")
    wide = scores.withColumn("s", s).groupBy("student_result_id").pivot("question_number", numbers).agg(F.max("s"))
    named = wide.select("student_result_id", *[F.col(str(n)).alias(f"q{n}") for n in numbers])
    total = F.lit(0.0)
    for n in numbers:
        total = total + F.coalesce(f"q{n}", F.lit(0.0))
    return named.withColumn("total", total).withColumn("mark", quarter(total / len(numbers)))


def public_answers(answers: DataFrame) -> DataFrame:
    """No raw payloads, fixed columns."""
    keep = ["run_id", "page_number", "question_number", "student_name", "registration", "answer_transcription", "score", "needs_human_review"]
    return answers.select(*keep)


def last_non_empty(answers: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The last non-empty value per keys in (page, question, id) order."""
    filled = answers.where(strip(F.col(value)) != "")
    return filled.groupBy(*keys).agg(F.max_by(value, F.struct("page_number", "question_number", "id")).alias(value))


def top_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows per group."""
    return df.withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_p") <= n).drop("_p")


def listing(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """O3: df with each row's `place` in its group, as pages of a listing are cut."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
