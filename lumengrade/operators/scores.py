"""Scores per (result, question): repeats, totals, statuses, consolidation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grades import cap_grade
from ..functions.values import quarter

KEY = ("student_result_id", "question_number")


def _one_per_key(df: DataFrame, keys: tuple[str, ...], *order) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def dedupe_first(scores: DataFrame) -> DataFrame:
    """The first score of each (result, question) in page, box, id order."""
    return _one_per_key(scores, KEY, "source_page_number", "box_pos", "id")


def dedupe_latest(scores: DataFrame) -> DataFrame:
    """The score of greatest id of each (result, question)."""
    return _one_per_key(scores, KEY, F.col("id").desc())


def effective() -> F.Column:
    return F.coalesce("final_score", "ai_score", F.lit(0.0))


def student_totals(scores: DataFrame) -> DataFrame:
    """A1: (student_result_id, total_score)."""
    return scores.groupBy("student_result_id").agg(F.sum(effective()).alias("total_score"))


def student_status(results: DataFrame, scores: DataFrame) -> DataFrame:
    """A2: (id, total_score, status); results without scores are approved with total 0."""
    per = scores.groupBy("student_result_id").agg(F.sum(effective()).alias("t"), F.bool_or("requires_manual_review").alias("p"))
    pending = F.coalesce("p", F.lit(False))
    joined = results.select("id").join(per, F.col("id") == F.col("student_result_id"), "left")
    return joined.select("id", F.coalesce("t", F.lit(0.0)).alias("total_score"), F.when(pending, "GRADED").otherwise("AUTO_APPROVED").alias("status"))


def finalised(scores: DataFrame) -> DataFrame:
    """A2's side effect: final := ai where no review is asked for and none is set."""
    return scores.withColumn("final_score", F.when(~F.col("requires_manual_review"), F.coalesce("final_score", "ai_score")).otherwise(F.col("final_score")))


def batch_status(results: DataFrame, scores: DataFrame) -> DataFrame:
    """A3: (batch_id, status) by whether any score of the batch is pending."""
    per = scores.groupBy("student_result_id").agg(F.bool_or("requires_manual_review").alias("p"))
    joined = results.select("id", "batch_id").join(per, F.col("id") == F.col("student_result_id"), "left")
    pending = F.bool_or(F.coalesce("p", F.lit(False)))
    return joined.groupBy("batch_id").agg(F.when(pending, "REVIEW_PENDING").otherwise("DONE").alias("status"))


def pending_results(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Results with a pending score."""
    return results.join(scores.where("requires_manual_review").select(F.col("student_result_id").alias("id")), "id", "left_semi")


def batch_stats(results: DataFrame, scores: DataFrame) -> DataFrame:
    """A4: per batch: total, auto_approved, reviewed, pending_review, counting results once."""
    waiting = scores.where("requires_manual_review").select(F.col("student_result_id").alias("id")).distinct().withColumn("w", F.lit(True))
    return (
        results.join(waiting, "id", "left").groupBy("batch_id")
        .agg(F.count("*").alias("total"), F.count_if(F.col("status") == "AUTO_APPROVED").alias("auto_approved"), F.count_if(F.col("status") == "REVIEWED").alias("reviewed"), F.count_if("w").alias("pending_review"))
    )


def remaining_pending(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Number of results that still hold a pending score."""
    return pending_results(results, scores).agg(F.countDistinct("id").alias("remaining"))


def final_mark(scores: DataFrame, exam_of: DataFrame, questions: DataFrame) -> DataFrame:
    """(student_result_id, mark): sum over the exam's number of questions, missing ones count 0, to the even quarter.

    Sums are cut to 6 places first, so that binary noise doesn't tip a half.

    exam_of(student_result_id, exam_id) names each result's exam.
    """
    n = questions.groupBy("exam_id").agg(F.count("*").alias("n"))
    got = scores.groupBy("student_result_id").agg(F.round(F.sum(F.coalesce("final_score", "ai_score")), 6).alias("s"))
    joined = exam_of.join(got, "student_result_id", "left").join(n, "exam_id", "left")
    mark = F.when(F.col("n") > 0, quarter(F.coalesce("s", F.lit(0.0)) / F.col("n"))).otherwise(0.0)
    return joined.select("student_result_id", mark.alias("mark"))


def complete_grades(grades: DataFrame, questions: DataFrame, keep_scores: bool = True) -> DataFrame:
    """grades(result_id, exam_id, question_number, score) completed with a zero row for each question they lack.

    keep_scores=False is the all-zero variant.
    """
    q = questions.select("exam_id", "question_number", "max_score")
    have = grades.join(q, ["exam_id", "question_number"], "left")
    score = cap_grade(F.coalesce("score", F.lit(0.0)), F.col("max_score")) if keep_scores else F.lit(0.0)
    have = have.select("result_id", "exam_id", "question_number", score.alias("score"), F.coalesce("max_score", F.lit(1.0)).alias("max_score"))
    wanted = grades.select("result_id", "exam_id").distinct().join(q, "exam_id")
    lacking = wanted.join(grades.select("result_id", "question_number"), ["result_id", "question_number"], "left_anti")
    return have.unionByName(lacking.select("result_id", "exam_id", "question_number", F.lit(0.0).alias("score"), "max_score"))


def batch_summary(results: DataFrame, totals: DataFrame) -> DataFrame:
    """Mean, least, greatest total and its deviation per batch."""
    joined = results.select(F.col("id").alias("student_result_id"), "batch_id").join(totals, "student_result_id")
    t = F.col("total_score")
    return joined.groupBy("batch_id").agg(F.avg(t).alias("mean_total"), F.min(t).alias("min_total"), F.max(t).alias("max_total"), F.stddev_samp(t).alias("sd_total"))


def question_difficulty(scores: DataFrame, max_score: float = 1.0) -> DataFrame:
    """Share of points and share of full answers per question."""
    s = F.coalesce("final_score", "ai_score", F.lit(0.0))
    return scores.groupBy("question_number").agg(F.avg(s / max_score).alias("share_of_points"), F.avg((s >= 0.99 * max_score).cast("double")).alias("share_correct"), F.count("*").alias("answers"))


def final_scores(scores: DataFrame) -> DataFrame:
    """Total and whether every score has been settled."""
    return scores.groupBy("student_result_id").agg(F.sum(effective()).alias("total_score"), F.bool_and(~F.col("requires_manual_review")).alias("reviewed_by_all"))


def batch_progress(batches: DataFrame, results: DataFrame) -> DataFrame:
    """Pages and results done per batch, and percent of its pages."""
    done = F.col("status") != "PENDING"
    per = results.groupBy("batch_id").agg(F.countDistinct(F.when(done, F.col("page_number"))).alias("p"), F.count_if(done).alias("r"))
    joined = batches.join(per, batches["id"] == per["batch_id"], "left")
    pages = F.coalesce("p", F.lit(0))
    share = F.when(F.col("total_pages") > 0, F.round(F.least(F.lit(100.0), 100.0 * pages / F.col("total_pages")), 2)).otherwise(0.0)
    return joined.select(F.col("id").alias("batch_id"), pages.alias("pages_done"), F.coalesce("r", F.lit(0)).alias("results_done"), share.alias("percent"))


def source_pages(scores: DataFrame) -> DataFrame:
    """Distinct sorted source pages per result."""
    return scores.groupBy("student_result_id").agg(F.sort_array(F.collect_set("source_page_number")).alias("pages"))
