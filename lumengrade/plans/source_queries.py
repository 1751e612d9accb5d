"""Scans, sinks, streams and listings as queries: tables are written to the shared folder and read again from there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import reports
from ..sources.batch_table import BatchTable, Refused
from ..sources.shared import shared_path, written
from ..sources.sinks import bucketed, read_report, write_report
from ..sources.tables import load_tables, overwrite_batches, reprocess
from ..streaming import jobs
from .registry import query
from .score_queries import r6

ENTITIES = {
    "classes": "SELECT CAST(id AS STRING) AS id, name FROM fx_classes",
    "students": "SELECT CAST(id AS STRING) AS id, CAST(class_id AS STRING) AS class_id, name, registration_number FROM fx_students",
    "question_scores": "SELECT id, CAST(student_result_id AS STRING) AS student_result_id, ai_score, final_score, requires_manual_review, CAST(source_page_number AS INT) AS source_page_number FROM fx_scores",
}


@query("s5_load_tables", """SELECT 'classes' AS entity, CAST(id AS VARCHAR) AS id, name AS said, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS absent FROM fx_classes
  UNION ALL SELECT 'students', CAST(id AS VARCHAR), registration_number, NULL, NULL FROM fx_students UNION ALL SELECT 'question_scores', id, CAST(student_result_id AS VARCHAR), ai_score, NULL FROM fx_scores""")
def _(v):
    """Entity files that lack some of their columns, read with the declared schemas; absent columns are null."""
    folder = shared_path(v.spark, "entities")
    for name, sql in ENTITIES.items():
        v.sql(sql).write.parquet(f"{folder}/{name}.parquet")
    t = load_tables(v.spark, folder, list(ENTITIES))
    none = F.lit(None).cast("double")
    one = lambda name, said, score, absent: t[name].select(F.lit(name).alias("entity"), "id", F.col(said).alias("said"), score.alias("score"), F.col(absent).cast("string").alias("absent"))
    return one("classes", "name", none, "created_at").unionByName(one("students", "registration_number", none, "curso")).unionByName(one("question_scores", "student_result_id", F.col("ai_score"), "ai_justification"))


SHEETS = "SELECT r.batch_id, s.student_result_id, s.question_number, s.source_page_number, s.ai_score FROM fx_scored s JOIN fx_results r ON r.id = s.student_result_id"


@query("s9_overwrite_batches", f"""SELECT batch_id, student_result_id, question_number, CASE WHEN batch_id % 2 = 0 AND batch_id % 5 = 0 THEN 0.0 WHEN batch_id % 2 = 0 AND batch_id % 5 <> 1 THEN ai_score + 1 ELSE ai_score END AS ai_score FROM ({SHEETS}) s""")
def _(v):
    """All batches are written; then the even ones again, but for those in work (1, 6 of ten); then some of them twice more."""
    path, rows = shared_path(v.spark, "batches"), v.sql(SHEETS).drop("source_page_number")
    overwrite_batches(rows, path)
    again = rows.where("batch_id % 2 = 0").withColumn("ai_score", F.col("ai_score") + 1)
    reprocess(again, v.sql("SELECT id, CASE WHEN id % 5 = 1 THEN 'PROCESSING' ELSE 'DONE' END AS status FROM fx_batches"), path)
    for _ in range(2):  # writing a batch again gives the same table
        overwrite_batches(again.where("batch_id % 5 = 0").withColumn("ai_score", F.lit(0.0)), path)
    return v.spark.read.parquet(path).select(F.col("batch_id").cast("long").alias("batch_id"), "student_result_id", "question_number", "ai_score")


@query("s9_atomic_reprocess", f"""SELECT k.moment, s.batch_id, count(*) AS scores, round(sum(CASE k.moment WHEN 'committed' THEN CASE WHEN batch_id % 2 = 0 THEN ai_score + 1 ELSE ai_score END
      WHEN 'refused' THEN CASE WHEN batch_id % 2 = 0 THEN ai_score + 1 ELSE ai_score END ELSE ai_score END), 6) AS total
  FROM ({SHEETS}) s JOIN (SELECT 'written' AS moment UNION ALL SELECT 'committed' UNION ALL SELECT 'refused' UNION ALL SELECT 'emptied') k ON k.moment <> 'emptied' GROUP BY 1, 2
  UNION ALL SELECT 'emptied', batch_id, count(*), round(sum(CASE WHEN batch_id % 2 = 0 THEN ai_score + 1 ELSE ai_score END), 6) FROM ({SHEETS}) s WHERE batch_id % 4 <> 0 GROUP BY 2""")
def _(v):
    """What a reader sees while even batches are written again (the old rows), once they are committed, after a slower writer of some of them
    and one of batches in work have been refused, and after every fourth batch was replaced by no rows."""
    rows = v.sql(SHEETS).drop("source_page_number")
    table = BatchTable(v.spark, shared_path(v.spark, "batches"), rows.schema)
    seen = lambda moment: table.read().groupBy("batch_id").agg(F.count("*").alias("scores"), r6(F.sum("ai_score")).alias("total")).select(F.lit(moment).alias("moment"), "*")
    table.replace(rows)
    rows = table.read()  # the same rows, from here on read as they were stored
    again = rows.where("batch_id % 2 = 0").withColumn("ai_score", F.col("ai_score") + 1)
    slower = table.write(rows.where("batch_id % 6 = 0").withColumn("ai_score", F.lit(9.0)))
    written = table.write(again)
    out = [seen("written")]
    table.commit(written)
    out.append(seen("committed"))
    busy = v["fx_batches"].where("id % 5 = 1").select(F.col("id").alias("batch"))
    for late, in_work in ((slower, None), (table.write(rows.where("batch_id % 5 = 1")), busy)):
        try:
            table.commit(late, in_work)
        except Refused:
            continue
        raise AssertionError("a commit that stands against another went through")
    out.append(seen("refused"))
    table.replace(rows.limit(0), replaced=[r.batch_id for r in rows.where("batch_id % 4 = 0").select("batch_id").distinct().collect()])  # one name a batch
    out.append(seen("emptied"))
    return reduce(DataFrame.unionByName, out)


@query("s6_bucketed_tables", """SELECT r.id AS student_result_id, r.batch_id, round(sum(coalesce(s.final_score, s.ai_score)), 6) AS total, count(*) AS scores, bool_or(s.requires_manual_review) AS pending
  FROM fx_results r JOIN fx_scored s ON s.student_result_id = r.id GROUP BY 1, 2""")
def _(v):
    """Results by batch and scores, both in buckets of the result: joined and totalled without a shuffle."""
    results = bucketed(v["fx_results"].select(F.col("id").alias("student_result_id"), "status", "batch_id"), "student_result_id", 8, "batch_id")
    scored = bucketed(v["fx_scored"].select("student_result_id", "question_number", "ai_score", "final_score", "requires_manual_review"), "student_result_id", 8)
    return bucket_totals(results, scored)


def bucket_totals(results: DataFrame, scored: DataFrame) -> DataFrame:
    both = results.hint("merge").join(scored, "student_result_id")
    total = r6(F.sum(F.coalesce("final_score", "ai_score"))).alias("total")
    return both.groupBy("student_result_id", "batch_id").agg(total, F.count("*").alias("scores"), F.bool_or("requires_manual_review").alias("pending"))


@query("s7_report_csv", """SELECT id, run_id, page_number, student_name, CASE WHEN registration = '' THEN NULL ELSE registration END AS registration, answer_transcription, score, needs_human_review FROM fx_answers""")
def _(v):
    """Answers written as a CSV report, texts with quotes, separators and line breaks among them, and read again."""
    rows, path = v["fx_answers"].select("id", "run_id", "page_number", "student_name", "registration", "answer_transcription", "score", "needs_human_review"), shared_path(v.spark, "report")
    write_report(rows, path)
    return read_report(v.spark, path, rows.schema)


PAGES = "SELECT id AS page_id, CAST(FLOOR(batch_id / 100.0) AS BIGINT) AS batch_id, CAST(created_at AS TIMESTAMP) AS page_ts, LEAST(3, (YEAR(created_at) - 1992) DIV 2) AS slice FROM fx_results"
TEXTS = """SELECT r.page_id, s.question_number, s.ai_score, r.page_ts + s.question_number * INTERVAL 1 HOUR AS text_ts,
  CASE r.page_id % 3 WHEN 0 THEN GREATEST(0, r.slice - 1) WHEN 1 THEN LEAST(3, r.slice + 1) ELSE r.slice END AS slice
  FROM fx_scored s JOIN pages r ON r.page_id = s.student_result_id WHERE r.page_id % 10 <> 0"""


def _arrive(v, rows, slices, *steps) -> None:
    """The rows of each slice land as files of one more micro-batch; each step starts its stream from its checkpoint again."""
    rows = [(written(df, "arriving"), folder) for df, folder in rows]  # worked out once, not once a slice
    for k in range(slices):
        for df, folder in rows:
            df.where(F.col("slice") == k).drop("slice").write.mode("append").parquet(folder)
        for step in steps:
            step().trigger(availableNow=True).start().awaitTermination()


@query("t1_grading_stream", f"""WITH pages AS ({PAGES.replace("DIV", "//")}), texts AS ({TEXTS}), seen AS (SELECT least((SELECT max(page_ts) FROM pages), (SELECT max(text_ts) FROM texts)) - INTERVAL 800 DAY AS w)
  SELECT batch_id, p.page_id, count(t.page_id) AS scores, round(sum(ai_score), 6) AS total FROM pages p LEFT JOIN texts t ON t.page_id = p.page_id CROSS JOIN seen
  WHERE t.page_id IS NOT NULL OR page_ts + INTERVAL 10 HOUR < w GROUP BY 1, 2""")
def _(v):
    """Pages and transcriptions land in four rounds, a third of the transcriptions a round before their pages and a third one after; each tenth page never
    gets any and comes out alone once the watermark has passed it. Each round is a start from the checkpoint."""
    pages, texts, inbox, check = (shared_path(v.spark, f"stream-{x}") for x in ("pages", "texts", "inbox", "check"))
    p = v.sql(PAGES)
    t = v.spark.sql(TEXTS.replace("fx_scored", "{s}").replace("pages r", "{p} r"), s=v["fx_scored"], p=p)
    graded = BatchTable(v.spark, shared_path(v.spark, "stream-out"), "batch_id long, page_id long, scores long, total double")
    whole = lambda df: df.groupBy("batch_id", "page_id").agg(F.count("question_number").alias("scores"), r6(F.sum("ai_score")).alias("total"))

    def grade():
        left, right = (v.spark.readStream.schema(df.drop("slice").schema).parquet(folder) for df, folder in ((p, pages), (t, texts)))
        return jobs.grade_stream(jobs.page_tasks(left, right, delay="800 days", wait="10 hours"), inbox, graded, check, whole)

    _arrive(v, [(p, pages), (t, texts)], 4, grade)
    return graded.read()


#: One row per slice and key, and a tenth of the rows a slice (8 days) late.
REPEATS = """SELECT slice, student_result_id, question_number, action, MIN(ts) AS ts
  FROM (SELECT *, LEAST(3, CAST((DAY(ts) - 1) / 8 AS INT)) + CASE WHEN event_id % 10 = 0 AND DAY(ts) <= 24 THEN 1 ELSE 0 END AS slice FROM fx_decisions) d GROUP BY 1, 2, 3, 4"""


@query("t2_dedupe_stream", f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY student_result_id, question_number, action ORDER BY slice) AS n FROM ({REPEATS.replace("CAST((DAY(ts) - 1) / 8 AS INT)", "(DAY(ts) - 1) // 8")}) r),
  w AS (SELECT slice + 1 AS slice, max(max(ts)) OVER (ORDER BY slice) - INTERVAL 3 DAY AS late FROM a GROUP BY slice),
  rows AS (SELECT a.*, w.late FROM a LEFT JOIN w USING (slice)),
  walk AS (SELECT student_result_id, question_number, action, 0::BIGINT AS n, NULL::TIMESTAMP AS held, FALSE AS passed, NULL::TIMESTAMP AS ts FROM rows GROUP BY 1, 2, 3
    UNION ALL SELECT student_result_id, question_number, action, n, CASE WHEN p THEN ts ELSE held END, p, ts
    FROM (SELECT r.*, k.held, coalesce(r.ts > r.late, TRUE) AND coalesce(k.held + INTERVAL 3 DAY <= r.late, TRUE) AS p FROM walk k JOIN rows r
      ON r.student_result_id = k.student_result_id AND r.question_number = k.question_number AND r.action = k.action AND r.n = k.n + 1) s)
  SELECT student_result_id, question_number, action, ts FROM walk WHERE passed""")
def _(v):
    """Four rounds of decisions under a watermark of three days: repeats drop out while their key is held, a tenth of the rows come a round late and mostly
    drop out behind the watermark, and keys whose state has gone pass again."""
    landing, out, check = (shared_path(v.spark, f"repeats-{x}") for x in ("in", "out", "check"))
    rows = v.sql(REPEATS).withColumn("ts", F.col("ts").cast("timestamp"))

    def once():
        stream = v.spark.readStream.schema(rows.drop("slice").schema).parquet(landing)
        kept = jobs.dedupe_stream(stream, ["student_result_id", "question_number", "action"], delay="3 days")
        return kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", check)

    _arrive(v, [(rows.unionByName(rows), landing)], 4, once)  # each row twice
    return v.spark.read.schema(rows.drop("slice").schema).parquet(out)


@query("t3_latest_decisions", """
SELECT student_result_id, question_number, action, final_score, event_id FROM (SELECT *, row_number() OVER (PARTITION BY student_result_id, question_number ORDER BY ts DESC, event_id DESC) AS p FROM fx_decisions) t WHERE p = 1""")
def _(v):
    """Decisions in three rounds out of order, the first round's again in the last; the table of last decisions is merged by key and restarted each round."""
    landing, check = (shared_path(v.spark, f"decisions-{x}") for x in ("in", "check"))
    rows = v["fx_decisions"].select("event_id", F.col("ts").cast("timestamp").alias("ts"), "student_result_id", "question_number", "action", "final_score", F.pmod("event_id", F.lit(3)).alias("slice"))
    rows = rows.unionByName(rows.where("slice = 0").withColumn("slice", F.lit(2).cast("long")))
    last = BatchTable(v.spark, shared_path(v.spark, "decisions-out"), "bucket int, student_result_id long, question_number int, action string, final_score double, ts timestamp, event_id long", key="bucket", most=16)

    def merge():
        stream = v.spark.readStream.schema(rows.drop("slice").schema).parquet(landing)
        return jobs.merge_stream(jobs.latest_decisions(stream), last, ["student_result_id", "question_number"], ["ts", "event_id"], check)

    _arrive(v, [(rows, landing)], 3, merge)
    return last.read().drop("bucket", "ts")


@query("t4_batch_progress", """SELECT b.id AS batch_id, count(DISTINCT r.page_number) AS pages_done, count(r.id) AS results_done,
       round(least(100.0, 100.0 * count(DISTINCT r.page_number) / max(b.total_pages)), 2) AS percent FROM fx_batches b JOIN fx_results r ON r.batch_id = b.id GROUP BY b.id""")
def _(v):
    """Results in three rounds; counts and percent of each batch as a stream joined with the table of batches end as A18 has them."""
    landing, check = (shared_path(v.spark, f"progress-{x}") for x in ("in", "check"))
    rows = v["fx_results"].select("batch_id", "page_number", "status", F.pmod("id", F.lit(3)).alias("slice"))
    live = BatchTable(v.spark, shared_path(v.spark, "progress-out"), "bucket int, batch_id long, pages_done long, results_done long, percent double", key="bucket", most=16)

    def merge():
        stream = v.spark.readStream.schema(rows.drop("slice").schema).parquet(landing)
        return jobs.merge_stream(jobs.progress_stream(stream, v["fx_batches"]), live, ["batch_id"], ["results_done"], check)

    _arrive(v, [(rows, landing)], 3, merge)
    return live.read().drop("bucket")


@query("o3_students_by_name", "SELECT class_id, row_number() OVER (PARTITION BY class_id ORDER BY name, id) AS place, id, name FROM fx_students")
def _(v):
    return reports.listing(v["fx_students"], ["class_id"], ["name", "id"]).select("class_id", "place", "id", "name")


@query("o3_results_by_page", "SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY page_number, id) AS place, id, status FROM fx_results")
def _(v):
    return reports.listing(v["fx_results"], ["batch_id"], ["page_number", "id"]).select("batch_id", "place", "id", "status")


@query("o3_questions_by_number", "SELECT exam_id, row_number() OVER (PARTITION BY exam_id ORDER BY question_number, id) AS place, id FROM fx_questions")
def _(v):
    return reports.listing(v["fx_questions"], ["exam_id"], ["question_number", "id"]).select("exam_id", "place", "id")


@query("o3_run_answers", "SELECT run_id, row_number() OVER (PARTITION BY run_id, page_number ORDER BY question_number, id) AS place, page_number, id FROM fx_answers")
def _(v):
    return reports.listing(v["fx_answers"], ["run_id", "page_number"], ["question_number", "id"]).select("run_id", "place", "page_number", "id")
