"""Streams end in the state that the batch form gives."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lumengrade.operators import scores
from lumengrade.sources.batch_table import BatchTable, Refused
from lumengrade.sources.tables import overwrite_batches, reprocess
from lumengrade.streaming import jobs

SCHEMA = "batch_id long, student_result_id long, question_number int, score double, status string, ts timestamp, event_id long, action string, final_score double"


def rows(spark, at, n=40):
    r = F.col("id")
    return spark.range(at, at + n).select(
        (r % 3).alias("batch_id"), (r % 7).alias("student_result_id"), (r % 2).cast("int").alias("question_number"), (r % 5 / 4.0).alias("score"), F.when(r % 4 == 0, "PENDING").otherwise("GRADED").alias("status"),
        F.timestamp_seconds(r * 60).alias("ts"), r.alias("event_id"), F.lit("update").alias("action"), (r % 5 / 4.0).alias("final_score"))


def grade(df):
    return df.groupBy("batch_id", "student_result_id").agg(F.sum("score").alias("total"))


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query.recentProgress


PAGE, TEXT = "page_id long, batch_id string, page_ts timestamp", "page_id long, text string, text_ts timestamp"


class Grading:
    """Page and text folders, and the graded table they stream into."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, str(path)
        self.table = BatchTable(spark, f"{path}/out", "batch_id string, page_id long, texts long, said string")

    def land(self, pages, texts):
        for rows, schema, name in ((pages, PAGE, "pages"), (texts, TEXT, "texts")):
            texted = self.spark.createDataFrame(rows, schema.replace("timestamp", "string"))
            ts = schema.split()[-2]
            texted.withColumn(ts, F.col(ts).cast("timestamp")).write.mode("append").parquet(f"{self.path}/{name}")

    def writer(self, grade=None):
        def graded(df):
            return df.groupBy("batch_id", "page_id").agg(F.count("text").alias("texts"), F.max("text").alias("said"))

        left, right = (self.spark.readStream.schema(schema).parquet(f"{self.path}/{name}") for schema, name in ((PAGE, "pages"), (TEXT, "texts")))
        return jobs.grade_stream(jobs.page_tasks(left, right, delay="1 hour", wait="2 hours"), f"{self.path}/inbox", self.table, f"{self.path}/check", grade or graded)

    def rows(self):
        return sorted(map(tuple, self.table.read().collect()))


def test_pages_wait_for_their_texts(spark, tmp_path):
    g = Grading(spark, tmp_path)
    g.land([(1, "a/1", "2024-01-01 10:00:00"), (2, "a/1", "2024-01-01 10:05:00")], [(2, "two", "2024-01-01 10:10:00"), (3, "three", "2024-01-01 10:20:00")])
    run(g.writer())
    assert g.rows() == [("a/1", 2, 1, "two")]  # page 1 may still get a text, text 3 its page
    g.land([(3, "b", "2024-01-01 10:15:00")], [(1, "one", "2024-01-01 11:00:00"), (1, "far", "2024-01-01 12:30:00")])
    run(g.writer())
    assert g.rows() == [("a/1", 1, 1, "one"), ("a/1", 2, 1, "two"), ("b", 3, 1, "three")]  # a text of more than two hours away isn't the page's
    g.land([(4, "b", "2024-01-01 13:00:00")], [])
    run(g.writer())
    assert len(g.rows()) == 3
    g.land([(5, "c", "2024-01-02 13:00:00")], [(9, "nobody's", "2024-01-02 12:00:00")])
    run(g.writer())
    assert g.rows() == [("a/1", 1, 1, "one"), ("a/1", 2, 1, "two"), ("b", 3, 1, "three"), ("b", 4, 0, None)]  # page 4 alone, page 5 waits
    assert run(g.writer())[0]["numInputRows"] == 0 and len(g.rows()) == 4


def test_a_failed_micro_batch_runs_again(spark, tmp_path):
    g = Grading(spark, tmp_path)
    g.land([(k, "a", "2024-01-01 10:00:00") for k in range(3)], [(k, str(k), "2024-01-01 10:10:00") for k in range(3)])

    def fails(df):
        raise RuntimeError("grader is down")

    with pytest.raises(Exception, match="grader is down"):
        run(g.writer(fails))
    assert g.rows() == []
    run(g.writer())
    assert g.rows() == [("a", k, 1, str(k)) for k in range(3)]  # the inbox holds the rows of the failed try once


def test_only_touched_folders_are_read(spark, tmp_path):
    g = Grading(spark, tmp_path)
    g.land([(1, "a", "2024-01-01 10:00:00"), (2, "b", "2024-01-01 10:00:00")], [(k, "x", "2024-01-01 10:10:00") for k in (1, 2)])
    run(g.writer())
    seen = []

    def grade(df):
        seen.extend(f.split("/inbox/")[1].split("/")[0] for f in df.inputFiles())
        return df.groupBy("batch_id", "page_id").agg(F.count("text").alias("texts"), F.max("text").alias("said"))

    g.land([(3, "b", "2024-01-01 10:00:00")], [(3, "x", "2024-01-01 10:10:00")])
    run(g.writer(grade))
    assert set(seen) == {"batch_id=b"} and [r[:2] for r in g.rows()] == [("a", 1), ("b", 2), ("b", 3)]


def test_micro_batches_are_bounded(spark):
    with pytest.raises(ValueError, match="more than 3"):
        jobs.touched(spark.range(10), "id", 3)


def test_repeats_late_rows_and_evicted_keys(spark, tmp_path):
    schema = "k long, ts timestamp"

    def land(*rows):
        out = spark.createDataFrame([(k, f"2024-01-01 {ts}:00") for k, ts in rows], "k long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        out.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        once = jobs.dedupe_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["k"], delay="1 hour")
        steps = run(once.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check"))
        state = [s["stateOperators"][0] for s in steps if s["stateOperators"]]
        got = sorted((r.k, r.ts.strftime("%H:%M")) for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect())
        return got, state[-1]["numRowsTotal"], sum(s["numRowsDroppedByWatermark"] for s in state)

    assert land((1, "10:00"), (1, "10:00"), (2, "10:10")) == ([(1, "10:00"), (2, "10:10")], 2, 0)
    assert land((1, "10:30"), (3, "10:20")) == ([(1, "10:00"), (2, "10:10"), (3, "10:20")], 3, 0)  # a repeat within the hour
    got, held, late = land((4, "15:00"), (2, "10:11"))
    assert [k for k, _ in got] == [1, 2, 3, 4] and (held, late) == (1, 0)  # the watermark moves to 14:00 and takes the three old keys along
    got, held, late = land((5, "13:00"), (1, "14:30"), (4, "15:10"))
    assert got[-2:] == [(3, "10:20"), (4, "15:00")] and (1, "14:30") in got and len(got) == 5  # 5 came too late, 1 counts as new, 4 is still held
    assert (held, late) == (2, 1)


def test_latest_decisions_merge_by_key(spark, tmp_path):
    table = BatchTable(spark, f"{tmp_path}/out", "bucket int, student_result_id long, question_number int, action string, final_score double, ts timestamp, event_id long", key="bucket", most=4)

    def writer():
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        return jobs.merge_stream(jobs.latest_decisions(stream), table, ["student_result_id", "question_number"], ["ts", "event_id"], f"{tmp_path}/check")

    key = ["student_result_id", "question_number", "event_id"]
    for start, until in ((40, 80), (0, 90), (80, 85)):  # later rows first, then old ones and repeats
        rows(spark, start, until - start).write.mode("append").parquet(f"{tmp_path}/in")
        run(writer())
        whole = jobs.latest_decisions(spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in"))
        assert sorted(map(tuple, table.read().select(*key).collect())) == sorted(map(tuple, whole.select(*key).collect()))
    before = table.head()
    jobs_again = jobs.merge_stream(jobs.latest_decisions(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")), table, key[:2], ["ts", "event_id"], f"{tmp_path}/check2")
    want = sorted(map(tuple, table.read().collect()))
    run(jobs_again)  # everything once more, from no checkpoint
    assert sorted(map(tuple, table.read().collect())) == want and table.head() > before


def test_progress_merges_to_a18(spark, tmp_path):
    batches = spark.createDataFrame([(0, 50), (1, 4), (2, 0)], "id long, total_pages int")
    schema = "batch_id long, page_number int, status string, id long"
    table = BatchTable(spark, f"{tmp_path}/out", "bucket int, batch_id long, pages_done long, results_done long, percent double", key="bucket")
    made = rows(spark, 0, 60).select("batch_id", (F.col("event_id") % 9).cast("int").alias("page_number"), "status", F.col("event_id").alias("id"))
    for start in (0, 20, 40):
        made.where(f"id >= {start} and id < {start + 20}").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        run(jobs.merge_stream(jobs.progress_stream(stream, batches), table, ["batch_id"], ["results_done"], f"{tmp_path}/check"))
        want = scores.batch_progress(batches, spark.read.schema(schema).parquet(f"{tmp_path}/in"))
        names = ["batch_id", "pages_done", "results_done", "percent"]
        assert sorted(map(tuple, table.read().select(names).collect())) == sorted(map(tuple, want.select(names).collect()))


# the table of batches


def batch_rows(spark, **batches):
    return spark.createDataFrame([(b, x) for b, values in batches.items() for x in values] or [], "b string, x long")


def held(table, **more):
    out = {}
    for r in table.read(**more).collect():
        out.setdefault(r.b, []).append(r.x)
    return {b: sorted(x) for b, x in out.items()}


def test_commits_are_seen_whole_or_not_at_all(spark, tmp_path):
    table = BatchTable(spark, f"{tmp_path}/t", "b string, x long", key="b")
    assert held(table) == {} and table.head() == 0
    table.replace(batch_rows(spark, a=[1, 2], b=[3], **{"c/d e=f": [4]}))
    old = table.read()
    written = table.write(batch_rows(spark, a=[9]))
    assert held(table) == {"a": [1, 2], "b": [3], "c/d e=f": [4]}  # in place, not yet seen
    table.commit(written)
    assert held(table) == {"a": [9], "b": [3], "c/d e=f": [4]} and held(table, batches=["a", "c/d e=f", "none"]) == {"a": [9], "c/d e=f": [4]}
    assert sorted(r.x for r in old.collect()) == [1, 2, 3, 4]  # a reader of before keeps what it saw
    table.replace(batch_rows(spark), replaced=["b"])
    assert held(table) == {"a": [9], "c/d e=f": [4]}
    table.replace(batch_rows(spark, b=[7]))
    assert held(BatchTable(spark, f"{tmp_path}/t", "b string, x long", key="b")) == {"a": [9], "b": [7], "c/d e=f": [4]}
    assert table.vacuum() == 0 or held(table) == {"a": [9], "b": [7], "c/d e=f": [4]}


def test_two_writers_of_a_batch(spark, tmp_path):
    table = BatchTable(spark, f"{tmp_path}/t", "b string, x long", key="b")
    table.replace(batch_rows(spark, a=[1], b=[2]))
    one, two, other = table.write(batch_rows(spark, a=[10])), table.write(batch_rows(spark, a=[20], b=[20])), table.write(batch_rows(spark, c=[30]))
    assert table.commit(one) == 2
    with pytest.raises(Refused, match="'a'"):
        table.commit(two)
    assert table.commit(other) == 3  # another batch is no one's business
    assert held(table) == {"a": [10], "b": [2], "c": [30]}
    assert table.vacuum() == 1 and held(table) == {"a": [10], "b": [2], "c": [30]}


def test_failed_writes_and_batches_in_work(spark, tmp_path):
    table = BatchTable(spark, f"{tmp_path}/t", "b string, x long", key="b", most=3)
    table.replace(batch_rows(spark, a=[1]))
    with pytest.raises(Exception):
        table.replace(batch_rows(spark, a=[5]).withColumn("x", F.raise_error("no grade").cast("long")))
    busy = spark.createDataFrame([("a",)], "batch string")
    with pytest.raises(Refused, match="in work"):
        table.replace(batch_rows(spark, a=[6], b=[6]), in_work=busy)
    with pytest.raises(ValueError, match="without a b"):
        table.replace(batch_rows(spark, a=[6]).withColumn("b", F.lit(None).cast("string")))
    with pytest.raises(ValueError, match="3 at most"):
        table.replace(batch_rows(spark, **{f"k{k}": [k] for k in range(4)}))
    assert held(table) == {"a": [1]} and table.head() == 1


def test_racing_commits_all_land(spark, tmp_path):
    table = BatchTable(spark, f"{tmp_path}/t", "b string, x long", key="b")
    written = [table.write(batch_rows(spark, **{f"k{k}": [k]})) for k in range(6)]
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(table.commit, written))
    assert sorted(numbers) == list(range(1, 7)) and held(table) == {f"k{k}": [k] for k in range(6)}


def test_overwrite_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    first = rows(spark, 0)
    overwrite_batches(first, path)
    overwrite_batches(first.where("batch_id = 1"), path)
    assert spark.read.parquet(path).count() == 40
    reprocess(first.where("event_id < 10"), spark.createDataFrame([(0, "DONE"), (1, "PROCESSING")], "id long, status string"), path)
    left = {r.batch_id: r["count"] for r in spark.read.parquet(path).groupBy("batch_id").count().collect()}
    assert left[0] == 4 and left[1] == 13 and left[2] == 13
