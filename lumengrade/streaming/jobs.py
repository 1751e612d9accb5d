"""Incremental forms of the batch operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..sources.batch_table import BatchTable, folder_of


def touched(new: DataFrame, key: str, most: int) -> list:
    """The keys that a micro-batch holds, no more than `most`: they name the folders to be read again."""
    found = [r[0] for r in new.select(key).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"a micro-batch touches more than {most} values of {key}; take fewer files at a time")
    return found


def page_tasks(pages: DataFrame, texts: DataFrame, on: str = "page_id", delay: str = "1 hour", wait: str = "1 hour") -> DataFrame:
    """T1, inputs: the pages stream (on, page_ts, ...) with the texts stream (on, text_ts, ...) that belongs to it, in either order of arrival.

    A text counts if its time is at most `wait` away from its page's. Pages without one come out alone, once the watermark (the
    slower input's latest time less `delay`) has passed the last text that could have been theirs; what the join still waits for is all the state there is.
    """
    left, right = pages.withWatermark("page_ts", delay), texts.withWatermark("text_ts", delay).withColumnRenamed(on, "_on")
    near = F.expr(f"_on = `{on}` AND text_ts >= page_ts - INTERVAL {wait} AND text_ts <= page_ts + INTERVAL {wait}")
    return left.join(right, near, "left_outer").drop("_on")


def grade_stream(tasks: DataFrame, inbox: str, table: BatchTable, checkpoint: str, grade: Callable[[DataFrame], DataFrame]) -> DataStreamWriter:
    """A stream of page tasks to the graded batches of `table`; start() it with a trigger.

    Each micro-batch is put into `inbox` under its batches and its own number; then the folders of the batches it touches, and only those, are
    read again, graded and committed. A batch may arrive over any number of micro-batches, and one that is run again after a failure
    puts the same rows in the same place and commits the same grades.
    """
    key, stored = table.key, T.StructType([*tasks.schema, T.StructField("arrival", T.LongType())])

    def write(new: DataFrame, number: int) -> None:
        new.persist()  # its keys and its rows; the inbox is what lasts
        try:
            names = touched(new, key, table.most)
            if not names:
                return
            put = new.withColumn("arrival", F.lit(number)).hint("rebalance", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            put.partitionBy(key, "arrival").parquet(inbox)
        finally:
            new.unpersist()
        folders = [f"{inbox}/{folder_of(key, name)}" for name in names]
        whole = new.sparkSession.read.schema(stored).option("basePath", inbox).parquet(*folders).where(F.col("arrival") <= number)
        table.replace(grade(whole.drop("arrival")), replaced=names)

    return tasks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def dedupe_stream(tasks: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first arrival of each key; a repeat within `delay` of it drops out. Rows behind the watermark drop out as late, and a key's state goes once
    the watermark has passed its time by `delay`; then the key counts as new. T1 settles which page counts."""
    return tasks.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def latest_decisions(events: DataFrame) -> DataFrame:
    """The last decision per (result, question) by (ts, event_id); batch or stream in update mode."""
    last = F.max_by(F.struct("action", "final_score", "ts", "event_id"), F.struct("ts", "event_id"))
    return events.groupBy("student_result_id", "question_number").agg(last.alias("d")).select("student_result_id", "question_number", "d.*")


def merge_stream(changes: DataFrame, table: BatchTable, keys: list[str], order: list[str], checkpoint: str) -> DataStreamWriter:
    """T3, T4, sink: an update-mode stream of rows by `keys` into a table with one row for each key; start() it with a trigger.

    The table's own key is a hash bucket of `keys`. A micro-batch reads the buckets it touches, keeps of each key's old and new rows
    the last by `order`, and commits those buckets; the order decides, not the arrival, so a micro-batch that is run again changes nothing.
    """
    bucket = bucket_of(keys, table)
    names = [f.name for f in table.schema]

    def write(new: DataFrame, _: int) -> None:
        placed = new.withColumn(table.key, bucket).select(*names).persist()
        try:
            buckets = touched(placed, table.key, table.most)
            if buckets:
                both = placed.unionByName(table.read(buckets))
                place = F.row_number().over(Window.partitionBy(table.key, *keys).orderBy(*[F.col(c).desc() for c in order]))
                table.replace(both.withColumn("_place", place).where("_place = 1").drop("_place"))
        finally:
            placed.unpersist()

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def bucket_of(keys: list[str], table: BatchTable):
    """Number of the bucket that a merged table keeps a key in; no more buckets than a commit may name."""
    return F.pmod(F.xxhash64(*keys), F.lit(min(256, table.most))).cast(table.schema[table.key].dataType)


def progress_stream(results: DataFrame, batches: DataFrame) -> DataFrame:
    """T4: pages and results done of each batch and the percent of its pages, as results arrive (A18 as they stand); batch or stream in update mode.

    The batches are a static table, joined to each micro-batch's changed counts. The pages of a batch are those of one upload.
    """
    done = F.col("status") != "PENDING"
    per = results.groupBy("batch_id").agg(F.collect_set(F.when(done, F.col("page_number"))).alias("p"), F.count_if(done).alias("results_done"))
    known = batches.select(F.col("id").alias("batch_id"), "total_pages")
    pages = F.size("p").cast("long")
    share = F.when(F.col("total_pages") > 0, F.round(F.least(F.lit(100.0), 100.0 * pages / F.col("total_pages")), 2)).otherwise(0.0)
    return per.join(known, "batch_id").select("batch_id", pages.alias("pages_done"), "results_done", share.alias("percent"))
