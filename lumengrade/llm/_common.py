"""Helpers shared by the corpus operators: word rule, shared-folder tables, Arrow slicing, link components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session (one machine) gets a temporary
    one; anywhere else that folder would not be shared, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[[^,]*(,\s*\d+)?\])?$", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lumengrade-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written once as Parquet into the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumengrade/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Remove stored() tables that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stored_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, rows: int, each: int = 20_000) -> DataFrame:
    """df in no more partitions than its rows (at most `rows`) and the cluster's cores call for, whatever the session's number of shuffle
    partitions: steps over a few rows then don't pay for hundreds of empty tasks and files. Nothing is shuffled."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by `keys` again, recut so that no group of equal keys (all longs) is spread over two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        ids = np.stack([batch.column(k).to_numpy() for k in keys])
        last = np.flatnonzero((ids != ids[:, -1:]).any(0))
        cut = int(last[-1]) + 1 if len(last) else 0  # where the last group starts
        if cut == 0 and len(held) > 1:
            tail = held[-2]
            if all(tail.column(k)[tail.num_rows - 1].as_py() == batch.column(k)[0].as_py() for k in keys):
                continue
        done = [*held[:-1], batch.slice(0, cut)] if cut else held[:-1]
        held = [batch.slice(cut)]
        if done:
            yield pa.concat_batches(done)
    if held:
        yield pa.concat_batches(held)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds about `limit` bytes of `column` (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if n:
            each = max(1, int(n * limit / max(limit, batch.column(column).nbytes)))
            for start in range(0, n, each):
                yield batch.slice(start, each)


def components(edges: DataFrame, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected `edges(a, b)`, a stored table, as (id, component_id), component_id the smallest id.

    Alternating large-star (neighbours above a node move to its smallest neighbour) and small-star (a node and its neighbours below
    it move to the smallest) until all components are stars. No component is ever gathered in one task; edges and minima of each round are
    written to the shared folder, as a join of two written tables is one that Spark can split where a node has very many edges.
    """

    def lowered(pairs: DataFrame, least: DataFrame) -> DataFrame:
        return pairs.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")

    def kept(df: DataFrame) -> DataFrame:
        return stored(sized(df, 2 * count, 500_000), tag)

    def stars(e: DataFrame) -> bool:
        ends = e.select(F.col("a").alias("id"), F.col("b").alias("up")).unionByName(e.select(F.col("b").alias("id"), F.lit(None).cast("long").alias("up")))
        per = ends.groupBy("id").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.bool_or(F.col("up").isNull()).alias("root"))
        return per.where("low <> high or (root and low is not null)").isEmpty()

    count = edges.count()
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    for k in range(max_rounds):
        if stars(now):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = kept(lowered(both.where("b > a"), least).distinct())
        forget(least, *[now] * (k > 0))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = kept(down.groupBy("a").agg(F.min("b").alias("m")))
        now = kept(lowered(down, least).unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        forget(large, least)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component_id"))).distinct()
