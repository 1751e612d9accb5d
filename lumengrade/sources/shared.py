"""A folder that the driver and all executors see, for tables that a query writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in spark.checkpoint.dir. Where that is unset, a session on one machine gets a temporary folder; elsewhere it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[[^,]*(,\s*\d+)?\])?$", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lumengrade-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found}/lumengrade/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read back: later plans know its size, and a lost executor costs no more than its tasks."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once_each(rows: DataFrame, inputs: list[str], judge: Callable[[DataFrame], DataFrame], tag: str) -> DataFrame:
    """rows with the columns that judge() adds to the distinct combinations of their `inputs`: it gets and keeps those columns, one row for each combination.

    The combinations and what is made of them are written, so that later plans know their size; rows meet them by 128-bit numbers, and no text is joined.
    """
    parts = [x for c in inputs for x in (F.isnull(c), F.col(c))]
    keys = {"_once1": F.xxhash64(*parts), "_once2": F.xxhash64(F.lit(1), *reversed(parts))}
    made = judge(written(rows.select(*inputs).distinct(), tag))
    made = written(made.withColumns(keys).drop(*inputs), f"{tag}-made")
    return rows.withColumns(keys).join(made, [*keys], "left").drop(*keys)
