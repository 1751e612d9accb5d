"""Tables laid out for joins on a key, and reports as CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import shared_path


def bucketed(df: DataFrame, key: str, buckets: int = 64, partition: str | None = None, name: str | None = None) -> DataFrame:
    """Df as a table of `buckets` sorted by `key`, in folders by `partition` (a run or batch), read back from there.

    Tables of equal buckets are joined and grouped by the key without a shuffle. A bucket's rows come together in one task before they are written,
    so that each folder holds one file a bucket; keys such as result ids spread evenly.
    """
    spark = df.sparkSession
    name = name or f"lumengrade_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", shared_path(spark, name))
    (writer.partitionBy(partition) if partition else writer).saveAsTable(name)
    return spark.table(name)


# Characters that a CSV cell is quoted and escaped with.
CSV = {"header": True, "quote": '"', "escape": '"', "lineSep": "\n", "timestampFormat": "yyyy-MM-dd HH:mm:ss"}


def write_report(df: DataFrame, path: str) -> None:
    """Df as CSV files with a header each; lists are joined by '; ', nulls are empty cells and empty texts quoted ones."""
    flat = [F.array_join(F.col(f"`{f.name}`").cast("array<string>"), "; ").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*flat).write.options(**CSV, emptyValue='""', nullValue="", quoteAll=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A report as write_report() leaves it; cells may hold line breaks and quotes."""
    return spark.read.schema(schema).options(**CSV, multiLine=True, emptyValue="", nullValue="\u0000", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
