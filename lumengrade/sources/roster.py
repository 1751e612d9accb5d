"""Roster CSV files to students."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def roster_rows(spark: SparkSession, path: str, class_of_file: str = r"([^/]*)\.csv$") -> DataFrame:
    """(file_id, line_no, f) of CSV files, f the trimmed fields of a row; UTF-8 where valid, else Latin-1; the file name names the class.

    The delimiter is ; where the first line holds one, else a comma. Fields may be quoted and hold line breaks, and there may be any
    number of them. A file is one row (rosters have 5 MB at most); files are spread over the tasks.
    """
    raw = spark.read.format("binaryFile").load(path)

    def run(batches):
        csv.field_size_limit(1 << 26)
        for t in batches:
            for file_id, content in zip(t.column("file_id").to_pylist(), t.column("content").to_pylist(), strict=True):
                try:
                    text = content.decode("utf-8-sig")
                except UnicodeDecodeError:
                    text = content.decode("latin-1")
                semi = ";" in (text.splitlines() or [""])[0]
                rows = [[x.strip() for x in row] for row in csv.reader(io.StringIO(text, newline=""), delimiter=";" if semi else ",")]
                yield pa.RecordBatch.from_arrays([pa.array([file_id] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], names=["file_id", "line_no", "f"])

    named = raw.select(F.regexp_extract("path", class_of_file, 1).alias("file_id"), "content")
    return named.mapInArrow(run, "file_id string, line_no int, f array<string>")


def _last_index(fields: Column, *words: str) -> Column:
    """Place of the last field that holds one of the words."""
    hits = F.transform(fields, lambda x, i: F.when(_any(F.lower(x), words), i))
    return F.array_max(F.filter(hits, lambda x: x.isNotNull()))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def rosters_from_rows(rows: DataFrame) -> DataFrame:
    """rows(file_id, line_no, f) to (file_id, line_no, registration_number, name, curso, turma).

    Rows up to the header, the first row by which both
    registration and name have been seen, are skipped; indexes gather over skipped rows, the last match wins. Rows blank in
    a key column drop out; `turma` is the file's first non-blank one.
    """
    so_far = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    columns = {"reg": ("matrícula", "matricula"), "nam": ("nome",), "cur": ("curso",), "tur": ("turma",)}
    seen = rows.withColumns({f"h_{k}": _last_index(F.col("f"), *w) for k, w in columns.items()})
    seen = seen.withColumns({k: F.last(f"h_{k}", ignorenulls=True).over(so_far) for k in columns})
    ready = F.when(F.col("reg").isNotNull() & F.col("nam").isNotNull(), F.col("line_no"))
    head = seen.groupBy("file_id").agg(F.min(ready).alias("head"), *[F.min_by(k, ready).alias(f"i_{k}") for k in columns])
    body = rows.join(head, "file_id").where("line_no > head")
    at = lambda k: F.nullif(F.get("f", F.col(f"i_{k}")), F.lit(""))
    named = body.select("file_id", "line_no", at("reg").alias("registration_number"), at("nam").alias("name"), at("cur").alias("curso"), at("tur").alias("t"))
    good = named.where("registration_number is not null and name is not null")
    turma = good.groupBy("file_id").agg(F.min_by("t", F.when(F.col("t").isNotNull(), F.col("line_no"))).alias("turma"))
    return good.join(turma, "file_id").select("file_id", "line_no", "registration_number", "name", "curso", "turma")


def read_rosters(spark: SparkSession, path: str, class_of_file: str = r"([^/]*)\.csv$") -> DataFrame:
    return rosters_from_rows(roster_rows(spark, path, class_of_file))
