"""Exam documents, as ordered text lines, to questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import decimal_or, decimal_or_null, strip

# Field of each key once lower-cased and rid of í, ç, ã, õ.
FIELDS = {
    "titulo da prova": "titulo", "titulo": "titulo", "disciplina": "disciplina", "curso": "curso", "turma": "turma",
    "enunciado": "question_text", "pergunta": "question_text",
    "resposta esperada": "expected_answer", "gabarito": "expected_answer", "padrao de resposta": "expected_answer",
    "criterios": "correction_criteria", "criterios de correcao": "correction_criteria", "critérios": "correction_criteria", "rubrica": "correction_criteria",
    "valor": "max_score", "pontuacao": "max_score",
}
PREFIXES = {"instrucoes": "instrucoes", "valor padrao": "valor_padrao", "valor geral": "valor_padrao"}
QUESTION_FIELDS = ("question_text", "expected_answer", "correction_criteria", "max_score")
META_FIELDS = ("titulo", "disciplina", "curso", "turma", "instrucoes", "valor_padrao")
HEADING = r"(?i)^(quest[aã]o|q)\s*(\d+)\b"


def field_of(key: Column) -> Column:
    """field named by a key, null where it names none."""
    k = F.translate(F.lower(strip(key)), "íçãõ", "icao")
    out = F.lit(None).cast("string")
    for prefix, field in PREFIXES.items():
        out = F.when(F.startswith(k, F.lit(prefix)), field).otherwise(out)
    for name, field in FIELDS.items():
        out = F.when(k == name, field).otherwise(out)
    return out


def tagged_lines(lines: DataFrame) -> DataFrame:
    """lines(doc_id, line_no, text) with question number, field and value, both filled forward."""
    text = strip(F.coalesce("text", F.lit("")))
    rows = lines.select("doc_id", "line_no", text.alias("t")).where("t <> ''")
    head = F.nullif(F.regexp_extract("t", HEADING, 2), F.lit("")).try_cast("int")
    parts = F.split("t", ":", 2)
    field = F.when((F.size(parts) == 2) & head.isNull(), field_of(F.get(parts, F.lit(0))))
    so_far = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"head": head, "field0": field})
    rows = rows.withColumn("question_number", F.last("head", ignorenulls=True).over(so_far))
    # A field ends at the next heading; a metadata field counts before the first heading only, a question field after it.
    in_place = F.when(F.col("question_number").isNull(), F.col("field0").isin(*META_FIELDS)).otherwise(F.col("field0").isin(*QUESTION_FIELDS))
    rows = rows.withColumn("field0", F.when(in_place, F.col("field0"))).withColumn("mark", F.when(F.col("head").isNotNull(), F.lit("")).otherwise(F.col("field0")))
    rows = rows.withColumn("field", F.nullif(F.last("mark", ignorenulls=True).over(so_far), F.lit("")))
    value = F.when(F.col("field0").isNotNull(), strip(F.get(F.split("t", ":", 2), F.lit(1)))).otherwise(F.col("t"))
    return rows.where("head is null and field is not null").select("doc_id", "line_no", "question_number", "field", value.alias("value"), F.col("field0").isNotNull().alias("opens"))


def _joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last opening of a field counts, with its continuation lines."""
    last = Window.partitionBy(*keys, "field")
    rows = rows.withColumn("_from", F.max(F.when(F.col("opens"), F.col("line_no"))).over(last)).where("line_no >= _from")
    value = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]), "\n")
    return rows.groupBy(*keys, "field").agg(strip(value).alias("value"))


def questions_from_lines(lines: DataFrame, default_score: float = 1.0) -> DataFrame:
    """One row per question heading with its fields, warnings for empty prompt or answer, and the document's title.

    A heading twice in a document is one question. The score defaults to the document's standing score before the heading.
    """
    rows = tagged_lines(lines)
    keys = ["doc_id", "question_number"]
    heads = lines.select("doc_id", F.nullif(F.regexp_extract(strip("text"), HEADING, 2), F.lit("")).try_cast("int").alias("question_number")).where("question_number is not null").distinct()
    fields = _joined(rows.where("question_number is not null"), keys).groupBy(*keys).pivot("field", list(QUESTION_FIELDS)).agg(F.first("value"))
    meta = _joined(rows.where("question_number is null").withColumn("question_number", F.lit(0)), ["doc_id"]).groupBy("doc_id").pivot("field", list(META_FIELDS)).agg(F.first("value"))
    joined = heads.join(fields, keys, "left").join(meta.select("doc_id", "titulo", "valor_padrao"), "doc_id", "left")
    standing = decimal_or(F.coalesce("valor_padrao", F.lit("")), default_score)
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    notes = F.array_compact(F.array(F.when(empty("question_text"), "empty prompt"), F.when(empty("expected_answer"), "empty answer")))
    return joined.select(
        *keys, F.col("titulo").alias("title"), F.coalesce("question_text", F.lit("")).alias("question_text"), F.coalesce("expected_answer", F.lit("")).alias("expected_answer"),
        F.coalesce("correction_criteria", F.lit("")).alias("correction_criteria"), F.coalesce(decimal_or_null(F.col("max_score")), standing).alias("max_score"), F.array_join(notes, "; ").alias("warnings"),
    )
