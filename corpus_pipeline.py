"""The corpus pipeline: toxicity, language, near-duplicates, mix, encoding. Counted as part of the llm subpackage.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and, but for the last, returns the columns of
documents; run() writes each result as Parquet to the shared folder and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengrade.llm import language_id, minhash_dedup, sentencepiece_codec, source_mix, toxicity
from lumengrade.llm._common import stored, table

#: Not expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), with_spans=False)
    return scored.where(F.col(toxicity.free("_score", docs.columns)) < 0.5).select(*docs.columns)


def drop_foreign(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language, or in none with posterior 0.5, go. They are named by a 64-bit number of text and source, on which
    the judgement rests, so that rows which share an id, or have none, are judged one by one."""
    key = F.xxhash64(F.col("text").cast("string"), F.lit("source"), F.col("source").cast("string"))
    judged = language_id.document_evidence(docs.select(key.alias("doc_id"), "text", "source"))
    found = language_id.identify(judged, docs)
    gone = stored(found.where("not kept").select(F.col("row_id").alias("key")).distinct(), "foreign")
    named = docs.select(F.struct("*").alias("row"), key.alias("key"))
    return named.join(gone, "key", "left_anti").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8) stays: a row of its smallest id. Texts are named by a 64-bit
    number, so that rows which share an id are judged by their own text. Rows without an id stay, and so do those without a word.

    The texts are shuffled once by text and id, at any size; only equal pairs of both are compared with each other.
    """
    text = F.col("text").cast("string")
    named = docs.where("doc_id is not null").select(F.struct("*").alias("row"), F.xxhash64(text).alias("key"), F.col("doc_id").cast("long").alias("id"))
    found = minhash_dedup.near_duplicates(named.select(F.col("key").alias("doc_id"), F.col("row.text").cast("string").alias("text")), shingle=5, threshold=0.8)
    group = found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("part"))
    first = named.groupBy("key", "id").agg(F.count("*").alias("rows")).groupBy("key").agg(F.min(F.struct("id", "rows")).alias("first"))
    one = stored(group.join(first, "key"), "group").groupBy("part").agg(F.min(F.struct("first.id", "key", "first.rows")).alias("one"))
    kept = stored(one.select("one.*"), "kept")
    once = named.join(kept.hint("merge"), ["key", "id"])
    again = once.where("rows > 1").dropDuplicates(["key", "id"])
    bare = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]") | F.col("doc_id").isNull()
    return once.where("rows = 1").select("row.*").unionByName(again.select("row.*")).unionByName(docs.where(bare))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix takes them."""
    return source_mix.take(docs, stored(source_mix.mix_units(docs), "mixed"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of each row."""
    got = sentencepiece_codec.sentencepiece_codec(docs)
    return got.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_foreign),
    ("minhash_dedup", drop_copies),
    ("source_mix", mix_sources),
    ("sentencepiece_codec", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
