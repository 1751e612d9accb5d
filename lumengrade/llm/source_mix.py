"""Mixing sources to target weights by pivotal dependent rounding over a distributed reduction tree.

Each source gets a target number of words; a document of that source then holds target / source size expected copies,
a whole part that it surely gets and a fractional part that is rounded. Rounding is pivotal: two documents of one source
meet, words move from one's fraction to the other's in a random direction until one fraction is 0 or 1, and the
other goes on. Moves keep both expectations and the source's sum of words, so only the last document of a source can
change the sum; large documents meet first, so that one is mostly small. Equal rows (same id, source and text)
are one unit of up to `together` rows: whole extra copies of a unit are certain, and only its fractional rest is rounded. Leaves of the
tree are blocks of units cut by a hash of the whole row (about `block` units, whatever the source or id); the at most one open unit per
(block, source) moves up, `fan` blocks meet in the next level, until one is left per source. It is rounded to the nearer side,
so a source misses its target by at most half of that document.

All random draws are hashes of (seed, level, rows), so reruns agree however the table is cut into files. Defined results: null text has
size 0; documents of size 0 hold no words and are taken 0 times; null source is a source of its own, last in order; null ids and ids
that repeat with other texts are rows of their own; equal rows share their copies evenly, within one; an empty table gives an
empty result; further columns are ignored by the mix and kept by take(), whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import slices, stored, table

WEIGHTS = (3.0, 1.0, 2.0)


ROW = "k1 long, k2 long, doc_id long, source string"


def row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes that name a row by id, source, text and all other columns (maps as JSON): rows of equal keys are equal throughout."""
    named = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")]
    rest = sorted(f.name for f in docs.schema if f.name not in ("doc_id", "source", "text"))
    named += [F.to_json(docs[f"`{c}`"]) if "map<" in dict(docs.dtypes)[c] else docs[f"`{c}`"] for c in rest]
    return [F.xxhash64(*named).alias("k1"), F.xxhash64(F.lit("row"), *named[::-1]).alias("k2")]


def sizes(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, source, size) of every row; size is the number of words, counted in Arrow batches."""
    names = [x.split()[0] for x in ROW.split(", ")]

    def run(batches):
        for part in slices(batches):
            n = [len(t.encode().split()) if t else 0 for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(n, pa.int64())], names=[*names, "size"])

    got = docs.select(*row_keys(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return got.mapInArrow(run, f"{ROW}, size long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) by water-filling: target = min(most * size, weight * level), summing to share * all.

    The windows run over one row per source (already aggregated), not over documents.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    by = by.withColumn("weight", pick).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    by = by.withColumn("total", share * F.sum("source_size").over(Window.partitionBy(F.lit(0))))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    by = by.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("place"), F.col("level"))))  # in this order all before it are full
    by = by.withColumn("place", F.row_number().over(fill)).withColumn("level", first.over(Window.partitionBy(F.lit(0)))["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return by.select("source", "source_size", target.cast("double").alias("target"))


def _draw(seed: int, level: int, key: str) -> float:
    return xxhash.xxh3_64_intdigest(key, seed=seed * 1000 + level) / 2.0**64


def pivotal(ids: np.ndarray, size: np.ndarray, frac: np.ndarray, seed: int, level: int) -> np.ndarray:
    """frac after pairing in the given order; at most one entry is left strictly between 0 and 1."""
    out, hold = frac.copy(), -1
    for i in range(len(out)):
        if not 0 < out[i] < 1:
            continue
        if hold < 0:
            hold = i
            continue
        a, b, p, q = size[hold], size[i], out[hold], out[i]
        up, down = min(a * (1 - p), b * q), min(a * p, b * (1 - q))  # words that hold may gain or lose
        gain = _draw(seed, level, f"{ids[hold]}|{ids[i]}") * (up + down) < down
        if gain:
            out[hold], out[i] = (1.0, q - up / b) if a * (1 - p) <= b * q else (p + up / a, 0.0)
        else:
            out[hold], out[i] = (0.0, q + down / b) if a * p <= b * (1 - q) else (p - down / a, 1.0)
        for k in (hold, i):
            out[k] = 0.0 if out[k] < 1e-12 else 1.0 if out[k] > 1 - 1e-12 else out[k]
        hold = next((k for k in (hold, i) if 0 < out[k] < 1), -1)
    return out


def settle(t: pa.Table, seed: int, level: int) -> pa.Table:
    """The units of one block with their fractions after pairing, source by source, large documents first."""
    frac = t.column("frac").to_numpy().copy()
    size, unit = t.column("size").to_numpy(), t.column("unit").to_numpy()
    source = pc.dictionary_encode(t.column("source").combine_chunks(), null_encoding="encode").indices.to_numpy()
    key = np.array([xxhash.xxh3_64_intdigest(int(u).to_bytes(8, "little", signed=True), seed=seed) for u in unit], np.uint64)
    order = np.lexsort((unit, key, -size, source))
    for at in np.split(order, np.flatnonzero(np.diff(source[order])) + 1):
        frac[at] = pivotal(unit[at], size[at].astype(float), frac[at], seed, level)
    return t.set_column(t.schema.get_field_index("frac"), "frac", pa.array(frac))


def mix_units(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, block: int = 4096, fan: int = 64, together: int = 4096) -> DataFrame:
    """(k1, k2, doc_id, source, size, source_size, target, rows, base, extra): `rows` equal rows of docs, of which `extra` are taken base + 1
    times and the others base times. Equal rows in excess of `together` make several units."""
    sized = stored(sizes(docs), "mix-size")
    targets = source_targets(sized, weights, share, most).withColumnRenamed("source", "s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    same = sized.groupBy("k1", "k2", "doc_id", "source", "size").agg(F.count("*").alias("n"))
    same = same.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / together))))
    same = same.withColumn("rows", F.least(F.lit(together), F.col("n") - F.col("chunk") * together).cast("long")).withColumn("unit", F.xxhash64("k1", "k2", "chunk"))
    rated = same.join(targets, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))
    blocks = max(1, -(-sized.count() // block))
    base = F.floor("rate").cast("long")
    units = rated.withColumn("base", base).withColumn("more", F.col("rows") * (F.col("rate") - F.col("base")))
    rows = units.select(
        "k1", "k2", "doc_id", "source", "size", "source_size", "target", "rows", "base", F.floor("more").cast("long").alias("whole"),
        (F.col("more") - F.floor("more")).alias("frac"), "unit", F.pmod(F.xxhash64("unit", F.lit(seed)), F.lit(blocks)).alias("block"),
    )
    step = lambda at: lambda t: settle(t, seed, at)
    settled, level = None, 0
    while True:
        keys = ["block"] if level == 0 else ["block", "source"]
        done = stored(rows.groupBy(*keys).applyInArrow(step(level), rows.schema), "mix-level")
        is_open = (F.col("frac") > 0) & (F.col("frac") < 1)
        shut = done.where(~is_open)
        settled = shut if settled is None else settled.unionByName(shut)
        rest = done.where(is_open)
        if blocks == 1:  # one open document per source at most
            settled = settled.unionByName(rest.withColumn("frac", F.round("frac")))
            break
        blocks = -(-blocks // fan)
        rows, level = rest.withColumn("block", F.floor(F.col("block") / fan).cast("long")), level + 1
    return settled.select("k1", "k2", "doc_id", "source", "size", "source_size", "target", "rows", "base", (F.col("whole") + F.col("frac").cast("long")).alias("extra"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of docs(doc_id, text, source)."""
    each = mix_units(docs, **options).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + (F.col("row") <= F.col("extra")).cast("long")).alias("copies"))


def take(docs: DataFrame, units: DataFrame) -> DataFrame:
    """docs, with all its columns, each row repeated as often as mix_units(docs), a stored table, takes it.

    The texts are shuffled once by row, at any size: a plan that broadcast the counts of a small table would change its needs as it grows.
    """
    copies = units.groupBy("k1", "k2").agg(F.sum("rows").alias("rows"), F.sum(F.col("rows") * F.col("base") + F.col("extra")).alias("copies"))
    kept = docs.select(F.struct("*").alias("row"), *row_keys(docs)).join(copies.where("copies > 0").hint("merge"), ["k1", "k2"])
    alone = kept.where("rows = 1").select("row", "copies")
    equal = kept.where("rows > 1").dropDuplicates(["k1", "k2"])  # any of them stands for all
    split = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 4096)))
    equal = equal.withColumn("at", split).select("row", F.least(F.lit(4096).cast("long"), F.col("copies") - 4096 * F.col("at")).alias("copies"))
    return alone.unionByName(equal).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
