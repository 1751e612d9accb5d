"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

1. Usable vectors (finite, not zero) are normalised in double precision; equal rows form one class, with a number of its own,
   that is hashed once and weighs as often as it occurs.
2. Each table quantises random Gaussian projections at a random offset and width; classes of equal cells share a bucket. A row
   of a table holds the cell, the class and a sketch of two longs, the signs of 128 further projections. Rows are dealt by range and
   read as sorted runs, so a bucket is worked on where it lies, without a join; members whose sketch is more than `SPREAD` standard errors
   past the angle at the threshold from all others of their bucket drop out.
3. Buckets that a partition's edge may cut or that have over `most` members go a longer way: they are cut into tiles, and each pair of
   tiles is a bounded group, in which a pair also has to meet in the first table whose cells it shares.
4. What is left gets its vectors. Cosines are checked exactly, a pair counts only in the first table whose cells it shares, and
   a group puts out link counts and a spanning forest, both bounded by its members.

The number of projections grows with the logarithm of the number of classes, so that buckets of unlike vectors grow with less than
its third root, and the number of tables is what a pair exactly at the threshold then needs to share one but for a share `MISS`; pairs
above it are found more surely (at cosine 0.92 a sixth of that share is missed, at 0.95 a thousandth).

Defined results: null, zero or non-finite vectors (or vectors with null components) link with nothing; equal vectors link
whatever the hashing; rows that repeat a vec_id count as vectors of their own, whether equal or not; rows without a vec_id link and are
kept; vectors of different lengths are never linked; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import components, forget, stored, table, whole_groups

WIDTH, TILE, MOST = 2.25, 1024, 1 << 15
MISS = 1e-3  # share of links exactly at the threshold that no table may find
BITS, SPREAD = 128, 4.5  # of a sketch


def agreement(cosine: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection of two unit vectors of this cosine agrees."""
    c = math.sqrt(max(2 - 2 * cosine, 1e-12))
    t = width / c
    tail = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def sizing(classes: int, threshold: float, width: float = WIDTH, miss: float = MISS) -> tuple[int, int]:
    """(projections, tables) for so many classes: a bucket gets up to 32 * classes ** 0.28 vectors at right angles to each other."""
    spread = max(1.0, max(2, classes) ** 0.72 / 32)
    projections = max(4, math.ceil(math.log(spread) / -math.log(agreement(0.0, width))))
    return projections, math.ceil(math.log(miss) / math.log(1 - agreement(threshold, width) ** projections))


def sketch_limit(threshold: float, bits: int = BITS) -> int:
    """Differing sketch bits up to which two vectors might reach the threshold."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.ceil(bits * p + SPREAD * math.sqrt(bits * p * (1 - p)))


@lru_cache(maxsize=8)
def _signs(dim: int, bits: int = BITS, seed: int = 12) -> np.ndarray:
    return np.random.default_rng(seed + dim).standard_normal((dim, bits))


@lru_cache(maxsize=8)
def _planes(dim: int, tables: int, projections: int, width: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed + dim)
    return rng.standard_normal((dim, tables * projections)), rng.uniform(0, width, tables * projections)


def cells(unit: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """64-bit cell code of each row in each table; the last ten bits are the table."""
    planes, offset = _planes(unit.shape[1], tables, projections, width)
    grid = np.floor((unit @ planes + offset) / width).astype(np.int64).reshape(len(unit), tables, projections)
    code = np.arange(tables, dtype=np.uint64)[None, :] + np.uint64(unit.shape[1] << 20)
    for k in range(projections):
        code = (code ^ grid[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(31)
    return (code & ~np.uint64(1023) | np.arange(tables, dtype=np.uint64)).astype(np.int64)


def unit_vector(row: list | None) -> np.ndarray | None:
    """The row at length 1 in double precision, or None where it is unusable."""
    if not row or any(x is None for x in row):
        return None
    v = np.array(row, np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def units(vectors: DataFrame) -> DataFrame:
    """(vec_id, vkey, unit): vkey names equal unit vectors; both null where the vector is unusable."""
    schema = pa.schema([("vec_id", pa.int64()), ("vkey", pa.binary()), ("unit", pa.binary())])

    def run(batches):
        for part in batches:
            raw = [u.tobytes() if u is not None else None for u in map(unit_vector, part.column("embedding").to_pylist())]
            keys = [xxhash.xxh3_128_digest(b) if b else None for b in raw]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], schema=schema)

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, vkey binary, unit binary")


def _by_length(units: pa.Array):
    """(places, matrix) of the unit vectors of each length."""
    rows = [np.frombuffer(x.as_buffer(), np.float64) for x in units]
    for dim in {len(r) for r in rows}:
        at = np.array([k for k, r in enumerate(rows) if len(r) == dim])
        yield at, np.stack([rows[k] for k in at])


def hashed(classes: DataFrame, tables: int, projections: int, width: float) -> DataFrame:
    """(cell, cid, s1, s2) of classes(cid, unit) in each table."""
    fields = [("cell", pa.int64()), ("cid", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                part = whole.slice(start, 500)
                cid = part.column("cid").to_numpy()
                for at, unit in _by_length(part.column("unit")):
                    signs = np.packbits(unit @ _signs(unit.shape[1]) > 0, axis=1).view(np.int64)
                    cols = [cells(unit, tables, projections, width).ravel(), *(np.repeat(x, tables) for x in (cid[at], signs[:, 0], signs[:, 1]))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=pa.schema(fields))

    return classes.select("cid", "unit").mapInArrow(run, "cell long, cid long, s1 long, s2 long")


def _apart(a: tuple, b: tuple) -> np.ndarray:
    """Differing sketch bits of all pairs of a and b, each (s1, s2), unsigned."""
    return np.bitwise_count(a[0][:, None] ^ b[0]) + np.bitwise_count(a[1][:, None] ^ b[1])


def _near_members(cell: np.ndarray, s1: np.ndarray, s2: np.ndarray, limit: int) -> np.ndarray:
    """Whether each row of sorted cells has another row of its cell within `limit` sketch bits."""
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[start, len(cell)])
    near, small = np.zeros(len(cell), bool), np.repeat(size <= 16, size)
    for step in range(1, int(size[size <= 16].max(initial=0))):
        i = np.flatnonzero((cell[:-step] == cell[step:]) & small[:-step])
        i = i[np.bitwise_count(s1[i] ^ s1[i + step]) + np.bitwise_count(s2[i] ^ s2[i + step]) <= limit]
        near[i] = near[i + step] = True
    for g in np.flatnonzero(size > 16):
        own = slice(start[g], start[g] + size[g])
        step = max(16, (1 << 20) // int(size[g]))
        for k in range(0, size[g], step):
            some = slice(start[g] + k, min(start[g] + k + step, start[g] + size[g]))
            near[some] |= (_apart((s1[some], s2[some]), (s1[own], s2[own])) <= limit).sum(1) > 1  # each is near itself
    return near


def bucket_members(rows: DataFrame, limit: int, most: int = MOST) -> DataFrame:
    """(cell, cid, late) of rows(cell, cid, s1, s2) sorted by cell: members with a near one in their bucket, and, `late`, all members of
    buckets that may go on in another partition or have over `most` members."""

    def shown(t, keep, late):
        return pa.RecordBatch.from_arrays([*(t.column(c).filter(pa.array(keep)) for c in ("cell", "cid")), pa.array(late[keep])], names=["cell", "cid", "late"])

    def run(batches):
        held = first = over = None
        for t in batches:
            if not t.num_rows:
                continue
            t = pa.concat_batches([held, t]) if held is not None and held.num_rows else t
            cell = t.column("cell").to_numpy()
            first = cell[0] if first is None else first
            cut = int(np.searchsorted(cell, cell[-1]))
            body, held = t.slice(0, cut), t.slice(cut)
            if cut:
                own = cell[:cut]
                start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                size = np.diff(np.r_[start, cut])
                late = np.repeat((own[start] == first) | (own[start] == over) | (size > most), size)
                keep = late.copy()
                keep[~late] = _near_members(own[~late], *(body.column(c).to_numpy()[~late].view(np.uint64) for c in ("s1", "s2")), limit)
                yield shown(body, keep, late)
            if cell[-1] in (first, over) or held.num_rows > most:
                over = cell[-1]
                every = np.ones(held.num_rows, bool)
                yield shown(held, every, every)
                held = None
        if held is not None:
            every = np.ones(held.num_rows, bool)
            yield shown(held, every, every)

    return rows.repartitionByRange("cell", "cid").sortWithinPartitions("cell", "cid").mapInArrow(run, "cell long, cid long, late boolean")


UNIT = ["cell", "lo", "hi"]
MEMBER = "cell long, lo int, hi int, cid long, side int"


def tiled(late: DataFrame) -> DataFrame:
    """MEMBER rows of late(cell, cid): tile lo (side 0) against tile hi (side 1) of one bucket, or a tile (side 0) within itself."""
    sizes = late.groupBy("cell").agg(F.count("*").alias("k")).where("k > 1")
    faced = late.join(stored(sizes.select("cell", F.ceil(F.col("k") / TILE).cast("int").alias("tiles")), "sizes"), "cell")
    faced = faced.withColumn("tile", F.pmod(F.xxhash64("cid", "cell"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return faced.select("cell", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "cid", (F.col("tile") > F.col("other")).cast("int").alias("side"))


def _units(t: pa.RecordBatch):
    """(rows of side 0, rows of side 1) of each unit of sorted MEMBER rows; a tile within itself has the same rows twice."""
    ids = np.stack([t.column(n).to_numpy() for n in UNIT])
    start = np.flatnonzero(np.r_[True, (ids[:, 1:] != ids[:, :-1]).any(0)])
    side = t.column("side").to_numpy()
    for a, z in zip(start.tolist(), [*start[1:].tolist(), t.num_rows], strict=True):
        split = a + int((side[a:z] == 0).sum())
        yield (slice(a, z), slice(a, z)) if ids[1, a] == ids[2, a] else (slice(a, split), slice(split, z))


def _first_here(p: np.ndarray, q: np.ndarray, marks: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether the first table in which rows p and q share a cell is that of their bucket."""
    out = np.empty(len(p), bool)
    for k in range(0, len(p), 20_000):
        s = slice(k, k + 20_000)
        out[s] = (marks[p[s]] == marks[q[s]]).argmax(1) == (cell[p[s]] & 1023)
    return out


def _pairs(t: pa.RecordBatch, hits):
    """(p, q) of all units: hits(rows x, rows y) gives a boolean matrix."""
    for x, y in _units(t):
        step = max(1, (1 << 20) // max(1, y.stop - y.start))
        for k in range(x.start, x.stop, step):
            part = slice(k, min(k + step, x.stop))
            p, q = np.nonzero(hits(part, y))
            p, q = p + part.start, q + y.start
            yield (p[p < q], q[p < q]) if x == y else (p, q)


def late_members(late: DataFrame, classes: DataFrame, tables: int, projections: int, width: float, limit: int) -> DataFrame:
    """MEMBER rows of late(cell, cid) that have a near sketch in their unit, this being the first table the two share."""
    names = [x.split()[0] for x in MEMBER.split(", ")]

    def marked(batches):
        for part in batches:
            marks: list = [None] * part.num_rows
            for at, unit in _by_length(part.column("unit")):
                signs = np.packbits(unit @ _signs(unit.shape[1]) > 0, axis=1).view(np.int64)
                for k, row in zip(at.tolist(), np.concatenate([signs, cells(unit, tables, projections, width)], 1), strict=True):
                    marks[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array(marks, pa.binary())], names=["cid", "marks"])

    def run(batches):
        for t in whole_groups(batches, UNIT):
            all_marks = np.frombuffer(b"".join(t.column("marks").to_pylist()), np.int64).reshape(t.num_rows, -1)
            s1, s2 = (all_marks[:, k].astype(np.uint64) for k in (0, 1))
            marks, cell = all_marks[:, 2:], t.column("cell").to_numpy()
            keep = np.zeros(t.num_rows, bool)
            for p, q in _pairs(t, lambda x, y, s1=s1, s2=s2: _apart((s1[x], s2[x]), (s1[y], s2[y])) <= limit):
                first = _first_here(p, q, marks, cell)
                keep[p[first]] = keep[q[first]] = True
            if keep.any():
                yield t.select(names).filter(pa.array(keep))

    wanted = classes.join(late.select("cid").distinct(), "cid", "left_semi").select("cid", "unit").mapInArrow(marked, "cid long, marks binary")
    return tiled(late).join(wanted, "cid").repartition(*UNIT).sortWithinPartitions(*UNIT, "side", "cid").mapInArrow(run, MEMBER)


class _Forest:
    """Components of rows, joined block by block: label[k] is the smallest row that links lead to from row k."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        while True:
            a, b = self.label[p], self.label[q]
            apart = a != b
            if not apart.any():
                return
            p, q, a, b = p[apart], q[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label != (shorter := self.label[self.label])).any():
                self.label = shorter


def _blocks(t: pa.RecordBatch, marks: np.ndarray, cell: np.ndarray, cells_at_once: int = 1 << 18):
    """Pairs of row sets that have to be compared, each of at most about `cells_at_once` pairs; within a set a row is compared with later ones.

    Members that share a cell of an earlier table have met there: the largest such set of a unit isn't compared with itself again.
    """
    for x, y in _units(t):
        if x != y:
            sets = [(np.arange(x.start, x.stop), np.arange(y.start, y.stop), False)]
        else:
            rows, k = np.arange(x.start, x.stop), int(cell[x.start] & 1023)
            met = np.zeros(len(rows), bool)
            for j in range(k):
                values, at, count = np.unique(marks[rows, j], return_inverse=True, return_counts=True)
                if count.max() > met.sum():
                    met = at == count.argmax()
            rest, met = rows[~met], rows[met]
            sets = [(rest, rest, True), (met, rest, False)] if len(met) > 1 else [(rows, rows, True)]
        for a, b, within in sets:
            if not len(a) or not len(b):
                continue
            step = max(1, cells_at_once // len(b))
            for i in range(0, len(a), step):
                some = a[i : i + step]
                yield some, b[i:] if within else b, within


def unit_links(t: pa.RecordBatch, tables: int, projections: int, width: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links gained, smallest row linked to) of each row of whole units; memory goes with the rows, not with the pairs."""
    n, cell = (t.column(c).to_numpy() for c in ("n", "cell"))
    raw = t.column("unit")
    dims = np.array([len(x.as_buffer()) // 8 for x in raw])
    unit, marks = np.zeros((t.num_rows, int(dims.max()))), np.empty((t.num_rows, tables), np.int64)
    for at, rows in _by_length(raw):
        unit[at, : rows.shape[1]], marks[at] = rows, cells(rows, tables, projections, width)
    gain, forest = np.zeros(t.num_rows), _Forest(t.num_rows)
    for x, y, within in _blocks(t, marks, cell):
        p, q = np.nonzero(unit[x] @ unit[y].T >= threshold)
        p, q = x[p], y[q]
        keep = (dims[p] == dims[q]) & ((p < q) if within else True)
        p, q = p[keep], q[keep]
        first = _first_here(p, q, marks, cell)
        p, q = p[first], q[first]
        if len(p):
            np.add.at(gain, p, n[q])
            np.add.at(gain, q, n[p])
            forest.join(p, q)
    return gain, forest.label


def links(members: DataFrame, classes: DataFrame, tables: int, projections: int, width: float, threshold: float) -> DataFrame:
    """(a, b, links): where b is null, links that class a gains in a unit; else an edge of the unit's forest."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(batches):
        for t in whole_groups(batches, UNIT):
            cid = t.column("cid").to_numpy()
            gain, label = unit_links(t, tables, projections, width, threshold)
            on, low = np.flatnonzero(gain), np.flatnonzero(label != np.arange(t.num_rows))
            b = pa.array(np.r_[np.zeros(len(on), np.int64), cid[label[low]]], mask=np.arange(len(on) + len(low)) < len(on))
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[cid[on], cid[low]]), b, pa.array(np.r_[gain[on].astype(np.int64), np.zeros(len(low), np.int64)])], schema=schema)

    full = members.join(classes, "cid").repartition(*UNIT).sortWithinPartitions(*UNIT, "side", "cid")
    return full.mapInArrow(run, "a long, b long, links long")


def near_vectors(vectors: DataFrame, threshold: float = 0.9, width: float = WIDTH, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors(vec_id, embedding)."""
    base = stored(units(vectors), "units")
    equal = base.where("vkey is not null").groupBy("vkey").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("unit").alias("unit"))
    equal = stored(equal.withColumn("cid", F.monotonically_increasing_id()), "equal")
    projections, tables = sizing(equal.count(), threshold, width, miss)
    classes = equal.select("cid", "n", "unit")
    met = stored(bucket_members(hashed(classes, tables, projections, width), sketch_limit(threshold)), "met")
    none = F.lit(0).cast("int")
    settled = met.where("not late").select("cell", none.alias("lo"), none.alias("hi"), "cid", none.alias("side"))
    late = late_members(met.where("late").select("cell", "cid"), classes, tables, projections, width, sketch_limit(threshold))
    members = stored(settled.unionByName(late), "members")
    forget(met)
    found = stored(links(members, classes, tables, projections, width, threshold), "found")
    forget(members)
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("more"))
    label = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "cid")
    per = equal.select("vkey", "rep", "n", "cid").join(counts, "cid", "left").join(label, "cid", "left")
    per = stored(per.select("vkey", "rep", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component_id", "cid").alias("part")), "per")
    forget(found, equal)
    least = stored(per.groupBy("part").agg(F.min("rep").alias("component_id")), "least")
    per = per.join(least, "part").select("vkey", "n_links", "component_id")
    got = base.where("vkey is not null").select("vec_id", "vkey").join(per, "vkey").select("vec_id", "n_links", "component_id")
    none = base.where("vkey is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return got.unionByName(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND list_dot_product(e, e) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM link GROUP BY x)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, least.component_id, v.vec_id = least.component_id AS kept
FROM v JOIN least ON least.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""
