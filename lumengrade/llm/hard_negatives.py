"""Hard-negative mining: inner products bounded along a spanning tree of the anchors, rescored only where a bound meets a window.

Anchors are cut into blocks of bounded size; each block is one pass over all rows, with the block's vectors and tree sent along. The
tree is a minimum spanning tree of the block by Euclidean distance. Going down the tree, a row's score at an anchor lies within
|edge| * |row| of its score at the parent; only rows whose bound meets what the anchor still looks for are scored exactly (in whole
numbers), the others hand their widened bounds on to the next edge.

1. Positives: an anchor looks for rows of its label that may still enter the best `positives` that the task has seen.
2. Negatives: it looks for rows of other labels within the windows of its positives, above the third best that the task has in each window.

Each task puts out at most positives (times negatives) rows for an anchor of the block; a rank per anchor merges them. No row is
shuffled for scoring, no pair that isn't a result of a task is put out, and what is sent to tasks is bounded by `block` anchors. All pairs are
still bounded, so the work grows with anchors times rows; every row meets every anchor, none is dropped.

Defined results: rows without an id or label, null vectors and vectors with a null or non-finite component take no part, nor do those
with a component beyond 2^27 in magnitude, whose products may not fit a long; rows equal in id, label and vector count once; other rows that
repeat an id stay rows of their own, never partners of that id's anchors; vectors are only compared with those of their length; an anchor
without positives, or a positive without negatives in its window, has no rows; a window below zero is empty; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import stored, table
from .integer_vectors import integer_vectors, matrix

BLOCK = 4096  # anchors sent to all tasks at once: 2 MB of 64 components
KEPT = 8192  # rows bounded at once


class Tree:
    """A minimum spanning tree of a block of vectors, as an order of visits in which each vector follows its parent."""

    def __init__(self, vectors: np.ndarray):
        n = len(vectors)
        real = vectors.astype(np.float64)
        parent, edge = np.full(n, -1), np.zeros(n)
        near, via, out = np.full(n, np.inf), np.zeros(n, np.intp), np.zeros(n, bool)
        at, children = 0, [[] for _ in range(n)]
        for _ in range(n - 1):
            out[at] = True
            gap = real - real[at]
            d = np.einsum("ij,ij->i", gap, gap)
            closer = ~out & (d < near)
            near[closer], via[closer] = d[closer], at
            at = int(np.where(out, np.inf, near).argmin())
            parent[at], edge[at] = via[at], np.sqrt(near[at])
            children[via[at]].append(at)
        size, order, todo = np.ones(n, np.intp), [], [0] if n else []
        while todo:
            order.append(todo.pop())
            todo += children[order[-1]]
        for x in reversed(order[1:]):
            size[parent[x]] += size[x]
        #: (vector, parent or -1, edge, whether the parent has no further child): small subtrees first, so that few bounds wait for their turn.
        self.visits: list[tuple[int, int, float, bool]] = []
        todo = [(0, True)] if n else []
        while todo:
            x, last = todo.pop()
            self.visits.append((x, int(parent[x]), float(edge[x]), last))
            todo += [(c, k == 0) for k, c in enumerate(sorted(children[x], key=lambda c: -size[c]))]


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with b in whole numbers: in floating point where all sums stay below 2^53, else in longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if most < 1 << 53 else a @ b


def walk(tree: Tree, anchors: np.ndarray, rows: np.ndarray, wanted):
    """Goes down the tree with bounds of all rows' scores; wanted(anchor, low, high) gives the rows to be scored exactly at an anchor.

    Yields (anchor, rows, scores) for the rows scored; there may be none.
    """
    norm = np.sqrt((rows.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for x, parent, edge, last in tree.visits:
        if parent < 0:
            low = high = exact(rows, anchors[x]).astype(np.float64)
            some = np.flatnonzero(wanted(x, low, high))
        else:
            low, high = bounds.pop(parent) if last else bounds[parent]
            reach = norm * (edge * (1 + 1e-9)) + 1e-3
            reach += np.maximum(np.abs(low), np.abs(high)) * 1e-12  # rounding of the sums themselves
            low, high = low - reach, high + reach
            some = np.flatnonzero(wanted(x, low, high))
        scores = exact(rows[some], anchors[x]) if len(some) < len(rows) // 2 else exact(rows, anchors[x])[some]
        low, high = low.copy(), high.copy()
        low[some] = high[some] = scores
        bounds[x] = low, high
        yield x, some, scores


def _best(ids: np.ndarray, scores: np.ndarray, most: int | None = None) -> np.ndarray:
    """Places in order of falling score, ties by id; at most `most` of them."""
    if most is not None and len(scores) > 4 * most:
        cut = np.partition(scores, len(scores) - most)[len(scores) - most]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))][:most]
    return np.lexsort((ids, -scores))[:most]


def _merged(held: tuple[np.ndarray, np.ndarray] | None, ids: np.ndarray, scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    if held is not None:
        ids, scores = np.r_[held[0], ids], np.r_[held[1], scores]
    at = _best(ids, scores, most)
    return ids[at], scores[at]


def _tables(batches, dim: int):
    """(ids, labels, vectors) of at most KEPT rows each, from batches of (vec_id, label, vec)."""
    for whole in batches:
        for start in range(0, whole.num_rows, KEPT):
            part = whole.slice(start, KEPT)
            yield part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("vec"), dim)


def nearest_same(rows: DataFrame, block: tuple, tree: Tree, dim: int, most: int) -> DataFrame:
    """(a, id, score): at most `most` best rows of each task for anchor number a of the block, of its label and with another id."""
    own_ids, own_labels, anchors = block

    def run(batches):
        held: list = [None] * len(anchors)
        for ids, labels, vectors in _tables(batches, dim):

            def wanted(x, low, high, ids=ids, labels=labels):
                full = held[x] is not None and len(held[x][0]) == most
                fits = (labels == own_labels[x]) & (ids != own_ids[x])
                return fits & (high >= held[x][1][-1]) if full else fits

            for x, some, scores in walk(tree, anchors, vectors, wanted):
                if len(some):
                    held[x] = _merged(held[x], ids[some], scores, most)
        yield _shown(["a", "id", "score"], [(np.full(len(h[0]), x), *h) for x, h in enumerate(held) if h is not None])

    return rows.mapInArrow(run, "a int, id long, score long")


def _shown(names: list[str], parts: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32() if n in ("a", "p") else pa.int64() for n in names]
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def windowed_others(rows: DataFrame, block: tuple, tree: Tree, dim: int, windows: list[list[tuple[int, int, int]]], most: int) -> DataFrame:
    """(a, p, id, score): at most `most` best rows of each task in window number p of anchor a, windows[a] = [(p, low, high)], of another label."""
    own_ids, own_labels, anchors = block

    def run(batches):
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def floors(x):
            """What each window of anchor x still takes."""
            for p, low, high in windows[x]:
                h = held.get((x, p))
                yield p, max(low, int(h[1][-1])) if h is not None and len(h[0]) == most else low, high

        for ids, labels, vectors in _tables(batches, dim):

            def wanted(x, low, high, ids=ids, labels=labels):
                meets = np.zeros(len(labels), bool)
                for _, least, top in floors(x):
                    meets |= (high >= least) & (low <= top)
                return meets & (labels != own_labels[x]) & (ids != own_ids[x])

            for x, some, scores in walk(tree, anchors, vectors, wanted):
                if not len(some):
                    continue
                at = _best(ids[some], scores)
                ids_x, scores_x = ids[some][at], scores[at]
                for p, least, top in floors(x):
                    first = int(np.searchsorted(-scores_x, -top))
                    few = slice(first, first + most)
                    fit = scores_x[few] >= least
                    if fit.any():
                        held[x, p] = _merged(held.get((x, p)), ids_x[few][fit], scores_x[few][fit], most)
        yield _shown(["a", "p", "id", "score"], [(np.full(len(h[0]), x), np.full(len(h[0]), p), *h) for (x, p), h in held.items()])

    return rows.mapInArrow(run, "a int, p int, id long, score long")


def _ranked(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest whole number n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); rows and anchors have (vec_id, label, vec), vec as
    integer_vectors() gives it; both are stored tables, and anchors are rows of `rows`."""
    spark = rows.sparkSession
    dims = [r.dim for r in anchors.select((F.length("vec") / 8).cast("int").alias("dim")).distinct().collect()]  # one or a few lengths of vectors
    out = []
    for dim in sorted(dims):
        mine, theirs = (t.where(F.length("vec") == 8 * dim).select("vec_id", "label", "vec") for t in (anchors, rows))
        count = max(1, -(-mine.count() // block))
        for number in range(count):  # hash blocks; one of more than `block` anchors is cut below
            part = mine if count == 1 else mine.where(F.pmod(F.xxhash64("vec_id", "vec", "label"), F.lit(count)) == number)
            own = part.orderBy("vec_id", "label", "vec").toArrow()  # about `block` anchors
            for start in range(0, own.num_rows, block):
                some = own.slice(start, block).combine_chunks()
                ids, labels = (some.column(c).to_numpy() for c in ("vec_id", "label"))
                vectors = matrix(some.column("vec"), dim)
                tree = Tree(vectors)
                best = _ranked(nearest_same(theirs, (ids, labels, vectors), tree, dim, positives), ["a"], positives)
                near = stored(best.select("a", F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
                windows: list[list[tuple[int, int, int]]] = [[] for _ in ids]
                for r in near.select("a", "p", "positive_score").collect():  # `positives` rows an anchor of the block
                    lo, hi = window_of(r.positive_score, low, high)
                    if lo <= hi:
                        windows[r.a].append((r.p, lo, hi))
                got = _ranked(windowed_others(theirs, (ids, labels, vectors), tree, dim, windows, negatives), ["a", "p"], negatives)
                names = spark.createDataFrame(list(zip(range(len(ids)), ids.tolist(), strict=True)), "a int, anchor_id long")
                out.append(stored(got.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(near, ["a", "p"]).join(names, "a"), "negatives"))
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not out:
        return spark.createDataFrame([], kinds)
    names = [k.split()[0] for k in kinds.split(", ")]
    return spark.read.schema(out[0].schema).parquet(*(t.stored_path for t in out)).select(*names)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "embeddings").where("vec_id is not null and label is not null")
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    rows = integer_vectors(named.select("vec_id", label, "embedding"), {"vec_id": "long", "label": "int"})
    rows = stored(rows.dropDuplicates(), "rows")
    anchors = stored(rows.where(F.pmod("vec_id", F.lit(50)) == 0), "anchors")
    return hard_negatives(rows, anchors)


ORACLE_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 3
"""
