"""Centroid clustering over integer vectors by bisector tournaments.

For centroids a and b the vectors nearer to b than to a are those with n.v > t, where n = 2 (b - a) and t = |b|^2 - |a|^2: one linear test
with integer normal and threshold. The normals and thresholds of all pairs are worked out once a round; a vector's nearest
centroid then comes from k-1 sign tests, each of which eliminates one centroid: the winner so far meets the next one, and zero favours the
smaller number. Only the winner's distance is computed, exactly.

A round is one pass over the written vectors: a task adds up count and component sums of each cluster over all its rows and puts out
k * dim rows at its end; Spark sums them, and k * dim rows, bounded by parameters, come back as the next centroids. Nothing
else is collected, no vector is shuffled, and a lost executor costs its tasks of one round.

Defined results: vectors of another length, null vectors and vectors with a null or non-finite component take no part and are not in the
result, nor are vectors with a component beyond 2^27 in magnitude, whose distances may not fit a long; fewer vectors than
k give as many centroids; rows that repeat a vec_id are vectors of their own; rows without a vec_id are clustered but seed no
centroid; of equal hashes the vector whose stored bytes come first seeds first; an empty cluster keeps its centroid; a sum of distances that does not
fit a long is null; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stored, table
from .integer_vectors import integer_vectors, matrix


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """normals[a, b] and thresholds[a, b] of all pairs: v is nearer to b than to a where normal.v > threshold."""
    square = (centroids * centroids).sum(1)
    return 2 * (centroids[None, :, :] - centroids[:, None, :]), square[None, :] - square[:, None]


def tournament(vectors: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each vector; of equally near ones the smallest."""
    best = np.zeros(len(vectors), np.intp)
    for rival in range(1, len(normals)):
        side = np.einsum("ij,ij->i", normals[best, rival], vectors) - thresholds[best, rival]
        best[side > 0] = rival  # on the bisector (zero) the smaller number stays
    return best


def seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of '<seed>:<vec_id>', in ascending order of the hash."""
    named = vectors.where("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return np.array([np.frombuffer(r.vec, np.int64) for r in named.orderBy("h", "vec").limit(k).select("vec").collect()], np.int64)


def _assigned(part: pa.RecordBatch, centroids: np.ndarray, pairs) -> tuple[np.ndarray, np.ndarray]:
    v = matrix(part.column("vec"), centroids.shape[1])
    best = np.concatenate([tournament(v[s : s + 4096], *pairs) for s in range(0, len(v), 4096)])
    return v, best


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise exact floor(sum / count) of each non-empty cluster."""
    k, dim = centroids.shape

    def run(batches):
        pairs, count, total = bisectors(centroids), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for part in batches:
            if part.num_rows:
                v, best = _assigned(part, centroids, pairs)
                count += np.bincount(best, minlength=k)
                np.add.at(total, best, v)
        on = np.flatnonzero(count)
        cols = [np.repeat(on, dim), np.tile(np.arange(dim), len(on)), np.repeat(count[on], dim), total[on].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["c", "d", "n", "s"])

    parts = vectors.select("vec").mapInArrow(run, "c long, d long, n long, s long")
    sums = parts.groupBy("c", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in sums.collect():  # k * dim rows at most
        out[r.c, r.d] = int(r.s) // r.n
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""

    def run(batches):
        pairs = bisectors(centroids)
        for part in batches:
            if part.num_rows:
                v, best = _assigned(part, centroids, pairs)
                off = v - centroids[best]
                cols = [part.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(np.einsum("ij,ij->i", off, off))]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "vec").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(embeddings: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the usable vectors of embeddings(vec_id, embedding)."""
    spark = embeddings.sparkSession
    vectors = stored(integer_vectors(embeddings.where(F.size("embedding") == dim), {"vec_id": "long"}), "vectors")
    centroids = seeds(vectors, k, seed)
    if not len(centroids):  # nothing that could seed a cluster
        kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], kinds)
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = stored(assigned(vectors, centroids), "assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    own = {r.cluster: int(r.own) for r in sums.collect()}  # k rows at most
    fits = lambda total: total if total < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    facts = [(n, fits(total), fits(sum(own.values())), digest(centroids[n])) for n, total in own.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 40, rounds: int = 5, dim: int = 64, seed: int = 2) -> str:
    """The same rounds by exact distances: components below 2^20 make all dot products exact in double."""
    near = "(SELECT v.vec_id, v.e, first(c.n ORDER BY list_dot_product(c.e, c.e) - 2 * list_dot_product(v.e, c.e), c.n) AS n FROM v, {c} c GROUP BY v.vec_id, v.e)"
    text = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
    WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS n, e FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})"""
    for r in range(rounds):
        text += f""",
m{r} AS MATERIALIZED (SELECT n, list(s ORDER BY i) AS e FROM (SELECT n, i, floor(sum(x) / count(*)) AS s
    FROM (SELECT n, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM {near.format(c=f"c{r}")}) GROUP BY n, i) GROUP BY n),
c{r + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m ON m.n = c.n)"""
    return f"""{text},
d AS MATERIALIZED (SELECT a.vec_id, a.n, list_dot_product(a.e, a.e) - 2 * list_dot_product(a.e, c.e) + list_dot_product(c.e, c.e) AS q, c.e AS c
    FROM {near.format(c=f"c{rounds}")} a JOIN c{rounds} c ON c.n = a.n)
SELECT vec_id, CAST(n AS INT) AS cluster, CAST(q AS BIGINT) AS distance, CAST(sum(q) OVER (PARTITION BY n) AS BIGINT) AS cluster_inertia,
    CAST(sum(q) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM d
"""


ORACLE_SQL = _sql()
