"""MinHash near-duplicates by SetSketch registers: band, estimate by likelihood, verify on full sets, group.

1. One pass over the texts makes for each document the 64-bit hashes of its distinct word shingles, their number, a
   digest of the whole set and a sketch. A register is a truncated minimum on an exponential scale: the smallest of the
   set's exponential variates h gives floor(1 - log_base(h)), so equal registers get likelier with similarity and the
   sketch of a union is the element-wise maximum.
2. Documents with equal sets form a class with a number of its own (not an id, which may repeat with other texts), in the order of
   their smallest ids; copies are linked by that alone.
3. Bands, fixed random subsets of the registers, name buckets. Rows (bucket, class) are dealt by range and sorted,
   so a bucket of any size is read as runs, over several tasks if need be, and each member is paired with the first of its run,
   its hub. Of all its hubs a class is tested against the one with which it shares most buckets. Pairs are estimated by maximising
   the joint likelihood of greater / smaller / equal registers given both set sizes; those that might reach the threshold are
   verified on the full sets. Components of the links are the parts.
4. Buckets that still hold several parts get the rest: every pair across two parts has a member outside the bucket's largest
   part, so the others, cut into tiles of bounded size, meet the tiles of all members. A pair of tiles is one bounded group of rows,
   spread over all tasks. First sketches are compared, each pair in the first band it shares; members left with a partner that might reach
   the threshold (five standard errors) bring their full sets, intersections of whole tiles are counted by matrix products, and
   only a spanning forest of parts comes out. So each pair that shares a bucket is verified, refuted by its estimate, or lies
   within one component already, and no step puts out more rows than it has members.

The registers per band grow with the logarithm of the number of classes, so that documents which share no more than
common shingles keep missing each other; the number of bands is what a pair at the threshold then needs to share one but for a
share `MISS`, with all bands drawn from the same registers. Texts are hashed a second time only for documents in a pair; a bitmap of bounded size tells them.

Defined results: null, empty and blank texts have empty sets and link with nothing (own component); a text of fewer words
than a shingle has its whole word sequence as one shingle; repeated rows are in one component and all kept rows if they
repeat the smallest id; an id that repeats with another text has a component for each text; rows without an id link with nothing
and are kept, with no component_id; ids are integers; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import components, forget, sized, slices, stored, table, whole_groups

REGISTERS, BASE, LIMIT = 192, 1.02, 4000
BACKGROUND, MISS = 0.05, 1e-5  # similarity of unlike documents; share of links at the threshold that no band may find
TILE, TILE_HASHES = 512, 1 << 20  # members of a tile, and shingles of all of them
MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(text: str | None, size: int, words_of: _WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of one text."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words_of.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    out = np.full(len(h) - width + 1, width if width < size else 0, np.uint64)
    for k in range(width):
        out = (out ^ h[k : len(h) - width + 1 + k]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


@lru_cache(maxsize=4)
def _multipliers(registers: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 62, (1 << 64) - 1, registers, dtype=np.uint64) | np.uint64(1)


def sketch(hashes: np.ndarray, registers: int = REGISTERS, base: float = BASE, limit: int = LIMIT) -> np.ndarray:
    """Registers (uint16) of a set; an empty set has zeros."""
    if not len(hashes):
        return np.zeros(registers, np.uint16)
    mult, least = _multipliers(registers), np.full(registers, np.iinfo(np.uint64).max)
    x = hashes ^ (hashes >> np.uint64(31))
    for k in range(0, len(x), 256):
        np.minimum(least, (x[k : k + 256, None] * mult[None, :]).min(axis=0), out=least)
    rate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
    return np.clip(np.floor(1 - np.log(np.maximum(rate, 1e-30)) / math.log(base)), 0, limit).astype(np.uint16)


def _log_likelihood(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float):
    """The log-likelihood of similarity j of sketch rows a, b with set sizes na, nb as a function, and the greatest j the sizes allow."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / math.log(base), 1e-12, 1)

    def value(j: np.ndarray) -> np.ndarray:
        more, less = p(u - v * j), p(v - u * j)
        return up * np.log(more) + down * np.log(less) + same * np.log(np.clip(1 - more - less, 1e-12, 1))

    return value, np.minimum(u / v, v / u)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float = BASE) -> np.ndarray:
    """Maximum-likelihood similarity of sketch rows a, b with set sizes na, nb, by ternary search on the log-likelihood."""
    value, high = _log_likelihood(a, b, na, nb, base)
    low = np.zeros(len(high))
    for _ in range(40):
        x, y = low + (high - low) / 3, high - (high - low) / 3
        right = value(x) < value(y)
        low, high = np.where(right, x, low), np.where(right, high, y)
    return (low + high) / 2


def reaches(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float, base: float = BASE) -> np.ndarray:
    """Whether estimate() is `least` or more: the log-likelihood has one peak, so its slope there tells."""
    value, high = _log_likelihood(a, b, na, nb, base)
    at = np.minimum(least, high)
    return (high >= least) & (value(np.minimum(at + 1e-5, high)) >= value(at - 1e-5))


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sketch) of every row."""
    fields = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sketch", pa.binary())]

    def run(batches):
        words_of = _WordHash()
        for part in slices(batches):
            sets = [shingle_hashes(t, shingle, words_of) for t in part.column("text").to_pylist()]
            keys = [hashlib.md5(s.tobytes()).digest() for s in sets]
            made = [sketch(s).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(made, pa.binary())], schema=pa.schema(fields))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sketch binary")


def missed(bands: int, rows: int, equal: float, registers: int = REGISTERS) -> float:
    """Share of pairs whose registers agree with odds `equal` that share none of so many random bands of the same registers."""
    k = np.arange(registers + 1)
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, registers + 1)))])
    weight = np.exp(log[-1] - log - log[::-1] + k * math.log(equal) + (registers - k) * math.log(1 - equal))
    with np.errstate(divide="ignore"):
        one = np.where(k >= rows, np.exp(log - log[np.maximum(k - rows, 0)] - log[-1] + log[registers - rows]), 0.0)
        return float(weight @ np.exp(bands * np.log1p(-np.minimum(one, 1.0))))


def banding(classes: int, threshold: float) -> list[list[int]]:
    """Registers of each band for so many classes."""
    rows, bands = max(6, math.ceil(math.log(10 * max(1, classes)) / -math.log(BACKGROUND))), 8
    while missed(bands, rows, threshold) > MISS:
        bands += 2
    rng = np.random.default_rng(5)
    return [rng.choice(REGISTERS, rows, replace=False).tolist() for _ in range(bands)]


def band_keys(registers: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """64-bit key of each band of each sketch row."""
    key = np.broadcast_to(np.arange(len(picks), dtype=np.uint64) * MIX, (len(registers), len(picks))).copy()
    wide = registers.astype(np.uint64)
    for k in range(picks.shape[1]):
        key = (key ^ wide[:, picks[:, k]]) * MIX
        key ^= key >> np.uint64(29)
    return key.astype(np.int64)


def _registers(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint16).reshape(len(sketches), -1)


def band_rows(reps: DataFrame, bands: list[list[int]]) -> DataFrame:
    """(key, cid) for each band of each class."""
    picks = np.array(bands)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                t = whole.slice(start, 2000)
                keys = band_keys(_registers(t.column("sketch")), picks)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(t.column("cid").to_numpy(), len(picks)))], names=["key", "cid"])

    return reps.select("cid", "sketch").mapInArrow(run, "key long, cid long")


def bucket_runs(batches):
    """(key, cid, hub, starts) of rows sorted by key: hub is the first class of the run, `starts` tells the partition's first run,
    whose bucket may have begun elsewhere. Runs of one class drop out unless they are the partition's first or last."""
    schema = pa.schema([("key", pa.int64()), ("cid", pa.int64()), ("hub", pa.int64()), ("starts", pa.bool_())])
    first = last = hub = held = None  # held: a run of one row so far, at the end of what has been read

    def shown(k, c, h):
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c), pa.array(h), pa.array(k == first)], schema=schema)

    for t in batches:
        if not t.num_rows:
            continue
        k, c = (t.column(n).to_numpy() for n in ("key", "cid"))
        first = k[0] if first is None else first
        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size, hubs = np.diff(np.r_[start, len(k)]), c[start].copy()
        show = (size > 1) | (k[start] == first)
        if last is not None and k[0] == last:
            hubs[0], show[0] = hub, True
            if held is not None:
                yield shown(*(np.array([x]) for x in held))
        held = None if show[-1] else (k[-1], c[-1], c[-1])
        rows = np.repeat(show, size)
        yield shown(k[rows], c[rows], np.repeat(hubs, size)[rows])
        last, hub = k[-1], hubs[-1]
    if held is not None:
        yield shown(*(np.array([x]) for x in held))


def hub_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): each class with the hub it shares most buckets with, and the hubs of buckets cut by a partition's edge with each other."""
    count = shared.where("cid <> hub").groupBy("cid", "hub").agg(F.count("*").alias("n"))
    best = count.groupBy("cid").agg(F.max(F.struct("n", (-F.col("hub")).alias("hub"))).alias("x")).select("cid", (-F.col("x.hub")).alias("hub"))
    cut = F.broadcast(shared.where("starts").select("key").distinct())  # one key a partition at most
    heads = shared.join(cut, "key", "left_semi").select("key", "hub").distinct()
    least = heads.groupBy("key").agg(F.min("hub").alias("cid"))
    over = heads.join(least, "key").where("hub <> cid").select("cid", "hub")
    both = best.unionByName(over)
    return both.select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()


PAIR = "a long, b long, ka binary, kb binary, rep_a long, rep_b long"


def near(pairs: DataFrame, reps: DataFrame, threshold: float, about: int) -> DataFrame:
    """PAIR rows, with set keys and smallest ids, of pairs(a, b) whose sizes and estimated similarity leave the threshold possible."""
    ends = [reps.select(F.col("cid").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"), F.col("set_key").alias(f"k{c}"), F.col("rep").alias(f"rep_{c}")) for c in "ab"]
    both = pairs.join(ends[0], "a").join(ends[1], "b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-6)
    names = [x.split()[0] for x in PAIR.split(", ")]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                t = whole.slice(start, 2000)
                keep = pa.array(_likely(*(_registers(t.column(c)) for c in ("sa", "sb")), *(t.column(c).to_numpy() for c in ("na", "nb")), threshold))
                yield t.select(names).filter(keep)

    return sized(both.select("na", "nb", "sa", "sb", *names), about).mapInArrow(run, PAIR)


def _likely(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the estimate is within five standard errors of the threshold or above it."""
    error = math.sqrt(threshold * (1 - threshold) / ka.shape[1])
    out = (ka == kb).sum(1) >= ka.shape[1] * (threshold - 6 * error)
    out[out] = reaches(ka[out], kb[out], na[out].astype(float), nb[out].astype(float), threshold - 5 * error)
    return out


def _spots(ids: np.ndarray, bits: int) -> np.ndarray:
    h = ids.astype(np.uint64) * MIX
    return ((h ^ (h >> np.uint64(32))) & np.uint64(bits - 1)).astype(np.int64)


def id_bitmap(wanted: DataFrame, about: int, most: int = 1 << 27) -> np.ndarray:
    """Bitmap of hashed ids of wanted(doc_id), at most `about` ids, 16 bits an id and `most` bits in all: the only thing that goes to every task."""
    bits = 1 << 16
    while bits < min(16 * about, most):
        bits *= 2

    def run(batches):
        got = np.zeros(bits // 8, np.uint8)
        for t in batches:
            at = _spots(t.column("doc_id").to_numpy(), bits)
            np.bitwise_or.at(got, at >> 3, (1 << (at & 7)).astype(np.uint8))
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(got[at].astype(np.int32))], names=["at", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    parts = wanted.select("doc_id").mapInArrow(run, "at long, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    for t in parts.toArrow().to_batches():
        out[t.column("at").to_numpy()] = t.column("bits").to_numpy().astype(np.uint8)
    return out


def full_sets(wanted: DataFrame, docs: DataFrame, shingle: int, about: int) -> DataFrame:
    """(set_key, hashes), once each, of the sets of the classes of wanted(doc_id), `about` at most, and of some more: only documents that
    the bitmap of ids lets through are hashed again."""
    bitmap = docs.sparkSession.sparkContext.broadcast(id_bitmap(wanted, about))
    fields = [("set_key", pa.binary()), ("hashes", pa.binary())]

    def whole(batches):
        words_of, known = _WordHash(), bitmap.value
        for part in slices(batches):
            at = _spots(part.column("doc_id").to_numpy(), len(known) * 8)
            part = part.filter(pa.array((known[at >> 3] >> (at & 7)) & 1 == 1))
            sets = [shingle_hashes(t, shingle, words_of).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(s).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())], schema=pa.schema(fields))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return stored(sized(texts.mapInArrow(whole, "set_key binary, hashes binary").dropDuplicates(["set_key"]), about), "sets")


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, threshold: float, about: int) -> DataFrame:
    """(a, b) of PAIR rows, a stored table, whose full sets reach the threshold, stored."""
    sets = full_sets(pairs.select(F.col("rep_a").alias("doc_id")).unionByName(pairs.select(F.col("rep_b").alias("doc_id"))), docs, shingle, about)
    percent = round(100 * threshold)

    def run(batches):
        for t in batches:
            keep = []
            for x, y in zip(t.column("ha"), t.column("hb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], names=["a", "b"])

    x, y = (sets.select(F.col("set_key").alias(f"k{c}"), F.col("hashes").alias(f"h{c}")) for c in ("a", "b"))
    both = pairs.select("a", "b", "ka", "kb").join(x, "ka").join(y, "kb").select("a", "b", "ha", "hb")
    links = stored(sized(both, about).mapInArrow(run, "a long, b long"), "links")
    forget(sets)
    return links


def tiled(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, r, c, cid, n, part, minor, role) of buckets with several parts: members outside the largest part (role 0, in tile r)
    facing all members (role 1, in tile c). parts(cid, part, n)."""
    member = shared.select("key", "cid").join(parts, "cid")
    by = member.groupBy("key", "part").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    per = by.groupBy("key").agg(F.count("*").alias("parts"), F.sum("k").alias("k"), F.sum("w").alias("w"), F.max(F.struct("k", "w", "part")).alias("top"))
    tiles = lambda k, w: F.ceil(F.greatest(k / TILE, w / TILE_HASHES)).cast("int")
    per = per.where("parts > 1").select("key", F.col("top.part").alias("major"), tiles(F.col("k") - F.col("top.k"), F.col("w") - F.col("top.w")).alias("rs"), tiles(F.col("k"), F.col("w")).alias("cs"))
    faced = member.join(stored(per, "mixed"), "key").withColumn("minor", F.col("part") != F.col("major"))
    spot = F.xxhash64("cid", "key")
    base = ["cid", "n", "part", "minor"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = faced.where("minor").select("key", F.pmod(spot, F.col("rs")).cast("int").alias("r"), every("cs").alias("c"), *base, F.lit(0).alias("role"))
    cols = faced.select("key", every("rs").alias("r"), F.pmod(spot, F.col("cs")).cast("int").alias("c"), *base, F.lit(1).alias("role"))
    return rows.unionByName(cols)


UNIT = ["key", "r", "c"]
MEMBER = "key long, r int, c int, cid long, n long, part long, minor boolean, role int"


def dealt(members: DataFrame, extra: DataFrame, about: int) -> DataFrame:
    """Members with their row of extra, sorted by unit; a unit's rows are in one task and follow each other."""
    return sized(members.join(extra, extra.columns[0]).repartition(*UNIT), about).sortWithinPartitions(*UNIT, "role", "cid")


def unit_pairs(t: pa.RecordBatch, threshold: float, most: int = 1 << 18):
    """Pairs (i, j) of rows of whole units sorted by role: role 0 against role 1, parts that differ, each pair once, sizes within reach."""
    cols = {n: t.column(n).to_numpy(zero_copy_only=False) for n in ("key", "r", "c", "cid", "n", "part", "minor", "role")}
    ids = np.stack([cols[n] for n in UNIT])
    start = np.flatnonzero(np.r_[True, (ids[:, 1:] != ids[:, :-1]).any(0)])
    end = np.r_[start[1:], t.num_rows]
    split = start + np.add.reduceat((cols["role"] == 0).astype(np.int64), start)
    i = np.flatnonzero(cols["role"] == 0)
    unit = np.searchsorted(start, i, "right") - 1
    wide = (end - split)[unit]
    done = 0
    while done < len(i):
        upto = max(done + 1, done + int(np.searchsorted(np.cumsum(wide[done:]), most, "right")))
        w = wide[done:upto]
        a = np.repeat(i[done:upto], w)
        b = np.repeat(split[unit[done:upto]], w) + np.arange(len(a)) - np.repeat(np.cumsum(w) - w, w)
        ok = (cols["part"][a] != cols["part"][b]) & (~cols["minor"][b] | (cols["cid"][a] < cols["cid"][b]))
        ok &= np.minimum(cols["n"][a], cols["n"][b]) >= threshold * np.maximum(cols["n"][a], cols["n"][b]) - 1e-6
        yield a[ok], b[ok], unit[np.repeat(np.arange(done, upto), w)[ok]]
        done = upto


def likely_members(members: DataFrame, reps: DataFrame, bands: list[list[int]], threshold: float, about: int) -> DataFrame:
    """The members, with smallest ids and set keys, with a partner in their unit that might reach the threshold, the unit's band being the
    first the two share."""
    schema = f"{MEMBER}, rep long, set_key binary"
    picks, names = np.array(bands), [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for t in whole_groups(batches, UNIT):
            sketch, n, key = _registers(t.column("sketch")), t.column("n").to_numpy(), t.column("key").to_numpy()
            own = band_keys(sketch, picks)
            keep = np.zeros(t.num_rows, bool)
            for i, j, _ in unit_pairs(t, threshold):
                for k in range(0, len(i), 1 << 13):
                    p, q = i[k : k + (1 << 13)], j[k : k + (1 << 13)]
                    likely = _likely(sketch[p], sketch[q], n[p], n[q], threshold)
                    p, q = p[likely], q[likely]
                    first = own[p, (own[p] == own[q]).argmax(1)] == key[p]
                    keep[p[first]] = keep[q[first]] = True
            if keep.any():
                yield t.select(names).filter(pa.array(keep))

    return dealt(members, reps.select("cid", "sketch", "rep", "set_key"), about).mapInArrow(run, schema)


def common(sets: list[np.ndarray], rows: int, block: int = 2048) -> np.ndarray:
    """Sizes of the intersections of the first `rows` sets with the others, by products of incidence matrices over blocks of shingles."""
    value, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    left, right = (np.bincount(code[at], minlength=len(value)) > 0 for at in (owner < rows, owner >= rows))
    number = np.cumsum(left & right) - 1  # only shingles on both sides
    on = (left & right)[code]
    code, owner = number[code[on]], owner[on]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((rows, len(sets) - rows), np.float32)
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, block):
        s = slice(*np.searchsorted(code, [at, at + block]))
        seen = np.zeros((len(sets), block), np.float32)
        seen[owner[s], code[s] - at] = 1
        out += seen[:rows] @ seen[rows:].T
    return out.astype(np.int64)


def part_links(members: DataFrame, sets: DataFrame, threshold: float, about: int) -> DataFrame:
    """(a, b): in each unit, a spanning forest of the parts that links of the threshold or more connect."""
    percent = round(100 * threshold)

    def run(batches):
        for t in whole_groups(batches, UNIT):
            hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("hashes")]
            n, part = (t.column(c).to_numpy() for c in ("n", "part"))
            parent: dict[int, int] = {}
            edges: list[tuple[int, int]] = []

            def root(x: int, parent=parent) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for i, j, unit in unit_pairs(t, threshold):
                for u in np.unique(unit):
                    p, q = i[unit == u], j[unit == u]
                    rows, cols = np.unique(p), np.unique(q)
                    both = common([hashes[k] for k in (*rows, *cols)], len(rows))[np.searchsorted(rows, p), np.searchsorted(cols, q)]
                    hit = 100 * both >= percent * (n[p] + n[q] - both)
                    for a, b in np.unique(np.stack([part[p[hit]], part[q[hit]]], 1), axis=0).tolist():
                        x, y = root(a), root(b)
                        if x != y:
                            parent[x] = y
                            edges.append((min(a, b), max(a, b)))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges, strict=True)], names=["a", "b"])

    return dealt(members, sets, about).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs(doc_id, text)."""
    base = stored(sketches(docs, shingle), "sketch")
    own = base.where("n_shingles > 0 and doc_id is not null")
    classes = own.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    # Numbers in the order of the smallest ids, so that hubs and components tend to be the oldest documents.
    reps = stored(classes.repartitionByRange("rep", "set_key").sortWithinPartitions("rep", "set_key").withColumn("cid", F.monotonically_increasing_id()), "reps")
    count = reps.count()
    bands = banding(count, threshold)
    rows = band_rows(reps, bands).repartitionByRange("key", "cid").sortWithinPartitions("key", "cid")
    shared = stored(rows.mapInArrow(bucket_runs, "key long, cid long, hub long, starts boolean"), "buckets")

    tested = stored(near(hub_pairs(shared), reps, threshold, count), "near")
    links = verified(tested, docs, shingle, threshold, count)
    label = components(links).withColumnRenamed("id", "cid")
    parts = reps.select("cid", "set_key", F.col("n_shingles").alias("n")).join(label, "cid", "left")
    parts = stored(sized(parts.select("cid", "set_key", "n", F.coalesce("component_id", "cid").alias("part")), count, 200_000), "parts")
    forget(tested, links)

    left = stored(likely_members(tiled(shared, parts.select("cid", "part", "n")), reps, bands, threshold, shared.count()), "likely")
    forget(shared)
    if not left.isEmpty():
        sets = full_sets(left.select(F.col("rep").alias("doc_id")), docs, shingle, count)
        links = stored(part_links(left, sets, threshold, left.count()), "links")
        forget(sets)
        moved = parts.join(components(links).withColumnRenamed("id", "part"), "part", "left")
        parts = moved.select("set_key", F.coalesce("component_id", "part").alias("part"))
    forget(left)

    least = reps.select(F.col("cid").alias("part"), F.col("rep").alias("component_id"))  # a component's smallest class has its smallest id
    final = parts.join(least, "part").select("set_key", "component_id")
    got = base.select("doc_id", "n_shingles", "set_key").where("n_shingles > 0 and doc_id is not null").join(final, "set_key").select("doc_id", "n_shingles", "component_id")
    got = got.unionByName(base.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return got.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
