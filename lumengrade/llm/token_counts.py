"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens by the vocabulary's public pattern. The distinct, not yet counted pre-tokens of an Arrow
batch lie end to end in one flat symbol array with the number of the pre-token each symbol belongs to. A round looks up
the rank of every adjacent pair at once (binary search in the sorted merge table), finds each pre-token's lowest rank
and merges all its occurrences, left to right where they overlap; pre-tokens without a mergeable pair have settled. The
count is the number of symbols that survive. Counts are kept per worker in a bounded table of pre-tokens.

Long pre-tokens (`LONG` bytes or more) lie in an array of their own, where pair ranks are kept between rounds: a round takes the lowest
rank of all, merges its occurrences in every pre-token and looks only at the pairs next to a merge, so a word without any blank
costs little more than its length.

Special strings count as the library does by default: each occurrence is one token and cuts the text. Null and empty
texts have 0 tokens; texts and single words of any length are counted whole; of overlapping equal pairs the leftmost merges. Repeated
rows are counted one by one; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, table

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
KEPT = 400_000  # pre-tokens whose count a worker keeps
LONG = 200


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class MergeTable:
    """Merge ranks as sorted arrays: pair code (left id * width + right id) to rank and merged id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.width = max(vocab.values()) + 1
        self.first = np.array([vocab[x] for x in byte_letters()], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        code = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.rank = code[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def ranks(self, code: np.ndarray) -> np.ndarray:
        """Rank of each pair code, len(self.made) where there is none."""
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.rank[at], len(self.made))

    def survivors(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word."""
        long = np.array([len(w) >= LONG for w in words], bool)
        out = np.empty(len(words), np.int64)
        for some, count in ((long, self._long_survivors), (~long, self._short_survivors)):
            if some.any():
                out[some] = count([w for w, yes in zip(words, some, strict=True) if yes])
        return out

    def _long_survivors(self, words: list[bytes]) -> np.ndarray:
        """One round for each rank, lowest first; `rank` holds the rank of the pair that starts at each place, -1 where none starts any more."""
        none, length = len(self.made), np.array([len(w) for w in words])
        symbol = self.first[np.frombuffer(b"".join(words), np.uint8)].copy()
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(length)
        after[ends - 1], before[ends - length] = n, -1
        merged = np.zeros(n, np.int64)
        rank = np.full(n + 1, none)
        waiting: dict[int, list[np.ndarray]] = {}
        agenda: list[int] = []

        def look(places: np.ndarray) -> None:
            rank[places] = none
            places = places[after[places] < n]
            found = self.ranks(symbol[places] * self.width + symbol[after[places]])
            places, found = places[found < none], found[found < none]
            rank[places] = found
            order = np.argsort(found, kind="stable")
            cut = np.flatnonzero(np.diff(found[order])) + 1
            for part in np.split(places[order], cut) if len(places) else ():
                r = int(rank[part[0]])
                if r not in waiting:
                    heapq.heappush(agenda, r)
                waiting.setdefault(r, []).append(part)

        look(np.arange(n))
        while agenda:
            r = heapq.heappop(agenda)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:  # overlapping pairs: every other one of a run
                run = np.flatnonzero(np.r_[True, after[at[:-1]] != at[1:]])
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            gone = after[at]
            follow = after[gone]
            symbol[at], after[at], rank[gone], merged[gone] = self.made[r], follow, -1, 1
            inside = follow < n
            before[follow[inside]] = at[inside]
            left = before[at]
            look(np.unique(np.concatenate([at, left[left >= 0]])))
        return length - np.add.reduceat(merged, ends - length)

    def _short_survivors(self, words: list[bytes]) -> np.ndarray:
        out = np.array([len(w) for w in words], np.int64)
        flat = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), out)
        while len(flat) > 1:
            same = owner[1:] == owner[:-1]
            rank = np.where(same, self.ranks(flat[:-1] * self.width + flat[1:]), len(self.made))
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(np.r_[rank, len(self.made)], starts)
            live = least < len(self.made)
            if not live.any():
                break
            lowest = np.repeat(least, np.diff(np.r_[starts, len(flat)]))
            hit = (rank == lowest[:-1]) & (rank < len(self.made))
            at = np.flatnonzero(hit)
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])  # runs of overlapping hits: every other one counts
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            flat[at] = self.made[rank[at]]
            keep = np.ones(len(flat), bool)
            keep[at + 1] = False
            out -= np.bincount(owner[at], minlength=len(out))
            keep &= np.repeat(live, np.diff(np.r_[starts, len(flat)]))  # settled words leave the array
            flat, owner = flat[keep], owner[keep]
        return out


@lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


@lru_cache(maxsize=4)
def _known(path: str) -> dict[str, int]:
    return {}


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    """Token counts of the texts, in order."""
    import public_tokenizers

    merges, known, cut = merge_table(path), _known(path), regex.compile(public_tokenizers.PATTERN)
    if len(known) > KEPT:
        known.clear()
    pieces, extra = [], []
    for text in texts:
        if not text:
            pieces.append([]), extra.append(0)
        elif merges.special and merges.special.search(text):
            parts = merges.special.split(text)
            pieces.append([x for p in parts for x in cut.findall(p)]), extra.append(len(parts) - 1)
        else:
            pieces.append(cut.findall(text)), extra.append(0)
    new = [*{x for p in pieces for x in p if x not in known}]
    for k in range(0, len(new), 20_000):
        part = new[k : k + 20_000]
        known.update(zip(part, merges.survivors([x.encode() for x in part]).tolist(), strict=True))
    counts = [sum(map(known.__getitem__, p)) + e for p, e in zip(pieces, extra, strict=True)]
    for x in new:
        if len(x) >= LONG:  # too large to keep
            del known[x]
    return counts


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of docs(doc_id, text)."""
    path = path or vocabulary_path()
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_bytes", "n_tokens")])

    def run(batches):
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(count_tokens(texts, path), pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > limit)
