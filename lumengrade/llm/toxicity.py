"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give document scores and offsets.

Labels mark documents, so labelled tokens come first: over the training sample, each feature of a word (the word, its
prefixes of 4 to 6 letters) is tested for a higher share of toxic documents (log-likelihood ratio, at odds of 8 or more);
words of toxic documents that have such a feature are labelled toxic, all others clean. The field has the two tags as
states, hashed word features as emissions and four transitions, and is fitted to these labels sentence by sentence with
forward-backward expectations and Adam.

A document's score combines, by a logistic link fitted on the sample's document labels and moved to the labels' own
class shares, the greatest marginal of its words and the expected number of toxic words among those with a marginal of 0.2
or more, so that mere length doesn't add up to toxicity. Spans are runs of words
whose marginal is 0.5 or more, with character offsets.

The training sample holds the labelled rows of smallest id hash, at most `per_class` of either class and `sample_chars`
characters of text in all; rows are whole texts. Scoring reads every whole text. Labels are read for training only.

Defined results: null and empty texts get the score of a document without words; several labels for one id count
as toxic if one does; repeated rows are scored one by one; further columns are ignored; without labels of both classes every score is 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WORD, slices, stored, table

MASK = (1 << 18) - 1
EDGE = ".,;:!?()[]{}\"'`*_<>#$%&|-"
SPACES = re.compile(WORD)


def features(word: str) -> list[str]:
    """Feature names of a word, without case and outer punctuation."""
    w = word.lower().strip(EDGE)
    return [f"w={w}", *(f"{n}^{w[:n]}" for n in (4, 5, 6) if len(w) > n)]


def sentences(text: str) -> list[list[str]]:
    """Words by sentence; sentences end with a line or with a word closed by . ! or ?"""
    out = []
    for line in text.split("\n"):
        now: list[str] = []
        for word in SPACES.findall(line):
            now.append(word)
            if word[-1] in ".!?":
                out.append(now)
                now = []
        if now:
            out.append(now)
    return out


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = 1000, sample_chars: int = 15_000_000) -> tuple[list[tuple[str, int]], float]:
    """(text, toxic) of the training sample, and the share of toxic rows among all training labels."""
    spark = docs.sparkSession
    known = labels.where("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = [r for c in (0, 1) for r in known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    if not n.get(0) or not n.get(1):
        return [], 0.0
    ids = spark.createDataFrame([(r["doc_id"], int(r["toxic"])) for r in chosen], "doc_id long, toxic int")  # at most 2 * per_class rows
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    found = stored(found.withColumn("size", F.length("text")).withColumn("at", F.xxhash64("doc_id")), "toxic-sample")
    left, fits = sample_chars, []
    for r in sorted(found.select("doc_id", "size", "at").collect(), key=lambda r: (r["at"], r["doc_id"])):
        if r["size"] <= left:
            left -= r["size"]
            fits.append(r["doc_id"])
    rows = found.where(F.col("doc_id").isin(fits)).orderBy("at", "doc_id", "size").collect() if fits else []
    return [*dict.fromkeys((r["text"], r["toxic"]) for r in rows)], n[1] / (n[0] + n[1])


def toxic_features(docs: list[tuple[np.ndarray, int]], named: list[list[str]], odds: float = 8.0) -> set[str]:
    """Features whose documents are toxic far more often than others, beyond what so many features show by chance. docs: (word numbers,
    toxic); named: the features of each word."""
    seen: list[Counter] = [Counter(), Counter()]
    for code, toxic in docs:
        seen[toxic].update({f for w in np.unique(code).tolist() for f in named[w]})
    n0, n1 = (sum(1 for _, t in docs if t == c) for c in (0, 1))
    base, floor, out = n1 / (n0 + n1), math.log(max(10, len(seen[1]))), set()
    for f, a in seen[1].items():
        b = seen[0][f]
        if (a + 0.5) / (n1 - a + 0.5) < odds * (b + 0.5) / (n0 - b + 0.5):
            continue
        gain = a * math.log(a / (a + b) / base) + (b * math.log(b / (a + b) / (1 - base)) if b else 0.0)
        if gain >= floor:
            out.add(f)
    return out


class Chain:
    """Two-tag chain: emission is the toxic tag's score over the clean one's, `trans[i, j]` the score of tag j after i."""

    def __init__(self, weight: np.ndarray, trans: np.ndarray, link: tuple[float, ...]):
        self.weight, self.trans, self.link = weight, trans, link

    def emission(self, word: str) -> float:
        return float(self.weight[[zlib.crc32(f.encode()) & MASK for f in features(word)]].sum() + self.weight[MASK + 1])

    def marginals(self, emit: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of sentences laid end to end: P(toxic) of each word, log P(no toxic word) of each sentence, log Z, and pair sums.

        Sentences run side by side in groups of like length, one step per place.
        """
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        prob, clean, logz, pairs = np.empty(len(emit)), np.empty(len(length)), np.empty(len(length)), np.zeros((2, 2))
        group = np.ceil(np.log2(np.maximum(length, 1))).astype(int)
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            n, wide = length[at], int(length[at].max())
            place = np.minimum(start[at][:, None] + np.arange(wide), len(emit) - 1)
            live = np.arange(wide) < n[:, None]
            e = np.where(live, emit[place], 0.0)
            a = np.zeros((wide, 2, len(at)))  # forward scores by place, tag, sentence
            b = np.zeros((wide, 2, len(at)))
            a[0, 1] = e[:, 0]
            t = self.trans
            for k in range(1, wide):
                a[k, 0] = np.logaddexp(a[k - 1, 0] + t[0, 0], a[k - 1, 1] + t[1, 0])
                a[k, 1] = np.logaddexp(a[k - 1, 0] + t[0, 1], a[k - 1, 1] + t[1, 1]) + e[:, k]
                a[k] = np.where(live[:, k], a[k], a[k - 1])
            for k in range(wide - 2, -1, -1):
                one, ok = e[:, k + 1] + b[k + 1, 1], live[:, k + 1]
                b[k, 0] = np.where(ok, np.logaddexp(t[0, 0] + b[k + 1, 0], t[0, 1] + one), 0.0)
                b[k, 1] = np.where(ok, np.logaddexp(t[1, 0] + b[k + 1, 0], t[1, 1] + one), 0.0)
            z = np.logaddexp(a[-1, 0], a[-1, 1])
            p = np.exp(a[:, 1] + b[:, 1] - z).T
            prob[place[live]] = p[live]
            clean[at], logz[at] = (n - 1) * t[0, 0] - z, z
            for i in (0, 1):
                for j in (0, 1):
                    x = a[:-1, i] + t[i, j] + b[1:, j] + (e[:, 1:].T if j else 0.0) - z
                    pairs[i, j] += np.exp(x[live[:, 1:].T]).sum()
        return prob, clean, logz, pairs

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ np.array(self.link), -30, 30)))


def document_evidence(prob: np.ndarray, owner: np.ndarray, n: int, floor: float = 0.2) -> np.ndarray:
    """Rows of the document link: 1, log-odds of the greatest marginal, log of 1 + expected number of toxic words."""
    top = np.zeros(n)
    np.maximum.at(top, owner, prob)
    clear = prob >= floor
    expected = np.bincount(owner[clear], weights=prob[clear], minlength=n)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(expected)], 1)


def fit_chain(rows: list[tuple[str, int]], share: float, steps: int = 60, ridge: float = 1e-3, rate: float = 0.15) -> Chain | None:
    """The chain fitted to the sample; None without both classes."""
    if not rows or len({t for _, t in rows}) < 2:
        return None
    ids: dict[str, int] = {}
    docs, lengths = [], []
    for text, toxic in rows:
        sents = sentences(text)
        docs.append((np.array([ids.setdefault(w, len(ids)) for s in sents for w in s], np.int32), toxic))
        lengths.append(np.array([*map(len, sents)], np.int64))
    named = [features(w) for w in ids]
    marks = toxic_features(docs, named)
    toxic_word = np.array([any(f in marks for f in fs) for fs in named], bool)
    width = 4
    table_ = np.full((len(ids), width), MASK + 2)  # the last weight stays 0
    for k, fs in enumerate(named):
        table_[k, : len(fs)] = [zlib.crc32(f.encode()) & MASK for f in fs[:width]]
    del ids, named
    chosen: list[tuple[np.ndarray, bool]] = []
    spare: list[tuple[np.ndarray, bool]] = []
    for (code, toxic), n in zip(docs, lengths, strict=True):
        for s in np.split(code, np.cumsum(n)[:-1]) if len(n) else ():
            (chosen if toxic and toxic_word[s].any() else spare).append((s, bool(toxic)))
    chosen += spare[:: max(1, len(spare) // max(2000, 4 * len(chosen)))]
    del spare
    if not chosen:
        return None
    flat, length = np.concatenate([s for s, _ in chosen]), np.array([len(s) for s, _ in chosen])
    gold = (toxic_word[flat] & np.repeat([t for _, t in chosen], length)).astype(float)
    inside = np.ones(len(flat) - 1, bool)
    inside[np.cumsum(length)[:-1] - 1] = False
    pair_gold = np.array([[((gold[:-1] == i) & (gold[1:] == j) & inside).sum() for j in (0, 1)] for i in (0, 1)], float)
    used, flat = np.unique(flat, return_inverse=True)
    cols = table_[used]
    theta = np.zeros(MASK + 3 + 4)
    theta[MASK + 1] = -2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = len(length)
    for step in range(1, steps + 1):
        emit = (theta[cols].sum(1) + theta[MASK + 1])[flat]
        chain = Chain(theta, theta[-4:].reshape(2, 2), ())
        prob, _, _, pairs = chain.marginals(emit, length)
        by_word = np.bincount(flat, weights=gold - prob, minlength=len(used))
        grad = np.zeros_like(theta)
        np.add.at(grad, cols.ravel(), np.repeat(by_word, width))
        grad[MASK + 1], grad[MASK + 2] = by_word.sum(), 0.0
        grad[-4:] = (pair_gold - pairs).ravel()
        grad = grad / total - ridge * theta * (np.arange(len(theta)) < MASK + 1) / 10
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta[MASK + 2] = 0.0
    chain = Chain(theta[: MASK + 3].astype(np.float32), theta[-4:].reshape(2, 2).copy(), ())
    emit_of = chain.weight[table_].sum(1) + chain.weight[MASK + 1]
    parts, at = [], 0
    while at < len(docs):  # some 200000 words at a time
        upto = at + max(1, int(np.searchsorted(np.cumsum([len(c) for c, _ in docs[at : at + 500]]), 200_000)))
        some = docs[at:upto]
        owner = np.repeat(np.arange(len(some)), [len(c) for c, _ in some])
        emit = emit_of[np.concatenate([c for c, _ in some])].astype(float)
        prob = chain.marginals(emit, np.concatenate(lengths[at:upto]))[0] if len(emit) else emit
        parts.append(document_evidence(prob, owner, len(some)))
        at = upto
    x = np.concatenate(parts)
    y = np.array([t for _, t in docs], float)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps of the ridge logistic link
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w += np.linalg.solve(hess, x.T @ (y - p) - 0.5 * w)
    here = y.mean()
    w[0] += math.log(share / (1 - share)) - math.log(here / (1 - here))
    chain.link = tuple(w.tolist())
    return chain


class _Words(dict):
    """Word to (number, ends a sentence); emissions by number grow beside it."""

    def __init__(self, chain: Chain):
        self.chain, self.emit = chain, []

    def __missing__(self, word: str) -> int:
        value = self[word] = 2 * len(self.emit) + (word[-1] in ".!?")
        self.emit.append(self.chain.emission(word))
        return value


def free(name: str, taken: list[str]) -> str:
    """name, with as many underscores behind it as it takes to be none of `taken`."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def score_documents(docs: DataFrame, chain: Chain | None, with_spans: bool = True) -> DataFrame:
    """docs, each row with all its columns, plus _score and _spans (free() names where docs has such columns). Only `text` is read."""
    added = [free("_score", docs.columns), free("_spans", docs.columns)]
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def joined(part, score, spans):
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64()), pa.array(spans, spans_type)], names=[*part.schema.names, *added])

    def run(batches):
        words = _Words(chain) if chain else None
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            if chain is None:
                yield joined(part, [0.0] * len(texts), [[]] * len(texts))
                continue
            if len(words) > 200_000:
                words = _Words(chain)
            number, ends, size = [], [], []
            for text in texts:
                before = len(number)
                for line in text.split("\n") if text else ():
                    found = [words[w] for w in SPACES.findall(line)]
                    if found:
                        number += found
                        ends.append(len(number))
                size.append(len(number) - before)
            code = np.array(number, np.int64)
            closes = (code & 1) == 1
            closes[np.array(ends, np.int64) - 1] = True
            stops = np.flatnonzero(closes) + 1
            length = np.diff(np.concatenate([[0], stops])) if len(stops) else np.empty(0, int)
            emit = np.array(words.emit)[code >> 1] if len(code) else np.empty(0)
            owner = np.repeat(np.arange(len(texts)), size)
            prob = chain.marginals(emit, length)[0] if len(code) else np.empty(0)
            score = chain.score(document_evidence(prob, owner, len(texts)))
            spans: list[list] = [[] for _ in texts]
            if with_spans and len(code):
                first = np.concatenate([[0], np.cumsum(size)])
                for d in np.unique(owner[prob >= 0.5]).tolist():
                    own = prob[first[d] : first[d + 1]]
                    last = -2
                    for k, m in enumerate(SPACES.finditer(texts[d])):
                        if own[k] >= 0.5:
                            if last == k - 1:
                                spans[d][-1] |= {"end": m.end(), "probability": max(spans[d][-1]["probability"], float(own[k]))}
                            else:
                                spans[d].append({"start": m.start(), "end": m.end(), "probability": float(own[k])})
                            last = k
            yield joined(part, score, spans)

    extra = T.StructType.fromDDL(f"{added[0]} double, {added[1]} array<struct<start:int,end:int,probability:double>>")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra.fields]))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 1000, with_spans: bool = True) -> DataFrame:
    """docs with all its columns plus _score (0 to 1) and _spans, learned from labels(doc_id, toxic)."""
    rows, share = training_rows(docs, labels, per_class)
    return score_documents(docs, fit_chain(rows, share), with_spans)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), table(spark, sf_dir, "labels"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.size("_spans").alias("n_spans"))
