"""Language identification by Bayesian evidence fusion.

Text evidence: character-trigram log-likelihoods over whole texts under one model per language, fitted on a bounded
sample of labelled rows (`sample_rows`, default 20000; counts are summed on Spark, only languages x buckets numbers reach
the driver). A further class `und` explains every trigram at `margin` nats below what languages give their own texts, so
it wins where no language fits. Trigrams overlap, so log-likelihoods are tempered by `temper`.

Side evidence, all from grouped aggregation over all rows: how often a declared markup language, and an address suffix,
go with each language as the text alone tells it; and host priors, smoothed hierarchically: a host's counts lean on its
parent domain's, these on the whole table's. A row's own text vote is taken out of its host's and domain's counts. The
posterior multiplies all of them. Labels (`lang` of documents) are read by the fit only, never as evidence of a row: documents declare
nothing, pages declare their markup's language.

Defined results: null or empty text has no text evidence; missing declaration, suffix or host count as a value of their
own; with no evidence at all the language is the commonest one; repeated rows and ids are judged one by one; of equal posteriors the first
language by name wins; texts and markup of any length, closed or not, are read whole in one pass; a sample without
labels gives `und` for every row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, stored, table
from .url_filter import host_of

BUCKETS = 1 << 13
HIDDEN = re.compile(r"<(script|style)\b", re.I)
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
EVIDENCE = "kind string, row_id long, declared string, suffix string, host string, domain string"


def trigrams(text: str) -> np.ndarray:
    """Bucket of each character trigram of the lower-cased text."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    if len(c) < 3:
        return np.empty(0, np.int64)
    h = (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1]) * np.uint32(0x85EBCA6B) ^ c[2:]
    return ((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 13)).astype(np.int64)


def visible(markup: str) -> str:
    """The text outside tags, scripts and styles, in one pass: each closing mark is looked for only beyond the last one found."""
    out, at, closes = [], 0, {}
    while (start := markup.find("<", at)) >= 0:
        end = -1
        if opened := HIDDEN.match(markup, start):
            name = opened[1].lower()
            found = closes.get(name, 0)
            if found is not None and (not found or found.start() < start):
                found = closes[name] = CLOSING[name].search(markup, start)
            end = found.end() if found else -1
        if end < 0:
            end = markup.find(">", start) + 1
            if not end:
                break  # no tag closes any more
        out.append(markup[at:start])
        at = end
    return " ".join([*out, markup[at:]])


def fit_text(docs: DataFrame, sample_rows: int = 20_000, smooth: float = 0.05) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probability of each bucket by language, expected log-probability of own text) from docs(doc_id, text, lang)."""
    known = docs.where("lang is not null and text is not null").select(F.col("doc_id"), "lang", "text")
    share = min(1.0, sample_rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < share * (1 << 20)) if share < 1 else known

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for part in slices(batches):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    counts = sample.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.collect()  # languages x buckets at most
    langs = sorted({r["lang"] for r in rows})
    n = np.full((len(langs), BUCKETS), smooth)
    for r in rows:
        n[langs.index(r["lang"]), r["bucket"]] += r["n"]
    p = n / n.sum(1, keepdims=True)
    return langs, np.log(p), (p * np.log(p)).sum(1)


def score_text(rows: DataFrame, langs: list[str], logp: np.ndarray, own: np.ndarray, margin: float, temper: float) -> DataFrame:
    """rows(EVIDENCE..., text) without text, plus `ll`: tempered log-likelihood of each language and, last, of und; and `vote`: its softmax, zeros without text."""
    model, floor = np.ascontiguousarray(logp.T), float(own.mean() - margin) if len(langs) else 0.0
    names = [x.split()[0] for x in EVIDENCE.split(", ")]

    def run(batches):
        for part in slices(batches):
            out = []
            for kind, text in zip(part.column("kind").to_pylist(), part.column("text").to_pylist(), strict=True):
                at = trigrams(visible(text) if kind == "page" else text) if text else np.empty(0, np.int64)
                if len(langs):
                    counts = np.bincount(at, minlength=BUCKETS) @ model if len(at) > BUCKETS else model[at].sum(0)
                else:
                    counts = np.empty(0)
                out.append(temper * np.append(counts, floor * len(at)))
            ll = np.stack(out)
            vote = softmax(ll) * ll.any(1, keepdims=True)
            arrays = [pa.array(list(x), pa.list_(pa.float64())) for x in (ll, vote)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *arrays], names=[*names, "ll", "vote"])

    return rows.select(*names, "text").mapInArrow(run, f"{EVIDENCE}, ll array<double>, vote array<double>")


def softmax(logs: np.ndarray) -> np.ndarray:
    raised = np.exp(logs - logs.max(1, keepdims=True))
    return raised / raised.sum(1, keepdims=True)


def _counts(df: DataFrame, keys: list[str], width: int, out: str) -> DataFrame:
    """Summed text votes by keys as one array column."""
    sums = [F.sum(F.element_at("vote", k + 1)).alias(f"_{k}") for k in range(width)]
    return stored(df.groupBy(*keys).agg(*sums).select(*keys, F.array(*[F.col(f"_{k}") for k in range(width)]).alias(out)), "language-counts")


def fuse(scored: DataFrame, langs: list[str], strength: float = 8.0) -> DataFrame:
    """scored plus lang, posterior and text_lang. `scored` is read several times, so pass a stored table. The counts by key are stored
    as well: Spark broadcasts them where they are small, else it can split the rows of a key that holds very many."""
    classes = [*langs, "und"]
    width = len(classes)
    voted = scored.withColumns({k: F.coalesce(k, F.lit("")) for k in ("declared", "suffix", "host", "domain")})
    total = voted.agg(*[F.sum(F.element_at("vote", k + 1)).alias(f"_{k}") for k in range(width)]).first()
    overall = np.array([(total[k] or 0.0) + 1.0 for k in range(width)])
    overall /= overall.sum()
    by_domain, by_host = _counts(voted, ["kind", "domain"], width, "nd"), _counts(voted, ["kind", "domain", "host"], width, "nh")
    by_declared, by_suffix = _counts(voted, ["kind", "declared"], width, "na"), _counts(voted, ["kind", "suffix"], width, "ns")
    joined = voted.join(by_host, ["kind", "domain", "host"]).join(by_domain, ["kind", "domain"]).join(by_declared, ["kind", "declared"]).join(by_suffix, ["kind", "suffix"])

    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            ll, vote, nd, nh, na, ns = (np.array(t.column(c).to_pylist(), float) for c in ("ll", "vote", "nd", "nh", "na", "ns"))

            def leaning(n, prior, vote=vote):
                n = np.maximum(n - vote, 0)  # without the row's own vote
                return (n + strength * prior) / (n.sum(1, keepdims=True) + strength)

            prior = leaning(nh, leaning(nd, overall))
            post = softmax(ll + np.log(prior) + np.log(leaning(na, overall) / overall) + np.log(leaning(ns, overall) / overall))
            best, text = post.argmax(1), ll.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [t.column("kind"), t.column("row_id"), pa.array([classes[k] for k in best]), pa.array(post.max(1)), pa.array([classes[k] for k in text]), t.column("declared")],
                names=["kind", "row_id", "lang", "posterior", "text_lang", "declared"],
            )

    picked = joined.select("kind", "row_id", "declared", "ll", "vote", "nd", "nh", "na", "ns")
    return picked.mapInArrow(run, "kind string, row_id long, lang string, posterior double, text_lang string, declared string")


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents declare nothing (lang is their label); their host is the source, without parent domain or suffix."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("row_id"), none.alias("declared"),
        none.alias("suffix"), F.col("source").cast("string").alias("host"), none.alias("domain"), F.col("text"),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages declare <html lang>; the suffix is the host's last label, the domain its last two."""
    host = host_of(F.col("url"))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return pages.select(
        F.lit("page").alias("kind"), F.col("page_id").cast("long").alias("row_id"), declared.alias("declared"),
        F.regexp_extract(host, "([^.:]*)(:[0-9]*)?$", 1).alias("suffix"), host.alias("host"),
        F.regexp_extract(host, "([^.]*[.][^.]*)$", 1).alias("domain"), F.col("html").alias("text"),
    )


def identify(rows: DataFrame, labelled: DataFrame, margin: float = 2.5, temper: float = 0.25, floor: float = 0.5) -> DataFrame:
    """(kind, row_id, lang, posterior, text_lang, declared, kept) of evidence rows; kept: a language, at `floor` or more."""
    langs, logp, own = fit_text(labelled)
    got = fuse(stored(score_text(rows, langs, logp, own, margin, temper), "language"), langs)
    return got.withColumn("kept", (F.col("lang") != "und") & (F.col("posterior") >= floor))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    got = identify(document_evidence(docs).unionByName(page_evidence(pages)), docs)
    one = lambda kind: F.when(F.col("kind") == kind, F.col("row_id"))
    return got.select(one("document").alias("doc_id"), one("page").alias("page_id"), "lang", F.round("posterior", 6).alias("posterior"), "text_lang", "declared", "kept")
