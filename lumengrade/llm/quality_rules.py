"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates their accuracies.

Every document is measured once (Arrow batches, whole texts); each rule turns the measures into a vote of +1 (fit),
-1 (unfit) or 0 (abstains). The votes of all documents are counted by vote pattern on Spark, at most 3**rules rows
whatever the corpus size, and EM over that table estimates the share of fit documents and each rule's accuracy: how often,
when it votes, it is right about documents of either kind (abstaining says nothing). With rules independent given the kind,
the posterior log-odds are a sum of one term per vote, so the final score is one native column expression and needs no join.

Defined results: null text counts as empty (all measures 0); empty text fails the base rule; repeated rows are judged
one by one; further columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, stored, table

SYMBOLS = b"#*$%&|<>"
SYMBOL_RUN = re.compile(b"[#*$%&|<>]+")
BLANKS = b" \t\n\x0b\x0c\r"


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    pairs = code[:-1] * len(ids) + code[1:]
    if len(ids) > 2_000_000:  # keep the window code within 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    _, at, n = np.unique(pairs[:-1] * len(ids) + code[2:], return_inverse=True, return_counts=True)
    hit = n[at] > 1
    cover = np.zeros(len(words), bool)
    for k in range(3):
        cover[k : len(words) - 2 + k] |= hit
    return int(cover.sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one text; a symbol run is one or more symbols next to each other."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    alpha = sum(1 for w in words if w[:1].isalpha() or w[0] > 127 or any(c > 64 for c in w))
    symbols = sum(raw.count(x) for x in SYMBOLS)
    return (
        len(words),
        len(text) - sum(raw.count(x) for x in BLANKS),
        symbols,
        len(SYMBOL_RUN.findall(raw)) if symbols else 0,
        len(lines),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        alpha,
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_symbol_runs", "n_lines", "n_dup_lines", "n_repeat_words", "n_alpha_words")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measures...) of every row."""
    fields = [pa.field("doc_id", pa.int64()), *(pa.field(m, pa.int64()) for m in MEASURES)]

    def run(batches):
        for part in slices(batches):
            rows = [measure_text(t) for t in part.column("text").to_pylist()]
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], schema=pa.schema(fields))

    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return got.mapInArrow(run, ", ".join(f"{f.name} long" for f in fields))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def default_rules() -> dict[str, Callable[[], Column]]:
    """Votes by rule name; each may abstain (0) where its measure says little."""
    n = F.col("n_words")
    c = F.col
    return {
        "length": lambda: _vote(n >= 80, n < 20),
        "word_length": lambda: _vote((n > 0) & c("word_chars").between(3 * n, 9 * n), (n == 0) | (c("word_chars") > 14 * n) | (c("word_chars") < 2 * n)),
        "symbols": lambda: _vote(50 * c("n_symbols") <= n, 5 * c("n_symbols") > n),
        "symbol_runs": lambda: _vote(50 * c("n_symbol_runs") <= n, 5 * c("n_symbol_runs") > n),
        "dup_lines": lambda: _vote(10 * c("n_dup_lines") <= c("n_lines"), 2 * c("n_dup_lines") > c("n_lines")),
        "repeats": lambda: _vote(10 * c("n_repeat_words") <= n, 2 * c("n_repeat_words") > n),
        "alphabetic": lambda: _vote(10 * c("n_alpha_words") >= 8 * n, 10 * c("n_alpha_words") < 6 * n),
    }


def fit_accuracies(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, prior: float = 2.0, trust: tuple[float, float] = (10.0, 0.1)) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM over (votes, count): the share of fit documents and, by rule, each vote's probability for (fit, unfit) documents, given
    that the rule votes.

    The start leans on rare votes, which say more than common ones. Counts are smoothed by `prior` votes each way for unfit
    documents and, for fit ones, by `trust` times as many for and against the rule: a rule that rejects is taken to seldom reject fit
    documents. The share stays in [0.05, 0.995].
    """
    width = len(patterns[0][0]) if patterns else 0
    if not patterns:
        return 0.9, []
    votes = np.array([p for p, _ in patterns]).reshape(len(patterns), width)
    count = np.array([c for _, c in patterns], float)
    said = {v: votes == v for v in (-1, 0, 1)}
    rare = {v: -np.log(((said[v] * count[:, None]).sum(0) + 1) / (count.sum() + 3)) for v in (-1, 1)}
    fit = 1 / (1 + np.exp(-2 * (said[1] @ np.diag(rare[1]) - said[-1] @ np.diag(rare[-1])).sum(1)))
    for _ in range(rounds):
        share = float(np.clip((fit @ count + prior) / (count.sum() + 2 * prior), 0.05, 0.995))
        cast = {v: [(said[v] * (w * count)[:, None]).sum(0) for w in (fit, 1 - fit)] for v in (-1, 1)}
        good = (cast[1][0] + trust[0] * prior) / (cast[1][0] + cast[-1][0] + sum(trust) * prior)
        bad = (cast[-1][1] + prior) / (cast[1][1] + cast[-1][1] + 2 * prior)
        rates = {1: (good, 1 - bad), -1: (1 - good, bad)}
        odds = math.log(share / (1 - share)) + sum((said[v] * np.log(rates[v][0] / rates[v][1])).sum(1) for v in (-1, 1))
        new = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        if np.abs(new - fit).max() < 1e-9:
            break
        fit = new
    return share, [{v: (float(rates[v][0][j]), float(rates[v][1][j])) for v in (-1, 1)} for j in range(width)]


def accuracy(rates: dict[int, tuple[float, float]], share: float) -> float:
    """How often a rule that votes is right."""
    right, wrong = share * rates[1][0] + (1 - share) * rates[-1][1], share * rates[-1][0] + (1 - share) * rates[1][1]
    return right / (right + wrong)


def judge(measured: DataFrame, rules: dict[str, Callable[[], Column]] | None = None, threshold: float = 0.5) -> DataFrame:
    """measured plus vote_<rule> columns, `posterior` (probability that the document is fit) and `fit`.

    `measured` is read twice (once to count vote patterns), so pass a stored table.
    """
    rules = rules or default_rules()
    voted = measured.withColumns({f"vote_{k}": rule() for k, rule in rules.items()})
    names = [f"vote_{k}" for k in rules]
    counted = voted.groupBy(*names).count().collect()  # at most 3 ** len(rules) rows
    share, rates = fit_accuracies(sorted((tuple(r[n] for n in names), r["count"]) for r in counted))
    odds = F.lit(math.log(share / (1 - share)))
    for n, r in zip(names, rates):
        term = {v: F.lit(math.log(p / q)) for v, (p, q) in r.items()}
        odds = odds + F.when(F.col(n) == 1, term[1]).when(F.col(n) == -1, term[-1]).otherwise(0.0)
    return voted.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("fit", F.col("posterior") >= threshold)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Measures, votes, posterior and fit of every row of docs(doc_id, text)."""
    return judge(stored(measures(docs), "quality"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return got.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("fit")).alias("kept"), F.round("posterior", 6).alias("posterior"),
    )
