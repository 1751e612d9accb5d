"""Corpus operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumengrade.llm import embedding_dedup, language_id, license_scan, minhash_dedup, quality_rules, sentencepiece_codec, source_mix, token_counts, toxicity, url_filter
from lumengrade.llm._common import WORD, components, whole_groups

rng = random.Random(3)
VOCABULARY = [f"{a}{b}" for a in ("th", "er", "on", "an", "re") for b in ("", "a", "ing", "ed", "ly", "es")]


def prose(n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


LONG = prose(20_000)
ODD = [None, "", " \n\t ", "one", "one two", "  lead  and   gaps ", "a<|endoftext|>b <|endoftext|>", "日本語 🙂 é \x00 \x1c x　y", "▁a ▁▁b▁", "café don't WE'LL 123 456", "#x *y $ % & | < >", "a b c a b c a b c", "x\nx\ny\n \nx", LONG]


def documents(spark, texts, source="s1", lang="en"):
    """Documents with a column that clashes with results."""
    rows = [(i, t, lang, source, 0, True, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size int")


def words(t):
    return re.findall(WORD, t or "")


def test_quality_measures(spark):
    texts = [*ODD, *(prose(rng.randint(1, 60)) for _ in range(60))]
    got = {r.doc_id: r for r in quality_rules.quality_rules(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = words(t)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want, t
    assert got[1].fit is False or got[1].n_words == 0


def test_quality_em():
    rng = np.random.default_rng(1)
    fit, true = rng.random(20_000) < 0.7, (0.9, 0.75, 0.6)
    votes = [np.where(rng.random(20_000) < 0.3, 0, np.where(rng.random(20_000) < a, 1, -1) * np.where(fit, 1, -1)) for a in true]
    share, rates = quality_rules.fit_accuracies(sorted(Counter(zip(*(v.tolist() for v in votes))).items()))
    assert abs(share - 0.7) < 0.15 and all(abs(quality_rules.accuracy(r, share) - a) < 0.1 for r, a in zip(rates, true))
    assert quality_rules.fit_accuracies([]) == (0.9, [])


def test_quality_em_row_by_row(spark):
    """The posterior of each document against EM over documents instead of vote patterns."""
    texts = [prose(rng.randint(5, 300)) for _ in range(150)] + ["###$$$ ".join(prose(100).split(" ")) for _ in range(15)] + ["same words again " * 40] * 9
    got = {r.doc_id: r for r in quality_rules.quality_rules(documents(spark, texts)).collect()}
    names = [f"vote_{k}" for k in quality_rules.default_rules()]
    votes = np.array([[got[i][n] for n in names] for i in range(len(texts))])
    up, down = (votes == 1).astype(float), (votes == -1).astype(float)
    weight = [-np.log((v.sum(0) + 1) / (len(texts) + 3)) for v in (up, down)]
    fit = 1 / (1 + np.exp(-2 * (up @ weight[0] - down @ weight[1])))
    for _ in range(200):
        share = np.clip((fit.sum() + 2) / (len(texts) + 4), 0.05, 0.995)
        good = (fit @ up + 20) / (fit @ (up + down) + 20.2)
        bad = ((1 - fit) @ down + 2) / ((1 - fit) @ (up + down) + 4)
        odds = np.log(share / (1 - share)) + up @ np.log(good / (1 - bad)) + down @ np.log((1 - good) / bad)
        new = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        done, fit = np.abs(new - fit).max() < 1e-9, new
        if done:
            break
    assert max(abs(got[i].posterior - 1 / (1 + np.exp(-odds[i]))) for i in range(len(texts))) < 1e-6
    assert quality_rules.quality_rules(documents(spark, texts).limit(0)).count() == 0


def test_quality_verdict(spark):
    texts = [prose(rng.randint(60, 200)) for _ in range(200)] + ["###$$$ ".join(prose(100).split(" ")) for _ in range(20)]
    got = {r.doc_id: r.fit for r in quality_rules.quality_rules(documents(spark, texts)).collect()}
    assert all(got[i] for i in range(200)) and not any(got[i] for i in range(200, 220))


def test_mix_targets_and_rounding(spark):
    rows = [(i, prose(rng.randint(0, 80)), s) for i, s in enumerate(["a"] * 200 + ["b"] * 60 + [None] * 40)] + [(900, None, "a"), (901, "", "z"), (5, "again one", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mix.mix(docs, block=32, fan=4).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(size.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s], left = 2.0 * size[s], left - 2.0 * size[s]
        open_ -= full
    target |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for r in got:
        assert r.copies in (0, 1, 2) and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - target[s]) <= 80 for s in order)
    odd = [(None, "null one here", "a"), (None, "null two", "a"), (2**53 + 1, "x y z", "b"), (2**53 + 3, "x y", None), (2**53 + 5, "x", "b")] + [(7, "same row again", "b")] * 30
    strange = spark.createDataFrame(odd, "doc_id long, text string, source string")
    many = source_mix.mix(docs.unionByName(strange), block=8, fan=4, together=7).collect()
    assert sorted(str(r.doc_id) for r in many) == sorted(str(r[0]) for r in rows + odd)
    assert sorted(map(str, many)) == sorted(map(str, source_mix.mix(docs.unionByName(strange).repartition(5), block=8, fan=4, together=7).collect()))
    same = [r.copies for r in many if r.doc_id == 7 and r.size == 3]
    assert len(same) == 30 and max(same) - min(same) <= 1
    again = source_mix.mix(docs.repartition(7), block=32, fan=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert source_mix.mix(docs.limit(0)).count() == 0


def test_take(spark):
    rows = [(i, prose(rng.randint(0, 40)), "ab"[i % 2], "x", 5) for i in range(60)] + [(None, "no id", "a", "y", 6), (None, "none", "b", "y", 6), (3, "other text", "a", "z", 7)] + [(9, "same row", "a", "k", 8)] * 12
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string, rows int")
    units = source_mix.stored(source_mix.mix_units(docs, block=16, together=5), "test-units")
    got = source_mix.take(docs, units)
    assert got.columns == docs.columns
    want = Counter()
    for r in source_mix.mix(docs, block=16, together=5).collect():
        want[(r.doc_id, r.source, r.size)] += r.copies
    assert Counter((r.doc_id, r.source, len(words(r.text))) for r in got.collect()) == +want
    assert source_mix.take(docs.limit(0), units).count() == 0


def test_pivotal_keeps_expectation():
    size, frac = np.array([5.0, 3.0, 8.0, 2.0]), np.array([0.3, 0.6, 0.25, 0.5])
    runs = np.array([source_mix.pivotal(np.arange(4), size, frac, seed, 0) for seed in range(4000)])
    assert np.abs(runs.mean(0) - frac).max() < 0.03 and np.allclose(runs @ size, frac @ size) and (((runs > 0) & (runs < 1)).sum(1) <= 1).all()


def test_token_counts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.vocabulary_path())
    alphabet = "ab \n\t's▁é日🙂12.!\x1c\x85　"
    texts = [*ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(300))]
    got = {r.doc_id: r for r in token_counts.token_counts(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids) and got[i].n_bytes == len((t or "").encode()), t


def test_token_counts_of_long_words():
    import time

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.vocabulary_path())
    r = random.Random(4)
    texts = ["a" * 3001, "ab" * 900, "".join(r.choice("etaoinshrdlu") for _ in range(20_000)), "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(3000)), "=" * 777, "the" * 500, "".join(r.choice("etaoin") for _ in range(201)) + " x " + "q" * 250]
    assert token_counts.count_tokens(texts, token_counts.vocabulary_path()) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    start = time.process_time()
    for alphabet in ("etaoinshrdlu", "QWERTYUIOPASDFGHJKLZXCVBNMqwertyuiopasdfghjklzxcvbnm"):
        token_counts.count_tokens(["".join(r.choices(alphabet, k=1_000_000))], token_counts.vocabulary_path())
    assert time.process_time() - start < 20


def test_sentencepiece(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    alphabet = "ab  \n\t's▁é日🙂12.!\x1c　"
    texts = [*ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(300)), "x" * 300]
    got = {r.doc_id: r for r in sentencepiece_codec.sentencepiece_codec(documents(spark, texts), with_text=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_eos=True)
        assert got[i].ids == " ".join(map(str, ids)) and got[i].decoded == library.decode(ids) and got[i].n_tokens == len(ids), t
    digest = {r.doc_id: r for r in sentencepiece_codec.sentencepiece_codec(documents(spark, ["hi there"])).collect()}
    assert digest[0].ids == hashlib.sha256(" ".join(map(str, library.encode("hi there", add_eos=True))).encode()).hexdigest()


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1", "https://example.com/en/x?q#f", "http://a.example.com/en/", "http://x.net/es/1", "http://x.net/de/1", "http://com/x", "http://com", "http://notcom/x",
            "http://bad.org/page.html?utm_source=a", "https://www.bad.org:443/page/", "http://bad.org/other", "http://net/fr/?"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filter.filter_urls(pages, spark.createDataFrame([("http://bad.org/page",), (None,)], "url string")).collect()}
    want = {4: ("www.example.com/en/", "allow"), 5: ("example.com/en/", "block"), 6: ("example.com/en/", "block"), 7: ("net/es/", "block"), 8: (None, "allow"), 9: ("com/", "allow"), 10: (None, "allow"), 11: (None, "allow"), 12: (None, "block"), 13: (None, "block"), 14: (None, "allow"), 15: ("net/fr/", "block")}
    assert all((got[k].rule, got[k].verdict) == v for k, v in want.items()), got
    assert all((got[k].host, got[k].path, got[k].verdict) == ("", "", "allow") for k in range(4))


def test_bloom_and_exact_join(spark):
    canonical = F.concat(F.lit("h/"), F.col("id").cast("string"))
    listed = spark.range(3000).select(canonical.alias("canonical"))
    urls = spark.range(6000).select(F.col("id").alias("page_id"), F.lit("h").alias("host"), F.lit("/").alias("path"), F.when(F.col("id") < 5990, canonical).alias("canonical"))
    false = []
    for most in (1, 64, 1 << 20):
        maybe = url_filter.possible_hits(urls, url_filter.stored(listed, "test-list"), most).collect()
        assert all(r.maybe for r in maybe if r.page_id < 3000) and not any(r.maybe for r in maybe if r.canonical is None)
        false.append(sum(r.maybe for r in maybe) - 3000)
        got = url_filter.listed_hits(urls, listed, most)
        assert got.count() == 6000 and got.where("listed").count() == 3000 and got.where("listed and page_id >= 3000").count() == 0
    assert false[0] == 2990 and 0 < false[2] < 60 < false[1]  # some pass the filter, none the join
    assert url_filter.listed_hits(urls, listed.limit(0)).where("listed").count() == 0
    assert url_filter.listed_hits(urls.limit(0), listed).count() == 0


def test_reported_list(spark):
    urls = ["http://a.org/x?utm_source=f", "https://www.a.org/x.html", "http://a.org/x/", "http://a.org/y", "http://spam-farm.example.org/q", "http://b.spam-farm.example.org/q?page=2", "ftp://a.org/x#t", "http://x.net/fr/1?utm_a=1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, r.listed) for r in url_filter.filter_urls(pages, url_filter.reported(pages)).collect()}
    assert [got[k][2] for k in range(8)] == [True, True, True, False, True, True, True, True] and got[7][:2] == ("net/fr/", "block") and got[1][1] == "block"


def linked(sets, share):
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 100 * share * len(sets[a] | sets[b]):
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    return {k: root(k) for k in sets}


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(spark, shingle):
    base = [prose(rng.randint(30, 200)) for _ in range(12)]
    texts = [*ODD, *base]
    for t in base:
        for _ in range(4):
            w = t.split(" ")
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            texts.append(" ".join(w))
    texts += [base[0].upper(), base[0], "one", "ONE", "one two"]
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(documents(spark, texts), shingle=shingle).collect()}

    def shingles(t):
        w = [x.lower() if x.isascii() else x for x in words(t)]
        return {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = linked(sets, 0.8)
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i), texts[i][:60] if texts[i] else texts[i]
    assert minhash_dedup.near_duplicates(documents(spark, texts).limit(0), shingle=shingle).count() == 0


def test_near_duplicates_without_id(spark):
    a, b, c = (prose(60) for _ in range(3))
    rows = [(1, a), (2, a), (3, b), (None, a), (None, c), (None, c), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()))
    assert got == [(0, 0, True)] * 5 + [(1, 1, True), (2, 1, False), (3, 3, True)]
    assert minhash_dedup.near_duplicates(docs.where("doc_id is null")).count() == 5


def test_near_duplicates_of_repeated_ids(spark):
    a, b = prose(80), prose(80)
    near = [t + " and more" for t in (a, b)]
    docs = spark.createDataFrame([(1, a), (1, b), (2, near[0]), (3, near[1]), (4, b), (4, b), (1, a)], "doc_id long, text string").withColumn("cid", F.lit(0)).withColumn("part", F.lit("clash"))
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect())
    assert got == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (4, 1, False), (4, 1, False)]
    docs = spark.createDataFrame([(5, a), (5, b), (7, near[0]), (6, near[1])], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(docs).collect()} == {(5, 5), (7, 5), (6, 5)}


def star_of_copies(n, seed):
    """Copies of one text edited at random places: many pairs lie near the threshold, so hubs alone don't settle them."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    return [" ".join(r.choice(["x1", "y2"]) + w if r.random() < r.choice([0.01, 0.05, 0.09]) else w for w in base) for _ in range(n)]


@pytest.mark.parametrize("tile", [4, 512])
def test_mixed_buckets(spark, tile, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "TILE", tile)
    texts = [t for k in range(3) for t in star_of_copies(40, k)] + [prose(50) for _ in range(20)]
    random.Random(8).shuffle(texts)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(documents(spark, texts), shingle=2).collect()}
    sets = {i: {tuple(w) for w in zip(t.split(" "), t.split(" ")[1:])} for i, t in enumerate(texts)}
    assert got == linked(sets, 0.8)


@pytest.mark.parametrize("hubs", [False, True])
def test_units_alone_find_all(spark, hubs, monkeypatch):
    """Parts are found by the tiles even if the hub step finds nothing."""
    if not hubs:
        real = minhash_dedup.hub_pairs
        monkeypatch.setattr(minhash_dedup, "hub_pairs", lambda shared: real(shared).limit(0))
    texts = star_of_copies(60, 5)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(documents(spark, texts), shingle=2).collect()}
    assert got == linked({i: {tuple(w) for w in zip(t.split(" "), t.split(" ")[1:])} for i, t in enumerate(texts)}, 0.8)


def test_bucket_runs_over_partitions(spark):
    rows = spark.range(2000).select((F.col("id") % 7 * (F.col("id") < 1000).cast("long")).alias("key"), (F.col("id") + 5000).alias("cid"))
    rows = rows.unionByName(spark.range(50).select((F.col("id") + 9000).alias("key"), F.col("id").alias("cid")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = rows.repartitionByRange(9, "key", "cid").sortWithinPartitions("key", "cid").mapInArrow(minhash_dedup.bucket_runs, "key long, cid long, hub long, starts boolean").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    real = [r for r in got if r.key < 9000]
    assert len({r.cid for r in real}) == len(real) == 2000 and all(r.hub <= r.cid for r in real)
    assert len(got) - len(real) <= 18
    hubs = {k: {r.hub for r in real if r.key == k} for k in range(7)}
    started = {r.hub for r in real if r.starts}
    assert all(min(r.cid for r in real if r.key == k) in h and len(h - started) <= 1 for k, h in hubs.items())


def test_whole_groups():
    t = pa.table({"k": sorted(rng.randrange(30) for _ in range(500)), "j": [0] * 500})
    out = [b for n in (1, 3, 50, 1000) for b in [list(whole_groups(iter(t.to_batches(n)), ["k", "j"]))]]
    for parts in out:
        assert pa.Table.from_batches(parts).equals(t)
        keys = [set(p.column("k").to_pylist()) for p in parts]
        assert not any(a & b for a, b in itertools.combinations(keys, 2))


def test_common():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 300, r.integers(0, 200)).astype(np.uint64)) for _ in range(25)]
    got = minhash_dedup.common(sets, 10, block=16)
    assert [[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:10]] == got.tolist()


def test_bands_find_the_threshold():
    r = np.random.default_rng(6)
    bands = minhash_dedup.banding(250_000, 0.8)
    assert minhash_dedup.missed(len(bands), len(bands[0]), 0.8) <= 1e-5
    equal = r.random((100_000, minhash_dedup.REGISTERS)) < 0.72
    share = 1 - np.any([equal[:, b].all(1) for b in bands], axis=0).mean()
    assert abs(share - minhash_dedup.missed(len(bands), len(bands[0]), 0.72)) < 2e-3


def test_sketch_estimate_and_merge():
    r = np.random.default_rng(2)
    x = r.integers(0, 1 << 62, 3000, dtype=np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[1000:])
    sa, sb = minhash_dedup.sketch(a, 4096), minhash_dedup.sketch(b, 4096)
    assert abs(minhash_dedup.estimate(sa[None], sb[None], np.array([2000.0]), np.array([2000.0]))[0] - 1 / 3) < 0.04
    assert (np.maximum(sa, sb) == minhash_dedup.sketch(np.unique(x), 4096)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[200] == got[150] == got[100] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", 60)  # hubs spread over many tasks
    try:
        r = random.Random(1)
        hubs = [(r.randrange(3), k) for k in range(10, 300)] + [(1000 - k, 5) for k in range(300)] + [(5, 2)]
        got = {r.id: r.component_id for r in components(spark.createDataFrame(hubs, "a long, b long"), max_rounds=8).collect()}
        assert all(got[k] == got[5] == 2 for k in range(701, 1001)) and set(got.values()) == {0, 1, 2}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def brute_links(data):
    """(links, smallest id reachable) of each row by position."""
    unit = [embedding_dedup.unit_vector(v) for _, v in data]
    at = [k for k, u in enumerate(unit) if u is not None]
    near = {k: [j for j in at if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= 0.9] if unit[k] is not None else [] for k in range(len(data))}
    out = []
    for k in near:
        seen, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j), todo.append(j)
        out.append((data[k][0], len(near[k]), min(data[j][0] for j in seen)))
    return sorted(out)


@pytest.mark.parametrize("tile, most", [(1024, 8192), (8, 8192), (8, 4)])
def test_embeddings(spark, tile, most, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup.bucket_members, "__defaults__", (most,))
    r = np.random.default_rng(4)
    rows = [r.standard_normal(16) for _ in range(120)]
    rows += [rows[k % 10] + 0.1 * r.standard_normal(16) for k in range(60)] + [rows[0] * 2, rows[0], rows[0]]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] * 16), (504, [1.0, 2.0]), (505, [])]
    data += [(7, data[3][1]), (7, [1.0] * 16), (600, [1.01] + [1.0] * 15), (601, [2.0, 4.0]), (602, [1.0, 2.1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("n_links", F.lit(0)).withColumn("cid", F.lit(1))
    got = embedding_dedup.near_vectors(df).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in got) == brute_links(data)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0
    lost = embedding_dedup.near_vectors(spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.01]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((x.vec_id or 0, x.n_links, x.kept) for x in lost) == [(0, 1, True), (0, 1, True), (3, 0, True)]


def test_embeddings_of_repeated_ids(spark):
    data = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [0.1, 1.0, 0.0]), (3, [0.1, 1.0, 0.0])]
    got = embedding_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in got) == brute_links(data)


def test_embeddings_at_threshold(spark):
    r = np.random.default_rng(9)
    data = []
    for i in range(600):
        a, b = np.linalg.qr(r.standard_normal((64, 2)))[0].T
        data += [(2 * i, a.tolist()), (2 * i + 1, (0.9005 * a + np.sqrt(1 - 0.9005**2) * b).tolist())]
    got = {x.vec_id: x for x in embedding_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    unit = np.stack([embedding_dedup.unit_vector(v) for _, v in data])
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert sum(got[i].n_links == links[i] for i in range(1200)) >= 1194
    for classes in (300, 50_000, 5_000_000):
        projections, tables = embedding_dedup.sizing(classes, 0.9)
        assert (1 - embedding_dedup.agreement(0.9, embedding_dedup.WIDTH) ** projections) ** tables <= 1e-3


def test_language(spark):
    texts = {"en": "the cat and the dog are in the house with this thing", "de": "der Hund und die Katze sind nicht in dem Haus für das", "fr": "le chat et le chien ne sont pas dans la maison pour une"}
    rows = [(i, " ".join(rng.sample(t.split(), 8)), lang, f"h{i % 4}") for i, (lang, t) in enumerate(list(texts.items()) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    odd = spark.createDataFrame([(900, None, None, None), (901, "", "en", "h1"), (902, "qzx#kj@@1!9%%zzq" * 40, None, None), (903, LONG, "en", "h0")], docs.schema)
    got = {r.row_id: r for r in language_id.identify(language_id.document_evidence(docs.unionByName(odd)), docs).collect()}
    assert sum(got[i].lang == lang for i, _, lang, _ in rows) >= 0.98 * len(rows) and all(got[i].kept for i, *_ in rows)
    assert got[902].lang == "und" and not got[902].kept and len(got) == len(rows) + 4
    pages = spark.createDataFrame([(1, "http://a.b.de/x", "<html lang='de'><script>the the</script><p>Hund und Katze sind nicht"), (2, None, None)], "page_id long, url string, html string")
    assert {r.row_id: r.lang for r in language_id.identify(language_id.page_evidence(pages), docs).collect()}[1] == "de"


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fit = docs.where("lang is not null and doc_id % 2 = 0")
    got = language_id.identify(language_id.document_evidence(docs.where("doc_id % 2 = 1")), fit).alias("g").join(docs.alias("d"), F.expr("g.row_id = d.doc_id and d.lang is not null"))
    n, right = got.agg(F.count("*"), F.sum((F.col("g.lang") == F.col("d.lang")).cast("int"))).first()
    assert n > 300 and right >= 0.97 * n


def test_language_of_page_brute_force(spark):
    """Posterior of each row by hand from text likelihoods and counts."""
    rows = [(i, f"http://h{i % 3}.x.{'de' if i % 2 else 'org'}/p", f"<html lang='{'de' if i % 4 else 'en'}'><p>{'der Hund und die Katze' if i % 2 else 'the cat and the dog'} {i}") for i in range(40)] + [(7, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("vote", F.lit(1))
    docs = spark.createDataFrame([(1, "der Hund und die Katze sind da", "de"), (2, "the cat and the dog are there", "en")], "doc_id long, text string, lang string")
    langs, logp, own = language_id.fit_text(docs)
    evidence = language_id.page_evidence(pages)
    scored = language_id.score_text(evidence, langs, logp, own, 2.5, 0.25).collect()
    got = sorted((r.row_id, r.lang, round(r.posterior, 6)) for r in language_id.identify(evidence, docs).collect())
    vote = [np.array(r.vote) for r in scored]
    overall = sum(vote) + 1
    overall = overall / overall.sum()

    def lean(n, prior):
        return (np.maximum(n, 0) + 8 * prior) / (np.maximum(n, 0).sum() + 8)

    want = []
    for k, r in enumerate(scored):
        def total(*keys, r=r):
            return sum(v for v, s in zip(vote, scored) if all((s[c] or "") == (r[c] or "") for c in keys))
        prior = lean(total("domain", "host") - vote[k], lean(total("domain") - vote[k], overall))
        log = np.array(r.ll) + np.log(prior) + np.log(lean(total("declared") - vote[k], overall) / overall) + np.log(lean(total("suffix") - vote[k], overall) / overall)
        p = np.exp(log - log.max())
        want.append((r.row_id, [*langs, "und"][int(p.argmax())], round(float((p / p.sum()).max()), 6)))
    assert len(got) == len(want) and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, sorted(want)))
    assert language_id.identify(evidence.limit(0), docs).count() == 0
    assert {r.lang for r in language_id.identify(evidence, docs.where("lang is null")).collect()} == {"und"}


def test_visible_text():
    import time

    junk = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice(["<", ">", "<script", "</script>", "</SCRIPT >", "<style>", "</style", "a", " ", "</", "<scripty>", "İ"]) for _ in range(r.randint(0, 14)))
        assert language_id.visible(t) == junk.sub(" ", t), t
    start = time.process_time()
    for t in ("<script" * 150_000, "<" * 1_000_000, "<script></style>" * 60_000, "<style>x</style>" * 60_000, "</script" + " " * 1_000_000):
        language_id.visible(t)
    assert time.process_time() - start < 10


def test_licenses(spark):
    apache = license_scan.TEMPLATES["Apache-2.0-notice"]
    edited = apache.replace("You may obtain", "Anyone may get").replace("express", "clear")
    texts = [*ODD, f"{prose(30)}\nReleased under the MIT license\n{prose(10)}", f"{prose(500)} {edited} {prose(40)}", prose(60), " ".join(apache.split()[:12]), "Licensed under CC BY-NC 4.0. " * 3]
    got = license_scan.license_scan(documents(spark, texts)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    n = len(ODD)
    assert set(by) == {n, n + 1, n + 3, n + 4} and [r.license for r in by[n]] == ["MIT"] and len(by[n + 4]) == 3
    r = by[n + 1][0]
    assert r.license == "Apache-2.0-notice" and 0.9 < r.coverage < 1 and texts[n + 1][r.first_char : r.end_char] == edited.strip()
    assert [r.license for r in by[n + 3]] == ["Apache-2.0"]


def test_edited_short_licenses(spark):
    short = {n: t.split() for n, t in license_scan.TEMPLATES.items() if len(t.split()) < 20}
    edits = [(n, w[:i] + new + w[i + skip :]) for n, w in short.items() for i in range(len(w)) for new, skip in ((["zzq"], 1), ([], 1), (["zzq"], 0))]
    texts = [" ".join(["qqa"] * 12 + e + ["qqb"] * 12) for _, e in edits]
    got = {(r.doc_id, r.license) for r in license_scan.license_scan(documents(spark, texts)).collect()}
    assert "MIT" in short and "CC-BY-NC-4.0" in short
    assert not [(n, " ".join(e)) for i, (n, e) in enumerate(edits) if (i, n) not in got]
    for n in range(1, 400):
        k, window = license_scan.runs(n)
        allowed = n - -(-4 * n // 5)
        assert -(-(n - allowed) // (allowed + 1)) >= k + window - 1 and k >= 1


def best_alignment(template, words):
    """Score and matched words of the best alignment of the whole template anywhere in words, by plain dynamic programming."""
    above = [(0, 0)] * (len(words) + 1)
    for want in template:
        row = [max([(above[0][0] - 1, above[0][1])])]
        for j, w in enumerate(words, 1):
            hit = w == want
            row.append(max((above[j - 1][0] + (1 if hit else -1), above[j - 1][1] + hit), (above[j][0] - 1, above[j][1]), (row[-1][0] - 1, row[-1][1])))
        above = row
    return max(above)


def test_licenses_brute_force():
    r = random.Random(12)
    templates = {"short": "alpha beta gamma delta epsilon zeta", "long": " ".join(f"t{k}" for k in range(40))}
    index = license_scan.Index(templates)
    words_of = minhash_dedup._WordHash()
    tried = hits = 0
    for _ in range(300):
        name = r.choice(["short", "long"])
        w = templates[name].split()
        for _ in range(r.randint(0, len(w) // 3)):
            k = r.randrange(len(w))
            w[k : k + r.choice([0, 1, 1])] = r.choice([["zz"], [], ["qq", w[k]]])
            w = w or ["zz"]
        text = [r.choice("abcdefg") for _ in range(r.randint(0, 30))] + w + [r.choice("abcdefg") for _ in range(r.randint(0, 30))]
        code = np.fromiter((words_of[x.encode()] for x in text), np.uint64, len(text))
        got = license_scan.scan([code, code[:0]], index)
        assert got[1] == [] and all(g[0] == name for g in got[0])
        score, matched = best_alignment(templates[name].split(), text)
        need = 0.8 * len(templates[name].split())
        if matched >= need:
            tried += 1
            hits += bool(got[0])
            assert not got[0] or got[0][0][1] == matched, (text, got, matched)
        else:
            assert not got[0]
    assert tried > 60 and hits >= 0.97 * tried  # more edits than coverage leaves may leave no shared run


def test_full_licenses(spark):
    full = {n: t for n, t in license_scan.TEMPLATES.items() if n.endswith("-full")}
    texts = [f"{prose(40)}\n{t}\n{prose(30)}" for t in full.values()] + [f"{prose(9)} {t.replace('software', 'program')} {prose(9)}" for t in full.values()]
    got = license_scan.license_scan(documents(spark, texts)).collect()
    assert sorted((r.doc_id, r.license) for r in got if r.doc_id < len(full)) == list(enumerate(full))
    assert all(r.coverage == 1 and texts[r.doc_id][r.first_char : r.end_char] == full[r.license] for r in got if r.doc_id < len(full))
    assert {(r.doc_id - len(full), r.license) for r in got if r.doc_id >= len(full)} >= set(enumerate(full))
    assert license_scan.license_scan(documents(spark, texts).limit(0)).count() == 0


def test_licenses_of_long_texts():
    import time

    index, words_of = license_scan.Index(license_scan.TEMPLATES), minhash_dedup._WordHash()
    start = time.process_time()
    for unit in ("Released under the MIT License. ", license_scan.TEMPLATES["MIT-full"] + " ", "licensed under the ", "of the software "):
        words = license_scan.plain_words(unit * (1_000_000 // len(unit)))
        got = license_scan.scan([np.fromiter(map(words_of.__getitem__, words), np.uint64, len(words))], index)[0]
        if "MIT" in unit:
            assert len(got) == 1_000_000 // len(unit) and {g[0] for g in got} <= {"MIT", "MIT-full"}
        assert time.process_time() - start < 40
        start = time.process_time()


def brute_marginals(chain, emit):
    tags = list(itertools.product((0, 1), repeat=len(emit)))
    score = np.array([sum(e for e, t in zip(emit, y) if t) + sum(chain.trans[a, b] for a, b in zip(y, y[1:])) for y in tags])
    p = np.exp(score - score.max())
    p /= p.sum()
    return [sum(q for q, y in zip(p, tags) if y[k]) for k in range(len(emit))], np.log(p[0])


def test_chain_marginals():
    r = np.random.default_rng(5)
    chain = toxicity.Chain(np.zeros(1), r.standard_normal((2, 2)), ())
    parts = [r.standard_normal(n) for n in (1, 4, 7, 3, 2, 8)]
    prob, clean, _, _ = chain.marginals(np.concatenate(parts), np.array([len(p) for p in parts]))
    at = 0
    for k, p in enumerate(parts):
        want, none = brute_marginals(chain, p)
        assert np.allclose(prob[at : at + len(p)], want) and abs(clean[k] - none) < 1e-9
        at += len(p)


def test_toxicity(spark):
    bad = ["idiot", "moron", "scum"]
    rows, labels = [], []
    for i in range(600):
        w = prose(rng.randint(20, 60)).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, LONG), (903, f"{LONG} idiot. scum"), (904, "plain.\nMoron, really")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    import zlib

    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i]._score >= 0.5) == bool(t) for i, t in held) >= 0.97 * len(held)
    assert len(got) == len(rows) and got[900]._score == got[901]._score < 0.5 and got[902]._score < 0.5 <= got[904]._score
    spans = [rows[-1][1][s.start : s.end] for s in got[904]._spans]
    assert spans == ["Moron,"] and got[903]._spans[0].start >= len(LONG)
    none = toxicity.toxicity(docs, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))
    assert {r._score for r in none.collect()} == {0.0}


def test_empty_tables(spark):
    docs = documents(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for got in (token_counts.token_counts(docs), sentencepiece_codec.sentencepiece_codec(docs), toxicity.toxicity(docs, labels), license_scan.license_scan(docs), minhash_dedup.near_duplicates(docs), source_mix.mix(docs), quality_rules.quality_rules(docs)):
        assert got.count() == 0


def test_long_single_sentence(spark):
    """A sentence of very many words and a very long word."""
    rows = [(1, "word " * 200_000), (2, "x" * 1_000_000), (3, "idiot " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = toxicity.Chain(np.zeros(toxicity.MASK + 3, np.float32), np.zeros((2, 2)), (-1.0, 1.0, 1.0))
    got = {r.doc_id: r._score for r in toxicity.score_documents(docs, chain, with_spans=False).collect()}
    assert len(got) == 3 and all(0 <= s <= 1 for s in got.values())
