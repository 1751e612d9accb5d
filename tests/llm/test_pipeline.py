"""The pipeline's stages one by one on a small folder of tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from lumengrade.llm import registry, source_mix

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "minhash_dedup", "source_mix", "sentencepiece_codec"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, docs, SF), f"test-{name}")
        assert out.columns == columns
        if name != "source_mix":
            assert out.count() <= before and out.select("doc_id").distinct().count() == out.count()
        docs, before = out, out.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == before and set(last.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_near_stage_leaves_no_pair(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.stored(corpus_pipeline.drop_copies(spark, docs, SF), "test-near")
    words = F.split(F.lower("text"), r"\s+")
    shingles = F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.array_join(F.slice("w", i + 1, 5), " "))
    sets = {r.doc_id: set(r.s) for r in kept.withColumn("w", words).where(F.size("w") >= 5).select("doc_id", shingles.alias("s")).collect()}
    ids = sorted(sets)
    assert not [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.82 * len(sets[a] | sets[b])]


def test_near_stage_keeps_rows_without_id(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (2, text), (None, text), (None, "a text that no row with an id has in common with it")], "doc_id long, text string")
    kept = corpus_pipeline.drop_copies(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted((r.doc_id or 0, r.text) for r in docs.where("doc_id is null or doc_id = 1").collect())


def test_near_stage_of_repeated_rows(spark):
    a, b = "one two three four five six seven eight nine ten", "a text of its own that no other row has in common with it"
    docs = spark.createDataFrame([(1, a, 5), (1, a, 5), (1, b, 6), (2, a.upper(), 7), (3, b, 8)], "doc_id long, text string, rows int")
    kept = corpus_pipeline.drop_copies(spark, docs, SF)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text, r.rows) for r in kept.collect()) == sorted([(1, a, 5), (1, b, 6)])


def test_near_stage_judges_each_text_of_an_id(spark):
    a, b = "one two three four five six seven eight nine ten", "a text of its own that no other row has in common with it at all or ever"
    docs = spark.createDataFrame([(0, f"{b} and more"), (1, a), (1, b)], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.drop_copies(spark, docs, SF).collect())) == [(0, f"{b} and more"), (1, a)]
    empty = spark.createDataFrame([(5, None), (5, ""), (6, " "), (7, None), (None, None)], docs.schema)
    assert corpus_pipeline.drop_copies(spark, docs.unionByName(empty), SF).count() == 7


def test_language_stage_judges_each_row_of_an_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = sorted(r.doc_id for r in corpus_pipeline.drop_foreign(spark, docs, SF).select("doc_id").collect())
    junk = docs.where(F.col("doc_id") == before[0]).withColumns({"text": F.lit("#%& 0x9f {}[] ;;; 7734 @@@ ~~~ 0b11 ^^^ || qzx vvk jjq xxz " * 20), "lang": F.lit(None).cast("string")})
    rows = corpus_pipeline.stored(docs.unionByName(junk).unionByName(junk.withColumn("doc_id", F.lit(None).cast("long"))), "test-foreign")
    kept = corpus_pipeline.drop_foreign(spark, rows, SF)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == before and kept.where("text like '%qzx%'").isEmpty()


def test_mix_stage_keeps_other_columns(spark):
    rows = [(7, "same words in both rows", lang, "a") for lang in ("en", "de")] * 3 + [(100 + k, f"row {k} " * 9, "en", "ab"[k % 2]) for k in range(20)]
    docs = corpus_pipeline.stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "test-langs")
    units = corpus_pipeline.stored(source_mix.mix_units(docs), "test-units")
    want = {(r.k1, r.k2): r.c for r in units.groupBy("k1", "k2").agg(F.sum(F.col("rows") * F.col("base") + F.col("extra")).alias("c")).collect()}
    got = source_mix.take(docs, units).where("doc_id = 7")
    for lang in ("en", "de"):
        key = docs.where(f"doc_id = 7 and lang = '{lang}'").select(*source_mix.row_keys(docs)).first()
        assert got.where(f"lang = '{lang}'").count() == want[key.k1, key.k2]


def test_stages_on_odd_tables(spark):
    """Empty tables, null columns and columns named as the stages name theirs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    clash = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(["_score", "_spans", "row", "rows", "copies", "cid", "part", "row_id", "k1", "source_size", "kept"])])
    odd = clash.withColumn("text", F.when(F.col("doc_id") % 5 != 0, F.col("text"))).withColumn("source", F.when(F.col("doc_id") % 3 != 0, F.col("source"))).withColumn("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")))
    odd = corpus_pipeline.stored(odd, "test-odd")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd.limit(0), SF).count() == 0
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and out.count() <= 2 * odd.count()
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() == odd.count()
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), SF).count() == 0


def test_every_operator_is_registered():
    names = registry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
