"""Bucketed tables, CSV reports, numbering in two levels, grid pairs, rule tables, many terms: results and plans."""

import random

import pytest
from pyspark.sql import functions as F

from lumengrade.functions import short_answer
from lumengrade.operators import grading, linking, regions, reports
from lumengrade.plans.source_queries import bucket_totals
from lumengrade.sources.sinks import bucketed, read_report, write_report


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_join_and_group_without_exchange(spark):
    results = spark.range(200).select(F.col("id").alias("student_result_id"), (F.col("id") % 3).alias("batch_id"))
    scores = spark.range(900).select((F.col("id") % 250).alias("student_result_id"), F.lit(0.5).alias("ai_score"), F.lit(None).cast("double").alias("final_score"), (F.col("id") % 7 == 0).alias("requires_manual_review"))
    want = sorted(map(tuple, bucket_totals(results, scores).collect()))
    laid = bucket_totals(bucketed(results, "student_result_id", 4, "batch_id"), bucketed(scores, "student_result_id", 4))
    assert "Exchange" not in plan(laid) and "Exchange" in plan(bucket_totals(results, scores))
    assert sorted(map(tuple, laid.collect())) == want


def test_report_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nover lines', 0.25, ["x", "y"]), (2, "", None, []), (3, None, 1.0, None), (4, " blanks ", 0.0, ["only"]), (5, "back\\slash;é", -1.5, ["a;b"])]
    write_report(spark.createDataFrame(rows, "id int, said string, score double, notes array<string>"), f"{tmp_path}/r")
    got = sorted(map(tuple, read_report(spark, f"{tmp_path}/r", "id int, said string, score double, notes string").collect()))
    assert [(r[0], r[2]) for r in got] == [(r[0], r[2]) for r in rows]
    assert [r[1] or "" for r in got] == [r[1] or "" for r in rows] and [r[3] or "" for r in got] == ["x; y", "", "", "only", "a;b"]
    text = "".join(open(f, newline="").read() for f in map(str, tmp_path.glob("r/*.csv")))
    assert "id,said,score,notes\n" in text


def test_numbers_in_two_levels(spark):
    rows = [(k % 3 if k % 2 else 0, f"r{k % 40:02}", k) for k in range(300)]
    random.Random(1).shuffle(rows)
    got = linking.numbered(spark.createDataFrame(rows, "exam_id int, registration_number string, student_id int").repartition(5), ["exam_id"], ["registration_number", "student_id"], "n")
    want = [(*r, n) for e in range(3) for n, r in enumerate(sorted(x for x in rows if x[0] == e))]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    text = plan(got)
    assert "hashpartitioning(exam_id" in text and "_part" in text and "SinglePartition" not in text
    assert linking.numbered(spark.createDataFrame([], "e int, s int"), ["e"], ["s"], "n").count() == 0


def test_grid_pairs(spark):
    rng = random.Random(2)
    boxes = [(p, f"{p}/{k}", rng.randrange(0, 2000), rng.randrange(0, 3000), rng.choice([0, 20, 90, 400]), rng.choice([10, 60, 300])) for p in range(3) for k in range(120)]
    boxes += [(9, str(k), 1000, 100 * k, 200, 90) for k in range(60)] + [(8, "same", 5, 5, 10, 10), (8, "same", 5, 5, 10, 10), (8, "same", 5, 5, 10, 12), (8, "other", 5, 5, 10, 10), (8, "neg", -300, -40, 500, 100), (8, "neg2", -300, -40, 500, 99)]
    df = spark.createDataFrame(boxes, "page_id int, region_id string, x int, y int, w int, h int")

    def over(a, b):
        both = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])) * max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
        least = min(a[4] * a[5], b[4] * b[5])
        return least > 0 and both > 0.65 * least

    place = lambda b: (b[3], b[2], b[1])
    want = sorted((a[0], a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and place(a) < place(b) and over(a, b))
    for cell in ((256, 128), (50, 2000)):
        assert sorted(map(tuple, regions.overlapping_pairs(df, cell=cell).collect())) == want != []
    with pytest.raises(ValueError):
        regions.overlapping_pairs(df, 0.3)


def test_rules_from_a_table(spark):
    texts = spark.createDataFrame([("M.Sóleo E.",), ("grande dorsal d",), ("aa. e vv. femorais esq.",), (None,), ("",)], "t string")
    rules = spark.createDataFrame(short_answer.normal_rules(), "step int, pattern string, word string")
    fixed, told = (texts.select(c.alias("f")).collect() for c in (short_answer.normal_form(F.col("t")), short_answer.normal_form_by(F.col("t"), rules)))
    assert fixed == told
    more = rules.unionByName(spark.createDataFrame([(1000, r"\bsoleo\b", "solear")], rules.schema))
    assert texts.select(short_answer.normal_form_by(F.col("t"), more).alias("f")).first().f == fixed[0].f.replace("soleo", "solear")
    assert texts.select(short_answer.normal_form_by(F.col("t"), rules.limit(0)).alias("f")).first().f == "m.soleo e."
    with pytest.raises(ValueError):
        short_answer.normal_form_by(F.col("t"), rules, most=3)


def test_many_terms_as_few(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 4)))
    answers = [(k, k % 5 if k % 9 else None, " ".join(word().upper() if rng.random() < 0.2 else word() for _ in range(rng.randint(0, 6))) if k % 7 else None, 0.5) for k in range(200)]
    terms = [(k % 4, word() + word()) for k in range(1500)] + [(2, ""), (None, "a"), (1, None)]
    df = spark.createDataFrame(answers, "id int, question_number int, rubric_text string, score double")
    table = spark.createDataFrame(terms, "question_number int, term string")
    lists = table.where("question_number is not null and term is not null").groupBy("question_number").agg(F.collect_list("term").alias("terms"))
    want = sorted(map(str, grading.semantic_guard(df, lists).collect()))
    assert sorted(map(str, grading.guard_by_terms(df, table).collect())) == want
    assert grading.guard_by_terms(df, table.limit(0)).where("possible_rubric_swap").isEmpty()
    with pytest.raises(ValueError):
        grading.guard_by_terms(df, table, most=10)


def test_errors_of_a_run_are_bounded(spark):
    pages = spark.range(500).select(F.lit("r").alias("run_id"), F.col("id").cast("int").alias("page_number"), F.lit("m").alias("vision_model"), F.lit(False).alias("fallback_used"), F.concat(F.lit("e"), "id").alias("error"))
    answers = spark.createDataFrame([("r", 1, 1, "t")], "run_id string, page_number int, question_number int, text_model string")
    got = reports.run_summary(pages, answers).first()
    assert (got.errors, got.error, got.status) == (500, " | ".join(f"e{k}" for k in range(20)), "FAILED")
