"""What the third review found: ties of regions, whole error lists of runs, work done once."""

import os

from pyspark.sql import functions as F

from lumengrade.operators import regions, reports
from lumengrade.plans import registry, source_queries
from lumengrade.sources.batch_table import BatchTable


def test_tied_regions_in_any_order(spark):
    boxes = [(1, "a", 0, 0, 100, 40), (1, "a", 0, 0, 40, 100), (1, "a", 0, 0, 100, 100), (1, "b", None, 0, 9, 9), (1, "b", None, 0, 9, 9)]
    got = []
    for rows in (boxes, boxes[::-1]):
        df = spark.createDataFrame(rows, "page_id long, region_id string, x int, y int, w int, h int").coalesce(1)
        got.append([tuple(r) for r in regions.suppress_regions(df).collect()])
    assert got[0] == got[1] == [(1, "a", 0, 0, 40, 100), (1, "a", 0, 0, 100, 40), boxes[3], boxes[4]]


def test_all_errors_of_a_run(spark):
    pages = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "r").otherwise("s").alias("run_id"), F.col("id").cast("int").alias("page_number"), F.lit("m").alias("vision_model"), F.lit(False).alias("fallback_used"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("e"), "id")).otherwise("").alias("error"))
    answers = spark.createDataFrame([("r", 1, 1, "t")], "run_id string, page_number int, question_number int, text_model string")
    got = {r.run_id: r for r in reports.run_summary(pages.repartition(7), answers, most=None).collect()}
    for run, of in (("r", range(0, 3000, 3)), ("s", [k for k in range(3000) if k % 3])):
        said = [f"e{k}" for k in of if k % 5]
        assert (got[run].errors, got[run].error, got[run].status) == (len(said), " | ".join(said), "FAILED")


def plan(spark, name):
    return registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_values_of_a_grade_are_read_once(spark):
    text = plan(spark, "f3_single_grade")
    assert text.count("trim(") + text.count("regexp_replace(") <= 6


def test_outputs_are_read_once_each(spark):
    assert "from_json" not in plan(spark, "f22_discursive_grades")  # rows meet grades of distinct outputs, written before


def test_short_answers_are_graded_once_each(spark):
    for name in ("f17_short_answers", "f17_rules_by_distance"):
        assert "regexp_replace" not in plan(spark, name)


def test_request_forms_are_worked_out_once_each(spark):
    assert "regexp_replace" not in plan(spark, "p10_grading_requests")


def test_raw_outputs_are_warned_of_once_each(spark):
    assert "from_json" not in plan(spark, "f20_schema_warnings")


def test_raw_outputs_are_recovered_once_each(spark):
    assert "from_json" not in plan(spark, "f19_recover_json")


def test_batches_written_again_start_from_the_table(spark, monkeypatch):
    plans, write = [], BatchTable.write
    monkeypatch.setattr(BatchTable, "write", lambda t, rows, replaced=None: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or write(t, rows, replaced))
    registry.queries()["s9_atomic_reprocess"](spark, "/root/testdata/sf0.001")
    assert ["row_number" in p for p in plans] == [True, False, False, False, False]


def test_arriving_rows_are_worked_out_once(spark, tmp_path):
    drawn = F.udf(lambda: os.urandom(1)[0] % 4, "int").asNondeterministic()
    source_queries._arrive(None, [(spark.range(400).withColumn("slice", drawn()), f"{tmp_path}/in")], 4)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/in").collect()) == list(range(400))  # once each
