"""Headline queries on $BENCH_SF_DIR, local[$BENCH_CPUS]; one JSON line."""

import importlib
import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "batch_report", "w1_dedupe_first", "a2_student_status", "a4_batch_stats", "a12_final_mark", "o1_review_queue", "m1_apply_updates", "j2_export_rows", "s8_report_wide",
    "a11_run_rows", "j13_resolve_identity", "a5_fold_results", "j11_resolve_ocr", "w7_pick_model_output", "f22_discursive_grades", "f17_short_answers", "f18_copied_prompts",
    "op1_quality_rules", "op2_source_mix", "op3_token_counts", "op4_url_filter", "op5_sentencepiece_codec", "op6_minhash_dedup", "op7_language_id", "op8_embedding_dedup",
    "op9_license_scan", "op10_toxicity", "op11_centroid_clusters", "op12_hard_negatives", "op13_page_text", "pipeline",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-check-")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    entry = importlib.import_module("__spark_entry__").queries()
    took = {}
    for name in [n for n in HEADLINE if n in entry]:
        best = None
        for _ in range(2):  # the first run warms up
            start = time.time()
            entry[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - start)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
