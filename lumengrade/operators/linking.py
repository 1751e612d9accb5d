"""Pages to students and to layout: manifests, boxes, identity, tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import first_filled, safe_uuid
from ..sources.shared import written

MANIFEST = (
    "struct<version:int,pages:array<struct<physical_index:int,exam_id:string,student_id:string,page_in_student:int,total_pages_for_student:int,"
    "boxes:array<struct<question_number:int,x_pt:double,y_bottom_pt:double,width_pt:double,height_pt:double>>,"
    "fiducials:array<struct<x_pt:double,y_pt:double,width_pt:double,height_pt:double>>>>>"
)


def manifest_pages(exams: DataFrame) -> DataFrame:
    """exams(id, layout_manifest_json) to pages; of equal page indexes the last counts, unreadable JSON has no page."""
    pages = exams.select(F.col("id").alias("exam_id"), F.posexplode(F.from_json("layout_manifest_json", MANIFEST)["pages"]).alias("_i", "p"))
    last = F.row_number().over(Window.partitionBy("exam_id", "p.physical_index").orderBy(F.desc("_i")))
    named = pages.withColumn("_r", last).where("_r = 1 and p.physical_index is not null")
    return named.select("exam_id", "p.physical_index", F.col("p.student_id").alias("student_id"), "p.page_in_student", F.col("p.boxes").alias("boxes"))


def manifest_boxes(pages: DataFrame) -> DataFrame:
    """pages(exam_id, physical_index, boxes) to one row per box, in box order."""
    return pages.select("exam_id", "physical_index", F.posexplode("boxes").alias("box_pos", "b")).select("exam_id", "physical_index", "box_pos", "b.*")


def pages_with_layout(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """pages(exam_id, physical_index, ...) with their manifest page where there is one."""
    return pages.join(manifest.withColumnRenamed("student_id", "manifest_student"), ["exam_id", "physical_index"], "left")


def last_question(questions: DataFrame) -> DataFrame:
    """Of equal question numbers of an exam the last id counts."""
    place = F.row_number().over(Window.partitionBy("exam_id", "question_number").orderBy(F.desc("id")))
    return questions.withColumn("_r", place).where("_r = 1").drop("_r")


def crop_tasks(boxes: DataFrame, questions: DataFrame) -> DataFrame:
    """Boxes joined to their question; unknown numbers drop out."""
    q = last_question(questions).select("exam_id", "question_number", F.col("id").alias("question_id"), "max_score")
    return boxes.join(q, ["exam_id", "question_number"])


def fallback_tasks(pages: DataFrame, boxes: DataFrame, questions: DataFrame) -> DataFrame:
    """Pages without boxes against every question of their exam."""
    bare = pages.join(boxes.select("exam_id", "physical_index"), ["exam_id", "physical_index"], "left_anti")
    q = last_question(questions).select("exam_id", "question_number", F.col("id").alias("question_id"), "max_score")
    return bare.select("exam_id", "physical_index").join(q, "exam_id")


def grading_tasks(pages: DataFrame, boxes: DataFrame, questions: DataFrame) -> DataFrame:
    """UN2: mapped and unmapped pages as one task table; box_pos of whole-page tasks is the question number."""
    pick = ["exam_id", "physical_index", "box_pos", "question_number", "question_id", "max_score", "whole_page"]
    mapped = crop_tasks(boxes, questions).withColumn("whole_page", F.lit(False)).select(*pick)
    rest = fallback_tasks(pages, boxes, questions).withColumn("whole_page", F.lit(True)).withColumn("box_pos", F.col("question_number")).select(*pick)
    return mapped.unionByName(rest)


def box_to_pixels(df: DataFrame, page_h_pt: float, dpi: int) -> DataFrame:
    """P5: PDF points from the bottom left to whole pixels from the top left, cut toward zero."""
    k = dpi / 72.0
    top = F.lit(page_h_pt) - F.col("y_bottom_pt") - F.col("height_pt")
    return df.withColumns({
        "left": (F.col("x_pt") * k).cast("int"), "upper": (top * k).cast("int"),
        "right": ((F.col("x_pt") + F.col("width_pt")) * k).cast("int"), "lower": ((top + F.col("height_pt")) * k).cast("int"),
    })


def override_page(df: DataFrame) -> DataFrame:
    """The place in the file wins over the page the model reports."""
    return df.withColumn("page_mismatch", F.coalesce(F.col("reported_page") != F.col("position"), F.lit(False))).withColumn("page_number", F.col("position"))


def resolve_identity(pages: DataFrame) -> DataFrame:
    """pages(exam_id, qr_exam, qr_student, header_student, manifest_student) with student_id, identity_source, warnings."""
    read = pages.withColumns({f"_{c}": safe_uuid(F.col(f"{c}_student")) for c in ("qr", "header", "manifest")})
    qr, header, manifest, ok, source = (F.col(c) for c in ("_qr", "_header", "_manifest", "_ok", "identity_source"))
    read = read.withColumn("_ok", F.coalesce(qr.isNotNull() & (F.col("qr_exam") == F.col("exam_id")), F.lit(False)))
    read = read.withColumn("identity_source", F.when(ok, "qr").when(header.isNotNull(), "header_ocr").when(manifest.isNotNull(), "manifest_fallback").otherwise("anonymous"))
    # Warning texts.
    said = F.array_compact(F.array(
        F.when(ok & (manifest != qr), "QR e manifest discordam. Usando QR."),
        F.when(ok & (header != qr), "QR e cabeçalho discordam. Usando QR."),
        F.when(~ok & qr.isNotNull(), "QR ignorado por exam_id divergente."),
        F.when((source == "header_ocr") & (manifest != header), "Cabeçalho e manifest discordam. Usando cabeçalho."),
        F.when(source == "manifest_fallback", "Identidade via manifest_fallback. Conferir manualmente."),
        F.when(source == "anonymous", "Nenhuma identidade confiável encontrada."),
    ))
    who = F.when(ok, qr).when(source == "header_ocr", header).when(source == "manifest_fallback", manifest)
    return read.withColumns({"student_id": who, "identity_warnings": said}).drop("_qr", "_header", "_manifest", "_ok")


def fold_results(pages: DataFrame) -> DataFrame:
    """A5: pages(batch_id, student_id, page_number, detected_name, detected_registration, identity_source, warnings) to one
    result per student; pages without a student stay one result each."""
    page = F.col("page_number")
    key = F.coalesce("student_id", F.concat(F.lit("page:"), page.cast("string")))
    filled = lambda c: F.max_by(c, F.when(first_filled(F.col(c)).isNotNull(), page))
    first = F.min_by("identity_source", page)
    later_qr = F.bool_or(F.col("identity_source") == "qr")
    keyed = pages.withColumn("result_key", key)
    # Of each warning only its first page and place count, so that no more than the distinct texts come together.
    each = keyed.select("batch_id", "result_key", "page_number", F.posexplode("warnings").alias("i", "warning"))
    each = each.groupBy("batch_id", "result_key", "warning").agg(F.min(F.struct("page_number", "i")).alias("at"))
    said = each.groupBy("batch_id", "result_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "warning"))), lambda x: x["warning"]).alias("warnings"))
    folded = keyed.groupBy("batch_id", "result_key").agg(
        F.min("page_number").alias("page_number"), F.max("page_number").alias("physical_page"),
        filled("detected_name").alias("detected_name"), filled("detected_registration").alias("detected_registration"),
        F.when((first == "manifest_fallback") & later_qr, "qr").otherwise(first).alias("identity_source"),
        F.count("*").alias("pages"),
    )
    joined = folded.join(said, ["batch_id", "result_key"], "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))
    return joined.select(*[c for c in folded.columns if c != "pages"], "warnings", "pages")


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Rows with their number (from 0) within `keys` by `order`, in two levels: rows are dealt out by range and written, numbered within each range
    partition, and moved on by what the partitions before hold of their group. No task gets a whole group."""
    dealt = rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "ranges")  # where the ranges end is sampled, so it has to be decided once
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    return dealt.withColumn("_local", local).join(counts, [*keys, "_part"]).withColumn(name, F.col("_local") + F.col("_before")).select(*rows.columns, name)


def sheet_manifest(students: DataFrame, layout_pages: DataFrame) -> DataFrame:
    """Each student of the exam's class times the layout's pages, with a running page index per exam.

    students(exam_id, student_id, registration_number), layout_pages(exam_id, page_in_student); a layout has a few pages.
    """
    sheets = Window.partitionBy("exam_id")
    pages = layout_pages.withColumn("_at", F.row_number().over(sheets.orderBy("page_in_student"))).withColumn("total_pages_for_student", F.count("*").over(sheets))
    placed = numbered(students, ["exam_id"], ["registration_number", "student_id"], "_nth")
    index = F.col("_nth") * F.col("total_pages_for_student") + F.col("_at") - 1
    return placed.join(pages, "exam_id").withColumn("physical_index", index.cast("int")).select(*students.columns, "page_in_student", "physical_index", "total_pages_for_student")


def validate_batches(batches: DataFrame, exams: DataFrame, questions: DataFrame) -> DataFrame:
    """batches(id, exam_id, readable) with status and reason of what can't run; a missing manifest is allowed."""
    e = exams.select(F.col("id").alias("exam_id"), F.lit(True).alias("_e")).distinct()
    q = questions.select("exam_id", F.lit(True).alias("_q")).distinct()
    joined = batches.join(e, "exam_id", "left").join(q, "exam_id", "left")
    reason = F.when(F.col("_e").isNull(), "exam not found").when(F.col("_q").isNull(), "exam without questions").when(~F.coalesce("readable", F.lit(False)), "file unreadable")
    return joined.select(*batches.columns, reason.alias("reason"), F.when(reason.isNotNull(), "FAILED").otherwise("PROCESSING").alias("status"))


def eligible_batches(batches: DataFrame, mode: str) -> DataFrame:
    """batches(id, status, exam_id[, new_exam_id]) with `eligible` and `why` for mode reprocess, reupload or run_now."""
    busy = F.col("status") == "PROCESSING"
    why = F.when(busy, "batch is being processed")
    if mode == "reupload":
        why = why.when(F.col("new_exam_id") != F.col("exam_id"), "another exam")
    if mode == "run_now":
        why = why.when(F.col("status").isin("REVIEW_PENDING", "DONE"), "already processed")
    return batches.withColumn("why", why).withColumn("eligible", F.col("why").isNull())


def match_class(exams: DataFrame, classes: DataFrame) -> DataFrame:
    """exams(id, turma) with the class of that name, whatever its case; of equal names the smallest id."""
    by = classes.groupBy(F.lower("name").alias("_k")).agg(F.min("id").alias("class_id"))
    return exams.join(by, F.lower("turma") == F.col("_k"), "left").drop("_k")


def list_exams(exams: DataFrame, practical: bool | None = None) -> DataFrame:
    """Exams of one kind, or all, by name."""
    return (exams if practical is None else exams.where(F.col("is_practical") == practical)).orderBy("name", "id")


def select_pages(pages: DataFrame, spec: F.Column) -> DataFrame:
    """pages(page_number, n_pages) named by a text like "1,3,5"; an empty or unreadable spec means all."""
    wanted = F.filter(F.transform(F.split(F.coalesce(spec, F.lit("")), ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull() & (x >= 1) & (x <= F.col("n_pages")))
    return pages.where((F.size(wanted) == 0) | F.array_contains(wanted, F.col("page_number")))
