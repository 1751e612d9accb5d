"""Semi-structured payloads to typed tables: rubrics, vision pages, OCR results, model outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grades import reading_confidence
from ..functions.identity import student_code
from ..functions.short_answer import expanded_form, normal_form
from ..functions.values import decimal_or_null, first_filled, first_nonzero, needs_fallback, strip, truthy_text, unit_interval
from ..sources.shared import once_each, written

QUESTION = "struct<number:string,prompt_detected:string,answer_transcription:string,reading_confidence:string,ocr_confidence:string,reading_notes:string,has_answer:string,image_region:string>"
PAGE = f"struct<student:struct<name:string,registration:string,class:string,student_code:string>,physical_page:int,page:int,page_number:int,questions:array<{QUESTION}>>"


def rubric_questions(rubrics: DataFrame) -> DataFrame:
    """S3: rubrics(rubric_id, payload) in any of three shapes (list, {"questions": list}, {"1": value}) to one row per question."""
    item = "map<string,string>"
    t = strip(F.col("payload"))
    listed = F.when(F.startswith(t, F.lit("[")), F.from_json(t, f"array<{item}>"))
    obj = F.when(F.startswith(t, F.lit("{")), F.from_json(t, item))
    nested = F.from_json(obj["questions"], f"array<{item}>")

    def value(k: Column, v: Column) -> Column:
        inner = F.when(F.startswith(strip(v), F.lit("{")), F.from_json(v, item))
        body = F.coalesce(inner, F.create_map(F.lit("rubric"), v))
        return F.map_concat(F.map_filter(body, lambda a, _: a != "number"), F.create_map(F.lit("number"), k))

    keyed = F.transform(F.map_entries(F.map_filter(obj, lambda k, _: k.try_cast("int").isNotNull())), lambda e: value(e["key"], e["value"]))
    rows = rubrics.select("rubric_id", F.explode(F.coalesce(listed, nested, keyed)).alias("q"))
    number = F.coalesce(F.col("q")["number"], F.col("q")["question_number"], F.col("q")["questao"]).try_cast("int")
    expected = first_filled(*[F.col("q")[k] for k in ("expected_answer", "rubric", "answer", "resposta")])
    top = first_nonzero(decimal_or_null(F.col("q")["max_score"]), decimal_or_null(F.col("q")["valor"]), F.lit(1.0))
    return rows.select("rubric_id", number.alias("question_number"), expected.alias("expected_answer"), F.col("q")["prompt"].alias("prompt"), top.alias("max_score"))


def attach_rubric(answers: DataFrame, rubric: DataFrame) -> DataFrame:
    """answers(rubric_id, question_number, ...) with their rubric by number, never by place; a rubric whose only question has
    no number applies to all. Of equal numbers the greatest expected answer counts."""
    by = rubric.where("question_number is not null").groupBy("rubric_id", "question_number").agg(F.max("expected_answer").alias("_own"))
    alone = rubric.groupBy("rubric_id").agg(F.count("*").alias("_n"), F.max("expected_answer").alias("_all"), F.count("question_number").alias("_k")).where("_n = 1 and _k = 0")
    joined = answers.join(by, ["rubric_id", "question_number"], "left").join(alone.select("rubric_id", "_all"), "rubric_id", "left")
    return joined.withColumn("expected_answer", F.coalesce("_own", "_all")).drop("_own", "_all")


def rubric_summary(rubrics: DataFrame, most: int = 20) -> DataFrame:
    """The first questions of each rubric, by number, as one JSON text."""
    place = F.row_number().over(Window.partitionBy("rubric_id").orderBy(F.asc_nulls_last("question_number"), "expected_answer"))
    kept = rubric_questions(rubrics).withColumn("_p", place).where(F.col("_p") <= most)
    item = F.struct(F.col("_p").alias("p"), F.struct("question_number", "expected_answer", "max_score").alias("q"))
    return kept.groupBy("rubric_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["q"])).alias("summary"))


def vision_questions(pages: DataFrame) -> DataFrame:
    """pages(run_id, position, payload) to one row per question; the number defaults to its place, has_answer to a text being there
    (blanks are one), the student's code to digits of name or registration, the physical page to the position."""
    page = F.from_json("payload", PAGE)
    rows = pages.select("run_id", "position", page.alias("p")).select("run_id", "position", "p.student", "p.physical_page", F.col("p.page_number").alias("stated_page"), F.posexplode("p.questions").alias("i", "q"))
    text = F.coalesce("q.answer_transcription", F.lit(""))
    return rows.select(
        "run_id", F.col("position").alias("page_number"), F.col("i").alias("place"), F.coalesce(F.col("q.number").try_cast("int"), F.col("i") + 1).alias("question_number"),
        F.coalesce("q.prompt_detected", F.lit("")).alias("prompt_detected"), text.alias("answer_transcription"),
        reading_confidence(F.col("q.reading_confidence")).alias("reading_confidence"), unit_interval(decimal_or_null(F.col("q.ocr_confidence"))).alias("ocr_confidence"),
        F.coalesce(truthy_text(F.col("q.has_answer")), text != "").alias("has_answer"), F.col("student.name").alias("student_name"), F.col("student.registration").alias("registration"),
        F.col("student.class").alias("class_name"), F.coalesce(first_filled(strip(F.col("student.student_code"))), student_code(F.col("student.name"), F.col("student.registration")), F.lit("")).alias("student_code"),
        F.coalesce(first_nonzero(F.col("physical_page"), F.col("stated_page")), F.col("position")).alias("physical_page"),
    )


def valid_questions(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, warnings): numbers that are null, zero or less drop out with a warning row each."""
    good = F.coalesce(F.col("question_number") > 0, F.lit(False))
    said = F.concat(F.lit("invalid question number on page "), F.col("page_number").cast("string"))
    return answers.where(good), answers.where(~good).select("run_id", "page_number", said.alias("warning"))


def dedupe_page_answers(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first answer per run, page and question, a warning per dropped row)."""
    key = ["run_id", "page_number", "question_number"]
    placed = answers.withColumn("_p", F.row_number().over(Window.partitionBy(*key).orderBy("place")))
    said = F.concat(F.lit("question "), F.col("question_number").cast("string"), F.lit(" repeats on page "), F.col("page_number").cast("string"))
    return placed.where("_p = 1").drop("_p"), placed.where("_p > 1").select("run_id", "page_number", "question_number", "place", said.alias("warning"))


def flatten_answers(pages: DataFrame) -> DataFrame:
    """Vision payload rows with grades to one wide row per answer.

    pages(run_id, payload, raw_page, grades) - grades is an array of struct(question_number, score text, max_score text, verdict,
    needs_human_review) joined by number; the page is the first non-zero of physical_page, page, raw_page, 0.
    """
    p = F.from_json("payload", PAGE)
    rows = pages.select("run_id", "raw_page", "grades", p.alias("p")).select("run_id", "raw_page", "grades", F.col("p.physical_page").alias("a"), F.col("p.page").alias("b"), "p.student", F.explode("p.questions").alias("q"))
    number = F.col("q.number").try_cast("int")
    rows = rows.withColumn("question_number", number).withColumn("g", F.get(F.filter("grades", lambda g: g["question_number"] == F.col("question_number")), F.lit(0)))
    reading = reading_confidence(F.col("q.reading_confidence"))
    return rows.select(
        "run_id", F.coalesce(first_nonzero(F.col("a"), F.col("b"), F.col("raw_page")), F.lit(0)).alias("page_number"), "question_number",
        F.col("student.name").alias("student_name"), F.col("student.student_code").alias("detected_student_code"), F.col("q.answer_transcription").alias("answer_transcription"),
        F.col("g.score").try_cast("double").alias("score"), F.col("g.max_score").try_cast("double").alias("max_score"), F.col("q.ocr_confidence").try_cast("double").alias("ocr_confidence"),
        F.col("q.image_region").alias("image_region_json"), (F.coalesce("g.needs_human_review", F.lit(False)) | (reading == "baixa")).alias("needs_human_review"),
    )


def mean_confidence(raw: DataFrame) -> DataFrame:
    """raw(answer_id, pages array<struct<markdown,conf:string>>) to text (blocks joined by a blank line) and mean confidence."""
    numbers = F.filter(F.transform("pages", lambda p: p["conf"].try_cast("double")), lambda x: x.isNotNull())
    mean = F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers))
    texts = F.filter(F.transform("pages", lambda p: p["markdown"]), lambda x: strip(x) != "")
    return raw.select("answer_id", F.array_join(texts, "\n\n").alias("text"), mean.alias("confidence"))


def resolve_ocr(results: DataFrame, order: list[str]) -> DataFrame:
    """results(answer_id, provider, text, confidence, error) folded in priority order to one transcription per answer."""
    at = lambda p, c: F.max(F.when(F.col("provider") == p, F.col(c)))
    per = results.groupBy("answer_id").agg(*[at(p, c).alias(f"{c}_{i}") for i, p in enumerate(order) for c in ("text", "confidence", "error")], *[
        F.bool_or(F.col("provider") == p).alias(f"has_{i}") for i, p in enumerate(order)])

    def one(i: int) -> Column:
        text = F.coalesce(f"text_{i}", F.lit(""))
        return F.when(F.coalesce(f"has_{i}", F.lit(False)), F.struct(
            text.alias("text"), F.col(f"confidence_{i}").alias("confidence"), needs_fallback(text, F.col(f"confidence_{i}")).alias("needs_fallback"),
            F.lit(order[i]).alias("provider"), F.nullif(f"error_{i}", F.lit("")).alias("error")))

    def good(r: Column) -> Column:
        return F.coalesce(r["error"].isNull() & ~r["needs_fallback"], F.lit(False))

    def fold(a: Column, b: Column) -> Column:
        name = F.concat(a["provider"], F.lit("->fallback:"), b["provider"])
        taken = F.struct(b["text"].alias("text"), b["confidence"].alias("confidence"), b["needs_fallback"].alias("needs_fallback"), name.alias("provider"), b["error"].alias("error"))
        joined = F.concat_ws("; ", a["error"], b["error"])
        neither = F.struct(
            F.coalesce(first_filled(a["text"], b["text"]), F.lit("")).alias("text"), first_nonzero(a["confidence"], b["confidence"]).alias("confidence"), F.lit(True).alias("needs_fallback"), name.alias("provider"),
            F.when(joined == "", "OCR principal e fallback sem texto confiável.").otherwise(joined).alias("error"))
        clean = taken.withField("error", F.lit(None).cast("string"))
        return F.when(a.isNull(), b).when(b.isNull() | good(a), a).when(good(b), taken).when(strip(b["text"]) != "", clean).otherwise(neither)

    out = per.withColumn("r", one(0))
    for i in range(1, len(order)):
        out = out.withColumn("_b", one(i)).withColumn("r", fold(F.col("r"), F.col("_b"))).drop("_b")
    return out.select("answer_id", "r.text", "r.confidence", "r.needs_fallback", "r.provider", "r.error")


def choose_grade(text: DataFrame, visual: DataFrame) -> DataFrame:
    """Text grades(task_id, score, confidence, parse_ok, review, ocr_error, needs_fallback) with the visual grade(task_id, score,
    confidence, parse_ok) in their place where the text is doubtful and the visual one parsed."""
    v = visual.select("task_id", F.col("score").alias("_s"), F.col("confidence").alias("_c"), F.col("parse_ok").alias("_ok"))
    joined = text.join(v, "task_id", "left")
    doubt = first_filled(F.col("ocr_error")).isNotNull() | F.col("needs_fallback") | ~F.col("parse_ok") | (F.col("confidence") < 0.70) | F.col("review")
    use = F.coalesce(doubt & F.col("_ok"), F.lit(False))
    return joined.select("task_id", F.when(use, F.col("_s")).otherwise(F.col("score")).alias("score"), F.when(use, F.col("_c")).otherwise(F.col("confidence")).alias("confidence"), use.alias("visual_used"))


def pick_model_output(outputs: DataFrame, candidates: list[str], text_only: tuple[str, ...] = ()) -> DataFrame:
    """outputs(task_id, model, ok, output, error): the first candidate that worked; fallback_used past the first; else joined errors."""
    order = [m for m in dict.fromkeys(candidates) if m and m not in text_only]
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    ranked = outputs.withColumn("rank", rank).where("rank > 0")
    best = F.min_by(F.struct("model", "output", "rank"), F.when(F.col("ok"), F.col("rank")))
    errors = F.transform(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.struct("rank", "error")))), lambda x: x["error"])
    per = ranked.groupBy("task_id").agg(best.alias("b"), F.array_join(errors, " | ").alias("e"))
    return per.select("task_id", F.col("b.model").alias("model"), F.col("b.output").alias("output"), F.coalesce(F.col("b.rank") > 1, F.lit(False)).alias("fallback_used"), F.when(F.col("b").isNull(), F.col("e")).alias("error"))


# What stands for a blank, by kind of request.
BLANK, UNREAD = "(vazio)", "(sem transcrição confiável)"


def build_requests(answers: DataFrame, questions: DataFrame, kind: str = "single") -> DataFrame:
    """P10: one request per answer with its question, as (id, question_id, prompt, payload, image); wording is the caller's.

    single grades a transcription (blank: BLANK) and visual the picture of the answer (answers.image; blank transcription: UNREAD), both by a prompt of
    named fields. grading has a JSON payload with raw, expanded and normal forms of prompt, answer and key, each worked out once for a question or
    a distinct answer. answers(id, question_id, answer_transcription, and for grading reading_confidence).
    """
    if kind not in ("single", "visual", "grading"):
        raise ValueError(f"no kind of request: {kind}")
    q = questions.select(F.col("id").alias("question_id"), "question_number", "question_text", "expected_answer", "max_score")
    if kind == "grading":
        text = lambda c: F.coalesce(c, F.lit(""))
        forms = {f"_{c}_{name}": form(text(c)) for c in ("question_text", "expected_answer") for name, form in (("expanded", expanded_form), ("normal", normal_form))}
        q = written(q.withColumns(forms), "questions")
        said = {"_said_expanded": expanded_form(text("answer_transcription")), "_said_normal": normal_form(text("answer_transcription"))}
        answers = once_each(answers, ["answer_transcription"], lambda rows: rows.withColumns(said), "answers")
    rows = answers.join(q, "question_id")
    image = F.col("image") if kind == "visual" else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    if kind == "grading":
        asked, said, key = (F.coalesce(c, F.lit("")) for c in ("question_text", "answer_transcription", "expected_answer"))
        body = F.struct(
            "question_number", asked.alias("question_prompt"), F.col("_question_text_expanded").alias("question_prompt_expanded"),
            F.coalesce(F.nullif("reading_confidence", F.lit("")), F.lit("media")).alias("reading_confidence"), said.alias("student_answer"),
            F.col("_said_expanded").alias("student_answer_expanded"), F.col("_said_normal").alias("student_answer_normalized"),
            F.col("_expected_answer_expanded").alias("rubric_expected_answer_expanded"), F.col("_expected_answer_normal").alias("rubric_expected_answer_normalized"),
            F.struct(key.alias("expected_answer"), "max_score").alias("rubric"),
        )
        return rows.select("id", "question_id", none.alias("prompt"), F.to_json(body).alias("payload"), image.alias("image"))
    shown = F.coalesce(first_filled(strip(F.col("answer_transcription"))), F.lit(UNREAD if kind == "visual" else BLANK))
    named = lambda c: F.coalesce(first_filled(F.col(c)), F.lit(BLANK))
    prompt = F.format_string("Questão %s: %s\nGabarito: %s\nValor: %s\nResposta: %s", F.col("question_number").cast("string"), named("question_text"), named("expected_answer"), F.col("max_score").cast("string"), shown)
    return rows.select("id", "question_id", prompt.alias("prompt"), none.alias("payload"), image.alias("image"))


#: Parts of a page's context that no reader of the page is told (fixed values).
UNTOLD = ("vision_model", "image_path")


def page_requests(pages: DataFrame) -> DataFrame:
    """P10 for whole pages: pages(page_id, image_path, ...) as (page_id, image, payload), what else is known of a page being its JSON context;
    nulls are left out, and a page of which nothing is known has none."""
    told = [c for c in pages.columns if c not in (*UNTOLD, "page_id")]
    known = F.lit(False)
    for c in told:
        known = known | F.col(c).isNotNull()
    return pages.select("page_id", F.col("image_path").alias("image"), F.when(known, F.to_json(F.struct(*told))).alias("payload") if told else F.lit(None).cast("string").alias("payload"))


def expected_from_raw(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Expected answer out of the stored grading JSON, else from the question table."""
    q = questions.select(F.col("id").alias("question_id"), F.col("expected_answer").alias("_q"))
    raw = [first_filled(F.get_json_object("raw_grading_json", f"$.{k}")) for k in ("expected_answer", "rubric_expected_answer")]
    return answers.join(q, "question_id", "left").select("id", F.coalesce(*raw, F.col("_q"), F.lit("")).alias("expected_answer"))
