"""Answers to grades: model output recovery, discursive and short-answer grading, guards."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grades import COPIED, LOW_READING, OFF_SCALE, PARSE_COMMENT, PARSE_ERROR, clamp_grade, verdict
from ..functions.json_text import schema_warnings, strict_boolean, text_list, truthy, with_kinds
from ..functions.short_answer import (
    copy_form, coverage, key_variants, laterality, normal_form, ratio_at_least, same_side, similarity, without_side,
)
from ..functions.values import decimal_or_null, first_filled, first_nonzero, strip
from ..sources.shared import once_each, written


def discursive_grades(outputs: DataFrame) -> DataFrame:
    """outputs(id, raw, answer, prompt, reading_confidence, max_score) to typed grades.

    Copied prompts are told by word overlap or ratio, as copied_prompts() does. A failed parse stands for a zero grade that passes the
    schema, asks for review and gives the marker of the failure as its reason. Each distinct output and answer is graded once.
    """
    inputs = ["raw", "answer", "reading_confidence", "max_score", *[c for c in PROMPTS if c in outputs.columns]]
    return once_each(outputs.select("id", *inputs), inputs, lambda rows: _grades(rows, inputs), "grades").select("id", "_grade.*")


def _grades(outputs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep, and the grade of each row as _grade."""
    rows = with_kinds(copied_prompts(outputs), "raw")
    failed = F.col("_obj").isNull()
    o = F.col("_obj")
    warned = F.when(failed, F.array().cast("array<string>")).otherwise(schema_warnings())
    rows = rows.withColumn("schema_warnings", warned).withColumn("schema_valid", F.size("schema_warnings") == 0)
    top = first_nonzero(decimal_or_null(o["max_score"]), F.col("max_score"), F.lit(1.0))
    grade = clamp_grade(F.coalesce(o["score"], o["nota"]))
    flag = strict_boolean(F.col("_kind_revisao_necessaria"), o["revisao_necessaria"])
    answer, sure = strip(F.coalesce("answer", F.lit(""))), F.lower(F.coalesce("reading_confidence", F.lit("")))
    rows = rows.withColumns({"top": top, "g": grade, "flag": flag, "a": answer, "c": sure})
    score = F.when(failed, 0.0).otherwise(F.greatest(F.lit(0.0), F.least("g.value", "top")))
    marks = F.size(F.split("a", r"\[ileg[ií]vel\]", -1)) - 1
    asked = F.when(F.map_contains_key("_obj", "needs_human_review"), truthy(F.col("_kind_needs_human_review"), o["needs_human_review"])).otherwise(F.col("flag.value"))
    review = failed | asked | (F.col("c") == "baixa") | (marks >= 2) | F.col("g.off_scale") | ~F.col("schema_valid") | F.col("flag.invalid") | F.col("copied")
    notes = F.when(~failed & F.col("flag.invalid"), F.array_append("schema_warnings", F.lit("Campo revisao_necessaria com tipo/valor inválido."))).otherwise(F.col("schema_warnings"))
    rows = rows.withColumns({"score": score, "notes": notes})
    reason = F.coalesce(
        first_filled(o["review_reason"]), F.when(failed, PARSE_ERROR), first_filled(F.array_join("notes", "; ")), F.when(F.col("copied"), COPIED),
        F.when(F.col("g.off_scale"), OFF_SCALE), F.when(F.col("c") == "baixa", LOW_READING), F.lit(""),
    )
    grade = F.struct(
        F.when(F.col("copied"), 0.0).otherwise(F.col("score")).alias("score"), F.col("top").alias("max_score"),
        F.when(F.col("copied"), "incorreta").otherwise(verdict(o["verdict"], F.col("a"), F.col("c"), F.col("score"))).alias("verdict"),
        F.when(failed, PARSE_COMMENT).otherwise(F.coalesce(o["justification"], o["comentario"], F.lit(""))).alias("justification"),
        text_list("missing_concepts", "criterios_ausentes").alias("missing_concepts"), text_list("detected_concepts", "criterios_atendidos").alias("detected_concepts"),
        review.alias("needs_human_review"), "schema_valid", F.col("notes").alias("parse_warnings"), reason.alias("review_reason"),
    )
    return rows.select(*keep, grade.alias("_grade"))


def overlap_copied(answer: F.Column, prompt: F.Column) -> F.Column:
    """F18's overlap rule: both of 20 characters or more in copy form, and 85 % of the answer's distinct words in the prompt."""
    a, p = copy_form(answer), copy_form(prompt)
    words = F.array_distinct(F.split(a, " "))
    return (F.length(a) >= 20) & (F.length(p) >= 20) & (F.size(F.array_intersect(words, F.split(p, " "))) / F.greatest(F.size(words), F.lit(1)) >= 0.85)


ALIKE = 0.86  # likeness of two short answers without their side words from which they have one structure
PROMPTS = ("prompt", "prompt_detected", "question_prompt", "rubric_prompt")  # fixed values: where a prompt may stand, first that says something


def asked_prompt(columns: list[str]) -> F.Column:
    """The prompt among the columns that hold one; '' where none says anything."""
    said = [F.nullif(F.col(c), F.lit("")) for c in PROMPTS if c in columns]
    return F.coalesce(*said, F.lit("")) if said else F.lit("")


def copied_prompts(turns: DataFrame, least: float = 0.86, ratio: Callable[..., F.Column] = ratio_at_least) -> DataFrame:
    """turns(answer, one or more of PROMPTS, ...) with `copied`. Each distinct pair of texts that are long enough is judged once.

    The ratio, of at most twice the shorter length over both and no more than the letters in common allow, runs only where word overlap hasn't
    decided and these bounds leave it open. Hits are written out once as 128-bit numbers, so that Spark joins them by their size; no text is joined.
    """
    named = turns.withColumn("_prompt", asked_prompt(turns.columns))
    long_enough = F.coalesce((F.length("answer") >= 20) & (F.length("_prompt") >= 20), F.lit(False))
    # Rows that can't be a hit get numbers of their own, so that blanks don't come together anywhere.
    keys = {"_k1": F.xxhash64("answer", "_prompt"), "_k2": F.xxhash64("_prompt", F.lit(1), "answer")}
    pairs = named.where(long_enough).groupBy("answer", "_prompt").agg(F.count("*").alias("_n"))
    named = named.withColumns({k: F.when(long_enough, c).otherwise(F.monotonically_increasing_id()) for k, c in keys.items()})
    # The forms lean on the count, so that no filter on them, nor the ratio, moves below the aggregate to every row.
    counted = lambda c: F.when(F.col("_n") > 0, c)
    pairs = pairs.withColumns({"_a": counted(copy_form(F.col("answer"))), "_p": counted(copy_form(F.col("_prompt")))}).where((F.length("_a") >= 20) & (F.length("_p") >= 20))
    words = F.array_distinct(F.split("_a", " "))
    pairs = pairs.withColumn("_o", F.size(F.array_intersect(words, F.split("_p", " "))) / F.greatest(F.size(words), F.lit(1)) >= 0.85)
    la, lp = F.length("_a"), F.length("_p")
    pairs = pairs.withColumn("_open", ~F.col("_o") & (2 * F.least(la, lp) >= least * (la + lp)))
    pairs = pairs.withColumns({"_x": F.when(F.col("_open"), F.col("_a")), "_y": F.when(F.col("_open"), F.col("_p"))}).withColumn("_r", ratio("_x", "_y", F.lit(least)))
    hits = pairs.where(F.col("_o") | (F.col("_r") >= least)).withColumnRenamed("_prompt", "_q")
    hits = hits.select(F.xxhash64("answer", "_q").alias("_k1"), F.xxhash64("_q", F.lit(1), "answer").alias("_k2"), F.lit(True).alias("_hit"))
    return named.join(written(hits, "copied"), ["_k1", "_k2"], "left").select(*turns.columns, F.coalesce("_hit", F.lit(False)).alias("copied"))


def grade_short_answers(answers: DataFrame, strict_empty: bool = False, ratio: Callable[..., F.Column] = ratio_at_least) -> DataFrame:
    """answers(id, answer, key, reading_confidence, max_score) graded against their keys.

    The ratio runs on distinct (answer form, variant) pairs only, and not where the letters in common show that a variant can't be the best
    one, or that texts without their side words can't be alike. strict_empty sends answers
    without any letter or figure to review instead of taking them as contained in the key. Each distinct answer to a key is graded once.
    """
    inputs = ["answer", "key", "reading_confidence", "max_score"]
    graded = once_each(answers.select("id", *inputs), inputs, lambda rows: _short_grades(rows, inputs, strict_empty, ratio), "short-grades")
    return graded.select("id", "_grade.*")


def _short_grades(answers: DataFrame, keep: list[str], strict_empty: bool, ratio: Callable[..., F.Column]) -> DataFrame:
    """The columns to keep, and the grade of each row as _grade."""
    key, answer = strip(F.coalesce("key", F.lit(""))), strip(F.coalesce("answer", F.lit("")))
    rows = answers.withColumns({"_key": key, "_answer": answer})
    # Normal forms are worked out once for each distinct text.
    forms = rows.select("_answer").distinct().withColumn("_norm", normal_form(F.col("_answer")))
    keys = rows.select("_key").distinct().withColumns({"_knorm": normal_form(F.col("_key")), "_variants": key_variants(F.col("_key"))})
    rows = rows.join(forms, "_answer").join(keys, "_key")
    cand = rows.where("_key <> '' and _answer <> ''").select("_norm", "_variants").distinct()
    pairs = cand.select("_norm", "_variants", F.posexplode("_variants").alias("_i", "_v")).withColumns({"_n0": without_side(F.col("_norm")), "_v0": without_side(F.col("_v"))})
    # A ratio counts only where it can make a variant the best one, or texts without their side words alike; sim is at least what coverage alone gives.
    pairs = pairs.withColumn("_low", similarity(F.lit(0.0), F.col("_norm"), F.col("_v")))
    pairs = pairs.withColumn("_best_low", F.max("_low").over(Window.partitionBy("_norm", "_variants")))
    reach = lambda sim, x, y: (sim - similarity(F.lit(0.0), F.col(x), F.col(y))) / 0.65 - 1e-9
    same = pairs.select(F.col("_norm").alias("x"), F.col("_v").alias("y"), reach(F.col("_best_low"), "_norm", "_v").alias("least"))
    bare = pairs.select(F.col("_n0").alias("x"), F.col("_v0").alias("y"), reach(F.lit(ALIKE), "_n0", "_v0").alias("least"))
    whole = same.unionByName(bare).where("x <> '' and y <> '' and x <> y").groupBy("x", "y").agg(F.min("least").alias("least"))
    ratios = whole.withColumn("r", ratio("x", "y", "least"))

    def with_ratio(df: DataFrame, x: str, y: str, out: str) -> DataFrame:
        r = ratios.select(F.col("x").alias(x), F.col("y").alias(y), F.col("r").alias("_r"))
        joined = df.join(r, [x, y], "left")
        return joined.withColumn(out, similarity(F.coalesce("_r", F.when(F.col(x) == F.col(y), 1.0), F.lit(0.0)), F.col(x), F.col(y))).drop("_r")

    scored = with_ratio(with_ratio(pairs, "_norm", "_v", "sim"), "_n0", "_v0", "sim0")
    best = scored.groupBy("_norm", "_variants").agg(F.max_by(F.struct("_v", "sim", "sim0"), F.struct("sim", -F.col("_i"))).alias("best"))
    rows = rows.join(best, ["_norm", "_variants"], "left")
    v, sim = F.coalesce("best._v", F.lit("")), F.coalesce("best.sim", F.lit(0.0))
    held = (v != "") & (F.contains(F.col("_norm"), v) | F.contains(v, F.col("_norm")) | (sim >= 0.90))
    empty = F.lit(strict_empty) & (F.col("_norm") == "")
    side = same_side(F.col("_norm"), F.col("_knorm"))
    correct = held & side & ~empty
    structure = (v != "") & (F.coalesce("best.sim0", F.lit(0.0)) >= ALIKE)
    near = ~correct & ((side & (sim >= 0.72)) | (structure & (sim >= 0.68)))
    low = F.lower(F.coalesce("reading_confidence", F.lit("media"))) == "baixa"
    no_key, no_answer = F.col("_key") == "", F.col("_answer") == ""
    # Justifications.
    why = (
        F.when(no_key, "Gabarito prático não informado para esta questão.").when(no_answer, F.concat(F.lit("Resposta em branco. Esperado: "), "_key", F.lit(".")))
        .when(~side & structure, "Estrutura compatível, mas lateralidade divergente.").when(correct, "Resposta prática confere com o gabarito esperado.")
        .when(near, "Resposta próxima ao gabarito; possível ruído de OCR/abreviação. Revisão humana recomendada.")
        .otherwise(F.concat(F.lit("Resposta prática não confere com o gabarito esperado: "), "_key", F.lit(".")))
    )
    asks = (
        F.when(no_key, "Gabarito prático ausente.").when(low, "Leitura visual com baixa confiança.")
        .when(~no_answer & (near | empty), "Resposta próxima ao gabarito; revisar possível erro de OCR/abreviação.").otherwise("")
    )
    told, none = F.array("_key"), F.array().cast("array<string>")
    top = first_nonzero(F.col("max_score"), F.lit(1.0))
    grade = F.struct(
        F.when(~no_key, F.when(correct & ~no_answer, top).otherwise(0.0)).alias("score"), top.alias("max_score"),
        F.when(no_key, "sem_rubrica").when(no_answer, "sem_resposta").when(correct, "correta").otherwise("incorreta").alias("verdict"),
        (no_key | low | (~no_answer & (near | empty))).alias("needs_human_review"), why.alias("justification"),
        F.when(correct & ~no_answer & ~no_key, told).otherwise(none).alias("detected_concepts"), F.when(no_key | (correct & ~no_answer), none).otherwise(told).alias("missing_concepts"),
        asks.alias("review_reason"), F.round(F.when(~no_key & ~no_answer, sim), 3).alias("similarity"), F.col("_norm").alias("normal_answer"),
    )
    return rows.select(*keep, grade.alias("_grade"))


def exact_matches(answers: DataFrame) -> DataFrame:
    """F17's exact path alone: ids whose normal form equals a variant's and whose side agrees; no ratio needed."""
    norm, knorm = normal_form(F.coalesce("answer", F.lit(""))), normal_form(F.coalesce("key", F.lit("")))
    return answers.where(F.array_contains(key_variants(F.coalesce("key", F.lit(""))), norm) & same_side(norm, knorm)).select("id")


def semantic_guard(answers: DataFrame, guards: DataFrame) -> DataFrame:
    """answers(id, question_number, rubric_text, score) against guards(question_number, terms): a rubric that meets none of its
    question's terms takes the score to 0 and asks for review."""
    joined = answers.join(guards, "question_number", "left")
    met = F.exists("terms", lambda t: F.contains(F.lower("rubric_text"), F.lower(t)))
    swapped = F.col("terms").isNotNull() & ~F.coalesce(met, F.lit(False))
    return joined.select("id", "question_number", F.when(swapped, 0.0).otherwise(F.col("score")).alias("score"), swapped.alias("possible_rubric_swap"))


def guard_by_terms(answers: DataFrame, terms: DataFrame, most: int = 200_000) -> DataFrame:
    """F24 for many terms: answers(id, question_number, rubric_text, score) against terms(question_number, term), any number a question; as semantic_guard().

    The terms are a table of parameters, at most `most` distinct ones. They form one automaton, and each text is read once for all of them, in Arrow
    batches. Terms are compared in lower case; blank ones count as met, as every text contains them.
    """
    rows = terms.where("question_number is not null and term is not null").select(F.lower("term").alias("term"), "question_number").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    of: dict[str, set[int]] = {}
    for r in rows:
        of.setdefault(r.term, set()).add(r.question_number)
    guarded = sorted({r.question_number for r in rows})

    def run(batches):
        import ahocorasick

        finder, always = ahocorasick.Automaton(), of.get("", set())
        for term, numbers in of.items():
            if term:
                finder.add_word(term, numbers)
        finder.make_automaton()
        for t in batches:
            met = []
            for number, text in zip(t.column("question_number").to_pylist(), t.column("_text").to_pylist(), strict=True):
                some = number in always and text is not None
                met.append(some or (text is not None and len(finder) > 0 and any(number in numbers for _, numbers in finder.iter(text))))
            yield t.drop_columns("_text").append_column("_met", pa.array(met, pa.bool_()))

    asked = answers.withColumns({"_text": F.lower("rubric_text"), "_guarded": F.coalesce(F.col("question_number").isin(guarded), F.lit(False)) if guarded else F.lit(False)})
    kept = asked.select("id", "question_number", "score", "_guarded", "_text")
    seen = kept.where("_guarded").mapInArrow(run, T.StructType([*kept.drop("_text").schema, T.StructField("_met", T.BooleanType())]))
    rows = seen.unionByName(kept.where("not _guarded").drop("_text").withColumn("_met", F.lit(True)))
    return rows.select("id", "question_number", F.when(F.col("_met"), F.col("score")).otherwise(0.0).alias("score"), (~F.col("_met")).alias("possible_rubric_swap"))


def default_grades(answers: DataFrame) -> DataFrame:
    """default rows for answers(id, cause): no rubric (score null), grading error or model failure (score 0), all for review."""
    cause = F.col("cause")
    # Causes and what is said of them.
    said = F.when(cause == "no_rubric", "Questão sem rubrica cadastrada.").when(cause == "grading_error", "Erro na correção automática.").otherwise("Falha do modelo de correção.")
    verdict_ = F.when(cause == "no_rubric", "sem_rubrica").otherwise("erro")
    return answers.select("id", F.when(cause != "no_rubric", 0.0).alias("score"), verdict_.alias("verdict"), F.lit(True).alias("needs_human_review"), said.alias("review_reason"))


def word_coverage(answers: DataFrame) -> DataFrame:
    """F15's native half and F16 for every (answer, key): coverage and sides of the normal forms."""
    a, k = normal_form(F.col("answer")), normal_form(F.col("key"))
    rows = answers.withColumns({"a": a, "k": k})
    return rows.select("id", coverage(F.col("a"), F.col("k")).alias("coverage"), laterality(F.col("a")).alias("side"), same_side(F.col("a"), F.col("k")).alias("side_ok"))


def order_window(*keys: str, by: list) -> F.Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
