"""Grade rules as column expressions: clamping, verdicts, review decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import blank, decimal_or_null, first_filled, quarter, strip, truthy_text, word_count

# Review reasons as reports show them.
ALIGNMENT = "Falha no alinhamento/crop da página."
OCR_FAILED = "Falha no OCR: "
BAD_FORMAT = "Resposta da IA em formato inválido ou nota fora do intervalo."
LOW_GRADING = "Confiança da correção automática abaixo do limiar (0,70)."
LOW_OCR = "Confiança do OCR abaixo do limiar (0,70)."
SHORT_TEXT = "Texto extraído vazio ou muito curto (menos de 3 palavras)."
UNSTABLE_OCR = "OCR instável (fallback necessário) e sem transcrição visual alternativa."
LONG_ZERO = "Nota zero com resposta longa — possível erro de leitura ou interpretação."
PARSE_COMMENT = "Resposta da IA em formato inválido. Revisão manual necessária."
PARSE_ERROR = "erro_parse"
NO_JUSTIFICATION = "Justificativa obrigatória ausente para nota parcial ou zero."
MODEL_ASKED = "IA sinalizou revisão manual."
COPIED = "Resposta parece cópia do enunciado da questão."
OFF_SCALE = "Nota fora do formato esperado; revisão manual necessária."
LOW_READING = "Leitura visual com baixa confiança."
VERDICTS = ("correta", "parcial", "incorreta", "sem_resposta", "ilegivel")


def clamp_grade(raw: Column) -> Column:
    """struct(value, off_scale); nearest of 0, .25, .5, .75, 1, ties down; what isn't a number is 0 and off scale."""
    v = decimal_or_null(raw)
    near = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.ceil(v * 4 - 0.5) / 4))
    value = F.coalesce(near, F.lit(0.0))
    return F.struct(value.alias("value"), (v.isNull() | (v != value)).alias("off_scale"))


def verdict(said: Column, answer: Column, confidence: Column, score: Column) -> Column:
    """an allowed verdict is kept, else it follows from answer, reading confidence and score."""
    told = F.lower(strip(F.coalesce(said, F.lit(""))))
    unreadable = (confidence == "baixa") & (F.contains(answer, F.lit("[ilegível]")) | F.contains(answer, F.lit("[ilegivel]")))
    return (
        F.when(told.isin(*VERDICTS), told).when(answer == "", "sem_resposta").when(unreadable, "ilegivel")
        .when(score >= 0.99, "correta").when(score > 0, "parcial").otherwise("incorreta")
    )


def reading_confidence(c: Column) -> Column:
    """alta, media or baixa; spellings of media join it, anything else is baixa."""
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(t.isin("alta", "media", "baixa"), t).when(t.isin("média", "medio", "médio"), "media").otherwise("baixa")


def review_reason(
    *, alignment_failed: Column, ocr_error: Column, fallback_ok: Column, parse_failed: Column, score: Column, max_score: Column,
    grading_confidence: Column, ocr_confidence: Column, text: Column, needs_fallback: Column, justification: Column,
    model_asked: Column, model_reason: Column,
) -> Column:
    """F8: the first rule that asks for review gives the reason; null where none does."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(alignment_failed, ALIGNMENT)
        .when(first_filled(ocr_error).isNotNull() & ~fallback_ok, F.concat(F.lit(OCR_FAILED), ocr_error))
        .when(parse_failed, BAD_FORMAT)
        .when((score < 0) | (score > max_score + 1e-6), F.concat(F.lit("Nota fora do intervalo permitido (0–"), max_score.cast("string"), F.lit(").")))
        .when(grading_confidence.isNull() | F.isnan(grading_confidence) | (F.abs(grading_confidence) == float("inf")) | (grading_confidence < 0.70), LOW_GRADING)
        .when(ocr_confidence < 0.70, LOW_OCR)
        .when(blank(text) | (word_count(text) < 3), SHORT_TEXT)
        .when(needs_fallback & ~fallback_ok, UNSTABLE_OCR)
        .when((score <= 0) & (F.length(strip(text)) > 200), LONG_ZERO)
        .when(((score < max_score) | (score <= 0)) & blank(justification), NO_JUSTIFICATION)
        .when(model_asked, F.coalesce(first_filled(model_reason), F.lit(MODEL_ASKED)))
    )


def forced_review(illegible: Column, grading_confidence: Column, score: Column, text: Column, parse_failed: Column) -> Column:
    """the four rules of the written policy."""
    return illegible | (grading_confidence < 0.70) | ((score == 0) & (F.length(text) > 200)) | parse_failed


def identity_override(identity_source: Column, alignment_failed: Column, required: Column, reason: Column, final: Column) -> Column:
    """struct(required, reason, final): a source other than the QR code, or a failed alignment, forces review."""
    weak = identity_source != "qr"
    forced = F.coalesce(weak, F.lit(False)) | alignment_failed
    why = F.when(weak, F.concat(F.lit("Vinculação sem QR confiável ("), identity_source, F.lit("). Conferir aluno/página."))).when(alignment_failed, ALIGNMENT)
    return F.struct((required | forced).alias("required"), F.coalesce(first_filled(reason), why).alias("reason"), F.when(~forced, final).alias("final"))


def single_grade(g: Column, max_default: float = 1.0) -> Column:
    """F3 over a map of text values: struct(question_number, score, max_score, confidence, justification, review, parse_ok).

    Alias keys give way to the first; score, maximum or English confidence that can't be read fail the parse; a score without end is 0.
    A review mark counts unless it is empty, false or zero. The values are picked and read once, then judged: without the step between, each would
    stand in the result many times over, in code too long for the JVM to compile.
    """

    def pick(*names: str) -> Column:
        return F.coalesce(*[g[n] for n in names])

    def number(c: Column, default: float) -> Column:
        return F.when(c.isNull(), F.lit(default)).otherwise(strip(c).try_cast("double"))

    read = F.struct(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), number(pick("max_score", "nota_maxima"), max_default))).alias("top"), number(pick("score", "nota"), 0.0).alias("raw"),
        number(pick("grading_confidence", "confianca"), 0.0).alias("told"), pick("question_number", "questao").alias("number"), pick("justification", "comentario").alias("why"),
        pick("manual_review_required", "revisao_necessaria").alias("mark"), g["grading_confidence"].isNotNull().alias("english"), g.isNull().alias("none"),
    )
    return F.get(F.transform(F.array(read), lambda r: _judged(r, max_default)), F.lit(0))


def _judged(r: Column, max_default: float) -> Column:
    """What F3 makes of the values read."""
    top, raw, told = r["top"], r["raw"], r["told"]
    outside = F.isnan(raw) | (raw < -1e-6) | (raw > top + 1e-6)
    endless = F.isnan(raw) | (F.abs(raw) == float("inf"))
    score = quarter(F.least(F.greatest(F.when(endless, 0.0).otherwise(raw), F.lit(0.0)), top))
    bad_confidence = told.isNull() | F.isnan(told)
    broken = r["none"] | raw.isNull() | top.isNull() | (r["english"] & told.isNull())
    confidence = F.when(bad_confidence, 0.0).otherwise(F.least(F.greatest(told, F.lit(0.0)), F.lit(1.0)))
    return F.struct(
        r["number"].try_cast("int").alias("question_number"),
        F.when(broken, 0.0).otherwise(score).alias("score"), F.coalesce(top, F.lit(max_default)).alias("max_score"),
        F.when(broken, 0.0).otherwise(confidence).alias("confidence"), F.coalesce(r["why"], F.lit("")).alias("justification"),
        (broken | F.coalesce(truthy_text(r["mark"]), F.lit(False))).alias("review"),
        F.coalesce(~broken & ~outside & ~bad_confidence, F.lit(False)).alias("parse_ok"),
    )


def cap_grade(score: Column, max_score: Column) -> Column:
    """At most the question's maximum (1.0 if unknown), nearest quarter, never below zero."""
    return F.greatest(F.lit(0.0), quarter(F.least(score, F.coalesce(max_score, F.lit(1.0)))))
