"""Score, review, report and history queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grades import clamp_grade, forced_review, identity_override, review_reason
from ..functions.values import quarter, word_count
from ..operators import reports, review, scores
from .fixtures import Views
from .registry import query


def r6(c) -> Column:
    return F.round(c, 6)


def listed(c) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


REVIEW_SQL = """
  CASE WHEN alignment_failed THEN 'Falha no alinhamento/crop da página.'
    WHEN coalesce(ocr_error, '') <> '' AND NOT fallback_ok THEN 'Falha no OCR: ' || ocr_error
    WHEN parse_failed THEN 'Resposta da IA em formato inválido ou nota fora do intervalo.'
    WHEN score < 0 OR score > max_score + 1e-6 THEN 'Nota fora do intervalo permitido (0–' || CAST(max_score AS VARCHAR) || ').'
    WHEN grading_confidence IS NULL OR grading_confidence < 0.70 THEN 'Confiança da correção automática abaixo do limiar (0,70).'
    WHEN ocr_confidence < 0.70 THEN 'Confiança do OCR abaixo do limiar (0,70).'
    WHEN words < 3 THEN 'Texto extraído vazio ou muito curto (menos de 3 palavras).'
    WHEN (words < 3 OR coalesce(ocr_confidence < 0.70, FALSE)) AND NOT fallback_ok THEN 'OCR instável (fallback necessário) e sem transcrição visual alternativa.'
    WHEN score <= 0 AND length(trim(text)) > 200 THEN 'Nota zero com resposta longa — possível erro de leitura ou interpretação.'
    WHEN (score < max_score OR score <= 0) AND trim(justification) = '' THEN 'Justificativa obrigatória ausente para nota parcial ou zero.'
    WHEN model_flag THEN coalesce(model_reason, 'IA sinalizou revisão manual.') END"""
WORDS = "(SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS words FROM fx_review)"


def decided(v: Views) -> DataFrame:
    """fx_review with reason and flag by F8."""
    c = F.col
    fallback = (word_count(c("text")) < 3) | F.coalesce(c("ocr_confidence") < 0.70, F.lit(False))
    reason = review_reason(
        alignment_failed=c("alignment_failed"), ocr_error=c("ocr_error"), fallback_ok=c("fallback_ok"), parse_failed=c("parse_failed"), score=c("score"),
        max_score=c("max_score"), grading_confidence=c("grading_confidence"), ocr_confidence=c("ocr_confidence"), text=c("text"), needs_fallback=fallback,
        justification=c("justification"), model_asked=c("model_flag"), model_reason=c("model_reason"),
    )
    return v["fx_review"].withColumn("reason", reason)


@query("batch_report", f"""
WITH d AS (SELECT student_result_id, question_number, score, {REVIEW_SQL} AS reason FROM {WORDS} w),
s AS (SELECT student_result_id, sum(score) AS total, bool_or(reason IS NOT NULL) AS pending, count(*) AS n, sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) AS settled FROM d GROUP BY 1),
q AS (SELECT exam_id, count(*) AS n FROM fx_questions GROUP BY 1),
b AS (SELECT r.batch_id, bool_or(coalesce(s.pending, FALSE)) AS pending FROM fx_results r LEFT JOIN s ON s.student_result_id = r.id GROUP BY 1)
SELECT r.id AS student_result_id, r.batch_id, round(coalesce(s.total, 0), 6) AS total_score, CASE WHEN coalesce(s.pending, FALSE) THEN 'GRADED' ELSE 'AUTO_APPROVED' END AS status,
       CASE WHEN q.n > 0 THEN round_even(round(coalesce(s.total, 0), 6) / q.n * 4, 0) / 4 ELSE 0.0 END AS mark, CASE WHEN b.pending THEN 'REVIEW_PENDING' ELSE 'DONE' END AS batch_status
FROM fx_results r LEFT JOIN s ON s.student_result_id = r.id JOIN fx_batches x ON x.id = r.batch_id LEFT JOIN q ON q.exam_id = x.exam_id JOIN b ON b.batch_id = r.batch_id""")
def batch_report(v: Views) -> DataFrame:
    """Flagship: repeats out, review decided, totals, marks and statuses per result and batch; one aggregate feeds all of them."""
    per = decided(v).groupBy("student_result_id").agg(r6(F.sum("score")).alias("t"), F.bool_or(F.col("reason").isNotNull()).alias("p"))
    n = v["fx_questions"].groupBy("exam_id").agg(F.count("*").alias("n"))
    joined = v["fx_results"].join(per, F.col("id") == F.col("student_result_id"), "left").select("id", "batch_id", F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("p", F.lit(False)).alias("p"))
    batch = joined.groupBy("batch_id").agg(F.bool_or("p").alias("bp"))
    exam = v["fx_batches"].select(F.col("id").alias("batch_id"), "exam_id").join(n, "exam_id", "left").join(batch, "batch_id")
    return joined.join(exam, "batch_id").select(
        F.col("id").alias("student_result_id"), "batch_id", F.col("t").alias("total_score"), F.when(F.col("p"), "GRADED").otherwise("AUTO_APPROVED").alias("status"),
        F.when(F.col("n") > 0, quarter(F.col("t") / F.col("n"))).otherwise(0.0).alias("mark"), F.when(F.col("bp"), "REVIEW_PENDING").otherwise("DONE").alias("batch_status"),
    )


@query("f8_review_decision", f"SELECT id, student_result_id, question_number, {REVIEW_SQL} AS reason FROM {WORDS} w")
def _(v):
    return decided(v).select("id", "student_result_id", "question_number", "reason")


@query("f9_forced_review", "SELECT id, student_result_id, question_number, alignment_failed OR grading_confidence < 0.70 OR (score = 0 AND length(text) > 200) OR parse_failed AS forced FROM fx_review")
def _(v):
    c = F.col
    return v["fx_review"].select("id", "student_result_id", "question_number", forced_review(c("alignment_failed"), c("grading_confidence"), c("score"), c("text"), c("parse_failed")).alias("forced"))


@query("f10_identity_override", """
SELECT s.id, s.student_result_id, s.question_number, s.requires_manual_review OR r.identity_source <> 'qr' OR s.box_pos % 50 = 0 AS required,
       CASE WHEN s.model_flag THEN 'dado' WHEN r.identity_source <> 'qr' THEN 'Vinculação sem QR confiável (' || r.identity_source || '). Conferir aluno/página.'
            WHEN s.box_pos % 50 = 0 THEN 'Falha no alinhamento/crop da página.' END AS reason,
       CASE WHEN r.identity_source <> 'qr' OR s.box_pos % 50 = 0 THEN NULL ELSE s.final_score END AS final
FROM fx_scored s JOIN fx_results r ON r.id = s.student_result_id""")
def _(v):
    j = v["fx_scored"].join(v["fx_results"].select(F.col("id").alias("student_result_id"), "identity_source"), "student_result_id")
    o = identity_override(F.col("identity_source"), F.col("box_pos") % 50 == 0, F.col("requires_manual_review"), F.when(F.col("model_flag"), "dado"), F.col("final_score"))
    return j.withColumn("o", o).select("id", "student_result_id", "question_number", "o.required", "o.reason", "o.final")


@query("f1_quarter", "SELECT id, student_result_id, question_number, round_even(ai_score * ocr_confidence * 4, 0) / 4 AS rounded FROM fx_scored")
def _(v):
    return v["fx_scored"].select("id", "student_result_id", "question_number", quarter(F.col("ai_score") * F.col("ocr_confidence")).alias("rounded"))


@query("f2_clamp_grade", """
SELECT id, student_result_id, question_number, CASE WHEN question_number = 7 THEN 0.0 ELSE least(1.0, greatest(0.0, ceil(x * 4 - 0.5) / 4)) END AS value,
       question_number = 7 OR x <> least(1.0, greatest(0.0, ceil(x * 4 - 0.5) / 4)) AS off_scale
FROM (SELECT *, CASE WHEN question_number = 6 THEN 1.75 ELSE ai_score * 1.25 END AS x FROM fx_scored) t""")
def _(v):
    text = F.when(F.col("question_number") == 7, "0.75d").when(F.col("question_number") == 6, " 1,75 ").otherwise(F.replace((F.col("ai_score") * 1.25).cast("string"), F.lit("."), F.lit(",")))
    return v["fx_scored"].withColumn("g", clamp_grade(text)).select("id", "student_result_id", "question_number", "g.value", "g.off_scale")


@query("w1_dedupe_first", "SELECT student_result_id, question_number, id, source_page_number, box_pos FROM (SELECT *, row_number() OVER (PARTITION BY student_result_id, question_number ORDER BY source_page_number, box_pos, id) AS p FROM fx_scores) t WHERE p = 1")
def _(v):
    return scores.dedupe_first(v["fx_scores"]).select("student_result_id", "question_number", "id", "source_page_number", "box_pos")


@query("w2_dedupe_latest", "SELECT student_result_id, question_number, max(id) AS id FROM fx_scores GROUP BY 1, 2")
def _(v):
    return scores.dedupe_latest(v["fx_scores"]).select("student_result_id", "question_number", "id")


@query("a1_student_totals", "SELECT student_result_id, round(sum(coalesce(final_score, ai_score, 0)), 6) AS total_score FROM fx_scored GROUP BY 1")
def _(v):
    return scores.student_totals(v["fx_scored"]).withColumn("total_score", r6("total_score"))


@query("a2_student_status", """
SELECT r.id, round(coalesce(t, 0), 6) AS total_score, CASE WHEN coalesce(p, FALSE) THEN 'GRADED' ELSE 'AUTO_APPROVED' END AS status
FROM fx_results r LEFT JOIN (SELECT student_result_id, sum(coalesce(final_score, ai_score, 0)) AS t, bool_or(requires_manual_review) AS p FROM fx_scored GROUP BY 1) s ON s.student_result_id = r.id""")
def _(v):
    return scores.student_status(v["fx_results"], v["fx_scored"]).withColumn("total_score", r6("total_score"))


@query("a2_finalised", "SELECT student_result_id, question_number, id, CASE WHEN NOT requires_manual_review THEN coalesce(final_score, ai_score) ELSE final_score END AS final_score FROM fx_scored")
def _(v):
    return scores.finalised(v["fx_scored"]).select("student_result_id", "question_number", "id", "final_score")


@query("a3_batch_status", """
SELECT batch_id, CASE WHEN bool_or(coalesce(p, FALSE)) THEN 'REVIEW_PENDING' ELSE 'DONE' END AS status
FROM fx_results r LEFT JOIN (SELECT student_result_id, bool_or(requires_manual_review) AS p FROM fx_scored GROUP BY 1) s ON s.student_result_id = r.id GROUP BY 1""")
def _(v):
    return scores.batch_status(v["fx_results"], v["fx_scored"])


@query("a4_batch_stats", """
SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'AUTO_APPROVED') AS auto_approved, count(*) FILTER (status = 'REVIEWED') AS reviewed,
       count(*) FILTER (id IN (SELECT student_result_id FROM fx_scored WHERE requires_manual_review)) AS pending_review FROM fx_results GROUP BY 1""")
def _(v):
    return scores.batch_stats(v["fx_results"], v["fx_scored"])


@query("a12_final_mark", """
SELECT e.student_result_id, CASE WHEN n > 0 THEN round_even(coalesce(s, 0) / n * 4, 0) / 4 ELSE 0.0 END AS mark
FROM fx_exam_of e LEFT JOIN (SELECT student_result_id, round(sum(coalesce(final_score, ai_score)), 6) AS s FROM fx_scored GROUP BY 1) t ON t.student_result_id = e.student_result_id
LEFT JOIN (SELECT exam_id, count(*) AS n FROM fx_questions GROUP BY 1) q ON q.exam_id = e.exam_id""")
def _(v):
    return scores.final_mark(v["fx_scored"], v["fx_exam_of"], v["fx_questions"])


@query("a14_complete_grades", """
WITH g AS (SELECT s.student_result_id AS result_id, e.exam_id, CAST(s.question_number AS INT) + CASE WHEN s.box_pos % 40 = 0 THEN 20 ELSE 0 END AS question_number, s.ai_score * 1.5 AS score
           FROM fx_scored s JOIN fx_exam_of e ON e.student_result_id = s.student_result_id),
have AS (SELECT result_id, g.exam_id, g.question_number, greatest(0.0, round_even(least(coalesce(score, 0), coalesce(max_score, 1.0)) * 4, 0) / 4) AS score, coalesce(max_score, 1.0) AS max_score
         FROM g LEFT JOIN fx_questions q ON q.exam_id = g.exam_id AND q.question_number = g.question_number)
SELECT * FROM have UNION ALL
SELECT w.result_id, w.exam_id, q.question_number, 0.0, q.max_score FROM (SELECT DISTINCT result_id, exam_id FROM g) w JOIN fx_questions q ON q.exam_id = w.exam_id
WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.result_id = w.result_id AND g.question_number = q.question_number)""")
def _(v):
    g = v["fx_scored"].join(v["fx_exam_of"], "student_result_id").select(
        F.col("student_result_id").alias("result_id"), "exam_id", (F.col("question_number").cast("int") + F.when(F.col("box_pos") % 40 == 0, 20).otherwise(0)).alias("question_number"), (F.col("ai_score") * 1.5).alias("score"))
    return scores.complete_grades(g, v["fx_questions"])


@query("a15_batch_summary", """
SELECT batch_id, round(avg(t), 6) AS mean_total, round(min(t), 6) AS min_total, round(max(t), 6) AS max_total, round(stddev_samp(t), 6) AS sd_total
FROM fx_results r JOIN (SELECT student_result_id, sum(coalesce(final_score, ai_score, 0)) AS t FROM fx_scored GROUP BY 1) s ON s.student_result_id = r.id GROUP BY 1""")
def _(v):
    got = scores.batch_summary(v["fx_results"], scores.student_totals(v["fx_scored"]))
    return got.select("batch_id", *[r6(c).alias(c) for c in ("mean_total", "min_total", "max_total", "sd_total")])


@query("a16_question_difficulty", """
SELECT question_number, round(avg(coalesce(final_score, ai_score, 0)), 6) AS share_of_points, round(avg(CASE WHEN coalesce(final_score, ai_score, 0) >= 0.99 THEN 1.0 ELSE 0.0 END), 6) AS share_correct, count(*) AS answers FROM fx_scored GROUP BY 1""")
def _(v):
    got = scores.question_difficulty(v["fx_scored"])
    return got.select("question_number", r6("share_of_points").alias("share_of_points"), r6("share_correct").alias("share_correct"), "answers")


@query("a17_final_scores", "SELECT student_result_id, round(sum(coalesce(final_score, ai_score, 0)), 6) AS total_score, bool_and(NOT requires_manual_review) AS reviewed_by_all FROM fx_scored GROUP BY 1")
def _(v):
    return scores.final_scores(v["fx_scored"]).withColumn("total_score", r6("total_score"))


@query("a18_batch_progress", """
SELECT b.id AS batch_id, count(DISTINCT r.page_number) AS pages_done, count(r.id) AS results_done,
       CASE WHEN max(b.total_pages) > 0 THEN round(least(100.0, 100.0 * count(DISTINCT r.page_number) / max(b.total_pages)), 2) ELSE 0.0 END AS percent
FROM fx_batches b LEFT JOIN fx_results r ON r.batch_id = b.id GROUP BY b.id""")
def _(v):
    return scores.batch_progress(v["fx_batches"], v["fx_results"])


@query("a19_remaining_pending", "SELECT count(DISTINCT r.id) AS remaining FROM fx_results r WHERE r.id IN (SELECT student_result_id FROM fx_scored WHERE requires_manual_review)")
def _(v):
    return scores.remaining_pending(v["fx_results"], v["fx_scored"])


@query("a20_source_pages", "SELECT student_result_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS pages FROM (SELECT DISTINCT student_result_id, source_page_number AS p FROM fx_scores) t GROUP BY 1")
def _(v):
    return scores.source_pages(v["fx_scores"]).withColumn("pages", listed("pages"))


@query("j7_pending_results", "SELECT id, batch_id, status FROM fx_results WHERE id IN (SELECT student_result_id FROM fx_scored WHERE requires_manual_review)")
def _(v):
    return scores.pending_results(v["fx_results"], v["fx_scored"]).select("id", "batch_id", "status")


@query("o1_review_queue", """
SELECT r.id, r.batch_id, r.page_number, r.status FROM fx_results r JOIN fx_batches b ON b.id = r.batch_id
WHERE r.status NOT IN ('REVIEWED', 'AUTO_APPROVED') AND r.id IN (SELECT student_result_id FROM fx_scored WHERE requires_manual_review)
ORDER BY b.created_at DESC, r.page_number, r.id LIMIT 10""")
def _(v):
    return review.review_queue(v["fx_results"], v["fx_scored"], v["fx_batches"], 10)


LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY student_result_id, question_number ORDER BY ts DESC, event_id DESC) AS p FROM fx_updates) t WHERE p = 1)"


@query("m1_apply_updates", f"""
SELECT s.student_result_id, s.question_number, s.id, CASE WHEN u.event_id IS NOT NULL THEN u.final_score ELSE s.final_score END AS final_score,
       s.requires_manual_review AND u.event_id IS NULL AS requires_manual_review, u.comment AS professor_comment
FROM fx_scored s LEFT JOIN {LATEST} u ON u.student_result_id = s.student_result_id AND u.question_number = s.question_number""")
def _(v):
    got = review.apply_score_updates(v["fx_scored"], v["fx_updates"])
    return got.select("student_result_id", "question_number", "id", "final_score", "requires_manual_review", "professor_comment")


@query("m1_totals_after", f"""
SELECT s.student_result_id, round(sum(CASE WHEN u.event_id IS NOT NULL THEN u.final_score ELSE coalesce(s.final_score, s.ai_score, 0) END), 6) AS total_score
FROM fx_scored s LEFT JOIN {LATEST} u ON u.student_result_id = s.student_result_id AND u.question_number = s.question_number GROUP BY 1""")
def _(v):
    return review.after_updates(v["fx_results"], review.apply_score_updates(v["fx_scored"], v["fx_updates"]))[0].withColumn("total_score", r6("total_score"))


@query("m2_approved_results", "SELECT id, batch_id, CASE WHEN id IN (SELECT student_result_id FROM fx_approvals) THEN 'REVIEWED' ELSE status END AS status FROM fx_results")
def _(v):
    return review.apply_approvals(v["fx_results"], v["fx_scored"], v["fx_approvals"])[0].select("id", "batch_id", "status")


@query("m2_approved_scores", """
SELECT student_result_id, question_number, id, CASE WHEN a AND requires_manual_review THEN coalesce(final_score, ai_score) ELSE final_score END AS final_score, requires_manual_review AND NOT a AS requires_manual_review
FROM (SELECT *, student_result_id IN (SELECT student_result_id FROM fx_approvals) AS a FROM fx_scored) t""")
def _(v):
    return review.apply_approvals(v["fx_results"], v["fx_scored"], v["fx_approvals"])[1].select("student_result_id", "question_number", "id", "final_score", "requires_manual_review")


PATCHES = """SELECT DISTINCT run_id, page_number, question_number, CASE WHEN page_number % 2 = 0 THEN CONCAT('novo ', CAST(page_number AS STRING)) END AS new_text,
  CASE WHEN page_number % 3 = 0 THEN NULL ELSE CAST(0.75 AS DOUBLE) END AS new_score, page_number % 4 = 0 AS new_review, CASE WHEN page_number % 5 = 0 THEN '' ELSE 'motivo' END AS new_reason
  FROM fx_answers WHERE page_number <= 12 AND question_number > 0"""


@query("m3_patch_answers", f"""
SELECT a.id, coalesce(p.new_text, a.answer_transcription) AS answer_transcription, CASE WHEN p.run_id IS NOT NULL THEN p.new_score ELSE a.score END AS score,
       CASE WHEN p.run_id IS NOT NULL THEN p.new_review ELSE a.needs_human_review END AS needs_human_review, nullif(p.new_reason, '') AS review_reason
FROM fx_answers a LEFT JOIN ({PATCHES}) p ON p.run_id = a.run_id AND p.page_number = a.page_number AND p.question_number = a.question_number""")
def _(v):
    return review.patch_answers(v["fx_answers"], v.sql(PATCHES)).select("id", "answer_transcription", "score", "needs_human_review", "review_reason")


INCOMING = """SELECT class_id, registration_number, name, CASE WHEN id % 2 = 0 THEN CONCAT(curso, ' II') ELSE curso END AS curso, id AS line_no FROM fx_students WHERE id % 3 <> 0
  UNION ALL SELECT class_id, CONCAT('N', registration_number), name, curso, id + 100000000 AS line_no FROM fx_students WHERE id % 10 = 0
  UNION ALL SELECT class_id, CONCAT('N', registration_number), CONCAT(name, ' X'), curso, id + 200000000 AS line_no FROM fx_students WHERE id % 20 = 0"""
UPSERTED = f"""
inc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class_id, registration_number ORDER BY line_no DESC) AS p FROM ({INCOMING}) i) t WHERE p = 1),
up AS (SELECT s.id, coalesce(s.class_id, i.class_id) AS class_id, coalesce(s.registration_number, i.registration_number) AS registration_number,
  CASE WHEN i.p = 1 THEN i.name ELSE s.name END AS name, CASE WHEN i.p = 1 THEN i.curso ELSE s.curso END AS curso,
  CASE WHEN s.id IS NULL THEN 'inserted' WHEN i.p = 1 AND (i.name IS DISTINCT FROM s.name OR i.curso IS DISTINCT FROM s.curso) THEN 'updated' ELSE 'same' END AS change
  FROM fx_students s FULL JOIN inc i ON i.class_id = s.class_id AND i.registration_number = s.registration_number)"""


@query("m4_upsert_roster", f"WITH {UPSERTED} SELECT * FROM up")
def _(v):
    return review.upsert_roster(v["fx_students"], v.sql(INCOMING))


@query("m4_roster_counts", f"WITH {UPSERTED} SELECT count(*) FILTER (change = 'inserted') AS inserted, count(*) FILTER (change = 'updated') AS updated FROM up")
def _(v):
    return review.roster_counts(review.upsert_roster(v["fx_students"], v.sql(INCOMING)))


NEW_QUESTIONS = "SELECT id + 2 AS id, exam_id, question_number, 'novo' AS question_text, expected_answer, CAST(2.0 AS DOUBLE) AS max_score FROM fx_questions WHERE id % 3 = 0"


@query("m5_upsert_questions", f"SELECT * FROM fx_questions WHERE id NOT IN (SELECT id FROM ({NEW_QUESTIONS}) n) UNION ALL {NEW_QUESTIONS}")
def _(v):
    return review.upsert(v["fx_questions"], v.sql(NEW_QUESTIONS), "id")


@query("j8_delete_exams", """
WITH gone AS (SELECT id FROM fx_batches WHERE exam_id IN (1, 3)), gr AS (SELECT id FROM fx_results WHERE batch_id IN (SELECT id FROM gone))
SELECT 'batches' AS kind, count(*) AS n FROM fx_batches WHERE id NOT IN (SELECT id FROM gone) UNION ALL
SELECT 'exams', count(*) FROM fx_exams WHERE id NOT IN (1, 3) UNION ALL SELECT 'questions', count(*) FROM fx_questions WHERE exam_id NOT IN (1, 3) UNION ALL
SELECT 'results', count(*) FROM fx_results WHERE id NOT IN (SELECT id FROM gr) UNION ALL SELECT 'scores', count(*) FROM fx_scored WHERE student_result_id NOT IN (SELECT id FROM gr)""")
def _(v):
    keys = v["fx_exams"].where("id in (1, 3)").select(F.col("id").alias("exam_id"))
    left = review.delete_exams(keys, v["fx_exams"], v["fx_questions"], v["fx_batches"], v["fx_results"], v["fx_scored"])
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in left.items()]
    out = counts[0]
    for df in counts[1:]:
        out = out.unionByName(df)
    return out


@query("j8_delete_classes", "SELECT r.id, CASE WHEN s.class_id % 4 = 0 THEN NULL ELSE r.student_id END AS student_id FROM fx_results r LEFT JOIN fx_students s ON s.id = r.student_id")
def _(v):
    keys = v["fx_classes"].where("id % 4 = 0").select(F.col("id").alias("class_id"))
    return review.delete_classes(keys, v["fx_students"], v["fx_results"])[1].select("id", "student_id")


@query("j1_result_detail", """
WITH s AS (SELECT s.student_result_id, CASE WHEN s.box_pos % 50 = 0 THEN 9999 ELSE e.exam_id * 8 + s.question_number - 1 END AS question_id, s.ai_score, s.final_score
           FROM fx_scored s JOIN fx_exam_of e ON e.student_result_id = s.student_result_id),
n AS (SELECT student_result_id, string_agg(q.question_number || ':' || s.ai_score, ',' ORDER BY q.question_number) AS items FROM s JOIN fx_questions q ON q.id = s.question_id GROUP BY 1)
SELECT r.id, t.name, t.registration_number, n.items FROM fx_results r JOIN n ON n.student_result_id = r.id LEFT JOIN fx_students t ON t.id = r.student_id""")
def _(v):
    s = v["fx_scored"].join(v["fx_exam_of"], "student_result_id").select("student_result_id", F.when(F.col("box_pos") % 50 == 0, 9999).otherwise(F.col("exam_id") * 8 + F.col("question_number") - 1).alias("question_id"), "ai_score", "final_score")
    got = reports.result_detail(v["fx_results"], s, v["fx_questions"], v["fx_students"])
    text = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["question_number"].cast("string"), x["ai_score"].cast("string"))), ",")
    return got.withColumn("items", text)


LOST = "SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE student_id END AS student_id, batch_id, page_number FROM fx_results"
CLASSY = "SELECT id, name, registration_number, curso, CASE WHEN id % 5 = 0 THEN NULL ELSE class_id END AS class_id FROM fx_students"
EXPORT_SQL = f"""SELECT r.id AS student_result_id, coalesce(s.name, 'Aluno (pág. ' || r.page_number || ')') AS student_name, coalesce(s.registration_number, 'P' || r.page_number) AS registration_number,
  coalesce(s.curso, '') AS curso, coalesce(c.name, CASE WHEN s.id IS NOT NULL THEN '—' ELSE '' END) AS turma
  FROM ({LOST}) r LEFT JOIN ({CLASSY}) s ON s.id = r.student_id LEFT JOIN fx_classes c ON c.id = s.class_id"""


@query("j2_export_rows", EXPORT_SQL)
def _(v):
    return reports.export_rows(v.sql(LOST), v.sql(CLASSY), v["fx_classes"])


@query("s7_report_summary", f"""
WITH e AS ({EXPORT_SQL}), t AS (SELECT student_result_id, round(sum(coalesce(final_score, ai_score)), 6) AS s, bool_or(requires_manual_review) AS p FROM fx_scored GROUP BY 1), q AS (SELECT exam_id, count(*) AS n FROM fx_questions GROUP BY 1)
SELECT e.*, CASE WHEN q.n > 0 THEN round_even(coalesce(t.s, 0) / q.n * 4, 0) / 4 ELSE 0.0 END AS mark, CASE WHEN coalesce(t.p, FALSE) THEN 'GRADED' ELSE 'AUTO_APPROVED' END AS status
FROM e LEFT JOIN t ON t.student_result_id = e.student_result_id JOIN fx_exam_of x ON x.student_result_id = e.student_result_id LEFT JOIN q ON q.exam_id = x.exam_id""")
def _(v):
    export = reports.export_rows(v.sql(LOST), v.sql(CLASSY), v["fx_classes"])
    return reports.report_summary(export, scores.final_mark(v["fx_scored"], v["fx_exam_of"], v["fx_questions"]), scores.student_status(v["fx_results"], v["fx_scored"]))


FRIENDLY = """CASE WHEN trim(text) = '' OR contains(t, 'sem resposta') OR contains(t, 'resposta vazia') THEN 'Resposta em branco ou não detectada.'
  WHEN contains(t, 'cópia do enunciado') OR contains(t, 'copia do enunciado') THEN 'Resposta parece cópia do enunciado da questão.'
  WHEN contains(t, 'schema incompleto') OR contains(t, 'json') THEN 'Falha no formato da resposta da IA. Conferir nota sugerida.'
  WHEN contains(t, 'expecting property name') THEN 'Falha ao interpretar resposta da IA. Revisão manual recomendada.'
  WHEN contains(t, 'identity_source') OR contains(t, 'manifest_fallback') OR contains(t, 'sem qr confiável') THEN 'Vinculação do aluno feita sem QR confiável. Conferir aluno.'
  WHEN coalesce(confidence < 0.70, FALSE) OR contains(t, 'baixa confiança') THEN 'Baixa confiança na leitura da resposta manuscrita.'
  WHEN contains(t, 'off-topic') OR contains(t, 'fora do tema') THEN 'Resposta fora do tema da questão.'
  WHEN trim(t, ' |') <> '' OR contains(t, '|') THEN 'Revisão manual recomendada.' ELSE '' END"""
NOTED = """SELECT s.id, s.student_result_id, s.question_number, s.text, s.grading_confidence AS confidence, s.model_flag AS needs_review, s.ocr_error AS error,
  CASE s.question_number WHEN 1 THEN 'Cópia do enunciado' WHEN 2 THEN 'schema incompleto' WHEN 3 THEN 'via manifest_fallback' WHEN 4 THEN 'fora do tema' WHEN 5 THEN 'algo' ELSE '' END AS w FROM fx_review s"""


@query("s7_report_reviews", f"SELECT id, student_result_id, question_number, {FRIENDLY} AS review_text FROM (SELECT *, lower(w || ' | ' || coalesce(error, '')) AS t FROM ({NOTED}) n) x WHERE needs_review")
def _(v):
    rows = v.sql(NOTED).withColumn("warnings", F.array("w"))
    return reports.report_reviews(reports.report_details(rows)).select("id", "student_result_id", "question_number", "review_text")


@query("p12_friendly_reason", f"SELECT id, student_result_id, question_number, {FRIENDLY} AS review_text FROM (SELECT *, lower(w || ' | ' || coalesce(error, '')) AS t FROM ({NOTED}) n) x")
def _(v):
    return reports.report_details(v.sql(NOTED).withColumn("warnings", F.array("w"))).select("id", "student_result_id", "question_number", "review_text")


@query("a6_exam_summary", "SELECT e.id, count(q.id) AS question_count FROM fx_exams e LEFT JOIN fx_questions q ON q.exam_id = e.id GROUP BY 1")
def _(v):
    return reports.exam_summary(v["fx_exams"], v["fx_questions"])


@query("a7_class_summary", "SELECT c.id, c.name, count(s.id) AS student_count FROM fx_classes c LEFT JOIN fx_students s ON s.class_id = c.id GROUP BY 1, 2 ORDER BY 2")
def _(v):
    return reports.class_summary(v["fx_classes"], v["fx_students"])


BATCH_HISTORY = """SELECT CAST(b.id AS VARCHAR) AS id, b.created_at, coalesce(x.students, 0) AS students, coalesce(x.scores, 0) AS scores, coalesce(x.pending, 0) AS pending FROM fx_batches b LEFT JOIN (
  SELECT r.batch_id, count(DISTINCT r.id) AS students, count(s.id) AS scores, count(*) FILTER (s.requires_manual_review) AS pending FROM fx_results r LEFT JOIN fx_scored s ON s.student_result_id = r.id GROUP BY 1) x ON x.batch_id = b.id"""
KEY_SQL = "coalesce(nullif(trim(detected_student_code), ''), nullif(trim(registration), ''), nullif(trim(student_name), ''), 'pagina-' || page_number)"
RUN_HISTORY = f"SELECT run_id, count(DISTINCT {KEY_SQL}) AS students, count(*) AS scores, count(*) FILTER (needs_human_review) AS pending FROM fx_answers GROUP BY 1"


@query("a8_batch_history", f"SELECT h.id, students, scores, pending FROM ({BATCH_HISTORY}) h JOIN fx_batches b ON CAST(b.id AS VARCHAR) = h.id WHERE b.user_id = 1")
def _(v):
    return reports.batch_history(v["fx_batches"], v["fx_results"], v["fx_scored"], 1).select("id", "students", "scores", "pending")


@query("a9_run_history", RUN_HISTORY)
def _(v):
    return reports.run_history(v["fx_answers"])


def _history(v: Views, limit: int) -> DataFrame:
    runs = reports.run_history(v["fx_answers"]).withColumnRenamed("run_id", "id").withColumn("created_at", F.lit(None).cast(v["fx_batches"].schema["created_at"].dataType))
    return reports.history(reports.batch_history(v["fx_batches"], v["fx_results"], v["fx_scored"]), runs, limit)


HISTORY = f"SELECT 'batch' AS kind, id, created_at, students, scores, pending FROM ({BATCH_HISTORY}) a UNION ALL SELECT 'visual', run_id, NULL, students, scores, pending FROM ({RUN_HISTORY}) b"


@query("o2_history", f"SELECT kind, id, students, scores, pending FROM ({HISTORY}) h ORDER BY created_at DESC NULLS LAST, kind, id LIMIT 90")
def _(v):
    return _history(v, 90).drop("created_at")


@query("a10_history_totals", f"SELECT count(*) AS items, count(*) FILTER (pending > 0) AS with_pending, CAST(sum(students) AS BIGINT) AS students FROM (SELECT * FROM ({HISTORY}) h ORDER BY created_at DESC NULLS LAST, kind, id LIMIT 200) t")
def _(v):
    return reports.history_totals(_history(v, 200))


@query("a11_run_rows", f"""
WITH k AS (SELECT *, {KEY_SQL} AS student_key, CASE WHEN needs_human_review THEN 'rev ' || id ELSE ' ' END AS reason FROM fx_answers),
last AS (SELECT run_id, student_key, question_number, score, row_number() OVER (PARTITION BY run_id, student_key, question_number ORDER BY page_number DESC, id DESC) AS p FROM k WHERE score IS NOT NULL),
tot AS (SELECT run_id, student_key, sum(score) AS total FROM last WHERE p = 1 GROUP BY 1, 2),
rs AS (SELECT run_id, student_key, string_agg(reason, '; ' ORDER BY page_number, question_number, id) AS reasons FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, student_key ORDER BY page_number, question_number, id) AS p FROM k WHERE trim(reason) <> '') t WHERE p <= 5 GROUP BY 1, 2)
SELECT k.run_id, k.student_key, arg_min(CASE WHEN trim(student_name) <> '' THEN trim(student_name) END, CAST(page_number AS BIGINT) * 100000000000 + CAST(question_number AS BIGINT) * 10000000000 + id) FILTER (trim(student_name) <> '') AS student_name,
  bool_or(needs_human_review) AS needs_review, count(*) AS answers, coalesce(any_value(rs.reasons), '') AS reasons, round(coalesce(any_value(tot.total), 0), 6) AS total
FROM k LEFT JOIN tot ON tot.run_id = k.run_id AND tot.student_key = k.student_key LEFT JOIN rs ON rs.run_id = k.run_id AND rs.student_key = k.student_key GROUP BY 1, 2""")
def _(v):
    reason = F.when(F.col("needs_human_review"), F.concat(F.lit("rev "), F.col("id").cast("string"))).otherwise(" ")
    return reports.run_rows(v["fx_answers"].withColumn("reason", reason)).withColumn("total", r6("total")).drop("registration")


@query("w5_last_non_empty", "SELECT run_id, question_number, arg_max(registration, CAST(page_number AS BIGINT) * 10000000000 + id) AS registration FROM fx_answers WHERE trim(registration) <> '' GROUP BY 1, 2")
def _(v):
    return reports.last_non_empty(v["fx_answers"], "registration", ["run_id", "question_number"])


@query("w8_top_n", "SELECT page_id, region_id, y FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, x, region_id) AS p FROM fx_boxes) t WHERE p <= 12")
def _(v):
    return reports.top_n(v["fx_boxes"], ["page_id"], ["y", "x", "region_id"], 12).select("page_id", "region_id", "y")


CODE = """CASE WHEN NOT (contains(t, 'falha') OR contains(t, 'json')) THEN 'STUDENT_LINK_WEAK' WHEN contains(t, 'rubrica') AND contains(t, 'troca') THEN 'RUBRIC_MISMATCH'
  WHEN contains(t, 'json') AND (contains(t, 'schema') OR contains(t, 'incompleto') OR contains(t, 'invalid')) THEN 'JSON_SCHEMA_INVALID' WHEN contains(t, 'render') OR (contains(t, 'pdf') AND contains(t, 'imagem')) THEN 'PDF_RENDER_FAILED'
  WHEN contains(t, 'qr') THEN 'QR_READ_FAILED' WHEN contains(t, 'transcri') THEN 'TRANSCRIPTION_FAILED' WHEN contains(t, 'grading') OR contains(t, 'corre') THEN 'GRADING_FAILED'
  WHEN contains(t, 'database') OR contains(t, 'sql') THEN 'DATABASE_ERROR' ELSE 'PDF_ANALYSIS_FAILED' END"""
STAGE = """CASE code WHEN 'PDF_RENDER_FAILED' THEN 'student_detection' WHEN 'QR_READ_FAILED' THEN 'qr_reading' WHEN 'TRANSCRIPTION_FAILED' THEN 'transcription' WHEN 'GRADING_FAILED' THEN 'grading'
  WHEN 'JSON_SCHEMA_INVALID' THEN 'grading' WHEN 'RUBRIC_MISMATCH' THEN 'grading' WHEN 'DATABASE_ERROR' THEN 'database' ELSE 'unknown' END"""


@query("p11_classify_warnings", f"SELECT batch_id, id, code, {STAGE} AS stage FROM (SELECT *, {CODE} AS code FROM (SELECT *, lower(warning) AS t FROM fx_warnings) a) b")
def _(v):
    return reports.classify_warnings(v["fx_warnings"]).select("batch_id", "id", "code", "stage")


@query("a21_warning_counts", f"SELECT batch_id, code, {STAGE} AS stage, count(*) AS n FROM (SELECT *, {CODE} AS code FROM (SELECT *, lower(warning) AS t FROM fx_warnings) a) b GROUP BY 1, 2, 3")
def _(v):
    return reports.warning_counts(v["fx_warnings"])


RUN_PAGES = "SELECT source AS run_id, doc_id AS page_number, CASE WHEN doc_id % 3 = 0 THEN '' ELSE CONCAT('vis', CAST(doc_id % 4 AS STRING)) END AS vision_model, doc_id % 6 = 0 AS fallback_used, CASE WHEN doc_id % 97 = 0 THEN CONCAT('erro ', CAST(doc_id AS STRING)) END AS error FROM documents"
RUN_ANSWERS = "SELECT source AS run_id, doc_id AS page_number, 1 AS question_number, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CONCAT('txt', CAST(doc_id % 3 AS STRING)) END AS text_model FROM documents"


@query("a22_run_summary", f"""
WITH p AS (SELECT run_id, count(*) AS pages_processed, arg_min(vision_model, page_number) FILTER (vision_model <> '') AS vision_model, count(*) FILTER (fallback_used) AS fallback_pages,
  count(*) FILTER (error <> '') AS errors FROM ({RUN_PAGES}) x GROUP BY 1),
e AS (SELECT run_id, string_agg(error, ' | ' ORDER BY page_number, error) AS error FROM ({RUN_PAGES}) x WHERE error <> '' GROUP BY 1),
t AS (SELECT run_id, arg_min(text_model, page_number) FILTER (text_model <> '') AS text_model FROM ({RUN_ANSWERS}) y GROUP BY 1)
SELECT p.*, coalesce(e.error, '') AS error, t.text_model, CASE WHEN p.errors = 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status FROM p LEFT JOIN t ON t.run_id = p.run_id LEFT JOIN e ON e.run_id = p.run_id""")
def _(v):
    return reports.run_summary(v.sql(RUN_PAGES), v.sql(RUN_ANSWERS), most=None)


@query("s8_report_wide", "SELECT student_result_id, " + ", ".join(f"max(coalesce(final_score, ai_score)) FILTER (question_number = {n}) AS q{n}" for n in range(1, 8)) + ", round(sum(coalesce(final_score, ai_score)), 6) AS total, round_even(round(sum(coalesce(final_score, ai_score)), 6) / 7 * 4, 0) / 4 AS mark FROM fx_scored GROUP BY 1")
def _(v):
    return reports.report_wide(v["fx_scored"], list(range(1, 8))).withColumn("total", r6("total"))


@query("p13_public_answers", "SELECT run_id, page_number, question_number, student_name, registration, answer_transcription, score, needs_human_review FROM fx_answers")
def _(v):
    return reports.public_answers(v["fx_answers"])
