"""Payload, model output and text grading queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grades import reading_confidence, single_grade
from ..functions.json_text import REQUIRED, schema_warnings, with_kinds, with_recovery
from ..functions.short_answer import (
    ABBREVIATIONS, ALIASES, ALTERNATIVES, DROPPED, LAST_LEFT, LAST_RIGHT, LEFT, MUSCLE, RIGHT, SIDES, copy_form, key_variants, nfd_strip, normal_form, normal_form_by, normal_rules, plain_letters,
)
from ..functions.values import decimal_or, iso_timestamp, needs_fallback, unit_interval, word_count
from ..operators import grading, payloads
from ..sources import exam_lines, roster
from ..sources.shared import once_each, shared_path
from .registry import query
from .score_queries import r6

RUBRICS = """SELECT exam_id AS rubric_id, CASE exam_id % 4
  WHEN 0 THEN CONCAT('[{"number": 1, "prompt": "p", "expected_answer": "e', CAST(exam_id AS STRING), '", "max_score": 2}, {"questao": 3, "rubric": "r"}]')
  WHEN 1 THEN CONCAT('{"questions": [{"question_number": "2", "resposta": "x', CAST(exam_id AS STRING), '"}]}')
  WHEN 2 THEN '{"1": "plain", "bad": "skip", "4": {"answer": "obj", "valor": 0.5}}' ELSE '[{"expected_answer": "for all"}]' END AS payload FROM (SELECT DISTINCT exam_id FROM fx_questions) e"""
RUBRIC_ROWS = """SELECT exam_id AS rubric_id, n AS question_number, CASE WHEN k = 0 AND n = 1 THEN 'e' || exam_id WHEN k = 0 THEN 'r' WHEN k = 1 THEN 'x' || exam_id WHEN k = 2 AND n = 1 THEN 'plain' WHEN k = 2 THEN 'obj' ELSE 'for all' END AS expected_answer,
  CASE WHEN k = 0 AND n = 1 THEN 'p' END AS prompt, CASE WHEN k = 0 AND n = 1 THEN 2.0 WHEN k = 2 AND n = 4 THEN 0.5 ELSE 1.0 END AS max_score
  FROM (SELECT DISTINCT exam_id, exam_id % 4 AS k FROM fx_questions) e JOIN (SELECT 0 AS kk, 1 AS n UNION ALL SELECT 0, 3 UNION ALL SELECT 1, 2 UNION ALL SELECT 2, 1 UNION ALL SELECT 2, 4 UNION ALL SELECT 3, NULL) s ON s.kk = e.k"""


@query("s3_rubric_questions", RUBRIC_ROWS)
def _(v):
    return payloads.rubric_questions(v.sql(RUBRICS))


@query("j6_attach_rubric", f"""WITH r AS ({RUBRIC_ROWS}) SELECT a.id, a.question_number, coalesce((SELECT max(expected_answer) FROM r WHERE r.rubric_id = a.id % 5 AND r.question_number = a.question_number), CASE WHEN a.id % 5 = 3 THEN 'for all' END) AS expected_answer FROM fx_answers a""")
def _(v):
    answers = v["fx_answers"].select("id", (F.col("id") % 5).cast("int").alias("rubric_id"), "question_number")
    return payloads.attach_rubric(answers, payloads.rubric_questions(v.sql(RUBRICS))).select("id", "question_number", "expected_answer")


@query("p14_rubric_summary", f"""SELECT rubric_id, '[' || string_agg('{{' || CASE WHEN question_number IS NULL THEN '' ELSE '"question_number":' || question_number || ',' END || '"expected_answer":"' || expected_answer || '","max_score":' || CAST(CAST(max_score AS DOUBLE) AS VARCHAR) || '}}', ',' ORDER BY question_number) || ']' AS summary FROM ({RUBRIC_ROWS}) r GROUP BY 1""")
def _(v):
    return payloads.rubric_summary(v.sql(RUBRICS))


VISION = """SELECT run_id, CAST(id AS INT) AS position, CONCAT('{"student": {"name": "', student_name, '", "student_code": "', detected_student_code, '"}, "physical_page": ', CAST(page_number - 1 AS STRING), ', "page": ', CAST(page_number AS STRING),
  ', "questions": [{"number": ', CAST(question_number AS STRING), ', "answer_transcription": "texto ', CAST(id AS STRING), '", "reading_confidence": "', CASE WHEN reading_confidence = 'media' THEN 'Médio' ELSE reading_confidence END, '", "ocr_confidence": ', CASE WHEN id % 2 = 0 THEN '1.5' ELSE '"0,5"' END,
  '}, {"answer_transcription": "', CASE WHEN id % 3 = 0 THEN '  ' ELSE '' END, '", "reading_confidence": "?"}]}') AS payload, id FROM fx_answers"""


VISION_ROWS = """SELECT run_id, CAST(id AS INT) AS page_number, k AS place, CASE WHEN k = 0 THEN question_number ELSE 2 END AS question_number, CASE WHEN k = 0 THEN 'texto ' || id WHEN id % 3 = 0 THEN '  ' ELSE '' END AS answer_transcription,
  CASE WHEN k = 0 THEN reading_confidence ELSE 'baixa' END AS reading_confidence, CASE WHEN k = 1 THEN NULL WHEN id % 2 = 0 THEN 1.0 ELSE 0.5 END AS ocr_confidence, k = 0 OR id % 3 = 0 AS has_answer,
  coalesce(nullif(trim(detected_student_code), ''), CASE WHEN student_name <> ' ' THEN printf('%03d', CAST(regexp_extract(student_name, '[0-9]+') AS INT)) END, '') AS student_code,
  CASE WHEN page_number - 1 <> 0 THEN page_number - 1 ELSE CAST(id AS INT) END AS physical_page
  FROM fx_answers CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) s"""


@query("f23_vision_questions", VISION_ROWS)
def _(v):
    return payloads.vision_questions(v.sql(VISION)).select("run_id", "page_number", "place", "question_number", "answer_transcription", "reading_confidence", "ocr_confidence", "has_answer", "student_code", "physical_page")


@query("p3_valid_questions", f"SELECT run_id, page_number, question_number, CAST(NULL AS VARCHAR) AS warning FROM ({VISION_ROWS}) a WHERE question_number > 0 UNION ALL SELECT run_id, page_number, NULL, 'invalid question number on page ' || page_number FROM ({VISION_ROWS}) b WHERE coalesce(question_number, 0) <= 0")
def _(v):
    kept, dropped = payloads.valid_questions(payloads.vision_questions(v.sql(VISION)))
    return kept.select("run_id", "page_number", "question_number", F.lit(None).cast("string").alias("warning")).unionByName(dropped.withColumn("question_number", F.lit(None).cast("int")))


@query("w3_dedupe_page_answers", f"""SELECT run_id, page_number, question_number, min(place) AS place, CAST(NULL AS VARCHAR) AS warning FROM ({VISION_ROWS}) a GROUP BY 1, 2, 3 UNION ALL
  SELECT run_id, page_number, question_number, place, 'question ' || question_number || ' repeats on page ' || page_number FROM (SELECT *, row_number() OVER (PARTITION BY run_id, page_number, question_number ORDER BY place) AS p FROM ({VISION_ROWS}) a) b WHERE p > 1""")
def _(v):
    kept, dropped = payloads.dedupe_page_answers(payloads.vision_questions(v.sql(VISION)))
    cols = ["run_id", "page_number", "question_number", "place"]
    return kept.select(*cols, F.lit(None).cast("string").alias("warning")).unionByName(dropped.select(*cols, "warning"))


@query("s6_flatten_answers", """SELECT run_id, id, CASE WHEN page_number - 1 <> 0 THEN page_number - 1 ELSE page_number END AS page_number, CASE WHEN k = 0 THEN question_number END AS question_number, CASE WHEN k = 0 THEN 'texto ' || id WHEN id % 3 = 0 THEN '  ' ELSE '' END AS answer_transcription,
  CASE WHEN k = 0 AND question_number = 1 THEN 0.5 END AS score, CASE WHEN k = 0 AND id % 2 = 0 THEN 1.5 END AS ocr_confidence, (k = 0 AND question_number = 2) OR k = 1 OR reading_confidence = 'baixa' AS needs_human_review
  FROM fx_answers CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) s""")
def _(v):
    grade = lambda n, s, r: F.struct(F.lit(n).alias("question_number"), F.lit(s).alias("score"), F.lit("1").alias("max_score"), F.lit("parcial").alias("verdict"), F.lit(r).alias("needs_human_review"))
    pages = v.sql(VISION).withColumn("raw_page", F.lit(7)).withColumn("grades", F.array(grade(1, "0.5", False), grade(2, "n/a", True)))
    got = payloads.flatten_answers(pages.withColumn("run_id", F.concat_ws("#", "run_id", F.col("id").cast("string"))))
    return got.select(F.split("run_id", "#")[0].alias("run_id"), F.split("run_id", "#")[1].cast("long").alias("id"), "page_number", "question_number", "answer_transcription", "score", "ocr_confidence", "needs_human_review")


@query("a13_mean_confidence", """SELECT student_result_id AS answer_id, coalesce(string_agg(CASE WHEN question_number % 3 <> 0 THEN 'bloco ' || question_number END, chr(10) || chr(10) ORDER BY question_number), '') AS text,
  round(avg(CASE WHEN question_number % 2 = 1 THEN ocr_confidence END), 6) AS confidence FROM fx_scored GROUP BY 1""")
def _(v):
    page = F.struct(F.col("question_number").alias("n"), F.when(F.col("question_number") % 3 != 0, F.concat(F.lit("bloco "), F.col("question_number").cast("string"))).otherwise(" ").alias("markdown"), F.when(F.col("question_number") % 2 == 1, F.col("ocr_confidence").cast("string")).otherwise("n/a").alias("conf"))
    raw = v["fx_scored"].groupBy(F.col("student_result_id").alias("answer_id")).agg(F.sort_array(F.collect_list(page)).alias("pages"))
    return payloads.mean_confidence(raw).withColumn("confidence", r6("confidence"))


@query("j11_resolve_ocr", """
WITH r AS (SELECT *, array_length(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) < 3 OR trim(text) = '' OR coalesce(confidence < 0.70, FALSE) AS nf FROM fx_ocr),
p AS (SELECT answer_id, any_value(text) FILTER (provider = 'azure') AS ta, any_value(text) FILTER (provider = 'google') AS tb, any_value(confidence) FILTER (provider = 'azure') AS ca, any_value(confidence) FILTER (provider = 'google') AS cb,
  any_value(error) FILTER (provider = 'azure') AS ea, any_value(error) FILTER (provider = 'google') AS eb, bool_or(nf) FILTER (provider = 'azure') AS na, bool_or(nf) FILTER (provider = 'google') AS nb, count(*) FILTER (provider = 'google') = 0 AS alone FROM r GROUP BY answer_id),
j AS (SELECT *, ea IS NULL AND NOT na AS ga, coalesce(eb IS NULL AND NOT nb, FALSE) AS gb FROM p)
SELECT answer_id, CASE WHEN alone OR ga THEN ta WHEN gb OR trim(tb) <> '' THEN tb ELSE coalesce(nullif(ta, ''), nullif(tb, ''), '') END AS text,
  CASE WHEN alone OR ga THEN ca WHEN gb OR trim(tb) <> '' THEN cb ELSE coalesce(ca, cb) END AS confidence, CASE WHEN alone OR ga THEN na WHEN gb OR trim(tb) <> '' THEN nb ELSE TRUE END AS needs_fallback,
  CASE WHEN alone OR ga THEN 'azure' ELSE 'azure->fallback:google' END AS provider,
  CASE WHEN alone OR ga THEN ea WHEN gb OR trim(tb) <> '' THEN NULL WHEN ea IS NULL AND eb IS NULL THEN 'OCR principal e fallback sem texto confiável.' ELSE concat_ws('; ', ea, eb) END AS error FROM j""")
def _(v):
    return payloads.resolve_ocr(v["fx_ocr"], ["azure", "google"])


TEXT_GRADES = "SELECT id AS task_id, student_result_id, question_number, score, grading_confidence AS confidence, NOT parse_failed AS parse_ok, model_flag AS review, ocr_error, alignment_failed AS needs_fallback FROM fx_review"
VISUAL_GRADES = "SELECT id AS task_id, student_result_id, question_number, 0.25 AS score, 0.9 AS confidence, score > 0.3 AS parse_ok FROM fx_review WHERE question_number <> 4"


@query("j12_choose_grade", f"""SELECT t.student_result_id, t.question_number, CASE WHEN u THEN 0.25 ELSE t.score END AS score, CASE WHEN u THEN 0.9 ELSE t.confidence END AS confidence, u AS visual_used FROM (
  SELECT t.*, coalesce((t.ocr_error IS NOT NULL OR t.needs_fallback OR NOT t.parse_ok OR t.confidence < 0.70 OR t.review) AND w.parse_ok, FALSE) AS u
  FROM ({TEXT_GRADES}) t LEFT JOIN ({VISUAL_GRADES}) w ON w.student_result_id = t.student_result_id AND w.question_number = t.question_number) t""")
def _(v):
    task = F.concat_ws("/", F.col("student_result_id").cast("string"), F.col("question_number").cast("string"))
    visual = v.sql(VISUAL_GRADES).select(task.alias("task_id"), F.col("score").cast("double").alias("score"), F.col("confidence").cast("double").alias("confidence"), "parse_ok")
    got = payloads.choose_grade(v.sql(TEXT_GRADES).withColumn("task_id", task), visual)
    return got.select(F.split("task_id", "/")[0].cast("long").alias("student_result_id"), F.split("task_id", "/")[1].cast("long").alias("question_number"), "score", "confidence", "visual_used")


OUTPUTS = """SELECT student_result_id AS task_id, CASE question_number WHEN 1 THEN 'm-b' WHEN 2 THEN 'm-a' WHEN 3 THEN 'text-only' ELSE CONCAT('zz', CAST(question_number AS STRING)) END AS model, box_pos % 3 <> 0 AS ok,
  CONCAT('out', CAST(box_pos AS STRING)) AS output, CASE WHEN box_pos % 3 = 0 THEN CONCAT('err', CAST(source_page_number AS STRING)) END AS error FROM fx_scored"""


@query("w7_pick_model_output", f"""
WITH r AS (SELECT *, CASE model WHEN 'm-a' THEN 1 WHEN 'm-b' THEN 2 WHEN 'zz4' THEN 3 END AS rank FROM ({OUTPUTS}) o WHERE model IN ('m-a', 'm-b', 'zz4')),
b AS (SELECT task_id, arg_min(model, rank) FILTER (ok) AS model, arg_min(output, rank) FILTER (ok) AS output, min(rank) FILTER (ok) AS rank, string_agg(error, ' | ' ORDER BY rank) FILTER (NOT ok) AS e FROM r GROUP BY 1)
SELECT task_id, model, output, coalesce(rank > 1, FALSE) AS fallback_used, CASE WHEN rank IS NULL THEN e END AS error FROM b""")
def _(v):
    return payloads.pick_model_output(v.sql(OUTPUTS), ["m-a", "text-only", "m-b", "m-a", "zz4"], ("text-only",))


ASKED = "SELECT id, CAST(id % 40 AS INT) AS question_id, CASE WHEN id % 6 = 0 THEN '  ' ELSE answer_transcription END AS answer_transcription FROM fx_answers"


def prompt_sql(blank: str) -> str:
    return f"""'Questão ' || q.question_number || ': ' || q.question_text || chr(10) || 'Gabarito: ' || q.expected_answer || chr(10) || 'Valor: 1.0' || chr(10) || 'Resposta: ' ||
  coalesce(nullif(regexp_replace(a.answer_transcription, '^\\s+|\\s+$', '', 'g'), ''), '{blank}')"""


@query("p10_build_requests", f"SELECT a.id, a.question_id, {prompt_sql('(vazio)')} AS prompt, NULL AS payload, NULL AS image FROM ({ASKED}) a JOIN fx_questions q ON q.id = a.question_id")
def _(v):
    return payloads.build_requests(v.sql(ASKED), v["fx_questions"])


@query("p10_visual_requests", f"SELECT a.id, a.question_id, {prompt_sql('(sem transcrição confiável)')} AS prompt, NULL AS payload, 'crop/' || a.id || '.png' AS image FROM ({ASKED}) a JOIN fx_questions q ON q.id = a.question_id")
def _(v):
    return payloads.build_requests(v.sql(ASKED).withColumn("image", F.concat(F.lit("crop/"), "id", F.lit(".png"))), v["fx_questions"], "visual")


TOLD_PAGES = "SELECT id AS page_id, CONCAT('page/', CAST(id AS STRING)) AS image_path, 'a model' AS vision_model, run_id, page_number, NULLIF(detected_student_code, '') AS code, registration FROM fx_answers"


@query("p10_page_requests", f"""SELECT page_id, image_path AS image, CAST(CASE WHEN code IS NULL AND registration IS NULL THEN json_object('run_id', run_id, 'page_number', page_number)
  WHEN code IS NULL THEN json_object('run_id', run_id, 'page_number', page_number, 'registration', registration) WHEN registration IS NULL THEN json_object('run_id', run_id, 'page_number', page_number, 'code', code)
  ELSE json_object('run_id', run_id, 'page_number', page_number, 'code', code, 'registration', registration) END AS VARCHAR) AS payload FROM ({TOLD_PAGES}) p""")
def _(v):
    return payloads.page_requests(v.sql(TOLD_PAGES))


RAWS = """SELECT id, CAST(id % 45 AS INT) AS question_id, CASE id % 4 WHEN 0 THEN '{"expected_answer": "from raw"}' WHEN 1 THEN '{"expected_answer": "", "rubric_expected_answer": "second"}' WHEN 2 THEN 'broken' END AS raw_grading_json FROM fx_answers"""


@query("p15_expected_from_raw", f"SELECT a.id, CASE a.id % 4 WHEN 0 THEN 'from raw' WHEN 1 THEN 'second' ELSE coalesce(q.expected_answer, '') END AS expected_answer FROM ({RAWS}) a LEFT JOIN fx_questions q ON q.id = a.question_id")
def _(v):
    return payloads.expected_from_raw(v.sql(RAWS), v["fx_questions"])


# What pages and documents say, in several spellings, and words of the texts that name no level.
SAID = """SELECT id, CASE WHEN LENGTH(answer_transcription) % 5 = 0 THEN UPPER(reading_confidence) WHEN LENGTH(answer_transcription) % 5 = 1 THEN CONCAT('  ', REPLACE(reading_confidence, 'media', 'Médio'), ' ')
  WHEN LENGTH(answer_transcription) % 5 = 2 THEN REPLACE(reading_confidence, 'media', 'MÉDIA') WHEN LENGTH(answer_transcription) % 5 = 3 THEN reading_confidence ELSE answer_transcription END AS said FROM fx_answers"""


@query("f5_reading_confidence", f"SELECT id, CASE WHEN t IN ('alta', 'media', 'baixa') THEN t WHEN t IN ('média', 'medio', 'médio') THEN 'media' ELSE 'baixa' END AS c FROM (SELECT id, lower(regexp_replace(coalesce(said, ''), '^\\s+|\\s+$', '', 'g')) AS t FROM ({SAID}) s) x")
def _(v):
    return v.sql(SAID).select("id", reading_confidence(F.col("said")).alias("c"))


@query("f6_unit_interval", "SELECT id, CASE WHEN score IS NULL THEN NULL ELSE least(1.0, greatest(0.0, score * 3 - 1)) END AS c FROM fx_answers")
def _(v):
    return v["fx_answers"].select("id", unit_interval(F.col("score") * 3 - 1).alias("c"))


@query("f7_word_count", "SELECT id, len(list_filter(regexp_split_to_array(answer_transcription, '[ \\t\\n\\f\\r\\v]+'), lambda x: x <> '')) AS n, len(list_filter(regexp_split_to_array(answer_transcription, '[ \\t\\n\\f\\r\\v]+'), lambda x: x <> '')) < 3 OR coalesce(score < 0.70, FALSE) AS nf FROM fx_answers")
def _(v):
    return v["fx_answers"].select("id", word_count(F.col("answer_transcription")).alias("n"), needs_fallback(F.col("answer_transcription"), F.col("score")).alias("nf"))


SOLE = "id, student_result_id, question_number"


@query("f19_recover_json", f"""SELECT {SOLE}, question_number <= 6 AS parsed, CASE WHEN question_number <= 3 THEN CAST(json_extract_string(regexp_replace(regexp_extract(raw, '\\{{.*\\}}', 0, 's'), ',\\s*\\}}', '}}'), '$.nota') AS DOUBLE)
  WHEN question_number IN (4, 6) THEN 0.5 WHEN question_number = 5 THEN 1.0 END AS nota FROM fx_raw""")
def _(v):
    got = once_each(v["fx_raw"].select("id", "student_result_id", "question_number", "raw"), ["raw"], lambda d: with_recovery(d, "raw"), "recovered")
    return got.select("id", "student_result_id", "question_number", F.col("_obj").isNotNull().alias("parsed"), F.col("_obj")["nota"].try_cast("double").alias("nota"))


@query("f20_schema_warnings", f"""SELECT {SOLE}, CASE WHEN question_number = 6 THEN 'JSON recuperado, mas schema incompleto: chaves ausentes: [''criterios_atendidos'', ''revisao_necessaria'']|Chaves suspeitas/ignoradas: [''criterios_austeis'', ''revisao_necessosa'']' ELSE '' END AS warnings FROM fx_raw""")
def _(v):
    warned = F.when(F.col("_obj").isNotNull(), F.array_join(schema_warnings(), "|"))
    rows = v["fx_raw"].select("id", "student_result_id", "question_number", "raw")
    return once_each(rows, ["raw"], lambda d: with_kinds(d, "raw").select("raw", F.coalesce(warned, F.lit("")).alias("warnings")), "warned").drop("raw")


# The repairs in order and the first that is one object, worked out from the text alone.
READ = r"""b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '^```(json|JSON)?\s*', ''), '\s*```$', '') AS bare FROM fx_outputs),
c1 AS (SELECT *, CASE WHEN regexp_matches(bare, '(?s)\{.*\}') THEN regexp_extract(bare, '(?s)\{.*\}') ELSE bare END AS t1 FROM b),
c2 AS (SELECT *, translate(t1, '“”‘’', '""''''') AS t2 FROM c1),
c3 AS (SELECT *, regexp_replace(t2, ',\s*([}\]])', '\1', 'g') AS t3 FROM c2),
c4 AS (SELECT *, regexp_replace(t3, '(\d),(\d)', '\1.\2', 'g') AS t4 FROM c3),
o AS (SELECT id, fault, list_filter([t1, t2, t3, t4], lambda t: json_valid(t) AND coalesce(try(json_type(t)), '') = 'OBJECT')[1] AS o FROM c4)"""


@query("f19_repairs_of_texts", f"WITH {READ} SELECT id, o IS NOT NULL AS parsed, try_cast(json_extract_string(o, '$.nota') AS DOUBLE) AS nota, json_extract_string(o, '$.comentario') AS comentario FROM o")
def _(v):
    got = with_recovery(v["fx_outputs"], "raw")
    return got.select("id", F.col("_obj").isNotNull().alias("parsed"), F.col("_obj")["nota"].try_cast("double").alias("nota"), F.col("_obj")["comentario"].alias("comentario"))


WRONG = "CASE WHEN list_contains(k, '{key}') AND NOT coalesce(json_type(o, '$.{key}') IN ({kinds}), FALSE) THEN 'Campo {key} com tipo inválido.' END"
LIST_OF = "'[''' || array_to_string({c}, ''', ''') || ''']'"


@query("f20_warnings_of_texts", f"""WITH {READ}, r AS (SELECT id, o, json_keys(o) AS k FROM o WHERE o IS NOT NULL),
l AS (SELECT *, list_filter({list(REQUIRED)}, lambda x: NOT list_contains(k, x)) AS lacking, list_filter(k, lambda x: NOT list_contains({list(REQUIRED)}, lower(trim(x))) AND (contains(lower(trim(x)), 'revisao_necess') OR starts_with(lower(trim(x)), 'criterios_'))) AS odd FROM r)
SELECT id, array_to_string(list_filter([CASE WHEN len(lacking) > 0 THEN 'JSON recuperado, mas schema incompleto: chaves ausentes: ' || {LIST_OF.format(c="lacking")} END, CASE WHEN len(odd) > 0 THEN 'Chaves suspeitas/ignoradas: ' || {LIST_OF.format(c="odd")} END,
  CASE WHEN list_contains(k, 'analysis') OR list_contains(k, 'reasoning') THEN 'Campos proibidos detectados: analysis/reasoning.' END, {WRONG.format(key="comentario", kinds="'VARCHAR'")},
  {WRONG.format(key="criterios_atendidos", kinds="'ARRAY'")}, {WRONG.format(key="criterios_ausentes", kinds="'ARRAY'")}, {WRONG.format(key="nota", kinds="'DOUBLE', 'UBIGINT', 'BIGINT', 'VARCHAR', 'BOOLEAN'")}], lambda x: x IS NOT NULL), '|') AS warnings FROM l""")
def _(v):
    read = with_kinds(v["fx_outputs"], "raw").where("_obj is not null")
    return read.select("id", F.array_join(schema_warnings(), "|").alias("warnings"))


@query("f22_grades_of_texts", f"""WITH {READ}, r AS (SELECT id, o, try_cast(json_extract_string(o, '$.nota') AS DOUBLE) AS x, json_extract_string(o, '$.revisao_necessaria') AS flag, json_type(o, '$.revisao_necessaria') AS kind FROM o),
g AS (SELECT *, CASE WHEN x IS NULL THEN 0.0 ELSE least(1.0, greatest(0.0, ceil(x * 4 - 0.5) / 4)) END AS s FROM r)
SELECT id, CASE WHEN o IS NULL THEN 0.0 ELSE s END AS score, o IS NULL OR coalesce(x, -1) <> s OR kind IS NULL OR flag = 'true' OR coalesce(flawed, FALSE) AS needs_human_review,
  CASE WHEN o IS NULL THEN 'Resposta da IA em formato inválido. Revisão manual necessária.' ELSE coalesce(json_extract_string(o, '$.comentario'), '') END AS justification
FROM (SELECT g.*, len(list_filter({list(REQUIRED)}, lambda q: NOT list_contains(json_keys(o), q))) > 0 OR list_contains(json_keys(o), 'analysis') OR coalesce(json_type(o, '$.criterios_atendidos') <> 'ARRAY', FALSE) AS flawed FROM g) h""")
def _(v):
    rows = v["fx_outputs"].withColumns({"answer": F.lit("uma resposta do aluno"), "prompt": F.lit(""), "reading_confidence": F.lit("alta"), "max_score": F.lit(1.0)})
    return grading.discursive_grades(rows).select("id", "score", "needs_human_review", "justification")


@query("f22_discursive_grades", f"""
WITH r AS (SELECT *, CASE WHEN question_number <= 3 THEN CAST(json_extract_string(regexp_replace(regexp_extract(raw, '\\{{.*\\}}', 0, 's'), ',\\s*\\}}', '}}'), '$.nota') AS DOUBLE) WHEN question_number = 7 THEN NULL WHEN question_number = 5 THEN 1.0 ELSE 0.5 END AS x, contains(answer, 'Explique') AS marks FROM fx_raw),
g AS (SELECT *, least(1.0, greatest(0.0, ceil(x * 4 - 0.5) / 4)) AS s, x <> least(1.0, greatest(0.0, ceil(x * 4 - 0.5) / 4)) AS off, CASE WHEN marks THEN TRUE ELSE FALSE END AS copied FROM r)
SELECT {SOLE}, CASE WHEN question_number = 7 OR copied THEN 0.0 ELSE s END AS score,
  CASE WHEN copied THEN 'incorreta' WHEN answer = '' THEN 'sem_resposta' WHEN question_number = 7 THEN 'incorreta' WHEN s >= 0.99 THEN 'correta' WHEN s > 0 THEN 'parcial' ELSE 'incorreta' END AS verdict,
  question_number IN (6, 7) OR (question_number = 2) OR reading_confidence = 'baixa' OR marks OR coalesce(off, FALSE) OR copied AS needs_human_review, question_number <> 6 AS schema_valid,
  CASE WHEN question_number = 7 THEN 'erro_parse' WHEN question_number = 6 THEN 'JSON recuperado, mas schema incompleto: chaves ausentes: [''criterios_atendidos'', ''revisao_necessaria'']; Chaves suspeitas/ignoradas: [''criterios_austeis'', ''revisao_necessosa'']; Campo revisao_necessaria com tipo/valor inválido.'
    WHEN copied THEN 'Resposta parece cópia do enunciado da questão.' WHEN coalesce(off, FALSE) THEN 'Nota fora do formato esperado; revisão manual necessária.' WHEN reading_confidence = 'baixa' THEN 'Leitura visual com baixa confiança.' ELSE '' END AS review_reason,
  CASE WHEN question_number = 7 THEN 'Resposta da IA em formato inválido. Revisão manual necessária.' WHEN question_number <= 2 THEN 'bom' WHEN question_number = 3 THEN 'c' ELSE 'x' END AS justification,
  CASE WHEN question_number = 1 THEN 'a' ELSE '' END AS detected FROM g""")
def _(v):
    rows = v["fx_raw"].withColumn("task", F.struct("id", "student_result_id", "question_number"))
    got = grading.discursive_grades(rows.drop("id").withColumnRenamed("task", "id"))
    return got.select("id.id", "id.student_result_id", "id.question_number", "score", "verdict", "needs_human_review", "schema_valid", "review_reason", "justification", F.array_join("detected_concepts", "|").alias("detected"))


@query("f3_single_grade", f"""SELECT {SOLE}, CASE WHEN ai_score * 2 > 1.0 THEN 1.0 ELSE round_even(ai_score * 2 * 4, 0) / 4 END AS score, grading_confidence AS confidence, ai_score * 2 <= 1.0 + 1e-6 AS parse_ok FROM fx_scored""")
def _(v):
    text = lambda c: c.cast("string")
    g = F.create_map(F.lit("nota"), text(F.col("ai_score") * 2), F.lit("nota_maxima"), F.lit("1.0"), F.lit("confianca"), text(F.col("grading_confidence")), F.lit("questao"), text(F.col("question_number")))
    return v["fx_scored"].withColumn("g", g).withColumn("r", single_grade(F.col("g"))).select("id", "student_result_id", "question_number", "r.score", "r.confidence", "r.parse_ok")


PRICES = "SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN REPLACE(CAST(p_retailprice AS STRING), '.', ',') WHEN p_size % 4 = 1 THEN CONCAT(' ', CAST(p_size AS STRING), ' ') WHEN p_size % 4 = 2 THEN p_name ELSE CAST(p_retailprice AS STRING) END AS said FROM part"


@query("f26_decimal_or", f"SELECT id, round(coalesce(CASE WHEN regexp_matches(t, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(t AS DOUBLE) END, 1.0), 6) AS x FROM (SELECT id, replace(trim(said), ',', '.') AS t FROM ({PRICES}) p) q")
def _(v):
    return v.sql(PRICES).select("id", r6(decimal_or(F.col("said"), 1.0)).alias("x"))


@query("f32_iso_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t FROM events")
def _(v):
    return v["events"].select("event_id", iso_timestamp(F.col("ts")).alias("t"))


FORM = "trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9áàâãéèêíïóôõöúçñ\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("f11_copy_form", f"SELECT id, {FORM.format(c='answer_transcription')} AS t FROM fx_answers")
def _(v):
    return v["fx_answers"].select("id", copy_form(F.col("answer_transcription")).alias("t"))


LETTERS = "SELECT id, CASE WHEN id % 4 = 0 THEN CONCAT(answer_transcription, ' ação e\u0301 n\u0303') ELSE answer_transcription END AS t FROM fx_answers"
# Further scripts: precomposed Greek, Cyrillic and Vietnamese letters, which the Latin table leaves whole.
SCRIPTS = "SELECT id, CONCAT(answer_transcription, ' Άλφα йод ệ ở ǻ e\u0301') AS t FROM fx_answers"


@query("f12_plain_letters", f"SELECT id, strip_accents(t) AS t FROM ({LETTERS}) x")
def _(v):
    return v.sql(LETTERS).select("id", plain_letters(F.col("t")).alias("t"))


@query("f12_nfd_strip", f"SELECT id, regexp_replace(strip_accents(t), '\\p{{Mn}}', '', 'g') AS t FROM ({SCRIPTS}) x")
def _(v):
    return v.sql(SCRIPTS).select("id", nfd_strip(F.col("t")).alias("t"))


def expanded_sql(c: str) -> str:
    """F13's first half for DuckDB. Its patterns know no look-ahead: the letter or blank ahead is matched and put back, where need be twice over."""
    shorts = "|".join(a for a, _ in ABBREVIATIONS)
    t = f"lower(strip_accents(coalesce({c}, '')))"
    for _ in range(2):
        t = f"regexp_replace({t}, '\\b({shorts})\\.([a-z])', '\\1. \\2', 'g')"
    t = f"(' ' || {t} || ' ')"
    for short, word in ABBREVIATIONS:
        t = f"regexp_replace({t}, '\\b{short}\\.?(\\s)', ' {word} \\1', 'g')"
    return t


def normal_sql(c: str) -> str:
    """F13 for DuckDB."""
    t = expanded_sql(c)
    for pattern, word in ((MUSCLE, " "), (LEFT, " esquerdo "), (RIGHT, " direito "), (DROPPED, " "), (r"\s+", " ")):
        t = f"regexp_replace({t}, '{pattern}', '{word}', 'g')"
    t = f"regexp_replace(regexp_replace(trim({t}), '{LAST_LEFT}', '\\1esquerdo'), '{LAST_RIGHT}', '\\1direito')"
    for alias, word in ALIASES:
        t = f"regexp_replace({t}, '\\b{alias}\\b', ' {word} ', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def side_sql(c: str) -> str:
    has = lambda a, b: f"(contains(' ' || {c}, ' {a}') OR contains(' ' || {c}, ' {b}'))"
    left, right = has("esquerdo", "esquerda"), has("direito", "direita")
    return f"CASE WHEN {left} AND NOT {right} THEN 'left' WHEN {right} AND NOT {left} THEN 'right' ELSE '' END"


PRACTICAL = "SELECT id, CAST(id % 40 AS INT) AS question_id, answer AS answer_transcription, CASE WHEN id % 3 = 0 THEN '' ELSE reading_confidence END AS reading_confidence FROM fx_short"


@query("p10_grading_requests", f"""SELECT a.id, a.question_id, CAST(json_object('question_number', q.question_number, 'question_prompt', q.question_text, 'question_prompt_expanded', {expanded_sql("q.question_text")},
    'reading_confidence', CASE WHEN a.reading_confidence = '' THEN 'media' ELSE a.reading_confidence END, 'student_answer', a.answer_transcription, 'student_answer_expanded', {expanded_sql("a.answer_transcription")},
    'student_answer_normalized', {normal_sql("a.answer_transcription")}, 'rubric_expected_answer_expanded', {expanded_sql("q.expected_answer")}, 'rubric_expected_answer_normalized', {normal_sql("q.expected_answer")},
    'rubric', json_object('expected_answer', q.expected_answer, 'max_score', q.max_score)) AS VARCHAR) AS payload
  FROM ({PRACTICAL}) a JOIN fx_questions q ON q.id = a.question_id""")
def _(v):
    return payloads.build_requests(v.sql(PRACTICAL), v["fx_questions"], "grading").select("id", "question_id", "payload")


# Forms of distinct texts, and each key's variants in order with their place.
SHORT = f"""s AS MATERIALIZED (SELECT id, reading_confidence, max_score, regexp_replace(answer, '^\\s+|\\s+$', '', 'g') AS answer, regexp_replace(key, '^\\s+|\\s+$', '', 'g') AS key FROM fx_short),
form AS MATERIALIZED (SELECT t, {normal_sql("t")} AS f FROM (SELECT answer AS t FROM s UNION SELECT key FROM s) x),
part_of AS (SELECT key, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM (SELECT key, string_split_regex(key, '{ALTERNATIVES}') AS parts FROM (SELECT DISTINCT key FROM s) k) l
  UNION ALL SELECT key, key, 1000000 FROM (SELECT DISTINCT key FROM s) k),
variant AS MATERIALIZED (SELECT key, v, min(i) AS i FROM (SELECT key, i, {normal_sql("p")} AS v FROM part_of WHERE trim(p) <> '') y WHERE v <> '' GROUP BY 1, 2)"""


@query("f13_normal_form", f"WITH {SHORT} SELECT s.id, a.f AS answer_form, k.f AS key_form FROM s JOIN form a ON a.t = s.answer JOIN form k ON k.t = s.key")
def _(v):
    return v["fx_short"].select("id", normal_form(F.col("answer")).alias("answer_form"), normal_form(F.col("key")).alias("key_form"))


@query("f13_rule_table", f"SELECT p_partkey AS id, {normal_sql('answer')} AS f FROM (SELECT id AS p_partkey, answer FROM fx_short) x")
def _(v):
    rules = v.spark.createDataFrame(normal_rules(), "step int, pattern string, word string")
    return v["fx_short"].select("id", normal_form_by(F.col("answer"), rules).alias("f"))


@query("f14_key_variants", f"WITH {SHORT} SELECT s.id, coalesce(string_agg(v, '|' ORDER BY i), '') AS variants FROM s LEFT JOIN variant n ON n.key = s.key GROUP BY 1")
def _(v):
    return v["fx_short"].select("id", F.array_join(key_variants(F.col("key")), "|").alias("variants"))


def coverage_sql(a: str, k: str) -> str:
    return f"len(list_intersect(string_split({a}, ' '), list_distinct(string_split({k}, ' ')))) / greatest(len(list_distinct(string_split({k}, ' '))), 1)"


@query("f15_coverage_and_side", f"""WITH {SHORT} SELECT id, round({coverage_sql("a", "k")}, 9) AS coverage, {side_sql("a")} AS side, ({side_sql("a")}) = '' OR ({side_sql("k")}) = '' OR ({side_sql("a")}) = ({side_sql("k")}) AS side_ok
  FROM (SELECT s.id, a.f AS a, k.f AS k FROM s JOIN form a ON a.t = s.answer JOIN form k ON k.t = s.key) x""")
def _(v):
    return grading.word_coverage(v["fx_short"]).withColumn("coverage", F.round("coverage", 9))


@query("f17_short_answers")
def _(v):
    return grading.grade_short_answers(v["fx_short"])


def distance_ratio(x: str, y: str, least=None):
    """A ratio that SQL knows as well, in place of the matching-blocks one."""
    return 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))


def likeness_sql(a: str, k: str) -> str:
    ratio = f"1 - levenshtein({a}, {k}) / greatest(length({a}), length({k}), 1)"
    return f"CASE WHEN {a} = '' OR {k} = '' THEN 0.0 ELSE 0.65 * ({ratio}) + 0.35 * ({coverage_sql(a, k)}) END"


BARE_SIDE = "trim(regexp_replace(regexp_replace({c}, '" + SIDES + "', ' ', 'g'), '\\s+', ' ', 'g'))"


# All rules of F17 but the ratio itself: another ratio, which DuckDB has too, stands in its place.
@query("f17_rules_by_distance", f"""WITH {SHORT},
pair AS MATERIALIZED (SELECT DISTINCT s.key, a.f AS n, v.v, v.i, {BARE_SIDE.format(c="a.f")} AS n0, {BARE_SIDE.format(c="v.v")} AS v0 FROM s JOIN form a ON a.t = s.answer JOIN variant v ON v.key = s.key WHERE s.answer <> ''),
liked AS (SELECT *, {likeness_sql("n", "v")} AS sim, {likeness_sql("n0", "v0")} AS sim0 FROM pair),
best AS (SELECT key, n, v, sim, sim0 FROM (SELECT *, row_number() OVER (PARTITION BY key, n ORDER BY sim DESC, i) AS p FROM liked) r WHERE p = 1),
x AS (SELECT s.*, a.f AS n, k.f AS kf, coalesce(b.v, '') AS v, coalesce(b.sim, 0.0) AS sim, coalesce(b.sim0, 0.0) AS sim0 FROM s JOIN form a ON a.t = s.answer JOIN form k ON k.t = s.key LEFT JOIN best b ON b.key = s.key AND b.n = a.f),
y AS (SELECT *, ({side_sql("n")}) = '' OR ({side_sql("kf")}) = '' OR ({side_sql("n")}) = ({side_sql("kf")}) AS side, v <> '' AND (contains(n, v) OR contains(v, n) OR sim >= 0.90) AS held, v <> '' AND sim0 >= 0.86 AS alike FROM x),
z AS (SELECT *, held AND side AS correct, NOT (held AND side) AND ((side AND sim >= 0.72) OR (alike AND sim >= 0.68)) AS near FROM y)
SELECT id, CASE WHEN key <> '' THEN CASE WHEN correct AND answer <> '' THEN max_score ELSE 0.0 END END AS score, CASE WHEN key = '' THEN 'sem_rubrica' WHEN answer = '' THEN 'sem_resposta' WHEN correct THEN 'correta' ELSE 'incorreta' END AS verdict,
  key = '' OR reading_confidence = 'baixa' OR (answer <> '' AND near) AS needs_human_review, CASE WHEN key = '' THEN 'Gabarito prático não informado para esta questão.' WHEN answer = '' THEN 'Resposta em branco. Esperado: ' || key || '.'
    WHEN NOT side AND alike THEN 'Estrutura compatível, mas lateralidade divergente.' WHEN correct THEN 'Resposta prática confere com o gabarito esperado.' WHEN near THEN 'Resposta próxima ao gabarito; possível ruído de OCR/abreviação. Revisão humana recomendada.'
    ELSE 'Resposta prática não confere com o gabarito esperado: ' || key || '.' END AS justification, n AS normal_answer,
  CASE WHEN key <> '' AND answer <> '' AND correct THEN key ELSE '' END AS detected, CASE WHEN key <> '' AND NOT (answer <> '' AND correct) THEN key ELSE '' END AS missing,
  CASE WHEN key = '' THEN 'Gabarito prático ausente.' WHEN reading_confidence = 'baixa' THEN 'Leitura visual com baixa confiança.' WHEN answer <> '' AND near THEN 'Resposta próxima ao gabarito; revisar possível erro de OCR/abreviação.' ELSE '' END AS review_reason FROM z""")
def _(v):
    got = grading.grade_short_answers(v["fx_short"], ratio=distance_ratio)
    concepts = [F.array_join(f"{c}_concepts", "|").alias(c) for c in ("detected", "missing")]
    return got.select("id", "score", "verdict", "needs_human_review", "justification", "normal_answer", *concepts, "review_reason")


@query("f17_exact_matches", f"""WITH {SHORT} SELECT s.id FROM s JOIN form a ON a.t = s.answer JOIN form k ON k.t = s.key JOIN variant v ON v.key = s.key AND v.v = a.f WHERE ({side_sql("a.f")}) = '' OR ({side_sql("k.f")}) = '' OR ({side_sql("a.f")}) = ({side_sql("k.f")})""")
def _(v):
    return grading.exact_matches(v["fx_short"])


TOLD = "SELECT conv_id, turn, prompt, CASE WHEN turn % 4 = 0 THEN CONCAT(prompt, ' ok') ELSE answer END AS answer FROM fx_turns"


@query("f18_copied_overlap", f"""
WITH t AS (SELECT conv_id, turn, {FORM.format(c='answer')} AS a, {FORM.format(c='prompt')} AS p FROM ({TOLD}) x),
w AS (SELECT *, list_distinct(string_split(a, ' ')) AS wa, list_distinct(string_split(p, ' ')) AS wp FROM t)
SELECT conv_id, turn, length(a) >= 20 AND length(p) >= 20 AND len(list_intersect(wa, wp)) / greatest(len(wa), 1) >= 0.85 AS copied FROM w""")
def _(v):
    return v.sql(TOLD).select("conv_id", "turn", grading.overlap_copied(F.col("answer"), F.col("prompt")).alias("copied"))


# Copying by overlap or ratio, with a ratio that DuckDB has too.
@query("f18_copied_by_distance", f"""
WITH t AS (SELECT conv_id, turn, {FORM.format(c='answer')} AS a, {FORM.format(c='prompt')} AS p FROM ({TOLD}) x),
w AS (SELECT *, list_distinct(string_split(a, ' ')) AS wa, list_distinct(string_split(p, ' ')) AS wp, length(a) >= 20 AND length(p) >= 20 AS long FROM t)
SELECT conv_id, turn, long AND (len(list_intersect(wa, wp)) / greatest(len(wa), 1) >= 0.85 OR (2 * least(length(a), length(p)) >= 0.6 * (length(a) + length(p)) AND 1 - levenshtein(a, p) / greatest(length(a), length(p), 1) >= 0.6)) AS copied FROM w""")
def _(v):
    return grading.copied_prompts(v.sql(TOLD), 0.6, distance_ratio).select("conv_id", "turn", "copied")


# The prompt under each of its four names, with empty ones before it.
ALIASED = f"""SELECT conv_id, turn, answer, CASE conv_id % 4 WHEN 0 THEN prompt WHEN 1 THEN '' END AS prompt, CASE conv_id % 4 WHEN 1 THEN prompt WHEN 2 THEN '' WHEN 0 THEN 'another prompt, which does not count' END AS prompt_detected,
  CASE WHEN conv_id % 4 = 2 THEN prompt END AS question_prompt, CASE WHEN conv_id % 8 = 3 THEN prompt WHEN conv_id % 4 <> 3 THEN answer END AS rubric_prompt FROM ({TOLD}) told"""


@query("f18_prompt_aliases", f"""
WITH t AS (SELECT conv_id, turn, {FORM.format(c='answer')} AS a, {FORM.format(c="CASE WHEN conv_id % 8 = 7 THEN '' ELSE prompt END")} AS p FROM ({TOLD}) x),
w AS (SELECT *, list_distinct(string_split(a, ' ')) AS wa, list_distinct(string_split(p, ' ')) AS wp, length(a) >= 20 AND length(p) >= 20 AS long FROM t)
SELECT conv_id, turn, long AND (len(list_intersect(wa, wp)) / greatest(len(wa), 1) >= 0.85 OR (2 * least(length(a), length(p)) >= 0.6 * (length(a) + length(p)) AND 1 - levenshtein(a, p) / greatest(length(a), length(p), 1) >= 0.6)) AS copied FROM w""")
def _(v):
    return grading.copied_prompts(v.sql(ALIASED), 0.6, distance_ratio).select("conv_id", "turn", "copied")


@query("f18_copied_prompts")
def _(v):
    return grading.copied_prompts(v.sql(TOLD)).select("conv_id", "turn", "copied")


CAUSES = "SELECT id, CASE WHEN question_number = 0 THEN 'no_rubric' WHEN needs_human_review OR LENGTH(answer_transcription) < 500 THEN 'grading_error' ELSE 'model_failure' END AS cause FROM fx_answers WHERE question_number = 0 OR needs_human_review OR reading_confidence = 'baixa' OR LENGTH(answer_transcription) < 500"


@query("f25_default_grades", f"""SELECT id, CASE WHEN cause <> 'no_rubric' THEN 0.0 END AS score, CASE WHEN cause = 'no_rubric' THEN 'sem_rubrica' ELSE 'erro' END AS verdict, TRUE AS needs_human_review,
  CASE cause WHEN 'no_rubric' THEN 'Questão sem rubrica cadastrada.' WHEN 'grading_error' THEN 'Erro na correção automática.' ELSE 'Falha do modelo de correção.' END AS review_reason FROM ({CAUSES}) c""")
def _(v):
    return grading.default_grades(v.sql(CAUSES))


# One CSV text per class: a title line, an empty one, the header, the students; even classes with semicolons and blank names here and
# there, odd ones with commas, a name over two lines and as many further columns as the class number says.
ROSTER_LINES = """SELECT CAST(class_id AS STRING) AS file_id, 2 + ROW_NUMBER() OVER (PARTITION BY class_id ORDER BY id) AS line_no,
    CASE WHEN class_id % 2 = 0 THEN CONCAT(registration_number, ';', CASE WHEN id % 10 = 0 THEN ' ' ELSE name END, ';', curso, ';', CASE WHEN id % 4 = 0 THEN 'T9' ELSE '' END)
      ELSE CONCAT(REPEAT('x,', CAST(class_id * 3 AS INT)), curso, ',"', REPLACE(name, '#', '\n""'), '",', registration_number) END AS line FROM fx_students
  UNION ALL SELECT CAST(id AS STRING), 0, CASE WHEN id % 2 = 0 THEN 'lista;de;alunos' ELSE 'lista de alunos' END FROM fx_classes
  UNION ALL SELECT CAST(id AS STRING), 1, '' FROM fx_classes
  UNION ALL SELECT CAST(id AS STRING), 2, CASE WHEN id % 2 = 0 THEN 'Matrícula;Nome completo;Curso;Turma' ELSE CONCAT(REPEAT('-,', CAST(id * 3 AS INT)), 'Curso,NOME,Matricula') END FROM fx_classes"""


@query("s1_rosters", f"""
WITH t AS (SELECT class_id, bool_or(id % 4 = 0) FILTER (id % 10 <> 0) AS has_turma FROM fx_students GROUP BY 1)
SELECT CAST(s.class_id AS VARCHAR) AS file_id, registration_number, CASE WHEN s.class_id % 2 = 1 THEN replace(name, '#', chr(10) || '"') ELSE name END AS name, curso, CASE WHEN s.class_id % 2 = 0 AND has_turma THEN 'T9' END AS turma FROM fx_students s JOIN t ON t.class_id = s.class_id WHERE s.class_id % 2 = 1 OR s.id % 10 <> 0""")
def _(v):
    """The files are written to the shared folder and scanned from there."""
    path = shared_path(v.spark, "rosters")
    lines = v.sql(ROSTER_LINES).groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\r\n").alias("text"))
    lines.repartition("file_id").write.partitionBy("file_id").text(path)
    return roster.read_rosters(v.spark, f"{path}/*", r"file_id=([^/]*)/").drop("line_no")


# Each benchmark exam as a document: title, standing score, then per question heading, prompt, answer over two lines, score.
EXAM_LINES = """SELECT exam_id AS doc_id, question_number * 10 + k AS line_no, CASE k WHEN 0 THEN CONCAT('Questão ', CAST(question_number AS STRING), ' -') WHEN 1 THEN CONCAT('Enunciado: pergunta ', CAST(id AS STRING))
    WHEN 2 THEN CASE WHEN question_number = 5 THEN '' ELSE CONCAT('Gabarito: resposta ', CAST(id AS STRING)) END WHEN 3 THEN CASE WHEN question_number = 5 THEN '' ELSE 'nota: continua' END
    ELSE CASE WHEN question_number % 2 = 0 THEN 'Pontuação: 2,5' ELSE 'Rubrica: critério' END END AS text
  FROM fx_questions CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k UNION ALL SELECT 4 AS k) s
  UNION ALL SELECT DISTINCT exam_id, 0, CONCAT('Título: Prova ', CAST(exam_id AS STRING)) FROM fx_questions UNION ALL SELECT DISTINCT exam_id, 1, 'Valor padrão por questão: 0,5' FROM fx_questions"""


@query("s4_questions_from_lines", """
SELECT exam_id AS doc_id, question_number, 'Prova ' || exam_id AS title, 'pergunta ' || id AS question_text, CASE WHEN question_number = 5 THEN '' ELSE 'resposta ' || id || chr(10) || 'nota: continua' END AS expected_answer,
  CASE WHEN question_number % 2 = 1 THEN 'critério' ELSE '' END AS correction_criteria, CASE WHEN question_number % 2 = 0 THEN 2.5 ELSE 0.5 END AS max_score, CASE WHEN question_number = 5 THEN 'empty answer' ELSE '' END AS warnings FROM fx_questions""")
def _(v):
    return exam_lines.questions_from_lines(v.sql(EXAM_LINES))
