"""Page linking, layout, task and region queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.identity import first_valid_qr, format_qr, identity_key, parse_qr, screen_key, student_code
from ..functions.values import json_or_null, safe_uuid
from ..operators import grading, linking, regions
from .registry import query

UUID = """CASE WHEN regexp_matches(regexp_replace(regexp_replace(lower(trim({c})), '^urn:uuid:', ''), '[{{}}-]', '', 'g'), '^[0-9a-f]{{32}}$') THEN
  regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '^urn:uuid:', ''), '[{{}}-]', '', 'g'), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') END"""


def uuid_sql(c: str) -> str:
    return UUID.format(c=c)


QR = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN CONCAT('MQPC|', exam_id, '| s', CAST(page_id AS STRING), ' |', CAST(page_number AS STRING), '|2') WHEN 1 THEN CONCAT('MQPC|', exam_id, '|s|x|2')
  WHEN 2 THEN 'OTHER|a|b|1|2' WHEN 3 THEN CONCAT('MQPC|', exam_id, '|s|1') ELSE CONCAT(' MQPC|', exam_id, '|z|', CAST(page_number AS STRING), '|3') END AS payload, exam_id, page_number FROM fx_pages"""


@query("p4_parse_qr", f"""
SELECT page_id, CASE WHEN ok THEN trim(p[2]) END AS exam_id, CASE WHEN ok THEN trim(p[3]) END AS student_id, CASE WHEN ok THEN TRY_CAST(p[4] AS INT) END AS page, CASE WHEN ok THEN TRY_CAST(p[5] AS INT) END AS total
FROM (SELECT page_id, p, len(p) = 5 AND p[1] = 'MQPC' AND TRY_CAST(p[4] AS INT) IS NOT NULL AND TRY_CAST(p[5] AS INT) IS NOT NULL AS ok FROM (SELECT page_id, string_split(trim(payload), '|') AS p FROM ({QR}) q) t) u""")
def _(v):
    return v.sql(QR).withColumn("q", parse_qr(F.col("payload"))).select("page_id", "q.exam_id", "q.student_id", "q.page", "q.total")


@query("p4_first_valid_qr", "SELECT page_id, 'MQPC|' || exam_id || '|s' || page_id || '|' || page_number || '|2' AS payload, page_number AS page FROM fx_pages")
def _(v):
    good = format_qr(F.col("exam_id"), F.concat(F.lit("s"), F.col("page_id").cast("string")), F.col("page_number"), F.lit(2))
    got = v["fx_pages"].withColumn("payload", good).withColumn("q", first_valid_qr(F.array(F.lit("junk"), F.lit("MQPC|a|b|c|d"), F.col("payload"))))
    return got.select("page_id", "payload", "q.page")


@query("p7_student_code", """
SELECT id, CASE WHEN c IS NULL THEN NULL ELSE printf('%03d', CAST(c AS INT)) END AS code FROM (SELECT id, coalesce(
  nullif(regexp_extract(coalesce(student_name, ''), '(?i)aluno\\D*(\\d{1,4})', 1), ''), nullif(regexp_extract(coalesce(student_name, ''), '(\\d{2,4})\\s*$', 1), ''),
  nullif(regexp_extract(coalesce(registration, ''), '(?i)aluno\\D*(\\d{1,4})', 1), ''), nullif(regexp_extract(coalesce(registration, ''), '(\\d{2,4})\\s*$', 1), '')) AS c FROM fx_answers) t""")
def _(v):
    return v["fx_answers"].select("id", student_code(F.col("student_name"), F.col("registration")).alias("code"))


@query("p8_identity_key", """
SELECT id, coalesce(nullif(trim(detected_student_code), ''), nullif(trim(registration), ''), nullif(trim(student_name), ''), 'pagina-' || page_number) AS key,
       coalesce(nullif(trim(detected_student_code), ''), nullif(trim(registration), ''), 'page-' || page_number) AS screen FROM fx_answers""")
def _(v):
    c = F.col
    return v["fx_answers"].select("id", identity_key(c("detected_student_code"), c("registration"), c("student_name"), c("page_number")).alias("key"), screen_key(c("detected_student_code"), c("registration"), c("page_number")).alias("screen"))


@query("p9_override_page", "SELECT page_id, page_number % 7 AS page_number, coalesce(page_number <> page_number % 7, FALSE) AS page_mismatch FROM fx_pages")
def _(v):
    rows = v["fx_pages"].select("page_id", F.col("page_number").alias("reported_page"), (F.col("page_number") % 7).alias("position"))
    return linking.override_page(rows).select("page_id", "page_number", "page_mismatch")


@query("f29_safe_uuid", f"SELECT page_id, {uuid_sql('qr_student')} AS student FROM fx_pages")
def _(v):
    return v["fx_pages"].select("page_id", safe_uuid(F.col("qr_student")).alias("student"))


@query("j13_resolve_identity", f"""
WITH u AS (SELECT page_id, exam_id, qr_exam, {uuid_sql('qr_student')} AS qr, {uuid_sql('header_student')} AS h, {uuid_sql('manifest_student')} AS m FROM fx_pages),
k AS (SELECT *, coalesce(qr IS NOT NULL AND qr_exam = exam_id, FALSE) AS ok FROM u),
s AS (SELECT *, CASE WHEN ok THEN 'qr' WHEN h IS NOT NULL THEN 'header_ocr' WHEN m IS NOT NULL THEN 'manifest_fallback' ELSE 'anonymous' END AS src FROM k)
SELECT page_id, CASE src WHEN 'qr' THEN qr WHEN 'header_ocr' THEN h WHEN 'manifest_fallback' THEN m END AS student_id, src AS identity_source, concat_ws('|', CASE WHEN ok AND m <> qr THEN 'QR e manifest discordam. Usando QR.' END,
  CASE WHEN ok AND h <> qr THEN 'QR e cabeçalho discordam. Usando QR.' END, CASE WHEN NOT ok AND qr IS NOT NULL THEN 'QR ignorado por exam_id divergente.' END, CASE WHEN src = 'header_ocr' AND m <> h THEN 'Cabeçalho e manifest discordam. Usando cabeçalho.' END,
  CASE WHEN src = 'manifest_fallback' THEN 'Identidade via manifest_fallback. Conferir manualmente.' END, CASE WHEN src = 'anonymous' THEN 'Nenhuma identidade confiável encontrada.' END) AS warnings FROM s""")
def _(v):
    return linking.resolve_identity(v["fx_pages"]).select("page_id", "student_id", "identity_source", F.array_join("identity_warnings", "|").alias("warnings"))


FOLD = """SELECT batch_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE CONCAT('s', CAST(page_id % 60 AS STRING)) END AS student_id, CAST(page_id AS INT) AS page_number, detected_name, detected_registration,
  CASE page_id % 3 WHEN 0 THEN 'manifest_fallback' WHEN 1 THEN 'qr' ELSE 'header_ocr' END AS identity_source, CASE page_id % 5 WHEN 0 THEN 'w1' WHEN 1 THEN 'w2' ELSE 'w3' END AS warning FROM fx_pages"""


@query("a5_fold_results", f"""
WITH f AS (SELECT *, coalesce(student_id, 'page:' || page_number) AS result_key FROM ({FOLD}) x),
w AS (SELECT batch_id, result_key, string_agg(warning, ',' ORDER BY p) AS warnings FROM (SELECT batch_id, result_key, warning, min(page_number) AS p FROM f GROUP BY 1, 2, 3) t GROUP BY 1, 2)
SELECT f.batch_id, f.result_key, min(page_number) AS page_number, max(page_number) AS physical_page, arg_max(detected_name, page_number) FILTER (detected_name <> '') AS detected_name,
  arg_max(detected_registration, page_number) FILTER (detected_registration <> '') AS detected_registration,
  CASE WHEN arg_min(identity_source, page_number) = 'manifest_fallback' AND bool_or(identity_source = 'qr') THEN 'qr' ELSE arg_min(identity_source, page_number) END AS identity_source, any_value(w.warnings) AS warnings, count(*) AS pages
FROM f JOIN w ON w.batch_id = f.batch_id AND w.result_key = f.result_key GROUP BY 1, 2""")
def _(v):
    got = linking.fold_results(v.sql(FOLD).withColumn("warnings", F.array("warning")))
    return got.withColumn("warnings", F.array_join("warnings", ","))


def _layout(v):
    pages = linking.manifest_pages(v["fx_manifests"])
    return pages, linking.manifest_boxes(pages)


@query("s2_manifest_pages", "SELECT id AS exam_id, k AS physical_index, CASE k WHEN 0 THEN 's0' ELSE 'new' END AS student_id, CASE k WHEN 0 THEN 1 ELSE 2 END AS page_in_student, 2 AS n_boxes FROM fx_manifests CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 3) s WHERE id <> 4")
def _(v):
    return _layout(v)[0].select("exam_id", "physical_index", "student_id", "page_in_student", F.size("boxes").alias("n_boxes"))


BOXES = """SELECT CAST(m.id AS INT) AS exam_id, k AS physical_index, b AS box_pos, CASE b WHEN 0 THEN 1 ELSE 99 END AS question_number, CASE b WHEN 0 THEN 50.5 ELSE 1.0 END AS x_pt, CASE b WHEN 0 THEN 100.25 ELSE 2.0 END AS y_bottom_pt,
  CASE b WHEN 0 THEN 400.0 ELSE 3.0 END AS width_pt, CASE b WHEN 0 THEN 120.75 ELSE 4.0 END AS height_pt FROM fx_manifests m CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 3) s CROSS JOIN (SELECT 0 AS b UNION ALL SELECT 1) t WHERE m.id <> 4"""


@query("s2_manifest_boxes", f"SELECT exam_id, physical_index, box_pos, question_number, CAST(x_pt AS DOUBLE) AS x_pt, CAST(height_pt AS DOUBLE) AS height_pt FROM ({BOXES}) b")
def _(v):
    return _layout(v)[1].select("exam_id", "physical_index", "box_pos", "question_number", "x_pt", "height_pt")


@query("p5_box_to_pixels", f"""SELECT exam_id, physical_index, box_pos, CAST(trunc(x_pt * (200 / 72.0)) AS INT) AS "left", CAST(trunc((842.0 - y_bottom_pt - height_pt) * (200 / 72.0)) AS INT) AS upper,
  CAST(trunc((x_pt + width_pt) * (200 / 72.0)) AS INT) AS "right", CAST(trunc((842.0 - y_bottom_pt) * (200 / 72.0)) AS INT) AS lower FROM ({BOXES}) b""")
def _(v):
    return linking.box_to_pixels(_layout(v)[1], 842.0, 200).select("exam_id", "physical_index", "box_pos", "left", "upper", "right", "lower")


EXAM_PAGES = "SELECT CAST(o_custkey % 5 AS INT) AS exam_id, CAST(o_orderkey % 6 AS INT) AS physical_index, o_orderkey AS page_id FROM orders"


@query("j4_pages_with_layout", f"SELECT p.page_id, p.exam_id, p.physical_index, CASE WHEN p.exam_id = 4 THEN NULL WHEN p.physical_index = 0 THEN 's0' WHEN p.physical_index = 3 THEN 'new' END AS manifest_student FROM ({EXAM_PAGES}) p")
def _(v):
    return linking.pages_with_layout(v.sql(EXAM_PAGES), _layout(v)[0]).select("page_id", "exam_id", "physical_index", "manifest_student")


@query("j3_crop_tasks", f"SELECT b.exam_id, b.physical_index, b.box_pos, q.id AS question_id FROM ({BOXES}) b JOIN fx_questions q ON q.exam_id = b.exam_id AND q.question_number = b.question_number")
def _(v):
    return linking.crop_tasks(_layout(v)[1], v["fx_questions"]).select("exam_id", "physical_index", "box_pos", "question_id")


DISTINCT_PAGES = f"SELECT DISTINCT exam_id, physical_index FROM ({EXAM_PAGES}) e"
BARE = f"SELECT p.exam_id, p.physical_index, q.question_number, q.id AS question_id FROM ({DISTINCT_PAGES}) p JOIN fx_questions q ON q.exam_id = p.exam_id WHERE p.exam_id = 4 OR p.physical_index NOT IN (0, 3)"


@query("j5_fallback_tasks", f"SELECT exam_id, physical_index, question_id FROM ({BARE}) b")
def _(v):
    return linking.fallback_tasks(v.sql(DISTINCT_PAGES), _layout(v)[1], v["fx_questions"]).select("exam_id", "physical_index", "question_id")


@query("un2_grading_tasks", f"""SELECT b.exam_id, b.physical_index, b.box_pos, q.id AS question_id, FALSE AS whole_page FROM ({BOXES}) b JOIN fx_questions q ON q.exam_id = b.exam_id AND q.question_number = b.question_number
  UNION ALL SELECT exam_id, physical_index, question_number, question_id, TRUE FROM ({BARE}) r""")
def _(v):
    return linking.grading_tasks(v.sql(DISTINCT_PAGES), _layout(v)[1], v["fx_questions"]).select("exam_id", "physical_index", "box_pos", "question_id", "whole_page")


SITTING = "SELECT CAST(class_id % 5 AS INT) AS exam_id, id AS student_id, registration_number FROM fx_students"
SHEETS = "SELECT DISTINCT exam_id, CAST(CEIL(question_number / 3.0) AS INT) AS page_in_student FROM fx_questions"


@query("j14_sheet_manifest", f"""SELECT s.exam_id, s.student_id, l.page_in_student, row_number() OVER (PARTITION BY s.exam_id ORDER BY s.registration_number, s.student_id, l.page_in_student) - 1 AS physical_index,
  count(*) OVER (PARTITION BY s.exam_id, s.student_id) AS total_pages_for_student FROM ({SITTING}) s JOIN ({SHEETS}) l ON l.exam_id = s.exam_id""")
def _(v):
    return linking.sheet_manifest(v.sql(SITTING), v.sql(SHEETS)).select("exam_id", "student_id", "page_in_student", "physical_index", "total_pages_for_student")


RUNS = "SELECT id, CASE WHEN id % 11 = 0 THEN 77 WHEN id % 13 = 0 THEN 9 ELSE exam_id END AS exam_id, id % 7 <> 0 AS readable FROM fx_batches"


@query("j15_validate_batches", f"""SELECT b.id, CASE WHEN e.id IS NULL THEN 'exam not found' WHEN b.exam_id NOT IN (SELECT exam_id FROM fx_questions) THEN 'exam without questions' WHEN NOT readable THEN 'file unreadable' END AS reason,
  CASE WHEN e.id IS NULL OR b.exam_id NOT IN (SELECT exam_id FROM fx_questions) OR NOT readable THEN 'FAILED' ELSE 'PROCESSING' END AS status FROM ({RUNS}) b LEFT JOIN fx_exams e ON e.id = b.exam_id""")
def _(v):
    return linking.validate_batches(v.sql(RUNS), v["fx_exams"], v["fx_questions"]).select("id", "reason", "status")


STATES = "SELECT id, exam_id, CASE WHEN id % 3 = 0 THEN exam_id ELSE exam_id + 1 END AS new_exam_id, CASE id % 4 WHEN 0 THEN 'PROCESSING' WHEN 1 THEN 'DONE' WHEN 2 THEN 'REVIEW_PENDING' ELSE 'FAILED' END AS status FROM fx_batches"


@query("p16_eligible_batches", f"""SELECT 'reprocess' AS mode, id, status <> 'PROCESSING' AS eligible FROM ({STATES}) a UNION ALL SELECT 'reupload', id, status <> 'PROCESSING' AND new_exam_id = exam_id FROM ({STATES}) b
  UNION ALL SELECT 'run_now', id, status = 'FAILED' FROM ({STATES}) c""")
def _(v):
    rows = v.sql(STATES)
    one = lambda m: linking.eligible_batches(rows, m).select(F.lit(m).alias("mode"), "id", "eligible")
    return one("reprocess").unionByName(one("reupload")).unionByName(one("run_now"))


NATIONS = "SELECT id, CASE id % 3 WHEN 0 THEN 'Brazil' ELSE LOWER(name) END AS name FROM fx_classes"


@query("j9_match_class", f"SELECT e.id, e.turma, (SELECT min(c.id) FROM ({NATIONS}) c WHERE lower(c.name) = lower(e.turma)) AS class_id FROM fx_exams e")
def _(v):
    return linking.match_class(v["fx_exams"], v.sql(NATIONS)).select("id", "turma", "class_id")


@query("p2_list_exams", "SELECT id, name FROM fx_exams WHERE is_practical")
def _(v):
    return linking.list_exams(v["fx_exams"], True).select("id", "name")


PICK = "SELECT page_id, page_number, 40 AS n_pages, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '1, 3,5,99' WHEN 2 THEN '7' ELSE 'x,2' END AS spec FROM fx_pages"


@query("p1_select_pages", f"SELECT page_id, page_number FROM ({PICK}) p WHERE spec = '' OR (spec = '1, 3,5,99' AND page_number IN (1, 3, 5)) OR (spec = '7' AND page_number = 7) OR (spec = 'x,2' AND page_number = 2)")
def _(v):
    return linking.select_pages(v.sql(PICK), F.col("spec")).select("page_id", "page_number")


SHEET = "SELECT DISTINCT page_id, 800 AS page_w, 1000 AS page_h FROM fx_boxes"
CANDIDATES = "SELECT page_id, region_id, x, y, w, h FROM fx_boxes r WHERE w * h >= 0.025 * (800 * 1000) AND w >= 800 * 0.35 AND h >= 1000 * 0.05 AND y >= 1000 * 0.10"
PADDED = """SELECT page_id, region_id, greatest(0, x - CAST(trunc(w * CAST(0.02 AS DOUBLE)) AS INT)) AS "left", greatest(0, y - CAST(trunc(h * CAST(0.04 AS DOUBLE)) AS INT)) AS upper,
  least(800, x + w + CAST(trunc(w * CAST(0.02 AS DOUBLE)) AS INT)) AS "right", least(1000, y + h + CAST(trunc(h * CAST(0.04 AS DOUBLE)) AS INT)) AS lower FROM"""
# Whether boxes a and b overlap by more than 65 % of the smaller one.
OVERLAP = """coalesce(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))
  / nullif(CAST(least({a}.w * {a}.h, {b}.w * {b}.h) AS DOUBLE), 0) > 0.65, FALSE)"""


@query("p6_region_candidates", f"{PADDED} ({CANDIDATES}) c")
def _(v):
    return regions.padded(regions.region_candidates(v["fx_boxes"], v.sql(SHEET)))


@query("j10_overlapping_pairs", f"""WITH c AS ({CANDIDATES})
SELECT a.page_id, a.region_id AS a, b.region_id AS b FROM c a JOIN c b ON a.page_id = b.page_id AND (a.y, a.x, a.region_id) < (b.y, b.x, b.region_id) WHERE {OVERLAP.format(a="a", b="b")}""")
def _(v):
    return regions.overlapping_pairs(regions.region_candidates(v["fx_boxes"], v.sql(SHEET)))


# A fold over the page's boxes in (y, x) order; its state is the list of the kept ones.
@query("j10_suppress_regions", f"""
WITH RECURSIVE n AS (SELECT page_id, {{'id': region_id, 'x': x, 'y': y, 'w': w, 'h': h}} AS b, row_number() OVER (PARTITION BY page_id ORDER BY y, x, region_id) AS k FROM ({CANDIDATES}) c),
f AS (SELECT page_id, k, [b] AS kept FROM n WHERE k = 1
  UNION ALL SELECT n.page_id, n.k, CASE WHEN len(f.kept) >= 12 OR len(list_filter(f.kept, lambda o: {OVERLAP.format(a="n.b", b="o")})) > 0 THEN f.kept ELSE list_append(f.kept, n.b) END FROM f JOIN n ON n.page_id = f.page_id AND n.k = f.k + 1),
t AS (SELECT page_id, unnest(arg_max(kept, k)) AS b FROM f GROUP BY page_id)
{PADDED} (SELECT page_id, b.id AS region_id, b.x AS x, b.y AS y, b.w AS w, b.h AS h FROM t) s""")
def _(v):
    return regions.answer_regions(v["fx_boxes"], v.sql(SHEET))


GUARD = "SELECT id, CAST(id % 8 AS INT) + 1 AS question_number, answer_transcription AS rubric_text, score FROM fx_answers"


@query("f24_semantic_guard", f"""SELECT id, question_number, CASE WHEN question_number <= 3 AND NOT (contains(lower(rubric_text), 'the') OR contains(lower(rubric_text), 'la')) THEN 0.0 ELSE score END AS score,
  question_number <= 3 AND NOT (contains(lower(rubric_text), 'the') OR contains(lower(rubric_text), 'la')) AS possible_rubric_swap FROM ({GUARD}) g""")
def _(v):
    guards = v["fx_questions"].where("question_number <= 3").select("question_number").distinct().withColumn("terms", F.array(F.lit("The"), F.lit("la")))
    return grading.semantic_guard(v.sql(GUARD), guards)


# A term from the middle of each text, for one question each.
TERMS = "SELECT CAST(doc_id % 8 AS INT) + 1 AS question_number, SUBSTR(text, 40, 5) AS term FROM documents WHERE doc_id % 8 <> 5"


@query("f24_many_terms", f"""WITH t AS (SELECT DISTINCT question_number, lower(term) AS term FROM ({TERMS}) x WHERE term IS NOT NULL),
m AS (SELECT g.id, bool_or(contains(lower(rubric_text), term)) AS met FROM ({GUARD}) g JOIN t ON t.question_number = g.question_number GROUP BY 1)
SELECT g.id, g.question_number, CASE WHEN m.id IS NOT NULL AND NOT coalesce(met, FALSE) THEN 0.0 ELSE score END AS score, m.id IS NOT NULL AND NOT coalesce(met, FALSE) AS possible_rubric_swap FROM ({GUARD}) g LEFT JOIN m ON m.id = g.id""")
def _(v):
    return grading.guard_by_terms(v.sql(GUARD), v.sql(TERMS))


@query("f30_json_or_null", "SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE '[\"' || run_id || '\",\"' || reading_confidence || '\"]' END AS j FROM fx_answers")
def _(v):
    arr = F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("run_id", "reading_confidence"))
    return v["fx_answers"].select("id", json_or_null(arr).alias("j"))
