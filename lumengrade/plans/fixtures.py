"""Views of the given tables that stand for the exam entities; the same text runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURES = {
    "fx_scores": """
SELECT l_orderkey AS student_result_id, l_linenumber AS question_number,
       CONCAT(CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_extendedprice AS STRING)) AS id,
       CAST(l_suppkey % 20 AS INT) + 1 AS source_page_number, l_partkey AS box_pos, ROUND(l_discount * 10, 2) AS ai_score,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE ROUND(l_discount * 10, 2) END AS final_score,
       l_returnflag = 'R' AS requires_manual_review, l_linestatus = 'O' AS model_flag,
       ROUND(1 - 5 * l_tax, 2) AS grading_confidence, ROUND(0.5 + l_quantity / 100, 2) AS ocr_confidence
FROM lineitem""",
    "fx_results": """
SELECT o_orderkey AS id, o_custkey AS student_id, YEAR(o_orderdate) * 100 + MONTH(o_orderdate) AS batch_id,
       CAST(o_orderkey % 40 AS INT) + 1 AS page_number,
       CASE o_orderstatus WHEN 'P' THEN 'GRADED' WHEN 'O' THEN 'AUTO_APPROVED' ELSE 'REVIEWED' END AS status,
       CASE SUBSTR(o_orderpriority, 1, 1) WHEN '1' THEN 'manifest_fallback' WHEN '5' THEN 'anonymous'
            WHEN '2' THEN 'header_ocr' ELSE 'qr' END AS identity_source, o_orderdate AS created_at
FROM orders""",
    "fx_batches": """
SELECT YEAR(o_orderdate) * 100 + MONTH(o_orderdate) AS id,
       CAST(MIN(YEAR(o_orderdate) * 100 + MONTH(o_orderdate)) % 5 AS INT) AS exam_id,
       CAST(MIN(o_custkey) % 3 AS INT) AS user_id, CAST(COUNT(*) AS INT) AS total_pages, MIN(o_orderdate) AS created_at
FROM orders GROUP BY YEAR(o_orderdate) * 100 + MONTH(o_orderdate)""",
    "fx_students": """
SELECT c_custkey AS id, c_nationkey AS class_id, c_name AS name,
       CONCAT('24102MED', CAST(c_custkey AS STRING)) AS registration_number, c_mktsegment AS curso FROM customer""",
    "fx_classes": "SELECT n_nationkey AS id, n_name AS name FROM nation",
    "fx_questions": """
SELECT CAST(item_id AS INT) AS id, CAST(FLOOR(item_id / 8.0) AS INT) AS exam_id, CAST(item_id % 8 AS INT) + 1 AS question_number,
       text AS question_text, text AS expected_answer, CAST(1.0 AS DOUBLE) AS max_score FROM benchmark""",
    "fx_answers": """
SELECT d.doc_id AS id, d.source AS run_id, CAST(d.doc_id % 30 AS INT) + 1 AS page_number, CAST(d.doc_id % 5 AS INT) AS question_number,
       CASE WHEN d.doc_id % 7 = 0 THEN ' ' ELSE CONCAT('ALUNO ', CAST(d.doc_id % 40 AS STRING)) END AS student_name,
       CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE CONCAT('24102MED', CAST(d.doc_id % 40 AS STRING)) END AS registration,
       CASE WHEN d.doc_id % 2 = 0 THEN CAST(d.doc_id % 40 AS STRING) ELSE '' END AS detected_student_code,
       d.text AS answer_transcription,
       CASE WHEN l.quality = 0 THEN 'baixa' WHEN l.quality = 1 THEN 'alta' ELSE 'media' END AS reading_confidence,
       CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE CAST(d.doc_id % 5 AS DOUBLE) / 4 END AS score,
       COALESCE(l.toxic = 1, FALSE) AS needs_human_review
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "fx_turns": """
SELECT conv_id, turn, prompt, answer FROM (
  SELECT conv_id, turn, role, text AS prompt, LEAD(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
         LEAD(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer
  FROM conversations) t WHERE role = 'user' AND next_role = 'assistant'""",
    "fx_decisions": """
SELECT event_id, ts, user_id AS student_result_id, CAST(event_id % 7 AS INT) + 1 AS question_number,
       CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'flag' ELSE 'update' END AS action,
       CAST(event_id % 5 AS DOUBLE) / 4 AS final_score, props FROM events""",
    # Scores without repeats, as the other operators see them.
    "fx_scored": """
SELECT student_result_id, question_number, id, source_page_number, box_pos, ai_score, final_score, requires_manual_review, model_flag,
       grading_confidence, ocr_confidence
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY student_result_id, question_number ORDER BY source_page_number, box_pos, id) AS place FROM fx_scores) t
WHERE place = 1""",
    "fx_exam_of": "SELECT r.id AS student_result_id, b.exam_id FROM fx_results r JOIN fx_batches b ON r.batch_id = b.id",
    "fx_exams": """
SELECT CAST(n AS INT) AS id, CONCAT('Prova ', CAST(n AS STRING)) AS name, n % 2 = 0 AS is_practical,
       CASE n % 3 WHEN 0 THEN 'brazil' WHEN 1 THEN 'Canada' ELSE 'nowhere' END AS turma
FROM (SELECT DISTINCT r_regionkey + k AS n FROM region CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 5 AS k) s) t""",
    "fx_review": """
SELECT id, student_result_id, question_number, ai_score AS score, CAST(1.0 AS DOUBLE) AS max_score, box_pos % 50 = 0 AS alignment_failed,
       CASE WHEN box_pos % 17 = 0 THEN 'HTTP 403' END AS ocr_error, box_pos % 2 = 0 AS fallback_ok, box_pos % 13 = 0 AS parse_failed,
       grading_confidence, ocr_confidence,
       CASE box_pos % 5 WHEN 0 THEN '  ' WHEN 1 THEN 'duas palavras' WHEN 2 THEN REPEAT('palavra longa ', 20) ELSE 'resposta com quatro palavras' END AS text,
       CASE WHEN box_pos % 3 = 0 THEN ' ' ELSE 'ok' END AS justification, model_flag,
       CASE WHEN box_pos % 7 = 0 THEN 'motivo' END AS model_reason
FROM fx_scored""",
    # One latest update per score key, and comments.
    "fx_updates": """
SELECT event_id, ts, student_result_id, question_number, final_score, CONCAT('c', CAST(event_id AS STRING)) AS comment
FROM fx_decisions WHERE action = 'update'""",
    "fx_approvals": "SELECT DISTINCT student_result_id FROM fx_decisions WHERE action = 'approve'",
    "fx_warnings": """
SELECT batch_id, id,
       CASE id % 9 WHEN 0 THEN 'Falha: possível troca de rubrica' WHEN 1 THEN 'JSON recuperado, mas schema incompleto' WHEN 2 THEN 'Falha ao render página'
            WHEN 3 THEN 'Falha no QR' WHEN 4 THEN 'Falha na transcrição' WHEN 5 THEN 'Falha na correção' WHEN 6 THEN 'Falha de database'
            WHEN 7 THEN 'Falha desconhecida' ELSE 'Identidade via manifest_fallback' END AS warning
FROM fx_results""",
    # Pages with identity signals; ids are UUID texts made from keys.
    "fx_pages": """
SELECT o_orderkey AS page_id, YEAR(o_orderdate) * 100 + MONTH(o_orderdate) AS batch_id, CONCAT('exam', CAST(o_custkey % 5 AS STRING)) AS exam_id,
       CAST(o_orderkey % 40 AS INT) + 1 AS page_number,
       CASE WHEN o_orderkey % 6 = 0 THEN 'other' ELSE CONCAT('exam', CAST(o_custkey % 5 AS STRING)) END AS qr_exam,
       CASE WHEN o_orderkey % 4 = 0 THEN 'bad' WHEN o_orderkey % 4 = 1 THEN CONCAT('{0000ABCD-0000-0000-0000-', LPAD(CAST(o_custkey AS STRING), 12, '0'), '}')
            WHEN o_orderkey % 4 = 2 THEN CONCAT('0000abcd00000000', LPAD(CAST(o_custkey AS STRING), 16, '0')) END AS qr_student,
       CASE WHEN o_orderkey % 5 = 0 THEN CONCAT('0000abcd-0000-0000-0000-', LPAD(CAST(o_custkey % 50 AS STRING), 12, '0')) END AS header_student,
       CASE WHEN o_orderkey % 3 = 0 THEN CONCAT('0000abcd-0000-0000-0000-', LPAD(CAST(o_custkey AS STRING), 12, '0')) END AS manifest_student,
       CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CONCAT('nome ', CAST(o_orderkey % 100 AS STRING)) END AS detected_name,
       CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_orderkey % 1000 AS STRING) END AS detected_registration
FROM orders""",
    # One manifest per exam, its page 3 twice; boxes from questions.
    "fx_manifests": """
SELECT exam_id AS id, CONCAT('{"version":1,"pages":[{"physical_index":0,"student_id":"s0","page_in_student":1,"boxes":[', boxes, ']},',
       '{"physical_index":3,"student_id":"old","page_in_student":1,"boxes":[]},{"physical_index":3,"student_id":"new","page_in_student":2,"boxes":[', boxes, ']}',
       CASE WHEN exam_id = 4 THEN ']' ELSE ']}' END) AS layout_manifest_json
FROM (SELECT exam_id, MIN(CONCAT('{"question_number":', CAST(question_number AS STRING), ',"x_pt":50.5,"y_bottom_pt":100.25,"width_pt":400,"height_pt":120.75},{"question_number":99,"x_pt":1,"y_bottom_pt":2,"width_pt":3,"height_pt":4}')) AS boxes
      FROM fx_questions GROUP BY exam_id) t""",
    "fx_boxes": """
SELECT CAST(FLOOR(l_orderkey / 8.0) AS BIGINT) AS page_id, CONCAT(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING)) AS region_id, CAST(l_suppkey % 300 AS INT) AS x,
       CAST(l_partkey % 900 AS INT) AS y, CAST(l_quantity * 20 AS INT) AS w, CAST(l_suppkey % 50 + l_quantity AS INT) * 3 AS h
FROM lineitem""",
    # Raw model outputs with a fault by question number.
    "fx_raw": """
SELECT id, question_number, student_result_id,
       CASE question_number
         WHEN 1 THEN CONCAT('{"nota": ', CAST(ai_score AS STRING), ', "comentario": "bom", "criterios_atendidos": ["a"], "criterios_ausentes": [], "revisao_necessaria": false}')
         WHEN 2 THEN CONCAT('```json\n{"nota": ', CAST(ai_score AS STRING), ', "comentario": "bom", "criterios_atendidos": [], "criterios_ausentes": [], "revisao_necessaria": "true"}\n```')
         WHEN 3 THEN CONCAT('ok: {"nota": ', CAST(ai_score AS STRING), ', "comentario": "c", "criterios_atendidos": [], "criterios_ausentes": [], "revisao_necessaria": false,}')
         WHEN 4 THEN '{"nota": 0,5, "comentario": "x", "criterios_atendidos": [], "criterios_ausentes": [], "revisao_necessaria": false}'
         WHEN 5 THEN '{“nota”: 1, “comentario”: “x”, “criterios_atendidos”: [], “criterios_ausentes”: [], “revisao_necessaria”: false}'
         WHEN 6 THEN '{"nota": 0.5, "comentario": "x", "criterios_austeis": [], "criterios_ausentes": [], "revisao_necessosa": false}'
         ELSE '{"nota": 0.5, "comentario": "cor' END AS raw,
       CASE WHEN box_pos % 9 = 0 THEN '' WHEN box_pos % 11 = 0 THEN 'Explique a função do músculo sóleo e do tendão [ilegível] [ilegível]' ELSE 'a resposta fala de outra coisa' END AS answer,
       'Explique a função do músculo sóleo e do tendão calcâneo' AS prompt,
       CASE WHEN box_pos % 4 = 0 THEN 'baixa' ELSE 'alta' END AS reading_confidence, CAST(1.0 AS DOUBLE) AS max_score
FROM fx_scored""",
    # Outputs about the given texts, with a fault that the text's length and id decide.
    "fx_outputs": """
SELECT id, fault, CASE fault WHEN 1 THEN CONCAT('```json', CHR(10), good, CHR(10), '```') WHEN 2 THEN CONCAT('Segue a nota: ', good, ' e nada mais.') WHEN 3 THEN CONCAT(SUBSTR(good, 1, LENGTH(good) - 1), ', }')
         WHEN 4 THEN REPLACE(good, '.25,', ',25,') WHEN 5 THEN REPLACE(REPLACE(good, '{"', '{“'), '": ', '”: ') WHEN 6 THEN REPLACE(REPLACE(good, 'criterios_atendidos', 'criterios_atend'), 'revisao_necessaria', 'revisao_necess')
         WHEN 7 THEN SUBSTR(good, 1, LENGTH(good) - 30) WHEN 8 THEN REPLACE(good, 'false', '"true"') WHEN 9 THEN REPLACE(REPLACE(good, '"criterios_ausentes": [], ', ''), '"nota": ', '"nota": [], "x": ')
         WHEN 10 THEN CONCAT('{"analysis": "', said, '", ', SUBSTR(good, 2, 100000)) WHEN 11 THEN '[1, 2]' WHEN 12 THEN REPLACE(good, '["a"]', '"a"') WHEN 13 THEN CONCAT(good, good) ELSE good END AS raw
FROM (SELECT id, fault, said, CONCAT('{"nota": ', CAST(id % 3 AS STRING), '.25, "comentario": "', said, '", "criterios_atendidos": ["a"], "criterios_ausentes": [], "revisao_necessaria": false}') AS good
  FROM (SELECT id, CAST((LENGTH(answer_transcription) * 7 + id) % 15 AS INT) AS fault,
               TRIM(TRANSLATE(SUBSTR(answer_transcription, 1 + CAST(id % 9 AS INT), 60), CONCAT(CHR(9), CHR(10), CHR(13), CHR(34), CHR(92), '{}[]“”‘’,`'), '               ')) AS said FROM fx_answers WHERE answer_transcription IS NOT NULL) t) g""",
    "fx_ocr": """
SELECT student_result_id * 10 + question_number AS answer_id, CASE WHEN k = 0 THEN 'azure' ELSE 'google' END AS provider,
       CASE WHEN (box_pos + k) % 4 = 0 THEN '' WHEN (box_pos + k) % 4 = 1 THEN 'duas palavras' ELSE CONCAT('texto lido pelo provedor ', CAST(k AS STRING)) END AS text,
       CASE WHEN source_page_number % 5 = 0 THEN NULL ELSE ROUND(ocr_confidence + k * 0.1, 2) END AS confidence,
       CASE WHEN (source_page_number + k) % 6 = 0 THEN CONCAT('HTTP 40', CAST(k AS STRING)) END AS error
FROM fx_scored CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) s WHERE NOT (k = 1 AND box_pos % 10 = 0)""",
    "fx_short": """
SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN CONCAT('m. ', p_name, ' E.') WHEN 1 THEN CASE WHEN p_size % 4 = 0 THEN CONCAT('A.B.', p_name, ' ESQ.') WHEN p_size % 4 = 1 THEN CONCAT('Mm.', p_name, ' direita') ELSE p_name END WHEN 2 THEN CONCAT(SUBSTR(p_name, 2, 60), ' D') WHEN 3 THEN '???' WHEN 4 THEN ' ' ELSE CONCAT('a. ', SUBSTR(p_name, 1, 8)) END AS answer,
       CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN CONCAT(p_name, ' ou ', SUBSTR(p_name, 1, 10)) ELSE CONCAT('Músculo ', p_name, ' esquerdo') END AS key,
       CASE WHEN p_partkey % 10 = 0 THEN 'baixa' ELSE 'alta' END AS reading_confidence, CAST(1.0 AS DOUBLE) AS max_score
FROM part""",
}


def needed(sql: str) -> list[str]:
    """Fixtures that a text uses, each after those it uses itself."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+\b", text):
            if name in FIXTURES and name not in out:
                visit(FIXTURES[name])
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def with_fixtures(sql: str) -> str:
    """sql with the fixtures it uses as leading WITH entries, as DuckDB runs it."""
    heads = [f"{n} AS ({FIXTURES[n]})" for n in needed(sql)]
    body = sql.strip()
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body):
        return f"WITH {m[1] or ''}" + ",\n".join([*heads, body[m.end() :]])
    return f"WITH {',\n'.join(heads)}\n{body}" if heads else body


class Views:
    """Fixtures and given tables as DataFrames of one session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.sql(FIXTURES[name]) if name in FIXTURES else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]

    def sql(self, text: str) -> DataFrame:
        """text with each table after FROM or JOIN bound to its DataFrame."""
        tables = set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)\b(?!\()", text)) - set(re.findall(r"\b(\w+) AS \(", text))
        bound = re.sub(r"\b(FROM|JOIN)\s+(\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in tables else m[0], text.replace("{", "{{").replace("}", "}}"))
        return self.spark.sql(bound, **{t: self[t] for t in tables})
