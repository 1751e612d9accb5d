"""Vectors that fix the rules' results, one by one."""

import pytest
from pyspark.sql import functions as F

from lumengrade.functions import grades, identity, json_text, messages, short_answer, values
from lumengrade.operators import grading, linking, payloads, regions, scores
from lumengrade.sources import exam_lines, roster


def one(spark, df, *cols):
    row = df.select(*cols).first()
    return row[0] if len(cols) == 1 else tuple(row)


@pytest.mark.parametrize("text,value,off", [("0.6", 0.5, True), ("0.75", 0.75, False), ("0,75", 0.75, False), ("0.75d", 0.0, True), ("NaN", 0.0, True), (None, 0.0, True), ("0.125", 0.0, True), ("7", 1.0, True)])
def test_clamp(spark, text, value, off):
    got = spark.createDataFrame([(text,)], "x string").select(grades.clamp_grade(F.col("x")).alias("g")).first().g
    assert (got.value, got.off_scale) == (value, off)


SHORT = [
    ("Peitoral maior esquerdo", "m. PeiToral maioR E.", "correta", False), ("Músculo Sóleo Esquerdo", "M. Soleo E", "correta", False), ("Músculo Sóleo Esquerdo", "M.Soleo E.", "correta", False),
    ("Músculo Sóleo Esquerdo", "musc. sóleo esq.", "correta", False), ("Músculo Sóleo Esquerdo", "Sóleo esquerdo (E)", "correta", False), ("Músculo Grande dorsal E", "m. latíssimo do dorso E.", "correta", False),
    ("Músculo Redondo menor E", "m redondo menor e", "correta", False), ("Músculos peitoral maior e redondo menor esquerdo", "Mm. peitoral maior e redondo menor E.", "correta", False),
    ("Artéria braquial direita", "A. braquial D.", "correta", False), ("Latissimo do dorso direito", "m. latissimo do dorso E.", "incorreta", None), ("Músculo Bucinador E", "M. Bucinafor E.", "incorreta", True),
    ("Veia cava superior", "V. cava superior", "correta", False), ("Nervo femoral direito", "N.Femoral D.", "correta", False), ("Ligamento cruzado anterior", "L. cruzado anterior", "correta", False), ("", "x", "sem_rubrica", True), ("Fêmur", " ", "sem_resposta", False), ("Fêmur", "???", "correta", False),
]


def test_short_answers(spark):
    rows = [(i, a, k, "alta", 1.0) for i, (k, a, _, _) in enumerate(SHORT)]
    df = spark.createDataFrame(rows, "id int, answer string, key string, reading_confidence string, max_score double")
    got = {r.id: r for r in grading.grade_short_answers(df).collect()}
    for i, (key, answer, verdict, review) in enumerate(SHORT):
        assert got[i].verdict == verdict, (key, answer, got[i])
        assert review is None or got[i].needs_human_review == review, (key, answer, got[i])
    assert "lateralidade" in got[9].justification and "OCR/abreviação" in got[10].justification and got[14].score is None
    strict = {r.id: r for r in grading.grade_short_answers(df, strict_empty=True).collect()}
    assert strict[16].verdict == "incorreta" and strict[16].needs_human_review


def test_normal_forms(spark):
    rows = [("M.Soleo E.", "soleo esquerdo"), ("Músculo Sóleo Esquerdo", "soleo esquerdo"), ("A.Braquial D.", "arteria braquial direito"), ("Sóleo esquerdo (E)", "soleo esquerdo esquerdo"), ("???", ""), (None, "")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r.got for r in df.select(short_answer.normal_form(F.col("t")).alias("got")).collect()] == [r[1] for r in rows]


def test_discursive(spark):
    prompt = "Explique a função do músculo sóleo na marcha"
    rows = [
        (1, '{"nota": 1 "comentario": "x"}', "a b c", prompt, "alta"),
        (2, '{"nota": 1, "comentario": "ok", "criterios_atendidos": [], "criterios_ausentes": [], "revisao_necessaria": false}', prompt, prompt, "alta"),
        (3, '{"nota": 0.5, "comentario": "x", "criterios_austeis": [], "criterios_ausentes": [], "revisao_necessosa": false}', "a b c", prompt, "alta"),
        (4, '{"nota": 0.5, "comentario": "x", "criterios_atendidos": [], "criterios_ausentes": [], "revisao_necessaria": "t"}', "a b c", prompt, "alta"),
        (5, '{"analysis": "...", "nota": 0.5}', "a b c", prompt, "alta"),
    ]
    df = spark.createDataFrame(rows, "id int, raw string, answer string, prompt string, reading_confidence string").withColumn("max_score", F.lit(1.0))
    got = {r.id: r for r in grading.discursive_grades(df).collect()}
    assert got[1].score == 0.0 and got[1].needs_human_review and got[1].review_reason == "erro_parse"
    assert got[2].score == 0.0 and got[2].verdict == "incorreta" and "cópia do enunciado" in got[2].review_reason
    assert got[3].score == 0.5 and not got[3].schema_valid and "chaves ausentes" in got[3].review_reason
    assert got[4].needs_human_review and "revisao_necessaria" in got[4].review_reason
    assert got[5].score == 0.5 and not got[5].schema_valid and got[5].needs_human_review


def test_copied_by_ratio(spark):
    df = spark.createDataFrame([("a funcao do musculo soleo e flexao planta", "a funcão do musculo soleos e flexao plantar"), ("curto", "curto")], "answer string, prompt string")
    assert [r.copied for r in grading.copied_prompts(df).orderBy(F.desc("answer")).collect()] == [False, True]


def test_json_strictness(spark):
    bad = ['{"nota":1},{"nota":2}', "{'nota': 1}", "[1]", '{"nota": 1} lixo', "nada"]
    df = spark.createDataFrame([(x,) for x in bad], "t string")
    assert [r.o for r in df.select(json_text.strict_object(F.col("t")).alias("o")).collect()] == [None] * 5
    fixed = json_text.with_recovery(spark.createDataFrame([('```json\n{"nota": 0,5,}\n```',)], "t string"), "t").first()._obj
    assert fixed == {"nota": "0.5"}


def test_single_grade(spark):
    rows = [({"score": "0.75", "grading_confidence": "0.82"},), ({"nota": "1.8", "nota_maxima": "1.0", "confianca": "0.9"},), ({"score": "abc"},), (None,)]
    got = [r.g for r in spark.createDataFrame(rows, "m map<string,string>").select(grades.single_grade(F.col("m")).alias("g")).collect()]
    assert (got[0].parse_ok, got[0].score, got[0].confidence) == (True, 0.75, 0.82)
    assert (got[1].parse_ok, got[1].score, got[1].confidence) == (False, 1.0, 0.9)
    assert (got[2].parse_ok, got[2].score) == (False, 0.0) and (got[3].parse_ok, got[3].score) == (False, 0.0)


def _reason(spark, **over):
    base = {"alignment_failed": False, "ocr_error": None, "fallback_ok": False, "parse_failed": False, "score": 1.0, "max_score": 1.0, "grading_confidence": 0.9, "ocr_confidence": 0.9, "text": "uma resposta boa", "needs_fallback": False, "justification": "ok", "model_asked": False, "model_reason": None}
    kinds = {str: "string", bool: "boolean", float: "double", type(None): "string"}
    cols = {k: F.lit(v).cast(kinds[type(v)]) for k, v in (base | over).items()}
    return spark.range(1).select(grades.review_reason(**cols).alias("r")).first().r


def test_review_rules(spark):
    assert _reason(spark) is None
    assert _reason(spark, text=" ") == grades.SHORT_TEXT and _reason(spark, ocr_confidence=0.5) == grades.LOW_OCR
    assert _reason(spark, text="palavra " * 30, score=0.0) == grades.LONG_ZERO and _reason(spark, parse_failed=True) == grades.BAD_FORMAT
    assert _reason(spark, ocr_error="Google Vision retornou HTTP 403.") == "Falha no OCR: Google Vision retornou HTTP 403."
    assert _reason(spark, ocr_error="HTTP 403", fallback_ok=True) is None
    assert _reason(spark, grading_confidence=float("nan")) == grades.LOW_GRADING and _reason(spark, model_asked=True) == grades.MODEL_ASKED


def test_identity(spark):
    a, b, e = "0000abcd-0000-0000-0000-000000000001", "0000abcd-0000-0000-0000-000000000002", "e1"
    rows = [(1, e, e, a, None, b), (2, e, None, None, None, a), (3, e, None, None, None, None), (4, e, "other", a, None, b), (5, e, "other", "bad", a, None)]
    df = spark.createDataFrame(rows, "id int, exam_id string, qr_exam string, qr_student string, header_student string, manifest_student string")
    got = {r.id: r for r in linking.resolve_identity(df).collect()}
    assert [got[i].identity_source for i in range(1, 6)] == ["qr", "manifest_fallback", "anonymous", "manifest_fallback", "header_ocr"]
    assert got[1].identity_warnings == ["QR e manifest discordam. Usando QR."] and "QR ignorado por exam_id divergente." in got[4].identity_warnings and got[5].identity_warnings == []


def test_student_codes(spark):
    rows = [("ALUNO 9", None, "009"), ("Ana", "24102MED1234", "1234"), ("Ana 12", None, "012"), (None, "x", None)]
    df = spark.createDataFrame(rows, "n string, r string, want string").withColumn("got", identity.student_code(F.col("n"), F.col("r")))
    assert [r.got for r in df.collect()] == [r[2] for r in rows]


def test_ocr_chain(spark):
    rows = [(1, "mistral_ocr", "", None, "HTTP 401"), (1, "google_vision", "um texto bem lido", 0.95, None), (2, "mistral_ocr", "texto com três palavras", 0.9, None), (3, "google_vision", "ab", 0.2, "x")]
    df = spark.createDataFrame(rows, "answer_id int, provider string, text string, confidence double, error string")
    got = {r.answer_id: r for r in payloads.resolve_ocr(df, ["mistral_ocr", "google_vision"]).collect()}
    assert got[1].provider == "mistral_ocr->fallback:google_vision" and got[1].error is None and got[1].text == "um texto bem lido"
    assert got[2].provider == "mistral_ocr" and got[3].provider == "google_vision"
    pages = spark.createDataFrame([(1, [("a", "0.9"), ("b", "0.8")]), (2, [("c", "x")])], "answer_id int, pages array<struct<markdown:string,conf:string>>")
    mean = {r.answer_id: (r.text, r.confidence) for r in payloads.mean_confidence(pages).collect()}
    assert mean[1][0] == "a\n\nb" and abs(mean[1][1] - 0.85) < 1e-9 and mean[2] == ("c", None)


def test_exam_lines(spark):
    lines = ["Título da prova: Fisiologia", "Valor padrão: 0,5", "Questão 1", "Enunciado: Defina", "o pulso", "Gabarito: Resposta 1", "obs: segue", "q 2", "Pergunta: B", "Critérios de correção: fica", "Valor: 2,5"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id int, line_no int, text string")
    got = {r.question_number: r for r in exam_lines.questions_from_lines(df).collect()}
    assert got[1].question_text == "Defina\no pulso" and got[1].expected_answer == "Resposta 1\nobs: segue" and got[1].max_score == 0.5 and got[1].title == "Fisiologia"
    assert got[2].max_score == 2.5 and got[2].warnings == "empty answer" and got[2].question_text.startswith("B\nCritérios de correção")


def test_roster_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("lista;x\nMatrícula;Nome;Turma\n1;Zoé;\n2;\n3;Ana;T1\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes('Nome,matricula\n"Silva, J",7\n'.encode())
    wide = ",".join(["x"] * 60)
    (tmp_path / "c.csv").write_bytes(f'\ufeff{wide},Nome,matricula\r\n{wide},"Zé\r\n""Neto""", 8 \r\n{wide}\r\n'.encode())
    (tmp_path / "d.csv").write_bytes(b"")
    got = sorted(tuple(r) for r in roster.read_rosters(spark, str(tmp_path)).select("file_id", "registration_number", "name", "turma").collect())
    assert got == [("a", "1", "Zoé", "T1"), ("a", "3", "Ana", "T1"), ("b", "7", "Silva, J", None), ("c", "8", 'Zé\r\n"Neto"', None)]


def test_rounding_and_reasons(spark):
    assert spark.range(1).select(values.quarter(F.lit(0.125))).first()[0] == 0.0
    said = messages.friendly_reason(F.array(F.lit("JSON recuperado, mas schema incompleto")), F.lit(None).cast("string"), F.lit(False), F.lit(False))
    assert spark.range(1).select(said).first()[0] == "Falha no formato da resposta da IA. Conferir nota sugerida."
    none = messages.friendly_reason(F.lit(None).cast("array<string>"), F.lit(None).cast("string"), F.lit(False), F.lit(False))
    assert spark.range(1).select(none).first()[0] == ""


def test_final_mark(spark):
    s = spark.createDataFrame([(1, n, None, 0.5) for n in (1, 2, 3)], "student_result_id int, question_number int, final_score double, ai_score double")
    e = spark.createDataFrame([(1, 1), (2, 9)], "student_result_id int, exam_id int")
    q = spark.createDataFrame([(1, n) for n in (1, 2, 3)], "exam_id int, question_number int")
    assert {r.student_result_id: r.mark for r in scores.final_mark(s, e, q).collect()} == {1: 0.5, 2: 0.0}


def test_pixels(spark):
    df = spark.createDataFrame([(50.0, 100.0, 400.0, 120.0)], "x_pt double, y_bottom_pt double, width_pt double, height_pt double")
    r = linking.box_to_pixels(df, 842.0, 200).first()
    assert 0 <= r.left < r.right <= 1654 and 0 <= r.upper < r.lower <= 2339


def test_suppression_over_all_boxes(spark):
    near = [(7, f"n{i:02}", i, 0, 100, 100) for i in range(14)]
    apart = [(7, f"r{i:02}", 0, 200 * i, 100, 100) for i in range(1, 15)]
    rows = [*near, *apart, (8, "x", 0, 0, 10, 10), (8, "y", 1, 0, 10, 10), (8, "z", 2, 0, 0, 9), (8, "u", 2, 0, 0, 9), (None, "z", 0, 0, 10, 10)]
    df = spark.createDataFrame(rows, "page_id long, region_id string, x int, y int, w int, h int").repartition(5)
    got = sorted(regions.suppress_regions(df).collect(), key=lambda r: (r.page_id or 0, r.y, r.x, r.region_id))
    assert [(r.page_id, r.region_id) for r in got] == [(None, "z"), (7, "n00"), *[(7, f"r{i:02}") for i in range(1, 12)], (8, "x"), (8, "u"), (8, "z")]


def test_padding_by_the_box(spark):
    df = spark.createDataFrame([(1, "a", 100, 200, 500, 100), (1, "b", 3, 900, 790, 99), (1, "c", 5, 150, 279, 100)], "page_id long, region_id string, x int, y int, w int, h int")
    pages = spark.createDataFrame([(1, 800, 1000)], "page_id long, page_w int, page_h int")
    got = {r.region_id: (r.left, r.upper, r.right, r.lower) for r in regions.answer_regions(df, pages).collect()}
    assert got == {"a": (90, 196, 610, 304), "b": (0, 897, 800, 1000)}


def test_failed_parse_and_truth(spark):
    fine = ', "nota": 1, "comentario": "ok", "criterios_atendidos": ["x", 2], "criterios_ausentes": [], "revisao_necessaria": '
    raws = ["nada", '{"a": 1' + fine + "false}", '{"needs_human_review": 1' + fine + "false}", '{"needs_human_review": "não"' + fine + "false}", '{"needs_human_review": null' + fine + "true}", '{"needs_human_review": []' + fine + "true}", '{"missing_concepts": ["m"], "detected_concepts": "d"' + fine + "false}"]
    df = spark.createDataFrame([(i, r, "a b c", None, "alta", 1.0) for i, r in enumerate(raws)], "id int, raw string, answer string, prompt string, reading_confidence string, max_score double")
    got = {r.id: r for r in grading.discursive_grades(df).collect()}
    assert (got[0].score, got[0].schema_valid, got[0].needs_human_review, got[0].review_reason, got[0].justification, got[0].parse_warnings) == (0.0, True, True, grades.PARSE_ERROR, grades.PARSE_COMMENT, [])
    assert [got[i].needs_human_review for i in range(1, 7)] == [False, True, True, False, False, False]
    assert got[1].detected_concepts == ["x", "2"] and got[6].missing_concepts == ["m"] and got[6].detected_concepts == []


def test_endless_scores(spark):
    rows = [({"score": "inf"},), ({"score": "-Infinity"},), ({"score": "0.5", "manual_review_required": "1", "grading_confidence": "1"},), ({"score": "0.5", "manual_review_required": "0"},)]
    got = [r.g for r in spark.createDataFrame(rows, "m map<string,string>").select(grades.single_grade(F.col("m")).alias("g")).collect()]
    assert [(g.score, g.parse_ok, g.review) for g in got] == [(0.0, False, False), (0.0, False, False), (0.5, True, True), (0.5, True, False)]


def test_vision_identity(spark):
    page = '{"student": {"name": "ALUNO 7", "registration": "", "class": "T1"}, "page_number": 4, "questions": [{"answer_transcription": " "}, {"answer_transcription": "", "has_answer": true}]}'
    got = sorted(payloads.vision_questions(spark.createDataFrame([("r", 2, page)], "run_id string, position int, payload string")).collect(), key=lambda r: r.place)
    assert [(r.student_code, r.class_name, r.physical_page, r.has_answer, r.question_number) for r in got] == [("007", "T1", 4, True, 1), ("007", "T1", 4, True, 2)]


def test_discursive_copied_by_ratio(spark):
    prompt = "a função do músculo sóleo e flexão plantar do pé"
    fine = '{"nota": 1, "comentario": "ok", "criterios_atendidos": [], "criterios_ausentes": [], "revisao_necessaria": false}'
    rows = [(1, fine, "a funcão do múscolo sóleos e flexao plantar do pe", prompt), (2, fine, "move o tornozelo e ajuda na marcha", prompt), (3, fine, None, None), (4, fine, "a funcão do múscolo sóleos e flexao plantar do pe", prompt)]
    df = spark.createDataFrame(rows, "id int, raw string, answer string, prompt string").withColumns({"reading_confidence": F.lit("alta"), "max_score": F.lit(1.0)})
    assert not any(r.c for r in df.select(F.coalesce(grading.overlap_copied(F.col("answer"), F.col("prompt")), F.lit(False)).alias("c")).collect())
    got = {r.id: r for r in grading.discursive_grades(df).collect()}
    for i in (1, 4):
        assert (got[i].score, got[i].verdict, got[i].needs_human_review, got[i].review_reason) == (0.0, "incorreta", True, grades.COPIED)
    assert len(got) == 4 and got[2].score == 1.0 and not got[2].needs_human_review
