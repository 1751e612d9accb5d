"""Short-answer text rules: normal forms, variants, laterality, similarity."""

from __future__ import annotations

import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import strip

# Abbreviation -> word, in the order they apply, and spelling aliases.
ABBREVIATIONS = (
    ("musc", "musculo"), ("mm", "musculos"), ("m", "musculo"), ("aa", "arterias"), ("a", "arteria"), ("vv", "veias"), ("v", "veia"),
    ("nn", "nervos"), ("n", "nervo"), ("ll", "ligamentos"), ("l", "ligamento"), ("tt", "tendoes"), ("t", "tendao"), ("oss", "ossos"), ("os", "osso"),
)
ALIASES = (("ilegivel", ""), ("grande dorsal", "latissimo do dorso"), ("anconea?", "anconeo"), ("bucinator", "bucinador"), ("halix", "halux"), ("vleo", "soleo"))
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżžĀĂĄĆĈĊČĎĒĔĖĘĚĜĞĠĢĤĨĪĬĮİĴĶĹĻĽŃŅŇŌŎŐŔŖŘŚŜŞŠŢŤŨŪŬŮŰŲŴŶŸŹŻŽ"
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)


# Patterns that decide normal forms, variants and sides, in the order they apply.
COPY_DROPPED = r"[^a-z0-9áàâãéèêíïóôõöúçñ\s]"
GLUED = r"\b({shorts})\.(?=[a-z])"
MUSCLE = r"\b(m|musc|musculo)\.?\b"
LEFT, RIGHT = r"\besq(?:\.|uerda|uerdo)?\b", r"\bdir(?:\.|eita|eito)?\b"
DROPPED, LAST_LEFT, LAST_RIGHT = r"[^a-z0-9\s]", r"(^|\s)e$", r"(^|\s)d$"
ALTERNATIVES = r"\s*(?:;|\||/|\n|, ou | ou )\s*"
SIDES = r"\b(esquerdo|esquerda|direito|direita)\b"


def copy_form(c: Column) -> Column:
    """lower case, Portuguese letters, figures and single blanks only."""
    kept = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), COPY_DROPPED, " ")
    return strip(F.regexp_replace(kept, r"\s+", " "))


def plain_letters(c: Column) -> Column:
    """F12 for Latin letters: accents off, combining marks dropped."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}", "")


@F.pandas_udf(T.StringType())
def nfd_strip(s: pd.Series) -> pd.Series:
    """F12 for all of Unicode."""
    return s.map(lambda x: x if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(T.DoubleType())
def ratcliff_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts; the order of arguments matters."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def letters_bound(a: str, b: str) -> float:
    """What U1 can't exceed: no more characters match than both texts have of a kind. Linear in the lengths."""
    n = len(a) + len(b)
    return 2.0 * sum((Counter(a) & Counter(b)).values()) / n if n else 1.0


def ratio_or_null(a: str | None, b: str | None, least: float | None) -> float | None:
    """U1, or None where a text is missing or the letters in common show that it lies below `least`."""
    if a is None or b is None or (least is not None and letters_bound(a, b) < least):
        return None
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def ratio_at_least(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """U1 where it can reach `least`, else null."""
    return pd.Series([ratio_or_null(*x) for x in zip(a, b, least, strict=True)], dtype="float64")


def expanded_form(c: Column) -> Column:
    """F13's first half: plain lower-case letters with abbreviations written out; P10 shows it."""
    t = F.lower(plain_letters(F.coalesce(c, F.lit(""))))
    shorts = "|".join(a for a, _ in ABBREVIATIONS)
    t = F.regexp_replace(t, GLUED.format(shorts=shorts), "$1. ")
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for short, word in ABBREVIATIONS:
        t = F.regexp_replace(t, rf"\b{short}\.?(?=\s|$)", f" {word} ")
    return t


def normal_form(c: Column) -> Column:
    """the comparable form of a short answer."""
    t = expanded_form(c)
    t = F.regexp_replace(t, MUSCLE, " ")
    t = F.regexp_replace(t, LEFT, " esquerdo ")
    t = F.regexp_replace(t, RIGHT, " direito ")
    t = strip(F.regexp_replace(F.regexp_replace(t, DROPPED, " "), r"\s+", " "))
    t = F.regexp_replace(F.regexp_replace(t, LAST_LEFT, "$1esquerdo"), LAST_RIGHT, "$1direito")
    for alias, word in ALIASES:
        t = F.regexp_replace(t, rf"\b{alias}\b", f" {word} ")
    return strip(F.regexp_replace(t, r"\s+", " "))


TRIMMED = (r"^\s+|\s+$", "")


def normal_rules() -> list[tuple[int, str, str]]:
    """F13 after plain lower-case letters as (step, pattern, word) rows: what a table of rules may start from."""
    steps = [(GLUED.format(shorts="|".join(a for a, _ in ABBREVIATIONS)), "$1. "), (r"^(?s)(.*)$", " $1 ")]
    steps += [(rf"\b{short}\.?(?=\s|$)", f" {word} ") for short, word in ABBREVIATIONS]
    steps += [(MUSCLE, " "), (LEFT, " esquerdo "), (RIGHT, " direito "), (DROPPED, " "), (r"\s+", " "), TRIMMED, (LAST_LEFT, "$1esquerdo"), (LAST_RIGHT, "$1direito")]
    steps += [(rf"\b{alias}\b", f" {word} ") for alias, word in ALIASES]
    return [(k, pattern, word) for k, (pattern, word) in enumerate([*steps, (r"\s+", " "), TRIMMED])]


def normal_form_by(c: Column, rules: DataFrame, most: int = 1000) -> Column:
    """F13 with the rewriting rules of a table rules(step, pattern, word), applied in the order of their steps; the table is a parameter of at
    most `most` rows and goes along with the plan."""
    rows = rules.select("step", "pattern", "word").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rewriting rules")
    steps = F.array(*[F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.word).alias("word")) for r in sorted(rows)])
    plain = F.lower(plain_letters(F.coalesce(c, F.lit(""))))
    return F.aggregate(steps, plain, lambda t, r: F.regexp_replace(t, r["pattern"], r["word"])) if rows else plain


def key_variants(key: Column) -> Column:
    """normal forms of a key's alternatives and of the whole key, blanks dropped, each once."""
    parts = F.split(key, ALTERNATIVES)
    parts = F.filter(parts, lambda p: strip(p) != "")
    return F.filter(F.array_distinct(F.concat(F.transform(parts, normal_form), F.array(normal_form(key)))), lambda v: v != "")


def coverage(answer: Column, key: Column) -> Column:
    """Share of the key's distinct words that the answer holds."""
    a, k = F.split(answer, " "), F.array_distinct(F.split(key, " "))
    return F.size(F.array_intersect(a, k)) / F.greatest(F.size(k), F.lit(1))


def similarity(ratio: Column, answer: Column, key: Column) -> Column:
    """F15, given the texts' ratio."""
    return F.when((answer == "") | (key == ""), 0.0).otherwise(0.65 * ratio + 0.35 * coverage(answer, key))


def laterality(normal: Column) -> Column:
    """F16: left, right, or '' for neither or both."""
    t = F.concat(F.lit(" "), normal)
    left = F.contains(t, F.lit(" esquerdo")) | F.contains(t, F.lit(" esquerda"))
    right = F.contains(t, F.lit(" direito")) | F.contains(t, F.lit(" direita"))
    return F.when(left & ~right, "left").when(right & ~left, "right").otherwise("")


def same_side(answer: Column, key: Column) -> Column:
    a, k = laterality(answer), laterality(key)
    return (a == "") | (k == "") | (a == k)


def without_side(normal: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(normal, SIDES, " "), r"\s+", " "))
