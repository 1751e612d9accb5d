"""Column helpers for loosely typed values: text trimming, falsy defaults, number grammar, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def strip(c: Column) -> Column:
    """white space of any kind off both ends (trim alone takes blanks only)."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def first_filled(*cols: Column) -> Column:
    """F27 for text: the first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def first_nonzero(*cols: Column) -> Column:
    """F27 for numbers: the first that is neither null nor zero."""
    return F.coalesce(*[F.when(c != 0, c) for c in cols])


def decimal_or_null(c: Column) -> Column:
    """A text with a dot or comma decimal as double, null where it isn't a plain number."""
    t = F.replace(strip(c), F.lit(","), F.lit("."))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def decimal_or(c: Column, default: float) -> Column:
    """comma-decimal parse with a default."""
    return F.coalesce(decimal_or_null(c), F.lit(float(default)))


def quarter(c: Column) -> Column:
    """nearest quarter, halves to the even quarter."""
    return F.bround(c * 4, 0) / 4


def unit_interval(c: Column) -> Column:
    """clamp to [0, 1]; null and NaN stay null."""
    return F.when(c.isNotNull() & ~F.isnan(c), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def word_count(c: Column) -> Column:
    """words between white space; null has none."""
    return F.coalesce(F.size(F.filter(F.split(c, r"\s+"), lambda x: x != "")), F.lit(0))


def needs_fallback(text: Column, confidence: Column) -> Column:
    """fewer than 3 words, or a known confidence under 0.70."""
    return (word_count(text) < 3) | F.coalesce(confidence < 0.70, F.lit(False))


def json_or_null(arr: Column) -> Column:
    """array to JSON text, empty to null."""
    return F.when(F.size(arr) > 0, F.to_json(arr))


def truthy_text(c: Column) -> Column:
    """Whether a value read as text counts as true: not where it is empty, false, zero or an empty list or object; null stays null."""
    return ~(F.lower(strip(c)).isin("", "false", "[]", "{}") | (F.coalesce(strip(c).try_cast("double"), F.lit(1.0)) == 0))


def iso_timestamp(ts: Column) -> Column:
    """F32: ISO text of a timestamp, for the report edge."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def safe_uuid(c: Column) -> Column:
    """canonical lower-case UUID text, else null; hyphens, braces and the urn prefix may vary."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "^urn:uuid:", ""), "[{}-]", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
