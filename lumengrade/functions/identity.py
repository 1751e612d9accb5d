"""Identity signals of a page: QR payloads, student codes, grouping keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import first_filled, strip

PREFIX = "MQPC"  # fixed value
# Where a student code stands in a name or registration, first match first.
CODES = (r"(?i)aluno\D*(\d{1,4})", r"(\d{2,4})\s*$")


def parse_qr(payload: Column) -> Column:
    """struct(exam_id, student_id, page, total) of a five-part payload, else null."""
    parts = F.split(strip(payload), r"\|", -1)
    page, total = F.get(parts, F.lit(3)).try_cast("int"), F.get(parts, F.lit(4)).try_cast("int")
    good = (F.size(parts) == 5) & (F.get(parts, F.lit(0)) == PREFIX) & page.isNotNull() & total.isNotNull()
    return F.when(good, F.struct(strip(F.get(parts, F.lit(1))).alias("exam_id"), strip(F.get(parts, F.lit(2))).alias("student_id"), page.alias("page"), total.alias("total")))


def format_qr(exam_id: Column, student_id: Column, page: Column, total: Column) -> Column:
    return F.concat_ws("|", F.lit(PREFIX), exam_id, student_id, page.cast("string"), total.cast("string"))


def first_valid_qr(payloads: Column) -> Column:
    """The first payload of an array that parses."""
    return F.get(F.filter(F.transform(payloads, parse_qr), lambda x: x.isNotNull()), F.lit(0))


def student_code(name: Column, registration: Column) -> Column:
    """Digits after 'aluno', else closing digits; from the name, else the registration; at least three figures; null without any."""

    def digits(c: Column) -> Column:
        c = F.coalesce(c, F.lit(""))
        return first_filled(*[F.regexp_extract(c, p, 1) for p in CODES])

    found = F.coalesce(digits(name), digits(registration))
    return F.when(found.isNotNull(), F.format_string("%03d", found.cast("int")))


def identity_key(code: Column, registration: Column, name: Column, page: Column) -> Column:
    """The first of code, registration, name that isn't blank, else the page."""
    filled = [F.nullif(strip(c), F.lit("")) for c in (code, registration, name)]
    return F.coalesce(*filled, F.concat(F.lit("pagina-"), page.cast("string")))


def screen_key(code: Column, registration: Column, page: Column) -> Column:
    """P8 as the screens group: names don't count."""
    filled = [F.nullif(strip(c), F.lit("")) for c in (code, registration)]
    return F.coalesce(*filled, F.concat(F.lit("page-"), page.cast("string")))
