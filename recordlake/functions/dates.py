"""Date normalisation to ISO strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Portuguese month names (fixed values).
MONTHS = ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]


def _make(year: Column, month: Column, day: Column) -> Column:
    """ISO date of its parts in digits; null where one is missing or there is no such day."""
    part = lambda c, n: F.when(F.length(F.trim(c)).between(1, n), F.lpad(F.trim(c), n, "0"))
    text = F.concat(part(year, 4), F.lit("-"), part(month, 2), F.lit("-"), part(day, 2))
    return text.try_cast("date").cast("string")


def normalize_date(c: Column) -> Column:
    """ISO date of the many forms that sources print; impossible dates are null.

    In order: ISO date or timestamp (its own date part), compact ISO, day first with ``/ - .``, year
    first with ``/``, written-out Portuguese; then the first date-like token, two-digit years being 20xx.
    Each form is told by one test and cut by places or marks; the token is looked for only where they fail.
    """
    text = F.lower(F.trim(F.regexp_replace(c, r"[\s\u00a0]+", " ")))
    cut = lambda i, n: F.substring(text, i, n)
    parts, slashed = F.split(text, "[/.-]"), F.split(text, "/")
    months = F.create_map(*(F.lit(x) for i, name in enumerate(MONTHS, 1) for x in (name.replace("ç", "c"), str(i))))
    spelled = r"(\d{1,2})º? de ([a-zç]+) de (\d{4})"
    word = lambda i: F.regexp_extract(text, spelled, i)
    whole = (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(?:$|[t ])"), _make(cut(1, 4), cut(6, 2), cut(9, 2)))
        .when(text.rlike(r"^\d{8}$"), _make(cut(1, 4), cut(5, 2), cut(7, 2)))
        .when(text.rlike(r"^\d{1,2}([/.-])\d{1,2}\1\d{4}$"), _make(parts[2], parts[1], parts[0]))
        .when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), _make(slashed[0], slashed[1], slashed[2]))
        .when(text.rlike(spelled), _make(word(3), F.element_at(months, F.replace(word(2), F.lit("ç"), F.lit("c"))), word(1)))
    )
    token = F.split(F.regexp_extract(text, r"\d{1,4}[./-]\d{1,2}[./-]\d{2,4}", 0), "[/.-]")
    last = F.when(F.length(F.get(token, F.lit(2))) == 2, F.concat(F.lit("20"), F.get(token, F.lit(2)))).otherwise(F.get(token, F.lit(2)))
    middle, first = F.get(token, F.lit(1)), F.get(token, F.lit(0))
    return F.coalesce(whole, _make(last, middle, first), _make(first, middle, F.get(token, F.lit(2))))


def excel_serial_date(c: Column) -> Column:
    """Day number of a sheet as ISO date; ISO dates pass, anything else comes back as it is."""
    days = c.try_cast("double")
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c).when(days.isNotNull(), F.date_add(F.lit("1899-12-30").cast("date"), days.cast("int")).cast("string")).otherwise(c)


def array_date(c: Column) -> Column:
    """``[y, m, d]`` as ISO date; null where parts are missing or impossible."""
    return F.when(F.size(c) >= 3, _make(c[0].cast("string"), c[1].cast("string"), c[2].cast("string")))


def text_date(c: Column) -> Column:
    """``N/D`` is null, else the first ten characters."""
    return F.when(F.upper(F.trim(c)) == "N/D", F.lit(None)).otherwise(F.nullif(F.substring(c, 1, 10), F.lit("")))
