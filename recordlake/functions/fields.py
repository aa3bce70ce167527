"""Fields of single sources as Column expressions: titles, sheet rows, JSON values, embedded files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlake.functions.dates import excel_serial_date
from recordlake.functions.text import collapse_space, nonblank, slug

#: Keys that name a JSON object, in order of preference (fixed values).
NAME_KEYS = ("descricao", "nome", "name", "label", "sigla", "codigo", "id")
#: Marks of an address that answers searches (fixed values).
ENDPOINT_MARKS = ("/api", "search", "juris", "document", "query")


def split_class_subject(c: Column) -> Column:
    """``class / subject`` at the first slash; without one all is the class. Null or empty gives nulls."""
    at = F.instr(c, "/")
    return F.struct(
        F.when(c != "", F.trim(F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c))).alias("case_class"),
        F.when(at > 0, F.trim(F.substring(c, at + 1, F.length(c)))).alias("subject"),
    )


def theme_number(title: Column) -> Column:
    return F.regexp_extract(title, r"(?i)Tema\s+0*(\d+)", 1).try_cast("long")


def title_status(title: Column) -> Column:
    """What stands in parentheses at the title's end."""
    return F.nullif(collapse_space(F.regexp_extract(title, r"\(([^)]+)\)\s*$", 1)), F.lit(""))


def sheet_case_number(case_class: Column, number: Column, state: Column) -> Column:
    """``class number/state`` of what is there; the state only behind something."""
    some = lambda c: F.nullif(c, F.lit(""))
    base = F.concat_ws(" ", some(case_class), some(number))
    return F.when((base != "") & some(state).isNotNull(), F.concat(base, F.lit("/"), state)).otherwise(base)


def sheet_result(bulletin: Column, title: Column, index: Column, case_class: Column, number: Column, state: Column, day: Column) -> Column:
    """Id, number and day of a bulletin sheet's row; the id names the case, else the title, else the row."""
    case = sheet_case_number(case_class, number, state)
    name = F.coalesce(F.nullif(case, F.lit("")), F.nullif(title, F.lit("")), index.cast("string"))
    return F.struct(F.concat(F.lit("stf-informativo-"), F.coalesce(bulletin, F.lit("")), F.lit("-"), slug(name)).alias("id"), case.alias("number"), excel_serial_date(day).alias("day"))


def embedded_file(c: Column) -> Column:
    """SHA-256 and size of a base64 value; null where it is empty or no base64."""
    body = F.try_to_binary(nonblank(c), F.lit("base64"))
    return F.when(F.octet_length(body) > 0, F.struct(F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("long").alias("bytes")))


def json_text(c: Column) -> Column:
    """A JSON value as text: an object by its first name key that has a value, a list's items joined by ``; ``."""
    named = lambda v: F.coalesce(F.when(F.trim(v).startswith("{"), F.coalesce(*(nonblank(F.get_json_object(v, f"$.{k}")) for k in NAME_KEYS), F.lit(""))), F.trim(v), F.lit(""))
    items = F.transform(F.from_json(c, "array<string>"), named)
    return F.when(F.trim(c).startswith("["), F.array_join(F.filter(items, lambda x: x != ""), "; ")).otherwise(named(c))


def json_strings(c: Column) -> Column:
    """All string values of a JSON text at any depth, in order; keys are no values."""
    literals = F.regexp_extract_all(c, F.lit(r'"(?:[^"\\]++|\\.)*+"(?:\s*:)?'), 0)
    values = F.filter(literals, lambda x: x.endswith('"'))
    return F.from_json(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), "array<string>")


def endpoint_like(c: Column) -> Column:
    low = F.lower(c)
    marked = low.contains(ENDPOINT_MARKS[0])
    for mark in ENDPOINT_MARKS[1:]:
        marked = marked | low.contains(mark)
    return c.rlike("^(/|https?://)") & marked


def first_uuid(*columns: Column) -> Column:
    """The first of the values that is a UUID."""
    whole = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
    return F.coalesce(*(F.when(F.trim(c).rlike(whole), F.trim(c)) for c in columns))


def labelled_fields(text: Column, patterns: dict[str, str]) -> Column:
    """First group of each pattern, white space collapsed; null where it doesn't occur."""
    return F.struct(*(F.nullif(collapse_space(F.regexp_extract(text, f"(?i){p}", 1)), F.lit("")).alias(name) for name, p in patterns.items()))


def summary_chars(summary: Column) -> Column:
    return F.length(F.coalesce(summary, F.lit(""))).cast("long")
