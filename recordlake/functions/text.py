"""Text functions as Column expressions; Arrow UDFs only where Spark has no builtin (Unicode forms)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlake.scratch import tidy


def nonblank(c: Column) -> Column:
    """The trimmed value, or null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def first_nonempty(*columns: Column) -> Column:
    return F.coalesce(*map(nonblank, columns))


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _normalized(value: str | None, keep_lines: bool) -> str | None:
    if value is None:
        return None
    value = unicodedata.normalize("NFKC", value).replace("\xa0", " ")
    if keep_lines:
        lines = (" ".join(line.split()) for line in value.splitlines())
        value = "\n".join(line for line in lines if line)
    else:
        value = " ".join(value.split())
    return value or None


@F.arrow_udf(T.StringType())
def normalize_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """NFKC, no-break spaces to spaces, white space collapsed, blank to null; memory is given back after a task."""
    for values in tidy(iter)(batches):
        yield pa.array((_normalized(v.as_py(), False) for v in values), pa.string())


@F.pandas_udf(T.StringType())
def normalize_lines(values: pd.Series) -> pd.Series:
    """Like ``normalize_text``, keeping non-empty lines apart."""
    return values.map(lambda v: _normalized(v, True))


def fold_value(value: str | None) -> str | None:
    if value is None:
        return None
    return "".join(ch for ch in unicodedata.normalize("NFKD", value.casefold()) if not unicodedata.combining(ch))


@F.pandas_udf(T.StringType())
def accent_fold(values: pd.Series) -> pd.Series:
    """Case and accents removed, for searching."""
    return values.map(fold_value)


def map_fold(c: Column) -> Column:
    """The fixed twelve-letter fold of lower-cased text."""
    return F.translate(F.lower(c), "áàâãéêíóôõúç", "aaaaeeiooouc")


@F.pandas_udf(T.StringType())
def ascii_key(values: pd.Series) -> pd.Series:
    """ASCII field key: runs of other than a-z, 0-9 and parentheses become one underscore."""
    import re

    return values.map(lambda v: None if v is None else re.sub(r"[^a-z0-9()]+", "_", fold_value(v).encode("ascii", "ignore").decode()).strip("_"))


def accent_contains(haystack: Column, needle: str) -> Column:
    """Accent- and case-insensitive substring test."""
    return accent_fold(haystack).contains(fold_value(needle))


def normalize_court_code(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(c), "-", " "), r"(?U)\s+", "")


def normalize_cnj_number(c: Column) -> Column:
    """Twenty digits as a unified case number, anything else collapsed."""
    digits = F.regexp_replace(c, r"\D", "")
    shaped = F.regexp_replace(digits, r"^(\d{7})(\d{2})(\d{4})(\d)(\d{2})(\d{4})$", r"$1-$2.$3.$4.$5.$6")
    return F.when(F.length(digits) == 20, shaped).otherwise(F.nullif(collapse_space(c), F.lit("")))


CNJ_PATTERN = r"\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}"


def find_case_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, CNJ_PATTERN, 0), F.lit(""))


def normalize_decision_type(c: Column) -> Column:
    """First rule that fits of an ordered list of substrings; else the folded name."""
    low = map_fold(collapse_space(c))
    rule = F.when(low == "", F.lit(None))
    for part, name in (("acord", "acordao"), ("senten", "sentenca"), ("monocr", "decisao_monocratica"), ("despacho", "despacho"), ("decis", "decisao")):
        rule = rule.when(low.contains(part), F.lit(name))
    return rule.otherwise(low)


def lenient_decision_type(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.contains("ac") & low.contains("rd"), "acordao").when(low.contains("senten"), "sentenca").when(low.contains("decis"), "decisao")


def slug(c: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.lower(cut), F.lit("")), F.lit("registro"))


def drop_fragment(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(c), "#.*$", ""), F.lit(""))


@F.pandas_udf(T.StringType())
def join_url(urls: pd.Series, bases: pd.Series) -> pd.Series:
    """A possibly relative URL against its base, without fragment."""
    return pd.Series([None if not (u or "").strip() else urljoin(b or "", u.strip()).split("#")[0] or None for u, b in zip(urls, bases, strict=True)])


@F.pandas_udf(T.StringType())
def absolute_url(urls: pd.Series, bases: pd.Series) -> pd.Series:
    """A possibly relative URL against its base, fragment and all; null where they can't be joined."""

    def one(url: str | None, base: str | None) -> str | None:
        try:
            return urljoin(base or "", url or "")
        except ValueError:
            return None

    return pd.Series([one(u, b) for u, b in zip(urls, bases, strict=True)])


def strip_session(c: Column) -> Column:
    """URL without session path parameters and token arguments."""
    cut = F.regexp_replace(c, r"(?i);jsessionid=[^?#]*", "")
    cut = F.regexp_replace(cut, r"(?i)([?&])(?:token|hash|sid|session|sessionid)=[^&#]*", "$1")
    return F.regexp_replace(F.regexp_replace(cut, r"([?&])&+", "$1"), r"[?&](#|$)", "$1")


def strip_tags(c: Column) -> Column:
    return collapse_space(F.regexp_replace(c, "<[^>]+>", " "))


def close_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+([,.;:!?])", "$1")


#: Values that sources print for "nothing" (fixed values).
NULL_VALUES = ["não informado", "não informada", "não informado(a)", "nao informado(a)", "não definida."]


def public_value(c: Column) -> Column:
    value = nonblank(c)
    return F.when(F.lower(value).isin(NULL_VALUES), F.lit(None)).otherwise(value)


def labelled_value(text: Column, label: str, labels: list[str]) -> Column:
    """What follows ``label :`` up to the next known label."""
    others = "|".join(x for x in labels if x != label)
    return nonblank(F.regexp_extract(text, rf"(?s)(?:^|\s){label}\s*:\s*(.*?)(?=(?:\s(?:{others})\s*:)|$)", 1))


def localized_total(text: Column, pattern: str) -> Column:
    """A number with thousands dots found by ``pattern``'s first group; null where absent."""
    return F.regexp_replace(F.regexp_extract(text, pattern, 1), r"\.", "").try_cast("long")


def collapse_doubled(c: Column) -> Column:
    """Text whose second half repeats its first keeps one half."""
    words = F.split(collapse_space(c), " ")
    half = (F.size(words) / 2).cast("int")
    twice = (F.size(words) % 2 == 0) & (F.slice(words, 1, F.greatest(half, F.lit(1))) == F.slice(words, half + 1, F.greatest(half, F.lit(1))))
    return F.when(twice & (half > 0), F.array_join(F.slice(words, 1, half), " ")).otherwise(collapse_space(c))


def highlight_text(highlights: Column) -> Column:
    """Map of fragment lists as a map of joined plain texts."""
    return F.transform_values(highlights, lambda _, v: strip_tags(F.array_join(v, " ")))


def unwrap_partial(markup: Column) -> Column:
    """CDATA blocks of a partial response that hold results; without any the markup itself."""
    blocks = F.regexp_extract_all(markup, F.lit(r"(?s)<!\[CDATA\[(.*?)\]\]>"), 1)
    wanted = F.filter(blocks, lambda b: b.contains("resultados"))
    return F.when(F.size(wanted) > 0, F.array_join(wanted, "\n")).otherwise(markup)


def synthetic_id(prefix: str, size: int, *parts: Column) -> Column:
    """Stable id from ordered identity fields; missing ones keep their place."""
    whole = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(whole, 256), 1, size))


def content_type(header: Column, body: Column) -> Column:
    """Declared type without parameters, else by the first bytes."""
    declared = nonblank(F.lower(F.split_part(header, F.lit(";"), F.lit(1))))
    head = F.lower(F.substring(body.cast("string"), 1, 4096))
    lead = F.ltrim(head)
    return F.coalesce(
        declared,
        F.when(lead.startswith("%pdf-"), "application/pdf").when(head.rlike("<html|<!doctype html"), "text/html").when(lead.startswith("{") | lead.startswith("["), "application/json").otherwise("text/plain"),
    )
