"""Routes that captured answers point to: links, resources, forms, script calls, JSON strings and endpoint-like text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions.fields import endpoint_like, json_strings
from recordlake.functions.text import absolute_url
from recordlake.sources import dom

# What a route was seen as, why, and how far that is to be trusted; in order of precedence.
KINDS = [
    ("link", "HTML link", 0.55), ("asset", "HTML resource link", 0.35), ("script", "script source", 0.40), ("form", "HTML form action", 0.70),
    ("script", "script API call", 0.65), ("json", "JSON string endpoint", 0.60), ("text", "endpoint-like text", 0.35),
]
CALL = r"(?i)(?:fetch|axios\.(?:get|post|put|delete)|url)\s*\(\s*['\"]([^'\"]+)"
PLAIN_URL = r"(?U)(?<![\w])(?:https?://|/)[A-Za-z0-9_./?=&%:#-]{2,}"
TEXT_MARKS = ("/api", "search", "juris")
#: Parts of names that search filters have.
FILTER_MARKS = ("filter", "filtro", "query", "search", "page", "sort", "tipo", "classe", "orgao", "relator", "data")


def _seen(values: Column, kind: int, method: Column | None = None) -> Column:
    source, reason, confidence = KINDS[kind]
    one = lambda v: F.struct(v.alias("value"), (F.lit("GET") if method is None else method).alias("method"), F.lit(source).alias("source"), F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"))
    return F.transform(values, one)


def _attributes(tag: str, name: str) -> Column:
    return F.transform(F.filter("nodes", lambda n: (n["tag"] == tag) & F.map_contains_key(n["attrs"], name)), lambda n: n["attrs"][name])


def route_candidates(answers: DataFrame, key: str, url: str, body: str, content_type: str) -> DataFrame:
    """(key, place, method, url, source, reason, confidence): each route of an answer once, as what it was first seen.

    Relative addresses are joined with the answer's url; others than http and https are left out. Links come first,
    then resources, scripts, forms, calls in scripts, JSON strings and plain text.
    """
    text, kind = F.coalesce(F.col("body"), F.lit("")), F.lower(F.coalesce("content_type", F.lit("")))
    rows = answers.select(F.col(key).alias("page"), F.col(url).alias("base"), F.col(body).cast("string").alias("body"), F.col(content_type).alias("content_type"))
    parsed = dom.dom(rows, "page", "body").select(F.col("page").alias("d_page"), "nodes")
    joined = rows.join(parsed, F.col("page").eqNullSafe(F.col("d_page")))
    html = kind.contains("html") | F.lower(text).contains("<html") | F.lower(text).contains("<a ")
    json = kind.contains("json") | F.ltrim(text).startswith("{") | F.ltrim(text).startswith("[")
    none = F.array().cast("array<struct<value: string, method: string, source: string, reason: string, confidence: double>>")
    forms = F.transform(
        F.filter("nodes", lambda n: n["tag"] == "form"),
        lambda n: F.struct(F.coalesce(F.nullif(n["attrs"]["action"], F.lit("")), F.col("base")).alias("value"), F.upper(F.coalesce(F.nullif(n["attrs"]["method"], F.lit("")), F.lit("GET"))).alias("method"), *(F.lit(v).alias(k) for k, v in zip(("source", "reason", "confidence"), KINDS[3], strict=True))),
    )
    calls = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"(?is)<script\b[^>]*>(.*?)</script>"), F.lit(1)), lambda s: F.regexp_extract_all(s, F.lit(CALL), F.lit(1))))
    strings = F.filter(F.coalesce(json_strings(text), F.array().cast("array<string>")), endpoint_like)
    plain = F.filter(F.regexp_extract_all(text, F.lit(PLAIN_URL), F.lit(0)), lambda v: reduce(lambda a, b: a | b, (F.lower(v).contains(m) for m in TEXT_MARKS)))
    tagged = [_seen(_attributes("a", "href"), 0), _seen(_attributes("link", "href"), 1), _seen(_attributes("script", "src"), 2), forms, _seen(calls, 4)]
    found = F.concat(F.when(html, F.concat(*tagged)).otherwise(none), F.when(json & F.try_parse_json(text).isNotNull(), _seen(strings, 5)).otherwise(none), _seen(plain, 6))
    rows = joined.select("page", "base", F.posexplode(found).alias("place", "c")).select("page", "base", "place", F.trim("c.value").alias("value"), "c.method", "c.source", "c.reason", "c.confidence")
    rows = rows.filter(~F.col("value").rlike(r"^(?:$|#|javascript:|mailto:|tel:)")).withColumn("url", absolute_url(F.col("value"), F.col("base")))
    rows = rows.filter(F.col("url").rlike(r"^(?i)https?://(?:[^/?#:@\[]|\[[0-9a-f:.]+\])"))
    first = rows.groupBy("page", "method", "url").agg(F.min(F.struct("place", "source", "reason", "confidence")).alias("c"))
    return first.select(F.col("page").alias(key), "c.place", "method", "url", "c.source", "c.reason", "c.confidence")


def filter_keys(answers: DataFrame, key: str, body: str) -> DataFrame:
    """(key, name, field_type, source, confidence): top-level keys of JSON objects that are named like search filters."""
    parsed = answers.select(F.col(key), F.col(body).cast("string").alias("body")).filter(F.ltrim("body").startswith("{"))
    pairs = parsed.select(key, "body", F.explode(F.json_object_keys("body")).alias("name"))
    value = F.element_at(F.from_json("body", "map<string, variant>"), F.col("name"))
    kinds = F.schema_of_variant(value)
    typed = F.when(kinds.startswith("ARRAY"), "json_array").when(kinds == "STRING", "str").when(kinds == "BIGINT", "int").when(kinds == "BOOLEAN", "bool").when(kinds.startswith("OBJECT"), "dict").when(kinds == "VOID", "NoneType").otherwise("float")
    named = reduce(lambda a, b: a | b, (F.lower("name").contains(m) for m in FILTER_MARKS))
    return pairs.filter(named).select(key, "name", typed.alias("field_type"), F.lit("json_key").alias("source"), F.lit(0.55).alias("confidence"))
