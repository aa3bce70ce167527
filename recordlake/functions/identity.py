"""Keys, identities, fingerprints and relevance."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlake.functions.text import collapse_space


def canonical_key(*parts: Column) -> Column:
    """Parts trimmed, lower-cased, space-collapsed and joined by ``|``; empty ones are left out."""
    return F.concat_ws("|", *(F.nullif(F.lower(collapse_space(p.cast("string"))), F.lit("")) for p in parts))


def record_identity(case_number: Column, number: Column, precedent_type: Column, court: Column, source: Column, id_: Column) -> Column:
    """``case:`` of a number that is not empty; a precedent (``precedent_type`` is set) without one goes by court, type and id, others by source and id."""
    chosen = F.coalesce(F.nullif(case_number, F.lit("")), F.nullif(number, F.lit("")))
    return F.coalesce(
        F.concat(F.lit("case:"), F.regexp_replace(F.lower(chosen), "[^0-9a-z]", "")),
        F.when(precedent_type.isNotNull(), F.concat_ws(":", F.lit("precedent"), court, precedent_type, id_)),
        F.concat_ws(":", F.lit("source"), source, id_),
    )


def collection_identity(source: Column, id_: Column, number: Column, kind: Column) -> Column:
    return F.when(F.coalesce(id_, F.lit("")) != "", F.concat_ws(":", source, id_)).otherwise(F.concat_ws(":", source, F.coalesce(number, F.lit("")), F.coalesce(kind, F.lit(""))))


def query_tokens(text: str) -> list[str]:
    """Words of a query of more than two characters; repeats count again."""
    return [t for t in re.findall(r"\w+", text.lower()) if len(t) > 2]


def relevance(text: str, *columns: Column) -> Column:
    """How often the query's words occur, as substrings, in the joined columns."""
    hay = F.lower(F.concat_ws(" ", *columns))
    counts = [((F.length(hay) - F.length(F.replace(hay, F.lit(t), F.lit("")))) / len(t)).cast("long") for t in query_tokens(text)]
    return reduce(lambda a, b: a + b, counts, F.lit(0).cast("long"))


def fingerprint(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def json_fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 of a flat object written with sorted keys and the separators ``", "`` and ``": "``."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    body = F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": '), F.coalesce(quote(fields[k].cast("string")), F.lit("null"))) for k in sorted(fields)))
    return F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256)


def dataset_row_id(dataset: Column, id_: Column, prefix: str = "dataset-") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", dataset, id_), 256), 1, 24))
