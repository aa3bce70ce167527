"""Search queries: validated on the driver, compiled to Column predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlake.functions.text import CNJ_PATTERN, accent_fold, fold_value

#: Filters that identify a case or party (fixed values).
IDENTIFIER_FILTERS = ("number", "party_name", "party_document", "lawyer_name", "oab", "precatory_number", "police_document", "cda")
#: Order names to sort keys (fixed values).
ORDER_KEYS = {"Text": "score", "relevance": "score", "relevancia": "score", "date": "judgment_date", "data": "judgment_date", "publication": "publication_date", "publicacao": "publication_date"}


class InvalidQueryError(ValueError):
    """A query that can't be run as it stands."""


def is_active(value: object) -> bool:
    """Whether a filter is set: null, blank, empty and false are not."""
    return bool(value.strip()) if isinstance(value, str) else bool(value)


def _check_date(value: str) -> str:
    for pattern, order in ((r"(\d{4})-(\d{2})-(\d{2})", (1, 2, 3)), (r"(\d{2})/(\d{2})/(\d{4})", (3, 2, 1))):
        m = re.fullmatch(pattern, value)
        if m:
            return "-".join(m[i] for i in order)
    raise InvalidQueryError(f"a date is YYYY-MM-DD or DD/MM/YYYY, not {value!r}")


@dataclass(frozen=True)
class SearchQuery:
    text: str = ""
    all_words: str = ""
    any_words: str = ""
    without_words: str = ""
    exact_phrase: str = ""
    number: str = ""
    rapporteur: str = ""
    party_name: str = ""
    party_document: str = ""
    lawyer_name: str = ""
    oab: str = ""
    precatory_number: str = ""
    police_document: str = ""
    cda: str = ""
    published_from: str = ""
    published_to: str = ""
    updated_from: str = ""
    updated_to: str = ""
    include_cancelled: bool = False
    order_by: str = "Text"
    courts: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    page: int = 1
    page_size: int = 10
    _dates: dict = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def of(cls, **filters: object) -> SearchQuery:
        """From keywords; unknown ones are refused."""
        unknown = set(filters) - {f.name for f in fields(cls) if not f.name.startswith("_")}
        if unknown:
            raise InvalidQueryError(f"unknown filters: {', '.join(sorted(unknown))}")
        return cls(**filters)

    def __post_init__(self) -> None:
        if self.page < 1 or not 1 <= self.page_size <= 100:
            raise InvalidQueryError("page is at least 1 and page_size from 1 to 100")
        for name in ("published", "updated"):
            dates = {end: _check_date(v) for end in ("from", "to") if (v := getattr(self, f"{name}_{end}"))}
            if len(dates) == 2 and dates["from"] > dates["to"]:
                raise InvalidQueryError(f"{name}_from is after {name}_to")
            self._dates[name] = dates
        if self.order_by not in ORDER_KEYS:
            raise InvalidQueryError(f"unknown order: {self.order_by}")

    def active_filters(self) -> list[str]:
        """Names of the filters that are set; a case number in the text counts as ``number``."""
        names = [f.name for f in fields(self) if f.name not in ("page", "page_size", "order_by") and not f.name.startswith("_") and is_active(getattr(self, f.name))]
        return names + ["number"] * ("number" not in names and re.search(CNJ_PATTERN, self.text) is not None)

    def identifiers(self) -> list[str]:
        return [f for f in self.active_filters() if f in IDENTIFIER_FILTERS]

    def refinements(self) -> list[str]:
        """The other filters, which a source that doesn't know them leaves to local filtering."""
        return [f for f in self.active_filters() if f not in IDENTIFIER_FILTERS]

    def active_values(self) -> dict[str, object]:
        return {f: getattr(self, f) for f in self.active_filters() if is_active(getattr(self, f))}

    def precedent_filter(self) -> dict[str, object]:
        """The filter of the general precedent search, by its own names (fixed values)."""
        return {
            "buscaGeral": self.text, "todasPalavras": self.all_words, "quaisquerPalavras": self.any_words, "semPalavras": self.without_words, "trechoExato": self.exact_phrase, "atualizacaoDesde": self.updated_from, "atualizacaoAte": self.updated_to,
            "cancelados": self.include_cancelled, "ordenacao": self.order_by, "nr": self.number, "pagina": self.page, "tamanhoPagina": self.page_size, "orgaos": list(self.courts), "tipos": list(self.types),
        }

    def expression(self) -> str:
        """The query as a boolean search expression."""
        parts = [self.text] * bool(self.text) + [f'"{self.exact_phrase}"'] * bool(self.exact_phrase)
        parts += [" e ".join(self.all_words.split())] * bool(self.all_words) + [" ou ".join(self.any_words.split())] * bool(self.any_words)
        return " ".join(parts + [f"não {w}" for w in self.without_words.split()])

    def word_predicate(self, haystack: Column, folded: bool = False) -> Column:
        """All words, any word, none of the excluded and the exact phrase, as substrings without case (or accents)."""
        hay = accent_fold(haystack) if folded else F.lower(haystack)
        form = fold_value if folded else str.lower
        has = lambda word: F.coalesce(hay.contains(form(word)), F.lit(False))
        tests = [has(w) for w in self.text.split() + self.all_words.split()] + [has(self.exact_phrase)] * bool(self.exact_phrase)
        if self.any_words.split():
            tests.append(reduce(lambda a, b: a | b, map(has, self.any_words.split())))
        tests += [~has(w) for w in self.without_words.split()]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def date_predicate(self, published: Column, updated: Column) -> Column:
        """Publication filters on the publication date, update filters on the source's update date."""
        tests = []
        for column, name in ((published, "published"), (updated, "updated")):
            dates = self._dates[name]
            tests += [column >= d if end == "from" else column <= d for end, d in dates.items()]
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def boosted_score(self, **weights: tuple[Column, float]) -> Column:
        """Weighted count of query words by field."""
        words = [w.lower() for w in (self.text + " " + self.all_words).split()]
        hits = [F.when(F.lower(column).contains(w), weight).otherwise(0.0) for column, weight in weights.values() for w in words]
        return reduce(lambda a, b: a + b, hits, F.lit(0.0))
