"""Single facts of HTML pages as columns, in Arrow UDFs; each page is parsed once, in one pass (see ``dom``)."""

from __future__ import annotations

from collections.abc import Callable
from html import unescape

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlake.sources.dom import Page


def _each(one: Callable[[Page], object]) -> Callable[[pd.Series], pd.Series]:
    return lambda markup: markup.map(lambda m: None if m is None else one(Page(m)))


def _texts(page: Page) -> Callable[[int], str]:
    whole = page.text()
    return lambda n: whole[page.start[n] : page.stop[n]].decode()


@F.pandas_udf(T.StringType())
def visible_text(markup: pd.Series) -> pd.Series:
    """Text outside scripts, styles and templates, white space collapsed; null for pages without."""
    return _each(lambda p: p.text().decode() or None)(markup)


def _title(page: Page) -> str | None:
    return next((" ".join(page.own[n]) for n, tag in enumerate(page.tag) if tag == "title" and page.own[n]), None)


@F.pandas_udf(T.StringType())
def title(markup: pd.Series) -> pd.Series:
    return _each(_title)(markup)


LINK = T.StructType([T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])


def _links(page: Page) -> list[dict]:
    text = _texts(page)
    return [{"url": a["href"], "text": text(n)} for n, (tag, a) in enumerate(zip(page.tag, page.attrs, strict=True)) if tag == "a" and a.get("href")]


@F.pandas_udf(T.ArrayType(LINK))
def links(markup: pd.Series) -> pd.Series:
    """Targets and texts of the anchors, in document order."""
    return _each(_links)(markup)


FIELD = T.StructType([T.StructField(n, T.StringType()) for n in ("form", "method", "name", "kind", "value")])


def _form_fields(page: Page) -> list[dict]:
    out, form_of = [], []
    for n, (tag, a, up) in enumerate(zip(page.tag, page.attrs, page.parent, strict=True)):
        form = form_of[up] if up >= 0 else None
        form_of.append(n if tag == "form" else form)
        if form is not None and tag in ("input", "select", "textarea", "button") and a.get("name"):
            at = page.attrs[form]
            out.append({"form": at.get("action", ""), "method": at.get("method", "get").lower(), "name": a["name"], "kind": a.get("type", tag), "value": a.get("value", "")})
    return out


@F.pandas_udf(T.ArrayType(FIELD))
def form_fields(markup: pd.Series) -> pd.Series:
    """Named fields of each form with its action and method."""
    return _each(_form_fields)(markup)


SIGNATURE = T.StructType([
    T.StructField("selector", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("id", T.StringType()), T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("attrs", T.ArrayType(T.StringType())), T.StructField("parent", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("length", T.IntegerType()),
])


def _signatures(page: Page) -> list[dict]:
    made = page.selectors()
    return [
        {"selector": made[n], "tag": page.tag[n], "id": a.get("id"), "classes": a.get("class", "").split(), "attrs": sorted(a), "parent": page.tag[page.parent[n]] if page.parent[n] >= 0 else "", "depth": page.depth[n], "text": (t := " ".join(page.own[n])), "length": len(t)}
        for n, a in enumerate(page.attrs) if page.own[n]
    ]


@F.pandas_udf(T.ArrayType(SIGNATURE))
def signatures(markup: pd.Series) -> pd.Series:
    """Signature and selector of every element with text of its own."""
    return _each(_signatures)(markup)


def _label_pairs(page: Page) -> dict[str, str]:
    text, out = _texts(page), {}
    below: dict[int, list[int]] = {}
    for n, up in enumerate(page.parent):
        below.setdefault(up, []).append(n)
    for n, tag in enumerate(page.tag):
        pair = below.get(n, []) if tag == "tr" else below[page.parent[n]][page.child[n] - 1 : page.child[n] + 1] if tag == "dt" else []
        kinds = [page.tag[x] for x in pair]
        if len(pair) == 2 and (kinds == ["dt", "dd"] if tag == "dt" else set(kinds) <= {"td", "th"}):
            out[text(pair[0]).lower().rstrip(": ")] = text(pair[1])
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def label_pairs(markup: pd.Series) -> pd.Series:
    """Values by lower-cased label of definition lists and two-cell table rows; the last value of a label wins."""
    return _each(_label_pairs)(markup)


def labelled(text: str, labels: list[str]) -> dict[str, str]:
    """Values behind ``label:`` in a text, each up to the next label."""
    low = text.lower()
    places = sorted((low.find(label.lower() + ":"), label) for label in labels if label.lower() + ":" in low)
    return {label.lower(): text[at + len(label) + 1 : following[0]].strip() for (at, label), following in zip(places, [*places[1:], (len(text), "")], strict=True)}


def cards(tag: str, css_class: str, labels: list[str]):
    """UDF: per element of a tag and class its text under ``text``, its first link, and the values of the labels in it."""

    def all_cards(page: Page) -> list[dict]:
        text = _texts(page)
        anchors = [n for n, t in enumerate(page.tag) if t == "a" and page.attrs[n].get("href")]
        out, at = [], 0
        for n, t in enumerate(page.tag):
            if t == tag and css_class in page.attrs[n].get("class", "").split():
                while at < len(anchors) and anchors[at] < n:
                    at += 1
                found = {"text": text(n)}
                if at < len(anchors) and anchors[at] <= page.last[n]:
                    found["url"] = page.attrs[anchors[at]]["href"]
                out.append(found | labelled(found["text"], labels))
        return out

    @F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    def run(markup: pd.Series) -> pd.Series:
        return _each(all_cards)(markup)

    return run


@F.pandas_udf(T.StringType())
def unescape_strip(markup: pd.Series) -> pd.Series:
    """Entities resolved, then tags dropped."""
    return markup.map(lambda m: None if m is None else Page(unescape(m)).text().decode() or None)
