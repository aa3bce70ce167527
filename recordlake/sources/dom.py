"""HTML pages as a table of elements, and CSS or XPath selectors as windows and joins over it.

``dom`` parses each page once, without recursion, into its visible text and its elements in document order.
An element has its number ``pre``, the number ``last`` of its last descendant, its parent's number, and the byte
range of its text in the page's text, so that "inside", "text of" and "next to" are comparisons of numbers.
``elements`` has a row each; ``select``, ``xpath``, ``find_by_text`` and ``find_by_regex`` filter such rows.

Pages are read whole, however long or deep. A null page has no elements and no text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements, and 64 characters of markup, after which a batch of pages ends.
BATCH = 8192
HIDDEN = {"script", "style", "noscript", "template"}
#: A start tag that ends open elements: which, and at which open elements the search stops.
_BLOCKS = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "nav", "header", "footer", "main", "form", "fieldset", "blockquote", "pre", "figure", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd"}
ENDS: dict[str, tuple[set[str], set[str]]] = {
    **{t: ({"p"}, {"table", "td", "th", "caption", "button", "template", "html"}) for t in _BLOCKS},
    "li": ({"li", "p"}, {"ul", "ol", "menu", "table", "html"}), "dt": ({"dt", "dd", "p"}, {"dl", "table", "html"}), "dd": ({"dt", "dd", "p"}, {"dl", "table", "html"}),
    "td": ({"td", "th"}, {"table", "html"}), "th": ({"td", "th"}, {"table", "html"}), "tr": ({"tr", "td", "th"}, {"table", "html"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot"}, {"table", "html"}), "tfoot": ({"tr", "td", "th", "tbody", "thead"}, {"table", "html"}), "option": ({"option"}, {"select", "html"}),
}
NODE = pa.struct([
    ("pre", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())),
    ("nth", pa.int32()), ("of_kind", pa.int32()), ("child", pa.int32()), ("of_parent", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("own", pa.string()), ("selector", pa.string()),
])
NODE_DDL = "array<struct<pre: int, last: int, parent: int, depth: int, tag: string, id: string, classes: array<string>, attrs: map<string, string>, nth: int, of_kind: int, child: int, of_parent: int, start: int, stop: int, own: string, selector: string>>"


class Page(HTMLParser):
    """One page's elements as columns; ``stack`` holds the open ones, -1 stands for the page."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.parent, self.depth, self.last, self.start, self.stop, self.own = [], [], [], [], [], [], [], []
        self.nth, self.child, self.hidden = [], [], []
        self.stack: list[int] = []
        self.kinds: dict[int, dict[str, int]] = {-1: {}}
        self.strings: list[str] = []
        self.size = 0  # bytes of the text so far, with a space behind each string
        self.feed(markup)
        self.close()
        while self.stack:
            self._pop()

    def _pop(self) -> None:
        n = self.stack.pop()
        self.last[n] = len(self.tag) - 1
        self.stop[n] = max(self.start[n], self.size - 1)

    def handle_starttag(self, tag, attrs):
        ends, scope = ENDS.get(tag, ((), ()))
        if ends:
            for at in range(len(self.stack) - 1, -1, -1):
                open_tag = self.tag[self.stack[at]]
                if open_tag in scope:
                    break
                if open_tag in ends:
                    while len(self.stack) > at:
                        self._pop()
        n, up = len(self.tag), self.stack[-1] if self.stack else -1
        kinds = self.kinds[up]
        kinds[tag] = kinds.get(tag, 0) + 1
        kinds[""] = kinds.get("", 0) + 1
        self.tag.append(tag)
        self.attrs.append({k: v or "" for k, v in reversed(attrs)})  # of repeated attributes the first counts
        self.parent.append(up)
        self.depth.append(len(self.stack) + 1)
        self.last.append(n)
        self.start.append(self.size)
        self.stop.append(self.size)
        self.own.append([])
        self.nth.append(kinds[tag])
        self.child.append(kinds[""])
        self.hidden.append(tag in HIDDEN or (up >= 0 and self.hidden[up]))
        if tag not in VOID:
            self.stack.append(n)
            self.kinds[n] = {}

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._pop()

    def handle_endtag(self, tag):
        for at in range(len(self.stack) - 1, -1, -1):
            if self.tag[self.stack[at]] == tag:
                while len(self.stack) > at:
                    self._pop()
                return

    def handle_data(self, data):
        text = " ".join(data.split())
        at = self.stack[-1] if self.stack else -1
        if text and not (at >= 0 and self.hidden[at]):
            self.strings.append(text)
            self.size += len(text.encode("utf-8", "replace")) + 1
            if at >= 0:
                self.own[at].append(text)

    def text(self) -> bytes:
        return " ".join(self.strings).encode("utf-8", "replace")

    def selectors(self) -> list[str | None]:
        """CSS paths of the elements with text of their own: an id ends it, else up to three classes or the place among its kind."""
        wanted = [bool(o) for o in self.own]
        for n in range(len(wanted) - 1, -1, -1):  # their ancestors' are needed too
            if wanted[n] and self.parent[n] >= 0 and not self.attrs[n].get("id"):
                wanted[self.parent[n]] = True
        made: list[str | None] = [None] * len(wanted)
        for n, needed in enumerate(wanted):
            if not needed:
                continue
            own_id, tag = self.attrs[n].get("id"), self.tag[n]
            if own_id:
                made[n] = f"{tag}#{own_id}"
                continue
            classes = self.attrs[n].get("class", "").split()[:3]
            place = f":nth-of-type({self.nth[n]})" if not classes and self.kinds[self.parent[n]][tag] > 1 else ""
            made[n] = (made[self.parent[n]] + " > " if self.parent[n] >= 0 else "") + tag + "".join(f".{c}" for c in classes) + place
        return [m if o else None for m, o in zip(made, self.own, strict=True)]


def _columns(pages: list[Page]) -> list[pa.Array]:
    def flat(of: Callable[[Page], list], kind: pa.DataType) -> pa.Array:
        return pa.array([x for p in pages for x in of(p)], kind)

    def one(name: str) -> pa.Array:
        kind = NODE.field(name).type
        return {
            "pre": lambda: flat(lambda p: list(range(len(p.tag))), kind), "id": lambda: flat(lambda p: [a.get("id") or None for a in p.attrs], kind), "classes": lambda: flat(lambda p: [a.get("class", "").split() for a in p.attrs], kind),
            "attrs": lambda: flat(lambda p: [list(a.items()) for a in p.attrs], kind), "of_kind": lambda: flat(lambda p: [p.kinds[u][t] for u, t in zip(p.parent, p.tag, strict=True)], kind),
            "of_parent": lambda: flat(lambda p: [p.kinds[u][""] for u in p.parent], kind), "own": lambda: flat(lambda p: [" ".join(o) or None for o in p.own], kind), "selector": lambda: flat(Page.selectors, kind),
        }.get(name, lambda: flat(lambda p: getattr(p, name), kind))()

    return [one(f.name) for f in NODE]


def _batch(keys: list[pa.Array], pages: list[Page | None]) -> pa.RecordBatch:
    known = [p for p in pages if p is not None]
    ends = np.cumsum([0, *(0 if p is None else len(p.tag) for p in pages)])
    nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(_columns(known), fields=list(NODE)))
    return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array([None if p is None else p.text() for p in pages], pa.binary()), nodes], ["page", "text", "nodes"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, pages, held = [], [], 0
    for batch in batches:
        for row in range(batch.num_rows):
            markup = batch.column(1)[row].as_py()
            keys.append(batch.column(0).slice(row, 1))
            pages.append(None if markup is None else Page(markup))
            held += 1 if markup is None else len(markup) // 64 + len(pages[-1].tag)
            if held >= BATCH:
                yield _batch(keys, pages)
                keys, pages, held = [], [], 0
    if keys:
        yield _batch(keys, pages)


def dom(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """A row a page: ``page`` (its key), ``text`` (visible, UTF-8 bytes) and ``nodes``."""
    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, F.col(markup).cast("string")).mapInArrow(_parse, f"page {kind}, text binary, nodes {NODE_DDL}")


def text_of(text: Column, node: Column) -> Column:
    """The visible text of an element."""
    return F.decode(F.substring(text, node["start"] + 1, node["stop"] - node["start"]), "UTF-8")


def elements(pages: DataFrame) -> DataFrame:
    """A row an element of ``dom``'s pages."""
    return pages.select("page", F.inline("nodes"))


def with_text(pages: DataFrame, keep: Column | None = None) -> DataFrame:
    """A row an element with its visible ``text``; ``keep`` tells by a function of the element which are wanted."""
    nodes = F.col("nodes") if keep is None else F.filter("nodes", keep)
    texted = F.transform(nodes, lambda n: F.struct(*(n[f.name].alias(f.name) for f in NODE), text_of(F.col("text"), n).alias("text")))
    return pages.select("page", F.inline(texted))


def links(pages: DataFrame) -> DataFrame:
    """Per page the targets and texts of its anchors, in document order."""
    anchors = F.filter("nodes", lambda n: (n["tag"] == "a") & (F.coalesce(n["attrs"]["href"], F.lit("")) != ""))
    return pages.select("page", F.transform(anchors, lambda n: F.struct(n["attrs"]["href"].alias("url"), text_of(F.col("text"), n).alias("text"))).alias("links"))


# --- selectors

class InvalidSelectorError(ValueError):
    """The selector is empty or says what isn't understood."""


Test = Callable[[], Column]
_NAME = r"(?:[\w-]|[^\x00-\x7F])+"
_SIMPLE = re.compile(rf"\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|\[\s*(?P<attr>[\w:.-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*)?\]|:(?P<pseudo>[\w-]+)(?:\(\s*(?P<arg>[^()]*(?:\([^()]*\))?[^()]*)\))?")
_NTH = re.compile(r"(?:(?P<a>[+-]?\d*)n\s*(?P<b>[+-]\s*\d+)?|(?P<only>[+-]?\d+)|(?P<word>odd|even))$")


def _nth(place: Column, arg: str) -> Column:
    """Whether a place (from 1) is one of ``an+b``, a number, odd or even."""
    m = _NTH.match(arg.strip().lower())
    if m is None:
        raise InvalidSelectorError(f"a place that isn't understood: {arg!r}")
    if m["only"]:
        return place == int(m["only"])
    if m["word"]:
        a, b = 2, 1 if m["word"] == "odd" else 0
    else:
        a = int(m["a"] + "1") if m["a"] in ("", "+", "-") else int(m["a"])
        b = int(re.sub(r"\s", "", m["b"] or "0"))
    if a == 0:
        return place == b
    return (F.pmod(place - b, F.lit(abs(a))) == 0) & ((place >= b) if a > 0 else (place <= b))


def _attribute(name: str, op: str | None, value: str | None) -> Column:
    v = F.element_at(F.col("attrs"), F.lit(name.lower()))
    has = F.col("attrs").isNotNull() & v.isNotNull()
    if op is None:
        return has
    value = value[1:-1] if value[:1] in "\"'" else value
    if op == "=":
        return has & (v == value)
    if not value and op != "|=":
        return F.lit(False)
    return has & {
        "~=": F.array_contains(F.split(v, r"\s+"), value), "|=": (v == value) | v.startswith(value + "-"), "^=": v.startswith(value), "$=": v.endswith(value), "*=": v.contains(value),
    }[op]


def compound(text: str) -> Column:
    """The test of an element by a compound selector such as ``a.x[href]:nth-of-type(2)``."""
    m = re.match(rf"\*|{_NAME}", text)
    tests = [F.col("tag") == m[0].lower()] if m and m[0] != "*" else [F.lit(True)]
    at = m.end() if m else 0
    if not text or (m is None and not _SIMPLE.match(text)):
        raise InvalidSelectorError(f"a selector that isn't understood: {text!r}")
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if m is None:
            raise InvalidSelectorError(f"a selector that isn't understood: {text!r}")
        at = m.end()
        if m["id"]:
            tests.append(F.coalesce(F.col("id") == m["id"], F.lit(False)))
        elif m["cls"]:
            tests.append(F.array_contains("classes", m["cls"]))
        elif m["attr"]:
            tests.append(F.coalesce(_attribute(m["attr"], m["op"], m["val"]), F.lit(False)))
        else:
            tests.append(_pseudo(m["pseudo"].lower(), m["arg"]))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _pseudo(name: str, arg: str | None) -> Column:
    nth, of_kind, child, of_parent = (F.col(c) for c in ("nth", "of_kind", "child", "of_parent"))
    fixed = {"first-child": child == 1, "last-child": child == of_parent, "only-child": of_parent == 1, "first-of-type": nth == 1, "last-of-type": nth == of_kind, "only-of-type": of_kind == 1, "empty": (F.col("last") == F.col("pre")) & (F.col("start") == F.col("stop"))}
    if arg is None and name in fixed:
        return fixed[name]
    places = {"nth-child": child, "nth-of-type": nth, "nth-last-child": of_parent - child + 1, "nth-last-of-type": of_kind - nth + 1}
    if arg is not None and name in places:
        return _nth(places[name], arg)
    if arg and name == "not":
        return ~compound(arg.strip())
    raise InvalidSelectorError(f"a selector that isn't understood: :{name}")


def _split(selector: str) -> list[list[tuple[str, str]]]:
    """Of each selector of a list its (combinator, compound) steps; the first combinator is empty."""
    out: list[list[tuple[str, str]]] = []
    steps: list[tuple[str, str]] = []
    held, combinator, depth, quote = "", "", 0, ""

    def end() -> None:
        nonlocal held, combinator
        if held:
            steps.append((combinator, held))
            held, combinator = "", " "

    for c in selector.strip():
        if quote:
            held, quote = held + c, "" if c == quote else quote
        elif c in "\"'" and depth:
            held, quote = held + c, c
        elif c in "([" or c in ")]":
            held, depth = held + c, depth + (1 if c in "([" else -1)
        elif depth:
            held += c
        elif c == ",":
            end()
            out.append(steps)
            steps, combinator = [], ""
        elif c in ">+~" or c.isspace():
            end()
            if not c.isspace():
                if not steps or combinator in (">", "+", "~"):
                    raise InvalidSelectorError(selector)
                combinator = c
        else:
            held += c
    end()
    out.append(steps)
    if depth or quote or combinator in (">", "+", "~") or any(not s for s in out):
        raise InvalidSelectorError(selector)
    return out


def nested(outer: str, inner: str) -> str:
    """The selector of what ``inner`` matches inside of what ``outer`` matches; both may be lists."""
    written = lambda steps: "".join(f" {c} {t}" if c.strip() else f" {t}" for c, t in steps)
    return ", ".join((written(o) + written(i)).strip() for o in _split(outer) for i in _split(inner))


def _mark(nodes: DataFrame, steps: list[tuple[str, Column]], name: str) -> DataFrame:
    """Adds whether an element ends a chain of steps; elements that fit no step may be missing."""
    for i, (combinator, test) in enumerate(steps):
        if i == 0:
            nodes = nodes.withColumn(name, test)
            continue
        seen, earlier = F.col(name), Window.partitionBy("page").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
        if combinator == ">":
            # an element that was seen also stands in for itself among its children
            held = nodes.withColumn("__above", F.explode(F.when(seen, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
            held = held.withColumn("__of", F.when(F.col("__above"), F.col("pre")).otherwise(F.col("parent")))
            held = held.withColumn(name, F.max("__above").over(Window.partitionBy("page", "__of")) & test)
            nodes = held.filter(~F.col("__above")).drop("__above", "__of")
            continue
        if combinator == " ":
            # inside an element that began before and ends here or later
            found = F.max(F.when(seen, F.col("last"))).over(earlier) >= F.col("pre")
        elif combinator == "~":
            found = F.max(seen).over(Window.partitionBy("page", "parent").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1))
        else:
            beside = Window.partitionBy("page", "parent").orderBy("pre")
            found = F.lag(seen).over(beside) & (F.lag("child").over(beside) == F.col("child") - 1)
        nodes = nodes.withColumn(name, F.coalesce(found, F.lit(False)) & test)
    return nodes


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """The elements that a CSS selector list matches: types, ids, classes, attributes, places, ``:not``; all four combinators."""
    return matched(nodes, chains(selector))


def chains(selector: str) -> list[list[tuple[str, Column]]]:
    """A selector list as chains of (combinator, test of an element)."""
    return [[(c, compound(t)) for c, t in steps] for steps in _split(selector)]


def marked(nodes: DataFrame, chains: list[list[tuple[str, Column]]]) -> DataFrame:
    """The elements that fit a step of any chain, with a column ``__0``, ``__1``... a chain: whether they end it.

    Steps are tested where the elements are read; only what fits one meets the others of its page, in one shuffle.
    """
    tests = {f"__{i}_{j}": F.coalesce(test, F.lit(False)) for i, steps in enumerate(chains) for j, (_, test) in enumerate(steps)}
    nodes = nodes.withColumns(tests).filter(F.greatest(F.lit(False), *map(F.col, tests)))
    if any(len(steps) > 1 for steps in chains):
        # by number: the windows cost far more than the few bytes of an element tell
        nodes = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page")
    for i, steps in enumerate(chains):
        nodes = _mark(nodes, [(c, F.col(f"__{i}_{j}")) for j, (c, _) in enumerate(steps)], f"__{i}")
    return nodes.drop(*tests)


def matched(nodes: DataFrame, chains: list[list[tuple[str, Column]]]) -> DataFrame:
    names = [f"__{i}" for i in range(len(chains))]
    return marked(nodes, chains).filter(F.greatest(F.lit(False), *map(F.col, names))).drop(*names)


_STEP = re.compile(rf"(?P<axis>//?)(?P<test>\*|{_NAME})(?P<rest>(?:\[[^\]]*\])*)")
_PREDICATE = re.compile(r"\[\s*(?:(?P<n>\d+)|(?P<end>last\(\))|@(?P<attr>[\w:.-]+)\s*(?:=\s*(?P<val>\"[^\"]*\"|'[^']*'))?|contains\(\s*@(?P<in>[\w:.-]+)\s*,\s*(?P<part>\"[^\"]*\"|'[^']*')\s*\)|starts-with\(\s*@(?P<of>[\w:.-]+)\s*,\s*(?P<head>\"[^\"]*\"|'[^']*')\s*\))\s*\]")


def xpath(nodes: DataFrame, expression: str) -> DataFrame:
    """The elements of an absolute location path of ``/`` and ``//`` steps with attribute tests, contains, starts-with and places."""
    steps, at = [], 0
    while at < len(expression):
        m = _STEP.match(expression, at)
        if m is None:
            raise InvalidSelectorError(expression)
        test = F.lit(True) if m["test"] == "*" else F.col("tag") == m["test"].lower()
        done = 0
        place, of = (F.col("child"), F.col("of_parent")) if m["test"] == "*" else (F.col("nth"), F.col("of_kind"))
        for p in _PREDICATE.finditer(m["rest"]):
            done += p.end() - p.start()
            if p["n"] or p["end"]:
                if p.start():
                    raise InvalidSelectorError(f"{expression}: a place behind another test")
                one = place == (int(p["n"]) if p["n"] else of)
            elif p["attr"]:
                one = _attribute(p["attr"], "=" if p["val"] else None, p["val"])
            else:
                one = _attribute(p["in"] or p["of"], "*=" if p["in"] else "^=", p["part"] or p["head"])
            test = test & F.coalesce(one, F.lit(False))
        if done < len(m["rest"]):
            raise InvalidSelectorError(expression)
        if not steps and m["axis"] == "/":
            test = test & (F.col("depth") == 1)
        steps.append((" " if m["axis"] == "//" else ">", test))
        at = m.end()
    if not steps:
        raise InvalidSelectorError(expression)
    return matched(nodes, [steps])


def find_by_text(pages: DataFrame, text: str, exact: bool = False, case_sensitive: bool = False, limit: int | None = None) -> DataFrame:
    """Elements whose visible text holds (or is) a label, by page and ``place``: shortest text first, then the deepest, those with an id, document order."""
    needle = " ".join(text.split())
    if not needle:
        return with_text(pages).withColumn("place", F.lit(1)).limit(0)
    fold = (lambda c: c) if case_sensitive else F.lower
    wanted = fold(F.lit(needle))
    found = with_text(pages, lambda n: (fold(text_of(F.col("text"), n)) == wanted) if exact else fold(text_of(F.col("text"), n)).contains(wanted))
    order = Window.partitionBy("page").orderBy(F.length("text"), F.desc("depth"), F.col("id").isNull(), "pre")
    found = found.withColumn("place", F.row_number().over(order))
    return found if limit is None else found.filter(F.col("place") <= limit)


def find_by_regex(pages: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """Elements whose visible text a regular expression occurs in, in document order."""
    found = with_text(pages, lambda n: text_of(F.col("text"), n).rlike(pattern))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("pre")))
    return found if limit is None else found.filter(F.col("place") <= limit)
