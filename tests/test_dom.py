"""Elements and selectors against a second evaluator, and hard pages."""

import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from recordlake.sources import dom, html


def random_page(seed):
    """Well-formed nested markup, so that a plain stack reads it."""
    rng = random.Random(seed)

    def node(depth):
        tag = rng.choice(["div", "span", "section", "b", "em"])
        attrs = "".join(f' {k}="{rng.choice(v)}"' for k, v in (("class", ["x", "y", "x y", "z-1"]), ("id", ["i1", "i2"]), ("data-k", ["ab", "ab-c", "b ab"]), ("lang", ["pt", "pt-BR"])) if rng.random() < 0.35)
        inner = "".join(node(depth + 1) if rng.random() < 0.6 else rng.choice(["t ", "ab c ", "é"]) for _ in range(rng.randint(0, 4 if depth < 5 else 0)))
        return f"<{tag}{attrs}>{inner}</{tag}>"

    return "<html><body>" + "".join(node(0) for _ in range(4)) + "</body></html>"


class Plain(HTMLParser):
    """A tree of dicts with links to parents: read by recursion, one element at a time."""

    def __init__(self, text):
        super().__init__()
        self.all, self.at = [], None
        self.feed(text)

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "attrs": dict(attrs), "up": self.at, "below": [], "n": len(self.all)}
        self.all.append(node)
        if self.at is not None:
            self.at["below"].append(node)
        self.at = node

    def handle_endtag(self, tag):
        self.at = self.at["up"]


def siblings(n):
    return n["up"]["below"] if n["up"] is not None else [n]


def same(n):
    return [s for s in siblings(n) if s["tag"] == n["tag"]]


SIMPLE = {
    "div": lambda n: n["tag"] == "div", "span": lambda n: n["tag"] == "span", "*": lambda n: True, ".x": lambda n: "x" in n["attrs"].get("class", "").split(), "div.x.y": lambda n: n["tag"] == "div" and {"x", "y"} <= set(n["attrs"].get("class", "").split()),
    "#i1": lambda n: n["attrs"].get("id") == "i1", "[data-k]": lambda n: "data-k" in n["attrs"], "[data-k='ab']": lambda n: n["attrs"].get("data-k") == "ab", '[data-k~="ab"]': lambda n: "ab" in n["attrs"].get("data-k", "").split(),
    "[lang|=pt]": lambda n: n["attrs"].get("lang", "") in ("pt", "pt-BR"), "[data-k^=ab]": lambda n: n["attrs"].get("data-k", "").startswith("ab"), "[data-k$=c]": lambda n: n["attrs"].get("data-k", "").endswith("c"), "b[data-k*='b-']": lambda n: n["tag"] == "b" and "b-" in n["attrs"].get("data-k", ""),
    ":nth-of-type(2)": lambda n: [s is n for s in same(n)].index(True) == 1, "span:nth-of-type(2n+1)": lambda n: n["tag"] == "span" and [s is n for s in same(n)].index(True) % 2 == 0, ":nth-child(-n+2)": lambda n: [s is n for s in siblings(n)].index(True) < 2,
    ":last-child": lambda n: siblings(n)[-1] is n, ":first-of-type": lambda n: same(n)[0] is n, ":only-of-type": lambda n: len(same(n)) == 1, ":nth-last-of-type(even)": lambda n: (len(same(n)) - [s is n for s in same(n)].index(True)) % 2 == 0,
    "div:not(.x)": lambda n: n["tag"] == "div" and "x" not in n["attrs"].get("class", "").split(), "*:not([id])": lambda n: "id" not in n["attrs"],
}


def before(n, combinator):
    """Elements from which a combinator leads to an element."""
    if combinator == ">":
        return [n["up"]] if n["up"] is not None else []
    if combinator in "+~":
        row = siblings(n)
        at = [s is n for s in row].index(True)
        return row[:at] if combinator == "~" else row[max(0, at - 1) : at]
    out = []
    while n["up"] is not None:
        n = n["up"]
        out.append(n)
    return out


def holds(n, steps):
    *first, (combinator, simple) = steps
    return SIMPLE[simple](n) and (not first or any(holds(p, first) for p in before(n, combinator)))


def test_selectors_against_a_second_evaluator(spark):
    rng = random.Random(3)
    texts = [random_page(i) for i in range(25)]
    trees = [Plain(t) for t in texts]
    pages = dom.dom(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, html string").repartition(3), "id", "html")
    nodes = dom.elements(pages).cache()
    assert nodes.count() == sum(len(t.all) for t in trees)
    chains = [[("", s)] for s in SIMPLE]
    chains += [[("", rng.choice(list(SIMPLE))), *((rng.choice(" >+~ "), rng.choice(list(SIMPLE))) for _ in range(rng.randint(1, 3)))] for _ in range(40)]
    for at in range(0, len(chains), 2):
        pair = chains[at : at + 2]
        selector = ", ".join("".join(c + s if c in ("", " ") else f" {c} {s}" for c, s in steps) for steps in pair)
        got = {(r["page"], r["pre"]) for r in dom.select(nodes, selector).select("page", "pre").collect()}
        want = {(i, n["n"]) for i, t in enumerate(trees) for n in t.all if any(holds(n, steps) for steps in pair)}
        assert got == want, selector
    nodes.unpersist()


def test_own_selectors_find_their_element(spark):
    pages = dom.dom(spark.createDataFrame([(i, random_page(100 + i)) for i in range(4)], "id long, html string"), "id", "html")
    nodes = dom.elements(pages).cache()
    for r in nodes.filter("selector is not null").orderBy("page", "pre").collect()[::9]:
        assert (r["page"], r["pre"]) in {(m["page"], m["pre"]) for m in dom.select(nodes, r["selector"]).collect()}
    nodes.unpersist()


@pytest.mark.parametrize("selector", ["", " ", "a >", "> a", "a > > b", "a[", "a[b", "a:has(b)", "a:nth-child(x)", "a,,b", "a:before", "..x", "a:not()"])
def test_bad_selectors(spark, selector):
    nodes = dom.elements(dom.dom(spark.createDataFrame([(1, "<a>")], "id long, html string"), "id", "html"))
    with pytest.raises(dom.InvalidSelectorError):
        dom.select(nodes, selector)


def test_xpath(spark):
    text = "<html><body><div id='a'><p class='k'>1<p>2</div><div><p>3<span href='/x'>s</span></div></body></html>"
    nodes = dom.elements(dom.dom(spark.createDataFrame([(1, text)], "id long, html string"), "id", "html"))
    got = lambda e: [r["own"] for r in dom.xpath(nodes, e).orderBy("pre").collect()]
    assert got("//p") == ["1", "2", "3"] and got("/html/body/div/p[1]") == ["1", "3"] and got("//p[last()]") == ["2", "3"] and got("//div[@id='a']//p") == ["1", "2"]
    assert got("//p[@class]") == ["1"] and got("//span[starts-with(@href,'/')]") == ["s"] and got("//*[contains(@class, \"k\")]") == ["1"] and got("/p") == [] and got("//div[2]/*[1]") == ["3"]
    for bad in ("", "p", "//p[text()='1']", "//p[@a][1]", "//"):
        with pytest.raises(dom.InvalidSelectorError):
            dom.xpath(nodes, bad)


def test_find_by_text_order(spark):
    text = "<div><p id='k'>Ementa do caso</p></div><section>EMENTA</section><b><i>Ementa</i></b><script>ementa</script>"
    pages = dom.dom(spark.createDataFrame([(1, text)], "id long, html string"), "id", "html")
    order = lambda **how: [(r["tag"], r["place"]) for r in dom.find_by_text(pages, " ementa ", **how).orderBy("place").collect()]
    # shortest first, then the deeper, then one with an id
    assert order() == [("i", 1), ("section", 2), ("b", 3), ("p", 4), ("div", 5)]
    assert order(exact=True) == [("i", 1), ("section", 2), ("b", 3)] and order(exact=True, case_sensitive=True) == [] and order(limit=1) == [("i", 1)]
    assert dom.find_by_text(pages, "  ").count() == 0
    assert [r["tag"] for r in dom.find_by_regex(pages, "^Em.*(caso|a)$").orderBy("place").collect()] == ["div", "p", "b", "i"]


def test_hard_pages(spark):
    """1,500 levels, 20,000 links, text behind ten million characters, nulls, empties, broken markup."""
    rows = [(1, "<div>" * 1500 + "<a href='/deep'>end</a>"), (2, "<p>" + "<a href='/x'>link text</a>" * 20_000), (3, "x" * 10_000_001 + "<a href='/last'>é</a>"), (4, None), (5, ""), (6, "</p><<a href=/q>z<tr><td>1<td>2<li>b"), (None, "<a href='/n'>n</a>")]
    pages = dom.dom(spark.createDataFrame(rows, "id long, html string"), "id", "html")
    began = time.time()
    found = {r["page"]: r["links"] for r in dom.links(pages).collect()}
    assert time.time() - began < 60
    assert (found[1][0]["url"], found[1][0]["text"], len(found[2]), found[3][0]["text"], found[4], found[5]) == ("/deep", "end", 20_000, "é", [], [])
    assert [x["url"] for x in found[6]] == ["/q"] and found[None][0]["url"] == "/n"
    nodes = dom.elements(pages)
    assert dom.select(nodes, "div > div a[href='/deep']").count() == 1 and dom.select(nodes.filter("page = 1"), "div div").count() == 1499
    assert dom.select(nodes, "p > a:nth-of-type(20000)").count() == 1
    assert dom.select(nodes.filter("page is null"), "a").count() == 1
    row = spark.createDataFrame(rows[:3], "id long, html string").select(F.size(html.links("html")).alias("n")).collect()
    assert [r["n"] for r in row] == [1, 20_000, 1]


def test_unclosed_elements():
    page = dom.Page("<p><b>one<br><p>two</b><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table><dl><dt>k<dd>v<dt>l</dl>")
    shape = [(t, page.tag[u] if u >= 0 else None) for t, u in zip(page.tag, page.parent, strict=True)]
    assert shape == [("p", None), ("b", "p"), ("br", "b"), ("p", None), ("ul", None), ("li", "ul"), ("li", "ul"), ("ul", "li"), ("li", "ul"), ("table", None), ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("td", "tr"), ("dl", None), ("dt", "dl"), ("dd", "dl"), ("dt", "dl")]
    assert re.sub(r"\s+", " ", page.text().decode()) == "one two a b c 1 2 3 k v l"


def test_child_steps_parse_once_without_joins(spark):
    rows = spark.createDataFrame([(1, "<div><p>a</p><b>x</b><p>b</p></div>"), (2, None), (None, "<ul><li><p>c</p></li></ul>")], "page_id long, html string")
    nodes = dom.elements(dom.dom(rows, "page_id", "html"))
    found = [dom.select(nodes, "div > p, li > p"), dom.xpath(nodes, "/div/p"), dom.select(nodes, "p + p")]
    assert [sorted((r["page"] or 0, r["pre"]) for r in f.collect()) for f in found] == [[(0, 2), (1, 1), (1, 3)], [(1, 1), (1, 3)], []]
    for f in found:
        text = f._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("MapInArrow") == 1 and "Join" not in text
