"""Route and filter candidates of single answers."""

from recordlake.operators import routes

HTML = """<html><a href="/a">1</a><a href=" /a ">2</a><a href="#x">3</a><a href="javascript:go()">4</a><a href='?p=2#top'>5</a><a>6</a>
<link href="style.css"><script src="//cdn.example.org/x.js"></script><form action="/s" method="post"></form><form></form>
<script>fetch('/api/one'); axios.get( "api/two" ); url("mailto:x"); const a = "/api/three";</script><!-- /juris/four --></html>"""
BASE = "https://site.example/dir/page?q=1"


def test_html_answers(spark):
    rows = [(1, BASE, HTML, "text/html"), (2, BASE, None, None), (3, BASE, "xhttp://api/no https://o.example/search?x /searching", "text/plain"), (4, None, "<html><a href='rel'><a href='ftp://x/y'><a href='http://[bad'><a href='http:///nohost'>", "")]
    got = routes.route_candidates(spark.createDataFrame(rows, "id long, url string, body string, kind string"), "id", "url", "body", "kind")
    assert got.columns == ["id", "place", "method", "url", "source", "reason", "confidence"]
    by = {}
    for r in got.orderBy("id", "place").collect():
        by.setdefault(r["id"], []).append((r["method"], r["url"], r["source"], r["confidence"]))
    root = "https://site.example"
    assert by[1] == [
        ("GET", f"{root}/a", "link", 0.55), ("GET", f"{root}/dir/page?p=2#top", "link", 0.55), ("GET", f"{root}/dir/style.css", "asset", 0.35), ("GET", "https://cdn.example.org/x.js", "script", 0.40), ("POST", f"{root}/s", "form", 0.70), ("GET", BASE, "form", 0.70),
        ("GET", f"{root}/api/one", "script", 0.65), ("GET", f"{root}/dir/api/two", "script", 0.65), ("GET", f"{root}/api/three", "text", 0.35), ("GET", f"{root}/juris/four", "text", 0.35),
    ]
    assert by[3] == [("GET", "https://api/no", "text", 0.35), ("GET", "https://o.example/search?x", "text", 0.35), ("GET", f"{root}/searching", "text", 0.35)]
    assert 2 not in by and 4 not in by


def test_json_answers(spark):
    rows = [(1, BASE, '{"next": "/api/p?2", "deep": [{"u": "https://o.example/Document/1"}, "/home", "/api/p?2"]}', "application/json"), (2, BASE, '{"u": "/api/x"', "application/json")]
    got = routes.route_candidates(spark.createDataFrame(rows, "id long, url string, body string, kind string"), "id", "url", "body", "kind").orderBy("id", "place").collect()
    assert [(r["id"], r["url"], r["source"]) for r in got] == [(1, "https://site.example/api/p?2", "json"), (1, "https://o.example/Document/1", "json"), (2, "https://site.example/api/x", "text")]


def test_filter_keys(spark):
    rows = [(1, '{"page": 1, "Sortierung": "x", "dataFim": null, "tipos": ["a"], "query": {"a": 1}, "x": 2, "pageable": true, "datas": 1.5}'), (2, '[{"page": 1}]'), (3, "{broken"), (4, None)]
    got = routes.filter_keys(spark.createDataFrame(rows, "id long, body string"), "id", "body").collect()
    assert {(r["id"], r["name"], r["field_type"]) for r in got} == {(1, "page", "int"), (1, "Sortierung", "str"), (1, "dataFim", "NoneType"), (1, "tipos", "json_array"), (1, "query", "dict"), (1, "pageable", "bool"), (1, "datas", "float")}
