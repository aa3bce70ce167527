"""Robots verdicts against a matcher that tries every rule, and stated cases."""

import random

from pyspark.sql import functions as F

from recordlake.operators import robots


def fits(pattern, target):
    """Whether a pattern fits, letter by letter."""
    end, pattern = pattern.endswith("$"), pattern.removesuffix("$")

    def go(p, t):
        if not p:
            return not t or not end
        if p[0] == "*":
            return any(go(p[1:], t[i:]) for i in range(len(t) + 1))
        return bool(t) and t[0] == p[0] and go(p[1:], t[1:])

    return go(pattern, target)


def verdict(rules, target):
    best = max(((len(p), allow) for allow, p in rules if p and fits(p, target)), default=(0, True))
    return best[1]


def test_against_trying_every_rule(spark):
    rng = random.Random(4)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    answers, rules = [], {}
    for i in range(40):
        rules[f"http://h{i}"] = [(rng.random() < 0.5, "/" + word(rng.randint(0, 4), "ab/*?.(+") + rng.choice(["", "", "$"])) for _ in range(rng.randint(1, 6))]
        answers.append((f"http://h{i}", 200, "User-Agent: *\n" + "\n".join(("Allow: " if a else "DISALLOW:") + p for a, p in rules[f"http://h{i}"])))
    urls = [(f"http://h{rng.randrange(40)}/" + word(rng.randint(0, 6), "ab/?.(+"),) for _ in range(600)]
    got = robots.may_fetch(spark.createDataFrame(urls, "url string"), spark.createDataFrame(answers, "origin string, status int, body string"), "bot").collect()
    assert len(got) == 600
    for r in got:
        origin, target = r["url"][: r["url"].index("/", 7)], r["url"][r["url"].index("/", 7) :]
        assert r["allowed"] == verdict(rules[origin], target), (r, rules[origin])


def test_answers_groups_and_urls(spark):
    own = "User-agent: Lake\nUser-agent: two # both\nDisallow: /own\n\nUser-agent: *\nDisallow: /\n"
    none = "User-agent: lake\nDisallow:\n\nUser-agent: *\r\nDisallow: /"
    answers = [("https://a", 200, own), ("https://b", 404, None), ("https://c", 503, own), ("https://d", None, None), ("https://e", 302, None), ("https://f", 200, none), ("https://g", 204, None), ("https://h", 200, "Disallow: /\nSitemap: x:y\nUser-agent: *\nAllow: /x\nDisallow: /x\nDisallow: /y z")]
    urls = ["https://A/own/x", "https://a/else", "https://b/q", "https://c/q", "https://d/q", "https://e/q", "https://f/q", "https://g", "https://h/x1", "https://h/", "https://h/y z", "https://h?y", "https://unasked/q", "no url", None]
    df = spark.createDataFrame([(u, 1) for u in urls], "url string, rule int").withColumnRenamed("rule", "n")
    frame = spark.createDataFrame(answers, "origin string, status int, body string")
    got = {r["url"]: (r["allowed"], r["rule"]) for r in robots.may_fetch(df, frame, "Lake/2.0 (+x)").collect()}
    assert got == {
        "https://A/own/x": (False, "/own"), "https://a/else": (True, None), "https://b/q": (True, None), "https://c/q": (False, None), "https://d/q": (False, None), "https://e/q": (False, None), "https://f/q": (True, None), "https://g": (True, None),
        "https://h/x1": (True, "/x"), "https://h/": (True, None), "https://h/y z": (False, "/y z"), "https://h?y": (True, None), "https://unasked/q": (None, None), "no url": (None, None), None: (None, None),
    }
    other = {r["url"]: r["allowed"] for r in robots.may_fetch(df, frame, "someone").collect()}
    assert other["https://A/own/x"] is False and other["https://a/else"] is False and other["https://f/q"] is False
    assert robots.may_fetch(df.limit(0), frame, "x").columns == ["url", "n", "allowed", "rule"]
    assert df.select(robots.target_of(F.col("url")).alias("t")).filter("t = '/?y'").count() == 1
