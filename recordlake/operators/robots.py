"""Robots rules as a table: which urls an agent may fetch, by the longest rule that fits.

An origin's robots answer allows all if it is missing (404), rules if it was sent (2xx), and forbids all otherwise.
A url whose origin was never asked has no verdict (null). Groups of rules that name the agent go before those for
all agents; of rules that fit, the longest pattern decides, and an allowing one among equals. ``*`` in a pattern
stands for any characters, a ``$`` behind it for the end of the path and query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def origin_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def target_of(url: Column) -> Column:
    """Path and query; an empty path is ``/``."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def robots_rules(answers: DataFrame) -> DataFrame:
    """(origin, agent, allow, pattern) of all sent robots files; ``answers`` has origin, status and body.

    Lines are ``name: value`` with comments behind ``#``. Agents named in consecutive lines share the rules below
    them. A rule without a pattern says nothing; one before any agent has no group.
    """
    sent = answers.filter((F.col("status") >= 200) & (F.col("status") < 300))
    lines = sent.select("origin", F.posexplode(F.split(F.coalesce("body", F.lit("")), "\r\n|\r|\n")).alias("at", "line"))
    plain = F.trim(F.regexp_replace("line", "#.*", ""))
    fields = lines.select("origin", "at", F.lower(F.trim(F.split_part(plain, F.lit(":"), F.lit(1)))).alias("name"), F.trim(F.regexp_extract(plain, "^[^:]*:(.*)$", 1)).alias("value"))
    fields = fields.filter(F.col("name").isin("user-agent", "allow", "disallow"))
    by_line = Window.partitionBy("origin").orderBy("at")
    begins = (F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(by_line), F.lit("")) != "user-agent")
    grouped = fields.withColumn("begins", begins).withColumn("group", F.sum(F.col("begins").cast("int")).over(by_line))
    agents = grouped.filter("name = 'user-agent'").select("origin", "group", F.lower("value").alias("agent"))
    rules = grouped.filter("name != 'user-agent' and value != ''").select("origin", "group", (F.col("name") == "allow").alias("allow"), F.col("value").alias("pattern"))
    # an agent's group without rules still goes before the group for all
    return agents.join(rules, ["origin", "group"], "left").select("origin", "agent", "allow", "pattern").distinct()


def pattern_regex(pattern: Column) -> Column:
    """A regular expression for a pattern."""
    end = pattern.endswith("$")
    body = F.when(end, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.regexp_replace(body, r"([^A-Za-z0-9_/*])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(quoted, r"\*+", ".*"), F.when(end, "$").otherwise(""))


def may_fetch(urls: DataFrame, answers: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """Adds ``allowed`` (true, false, or null where the origin was not asked) and the deciding ``rule``, if any.

    ``answers`` has a row an origin (origin, status, body); a null status is a failed request.
    """
    token = agent.split("/")[0].strip().lower()
    rules = robots_rules(answers).filter(F.col("agent").isin(token, "*"))
    named = rules.withColumn("__own", F.max(F.col("agent") == token).over(Window.partitionBy("origin"))).filter(F.col("__own") == (F.col("agent") == token))
    usable = named.filter("pattern is not null").select(F.col("origin").alias("__rule_origin"), "allow", "pattern", F.split_part("pattern", F.lit("*"), F.lit(1)).alias("__head"), pattern_regex(F.col("pattern")).alias("__regex"))
    usable = usable.withColumn("__head", F.rtrim("__head", F.lit("$")))
    asked = urls.withColumns({"__origin": origin_of(F.col(url)), "__target": target_of(F.col(url))})
    targets = asked.select("__origin", "__target").distinct()
    fits = targets.join(usable, (F.col("__origin") == F.col("__rule_origin")) & F.col("__target").startswith(F.col("__head")) & F.rlike("__target", F.col("__regex")))
    best = fits.groupBy("__origin", "__target").agg(F.max(F.struct(F.length("pattern").alias("size"), "allow", "pattern")).alias("best"))
    state = answers.select(F.col("origin").alias("__answer"), F.when(F.col("status") == 404, "open").when((F.col("status") >= 200) & (F.col("status") < 300), "ruled").otherwise("closed").alias("__state"))
    joined = asked.join(best, ["__origin", "__target"], "left").join(state, F.col("__origin") == F.col("__answer"), "left")
    ruled = F.col("__state") == "ruled"
    allowed = F.when(F.col("__state") == "open", True).when(F.col("__state") == "closed", False).when(ruled, F.coalesce("best.allow", F.lit(True)))
    return joined.withColumns({"allowed": allowed, "rule": F.when(ruled, F.col("best.pattern"))}).select(*urls.columns, "allowed", "rule")
