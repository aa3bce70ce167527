"""Mixing sources to target weights by entropy balancing.

Every word of a document starts with rate 1. Among all rates that give each source its target number
of words, those of least relative entropy are exponential tilts ``exp(lambda_source)``; the
multipliers minimise the convex dual ``sum size * exp(lambda) - lambda * target``. Newton steps run
on the aggregated source table (the Hessian is diagonal, sources being disjoint) until the gradient
vanishes. Rates are then rounded into copies: each document gets the whole part of its rate, and
documents in seeded hash order get one more until the source's remaining words are reached. The
cut-off is found by aggregating hash digits, so no source is ever sorted in one place.

A null text has size 0, a null source is a source of its own and comes last, rows that repeat count
separately, an empty table gives an empty mix, other columns are ignored. Where all sizes are 0,
all targets are 0. The same rows and seed give the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordlake.llm.scratch import materialize

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
DIGIT_BITS = 16


def word_count(text: Column) -> Column:
    led = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{_SPACE}+", "")
    return F.length(F.regexp_replace(led, f"{_WORD}+{_SPACE}*", "x")).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target): ``share`` of all words by cycling weights, at most ``cap`` times a source.

    With sources ordered by cap over weight, those that reach their cap come first; the level of the
    others follows from what those leave over.
    """
    every = Window.orderBy(F.col("source").isNull(), "source")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * cap)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (
        ranked.withColumn("goal", F.sum("source_size").over(whole) * share)
        .withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(later))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"])
    )
    return level.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def newton_rates(targets: DataFrame, tolerance: float = 1e-10, most: int = 200) -> DataFrame:
    """Adds ``rate = exp(lambda)``. Each step is one distributed pass; the loop ends when every gradient is small."""
    size, target, lam = F.col("source_size"), F.col("target"), F.col("lam")
    state = materialize(targets.withColumn("lam", F.lit(0.0)), "newton")
    for _ in range(most):
        gap = state.filter((target > 0) & (size > 0)).agg(F.max(F.abs(size * F.exp(lam) - target) / target)).first()[0]
        if gap is None or gap <= tolerance:
            break
        hessian = size * F.exp(lam)
        state = materialize(state.withColumn("lam", F.when(hessian > 0, lam - (hessian - target) / hessian).otherwise(lam)), "newton")
    return state.withColumn("rate", F.when((size > 0) & (target > 0), F.round(F.exp(lam), 9)).otherwise(0.0)).drop("lam")


def _crossing(rows: DataFrame, need: DataFrame, digit: Column) -> DataFrame:
    """Per source the digit at which running sizes reach ``need``, and what is still needed within it."""
    sums = rows.groupBy("key", digit.alias("digit")).agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("key").orderBy("digit")
    cut = sums.withColumn("upto", F.sum("words").over(up_to)).join(need, "key")
    cut = cut.filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("words") < F.col("need")))
    return cut.select("key", "digit", (F.col("need") - F.col("upto") + F.col("words")).alias("need"))


def _source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))


def _digits() -> list[Column]:
    """The seeded hash ``u`` from its top digit down."""
    low_bits = 64 - 2 * DIGIT_BITS
    return [
        F.shiftrightunsigned("u", 64 - DIGIT_BITS), F.shiftrightunsigned("u", low_bits).bitwiseAND(2**DIGIT_BITS - 1), F.col("u").bitwiseAND(2**low_bits - 1),
    ]


def _source_cuts(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Per source key: source_size, target, rate, whole copies, and the hash digits up to which a row gets one more."""
    rates = newton_rates(source_targets(sized, weights, share, cap))
    rates = rates.withColumn("key", _source_key()).drop("source")
    rates = rates.withColumn("base", F.floor("rate").cast("long"))
    rates = materialize(rates.withColumn("need", F.when(F.col("rate") > F.col("base"), F.col("target") - F.col("base") * F.col("source_size")).otherwise(0.0)), "rates")

    digit1, digit2, low = _digits()
    first = materialize(_crossing(sized, rates.filter("need > 0").select("key", "need"), digit1), "cut")
    within = sized.join(first.select("key", F.col("digit").alias("d1")), "key").filter(digit1 == F.col("d1"))
    second = materialize(_crossing(within, first.select("key", "need"), digit2), "cut")
    within = within.join(second.select("key", F.col("digit").alias("d2")), "key").filter(digit2 == F.col("d2"))
    tail = within.groupBy("key", low.alias("low")).agg(F.sum("size").alias("words"))
    tail = tail.withColumn("upto", F.sum("words").over(Window.partitionBy("key").orderBy("low"))).join(second.select("key", "need"), "key")
    last = tail.filter(F.col("upto") - F.col("words") / 2 <= F.col("need")).groupBy("key").agg(F.max("low").alias("d3"))
    cuts = (
        rates.join(first.select("key", F.col("digit").alias("d1")), "key", "left")
        .join(second.select("key", F.col("digit").alias("d2")), "key", "left")
        .join(last, "key", "left")
        .select("key", "source_size", "target", "rate", "base", F.coalesce("d1", F.lit(-1)).alias("d1"), F.coalesce("d2", F.lit(-1)).alias("d2"), F.coalesce("d3", F.lit(-1)).alias("d3"))
    )
    return materialize(cuts, "cuts")


def _copies() -> Column:
    given, cut = F.struct(*(d.cast("long") for d in _digits())), F.struct(*(F.col(c).cast("long") for c in ("d1", "d2", "d3")))
    return F.col("base") + F.when(given <= cut, 1).otherwise(0)


def _sized(df: DataFrame, key: str, seed: int) -> DataFrame:
    sized = df.select(F.col(key).alias("id"), "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.col(key), F.lit(seed)).alias("u"))
    return materialize(sized.withColumn("key", _source_key()), "sized")


def mix(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, key: str = "doc_id", seed: int = 29) -> DataFrame:
    """One row per row of ``df``: key, source, size, source_size, target, rate, copies."""
    sized = _sized(df, key, seed)
    cuts = _source_cuts(sized, weights, share, cap)
    return sized.join(cuts, "key").select(F.col("id").alias(key), "source", "size", "source_size", "target", "rate", _copies().alias("copies"))


def mixed_rows(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, key: str = "doc_id", seed: int = 29) -> DataFrame:
    """The mix itself: every row of ``df`` as often as its copies say, with its columns."""
    cuts = _source_cuts(_sized(df, key, seed), weights, share, cap)
    placed = df.select(F.struct(*df.columns).alias("row"), F.col("source"), F.xxhash64(F.col(key), F.lit(seed)).alias("u")).withColumn("key", _source_key())
    repeated = placed.join(cuts.select("key", "base", "d1", "d2", "d3"), "key").select("row", _copies().alias("copies"))
    return repeated.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
