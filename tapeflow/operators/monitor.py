"""Tests of price levels tick by tick: which level is met, how it reacts, and the ticks around."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import quotient
from .running import running_sum

# Tolerance around a level; shares of delta in volume; moves in percent; ratios of volume.
TOLERANCE, STRONG, MODERATE = 0.005, 0.6, 0.3
TREND_STRONG, TREND_WEAK, VOLATILE = 2.0, 0.5, 1.0
EXTREME, HIGH, ELEVATED, LOW = 3.0, 2.0, 1.5, 0.5
#: Ticks that a test looks back on, its own included.
LOOKBACK = 20
#: Ticks of a run that is scanned at once; a run's last ``LOOKBACK`` are dealt to the next one too.
RUN = 10_000
#: Ticks of a block whose volumes are summed on their own; blocks begin with a symbol's first tick.
BLOCK = 16
#: Width of a step of log price by which ticks and levels meet.
STEP = 0.02


def block_sum(values: Column, n: Column) -> Column:
    """Sum of an array of doubles, fewer than ``2 * BLOCK``, whose last is the n-th of its line: what stands before a whole block of
    the line is added up in order, then the block's own sum, then what follows. The SQL's windows add up so; any other order
    gives other last digits, which tell where a ratio lies on a threshold."""
    before = F.pmod(F.size(values) - n, F.lit(BLOCK)).cast("int")
    after = F.size(values) - before - BLOCK
    total = lambda some, start: F.aggregate(some, start, lambda a, x: a + x)
    part = lambda at, count: F.slice(values, at + 1, F.greatest(count, F.lit(0)))
    blocks = total(part(before, F.lit(BLOCK)), F.lit(0.0))
    whole = total(part(before + BLOCK, after), total(part(F.lit(0), before), F.lit(0.0)) + blocks)
    return F.when(after >= 0, whole).otherwise(total(values, F.lit(0.0)))


def recent(ticks: DataFrame, bucket_ms: int = 86_400_000) -> DataFrame:
    """Ticks (symbol, t, seq, price, volume, delta) with what the last ticks of their symbol give: n (ticks so far), change10 (percent
    over the last 10, infinite if it begins at 0), volatility20 (percent), momentum5 and volume_ratio. A symbol is cut into runs of
    ``RUN`` ticks."""
    rows = running_sum(ticks, F.lit(1), "n", ["symbol"], ["t", "seq"], bucket_ms)
    own = F.floor((F.col("n") - 1) / RUN)
    again = F.when((F.col("n") - 1) % RUN >= RUN - LOOKBACK, own + 1)
    rows = rows.withColumn("_own", own).withColumn("_run", F.explode(F.array_compact(F.array(own, again))))
    line = Window.partitionBy("symbol", "_run").orderBy("n")
    w = lambda k: line.rowsBetween(1 - k, 0)
    first = F.first("price").over(w(10))
    mean5 = F.avg("volume").over(w(5))
    rows = rows.withColumns(
        {
            "change10": F.when(F.col("n") >= 10, quotient(F.col("price") - first, first) * 100),
            "volatility20": F.when(F.col("n") >= 20, F.coalesce(F.try_divide(F.stddev_pop("price").over(w(20)), F.avg("price").over(w(20))), F.lit(0.0)) * 100).otherwise(0.0),
            "momentum5": F.when(F.col("n") >= 5, F.coalesce(F.try_divide(F.avg("delta").over(w(5)), mean5), F.lit(0.0))).otherwise(0.0),
            "_volumes": F.collect_list("volume").over(w(20)),
        }
    )
    mean20 = block_sum(F.col("_volumes"), F.col("n")) / F.size("_volumes")
    rows = rows.withColumn("volume_ratio", F.coalesce(F.try_divide(F.col("volume"), mean20), F.lit(1.0))).drop("_volumes")
    return rows.where("_run = _own").drop("_own", "_run")


def slot(price: Column) -> Column:
    """The step of log price that a price lies in."""
    return F.floor(F.log(price) / STEP)


def bands(levels: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """symbol, _slot and _levels: the levels (symbol, kind, place, level, strength) whose band touches a step of log price, as a list
    in which supports come before resistances, then by ``place`` and price."""
    reach = F.explode(F.sequence(slot(F.col("level") * (1 - tolerance * 1.001)), slot(F.col("level") * (1 + tolerance * 1.001))))
    entry = F.struct((F.col("kind") != "support").alias("a"), "place", "level", "kind", "strength")
    return levels.where("level > 0").withColumn("_slot", reach).groupBy("symbol", "_slot").agg(F.collect_set(entry).alias("_levels"))


def met(ticks: DataFrame, levels: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``ticks`` that lie within ``tolerance`` of a level, with the first such level: supports before resistances, then by ``place``.

    Levels are static: a tick meets the short list of its own step of log price (:func:`bands`) in one equal join, and takes
    the first of that list; nothing is aggregated, so ticks may be a stream."""
    near = F.filter("_levels", lambda x: F.abs(F.col("price") - x["level"]) <= x["level"] * tolerance)
    found = ticks.where("price > 0").withColumn("_slot", slot(F.col("price"))).join(bands(levels, tolerance), ["symbol", "_slot"])
    found = found.withColumn("_first", F.array_min(near)).where("_first IS NOT NULL")
    return found.select(*ticks.columns, "_first.kind", "_first.level", "_first.strength")


def reaction(delta: Column, volume: Column, support: Column) -> Column:
    """How a level reacts: by the delta's share in the volume, whose sign turns at a resistance."""
    share = F.when(volume > 0, delta / volume).otherwise(0.0)
    share = F.when(support, share).otherwise(-share)
    return F.when(share > STRONG, "strong_defense").when(share > MODERATE, "defense").when(share < -STRONG, "weak_defense").otherwise("neutral")


def judged(tests: DataFrame) -> DataFrame:
    """Tests with reaction, confidence, trend, volatility and volume classes, momentum and advice; row by row."""
    support = F.col("kind") == "support"
    change, ratio = F.col("change10"), F.col("volume_ratio")
    trend = F.when(change.isNull(), "UNKNOWN").when(change > TREND_STRONG, "STRONG_UP").when(change > TREND_WEAK, "UP").when(change < -TREND_STRONG, "STRONG_DOWN")
    volume = F.when(ratio > EXTREME, "EXTREME").when(ratio > HIGH, "HIGH").when(ratio > ELEVATED, "ELEVATED").when(ratio < LOW, "LOW").otherwise("NORMAL")
    momentum = F.when(change.isNull(), "NEUTRAL").when(F.col("momentum5") > 0.1, "BULLISH").when(F.col("momentum5") < -0.1, "BEARISH").otherwise("NEUTRAL")
    out = tests.withColumns(
        {
            "deviation": (F.col("price") / F.col("level") - 1) * 100,
            "reaction": reaction(F.col("delta"), F.col("volume"), support),
            "trend": trend.when(change < -TREND_WEAK, "DOWN").otherwise("SIDEWAYS"),
            "volatility": F.when(change.isNull(), "UNKNOWN").when(F.col("volatility20") > VOLATILE, "HIGH").otherwise("LOW"),
            "volume_class": volume,
            "momentum": momentum,
        }
    )
    kind = F.col("reaction")
    confidence = F.when(kind.isin("strong_defense", "weak_defense"), "HIGH").when(kind == "defense", "MEDIUM").otherwise("LOW")
    trade, way = F.when(support, "BUY").otherwise("SELL"), F.when(support, "BREAKDOWN").otherwise("BREAKOUT")
    advice = F.when(kind == "strong_defense", trade).when(kind == "defense", F.concat(F.lit("CAUTIOUS "), trade)).when(kind == "weak_defense", F.concat(F.lit("WATCH FOR "), way)).otherwise("MONITOR")
    significance = F.when(F.col("volume_class").isin("EXTREME", "HIGH"), "HIGH").when(F.col("volume_class") == "ELEVATED", "MEDIUM").otherwise("LOW")
    return out.withColumns({"confidence": confidence, "advice": advice, "significance": significance})


def level_tests(ticks: DataFrame, levels: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Every test of a level by a tick. Ticks with null price, volume, delta or time are left out; a symbol without levels has no tests."""
    rows = ticks.select("symbol", "t", "seq", "price", "volume", "delta").dropna()
    return judged(met(recent(rows), levels, tolerance))


def summary(tests: DataFrame) -> DataFrame:
    """Tests of each level, defences that held and failed, and the share that held, in percent."""
    held = F.col("reaction").isin("strong_defense", "defense")
    out = tests.groupBy("symbol", "kind", "level").agg(
        F.count(F.lit(1)).alias("tests"), F.count(F.when(held, 1)).alias("held"), F.count(F.when(F.col("reaction") == "weak_defense", 1)).alias("failed"), F.max("t").alias("last_t")
    )
    return out.withColumn("success", F.col("held") / F.col("tests") * 100)
