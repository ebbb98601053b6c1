"""Support and resistance: pivots, clusters, touches, reactions, zones, reference prices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import previous


def pivots(periods: DataFrame) -> DataFrame:
    """Classic, Camarilla, Woodie and Fibonacci pivots of a period's high, low and close."""
    h, l, c = F.col("high"), F.col("low"), F.col("close")
    p, r = (h + l + c) / 3, h - l
    out = {"pivot": p, "r1": p * 2 - l, "s1": p * 2 - h, "r2": p + r, "s2": p - r, "r3": h + (p - l) * 2, "s3": l - (h - p) * 2}
    # Factors of the Camarilla and Fibonacci levels.
    for i, k in enumerate((12, 6, 4, 2), 1):
        out |= {f"cam_r{i}": c + r * 1.1 / k, f"cam_s{i}": c - r * 1.1 / k}
    out["woodie"] = (h + l + c * 2) / 4
    for i, k in enumerate((0.382, 0.618, 1.0), 1):
        out |= {f"fib_r{i}": p + r * k, f"fib_s{i}": p - r * k}
    return periods.withColumns(out)


def periods(candles: DataFrame, unit: str) -> DataFrame:
    """Candles of complete calendar periods (week, month), the last of each symbol left out."""
    start = F.unix_millis(F.date_trunc(unit, F.timestamp_millis("ts")))
    out = candles.groupBy("symbol", start.alias("period")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )
    return out.withColumn("_last", F.max("period").over(Window.partitionBy("symbol"))).where("period < _last").drop("_last")


def reference_prices(candles: DataFrame, unit: str) -> DataFrame:
    """Candles with the extremes and close of the complete period before, and whether they are inside."""
    start = F.unix_millis(F.date_trunc(unit, F.timestamp_millis("ts")))
    rows = candles.withColumn("period", start)
    done = rows.groupBy("symbol", "period").agg(F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "ts").alias("c"))
    w = Window.partitionBy("symbol").orderBy("period")
    done = done.select("symbol", "period", *(F.lag(x).over(w).alias(f"previous_{n}") for x, n in (("h", "high"), ("l", "low"), ("c", "close"))))
    out = rows.join(done, ["symbol", "period"])
    return out.withColumns({"distance": F.try_divide("close", "previous_close") - 1, "inside": F.col("close").between(F.col("previous_low"), F.col("previous_high"))})


def gap_clusters(prices: DataFrame, eps: float = 0.005, least: int = 2) -> DataFrame:
    """Clusters of a symbol's prices, split where neighbours lie more than ``eps`` of the whole range apart."""
    w = Window.partitionBy("symbol").orderBy("price")
    whole = Window.partitionBy("symbol")
    apart = (F.col("price") - F.lag("price").over(w) > (F.max("price").over(whole) - F.min("price").over(whole)) * eps).cast("int")
    rows = prices.withColumn("_new", F.coalesce(apart, F.lit(0)))
    rows = rows.withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("symbol", "cluster").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.avg("price").alias("center"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= least)


def chained(prices: DataFrame, tolerance: float, rule: str = "mean", least: int = 1) -> DataFrame:
    """Clusters grown in price order: a price joins while within ``tolerance`` of the running
    mean (``mean``) or of the first price (``anchor``). Groups are the levels of one symbol."""

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        out, held = [], []
        for price in [*sorted(pdf["price"]), None]:
            at = (sum(held) / len(held) if rule == "mean" else held[0]) if held else None
            if held and (price is None or price > at * (1 + tolerance)):
                if len(held) >= least:
                    out.append((pdf["symbol"].iloc[0], held[0], held[-1], sum(held) / len(held), len(held)))
                held = []
            if price is not None:
                held.append(price)
        return pd.DataFrame(out, columns=["symbol", "low", "high", "center", "n"])

    kind = dict(prices.dtypes)["symbol"]
    return prices.groupBy("symbol").applyInPandas(sweep, f"symbol {kind}, low double, high double, center double, n bigint")


def touches(levels: DataFrame, candles: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """How often and when last candles touched each level. Both sides are dealt by symbol and
    price step (the logarithm of the price), so a candle meets only levels near its range."""
    step = 0.05
    slot = lambda c: F.floor(F.log(c) / step)
    near = candles.select(
        "symbol", "ts", "high", "low", F.explode(F.sequence(slot(F.col("low") * (1 - tolerance)), slot(F.col("high") * (1 + tolerance)))).alias("_slot")
    )
    rows = levels.withColumn("_slot", slot(F.col("price"))).join(near, ["symbol", "_slot"])
    hit = rows.where((F.col("low") <= F.col("price") * (1 + tolerance)) & (F.col("high") >= F.col("price") * (1 - tolerance)))
    counts = hit.groupBy("symbol", "price").agg(F.count(F.lit(1)).alias("touches"), F.max("ts").alias("last_touch"))
    return levels.join(counts, ["symbol", "price"], "left").fillna(0, ["touches"])


def reactions(candles: DataFrame, ahead: int = 10) -> DataFrame:
    """Greatest rise and fall from each close within the next ``ahead`` candles."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(1, ahead)
    return candles.withColumns({"rise": F.try_divide(F.max("high").over(w), "close") - 1, "fall": 1 - F.try_divide(F.min("low").over(w), "close")})


def zone_touches(zones: DataFrame, ticks: DataFrame, debounce_ms: int) -> DataFrame:
    """Ticks inside a zone (symbol, zone, low, high) that come at least ``debounce_ms`` after
    the tick inside it before. Both sides are dealt by symbol and price step, so a tick meets only
    zones near its price; the tick before is carried over buckets of time (:func:`running.previous`)."""
    step = 0.05
    slot = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1e-9))) / step)
    dealt = zones.withColumn("_slot", F.explode(F.sequence(slot("low"), slot("high"))))
    inside = ticks.withColumn("_slot", slot("p")).join(dealt, ["symbol", "_slot"]).where(F.col("p").between(F.col("low"), F.col("high"))).drop("_slot")
    inside = previous(inside, "t", "_before", ["symbol", "zone"], ["t", "seq"])
    return inside.where(F.col("_before").isNull() | (F.col("t") - F.col("_before") >= debounce_ms)).drop("_before")


def level_scores(rows: DataFrame) -> DataFrame:
    """0 to 100 from touches, recency, width and volume of a level."""
    points = F.least(F.col("touches"), F.lit(5)) * 5 + F.least(F.col("n"), F.lit(10)) * 3
    return rows.withColumn("score", F.least(F.lit(100), points + 45 - F.least(F.lit(45), F.floor(F.col("age_ms") / 86_400_000))))


def price_targets(candidates: DataFrame, last: DataFrame, tolerance: float = 0.005, k: int = 10) -> DataFrame:
    """Candidate prices (symbol, source, price, weight) chained to targets, weighted by source,
    the ``k`` strongest of each symbol with their direction from the last price."""
    joined = chained(candidates.select("symbol", "price"), tolerance, "mean")
    slots = joined.select("symbol", "low", "high", "center", "n")
    inside = candidates.join(slots, "symbol").where(F.col("price").between(F.col("low"), F.col("high")))
    out = inside.groupBy("symbol", "low", "high").agg(
        F.try_divide(F.sum(F.col("price") * F.col("weight")), F.sum("weight")).alias("target"), F.sum("weight").alias("weight"), F.count_distinct("source").alias("sources")
    )
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("weight"), F.desc("sources"), "target"))
    out = out.join(last, "symbol").withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("symbol", "rank", "target", "weight", "sources", F.when(F.col("target") > F.col("last"), "up").otherwise("down").alias("direction"))


def upsert_zones(zones: DataFrame, share: float = 0.0002, least: float = 8.0) -> DataFrame:
    """Zones (symbol, kind, anchor, low, high, score, seq) merged in the order of arrival: one
    that lies within max(share * anchor, least) of a zone of its kind widens it and raises its
    score. Groups are the zones of one symbol and kind."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        held: list[list] = []
        for r in pdf.sort_values("seq").itertuples():
            near = [z for z in held if abs(z[0] - r.anchor) <= max(share * r.anchor, least)]
            if near:
                z = min(near, key=lambda z: abs(z[0] - r.anchor))
                z[0], z[1], z[2], z[3], z[4] = (z[0] * z[4] + r.anchor) / (z[4] + 1), min(z[1], r.low), max(z[2], r.high), max(z[3], r.score), z[4] + 1
            else:
                held.append([r.anchor, r.low, r.high, r.score, 1])
        rows = [(pdf["symbol"].iloc[0], pdf["kind"].iloc[0], *z) for z in held]
        return pd.DataFrame(rows, columns=["symbol", "kind", "anchor", "low", "high", "score", "touches"])

    kind = dict(zones.dtypes)["symbol"]
    return zones.groupBy("symbol", "kind").applyInPandas(merge, f"symbol {kind}, kind string, anchor double, low double, high double, score double, touches bigint")


def bootstrap(values: DataFrame, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Mean of each symbol's values (a level's reactions) with a 95 % bootstrap interval and a normal one."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["value"].to_numpy())
        means = np.random.default_rng(seed).choice(x, (resamples, len(x))).mean(1)
        half = 1.96 * x.std(ddof=1) / len(x) ** 0.5 if len(x) > 1 else float("nan")
        row = (pdf["symbol"].iloc[0], x.mean(), *np.percentile(means, [2.5, 97.5]), x.mean() - half, x.mean() + half)
        return pd.DataFrame([row], columns=["symbol", "mean", "low", "high", "normal_low", "normal_high"])

    kind = dict(values.dtypes)["symbol"]
    return values.groupBy("symbol").applyInPandas(draw, f"symbol {kind}, mean double, low double, high double, normal_low double, normal_high double")
