"""Levels from many sources in one table, merged where they lie together, scored; and zones of defence made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weight of each source of a level; strength and side of each source of defence.
PROFILE_WEIGHTS = {"daily": {"poc": 1.5, "vah": 1.2, "val": 1.2, "hvn": 0.8}, "weekly": {"poc": 1.8, "vah": 1.8, "val": 1.8}, "monthly": {"poc": 2.0, "vah": 2.0, "val": 2.0}}
AVERAGE_WEIGHTS = {"ema_21_15m": 0.5, "ema_21_1h": 0.8, "ema_21_4h": 1.2, "ema_21_1d": 1.5, "mme_21": 1.0}
CLASSIC_WEIGHT, PIVOT_WEIGHT, ROUND_WEIGHT, OTHER_AVERAGE = 1.3, 1.0, 0.6, 0.8
CONFLUENCE_POINTS = {1: 5, 2: 12, 3: 20, 4: 25}
PROFILE_DEFENCE = {"poc": 45, "vah": 35, "val": 35, "hvn": 25}
AVERAGE_DEFENCE = {"1d": 30, "4h": 25, "1h": 15, "15m": 10}
#: Share of the price within which levels, and signals of defence, lie together; step of round numbers.
TOGETHER, ZONE, ROUND = 0.0015, 0.003, 1000
#: Candles whose touches count, levels and zones listed, sources of a zone.
LOOKBACK, LISTED, MOST_ZONES, LEAST_SOURCES = 100, 20, 5, 2


def candidates(prices: DataFrame, profiles: DataFrame, pivots: DataFrame, averages: DataFrame, step: float = ROUND) -> DataFrame:
    """One table of levels: symbol, price, source, weight.

    ``prices`` (symbol, last); ``profiles`` (symbol, period, kind, price) with kinds poc, vah, val, hvn; ``pivots`` (symbol, method,
    name, price); ``averages`` (symbol, name, price). Seven round numbers around the price are added for symbols that have any
    other source. Levels that are null or not positive are left out, as are periods without weight."""
    weights = F.create_map(*(F.lit(x) for p, kinds in PROFILE_WEIGHTS.items() for k, w in kinds.items() for x in (f"{k}_{p}", w)))
    source = F.concat_ws("_", "kind", "period")
    parts = [
        profiles.select("symbol", "price", source.alias("source"), weights[source].alias("weight")),
        pivots.select("symbol", "price", F.concat(F.lit("pivot_"), "method", F.lit("_"), "name").alias("source"), F.when(F.col("method") == "classic", CLASSIC_WEIGHT).otherwise(PIVOT_WEIGHT).alias("weight")),
        averages.select("symbol", "price", F.col("name").alias("source"), F.coalesce(F.create_map(*(F.lit(x) for kv in AVERAGE_WEIGHTS.items() for x in kv))[F.col("name")], F.lit(OTHER_AVERAGE)).alias("weight")),
    ]
    given = reduce(DataFrame.unionByName, parts).where("price > 0 AND weight IS NOT NULL")
    base = F.floor(F.col("last") / step) * step
    near = F.transform(F.sequence(F.lit(-3), F.lit(3)), lambda k: base + k * step)
    rounds = prices.where("last > 0").join(given.select("symbol").distinct(), "symbol", "left_semi").select("symbol", F.explode(near).alias("price"))
    rounds = rounds.where("price > 0").select("symbol", F.col("price").cast("double"), F.lit("round_number").alias("source"), F.lit(ROUND_WEIGHT).alias("weight"))
    return given.union(rounds)


def anchored(levels: DataFrame, tolerance: str, *values: str) -> DataFrame:
    """``levels`` (symbol, price, ...) as groups: symbol and ``group``, the list of structs of price and ``values``.

    From the lowest price up, a group takes all prices within ``tolerance`` (a column, one value a symbol) of its first. Where two
    neighbours lie further apart than that a group surely begins, so a symbol falls into runs that are independent; only
    inside a run the beginnings are followed one after the other, in a list as long as the run."""
    line = Window.partitionBy("symbol").orderBy("price", *values)
    fresh = F.coalesce(F.col("price") - F.lag("price").over(line) > F.col(tolerance), F.lit(True))
    rows = levels.withColumn("_fresh", fresh.cast("long")).withColumn("_run", F.sum("_fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("symbol", "_run").agg(F.sort_array(F.collect_list(F.struct("price", *values))).alias("_all"), F.first(tolerance).alias("_far"))
    starts = F.aggregate(
        "_all",
        F.array().cast("array<double>"),
        lambda held, x: F.when((F.size(held) == 0) | (x["price"] - F.try_element_at(held, F.lit(-1)) > F.col("_far")), F.concat(held, F.array(x["price"]))).otherwise(held),
    )
    runs = runs.withColumn("_starts", starts)
    begin = F.col("_begin")
    own = F.filter("_all", lambda x: (x["price"] >= begin) & (x["price"] - begin <= F.col("_far")))
    return runs.withColumn("_begin", F.explode("_starts")).select("symbol", own.alias("group"))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def scored(levels: DataFrame, prices: DataFrame, candles: DataFrame | None = None, tolerance: float = TOGETHER) -> DataFrame:
    """Levels of 0 to 100 points by touches, weight of sources, confluence and nearness: symbol, price, source, sources, touches,
    distance, strength, side and rank (``LISTED`` a symbol at most, strongest first, of equals the lower price).

    ``candles`` are the recent ones: the last ``LOOKBACK`` of each symbol count, a touch is a high or low within the tolerance of
    the level. Without candles a level has 8 points and no touches."""
    rows = levels.join(prices.where("last > 0"), "symbol").withColumn("_far", F.col("last") * tolerance)
    groups = anchored(rows, "_far", "source", "weight").join(prices, "symbol")
    best = F.reduce("group", F.lit(None).cast("struct<weight: double, source: string>"), lambda a, x: F.when(a.isNull() | (x["weight"] > a["weight"]), F.struct(x["weight"].alias("weight"), x["source"].alias("source"))).otherwise(a))
    groups = groups.select(
        "symbol", "last", F.round(_mean(F.col("group.price")) + 1.7e-10, 2).alias("price"), best["source"].alias("source"), F.sort_array(F.array_distinct("group.source")).alias("sources"),
        F.aggregate("group.weight", F.lit(0.0), lambda a, x: a + x).alias("_weight"),
    )
    if candles is None:
        groups = groups.withColumns({"touches": F.lit(None).cast("long"), "_touched": F.lit(8.0)})
    else:
        newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
        recent = candles.withColumn("_k", newest).where(F.col("_k") <= LOOKBACK).groupBy("symbol").agg(F.collect_list(F.struct("high", "low")).alias("_recent"))
        near = lambda x: (F.abs(x["high"] - F.col("price")) <= F.col("price") * tolerance) | (F.abs(x["low"] - F.col("price")) <= F.col("price") * tolerance)
        groups = groups.join(recent, "symbol", "left").withColumn("touches", F.coalesce(F.size(F.filter("_recent", near)), F.lit(0)).cast("long"))
        groups = groups.withColumn("_touched", F.least(F.lit(25.0), F.col("touches") * 6.0)).drop("_recent")
    together = F.coalesce(F.create_map(*(F.lit(x) for kv in CONFLUENCE_POINTS.items() for x in kv))[F.size("sources")], F.lit(30))
    distance = F.abs(F.col("price") - F.col("last")) / F.col("last") * 100
    points = F.col("_touched") + F.least(F.lit(25.0), F.col("_weight") * 8) + together + F.greatest(F.lit(0.0), 20 - distance * 3)
    side = F.when(F.col("price") < F.col("last"), "support").when(F.col("price") > F.col("last"), "resistance").otherwise("at_price")
    out = groups.withColumns({"distance": distance, "strength": F.least(F.lit(100), F.round(points + 1.7e-10).cast("int")), "side": side})
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("strength"), "price"))
    return out.withColumn("rank", rank).where(F.col("rank") <= LISTED).select("symbol", "price", "source", "sources", "touches", "distance", "strength", "side", "rank")


def defence_signals(prices: DataFrame, profiles: DataFrame, pivots: DataFrame, averages: DataFrame, levels: DataFrame, absorptions: DataFrame, book: DataFrame) -> DataFrame:
    """Signals of defence from all sources: symbol, price, source, strength, side (buy or sell).

    Further to :func:`candidates`: ``levels`` as :func:`scored` gives them, of which those above 30 points count; ``absorptions``
    (symbol, price, side, strength of 0 to 1); ``book`` (symbol, bid_depth, ask_depth, imbalance, depth_imbalance)."""
    last, below = F.col("last"), F.when(F.col("price") < F.col("last"), "buy").otherwise("sell")
    one = lambda df, source, strength, side: df.join(prices.where("last > 0"), "symbol").select("symbol", F.col("price").cast("double"), source.alias("source"), strength.cast("double").alias("strength"), side.alias("side"))
    kinds = F.create_map(*(F.lit(x) for kv in PROFILE_DEFENCE.items() for x in kv))[F.col("kind")]
    of_kind = F.when(F.col("kind") == "vah", "sell").when(F.col("kind") == "val", "buy").otherwise(below)
    frame = F.coalesce(*(F.when(F.col("name").contains(tf), w) for tf, w in AVERAGE_DEFENCE.items()), F.lit(15))
    supports = F.when(F.col("name").startswith("S") | (F.col("name") == "PP"), "buy").otherwise("sell")
    lean = F.abs("imbalance") * 200
    walls = F.array_compact(
        F.array(
            F.when((F.col("bid_depth") > 0) & ((F.col("imbalance") > 0.05) | (F.col("bid_depth") > F.col("ask_depth") * 1.1)), F.struct(F.lit(0.999).alias("f"), F.lit("orderbook_bid_wall").alias("source"), F.least(F.lit(40.0), lean).alias("strength"), F.lit("buy").alias("side"))),
            F.when((F.col("ask_depth") > 0) & ((F.col("imbalance") < -0.05) | (F.col("ask_depth") > F.col("bid_depth") * 1.1)), F.struct(F.lit(1.001).alias("f"), F.lit("orderbook_ask_wall").alias("source"), F.least(F.lit(40.0), lean).alias("strength"), F.lit("sell").alias("side"))),
            F.when(F.abs("depth_imbalance") > 0.1, F.struct(F.when(F.col("depth_imbalance") > 0, 0.998).otherwise(1.002).alias("f"), F.lit("depth_asymmetry").alias("source"), F.least(F.lit(30.0), F.abs("depth_imbalance") * 100).alias("strength"), F.when(F.col("depth_imbalance") > 0, "buy").otherwise("sell").alias("side"))),
        )
    )
    wall = book.join(prices.where("last > 0"), "symbol").select("symbol", "last", F.explode(walls).alias("w"))
    wall = wall.select("symbol", F.when(F.col("w.source") == "depth_asymmetry", last * F.col("w.f")).otherwise(F.round(last * F.col("w.f") + 1.7e-10, 2)).alias("price"), "w.source", "w.strength", "w.side")
    parts = [
        wall,
        one(profiles.where("period = 'daily'"), F.concat(F.lit("vp_"), "kind"), kinds, of_kind),
        one(levels.where("strength > 30").select("symbol", "price", F.col("source").alias("first"), "strength"), F.concat(F.lit("sr_level_"), "first"), F.least(F.lit(50.0), F.col("strength") * 0.5), below),
        one(absorptions.select("symbol", "price", F.col("side").alias("who"), F.col("strength").alias("s")), F.concat(F.lit("absorption_"), "who"), F.least(F.lit(40.0), F.col("s") * 40), F.col("who")),
        one(pivots, F.concat(F.lit("pivot_"), "method", F.lit("_"), "name"), F.when(F.col("name") == "PP", 30).otherwise(20), supports),
        one(averages, F.concat(F.lit("ema_"), "name"), frame, below),
    ]
    return reduce(DataFrame.unionByName, parts).where("price > 0 AND strength IS NOT NULL AND side IS NOT NULL")


def defence_zones(signals: DataFrame, prices: DataFrame, width: float = ZONE) -> DataFrame:
    """Zones of defence: symbol, side, rank, center, low, high, strength, sources, signals, kind, distance.

    Signals that lie together make a zone; its side is that of most signals (buy, of equals), its strength their mean times
    three tenths more for every source, 100 at most. Zones of ``LEAST_SOURCES`` sources count; of a symbol without such
    its five strongest do. ``MOST_ZONES`` a side at most, strongest first, of equals the lower."""
    rows = signals.join(prices.where("last > 0"), "symbol").withColumn("_far", F.col("last") * width)
    groups = anchored(rows, "_far", "source", "strength", "side").join(prices, "symbol")
    n, far = F.size("group"), F.col("last") * width
    sources = F.size(F.array_distinct("group.source"))
    mean = _mean(F.col("group.strength"))
    buys = F.size(F.filter("group", lambda x: x["side"] == "buy"))
    zones = groups.select(
        "symbol", "last", F.round(_mean(F.col("group.price")) + 1.7e-10, 2).alias("center"), F.round(F.array_min("group.price") - far * 0.5 + 1.7e-10, 2).alias("low"), F.round(F.array_max("group.price") + far * 0.5 + 1.7e-10, 2).alias("high"),
        F.round(F.least(F.lit(100.0), mean * (1 + sources * 0.3)) + 1.7e-10).cast("int").alias("strength"), sources.alias("sources"), n.alias("signals"),
        F.when(buys * 2 >= n, "buy").otherwise("sell").alias("side"), F.when(sources >= 3, "confluence").when(sources >= 2, "cluster").otherwise("single").alias("kind"),
    )
    order = [F.desc("strength"), F.col("center")]
    of_symbol = Window.partitionBy("symbol")
    zones = zones.withColumns({"_strong": F.max((F.col("sources") >= LEAST_SOURCES).cast("int")).over(of_symbol), "_k": F.row_number().over(of_symbol.orderBy(*order))})
    zones = zones.where(F.when(F.col("_strong") == 1, F.col("sources") >= LEAST_SOURCES).otherwise(F.col("_k") <= 5))
    zones = zones.withColumn("rank", F.row_number().over(Window.partitionBy("symbol", "side").orderBy(*order))).where(F.col("rank") <= MOST_ZONES)
    distance = F.abs(F.col("center") - F.col("last")) / F.col("last") * 100
    return zones.select("symbol", "side", "rank", "center", "low", "high", "strength", "sources", "signals", "kind", distance.alias("distance"))


def defence_balance(zones: DataFrame) -> DataFrame:
    """Strength of the buy zones against the sell zones of each symbol, and which side that favours."""
    part = lambda side: F.sum(F.when(F.col("side") == side, F.col("strength")).otherwise(0))
    out = zones.groupBy("symbol").agg(part("buy").alias("buy"), part("sell").alias("sell"))
    ratio = F.when(F.col("sell") > 0, F.col("buy") / F.col("sell")).when(F.col("buy") > 0, 99.0).otherwise(1.0)
    r = F.col("ratio")
    bias = F.when(r > 1.5, "strong_buy_defense").when(r > 1.1, "slight_buy_defense").when(r > 0.9, "neutral").when(r > 0.67, "slight_sell_defense").otherwise("strong_sell_defense")
    return out.withColumn("ratio", ratio).withColumn("bias", F.when(F.col("buy") + F.col("sell") == 0, "neutral").otherwise(bias))
