"""Order book: depth, imbalance, walls, impact, concentration, changes between snapshots, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decode_levels(column: str, side: str) -> Column:
    """[[price, quantity], ...] in text as structs, without levels that are not positive."""
    pairs = F.transform(column, lambda x: F.struct(F.lit(side).alias("side"), x[0].try_cast("double").alias("price"), x[1].try_cast("double").alias("qty")))
    return F.filter(pairs, lambda x: (x["price"] > 0) & (x["qty"] > 0))


def ranked(book: DataFrame) -> DataFrame:
    """Levels with their place from the best price on and the quantity and value up to them."""
    best_first = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy("snapshot", "side").orderBy(best_first, "seq")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    return book.withColumns(
        {
            "place": F.row_number().over(w),
            "cum_qty": F.sum("qty").over(up_to),
            "cum_value": F.sum((F.col("price") * F.col("qty")).cast("decimal(28,6)")).over(up_to).cast("double"),
        }
    )


def depth(book: DataFrame, tops: tuple[int, ...] = (1, 5, 10, 25)) -> DataFrame:
    """Value of the best levels of each side, their imbalance, and best prices with spread."""
    value = F.col("price") * F.col("qty")
    side = lambda s, n: F.sum(F.when((F.col("side") == s) & (F.col("place") <= n), value).otherwise(0).cast("decimal(28,6)")).cast("double")
    sums = [side(s, n).alias(f"{s}_{n}") for n in tops for s in ("bid", "ask")]
    out = ranked(book).groupBy("snapshot").agg(
        *sums, F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("best_bid"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("best_ask")
    )
    mid = (F.col("best_bid") + F.col("best_ask")) / 2
    out = out.withColumns({f"imbalance_{n}": F.try_divide(F.col(f"bid_{n}") - F.col(f"ask_{n}"), F.col(f"bid_{n}") + F.col(f"ask_{n}")) for n in tops})
    return out.withColumns({"mid": mid, "spread_bps": F.try_divide(F.col("best_ask") - F.col("best_bid"), mid) * 10_000})


def weighted_imbalance(book: DataFrame) -> DataFrame:
    # Weights of the six best levels.
    weights = F.array(*(F.lit(x) for x in (1.0, 0.8, 0.6, 0.4, 0.2, 0.1)))
    rows = ranked(book).where("place <= 6").withColumn("w", F.element_at(weights, F.col("place")) * F.col("price") * F.col("qty"))
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("w")).otherwise(0).cast("decimal(28,6)")).cast("double")
    out = rows.groupBy("snapshot").agg(side("bid").alias("bid"), side("ask").alias("ask"))
    return out.withColumn("weighted_imbalance", F.try_divide(F.col("bid") - F.col("ask"), F.col("bid") + F.col("ask")))


def walls(book: DataFrame, q: float = 0.9, k: float = 1.0) -> DataFrame:
    """Levels whose quantity reaches the ``q`` quantile of their side times ``k``."""
    limit = book.groupBy("snapshot", "side").agg((F.percentile("qty", F.lit(q)) * max(1.0, k)).alias("limit"))
    return book.join(limit, ["snapshot", "side"]).where(F.col("qty") >= F.col("limit"))


def impact(book: DataFrame, values: tuple[float, ...]) -> DataFrame:
    """What buying (asks) or selling (bids) for a value costs: the last level is taken in part."""
    sizes = F.explode(F.array(*(F.lit(float(v)) for v in values))).alias("value")
    rows = ranked(book).select("*", sizes)
    before = F.col("cum_value") - F.col("price") * F.col("qty")
    part = F.least(F.col("price") * F.col("qty"), F.greatest(F.col("value") - before, F.lit(0.0)))
    rows = rows.withColumn("part", part).where("part > 0")
    out = rows.groupBy("snapshot", "side", "value").agg(
        F.sum(F.col("part").cast("decimal(28,6)")).cast("double").alias("filled"),
        F.sum(F.try_divide("part", "price").cast("decimal(28,10)")).cast("double").alias("quantity"),
        F.count(F.lit(1)).alias("levels"),
        F.min_by("price", "place").alias("best"),
    )
    out = out.withColumn("average", F.try_divide("filled", "quantity"))
    return out.withColumns({"slippage_bps": F.abs(F.try_divide("average", "best") - 1) * 10_000, "complete": F.col("filled") >= F.col("value") - 1e-6})


def concentration(book: DataFrame) -> DataFrame:
    """Herfindahl index and share of the largest and the three largest levels of each side."""
    value = F.col("price") * F.col("qty")
    w = Window.partitionBy("snapshot", "side")
    rows = book.withColumn("share", F.try_divide(value, F.sum(value.cast("decimal(28,6)")).over(w).cast("double")))
    rows = rows.withColumn("k", F.row_number().over(w.orderBy(F.desc("share"), "seq")))
    return rows.groupBy("snapshot", "side").agg(
        F.sum(F.col("share") * F.col("share")).alias("hhi"), F.max("share").alias("top_1"), F.sum(F.when(F.col("k") <= 3, F.col("share")).otherwise(0.0)).alias("top_3")
    )


def microstructure(book: DataFrame) -> DataFrame:
    """Volume-weighted price of each side and its mean distance from the best price."""
    rows = ranked(book)
    best = Window.partitionBy("snapshot", "side").orderBy("place")
    rows = rows.withColumn("away", F.abs(F.try_divide(F.col("price"), F.first("price").over(best)) - 1) * 10_000)
    return rows.groupBy("snapshot", "side").agg(
        F.try_divide(F.sum((F.col("price") * F.col("qty")).cast("decimal(28,6)")).cast("double"), F.sum("qty")).alias("vwap"), F.avg("away").alias("mean_distance_bps")
    )


def validate(book: DataFrame, least_levels: int = 5) -> DataFrame:
    """Snapshots with the rules that they break."""
    out = book.groupBy("snapshot").agg(
        F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("bid"),
        F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("ask"),
        F.sum((F.col("side") == "bid").cast("int")).alias("bids"),
        F.sum((F.col("side") == "ask").cast("int")).alias("asks"),
    )
    rules = {
        "no_bids": F.col("bids") == 0,
        "no_asks": F.col("asks") == 0,
        "crossed": F.col("bid") >= F.col("ask"),
        "thin": (F.col("bids") < least_levels) | (F.col("asks") < least_levels),
        "wide": F.col("ask") - F.col("bid") > F.col("ask") * 0.01,
    }
    return out.withColumn("broken", F.concat_ws(",", *(F.when(r, n) for n, r in rules.items())))


def apply_deltas(deltas: DataFrame) -> DataFrame:
    """The book after all deltas (symbol, side, price, qty, seq): the last quantity of each
    price, without those that ended at 0."""
    last = deltas.groupBy("symbol", "side", "price").agg(F.max_by("qty", "seq").alias("qty"), F.max("seq").alias("seq"))
    return last.where("qty > 0")


def reloads(snapshots: DataFrame, least: float = 3.0) -> DataFrame:
    """Iceberg score: how much levels grew by at least ``least`` between neighbouring
    snapshots (symbol, n, side, price, qty), each at most doubling."""
    before = snapshots.select("symbol", "side", "price", (F.col("n") + 1).alias("n"), F.col("qty").alias("was"))
    grown = snapshots.join(before, ["symbol", "side", "price", "n"]).where(F.col("qty") - F.col("was") >= least)
    return grown.groupBy("symbol", "n", "side").agg(
        F.sum(F.least(F.lit(1.0), (F.col("qty") - F.col("was")) / F.col("was"))).alias("score"), F.count(F.lit(1)).alias("levels")
    )


def liquidity_flow(depths: DataFrame, alert: float = 0.15) -> DataFrame:
    """Relative change of the five best levels' value from snapshot to snapshot (ordered by n)."""
    w = Window.partitionBy("symbol").orderBy("n")
    change = F.try_divide(F.col("value"), F.lag("value").over(w)) - 1
    return depths.withColumn("change", change).withColumn("alert", F.abs("change") > alert)
