"""Volume by price: profiles, value areas, nodes, shape, footprints, heat maps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import price_bins, total, window_end

KEY = ("symbol", "window_end")


def binned_profile(trades: DataFrame, width_ms: int, bins: int = 20) -> DataFrame:
    """Volume and middle price of each of ``bins`` equal price bins of a window."""
    rows = price_bins(trades, width_ms, bins).groupBy(*KEY, "bin", "lo", "hi").agg(total(F.col("q")).alias("volume"))
    return rows.select(*KEY, "bin", (F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins).alias("price"), "volume")


def point_of_control(profile: DataFrame) -> DataFrame:
    """The bin with the most volume (the lowest of equals), its price and share."""
    top = F.max_by(F.struct("price", "volume", "bin"), F.struct("volume", (-F.col("bin")).alias("b")))
    out = profile.groupBy(*KEY).agg(top.alias("x"), F.sum(F.col("volume").cast("decimal(20,8)")).cast("double").alias("volume"))
    return out.select(*KEY, F.col("x.bin").alias("poc_bin"), F.col("x.price").alias("poc"), F.try_divide("x.volume", "volume").alias("poc_share"), "volume")


def value_area_greedy(profile: DataFrame, share: float = 0.70) -> DataFrame:
    """The price range of the strongest bins that together hold ``share`` of the volume."""
    of_window = Window.partitionBy(*KEY)
    strongest = of_window.orderBy(F.desc("volume"), "bin").rowsBetween(Window.unboundedPreceding, -1)
    exact = F.col("volume").cast("decimal(20,8)")
    rows = profile.withColumns({"_all": F.sum(exact).over(of_window), "_before": F.coalesce(F.sum(exact).over(strongest), F.lit(0))})
    rows = rows.where(F.col("_before") < F.col("_all") * F.lit(share).cast("decimal(6,4)"))
    return rows.groupBy(*KEY).agg(F.max("price").alias("vah"), F.min("price").alias("val"), F.count(F.lit(1)).alias("bins"))


def value_area_expand(profile: DataFrame, share: float = 0.70, tie_up: bool = True) -> DataFrame:
    """The value area grown from the point of control bin by bin to the stronger side."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin").reset_index(drop=True)
        v = pdf["volume"].to_numpy()
        low = high = int(v.argmax())
        held, goal = v[low], v.sum() * share
        while held < goal and (low > 0 or high < len(v) - 1):
            up = v[high + 1] if high < len(v) - 1 else -1.0
            down = v[low - 1] if low > 0 else -1.0
            if up > down or (up == down and tie_up):
                high, held = high + 1, held + up
            else:
                low, held = low - 1, held + down
        row = pdf.iloc[0]
        return pd.DataFrame([(row["symbol"], row["window_end"], pdf["price"][high], pdf["price"][low])], columns=["symbol", "window_end", "vah", "val"])

    kind = dict(profile.dtypes)["symbol"]
    return profile.groupBy(*KEY).applyInPandas(grow, f"symbol {kind}, window_end bigint, vah double, val double")


def nodes(profile: DataFrame, k: float = 1.0) -> DataFrame:
    """High and low volume nodes: bins beyond ``k`` deviations from the mean of their profile."""
    w = Window.partitionBy(*KEY)
    mean, dev = F.avg("volume").over(w), F.stddev_pop("volume").over(w)
    rows = profile.withColumns({"_m": mean, "_d": dev})
    kind = F.when(F.col("volume") > F.col("_m") + F.col("_d") * k + 1e-9, "HVN").when(F.col("volume") < F.col("_m") - F.col("_d") * k - 1e-9, "LVN")
    rows = rows.withColumns({"kind": kind, "z": F.try_divide(F.col("volume") - F.col("_m"), F.col("_d"))})
    return rows.where("kind IS NOT NULL").drop("_m", "_d")


def shape(profile: DataFrame, bins: int = 20) -> DataFrame:
    """Profile shape by the thirds of the range: P (top), b (bottom), D (middle), else B."""
    third = lambda lo, hi: total(F.when((F.col("bin") >= lo) & (F.col("bin") < hi), F.col("volume")).otherwise(0))
    a, b = bins // 3, bins - bins // 3
    out = profile.groupBy(*KEY).agg(third(0, a).alias("bottom"), third(a, b).alias("middle"), third(b, bins).alias("top"))
    whole = F.col("bottom") + F.col("middle") + F.col("top")
    label = (
        F.when(F.try_divide("top", whole) > 0.45, "P").when(F.try_divide("bottom", whole) > 0.45, "b").when(F.try_divide("middle", whole) > 0.5, "D")
        .when((F.try_divide("top", whole) > 0.32) & (F.try_divide("bottom", whole) > 0.32), "B").otherwise("Thin")
    )
    return out.withColumn("shape", label)


def session_shape(trades: DataFrame, width_ms: int, least: int = 20) -> DataFrame:
    """Shape of the volume of each session: symbol, window_end, bottom, middle, top (shares of the thirds of its range), shape,
    signal and zone. Sessions of fewer than ``least`` trades or without range are left out.

    P is heavy at the top, b at the bottom, D in the middle, B at both ends. Any other is B too if its histogram has two peaks
    with a valley between them: bins are as many as fifty trades each allow (10 to 30), empty ones included; a peak is
    above both neighbours and 40 % of the fullest bin; between the first and the last peak some bin falls below half
    their mean. What is left is thin."""
    key = ["symbol", "window_end"]
    rows = trades.withColumn("window_end", window_end(F.col("t"), width_ms)).select(*key, "p", F.col("q").cast("decimal(20,8)").alias("q"))
    session = rows.groupBy(*key).agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & (F.col("hi") > F.col("lo")))
    session = session.withColumn("bins", F.greatest(F.lit(10), F.least(F.lit(30), F.floor(F.col("n") / 50))).cast("int"))
    third = (F.col("hi") - F.col("lo")) / 3
    place = F.least(F.floor((F.col("p") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("bins"))), F.col("bins") - 1).cast("int")
    part = F.when(F.col("p") <= F.col("lo") + third, "bottom").when(F.col("p") > F.col("hi") - third, "top").otherwise("middle")
    held = rows.join(session, key).withColumns({"bin": place, "part": part})
    full = held.groupBy(*key, "bin").agg(*(F.sum(F.when(F.col("part") == k, F.col("q")).otherwise(0)).alias(k) for k in ("bottom", "middle", "top")))
    dense = session.select(*key, F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"), "bins").join(full, [*key, "bin"], "left").fillna(0, ["bottom", "middle", "top"])
    line, whole = Window.partitionBy(*key).orderBy("bin"), Window.partitionBy(*key)
    v = F.col("v")
    dense = dense.withColumn("v", (F.col("bottom") + F.col("middle") + F.col("top")).cast("double"))
    peak = (v > F.lag("v").over(line)) & (v > F.lead("v").over(line)) & (v > F.max("v").over(whole) * 0.4)
    dense = dense.withColumn("peak", F.coalesce(peak, F.lit(False)))
    of_peak = F.when(F.col("peak"), F.col("bin"))
    dense = dense.withColumns({"from": F.min(of_peak).over(whole), "to": F.max(of_peak).over(whole)})
    out = dense.groupBy(*key).agg(
        *(F.sum(k).cast("double").alias(k) for k in ("bottom", "middle", "top")),
        F.min(F.when((F.col("bin") >= F.col("from")) & (F.col("bin") <= F.col("to")), v)).alias("valley"),
        F.max(F.when(F.col("bin") == F.col("from"), v)).alias("a"), F.max(F.when(F.col("bin") == F.col("to"), v)).alias("b"), F.count(F.when(F.col("peak"), 1)).alias("peaks"),
    )
    total_volume = F.col("bottom") + F.col("middle") + F.col("top")
    out = out.withColumn("_all", total_volume).where("_all > 0").withColumns({k: F.col(k) / F.col("_all") for k in ("bottom", "middle", "top")})
    bottom, middle, top = (F.col(k) for k in ("bottom", "middle", "top"))
    split = (F.col("peaks") >= 2) & (F.col("valley") < (F.col("a") + F.col("b")) / 2 * 0.5)
    both = (bottom > 0.32) & (top > 0.32) & (middle < 0.30)
    label = F.when(split, "B").when(top > 0.45, "P").when(bottom > 0.45, "b").when(middle > 0.5, "D").when(both, "B").otherwise("Thin")
    # What each shape is taken for.
    meaning = {"P": "BEARISH_AFTER", "b": "BULLISH_AFTER", "D": "RANGE", "B": "BREAKOUT_EXPECTED", "Thin": "VOLATILE"}
    signal = F.create_map(*(F.lit(x) for kv in meaning.items() for x in kv))[F.col("shape")]
    zone = F.when((top > bottom) & (top > middle), "upper").when((bottom > top) & (bottom > middle), "lower").otherwise("middle")
    return out.withColumn("shape", label).select(*key, "bottom", "middle", "top", "shape", signal.alias("signal"), zone.alias("zone"))


def poor_extremes(profile: DataFrame, bins: int = 20) -> DataFrame:
    """Whether much (poor) or little (excess) volume lies in the outer tenths of the range."""
    edge = bins // 10
    out = profile.groupBy(*KEY).agg(
        total(F.when(F.col("bin") >= bins - edge, F.col("volume")).otherwise(0)).alias("high"),
        total(F.when(F.col("bin") < edge, F.col("volume")).otherwise(0)).alias("low"),
        total(F.col("volume")).alias("volume"),
    )
    label = lambda c: F.when(F.col(c) > F.col("volume") / 10 * 0.5, "poor").when(F.col(c) < F.col("volume") / 10 * 0.2, "excess").otherwise("normal")
    return out.withColumns({"high_extreme": label("high"), "low_extreme": label("low")})


def rounded_profile(trades: DataFrame, width_ms: int, step: float = 1.0) -> DataFrame:
    """Volume by price rounded to ``step``, with single prints: prices that one trade alone touched."""
    price = F.round(F.col("p") / step) * step
    rows = trades.withColumns({"window_end": window_end(F.col("t"), width_ms), "price": price})
    out = rows.groupBy(*KEY, "price").agg(total(F.col("q")).alias("volume"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("single_print", F.col("n") == 1)


def no_mans_land(node_rows: DataFrame, least_gap: float = 0.003, k: int = 10) -> DataFrame:
    """The widest gaps between neighbouring high volume nodes of a window."""
    w = Window.partitionBy(*KEY).orderBy("price")
    rows = node_rows.where("kind = 'HVN'").withColumn("upper", F.lead("price").over(w)).withColumn("gap", F.try_divide("upper", "price") - 1)
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("gap"), "price"))
    rows = rows.where(F.col("gap") > least_gap).withColumn("rank", rank).where(F.col("rank") <= k)
    return rows.select(*KEY, F.col("price").alias("lower"), "upper", "gap", "rank")


def balance(profile: DataFrame) -> DataFrame:
    """Volume below and above the volume-weighted price, and the moments of the profile."""
    weight = F.col("price") * F.col("volume")
    mean = profile.groupBy(*KEY).agg(F.try_divide(F.sum(weight), F.sum("volume")).alias("mean"))
    rows = profile.join(mean, [*KEY])
    return rows.groupBy(*KEY, "mean").agg(
        total(F.when(F.col("price") < F.col("mean") - 1e-9, F.col("volume")).otherwise(0)).alias("below"),
        total(F.when(F.col("price") >= F.col("mean") - 1e-9, F.col("volume")).otherwise(0)).alias("above"),
        F.sqrt(F.try_divide(F.sum(F.col("volume") * F.pow(F.col("price") - F.col("mean"), 2)), F.sum("volume"))).alias("spread"),
    )


def price_level(step: float) -> Column:
    return F.floor(F.col("p") / step)


def footprint(trades: DataFrame, width_ms: int, tick: float) -> DataFrame:
    """Bought and sold volume of each price level of a bar."""
    rows = trades.withColumns({"window_end": window_end(F.col("t"), width_ms), "level": price_level(tick)})
    return rows.groupBy(*KEY, "level").agg(
        total(F.when(~F.col("m"), F.col("q")).otherwise(0)).alias("bought"),
        total(F.when(F.col("m"), F.col("q")).otherwise(0)).alias("sold"),
        F.count(F.lit(1)).alias("n"),
    )


def imbalances(levels: DataFrame, ratio: float = 3.0) -> DataFrame:
    side = F.when((F.col("bought") > 0) & (F.col("bought") >= F.col("sold") * ratio), "buy").when((F.col("sold") > 0) & (F.col("sold") >= F.col("bought") * ratio), "sell")
    return levels.withColumn("side", side).where("side IS NOT NULL")


def stacked(levels: DataFrame, least: int = 3, ratio: float = 3.0) -> DataFrame:
    """Runs of at least ``least`` neighbouring levels that are out of balance to one side."""
    rows = imbalances(levels, ratio)
    w = Window.partitionBy(*KEY, "side").orderBy("level")
    rows = rows.withColumn("_run", F.col("level") - F.row_number().over(w))
    out = rows.groupBy(*KEY, "side", "_run").agg(F.min("level").alias("low"), F.max("level").alias("high"), F.count(F.lit(1)).alias("levels"))
    return out.where(F.col("levels") >= least).drop("_run")


def liquidation_heatmap(trades: DataFrame, bucket: float) -> DataFrame:
    """Value sold out of long and of short positions by price bucket."""
    value = F.col("p") * F.col("q")
    return trades.groupBy("symbol", (F.floor(F.col("p") / bucket) * bucket).alias("price")).agg(
        total(F.when(F.col("m"), value).otherwise(0)).alias("long_value"), total(F.when(~F.col("m"), value).otherwise(0)).alias("short_value")
    )


def vwap_bands(trades: DataFrame, width_ms: int) -> DataFrame:
    """Volume-weighted price of each window with bands of one to three deviations, and the plain mean."""
    rows = trades.withColumn("window_end", window_end(F.col("t"), width_ms))
    q, pq, ppq = (total(c) for c in (F.col("q"), F.col("p") * F.col("q"), F.col("p") * F.col("p") * F.col("q")))
    out = rows.groupBy(*KEY).agg(F.try_divide(pq, q).alias("vwap"), F.try_divide(ppq, q).alias("square"), (total(F.col("p")) / F.count(F.lit(1))).alias("twap"))
    out = out.withColumn("deviation", F.sqrt(F.greatest(F.col("square") - F.col("vwap") * F.col("vwap"), F.lit(0.0))))
    bands = {f"{side}_{k}": F.col("vwap") + sign * k * F.col("deviation") for k in (1, 2, 3) for side, sign in (("upper", 1), ("lower", -1))}
    apart = F.try_divide(F.col("twap") - F.col("vwap"), "vwap") * 100
    signal = F.when(F.col("divergence") > 1, "twap_above").when(F.col("divergence") < -1, "twap_below").otherwise("aligned")
    return out.withColumns(bands).withColumn("divergence", apart).withColumn("signal", signal).drop("square")
