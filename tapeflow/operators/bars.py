"""Trades to windows: prices, volumes, deltas, speed, dwell, and event-anchored bars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import ALWAYS, NOTHING, OPEN, filled, running_sum, with_states


def order() -> Column:
    return F.struct("t", "seq")



def window_end(time: Column, width_ms: int) -> Column:
    """End of the epoch-aligned window [end - width, end) around a time."""
    return (F.floor(time / width_ms) + 1) * width_ms


def signed(name: str = "q") -> Column:
    return F.when(F.col("m"), -F.col(name)).otherwise(F.col(name))


def exact(column: Column) -> Column:
    """Sums of this are exact and so the same in any order."""
    return column.cast("decimal(20,8)")


def total(column: Column) -> Column:
    return F.sum(exact(column)).cast("double")


def ohlcv(trades: DataFrame, width_ms: int) -> DataFrame:
    """Open, high, low, close, volume, vwap and the two volumes of each symbol and window."""
    rows = trades.withColumn("window_end", window_end(F.col("t"), width_ms))
    return rows.groupBy("symbol", "window_end").agg(
        F.min_by("p", order()).alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", order()).alias("close"),
        total(F.col("q")).alias("volume"),
        total(F.when(~F.col("m"), F.col("q")).otherwise(0)).alias("buy_volume"),
        total(F.when(F.col("m"), F.col("q")).otherwise(0)).alias("sell_volume"),
        F.try_divide(total(F.col("p") * F.col("q")), total(F.col("q"))).alias("vwap"),
        F.count(F.lit(1)).alias("n"),
        F.min("t").alias("open_t"),
        F.max("t").alias("close_t"),
    )


def intra_delta(trades: DataFrame, width_ms: int) -> DataFrame:
    """Least, greatest and last running delta inside each window, and the reversals from them."""
    rows = trades.withColumn("window_end", window_end(F.col("t"), width_ms))
    w = Window.partitionBy("symbol", "window_end").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("d", F.sum(exact(signed())).over(w))
    out = rows.groupBy("symbol", "window_end").agg(
        F.min("d").alias("delta_min"), F.max("d").alias("delta_max"), F.max_by("d", order()).alias("delta_close")
    )
    out = out.select("symbol", "window_end", *(F.col(c).cast("double").alias(c) for c in ("delta_min", "delta_max", "delta_close")))
    return out.withColumns({"from_min": F.col("delta_close") - F.col("delta_min"), "from_max": F.col("delta_max") - F.col("delta_close")})


def trade_speed(trades: DataFrame, width_ms: int) -> DataFrame:
    """Trades a second and mean size of each window; 0 with fewer than two trades."""
    rows = trades.withColumn("window_end", window_end(F.col("t"), width_ms))
    out = rows.groupBy("symbol", "window_end").agg(
        F.count(F.lit(1)).alias("n"), ((F.max("t") - F.min("t")) / 1000).alias("seconds"), total(F.col("q")).alias("volume")
    )
    many = (F.col("n") >= 2) & (F.col("seconds") > 0)
    return out.select(
        "symbol",
        "window_end",
        "n",
        F.when(many, F.col("n") / F.col("seconds")).otherwise(0.0).alias("per_second"),
        F.when(F.col("n") >= 2, F.col("volume") / F.col("n")).otherwise(0.0).alias("mean_size"),
    )


def price_bins(trades: DataFrame, width_ms: int, bins: int) -> DataFrame:
    """Trades with the bin of their price between the least and greatest of their window."""
    rows = trades.withColumn("window_end", window_end(F.col("t"), width_ms))
    ends = rows.groupBy("symbol", "window_end").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    rows = rows.join(ends, ["symbol", "window_end"])
    place = F.floor((F.col("p") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))
    return rows.withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(place, F.lit(bins - 1))).otherwise(0).cast("bigint"))


def dwell(trades: DataFrame, width_ms: int, bins: int = 20) -> DataFrame:
    """The price bin of each window between whose first and last trade most time passed."""
    times = price_bins(trades, width_ms, bins).groupBy("symbol", "window_end", "bin", "lo", "hi").agg(
        (F.max("t") - F.min("t")).alias("dwell_ms"), F.count(F.lit(1)).alias("n")
    )
    top = times.groupBy("symbol", "window_end").agg(F.max(F.struct("dwell_ms", (-F.col("bin")).alias("b"), "n", "lo", "hi")).alias("x"))
    place = (-F.col("x.b") + 0.5) / bins
    return top.select(
        "symbol",
        "window_end",
        (-F.col("x.b")).alias("bin"),
        F.col("x.dwell_ms").alias("dwell_ms"),
        F.col("x.n").alias("n"),
        F.when(place >= 0.8, "High").when(place <= 0.2, "Low").otherwise("Mid").alias("location"),
    )


def cvd(trades: DataFrame) -> DataFrame:
    """Trades with the cumulative volume delta since the symbol's first trade."""
    return running_sum(trades, exact(signed()), "cvd", ["symbol"], ["t", "seq"]).withColumn("cvd", F.col("cvd").cast("double"))


def cvd_reset(trades: DataFrame, reset_ms: int) -> DataFrame:
    """As :func:`cvd`, from 0 again at every multiple of ``reset_ms``."""
    w = Window.partitionBy("symbol", F.floor(F.col("t") / reset_ms)).orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return trades.withColumn("cvd", F.sum(exact(signed())).over(w).cast("double"))


def anchored(trades: DataFrame, width_ms: int, chunk_ms: int = 86_400_000) -> DataFrame:
    """Trades with the time at which their bar opened (``bar``) or, of a trade that closes a bar and is in none, of the bar
    that it closes (``closes``). A bar opens with the first trade after the one that closed the bar before, and is
    closed by the first trade at least ``width_ms`` later.

    Where a bar opens depends on all bars before. Each chunk of time first says which bar is open at
    its end for any bar open where it begins (:func:`running.with_states`), then is folded from its
    true state, so bars run on over the borders of chunks; a group is bounded by a symbol's chunk.
    """

    def summarise(pdf: pd.DataFrame) -> list[tuple[int, int, int, int]]:
        t = pdf["t"].to_numpy()
        closes = np.searchsorted(t, t + width_ms)
        last: list[tuple[int, int]] = [(NOTHING, 0)] * (len(t) + 2)  # the state at the end if a bar opens at trade i
        for i in range(len(t) - 1, -1, -1):
            last[i] = (OPEN, int(t[i])) if closes[i] == len(t) else last[closes[i] + 1]
        first = int(np.searchsorted(t, t[0] + width_ms))
        return [(NOTHING, ALWAYS, *last[0]), *((OPEN, int(t[c]) - width_ms, *last[c + 1]) for c in range(min(first + 1, len(t))))]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "seq"])
        t, at = pdf["t"].to_numpy(), 0
        bar, closes = np.zeros(len(t), np.int64), np.zeros(len(t), bool)
        start = int(pdf["_since"].iloc[0]) if pdf["_state"].iloc[0] == OPEN else None
        while at < len(t):
            # A bar takes all trades up to the one that closes it: one step a bar.
            start = int(t[at]) if start is None else start
            end = max(at, int(np.searchsorted(t, start + width_ms)))
            bar[at : end + 1] = start
            if end < len(t):
                closes[end] = True
                start = None
            at = end + 1
        own = pd.array(bar, "Int64")
        pdf = pdf.assign(bar=own, closes=own)
        pdf.loc[closes, "bar"] = pd.NA
        pdf.loc[~closes, "closes"] = pd.NA
        return pdf[["symbol", "bar", "closes", "p", "q", "t", "m", "seq"]]

    rows = with_states(trades.withColumn("chunk", F.floor(F.col("t") / chunk_ms)), summarise)
    kind = dict(trades.dtypes)["symbol"]
    schema = f"symbol {kind}, bar bigint, closes bigint, p double, q double, t bigint, m boolean, seq bigint"
    return rows.groupBy("symbol", "chunk").applyInPandas(fold, schema)


def cooled(alerts: DataFrame, cooldown_ms: int, chunk_ms: int = 86_400_000) -> DataFrame:
    """Alerts (symbol, t, seq, ...) without those that come within the cooldown after one that was kept. What is kept depends
    on all before: chunks of time are followed as in :func:`anchored`."""

    def summarise(pdf: pd.DataFrame) -> list[tuple[int, int, int, int]]:
        t = pdf["t"].to_numpy()
        following, last = np.searchsorted(t, t + cooldown_ms), [(NOTHING, 0)] * (len(t) + 1)
        for i in range(len(t) - 1, -1, -1):
            last[i] = (OPEN, int(t[i])) if following[i] == len(t) else last[following[i]]
        return [(NOTHING, ALWAYS, *last[0]), *((OPEN, int(t[c]) - cooldown_ms, *last[c]) for c in range(len(t)))]

    names = alerts.columns

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "seq"])
        t, kept = pdf["t"].to_numpy(), []
        at = int(np.searchsorted(t, pdf["_since"].iloc[0] + cooldown_ms)) if pdf["_state"].iloc[0] == OPEN else 0
        while at < len(t):
            kept.append(at)
            at = max(at + 1, int(np.searchsorted(t, t[at] + cooldown_ms)))
        return pdf.iloc[kept][names]

    rows = with_states(alerts.withColumn("chunk", F.floor(F.col("t") / chunk_ms)), summarise)
    return rows.groupBy("symbol", "chunk").applyInPandas(fold, alerts.schema)


def imbalance_bars(trades: DataFrame, width_ms: int) -> DataFrame:
    """Closed bars of bought and sold volume: symbol, t (opening), seq (of the opening trade), buy_volume, sell_volume, buys, sells,
    open, close, price_change (percent; from a price of 0 infinite, or NaN if it stays there), ratio (null where only one side traded), effective, dominant and severity.

    A bar opens with the first trade after the one that closed the bar before, and that closing trade's volume counts in
    it. A bar that no trade has closed yet is not given out. ``effective`` is the larger of the ratio and its inverse, 100 where
    one side is missing; from 2, 3 and 5 on it is moderate, strong and extreme."""
    rows = anchored(trades, width_ms)
    closed = rows.where("closes IS NOT NULL").select("symbol", F.col("closes").alias("bar")).distinct()
    # A closing trade belongs to the bar that the next trade opens: the first opening after it.
    rows = rows.withColumns({"_opens": F.when(F.col("closes").isNull(), F.struct("bar", "seq")), "_back": -F.col("t"), "_less": -F.col("seq")})
    rows = filled(rows, "_opens", "_next", ["symbol"], ["_back", "_less"])
    rows = rows.withColumn("bar", F.coalesce("bar", "_next.bar")).where("bar IS NOT NULL")
    bought = F.when(~F.col("m"), F.col("q")).otherwise(0)
    sold = F.when(F.col("m"), F.col("q")).otherwise(0)
    first = F.when(F.col("closes").isNull(), order())
    bars = rows.groupBy("symbol", "bar").agg(
        F.min_by("seq", first).alias("seq"), total(bought).alias("buy_volume"), total(sold).alias("sell_volume"), F.count(F.when(~F.col("m"), 1)).alias("buys"), F.count(F.when(F.col("m"), 1)).alias("sells"),
        F.min_by("p", first).alias("open"), F.max_by("p", order()).alias("close"),
    ).join(closed, ["symbol", "bar"])
    b, s = F.col("buy_volume"), F.col("sell_volume")
    ratio = F.when((b > 0) & (s > 0), b / s).when((b <= 0) & (s <= 0), 1.0)
    effective = F.coalesce(F.greatest(F.col("ratio"), 1 / F.col("ratio")), F.lit(100.0))
    severity = F.when(F.col("effective") >= 5, "extreme").when(F.col("effective") >= 3, "strong").when(F.col("effective") >= 2, "moderate")
    moved = F.col("close") - F.col("open")
    change = F.coalesce(F.try_divide(moved, "open") * 100, F.when(F.col("open") == 0, F.when(moved == 0, float("nan")).otherwise(F.signum(moved) * float("inf"))))
    out = bars.withColumnRenamed("bar", "t").withColumns({"price_change": change, "ratio": ratio})
    out = out.withColumn("effective", effective).withColumn("dominant", F.when(b > s, "buy").when(s > b, "sell").otherwise("unknown"))
    return out.withColumn("severity", severity)


def chained_windows(trades: DataFrame, width_ms: int) -> DataFrame:
    """Windows that follow one another without a gap: symbol, ts (opening), end, high, low, volume, buy_volume, sell_volume, n.

    A window is closed by the first trade at least ``width_ms`` after it opened, which still counts in it; the next one opens at
    that trade's time and price. The last window of a symbol, which no trade has closed, is not given out."""
    ends = cooled(trades.select("symbol", "t", "seq", "p"), width_ms)
    before = Window.partitionBy("symbol").orderBy("t", "seq")
    # Each trade that closes a window with the one before it, which opened that window; the first trade only opens.
    ends = ends.withColumn("_open", F.lag(F.struct("t", "p")).over(before)).where("_open IS NOT NULL").select("symbol", "seq", "_open")
    rows = trades.join(ends, ["symbol", "seq"], "left").withColumns({"_end": F.when(F.col("_open").isNotNull(), F.struct("t", "seq", "_open")), "_back": -F.col("t"), "_less": -F.col("seq")})
    rows = filled(rows, "_end", "_of", ["symbol"], ["_back", "_less"]).where("_of IS NOT NULL")
    side = lambda sold: total(F.when(F.col("m") == sold, F.col("q")).otherwise(0))
    out = rows.groupBy("symbol", F.col("_of.seq").alias("seq")).agg(
        F.first("_of._open.t").alias("ts"), F.first("_of.t").alias("end"), F.greatest(F.max("p"), F.first("_of._open.p")).alias("high"), F.least(F.min("p"), F.first("_of._open.p")).alias("low"),
        total(F.col("q")).alias("volume"), side(False).alias("buy_volume"), side(True).alias("sell_volume"), F.count(F.lit(1)).alias("n"),
    )
    return out.drop("seq")


def anchored_bars(trades: DataFrame, width_ms: int, chunk_ms: int = 86_400_000) -> DataFrame:
    """Bars that open with the first trade after the one before closed and close with the
    first trade at least ``width_ms`` later, which belongs to no bar (:func:`anchored`)."""
    kept = anchored(trades, width_ms, chunk_ms).where("bar IS NOT NULL")
    bars = kept.groupBy("symbol", "bar").agg(
        F.min("t").alias("open_t"),
        F.min_by("p", order()).alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", order()).alias("close"),
        F.sum(exact(signed())).alias("d"),
        F.count(F.lit(1)).alias("n"),
    )
    out = running_sum(bars, F.col("d"), "cumulative_delta", ["symbol"], ["open_t", "bar"], 30 * chunk_ms)
    return out.withColumns({"delta": F.col("d").cast("double"), "cumulative_delta": F.col("cumulative_delta").cast("double")}).drop("d", "bar")
