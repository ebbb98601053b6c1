"""Order flow: rolling imbalance, size sectors, pressure, absorption, exhaustion, whales."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import exact, signed, total, window_end
from .running import ALWAYS, ENDED, NOTHING, OPEN, with_states

#: By how much a volume must exceed its limit, so that the order of a sum does not decide.
TOLERANCE = 1e-9


def sector(bounds: tuple[float, float] = (0.5, 1.0)) -> Column:
    return F.when(F.col("q") < bounds[0], "retail").when(F.col("q") < bounds[1], "mid").otherwise("whale")


def rolling_flow(trades: DataFrame, widths_ms: tuple[int, ...]) -> DataFrame:
    """Each trade with the net flow, volume and imbalance of the ``width`` before it, for
    every width.

    A trade enters every sum at its time and leaves that of a width so much later: a sum is one
    running sum over entries and departures, so the work does not grow with the width. These are dealt by
    symbol and the widest span of their own time; what is held where a span begins is carried into it, so a
    long history is not one task and no trade is dealt twice."""
    n = range(1, len(widths_ms) + 1)
    moves = [F.struct((F.col("t") + w).alias("at"), F.lit(i).alias("kind")) for i, w in enumerate((0, *widths_ms))]
    rows = trades.withColumn("_move", F.explode(F.array(*moves)))
    kind = F.col("_move.kind")
    part = lambda value, i: F.when(kind == 0, value).when(kind == i, -value)
    values = {f"net_{i}": part(exact(signed()), i) for i in n} | {f"volume_{i}": part(exact(F.col("q")), i) for i in n}
    rows = rows.withColumn("_bucket", F.floor(F.col("_move.at") / max(widths_ms)))
    sums = rows.groupBy("symbol", "_bucket").agg(*(F.sum(v).alias(k) for k, v in values.items()))
    before = Window.partitionBy("symbol").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("symbol", "_bucket", *(F.sum(k).over(before).alias(f"_c_{k}") for k in values))
    so_far = Window.partitionBy("symbol", "_bucket").orderBy("_move.at").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_s_{k}": F.sum(v).over(so_far) for k, v in values.items()}).where(kind == 0).join(carried, ["symbol", "_bucket"])
    zero = F.lit(0)
    rows = rows.withColumns({k: (F.coalesce(f"_c_{k}", zero) + F.coalesce(f"_s_{k}", zero)).cast("double") for k in values})
    names = [c for i in n for c in (f"net_{i}", f"volume_{i}", f"imbalance_{i}")]
    rows = rows.withColumns({f"imbalance_{i}": F.try_divide(f"net_{i}", f"volume_{i}") for i in n})
    return rows.select(*trades.columns, *names)


def sector_flow(trades: DataFrame, width_ms: int) -> DataFrame:
    """Volumes, delta and count of each size sector in each window."""
    rows = trades.withColumns({"window_end": window_end(F.col("t"), width_ms), "sector": sector()})
    return rows.groupBy("symbol", "window_end", "sector").agg(
        total(F.when(~F.col("m"), F.col("q")).otherwise(0)).alias("buy"),
        total(F.when(F.col("m"), F.col("q")).otherwise(0)).alias("sell"),
        total(signed()).alias("delta"),
        F.count(F.lit(1)).alias("n"),
    )


def participants(trades: DataFrame, width_ms: int) -> DataFrame:
    """Share, imbalance and activity of each sector within its window."""
    rows = sector_flow(trades, width_ms)
    of_window = Window.partitionBy("symbol", "window_end")
    volume = F.col("buy") + F.col("sell")
    share = F.try_divide(volume, F.sum(volume).over(of_window))
    imbalance = F.try_divide(F.col("delta"), volume)
    activity = F.abs(imbalance) * 0.4 + share * 0.4 + F.least(F.lit(1.0), F.col("n") / 10) * 0.2
    return rows.withColumns({"share": share, "imbalance": imbalance, "activity": activity})


def buy_sell_ratio(windows: DataFrame, cap: float = 10.0) -> DataFrame:
    """Windows with buy / sell volume, capped, and a pressure label."""
    ratio = F.when(F.col("sell_volume") > 0, F.least(F.lit(cap), F.col("buy_volume") / F.col("sell_volume"))).when(F.col("buy_volume") > 0, cap).otherwise(1.0)
    r = F.col("ratio")
    label = (
        F.when(r >= 3, "EXTREME_BUY").when(r >= 2, "STRONG_BUY").when(r >= 1.2, "BUY")
        .when(r > 1 / 1.2, "NEUTRAL").when(r > 0.5, "SELL").when(r > 1 / 3, "STRONG_SELL").otherwise("EXTREME_SELL")
    )
    return windows.withColumn("ratio", ratio).withColumn("pressure", label)


def absorption(windows: DataFrame, eps: float = 1.0) -> DataFrame:
    """Windows with the side that hit and the side that absorbed it: the price closed
    against the delta. The index is |delta| / volume times |imbalance|, at most 1."""
    delta = F.col("buy_volume") - F.col("sell_volume")
    place = F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5)
    out = windows.withColumns({"delta": delta, "close_place": place})
    absorbed = (
        F.when((F.col("delta") < -eps) & (F.col("close") >= F.col("open") * 0.998) & (F.col("close_place") > 0.5), "buyer")
        .when((F.col("delta") > eps) & (F.col("close") <= F.col("open") * 1.002) & (F.col("close_place") < 0.5), "seller")
    )
    share = F.try_divide(F.abs("delta"), F.col("volume"))
    index = F.least(F.lit(1.0), share) * F.least(F.lit(1.0), share)
    out = out.withColumns({"absorber_side": absorbed, "absorption_index": index})
    i = F.col("absorption_index")
    return out.withColumns(
        {
            "aggressor_side": F.when(F.col("delta") < 0, "seller").when(F.col("delta") > 0, "buyer"),
            "intensity": F.when(i >= 0.6, "STRONG").when(i >= 0.3, "MODERATE").when(i >= 0.1, "WEAK").otherwise("NONE"),
        }
    )


def _history(rows: int) -> Window:
    return Window.partitionBy("symbol").orderBy("window_end").rowsBetween(-rows, -1)


def exhaustion(windows: DataFrame, factor: float = 2.5, history: int = 100) -> DataFrame:
    """Windows whose volume exceeds ``factor`` times the mean of those before (five at least)
    while the price moved with the stronger side."""
    w = _history(history)
    mean, n = F.avg("volume").over(w), F.count("volume").over(w)
    high = (n >= 5) & (F.col("volume") > mean * factor + TOLERANCE)
    up, down = F.col("close") > F.col("open"), F.col("close") < F.col("open")
    label = (
        F.when(high & up & (F.col("buy_volume") > F.col("sell_volume")), "buy_exhaustion")
        .when(high & down & (F.col("sell_volume") > F.col("buy_volume")), "sell_exhaustion")
    )
    return windows.withColumns({"mean_volume": mean, "exhaustion": label})


def delta_threshold(windows: DataFrame, factor: float = 2.0, history: int = 100) -> DataFrame:
    """Windows with the threshold that their delta has to pass: |mean + factor * deviation|
    of the deltas before, at least 0.5; 2 until there are more than ten."""
    w = _history(history)
    delta = F.col("buy_volume") - F.col("sell_volume")
    rows = windows.withColumn("delta", delta)
    n = F.count("delta").over(w)
    level = F.greatest(F.lit(0.5), F.abs(F.avg("delta").over(w) + F.stddev_pop("delta").over(w) * factor))
    return rows.withColumn("threshold", F.when(n > 10, level).otherwise(2.0)).withColumn("passed", F.abs("delta") > F.col("threshold"))


def whale_events(trades: DataFrame, least: float) -> DataFrame:
    """Trades worth at least ``least``, with size class and rank among the symbol's trades."""
    rows = trades.withColumn("value", F.col("p") * F.col("q"))
    size = F.when(F.col("value") >= least * 10, "mega").when(F.col("value") >= least * 5, "large").otherwise("whale")
    return rows.where(F.col("value") >= least).withColumn("class", size)


def whale_pressure(trades: DataFrame, least: float, width_ms: int) -> DataFrame:
    """Counts, values, largest and score of a window's large trades."""
    rows = whale_events(trades, least).withColumn("window_end", window_end(F.col("t"), width_ms))
    out = rows.groupBy("symbol", "window_end").agg(
        F.count(F.lit(1)).alias("n"),
        total(F.when(~F.col("m"), F.col("value")).otherwise(0)).alias("bought"),
        total(F.when(F.col("m"), F.col("value")).otherwise(0)).alias("sold"),
        F.max("value").alias("largest"),
    )
    return out.withColumn("score", F.try_divide(F.col("bought") - F.col("sold"), F.col("bought") + F.col("sold")) * 100)


def large_trades(trades: DataFrame, least_q: float, width_ms: int, k: int = 20) -> DataFrame:
    """The last ``k`` distinct large trades of each window."""
    rows = trades.where(F.col("q") >= least_q).dropDuplicates(["symbol", "p", "q", "t"])
    rows = rows.withColumn("window_end", window_end(F.col("t"), width_ms))
    rank = F.row_number().over(Window.partitionBy("symbol", "window_end").orderBy(F.desc("t"), F.desc("p"), F.desc("q")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("symbol", "window_end", "rank", "p", "q", "t")


def tick_rule(trades: DataFrame, width_ms: int) -> DataFrame:
    """Sum of the signs of price moves inside each window, and trades a second."""
    rows = trades.withColumn("window_end", window_end(F.col("t"), width_ms))
    w = Window.partitionBy("symbol", "window_end").orderBy("t", "seq")
    rows = rows.withColumn("tick", F.signum(F.col("p") - F.lag("p").over(w)))
    return rows.groupBy("symbol", "window_end").agg(F.coalesce(F.sum("tick"), F.lit(0.0)).alias("tick_sum"), F.count(F.lit(1)).alias("n"))


def passive_aggressive(windows: DataFrame) -> DataFrame:
    """Windows with the share of aggressive buying and a label of who leads."""
    share = F.try_divide(F.col("buy_volume"), F.col("buy_volume") + F.col("sell_volume"))
    lead = F.when(F.col("buy_share") > 0.55, "buyers").when(F.col("buy_share") < 0.45, "sellers").otherwise("balanced")
    return windows.withColumn("buy_share", share).withColumn("lead", lead)


def bursts(trades: DataFrame, width_ms: int, threshold: float, end_ratio: float = 0.5, cooldown_ms: int = 200, chunk_ms: int = 86_400_000) -> DataFrame:
    """Bursts: the volume of the last ``width_ms`` reaches ``threshold``; one ends below
    ``end_ratio`` of it and the next starts after the cooldown. A burst that never ends is not given.

    Volumes of the last ``width_ms`` are summed in chunks of time that also hold a copy of the
    rows just before. Each chunk then says what it makes of a burst that is open, or ended at any time,
    where it begins (:func:`running.with_states`), and is folded from its true state, so bursts and
    cooldowns run on over the borders of chunks."""
    kind = dict(trades.dtypes)["symbol"]
    own = F.floor(F.col("t") / chunk_ms)
    reach = F.floor((F.col("t") + width_ms - 1) / chunk_ms)
    rows = trades.select("symbol", F.explode(F.sequence(own, reach)).alias("chunk"), "t", "seq", "q", own.alias("own"))

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "seq"])
        times, sizes = pdf["t"].to_numpy(), pdf["q"].to_numpy()
        volumes, first, volume = np.empty(len(pdf)), 0, 0.0
        for i, t in enumerate(times):
            volume += sizes[i]
            while t - times[first] >= width_ms:
                volume -= sizes[first]
                first += 1
            volumes[i] = volume
        return pdf.assign(volume=volumes)[pdf["own"] == pdf["chunk"]][["symbol", "chunk", "t", "seq", "volume"]]

    rows = rows.groupBy("symbol", "chunk").applyInPandas(sums, f"symbol {kind}, chunk bigint, t bigint, seq bigint, volume double")

    def summarise(pdf: pd.DataFrame) -> list[tuple[int, int, int, int]]:
        t, v = pdf["t"].to_numpy(), pdf["volume"].to_numpy()
        hot, cold = np.flatnonzero(v >= threshold), np.flatnonzero(v < threshold * end_ratio)

        def ended(i: int) -> tuple[int, int]:
            """The state at the end if a burst ends at trade i."""
            at = np.searchsorted(hot, max(i + 1, np.searchsorted(t, t[i] + cooldown_ms)))
            return last[at] if at < len(hot) else (ENDED, int(t[i]))

        last: list[tuple[int, int]] = [(NOTHING, 0)] * len(hot)  # the state at the end if a burst starts at the h-th hot trade
        for h in range(len(hot) - 1, -1, -1):
            at = np.searchsorted(cold, hot[h] + 1)
            last[h] = ended(cold[at]) if at < len(cold) else (OPEN, int(t[hot[h]]))
        return [
            *((NOTHING, ALWAYS, *x) for x in last[:1]),
            *((OPEN, ALWAYS, *ended(i)) for i in cold[:1]),
            *((ENDED, int(t[i]) - cooldown_ms, *x) for i, x in zip(hot, last, strict=True)),
        ]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "seq"])
        state, since = int(pdf["_state"].iloc[0]), int(pdf["_since"].iloc[0])
        out, start, ended, peak = [], since if state == OPEN else None, since if state == ENDED else None, 0.0
        for t, volume in zip(pdf["t"], pdf["volume"], strict=True):
            if start is None and volume >= threshold and (ended is None or t - ended >= cooldown_ms):
                start, peak = t, volume
            elif start is not None:
                peak = max(peak, volume)
                if volume < threshold * end_ratio:
                    out.append((pdf["symbol"].iloc[0], start, t, peak))
                    start, ended = None, t
        if start is not None:
            out.append((pdf["symbol"].iloc[0], start, None, peak))
        return pd.DataFrame(out, columns=["symbol", "start_t", "end_t", "peak"]).astype({"end_t": "Int64"})

    pieces = with_states(rows, summarise).groupBy("symbol", "chunk").applyInPandas(fold, f"symbol {kind}, start_t bigint, end_t bigint, peak double")
    return pieces.groupBy("symbol", "start_t").agg(F.max("end_t").alias("end_t"), F.max("peak").alias("peak")).where("end_t IS NOT NULL")
