"""Joins in time: nearest and forward as-of, horizons, price paths, tail-aligned series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import filled, surrounding


def asof_nearest(left: DataFrame, right: DataFrame, tolerance_ms: int, by: tuple[str, ...] = ("symbol",), bucket_ms: int = 3_600_000) -> DataFrame:
    """Each left row (t) with the right row (rt, rid, value) nearest in time within the tolerance,
    ties to the earlier, then to the smaller rid. Both sides are one union; the last right row at
    or before each row and the first at or after it are carried through it (:func:`running.surrounding`),
    so no row meets more than two others, however many share a time."""
    found = F.struct(F.col("rt"), F.col("rid"), F.col("value"))
    nothing = F.lit(None).cast(right.select(found.alias("x")).schema["x"].dataType)
    rows = left.select(*by, F.col("t").alias("_t"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_less"), F.struct(*left.columns).alias("_left"), nothing.alias("_right"))
    none = F.lit(None).cast(rows.schema["_left"].dataType)
    others = right.select(*by, F.col("rt").alias("_t"), F.lit(0).alias("_kind"), (-F.col("rid")).cast("long").alias("_less"), none.alias("_left"), found.alias("_right"))
    both = rows.unionByName(others).withColumn("_back", -F.col("_t"))
    both = surrounding(both, "_right", "_before", "_after", list(by), ["_t", "_kind", "_less"], ["_back", "_kind", "_less"], bucket_ms).where("_left IS NOT NULL")
    near = lambda c: F.when(F.abs(F.col(f"{c}.rt") - F.col("_t")) <= tolerance_ms, F.struct(F.abs(F.col(f"{c}.rt") - F.col("_t")).alias("d"), f"{c}.rt", f"{c}.rid", f"{c}.value"))
    out = both.withColumn("_x", F.least(near("_before"), near("_after")))
    return out.select(*(F.col(f"_left.{c}").alias(c) for c in left.columns), F.col("_x.rid").alias("rid"), F.col("_x.rt").alias("rt"), F.col("_x.value").alias("value"))


def asof_backward(left: DataFrame, right: DataFrame, by: str = "symbol") -> DataFrame:
    """Each left row (t, id) with the value of the last right row (rt, value) at or before it:
    one union, sorted once by time within days, with the last value of earlier days carried in."""
    rows = left.select(by, "t", "id", F.lit(1).alias("seq"), F.lit(None).cast("double").alias("value"))
    others = right.select(by, F.col("rt").alias("t"), F.lit(None).cast(dict(left.dtypes)["id"]).alias("id"), F.lit(0).alias("seq"), F.col("value").cast("double"))
    out = filled(rows.unionByName(others), "value", "matched", [by], ["t", "seq"])
    return out.where("id IS NOT NULL").select(by, "t", "id", F.col("matched").alias("value"))


def horizons(signals: DataFrame, ticks: DataFrame, hours: tuple[int, ...], flat: float, span_ms: int = 86_400_000, bucket_ms: int = 3_600_000) -> DataFrame:
    """Long form: for each signal (id, symbol, t, price) and horizon the first tick at or after
    it, the change and its direction. Signals and ticks are one union that is scanned backward in
    time with the last tick seen, so a signal meets one tick; a tick later than one span after the
    horizon does not count. A price of 0 has no change."""
    wanted = signals.withColumn("h", F.explode(F.array(*(F.lit(h) for h in hours)))).withColumn("due", F.col("t") + F.col("h") * 3_600_000)
    found = F.struct(F.col("t").alias("at"), F.col("p").alias("later"))
    nothing = F.lit(None).cast(ticks.select(found.alias("x")).schema["x"].dataType)
    rows = wanted.select("symbol", (-F.col("due")).alias("_back"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_less"), F.struct("id", "symbol", "h", "due", "price").alias("_w"), nothing.alias("_tick"))
    none = F.lit(None).cast(rows.schema["_w"].dataType)
    seen = ticks.select("symbol", (-F.col("t")).alias("_back"), F.lit(0).alias("_kind"), (-F.col("seq")).cast("long").alias("_less"), none.alias("_w"), found.alias("_tick"))
    both = filled(rows.unionByName(seen), "_tick", "_next", ["symbol"], ["_back", "_kind", "_less"], bucket_ms).where("_w IS NOT NULL")
    out = both.select("_w.*", F.when(F.col("_next.at") <= F.col("_w.due") + span_ms, F.col("_next.later")).alias("later"))
    out = out.withColumn("change", F.try_divide("later", "price") - 1)
    label = F.when(F.col("change") > flat, "up").when(F.col("change") < -flat, "down").when(F.col("change").isNotNull(), "flat")
    return out.select("id", "symbol", "h", "later", "change", label.alias("direction"))


def price_path(signals: DataFrame, ticks: DataFrame, horizon_ms: int, grains: int = 32, ratio: Callable[[Column, Column], Column] = F.try_divide) -> DataFrame:
    """Most favourable and most adverse change in (t, t + horizon] after each signal.

    Ticks are first summed to grains of time, ``grains`` to a horizon: a signal meets the sums of
    the grains that lie wholly in its horizon, and single ticks only in the two at its ends. Ticks
    without a price are not counted. ``ratio`` divides by the signal's price: as it is, a price of 0 has no change."""
    width = max(1, horizon_ms // grains)
    grain = lambda c: F.floor(c / width)
    end = F.col("t") + horizon_ms
    sums = ticks.groupBy("symbol", grain(F.col("t")).alias("_g")).agg(F.max("p").alias("hi"), F.min("p").alias("lo"), F.count("p").alias("n"))
    low, high = grain(F.col("t")) + 1, grain(end + 1) - 1
    whole = signals.select("id", "symbol", F.explode(F.when(low <= high, F.sequence(low, high))).alias("_g")).join(sums, ["symbol", "_g"]).select("id", "hi", "lo", "n")
    last = F.when(((end + 1) % width != 0) & (grain(end) != grain(F.col("t"))), grain(end))
    ends = signals.select("id", "symbol", "t", F.explode(F.array_compact(F.array(grain(F.col("t")), last))).alias("_g"))
    single = ends.join(ticks.select("symbol", F.col("t").alias("at"), "p", grain(F.col("t")).alias("_g")), ["symbol", "_g"])
    single = single.where((F.col("at") > F.col("t")) & (F.col("at") <= end)).select("id", F.col("p").alias("hi"), F.col("p").alias("lo"), F.col("p").isNotNull().cast("long").alias("n"))
    path = whole.union(single).groupBy("id").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.sum("n").alias("ticks"))
    out = signals.join(path, "id", "left")
    return out.select("id", "symbol", (ratio(F.col("hi"), F.col("price")) - 1).alias("mfe"), (ratio(F.col("lo"), F.col("price")) - 1).alias("mae"), F.coalesce("ticks", F.lit(0)).alias("ticks"))


def tail_aligned(series: DataFrame, n: int) -> DataFrame:
    """The last ``n`` returns of each symbol, numbered from the end."""
    w = Window.partitionBy("symbol").orderBy("ts")
    r = series.withColumn("r", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).where("r IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    return r.withColumn("place", rank).where(F.col("place") <= n).select("symbol", "place", "r")


def correlations(series: DataFrame, n: int = 50) -> DataFrame:
    """Pearson correlation of the last ``n`` returns of every pair of symbols, aligned by place."""
    a = tail_aligned(series, n)
    b = a.select(F.col("symbol").alias("other"), "place", F.col("r").alias("s"))
    pairs = a.join(b, "place").where("symbol < other")
    return pairs.groupBy("symbol", "other").agg(F.corr("r", "s").alias("correlation"), F.count(F.lit(1)).alias("n"))


def direction_labels(candles: DataFrame, horizon: int, threshold: float) -> DataFrame:
    """Candles with the change over the next ``horizon`` rows and its label: 1, 0 or -1."""
    change = F.try_divide(F.lead("close", horizon).over(Window.partitionBy("symbol").orderBy("ts")), "close") - 1
    rows = candles.withColumn("change", change).where("change IS NOT NULL")
    return rows.withColumn("label", F.when(F.col("change") > threshold, 1).when(F.col("change") < -threshold, -1).otherwise(0))


def backtest(candles: DataFrame, entries: DataFrame, take: float, stop: float, ahead: int, fee: float = 0.0008) -> DataFrame:
    """Long entries (symbol, ts): the first of the next ``ahead`` candles that reaches the
    target or the stop (the stop first where both), else the last, and the profit after fees."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(1, ahead)
    rows = candles.withColumn("path", F.collect_list(F.struct("ts", "high", "low", "close")).over(w))
    rows = rows.join(entries.select("symbol", "ts").distinct(), ["symbol", "ts"], "left_semi").where(F.size("path") > 0)
    hit = lambda x: (x["high"] >= F.col("close") * (1 + take)) | (x["low"] <= F.col("close") * (1 - stop))
    end = F.coalesce(F.get(F.filter("path", hit), F.lit(0)), F.element_at("path", -1))
    rows = rows.withColumn("end", end)
    price = (
        F.when(F.col("end.low") <= F.col("close") * (1 - stop), F.col("close") * (1 - stop))
        .when(F.col("end.high") >= F.col("close") * (1 + take), F.col("close") * (1 + take)).otherwise(F.col("end.close"))
    )
    reason = F.when(F.col("end.low") <= F.col("close") * (1 - stop), "stop").when(F.col("end.high") >= F.col("close") * (1 + take), "target").otherwise("time")
    return rows.select("symbol", "ts", F.col("end.ts").alias("exit_ts"), reason.alias("reason"), (F.try_divide(price, "close") - 1 - fee).alias("profit"))
