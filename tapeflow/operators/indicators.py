"""Indicators over candles: averages, oscillators, trend, volatility, channels, patterns, structure."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .running import DAY_MS, affine, numbered, previous


def over(rows: int, ahead: int = 0) -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts").rowsBetween(-rows + 1, ahead)


def line() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def full(column: Column, n: int, counted: str = "close") -> Column:
    """The column where the frame of ``n`` rows is complete, else null."""
    return F.when(F.count(counted).over(over(n)) >= n, column)


def bollinger(candles: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    mean, dev = F.avg("close").over(over(n)), F.stddev_samp("close").over(over(n))
    out = candles.withColumns({"sma": full(mean, n), "_dev": full(dev, n)})
    out = out.withColumns({"upper": F.col("sma") + F.col("_dev") * k, "lower": F.col("sma") - F.col("_dev") * k})
    return out.withColumn("percent_b", F.try_divide(F.col("close") - F.col("lower"), F.col("upper") - F.col("lower"))).drop("_dev")


def rsi(candles: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength by plain means of the last ``n`` gains and losses."""
    move = F.col("close") - F.lag("close").over(line())
    rows = candles.withColumn("_d", move)
    gain, loss = F.avg(F.greatest("_d", F.lit(0.0))).over(over(n)), F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(over(n))
    rows = rows.withColumns({"_g": gain, "_l": loss, "_n": F.count("_d").over(over(n))})
    value = F.when(F.col("_l") > 0, 100 - 100 / (1 + F.col("_g") / F.col("_l"))).when(F.col("_g") > 0, 100.0).otherwise(50.0)
    return rows.withColumn("rsi", F.when(F.col("_n") >= n, value)).drop("_d", "_g", "_l", "_n")


def true_range() -> Column:
    before = F.lag("close").over(line())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(candles: DataFrame, n: int = 14) -> DataFrame:
    rows = candles.withColumn("tr", true_range())
    return rows.withColumn("atr", full(F.avg("tr").over(over(n)), n))


def adx(candles: DataFrame, n: int = 14) -> DataFrame:
    up, down = F.col("high") - F.lag("high").over(line()), F.lag("low").over(line()) - F.col("low")
    rows = candles.withColumns({"_up": up, "_down": down, "_tr": true_range()})
    rows = rows.withColumns(
        {
            "_plus": F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0),
            "_minus": F.when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).otherwise(0.0),
        }
    )
    s = lambda c: F.sum(c).over(over(n))
    rows = rows.withColumns({"plus_di": full(F.try_divide(s("_plus"), s("_tr")) * 100, n), "minus_di": full(F.try_divide(s("_minus"), s("_tr")) * 100, n)})
    dx = F.try_divide(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")) * 100
    rows = rows.withColumn("_dx", dx)
    rows = rows.withColumn("adx", F.when(F.count("_dx").over(over(n)) >= n, F.avg("_dx").over(over(n))))
    return rows.drop("_up", "_down", "_tr", "_plus", "_minus", "_dx")


def stochastic(candles: DataFrame, n: int = 14, d: int = 3) -> DataFrame:
    low, high = F.min("low").over(over(n)), F.max("high").over(over(n))
    rows = candles.withColumn("k", full(F.try_divide(F.col("close") - low, high - low) * 100, n))
    return rows.withColumn("d", F.when(F.count("k").over(over(d)) >= d, F.avg("k").over(over(d))))


def williams(candles: DataFrame, n: int = 14) -> DataFrame:
    low, high = F.min("low").over(over(n)), F.max("high").over(over(n))
    return candles.withColumn("williams_r", F.coalesce(full(F.try_divide(high - F.col("close"), high - low) * -100, n), F.lit(-50.0)))


def cci(candles: DataFrame, n: int = 20) -> DataFrame:
    rows = candles.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    rows = rows.withColumns({"_m": F.avg("_tp").over(over(n)), "_all": F.collect_list("_tp").over(over(n))})
    apart = F.aggregate("_all", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m"))) / F.size("_all")
    return rows.withColumn("cci", full(F.try_divide(F.col("_tp") - F.col("_m"), apart * 0.015), n)).drop("_tp", "_m", "_all")


def realized_volatility(candles: DataFrame, n: int = 20) -> DataFrame:
    rows = candles.withColumn("_r", F.ln(F.try_divide(F.col("close"), F.lag("close").over(line()))))
    scaled = F.stddev_pop("_r").over(over(n)) * float(np.sqrt(n))
    return rows.withColumn("vol_scaled", F.when(F.count("_r").over(over(n)) >= n, scaled)).drop("_r")


def mean_reversion(candles: DataFrame, n: int = 20) -> DataFrame:
    mean, dev = F.avg("close").over(over(n)), F.stddev_pop("close").over(over(n))
    rows = candles.withColumn("z", full(F.try_divide(F.col("close") - mean, dev), n))
    state = F.when(F.abs("z") >= 2, "extended").when(F.abs("z") >= 1, "stretched").when(F.col("z").isNotNull(), "near")
    return rows.withColumn("state", state)


def regression_channel(candles: DataFrame, n: int = 50) -> DataFrame:
    """Least-squares line through the last ``n`` closes, its residual deviation and the close's place."""
    rows = candles.withColumn("_x", F.row_number().over(line()).cast("double"))
    x, y = F.col("_x"), F.col("close")
    w = over(n)
    slope = F.covar_pop(y, x).over(w) / F.var_pop(x).over(w)
    rows = rows.withColumns({"slope": full(slope, n), "_mx": F.avg(x).over(w), "_my": F.avg(y).over(w), "_vx": F.var_pop(x).over(w), "_vy": F.var_pop(y).over(w)})
    rows = rows.withColumn("middle", F.col("_my") + F.col("slope") * (x - F.col("_mx")))
    rows = rows.withColumn("deviation", F.sqrt(F.greatest(F.col("_vy") - F.pow("slope", F.lit(2)) * F.col("_vx"), F.lit(0.0))))
    return rows.withColumn("place", F.try_divide(y - F.col("middle"), F.col("deviation"))).drop("_x", "_mx", "_my", "_vx", "_vy")


def price_features(candles: DataFrame, windows: tuple[int, ...] = (1, 5, 15)) -> DataFrame:
    out = candles
    for n in windows:
        out = out.withColumn(f"return_{n}", F.try_divide(F.col("close"), F.lag("close", n).over(line())) - 1)
    return out.withColumn("volume_ratio", F.least(F.lit(5.0), F.try_divide(F.col("volume"), F.avg("volume").over(over(20)))))


def patterns(candles: DataFrame) -> DataFrame:
    """Candles with the names of the candlestick patterns that end on them."""
    c = {i: {k: F.lag(k, i).over(line()) if i else F.col(k) for k in ("open", "high", "low", "close")} for i in (0, 1, 2)}
    body = {i: F.abs(x["close"] - x["open"]) for i, x in c.items()}
    size = {i: x["high"] - x["low"] for i, x in c.items()}
    up, down = ({i: op(x) for i, x in c.items()} for op in (lambda x: x["close"] > x["open"], lambda x: x["close"] < x["open"]))
    upper = c[0]["high"] - F.greatest("open", "close")
    lower = F.least("open", "close") - c[0]["low"]
    middle = (c[2]["open"] + c[2]["close"]) / 2
    # The ten patterns and their proportions.
    rules = {
        "doji": (size[0] > 0) & (body[0] <= size[0] * 0.1),
        "hammer": (lower >= body[0] * 2) & (upper <= body[0] * 0.5) & (body[0] > 0),
        "shooting_star": (upper >= body[0] * 2) & (lower <= body[0] * 0.5) & (body[0] > 0),
        "pin_bar": (size[0] > 0) & (F.greatest(upper, lower) >= size[0] * 0.66) & (body[0] > 0),
        "bullish_engulfing": down[1] & up[0] & (c[0]["open"] <= c[1]["close"]) & (c[0]["close"] >= c[1]["open"]),
        "bearish_engulfing": up[1] & down[0] & (c[0]["open"] >= c[1]["close"]) & (c[0]["close"] <= c[1]["open"]),
        "morning_star": down[2] & (body[1] <= body[2] * 0.3) & up[0] & (c[0]["close"] > middle),
        "evening_star": up[2] & (body[1] <= body[2] * 0.3) & down[0] & (c[0]["close"] < middle),
        "three_soldiers": up[2] & up[1] & up[0] & (c[0]["close"] > c[1]["close"]) & (c[1]["close"] > c[2]["close"]),
        "three_crows": down[2] & down[1] & down[0] & (c[0]["close"] < c[1]["close"]) & (c[1]["close"] < c[2]["close"]),
    }
    return candles.withColumn("patterns", F.concat_ws(",", *(F.when(rule, name) for name, rule in rules.items())))


def fair_value_gaps(candles: DataFrame, least: float = 0.0005) -> DataFrame:
    """Gaps that the candle two before and the current leave between them."""
    rows = candles.withColumns({"_h": F.lag("high", 2).over(line()), "_l": F.lag("low", 2).over(line())})
    kind = F.when(F.col("low") > F.col("_h") * (1 + least), "bullish").when(F.col("high") < F.col("_l") * (1 - least), "bearish")
    rows = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    up = F.col("kind") == "bullish"
    return rows.select(
        "symbol", "ts", "kind", F.when(up, F.col("_h")).otherwise(F.col("high")).alias("bottom"), F.when(up, F.col("low")).otherwise(F.col("_l")).alias("top")
    )


def gap_fills(gaps: DataFrame, candles: DataFrame, horizon_ms: int) -> DataFrame:
    """When within the horizon later candles first covered half of each gap. Both sides are dealt
    by symbol and span of time, so a candle meets only the gaps that it can fill."""
    g = gaps.withColumn("_span", F.explode(F.sequence(F.floor(F.col("ts") / horizon_ms), F.floor((F.col("ts") + horizon_ms) / horizon_ms))))
    c = candles.select("symbol", F.col("ts").alias("at"), "high", "low", F.floor(F.col("ts") / horizon_ms).alias("_span"))
    hit = g.join(c, ["symbol", "_span"]).where("at > ts AND at <= ts + " + str(horizon_ms))
    covered = (F.least("high", "top") - F.greatest("low", "bottom")) / (F.col("top") - F.col("bottom"))
    first = hit.where(covered >= 0.5).groupBy("symbol", "ts").agg(F.min("at").alias("filled_at"))
    return gaps.join(first, ["symbol", "ts"], "left")


def swings(candles: DataFrame, k: int = 3) -> DataFrame:
    """Candles whose high (low) is the greatest (least) of the ``k`` before and after."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-k, k)
    rows = candles.withColumns({"_hi": F.max("high").over(w), "_lo": F.min("low").over(w), "_n": F.count("high").over(w)})
    full_frame = F.col("_n") == 2 * k + 1
    rows = rows.withColumns({"is_high": full_frame & (F.col("high") == F.col("_hi")), "is_low": full_frame & (F.col("low") == F.col("_lo"))})
    kinds = F.array_compact(F.array(F.when(F.col("is_high"), F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"))), F.when(F.col("is_low"), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price")))))
    return rows.select("symbol", "ts", F.explode(kinds).alias("x")).select("symbol", "ts", "x.kind", "x.price")


def structure_breaks(swing_rows: DataFrame) -> DataFrame:
    """Swings with the label against the one before of their kind (HH, LH, HL, LL) and whether
    they break the structure: a higher high or a lower low."""
    before = F.lag("price").over(Window.partitionBy("symbol", "kind").orderBy("ts"))
    rows = swing_rows.withColumn("before", before).where("before IS NOT NULL")
    above = F.col("price") > F.col("before")
    label = F.when(F.col("kind") == "high", F.when(above, "HH").otherwise("LH")).otherwise(F.when(above, "HL").otherwise("LL"))
    return rows.withColumn("label", label).withColumn("breaks", F.col("label").isin("HH", "LL"))


def order_blocks(candles: DataFrame, factor: float = 1.5, share: float = 0.6) -> DataFrame:
    """Candles followed by an opposite one of ``factor`` times their body that is mostly body."""
    nxt = {k: F.lead(k).over(line()) for k in ("open", "high", "low", "close")}
    rows = candles.withColumns({f"_{k}": v for k, v in nxt.items()})
    body, after = F.abs(F.col("close") - F.col("open")), F.abs(F.col("_close") - F.col("_open"))
    strong = (after > body * factor) & (after >= (F.col("_high") - F.col("_low")) * share)
    kind = F.when(strong & (F.col("close") < F.col("open")) & (F.col("_close") > F.col("_open")), "bullish").when(
        strong & (F.col("close") > F.col("open")) & (F.col("_close") < F.col("_open")), "bearish"
    )
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select("symbol", "ts", "kind", "low", "high")


def sweeps(candles: DataFrame, n: int = 10) -> DataFrame:
    """Candles whose wick passes the extreme of the ``n`` before and whose close comes back."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-n, -1)
    rows = candles.withColumns({"_hi": F.max("high").over(w), "_lo": F.min("low").over(w), "_n": F.count("high").over(w)}).where(F.col("_n") == n)
    kind = F.when((F.col("high") > F.col("_hi")) & (F.col("close") < F.col("_hi")), "high").when((F.col("low") < F.col("_lo")) & (F.col("close") > F.col("_lo")), "low")
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select("symbol", "ts", "kind", F.when(F.col("kind") == "high", F.col("_hi")).otherwise(F.col("_lo")).alias("level"))


def fibonacci(candles: DataFrame, n: int = 50) -> DataFrame:
    """Retracement levels between the extremes of the last ``n`` candles."""
    hi, lo = F.max("high").over(over(n)), F.min("low").over(over(n))
    # The five ratios.
    ratios = {"fib_236": 0.236, "fib_382": 0.382, "fib_500": 0.5, "fib_618": 0.618, "fib_786": 0.786}
    return candles.withColumns({k: hi - (hi - lo) * r for k, r in ratios.items()})


def fold(df: DataFrame, step, schema: str, by: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """An order-dependent recurrence: ``step`` gets a group sorted by ``order`` as pandas."""
    return df.groupBy(*by).applyInPandas(lambda pdf: step(pdf.sort_values(list(order))), schema)


#: Candles that a recursive indicator scans at once, in time.
SCAN_MS = 365 * DAY_MS


def smoothed(candles: DataFrame, n: int = 14) -> DataFrame:
    """The recursive indicators: Wilder's RSI, MACD with its signal, EMA 21 and ATR, as scans over buckets of time
    (:func:`running.affine`), so that a symbol's history is no single task."""
    by, order = ["symbol"], ["ts"]
    rows = previous(candles, "close", "_before", by, order, SCAN_MS)
    move = F.col("close") - F.col("_before")
    reach = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_before")), F.abs(F.col("low") - F.col("_before")))
    rows = numbered(rows.withColumns({"_d": move, "_tr": reach}), "_n", by, order, SCAN_MS)
    first, second = F.col("_n") == 1, F.col("_n") == 2

    def mean(x, weight: float, begins):
        return F.when(begins, 0.0).otherwise(1 - weight), F.when(begins, x).otherwise(x * weight)

    maps = {
        "_gain": mean(F.when(second | F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0))), 1 / n, second),
        "_loss": mean(F.when(second | F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0))), 1 / n, second),
        "_fast": mean(F.col("close"), 2 / 13, first),
        "_slow": mean(F.col("close"), 2 / 27, first),
        "ema_21": mean(F.col("close"), 2 / 22, first),
        "_atr": mean(F.col("_tr"), 2 / (n + 1), first),
    }
    rows = affine(rows, maps, by, order, SCAN_MS).withColumn("macd", F.col("_fast") - F.col("_slow"))
    rows = affine(rows, {"macd_signal": mean(F.col("macd"), 0.2, first)}, by, order, SCAN_MS)
    wilder = F.when(F.col("_n") > n, F.when(F.col("_loss") > 0, 100 - 100 / (1 + F.col("_gain") / F.col("_loss"))).otherwise(100.0))
    atr = F.when(F.col("_n") >= n, F.col("_atr"))
    return rows.select("symbol", "ts", wilder.alias("rsi_wilder"), "macd", "macd_signal", "ema_21", atr.alias("atr_ewm"))


def volatility_forecast(candles: DataFrame, span: int = 30) -> DataFrame:
    """Volatility of each candle's returns so far: historical (standard deviation of all), garch (a tenth above), ewma (deviation
    of exponentially weighted returns with ``span``, unbiased), their ratio and the regime that it falls in.

    Plain sums and weighted sums of returns and their squares are maps of the sums before (:func:`running.affine`)."""
    by, order = ["symbol"], ["ts"]
    rows = previous(candles.select("symbol", "ts", "close"), "close", "_before", by, order, SCAN_MS)
    r, keep = F.try_divide("close", "_before") - 1, 1 - 2 / (span + 1)
    rows, x = rows.withColumn("_r", r), F.col("_r")
    one = F.when(x.isNotNull(), 1.0)
    sums = {"_n": (one, one), "_s": (one, x), "_q": (one, x * x)}
    weighted = {"_w": (one * keep, one), "_w2": (one * keep * keep, one), "_ws": (one * keep, x), "_wq": (one * keep, x * x)}
    rows = affine(rows, sums | weighted, by, order, SCAN_MS).where(x.isNotNull())
    plain = F.when(F.col("_n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1))))
    mean = F.col("_ws") / F.col("_w")
    spread = F.greatest(F.lit(0.0), F.col("_wq") / F.col("_w") - mean * mean)
    part = F.col("_w") * F.col("_w")
    ewma = F.when(F.col("_n") > 1, F.sqrt(spread * part / (part - F.col("_w2"))))
    ratio = F.when(F.col("historical") > 0, F.col("garch") / F.col("historical")).otherwise(1.0)
    out = rows.select("symbol", "ts", plain.alias("historical"), ewma.alias("ewma")).withColumn("garch", F.col("historical") * 1.1).withColumn("ratio", ratio)
    return out.withColumn("regime", F.when(F.col("ratio") < 0.8, "LOW").when(F.col("ratio") < 1.2, "MEDIUM").when(F.col("ratio") < 2, "HIGH").otherwise("EXTREME"))
