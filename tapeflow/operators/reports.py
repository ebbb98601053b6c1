"""Reports, probabilities, calendars, level tests, book state machines and session logic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import line, over
from .running import previous, running_sum

# Sources of each layer of signals.
LAYERS = {
    "order_flow": "cvd_analyzer footprint_analyzer ofi_analyzer absorption_detector iceberg_detector".split(),
    "structure": "smart_money_analyzer vwap_twap_analyzer".split(),
    "statistical": "kalman_filter hurst_calculator garch_model mean_reversion market_regime_hmm".split(),
    "sentiment": "crypto_cot whale_detector entropy_analyzer".split(),
    "probabilistic": "monte_carlo fourier_cycles".split(),
}
# 97.5 % points of the t distribution for 1 to 10 degrees of freedom.
T_POINTS = (12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139)
NORMAL_POINT = 1.959964


def probabilities(outcomes: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """Shares of up, down and flat outcomes and the mean change of every combination of keys that has
    at least ``least`` outcomes."""
    share = lambda x: F.avg((F.col("direction") == x).cast("double"))
    out = outcomes.where("direction IS NOT NULL").groupBy(*keys)
    out = out.agg(F.count(F.lit(1)).alias("n"), share("up").alias("up"), share("down").alias("down"), share("flat").alias("flat"), F.avg("change").alias("mean"))
    return out.where(F.col("n") >= least)


def with_prior(events: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Events with the known probabilities of their keys, else fixed ones by their label."""
    rows = events.join(known.select(*keys, "up", "down"), keys, "left").withColumn("real", F.col("up").isNotNull())
    bought, sold = F.lower("label").contains("buy"), F.lower("label").contains("sell")
    up = F.when(bought, 0.45).when(sold, 0.25).when(F.lower("label").contains("exhaust"), 0.35).otherwise(0.33)
    down = F.when(bought, 0.25).when(sold, 0.45).when(F.lower("label").contains("exhaust"), 0.35).otherwise(0.33)
    rows = rows.withColumns({"up": F.coalesce("up", up), "down": F.coalesce("down", down)})
    return rows.withColumn("flat", F.greatest(F.lit(0.0), 1 - F.col("up") - F.col("down")))


def similar_summary(outcomes: DataFrame, by: str) -> DataFrame:
    """How similar cases ended: counts, win rate, mean and a reading of both."""
    n = lambda x: F.sum((F.col("direction") == x).cast("int"))
    out = outcomes.groupBy(by).agg(F.count(F.lit(1)).alias("similar"), n("up").alias("up"), n("down").alias("down"), F.avg("change").alias("mean"))
    out = out.withColumn("win_rate", F.try_divide("up", F.col("up") + F.col("down")) * 100)
    reading = F.when(F.col("up") + F.col("down") < 3, "insufficient").when(F.col("win_rate") >= 70, "rising").when(F.col("win_rate") <= 30, "falling").otherwise("mixed")
    return out.withColumn("reading", reading)


def pnl_report(trades: DataFrame, by: str) -> DataFrame:
    """Count, sum, win rate, mean over deviation and the largest fall of the summed profit (symbol, ts, profit)
    from its peak, which is at least 0."""
    rows = running_sum(trades, F.col("profit").cast("decimal(28,10)"), "_sum", [by], ["ts"], 366 * 86_400_000)
    rows = rows.withColumn("_sum", F.col("_sum").cast("double"))
    rows = rows.withColumn("_fall", F.greatest(F.lit(0.0), F.max("_sum").over(Window.partitionBy(by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))) - F.col("_sum"))
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("profit").cast("decimal(28,10)")).cast("double").alias("total"), F.avg((F.col("profit") > 0).cast("double")).alias("win_rate"),
        F.coalesce(F.try_divide(F.avg("profit"), F.stddev_samp("profit")), F.lit(0.0)).alias("sharpe"), F.max("_fall").alias("max_fall"),
    )


def evaluation(rows: DataFrame) -> DataFrame:
    """Trades (horizon, confidence, profit) by horizon, by confidence bucket, and by both."""
    c = F.col("confidence")
    rows = rows.withColumn("bucket", F.when(c < 0.5, "0.0-0.5").when(c < 0.7, "0.5-0.7").when(c < 0.9, "0.7-0.9").otherwise("0.9-1.0"))
    gain, loss = F.sum(F.greatest("profit", F.lit(0.0))), -F.sum(F.least("profit", F.lit(0.0)))
    figures = [F.count(F.lit(1)).alias("n"), F.avg((F.col("profit") > 0).cast("double")).alias("win_rate"), F.avg("profit").alias("mean"), F.try_divide(gain, loss).alias("profit_factor")]
    return rows.groupingSets([[F.col("horizon")], [F.col("bucket")], [F.col("horizon"), F.col("bucket")]], "horizon", "bucket").agg(*figures)


def fallback_decision(rows: DataFrame) -> DataFrame:
    """Decisions where one side is missing: the model alone at three quarters of its confidence, or the
    language model with a bonus where the model agrees."""
    alone = F.col("confidence") * 0.75
    waits = F.col("action").isin("flat", "wait") | (alone < 0.5)
    lean = F.when(F.col("prob_up") > 0.6, "buy").when(F.col("prob_up") < 0.4, "sell").otherwise("flat")
    agrees = F.coalesce((lean == F.col("llm_action")) & F.col("llm_action").isin("buy", "sell"), F.lit(False))
    has = F.col("llm_action").isNotNull()
    return rows.withColumns(
        {
            "final": F.when(has, F.col("llm_action")).when(waits, "wait").otherwise(F.col("action")),
            "final_confidence": F.when(has, F.least(F.lit(1.0), F.col("llm_confidence") + F.when(agrees, 0.05).otherwise(0.0))).otherwise(alone),
            "origin": F.when(has & agrees, "llm_consensus").when(has, "llm").otherwise("model_only"),
        }
    )


def market_calendar(times: DataFrame, holidays: DataFrame) -> DataFrame:
    """Times (t) with the New York date, weekend and holiday flags of the day before, of and after, and the
    liquidity to expect. ``holidays`` (date, name) is a small table, joined by date."""
    day = F.to_date(F.from_utc_timestamp(F.timestamp_millis(F.col("t")), "America/New_York"))
    rows = times.withColumn("day", day)
    for name, shift in (("holiday", 0), ("pre", 1), ("post", -1)):
        on = holidays.select(F.date_sub("date", shift).alias("day"), F.lit(True).alias(name)).distinct()
        rows = rows.join(on, "day", "left").fillna({name: False})
    rows = rows.withColumn("weekend", F.dayofweek("day").isin(1, 7))
    near = F.col("pre") | F.col("post")
    liquidity = F.when(F.col("holiday"), "VERY_LOW").when(F.col("weekend") & near, "VERY_LOW").when(F.col("weekend"), "LOW").when(near, "REDUCED").otherwise("NORMAL")
    return rows.withColumn("liquidity", liquidity)


def layers(signals: DataFrame) -> DataFrame:
    """Signals (source, direction) by layer: counts of each side and which one leads."""
    layer = F.create_map(*[F.lit(x) for name, sources in LAYERS.items() for s in sources for x in (s, name)])[F.col("source")]
    n = lambda x: F.sum((F.col("direction") == x).cast("int"))
    out = signals.withColumn("layer", layer).where("layer IS NOT NULL").groupBy("layer").agg(n("buy").alias("buys"), n("sell").alias("sells"), F.count(F.lit(1)).alias("signals"), F.count_distinct("source").alias("sources"))
    return out.withColumn("direction", F.when(F.col("buys") > F.col("sells"), "bullish").when(F.col("sells") > F.col("buys"), "bearish").otherwise("neutral"))


def metric_stats(metrics: DataFrame, width_ms: int) -> DataFrame:
    """Metrics (kind, t, latency, failed) by kind and window: count, rate of failures, mean, median and 95 % latency."""
    out = metrics.groupBy("kind", (F.floor(F.col("t") / width_ms) * width_ms).alias("start"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("failed").cast("double")).alias("rate"), F.avg("latency").alias("mean"), F.percentile("latency", 0.5).alias("p50"), F.percentile("latency", 0.95).alias("p95"))


def rate_alerts(stats: DataFrame, most_rate: float, most_latency: float) -> DataFrame:
    """Statistics beyond a threshold as alerts, their level, and how many of a kind there are."""
    rules = F.array_compact(F.array(F.when(F.col("rate") > most_rate, "rate"), F.when(F.col("mean") > most_latency, "latency")))
    rows = stats.select("kind", "start", "rate", "mean", F.explode(rules).alias("alert"))
    over_by = F.when(F.col("alert") == "rate", F.col("rate") / most_rate).otherwise(F.col("mean") / most_latency)
    rows = rows.withColumn("level", F.when(over_by > 1.5, "critical").otherwise("warning"))
    return rows.groupBy("kind", "alert", "level").agg(F.count(F.lit(1)).alias("n"))


def sessions(trades: DataFrame, gap_ms: int) -> DataFrame:
    """Trades summed to sessions, which a silence of ``gap_ms`` ends, over buckets of time."""
    rows = previous(trades, "t", "_before", ["symbol"], ["t", "seq"])
    opens = F.when(F.col("_before").isNull() | (F.col("t") - F.col("_before") >= gap_ms), 1).otherwise(0)
    rows = running_sum(rows, opens, "session", ["symbol"], ["t", "seq"])
    return rows.groupBy("symbol", "session").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("decimal(20,8)")).cast("double").alias("volume"))


def warmed(windows: DataFrame, skip: int = 3) -> DataFrame:
    """Windows (symbol, ts) after the first ``skip`` of each symbol, with the closes of the two before."""
    rows = windows.withColumns({"_n": F.row_number().over(line()), "close_1": F.lag("close", 1).over(line()), "close_2": F.lag("close", 2).over(line())})
    return rows.where(F.col("_n") > skip).drop("_n")


def checked_return(candles: DataFrame, n: int) -> DataFrame:
    """Return over ``n`` candles, or over as many as there are, clipped to a half, and whether it is valid."""
    past = F.coalesce(F.lag("close", n).over(line()), F.first("close").over(line().rowsBetween(Window.unboundedPreceding, 0)))
    rows = candles.withColumns({"_past": past, "_k": F.row_number().over(line())})
    sound = (F.col("close") > 0) & (F.col("_past") > 0)
    reason = F.when(F.col("_k") == 1, "WARMUP").when(~sound, "ZERO_PRICE").otherwise("VALID")
    value = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.try_divide("close", "_past") - 1))
    return rows.withColumns({"reason": reason, "value": F.when(F.col("_k") == 1, 0.0).when(sound, value).otherwise(0.0)}).drop("_past", "_k")


def live_features(candles: DataFrame, n: int = 20) -> DataFrame:
    """Returns over 1, 5 and 10 candles, Bollinger bands, volume ratio, and how many features are real."""
    rows = candles.withColumns({f"return_{k}": F.try_divide("close", F.lag("close", k).over(line())) - 1 for k in (1, 5, 10)})
    full = F.count("close").over(over(n)) >= n
    mean, dev = F.avg("close").over(over(n)), F.stddev_pop("close").over(over(n))
    rows = rows.withColumns({"upper": F.when(full, mean + dev * 2), "lower": F.when(full, mean - dev * 2), "volume_ratio": F.when(full, F.try_divide("volume", F.avg("volume").over(over(n))))})
    names = ("return_1", "return_5", "return_10", "upper", "lower", "volume_ratio")
    return rows.withColumn("real", sum(F.col(c).isNotNull().cast("int") for c in names))


def t_point(dof: Column) -> Column:
    """97.5 % point of the t distribution: a table up to 10 degrees of freedom, then its expansion in 1 / dof."""
    z = NORMAL_POINT
    g = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    far = F.lit(z) + F.lit(g[0]) / dof + F.lit(g[1]) / (dof * dof) + F.lit(g[2]) / (dof * dof * dof)
    return F.when(dof <= len(T_POINTS), F.get(F.array(*map(F.lit, T_POINTS)), (dof - 1).cast("int"))).otherwise(far)


def t_interval(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, deviation and 95 % confidence interval of each group, and a stability of 0 to 10 that falls with its width."""
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))
    half = F.when(F.col("n") > 1, t_point(F.col("n") - 1) * F.col("deviation") / F.sqrt("n")).otherwise(0.0)
    out = out.withColumn("_half", half).fillna({"deviation": 0.0})
    width = F.coalesce(F.try_divide(F.col("_half") * 2, F.abs("mean")), F.lit(0.0)) * 100
    return out.withColumns({"low": F.col("mean") - F.col("_half"), "high": F.col("mean") + F.col("_half"), "stability": F.greatest(F.lit(0.0), F.least(F.lit(10.0), 10 - width * 2))}).drop("_half")


def relative_strength(levels: DataFrame, candles: DataFrame, tolerance: float = 0.005, ahead: int = 5, reversal: float = 0.005) -> DataFrame:
    """Levels (symbol, price) scored 0 to 10 by the share of touches that reverse within ``ahead`` candles, the
    volume at those and the recency of the last touch. Closes meet levels by price step."""
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    c = candles.withColumns({"_i": F.row_number().over(line()) - 1, "_n": n, "_after": F.lead("close", ahead - 1).over(line()), "_v": F.avg("volume").over(Window.partitionBy("symbol"))})
    step = 0.05
    slot = lambda x: F.floor(F.log(x) / step)
    near = c.select("symbol", "close", "volume", "_i", "_n", "_after", "_v", F.explode(F.sequence(slot(F.col("close") / (1 + tolerance)), slot(F.col("close") / (1 - tolerance)))).alias("_s"))
    met = levels.withColumn("_s", slot(F.col("price"))).join(near, ["symbol", "_s"]).where(F.abs(F.col("close") - F.col("price")) <= F.col("price") * tolerance)
    turned = (F.col("_i") < F.col("_n") - ahead) & (F.abs(F.col("_after") - F.col("price")) / F.col("price") > reversal)
    out = met.groupBy("symbol", "price").agg(
        F.count(F.lit(1)).alias("touches"), F.sum(F.when(turned, 1).otherwise(0)).alias("rejections"), F.try_divide(F.avg(F.when(turned, F.col("volume"))), F.max("_v")).alias("_r"), F.max("_i").alias("_last"), F.max("_n").alias("_n")
    )
    out = levels.join(out, ["symbol", "price"], "left").fillna({"touches": 0, "rejections": 0})
    rate, ratio = F.coalesce(F.try_divide("rejections", "touches"), F.lit(0.0)), F.coalesce("_r", F.lit(1.0))
    score = (rate * 0.4 + F.least(ratio, F.lit(2.0)) / 2 * 0.3 + (1 - (F.col("_n") - F.col("_last")) / F.col("_n")) * 0.3) * 10
    return out.withColumn("score", F.when(F.col("touches") > 0, score).otherwise(0.0)).drop("_r", "_last", "_n")


def neutral_zone(zones: DataFrame) -> DataFrame:
    """Per symbol the gap between the highest buy zone and the lowest sell zone (symbol, side, center, low, high)."""
    out = zones.groupBy("symbol").agg(
        F.max_by("high", F.when(F.col("side") == "buy", F.col("center"))).alias("start"), F.min_by("low", F.when(F.col("side") == "sell", F.col("center"))).alias("end")
    )
    return out.where("end > start").withColumn("width", F.col("end") - F.col("start"))


def level_tests(tests: DataFrame) -> DataFrame:
    """Tests of levels (symbol, outcome) as counts and rates."""
    n = lambda x: F.sum((F.col("outcome") == x).cast("int"))
    out = tests.groupBy("symbol").agg(F.count(F.lit(1)).alias("tests"), n("defended").alias("defended"), n("failed").alias("failed"))
    return out.withColumns({"defended_rate": F.try_divide("defended", "tests"), "failed_rate": F.try_divide("failed", "tests")})


def book_statistics(book: DataFrame, near: float = 0.02, critical: float = 0.95) -> DataFrame:
    """Per snapshot: levels and quantities of both sides, best prices, spread, value within ``near`` of the
    middle, and whether the quantities are critically one-sided."""
    side = lambda s: F.col("side") == s
    best = book.groupBy("snapshot").agg(F.max(F.when(side("bid"), F.col("price"))).alias("bid"), F.min(F.when(side("ask"), F.col("price"))).alias("ask"))
    mid = (F.col("bid") + F.col("ask")) / 2
    rows = book.join(best, "snapshot").withColumn("_near", F.abs(F.col("price") - mid) <= mid * near)
    quantity = lambda s: F.sum(F.when(side(s), F.col("qty")).otherwise(0.0))
    value = lambda s: F.sum(F.when(side(s) & F.col("_near"), (F.col("price") * F.col("qty")).cast("decimal(28,6)")).otherwise(0)).cast("double")
    out = rows.groupBy("snapshot", "bid", "ask").agg(
        F.sum(side("bid").cast("int")).alias("bids"), F.sum(side("ask").cast("int")).alias("asks"), quantity("bid").alias("bid_qty"), quantity("ask").alias("ask_qty"), value("bid").alias("bid_near"), value("ask").alias("ask_near")
    )
    imbalance = F.coalesce(F.try_divide(F.col("bid_qty") - F.col("ask_qty"), F.col("bid_qty") + F.col("ask_qty")), F.lit(0.0))
    return out.withColumns({"spread": F.col("ask") - F.col("bid"), "imbalance": imbalance, "critical": F.abs(imbalance) >= critical})


def cluster_sides(clusters: DataFrame) -> DataFrame:
    """Clusters (center, buy_volume, sell_volume) as support or resistance where one side is a fifth larger, and their weight."""
    b, s = F.col("buy_volume"), F.col("sell_volume")
    role = F.when(b > s * 1.2, "support").when(s > b * 1.2, "resistance").otherwise("neutral")
    return clusters.withColumns({"role": role, "weight": (b + s) * (1 + F.abs(F.coalesce(F.try_divide(b - s, b + s), F.lit(0.0))))})


def active_patterns(candles: DataFrame, history: int = 500) -> DataFrame:
    """Triangles and wedges from the last two swing highs and lows among the last ``history`` closes of each symbol, at its
    last close: pattern, target, completion, stop, confidence and bias, three at most. A symbol needs 6 closes.
    Wedges count only while the closes range over less than 3 % of the price."""
    before, after = F.lag("close").over(line()), F.lead("close").over(line())
    newest = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    kind = F.when((F.col("close") > before) & (F.col("close") > after), "h").when((F.col("close") < before) & (F.col("close") < after), "l")
    rows = candles.select("symbol", "ts", "close").withColumns({"_kind": kind, "_before": before, "_k": F.row_number().over(newest)}).where(F.col("_k") <= history)
    # The oldest close of the history has no neighbour in it, so it is no swing.
    rows = rows.withColumn("_kind", F.when(F.col("_k") < history, F.col("_kind")))
    swings = rows.where("_kind IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "_kind").orderBy(F.desc("ts")))).where("_n <= 2")
    points = {f"{c}{n}": F.max(F.when((F.col("_kind") == c) & (F.col("_n") == 3 - n), F.col("close"))) for c in "hl" for n in (1, 2)}
    now = rows.groupBy("symbol").agg(F.max_by("close", "ts").alias("price"), F.count("close").alias("_n"), F.max("close").alias("_hi"), F.min("close").alias("_lo"))
    out = now.where("_n >= 6").join(swings.groupBy("symbol").agg(*(c.alias(k) for k, c in points.items())).dropna(), "symbol")
    p, h1, h2, l1, l2 = (F.col(c) for c in ("price", "h1", "h2", "l1", "l2"))
    flat_high, flat_low = F.abs(h2 - h1) / p < 0.002, F.abs(l2 - l1) / p < 0.002
    rate_high, rate_low = (h2 - h1) / F.greatest(h1, F.lit(1.0)), (l2 - l1) / F.greatest(l1, F.lit(1.0))
    narrow = F.when(p > 0, (F.col("_hi") - F.col("_lo")) / p).otherwise(0.01) < 0.03
    up, gap = p > (h2 + l2) / 2, F.greatest(h2 - l2, F.lit(1.0))
    cap = lambda c, top: F.least(F.lit(top), c)
    # The five patterns with target, completion, stop, confidence at completion 0 and its growth, and bias.
    rules = {
        "ASCENDING_TRIANGLE": (flat_high & (l2 > l1) & (h2 > p), h2 + (h2 - l2), cap((p - l2) / gap, 0.95), l2 * 0.998, 0.55, 0.2, F.lit("BULLISH")),
        "DESCENDING_TRIANGLE": (flat_low & (h2 < h1) & (l2 < p), l2 - (h2 - l2), cap((h2 - p) / gap, 0.95), h2 * 1.002, 0.55, 0.2, F.lit("BEARISH")),
        "SYMMETRICAL_TRIANGLE": (
            (h2 < h1) & (l2 > l1) & ~flat_high & ~flat_low, F.when(up, h2 + (h1 - l1) * 0.75).otherwise(l2 - (h1 - l1) * 0.75), cap(1 - (h2 - l2) / F.greatest(h1 - l1, F.lit(1.0)), 0.90),
            F.when(up, l2 * 0.997).otherwise(h2 * 1.003), 0.45, 0.25, F.when(up, "BULLISH").otherwise("BEARISH"),
        ),
        "RISING_WEDGE": ((h2 > h1) & (l2 > l1) & (rate_low > rate_high) & narrow, l1, cap(rate_high / F.greatest(rate_low, F.lit(0.0001)), 0.90), h2 * 1.002, 0.5, 0.2, F.lit("BEARISH")),
        "FALLING_WEDGE": ((h2 < h1) & (l2 < l1) & (rate_high < rate_low) & narrow, h1, cap(-rate_low / F.greatest(-rate_high, F.lit(0.0001)), 0.90), l2 * 0.998, 0.5, 0.2, F.lit("BULLISH")),
    }
    entry = lambda k, target, done, stop, base, growth, bias: F.struct(
        F.lit(k).alias("pattern"), target.alias("target"), done.alias("completion"), stop.alias("stop"), (base + done * growth).alias("confidence"), bias.alias("bias")
    )
    found = F.array_compact(F.array(*(F.when(rule, entry(k, *rest)) for k, (rule, *rest) in rules.items())))
    return out.select("symbol", F.explode(F.slice(found, 1, 3)).alias("x")).select("symbol", "x.*")


def local_extrema(candles: DataFrame, span: int = 5, distance: int = 5, least_percent: float = 0.002) -> DataFrame:
    """Peaks and troughs of each symbol's smoothed closes with enough prominence and distance: kind, ts, price.
    One group a symbol: candles do not grow with trades."""

    def bases(x: np.ndarray) -> np.ndarray:
        """For each place the least value since the last one that was greater, by a stack of those still in sight."""
        out, sight = np.empty(len(x)), []
        for i, v in enumerate(x.tolist()):
            low = v
            while sight and sight[-1][0] <= v:
                low = min(low, sight.pop()[1])
            sight.append((v, low))
            out[i] = low
        return out

    def peaks(x: np.ndarray, prominence: float) -> list[int]:
        tops, i = [], 1
        while i < len(x) - 1:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if x[i] > x[i - 1] and j < len(x) - 1 and x[j + 1] < x[i]:
                tops.append((i + j) // 2)
            i = j + 1
        kept = [True] * len(tops)
        for k in sorted(range(len(tops)), key=lambda k: (x[tops[k]], tops[k]), reverse=True):  # the higher of two close peaks stays
            for step in (-1, 1) if kept[k] else ():
                n = k + step
                while 0 <= n < len(tops) and abs(tops[n] - tops[k]) < distance:
                    kept[n] = False
                    n += step
        base = np.maximum(bases(x), bases(x[::-1])[::-1])
        return [i for i, stays in zip(tops, kept, strict=True) if stays and x[i] - base[i] >= prominence]

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        prices, out = pdf["close"].to_numpy(), []
        if len(prices) >= 10:
            smooth = pdf["close"].ewm(span=span).mean().to_numpy()
            least = max(np.median(np.abs(np.diff(smooth))), prices[-1] * least_percent)
            out = [(kind, i) for kind, sign in (("high", 1), ("low", -1)) for i in peaks(sign * smooth, least)]
        return pd.DataFrame([(pdf["symbol"].iloc[0], k, pdf["ts"].iloc[i], prices[i]) for k, i in out], columns=["symbol", "kind", "ts", "price"])

    kind = dict(candles.dtypes)["symbol"]
    return candles.select("symbol", "ts", "close").groupBy("symbol").applyInPandas(find, f"symbol {kind}, kind string, ts bigint, price double")


def ranked_levels(levels: DataFrame, prices: DataFrame, k: int = 10, merge: float = 0.01) -> DataFrame:
    """Levels (symbol, price, score) on each side of the current price, best first, without those closer than
    ``merge`` of the price to a better one. A group is a symbol's side: levels are few."""
    rows = levels.join(prices, "symbol").withColumn("side", F.when(F.col("price") < F.col("last") * 1.001, "support").otherwise("resistance"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_d=(pdf["price"] - pdf["last"]).abs()).sort_values(["score", "_d", "price"], ascending=[False, True, pdf["side"].iloc[0] == "support"])
        kept: list[int] = []
        for i, price in enumerate(pdf["price"]):
            if len(kept) < k and all(abs(price - pdf["price"].iloc[j]) / pdf["last"].iloc[0] >= merge for j in kept):
                kept.append(i)
        return pdf.iloc[kept].assign(rank=range(1, len(kept) + 1))[["symbol", "side", "rank", "price", "score"]]

    kind = dict(levels.dtypes)["symbol"]
    return rows.groupBy("symbol", "side").applyInPandas(pick, f"symbol {kind}, side string, rank bigint, price double, score double")


def icebergs(levels: DataFrame, tolerance: float = 0.2, least: int = 2) -> DataFrame:
    """Price buckets (side, bucket, n, qty by snapshot number n) that were eaten and refilled again and again:
    eaten below 30 % of the last quantity, refilled above 70 % to about the quantity before. A group is one bucket."""
    last = levels.agg(F.max("n").alias("_last"))

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, quantity = pdf.groupby("n")["qty"].sum(), []
        eaten: list[float] = []
        refills, end, first = 0, None, None
        for n, before in seen.items():
            if n == pdf["_last"].iloc[0]:
                break
            now = seen.get(n + 1, 0.0)
            if before > 0 and now < before * 0.3:
                first = n + 1 if first is None else first
                eaten.append(before)
                quantity.append(before)
            elif eaten and now > before * 0.7 and abs(now - eaten[-1]) <= tolerance * eaten[-1]:
                quantity.append(now)
                if len(eaten) >= least:
                    refills, end = len(eaten), n + 1
        if not refills:
            return pd.DataFrame(columns=["side", "bucket", "first_n", "last_n", "refills", "mean_qty", "confidence"])
        row = (pdf["side"].iloc[0], pdf["bucket"].iloc[0], first, end, refills, float(np.mean(quantity)), min(refills / (least * 2), 1.0))
        return pd.DataFrame([row], columns=["side", "bucket", "first_n", "last_n", "refills", "mean_qty", "confidence"])

    rows = levels.select("side", "bucket", "n", "qty").join(F.broadcast(last))
    return rows.groupBy("side", "bucket").applyInPandas(follow, "side string, bucket bigint, first_n bigint, last_n bigint, refills bigint, mean_qty double, confidence double")
