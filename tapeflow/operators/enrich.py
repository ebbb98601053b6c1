"""Fields that enrich a window: regimes, their rules, session indicators, levels, book labels, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import line, over

# Fixed values by (market, volatility): size, stop and target multipliers, least confidence, sides, confirmation. The first fitting row counts.
REGIME_RULES = (
    ("market = 'RISK_ON' AND volatility = 'LOW_VOL'", 1.25, 0.8, 1.2, 0.55, "long,short", False),
    ("market = 'RISK_ON' AND volatility = 'NORMAL_VOL'", 1.0, 1.0, 1.0, 0.60, "long,short", False),
    ("market = 'RISK_OFF' AND volatility IN ('HIGH_VOL', 'EXTREME_VOL')", 0.5, 1.5, 0.8, 0.75, "short", True),
    ("market = 'RISK_OFF'", 0.75, 1.2, 0.9, 0.65, "long,short", True),
    ("market = 'TRANSITION'", 0.5, 1.3, 0.8, 0.70, "long,short", True),
    ("volatility = 'EXTREME_VOL'", 0.0, 2.0, 0.5, 0.90, "none", True),
    ("correlation = 'CRYPTO_NATIVE'", 1.0, 1.0, 1.0, 0.60, "long,short", False),
    ("true", 0.75, 1.2, 1.0, 0.65, "long,short", False),
)
# Weights of level sources.
SOURCE_WEIGHTS = {
    "poc_daily": 20, "poc_weekly": 22, "poc_monthly": 25, "vah_daily": 15, "val_daily": 15, "vah_weekly": 18, "val_weekly": 18,
    "pivot_classic_PP": 18, "pivot_classic_R1": 14, "pivot_classic_S1": 14, "ema_21_1d": 16, "ema_21_4h": 14, "round_number": 10, "hvn_daily": 12,
}


def regime_rules(signals: DataFrame) -> DataFrame:
    """Signals (market, volatility, correlation) with the adjustments of the first rule that fits."""
    names = ("size_factor", "stop_factor", "target_factor", "least_confidence", "sides", "confirm")
    rule = F.lit(None)
    for when, *values in reversed(REGIME_RULES):
        rule = F.when(F.expr(when), F.struct(*(F.lit(v).alias(n) for n, v in zip(names, values, strict=True)))).otherwise(rule)
    return signals.withColumn("_rule", rule).select("*", "_rule.*").drop("_rule")


def gated(signals: DataFrame) -> DataFrame:
    """Signals (side, confidence, changing, size, balance, entry, atr and those of :func:`regime_rules`)
    that the regime lets through, with size, stop and target; ``reason`` says why not."""
    rows = regime_rules(signals)
    reason = (
        F.when(F.col("sides") == "none", "no_trading").when(~F.array_contains(F.split("sides", ","), F.col("side")), "side")
        .when(F.col("confidence") < F.col("least_confidence"), "confidence").when(F.col("changing") & F.col("confirm"), "changing")
        .when(F.col("size_factor") == 0, "size").otherwise("ok")
    )
    size = F.least(F.col("size") * F.col("size_factor"), F.col("size") * 2, F.col("balance") * 0.1)
    way = F.when(F.col("side") == "long", 1).otherwise(-1)
    stop = F.col("entry") - way * F.col("atr") * 1.5 * F.col("stop_factor")
    target = F.col("entry") + way * F.col("atr") * 3.0 * F.col("target_factor")
    passed = F.col("reason") == "ok"
    return rows.withColumn("reason", reason).withColumns({n: F.when(passed, c) for n, c in (("adjusted_size", size), ("stop", stop), ("target", target))})


def regime_probabilities(rows: DataFrame) -> DataFrame:
    """Shares of trending, reverting and breakout points from adx, profile signal, whale score, book
    imbalance, flow trend and structure; the likeliest regime and the chance of a change."""
    c = F.col
    trending = (
        F.when(c("adx") > 50, 0.4).when(c("adx") > 35, 0.25).otherwise(0.0) + F.when(c("profile").isin("TREND_UP", "TREND_DOWN"), 0.25).otherwise(0.0)
        + F.when(F.abs("imbalance") >= 0.8, 0.10).otherwise(0.0) + F.when(F.lower("flow").contains("accel"), 0.15).otherwise(0.0) + F.when(c("structure") == "TRENDING", 0.20).otherwise(0.0)
    )
    reverting = (
        F.when(c("adx") < 20, 0.3).when(c("adx") <= 35, 0.15).otherwise(0.0) + F.when(c("profile") == "RANGE", 0.25).otherwise(0.0)
        + F.when(F.lower("flow").contains("reversal"), 0.15).otherwise(0.0) + F.when(c("structure") == "RANGE_BOUND", 0.20).otherwise(0.0)
    )
    breakout = (
        F.when(c("profile") == "BREAKOUT_EXPECTED", 0.35).otherwise(0.0) + F.when(F.abs("whale") >= 30, 0.20).when(F.abs("whale") >= 15, 0.10).otherwise(0.0)
        + F.when(F.abs("imbalance") >= 0.8, 0.25).when(F.abs("imbalance") >= 0.5, 0.10).otherwise(0.0)
    )
    out = rows.withColumns({"_t": trending, "_r": reverting, "_b": breakout}).withColumn("_sum", c("_t") + c("_r") + c("_b"))
    share = lambda n, default: F.when(c("_sum") > 0, c(n) / c("_sum")).otherwise(default)
    out = out.withColumns({"trending": share("_t", 0.33), "reverting": share("_r", 0.50)})
    out = out.withColumn("breakout", F.greatest(F.lit(0.0), 1 - c("trending") - c("reverting")))
    most = F.greatest("trending", "reverting", "breakout")
    near = lambda n: c(n) >= most - 1e-9
    regime = F.when(near("trending"), "TRENDING").when(near("reverting"), "MEAN_REVERTING").otherwise("BREAKOUT")
    change = F.least(F.lit(0.95), F.greatest(F.lit(0.05), c("breakout") + (0.5 - F.abs(0.5 - c("trending"))) * 0.3))
    out = out.withColumns({"regime": regime, "change": change})
    lasts = F.when(c("regime") == "TRENDING", F.when(c("adx") < 50, "30m-2h").otherwise("2h-8h")).when(c("regime") == "MEAN_REVERTING", "15m-1h").otherwise("5m-30m")
    return out.withColumn("lasts", lasts).drop("_t", "_r", "_b", "_sum")


def correlation_regime(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), "UNKNOWN").when(c < -0.4, "INVERSE").when(F.abs(c) < 0.2, "DECORRELATED").otherwise("CORRELATED")


def session_oscillators(candles: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    """Stochastic and Williams %R from full windows of ``n`` candles, with signal and zone. A window
    without range has none; inside the smoothing it counts as 50."""
    high, low, close = F.max("high").over(over(n)), F.min("low").over(over(n)), F.col("close")
    full = F.count("close").over(over(n)) >= n
    rows = candles.withColumns({"_hh": high, "_ll": low, "_full": full})
    span = F.col("_hh") - F.col("_ll")
    raw = F.when(F.col("_full"), F.when(span > 0, (close - F.col("_ll")) / span * 100).otherwise(50.0))
    rows = rows.withColumn("_raw", raw).withColumn("stoch_d", F.avg("_raw").over(over(smooth))).where(F.col("_full") & (span > 0))
    rows = rows.withColumns({"stoch_k": F.col("_raw"), "williams_r": (F.col("_hh") - close) / span * -100})
    k, d = F.round("stoch_k", 2), F.round("stoch_d", 2)
    signal = F.when((k < 20) & (d < 20), "OVERSOLD").when((k > 80) & (d > 80), "OVERBOUGHT").when(k > d, "BULLISH").when(k < d, "BEARISH").otherwise("NEUTRAL")
    zone = F.when(F.col("williams_r") > -20, "overbought").when(F.col("williams_r") < -80, "oversold").otherwise("neutral")
    return rows.withColumns({"signal": signal, "zone": zone}).drop("_hh", "_ll", "_full", "_raw")


def sample_volatility(candles: DataFrame) -> DataFrame:
    """Per symbol the sample deviation of all log returns, and their number."""
    r = candles.withColumn("r", F.ln(F.try_divide(F.col("close"), F.lag("close").over(line())))).where("r IS NOT NULL")
    return r.groupBy("symbol").agg(F.stddev_samp("r").alias("volatility"), F.count(F.lit(1)).alias("n"))


def activity_regime(candles: DataFrame, atr: str = "atr", n: int = 50) -> DataFrame:
    """A label from the average true range and the volume against its mean over ``n`` candles."""
    change = F.try_divide(F.col("volume"), F.avg("volume").over(over(n)))
    wide = F.coalesce(F.try_divide(F.col(atr), F.col("close")) > 0.01, F.lit(False))
    rows = candles.withColumns({"volume_change": change, "_wide": wide})
    busy, quiet = F.col("volume_change") > 1.2, F.col("volume_change") < 0.8
    label = F.when(F.col("_wide") & quiet, "manipulation").when(F.col("_wide") & busy, "institutional").when(~F.col("_wide") & quiet, "range").otherwise("accumulation")
    return rows.withColumn("activity", label).drop("_wide")


def trend_regime(adx: Column, volatility: Column) -> Column:
    return F.when(volatility >= 0.02, "High Volatility").when(adx > 25, "Trending").otherwise("Range")


def score_trend(scores: DataFrame, n: int = 30, recent: int = 5) -> DataFrame:
    """Mean of the last ``n`` scores against the last few: rising, falling or stable."""
    rows = scores.withColumns({"mean": F.avg("score").over(over(n)), "recent": F.avg("score").over(over(recent)), "samples": F.count("score").over(over(n))})
    way = F.when(F.col("samples") < 3, "insufficient_data").when(F.col("recent") > F.col("mean") + 5, "increasing_accumulation").when(F.col("recent") < F.col("mean") - 5, "increasing_distribution").otherwise("stable")
    return rows.withColumns({"direction": way, "momentum": F.col("score") - F.col("mean")})


def session_fibonacci(rows: DataFrame) -> DataFrame:
    """Retracements of (high, low) where the range is at least 0.3 % of the low."""
    span = F.col("high") - F.col("low")
    out = rows.where((span > 0) & ((F.col("low") <= 0) | (F.try_divide(span, "low") >= 0.003)))
    return out.withColumns({f"fib_{n}": F.col("low") + span * share for n, share in (("236", 0.236), ("382", 0.382), ("500", 0.5), ("618", 0.618), ("786", 0.786))})


def cci_proxy(price: Column, mean: Column, atr: Column) -> Column:
    return F.try_divide(price - mean, atr * (0.015 / 4))


def normalised_delta(windows: DataFrame) -> DataFrame:
    """Delta over the range, which counts as 0.01 % of the close at least; 0 where there is none."""
    span = F.greatest(F.col("high") - F.col("low"), F.col("close") * 0.0001)
    return windows.withColumn("delta_norm", F.coalesce(F.try_divide(F.col("buy_volume") - F.col("sell_volume"), span), F.lit(0.0)))


def cvd_divergence(bars: DataFrame, n: int = 10) -> DataFrame:
    """Bars (symbol, ts, close, cvd) whose price and cumulative delta went opposite ways over the last
    ``n`` bars; there must be one more before them."""
    before = lambda c: F.lag(c, n - 1).over(line())
    change = F.try_divide(F.col("close") - before("close"), before("close"))
    rows = bars.withColumns({"price_change": change, "cvd_change": F.col("cvd") - before("cvd"), "_n": F.row_number().over(line())}).where(F.col("_n") > n).drop("_n")
    up, cvd_up = F.col("price_change") > 0, F.col("cvd_change") > 0
    rows = rows.where(up != cvd_up)
    return rows.withColumns({"kind": F.when(up, "bearish").otherwise("bullish"), "strength": F.least(F.abs("price_change") * 100, F.lit(1.0))})


def absorbing_windows(windows: DataFrame, n: int = 100, least_trades: int = 5, volume_factor: float = 2.0, narrow_percent: float = 0.05) -> DataFrame:
    """Windows (symbol, ts, high, low, volume, buy_volume, sell_volume, n) with much volume and little range
    (in percent of its middle) against the last ``n`` windows, themselves included: who absorbs, and how strongly."""
    rows = windows.withColumn("range_percent", F.coalesce(F.try_divide(F.col("high") - F.col("low"), (F.col("high") + F.col("low")) / 2), F.lit(0.0)) * 100)
    rows = rows.withColumns({"_v": F.avg("volume").over(over(n)), "_r": F.avg("range_percent").over(over(n)), "_k": F.count("volume").over(over(n))})
    rows = rows.withColumns({"volume_ratio": F.try_divide("volume", "_v"), "range_ratio": F.try_divide("range_percent", "_r")})
    narrow = (F.col("range_percent") < narrow_percent) | (F.col("range_ratio") < 0.5)
    rows = rows.where((F.col("_k") >= 5) & (F.col("n") >= least_trades) & (F.col("volume_ratio") >= volume_factor) & narrow)
    absorber = F.when(F.col("buy_volume") > F.col("sell_volume") * 1.5, "sell").when(F.col("sell_volume") > F.col("buy_volume") * 1.5, "buy").otherwise("unknown")
    intensity = F.least(F.lit(1.0), F.col("volume_ratio") / volume_factor * 0.5 + (1 - F.least("range_ratio", F.lit(1.0))) * 0.5)
    return rows.withColumns({"absorber": absorber, "intensity": intensity, "level": (F.col("high") + F.col("low")) / 2}).drop("_v", "_r", "_k")


def flow_bars(windows: DataFrame) -> DataFrame:
    """Windows with the ratio of bought to sold volume, the dominant side and its change of price; the
    severity of the larger ratio, and over the last five the vote of the dominant sides."""
    b, s = F.col("buy_volume"), F.col("sell_volume")
    ratio = F.when(s > 0, b / s).when(b > 0, float("inf")).otherwise(1.0)
    side = F.when(b > s, "buy").when(s > b, "sell").otherwise("unknown")
    rows = windows.withColumns({"ratio": ratio, "dominant": side, "price_change": F.try_divide(F.col("close") - F.col("open"), "open") * 100})
    top = F.greatest("ratio", F.when(F.col("ratio") > 0, 1 / F.col("ratio")).otherwise(float("inf")))
    rows = rows.withColumn("effective", F.when(top == float("inf"), 100.0).otherwise(top)).withColumn("ratio", F.when(F.col("ratio") < float("inf"), F.col("ratio")))
    severity = F.when(F.col("effective") >= 5, "extreme").when(F.col("effective") >= 3, "strong").when(F.col("effective") >= 2, "moderate")
    votes = lambda x: F.sum((F.col("dominant") == x).cast("int")).over(over(5))
    rows = rows.withColumns({"severity": severity, "_b": votes("buy"), "_s": votes("sell"), "_n": F.count(F.lit(1)).over(over(5))})
    score = F.when(F.col("_n") < 5, 0.0).when(F.col("_b") > F.col("_s"), F.col("_b") / 5).when(F.col("_s") > F.col("_b"), -F.col("_s") / 5).otherwise(0.0)
    return rows.withColumn("trend_score", score).withColumn("trend", F.when(F.col("trend_score") > 0, "bullish").when(F.col("trend_score") < 0, "bearish").otherwise("neutral")).drop("_b", "_s", "_n")


def profile_parameters(windows: DataFrame, bins: int = 20) -> DataFrame:
    """Bins (10 to 50) and value area (60 to 80 %) of a profile from volatility (atr over price), the
    whales' share and the delta's share; the defaults for fewer than 10 trades."""
    within = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), c))
    volatility = within(F.coalesce(F.try_divide("atr", "close"), F.lit(0.01)), 0.5, 2.0)
    rows = windows.withColumns({"_v": volatility, "_w": within(1 + F.col("whale_share"), 0.8, 1.5), "_t": within(1 + F.col("delta_share"), 0.7, 1.3)})
    many = F.col("n") >= 10
    found = F.floor(F.round(bins * F.col("_v") * F.col("_w") * F.col("_t"), 9)).cast("int")
    return rows.withColumns(
        {
            "bins": F.when(many, F.greatest(F.lit(10), F.least(F.lit(50), found))).otherwise(bins),
            "value_area": F.when(many, within(0.70 + (F.col("_v") - 1) * 0.1, 0.60, 0.80)).otherwise(0.70),
            "sensitivity": F.when(many, within(2 - F.col("_v"), 0.5, 2.0)).otherwise(1.0),
        }
    ).drop("_v", "_w", "_t")


def checked_profile(profiles: DataFrame) -> DataFrame:
    """Profiles (poc, vah, val) with vah above val and a status."""
    high, low = F.greatest("vah", "val"), F.least("vah", "val")
    status = F.when(F.coalesce(F.col("poc") == 0, F.lit(True)), "no_data").when(F.try_divide(high - low, F.col("poc")) * 100 < 0.05, "insufficient_data").otherwise("success")
    return profiles.withColumns({"status": status, "vah": high, "val": low})


def level_distances(prices: DataFrame, nodes: DataFrame, by: list[str], near: float = 0.005) -> DataFrame:
    """Prices (by, price) with the percent distance to the nearest node (by, kind, at) of each kind, and
    how many nodes lie within ``near``."""
    rows = prices.join(nodes, by).withColumn("_d", F.abs(F.try_divide(F.col("price") - F.col("at"), "price")) * 100)
    return rows.groupBy(*by, "price", "kind").agg(F.min("_d").alias("distance"), F.sum((F.col("_d") <= near * 100).cast("int")).alias("near"))


def quick_score(price: Column, current: Column, source: Column, confluence: Column) -> Column:
    """0 to 100 from the weight of a level's source, its confluence and its distance from the price."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for pair in SOURCE_WEIGHTS.items() for x in pair])[source], F.lit(10))
    far = F.abs(F.try_divide(price - current, current)) * 100
    return F.least(F.lit(100), weight + F.least(F.lit(30), confluence * 8) + F.coalesce(F.greatest(F.lit(0), (20 - far * 3).cast("int")), F.lit(0)))


def adaptive_thresholds(volatility: Column) -> Column:
    factor = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.try_divide(F.lit(0.5), F.when(volatility > 0, volatility).otherwise(0.03))))
    return F.struct(factor.alias("factor"), (factor * 0.15).alias("absorption"), (factor * 0.10).alias("flow"))


def nearest_targets(rows: DataFrame) -> DataFrame:
    """Nearest bull and bear targets over the next 5, 15 and 60 minutes from atr_15m, atr_1h, value area
    and defence levels on the right side of the price."""
    p = F.col("price")
    above = lambda *c: F.least(*(F.when(x > p, x) for x in c))
    below = lambda *c: F.greatest(*(F.when(x < p, x) for x in c))
    out = {}
    for name, times in (("5m", 0.3), ("15m", 0.7)):
        step = F.col("atr_15m") * times
        out[f"bull_{name}"] = above(p + step, F.col("sell_defence"), F.col("vah"))
        out[f"bear_{name}"] = below(p - step, F.col("buy_defence"), F.col("val"))
    step = F.col("atr_1h") * 1.2
    out |= {"bull_1h": above(p + step, F.col("vah")), "bear_1h": below(p - step, F.col("val"))}
    return rows.withColumns(out)


def book_labels(books: DataFrame, alert: float = 0.4, tight_bps: float = 0.2, critical: float = 0.95, dominant: float = 2_000_000, ratio: float = 20.0) -> DataFrame:
    """Books (imbalance, spread_bps, bid_value, ask_value, reload) with a label, alerts and critical flags."""
    i, size = F.col("imbalance"), F.abs("imbalance")
    label = F.when(i > alert, "demand").when(i < -alert, "supply").when(i > 0, "light_demand").when(i < 0, "light_supply").otherwise("balance")
    wide = F.coalesce(F.col("spread_bps") >= 50, F.lit(False))
    r = F.try_divide("bid_value", "ask_value")
    extreme_ratio = F.coalesce(F.when(r > 0, F.greatest(r, 1 / r)).otherwise(float("inf")) >= ratio, F.lit(False))
    is_critical = (size >= critical) & (wide | extreme_ratio | (F.greatest("bid_value", "ask_value") >= dominant))
    emergency = (size >= 0.9) & ~wide
    alerts = F.array_compact(F.array(
        F.when(size >= alert, "imbalance"), F.when(F.col("reload"), "reload"), F.when(F.col("spread_bps") <= tight_bps, "tight"),
        F.when(is_critical, "critical").when(emergency, "emergency"),
    ))
    return books.withColumns({"label": label, "alerts": F.concat_ws(",", alerts), "is_critical": is_critical, "is_emergency": emergency})


def depth_slope(d1: Column, d5: Column, d10: Column, d25: Column, price: Column) -> Column:
    """Slope of the least-squares line through four depth differences (levels 1, 5, 10, 25), over the price."""
    xs = (1, 5, 10, 25)
    mean = sum(xs) / 4
    spread = sum((x - mean) ** 2 for x in xs)
    return F.try_divide(sum(d * ((x - mean) / spread) for x, d in zip(xs, (d1, d5, d10, d25), strict=True)), price)


def small_slippage(at_100k: Column, depth: Column, spread_bps: Column, value: int) -> Column:
    """Slippage of 1,000 or 10,000 in value: scaled from that of 100,000, else by depth and spread."""
    return F.when(at_100k > 0, at_100k * (value / 100_000)).otherwise(F.try_divide(F.lit(float(value)), F.greatest(depth, F.lit(1000.0))) * spread_bps)


def liquidity_risk(rows: DataFrame) -> DataFrame:
    """Spread share, slippage and impact of a position (bid, ask, size); 0 without a two-sided book."""
    share = F.coalesce(F.when((F.col("bid") > 0) & (F.col("ask") > 0), F.try_divide(F.col("ask") - F.col("bid"), (F.col("bid") + F.col("ask")) / 2)), F.lit(0.0))
    return rows.withColumns({"spread_ratio": share, "slippage": share * F.col("size"), "impact": share * F.col("size") * 1.5})


def margins(rows: DataFrame) -> DataFrame:
    """Initial (10 % of the notional), maintenance (80 % of it) and free margin (half of it)."""
    first = F.col("notional") * 0.1
    return rows.withColumns({"initial": first, "maintenance": first * 0.8, "free": first * 0.5})


def side_and_strength(signals: DataFrame) -> DataFrame:
    """Absorption labels as sides, and how many of three conditions (delta, volume, imbalance) hold."""
    text = F.lower("label")
    side = F.when(text.contains("sell absorption"), "buy").when(text.contains("buy absorption"), "sell").otherwise("none")
    held = (F.abs("delta") >= 500).cast("int") + (F.col("volume") >= 100_000).cast("int") + F.coalesce((F.abs("imbalance") >= 0.6).cast("int"), F.lit(0))
    return signals.withColumns({"side": side, "strength": F.when(held >= 3, "strong").when(held >= 2, "medium").otherwise("weak")})


def recency(levels: DataFrame, candles: DataFrame, tolerance: float = 0.005, recent: int = 50) -> DataFrame:
    """Levels (symbol, price) with the candle of the last touch of a close, touches among the last
    ``recent`` candles, and a score of 0 to 10 that falls with the distance from the end."""
    n = Window.partitionBy("symbol")
    numbered = candles.withColumns({"_i": F.row_number().over(line()) - 1, "_n": F.count(F.lit(1)).over(n)}).select("symbol", "close", "_i", "_n")
    step = 0.05
    slot = lambda c: F.floor(F.log(c) / step)
    near = numbered.withColumn("_s", F.explode(F.sequence(slot(F.col("close") / (1 + tolerance)), slot(F.col("close") / (1 - tolerance)))))
    met = levels.withColumn("_s", slot(F.col("price"))).join(near, ["symbol", "_s"]).where(F.abs(F.col("close") - F.col("price")) <= F.col("price") * tolerance)
    last = met.groupBy("symbol", "price").agg(
        F.max("_i").alias("last_touch"), F.sum((F.col("_i") >= F.col("_n") - F.least(F.lit(recent), F.col("_n"))).cast("int")).alias("recent_touches"), F.max("_n").alias("_n")
    )
    out = levels.join(last, ["symbol", "price"], "left")
    score = (1 - F.coalesce(F.try_divide(F.col("_n") - 1 - F.col("last_touch"), F.col("_n") - 1), F.lit(0.0))) * 10
    score = F.when(F.col("last_touch").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(10.0), score)))
    return out.withColumn("score", score).fillna({"last_touch": -1, "recent_touches": 0}).drop("_n")


def cluster_quality(members: DataFrame, ranges: DataFrame) -> DataFrame:
    """Clusters (symbol, cluster, price) scored by dispersion, concentration and outliers against the
    symbol's whole price range (symbol, span)."""
    quarter = members.groupBy("symbol", "cluster").agg(F.percentile("price", 0.25).alias("_q1"), F.percentile("price", 0.75).alias("_q3"))
    rows = members.join(quarter, ["symbol", "cluster"])
    iqr = F.col("_q3") - F.col("_q1")
    outside = (iqr > 0) & ((F.col("price") < F.col("_q1") - 1.5 * iqr) | (F.col("price") > F.col("_q3") + 1.5 * iqr))
    out = rows.groupBy("symbol", "cluster").agg(
        F.count(F.lit(1)).alias("n"), (F.max("price") - F.min("price")).alias("_range"), F.try_divide(F.stddev_pop("price"), F.abs(F.avg("price"))).alias("_cv"), F.sum(outside.cast("int")).alias("outliers")
    )
    out = out.join(ranges, "symbol")
    few = F.col("n") < 3
    dispersion = 10 * (1 - F.least(F.coalesce(F.try_divide("_range", "span"), F.lit(0.0)) * 10, F.lit(1.0)))
    concentration = 10 * (1 - F.least(F.coalesce("_cv", F.lit(0.0)) * 5, F.lit(1.0)))
    score = dispersion * 0.4 + concentration * 0.4 + 10 * (1 - F.col("outliers") / F.col("n")) * 0.2
    out = out.withColumn("score", F.when(few, 0.0).otherwise(score))
    grade = F.when(few, "insufficient").when(F.col("score") >= 8, "excellent").when(F.col("score") >= 6, "good").when(F.col("score") >= 4, "moderate").otherwise("poor")
    return out.withColumns({"quality": grade, "outliers": F.when(few, 0).otherwise(F.col("outliers"))}).drop("_range", "_cv", "span")
