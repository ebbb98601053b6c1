"""Checks, scores and decisions on rows that other operators made."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import SCAN_MS, line, over
from .running import affine, numbered


def flags(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, joined by commas."""
    return F.concat_ws(",", *(F.when(rule, name) for name, rule in rules.items()))


def audit(windows: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Stored totals against their parts: volume = bought + sold, prices within low and high."""
    rules = {
        "volume": F.abs(F.col("volume") - F.col("buy_volume") - F.col("sell_volume")) > tolerance,
        "close": ~F.col("close").between(F.col("low"), F.col("high")),
        "vwap": ~F.col("vwap").between(F.col("low") - tolerance, F.col("high") + tolerance),
        "times": F.col("open_t") > F.col("close_t"),
    }
    return windows.withColumn("broken", flags(rules)).withColumn("consistent", F.col("broken") == "")


def completeness(df: DataFrame, required: list[str], wanted: list[str], optional: list[str]) -> DataFrame:
    """Weighted share of fields that are present (60, 30 and 10 points) and a grade."""
    share = lambda names: sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0)) / len(names)
    score = share(required) * 60 + share(wanted) * 30 + share(optional) * 10
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 50, "C").otherwise("D")
    return df.withColumn("score", score).withColumn("grade", grade)


def anomalies(df: DataFrame, stats: DataFrame, value: str) -> DataFrame:
    """Rows whose value lies over 3 (HIGH) or 5 (CRITICAL) deviations from the given mean."""
    rows = df.join(stats, "symbol").withColumn("z", F.try_divide(F.col(value) - F.col("mean"), F.col("deviation")))
    severity = F.when(F.abs("z") > 5, "CRITICAL").when(F.abs("z") > 3, "HIGH")
    return rows.withColumn("severity", severity).where("severity IS NOT NULL").drop("mean", "deviation")


def vwap_zone(distance: Column) -> Column:
    """Label of a distance from the volume-weighted price in deviations."""
    return (
        F.when(distance >= 3, "extreme_above").when(distance >= 2, "far_above").when(distance >= 1, "above")
        .when(distance > -1, "fair").when(distance > -2, "below").when(distance > -3, "far_below").otherwise("extreme_below")
    )


def spread_tracker(spreads: DataFrame, n: int = 24, tight: float = 100.0) -> DataFrame:
    """Spread (symbol, ts, spread) against the ``n`` rows before: mean, median, share of them
    below it, and how many rows in a row it has been tight."""
    before = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-n, -1)
    rows = spreads.withColumns({"mean": F.avg("spread").over(before), "median": F.percentile("spread", F.lit(0.5)).over(before), "_all": F.collect_list("spread").over(before)})
    below = F.size(F.filter("_all", lambda x: x < F.col("spread")))
    rows = rows.withColumn("rank", F.when(F.size("_all") > 0, below / F.size("_all"))).drop("_all")
    return streak(rows.withColumn("is_tight", F.col("spread") <= tight), "is_tight", "tight_rows")


def streak(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the length so far of the run of equal values that each row belongs to."""
    changed = F.when(F.col(column).eqNullSafe(F.lag(column).over(line())), 0).otherwise(1)
    rows = df.withColumn("_c", changed)
    rows = rows.withColumn("_run", F.sum("_c").over(line().rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("symbol", "_run").orderBy("ts"))).drop("_c", "_run")


def bias(predictions: DataFrame, n: int = 20, block: float = 0.95) -> DataFrame:
    """Share of the last ``n`` probabilities above .6 and below .4, and whether they are blocked."""
    up, down = (F.avg(c.cast("double")).over(over(n)) for c in (F.col("prob") > 0.6, F.col("prob") < 0.4))
    rows = predictions.withColumns({"up_share": up, "down_share": down, "_n": F.count("prob").over(over(n))})
    return rows.withColumn("blocked", (F.col("_n") >= n) & (F.greatest("up_share", "down_share") >= block)).drop("_n")


def frozen(predictions: DataFrame, least: int = 4, tolerance: float = 1e-7) -> DataFrame:
    """Whether a model has given (nearly) the same output ``least`` times in a row."""
    same = F.coalesce(F.abs(F.col("prob") - F.lag("prob").over(line())) < tolerance, F.lit(False))
    rows = streak(predictions.withColumn("_same", same), "_same", "_k")
    return rows.withColumn("frozen", F.col("_same") & (F.col("_k") >= least - 1)).drop("_same", "_k")


def normal_cdf(z: Column) -> Column:
    """Normal distribution function by the five-term polynomial."""
    # Coefficients of the polynomial.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    x = F.abs(z)
    t = 1 / (1 + x * 0.2316419)
    poly = sum((F.pow(t, F.lit(i)) * c for i, c in enumerate(b[1:], 2)), t * b[0])
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def triangle(candles: DataFrame, n: int = 40, near: float = 0.02) -> DataFrame:
    """Ascending triangles: at least three of the last ``n`` highs near their maximum while the lows rise."""
    w = over(n)
    rows = candles.withColumns({"_top": F.max("high").over(w), "_highs": F.collect_list("high").over(w), "_x": F.row_number().over(line()).cast("double")})
    rows = rows.withColumn("slope", F.try_divide(F.covar_pop("low", "_x").over(w), F.var_pop("_x").over(w)))
    rows = rows.withColumn("touches", F.size(F.filter("_highs", lambda h: h >= F.col("_top") * (1 - near))))
    full = F.size("_highs") >= n
    return rows.withColumn("is_triangle", full & (F.col("touches") >= 3) & (F.col("slope") > 0)).drop("_top", "_highs", "_x")


def stoch_rsi(rows: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    """Stochastic of the relative strength (symbol, ts, rsi), smoothed twice; 50 where unknown."""
    low, high = F.min("rsi").over(over(n)), F.max("rsi").over(over(n))
    raw = F.when(F.count("rsi").over(over(n)) >= n, F.try_divide(F.col("rsi") - low, high - low) * 100)
    out = rows.withColumn("_raw", F.coalesce(raw, F.lit(50.0)))
    out = out.withColumn("stoch_rsi_k", F.avg("_raw").over(over(smooth)))
    return out.withColumn("stoch_rsi_d", F.avg("stoch_rsi_k").over(over(smooth))).drop("_raw")


def vol_forecast(vols: DataFrame, decay: float = 0.94) -> DataFrame:
    """EWMA forecast of volatility (symbol, ts, vol): from the variance of the first five on, before that a twentieth above it."""
    by, at = ["symbol"], ["ts"]
    rows = numbered(vols.select("symbol", "ts", "vol").dropna(), "_n", by, at, SCAN_MS)
    v, n, one = F.col("vol"), F.col("_n"), F.lit(1.0)
    rows = affine(rows, {"_sum": (one, F.when(n <= 5, v)), "_squares": (one, F.when(n <= 5, v * v))}, by, at, SCAN_MS)
    begin = F.greatest(F.lit(0.0), F.col("_squares") / 5 - F.col("_sum") * F.col("_sum") / 25)
    maps = {"_var": (F.when(n == 5, 0.0).when(n > 5, decay), F.when(n == 5, begin).when(n > 5, (1 - decay) * v * v))}
    rows = affine(rows, maps, by, at, SCAN_MS)
    return rows.select("symbol", "ts", F.when(n >= 5, F.sqrt("_var")).otherwise(1.05 * v).alias("forecast"))


def timeframe_trend(candles: DataFrame, unit: str, n: int = 21) -> DataFrame:
    """Close of each calendar period against its exponential mean: up or down."""
    start = F.unix_millis(F.date_trunc(unit, F.timestamp_millis("ts")))
    closes = candles.groupBy("symbol", start.alias("period")).agg(F.max_by("close", "ts").alias("close"))
    by, at, weight = ["symbol"], ["period"], 2 / (n + 1)
    rows = numbered(closes, "_n", by, at, SCAN_MS)
    first = F.col("_n") == 1
    rows = affine(rows, {"ema": (F.when(first, 0.0).otherwise(1 - weight), F.when(first, F.col("close")).otherwise(F.col("close") * weight))}, by, at, SCAN_MS)
    return rows.drop("_n").withColumn("trend", F.when(F.col("close") > F.col("ema"), "up").otherwise("down"))


def whale_score(rows: DataFrame) -> DataFrame:
    """Accumulation score from flow (30), book (20), absorption (25) and derivatives (25), each in -1 to 1."""
    part = lambda c, points: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0)))) * points
    score = sum((part(c, p) for c, p in (("flow", 30), ("book", 20), ("absorbed", 25), ("derivatives", 25))), F.lit(0.0))
    label = F.when(F.col("score") >= 50, "strong_accumulation").when(F.col("score") >= 20, "accumulation").when(F.col("score") <= -50, "strong_distribution").when(F.col("score") <= -20, "distribution").otherwise("neutral")
    return rows.withColumn("score", score).withColumn("label", label)


def fusion(rows: DataFrame, weight: float = 0.6, least: float = 0.1) -> DataFrame:
    """A model's probability and a rule score (-1 to 1) joined to one decision. A model that is
    not sure counts nothing; a strong conflict gives HOLD."""
    valid = (F.col("confidence") >= least) & F.col("prob").between(0.01, 0.99)
    model = F.when(valid, F.col("prob") * 2 - 1)
    rows = rows.withColumn("model", model)
    total = F.when(F.col("model").isNull(), F.col("rule")).otherwise(F.col("model") * weight + F.col("rule") * (1 - weight))
    conflict = (F.col("model") * F.col("rule") < 0) & (F.abs("model") > 0.5) & (F.abs("rule") > 0.5)
    rows = rows.withColumns({"total": total, "conflict": F.coalesce(conflict, F.lit(False))})
    action = F.when(F.col("conflict"), "HOLD").when(F.col("total") > 0.2, "BUY").when(F.col("total") < -0.2, "SELL").otherwise("HOLD")
    return rows.withColumn("action", action)


def position_metrics(positions: DataFrame) -> DataFrame:
    """Profit, distances to stop and target and reward for risk of positions (side, size, entry, price, stop, target)."""
    sign = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    rows = positions.withColumns(
        {
            "pnl": (F.col("price") - F.col("entry")) * F.col("size") * sign,
            "to_stop": F.try_divide(F.abs(F.col("price") - F.col("stop")), "price"),
            "to_target": F.try_divide(F.abs(F.col("target") - F.col("price")), "price"),
        }
    )
    return rows.withColumn("reward_risk", F.try_divide(F.abs(F.col("target") - F.col("entry")), F.abs(F.col("entry") - F.col("stop"))))


def counterparty(exposures: DataFrame, default: float = 0.01) -> DataFrame:
    """Exposure-weighted default probability, expected loss and concentration of each portfolio."""
    p = F.coalesce("probability", F.lit(default))
    share = F.try_divide(F.col("value"), F.sum("value").over(Window.partitionBy("portfolio")))
    rows = exposures.withColumns({"_s": share, "_l": F.col("value") * p * 0.6, "_p": p})
    return rows.groupBy("portfolio").agg(
        F.sum(F.col("_s") * F.col("_p")).alias("probability"), F.sum(F.col("_l").cast("decimal(28,6)")).cast("double").alias("expected_loss"), F.sum(F.col("_s") * F.col("_s")).alias("hhi")
    )


def compliance(portfolios: DataFrame, leverage: float = 3.0, liquid: float = 0.2, largest: float = 0.25) -> DataFrame:
    rules = {"leverage": F.col("leverage") > leverage, "liquidity": F.col("liquid_share") < liquid, "concentration": F.col("largest") > largest}
    return portfolios.withColumn("violations", flags(rules))


def dynamic_limits(rows: DataFrame) -> DataFrame:
    """Size multiplier by volatility (.03, .01) and VIX (30, 15), and what to do."""
    factor = F.when(F.col("vol") > 0.03, 0.5).when(F.col("vol") < 0.01, 1.2).otherwise(1.0) * F.when(F.col("vix") > 30, 0.5).when(F.col("vix") < 15, 1.1).otherwise(1.0)
    action = F.when(F.col("factor") < 0.5, "reduce").when(F.col("factor") < 1, "careful").when(F.col("factor") > 1.2, "expand").otherwise("normal")
    return rows.withColumn("factor", factor).withColumn("action", action)


def alerts(rows: DataFrame) -> DataFrame:
    """Structured alerts of candles with ratio, rsi, z and level columns: one row each."""
    kinds = {
        "volume": (F.col("ratio") >= 2, F.when(F.col("ratio") >= 4, "HIGH").otherwise("MEDIUM")),
        "rsi_high": (F.col("rsi") >= 70, F.when(F.col("rsi") >= 80, "HIGH").otherwise("MEDIUM")),
        "rsi_low": (F.col("rsi") <= 30, F.when(F.col("rsi") <= 20, "HIGH").otherwise("MEDIUM")),
        "breakout": (F.col("close") > F.col("level"), F.lit("HIGH")),
        "stretched": (F.abs("z") >= 2, F.lit("LOW")),
    }
    found = F.array_compact(F.array(*(F.when(rule, F.struct(F.lit(k).alias("kind"), s.alias("severity"))) for k, (rule, s) in kinds.items())))
    return rows.select("symbol", "ts", F.explode(found).alias("x")).select("symbol", "ts", "x.kind", "x.severity")


def funding(rates: DataFrame) -> DataFrame:
    """Mean funding of all symbols at each time, its sentiment, its move and the counts by sign."""
    out = rates.groupBy("ts").agg(
        F.avg("rate").alias("mean"), F.sum((F.col("rate") > 0).cast("int")).alias("positive"), F.sum((F.col("rate") < 0).cast("int")).alias("negative")
    )
    mood = F.when(F.col("mean") > 0.001, "very_bullish").when(F.col("mean") > 0.0003, "bullish").when(F.col("mean") > 0, "mild").when(F.col("mean") > -0.0003, "cautious").when(F.col("mean") > -0.001, "bearish").otherwise("very_bearish")
    before = F.lag("mean").over(Window.orderBy("ts"))
    return out.withColumn("sentiment", mood).withColumn("change", F.col("mean") - before)


def level_strength(levels: DataFrame, price: DataFrame) -> DataFrame:
    """Levels of several sources (symbol, source, price, weight, touches): how many other
    sources agree within 0.5 % and a score from touches, weight, agreement and nearness. Levels
    are a small table; both sides are dealt by symbol and logarithmic price step."""
    slot = lambda c: F.floor(F.log(c) / 0.005)
    near = levels.select("symbol", F.col("source").alias("other"), F.col("price").alias("at"), F.explode(F.array(slot(F.col("price")) - 1, slot(F.col("price")), slot(F.col("price")) + 1)).alias("_s"))
    met = levels.withColumn("_s", slot(F.col("price"))).join(near, ["symbol", "_s"]).where((F.col("other") != F.col("source")) & (F.abs(F.try_divide("at", "price") - 1) <= 0.005))
    counts = met.groupBy("symbol", "source", "price").agg(F.count_distinct("other").alias("agree"))
    rows = levels.join(counts, ["symbol", "source", "price"], "left").fillna(0, ["agree"]).join(price, "symbol")
    score = F.least("touches", F.lit(5)) * 5 + F.col("weight") * 25 + F.least("agree", F.lit(3)) * 10 + F.greatest(F.lit(0.0), 1 - F.abs(F.col("price") / F.col("last") - 1) * 10) * 20
    return rows.withColumn("score", score).withColumn("side", F.when(F.col("price") < F.col("last"), "support").otherwise("resistance"))


def asymmetry(scored: DataFrame) -> DataFrame:
    """Strength of support against resistance of each symbol."""
    out = scored.groupBy("symbol").agg(*(F.sum(F.when(F.col("side") == s, F.col("score")).otherwise(0.0)).alias(s) for s in ("support", "resistance")))
    ratio = F.try_divide(F.col("support"), F.col("resistance"))
    return out.withColumn("ratio", ratio).withColumn("bias", F.when(F.col("ratio") > 1.5, "bullish").when(F.col("ratio") < 1 / 1.5, "bearish").otherwise("balanced"))


def encode(events: DataFrame, category: str, mapping: dict[str, float], numbers: list[str]) -> DataFrame:
    """Feature vectors: a category by its map, numbers scaled to mean 0 and deviation 1 (both sums in one pass)."""
    stats = events.agg(*(F.avg(n).alias(f"{n}_m") for n in numbers), *(F.stddev_pop(n).alias(f"{n}_d") for n in numbers))
    code = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.col(category)]
    scaled = [F.coalesce(F.try_divide(F.col(n) - F.col(f"{n}_m"), F.col(f"{n}_d")), F.lit(0.0)) for n in numbers]
    rows = events.join(F.broadcast(stats))
    return rows.select(*events.columns, F.array(F.coalesce(code, F.lit(-1.0)), *scaled).alias("vector"))


def payload(df: DataFrame, key: str, sections: list[list[str]], budget: int) -> DataFrame:
    """Rows as JSON of as many sections of columns, in order, as the budget of characters holds."""
    names = [c for s in sections for c in s]
    forms = [F.to_json(F.struct(*(c for s in sections[: i + 1] for c in s))) for i in range(len(sections))]
    best = forms[0]
    for form in forms[1:]:
        best = F.when(F.length(form) <= budget, form).otherwise(best)
    return df.select(key, *names).select(key, best.alias("payload")).withColumn("size", F.length("payload"))
