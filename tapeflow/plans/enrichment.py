"""Queries: repair of records, enrichment of windows, regimes, levels, books and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, enrich, levels, repair
from ..operators import indicators as ind
from ..sources.tables import book_from_part, candles_from_orders, table
from .base import DAY, rounded, sql
from .trading import hours

#: Thirty years, by which order dates are moved into the range of valid epochs.
SHIFT = 946_684_800_000


def _records(spark, d):
    """Stored window records with planted disagreements, from orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    epoch = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.when(k % 11 == 0, 0).otherwise(SHIFT) + k % 7 * 1000
    rows = table(spark, d, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("symbol"), k.alias("seq"), epoch.alias("epoch_ms"), k.alias("k"), c.alias("c"))
    buy, sell = F.col("k") % 97 / 8.0, F.col("c") % 89 / 8.0
    rows = rows.withColumns({"buy": buy, "sell": sell, "sector_buy": F.col("k") % 13 / 8.0, "sector_sell": F.col("c") % 11 / 8.0})
    return rows.withColumns(
        {
            "first_seen": F.when(F.col("k") % 5 != 0, F.col("epoch_ms") - F.col("k") % 3 * 1000),
            "last_seen": F.when(F.col("k") % 9 != 0, F.col("epoch_ms") - F.col("c") % 4 * 500),
            "age_ms": F.when(F.col("k") % 2 == 0, F.lit(-5).cast("long")).otherwise(F.col("c")),
            "total": F.col("buy") + F.col("sell") + F.when(F.col("k") % 5 == 0, 0.5).otherwise(0.0),
            "delta": F.col("buy") - F.col("sell") + F.when(F.col("k") % 7 == 0, 1.0).otherwise(0.0),
            "whale_buy": F.when(F.col("k") % 3 != 0, F.col("sector_buy")),
            "whale_sell": F.col("sector_sell") + F.when(F.col("c") % 3 == 0, 0.25).otherwise(0.0),
            "whale_delta": F.when(F.col("k") % 2 == 0, F.col("sector_buy") - F.col("sector_sell")).otherwise(0.0),
            "poc_volume": F.col("k") % 16 / 8.0,
            "poc_percent": F.lit(10.0),
            "direction": F.when(F.col("k") % 2 == 0, "buying").otherwise("selling"),
        }
    )


def repair_times(spark, d):
    return repair.repair_times(_records(spark, d)).select("id", "first_seen", "last_seen", "age_ms")


def repair_volumes(spark, d):
    names = ("total", "delta", "whale_buy", "whale_sell", "whale_delta", "poc_percent", "direction", "corrected", "accepted")
    return rounded(repair.repair_volumes(_records(spark, d)).select("id", *names))


def repair_order(spark, d):
    return repair.repair_order(_records(spark, d), behind_ms=30 * DAY).select("id", "symbol", "epoch_ms")


def repair_all(spark, d):
    return rounded(repair.repaired(_records(spark, d)).select("id", "symbol", "epoch_ms", "first_seen", "last_seen", "age_ms", "total", "delta", "whale_delta"))


def repair_book_changes(spark, d):
    rows = book_from_part(spark, d).select("snapshot", ((F.col("qty") - 25) / 64).alias("change"))
    return repair.book_changes(rows.where("abs(change) < 0.35 OR snapshot > 'Brand#3'"))


def repair_digits(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 7).alias("price"), F.struct((F.col("l_quantity") / 7).alias("volume_ratio"), (F.col("l_tax") / 7).alias("other")).alias("part"))
    return repair.rounded_by_name(rows).select("l_orderkey", "l_linenumber", F.col("price"), F.col("part.volume_ratio").alias("volume_ratio"), F.round(F.col("part.other") + 1.7e-10, 6).alias("other"))


def record_evidence(spark, d):
    label = F.when(F.col("c") % 3 == 0, "buy_absorption").when(F.col("c") % 3 == 1, "sell_absorption").otherwise("none")
    rows = _records(spark, d).withColumns({"label": label, "eps": F.lit(1.0), "prob_up": F.col("k") % 100 / 100.0, "confidence": F.col("c") % 50 / 100.0, "warm": F.col("c") % 2 == 0})
    return repair.evidence(rows).select("id", "has_flow", "label_ok", "model_ok")


def record_reliability(spark, d):
    rows = _records(spark, d).withColumns(
        {
            "book_mode": F.when(F.col("k") % 5 == 0, "emergency").when(F.col("k") % 5 == 1, "cache").otherwise("live"),
            "latency_ms": F.col("c") % 20 * 1000,
            "anomaly": F.when(F.col("c") % 7 == 0, "HIGH").when(F.col("c") % 7 == 1, "MEDIUM").otherwise("NONE"),
        }
    )
    spread = repair.venue_spread([F.col("buy") + 100, F.col("sell") + 100, F.col("poc_volume") + 100])
    rows = repair.reliability(rows, ["first_seen", "last_seen", "whale_buy", "id"]).withColumn("venue_spread", spread)
    return rounded(rows.select("id", "completeness", "reliability", "quality", "venue_spread"))


def record_shown(spark, d):
    shown = repair.ui_rounded(F.col("buy") / 7, F.col("sell") / 7, 2)
    passive = repair.passive_share(F.when(F.col("k") % 4 == 0, 0.0).otherwise(F.col("buy")), F.when(F.col("k") % 4 == 0, 0.0).otherwise(F.col("sell")), 50.0 + F.col("c") % 3, 50.0 - F.col("c") % 3)
    return rounded(_records(spark, d).select("id", shown.alias("x"), passive.alias("passive")).select("id", "x.*", "passive"))


def frame_check(spark, d):
    return repair.checked_frame(candles_from_orders(spark, d), ["open", "close", "volume"], 50, ["close", "volume"])


def regime_gate(spark, d):
    k = F.col("c_custkey")
    pick = lambda of, *names: F.element_at(F.array(*map(F.lit, names)), (of % len(names) + 1).cast("int"))
    rows = table(spark, d, "customer").select(
        k.alias("id"), pick(k, "RISK_ON", "RISK_OFF", "TRANSITION", "UNCERTAIN").alias("market"), pick(F.col("c_nationkey"), "LOW_VOL", "NORMAL_VOL", "HIGH_VOL", "EXTREME_VOL").alias("volatility"),
        pick(k, "MACRO_CORRELATED", "CRYPTO_NATIVE").alias("correlation"), pick(F.col("c_nationkey"), "long", "short").alias("side"), (k % 100 / 100.0).alias("confidence"), (k % 13 == 0).alias("changing"),
        F.lit(2.0).alias("size"), (k % 40 * 1.0).alias("balance"), F.lit(1000.0).alias("entry"), F.lit(8.0).alias("atr"),
    )
    return rounded(enrich.gated(rows).select("id", "size_factor", "least_confidence", "reason", "adjusted_size", "stop", "target"))


def regime_shares(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    pick = lambda of, *names: F.element_at(F.array(*map(F.lit, names)), (of % len(names) + 1).cast("int"))
    rows = table(spark, d, "customer").select(
        k.alias("id"), (k % 70 * 1.0).alias("adx"), pick(k, "RANGE", "TREND_UP", "BREAKOUT_EXPECTED", "NONE").alias("profile"), (n * 2.0 - 20).alias("whale"), (k % 11 / 10.0).alias("imbalance"),
        pick(n, "accelerating", "reversal", "").alias("flow"), pick(k, "TRENDING", "RANGE_BOUND", "OTHER").alias("structure"),
    )
    return rounded(enrich.regime_probabilities(rows).select("id", "trending", "reverting", "breakout", "regime", "change", "lasts"), 4)


def ind_session(spark, d):
    return rounded(enrich.session_oscillators(candles_from_orders(spark, d)).select("symbol", "ts", "stoch_k", "stoch_d", "signal", "williams_r", "zone"))


def ind_sample_volatility(spark, d):
    return rounded(enrich.sample_volatility(candles_from_orders(spark, d)))


def ind_activity(spark, d):
    rows = candles_from_orders(spark, d).withColumn("atr", F.col("high") - F.col("low"))
    out = enrich.activity_regime(rows).withColumn("trend", enrich.trend_regime(F.col("volume") * 4, F.col("ts") % 7 / 250.0))
    return rounded(out.select("symbol", "ts", "volume_change", "activity", "trend"))


def ind_score_trend(spark, d):
    scores = candles_from_orders(spark, d).select("symbol", "ts", (F.col("volume") * 10).alias("score"))
    return rounded(enrich.score_trend(scores).select("symbol", "ts", "mean", "recent", "momentum", "direction"))


def ind_session_levels(spark, d):
    rows = enrich.session_fibonacci(candles_from_orders(spark, d))
    rows = rows.withColumn("cci_proxy", enrich.cci_proxy(F.col("close"), F.col("open"), F.col("high") - F.col("low")))
    return rounded(rows.select("symbol", "ts", "fib_236", "fib_382", "fib_500", "fib_618", "fib_786", "cci_proxy"))


def window_delta_norm(spark, d):
    return rounded(enrich.normalised_delta(hours(spark, d)).select("symbol", "window_end", "delta_norm"))


def _cvd_bars(spark, d):
    rows = candles_from_orders(spark, d)
    return rows.select("symbol", "ts", "close", (F.col("volume") * 3 - F.col("ts") / DAY % 11).alias("cvd"))


def cvd_divergences(spark, d):
    return rounded(enrich.cvd_divergence(_cvd_bars(spark, d)).select("symbol", "ts", "kind", "strength"))


def _flow_windows(spark, d):
    return hours(spark, d).withColumnRenamed("window_end", "ts")


def absorption_windows(spark, d):
    rows = enrich.absorbing_windows(_flow_windows(spark, d), volume_factor=1.2, narrow_percent=60.0, least_trades=2)
    return rounded(rows.select("symbol", "ts", "volume_ratio", "range_ratio", "absorber", "intensity", "level"))


def bars_flow_ratio(spark, d):
    rows = enrich.flow_bars(_flow_windows(spark, d))
    return rounded(rows.select("symbol", "ts", "ratio", "dominant", "price_change", "effective", "severity", "trend_score", "trend"))


def vp_parameters(spark, d):
    share = F.try_divide(F.abs(F.col("buy_volume") - F.col("sell_volume")), F.col("volume"))
    rows = hours(spark, d).withColumns({"atr": (F.col("high") - F.col("low")) * 1.5, "whale_share": F.col("n") % 7 / 10.0, "delta_share": share})
    return rounded(enrich.profile_parameters(rows).select("symbol", "window_end", "bins", "value_area", "sensitivity"))


def vp_checked(spark, d):
    rows = candles_from_orders(spark, d).select("symbol", "ts", F.col("close").alias("poc"), F.col("open").alias("vah"), F.col("low").alias("val"))
    return enrich.checked_profile(rows)


def vp_distances(spark, d):
    c = candles_from_orders(spark, d)
    prices = c.groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    nodes = c.select("symbol", F.when(F.col("volume") > 2, "HVN").otherwise("LVN").alias("kind"), F.col("close").alias("at"))
    return rounded(enrich.level_distances(prices, nodes, ["symbol"]))


def lvl_quick_score(spark, d):
    k = F.col("c_custkey")
    source = F.element_at(F.array(*map(F.lit, ("poc_daily", "ema_21_1d", "round_number", "other"))), (k % 4 + 1).cast("int"))
    return table(spark, d, "customer").select(k.alias("id"), enrich.quick_score(1000.0 + k % 64, F.lit(1024.0), source, F.col("c_nationkey") % 6).alias("score"))


def lvl_adaptive(spark, d):
    v = F.col("c_custkey") % 16 / 16.0
    return rounded(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), enrich.adaptive_thresholds(v).alias("x")).select("id", "x.*"))


def lvl_nearest_targets(spark, d):
    rows = candles_from_orders(spark, d).select(
        "symbol", "ts", F.col("close").alias("price"), ((F.col("high") - F.col("low")) * 0.2).alias("atr_15m"), ((F.col("high") - F.col("low")) * 0.5).alias("atr_1h"),
        F.col("high").alias("vah"), F.col("low").alias("val"), (F.col("open") * 1.1).alias("sell_defence"), (F.col("open") * 0.9).alias("buy_defence"),
    )
    rows = rows.where("atr_1h > 0")
    return rounded(enrich.nearest_targets(rows).select("symbol", "ts", "bull_5m", "bear_5m", "bull_15m", "bear_15m", "bull_1h", "bear_1h"), 4)


def lvl_recency(spark, d):
    c = candles_from_orders(spark, d)
    found = c.groupBy("symbol", F.floor(F.col("ts") / (60 * DAY)).alias("p")).agg(F.max_by("close", "ts").alias("price")).groupBy("symbol", "price").agg(F.count(F.lit(1)).alias("periods"))
    return rounded(enrich.recency(found, c))


def _clusters(spark, d):
    c = candles_from_orders(spark, d)
    return c.select("symbol", F.floor(F.col("close") / 40_000).cast("long").alias("cluster"), F.col("close").alias("price"))


def lvl_cluster_quality(spark, d):
    m = _clusters(spark, d)
    spans = m.groupBy("symbol").agg((F.max("price") - F.min("price")).alias("span"))
    return rounded(enrich.cluster_quality(m, spans))


def book_alerts(spark, d):
    rows = book_from_part(spark, d)
    value = lambda side: F.sum(F.when(F.col("side") == side, (F.col("price") * F.col("qty")).cast("decimal(28,6)")).otherwise(0)).cast("double")
    books = rows.groupBy("snapshot").agg(value("bid").alias("bid_value"), value("ask").alias("ask_value"), F.max("seq").alias("top"))
    books = books.withColumns({"imbalance": F.col("top") % 21 / 10.0 - 1, "spread_bps": F.col("top") % 90 * 1.0, "reload": F.col("top") % 2 == 0})
    return rounded(enrich.book_labels(books).select("snapshot", "imbalance", "label", "alerts", "is_critical", "is_emergency"))


def book_small_slippage(spark, d):
    k = F.col("c_custkey")
    at, depth, spread = F.when(k % 3 != 0, k % 50 / 10.0), k % 5000 * 1.0, k % 30 / 10.0
    out = table(spark, d, "customer").select(k.alias("id"), *(enrich.small_slippage(at, depth, spread, v).alias(f"at_{v}") for v in (1000, 10000)), enrich.depth_slope(depth, depth * 0.5 + 3, spread, at, F.lit(1000.0)).alias("slope"))
    return rounded(out.fillna({"slope": 0.0}))


def risk_liquidity(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("id"), F.when(k % 9 != 0, 100.0 + k % 5).alias("bid"), (106.0 + k % 3).alias("ask"), (k % 20 * 1.0).alias("size"), F.col("c_acctbal").alias("notional"))
    return rounded(enrich.margins(enrich.liquidity_risk(rows)).select("id", "spread_ratio", "slippage", "impact", "initial", "maintenance", "free"))


def signal_side(spark, d):
    k = F.col("c_custkey")
    label = F.element_at(F.array(*map(F.lit, ("Sell absorption", "BUY absorption seen", "Exhaustion"))), (k % 3 + 1).cast("int"))
    rows = table(spark, d, "customer").select(k.alias("id"), label.alias("label"), (k % 1200 - 600.0).alias("delta"), (F.col("c_nationkey") * 9000.0).alias("volume"), F.when(k % 4 != 0, k % 10 / 10.0).alias("imbalance"))
    return enrich.side_and_strength(rows).select("id", "side", "strength")


def corr_regime(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey") % 17 / 8.0 - 1).alias("c"))
    return rows.select("id", enrich.correlation_regime(F.col("c")).alias("regime"))


QUERIES = (
    repair_times, repair_volumes, repair_order, repair_all, repair_book_changes, repair_digits, record_evidence, record_reliability, record_shown, frame_check, regime_gate, regime_shares,
    ind_session, ind_sample_volatility, ind_activity, ind_score_trend, ind_session_levels, window_delta_norm, cvd_divergences, absorption_windows, bars_flow_ratio, vp_parameters, vp_checked, vp_distances,
    lvl_quick_score, lvl_adaptive, lvl_nearest_targets, lvl_recency, lvl_cluster_quality, book_alerts, book_small_slippage, risk_liquidity, signal_side, corr_regime,
)

_L = "(PARTITION BY symbol ORDER BY ts)"


def _w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_REC = f"""r0 AS (SELECT o_orderkey AS id, o_orderpriority AS symbol, o_orderkey AS seq, o_orderkey AS k, o_custkey AS c, epoch_us(o_orderdate) // 1000 + CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE {SHIFT} END + o_orderkey % 7 * 1000 AS epoch_ms FROM orders),
    rec AS (SELECT *, (k % 97) / 8.0::DOUBLE AS buy, (c % 89) / 8.0::DOUBLE AS sell, (k % 13) / 8.0::DOUBLE AS sector_buy, (c % 11) / 8.0::DOUBLE AS sector_sell, CASE WHEN k % 5 <> 0 THEN epoch_ms - k % 3 * 1000 END AS fs, CASE WHEN k % 9 <> 0 THEN epoch_ms - c % 4 * 500 END AS ls,
    CASE WHEN k % 2 = 0 THEN -5 ELSE c END AS age, (k % 16) / 8.0::DOUBLE AS poc FROM r0)"""
_TIMES = """tm AS (SELECT id, symbol, seq, epoch_ms, k, c, CASE WHEN fs IS NULL THEN least(ls, epoch_ms) WHEN ls IS NULL THEN fs ELSE least(fs, ls) END AS first_seen, CASE WHEN ls IS NULL THEN greatest(fs, epoch_ms) WHEN fs IS NULL THEN ls ELSE greatest(fs, ls) END AS last_seen, age
    FROM rec WHERE epoch_ms BETWEEN 1609459200000 AND 2147483647000)"""
_TIMED = "SELECT id, first_seen, last_seen, CASE WHEN age < 0 THEN greatest(0, epoch_ms - last_seen) ELSE age END AS age_ms FROM tm"
_VOLUMES = """vo AS (SELECT id, k, c, buy, sell, buy + sell AS total, buy - sell AS delta, CASE WHEN k % 3 <> 0 THEN sector_buy WHEN sector_buy > 2e-4 THEN sector_buy END AS whale_buy, sector_sell AS whale_sell, sector_buy, sector_sell, poc,
    concat_ws(',', CASE WHEN k % 5 = 0 THEN 'total' END, CASE WHEN k % 7 = 0 THEN 'delta' END, CASE WHEN k % 3 = 0 AND sector_buy > 2e-4 THEN 'whale_buy' END, CASE WHEN c % 3 = 0 THEN 'whale_sell' END) AS fixed FROM rec),
    wd AS (SELECT *, CASE WHEN k % 2 = 0 THEN sector_buy - sector_sell ELSE 0 END AS stored, whale_buy - whale_sell AS whale_true FROM vo),
    w2 AS (SELECT *, CASE WHEN abs(stored - whale_true) > 2e-4 THEN whale_true ELSE stored END AS whale_delta, CASE WHEN poc > 0 AND total > 0 AND abs(10 - poc / total * 100) > 0.1 THEN round(poc / total * 100, 2) ELSE 10 END AS poc_percent, CASE WHEN k % 2 = 0 THEN 'buying' ELSE 'selling' END AS d0 FROM wd),
    w3 AS (SELECT *, CASE WHEN whale_delta > 2e-4 AND d0 = 'selling' THEN 'buying' WHEN whale_delta < -2e-4 AND d0 = 'buying' THEN 'selling' ELSE d0 END AS direction,
    coalesce(whale_buy > buy + 2e-4, false) OR whale_sell > sell + 2e-4 AS too_large FROM w2)"""
_ACCEPTED = "CASE WHEN whale_sell > sell + 2e-4 THEN false WHEN whale_buy IS NULL THEN NULL ELSE NOT whale_buy > buy + 2e-4 END"


def _pick(of: str, *names: str) -> str:
    return f"[{', '.join(repr(n) for n in names)}][CAST({of} % {len(names)} + 1 AS BIGINT)]"


_GATE = f"""g AS (SELECT c_custkey AS id, {_pick('c_custkey', 'RISK_ON', 'RISK_OFF', 'TRANSITION', 'UNCERTAIN')} AS m, {_pick('c_nationkey', 'LOW_VOL', 'NORMAL_VOL', 'HIGH_VOL', 'EXTREME_VOL')} AS v, {_pick('c_custkey', 'MACRO_CORRELATED', 'CRYPTO_NATIVE')} AS co,
    {_pick('c_nationkey', 'long', 'short')} AS side, (c_custkey % 100) / 100.0::DOUBLE AS conf, c_custkey % 13 = 0 AS changing, (c_custkey % 40)::DOUBLE AS balance FROM customer),
    rules(n, m, v, co, sf, st, tf, lc, sides, conf2) AS (VALUES (1, 'RISK_ON', ['LOW_VOL'], NULL, 1.25, 0.8, 1.2, 0.55, 'long,short', false), (2, 'RISK_ON', ['NORMAL_VOL'], NULL, 1.0, 1.0, 1.0, 0.60, 'long,short', false),
    (3, 'RISK_OFF', ['HIGH_VOL', 'EXTREME_VOL'], NULL, 0.5, 1.5, 0.8, 0.75, 'short', true), (4, 'RISK_OFF', NULL, NULL, 0.75, 1.2, 0.9, 0.65, 'long,short', true), (5, 'TRANSITION', NULL, NULL, 0.5, 1.3, 0.8, 0.70, 'long,short', true),
    (6, NULL, ['EXTREME_VOL'], NULL, 0.0, 2.0, 0.5, 0.90, 'none', true), (7, NULL, NULL, 'CRYPTO_NATIVE', 1.0, 1.0, 1.0, 0.60, 'long,short', false), (8, NULL, NULL, NULL, 0.75, 1.2, 1.0, 0.65, 'long,short', false)),
    gr AS (SELECT g.*, r.n, sf::DOUBLE AS sf, st::DOUBLE AS st, tf::DOUBLE AS tf, lc::DOUBLE AS lc, sides, conf2 FROM g JOIN rules r ON (r.m IS NULL OR r.m = g.m) AND (r.v IS NULL OR list_contains(r.v, g.v)) AND (r.co IS NULL OR r.co = g.co) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n) = 1),
    gw AS (SELECT *, CASE WHEN sides = 'none' THEN 'no_trading' WHEN NOT contains(sides, side) THEN 'side' WHEN conf < lc THEN 'confidence' WHEN changing AND conf2 THEN 'changing' WHEN sf = 0 THEN 'size' ELSE 'ok' END AS reason FROM gr)"""
_SHARES = f"""p AS (SELECT c_custkey AS id, (c_custkey % 70)::DOUBLE AS adx, {_pick('c_custkey', 'RANGE', 'TREND_UP', 'BREAKOUT_EXPECTED', 'NONE')} AS pr, abs(c_nationkey * 2 - 20) AS wh, c_custkey % 11 AS im, {_pick('c_nationkey', 'accelerating', 'reversal', '')} AS fl,
    {_pick('c_custkey', 'TRENDING', 'RANGE_BOUND', 'OTHER')} AS st FROM customer),
    q AS (SELECT *, CASE WHEN adx > 50 THEN 0.4 WHEN adx > 35 THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN pr = 'TREND_UP' THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN im >= 8 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN fl = 'accelerating' THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN st = 'TRENDING' THEN 0.2 ELSE 0 END::DOUBLE AS t,
    CASE WHEN adx < 20 THEN 0.3 WHEN adx <= 35 THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN pr = 'RANGE' THEN 0.25 ELSE 0 END::DOUBLE + CASE WHEN fl = 'reversal' THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN st = 'RANGE_BOUND' THEN 0.2 ELSE 0 END::DOUBLE AS r,
    CASE WHEN pr = 'BREAKOUT_EXPECTED' THEN 0.35 ELSE 0 END::DOUBLE + CASE WHEN wh >= 30 THEN 0.2 WHEN wh >= 15 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN im >= 8 THEN 0.25 WHEN im >= 5 THEN 0.1 ELSE 0 END::DOUBLE AS b FROM p),
    s AS (SELECT *, CASE WHEN t + r + b > 0 THEN t / (t + r + b) ELSE 0.33::DOUBLE END AS pt, CASE WHEN t + r + b > 0 THEN r / (t + r + b) ELSE 0.5::DOUBLE END AS pm FROM q), u AS (SELECT *, greatest(0::DOUBLE, 1 - pt - pm) AS pb FROM s),
    x AS (SELECT *, CASE WHEN pt >= greatest(pt, pm, pb) - 1e-9 THEN 'TRENDING' WHEN pm >= greatest(pt, pm, pb) - 1e-9 THEN 'MEAN_REVERTING' ELSE 'BREAKOUT' END AS regime FROM u)"""

ORACLE = {
    "repair_times": sql(more=f"{_REC}, {_TIMES}", select=_TIMED),
    "repair_volumes": sql(more=f"{_REC}, {_VOLUMES}", select=f"""SELECT id, round(total, 6) AS total, round(delta, 6) AS delta, round(whale_buy, 6) AS whale_buy, round(whale_sell, 6) AS whale_sell, round(whale_delta, 6) AS whale_delta, round(poc_percent, 6) AS poc_percent, direction, concat_ws(',', nullif(fixed, ''), CASE WHEN whale_delta <> stored THEN 'whale_delta' END,
        CASE WHEN poc_percent <> 10 THEN 'poc_percent' END, CASE WHEN direction <> d0 THEN 'direction' END) AS corrected, {_ACCEPTED} AS accepted FROM w3"""),
    "repair_order": sql(more=_REC, select=f"""SELECT id, symbol, epoch_ms FROM (SELECT *, max(CASE WHEN epoch_ms % 60000 <> 0 THEN epoch_ms END) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS seen FROM rec) WHERE seen IS NULL OR seen - epoch_ms <= {30 * DAY}"""),
    "repair_all": sql(more=f"{_REC}, {_TIMES}, {_VOLUMES}, td AS ({_TIMED})", select=f"""SELECT id, symbol, epoch_ms, first_seen, last_seen, age_ms, round(total, 6) AS total, round(delta, 6) AS delta, round(whale_delta, 6) AS whale_delta FROM (SELECT tm.id, tm.symbol, tm.seq, tm.epoch_ms, td.first_seen, td.last_seen, age_ms, total, delta, whale_delta,
        max(CASE WHEN epoch_ms % 60000 <> 0 THEN epoch_ms END) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS seen FROM tm JOIN td USING (id) JOIN w3 USING (id) WHERE {_ACCEPTED}) WHERE seen IS NULL OR seen - epoch_ms <= 5000 QUALIFY row_number() OVER (PARTITION BY symbol, epoch_ms ORDER BY seq) = 1"""),
    "repair_book_changes": sql("book", select="SELECT snapshot, max(abs(qty - 25) / 64) AS largest, max(abs(qty - 25) / 64) <= 0.3 AS accepted FROM book WHERE abs(qty - 25) / 64 < 0.35 OR snapshot > 'Brand#3' GROUP BY 1"),
    "repair_digits": "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 4) AS price, round(l_quantity / 7, 8) AS volume_ratio, round(l_tax / 7, 6) AS other FROM lineitem",
    "record_evidence": sql(more=f"{_REC}, rw AS (SELECT *, buy - sell + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS delta, buy + sell + CASE WHEN k % 5 = 0 THEN 0.5 ELSE 0 END AS total, CASE WHEN k % 2 = 0 THEN sector_buy - sector_sell ELSE 0 END AS wd FROM rec)",
        select="""SELECT id, total > 0 OR delta <> 0 OR wd <> 0 AS has_flow, CASE WHEN c % 3 = 0 THEN delta < -1 WHEN c % 3 = 1 THEN delta > 1 ELSE true END AS label_ok, CASE WHEN k % 100 > 95 OR k % 100 < 5 THEN c % 2 = 0 ELSE c % 50 >= 10 END AS model_ok FROM rw"""),
    "record_reliability": sql(more=f"""{_REC}, rl AS (SELECT *, ((fs IS NOT NULL)::INT + (ls IS NOT NULL)::INT + (k % 3 <> 0)::INT + 1) * 25.0::DOUBLE AS co, 10.0::DOUBLE - CASE WHEN k % 5 = 0 THEN 3 WHEN k % 5 = 1 THEN 1.5 ELSE 0 END - CASE WHEN c % 20 > 15 THEN 1 WHEN c % 20 > 8 THEN 0.5 ELSE 0 END
        - CASE WHEN c % 7 = 0 THEN 2 WHEN c % 7 = 1 THEN 0.5 ELSE 0 END AS re, (buy + sell + poc + 300) / 3 AS mean FROM rec)""",
        select="""SELECT id, round(co, 6) AS completeness, round(re, 6) AS reliability, round(co / 20 + re / 2, 6) AS quality, round(least(0.5::DOUBLE, greatest(abs(buy + 100 - mean), abs(sell + 100 - mean), abs(poc + 100 - mean)) / mean * 100), 6) AS venue_spread FROM rl"""),
    "record_shown": sql(more=f"{_REC}, sh AS (SELECT *, round(CAST(buy / 7 AS DECIMAL(28,10)), 2) AS b, round(CAST(sell / 7 AS DECIMAL(28,10)), 2) AS s FROM rec)",
        select="""SELECT id, b::DOUBLE AS buy, s::DOUBLE AS sell, (b + s)::DOUBLE AS total, round(CASE WHEN k % 4 <> 0 AND buy + sell > 0 THEN buy / (buy + sell) * 100 WHEN c % 3 <> 0 THEN 50 - c % 3 ELSE 50 END, 6) AS passive FROM sh"""),
    "frame_check": sql("candles", select="SELECT count(*) AS n, 0 AS nulls, count(*) FILTER (close <= 0 OR volume <= 0) AS not_positive, count(*) >= 50 AND count(*) FILTER (close <= 0 OR volume <= 0) = 0 AS sound FROM candles"),
    "regime_gate": sql(more=_GATE, select="""SELECT id, round(sf, 6) AS size_factor, round(lc, 6) AS least_confidence, reason, round(CASE WHEN reason = 'ok' THEN least(2 * sf, 4, balance * 0.1::DOUBLE) END, 6) AS adjusted_size,
        round(CASE WHEN reason = 'ok' THEN 1000 - CASE WHEN side = 'long' THEN 1 ELSE -1 END * 12 * st END, 6) AS stop, round(CASE WHEN reason = 'ok' THEN 1000 + CASE WHEN side = 'long' THEN 1 ELSE -1 END * 24 * tf END, 6) AS target FROM gw"""),
    "regime_shares": sql(more=_SHARES, select="""SELECT id, round(pt, 4) AS trending, round(pm, 4) AS reverting, round(pb, 4) AS breakout, regime, round(least(0.95::DOUBLE, greatest(0.05::DOUBLE, pb + (0.5 - abs(0.5 - pt)) * 0.3)), 4) AS "change",
        CASE WHEN regime = 'TRENDING' THEN CASE WHEN adx < 50 THEN '30m-2h' ELSE '2h-8h' END WHEN regime = 'MEAN_REVERTING' THEN '15m-1h' ELSE '5m-30m' END AS lasts FROM x"""),
    "ind_session": sql("candles", more=f"""a AS (SELECT *, max(high) OVER w AS hh, min(low) OVER w AS ll, count(close) OVER w >= 14 AS f FROM candles WINDOW w AS {_w(14)}), b AS (SELECT *, CASE WHEN f THEN CASE WHEN hh > ll THEN (close - ll) / (hh - ll) * 100 ELSE 50 END END AS k FROM a),
        c AS (SELECT *, avg(k) OVER {_w(3)} AS d, (hh - close) / (hh - ll) * -100 AS wr FROM b)""", select="""SELECT symbol, ts, round(k, 6) AS stoch_k, round(d, 6) AS stoch_d, CASE WHEN round(k, 2) < 20 AND round(d, 2) < 20 THEN 'OVERSOLD' WHEN round(k, 2) > 80 AND round(d, 2) > 80 THEN 'OVERBOUGHT'
        WHEN round(k, 2) > round(d, 2) THEN 'BULLISH' WHEN round(k, 2) < round(d, 2) THEN 'BEARISH' ELSE 'NEUTRAL' END AS signal, round(wr, 6) AS williams_r, CASE WHEN wr > -20 THEN 'overbought' WHEN wr < -80 THEN 'oversold' ELSE 'neutral' END AS zone FROM c WHERE f AND hh > ll"""),
    "ind_sample_volatility": sql("candles", select=f"SELECT symbol, round(stddev_samp(r), 6) AS volatility, count(*) AS n FROM (SELECT symbol, ln(close / lag(close) OVER {_L}) AS r FROM candles) WHERE r IS NOT NULL GROUP BY 1"),
    "ind_activity": sql("candles", more=f"a AS (SELECT symbol, ts, volume, volume / avg(volume) OVER {_w(50)} AS vc, (high - low) / close > 0.01 AS w FROM candles)", select="""SELECT symbol, ts, round(vc, 6) AS volume_change, CASE WHEN w AND vc < 0.8 THEN 'manipulation' WHEN w AND vc > 1.2 THEN 'institutional'
        WHEN NOT w AND vc < 0.8 THEN 'range' ELSE 'accumulation' END AS activity, CASE WHEN ts % 7 >= 5 THEN 'High Volatility' WHEN volume * 4 > 25 THEN 'Trending' ELSE 'Range' END AS trend FROM a"""),
    "ind_score_trend": sql("candles", more=f"a AS (SELECT symbol, ts, volume * 10 AS s, avg(volume * 10) OVER {_w(30)} AS m, avg(volume * 10) OVER {_w(5)} AS r, count(volume) OVER {_w(30)} AS n FROM candles)",
        select="""SELECT symbol, ts, round(m, 6) AS mean, round(r, 6) AS recent, round(s - m, 6) AS momentum, CASE WHEN n < 3 THEN 'insufficient_data' WHEN r > m + 5 THEN 'increasing_accumulation' WHEN r < m - 5 THEN 'increasing_distribution' ELSE 'stable' END AS direction FROM a"""),
    "ind_session_levels": sql("candles", select="SELECT symbol, ts" + "".join(f", round(low + (high - low) * {share}, 6) AS fib_{n}" for n, share in (("236", 0.236), ("382", 0.382), ("500", 0.5), ("618", 0.618), ("786", 0.786)))
        + ", round((close - open) / ((high - low) * (0.015::DOUBLE / 4)), 6) AS cci_proxy FROM candles WHERE high > low AND (low <= 0 OR (high - low) / low >= 0.003)"),
    "window_delta_norm": sql("trades", "sided", "hours", select="SELECT symbol, window_end, round((buy_volume - sell_volume) / greatest(high - low, close * 0.0001::DOUBLE), 6) AS delta_norm FROM hours"),
    "cvd_divergences": sql("candles", more=f"b AS (SELECT symbol, ts, close, volume * 3 - (ts / {DAY}) % 11 AS cvd FROM candles), a AS (SELECT *, (close - lag(close, 9) OVER w) / lag(close, 9) OVER w AS pc, cvd - lag(cvd, 9) OVER w AS cc, row_number() OVER w AS n FROM b WINDOW w AS {_L})",
        select="SELECT symbol, ts, CASE WHEN pc > 0 THEN 'bearish' ELSE 'bullish' END AS kind, round(least(abs(pc) * 100, 1.0::DOUBLE), 6) AS strength FROM a WHERE n > 10 AND (pc > 0) <> (cc > 0)"),
    "absorption_windows": sql("trades", "sided", "hours", more=f"""fw AS (SELECT *, window_end AS ts, (high - low) / ((high + low) / 2) * 100 AS rp FROM hours), a AS (SELECT *, volume / avg(volume) OVER w AS vr, rp / nullif(avg(rp) OVER w, 0) AS rr, count(volume) OVER w AS kk FROM fw WINDOW w AS {_w(100)})""",
        select="""SELECT symbol, ts, round(vr, 6) AS volume_ratio, round(rr, 6) AS range_ratio, CASE WHEN buy_volume > sell_volume * 1.5 THEN 'sell' WHEN sell_volume > buy_volume * 1.5 THEN 'buy' ELSE 'unknown' END AS absorber, round(least(1.0::DOUBLE, vr / 1.2 * 0.5 + (1 - least(rr, 1.0::DOUBLE)) * 0.5), 6) AS intensity,
        round((high + low) / 2, 6) AS level FROM a WHERE kk >= 5 AND n >= 2 AND vr >= 1.2 AND (rp < 60 OR rr < 0.5)"""),
    "bars_flow_ratio": sql("trades", "sided", "hours", more=f"""fb AS (SELECT symbol, window_end AS ts, open, close, buy_volume AS b, sell_volume AS s, CASE WHEN sell_volume > 0 THEN buy_volume / sell_volume END AS ratio, CASE WHEN buy_volume > sell_volume THEN 'buy' WHEN sell_volume > buy_volume THEN 'sell' ELSE 'unknown' END AS dominant FROM hours),
        fe AS (SELECT *, CASE WHEN b = 0 AND s = 0 THEN 1 WHEN b = 0 OR s = 0 THEN 100 ELSE greatest(ratio, 1 / ratio) END AS e FROM fb), fv AS (SELECT *, count(*) FILTER (dominant = 'buy') OVER w AS vb, count(*) FILTER (dominant = 'sell') OVER w AS vs, count(*) OVER w AS vn FROM fe WINDOW w AS {_w(5)}),
        ft AS (SELECT *, CASE WHEN vn < 5 THEN 0 WHEN vb > vs THEN vb / 5.0::DOUBLE WHEN vs > vb THEN -vs / 5.0::DOUBLE ELSE 0 END AS sc FROM fv)""",
        select="""SELECT symbol, ts, round(ratio, 6) AS ratio, dominant, round((close - open) / open * 100, 6) AS price_change, round(e, 6) AS effective, CASE WHEN e >= 5 THEN 'extreme' WHEN e >= 3 THEN 'strong' WHEN e >= 2 THEN 'moderate' END AS severity, round(sc, 6) AS trend_score, CASE WHEN sc > 0 THEN 'bullish' WHEN sc < 0 THEN 'bearish' ELSE 'neutral' END AS trend FROM ft"""),
    "vp_parameters": sql("trades", "sided", "hours", more="""v AS (SELECT *, greatest(0.5::DOUBLE, least(2.0::DOUBLE, (high - low) * 1.5 / close)) AS a, greatest(0.8::DOUBLE, least(1.5::DOUBLE, 1 + (n % 7) / 10.0::DOUBLE)) AS w, greatest(0.7::DOUBLE, least(1.3::DOUBLE, 1 + abs(buy_volume - sell_volume) / volume)) AS t FROM hours)""",
        select="""SELECT symbol, window_end, CASE WHEN n >= 10 THEN greatest(10, least(50, floor(round(20 * a * w * t, 9))::INT)) ELSE 20 END AS bins, round(CASE WHEN n >= 10 THEN greatest(0.6::DOUBLE, least(0.8::DOUBLE, 0.7 + (a - 1) * 0.1)) ELSE 0.7 END, 6) AS value_area,
        round(CASE WHEN n >= 10 THEN greatest(0.5::DOUBLE, least(2.0::DOUBLE, 2 - a)) ELSE 1 END, 6) AS sensitivity FROM v"""),
    "vp_checked": sql("candles", select="""SELECT symbol, ts, close AS poc, greatest(open, low) AS vah, least(open, low) AS val, CASE WHEN close = 0 THEN 'no_data' WHEN abs(open - low) / close * 100 < 0.05 THEN 'insufficient_data' ELSE 'success' END AS status FROM candles"""),
    "vp_distances": sql("candles", more="p AS (SELECT symbol, arg_max(close, ts) AS price FROM candles GROUP BY 1), n AS (SELECT symbol, CASE WHEN volume > 2 THEN 'HVN' ELSE 'LVN' END AS kind, close AS node FROM candles)",
        select="SELECT symbol, round(price, 6) AS price, kind, round(min(abs(price - node) / price * 100), 6) AS distance, count(*) FILTER (abs(price - node) / price * 100 <= 0.5) AS near FROM p JOIN n USING (symbol) GROUP BY symbol, price, kind"),
    "lvl_quick_score": "SELECT c_custkey AS id, least(100, [20, 16, 10, 10][c_custkey % 4 + 1] + least(30, c_nationkey % 6 * 8) + greatest(0, trunc(20 - abs(c_custkey % 64 - 24) / 1024 * 300)::INT)) AS score FROM customer",
    "lvl_adaptive": sql(more="a AS (SELECT c_custkey AS id, greatest(0.5::DOUBLE, least(2.0::DOUBLE, 0.5 / CASE WHEN c_custkey % 16 > 0 THEN (c_custkey % 16) / 16.0::DOUBLE ELSE 0.03 END)) AS f FROM customer)", select="SELECT id, round(f, 6) AS factor, round(f * 0.15::DOUBLE, 6) AS absorption, round(f * 0.1::DOUBLE, 6) AS flow FROM a"),
    "lvl_nearest_targets": sql("candles", more="t AS (SELECT symbol, ts, close AS p, (high - low) * 0.2::DOUBLE AS a, (high - low) * 0.5::DOUBLE AS h, high AS u, low AS l, open * 1.1::DOUBLE AS s, open * 0.9::DOUBLE AS b FROM candles WHERE high > low)",
        select="SELECT symbol, ts" + "".join(f""", round(least(p + a * {x}::DOUBLE, CASE WHEN s > p THEN s END, CASE WHEN u > p THEN u END), 4) AS bull_{n}, round(greatest(p - a * {x}::DOUBLE, CASE WHEN b < p THEN b END, CASE WHEN l < p THEN l END), 4) AS bear_{n}""" for n, x in (("5m", 0.3), ("15m", 0.7)))
        + ", round(least(p + h * 1.2::DOUBLE, CASE WHEN u > p THEN u END), 4) AS bull_1h, round(greatest(p - h * 1.2::DOUBLE, CASE WHEN l < p THEN l END), 4) AS bear_1h FROM t"),
    "lvl_recency": sql("candles", more=f"""pe AS (SELECT symbol, ts // {60 * DAY} AS p, arg_max(close, ts) AS price FROM candles GROUP BY 1, 2), lv AS (SELECT symbol, price, count(*) AS periods FROM pe GROUP BY 1, 2), nb AS (SELECT symbol, close, row_number() OVER {_L} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM candles),
        tc AS (SELECT lv.symbol, price, periods, max(i) AS last, count(*) FILTER (i >= n - least(50, n)) AS recent, any_value(n) AS n FROM lv JOIN nb ON nb.symbol = lv.symbol AND abs(close - price) <= price * 0.005::DOUBLE GROUP BY 1, 2, 3)""",
        select="SELECT symbol, round(price, 6) AS price, periods, last AS last_touch, recent AS recent_touches, round(greatest(0.0::DOUBLE, least(10.0::DOUBLE, (1 - (n - 1 - last) / nullif(n - 1, 0)) * 10)), 6) AS score FROM tc"),
    "lvl_cluster_quality": sql("candles", more="""m AS (SELECT symbol, floor(close / 40000)::BIGINT AS cluster, close AS price FROM candles), z AS (SELECT symbol, max(price) - min(price) AS span FROM m GROUP BY 1), q AS (SELECT symbol, cluster, quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM m GROUP BY 1, 2),
        g AS (SELECT symbol, cluster, count(*) AS n, max(price) - min(price) AS r, stddev_pop(price) / abs(avg(price)) AS cv, count(*) FILTER (b > a AND (price < a - 1.5 * (b - a) OR price > b + 1.5 * (b - a))) AS o FROM m JOIN q USING (symbol, cluster) GROUP BY 1, 2),
        h AS (SELECT *, CASE WHEN n < 3 THEN 0 ELSE 10 * (1 - least(coalesce(r / nullif(span, 0), 0) * 10, 1.0::DOUBLE)) * 0.4 + 10 * (1 - least(coalesce(cv, 0) * 5, 1.0::DOUBLE)) * 0.4 + 10 * (1 - o / n) * 0.2 END AS s FROM g JOIN z USING (symbol))""",
        select="SELECT symbol, cluster, n, CASE WHEN n < 3 THEN 0 ELSE o END AS outliers, round(s, 6) AS score, CASE WHEN n < 3 THEN 'insufficient' WHEN s >= 8 THEN 'excellent' WHEN s >= 6 THEN 'good' WHEN s >= 4 THEN 'moderate' ELSE 'poor' END AS quality FROM h"),
    "book_alerts": sql("book", more="""bk AS (SELECT snapshot, sum(CAST(CASE WHEN side = 'bid' THEN price * qty ELSE 0 END AS DECIMAL(28,6)))::DOUBLE AS bv, sum(CAST(CASE WHEN side = 'ask' THEN price * qty ELSE 0 END AS DECIMAL(28,6)))::DOUBLE AS av, max(seq) AS top FROM book GROUP BY 1),
        bi AS (SELECT *, (top % 21) / 10.0::DOUBLE - 1 AS i, (top % 90)::DOUBLE AS sp FROM bk), bc AS (SELECT *, abs(i) >= 0.95 AND (sp >= 50 OR coalesce(greatest(bv / nullif(av, 0), av / nullif(bv, 0)) >= 20, bv = 0 OR av = 0) OR greatest(bv, av) >= 2000000) AS cr, abs(i) >= 0.9 AND sp < 50 AS em FROM bi)""",
        select="""SELECT snapshot, round(i, 6) AS imbalance, CASE WHEN i > 0.4 THEN 'demand' WHEN i < -0.4 THEN 'supply' WHEN i > 0 THEN 'light_demand' WHEN i < 0 THEN 'light_supply' ELSE 'balance' END AS label, concat_ws(',', CASE WHEN abs(i) >= 0.4 THEN 'imbalance' END, CASE WHEN top % 2 = 0 THEN 'reload' END,
        CASE WHEN sp <= 0.2 THEN 'tight' END, CASE WHEN cr THEN 'critical' WHEN em THEN 'emergency' END) AS alerts, cr AS is_critical, em AS is_emergency FROM bc"""),
    "book_small_slippage": sql(more="s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 50) / 10.0::DOUBLE END AS a, (c_custkey % 5000)::DOUBLE AS d, (c_custkey % 30) / 10.0::DOUBLE AS sp FROM customer)",
        select="SELECT id" + "".join(f", round(CASE WHEN a > 0 THEN a * {v / 100000} ELSE {v}::DOUBLE / greatest(d, 1000) * sp END, 6) AS at_{v}" for v in (1000, 10000))
        + ", round(coalesce((d * (1 - 10.25::DOUBLE) + (d * 0.5 + 3) * (5 - 10.25::DOUBLE) + sp * (10 - 10.25::DOUBLE) + a * (25 - 10.25::DOUBLE)) / 330.75 / 1000, 0), 6) AS slope FROM s"),
    "risk_liquidity": sql(more="""l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 <> 0 THEN 100.0::DOUBLE + c_custkey % 5 END AS b, 106.0::DOUBLE + c_custkey % 3 AS a, (c_custkey % 20)::DOUBLE AS s, c_acctbal AS v FROM customer), m AS (SELECT *, coalesce((a - b) / ((a + b) / 2), 0) AS r FROM l)""",
        select="SELECT id, round(r, 6) AS spread_ratio, round(r * s, 6) AS slippage, round(r * s * 1.5, 6) AS impact, round(v * 0.1::DOUBLE, 6) AS initial, round(v * 0.08::DOUBLE, 6) AS maintenance, round(v * 0.05::DOUBLE, 6) AS free FROM m"),
    "signal_side": sql(more="s AS (SELECT c_custkey AS id, c_custkey % 3 AS l, (abs(c_custkey % 1200 - 600) >= 500)::INT + (c_nationkey * 9000 >= 100000)::INT + (c_custkey % 4 <> 0 AND c_custkey % 10 >= 6)::INT AS h FROM customer)",
        select="SELECT id, CASE l WHEN 0 THEN 'buy' WHEN 1 THEN 'sell' ELSE 'none' END AS side, CASE WHEN h >= 3 THEN 'strong' WHEN h >= 2 THEN 'medium' ELSE 'weak' END AS strength FROM s"),
    "corr_regime": "SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'UNKNOWN' WHEN c_custkey % 17 < 5 THEN 'INVERSE' WHEN c_custkey % 17 BETWEEN 7 AND 9 THEN 'DECORRELATED' ELSE 'CORRELATED' END AS regime FROM customer",
}
