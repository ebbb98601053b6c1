"""Queries: checks, trackers, scores and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars, models, profile
from ..operators import decisions as dec
from ..operators import indicators as ind
from ..operators import levels
from ..sources.tables import candles_from_orders, table
from .base import DAY, rounded, sql
from .trading import hours, sided


def _candles(spark, d):
    return candles_from_orders(spark, d)


def audit_windows(spark, d):
    return dec.audit(hours(spark, d)).select("symbol", "window_end", "broken", "consistent")


def score_quality(spark, d):
    rows = ind.adx(ind.rsi(_candles(spark, d)))
    return rounded(dec.completeness(rows, ["open", "close"], ["rsi", "plus_di"], ["adx"]).select("symbol", "ts", "score", "grade"))


def anomaly_z(spark, d):
    c = _candles(spark, d)
    stats = c.groupBy("symbol").agg(F.avg("high").alias("mean"), (F.stddev_pop("high") * 0.4).alias("deviation"))
    return rounded(dec.anomalies(c.select("symbol", "ts", "high"), stats, "high"), 4)


def vwap_zones(spark, d):
    t = sided(spark, d)
    rows = profile.vwap_bands(t, DAY).join(bars.ohlcv(t, DAY).select("symbol", "window_end", "close"), ["symbol", "window_end"])
    distance = F.try_divide(F.col("close") - F.col("vwap"), F.col("deviation"))
    return rounded(rows.select("symbol", "window_end", distance.alias("distance")).withColumn("zone", dec.vwap_zone(F.col("distance"))), 4)


def _spreads(spark, d):
    return _candles(spark, d).select("symbol", "ts", ((F.col("high") - F.col("low")) / F.col("low")).alias("spread"))


def ind_spread_percentile(spark, d):
    return rounded(dec.spread_tracker(_spreads(spark, d), 24, 2.0), 4)


def regime_stability(spark, d):
    return dec.streak(models.regimes(_candles(spark, d)), "regime", "rows_in_regime").select("symbol", "ts", "regime", "rows_in_regime")


def _predictions(spark, d):
    return _candles(spark, d).select("symbol", "ts", F.least(F.lit(1.0), F.col("close") / 400_000).alias("prob"))


def model_bias(spark, d):
    return rounded(dec.bias(_predictions(spark, d), 5, 0.8).select("symbol", "ts", "up_share", "down_share", "blocked"))


def model_frozen(spark, d):
    rows = _predictions(spark, d).withColumn("prob", F.when(F.col("ts") % (20 * DAY) < 6 * DAY, 0.5).otherwise(F.col("prob")))
    return dec.frozen(rows).select("symbol", "ts", "frozen")


def reversion_probability(spark, d):
    rows = ind.mean_reversion(_candles(spark, d)).where("z IS NOT NULL")
    return rounded(rows.select("symbol", "ts", dec.normal_cdf(F.abs("z")).alias("probability")))


def pat_triangle(spark, d):
    return rounded(dec.triangle(_candles(spark, d)).where("is_triangle").select("symbol", "ts", "touches", "slope"), 3)


def ind_stoch_rsi(spark, d):
    return rounded(dec.stoch_rsi(ind.rsi(_candles(spark, d))).select("symbol", "ts", "stoch_rsi_k", "stoch_rsi_d"), 4)


def mdl_vol_forecast(spark, d):
    vols = ind.realized_volatility(_candles(spark, d)).where("vol_scaled IS NOT NULL").select("symbol", "ts", F.col("vol_scaled").alias("vol"))
    return rounded(dec.vol_forecast(vols))


def ind_timeframe_trend(spark, d):
    return rounded(dec.timeframe_trend(_candles(spark, d), "week"), 4)


def score_whale(spark, d):
    h = hours(spark, d)
    flow = F.try_divide(F.col("buy_volume") - F.col("sell_volume"), F.col("volume"))
    rows = h.select("symbol", "window_end", flow.alias("flow"), ((F.col("close") - F.col("open")) / F.col("open")).alias("book"), F.lit(None).cast("double").alias("absorbed"), (F.col("n") / 10 - 0.5).alias("derivatives"))
    return rounded(dec.whale_score(rows).select("symbol", "window_end", "score", "label"))


def decision_fusion(spark, d):
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 101 / 100).alias("prob"), (F.col("c_nationkey") / 25).alias("confidence"), (F.col("c_custkey") % 21 / 10 - 1).alias("rule"))
    return rounded(dec.fusion(rows).select("id", "total", "conflict", "action"))


def risk_positions(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "long").otherwise("short").alias("side"), (F.col("o_custkey") % 10 + 1).cast("double").alias("size"),
        F.col("o_totalprice").alias("entry"), (F.col("o_totalprice") * 1.02).alias("price"), (F.col("o_totalprice") * 0.9).alias("stop"), (F.col("o_totalprice") * 1.3).alias("target"),
    )
    return rounded(dec.position_metrics(rows).select("id", "pnl", "to_stop", "to_target", "reward_risk"), 4)


def risk_counterparty(spark, d):
    s = table(spark, d, "supplier")
    rows = s.select((F.col("s_nationkey") % 5).alias("portfolio"), F.abs("s_acctbal").alias("value"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 10 / 100).alias("probability"))
    return rounded(dec.counterparty(rows))


def risk_compliance(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5).cast("double").alias("leverage"), (F.col("c_nationkey") / 25).alias("liquid_share"), (F.col("c_custkey") % 40 / 100).alias("largest"))
    return dec.compliance(rows).select("id", "violations")


def risk_dynamic_limits(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 40 / 1000).alias("vol"), (F.col("c_nationkey") * 2).cast("double").alias("vix"))
    return rounded(dec.dynamic_limits(rows).select("id", "factor", "action"))


def alerts_structured(spark, d):
    c = ind.mean_reversion(ind.rsi(_candles(spark, d)))
    before = F.max("high").over(ind.line().rowsBetween(-20, -1))
    rows = c.withColumns({"ratio": F.try_divide(F.col("volume"), F.avg("volume").over(ind.line().rowsBetween(-20, -1))), "level": before})
    return dec.alerts(rows)


def funding_sentiment(spark, d):
    rates = _candles(spark, d).select("ts", ((F.col("close") / F.col("open") - 1) / 1000).alias("rate"))
    return rounded(dec.funding(rates))


def lvl_strength(spark, d):
    c = _candles(spark, d)
    swing = ind.swings(c, 10).select("symbol", F.col("kind").alias("source"), "price").distinct()
    levels = swing.select("symbol", "source", "price", F.when(F.col("source") == "high", 1.0).otherwise(0.8).alias("weight"), F.lit(2).alias("touches"))
    return dec.level_strength(levels, c.groupBy("symbol").agg(F.max_by("close", "ts").alias("last")))


def lvl_strength_scores(spark, d):
    return rounded(lvl_strength(spark, d), 4)


def lvl_asymmetry(spark, d):
    return rounded(dec.asymmetry(lvl_strength(spark, d)), 3)


def sim_vectors(spark, d):
    mapping = {"view": 0.0, "click": 0.25, "signup": 0.5, "purchase": 0.75}
    out = dec.encode(table(spark, d, "events").select("event_id", "event_type", "value"), "event_type", mapping, ["value"])
    return rounded(out.select("event_id", F.col("vector")[0].alias("code"), F.col("vector")[1].alias("scaled")))


def payload_compact(spark, d):
    rows = table(spark, d, "orders")
    return dec.payload(rows, "o_orderkey", [["o_orderstatus"], ["o_custkey"], ["o_orderpriority"]], 70).select("o_orderkey", "payload", "size")


def dataset_drop_constant(spark, d):
    """Columns of a feature table with their null and distinct counts, and whether they stay."""
    rows = ind.price_features(_candles(spark, d)).withColumn("constant", F.lit(1.0))
    names = ["return_1", "return_5", "volume_ratio", "constant"]
    counts = rows.agg(*(F.struct(F.count(c).alias("n"), F.count_distinct(c).alias("k")).alias(c) for c in names))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}.n").alias("n"), (F.col(f"{c}.k") > 1).alias("kept")) for c in names))).alias("x")).select("x.*")


def events_recent(spark, d):
    return table(spark, d, "events").where("event_type IN ('purchase', 'signup')").select("event_id", "event_type", "value").orderBy(F.desc("event_id")).limit(100)


def label_quality_counts(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


def lvl_price_targets(spark, d):
    c = _candles(spark, d)
    swing = ind.swings(c, 10).select("symbol", F.col("kind").alias("source"), "price", F.lit(1.0).alias("weight"))
    pivots = levels.pivots(levels.periods(c, "month")).select("symbol", F.explode(F.array(*(F.struct(F.lit(n).alias("source"), F.col(n).alias("price")) for n in ("r1", "s1")))).alias("x"))
    pivots = pivots.select("symbol", "x.source", "x.price", F.lit(0.8).alias("weight"))
    return rounded(levels.price_targets(swing.unionByName(pivots), c.groupBy("symbol").agg(F.max_by("close", "ts").alias("last"))), 3)


def lvl_registry(spark, d):
    rows = ind.swings(_candles(spark, d), 3).select("symbol", "kind", F.col("price").alias("anchor"), (F.col("price") * 0.999).alias("low"), (F.col("price") * 1.001).alias("high"), F.lit(1.0).alias("score"), F.col("ts").alias("seq"))
    return rounded(levels.upsert_zones(rows, 0.005), 3)


def lvl_bootstrap(spark, d):
    rows = levels.reactions(_candles(spark, d)).where("rise IS NOT NULL").select("symbol", "ts", F.col("rise").alias("value"))
    return rounded(levels.bootstrap(rows.orderBy("symbol", "ts").select("symbol", "value")), 4)


def heat_clusters(spark, d):
    rows = sided(spark, d).select(F.concat_ws("|", "symbol", bars.window_end(F.col("t"), DAY).cast("string")).alias("symbol"), F.col("p").alias("price"))
    return rounded(levels.chained(rows, 0.02, "mean", 5), 4)


QUERIES = [
    lvl_price_targets, lvl_registry, lvl_bootstrap, heat_clusters, audit_windows, score_quality, anomaly_z, vwap_zones, ind_spread_percentile, regime_stability, model_bias, model_frozen, reversion_probability,
    pat_triangle, ind_stoch_rsi, mdl_vol_forecast, ind_timeframe_trend, score_whale, decision_fusion, risk_positions, risk_counterparty,
    risk_compliance, risk_dynamic_limits, alerts_structured, funding_sentiment, lvl_strength_scores, lvl_asymmetry, sim_vectors, payload_compact,
    dataset_drop_constant, events_recent, label_quality_counts,
]

_L = "(PARTITION BY symbol ORDER BY ts)"


def _w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_REG = f"""ret AS (SELECT symbol, ts, r FROM (SELECT *, ln(close / lag(close) OVER {_L}) AS r FROM candles) WHERE r IS NOT NULL), reg AS (SELECT symbol, ts, CASE WHEN mean > deviation * 0.2 + 1e-12 THEN 'bull'
    WHEN mean < deviation * -0.2 - 1e-12 THEN 'bear' WHEN deviation > 1 THEN 'volatile' ELSE 'range' END AS regime FROM (SELECT *, avg(r) OVER w AS mean, stddev_pop(r) OVER w AS deviation, count(r) OVER w AS n FROM ret WINDOW w AS {_w(20)}) WHERE n >= 20)"""
_RSI = f"""rs AS (SELECT *, CASE WHEN dn < 14 THEN NULL WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100.0 ELSE 50.0 END AS rsi FROM (SELECT *, avg(greatest(d, 0)) OVER w AS g, avg(greatest(-d, 0)) OVER w AS l, count(d) OVER w AS dn
    FROM (SELECT *, close - lag(close) OVER {_L} AS d FROM candles) WINDOW w AS {_w(14)}))"""
_Z = f"CASE WHEN count(close) OVER w20 >= 20 THEN (close - avg(close) OVER w20) / stddev_pop(close) OVER w20 END"

ORACLE = {
    "audit_windows": sql("trades", "sided", "hours", select="SELECT symbol, window_end, '' AS broken, true AS consistent FROM hours"),
    "score_quality": sql("candles", select=f"""SELECT symbol, ts, round(s, 6) AS score, CASE WHEN s >= 90 THEN 'A' WHEN s >= 75 THEN 'B' WHEN s >= 50 THEN 'C' ELSE 'D' END AS grade FROM
        (SELECT symbol, ts, 60 + CASE WHEN i > 14 THEN 15 ELSE 0 END + CASE WHEN i >= 14 THEN 15 ELSE 0 END + CASE WHEN i >= 27 THEN 10 ELSE 0 END AS s FROM (SELECT *, row_number() OVER {_L} AS i FROM candles))"""),
    "anomaly_z": sql("candles", select="""SELECT symbol, ts, high, round(z, 4) AS z, CASE WHEN abs(z) > 5 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM (SELECT symbol, ts, high, (high - avg(high) OVER p) / (stddev_pop(high) OVER p * 0.4) AS z FROM candles WINDOW p AS (PARTITION BY symbol)) WHERE abs(z) > 3"""),
    "ind_spread_percentile": sql("candles", more=f"""sp AS (SELECT symbol, ts, (high - low) / low AS spread, (high - low) / low <= 2 AS is_tight FROM candles), st AS (SELECT *, avg(spread) OVER w AS mean, quantile_cont(spread, 0.5) OVER w AS median, list(spread) OVER w AS a,
        CASE WHEN is_tight IS NOT DISTINCT FROM lag(is_tight) OVER {_L} THEN 0 ELSE 1 END AS c FROM sp WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))""",
        select=f"""SELECT symbol, ts, round(spread, 4) AS spread, round(mean, 4) AS mean, round(median, 4) AS median, round(len(list_filter(a, lambda x: x < spread)) / len(a), 4) AS rank, is_tight, row_number() OVER (PARTITION BY symbol, run ORDER BY ts) AS tight_rows
        FROM (SELECT *, sum(c) OVER {_L} AS run FROM st)"""),
    "regime_stability": sql("candles", more=_REG, select=f"""SELECT symbol, ts, regime, row_number() OVER (PARTITION BY symbol, run ORDER BY ts) AS rows_in_regime FROM (SELECT *, sum(c) OVER {_L} AS run FROM
        (SELECT *, CASE WHEN regime = lag(regime) OVER {_L} THEN 0 ELSE 1 END AS c FROM reg))"""),
    "model_bias": sql("candles", select=f"""SELECT symbol, ts, round(u, 6) AS up_share, round(d, 6) AS down_share, n >= 5 AND greatest(u, d) >= 0.8 AS blocked FROM (SELECT symbol, ts, avg((p > 0.6)::INT) OVER w AS u, avg((p < 0.4)::INT) OVER w AS d, count(p) OVER w AS n
        FROM (SELECT symbol, ts, least(1.0::DOUBLE, close / 400000) AS p FROM candles) WINDOW w AS {_w(5)})"""),
    "reversion_probability": sql("candles", select=f"""SELECT symbol, ts, round(1 - exp(-z * z / 2) / sqrt(2 * pi()) * (0.319381530 * k - 0.356563782 * k ** 2 + 1.781477937 * k ** 3 - 1.821255978 * k ** 4 + 1.330274429 * k ** 5), 6) AS probability FROM
        (SELECT *, 1 / (1 + z * 0.2316419::DOUBLE) AS k FROM (SELECT symbol, ts, abs({_Z}) AS z FROM candles WINDOW w20 AS {_w(20)}) WHERE z IS NOT NULL)"""),
    "ind_stoch_rsi": sql("candles", more=_RSI, select=f"""SELECT symbol, ts, round(k, 4) AS stoch_rsi_k, round(avg(k) OVER w, 4) AS stoch_rsi_d FROM (SELECT symbol, ts, avg(raw) OVER w AS k FROM (SELECT symbol, ts, coalesce(CASE WHEN count(rsi) OVER w >= 14 AND max(rsi) OVER w > min(rsi) OVER w
        THEN (rsi - min(rsi) OVER w) / (max(rsi) OVER w - min(rsi) OVER w) * 100 END, 50.0) AS raw FROM rs WINDOW w AS {_w(14)}) WINDOW w AS {_w(3)}) WINDOW w AS {_w(3)}"""),
    "score_whale": sql("trades", "sided", "hours", select="""SELECT symbol, window_end, round(s, 6) AS score, CASE WHEN s >= 50 THEN 'strong_accumulation' WHEN s >= 20 THEN 'accumulation' WHEN s <= -50 THEN 'strong_distribution' WHEN s <= -20 THEN 'distribution' ELSE 'neutral' END AS label FROM
        (SELECT symbol, window_end, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (buy_volume - sell_volume) / volume)) * 30 + greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (close - open) / open)) * 20 + greatest(-1.0::DOUBLE, least(1.0::DOUBLE, n / 10 - 0.5)) * 25 AS s FROM hours)"""),
    "risk_positions": """SELECT o_orderkey AS id, round(o_totalprice * 0.02 * (o_custkey % 10 + 1) * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END, 4) AS pnl, round(0.12::DOUBLE / 1.02, 4) AS to_stop, round(0.28::DOUBLE / 1.02, 4) AS to_target, round(3.0, 4) AS reward_risk FROM orders""",
    "risk_counterparty": """SELECT portfolio, round(sum(s * p), 6) AS probability, round(sum(CAST(value * p * 0.6::DOUBLE AS DECIMAL(28,6)))::DOUBLE, 6) AS expected_loss, round(sum(s * s), 6) AS hhi FROM (SELECT *, value / sum(value) OVER (PARTITION BY portfolio) AS s FROM
        (SELECT s_nationkey % 5 AS portfolio, abs(s_acctbal) AS value, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 10 / 100 ELSE 0.01 END AS p FROM supplier)) GROUP BY 1""",
    "risk_compliance": "SELECT c_custkey AS id, concat_ws(',', CASE WHEN c_custkey % 5 > 3 THEN 'leverage' END, CASE WHEN c_nationkey < 5 THEN 'liquidity' END, CASE WHEN c_custkey % 40 > 25 THEN 'concentration' END) AS violations FROM customer",
    "risk_dynamic_limits": """SELECT id, round(f, 6) AS factor, CASE WHEN f < 0.5 THEN 'reduce' WHEN f < 1 THEN 'careful' WHEN f > 1.2 THEN 'expand' ELSE 'normal' END AS action FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 40 > 30 THEN 0.5 WHEN c_custkey % 40 < 10 THEN 1.2 ELSE 1.0 END::DOUBLE
        * CASE WHEN c_nationkey * 2 > 30 THEN 0.5 WHEN c_nationkey * 2 < 15 THEN 1.1 ELSE 1.0 END::DOUBLE AS f FROM customer)""",
    "alerts_structured": sql("candles", more=_RSI + f""", x AS (SELECT symbol, ts, close, rsi, {_Z} AS z, volume / avg(volume) OVER b AS ratio, max(high) OVER b AS lv FROM rs WINDOW w20 AS {_w(20)}, b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""",
        select="""SELECT symbol, ts, 'volume' AS kind, CASE WHEN ratio >= 4 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM x WHERE ratio >= 2 UNION ALL SELECT symbol, ts, 'rsi_high', CASE WHEN rsi >= 80 THEN 'HIGH' ELSE 'MEDIUM' END FROM x WHERE rsi >= 70
        UNION ALL SELECT symbol, ts, 'rsi_low', CASE WHEN rsi <= 20 THEN 'HIGH' ELSE 'MEDIUM' END FROM x WHERE rsi <= 30 UNION ALL SELECT symbol, ts, 'breakout', 'HIGH' FROM x WHERE close > lv UNION ALL SELECT symbol, ts, 'stretched', 'LOW' FROM x WHERE abs(z) >= 2"""),
    "payload_compact": """SELECT o_orderkey, payload, length(payload) AS size FROM (SELECT o_orderkey, CASE WHEN length(c) <= 70 THEN c WHEN length(b) <= 70 THEN b ELSE a END AS payload FROM (SELECT o_orderkey, concat('{"o_orderstatus":"', o_orderstatus, '"}') AS a,
        concat('{"o_orderstatus":"', o_orderstatus, '","o_custkey":', o_custkey, '}') AS b, concat('{"o_orderstatus":"', o_orderstatus, '","o_custkey":', o_custkey, ',"o_orderpriority":"', o_orderpriority, '"}') AS c FROM orders))""",
    "sim_vectors": """SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 0.25 WHEN 'signup' THEN 0.5 WHEN 'purchase' THEN 0.75 ELSE -1 END::DOUBLE AS code, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS scaled FROM events""",
    "events_recent": "SELECT event_id, event_type, value FROM events WHERE event_type IN ('purchase', 'signup') ORDER BY event_id DESC LIMIT 100",
    "label_quality_counts": "SELECT source, quality, toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL",
}
