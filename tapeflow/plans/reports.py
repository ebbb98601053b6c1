"""Queries: reports, probabilities, calendars, level tests, books, sessions, text from models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import indicators as ind
from ..operators import joins, reports
from ..sources.tables import book_from_part, candles_from_orders, table, trades_from_events
from .base import DAY, HOUR, rounded, sql
from .trading import sided


def _outcomes(spark, d):
    """Direction of the next close after each candle, by symbol and weekday."""
    rows = joins.direction_labels(candles_from_orders(spark, d), 1, 0.05)
    way = F.when(F.col("label") > 0, "up").when(F.col("label") < 0, "down").otherwise("flat")
    return rows.select("symbol", "ts", (F.floor(F.col("ts") / DAY) % 7).alias("day"), "change", way.alias("direction"))


def prob_all(spark, d):
    return rounded(reports.probabilities(_outcomes(spark, d), ["symbol", "day"], 10))


def prob_prior(spark, d):
    k = F.col("c_custkey")
    pick = lambda of, *names: F.element_at(F.array(*map(F.lit, names)), (of % len(names) + 1).cast("int"))
    events = table(spark, d, "customer").select(k.alias("id"), pick(k, "1-URGENT", "2-HIGH", "none").alias("symbol"), (k % 7).alias("day"), pick(F.col("c_nationkey"), "Buy absorption", "Sell absorption", "Exhaustion", "Other").alias("label"))
    known = reports.probabilities(_outcomes(spark, d), ["symbol", "day"], 1)
    return rounded(reports.with_prior(events, known, ["symbol", "day"]).select("id", "up", "down", "flat", "real"))


def sim_summary(spark, d):
    return rounded(reports.similar_summary(_outcomes(spark, d), "symbol"))


def _profits(spark, d):
    return _outcomes(spark, d).select("symbol", "ts", F.greatest(F.lit(-0.9), F.least(F.lit(0.9), F.round("change", 4))).alias("profit"))


def perf_report(spark, d):
    return rounded(reports.pnl_report(_profits(spark, d), "symbol"))


def perf_evaluation(spark, d):
    rows = _profits(spark, d).select((F.floor(F.col("ts") / DAY) % 3 * 15).alias("horizon"), (F.floor(F.col("ts") / DAY) % 100 / 100.0).alias("confidence"), "profit")
    return rounded(reports.evaluation(rows).fillna({"horizon": -1, "bucket": "all"}))


def decision_fallback(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    pick = lambda of, *names: F.element_at(F.array(*map(F.lit, names)), (of % len(names) + 1).cast("int"))
    rows = table(spark, d, "customer").select(k.alias("id"), (k % 100 / 100.0).alias("prob_up"), (n / 25.0).alias("confidence"), pick(k, "buy", "sell", "wait").alias("action"), F.when(k % 4 != 0, pick(n, "buy", "sell", "flat")).alias("llm_action"), (k % 50 / 50.0).alias("llm_confidence"))
    return rounded(reports.fallback_decision(rows).select("id", "final", "final_confidence", "origin"))


def calendar_liquidity(spark, d):
    days = spark.createDataFrame([("2024-01-01", "New Year"), ("2024-01-15", "King"), ("2024-02-19", "Presidents"), ("2024-03-29", "Good Friday")], "date string, name string")
    out = reports.market_calendar(trades_from_events(spark, d).select("seq", "t"), days.withColumn("date", F.to_date("date")))
    return out.select("seq", F.date_format("day", "yyyy-MM-dd").alias("day"), "holiday", "weekend", "liquidity")


def score_layers(spark, d):
    sources = [s for names in reports.LAYERS.values() for s in names] + ["unknown"]
    source = F.element_at(F.array(*map(F.lit, sources)), (F.col("c_custkey") % len(sources) + 1).cast("int"))
    way = F.element_at(F.array(F.lit("buy"), F.lit("sell"), F.lit("none")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    return reports.layers(table(spark, d, "customer").select(source.alias("source"), way.alias("direction")))


def _metrics(spark, d):
    t = trades_from_events(spark, d)
    return reports.metric_stats(t.select(F.col("symbol").alias("kind"), "t", F.col("p").alias("latency"), (F.col("seq") % 7 == 0).alias("failed")), DAY)


def quality_stats(spark, d):
    return rounded(_metrics(spark, d), 4)


def quality_alerts(spark, d):
    return reports.rate_alerts(_metrics(spark, d), 0.14, 50.0)


def trade_sessions(spark, d):
    return reports.sessions(trades_from_events(spark, d), 2 * HOUR)


def window_history(spark, d):
    return reports.warmed(candles_from_orders(spark, d)).select("symbol", "ts", "close", "close_1", "close_2")


def ind_checked_return(spark, d):
    return rounded(reports.checked_return(candles_from_orders(spark, d), 5).select("symbol", "ts", "value", "reason"))


def ml_live_features(spark, d):
    return rounded(reports.live_features(candles_from_orders(spark, d)).select("symbol", "ts", "return_1", "return_5", "return_10", "upper", "lower", "volume_ratio", "real"), 4)


def lvl_t_interval(spark, d):
    rows = candles_from_orders(spark, d).withColumn("month", F.floor(F.col("ts") / (30 * DAY)))
    return rounded(reports.t_interval(rows, ["symbol", "month"], "close"), 3)


def lvl_relative_strength(spark, d):
    c = candles_from_orders(spark, d)
    found = c.groupBy("symbol", F.floor(F.col("ts") / (90 * DAY)).alias("p")).agg(F.max_by("close", "ts").alias("price")).select("symbol", "price").distinct()
    return rounded(reports.relative_strength(found, c))


def lvl_neutral_zone(spark, d):
    k = F.col("o_totalprice")
    rows = candles_from_orders(spark, d).where("volume = 1").select("symbol", F.when(F.col("close") < 100_000, "buy").when(F.col("close") > 200_000, "sell").alias("side"), F.col("close").alias("center"), (F.col("close") - 5).alias("low"), (F.col("close") + 5).alias("high"))
    return rounded(reports.neutral_zone(rows.where("side IS NOT NULL")), 4)


def lvl_tests(spark, d):
    rows = candles_from_orders(spark, d).select("symbol", F.when(F.col("volume") > 2, "defended").when(F.col("volume") > 1, "failed").otherwise("open").alias("outcome"))
    return rounded(reports.level_tests(rows))


def book_stats(spark, d):
    return rounded(reports.book_statistics(book_from_part(spark, d)))


def heat_sides(spark, d):
    t = sided(spark, d)
    side = lambda m: F.sum(F.when(F.col("m") == F.lit(m), F.col("q").cast("decimal(20,8)")).otherwise(0)).cast("double")
    rows = t.groupBy("symbol", (F.floor(F.col("p") / 10) * 10).alias("center")).agg(side(False).alias("buy_volume"), side(True).alias("sell_volume"))
    return rounded(reports.cluster_sides(rows))


def pat_active(spark, d):
    """Every month of a symbol for itself; in odd months prices move by a hundredth of what they do, so that wedges can form."""
    c, month = candles_from_orders(spark, d), F.date_format(F.timestamp_millis("ts"), "yyyy-MM")
    close = F.when(F.month(F.timestamp_millis("ts")) % 2 == 1, 100_000 + F.col("close") / 100).otherwise(F.col("close"))
    return rounded(reports.active_patterns(c.select(F.concat_ws(" ", "symbol", month).alias("symbol"), "ts", close.alias("close"))), 4)


def lvl_extrema(spark, d):
    return reports.local_extrema(candles_from_orders(spark, d))


def lvl_ranked(spark, d):
    c = candles_from_orders(spark, d)
    levels = ind.swings(c, 10).groupBy("symbol", "price").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return rounded(reports.ranked_levels(levels, c.groupBy("symbol").agg(F.max_by("close", "ts").alias("last"))), 4)


def book_icebergs(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("side"), F.floor(F.col("l_extendedprice") / 10000).alias("bucket"), (F.floor(F.unix_millis(F.col("l_shipdate").cast("timestamp")) / (10 * DAY))).alias("n")).agg(F.sum("l_quantity").alias("qty"))
    return rounded(reports.icebergs(rows, 0.5))


def fn_shares(spark, d):
    v = F.col("c_custkey") % 300 / 4.0 - 20
    return rounded(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), scalars.ratio01(v).alias("share"), scalars.percent100(v).alias("percent"), scalars.half_up(F.col("c_acctbal") / 8, 2).cast("double").alias("cents"), scalars.shown_percent(v / 8).alias("shown")))


def fn_triplet_ok(spark, d):
    t = trades_from_events(spark, d)
    iso = lambda shift, ends: F.concat(F.date_format(F.timestamp_millis(F.col("t") + shift), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit(ends))
    late = F.when(F.col("seq") % 3 == 0, 5000).otherwise(1000)
    return t.select("seq", scalars.triplet_ok(F.col("t"), iso(0, "Z"), iso(late - 5 * HOUR, "-05:00")).alias("ok"))


def fn_json_object(spark, d):
    text = F.concat(F.lit('<think>{"a":'), "c_custkey", F.lit('}</think> so: ```json\n{"k": '), "c_custkey", F.lit(', "s": "br{ace", "o": {"x": [1, {"y": 2}]}'), F.when(F.col("c_custkey") % 5 == 0, "").otherwise("} done }"))
    return table(spark, d, "customer").select("c_custkey", scalars.json_object(text).alias("found"), scalars.json_truncated(F.when(F.col("c_custkey") % 3 == 0, F.lit('{"k": {"x": ')).otherwise(text)).alias("truncated"))


def fn_canonical_hash(spark, d):
    return table(spark, d, "nation").select("n_nationkey", scalars.canonical_hash(["n_regionkey", "n_name", "n_nationkey"]).alias("hash"))


QUERIES = (
    prob_all, prob_prior, sim_summary, perf_report, perf_evaluation, decision_fallback, calendar_liquidity, score_layers, quality_stats, quality_alerts, trade_sessions, window_history, ind_checked_return, ml_live_features,
    lvl_t_interval, lvl_relative_strength, lvl_neutral_zone, lvl_tests, book_stats, heat_sides, pat_active, lvl_extrema, lvl_ranked, book_icebergs, fn_shares, fn_triplet_ok, fn_json_object, fn_canonical_hash,
)

_L = "(PARTITION BY symbol ORDER BY ts)"


def _w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _pick(of: str, *names: str) -> str:
    return f"[{', '.join(repr(n) for n in names)}][CAST({of} % {len(names)} + 1 AS BIGINT)]"


_OUT = f"""o0 AS (SELECT symbol, ts, ts // {DAY} % 7 AS day, lead(close) OVER {_L} / close - 1 AS change FROM candles), oc AS (SELECT *, CASE WHEN change > 0.05 THEN 'up' WHEN change < -0.05 THEN 'down' ELSE 'flat' END AS direction FROM o0 WHERE change IS NOT NULL),
    pr AS (SELECT symbol, ts, greatest(-0.9::DOUBLE, least(0.9::DOUBLE, round(change, 4))) AS profit FROM oc)"""
_PROB = "pb AS (SELECT symbol, day, count(*) AS n, avg((direction = 'up')::INT) AS up, avg((direction = 'down')::INT) AS down, avg((direction = 'flat')::INT) AS flat, avg(change) AS mean FROM oc GROUP BY 1, 2)"
_SOURCES = [s for names in reports.LAYERS.values() for s in names] + ["unknown"]
_LAYER = " ".join(f"WHEN source IN ({', '.join(repr(s) for s in names)}) THEN '{layer}'" for layer, names in reports.LAYERS.items())
_METRICS = f"ms AS (SELECT symbol AS kind, t // {DAY} * {DAY} AS start, count(*) AS n, avg((seq % 7 = 0)::INT) AS rate, avg(p) AS mean, quantile_cont(p, 0.5) AS p50, quantile_cont(p, 0.95) AS p95 FROM trades GROUP BY 1, 2)"
_T = "[" + ", ".join(map(str, reports.T_POINTS)) + "]::DOUBLE[]"
_Z = reports.NORMAL_POINT
_G = [(_Z**3 + _Z) / 4, (5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96, (3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384]
_SWING = """mc AS (SELECT symbol || ' ' || strftime(to_timestamp(ts / 1000) AT TIME ZONE 'UTC', '%Y-%m') AS symbol, ts,
        CASE WHEN month(to_timestamp(ts / 1000) AT TIME ZONE 'UTC') % 2 = 1 THEN 100000 + close / 100 ELSE close END AS close FROM candles),
    sw AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS a, lead(close) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM mc),
    sl AS (SELECT symbol, arg_max(close, ts) AS p, (max(close) - min(close)) / arg_max(close, ts) < 0.03 AS nr, list(close ORDER BY ts DESC) FILTER (close > a AND close > b) AS h,
        list(close ORDER BY ts DESC) FILTER (close < a AND close < b) AS l FROM sw GROUP BY 1 HAVING count(*) >= 6),
    sv AS (SELECT symbol, p, nr, h[2] AS h1, h[1] AS h2, l[2] AS l1, l[1] AS l2 FROM sl WHERE len(h) >= 2 AND len(l) >= 2),
    sr AS (SELECT *, (h2 - h1) / greatest(h1, 1) AS rh, (l2 - l1) / greatest(l1, 1) AS rl, abs(h2 - h1) / p < 0.002 AS fh, abs(l2 - l1) / p < 0.002 AS fl, p > (h2 + l2) / 2 AS up FROM sv)"""
_PATTERNS = (
    ("ASCENDING_TRIANGLE", "fh AND l2 > l1 AND h2 > p", "h2 + (h2 - l2)", "least(0.95::DOUBLE, (p - l2) / greatest(h2 - l2, 1))", "l2 * 0.998", 0.55, 0.2, "'BULLISH'"),
    ("DESCENDING_TRIANGLE", "fl AND h2 < h1 AND l2 < p", "l2 - (h2 - l2)", "least(0.95::DOUBLE, (h2 - p) / greatest(h2 - l2, 1))", "h2 * 1.002", 0.55, 0.2, "'BEARISH'"),
    ("SYMMETRICAL_TRIANGLE", "h2 < h1 AND l2 > l1 AND NOT fh AND NOT fl", "CASE WHEN up THEN h2 + (h1 - l1) * 0.75 ELSE l2 - (h1 - l1) * 0.75 END", "least(0.9::DOUBLE, 1 - (h2 - l2) / greatest(h1 - l1, 1))",
        "CASE WHEN up THEN l2 * 0.997 ELSE h2 * 1.003 END", 0.45, 0.25, "CASE WHEN up THEN 'BULLISH' ELSE 'BEARISH' END"),
    ("RISING_WEDGE", "h2 > h1 AND l2 > l1 AND rl > rh AND nr", "l1", "least(0.9::DOUBLE, rh / greatest(rl, 0.0001::DOUBLE))", "h2 * 1.002", 0.5, 0.2, "'BEARISH'"),
    ("FALLING_WEDGE", "h2 < h1 AND l2 < l1 AND rh < rl AND nr", "h1", "least(0.9::DOUBLE, -rl / greatest(-rh, 0.0001::DOUBLE))", "l2 * 0.998", 0.5, 0.2, "'BULLISH'"),
)

ORACLE = {
    "prob_all": sql("candles", more=f"{_OUT}, {_PROB}", select="SELECT symbol, day, n, round(up, 6) AS up, round(down, 6) AS down, round(flat, 6) AS flat, round(mean, 6) AS mean FROM pb WHERE n >= 10"),
    "prob_prior": sql("candles", more=f"{_OUT}, {_PROB}, ev AS (SELECT c_custkey AS id, {_pick('c_custkey', '1-URGENT', '2-HIGH', 'none')} AS symbol, c_custkey % 7 AS day, c_nationkey % 4 AS l FROM customer), pu AS (SELECT id, pb.up IS NOT NULL AS real, coalesce(pb.up, [0.45, 0.25, 0.35, 0.33][l + 1]::DOUBLE) AS u, coalesce(pb.down, [0.25, 0.45, 0.35, 0.33][l + 1]::DOUBLE) AS d FROM ev LEFT JOIN pb USING (symbol, day))",
        select="SELECT id, round(u, 6) AS up, round(d, 6) AS down, round(greatest(0::DOUBLE, 1 - u - d), 6) AS flat, real FROM pu"),
    "sim_summary": sql("candles", more=f"{_OUT}, su AS (SELECT symbol, count(*) AS similar, count(*) FILTER (direction = 'up') AS up, count(*) FILTER (direction = 'down') AS down, avg(change) AS mean FROM oc GROUP BY 1)",
        select="""SELECT symbol, "similar", up, down, round(mean, 6) AS mean, round(up / nullif(up + down, 0) * 100, 6) AS win_rate, CASE WHEN up + down < 3 THEN 'insufficient' WHEN up / (up + down) >= 0.7 THEN 'rising' WHEN up / (up + down) <= 0.3 THEN 'falling' ELSE 'mixed' END AS reading FROM su""").replace("AS similar,", 'AS "similar",'),
    "perf_report": sql("candles", more=f"{_OUT}, cu AS (SELECT *, sum(CAST(profit AS DECIMAL(28,10))) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)::DOUBLE AS s FROM pr), fa AS (SELECT *, greatest(0::DOUBLE, max(s) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) - s AS f FROM cu)",
        select="SELECT symbol, count(*) AS n, round(sum(CAST(profit AS DECIMAL(28,10)))::DOUBLE, 6) AS total, round(avg((profit > 0)::INT), 6) AS win_rate, round(coalesce(avg(profit) / nullif(stddev_samp(profit), 0), 0), 6) AS sharpe, round(max(f), 6) AS max_fall FROM fa GROUP BY 1"),
    "perf_evaluation": sql("candles", more=f"{_OUT}, ev AS (SELECT ts // {DAY} % 3 * 15 AS horizon, ts // {DAY} % 100 AS c, profit FROM pr), eb AS (SELECT horizon, CASE WHEN c < 50 THEN '0.0-0.5' WHEN c < 70 THEN '0.5-0.7' WHEN c < 90 THEN '0.7-0.9' ELSE '0.9-1.0' END AS bucket, profit FROM ev)",
        select="""SELECT coalesce(horizon, -1) AS horizon, coalesce(bucket, 'all') AS bucket, count(*) AS n, round(avg((profit > 0)::INT), 6) AS win_rate, round(avg(profit), 6) AS mean, round(sum(greatest(profit, 0)) / nullif(-sum(least(profit, 0)), 0), 6) AS profit_factor FROM eb GROUP BY GROUPING SETS ((horizon), (bucket), (horizon, bucket))"""),
    "decision_fallback": sql(more=f"fd AS (SELECT c_custkey AS id, c_custkey % 100 AS p, c_nationkey / 25 * 0.75::DOUBLE AS alone, {_pick('c_custkey', 'buy', 'sell', 'wait')} AS act, CASE WHEN c_custkey % 4 <> 0 THEN {_pick('c_nationkey', 'buy', 'sell', 'flat')} END AS la, (c_custkey % 50) / 50 AS lc FROM customer), fa AS (SELECT *, coalesce((la = 'buy' AND p > 60) OR (la = 'sell' AND p < 40), false) AS ag FROM fd)",
        select="""SELECT id, CASE WHEN la IS NOT NULL THEN la WHEN act = 'wait' OR alone < 0.5 THEN 'wait' ELSE act END AS final, round(CASE WHEN la IS NOT NULL THEN least(1::DOUBLE, lc + CASE WHEN ag THEN 0.05 ELSE 0 END) ELSE alone END, 6) AS final_confidence, CASE WHEN la IS NULL THEN 'model_only' WHEN ag THEN 'llm_consensus' ELSE 'llm' END AS origin FROM fa"""),
    "calendar_liquidity": sql("trades", more="""hd AS (SELECT unnest([DATE '2024-01-01', DATE '2024-01-15', DATE '2024-02-19', DATE '2024-03-29']) AS d), dy AS (SELECT seq, CAST(make_timestamp((t - CASE WHEN t >= 1710054000000 AND t < 1730613600000 THEN 14400000 ELSE 18000000 END) * 1000) AS DATE) AS day FROM trades),
        fl AS (SELECT seq, day, day IN (SELECT d FROM hd) AS holiday, strftime(day, '%w') IN ('0', '6') AS weekend, (day + 1) IN (SELECT d FROM hd) OR (day - 1) IN (SELECT d FROM hd) AS near FROM dy)""",
        select="SELECT seq, strftime(day, '%Y-%m-%d') AS day, holiday, weekend, CASE WHEN holiday THEN 'VERY_LOW' WHEN weekend AND near THEN 'VERY_LOW' WHEN weekend THEN 'LOW' WHEN near THEN 'REDUCED' ELSE 'NORMAL' END AS liquidity FROM fl"),
    "score_layers": sql(more=f"si AS (SELECT {_pick('c_custkey', *_SOURCES)} AS source, c_nationkey % 3 AS w FROM customer), la AS (SELECT CASE {_LAYER} END AS layer, source, w FROM si)",
        select="SELECT layer, count(*) FILTER (w = 0) AS buys, count(*) FILTER (w = 1) AS sells, count(*) AS signals, count(DISTINCT source) AS sources, CASE WHEN count(*) FILTER (w = 0) > count(*) FILTER (w = 1) THEN 'bullish' WHEN count(*) FILTER (w = 1) > count(*) FILTER (w = 0) THEN 'bearish' ELSE 'neutral' END AS direction FROM la WHERE layer IS NOT NULL GROUP BY 1"),
    "quality_stats": sql("trades", more=_METRICS, select='SELECT kind, start, n, round(rate, 4) AS rate, round(mean, 4) AS mean, round(p50, 4) AS p50, round(p95, 4) AS p95 FROM ms'),
    "quality_alerts": sql("trades", more=_METRICS + ", al AS (SELECT kind, 'rate' AS alert, rate / 0.14::DOUBLE AS b FROM ms WHERE rate > 0.14::DOUBLE UNION ALL SELECT kind, 'latency', mean / 50 FROM ms WHERE mean > 50)",
        select="SELECT kind, alert, CASE WHEN b > 1.5 THEN 'critical' ELSE 'warning' END AS level, count(*) AS n FROM al GROUP BY 1, 2, 3"),
    "trade_sessions": sql("trades", more=f"sb AS (SELECT *, CASE WHEN t - lag(t) OVER w < {2 * HOUR} THEN 0 ELSE 1 END AS o FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY t, seq)), ss AS (SELECT *, sum(o) OVER (PARTITION BY symbol ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS session FROM sb)",
        select='SELECT symbol, session, min(t) AS start, max(t) AS "end", count(*) AS n, sum(CAST(q AS DECIMAL(20,8)))::DOUBLE AS volume FROM ss GROUP BY 1, 2'),
    "window_history": sql("candles", select=f"SELECT symbol, ts, close, lag(close) OVER {_L} AS close_1, lag(close, 2) OVER {_L} AS close_2 FROM candles QUALIFY row_number() OVER {_L} > 3"),
    "ind_checked_return": sql("candles", more=f"rv AS (SELECT symbol, ts, row_number() OVER {_L} AS k, greatest(-0.5::DOUBLE, least(0.5::DOUBLE, close / coalesce(lag(close, 5) OVER {_L}, first_value(close) OVER {_L}) - 1)) AS v FROM candles)",
        select="SELECT symbol, ts, round(CASE WHEN k = 1 THEN 0 ELSE v END, 6) AS value, CASE WHEN k = 1 THEN 'WARMUP' ELSE 'VALID' END AS reason FROM rv"),
    "ml_live_features": sql("candles", more=f"""lf AS (SELECT symbol, ts, close / lag(close) OVER l - 1 AS r1, close / lag(close, 5) OVER l - 1 AS r5, close / lag(close, 10) OVER l - 1 AS r10, CASE WHEN count(close) OVER w >= 20 THEN avg(close) OVER w END AS m, CASE WHEN count(close) OVER w >= 20 THEN stddev_pop(close) OVER w END AS s,
        CASE WHEN count(close) OVER w >= 20 THEN volume / avg(volume) OVER w END AS v FROM candles WINDOW w AS {_w(20)}, l AS {_L})""",
        select="SELECT symbol, ts, round(r1, 4) AS return_1, round(r5, 4) AS return_5, round(r10, 4) AS return_10, round(m + s * 2, 4) AS upper, round(m - s * 2, 4) AS lower, round(v, 4) AS volume_ratio, (r1 IS NOT NULL)::INT + (r5 IS NOT NULL)::INT + (r10 IS NOT NULL)::INT + (m IS NOT NULL)::INT * 3 AS real FROM lf"),
    "lvl_t_interval": sql("candles", more=f"""ti AS (SELECT symbol, ts // {30 * DAY} AS month, count(close) AS n, avg(close) AS m, coalesce(stddev_samp(close), 0) AS s FROM candles GROUP BY 1, 2),
        tp AS (SELECT *, CASE WHEN n <= 1 THEN 0 ELSE CASE WHEN n - 1 <= 10 THEN ({_T})[n - 1] ELSE {_Z}::DOUBLE + {_G[0]!r}::DOUBLE / (n - 1) + {_G[1]!r}::DOUBLE / ((n - 1) * (n - 1)) + {_G[2]!r}::DOUBLE / ((n - 1) * (n - 1) * (n - 1)) END * s / sqrt(n) END AS h FROM ti)""",
        select="SELECT symbol, month, n, round(m, 3) AS mean, round(s, 3) AS deviation, round(m - h, 3) AS low, round(m + h, 3) AS high, round(greatest(0::DOUBLE, least(10::DOUBLE, 10 - h * 2 / abs(m) * 200)), 3) AS stability FROM tp"),
    "lvl_relative_strength": sql("candles", more=f"""le AS (SELECT DISTINCT symbol, price FROM (SELECT symbol, arg_max(close, ts) AS price FROM candles GROUP BY symbol, ts // {90 * DAY})), nb AS (SELECT symbol, close, volume, row_number() OVER {_L} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, lead(close, 4) OVER {_L} AS f, avg(volume) OVER (PARTITION BY symbol) AS v FROM candles),
        mt AS (SELECT le.symbol, price, volume, i, n, v, i < n - 5 AND abs(f - price) / price > 0.005 AS turned FROM le JOIN nb ON le.symbol = nb.symbol AND abs(close - price) <= price * 0.005::DOUBLE),
        rs AS (SELECT symbol, price, count(*) AS touches, count(*) FILTER (turned) AS rejections, avg(volume) FILTER (turned) / any_value(v) AS r, max(i) AS last, any_value(n) AS n FROM mt GROUP BY 1, 2)""",
        select="SELECT symbol, round(price, 6) AS price, touches, rejections, round((rejections / touches * 0.4 + least(coalesce(r, 1), 2) / 2 * 0.3 + (1 - (n - last) / n) * 0.3) * 10, 6) AS score FROM rs"),
    "lvl_neutral_zone": sql("candles", more="nz AS (SELECT symbol, max(close) FILTER (close < 100000) + 5 AS s, min(close) FILTER (close > 200000) - 5 AS e FROM candles WHERE volume = 1 GROUP BY 1)", select='SELECT symbol, round(s, 4) AS start, round(e, 4) AS "end", round(e - s, 4) AS width FROM nz WHERE e > s'),
    "lvl_tests": sql("candles", select="SELECT symbol, count(*) AS tests, count(*) FILTER (volume > 2) AS defended, count(*) FILTER (volume = 2) AS failed, round(count(*) FILTER (volume > 2) / count(*), 6) AS defended_rate, round(count(*) FILTER (volume = 2) / count(*), 6) AS failed_rate FROM candles GROUP BY 1"),
    "book_stats": sql("book", more="bb AS (SELECT snapshot, max(CASE WHEN side = 'bid' THEN price END) AS b, min(CASE WHEN side = 'ask' THEN price END) AS a FROM book GROUP BY 1), bn AS (SELECT *, abs(price - (b + a) / 2) <= (b + a) / 2 * 0.02::DOUBLE AS nr FROM book JOIN bb USING (snapshot))",
        select="""SELECT snapshot, round(b, 6) AS bid, round(a, 6) AS ask, count(*) FILTER (side = 'bid') AS bids, count(*) FILTER (side = 'ask') AS asks, sum(CASE WHEN side = 'bid' THEN qty ELSE 0 END) AS bid_qty, sum(CASE WHEN side = 'ask' THEN qty ELSE 0 END) AS ask_qty,
        round(sum(CAST(CASE WHEN side = 'bid' AND nr THEN price * qty ELSE 0 END AS DECIMAL(28,6)))::DOUBLE, 6) AS bid_near, round(sum(CAST(CASE WHEN side = 'ask' AND nr THEN price * qty ELSE 0 END AS DECIMAL(28,6)))::DOUBLE, 6) AS ask_near, round(a - b, 6) AS spread,
        round(sum(CASE WHEN side = 'bid' THEN qty ELSE -qty END) / sum(qty), 6) AS imbalance, abs(sum(CASE WHEN side = 'bid' THEN qty ELSE -qty END) / sum(qty)) >= 0.95 AS critical FROM bn GROUP BY snapshot, b, a"""),
    "heat_sides": sql("trades", "sided", more="hs AS (SELECT symbol, floor(p / 10) * 10 AS c, sum(CAST(CASE WHEN NOT m THEN q ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS b, sum(CAST(CASE WHEN m THEN q ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS s FROM sided GROUP BY 1, 2)",
        select="SELECT symbol, c AS center, round(b, 6) AS buy_volume, round(s, 6) AS sell_volume, CASE WHEN b > s * 1.2 THEN 'support' WHEN s > b * 1.2 THEN 'resistance' ELSE 'neutral' END AS role, round((b + s) * (1 + abs((b - s) / (b + s))), 6) AS weight FROM hs"),
    "pat_active": sql("candles", more=_SWING, select="""SELECT symbol, pattern, round(target, 4) AS target, round(completion, 4) AS completion, round(stop, 4) AS stop, round(base + growth * completion, 4) AS confidence, bias FROM
        (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY o) AS k FROM (""" + " UNION ALL ".join(f"SELECT symbol, {i} AS o, '{n}' AS pattern, {t} AS target, {c} AS completion, {st} AS stop, {b}::DOUBLE AS base, {g}::DOUBLE AS growth, {bi} AS bias FROM sr WHERE {r}"
        for i, (n, r, t, c, st, b, g, bi) in enumerate(_PATTERNS)) + ")) WHERE k <= 3"),
    "fn_shares": sql(more="v AS (SELECT c_custkey AS id, c_acctbal AS a, (c_custkey % 300) / 4 - 20 AS v FROM customer)", select="SELECT id, round(CASE WHEN abs(v) > 1 THEN v / 100 ELSE v END, 6) AS share, round(CASE WHEN abs(v) <= 1 THEN v * 100 ELSE v END, 6) AS percent, round(CAST(a / 8 AS DECIMAL(28,10)), 2)::DOUBLE AS cents, printf('%.2f', round(v / 8 + 1.7e-10, 2)) || '%' AS shown FROM v"),
    "fn_triplet_ok": sql("trades", select="SELECT seq, seq % 3 <> 0 AS ok FROM trades"),
    "fn_json_object": """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '{"x": [1, {"y": 2}]}' ELSE concat('{"k": ', c_custkey, ', "s": "br{ace", "o": {"x": [1, {"y": 2}]}}') END AS found, c_custkey % 3 = 0 AS truncated FROM customer""",
    "fn_canonical_hash": """SELECT n_nationkey, sha256(concat('{"n_name":"', n_name, '","n_nationkey":', n_nationkey, ',"n_regionkey":', n_regionkey, '}')) AS hash FROM nation""",
}
