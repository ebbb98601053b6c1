"""DuckDB twins, and brute-force forms of their windows, of queries that came without one."""

from __future__ import annotations

from . import analysis, decisions, market
from .base import DAY, sql

_L = "(PARTITION BY symbol ORDER BY ts)"


def _w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_LAGGED = f"""lg AS (SELECT *, lag(open) OVER l AS o1, lag(close) OVER l AS c1, lag(open, 2) OVER l AS o2, lag(close, 2) OVER l AS c2, abs(close - open) AS b, high - low AS z, high - greatest(open, close) AS u, least(open, close) - low AS d FROM candles WINDOW l AS {_L})"""
# The ten patterns and their proportions.
_PATTERNS = {
    "doji": "z > 0 AND b <= z * 0.1::DOUBLE",
    "hammer": "d >= b * 2 AND u <= b * 0.5::DOUBLE AND b > 0",
    "shooting_star": "u >= b * 2 AND d <= b * 0.5::DOUBLE AND b > 0",
    "pin_bar": "z > 0 AND greatest(u, d) >= z * 0.66::DOUBLE AND b > 0",
    "bullish_engulfing": "c1 < o1 AND close > open AND open <= c1 AND close >= o1",
    "bearish_engulfing": "c1 > o1 AND close < open AND open >= c1 AND close <= o1",
    "morning_star": "c2 < o2 AND abs(c1 - o1) <= abs(c2 - o2) * 0.3::DOUBLE AND close > open AND close > (o2 + c2) / 2",
    "evening_star": "c2 > o2 AND abs(c1 - o1) <= abs(c2 - o2) * 0.3::DOUBLE AND close < open AND close < (o2 + c2) / 2",
    "three_soldiers": "c2 > o2 AND c1 > o1 AND close > open AND close > c1 AND c1 > c2",
    "three_crows": "c2 < o2 AND c1 < o1 AND close < open AND close < c1 AND c1 < c2",
}
_BANDS = f"""vb AS (SELECT symbol, (t // {DAY} + 1) * {DAY} AS window_end, arg_max(p, (t, seq)) AS close, sum(CAST(p * q AS DECIMAL(20,8)))::DOUBLE / sum(CAST(q AS DECIMAL(20,8)))::DOUBLE AS vwap,
    sum(CAST(p * p * q AS DECIMAL(20,8)))::DOUBLE / sum(CAST(q AS DECIMAL(20,8)))::DOUBLE AS sq FROM sided GROUP BY 1, 2),
    vz AS (SELECT symbol, window_end, (close - vwap) / nullif(sqrt(greatest(sq - vwap * vwap, 0)), 0) AS d FROM vb)"""
_FROZEN = f"""fp AS (SELECT symbol, ts, CASE WHEN ts % {20 * DAY} < {6 * DAY} THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, close / 400000) END AS p FROM candles), fs AS (SELECT symbol, ts, coalesce(abs(p - lag(p) OVER {_L}) < 1e-7, false) AS s FROM fp),
    fc AS (SELECT *, CASE WHEN s = lag(s) OVER {_L} THEN 0 ELSE 1 END AS c FROM fs), fr AS (SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM fc)"""
_TRIANGLE = f"""tr AS (SELECT *, max(high) OVER w AS top, list(high) OVER w AS hs, regr_slope(low, x) OVER w AS slope FROM (SELECT *, row_number() OVER {_L}::DOUBLE AS x FROM candles) WINDOW w AS {_w(40)}),
    ts2 AS (SELECT symbol, ts, slope, len(list_filter(hs, lambda h: h >= top * 0.98::DOUBLE)) AS touches, len(hs) AS n FROM tr)"""
_STRENGTH = f"""f10 AS (SELECT *, max(high) OVER w AS hi, min(low) OVER w AS lo, count(high) OVER w AS n FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
    lv AS (SELECT DISTINCT symbol, source, price FROM (SELECT symbol, 'high' AS source, high AS price FROM f10 WHERE n = 21 AND high = hi UNION ALL SELECT symbol, 'low', low FROM f10 WHERE n = 21 AND low = lo)),
    la AS (SELECT symbol, arg_max(close, ts) AS last FROM candles GROUP BY 1), ag AS (SELECT a.symbol, a.source, a.price, count(DISTINCT b.source) AS agree FROM lv a LEFT JOIN lv b ON a.symbol = b.symbol AND a.source <> b.source AND abs(b.price / a.price - 1) <= 0.005 GROUP BY 1, 2, 3),
    st AS (SELECT symbol, source, price, CASE WHEN source = 'high' THEN 1.0 ELSE 0.8 END::DOUBLE AS weight, 2 AS touches, agree, last, 10 + CASE WHEN source = 'high' THEN 25 ELSE 20 END::DOUBLE + least(agree, 3) * 10 + greatest(0, 1 - abs(price / last - 1) * 10) * 20 AS score,
    CASE WHEN price < last THEN 'support' ELSE 'resistance' END AS side FROM ag JOIN la USING (symbol))"""
_EXITS = f"""rt AS (SELECT symbol, ts, r FROM (SELECT *, ln(close / lag(close) OVER {_L}) AS r FROM candles) WHERE r IS NOT NULL), en AS (SELECT symbol, ts FROM (SELECT *, avg(r) OVER w AS mean, count(r) OVER w AS n FROM rt WINDOW w AS {_w(20)}) WHERE n >= 20 AND mean > 0),
    nb AS (SELECT *, row_number() OVER {_L} AS i FROM candles), pa AS (SELECT a.symbol, a.ts, a.close AS entry, b.ts AS b_ts, b.i - a.i AS k, b.close, b.low <= a.close * 0.95::DOUBLE AS stop, b.high >= a.close * 1.1::DOUBLE AS target FROM en JOIN nb a USING (symbol, ts) JOIN nb b ON b.symbol = a.symbol AND b.i > a.i AND b.i <= a.i + 20),
    ex AS (SELECT * FROM pa QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY CASE WHEN stop OR target THEN 0 ELSE 1 END, CASE WHEN stop OR target THEN k ELSE -k END) = 1),
    eo AS (SELECT symbol, ts, b_ts AS exit_ts, CASE WHEN stop THEN 'stop' WHEN target THEN 'target' ELSE 'time' END AS reason, CASE WHEN stop THEN entry * 0.95::DOUBLE WHEN target THEN entry * 1.1::DOUBLE ELSE close END / entry - 1 - 0.0008::DOUBLE AS profit FROM ex)"""
_FEATURES = f"""fe AS (SELECT symbol, ts, close / lag(close) OVER l - 1 AS return_1, close / lag(close, 5) OVER l - 1 AS return_5, close / lag(close, 15) OVER l - 1 AS return_15, least(5.0::DOUBLE, volume / avg(volume) OVER w) AS volume_ratio, (close / lag(close) OVER l - 1) * 2 AS return_1_again
    FROM candles WINDOW w AS {_w(20)}, l AS {_L})"""
_NAMES = ("return_1", "return_5", "return_15", "volume_ratio", "return_1_again")

market.ORACLE |= {
    "pat_candles": sql("candles", more=_LAGGED, select="SELECT symbol, ts, concat_ws(',', " + ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in _PATTERNS.items()) + ") AS patterns FROM lg"),
}
decisions.ORACLE |= {
    "vwap_zones": sql("trades", "sided", more=_BANDS, select="""SELECT symbol, window_end, round(d, 4) AS distance, CASE WHEN d >= 3 THEN 'extreme_above' WHEN d >= 2 THEN 'far_above' WHEN d >= 1 THEN 'above' WHEN d > -1 THEN 'fair' WHEN d > -2 THEN 'below' WHEN d > -3 THEN 'far_below' ELSE 'extreme_below' END AS zone FROM vz"""),
    "model_frozen": sql("candles", more=_FROZEN, select="SELECT symbol, ts, s AND row_number() OVER (PARTITION BY symbol, run ORDER BY ts) >= 3 AS frozen FROM fr"),
    "pat_triangle": sql("candles", more=_TRIANGLE, select="SELECT symbol, ts, touches, round(slope, 3) AS slope FROM ts2 WHERE n >= 40 AND touches >= 3 AND slope > 0"),
    "decision_fusion": sql(more="""fu AS (SELECT c_custkey AS id, CASE WHEN c_nationkey / 25 >= 0.1 AND c_custkey % 101 BETWEEN 1 AND 99 THEN (c_custkey % 101) / 100 * 2 - 1 END AS m, (c_custkey % 21) / 10 - 1 AS r FROM customer),
        fv AS (SELECT id, coalesce(m * 0.6::DOUBLE + r * 0.4::DOUBLE, r) AS total, coalesce(m * r < 0 AND abs(m) > 0.5 AND abs(r) > 0.5, false) AS conflict FROM fu)""",
        select="SELECT id, round(total, 6) AS total, conflict, CASE WHEN conflict THEN 'HOLD' WHEN total > 0.2 THEN 'BUY' WHEN total < -0.2 THEN 'SELL' ELSE 'HOLD' END AS action FROM fv"),
    "funding_sentiment": sql("candles", more="fd AS (SELECT ts, avg((close / open - 1) / 1000) AS m, count(*) FILTER (close / open - 1 > 0) AS positive, count(*) FILTER (close / open - 1 < 0) AS negative FROM candles GROUP BY 1)",
        select="""SELECT ts, round(m, 6) AS mean, positive, negative, CASE WHEN m > 0.001 THEN 'very_bullish' WHEN m > 0.0003 THEN 'bullish' WHEN m > 0 THEN 'mild' WHEN m > -0.0003 THEN 'cautious' WHEN m > -0.001 THEN 'bearish' ELSE 'very_bearish' END AS sentiment,
        round(m - lag(m) OVER (ORDER BY ts), 6) AS "change" FROM fd"""),
    "lvl_strength_scores": sql("candles", more=_STRENGTH, select="SELECT symbol, source, round(price, 4) AS price, round(weight, 4) AS weight, touches, agree, round(last, 4) AS last, round(score, 4) AS score, side FROM st"),
    "lvl_asymmetry": sql("candles", more=_STRENGTH + ", sa AS (SELECT symbol, sum(CASE WHEN side = 'support' THEN score ELSE 0 END) AS s, sum(CASE WHEN side = 'resistance' THEN score ELSE 0 END) AS r FROM st GROUP BY 1)",
        select="SELECT symbol, round(s, 3) AS support, round(r, 3) AS resistance, round(s / nullif(r, 0), 3) AS ratio, CASE WHEN s / nullif(r, 0) > 1.5 THEN 'bullish' WHEN s / nullif(r, 0) < 1 / 1.5 THEN 'bearish' ELSE 'balanced' END AS bias FROM sa"),
    "dataset_drop_constant": sql("candles", more=_FEATURES, select=" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) > 1 AS kept FROM fe" for c in ("return_1", "return_5", "volume_ratio")) + " UNION ALL SELECT 'constant', count(*), false FROM fe"),
}
analysis.ORACLE |= {
    "backtest_exits": sql("candles", more=_EXITS, select="SELECT symbol, ts, exit_ts, reason, round(profit, 6) AS profit FROM eo"),
    "perf_profit_factor": sql("candles", more=_EXITS, select="""SELECT symbol, count(*) AS n, round(avg((profit > 0)::INT), 6) AS win_rate, round(CASE WHEN sum(least(profit, 0)) < 0 THEN sum(greatest(profit, 0)) / -sum(least(profit, 0)) ELSE 999 END, 6) AS profit_factor, round(avg(profit), 6) AS mean FROM eo GROUP BY 1"""),
    "ml_corr_prune": sql("candles", more=_FEATURES, select=" UNION ALL ".join(f"SELECT '{a}|{b}' AS pair, round(corr({a}, {b}), 6) AS r, abs(corr({a}, {b})) > 0.95 AS \"drop\" FROM fe" for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :])),
    "fn_redact": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(api[_-]?key|token|secret|password)(\s*[=:]\s*)("[^"]*"|\S+)', '\1\2***', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g'), '[0-9]{13,19}', '<number>', 'g')) AS hash FROM documents""",
}


def _recursion(seed: str, step: str, rows: str, columns: str, select: str, more: str) -> str:
    """A recurrence over numbered rows (symbol, n, ...): ``seed`` of the first row, ``step`` of the others from the row before (e)."""
    walk = f"e AS (SELECT symbol, n, {seed} FROM {rows} WHERE n = 1 UNION ALL SELECT r.symbol, r.n, {step} FROM e JOIN {rows} r ON r.symbol = e.symbol AND r.n = e.n + 1)"
    return sql("candles", more=f"{more}, {walk}", select=f"SELECT {columns} FROM e JOIN {rows} USING (symbol, n) {select}").replace("WITH ", "WITH RECURSIVE ", 1)


_ROWS = f"rw AS (SELECT *, row_number() OVER {_L} AS n, close - lag(close) OVER {_L} AS d, greatest(high - low, abs(high - lag(close) OVER {_L}), abs(low - lag(close) OVER {_L})) AS tr FROM candles)"
_MEAN = lambda x, w, e: f"{w} * ({x}) + (1 - {w}) * e.{e}"
_G, _S, _F, _A = "(1.0::DOUBLE / 14)", "(2.0::DOUBLE / 27)", "(2.0::DOUBLE / 13)", "(2.0::DOUBLE / 15)"
market.ORACLE |= {
    "mdl_kalman": _recursion(
        "close AS x, 1.0::DOUBLE AS v", "e.x + (e.v + 0.01::DOUBLE) / (e.v + 1.01::DOUBLE) * (r.close - e.x), (1 - (e.v + 0.01::DOUBLE) / (e.v + 1.01::DOUBLE)) * (e.v + 0.01::DOUBLE)", "rw",
        "symbol, ts, round(x, 4) AS level, round((close / x - 1) * 100, 4) AS deviation", "", _ROWS,
    ),
    "ind_recursive": _recursion(
        "CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l, close AS f, close AS s, close AS e21, tr AS a, 0.0::DOUBLE AS sg",
        f"CASE WHEN r.n = 2 THEN greatest(r.d, 0) ELSE {_MEAN('greatest(r.d, 0)', _G, 'g')} END, CASE WHEN r.n = 2 THEN greatest(-r.d, 0) ELSE {_MEAN('greatest(-r.d, 0)', _G, 'l')} END, "
        f"{_MEAN('r.close', _F, 'f')}, {_MEAN('r.close', _S, 's')}, {_MEAN('r.close', '(2.0::DOUBLE / 22)', 'e21')}, {_MEAN('r.tr', _A, 'a')}, "
        f"{_MEAN(_MEAN('r.close', _F, 'f') + ' - (' + _MEAN('r.close', _S, 's') + ')', '0.2::DOUBLE', 'sg')}", "rw",
        "symbol, ts, round(CASE WHEN n > 14 THEN CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) ELSE 100 END END, 4) AS rsi_wilder, round(f - s, 4) AS macd, round(sg, 4) AS macd_signal, round(e21, 4) AS ema_21, "
        "round(CASE WHEN n >= 14 THEN a END, 4) AS atr_ewm", "", _ROWS,
    ),
}
decisions.ORACLE |= {
    "ind_timeframe_trend": _recursion(
        "close AS x", _MEAN("r.close", "(2.0::DOUBLE / 22)", "x"), "wk", "symbol, period, round(close, 4) AS close, round(x, 4) AS ema, CASE WHEN close > x THEN 'up' ELSE 'down' END AS trend", "",
        "wp AS (SELECT symbol, epoch_us(date_trunc('week', to_timestamp(ts / 1000) AT TIME ZONE 'UTC')) // 1000 AS period, arg_max(close, ts) AS close FROM candles GROUP BY 1, 2), wk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY period) AS n FROM wp)",
    ),
    "mdl_vol_forecast": _recursion(
        "CAST(NULL AS DOUBLE) AS x", "CASE WHEN r.n = 5 THEN r.five WHEN r.n > 5 THEN 0.94::DOUBLE * e.x + (1 - 0.94::DOUBLE) * r.vol * r.vol END", "vr", "symbol, ts, round(CASE WHEN n >= 5 THEN sqrt(x) ELSE 1.05::DOUBLE * vol END, 6) AS forecast", "",
        f"lr AS (SELECT symbol, ts, ln(close / lag(close) OVER {_L}) AS r FROM candles), lv AS (SELECT symbol, ts, CASE WHEN count(r) OVER {_w(20)} >= 20 THEN stddev_pop(r) OVER {_w(20)} * sqrt(20.0::DOUBLE) END AS vol FROM lr), "
        f"vr AS (SELECT *, row_number() OVER {_L} AS n, var_pop(vol) OVER {_w(5)} AS five FROM lv WHERE vol IS NOT NULL)",
    ),
}
