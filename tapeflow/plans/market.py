"""Queries: volume profiles, indicators, patterns and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators import models, profile
from ..sources.tables import candles_from_orders
from .base import DAY, rounded, sql
from .trading import sided

KEY = ("symbol", "ts")


def _profile(spark, d):
    return profile.binned_profile(sided(spark, d), DAY)


def vp_static20(spark, d):
    return rounded(profile.point_of_control(_profile(spark, d)))


def vp_bins(spark, d):
    return rounded(_profile(spark, d))


def vp_value_area_greedy(spark, d):
    return rounded(profile.value_area_greedy(_profile(spark, d)))


def vp_value_area_expand(spark, d):
    return rounded(profile.value_area_expand(_profile(spark, d)))


def vp_hvn_lvn(spark, d):
    return rounded(profile.nodes(_profile(spark, d)))


def vp_shape(spark, d):
    return rounded(profile.shape(_profile(spark, d)))


def vp_poor_extremes(spark, d):
    return rounded(profile.poor_extremes(_profile(spark, d)))


def vp_price1(spark, d):
    return rounded(profile.rounded_profile(sided(spark, d), DAY))


def vp_no_mans_land(spark, d):
    return rounded(profile.no_mans_land(profile.nodes(_profile(spark, d), 0.5)))


def vp_balance(spark, d):
    return rounded(profile.balance(_profile(spark, d)), 4)


def footprint_levels(spark, d):
    return rounded(profile.footprint(sided(spark, d), DAY, 10.0))


def footprint_imbalance(spark, d):
    return rounded(profile.imbalances(profile.footprint(sided(spark, d), DAY, 10.0)))


def footprint_stacked(spark, d):
    return profile.stacked(profile.footprint(sided(spark, d), DAY, 10.0))


def liquidation_heatmap(spark, d):
    return rounded(profile.liquidation_heatmap(sided(spark, d), 50.0))


def ind_vwap_bands(spark, d):
    return rounded(profile.vwap_bands(sided(spark, d), DAY), 4)


def _ind(operator, *columns, digits=4):
    def query(spark, d):
        return rounded(operator(candles_from_orders(spark, d)).select(*KEY, *columns), digits)

    return query


def _named(name, query):
    query.__name__ = name
    return query


ind_sma_bb = _named("ind_sma_bb", _ind(ind.bollinger, "sma", "upper", "lower", "percent_b"))
ind_rsi_sma = _named("ind_rsi_sma", _ind(ind.rsi, "rsi"))
ind_atr_sma = _named("ind_atr_sma", _ind(ind.atr, "tr", "atr"))
ind_adx_sum = _named("ind_adx_sum", _ind(ind.adx, "plus_di", "minus_di", "adx"))
ind_stoch = _named("ind_stoch", _ind(ind.stochastic, "k", "d"))
ind_williams = _named("ind_williams", _ind(ind.williams, "williams_r"))
ind_cci = _named("ind_cci", _ind(ind.cci, "cci"))
ind_realized_vol = _named("ind_realized_vol", _ind(ind.realized_volatility, "vol_scaled"))
ind_zscore_meanrev = _named("ind_zscore_meanrev", _ind(ind.mean_reversion, "z", "state"))
ind_regression_channel = _named("ind_regression_channel", _ind(ind.regression_channel, "slope", "middle", "deviation", "place", digits=3))
ind_recursive = _named("ind_recursive", _ind(ind.smoothed, "rsi_wilder", "macd", "macd_signal", "ema_21", "atr_ewm"))
ml_feature_rows = _named("ml_feature_rows", _ind(ind.price_features, "return_1", "return_5", "return_15", "volume_ratio"))
pat_candles = _named("pat_candles", _ind(ind.patterns, "patterns"))
pat_fib = _named("pat_fib", _ind(ind.fibonacci, "fib_236", "fib_382", "fib_500", "fib_618", "fib_786"))


def pat_fvg(spark, d):
    return rounded(ind.fair_value_gaps(candles_from_orders(spark, d)), 4)


def pat_fvg_fills(spark, d):
    candles = candles_from_orders(spark, d)
    return ind.gap_fills(ind.fair_value_gaps(candles), candles, 20 * DAY).select("symbol", "ts", "kind", "filled_at")


def pat_swings(spark, d):
    return rounded(ind.swings(candles_from_orders(spark, d)), 4)


def pat_bos(spark, d):
    return rounded(ind.structure_breaks(ind.swings(candles_from_orders(spark, d))), 4)


def pat_order_blocks(spark, d):
    return rounded(ind.order_blocks(candles_from_orders(spark, d)), 4)


def pat_sweeps(spark, d):
    return rounded(ind.sweeps(candles_from_orders(spark, d)), 4)


def mdl_garch(spark, d):
    return rounded(models.garch(candles_from_orders(spark, d)))


def mdl_garch_forecast(spark, d):
    return rounded(models.garch_forecast(models.garch(candles_from_orders(spark, d))))


def mdl_kalman(spark, d):
    return rounded(models.kalman(candles_from_orders(spark, d)), 4)


def mdl_regime_scores(spark, d):
    return rounded(models.regimes(candles_from_orders(spark, d)))


def mdl_regime_transitions(spark, d):
    return rounded(models.transitions(models.regimes(candles_from_orders(spark, d))))


def mdl_entropy(spark, d):
    return rounded(models.entropy(candles_from_orders(spark, d)))


def mdl_hurst_fft(spark, d):
    return rounded(models.spectral(candles_from_orders(spark, d)), 4)


def mdl_monte_carlo(spark, d):
    return rounded(models.monte_carlo(candles_from_orders(spark, d)), 4)


QUERIES = [
    vp_static20, vp_bins, vp_value_area_greedy, vp_value_area_expand, vp_hvn_lvn, vp_shape, vp_poor_extremes, vp_price1, vp_no_mans_land,
    vp_balance, footprint_levels, footprint_imbalance, footprint_stacked, liquidation_heatmap, ind_vwap_bands, ind_sma_bb, ind_rsi_sma, ind_atr_sma,
    ind_adx_sum, ind_stoch, ind_williams, ind_cci, ind_realized_vol, ind_zscore_meanrev, ind_regression_channel, ind_recursive, ml_feature_rows,
    pat_candles, pat_fib, pat_fvg, pat_fvg_fills, pat_swings, pat_bos, pat_order_blocks, pat_sweeps, mdl_garch, mdl_garch_forecast, mdl_kalman,
    mdl_regime_scores, mdl_regime_transitions, mdl_entropy, mdl_hurst_fft, mdl_monte_carlo,
]

_PROFILE = """ends AS (SELECT *, (t // 86400000 + 1) * 86400000 AS window_end, min(p) OVER (PARTITION BY symbol, t // 86400000) AS lo,
    max(p) OVER (PARTITION BY symbol, t // 86400000) AS hi FROM sided), prof AS (SELECT symbol, window_end, bin, lo + (bin + 0.5) * (hi - lo) / 20 AS price, volume FROM
    (SELECT symbol, window_end, lo, hi, CASE WHEN hi > lo THEN least(floor((p - lo) / ((hi - lo) / 20))::BIGINT, 19) ELSE 0 END AS bin,
    sum(CAST(q AS DECIMAL(20,8)))::DOUBLE AS volume FROM ends GROUP BY ALL))"""
_NODES = _PROFILE + """, nodes AS (SELECT *, CASE WHEN volume > m + d * {k} + 1e-9 THEN 'HVN' WHEN volume < m - d * {k} - 1e-9 THEN 'LVN' END AS kind,
    CASE WHEN d <> 0 THEN (volume - m) / d END AS z FROM (SELECT *, avg(volume) OVER w AS m, stddev_pop(volume) OVER w AS d FROM prof WINDOW w AS (PARTITION BY symbol, window_end)))"""
_FOOT = """foot AS (SELECT symbol, (t // 86400000 + 1) * 86400000 AS window_end, floor(p / 10)::BIGINT AS level,
    sum(CAST(CASE WHEN NOT m THEN q ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS bought, sum(CAST(CASE WHEN m THEN q ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS sold, count(*) AS n FROM sided GROUP BY 1, 2, 3),
    imb AS (SELECT *, CASE WHEN bought > 0 AND bought >= sold * 3 THEN 'buy' WHEN sold > 0 AND sold >= bought * 3 THEN 'sell' END AS side FROM foot)"""
_S = ("trades", "sided")


def _w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_L = "(PARTITION BY symbol ORDER BY ts)"
_RET = f"ret AS (SELECT symbol, ts, close, r FROM (SELECT *, ln(close / lag(close) OVER {_L}) AS r FROM candles) WHERE r IS NOT NULL)"
_REG = _RET + f""", reg AS (SELECT symbol, ts, mean, deviation, CASE WHEN mean > deviation * 0.2 + 1e-12 THEN 'bull' WHEN mean < deviation * -0.2 - 1e-12 THEN 'bear'
    WHEN deviation > 1 THEN 'volatile' ELSE 'range' END AS regime FROM (SELECT *, avg(r) OVER w AS mean, stddev_pop(r) OVER w AS deviation, count(r) OVER w AS n FROM ret WINDOW w AS {_w(20)}) WHERE n >= 20)"""
_SW = """sw AS (SELECT * FROM (SELECT symbol, ts, 'high' AS kind, high AS price FROM f WHERE n = 7 AND high = hi UNION ALL SELECT symbol, ts, 'low', low FROM f WHERE n = 7 AND low = lo))"""
_SWF = f"""f AS (SELECT *, max(high) OVER w AS hi, min(low) OVER w AS lo, count(high) OVER w AS n FROM candles WINDOW w AS
    (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), {_SW}"""
_TR = f"tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {_L}), abs(low - lag(close) OVER {_L})) AS tr FROM candles)"
_FVG = f"""g AS (SELECT symbol, ts, kind, CASE WHEN kind = 'bullish' THEN h ELSE high END AS bottom, CASE WHEN kind = 'bullish' THEN low ELSE l END AS top FROM
    (SELECT *, CASE WHEN low > h * 1.0005::DOUBLE THEN 'bullish' WHEN high < l * (1 - 0.0005::DOUBLE) THEN 'bearish' END AS kind FROM
    (SELECT *, lag(high, 2) OVER {_L} AS h, lag(low, 2) OVER {_L} AS l FROM candles)) WHERE kind IS NOT NULL)"""


def _chain(first: str, then: str, name: str) -> str:
    """A recurrence over the numbered rows of each symbol."""
    return f"num AS (SELECT *, row_number() OVER {_L} AS i FROM ret), {name} AS (SELECT symbol, ts, i, r, {first} AS v FROM num WHERE i = 1 UNION ALL SELECT n.symbol, n.ts, n.i, n.r, {then} FROM {name} p JOIN num n ON n.symbol = p.symbol AND n.i = p.i + 1)"


_GARCH = "WITH RECURSIVE " + sql("candles", select="", more=_RET + ", " + _chain("r * r", "1e-6 + 0.1 * p.r * p.r + 0.85 * p.v", "ch"))[5:]

ORACLE = {
    "vp_price1": sql(*_S, select="SELECT symbol, (t // 86400000 + 1) * 86400000 AS window_end, round(p) AS price, sum(CAST(q AS DECIMAL(20,8)))::DOUBLE AS volume, count(*) AS n, count(*) = 1 AS single_print FROM sided GROUP BY 1, 2, 3"),
    "ind_vwap_bands": sql(*_S, select="SELECT symbol, window_end, round(vwap, 4) AS vwap, round(twap, 4) AS twap, round(dv, 4) AS deviation, " + ", ".join(f"round(vwap {s} {k} * dv, 4) AS {n}_{k}" for k in (1, 2, 3) for n, s in (("upper", "+"), ("lower", "-")))
        + """, round((twap - vwap) / vwap * 100, 4) AS divergence, CASE WHEN (twap - vwap) / vwap * 100 > 1 THEN 'twap_above' WHEN (twap - vwap) / vwap * 100 < -1 THEN 'twap_below' ELSE 'aligned' END AS signal FROM (SELECT *, sqrt(greatest(sq - vwap * vwap, 0)) AS dv FROM
        (SELECT symbol, (t // 86400000 + 1) * 86400000 AS window_end, sum(CAST(p * q AS DECIMAL(20,8)))::DOUBLE / sum(CAST(q AS DECIMAL(20,8)))::DOUBLE AS vwap, sum(CAST(p * p * q AS DECIMAL(20,8)))::DOUBLE / sum(CAST(q AS DECIMAL(20,8)))::DOUBLE AS sq,
        sum(CAST(p AS DECIMAL(20,8)))::DOUBLE / count(*) AS twap FROM sided GROUP BY 1, 2))"""),
    "vp_balance": sql(*_S, more=_PROFILE, select="""SELECT symbol, window_end, round(mean, 4) AS mean, sum(CAST(CASE WHEN price < mean - 1e-9 THEN volume ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS below, sum(CAST(CASE WHEN price >= mean - 1e-9 THEN volume ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS above,
        round(sqrt(sum(volume * (price - mean) ** 2) / sum(volume)), 4) AS spread FROM prof JOIN (SELECT symbol, window_end, sum(price * volume) / sum(volume) AS mean FROM prof GROUP BY 1, 2) USING (symbol, window_end) GROUP BY symbol, window_end, mean"""),
    "vp_bins": sql(*_S, more=_PROFILE, select="SELECT symbol, window_end, bin, round(price, 6) AS price, volume FROM prof"),
    "vp_static20": sql(*_S, more=_PROFILE, select="""SELECT symbol, window_end, bin AS poc_bin, round(price, 6) AS poc, round(volume / total, 6) AS poc_share, total AS volume FROM
        (SELECT *, sum(CAST(volume AS DECIMAL(20,8))) OVER (PARTITION BY symbol, window_end)::DOUBLE AS total, row_number() OVER (PARTITION BY symbol, window_end ORDER BY volume DESC, bin) AS k FROM prof) WHERE k = 1"""),
    "vp_value_area_greedy": sql(*_S, more=_PROFILE, select="""SELECT symbol, window_end, round(max(price), 6) AS vah, round(min(price), 6) AS val, count(*) AS bins FROM
        (SELECT *, sum(CAST(volume AS DECIMAL(20,8))) OVER (PARTITION BY symbol, window_end) AS total, coalesce(sum(CAST(volume AS DECIMAL(20,8))) OVER
        (PARTITION BY symbol, window_end ORDER BY volume DESC, bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM prof) WHERE before < total * 0.7 GROUP BY 1, 2"""),
    "vp_hvn_lvn": sql(*_S, more=_NODES.format(k="1.0"), select="SELECT symbol, window_end, bin, round(price, 6) AS price, volume, kind, round(z, 6) AS z FROM nodes WHERE kind IS NOT NULL"),
    "vp_shape": sql(*_S, more=_PROFILE, select="""SELECT *, CASE WHEN top / (bottom + middle + top) > 0.45 THEN 'P' WHEN bottom / (bottom + middle + top) > 0.45 THEN 'b' WHEN middle / (bottom + middle + top) > 0.5 THEN 'D'
        WHEN top / (bottom + middle + top) > 0.32 AND bottom / (bottom + middle + top) > 0.32 THEN 'B' ELSE 'Thin' END AS shape FROM (SELECT symbol, window_end,
        sum(CAST(CASE WHEN bin < 6 THEN volume ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS bottom, sum(CAST(CASE WHEN bin >= 6 AND bin < 14 THEN volume ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS middle,
        sum(CAST(CASE WHEN bin >= 14 THEN volume ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS top FROM prof GROUP BY 1, 2)"""),
    "vp_poor_extremes": sql(*_S, more=_PROFILE, select="""SELECT *, CASE WHEN high > volume / 10 * 0.5 THEN 'poor' WHEN high < volume / 10 * 0.2 THEN 'excess' ELSE 'normal' END AS high_extreme,
        CASE WHEN low > volume / 10 * 0.5 THEN 'poor' WHEN low < volume / 10 * 0.2 THEN 'excess' ELSE 'normal' END AS low_extreme FROM (SELECT symbol, window_end,
        sum(CAST(CASE WHEN bin >= 18 THEN volume ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS high, sum(CAST(CASE WHEN bin < 2 THEN volume ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS low,
        sum(CAST(volume AS DECIMAL(20,8)))::DOUBLE AS volume FROM prof GROUP BY 1, 2)"""),
    "vp_no_mans_land": sql(*_S, more=_NODES.format(k="0.5"), select="""SELECT symbol, window_end, round(price, 6) AS lower, round(upper, 6) AS upper, round(gap, 6) AS gap, rank FROM
        (SELECT *, row_number() OVER (PARTITION BY symbol, window_end ORDER BY gap DESC, price) AS rank FROM (SELECT *, lead(price) OVER (PARTITION BY symbol, window_end ORDER BY price) AS upper,
        lead(price) OVER (PARTITION BY symbol, window_end ORDER BY price) / price - 1 AS gap FROM nodes WHERE kind = 'HVN') WHERE gap > 0.003) WHERE rank <= 10"""),
    "footprint_levels": sql(*_S, more=_FOOT, select="SELECT * FROM foot"),
    "footprint_imbalance": sql(*_S, more=_FOOT, select="SELECT * FROM imb WHERE side IS NOT NULL"),
    "footprint_stacked": sql(*_S, more=_FOOT, select="""SELECT symbol, window_end, side, min(level) AS low, max(level) AS high, count(*) AS levels FROM
        (SELECT *, level - row_number() OVER (PARTITION BY symbol, window_end, side ORDER BY level) AS g FROM imb WHERE side IS NOT NULL) GROUP BY symbol, window_end, side, g HAVING count(*) >= 3"""),
    "liquidation_heatmap": sql(*_S, select="""SELECT symbol, floor(p / 50) * 50 AS price, sum(CAST(CASE WHEN m THEN p * q ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS long_value,
        sum(CAST(CASE WHEN NOT m THEN p * q ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS short_value FROM sided GROUP BY 1, 2"""),
    "ind_sma_bb": sql("candles", select=f"""SELECT symbol, ts, round(sma, 4) AS sma, round(sma + 2 * dev, 4) AS upper, round(sma - 2 * dev, 4) AS lower, round((close - (sma - 2 * dev)) / (4 * dev), 4) AS percent_b FROM
        (SELECT symbol, ts, close, CASE WHEN count(close) OVER w >= 20 THEN avg(close) OVER w END AS sma, CASE WHEN count(close) OVER w >= 20 THEN stddev_samp(close) OVER w END AS dev FROM candles WINDOW w AS {_w(20)})"""),
    "ind_rsi_sma": sql("candles", select=f"""SELECT symbol, ts, round(CASE WHEN n < 14 THEN NULL WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100.0 ELSE 50.0 END, 4) AS rsi FROM
        (SELECT symbol, ts, avg(greatest(d, 0)) OVER w AS g, avg(greatest(-d, 0)) OVER w AS l, count(d) OVER w AS n FROM (SELECT *, close - lag(close) OVER {_L} AS d FROM candles) WINDOW w AS {_w(14)})"""),
    "ind_atr_sma": sql("candles", more=_TR, select=f"SELECT symbol, ts, round(tr, 4) AS tr, round(CASE WHEN count(close) OVER w >= 14 THEN avg(tr) OVER w END, 4) AS atr FROM tr WINDOW w AS {_w(14)}"),
    "ind_adx_sum": sql("candles", more=_TR, select=f"""SELECT symbol, ts, round(pdi, 4) AS plus_di, round(mdi, 4) AS minus_di, round(CASE WHEN count(dx) OVER w >= 14 THEN avg(dx) OVER w END, 4) AS adx FROM
        (SELECT *, CASE WHEN pdi + mdi <> 0 THEN abs(pdi - mdi) / (pdi + mdi) * 100 END AS dx FROM (SELECT symbol, ts, CASE WHEN count(close) OVER w >= 14 THEN sum(pd) OVER w / sum(tr) OVER w * 100 END AS pdi,
        CASE WHEN count(close) OVER w >= 14 THEN sum(md) OVER w / sum(tr) OVER w * 100 END AS mdi FROM (SELECT *, CASE WHEN u > dn AND u > 0 THEN u ELSE 0 END AS pd, CASE WHEN dn > u AND dn > 0 THEN dn ELSE 0 END AS md FROM
        (SELECT *, high - lag(high) OVER {_L} AS u, lag(low) OVER {_L} - low AS dn FROM tr)) WINDOW w AS {_w(14)})) WINDOW w AS {_w(14)}"""),
    "ind_stoch": sql("candles", select=f"""SELECT symbol, ts, round(k, 4) AS k, round(CASE WHEN count(k) OVER w >= 3 THEN avg(k) OVER w END, 4) AS d FROM (SELECT symbol, ts, CASE WHEN count(close) OVER w >= 14 AND max(high) OVER w > min(low) OVER w
        THEN (close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w) * 100 END AS k FROM candles WINDOW w AS {_w(14)}) WINDOW w AS {_w(3)}"""),
    "ind_williams": sql("candles", select=f"""SELECT symbol, ts, round(coalesce(CASE WHEN count(close) OVER w >= 14 AND max(high) OVER w > min(low) OVER w
        THEN (max(high) OVER w - close) / (max(high) OVER w - min(low) OVER w) * -100 END, -50.0), 4) AS williams_r FROM candles WINDOW w AS {_w(14)}"""),
    "ind_cci": sql("candles", select=f"""SELECT symbol, ts, round(CASE WHEN len(a) >= 20 THEN (tp - m) / (list_avg(list_transform(a, lambda x: abs(x - m))) * 0.015) END, 4) AS cci FROM
        (SELECT symbol, ts, tp, avg(tp) OVER w AS m, list(tp) OVER w AS a FROM (SELECT *, (high + low + close) / 3 AS tp FROM candles) WINDOW w AS {_w(20)})"""),
    "ind_realized_vol": sql("candles", select=f"SELECT symbol, ts, round(CASE WHEN count(r) OVER w >= 20 THEN stddev_pop(r) OVER w * sqrt(20) END, 4) AS vol_scaled FROM (SELECT *, ln(close / lag(close) OVER {_L}) AS r FROM candles) WINDOW w AS {_w(20)}"),
    "ind_zscore_meanrev": sql("candles", select=f"""SELECT symbol, ts, round(z, 4) AS z, CASE WHEN abs(z) >= 2 THEN 'extended' WHEN abs(z) >= 1 THEN 'stretched' WHEN z IS NOT NULL THEN 'near' END AS state FROM
        (SELECT symbol, ts, CASE WHEN count(close) OVER w >= 20 THEN (close - avg(close) OVER w) / stddev_pop(close) OVER w END AS z FROM candles WINDOW w AS {_w(20)})"""),
    "ml_feature_rows": sql("candles", select=f"""SELECT symbol, ts, round(close / lag(close) OVER l - 1, 4) AS return_1, round(close / lag(close, 5) OVER l - 1, 4) AS return_5, round(close / lag(close, 15) OVER l - 1, 4) AS return_15,
        round(least(5.0::DOUBLE, volume / avg(volume) OVER w), 4) AS volume_ratio FROM candles WINDOW w AS {_w(20)}, l AS {_L}"""),
    "pat_fib": sql("candles", select="SELECT symbol, ts, " + ", ".join(f"round(hi - (hi - lo) * {r}::DOUBLE, 4) AS fib_{int(r * 1000 + 0.5)}" for r in (0.236, 0.382, 0.5, 0.618, 0.786))
        + f" FROM (SELECT symbol, ts, max(high) OVER w AS hi, min(low) OVER w AS lo FROM candles WINDOW w AS {_w(50)})"),
    "pat_fvg": sql("candles", more=_FVG, select="SELECT symbol, ts, kind, round(bottom, 4) AS bottom, round(top, 4) AS top FROM g"),
    "pat_fvg_fills": sql("candles", more=_FVG, select=f"""SELECT g.symbol, g.ts, any_value(kind) AS kind, min(CASE WHEN (least(high, top) - greatest(low, bottom)) / (top - bottom) >= 0.5 THEN c.ts END) AS filled_at
        FROM g LEFT JOIN candles c ON c.symbol = g.symbol AND c.ts > g.ts AND c.ts <= g.ts + {20 * DAY} GROUP BY 1, 2"""),
    "pat_swings": sql("candles", more=_SWF, select="SELECT * FROM sw"),
    "pat_bos": sql("candles", more=_SWF, select="""SELECT *, label IN ('HH', 'LL') AS breaks FROM (SELECT *, CASE WHEN kind = 'high' THEN CASE WHEN price > before THEN 'HH' ELSE 'LH' END ELSE CASE WHEN price > before THEN 'HL' ELSE 'LL' END END AS label
        FROM (SELECT *, lag(price) OVER (PARTITION BY symbol, kind ORDER BY ts) AS before FROM sw) WHERE before IS NOT NULL)"""),
    "pat_order_blocks": sql("candles", select=f"""SELECT symbol, ts, kind, low, high FROM (SELECT *, CASE WHEN s AND close < open AND c1 > o1 THEN 'bullish' WHEN s AND close > open AND c1 < o1 THEN 'bearish' END AS kind FROM
        (SELECT *, abs(c1 - o1) > abs(close - open) * 1.5 AND abs(c1 - o1) >= (h1 - l1) * 0.6::DOUBLE AS s FROM (SELECT *, lead(open) OVER l AS o1, lead(high) OVER l AS h1, lead(low) OVER l AS l1, lead(close) OVER l AS c1 FROM candles WINDOW l AS {_L}))) WHERE kind IS NOT NULL"""),
    "pat_sweeps": sql("candles", select="""SELECT symbol, ts, kind, CASE WHEN kind = 'high' THEN hi ELSE lo END AS level FROM (SELECT *, CASE WHEN high > hi AND close < hi THEN 'high' WHEN low < lo AND close > lo THEN 'low' END AS kind FROM
        (SELECT *, max(high) OVER w AS hi, min(low) OVER w AS lo, count(high) OVER w AS n FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) WHERE n = 10) WHERE kind IS NOT NULL"""),
    "mdl_garch": _GARCH + " SELECT symbol, ts, round(v, 6) AS variance FROM ch",
    "mdl_garch_forecast": _GARCH + """ SELECT symbol, h, round(1e-6 / (1 - 0.1 - 0.85) + (0.95::DOUBLE ** h) * (v - 1e-6 / (1 - 0.1 - 0.85)), 6) AS variance FROM (SELECT symbol, arg_max(v, ts) AS v FROM ch GROUP BY 1), (SELECT unnest(range(1, 6))::INTEGER AS h)""",
    "mdl_regime_scores": sql("candles", more=_REG, select="SELECT symbol, ts, round(mean, 6) AS mean, round(deviation, 6) AS deviation, regime FROM reg"),
    "mdl_regime_transitions": sql("candles", more=_REG, select=f"""SELECT symbol, before, regime, n, round(n / sum(n) OVER (PARTITION BY symbol, before), 6) AS share FROM (SELECT symbol, before, regime, count(*) AS n FROM
        (SELECT *, lag(regime) OVER {_L} AS before FROM reg) WHERE before IS NOT NULL GROUP BY 1, 2, 3)"""),
    "mdl_entropy": sql("candles", more=_RET, select="""SELECT symbol, round(sum(-p * log2(p)), 6) AS bits, count(*) AS bins FROM (SELECT symbol, n / sum(n) OVER (PARTITION BY symbol) AS p FROM (SELECT symbol,
        least(floor((r - lo) / (hi - lo) * 20), 19) AS b, count(*) AS n FROM (SELECT *, min(r) OVER (PARTITION BY symbol) AS lo, max(r) OVER (PARTITION BY symbol) AS hi FROM ret) GROUP BY 1, 2)) GROUP BY 1"""),
}
