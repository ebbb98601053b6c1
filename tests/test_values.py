"""Values of operators that have no SQL twin, against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeflow.operators import bars, book, crossasset, decisions, models
from tapeflow.operators import indicators as ind

DAY = 86_400_000


@pytest.fixture(scope="module")
def closes():
    rng = np.random.default_rng(12)
    return {s: 100 + np.cumsum(rng.normal(0, 1, 200)) for s in ("a", "b")}


@pytest.fixture(scope="module")
def candles(spark, closes):
    rows = [(s, i * 3 * DAY, float(c), float(c) + 1, float(c) - 1, float(c), 1.0 + i % 3) for s, x in closes.items() for i, c in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, ts bigint, open double, high double, low double, close double, volume double").repartition(3)


def of(df, symbol, order="ts"):
    return df.where(F.col("symbol") == symbol).toPandas().sort_values(order).reset_index(drop=True)


def test_regression_channel(candles, closes):
    got = of(ind.regression_channel(candles, 20), "a")
    x = np.arange(20)
    for i in range(19, 200):
        y = closes["a"][i - 19 : i + 1]
        slope, start = np.polyfit(x, y, 1)
        line = slope * x + start
        assert got["slope"][i] == pytest.approx(slope, abs=1e-8) and got["middle"][i] == pytest.approx(line[-1], abs=1e-8)
        assert got["deviation"][i] == pytest.approx(np.std(y - line), abs=1e-6)
        assert got["place"][i] == pytest.approx((y[-1] - line[-1]) / np.std(y - line), rel=1e-5)
    assert got["slope"][:19].isna().all()


def test_volatility_forecast_from_the_first_five(candles):
    vols = candles.select("symbol", "ts", (F.col("close") / 1000).alias("vol"))
    got, v = of(decisions.vol_forecast(vols), "b"), of(vols, "b")["vol"].to_numpy()
    var, want = None, []
    for i, x in enumerate(v):
        var = np.var(v[:5]) if i == 4 else 0.94 * var + 0.06 * x * x if i > 4 else None
        want.append(np.sqrt(var) if var is not None else 1.05 * x)
    np.testing.assert_allclose(got["forecast"], want, rtol=1e-9)


def test_timeframe_trend(candles, closes):
    got = of(decisions.timeframe_trend(candles, "week"), "a", "period")
    weeks = pd.Series(closes["a"], index=pd.to_datetime(np.arange(200) * 3 * DAY, unit="ms")).resample("W-SUN").last().dropna()
    ema = weeks.ewm(span=21, adjust=False).mean()
    np.testing.assert_allclose(got["close"], weeks)
    np.testing.assert_allclose(got["ema"], ema, rtol=1e-9)
    assert list(got["trend"]) == ["up" if c > e else "down" for c, e in zip(weeks, ema, strict=True)]


def test_spectral(candles, spark):
    got = {r["symbol"]: r for r in models.spectral(candles).collect()}
    x = of(candles, "a")["close"].to_numpy()
    lags = [2, 4, 8, 16, 32]
    slope = np.polyfit(np.log(lags), np.log([np.std(x[n:] - x[:-n]) for n in lags]), 1)[0]
    assert got["a"]["hurst"] == pytest.approx(slope) and got["a"]["fractal_dimension"] == pytest.approx(2 - slope)
    wave = [("w", i, float(50 + 5 * np.sin(2 * np.pi * i / 25) + np.sin(2 * np.pi * i / 10))) for i in range(200)]
    cycles = models.spectral(spark.createDataFrame(wave, "symbol string, ts bigint, close double"), 2).first()["periods"]
    assert cycles == pytest.approx([25.0, 10.0])


def test_book_microstructure(spark):
    rows = [("s", "bid", 100.0, 2.0, 1), ("s", "bid", 99.0, 1.0, 2), ("s", "ask", 101.0, 4.0, 3), ("t", "ask", 50.0, 1.0, 4)]
    got = {(r["snapshot"], r["side"]): r for r in book.microstructure(spark.createDataFrame(rows, "snapshot string, side string, price double, qty double, seq int")).collect()}
    assert got["s", "bid"]["vwap"] == pytest.approx(299 / 3) and got["s", "bid"]["mean_distance_bps"] == pytest.approx(50.0)
    assert got["s", "ask"]["vwap"] == 101 and got["t", "ask"]["mean_distance_bps"] == 0


def test_imbalance_bars_and_cooldown_equal_a_loop(spark):
    rng = np.random.default_rng(4)
    t = np.cumsum(rng.integers(0, 20_000_000, 300))
    rows = [("a", float(rng.integers(1, 9)), float(rng.integers(1, 5)), int(x), bool(rng.random() < 0.5), i) for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "symbol string, p double, q double, t bigint, m boolean, seq bigint").repartition(4)
    width, want, held, start = 90_000_000, [], [], None
    for _, p, q, at, m, seq in rows:
        if start is None:
            start = (at, seq, p)
        elif at - start[0] >= width:
            sums = [sum(x[1] for x in held if x[2] == side) for side in (False, True)]
            want.append((*start[:2], *sums, start[2], held[-1][0]))
            held, start = [], None
        held.append((p, q, m))
    got = bars.imbalance_bars(df, width)
    assert sorted((r["t"], r["seq"], r["buy_volume"], r["sell_volume"], r["open"], r["close"]) for r in got.collect()) == want and len(want) > 20
    kept, last = [], None
    for x in want:
        if last is None or x[0] - last >= 500_000_000:
            kept.append(x[0])
            last = x[0]
    assert sorted(r["t"] for r in bars.cooled(got.select("symbol", "t", "seq"), 500_000_000).collect()) == kept and 1 < len(kept) < len(want)


def test_cross_asset_equals_pandas(spark, candles, closes):
    rng = np.random.default_rng(3)
    days = sorted(rng.choice(600, 250, replace=False))
    level = 50 + np.cumsum(rng.normal(0, 1, 250))
    references = spark.createDataFrame([("r", int(d) * DAY, float(x)) for d, x in zip(days, level, strict=True)], "symbol string, ts bigint, close double")
    got = of(crossasset.cross_asset(candles, references), "a")
    times = np.arange(200) * 3
    at = np.searchsorted(days, times, side="right") - 1
    frame = pd.DataFrame({"x": closes["a"], "y": np.where(at >= 0, level[np.maximum(at, 0)], np.nan)}, index=pd.to_datetime(times, unit="D"))
    moves = frame.pct_change(fill_method=None)
    both = moves.dropna()
    for n in (30, 90):
        want = both["x"].rolling(f"{n}D").corr(both["y"]).reindex(moves.index)
        for value, plain, count in zip(got[f"corr_{n}d"], want, both["x"].rolling(f"{n}D").count().reindex(moves.index), strict=True):
            if count >= 5 and plain == plain and abs(plain) < 1 - 1e-9:
                assert value == pytest.approx(plain, abs=1e-7)
    assert (got["stability"].dropna() >= 0).all() and set(got["regime"]) <= {"UNKNOWN", "STRONG_INVERSE", "STRONG_POSITIVE", "MODERATE_INVERSE", "MODERATE_POSITIVE", "DECORRELATED"}
