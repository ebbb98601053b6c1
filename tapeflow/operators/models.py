"""Statistical models of candle series: GARCH, Kalman, regimes, entropy, Hurst, cycles, Monte Carlo."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .indicators import SCAN_MS, fold, line, over
from .running import affine, numbered, previous


def returns(candles: DataFrame) -> DataFrame:
    r = F.ln(F.try_divide(F.col("close"), F.lag("close").over(line())))
    return candles.select("symbol", "ts", "close", r.alias("r")).where("r IS NOT NULL")


def garch(candles: DataFrame, omega: float = 1e-6, alpha: float = 0.1, beta: float = 0.85) -> DataFrame:
    """GARCH(1,1) variance of log returns: from the first squared return, then
    omega + alpha * previous squared return + beta * previous variance: a scan of affine maps."""
    by, order = ["symbol"], ["ts"]
    rows = previous(candles.select("symbol", "ts", "close"), "close", "_close", by, order, SCAN_MS)
    rows = rows.withColumn("r", F.ln(F.try_divide("close", "_close"))).where("r IS NOT NULL")
    rows = previous(rows, "r", "_r", by, order, SCAN_MS)
    first, r = F.col("_r").isNull(), F.col("r")
    maps = {"variance": (F.when(first, 0.0).otherwise(beta), F.when(first, r * r).otherwise(omega + alpha * F.col("_r") * F.col("_r")))}
    return affine(rows, maps, by, order, SCAN_MS).select("symbol", "ts", "variance")


def garch_forecast(variances: DataFrame, steps: int = 5, omega: float = 1e-6, alpha: float = 0.1, beta: float = 0.85) -> DataFrame:
    """Expected variance 1 to ``steps`` ahead of the last: it returns to the long-run level."""
    last = variances.groupBy("symbol").agg(F.max_by("variance", "ts").alias("v"))
    level = omega / (1 - alpha - beta)
    h = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("h")
    out = last.select("symbol", "v", h)
    return out.select("symbol", "h", (level + F.pow(F.lit(alpha + beta), F.col("h")) * (F.col("v") - level)).alias("variance"))


def _gains(q: float, r: float) -> list[float]:
    """Gains of a scalar Kalman filter from its second row on, up to the one that they settle at."""
    out, p = [], 1.0
    while True:
        p += q
        k = p / (p + r)
        p *= 1 - k
        if out and abs(k - out[-1]) <= 1e-15:
            return out
        out.append(k)


def kalman(candles: DataFrame, q: float = 0.01, r: float = 1.0) -> DataFrame:
    """Scalar Kalman filter of the close and its deviation in percent. The gain depends on the row's number alone and
    settles, so the level is a scan of affine maps."""
    by, order = ["symbol"], ["ts"]
    gains = _gains(q, r)
    rows = numbered(candles.select("symbol", "ts", "close"), "_n", by, order, SCAN_MS)
    k = F.when(F.col("_n") == 1, 1.0).otherwise(F.get(F.array(*map(F.lit, gains)), F.least(F.col("_n") - 2, F.lit(len(gains) - 1)).cast("int")))
    rows = affine(rows.withColumn("_k", k), {"level": (1 - F.col("_k"), F.col("_k") * F.col("close"))}, by, order, SCAN_MS)
    return rows.select("symbol", "ts", "level", ((F.col("close") / F.col("level") - 1) * 100).alias("deviation"))


def regimes(candles: DataFrame, n: int = 20) -> DataFrame:
    """Label of each candle by mean and deviation of the last ``n`` returns."""
    rows = returns(candles)
    mean, dev = F.avg("r").over(over(n)), F.stddev_pop("r").over(over(n))
    rows = rows.withColumns({"mean": mean, "deviation": dev, "_n": F.count("r").over(over(n))}).where(F.col("_n") >= n)
    label = (
        F.when(F.col("mean") > F.col("deviation") * 0.2 + 1e-12, "bull").when(F.col("mean") < F.col("deviation") * -0.2 - 1e-12, "bear")
        .when(F.col("deviation") > 1.0, "volatile").otherwise("range")
    )
    return rows.select("symbol", "ts", "mean", "deviation", label.alias("regime"))


def transitions(regime_rows: DataFrame) -> DataFrame:
    """Counts and shares of moves from each regime to each."""
    rows = regime_rows.withColumn("before", F.lag("regime").over(line())).where("before IS NOT NULL")
    counts = rows.groupBy("symbol", "before", "regime").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("symbol", "before")))


def entropy(candles: DataFrame, bins: int = 20) -> DataFrame:
    """Shannon entropy in bits of a symbol's returns over equal bins of their range."""
    rows = returns(candles)
    ends = rows.groupBy("symbol").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    place = F.least(F.floor((F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counts = rows.join(ends, "symbol").groupBy("symbol", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("symbol"))
    return counts.withColumn("_p", share).groupBy("symbol").agg(F.sum(-F.col("_p") * F.log2("_p")).alias("bits"), F.count(F.lit(1)).alias("bins"))


def spectral(candles: DataFrame, k: int = 3) -> DataFrame:
    """Hurst exponent (slope of log deviation against log lag), Higuchi-like roughness and the
    ``k`` strongest cycle lengths of each symbol's closes."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["close"].to_numpy()
        lags = np.array([n for n in (2, 4, 8, 16, 32) if n < len(x) // 2])
        hurst = np.nan
        if len(lags) > 1:
            spread = np.array([np.std(x[n:] - x[:-n]) for n in lags])
            if (spread > 0).all():
                hurst = np.polyfit(np.log(lags), np.log(spread), 1)[0]
        line_fit = np.polyval(np.polyfit(np.arange(len(x)), x, 1), np.arange(len(x))) if len(x) > 2 else x
        power = np.abs(np.fft.rfft(x - line_fit)) ** 2
        top = [len(x) / i for i in (np.argsort(-power[1:])[:k] + 1)] if len(power) > 1 else []
        return pd.DataFrame([(pdf["symbol"].iloc[0], hurst, 2 - hurst, top)], columns=["symbol", "hurst", "fractal_dimension", "periods"])

    kind = dict(candles.dtypes)["symbol"]
    return fold(candles, step, f"symbol {kind}, hurst double, fractal_dimension double, periods array<double>")


def monte_carlo(candles: DataFrame, steps: int = 24, paths: int = 1000, seed: int = 42) -> DataFrame:
    """Percentiles of simulated end prices, value at risk and the chance of a rise. Random
    numbers come from a linear congruential generator, so results repeat."""

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.diff(np.log(pdf["close"].to_numpy()))
        mean, dev, last = (r.mean(), r.std(), pdf["close"].iloc[-1]) if len(r) else (0.0, 0.0, pdf["close"].iloc[-1])
        n = steps * paths * 2
        state, u = seed, np.empty(n)
        for i in range(n):
            # Multiplier, increment and modulus of the generator.
            state = (1103515245 * state + 12345) % (1 << 31)
            u[i] = (state + 0.5) / (1 << 31)
        normal = np.sqrt(-2 * np.log(u[::2])) * np.cos(2 * np.pi * u[1::2])
        end = last * np.exp(np.cumsum((mean - dev * dev / 2 + dev * normal).reshape(paths, steps), 1)[:, -1])
        end.sort()
        at = lambda share: float(end[min(paths - 1, int(paths * share))])
        tail = end[: max(1, int(paths * 0.05))]
        row = (pdf["symbol"].iloc[0], at(0.05), at(0.5), at(0.95), float((end > last).mean()), last - at(0.05), last - float(tail.mean()))
        return pd.DataFrame([row], columns=["symbol", "p5", "p50", "p95", "rise", "var_95", "cvar_95"])

    kind = dict(candles.dtypes)["symbol"]
    return fold(candles, step, f"symbol {kind}, p5 double, p50 double, p95 double, rise double, var_95 double, cvar_95 double")
