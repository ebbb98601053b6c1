"""Validation, repair and de-duplication of trades and candles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running_max, tick_side

ORDER = ["t", "seq"]


def valid_trades(trades: DataFrame) -> DataFrame:
    """Trades with positive price, quantity and time; a missing taker side stays null."""
    return trades.where("p > 0 AND q > 0 AND t > 0")


def reject_reason(trades: DataFrame, columns: tuple[str, ...] = ("p", "q", "t")) -> DataFrame:
    """``trades`` with the first rule that each row breaks, or null: a value for all ``columns``, then a positive one."""
    missing = [F.when(F.col(c).isNull(), f"missing_{c}") for c in columns]
    invalid = [F.when(F.isnan(c) | (F.col(c) <= 0), f"invalid_{c}_value") for c in columns]
    return trades.withColumn("reason", F.coalesce(*missing, *invalid))


def infer_side(trades: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``trades`` with m filled: as given, else by the price move (up buys, down sells), else
    as the trade before, else false (buy)."""
    return tick_side(trades, list(by), ORDER).withColumn("m", F.coalesce("m", F.lit(False)))


def check_ohlc(candles: DataFrame) -> DataFrame:
    """``candles`` with is_valid and repaired prices: the high is the greatest, the low the
    least of the positive prices, a missing open or close is the other or 1."""
    valid = F.expr("open > 0 AND close > 0 AND high >= low AND high >= greatest(open, close) AND low <= least(open, close)")
    good = lambda c: F.when(F.col(c) > 0, F.col(c))
    o, c = F.coalesce(good("open"), good("close"), F.lit(1.0)), F.coalesce(good("close"), good("open"), F.lit(1.0))
    return candles.withColumns(
        {
            "is_valid": F.coalesce(valid, F.lit(False)),
            "fixed_open": o,
            "fixed_close": c,
            "fixed_high": F.greatest(o, c, good("high"), good("low")),
            "fixed_low": F.least(o, c, good("high"), good("low")),
        }
    )


def event_id(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with an md5 of the named columns as event identity."""
    return df.withColumn("event_hash", F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))))


def dedup(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, by partial aggregation: only one row
    of a key leaves each task, however many share it."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def stale(trades: DataFrame, as_of: int, max_age_ms: int) -> DataFrame:
    return trades.withColumn("age_ms", F.lit(as_of) - F.col("t")).withColumn("is_stale", F.col("age_ms") > max_age_ms)


def clamp_late(trades: DataFrame, by: tuple[str, ...] = ("symbol",), bucket: int = 100_000) -> DataFrame:
    """``trades`` with t raised to the largest t that arrived before, in runs of ``bucket`` sequence numbers."""
    return running_max(trades, "t", list(by), ["seq"], bucket)


def quality_score(windows: DataFrame) -> DataFrame:
    """100 less the penalty of every broken rule, and whether at least 70 is left."""
    # Penalties of the rules.
    rules = {
        "no_trades": ("n < 10", 25),
        "flat": ("high = low", 30),
        "one_sided": ("buy_volume = 0 OR sell_volume = 0", 15),
        "whale_only": ("whale_volume >= volume * 0.9", 10),
        "wide": ("high > low * 10", 20),
    }
    score = F.lit(100)
    for rule, points in rules.values():
        score = score - F.when(F.expr(rule), points).otherwise(0)
    flags = F.array_compact(F.array(*(F.when(F.expr(r), n) for n, (r, _) in rules.items())))
    return windows.withColumns({"score": score, "flags": F.concat_ws(",", flags)}).withColumn("is_valid", F.col("score") >= 70)
