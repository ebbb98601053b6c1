"""Repair of stored window records: times, volumes, deltas, order, rounding by field name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .clean import dedup
from .running import running_max

# Valid epochs (2021 to 2038), tolerance and digits of volumes, how far behind a record may come, greatest change of a book level.
FIRST_MS, LAST_MS = 1_609_459_200_000, 2_147_483_647_000
TOLERANCE, DIGITS, BEHIND_MS, BOOK_CHANGE = 2e-4, 8, 5_000, 0.3
# Digits by field name.
NAME_DIGITS = {"price": 4, "volume": 8, "delta": 8, "quantity": 8, "percent": 2, "ratio": 4, "ms": 0, "count": 0}


def repair_times(records: DataFrame) -> DataFrame:
    """Records (epoch_ms, first_seen, last_seen, age_ms) with a valid epoch; first and last are put in
    order, missing ones taken from the other and the epoch, and a negative age is counted anew."""
    rows = records.where(F.col("epoch_ms").between(FIRST_MS, LAST_MS))
    now, first, last = F.col("epoch_ms"), F.col("first_seen"), F.col("last_seen")
    broken = (first <= 0) | (last <= 0)
    fixed_first = F.when(first.isNull(), F.least(last, now)).when(last.isNull(), first).when(broken, now).otherwise(F.least(first, last))
    fixed_last = F.when(last.isNull(), F.greatest(first, now)).when(first.isNull(), last).when(broken, now).otherwise(F.greatest(first, last))
    rows = rows.withColumns({"first_seen": fixed_first, "last_seen": fixed_last})
    return rows.withColumn("age_ms", F.when(F.col("age_ms") < 0, F.greatest(F.lit(0), F.coalesce(now - F.col("last_seen"), F.lit(0)))).otherwise(F.col("age_ms")))


def _unless_near(stored: str, true: Column, tolerance: float = TOLERANCE, digits: int = DIGITS) -> Column:
    """The stored value, or the true one where they differ by more than the tolerance."""
    return F.when(F.abs(F.coalesce(F.col(stored), F.lit(0.0)) - true) > tolerance, F.round(true, digits)).otherwise(F.col(stored))


def repair_volumes(records: DataFrame) -> DataFrame:
    """Records whose total, delta, whale volumes, whale delta, share of the point of control and whale
    direction disagree with their parts get the values of the parts; ``corrected`` names them."""
    fixed = {
        "total": _unless_near("total", F.col("buy") + F.col("sell")),
        "delta": _unless_near("delta", F.col("buy") - F.col("sell")),
        "whale_buy": _unless_near("whale_buy", F.col("sector_buy")),
        "whale_sell": _unless_near("whale_sell", F.col("sector_sell")),
    }
    rows = records.withColumns({f"_{c}": F.col(c) for c in (*fixed, "whale_delta", "poc_percent", "direction")}).withColumns(fixed)
    rows = rows.withColumn("whale_delta", _unless_near("whale_delta", F.col("whale_buy") - F.col("whale_sell")))
    share = F.try_divide("poc_volume", "total") * 100
    rows = rows.withColumn("poc_percent", F.when((F.col("poc_volume") > 0) & (F.col("total") > 0), _unless_near("poc_percent", share, 0.1, 2)).otherwise(F.col("poc_percent")))
    against = F.when((F.col("whale_delta") > TOLERANCE) & (F.col("direction") == "selling"), "buying").when((F.col("whale_delta") < -TOLERANCE) & (F.col("direction") == "buying"), "selling")
    rows = rows.withColumn("direction", F.coalesce(against, "direction"))
    names = (*fixed, "whale_delta", "poc_percent", "direction")
    changed = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), c) for c in names)))
    too_large = (F.col("whale_buy") > F.col("buy") + TOLERANCE) | (F.col("whale_sell") > F.col("sell") + TOLERANCE) | (F.col("buy") < 0) | (F.col("sell") < 0)
    return rows.withColumns({"corrected": F.concat_ws(",", changed), "accepted": ~too_large}).drop(*(f"_{c}" for c in names))


def repair_order(records: DataFrame, by: str = "symbol", behind_ms: int = BEHIND_MS) -> DataFrame:
    """Records in order of arrival (seq) without those more than ``behind_ms`` behind the latest epoch
    seen; whole minutes, the made-up times of candles, do not count as seen."""
    rows = records.withColumn("_seen", F.when(F.col("epoch_ms") % 60_000 != 0, F.col("epoch_ms")))
    rows = running_max(rows, "_seen", [by], ["seq"], 100_000)
    return rows.where(F.col("_seen").isNull() | (F.col("_seen") - F.col("epoch_ms") <= behind_ms)).drop("_seen")


def repaired(records: DataFrame) -> DataFrame:
    """The whole repair: times, volumes, order, and one record for each symbol and epoch."""
    rows = repair_order(repair_volumes(repair_times(records)).where("accepted"))
    return dedup(rows, ["symbol", "epoch_ms"], ["seq"])


def book_changes(levels: DataFrame, most: float = BOOK_CHANGE) -> DataFrame:
    """Per snapshot the largest change of a level and whether it is small enough to be believed."""
    out = levels.groupBy("snapshot").agg(F.max(F.abs("change")).alias("largest"))
    return out.withColumn("accepted", F.coalesce(F.col("largest") <= most, F.lit(True)))


def _digits(name: str) -> int | None:
    return next((n for part, n in NAME_DIGITS.items() if part in name.lower().split("_")), None)


def rounded_by_name(df: DataFrame) -> DataFrame:
    """Every number, in structs and arrays too, rounded to the digits that its field's name calls for;
    NaN and infinite values become null. Other fields stay."""

    def fix(c: Column, kind: T.DataType, name: str) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*(fix(c[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: fix(x, kind.elementType, name))
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            sound = F.when(F.abs(c) < float("inf"), c)
            return sound if _digits(name) is None else F.round(sound, _digits(name))
        return c

    return df.select(*(fix(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields))


def evidence(records: DataFrame) -> DataFrame:
    """Records with ``has_flow`` (any volume or delta), ``label_ok`` (the label agrees with the delta's
    sign beyond ``eps``) and ``model_ok`` (the prediction may be used)."""
    flow = (F.col("total") > 0) | (F.col("delta") != 0) | (F.col("whale_delta") != 0)
    label = F.when(F.col("label") == "buy_absorption", F.col("delta") < -F.col("eps")).when(F.col("label") == "sell_absorption", F.col("delta") > F.col("eps")).otherwise(True)
    extreme = (F.col("prob_up") > 0.95) | (F.col("prob_up") < 0.05)
    model = F.when(extreme, F.col("warm")).otherwise(F.col("confidence") >= 0.10)
    return records.withColumns({"has_flow": flow, "label_ok": label, "model_ok": model})


def reliability(records: DataFrame, required: list[str]) -> DataFrame:
    """Completeness over the required columns, reliability (10 less penalties for book mode, latency and
    anomaly) and the quality score of both."""
    # Penalties.
    book = F.when(F.col("book_mode") == "emergency", 3.0).when(F.col("book_mode") == "cache", 1.5).otherwise(0.0)
    late = F.when(F.col("latency_ms") > 15_000, 1.0).when(F.col("latency_ms") > 8_000, 0.5).otherwise(0.0)
    odd = F.when(F.col("anomaly") == "HIGH", 2.0).when(F.col("anomaly") == "MEDIUM", 0.5).otherwise(0.0)
    present = sum(F.col(c).isNotNull().cast("int") for c in required) * 100.0 / len(required)
    rows = records.withColumns({"completeness": present, "reliability": 10.0 - book - late - odd})
    return rows.withColumn("quality", F.col("completeness") / 20 + F.col("reliability") / 2)


def venue_spread(prices: list[Column], most: float = 0.5) -> Column:
    """Largest distance of the positive prices from their mean in percent, at most ``most``; null for fewer than two."""
    some = F.filter(F.array(*prices), lambda x: x > 0)
    mean = F.try_divide(F.aggregate(some, F.lit(0.0), lambda a, x: a + x), F.size(some))
    widest = F.array_max(F.transform(some, lambda x: F.abs(x - mean)))
    return F.when(F.size(some) >= 2, F.least(F.try_divide(widest, mean) * 100, F.lit(most)))


def ui_rounded(buy: Column, sell: Column, digits: int) -> Column:
    """Both sides rounded, and their total from the rounded sides, so that what is shown adds up."""
    b, s = F.round(buy.cast("decimal(28,10)"), digits), F.round(sell.cast("decimal(28,10)"), digits)
    return F.struct(b.cast("double").alias("buy"), s.cast("double").alias("sell"), (b + s).cast("double").alias("total"))


def passive_share(bid_depth: Column, ask_depth: Column, aggressive_buy: Column, aggressive_sell: Column) -> Column:
    """Percent of resting orders that buy: by depth, else by who absorbs the aggressive side."""
    by_depth = F.try_divide(bid_depth, bid_depth + ask_depth) * 100
    return F.when(bid_depth + ask_depth > 0, by_depth).when((aggressive_buy != 50) | (aggressive_sell != 50), aggressive_sell).otherwise(50.0)


def checked_frame(df: DataFrame, required: list[str], least: int = 50, positive: list[str] = ()) -> DataFrame:
    """One row: rows, nulls in the required columns, values that are not positive, and whether all is well."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    nulls = sum(F.sum(F.col(c).isNull().cast("long")) for c in required)
    wrong = sum((F.sum((F.col(c) <= 0).cast("long")) for c in positive), F.lit(0))
    out = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(nulls, F.lit(0)).alias("nulls"), F.coalesce(wrong, F.lit(0)).alias("not_positive"))
    return out.withColumn("sound", (F.col("n") >= least) & (F.col("nulls") == 0) & (F.col("not_positive") == 0))
