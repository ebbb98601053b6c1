"""How symbols move with reference assets: correlations over several horizons and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import filled

DAY_MS = 86_400_000


def on_calendar(series: DataFrame, references: DataFrame) -> DataFrame:
    """symbol, other, ts, x, y: returns of a symbol between its own times, and of a reference asset between the same times.

    Calendars differ: a reference counts with its last close at or before each time, found by one union in which
    that close is carried (not by comparing times). A reference that did not trade since the time before has return 0. The list of
    references is short (one asset each); symbols are many."""
    names = references.select(F.col("symbol").alias("other")).distinct()
    rows = series.select("symbol", "ts", F.col("close").cast("double").alias("x")).dropna()
    # A row for each reference: the array of their names is as short as the list that the caller gives.
    every = names.agg(F.collect_list("other").alias("_others"))
    wanted = rows.join(F.broadcast(every)).withColumn("other", F.explode("_others")).where("symbol <> other")
    asked = wanted.select("other", "ts", F.lit(1).alias("_kind"), F.col("symbol").alias("_s"), "x", F.lit(None).cast("double").alias("y"))
    given = references.select(F.col("symbol").alias("other"), "ts", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("_s"), F.lit(None).cast("double").alias("x"), F.col("close").cast("double").alias("y"))
    both = filled(asked.unionByName(given), "y", "_y", ["other"], ["ts", "_kind", "_s"], 365 * DAY_MS).where("_kind = 1")
    line = Window.partitionBy("symbol", "other").orderBy("ts")
    both = both.select(F.col("_s").alias("symbol"), "other", "ts", "x", F.col("_y").alias("y"))
    move = lambda c: F.try_divide(c, F.lag(c).over(line)) - 1
    return both.withColumns({"rx": move("x"), "ry": move("y")}).select("symbol", "other", "ts", "y", F.col("rx").alias("x_return"), F.col("ry").alias("y_return"))


def cross_asset(series: DataFrame, references: DataFrame, days: tuple[int, ...] = (7, 30, 90), least: int = 5) -> DataFrame:
    """For each symbol, reference and time: correlation of returns over the last ``days`` (null below ``least`` pairs), the
    reference's change over 5 and 20 rows and its momentum, and from the last two horizons how stable the correlation is
    (distance), how strong (mean, without sign), and its regime.

    Only pairs with a reference are formed, so rows grow with the symbols, not with their square; frames are ranges of
    days, so symbols may trade on different days."""
    rows = on_calendar(series, references)
    line = Window.partitionBy("symbol", "other").orderBy("ts")
    both, out = F.col("x_return").isNotNull() & F.col("y_return").isNotNull(), {}
    x, y = F.when(both, F.col("x_return")), F.when(both, F.col("y_return"))
    for n in days:
        w = line.rangeBetween(-n * DAY_MS + 1, 0)
        dx, dy = F.stddev_pop(x).over(w), F.stddev_pop(y).over(w)
        known = (F.count(x).over(w) >= least) & (dx >= 1e-12) & (dy >= 1e-12)
        out[f"corr_{n}d"] = F.when(known, F.try_divide(F.covar_pop(x, y).over(w), dx * dy))
    back = lambda k: F.try_divide("y", F.lag("y", k).over(line)) - 1
    rows = rows.withColumns(out | {"return_5": back(5), "return_20": back(20)})
    short, long = (F.col(f"corr_{n}d") for n in days[-2:])
    mean = (short + long) / 2
    regime = F.when(short.isNull(), "UNKNOWN").when(F.abs(short) > 0.6, F.when(short < 0, "STRONG_INVERSE").otherwise("STRONG_POSITIVE")).when(
        F.abs(short) > 0.3, F.when(short < 0, "MODERATE_INVERSE").otherwise("MODERATE_POSITIVE")
    ).otherwise("DECORRELATED")
    return rows.withColumns({"stability": F.abs(short - long), "strength": F.abs(mean), "momentum": F.col("return_20") - F.col("return_5"), "regime": regime})
