"""Readers of stored tables: liquidations, derivatives, on-chain metrics, macro series, signals, decisions of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import json_double
from ..operators.joins import asof_backward

DAY_MINUTES = 1_440


def liquidations(rows: DataFrame, as_of: int, minutes: int) -> DataFrame:
    """Forced orders (t) of the last ``minutes``, a day at most; the time range reaches the scan."""
    return rows.where(F.col("t").between(as_of - min(minutes, DAY_MINUTES) * 60_000, as_of))


def derivatives(rows: DataFrame) -> DataFrame:
    """Open interest, price and long-short ratio of a symbol as the value of longs and shorts."""
    value, ratio = F.col("open_interest") * F.col("price"), F.col("long_short")
    return rows.withColumns({"longs": F.try_divide(value * ratio, 1 + ratio), "shorts": F.try_divide(value, 1 + ratio)})


def merged(first: DataFrame, second: DataFrame, on: str) -> DataFrame:
    """Two sources of one record: every key of either, the first source's value where it has one."""
    a, b = first.alias("a"), second.alias("b")
    names = list(dict.fromkeys([*first.columns, *second.columns]))
    pick = lambda c: F.coalesce(*(F.col(f"{s}.{c}") for s, df in (("a", first), ("b", second)) if c in df.columns))
    return a.join(b, F.col(f"a.{on}") == F.col(f"b.{on}"), "full_outer").select(*(pick(c).alias(c) for c in names))


def first_source(rows: DataFrame, least: int = 5) -> DataFrame:
    """Of each asset the rows (asset, source, ...) of the first source, by its number, that has at least ``least``."""
    enough = rows.groupBy("asset", "source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return rows.join(enough.groupBy("asset").agg(F.min("source").alias("source")), ["asset", "source"], "left_semi")


def macro_at(windows: DataFrame, series: DataFrame) -> DataFrame:
    """Windows (id, symbol, t) with the last value of a macro series (symbol, rt, value) at or before them."""
    return asof_backward(windows, series)


def signals(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Events whose payload names absorbed buying or selling, as signals with a positive price: sold absorption
    is a buy, bought absorption a sell."""
    label, price = F.get_json_object(payload, "$.label"), json_double(payload, "$.price")
    side = F.when(label.contains("Venda"), "BUY").when(label.contains("Compra"), "SELL")
    rows = events.withColumns({"side": side, "price": price})
    return rows.where(F.col("side").isNotNull() & (F.col("price") > 0)).drop(payload)


def model_decisions(events: DataFrame, kind: str = "kind", payload: str = "payload") -> DataFrame:
    """Events of models' analyses with typed action, confidence and probability."""
    text = lambda path: F.get_json_object(payload, path)
    rows = events.where(F.col(kind) == "AI_ANALYSIS")
    return rows.withColumns({"action": text("$.result.action"), "confidence": json_double(payload, "$.result.confidence"), "prob_up": json_double(payload, "$.quant.prob_up")}).drop(kind, payload)


def future_closes(points: DataFrame, candles: DataFrame, horizon_ms: int) -> DataFrame:
    """Closes after each point (id, symbol, t) up to the horizon; both sides meet by spans of the horizon."""
    span = lambda c: F.floor(c / horizon_ms)
    look = points.withColumn("_s", F.explode(F.array(span(F.col("t")), span(F.col("t")) + 1)))
    meet = look.join(candles.select("symbol", "ts", "close", span(F.col("ts")).alias("_s")), ["symbol", "_s"])
    return meet.where((F.col("ts") > F.col("t")) & (F.col("ts") <= F.col("t") + horizon_ms)).drop("_s")


def complete(record: DataFrame, times: list[str], least_index: float = 0.02) -> DataFrame:
    """Records with ``sound``: some time is given, and an index beside an absorption is large enough."""
    given: Column = F.coalesce(*(F.col(c) for c in times)).isNotNull()
    return record.withColumn("sound", given & (F.col("is_absorption") | F.coalesce(F.col("absorption_index") >= least_index, F.lit(True))))
