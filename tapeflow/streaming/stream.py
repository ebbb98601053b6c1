"""The operators on streams: windows with watermark, de-duplication, stateful bars, cooldowns, sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.bars import exact

LATENESS = "30 seconds"


def timed(trades: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Trades with event time and watermark."""
    return trades.withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", lateness)


def ohlcv(trades: DataFrame, width: str = "1 minute", slide: str | None = None, lateness: str = LATENESS, least: int = 1) -> DataFrame:
    """Windows of trades (m given); a window is given out once the watermark passes its end.
    Late trades within the watermark count in their own window."""
    order = F.struct("t", "seq")
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = timed(trades, lateness).groupBy("symbol", window.alias("w")).agg(
        F.min_by("p", order).alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", order).alias("close"),
        F.sum(exact(F.col("q"))).cast("double").alias("volume"),
        F.sum(exact(F.when(F.col("m"), -F.col("q")).otherwise(F.col("q")))).cast("double").alias("delta"),
        F.count(F.lit(1)).alias("n"),
    )
    return out.where(F.col("n") >= least).select("symbol", F.unix_millis("w.end").alias("window_end"), "open", "high", "low", "close", "volume", "delta", "n")


def deduplicated(events: DataFrame, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """Events without those whose key came within the watermark before."""
    return timed(events, lateness).dropDuplicatesWithinWatermark(keys)


def anchored_bars(trades: DataFrame, width_ms: int) -> DataFrame:
    """Bars that open with a trade and close with the first trade at least ``width_ms`` later,
    which belongs to no bar. The open bar of each symbol is kept as state."""
    state = "start bigint, open double, high double, low double, close double, delta double, n bigint"
    kind = dict(trades.dtypes)["symbol"]
    names = ["symbol", "open_t", "open", "high", "low", "close", "delta", "n"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        bar = list(held.get) if held.exists else None
        rows = pd.concat(list(batches)).sort_values(["t", "seq"])
        out = []
        for t, p, q, m in zip(rows["t"], rows["p"], rows["q"], rows["m"], strict=True):
            signed = -q if m else q
            if bar is None:
                bar = [int(t), float(p), float(p), float(p), float(p), float(signed), 1]
            elif t - bar[0] >= width_ms:
                out.append((key[0], *bar))
                bar = None
            else:
                bar = [bar[0], bar[1], max(bar[2], float(p)), min(bar[3], float(p)), float(p), bar[5] + float(signed), bar[6] + 1]
        if bar is None:
            if held.exists:
                held.remove()
        else:
            held.update(tuple(bar))
        yield pd.DataFrame(out, columns=names)

    schema = f"symbol {kind}, open_t bigint, open double, high double, low double, close double, delta double, n bigint"
    return trades.groupBy("symbol").applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.NoTimeout)


def cooled(alerts: DataFrame, cooldown_ms: int) -> DataFrame:
    """Alerts (symbol, kind, t) without those that come within the cooldown after one that was kept."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last = held.get[0] if held.exists else None
        kept = []
        for t in pd.concat(list(batches))["t"].sort_values():
            if last is None or t - last >= cooldown_ms:
                last = int(t)
                kept.append((*key, last))
        held.update((last,))
        yield pd.DataFrame(kept, columns=["symbol", "kind", "t"])

    return alerts.groupBy("symbol", "kind").applyInPandasWithState(step, "symbol string, kind string, t bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def fan_out(events: DataFrame, handlers: dict, checkpoint: str):
    """Starts a query that gives each handler its event type's rows of every micro-batch."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        for event_type, handler in handlers.items():
            handler(df.where(F.col("event_type") == event_type), number)
        df.unpersist()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
