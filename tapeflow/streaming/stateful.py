"""Stateful stream operators: level tests, books from deltas and adaptive thresholds, with lists, maps and timers as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import monitor
from ..operators.adaptive import Threshold
from ..operators.booksync import Levels

TICK = "t bigint, seq bigint, price double, volume double, delta double"


def block_mean(values: pd.Series, number: pd.Series, width: int) -> pd.Series:
    """Mean of the last ``width`` values (all, if fewer) at each place, added up as in :func:`monitor.block_sum`; ``number`` is
    the place of each value in its line."""
    line = np.concatenate([np.zeros(width - 1), values.to_numpy(float)])
    size = np.minimum(np.arange(1, len(values) + 1), width)
    begin, before = width - size, (size - number.to_numpy()) % monitor.BLOCK
    end = np.where(before + monitor.BLOCK <= size, begin + before + monitor.BLOCK, -1)
    total, block = np.zeros(len(values)), np.zeros(len(values))
    for i in range(width):
        x, inside = line[i : i + len(values)], (i < end) & (i >= end - monitor.BLOCK)
        block = np.where(inside, block + x, block)
        total = np.where(inside | (i < begin), total, total + x)
        total = np.where(i == end - 1, total + block, total)
    return pd.Series(total / size, index=values.index)


class Recent(StatefulProcessor):
    """Gives each tick what the last ticks of its symbol say; the state is a list of the last ``LOOKBACK`` ticks and their
    number. A symbol that is silent for ``silence_ms`` of event time is forgotten."""

    def __init__(self, silence_ms: int | None):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "price double, volume double, delta double")
        self.seen = handle.getValueState("seen", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["t", "seq"])
        n = self.seen.get()[0] if self.seen.exists() else 0
        held = [tuple(x) for x in self.last.get()] if self.last.exists() else []
        every = pd.DataFrame(held + list(zip(new["price"], new["volume"], new["delta"], strict=True)), columns=["price", "volume", "delta"])
        number = pd.Series(range(n + 1 - len(held), n + 1 + len(new)), dtype="int64")
        price, volume = every["price"], every["volume"]
        first = price.shift(9)
        change = ((price - first) / first * 100).where(number >= 10)
        mean20 = price.rolling(20, 1).mean()
        volatility = (price.rolling(20, 1).std(ddof=0) / mean20.where(mean20 != 0) * 100).fillna(0.0).where(number >= 20, 0.0)
        mean5, mean = volume.rolling(5, 1).mean(), block_mean(volume, number, 20)
        momentum = (every["delta"].rolling(5, 1).mean() / mean5.where(mean5 != 0)).fillna(0.0).where(number >= 5, 0.0)
        ratio = (volume / mean.where(mean != 0)).fillna(1.0)
        made = pd.DataFrame({"n": number, "change10": change, "volatility20": volatility, "momentum5": momentum, "volume_ratio": ratio}).iloc[len(held) :]
        self.seen.update((n + len(new),))
        self.last.put([tuple(map(float, x)) for x in every.tail(monitor.LOOKBACK).itertuples(index=False)])
        if self.silence_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(new["t"].max()) + self.silence_ms)
        out = new[["t", "seq", "price", "volume", "delta"]].reset_index(drop=True)
        yield pd.concat([pd.DataFrame({"symbol": [key[0]] * len(out)}), out, made.reset_index(drop=True)], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.seen.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def level_tests(ticks: DataFrame, levels: DataFrame, tolerance: float = monitor.TOLERANCE, lateness: str = "0 seconds", silence_ms: int | None = None) -> DataFrame:
    """Tests of static ``levels`` by a stream of ticks, as :func:`monitor.level_tests` has them for a table.

    Ticks of a symbol count in the order they come in, and by (t, seq) within a micro-batch. The join with the levels is
    stream-static by step of log price."""
    schema = f"symbol {dict(ticks.dtypes)['symbol']}, {TICK}, n bigint, change10 double, volatility20 double, momentum5 double, volume_ratio double"
    rows = ticks.select("symbol", "t", "seq", "price", "volume", "delta").dropna()
    mode = "None"
    if silence_ms is not None:
        rows, mode = rows.withColumn("_ts", F.timestamp_millis("t")).withWatermark("_ts", lateness), "EventTime"
    rows = rows.groupBy("symbol").transformWithStateInPandas(Recent(silence_ms), schema, "Append", mode)
    return monitor.judged(monitor.met(rows, levels, tolerance))


class Book(StatefulProcessor):
    """One book: quantities by side and price, the last id, and whether ids are missing since the last snapshot."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "side string, price double", "qty double")
        self.head = handle.getValueState("head", "last_id bigint, segment bigint, stale boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, segment, stale = self.head.get() if self.head.exists() else (None, 0, True)
        sides, out = {"bid": Levels(True), "ask": Levels(False)}, []
        for (side, price), (qty,) in self.levels.iterator():
            sides[side].put(price, qty)
        changed: dict[tuple[str, float], float] = {}
        new = pd.concat(list(rows)).sort_values(["arrival", "line", "qty"], kind="stable")
        for arrival, some in new.groupby("arrival", sort=True):
            kind, first_id, last_id = some["kind"].iloc[0], int(some["first_id"].iloc[0]), int(some["last_id"].iloc[0])
            if last is not None and last_id <= last:
                continue
            if kind == "snapshot":
                segment, stale = segment + 1, False
                for side, of in sides.items():
                    changed |= {(side, p): 0.0 for p in of.of}
                sides = {"bid": Levels(True), "ask": Levels(False)}
            elif last is None or first_id > last + 1:
                stale = True
            last = last_id
            if not stale:
                for side, price, qty in zip(some["side"], some["price"], some["qty"], strict=True):
                    if side in sides and price == price and qty == qty:
                        sides[side].put(price, qty)
                        changed[side, price] = qty
            bid, ask = sides["bid"], sides["ask"]
            told = (bid.best(), ask.best(), len(bid.of), len(ask.of), sum(bid.of.values()), sum(ask.of.values()))
            out.append((key[0], arrival, last_id, segment, stale, *((None,) * 6 if stale else told)))
        for (side, price), qty in changed.items():
            if qty > 0:
                self.levels.updateValue((side, price), (qty,))
            elif self.levels.containsKey((side, price)):
                self.levels.removeKey((side, price))
        if last is not None:
            self.head.update((last, segment, stale))
        yield pd.DataFrame(out, columns="book arrival last_id segment stale best_bid best_ask bid_levels ask_levels bid_qty ask_qty".split())

    def close(self) -> None:
        pass


def replayed(updates: DataFrame) -> DataFrame:
    """Books after every accepted update of a stream of lines (book, arrival, kind, first_id, last_id, side, price, qty, line), as
    :func:`booksync.replayed` has them for tables. All lines of an update lie in one micro-batch; an update without
    lines is one line without side."""
    schema = (
        f"book {dict(updates.dtypes)['book']}, arrival bigint, last_id bigint, segment bigint, stale boolean, best_bid double, best_ask double, "
        "bid_levels bigint, ask_levels bigint, bid_qty double, ask_qty double"
    )
    return updates.groupBy("book").transformWithStateInPandas(Book(), schema, "Append", "None")


class Minimum(StatefulProcessor):
    """The least number of trades in force, and the last counts that decide on it."""

    def __init__(self, threshold: Threshold):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "minimum bigint")
        self.counts = handle.getListState("counts", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("window_end").reset_index(drop=True)
        current = self.now.get()[0] if self.now.exists() else self.threshold.initial
        seen = [n for (n,) in self.counts.get()] if self.counts.exists() else []
        found, current, seen = self.threshold.follow([int(n) for n in new["n"]], current, seen)
        self.now.update((current,))
        self.counts.put([(n,) for n in seen])
        yield pd.concat([new[["symbol", "window_end", "n"]], pd.DataFrame(found, columns=["minimum", "enough", "minimum_after", "reason"])], axis=1)

    def close(self) -> None:
        pass


def adaptive_minimum(windows: DataFrame, threshold: Threshold = Threshold()) -> DataFrame:
    """Windows (symbol, window_end, n) of a stream with the least number of trades in force, as :func:`adaptive.adaptive_minimum` has
    them for a table. Windows come in order from one micro-batch to the next."""
    rows = windows.select("symbol", "window_end", F.col("n").cast("long").alias("n")).dropna()
    schema = f"symbol {dict(windows.dtypes)['symbol']}, window_end bigint, n bigint, minimum bigint, enough boolean, minimum_after bigint, reason string"
    return rows.groupBy("symbol").transformWithStateInPandas(Minimum(threshold), schema, "Append", "None")
