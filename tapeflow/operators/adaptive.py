"""Thresholds that adapt to what they let through: the least number of trades of a window."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Threshold:
    """Where the threshold begins, its bounds, how many counts it remembers, the share of a step that is taken, and the
    share of remembered counts below it that moves it. Fixed values."""

    initial: int = 10
    least: int = 3
    most: int = 50
    history: int = 20
    rate: float = 0.1
    confidence: float = 0.7

    def after(self, current: int, counts: list[int]) -> tuple[int, str]:
        """The threshold after the remembered counts, and why: it moves once half the memory is full and more than
        ``confidence`` of the counts lie below it, a part of the way to nine tenths of their median, by whole trades."""
        if len(counts) < self.history * 0.5 or np.mean(np.asarray(counts) < current) <= self.confidence:
            return current, "no_adjustment_needed"
        goal = max(self.least, min(int(int(np.median(counts)) * 0.9), self.most))
        step = int((goal - current) * self.rate)
        return (current + step, "adjusted") if step else (current, "no_change")

    def follow(self, counts: list[int], current: int, remembered: list[int]) -> tuple[list[tuple[int, bool, int, str]], int, list[int]]:
        """For each new count (threshold, whether the count reaches it, threshold after it, why), and the state at the end."""
        out = []
        for n in counts:
            before = current
            remembered = [*remembered, n][-self.history :]
            current, why = self.after(current, remembered)
            out.append((before, n >= before, current, why))
        return out, current, remembered


def adaptive_minimum(windows: DataFrame, threshold: Threshold = Threshold()) -> DataFrame:
    """``windows`` (symbol, window_end, n) with the least number of trades in force, whether the window has it, the one after it,
    and why. The state is a number and the last counts, which decide together, so the windows of a symbol are
    followed in order: one group a symbol of one row a window. Rows with a null are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("window_end")
        found, _, _ = threshold.follow(pdf["n"].tolist(), threshold.initial, [])
        return pd.concat([pdf.reset_index(drop=True), pd.DataFrame(found, columns=["minimum", "enough", "minimum_after", "reason"])], axis=1)

    rows = windows.select("symbol", "window_end", F.col("n").cast("long").alias("n")).dropna()
    kind = dict(windows.dtypes)["symbol"]
    return rows.groupBy("symbol").applyInPandas(run, f"symbol {kind}, window_end bigint, n bigint, minimum bigint, enough boolean, minimum_after bigint, reason string")
