"""Running values over long histories without one task per symbol.

A window over all rows of a symbol puts them into one task. Here the history is cut into
time buckets: each bucket is scanned on its own, what it passes on is one small row, and
only these rows are scanned in order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: States that a fold over time can be in where a chunk begins: nothing yet, open since a time, ended at a time.
NOTHING, OPEN, ENDED = 0, 1, 2
#: A limit that every time is below.
ALWAYS = (1 << 63) - 1


def _bucketed(df: DataFrame, time: str, bucket_ms: int) -> DataFrame:
    return df.withColumn("_bucket", F.floor(F.col(time) / bucket_ms))


def _dealt(df: DataFrame, time: str, bucket_ms: int, by: list[str]) -> DataFrame:
    """``df`` with its bucket, one shuffle of which serves both what sums a bucket up and what scans it. Rows without group or
    time are in no bucket."""
    return _bucketed(df, time, bucket_ms).dropna(subset=[*by, "_bucket"]).repartition(*by, "_bucket")


def _summed(rows: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """One row for each bucket. It looks at every column, so that it reads the very shuffle that the scan of the rows reads:
    with fewer columns Spark would read and shuffle the table once more."""
    seen = F.max(F.xxhash64(*rows.columns))
    return rows.groupBy(*by, "_bucket").agg(*(c.alias(n) for n, c in sums.items()), seen.alias("_seen")).where("_seen IS NOT NULL").drop("_seen")


def running_sum(df: DataFrame, value: Column, name: str, by: list[str], order: list[str], bucket_ms: int = DAY_MS) -> DataFrame:
    """``df`` with the sum of ``value`` from the first row of each group to the current."""
    rows = _dealt(df.withColumn("_v", value), order[0], bucket_ms, by)
    sums = _summed(rows, by, _s=F.sum("_v"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*by, "_bucket", F.sum("_s").over(before).alias("_carried"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(carried, [*by, "_bucket"])
    return rows.withColumn(name, F.coalesce("_carried", F.lit(0)) + F.sum("_v").over(inside)).select(*df.columns, name)


def previous(df: DataFrame, column: str, name: str, by: list[str], order: list[str], bucket_ms: int = DAY_MS) -> DataFrame:
    """``df`` with the value of ``column`` in the group's row before."""
    rows = _dealt(df, order[0], bucket_ms, by)
    last = _summed(rows, by, _last=F.max_by(column, F.struct(*order)))
    carried = last.select(*by, "_bucket", F.lag("_last").over(Window.partitionBy(*by).orderBy("_bucket")).alias("_carried"))
    rows = rows.join(carried, [*by, "_bucket"])
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    value = F.when(F.row_number().over(inside) == 1, F.col("_carried")).otherwise(F.lag(column).over(inside))
    return rows.withColumn(name, value).select(*df.columns, name)


def running_values(df: DataFrame, values: dict[str, tuple[str, Column]], by: list[str], order: list[str], bucket: int, inclusive: bool = True) -> DataFrame:
    """``df`` with several running values at once: ``values`` names ("sum" or "max", column); of rows up to the current one, which
    counts only if ``inclusive``. A sum begins at 0, a maximum with null. ``bucket`` is in units of the first order column."""
    kinds = {"sum": F.sum, "max": F.max}
    rows = df.withColumns({f"_v_{n}": c for n, (_, c) in values.items()})
    rows = _dealt(rows, order[0], bucket, by)
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = _summed(rows, by, **{f"_e_{n}": kinds[k](f"_v_{n}") for n, (k, _) in values.items()})
    carried = ends.select(*by, "_bucket", *(kinds[k](f"_e_{n}").over(before).alias(f"_c_{n}") for n, (k, _) in values.items()))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.join(carried, [*by, "_bucket"])
    zero = F.lit(0)
    made = {
        n: F.coalesce(f"_c_{n}", zero) + F.coalesce(F.sum(f"_v_{n}").over(inside), zero) if k == "sum" else F.greatest(f"_c_{n}", F.max(f"_v_{n}").over(inside))
        for n, (k, _) in values.items()
    }
    return rows.withColumns(made).select(*df.columns, *values)


def running_max(df: DataFrame, column: str, by: list[str], order: list[str], bucket: int) -> DataFrame:
    """``df`` with ``column`` raised to the greatest value of the group so far; ``bucket`` is in units of the first order column."""
    out = running_values(df, {"_greatest": ("max", F.col(column))}, by, order, bucket)
    return out.withColumn(column, F.col("_greatest")).select(*df.columns)


def filled(df: DataFrame, column: str, name: str, by: list[str], order: list[str], bucket_ms: int = DAY_MS) -> DataFrame:
    """``df`` with the last value of ``column`` that is not null, the current row's included."""
    rows = _dealt(df, order[0], bucket_ms, by)
    known = F.when(F.col(column).isNotNull(), F.struct(*order))
    last = _summed(rows, by, _last=F.max_by(column, known))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*by, "_bucket", F.last("_last", True).over(before).alias("_carried"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(carried, [*by, "_bucket"])
    return rows.withColumn(name, F.coalesce(F.last(column, True).over(inside), "_carried")).select(*df.columns, name)


def surrounding(df: DataFrame, column: str, before: str, after: str, by: list[str], order: list[str], back: list[str], bucket_ms: int = DAY_MS) -> DataFrame:
    """``df`` with the last known value of ``column`` in the order ``order`` (as ``before``) and in the order ``back`` against time
    (as ``after``), the row's own included. Both come from one shuffle: a bucket is sorted twice, and gives its neighbours on either
    side its last and its first known value. The first column of ``back`` is the negative of that of ``order``."""
    rows = _dealt(df, order[0], bucket_ms, by)
    known = lambda names: F.when(F.col(column).isNotNull(), F.struct(*names))
    ends = _summed(rows, by, _last=F.max_by(column, known(order)), _first=F.max_by(column, known(back)))
    across = Window.partitionBy(*by).orderBy("_bucket")
    held = F.last("_last", True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    due = F.first("_first", True).over(across.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.join(ends.select(*by, "_bucket", held.alias("_held"), due.alias("_due")), [*by, "_bucket"])
    inside = lambda names: Window.partitionBy(*by, "_bucket").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(before, F.coalesce(F.last(column, True).over(inside(order)), "_held"))
    return rows.withColumn(after, F.coalesce(F.last(column, True).over(inside(back)), "_due")).select(*df.columns, before, after)


def tick_side(df: DataFrame, by: list[str], order: list[str], bucket_ms: int = DAY_MS) -> DataFrame:
    """``df`` (p, m) with m filled: as given, else by the move of p (up false, down true), else as in the row before, else null.

    One scan of each bucket gives the moves inside it; its first price, last price and last known side are carried to the
    buckets after it."""
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    side = lambda p, before: F.when(p > before, False).when(p < before, True)
    place = F.struct(*order)
    rows = _dealt(df, order[0], bucket_ms, by)
    rows = rows.withColumn("_tick", F.coalesce("m", side(F.col("p"), F.lag("p").over(inside))))
    ends = _summed(
        rows, by, _p=F.min_by("p", place), _last=F.max_by("p", place), _m=F.min_by("m", place), _known=F.max_by("_tick", F.when(F.col("_tick").isNotNull(), place))
    )
    across = Window.partitionBy(*by).orderBy("_bucket")
    ends = ends.withColumn("_first", F.coalesce("_m", side(F.col("_p"), F.lag("_last").over(across))))
    held = F.last(F.coalesce("_known", "_first"), True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(ends.select(*by, "_bucket", "_first", held.alias("_held")), [*by, "_bucket"])
    tick = F.when(F.row_number().over(inside) == 1, F.coalesce("_tick", "_first")).otherwise(F.col("_tick"))
    found = F.last("_tick", True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_tick", tick).withColumn("m", F.coalesce(found, "_held")).select(*df.columns)


def with_states(rows: DataFrame, summarise: Callable[[pd.DataFrame], list[tuple[int, int, int, int]]]) -> DataFrame:
    """``rows`` (symbol, chunk, ...) with the state (_state, _since) of a fold where their chunk begins.

    A fold in time order depends on all rows before. Each chunk first says what it makes of any
    state: ``summarise`` gives (state, limit, new state, new time) in order of limits, and the first
    entry of the state whose limit the time does not exceed applies; without one the state stays.
    Only these entries are then followed through a symbol's chunks, one small list for each."""
    kind = dict(rows.dtypes)["symbol"]

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for entry in summarise(pdf.sort_values(["t", "seq"])):
            if out and out[-1][:2] == entry[:2]:
                continue  # the first of rows at one time decides
            if out and out[-1][0] == entry[0] and out[-1][2:] == entry[2:]:
                out.pop()  # the same outcome up to a larger limit
            out.append(entry)
        frame = pd.DataFrame(out or [(-1, 0, 0, 0)], columns=["state", "limit", "new_state", "new_since"])
        return frame.assign(symbol=pdf["symbol"].iloc[0], chunk=pdf["chunk"].iloc[0])

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        now, out = (NOTHING, 0), []
        for chunk, some in pdf.groupby("chunk", sort=True):
            out.append((pdf["symbol"].iloc[0], chunk, *now))
            for state, limit, *new in sorted(zip(some["state"], some["limit"], some["new_state"], some["new_since"], strict=True)):
                if state == now[0] and now[1] <= limit:
                    now = tuple(new)
                    break
        return pd.DataFrame(out, columns=["symbol", "chunk", "_state", "_since"])

    found = rows.groupBy("symbol", "chunk").applyInPandas(entries, f"state bigint, limit bigint, new_state bigint, new_since bigint, symbol {kind}, chunk bigint")
    states = found.groupBy("symbol").applyInPandas(follow, f"symbol {kind}, chunk bigint, _state bigint, _since bigint")
    return rows.join(states, ["symbol", "chunk"])


def numbered(df: DataFrame, name: str, by: list[str], order: list[str], bucket_ms: int = DAY_MS) -> DataFrame:
    """``df`` with the number of its group's rows up to the current."""
    return running_sum(df, F.lit(1), name, by, order, bucket_ms)


def _composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the map that all maps y -> a y + b up to it make one after the other. Maps are
    composed over distances 1, 2, 4, ..., so the work is n log n without a loop over rows."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a):
        b[step:] = a[step:] * b[:-step] + b[step:]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return a, b


def affine(df: DataFrame, maps: dict[str, tuple[Column, Column]], by: list[str], order: list[str], bucket_ms: int = DAY_MS) -> DataFrame:
    """``df`` with each y = a * y of the row before + b of its group, which starts at 0; ``maps`` names (a, b).

    A recurrence of this kind is a composition of maps, and these compose to maps of the same kind: each bucket of time gives
    one pair (a, b), only those are followed in order, and each bucket is then filled from its true start. Rows
    where a or b is null leave y as it is. A moving mean with weight w is (1 - w, w * x), and (0, x) where it begins."""
    names = list(maps)
    rows = _bucketed(df, order[0], bucket_ms)
    for i, (a, b) in enumerate(maps.values()):
        known = a.isNotNull() & b.isNotNull()
        rows = rows.withColumns({f"_a{i}": F.when(known, a.cast("double")).otherwise(1.0), f"_b{i}": F.when(known, b.cast("double")).otherwise(0.0)})
    keys = [*by, "_bucket"]
    kinds = dict(rows.dtypes)
    keyed, given = ", ".join(f"`{k}` {kinds[k]}" for k in keys), df.columns

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values(order), pdf[keys].iloc[:1].copy()
        pairs = [_composed(pdf[f"_a{i}"].to_numpy(float), pdf[f"_b{i}"].to_numpy(float)) for i in range(len(names))]
        out["_a"], out["_b"] = [[float(a[-1]) for a, _ in pairs]], [[float(b[-1]) for _, b in pairs]]
        return out

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, y, out = pdf.sort_values("_bucket"), np.zeros(len(names)), []
        for a, b in zip(pdf["_a"], pdf["_b"], strict=True):
            out.append(y.tolist())
            y = np.asarray(a) * y + np.asarray(b)
        return pdf[keys].assign(_y=out)

    def fill(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf, y = pdf.sort_values(order), start["_y"].iloc[0]
        for i, name in enumerate(names):
            a, b = _composed(pdf[f"_a{i}"].to_numpy(float), pdf[f"_b{i}"].to_numpy(float))
            pdf[name] = a * y[i] + b
        return pdf[[*given, *names]]

    found = rows.groupBy(*keys).applyInPandas(ends, f"{keyed}, _a array<double>, _b array<double>")
    starts = found.groupBy(*by).applyInPandas(follow, f"{keyed}, _y array<double>")
    schema = ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + [f"`{n}` double" for n in names])
    return rows.groupBy(*keys).cogroup(starts.groupBy(*keys)).applyInPandas(fill, schema)
