"""Risk, performance, scoring, alerts, calendars, similarity and model training."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import line

#: Bytes of the queries that are compared in one pass, and pairs whose scores are held at once.
QUERY_BYTES, PAIRS = 8 << 20, 4 << 20


def var_es(returns: DataFrame, level: float = 0.95) -> DataFrame:
    """Value at risk (interpolated percentile) and expected shortfall of each symbol."""
    cut = returns.groupBy("symbol").agg(F.percentile("r", F.lit(1 - level)).alias("cut"))
    tail = returns.join(cut, "symbol").groupBy("symbol", "cut").agg(F.avg(F.when(F.col("r") <= F.col("cut") + 1e-12, F.col("r"))).alias("mean"))
    return tail.select("symbol", (-F.col("cut")).alias("var"), (-F.col("mean")).alias("es"))


def ratios(returns: DataFrame, periods: int = 252) -> DataFrame:
    """Sharpe, Sortino and Omega ratios of each symbol's returns."""
    down = F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), 2)))
    scale = float(periods) ** 0.5
    gains, losses = F.sum(F.greatest("r", F.lit(0.0))), F.sum(F.greatest(-F.col("r"), F.lit(0.0)))
    return returns.groupBy("symbol").agg(
        F.try_divide(F.avg("r") * scale, F.stddev_samp("r")).alias("sharpe"),
        F.try_divide(F.avg("r") * scale, down).alias("sortino"),
        F.try_divide(gains, losses).alias("omega"),
        F.count(F.lit(1)).alias("n"),
    )


def drawdown(candles: DataFrame) -> DataFrame:
    """Greatest fall from a running peak of each symbol, and its time."""
    peak = F.max("close").over(line().rowsBetween(Window.unboundedPreceding, 0))
    rows = candles.withColumn("fall", 1 - F.try_divide("close", peak))
    return rows.groupBy("symbol").agg(F.max("fall").alias("max_drawdown"), F.min_by("ts", F.struct(-F.col("fall"), "ts")).alias("at"))


def profit_factor(trades: DataFrame) -> DataFrame:
    """Win rate, profit factor (999 without a loss) and mean of each group's profits."""
    gain = F.sum(F.when(F.col("profit") > 0, F.col("profit")).otherwise(0.0))
    loss = -F.sum(F.when(F.col("profit") < 0, F.col("profit")).otherwise(0.0))
    return trades.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("profit") > 0).cast("double")).alias("win_rate"), F.when(loss > 0, gain / loss).otherwise(999.0).alias("profit_factor"), F.avg("profit").alias("mean")
    )


def herfindahl(positions: DataFrame) -> DataFrame:
    """Concentration of each portfolio's (portfolio, asset, value) exposure."""
    share = F.try_divide(F.abs("value"), F.sum(F.abs("value")).over(Window.partitionBy("portfolio")))
    rows = positions.withColumn("share", share)
    return rows.groupBy("portfolio").agg(F.sum(F.col("share") * F.col("share")).alias("hhi"), F.max("share").alias("largest"), F.count(F.lit(1)).alias("n"))


def stress(positions: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Profit of each portfolio in each scenario (scenario, asset, change)."""
    return positions.join(scenarios, "asset").groupBy("portfolio", "scenario").agg(F.sum((F.col("value") * F.col("change")).cast("decimal(28,6)")).cast("double").alias("profit"))


def trade_gate(positions: DataFrame, cash: float, largest: float) -> DataFrame:
    """Whether each position passes the limits, and the first reason why not."""
    reason = F.when(F.col("value") <= 0, "not_positive").when(F.col("value") > cash, "no_cash").when(F.col("share") > largest, "too_large")
    return positions.withColumn("reason", F.coalesce(reason, F.lit("ok"))).withColumn("allowed", F.col("reason") == "ok")


def volume_spikes(candles: DataFrame, n: int = 20, factor: float = 3.0) -> DataFrame:
    before = F.avg("volume").over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(-n, -1))
    rows = candles.withColumn("ratio", F.try_divide(F.col("volume"), before))
    severity = F.when(F.col("ratio") >= factor * 2, "HIGH").when(F.col("ratio") >= factor, "MEDIUM")
    return rows.withColumn("severity", severity).where("severity IS NOT NULL").select("symbol", "ts", "volume", "ratio", "severity")


def squeezes(vols: DataFrame, n: int = 100) -> DataFrame:
    """Whether each volatility (symbol, ts, vol) lies below the 10th or above the 90th
    percentile of the ``n`` before it (20 at least)."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-n, -1)
    rows = vols.withColumns({"_l": F.percentile("vol", F.lit(0.1)).over(w), "_h": F.percentile("vol", F.lit(0.9)).over(w), "_n": F.count("vol").over(w)})
    state = F.when(F.col("_n") < 20, "unknown").when(F.col("vol") < F.col("_l") - 1e-12, "squeeze").when(F.col("vol") > F.col("_h") + 1e-12, "expansion").otherwise("normal")
    return rows.select("symbol", "ts", "vol", state.alias("state"))


def session(time: str) -> Column:
    """Market session of a time in ms by the New York hour."""
    hour = F.hour(F.from_utc_timestamp(F.timestamp_millis(time), "America/New_York"))
    return F.when((hour >= 8) & (hour < 12), "NY_OVERLAP").when((hour >= 12) & (hour < 17), "NY").when((hour >= 3) & (hour < 8), "EUROPE").otherwise("ASIA")


def confluence(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted agreement of signals (t, source, direction in -1, 0, 1, confidence)."""
    rows = signals.join(weights, "source")
    part = F.col("weight") * F.col("confidence")
    out = rows.groupBy("symbol", "t").agg(
        F.sum((part * F.col("direction")).cast("decimal(20,8)")).cast("double").alias("score"), F.sum(part.cast("decimal(20,8)")).cast("double").alias("total"), F.count(F.lit(1)).alias("sources")
    )
    strength = F.try_divide(F.col("score"), F.col("total"))
    return out.withColumn("strength", strength).withColumn(
        "label", F.when(F.col("strength") > 0.5, "STRONG_BUY").when(F.col("strength") > 0.1, "BUY").when(F.col("strength") < -0.5, "STRONG_SELL").when(F.col("strength") < -0.1, "SELL").otherwise("NEUTRAL")
    )


def macro_regime(rows: DataFrame) -> DataFrame:
    """RISK_ON, RISK_OFF or TRANSITION from volatility, dominance and yield curve."""
    points = F.when(F.col("vix") > 30, -2).when(F.col("vix") > 20, -1).otherwise(1) + F.when(F.col("dominance") > 55, -1).otherwise(1) + F.when(F.col("curve") < 0, -1).otherwise(1)
    return rows.withColumn("points", points).withColumn("regime", F.when(F.col("points") >= 2, "RISK_ON").when(F.col("points") <= -2, "RISK_OFF").otherwise("TRANSITION"))


def cot(points: DataFrame) -> DataFrame:
    """Signals of derivatives points (symbol, ts, funding, interest, ratio)."""
    change = F.try_divide(F.col("interest"), F.lag("interest", 4).over(line())) - 1
    rows = points.withColumn("interest_change", change)
    rules = {
        "funding_high": F.col("funding") > 0.0005, "funding_negative": F.col("funding") < 0, "interest_rising": F.col("interest_change") > 0.05,
        "crowded_longs": F.col("ratio") > 2, "crowded_shorts": F.col("ratio") < 0.5, "squeeze_risk": (F.col("funding") < 0) & (F.col("interest_change") > 0.05),
    }
    return rows.withColumn("signals", F.concat_ws(",", *(F.when(r, n) for n, r in rules.items())))


def outcome_probability(outcomes: DataFrame, least: int = 5) -> DataFrame:
    """Share of each direction and mean change by symbol and horizon, with enough outcomes."""
    known = outcomes.where("direction IS NOT NULL")
    share = lambda d: F.avg((F.col("direction") == d).cast("double"))
    out = known.groupBy("symbol", "h").agg(
        F.count(F.lit(1)).alias("n"), share("up").alias("up"), share("down").alias("down"), F.avg("change").alias("mean"), F.min("change").alias("worst"), F.max("change").alias("best")
    )
    return out.where(F.col("n") >= least)


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def similar(vectors: DataFrame, queries: DataFrame, k: int = 5, measure: str = "cosine") -> DataFrame:
    """The ``k`` most similar vectors (vec_id, embedding) of each query, of all vectors with
    another id. Queries are compared in blocks of at most ``QUERY_BYTES``; each block is one
    pass over the vectors, in which a task keeps only the k best of its rows for each query.

    Vectors that are null, of another length than the query or hold null or non-finite
    components have no score and take no part, nor do rows without id; for the cosine, nor do
    vectors that are zero. A query that repeats is searched once."""

    def usable(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        df = df.where(F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
        return df.where(F.exists("v", lambda x: x != 0)) if measure == "cosine" else df.where(F.size("v") > 0)

    spark, rows, asked = vectors.sparkSession, usable(vectors), usable(queries).distinct()
    sizes = [(r["d"], r["n"]) for r in asked.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()]
    schema, parts = "query_id long, vec_id long, score double", []
    for d, n in sizes:
        blocks = -(-n * (8 * d + 8) // QUERY_BYTES)
        for i in range(blocks):
            block = asked.where((F.size("v") == d) & (F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == i)).orderBy("vec_id", "v").toArrow()
            if block.num_rows:
                q = block["v"].combine_chunks().flatten().to_numpy().reshape(-1, d)
                shared = spark.sparkContext.broadcast((block["vec_id"].to_numpy(), q))
                parts.append(rows.where(F.size("v") == d).mapInArrow(_nearest_of_task(shared, k, measure), schema))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _nearest_of_task(shared, k: int, measure: str):
    """Batches of (vec_id, v) to the k best of all of them for each query. A product of
    matrices only picks the rows that can be among them; their scores are summed row by row."""

    def run(batches):
        query_ids, q = shared.value
        q_norm = np.sqrt((q * q).sum(1))
        unit = q / q_norm[:, None] if measure == "cosine" else q
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
        least = np.full(len(q), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            square = (x * x).sum(1)
            step = max(1, PAIRS // len(x))
            for start in range(0, len(q), step):
                at = slice(start, start + step)
                if measure == "cosine":
                    rough, near = unit[at] @ (x / np.sqrt(square)[:, None]).T, np.full(len(q[at]), 1e-9)
                else:
                    # The squared distance, negative; its error grows with the lengths.
                    rough = 2 * (q[at] @ x.T) - square - (q_norm[at] ** 2)[:, None]
                    near = 1e-9 * (square.max() + q_norm[at] ** 2)
                rough[query_ids[at][:, None] == ids] = -np.inf
                cut = np.partition(rough, -k, axis=1)[:, -k] if len(x) > k else np.full(len(rough), -np.inf)
                known = least[at] if measure == "cosine" else np.where(np.isfinite(least[at]), -(least[at] ** 2), -np.inf)
                cut = np.maximum(cut, known) - near
                for i in np.flatnonzero(rough.max(1) >= cut):
                    some = np.flatnonzero((rough[i] >= cut[i]) & (rough[i] > -np.inf))
                    one = q[start + i]
                    if measure == "cosine":
                        score = (x[some] * one).sum(1) / np.sqrt(square[some] * (one * one).sum())
                    else:
                        score = -np.sqrt(((x[some] - one) ** 2).sum(1))
                    held = best[start + i]
                    best[start + i] = held = _top(np.append(held[0], ids[some]), np.append(held[1], score), k)
                    if len(held[0]) == k:
                        least[start + i] = held[1][-1]
        counts = [len(b[0]) for b in best]
        if sum(counts):
            columns = [np.repeat(query_ids, counts), np.concatenate([b[0] for b in best]), np.concatenate([b[1] for b in best])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return run


def train_direction(rows: DataFrame, features: list[str], cut: float = 0.8):
    """Boosted trees on the first ``cut`` of time, their quality on the rest: (model, metrics)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
    from pyspark.ml.feature import Imputer, VectorAssembler

    rows = rows.withColumn("label", F.col("label").cast("double"))
    split = rows.agg(F.percentile_approx("ts", cut, 1000)).first()[0]
    filled = [f"{f}_filled" for f in features]
    steps = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features", handleInvalid="skip")]
    model = Pipeline(stages=[*steps, GBTClassifier(maxIter=10, maxDepth=3, seed=42)]).fit(rows.where(F.col("ts") <= split))
    scored = model.transform(rows.where(F.col("ts") > split))
    quality = {name: MulticlassClassificationEvaluator(metricName=name).evaluate(scored) for name in ("accuracy", "f1")}
    return model, quality | {"auc": BinaryClassificationEvaluator().evaluate(scored)}
