"""Direction models: features by alias, time-ordered folds, versions on disk, scores of batches and streams."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .indicators import line, over

# The features a model is trained on, in order; where a record may hold each of them; what stands for a missing one.
FEATURES = ("price_close", "return_1", "return_5", "return_10", "bb_upper", "bb_lower", "bb_width", "rsi", "volume_ratio")
ALIASES = {
    "price_close": ("price_close", "enriched.ohlc.close", "preco_fechamento", "price", "current_price"),
    "return_1": ("return_1", "ml_features.price_features.returns_1", "ml_features.price_features.returns_1m"),
    "return_5": ("return_5", "ml_features.price_features.returns_5", "ml_features.price_features.returns_5m"),
    "return_10": ("return_10", "ml_features.price_features.returns_10", "ml_features.price_features.returns_10m"),
    "bb_upper": ("bb_upper", "ml_features.price_features.bb_upper", "technical.bb_upper"),
    "bb_lower": ("bb_lower", "ml_features.price_features.bb_lower", "technical.bb_lower"),
    "bb_width": ("bb_width", "ml_features.price_features.bb_width", "technical.bb_width"),
    "rsi": ("rsi", "ml_features.price_features.rsi", "technical.rsi", "contextual.multi_tf.15m.rsi", "multi_tf.15m.rsi_short",
            "multi_tf.1h.rsi_short", "multi_tf.4h.rsi_short", "multi_tf.1d.rsi_short"),
    "volume_ratio": ("volume_ratio", "ml_features.microstructure.volume_ratio", "volume_sma_ratio"),
}
DEFAULTS = {"price_close": 0.0, "return_1": 0.0, "return_5": 0.0, "return_10": 0.0, "rsi": 50.0, "volume_ratio": 1.0}
RSI_FALLBACKS = tuple(f"multi_tf.{tf}.{key}" for tf in ("15m", "1h", "4h", "1d") for key in ("rsi_short", "rsi", "rsi_14"))
#: Features whose 0 is a value; a 0 of any other counts as missing.
ZERO_COUNTS = ("return_1", "return_5", "return_10")
#: Rows before a model's score may be used, and before all features are there; features that must be real otherwise.
RSI_PERIOD, BAND_PERIOD, LEAST_REAL = 14, 20, 7
#: Scores from which a row is called bullish, and below which bearish.
BULLISH, BEARISH = 0.6, 0.4


def field(schema: T.StructType, path: str) -> Column | None:
    """The column at a path: a column of that very name, else the nested field; None if the schema has neither."""
    if path in schema.names:
        return F.col(f"`{path}`")
    found, kind = None, schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
        found = F.col(f"`{part}`") if found is None else found.getField(part)
    return None if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else found


def _number(column: Column) -> Column:
    """The column as a finite double; texts that are no number are null."""
    value = column.try_cast("double")
    return F.when(~F.isnan(value), value)


def history_features(candles: DataFrame) -> DataFrame:
    """``candles`` with what the last rows of a symbol give of each feature (``own_<feature>``) and ``history``, the rows so
    far up to 100. A return over k rows compares with the row k - 1 before; bands need 20 rows; the relative
    strength takes as many of 14 moves as there are, at least 2."""
    n = F.count(F.lit(1)).over(line().rowsBetween(Window.unboundedPreceding, 0))
    rows = candles.withColumns({"_n": n, "_d": F.col("close") - F.lag("close").over(line())})
    moves = over(RSI_PERIOD)
    mean, dev = F.avg("close").over(over(BAND_PERIOD)), F.stddev_samp("close").over(over(BAND_PERIOD))
    gain, loss = F.avg(F.greatest("_d", F.lit(0.0))).over(moves), F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(moves)
    rows = rows.withColumns({"_mean": mean, "_dev": dev, "_gain": gain, "_loss": loss, "_volume": F.avg("volume").over(over(20))})
    back = lambda k: F.try_divide("close", F.lag("close", k).over(line())) - 1
    banded = lambda c: F.when(F.col("_n") >= BAND_PERIOD, c)
    strength = F.when(F.col("_loss") < 1e-10, F.when(F.col("_gain") > 1e-10, 80.0).otherwise(50.0)).otherwise(100 - 100 / (1 + F.col("_gain") / F.col("_loss")))
    own = {
        "price_close": F.col("close"),
        "return_1": back(1),
        "return_5": F.when(F.col("_n") >= 6, back(4)),
        "return_10": F.when(F.col("_n") >= 11, back(9)),
        "bb_upper": banded(F.col("_mean") + 2 * F.col("_dev")),
        "bb_lower": banded(F.col("_mean") - 2 * F.col("_dev")),
        "bb_width": banded(F.when(F.col("_mean") > 0, 4 * F.col("_dev") / F.col("_mean")).otherwise(0.0)),
        "rsi": F.when(F.col("_n") >= 3, strength),
        "volume_ratio": F.when(F.col("_volume") > 1e-10, F.col("volume") / F.col("_volume")).otherwise(1.0),
    }
    # A single row has no history: nothing is derived from it.
    rows = rows.withColumns({f"own_{k}": F.when((F.col("_n") >= 2) & (F.col("close") > 0), v) for k, v in own.items()})
    return rows.withColumn("history", F.least("_n", F.lit(100))).drop("_n", "_d", "_mean", "_dev", "_gain", "_loss", "_volume")


def resolved(rows: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """``rows`` with each feature as ``f_<name>`` and where they came from: n_external, n_internal, n_default.

    The first alias in the schema with a number gives a feature; a 0 counts only for returns. Else it is what
    history gives (``own_<name>``), else its default, null where it has none. A relative strength of 0, 100 or beyond
    is replaced by the first plausible one of a longer time frame, else 50. Row by row: works on streams."""
    schema = rows.schema
    given, own = {}, {}
    for name, paths in aliases.items():
        found = [_number(c) for c in (field(schema, p) for p in paths) if c is not None]
        found = found if name in ZERO_COUNTS else [F.when(c != 0, c) for c in found]
        given[name] = F.coalesce(*found) if found else F.lit(None).cast("double")
        inner = field(schema, f"own_{name}")
        own[name] = F.lit(None).cast("double") if inner is None else inner
    value = {n: F.coalesce(given[n], own[n], F.lit(DEFAULTS.get(n)).cast("double")) for n in aliases}
    if "rsi" in value:
        longer = [_number(c) for c in (field(schema, p) for p in RSI_FALLBACKS) if c is not None]
        better = F.coalesce(*(F.when((c > 5) & (c < 95), c) for c in longer), F.lit(50.0))
        value["rsi"] = F.when((value["rsi"] >= 100) | (value["rsi"] <= 0), better).otherwise(value["rsi"])
    outside = sum(given[n].isNotNull().cast("int") for n in aliases)
    inside = sum((given[n].isNull() & own[n].isNotNull()).cast("int") for n in aliases)
    counts = {"n_external": outside, "n_internal": inside, "n_default": F.lit(len(aliases)) - outside - inside}
    return rows.withColumns({f"f_{n}": c for n, c in value.items()} | counts)


def labelled(candles: DataFrame, horizon: int = 15, threshold: float = 0.002) -> DataFrame:
    """``candles`` with label 1 where the close ``horizon`` rows on is more than ``threshold`` above, 0 where it is not, null at the end."""
    change = F.try_divide(F.lead("close", horizon).over(line()), "close") - 1
    return candles.withColumn("label", (change > threshold).cast("double"))


def _pipeline(features: tuple[str, ...], rounds: int, tolerance: float) -> Pipeline:
    given, filled = [f"f_{n}" for n in features], [f"_filled_{n}" for n in features]
    trees = GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.2, seed=42, weightCol="_weight", validationIndicatorCol="_later", validationTol=tolerance)
    return Pipeline(stages=[Imputer(strategy="median", inputCols=given, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), trees])


def fitted(rows: DataFrame, features: tuple[str, ...] = FEATURES, rounds: int = 20, tolerance: float = 0.01) -> PipelineModel:
    """A model of the rows (f_<name>, label, ``_later``: whether a row is kept for early stopping). Ups weigh as much
    as the others together; trees are added until the later rows gain less than ``tolerance``."""
    up, n = rows.where("NOT _later").agg(F.sum("label"), F.count("label")).first()
    weight = (n - up) / up if up else 1.0
    rows = rows.withColumn("_weight", F.when(F.col("label") > 0, weight).otherwise(1.0))
    return _pipeline(features, rounds, tolerance).fit(rows)


def time_folds(rows: DataFrame, folds: int = 5, features: tuple[str, ...] = FEATURES, rounds: int = 20, held: float = 0.2) -> tuple[PipelineModel, DataFrame]:
    """A model, and how models of the time before did on each later stretch: (model, quality).

    Rows with a label are cut by time into ``folds`` + 2 stretches of equal size. Stretch k is scored by a model of all
    before it; the last of these stops early by the stretch before the one held out, and is the model. Quality is one row a fold:
    fold, rows, ups, called, hits, precision, recall, accuracy, brier (mean squared error of prob_up). Cuts are
    exact ranks of distinct times, so equal times are never parted."""
    rows = rows.where("label IS NOT NULL")
    times = rows.groupBy("ts").agg(F.count(F.lit(1)).alias("n"))
    cuts = times.agg(*(F.expr(f"percentile(ts, {k / (folds + 1)}, n)").alias(f"c{k}") for k in range(1, folds + 1))).first()
    scored, model = [], None
    for k in range(1, folds + 1):
        begin, end = cuts[k - 1], cuts[k] if k < folds else None
        known = rows.where(F.col("ts") <= begin)
        if known.isEmpty():
            continue
        later = known.agg(F.expr(f"percentile(ts, {1 - held})")).first()[0]
        model = fitted(known.withColumn("_later", F.col("ts") > later), features, rounds)
        part = rows.where(F.col("ts") > begin)
        part = part.where(F.col("ts") <= end) if end is not None else part
        scored.append(scores(model, part.withColumn("_weight", F.lit(1.0))).select(F.lit(k).alias("fold"), "label", "prob_up"))
    if not scored:
        return None, rows.sparkSession.createDataFrame([], "fold int, rows long, ups long, called long, hits long, precision double, recall double, accuracy double, brier double")
    every = scored[0]
    for part in scored[1:]:
        every = every.union(part)
    called, up = F.col("prob_up") >= 0.5, F.col("label") > 0
    count = lambda c: F.count(F.when(c, 1))
    out = every.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), count(up).alias("ups"), count(called).alias("called"), count(called & up).alias("hits"),
        F.avg((called == up).cast("double")).alias("accuracy"), F.avg(F.pow(F.col("prob_up") - F.col("label"), F.lit(2))).alias("brier"),
    )
    out = out.withColumns({"precision": F.try_divide("hits", "called"), "recall": F.try_divide("hits", "ups")})
    return model, out.select("fold", "rows", "ups", "called", "hits", "precision", "recall", "accuracy", "brier")


def scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` (f_<name>) with prob_up, prob_down, signal and confidence; row by row, so it works on streams."""
    from pyspark.ml.functions import vector_to_array

    given = rows.columns
    up = vector_to_array("probability")[1]
    out = model.transform(rows).withColumn("prob_up", up).select(*(f"`{c}`" for c in given if c != "_weight"), "prob_up")
    signal = F.when(F.col("prob_up") > BULLISH, "bullish").when(F.col("prob_up") < BEARISH, "bearish").otherwise("neutral")
    return out.withColumns({"prob_down": 1 - F.col("prob_up"), "signal": signal, "confidence": F.abs(F.col("prob_up") - 0.5) * 2})


def with_readiness(scored: DataFrame) -> DataFrame:
    """Whether a score may take part in a decision (``usable``: 7 real features, or 15 rows of history), and whether
    all features had their history (``warm``). Rows without ``history`` have none."""
    history = F.coalesce(F.col("history"), F.lit(0)) if "history" in scored.columns else F.lit(0)
    real = F.col("n_external") + F.col("n_internal")
    return scored.withColumns({"usable": (real >= LEAST_REAL) | (history >= RSI_PERIOD + 1), "warm": history >= max(BAND_PERIOD, RSI_PERIOD + 1, 10)})


def save(model: PipelineModel, root: str, version: int, features: tuple[str, ...] = FEATURES) -> None:
    """The model below ``root``, and a line in the list of versions. A version is written once: the list
    gets its line last, so a version in it is whole."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{root}/model-{version}")
    listed = spark.createDataFrame([(version, json.dumps(features))], "version long, features string")
    listed.write.mode("append").json(f"{root}/versions")


def load(spark: SparkSession, root: str, version: int | None = None) -> tuple[PipelineModel, tuple[str, ...]]:
    """The model of a version, by default of the newest, and its features. A version that is not listed is an error."""
    listed = spark.read.schema("version long, features string").json(f"{root}/versions")
    listed = listed if version is None else listed.where(F.col("version") == version)
    newest = listed.orderBy(F.desc("version")).first()
    if newest is None:
        raise ValueError(f"no version {'' if version is None else version} below {root}")
    return PipelineModel.load(f"{root}/model-{newest['version']}"), tuple(json.loads(newest["features"]))
