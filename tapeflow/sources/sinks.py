"""Stored events, features and signals: how they are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StructType

#: Columns of the signal file, in order. Fixed values.
SIGNAL_COLUMNS = "timestamp_utc symbol exchange event_type side price delta volume poc val vah regime strength context".split()


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns with dotted names, arrays and maps as JSON, NaN and infinity as null."""
    out = []

    def walk(schema: StructType, path: tuple[str, ...]):
        for f in schema.fields:
            at = (*path, f.name)
            if isinstance(f.dataType, StructType):
                walk(f.dataType, at)
                continue
            column = F.col(".".join(f"`{x}`" for x in at))
            if isinstance(f.dataType, (ArrayType, MapType)):
                column = F.to_json(column)
            elif isinstance(f.dataType, (DoubleType, FloatType)):
                column = F.when(F.isnan(column) | (F.abs(column) == float("inf")), None).otherwise(column)
            out.append(column.alias(sep.join(at)))

    walk(df.schema, ())
    return df.select(*out)


def _append(rows: DataFrame, path: str, time: str) -> None:
    """Appends rows as Parquet, one folder a day. A run without rows would leave no file, and so none of its columns: each run
    adds an empty file to the folder of rows without a day, which readers merge."""
    rows.limit(0).write.mode("append").parquet(f"{path.rstrip('/')}/date=__HIVE_DEFAULT_PARTITION__")
    rows.withColumn("date", F.to_date(F.timestamp_millis(time))).write.mode("append").partitionBy("date").parquet(path)


def write_features(df: DataFrame, path: str, time: str = "ts") -> None:
    """Appends flattened rows as Parquet, one folder a day."""
    _append(flatten(df), path, time)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """All parts with the union of their columns."""
    return spark.read.option("mergeSchema", True).parquet(path)


def write_events(df: DataFrame, path: str) -> None:
    """Appends events (timestamp_ms, event_type, symbol, is_signal, ...) with the whole row as JSON payload."""
    rows = df.select("timestamp_ms", "event_type", "symbol", "is_signal", F.to_json(F.struct(*df.columns)).alias("payload"))
    _append(rows, path, "timestamp_ms")


def recent_events(spark: SparkSession, path: str, n: int = 100, event_type: str | None = None, signals_only: bool = False) -> DataFrame:
    """The last ``n`` events, oldest first."""
    rows = spark.read.parquet(path)
    if event_type:
        rows = rows.where(F.col("event_type") == event_type)
    if signals_only:
        rows = rows.where("is_signal")
    return rows.orderBy(F.desc("timestamp_ms"), F.desc("payload")).limit(n).orderBy("timestamp_ms", "payload")


def write_signals(df: DataFrame, path: str) -> None:
    """Appends signals as CSV with a header; absent columns are empty."""
    columns = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in SIGNAL_COLUMNS]
    df.select(*columns).write.mode("append").option("header", True).csv(path)
