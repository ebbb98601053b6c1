"""Stored records read again: damaged lines set apart, parts with different columns joined, gates on what comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

#: Column in which a line that is no record stands.
DAMAGED = "_corrupt_record"
#: Names that a time or a price may have, in order. Fixed values.
TIMES, PRICES = ("saved_at", "timestamp", "epoch_ms", "timestamp_ms"), ("close", "price", "preco_fechamento", "price_close")


def _parsed(lines: DataFrame, schema: StructType) -> DataFrame:
    """Lines (value) as records: a line that is none has nulls and its text in ``_corrupt_record``."""
    fields = StructType([f for f in schema.fields if f.name != DAMAGED] + [StructField(DAMAGED, StringType())])
    record = F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": DAMAGED})
    rows = lines.where(F.trim("value") != "").select(record.alias("_r"), F.input_file_name().alias("_file"))
    return rows.select("_r.*", "_file")


def read_lines(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """JSON lines below a path as records, with the text of lines that are none in ``_corrupt_record``. Without a schema
    it is read from the lines themselves: the union of the fields of all parts. Empty lines are no records."""
    if schema is None:
        schema = spark.read.option("columnNameOfCorruptRecord", DAMAGED).json(path).schema
    return _parsed(spark.read.text(path), schema)


def parts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of :func:`read_lines`: each line is in one of both. Rejects: file, line, reason."""
    columns = [c for c in lines.columns if c not in (DAMAGED, "_file")]
    bad = lines.where(F.col(DAMAGED).isNotNull())
    text = F.trim(F.col(DAMAGED))
    reason = F.when(~text.startswith("{"), "no_object").when(~text.endswith("}"), "cut_off").otherwise("malformed")
    return lines.where(F.col(DAMAGED).isNull()).select(*columns), bad.select(F.col("_file").alias("file"), F.col(DAMAGED).alias("line"), reason.alias("reason"))


def counted(lines: DataFrame) -> DataFrame:
    """Good and damaged lines of each file."""
    bad = F.col(DAMAGED).isNotNull()
    return lines.groupBy(F.regexp_extract("_file", r"[^/]+$", 0).alias("file")).agg(F.count(F.when(~bad, 1)).alias("good"), F.count(F.when(bad, 1)).alias("damaged"))


def follow_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The same lines as a stream, for a replay that goes on where it stopped; use it with ``trigger(availableNow=True)``."""
    return _parsed(spark.readStream.text(path), schema)


def replay(stream: DataFrame, good: str, rejects: str, checkpoint: str):
    """Starts a query that writes records and rejects of every micro-batch apart; what a repeated batch wrote is replaced."""

    def batch(lines: DataFrame, number: int) -> None:
        lines = lines.persist()
        records, bad = parts(lines)
        records.write.mode("overwrite").parquet(f"{good}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        lines.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def gate(rows: DataFrame, required: tuple[str, ...] = (), least: int = 100, most_null: float = 0.3) -> DataFrame:
    """One row on whether a table may be learned from: rows, errors, warnings, valid, and the null share of each column (a map).

    Errors are missing required columns, no price, fewer rows than ``least``; warnings are columns beyond ``most_null`` and no time.
    All shares come from one pass."""
    shares = F.map_from_arrays(
        F.array(*map(F.lit, rows.columns)), F.array(*(F.coalesce(F.avg(F.col(f"`{c}`").isNull().cast("double")), F.lit(0.0)) for c in rows.columns))
    )
    out = rows.agg(F.count(F.lit(1)).alias("rows"), shares.alias("null_share"))
    missing = [c for c in required if c not in rows.columns]
    errors = [F.lit(f"missing: {c}") for c in missing]
    if not any(c in rows.columns for c in PRICES):
        errors.append(F.lit("no price"))
    errors.append(F.when(F.col("rows") < least, F.lit("too few rows")))
    warnings = [] if any(c in rows.columns for c in TIMES) else [F.lit("no time")]
    many = F.transform(F.filter(F.map_entries("null_share"), lambda x: x["value"] > most_null), lambda x: F.concat(F.lit("null: "), x["key"]))
    out = out.withColumns({"errors": F.array_compact(F.array(*errors)), "warnings": F.concat(F.array(*warnings).cast("array<string>"), F.sort_array(many))})
    return out.withColumn("valid", F.size("errors") == 0).select("rows", "valid", "errors", "warnings", "null_share")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows without exact repeats, with ``_time`` (epoch milliseconds) from the first name of a time that has one: numbers below
    10^11 are seconds, texts ISO times."""
    found = []
    for name in TIMES:
        if name in rows.columns:
            text = F.col(name).cast("string")
            number = text.try_cast("double")
            scaled = F.when(F.abs(number) < 1e11, number * 1000).otherwise(number)
            found.append(F.coalesce(scaled.cast("long"), F.unix_millis(F.try_to_timestamp(text))))
    time = F.coalesce(*found) if found else F.lit(None).cast("long")
    return rows.dropDuplicates().withColumn("_time", time)
