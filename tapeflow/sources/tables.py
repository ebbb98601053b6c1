"""The stored tables as trades, candles and book ladders.

A trade has symbol, p (price), q (quantity), t (epoch ms), m (taker sells, or null), seq
(arrival order). A candle has symbol, ts (epoch ms), open, high, low, close, volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch_ms(column) -> F.Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def trades_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as trades without a taker side: the value is the price, props.k the size."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("value").alias("p"),
        ((F.get_json_object("props", "$.k").cast("bigint") + 1) / 10.0).alias("q"),
        epoch_ms("ts").alias("t"),
        F.lit(None).cast("boolean").alias("m"),
        F.col("event_id").alias("seq"),
    )


def trades_from_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as trades with a taker side: returned items are sales."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"),
        F.col("l_quantity").alias("q"),
        epoch_ms("l_shipdate").alias("t"),
        (F.col("l_returnflag") == "R").alias("m"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def candles_from_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as daily candles of each priority."""
    order = F.struct("o_orderdate", "o_orderkey")
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderpriority").alias("symbol"), epoch_ms("o_orderdate").alias("ts"))
        .agg(
            F.min_by("o_totalprice", order).alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", order).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
    )


def book_from_part(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as book levels: one snapshot a brand; odd keys are bids below, even keys asks above."""
    bid = F.col("p_partkey") % 2 == 1
    return table(spark, folder, "part").select(
        F.col("p_brand").alias("snapshot"),
        F.when(bid, "bid").otherwise("ask").alias("side"),
        F.when(bid, F.col("p_retailprice") - 200).otherwise(F.col("p_retailprice") + 1).alias("price"),
        F.col("p_size").cast("double").alias("qty"),
        F.col("p_partkey").alias("seq"),
    )


def read_trade_json(spark: SparkSession, path: str) -> DataFrame:
    """Trades from JSON lines with the field names of several feeds; rows without a
    positive price, quantity or time are left out."""
    rows = spark.read.text(path)
    raw = lambda *keys: F.coalesce(*(F.get_json_object("value", f"$.{k}") for k in keys))
    number = lambda *keys: raw(*keys).try_cast("double")
    return rows.select(
        raw("symbol", "s").alias("symbol"),
        number("p", "P", "price").alias("p"),
        number("q", "Q", "quantity").alias("q"),
        raw("T", "tradeTime", "E").try_cast("bigint").alias("t"),
        raw("m", "side").alias("m"),
        raw("seq").try_cast("bigint").alias("seq"),
    ).withColumn("m", taker_sells("m")).where("p > 0 AND q > 0 AND t > 0")


def taker_sells(column: str) -> F.Column:
    """A taker side in any spelling as boolean: true if the taker sells, null if unknown."""
    text = F.lower(F.trim(F.col(column).cast("string")))
    # Spellings of the two sides.
    return (
        F.when(text.isin("sell", "ask", "s", "seller", "true", "1", "yes"), True)
        .when(text.isin("buy", "bid", "b", "buyer", "false", "0", "no"), False)
        .otherwise(F.lit(None).cast("boolean"))
    )


def decode_klines(rows: DataFrame, column: str = "kline") -> DataFrame:
    """Candles from arrays of twelve strings: open time, open, high, low, close, volume, ..., trades."""
    k = lambda i, kind: F.col(column)[i].cast(kind)
    others = [c for c in rows.columns if c != column]
    return rows.select(
        *others,
        k(0, "bigint").alias("ts"),
        *(k(i + 1, "double").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"))),
        k(8, "bigint").alias("num_trades"),
    )
