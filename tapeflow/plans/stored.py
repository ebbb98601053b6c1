"""Queries over readers of stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import stored
from ..sources.tables import candles_from_orders, table, trades_from_events
from .base import DAY, rounded, sql

AS_OF = 1_706_000_000_000


def src_liquidations(spark, d):
    return stored.liquidations(trades_from_events(spark, d), AS_OF, 2_000).select("symbol", "seq", "t", "p", "q")


def src_derivatives(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("id"), (k % 90 * 1.0).alias("open_interest"), (F.col("c_nationkey") + 100.0).alias("price"), (k % 16 / 8.0).alias("long_short"))
    return rounded(stored.derivatives(rows).select("id", "longs", "shorts"))


def src_onchain(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer")
    a = rows.where(k % 3 != 0).select(k.alias("ts"), F.when(k % 2 == 0, F.col("c_acctbal")).alias("hashrate"), k.alias("height"))
    b = rows.where(k % 5 != 0).select(k.alias("ts"), (F.col("c_acctbal") + 1).alias("hashrate"), F.col("c_nationkey").alias("fees"))
    return rounded(stored.merged(a, b, "ts"))


def src_ticker_fallback(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("asset"), F.col("l_linenumber").alias("source"), F.col("l_orderkey").alias("key"))
    return stored.first_source(rows, 90)


def src_macro(spark, d):
    c = candles_from_orders(spark, d).where("symbol = '1-URGENT'")
    series = c.select(F.lit("all").alias("symbol"), (F.col("ts") + 12 * 3_600_000).alias("rt"), F.col("close").alias("value"))
    windows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("all").alias("symbol"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("t"))
    return stored.macro_at(windows, series).select("id", "t", "value")


def _payloads(spark, d):
    k = F.col("o_orderkey")
    label = F.element_at(F.array(*map(F.lit, ("Absorção de Venda", "Absorção de Compra", "Neutro"))), (k % 3 + 1).cast("int"))
    price = F.when(k % 7 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice"))
    result = F.struct(F.when(k % 2 == 0, "buy").otherwise("wait").alias("action"), (k % 8 / 8.0).alias("confidence"))
    payload = F.to_json(F.struct(label.alias("label"), price.alias("price"), result.alias("result"), F.struct((k % 4 / 4.0).alias("prob_up")).alias("quant")))
    return table(spark, d, "orders").select(k.alias("id"), F.when(k % 5 == 0, "AI_ANALYSIS").otherwise("SIGNAL").alias("kind"), payload.alias("payload"))


def src_signals(spark, d):
    return rounded(stored.signals(_payloads(spark, d)).select("id", "side", "price"))


def src_model_decisions(spark, d):
    return stored.model_decisions(_payloads(spark, d)).select("id", "action", "confidence", "prob_up")


def src_future_closes(spark, d):
    c = candles_from_orders(spark, d)
    points = c.where("volume > 2").select(F.col("ts").alias("id"), "symbol", F.col("ts").alias("t"))
    return stored.future_closes(points, c, 3 * DAY).select("id", "symbol", "ts", "close")


def src_complete(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("id"), F.when(k % 3 == 0, k).alias("epoch_ms"), F.when(k % 5 == 0, k).alias("event_ms"), (k % 2 == 0).alias("is_absorption"), F.when(k % 4 != 0, k % 10 / 100.0).alias("absorption_index"))
    return stored.complete(rows, ["epoch_ms", "event_ms"]).select("id", "sound")


QUERIES = (src_liquidations, src_derivatives, src_onchain, src_ticker_fallback, src_macro, src_signals, src_model_decisions, src_future_closes, src_complete)

ORACLE = {
    "src_liquidations": sql("trades", select=f"SELECT symbol, seq, t, p, q FROM trades WHERE t BETWEEN {AS_OF - 86_400_000} AND {AS_OF}"),
    "src_derivatives": sql(more="v AS (SELECT c_custkey AS id, (c_custkey % 90) * (c_nationkey + 100.0::DOUBLE) AS v, (c_custkey % 16) / 8 AS r FROM customer)", select="SELECT id, round(v * r / (1 + r), 6) AS longs, round(v / (1 + r), 6) AS shorts FROM v"),
    "src_onchain": """SELECT c_custkey AS ts, round(CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN c_acctbal WHEN c_custkey % 5 <> 0 THEN c_acctbal + 1 END, 6) AS hashrate, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS height, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS fees
        FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 5 <> 0""",
    "src_ticker_fallback": """SELECT l_suppkey AS asset, l_linenumber AS source, l_orderkey AS key FROM lineitem JOIN (SELECT a, min(s) AS s FROM (SELECT l_suppkey AS a, l_linenumber AS s FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 90) GROUP BY 1) ON a = l_suppkey AND s = l_linenumber""",
    "src_macro": sql("candles", select="SELECT o_orderkey AS id, epoch_us(o_orderdate) // 1000 AS t, value FROM orders o ASOF LEFT JOIN (SELECT ts + 43200000 AS rt, close AS value FROM candles WHERE symbol = '1-URGENT') m ON m.rt <= epoch_us(o.o_orderdate) // 1000"),
    "src_signals": "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'BUY' ELSE 'SELL' END AS side, round(o_totalprice, 6) AS price FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 7 <> 0",
    "src_model_decisions": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'wait' END AS action, (o_orderkey % 8) / 8 AS confidence, (o_orderkey % 4) / 4 AS prob_up FROM orders WHERE o_orderkey % 5 = 0",
    "src_future_closes": sql("candles", select=f"SELECT p.ts AS id, p.symbol, c.ts, c.close FROM candles p JOIN candles c ON c.symbol = p.symbol AND c.ts > p.ts AND c.ts <= p.ts + {3 * DAY} WHERE p.volume > 2"),
    "src_complete": "SELECT c_custkey AS id, (c_custkey % 3 = 0 OR c_custkey % 5 = 0) AND (c_custkey % 2 = 0 OR c_custkey % 4 = 0 OR c_custkey % 10 >= 2) AS sound FROM customer",
}
