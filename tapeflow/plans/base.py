"""Shared pieces of the queries and their DuckDB twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

HOUR, DAY = 3_600_000, 86_400_000

#: The adapters of ``sources.tables`` in DuckDB SQL, and the operators that many queries build on.
CTE = {
    "trades": """trades AS (SELECT event_type AS symbol, value AS p, (CAST(json_extract_string(props, '$.k') AS BIGINT) + 1) / 10.0::DOUBLE AS q,
        epoch_us(ts) // 1000 AS t, CAST(NULL AS BOOLEAN) AS m, event_id AS seq FROM events)""",
    "sided": """ticks AS (SELECT *, CASE WHEN p > lag(p) OVER w THEN false WHEN p < lag(p) OVER w THEN true END AS tick
        FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY t, seq)),
        sided AS (SELECT symbol, p, q, t, seq, coalesce(last_value(tick IGNORE NULLS) OVER
        (PARTITION BY symbol ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS m FROM ticks)""",
    "hours": """hours AS (SELECT symbol, (t // 3600000 + 1) * 3600000 AS window_end, arg_min(p, (t, seq)) AS open, max(p) AS high, min(p) AS low,
        arg_max(p, (t, seq)) AS close, sum(CAST(q AS DECIMAL(20,8)))::DOUBLE AS volume,
        sum(CAST(CASE WHEN NOT m THEN q ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS buy_volume,
        sum(CAST(CASE WHEN m THEN q ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS sell_volume,
        sum(CAST(p * q AS DECIMAL(20,8)))::DOUBLE / sum(CAST(q AS DECIMAL(20,8)))::DOUBLE AS vwap, count(*) AS n, min(t) AS open_t, max(t) AS close_t
        FROM sided GROUP BY 1, 2)""",
    "candles": """candles AS (SELECT o_orderpriority AS symbol, epoch_us(o_orderdate) // 1000 AS ts, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS open,
        max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS close,
        count(*)::DOUBLE AS volume FROM orders GROUP BY 1, 2)""",
    "book": """book AS (SELECT p_brand AS snapshot, CASE WHEN p_partkey % 2 = 1 THEN 'bid' ELSE 'ask' END AS side,
        CASE WHEN p_partkey % 2 = 1 THEN p_retailprice - 200 ELSE p_retailprice + 1 END AS price, p_size::DOUBLE AS qty, p_partkey AS seq FROM part)""",
}


def sql(*names: str, select: str, more: str = "") -> str:
    """A statement over the named shared pieces."""
    parts = [CTE[n] for n in names]
    return "WITH " + ", ".join(parts + ([more] if more else [])) + " " + select


#: Added before rounding on both sides, so that no value lies half-way between two results.
NUDGE = 1.7e-10


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, so that the order of a sum does not show."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)]
    return df.withColumns({c: F.round(F.col(c) + NUDGE, digits) for c in names})


def nudged(statement: str) -> str:
    """A statement whose ``round(x, 6) AS`` (or 3, 4) rounds as :func:`rounded` does."""
    return re.sub(r", ([346])\)(?= AS)", rf" + {NUDGE}, \1)", statement)
