"""Streams give what the batch operators give on the same rows."""

from tapeflow.operators import bars
from tapeflow.streaming import stream

SCHEMA = "symbol string, p double, q double, t bigint, m boolean, seq bigint"


def feed(spark, tmp_path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


PARTS = [[("a", float(i % 7 + 1), 1.0 + i % 3, 20_000 * i, i % 2 == 0, i) for i in range(k, k + 20)] for k in range(0, 60, 20)]


def test_windows(spark, tmp_path):
    got = drained(stream.ohlcv(feed(spark, tmp_path, PARTS)), "windows").collect()
    batch = spark.createDataFrame(sum(PARTS, []), SCHEMA)
    want = {(r["symbol"], r["window_end"]): (r["open"], r["high"], r["low"], r["close"], r["volume"], r["n"]) for r in bars.ohlcv(batch, 60_000).collect()}
    assert len(got) >= len(want) - 2
    assert all(want[r["symbol"], r["window_end"]] == (r["open"], r["high"], r["low"], r["close"], r["volume"], r["n"]) for r in got)


def test_anchored_bars(spark, tmp_path):
    got = sorted((r["open_t"], r["open"], r["close"], r["n"]) for r in drained(stream.anchored_bars(feed(spark, tmp_path, PARTS), 60_000), "bars").collect())
    batch = spark.createDataFrame(sum(PARTS, []), SCHEMA)
    want = sorted((r["open_t"], r["open"], r["close"], r["n"]) for r in bars.anchored_bars(batch, 60_000).collect())
    assert got == want[: len(got)] and len(got) >= len(want) - 1


def test_dedup_and_cooldown(spark, tmp_path):
    twice = [[("a", 1.0, 1.0, 1000 * i, True, i // 2) for i in range(6)]]
    assert drained(stream.deduplicated(feed(spark, tmp_path, twice), ["seq"]), "once").count() == 3
    alerts = feed(spark, tmp_path / "b", [[("a", 1.0, 1.0, t, True, 0) for t in (0, 5, 12, 20, 31)]])
    kept = stream.cooled(alerts.selectExpr("symbol", "'spike' AS kind", "t"), 10)
    assert sorted(r["t"] for r in drained(kept, "kept").collect()) == [0, 12, 31]


def test_fan_out(spark, tmp_path):
    seen = {}
    events = feed(spark, tmp_path, PARTS).selectExpr("CASE WHEN m THEN 'sell' ELSE 'buy' END AS event_type", "seq")
    handlers = {k: (lambda df, n, k=k: seen.__setitem__(k, seen.get(k, 0) + df.count())) for k in ("sell", "buy")}
    stream.fan_out(events, handlers, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert seen == {"sell": 30, "buy": 30}
