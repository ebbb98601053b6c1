"""Level tests and books: tables against plain folds, streams against tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeflow.operators import adaptive, booksync, monitor
from tapeflow.streaming import stateful

TICKS = "symbol string, t bigint, seq bigint, price double, volume double, delta double"
LEVELS = "symbol string, kind string, place int, level double, strength double"
UPDATES = "book string, arrival bigint, kind string, first_id bigint, last_id bigint"
LINES = "book string, arrival bigint, side string, price double, qty double, line int"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def drained(df, name):
    df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def fed(spark, parts, schema, path):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def ticks(n=120):
    rng = np.random.default_rng(2)
    rows = []
    for s in ("a", "b"):
        price = 100 + np.cumsum(rng.normal(0, 0.4, n))
        rows += [(s, 1000 * i, i, float(p), float(v), float(v * d)) for i, (p, v, d) in enumerate(zip(price, rng.integers(0, 9, n), rng.uniform(-1, 1, n), strict=True))]
    return rows


LEVEL_ROWS = [("a", "support", 0, 99.0, 5.0), ("a", "support", 1, 99.2, 4.0), ("a", "resistance", 0, 99.1, 3.0), ("a", "resistance", 1, 103.0, 3.0), ("b", "resistance", 0, 100.0, 1.0), ("c", "support", 0, 1.0, 1.0), ("a", "support", 2, -1.0, 1.0)]


def expected_tests(rows, levels):
    out = set()
    for s in ("a", "b"):
        own = [r for r in rows if r[0] == s]
        for i, (_, _, seq, p, v, d) in enumerate(own):
            order = sorted((k != "support", place, level, k) for sym, k, place, level, _ in levels if sym == s and level > 0)
            hit = next(((k, level) for _, _, level, k in order if abs(p - level) <= level * 0.005), None)
            if not hit:
                continue
            last = own[max(0, i - 19) : i + 1]
            share = (d / v if v > 0 else 0) * (1 if hit[0] == "support" else -1)
            react = "strong_defense" if share > 0.6 else "defense" if share > 0.3 else "weak_defense" if share < -0.6 else "neutral"
            if i >= 9:
                change = (p / own[i - 9][3] - 1) * 100
                trend = "STRONG_UP" if change > 2 else "UP" if change > 0.5 else "STRONG_DOWN" if change < -2 else "DOWN" if change < -0.5 else "SIDEWAYS"
                prices = [x[3] for x in last]
                vol = "HIGH" if i >= 19 and np.std(prices) / np.mean(prices) * 100 > 1 else "LOW"
                five = own[i - 4 : i + 1]
                mean5 = np.mean([x[4] for x in five])
                m = np.mean([x[5] for x in five]) / mean5 if mean5 else 0
                momentum = "BULLISH" if m > 0.1 else "BEARISH" if m < -0.1 else "NEUTRAL"
            else:
                trend, vol, momentum = "UNKNOWN", "UNKNOWN", "NEUTRAL"
            mean = np.mean([x[4] for x in last])
            ratio = v / mean if mean else 1
            size = "EXTREME" if ratio > 3 else "HIGH" if ratio > 2 else "ELEVATED" if ratio > 1.5 else "LOW" if ratio < 0.5 else "NORMAL"
            out.add((s, seq, *hit, react, trend, vol, momentum, size))
    return out


COLUMNS = ["symbol", "seq", "kind", "level", "reaction", "trend", "volatility", "momentum", "volume_class"]


def test_level_expected_tests_force(spark, monkeypatch):
    monkeypatch.setattr(monitor, "RUN", 30)
    rows = ticks()
    df = spark.createDataFrame(rows + [("a", None, 999, 99.0, 1.0, 1.0)], TICKS).repartition(3)
    found = monitor.level_tests(df, spark.createDataFrame(LEVEL_ROWS, LEVELS))
    want = expected_tests(rows, LEVEL_ROWS)
    assert {tuple(r[c] for c in COLUMNS) for r in found.collect()} == want and len(want) > 20
    total = {(r["symbol"], r["kind"], r["level"]): (r["tests"], r["held"], r["failed"]) for r in monitor.summary(found).collect()}
    for key, (n, held, failed) in total.items():
        own = [w for w in want if (w[0], w[2], w[3]) == key]
        assert n == len(own) and held == sum(w[4] in ("strong_defense", "defense") for w in own) and failed == sum(w[4] == "weak_defense" for w in own)


def test_level_tests_of_a_stream(spark, tmp_path, rocks):
    rows = sorted(ticks(), key=lambda r: r[1])
    levels = spark.createDataFrame(LEVEL_ROWS, LEVELS)
    stream = fed(spark, [rows[:7], rows[7:90], rows[90:]], TICKS, str(tmp_path / "in"))
    got = {tuple(r[c] for c in COLUMNS) for r in drained(stateful.level_tests(stream, levels), "level_tests").collect()}
    assert got == expected_tests(rows, LEVEL_ROWS)


def test_level_tests_at_thresholds_are_those_of_sql(spark, tmp_path, rocks, monkeypatch):
    """Volumes in tenths, whose mean's last digit decides at a threshold, and a price of 0 that later changes begin at."""
    monkeypatch.setattr(monitor, "RUN", 30)
    rng = np.random.default_rng(21)
    rows = [(s, i // 2, i, 0.0 if i == 40 else float(rng.integers(980, 1021)) / 10, float(rng.integers(1, 101)) / 10, 0.0) for s in ("a", "b") for i in range(400)]
    c = duckdb.connect()
    c.execute("CREATE TABLE ticks (symbol VARCHAR, t BIGINT, seq BIGINT, price DOUBLE, volume DOUBLE, delta DOUBLE)")
    c.executemany("INSERT INTO ticks VALUES (?, ?, ?, ?, ?, ?)", rows)
    change = "CASE WHEN row_number() OVER s >= 10 THEN (price - first_value(price) OVER (s ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) / first_value(price) OVER (s ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) * 100 END"
    ratio = "volume / avg(volume) OVER (s ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    found = c.execute(f"SELECT symbol, seq, {change}, {ratio} FROM ticks WINDOW s AS (PARTITION BY symbol ORDER BY t, seq)").fetchall()
    want = {(s, i): rest for s, i, *rest in found if i != 40}
    assert sum(x[0] == float("inf") for x in want.values()) == 2
    df = spark.createDataFrame(rows, TICKS).repartition(3)
    assert {(r["symbol"], r["seq"]): [r["change10"], r["volume_ratio"]] for r in monitor.recent(df).where("seq <> 40").collect()} == want
    levels = spark.createDataFrame([(s, "support", 0, 100.0, 1.0) for s in ("a", "b")], LEVELS)
    rows.sort(key=lambda r: r[2])
    stream = stateful.level_tests(fed(spark, [rows[:30], rows[30:300], rows[300:]], TICKS, str(tmp_path / "in")), levels, 0.05)
    assert {(r["symbol"], r["seq"]): [r["change10"], r["volume_ratio"]] for r in drained(stream, "thresholds").collect()} == want
    assert {r["trend"] for r in monitor.level_tests(df, levels, 0.05).where("seq = 49").collect()} == {"STRONG_UP"}


def test_silent_symbols_are_forgotten(spark, tmp_path, rocks):
    one = [("a", 1000 * (i + 1), i, 99.0, 1.0, 0.0) for i in range(12)]
    two = [("b", 500_000, 1, 50.0, 1.0, 0.0)]
    three = [("a", 600_000 + i, 100 + i, 99.0, 1.0, 0.0) for i in range(2)]
    stream = fed(spark, [one, two, two, three], TICKS, str(tmp_path / "in"))
    got = {r["seq"]: r["n"] for r in drained(stateful.level_tests(stream, spark.createDataFrame(LEVEL_ROWS, LEVELS), silence_ms=60_000), "forgotten").collect() if r["symbol"] == "a"}
    assert got[11] == 12 and got[100] == 1 and got[101] == 2


def messages(seed=4, n=160):
    """Snapshots, deltas, lost ones, repeats and ones out of order."""
    rng = np.random.default_rng(seed)
    updates, lines = [], []
    for book in ("x", "y"):
        sent, number = [], 0
        for i in range(n):
            kind = "snapshot" if rng.random() < 0.05 or i == 5 else "delta"
            width = int(rng.integers(1, 4))
            own = [(("bid", "ask")[int(rng.integers(2))], float(rng.integers(95, 105)), float(rng.integers(0, 4)), k) for k in range(rng.integers(0, 4))]
            sent.append((kind, number + 1, number + width, own))
            number += width
        order = []
        for i, message in enumerate(sent):
            if rng.random() < 0.06:
                continue
            order.append(message)
            if rng.random() < 0.1:
                order.append(sent[int(rng.integers(max(0, i - 5), i + 1))])
        for arrival, (kind, a, b, own) in enumerate(order):
            updates.append((book, arrival, kind, a, b))
            lines += [(book, arrival, *x) for x in own]
    return updates, lines


def books_brute(updates, lines):
    out = {}
    for book in ("x", "y"):
        last, stale, segment, sides = None, True, 0, {"bid": {}, "ask": {}}
        for _, arrival, kind, a, b in sorted(u for u in updates if u[0] == book):
            if last is not None and b <= last:
                continue
            if kind == "snapshot":
                stale, segment, sides = False, segment + 1, {"bid": {}, "ask": {}}
            elif last is None or a > last + 1:
                stale = True
            last = b
            if not stale:
                for _, _, side, price, qty, _ in sorted((x for x in lines if x[:2] == (book, arrival)), key=lambda x: x[5]):
                    sides[side][price] = qty
            bid, ask = ({p: q for p, q in sides[s].items() if q > 0} for s in ("bid", "ask"))
            known = (max(bid, default=None), min(ask, default=None), len(bid), len(ask), sum(bid.values()), sum(ask.values()))
            out[book, arrival] = (b, segment, stale, *((None,) * 6 if stale else known))
    return out


NAMES = ["last_id", "segment", "stale", "best_bid", "best_ask", "bid_levels", "ask_levels", "bid_qty", "ask_qty"]


def plain(rows):
    return {(r["book"], r["arrival"]): tuple(None if r[c] is None or r[c] != r[c] else r[c] for c in NAMES) for r in rows}


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_books_equal_a_plain_fold(spark, chunk):
    updates, lines = messages()
    got = booksync.replayed(spark.createDataFrame(updates, UPDATES).repartition(5), spark.createDataFrame(lines, LINES).repartition(5), chunk)
    want = books_brute(updates, lines)
    assert plain(got.collect()) == want and any(v[2] for v in want.values()) and sum(not v[2] for v in want.values()) > 50


def test_books_of_a_stream(spark, tmp_path, rocks):
    updates, lines = messages(9)
    rows = [(*u, *(x[2:] if x else (None, None, None, 0))) for u in updates for x in [x for x in lines if x[:2] == u[:2]] or [None]]
    rows.sort(key=lambda r: r[1])
    # All lines of an update are in one part.
    parts = [[r for r in rows if a <= r[1] < b] for a, b in ((0, 20), (20, 21), (21, 90), (90, 10_000))]
    schema = UPDATES + ", side string, price double, qty double, line int"
    got = drained(stateful.replayed(fed(spark, parts, schema, str(tmp_path / "in"))), "books")
    assert plain(got.collect()) == books_brute(updates, lines)


def test_book_replay_has_every_accepted_update(spark):
    updates, lines = messages(1, 30)
    df = spark.createDataFrame(updates, UPDATES)
    nulls = df.union(df.limit(1).withColumn("last_id", F.lit(None).cast("bigint")).withColumn("arrival", F.lit(10_000).cast("bigint")))
    assert booksync.accepted(nulls).count() == len(books_brute(updates, lines))
    assert booksync.replayed(df.limit(0), spark.createDataFrame(lines, LINES)).collect() == []


def test_adaptive_minimum_of_a_stream(spark, tmp_path, rocks):
    rng = np.random.default_rng(6)
    schema = "symbol string, window_end bigint, n bigint"
    rows = [(s, i, int(n)) for s in "ab" for i, n in enumerate(np.concatenate([rng.integers(60, 90, 15), rng.integers(1, 9, 40)]))]
    rows.sort(key=lambda r: r[1])
    setup = adaptive.Threshold(initial=60, rate=0.5)
    stream = fed(spark, [rows[:10], rows[10:51], rows[51:]], schema, str(tmp_path / "in"))
    got = sorted(map(tuple, drained(stateful.adaptive_minimum(stream, setup), "minimum").collect()))
    assert got == sorted(map(tuple, adaptive.adaptive_minimum(spark.createDataFrame(rows, schema), setup).collect())) and len(got) == len(rows)
