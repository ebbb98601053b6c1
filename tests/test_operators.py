"""Order-dependent operators against plain Python, edge cases, sources and sinks."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tapeflow.functions import scalars
from tapeflow.operators import bars, clean, flow, indicators, joins, levels, models, profile, repair, reports, running, scores
from tapeflow.plans import analysis
from tapeflow.sources import sinks, tables

TRADES = "symbol string, p double, q double, t bigint, m boolean, seq bigint"


def trades(spark, n=300, seed=1, day=5_000_000):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.integers(1, 40 * day, n))
    data = [(f"s{i % 3}", float(p), float(q), int(x), None, i) for i, (p, q, x) in enumerate(zip(rng.integers(1, 9, n), rng.integers(1, 5, n), t, strict=True))]
    return spark.createDataFrame(data, TRADES), pd.DataFrame(data, columns=["symbol", "p", "q", "t", "m", "seq"])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], TRADES)
    assert clean.infer_side(empty).count() == 0
    assert bars.ohlcv(empty, 1000).count() == 0
    assert bars.anchored_bars(empty, 1000).count() == 0
    assert profile.point_of_control(profile.binned_profile(empty, 1000)).count() == 0


def test_side_carries_over_buckets(spark):
    df, pdf = trades(spark)
    got = {r["seq"]: r["m"] for r in clean.infer_side(df).collect()}
    for _, g in pdf.groupby("symbol"):
        last, before = False, None
        for r in g.sort_values(["t", "seq"]).itertuples():
            if before is not None and r.p != before:
                last = r.p < before
            before = r.p
            assert got[r.seq] == last


def test_running_sum_in_buckets(spark):
    df, pdf = trades(spark)
    out = running.running_sum(df, bars.exact(df["q"]), "s", ["symbol"], ["t", "seq"], 7_000_000).collect()
    want = pdf.sort_values(["t", "seq"]).groupby("symbol")["q"].cumsum()
    assert {r["seq"]: float(r["s"]) for r in out} == {int(pdf.loc[i, "seq"]): v for i, v in want.items()}


def test_explicit_side_wins_and_rejects(spark):
    data = [("a", 1.0, 1.0, 1, True, 0), ("a", 2.0, 1.0, 2, True, 1), ("a", 2.0, 0.0, 3, None, 2), ("a", None, 1.0, 4, None, 3), ("a", float("nan"), 1.0, 5, None, 4)]
    df = spark.createDataFrame(data, TRADES)
    assert [r["reason"] for r in clean.reject_reason(df).orderBy("seq").collect()] == [None, None, "invalid_q_value", "missing_p", "invalid_p_value"]
    assert [r["m"] for r in clean.infer_side(clean.valid_trades(df.where("seq < 3"))).orderBy("seq").collect()] == [True, True]


def test_anchored_bars(spark):
    df = spark.createDataFrame([("a", float(i), 1.0, t, False, i) for i, t in enumerate([0, 10, 70, 80, 200, 210])], TRADES)
    got = [(r["open_t"], r["n"]) for r in bars.anchored_bars(df, 60).orderBy("open_t").collect()]
    assert got == [(0, 2), (80, 1), (210, 1)]


def bars_brute(rows, width):
    out, start = {}, None
    for _, _, _, t, _, _ in rows:
        start = t if start is None else start
        if t - start >= width:
            start = None
        else:
            out[start] = out.get(start, 0) + 1
    return out


def bursts_brute(rows, width, threshold, ratio, cooldown):
    out, start, ended, held = [], None, None, []
    for _, _, q, t, _, _ in rows:
        held = [(a, b) for a, b in [*held, (t, q)] if t - a < width]
        volume = sum(b for _, b in held)
        if start is None and volume >= threshold and (ended is None or t - ended >= cooldown):
            start, peak = t, volume
        elif start is not None:
            peak = max(peak, volume)
            if volume < threshold * ratio:
                out.append((start, t, peak))
                start, ended = None, t
    return out


def test_folds_run_on_over_chunks(spark):
    rng = np.random.default_rng(11)
    for gap in (3, 40):
        times = np.cumsum(rng.integers(0, gap, 400))
        rows = [("a", 1.0, float(rng.integers(1, 6)), int(t), False, i) for i, t in enumerate(times)]
        df = spark.createDataFrame(rows + [("b", *r[1:]) for r in rows[50:]], TRADES)
        for chunk in (25, 170, 10**9):
            got = {r["open_t"]: r["n"] for r in bars.anchored_bars(df, 60, chunk).where("symbol = 'a'").collect()}
            assert got == bars_brute(rows, 60), chunk
            for cooldown in (0, 90):
                found = flow.bursts(df, 30, 12.0, 0.5, cooldown, chunk)
                for symbol, own in (("a", rows), ("b", rows[50:])):
                    got = sorted((r["start_t"], r["end_t"], r["peak"]) for r in found.where(f"symbol = '{symbol}'").collect())
                    assert got == bursts_brute(own, 30, 12.0, 0.5, cooldown), (chunk, cooldown)


def test_joins_in_time(spark):
    rng = np.random.default_rng(12)
    ticks = [("a", float(rng.integers(0, 9)), 1.0, int(t), False, i) for i, t in enumerate(np.sort(rng.integers(0, 4000, 300)))]
    signals = [(i, "a", int(t), float(p)) for i, (t, p) in enumerate(zip(rng.integers(-50, 4100, 120), rng.integers(0, 5, 120), strict=True))]
    signals.append((998, "none", 5, 1.0))
    left = spark.createDataFrame(signals, "id long, symbol string, t long, price double")
    table = spark.createDataFrame(ticks, TRADES)
    right = table.selectExpr("symbol", "t AS rt", "seq AS rid", "p AS value")
    for bucket in (100, 10**7):
        for r in joins.asof_nearest(left, right, 20, bucket_ms=bucket).collect():
            near = min(((abs(x[3] - r["t"]), x[3], x[5]) for x in ticks if r["symbol"] == "a" and abs(x[3] - r["t"]) <= 20), default=(None, None, None))
            assert (r["rt"], r["rid"]) == near[1:]
    hour = 3_600_000
    due = left.withColumn("t", F.col("t") - hour)
    got = {r["id"]: r["later"] for r in joins.horizons(due, table, (1,), 0.1, span_ms=15, bucket_ms=100).collect()}
    want = {i: min(((x[3], x[5], x[1]) for x in ticks if s == "a" and t <= x[3] <= t + 15), default=(0, 0, None))[2] for i, s, t, _ in signals}
    assert got == want
    for horizon, grains in ((700, 32), (37, 32), (500, 7), (1, 4)):
        for r in joins.price_path(left, table, horizon, grains).collect():
            _, symbol, t, price = next(s for s in signals if s[0] == r["id"])
            path = [x[1] for x in ticks if symbol == "a" and t < x[3] <= t + horizon]
            assert r["ticks"] == len(path)
            if path and price:
                assert (r["mfe"], r["mae"]) == (max(path) / price - 1, min(path) / price - 1)
            else:
                assert r["mfe"] is None and r["mae"] is None


def test_late_and_zones(spark):
    rng = np.random.default_rng(13)
    rows = [("a", float(rng.integers(1, 200)), 1.0, int(rng.integers(0, 900)), False, i) for i in range(300)]
    df = spark.createDataFrame(rows, TRADES)
    top, want = -1, {}
    for r in rows:
        top = max(top, r[3])
        want[r[5]] = top
    assert {r["seq"]: r["t"] for r in clean.clamp_late(df, bucket=17).collect()} == want
    zones = spark.createDataFrame([("a", 1, 10.0, 40.0), ("a", 2, 35.0, 36.0), ("a", 3, -5.0, 2.0)], "symbol string, zone int, low double, high double")
    want = set()
    for zone, low, high in ((1, 10, 40), (2, 35, 36), (3, -5, 2)):
        last = None
        for r in sorted(rows, key=lambda r: (r[3], r[5])):
            if low <= r[1] <= high:
                if last is None or r[3] - last >= 20:
                    want.add((zone, r[5]))
                last = r[3]
    assert {(r["zone"], r["seq"]) for r in levels.zone_touches(zones, df, 20).collect()} == want


def test_value_area_ties(spark):
    df = spark.createDataFrame([("a", 1, b, float(b), v) for b, v in enumerate([1.0, 5.0, 9.0, 5.0, 1.0])], "symbol string, window_end bigint, bin bigint, price double, volume double")
    up = profile.value_area_expand(df, 0.6).first()
    down = profile.value_area_expand(df, 0.6, tie_up=False).first()
    assert (up["val"], up["vah"]) == (2.0, 3.0) and (down["val"], down["vah"]) == (1.0, 2.0)


def test_bursts(spark):
    df = spark.createDataFrame([("a", 1.0, q, t, False, i) for i, (t, q) in enumerate([(0, 6.0), (50, 6.0), (400, 1.0), (1000, 1.0)])], TRADES)
    assert [(r["start_t"], r["end_t"]) for r in flow.bursts(df, 200, 10.0, 0.5, 200).collect()] == [(50, 400)]


def test_chained_rules(spark):
    df = spark.createDataFrame([("a", p) for p in (100.0, 100.9, 101.4, 101.7)], "symbol string, price double")
    assert sorted(r["n"] for r in levels.chained(df, 0.01, "anchor").collect()) == [2, 2]
    assert sorted(r["n"] for r in levels.chained(df, 0.01, "mean").collect()) == [4]


def candles(spark, closes):
    rows = [("a", i * 86_400_000, c, c + 1, c - 1, c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts bigint, open double, high double, low double, close double, volume double")


def test_recursive_indicators(spark):
    x = pd.Series(np.random.default_rng(2).normal(100, 5, 60).round(2))
    got = indicators.smoothed(candles(spark, x.tolist())).toPandas().sort_values("ts")
    want = x.ewm(span=12, adjust=False).mean() - x.ewm(span=26, adjust=False).mean()
    assert np.allclose(got["macd"], want)
    assert np.allclose(got["ema_21"], x.ewm(span=21, adjust=False).mean())


def test_patterns(spark):
    rows = [("a", 1, 10.0, 10.5, 8.0, 9.0, 1.0), ("a", 2, 8.5, 12.0, 8.0, 11.0, 1.0), ("a", 3, 10.0, 11.0, 9.0, 10.05, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, ts bigint, open double, high double, low double, close double, volume double")
    got = [r["patterns"] for r in indicators.patterns(df).orderBy("ts").collect()]
    assert "bullish_engulfing" in got[1] and "doji" in got[2]


def test_kalman_and_monte_carlo(spark):
    df = candles(spark, [100.0, 101.0, 99.0, 102.0])
    levels_ = [r["level"] for r in models.kalman(df).orderBy("ts").collect()]
    assert levels_[0] == 100.0 and 100 < levels_[1] < 101
    a, b = (models.monte_carlo(df, 5, 100).first() for _ in range(2))
    assert a == b and a["p5"] <= a["p50"] <= a["p95"]


def test_backtest_prefers_stop(spark):
    df = candles(spark, [100.0, 100.0, 100.0]).withColumn("high", indicators.F.lit(120.0)).withColumn("low", indicators.F.lit(80.0))
    out = joins.backtest(df, df.limit(1), 0.1, 0.1, 2).first()
    assert out["reason"] == "stop" and abs(out["profit"] + 0.1008) < 1e-9


def test_scalars(spark):
    df = spark.createDataFrame([("$1,234.5",), ("1.2K",), ("-3M",), ("5%",), ("N/A",), (None,)], "x string")
    assert [r[0] for r in df.select(scalars.parse_number(df["x"])).collect()] == [1234.5, 1200.0, -3e6, 5.0, None, None]
    df = spark.createDataFrame([("1700000000",), ("1700000000123",), ("2023-11-14T22:13:20Z",), ("x",)], "x string")
    assert [r[0] for r in df.select(scalars.to_epoch_ms(df["x"])).collect()] == [1700000000000, 1700000000123, 1700000000000, None]
    df = spark.createDataFrame([("key api_key=abc123 mail a@b.co card 4111111111111111",), ("cafÃ©",)], "x string")
    assert df.select(scalars.redact(df["x"])).first()[0] == "key api_key=*** mail <email> card <number>"
    assert df.select(scalars.repair_mojibake(df["x"])).collect()[1][0] == "café"


def test_sources_and_sinks(spark, tmp_path):
    feed = tmp_path / "feed.jsonl"
    feed.write_text('{"s":"x","p":"1.5","q":"2","T":5,"m":"sell"}\n{"symbol":"x","price":2,"quantity":1,"E":6,"side":"BUY"}\nbroken\n{"p":0,"q":1,"T":7}\n')
    got = tables.read_trade_json(spark, str(feed)).orderBy("t").collect()
    assert [(r["symbol"], r["p"], r["t"], r["m"]) for r in got] == [("x", 1.5, 5, True), ("x", 2.0, 6, False)]
    kline = spark.createDataFrame([(["1", "2", "3", "1", "2.5", "9", "0", "0", "4", "0", "0", "0"],)], "kline array<string>")
    assert tables.decode_klines(kline).first()["num_trades"] == 4
    nested = spark.createDataFrame([(86_400_000, {"a": 1.0, "b": [1, 2]}, float("inf"))], "ts bigint, x struct<a: double, b: array<int>>, y double")
    sinks.write_features(nested, str(tmp_path / "f"))
    row = sinks.read_features(spark, str(tmp_path / "f")).first()
    assert row["x.a"] == 1.0 and row["x.b"] == "[1,2]" and row["y"] is None and str(row["date"]) == "1970-01-02"
    events = spark.createDataFrame([(i, "e", "s", i % 2 == 0) for i in range(5)], "timestamp_ms bigint, event_type string, symbol string, is_signal boolean")
    sinks.write_events(events, str(tmp_path / "e"))
    assert [r["timestamp_ms"] for r in sinks.recent_events(spark, str(tmp_path / "e"), 2, signals_only=True).collect()] == [2, 4]
    sinks.write_signals(spark.createDataFrame([("x", 1.0)], "symbol string, price double"), str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).columns == sinks.SIGNAL_COLUMNS


def similar_brute(ids, x, query, k, measure):
    s = x @ x[query] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[query]) if measure == "cosine" else -np.linalg.norm(x - x[query], axis=1)
    order = [i for i in np.lexsort((ids, -s.round(9))) if ids[i] != ids[query]][:k]
    return [(int(ids[i]), round(float(s[i]), 6)) for i in order]


def test_similar_searches_all_due_queries(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 8))
    x[300:420] = x[300]  # a hot vector; a query among its copies
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    odd = spark.createDataFrame([(1000, None), (1100, [1.0, None] + [1.0] * 6), (None, [1.0] * 8), (1200, [float("nan")] * 8)], df.schema)
    df.unionByName(odd).write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(scores, "QUERY_BYTES", 200)
    monkeypatch.setattr(scores, "PAIRS", 500)
    for query, measure in ((analysis.sim_cosine_search, "cosine"), (analysis.sim_euclid_search, "euclid")):
        got = {}
        for r in query(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 6)))
        assert got.keys() == {0, 100, 200, 300, 400, 500, 600}
        for i, found in got.items():
            want = similar_brute(np.arange(700), x, i, 5, measure)
            assert [v for v, _ in found] == [v for v, _ in want]
            assert np.allclose([s for _, s in found], [s for _, s in want], atol=2e-6)


def test_local_extrema(spark):
    x = [10.0, 10.0, 10.0, 14.0, 10.0, 10.0, 10.0, 10.0, 10.0, 6.0, 10.0, 10.0, 10.0, 10.0, 14.1, 10.0, 10.0, 10.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)] + [("b", i, 1.0) for i in range(5)], "symbol string, ts bigint, close double")
    got = sorted((r["symbol"], r["kind"], r["ts"], r["price"]) for r in reports.local_extrema(df).collect())
    assert got == [("a", "high", 3, 14.0), ("a", "high", 14, 14.1), ("a", "low", 9, 6.0)]
    near = [10.0] * 4 + [14.0, 10.0, 10.0, 15.0] + [10.0] * 5
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(near)], "symbol string, ts bigint, close double")
    assert [r["ts"] for r in reports.local_extrema(df).where("kind = 'high'").collect()] == [7]


def test_ranked_levels(spark):
    df = spark.createDataFrame([("a", 99.0, 5.0), ("a", 98.5, 9.0), ("a", 90.0, 1.0), ("a", 103.0, 2.0), ("a", 105.0, 2.0)], "symbol string, price double, score double")
    last = spark.createDataFrame([("a", 100.0)], "symbol string, last double")
    got = sorted((r["side"], r["rank"], r["price"]) for r in reports.ranked_levels(df, last).collect())
    assert got == [("resistance", 1, 103.0), ("resistance", 2, 105.0), ("support", 1, 98.5), ("support", 2, 90.0)]
    assert reports.ranked_levels(df, last, k=1).count() == 2


def test_icebergs(spark):
    def rows(side, quantities):
        return [(side, 1, n, float(q)) for n, q in enumerate(quantities) if q]

    df = spark.createDataFrame(rows("bid", [10, 1, 10, 2, 9, 9]) + rows("ask", [10, 1, 3, 3, 3, 3]) + [("end", 0, 5, 1.0)], "side string, bucket bigint, n bigint, qty double")
    # 10 is eaten to 1; 1 grows to 10, about the quantity before; eaten and refilled once more.
    got = [(r["side"], r["first_n"], r["last_n"], r["refills"], round(r["mean_qty"], 3), r["confidence"]) for r in reports.icebergs(df).collect()]
    assert got == [("bid", 1, 5, 2, 9.6, 0.5)]


def test_rounded_by_name(spark):
    df = spark.createDataFrame([(1.23456789, (2.3456, float("nan")), [1.23456, float("inf")])], "price double, part struct<ratio double, other double>, prices_percent array<double>")
    r = repair.rounded_by_name(df).first()
    assert r["price"] == 1.2346 and r["part"]["ratio"] == 2.3456 and r["part"]["other"] is None and r["prices_percent"] == [1.23, None]


def test_checked_frame(spark):
    import pytest

    df = spark.createDataFrame([(1.0, None), (0.0, 2.0)], "a double, b double")
    r = repair.checked_frame(df, ["a", "b"], 1, ["a"]).first()
    assert (r["n"], r["nulls"], r["not_positive"], r["sound"]) == (2, 1, 1, False)
    with pytest.raises(ValueError):
        repair.checked_frame(df, ["c"])
