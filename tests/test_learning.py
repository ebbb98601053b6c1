"""Models, labels across runs, adaptive thresholds, scans, compaction and replay against plain Python."""

import json
import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeflow.functions import scalars
from tapeflow.operators import adaptive, backfill, compaction, inference, models, reports, running
from tapeflow.operators import indicators as ind
from tapeflow.plans import learning
from tapeflow.sources import replay
from tapeflow.sources.tables import candles_from_orders

DAY = 86_400_000


def candles(spark, n=400, seed=1, symbols=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i, c in enumerate(close):
            rows.append((s, i * 9 * DAY, float(c * 0.99), float(c * 1.02), float(c * 0.97), float(c), float(1 + i % 5)))
    return spark.createDataFrame(rows, "symbol string, ts bigint, open double, high double, low double, close double, volume double").repartition(5)


def by_symbol(df):
    pdf = df.toPandas().sort_values(["symbol", "ts"])
    return dict(tuple(pdf.groupby("symbol")))


def test_affine_equals_a_loop(spark):
    rng = np.random.default_rng(0)
    rows = [(s, t, float(rng.uniform(-1, 1)), None if t % 7 == 3 else float(rng.normal())) for s in "ab" for t in range(300)]
    df = spark.createDataFrame(rows, "symbol string, ts bigint, a double, b double")
    for bucket in (1, 17, 1000):
        got = by_symbol(running.affine(df, {"y": (F.col("a"), F.col("b"))}, ["symbol"], ["ts"], bucket))
        for s, pdf in got.items():
            y = 0.0
            for (_, _, a, b), value in zip([r for r in rows if r[0] == s], pdf["y"], strict=True):
                y = y if b is None else a * y + b
                assert value == pytest.approx(y, rel=1e-9, abs=1e-12)


def test_recursive_indicators_equal_pandas(spark):
    df = candles(spark)
    of = by_symbol(df)
    got = by_symbol(ind.smoothed(df))
    forecast, garch, kalman = (by_symbol(f(df)) for f in (ind.volatility_forecast, models.garch, models.kalman))
    for s, pdf in of.items():
        c, d = pdf["close"].reset_index(drop=True), pdf["close"].diff().reset_index(drop=True)
        ewm = lambda x, w, least=1: x.ewm(alpha=w, adjust=False, min_periods=least).mean()
        gain, loss = ewm(d.clip(lower=0), 1 / 14, 14), ewm((-d).clip(lower=0), 1 / 14, 14)
        before = c.shift()
        high, low = pdf["high"].reset_index(drop=True), pdf["low"].reset_index(drop=True)
        tr = pd.concat([high - low, (high - before).abs(), (low - before).abs()], axis=1).max(axis=1)
        macd = ewm(c, 2 / 13) - ewm(c, 2 / 27)
        want = {"rsi_wilder": 100 - 100 / (1 + gain / loss), "macd": macd, "macd_signal": ewm(macd, 0.2), "ema_21": ewm(c, 2 / 22), "atr_ewm": ewm(tr, 2 / 15, 14)}
        for name, x in want.items():
            np.testing.assert_allclose(got[s][name].to_numpy(float), x.to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=name)
        r = c.pct_change().dropna()
        np.testing.assert_allclose(forecast[s]["ewma"].to_numpy(float), r.ewm(span=30).std().to_numpy(), rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose(forecast[s]["historical"].to_numpy(float), r.expanding().std().to_numpy(), rtol=1e-9, atol=1e-12)
        log = np.log(c / before).dropna().to_numpy()
        v = [log[0] ** 2]
        for x in log[:-1]:
            v.append(1e-6 + 0.1 * x * x + 0.85 * v[-1])
        np.testing.assert_allclose(garch[s]["variance"], v, rtol=1e-9)
        x, p, level = None, 1.0, []
        for z in c:
            if x is None:
                x = z
            else:
                p += 0.01
                k = p / (p + 1)
                x, p = x + k * (z - x), (1 - k) * p
            level.append(x)
        np.testing.assert_allclose(kalman[s]["level"], level, rtol=1e-9)


def test_backfill_runs_equal_one_run(spark, tmp_path):
    df = candles(spark, 120).select("symbol", "ts", "close")
    df = df.withColumn("close", F.when(F.col("ts") == 30 * 9 * DAY, 0.0).otherwise(F.col("close")))
    one, more = backfill.Backfill(str(tmp_path / "one"), 10), backfill.Backfill(str(tmp_path / "more"), 10)
    one.run(df, 0)
    cut = [0, 3, 50, 51, 90, 500]
    for k, (a, b) in enumerate(zip(cut, cut[1:])):
        part = df.where((F.col("ts") >= a * 9 * DAY) & (F.col("ts") < b * 9 * DAY))
        late = df.where(F.col("ts") < (a - 30) * 9 * DAY)  # rows that were there already
        for _ in range(2 if k in (1, 3) else 1):  # a repeated run adds nothing
            more.run(part.union(late).union(part), k)
    got, want = (sorted(map(tuple, t.collect())) for t in (more.labelled(spark, 5), one.labelled(spark, 1)))
    assert got == want and len(got) == 2 * 110
    closes = by_symbol(df)["a"]["close"].tolist()
    for s, ts, close, label in want:
        i = ts // (9 * DAY)
        if s == "a":
            change = closes[i + 10] / close - 1 if close > 0 and closes[i + 10] > 0 else None
            assert label == (None if change is None else 1 if change > 0.002 else -1 if change < -0.002 else 0)
    stats = more.stats(spark, 5).first()
    assert stats["total"] == sum(x[3] is not None for x in want) and not stats["ready"]


def test_backfill_of_a_stream(spark, tmp_path):
    df = candles(spark, 60).select("symbol", "ts", "close").coalesce(1)
    for a, b in ((0, 20), (20, 45), (45, 60)):
        df.where((F.col("ts") >= a * 9 * DAY) & (F.col("ts") < b * 9 * DAY)).write.mode("append").parquet(str(tmp_path / "in"))
    jobs = backfill.Backfill(str(tmp_path / "out"), 10)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.follow(stream, str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    runs = query.lastProgress["batchId"] + 1
    one = backfill.Backfill(str(tmp_path / "one"), 10)
    one.run(df, 0)
    assert sorted(map(tuple, jobs.labelled(spark, runs).collect())) == sorted(map(tuple, one.labelled(spark, 1).collect()))


def test_adaptive_minimum_equals_a_loop(spark):
    rng = np.random.default_rng(5)
    counts = [int(x) for x in np.concatenate([rng.integers(60, 90, 30), rng.integers(1, 9, 60), rng.integers(0, 4, 40)])]
    setup = adaptive.Threshold(initial=60, rate=0.5)
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate(counts)] + [("b", 1, None)], "symbol string, window_end bigint, n bigint").repartition(3)
    got = sorted(map(tuple, adaptive.adaptive_minimum(df, setup).collect()))
    now, seen = 60, []
    for i, n in enumerate(counts):
        before, seen = now, (seen + [n])[-20:]
        why = "no_adjustment_needed"
        if len(seen) >= 10 and sum(x < now for x in seen) / len(seen) > 0.7:
            step = int((max(3, min(int(int(statistics.median(seen)) * 0.9), 50)) - now) * 0.5)
            now, why = now + step, "adjusted" if step else "no_change"
        assert got[i] == ("a", i, n, before, n >= before, now, why)
    assert len(got) == len(counts) and {g[6] for g in got} == {"adjusted", "no_change", "no_adjustment_needed"}
    # The same in two parts, from the state between them.
    first, now, seen = setup.follow(counts[:70], setup.initial, [])
    assert first + setup.follow(counts[70:], now, seen)[0] == [g[3:] for g in got]


def test_models_are_saved_and_loaded(spark, tmp_path):
    rows = inference.labelled(inference.resolved(inference.history_features(candles(spark, 150)))).cache()
    known = rows.where("label IS NOT NULL").withColumn("_later", F.col("ts") > 110 * 9 * DAY)
    root = str(tmp_path / "models")
    first, second = inference.fitted(known, rounds=1), inference.fitted(known, rounds=6, tolerance=0.0)
    inference.save(first, root, 1)
    inference.save(second, root, 2)
    score = lambda m: {(r["symbol"], r["ts"]): r["prob_up"] for r in inference.scores(m, rows).collect()}
    for version, model in ((1, first), (2, second), (None, second)):
        loaded, features = inference.load(spark, root, version)
        assert features == inference.FEATURES and score(loaded) == score(model)
    assert score(first) != score(second)
    with pytest.raises(ValueError, match="no version 3"):
        inference.load(spark, root, 3)
    out = inference.with_readiness(inference.scores(first, rows)).collect()
    assert len(out) == 300 and all(r["prob_up"] + r["prob_down"] == pytest.approx(1) and r["confidence"] == pytest.approx(abs(r["prob_up"] - 0.5) * 2) for r in out)
    assert all(r["signal"] == ("bullish" if r["prob_up"] > 0.6 else "bearish" if r["prob_up"] < 0.4 else "neutral") for r in out)
    assert {r["warm"] for r in out if r["history"] < 20} == {False} and all(r["warm"] for r in out if r["history"] >= 20)
    # The same scores on a stream of records that carry their features.
    given = rows.select("symbol", "ts", *(F.col(f"f_{n}").alias(n) for n in inference.FEATURES))
    given.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(given.schema).parquet(str(tmp_path / "in"))
    inference.scores(first, inference.resolved(stream)).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start().awaitTermination()
    batch = {(r["symbol"], r["ts"]): r["prob_up"] for r in inference.scores(first, inference.resolved(given)).collect()}
    assert {(r["symbol"], r["ts"]): r["prob_up"] for r in spark.table("scored").collect()} == batch


def test_features_by_alias(spark):
    rows = spark.createDataFrame(
        [(1, 0.0, "x", ((105.0,),), 7.0), (2, 0.5, "61", ((200.0,),), None), (3, None, None, None, 0.0)],
        "id int, return_1 double, rsi string, multi_tf struct<`1h`: struct<rsi_short: double>>, `technical.bb_upper` double",
    )
    got = {r["id"]: r for r in inference.resolved(rows).collect()}
    assert [got[i]["f_return_1"] for i in (1, 2, 3)] == [0.0, 0.5, 0.0]
    assert [got[i]["f_rsi"] for i in (1, 2, 3)] == [50.0, 61.0, 50.0]  # 105 is replaced; no plausible one is there
    assert [got[i]["f_bb_upper"] for i in (1, 2, 3)] == [7.0, None, None]
    assert [(got[i]["n_external"], got[i]["n_default"]) for i in (1, 2, 3)] == [(3, 6), (2, 7), (0, 9)]


def test_time_folds_know_only_the_past(spark):
    rows = inference.labelled(inference.resolved(inference.history_features(candles(spark, 150))))
    model, quality = inference.time_folds(rows, folds=3, rounds=3)
    found = {r["fold"]: r for r in quality.collect()}
    assert sorted(found) == [1, 2, 3] and model is not None
    assert sum(r["rows"] for r in found.values()) == pytest.approx(0.75 * 2 * 135, abs=6)
    for r in found.values():
        assert 0 <= r["brier"] <= 1 and r["hits"] <= min(r["called"], r["ups"]) and r["precision"] == (r["hits"] / r["called"] if r["called"] else None)
    assert inference.time_folds(rows.limit(0))[0] is None


def test_json_objects_at_any_depth(spark):
    deep = '{"a":[{"b":{"c":[{"d":{"e":{"f":{"g":{"h":{"i":1}}}}}}]}}]}'
    texts = {
        deep: deep, f"it's {deep} then": deep, 'x {"a": "}{"} {"b": 1}': '{"a": "}{"}', '{"a": {"b": 1}, {"c": 2': '{"b": 1}', '{"a': None, "none": None, "": None,
        '{"a": "say \\"{\\" now"}': '{"a": "say \\"{\\" now"}', '{ "open {"k": 1}': '{"k": 1}', "} {}": "{}", "{" * 2000: None, '"' * 2000 + "{}": "{}",
    }
    df = spark.createDataFrame([(k,) for k in texts] + [(None,)], "t string")
    got = {r["t"]: (r["o"], r["cut"]) for r in df.select("t", scalars.json_object(F.col("t")).alias("o"), scalars.json_truncated(F.col("t")).alias("cut")).collect()}
    for text, want in texts.items():
        assert got[text] == (want, "{" in text and want is None), text
    assert got[None][0] is None


def test_extrema_equal_a_plain_search(spark):
    rng = np.random.default_rng(8)
    close = np.round(100 + np.cumsum(rng.normal(0, 1, 600)), 1)
    df = spark.createDataFrame([("a", i, float(c)) for i, c in enumerate(close)], "symbol string, ts bigint, close double")
    got = {(r["kind"], r["ts"]) for r in reports.local_extrema(df).collect()}
    smooth = pd.Series(close).ewm(span=5).mean().to_numpy()
    least, want = max(np.median(np.abs(np.diff(smooth))), close[-1] * 0.002), set()
    for kind, x in (("high", smooth), ("low", -smooth)):
        tops = [i for i in range(1, 599) if x[i - 1] < x[i] > x[i + 1]]
        gone = set()
        for i in sorted(tops, key=lambda i: (x[i], i), reverse=True):
            if i not in gone:
                gone |= {j for j in tops if j != i and abs(j - i) < 5}
        for i in tops:
            left = max((j for j in range(i) if x[j] > x[i]), default=-1)
            right = min((j for j in range(i + 1, 600) if x[j] > x[i]), default=600)
            if i not in gone and x[i] - max(min(x[left + 1 : i + 1]), min(x[i:right])) >= least:
                want.add((kind, i))
    assert got == want and len(want) > 20


def test_compaction_fits_the_budget():
    rng = np.random.default_rng(3)

    def value(depth):
        kind = rng.integers(0, 6 if depth else 3)
        if kind < 3:
            return [None, "é" * int(rng.integers(0, 40)), float(rng.integers(0, 99))][kind]
        if kind == 3:
            return [value(depth - 1) for _ in range(rng.integers(0, 12))]
        return {f"k{i}": value(depth - 1) for i in range(rng.integers(0, 8))}

    names = ["price_context", "flow_context", "macro_context", "historical_stats", "raw_event", "other", "technical_indicators"]
    for _ in range(60):
        record = {n: value(4) for n in names}
        for budget in (2, 50, 300, 2000):
            text = compaction.compacted(json.loads(json.dumps(record)), budget)
            assert len(text.encode()) <= budget and "raw_event" not in json.loads(text)
    small = {"price_context": {"a": 1}, "macro_context": {"b": 2}, "debug": 1}
    assert json.loads(compaction.compacted(dict(small), 6144)) == {"price_context": {"a": 1}, "macro_context": {"b": 2}}
    large = small | {"macro_context": {"b": "x" * 600}, "historical_stats": {"c": "y" * 100}}
    assert json.loads(compaction.compacted(dict(large), 200)) == {"price_context": {"a": 1}, "macro_context": {}, "historical_stats": {"c": "y" * 100}}
    assert compaction.compacted([1], 99) is None


def test_copies_of_fields(spark):
    record = {
        "volume_compra": 1, "raw_event": {"volume_compra": 1, "x": 2, "flow_metrics": {}}, "fluxo_continuo": {"time_index": 1, "liquidity_heatmap": {"clusters": [{"a": 1, "recent_ts_ms": 5}, {"recent_ts_ms": 6}]}},
        "institutional_analytics": {"sr_analysis": {"defense_zones": {"buy_defense": [], "strongest_buy": 1, "sell_defense": [1], "strongest_sell": 2}}},
    }
    texts = [json.dumps(record), "no json", None, "[1]", '{"a": 1}', '{"volume_compra":NaN}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r for r in compaction.deduplicated(df, "t").collect()}
    left = json.loads(got[0]["t"])
    assert left["raw_event"] == {"x": 2} and left["fluxo_continuo"] == {"liquidity_heatmap": {"clusters": [{"a": 1}, {}]}} and got[0]["removed"] == 6
    assert left["institutional_analytics"]["sr_analysis"]["defense_zones"] == {"buy_defense": [], "strongest_buy": 1, "sell_defense": [1]}
    assert [(got[i]["t"], got[i]["removed"]) for i in range(1, 6)] == [(t, 0) for t in texts[1:]]
    assert [r["x"] for r in df.select(compaction.within(F.col("t"), 20).alias("x")).collect()][1:5] == [None, None, None, '{"a":1}']


def test_replay_of_damaged_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"a": 1, "timestamp": "2024-01-01T00:00:00Z"}\nnothing\n{"a": 2, "timestamp"\n\n{"a": 1, "timestamp": "2024-01-01T00:00:00Z"}\n')
    (folder / "b.json").write_text('{"b": {"c": 3}, "epoch_ms": 1700000000}\n{"a" 5}\n')
    lines = replay.read_lines(spark, str(folder))
    good, bad = replay.parts(lines)
    assert {(r["file"], r["good"], r["damaged"]) for r in replay.counted(lines).collect()} == {("a.json", 2, 2), ("b.json", 1, 1)}
    assert sorted(r["reason"] for r in bad.collect()) == ["cut_off", "malformed", "no_object"] and set(good.columns) == {"a", "b", "timestamp", "epoch_ms"}
    assert sorted(r["_time"] for r in replay.ordered(good).collect()) == [1_700_000_000_000, 1_704_067_200_000]
    found = replay.gate(good, ("a", "side"), least=4).first()
    assert found["errors"] == ["missing: side", "no price", "too few rows"] and not found["valid"] and found["null_share"]["a"] == pytest.approx(1 / 3)
    assert found["warnings"] == ["null: a", "null: b", "null: epoch_ms", "null: timestamp"][-len(found["warnings"]) :]
    for _ in range(2):  # the second replay goes on where the first stopped: nothing is left
        stream = replay.follow_lines(spark, str(folder), good.schema)
        replay.replay(stream, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 3 and spark.read.parquet(str(tmp_path / "bad")).count() == 3


def test_ml_inference_scores_all_candles(spark, sf_dir):
    got = learning.ml_inference(spark, sf_dir)
    assert got.count() == candles_from_orders(spark, sf_dir).count() and all(0 <= r["prob_up"] <= 1 and not math.isnan(r["prob_up"]) for r in got.collect())
