"""Queries on tables that the given ones do not show: every row counts, empty runs included."""

import datetime
import json

import duckdb
import pytest

from tapeflow.operators import booksync, compaction
from tapeflow.plans import catalog
from tapeflow.sources import sinks
from test_queries import rows as plain


def test_runs_without_rows_keep_their_columns(spark, tmp_path):
    path = str(tmp_path / "f")
    df = spark.createDataFrame([("a", 1_700_000_000_000, 1.5, 3)], "symbol string, ts bigint, close double, n int")
    sinks.write_features(df.select("symbol", "ts", "close"), path)
    sinks.write_features(df.where("n > 5").select("symbol", "ts", "n"), path)
    got = sinks.read_features(spark, path)
    assert got.select("symbol", "ts", "close", "n").collect() == [("a", 1_700_000_000_000, 1.5, None)]
    assert [str(r["date"]) for r in got.select("date").collect()] == ["2023-11-14"]
    events = df.select(df.ts.alias("timestamp_ms"), df.symbol.alias("event_type"), "symbol", (df.n > 5).alias("is_signal"))
    sinks.write_events(events.limit(0), str(tmp_path / "e"))
    assert sinks.recent_events(spark, str(tmp_path / "e")).collect() == []
    sinks.write_events(events, str(tmp_path / "e"))
    assert sinks.recent_events(spark, str(tmp_path / "e")).count() == 1


def checked(spark, folder, names):
    """The named queries against their SQL on the tables of a folder."""
    c = duckdb.connect()
    for f in folder.iterdir():
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    for name in names:
        df = catalog.QUERIES[name](spark, str(folder))
        want = c.execute(catalog.ORACLE_SQL[name])
        columns = [x[0] for x in want.description]
        assert plain(df.columns, df.collect()) == plain(columns, want.fetchall()), name


SIDED = ["bars_flow_ratio", "bars_imbalance", "cvd_4h_reset", "cvd_running", "flow_buy_sell_ratio", "flow_participants", "flow_rolling_1_5_15", "flow_sectors", "footprint_imbalance", "footprint_levels"]


@pytest.mark.parametrize("name", SIDED)
def test_trades_at_price_0_count(spark, tmp_path, name):
    start = datetime.datetime(2024, 1, 1)
    prices = [5.0, 0.0, 0.0, 7.5, 7.5, 12.0, 0.0, 3.0]
    rows = [(i, start + datetime.timedelta(hours=2 * i), i, "ab"[i % 3 == 0], prices[i % 8], f'{{"k": {i % 7}}}') for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    df.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    checked(spark, tmp_path, [name])


# Queries on hours of the same step: what a missing trade changes shows in the hours after it too.
HOURLY = ["dynamic_delta_threshold", "exhaustion_signal", "flow_absorption_label"]


@pytest.mark.parametrize("name", HOURLY)
def test_trades_at_price_0_count_in_hours(spark, tmp_path, name):
    start = datetime.datetime(2024, 1, 1)
    prices = [5.0, 0.0, 0.0, 7.5, 7.5, 12.0, 0.0, 3.0]
    rows = [(i, start + datetime.timedelta(minutes=20 * i), i, "ab"[i % 5 == 0], prices[i % 8], f'{{"k": {99 if i % 17 == 0 else i * i % 7}}}') for i in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    df.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    checked(spark, tmp_path, [name])


def test_numbers_half_way_between_two_cents(spark, tmp_path):
    rows = [(3 * i + i % 2, 1000 * i + 605.0 + 10 * i) for i in range(300)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_totalprice double").toPandas().to_parquet(tmp_path / "orders.parquet")
    checked(spark, tmp_path, ["fn_parse_number"])


def test_books_of_a_task_are_folded_in_one_pass(spark):
    """Short segments share a chunk, and chunks share a pass: no call of Python for each segment."""
    updates = [("a", i, "snapshot" if i % 5 == 0 else "delta", i, i) for i in range(40) if i != 12]
    lines = [("a", i, "bid" if k else "ask", float(10 - 3 * k + i % 3), float(i % 4), k) for i in range(40) for k in (0, 1)]
    df = spark.createDataFrame(updates, "book string, arrival bigint, kind string, first_id bigint, last_id bigint")
    got = booksync.replayed(df, spark.createDataFrame(lines, "book string, arrival bigint, side string, price double, qty double, line int"), 3)
    plan = got._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan
    rows = {r["arrival"]: r for r in got.collect()}
    assert sorted(rows) == [i for i in range(40) if i != 12] and [i for i, r in rows.items() if r["stale"]] in ([13, 14], [14, 13])
    # A segment goes on over the borders of chunks: quantities at 35 to 39 stay until they are changed.
    assert (rows[39]["bid_levels"], rows[39]["bid_qty"]) == (3, 6.0) and rows[13]["bid_qty"] is None


def test_lists_of_a_record_are_measured_once(monkeypatch):
    """The bytes that are encoded to shrink a record: each list once, then only the tails that go."""
    calls, encoded = [], compaction.encoded
    monkeypatch.setattr(compaction, "encoded", lambda value: calls.append(1) or encoded(value))
    record = {f"k{i}": [[j, j + 1] for j in range(64)] for i in range(4)}
    whole = compaction.shrunk(json.loads(json.dumps(record)), 60)
    assert len(encoded(whole)) <= 60 and len(whole) == 4
    # 260 lists, at most 8 halvings of each outer and 1 of each inner list.
    assert len(calls) < 400


def test_records_have_no_copies_by_any_path():
    """Paths through what is no object, and a field that is both the copy and the original."""
    record = {"volume_compra": 1, "raw_event": {"raw_event": {"x": 1}, "volume_compra": [1]}, "contextual_snapshot": [1], "fluxo_continuo": {"time_index": 0, "liquidity_heatmap": {"clusters": {"a": 1}}}}
    assert compaction.without_copies(record) == 3 and record["raw_event"] == {} and record["fluxo_continuo"] == {"liquidity_heatmap": {"clusters": {"a": 1}}}


def test_signals_at_price_0_have_infinite_changes(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    prices = [5.0, 0.0, 7.5, None, 12.0, 0.0, 3.0]
    rows = [(i, start + datetime.timedelta(minutes=50 * i + 500 * (i > 50)), i, ("purchase", "view", "click")[i % 3], 0.0 if i == 51 else prices[i % 7], f'{{"k": {i % 5}}}') for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    df.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "in").mkdir()
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "in" / "events.parquet")
    checked(spark, tmp_path / "in", ["price_path_mfe_mae"])
    found = {str(r["mfe"]) for r in catalog.QUERIES["price_path_mfe_mae"](spark, str(tmp_path / "in")).collect()}
    assert "inf" in found and "None" in found


def test_reject_reasons_are_of_planted_sizes_only(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    prices, sizes = [5.0, 0.0, None, float("nan"), -1.0], ['{"k": 3}', '{"k": -1}', "{}", '{"k": -9}']
    rows = [(i, start, i, "ab"[i % 3 == 0], prices[i % 5], sizes[i % 4]) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    df.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "in").mkdir()
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "in" / "events.parquet")
    checked(spark, tmp_path / "in", ["trade_reject_reasons"])
