"""Queries: models and their features, labels across runs, tests of levels, books from deltas, volatility forecasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import adaptive, backfill, bars, booksync, compaction, crossasset, enrich, inference, monitor, profile, zones
from ..operators import indicators as ind
from ..operators.running import numbered
from ..sources import replay, sinks
from ..sources.tables import candles_from_orders, epoch_ms, table
from .base import DAY, HOUR, rounded, sql
from .trading import sided


def shared_folder(spark, label: str) -> str:
    """A new folder that all executors share, below spark.checkpoint.dir; on one machine a temporary one serves."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tapeflow-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _records(spark, d):
    """Candles as records of a feed: some carry features of their own, under several names, some of them unusable."""
    rows = inference.history_features(candles_from_orders(spark, d))
    k = F.dayofmonth(F.timestamp_millis("ts"))
    technical = F.struct(F.when(k % 3 == 0, F.col("high")).when(k % 3 == 1, 0.0).alias("bb_upper"), F.when(k % 4 == 0, "n/a").when(k % 4 == 1, F.format_string("%d", k)).alias("rsi"))
    longer = F.struct(F.struct(F.when(k % 2 == 0, 55.0).otherwise(97.0).alias("rsi_short")).alias("1h"))
    volume = F.when(k % 5 == 0, F.col("volume") / 4)
    return rows.withColumns({"technical": technical, "multi_tf": longer, "volume_sma_ratio": volume, "return_1": F.when(k % 7 == 0, 0.0), "price": F.when(k == 1, F.col("open"))})


def ml_feature_mapping(spark, d):
    rows = inference.resolved(_records(spark, d))
    return rounded(rows.select("symbol", "ts", *(f"f_{n}" for n in inference.FEATURES), "n_external", "n_internal", "n_default"), 4)


def _training(spark, d):
    return inference.labelled(inference.resolved(inference.history_features(candles_from_orders(spark, d))))


def ml_time_folds(spark, d):
    """Quality of models that only know the time before, fold by fold."""
    return rounded(inference.time_folds(_training(spark, d), folds=3, rounds=10)[1])


def ml_inference(spark, d):
    """A model of the candles, written, read again by its version, and its score of every candle."""
    rows, root = _training(spark, d), shared_folder(spark, "models")
    inference.save(inference.fitted(rows.where("label IS NOT NULL").withColumn("_later", F.pmod(F.xxhash64("symbol", "ts"), F.lit(5)) == 0), rounds=10), root, 1)
    model, _ = inference.load(spark, root)
    out = inference.with_readiness(inference.scores(model, rows))
    return rounded(out.select("symbol", "ts", "prob_up", "prob_down", "signal", "confidence", "usable", "warm"))


def label_backfill(spark, d):
    """Labels of candles that come in three runs, each of which labels what waited for it."""
    rows = candles_from_orders(spark, d).select("symbol", "ts", "close")
    cuts = [c * DAY for c in (8800, 9500)]
    jobs = backfill.Backfill(shared_folder(spark, "labels"))
    for number, some in enumerate((F.col("ts") < cuts[0], (F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1]), F.col("ts") >= cuts[1])):
        jobs.run(rows.where(some), number)
    return rounded(jobs.labelled(spark, 3), 4)


def _ticks(spark, d):
    signed = F.when(F.col("m"), -F.col("q")).otherwise(F.col("q"))
    return sided(spark, d).select("symbol", "t", "seq", F.col("p").alias("price"), F.col("q").alias("volume"), signed.alias("delta"))


def _levels(ticks):
    """Three supports and three resistances of each symbol around its mean price."""
    mean = ticks.groupBy("symbol").agg(F.avg("price").alias("mean"))
    rows = mean.select("symbol", "mean", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k"))
    factor = F.when(F.col("k") <= 3, 1 - F.col("k") * 0.2).otherwise(1 + (F.col("k") - 3) * 0.2)
    return rows.select(
        "symbol", F.when(F.col("k") <= 3, "support").otherwise("resistance").alias("kind"), F.pmod(F.col("k") - 1, F.lit(3)).alias("place"), F.round(F.col("mean") * factor, 2).alias("level"), (F.col("k") * 1.5).alias("strength")
    )


def lvl_monitor(spark, d):
    ticks = _ticks(spark, d)
    out = monitor.level_tests(ticks, _levels(ticks), 0.05)
    return rounded(out.select("symbol", "seq", "kind", "level", "deviation", "reaction", "confidence", "trend", "volatility", "volume_class", "significance", "momentum", "advice"), 4)


def lvl_monitor_summary(spark, d):
    ticks = _ticks(spark, d)
    return rounded(monitor.summary(monitor.level_tests(ticks, _levels(ticks), 0.05)), 4)


def book_messages(spark, d):
    """Updates and lines of a book for each priority of orders: an order is an update, its items are the lines. Some
    updates are lost, some come twice, every fortieth is a snapshot."""
    orders = table(spark, d, "orders").select(F.col("o_orderpriority").alias("book"), "o_orderkey")
    rows = numbered(orders, "n", ["book"], ["o_orderkey"], 1_000_000).where("o_orderkey % 131 <> 0")
    times = F.when(F.col("o_orderkey") % 17 == 0, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("again", F.explode(times))
    arrival = F.col("o_orderkey") * 2 + F.col("again")
    kind = F.when(F.col("n") % 40 == 5, "snapshot").otherwise("delta")
    updates = rows.select("book", arrival.alias("arrival"), kind.alias("kind"), F.col("n").alias("first_id"), F.col("n").alias("last_id"))
    items = table(spark, d, "lineitem").join(rows.select("book", "o_orderkey", arrival.alias("arrival")), F.col("l_orderkey") == F.col("o_orderkey"))
    bid = F.col("l_linenumber") % 2 == 1
    lines = items.select(
        "book", "arrival", F.when(bid, "bid").otherwise("ask").alias("side"), (F.when(bid, 900).otherwise(950) + F.col("l_partkey") % 40).cast("double").alias("price"),
        F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity").cast("double")).alias("qty"), F.col("l_linenumber").alias("line"),
    )
    return updates, lines


def book_replay(spark, d):
    return rounded(booksync.replayed(*book_messages(spark, d), chunk=200), 4)


def mdl_volatility_ewma(spark, d):
    return rounded(ind.volatility_forecast(candles_from_orders(spark, d)))


def min_trades_adaptive(spark, d):
    return adaptive.adaptive_minimum(bars.ohlcv(sided(spark, d), HOUR))


def cross_asset_features(spark, d):
    """Each priority's candles against the mean price of a day's shipments, by their flag."""
    flag = F.col("l_returnflag").alias("symbol")
    references = table(spark, d, "lineitem").groupBy(flag, epoch_ms("l_shipdate").alias("ts")).agg((F.sum(F.col("l_extendedprice").cast("decimal(20,4)")) / F.count(F.lit(1))).cast("double").alias("close"))
    series = candles_from_orders(spark, d).select("symbol", "ts", "close")
    return rounded(crossasset.cross_asset(series, references).drop("y", "x_return", "y_return"))


def _stored_lines(spark, d):
    """Orders as JSON lines in a folder: later parts have a field more, every 50th line is cut off, every 77th is none at all."""
    root = shared_folder(spark, "lines")
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), epoch_ms("o_orderdate").alias("epoch_ms"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus")).alias("clerk"))
    k = F.col("o_orderkey")
    whole = F.when(k % 2 == 0, F.to_json(F.struct("o_orderkey", "price", "epoch_ms", "clerk"))).otherwise(F.to_json(F.struct("o_orderkey", "price", "epoch_ms")))
    line = F.when(k % 50 == 0, F.substring(whole, 1, 30)).when(k % 77 == 0, F.lit("lost connection")).otherwise(whole)
    orders.select(line.alias("value")).write.text(root)
    return replay.read_lines(spark, root)


def replay_lines(spark, d):
    """Records of stored lines, and why the others are none."""
    good, bad = replay.parts(_stored_lines(spark, d))
    kept = replay.ordered(good).groupBy(F.lit("record").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("_time").alias("first"), F.max("_time").alias("last"), F.count("clerk").alias("clerks"))
    lost = bad.groupBy(F.col("reason").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("clerks"))
    return kept.union(lost)


def replay_gate(spark, d):
    """Whether the records may be learned from: their number, and columns that are mostly null."""
    good, _ = replay.parts(_stored_lines(spark, d))
    found = replay.gate(good, required=("price", "side"))
    return rounded(found.select("rows", "valid", F.concat_ws(",", "errors").alias("errors"), F.concat_ws(",", "warnings").alias("warnings"), F.element_at("null_share", "clerk").alias("clerk_null")))


def features_stored(spark, d):
    """Features of hours written by day and read back, two runs with different columns: every column of either."""
    root, h = shared_folder(spark, "features"), bars.ohlcv(sided(spark, d), HOUR)
    rows = h.select("symbol", F.col("window_end").alias("ts"), "close", "high", "low", "n")
    sinks.write_features(rows.where("n > 1").select("symbol", "ts", "close", F.struct("high", "low").alias("range")), root)
    sinks.write_features(rows.where("n <= 1").select("symbol", "ts", "close", "n"), root)
    return rounded(sinks.read_features(spark, root).select("symbol", "ts", "close", F.col("`range.high`").alias("high"), F.col("`range.low`").alias("low"), "n"), 4)


def events_stored(spark, d):
    """Events written as JSON payloads and read back: the last hundred signals, oldest first."""
    root = shared_folder(spark, "events")
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), epoch_ms("ts").alias("timestamp_ms"), "event_type", F.lit("all").alias("symbol"), (F.col("value") > 50).alias("is_signal"))
    sinks.write_events(rows, root)
    return sinks.recent_events(spark, root, 100, signals_only=True).select("timestamp_ms", "event_type", F.get_json_object("payload", "$.id").cast("long").alias("id"))


def _records_json(spark, d):
    """Orders with their items as nested records, in which sections repeat each other."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"))).alias("clusters"), F.sum("l_quantity").alias("volume"))
    rows = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    flow = F.struct("clusters", F.col("o_orderpriority").alias("time_index"))
    record = F.struct(
        F.col("o_orderkey").alias("id"), F.col("volume").alias("volume_compra"), F.col("o_totalprice").alias("preco_fechamento"), flow.alias("fluxo_continuo"), F.struct(F.col("o_orderpriority").alias("text"), "clusters").alias("macro_context"),
        F.struct(F.col("volume").alias("volume_compra"), F.col("o_orderstatus").alias("status")).alias("contextual_snapshot"), F.struct(F.col("o_totalprice").alias("preco_fechamento"), flow.alias("flow_metrics")).alias("raw_event"),
    )
    return rows.select("o_orderkey", F.to_json(record).alias("record"))


def record_copies(spark, d):
    rows = compaction.deduplicated(_records_json(spark, d), "record")
    return rows.select("o_orderkey", "removed", F.get_json_object("record", "$.fluxo_continuo.time_index").isNull().alias("no_index"), F.get_json_object("record", "$.raw_event").alias("raw"), F.get_json_object("record", "$.contextual_snapshot").alias("context"))


def record_within(spark, d):
    """Records of at most 700 bytes, and what is left of them."""
    rows = _records_json(spark, d).select("o_orderkey", compaction.within(F.col("record"), 700).alias("record"))
    return rows.select("o_orderkey", F.octet_length("record").alias("bytes"), F.get_json_object("record", "$.id").cast("long").alias("id"), "record")


def _sources(spark, d):
    """What levels come from, for each symbol of the trades: prices, profiles of a day, week and month, pivots, averages, absorptions, book."""
    trades = sided(spark, d)
    now = trades.groupBy("symbol").agg(F.max_by("p", F.struct("t", "seq")).alias("last"), F.floor(F.max("t") / DAY).alias("day"))
    rows = trades.join(now, "symbol").withColumn("age", F.col("day") - F.floor(F.col("t") / DAY))
    spans = F.array(*(F.struct(F.lit(p).alias("period"), F.lit(n).alias("days")) for p, n in (("daily", 1), ("weekly", 7), ("monthly", 30))))
    rows = rows.withColumn("s", F.explode(spans)).where("age < s.days")
    steps = rows.groupBy("symbol", "s.period", F.floor("p").alias("b")).agg(F.sum(F.col("q").cast("decimal(20,8)")).alias("v"), F.max("p").alias("hi"), F.min("p").alias("lo"))
    of = steps.groupBy("symbol", "period").agg(F.max_by(F.col("b") + 0.5, F.struct("v", -F.col("b"))).alias("poc"), F.max("hi").alias("vah"), F.min("lo").alias("val"))
    profiles = of.select("symbol", "period", F.explode(F.create_map(*(x for k in ("poc", "vah", "val") for x in (F.lit(k), F.col(k).cast("double"))))).alias("kind", "price"))
    day = of.where("period = 'daily'").join(now, "symbol")
    pp = (F.col("vah") + F.col("val") + F.col("last")) / 3
    pivots = day.select("symbol", F.lit("classic").alias("method"), F.explode(F.create_map(F.lit("PP"), pp, F.lit("R1"), 2 * pp - F.col("val"), F.lit("S1"), 2 * pp - F.col("vah"))).alias("name", "price"))
    h = bars.ohlcv(trades, HOUR)
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("window_end")))
    averages = h.withColumn("k", newest).where("k <= 21").groupBy("symbol").agg(F.avg("close").alias("price")).withColumn("name", F.lit("ema_21_1h"))
    big = rows.where("s.period = 'daily' AND q > 9").select("symbol", F.col("p").alias("price"), F.when(F.col("m"), "sell").otherwise("buy").alias("side"), (F.col("q") / 20).alias("strength"))
    exact = lambda c: F.sum(c.cast("decimal(20,8)")).cast("double")
    sums = {f"{side}_{p}": exact(F.when((F.col("s.period") == p) & (F.col("m") == (side == "ask")), F.col("q")).otherwise(0)) for side in ("bid", "ask") for p in ("daily", "weekly")}
    book = rows.groupBy("symbol").agg(*(c.alias(n) for n, c in sums.items()))
    lean = lambda p: (F.col(f"bid_{p}") - F.col(f"ask_{p}")) / (F.col(f"bid_{p}") + F.col(f"ask_{p}"))
    book = book.select("symbol", F.col("bid_daily").alias("bid_depth"), F.col("ask_daily").alias("ask_depth"), lean("daily").alias("imbalance"), lean("weekly").alias("depth_imbalance"))
    candles = h.select("symbol", F.col("window_end").alias("ts"), "high", "low")
    return now.select("symbol", "last"), profiles, pivots, averages, big, book, candles


def lvl_scored_sources(spark, d):
    prices, profiles, pivots, averages, _, _, candles = _sources(spark, d)
    out = zones.scored(zones.candidates(prices, profiles, pivots, averages, 10), prices, candles, 0.02)
    return rounded(out.withColumn("sources", F.concat_ws(",", "sources")), 4)


def _zones(spark, d):
    prices, profiles, pivots, averages, big, book, candles = _sources(spark, d)
    levels = zones.scored(zones.candidates(prices, profiles, pivots, averages, 10), prices, candles, 0.02)
    return zones.defence_zones(zones.defence_signals(prices, profiles, pivots, averages, levels, big, book), prices, 0.04)


def lvl_defence_zones(spark, d):
    return rounded(_zones(spark, d), 4)


def lvl_defence_balance(spark, d):
    return rounded(zones.defence_balance(_zones(spark, d)), 4)


def vp_session_shape(spark, d):
    return rounded(profile.session_shape(sided(spark, d), 7 * DAY))


def bars_imbalance(spark, d):
    return rounded(bars.imbalance_bars(sided(spark, d), 6 * HOUR))


def alerts_imbalance(spark, d):
    """Bars with twice as much on one side, none within a day after another."""
    found = bars.imbalance_bars(sided(spark, d), 6 * HOUR).where("effective >= 2")
    return rounded(bars.cooled(found.select("symbol", "t", "seq", "effective", "dominant", "close", "severity"), DAY))


def absorption_events(spark, d):
    """Windows that follow each other trade by trade, with much volume and little range."""
    windows = bars.chained_windows(sided(spark, d), 6 * HOUR)
    out = enrich.absorbing_windows(windows, volume_factor=1.2, narrow_percent=195.0)
    return rounded(out.select("symbol", "ts", "end", "level", "volume", "n", "volume_ratio", "range_ratio", "absorber", "intensity"), 4)


QUERIES = [absorption_events, vp_session_shape, bars_imbalance, alerts_imbalance, lvl_scored_sources, lvl_defence_zones, lvl_defence_balance, min_trades_adaptive, cross_asset_features, replay_lines, replay_gate, features_stored, events_stored, record_copies, record_within, ml_feature_mapping, ml_time_folds, ml_inference, label_backfill, lvl_monitor, lvl_monitor_summary, book_replay, mdl_volatility_ewma]

_L = "(PARTITION BY symbol ORDER BY ts)"
_W = lambda n: f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_TESTS = """levels AS (SELECT symbol, CASE WHEN k <= 3 THEN 'support' ELSE 'resistance' END AS kind, (k - 1) % 3 AS place, k * 1.5::DOUBLE AS strength,
        round(mean * CASE WHEN k <= 3 THEN 1 - k * 0.2::DOUBLE ELSE 1 + (k - 3) * 0.2::DOUBLE END, 2) AS level FROM (SELECT symbol, avg(p) AS mean FROM sided GROUP BY 1), (SELECT unnest(range(1, 7)) AS k)),
    flows AS (SELECT *, CASE WHEN m THEN -q ELSE q END AS delta FROM sided),
    recent AS (SELECT *, row_number() OVER s AS n, first_value(p) OVER (s ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS first,
        stddev_pop(p) OVER w / avg(p) OVER w * 100 AS vol20, avg(delta) OVER (s ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / avg(q) OVER (s ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m5, q / avg(q) OVER w AS ratio
        FROM flows WINDOW s AS (PARTITION BY symbol ORDER BY t, seq), w AS (PARTITION BY symbol ORDER BY t, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    near AS (SELECT r.*, kind, level, row_number() OVER (PARTITION BY r.symbol, r.seq ORDER BY kind <> 'support', place) AS place FROM recent r JOIN levels l ON l.symbol = r.symbol AND abs(p - level) <= level * 0.05::DOUBLE),
    tests AS (SELECT *, CASE WHEN n >= 10 THEN (p - first) / first * 100 END AS change, CASE WHEN kind = 'support' THEN delta / q ELSE -delta / q END AS share FROM near WHERE place = 1),
    judged AS (SELECT symbol, seq, t, kind, level, round((p / level - 1) * 100, 4) AS deviation,
        CASE WHEN share > 0.6 THEN 'strong_defense' WHEN share > 0.3 THEN 'defense' WHEN share < -0.6 THEN 'weak_defense' ELSE 'neutral' END AS reaction,
        CASE WHEN abs(share) > 0.6 THEN 'HIGH' WHEN share > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
        CASE WHEN change IS NULL THEN 'UNKNOWN' WHEN change > 2 THEN 'STRONG_UP' WHEN change > 0.5 THEN 'UP' WHEN change < -2 THEN 'STRONG_DOWN' WHEN change < -0.5 THEN 'DOWN' ELSE 'SIDEWAYS' END AS trend,
        CASE WHEN change IS NULL THEN 'UNKNOWN' WHEN n >= 20 AND vol20 > 1 THEN 'HIGH' ELSE 'LOW' END AS volatility,
        CASE WHEN ratio > 3 THEN 'EXTREME' WHEN ratio > 2 THEN 'HIGH' WHEN ratio > 1.5 THEN 'ELEVATED' WHEN ratio < 0.5 THEN 'LOW' ELSE 'NORMAL' END AS volume_class,
        CASE WHEN ratio > 2 THEN 'HIGH' WHEN ratio > 1.5 THEN 'MEDIUM' ELSE 'LOW' END AS significance,
        CASE WHEN change IS NULL THEN 'NEUTRAL' WHEN m5 > 0.1 THEN 'BULLISH' WHEN m5 < -0.1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS momentum,
        CASE WHEN share > 0.6 THEN CASE kind WHEN 'support' THEN 'BUY' ELSE 'SELL' END WHEN share > 0.3 THEN CASE kind WHEN 'support' THEN 'CAUTIOUS BUY' ELSE 'CAUTIOUS SELL' END
             WHEN share < -0.6 THEN CASE kind WHEN 'support' THEN 'WATCH FOR BREAKDOWN' ELSE 'WATCH FOR BREAKOUT' END ELSE 'MONITOR' END AS advice FROM tests)"""
_BOOKS = """orders_n AS (SELECT o_orderpriority AS book, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders),
    sent AS (SELECT book, o_orderkey, n, o_orderkey * 2 + again AS arrival, CASE WHEN n % 40 = 5 THEN 'snapshot' ELSE 'delta' END AS kind FROM orders_n, (SELECT unnest([0, 1]) AS again)
        WHERE o_orderkey % 131 <> 0 AND (again = 0 OR o_orderkey % 17 = 0)),
    topped AS (SELECT *, max(n) OVER (PARTITION BY book ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sent),
    good AS (SELECT *, sum(CASE WHEN kind = 'snapshot' THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY arrival) AS segment FROM topped WHERE before IS NULL OR n > before),
    heads AS (SELECT book, arrival, o_orderkey, n AS last_id, CAST(segment AS BIGINT) AS segment,
        sum(CASE WHEN kind = 'delta' AND (segment = 0 OR n > before + 1) THEN 1 ELSE 0 END) OVER (PARTITION BY book, segment ORDER BY arrival) > 0 AS stale FROM good),
    lines AS (SELECT book, arrival, segment, CASE WHEN l_linenumber % 2 = 1 THEN 'bid' ELSE 'ask' END AS side, (CASE WHEN l_linenumber % 2 = 1 THEN 900 ELSE 950 END + l_partkey % 40)::DOUBLE AS price,
        arg_max(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity::DOUBLE END, (l_linenumber, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity::DOUBLE END)) AS qty FROM heads JOIN lineitem ON l_orderkey = o_orderkey WHERE NOT stale GROUP BY 1, 2, 3, 4, 5),
    grid AS (SELECT h.book, h.arrival, h.segment, x.side, x.price FROM heads h JOIN (SELECT DISTINCT book, segment, side, price FROM lines) x ON x.book = h.book AND x.segment = h.segment WHERE NOT stale),
    state AS (SELECT g.book, g.arrival, g.side, g.price, last_value(qty IGNORE NULLS) OVER (PARTITION BY g.book, g.segment, g.side, g.price ORDER BY g.arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS qty
        FROM grid g LEFT JOIN lines l ON l.book = g.book AND l.arrival = g.arrival AND l.side = g.side AND l.price = g.price),
    books AS (SELECT book, arrival, max(CASE WHEN side = 'bid' THEN price END) AS best_bid, min(CASE WHEN side = 'ask' THEN price END) AS best_ask, count(CASE WHEN side = 'bid' THEN 1 END) AS bid_levels,
        count(CASE WHEN side = 'ask' THEN 1 END) AS ask_levels, sum(CASE WHEN side = 'bid' THEN qty ELSE 0 END) AS bid_qty, sum(CASE WHEN side = 'ask' THEN qty ELSE 0 END) AS ask_qty FROM state WHERE qty > 0 GROUP BY 1, 2)"""

_SOURCES = f"""lastp AS (SELECT symbol, arg_max(p, (t, seq)) AS last, max(t) // {DAY} AS day FROM sided GROUP BY 1),
    win AS (SELECT s.*, last, period FROM sided s JOIN lastp l USING (symbol), (VALUES ('daily', 1), ('weekly', 7), ('monthly', 30)) x(period, days) WHERE day - t // {DAY} < days),
    steps AS (SELECT symbol, period, floor(p) AS b, sum(CAST(q AS DECIMAL(20,8))) AS v, max(p) AS hi, min(p) AS lo FROM win GROUP BY 1, 2, 3),
    pof AS (SELECT symbol, period, arg_max(b + 0.5, (v, -b))::DOUBLE AS poc, max(hi) AS vah, min(lo) AS val FROM steps GROUP BY 1, 2),
    profs AS (SELECT symbol, period, 'poc' AS kind, poc AS price FROM pof UNION ALL SELECT symbol, period, 'vah', vah FROM pof UNION ALL SELECT symbol, period, 'val', val FROM pof),
    pv AS (SELECT symbol, vah, val, (vah + val + last) / 3 AS pp FROM pof JOIN lastp USING (symbol) WHERE period = 'daily'),
    pivs AS (SELECT symbol, 'PP' AS name, pp AS price FROM pv UNION ALL SELECT symbol, 'R1', 2 * pp - val FROM pv UNION ALL SELECT symbol, 'S1', 2 * pp - vah FROM pv),
    avgs AS (SELECT symbol, avg(close) AS price FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY window_end DESC) AS k FROM hours) WHERE k <= 21 GROUP BY 1),
    cand AS (SELECT symbol, price, kind || '_' || period AS source, CASE period WHEN 'weekly' THEN 1.8 WHEN 'monthly' THEN 2.0 ELSE CASE kind WHEN 'poc' THEN 1.5 ELSE 1.2 END END::DOUBLE AS weight FROM profs
        UNION ALL SELECT symbol, price, 'pivot_classic_' || name, 1.3 FROM pivs UNION ALL SELECT symbol, price, 'ema_21_1h', 0.8 FROM avgs
        UNION ALL SELECT symbol, (floor(last / 10) + k) * 10, 'round_number', 0.6 FROM lastp, (SELECT unnest(range(-3, 4)) AS k)),
    lv AS (SELECT symbol, price, source, weight, last, last * 0.02::DOUBLE AS far FROM cand JOIN lastp USING (symbol) WHERE price > 0),
    an AS (SELECT symbol, min(price) AS a, any_value(far) AS far FROM lv GROUP BY 1 UNION ALL SELECT an.symbol, (SELECT min(price) FROM lv WHERE lv.symbol = an.symbol AND lv.price - an.a > an.far), an.far FROM an WHERE an.a IS NOT NULL),
    gr AS (SELECT lv.*, (SELECT max(a) FROM an WHERE an.symbol = lv.symbol AND a <= lv.price) AS a FROM lv),
    mg AS (SELECT symbol, a, any_value(last) AS last, round(avg(price) + 1.7e-10, 2) AS price, first(source ORDER BY weight DESC, price, source) AS source, list_sort(list(DISTINCT source)) AS sources, sum(CAST(weight AS DECIMAL(10,2)))::DOUBLE AS weight FROM gr GROUP BY 1, 2),
    rc AS (SELECT symbol, high, low FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY window_end DESC) AS k FROM hours) WHERE k <= 100),
    tc AS (SELECT mg.symbol, mg.a, count(*) AS touches FROM mg JOIN rc ON rc.symbol = mg.symbol AND (abs(high - price) <= price * 0.02::DOUBLE OR abs(low - price) <= price * 0.02::DOUBLE) GROUP BY 1, 2),
    sc AS (SELECT mg.*, coalesce(touches, 0) AS touches, abs(price - last) / last * 100 AS distance, CASE WHEN price < last THEN 'support' WHEN price > last THEN 'resistance' ELSE 'at_price' END AS side,
        least(100, round(least(25, coalesce(touches, 0) * 6.0::DOUBLE) + least(25.0::DOUBLE, weight * 8) + CASE len(sources) WHEN 1 THEN 5 WHEN 2 THEN 12 WHEN 3 THEN 20 WHEN 4 THEN 25 ELSE 30 END + greatest(0, 20 - abs(price - last) / last * 300) + 1.7e-10)::INTEGER) AS strength
        FROM mg LEFT JOIN tc USING (symbol, a)),
    sr20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY strength DESC, price) AS rank FROM sc) WHERE rank <= 20)"""
_ZONES = _SOURCES + f""", bk AS (SELECT symbol, any_value(last) AS last, {", ".join(f"sum(CAST(CASE WHEN period = '{p}' AND {w} THEN q ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS {s}_{p}" for p in ("daily", "weekly") for s, w in (("bid", "NOT m"), ("ask", "m")))} FROM win GROUP BY 1),
    bi AS (SELECT *, (bid_daily - ask_daily) / (bid_daily + ask_daily) AS i, (bid_weekly - ask_weekly) / (bid_weekly + ask_weekly) AS di FROM bk),
    sg AS (SELECT symbol, round(last * 0.999::DOUBLE + 1.7e-10, 2) AS price, 'orderbook_bid_wall' AS source, least(40, abs(i) * 200)::DOUBLE AS strength, 'buy' AS side FROM bi WHERE bid_daily > 0 AND (i > 0.05 OR bid_daily > ask_daily * 1.1::DOUBLE)
        UNION ALL SELECT symbol, round(last * 1.001::DOUBLE + 1.7e-10, 2), 'orderbook_ask_wall', least(40, abs(i) * 200), 'sell' FROM bi WHERE ask_daily > 0 AND (i < -0.05 OR ask_daily > bid_daily * 1.1::DOUBLE)
        UNION ALL SELECT symbol, last * CASE WHEN di > 0 THEN 0.998::DOUBLE ELSE 1.002::DOUBLE END, 'depth_asymmetry', least(30, abs(di) * 100), CASE WHEN di > 0 THEN 'buy' ELSE 'sell' END FROM bi WHERE abs(di) > 0.1
        UNION ALL SELECT symbol, price, 'vp_' || kind, CASE kind WHEN 'poc' THEN 45 ELSE 35 END, CASE kind WHEN 'vah' THEN 'sell' WHEN 'val' THEN 'buy' ELSE CASE WHEN price < last THEN 'buy' ELSE 'sell' END END FROM profs JOIN lastp USING (symbol) WHERE period = 'daily'
        UNION ALL SELECT symbol, price, 'sr_level_' || source, least(50, strength * 0.5::DOUBLE), CASE WHEN price < last THEN 'buy' ELSE 'sell' END FROM sr20 WHERE strength > 30
        UNION ALL SELECT symbol, p, 'absorption_' || CASE WHEN m THEN 'sell' ELSE 'buy' END, least(40, q / 20 * 40), CASE WHEN m THEN 'sell' ELSE 'buy' END FROM win WHERE period = 'daily' AND q > 9
        UNION ALL SELECT symbol, price, 'pivot_classic_' || name, CASE name WHEN 'PP' THEN 30 ELSE 20 END, CASE WHEN name IN ('PP', 'S1') THEN 'buy' ELSE 'sell' END FROM pivs
        UNION ALL SELECT symbol, price, 'ema_ema_21_1h', 15, CASE WHEN price < last THEN 'buy' ELSE 'sell' END FROM avgs JOIN lastp USING (symbol)),
    sl2 AS (SELECT sg.*, last, last * 0.04::DOUBLE AS far FROM sg JOIN lastp USING (symbol) WHERE price > 0),
    zn AS (SELECT symbol, min(price) AS a, any_value(far) AS far FROM sl2 GROUP BY 1 UNION ALL SELECT zn.symbol, (SELECT min(price) FROM sl2 WHERE sl2.symbol = zn.symbol AND sl2.price - zn.a > zn.far), zn.far FROM zn WHERE zn.a IS NOT NULL),
    zg AS (SELECT sl2.*, (SELECT max(a) FROM zn WHERE zn.symbol = sl2.symbol AND a <= sl2.price) AS a FROM sl2),
    zz AS (SELECT symbol, a, any_value(last) AS last, round(avg(price) + 1.7e-10, 2) AS center, round(min(price) - any_value(far) * 0.5 + 1.7e-10, 2) AS low, round(max(price) + any_value(far) * 0.5 + 1.7e-10, 2) AS high,
        round(least(100.0::DOUBLE, avg(strength) * (1 + count(DISTINCT source) * 0.3::DOUBLE)) + 1.7e-10)::INTEGER AS strength, count(DISTINCT source)::INTEGER AS sources, count(*)::INTEGER AS signals,
        CASE WHEN count(CASE WHEN side = 'buy' THEN 1 END) * 2 >= count(*) THEN 'buy' ELSE 'sell' END AS side FROM zg GROUP BY 1, 2),
    zk AS (SELECT *, max((sources >= 2)::INT) OVER (PARTITION BY symbol) AS strong, row_number() OVER (PARTITION BY symbol ORDER BY strength DESC, center) AS k FROM zz),
    zr AS (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY strength DESC, center) AS rank FROM zk WHERE CASE WHEN strong = 1 THEN sources >= 2 ELSE k <= 5 END),
    zones AS (SELECT symbol, side, rank::INTEGER AS rank, center, low, high, strength, sources, signals, CASE WHEN sources >= 3 THEN 'confluence' WHEN sources >= 2 THEN 'cluster' ELSE 'single' END AS kind, round(abs(center - last) / last * 100, 4) AS distance FROM zr WHERE rank <= 5)"""
_SHAPES = f"""ss AS (SELECT *, (t // {7 * DAY} + 1) * {7 * DAY} AS window_end FROM sided), se AS (SELECT symbol, window_end, min(p) AS lo, max(p) AS hi, count(*) AS n, greatest(10, least(30, count(*) // 50))::INTEGER AS bins FROM ss GROUP BY 1, 2 HAVING count(*) >= 20 AND max(p) > min(p)),
    hb AS (SELECT symbol, window_end, least(floor((p - lo) / ((hi - lo) / bins)), bins - 1)::INTEGER AS bin, sum(CAST(q AS DECIMAL(20,8))) AS v, sum(CAST(CASE WHEN p <= lo + (hi - lo) / 3 THEN q ELSE 0 END AS DECIMAL(20,8))) AS bottom,
        sum(CAST(CASE WHEN p > hi - (hi - lo) / 3 THEN q ELSE 0 END AS DECIMAL(20,8))) AS top FROM ss JOIN se USING (symbol, window_end) GROUP BY 1, 2, 3),
    dn AS (SELECT g.symbol, g.window_end, g.bin, coalesce(v, 0)::DOUBLE AS v, coalesce(bottom, 0)::DOUBLE AS bottom, coalesce(top, 0)::DOUBLE AS top FROM (SELECT symbol, window_end, unnest(range(bins)) AS bin FROM se) g LEFT JOIN hb USING (symbol, window_end, bin)),
    pk AS (SELECT *, coalesce(v > lag(v) OVER l AND v > lead(v) OVER l AND v > max(v) OVER w * 0.4::DOUBLE, false) AS peak FROM dn WINDOW l AS (PARTITION BY symbol, window_end ORDER BY bin), w AS (PARTITION BY symbol, window_end)),
    ft AS (SELECT *, min(CASE WHEN peak THEN bin END) OVER w AS f, max(CASE WHEN peak THEN bin END) OVER w AS o FROM pk WINDOW w AS (PARTITION BY symbol, window_end)),
    sh AS (SELECT symbol, window_end, sum(bottom) / sum(v) AS bottom, sum(top) / sum(v) AS top, 1 - sum(bottom) / sum(v) - sum(top) / sum(v) AS middle, count(CASE WHEN peak THEN 1 END) AS peaks,
        min(CASE WHEN bin BETWEEN f AND o THEN v END) AS valley, max(CASE WHEN bin = f THEN v END) AS a, max(CASE WHEN bin = o THEN v END) AS b FROM ft GROUP BY 1, 2),
    sn AS (SELECT *, CASE WHEN peaks >= 2 AND valley < (a + b) / 2 * 0.5 THEN 'B' WHEN top > 0.45 THEN 'P' WHEN bottom > 0.45 THEN 'b' WHEN middle > 0.5 THEN 'D' WHEN bottom > 0.32 AND top > 0.32 AND middle < 0.3 THEN 'B' ELSE 'Thin' END AS shape FROM sh)"""
_IMBALANCE = f"""num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t, seq) AS rn FROM sided),
    st AS (SELECT DISTINCT symbol, CAST(1 AS BIGINT) AS s FROM num UNION ALL SELECT st.symbol, (SELECT min(x.rn) FROM num x WHERE x.symbol = st.symbol AND x.t >= y.t + {6 * HOUR}) + 1 FROM st JOIN num y ON y.symbol = st.symbol AND y.rn = st.s),
    sp AS (SELECT symbol, s, lead(s) OVER (PARTITION BY symbol ORDER BY s) - 1 AS c FROM st WHERE s IS NOT NULL),
    bs AS (SELECT sp.symbol, sp.s, arg_min(n.t, n.rn) FILTER (n.rn >= sp.s) AS t, arg_min(n.seq, n.rn) FILTER (n.rn >= sp.s) AS seq, sum(CAST(CASE WHEN NOT m THEN q ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS b, sum(CAST(CASE WHEN m THEN q ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS v,
        count(*) FILTER (NOT m) AS buys, count(*) FILTER (m) AS sells, arg_min(p, n.rn) FILTER (n.rn >= sp.s) AS open, arg_max(p, n.rn) AS close
        FROM sp JOIN num n ON n.symbol = sp.symbol AND n.rn >= CASE WHEN sp.s > 1 THEN sp.s - 1 ELSE 1 END AND n.rn < sp.c WHERE c IS NOT NULL GROUP BY 1, 2),
    ib AS (SELECT *, CASE WHEN b > 0 AND v > 0 THEN b / v WHEN b <= 0 AND v <= 0 THEN 1.0 END AS ratio, CASE WHEN b > 0 AND v > 0 THEN greatest(b / v, v / b) WHEN b <= 0 AND v <= 0 THEN 1.0 ELSE 100.0 END AS effective FROM bs),
    iv AS (SELECT *, CASE WHEN b > v THEN 'buy' WHEN v > b THEN 'sell' ELSE 'unknown' END AS dominant, CASE WHEN effective >= 5 THEN 'extreme' WHEN effective >= 3 THEN 'strong' WHEN effective >= 2 THEN 'moderate' END AS severity FROM ib),
    al AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS k FROM iv WHERE effective >= 2),
    ac AS (SELECT DISTINCT symbol, CAST(1 AS BIGINT) AS k FROM al UNION ALL SELECT ac.symbol, (SELECT min(x.k) FROM al x WHERE x.symbol = ac.symbol AND x.t >= y.t + {DAY}) FROM ac JOIN al y ON y.symbol = ac.symbol AND y.k = ac.k)"""
_CHAIN = f"""num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t, seq) AS rn FROM sided),
    st AS (SELECT DISTINCT symbol, CAST(1 AS BIGINT) AS s FROM num UNION ALL SELECT st.symbol, (SELECT min(x.rn) FROM num x WHERE x.symbol = st.symbol AND x.rn > st.s AND x.t >= y.t + {6 * HOUR}) FROM st JOIN num y ON y.symbol = st.symbol AND y.rn = st.s),
    sp AS (SELECT symbol, s, lead(s) OVER (PARTITION BY symbol ORDER BY s) AS c FROM st WHERE s IS NOT NULL),
    cw AS (SELECT sp.symbol, sp.s, arg_min(t, rn) AS ts, arg_max(t, rn) AS "end", max(p) AS high, min(p) AS low, sum(CAST(CASE WHEN rn > s OR s = 1 THEN q ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS volume,
        sum(CAST(CASE WHEN (rn > s OR s = 1) AND NOT m THEN q ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS b, sum(CAST(CASE WHEN (rn > s OR s = 1) AND m THEN q ELSE 0 END AS DECIMAL(20,8)))::DOUBLE AS v, count(*) - CASE WHEN any_value(s) = 1 THEN 0 ELSE 1 END AS n
        FROM sp JOIN num ON num.symbol = sp.symbol AND rn BETWEEN sp.s AND sp.c WHERE c IS NOT NULL GROUP BY 1, 2),
    cr AS (SELECT *, (high - low) / ((high + low) / 2) * 100 AS rp FROM cw),
    ch AS (SELECT *, volume / avg(volume) OVER w AS vr, rp / avg(rp) OVER w AS rr, count(*) OVER w AS k FROM cr WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))"""
_S = ("trades", "sided", "hours")


def _recursive(statement: str) -> str:
    return statement.replace("WITH ", "WITH RECURSIVE ", 1)


ORACLE = {
    "absorption_events": _recursive(sql("trades", "sided", more=_CHAIN, select="""SELECT symbol, ts, "end", round((high + low) / 2, 4) AS level, round(volume, 4) AS volume, n, round(vr, 4) AS volume_ratio, round(rr, 4) AS range_ratio, CASE WHEN b > v * 1.5 THEN 'sell' WHEN v > b * 1.5 THEN 'buy' ELSE 'unknown' END AS absorber,
        round(least(1.0::DOUBLE, vr / 1.2::DOUBLE * 0.5 + (1 - least(rr, 1)) * 0.5), 4) AS intensity FROM ch WHERE k >= 5 AND n >= 5 AND vr >= 1.2 AND (rp < 195 OR rr < 0.5)""")),
    "vp_session_shape": sql("trades", "sided", more=_SHAPES, select="""SELECT symbol, window_end, round(bottom, 6) AS bottom, round(middle, 6) AS middle, round(top, 6) AS top, shape, CASE shape WHEN 'P' THEN 'BEARISH_AFTER' WHEN 'b' THEN 'BULLISH_AFTER' WHEN 'D' THEN 'RANGE' WHEN 'B' THEN 'BREAKOUT_EXPECTED' ELSE 'VOLATILE' END AS signal,
        CASE WHEN top > bottom AND top > middle THEN 'upper' WHEN bottom > top AND bottom > middle THEN 'lower' ELSE 'middle' END AS zone FROM sn"""),
    "bars_imbalance": _recursive(sql("trades", "sided", more=_IMBALANCE, select="SELECT symbol, t, seq, round(b, 6) AS buy_volume, round(v, 6) AS sell_volume, buys, sells, round(open, 6) AS open, round(close, 6) AS close, round((close - open) / open * 100, 6) AS price_change, round(ratio, 6) AS ratio, round(effective, 6) AS effective, dominant, severity FROM iv")),
    "alerts_imbalance": _recursive(sql("trades", "sided", more=_IMBALANCE, select="SELECT symbol, t, seq, round(effective, 6) AS effective, dominant, round(close, 6) AS close, severity FROM al JOIN ac USING (symbol, k)")),
    "lvl_scored_sources": _recursive(sql(*_S, more=_SOURCES, select="SELECT symbol, price, source, array_to_string(sources, ',') AS sources, touches, round(distance, 4) AS distance, strength, side, rank::INTEGER AS rank FROM sr20")),
    "lvl_defence_zones": _recursive(sql(*_S, more=_ZONES, select="SELECT * FROM zones")),
    "lvl_defence_balance": _recursive(sql(*_S, more=_ZONES, select="""SELECT symbol, buy, sell, round(r, 4) AS ratio, CASE WHEN buy + sell = 0 THEN 'neutral' WHEN r > 1.5 THEN 'strong_buy_defense' WHEN r > 1.1 THEN 'slight_buy_defense' WHEN r > 0.9 THEN 'neutral' WHEN r > 0.67 THEN 'slight_sell_defense' ELSE 'strong_sell_defense' END AS bias FROM
        (SELECT *, CASE WHEN sell > 0 THEN buy / sell WHEN buy > 0 THEN 99.0 ELSE 1.0 END AS r FROM (SELECT symbol, sum(CASE WHEN side = 'buy' THEN strength ELSE 0 END)::BIGINT AS buy, sum(CASE WHEN side = 'sell' THEN strength ELSE 0 END)::BIGINT AS sell FROM zones GROUP BY 1))""")),
    "ml_feature_mapping": sql("candles", more=f"""h AS (SELECT *, row_number() OVER l AS n, day(to_timestamp(ts / 1000) AT TIME ZONE 'UTC') AS k, close - lag(close) OVER l AS dd, lag(close) OVER l AS c1, lag(close, 4) OVER l AS c4, lag(close, 9) OVER l AS c9,
            avg(close) OVER {_W(20)} AS mean, stddev_samp(close) OVER {_W(20)} AS dev, avg(volume) OVER {_W(20)} AS vol FROM candles WINDOW l AS {_L}),
        g AS (SELECT *, avg(greatest(dd, 0)) OVER {_W(14)} AS gain, avg(greatest(-dd, 0)) OVER {_W(14)} AS loss FROM h),
        o AS (SELECT *, CASE WHEN k = 1 AND open <> 0 THEN open END AS e_price, CASE WHEN k % 7 = 0 THEN 0.0::DOUBLE END AS e_r1, CASE WHEN k % 3 = 0 AND high <> 0 THEN high END AS e_up,
            CASE WHEN k % 4 = 1 THEN k::DOUBLE END AS e_rsi, CASE WHEN k % 5 = 0 THEN volume / 4 END AS e_vol,
            CASE WHEN n >= 2 THEN close END AS i_price, CASE WHEN n >= 2 THEN close / c1 - 1 END AS i_r1, CASE WHEN n >= 6 THEN close / c4 - 1 END AS i_r5, CASE WHEN n >= 11 THEN close / c9 - 1 END AS i_r10,
            CASE WHEN n >= 20 THEN mean + 2 * dev END AS i_up, CASE WHEN n >= 20 THEN mean - 2 * dev END AS i_lo, CASE WHEN n >= 20 THEN 4 * dev / mean END AS i_w,
            CASE WHEN n >= 3 THEN CASE WHEN loss < 1e-10 THEN CASE WHEN gain > 1e-10 THEN 80.0 ELSE 50.0 END ELSE 100 - 100 / (1 + gain / loss) END END AS i_rsi, CASE WHEN n >= 2 THEN volume / vol END AS i_vol FROM g)""",
        select="""SELECT symbol, ts, round(coalesce(e_price, i_price, 0), 4) AS f_price_close, round(coalesce(e_r1, i_r1, 0), 4) AS f_return_1, round(coalesce(i_r5, 0), 4) AS f_return_5, round(coalesce(i_r10, 0), 4) AS f_return_10,
            round(coalesce(e_up, i_up), 4) AS f_bb_upper, round(i_lo, 4) AS f_bb_lower, round(i_w, 4) AS f_bb_width,
            round(CASE WHEN coalesce(e_rsi, x_rsi, i_rsi, 50) >= 100 OR coalesce(e_rsi, x_rsi, i_rsi, 50) <= 0 THEN CASE WHEN k % 2 = 0 THEN 55 ELSE 50 END ELSE coalesce(e_rsi, x_rsi, i_rsi, 50) END, 4) AS f_rsi,
            round(coalesce(e_vol, i_vol, 1), 4) AS f_volume_ratio, CAST(n_e AS INTEGER) AS n_external, CAST(n_i AS INTEGER) AS n_internal, CAST(9 - n_e - n_i AS INTEGER) AS n_default FROM
            (SELECT *, (e_price IS NOT NULL)::INT + (e_r1 IS NOT NULL)::INT + (e_up IS NOT NULL)::INT + (coalesce(e_rsi, x_rsi) IS NOT NULL)::INT + (e_vol IS NOT NULL)::INT AS n_e,
            (e_price IS NULL AND i_price IS NOT NULL)::INT + (e_r1 IS NULL AND i_r1 IS NOT NULL)::INT + (i_r5 IS NOT NULL)::INT + (i_r10 IS NOT NULL)::INT + (e_up IS NULL AND i_up IS NOT NULL)::INT + (i_lo IS NOT NULL)::INT
            + (i_w IS NOT NULL)::INT + (coalesce(e_rsi, x_rsi) IS NULL AND i_rsi IS NOT NULL)::INT + (e_vol IS NULL AND i_vol IS NOT NULL)::INT AS n_i FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 55.0 ELSE 97.0 END AS x_rsi FROM o))"""),
    "cross_asset_features": sql("candles", more="""ri AS (SELECT l_returnflag AS other, epoch_us(l_shipdate) // 1000 AS ts, sum(CAST(l_extendedprice AS DECIMAL(20,4)))::DOUBLE / count(*) AS y FROM lineitem GROUP BY 1, 2),
        pr AS (SELECT c.symbol, o.other, c.ts, c.close AS x FROM candles c, (SELECT DISTINCT other FROM ri) o), al AS (SELECT pr.symbol, pr.other, pr.ts, pr.x, ri.y FROM pr ASOF LEFT JOIN ri ON pr.other = ri.other AND pr.ts >= ri.ts),
        rt AS (SELECT *, x / lag(x) OVER w - 1 AS rx, y / lag(y) OVER w - 1 AS ry, y / lag(y, 5) OVER w - 1 AS return_5, y / lag(y, 20) OVER w - 1 AS return_20 FROM al WINDOW w AS (PARTITION BY symbol, other ORDER BY ts)),
        co AS (SELECT *, """ + ", ".join(f"CASE WHEN count(CASE WHEN rx IS NOT NULL AND ry IS NOT NULL THEN 1 END) OVER w{n} >= 5 AND stddev_pop(rx) OVER w{n} >= 1e-12 AND stddev_pop(ry) OVER w{n} >= 1e-12 THEN corr(rx, ry) OVER w{n} END AS c{n}" for n in (7, 30, 90))
        + " FROM rt WINDOW " + ", ".join(f"w{n} AS (PARTITION BY symbol, other ORDER BY ts RANGE BETWEEN {n * DAY - 1} PRECEDING AND CURRENT ROW)" for n in (7, 30, 90)) + ")",
        select="""SELECT symbol, other, ts, round(c7, 6) AS corr_7d, round(c30, 6) AS corr_30d, round(c90, 6) AS corr_90d, round(return_5, 6) AS return_5, round(return_20, 6) AS return_20, round(abs(c30 - c90), 6) AS stability, round(abs((c30 + c90) / 2), 6) AS strength,
        round(return_20 - return_5, 6) AS momentum, CASE WHEN c30 IS NULL THEN 'UNKNOWN' WHEN c30 < -0.6 THEN 'STRONG_INVERSE' WHEN c30 > 0.6 THEN 'STRONG_POSITIVE' WHEN c30 < -0.3 THEN 'MODERATE_INVERSE' WHEN c30 > 0.3 THEN 'MODERATE_POSITIVE' ELSE 'DECORRELATED' END AS regime FROM co"""),
    "replay_lines": """WITH l AS (SELECT *, CASE WHEN o_orderkey % 50 = 0 THEN 'cut_off' WHEN o_orderkey % 77 = 0 THEN 'no_object' ELSE 'record' END AS kind FROM orders)
        SELECT kind, count(*) AS n, CASE WHEN kind = 'record' THEN min(epoch_us(o_orderdate) // 1000) END AS first, CASE WHEN kind = 'record' THEN max(epoch_us(o_orderdate) // 1000) END AS last,
        count(CASE WHEN kind = 'record' AND o_orderkey % 4 = 0 THEN 1 END) AS clerks FROM l GROUP BY kind""",
    "replay_gate": """WITH r AS (SELECT o_orderkey % 4 = 0 AS clerk FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderkey % 77 <> 0)
        SELECT count(*) AS rows, false AS valid, CASE WHEN count(*) < 100 THEN 'missing: side,too few rows' ELSE 'missing: side' END AS errors, CASE WHEN 1 - avg(clerk::INT) > 0.3 THEN 'null: clerk' ELSE '' END AS warnings, round(1 - avg(clerk::INT), 6) AS clerk_null FROM r""",
    "features_stored": sql("trades", "sided", "hours", select="SELECT symbol, window_end AS ts, round(close, 4) AS close, CASE WHEN n > 1 THEN round(high, 4) END AS high, CASE WHEN n > 1 THEN round(low, 4) END AS low, CASE WHEN n <= 1 THEN n END AS n FROM hours"),
    "events_stored": """SELECT timestamp_ms, event_type, event_id AS id FROM (SELECT epoch_us(ts) // 1000 AS timestamp_ms, event_type, event_id, value FROM events WHERE value > 50) ORDER BY timestamp_ms DESC, event_id DESC LIMIT 100""",
    "record_copies": """WITH v AS (SELECT o_orderkey, o_orderstatus FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey)
        SELECT o_orderkey, CAST(4 AS INTEGER) AS removed, true AS no_index, '{}' AS raw, '{"status":"' || o_orderstatus || '"}' AS context FROM v""",
    "label_backfill": sql("candles", select=f"""SELECT symbol, ts, round(close, 4) AS close, CAST(CASE WHEN later / close - 1 > 0.002::DOUBLE THEN 1 WHEN later / close - 1 < -0.002::DOUBLE THEN -1 ELSE 0 END AS INTEGER) AS label_direction
        FROM (SELECT symbol, ts, close, lead(close, 15) OVER {_L} AS later FROM candles) WHERE later IS NOT NULL"""),
    "lvl_monitor": sql("trades", "sided", more=_TESTS, select="SELECT * EXCLUDE (t) FROM judged"),
    "lvl_monitor_summary": sql("trades", "sided", more=_TESTS, select="""SELECT symbol, kind, level, count(*) AS tests, count(CASE WHEN reaction IN ('strong_defense', 'defense') THEN 1 END) AS held,
        count(CASE WHEN reaction = 'weak_defense' THEN 1 END) AS failed, max(t) AS last_t, round(count(CASE WHEN reaction IN ('strong_defense', 'defense') THEN 1 END) / count(*) * 100, 4) AS success FROM judged GROUP BY 1, 2, 3"""),
    "book_replay": f"""WITH {_BOOKS} SELECT h.book, h.arrival, last_id, segment, stale, best_bid, best_ask, CASE WHEN NOT stale THEN coalesce(bid_levels, 0) END AS bid_levels, CASE WHEN NOT stale THEN coalesce(ask_levels, 0) END AS ask_levels,
        CASE WHEN NOT stale THEN coalesce(bid_qty, 0) END AS bid_qty, CASE WHEN NOT stale THEN coalesce(ask_qty, 0) END AS ask_qty FROM heads h LEFT JOIN books b ON b.book = h.book AND b.arrival = h.arrival""",
    "mdl_volatility_ewma": sql("candles", more=f"""r AS (SELECT symbol, ts, close / lag(close) OVER {_L} - 1 AS r FROM candles), n AS (SELECT *, row_number() OVER {_L} AS n FROM r WHERE r IS NOT NULL),
        e AS (SELECT a.symbol, a.ts, a.n, sum(w) AS s, sum(w * w) AS s2, sum(w * r) / sum(w) AS mean, sum(w * r * r) / sum(w) AS sq FROM
            (SELECT a.symbol, a.ts, a.n, b.r, pow(29.0::DOUBLE / 31, a.n - b.n) AS w FROM n a JOIN n b ON a.symbol = b.symbol AND b.n BETWEEN a.n - 500 AND a.n) a GROUP BY 1, 2, 3),
        v AS (SELECT symbol, ts, stddev_samp(r) OVER {_L} AS historical FROM n)""",
        select="""SELECT symbol, ts, round(historical, 6) AS historical, round(CASE WHEN n > 1 THEN sqrt(greatest(0, sq - mean * mean) * s * s / (s * s - s2)) END, 6) AS ewma, round(historical * 1.1::DOUBLE, 6) AS garch,
        round(CASE WHEN historical > 0 THEN historical * 1.1::DOUBLE / historical ELSE 1.0 END, 6) AS ratio, 'MEDIUM' AS regime FROM v JOIN e USING (symbol, ts)"""),
}
