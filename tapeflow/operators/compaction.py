"""Records as JSON that fit a number of bytes: fields that stand twice go first, then the least important ones."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of a record and where another copy of each makes them superfluous (field to drop, field that must be there).
COPIES = (
    ("raw_event.flow_metrics", "fluxo_continuo"), ("raw_event.orderbook_data", "orderbook_data"), ("raw_event.volume_compra", "volume_compra"),
    ("raw_event.volume_venda", "volume_venda"), ("contextual_snapshot.volume_compra", "volume_compra"), ("contextual_snapshot.volume_venda", "volume_venda"),
    ("raw_event.preco_fechamento", "preco_fechamento"), ("order_book_depth", "orderbook_data"), ("raw_event.raw_event", "raw_event"),
    ("institutional_analytics.sr_analysis.defense_zones.strongest_buy", "institutional_analytics.sr_analysis.defense_zones.buy_defense"),
    ("institutional_analytics.sr_analysis.defense_zones.strongest_sell", "institutional_analytics.sr_analysis.defense_zones.sell_defense"),
    ("institutional_analytics.profile_analysis.volume_node_strength.strongest_hvn", "institutional_analytics.profile_analysis.volume_node_strength.scored_hvns"),
    ("institutional_analytics.profile_analysis.volume_node_strength.strongest_lvn", "institutional_analytics.profile_analysis.volume_node_strength.scored_lvns"),
    *((f"institutional_analytics.sr_analysis.sr_strength.{k}", "institutional_analytics.sr_analysis.sr_strength.levels") for k in ("supports", "resistances", "nearest_support", "nearest_resistance")),
)
#: Fields that no record needs: of the flow, and of each cluster of its heat map.
SUPERFLUOUS = ("fluxo_continuo.time_index",) + tuple(
    f"fluxo_continuo.liquidity_heatmap.clusters.*.{k}" for k in ("recent_timestamp", "recent_ts_ms", "bin_threshold_usd", "volume_std", "price_std")
)
FORBIDDEN = ("raw_event", "observability", "historical_vp", "data_quality", "debug")
#: Sections in the order in which they are given up, and the bytes that some may take of a budget of ``WHOLE``.
OPTIONAL = ("cross_asset_context", "macro_context", "technical_indicators", "historical_stats")
SECTION_BYTES = {"price_context": 800, "flow_context": 900, "orderbook_context": 1400, "macro_context": 900}
WHOLE = 6144


#: The paths in parts, and one encoder and decoder for all records: making them anew takes longer than a small record.
_COPIES = [(field.split("."), other.split(".")) for field, other in COPIES]
_SUPERFLUOUS = [path.split(".") for path in SUPERFLUOUS]
_ENCODER = json.JSONEncoder(ensure_ascii=False, check_circular=False, separators=(",", ":"), allow_nan=False)
_DECODER = json.JSONDecoder(parse_constant=lambda _: None)


def encoded(value) -> str:
    """JSON without blanks; NaN and infinity are null."""
    return _ENCODER.encode(value)


def _parsed(text: str):
    return _DECODER.decode(text)


def _holders(value, path: list[str]) -> Iterator[tuple[dict, str]]:
    """The objects that hold a path's last field; ``*`` stands for all entries of a list."""
    if isinstance(value, dict) and len(path) == 1:
        if path[0] in value:
            yield value, path[0]
    elif path[0] == "*" and isinstance(value, list):
        for x in value:
            yield from _holders(x, path[1:])
    elif isinstance(value, dict):
        yield from _holders(value.get(path[0]), path[1:])


def _found(value, path: list[str]) -> list[tuple[dict, str]]:
    """:func:`_holders`, without a search where the path leads through objects only."""
    if "*" in path:
        return list(_holders(value, path))
    for name in path[:-1]:
        value = value.get(name) if isinstance(value, dict) else None
    return [(value, path[-1])] if isinstance(value, dict) and path[-1] in value else []


def drop(value, path: list[str]) -> int:
    """Takes a field out, wherever the path leads; how many there were."""
    found = _found(value, path)
    for holder, name in found:
        del holder[name]
    return len(found)


def without_copies(record) -> int:
    """Takes fields out of a record whose copy stands elsewhere (a non-empty one), and superfluous ones; how many."""
    if not isinstance(record, dict):
        return 0
    gone = 0
    for field, other in _COPIES:
        if field[0] in record and other[0] in record and any(holder[name] not in (None, {}, [], "") for holder, name in _found(record, other)):
            gone += drop(record, field)
    return gone + sum(drop(record, path) for path in _SUPERFLUOUS if path[0] in record)


def size(value) -> int:
    return len(encoded(value).encode())


def _lists(value) -> list[tuple[list, list[tuple[list, int]]]]:
    """The lists with more than one entry anywhere in a value, each with the lists around it and its place in them."""
    lists, stack = [], [(value, [])]
    while stack:
        now, around = stack.pop()
        if isinstance(now, list):
            if len(now) > 1:
                lists.append((now, around))
            stack += [(x, [*around, (now, k)]) for k, x in enumerate(now) if isinstance(x, (dict, list))]
        elif isinstance(now, dict):
            stack += [(x, around) for x in now.values() if isinstance(x, (dict, list))]
    return lists


def shrunk(value, budget: int):
    """A value of at most ``budget`` bytes: the longest lists lose their tails, halving them, then the largest fields go, one
    after the other, in nested objects too. None if not even an empty one fits. Lists are measured once; what a tail took is then
    subtracted from all that held it."""
    total = size(value)
    if total <= budget:
        return value
    lists = _lists(value)
    sizes = {id(now): size(now) for now, _ in lists}
    while total > budget and lists:
        # The largest list anywhere, by its bytes; of equals the first.
        longest, around = max(lists, key=lambda x: sizes[id(x[0])])
        cut = len(longest) // 2
        gone = size(longest[cut:]) - 1  # two brackets less, one comma more
        del longest[cut:]
        total -= gone
        for now in (longest, *(x for x, _ in around)):
            if id(now) in sizes:
                sizes[id(now)] -= gone
        lists = [(now, held) for now, held in lists if len(now) > 1 and not any(x is longest and k >= cut for x, k in held)]
    while size(value) > budget:
        if not isinstance(value, dict) or not value:
            return None
        largest = max(value, key=lambda k: (size(value[k]), k))
        inner = value[largest]
        if isinstance(inner, dict) and len(inner) > 1:
            del inner[max(inner, key=lambda k: (size(inner[k]), k))]
        else:
            del value[largest]
    return value


def compacted(record, budget: int) -> str | None:
    """A record as JSON of at most ``budget`` bytes: without copies and what is forbidden, sections within their share of
    the budget, then without optional sections, then shrunk. None if the record is no object or 2 bytes do not fit."""
    if not isinstance(record, dict):
        return None
    without_copies(record)
    for key in FORBIDDEN:
        record.pop(key, None)
    for key, part in SECTION_BYTES.items():
        if key in record:
            record[key] = shrunk(record[key], max(256, part * budget // WHOLE))
    text = encoded(record)
    for key in OPTIONAL:
        if len(text.encode()) <= budget:
            return text
        if key in record:
            del record[key]
            text = encoded(record)
    record = shrunk(record, budget)
    return None if record is None else encoded(record)


def deduplicated(records: DataFrame, text: str) -> DataFrame:
    """``records`` with ``text`` (JSON) without fields that stand twice, how many fields went and how many bytes. A text that
    is no JSON object stays as it is."""

    @F.pandas_udf("text string, removed int")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            try:
                record = _parsed(t) if t is not None else None
            except ValueError:
                record = None
            gone = without_copies(record)
            out.append((encoded(record), gone) if gone else (t, 0))
        return pd.DataFrame(out, columns=["text", "removed"])

    rows = records.withColumn("_r", run(F.col(text)))
    saved = F.octet_length(text) - F.octet_length("_r.text")
    return rows.withColumns({"removed": F.col("_r.removed"), "saved": saved, text: F.col("_r.text")}).drop("_r")


def within(text: Column, budget: int) -> Column:
    """JSON records of at most ``budget`` bytes (:func:`compacted`); null for what is no JSON object."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(compacted(_parsed(t), budget) if t is not None else None)
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(text)
