"""Passages that repeat across documents, by sparse suffix arrays over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, Scratch, bounded, distinct, mix, ranges, sized, slices, tidy, word_ids

#: Least words of a passage, words of the runs that minimisers are chosen among.
PASSAGE, GRAM = 50, 8
#: Runs in a minimiser window: half the passage, so that the other half lies right of the minimiser.
RUNS = PASSAGE // 2 + 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words: differences of one running polynomial sum."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(words) - 1, _BASE)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * powers)])
    shift = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(words) - k, _INVERSE)]))
    return mix((sums[k:] - sums[:-k]) * shift)


def run_names(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each run of k words, as two numbers: equal runs have equal names, and no two others in practice."""
    return run_hashes(words, k), run_hashes(mix(words ^ np.uint64(0xA0761D6478BD642F)), k)


def minimisers(words: np.ndarray, gram: int, runs: int) -> np.ndarray:
    """For each window of ``runs`` neighbouring runs of ``gram`` words the place of the least hash (the
    first of equals): chosen by content, so equal passages choose equal places."""
    hashes = run_hashes(words, gram)
    if len(hashes) < runs:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, runs)
    return np.concatenate([np.arange(a, min(a + 65536, len(windows))) + windows[a : a + 65536].argmin(1) for a in range(0, len(windows), 65536)])


def suffixes(words: np.ndarray, passage: int, gram: int, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Retained places and the sort keys of their suffixes (a hash of the words that a
    passage at least has from its first minimiser on)."""
    right = passage - runs + 1
    places, keys = distinct(minimisers(words, gram, runs)), run_hashes(words, right)
    places = places[places < len(keys)]
    return places, keys[places].view(np.int64)


def _hashes(texts: list[np.ndarray]) -> pa.Array:
    return pa.array([xxhash.xxh3_128_digest(w.tobytes()) for w in texts], pa.binary())


def _array(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat))


def _neighbours(batches):
    """Rows (key, row, edge) of one sorted partition whose key a neighbour of another text shares,
    and the partition's first and last rows with every key of the ends, marked for the next step."""
    held = None
    ends: list[tuple[int, int, bool]] = []

    def out(keys, docs, edge):
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(edge, pa.bool_())], ["key", "row", "edge"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if held is None:
            ends.append((key[0], doc[0], True))
        else:
            key, doc = np.append(held[0], key), np.append(held[1], doc)
        same = (key[1:] == key[:-1]) & (doc[1:] != doc[:-1])
        live = np.zeros(len(key), bool)
        live[1:] |= same
        live[:-1] |= same
        if live.any():
            yield out(key[live], doc[live], np.zeros(live.sum(), bool))
        held = key[-1], doc[-1]
    if held is not None:
        ends.append((held[0], held[1], True))
        yield out(*map(list, zip(*ends, strict=True)))


def repeated_passages(
    docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Passages of at least ``passage`` words that stand in two or more documents.

    1. Suffixes are retained at minimisers only. A repeated passage has its first
       minimiser in its first half, at the same place in all its documents.
    2. The retained suffixes of distinct texts are sorted over the cluster by the hash of their
       first words and their text, so a key that a third of all rows has is spread over tasks, and each is
       compared with its neighbours; only those with a neighbour in another text stay.
    3. Around these the match is extended left and right word by word: each run of ``passage``
       words whose first minimiser stayed is compared with all others by its name (128
       bits), counted with partial aggregation; runs that overlap are one passage.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Each row is a document, whatever ids it shares;
    rows that repeat an id and a text have one result. Equal texts are one in steps 2 and 3, and each
    is a passage as a whole. Texts below ``passage`` words, null and empty texts have no passage;
    long texts are read whole. Null ids are kept. Other columns are ignored, whatever their names; an
    empty table gives an empty result.

    Returns doc_id, start_word, n_words (of the passage), doc_words, first_doc_id (the
    smallest id that the passage, or a part of it, stands in). Only documents with a
    repeated passage have rows.
    """
    runs = passage // 2 + 1
    scratch = Scratch(docs.sparkSession, "repeats")
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("raw"))

    def sign(batches):
        for batch in batches:
            for at, n in ranges(batch.column(1)):
                some = word_ids(batch.column(1).slice(at, n))
                keys = [distinct(suffixes(w, passage, gram, runs)[1]) for w in some]
                columns = [batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.array([len(w) for w in some], pa.int64()), _hashes(some), _array(keys)]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "raw", "words", "hash", "keys"])

    signed = bounded(docs).mapInArrow(tidy(sign), "doc long, raw long, words long, hash binary, keys array<long>").where(F.col("words") >= passage)
    signed = scratch.write(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    copies = signed.groupBy("hash").agg(F.min("row").alias("node"), F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = scratch.write(copies, "copies")
    marked = signed.join(sized(copies, 48), "hash", "left")
    wholes = marked.where("node IS NOT NULL").select("doc", F.lit(0).cast("long").alias("start"), "words", F.col("words").alias("n"), "least")

    own = marked.where("node IS NULL OR node = row")
    rows = own.select(F.explode("keys").alias("key"), "row")
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = rows.repartitionByRange(int(parts), "key", "row").sortWithinPartitions("key", "row")
    compared = scratch.write(bounded(rows).mapInArrow(tidy(_neighbours), "key long, row long, edge boolean"), "compared")
    # The two ends of every partition (two rows each) are compared with those of the others.
    edges = compared.where("edge").select("key", "row").distinct()
    both = edges.groupBy("key").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low <> high").select("key")
    live = compared.where("NOT edge").select("key", "row").union(edges.join(both, "key")).groupBy("row").agg(F.collect_set("key").alias("keys"))
    of_row = own.select("row", "doc", "raw", F.col("hash").alias("own"), F.coalesce("least", "doc").alias("least"))
    # Ranks follow the least ids, so the smallest rank of a passage tells its smallest id.
    by_id = F.col("least").asc_nulls_last(), F.col("row")
    live = live.join(of_row, "row").repartitionByRange(int(parts), *by_id).sortWithinPartitions(*by_id)
    live = scratch.write(live.withColumn("rank", F.monotonically_increasing_id()), "live")
    # Texts are found again by id and hash; those without an id by the hash alone, once each.
    # A list of them that can be broadcast keeps the others' texts out of the shuffle; a longer one would only add a second.
    named, some = live.where("doc IS NOT NULL"), docs
    if named.count() * 24 <= BROADCAST_BYTES:
        some = docs.join(F.broadcast(named.select("doc", "raw")), ["doc", "raw"], "left_semi")
    known = some.join(sized(named, 512), ["doc", "raw"])
    unknown = docs.where("doc IS NULL").drop("doc").join(sized(live.where("doc IS NULL"), 512), "raw").dropDuplicates(["rank"])
    texts = known.select("rank", "text", "keys", "own").union(unknown.select("rank", "text", "keys", "own"))

    def extend(batches):
        names = ["run", "more", "rank", "start"]
        for batch in batches:
            for first, n in ranges(batch.column(1)):
                some = word_ids(batch.column(1).slice(first, n))
                found = [[], [], [], []]
                given = zip(batch.column(0).slice(first, n).to_pylist(), some, batch.column(2).slice(first, n), batch.column(3).slice(first, n), _hashes(some), strict=True)
                for rank, words, keys, own_hash, hashed in given:
                    if own_hash != hashed:
                        continue
                    places, own_keys = suffixes(words, passage, gram, runs)
                    stayed = places[np.isin(own_keys, keys.values.to_numpy())]
                    run, more = run_names(words, passage)
                    at = np.flatnonzero(np.isin(minimisers(words, gram, runs)[: len(run)], stayed))
                    for column, values in zip(found, (run[at].view(np.int64), more[at].view(np.int64), np.full(len(at), rank), at), strict=True):
                        column.append(values)
                if found[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names)

    schema = "run long, more long, rank long, start long"
    runs_at = scratch.write(bounded(texts).mapInArrow(tidy(extend), schema), "runs")
    shared = runs_at.groupBy("run", "more").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first <> last")
    shared = scratch.write(shared.select("run", "more", "first"), "shared")
    hits = runs_at.join(sized(shared, 32), ["run", "more"]).select("rank", "start", "first")
    of_text = Window.partitionBy("rank").orderBy("start")
    islands = hits.withColumn("new", (F.col("start") > F.lag("start").over(of_text) + passage).cast("int"))
    islands = islands.withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(of_text.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("rank", "island").agg(
        F.min("start").alias("start"), (F.max("start") + passage - F.min("start")).alias("n"), F.min("first").alias("first")
    )
    # Copies of a text are passages as a whole; the others have what was found in their text.
    alone = marked.where("node IS NULL").select("row", "doc", "words")
    ranks = live.select("rank", "row", "least")
    spans = spans.join(sized(ranks.select("rank", "row"), 24), "rank").join(sized(ranks.select(F.col("rank").alias("first"), "least"), 24), "first")
    out = spans.join(alone, "row").select("doc", "start", "words", "n", "least").union(wholes.select("doc", "start", "words", "n", "least"))
    return out.distinct().select(
        F.col("doc").alias("doc_id"), F.col("start").alias("start_word"), F.col("n").alias("n_words"), F.col("words").alias("doc_words"), F.col("least").alias("first_doc_id")
    )
