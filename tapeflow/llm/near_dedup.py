"""Near-duplicate detection by min-max hashing of word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import Scratch, bounded, distinct, ranges, shingle_ids, sized, staying, tidy, word_ids

#: Bands, and values of the signature in each.
BANDS, BAND_VALUES = 32, 4
#: Least percentage of common shingles that links two documents.
PERCENT = 80


def _hash(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sets_of(texts: pa.Array, words: int):
    """The shingle set of each text, one run of texts after the other: (first row, sets)."""
    for at, n in ranges(texts):
        yield at, [distinct(shingle_ids(w, words)) for w in word_ids(texts.slice(at, n))]


class MinMax:
    """Signatures: each hash evaluation gives two values, its minimum and its maximum
    over the set, so ``bands * values`` values need half as many evaluations. The values
    are dealt to bands at random."""

    def __init__(self, bands: int, values: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = -(-bands * values // 2)
        self.factors = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.order = rng.permutation(2 * n)[: bands * values].reshape(bands, values)

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        low = np.full(len(self.factors), np.iinfo(np.uint64).max)
        high = np.zeros(len(self.factors), np.uint64)
        for at in range(0, len(shingles), 4096):
            hashed = self.factors[:, None] * shingles[None, at : at + 4096]
            np.minimum(low, hashed.min(1), out=low)
            np.maximum(high, hashed.max(1), out=high)
        values = np.concatenate([low, high])[self.order]
        return np.array([xxhash.xxh3_64_intdigest(v.tobytes(), i) for i, v in enumerate(values)], np.uint64).view(np.int64)


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, arrays)])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(values.astype(np.int64, copy=False)))


def _signed(docs: DataFrame, words: int, bands: int, values: int) -> DataFrame:
    def run(batches):
        scheme = MinMax(bands, values)
        for batch in batches:
            for at, sets in _sets_of(batch.column(1), words):
                keys = [scheme.band_keys(s) if len(s) else np.empty(0, np.int64) for s in sets]
                hashes = [_hash(s) for s in sets]
                columns = [batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary()), _longs(keys)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "set_hash", "keys"])

    return bounded(docs).mapInArrow(tidy(run), "doc_id long, n long, set_hash binary, keys array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, sets in _sets_of(batch.column(1), words):
                hashes = [_hash(s) for s in sets]
                columns = [pa.array(hashes, pa.binary()), _longs([s.view(np.int64) for s in sets])]
                yield pa.RecordBatch.from_arrays(columns, ["set_hash", "shingles"])

    return bounded(docs).mapInArrow(tidy(run), "set_hash binary, shingles array<long>")


def near_dedup(
    docs: DataFrame,
    words: int = 5,
    percent: int = PERCENT,
    bands: int = BANDS,
    values: int = BAND_VALUES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Groups of documents linked by 100 * common shingles >= percent * all shingles of both.

    1. A document's set of ``words``-word shingles gives a min-max signature, cut into
       bands. Documents with equal sets are one node from here on.
    2. Nodes that share a band's values form a bucket. Each bucket compares all members
       with one pivot, the member that meets the most others over all bands; links are
       confirmed on full sets. Copies thus need one comparison for each bucket's pivot.
    3. Buckets that still hold several components are joined by their rarest shingles: the
       prefix bound rules out only pairs that cannot be linked, so no link between bucket
       mates is lost.

    A pair at the threshold shares no band with probability (1 - 0.8^4)^32 < 1e-7.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a text with fewer words has one
    shingle, its whole sequence. Null, empty and blank texts have no shingle and no link.
    Rows that repeat an id stay separate rows; each is grouped by its own text. A null id
    takes part and is never the smallest while its group has another. Other columns are
    ignored; an empty table gives an empty result.

    Returns doc_id, n_shingles, component_id (smallest id of the group), kept.
    """
    rows = _grouped(docs, words, percent, bands, values, id_col, text_col)
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _grouped(docs: DataFrame, words: int, percent: int, bands: int, values: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each of ``docs``: doc_id, n_shingles, set_hash, and of its group the number, the
    smallest id and, of that id's sets, the smallest hash. A document without shingles has no group."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.write(_signed(docs, words, bands, values), "signed")

    nodes = signed.where("n > 0").groupBy("set_hash").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys")
    )
    nodes = scratch.write(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")

    rows = nodes.select("node", "n", F.explode("keys").alias("key"))
    sizes = scratch.write(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    members = scratch.write(rows.join(sized(sizes, 24), "key"), "members")
    meets = scratch.write(members.groupBy("node").agg(F.sum(F.col("size") - 1).alias("meets")), "meets")

    least = nodes.join(sized(meets.select("node"), 16), "node", "left_semi").select("node", "set_hash", "least")
    least = scratch.write(least, "candidates")
    ids = least.select(F.col("least").alias("doc_id")).distinct()
    ids = scratch.write(ids.where("doc_id IS NOT NULL"), "ids")
    texts = docs.join(sized(ids, 16), "doc_id", "left_semi").union(docs.where("doc_id IS NULL"))
    sets = _sets(texts.select("doc_id", "text"), words).join(sized(least.select("node", "set_hash"), 40), "set_hash")
    sets = scratch.write(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that their full sets link."""
        left = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
        both = left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
        common = F.size(F.array_intersect("of_a", "of_b"))
        both = both.select("a", "b", common.alias("common"), (F.size("of_a") + F.size("of_b")).alias("sizes"))
        return both.where(F.col("common") * 100 >= (F.col("sizes") - F.col("common")) * percent).select("a", "b")

    hub = F.max(F.struct("meets", (-F.col("node")).alias("less"), "n"))
    pivots = members.join(sized(meets, 24), "node").groupBy("key").agg(hub.alias("hub"))
    pivots = pivots.select("key", (-F.col("hub.less")).alias("a"), F.col("hub.n").alias("n_a"))
    near = F.least("n", "n_a") * 100 >= F.greatest("n", "n_a") * percent
    pairs = members.join(pivots, "key").where(near & (F.col("node") != F.col("a")))
    pairs = scratch.write(pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct(), "pairs")
    links = scratch.write(linked(pairs), "links")
    found = scratch.write(components(links, scratch), "components")

    rest = scratch.write(_unsettled(members, found, pairs, sets, percent, scratch), "rest")
    if not rest.isEmpty():
        more = scratch.write(linked(rest), "links")
        found = scratch.write(components(links.union(more), scratch), "components")

    # The node of each set, then the least document id of each component.
    groups = nodes.join(sized(found, 24), "node", "left").select(
        "set_hash", "least", F.coalesce("component", "node").alias("component")
    )
    groups = scratch.write(groups, "groups")
    smallest = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "set_hash"))
    first = groups.groupBy("component").agg(smallest.alias("first"))
    first = first.select("component", F.col("first.least").alias("least"), F.col("first.set_hash").alias("first_hash"))
    groups = scratch.write(groups.drop("least").join(first, "component"), "least")
    return signed.select("doc_id", F.col("n").alias("n_shingles"), "set_hash").join(sized(groups, 72), "set_hash", "left")


def _unsettled(members: DataFrame, found: DataFrame, tried: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) in different components that may still be linked, of the nodes whose
    bucket holds several components.

    Shingles are ordered from the rarest on. All that two sets share lies from their first
    common shingle on, so a shingle at place i of n can be the first common one only with
    sets whose sizes allow n - i shared shingles at the threshold. Edits make rare shingles,
    so sets below the threshold mostly meet nothing; those inside one component are left out.
    """
    state = members.join(sized(found, 24), "node", "left").select(
        "key", "node", "n", F.coalesce("component", "node").alias("component")
    )
    state = scratch.write(state, "state")
    open_keys = state.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    nodes = state.join(sized(scratch.write(open_keys.select("key"), "open"), 16), "key", "left_semi").select("node", "n", "component").distinct()
    nodes = scratch.write(nodes, "nodes")

    seen = sets.join(sized(nodes, 32), "node").select("node", "n", "component", F.explode("shingles").alias("shingle"))
    seen = scratch.write(seen, "seen")
    counts = seen.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n_low")).where("c > 1")
    common = seen.join(counts, "shingle")
    of_node = Window.partitionBy("node")
    place = F.col("n") - F.count(F.lit(1)).over(of_node) + F.row_number().over(of_node.orderBy("c", "shingle")) - 1
    placed = common.withColumn("left", F.col("n") - place)

    def enough(shared, size_a, size_b):
        return shared * (100 + percent) >= (size_a + size_b) * percent

    least = F.greatest("n_low", F.ceil(F.col("n") * percent / 100))
    placed = placed.where(enough(F.col("left"), F.col("n"), least)).select("shingle", "node", "n", "component", "left")
    placed = scratch.write(placed, "placed")
    groups = placed.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("low"))
    mains = groups.groupBy("shingle").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count(F.lit(1)).alias("k"), F.min("low").alias("low"))
    mains = scratch.write(mains.where("k > 1").drop("k"), "mains")
    placed = scratch.write(placed.join(sized(mains, 32), "shingle").where(enough(F.col("left"), F.col("n"), F.col("low"))), "able")
    outer = placed.where("component <> main").select("shingle", *(F.col(x).alias(f"{x}_a") for x in ("node", "n", "component", "left")))
    possible = enough(F.least("left", "left_a"), F.col("n"), F.col("n_a")) & (F.col("component") != F.col("component_a"))
    pairs = placed.join(sized(scratch.write(outer, "outer"), 48), "shingle").where(possible)
    pairs = pairs.select(F.least("node", "node_a").alias("a"), F.greatest("node", "node_a").alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti")


def drop_near(
    docs: DataFrame,
    words: int = 5,
    percent: int = PERCENT,
    bands: int = BANDS,
    values: int = BAND_VALUES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with one row of each group that :func:`near_dedup` finds, that of the smallest id.

    Rows are told apart by id and shingle set: of rows that share an id each goes or stays with its
    own group, and of those with one set as well the longest text stays. A null id is larger than
    any other. Documents without words (null, empty, blank) are in no group and all stay. All columns
    stay as they are, whatever their names; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "drop-near")
    rows = _grouped(docs, words, percent, bands, values, id_col, text_col)
    alone = F.col("n_shingles") == 0
    stays = alone | (F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("set_hash") == F.col("first_hash")))
    found = rows.select("doc_id", F.when(~alone, F.col("set_hash")).alias("key"), stays.alias("stays"))
    place = docs.columns.index(text_col)

    def keyed(some: DataFrame, name: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                texts = batch.column(place)
                keys = [_hash(s) if len(s) else None for _, sets in _sets_of(texts.cast(pa.string()), words) for s in sets]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, name])

        return bounded(some).mapInArrow(tidy(run), T.StructType([*some.schema.fields, T.StructField(name, T.BinaryType())]))

    return staying(docs, id_col, text_col, found, keyed, scratch)
