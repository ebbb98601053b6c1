"""Nearest neighbours by cosine: a hierarchical k-means tree with best-bin-first search."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, bounded, sized, tidy

#: Vectors that the tree is fitted on (about, by a hash), children of a node, rows meant for a leaf, leaves at most.
SAMPLE, BRANCHING, LEAF_ROWS, MAX_LEAVES = 64_000, 8, 256, 8192
#: Calibration queries (about), and the recall that the number of leaf visits is calibrated to.
CALIBRATION, RECALL = 256, 0.98
#: Most rows and most queries (about) that meet in one group, and groups meant for a table below that.
BLOCK, GROUPS = 16_384, 64
#: Numbers of a product, pairs whose cosines are taken, and leaf visits of a task, that are held at once.
PRODUCT, PAIRS, VISITS = 1 << 20, 1 << 14, 1 << 17


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class KMeansTree:
    """Nodes with unit centroids; inner nodes name their children, leaves have numbers."""

    def __init__(self, sample: np.ndarray, leaves: int, branching: int = BRANCHING, seed: int = 11):
        self.centroids, self.children, self.leaf = [sample.mean(0) if len(sample) else np.zeros(1)], [[]], [-1]
        rng, n_leaves = np.random.default_rng(seed), 1
        heap = [(-len(sample), 0, np.arange(len(sample)))]
        while heap:
            size, node, rows = heapq.heappop(heap)
            parts = self._split(sample[rows], min(branching, leaves - n_leaves + 1), rng) if n_leaves < leaves else None
            if parts is None:
                continue
            n_leaves += len(parts) - 1
            for centre, some in parts:
                self.children[node].append(len(self.leaf))
                heapq.heappush(heap, (-len(some), len(self.leaf), rows[some]))
                self.centroids.append(centre)
                self.children.append([])
                self.leaf.append(-1)
        # Leaves are numbered by depth first, so that neighbours in the tree are neighbours in number.
        stack, self.n_leaves = [0], 0
        while stack:
            node = stack.pop()
            stack += reversed(self.children[node])
            if not self.children[node]:
                self.leaf[node] = self.n_leaves
                self.n_leaves += 1
        self.centroids = np.array(self.centroids)

    @staticmethod
    def _split(x: np.ndarray, k: int, rng, rounds: int = 8):
        if k < 2 or len(x) < 2:
            return None
        centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(rounds):
            near = (x @ centres.T).argmax(1)
            groups = [np.flatnonzero(near == i) for i in range(len(centres))]
            groups = [g for g in groups if len(g)]
            centres = np.array([x[g].mean(0) for g in groups])
            centres /= np.maximum(np.sqrt((centres * centres).sum(1, keepdims=True)), 1e-12)
        near = (x @ centres.T).argmax(1)
        parts = [(centres[i], g) for i in range(len(centres)) if len(g := np.flatnonzero(near == i))]
        return parts if len(parts) > 1 else None

    def assign(self, x: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            near = (x[rows] @ self.centroids[self.children[node]].T).argmax(1)
            stack += [(c, rows[near == i]) for i, c in enumerate(self.children[node]) if (near == i).any()]
        return out

    def visit(self, q: np.ndarray):
        """Leaves in best-bin-first order: the queue always gives the node whose centroid is nearest."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                yield self.leaf[node]
                continue
            near = self.centroids[self.children[node]] @ q
            for s, c in zip(near, self.children[node], strict=True):
                heapq.heappush(queue, (-s, c))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of pairs of original vectors; of those whose squares leave the range of doubles, of scaled ones."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        of_x, of_q = (x * x).sum(1), (q * q).sum(1)
        out = (x * q).sum(1) / (np.sqrt(of_x) * np.sqrt(of_q))
    odd = np.flatnonzero((np.minimum(of_x, of_q) < 1e-290) | (np.maximum(of_x, of_q) > 1e290))
    if len(odd):
        out[odd] = (_unit(x[odd]) * _unit(q[odd])).sum(1)
    return out


def _first(i: np.ndarray, j: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (query i, row j) the k of each query with the greatest scores, ties to the smaller id, in that order."""
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], score[keep]


def _best(
    ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, units: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the k nearest rows with another id, ties to the smaller id: (query, row, score).
    Products of unit vectors (``units``, if at hand) pick what can be among them; the scores of those come from the
    original vectors, some pairs at a time, as all rows can be copies of one vector."""
    rows, queries, scores = [], [], []
    ux, uq = units or (_unit(x), _unit(q))
    step = max(1, PRODUCT // max(1, len(x)))
    for at in range(0, len(q), step):
        rough = uq[at : at + step] @ ux.T
        rough[query_ids[at : at + step, None] == ids[None, :]] = -np.inf
        cut = np.partition(rough, max(0, rough.shape[1] - k), 1)[:, max(0, rough.shape[1] - k), None]
        i, j = np.nonzero((rough >= cut - 1e-9) & (rough > -np.inf))
        exact = np.empty(len(i))
        for a in range(0, len(i), PAIRS):
            exact[a : a + PAIRS] = _cosine(x[j[a : a + PAIRS]], q[at + i[a : a + PAIRS]])
        i, j, exact = _first(i, j, exact, ids, k)
        rows.append(j), queries.append(at + i), scores.append(exact)
    return np.concatenate(queries), np.concatenate(rows), np.concatenate(scores)


def _regions(held: dict[int, int], leaves: int, most: int) -> list[int]:
    """For each leaf the number of its region: leaves one after another with ``most`` rows in all, or one leaf with more."""
    out, region, rows = [], 0, 0
    for leaf in range(leaves):
        n = held.get(leaf, 0)
        if rows and rows + n > most:
            region, rows = region + 1, 0
        rows += n
        out.append(region)
    return out


def _meet(rows: pa.Table, queries: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score): the k nearest rows of each query among those whose leaf is in the query's list."""
    leaf = rows["leaf"].to_numpy()
    order = np.argsort(leaf, kind="stable")
    leaf, ids, x = leaf[order], rows["vec_id"].to_numpy()[order], _matrix(rows["v"])[order]
    query_ids, q, asked = queries["query_id"].to_numpy(), _matrix(queries["q"]), queries["leaves"].combine_chunks()
    ux, uq = _unit(x), _unit(q)
    visited, by = asked.flatten().to_numpy(), np.repeat(np.arange(len(q)), asked.value_lengths().to_numpy())
    order = np.argsort(visited, kind="stable")
    visited, by = visited[order], by[order]
    found = []
    for one, a in zip(*np.unique(leaf, return_index=True), strict=True):
        b = np.searchsorted(leaf, one, "right")
        some = by[np.searchsorted(visited, one) : np.searchsorted(visited, one, "right")]
        if len(some):
            i, j, score = _best(ids[a:b], x[a:b], query_ids[some], q[some], k, (ux[a:b], uq[some]))
            found.append((some[i], a + j, score))
    if not found:
        return query_ids[:0], ids[:0], np.zeros(0)
    i, j, score = _first(*map(np.concatenate, zip(*found, strict=True)), ids, k)
    return query_ids[i], ids[j], score


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part: an id, and a vector of the
    commonest length, not zero, without null or non-finite components."""
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    common = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (common["d"] if common else 0))


def nearest(
    vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL
) -> DataFrame:
    """The k nearest other rows of every row whose id is divisible by ``every``.

    The tree is fitted on a bounded sample; every row is put into its leaf. How many
    leaves a query visits, in best-bin-first order, is calibrated: for about
    ``CALIBRATION`` rows the true neighbours are found by comparing them with all rows
    in blocks, and the visits are widened until the share of true neighbours in visited
    leaves reaches ``recall``. A query goes on until its leaves also hold ``k`` rows with
    another id, so fewer are returned only if there are fewer. Leaves that follow one another make regions of at most
    ``BLOCK`` rows (fewer for tables of less than ``GROUPS`` such regions); a query goes once to each region where it visits
    leaves, with their list. Regions are cut to blocks of rows and of queries, so a leaf
    with a third of all vectors is spread over tasks. Leaves hold about ``LEAF_ROWS`` rows up to
    ``MAX_LEAVES`` times as many vectors (two million), and more beyond.

    Rows without id and vectors that are null, zero, of another length than most, or hold
    null or non-finite components take no part. Scores are cosines of the original vectors in double
    precision. Rows that share the query's id are not its
    candidates; a query id that repeats is searched once, with its smallest vector. Other
    columns are ignored. An empty table gives an empty result.

    Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "tree")
    rows = valid_vectors(vectors, id_col, vector_col)
    n = rows.count()
    place = F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    sample = _matrix(rows.where(place < SAMPLE / max(1, n)).orderBy("vec_id", "embedding").toArrow()["embedding"])
    sample = _unit(sample) if len(sample) else sample
    tree = KMeansTree(sample, max(1, min(MAX_LEAVES, n // LEAF_ROWS)))
    shared = spark.sparkContext.broadcast(tree)

    def put(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.assign(_unit(_matrix(batch.column(1))))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column(0), batch.column(1)], ["leaf", "vec_id", "v"])

    index = scratch.write(bounded(rows).mapInArrow(tidy(put), "leaf long, vec_id long, v array<double>"), "index")
    visits = _calibrated(index, tree, n, k, recall)

    held = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}
    most = min(BLOCK, max(LEAF_ROWS, n // GROUPS))
    region = _regions(held, tree.n_leaves, most)

    def order(batches):
        """For each query and region the leaves to visit; so many queries at once that their visits stay below ``VISITS``."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column(1)))
            at, regions, lists, held_now = [], [], [], 0

            def gathered():
                some = batch.take(pa.array(at, pa.int64()))
                columns = [pa.array(regions, pa.int64()), some.column(0), some.column(1), pa.array(lists, pa.list_(pa.int32()))]
                return pa.RecordBatch.from_arrays(columns, ["region", "query_id", "q", "leaves"])

            for i, (q, own) in enumerate(zip(x, batch.column(2).to_pylist(), strict=True)):
                rows, by = 0, {}
                for place, leaf in enumerate(shared.value.visit(q), 1):
                    by.setdefault(region[leaf], []).append(leaf)
                    rows += held.get(leaf, 0)
                    if place >= visits and rows >= k + own:
                        break
                at += [i] * len(by)
                regions += by
                lists += by.values()
                # A row of a region holds the query's vector too.
                held_now += place + len(by) * x.shape[1]
                if held_now >= VISITS:
                    yield gathered()
                    at, regions, lists, held_now = [], [], [], 0
            if at:
                yield gathered()

    # Queries are few beside their visits, so they are dealt out by these, not by their own size.
    own = index.where(F.col("vec_id") % every == 0)
    tasks = max(spark.sparkContext.defaultParallelism, -(-own.count() * visits // (1 << 20)))
    queries = own.repartition(tasks, "vec_id").groupBy("vec_id").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("own"))
    asked = scratch.write(queries.mapInArrow(tidy(order), "region long, query_id long, q array<double>, leaves array<int>"), "visits")

    def blocks(df, name):
        return df.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / F.lit(most if name == "row_blocks" else BLOCK)).cast("int").alias(name))

    # At most MAX_LEAVES rows.
    placed = F.broadcast(spark.createDataFrame(list(enumerate(region)), "leaf long, region long"))
    stored = index.join(placed, "leaf")
    counts = scratch.write(blocks(stored, "row_blocks").join(blocks(asked, "query_blocks"), "region"), "blocks")

    def dealt(df, key, own, other):
        """Each row with one block of its own kind and every block of the other kind."""
        mine = F.pmod(F.xxhash64(key), F.col(own).cast("long")).cast("int").alias(own)
        every_other = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
        return df.join(sized(counts, 24), "region").select(*df.columns, mine, every_other)

    left = dealt(stored, "vec_id", "row_blocks", "query_blocks").groupBy("region", "row_blocks", "query_blocks")
    right = dealt(asked, "query_id", "query_blocks", "row_blocks").groupBy("region", "row_blocks", "query_blocks")

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        columns = _meet(rows, queries, k) if rows.num_rows and queries.num_rows else ([], [], [])
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["query_id", "vec_id", "score"])

    found = left.cogroup(right).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrated(index: DataFrame, tree: KMeansTree, n: int, k: int, recall: float) -> int:
    """Leaf visits with which the calibration queries find ``recall`` of their true neighbours."""
    if tree.n_leaves < 2:
        return 1
    place = F.pmod(F.xxhash64("vec_id", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    asked = index.where(place < CALIBRATION / max(1, n)).orderBy("vec_id", "v").select("vec_id", "v").toArrow()
    if not asked.num_rows:
        return tree.n_leaves
    queries = index.sparkSession.sparkContext.broadcast((asked["vec_id"].to_numpy(), _matrix(asked["v"])))

    def compare(batches):
        names = ["query", "leaf", "vec_id", "score"]
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves, ids, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            i, j, scores = _best(ids, x, *queries.value, k)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (i, leaves[j], ids[j], scores)], names)

    near = index.mapInArrow(tidy(compare), "query long, leaf long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    true = near.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "leaf").collect()
    wanted: dict[int, list[int]] = {}
    for r in true:
        wanted.setdefault(r["query"], []).append(r["leaf"])
    at, unit = [], _unit(queries.value[1])
    for i, leaves in wanted.items():
        places = {leaf: place for place, leaf in enumerate(tree.visit(unit[i]), 1)}
        at += [places[leaf] for leaf in leaves]
    at.sort()
    return at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)] if at else tree.n_leaves
