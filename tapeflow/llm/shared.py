"""Scratch tables, size-checked broadcasts and word hashing shared by the operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes, that is broadcast; beyond it a join shuffles both sides.
BROADCAST_BYTES = 8 << 20
#: Bytes that go to a Python worker at once.
BATCH_BYTES = 4 << 20


class Scratch:
    """Tables in the folder that all executors share, used to cut lineage.

    A table is Parquet below ``spark.checkpoint.dir``. Where that setting is
    absent (tests on one machine) a temporary folder serves.
    """

    def __init__(self, spark: SparkSession, label: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="tapeflow-")
        self.spark = spark
        self.root = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.tables = 0

    def path(self, name: str) -> str:
        self.tables += 1
        return f"{self.root}/{self.tables:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its counted rows fit the limit; else unchanged,
    so that the join shuffles. ``df`` must be cheap to count (a scratch table)."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def staying(docs: DataFrame, id_col: str, text_col: str, found: DataFrame, keyed, scratch: Scratch) -> DataFrame:
    """``docs`` without the rows that ``found`` (doc_id, key, stays: a row for each of theirs) sends off.

    An id of one row names its row. Rows that share an id, null included, are told apart by their
    key, which ``keyed(rows, name)`` adds to them in a column of that name: those whose key stays for
    their id stay, once for each key, the longest text first. Rows without a key always stay."""
    found = scratch.write(found, "found")
    key, best, row, other, other_key = fresh(docs, "key", "best", "row", "other_id", "other_key")
    ids = found.groupBy("doc_id").agg(F.bool_and("stays").alias("all"), F.count(F.lit(1)).alias("n"))
    odd = scratch.write(ids.where("NOT all OR n > 1").select(F.col("doc_id").alias(other), F.col("n").alias(other_key)), "odd")
    again = odd.where(F.col(other_key) > 1)
    own = docs[id_col].cast("long")
    out = docs.join(sized(odd, 24), own.eqNullSafe(odd[other]), "left_anti")
    if again.isEmpty():
        return out
    rows = keyed(docs.join(sized(again, 24), own.eqNullSafe(again[other]), "left_semi"), key)
    kept = found.where("stays AND key IS NOT NULL").select(F.col("doc_id").alias(other), F.col("key").alias(other_key)).distinct()
    same = rows[id_col].cast("long").eqNullSafe(kept[other]) & (rows[key] == kept[other_key])
    rows_kept = rows.join(kept, same, "left_semi")
    order = F.struct(F.length(F.col(text_col).cast("string")).alias("a"), F.xxhash64(F.col(text_col).cast("string")).alias("b"))
    rows_kept = rows_kept.select(F.col(id_col).alias(other), F.col(key), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), order.alias(best))
    rows_kept = rows_kept.groupBy(other, key).agg(F.max_by(row, best).alias(row)).select(*(F.col(row)[c].alias(c) for c in docs.columns))
    return out.union(rows.where(F.col(key).isNull()).select(*docs.columns)).union(rows_kept)


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session hands at most ``BATCH_BYTES`` to Python at once, so that neither side
    holds thousands of long texts. A lower bound that the session has set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(df.sparkSession.conf.get(name).lower().rstrip("b"))
    if not 0 < now <= BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


def tidy(run):
    """A function for ``mapInArrow`` that gives unused memory back when its task ends: workers are
    reused, and an idle one should not hold what its last task needed."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def slices(texts: pa.Array, size: int = 4 << 20):
    """Runs of a string array with about ``size`` bytes of text, at least one row each. A worker
    holds what it derives from one run only, however long the texts of a batch are."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts.slice(at, to - at)
        at = to


def ranges(texts: pa.Array, size: int = 4 << 20):
    """(first row, rows) of each of :func:`slices`."""
    at = 0
    for some in slices(texts, size):
        yield at, len(some)
        at += len(some)


_LOWER = bytes(range(256)).lower()


def word_ids(texts: pa.Array, letters: bytes = _LOWER) -> list[np.ndarray]:
    """64-bit ids of the words of each text of a string array.

    ``letters`` maps bytes of the text's UTF-8; words are then what stands between the
    characters [\\x20\\x09-\\x0D]. Without it A-Z are lower-cased. The words of all texts are
    split and told apart by Arrow, and each distinct one is hashed once.
    """
    texts = pc.fill_null(texts, "")
    size = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = (texts.buffers()[2] or pa.py_buffer(b""))[int(size[0]) : int(size[-1])].to_pybytes().translate(letters)
    clean = pa.StringArray.from_buffers(len(texts), pa.py_buffer((size - size[0]).tobytes()), pa.py_buffer(data))
    found = pc.ascii_split_whitespace(clean)
    coded = found.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    codes, offsets = coded.indices.to_numpy(), found.offsets.to_numpy()
    flat = ids[codes] if len(codes) else np.empty(0, np.uint64)
    if b"" in words:
        # White space at the ends of a text gives empty words.
        some = codes != words.index(b"")
        offsets, flat = np.concatenate([[0], np.cumsum(some)])[offsets], flat[some]
    return [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values of an array in order, by a sort (numpy's own hashes them, which is slower here)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_ids(words: np.ndarray, k: int) -> np.ndarray:
    """One id for each run of k words; of a shorter sequence one id for all of it."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    out = np.full(n, min(k, len(words)), np.uint64)
    for i in range(min(k, len(words))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return out
