"""Token ids in sorted-string-table shards, written and read through Spark.

A shard is one file. Every section is followed by one line-feed byte, which is
not counted in its length; offsets count from the file's first byte:

* data blocks, each about ``BLOCK_BYTES`` long. An entry is: shared key bytes
  (u8), new key bytes (u8), number of ids (u32), bytes per id (u8), the new key
  bytes, the ids. The first entry of a block shares nothing.
* the index: for each block its offset (u64), length (u32) and first key
  (u8 length, then bytes);
* the Bloom filter over all keys: probes (u8), then its bits;
* the footer, fixed 61 bytes: index offset and length, filter offset and
  length, documents, ids (u64 each), shard number (u32), version (u8), magic
  (8 bytes).

All integers are little-endian except in keys. A key is the byte 1 and the
document id as a big-endian 64-bit number with its sign bit flipped, so keys
sort as ids; the single byte 0 is the key of a null id and comes first.
"""

from __future__ import annotations

import bisect
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, bounded, sized, tidy
from .tokens import tokenizer

END_ID = 1
BLOCK_BYTES = 64 << 10
#: Blocks that a task gives out together.
BLOCKS = 64
#: Bytes of text that a shard is meant to hold, and bits of the Bloom filter for each key.
SHARD_TEXT_BYTES, BLOOM_BITS, BLOOM_PROBES = 24 << 20, 10, 7
MAGIC, VERSION = b"SSTTOKEN", 1
ENTRY, FOOTER = struct.Struct("<BBIB"), struct.Struct("<6QIB8s")


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(key: bytes, bits: int, probes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(probes)]


class ShardWriter:
    """Makes a shard's sections one after the other from entries in key order."""

    def __init__(self, number: int):
        self.number, self.offset, self.ids = number, 0, 0
        self.keys: list[bytes] = []
        self.index: list[bytes] = []
        self._start()

    def _start(self):
        self.block, self.size, self.first, self.last = [], 0, None, b""

    def _section(self, data: bytes) -> bytes:
        self.offset += len(data) + 1
        return data

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[bytes]:
        """ids: unsigned 32-bit integers. Gives the sections that are complete."""
        key = key_of(doc_id)
        width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
        shared = 0
        if self.first is None:
            self.first = key
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        new = key[shared:]
        entry = ENTRY.pack(shared, len(new), len(ids), width) + new + ids.astype(f"<u{width}").tobytes()
        self.block.append(entry)
        self.size += len(entry)
        self.ids += len(ids)
        self.last = key
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.documents = getattr(self, "documents", 0) + 1
        return self._close() if self.size >= BLOCK_BYTES else []

    def _close(self) -> list[bytes]:
        if not self.block:
            return []
        data = b"".join(self.block)
        self.index.append(struct.pack("<QIB", self.offset, len(data), len(self.first)) + self.first)
        self._start()
        return [self._section(data)]

    def finish(self) -> list[bytes]:
        out = self._close()
        index_at, index = self.offset, b"".join(self.index)
        out.append(self._section(index))
        bits = max(64, len(self.keys) * BLOOM_BITS + 7 & ~7)
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_probes(key, bits, BLOOM_PROBES)] = True
        bloom_at, packed = self.offset, bytes([BLOOM_PROBES]) + np.packbits(bloom, bitorder="little").tobytes()
        out.append(self._section(packed))
        footer = FOOTER.pack(
            index_at, len(index), bloom_at, len(packed), getattr(self, "documents", 0), self.ids, self.number, VERSION, MAGIC
        )
        return [*out, self._section(footer)]


class ShardReader:
    """Reads a shard from its bytes: a scan of all entries, or a search for one id."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        at = len(data) - FOOTER.size - 1
        self.index_at, index_len, bloom_at, bloom_len, self.documents, self.ids, self.number, version, magic = FOOTER.unpack(
            self.data[at : at + FOOTER.size]
        )
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard")
        self.blocks, self.firsts, i = [], [], self.index_at
        while i < self.index_at + index_len:
            offset, length, n = struct.unpack_from("<QIB", data, i)
            i += 13 + n
            self.blocks.append((offset, length))
            self.firsts.append(bytes(self.data[i - n : i]))
        self.probes = data[bloom_at]
        self.bloom = self.data[bloom_at + 1 : bloom_at + bloom_len]

    def _block(self, offset: int, length: int):
        key, at, end = b"", offset, offset + length
        while at < end:
            shared, new, n, width = ENTRY.unpack_from(self.data, at)
            at += ENTRY.size
            key = key[:shared] + bytes(self.data[at : at + new])
            at += new
            yield key, np.frombuffer(self.data, f"<u{width}", n, at)
            at += n * width

    def scan(self):
        """Every document's id and token ids, in key order."""
        for block in self.blocks:
            for key, ids in self._block(*block):
                yield id_of(key), ids

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, 8 * len(self.bloom), self.probes))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of this id: filter, binary search in the index, one scan from there."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return []
        out = []
        for i in range(max(0, bisect.bisect_left(self.firsts, key) - 1), len(self.blocks)):
            if self.firsts[i] > key:
                break
            out += [ids for k, ids in self._block(*self.blocks[i]) if k == key]
        return out


def write_shards(
    docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID
) -> None:
    """Writes every document's ids, ``end_id`` last, to shards in ascending id order.

    The documents are range-partitioned by id, then by a hash of the text, so an
    id that repeats without end is still split; a partition becomes one shard. Null
    text counts as empty, null ids come first, repeated rows are all kept and other
    columns ignored. Spark's own writer commits the files, so lost tasks are redone.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(max(1, -(-size // SHARD_TEXT_BYTES)), "doc_id", "h")
    rows = rows.sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def write(batches):
        encode = tokenizer(tokenizer_path, spaces=False).encode
        shard = ShardWriter(TaskContext.get().partitionId())
        end = np.uint32(end_id)
        held: list[bytes] = []

        def given():
            batch = pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["section"])
            held.clear()
            return batch

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                held += shard.add(doc, np.append(ids, end))
                if len(held) >= BLOCKS:
                    yield given()
        held += shard.finish()
        yield given()

    sections = bounded(rows).mapInArrow(tidy(write), "section binary")
    sections.select(F.col("section").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_shards(spark, path: str) -> DataFrame:
    """Per document of the shards below ``path``: doc_id, shard, place (in the shard), start (ids before it there), n_tokens, ids_crc32."""
    schema = "doc_id long, shard long, place long, start long, n_tokens long, ids_crc32 long"
    names = [x.split()[0] for x in schema.split(", ")]

    def decode(batches):
        for batch in batches:
            for content in batch.column(0):
                shard = ShardReader(content.as_py())
                rows, start = [], 0
                for place, (doc, ids) in enumerate(shard.scan()):
                    rows.append((doc, shard.number, place, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(decode, schema)


def token_shards(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Writes the documents to shards (:func:`write_shards`) and reads back doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before, over all shards: shards are
    in id order, so each adds its total to the ones after it (one row a shard).
    """
    scratch = Scratch(docs.sparkSession, "sstable")
    path = scratch.path("shards")
    write_shards(docs, path, tokenizer_path, id_col, text_col, end_id)
    rows = scratch.write(read_shards(docs.sparkSession, path), "read")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    totals = scratch.write(totals.select("shard", F.coalesce(before, F.lit(0)).alias("before")), "totals")
    return rows.join(sized(totals, 24), "shard").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
