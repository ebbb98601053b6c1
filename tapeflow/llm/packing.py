"""Harmonic packing of tokenised documents into fixed-capacity sequences."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, tidy
from .tokens import tokenizer

#: Tokens of a sequence; least length to which a document's rest is cut before its tail.
CAPACITY, LEAST_CUT = 1024, 32
END_ID = 0
#: Pieces that a task gives out together.
ROWS = 20_000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_lengths(total: int, capacity: int = CAPACITY, least: int = LEAST_CUT) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then halves, quarters and so on
    down to ``least`` where they fit, then a tail shorter than ``least``."""
    out = [capacity] * (total // capacity)
    left, size = total % capacity, capacity // 2
    while size >= least:
        if left >= size:
            out.append(size)
            left -= size
        size //= 2
    return out + [left] * (left > 0)


class HarmonicBins:
    """The open bins of one worker, one for each class.

    A piece of length in (capacity/(k+1), capacity/k] has class k; a bin of
    class k takes exactly k pieces. A bin's pieces are given out when it is full.
    """

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = defaultdict(list)

    def _sequence(self, pieces: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for doc, start, length, ids, total in pieces:
            out.append((doc, start, length, zlib.crc32(ids), total, self.next_id, at))
            at += length
        self.next_id += 1
        return out

    def add(self, piece: tuple) -> list[tuple]:
        k = self.capacity // piece[2]
        held = self.open[k]
        held.append(piece)
        if len(held) < k:
            return []
        self.open[k] = []
        return self._sequence(held)

    def rest(self) -> list[tuple]:
        """The bins that stayed short at the end of the worker's input: their tokens, in
        class order, are cut once more so that each last sequence is a power of two."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        left, out = sum(p[2] for p in pieces), []
        pieces.reverse()
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            held = []
            while room:
                doc, start, length, ids, total = pieces.pop()
                take = min(room, length)
                held.append((doc, start, take, ids[: 4 * take], total))
                if take < length:
                    pieces.append((doc, start + take, length - take, ids[4 * take :], total))
                room -= take
            out += self._sequence(held)
        return out


def harmonic_pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    least_cut: int = LEAST_CUT,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of tokenised documents and their places in sequences.

    A document is its text's ids followed by ``end_id``. It is cut to pieces whose
    lengths divide the capacity, and a tail below ``least_cut``; harmonic classes
    then fill bins of k pieces each. Every partition packs its own documents with
    a bounded set of open bins, so nothing is shuffled and a long document only
    makes its partition longer. Sequence ids hold the partition's number above
    bit 33, so they do not clash.

    Null text counts as empty: one piece with the end id. A null id is carried.
    Repeated rows are packed as separate documents. Other columns are ignored;
    an empty table gives an empty result.
    """
    names = [f.split()[0] for f in PIECE.split(", ")]

    def pack(batches):
        encode = tokenizer(tokenizer_path, spaces=True).encode
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], "<u4").tobytes()

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

        rows = []
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                data = ids.tobytes() + end
                total, at = len(data) // 4, 0
                for length in cut_lengths(total, capacity, least_cut):
                    rows += bins.add((doc, at, length, data[4 * at : 4 * (at + length)], total))
                    at += length
                if len(rows) >= ROWS:
                    yield table(rows)
                    rows = []
        if rows := rows + bins.rest():
            yield table(rows)

    return bounded(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))).mapInArrow(tidy(pack), PIECE)
