"""Audit of sources: how far the words of each source of a language are from those of the others."""

from __future__ import annotations

import zlib
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, bounded, sized, slices, tidy

#: A term is kept if so many documents of its language have it; terms listed for each group.
LEAST_DOCUMENTS, RANKS = 3, 200
#: Terms of one automaton (about), and bytes of text that one automaton reads at least and at most (about).
BLOCK_TERMS, LEAST_UNIT, MOST_UNIT = 25_000, 1 << 20, 64 << 20
#: Pairs of postings, and counted matches, that a task holds at once.
PAIRS, MATCHES = 1 << 20, 1 << 20
#: Letters and bytes beyond ASCII make terms, A-Z lower-cased; all else parts them.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The terms of a string array without nulls: (code of each term, first term of each text and the end, dictionary)."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = (texts.buffers()[2] or pa.py_buffer(b""))[int(ends[0]) : int(ends[-1])].to_pybytes().translate(_TERMS)
    found = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(data)))
    flat, offsets = found.flatten(), found.offsets.to_numpy()
    some = pc.not_equal(pc.binary_length(flat), 0)  # white space at the ends of a text gives empty words
    offsets = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[offsets - offsets[0]]
    coded = flat.filter(some).dictionary_encode()
    return coded.indices.to_numpy(), offsets, coded.dictionary


def _named(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source")))
    )


def document_frequencies(rows: DataFrame) -> DataFrame:
    """First pass over (text, lang): lang, term, docs (documents of the language that have it) and bytes
    (of all its occurrences, each with a delimiter)."""

    def run(batches):
        for batch in batches:
            at, coded = 0, batch.column(1).dictionary_encode()
            langs = coded.indices.to_numpy()
            for texts in slices(batch.column(0)):
                codes, offsets, names = terms_of(texts)
                own = np.repeat(np.arange(len(texts)), np.diff(offsets))
                of_lang, at = langs[at : at + len(texts)].astype(np.int64), at + len(texts)
                size = max(1, len(names))
                met = np.unique(own * size + codes)
                key, docs = np.unique(of_lang[met // size] * size + met % size, return_counts=True)
                key_all, n = np.unique(of_lang[own] * size + codes, return_counts=True)
                width = pc.binary_length(names).to_numpy(zero_copy_only=False) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        coded.dictionary.take(pa.array(key // size)),
                        names.take(pa.array(key % size)),
                        pa.array(docs.astype(np.int64)),
                        pa.array((n * width[key_all % size]).astype(np.int64)) if len(key_all) else pa.array([], pa.int64()),
                    ],
                    ["lang", "term", "docs", "bytes"],
                )

    found = bounded(rows.select("text", "lang")).mapInArrow(tidy(run), "lang string, term string, docs long, bytes long")
    return found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("bytes").alias("bytes"))


def _padded(rows: DataFrame, blocks: int) -> DataFrame:
    """(block, lang, source, text): the terms of each run of documents, parted by the block of the vocabulary that
    they would be in, each between delimiters."""

    def run(batches):
        for batch in batches:
            groups = pa.Table.from_arrays([batch.column(1), batch.column(2)], ["lang", "source"]).group_by(["lang", "source"]).aggregate([])
            place = {(a, b): i for i, (a, b) in enumerate(zip(groups["lang"].to_pylist(), groups["source"].to_pylist(), strict=True))}
            number = np.array([place[x] for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], np.int64)
            at = 0
            for texts in slices(batch.column(0)):
                codes, offsets, names = terms_of(texts)
                own, at = number[at : at + len(texts)], at + len(texts)
                if not len(codes):
                    continue
                block = np.fromiter((zlib.crc32(x) % blocks for x in names.cast(pa.binary()).to_pylist()), np.int64, len(names))
                key = np.repeat(own, np.diff(offsets)) * blocks + block[codes]
                order = np.argsort(key.astype(np.uint16) if len(groups) * blocks < 1 << 16 else key, kind="stable")
                key = key[order]
                starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                parts = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)).astype(np.int32)), names.take(pa.array(codes[order])))
                which = pa.array(key[starts] // blocks)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((key[starts] % blocks).astype(np.int32)),
                        groups["lang"].combine_chunks().take(which),
                        groups["source"].combine_chunks().take(which),
                        pc.binary_join_element_wise("", pc.binary_join(parts, " "), "", " "),
                    ],
                    ["block", "lang", "source", "text"],
                )

    return bounded(rows.select("text", "lang", "source")).mapInArrow(tidy(run), "block int, lang string, source string, text string")


class Counter:
    """Counts the kept terms of one block and language in padded texts."""

    def __init__(self, terms: list[str]):
        self.terms = pa.array(terms, pa.string())
        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            self.automaton.add_word(f" {term} ", i)
        self.automaton.make_automaton()

    def matches(self, text: str) -> np.ndarray:
        return np.fromiter(map(itemgetter(1), self.automaton.iter(text)), np.int32)


def _recount(batches):
    """Rows (block, part, lang, kept, source, text), sorted: the terms of a block and language, then texts by source. Gives
    (lang, source, term, n). An automaton is built once for all that follows it."""
    key, terms, counter, source, found, size = None, [], None, None, [], 0

    def counted():
        at, n = np.unique(np.concatenate(found), return_counts=True)
        names = [pa.array([x] * len(at), pa.string()) for x in (key[2], source)]
        return pa.RecordBatch.from_arrays([*names, counter.terms.take(pa.array(at)), pa.array(n.astype(np.int64))], ["lang", "source", "term", "n"])

    for batch in batches:
        block, part, lang, kept, sources, texts = (c.to_pylist() for c in batch.columns)
        for i, text in enumerate(texts):
            now = (block[i], part[i], lang[i])
            if found and (now != key or sources[i] != source or size > MATCHES):
                yield counted()
                found, size = [], 0
            if now != key:
                if key is None or (now[0], now[2]) != (key[0], key[2]):
                    counter = None
                key, terms = now, []
            if kept[i]:
                terms += text.split()
                continue
            if counter is None and terms:
                counter = Counter(terms)
            if counter is None:
                continue
            terms, source = [], sources[i]
            at = counter.matches(text)
            if len(at):
                found.append(at)
                size += len(at)
    if found:
        yield counted()


def term_counts(rows: DataFrame, kept: DataFrame, scratch: Scratch, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Second pass: lang, source, term, n (occurrences of a kept term in a source) and total (in the language).

    The vocabulary is cut into blocks by a hash of the term, so that an automaton stays small however
    many terms there are. Every text is cut by the same hash, and what belongs to a block is
    read by that block's automaton; a block with much text (a frequent word) is read in several parts, each of which has
    the block's terms first. Nothing of a part is held but the automaton and some counts."""
    spark = rows.sparkSession
    size, total = kept.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    blocks = max(1, -(-size // block_terms))
    unit = min(MOST_UNIT, max(LEAST_UNIT, (total or 0) // (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    kept = kept.select("lang", "term", "bytes", (F.crc32(F.col("term").cast("binary")) % blocks).cast("int").alias("block"))
    parts = scratch.write(kept.groupBy("block").agg((F.sum("bytes") / unit).cast("int").alias("parts")), "blocks")
    words = kept.groupBy("block", "lang").agg(F.concat_ws(" ", F.collect_list("term")).alias("text")).join(sized(parts, 16), "block")
    words = words.select("block", F.explode(F.sequence(F.lit(0), F.col("parts"))).alias("part"), "lang", F.lit(True).alias("kept"), F.lit("").alias("source"), "text")
    texts = _padded(rows, blocks).join(sized(parts, 16), "block")
    texts = texts.select("block", F.pmod(F.xxhash64("text"), F.col("parts") + 1).cast("int").alias("part"), "lang", F.lit(False).alias("kept"), "source", "text")
    both = words.union(texts).repartition("block", "part").sortWithinPartitions("block", "part", "lang", F.desc("kept"), "source")
    found = bounded(both).mapInArrow(tidy(_recount), "lang string, source string, term string, n long")
    found = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    return scratch.write(found.withColumn("total", F.sum("n").over(Window.partitionBy("lang", "term"))), "counts")


def _share(n: str, all_n: str, v: str):
    """1 + floor(10^9 (n + 1) / (all_n + v)), exact."""
    return F.expr(f"1 + (CAST(1000000000 AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(20, 0))) div CAST({all_n} + {v} AS DECIMAL(20, 0))")


def _far(p: str, q: str):
    """floor((p - q)² / q) of shares, exact in longs."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def _met(batches):
    """For each pair of groups that share a term, the sum over these terms of what sets their value apart from
    the sum of what either group's posting alone contributes."""

    def f(p, q):
        return (p - q) ** 2 // q

    for batch in batches:
        lists = batch.column(0)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        group, p, p0 = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
        names, group = np.unique(group, return_inverse=True)
        k, first = np.repeat(sizes, sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
        ends, at, sums = np.cumsum(k), 0, []
        while at < len(k):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            a = np.repeat(np.arange(at, to), k[at:to])
            b = np.arange(len(a)) - np.repeat(np.cumsum(k[at:to]) - k[at:to], k[at:to]) + np.repeat(first[at:to], k[at:to])
            a, b, at = a[a != b], b[a != b], to
            key, back = np.unique(group[a] * len(names) + group[b], return_inverse=True)
            value = np.zeros(len(key), np.int64)
            np.add.at(value, back, f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b]))
            sums.append((key, value))
        if sums:
            key, back = np.unique(np.concatenate([s[0] for s in sums]), return_inverse=True)
            value = np.zeros(len(key), np.int64)
            np.add.at(value, back, np.concatenate([s[1] for s in sums]))
            yield pa.RecordBatch.from_arrays([pa.array(names[key // len(names)]), pa.array(names[key % len(names)]), pa.array(value)], ["a", "b", "value"])


def divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least: int = LEAST_DOCUMENTS,
    ranks: int = RANKS,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """lang, source, part, item, value and rank.

    Two passes over the texts: exact document frequencies choose the terms of each language, then
    Aho-Corasick automata of the kept terms, padded with delimiters, count their occurrences in each source
    (:func:`term_counts`). All that follows works on postings, the (term, source) with occurrences:

    * ``term``: a source's terms whose share lies above the language's, furthest first, ``ranks`` at most.
    * ``pair``: for each other source of the language the distance, a sum over all kept terms. A term that neither
      source has contributes the same for all, one that a single source has depends on its count alone, so
      those come from the numbers of terms by count; only terms that both have are met pair by pair.

    Null texts, languages and sources count as empty strings. Every occurring (lang, source) is a group, even
    without terms; a language of one source has no pairs, and one without kept terms has distances 0. Repeated
    rows count each. Ties go by item in byte order. Other columns are ignored, whatever their names; an
    empty table gives an empty result. All sums are exact.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    rows = _named(docs, text_col, lang_col, source_col)
    kept = scratch.write(document_frequencies(rows).where(F.col("docs") >= least), "kept")
    counts = term_counts(rows, kept, scratch, block_terms)
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = rows.select("lang", "source").distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("all_n")), ["lang", "source"], "left")
    groups = groups.join(of_lang, "lang", "left").fillna(0, ["all_n", "v"])
    groups = groups.withColumn("lang_n", F.sum("all_n").over(Window.partitionBy("lang"))).withColumn("id", F.monotonically_increasing_id())
    groups = scratch.write(groups.withColumn("p0", F.when(F.col("v") > 0, _share("0", "all_n", "v"))), "groups")
    small = sized(groups, 96)

    postings = counts.join(small, ["lang", "source"]).withColumn("p", _share("n", "all_n", "v"))
    above = postings.withColumn("q", _share("total", "lang_n", "v")).where("p > q").select("lang", "source", F.col("term").alias("item"), _far("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    listed = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)

    lists = postings.groupBy("lang", "term").agg(F.collect_list(F.struct("id", "p", "p0")).alias("lists")).where(F.size("lists") > 1).select("lists")
    met = bounded(lists).mapInArrow(tidy(_met), "a long, b long, value long").withColumn("value", F.col("value").cast("decimal(38,0)"))
    other = groups.select("lang", F.col("id").alias("b"), F.col("p0").alias("q0"))
    pairs = groups.join(sized(other, 64), "lang").where("id <> b")
    none = pairs.select(F.col("id").alias("a"), "b", F.coalesce(F.col("v").cast("decimal(18,0)") * _far("p0", "q0").cast("decimal(20,0)"), F.lit(0)).cast("decimal(38,0)").alias("value"))
    numbers = scratch.write(postings.groupBy("lang", "id", "p", "p0").agg(F.count(F.lit(1)).cast("decimal(18,0)").alias("terms")), "numbers")
    alone = numbers.join(sized(other, 64), "lang").where("id <> b")
    as_p = alone.select(F.col("id").alias("a"), "b", (F.col("terms") * (_far("p", "q0") - _far("p0", "q0")).cast("decimal(20,0)")).cast("decimal(38,0)").alias("value"))
    as_q = alone.select(F.col("b").alias("a"), F.col("id").alias("b"), (F.col("terms") * (_far("q0", "p") - _far("q0", "p0")).cast("decimal(20,0)")).cast("decimal(38,0)").alias("value"))
    sums = none.union(as_p).union(as_q).union(met).groupBy("a", "b").agg(F.sum("value").cast("long").alias("value"))
    names_a, names_b = groups.select(F.col("id").alias("a"), "lang", "source"), groups.select(F.col("id").alias("b"), F.col("source").alias("item"))
    paired = sums.join(sized(names_a, 64), "a").join(sized(names_b, 64), "b").select("lang", "source", "item", "value")
    paired = paired.withColumn("rank", F.row_number().over(order))

    columns = ["lang", "source", "part", "item", "value", "rank"]
    return paired.withColumn("part", F.lit("pair")).select(columns).union(listed.withColumn("part", F.lit("term")).select(columns))
