"""Exact deduplication by distributed MSD radix partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, sized, staying

#: Bytes of the first digit, and how many times wider each later digit is.
FIRST_DIGIT, WIDEN = 64, 16


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT, widen: int = WIDEN
) -> DataFrame:
    """Classes of equal texts, where white space [\\x20\\x09-\\x0D] does not count.

    The radix key of a text is its length in bytes followed by its bytes. Each
    round deals the documents of a group by their next digit, a run of bytes;
    a group leaves when it has one document or its bytes have ended. Equality
    rests on the bytes alone. Groups are counted with partial aggregation and
    only the count goes back to the documents, so no task gathers a group.
    Digits widen, so the rounds grow with the logarithm of the longest text,
    and from the second round on only documents that share a prefix remain.

    Of equal texts the row with the most code points in the original text stays,
    then the smallest id. Null text counts as empty; empty texts are one class.
    Rows that repeat an id and a text count in ``group_size`` and are marked alike.
    A null id is never preferred to another; as the only id it is its own
    ``keep_id``. Other columns are ignored. An empty table gives an empty result.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = _bare(text_col)
    state = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("points"), rest.alias("rest")
    ).select(
        "doc_id",
        "points",
        F.octet_length("rest").cast("long").alias("size"),
        F.octet_length("rest").cast("string").cast("binary").alias("group"),
        F.sha2("rest", 256).alias("text_sha256"),
        "rest",
    )
    width, used, ended, first = first_digit, 0, [], True
    while True:
        used += width
        dealt = state.withColumn("digit", F.substring("rest", 1, width))
        order = F.struct("points", F.bitwise_not(F.col("doc_id")))
        groups = dealt.groupBy("group", "digit").agg(
            F.count(F.lit(1)).alias("n"),
            F.max(order).alias("best"),
            *([] if first else [F.min("row").alias("label")]),
        )
        groups = scratch.write(groups.where("n > 1"), "groups")
        done = F.col("n").isNull() | (F.col("size") <= used)
        # After the first round a group's name is its length and first digit, later the least row number in it.
        name = (
            F.concat("group", F.lit(b":"), "digit") if first else F.col("label").cast("string").cast("binary")
        )
        after = dealt.join(sized(groups, width + 96), ["group", "digit"], "left").select(
            F.monotonically_increasing_id().alias("row") if first else F.col("row"),
            "doc_id",
            "points",
            "size",
            "text_sha256",
            "n",
            F.bitwise_not(F.col("best").getField("col2")).alias("keep_id"),
            F.when(~done, name).alias("group"),
            F.when(~done, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
            done.alias("done"),
        )
        after = scratch.write(after, "dealt")
        ended.append(after.where("done"))
        state = after.where("NOT done").drop("n", "keep_id", "done")
        if state.isEmpty():
            break
        width, first = width * widen, False
    out = ended[0]
    for more in ended[1:]:
        out = out.union(more)
    keep = F.when(F.col("n").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def _bare(text: str):
    """The bytes of a text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", "").cast("binary")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that :func:`exact_dedup` does not keep.

    Of each class of equal texts one row stays; null, empty and blank texts are one class. Rows that
    share an id are told apart by their texts, and of those that repeat a kept id and its text the
    longest stays. A null id counts as an id of its own. All columns stay as they are, whatever their
    names; an empty table gives an empty result.
    """
    found = exact_dedup(docs, id_col, text_col).select("doc_id", F.col("text_sha256").alias("key"), F.col("kept").alias("stays"))

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn(name, F.sha2(_bare(text_col), 256))

    return staying(docs, id_col, text_col, found, keyed, Scratch(docs.sparkSession, "copies"))
