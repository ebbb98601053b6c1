"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .shared import bounded, distinct, mix, sized, slices, tidy, word_ids

#: Hashed features (a power of two), labelled rows that are learned from (about, by a hash
#: of the id), passes over them.
FEATURES, SAMPLE, EPOCHS = 1 << 20, 12_000, 2
#: Step size and smoothing of the per-coordinate rates, and the two penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 1.0
THRESHOLD = 0.3
#: Everything but letters, digits and bytes beyond ASCII separates words; A-Z is lower-cased.
_SIGNS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(texts: pa.Array, size: int = FEATURES):
    """The words (64-bit ids) and the distinct hashed features of each text of a string array, one text
    after the other: words, neighbouring pairs, and pairs that skip a word."""
    for some in slices(texts):
        for w in word_ids(some, _SIGNS):
            parts = [w]
            for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
                if len(w) > gap:
                    parts.append(mix(w[:-gap] * np.uint64(salt) + w[gap:]))
            yield w, distinct((np.concatenate(parts) >> np.uint64(20)).astype(np.uint32) & np.uint32(size - 1))


class Ftrl:
    """Binary FTRL-proximal regression; coordinate 0 of the vectors beyond the features is the bias."""

    def __init__(self, size: int = FEATURES, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.size, self.alpha, self.beta, self.l1, self.l2 = size, alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, self.size)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, size: int = FEATURES
) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) that are not zero; the last place is the bias.

    Labels of rows that are held out are never read into the fit. At most about
    ``sample`` labelled documents, chosen by a hash of the id, are learned from, in the
    order of another hash, by one task; all of a smaller label table is used. An id with
    several labels counts with the largest; null labels are left out.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    share = sample / max(1, known.count())
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30) < share)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(sized(known, 16), "id").select("label", "text", F.xxhash64("id", F.lit(1)).alias("place"))

    def run(batches):
        model, kept = Ftrl(size), []
        for batch in batches:
            for label, (_, at) in zip(batch.column(0).to_pylist(), features(batch.column(1), size), strict=True):
                kept.append((at, int(label > 0)))
                model.learn(at, kept[-1][1])
        for _ in range(EPOCHS - 1):
            for at, label in kept:
                model.learn(at, label)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], ["at", "w"])

    fitted = rows.repartition(1).sortWithinPartitions("place", "text").select("label", "text")
    fitted = bounded(fitted).mapInArrow(tidy(run), "at long, w double").toArrow()
    return fitted["at"].to_numpy(), fitted["w"].to_numpy()


def score_toxicity(
    docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, size: int = FEATURES
) -> DataFrame:
    """doc_id, score and predicted for every whole text; null texts count as empty and get
    the bias alone. Repeated rows and null ids are kept, other columns ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        w = np.zeros(size + 1)
        w[shared.value[0]] = shared.value[1]
        some = w != 0  # few weights are not zero; this smaller table stays in the cache
        for batch in batches:
            sums = np.array([w[at[some[at]]].sum() for _, at in features(batch.column(1), size)]) + w[size]
            scores = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = bounded(rows).mapInArrow(tidy(run), "doc_id long, score double")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Trains on the labels that are not held out and scores all of ``docs``: doc_id,
    held_out, score, predicted. Without labels every score is 0.5; an empty table gives
    an empty result."""
    scored = score_toxicity(docs, train_toxicity(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")
