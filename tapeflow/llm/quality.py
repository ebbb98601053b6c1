"""Quality scores by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, distinct, mix, sized, slices, tidy, word_ids

#: Trusted positives and unlabelled documents that are learned from (about, by a hash of the id).
POSITIVES, UNLABELLED = 6_000, 10_000
#: Passes over them, unlabelled documents of a step, least number of steps.
EPOCHS, STEP, UPDATES = 4, 128, 400
#: Places of hashed words (a power of two), steps of a measure of form, and places of all of these.
WORDS, STEPS = 1 << 18, 24
FORM = 16 + (8 + 4 * 17) * STEPS
#: A word is learned if this share of the fitted documents has it.
SUPPORT = 0.01
#: Length of the vector of a text's words; each feature of form has 1.
WEIGHT = 0.3
#: Step size of the per-coordinate rates, and pull of weights to 0.
RATE, PULL = 0.1, 1e-4
#: Share of both samples that is kept back to estimate the class prior, and chance that its bound fails.
KEPT_BACK, CHANCE = 0.25, 0.1
THRESHOLD = 0.5
#: Everything but letters, digits and bytes beyond ASCII separates words; A-Z is lower-cased.
_SIGNS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Kinds of bytes: signs, small letters and what is beyond ASCII, capitals, digits, white space.
_KIND = np.array([2 if 65 <= b <= 90 else 1 if 97 <= b <= 122 or b >= 128 else 3 if 48 <= b <= 57 else 4 if b in b" \n\t\r" else 0 for b in range(256)])


def held_out(id_col: str = "doc_id"):
    """Rows whose label is never read: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def _form(data: bytes, words: np.ndarray) -> np.ndarray:
    """Places of a text's features of form: each measure in steps of its own row of ``STEPS_OF_FORM``,
    and the measures of repetition once more for every length, of which they depend."""
    n, pairs, lines = len(words), mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]), data.split(b"\n")
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=5)
    letters, size = max(1, kinds[1] + kinds[2]), max(1, len(data))
    counts = np.unique(words, return_counts=True)[1]
    longest = np.diff(np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1], [True]]))).max() if n else 0
    length = min(15, n.bit_length())
    shares = (
        kinds[0] / size,
        kinds[2] / letters,
        kinds[3] / size,
        kinds[0] / max(1, n) / 4,
        data.count(b"\n") / max(1, n),
        len(set(lines)) / len(lines),
        min(1.0, len(data) / max(1, n) / 16),
        min(1.0, longest / 16),
    )
    of_length = (
        len(counts) / max(1, n),
        len(distinct(pairs)) / max(1, len(pairs)),
        counts.max() / n if n else 0.0,
        float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0,
    )
    at = [length] + [16 + i * STEPS + _step(x) for i, x in enumerate(shares)]
    at += [16 + (len(shares) + i * 17) * STEPS + _step(x) for i, x in enumerate(of_length)]
    at += [16 + (len(shares) + i * 17 + 1 + length) * STEPS + _step(x) for i, x in enumerate(of_length)]
    return np.array(at)


def _step(share: float) -> int:
    """The step of a share: finer near 0 and 1."""
    return int(STEPS * 0.999999 * (np.arcsin(np.sqrt(min(1.0, max(0.0, share)))) / (np.pi / 2)))


def text_features(texts: pa.Array):
    """(places, values) of each text of a string array: its form, each of value 1, and its distinct
    hashed words, all together of length ``WEIGHT``."""
    for some in slices(pc.fill_null(texts, "")):
        data = some.cast(pa.binary())
        for i, words in enumerate(word_ids(some, _SIGNS)):
            form = _form(data[i].as_py(), words)
            at = distinct((words >> np.uint64(20)).astype(np.int64) & (WORDS - 1)) + FORM
            yield np.concatenate([form, at]), np.concatenate([np.ones(len(form)), np.full(len(at), WEIGHT * max(1, len(at)) ** -0.5)])


class Linear:
    """A linear model of sparse features; the last weight is the bias."""

    def __init__(self, places: int = FORM + WORDS, rate: float = RATE, pull: float = PULL):
        self.w, self.squares = np.zeros(places + 1), np.zeros(places + 1)
        self.rate, self.pull = rate, pull

    def values(self, rows: list) -> np.ndarray:
        return np.array([self.w[at] @ x for at, x in rows]) + self.w[-1]

    def move(self, rows: list, slopes: np.ndarray) -> None:
        """One step against the gradient whose factor is ``slopes`` for each row."""
        at = np.concatenate([*(at for at, _ in rows), [len(self.w) - 1]])
        g = np.concatenate([*(s * x for s, (_, x) in zip(slopes, rows, strict=True)), [slopes.sum()]])
        at, back = np.unique(at, return_inverse=True)
        g = np.bincount(back, g) + self.pull * self.w[at]
        self.squares[at] += g * g
        self.w[at] -= self.rate * g / np.sqrt(self.squares[at] + 1e-8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _loss(z: np.ndarray) -> np.ndarray:
    """Logistic loss of a value whose class is positive; of ``-z`` if it is negative."""
    return np.logaddexp(0, -z)


def risks(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive part of the risk, and the unbiased estimate of the negative part from values of
    positives and unlabelled rows; that estimate may be below 0, the true part cannot."""
    return prior * _loss(positive).mean(), _loss(-unlabelled).mean() - prior * _loss(-positive).mean()


def slopes(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives, by the values, of what a step of non-negative learning minimises: the whole risk
    while the negative part is not below 0, else the negative part's distance to 0 alone."""
    p, u, n_p, n_u = _sigmoid(positive), _sigmoid(unlabelled), len(positive), len(unlabelled)
    if risks(positive, unlabelled, prior)[1] >= 0:
        return prior * (p - 1 - p) / n_p, u / n_u
    return prior * p / n_p, -u / n_u


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, places: int = FORM + WORDS, seed: int = 5) -> Linear:
    """A model that minimises the non-negative unbiased risk. Every step takes ``STEP`` unlabelled rows
    and as large a part of the positives."""
    model, rng = Linear(places), np.random.default_rng(seed)
    if not positive or not unlabelled:
        return model
    steps = max(1, -(-len(unlabelled) // STEP))
    for _ in range(max(EPOCHS, -(-UPDATES // steps))):
        of_p, of_u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for i, some in enumerate(np.array_split(of_u, steps)):
            part = np.array_split(of_p, steps)[i] if len(of_p) >= steps else of_p
            p, u = [positive[j] for j in part], [unlabelled[j] for j in some]
            slope_p, slope_u = slopes(model.values(p), model.values(u), prior)
            model.move(p + u, np.concatenate([slope_p, slope_u]))
    return model


def separate(positive: list[np.ndarray], unlabelled: list[np.ndarray], places: int = FORM + WORDS, seed: int = 3) -> Linear:
    """A model of trusted positives against unlabelled rows, for the estimate of the prior."""
    model, rng = Linear(places), np.random.default_rng(seed)
    steps = max(1, -(-len(unlabelled) // STEP))
    for _ in range(max(2, -(-UPDATES // 2 // steps))):
        of_p, of_u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for i, some in enumerate(np.array_split(of_u, steps)):
            part = np.array_split(of_p, steps)[i] if len(of_p) >= steps else of_p
            p, u = [positive[j] for j in part], [unlabelled[j] for j in some]
            slope_p, slope_u = _sigmoid(model.values(p)) - 1, _sigmoid(model.values(u))
            model.move(p + u, np.concatenate([slope_p / len(p), slope_u / len(u)]))
    return model


def prior_of(positive: np.ndarray, unlabelled: np.ndarray, chance: float = CHANCE) -> float:
    """The share of positives among unlabelled rows, from values of rows that the model has not seen.

    Above any bound, unlabelled rows hold at least their positives: the share of unlabelled rows above it,
    divided by that of positives, is never below the prior but by chance, and comes down to it
    where nothing but positives is. Taken is the bound with the least ratio, each share with its margin of error."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    bounds = np.unique(positive)
    above_p = 1 - np.searchsorted(np.sort(positive), bounds) / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), bounds) / len(unlabelled)
    margin = np.sqrt(np.log(4 / chance) / 2 / len(unlabelled)) + np.sqrt(np.log(4 / chance) / 2 / len(positive))
    best = np.argmin((above_u + margin) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def learn(positive: list, unlabelled: list) -> tuple[Linear, float]:
    """The model and the class prior from the features of trusted positives and of unlabelled texts.

    A part of both, kept back, gives the prior. All of them give the model, whose bias is then moved
    until the share of unlabelled texts that it takes for positive is the prior and its standard error:
    in doubt a document is kept."""
    of_p, of_u = (np.array([i % round(1 / KEPT_BACK) == 0 for i in range(len(rows))], bool) for rows in (positive, unlabelled))
    told = separate([r for r, b in zip(positive, of_p, strict=True) if not b], [r for r, b in zip(unlabelled, of_u, strict=True) if not b])
    prior = prior_of(*(told.values([r for r, b in zip(rows, back, strict=True) if b]) for rows, back in ((positive, of_p), (unlabelled, of_u))))
    model = fit(positive, unlabelled, prior)
    if positive and unlabelled:
        share = min(1.0, prior + np.sqrt(prior * (1 - prior) / max(1, of_u.sum())))
        model.w[-1] -= np.quantile(model.values(unlabelled), 1 - share)
    return model, prior


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, prior): the weights that are not zero, the last place is the bias.

    Trusted positives are the documents whose every label is above 0, but for those that are held out,
    whose labels are never read. Unlabelled text is any document that is not held out, whether it
    has a label or not: labels of 0 are never learned from. About ``positives`` and ``unlabelled`` of them,
    taken by a hash of the id, are learned from by one task, in the order of another hash."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("label")).where("label > 0").select("id")
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    known = known.where(chance < positives / max(1, known.count()))
    rows = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    some = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30) < unlabelled * 1.5 / max(1, docs.count()))
    rows = rows.join(sized(known, 16), "id", "left_semi").withColumn("trusted", F.lit(True)).union(some.withColumn("trusted", F.lit(False)))

    def run(batches):
        texts = {True: [], False: []}
        for batch in batches:
            for trusted, row in zip(batch.column(0).to_pylist(), text_features(batch.column(1)), strict=True):
                texts[trusted].append(row)
        both = [*texts[True], *texts[False]]
        often = np.bincount(np.concatenate([at for at, _ in both]), minlength=FORM + WORDS) >= SUPPORT * len(both) if both else np.empty(0, bool)
        often[:FORM] = True
        for rows in texts.values():
            rows[:] = [(at[often[at]], x[often[at]]) for at, x in rows]
        model, prior = learn(texts[True], texts[False])
        at = np.flatnonzero(model.w)
        at = at if len(at) else np.array([len(model.w) - 1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(model.w[at]), pa.array(np.full(len(at), prior))], ["at", "w", "prior"])

    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("id", F.lit(1)), "trusted", "text").select("trusted", "text")
    found = bounded(ordered).mapInArrow(tidy(run), "at long, w double, prior double").toArrow()
    return found["at"].to_numpy(), found["w"].to_numpy(), float(found["prior"][0].as_py()) if len(found) else 0.5


def score_quality(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for every whole text; null texts count as empty and are scored by their
    form. Repeated rows and null ids are kept, other columns ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model[:2])

    def run(batches):
        linear = Linear()
        linear.w[shared.value[0]] = shared.value[1]
        for batch in batches:
            scores = _sigmoid(linear.values(list(text_features(batch.column(1)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = bounded(rows).mapInArrow(tidy(run), "doc_id long, score double")
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Learns from trusted positives and unlabelled text and scores all of ``docs``: doc_id, held_out,
    score, predicted. Without trusted positives every score is 0.5; ties of labels count as not
    trusted; an empty table gives an empty result."""
    scored = score_quality(docs, train_quality(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")
