"""Soft-membership mixing: document rates whose expected domain totals match target weights."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langid import held_out
from .shared import Scratch, bounded, fresh, sized, tidy
from .tokens import tokenizer
from .toxicity import Ftrl, features

#: Share of all tokens that each domain is to have.
TARGETS = {"good": 0.90, "poor": 0.08, "toxic": 0.02}
#: Labelled rows that the classifier is fitted on (about, by a hash of the id), passes and least number of updates, hashed features.
SAMPLE, EPOCHS, UPDATES, FEATURES = 9_000, 2, 6_000, 1 << 19
#: Steps of a feature of form, and places of all features.
FORMS = 64
PLACES = FEATURES + 6 * FORMS
#: Steps at most, the distance to the targets that ends them, as a share of each, and the share by which a step must at
#: least reduce the error; without that the nearest rates are found.
STEPS, NEAR, PROGRESS = 96, 1e-3, 1e-3
#: Steps after which the rates are written, so that the expression of a rate stays short.
WRITTEN = 12
#: Added to the Gram matrix of the domains before it is inverted: how rare a domain may be before its steps get shorter.
RIDGE = 1e-5
_LETTERS = bytes(b for b in range(256) if chr(b).isalnum() or b >= 128 or b in b" \n\t\r")
_CAPITALS = bytes(range(65, 91))


def _form(text: bytes, words: int, distinct: float) -> list[int]:
    """Features of a text's form: shares of signs, of capitals and of distinct words and lines, and
    lengths, each in steps of its own row of ``FORMS``."""
    n, lines = max(1, words), text.split(b"\n")
    form = (
        round(20 * len(text.translate(None, _LETTERS)) / max(1, len(text))),
        round(20 * (len(text) - len(text.translate(None, _CAPITALS))) / max(1, len(text))),
        round(20 * distinct),
        round(10 * len(set(lines)) / len(lines)),
        min(12, len(text) // n),
        n.bit_length(),
    )
    return [FEATURES + i * FORMS + min(x, FORMS - 1) for i, x in enumerate(form)]


def domain_features(texts: pa.Array):
    """Places of the hashed word features of each text of a string array, then those of its form."""
    data = texts.cast(pa.binary())
    for i, (words, at) in enumerate(features(texts, FEATURES)):
        made = max(1, 3 * len(words) - 3)
        yield np.concatenate([at, np.array(_form(data[i].as_py() or b"", len(words), min(1.0, len(at) / made)), np.uint32)])


def domain_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain) of the labelled rows that are not held out: toxic, else poor, else good."""
    domain = F.when(F.max("toxic") > 0, "toxic").when(F.min("quality") < 1, "poor").otherwise("good")
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & F.col("quality").isNotNull() & ~held_out(id_col))
    return known.groupBy(F.col(id_col).cast("long").alias("id")).agg(domain.alias("domain"))


def train_domains(docs: DataFrame, known: DataFrame, domains: list[str], id_col: str, text_col: str, sample: int = SAMPLE) -> dict:
    """Places and weights of one FTRL regression for each domain, fitted by one task on a
    bounded sample of the labelled rows, in the order of a hash. Few rows are gone through
    until there were ``UPDATES`` updates."""
    share = sample / max(1, known.count())
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30) < share)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(sized(known, 32), "id").select("domain", "text", F.xxhash64("id", F.lit(1)).alias("place"))

    def run(batches):
        models, kept = [Ftrl(PLACES) for _ in domains], []
        for batch in batches:
            kept += zip(domain_features(batch.column(1)), batch.column(0).to_pylist(), strict=True)
        for _ in range(max(EPOCHS, -(-UPDATES // max(1, len(kept))))):
            for at, domain in kept:
                for d, model in zip(domains, models, strict=True):
                    model.learn(at, int(d == domain))
        for i, model in enumerate(models):
            w = model.weights(slice(None))
            at = np.flatnonzero(w)
            columns = [pa.array(np.full(len(at), i), pa.int64()), pa.array(at, pa.int64()), pa.array(w[at], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["d", "at", "w"])

    ordered = rows.repartition(1).sortWithinPartitions("place", "text").select("domain", "text")
    fitted = bounded(ordered).mapInArrow(tidy(run), "d long, at long, w double").toArrow()
    d, at, w = (fitted[c].to_numpy() for c in ("d", "at", "w"))
    return {i: (at[d == i], w[d == i]) for i in range(len(domains))}


def posteriors(docs: DataFrame, model: dict, text_col: str, tokenizer_path: str, tokens: str, names: list[str]) -> DataFrame:
    """``docs`` with a column ``tokens`` (ids of the whole text, and one for its end) and a column
    for each domain's posterior; these add to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        w = np.zeros((PLACES + 1, len(names)))
        for i, (at, values) in shared.value.items():
            w[at, i] = values
        some = (w != 0).any(1)  # few weights are not zero; this smaller table stays in the cache
        count = tokenizer(tokenizer_path, spaces=True).counts
        for batch in batches:
            texts = batch.column(place).cast(pa.string())
            sums = np.array([w[at[some[at]]].sum(0) for at in domain_features(texts)]).reshape(-1, len(names)) + w[PLACES]
            p = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            p /= p.sum(1, keepdims=True)
            added = [pa.array(count(texts) + 1, pa.int64()), *(pa.array(p[:, i].copy()) for i in range(len(names)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, tokens, *names])

    more = [T.StructField(tokens, T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names)]
    return bounded(docs).mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *more]))


def _stepped(rate, p: list, steps: list[np.ndarray]):
    """A rate after some projected steps: each takes a step's part of every posterior off and stops at 0."""
    for step in steps:
        rate = F.greatest(rate - sum(x * float(v) for x, v in zip(p, step, strict=True)), F.lit(0.0))
    return rate


def fitted(table: DataFrame, tokens: str, names: list[str], rate: str, goal: np.ndarray, scratch: Scratch) -> DataFrame:
    """``table`` with the column ``rate``, whose expected domain totals are nearest to ``goal``.

    Least squares by projected gradient: with A r the totals (each a share of all tokens) of rates
    r, the error (A r - goal)' W (A r - goal) is reduced from r = 1 on. W, the inverse of the
    domains' Gram matrix, gives rare domains the weight of common ones; in the metric of the tokens
    a document's gradient is its posteriors' product with W (A r - goal), steps of length 1 never
    raise the error, and the projection sets negative rates to 0. A step is one aggregation.
    """
    p, t, k = [F.col(n) for n in names], F.col(tokens), len(names)
    gram = [F.sum(t * a * b) for i, a in enumerate(p) for b in p[i:]]
    total, *given = table.agg(F.sum(t), *gram).first()
    state, steps, last = table.withColumn(rate, F.lit(1.0)), [], np.inf
    if not total:
        return state
    weight = np.zeros((k, k))
    weight[np.triu_indices(k)] = np.array(given, float) / float(total)
    weight = np.linalg.inv(weight + weight.T - np.diag(weight.diagonal()) + RIDGE * np.eye(k))
    for _ in range(STEPS):
        now = _stepped(F.col(rate), p, steps)
        error = np.array(state.agg(*(F.sum(now * t * x) for x in p)).first(), float) / float(total) - goal
        size = float(error @ weight @ error)
        if (np.abs(error) <= NEAR * goal).all() or size > (1 - PROGRESS) * last:
            break
        steps, last = [*steps, weight @ error], size
        if len(steps) == WRITTEN:
            state, steps = scratch.write(state.withColumn(rate, _stepped(F.col(rate), p, steps)), "rates"), []
    return state.withColumn(rate, _stepped(F.col(rate), p, steps))


def _mixed(docs: DataFrame, labels: DataFrame, tokenizer_path: str, targets: dict[str, float], id_col: str, text_col: str, all_columns: bool):
    domains = sorted(targets)
    scratch = Scratch(docs.sparkSession, "mixing")
    model = train_domains(docs, domain_labels(labels), domains, id_col, text_col)
    tokens, rate, *names = fresh(docs, "tokens", "rate", *(f"p_{d}" for d in domains)) if all_columns else ["tokens", "rate", *(f"p_{d}" for d in domains)]
    if not all_columns:
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        text_col = "text"
    table = posteriors(docs, model, text_col, tokenizer_path, tokens, names)
    table = scratch.write(table if all_columns else table.drop(text_col), "posteriors")
    goal = np.array([targets[d] for d in domains]) / sum(targets.values())
    return fitted(table, tokens, names, rate, goal, scratch), rate


def mixing_rates(
    docs: DataFrame, labels: DataFrame, tokenizer_path: str, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, tokens, p_<domain> and rate for every document.

    A classifier fitted on the label table gives each whole text its domain posteriors.
    Nonnegative rates are then fitted (:func:`fitted`) so that the expected domain totals, sum of
    rate * tokens * posterior, match the target shares of all tokens. Rates start at 1 and stay
    near it where targets allow. Targets that no rates reach with these posteriors are
    approached as far as possible. Targets are scaled to add to 1.

    Null texts count as empty: one token, the end. Without labels the posteriors are even.
    Repeated rows, ties and null ids are kept, each row with its own rate; equal texts have equal
    rates. Long texts are read whole. Other columns are ignored, whatever their names; an empty
    table gives an empty result.
    """
    return _mixed(docs, labels, tokenizer_path, targets, id_col, text_col, False)[0]


def mix(
    docs: DataFrame, labels: DataFrame, tokenizer_path: str, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with each row as often as its rate (:func:`mixing_rates`) says: the whole part, and
    once more where a hash of id and text falls below the rest. Every row has its own rate, whether
    its id is null or repeats; all columns stay as they are, whatever their names. An empty table
    gives an empty result."""
    found, rate = _mixed(docs, labels, tokenizer_path, targets, id_col, text_col, True)
    chance = F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.lit(41)), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(F.col(rate) + chance).cast("int")
    (copy,) = fresh(found, "copy")
    return found.where(times > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*(found[c] for c in docs.columns))
