"""Language identification by a byte convolutional network, trained here in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, tidy

#: Bytes of a window, widths of the filters and filters of each width.
WINDOW, WIDTHS, FILTERS, EMBEDDING = 192, (2, 3, 4), 16, 12
#: Labelled documents of each language that the network is fitted on (about; by a hash of
#: the id), documents of all languages at most (many languages share them), windows taken from each.
SAMPLE_PER_LANGUAGE, SAMPLE, WINDOWS_EACH = 1200, 60_000, 2
#: Windows that are convolved together.
BLOCK = 32
EPOCHS, BATCH, RATE = 6, 64, 0.004
#: Steps that a small sample is repeated for at least.
STEPS = 800
UNDETERMINED = "und"


class ByteNet:
    """Embedding, convolutions of several widths, maximum over the window, softmax.

    A filter of width w sees bytes i to i+w-1; all are held in one kernel of the
    largest width whose later taps are zero for narrower filters.
    """

    def __init__(self, languages: list[str], widths=WIDTHS, filters=FILTERS, embedding=EMBEDDING, window=WINDOW, seed=3):
        rng = np.random.default_rng(seed)
        self.languages, self.window, self.taps = languages, window, max(widths)
        n = filters * len(widths)
        self.mask = (np.arange(self.taps)[:, None, None] < np.repeat(widths, filters)[None, None, :]).astype(np.float32)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, embedding)).astype(np.float32),
            "kernel": (rng.normal(0, 0.3, (self.taps, embedding, n)) * self.mask).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "out": rng.normal(0, 0.1, (n, len(languages))).astype(np.float32),
            "out_bias": np.zeros(len(languages), np.float32),
        }
        self.pairs = None

    def fit(self, x: np.ndarray, y: np.ndarray, epochs=EPOCHS, batch=BATCH, rate=RATE, seed=5) -> None:
        """Adam on the cross entropy of windows ``x`` (bytes, zero-padded) and classes ``y``."""
        rng, p = np.random.default_rng(seed), self.p
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
        step, places = 0, self.window - self.taps + 1
        for _ in range(max(epochs, -(-STEPS * batch // len(x)))):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                b, t = x[rows], y[rows]
                n = len(b)
                e = p["embed"][b]
                cols = np.concatenate([e[:, k : k + places] for k in range(self.taps)], 2).reshape(n * places, -1)
                kernel = p["kernel"].reshape(cols.shape[1], -1)
                conv = (cols @ kernel).reshape(n, places, -1)
                top = conv.argmax(1)
                pooled = np.take_along_axis(conv, top[:, None], 1)[:, 0] + p["bias"]
                hidden = np.maximum(pooled, 0)
                logits = hidden @ p["out"] + p["out_bias"]
                logits -= logits.max(1, keepdims=True)
                d = np.exp(logits)
                d /= d.sum(1, keepdims=True)
                d[np.arange(n), t] -= 1
                d /= n
                g = {"out": hidden.T @ d, "out_bias": d.sum(0)}
                dh = (d @ p["out"].T) * (pooled > 0)
                g["bias"] = dh.sum(0)
                # Only the place of each maximum passes a gradient on.
                patch = np.stack([b[np.arange(n)[:, None], top + k] for k in range(self.taps)], 0)
                seen = p["embed"][patch]
                g["kernel"] = np.einsum("knfe,nf->kef", seen, dh, optimize=True) * self.mask
                back = np.einsum("nf,kef->knfe", dh, p["kernel"], optimize=True)
                g["embed"] = np.zeros_like(p["embed"])
                np.add.at(g["embed"], patch.ravel(), back.reshape(-1, back.shape[-1]))
                step += 1
                for k, v in g.items():
                    m, s = moment[k]
                    m += 0.1 * (v - m)
                    s += 0.001 * (v * v - s)
                    p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)

    def compile(self) -> None:
        """Tables of what each pair of bytes adds to every filter: the convolution is then
        a sum of table rows, one for every two taps."""
        taps = np.einsum("be,kef->kbf", self.p["embed"], self.p["kernel"])
        if self.taps % 2:
            taps = np.concatenate([taps, np.zeros_like(taps[:1])])
        self.pairs = [
            np.ascontiguousarray((taps[k][:, None] + taps[k + 1][None]).reshape(65536, -1)) for k in range(0, len(taps), 2)
        ]

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of windows (bytes, zero-padded)."""
        if self.pairs is None:
            self.compile()
        places = self.window - self.taps + 1
        pair = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        out = np.empty((len(x), self.pairs[0].shape[1]), np.float32)
        for at in range(0, len(x), BLOCK):
            rows = pair[at : at + BLOCK]
            conv = self.pairs[0][rows[:, :places]]
            for k, table in enumerate(self.pairs[1:], 1):
                conv += table[rows[:, 2 * k : 2 * k + places]]
            conv.max(1, out=out[at : at + BLOCK])
        logits = np.maximum(out + self.p["bias"], 0) @ self.p["out"] + self.p["out_bias"]
        logits = np.exp(logits - logits.max(1, keepdims=True))
        return logits / logits.sum(1, keepdims=True)

    def texts(self, texts: list[str]) -> np.ndarray:
        """Class probabilities of whole texts: the mean over all their windows, by bytes.
        Windows overlap by the widest filter, so none of its places is left out."""
        step, bound = self.window - self.taps + 1, 4096
        total = np.zeros((len(texts), len(self.languages)))
        rows, owners, weights = [], [], []

        def flush():
            if rows:
                np.add.at(total, owners, self.windows(np.stack(rows)) * np.array(weights)[:, None])
                rows.clear(), owners.clear(), weights.clear()

        for i, text in enumerate(texts):
            data = prepared(text)
            for at in range(0, max(1, len(data) - self.taps + 1), step):
                part = data[at : at + self.window]
                rows.append(np.frombuffer(part.ljust(self.window, b"\0"), np.uint8))
                owners.append(i)
                weights.append(len(part))
                if len(rows) >= bound:
                    flush()
        flush()
        return total / np.maximum(total.sum(1, keepdims=True), 1e-12)


def prepared(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def train_bytenet(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> ByteNet:
    """A network fitted on a bounded sample of labelled rows that are not held out.

    All labelled rows are counted by language, and every language can be predicted. About ``per_language``
    documents of each (all of a rarer one), fewer if there are more than ``SAMPLE`` of them, are taken by a hash of id and text, and ``WINDOWS_EACH`` pieces of
    each at hashed places, so at most a few megabytes reach the driver.
    """
    text = F.col(text_col).cast("string")
    rows = docs.where(~F.coalesce(held_out(id_col), F.lit(False)) & F.col(lang_col).isNotNull() & (F.length(text) > 0))
    rows = rows.select(text.alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"))
    counts = rows.groupBy("lang").count().collect()  # one small row a language
    if not counts:
        return ByteNet([UNDETERMINED])
    languages = sorted(r["lang"] for r in counts)
    per_language = min(per_language, max(1, SAMPLE // len(languages)))
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(per_language / r["count"]))])
    sample = rows.where(place < share[F.col("lang")])
    pieces = [
        F.substring("text", (F.pmod(F.xxhash64("text", F.lit(i)), F.length("text")) + 1).cast("int"), F.lit(WINDOW).cast("int"))
        for i in range(WINDOWS_EACH)
    ]
    taken = sample.select("lang", F.explode(F.array(*pieces)).alias("piece")).toArrow()
    net = ByteNet(languages)
    order = {x: i for i, x in enumerate(languages)}
    pairs = sorted(zip(taken["piece"].to_pylist(), taken["lang"].to_pylist(), strict=True))
    data = [(prepared(p)[:WINDOW], order[y]) for p, y in pairs if any(map(str.isalpha, p))]
    if data:
        x = np.stack([np.frombuffer(p.ljust(WINDOW, b"\0"), np.uint8) for p, _ in data])
        net.fit(x, np.array([y for _, y in data]))
    return net


def identify(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the share of that language) for every whole text.

    Null texts and texts without a letter get ``und`` with score 1. Long texts are read
    window by window; the mean is taken over all windows. Repeated rows and null ids are
    kept, other columns ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((net.languages, net.p))

    def run(batches):
        model = ByteNet(shared.value[0])
        model.p = shared.value[1]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
            names, scores = [UNDETERMINED] * len(texts), [1.0] * len(texts)
            for at in range(0, len(known), 64):
                some = known[at : at + 64]
                for i, p in zip(some, model.texts([texts[i] for i in some]), strict=True):
                    best = int(p.argmax())
                    names[i], scores[i] = model.languages[best], min(1.0, float(p[best]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded(rows).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Trains on the labelled rows of ``docs`` that are not held out and predicts all rows:
    doc_id, held_out, lang_pred, score. An empty table gives an empty result."""
    net = train_bytenet(docs, id_col, text_col, lang_col)
    found = identify(docs, net, id_col, text_col)
    return found.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, net: ByteNet, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is null, has no letter, or whose best language
    has a share below ``least``. Every other row stays, repeated ones and those with a null id too, and
    long texts are read whole. All columns stay as they are, whatever their names; an empty table gives an
    empty result."""
    shared = docs.sparkSession.sparkContext.broadcast((net.languages, net.p))
    place = docs.columns.index(text_col)

    def run(batches):
        model = ByteNet(shared.value[0])
        model.p = shared.value[1]
        for batch in batches:
            texts = batch.column(place).to_pylist()
            known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
            keep = []
            for at in range(0, len(known), 64):
                some = known[at : at + 64]
                keep += [i for i, p in zip(some, model.texts([texts[i] for i in some]), strict=True) if p.max() >= least]
            yield batch.take(pa.array(keep, pa.int64()))

    return bounded(docs).mapInArrow(tidy(run), docs.schema)
