"""Source divergence, whitening and positive-unlabelled quality against plain Python and numpy."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeflow.llm import divergence, quality, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "Alpha beta, gamma! alpha", "en", "a", 1),
    (1, "Alpha beta, gamma! alpha", "en", "a", 1),
    (2, "ALPHA beta2beta gamma", "en", "b", 1),
    (3, "été Été alpha", "en", None, None),
    (4, None, None, None, None),
    (5, "", "en", "c", 0),
    (6, " \t\n..", "fr", "b", 3),
    (7, "alpha " * 30_000 + "beta gamma", "en", "b", 9),
    (None, "été beta gamma delta", "en", "a", 4),
    (9, "x y z", "de", "b", 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def divergence_brute(rows):
    terms = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((r["text"] or "", r["lang"] or "", r["source"] or "") for r in rows):
        found = terms.findall(text.translate(lower))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        langs[lang].add(source)
    out = set()
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        of, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)

        def f(p, q):
            return (p - q) ** 2 // q

        for s in sources:
            pairs = [(-sum(f(of[s][t], of[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            found = [(-f(of[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and of[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(found)[:200])):
                out |= {(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(items)}
    return out


def test_divergence_brute_force(docs, odd):
    for df in (docs, odd):
        got = [tuple(r) for r in divergence.divergence(df).collect()]
        assert len(got) == len(set(got)) and set(got) == divergence_brute(df.collect())


def test_divergence_in_small_blocks_and_parts(docs, odd, monkeypatch):
    monkeypatch.setattr(divergence, "LEAST_UNIT", 1 << 10)
    monkeypatch.setattr(divergence, "PAIRS", 64)
    monkeypatch.setattr(divergence, "MATCHES", 100)
    for df in (docs, odd):
        assert {tuple(r) for r in divergence.divergence(df, block_terms=20).collect()} == divergence_brute(df.collect())


def test_divergence_edges(spark, odd):
    empty = divergence.divergence(odd.limit(0))
    assert empty.collect() == [] and empty.columns == ["lang", "source", "part", "item", "value", "rank"]
    clash = odd.select("*", *(F.lit("z").alias(c) for c in ("term", "n", "block", "part", "rank", "id", "p", "value")))
    assert sorted(map(tuple, divergence.divergence(clash).collect())) == sorted(map(tuple, divergence.divergence(odd).collect()))
    alone = spark.createDataFrame([(1, "a b", "en", "s", 1)] * 3, DOCS)
    assert divergence.divergence(alone).collect() == []  # one source: no pair, no term above its own language
    none = spark.createDataFrame([(1, "a", "en", "s", 1), (2, "b", "en", "t", 1)], DOCS)
    assert {(r["source"], r["item"], r["value"]) for r in divergence.divergence(none).collect()} == {("s", "t", 0), ("t", "s", 0)}


def whitened_brute(rows, k=8):
    x = np.array([[int(np.floor(1024 * float(v))) + 100_000 for v in vector] for _, vector in rows], object)
    n, s = len(x), x.sum(0)
    y = (n * x - s).astype(float) / n
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    return n, [int(v) for v in ((n * x - s) ** 2).sum(1)], y @ vectors[:, order] / np.sqrt(values[order]), values[order] / np.trace(cov)


def check_whitened(df, rows):
    got = df.collect()
    n, deviation, white, explained = whitened_brute(rows, min(8, len(rows[0][1])))
    k = white.shape[1]
    assert len(got) == len(rows) * k and {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-8
    by = defaultdict(list)
    for r in got:
        by[r["component"]].append((r["vec_id"], r["deviation"], r["whitened"]))
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
    for c, found in by.items():
        plain = sorted(((i, d if d < 1 << 63 else None, w) for (i, _), d, w in zip(rows, deviation, white[:, c - 1], strict=True)), key=str)
        found = sorted(found, key=str)
        # Rows of one id and deviation are the same vector, so the order of both sides is the same up to rounding.
        assert [x[:2] for x in found] == [x[:2] for x in plain]
        sign = np.sign(sum(x[2] * y[2] for x, y in zip(found, plain, strict=True)))
        assert max(abs(x[2] - sign * y[2]) for x, y in zip(found, plain, strict=True)) < 1e-7


def test_whitening_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    check_whitened(whitening.whitened(df), rows)


def test_whitening_edges(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(40)] + [(None, [1.0, 2.0, 3.0, 4.0, 5.0]), (3, [0.0] * 5)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0, 3.0, 4.0]), (93, [float("nan")] * 5), (94, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (95, [1.0, 2.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").repartition(7)
    check_whitened(whitening.whitened(df), good)
    clash = df.select("*", *(F.lit(1).alias(c) for c in ("component", "n", "whitened", "sum")))
    assert whitening.whitened(clash).count() == len(good) * 5
    assert whitening.whitened(df.limit(0)).collect() == [] and whitening.whitened(df.where("vec_id > 89")).count() == 2 * 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], df.schema)
    assert whitening.whitened(same).collect() == []
    line = whitening.whitened(spark.createDataFrame([(1, [0.0, 2.0]), (2, [1.0, 2.0])], df.schema)).collect()
    assert {(r["vec_id"], r["component"], round(r["whitened"], 9), r["explained"]) for r in line} == {(1, 1, -1.0, 1.0), (2, 1, 1.0, 1.0)}
    large = whitening.whitened(spark.createDataFrame([(1, [1e15, 0.0]), (2, [-1e15, 1.0])], df.schema)).collect()
    assert {r["deviation"] for r in large} == {None}


def test_non_negative_risk():
    rng = np.random.default_rng(2)
    p, u = rng.normal(size=7), rng.normal(size=9)
    for prior in (0.3, 0.9):
        sign = 1 if quality.risks(p, u, prior)[1] >= 0 else -1

        def goal(p, u, prior=prior, sign=sign):
            a, b = quality.risks(p, u, prior)
            return a + b if sign > 0 else -b

        of_p, of_u = quality.slopes(p, u, prior)
        for i in range(7):
            d = np.eye(7)[i] * 1e-6
            assert of_p[i] == pytest.approx((goal(p + d, u) - goal(p - d, u)) / 2e-6, abs=1e-6)
        for i in range(9):
            d = np.eye(9)[i] * 1e-6
            assert of_u[i] == pytest.approx((goal(p, u + d) - goal(p, u - d)) / 2e-6, abs=1e-6)


def test_prior_estimate():
    rng = np.random.default_rng(3)
    positive = rng.normal(3, 1, 1500)
    mixed = np.concatenate([rng.normal(3, 1, 1400), rng.normal(-3, 1, 600)])
    assert quality.prior_of(positive, mixed) == pytest.approx(0.7, abs=0.04)
    assert quality.prior_of(positive[:0], mixed) == 0.5


@pytest.fixture(scope="module")
def web(spark):
    path = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")


def test_quality_held_out(web):
    docs, labels = web
    found = quality.quality(docs, labels)
    rows = found.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    good, poor = [[r["score"] for r in rows if r["quality"] == q] for q in (1, 0)]
    assert np.mean([a > b for a in good for b in poor]) > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    assert {r["doc_id"]: r["held_out"] for r in found.collect()} == {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in docs.collect()}


def test_quality_learns_from_trusted_positives_only(web):
    docs, labels = web
    some = docs.where("doc_id < 300")
    scores = {r["doc_id"]: r["score"] for r in quality.quality(some, labels).collect()}
    held = quality.held_out("doc_id")
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).where(held | (F.col("quality") > 0))
    moved = some.select("doc_id", "text", F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(0).alias("score"))
    assert {r["doc_id"]: r["score"] for r in quality.quality(moved, other).collect()} == scores


def test_quality_edges(spark, odd, web):
    found = quality.quality(odd, web[1].limit(0)).collect()
    assert len(found) == len(ODD) and {r["score"] for r in found} == {0.5}
    found = quality.quality(odd, web[1].union(web[1].limit(0)).union(spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int"))).collect()
    assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    empty = quality.quality(odd.limit(0), web[1])
    assert empty.collect() == [] and empty.columns == ["doc_id", "held_out", "score", "predicted"]
