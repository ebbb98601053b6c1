"""Training-data operators against brute force, round trips and held-out quality on small fixtures."""

import itertools
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tapeflow.llm import exact_dedup, html_extract, langid, mixing, near_dedup, neighbours, packing, queries, repeats, shared, sstable, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}x{i // 997}" for i in range(12_000))
ODD = [
    (1, "One two three four five six", "en", "a", 1),
    (2, "one  TWO three four\nfive six", "en", "a", 1),
    (3, "One two three four five six", "en", None, None),
    (4, None, None, None, None),
    (5, "", "en", "b", 0),
    (6, " \t\n", "en", "b", 3),
    (7, LONG, "en", "b", 9),
    (8, LONG + " tail", None, "b", 9),
    (9, "word", "de", "b", 4),
    (None, "nobody's text of some length", "de", "b", 4),
    (3, "One two three four five six", "en", None, None),
    (11, "12345 !!! ###", "en", "b", 4),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text):
    return (text or "").encode().lower().split()


def near_brute(rows, k, percent):
    def shingles(w):
        return {tuple(w)} if w and len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = [shingles(words(t)) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    for i, s in enumerate(sets):
        counts = defaultdict(int)
        for x in s:
            for j in by[x]:
                counts[j] += j > i
        for j, c in counts.items():
            if c and 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i)))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup_brute_force(docs, odd, k):
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in near_dedup.near_dedup(df, words=k).collect())
        assert got == near_brute([tuple(r) for r in df.collect()], k, 80)


def test_near_dedup_edited_group(spark):
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(250):
        w = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 16)):
            w[at] = f"e{rng.integers(0, 300)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in near_dedup.near_dedup(df, words=2).collect())
    assert got == near_brute(rows, 2, 80)


def test_minmax_is_unbiased():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 63, 1000, np.uint64), rng.integers(0, 1 << 63, 250, np.uint64)
    scheme = near_dedup.MinMax(1000, 1)
    same = (scheme.band_keys(a) == scheme.band_keys(np.concatenate([a, b]))).mean()
    assert abs(same - 0.8) < 0.05
    assert len(scheme.factors) == 500


def exact_brute(rows):
    classes = defaultdict(list)
    for d, t in rows:
        t = t or ""
        classes["".join(t.translate({c: None for c in (32, 9, 10, 11, 12, 13)}))].append((-len(t), d is None, d))
    out = []
    for members in classes.values():
        keep = min(members, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out += [(str(d), str(keep), len(members), str(d) == str(keep)) for _, _, d in members]
    return sorted(out)


def test_exact_dedup_brute_force(docs, odd, empty):
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        for digit in (64, 2):
            got = exact_dedup.exact_dedup(df, first_digit=digit).collect()
            assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in got) == exact_brute(rows)
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "6", "7", "8", "9", "11", "None"])


def test_tokens_equal_library():
    rng = np.random.default_rng(1)
    parts = ["a", "Ab", "é", "É", "'s", "'", "1", "½", "!", "###", "_", "\n", " ", "  ", "\t", "日本", "ß", "İ", " ", " ", "😀", "\x1c", "<|endoftext|>", "<|startoftext|>", "the", " The,", "\x0b", "\x85", "\u00a0", "\r\n"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(4000)] + [LONG, ""]
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        cache = tokens.TokenCache(public_tokenizers.path(name), spaces)
        plain = Tokenizer.from_file(public_tokenizers.path(name))
        want = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
        for _ in range(2):
            assert [x.tolist() for x in cache.encode(pa.array([*texts, None]))] == [*want, []]
        assert cache.counts(pa.array([*texts, None])).tolist() == [*map(len, want), 0]
        assert any(x.ids != y.ids for x, y in zip(plain.encode_batch(["a <|endoftext|> b"]), plain.encode_batch(["a b"]), strict=True))


def test_tokens_forget_rare_words(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS_KEPT", 40)
    monkeypatch.setattr(tokens, "TEXT_BYTES", 400)
    cache = tokens.TokenCache(public_tokenizers.path("byte_bpe_50k.json"), True)
    texts = [" ".join(f"Word{(i * j) % 97}, tail" for j in range(20)) for i in range(60)]
    want = [x.ids for x in cache.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in cache.encode(pa.array(texts))] == want


def test_word_ids():
    for texts in (["One two", None, "", " \t ", " a\x0bB\n", "é É\u00a0x", "z"], [], [None]):
        for some in (pa.array(texts, pa.string()), pa.array(["x", *texts, "y"], pa.string()).slice(1, len(texts))):
            assert [x.tolist() for x in shared.word_ids(some)] == [[xxhash.xxh3_64_intdigest(w) for w in words(t)] for t in texts]


def one(text):
    return shared.word_ids(pa.array([text]))[0]


def library_ids(name, rows, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [(d, [*x.ids, end]) for (d, _), x in zip(rows, t.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True)]


def test_packing(docs, odd, empty):
    for df in (docs, odd):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        out = packing.harmonic_pack(df, public_tokenizers.path("byte_bpe_50k.json")).toPandas()
        sequences = out.sort_values("offset").groupby("sequence_id")
        sizes = sequences["length"].sum()
        assert (sequences["offset"].max() + sequences["length"].last() == sizes).all() and (sizes <= 1024).all()
        padded = sum(1024 if n & (n - 1) else n for n in sizes)
        assert sizes.sum() / padded > 0.9
        ids = defaultdict(list)
        for d, x in library_ids("byte_bpe_50k.json", rows, 0):
            ids[str(d)].append(x)
        pieces = defaultdict(list)
        for r in out.itertuples():
            pieces["None" if r.doc_id != r.doc_id else str(int(r.doc_id))].append(r)
        assert pieces.keys() == ids.keys()
        for d, found in pieces.items():
            x = ids[d][0]
            assert sum(r.length for r in found) == sum(map(len, ids[d]))
            for r in found:
                assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes())
    assert packing.harmonic_pack(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_sorted_string_tables(spark, docs, odd, empty, tmp_path):
    for df in (docs, odd):
        rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        want, start = [], 0
        for d, x in library_ids("word_bpe_49k.json", rows, 1):
            want.append((str(d), start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
            start += len(x)
        got = sstable.token_shards(df, public_tokenizers.path("word_bpe_49k.json")).collect()
        assert sorted((str(r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    assert sstable.token_shards(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    path = str(tmp_path / "shards")
    sstable.write_shards(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    shards = [sstable.ShardReader(f.read_bytes()) for f in sorted((tmp_path / "shards").glob("part-*")) if f.stat().st_size]
    for d, x in library_ids("word_bpe_49k.json", [(r["doc_id"], r["text"]) for r in docs.limit(20).collect()], 1):
        assert [i.tolist() for s in shards for i in s.get(d)] == [x]
    assert all(not s.get(10**15) for s in shards)


def test_repeats_brute_force(docs, odd, empty):
    for df, n in ((docs, 50), (odd, 5), (odd, 50)):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").distinct().collect()]
        where, all_words = defaultdict(set), {}
        for d, t in rows:
            all_words[d] = words(t)
            for s in range(len(all_words[d]) - n + 1):
                where[tuple(all_words[d][s : s + n])].add(d)
        want = []
        for d, w in all_words.items():
            hits = [s for s in range(len(w) - n + 1) if len(where[tuple(w[s : s + n])]) > 1]
            for s in hits:
                if want and want[-1][0] == d and s <= want[-1][1] + want[-1][2]:
                    want[-1][2] = s + n - want[-1][1]
                else:
                    want.append([d, s, n])
        got = repeats.repeated_passages(df, passage=n, gram=min(8, n // 2)).collect()
        assert sorted((str(r["doc_id"]), r["start_word"], r["n_words"]) for r in got) == sorted((str(d), s, m) for d, s, m in want)
    assert repeats.repeated_passages(empty).count() == 0


def test_clashing_names_repeated_rows_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    words_path = public_tokenizers.path("word_bpe_49k.json")
    operators = {
        "near": near_dedup.near_dedup,
        "exact": exact_dedup.exact_dedup,
        "toxicity": lambda df: toxicity.toxicity(df, labels),
        "language": langid.language_id,
        "mixing": lambda df: mixing.mixing_rates(df, labels, BYTE_BPE),
        "tables": lambda df: sstable.token_shards(df, words_path),
    }
    clashing = odd
    for c in (*CLASHING, "score", "kept", "predicted", "held_out", "lang_pred", "start", "shard", "h", "group", "digit", "label"):
        clashing = clashing.withColumn(c, F.lit(c))
    for name, run in operators.items():
        plain = sorted(map(str, run(odd).collect()))
        assert len(plain) == len(ODD), name
        assert sorted(map(str, run(clashing).collect())) == plain, name
        assert run(empty).count() == 0, name
    pieces = packing.harmonic_pack(clashing, BYTE_BPE)
    assert pieces.agg(F.sum("length")).first()[0] == packing.harmonic_pack(odd, BYTE_BPE).agg(F.sum("length")).first()[0]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, empty, "/root/testdata/sf0.001")
        assert none.columns == empty.columns and none.count() == 0, name
    # The score of a long text and of a repeated row is that of the text.
    scores = defaultdict(set)
    for r in toxicity.toxicity(odd, labels).collect():
        scores[r["doc_id"]].add(r["score"])
    assert all(len(x) == 1 for x in scores.values())
    rows = [(1, "http://a.example.com/1", "<p>x</p>")] * 3 + [(2, "http://a.example.com/2", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("host", "token", "own", "n_chars")})
    assert sorted(r["text"] for r in html_extract.extract_main_text(pages).collect()) == ["deep", "x", "x", "x"]


def test_repeats_tell_rows_apart(spark, empty):
    passage = " ".join(f"p{i}" for i in range(60))
    around = lambda n: " ".join(f"x{n}y{i}" for i in range(40 + n))
    rows = [(None, f"{around(i)} {passage} {around(i + 10)}") for i in range(3)] + [(5, f"{passage} {around(30)}"), (5, f"{around(40)} {passage}"), (-(1 << 63), around(50) + " " + around(51))]
    rows += [(8, around(60)), (8, around(60)), (9, around(60).upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASHING:
        df = df.withColumn(c, F.lit(c))
    got = sorted((str(r["doc_id"]), r["start_word"], r["n_words"], r["doc_words"], r["first_doc_id"]) for r in repeats.repeated_passages(df).collect())
    want = [("None", 40 + i, 60, 150 + 2 * i, 5) for i in range(3)] + [("5", 0, 60, 130, 5), ("5", 80, 60, 140, 5), ("8", 0, 100, 100, 8), ("9", 0, 100, 100, 8)]
    assert got == sorted(want)


def test_nearest_scores_are_of_original_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (300, 12)) * 10.0 ** rng.integers(-3, 4, (300, 1))
    x[7], x[8] = x[50] * 1e-200, x[50] * 1e200
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    for r in neighbours.nearest(df).collect():
        a, b = (x[i] / np.abs(x[i]).max() if i in (7, 8) else x[i] for i in (r["query_id"], r["vec_id"]))
        want = (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
        assert abs(r["score"] - want) <= (1e-12 if r["vec_id"] in (7, 8) else 2.3e-16)
    top = [r["vec_id"] for r in neighbours.nearest(df).where("query_id = 50").orderBy("rank").collect()][:2]
    assert sorted(top) == [7, 8]


def test_nearest_recall_and_edges(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (400, 16)) for c in rng.normal(0, 1, (8, 16))]).astype(float)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] + [1.0] * 15), (5150, [None] + [1.0] * 15), (None, [1.0] * 16), (5200, [1.0, 2.0])]
    rows += [(6000 + i, rows[0][1]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = defaultdict(list)
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    valid = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    ids, m = np.array([i for i, _ in valid]), np.array([v for _, v in valid])
    hit = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        s = (m @ m[at]).round(12)
        s[at] = -9
        best = np.lexsort((ids, -s))[:5]
        assert [k for k, _ in got[ids[at]]] == [k for k, _ in sorted(got[ids[at]], key=lambda z: (-z[1], z[0]))]
        hit += len({int(i) for i in ids[best]} & {k for k, _ in got[ids[at]]})
        total += 5
    assert got.keys() == set(ids[ids % 50 == 0].tolist())
    assert hit / total >= 0.9
    assert neighbours.nearest(df.where("vec_id < 0")).count() == 0
    assert sorted(r["rank"] for r in neighbours.nearest(df.where("vec_id < 3"), every=1).collect()) == [1, 1, 1, 2, 2, 2]


def test_nearest_finds_k_for_outliers(spark):
    rng = np.random.default_rng(6)
    hot = [1.0] * 8
    rows = [(i, [float(v) for v in np.array(hot) + rng.normal(0, 1e-3, 8)] if i % 2 else hot) for i in range(1, 3000) if i % 50]
    rows += [(i * 50, [float(v) for v in rng.normal(0, 1, 8)]) for i in range(12)] + [(600, hot)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(int)
    for r in neighbours.nearest(df).collect():
        got[r["query_id"]] += 1
    assert got == {i * 50: 5 for i in range(13)}


def test_nearest_holds_few_visits_at_once(spark, monkeypatch):
    """Queries that visit nearly every leaf: what tasks hand on stays small, and all leaves asked for are searched."""

    def watched(run):
        def wrapped(batches):
            for batch in run(batches):
                assert batch.nbytes <= 4 << 20
                yield batch

        return wrapped

    monkeypatch.setattr(neighbours, "tidy", watched)
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 8)
    monkeypatch.setattr(neighbours, "BLOCK", 60)
    x = np.random.default_rng(12).normal(0, 1, (2000, 32))
    x[500:800] = x[500]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, every=2, recall=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for at in range(0, 2000, 2):
        s = (unit @ unit[at]).round(12)
        s[at] = -9
        hit += len(set(np.lexsort((np.arange(2000), -s))[:5].tolist()) & set(got[at]))
        assert len(got[at]) == 5
    assert hit >= 0.99 * 5000


def test_best_of_copies_in_little_memory():
    x = np.tile(np.random.default_rng(3).normal(0, 1, 64), (1000, 1))
    tracemalloc.start()
    i, j, _ = neighbours._best(np.arange(1000), x, np.arange(300), x[:300], 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [j[i == 2].tolist(), j[i == 9].tolist(), len(i)] == [[0, 1, 3, 4, 5], [0, 1, 2, 3, 4], 1500]
    assert peak < 100 << 20


def test_language_held_out(docs, odd, empty):
    got = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95
    assert got["score"].between(0, 1).all()
    net = langid.train_bytenet(docs)
    found = [(str(r["doc_id"]), r["lang_pred"]) for r in langid.identify(odd, net).collect()]
    assert len(found) == len(ODD)
    assert {d for d, x in found if x == "und"} == {"4", "5", "6", "11"}
    assert langid.identify(empty, net).count() == 0 and langid.language_id(empty).count() == 0
    kept = langid.drop_unidentified(odd, net)
    assert kept.schema == odd.schema and kept.count() == len(ODD) - 4


def test_windows_equal_a_plain_convolution():
    net = langid.ByteNet(["a", "b", "c"], seed=1)
    x = np.random.default_rng(2).integers(0, 256, (21, net.window)).astype(np.uint8)
    for row, got in zip(x, net.windows(x), strict=True):
        e, found = net.p["embed"][row], np.full(net.p["bias"].shape, -np.inf, np.float32)
        for i in range(net.window - net.taps + 1):
            found = np.maximum(found, np.einsum("ke,kef->f", e[i : i + net.taps], net.p["kernel"] * net.mask))
        logits = np.maximum(found + net.p["bias"], 0) @ net.p["out"] + net.p["out_bias"]
        want = np.exp(logits - logits.max())
        assert np.allclose(got, want / want.sum(), atol=1e-5)


def test_every_language_can_be_predicted(spark):
    rows = [(i * 3 + k, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 40, f"l{k:03d}") for i in range(2) for k in range(230)]
    net = langid.train_bytenet(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(net.languages) == len({x[2] for x in rows if zlib.crc32(str(x[0]).encode()) % 4 != 2})


def naive_ftrl(rows, size, alpha, beta, l1, l2):
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    for at, label in rows:
        w = {i: weight(i) for i in [*at, size]}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in w:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
            n[i] += g * g
    return [weight(i) for i in range(size + 1)]


def test_ftrl_equals_the_formula():
    rng = np.random.default_rng(5)
    rows = [(np.unique(rng.integers(0, 30, 8)), int(rng.integers(0, 2))) for _ in range(200)]
    model = toxicity.Ftrl(30, l1=0.5)
    for at, label in rows:
        model.learn(at, label)
    assert np.allclose(model.weights(slice(None)), naive_ftrl([(a.tolist(), y) for a, y in rows], 30, model.alpha, model.beta, 0.5, model.l2))


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(1500):
        w = [f"n{x}" for x in rng.integers(0, 400, 40)]
        toxic = i % 5 == 0
        if toxic:
            w[int(rng.integers(0, 40))] = f"Insult{i % 4}!"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    df = spark.createDataFrame([*rows, (None, "n1"), (9999, None), (9998, "")], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (9999, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(df, known).toPandas()
    held = out[out["held_out"] & (out["doc_id"] < 9000)]
    truth = held["doc_id"] % 5 == 0
    assert ((held["predicted"] == 1) == truth).mean() > 0.97
    assert len(out) == 1503 and out["score"].between(0, 1).all()
    at, w = toxicity.train_toxicity(df, known)
    assert 0 < len(at) < 2000
    assert toxicity.toxicity(df.where("doc_id < 0"), known).count() == 0
    assert set(toxicity.toxicity(df.limit(5), known.where("doc_id < 0")).toPandas()["score"]) == {0.5}


def test_labels_are_never_inputs(spark):
    df = spark.createDataFrame([(i, "same text") for i in range(8)], "doc_id long, text string")
    a = spark.createDataFrame([(i, 1, i % 2) for i in range(8)], "doc_id long, quality int, toxic int")
    assert len({r["score"] for r in toxicity.toxicity(df, a).collect()}) == 1
    outside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    flipped = a.withColumn("toxic", F.when(outside, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.toxicity(df, a).collect()) == sorted(toxicity.toxicity(df, flipped).collect())


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def totals(out, domains=("good", "poor", "toxic")):
    """Shares of all tokens that each domain is expected to have."""
    return {d: (out["rate"] * out["tokens"] * out[f"p_{d}"]).sum() / out["tokens"].sum() for d in domains}


def test_mixing_reaches_targets(spark, odd, empty, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rng = np.random.default_rng(8)
    rows, known = [], []
    for i in range(900):
        w = [f"n{x}" for x in rng.integers(0, 300, 30)]
        if i % 3:
            w[::6] = [f"{'junk' if i % 3 == 1 else 'insult'}{x}" for x in rng.integers(0, 3, 5)]
        rows.append((i, " ".join(w)))
        known.append((i, int(i % 3 != 1), int(i % 3 == 2)))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    for targets in ({"good": 0.7, "poor": 0.2, "toxic": 0.1}, {"good": 0.5, "poor": 0.5, "toxic": 0.0}):
        out = mixing.mixing_rates(made, known, BYTE_BPE, targets).toPandas()
        assert (out["rate"] >= 0).all() and np.allclose(out[["p_good", "p_poor", "p_toxic"]].sum(axis=1), 1)
        for d, share in totals(out).items():
            assert abs(share - targets[d]) < 0.005
    # At the default targets, on the given tables.
    out = mixing.mixing_rates(docs, labels, BYTE_BPE).toPandas()
    assert out["tokens"].tolist() == [len(x) for _, x in library_ids("byte_bpe_50k.json", [(r["doc_id"], r["text"]) for r in docs.collect()], 0)]
    for d, share in totals(out).items():
        assert abs(share - mixing.TARGETS[d]) < 0.005
    mixed = mixing.mix(odd, labels, BYTE_BPE)
    assert mixed.columns == odd.columns
    assert mixing.mixing_rates(odd, labels, BYTE_BPE).count() == len(ODD)
    assert mixing.mixing_rates(empty, labels, BYTE_BPE).count() == 0 and mixing.mix(empty, labels, BYTE_BPE).count() == 0
    even = mixing.mixing_rates(odd, labels.where("doc_id < 0"), BYTE_BPE).toPandas()
    assert np.allclose(even[["p_good", "p_poor", "p_toxic"]], 1 / 3)


def projected_gradient(tokens_of, p, goal, ridge=mixing.RIDGE):
    """The same least squares on plain arrays, many steps."""
    share, r = tokens_of / tokens_of.sum(), np.ones(len(p))
    weight = np.linalg.inv((p * share[:, None]).T @ p + ridge * np.eye(p.shape[1]))
    for _ in range(3000):
        r = np.maximum(0, r - p @ (weight @ ((share * r) @ p - goal)))
    return r


def test_mixing_fit(spark):
    # Shares of tokens far from the targets; posteriors as a classifier gives them.
    rng = np.random.default_rng(3)
    domains, goal = ["good", "poor", "toxic"], np.array([0.90, 0.08, 0.02])
    names = [f"p_{d}" for d in domains]
    for shares in ((0.88, 0.007, 0.113), (0.994, 0.005, 0.001), (0.3, 0.4, 0.3)):
        kinds = rng.choice(3, 4000, p=np.array(shares) / sum(shares))
        p = rng.dirichlet([0.02, 0.01, 0.01], 4000) * 0.02
        p[np.arange(4000), kinds] += 1 - p.sum(1)
        n = rng.integers(20, 400, 4000)
        table = spark.createDataFrame([(int(a), *map(float, x)) for a, x in zip(n, p, strict=True)], "tokens long, p_good double, p_poor double, p_toxic double")
        got = mixing.fitted(table, "tokens", names, "rate", goal, shared.Scratch(spark, "test")).toPandas()
        for d, share in totals(got).items():
            assert abs(share - goal[domains.index(d)]) <= 0.002 * goal[domains.index(d)], (shares, d)
        want = projected_gradient(n.astype(float), p, goal)
        assert np.abs(got.sort_values(["tokens", *names])["rate"].to_numpy() - want[np.lexsort([*p.T[::-1], n])]).max() < 0.05
    # A classifier that cannot tell domains apart: no rate fits better than 1.
    even = table.selectExpr("tokens", "1/3D AS p_good", "1/3D AS p_poor", "1/3D AS p_toxic")
    got = mixing.fitted(even, "tokens", names, "rate", goal, shared.Scratch(spark, "test")).toPandas()
    assert np.allclose(got["rate"], 1, atol=0.01)


CLASHING = "key", "best", "row", "other_id", "other_key", "tokens", "rate", "p_good", "copy", "_times", "_n", "_sha", "_id", "n", "component", "doc", "set_hash"
SAME_IDS = [
    (1, "one two three four five six seven eight"),
    (2, "one two three four five six seven eight"),
    (2, "quite another text of nine words stands here now"),
    (None, "one two three four five six seven eight"),
    (None, "a text that only rows without an id hold"),
    (None, "a text that only rows without an id hold"),
    (2, "quite another text of nine words stands here  now"),
    (3, "quite another text of nine words stands here now"),
    (4, None),
    (4, ""),
]


def test_stages_tell_rows_apart(spark):
    df = spark.createDataFrame(SAME_IDS, "doc_id long, text string")
    for c in CLASHING:
        df = df.withColumn(c, F.lit(c))
    want = [(None, SAME_IDS[4][1]), (1, SAME_IDS[0][1]), (2, SAME_IDS[6][1])]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    for stage, blank in ((near_dedup.drop_near, 2), (exact_dedup.drop_copies, 1)):
        out = stage(df)
        assert out.columns == df.columns
        found = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert sorted((r for r in found if r[1]), key=key) == want
        assert len(found) == len(want) + blank
        assert {tuple(r[c] for c in CLASHING) for r in out.collect()} == {CLASHING}
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    mixed = mixing.mix(df, labels, BYTE_BPE, {"good": 1.0, "poor": 0.0, "toxic": 0.0})
    assert mixed.columns == df.columns


PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu {i}</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- ad --><div class="ad">Buy {i}</div><article><h1>Head &amp; {i}</h1><p><b>First  para<br>graph {i}.<p>Second&nbsp;one
{i}.</p><form><input>Mail</form></article><div id="comments"><p>Nice {i}</p></div><aside>Side</aside><footer>&copy; {i}</footer></body></html>"""


def test_html(spark):
    rows = [(i, f"http://{'one' if i < 6 else f'h{i}'}.example.com/{i}", PAGE.format(i=i)) for i in range(9)]
    rows += [(20, None, None), (21, "x", ""), (None, "http://one.example.com/z", "plain text"), (22, "http://z.example.com", "<p>a < b &lt; c</p>" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r["url"] if r["page_id"] is None else r["page_id"]: r for r in html_extract.extract_main_text(df).collect()}
    for i in range(9):
        assert got[i]["text"] == f"Head & {i}\nFirst para graph {i}.\nSecond one {i}." and got[i]["n_chars"] == len(got[i]["text"])
    assert got[20]["text"] == got[21]["text"] == "" and got[20]["url"] is None
    assert len(got) == 13 and got[22]["text"].startswith("a < b < c\na < b")
    assert html_extract.extract_main_text(df.where("page_id < 0")).count() == 0


def test_html_template_text_is_dropped(spark):
    page = "<html><body><h2>Site name</h2><div><p>Story {i} body</p></div><div>All rights reserved</div></body></html>"
    df = spark.createDataFrame([(i, f"http://a.example.com/{i}", page.format(i=i)) for i in range(8)], "page_id long, url string, html string")
    assert {r["text"] for r in html_extract.extract_main_text(df).collect()} == {f"Story {i} body" for i in range(8)}


def test_html_template_despite_odd_pages(spark):
    page = "<html><body><h2>Site name</h2><div><p>Story {i} body</p></div><div>All rights reserved</div></body></html>"
    article = "<html><body><p>Teaser {i}</p><article><p>Story {i} body</p></article></body></html>"
    rows = [(i, f"http://a.example.com/{i}", page.format(i=i)) for i in range(30)]
    rows += [(100 + i, f"http://b.example.com/{i}", article.format(i=i)) for i in range(30)]
    for at, host in ((40, "a"), (140, "b")):
        rows += [(at + i, f"http://{host}.example.com/odd{i}", x) for i, x in enumerate([None, "", "<html></html>", None, "", "502 bad gateway"])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(df).collect()}
    for i in range(30):
        assert got[i] == got[100 + i] == f"Story {i} body"
    assert got[45] == got[145] == "502 bad gateway" and got[40] == got[141] == ""


def test_pipeline_stages(spark, docs, odd, sf_dir):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns, name
        out.write.format("noop").mode("overwrite").save()
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {d: t for d, t in rows.items() if any(map(str.isalpha, t or ""))}
    kept = [r for r in exact_brute(list(left.items())) if r[3]]
    left = {int(d): left[int(d)] for d, _, _, _ in kept}
    kept = {d for d, _, c in near_brute(list(left.items()), 5, 80) if d == c}
    packed = set(out["doc_id"].astype(int).astype(str))
    assert packed <= kept and len(packed) > 0.3 * len(kept)
    tokens_of = out.groupby("doc_id")["length"].sum() / out.groupby("doc_id")["doc_tokens"].first()
    assert (tokens_of == tokens_of.round()).all()


def test_queries_are_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_shingles_of_short_texts():
    w = one("a b")
    assert len(shared.shingle_ids(w, 5)) == 1 and len(shared.shingle_ids(one(""), 5)) == 0
    assert len(set(itertools.chain(shared.shingle_ids(one("a b"), 3), shared.shingle_ids(one("a b c"), 3)))) == 2
