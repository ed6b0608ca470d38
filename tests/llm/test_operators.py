"""Defined cases and brute-force comparisons of the ten operators."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeseek.llm import fingerprint, mixing, neighbours, ngram_join, packing, pii, quality, suffix, toxicity, urls

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, label string, score double, h long"


def words(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, a very long text, ties, repeated rows and columns with clashing names."""
    base = words(1, 120)
    texts = [None, "", "  ", "!!!", "one", base, base, base + " end", words(2, 60_000), "x" * 200_000, words(3, 80)]
    rows = [(k if k != 4 else None, t, "en", None if k % 3 == 0 else f"s{k % 3}", None, "l", 1.0, k) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], rows[10]], SHAPE)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (10, 0, 1), (6, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


RUNS = {
    "sketch": lambda d, l: fingerprint.sketch(d),
    "groups": lambda d, l: ngram_join.groups(d),
    "pairs": lambda d, l: ngram_join.pairs(d),
    "keep_one": lambda d, l: ngram_join.keep_one(d),
    "packing": lambda d, l: packing.pack(d),
    "toxicity": lambda d, l: toxicity.score(d, l),
    "quality": lambda d, l: quality.resample(d, l),
    "quality_keep": lambda d, l: quality.keep(d, l),
    "suffix": lambda d, l: suffix.repeats(d),
    "mixing": lambda d, l: mixing.mix(d),
    "mixing_keep": lambda d, l: mixing.keep(d),
    "pii": lambda d, l: pii.find(d),
    "redact": lambda d, l: pii.redact(d),
    "urls": lambda d, l: urls.filter_urls(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), "score")),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_and_empty_tables(odd, labels, name):
    got = RUNS[name](odd, labels)
    assert len(set(got.columns)) == len(got.columns)
    rows = got.count()
    assert RUNS[name](odd.where("false"), labels.where("false")).count() == 0
    if name in ("sketch", "toxicity", "redact", "urls"):
        assert rows == odd.count()
    if name in ("keep_one", "quality_keep", "mixing_keep", "redact"):
        assert got.columns == odd.columns


def test_sketch_containment(spark):
    big = words(4, 20_000)
    small = " ".join(big.split()[5000:9000])
    s = fingerprint.sketch(spark.createDataFrame([(1, small), (2, big)], "doc_id long, text string"))
    got = fingerprint.containment(s.where("doc_id = 1").withColumnRenamed("doc_id", "a"), s.where("doc_id = 2").withColumnRenamed("doc_id", "b"), "a", "b").first()
    assert got.containment == 1.0 and abs(got.shared / fingerprint.FRACTION / 4000 - 1) < 0.15


def _trigrams(t):
    w = re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (t or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("block", [4096, 8])
def test_ngram_join_brute_force(spark, block):
    r, texts = random.Random(5), []
    for k in range(40):
        base = words(100 + k, r.randrange(5, 90)).split()
        for _ in range(r.randrange(1, 5)):
            copy = [w if r.random() > 0.04 else "zz" for w in base]
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [_trigrams(t) for t in texts]
    truth = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    got = {(x.doc_a, x.doc_b) for x in ngram_join.pairs(df, block=block).collect()}
    assert not got - truth and len(got) >= 0.9 * len(truth)


def test_packing_is_a_packing(spark):
    r = random.Random(6)
    df = spark.createDataFrame([(k, " ".join(["a"] * r.choice([3, 100, 700, 1100, 2048, 5000])), "s") for k in range(300)], "doc_id long, text string, source string")
    got = packing.pack(df).toPandas()
    assert got.n_tokens.sum() == sum(len(t.text.split()) for t in df.collect())
    assert got.groupby("bin_id").n_tokens.sum().max() <= packing.CAPACITY and not got.duplicated(["bin_id", "slot"]).any()
    assert got.bin_id.nunique() <= np.ceil(got.n_tokens.sum() / packing.CAPACITY) * 1.15


def test_packing_order_is_the_same_at_every_size(spark, monkeypatch):
    df = spark.createDataFrame([(k, "a " * (20 + k % 3), "s") for k in range(200)], "doc_id long, text string, source string")
    one = {tuple(r) for r in packing.pack(df).collect()}
    monkeypatch.setattr(packing, "SLICE_ROWS", 30)
    assert {tuple(r) for r in packing.pack(df).collect()} == one


def test_toxicity_and_quality_held_out(spark):
    r = random.Random(7)
    good, bad = [f"calm{k}" for k in range(300)], ["slurone", "slurtwo", "slurthree"]
    rows = []
    for k in range(400):
        w = [r.choice(good) for _ in range(40)]
        if k % 4 == 0:
            w[3:3 + 1 + k % 3] = r.sample(bad, 1 + k % 3)
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(200)], "doc_id long, quality int, toxic int")
    got = toxicity.score(df, known).where("doc_id >= 200").toPandas()
    assert ((got.doc_id % 4 == 0) == got.toxic).mean() > 0.95


def test_kth_largest(spark):
    x = [random.Random(8).choice([1.0, 2.5, 7.0, 9.25]) + k % 7 for k in range(20_000)]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    assert all(quality.kth_largest(df, "v", k, bins=16, small=50) == sorted(x, reverse=True)[k - 1] for k in (1, 777, 20_000 - 1))


def test_suffix_brute_force(spark):
    shared = words(9, 70)
    texts = [words(20, 90) + " " + shared + " " + words(21, 30), shared.upper(), words(22, 120), words(23, 60) + " " + shared, words(24, 49)]
    got = {(r.doc_id, r.first_word, r.end_word, r.is_copy) for r in suffix.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {(0, 90, 160, False), (1, 0, 70, True), (3, 60, 130, True)}


def test_pii_learns_from_context(spark):
    r = random.Random(10)
    seeds = [(k, f"mail user{k}@example.com now") for k in range(8)] + [(100 + k, f"token=ab{r.randrange(10**11, 10**12)}cdEF{k} here") for k in range(8)]
    df = spark.createDataFrame([*seeds, (50, "version 2.1 of 14 items")], "doc_id long, text string")
    assert {x.doc_id for x in pii.find(df).collect()} >= set(range(8)) and 50 not in {x.doc_id for x in pii.find(df).collect()}
    assert "example.com" not in pii.redact(df).where("doc_id = 0").first().text


def test_pii_new_forms_after_learnt_words(spark):
    rows = [(k, f"phone +1 (301) 555-{1000 + 7 * k} or write") for k in range(20)]
    new = ["phone 555 123 4567 or", "phone +44 20 7946 0958", "phone DE89 3704 0044 0532 0130 00 today", "phone 123-45-6789", "password=correcthorsebattery", "on 2024-05-16 or 7 then"]
    df = spark.createDataFrame([*rows, *[(100 + k, t) for k, t in enumerate(new)]], "doc_id long, text string")
    got = {r.doc_id: r.value for r in pii.find(df).where("doc_id >= 100").collect()}
    assert got == {100: "555 123 4567", 101: "+44 20 7946 0958", 102: "DE89 3704 0044 0532 0130 00", 103: "123-45-6789", 104: "correcthorsebattery"}
    text = {r.doc_id: r.text for r in pii.redact(df).where("doc_id >= 100").collect()}
    assert text == {100: "phone <PHONE> or", 101: "phone <PHONE>", 102: "phone <PHONE> today", 103: "phone <PHONE>", 104: "password=<SECRET>", 105: new[5]}
    assert pii.seed_kind("123-45-6789", "") is None and all(pii.seed_kind(x, "") == "" for x in ("2024-05-16", "5/16/2024", "16-05-24"))


def test_urls_tell_hosts_apart(spark):
    rows = [(k, f"http://{'casino' if k % 3 == 0 else 'news'}.site.com/p/{k}") for k in range(600)]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).toPandas()
    assert (got.keep == (got.page_id % 3 != 0)).mean() > 0.97


@pytest.mark.parametrize("calibration_rows", [20_000, 40])
def test_urls_brute_force(spark, calibration_rows):
    r = random.Random(12)
    rows = [(k, f"http://{'casino' if k % 3 == 0 else 'news'}{r.randrange(10**6)}.com/{r.randrange(36**9):x}") for k in range(1500)]
    df = spark.createDataFrame([*rows, rows[1], (1501, None), (1502, "")], "page_id long, url string")
    got = {x.page_id: x.score for x in urls.filter_urls(df, calibration_rows=calibration_rows).collect()}
    place = df.where("url <> ''").select("url", (F.pmod(F.xxhash64(F.lit(3), "url"), F.lit(5)) == 0).alias("held"), F.xxhash64(F.lit(5), "url").alias("h")).collect()
    sample = {u for u, _ in sorted({(x.url, x.h) for x in place if x.held}, key=lambda x: x[1])[:calibration_rows]}
    pairs, ctx = [{}, {}], [{}, {}]
    at = lambda u: [("\0" * 5 + u + "\1")[i : i + 6] for i in range(len(u) + 1)]
    for _, u in [*rows, rows[1]]:
        for g in at(u) if u not in sample else []:
            for o in range(6):
                c = int("casino" not in u)
                pairs[c][g[5 - o :]] = pairs[c].get(g[5 - o :], 0) + 1
                ctx[c][o, g[5 - o : 5]] = ctx[c].get((o, g[5 - o : 5]), 0) + 1
    for k, u in rows[::50]:
        ratio = []
        for g in at(u):
            p = [1 / 257, 1 / 257]
            for o in range(6):
                p = [(pairs[c].get(g[5 - o :], 0) + 1.5 * p[c]) / (ctx[c].get((o, g[5 - o : 5]), 0) + 1.5) for c in (0, 1)]
            ratio.append(np.log(max(p[1], 1e-12)) - np.log(max(p[0], 1e-12)))
        assert abs(got[k] - np.mean(ratio)) < 1e-9
    assert len(got) == 1502 and got[1501] == got[1502] == 0


def _recall(got, v, queries):
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = n[queries] @ n.T
    s[np.arange(len(queries)), queries] = -2
    truth = {(int(queries[i]), int(j)) for i in range(len(queries)) for j in np.argsort(-s[i])[:10]}
    exact = dict(zip(zip(got.vec_id, got.neighbour_id), got.similarity))
    assert all(abs(x - float(n[i] @ n[j])) < 2e-6 for (i, j), x in exact.items())
    return len(truth & set(exact)) / len(truth)


def test_neighbours_recall_and_odd_rows(spark):
    v = np.random.default_rng(11).standard_normal((600, 32))
    v[300:320] = v[0] + 0.01 * v[300:320]
    v[400:460] = v[1]  # sixty copies: ties in order of id
    v[5] *= 1e300
    rows = [(int(k), [float(x) for x in e], "x", 1.0) for k, e in enumerate(v)] + [(None, [1.0] * 32, "", 0.0), (9001, None, "", 0.0), (9002, [0.0] * 32, "", 0.0), (9003, [float("nan")] * 32, "", 0.0), (9004, [1.0], "", 0.0)]
    df = spark.createDataFrame([*rows, rows[3]], "vec_id long, embedding array<double>, id string, similarity double")
    got = neighbours.neighbours(df, block=200, every=1).toPandas()
    v[5] /= 1e300
    copies = got[got.vec_id == 430].sort_values("rank")
    assert list(copies.neighbour_id) == [1, *range(400, 409)] and (copies.similarity == 1).all()
    others = got[~got.vec_id.isin([1, *range(400, 460)])]
    assert _recall(others, v, np.array(sorted(others.vec_id.unique()))) >= 0.9
    assert got.vec_id.max() < 600 and got.groupby("vec_id").size().eq(10).all()
    assert set(neighbours.neighbours(df, block=200).toPandas().vec_id) == set(range(0, 600, 20))
    assert neighbours.neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_neighbours_compare_less_than_all(spark, tmp_path):
    r, shares = np.random.default_rng(3), []
    for n in (2000, 8000, 32_000):  # growth well below the square
        c = r.standard_normal((n // 40, 64))
        v = c[r.integers(0, len(c), n)] + 0.25 * r.standard_normal((n, 64))
        counter = spark.sparkContext.accumulator(0)
        pq.write_table(pa.table({"vec_id": pa.array(range(n)), "embedding": pa.array(list(v))}), tmp_path / f"{n}.parquet")
        got = neighbours.neighbours(spark.read.parquet(str(tmp_path / f"{n}.parquet")), counter=counter).toPandas()
        queries = np.arange(0, n, 20)
        assert _recall(got, v, queries) >= 0.9
        shares.append(counter.value / (n * len(queries)))
    assert shares[2] < 0.2 and shares[2] < shares[1] / 2 < shares[0] / 4


def test_pipeline_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "pii", "mixing", "packing"]
    assert 0 < got.doc_id.nunique() < docs.count() and got.groupby("bin_id").n_tokens.sum().max() <= packing.CAPACITY
