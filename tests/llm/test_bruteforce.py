"""Each operator without SQL, and the stages of the pipeline, against a plain version of the same rule."""

import itertools
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeseek.llm import common, fingerprint, mixing, ngram_join, packing, pii, quality, suffix, toxicity

CLASH = "doc_id long, text string, source string, n_chars long, _surplus long, _s string, _last long, _key double, _log_ratio double, _spans int, h long, c long"


def words(seed, n, vocabulary=5000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def clashing(spark, texts, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], t, f"s{k % 3}", len(t or ""), k, "x", 1, 0.5, 0.5, 1, k, k) for k, t in enumerate(texts)], CLASH)


def trigrams(t):
    w = re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (t or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())


def near_groups(texts, ids, threshold=0.5):
    """Least id of the group of each text, by all pairs."""
    sets, root = [trigrams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if ids[i] is not None and ids[j] is not None and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    members = defaultdict(set)
    for k in range(len(texts)):
        if ids[k] is not None:
            members[find(k)].add(ids[k])
    return {d: min(m) for m in members.values() for d in m if len(m) > 1}


def near_copies():
    """Groups of near copies, half of all texts with one long passage, some hardly anything but it."""
    r, texts, passage = random.Random(5), [], words(77, 25)
    for k in range(40):
        base = words(100 + k, r.randrange(30, 90)).split()
        for _ in range(r.randrange(1, 5)):
            copy = [w if r.random() > 0.02 else "zz" for w in base]
            texts.append(" ".join(copy) + (" " + passage if k % 2 else ""))
    return texts + [passage, passage + " tail", "odd " + passage, None, "", "!!", "one", "One."]


@pytest.mark.parametrize("block,hot,sent", [(4096, 512, 10**6), (6, 6, 10**6), (6, 6, 0)])
def test_ngram_join(spark, monkeypatch, block, hot, sent):
    monkeypatch.setattr(ngram_join, "SENT", sent)
    texts = near_copies()
    ids = list(range(len(texts)))
    ids[3] = None
    df = clashing(spark, [*texts, texts[0]], [*ids, 0])
    truth = near_groups(texts, ids)
    got = {r.doc_id: (r.group_id, r.group_size) for r in ngram_join.groups(df, block=block, hot=hot).collect()}
    size = Counter(truth.values())
    assert got == {d: (g, size[g]) for d, g in truth.items()}
    kept = ngram_join.keep_one(df, block=block, hot=hot)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d in [*ids, 0] if d is None or truth.get(d, d) == d)


def test_ngram_join_leaves_large_trees(spark):
    """A passage in every text: no tree holds all texts, as each is routed by its other n-grams."""
    passage = words(1, 20)
    texts = [words(50 + k // 2, 80) + " " + passage + (" x" if k % 2 else "") for k in range(120)]
    docs = clashing(spark, texts)
    alike = docs.mapInArrow(ngram_join._summary(3, ngram_join.KEPT), "doc_id long, c long, n int, least array<long>")
    classes = common.cut(alike.groupBy("c").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("least").alias("least")))
    before = classes.select(F.explode(F.slice("least", 1, 8)).alias("a")).groupBy("a").count().agg(F.max("count")).first()[0]
    after = ngram_join._spread(classes, 8, 20).groupBy("anchor").count().where("count > 20").count()
    assert before > 60 and after == 0
    assert {r.doc_id: r.group_id for r in ngram_join.groups(docs, hot=20).collect()} == near_groups(texts, range(120))


def apart(seeds):
    """Pairs of texts that just reach the threshold."""
    return [words(3 * k, 70) + " " + words(3 * k + i, 33) for k in seeds for i in (1, 2)]


#: Of each of these pairs the eight least n-grams by hash have none in common.
APART = (2585, 20589, 23186, 25874, 35540, 37582, 48791)


@pytest.mark.parametrize("levels,hot,block", [((16, 128), 512, 4096), ((2, 3), 3, 5), ((1,), 4, 4096)])
def test_ngram_join_links(spark, monkeypatch, levels, hot, block):
    """Every pair at the threshold is found, however few n-grams it shares, and every link of a group counts, at any limits."""
    monkeypatch.setattr(ngram_join, "LEVELS", levels, raising=False)
    texts = [*apart(APART), *near_copies()]
    docs = clashing(spark, [*texts, texts[0], texts[-20] + "!"])
    texts += [texts[0], texts[-20] + "!"]
    sets = [trigrams(t) for t in texts]
    near = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    assert {(2 * k, 2 * k + 1) for k in range(len(APART))} <= near
    assert {(x.doc_a, x.doc_b) for x in ngram_join.pairs(docs, block=block, hot=hot).collect()} == near
    truth = near_groups(texts, range(len(texts)))
    least = {i: min(j for j in range(len(texts)) if sets[j] == sets[i]) for i in truth}
    links = {i: len({frozenset(sets[a + b - i]) for a, b in near if i in (a, b)} - {frozenset(sets[i])}) for i in truth}
    size = Counter(truth.values())
    got = {x.doc_id: (x.group_id, x.group_size, x.class_id, x.links) for x in ngram_join.groups(docs, block=block, hot=hot).collect()}
    assert got == {i: (g, size[g], least[i], links[i]) for i, g in truth.items()}
    assert max(links.values()) > 2


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_ngram_join_shuffles_less_than_its_sets(spark):
    """Unlike texts: what is shuffled stays under the four bytes that each n-gram takes in its bucket, as not all are sent."""
    texts = [" ".join(str(w) for w in random.Random(k).sample(range(10**6), 600)) for k in range(300)]
    before = shuffled(spark)
    assert ngram_join.groups(clashing(spark, texts)).count() == 0
    assert shuffled(spark) - before < 3.6 * sum(len(trigrams(t)) for t in texts)


@pytest.mark.parametrize("levels", [(16, 128), (1,)])
@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.9])
def test_ngram_join_pairs_of_what_is_not_sent(spark, monkeypatch, levels, threshold):
    """Pairs that share few n-grams, of some all among those that the first level leaves out."""
    monkeypatch.setattr(ngram_join, "LEVELS", levels)
    texts = [t for k in range(60) for t in (words(k, 3 + k // 12), words(k, 3 + k // 12) + " more" * (1 + k % 2))]
    sets = [trigrams(t) for t in texts]
    near = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}
    column = clashing(spark, texts).toArrow().column("text").combine_chunks()
    h, _, at = ngram_join._sets(column, 3)
    sent = [set(h[a:b][h[a:b] < ngram_join._below(threshold)].tolist()) for a, b in zip(at, at[1:])]
    assert threshold > 0.5 or any(not sent[i] & sent[j] for i, j in near)
    assert {(x.doc_a, x.doc_b) for x in ngram_join.pairs(clashing(spark, texts), threshold=threshold).collect()} == near


def test_components_go_on_to_the_end(spark):
    chain = [(k, k + 1) for k in range(90)] + [(1000, 1001), (7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(1, 91), 0) | {1001: 1000}


def test_suffix_hot_phrases(spark, monkeypatch):
    shared = words(9, 70)
    texts = [words(20 + k, 30 + k) + " " + shared + " " + words(60 + k, 20) for k in range(8)] + [words(90, 55) + " " + words(91, 55), words(92, 10) + " " + words(91, 55), None, ""]
    df = clashing(spark, texts)
    rows = lambda: {tuple(r) for r in suffix.repeats(df).collect()}
    plain = rows()
    w = [re.findall(r"\w+", t or "") for t in texts]
    at = defaultdict(list)
    for d, x in enumerate(w):
        for p in range(len(x) - 49):
            at[tuple(x[p : p + 50])].append((d, p))
    cover = {(d, q, (d, p) != o[0]) for o in at.values() if len({d for d, _ in o}) > 1 for d, p in o for q in range(p, p + 50)}
    assert {(d, q, c) for d, a, z, _, c in plain for q in range(a, z)} == cover
    monkeypatch.setattr(suffix, "HOT", 3)
    assert rows() == plain


# ---- PII

TEXTS = [
    *[f"phone +1 (301) 555-{1000 + 7 * k} or write" for k in range(20)],
    *[f"mail user{k}@example.com now, version {k}.2 of 14" for k in range(5)],
    *[f"token=ab{random.Random(k).randrange(10**11)}cdEF{k} here" for k in range(4)],
    "phone 555 123 4567 or", "phone DE89 3704 0044 0532 0130 00 today", "phone 123-45-6789", "db_password: correcthorse", "on 2024-05-16 or 7 then", None, "", "no mark at all", "phone 555 123 4567 or",
]


def learnt(texts, confidence=pii.MIN_CONFIDENCE, support=pii.MIN_SUPPORT):
    """Bootstrapping with dictionaries: the accepted patterns."""
    rank = lambda s: (s is not None, s or "")
    edges, seed_of = {}, {}
    for t in texts:
        for _, v, left, right, seed in pii.mentions(t or ""):
            for p in pii.patterns(v, left, right):
                if p is not None:
                    edges[v, p] = max(edges.get((v, p)), seed, key=rank)
            seed_of[v] = max(seed_of.get(v), seed, key=rank)
    alone = lambda p: p.startswith("* ") or p.endswith(" *")
    scored = {e: (s or None, None if s is None else float(s != "")) for e, s in edges.items()}
    accepted = {}
    while True:
        votes = defaultdict(lambda: defaultdict(lambda: [0.0, 0.0]))
        for (_, p), (kind, x) in scored.items():
            x = 0.0 if x is None and alone(p) else x
            if x is not None:
                votes[p][kind][0] += x
                votes[p][kind][1] += 1 - x
        fresh = {}
        for p, by in votes.items():
            kind = max(by, key=lambda k: (by[k][0], rank(k)))
            share = by[kind][0] / (sum(map(sum, by.values())) + 0.5)
            if p not in accepted and kind and share >= confidence and by[kind][0] >= support:
                fresh[p] = (kind, share)
        if not fresh:
            return accepted
        accepted |= fresh
        reach = {}
        for (v, p), s in edges.items():
            if s is None and p in accepted:
                reach.setdefault(v, []).append(accepted[p])
        best = {v: (max((c, k) for k, c in x)[1], max(c for _, c in x)) for v, x in reach.items()}
        scored = {(v, p): (s or best.get(v, (None, None))[0], 0.0 if s == "" else 1.0 if s else best.get(v, (None, None))[1]) for (v, p), s in edges.items()}


def test_pii_brute_force(spark):
    ids = [None if k == 2 else k for k in range(len(TEXTS))]
    df = clashing(spark, TEXTS, ids)
    accepted = learnt(TEXTS)
    truth, clean = Counter(), []
    for d, t in zip(ids, TEXTS):
        last, out = 0, ""
        for at, v, left, right, seed in pii.mentions(t or ""):
            kind = seed or (None if seed == "" else next((accepted[p][0] for p in pii.patterns(v, left, right) if p in accepted), None))
            if kind:
                truth[d, at, len(v), kind, v] += 1
                out += t[last:at] + f"<{kind}>"
                last = at + len(v)
        clean.append((d, None if t is None else out + t[last:]))
    assert Counter((r.doc_id, r.start, r.length, r.kind, r.value) for r in pii.find(df).collect()) == truth
    assert (29, 6, 12, "PHONE", "555 123 4567") in truth and (32, 13, 12, "SECRET", "correcthorse") in truth
    got = pii.redact(df)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(clean)
    assert all(r.n_chars == len(r.text or "") for r in got.collect())


def test_pii_redact_with_many_patterns(spark, monkeypatch):
    df = clashing(spark, TEXTS, [None if k == 2 else k for k in range(len(TEXTS))])
    plain = Counter(map(tuple, pii.redact(df).collect()))
    monkeypatch.setattr(pii, "KNOWN", 0)
    assert Counter(map(tuple, pii.redact(df).collect())) == plain


@pytest.mark.parametrize("text", ["x" * 200_000 + " 1", "中" * 50_000 + " 1", "1)" * 100_000 + "x", "1-" * 100_000 + "x", "a@" * 100_000, "password " * 20_000 + "1", " " * 200_000 + "1", "1 " * 100_000])
def test_pii_is_linear(text):
    t = time.time()
    list(pii.mentions(text))
    assert time.time() - t < 3  # hours, where the time follows the square


# ---- quality


def test_quality_brute_force(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["clear", "plain", "text", "that", "reads", "well"]) if k % 3 else r.choice(["%%%", "###", "zz9", "q!!"]) for _ in range(r.randrange(5, 60))) for k in range(240)] + [None, ""]
    df = clashing(spark, [*texts, texts[0]], [*range(240), 240, None, 0])
    known = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(0, 120)], "doc_id long, quality int, toxic int")
    every = [*texts, texts[0]]
    ids = [*range(240), 240, None, 0]
    bucket = [quality.features(pa.array([t or ""]))[0] for t in every]
    target = {k for k in range(120) if k % 3}
    raw, aim = Counter(), Counter()
    for d, b in zip(ids, bucket):
        raw.update(b.tolist())
        if d in target:
            aim.update(b.tolist())
    n_raw, n_aim = sum(raw.values()) + quality.BUCKETS, sum(aim.values()) + quality.BUCKETS
    ratio = [sum(np.log((aim[x] + 1) / n_aim) - np.log((raw[x] + 1) / n_raw) for x in b.tolist()) for b in bucket]
    key = [v - np.log(-np.log(common.uniform(np.array([d or 0]), 6)[0])) for v, d in zip(ratio, ids)]
    for fraction in (0.3, None):
        got = quality.resample(df, known, fraction).collect()
        k = round(fraction * len(every)) if fraction else len(got)
        last = sorted(key, reverse=True)[k - 1]
        assert Counter(r.doc_id for r in got) == Counter(d for d, x in zip(ids, key) if x >= last - 1e-9)
        assert all(abs(x.log_ratio - ratio[ids.index(x.doc_id)]) < 1e-6 for x in got)
        if fraction is None:  # the share of good ones among all with a text
            assert abs(k - sum(1 for d in ids[:240] if d % 3) - 1) <= 2
    kept = quality.keep(df, known)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got)
    assert quality.keep(df, known.where("false")).count() == df.count()


def test_kth_largest_of_close_values(spark):
    x = [1.0 + k * 2.0**-52 for k in range(5) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    assert [quality.kth_largest(df, "v", k, small=10) for k in (1, 3000, 3001, 14_999)] == [sorted(x, reverse=True)[k - 1] for k in (1, 3000, 3001, 14_999)]


# ---- toxicity


def test_ordinal_fit_is_the_optimum():
    """The gradient of the plain cumulative-link likelihood, by differences, is near zero at the fit."""
    r = np.random.default_rng(1)
    x = r.integers(0, 2, (400, 6))
    y = np.clip(x[:, :3].sum(1) + r.integers(-1, 2, 400), 0, 3)
    row, feature = np.nonzero(x)
    m = toxicity.ordinal_fit(row, feature, y, 6, rounds=4000, rate=0.02)
    weight = np.sqrt(len(y) / (np.bincount(y, minlength=4)[y] * 4))

    def loss(w, theta):
        p = 1 / (1 + np.exp(-((x @ w)[:, None] - theta[None])))
        mass = np.concatenate([np.ones((len(y), 1)), p], 1) - np.concatenate([p, np.zeros((len(y), 1))], 1)
        return -(weight * np.log(mass[np.arange(len(y)), y])).mean() + 0.5 * 1e-3 * (w * w).sum()

    best = loss(m.weights, m.thetas)
    for k in range(9):
        for step in (1e-3, -1e-3):
            w, theta = m.weights.copy(), m.thetas.copy()
            (w if k < 6 else theta)[k % 6] += step
            assert loss(w, theta) > best - 2e-6
    assert (np.diff(m.thetas) > 0).all()


def test_toxicity_brute_force(spark):
    r = random.Random(7)
    rows = []
    for k in range(300):
        w = [f"calm{r.randrange(300)}" for _ in range(30)]
        if k % 3 == 0:
            w[: 1 + k % 4] = [f"slur{x}" for x in r.sample(range(6), 1 + k % 4)]
        rows.append(" ".join(w))
    df = clashing(spark, [*rows, None, "", rows[0]], [*range(300), 300, 301, None])
    for labels in ([(k, 1, int(k % 3 == 0)) for k in range(150)], [(k, 1, (1 + (k % 4 > 0) + (k % 4 > 2)) if k % 3 == 0 else 0) for k in range(150)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        model = toxicity.fit(df, known)
        got = {x.doc_id: x for x in toxicity.score(df, known).collect()}
        assert len(got) == 303
        for k, t in [*enumerate(rows), (300, ""), (301, ""), (None, rows[0])]:
            feature = set((toxicity.features(pa.array([t]))[0]).astype(int).tolist())
            s = sum(model.weights[f] for f in feature)
            above = 1 / (1 + np.exp(-(s - model.thetas)))
            mass = [1 - above[0], *(above[:-1] - above[1:]), above[-1]]
            assert abs(got[k].expected_severity - above.sum()) < 1e-4 and got[k].toxic == (above[0] > 0.5) and mass[got[k].grade] > max(mass) - 1e-6
        severe = [np.mean([got[k].expected_severity for k in range(150, 300) if (1 + k % 4 if k % 3 == 0 else 0) == g]) for g in range(5)]
        assert severe[0] < severe[1] < severe[3] and sum(got[k].toxic == (k % 3 == 0) for k in range(150, 300)) >= 143


# ---- packing


def bins_needed(items, room):
    """The least number of bins, by trying all."""
    items = sorted(items, reverse=True)
    best = len(items)

    def place(k, space):
        nonlocal best
        if len(space) >= best:
            return
        if k == len(items):
            best = len(space)
            return
        for i in {s: i for i, s in enumerate(space)}.values():
            if space[i] >= items[k]:
                space[i] -= items[k]
                place(k + 1, space)
                space[i] += items[k]
        place(k + 1, [*space, room - items[k]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_packing_is_near_the_optimum(seed):
    r = random.Random(seed)
    counts = Counter(r.choice([2, 3, 5, 7, 8, 11]) for _ in range(11))
    got = packing.plan(counts, 16)
    used = Counter()
    for pattern, bins in got:
        assert sum(s * a for s, a in pattern.items()) <= 16 and bins > 0
        for s, a in pattern.items():
            used[s] += a * bins
    assert used == counts
    assert sum(b for _, b in got) <= bins_needed(counts.elements(), 16) + 1
    # no pattern whatever has a value above one: the linear program is at its optimum
    sizes = np.array(sorted(counts))
    columns, amount = packing.solve(sizes, np.array([counts[s] for s in sizes], float), 16)
    dual = np.linalg.solve(columns.T.astype(float), np.ones(len(sizes)))
    for p in itertools.product(*[range(16 // s + 1) for s in sizes]):
        assert np.dot(p, sizes) > 16 or np.dot(p, dual) <= 1 + 1e-6
    assert np.allclose(columns @ amount, [counts[s] for s in sizes])


def test_packing_fills_bins_and_texts_come_back(spark):
    r = random.Random(2)
    texts = ["  " + words(k, r.choice([1, 40, 300, 900, 2048, 4500])) + ("\nénd " if k % 2 else "") for k in range(200)] + [None, "", "   ", "one"]
    df = clashing(spark, [*texts, texts[1], texts[1]], [*range(202), None, None, 1, 1])
    got = packing.pack(df, text=True).toPandas()
    plain = packing.pack(df).toPandas()
    assert Counter(map(tuple, plain.fillna(-1).values.tolist())) == Counter(map(tuple, got.drop(columns="text").fillna(-1).values.tolist()))
    for d in (0, 7, 33):
        assert "".join(got[got.doc_id == d].sort_values("piece").text) == texts[d]
    assert (got.text.map(lambda t: len(t.split())) == got.n_tokens).all()
    assert got.n_tokens.sum() == sum(len((t or "").split()) for t in [*texts, texts[1], texts[1]])
    assert got.n_tokens.sum() / (got.bin_id.nunique() * packing.CAPACITY) > 0.9


# ---- fingerprints


def test_merge_and_containment_of_unequal_texts(spark):
    big = words(4, 30_000)
    texts = [big, " ".join(big.split()[5000:9000]), words(5, 3000) + " " + " ".join(big.split()[:3000]), words(6, 2000), None, ""]
    s = fingerprint.sketch(clashing(spark, texts))
    rows = {r.doc_id: r for r in s.collect()}
    shingles = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in ((t or "").split() for t in texts)]
    assert all(rows[k].n_shingles == len(x) for k, x in enumerate(shingles)) and rows[4].sketch == rows[5].sketch == []
    got = {r.a: r.containment for r in fingerprint.containment(s.withColumnRenamed("doc_id", "a"), s.where("doc_id = 0").withColumnRenamed("doc_id", "b"), "a", "b").collect()}
    for k in (1, 2):
        assert abs(got[k] - len(shingles[k] & shingles[0]) / len(shingles[k])) < 0.08
    assert 3 not in got and got[0] == 1
    merged = fingerprint.merge(s.withColumn("all", F.lit(1)), "all").first().sketch
    assert merged == sorted({h for r in rows.values() for h in r.sketch})
    union = len(set.union(*shingles))
    assert abs(len(merged) / fingerprint.FRACTION / union - 1) < 0.08


# ---- the pipeline


def test_pipeline_brute_force(spark, tmp_path):
    """Every stage's rows are those that the plain versions above give for its own input."""
    r = random.Random(1)
    good = [" ".join(r.choice(["clear", "plain", "text", "that", "reads", "well"]) + str(r.randrange(400)) for _ in range(r.randrange(30, 90))) for _ in range(120)]
    bad = [" ".join(r.choice(["%%%", "###", "zz9!", "q!!"]) for _ in range(40)) for _ in range(40)]
    texts = [*good, *bad, *[g + " end" for g in good[:30]], *[f"{good[k]} mail user{k}@example.com" for k in range(60, 66)], None, ""]
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 7 if k % 2 else 0}", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, int(k < 120), 0) for k in range(0, 160, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    one = corpus_pipeline.by_quality(spark, docs, sf).cache()
    assert {x.doc_id for x in one.collect()} == {x.doc_id for x in quality.resample(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    got = {x.doc_id for x in one.collect()}
    assert not got & set(range(120, 160)) and len({*range(120), *range(160, 196)} - got) <= 2
    two = corpus_pipeline.by_ngram_join(spark, one, sf).cache()
    left = [(x.doc_id, x.text) for x in one.collect()]
    truth = near_groups([t for _, t in left], [d for d, _ in left])
    assert {x.doc_id for x in two.collect()} == {d for d, _ in left if truth.get(d, d) == d}
    three = corpus_pipeline.by_pii(spark, two, sf).cache()
    accepted = learnt([x.text for x in two.collect()])
    for x in two.collect():
        y = three.where(F.col("doc_id") == x.doc_id).first()
        found = [v for _, v, a, b, seed in pii.mentions(x.text or "") if seed or (seed is None and any(p in accepted for p in pii.patterns(v, a, b)))]
        assert (y.text != x.text) == bool(found) and (x.text is None or y.n_chars == len(y.text))
    four = corpus_pipeline.by_mixing(spark, three, sf).cache()
    assert {x.doc_id for x in four.collect()} == {x.doc_id for x in mixing.mix(three).collect()} | {x.doc_id for x in four.where("text is null or trim(text) = ''").collect()}
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    five = corpus_pipeline.by_packing(spark, four, sf).toPandas()
    for x in four.collect():
        if (x.text or "").strip():
            assert "".join(five[five.doc_id == x.doc_id].sort_values("piece").text) == x.text
    assert {tuple(x) for x in corpus_pipeline.run(spark, sf).collect()} == {tuple(x) for x in five.itertuples(index=False)}


def test_pipeline_near_copies_at_the_threshold(spark):
    """One of each pair is dropped, though their eight least n-grams by hash have none in common."""
    docs = clashing(spark, apart(APART))
    assert sorted(x.doc_id for x in corpus_pipeline.by_ngram_join(spark, docs, "").collect()) == list(range(0, 2 * len(APART), 2))


def test_pipeline_near_copies_of_any_case(spark):
    """Capitals of all letters are folded, so a copy in capitals is a copy whatever its language."""
    r = random.Random(8)
    plain = [" ".join("".join(r.choice("éöñжσçşd") for _ in range(4)) + r.choice("ςáx") for _ in range(40)) for _ in range(12)]
    docs = clashing(spark, [*plain, *(t.upper() for t in plain[:4]), *(t.title() for t in plain[4:8])])
    texts = [x.text for x in docs.orderBy("doc_id").collect()]
    truth = near_groups(texts, range(len(texts)))
    assert len(truth) == 16
    assert {x.doc_id: x.group_id for x in ngram_join.groups(docs).collect()} == truth
    assert {x.doc_id for x in corpus_pipeline.by_ngram_join(spark, docs, "").collect()} == {k for k in range(len(texts)) if truth.get(k, k) == k}


def test_pipeline_near_copies_of_ids_with_several_texts(spark):
    """An id with several texts links all that any of them reaches: none of these is without a row, and of each group the least id stays."""
    r = random.Random(9)
    texts = [t for k in range(30) for t in (words(700 + k, 40), words(700 + k, 40) + " end", words(700 + k, 40) + " other end")]
    rows = [(r.randrange(250), t) for t in texts] + [(1003, words(1, 40)), (1005, words(1, 41)), (1005, words(2, 40)), (1007, words(2, 41)), (1009, words(2, 42))]
    docs = clashing(spark, [t for _, t in rows], [k for k, _ in rows])
    sets, root = [trigrams(t) for _, t in rows], {k: k for k, _ in rows}
    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j]):
            a, b = root[rows[i][0]], root[rows[j][0]]
            root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    size = Counter(root.values())
    assert {root[k] for k in (1003, 1005, 1007, 1009)} == {1003}
    assert {x.doc_id: (x.group_id, x.group_size) for x in ngram_join.groups(docs).collect()} == {k: (g, size[g]) for k, g in root.items() if size[g] > 1}
    assert Counter(x.doc_id for x in corpus_pipeline.by_ngram_join(spark, docs, "").collect()) == Counter(k for k, _ in rows if root[k] == k)


@pytest.mark.parametrize("count,block", [(1, 4096), (8, 4096), (8, 4)])
def test_near_copies_at_a_threshold_that_floats_round_up(spark, count, block):
    """0.55 * 100 is above 55, yet 55 of 100 n-grams reach 0.55."""
    whole = [f"w{k}" for k in range(102)]
    texts = [" ".join(whole), *(" ".join(whole[5 * k : 5 * k + 57]) for k in range(count))]
    docs = clashing(spark, texts)
    got = {(x.doc_a, x.doc_b) for x in ngram_join.pairs(docs, threshold=0.55, block=block).collect()}
    assert {(0, k) for k in range(1, count + 1)} <= got
    assert [x.doc_id for x in ngram_join.keep_one(docs, threshold=0.55, block=block).collect()] == [0]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
