"""Result algebra: reciprocal rank fusion, keyword boost, MinHash dedup, compression."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import cut

SLOTS = 128
SAME = 0.85
BANDS = 20


def rrf(sources: Sequence[tuple[DataFrame | None, float]], key: str, k: int = 60, by: Sequence[str] = ()) -> DataFrame:
    """(by, key, score): the sum of weight / (k + rank), rank from 1 within each source and each value of ``by``, such as a query or a collection.

    A weight of 0 counts as 1; sources that are None are left out. Without a source there is nothing to take the columns from: a ValueError.
    Give ``by`` where hits are many: without it a source is ranked as one list, in one task.
    """
    ranked = None
    for hits, weight in sources:
        if hits is None:
            continue
        rank = F.row_number().over(W.partitionBy(*[F.col(b) for b in by]).orderBy(F.desc("score"), key))
        part = hits.select(*by, key, (F.lit(float(weight or 1)) / (k + rank)).alias("s"))
        ranked = part if ranked is None else ranked.unionByName(part)
    if ranked is None:
        raise ValueError("no source")
    return ranked.groupBy(*by, key).agg(F.round(F.sum("s"), 9).alias("score"))


def hit_score(hits: DataFrame, by: Sequence[str] = (), collection: str = "collection") -> DataFrame:
    """(by, score): the sum of the best scores of each collection (chunks, nodes, edges)."""
    return hits.groupBy(*by, collection).agg(F.max("score").alias("s")).groupBy(*by).agg(F.round(F.sum("s"), 9).alias("score"))


def boost(score: Column, words: Sequence[str], title: Column, summary: Column, tags: Column, step: float = 0.15) -> Column:
    """A score grows by ``step`` for each of up to three query words that a tag equals or title or summary holds."""
    def holds(w: str) -> Column:
        return (F.lower(title).contains(w) | F.lower(summary).contains(w) | F.exists(tags, lambda t: F.lower(t) == w)).cast("int")

    found = F.lit(0)
    for word in words:
        found = found + holds(word.lower())
    return score * (1 + F.least(F.lit(1.0), F.lit(step) * F.least(F.lit(3), found)))


def _signature(texts: pd.Series) -> np.ndarray:
    """FNV-1a of each token's bytes and one seed byte, least of all tokens below 2**63, for every slot."""
    prime, out = np.uint64(0x100000001B3), np.zeros((len(texts), SLOTS), np.uint64)
    cut = str.maketrans({c: " " for c in "!\"#%&'()*,-./:;?@[\\]_{}、。，！？；：“”‘’（）《》【】…—"})
    cache: dict[str, int] = {}
    slots = np.arange(SLOTS, dtype=np.uint64)
    for i, text in enumerate(texts):
        words = {w for w in (text or "").translate(cut).lower().split() if len(w.encode()) > 2}
        if not words:
            continue
        for w in words:
            if w not in cache:
                h = 0xCBF29CE484222325
                for byte in w.encode():
                    h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
                cache[w] = h
        state = np.fromiter((cache[w] for w in words), np.uint64, len(words))
        least = np.full(SLOTS, 1 << 63, np.uint64)
        for at in range(0, len(state), 4096):  # a long text in pieces
            least = np.minimum(least, ((state[at : at + 4096, None] ^ slots[None]) * prime).min(0))
        out[i] = least
        if len(cache) > 1_000_000:
            cache.clear()
    return out


def minhash_dedup(hits: DataFrame, group: str, key: str, text: str = "text", score: str = "score") -> DataFrame:
    """``hits`` with one row of each cluster: rows of a group whose signatures agree in 85 % of the slots, transitively; the best score stays.

    Two signatures that agree in 109 of 128 slots differ in at most 19, so at least one of ``BANDS`` bands of six slots is alike: the join on
    bands misses no pair. Equal signatures of a group are one from the start, so the work follows the pairs that share a band.
    """
    kind = {f.name: f.dataType.simpleString() for f in hits.schema}

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), 256):
                q = p.iloc[at : at + 256]
                yield pd.DataFrame({"g": q["g"], "k": q["k"], "x": q["x"], "s": [x.tobytes() for x in _signature(q["t"])]})

    rows = hits.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(score).cast("double").alias("x"), F.col(text).alias("t")).mapInPandas(sign, f"g {kind[group]}, k {kind[key]}, x double, s binary")
    one = cut(rows.groupBy("g", "s").agg(F.min(F.struct((-F.col("x")).alias("x"), "k")).alias("best")).select("g", F.col("best.k").alias("k"), "s", "best"))
    bands = F.expr(f"transform(sequence(0, {BANDS - 1}), b -> struct(b as band, xxhash64(substring(s, b * 48 + 1, 48)) as h))")
    each = one.select("g", "k", "s", F.inline(bands))
    a, b = each.alias("a"), each.alias("b")
    pair = a.join(b, F.expr("a.g <=> b.g and a.band = b.band and a.h = b.h and a.k < b.k")).select(F.col("a.g").alias("g"), F.col("a.k").alias("k1"), F.col("b.k").alias("k2"), F.col("a.s").alias("s1"), F.col("b.s").alias("s2"))

    def agree(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x, y = (np.frombuffer(b"".join(p[c]), np.uint64).reshape(-1, SLOTS) for c in ("s1", "s2"))
                p = p[(x == y).mean(1) >= SAME].drop_duplicates(["g", "k1", "k2"])
            yield p[["g", "k1", "k2"]]

    edges = pair.mapInPandas(agree, f"g {kind[group]}, k1 {kind[key]}, k2 {kind[key]}").distinct()
    both = cut(edges.unionAll(edges.select("g", F.col("k2").alias("k1"), F.col("k1").alias("k2"))))
    label = one.select("g", "k", "best")
    while not both.isEmpty():  # the best row of a cluster spreads along the edges until nothing changes
        sent = both.join(label.withColumnsRenamed({"g": "_g", "k": "_k"}), F.col("g").eqNullSafe(F.col("_g")) & (F.col("k1") == F.col("_k"))).select("g", F.col("k2").alias("k"), "best", F.lit(1).alias("new"))
        spread = cut(label.withColumn("new", F.lit(0)).unionByName(sent).groupBy("g", "k").agg(F.min("best").alias("best"), F.min(F.struct("best", "new")).alias("by")))
        label = spread.select("g", "k", "best")
        if spread.where("by.new = 1").isEmpty():
            break
    chosen = label.where("k = best.k").select(F.col("g").alias("_g"), F.col("k").alias("_k"))
    return hits.join(chosen, F.col(group).eqNullSafe(F.col("_g")) & (F.col(key) == F.col("_k")), "left_semi")


def compress(hits: DataFrame, rewrite: Callable[[pd.Series], pd.Series], most: int = 5, text: str = "text") -> DataFrame:
    """The best hits with their text rewritten by a model; an empty answer keeps the text."""
    best = hits.orderBy(F.desc("score")).limit(most)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            new = rewrite(p[text])
            yield p.assign(**{text: new.where(new.fillna("").str.strip() != "", p[text])})

    return best.mapInPandas(run, hits.schema)
