"""Vector collection: filters, exact top-k, folds, pages, and writes as last-writer-wins merges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def where(df: DataFrame, exact: dict | None = None, prefix: dict | None = None) -> DataFrame:
    """All exact and all prefix conditions hold."""
    for key, value in (exact or {}).items():
        df = df.where(F.col(key) == F.lit(value))
    for key, value in (prefix or {}).items():
        df = df.where(F.col(key).cast("string").startswith(value))
    return df


def under(path: Column, folder: str) -> Column:
    """The folder itself or what lies below; ``/foo`` does not hold ``/foobar``."""
    root = folder.rstrip("/").lower()
    return (F.lower(path) == root) | F.lower(path).startswith(root + "/")


def top_k(vectors: DataFrame, query: Sequence[float], k: int = 10, key: str = "vec_id", vector: str = "embedding", exact: dict | None = None) -> DataFrame:
    """(key, score) of the k nearest by cosine; one pass and no shuffle of the table (take-ordered)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return where(vectors, exact).select(key, F.round(cosine(F.col(vector), q), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def batch_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", most: int = 4096) -> DataFrame:
    """(query_id, key, score, rank): queries are (query_id, query).

    Up to ``most`` queries at a time are sent to the tasks, which multiply them with whole Arrow batches of vectors and keep the best k
    of each batch, ties included, so little is shuffled. A null query or vector, or one of another length, has score 0.
    """
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query"))
    first = asked.limit(most + 1).collect()
    blocks = 1 if len(first) <= most else -(-asked.count() // most)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double"
    slim = vectors.select(key, F.col(vector).cast("array<double>").alias("_v"))
    out = None
    for block in range(blocks):
        rows = first if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()
        part = slim.mapInPandas(_products([r.query_id for r in rows], [r.query for r in rows], k, key), kinds)
        out = part if out is None else out.unionAll(part)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _products(ids: list, rows: list, k: int, key: str):
    by_size: dict[int, list[int]] = {}
    for i, q in enumerate(rows):
        by_size.setdefault(len(q or ()), []).append(i)

    def unit(m: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    held = {n: (at, unit(np.array([rows[i] for i in at], float).reshape(len(at), n))) for n, at in by_size.items()}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if not len(p) or not ids:
                continue
            size = p["_v"].map(lambda v: -1 if v is None else len(v)).to_numpy()
            score = np.zeros((len(ids), len(p)))
            for n, (at, q) in held.items():
                mine = np.flatnonzero(size == n)
                if n and len(mine):
                    score[np.ix_(at, mine)] = q @ unit(np.stack(p["_v"].to_numpy()[mine]).astype(float)).T
            score = np.round(score, 6)
            least = np.partition(score, len(p) - k, axis=1)[:, len(p) - k] if len(p) > k else np.full(len(ids), -2.0)
            r, c = np.nonzero(score >= least[:, None])
            yield pd.DataFrame({"query_id": [ids[i] for i in r], key: p[key].to_numpy()[c], "score": score[r, c]})

    return run


def fold_dimensions(hits: DataFrame) -> DataFrame:
    """(chunk_id, score): the best of a chunk's content, title and summary hits."""
    return hits.groupBy("chunk_id").agg(F.max("score").alias("score"))


def fold_parents(hits: DataFrame) -> DataFrame:
    """(chunk_id, score): a child goes into its parent where that is a hit too; scores travel with the rows."""
    parent = hits.select(F.col("chunk_id").alias("_p"), F.lit(True).alias("_there"))
    folded = hits.join(parent, F.col("parent_id") == F.col("_p"), "left")
    return folded.select(F.when(F.col("_there"), F.col("parent_id")).otherwise(F.col("chunk_id")).alias("chunk_id"), "score").groupBy("chunk_id").agg(F.max("score").alias("score"))


def page(df: DataFrame, order: Sequence[str | Column], number: int = 1, size: int = 20, most: int = 200) -> DataFrame:
    size = min(max(size, 1), most)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same keys; one shuffle on the keys."""
    rows = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    names = [c for c in old.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "_v").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in names])


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def rerank(hits: DataFrame, vectors: DataFrame, query: Sequence[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Scores are replaced by the cosine of query and content."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return hits.select(key).join(vectors, key).select(key, F.round(cosine(F.col(vector), q), 6).alias("score"))


# ---- up to three vectors for each chunk: of its content, title and summary

DIMENSIONS = ("content", "title", "summary")


def index_rows(chunks: DataFrame, embed) -> DataFrame:
    """(chunk_id, dim, vector): one for each of content, title and summary that has text; ``embed`` maps a text column to a vector column."""
    have = [c for c in DIMENSIONS if c in chunks.columns]
    each = chunks.select("chunk_id", F.inline(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).alias("text")) for c in have])))
    return each.where("trim(coalesce(text, '')) <> ''").select("chunk_id", "dim", embed(F.col("text")).alias("vector"))


def refill(vectors: DataFrame, chunks: DataFrame, embed) -> DataFrame:
    """``vectors`` (chunk_id, dim, vector) with those that chunks lack; once done, doing it again adds nothing."""
    missing = index_rows(chunks, embed).join(vectors.select("chunk_id", "dim"), ["chunk_id", "dim"], "left_anti")
    return vectors.unionByName(missing)


def count_main(vectors: DataFrame, dim: str = "content") -> DataFrame:
    """(vectors, main): all vectors, and those of the content."""
    return vectors.agg(F.count("*").alias("vectors"), F.count_if(F.col("dim") == dim).alias("main"))


def resolve_dimensions(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (chunk_id, dim, score) folded to chunks that exist: the best score, and the columns of the chunk."""
    return fold_dimensions(hits).join(chunks, "chunk_id")


def patch_metadata(rows: DataFrame, patches: DataFrame, key: str = "chunk_id", column: str = "metadata") -> DataFrame:
    """Each key of a patch (key, patch map) replaces that of the row's metadata. A patch without a row raises ``KeyError`` with the count."""
    missing = patches.join(rows.select(key), key, "left_anti").count()
    if missing:
        raise KeyError(f"{missing} patches have no row")
    one = patches.select(F.col(key).alias("_key"), F.col("patch").alias("_patch"))
    old, new = F.coalesce(column, F.create_map().cast("map<string,string>")), F.col("_patch")
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    merged = F.when(new.isNull(), F.col(column)).otherwise(F.map_concat(kept, new))
    return rows.join(one, F.col(key) == F.col("_key"), "left").withColumn(column, merged).select(*rows.columns)


def delete_some(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``delete`` that raises ``KeyError`` when no row has any of the keys."""
    if rows.join(gone.select(key), key, "left_semi").isEmpty():
        raise KeyError("nothing to delete")
    return delete(rows, gone, key)


def clear(rows: DataFrame) -> DataFrame:
    return rows.limit(0)


def page_with_total(df: DataFrame, order: Sequence[str | Column], number: int = 1, size: int = 20) -> tuple[DataFrame, int]:
    return page(df, order, number, size), df.count()


def rebuild(parts: DataFrame, key: str, index: str = "index", text: str = "content", between: str = "\n") -> DataFrame:
    """(key, text): the parts of each document in order."""
    rows = F.array_sort(F.collect_list(F.struct(index, text)))
    return parts.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x[text]), between).alias(text))
