"""What a user of the engine can bring: embedder, summariser, refiller, hooks, a recorder of usage.

All work on DataFrames; the ones that call a model do it by Arrow batches.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger("lakeseek")


class Embedder(Protocol):
    """A text column to a vector column of ``dim`` numbers."""

    dim: int
    multimodal: bool

    def __call__(self, text: Column) -> Column: ...


class HashedEmbedder:
    """A deterministic bag of hashed words: the default where no model is given. One pass over the words."""

    multimodal = False

    def __init__(self, dim: int = 256):
        self.dim = dim

    def __call__(self, text: Column) -> Column:
        dim = self.dim
        zero = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.lit(0.0).cast("float"))
        words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z\\x{80}-\\x{10ffff}]+"), lambda w: w != "")
        return F.coalesce(_histogram(dim)(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))), zero)


def _histogram(dim: int):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda x: np.bincount(np.asarray(x, np.int64), minlength=dim).astype(np.float32) if x is not None else None)

    return run


class BatchEmbedder:
    """A model that maps a list of texts to a matrix; ``load`` is called once in each worker."""

    def __init__(self, dim: int, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 256, multimodal: bool = False):
        self.dim, self.load, self.batch, self.multimodal = dim, load, batch, multimodal

    def __call__(self, text: Column) -> Column:
        load, batch, dim = self.load, self.batch, self.dim

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for p in parts:
                rows: list[np.ndarray] = []
                for at in range(0, len(p), batch):
                    got = np.asarray(model(p.iloc[at : at + batch].fillna("").tolist()), np.float32)
                    if got.ndim != 2 or got.shape[1] != dim:
                        raise ValueError(f"vectors of {got.shape[-1]} numbers instead of {dim}")
                    rows += list(got)
                yield pd.Series(rows, index=p.index)

        return run(text)


class Summarizer(Protocol):
    """Chunks (chunk_id, content, ...) to the same rows with title and summary filled."""

    def __call__(self, chunks: DataFrame) -> DataFrame: ...


class Refiller(Protocol):
    """Chunks to entities (chunk_id, name, type) and relations (chunk_id, subject, predicate, object)."""

    def __call__(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]: ...


def summarizer(model: Callable[[list[str]], list[tuple[str, str]]], least: int = 200) -> Summarizer:
    """From a function of texts to (title, summary): texts of under ``least`` signs and failed batches keep what they have."""

    def run(chunks: DataFrame) -> DataFrame:
        def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                p = p.copy()
                some = p.index[p["content"].fillna("").str.len() >= least]
                if len(some):
                    try:
                        got = model(p.loc[some, "content"].tolist())
                        p.loc[some, "title"], p.loc[some, "summary"] = [x[0] for x in got], [x[1] for x in got]
                    except Exception as e:  # a model that fails must not stop the index
                        log.warning("summaries of %d chunks failed: %s", len(some), e)
                yield p

        return chunks.mapInPandas(fill, chunks.schema)

    return run


@dataclass
class Hooks:
    """Called in order. The first three change what they get; the others are told, and what they raise is logged only (but ``on_error``)."""

    before_chunk: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    chunked: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    before_graph: list[Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]] = field(default_factory=list)
    chunks_saved: list[Callable[[DataFrame], None]] = field(default_factory=list)
    graph_saved: list[Callable[[DataFrame, DataFrame], None]] = field(default_factory=list)
    removed: list[Callable[[DataFrame], None]] = field(default_factory=list)

    @classmethod
    def of(cls, *parts: object) -> Hooks:
        """Every part is registered for each hook that it has a method for."""
        out = cls()
        for p in parts:
            for name in cls.__dataclass_fields__:
                if callable(f := getattr(p, name, None)):
                    getattr(out, name).append(f)
        return out

    def change(self, name: str, *value):
        for f in getattr(self, name):
            got = f(*value)
            value = got if isinstance(got, tuple) else (got,)
        return value if len(value) > 1 else value[0]

    def tell(self, name: str, *value) -> None:
        for f in getattr(self, name):
            try:
                f(*value)
            except Exception as e:
                log.warning("hook %s failed: %s", name, e)


@dataclass
class Query:
    """What is asked. kind: semantic, keyword, hybrid or graph; filters are equalities on columns of the chunks."""

    raw: str
    kind: str = "semantic"
    filters: dict = field(default_factory=dict)
    depth: int = 1
    limit: int = 10
    edge_types: tuple[str, ...] = ()

    def keywords(self) -> list[str]:
        return [w for w in self.raw.split() if w]


def as_json(df: DataFrame) -> DataFrame:
    """(json) of each row; null fields are left out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def as_text(df: DataFrame, most: int = 20, width: int = 60) -> str:
    """A table for the terminal."""
    rows = [[("" if x is None else str(x)).replace("\n", " ")[:width] for x in r] for r in df.limit(most).collect()]
    wide = [max(len(c), *(len(r[k]) for r in rows)) if rows else len(c) for k, c in enumerate(df.columns)]
    line = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, wide)).rstrip()
    return "\n".join([line(df.columns), "  ".join("-" * w for w in wide), *map(line, rows)])
