"""Paged views over the nodes of one label: a specification compiled to columns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAD_FIELD = 40002


class ViewError(ValueError):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Spec:
    label: str
    equals: dict = field(default_factory=dict)
    among: dict[str, Sequence] = field(default_factory=dict)
    between: dict[str, tuple] = field(default_factory=dict)
    contains: dict[str, str] = field(default_factory=dict)
    order: Sequence[tuple[str, bool]] = ()  # (field, descending)
    columns: Sequence[str] = ()
    page: int = 1
    size: int = 20


def _field(name: str, known: Sequence[str]) -> str:
    if not re.fullmatch(r"[A-Za-z_]\w*", name, re.ASCII) or name not in known:
        raise ViewError(BAD_FIELD, f"unknown field: {name}")
    return name


def matching(nodes: DataFrame, spec: Spec, fields: Sequence[str]) -> DataFrame:
    """All rows of the view, the declared fields as columns (strings)."""
    _field(spec.label, [spec.label])
    df = nodes.where(F.array_contains("labels", spec.label)).select("node_id", *[F.try_element_at("properties", F.lit(f)).alias(f) for f in fields])
    number = lambda name, value: F.col(name).try_cast("double") if isinstance(value, (int, float)) else F.col(name)
    for name, value in spec.equals.items():
        df = df.where(number(_field(name, fields), value) == value)
    for name, values in spec.among.items():
        if values:
            df = df.where(number(_field(name, fields), values[0]).isin(list(values)))
    for name, (low, high) in spec.between.items():
        if low is not None:
            df = df.where(number(_field(name, fields), low) >= low)
        if high is not None:
            df = df.where(number(_field(name, fields), high) <= high)
    for name, part in spec.contains.items():
        df = df.where(F.col(_field(name, fields)).contains(part))
    return df


def order_keys(name: str, down: bool) -> list:
    """Numbers by value, then texts; empty ones last."""
    keys = [F.col(name).try_cast("double"), F.col(name)]
    return [k.desc_nulls_last() if down else k.asc_nulls_last() for k in keys]


def query(nodes: DataFrame, spec: Spec, fields: Sequence[str]) -> DataFrame:
    """One page; an order by fields that are not declared is left out, ties and the default go by id. Numbers are ordered by value."""
    size = min(spec.size if spec.size > 0 else 20, 200)
    keys = [k for n, down in spec.order if n in fields for k in order_keys(n, down)]
    columns = ["node_id", *[_field(c, fields) for c in spec.columns or fields]]
    return matching(nodes, spec, fields).orderBy(*keys, "node_id").offset((max(spec.page, 1) - 1) * size).limit(size).select(*columns)


def page(nodes: DataFrame, spec: Spec, fields: Sequence[str]) -> tuple[DataFrame, int]:
    """One page and the number of all rows."""
    return query(nodes, spec, fields), matching(nodes, spec, fields).count()


def describe(nodes: DataFrame, label: str) -> DataFrame:
    """(field, type, n): the properties that nodes of a label have, with the type that all values are read as: boolean, number or string."""
    _field(label, [label])
    each = nodes.where(F.array_contains("labels", label)).select(F.explode("properties").alias("field", "value")).where("value is not null")
    kind = F.when(F.bool_and(F.col("value").isin("true", "false")), "boolean").when(F.bool_and(F.col("value").try_cast("double").isNotNull()), "number").otherwise("string")
    return each.groupBy("field").agg(kind.alias("type"), F.count("*").alias("n"))
