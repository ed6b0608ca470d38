"""Identity columns: lowercase hex SHA-256 of joined parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def doc_id(file_name: Column, content: Column) -> Column:
    return F.sha2(F.coalesce(F.nullif(file_name, F.lit("")), content, F.lit("")), 256)


def region_id(folder: Column) -> Column:
    return F.sha2(F.lower(folder), 256)


def content_hash(content: Column) -> Column:
    """First 16 hex digits; empty for empty content."""
    return F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "").otherwise(F.substring(F.sha2(content, 256), 1, 16))
