"""Document metadata: change detection, chunk differences, status, usage, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .vector import delete_some, under, upsert

#: What may follow a status.
STATUS = {"pending": ("indexing",), "indexing": ("indexed", "failed"), "indexed": ("indexing", "partial_deleted"), "failed": ("indexing",), "partial_deleted": ("indexing",)}


def changes(listing: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, change): new, changed, deleted or same, by size, time and hash; both sides are (key, size, mtime, hash)."""
    a, b = listing.alias("a"), known.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    same = F.col("a.hash").eqNullSafe(F.col("b.hash")) & F.col("a.size").eqNullSafe(F.col("b.size")) & F.col("a.mtime").eqNullSafe(F.col("b.mtime"))
    change = F.when(F.col(f"b.{key}").isNull(), "new").when(F.col(f"a.{key}").isNull(), "deleted").when(same, "same").otherwise("changed")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), change.alias("change"))


def chunk_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, action): SkipAll where title, content and summary agree, SkipRefill where only the summary is missing, else Full."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.expr("a.doc_id = b.doc_id and a.index = b.index"), "full")
    same = F.expr("a.title <=> b.title and a.content <=> b.content and a.doc_id is not null and b.doc_id is not null")
    rows = joined.select(F.expr("coalesce(a.doc_id, b.doc_id)").alias("doc_id"), same.alias("same"), F.expr("coalesce(a.summary, '') <> ''").alias("done"))
    flags = rows.groupBy("doc_id").agg(F.bool_and("same").alias("same"), F.bool_and("done").alias("done"))
    return flags.select("doc_id", F.expr("case when not same then 'Full' when done then 'SkipAll' else 'SkipRefill' end").alias("action"))


def resume(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks with the summaries that equal chunks (chunk_id) had before; those without one are still to be made."""
    before = done.where("coalesce(summary, '') <> ''").select("chunk_id", F.col("summary").alias("_s")).dropDuplicates(["chunk_id"])
    return chunks.join(before, "chunk_id", "left").withColumn("summary", F.coalesce(F.nullif("summary", F.lit("")), "_s", F.lit(""))).select(*chunks.columns)


def put(known: DataFrame, new: DataFrame) -> DataFrame:
    """Records by path: new ones replace old ones; file_name and ext come from the path."""
    path = F.col("path")
    return upsert(known, new.withColumns({"file_name": text.file_name(path), "ext": text.extension(path)}).select(*known.columns), ["path"])


def drop(known: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the records of these paths; ``KeyError`` if none is there."""
    return delete_some(known, gone, "path")


def with_status(known: DataFrame, status: str | None = None, folder: str | None = None) -> DataFrame:
    """Records of a status, and those of a folder or below it."""
    rows = known if status is None else known.where(F.col("status") == status)
    return rows if folder is None else rows.where(under(F.col("path"), folder))


def may_follow(old: Column, new: Column) -> Column:
    """Whether a status may follow another; anything but what ``STATUS`` lists is refused, a first status must be pending or indexing."""
    allowed = F.lit(False)
    for k, after in STATUS.items():
        allowed = allowed | ((old == k) & new.isin(*after))
    return F.when(old.isNull(), new.isin("pending", "indexing")).otherwise(allowed)


def count_by_status(known: DataFrame, status: str = "status") -> DataFrame:
    return known.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))


def recent(rows: DataFrame, time: str, key: str, most: int = 0) -> DataFrame:
    """The newest first; below 1 all of them."""
    ordered = rows.orderBy(F.desc(time), F.desc(key))
    return ordered.limit(most) if most > 0 else ordered


def record_usage(usages: DataFrame, new: DataFrame) -> DataFrame:
    return usages.unionByName(new)


def usage_totals(usages: DataFrame, by: str, tokens: Column, model: Column, key: str) -> DataFrame:
    """(by, total, latest): the tokens used, and the model of the greatest key."""
    return usages.groupBy(by).agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("total"), F.max_by(model, F.col(key)).alias("latest"))


def folder_sizes(files: DataFrame, folder: str, size: str) -> DataFrame:
    """(folder, documents, size): of each folder its files and their bytes."""
    return files.groupBy(folder).agg(F.count("*").alias("documents"), F.sum(size).alias("size"))


#: Rows that a task makes of a product, about; as many relations and as many entities of a name are in a block.
TASK_ROWS, BLOCK = 4_000_000, 1_000


def relations_to_ids(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations (subject, predicate, object) between the ids of entities (name, entity_id); those with an unknown end are left out.

    A name of many entities in many relations gives their product: the rows returned grow with the square of the input, the work of a task does not.
    """
    starts = with_ids(relations.select("subject", "predicate", "object"), "subject", entities, "src")
    return with_ids(starts, "object", entities, "dst").select("src", "dst", F.col("predicate").alias("type"))


def with_ids(rows: DataFrame, key: str, entities: DataFrame, name: str) -> DataFrame:
    """The rows with the id of each entity (name, entity_id) that their key names.

    The rows to come are counted first. If they are more than a task's, names of more than a block are joined by blocks of about ``BLOCK``
    rows of either side, in as many tasks as the count asks for.
    """
    e = entities.select(F.col("name").alias(key), F.col("entity_id").alias(name))
    count = rows.groupBy(key).agg(F.count("*").alias("_n")).join(e.groupBy(key).agg(F.count("*").alias("_m")), key).withColumn("_p", F.col("_n") * F.col("_m"))
    gain, total = count.agg(F.sum(F.col("_p") - F.col("_n")), F.sum("_p")).first()
    if not gain or total <= TASK_ROWS:  # as many rows as before, or few
        return rows.join(e, key)
    spark = rows.sparkSession
    found = count.where(F.col("_p") > BLOCK * BLOCK)
    large = F.broadcast(spark.createDataFrame(found.collect(), found.schema))  # at most one name for each BLOCK * BLOCK rows to come
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))

    def blocks(df: DataFrame, own: str, other: str, a: str, b: str) -> DataFrame:
        """Each row in a block of its own side, for every block of the other side."""
        parts = lambda c: F.coalesce(F.ceil(F.col(c) / BLOCK), F.lit(1).cast("long"))
        placed = df.join(large, key, "left").withColumn(a, F.pmod(F.xxhash64(*df.columns), parts(own))).withColumn(b, F.explode(F.sequence(F.lit(0).cast("long"), parts(other) - 1)))
        return placed.drop("_n", "_m", "_p").repartition(tasks, key, "_a", "_b")

    return blocks(rows, "_n", "_m", "_a", "_b").join(blocks(e, "_m", "_n", "_b", "_a").hint("merge"), [key, "_a", "_b"]).drop("_a", "_b")
