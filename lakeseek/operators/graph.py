"""Property graph as two tables: nodes (node_id, labels, name, properties, docs) and edges (edge_id, src, dst, type).

Traversals are at most three joins deep and keep only ids on the way; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import digest, region_id

HIDDEN = ("Region", "Document", "Chunk", "Section", "Code", "Image")
ROOTS = ("Document", "Code", "Image", "DataFile")
DEPTH = 3
LIMIT = 100


def node(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node of this id; no row if there is none."""
    return nodes.where(F.col("node_id") == node_id)


def by_labels(nodes: DataFrame, labels: Sequence[str]) -> DataFrame:
    return nodes.where(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels])))


def by_chunks(rows: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Nodes or edges that name any of the chunks (chunk_id) as a source."""
    owners = rows.select(key, F.explode("source_chunk_ids").alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id", "left_semi").select(key).distinct()
    return rows.join(owners, key, "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b): every edge in both directions, by one pass over the edges."""
    return edges.select(F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))))


def neighbours(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """(node_id, hops) of every node within ``depth`` (1 to 3) undirected steps of a start (node_id), the starts left out."""
    return reach(edges, starts.select(F.lit(0).alias("start"), "node_id"), depth).select("node_id", "hops")


def reach(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """(start, node_id, hops) for every start of its own: starts are (start, node_id), one or more nodes each; a depth below 1 gives nothing.

    Each step joins all that was reached so far with the edges and keeps the least number of hops, one aggregation a step in place of
    anti joins with all that was seen.
    """
    links = both_ways(edges)
    seen = starts.select("start", "node_id", F.lit(0).alias("hops")).distinct()
    for k in range(1, min(depth, DEPTH) + 1):
        step = seen.where(F.col("hops") == k - 1).join(links, F.col("node_id") == F.col("a")).select("start", F.col("b").alias("node_id"), F.lit(k).alias("hops"))
        seen = seen.unionAll(step).groupBy("start", "node_id").agg(F.min("hops").alias("hops"))
    return seen.where("hops > 0")


def neighbourhood(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 1, limit: int = LIMIT, clamp: bool = True) -> tuple[DataFrame, DataFrame]:
    """The nodes around the starts (node_id) and the edges among starts and nodes, each once.

    clamp: the depth is taken as 1 to 3; else a depth below 1 gives nothing. Breadth first, a level whose start reaches the limit is the
    last one, as a whole; within it all nodes count. A limit below 1 is none.
    """
    depth = max(1, depth) if clamp else depth
    own = starts.select(F.col("node_id").alias("start"), "node_id")
    found = reach(edges, own, depth)
    last_level = min(depth, DEPTH)
    full = None
    if limit > 0 and depth > 1:
        size = found.groupBy("start", "hops").agg(F.count("*").alias("n"))
        before = W.partitionBy("start").orderBy("hops").rowsBetween(W.unboundedPreceding, -1)
        sizes = size.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        open_ = sizes.where(F.col("before") < limit)
        found = found.join(open_.select("start", "hops"), ["start", "hops"])
        full = sizes.where(F.col("before") + F.col("n") >= limit).groupBy("start").agg(F.min("hops").alias("stop"))
    inside = own.select("start", "node_id", F.lit(0).alias("hops")).where(F.lit(depth > 0))
    inside = inside.unionByName(found.where(F.col("hops") < depth)) if depth > 1 else inside
    # an edge is met when the nearer end is left behind: every edge of a node from which a further level was taken, whoever its start is
    goes = F.col("hops") < last_level
    if full is not None:
        inside = inside.join(full, "start", "left")
        goes = goes & (F.col("stop").isNull() | (F.col("hops") < F.col("stop")))
    left = inside.where(goes).select("node_id").distinct()
    whole = edges.where("src is not null and dst is not null")
    ways = [whole.join(left.select(F.col("node_id").alias(c)), c, "left_semi").select(*edges.columns) for c in ("src", "dst")]
    if depth > 1:  # within the last level of a start that is not the last of all, only the edges between its nodes
        held = inside.where(~goes).select("start", "node_id", "hops")
        a, b = (held.select(F.col("start").alias(f"s{x}"), F.col("node_id").alias(x), F.col("hops").alias(f"h{x}")) for x in ("a", "b"))
        ways.append(whole.join(a, F.col("src") == F.col("a")).join(b, (F.col("dst") == F.col("b")) & (F.col("sa") == F.col("sb")) & (F.col("ha") == F.col("hb"))).select(*edges.columns))
    links = reduce(DataFrame.unionAll, ways).dropDuplicates(["src", "dst", "type"])
    around = found.select("node_id").distinct().join(starts.select("node_id"), "node_id", "left_anti") if clamp else found.select("node_id").distinct()
    return nodes.join(around, "node_id", "left_semi"), links


def label_counts(nodes: DataFrame, hidden: Sequence[str] = HIDDEN) -> DataFrame:
    each = nodes.select(F.explode(F.array_distinct("labels")).alias("label"))
    return each.where(~F.col("label").isin(list(hidden))).groupBy("label").agg(F.count("*").alias("n"))


def node_score(frequency: Column, confidence: Column) -> Column:
    return F.least(F.lit(1.0), 0.3 + 0.01 * frequency + 0.1 * confidence)


def edge_score(score: Column, confidence: Column) -> Column:
    return F.least(F.lit(1.0), 0.2 + 0.1 * score + 0.1 * confidence)


def match_names(nodes: DataFrame, word: str, most: int = 20) -> DataFrame:
    """Nodes whose name holds the word or is held by it."""
    name = F.col("name")
    return nodes.where(name.contains(word) | (F.instr(F.lit(word), name) > 0)).orderBy("node_id").limit(most)


def match_queries(nodes: DataFrame, queries: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, node_id): for each of the queries (query_id, word) the first nodes that ``match_names`` finds.

    A theta join on substrings; the side that Spark knows to be small is sent to the tasks, and each task keeps ``most`` a query.
    """
    hold = F.col("name").contains(F.col("word")) | F.col("word").contains(F.col("name"))
    pair = nodes.select("node_id", "name").join(queries.select("query_id", "word"), hold)
    return pair.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("node_id"))).where(F.col("r") <= most).select("query_id", "node_id")


def _number(properties: str, key: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(properties), F.lit(key)).try_cast("double"), F.lit(0.0))


def search(nodes: DataFrame, edges: DataFrame, word: str, most: int = 20, around: int = 10) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, seed, score) whose name matches, with one step of neighbours, and the edges between (src, dst, type, score).

    Each seed brings up to ``around`` neighbours, the first by id, with the edges to them.
    """
    seeds = match_names(nodes, word, most).select("node_id")
    met = seeds.join(both_ways(edges), F.col("node_id") == F.col("a")).select("a", "b").distinct()
    met = met.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy("b"))).where(F.col("r") <= around).select("a", "b")
    ids = seeds.select("node_id", F.lit(True).alias("seed")).unionAll(met.select("b", F.lit(False))).groupBy("node_id").agg(F.bool_or("seed").alias("seed"))
    score = node_score(_number("properties", "frequency"), _number("properties", "confidence"))
    out = nodes.join(ids, "node_id").select("node_id", "seed", F.round(score, 6).alias("score"))
    links = met.select(F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))).distinct()
    e = edges if "properties" in edges.columns else edges.withColumn("properties", F.create_map().cast("map<string,string>"))
    weight = edge_score(_number("properties", "score"), _number("properties", "confidence"))
    return out, e.join(links, (F.col("src") == F.col("x")) & (F.col("dst") == F.col("y"))).select("src", "dst", "type", F.round(weight, 6).alias("score")).distinct()


# ---- regions: a folder is a node, its documents hang on it by CONTAINS

def save_roots(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with the documents of ``roots`` (node_id, dir, file_name), their Region nodes and CONTAINS edges.

    Root nodes get dir and file_name as properties; a Region or an edge that is there already stays as it is.
    """
    folder = F.lower("dir")
    own = roots.select("node_id", F.create_map(F.lit("dir"), folder, F.lit("file_name"), F.lower("file_name")).alias("_own"))
    entries = F.concat(F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,string>"))), F.coalesce(F.map_entries("_own"), F.array().cast("array<struct<key:string,value:string>>")))
    merged = F.map_from_entries(F.transform(F.array_distinct(F.transform(entries, lambda e: e["key"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value"))))
    known = nodes.join(own, "node_id", "left").withColumn("properties", F.when(F.col("_own").isNotNull(), merged).otherwise(F.col("properties"))).select(*nodes.columns)
    region = roots.select(region_id(folder).alias("node_id"), F.array(F.lit("Region")).alias("labels"), F.regexp_extract(folder, "([^/]*)/?$", 1).alias("name"), F.create_map(F.lit("dir"), folder).alias("properties")).dropDuplicates(["node_id"])
    new = region.join(nodes.select("node_id"), "node_id", "left_anti")
    links = roots.select(region_id(folder).alias("src"), F.col("node_id").alias("dst"), F.lit("CONTAINS").alias("type")).distinct().withColumn("edge_id", digest(F.col("src"), F.col("type"), F.col("dst")))
    fresh = links.join(edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")
    return known.unionByName(new, allowMissingColumns=True), edges.unionByName(fresh.select(*[c for c in fresh.columns if c in edges.columns]), allowMissingColumns=True)


def roots_under(nodes: DataFrame, folder: str, file_name: str | None = None, labels: Sequence[str] = ROOTS) -> DataFrame:
    """Root nodes whose folder starts with this path; with a file name, those of exactly this folder and file."""
    own = F.try_element_at("properties", F.lit("dir"))
    rows = by_labels(nodes, labels)
    if file_name is None:
        return rows.where(own.startswith(folder.lower()))
    return rows.where((own == folder.lower()) & (F.try_element_at("properties", F.lit("file_name")) == file_name.lower()))


def count_by_region(nodes: DataFrame, folder: str) -> DataFrame:
    """(n): the root documents below a folder, summed over their labels."""
    each = roots_under(nodes, folder).select(F.explode(F.array_intersect("labels", F.array(*[F.lit(x) for x in ROOTS]))))
    return each.agg(F.count("*").alias("n"))


def explore_region(nodes: DataFrame, edges: DataFrame, folder: str, depth: int = 1, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """The region of a folder, the documents below it and what lies around them, with the edges between, each once."""
    region = nodes.where(F.col("node_id") == region_id(F.lit(folder.lower())))
    starts = region.select("node_id").unionAll(roots_under(nodes, folder).select("node_id")).distinct()
    around, links = neighbourhood(nodes, edges, starts, depth, limit)
    ids = starts.unionAll(around.select("node_id")).distinct()
    return nodes.join(ids, "node_id", "left_semi"), links


def explore_file(nodes: DataFrame, edges: DataFrame, folder: str, file_name: str, depth: int = 2, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """The root nodes of one file and what lies around them, with the edges between."""
    starts = roots_under(nodes, folder, file_name).select("node_id")
    around, links = neighbourhood(nodes, edges, starts, depth, limit)
    return nodes.join(starts.unionAll(around.select("node_id")).distinct(), "node_id", "left_semi"), links


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes (node_id) and every edge that touches them."""
    left = edges.join(gone.select(F.col("node_id").alias("src")), "src", "left_anti").join(gone.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone.select("node_id"), "node_id", "left_anti"), left.select(*edges.columns)


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the edges of these ids (edge_id)."""
    return edges.join(gone.select("edge_id"), "edge_id", "left_anti")


def remove_chunks(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the edges, then the nodes, that name any of the chunks (chunk_id) as a source; edges of nodes that go, go too."""
    edges = edges.join(by_chunks(edges, chunks, "edge_id").select("edge_id"), "edge_id", "left_anti")
    return detach_delete(nodes, edges, by_chunks(nodes, chunks, "node_id"))


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """New nodes replace those of the same id; name and sources are kept as properties too."""
    from .vector import upsert

    sources = [F.struct(F.lit(k).alias("key"), F.array_join(c, ",").alias("value")) for k, c in (("source_chunk_ids", "source_chunk_ids"), ("source_doc_ids", "source_doc_ids")) if c in new.columns]
    own = F.array(F.struct(F.lit("name").alias("key"), F.col("name").alias("value")), *sources)
    kept = F.filter(F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,string>"))), lambda e: ~F.exists(own, lambda o: o["key"] == e["key"]))
    return upsert(nodes, new.withColumn("properties", F.map_from_entries(F.concat(kept, own))), ["node_id"])


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """New edges replace those of the same ends and type."""
    from .vector import upsert

    return upsert(edges, new, ["src", "dst", "type"])


def tree(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(node_id, parent_id, depth) along CONTAINS edges, flat; roots have no parent."""
    contains = edges.where("type = 'CONTAINS'").select("src", "dst")
    level = roots.select("node_id", F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"))
    out = level
    for k in range(1, depth + 1):
        level = level.select("node_id").join(contains, F.col("node_id") == F.col("src")).select(F.col("dst").alias("node_id"), F.col("src").alias("parent_id"), F.lit(k).alias("depth"))
        out = out.unionAll(level)
    return out


def document_tree(nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(node_id, parent_id, type, name, depth): regions, their documents, and the chunks of these by ``doc_id``, flat.

    nodes need ``docs``, the ids of the documents that a node comes from.
    """
    regions = by_labels(nodes, ["Region"])
    documents = by_labels(nodes, ROOTS)
    placed = documents.join(edges.where("type = 'CONTAINS'").select("src", "dst").join(regions.select(F.col("node_id").alias("src")), "src", "left_semi"), F.col("node_id") == F.col("dst"))
    one = regions.select("node_id", F.lit(None).cast("string").alias("parent_id"), F.lit("Region").alias("type"), "name", F.lit(0).alias("depth"))
    two = placed.select("node_id", F.col("src").alias("parent_id"), F.lit("Document").alias("type"), "name", F.lit(1).alias("depth"))
    owner = placed.select(F.col("node_id").alias("parent_id"), F.explode("docs").alias("doc_id")).distinct()
    three = chunks.select(F.col("chunk_id").alias("node_id"), F.col("title").alias("name"), "doc_id").join(owner, "doc_id").select("node_id", "parent_id", F.lit("Chunk").alias("type"), "name", F.lit(2).alias("depth"))
    return one.unionAll(two).unionAll(three)
