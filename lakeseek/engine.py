"""Facade: index folders or tables of text, search, browse the graph.

Every change is written out (a reliable checkpoint), so a search reads chunks, vectors and graph and parses nothing again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import cut
from .extensions import HashedEmbedder, Hooks, Query, Refiller, Summarizer, log
from .functions import text as T
from .functions.ids import digest
from .operators import code, datum, graph, meta, result, split, vector
from .plans import cypher, view
from .sources import files

hashed_embedding = HashedEmbedder()
NODES = "node_id string, labels array<string>, name string, properties map<string,string>, source_chunk_ids array<string>, docs array<string>"
EDGES = "edge_id string, src string, dst string, type string, source_chunk_ids array<string>"


class Engine:
    def __init__(self, spark: SparkSession, embed=hashed_embedding, summarize: Summarizer | None = None, refill: Refiller | None = None, hooks: Hooks | None = None, chunker: Callable[[DataFrame], DataFrame] = split.chunks):
        self.spark, self.embed, self.summarize, self.refill, self.hooks, self.chunker = spark, embed, summarize, refill, hooks or Hooks(), chunker
        self.chunks: DataFrame | None = None
        self.vectors: DataFrame | None = None
        self.nodes = spark.createDataFrame([], NODES)
        self.edges = spark.createDataFrame([], EDGES)

    # ---- index

    def add_folder(self, folder: str, rules=()) -> DataFrame:
        docs = files.scan(self.spark, folder, rules).where("error is null")
        return self.add(docs.select("doc_id", "file_name", F.col("content")))

    def add(self, docs: DataFrame) -> DataFrame:
        """docs: (doc_id, file_name, content). Returns the chunks; a document added again replaces its chunks, vectors and nodes."""
        docs = cut(self.hooks.change("before_chunk", docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("file_name", F.lit("")).alias("file_name"), "content")))
        made = self.hooks.change("chunked", self.chunker(docs))
        if self.summarize is not None:
            made = self.summarize(meta.resume(made, self.chunks) if self.chunks is not None else made)
        made = cut(made)
        fresh = cut(vector.index_rows(made, self.embed))
        if self.chunks is not None:
            gone = self.chunks.join(docs.select("doc_id"), "doc_id", "left_semi").select("chunk_id")
            self.vectors = cut(self.vectors.join(gone, "chunk_id", "left_anti").unionByName(fresh))
            self.nodes, self.edges = (cut(x) for x in graph.remove_chunks(self.nodes, self.edges, gone))
            self.chunks = cut(self.chunks.join(docs.select("doc_id"), "doc_id", "left_anti").unionByName(made))
        else:
            self.chunks, self.vectors = made, fresh
        self.hooks.tell("chunks_saved", made)
        try:
            self._add_graph(docs, made)
        except Exception as e:  # the index is useful without its graph
            log.warning("graph of %d documents failed: %s", docs.count(), e)
        return self.chunks

    def _add_graph(self, docs: DataFrame, chunks: DataFrame) -> None:
        folder, base = T.folder(F.col("file_name")), T.stem(F.col("file_name"))
        label = split.content_type(split.route(F.col("file_name")))
        of = chunks.groupBy("doc_id").agg(F.collect_set("chunk_id").alias("_ids"))
        roots = docs.join(of, "doc_id").select(digest(F.col("doc_id"), base, label).alias("node_id"), F.array(label).alias("labels"), base.alias("name"), F.create_map().cast("map<string,string>").alias("properties"), F.col("_ids").alias("source_chunk_ids"), F.array("doc_id").alias("docs"), folder.alias("dir"), "file_name")
        nodes = roots.drop("dir", "file_name")
        links = self.spark.createDataFrame([], EDGES)
        if self.refill is not None:
            entities, relations = self.refill(chunks.where(f"char_length(content) >= {split.SUMMARY}"))
            own = entities.withColumn("entity_id", digest(F.col("name"), F.col("type")))
            owner = own.join(chunks.select("chunk_id", "doc_id"), "chunk_id")
            nodes = nodes.unionByName(owner.groupBy("entity_id").agg(F.first("name").alias("name"), F.array(F.first("type")).alias("labels"), F.collect_set("chunk_id").alias("source_chunk_ids"), F.collect_set("doc_id").alias("docs")).select(F.col("entity_id").alias("node_id"), "labels", "name", F.create_map(F.lit("frequency"), F.size("source_chunk_ids").cast("string")).alias("properties"), "source_chunk_ids", "docs"))
            named = own.groupBy("name").agg(F.min("entity_id").alias("entity_id"))
            known = relations.join(named.select(F.col("name").alias("subject"), F.col("entity_id").alias("src")), "subject").join(named.select(F.col("name").alias("object"), F.col("entity_id").alias("dst")), "object")
            links = links.unionByName(known.groupBy("src", "predicate", "dst").agg(F.collect_set("chunk_id").alias("source_chunk_ids")).select(digest(F.col("src"), F.col("predicate"), F.col("dst")).alias("edge_id"), "src", "dst", F.col("predicate").alias("type"), "source_chunk_ids"))
        nodes, links = self.hooks.change("before_graph", nodes, links)
        nodes, links = graph.save_roots(vector.upsert(self.nodes, nodes, ["node_id"]), vector.upsert(self.edges, links, ["edge_id"]), roots)
        self.nodes, self.edges = cut(nodes), cut(links)
        self.hooks.tell("graph_saved", self.nodes, self.edges)

    def remove(self, doc_id: str) -> None:
        """The chunks of a document, their vectors, and what the graph has from them."""
        gone = cut(self.chunks.where(F.col("doc_id") == doc_id).select("chunk_id"))
        self.hooks.tell("removed", gone)
        self.remove_chunks(gone)

    def remove_chunks(self, gone: DataFrame) -> None:
        self.nodes, self.edges = (cut(x) for x in graph.remove_chunks(self.nodes, self.edges, gone))
        self.vectors = cut(vector.delete(self.vectors, gone, "chunk_id"))
        self.chunks = cut(vector.delete(self.chunks, gone, "chunk_id"))

    def refill_dimensions(self) -> None:
        self.vectors = cut(vector.refill(self.vectors, self.chunks, self.embed))

    def clear(self) -> None:
        self.chunks = self.vectors = None
        self.nodes, self.edges = self.spark.createDataFrame([], NODES), self.spark.createDataFrame([], EDGES)

    # ---- search

    def search(self, text: str | Query, k: int = 10, folder: str | None = None, rerank: bool = False, dedup: bool = False, fold: bool = True) -> DataFrame:
        """(chunk_id, title, content, score): the k best chunks by cosine, dimensions folded, children into parents that are hits too, then the boost for query words."""
        q = text if isinstance(text, Query) else Query(text)
        best = self._semantic(q, k, folder, fold)
        if rerank:
            score = vector.cosine(self.embed(F.col("content")), self._vector(q.raw))
            best = best.withColumn("score", F.round(score, 6))
        if dedup:
            best = result.minhash_dedup(best, "doc_id", "chunk_id", "content")
        return self._boosted(best, q).select("chunk_id", "title", "content", "score").orderBy(F.desc("score"), "chunk_id")

    def _vector(self, text: str):
        values = self.spark.range(1).select(self.embed(F.lit(text)).alias("v")).first().v
        return F.array(*[F.lit(float(x)) for x in values])

    def _semantic(self, q: Query, k: int, folder: str | None, fold: bool = True) -> DataFrame:
        rows = vector.where(self.chunks, exact=q.filters)
        if folder is not None:
            rows = rows.where(vector.under(F.col("dir"), folder))
        scored = self.vectors.select("chunk_id", F.round(vector.cosine(F.col("vector"), self._vector(q.raw)), 6).alias("score"))
        hits = vector.fold_dimensions(scored).join(rows.select("chunk_id", "parent_id"), "chunk_id")
        best = hits.orderBy(F.desc("score"), "chunk_id").limit(k)
        best = vector.fold_parents(best) if fold else best.select("chunk_id", "score")
        return rows.join(F.broadcast(best), "chunk_id").select("chunk_id", "doc_id", "title", "summary", "content", "score")  # at most k rows

    def _boosted(self, hits: DataFrame, q: Query) -> DataFrame:
        score = result.boost(F.col("score"), q.keywords(), F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.array().cast("array<string>"))
        return hits.withColumn("score", F.round(score, 9))

    def hyper_search(self, text: str | Query, k: int = 10, weights: tuple[float, float] = (1.0, 0.7)) -> dict[str, DataFrame]:
        """chunks, nodes and edges, each fused by rank from the semantic and the graph side; chunks are boosted. A graph that fails gives none."""
        q = text if isinstance(text, Query) else Query(text)
        semantic = self._semantic(q, k, None)
        fused = result.rrf([(semantic.select("chunk_id", "score"), weights[0])], "chunk_id")
        chunks = self._boosted(semantic.drop("score").join(fused, "chunk_id"), q)
        try:
            nodes, edges = graph.search(self.nodes, self.edges, q.raw)
            nodes = result.rrf([(None, weights[0]), (nodes.select("node_id", "score"), weights[1])], "node_id")
            edges = result.rrf([(edges.select(F.concat_ws(":", "src", "type", "dst").alias("edge"), "score"), weights[1])], "edge")
        except Exception as e:
            log.warning("graph search failed: %s", e)
            nodes = edges = None
        return {"chunks": chunks.orderBy(F.desc("score"), "chunk_id"), "nodes": nodes, "edges": edges}

    def search_any(self, text: str, k: int = 10, fold: bool = True) -> DataFrame:
        """Alternatives parted by ``|`` are searched apart and fused by rank."""
        return result.rrf([(self.search(part.strip(), k, fold=fold).select("chunk_id", "score"), 1.0) for part in text.split("|") if part.strip()], "chunk_id")

    # ---- browse

    def status(self) -> DataFrame:
        return self.chunks.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"))

    def document(self, doc_id: str) -> DataFrame:
        return vector.rebuild(self.chunks.where(F.col("doc_id") == doc_id), "doc_id")

    def tree(self) -> DataFrame:
        return graph.document_tree(self.nodes, self.edges, self.chunks)

    def explore_region(self, folder: str, depth: int = 1, limit: int = 100) -> tuple[DataFrame, DataFrame]:
        return graph.explore_region(self.nodes, self.edges, folder, depth, limit)

    def explore_file(self, path: str, depth: int = 2, limit: int = 100) -> tuple[DataFrame, DataFrame]:
        folder, _, name = path.rpartition("/")
        return graph.explore_file(self.nodes, self.edges, folder, path, depth, limit) if name else graph.explore_region(self.nodes, self.edges, folder, depth, limit)

    def count_by_region(self, folder: str) -> DataFrame:
        return graph.count_by_region(self.nodes, folder)

    def query_graph(self, text: str, params: dict | None = None) -> DataFrame:
        return cypher.run(self.nodes, self.edges, text, params)

    def write_graph(self, text: str, params: dict | None = None) -> DataFrame | None:
        nodes, edges, rows = cypher.execute(self.nodes, self.edges, text, params)
        self.nodes, self.edges = cut(nodes), cut(edges)
        return rows

    cypher = staticmethod(cypher.run)
    view = staticmethod(view.query)
    neighbours = staticmethod(graph.neighbours)
    split_code = staticmethod(code.graph)
    split_data = staticmethod(datum.split)
