"""Data files: containers become chunks titled by their path, scalars are pooled; parents and graph by path.

The text is parsed as YAML, of which JSON is a part, with the place of every node. A container of more than ``LIMIT`` bytes is split
further down to depth ``DEPTH``; a smaller one is a chunk of its own. Scalars gather in blocks of the other fields, closed at ``LIMIT``
bytes. What is no container or does not parse is split by lines. Positions are in bytes of UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import digest

LIMIT, DEPTH = 1500, 5
REST = "其余字段"
KINDS = {"csv": "CSV", "json": "JSON", "xml": "XML", "xls": "Excel", "xlsx": "Excel", "eml": "Email", "msg": "Email", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "log": "Log"}


def kind_of(name: str) -> str:
    base = (name or "").rpartition("/")[2]
    ext = base.rpartition(".")[2].lower() if "." in base else ""
    return KINDS.get(ext, ext.upper() or "Data")


def by_lines(text: str, kind: str) -> list[tuple[str, str, int, int]]:
    """(title, content, first byte, end) of runs of whole lines that fit into ``LIMIT`` bytes; a longer line stands alone."""
    out, held, first, start, at, size = [], [], 0, 0, 0, 0
    rows = text.split("\n")

    def close(end: int) -> None:
        body = "\n".join(held).rstrip("\n")
        out.append((f"{kind} 行 {first}-{end - 1}", body, start, start + len(body.encode())))

    for k, row in enumerate(rows):
        n = len(row.encode()) + 1
        if held and size + n > LIMIT:
            close(k)
            held, size = [], 0
        if not held:
            first, start = k, at
        held.append(row)
        size += n
        at += n
    close(len(rows))
    return out


def _yaml_tree(text: str):
    import yaml

    return yaml.compose(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))


def split_text(text: str, kind: str) -> list[tuple[str, str, int, int]]:
    """(title, content, first byte, end) of each chunk of one file, in the order in which they are closed."""
    if not text:
        return []
    if kind == "Log":
        return by_lines(text, kind)
    try:
        top = _yaml_tree(text)
    except Exception:  # whatever the parser does not like is split by lines
        return by_lines(text, kind)
    if top is None or top.id == "scalar":
        return by_lines(text, kind)
    data = text if text.isascii() else None
    place = [0]
    if data is None:
        for c in text:
            place.append(place[-1] + len(c.encode()))
    byte = (lambda k: k) if data is not None else place.__getitem__
    out: list[tuple[str, str, int, int]] = []
    rest: list[str] = []
    state = {"size": 0, "start": 0, "n": 0}

    def body(node) -> tuple[str, int, int]:
        a, z = node.start_mark.index, node.end_mark.index
        part = text[a:z].strip()
        return part, byte(a), byte(a) + len(part.encode())

    def emit(path: str, node) -> None:
        part, a, z = body(node)
        if part:
            out.append((f"{kind}.{path}" if path else kind, part, a, z))

    def close() -> None:
        if rest:
            state["n"] += 1
            part = "\n".join(rest).rstrip("\n")
            out.append((f"{kind}.{REST}{state['n'] if state['n'] > 1 else ''}", part, state["start"], state["start"] + len(part.encode())))
            rest.clear()
            state["size"] = 0

    def pool(a: int, z: int) -> None:
        part = text[a:z].strip()
        if not rest:
            state["start"] = byte(a)
        state["size"] += len(part.encode()) + bool(rest)
        rest.append(part)
        if state["size"] >= LIMIT:
            close()

    def walk(node, path: str, depth: int) -> None:
        pairs = [(k, v, k.start_mark.index, f"{path}.{k.value}" if path else str(k.value)) for k, v in node.value] if node.id == "mapping" else [(None, v, v.start_mark.index, f"{path}[{i}]") for i, v in enumerate(node.value)]
        for _, v, a, name in pairs:
            if v.id == "scalar":
                pool(a, v.end_mark.index)
            elif byte(v.end_mark.index) - byte(v.start_mark.index) > LIMIT and depth + 1 < DEPTH:
                walk(v, name, depth + 1)
            else:
                emit(name, v)

    walk(top, "", 0)
    close()
    return out or by_lines(text, kind)


def parent_title(title: str, kind: str) -> str | None:
    """The path without its last field or index; the kind itself at the top; None for what has no path or holds other fields."""
    if not title.startswith(kind + ".") or title.startswith(f"{kind}.{REST}"):
        return None
    path = title[len(kind) + 1 :]
    cut = max(path.rfind("."), path.rfind("["))
    return kind if cut <= 0 else f"{kind}.{path[:cut]}"


def split(docs: DataFrame) -> DataFrame:
    """(doc_id, file_name, kind, index, title, content, start_pos, end_pos, chunk_id, parent_id, parent_title) of every file (doc_id, file_name, content).

    A null or empty text gives no chunk; parent_id is that of the chunk with the parent's title, where there is one (of several, the last).
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for doc, name, text in zip(p["doc_id"], p["file_name"], p["content"]):
                kind = kind_of(name)
                made = split_text(text or "", kind)
                last = {title: k for k, (title, *_) in enumerate(made)}
                for k, (title, body, a, z) in enumerate(made):
                    up = parent_title(title, kind)
                    rows.append((doc, name, kind, k, title, body, a, z, up, made[last[up]][1] if up in last else None))
            yield pd.DataFrame(rows, columns=["doc_id", "file_name", "kind", "index", "title", "content", "start_pos", "end_pos", "parent_title", "_up"])

    made = docs.selectExpr("cast(doc_id as string) as doc_id", "file_name", "content").mapInPandas(run, "doc_id string, file_name string, kind string, index int, title string, content string, start_pos int, end_pos int, parent_title string, _up string")
    own = digest(F.col("doc_id"), F.col("title"), F.col("content"))
    up = F.when(F.col("_up").isNotNull(), digest(F.col("doc_id"), F.col("parent_title"), F.col("_up")))
    return made.select("doc_id", "file_name", "kind", "index", "title", "content", "start_pos", "end_pos", own.alias("chunk_id"), up.alias("parent_id"), "parent_title")


def graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, doc_id, labels, name, node_type, path, chunk_id) and CONTAINS edges (edge_id, src, dst, type) of the chunks that ``split`` gives.

    The kind is the Document root; a record (a path with an index) or an object with chunks of its own below is a Collection, others are Data.
    """
    named = chunks.where(F.expr(f"title <> kind and not startswith(title, concat(kind, '.{REST}'))")).withColumn("path", F.expr("substring(title, length(kind) + 2)"))
    above = chunks.select("doc_id", F.expr("transform(filter(sequence(1, length(title)), i -> substring(title, i, 1) = '.'), i -> substring(title, 1, i - 1))").alias("up")).select("doc_id", F.explode("up").alias("title")).distinct().withColumn("holds", F.lit(True))
    typed = named.join(above, ["doc_id", "title"], "left").withColumn("node_type", F.when(F.instr("path", "[") > 0, "record").when(F.col("holds"), "object").otherwise("field"))
    label = F.when(F.col("node_type") == "field", "Data").otherwise("Collection")
    name_id = lambda title, kind: digest(F.col("doc_id"), title, kind)
    typed = typed.withColumn("label", label)
    data = typed.select(name_id(F.col("title"), F.col("label")).alias("node_id"), "doc_id", F.array("label").alias("labels"), F.col("title").alias("name"), "node_type", "path", "chunk_id").dropDuplicates(["node_id"])
    root = chunks.select("doc_id", "kind").distinct().select(name_id(F.col("kind"), F.lit("Document")).alias("node_id"), "doc_id", F.array(F.lit("Document")).alias("labels"), F.col("kind").alias("name"), F.lit("data_kind").alias("node_type"), F.lit("").alias("path"), F.lit("").alias("chunk_id"))
    nodes = root.unionByName(data)
    down = typed.select("doc_id", F.col("parent_title").alias("up"), name_id(F.col("title"), F.col("label")).alias("dst")).where("up is not null")
    links = down.join(nodes.select("doc_id", F.col("name").alias("up"), F.col("node_id").alias("src")), ["doc_id", "up"])
    return nodes, links.select(digest(F.col("doc_id"), F.col("src"), F.lit("CONTAINS"), F.col("dst")).alias("edge_id"), "src", "dst", F.lit("CONTAINS").alias("type")).distinct()
