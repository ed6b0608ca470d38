"""File sources: a recursive scan with ignore rules, parsers as Arrow batches, and normalised raw documents.

Formats whose libraries are missing (PDF, XLS, MSG, DOC, PPT, images) give a row with ``error`` set, never an exception.
"""

from __future__ import annotations

import csv
import email
import email.policy
import html.parser
import io
import json
import re
import tomllib
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import doc_id

DATA = ("json", "jsonc", "yaml", "yml", "toml", "xml", "csv", "log", "xlsx")
DOCUMENT = ("md", "markdown", "html", "htm", "docx", "pptx", "epub", "eml", "pdf", "doc", "ppt", "xls", "msg")
IMAGE = ("png", "jpg", "jpeg", "gif", "webp", "bmp")
RAW = "file_name string, doc_type string, content string, size long, mod_time timestamp, meta map<string,string>, error string"


def to_json(value) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)
    for sign in "<>&":
        text = text.replace(sign, f"\\u{ord(sign):04x}")
    return text


def strip_json_comments(text: str) -> str:
    """Line and block comments go, but not inside strings."""
    return re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.DOTALL)


def parse_csv(text: str) -> tuple[str, dict]:
    rows = [r for r in csv.reader(io.StringIO(text), skipinitialspace=True) if r]
    if not rows:
        raise ValueError("empty csv")
    wide = max(map(len, rows))
    names = rows[0] + [f"col_{k + 1}" for k in range(len(rows[0]), wide)]
    return to_json([dict(zip(names, r + [""] * (wide - len(r)))) for r in rows[1:]]), {"rows": len(rows), "columns": len(rows[0])}


def parse_log(text: str) -> tuple[str, dict]:
    every = text.split("\n")
    kept = [{"line": k, "text": x.rstrip("\r")} for k, x in enumerate(every, 1) if x.strip()]
    return to_json(kept), {"lines": len(every), "nonblank_lines": len(kept)}


def _element(e: ET.Element):
    out: dict = {f"@{k}": v for k, v in e.attrib.items()}
    for child in e:
        value, name = _element(child), child.tag.rpartition("}")[2]
        if name in out:
            out[name] = [*(out[name] if isinstance(out[name], list) else [out[name]]), value]
        else:
            out[name] = value
    text = (e.text or "").strip()
    if not out:
        return text
    return out | ({"#text": text} if text else {})


class _Markdown(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.out: list[str] = []
        self.mute = 0
        self.link = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head", "title"):
            self.mute += tag != "head"
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "table", "ul", "ol"):
            self.out.append("\n\n")
        elif tag in ("br", "tr"):
            self.out.append("\n")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("b", "strong", "i", "em"):
            self.out.append("**" if tag in ("b", "strong") else "*")
        elif tag == "a":
            self.link = dict(attrs).get("href") or ""
            self.out.append("[")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.mute = max(0, self.mute - 1)
        elif tag in ("b", "strong", "i", "em"):
            self.out.append("**" if tag in ("b", "strong") else "*")
        elif tag == "a":
            self.out.append(f"]({self.link})")
        elif tag in ("p", "div") or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.mute:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(text: str) -> str:
    p = _Markdown()
    p.feed(text or "")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(p.out))).strip()


def parse_html(text: str) -> tuple[str, dict]:
    title = re.search(r"<title[^>]*>(.*?)</title>", text, re.IGNORECASE | re.DOTALL)
    return html_to_markdown(text), {"title": html.unescape(title[1]).strip()} if title else {}


def parse_eml(data: bytes) -> tuple[str, dict]:
    m = email.message_from_bytes(data, policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body else ""
    if body and body.get_content_type() == "text/html":
        text = re.sub(r"<[^>]*>", "", text)
    date = m["date"].datetime.isoformat() if m["date"] and m["date"].datetime else ""
    head = {"from": str(m["from"] or ""), "to": str(m["to"] or ""), "subject": str(m["subject"] or ""), "date": date}
    return to_json({**head, "body": text.strip()}), {"subject": head["subject"]}


def _texts(e: ET.Element, tag: str) -> str:
    return "".join(x.text or "" for x in e.iter() if x.tag.rpartition("}")[2] == tag)


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ET.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), "")


def _run_text(r: ET.Element) -> str:
    text = "".join((x.text or "") if _tag(x) == "t" else "\t" if _tag(x) == "tab" else "\n" if _tag(x) in ("br", "cr") else "" for x in r)
    if not text.strip():
        return text
    on = {_tag(x) for p in r if _tag(p) == "rPr" for x in p if _attr(x, "val") not in ("0", "false", "none")}
    text = re.sub(r"([*~\\])", r"\\\1", text)
    for mark, sign in (("strike", "~~"), ("b", "**"), ("i", "*")):
        text = f"{sign}{text}{sign}" if mark in on else text
    return text


def _paragraph(p: ET.Element, links: dict[str, str], kinds: dict[str, str], counts: dict[tuple, int]) -> str:
    out = []
    for x in p:
        if _tag(x) == "r":
            out.append(_run_text(x))
        elif _tag(x) == "hyperlink":
            inner = "".join(_run_text(r) for r in x if _tag(r) == "r")
            target = links.get(_attr(x, "id"), "")
            out.append(f"[{inner}]({target})" if target else inner)
    text = "".join(out)
    if not text.strip():
        return ""
    own = next((x for x in p if _tag(x) == "pPr"), None)
    own = own if own is not None else ET.Element("none")
    style = next((_attr(x, "val") for x in own if _tag(x) == "pStyle"), "")
    if level := re.fullmatch(r"(?:[Hh]eading\s*)?([1-6])", style):
        return "#" * int(level[1]) + " " + text
    if style == "Code":
        return f"`{text}`"
    number = next((x for x in own if _tag(x) == "numPr"), None)
    if number is not None:
        num, depth = (next((_attr(x, "val") for x in number if _tag(x) == k), "0") for k in ("numId", "ilvl"))
        left = next((_attr(x, "left") for x in own if _tag(x) == "ind"), "")
        indent = "  " * (int(left) // 360 if left.isdigit() else int(depth or 0))
        if kinds.get(num) == "decimal":
            counts[num, indent] = counts.get((num, indent), 0) + 1
            return f"{indent}{counts[num, indent]}. {text}"
        return f"{indent}- {text}"
    return text


def _table(t: ET.Element) -> str:
    """A Markdown table; its head is empty, cells are as wide as the widest of their column."""
    rows = [[" ".join(filter(None, ("".join(_run_text(r) for r in p.iter() if _tag(r) == "r").strip() for p in c.iter() if _tag(p) == "p"))).replace("|", "\\|").replace("\n", " ") for c in r if _tag(c) == "tc"] for r in t if _tag(r) == "tr"]
    n = max(map(len, rows), default=0)
    rows = [r + [""] * (n - len(r)) for r in rows]
    wide = [max(3, *(len(r[k].encode()) for r in rows)) for k in range(n)]
    line = lambda r: "| " + " | ".join(x + " " * (w - len(x.encode())) for x, w in zip(r, wide)) + " |"
    return "\n".join([line([""] * n), "|" + "|".join("-" * (w + 2) for w in wide) + "|", *map(line, rows)]) if n else ""


def _relations(z: zipfile.ZipFile, name: str) -> dict[str, str]:
    return {x.attrib["Id"]: x.attrib.get("Target", "") for x in ET.fromstring(z.read(name))} if name in z.namelist() else {}


def parse_docx(data: bytes) -> tuple[str, dict]:
    z = zipfile.ZipFile(io.BytesIO(data))
    links, kinds, counts = _relations(z, "word/_rels/document.xml.rels"), {}, {}
    if "word/numbering.xml" in z.namelist():
        root = ET.fromstring(z.read("word/numbering.xml"))
        formats = {_attr(a, "abstractNumId"): next((_attr(x, "val") for x in a.iter() if _tag(x) == "numFmt"), "bullet") for a in root if _tag(a) == "abstractNum"}
        kinds = {_attr(a, "numId"): formats.get(next((_attr(x, "val") for x in a if _tag(x) == "abstractNumId"), ""), "bullet") for a in root if _tag(a) == "num"}
    body = next(x for x in ET.fromstring(z.read("word/document.xml")) if _tag(x) == "body")
    out = []
    for x in body:
        if _tag(x) == "p":
            out.append(_paragraph(x, links, kinds, counts))
            for box in (t for t in x.iter() if _tag(t) == "txbxContent"):
                inner = "\n".join(filter(None, ("".join(r.text or "" for r in p.iter() if _tag(r) == "t") for p in box if _tag(p) == "p")))
                out.append(f"```\n{inner}\n```" if inner else "")
        elif _tag(x) == "tbl":
            out.append(_table(x))
    return "\n\n".join(filter(None, out)), {}


def parse_pptx(data: bytes) -> tuple[str, dict]:
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    out = []
    for k, (_, name) in enumerate(slides, 1):
        out.append(f"## Slide {k}")
        for shape in (x for x in ET.fromstring(z.read(name)).iter() if _tag(x) == "sp"):
            title = any(_tag(x) == "ph" and _attr(x, "type") in ("title", "ctrTitle") for x in shape.iter())
            for p in (x for x in shape.iter() if _tag(x) == "p"):
                if not (t := _texts(p, "t").strip()):
                    continue
                own = next((x for x in p if _tag(x) == "pPr"), None)
                listed = own is not None and (any(_tag(x) in ("buChar", "buAutoNum") for x in own) or own.attrib.get("lvl", "0") != "0")
                depth = int(own.attrib.get("lvl", "0")) if listed else 0
                out.append("### " + t if title else "  " * depth + "- " + t if listed else t)
    return "\n\n".join(out), {"slides": len(slides)}


def _column(ref: str, following: int) -> int:
    """The place of a cell, by its letters; without a reference the one that follows."""
    letters = re.match("[A-Z]*", ref)[0]
    return sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters))) - 1 if letters else following


def parse_xlsx(data: bytes) -> tuple[str, dict]:
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = [_texts(x, "t") for x in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    names = [x.attrib["name"] for x in ET.fromstring(z.read("xl/workbook.xml")).iter() if x.tag.endswith("}sheet")]
    out = []
    for k, name in enumerate(names, 1):
        rows = []
        for row in (x for x in ET.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter() if x.tag.endswith("}row")):
            cells: list[str] = []
            for c in row:
                v = _texts(c, "v") or _texts(c, "t")
                at = _column(c.attrib.get("r", ""), len(cells))
                cells += [""] * (at + 1 - len(cells))
                cells[at] = shared[int(v)] if c.attrib.get("t") == "s" and v else v
            if any(cells):
                rows.append(cells)
        out.append({"sheet": name, "rows": [dict(zip(rows[0], r + [""] * (len(rows[0]) - len(r)))) for r in rows[1:]] if rows else []})
    return to_json(out), {"sheets": len(names)}


def parse_epub(data: bytes) -> tuple[str, dict]:
    z = zipfile.ZipFile(io.BytesIO(data))
    opf = next(x.attrib["full-path"] for x in ET.fromstring(z.read("META-INF/container.xml")).iter() if x.tag.endswith("rootfile"))
    root, folder = ET.fromstring(z.read(opf)), opf.rpartition("/")[0]
    items = {x.attrib["id"]: x.attrib["href"] for x in root.iter() if x.tag.endswith("}item") and re.search("xml|html", x.attrib.get("media-type", ""))}
    spine = [x.attrib["idref"] for x in root.iter() if x.tag.endswith("}itemref")]
    parts = [html_to_markdown(z.read(f"{folder}/{items[i]}".lstrip("/")).decode("utf-8", "replace")) for i in spine if i in items]
    return "\n\n".join(parts), {k: _texts(root, k) for k in ("title", "creator", "language")}


def _yaml(text: str):
    import yaml

    return yaml.safe_load(text)


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


PARSERS: dict[str, Callable[[bytes], tuple[str, dict]]] = {
    "csv": lambda d: parse_csv(_text(d)),
    "log": lambda d: parse_log(_text(d)),
    **dict.fromkeys(("json", "jsonc"), lambda d: ((lambda v: (to_json(v), {"json_type": type(v).__name__}))(json.loads(strip_json_comments(_text(d)))))),
    **dict.fromkeys(("yaml", "yml"), lambda d: (to_json(_yaml(_text(d))), {})),
    "toml": lambda d: (to_json(tomllib.loads(_text(d))), {}),
    "xml": lambda d: (to_json(_element(ET.fromstring(d))), {}),
    **dict.fromkeys(("html", "htm"), lambda d: parse_html(_text(d))),
    "eml": parse_eml,
    "docx": parse_docx,
    "pptx": parse_pptx,
    "xlsx": parse_xlsx,
    "epub": parse_epub,
}
MISSING = {"pdf", "xls", "msg", "doc", "ppt", *IMAGE}


def kind_of(ext: str) -> str:
    return "data" if ext in DATA else "document" if ext in DOCUMENT else "image" if ext in IMAGE else "text"


def parse(name: str, data: bytes) -> tuple[str, dict, str | None]:
    ext = name.rpartition(".")[2].lower()
    if not data:
        return "", {}, "empty file"
    if ext in MISSING:
        return "", {}, f"no reader for {ext}"
    try:
        content, meta = PARSERS[ext](data) if ext in PARSERS else (_text(data), {})
    except Exception as e:  # a broken file is a row, not the end of the scan
        return "", {}, f"{type(e).__name__}: {e}"
    return content, {k: str(v) for k, v in meta.items() if v != ""}, None


TEXT = "txt md markdown html htm css js jsx mjs ts tsx py go java kt c cpp cc h hpp cs rs php rb sh sql swift scala vue svelte graphql gql ini conf cfg env tsv".split()
INDEXABLE = frozenset([*TEXT, *DATA, *DOCUMENT, *IMAGE])
IGNORE_FILE = ".indexignore"
DEEPEST = 64


def load_rules(text: str) -> list[str]:
    """One rule a line; blank lines and those that begin with # do nothing."""
    return [r for x in text.splitlines() if (r := x.strip()) and not r.startswith("#")]


def ignored(path: str, rules: Sequence[str]) -> bool:
    """Suffix (``*.x``, ``**.x``), folder (``x/``), segment and shell patterns; blank rules and comments do nothing."""
    return any(re.search(p, path.strip("/")) for p in map(rule_pattern, load_rules("\n".join(rules))))


def rule_pattern(rule: str) -> str:
    """A rule as a regular expression over the path below the folder, for Python and for Spark alike."""
    if rule.startswith(("**.", "*.")):
        return re.escape(rule.lstrip("*")).replace("\\-", "-") + "$"
    plain = rule.strip("/")
    if any(c in plain for c in "*?["):
        shell = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c in "[]-^" else re.escape(c) for c in plain)
        return f"(?:^|/){shell}(?:/|$)"
    return f"^{re.escape(plain)}|(?:^|/){re.escape(plain)}(?:/|$)"


def _layers(spark: SparkSession, folder: str, ignore_file: str) -> list[tuple[str, str]]:
    """(folder below, pattern) of every rule file; a rule holds for its own folder and all below."""
    jvm, base = spark._jvm, folder.rstrip("/")
    fs = jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    root = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(base)).toUri().getPath()
    out = []
    for depth in range(DEEPEST + 1):  # one listing a level; such files are hidden from Spark's own sources
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(base + "/*" * depth + "/" + ignore_file)) or ():
            path = status.getPath()
            inside = path.toUri().getPath().removeprefix(root).strip("/").rpartition("/")[0]
            body = fs.open(path)
            out += [(inside, rule_pattern(x)) for x in load_rules(jvm.org.apache.commons.io.IOUtils.toString(body, "UTF-8"))]
            body.close()
        if not len(fs.globStatus(jvm.org.apache.hadoop.fs.Path(base + "/*" * (depth + 1))) or ()):
            break
    else:
        raise ValueError(f"folders more than {DEEPEST} deep")
    return out


def listing(spark: SparkSession, folder: str, rules: Sequence[str] = (), ignore_file: str = IGNORE_FILE, everything: bool = False) -> DataFrame:
    """Files below a folder (path, file_name, inside, size, mod_time, content): of indexable extensions, not ignored, not in a ``*.rag`` folder.

    What is left out is left out by conditions on the path; a plan that does not use ``content`` never opens a file.
    """
    ext = ",".join(sorted({e for x in INDEXABLE for e in (x, x.upper())}))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (read if everything else read.option("pathGlobFilter", "*.{" + ext + "}")).load(folder)
    name = F.regexp_replace("path", "^file:/+", "/")
    inside = F.expr(f"substring(file_name, {len(folder.rstrip('/')) + 2})")
    df = df.select("path", name.alias("file_name"), F.col("length").alias("size"), F.col("modificationTime").alias("mod_time"), "content").withColumn("inside", inside)
    df = df.where(~F.col("inside").rlike("(?:^|/)[^/]*\\.rag/"))
    for p in map(rule_pattern, load_rules("\n".join(rules))):
        df = df.where(~F.col("inside").rlike(p))
    for below, p in _layers(spark, folder, ignore_file):
        part = F.col("inside") if not below else F.when(F.col("inside").startswith(below + "/"), F.substring("inside", len(below) + 2, 1 << 20))
        df = df.where(~F.coalesce(part.rlike(p), F.lit(False)))
    return df


def scan(spark: SparkSession, folder: str, rules: Sequence[str] = (), ignore_file: str = IGNORE_FILE) -> DataFrame:
    """Raw documents of every indexable file below a folder. Files are read and parsed where they lie."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for name, when, size, data in zip(p["file_name"], p["mod_time"], p["size"], p["content"]):
                content, meta, error = parse(name, bytes(data))
                rows.append((name, kind_of(name.rpartition(".")[2].lower()), content, size, when, meta, error))
            yield pd.DataFrame(rows, columns=["file_name", "doc_type", "content", "size", "mod_time", "meta", "error"])

    docs = listing(spark, folder, rules, ignore_file).select("file_name", "mod_time", "size", "content").mapInPandas(run, RAW)
    return docs.withColumn("doc_id", doc_id(F.col("file_name"), F.col("content")))


def from_texts(rows: DataFrame, content: str = "content", doc_type: str = "text") -> DataFrame:
    """Raw documents of a table of texts: without a file name, the id is that of the content."""
    none = F.lit(None)
    return rows.select(F.lit("").alias("file_name"), F.lit(doc_type).alias("doc_type"), F.col(content).alias("content"), F.octet_length(content).cast("long").alias("size"), none.cast("timestamp").alias("mod_time"), F.create_map().cast("map<string,string>").alias("meta"), none.cast("string").alias("error"), doc_id(F.lit(""), F.col(content)).alias("doc_id"))


def open_file(spark: SparkSession, path: str) -> DataFrame:
    """One raw document; ``ValueError`` for an empty or relative path, ``FileNotFoundError`` for none, ``IsADirectoryError`` for a folder."""
    import os

    if not path or not (path.startswith("/") or "://" in path):
        raise ValueError(f"not an absolute path: {path!r}")
    if "://" not in path:
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        if os.path.isdir(path):
            raise IsADirectoryError(path)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for name, when, size, data in zip(p["path"], p["modificationTime"], p["length"], p["content"]):
                name = re.sub(r"^file:/+", "/", name)
                content, meta, error = parse(name, bytes(data))
                rows.append((name, kind_of(name.rpartition(".")[2].lower()), content, size, when, meta, error))
            yield pd.DataFrame(rows, columns=["file_name", "doc_type", "content", "size", "mod_time", "meta", "error"])

    return spark.read.format("binaryFile").load(path).mapInPandas(run, RAW).withColumn("doc_id", doc_id(F.col("file_name"), F.col("content")))


def load_schemas(spark: SparkSession, folder: str) -> tuple[dict[str, dict], dict[str, str]]:
    """The JSON schemas of a folder, not below it, by the file's base name; and the errors of those that do not parse."""
    good: dict[str, dict] = {}
    bad: dict[str, str] = {}
    for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", "content").collect():  # schemas are few
        name = r.path.rpartition("/")[2].rpartition(".")[0]
        try:
            value = json.loads(bytes(r.content))
            if not isinstance(value, dict):
                raise ValueError("no object")
            good[name] = value
        except ValueError as e:
            bad[name] = str(e)
    return good, bad
