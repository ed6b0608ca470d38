"""Splitters: Markdown sections, greedy lines, the router; strategy and MIME labels as columns.

A document is split where it lies, by a Python function: no text is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import digest, region_id
from . import code, datum

LINE_BYTES = 1500
#: What a README.md that was made for its folder holds; the engine that writes them can set another.
REGION_MARK = "<!-- region-descriptor -->"
SHORT, SUMMARY = 20, 200
DATA = tuple(datum.KINDS)
IMAGE = ("png", "jpg", "jpeg", "gif", "webp", "bmp")

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*))?$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_UNDER = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_NO_PARAGRAPH = re.compile(r" {0,3}(?:>|[-+*][ \t]|\d{1,9}[.)][ \t]|\||<)|(?: {4}|\t)|[ \t]*$")


def headings(lines: list[str]) -> list[tuple[int, int, str]]:
    """(line, level, title) of every heading: ATX, and setext at the paragraph's first line. Fenced text has none.

    A fence is closed by its own sign, at least as often, with nothing after it.
    """
    out: list[tuple[int, int, str]] = []
    fence, paragraph = "", -1
    for k, line in enumerate(lines):
        m = _FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
            paragraph = -1
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            fence, paragraph = m[1], -1
        elif m := _ATX.match(line):
            out.append((k, len(m[1]), re.sub(r"(?:^|[ \t]+)#*[ \t]*$", "", m[2] or "")))
            paragraph = -1
        elif paragraph >= 0 and (m := _UNDER.match(line)):
            out.append((paragraph, 1 if m[1][0] == "=" else 2, " ".join(x.strip() for x in lines[paragraph:k])))
            paragraph = -1
        elif _NO_PARAGRAPH.match(line) and (paragraph < 0 or not line.strip()):
            paragraph = -1
        elif paragraph < 0:
            paragraph = k
    return out


def sections_of(text: str) -> list[tuple[int, int, str, str, int, int, int, int, int | None]]:
    """(index, level, title, content, first byte, end, first line, last line, parent) of every section; what precedes the first heading is 0."""
    raw = text.split("\n")
    lines = [x[:-1] if x.endswith("\r") else x for x in raw]
    starts = [0]
    for x in raw:
        starts.append(starts[-1] + len(x.encode()) + 1)
    heads = headings(lines)
    out, open_ = [], []
    edges = [(0, 0, ""), *heads] if not heads or heads[0][0] > 0 else heads
    shift = 0 if edges and edges[0][1] == 0 else 1
    for k, (at, level, title) in enumerate(edges):
        end = edges[k + 1][0] if k + 1 < len(edges) else len(lines)
        body = "\n".join(lines[at:end]).rstrip("\n")
        if level == 0 and not body.strip():
            continue
        while open_ and open_[-1][0] >= level:
            open_.pop()
        index = k + shift
        out.append((index, level, title, body, starts[at], starts[at] + len(body.encode()), at + 1, at + 1 + body.count("\n"), open_[-1][1] if open_ and level else None))
        if level:
            open_.append((level, index))
    return out


def parsed(docs: DataFrame, key: str, text: str, f: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """(key, columns): the rows that a Python function makes of each text; a null one is empty.

    A plain function gets 100 texts at once, an Arrow one 10,000: with these, their rows and the copies of both a worker would hold GBs.
    """
    make = F.udf(f, f"array<struct<{', '.join(c.replace(' ', ': ') for c in columns.split(', '))}>>", useArrow=False).asNondeterministic()  # so that it runs once
    return docs.select(key, make(F.coalesce(text, F.lit(""))).alias("_rows")).select(key, F.inline("_rows"))


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, index, level, title, content, start_pos, end_pos, start_line, end_line, parent): bytes and lines as well. Null and blank texts have none."""
    return parsed(docs, key, text, sections_of, "index long, level int, title string, content string, start_pos long, end_pos long, start_line int, end_line int, parent long")


def markdown(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, index, level, title, content, parent): a section runs from its heading to the next; what precedes is level 0.

    The parent is the nearest section before with a smaller level.
    """
    return sections(docs, key, text).select(key, "index", "level", "title", "content", "parent")


def section_graph(parts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and CONTAINS edges of the sections that ``markdown`` gives: a Document for each key, a Section for each heading."""
    own = lambda i: digest(F.col(key), i, F.lit("Section"))
    root = digest(F.col(key), F.lit("Document"))
    nodes = parts.select(root.alias("node_id"), F.array(F.lit("Document")).alias("labels"), F.lit("").alias("name")).distinct()
    named = parts.where("level > 0")
    nodes = nodes.unionByName(named.select(own(F.col("index")).alias("node_id"), F.array(F.lit("Section")).alias("labels"), F.col("title").alias("name")))
    return nodes, named.select(F.when(F.col("parent").isNull(), root).otherwise(own(F.col("parent"))).alias("src"), own(F.col("index")).alias("dst"), F.lit("CONTAINS").alias("type"))


def _fill(text: str, limit: int) -> list[str]:
    out: list[list[str]] = []
    size = 0
    for line in text.split("\n"):
        n = len(line.encode())
        if out and size + 1 + n <= limit:
            out[-1].append(line)
            size += 1 + n
        else:
            out.append([line])
            size = n
    return ["\n".join(x) for x in out]


def lines(docs: DataFrame, key: str, text: str, limit: int = LINE_BYTES) -> DataFrame:
    """(key, index, content): whole lines, as many as fit into ``limit`` bytes; a longer line stands alone. Linear in the text."""
    return parsed(docs, key, text, lambda t: list(enumerate(_fill(t, limit))), "index int, content string")


def log_entries(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, text): the lines that are not blank, counted from 1."""
    rows = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "t")).where("trim(t) <> ''")
    return rows.select(key, (F.col("pos") + 1).alias("line"), F.expr("rtrim('\\r', t)").alias("text"))


# ---- the router and what all chunks get

def route(file_name: Column, doc_type: Column | None = None) -> Column:
    """image, code, datum or markdown: by the type where it says image or data, else by extension; what is unknown is Markdown."""
    ext = T.extension(file_name)
    by_name = F.when(ext.isin(list(IMAGE)), "image").when(ext.isin(list(code.LANGUAGES)), "code").when(ext.isin(list(DATA)), "datum").otherwise("markdown")
    if doc_type is None:
        return by_name
    return F.when(doc_type == "image", "image").when(doc_type == "data", "datum").otherwise(by_name)


def content_type(route_: Column) -> Column:
    return F.when(route_ == "image", "Image").when(route_ == "code", "Code").when(route_ == "datum", "DataFile").otherwise("Document")


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, index, title, summary, content, content_type, language, dir, region_id, start_pos, end_pos, parent_id, is_region_descriptor).

    docs: (doc_id, file_name, content); each goes the way that ``route`` says. Texts of under ``SHORT`` signs have no chunk. A README.md
    describes its folder: its top sections are titled by the folder, one with the mark of a made descriptor is one chunk.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "file_name", "content").where(F.char_length("content") >= SHORT).withColumn("route", route(F.col("file_name")))
    readme = F.lower(T.file_name(F.col("file_name"))) == "readme.md"
    made = readme & F.col("content").contains(REGION_MARK)
    base = T.stem(F.col("file_name"))
    folder = T.folder(F.col("file_name"))
    folder_name = F.regexp_extract(folder, "([^/]*)$", 1)
    head = [folder.alias("dir"), region_id(folder).alias("region_id"), content_type(F.col("route")).alias("content_type")]
    facts = rows.select("doc_id", "file_name", "route", base.alias("base"), folder_name.alias("folder"), (readme & ~made).alias("readme"), *head)

    def finish(df: DataFrame, language: Column, title: Column, parent: Column, summary: Column) -> DataFrame:
        return df.join(facts, "doc_id").select(
            digest(F.col("doc_id"), title, F.col("content")).alias("chunk_id"), "doc_id", F.col("index").cast("int").alias("index"), title.alias("title"), summary.alias("summary"), "content", "content_type", language.alias("language"), "dir", "region_id", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"), parent.alias("parent_id"), F.col("readme").alias("is_region_descriptor")
        )

    none = F.lit(None).cast("string")
    whole = rows.where(made | (F.col("route") == "image")).select("doc_id", "content", F.lit(0).alias("index"), F.lit(0).alias("start_pos"), F.octet_length("content").alias("end_pos"))
    whole = finish(whole, F.lit(""), F.when(F.lower(T.file_name(F.col("file_name"))) == "readme.md", F.col("folder")).otherwise(F.col("base")), none, F.lit("")).withColumn("is_region_descriptor", F.col("content").contains(REGION_MARK))
    parts = sections(rows.where(~made & (F.col("route") == "markdown")), "doc_id", "content")
    up = parts.select("doc_id", F.col("index").alias("parent"), F.col("title").alias("_ut"), F.col("content").alias("_uc"), F.lit(True).alias("_up"))
    parts = parts.join(up, ["doc_id", "parent"], "left")
    own = F.when(F.col("readme") & F.col("parent").isNull(), F.col("folder")).when(F.col("title") == "", F.col("base")).otherwise(F.col("title"))
    up_title = F.when(F.col("_ut") == "", F.col("base")).otherwise(F.col("_ut"))
    md = finish(parts, F.lit("markdown"), own, F.when(F.col("_up"), digest(F.col("doc_id"), up_title, F.col("_uc"))), F.lit(""))
    data = datum.split(rows.where("route = 'datum'")).drop("chunk_id", "file_name")
    dt = finish(data, F.lower("kind"), F.col("title"), F.col("parent_id"), F.lit(""))
    s = code.symbols(rows.where("route = 'code'")).withColumn("index", F.col("sid") + 1).withColumnRenamed("start", "start_pos").withColumn("end_pos", F.col("start_pos") + F.octet_length("content"))
    above = s.select("doc_id", F.col("sid").alias("parent"), digest(F.col("doc_id"), F.col("signature"), F.col("content")).alias("_pid"))
    cd = finish(s.drop("file_name").join(above.where("parent >= 0"), ["doc_id", "parent"], "left"), F.col("language"), F.col("signature"), F.col("_pid"), F.col("summary"))
    return whole.unionByName(md).unionByName(dt).unionByName(cd)


def remove_fences(c: Column) -> Column:
    """Without fenced blocks."""
    return F.regexp_replace(c, "(?s)```.*?```", "")


def first_line(c: Column) -> Column:
    """The title of a text: its first line that is not blank."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit(""))


def whole_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, title, content, strategy): one chunk for each text that is not blank, titled by its first line."""
    return docs.where(F.trim(F.coalesce(text, F.lit(""))) != "").select(key, first_line(F.col(text)).alias("title"), F.col(text).alias("content"), strategy(F.col(text)).alias("strategy"))


# ---- labels

_CODE_WORDS = ("func |function |def |class |interface |package |import |export |require\\(|public |private |protected |static |const |let |var |SELECT |FROM |WHERE |INSERT |UPDATE |DELETE |CREATE |ALTER |DROP |fn |impl ")


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.trim(x))


def _count(x: Column, sign: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit("")))


def strategy(text: Column, mime_: Column | None = None) -> Column:
    """sentence, paragraph, code, parent_doc or recursive. Words of code count as they are written."""
    marks = F.size(F.filter(_lines(text), lambda x: x.rlike("^(?:#|[-*>] |1\\. |```)")))
    rows = F.aggregate(F.split(text, "\n"), F.lit(0), lambda n, x: n + (_count(x, "|") >= 3).cast("int") + ((_count(x, ",") >= 3) & ~x.contains(" ")).cast("int"))
    size = F.octet_length(text)
    label = F.when(text.rlike(_CODE_WORDS), "code").when(size < 200, "sentence").when(size > 2000, "parent_doc").when(marks >= 3, "paragraph").when(rows >= 2, "recursive").otherwise("recursive")
    if mime_ is None:
        return label
    return F.when(mime_.isin("application/json", "text/yaml", "text/xml", "application/xml", "text/toml"), "recursive").when(mime_.isin("text/html", "text/markdown"), "paragraph").otherwise(label)


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\f\x0b"))


def mime(text: Column) -> Column:
    """The MIME type that a text looks like, by rules in a fixed order; the last is text/plain."""
    return mime_of_stripped(stripped(text))


def mime_of_stripped(t: Column) -> Column:
    """``mime`` of a text without blanks around it. Rows are looked at without spaces around them, by patterns over the whole text: no rows are made."""
    row = "(?md)^ *+"  # flag d: only \n ends a row
    mark = "#|\\*|---|===|```|(?:- |[12]\\. |> ) *+[^\\n]"
    ascii_, two = "[\\x00-\\x09\\x0b-\\x7f]", "[\\x{80}-\\x{7ff}]"
    short = f"(?:{ascii_}{{1,3}}|{two}{ascii_}?|{ascii_}{two}|[\\x{{800}}-\\x{{ffff}}]) *+$"  # of at most three bytes
    decides = F.regexp_extract(t, f"{row}(?:({mark})|(?=[^ \\n])(?!{short}))", 1)  # of the first row that is marked or not short
    starts = lambda x, *words: x.rlike("^(?:" + "|".join(words) + ")")
    toml = ~t.rlike(f"{row}(?=[^ \\n])(?!#|\\[[^\\n]*\\] *+$|[^\\n=]*+=)")
    signs = t.contains("{") | t.contains("}") | (t.contains(":") & t.contains(";"))
    css = signs & t.rlike(f"{row}(?!/\\*)(?:[^\\n{{}}]*+[{{}}]|(?=[^\\n:]*+:)[^\\n;]*+;)")
    graphql = t.rlike(f"{row}(?:type|query|mutation|subscription|fragment|schema|extend|enum|interface|union|input|scalar|directive) ++[^\\n]")
    sql = F.upper(F.substring(t, 1, 16)).rlike("^(?:SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|TABLE|INDEX|VIEW|FROM|WHERE|JOIN|LEFT|RIGHT|INNER|OUTER|GROUP BY|ORDER BY|HAVING|LIMIT|OFFSET)")
    line = F.coalesce(F.rtrim(F.regexp_extract(t, f"{row}(?!//|#)([^ \\n][^\\n]*+)", 1)), F.lit(""))
    typed = line.contains(": ") & (line.contains("interface") | line.contains("type "))
    program = (
        F.when(starts(line, "package ", "import ") & t.contains("func "), "text/x-go").when(starts(line, "def ", "class ", "import ", "from "), "text/x-python").when(starts(line, "public class", "private ", "protected "), "text/x-java")
        .when(starts(line, "int main\\(", "void main\\("), "text/x-c").when(starts(line, "fn main\\(", "use ", "let mut ", "impl "), "text/x-rust")
        .when(starts(line, "const ", "let ", "var ", "function ") | line.contains("=>"), F.when(typed, "text/typescript").otherwise("text/javascript"))
        .when(starts(line, "module "), "text/x-ruby").when(starts(line, "\\$"), "text/x-php").when(starts(line, "func "), "text/x-swift").when(starts(line, "fun ", "val ", "data class"), "text/x-kotlin")
    )
    closed = (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))
    return (
        F.when(t == "", "text/plain").when(closed, "application/json").when(starts(t, "<\\?", "<!", "<html", "<head", "<body", "<div", "<p>", "<span"), "text/html").when(t.startswith("---"), "text/yaml")
        .when((t.startswith("[") | (t.contains("=") & ~t.contains(":"))) & toml, "text/toml").when(F.coalesce(decides != "", F.lit(False)), "text/markdown").when(t.startswith("{") | css, "text/css").when(graphql, "application/graphql").when(sql, "text/sql")
        .otherwise(F.coalesce(program, F.lit("text/plain")))
    )


_X = "text/x-"
MIME = {
    **dict.fromkeys(("txt", "ini", "conf", "cfg", "env"), "text/plain"), "md": "text/markdown", "html": "text/html", "htm": "text/html", "json": "application/json", "css": "text/css", "js": "text/javascript", "xml": "text/xml", "yaml": "text/yaml", "yml": "text/yaml", "toml": "text/toml", "csv": "text/csv", "tsv": "text/tab-separated-values", "sql": "text/sql",
    **{e: _X + n for e, n in zip("py go java c cpp h hpp cs php rb pl sh ps1 rs swift kt".split(), "python go java c c++ c c++ csharp php ruby perl sh powershell rust swift kotlin".split())}, "ts": "text/typescript", "vue": "text/vue", "svelte": "text/svelte", "graphql": "application/graphql", "gql": "application/graphql",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml", "pdf": "application/pdf", "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint",
    **{e: f"application/vnd.openxmlformats-officedocument.{n}" for e, n in (("docx", "wordprocessingml.document"), ("xlsx", "spreadsheetml.sheet"), ("pptx", "presentationml.presentation"))},
}


def mime_of_name(path: Column) -> Column:
    """By extension; null where the extension is not known."""
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.try_element_at(table, T.extension(path))


def mime_of_bytes(data: Column) -> Column:
    """Of an image, by its first bytes; JPEG where none fits."""
    head = F.hex(F.substring(data, 1, 12))
    webp = head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    return F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E47"), "image/png").when(head.startswith("47494638"), "image/gif").when(webp, "image/webp").when(head.startswith("424D"), "image/bmp").otherwise("image/jpeg")
