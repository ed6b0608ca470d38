"""Source files: symbols become chunks, symbols and calls become a graph.

Python is parsed by its own grammar. Other languages are read by declared tables: comments and strings are blanked, headers found by the
patterns of the language, ends by the matching brace (or the closing ``end``). That is an approximation of a grammar: what a pattern does
not describe is part of the chunk before it. Containment, call and inheritance edges are joins. Positions are in bytes of UTF-8.
"""

from __future__ import annotations

import ast
import heapq
import io
import re
import tokenize
from array import array
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import digest

#: Signs of a Python text that are parsed at once; rows that leave Python at once.
PIECE, ROWS = 500_000, 2_000
LANGUAGES = {
    "go": "go", "py": "python", "pyi": "python", "java": "java", "kt": "kotlin", "kts": "kotlin", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "rs": "rust", "php": "php", "rb": "ruby", "sh": "bash", "bash": "bash", "swift": "swift", "scala": "scala", "groovy": "java", "lua": "lua",
}
_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|data|open|override|suspend|inline|async|export|default|readonly|virtual|partial|unsafe|extern|const|pub(?:\([^)]*\))?)\s+)*"
_TYPES = rf"^[ \t]*{_MOD}(?P<kind>class|interface|enum|record|object|trait|struct|protocol|namespace|module|union)\s+(?P<name>[A-Za-z_$][\w$]*)"
_METHOD = rf"^[ \t]*{_MOD}(?:[\w<>\[\],.?&*:]+[\s*&]+)+(?P<name>~?[A-Za-z_]\w*)\s*\((?P<args>[^;{{}}]*?)\)\s*(?:const|throws\s+[\w,\s.]+|:\s*[^{{;]+)?\s*(?=[{{;])"
_FUN = r"\b(?P<kind>fun|fn|func|def|function)\s+(?:<[^>]*>\s*)?(?:[\w<>]+\.)?(?P<name>[A-Za-z_$][\w$?!]*)"
#: language: (pattern, kind of node where the pattern has no group ``kind``)
PATTERNS = {
    "go": [(r"^func\s+(?:\(\s*\w*\s*\*?(?P<recv>\w+)[^)]*\)\s*)?(?P<name>\w+)", "function"), (r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?P<kind>struct|interface|[\w.*\[\]]+)", "type"), (r"^\t(?P<name>[A-Z]\w*)\s+(?P<kind>struct|interface)\s*\{", "type")],
    "java": [(_TYPES, "class"), (_METHOD, "method")],
    "csharp": [(_TYPES, "class"), (_METHOD, "method")],
    "kotlin": [(_TYPES, "class"), (rf"^[ \t]*{_MOD}{_FUN}", "function")],
    "scala": [(_TYPES, "class"), (rf"^[ \t]*{_MOD}{_FUN}", "function")],
    "swift": [(_TYPES, "class"), (rf"^[ \t]*{_MOD}{_FUN}", "function")],
    "rust": [(_TYPES, "class"), (rf"^[ \t]*{_MOD}{_FUN}", "function"), (r"^[ \t]*(?P<kind>impl)\b(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(?P<name>\w+)", "impl")],
    "javascript": [(_TYPES, "class"), (rf"^[ \t]*{_MOD}function\s*\*?\s*(?P<name>[A-Za-z_$][\w$]*)", "function"), (r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?(?:\([^)]*\)|\w+)\s*=>", "function"), (rf"^[ \t]+{_MOD}(?:get\s+|set\s+|\*\s*)?(?P<name>#?[A-Za-z_$][\w$]*)\s*\([^;{{}}]*?\)\s*(?::\s*[^{{;=]+)?(?=\{{|;)", "method")],
    "typescript": [],
    "c": [(r"^[ \t]*(?:typedef\s+)?(?P<kind>struct|enum|union|class|namespace)\s+(?P<name>\w+)\s*(?=[{:])", "struct"), (r"^[A-Za-z_][\w\s*&:<>,]*?[\s*&]+(?P<name>~?[A-Za-z_][\w:~]*)\s*\([^;{}]*\)\s*(?:const\s*)?(?=\{)", "function")],
    "cpp": [],
    "php": [(_TYPES, "class"), (rf"^[ \t]*{_MOD}function\s+&?(?P<name>\w+)", "function")],
    "bash": [(r"^[ \t]*(?:function\s+)?(?P<name>[A-Za-z_][\w-]*)\s*\(\)\s*(?=\{)", "function")],
    "ruby": [(r"^[ \t]*(?P<kind>class|module)\s+(?P<name>[\w:]+)", "class"), (r"^[ \t]*def\s+(?:self\.)?(?P<name>[\w?!=]+)", "method")],
    "lua": [(r"^[ \t]*(?:local\s+)?function\s+(?P<name>[\w.:]+)", "function")],
}
PATTERNS["typescript"] = [*PATTERNS["javascript"], (r"^[ \t]*(?:export\s+)?type\s+(?P<name>\w+)\s*=", "type")]
PATTERNS["cpp"] = PATTERNS["c"]
NOT_NAMES = set("if for while switch catch return new else do try sizeof typeof delete throw await yield super constructor_ case".split())
CLASSES = {"class", "interface", "enum", "record", "object", "trait", "struct", "protocol", "namespace", "module", "union", "impl", "type"}
_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`", re.DOTALL)
_LINE = re.compile(r"[^\n]*")
_BLANK_HASH = re.compile(r"#[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|--[^\n]*")


def language_of(name: str) -> str:
    return LANGUAGES.get((name or "").rpartition(".")[2].lower(), "")


def label_of(kind: str) -> str:
    kind = normalise(kind)
    for part, label in (("method", "Method"), ("constructor", "Method"), ("func", "Function"), ("fn", "Function"), ("fun", "Function"), ("def", "Function"), ("interface", "Interface"), ("protocol", "Interface"), ("trait", "Interface"), ("class", "Class"), ("struct", "Class"), ("record", "Class"), ("object", "Class"), ("impl", "Class"), ("enum", "Type"), ("union", "Type"), ("type", "Type"), ("var", "Variable"), ("const", "Variable"), ("module", "Module"), ("namespace", "Module"), ("package", "Module")):
        if part in kind:
            return label
    return "Symbol"


def normalise(kind: str) -> str:
    return re.sub(r"_(declaration|definition|statement|item|spec|specifier)$", "", kind)


def visibility_of(name: str, signature: str) -> str:
    if name.startswith("__"):
        return "private"
    if name.startswith("_"):
        return "protected"
    for word, kind in ((r"\b(?:pub|public)\b", "public"), (r"\bprivate\b", "private"), (r"\bprotected\b", "protected")):
        if re.search(word, signature):
            return kind
    return "exported" if name[:1].isupper() else "unexported"


def clean_comment(text: str) -> str:
    """Comment signs go, lines become one."""
    rows = [re.sub(r"^\s*(?:///?!?|#+|/?\*+!?|--|\"\"\"|''')\s?|\s*\*+/\s*$|\"\"\"\s*$", "", x).strip() for x in text.split("\n")]
    return " ".join(x for x in rows if x and x != "/")


def _comment_above(text: str, at: int) -> str:
    """The comment lines that end right above a place, at most a line break between."""
    found: list[str] = []
    inside = False
    end = text.rfind("\n", 0, at)
    while end > 0:
        start = text.rfind("\n", 0, end) + 1
        row = text[start:end]
        x = row.strip()
        if inside or x.endswith("*/"):
            inside = not x.startswith("/*")
        elif not x.startswith(("//", "#", "--")) or x.startswith(("#include", "#define", "#!")):
            break
        found.append(row)
        end = start - 1
    return clean_comment("\n".join(found[::-1]))


def _end_of_braces(masked: str, at: int, stop: str = ";") -> tuple[int, int]:
    """(first sign of the body or -1, end): the matching brace of the first one after a header, or the header's end."""
    k = at
    while k < len(masked) and masked[k] not in "{" + stop:
        k += 1
    if k >= len(masked) or masked[k] != "{":
        return -1, min(k + 1, len(masked))
    depth = 0
    for j in range(k, len(masked)):
        depth += (masked[j] == "{") - (masked[j] == "}")
        if depth == 0:
            return k, j + 1
    return k, len(masked)


def _row_starts(text: str | bytes) -> array:
    """Where each row starts, and one more."""
    sign = b"\n" if isinstance(text, bytes) else "\n"
    starts, k = array("q", [0]), text.find(sign)
    while k >= 0:
        starts.append(k + 1)
        k = text.find(sign, k + 1)
    starts.append(len(text) + 1)
    return starts


def _cuts(text: str, size: int) -> list[tuple[int, list[str]]]:
    """(row, indents of the blocks that are open there) of the statements before which a text is cut, about every ``size`` signs.

    Only statements of the file itself, of classes and of functions are cut apart, never a block's first or what follows a decorator.
    """
    cuts: list[tuple[int, list[str]]] = [(1, [])]
    blocks: list[tuple[str, bool]] = []
    at = _row_starts(text)
    begins, first, decorated, holds, after = True, False, False, False, ""
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.type == tokenize.INDENT:
            blocks.append((t.string, holds and (not blocks or blocks[-1][1])))
            first = True
        elif t.type == tokenize.DEDENT:
            blocks.pop()
        elif t.type == tokenize.NEWLINE:
            begins = True
        elif t.type in (tokenize.NL, tokenize.COMMENT, tokenize.ENDMARKER):
            continue
        elif begins:
            row, word = t.start[0], t.string
            if not first and not decorated and (not blocks or blocks[-1][1]) and word not in ("else", "elif", "except", "finally") and at[row - 1] - at[cuts[-1][0] - 1] >= size:
                cuts.append((row, [b[0] for b in blocks]))
            begins, first, decorated, holds, after = False, False, word == "@", word in ("class", "def"), word
        elif after:
            holds, after = holds or after == "async" and t.string == "def", ""
    return cuts


def _trees(text: str) -> Iterator[tuple[ast.Module, int, int, int]]:
    """(tree, classes around it, what its rows lack, blocks open at its end): a long text in pieces, as a tree takes 150 times its text.

    A piece from within blocks has as many classes around it, which stand for them.
    """
    if len(text) <= PIECE or "\r" in text:
        yield ast.parse(text), 0, 0, 0
        return
    at, cuts = _row_starts(text), _cuts(text, PIECE)
    for k, (row, blocks) in enumerate(cuts):
        after = cuts[k + 1] if k + 1 < len(cuts) else (0, [])
        around = "".join(f"{x}class _:\n" for x in ["", *blocks][: len(blocks)])
        yield ast.parse(around + text[at[row - 1] : at[after[0] - 1] if after[0] else len(text)]), len(blocks), row - 1 - len(blocks), len(after[1])


def _python(text: str) -> list[dict]:
    data = text.encode()
    starts = _row_starts(data)
    rows = starts if text.isascii() else _row_starts(text)
    out: list[dict] = []
    chain: list[int] = []
    for tree, around, lack, open_ in _trees(text):
        place: dict[int, int] = {}
        node = tree
        for k in chain:
            node = node.body[0]
            place[id(node)] = k
            out[k]["end"] = starts[node.end_lineno - 1 + lack] + node.end_col_offset

        def visit(node) -> None:
            for x in ast.iter_child_nodes(node):
                if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and id(x) not in place:
                    a, z = starts[x.lineno - 1 + lack] + x.col_offset, starts[x.end_lineno - 1 + lack] + x.end_col_offset
                    first = x.body[0]
                    body = starts[first.lineno - 1 + lack] + first.col_offset
                    head = data[a:body].decode("utf-8", "replace")
                    above = _comment_above(text, rows[x.lineno - 1 + lack])
                    place[id(x)] = len(out)
                    out.append({"name": x.name, "kind": "class" if isinstance(x, ast.ClassDef) else "function", "start": a, "end": z, "sig": re.sub(r"\s*:\s*(?:#[^\n]*)?\s*$", "", head), "doc": above or " ".join((ast.get_docstring(x) or "").split()), "recv": ""})
                visit(x)

        visit(tree)
        node, chain = tree, []
        for _ in range(open_):
            node = node.body[-1]
            chain.append(place[id(node)])
    return out


def _by_tables(text: str, language: str) -> list[dict]:
    hash_ = language in ("ruby", "bash", "lua")
    masked = (_BLANK_HASH if hash_ else _BLANK).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    found: dict[int, dict] = {}
    for pattern, kind in PATTERNS[language]:
        for m in re.finditer(pattern, masked, re.MULTILINE):
            name = m["name"]
            if name in NOT_NAMES or re.match(r"\s*(?:return|else|throw|new|await)\b", m[0]):
                continue
            groups = m.groupdict()
            own = groups.get("kind") or kind
            own = own if language != "go" or own in ("struct", "interface") or kind == "function" else "type"
            at = m.start("name") if language == "go" and kind == "type" else m.start() + len(m[0]) - len(m[0].lstrip())
            if language in ("ruby", "lua"):
                indent = re.match(r"[ \t]*", masked[masked.rfind("\n", 0, m.start()) + 1 :])[0] if m.start() else ""
                close = re.compile(rf"^{re.escape(re.match(r'[ \t]*', m[0])[0] or indent)}end\b", re.MULTILINE).search(masked, m.end())
                body, end = m.end(), close.end() if close else len(masked)
            else:
                body, end = _end_of_braces(masked, m.end(), ";\n" if language == "go" and own == "type" else ";")
            if kind == "method" and body < 0 and not re.search(r"\)\s*(?::[^;]*|throws[^;]*)?;?$", masked[at:end]):
                continue
            head = text[at : body if body > 0 else end].rstrip("{ \t\n;=")
            sig = head if language not in ("ruby", "lua") else _LINE.match(text, at)[0].rstrip()
            found.setdefault(at, {"name": name.lstrip("~"), "kind": own if kind != "method" else "method", "start": at, "end": end, "sig": sig.strip(), "doc": _comment_above(text, at if language != "go" or kind != "type" else m.start()), "recv": groups.get("recv") or ""})
    out = [found[k] for k in sorted(found)]
    if not text.isascii():
        place = [0]
        for c in text:
            place.append(place[-1] + len(c.encode()))
        for x in out:
            x["start"], x["end"] = place[x["start"]], place[x["end"]]
    return out


def package_of(text: str, language: str) -> str:
    m = re.search(r"^\s*package\s+([\w.]+)", text, re.MULTILINE) if language in ("go", "java", "kotlin", "scala") else None
    return m[1] if m else ""


def symbols_of(text: str, language: str) -> list[dict] | None:
    """The symbols by start, each with its parent's place in the list and its name within parents; None where the text does not parse."""
    try:
        found = _python(text) if language == "python" else _by_tables(text, language)
    except (SyntaxError, tokenize.TokenError, ValueError, RecursionError):
        return None
    found.sort(key=lambda x: (x["start"], -x["end"]))
    open_: list[int] = []
    for k, x in enumerate(found):
        while open_ and found[open_[-1]]["end"] < x["end"]:
            open_.pop()
        x["parent"] = open_[-1] if open_ else -1
        x["qualified"] = f"{x['recv']}.{x['name']}" if x["recv"] else f"{found[x['parent']]['qualified']}.{x['name']}" if open_ else x["name"]
        x["visibility"] = visibility_of(x["name"], x["sig"])
        open_.append(k)
    return found


def relations_of(text: str, language: str, found: list[dict]) -> list[tuple[int, str, str]]:
    """(byte, target, kind) of the calls of Go and Python and the heritage of Java, Kotlin and TypeScript."""
    out: list[tuple[int, str, str]] = []
    if language == "python":
        starts = _row_starts(text.encode())
        calls: list[tuple[int, str, bool]] = []
        for tree, _, lack, _ in _trees(text):
            for x in ast.walk(tree):
                if isinstance(x, ast.Call):
                    f = x.func
                    if isinstance(f, ast.Name):
                        calls.append((starts[x.lineno - 1 + lack] + x.col_offset, f.id, False))
                    elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                        calls.append((starts[x.lineno - 1 + lack] + x.col_offset, f.attr, f.value.id == "self"))
        calls.sort()
        holders = _Narrowest()
        k = 0
        for at, name, own in calls:
            while k < len(found) and found[k]["start"] <= at:
                holders.add(found[k]["start"], found[k]["end"], k)
                k += 1
            inner = holders.at(at) if own else None
            up = found[found[inner]["parent"]]["qualified"] + "." if inner is not None and found[inner]["parent"] >= 0 else ""
            out.append((at, up + name, "CALLS"))
    elif language == "go":
        masked = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        kinds = {m[1]: m[2] for m in re.finditer(r"\b(\w+)\s*:=\s*&?(\w+)\{", masked)}
        kinds |= {m[1]: m[2] for m in re.finditer(r"\bvar\s+(\w+)\s+\*?(\w+)", masked)} | {m[1]: m[2] for m in re.finditer(r"[(,]\s*(\w+)\s+\*?([A-Z]\w*)\s*(?=[,)])", masked)}
        heads = {x["start"] for x in found}
        byte, done = 0, 0
        for m in re.finditer(r"(?:\b(\w+)\.)?\b(\w+)\s*\(", masked):
            if m[2] not in ("func", "if", "for", "switch", "return", "range") and not re.search(r"func\s+(?:\([^)]*\)\s*)?$", masked[max(0, m.start() - 200) : m.start()]) and m.start() not in heads:
                byte, done = byte + len(text[done : m.start()].encode()), m.start()
                out.append((byte, f"{kinds[m[1]]}.{m[2]}" if m[1] in kinds else m[2], "CALLS"))
    elif language in ("java", "kotlin", "typescript"):
        for x in found:
            if x["kind"] in ("class", "interface", "record", "enum"):
                for word, kind in (("extends", "INHERITS"), ("implements", "IMPLEMENTS")):
                    if m := re.search(rf"\b{word}\s+([\w.<>,\s]+?)(?=\s+(?:extends|implements)\b|$)", x["sig"]):
                        out += [(x["start"], re.sub(r"<.*", "", n).strip(), kind) for n in m[1].split(",") if n.strip()]
    return out


class _Narrowest:
    """The intervals that were added, by rising start; those that ended leave as soon as they would be the narrowest."""

    def __init__(self) -> None:
        self.heap: list[tuple[int, int, int]] = []

    def add(self, start: int, end: int, name: int) -> None:
        heapq.heappush(self.heap, (end - start, name, end))

    def at(self, place: int) -> int | None:
        """The narrowest that holds the place, of equal ones that of the least name; places must not fall."""
        while self.heap and self.heap[0][2] <= place:
            heapq.heappop(self.heap)
        return self.heap[0][1] if self.heap else None


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows in tables of at most ``ROWS``."""
    while part := list(islice(rows, ROWS)):
        yield pd.DataFrame(part, columns=columns)


SYMBOL = "doc_id string, file_name string, language string, package string, sid int, name string, qualified string, node_type string, label string, start long, end long, parent int, receiver string, signature string, visibility string, summary string, chunk_end long, content string"


def symbols(docs: DataFrame) -> DataFrame:
    """The symbols of every file (doc_id, file_name, content), by start; sid -1 is the header, or the whole text where nothing was found.

    A chunk runs from a symbol to the next; files of unknown languages and null or empty texts have no rows here (they go the Markdown way).
    """

    def of(doc: str, name: str, text: str) -> Iterator[tuple]:
        language = language_of(name)
        if not language or not text:
            return
        data, found, base = text.encode(), symbols_of(text, language) or [], name.rpartition("/")[2].rpartition(".")[0]
        package = package_of(text, language)
        first = found[0]["start"] if found else len(data)
        head = data[:first].decode("utf-8", "replace").strip()
        if head:
            yield doc, name, language, package, -1, f"{base} (header)" if found else base, "", "header", "", 0, len(head.encode()), -1, "", f"{base} (header)" if found else base, "unexported", "", first, head
        for k, x in enumerate(found):
            end = found[k + 1]["start"] if k + 1 < len(found) else len(data)
            yield doc, name, language, package, k, x["name"], x["qualified"], x["kind"], label_of(x["kind"]), x["start"], x["end"], x["parent"], x["recv"], x["sig"] or x["name"], x["visibility"], x["doc"], end, data[x["start"] : end].decode("utf-8", "replace").strip()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for row in zip(p["doc_id"], p["file_name"], p["content"]):
                yield from _frames(of(*row), [c.split()[0] for c in SYMBOL.split(", ")])

    return docs.selectExpr("cast(doc_id as string) as doc_id", "file_name", "content").mapInPandas(run, SYMBOL)


def relations(docs: DataFrame) -> DataFrame:
    """(doc_id, at, target, type) of the calls and the heritage in every file."""

    def of(doc: str, name: str, text: str) -> Iterator[tuple]:
        language = language_of(name)
        found = symbols_of(text, language) if language and text else None
        return ((doc, *x) for x in relations_of(text, language, found)) if found else iter(())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for row in zip(p["doc_id"], p["file_name"], p["content"]):
                yield from _frames(of(*row), ["doc_id", "at", "target", "type"])

    return docs.selectExpr("cast(doc_id as string) as doc_id", "file_name", "content").mapInPandas(run, "doc_id string, at long, target string, type string")


def innermost(points: DataFrame, intervals: DataFrame, file: str = "doc_id", at: str = "at") -> DataFrame:
    """Each point (file, at, ...) with the columns of the narrowest interval (file, sid, start, end) that holds it; points in none are left out.

    One pass over the points and the intervals of a file by place: no pairs, and only the intervals that are open are held.
    """
    kind = intervals.schema["sid"].dataType.simpleString()
    row = T.StructType(points.schema.fields)
    p = points.where(f"{file} is not null and {at} is not null").select(F.col(file).alias("f"), F.col(at).cast("long").alias("a"), F.lit(1).alias("point"), F.lit(None).cast("long").alias("z"), F.lit(None).cast(kind).alias("sid"), F.struct(*points.columns).cast(row).alias("row"))
    i = intervals.where(f"{file} is not null and start < end").select(F.col(file).alias("f"), F.col("start").cast("long").alias("a"), F.lit(0).alias("point"), F.col("end").cast("long").alias("z"), "sid", F.lit(None).cast(row).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, _Narrowest()
        for b in batches:
            kept, held = [], []
            columns = [b.column(c).to_pylist() for c in ("f", "a", "point", "z", "sid")]
            for n, (f, place, point, z, sid) in enumerate(zip(*columns)):
                if f != now:
                    now, open_ = f, _Narrowest()
                if not point:
                    open_.add(place, z, sid)
                elif (inner := open_.at(place)) is not None:
                    kept.append(n)
                    held.append(inner)
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(kept, pa.int64())), pa.array(held, b.schema.field("sid").type)], ["row", "sid"])

    both = p.unionByName(i).repartition("f").sortWithinPartitions("f", "a", "point")
    return both.mapInArrow(run, T.StructType([T.StructField("row", row), T.StructField("sid", intervals.schema["sid"].dataType)])).select("row.*", "sid")


def containment(intervals: DataFrame, file: str = "doc_id") -> DataFrame:
    """(file, sid, parent): the narrowest other interval of the file that holds each one; null at the top. Equal intervals: the one with the lesser sid is outside."""
    a, b = intervals.alias("a"), intervals.alias("b")
    holds = F.expr(f"a.{file} = b.{file} and b.start <= a.start and a.end <= b.end and a.sid <> b.sid and (b.start < a.start or a.end < b.end or b.sid < a.sid)")
    pair = a.join(b, holds, "left").select(F.col(f"a.{file}").alias(file), F.col("a.sid").alias("sid"), F.expr("if(b.sid is null, null, struct(b.end - b.start as w, -b.sid as s))").alias("o"))
    return pair.groupBy(file, "sid").agg((-F.min("o")["s"]).alias("parent"))


def resolve(relations_: DataFrame, symbols_: DataFrame) -> DataFrame:
    """(doc_id, src, dst, type) in sids: from the innermost symbol of a relation to the one of this file that the target names.

    A qualified name goes before a plain one, an earlier symbol before a later one; targets outside the file are left out, as are calls of
    classes. Each edge once.
    """
    s = symbols_.where("sid >= 0")
    inside = innermost(relations_, s.select("doc_id", "sid", "start", "end")).withColumn("short", F.regexp_extract("target", "([^.]*)$", 1))
    # a row for each name, so that a call meets one and not all that bear it
    each = s.select("doc_id", "sid", F.col("label").isin("Function", "Method").alias("runs"), F.inline(F.array(F.struct(F.col("qualified").alias("word"), F.lit(True).alias("full")), F.struct(F.col("name").alias("word"), F.lit(False).alias("full")))))
    first = lambda c: F.min(F.when(F.expr(c), F.col("sid")))
    names = each.groupBy("doc_id", "word").agg(first("full").alias("full"), first("full and runs").alias("full_runs"), first("not full").alias("plain"), first("not full and runs").alias("plain_runs"))
    q = names.select("doc_id", F.col("word").alias("target"), "full", "full_runs")
    n = names.select("doc_id", F.col("word").alias("short"), "plain", "plain_runs")
    dst = F.expr("if(type = 'CALLS', coalesce(full_runs, plain_runs), coalesce(full, plain))")
    found = inside.join(q, ["doc_id", "target"], "left").join(n, ["doc_id", "short"], "left")
    return found.select("doc_id", F.col("sid").alias("src"), dst.alias("dst"), "type").where("dst is not null").distinct()


def belongs_to(symbols_: DataFrame) -> DataFrame:
    """(doc_id, src, dst, type) in sids: methods with a receiver belong to the type of this name in the file."""
    m = symbols_.where("receiver <> ''").select("doc_id", F.col("sid").alias("src"), "receiver")
    t = symbols_.where("label in ('Class', 'Interface', 'Type')").groupBy("doc_id", F.col("name").alias("receiver")).agg(F.max("sid").alias("dst"))
    return m.join(t, ["doc_id", "receiver"]).select("doc_id", "src", "dst", F.lit("BELONGS_TO").alias("type"))


def chunk_id():
    return digest(F.col("doc_id"), F.col("signature"), F.col("content"))


def graph(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, nodes and edges of every file.

    Symbols of a package have ids by package, so that one of several files is one node; others by file. A file is a Document node.
    """
    s = symbols(docs)
    chunks = s.select(chunk_id().alias("chunk_id"), "doc_id", "sid", F.col("signature").alias("title"), "summary", "content", "start", "chunk_end", "node_type", "signature", "visibility", "language", "parent")
    scope = F.when(F.col("package") != "", F.col("package")).otherwise(F.col("doc_id"))
    own = digest(scope, F.col("qualified"), F.col("label"))
    named = s.where("sid >= 0").select("doc_id", "sid", own.alias("node_id"), F.array("label").alias("labels"), F.col("qualified").alias("name"), F.create_map(F.lit("node_type"), "node_type", F.lit("signature"), "signature", F.lit("visibility"), "visibility", F.lit("language"), "language", F.lit("receiver"), "receiver").alias("properties"), "parent")
    base = F.regexp_replace(F.regexp_extract("file_name", "([^/]*)$", 1), "\\.[^.]*$", "")
    root = s.groupBy("doc_id", "file_name").agg(F.max("package").alias("package"), F.max("language").alias("language")).select("doc_id", F.lit(-1).alias("sid"), digest(F.col("doc_id"), base, F.lit("Document")).alias("node_id"), F.array(F.lit("Document")).alias("labels"), base.alias("name"), F.create_map(F.lit("node_type"), F.lit("document"), F.lit("language"), "language", F.lit("package"), "package").alias("properties"), F.lit(None).cast("int").alias("parent"))
    every = root.unionByName(named)
    links = named.select("doc_id", F.col("parent").alias("src"), F.col("sid").alias("dst"), F.lit("CONTAINS").alias("type")).unionByName(belongs_to(s)).unionByName(resolve(relations(docs), s))
    a, b = (every.select("doc_id", F.col("sid").alias(x), F.col("node_id").alias(f"{x}_id")) for x in ("src", "dst"))
    edges = links.join(a, ["doc_id", "src"]).join(b, ["doc_id", "dst"]).select(digest(F.col("doc_id"), F.col("src_id"), F.col("type"), F.col("dst_id")).alias("edge_id"), F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "type").dropDuplicates(["edge_id"])
    return chunks, every.drop("sid", "parent").dropDuplicates(["node_id"]), edges
