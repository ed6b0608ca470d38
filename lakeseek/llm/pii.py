"""Personal identifiers by bootstrapped contextual extraction.

Mentions are the tokens with a digit or an at sign, neighbouring number groups taken together, and whatever stands after a secret's
key. A mention that a strict validator passes (a card number with a right check digit, an address with a known top-level domain, ...)
is a seed; plain short numbers, versions and dates are counter-examples; all others are unknown. Each mention carries lexical
patterns: its shape (letter, digit and mixed runs with the lengths of long ones), its shape after the word or key to its left, that
word alone and the word to its right alone. Spark scores the graph of patterns and instances in rounds until nothing new is accepted:
a pattern's confidence is the share of confirmed instances among those decided (of a word alone, which holds any form: among all),
with a prior against few; patterns above ``MIN_CONFIDENCE`` with ``MIN_SUPPORT`` confirmed instances confirm their unknown
instances, which count in the next round. So identifiers are found that no validator knows: a card number with a wrong check digit,
a secret of another key, a number of a new form after a learnt word.

Defined cases: a null or empty text has no mentions; a null id gives mentions of id null; every mention of a repeated row is
listed; a table without seeds gives no patterns and an empty result; other columns pass through ``redact``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if, broadcast_value, cut, fresh
from .tokens import pieces, text_buffer

MIN_CONFIDENCE = 0.8
MIN_SUPPORT = 3
#: Up to so many patterns are sent to the executors.
KNOWN = 100_000
_ASKED = np.zeros(256, bool)
_ASKED[48:58] = True
_ASKED[64] = True
_NUMBER = r"[+(]{0,2}\d{1,6}(?:[)-]{1,3}\d{1,6}){0,6}\)?"
_KEYED = r"(?:password|passwd|secret|token|api_?key)\s*[=:]\s*[\"']?"
_IBAN = r"\b[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?!\w)"
_SECRET = re.compile(rf"(?i:{_KEYED})(?P<value>[^\s\"'<>]+)")
# a run is taken whole, with or without a digit, so the time needed is linear in the text
MENTION = re.compile(rf"{_IBAN}|(?<![\w@.+-]){_NUMBER}(?: {_NUMBER}(?![\w@]|[.-]\d))+|[^\s=\"'<>|,;:(){{}}\[\]]++")
_EDGE = ".!?*#&$%-_/\\"
_RUN = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")
_TLD = "com|org|net|edu|gov|io|de|fr|es|uk|eu|info|biz"
_EMAIL = re.compile(rf"[\w.+-]+@(?:[\w-]+\.)+(?:{_TLD})", re.ASCII)
_PHONE = re.compile(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}")
_KEY = re.compile(r"AKIA[0-9A-Z]{16}")
_RIGHT = re.compile(r"[\"')\]]*\s+([^\W\d_]+)")
_PLAIN = re.compile(r"v?\d{1,4}(?:\.\d{1,3}){0,2}|\d{1,2}(?:st|nd|rd|th)")
_DATE = re.compile(r"(\d{1,4})([-/])(\d{1,2})\2(\d{1,4})")


def _luhn(digits: str) -> bool:
    d = [int(c) for c in digits[::-1]]
    return sum(d[::2]) % 10 + sum(sum(divmod(2 * x, 10)) for x in d[1::2]) % 10 in (0, 10)


def _date(value: str) -> bool:
    """Year first, or day and month in either order before a year of two or four digits."""
    m = _DATE.fullmatch(value)
    if not m:
        return False
    a, b, c = m[1], m[3], m[4]
    day = lambda d, month: 1 <= int(d) <= 31 and 1 <= int(month) <= 12
    return (len(a) in (2, 4) and len(c) < 3 and day(c, b)) or (len(a) < 3 and len(c) in (2, 4) and (day(a, b) or day(b, a)))


def seed_kind(value: str, keyed: bool = False) -> str | None:
    """The kind of a certain identifier, '' for a counter-example, None if unknown. keyed: it stands after a secret's key."""
    if _EMAIL.fullmatch(value):
        return "EMAIL"
    if _PHONE.fullmatch(value):
        return "PHONE"
    if _KEY.fullmatch(value):
        return "KEY"
    digits = re.sub(r"[ -]", "", value)
    if digits.isdecimal() and digits.isascii() and 13 <= len(digits) <= 19:
        return "CARD" if digits[0] in "3456" and _luhn(digits) else None
    parts = value.split(".")
    if len(parts) == 4 and all(p.isdecimal() and p.isascii() and len(p) < 4 and int(p) < 256 for p in parts):
        return "IP"
    if keyed and len(value) >= 8:
        return "SECRET"
    return "" if _PLAIN.fullmatch(value) or _date(value) else None


def shape(value: str) -> str:
    def run(m: re.Match) -> str:
        s = m[0]
        if s.isdecimal():
            return "9" if len(s) < 5 else f"9{{{len(s)}}}"
        if any(c.isdecimal() for c in s) and len(s) >= 12:
            return f"{'K' if s.isupper() else 'X'}{{{len(s)}}}"
        return "w"

    out = _RUN.sub(run, value)
    name, at, host = out.partition("@")
    return "w@w" if at and re.fullmatch(r"[w9{}.+_-]+", name) and re.fullmatch(r"[w9{}.-]+\.[w9{}.-]+", host) else out


def left_word(text: str, at: int) -> str:
    """The word before a value, in lower case, with = after it if it is the value's key; however long it is."""
    j = at - 1 if at and text[at - 1] in "\"'(" else at
    k = j
    while k and text[k - 1].isspace():
        k -= 1
    sign = k > 0 and text[k - 1] in "=:"
    if sign:
        k -= 1
        while k and text[k - 1].isspace():
            k -= 1
    elif k == j:
        return ""
    end = k
    while k and text[k - 1].isalpha():
        k -= 1
    return text[k:end].lower() + "=" if sign and k < end else text[k:end].lower()


def _spans(text: str) -> Iterator[tuple[int, str, bool]]:
    """(first character, characters, keyed) of whatever may be a mention, in order."""
    last = 0
    for m in _SECRET.finditer(text):
        yield from ((x.start(), x[0], False) for x in MENTION.finditer(text, last, m.start("value")))
        yield m.start("value"), m["value"], True
        last = m.end()
    yield from ((x.start(), x[0], False) for x in MENTION.finditer(text, last))


def mentions(text: str) -> Iterator[tuple[int, str, str, str, str | None]]:
    """(first character, value, left word with its sign, right word, seed kind)."""
    for start, whole, keyed in _spans(text):
        if not keyed and "@" not in whole and not _DIGIT.search(whole):
            continue
        value = whole.rstrip(".,;") if keyed else whole.strip(_EDGE)
        if not keyed and value.endswith(")") and "(" not in value:
            value = value.rstrip(").")
        if not value or not (keyed or "@" in value or _DIGIT.search(value)):
            continue
        at = start + whole.index(value)
        after = _RIGHT.match(text, at + len(value))
        yield at, value, left_word(text, at), after[1].lower() if after else "", seed_kind(value, keyed)


def patterns(value: str, left: str, right: str) -> tuple[str, str, str | None, str | None]:
    """Shape, shape after the left word, left word alone, right word alone; a star stands for any value, and no value begins or ends with one."""
    s = shape(value)
    return s, f"{left} {s}", f"{left} *" if left else None, f"* {right}" if right else None


PATTERNS = ("shape", "cued", "left", "right")


def _rows_with_marks(column: pa.Array) -> np.ndarray:
    raw, off = text_buffer(column)
    at = np.flatnonzero(_ASKED[raw])
    marked = np.searchsorted(off, at, side="right") - 1
    keyed = np.flatnonzero(pc.fill_null(pc.match_substring_regex(column, _KEYED, ignore_case=True), False).to_numpy(zero_copy_only=False))
    return np.unique(np.concatenate([marked, keyed]))


def _extract(keyed: bool):
    head = pa.struct([("id", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]) if keyed else pa.int64()
    kind = [head, pa.int32(), pa.int32(), *[pa.string()] * 6]
    first = "text_key" if keyed else "doc_id"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            out: list[list] = [[] for _ in kind]
            text, doc = b.column("text"), b.column(first)
            for i in _rows_with_marks(text):
                own = doc[i].as_py()
                for at, value, left, right, seed in mentions(text[i].as_py()):
                    for c, x in zip(out, (own, at, len(value), value, *patterns(value, left, right), seed)):
                        c.append(x)
            if out[0]:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kind)], [first, "start", "length", "value", *PATTERNS, "seed"])

    return run


def extract(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """The mentions with their patterns; of each id, or keyed, of each id and text."""
    head = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(9), "text").alias("b")).alias("text_key") if keyed else F.col("doc_id").cast("long").alias("doc_id")
    first = "text_key struct<id:long,a:long,b:long>" if keyed else "doc_id long"
    return docs.select(head, "text").mapInArrow(_extract(keyed), f"{first}, start int, length int, value string, shape string, cued string, left string, right string, seed string")


def learn(found: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(pattern, kind, confidence) of the accepted patterns; those a shape of the same kind already covers are left out."""
    # an instance is a value with its patterns: the edges of the graph, each once
    edges = cut(found.groupBy("value", *PATTERNS).agg(F.max("seed").alias("seed")).select("value", F.explode(F.array(*PATTERNS)).alias("pattern"), "seed").where("pattern is not null").groupBy("value", "pattern").agg(F.max("seed").alias("seed")))
    scored = edges.withColumn("kind", F.nullif("seed", F.lit(""))).withColumn("score", F.when(F.col("seed") == "", 0.0).when(F.col("seed").isNotNull(), 1.0))
    alone = F.expr("startswith(pattern, '* ') or endswith(pattern, ' *')")
    accepted = None
    while True:  # what is accepted stays, so there is an end
        votes = scored.withColumn("score", F.when(alone, F.coalesce("score", F.lit(0.0))).otherwise(F.col("score"))).where("score is not null").groupBy("pattern", "kind").agg(F.sum("score").alias("yes"), F.sum(1 - F.col("score")).alias("no"))
        best = votes.groupBy("pattern").agg(F.max_by("kind", F.struct("yes", "kind")).alias("kind"), F.max("yes").alias("yes"), (F.sum("yes") + F.sum("no")).alias("all"))
        fresh = best.withColumn("confidence", F.col("yes") / (F.col("all") + 0.5)).where((F.col("confidence") >= min_confidence) & (F.col("yes") >= min_support) & F.col("kind").isNotNull()).select("pattern", "kind", "confidence")
        if accepted is None:
            accepted = cut(fresh)
        else:
            fresh = cut(fresh.join(broadcast_if(accepted), "pattern", "left_anti"))
            if fresh.isEmpty():
                break
            accepted = cut(accepted.unionAll(fresh).coalesce(1))
        reach = edges.where("seed is null").join(broadcast_if(accepted), "pattern").groupBy("value").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("_kind"), F.max("confidence").alias("_score"))
        scored = edges.join(reach, "value", "left").select("value", "pattern", "seed", F.coalesce(F.nullif("seed", F.lit("")), "_kind").alias("kind"), F.when(F.col("seed") == "", 0.0).when(F.col("seed").isNotNull(), 1.0).otherwise(F.col("_score")).alias("score"))
    shapes = accepted.where(~alone & F.expr("instr(pattern, ' ') = 0 or substring(pattern, 1, 1) = '+'")).select(F.col("pattern").alias("_shape"), F.col("kind").alias("_kind"))
    covered = F.expr("kind = _kind and endswith(pattern, concat(' ', _shape))")
    return accepted.join(broadcast_if(shapes), covered, "left_anti")


def _kinds(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """``found`` with the kind and confidence of what is an identifier."""
    joined = found.where("seed is null or seed <> ''")
    for p in PATTERNS:
        joined = joined.join(accepted.select(F.col("pattern").alias(p), F.col("kind").alias(f"_k_{p}"), F.col("confidence").alias(f"_c_{p}")), p, "left")
    seed = F.nullif("seed", F.lit(""))
    kind, confidence = (F.coalesce(*[f"_{x}_{p}" for p in PATTERNS]) for x in "kc")
    return joined.withColumns({"kind": F.coalesce(seed, kind), "confidence": F.when(seed.isNotNull(), 1.0).otherwise(confidence)}).where("kind is not null")


def find(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, start, length, kind, value, confidence) of every identifier; seeds have confidence 1."""
    found = cut(extract(docs))
    return _kinds(found, broadcast_if(cut(learn(found, **options)))).select("doc_id", "start", "length", "kind", "value", "confidence")


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every identifier replaced by its kind in angle brackets; ``n_chars``, where it is, follows the text.

    Up to ``KNOWN`` accepted patterns are sent to the executors, which read the texts a second time. With more, the spans found are
    joined to the documents by id and hash of the text; the result is the same.
    """
    found = cut(extract(docs))
    accepted = cut(learn(found, **options))
    names = docs.columns
    known = {r.pattern: r.kind for r in accepted.limit(KNOWN + 1).collect()}
    if len(known) <= KNOWN:
        shared = broadcast_value(docs.sparkSession, known)

        def kinds(text: str) -> Iterator[tuple[int, int, str]]:
            for at, value, left, right, seed in mentions(text):
                kind = seed or (None if seed == "" else next((k for p in patterns(value, left, right) if (k := shared.value.get(p))), None))
                if kind:
                    yield at, len(value), kind

        return docs.mapInArrow(_replacing(names, lambda b, i: kinds(b.column("text")[i].as_py()), None), T.StructType(docs.schema.fields))
    spans, key = (fresh(names, x) for x in ("_spans", "_key"))
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(9), "text").alias("b")))
    each = _kinds(cut(extract(docs, True)), broadcast_if(accepted)).select("text_key", F.struct("start", "length", "kind").alias("span"))
    listed = each.groupBy("text_key").agg(F.sort_array(F.collect_set("span")).alias(spans)).select(F.col("text_key").alias("_mine"), spans)
    joined = keyed.join(listed, F.col(key).eqNullSafe(F.col("_mine")), "left").select(*names, spans)
    return joined.mapInArrow(_replacing(names, lambda b, i: ((x["start"], x["length"], x["kind"]) for x in b.column(spans)[i].as_py() or ()), spans), T.StructType(docs.schema.fields))


def _replacing(names: list[str], spans_of: Callable, column: str | None):
    def clean(text: str, found: Iterator[tuple[int, int, str]]) -> str:
        out, last = [], 0
        for at, length, kind in found:
            out += [text[last:at], f"<{kind}>"]
            last = at + length
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            text = b.column("text")
            hit = _rows_with_marks(text) if column is None else np.flatnonzero(b.column(column).is_valid().to_numpy(zero_copy_only=False))
            columns = [b.column(n) for n in names]
            if len(hit):
                new = text.to_pylist()
                for i in hit:
                    new[i] = clean(new[i], spans_of(b, int(i)))
                columns = [pa.array(new, text.type) if n == "text" else b.column(n) for n in names]
                if "n_chars" in names:
                    size = b.column("n_chars").to_pylist()
                    for i in hit:
                        size[i] = len(new[i])
                    columns[names.index("n_chars")] = pa.array(size, b.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return run
