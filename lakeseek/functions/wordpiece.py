"""WordPiece tokens for encoder models: basic splitting, then the longest piece first, as Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B81F), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
LONGEST = 100


def load_vocabulary(path: str) -> dict[str, int]:
    """One token a line; its number is its line."""
    with open(path, encoding="utf-8") as f:
        return {line.rstrip("\n"): k for k, line in enumerate(f)}


def basic(text: str, lower: bool = True) -> list[str]:
    """Words at white space; every CJK sign and every punctuation sign stands alone; control signs and, in lower case, accents go."""
    out: list[str] = []
    word = ""
    for c in unicodedata.normalize("NFD", text.lower()) if lower else text:
        kind = unicodedata.category(c)
        if lower and kind == "Mn":
            continue
        if kind in ("Cc", "Cf") and c not in "\t\n\r" or c == "�":
            continue
        alone = kind[0] == "P" or c in "$+<=>^`|~" or any(a <= ord(c) <= z for a, z in _CJK)
        if c.isspace() or alone:
            if word:
                out.append(word)
            word = ""
            if alone:
                out.append(c)
        else:
            word += c
    return [*out, word] if word else out


def pieces(word: str, vocabulary: dict[str, int], unknown: str = "[UNK]") -> list[str]:
    """The longest pieces from the left; the whole word is unknown if any part is, or if it is longer than ``LONGEST``."""
    out, at = [], 0
    if len(word) > LONGEST:
        return [unknown]
    while at < len(word):
        end = len(word)
        while end > at and ("##" if at else "") + word[at:end] not in vocabulary:
            end -= 1
        if end == at:
            return [unknown]
        out.append(("##" if at else "") + word[at:end])
        at = end
    return out


def encode(text: str | None, vocabulary: dict[str, int], most: int = 512, lower: bool = True) -> tuple[list[int], list[int]]:
    """(ids, mask) of this length: [CLS], the pieces that fit, [SEP], then padding, which the mask leaves out. A null text is empty."""
    tokens = [p for w in basic(text or "", lower) for p in pieces(w, vocabulary)][: most - 2]
    ids = [vocabulary[t] for t in ("[CLS]", *tokens, "[SEP]")]
    pad = most - len(ids)
    return ids + [vocabulary["[PAD]"]] * pad, [1] * len(ids) + [0] * pad


def encode_column(text: Column, vocabulary: dict[str, int] | Sequence[str], most: int = 512, lower: bool = True) -> Column:
    """A struct (ids, mask) of each text."""
    table = vocabulary if isinstance(vocabulary, dict) else {w: k for k, w in enumerate(vocabulary)}

    @F.pandas_udf("ids array<int>, mask array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [encode(t, table, most, lower) for t in p]
            yield pd.DataFrame({"ids": [r[0] for r in rows], "mask": [r[1] for r in rows]})

    return run(text)
