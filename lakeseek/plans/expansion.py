"""What a language model adds to a query: other wordings, a made answer, a graph statement. The model is a function of a prompt.

A model that fails or answers nothing leaves the query as it is; a statement is only used if it parses and only reads.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from ..extensions import log
from .cypher import CypherError, Parser

Model = Callable[[str], str]
_WRITES = {"CREATE", "MERGE", "SET", "REMOVE", "DELETE", "DETACH"}


def _ask(model: Model, prompt: str) -> str:
    try:
        return (model(prompt) or "").strip()
    except Exception as e:
        log.warning("the model failed: %s", e)
        return ""


def wordings(text: str, model: Model, most: int = 3) -> list[str]:
    """The query and up to ``most`` other wordings, one a line in the answer, each once."""
    got = _ask(model, f"Write {most} other wordings of this search query, one a line:\n{text}")
    rows = [x.lstrip("-*0123456789. ").strip() for x in got.split("\n")]
    return list(dict.fromkeys([text, *[x for x in rows if x][:most]]))


def rewrite(text: str, model: Model) -> str:
    return _ask(model, f"Rewrite this search query so that it stands alone:\n{text}") or text


def made_answer(text: str, model: Model) -> str:
    """A passage that could answer the query, to be embedded in its place."""
    return _ask(model, f"Write a short passage that answers:\n{text}") or text


def to_cypher(question: str, schema: str, model: Model, attempts: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """A statement that parses and does not write; each attempt is told the last error, after waits of 2 and 4 seconds. Else ``CypherError``."""
    error = ""
    for k in range(attempts):
        if k:
            sleep(wait * 2 ** (k - 1))
        said = _ask(model, f"Graph schema:\n{schema}\nWrite one Cypher statement that answers: {question}\n{error}")
        text = said.removeprefix("```cypher").removeprefix("```").removesuffix("```").strip()
        try:
            words = {t.upper() for kind, t in Parser(text, {}).tokens if kind == "word"}
            if not {"MATCH", "RETURN"} <= words:
                raise CypherError("MATCH and RETURN are needed")
            if words & _WRITES:
                raise CypherError("the statement writes")
            return text
        except CypherError as e:
            error = f"The last answer was wrong: {e}"
    raise CypherError(f"no statement after {attempts} attempts. {error}")
