"""A subset of Cypher compiled to DataFrame plans, read by a tokenizer and a recursive-descent parser.

Reading: MATCH of one or more paths of any length, WHERE, WITH of names, RETURN with aggregates, DISTINCT, ORDER BY, SKIP, LIMIT. Writing
(``execute``): CREATE, MERGE of a node, SET, REMOVE, DELETE, DETACH DELETE. A relationship without an arrow is met in both directions, and
no relationship twice in one path. Properties are a map of strings; a comparison with a number casts, and an order puts numbers by value
before texts. What is not known raises ``CypherError``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import digest
from ..operators import graph


class CypherError(ValueError):
    pass


_TOKEN = re.compile(r"\s+|(?P<text>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<number>\d+\.\d+|\d+)|(?P<param>\$\w+)|(?P<word>[A-Za-z_]\w*|`[^`]+`)|(?P<sign><>|<=|>=|->|<-|[-()\[\]{}:,.|=<>*;+])")
_OWN = {"ID": "node_id", "id": "node_id", "name": "name"}
_AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}


@dataclass
class Node:
    name: str
    labels: list[str]
    props: dict


@dataclass
class Rel:
    name: str
    types: list[str]
    props: dict
    way: int  # 1 to the right, -1 to the left, 0 both


@dataclass
class State:
    nodes: DataFrame
    edges: DataFrame
    rows: DataFrame | None = None
    kinds: dict[str, str] = field(default_factory=dict)
    fresh: int = 0


class Parser:
    def __init__(self, text: str, params: dict):
        self.params, self.tokens, at = params, [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise CypherError(f"no token: {text[at : at + 20]}")
            at = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
        self.at, self.unnamed = 0, 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def word(self, *words: str) -> bool:
        """Takes the words, in any case, if they come next."""
        for k, w in enumerate(words):
            kind, text = self.peek(k)
            if kind != "word" or text.upper() != w:
                return False
        self.at += len(words)
        return True

    def sign(self, text: str) -> bool:
        if self.peek() == ("sign", text):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.sign(text):
            raise CypherError(f"{text} is missing before {self.peek()[1] or 'the end'}")

    def name(self) -> str:
        kind, text = self.peek()
        if kind != "word":
            raise CypherError(f"no name: {text or 'the end'}")
        self.at += 1
        return text.strip("`")

    def literal(self):
        kind, text = self.peek()
        if self.sign("["):
            out = []
            while not self.sign("]"):
                out.append(self.literal())
                self.sign(",")
            return out
        negative = self.sign("-")
        kind, text = self.peek()
        self.at += 1
        if kind == "number":
            value = float(text) if "." in text else int(text)
            return -value if negative else value
        if kind == "text":
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        if kind == "param":
            if text[1:] not in self.params:
                raise CypherError(f"no parameter: {text}")
            return self.params[text[1:]]
        if kind == "word" and text.upper() in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[text.upper()]
        raise CypherError(f"no literal: {text or 'the end'}")

    def props(self) -> dict:
        out = {}
        if self.sign("{"):
            while not self.sign("}"):
                key = self.name()
                self.need(":")
                out[key] = self.literal()
                self.sign(",")
        return out

    def hidden(self) -> str:
        self.unnamed += 1
        return f"_{self.unnamed}"

    def node(self) -> Node:
        self.need("(")
        name = self.name() if self.peek()[0] == "word" else self.hidden()
        labels = []
        while self.sign(":"):
            labels.append(self.name())
        props = self.props()
        self.need(")")
        return Node(name, labels, props)

    def path(self) -> list:
        out: list = [self.node()]
        while self.peek()[1] in ("-", "<-"):
            left = self.sign("<-") or not self.sign("-")
            rel = Rel(self.hidden(), [], {}, 0)
            if self.sign("["):
                if self.peek()[0] == "word":
                    rel.name = self.name()
                if self.sign(":"):
                    rel.types.append(self.name())
                    while self.sign("|"):
                        self.sign(":")
                        rel.types.append(self.name())
                if self.sign("*"):
                    raise CypherError("paths of variable length are not known")
                rel.props = self.props()
                self.need("]")
            right = self.sign("->") or not self.sign("-")
            rel.way = 0 if left == right else 1 if right else -1
            out += [rel, self.node()]
        return out

    def paths(self) -> list[list]:
        out = [self.path()]
        while self.sign(","):
            out.append(self.path())
        return out


# ---- expressions

def _value(state: State, name: str, key: str) -> Column:
    kind = state.kinds.get(name)
    if kind is None:
        raise CypherError(f"no name: {name}")
    if kind == "node" and key in _OWN:
        return F.col(f"{name}.{_OWN[key]}")
    if kind == "rel" and key in ("ID", "id", "type", "src", "dst"):
        return F.col(f"{name}.{'edge_id' if key in ('ID', 'id') else key}")
    return F.try_element_at(F.col(f"{name}.properties"), F.lit(key))


def _compare(left: Column, sign: str, value) -> Column:
    if isinstance(value, bool):
        value = str(value).lower()
    if isinstance(value, (int, float)):
        left = left.try_cast("double")
    if sign == "IN":
        numbers = bool(value) and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in value)
        return (left.try_cast("double") if numbers else left).isin([x if numbers else str(x) for x in value])
    if value is None:
        return F.lit(None).cast("boolean")
    return {"=": left == value, "<>": left != value, ">": left > value, "<": left < value, ">=": left >= value, "<=": left <= value}[sign]


def _term(p: Parser, state: State) -> Column:
    if p.word("NOT"):
        return ~_term(p, state)
    if p.sign("("):
        out = _either(p, state)
        p.need(")")
        return out
    name = p.name()
    if not p.sign("."):
        if p.sign(":"):
            return F.array_contains(F.col(f"{name}.labels"), p.name())
        raise CypherError(f"no condition: {name}")
    left = _value(state, name, p.name())
    if p.word("IS", "NOT", "NULL"):
        return left.isNotNull()
    if p.word("IS", "NULL"):
        return left.isNull()
    sign = "IN" if p.word("IN") else "CONTAINS" if p.word("CONTAINS") else "STARTS" if p.word("STARTS", "WITH") else "ENDS" if p.word("ENDS", "WITH") else p.peek()[1]
    if sign not in ("IN", "CONTAINS", "STARTS", "ENDS"):
        if sign not in ("=", "<>", ">", "<", ">=", "<="):
            raise CypherError(f"no comparison: {sign or 'the end'}")
        p.at += 1
    if p.peek()[0] == "word" and p.peek(1)[1] == ".":  # another property
        other = p.name()
        p.need(".")
        right = _value(state, other, p.name())
        if sign == "IN":
            raise CypherError("IN needs a list")
    else:
        value = p.literal()
        if sign not in ("CONTAINS", "STARTS", "ENDS"):
            return _compare(left, sign, value)
        right = F.lit(value)
    return {"CONTAINS": left.contains, "STARTS": left.startswith, "ENDS": left.endswith}[sign](right) if sign in ("CONTAINS", "STARTS", "ENDS") else _compare_columns(left, sign, right)


def _compare_columns(a: Column, sign: str, b: Column) -> Column:
    return {"=": a == b, "<>": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[sign]


def _both(p: Parser, state: State) -> Column:
    out = _term(p, state)
    while p.word("AND"):
        out = out & _term(p, state)
    return out


def _either(p: Parser, state: State) -> Column:
    out = _both(p, state)
    while p.word("OR"):
        out = out | _both(p, state)
    return out


# ---- reading

def _nodes(state: State, n: Node) -> DataFrame:
    df = state.nodes
    for label in n.labels:
        df = df.where(F.array_contains("labels", label))
    for k, v in n.props.items():
        df = df.where(_compare(F.col(_OWN[k]) if k in _OWN else F.try_element_at("properties", F.lit(k)), "=", v))
    return df.select(F.struct(*[c for c in ("node_id", "labels", "name", "properties") if c in df.columns]).alias(n.name))


def _links(state: State, r: Rel) -> DataFrame:
    df = state.edges
    if r.types:
        df = df.where(F.col("type").isin(r.types))
    if "properties" in df.columns:
        for k, v in r.props.items():
            df = df.where(_compare(F.try_element_at("properties", F.lit(k)), "=", v))
    elif r.props:
        raise CypherError("these relationships have no properties")
    own = F.struct(*[c for c in ("edge_id", "src", "dst", "type", "properties") if c in df.columns]).alias(r.name)
    ends = {1: [("src", "dst")], -1: [("dst", "src")], 0: [("src", "dst"), ("dst", "src")]}[r.way]
    parts = [df.select(own, F.col(a).alias(f"{r.name}_a"), F.col(b).alias(f"{r.name}_b")) for a, b in ends]
    return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1].where(f"{r.name}_a <> {r.name}_b"))


def _match(state: State, paths: list[list]) -> None:
    used: list[str] = []
    for path in paths:
        first = path[0]
        if first.name in state.kinds:
            rows = state.rows
            for label in first.labels:
                rows = rows.where(F.array_contains(F.col(f"{first.name}.labels"), label))
        elif state.rows is None:
            rows = _nodes(state, first)
        elif shared := [x for x in path if isinstance(x, Node) and x.name in state.kinds]:
            # read from the end that is known
            if path[-1].name not in state.kinds:
                raise CypherError(f"start the path with {shared[0].name}")
            path = [Rel(x.name, x.types, x.props, -x.way) if isinstance(x, Rel) else x for x in path[::-1]]
            rows = state.rows
        else:
            raise CypherError("paths need a name in common")
        state.kinds[path[0].name] = "node"
        for r, n in zip(path[1::2], path[2::2]):
            before = path[path.index(r) - 1].name
            rows = rows.join(_links(state, r), F.col(f"{before}.node_id") == F.col(f"{r.name}_a"))
            if n.name in state.kinds:
                rows = rows.where(F.col(f"{n.name}.node_id") == F.col(f"{r.name}_b"))
            else:
                rows = rows.join(_nodes(state, n), F.col(f"{r.name}_b") == F.col(f"{n.name}.node_id"))
                state.kinds[n.name] = "node"
            for other in used:
                rows = rows.where(~((F.col(f"{other}.src") == F.col(f"{r.name}.src")) & (F.col(f"{other}.dst") == F.col(f"{r.name}.dst")) & (F.col(f"{other}.type") == F.col(f"{r.name}.type"))))
            rows = rows.drop(f"{r.name}_a", f"{r.name}_b")
            used.append(r.name)
            state.kinds[r.name] = "rel"
        state.rows = rows


def _item(p: Parser, state: State) -> tuple[Column, bool, str]:
    """(column, whether it is an aggregate, the text)."""
    start = p.at
    kind, text = p.peek()
    if kind != "word":
        return F.lit(p.literal()), False, "".join(t for _, t in p.tokens[start : p.at])
    name = p.name()
    said = lambda: "".join(t for _, t in p.tokens[start : p.at])
    if p.sign("("):
        what = name.lower()
        unique = p.word("DISTINCT")
        if p.sign("*"):
            inner = F.lit(1)
        else:
            arg = p.name()
            inner = _value(state, arg, p.name()) if p.sign(".") else F.col(arg)
            if what in ("labels", "type", "id"):
                inner = F.col(f"{arg}.{ {'labels': 'labels', 'type': 'type', 'id': 'node_id' if state.kinds.get(arg) == 'node' else 'edge_id'}[what] }")
            elif arg not in state.kinds:
                raise CypherError(f"no name: {arg}")
            elif what in ("count", "collect") and p.peek(-1)[1] == arg and p.peek(-2)[1] != ".":
                inner = F.col(f"{arg}.node_id") if state.kinds[arg] == "node" else F.struct(f"{arg}.src", f"{arg}.dst", f"{arg}.type")
        p.need(")")
        if what in ("labels", "type", "id"):
            return inner, False, said()
        if what not in _AGGREGATES:
            raise CypherError(f"no function: {name}")
        number = inner.try_cast("double") if what in ("sum", "avg") else inner
        out = {"count": F.countDistinct if unique else F.count, "sum": F.sum_distinct if unique else F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": F.collect_set if unique else F.collect_list}[what](number)
        return out, True, said()
    if p.sign("."):
        return _value(state, name, p.name()), False, said()
    if name not in state.kinds:
        raise CypherError(f"no item: {name}")
    return F.col(name), False, name


def _order(c: Column, down: bool, texts: bool) -> list[Column]:
    keys = [c.try_cast("double"), c] if texts else [c]
    return [k.desc_nulls_last() if down else k.asc_nulls_last() for k in keys]


def _return(p: Parser, state: State) -> DataFrame:
    unique = p.word("DISTINCT")
    items: list[tuple[str, Column, bool, str]] = []
    while True:
        c, many, said = _item(p, state)
        items.append((p.name() if p.word("AS") else said, c, many, said))
        if not p.sign(","):
            break
    plain, counts = [(n, c) for n, c, many, _ in items if not many], [(n, c) for n, c, many, _ in items if many]
    df = state.rows
    if counts:
        df = df.groupBy(*[c.alias(n) for n, c in plain]).agg(*[c.alias(n) for n, c in counts]) if plain else df.agg(*[c.alias(n) for n, c in counts])
        df = df.select(*[F.col(f"`{n}`") for n, *_ in items])
    elif unique:
        df = df.select(*[c.alias(n) for n, c in plain]).distinct()
    names = {n: n for n, *_ in items} | {said: n for n, _, _, said in items}
    done = bool(counts) or unique
    if p.word("ORDER", "BY"):
        keys: list[Column] = []
        while True:
            start = p.at
            alias = p.peek()[0] == "word" and p.peek()[1].strip("`") in names and p.peek(1)[1] not in (".", "(")
            if alias:
                said = p.name()
                column = None
            else:
                try:
                    column, many, said = _item(p, state)
                except CypherError:
                    p.at = start
                    raise
            down = p.word("DESC") or p.word("DESCENDING")
            if not down:
                p.word("ASC") or p.word("ASCENDING")
            if done:
                if said not in names:
                    raise CypherError(f"not returned: {said}")
                column = F.col(f"`{names[said]}`")
                kind = df.schema[names[said]].dataType.simpleString()
            else:
                column = next(c for n, c, _, s in items if said in (n, s)) if column is None or said in names else column
                kind = state.rows.select(column.alias("x")).schema["x"].dataType.simpleString()
            keys += _order(column, down, kind == "string")
            if not p.sign(","):
                break
        df = df.orderBy(*keys)
    if not done:
        df = df.select(*[c.alias(n) for n, c in plain])
    if p.word("SKIP"):
        df = df.offset(int(p.literal()))
    return df.limit(int(p.literal())) if p.word("LIMIT") else df


# ---- writing

def _text(value) -> str | None:
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def _create(p: Parser, state: State, paths: list[list]) -> None:
    """Nodes without an ID get a digest of their place in the statement and of the rows they are made for."""
    spark = state.nodes.sparkSession
    base = state.rows if state.rows is not None else spark.range(1).select(F.lit(0).alias("_one"))
    known = [F.col(f"{n}.node_id") for n, k in state.kinds.items() if k == "node"]
    names = dict(state.kinds)
    for path in paths:
        for n in path[::2]:
            if n.name in names:
                continue
            state.fresh += 1
            own = n.props.get("ID", n.props.get("id"))
            count = F.lit(0) if own is not None or known else F.lit(state.nodes.count())
            node_id = F.lit(str(own)) if own is not None else digest(F.lit("created"), F.lit(state.fresh), count, F.lit("|".join([*n.labels, *map(str, n.props.items())])), *known)
            props = [x for k, v in n.props.items() if k not in ("ID", "id") for x in (F.lit(k), F.lit(_text(v)))]
            made = F.struct(node_id.alias("node_id"), F.array(*map(F.lit, n.labels)).cast("array<string>").alias("labels"), F.lit(_text(n.props.get("name"))).alias("name"), (F.create_map(*props) if props else F.create_map()).cast("map<string,string>").alias("properties"))
            base = base.withColumn(n.name, made)
            new = base.select(f"{n.name}.*").dropDuplicates(["node_id"])
            state.nodes = state.nodes.unionByName(new, allowMissingColumns=True)
            names[n.name] = "node"
        for k in range(1, len(path), 2):
            r, (a, b) = path[k], (path[k - 1].name, path[k + 1].name)
            if r.way == 0 or len(r.types) != 1:
                raise CypherError("a relationship is made with one type and one direction")
            a, b = (a, b) if r.way == 1 else (b, a)
            src, dst, kind = F.col(f"{a}.node_id"), F.col(f"{b}.node_id"), F.lit(r.types[0])
            new = base.select(digest(src, kind, dst).alias("edge_id"), src.alias("src"), dst.alias("dst"), kind.alias("type")).distinct()
            if "properties" in state.edges.columns:
                pairs = [x for k2, v in r.props.items() for x in (F.lit(k2), F.lit(_text(v)))]
                new = new.withColumn("properties", (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>"))
            elif r.props:
                raise CypherError("these relationships have no properties")
            state.edges = state.edges.unionByName(new.select(*[c for c in new.columns if c in state.edges.columns]), allowMissingColumns=True)
    state.rows, state.kinds = base, names


def _change(state: State, name: str, key: str, value, remove: bool) -> None:
    if state.kinds.get(name) != "node":
        raise CypherError(f"no node: {name}")
    ids = state.rows.select(F.col(f"{name}.node_id").alias("_id")).distinct().withColumn("_hit", F.lit(True))
    df = state.nodes.join(ids, F.col("node_id") == F.col("_id"), "left")
    old = F.coalesce("properties", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: k != key)
    new = kept if remove or value is None else F.map_concat(kept, F.create_map(F.lit(key), F.lit(_text(value))))
    df = df.withColumn("properties", F.when(F.col("_hit"), new).otherwise(F.col("properties")))
    if key == "name":
        df = df.withColumn("name", F.when(F.col("_hit"), F.lit(None if remove else _text(value))).otherwise(F.col("name")))
    state.nodes = df.select(*state.nodes.columns)


def _delete(state: State, names: list[str], detach: bool) -> None:
    for name in names:
        kind = state.kinds.get(name)
        if kind == "rel":
            gone = state.rows.select(*[F.col(f"{name}.{c}").alias(c) for c in ("src", "dst", "type")]).distinct()
            state.edges = state.edges.join(gone, ["src", "dst", "type"], "left_anti").select(*state.edges.columns)
        elif kind == "node":
            gone = state.rows.select(F.col(f"{name}.node_id").alias("node_id")).distinct()
            nodes, edges = graph.detach_delete(state.nodes, state.edges, gone)
            if not detach and edges.count() != state.edges.count():
                raise CypherError(f"{name} has relationships: DETACH DELETE")
            state.nodes, state.edges = nodes, edges
        else:
            raise CypherError(f"no name: {name}")


def execute(nodes: DataFrame, edges: DataFrame, text: str, params: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(nodes, edges, rows): the tables after the statement, and what RETURN gives, if it is there."""
    p, state, out = Parser(text, params or {}), State(nodes, edges), None
    if not p.tokens:
        raise CypherError("an empty statement")
    while p.peek()[0] != "end" and not p.sign(";"):
        if out is not None:
            raise CypherError(f"after RETURN: {p.peek()[1]}")
        if p.word("MATCH"):
            _match(state, p.paths())
        elif p.word("CREATE"):
            _create(p, state, p.paths())
        elif p.word("MERGE"):
            path = p.path()
            if len(path) != 1:
                raise CypherError("MERGE knows single nodes")
            there = _nodes(state, path[0])
            if there.isEmpty():
                _create(p, state, [path])
            else:
                state.rows = there
                state.kinds[path[0].name] = "node"
        elif p.word("WHERE"):
            state.rows = state.rows.where(_either(p, state)) if state.rows is not None else None
        elif p.word("WITH"):
            kept = [p.name()]
            while p.sign(","):
                kept.append(p.name())
            state.kinds = {k: v for k, v in state.kinds.items() if k in kept}
            if len(state.kinds) != len(kept):
                raise CypherError("WITH knows names that are matched")
            state.rows = state.rows.select(*kept)
        elif p.word("SET") or p.word("REMOVE"):
            remove = p.peek(-1)[1].upper() == "REMOVE"
            while True:
                name = p.name()
                p.need(".")
                key = p.name()
                if not remove:
                    p.need("=")
                _change(state, name, key, None if remove else p.literal(), remove)
                if not p.sign(","):
                    break
        elif p.word("DETACH", "DELETE") or p.word("DELETE"):
            detach = p.at > 1 and p.peek(-2)[1].upper() == "DETACH"
            names = [p.name()]
            while p.sign(","):
                names.append(p.name())
            _delete(state, names, detach)
        elif p.word("RETURN"):
            if state.rows is None:
                raise CypherError("RETURN needs MATCH")
            out = _return(p, state)
        else:
            raise CypherError(f"unknown clause: {p.peek()[1]}")
    return state.nodes, state.edges, out


def run(nodes: DataFrame, edges: DataFrame, text: str, params: dict | None = None) -> DataFrame:
    """The rows of a statement that only reads."""
    if any(kind == "word" and t.upper() in ("CREATE", "MERGE", "SET", "REMOVE", "DELETE") for kind, t in Parser(text, params or {}).tokens):
        raise CypherError("this statement writes: use execute")
    rows = execute(nodes, edges, text, params)[2]
    if rows is None:
        raise CypherError("RETURN is missing")
    return rows
