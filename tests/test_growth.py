"""Steps whose work must grow no faster than their input, against plain versions."""

import datetime
import random
import time

from pyspark.sql import functions as F

from lakeseek.operators import code, graph, meta, split
from lakeseek.plans import catalog
from lakeseek.sources import files


def _module(n: int) -> str:
    return "# one\nclass N:\n" + "\n".join(f"    def c{k}(self):\n        self.c{max(0, k - 1)}()\n" for k in range(n)) + "\nN()\n"


def test_code_time_is_linear_in_a_file():
    def took(n: int) -> float:
        text, began = _module(n), time.process_time()
        found = code.symbols_of(text, "python")
        assert len(found) == n + 1 and len(code.relations_of(text, "python", found)) == n + 1
        return time.process_time() - began

    least = min(took(1000) for _ in range(4))
    assert min(took(9000) for _ in range(2)) < 22 * least  # a linear step gives about 10, the one before gave 37


def test_code_in_pieces_is_code_as_a_whole(monkeypatch):
    text = "import x\n\n# top\n@x.d(\n  1)\nclass A(B):\n    '''Doc.'''\n    k = '''\n  def no():\n'''\n\n    # first é\n    def f(self):\n        self.g()\n        if k:\n            def inner(): pass\n        else:\n            y()\n    async def g(self):\n        async with z as q:\n            q.h()\n        return 1\n    class C:\n        def h(self): return self.f()\n\n    def last(self):\n        pass\ndef out():\n\tfor a in b:\n\t\tout()\n\telse:\n\t\tA()\nout(); A()\n"
    whole = code.symbols_of(text, "python")
    calls = sorted(code.relations_of(text, "python", whole))
    assert [x["qualified"] for x in whole] == ["A", "A.f", "A.f.inner", "A.g", "A.C", "A.C.h", "A.last", "out"]
    for size in (1, 40, 150):
        monkeypatch.setattr(code, "PIECE", size)
        assert len(list(code._trees(text))) > 1
        assert code.symbols_of(text, "python") == whole and sorted(code.relations_of(text, "python", whole)) == calls
        assert code.symbols_of(text + "def (", "python") is None and code.symbols_of("class A:\n    x = 1\n    y = 2\nelse:\n    z\n", "python") is None


def test_calls_against_plain_rules(spark):
    r = random.Random(3)
    spans = [(f"d{r.randrange(3)}", k, a := r.randrange(40), a + r.randrange(25), r.choice("abc"), f"{r.choice('XY')}.{r.choice('abc')}", r.choice(["Function", "Class", "Method"])) for k in range(90)]
    points = [(f"d{r.randrange(4)}", r.randrange(70), r.choice(["a", "X.b", "Y.c", "q.a", "Z"]), r.choice(["CALLS", "INHERITS"])) for _ in range(200)]
    want, inside = set(), []
    for d, at, target, kind in points:
        src = min(((z - a, k) for e, k, a, z, *_ in spans if e == d and a <= at < z), default=None)
        if src:
            inside.append((d, at, src[1]))
            to = [(q != target, k) for e, k, _, _, n, q, label in spans if e == d and (q == target or n == target.rpartition(".")[2]) and (kind != "CALLS" or label != "Class")]
            want |= {(d, src[1], min(to)[1], kind)} if to else set()
    s = spark.createDataFrame(spans, "doc_id string, sid int, start long, end long, name string, qualified string, label string")
    p = spark.createDataFrame(points, "doc_id string, at long, target string, type string")
    got = code.innermost(p, s)
    assert sorted((x.doc_id, x.at, x.sid) for x in got.collect()) == sorted(inside) and got.columns == [*p.columns, "sid"]
    assert "Join" not in got._jdf.queryExecution().sparkPlan().toString()  # no pairs of points and intervals
    rows = [tuple(x) for x in code.resolve(p, s.withColumn("receiver", F.lit(""))).collect()]
    assert set(rows) == want and len(rows) == len(want)


def _joined(df) -> int:
    """The most rows that any join of a table gives."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        x = todo.pop()
        kind = x.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(x.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(x.plan())
        else:
            todo += [x.children().apply(k) for k in range(x.children().size())]
        if "Join" in kind and x.metrics().contains("numOutputRows"):
            most = max(most, x.metrics().apply("numOutputRows").value())
    return most


def test_edges_around_many_starts_are_no_pairs(spark):
    n = 300
    roots = spark.createDataFrame([(f"d{k}", "/a", f"f{k}") for k in range(n)], "node_id string, dir string, file_name string")
    nodes = spark.createDataFrame([(f"d{k}", ["Document"], f"d{k}", {}) for k in range(n)] + [("e", ["Entity"], "e", {})], "node_id string, labels array<string>, name string, properties map<string,string>")
    edges = spark.createDataFrame([(f"h{k}", f"d{k}", "e", "HAS") for k in range(n)], "edge_id string, src string, dst string, type string")
    links = graph.explore_region(*graph.save_roots(nodes, edges, roots), "/a")[1]
    assert links.count() == 2 * n and _joined(links) <= 4 * n


def test_neighbourhood_against_plain_search(spark):
    r = random.Random(5)
    pairs = sorted({(f"n{r.randrange(30)}", f"n{r.randrange(30)}", r.choice("xy")) for _ in range(45)})
    edges = spark.createDataFrame([(str(k), *p) for k, p in enumerate(pairs)] + [("null", "n1", None, "x")], "edge_id string, src string, dst string, type string")
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(30)], "node_id string")
    for depth, limit, clamp, starts in ((1, 100, True, ["n1", "n2", "n3"]), (2, 3, True, ["n1", "n4"]), (3, 4, True, ["n1", "n2", "n9"]), (3, 0, True, ["n5"]), (2, 2, False, ["n1", "n7"]), (5, 100, True, ["n2"]), (0, 5, False, ["n1"])):
        around, met = set(), set()
        for s in starts:
            hops, count = {s: 0}, 0
            for h in range(1, min(depth, 3) + 1):
                if depth > 1 and limit > 0 and count >= limit:
                    break
                new = {y for a, b, _ in [*pairs, ("n1", None, "x")] for x, y in ((a, b), (b, a)) if x is not None and hops.get(x) == h - 1} - set(hops)
                hops |= dict.fromkeys(new, h)
                count += len(new)
            around |= set(hops) - {s, None}
            met |= {(a, b, t) for a, b, t in pairs if a in hops and b in hops and min(hops[a], hops[b]) < depth}
        got, links = graph.neighbourhood(nodes, edges, spark.createDataFrame([(x,) for x in starts], "node_id string"), depth, limit, clamp)
        assert {x.node_id for x in got.collect()} == (around - set(starts) if clamp else around)
        rows = [(x.src, x.dst, x.type) for x in links.collect()]
        assert set(rows) == met and len(rows) == len(met) and links.columns == edges.columns


def test_containment_rounds_halves_to_even(spark, tmp_path):
    day = lambda hours: datetime.datetime(1970, 1, 1) + datetime.timedelta(hours=hours)
    rows = [(1, 1, day(0), 402.5), (2, 1, day(0), 403.0), (3, 2, day(36), 401.0), (4, 2, day(48), 401.0), (5, 2, day(12), 800.5)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    # spans: 0-2 in 0-3; 2-3 is twice there, the lesser outside; 0-0
    assert {x.sid: x.parent for x in catalog.code_containment(spark, str(tmp_path)).collect()} == {1: 2, 2: None, 3: None, 4: 3, 5: None}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sections_take_few_texts_at_once(spark):
    texts = [(k, t) for k, t in enumerate(["a\n# b\nc", "", None, "# x\r\n## y\nz\n\n", "Title\n=====\né", "```\n# no\n```"])]
    got = split.sections(spark.createDataFrame(texts, "page_id long, md string"), "page_id", "md")
    assert [tuple(x) for x in got.orderBy("page_id", "index").collect()] == [(k, *x) for k, t in texts for x in split.sections_of(t or "")]
    assert _plan(got).count("BatchEvalPython") == 1 and "MapInPandas" not in _plan(got)  # 100 texts, not 10,000; each read once
    rows = split.lines(spark.createDataFrame(texts, "page_id long, md string"), "page_id", "md", 4)
    assert [tuple(x) for x in rows.orderBy("page_id", "index").collect()] == [(k, i, x) for k, t in texts for i, x in enumerate(split._fill(t or "", 4))]
    assert "MapInPandas" not in _plan(rows)


def test_parents_of_sections_run_the_reader_once(spark, tmp_path):
    pages = [(k, f"http://x/{k}", f"<title>t{k}</title><p>b</p>") for k in range(4)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.md_parent(spark, str(tmp_path))
    assert _plan(got).count("BatchEvalPython") == 1 and "MapInPandas" not in _plan(got)
    assert sorted((x["page_id"], x["index"], x["parent"]) for x in got.collect() if x["page_id"] < 2) == [(0, 1, None), (0, 2, 1), (0, 3, 2), (0, 4, 1), (1, 1, None), (1, 2, 1), (1, 3, 1)]


def test_page_markdown_takes_few_pages_at_once(spark, tmp_path):
    pages = [(1, "<h1>A</h1><p>b &amp; <b>c</b></p>"), (2, None), (3, "")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.page_markdown(spark, str(tmp_path))
    assert {x.page_id: x.markdown for x in got.collect()} == {k: files.html_to_markdown(t) for k, t in pages}
    assert "BatchEvalPython" in _plan(got) and "ArrowEvalPython" not in _plan(got)


def test_mime_by_patterns_over_the_text(spark):
    want = {" \n": "text/plain", "abc\n- \n* x": "text/markdown", "- \nlong line": "text/plain", "1. ====>\n\x85": "text/markdown", "é1\n# a": "text/markdown", "éa1\n# a": "text/plain", "x\n  type q": "application/graphql", "x\ntype  ": "text/plain", "abcd\n/* { */": "text/plain", "abcd\n a: b;": "text/css", "a=1\n# b\n[c] ": "text/toml", "a=1\nb": "text/plain", "// x\n  import os ": "text/x-python", "Select 1": "text/sql", "中\n> q": "text/markdown", "😀\n> q": "text/plain"}
    rows = spark.createDataFrame([(t,) for t in [*want, None]], "t string").select("t", split.mime(F.col("t")).alias("m"))
    assert {x.t: x.m for x in rows.collect()} == want | {None: "text/plain"}
    assert "filter(" not in _plan(rows) and "split(" not in _plan(rows)


def test_relations_of_a_name_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(meta, "BLOCK", 10, raising=False)
    monkeypatch.setattr(meta, "TASK_ROWS", 500, raising=False)
    entities = [("hot", k) for k in range(60)] + [(f"s{k}", 1000 + k) for k in range(100)] + [("two", 1), ("two", 1), (None, 7)]
    relations = [(f"s{k}", "r", "hot") for k in range(90)] + [("s1", "r", "hot"), ("s1", "q", "two"), ("two", "q", "s2"), ("s3", "q", "none"), (None, "q", "hot"), ("s4", "q", None)]
    got = meta.relations_to_ids(spark.createDataFrame(relations, "subject string, predicate string, object string").coalesce(1), spark.createDataFrame(entities, "name string, entity_id long"))
    want = sorted((a, b, p) for s, p, o in relations for n, a in entities if n == s and n for m, b in entities if m == o and m)
    per_task = [len(x) for x in got.rdd.glom().collect()]
    assert sorted(tuple(x) for x in got.collect()) == want and got.columns == ["src", "dst", "type"]
    assert sum(per_task) == len(want) and max(per_task) < len(want) / 2  # one task had all of the name
