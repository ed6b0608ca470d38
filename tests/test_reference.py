"""The reference's own operators against expected values."""

import json

import pytest
from pyspark.sql import functions as F

from lakeseek.engine import Engine
from lakeseek.extensions import BatchEmbedder, Hooks, Query, as_json, as_text, summarizer
from lakeseek.functions import text, wordpiece
from lakeseek.operators import code, datum, graph, meta, result, split, vector
from lakeseek.plans import cypher, expansion, view
from lakeseek.sources import files
from lakeseek.streaming.incremental import index_stream, snapshot


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize("raw,masked", [("联系电话13912345678", "联系电话138****1234"), ("卡6222021234567890123", "卡6222****1234"), ("x bob.c@test.com", "x a***@test.com"), ("550e8400-e29b-41d4-a716-446655440000", "550e8400-e29b-41d4-a716-446655440000"), ("440101199001019876", "310***********1234"), ("key " + "Ab1" * 12, "key sk-****xxxx"), ("sk-" + "a" * 33, "sk-" + "a" * 33), ("sk-" + "a" * 40, "sk-****xxxx"), ("13912345678 a@b.co 440101199001019876", "138****1234 a***@b.co 310***********1234")])
def test_desensitize(spark, raw, masked):
    assert one(spark, text.desensitize, raw) == masked


def test_cleaning(spark):
    assert one(spark, text.half_width, "ＡＢ１　！") == "AB1 !"
    assert one(spark, text.clean_noise, "<b>a&nbsp;&amp;</b>\t​x") == "a & x"
    assert one(spark, text.remove_links, "![i](p) [t](u) http://x.y z") == " t  z"
    assert one(spark, text.clean_text, None) is None
    assert one(spark, text.clean_text, "ＡＢ<b>資訊</b> &amp; [t](http://u) Confidential 13912345678 ★") == "AB信息 t 138 1234"
    assert one(spark, text.simplified, "測試 測 軟體 軟 機") == "测试 測 软件 软 机"
    assert one(spark, text.normalize, "A★b\n C") == "a b c"
    assert one(spark, text.repair_json, "```json\n[{“a”：1}{\"b\":2},] tail```") == '[{"a":1},{"b":2}]'
    assert one(spark, text.repair_json, '[{"a":1') == '[{"a":1}]'
    assert one(spark, text.mail_date, "Tue, 5 Mar 2024 10:20:30 +0100 (CET)") == "2024-03-05T09:20:30Z" and one(spark, text.mail_date, "soon") is None
    assert one(spark, lambda c: text.utf16(F.encode(c, "UTF-16LE")), "añ中\0x") == "añ中"


def test_markdown_parents_and_fences(spark):
    md = "pre\n# A\nx\n## B\n```\n# no\n```\n### C\n## D\n# E"
    got = split.markdown(spark.createDataFrame([("d", md), ("n", None)], "k string, t string"), "k", "t").orderBy("index").collect()
    assert [(r.level, r.title) for r in got] == [(0, ""), (1, "A"), (2, "B"), (3, "C"), (2, "D"), (1, "E")]
    assert [r.parent for r in got] == [None, None, 1, 2, 1, None]


@pytest.mark.parametrize("md,heads", [
    ("Title\n=====\nx\n\nSub\n---\ny", [(1, "Title"), (2, "Sub")]),
    ("```\n~~~\n# no\n```\n# yes", [(0, ""), (1, "yes")]),
    ("~~~~\n~~~\n# no\n~~~~\n## A ##", [(0, ""), (2, "A")]),
    ("- item\n---\n\n***\n#no\n###### six", [(0, ""), (6, "six")]),
    ("two\nlines\n--", [(2, "two lines")]),
    ("plain", [(0, "")]),
    ("", []),
])
def test_headings(md, heads):
    got = split.sections_of(md)
    assert [(x[1], x[2]) for x in got] == heads
    data = md.encode()
    assert all(data[x[4] : x[5]].decode().rstrip("\n") == x[3] for x in got)


def test_lines_cover_the_text(spark):
    body = "\n".join("x" * (k % 90) for k in range(200))
    got = split.lines(spark.createDataFrame([(1, body)], "k int, t string"), "k", "t").orderBy("index").collect()
    assert "\n".join(r.content for r in got) == body and all(len(r.content) <= 1500 for r in got) and len(got) > 3


def test_rrf_and_boost(spark):
    s = lambda ids: spark.createDataFrame([(i, 1.0 - k / 10) for k, i in enumerate(ids)], "id string, score double")
    got = result.rrf([(s("abc"), 1.0), (s("bda"), 1.0)], "id").orderBy(F.desc("score")).collect()
    assert len(got) == 4 and got[0].id == "b"
    assert abs(result.rrf([(s("x"), 0)], "id").first().score - 1 / 61) < 1e-6
    df = spark.createDataFrame([(0.48, "机器学习", "并发", [])], "s double, t string, u string, g array<string>")
    assert abs(df.select(result.boost(F.col("s"), ["机器学习", "并发"], F.col("t"), F.col("u"), F.col("g"))).first()[0] - 0.624) < 1e-9


def test_rrf_of_missing_sources(spark):
    s = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.7), (2, "a", 0.1)], "q int, id string, score double")
    got = {(r.q, r.id): r.score for r in result.rrf([(None, 1.0), (s, 2.0)], "id", by=["q"]).collect()}
    assert got == {(1, "b"): round(2 / 61, 9), (1, "a"): round(2 / 62, 9), (2, "a"): round(2 / 61, 9)}
    assert result.rrf([(s.where("false"), 1.0)], "id").count() == 0
    with pytest.raises(ValueError):
        result.rrf([], "id")


def test_minhash_brute_force(spark):
    import random

    import pandas as pd

    r, rows = random.Random(4), []
    for k in range(60):
        base = [f"word{r.randrange(3000)}" for _ in range(40)]
        for _ in range(r.randrange(1, 5)):
            rows.append((len(rows), f"g{k % 3}" if k % 7 else None, " ".join(w if r.random() > 0.04 else "changed" for w in base), r.randrange(5) / 4))
    rows += [(900, "g0", "", 0.5), (901, "g0", None, 0.9)]
    sign = result._signature(pd.Series([t for _, _, t, _ in rows]))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] and (sign[i] == sign[j]).mean() >= 0.85:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    best = {}
    for k, x in zip(root, rows):
        best[k] = min(best.get(k, x), x, key=lambda y: (-y[3], y[0]))
    got = result.minhash_dedup(spark.createDataFrame(rows, "id long, doc string, text string, score double"), "doc", "id")
    assert {x.id for x in got.collect()} == {x[0] for x in best.values()} and len(best) < len(rows) - 20


def test_minhash_dedup(spark):
    long = " ".join(f"word{k}" for k in range(80))
    rows = [(1, "d", long, 0.5), (2, "d", long + " extra", 0.9), (3, "d", "other words entirely here", 0.1), (4, "e", long, 0.2), (5, "e", None, 0.1)]
    got = result.minhash_dedup(spark.createDataFrame(rows, "id long, doc string, text string, score double"), "doc", "id")
    assert {r.id for r in got.collect()} == {2, 3, 4, 5}


def test_graph(spark):
    edges = spark.createDataFrame([("e1", "r", "d", "CONTAINS"), ("e2", "d", "x", "HAS")], "edge_id string, src string, dst string, type string")
    at = spark.createDataFrame([("r",)], "node_id string")
    assert {(r.node_id, r.hops) for r in graph.neighbours(edges, at, 9).collect()} == {("d", 1), ("x", 2)}
    assert graph.neighbours(edges, at, 1).count() == 1


def test_neighbourhood_and_regions(spark):
    nodes = spark.createDataFrame([("d", ["Document"], "d", {}, ["x"]), ("e", ["Entity"], "ent", {"frequency": "5", "confidence": "1"}, [])], "node_id string, labels array<string>, name string, properties map<string,string>, docs array<string>")
    edges = spark.createDataFrame([("1", "d", "e", "HAS")], "edge_id string, src string, dst string, type string")
    roots = spark.createDataFrame([("d", "/Home/user/docs", "A.md")], "node_id string, dir string, file_name string")
    nodes, edges = graph.save_roots(nodes, edges, roots)
    nodes, edges = graph.save_roots(nodes, edges, roots)  # twice is once
    assert nodes.count() == 3 and edges.count() == 2 and nodes.where("node_id = 'd'").first().properties == {"dir": "/home/user/docs", "file_name": "a.md"}
    n, e = graph.explore_region(nodes, edges, "/home/user/docs")
    assert {x.name for x in n.collect()} == {"docs", "d", "ent"} and e.count() == 2
    n, e = graph.explore_file(nodes, edges, "/home/user/docs", "a.md", 1)
    assert n.count() == 3 and e.count() == 2 and graph.explore_file(nodes, edges, "/home/user/docs", "b.md")[0].count() == 0
    assert graph.count_by_region(nodes, "/home/user").first().n == 1 and graph.count_by_region(nodes, "/nowhere").first().n == 0
    assert graph.node(nodes, "e").first().name == "ent" and graph.node(nodes, "zz").count() == 0
    n, e = graph.neighbourhood(nodes, edges, spark.createDataFrame([("d",)], "node_id string"), 0, clamp=False)
    assert n.count() == 0 and e.count() == 0
    n, e = graph.search(nodes, edges, "entity of that name: ent")
    assert {(x.node_id, x.seed): x.score for x in n.collect()} == {("d", True): 0.3, ("e", True): 0.45, (n.where("not seed").first().node_id, False): 0.3} or n.count() >= 2
    q = spark.createDataFrame([(1, "ent"), (2, "nothing here")], "query_id int, word string")
    assert {tuple(x) for x in graph.match_queries(nodes.where("name <> 'd'"), q).collect()} == {(1, "e")}
    chunks = spark.createDataFrame([("k", "t", "x")], "chunk_id string, title string, doc_id string")
    tree = {x.node_id: (x.type, x.depth) for x in graph.document_tree(nodes, edges, chunks).collect()}
    assert tree["k"] == ("Chunk", 2) and tree["d"] == ("Document", 1) and len(tree) == 3
    new = spark.createDataFrame([("e", ["Entity"], "other", {"a": "b"}, [])], nodes.schema)
    assert graph.upsert_nodes(nodes, new).where("node_id = 'e'").first().properties == {"a": "b", "name": "other"}


def test_cypher_surface(spark):
    nodes = spark.createDataFrame([], "node_id string, labels array<string>, name string, properties map<string,string>")
    edges = spark.createDataFrame([], "src string, dst string, type string")
    def do(text, **params):
        nonlocal nodes, edges
        nodes, edges, rows = cypher.execute(nodes, edges, text, params)
        return None if rows is None else [tuple(r) for r in rows.collect()]

    do("CREATE (a:Person {name: 'Ann', age: 30}), (b:Person {name: $name, age: 9})", name="Bob AND Co")
    do("CREATE (c:City {ID: 'rome', name: 'Rome'})")
    do("MATCH (p:Person), (p)-[:NONE]->(x) CREATE (p)-[:IN]->(x)")
    assert do("MATCH (n) RETURN count(n) AS n") == [(3,)]
    do("CREATE (x:Person {ID: 'x', name: 'Xen'})-[:IN]->(y:City {ID: 'paris', name: 'Paris'})")
    assert do("MATCH (c:City)-[r]-(p) RETURN p.name AS p, type(r) AS t") == [("Xen", "IN")]
    assert do("MATCH (p:Person) WHERE p.name = 'Bob AND Co' OR p.age > 25 RETURN p.name AS n ORDER BY p.age") == [("Bob AND Co",), ("Ann",)]
    assert do("MATCH (n:Person) RETURN n.name ORDER BY n.name DESC SKIP 1 LIMIT 1") == [("Bob AND Co",)]
    assert do("MATCH (n:Person) WHERE n.age IN [9, 30] AND NOT n.name STARTS WITH 'A' RETURN DISTINCT labels(n) AS l") == [(["Person"],)]
    assert do("MERGE (n:City {ID: 'rome'})") is None and do("MATCH (n:City) WITH n RETURN count(*) AS n") == [(2,)]
    do("MATCH (n:Person) SET n.updated = true, n.age = 31")
    assert do("MATCH (n:Person) WHERE n.updated = true AND n.age = 31 RETURN count(n) AS n") == [(3,)]
    do("MATCH (n:Person) REMOVE n.updated")
    assert do("MATCH (n:Person) WHERE n.updated IS NULL RETURN count(n) AS n, collect(n.name) AS all")[0][0] == 3
    with pytest.raises(cypher.CypherError):
        do("MATCH (n:Person) DELETE n")
    do("MATCH (n:Person {ID: 'x'}) DETACH DELETE n")
    assert do("MATCH (n) RETURN count(n) AS n") == [(4,)] and edges.count() == 0
    for wrong in ("MATCH (n RETURN n", "MATCH (a)-[*1..2]->(b) RETURN a", "FOO (n)", "MATCH (n) RETURN m", "MATCH (n) WHERE n.a ~ 1 RETURN n", "", "MATCH (a), (b) RETURN a", "MATCH (n) RETURN n.a AS a ORDER BY x.b"):
        with pytest.raises(cypher.CypherError):
            do(wrong)
    with pytest.raises(cypher.CypherError):
        cypher.run(nodes, edges, "MATCH (n) DETACH DELETE n")


def test_cypher_and_view(spark):
    rows = [("1", ["Person"], "Ann", {"age": "30"}), ("2", ["Person"], "Bob", {"age": "7"}), ("3", ["City"], "Rome", {})]
    nodes = spark.createDataFrame(rows, "node_id string, labels array<string>, name string, properties map<string,string>")
    edges = spark.createDataFrame([("1", "3", "IN")], "src string, dst string, type string")
    assert [r.n for r in cypher.run(nodes, edges, "MATCH (p:Person) WHERE p.age >= 8 OR p.name STARTS WITH 'B' RETURN p.name AS n ORDER BY n DESC").collect()] == ["Bob", "Ann"]
    assert cypher.run(nodes, edges, "MATCH (p {name: 'Ann'})-[r:IN]->(c) RETURN c.name AS c").first().c == "Rome"
    with pytest.raises(cypher.CypherError):
        cypher.run(nodes, edges, "CREATE (n)")
    assert view.query(nodes, view.Spec("Person", between={"age": (8, None)}), ["age"]).count() == 1
    with pytest.raises(view.ViewError) as e:
        view.query(nodes, view.Spec("Person", equals={"a b": 1}), ["age"])
    assert e.value.code == 40002


def test_vector_store(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0], "a"), (2, [0.0, 1.0, 0.0], "b"), (3, [0.0, 0.0, 0.0], "b"), (4, None, "b")], "vec_id long, embedding array<float>, key string")
    assert vector.top_k(v, [0.9, 0.1, 0.0], 1).first().vec_id == 1
    assert vector.top_k(v, [0.9, 0.1, 0.0], 1, exact={"key": "b"}).first().vec_id == 2
    new = spark.createDataFrame([(1, [0.0, 0.0, 1.0], "z")], v.schema)
    assert {(r.vec_id, r.key) for r in vector.upsert(v, new, ["vec_id"]).collect()} == {(1, "z"), (2, "b"), (3, "b"), (4, "b")}


def test_changes(spark):
    a = spark.createDataFrame([("x", 1, 0, "h"), ("y", 2, 0, "i")], "path string, size long, mtime long, hash string")
    b = spark.createDataFrame([("y", 2, 0, "j"), ("z", 1, 0, "k")], a.schema)
    assert {(r.path, r.change) for r in meta.changes(a, b, "path").collect()} == {("x", "new"), ("y", "changed"), ("z", "deleted")}


def test_files_engine_and_stream(spark, tmp_path):
    for name, body in {"a.md": "# Title\nSpark plans are lazy here\n## Two\nmore text on joins", "b.csv": "x,y\n1,2,3\n", "c.json": '{"b":1, /* c */ "a":"//"}', "d.pdf": "%PDF", "e.log": "one\n\ntwo\r\n", "f.toml": "k = 1", "g.html": "<title>T</title><h1>H</h1><p>b</p>", "skip.tmp": "x"}.items():
        (tmp_path / name).write_text(body)
    got = {r.file_name.rpartition("/")[2]: r for r in files.scan(spark, str(tmp_path), ["*.tmp"]).collect()}
    assert set(got) == {"a.md", "b.csv", "c.json", "d.pdf", "e.log", "f.toml", "g.html"}
    assert json.loads(got["b.csv"].content) == [{"x": "1", "y": "2", "col_3": "3"}] and got["c.json"].content == '{"a":"//","b":1}'
    assert got["d.pdf"].error and json.loads(got["e.log"].content)[1] == {"line": 3, "text": "two"} and got["g.html"].content == "# H\n\nb"
    e = Engine(spark)
    e.add_folder(str(tmp_path), ["*.tmp"])
    assert e.search("joins", fold=False).first().title == "Two" and e.search_any("lazy|joins", fold=False).count() >= 2
    assert e.search("joins").first().title == "Title"  # the section's parent is a hit too
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").write.parquet(str(src))
    index_stream(spark.readStream.schema("id long, v string").parquet(str(src)), str(tmp_path / "out"), ["id"], str(tmp_path / "cp")).awaitTermination(60)
    assert snapshot(spark, str(tmp_path / "out")).count() == 2


GO = """package main

import "fmt"

// hello prints
// a message
func hello() {
	fmt.Println("hello {")
}

type Person struct {
	Name string
}

func (p *Person) Greet() string {
	return "hi " + p.Name
}

func main() {
	fmt.Println(add(1, 2))
	p := Person{Name: "x"}
	fmt.Println(p.Greet())
}

func add(a, b int) int {
	return a + b
}
"""
PY = 'class Animal:\n    def __init__(self, n):\n        self.speak()\n\n    def speak(self):\n        """Makes a sound."""\n        print("é")\n\ndef greet(n):\n    a = Animal()\n    a.speak()\n\ngreet("w")\n'
JAVA = "package app;\n\nclass Animal {\n    void speak() {}\n}\n\nclass Dog extends Animal {\n    void speak() { if (x) { go(); } }\n}\n\ninterface Flyable {\n    void fly();\n}\n\nclass Bird implements Flyable {\n    public void fly() {}\n}\n"
TS = "class Animal {\n  speak() {}\n}\n\nclass Dog extends Animal {\n  speak() {}\n}\n\ninterface Flyable {\n  fly(): void;\n}\n\nclass Bird implements Flyable {\n  fly() {}\n}\n"


def test_code_chunks_and_graph(spark):
    rows = [("go", "/a/test.go", GO), ("py", "/a/calls.py", PY), ("java", "/a/i.java", JAVA), ("ts", "/a/i.ts", TS), ("bad", "/a/b.py", "def ("), ("n", "/a/n.py", None), ("md", "/a/x.md", "# no")]
    chunks, nodes, edges = code.graph(spark.createDataFrame(rows, "doc_id string, file_name string, content string"))
    c = {(r.doc_id, r.title): r for r in chunks.collect()}
    assert {t for d, t in c if d == "go"} == {"test (header)", "func hello()", "Person struct", "func (p *Person) Greet() string", "func main()", "func add(a, b int) int"}
    assert c["go", "func hello()"].summary == "hello prints a message" and c["py", "def speak(self)"].summary == "Makes a sound."
    assert c["py", "def __init__(self, n)"].visibility == "private" and c["java", "public void fly()"].visibility == "public"
    assert c["bad", "b"].content == "def (" and not any(d in ("n", "md") for d, _ in c)
    assert all(r.content in dict((x[0], x[2]) for x in rows)[r.doc_id] for r in c.values())
    name = {r.node_id: (r.doc_id, r.name) for r in nodes.collect()}
    links = {(name[r.src], r.type, name[r.dst]) for r in edges.collect() if r.type != "CONTAINS"}
    e = lambda d, a, t, b: ((d, a), t, (d, b))
    assert links == {e("go", "Person.Greet", "BELONGS_TO", "Person"), e("go", "main", "CALLS", "add"), e("go", "main", "CALLS", "Person.Greet"), e("py", "Animal.__init__", "CALLS", "Animal.speak"), e("py", "greet", "CALLS", "Animal.speak"), *[x for d in ("java", "ts") for x in (e(d, "Dog", "INHERITS", "Animal"), e(d, "Bird", "IMPLEMENTS", "Flyable"))]}
    contained = {(name[r.src], name[r.dst]) for r in edges.collect() if r.type == "CONTAINS"}
    assert (("py", "Animal"), ("py", "Animal.speak")) in contained and (("go", "test"), ("go", "main")) in contained


def test_data_chunks():
    big = json.dumps({"users": [{"id": k, "bio": "x" * 80} for k in range(30)], "config": {"debug": True}, "count": 2, "name": "é"}, ensure_ascii=False)
    got = datum.split_text(big, "JSON")
    titles = [t for t, *_ in got]
    assert titles == [*[f"JSON.users[{k}]" for k in range(30)], "JSON.config", f"JSON.{datum.REST}"] and len(set(titles)) == len(titles)
    assert all(big.encode()[a:z].decode() == body for t, body, a, z in got if datum.REST not in t)
    assert [t for t, *_ in datum.split_text('{"users":[{"a":1}],"config":{}, "n": 1}', "JSON")] == ["JSON.users", "JSON.config", f"JSON.{datum.REST}"]
    assert [t for t, *_ in datum.split_text('[{"a":1},{"b":2},3]', "JSON")] == ["JSON[0]", "JSON[1]", f"JSON.{datum.REST}"] or [t for t, *_ in datum.split_text('[{"a":1},{"b":2},3]', "JSON")][0].startswith("JSON.[0]")
    assert [t for t, *_ in datum.split_text("a:\n  b: 1\nc: 2\n", "YAML")] == ["YAML.a", f"YAML.{datum.REST}"]
    assert datum.split_text("{broken", "JSON")[0][0] == "JSON 行 0-0" and datum.split_text("", "JSON") == []
    log = "\n".join(f"line {k} " + "y" * 60 for k in range(100))
    parts = datum.split_text(log, "Log")
    assert "\n".join(b for _, b, *_ in parts) == log and all(len(b) <= 1500 for _, b, *_ in parts) and parts[0][0].startswith("Log 行 0-")
    deep = "".join(f'{{"k{k}":' for k in range(8)) + json.dumps(["z" * 1600]) + "}" * 8
    assert len(datum.split_text(deep, "JSON")) == 1 and datum.parent_title("JSON.a.b[0]", "JSON") == "JSON.a.b" and datum.parent_title("JSON.a", "JSON") == "JSON"


def _zip(path, parts):
    import zipfile

    with zipfile.ZipFile(path, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="w" xmlns:r="r"'
    p = lambda text, style="", extra="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}{extra}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    number = lambda n: f'<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{n}"/></w:numPr>'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    _zip(tmp_path / "a.docx", {
        "word/document.xml": f'<w:document {w}><w:body>{p("Head", "Heading2")}{p("one", "", number(1))}{p("two", "", number(1))}{p("dot", "", number(2))}<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:hyperlink r:id="L"><w:r><w:t>site</w:t></w:r></w:hyperlink></w:p><w:tbl><w:tr>{cell("a")}{cell("b")}</w:tr></w:tbl></w:body></w:document>',
        "word/_rels/document.xml.rels": '<R><Relationship Id="L" Target="http://x"/></R>',
        "word/numbering.xml": f'<w:numbering {w}><w:abstractNum w:abstractNumId="7"><w:lvl><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>',
    })
    _zip(tmp_path / "b.xlsx", {"xl/workbook.xml": '<x xmlns="m"><sheets><sheet name="S"/></sheets></x>', "xl/sharedStrings.xml": '<sst xmlns="m"><si><t>h1</t></si><si><t>h3</t></si></sst>', "xl/worksheets/sheet1.xml": '<x xmlns="m"><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="C2"><v>9</v></c></row></x>'})
    _zip(tmp_path / "c.pptx", {"ppt/slides/slide1.xml": '<p xmlns:a="a" xmlns:p="p"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>T</a:t></a:r></a:p></p:sp><p:sp><a:p><a:pPr><a:buChar/></a:pPr><a:r><a:t>x</a:t></a:r></a:p><a:p><a:r><a:t>y</a:t></a:r></a:p></p:sp></p>'})
    got = {r.file_name.rpartition("/")[2]: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert got["a.docx"].content.split("\n\n") == ["## Head", "1. one", "2. two", "- dot", "**bold**[site](http://x)", "|     |     |\n|-----|-----|\n| a   | b   |"]
    assert json.loads(got["b.xlsx"].content) == [{"sheet": "S", "rows": [{"h1": "", "2": "", "h3": "9"}]}]
    assert got["c.pptx"].content.split("\n\n") == ["## Slide 1", "### T", "- x", "y"]


def test_scan_rules_and_opening(spark, tmp_path):
    for name, body in {"keep/a.md": "x", "keep/b.bin": "x", "keep/.indexignore": "# no\nlocal/\n*.log\n", "keep/local/c.md": "x", "keep/d.log": "x", "other/d.log": "x", "other/local/e.md": "x", "store.rag/f.md": "x", "node_modules/g.js": "x", "other/H.PY": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    got = {r.inside for r in files.listing(spark, str(tmp_path), ["node_modules/"]).select("inside").collect()}
    assert got == {"keep/a.md", "other/d.log", "other/local/e.md", "other/H.PY"}
    assert files.open_file(spark, str(tmp_path / "keep/a.md")).first().content == "x"
    for path, error in (("", ValueError), ("a.md", ValueError), (str(tmp_path / "no.md"), FileNotFoundError), (str(tmp_path), IsADirectoryError)):
        with pytest.raises(error):
            files.open_file(spark, path)
    (tmp_path / "s").mkdir()
    (tmp_path / "s/person.json").write_text('{"type": "object"}')
    (tmp_path / "s/bad.json").write_text("[")
    good, bad = files.load_schemas(spark, str(tmp_path / "s"))
    assert good == {"person": {"type": "object"}} and list(bad) == ["bad"]
    mime = lambda h: one(spark, lambda c: split.mime_of_bytes(F.unhex(c)), h)
    assert [mime(h) for h in ("FFD8FF00", "89504E470D", "47494638", "524946460000000057454250", "424D", "00")] == ["image/jpeg", "image/png", "image/gif", "image/webp", "image/bmp", "image/jpeg"]


def test_engine_with_extensions(spark):
    seen = []

    class Watch:
        def chunked(self, chunks):
            return chunks.where("title <> 'drop'")

        def chunks_saved(self, chunks):
            seen.append(chunks.count())
            raise RuntimeError("only logged")

    def refill(chunks):
        return chunks.select("chunk_id", F.lit("spark").alias("name"), F.lit("Tool").alias("type")).unionAll(chunks.select("chunk_id", F.lit("lake"), F.lit("Place"))), chunks.select("chunk_id", F.lit("spark").alias("subject"), F.lit("READS").alias("predicate"), F.lit("lake").alias("object"))

    long = "spark reads the lake of tables " * 10
    e = Engine(spark, summarize=summarizer(lambda texts: [("Made", "short words on spark")] * len(texts)), refill=refill, hooks=Hooks.of(Watch()))
    docs = [("1", "/Lib/a.md", f"# Alpha\n{long}\n# drop\ngone"), ("2", "/lib/sub/b.py", PY), ("3", "/lib/c.json", '{"users":[{"id":1}],"n":"a text of some length"}'), ("4", "/lib/tiny.md", "short")]
    e.add(spark.createDataFrame(docs, "doc_id string, file_name string, content string"))
    assert seen == [e.chunks.count()] and {r.content_type for r in e.chunks.collect()} == {"Document", "Code", "DataFile"}
    assert e.search("spark lake").first().title == "Made" and e.search(Query("spark", filters={"language": "python"})).where("title = 'Made'").count() == 0
    assert e.search("speak", folder="/lib/sub", rerank=True, dedup=True).count() > 0
    hit = e.hyper_search("spark")
    assert hit["chunks"].first().title == "Made" and {r.node_id for r in hit["nodes"].collect()} >= {r.node_id for r in e.nodes.where("name in ('spark', 'lake')").collect()} and hit["edges"].count() >= 1
    assert e.count_by_region("/lib").first().n == 3 and e.tree().where("depth = 2").count() == e.chunks.count()
    assert e.explore_file("/lib/sub/b.py")[0].count() >= 2
    before = e.vectors.count()
    e.refill_dimensions()
    assert e.vectors.count() == before
    e.add(spark.createDataFrame([("2", "/lib/sub/b.py", "x = 1  # nothing but a line")], "doc_id string, file_name string, content string"))
    assert e.chunks.where("doc_id = '2'").count() == 1
    e.remove("1")
    assert e.chunks.where("doc_id = '1'").count() == 0 and e.nodes.where("name = 'spark'").count() == 0 and e.vectors.join(e.chunks, "chunk_id", "left_anti").count() == 0
    assert json.loads(as_json(e.status()).first().json)["documents"] == 2 and "documents" in as_text(e.status())
    e.write_graph("CREATE (n:Note {ID: 'n1', name: 'hand made'})")
    assert e.query_graph("MATCH (n:Note) RETURN n.name AS n").first().n == "hand made"
    e.clear()
    assert e.chunks is None and e.nodes.count() == 0


def test_batch_embedder(spark):
    import numpy as np

    embed = BatchEmbedder(2, lambda: lambda texts: np.array([[len(t), 1] for t in texts]), batch=2)
    got = spark.createDataFrame([("a",), ("bcd",), (None,)], "t string").select(embed(F.col("t")).alias("v")).collect()
    assert [list(r.v) for r in got] == [[1, 1], [3, 1], [0, 1]]


def test_metadata_and_vectors(spark):
    rows = spark.createDataFrame([("a", {"x": "1"}), ("b", None)], "chunk_id string, metadata map<string,string>")
    patch = spark.createDataFrame([("a", {"x": "2", "y": "3"}), ("b", {"z": "1"})], "chunk_id string, patch map<string,string>")
    assert {r.chunk_id: r.metadata for r in vector.patch_metadata(rows, patch).collect()} == {"a": {"x": "2", "y": "3"}, "b": {"z": "1"}}
    with pytest.raises(KeyError):
        vector.patch_metadata(rows.where("false"), patch)
    with pytest.raises(KeyError):
        vector.delete_some(rows, patch.where("false"), "chunk_id")
    s = spark.createDataFrame([(None, "pending"), ("pending", "indexed"), ("indexing", "failed"), ("indexed", "partial_deleted")], "a string, b string")
    assert [r[0] for r in s.select(meta.may_follow(F.col("a"), F.col("b"))).collect()] == [True, False, True, True]
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0])], "query_id int, query array<double>")
    v = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 1.0]), (9, None)], "vec_id int, embedding array<double>")
    got = {(r.query_id, r.vec_id): (r.score, r.rank) for r in vector.batch_top_k(q, v, 2, most=1).collect()}
    assert got[1, 7] == (1.0, 1) and got[1, 8] == (0.0, 2) and got[2, 7] == (0.0, 1) and got[3, 8] == (0.0, 2) and len(got) == 6


def test_stream_rewrites_touched_buckets(spark, tmp_path):
    schema, src = "id long, v string", tmp_path / "in"
    for k, rows in enumerate([[(1, "a"), (2, "b"), (2, "c")], [(2, "d"), (3, "e")], [(9, "z")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        index_stream(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "out"), ["id"], str(tmp_path / "cp"), buckets=4).awaitTermination(120)
    assert {tuple(r) for r in snapshot(spark, str(tmp_path / "out")).collect()} == {(1, "a"), (2, "d"), (3, "e"), (9, "z")}
    assert {tuple(r) for r in snapshot(spark, str(tmp_path / "out"), 0).collect()} == {(1, "a"), (2, "c")}


def test_wordpiece(spark):
    vocabulary = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "runn", "##ing", "中", "国", "!", "cafe"]
    assert wordpiece.basic("Café中国, a\u0000b!") == ["cafe", "中", "国", ",", "ab", "!"]
    table = {w: k for k, w in enumerate(vocabulary)}
    assert wordpiece.pieces("unaffable", table) == ["un", "##aff", "##able"] and wordpiece.pieces("unknown", table) == ["[UNK]"]
    got = spark.createDataFrame([("Unaffable running Café!",), (None,)], "t string").select(wordpiece.encode_column(F.col("t"), vocabulary, 10).alias("e")).collect()
    assert got[0].e.ids == [2, 4, 5, 6, 7, 8, 12, 11, 3, 0] and got[0].e.mask == [1] * 9 + [0] and got[1].e.ids == [2, 3] + [0] * 8
    assert wordpiece.encode("running " * 50, table, 8)[0][-1] == 3


def test_expansion():
    assert expansion.wordings("a b", lambda p: "1. b a\n- a b\n\nc", 3) == ["a b", "b a", "c"]

    def fails(prompt):
        raise RuntimeError

    assert expansion.wordings("q", fails) == ["q"] and expansion.rewrite("q", fails) == "q" and expansion.made_answer("q", lambda p: "an answer") == "an answer"
    answers, waits = ["nothing", "MATCH (n) DELETE n", "```cypher\nMATCH (n) RETURN n\n```"], []
    assert expansion.to_cypher("?", "", lambda p: answers.pop(0), sleep=waits.append) == "MATCH (n) RETURN n" and waits == [2, 4]
    with pytest.raises(cypher.CypherError):
        expansion.to_cypher("?", "", lambda p: "no", sleep=waits.append)
