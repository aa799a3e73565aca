import json
from datetime import datetime

from pyspark.sql import functions as F

from codeloom import schema
from codeloom.functions import names, paths
from codeloom.operators import graph, ingest, language, metrics, mutate, patterns, rules, search, semantic, traverse
from codeloom.plans.queries import QUERIES
from codeloom.sources import files as source_files

AT = datetime(2025, 1, 1)


def node(uuid, name="n", type="function", path="src/a.py", start=1, end=2, doc=None, tags=None, repo="r", at=AT):  # noqa: A002
    return (uuid, repo, path, type, name, start, end, doc, tags or [], None, "system", at, False, [])


def edge(uuid, a, b, type="calls", at=AT):  # noqa: A002
    return (uuid, a, b, type, None, "system", at, False, [])


def nodes_of(spark, *rows):
    return graph.entities(spark.createDataFrame(list(rows), schema.NODES))


def links_of(spark, *rows):
    return graph.relations(spark.createDataFrame(list(rows), schema.EDGES))


def files_of(spark, *rows):
    return spark.createDataFrame([("r", p, c, None, None) for p, c in rows], schema.FILES)


def test_entities_and_relations_keep_the_last(spark):
    later = datetime(2025, 2, 1)
    n = nodes_of(spark, node("A", "old"), node(" {a} ", "new", path=".\\b\\c.py", at=later))
    assert [(r.uuid, r.name, r.file_path) for r in n.collect()] == [("a", "new", "b/c.py")]
    e = links_of(spark, edge("1", "a", "b"), edge("2", "A", "{B}", "uses", later), edge("3", None, "b"))
    assert [(r.src, r.dst, r.type) for r in e.collect()] == [("a", "b", "uses")]


def test_degrees_with_self_loops_and_isolated(spark):
    n, e = nodes_of(spark, node("a"), node("b"), node("c")), links_of(spark, edge("1", "a", "a"), edge("2", "a", "b"))
    got = {r.uuid: (r.n_out, r.n_in, r.degree) for r in graph.degrees(n, e).collect()}
    assert got == {"a": (2, 1, 3), "b": (0, 1, 1), "c": (0, 0, 0)}
    sizes = metrics.sizes(n, e).first()
    assert (sizes.n_nodes, sizes.n_edges, sizes.max_degree) == (3, 2, 3) and abs(sizes.density - 2 / 6) < 1e-12


def test_empty_graph_metrics(spark):
    n, e = nodes_of(spark), links_of(spark)
    for f in (metrics.sizes, metrics.complexity_histogram, metrics.quality_scores, metrics.fan_issues, metrics.most_connected):
        assert f(n, e).count() == 0


def test_members_take_the_innermost_class(spark):
    n = nodes_of(spark, node("o", "Outer", "class", start=1, end=600), node("i", "Inner", "class", start=300, end=400), node("f", "f", start=310, end=320), node("g", "g", start=500, end=510))
    assert {r.uuid: r.class_name for r in metrics.containing_class(n).collect()} == {"f": "Inner", "g": "Outer"}


def test_impact(spark):
    n = nodes_of(spark, *[node(x) for x in "abcd"])
    e = links_of(spark, edge("1", "b", "a"), edge("2", "c", "b", "imports"), edge("3", "d", "b", "contains"))
    targets = spark.createDataFrame([("a",), ("zz",)], "target string")
    got = {r.target: (r.direct, r.transitive, r.affected, r.score, r.risk) for r in metrics.impact(e, n, targets).collect()}
    assert got == {"a": (1, 1, 2, 4, "low"), "zz": (0, 0, 0, 0, "low")}


def test_paths(spark):
    df = spark.createDataFrame([("a/b/.env",), ("x.tar.GZ",), ("noend",), (None,)], "p string")
    assert [r[0] for r in df.select(paths.ending("p")).collect()] == ["", ".gz", "", None]
    assert df.select(paths.depth("p")).first()[0] == 2


def test_fuzzy_scores(spark):
    n = nodes_of(spark, *[node(f"u{i}", x) for i, x in enumerate(["load", "loader", "my_load_x", "laod", "zzz"])])
    got = {r.name: round(r.score, 4) for r in search.fuzzy(n, "LOAD").collect()}
    assert got["load"] == 1.0 and got["loader"] == 0.9 and got["my_load_x"] == 0.7 and "zzz" not in got
    assert got["laod"] == 0.375  # ratio .75, halved


def test_pages_concatenate_to_the_whole(spark):
    n = nodes_of(spark, *[node(f"u{i:02d}") for i in range(25)])
    pages = [search.page(n.select("uuid"), ["uuid"], 10, o).collect() for o in (0, 10, 20, 30)]
    assert [r.uuid for p in pages for r in p] == [f"u{i:02d}" for i in range(25)] and {r.total for p in pages for r in p} == {25}


def test_probable_names(spark):
    n = nodes_of(spark, node("a", "load", path="src/io.py"), node("b", "load", path="web/x.js"), node("c", "save", path="src/io.py"))
    asked = spark.createDataFrame([("io.py:load",), ("save",), ("nothing_like_it",)], "request string")
    assert {tuple(r) for r in search.probable(n, asked).collect()} == {("io.py:load", "a"), ("save", "c")}


def test_call_tree_caps_children_and_avoids_cycles(spark):
    e = links_of(spark, *[edge(f"x{i}", "a", f"c{i}") for i in range(7)], edge("y", "c0", "a"), edge("z", "c1", "d", "uses"))
    roots = spark.createDataFrame([("a",)], "root string")
    rows = traverse.call_tree(e, roots, 3).collect()
    assert sorted(r.uuid for r in rows if r.depth == 1) == ["c0", "c1", "c2", "c3", "c4"]
    assert [r.uuid for r in rows if r.depth == 2] == ["d"]
    assert [r.uuid for r in traverse.call_tree(e, roots, 3, direction="both").collect()] == ["a"]


def test_reach_and_induced(spark):
    e = links_of(spark, edge("1", "a", "b"), edge("2", "b", "c"), edge("3", "c", "a"), edge("4", "c", "d"))
    root = spark.createDataFrame([("a",)], "uuid string")
    ids, links = traverse.subgraph(e, root, 2)
    assert {tuple(r) for r in ids.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r.src, r.dst) for r in links.collect()} == {("a", "b"), ("b", "c"), ("c", "a")}
    raw = spark.createDataFrame([edge("1", "A", "b"), edge("2", "b", "{c}"), edge("3", "c", "a"), edge("4", "c", "d")], schema.EDGES)
    ids, links = traverse.subgraph(lambda near, end: graph.relations_at(raw, near, end), root, 2)
    assert {tuple(r) for r in ids.collect()} == {("a", 0), ("b", 1), ("c", 2)} and links.count() == 3


def test_snippets_with_crlf_and_out_of_range(spark):
    f = files_of(spark, ("src/a.py", "import os\r\ndef f(\r\n  x):\r\n  return x\r\nend"), ("src/b.py", None))
    n = nodes_of(spark, node("a", start=2, end=4), node("b", start=50, end=60), node("c", path="src/b.py"))
    rows = {r.uuid: r for r in traverse.snippets(n, f, 1).collect()}
    assert set(rows) == {"a"}
    assert rows["a"].code == "def f(\n  x):\n  return x" and rows["a"].before == "import os" and rows["a"].after == "end" and rows["a"].signature == "def f( x):"


def test_detection(spark):
    f = files_of(spark, ("a.py", "import os\n\ndef f(x):\n    print(x)\n"), ("b.js", "function f(a) { console.log(a); }\nconst g = (x) => x;"), ("c", ""), ("d.py", None))
    got = {r.file_path: (r.language, r.confidence, r.method) for r in language.detect(f).collect()}
    assert got["a.py"][0] == "python" and got["a.py"][1] > 0.5 and got["b.js"][0] == "javascript" and got["b.js"][1] > 0.4
    assert got["c"] == ("unknown", 0.0, "none") and got["d.py"] == ("python", 0.9, "extension")


def test_rules(spark):
    text = "def f(a):\n    try:\n        x = []\n        for y in a:\n            x.append(y)\n    except:\n        pass  # TODO: later\n" + "z = '" + "q" * 130 + "'\npassword = 'abcdefgh1'\n"
    f = files_of(spark, ("a.py", text), ("b.js", "var a = 1\n"), ("c.py", None))
    got = {(r.rule_id, r.file_path, r.line) for r in rules.matches(f).collect()}
    assert {("python_bare_except", "a.py", 6), ("todo_comments", "a.py", 7), ("long_lines", "a.py", 8), ("hardcoded_secret", "a.py", 9), ("js_var_usage", "b.js", 1)} <= got
    whole = {(r.rule_id, r.line) for r in rules.matches(f).collect()}
    assert {("semantic_missing_docstring", 1), ("semantic_list_comprehension", 3), ("python_missing_docstring", 1)} <= whole
    own = rules.Rule("own", "semantic", "info", ("*",), "", matcher=lambda t: 1 / 0)
    assert rules.matches(f, [own]).count() == 0
    off = rules.with_enabled(rules.RULES, ["long_lines"], False)
    assert "long_lines" not in {r.id for r in rules.chosen(off)} and [r.id for r in rules.chosen(rules.RULES, severity="error")] == ["hardcoded_secret"]


SINGLE = "class Pool:\n    _instance = None\n    def get_instance(self):\n        return Pool()\n"


def test_patterns(spark):
    f = files_of(spark, ("src/a.py", SINGLE + "def make_it(a, b, c, d, e, f):\n    return Thing(a)\n"), ("b.js", "const { a } = x.map((y) => y);\n"))
    n = nodes_of(spark, node("p", "Pool", "class", start=1, end=4), node("m", "make_it", start=5, end=6))
    got = {(r.pattern, r.uuid) for r in patterns.entity_patterns(patterns.with_code(n, f)).collect()}
    assert got == {("singleton", "p"), ("factory", "m"), ("long_parameter_list", "m")}
    assert {(r.pattern, r.file_path) for r in patterns.idioms(f).collect()} == {("arrow_function", "b.js"), ("destructuring", "b.js")}
    block = "\n".join(f"line {i}" for i in range(5))
    again = files_of(spark, ("a.py", f"{block}\nother\n{block}\nend"), ("b.py", block))
    assert [(r.file_path, r.line) for r in patterns.duplicate_blocks(again).collect()] == [("a.py", 1)]
    near = files_of(spark, ("c.py", "\n".join("xy"[i % 2] for i in range(12))), ("d.py", "\n" * 30), ("e.py", None))
    assert [(r.file_path, r.line) for r in patterns.duplicate_blocks(near).collect()] == [("c.py", 1)]


def test_roles_of_a_file(spark):
    text = "class Shape:\n    def set_strategy(self, s): self.strategy = s\nclass AreaPolicy:\n    def apply(self): pass\nclass UserData:\n    pass\nclass UserTemplate:\n    pass\nclass UserAction:\n    pass\n"
    f = files_of(spark, ("src/a.py", text))
    n = nodes_of(spark, node("s", "Shape", "class", start=1, end=2), node("p", "AreaPolicy", "class", start=3, end=4), *[node(x, c, "class", start=k, end=k + 1) for x, c, k in (("d", "UserData", 5), ("t", "UserTemplate", 7), ("c", "UserAction", 9))])
    rows = {r.pattern: (r.start_line, r.end_line, r.entities, r.evidence) for r in patterns.file_patterns(n, patterns.with_code(n, f)).collect()}
    assert rows == {"strategy": (1, 4, 2, "context:1,strategy:1"), "mvc": (5, 10, 3, "controller:1,model:1,view:1")}
    assert {(r.pattern, r.role, r.uuid) for r in patterns.pattern_members(n, patterns.with_code(n, f)).collect()} == {("strategy", "context", "s"), ("strategy", "strategy", "p"), ("mvc", "model", "d"), ("mvc", "view", "t"), ("mvc", "controller", "c")}


PY = '''"""Tools."""
import os
from pkg.mod import thing as t

class Base:
    pass

class Job(Base):
    """A job."""
    def run(self, x):
        self.check(x)
        return helper(x)

async def helper(x):
    print(x)
    t(x)
    return os.path.join(x)
'''


def test_parsing_and_resolution(spark):
    f = files_of(spark, ("pkg/main.py", PY), ("pkg/mod.py", "def thing(x):\n    return x\n"), ("bad.py", "def ("), ("web.js", "class A extends B {\n  go(x) {\n  }\n}\nconst f = (y) => y;\nif (x) {\n}\n"))
    parsed = ingest.parse(f)
    e = ingest.parsed_entities(parsed)
    rows = {(r.file_path, r.type, r.name) for r in e.collect()}
    assert {("pkg/main.py", "class", "Job"), ("pkg/main.py", "function", "run"), ("pkg/main.py", "module", "pkg.main"), ("pkg/main.py", "import", "pkg.mod.thing"), ("web.js", "class", "A"), ("web.js", "function", "f")} <= rows
    assert not any(p == "bad.py" for p, _, _ in rows) and ("web.js", "function", "if") not in rows
    ids = {r.name: r.uuid for r in e.where("type in ('function', 'class')").collect()}
    assert {(r.src, r.dst) for r in ingest.local_links(parsed, e).collect()} == {(ids["run"], ids["helper"])}
    links = {(r.src, r.dst) for r in ingest.resolve_calls(parsed, e).collect()}
    assert (ids["run"], ids["helper"]) in links
    assert {(r.src, r.dst) for r in ingest.inheritance_links(parsed, e).collect()} == {(ids["Job"], ids["Base"])}
    tagged = {(r.file_path, r.tag, r.name) for r in ingest.tags(parsed).collect()}
    assert {("pkg/main.py", "definition.class", "Job"), ("pkg/main.py", "definition.function", "run"), ("pkg/main.py", "reference.call", "check"), ("web.js", "definition.method", "go"), ("web.js", "definition.function", "f")} <= tagged
    calls = {r.name: r.calls for r in ingest.call_counts(parsed).collect()}
    assert calls["helper"] == 1 and "print" not in calls
    ranked = ingest.ranked(e, ingest.local_links(parsed, e), ingest.call_counts(parsed))
    assert abs(ranked.agg(F.max("importance")).first()[0] - 1.0) < 1e-9
    tags = {r.name: r.tags for r in e.collect()}
    assert "ASYNC" in tags["helper"] and "UTILITY" in tags["helper"]
    made = ingest.counters(parsed, f, ingest.resolve_calls(parsed, e)).first()
    assert made.files == 4 and made.errors == 1 and made.edges == len(links)
    rows = {(r.name, r.context) for r in parsed.where("kind = 'contains'").collect()}
    assert rows == {("run", "class"), ("helper", "module"), ("thing", "module")}
    details = {r.name: json.loads(r.metadata) for r in e.where("metadata is not null").collect()}
    assert details["helper"] == {"is_async": True, "parameters": ["x"]} and details["Job"] == {"base_classes": ["Base"]}
    out = ingest.ranked_links(ingest.resolve_calls(parsed, e), ranked).collect()
    assert out and all(json.loads(r.properties)["callee_rank"] > 0 and json.loads(r.properties)["cross_file"] for r in out)


def test_semantic_entities(spark):
    text = "@app.get('/x')\nasync def view_helper(a):\n    pass\n\nLIMIT = 5\nname = open('x')\nROUTES = {'go': view_helper, 'n': 1}\nclass UserModel(Base):\n    def __init__(self):\n        self.db = Store()\n"
    f = files_of(spark, ("src/a.py", text))
    got = {(r.pattern, r.name, r.line) for r in semantic.pattern_entities(f).collect()}
    assert {("fastapi_endpoint", "get", 1), ("decorator", "app", 1), ("constants", "LIMIT", 5), ("model_class", "User", 8), ("utility_function", "view_helper", 2)} <= got
    assert {(r.name, r.type) for r in semantic.variables(f).collect()} == {("LIMIT", "constant"), ("name", "variable"), ("ROUTES", "constant")}
    assert [(r.holder, r.key, r.function) for r in semantic.handlers(f).collect()] == [("ROUTES", "n", "1")]
    assert {(r.relation, r.source, r.target) for r in semantic.text_relations(f).collect()} == {("inherits", "UserModel", "Base"), ("composes", "db", "Store")}
    n = nodes_of(spark, node("v", "view_helper", start=2, end=3), node("t", "test_view_helper", start=20, end=21), node("l", "LIMIT", "variable", start=5, end=5), node("w", "view", start=40, end=41))
    assert [(r.decorator, r.uuid, r.external) for r in semantic.decorated(f, n).collect()] == [("app", "v", True)]
    assert {(r.test, r.subject) for r in semantic.tested(n).collect()} == {("t", "w")}
    assert {(r.base, r.name, r.type) for r in semantic.contextual(n, f).collect()} >= {("v", "util_view_helper", "utility"), ("v", "api_view_helper", "endpoint")}
    every = semantic.extracted(n, f).collect()
    assert len({r.uuid for r in every}) == len(every)
    found = {(r.type, r.name): r for r in every}
    assert {("endpoint", "get"), ("constant", "LIMIT"), ("variable", "name"), ("handler", "ROUTES[n]"), ("endpoint", "api_view_helper"), ("model", "User")} <= set(found)
    assert found["handler", "ROUTES[n]"].tags == ["HANDLER", "MAPPING"] and json.loads(found["variable", "name"].metadata)["value"] == "open('x')"


def test_mutations(spark):
    nodes = spark.createDataFrame([node("a"), node("b")], schema.NODES)
    edges = spark.createDataFrame([edge("1", "a", "b"), edge("2", "b", "b")], schema.EDGES)
    new, log = mutate.update(nodes, "a", {"name": "x", "docstring": None, "tags": ["T"], "nope": 1}, "me", AT)
    row = new.where("uuid = 'a'").first()
    assert row.name == "x" and row.tags == ["T"] and len(row.history) == 1 and json.loads(log.first().details) == {"name": "x", "docstring": None, "tags": ["T"]}
    assert mutate.update(nodes, "zz", {"name": "x"}, "me", AT)[1].count() == 0
    left, links, log = mutate.delete(nodes, edges, spark.createDataFrame([("b",), ("zz",)], "uuid string"), "me", AT)
    assert [r.uuid for r in left.collect()] == ["a"] and links.count() == 0 and [r.entity_uuid for r in log.collect()] == ["b"]
    made, log = mutate.create(nodes, spark.createDataFrame([("c", "r", "made")], "uuid string, repo_id string, name string"), "me", AT)
    assert made.count() == 3 and made.where("uuid = 'c'").first().manual and log.first().action == "create_entity"
    want = spark.createDataFrame([("9", "a", "b", "uses"), ("8", "a", "zz", "uses")], "uuid string, from_uuid string, to_uuid string, type string")
    out, rejected, _ = mutate.relate(nodes, edges, want, "me", AT)
    assert {(r.from_uuid, r.to_uuid, r.type) for r in out.collect()} == {("a", "b", "uses"), ("b", "b", "calls")} and [r.to_uuid for r in rejected.collect()] == ["zz"]


def test_name_expressions(spark):
    df = spark.createDataFrame([("test_api", "function"), ("_x", "function"), ("BadError", "class")], "name string, type string")
    tags = [r[0] for r in df.select(names.auto_tags(F.col("name"), F.col("type"))).collect()]
    assert tags == [["FUNCTION", "API", "TEST", "TEST"], ["FUNCTION", "PRIVATE"], ["CLASS", "EXCEPTION", "EXCEPTION"]]


def test_relations_of_text(spark):
    text = "@app.route('/go')\ndef go(a):\n    return a\n\nclass Job(Base):\n    def __init__(self):\n        self.db = Store()\n\nTABLE = {\n    'go': go,\n}\n\ndef test_go(x):\n    assert go(x)\n"
    f = files_of(spark, ("src/a.py", text), ("src/b.py", None), ("src/c.py", ""))
    n = nodes_of(spark, node("g", "go", start=2, end=3), node("j", "Job", "class", start=5, end=7), node("t", "test_go", start=13, end=14), node("c", "TABLE", "variable", start=9, end=11))
    assert [(r.endpoint, r.uuid) for r in semantic.served(f, n).collect()] == [("/go", "g")]
    assert [(r.key, r.source, r.target) for r in semantic.handled(f, n).collect()] == [("go", "c", "g")]
    assert [(r.test, r.subject) for r in semantic.tested_by_calls(n, f).collect()] == [("t", "g")]
    got = {(r.relation, r.source, r.target, r.external) for r in semantic.relations(f, n).collect()}
    assert got == {
        ("inherits", "j", "external:Base", True), ("decorates", "external:app", "g", True), ("handles", "c", "g", False), ("handles", "/go", "g", False), ("tests", "t", "g", False),
    }
    assert semantic.relations(f.limit(0), n).where("relation <> 'tests'").count() == 0


def test_entity_at_takes_the_tightest(spark):
    n = nodes_of(spark, node("o", "Outer", "class", start=1, end=500), node("i", "inner", start=200, end=210), node("x", "nolines", start=None, end=None))
    places = spark.createDataFrame([("r", "src/a.py", 205), ("r", "src/a.py", 300), ("r", "src/a.py", 999)], "repo_id string, file_path string, line int")
    assert {(r.line, r.uuid) for r in traverse.entity_at(n, places).collect()} == {(205, "i"), (300, "o")}


def test_context_of_unknown_and_isolated_entities(spark):
    n, e = nodes_of(spark, node("a"), node("b")), links_of(spark, edge("1", "a", "a"))
    ids = spark.createDataFrame([("a",), ("b",), ("zz",)], "uuid string")
    rows = {r.uuid: (r.code, r.neighbours, r.n_links) for r in traverse.context(n, e, files_of(spark), ids).collect()}
    assert rows == {"a": (None, ["a"], 2), "b": (None, [], 0)}


def test_entity_at_line_finds_short_entities(spark, tmp_path):
    """An entity between two of the lines 1, 11, 21."""
    spark.createDataFrame([("u", "r", "f.py", "function", "g", 3, 5, None, None, None, None, None, False)], "uuid string, repo_id string, file_path string, type string, name string, start_line int, end_line int, docstring string, tags array<string>, metadata string, created_by string, created_at timestamp, manual boolean").write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame([("r", "f.py", "x\n" * 20)], "repo_id string, file_path string, content string").write.parquet(f"{tmp_path}/source_files.parquet")
    rows = QUERIES["entity_at_line"](spark, str(tmp_path)).collect()
    assert sorted((r.line, r.uuid) for r in rows) == [(3, "u"), (4, "u"), (5, "u")]


def test_every_match_of_a_line_has_its_row(spark, tmp_path):
    files_of(spark, ("a.js", "var a; var b\nvar c"), ("b.py", "token = 'abcdefgh1'; secret = 'abcdefgh2'\n"), ("c.py", "class A(B): pass; self.x = Y(); self.z = W()\nclass C(\n    D): pass\n")).write.parquet(f"{tmp_path}/source_files.parquet")
    got = lambda name: [(r.line, r["column"]) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got("rule_var")) == [(1, 1), (1, 8), (2, 1)]
    assert len(got("rule_secrets")) == 2
    rows = QUERIES["text_relations"](spark, str(tmp_path)).collect()
    assert sorted((r.line, r.source, r.target) for r in rows) == [(1, "A", "B"), (1, "x", "Y"), (1, "z", "W"), (2, "C", "D")]
    f = files_of(spark, ("d.py", "@app.get('/a') @app.get('/b')\ndef f(): pass\n"))
    assert sorted((r.pattern, r.metadata) for r in semantic.pattern_entities(f).where("type = 'endpoint'").collect()) == [("fastapi_endpoint", "/a"), ("fastapi_endpoint", "/b")]
    n = nodes_of(spark, node("u", name="f", path="d.py"))
    assert {r.endpoint for r in semantic.served(f, n).collect()} == {"/a", "/b"}


def key_table(entities):
    """The keys of entities and their order, registered one by one."""
    keys = {}
    for e in sorted(entities, key=lambda r: (r.file_path, r.ordinal)):
        module = e.file_path.replace(".py", "").replace("/", ".")
        own = [f"{e.file_path}:{e.name}", e.name]
        if e.type in ("class", "function"):
            own.append(f"{module}.{e.name}")
        if e.type == "function" and e.context != "module":
            own += [f"{e.context}.{e.name}", f"{module}.{e.context}.{e.name}"]
        for k in dict.fromkeys(own):
            keys[k] = e
    return keys


def brute_resolve(parsed, entities):
    """Every call against every key, tier after tier."""
    keys, out = key_table(entities), set()
    brought = {(r.file_path, r.name): r.extra for r in sorted((r for r in parsed if r.kind == "import"), key=lambda r: r.ordinal)}
    for c in (r for r in parsed if r.kind == "call"):
        module = c.file_path.replace(".py", "").replace("/", ".")
        near = [e for e in sorted(entities, key=lambda r: r.ordinal) if e.file_path == c.file_path and e.name == c.context]
        inside = keys.get(c.context)
        tried = [keys.get(f"{c.file_path}:{c.context}"), inside if inside and inside.file_path == c.file_path else None, keys.get(f"{module}.{c.context}"), *near[:1], keys.get(f"{c.file_path}:{module}"), keys.get(module)]
        src = next((e for e in tried if e), None)
        dst = keys.get(c.name) or (keys.get(c.name.split(".")[-1]) if "." in c.name else None)
        if dst is None:
            scored = [(100 if "." in c.name and k.endswith(c.name) else 80 if k.endswith("." + c.name) else 60 if c.name in e.name else 40, e) for k, e in keys.items() if c.name in k]
            dst = max(scored, key=lambda x: x[0])[1] if scored else None
        if dst is None:
            first, _, rest = c.name.partition(".")
            full = brought.get((c.file_path, first))
            dst = keys.get(full + ("." + rest if rest else "")) if full else None
        if src and dst and src.uuid != dst.uuid:
            out.add((src.uuid, dst.uuid))
    return out


def test_calls_resolve_as_by_brute_force(spark):
    """All tiers: exact, last segment, ending, contained, through imports; callers within classes and modules."""
    f = files_of(
        spark,
        ("pkg/a.py", "import pkg.tools as tk\nfrom lib.deep import load_rows as lr\n\nclass Box:\n    size = compute(1)\n    def open(self):\n        self.shut()\n        rows(1)\n        tk.pack(self)\n        lr(2)\n\nBox()\nz = ab.cd(1)\n"),
        ("pkg/tools.py", "def pack(x):\n    return unpack_all(x)\n\ndef unpack_all(x):\n    def inner(y):\n        return pack(y)\n    return all_un(x)\n"),
        ("lib/deep.py", "class Store:\n    def shut(self):\n        return load_rows()\n\ndef load_rows():\n    return [xab.cdx(), ows(), q()]\n"),
        ("xab.cd/e.py", "def lonely():\n    return Store.shut(1)\n"),
    )
    parsed = ingest.parse(f)
    entities = ingest.parsed_entities(parsed)
    got = {(r.src, r.dst) for r in ingest.resolve_calls(parsed, entities).collect()}
    assert got == brute_resolve(parsed.collect(), entities.collect()) and len(got) > 8


def test_bases_come_from_the_file_first(spark):
    f = files_of(spark, ("a.py", "class Base: pass\nclass A(Base): pass\nclass Self(Self): pass\n"), ("b.py", "class Base: pass\nclass B(Base): pass\n"), ("c.py", "class C(Base): pass\nclass Self(Self): pass\nclass D(Nowhere): pass\n"))
    e = ingest.parsed_entities(ingest.parse(f))
    by = {r.uuid: (r.file_path, r.name) for r in e.collect()}
    got = {(by[r.src], by[r.dst]) for r in ingest.inheritance_links(ingest.parse(f), e).collect()}
    assert got == {(("a.py", "A"), ("a.py", "Base")), (("b.py", "B"), ("b.py", "Base")), (("c.py", "C"), ("a.py", "Base")), (("a.py", "Self"), ("c.py", "Self")), (("c.py", "Self"), ("a.py", "Self"))}


def test_deep_files_and_other_readers(spark):
    f = files_of(spark, ("deep.py", "x = " + "(" * 90 + "1" + ")" * 90 + "\ny = " + "-" * 5000 + "1\n"), ("ok.py", "def f(): pass\n"), ("t.txt", "one two"))
    parsed = ingest.parse(f)
    assert {r.file_path for r in parsed.collect()} <= {"ok.py", "deep.py"} and parsed.where("file_path = 'ok.py'").count() == 3
    words = {".txt": lambda text: [("entity", w, "word", 1, 1, None, "module", None, None) for w in text.split()]}
    assert sorted(r.name for r in ingest.parse(f, words).collect()) == ["one", "two"]


def test_similar_names_pass_the_bound(spark):
    """No pair that the sequences would match is lost by the bound of letters."""
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeÄ_") for _ in range(rng.randrange(0, 9))) for _ in range(120)]
    rows = spark.createDataFrame([(a, b) for a in words for b in words[:30]], "a string, b string")
    for r in rows.select("a", "b", names.can_be_similar(F.col("a"), F.col("b")).alias("may")).collect():
        if SequenceMatcher(None, r.a.lower(), r.b.lower()).ratio() >= names.SIMILAR:
            assert r.may, (r.a, r.b)


def test_priority_cut(spark):
    rows = [("r", f"src/f{i:02d}.py", "x", 1000 * (i % 7), None) for i in range(20)] + [("s", f"g{i}.py", "x", 10, None) for i in range(3)] + [("t", "main.py", "x", None, None)]
    f = spark.createDataFrame(rows, schema.FILES)
    kept = source_files.prioritised(f, large=10, least=4).collect()
    want = sorted((-(30 + min(20, n // 1000)), p) for r, p, _, n, _ in rows if r == "r")[:16]
    assert sorted(r.file_path for r in kept if r.repo_id == "r") == sorted(p for _, p in want)
    assert sum(r.repo_id == "s" for r in kept) == 3 and source_files.prioritised(f).count() == 24


def brute_fuzzy(name, wanted):
    from difflib import SequenceMatcher

    a, b = name.lower(), wanted.lower()
    if a == b:
        return 1.0
    if a.startswith(b):
        return 0.9
    if b in a:
        return 0.7
    ratio = SequenceMatcher(None, a, b).ratio()
    return ratio * 0.5 if ratio >= names.SIMILAR else None


def test_fuzzy_and_probable_equal_brute_force(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(11)
    words = ["load", "config", "render", "theme", "lode", "conf", "Rendr", "thema"]
    called = ["".join(rng.choice(words) + rng.choice(["", "_"]) for _ in range(rng.randrange(1, 4))) for _ in range(150)]
    n = nodes_of(spark, *[node(f"u{i:03d}", x, path=f"src/{rng.choice(words)}.py") for i, x in enumerate(called)], node("none", None))
    rows = n.collect()
    for wanted in ("load_config", "THEME", "rendr"):
        want = {r.uuid: brute_fuzzy(r.name, wanted) for r in rows if r.name is not None}
        got = {r.uuid: r.score for r in search.fuzzy(n, wanted).collect()}
        assert got.keys() == {u for u, s in want.items() if s is not None} and all(abs(got[u] - want[u]) < 1e-9 for u in got)
    asked = ["load_config", "theme.py:render", "src/lod.py:conf", ":thema", "nothing_like_it_at_all"]
    alike = lambda a, b: SequenceMatcher(None, a.lower(), b.lower()).ratio() >= names.SIMILAR
    want = set()
    for q in asked:
        place, name = q.split(":", 1) if ":" in q else ("", q)
        for r in rows:
            if r.name is not None and (name.lower() in r.name.lower() or alike(r.name, name)) and (not place or place in r.file_path or alike(r.file_path, place)):
                want.add((q, r.uuid))
    got = [tuple(r) for r in search.probable(n, spark.createDataFrame([(q,) for q in asked], "request string")).collect()]
    assert set(got) == want and len(got) == len(want)
