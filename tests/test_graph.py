"""The code graph on small trees: scan, extraction, links, layout, context, store, views."""

import re

import pytest
from pyspark.sql import functions as F

from arboria.functions import constants as K
from arboria.functions import scoring as S
from arboria.functions import text as T
from arboria.operators import embed, evaluate, extract, layout, links, pack, search, view
from arboria.plans import context, index
from arboria.plans.api import Engine, resolve_root
from arboria.sources import scan, store, work

FILES = {
    "pkg/common.py": '"""Helpers."""\n\nclass Base:\n    """A base."""\n    def __init__(self):\n        self.x = 1\n\ndef hub_core(a, b=2):\n    """Core."""\n    return transform(a) + b\n\ndef transform(v):\n    return v * 2\n',
    "pkg/mod.py": "from common import hub_core\n\nclass Child(Base):\n    def go(self):\n        return hub_core(1)\n\ndef charge(t):\n    # jwt secret\n    rows = client.rpc('get_total')\n    return transform(t)\n\ndef transform(q):\n    return q\n",
    "pkg/__init__.py": "VERSION = 1\n",
    "tests/test_mod.py": "def test_charge():\n    assert charge(1)\n",
    "web/app.ts": "export function handler() {\n  if (x) { return client.from('orders_table'); }\n}\nexport const run = (a) => {\n  handler();\n}\n// uses 'hub_core'\n",
    "supabase/functions/mailer/index.ts": "serve(() => {})\n",
    "svc/main.go": "package main\n\nfunc Serve(a int) {\n\tif true {\n\t}\n}\n\ntype Box struct {\n}\n",
    "db/schema.sql": "CREATE TABLE public.orders_table (id int);\nCREATE OR REPLACE FUNCTION get_total() RETURNS int AS $$ select ';' ; $$;\nCREATE VIEW v AS SELECT 1",
    "README.md": "# Title\ntext\n## Part ##\nmore\n",
    "twin.md": "# Title\ntext\n## Part ##\nmore\n",
    "broken.py": "def oops(:\n  class X\n",
    "data.json": "{}\n",
    "lib.min.js": "var a=1;\n",
    "wide.js": "x" * 900 + "\n",
    "node_modules/dep.js": "function no() {}\n",
    "bin.txt": "a\0b",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("proj")
    for rel, text in FILES.items():
        p = base / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(base)


@pytest.fixture(scope="module")
def keep(tmp_path_factory):
    return work.keeper(str(tmp_path_factory.mktemp("work")))


@pytest.fixture(scope="module")
def files(spark, root, keep):
    return keep(scan.scan(spark, root), "scan")


@pytest.fixture(scope="module")
def graph(files, root, keep):
    return index.graph(files, root, keep=keep)


def rows_of(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_scan_gates_in_walk_order(files):
    got = files.orderBy("ord").collect()
    order = [r.rel for r in got]
    assert order[:4] == ["README.md", "bin.txt", "broken.py", "data.json"] and order.index("twin.md") < order.index("db/schema.sql")
    assert not {"lib.min.js", "wide.js", "node_modules/dep.js"} & set(order) and "pkg/__init__.py" in order
    by = {r.rel: r.outcome for r in got}
    assert by["bin.txt"] == "binary" and by["twin.md"] == "duplicate" and by["README.md"] == "kept"


def test_scan_limits(spark, root):
    got = scan.scan(spark, root, max_files=3, max_bytes=5).collect()
    assert len(got) == 3 and all(len(r.text.encode()) <= 5 for r in got) and any(r.truncated for r in got)


def test_symbols(files):
    got = rows_of(extract.symbols(files.where("outcome = 'kept'")), "rel", "kind", "name", "line_start", "line_end")
    assert {("pkg/common.py", "class", "Base", 3, 6), ("pkg/common.py", "function", "hub_core", 8, 10), ("pkg/mod.py", "function", "go", 4, 5)} <= got
    assert {("web/app.ts", "function", "handler", 1, 3), ("web/app.ts", "function", "run", 4, 6), ("supabase/functions/mailer/index.ts", "function", "mailer", 1, 2)} <= got
    assert {("svc/main.go", "function", "Serve", 3, 6), ("svc/main.go", "class", "Box", 8, 9)} <= got
    assert {("db/schema.sql", "class", "orders_table", 1, 1), ("db/schema.sql", "function", "get_total", 2, 2), ("db/schema.sql", "class", "v", 3, 3)} <= got
    assert {("README.md", "section", "Title", 1, 2), ("README.md", "section", "Part ##", 3, 4), ("broken.py", "block", "oops", 1, 2)} <= got
    assert extract.sql_rows("select 1") == [] and extract.python_rows("def f(:") is None


def test_links_between_languages_and_files(graph):
    names = graph.symbols.select("node_id", F.concat("rel", F.lit(":"), "name").alias("name"))
    pairs = graph.links.join(names.toDF("from", "a"), "from").join(names.toDF("to", "b"), "to")
    got = {(r.a, r.b, r.type) for r in pairs.collect()}
    syntax = "syntax_dependency"
    assert ("pkg/mod.py:go", "pkg/common.py:hub_core", syntax) in got
    assert ("pkg/mod.py:charge", "pkg/common.py:transform", syntax) in got  # another file's before the own file's
    assert ("pkg/common.py:hub_core", "pkg/mod.py:transform", syntax) in got
    assert ("pkg/mod.py:charge", "db/schema.sql:get_total", syntax) in got
    assert ("web/app.ts:handler", "db/schema.sql:orders_table", syntax) in got
    assert ("web/app.ts:run", "web/app.ts:handler", "dependency") in got
    assert ("tests/test_mod.py:test_charge", "pkg/mod.py:charge", syntax) in got
    assert not any(a == b for a, b, _ in got)


def test_links_normal_form(spark):
    raw = [("a", "b", "t", "l", 2), ("a", "b", "t", "l", 1), ("a", "a", "t", "l", 3), ("", "b", "t", "l", 4), ("b", "a", "t", "l", 5)]
    got = links.normalized(spark.createDataFrame(raw, "from string, to string, type string, label string, ord int"), ["ord"])
    assert {(r["from"], r["to"], r.ord) for r in got.collect()} == {("a", "b", 1), ("b", "a", 5)}


def test_tree_and_layout(graph, root):
    nodes = {r.id: r for r in graph.nodes.collect()}
    top = next(n for n in nodes.values() if n.node_type == "project")
    assert top.parent_id is None and (top.x, top.y) == (0.0, 0.0) and top.zoom_threshold == 0.45
    for n in nodes.values():
        if n.parent_id:
            p = nodes[n.parent_id]
            assert n.path_ids[-2:] == [p.id, n.id] and abs(n.x) <= 1 and abs(n.y) <= 1
            r = ((n.x - p.x) ** 2 + (n.y - p.y) ** 2) ** 0.5
            if n.node_type == "directory":
                assert abs(r - (0.18 if p is top else 0.07)) < 1e-9
            if n.node_type == "file":
                assert abs(r - (0.095 if p is top else 0.045)) < 1e-9
    pkg = next(n for n in nodes.values() if n.title == "dir: pkg")
    assert pkg.summary == "Directory with 3 files and 0 child directories" and "- file: file: pkg/mod.py" in pkg.detail_content
    assert len(next(n for n in nodes.values() if n.title == "function: hub_core").embedding) == 384


def test_ids_are_stable(spark):
    import hashlib

    row = spark.range(1).select(T.stable_id(F.lit("file"), F.lit("Pkg/A b.py"), F.lit("x")).alias("i"), T.concept_id(F.lit("Ä?"), F.lit("s")).alias("c")).first()
    assert row.i == "file-pkg-a-b-py-" + hashlib.sha1(b"file|Pkg/A b.py|x").hexdigest()[:10]
    assert row.c.startswith("node-") and len(row.c) == 13


def contexts(spark, graph, asked):
    q = spark.createDataFrame([(i, t, b, None) for i, (t, b) in enumerate(asked)], "query_id long, query string, budget int, root string")
    rows = context.contexts(graph.nodes, graph.links, graph.files, q, semantic=False).orderBy("query_id").collect()
    return rows


def test_context_keeps_budgets_and_whole_lines(spark, graph):
    budgets = [100, 500, 700, 1000, 1500, 3000, 9000]
    rows = contexts(spark, graph, [("hub_core", b) for b in budgets])
    source = {line for t in FILES.values() for line in t.splitlines()}
    for r, b in zip(rows, budgets, strict=True):
        assert r.selected_count > 0 and r.used <= max(500, b) and len(r.compiled_context) == r.used + 2 * (r.selected_count - 1)
        for line in r.compiled_context.splitlines():
            if m := re.match(r"\s*\d+: (.*)$", line):
                assert m[1] in source
    assert rows[-1].selected_count >= rows[1].selected_count
    levels = [i.level for i in rows[-1].selected]
    assert levels[0] == "full" and "function: hub_core" in rows[0].compiled_context


def test_context_shows_callers_of_the_focus_first(spark, graph):
    r = contexts(spark, graph, [("hub_core", 1500)])[0]
    roles = [i.role for i in r.selected]
    assert roles[0] is None and set(roles[1:3]) <= {"caller", "callee"} and "go" in r.compiled_context


def test_critical_code_is_whole_or_absent(spark, graph):
    for r in contexts(spark, graph, [("charge jwt", 500), ("charge jwt", 6000)]):
        for i in r.selected:
            if i.role is None and i.pos > 1 and "charge" in i.id:
                assert i.level == "full"


def test_greedy_goes_on_after_a_misfit(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 9, 4, 1, 8])], "g string, i int, s int")
    r = pack.greedy(df, "g", ["i"], "s", 10).first()
    assert (r.used, r.taken) == (10, [0, 2, 3])


def test_runtime_code_ranks_before_tests(spark):
    nodes = spark.createDataFrame([("a", "x/tests/payment_test.py"), ("b", "x/src/payment.py")], "id string, source_path string")
    nodes = nodes.selectExpr("id", "'function: payment' title", "'' summary", "'' detail_content", "'symbol' node_type", "source_path", "'r' index_root", "1.0D zoom_threshold")
    ask = lambda q, root=None: [r.id for r in search.search(nodes, spark.createDataFrame([(0, q, root)], "query_id long, query string, root string")).orderBy("rank").collect()]
    assert ask("payment") == ["b", "a"] and ask("payment", "other") == []
    assert ask("payment test")[0] == "a"


def test_query_zoom(spark):
    z = lambda q, b: spark.range(1).select(S.query_zoom(F.lit(q), F.lit(b)).alias("z")).first().z
    assert z("x", 6000) == 0.5 and z("Overview", 6000) == 0.85 and abs(z("why overview", 6000) - 0.5) < 1e-12 and z("bug", 9000) == pytest.approx(0.25)


def test_lines_end_as_in_python(spark):
    texts = ["", "a", "a\n", "a\n\nb", "a\r\nb\rc", "a\x0bb\x1cc d\x85e\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.lines("t").alias("l")).collect()
    assert [r.l for r in rows] == [r.t.splitlines() for r in rows]


def test_largest_gap(spark):
    import math

    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", -2.0), ("b", 0.5)], "g string, angle double")
    got = {r.g: r.theta for r in layout.largest_gap(df, "g").collect()}
    assert got["a"] == pytest.approx((1.0 + (-2.0 + 2 * math.pi)) / 2 - (0 if (1.0 - 2.0 + 2 * math.pi) / 2 < math.pi else 2 * math.pi))
    assert got["b"] == pytest.approx(0.5 + math.pi - 2 * math.pi)


def test_hash_vectors_and_cache(spark):
    assert abs(sum(x * x for x in embed.hash_vector("alpha beta").tolist()) - 1) < 1e-9
    assert embed.hash_vector("A b").tolist() == embed.hash_vector("a B").tolist()
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "i int, embed_text string")
    first, fresh = embed.embedded(rows)
    assert fresh.count() == 2 and first.where("embedding is null").count() == 0
    _, again = embed.embedded(rows, fresh)
    assert again.count() == 0


def test_projection(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(4)], "id int, embedding array<double>")
    assert all(abs(r.x**2 + r.y**2 - 0.65**2) < 1e-9 for r in embed.projected(same).collect())
    some = spark.createDataFrame([(i, [float(i), float(i * i % 7), 1.0]) for i in range(9)], "id int, embedding array<double>")
    got = embed.projected(some).collect()
    assert max(max(abs(r.x), abs(r.y)) for r in got) == pytest.approx(1.0)
    assert embed.projected(some.limit(1)).first()[1:] == (0.0, 0.0)


def test_views(spark, graph):
    n = graph.nodes
    assert view.visible(n, 0, 0, 0.5).count() == 1  # the project alone is unlocked from afar
    top = view.stream_top(n, 0, 0, 12.0)
    ids, shown = view.with_links(top, n, graph.links, 12.0)
    assert ids.count() >= top.count() and shown.count() <= K.STREAM_LINKS
    assert view.with_links(top, n, graph.links, 2.0)[1].count() == 0
    state = {r.detail_state for r in view.node_view(n, 0, 0, 9.0).collect()}
    assert state <= {"unlocked", "locked", "outside_fov"} and "unlocked" in state
    nodes, edges = view.exported(n, graph.links)
    risk = {r.label: r.risk_score for r in nodes.collect()}
    assert risk["pkg"] >= risk["charge"] == 3 and edges.where("cross_language").count() >= 2


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "query_id int, id string, rank int")
    gold = spark.createDataFrame([(1, "b"), (1, "z"), (2, "q")], "query_id int, id string")
    got = {r.query_id: (r.recall, r.mrr, r.hit) for r in evaluate.metrics(ranked, gold, 5).collect()}
    assert got == {1: (0.5, 0.5, 1), 2: (0.0, 0.0, 0)}
    assert rows_of(evaluate.only_in(ranked, gold), "id") == {("a",), ("c",)}


def test_roots():
    assert resolve_root("x", "a", ["a"]).warnings and resolve_root(None, "a", ["a", "b"]).root == "a"
    assert resolve_root(None, None, ["b"]).root == "b" and resolve_root(None, "gone", ["a", "b"]).warnings


def test_store_writes_what_changed_and_survives_a_torn_pointer(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    rows = [(f"n{i}", f"p{i}", float(i), [0.1, 0.2], "2020") for i in range(40)]
    schema = "id string, source_path string, x double, embedding array<double>, updated_at string"
    df = spark.createDataFrame(rows, schema)
    assert s.commit({"nodes": df})["nodes"] > 1
    assert rows_of(s.read("nodes"), "id", "x") == {(r[0], r[2]) for r in rows}
    assert s.commit({"nodes": df.withColumn("updated_at", F.lit("2021"))})["nodes"] == 0
    pinned = s.manifest()
    assert s.commit({"nodes": df.withColumn("x", F.when(F.col("id") == "n3", 9.0).otherwise(F.col("x")))})["nodes"] == 1
    assert s.read("nodes", pinned).where("id = 'n3'").first().x == 3.0 and s.read("nodes").where("id = 'n3'").first().x == 9.0
    (tmp_path / "s" / "CURRENT").write_text("{torn")
    for crc in (tmp_path / "s").glob(".*.crc"):
        crc.unlink()
    assert s.manifest()["version"] == 0 and s.read("nodes") is None


def test_engine_indexes_again_only_what_changed(spark, tmp_path):
    base = tmp_path / "proj"
    (base / "a").mkdir(parents=True)
    (base / "a" / "one.py").write_text("def one():\n    return two()\n")
    (base / "two.py").write_text("def two():\n    return 1\n")
    e = Engine(spark, str(tmp_path / "db"))
    first = e.index(str(base))
    assert (first["file_count"], first["symbol_count"], first["link_count"]) == (2, 2, 1)
    (base / "two.py").write_text("def two():\n    return 2\n\ndef three():\n    return one()\n")
    event = e.ingest(str(base), ["two.py"])
    assert event["files"] == {"two.py": "modified"} and e.links().count() == 2
    fresh = Engine(spark, str(tmp_path / "db2"))
    fresh.index(str(base))
    assert rows_of(e.nodes(), "id", "title", "x", "y", "detail_content") == rows_of(fresh.nodes(), "id", "title", "x", "y", "detail_content")
    assert "def two" in e.context("two", 1500)["compiled_context"]
    i = e.inject_concept("Idea", "of ones")
    assert e.nodes().where(F.col("id") == i).first().node_type == "concept" and e.status()["concept_count"] == 1
    assert e.zoom_query("three")[0]["title"] == "function: three"
    e.reset()
    assert e.nodes() is None
