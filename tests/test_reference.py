"""The operators over a small graph whose results are known."""

import math
import sqlite3
from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import ids, rules, text
from loomgraph.operators import changes, docs, flows, resolve, rollups, search, synthesis, traversal
from loomgraph.operators import code_graph as cg


@pytest.fixture(scope="module")
def graph(spark):
    at = D(2024, 1, 1)
    classes = spark.createDataFrame(
        [("c1", "TestController", "com.example.TestController", "com.example", "src/TestController.java", None, "[]", ["com.other.Far"], ["@RestController"], at),
         ("c2", "TestService", "com.example.TestService", "com.example", "src/TestService.java", None, '["com.example.Api"]', [], ["@Service", "@Transactional"], at),
         ("c3", "TestRepository", "com.example.TestRepository", "com.example", "src/TestRepository.java", "BaseRepository", None, [], ["@Repository"], at),
         ("c4", "BaseRepository", "com.example.BaseRepository", "com.example", "src/BaseRepository.java", None, None, [], [], at),
         ("c5", "Api", "com.example.Api", "com.example", "src/Api.java", None, None, [], [], at)],
        "id string, name string, full_name string, package_name string, file_path string, extends string, implements_json string, imports array<string>, annotations array<string>, indexed_at timestamp")
    methods = spark.createDataFrame(
        [("m1", "handleRequest", "com.example.TestController", ["String"], "src/TestController.java", 10, 15, "void handleRequest(String s) { service.process(s); }", "void"),
         ("m2", "process", "com.example.TestService", ["String"], "src/TestService.java", 20, 25, "void process(String s) { repo.fetch(s); }", "TestRepository"),
         ("m3", "fetch", "com.example.TestRepository", ["String"], "src/TestRepository.java", 30, 35, "void fetch(String s) { }", "void"),
         ("m4", "close", "com.example.BaseRepository", [], "src/BaseRepository.java", 5, 6, "void close() { }", "void"),
         ("m5", "process", "com.example.TestService", ["Integer"], "src/TestService.java", 40, 45, None, "void")],
        "id string, method_name string, class_full_name string, parameter_types array<string>, file_path string, start_line int, end_line int, source string, return_type string",
    ).withColumn("signature", ids.signature("class_full_name", "method_name", "parameter_types"))
    calls = spark.createDataFrame(
        [("k1", "m1", '["m2"]', 11), ("k2", "m2", '[ "M3" ]', 21), ("k3", "m3", "[]", 31), ("k4", "m2", '["broken"', 22)],
        "id string, caller_method_id string, resolved_candidates_json string, line int")
    return classes, methods, calls


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_edges_and_rollups(graph):
    classes, methods, calls = graph
    e = cg.call_edges(calls)
    assert rows(e) == [("k1", "m1", "m2"), ("k2", "m2", "m3")]
    assert rows(rollups.caller_counts(e)) == [("m2", 1), ("m3", 1)]
    assert ("src/TestService.java", "src/TestController.java", 1, "process") in rows(rollups.file_dependents(e, methods))
    assert rows(rollups.file_dependencies(e, methods).filter("file like '%Controller%'")) == [("src/TestController.java", "src/TestService.java", 1, "process")]
    inh = cg.inheritance_edges(classes)
    assert rows(inh.select("source", "target", "relation")) == [("com.example.TestRepository", "BaseRepository", "extends"), ("com.example.TestService", "com.example.Api", "implements")]
    assert [r["target"] for r in rollups.missing_targets(inh, classes).collect()] == ["BaseRepository"]


def test_traversal(spark, graph):
    e = cg.call_edges(graph[2])
    seed = lambda *i: spark.createDataFrame([(x,) for x in i], "id string")
    assert rows(traversal.levels(e, seed("m1"))) == [("m1", 0), ("m2", 1), ("m3", 2)]
    assert rows(traversal.callers(e, seed("m3"), 1)) == [("m2", 1)]
    paths = {r["id"]: r["path"] for r in traversal.shortest_paths(e, seed("m1"), 6).collect()}
    assert paths["m3"] == ["m1", "m2", "m3"]
    assert "m3" not in {r["id"] for r in traversal.shortest_paths(e, seed("m1"), 1).collect()}
    assert "m1" not in {r["id"] for r in traversal.shortest_paths(e, seed("m3"), 6).collect()}
    assert rows(traversal.bridges(e, seed("m2"))) == [("m1", "m3")]
    assert rows(traversal.sinks(e, seed("m1", "m3"))) == [("m1", 1, 1.0), ("m3", 0, 0.0)]
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert rows(traversal.closure(loop)) == [("a", "a", 2), ("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("b", "b", 2), ("b", "c", 1)]
    nodes, walked, stops = traversal.stitched_flow(loop, seed("a"), 2)
    assert rows(stops) == [("b", "cycle"), ("c", "max_depth")]
    ranks = {r["id"]: (r["rank"], r["tier"]) for r in traversal.flow_ranks(nodes, walked).collect()}
    assert ranks == {"a": (115.0, "primary"), "b": (55.0, "primary"), "c": (10.0, "utility")}
    capped = traversal.capped(nodes, 2).collect()
    assert [r["id"] for r in capped] == ["a", "b"] and capped[0]["omitted"] == 1


def test_selectors(graph):
    classes, methods, _ = graph
    ids_of = lambda df: sorted(r["id"] for r in df.collect())
    assert ids_of(cg.select_methods(methods, "m2")) == ["m2"]
    assert ids_of(cg.select_methods(methods, "TestService.process")) == ["m2", "m5"]
    assert ids_of(cg.select_methods(methods, "com.example.TestService#process(String)")) == ["m2"]
    assert ids_of(cg.select_methods(methods, "nothing")) == []
    best = cg.suggestions(methods, "fetch").first()
    assert best["id"] == "m3" and best["score"] == 150
    assert ids_of(cg.annotated(methods.selectExpr("*", "array('@Override') as annotations", "null as framework_role"), classes, "org.x.Service()")) == ["c2"]
    points = methods.sparkSession.createDataFrame([("src/TestService.java", 22), ("src/TestService.java", 99)], "file_path string, line int")
    assert rows(cg.method_at_line(methods, points)) == [("src/TestService.java", 22, "m2")]
    assert cg.latest(methods.selectExpr("id", "source", "end_line as indexed_at").union(methods.selectExpr("id", "'x'", "1"))).filter("source = 'x'").count() == 0


def test_resolution(spark, graph):
    classes, methods, _ = graph
    calls = spark.createDataFrame(
        [("a", "m1", "process", "service", "TestService", 1, ["String"]), ("b", "m1", "process", "service", "TestService", 1, [None]), ("c", "m3", "close", None, None, 0, []), ("d", "m1", "fetch", None, None, 1, ["String"]), ("e", "m1", "go", "x", "com.lib.Thing", 0, []), ("f", "m1", "gone", "service", "TestService", 0, []), ("g", "m1", "process", "api", "Api", 1, ["Integer"]), ("h", "m3", "fetch", "this", None, -1, None)],
        "callsite_id string, caller_method_id string, callee_name string, receiver string, receiver_type string, argument_count int, argument_types array<string>")
    inh = cg.inheritance_edges(classes).withColumn("target", F.when(F.col("target") == "BaseRepository", "com.example.BaseRepository").otherwise(F.col("target")))
    got = {r["callsite_id"]: (r["status"], r["candidates"]) for r in resolve.resolve(calls, methods, classes, inh).collect()}
    assert got == {
        "a": ("resolved_same_package", ["m2"]),
        "b": ("ambiguous_overload", ["m2", "m5"]),
        "c": ("resolved_inherited", ["m4"]),
        "d": ("candidate_global_name_arity", ["m3"]),
        "e": ("external_library", []),
        "f": ("unresolved_method", []),
        "g": ("resolved_via_sole_implementation", ["m5"]),
        "h": ("resolved_same_class", ["m3"]),
    }
    dyn = {r["callsite_id"]: r["status"] for r in resolve.dynamic_cascade(calls, methods).collect()}
    assert dyn["a"] == "resolved_arity" and dyn["e"] == "unresolved" and dyn["h"] == "resolved_name_only"


def test_bm25_against_sqlite(spark):
    texts = ["the invoice retry loop", "retry retry later", "an invoice", "nothing here at all", "invoices are kept and retried", ""]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(text)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index in this sqlite")
    con.executemany("insert into t(rowid, text) values (?, ?)", list(enumerate(texts)))
    want = dict(con.execute("""select rowid, bm25(t) from t where t match '"invoice"* OR "retr"*'""").fetchall())
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["score"] for r in search.bm25(df, ["invoice", "retr"], ["text"]).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    index = {(r["id"], r["term"]): r["text"] for r in search.postings(df, "id", ["text"]).collect()}
    assert index[(1, "retry")] == 2


def test_ranking(spark, graph):
    hits = search.two_phase(graph[1], ["process"])
    best = hits.orderBy("score").collect()
    assert {r["id"] for r in best[:2]} == {"m2", "m5"} and best[0]["bucket"] == "name"
    s = search.hit_score(F.lit(-2.0), ["process"], F.lit("process"), F.lit("a#process()"), F.lit("src/test/process.java"), F.array(F.lit("service")))
    assert one(spark, s) == 2.0 + 2.0 + 0.5 + 1.5 + 1.5 - 1.0
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [1.0, 1.0]), ("d", [1.0]), ("e", None)], "method_id string, embedding array<float>")
    assert [r["id"] for r in search.dense_hits(v, [1.0, 0.1], 2).collect()] == ["a", "c"]


def test_words(spark):
    assert one(spark, text.query_tokens(F.lit("getUserName of Old_Get get"))) == ["getusername", "get", "user", "name", "of", "old_get", "old"]
    assert set(one(spark, text.rank_tokens(F.lit("how does AuthToken work")))) == {"authtoken", "auth", "token"}
    for word, stem in {"running": "run", "flies": "fli", "happily": "happili", "relational": "relat", "conditional": "condit", "generously": "generous", "hopping": "hop", "agreed": "agre", "national": "nation", "skies": "sky", "consistency": "consist"}.items():
        assert text.porter2(word) == stem, word
    df = spark.createDataFrame([("show me the running Servers",), ("the of",)], "q string")
    assert [r["x"] for r in df.select(text.without_stop_words(F.col("q")).alias("x")).collect()] == ["run servers", "the of"]


def test_rules(spark):
    a = F.array(F.lit("@PostMapping(\"/a\")"), F.lit("@Override"))
    c = F.array(F.lit("@RequestMapping(path = \"/base/\")"))
    assert tuple(one(spark, rules.endpoint(a, c))) == (True, "POST", "/a", "/base/", "/base/a")
    none = F.array().cast("array<string>")
    assert tuple(one(spark, rules.endpoint(none, none))) == (False, None, None, None, None)
    assert one(spark, rules.class_stereotypes(F.lit("XDto"), F.array(F.lit("@org.x.RestController")))) == ["controller", "dto", "rest_controller"]
    assert one(spark, rules.class_stereotypes(F.lit("X"), F.lit(None).cast("array<string>"), F.lit("enum_declaration"))) == ["enum"]
    assert [one(spark, rules.budget_tier(F.lit(n))) for n in (199, 200, 999, 1000, 5000, 20000)] == ["XS", "S", "S", "M", "L", "XL"]
    assert [one(spark, rules.path_variant(F.lit(p))) for p in ("src/test/A.java", "a/test_x.py", "a\\tests\\b.cs", "src/main/A.java")] == ["test", "test", "test", "main"]
    assert one(spark, rules.path_matches(F.lit("a\\b\\c.py"), F.lit("b/c.py"))) and not one(spark, rules.path_matches(F.lit("a/bb/c.py"), F.lit("b/c.py")))
    assert one(spark, cg.text_window(F.lit("\n".join(map(str, range(10)))), 6)) == "0\n1\n2\n...\n7\n8\n9"


def test_changes(spark):
    f = "path string, mtime_ns long, size long"
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], f)
    new = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], f)
    assert rows(changes.fingerprint_diff(old, new)) == [("b", "changed"), ("c", "deleted"), ("d", "added")]
    assert changes.is_stale(old, new) and not changes.is_stale(old, old)
    m = "signature string, file_path string, start_line int, source string"
    a = spark.createDataFrame([("s1", "f", 1, "x"), ("s2", "f", 5, "y"), ("s3", "g", 1, "z"), ("s4", "h", 1, "q")], m)
    b = spark.createDataFrame([("s1", "f", 2, "x"), ("s2", "f", 6, "y"), ("s3", "g", 1, "zz"), ("s5", "h", 1, "q")], m)
    assert rows(changes.file_changes(changes.record_diff(a, b))) == [("f", "metadata_only"), ("g", "callsite_change"), ("h", "structural")]
    k = "k string, p string, v int"
    base, fix = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], k), spark.createDataFrame([("a", None, 9), ("c", None, 3)], k)
    assert rows(changes.upsert(base, fix, ["k", "p"]).select("k", "v")) == [("a", 9), ("b", 2), ("c", 3)]


def test_incremental_equals_full(spark):
    s = "id string, file_path string"
    base = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], s)
    parsed = spark.createDataFrame([("1b", "a"), ("4", "d")], s)
    touched = spark.createDataFrame([("a",), ("c",), ("d",)], "file_path string")
    failed = spark.createDataFrame([("c",)], "file_path string")
    assert rows(changes.replaced_files(base, parsed, touched, failed)) == [("1b", "a"), ("2", "b"), ("3", "c"), ("4", "d")]


def test_docs(spark):
    long = "\n\n".join(f"paragraph {i} " + "word " * 60 for i in range(20))
    df = spark.createDataFrame([("p", f"intro\n# One\nshort\n## Two\n{long}")], "path string, text string")
    got = docs.markdown_chunks(df).orderBy("chunk_index").collect()
    assert [r["title"] for r in got[:3]] == [None, "One", "Two"] and len(got) > 4
    assert all(len(r["content"]) <= 3000 for r in got) and [r["chunk_index"] for r in got] == list(range(len(got)))
    chunks = spark.createDataFrame([("x", "s", "A,B"), ("y", "s", "B, C"), ("z", "s", "C"), ("w", "s", None)], "id string, source_path string, linked_classes string")
    classes = spark.createDataFrame([("A",), ("B",)], "name string")
    assert rows(docs.stale_chunks(chunks, classes).select("id", "state")) == [("x", "fresh"), ("y", "partial"), ("z", "dropped")]
    assert [r["id"] for r in docs.docs_for(chunks, "C").orderBy("id").collect()] == ["y", "z"]


def test_evaluation(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(20)], "k string, v double")
    assert rows(rollups.latency_summary(df, "k", "v")) == [("a", 20, 9.5, 10.0, 19.0)]
    empty = F.array().cast("array<string>")
    assert tuple(one(spark, rollups.set_scores(empty, empty))) == (1.0, 1.0, 0.0, 0.0)


def test_synthesis(spark):
    classes = spark.createDataFrame([("c1", "p.A", ["@Data", "@Builder"]), ("c2", "p.R", [])], "id string, full_name string, annotations array<string>")
    fields = spark.createDataFrame([("c1", "name", "String", []), ("c1", "open", "boolean", ["final"]), ("c1", "LOG", "Logger", ["static"]), ("c2", "x", "int", [])], "class_id string, name string, type_name string, modifiers array<string>")
    made = {(r["method_name"], r["kind"]) for r in synthesis.accessor_methods(classes, fields).collect()}
    assert made == {("getName", "getter"), ("setName", "setter"), ("name", "builder"), ("isOpen", "getter"), ("open", "builder"), ("builder", "builder"), ("build", "builder")}
    inh = spark.createDataFrame([("c2", "p.R", "org.x.JpaRepository<A>", "extends")], "source_id string, source string, target string, relation string")
    assert synthesis.repository_methods(classes, inh).count() == 10
    names = spark.createDataFrame([("p.Outer.Inner",), ("q.Outer$Inner",)], "full_name string")
    assert synthesis.inner_classes(names).first()["full_name"] == "q.Outer$Inner"


def test_stack_traces(spark, graph):
    text_ = "Error\n\tat com.example.TestService.process(TestService.java:22)\r\n\tat com.lib.X.y(X.java:1)\n  File \"/a/TestRepository.java\", line 31, in fetch\n"
    frames = flows.stack_frames(spark.createDataFrame([(1, text_), (2, None)], "id int, text string"))
    got = flows.matched_frames(frames, graph[1]).orderBy("position").collect()
    assert [(r["status"], r["method_id"]) for r in got] == [("matched", "m2"), ("unmatched", None), ("matched", "m3")]
    assert flows.anchors(flows.matched_frames(frames, graph[1])).first()["method_id"] == "m2"


def test_rules_of_exclusion(spark, graph):
    wanted = spark.createDataFrame([("package", "com.example", False), ("selector", "fetch", True), ("selector", "process", True)], "kind string, pattern string, include boolean")
    out = {r["id"]: r["out"] for r in flows.excluded(graph[1], wanted).collect()}
    assert out == {"m1": True, "m2": True, "m3": False, "m4": True, "m5": True}
