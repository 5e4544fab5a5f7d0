"""Lookups, reports, the stored index, records and what follows from changes, on small tables."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.operators import changes, docs, flows, index, lookups, reports, search, synthesis
from loomgraph.sources import records

METHODS = "id string, class_full_name string, method_name string, signature string, file_path string, start_line int, parameter_types array<string>, generated boolean"


@pytest.fixture(scope="module")
def methods(spark):
    rows = [("1", "p.A", "run", "p.A#run()", "a", 1, [], None), ("2", "p.A", "run", "p.A#run(int)", "a", 2, ["int"], True), ("3", "q.A", "go", "q.A#go()", "b", 1, [], True), ("4", "q.B", "go", "q.B#go()", "c", 1, [], True), ("5", None, "x", None, None, None, None, None)]
    return spark.createDataFrame(rows, METHODS)


def test_selectors(spark, methods):
    asked = ["1", "p.A#run(int)", "p.A.run", "A#run", "go", "A.go", "A#nope", "A", "q.B", "zzz", "", None, "run", "run"]
    got = {r["selector"]: r for r in lookups.resolved_selectors(methods, spark.createDataFrame([(a,) for a in asked], "selector string")).collect()}
    assert len(got) == 12
    state = lambda s: (got[s]["status"], got[s]["method_id"])
    assert state("1") == ("found", "1") and state("p.A#run(int)") == ("generated", "2") and state("p.A.run") == ("found", "1") and state("A#run") == ("found", "1")
    assert state("go") == ("ambiguous", None) and state("A.go") == ("generated", "3") and state("run") == ("found", "1")
    assert got["A#nope"]["status"] == "class_without_method" and got["A#nope"]["names"] == ["run"] and got["A#nope"]["class"] == "p.A"
    assert got["A"]["status"] == "class" and got["q.B"]["class"] == "q.B" and got["zzz"]["status"] == got[""]["status"] == "unknown"
    assert lookups.resolved_selectors(methods.limit(0), spark.createDataFrame([("a",)], "selector string")).first()["status"] == "unknown"


def test_implementations(spark):
    classes = spark.createDataFrame([("p.I", ["interface"]), ("q.I", []), ("p.X", []), ("p.Y", []), ("p.Z", [])], "full_name string, stereotypes array<string>")
    inh = spark.createDataFrame([("p.X", "I", "implements"), ("p.Y", "p.X", "extends"), ("p.Z", "Y", "extends"), ("p.X", "Z", "implements"), ("gone", "I", "implements")], "source string, target string, relation string")
    assert {tuple(r) for r in lookups.implementations(classes, inh).collect()} == {("I", "p.X", 1), ("X", "p.Y", 1), ("Y", "p.Z", 1), ("Z", "p.X", 1)}
    deep = {(r["type"], r["implementer"]): r["distance"] for r in lookups.implementations(classes, inh, transitive=True).collect()}
    assert deep["I", "p.Z"] == 3 and deep["Z", "p.X"] == 1 and deep["X", "p.X"] == 3 and len(deep) == 12
    assert {r["short"]: r["full_name"] for r in lookups.declared_types(classes).collect()}["I"] == "p.I"
    assert {tuple(r) for r in lookups.implementers_of(inh, spark.createDataFrame([("p.X",), ("I",)], "name string")).collect()} == {("p.X", "p.Y"), ("I", "p.X"), ("I", "gone")}


def test_reports_have_their_limits_and_order(spark):
    nodes = spark.createDataFrame([("a", "s.a", "utility", 9.0), ("b", "s.b", "primary", 1.0), ("c", "s.c", "supporting", 5.0), ("d", "s.d", "primary", 2.0), ("d", "s.d", "primary", 2.0)], "id string, signature string, tier string, rank double")
    assert [r["id"] for r in lookups.top_first(nodes.distinct(), 4).collect()] == ["c", "d", "b", "a"]
    assert [r["id"] for r in lookups.expansion_queue(nodes, "b").collect()] == ["d", "c"]
    parts = nodes.withColumns({"reason": F.lit("x"), "seq": F.lit(1)}).unionByName(nodes.filter("id = 'a'").withColumns({"tier": F.lit("primary"), "reason": F.lit("first"), "seq": F.lit(0)}))
    assert [(r["id"], r["reason"]) for r in lookups.suggested_next(parts).collect()] == [("a", "first"), ("d", "x"), ("b", "x"), ("c", "x")]
    assert lookups.spot_check(spark.createDataFrame([("a",), ("b",)], "path string")).count() == 1
    assert lookups.focused(spark.createDataFrame([("a", "b")], "src string, dst string"), nodes, nodes.filter("id = 'zz'").select("id"), 2).count() == 4


CALLS = "callsite_id string, caller_method_id string, callee_name string, receiver string, receiver_type string, status string, candidates array<string>, line int, reason string"


def test_built_flow(spark):
    calls = [
        ("1", "r", "load", "repo", "p.Repository", "resolved_exact", ["m"], 3, "x"),
        ("2", "r", "load", "repo", "p.Repository", "resolved_exact", ["m"], 5, "x"),
        ("3", "m", "info", "log", "Logger", "external_library", [], 7, "x"),
        ("4", "m", "stream", "xs", "List", "resolved_exact", ["u"], 8, "x"),
        ("5", "m", "save", "svc", "p.Service", "unresolved_method", [], 9, "lost"),
        ("6", "m", "again", "r", "p.Service", "resolved_exact", ["r"], 10, "x"),
        ("7", "z", "far", None, None, "resolved_exact", ["q"], 1, "x"),
        ("8", "m", "maybe", "thing", "T", "ambiguous_type", ["z"], 11, "x"),
    ]
    c = spark.createDataFrame(calls, CALLS)
    roots = spark.createDataFrame([("r",)], "id string")
    flow = lambda mode, depth=3: {(r["src"], r["dst"], r["call"]): (r["depth"], r["times"], r["lines"], r["confidence"]) for r in reports.built_flow(c, roots, depth, mode).collect()}
    assert flow("compact") == {("r", "m", "load"): (1, 2, [3, 5], 1.0), ("m", "r", "again"): (2, 1, [10], 1.0), ("m", "z", "maybe"): (2, 1, [11], 0.75), ("z", "q", "far"): (3, 1, [1], 1.0)}
    assert set(flow("full")) - set(flow("compact")) == {("m", None, "save")}
    assert ("m", "u", "stream") in flow("debug") and set(flow("compact", 1)) == {("r", "m", "load")} and flow("compact", 0) == {}
    with pytest.raises(ValueError, match="mode"):
        reports.built_flow(c, roots, 1, "other")
    stats = reports.flow_stats(reports.built_flow(c, roots, 3), c).first()
    assert (stats["steps"], stats["deduplicated"], stats["unresolved"], stats["observability"], stats["utility"]) == (5, 1, 1, 1, 1)
    u = reports.uncertain_edges(c)
    assert {tuple(r) for r in u.collect()} == {("m", "info", "x", 1), ("m", "save", "lost", 1)}
    top = reports.uncertain_summary(u, 1).first()
    assert (top["call"], top["total"], top["omitted"]) == ("info", 2, 1)
    assert {tuple(r) for r in reports.stopped_summary(spark.createDataFrame([("a", "x"), ("b", None)], "id string, reason string")).collect()} == {("x", 1), ("unknown", 1)}


def test_mind_map(spark):
    m = spark.createDataFrame([("r", "a.service.R#r()", "f"), ("s", "a.components.S#s()", "f"), ("t", "a.skip.T#t()", "f"), ("u", "a.U#u()", "f")], "id string, signature string, file_path string")
    e = spark.createDataFrame([("r", "s"), ("r", "t"), ("t", "u"), ("s", "u")], "src string, dst string")
    root = spark.createDataFrame([("r",)], "id string")
    got = {r["id"]: (r["depth"], r["tier"]) for r in reports.mind_map(m, e, root, 3, config={"package_contains": (".skip.",)}).collect()}
    assert got == {"r": (0, "primary"), "s": (1, "supporting"), "u": (2, "utility")}
    assert [r["id"] for r in reports.mind_map(m, e, root, 3, most=2).orderBy("position").collect()] == ["r", "s"]
    assert {r["id"] for r in reports.mind_map(m, e, root, 3, utilities=False).collect()} == {"r", "s"}
    assert {(r["section"], r["id"]) for r in reports.flow_document(m.withColumns({"tier": F.lit("primary"), "rank": F.lit(1.0)}), e, "r", subflows=1, depth=1).collect()} == {("root", "r"), ("root", "s"), ("root", "t"), ("u", "u")}


def test_index_against_sqlite(spark):
    rows = [("1", "archiveInvoice", "p.A#archiveInvoice()", "p.A", "return invoice archive invoice;"), ("2", "load", "p.B#load()", "p.B", "archive the invoices"), ("3", "invoice", None, "p.Invoice", ""), ("4", "none", "x", "y", None), ("5", "get_invoice", "q", "r", "")]
    m = spark.createDataFrame(rows, "id string, method_name string, signature string, class_full_name string, source string")
    ix = index.Index.build(m, "id", search.METHOD_COLUMNS)
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(id unindexed, method_name, signature, class_full_name, source)")
    con.executemany("insert into t values (?,?,?,?,?)", rows)
    for terms, match in ((["archive", "invoice"], '"archive"* OR "invoice"*'), (["inv"], '"inv"*')):
        want = dict(con.execute("select id, bm25(t) from t where t match ?", (match,)).fetchall())
        got = {r["id"]: r["score"] for r in ix.search(terms).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    want = {r[0] for r in con.execute("select id from t where t match ?", ('"archive"* "invoice"*',))}
    assert {r["id"] for r in ix.search(["archive", "invoice"], every=True).collect()} == want
    assert {r["id"] for r in ix.search(["invoice"], only="method_name", whole=True).collect()} == {"3", "5"}
    assert {r["id"] for r in ix.search(["i"]).collect()} == {"1", "2", "3", "5"} and ix.search([]).count() == 0 and ix.search(["zzz"]).count() == 0
    plan = ix.search(["invoice"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "StringStartsWith(term,invoice)" in plan
    now = m.filter("id <> '2'").withColumn("source", F.when(F.col("id") == "4", "archive").otherwise(F.col("source")))
    again = ix.synced(now, "id", spark.createDataFrame([("2",), ("4",)], "id string"))
    assert again.differences(now, "id").count() == 0 and ix.differences(now, "id").count() > 0
    assert {r["id"] for r in again.search(["archive"], whole=True).collect()} == {"1", "4"}
    empty = index.Index.build(m.limit(0), "id", search.METHOD_COLUMNS)
    assert empty.search(["invoice"]).count() == 0


def test_search_contract(spark):
    m = spark.createDataFrame([("m1", "archive", "p.A#archive()", "src/A.java", "p.A", "x"), ("m2", "other", "p.B#other()", "src/B.java", "p.B", "calls archive and retries"), ("m3", "archive", "g.G#archive()", "build/generated/G.java", "g.G", ""), ("m4", "far", "p.F#far()", "src/F.java", "p.F", "")], "id string, method_name string, signature string, file_path string, class_full_name string, source string")
    c = spark.createDataFrame([("c1", "Archive", "p.Archive", "p", "src/Archive.java"), ("c2", "ArchiveIt", "p.ArchiveIt", "p", "src/It.java")], "id string, name string, full_name string, package_name string, file_path string")
    e = spark.createDataFrame([("m4", "m1"), ("m4", "m2"), ("m2", "m1")], "src string, dst string")
    ix, cx = index.Index.build(m, "id", search.METHOD_COLUMNS), index.Index.build(c, "id", index.CLASS_COLUMNS)
    assert index.is_identifier("archive") and index.is_identifier("x y z") and not index.is_identifier("how x y") and not index.is_identifier("x y z w") and not index.is_identifier("")
    assert index.parts("getUser_name XMLParser") == ["getuser", "name", "get", "user", "xmlparser", "xml", "parser"] or "user" in index.parts("getUser_name")
    callers = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    found = {r["id"]: r["bucket"] for r in index.hits(ix, cx, "archive", c, callers=callers).collect()}
    assert found == {"m1": "name", "m3": "name", "m2": "text", "c1": "exact_class"}
    got = index.answered(ix, cx, m, c, e, "archive", callers=callers).orderBy("position").collect()
    assert [r["id"] for r in got][:1] == ["m1"] and [r["id"] for r in got if r["source"] == "graph"] == ["m4"]
    assert [r["id"] for r in got if r["source"] == "fts"][-1] == "m3"
    assert len(index.answered(ix, cx, m, c, e, "archive", exact=True).collect()) <= 5
    vectors = spark.createDataFrame([("m4", [1.0, 0.0]), ("m1", [0.0, 1.0])], "method_id string, embedding array<double>")
    dense = index.answered(ix, cx, m, c, e, "archive", vectors=vectors, asked=[1.0, 0.1]).collect()
    assert "m4" in {r["id"] for r in dense if r["source"] == "fts"}
    assert [r["id"] for r in index.answered(ix, cx, m, c, e, "rchiv").collect()][0] in {"m1", "m2", "m3"}
    assert index.answered(ix, cx, m, c, e, "zzz").count() == 0
    seen = index.explored(ix, m, e, "how does the archive retry").orderBy("position").collect()
    assert {r["id"] for r in seen if r["source"] == "fts"} >= {"m1", "m2"} and {r["source"] for r in seen} <= {"fts", "graph"}
    lifted = index.hits(ix, None, "archive", context=spark.createDataFrame([("m2",)], "id string")).orderBy("score").collect()
    assert {r["id"]: r["score"] < -400 for r in lifted}["m2"]


def test_records(spark, tmp_path):
    lines = [{"_type": "class", "id": "c", "name": "A", "full_name": "p.A"}, {"_type": "callsite", "id": "k", "caller_method_id": "m", "callee_name": "f", "resolved_candidates": ["x"]}, {"_type": "other", "id": "z"}, {"_type": "resolved_call_edge", "id": "e", "callsite_id": "k", "caller_method_id": "m", "callee_method_id": "x"}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nno json\n")
    g = records.read(spark, str(tmp_path / "r.jsonl"))
    assert {n: df.count() for n, df in g.items()} == {"class": 1, "method": 0, "field": 0, "callsite": 1, "inheritance_edge": 0, "resolved_call_edge": 1}
    assert g["class"].first()["implements"] == [] and g["class"].first()["language"] == "typescript" and g["callsite"].first()["resolution_status"] == "unresolved"


def test_changes(spark):
    base = {"methods": spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")], "id string, file_path string"), "edges": spark.createDataFrame([("1", "2"), ("2", "4"), ("4", "1")], "src string, dst string")}
    parsed = {"methods": spark.createDataFrame([("2n", "b"), ("4n", "d")], "id string, file_path string")}
    files = lambda *p: spark.createDataFrame([(x,) for x in p], "file_path string")
    out = changes.reindexed(base, parsed, files("b", "d"), files("c"), files("d"))
    assert {r["id"] for r in out["methods"].collect()} == {"1", "2n", "4"} and [tuple(r) for r in out["edges"].collect()] == [("4", "1")]
    assert {r["path"] for r in changes.trigger(spark.createDataFrame([("a/B.JAVA",), ("x.md",), ("a/B.JAVA",), ("noext",)], "path string")).collect()} == {"a/B.JAVA"}
    v = lambda *r: spark.createDataFrame(list(r), "name string, version string")
    assert [r["name"] for r in changes.outdated(v(("a", "2"), ("b", "1")), v(("a", "1"), ("b", "1"))).collect()] == ["a"]
    resolved = spark.createDataFrame([("1", "old"), ("2", "old")], "callsite_id string, status string")
    got = changes.rescoped(resolved, resolved.withColumn("status", F.lit("new")), spark.createDataFrame([("2",)], "callsite_id string"))
    assert {tuple(r) for r in got.collect()} == {("1", "old"), ("2", "new")}


def test_what_had_no_caller(spark):
    hits = spark.createDataFrame([("1", 0.5), ("2", 0.2)], "id string, score double")
    assert {(r["id"], r["bucket"]) for r in docs.merged_hits(spark.createDataFrame([("2",), ("3",)], "id string"), hits).collect()} == {("1", 1), ("2", 0), ("3", 0)}
    assert [r["file_path"] for r in synthesis.uncovered(spark.createDataFrame([("a",), ("b",)], "file_path string"), spark.createDataFrame([("a",)], "file_path string")).collect()] == ["b"]
    paths = spark.createDataFrame([("x/build/generated/A.java",), ("x/A.java",)], "file_path string")
    assert [r["bucket"] for r in search.demoted_last(paths).collect()] == [1, 0]
    ranks = spark.createDataFrame([("a", 1.0, "utility"), ("b", 0.5, "primary")], "id string, rank double, tier string")
    assert [r["id"] for r in flows.next_steps(ranks.select("id"), ranks).collect()] == ["b", "a"]
    log = spark.createDataFrame([(1, "method_source", "m", "primary"), (2, "method_source", "m", None), (3, "other", "m", "utility")], "seq int, tool_name string, method_id string, tier string")
    assert [(r["tier"], r["n"], r["pct"]) for r in flows.tier_history(log).collect()] == [("primary", 1, 100.0)]
    calls = spark.createDataFrame([("a", "unresolved_receiver", "e"), ("getClass", "unresolved_receiver", None), ("a", "unresolved_receiver", "Err.x"), ("a", "unresolved_receiver", "errx"), ("a", "resolved", "e"), (None, None, None)], "c string, s string, r string")
    assert [r[0] for r in calls.select(rules.lambda_noise(F.col("c"), F.col("s"), F.col("r"))).collect()] == [True, True, True, False, False, False]
    r = spark.createDataFrame([('"a"', {"x": "T"}), ("x", {"x": "T"}), ("1.5f", None), ("0x1F", None), ("'c'", None), ("null", None), ("f(x)", {"x": "T"}), (None, None)], "a string, v map<string,string>")
    assert [x[0] for x in r.select(rules.argument_type(F.col("a"), F.col("v"))).collect()] == ["java.lang.String", "T", "double", "int", "char", "null", None, None]


def test_sinks_and_encoders(spark, tmp_path):
    from loomgraph.operators import rollups
    from loomgraph.sources import store

    state = spark.createDataFrame([("1", "resolved_exact", ["x", "y"]), ("2", "unresolved_method", []), ("3", "resolved_exact", ["x"])], "callsite_id string, status string, candidates array<string>")
    calls = spark.createDataFrame([("1", "a", "src/main/A.java"), ("2", "b", "src/test/B.java"), ("3", "b", "src/test/B.java")], "callsite_id string, caller_method_id string, file_path string")
    edges, sites = store.write_resolution(state, calls, str(tmp_path))
    assert {(r["src"], r["dst"], r["variant"]) for r in spark.read.parquet(edges).collect()} == {("a", "x", "main"), ("a", "y", "main"), ("b", "x", "test")}
    store.write_resolution(state.filter("callsite_id = '3'"), calls, str(tmp_path))
    assert spark.read.parquet(sites).count() == 2
    chunks = spark.createDataFrame([("d", 1, "x"), ("d", 2, "y"), ("e", 1, "z"), (None, 1, "n")], "path string, i int, text string")
    out = changes.replaced_groups(chunks, spark.createDataFrame([("d", 1, "new"), (None, 5, "m")], "path string, i int, text string"), ["path"])
    assert {tuple(r) for r in out.collect()} == {("d", 1, "new"), ("e", 1, "z"), (None, 5, "m")}
    e = spark.createDataFrame([("a", "b"), ("c", "d")], "src string, dst string")
    assert {tuple(r) for r in changes.replaced_edges(e, spark.createDataFrame([("a", "z"), ("c", "q")], "src string, dst string"), e.filter("src = 'a'").select("src")).collect()} == {("a", "z"), ("c", "d")}
    wanted = spark.createDataFrame([("1", "m", "h1", "ab"), ("2", "m", "h2", None), ("3", "m", "h3", "abc")], "method_id string, model string, text_hash string, payload string")
    have = spark.createDataFrame([("1", "m", "h1"), ("2", "m", "old")], "method_id string, model string, text_hash string")
    got = changes.embedded(wanted, have, lambda texts: [[len(t), 1.0] for t in texts], batch=1)
    assert {r["method_id"]: r["embedding"] for r in got.collect()} == {"2": [0.0, 1.0], "3": [3.0, 1.0]}
    assert changes.model_in_use(have).first()["model"] == "m" and changes.model_in_use(have.limit(0)).count() == 0
    paths = spark.createDataFrame([("./a/b/c.py",), ("a/b/d/e.py",), ("a\\\\x.py".replace("\\\\", "\\"),), ("z.py",), (None,)], "p string")
    assert tuple(rollups.majority_ancestor(paths, "p").first())[:2] == ("a", 3)
    assert rollups.majority_ancestor(paths.filter("p = 'z.py'"), "p").count() == 0
    lost = spark.createDataFrame([("1", "a", "save", "svc", "p.S", [], 3), ("2", "a", "info", "log", "L", [], 4), ("3", "b", "load", "svc", "p.S", ["x", "y"], 5), ("4", "b", "ok", "svc", "p.S", ["x"], 6)], "callsite_id string, caller_method_id string, callee_name string, receiver string, receiver_type string, candidates array<string>, line int")
    ranks = spark.createDataFrame([("a", "utility", 9.0), ("b", "primary", 1.0)], "id string, tier string, rank double")
    assert [r["callsite_id"] for r in reports.important_unresolved(lost, ranks).collect()] == ["3", "1"]
