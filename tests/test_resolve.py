"""The resolution cascade where names are popular and hierarchies deep."""

import pytest

from loomgraph.operators import resolve, traversal
from loomgraph.operators import code_graph as cg

CALLS = "callsite_id string, caller_method_id string, callee_name string, receiver string, receiver_type string, argument_count int, argument_types array<string>"
METHODS = "id string, class_full_name string, method_name string, parameter_types array<string>"
CLASSES = "id string, full_name string, package_name string, extends string, implements_json string, imports array<string>"


@pytest.fixture(scope="module")
def resolved(spark):
    def run(calls, methods, classes):
        c = spark.createDataFrame(classes, CLASSES)
        out = resolve.resolve(spark.createDataFrame(calls, CALLS), spark.createDataFrame(methods, METHODS), c, cg.inheritance_edges(c))
        return {r["callsite_id"]: (r["status"], r["candidates"]) for r in out.collect()}

    return run


def test_all_methods_of_a_name(resolved):
    classes = [(f"c{i}", f"p.C{i}", "p", None, None, []) for i in range(4)]
    methods = [("m0", "p.C0", "start", []), ("m1", "p.C1", "save", ["String"]), ("m2", "p.C2", "save", ["Integer"]), ("m3", "p.C3", "save", [])]
    calls = [("one", "m0", "save", None, None, 1, [None]), ("any", "m0", "save", None, None, -1, []), ("null", "m0", "save", "this", None, None, None), ("zero", "m0", "save", None, None, 0, []), ("none", "m0", "load", None, None, -1, [])]
    assert resolved(calls, methods, classes) == {
        "one": ("ambiguous_global_name_arity", ["m1", "m2"]),
        "any": ("ambiguous_global_name_arity", ["m1", "m2", "m3"]),
        "null": ("ambiguous_global_name_arity", ["m1", "m2", "m3"]),
        "zero": ("candidate_global_name_arity", ["m3"]),
        "none": ("unresolved_method", []),
    }


def test_parents_by_short_name_and_deep_chains(spark, resolved):
    chain = [(f"c{i}", f"p.C{i}", "p", f"C{i + 1}" if i < 25 else None, None, []) for i in range(26)]
    classes = [*chain, ("d", "q.D", "q", "Far<String>", '["Kind", "Flag"]', ["r.Far", "s.*"]), ("e", "r.Far", "r", None, None, []), ("f", "q.Kind", "q", None, None, []), ("g", "s.Flag", "s", None, None, []), ("h", "Bare", "", "C0", None, [])]
    inh = cg.inheritance_edges(spark.createDataFrame(classes, CLASSES))
    full = resolve.resolved_parents(spark.createDataFrame(classes, CLASSES), inh)
    assert {(r["target"], r["relation"]) for r in full.filter("source = 'q.D'").collect()} == {("r.Far", "extends"), ("q.Kind", "implements"), ("s.Flag", "implements")}
    assert [r["target"] for r in full.filter("source = 'Bare'").collect()] == ["C0"]
    methods = [("m0", "p.C0", "start", []), ("m1", "p.C25", "stop", []), ("m2", "q.D", "run", []), ("m3", "r.Far", "go", []), ("m4", "s.Flag", "wave", [])]
    calls = [("deep", "m0", "stop", None, None, 0, []), ("far", "m2", "go", None, None, 0, []), ("flag", "m2", "wave", None, None, 0, []), ("typed", "m2", "stop", "x", "p.C0", 0, [])]
    assert resolved(calls, methods, classes) == {
        "deep": ("resolved_inherited", ["m1"]),
        "far": ("resolved_inherited", ["m3"]),
        "flag": ("resolved_inherited", ["m4"]),
        "typed": ("resolved_inherited", ["m1"]),
    }


def test_fan_out_and_imports_of_any_depth(spark):
    methods = spark.createDataFrame([("a", "C0", "stop", "M0"), ("b", "C22", "stop", "M22")], "id string, class_full_name string, method_name string, module_id string")
    links = [(f"C{i + 1}", f"C{i}", f"M{i}", f"M{i + 1}") for i in range(22)]
    inh = spark.createDataFrame([(s, t) for s, t, _, _ in links], "source string, target string")
    hits = spark.createDataFrame([("k", "x", ["a"])], "callsite_id string, status string, candidates array<string>")
    assert resolve.hierarchy_fan_out(hits, methods, inh).first()["candidates"] == ["a", "b"]
    imports = spark.createDataFrame([(a, b) for _, _, a, b in links], "src string, dst string")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert resolve.reachable_imports(edges, methods, imports).count() == 1


def test_doubling_gives_the_closure(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (0, 3), (4, 2), (7, 7)], "src int, dst int")
    assert sorted(map(tuple, traversal.deep_closure(e).collect())) == sorted(map(tuple, traversal.closure(e).collect()))


FULL_CALLS = CALLS + ", text string, line int, column_no int, file_path string"
FULL_METHODS = METHODS + ", return_type string, parameter_names array<string>, local_variable_types map<string,string>"
FIELDS = "class_full_name string, name string, type_name string"


def test_the_whole_cascade(spark):
    classes = [
        ("1", "p.Main", "p", None, None, []),
        ("2", "p.Repo", "p", None, None, []),
        ("3", "p.RepoImpl", "p", None, '["Repo"]', []),
        ("4", "p.Outer$Inner", "p", None, None, []),
        ("5", "p.Base", "p", "Lib", None, []),
        ("6", "p.Child", "p", "Base", None, []),
        ("7", "q.Lib", "q", None, None, []),
        ("8", "p.GateImpl", "p", None, None, []),
        ("9", "p.Solo", "p", None, '["Runnable"]', []),
    ]
    m = lambda id_, cls, name, types=(), ret=None, names=(), local=None: (id_, cls, name, list(types), ret, list(names), local)
    methods = [
        m("main", "p.Main", "main", ["Repo"], None, ["repo"], {"child": "Child"}),
        m("find", "p.RepoImpl", "find", ["int"], "Child"),
        m("in", "p.Outer$Inner", "go"),
        m("baseSave", "p.Base", "store", ["int"]),
        m("childSave", "p.Child", "store", ["int"]),
        m("lib", "q.Lib", "load", ["int", "int"]),
        m("open", "p.GateImpl", "open"),
        m("only", "p.Solo", "perform", ["int"]),
    ]
    fields = [("p.Main", "base", "Base"), ("p.Base", "inner", "Outer.Inner"), ("p.Main", "gate", "Gate")]
    calls = [
        ("chain", "main", "store", "repo.find(1)", None, 1, [], "repo.find(1).store(2)", 2, 1, "a.java"),
        ("inner_of_chain", "main", "find", "repo", "Repo", 1, [], "repo.find(1)", 2, 1, "a.java"),
        ("nested", "main", "go", "x", "Outer.Inner", 0, [], "x.go()", 3, 1, "a.java"),
        ("dotted", "main", "go", "this.base.inner", None, 0, [], "t", 4, 1, "a.java"),
        ("dotted_child", "main", "store", "child.y", None, 1, [], "t", 4, 2, "a.java"),
        ("wide", "main", "store", "b", "Base", 1, [], "b.store(1)", 5, 1, "a.java"),
        ("relaxed", "main", "load", "c", "Child", 1, [], "c.load(1)", 6, 1, "a.java"),
        ("global", "main", "parse", "JSON", None, 1, [], "JSON.parse(x)", 7, 1, "a.ts"),
        ("hook", "main", "useThing", None, None, 0, [], "useThing()", 7, 2, "a.tsx"),
        ("not_a_script", "main", "parse", "JSON", None, 1, [], "JSON.parse(x)", 7, 3, "a.java"),
        ("suffix", "main", "open", "gate", None, 0, [], "gate.open()", 8, 1, "a.java"),
        ("dispatch", "main", "perform", "z", None, 1, [], "z.perform(1)", 9, 1, "a.java"),
    ]
    c = spark.createDataFrame(classes, CLASSES)
    out = resolve.resolve_all(spark.createDataFrame(calls, FULL_CALLS), spark.createDataFrame(methods, FULL_METHODS), c, cg.inheritance_edges(c), spark.createDataFrame(fields, FIELDS))
    got = {r["callsite_id"]: (r["status"], r["candidates"]) for r in out.collect()}
    assert got["inner_of_chain"] == ("resolved_via_sole_implementation", ["find"])
    assert got["chain"] == ("resolved_same_package", ["childSave"])
    assert got["nested"] == ("resolved_exact", ["in"])
    assert got["dotted"] == ("resolved_exact", ["in"])
    assert got["dotted_child"][0] == "unresolved_receiver"
    assert got["wide"] == ("resolved_cha", ["baseSave", "childSave"])
    assert got["relaxed"] == ("resolved_inherited", ["lib"])
    assert got["global"][0] == got["hook"][0] == "external_library"
    assert got["not_a_script"][0] == "unresolved_receiver"
    assert got["suffix"] == ("resolved_impl_suffix", ["open"])
    assert got["dispatch"] == ("resolved_interface_dispatch_fallback", ["only"])
    assert set(got) == {r[0] for r in calls}


def test_cascades_of_other_languages(spark):
    names = "full_name string, name string, package_name string, stereotypes array<string>"
    classes = spark.createDataFrame([("k.Store", "Store", "k", []), ("k.Base", "Base", "k", []), ("k.Deep", "Deep", "k", []), ("k._functions", "_functions", "k", ["module"])], names)
    methods = spark.createDataFrame([("s", "k.Store", "Put", []), ("b", "k.Base", "Get", []), ("d", "k.Deep", "Get", []), ("d2", "k.Deep", "Close", []), ("f", "k._functions", "New", [])], METHODS)
    embeds = spark.createDataFrame([("k.Store", "Base"), ("k.Base", "Deep"), ("k.Deep", "Store")], "source string, target string")
    calls = [("1", "k", "k.Store", "Put", "s", "Store"), ("2", "k", "k.Store", "Get", "s", "x.Store"), ("3", "k", "k.Store", "Close", "s", "Store"), ("4", "k", "k.Store", "New", None, None), ("5", "k", "k.Store", "Gone", "s", "Store"), ("6", "k", "k.Store", "Put", None, None)]
    c = spark.createDataFrame(calls, "callsite_id string, package_name string, caller_class string, callee_name string, receiver string, receiver_type string")
    got = {r["callsite_id"]: (r["status"], r["candidates"]) for r in resolve.embedded_cascade(c, methods, classes, embeds).collect()}
    assert got == {"1": ("resolved_exact", ["s"]), "2": ("resolved_exact", ["b"]), "3": ("resolved_exact", ["d2"]), "4": ("resolved_exact", ["f"]), "5": ("unresolved", []), "6": ("unresolved", [])}
    got = {r["callsite_id"]: (r["status"], r["candidates"]) for r in resolve.owner_cascade(c, methods, classes).collect()}
    assert got["1"] == ("resolved_exact", ["s"]) and got["2"] == ("unresolved", []) and got["6"] == ("resolved_exact", ["s"])


def test_beans_and_phantoms(spark):
    classes = spark.createDataFrame([("a.S", ["@Service"]), ("a.C", ["@Configuration"]), ("a.P", []), (None, ["@Service"])], "full_name string, annotations array<string>")
    methods = spark.createDataFrame([("a.C", ["@Bean"], "b.Made"), ("a.C", ["@Bean"], "void"), ("a.P", ["@Bean"], "b.Other"), ("a.C", None, "b.No")], "class_full_name string, annotations array<string>, return_type string")
    beans = resolve.static_beans(classes, methods)
    assert {r[0] for r in beans.collect()} == {"a.S", "a.C", "b.Made"}
    calls = spark.createDataFrame([("1", "x", None, ["p"]), ("2", "x", None, ["p", "q"]), ("3", "unresolved_receiver", "a.S", []), ("4", "unresolved_receiver", "z", [])], "callsite_id string, status string, type string, candidates array<string>")
    kept = resolve.without_phantoms(calls, spark.createDataFrame([("p",), ("p",)], "dst string"), beans)
    assert {tuple(r) for r in kept.collect()} == {("2", "x"), ("3", "actuator_resolved"), ("4", "unresolved_receiver")}
