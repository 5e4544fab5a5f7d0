"""SemanticDB documents, written here by hand."""

from loomgraph.sources import semanticdb as s


def field(number, value):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
            n >>= 7
            if not n:
                return out

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def symbol(name, kind, display, parents=()):
    signature = field(1, b"".join(field(2, field(2, field(2, p))) for p in parents))
    return field(5, field(1, name) + field(3, kind) + field(5, display) + field(17, signature))


def occurrence(name, line, role, column=2):
    return field(6, field(1, field(1, line) + field(2, column)) + field(2, name) + field(3, role))


DOCUMENT = field(1, field(2, "src/Shop.scala") + symbol("a/b/Shop#", 13, "Shop", ["a/b/Base#", "a/b/Api#"]) + symbol("a/b/Shop#run().", 3, "run") + symbol("a/b/Shop#load(+1).", 3, "load") + symbol("local0", 19, "x") + occurrence("a/b/Shop#", 0, 2) + occurrence("a/b/Shop#run().", 2, 2) + occurrence("a/b/Shop#load(+1).", 300, 2) + occurrence("a/b/Shop#load(+1).", 4, 1) + occurrence("a/b/Shop#load(+1).", 4, 1, 9) + occurrence("a/b/Shop#run().", 301, 1) + occurrence("scala/Int#", 4, 1) + occurrence("a/b/Shop#run().", 1, 1) + occurrence("local0", 4, 1))


def test_tables(spark):
    g = s.tables(s.parse(spark.createDataFrame([(bytearray(DOCUMENT),), (bytearray(b"\x0a\xff"),), (bytearray(b"plain text"),), (None,)], "content binary")))
    c = g["classes"].collect()
    assert [(r["full_name"], r["package_name"], r["file_path"], r["start_line"], r["stereotypes"]) for r in c] == [("a.b.Shop", "a.b", "src/Shop.scala", 1, ["class"])]
    m = {r["method_name"]: r for r in g["methods"].collect()}
    assert {(r["method_name"], r["class_full_name"], r["start_line"]) for r in m.values()} == {("run", "a.b.Shop", 3), ("load", "a.b.Shop", 301)}
    e = g["edges"].collect()
    assert sorted((r["src"] == m["run"]["id"], r["dst"] == m["load"]["id"], r["line"]) for r in e) == [(False, False, 302), (True, True, 5), (True, True, 5)]
    assert len({r["callsite_id"] for r in e}) == 3
    assert {(r["target"], r["relation"]) for r in g["inheritance"].collect()} == {("a.b.Base", "extends"), ("a.b.Api", "implements")}
