import random
from datetime import datetime as D

import pytest

from loomgraph.operators import hierarchy as h
from loomgraph.operators import skew


def brute(links):
    parent = dict(links)
    out = {}
    for node in parent:
        at, path, seen = node, [node], {node}
        while at in parent:
            at = parent[at]
            if at in seen:
                path = None
                break
            seen.add(at)
            path.append(at)
        out[node] = ("", -1, None) if path is None else (path[-1], len(path) - 1, path[::-1])
    return out


def random_links(seed):
    rng = random.Random(seed)
    n = 60
    links = {f"n{i}": f"n{rng.randint(max(0, i - 3), i + (1 if rng.random() < 0.05 else -1))}" for i in range(1, n)}
    return list(links.items())


@pytest.mark.parametrize("core", [0, 7, 4096])
@pytest.mark.parametrize("links", [[("a", "b")], [("a", "a")], [("a", "b"), ("b", "a"), ("c", "a"), ("d", "c")], [(f"x{i:03d}", f"x{i + 1:03d}") for i in range(40)], [(f"s{i}", "hub") for i in range(50)], random_links(1), random_links(2), []])
def test_against_walk(spark, monkeypatch, links, core):
    monkeypatch.setattr(h, "CORE", core)
    df = spark.createDataFrame(links + [(None, "q"), ("q", None)], "node string, parent string").selectExpr("*", "1 as depth", "2 as path")
    tree = h.hierarchy(df, paths=True, sizes=True).persist()
    got = {r["node"]: (r["root"], r["depth"], r["path"]) for r in tree.collect()}
    want = brute(links)
    assert got == want
    pairs = {(r["ancestor"], r["descendant"], r["distance"]) for r in h.descendants(tree).collect()}
    assert pairs == {(a, node, len(p) - 1 - i) for node, (_, _, p) in want.items() if p for i, a in enumerate(p[:-1])}
    below = {node: sum(a == node for a, _, _ in pairs) if p else None for node, (_, _, p) in want.items()}
    assert {r["node"]: r["below"] for r in tree.collect()} == below
    assert h.hierarchy(df).columns == ["node", "root", "depth"]


def test_hot_parents(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    monkeypatch.setattr(skew, "HOT_SHARE", 10)
    monkeypatch.setattr(h, "CORE", 3)
    links = [(f"s{i}", "hub") for i in range(60)] + [("hub", "top"), ("x", "s1"), ("y", "x")]
    df = spark.createDataFrame(links, "node string, parent string")
    assert skew.hot_keys(df, "parent") == ["hub"]
    got = {r["node"]: (r["root"], r["depth"]) for r in h.hierarchy(df).collect()}
    assert got == {k: v[:2] for k, v in brute(links).items()}


def test_class_links(spark):
    at, later = D(2024, 1, 1), D(2024, 2, 1)
    rows = [
        ("p.A", "p", "B", None, [], at, "1"),
        ("p.A", "p", " C<T> ", None, ["q.C"], later, "1"),
        ("p.B", "p", "", '["D[x]", "E"]', ["z.D", "y.D"], at, "2"),
        ("p.E", "p", " q.X [Y]", None, None, at, "3"),
        ("p.F", "p", "A<K, V>", "broken[", ["q.A"], at, "4"),
        ("p.G", None, "A", None, ["q.A"], at, "5"),
        ("p.H", "p", None, "[]", [], at, "6"),
        ("p.I", "p", "  ", '[" p.A "]', [], None, "7"),
        (None, "p", "A", None, [], at, "8"),
    ]
    df = spark.createDataFrame(rows, "full_name string, package_name string, extends string, implements_json string, imports array<string>, indexed_at timestamp, id string")
    got = {r["node"]: r["parent"] for r in h.class_links(df).collect()}
    assert got == {"p.A": "q.C", "p.B": "z.D", "p.E": "q.X", "p.F": "p.A", "p.G": "q.A", "p.I": "p.A"}
    assert h.class_links(df.limit(0)).count() == 0
