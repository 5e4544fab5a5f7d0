"""Queries over small tables, held against brute force: nothing is left out."""

import random

import pytest

from loomgraph.plans import QUERIES


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def calls(spark, tmp_path_factory):
    """A folder with 40 methods of ids of any prefix, every fifth an endpoint, and the edges among them."""
    folder, r = tmp_path_factory.mktemp("graph"), random.Random(7)
    names = [f"{r.randrange(16):x}{i:02d}" for i in range(40)]
    edges = sorted({(r.choice(names[:30]), r.choice(names)) for _ in range(60)})
    sites = [(f"k{i}", a, f'["{b}"]', i) for i, (a, b) in enumerate(edges)]
    spark.createDataFrame(sites, "id string, caller_method_id string, resolved_candidates_json string, line int").write.parquet(str(folder / "callsites.parquet"))
    spark.createDataFrame([(x, i % 5 == 0) for i, x in enumerate(names)], "id string, is_endpoint boolean").write.parquet(str(folder / "methods.parquet"))
    return str(folder), edges, set(names[::5])


def reach(edges, start, most):
    depth, frontier = {}, {start}
    for hop in range(1, most + 1):
        frontier = {b for a, b in edges if a in frontier} - depth.keys()
        depth |= dict.fromkeys(frontier, hop)
    return depth


def test_reach_of_all_callers(spark, calls):
    folder, edges, _ = calls
    want = {a: reach(edges, a, 4) for a, _ in edges}
    assert rows(QUERIES["graph_closure_all"](spark, folder)) == sorted((a, b, d) for a, w in want.items() for b, d in w.items())
    got = {r["id"]: r["sinks"] for r in QUERIES["graph_sinks_all"](spark, folder).collect()}
    assert got == {a: len(w.keys() - want.keys()) for a, w in want.items()}


def test_walks_from_all_endpoints(spark, calls):
    folder, edges, ends = calls
    seeds = ends & {a for a, _ in edges}
    near = [reach(edges, a, 3) for a in seeds]
    want = {b: min(n.get(b, 9) for n in near) for b in {b for n in near for b in n}} | dict.fromkeys(seeds, 0)
    assert rows(QUERIES["graph_levels"](spark, folder)) == sorted(want.items())
    assert {(r["id"], r["path"].count(">")) for r in QUERIES["graph_shortest_paths"](spark, folder).collect()} == set(want.items())
    called = ends & {b for _, b in edges}
    back = [(b, a) for a, b in edges]
    up = {x for s in called for x in reach(back, s, 3)} - called
    assert {r["id"] for r in QUERIES["graph_callers"](spark, folder).collect()} == up
    assert rows(QUERIES["join_touching"](spark, folder)) == [e for e in edges if ends & set(e)]


def test_search_asks_with_all_queries(spark, tmp_path, monkeypatch):
    from loomgraph.operators import search

    monkeypatch.setattr(search, "BLOCK", 30)
    monkeypatch.setattr(search, "ASKED", 2)
    r = random.Random(3)
    data = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(100)]
    spark.createDataFrame(data, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {(q, i) for q, a in data if q % 20 == 0 for i in sorted(range(100), key=lambda i: -dot(a, data[i][1]) / dot(data[i][1], data[i][1]) ** 0.5)[:10]}
    assert {(x["query"], x["id"]) for x in QUERIES["search_dense_all"](spark, str(tmp_path)).collect()} == want
