"""Walks over graphs of short names in which nearly all reaches nearly all."""

import random
from collections import deque
from pathlib import Path

import numpy as np
import pytest

from loomgraph.operators import lookups, resolve, walks
from loomgraph.session import ensure_checkpoint_dir

N = 400
#: Each name leads to two others and reaches all within nine steps.
DENSE = [(f"p.C{j % N}", f"C{i}", "extends") for i in range(N) for j in (2 * i, 2 * i + 1)]


def plain(edges, start):
    far, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for y in edges.get(x, ()):
            if y not in far:
                far[y] = far[x] + 1
                todo.append(y)
    return far


def test_distances_against_plain_walks():
    rng = random.Random(1)
    for n, m in ((1, 0), (1, 1), (5, 3), (60, 70), (60, 400)):
        src, dst = (np.array([rng.randrange(n) for _ in range(m)], int) for _ in range(2))
        edges = {}
        for a, b in zip(src.tolist(), dst.tolist(), strict=True):
            edges.setdefault(a, []).append(b)
        g = walks.Graph(n, src, dst)
        got = g.distances([np.array([s], int) for s in range(n)])
        for s in range(n):
            assert {i: d for i, d in enumerate(got[s].tolist()) if d != walks.FAR} == plain(edges, s)
        assert (g.distances([np.arange(n), np.arange(0)]) == [[0] * n, [walks.FAR] * n]).all()


@pytest.fixture(scope="module")
def dense(spark):
    return spark.createDataFrame([(f"p.C{i}",) for i in range(N)], "full_name string"), spark.createDataFrame(DENSE, "source string, target string, relation string")


def stored(spark):
    ensure_checkpoint_dir(spark)
    return sum(p.stat().st_size for p in Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")).rglob("*") if p.is_file())


def test_what_implementations_reach_is_not_stored(spark, dense):
    before = stored(spark)
    assert lookups.implementations(*dense, transitive=True).count() == N * N
    assert stored(spark) - before < 200_000  # the result has 160,000 rows, the graph 800


def test_what_implementations_return_takes_little_disk(spark, tmp_path):
    rng = random.Random(3)
    owners = [f"{rng.getrandbits(1200):x}.X{i}" for i in range(4000)]  # 1.2 MB of names, more than a Parquet dictionary takes
    clauses = [(f"p.T{(i + 1) % 60}", f"T{i}", "extends") for i in range(60)] + [(o, f"T{rng.randrange(60)}", "extends") for o in owners]
    classes = spark.createDataFrame([(s,) for s, _, _ in clauses], "full_name string")
    lookups.implementations(classes, spark.createDataFrame(clauses, "source string, target string, relation string"), transitive=True).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).select("type", "implementer").distinct()
    assert got.count() == 60 * 4060
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 4_000_000  # 243,600 rows; the names alone are 1.2 MB


def test_parts_of_names(monkeypatch):
    monkeypatch.setattr(walks, "NAMES", 20)
    assert walks.parts([]) == []
    assert walks.parts(["a"] * 9) == [(0, 4), (4, 8), (8, 9)]
    assert walks.parts(["a"] * 9, 3) == [(0, 3), (3, 6), (6, 9)]
    assert walks.parts(["a", "b" * 30, "\u00e9" * 8, "c"]) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_implementations_in_parts(spark, dense, monkeypatch):
    rows = lambda: sorted(tuple(r) for r in lookups.implementations(*dense, transitive=True).collect())
    whole = rows()
    monkeypatch.setattr(walks, "NAMES", 1000)
    assert rows() == whole


def test_implementations_of_a_graph_too_large_for_a_task(spark, dense, monkeypatch):
    rows = lambda: {tuple(r) for r in lookups.implementations(*dense, transitive=True).collect()}
    at_hand = rows()
    monkeypatch.setattr(walks, "AT_HAND", 10)
    assert rows() == at_hand
    assert lookups.implementations(dense[0].limit(0), dense[1].limit(0), transitive=True).count() == 0


def test_embedded_calls_on_a_dense_graph(spark, dense, monkeypatch):
    rng = random.Random(2)
    names = [(f"{p}.C{i}", f"C{i}", p, []) for i in range(N) for p in (("p", "q") if i % 5 == 0 else ("p",))]
    classes = spark.createDataFrame(names, "full_name string, name string, package_name string, stereotypes array<string>")
    methods = [(f"m{k}", f"p.C{rng.randrange(N)}", f"run{k % 20}") for k in range(60)]
    calls = [(str(k), "p", f"run{rng.randrange(22)}", "x", f"C{rng.randrange(N + 3)}") for k in range(300)]
    c = spark.createDataFrame(calls, "callsite_id string, package_name string, callee_name string, receiver string, receiver_type string")
    m = spark.createDataFrame(methods, "id string, class_full_name string, method_name string")
    run = lambda: {r["callsite_id"]: r["candidates"] for r in resolve.embedded_cascade(c, m, classes, dense[1].select("source", "target")).collect()}
    before = stored(spark)
    got = run()
    assert stored(spark) - before < 200_000
    edges = {}
    for s, t, _ in DENSE:
        edges.setdefault(s, []).extend(n[0] for n in names if n[1] == t)
    for id_, _, callee, _, type_ in calls:
        want = set()
        for owner in (n[0] for n in names if n[1] == type_):
            far = plain(edges, owner)
            at = [(far[cls], i) for i, cls, name in methods if name == callee and cls in far]
            want |= {i for d, i in at if d == min(at)[0]}
        assert got[id_] == sorted(want)
    monkeypatch.setattr(walks, "AT_HAND", -1)
    assert run() == got
