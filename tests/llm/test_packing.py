import random
from collections import Counter

import pytest

from loomgraph.llm import packing


@pytest.mark.parametrize("sizes", [(100,), (30, 60, 100)])
def test_plan_holds_every_item_once(sizes):
    rng = random.Random(3)
    histogram = Counter(rng.randint(1, 100) for _ in range(5000))
    runs = packing.plan(dict(histogram), sizes)
    held = Counter()
    for count, capacity, contents in runs:
        assert capacity in sizes and sum(s * n for s, n in contents) <= capacity
        for s, n in contents:
            held[s] += count * n
    assert held == histogram
    total, room = sum(s * n for s, n in histogram.items()), sum(c * k for c, k, _ in runs)
    assert total / room > 0.97


def test_small_cases_as_well_as_brute_force():
    assert sum(c for c, _, _ in packing.plan({6: 2, 4: 2}, (10,))) == 2
    assert packing.plan({}, (10,)) == []
    # one item that a small container holds opens the small one
    assert packing.plan({3: 1}, (4, 10)) == [(1, 4, [(3, 1)])]


def test_pack(spark):
    rng = random.Random(7)
    rows = [(i, rng.randint(1, 60)) for i in range(300)] + [(1000, 250), (1001, 0), (1002, None), (1003, 0), (5, 10)]
    got = packing.pack(spark.createDataFrame(rows, "k long, n long"), "k", "n", (100,), (25, 50)).collect()
    by = {}
    for r in got:
        if r["size"]:
            by.setdefault(r["container"], []).append(r)
    for rs in by.values():
        used = sum(r["size"] for r in rs)
        assert used == rs[0]["used"] <= rs[0]["fitted_capacity"] <= 100
        assert rs[0]["fitted_capacity"] == next(c for c in (25, 50, 100) if c >= used)
    assert sorted(r["size"] for r in got if r["k"] == 1000) == [50, 100, 100]
    assert sum(r["size"] for r in got) == sum(n or 0 for _, n in rows)
    assert Counter(r["k"] for r in got if r["k"] != 1000) == Counter(k for k, _ in rows if k != 1000)
    assert all(r["container"] is not None for r in got)
    assert packing.pack(spark.createDataFrame([], "k long, n long"), "k", "n").count() == 0


def test_ranks_over_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 10)
    got = packing.pack(spark.range(200).selectExpr("id as k", "50 as n"), "k", "n", (100,)).collect()
    assert Counter(Counter(r["container"] for r in got).values()) == {2: 100}
