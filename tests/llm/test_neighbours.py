import numpy as np
import pytest

from loomgraph.llm import neighbours as nb

SCHEMA = "method_id string, variant string, model string, embedding array<float>, created_at timestamp, cosine string"


def rows_of(x, model="m", prefix=""):
    return [(f"{prefix}{i:05d}", "main", model, [float(v) for v in r], None, "extra") for i, r in enumerate(x)]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    return (rng.normal(size=(60, 24))[rng.integers(0, 60, 3000)] + 0.35 * rng.normal(size=(3000, 24))).astype(np.float32)


def exact(x, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s, np.sort(s, axis=1)[:, -k]


def recall(got, x):
    s, kth = exact(x)
    return sum(s[int(r["method_id"]), int(r["neighbour"])] >= kth[int(r["method_id"])] - 1e-4 for r in got) / (5 * len(x))


def test_recall_against_brute_force(spark, clustered):
    got = nb.neighbours(spark.createDataFrame(rows_of(clustered), SCHEMA)).collect()
    assert len(got) == 5 * len(clustered)
    assert recall(got, clustered) >= 0.9
    s, _ = exact(clustered)
    assert max(abs(s[int(r["method_id"]), int(r["neighbour"])] - r["cosine"]) for r in got) < 1e-3


def test_split_regions_give_the_same(spark, clustered, monkeypatch):
    monkeypatch.setattr(nb, "REGION", 800)
    monkeypatch.setattr(nb, "MOST_QUERIES", 300)
    monkeypatch.setattr(nb, "MOST_STORED", 700)
    got = nb.neighbours(spark.createDataFrame(rows_of(clustered), SCHEMA)).collect()
    assert len(got) == 5 * len(clustered) and recall(got, clustered) >= 0.9


def test_copies_and_bad_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    rows = rows_of(x) + [(f"c{i:03d}", "main", "m", [1.0] * 8, None, None) for i in range(30)]
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0] * 4, [0.0] * 8, [nan] * 8, [inf] + [1.0] * 7, [None] + [1.0] * 7]
    rows += [(f"b{i}", "main", "m", v, None, None) for i, v in enumerate(bad)] + [(None, "main", "m", [1.0] * 8, None, None)]
    got = nb.neighbours(spark.createDataFrame(rows, SCHEMA)).collect()
    asked = {r["method_id"] for r in got}
    assert len(asked) == 70 and not any(i.startswith("b") for i in asked)
    for i in (r["method_id"] for r in rows_and(got, "c")):
        near = [r for r in got if r["method_id"] == i]
        assert len(near) == 5 and all(r["neighbour"].startswith("c") and r["neighbour"] != i for r in near)
    assert len({(r["method_id"], r["neighbour"]) for r in got}) == len(got) == 350


def rows_and(got, prefix):
    return [r for r in got if r["method_id"].startswith(prefix)]


def test_latest_row_counts_and_pairs(spark):
    from datetime import datetime

    old, new = datetime(2024, 1, 1), datetime(2024, 2, 1)
    rows = [("a", "v", "m", [1.0, 0.0], new, ""), ("a", "v", "m", [0.0, 1.0], old, ""), ("b", "v", "m", [0.9, 0.1], None, ""), ("c", "v", "m", [0.0, 1.0], None, ""), ("a", "v", "other", [1.0, 1.0, 1.0], None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = nb.similar_pairs(nb.neighbours(df), df, 0.92).collect()
    assert [(r["method_id_a"], r["method_id_b"]) for r in got] == [("a", "b")]
    assert nb.neighbours(df.limit(0)).count() == 0


def test_codes_rebuild_vectors():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = nb.fit(x, len(x))
    codes, norms, near = nb.encode(x[:500], c)
    made = sum(level[codes[:, i]] for i, level in enumerate([c.cells, *c.books]))
    assert np.allclose(np.linalg.norm(made, axis=1), norms, atol=1e-3)
    assert ((made - x[:500]) ** 2).sum(1).mean() < 0.15 and near.shape[1] == c.probes


def test_similar_pairs_of_noise_need_few_cells(spark, monkeypatch):
    """Vectors without structure share cells with their nearest only if listed in hundreds; pairs at a high cosine don't."""
    monkeypatch.setattr(nb, "PER_CELL", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(600):  # pairs at cosines from 0.91 to 1
        u = rng.normal(size=48)
        u -= (u @ x[i]) * x[i]
        c = 0.91 + 0.09 * i / 600
        x[5000 + i] = c * x[i] + (1 - c * c) ** 0.5 * u / np.linalg.norm(u)
    assert nb.fit(x, len(x)).probes > 100
    assert all(nb.fit(x[:n], n, least=0.919).probes <= 32 for n in (1500, 3000, 6000))
    df = spark.createDataFrame(rows_of(x), SCHEMA)
    got = {(r["method_id_a"], r["method_id_b"]) for r in nb.similar_pairs(nb.neighbours(df, least=0.919), df, 0.92).collect()}
    s, _ = exact(x)
    want = {(f"{i:05d}", f"{j:05d}") for i, j in zip(*np.nonzero(s >= 0.92), strict=True) if i < j}
    assert got <= want and len(got) >= 0.99 * len(want) > 500


def test_least_cosine_leaves_of_the_nearest_what_reaches_it(spark, monkeypatch):
    """Crowds of near and of equal vectors, with regions split by query and stored vector: as the five nearest, filtered."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(40, 24)), 12, axis=0) + 0.25 * rng.normal(size=(480, 24))
    x = np.vstack([x, np.repeat(x[:3], 9, axis=0)]).astype(np.float32)
    df = spark.createDataFrame(rows_of(x), SCHEMA)
    want = nb.neighbours(df).filter("cosine >= 0.9").collect()
    monkeypatch.setattr(nb, "MOST_QUERIES", 100)
    monkeypatch.setattr(nb, "MOST_STORED", 200)
    got = nb.neighbours(df, least=0.9).collect()
    key = lambda rows: sorted((r["method_id"], r["neighbour"], round(r["cosine"], 4)) for r in rows)
    assert key(got) == key(want) and len(got) > 500
