from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import splitting


def check(text, limit, overlap):
    pieces = splitting.cuts(text, limit, overlap)
    assert all(b - a <= limit for a, b in pieces)
    assert all(later[0] == earlier[1] - overlap for earlier, later in zip(pieces, pieces[1:], strict=False))
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text("ab .\n!。\r", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_any_text(text, limit, overlap):
    check(text, limit, overlap)


def test_natural_boundaries():
    text = "One two three. Four five six.\n\nSeven eight nine. Ten eleven."
    a, b = check(text, 40, 5)[0]
    assert text[a:b].endswith("\n\n")
    assert check("x" * 100, 40, 10)[0] == (0, 40)
    words = "word " * 30
    assert all(words[b - 1] == " " for _, b in check(words, 40, 5)[:-1])


def test_chunks_and_sources(spark):
    long = "Sentence number one is here. " * 200
    rows = [
        ("a", "s1", "md", "T", "short", "X", 0, 10),
        ("b", "s1", "md", None, long, "", 1, 20),
        ("b", "s1", "md", None, "old", "", 1, 5),
        ("b", "s1", "md", None, long, "", 1, 20),
        ("c", "s1", "md", None, None, None, 2, 7),
        ("d", "s2", "md", None, "😀" * 3000, None, None, None),
        ("e", None, None, None, "", None, 0, 1),
    ]
    chunks = spark.createDataFrame(rows, "id string, source_path string, source_type string, title string, content string, linked_classes string, chunk_index int, ts long").selectExpr("*", "1 as piece", "2 as _rank")
    got = splitting.split_chunks(chunks).collect()
    b = sorted((r for r in got if r["id"] == "b"), key=lambda r: r["piece"])
    assert len(b) > 1 and all(len(r["content"]) <= 3000 for r in b)
    assert all(later["content"].startswith(earlier["content"][-200:]) for earlier, later in zip(b, b[1:], strict=False))
    s1 = sorted(r["chunk_index"] for r in got if r["source_path"] == "s1")
    assert s1 == list(range(len(s1))) and [r["chunk_index"] for r in b] == list(range(1, 1 + len(b)))
    assert len([r for r in got if r["id"] == "d"]) == 1 and len([r for r in got if r["id"] == "e"]) == 1
    sources = spark.createDataFrame([("s1", "md", "S", 99, 5), ("gone", "md", "G", 3, 5), ("s1", "md", "old", 1, 1)], "source_path string, source_type string, title string, chunk_count int, indexed_at long")
    counts = {r["source_path"]: r["chunk_count"] for r in splitting.corrected_sources(sources, splitting.split_chunks(chunks)).collect()}
    assert counts == {"s1": len(s1), "s2": 1, "gone": 0, None: 1}
    assert splitting.split_chunks(chunks.limit(0)).count() == 0
