import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import bpe


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.default_vocabulary(), "rb") as f:
        return bpe.Encoder(f.read())


@pytest.fixture(scope="module")
def public():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


HARD = ["", " ", "a" * 5000, "ab" * 3000, "　\x1c\x1d x\x85y", "x" * 100 + " " * 3000 + "y", "ΑΒΓ १२३ ½ ²", "'S 's'll''re don't", "\r\n\r\n \t\n x", "😀😀👩‍👩‍👧 𝒜𝓑 𝟘𝟙", "<|endoftext|>", "\x00\x01", "日本語のテキスト。"]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts_as_public_tokenizer(encoder, public, text):
    assert encoder.encode(text) == public.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=200))
def test_any_text_as_public_tokenizer(encoder, public, text):
    assert encoder.encode(text) == public.encode(text, add_special_tokens=False).ids


def test_merge_against_brute_force(encoder):
    rng = random.Random(5)
    for _ in range(200):
        piece = bytes(rng.choice(b"aberst \xc3\xa9in") for _ in range(rng.randint(1, 40)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((encoder.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in encoder.ranks), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        want = [encoder.ranks[piece]] if piece in encoder.ranks else [encoder.ranks[p] for p in parts]
        assert bpe.merge(piece, encoder.ranks) == want


def test_rank_queue_orders_by_rank_then_position():
    q = bpe.RankQueue()
    entries = [(70_000, 3), (5, 9), (5, 2), (256, 1), (0, 4)]
    for e in entries:
        q.push(*e)
    assert [q.pop() for _ in entries] == sorted(entries)
    assert q.pop() is None


def test_table(spark):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", None), (1, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    got = bpe.encode(df).collect()
    assert [len(r["ids"]) for r in got] == [2, 0, 0, 2] and got[0]["tokens"] == "x"
    assert [r["n"] for r in bpe.count_tokens(df, out="n").collect()] == [2, 0, 0, 2]
    with pytest.raises(ValueError):
        bpe.count_tokens(df)
    assert bpe.encode(df.limit(0)).count() == 0
