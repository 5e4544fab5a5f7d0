"""Whole-corpus encoding with a public byte-level BPE vocabulary.

Texts are cut into pre-tokens by the vocabulary's pattern. Each distinct pre-token is merged once per Python worker by
a *hierarchical-bitmap rank queue*: one bucket of linked-list positions per merge rank, a bitmap over the buckets that
are not empty and a second bitmap over the words of the first, so that find-first-set gives the lowest rank in a
constant number of steps. Entries whose pair has changed since they were queued are skipped when they come up. The
work is O(n log n) in the length of the pre-token, so megabyte-long pre-tokens (base64, one letter repeated) are safe.

Defined results: an empty text and a null text have no ids (an empty list); every other text, of any length, is taken
whole and as stored. Special-token strings in a text are ordinary text. Repeated rows are each encoded. Extra columns
pass through :func:`encode` untouched, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pre-tokens longer than this are merged but not remembered.
CACHED_LENGTH = 64
#: A worker forgets its merged pre-tokens when it holds so many.
CACHED_ENTRIES = 400_000


def default_vocabulary() -> str:
    """Path of ``byte_bpe_50k`` among the installed public tokenizers."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _ranges(test, most: int) -> str:
    """The code points up to ``most`` for which ``test(category)`` holds, as the inside of a character class."""
    out, start = [], None
    for cp in range(most + 2):
        inside = cp <= most and test(unicodedata.category(chr(cp)))
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return "".join(out)


#: Unicode's White_Space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@cache
def pattern(most: int) -> re.Pattern:
    """The pre-token pattern of the vocabulary for texts without code points above ``most``, with letters, numbers and
    white space as explicit Unicode ranges. Only character sets that end at U+FFFF are matched by table."""
    letter, number = _ranges(lambda c: c[0] == "L", most), _ranges(lambda c: c[0] == "N", most)
    return re.compile(f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[^{_SPACE}{letter}{number}]+| ?[{number}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def _stand_in(match: re.Match) -> str:
    """A BMP character of the same class as one beyond, for which the pattern cuts alike."""
    kind = unicodedata.category(match[0])[0]
    return "\u4e00" if kind == "L" else "\u00bd" if kind == "N" else "\ue000"


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def pre_tokens(text: str) -> list[str]:
    if text.isascii():
        return pattern(0x7F).findall(text)
    find = pattern(0xFFFF)
    if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text):
        return find.findall(text)
    return [text[m.start() : m.end()] for m in find.finditer(_ASTRAL.sub(_stand_in, text))]


class RankQueue:
    """Positions by merge rank; the lowest rank first, within a rank the leftmost position."""

    WORD = 256

    __slots__ = ("buckets", "words", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        word, bit = divmod(rank, self.WORD)
        self.words[word] = self.words.get(word, 0) | 1 << bit
        self.top |= 1 << word

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        bit = (bits & -bits).bit_length() - 1
        rank = word * self.WORD + bit
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            bits &= bits - 1
            self.words[word] = bits
            if not bits:
                self.top = top & (top - 1)
        return rank, position


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue, get = RankQueue(), ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            queue.push(rank, i)
    while (entry := queue.pop()) is not None:
        rank, i = entry
        left = parts[i]
        j = after[i]
        if left is None or j >= n:
            continue
        pair = left + parts[j]
        if get(pair) != rank:  # stale: one side has grown since
            continue
        parts[i], parts[j] = pair, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = get(pair + parts[k])
            if rank is not None:
                queue.push(rank, i)
        h = before[i]
        if h >= 0:
            rank = get(parts[h] + pair)
            if rank is not None:
                queue.push(rank, h)
    return [ranks[p] for p in parts if p is not None]


class Encoder(dict):
    """Maps pre-tokens to their ids, packed as 32-bit integers, merging what it hasn't seen."""

    def __init__(self, vocabulary: bytes) -> None:
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}

    def __missing__(self, piece: str) -> bytes:
        ids = array("i", merge(piece.encode("utf-8", "surrogatepass"), self.ranks)).tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids

    def packed(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, pre_tokens(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(vocabulary: bytes) -> Encoder:
    """One encoder per worker process and vocabulary, so that later tasks find it warm."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def _apply(df: DataFrame, text: str, out: str, counted: bool, vocabulary: str | None) -> DataFrame:
    if out in df.columns:
        raise ValueError(f"column {out} exists already")
    at = df.columns.index(text)
    # A vocabulary is one file of bounded size (under 1 MB for 50,000 ids).
    shared = df.sparkSession.sparkContext.broadcast(Path(vocabulary or default_vocabulary()).read_bytes())
    result = T.LongType() if counted else T.ArrayType(T.IntegerType(), containsNull=False)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = encoder_of(shared.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if counted:
                made = pa.array([len(encoder.packed(t)) // 4 for t in texts], pa.int64())
            else:
                packed = [encoder.packed(t) for t in texts]
                values = b"".join(packed)
                offsets = array("i", accumulate((len(p) // 4 for p in packed), initial=0))
                ids = pa.Array.from_buffers(pa.int32(), len(values) // 4, [None, pa.py_buffer(values)])
                made = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)]), ids)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, result, False)]))


def encode(df: DataFrame, text: str = "text", out: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``df`` with the token ids of ``text`` in ``out``; a narrow step, no shuffle."""
    return _apply(df, text, out, False, vocabulary)


def count_tokens(df: DataFrame, text: str = "text", out: str = "tokens", vocabulary: str | None = None) -> DataFrame:
    """``df`` with the number of token ids of ``text`` in ``out``."""
    return _apply(df, text, out, True, vocabulary)
