"""Splitting items that exceed a size limit at natural boundaries, with overlap.

Method: token offsets are prefix sums over the lengths of the tokens (words, white space, marks); the boundaries among
them lie in sorted arrays, one per kind: paragraph, line, sentence, word. For each piece the last boundary under the
limit is found by binary search; a better kind wins if its boundary leaves the piece at least half full. The next piece
starts the overlap before the cut. Where no boundary lies beyond the overlap, the piece is cut hard at the limit.

Defined results: lengths are counted in Unicode code points of the text as stored; a null or short text stays one piece
(its content null or unchanged); of the rows of one id the one with the greatest ``ts`` counts, null ``ts`` being least
(ties: the greatest content, then the greatest remaining fields, so repeated rows collapse); a source without any row of
its own gets one; an empty table gives none. Only the named columns are read, so extra columns with any names are safe.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rollups import ranked

LIMIT, OVERLAP = 3000, 200

_TOKEN = re.compile(r"\w+|\s+|[^\w\s]")
_SENTENCE_END = frozenset(".!?…。！？")


def boundaries(text: str) -> list[list[int]]:
    """Sorted offsets before which the text may be cut: paragraphs, lines, sentences, words."""
    paragraphs, lines, sentences, words = [], [], [], []
    offset, last = 0, ""
    for token in _TOKEN.findall(text):
        offset += len(token)  # the prefix sum
        if token.isspace():
            words.append(offset)
            if (breaks := token.count("\n") or token.count("\r")) > 1:
                paragraphs.append(offset)
            if breaks:
                lines.append(offset)
            elif last in _SENTENCE_END:
                sentences.append(offset)
        elif token in "。！？":
            sentences.append(offset)
            words.append(offset)
        last = token[-1]
    return [paragraphs, lines, sentences, words]


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """The pieces of ``text`` as (start, end): each at most ``limit`` long, each later one starting ``overlap`` before the end of the last."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    n, start, out = len(text), 0, []
    kinds = boundaries(text) if n > limit else []
    while n - start > limit:
        most = start + limit
        least = start + (overlap if out else 0)
        half = max(least, start + limit // 2)
        end = most
        for lowest in (half, least):
            found = [k[at - 1] for k in kinds if (at := bisect_right(k, most)) and k[at - 1] > lowest]
            if found:
                end = found[0]
                break
        out.append((start, end))
        start = end - overlap
    return [*out, (start, n)]


def split(df: DataFrame, text: str, limit: int = LIMIT, overlap: int = OVERLAP, piece: str = "piece") -> DataFrame:
    """``df`` with one row per piece: ``text`` holds the piece and ``piece`` its number from 0; a narrow step."""
    at = df.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            texts, rows, numbers, parts = batch.column(at).to_pylist(), [], [], []
            for i, t in enumerate(texts):
                for number, (a, b) in enumerate(cuts(t, limit, overlap) if t else [(0, None)]):
                    rows.append(i)
                    numbers.append(number)
                    parts.append(t[a:b] if t else t)
            rows = pa.array(rows, pa.int64())
            columns = [pa.array(parts, pa.string()) if i == at else pc.take(c, rows) for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int32())], names=[*batch.schema.names, piece])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(piece, T.IntegerType(), False)]))


_FIELDS = ("id", "source_path", "source_type", "title", "content", "linked_classes", "chunk_index", "ts")


def current(chunks: DataFrame) -> DataFrame:
    """The row of each id that counts: an aggregation that keeps one row of each id in every partition before anything is
    shuffled, so an id with very many rows is no burden."""
    rank: list[Column] = [F.coalesce("ts", F.lit(-(2**62))), F.coalesce(F.length("content"), F.lit(-1)), F.xxhash64("content"), F.xxhash64("source_path", "source_type", "title", "linked_classes", "chunk_index")]
    best = F.max_by(F.struct(*(f for f in _FIELDS if f != "id")), F.struct(*rank)).alias("r")
    return chunks.groupBy("id").agg(best).select("id", "r.*")


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The current rows of ``chunks`` in pieces, with ``chunk_index`` renumbered from 0 per ``source_path``.

    Columns: those of the table; ``id`` is that of the row that a piece comes from, ``piece`` its number in it. Rows without
    ``chunk_index`` come last in their source, those of equal index by id. A source may hold a third of all rows, or have as many
    rows without index: rows are numbered in parts by range, and only the parts' sizes are summed per source.
    """
    rows = current(chunks).withColumn("_long", F.length("content") > limit)
    long = split(rows.filter("_long"), "content", limit, overlap)
    pieces = rows.filter(~F.coalesce("_long", F.lit(False))).withColumn("piece", F.lit(0)).unionByName(long)
    pieces = pieces.withColumn("_position", F.coalesce("chunk_index", F.lit(2**31 - 1)))
    numbered = ranked(pieces, "source_path", [F.col("_position"), F.col("id"), F.col("piece")])
    return numbered.select("id", "source_path", "source_type", "title", "content", "linked_classes", (F.col("rank") - 1).cast("int").alias("chunk_index"), "ts", "piece")


def corrected_sources(sources: DataFrame, pieces: DataFrame) -> DataFrame:
    """``sources`` with ``chunk_count`` put right: one row for each source of either table; the row indexed last counts."""
    counted = pieces.groupBy("source_path").agg(F.count("*").cast("int").alias("_count"), F.max("source_type").alias("_type"), F.max("title").alias("_title"), F.max("ts").alias("_ts"))
    last = sources.groupBy("source_path").agg(F.max(F.struct(F.coalesce("indexed_at", F.lit(-(2**62))).alias("at"), "source_type", "title", "indexed_at")).alias("_last"))
    both = last.join(counted.withColumnRenamed("source_path", "_path"), F.col("source_path").eqNullSafe(F.col("_path")), "full_outer")
    return both.select(
        F.coalesce("source_path", "_path").alias("source_path"),
        F.coalesce("_last.source_type", "_type").alias("source_type"),
        F.coalesce("_last.title", "_title").alias("title"),
        F.coalesce("_count", F.lit(0)).alias("chunk_count"),
        F.coalesce("_last.indexed_at", "_ts").alias("indexed_at"),
    )
