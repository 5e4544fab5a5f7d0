"""Queries of the training-data problems, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, spread
from . import bpe, code_docs, generated_files, neighbours, packing, spam_pages, splitting

CAPACITY = 2048
SIZES = (512, 1024, 2048)
SIMILAR = 0.92


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return generated_files.judged_files(table(spark, folder, "methods"), table(spark, folder, "classes"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).filter("not by_hand").select("file_path")


def p1_handwritten(spark: SparkSession, folder: str) -> DataFrame:
    """The hand-written files, to which classes, methods and call sites can be kept."""
    return _judged(spark, folder).filter("by_hand").select("file_path")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = splitting.current(table(spark, folder, "doc_chunks")).select("id", "content")
    return splitting.split(rows, "content").filter("piece = 1").select("id")


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All current chunks, oversized ones in pieces, renumbered."""
    return splitting.split_chunks(table(spark, folder, "doc_chunks"))


def p2_sources(spark: SparkSession, folder: str) -> DataFrame:
    """doc_sources with the number of chunks put right."""
    return splitting.corrected_sources(table(spark, folder, "doc_sources"), p2_pieces(spark, folder))


def p2_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """The digest of each current chunk put together again from its pieces without their overlaps, the length of its longest
    piece if that exceeds the limit, and whether each later piece starts as the one before it ends."""
    rows = splitting.split(splitting.current(table(spark, folder, "doc_chunks")).select("id", "content"), "content")
    one = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("piece", "content"))).alias("p"))
    text = F.aggregate("p", F.lit(""), lambda all_, p: F.concat(all_, F.when(p["piece"] == 0, p["content"]).otherwise(F.substring(p["content"], splitting.OVERLAP + 1, splitting.LIMIT))))
    meets = lambda p, i: (i == 0) | F.col("p")[i - 1]["content"].endswith(F.substring(p["content"], 1, splitting.OVERLAP))
    long = F.exists("p", lambda p: F.length(p["content"]) > splitting.LIMIT)
    return one.select("id", F.md5(text).alias("digest"), F.coalesce(long, F.lit(False)).alias("too_long"), F.coalesce(F.forall(F.transform("p", meets), lambda x: x), F.lit(True)).alias("overlapping"))


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar methods of each."""
    return neighbours.neighbours(table(spark, folder, "method_embeddings"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "method_embeddings")
    pairs = neighbours.similar_pairs(neighbours.neighbours(vectors, least=SIMILAR - neighbours.SLACK), vectors, SIMILAR)
    return pairs.select("model", "method_id_a", "method_id_b")


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "methods").select("id", "language", "method_name", "signature", "source"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def p6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Code and description of each documented method."""
    return code_docs.code_pairs(_sources(spark, folder)).distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return code_docs.code_pairs(_sources(spark, folder)).select("id").filter("id is not null").distinct()


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(_texts(spark, folder)).select("doc_id", "ids")


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.count_tokens(_texts(spark, folder)).select("doc_id", "tokens")


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Each document, or piece of one over the capacity, in its container of 2,048 tokens; ``fitted_capacity`` is the
    least of 256, 512, 1,024 and 2,048 that holds the container's contents."""
    return packing.pack(_sized(spark, folder), "doc_id", "tokens", (CAPACITY,), (256, 512, 1024))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Containers by capacity and fill."""
    packed = cut(p8_packed(spark, folder)).filter("size > 0")
    one = packed.groupBy("container").agg(F.sum("size").alias("used"), F.count("*").alias("items"), F.first("fitted_capacity").alias("fitted_capacity"))
    return one.groupBy("fitted_capacity").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"))


def p8_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Containers of several permitted sequence lengths, chosen jointly: by capacity, with what they hold."""
    packed = cut(packing.pack(_sized(spark, folder), "doc_id", "tokens", SIZES)).filter("size > 0")
    one = packed.groupBy("container").agg(F.first("capacity").alias("capacity"), F.sum("size").alias("used"), F.count("*").alias("items"), F.first("fitted_capacity").alias("fitted_capacity"))
    return one.groupBy("capacity", "fitted_capacity").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"))


def p8_sound(spark: SparkSession, folder: str) -> DataFrame:
    """What packing must keep to, for one capacity and for several: rows packed as often as there are, tokens lost, containers
    over their capacity, items cut without need, containers that hold over a tenth less than they could on the whole."""
    sized = cut(_sized(spark, folder))
    total, most = F.sum(F.coalesce("tokens", F.lit(0))), F.max(F.coalesce("tokens", F.lit(0)))
    want = sized.agg(total.alias("tokens"), most.alias("most")).first()
    out = None
    for name, sizes in (("one", (CAPACITY,)), ("several", SIZES)):
        packed = cut(packing.pack(sized, "doc_id", "tokens", sizes))
        used = packed.filter("size > 0").groupBy("container").agg(F.sum("size").alias("used"), F.first("capacity").alias("capacity"))
        fill = used.agg(F.count_if(F.col("used") > F.col("capacity")).alias("overfull"), (F.coalesce(F.sum("used") / F.sum("capacity"), F.lit(1.0)) >= 0.9).alias("well_filled"))
        kept = packed.agg(F.count_if(F.col("piece") == 0).alias("items"), (F.coalesce(F.sum("size"), F.lit(0)) - F.lit(want["tokens"] or 0)).alias("lost"), F.count_if((F.col("piece") > 0) & F.lit((want["most"] or 0) <= CAPACITY)).alias("cut_needlessly"))
        row = kept.withColumn("one", F.lit(1)).join(fill.withColumn("one", F.lit(1)), "one").select(F.lit(name).alias("sizes"), "items", "lost", "overfull", "cut_needlessly", "well_filled")
        out = row if out is None else out.unionByName(row)
    return out


def p9_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document by label."""
    return spam_pages.labelled_pages(_texts(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_labels(spark, folder).filter("spam").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (p1_found, p1_handwritten, p2_found, p2_pieces, p2_sources, p2_rejoined, p4_found, p4_neighbours, p6_found, p6_pairs, p7_ids, p8_packed, p8_containers, p8_sizes, p8_sound, p9_found, p9_labels)
}

_CURRENT = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC NULLS LAST, length(content) DESC NULLS LAST) AS r FROM doc_chunks) WHERE r = 1)"

ORACLE = {
    "p2_rejoined": f"SELECT id, md5(content) AS digest, false AS too_long, true AS overlapping FROM {_CURRENT}",
    "p8_sound": "SELECT s AS sizes, n AS items, 0 AS lost, 0 AS overfull, 0 AS cut_needlessly, true AS well_filled FROM (SELECT count(*) AS n FROM documents), (VALUES ('one'), ('several')) v(s)",
    "p2_found": f"SELECT id FROM (SELECT id, content, row_number() OVER (PARTITION BY id ORDER BY ts DESC NULLS LAST, length(content) DESC NULLS LAST) AS r FROM doc_chunks) WHERE r = 1 AND length(content) > {splitting.LIMIT}",
}
