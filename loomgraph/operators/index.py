"""A stored inverted index, and search over it as users call it: identifiers and plain language, methods and classes.

The postings (term, id, frequency by column, length of the document) are written once, in ``BUCKETS`` folders by the hash of
the terms' first two characters and sorted by term within the files, with one row of corpus figures beside them. A query
reads the folders of its own terms only, and of these the row groups whose range of terms fits; no text is scanned.
Scores are those of :mod:`search`.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut, shared_folder
from . import search, traversal

BUCKETS, START = 64, 2
LIFT_NAME, LIFT_CONTEXT = 1000.0, 500.0
CLASS_COLUMNS = ("name", "full_name", "package_name")
#: Similarities below this don't count.
LEAST_SIMILAR = 0.25


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(c, 1, START)), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Index:
    """``postings`` (bucket, term, id, length and a frequency for each of ``columns``), and the corpus' figures."""

    postings: DataFrame
    columns: tuple[str, ...]
    documents: int
    average: float

    @classmethod
    def build(cls, docs: DataFrame, id_: str, columns: Sequence[str], folder: str | None = None) -> Index:
        """Index ``docs``, one row an id, under ``folder`` (a new one in the shared folder if none is given)."""
        spark = docs.sparkSession
        at = (folder or shared_folder(spark, "index-" + uuid.uuid4().hex)).rstrip("/")
        rows = search.postings(docs, id_, columns).withColumn("bucket", _bucket(F.col("term")))
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("errorifexists").partitionBy("bucket").parquet(f"{at}/postings")
        search.document_lengths(docs, id_, columns).agg(F.count("*").alias("documents"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("average")).coalesce(1).write.mode("errorifexists").parquet(f"{at}/figures")
        return cls.read(spark, at, columns)

    @classmethod
    def read(cls, spark: SparkSession, folder: str, columns: Sequence[str]) -> Index:
        figures = spark.read.parquet(f"{folder}/figures").first()
        types = {c: "long" for c in columns}
        schema = "id string, term string, length int, " + ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", bucket int"
        return cls(spark.read.schema(schema).parquet(f"{folder}/postings"), tuple(columns), figures["documents"], figures["average"] or 1.0)

    def synced(self, docs: DataFrame, id_: str, changed: DataFrame, folder: str | None = None) -> Index:
        """The index after the documents ``changed`` (id) were added, edited or deleted, ``docs`` being all as they are now:
        their postings are made anew, all others kept. A new folder; readers keep the old one."""
        spark = docs.sparkSession
        at = (folder or shared_folder(spark, "index-" + uuid.uuid4().hex)).rstrip("/")
        gone = changed.select("id").distinct()
        fresh = search.postings(docs.join(gone.withColumnRenamed("id", id_), id_, "left_semi"), id_, self.columns).withColumn("bucket", _bucket(F.col("term")))
        rows = self.postings.join(gone, "id", "left_anti").unionByName(fresh)
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("errorifexists").partitionBy("bucket").parquet(f"{at}/postings")
        search.document_lengths(docs, id_, self.columns).agg(F.count("*").alias("documents"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("average")).coalesce(1).write.mode("errorifexists").parquet(f"{at}/figures")
        return type(self).read(spark, at, self.columns)

    def differences(self, docs: DataFrame, id_: str) -> DataFrame:
        """(id, term): postings that the documents don't have, or that lack; empty where the index is sound."""
        now = search.postings(docs, id_, self.columns).select(F.col("id").cast("string"), "term", "length", *self.columns)
        have = self.postings.select("id", "term", "length", *self.columns)
        return have.exceptAll(now).unionByName(now.exceptAll(have)).select("id", "term").distinct()

    def search(self, terms: Sequence[str], weights: Mapping[str, float] | None = None, only: str | None = None, every: bool = False, whole: bool = False) -> DataFrame:
        """(id, score, terms): documents with any (or ``every``) of the terms, which are prefixes or ``whole`` tokens, in ``only``
        one column if given."""
        terms = [t.lower() for t in terms]
        empty = self.postings.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("terms")).limit(0)
        if not terms:
            return empty
        meets = [(F.col("term") == t) if whole else F.col("term").startswith(t) for t in terms]
        rows = self.postings.filter(reduce(lambda a, b: a | b, meets))
        if all(whole or len(t) >= START for t in terms):
            spark = self.postings.sparkSession
            buckets = sorted({r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"))).collect()})
            rows = rows.filter(F.col("bucket").isin(buckets))
        used = [only] if only else list(self.columns)
        plain = reduce(lambda a, b: a + b, (F.col(c) for c in used))
        weighted = reduce(lambda a, b: a + b, (F.lit(float((weights or {}).get(c, 1.0))) * F.col(c) for c in used))
        sums = [a for k, m in enumerate(meets) for a in (F.sum(F.when(m, plain).otherwise(0)).alias(f"n_{k}"), F.sum(F.when(m, weighted).otherwise(0.0)).alias(f"f_{k}"))]
        hits = rows.groupBy("id").agg(F.first("length").alias("length"), *sums)
        held = hits.agg(*(F.count_if(F.col(f"n_{k}") > 0).alias(f"h_{k}") for k in range(len(terms)))).first()
        score: Column = F.lit(0.0)
        for k in range(len(terms)):
            n = held[f"h_{k}"]
            idf = math.log((self.documents - n + 0.5) / (n + 0.5)) if self.documents else 0.0
            f = F.col(f"f_{k}")
            score = score + F.lit(idf if idf > 0 else 1e-6) * f * (search.K1 + 1) / (f + search.K1 * (1 - search.B + search.B * F.col("length") / F.lit(float(self.average))))
        hit = [F.col(f"n_{k}") > 0 for k in range(len(terms))]
        return hits.filter(reduce(lambda a, b: (a & b) if every else (a | b), hit)).select("id", (-score).alias("score"), reduce(lambda a, b: a + b, (h.cast("int") for h in hit)).alias("terms"))


_WORD = re.compile(r"[A-Za-z0-9_]+")


def words(query: str) -> list[str]:
    return _WORD.findall(query)


def parts(query: str) -> list[str]:
    """Words of a query and their camel-case parts, each once; an underscore parts a word into terms."""
    out: dict[str, None] = {}
    for word in words(query):
        for part in (word, *re.findall(text.CAMEL_QUERY, word)):
            for term in filter(None, part.lower().split("_")):
                out.setdefault(term)
    return list(out)


def is_identifier(query: str) -> bool:
    """Whether a query looks like an identifier: one word, or up to three without stop words."""
    w = words(query)
    return len(w) == 1 or 0 < len(w) <= 3 and not any(x.lower() in text.STOP_WORDS for x in w)


def plain_terms(spark: SparkSession, query: str) -> list[str]:
    """The terms of a query in plain language: stop words left out, the others stemmed."""
    kept = spark.createDataFrame([(query,)], "q string").select(text.without_stop_words(F.col("q")).alias("q")).first()["q"]
    return parts(kept or "")


def class_hits(classes: Index, query: str) -> DataFrame:
    """(id, score): classes with a word of the query as a whole token of their name."""
    tokens = [t for w in words(query) for t in w.split("_") if t]
    return classes.search(tokens, {"name": 10.0}, only="name", whole=True).select("id", "score")


def hits(methods: Index, classes: Index | None, query: str, class_names: DataFrame | None = None, context: DataFrame | None = None, callers: DataFrame | None = None) -> DataFrame:
    """(id, kind, score, bucket, callers): all that a query finds, the best having the least score.

    A query that looks like an identifier seeks whole tokens of names first, lifted above the rest (bucket ``name``), then
    all its parts in any column, or any of them where nothing has all (``text``), and classes (``exact_class`` where a word
    of the query is the whole name, given ``class_names`` (id, name), else ``class``). Any other query seeks any of its
    words but stop words. Hits among ``context`` (id) are lifted; of equal scores the one with more ``callers`` (id,
    callers) comes first, then by bucket and id: order by score, callers descending, bucket, id."""
    spark = methods.postings.sparkSession
    if is_identifier(query):
        tokens = [t for w in words(query) for t in w.split("_") if t]
        name = methods.search(tokens, {"method_name": 10.0}, only="method_name", whole=True).select("id", (F.col("score") - LIFT_NAME).alias("score"), F.lit(1).alias("bucket"))
        body = methods.search(parts(query), every=True)
        if body.isEmpty():
            body = methods.search(parts(query))
        body = body.select("id", "score", F.lit(2).alias("bucket"))
        found = name.unionByName(body).groupBy("id").agg(F.min(F.struct("bucket", "score")).alias("b")).select("id", F.lit("method").alias("kind"), "b.score", "b.bucket")
        if classes is not None:
            c = class_hits(classes, query)
            exact = F.lower("name").isin([w.lower() for w in words(query)])
            c = c.join(class_names.groupBy("id").agg(F.min("name").alias("name")), "id", "left").withColumn("bucket", F.when(exact, 0).otherwise(3)) if class_names is not None else c.withColumn("bucket", F.lit(3))
            found = found.unionByName(c.select("id", F.lit("class").alias("kind"), "score", "bucket"))
    else:
        found = methods.search(plain_terms(spark, query)).select("id", F.lit("method").alias("kind"), "score", F.lit(2).alias("bucket"))
    if context is not None:
        near = context.select("id").distinct().withColumn("lift", F.lit(LIFT_CONTEXT))
        found = found.join(near, "id", "left").withColumn("score", F.col("score") - F.coalesce("lift", F.lit(0.0))).drop("lift")
    if callers is not None:
        found = found.join(callers.select("id", "callers"), "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    else:
        found = found.withColumn("callers", F.lit(0))
    named = F.element_at(F.array(*map(F.lit, ("exact_class", "name", "text", "class"))), F.col("bucket") + 1)
    return found.select("id", "kind", "score", "callers", F.col("bucket").alias("tier"), named.alias("bucket"))


def best(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` hits (a search's limit)."""
    return found.orderBy("score", F.desc("callers"), "tier", "id").limit(most)


def similar(vectors: DataFrame | None, query: Sequence[float] | None, k: int) -> DataFrame | None:
    if vectors is None or query is None:
        return None
    return search.dense_hits(vectors, query, k).filter(F.col("similarity") > LEAST_SIMILAR)


def answered(methods: Index, classes: Index, table: DataFrame, class_table: DataFrame, edges: DataFrame, query: str, most: int = 20, exact: bool = False, vectors: DataFrame | None = None, asked: Sequence[float] | None = None, callers: DataFrame | None = None) -> DataFrame:
    """(id, source, score, position): a search's answer.

    The best ``most`` hits, or where the index has none, of the scan for substrings; generated files last, and five times as
    many sought where all are generated; the nearest vectors beside them and all blended; then classes of files not yet
    there, then what calls or is called by the hits, by how well it matches the query. ``exact`` gives the first five hits
    alone. ``table`` has one row per method (id, method_name, signature, file_path, source), ``class_table`` (id, name,
    file_path)."""
    fetch = 5 if exact else most
    info = table.select("id", "method_name", "signature", "file_path")
    ranked = hits(methods, classes, query, class_table, callers=callers)

    def first(n: int) -> DataFrame:
        top = best(ranked, n)
        rows = top.filter("kind = 'method'").join(info, "id").unionByName(top.filter("kind = 'class'").join(class_table.select("id", F.col("name").alias("method_name"), F.lit(None).cast("string").alias("signature"), "file_path"), "id"))
        return search.demoted_last(rows.withColumnRenamed("bucket", "way"))

    rows = cut(first(fetch))
    if rows.isEmpty():
        scan = search.substring_hits(table, parts(query)).orderBy(F.desc("matched"), "id").limit(fetch)
        rows = cut(search.demoted_last(scan.join(info, "id").select("id", F.lit("method").alias("kind"), (-F.col("matched").cast("double")).alias("score"), F.lit(0).alias("callers"), F.lit(2).alias("tier"), F.lit("scan").alias("way"), "method_name", "signature", "file_path")))
    elif not exact and rows.filter(F.col("bucket") == 0).isEmpty():
        rows = cut(first(5 * most))
    if exact:
        return _placed([rows.select("id", F.lit("fts").alias("source"), (-F.col("score")).alias("score"), F.col("bucket").cast("double").alias("k1"), F.col("score").alias("k2"))]).limit(5)
    near = similar(vectors, asked, 2 * fetch)
    if near is not None:
        extra = near.join(rows, "id", "left_anti").join(info, "id").select("id", F.lit("method").alias("kind"), F.lit(0.0).alias("score"), F.lit(0).alias("callers"), F.lit(4).alias("tier"), F.lit("dense").alias("way"), "method_name", "signature", "file_path")
        rows = rows.unionByName(search.demoted_last(extra)).join(near.select("id", "similarity"), "id", "left").withColumn("heuristic", F.lit(0.0))
        rows = cut(search.blended(rows).withColumn("k2", -F.col("blend")).drop("similarity", "heuristic", "blend"))
    else:
        rows = rows.withColumn("k2", F.col("score"))
    seeds = rows.select("id", F.lit("fts").alias("source"), (-F.col("score")).alias("score"), F.col("bucket").cast("double").alias("k1"), "k2")
    files = rows.select("file_path").distinct()
    more = class_hits(classes, query).join(rows.select("id"), "id", "left_anti").join(class_table, "id").join(files, "file_path", "left_anti")
    more = more.groupBy("file_path").agg(F.min(F.struct("score", "id")).alias("b")).select("b.id", F.lit("class_fts").alias("source"), (-F.col("b.score")).alias("score"), F.lit(2.0).alias("k1"), F.col("b.score").alias("k2")).orderBy("k2", "id").limit(max(1, most // 2))
    around = traversal.neighbourhood(edges, rows.select("id"), 1).select("id").join(rows.select("id"), "id", "left_anti").join(info, "id")
    match = search.hit_score(F.lit(0.0), parts(query), F.col("method_name"), F.col("signature"), F.col("file_path"), F.lit(None).cast("array<string>"))
    around = around.select("id", F.lit("graph").alias("source"), match.alias("score"), F.lit(3.0).alias("k1"), (-match).alias("k2"))
    return _placed([seeds, more, around])


def explored(methods: Index, table: DataFrame, edges: DataFrame, query: str, most: int = 10, vectors: DataFrame | None = None, asked: Sequence[float] | None = None, stereotypes: DataFrame | None = None) -> DataFrame:
    """(id, source, score, position): the best ``most`` methods for a question in plain language, scored by how their names,
    signatures, paths and classes match, then the best ``most`` within two calls of them. ``stereotypes`` (id, stereotypes)."""
    fetch = max(4 * most, 40)
    info = table.select("id", "method_name", "signature", "file_path")
    if stereotypes is not None:
        info = info.join(stereotypes.select("id", "stereotypes"), "id", "left")
    else:
        info = info.withColumn("stereotypes", F.lit(None).cast("array<string>"))
    found = best(hits(methods, None, query), fetch).select("id", "score")
    near = similar(vectors, asked, 2 * fetch)
    if near is not None:
        found = found.join(near.select("id", "similarity"), "id", "full_outer")
    tokens = [t for t in parts(query) if t not in text.STOP_WORDS]
    match = search.hit_score(F.col("score"), tokens, F.col("method_name"), F.col("signature"), F.col("file_path"), F.col("stereotypes"))
    seeds = found.join(info, "id").withColumn("match", match)
    if near is not None:
        seeds = search.blended(cut(seeds.withColumn("heuristic", F.col("match") / 10))).withColumn("match", F.col("blend"))
    seeds = cut(seeds.select("id", F.col("match").alias("score")).orderBy(F.desc("score"), "id").limit(most))
    around = traversal.neighbourhood(edges, seeds.select("id"), 2).select("id").join(seeds, "id", "left_anti").join(info, "id").withColumn("score", F.lit(0.0))
    around = around.withColumn("match", match).select("id", F.col("match").alias("score")).orderBy(F.desc("score"), "id").limit(most)
    key = lambda df, source, k: df.select("id", F.lit(source).alias("source"), "score", F.lit(float(k)).alias("k1"), (-F.col("score")).alias("k2"))
    return _placed([key(seeds, "fts", 0), key(around, "graph", 1)])


def _placed(parts_: Sequence[DataFrame]) -> DataFrame:
    """Parts of an answer one after another, numbered; answers are as long as their limits allow."""
    whole = reduce(lambda a, b: a.unionByName(b), parts_)
    one = whole.agg(F.array_sort(F.collect_list(F.struct("k1", "k2", "id", "source", "score"))).alias("r"))
    return one.select(F.posexplode("r").alias("position", "r")).select("r.id", "r.source", "r.score", "position")


def chunk_hits(chunks: Index, query: str) -> DataFrame:
    """(id, score): chunks of documents by title, content and linked classes; all terms must be there."""
    return chunks.search(parts(query), every=True).select("id", "score")
