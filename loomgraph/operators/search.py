"""Full-text search: postings, BM25 with column weights, two-phase search, re-ranking signals.

The score is that of the usual full-text engine, negative, the lesser the better:
``-sum over terms of IDF * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / average length))`` with ``f`` the weighted sum of
the term's frequencies by column and ``IDF = ln((N - n + 0.5) / (n + 0.5))``, 1e-6 where that isn't positive. Lengths are
tokens over all columns; ``N``, ``n`` and the average are of the whole corpus. Query terms are prefixes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..session import cut

K1, B = 1.2, 0.75


_TOKENS = r"[\p{L}\p{N}]+"


def _plain(column: str) -> Column:
    return F.lower(F.translate(F.coalesce(column, F.lit("")), "İ", "i"))


def _starting(plain: Column, term: str) -> Column:
    """How many tokens begin with a term, counted in the text itself: no array of tokens is made."""
    return F.regexp_count(plain, F.lit(r"(?<![\p{L}\p{N}])" + re.escape(term.lower())))


def _tagged(column: str) -> Column:
    return F.transform(text.index_tokens(F.col(column)), lambda t: F.struct(t.alias("term"), F.lit(column).alias("column")))


def document_lengths(docs: DataFrame, id_: str, columns: Sequence[str]) -> DataFrame:
    size = reduce(lambda a, b: a + b, (F.size(text.index_tokens(F.col(c))) for c in columns))
    return docs.select(F.col(id_).alias("id"), size.alias("length"))


def postings(docs: DataFrame, id_: str, columns: Sequence[str]) -> DataFrame:
    """(id, term, frequencies by column, length): an inverted index, partitioned by term when written."""
    size = reduce(lambda a, b: a + b, (F.size(text.index_tokens(F.col(c))) for c in columns))
    # the length first: beside the explosion it would be counted again for every token
    sized = docs.select(F.col(id_).alias("id"), *columns, size.alias("length"))
    rows = sized.select("id", "length", F.explode(F.concat(*map(_tagged, columns))).alias("p")).select("id", "length", "p.*")
    return rows.groupBy("id", "term", "length").agg(*(F.count_if(F.col("column") == c).alias(c) for c in columns))


def counted(docs: DataFrame, terms: Sequence[str], columns: Sequence[str], id_: str = "id") -> DataFrame:
    """(id, length, f_k_column): how often each of the prefix ``terms`` begins a token of each column. The texts are scanned once;
    the few numbers of each document are stored, as corpus figures and scores both need them."""
    tokens = {c: _plain(c) for c in columns}
    size = reduce(lambda a, b: a + b, (F.regexp_count(t, F.lit(_TOKENS)) for t in tokens.values()))
    each = [_starting(tokens[c], term).alias(f"f_{k}_{c}") for k, term in enumerate(terms) for c in columns]
    return cut(docs.select(F.col(id_).alias("id"), size.alias("length"), *each))


def scored(rows: DataFrame, terms: Sequence[str], columns: Sequence[str], weights: Mapping[str, float] | None = None, only: str | None = None, every: bool = False) -> DataFrame:
    """(id, score, terms) of what :func:`counted` gave: documents with any (or ``every``) of the terms, in ``only`` one column if
    given."""
    weights, used = weights or {}, [only] if only else list(columns)
    if not terms:
        return rows.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("terms")).limit(0)
    seen = {k: reduce(lambda a, b: a + b, (F.col(f"f_{k}_{c}") for c in used)) for k in range(len(terms))}
    sums = rows.agg(F.count("*").alias("n"), F.avg("length").alias("average"), *(F.count_if(seen[k] > 0).alias(f"n_{k}") for k in seen)).first()
    n, average = sums["n"], sums["average"] or 1.0
    hit = [seen[k] > 0 for k in seen]
    score: Column = F.lit(0.0)
    for k in seen:
        held = sums[f"n_{k}"]
        idf = math.log((n - held + 0.5) / (held + 0.5)) if n else 0.0
        idf = idf if idf > 0 else 1e-6
        f = reduce(lambda a, b: a + b, (F.lit(float(weights.get(c, 1.0))) * F.col(f"f_{k}_{c}") for c in used))
        score = score + F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.lit(float(average))))
    kept = rows.filter(reduce(lambda a, b: (a & b) if every else (a | b), hit))
    return kept.select("id", (-score).alias("score"), reduce(lambda a, b: a + b, (h.cast("int") for h in hit)).alias("terms"))


def bm25(docs: DataFrame, terms: Sequence[str], columns: Sequence[str], id_: str = "id", weights: Mapping[str, float] | None = None, only: str | None = None, every: bool = False) -> DataFrame:
    """(id, score, terms): documents with any (or ``every``) of the prefix ``terms``, in ``only`` one column if given; a scan of
    the texts, where :mod:`index` keeps postings."""
    return scored(counted(docs, terms, columns, id_), terms, columns, weights, only, every)


METHOD_COLUMNS = ("method_name", "signature", "class_full_name", "source")


def two_phase(methods: DataFrame, query_terms: Sequence[str], context: Sequence[str] = ()) -> DataFrame:
    """(id, score, bucket): hits by name come first by an offset, then hits anywhere; hits in ``context`` classes are lifted.

    Phase one searches the name column with tenfold weight, phase two all columns; a method keeps its better score."""
    rows = counted(methods, query_terms, METHOD_COLUMNS)
    name = scored(rows, query_terms, METHOD_COLUMNS, {"method_name": 10.0}, only="method_name").select("id", (F.col("score") - 1000.0).alias("score"), F.lit("name").alias("bucket"))
    any_ = scored(rows, query_terms, METHOD_COLUMNS).select("id", "score", F.lit("text").alias("bucket"))
    best = name.unionByName(any_).groupBy("id").agg(F.min(F.struct("score", "bucket")).alias("b")).select("id", "b.*")
    if context:
        inside = methods.filter(F.col("class_full_name").isin(list(context))).select("id").withColumn("lift", F.lit(500.0))
        best = best.join(inside, "id", "left").select("id", (F.col("score") - F.coalesce("lift", F.lit(0.0))).alias("score"), "bucket")
    return best


def substring_hits(methods: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(id, matched): how many terms occur in name, signature or source; the way where there is no index."""
    blob = F.lower(F.concat_ws(" ", "method_name", "signature", "source"))
    matched = reduce(lambda a, b: a + b, (blob.contains(t.lower()).cast("int") for t in terms))
    return methods.select("id", matched.alias("matched")).filter("matched > 0")


def hit_score(bm25_score: Column, tokens: Sequence[str], name: Column, signature: Column, path: Column, stereotypes: Column) -> Column:
    """The score by which hits are re-ranked, greater is better: each token adds for a match in name, signature and path;
    stereotypes add, tests and generated files take off."""
    name, signature, path = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(signature, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    folder = F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    file = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    score = -F.coalesce(bm25_score, F.lit(0.0))
    for t in tokens:
        score = score + F.when(name == t, 2.0).when(name.contains(t), 1.0).otherwise(0.0) + F.when(signature.contains(t), 0.5).otherwise(0.0) + F.when(file.contains(t), 1.5).when(folder.contains(t), 0.5).otherwise(0.0)
    has = lambda s: F.coalesce(F.array_contains(stereotypes, s), F.lit(False))
    score = score + F.when(has("controller") | has("service"), 1.5).when(has("repository"), 0.5).otherwise(0.0)
    score = score - F.when(path.rlike(r"/tests?/|tests?\.java$"), 1.0).otherwise(0.0)
    return score - F.when(path.rlike(r"/generated/|/gen/|\.generated\.|_generated\.|build/generated|target/generated"), 10.0).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dense_hits(vectors: DataFrame, query: Sequence[float], k: int, id_: str = "method_id") -> DataFrame:
    """(id, similarity): the ``k`` vectors nearest to one query vector (a search's limit)."""
    q = F.array(*(F.lit(float(x)) for x in query))
    fit = vectors.filter(F.size("embedding") == len(query))
    return fit.select(F.col(id_).alias("id"), cosine(F.col("embedding"), q).alias("similarity")).filter("similarity is not null and not isnan(similarity)").orderBy(F.desc("similarity"), "id").limit(k)


#: Vectors of a block and queries of a block: one task holds the products of both.
BLOCK, ASKED = 8192, 1024


def dense_hits_all(vectors: DataFrame, queries: DataFrame, k: int, id_: str = "method_id") -> DataFrame:
    """(query, id, similarity): the ``k`` vectors nearest to each row of ``queries`` by brute force, block by block; ties by id.
    Only vectors of the query's length count; those with nulls and of norm 0 have no similarity."""
    clean = lambda df: df.filter("embedding is not null and forall(embedding, x -> x is not null)").select(F.col(id_).alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("n"))
    v, q = clean(vectors), clean(queries)
    parts, asked = vectors.count() // BLOCK + 1, queries.count() // ASKED + 1
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.withColumn("p", of(parts)).withColumn("b", every(asked))
    q = q.withColumn("b", of(asked)).withColumn("p", every(parts))
    type_ = vectors.schema[id_].dataType.simpleString()

    def run(left, right):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        ask, ids_ = left.column("id").to_pylist(), right.column("id").to_pylist()
        out: tuple[list, list, list] = ([], [], [])
        if ask and ids_:
            x, y = (np.array(t.column("v").to_pylist(), np.float64).reshape(t.num_rows, -1) for t in (left, right))
            with np.errstate(divide="ignore", invalid="ignore"):
                s = (x @ y.T) / np.sqrt((x * x).sum(1)[:, None] * (y * y).sum(1)[None, :])
            for i, row in enumerate(s):
                at = np.flatnonzero(~np.isnan(row))
                if len(at) > k:  # all that are not below the k-th, so that ties are kept
                    at = at[row[at] >= np.partition(row[at], len(at) - k)[len(at) - k]]
                for j in sorted(at.tolist(), key=lambda j: (-row[j], ids_[j]))[:k]:
                    out[0].append(ask[i]), out[1].append(ids_[j]), out[2].append(float(row[j]))
        return pa.table({"query": pa.array(out[0], left.schema.field("id").type), "id": pa.array(out[1], right.schema.field("id").type), "similarity": pa.array(out[2], pa.float64())})

    keys = ["n", "b", "p"]
    near = q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(run, f"query {type_}, id {type_}, similarity double")
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return near.withColumn("r", first).filter(F.col("r") <= k).drop("r")


def blended(hits: DataFrame, least: float | None = None) -> DataFrame:
    """``hits`` (id, score, similarity, heuristic) with ``blend``: 0.6 of the BM25 score scaled to 0..1 over the hits, 0.2 of
    the similarity and 0.2 of the heuristic; 0.8 and 0.2 where there is no vector. The corpus has no part in it: the scale
    is over the candidate set, whose extremes are one row."""
    score = -F.coalesce("score", F.lit(0.0))
    lo, hi = hits.agg(F.min(score), F.max(score)).first()
    lo, hi = lo or 0.0, hi or 0.0
    scaled = (score - lo) / (hi - lo) if hi > lo else F.lit(1.0)
    blend = F.when(F.col("similarity").isNull(), 0.8 * scaled + 0.2 * F.col("heuristic")).otherwise(0.6 * scaled + 0.2 * F.col("similarity") + 0.2 * F.col("heuristic"))
    out = hits.withColumn("blend", blend)
    return out if least is None else out.filter(F.col("similarity").isNull() | (F.col("similarity") >= least))


def demoted_last(hits: DataFrame, path: str = "file_path") -> DataFrame:
    """Hits with ``bucket`` 1 for generated files, which sort after all others."""
    return hits.withColumn("bucket", F.when(rules.demoted_path(F.col(path)), 1).otherwise(0))
