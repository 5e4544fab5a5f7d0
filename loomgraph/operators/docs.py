"""Documents of a code base: chunks by heading, links to classes and methods, staleness, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids

MOST, PACKED = 3000, 1800


def heading_sections(text: Column) -> Column:
    """Sections of a Markdown text, each beginning with a heading of level one to three."""
    marked = F.regexp_replace(text, r"(?m)^(?=#{1,3} )", "\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


def packed_paragraphs(section: Column, most: int = MOST, packed: int = PACKED) -> Column:
    """A section as it is, or if it is longer than ``most``, its paragraphs packed greedily to about ``packed`` characters."""
    paragraphs = F.filter(F.split(section, r"\n[ \t]*\n"), lambda p: F.trim(p) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def put(acc: Column, p: Column) -> Column:
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        fits = F.length(joined) <= packed
        return F.struct(F.when(fits | (acc["open"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits | (acc["open"] == ""), joined).otherwise(p).alias("open"))

    greedy = F.aggregate(paragraphs, start, put, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return F.when(F.length(section) <= most, F.array(section)).otherwise(greedy)


def markdown_chunks(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(id, path, title, chunk_index, content): chunks by heading, long sections by paragraph."""
    sections = docs.select(F.col(path).alias("path"), F.posexplode(heading_sections(F.col(text))).alias("s", "section"))
    parts = sections.select("path", "s", "section", F.posexplode(packed_paragraphs(F.col("section"))).alias("p", "content"))
    title = F.nullif(F.regexp_extract("section", r"(?m)^#{1,3} +(.*)$", 1), F.lit(""))
    w = Window.partitionBy("path").orderBy("s", "p")
    out = parts.select("path", title.alias("title"), (F.row_number().over(w) - 1).alias("chunk_index"), F.trim("content").alias("content"))
    return out.select(ids.doc_chunk_id("path", "chunk_index").alias("id"), "path", "title", "chunk_index", "content")


def camel_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-zA-Z0-9]{2,}\b"), F.lit(0)))


def symbol_links(chunks: DataFrame, names: DataFrame, id_: str = "id", text: str = "content") -> DataFrame:
    """(id, name): capitalised words of a text that are names of classes or methods (name)."""
    words = chunks.select(F.col(id_).alias("id"), F.explode(camel_words(F.coalesce(text, F.lit("")))).alias("name"))
    return words.join(names.select("name").distinct(), "name", "left_semi").distinct().select("id", "name")


QUALIFIED = r"\b([a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*)+\.[A-Z][A-Za-z0-9_]*)\b"


def resource_links(chunks: DataFrame, class_names: DataFrame, method_names: DataFrame, id_: str = "id") -> DataFrame:
    """(id, name): classes that a chunk's title or content names in full (by short name), and capitalised words that are names of
    classes or methods."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    rows = chunks.select(F.col(id_).alias("id"), text.alias("t")).distinct()
    classes = class_names.select(F.col(class_names.columns[0]).alias("known")).filter("known is not null").distinct()
    full = rows.select("id", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(QUALIFIED), F.lit(1)))).alias("q"))
    asked = full.select("id", F.explode(F.array("q", ids.short_name("q"))).alias("known"))
    by_name = asked.join(classes, "known", "left_semi").select("id", ids.short_name("known").alias("name"))
    either = classes.union(method_names.select("name")).select(F.col("known").alias("name")).distinct()
    words = rows.select("id", F.explode(camel_words(F.col("t"))).alias("name")).join(either, "name", "left_semi")
    return by_name.unionByName(words.select("id", "name")).distinct()


def graph_names(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """Short and full names of classes, and names of methods of more than two characters."""
    return classes.select(F.col("name")).union(classes.select("full_name")).union(methods.filter(F.length("method_name") > 2).select("method_name")).filter("name is not null").distinct()


def linked(chunks: DataFrame) -> DataFrame:
    """(id, source_path, name): the entries of the comma list of linked classes."""
    return chunks.select("id", "source_path", F.explode(F.split(F.coalesce("linked_classes", F.lit("")), ",")).alias("name")).withColumn("name", F.trim("name")).filter("name <> ''").distinct()


def stale_chunks(chunks: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, links, gone, state): chunks of which all linked classes have vanished, or some."""
    known = classes.select("name").distinct().withColumn("here", F.lit(1))
    counts = linked(chunks).join(known, "name", "left").groupBy("id").agg(F.count("*").alias("links"), F.count_if(F.col("here").isNull()).alias("gone"))
    return counts.withColumn("state", F.when(F.col("gone") == F.col("links"), "dropped").when(F.col("gone") > 0, "partial").otherwise("fresh"))


def docs_for(chunks: DataFrame, name: str) -> DataFrame:
    return chunks.filter(F.array_contains(F.transform(F.split(F.coalesce("linked_classes", F.lit("")), ","), lambda x: F.trim(x)), name))


def merged_hits(by_class: DataFrame, by_text: DataFrame) -> DataFrame:
    """Chunks linked to a class first, then those found by text, each once (id, score)."""
    rows = by_class.select("id", F.lit(0).alias("bucket"), F.lit(0.0).alias("score")).unionByName(by_text.select("id", F.lit(1).alias("bucket"), "score"))
    return rows.groupBy("id").agg(F.min(F.struct("bucket", "score")).alias("b")).select("id", "b.bucket", "b.score")


def doc_graph(chunks: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind) and edges (src, dst, kind) from sources to chunks to classes."""
    links = linked(chunks).join(classes.select("name").distinct(), "name", "left_semi")
    nodes = chunks.select(F.col("source_path").alias("id"), F.lit("source").alias("kind")).union(chunks.select("id", F.lit("chunk"))).union(links.select("name", F.lit("class"))).distinct()
    edges = chunks.select(F.col("source_path").alias("src"), F.col("id").alias("dst"), F.lit("holds").alias("kind")).union(links.select("id", "name", F.lit("names"))).distinct()
    return nodes, edges


def unknown_references(texts: DataFrame, names: DataFrame, id_: str = "id", text: str = "content") -> DataFrame:
    """(name, n): names in backticks that look like members or classes but are no known name."""
    found = texts.select(F.col(id_).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(r"`(?:\w+\.)?([A-Za-z]\w+)`"), F.lit(1))).alias("name"))
    return found.join(names.select("name").distinct(), "name", "left_anti").groupBy("name").agg(F.count_distinct("id").alias("n"))
