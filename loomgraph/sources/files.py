"""Files as sources: walking and filtering a tree, language and framework by manifests, wholesale text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Directories that are never sources, by language where they differ.
PRUNED = "node_modules .git .hg .svn __pycache__ venv .venv env .tox .mypy_cache .pytest_cache build dist target out .gradle .idea .vscode bin obj vendor .next coverage".split()
EXTENSIONS = {"java": [".java"], "python": [".py"], "typescript": [".ts", ".tsx", ".js", ".jsx", ".mjs"], "go": [".go"], "csharp": [".cs"], "scala": [".scala"], "smithy": [".smithy"], "docs": [".md", ".mdx", ".txt"], "resources": [".yaml", ".yml", ".json", ".xml"]}
#: Directories that are never sources of one language, though they may be of another.
PRUNED_FOR = {"java": ["generated-sources", "generated-test-sources"], "python": ["site-packages", "dist-packages", "migrations", ".eggs"], "typescript": ["bower_components", ".nuxt", "storybook-static"], "go": ["testdata", "third_party"], "csharp": ["packages", "TestResults"], "scala": ["project", ".bloop", ".metals"]}
MANIFESTS = {"pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java", "package.json": "typescript", "tsconfig.json": "typescript", "pyproject.toml": "python", "setup.py": "python", "requirements.txt": "python", "go.mod": "go", "build.sbt": "scala"}
MOST_BYTES, HEADER_LINES, LONG_LINE = 1_000_000, 10, 500
GENERATED_HEADER = r"(?i)(code generated|@generated|auto-?generated|do not edit)"


def listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, relative, length, modified): the files below ``root``; contents aren't read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    r = r.option("pathGlobFilter", glob) if glob else r
    df = r.load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    base = root.rstrip("/").removeprefix("file://")
    return df.withColumn("relative", F.regexp_replace("path", f"^(?:file:)?/*{base.lstrip('/')}/", ""))


def pruned(files: DataFrame, language: str | None = None) -> DataFrame:
    """Files of a language outside the directories that are never sources, those whose name begins with a dot among them."""
    parts = F.slice(F.split("relative", "/"), 1, F.greatest(F.lit(0), F.size(F.split("relative", "/")) - 1))
    names = [*PRUNED, *PRUNED_FOR.get(language or "", [])]
    out = files.filter((F.size(F.array_intersect(parts, F.array(*(F.lit(p) for p in names)))) == 0) & ~F.exists(parts, lambda d: d.rlike(r"^\.[^.]")))
    if language is None:
        return out
    ends = F.exists(F.array(*(F.lit(e) for e in EXTENSIONS[language])), lambda e: F.col("relative").endswith(e))
    return out.filter(ends)


def resource_files(files: DataFrame) -> DataFrame:
    """YAML, JSON and XML files below any directory named resources."""
    return files.filter(F.concat(F.lit("/"), F.col("relative")).rlike(r"/resources/(?:.*/)?[^/]+\.(?:ya?ml|json|xml)$"))


def ignore_pattern(rule: str) -> str:
    """The regular expression over relative paths for a line of an ignore file; ``**`` stands for any directories, a rule with
    a slash other than at its end is bound to the root, one that ends with a slash is of directories."""
    directory, bound = rule.endswith("/"), "/" in rule.rstrip("/")
    out, body = "", rule.strip("/")
    i = 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + body[i] if not body[i].isalnum() and body[i] not in "_/ " else body[i]), i + 1
    return ("^" if bound else "^(?:.*/)?") + out + ("/.*$" if directory else "(?:/.*)?$")


def not_ignored(files: DataFrame, rules: Sequence[str], skip_folders: Sequence[str] = ()) -> DataFrame:
    """Files that the lines of an ignore file leave, the last line that fits deciding (``!`` takes back), and that lie outside of
    ``skip_folders``, which are path prefixes."""
    out = F.lit(False)
    for rule in (r.strip() for r in rules):
        if rule and not rule.startswith("#"):
            back = rule.startswith("!")
            out = F.when(F.col("relative").rlike(ignore_pattern(rule.lstrip("!"))), F.lit(not back)).otherwise(out)
    for folder in (f.strip("/") for f in skip_folders):
        if folder:
            out = out | F.col("relative").startswith(folder + "/") | (F.col("relative") == folder)
    return files.filter(~out)


def texts(spark: SparkSession, files: str, glob: str | None = None) -> DataFrame:
    """(path, text): files read whole."""
    read = spark.read.text(files, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def skipped(text: Column, length: Column) -> Column:
    """Whether a file is too large, has a generated header or a line so long that it isn't source."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, HEADER_LINES), "\n")
    return (length > MOST_BYTES) | head.rlike(GENERATED_HEADER) | text.rlike(f"[^\\n]{{{LONG_LINE + 1},}}")


def languages(files: DataFrame) -> DataFrame:
    """(language): those of which a manifest or, for C#, a project file is there."""
    name = F.substring_index("relative", "/", -1)
    of = F.lit(None).cast("string")
    for manifest, language in MANIFESTS.items():
        of = F.when(name == manifest, language).otherwise(of)
    of = F.when(name.rlike(r"\.(csproj|sln)$"), "csharp").otherwise(of)
    return files.select(of.alias("language")).filter("language is not null").distinct()


def frameworks(manifests: DataFrame) -> DataFrame:
    """(framework) by what manifests (path, text) contain."""
    marks = {"spring": "spring-boot|springframework", "angular": '"@angular/core"', "react": '"react"', "express": '"express"', "fastapi": "(?i)fastapi", "flask": "(?i)flask", "django": "(?i)django", "nest": '"@nestjs/core"'}
    found = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(n)) for n, p in marks.items())))
    return manifests.select(F.explode(found).alias("framework")).distinct()


def module_of(files: DataFrame, modules: DataFrame) -> DataFrame:
    """Files with the module whose directory (module_dir) is their longest prefix; a join on exploded prefixes."""
    parts = F.split("relative", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = files.withColumn("prefix", F.explode(prefixes))
    hit = rows.join(modules.select(F.col("module_dir").alias("prefix"), "module_id"), "prefix", "left")
    best = F.max_by("module_id", F.when(F.col("module_id").isNotNull(), F.length("prefix"))).alias("module_id")
    return hit.groupBy(*files.columns).agg(best)


def resources(text_files: DataFrame) -> DataFrame:
    """(path, key, content): a chunk for each top-level key of JSON, key of YAML or child of XML, cut at 3,000 characters."""
    t, p = F.col("text"), F.lower("path")
    pairs = F.from_json(t, T.MapType(T.StringType(), T.StringType()))
    json = text_files.filter(p.endswith(".json")).select("path", F.explode(F.map_entries(pairs)).alias("e")).select("path", "e.key", F.col("e.value").alias("content"))
    blocks = F.regexp_extract_all(t, F.lit(r"(?m)^[A-Za-z_\"'][^\n:]*:[^\n]*(?:\n(?:[ \t#-][^\n]*)?)*"), F.lit(0))
    yaml = text_files.filter(p.rlike(r"\.ya?ml$")).select("path", F.explode(blocks).alias("content")).select("path", F.trim(F.regexp_extract("content", r"^([^:\n]+):", 1)).alias("key"), "content")
    inner = F.regexp_replace(t, r"(?s)^.*?<(?![?!])[\w:.-]+[^>]*>|</[\w:.-]+>\s*$", "")
    kids = F.regexp_extract_all(inner, F.lit(r"(?s)<([\w:.-]+)(?:\s[^>]*)?(?:/>|>.*?</\1>)"), F.lit(0))
    xml = text_files.filter(p.endswith(".xml")).select("path", F.explode(kids).alias("content")).select("path", F.regexp_extract("content", r"^<([\w:.-]+)", 1).alias("key"), "content")
    return json.unionByName(yaml).unionByName(xml).withColumn("content", F.substring("content", 1, 3000))


def beans(json_text: DataFrame) -> DataFrame:
    """(context, bean, type) from an application's bean report (text)."""
    bean = T.StructType([T.StructField("type", T.StringType())])
    schema = T.StructType([T.StructField("contexts", T.MapType(T.StringType(), T.StructType([T.StructField("beans", T.MapType(T.StringType(), bean))])))])
    c = json_text.select(F.explode(F.from_json("text", schema)["contexts"]).alias("context", "c"))
    return c.select("context", F.explode("c.beans").alias("bean", "b")).select("context", "bean", "b.type")
