import json
from datetime import datetime as D
from datetime import timedelta

import pytest

from loomgraph.sources import files, python_code, smithy, store
from loomgraph.streaming import debounce


@pytest.fixture
def tree(tmp_path):
    for path, text in {
        "pom.xml": "<project><parent>spring-boot</parent><version>1</version></project>",
        "src/a.py": "import os\nfrom x.y import z\n\n@dataclass\nclass A(models.Model):\n    @app.get('/x')\n    def f(self, n: int) -> str:\n        return self.g(n, 2)\n",
        "src/bad.py": "def (:\n",
        "node_modules/m/b.py": "x = 1\n",
        "resources/c.json": '{"a": {"b": 1}, "c": "text"}',
        "resources/d.yaml": "one: 1\ntwo:\n  three: 3\n",
        "api.smithy": 'namespace x.y\n\nservice Shop {\n  version: "1"\n  operations: [GetItem]\n}\n\n@http(method: "GET", uri: "/items/{id}")\noperation GetItem {\n  input := {\n    @required\n    id: String\n  }\n  output: Item\n  errors: [NotFound]\n}\n\nstructure Item {\n  /// a { brace }\n  name: String\n}\n',
    }.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path


def test_walk(spark, tree):
    all_ = files.listing(spark, str(tree))
    assert {r["relative"] for r in files.pruned(all_, "python").collect()} == {"src/a.py", "src/bad.py"}
    assert {r["language"] for r in files.languages(all_).collect()} == {"java"}
    assert {r["framework"] for r in files.frameworks(files.texts(spark, str(tree), "pom.xml")).collect()} == {"spring"}
    modules = spark.createDataFrame([("", "root"), ("src", "code")], "module_dir string, module_id string")
    got = {r["relative"]: r["module_id"] for r in files.module_of(all_.select("relative"), modules).collect()}
    assert got["src/a.py"] == "code" and got["pom.xml"] == "root"


def test_python(spark, tree):
    rows = python_code.parse(files.texts(spark, str(tree / "src"), "*.py"))
    kinds = {(r["kind"], r["name"]) for r in rows.collect()}
    assert {("class", "A"), ("function", "f"), ("call", "g"), ("import", "os"), ("import", "x.y.z"), ("error", "SyntaxError")} <= kinds
    assert python_code.classes(rows).first()["stereotypes"] == ["dataclass", "django_model"]
    assert python_code.functions(rows).first()["role"] == "fastapi_route"
    assert python_code.calls(rows).filter("callee_name = 'g'").first()["argument_count"] == 2


def test_smithy(spark, tree):
    shapes = smithy.parse(files.texts(spark, str(tree), "*.smithy"))
    op = smithy.operations(shapes).first()
    assert (op["name"], op["service"], op["input"], op["output"], op["errors"], op["http_method"]) == ("GetItem", "Shop", "GetItemInput", "Item", ["NotFound"], "GET")
    members = {r["name"]: r["members"] for r in shapes.collect()}
    assert members["GetItemInput"][0]["required"] and members["Item"][0]["name"] == "name"


def test_resources(spark, tree):
    got = {(r["path"].rsplit("/", 1)[-1], r["key"]) for r in files.resources(files.texts(spark, str(tree))).collect()}
    assert {("c.json", "a"), ("c.json", "c"), ("d.yaml", "one"), ("d.yaml", "two"), ("pom.xml", "parent"), ("pom.xml", "version")} <= got
    report = spark.createDataFrame([(json.dumps({"contexts": {"app": {"beans": {"b1": {"type": "x.Y"}}}}}),)], "text string")
    assert [tuple(r) for r in files.beans(report).collect()] == [("app", "b1", "x.Y")]


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("1", "main", "m"), ("2", "test", "m")], "id string, variant string, module_id string")
    path = str(tmp_path / "t")
    store.write_scope(df, path)
    store.write_scope(spark.createDataFrame([("3", "test", "m")], df.schema), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == ["1", "3"]
    first = store.write_snapshot(df, str(tmp_path), "s1")
    second = store.upsert_snapshot(spark, first, spark.createDataFrame([("2", "main", "m")], df.schema), ["id"], str(tmp_path), "s2")
    assert {(r["id"], r["variant"]) for r in spark.read.parquet(second).collect()} == {("1", "main"), ("2", "main")}
    df.createOrReplaceTempView("things")
    got, more = store.ad_hoc(spark, "select * from things", 1)
    assert more and got.count() == 1
    with pytest.raises(ValueError):
        store.ad_hoc(spark, "drop table things")
    with pytest.raises(ValueError):
        store.checked_version({"version": "0"})
    assert store.dot_lines(spark.createDataFrame([('a"b', "c")], "src string, dst string")).first()["value"] == '  "a\\"b" -> "c";'


def test_bursts_batch_and_stream(spark, tmp_path):
    t0 = D(2024, 1, 1)
    at = [t0 + timedelta(milliseconds=x) for x in (0, 200, 400, 2000, 2100)]
    rows = [("r", f"f{i % 3}", "modify", x) for i, x in enumerate(at)]
    got = debounce.bursts(spark.createDataFrame(rows, debounce.EVENTS)).orderBy("start").collect()
    assert [(r["events"], r["paths"]) for r in got] == [(3, ["f0", "f1", "f2"]), (2, ["f0", "f1"])]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps({"repository": r, "path": p, "kind": k, "at": x.isoformat()}) for r, p, k, x in rows))
    seen = []
    debounce.drain(debounce.file_events(spark, str(folder)), lambda df, n: seen.extend(debounce.bursts(df).collect()), str(tmp_path / "cp"))
    assert sorted(r["events"] for r in seen) == [2, 3]


def test_ignore_rules_and_resources(spark):
    paths = ["a.log", "x/a.log", "x/keep.log", "build/a.py", "x/build/a.py", "docs/a/b.md", "docs/c.md", "legacy/a.py", "vendor/legacy/a.py", "resources/a.yml", "m/src/main/resources/x/b.json", "resources.json", "q/resources/c.txt", ".hidden/a.py", "migrations/a.py"]
    df = spark.createDataFrame([(p,) for p in paths], "relative string")
    kept = {r[0] for r in files.not_ignored(df, ["# a comment", "", "*.log", "!keep.log", "/build/", "docs/**/b.md"], ["legacy/"]).collect()}
    assert set(paths) - kept == {"a.log", "x/a.log", "build/a.py", "docs/a/b.md", "legacy/a.py"}
    assert {r[0] for r in files.resource_files(df).collect()} == {"resources/a.yml", "m/src/main/resources/x/b.json"}
    assert {r[0] for r in files.pruned(df, "python").collect()} == {"legacy/a.py"}
    assert "migrations/a.py" in {r[0] for r in files.pruned(df).collect()}


def test_traits_of_any_length(spark):
    long = "/// " + "words of a long description " * 60
    text = f'namespace n\n\nstructure A {{ x: String }}\n{long}\n@documentation("with {{ and ) within")\n@http(method: "GET", uri: "/a(b)")\noperation Get {{\n  input: A\n}}\noperation Other {{ input: A }}\n'
    rows = smithy.shapes_of("p", text)
    detail = {r[3]: json.loads(r[5]) for r in rows}
    assert detail["Get"]["uri"] == "/a(b)" and "uri" not in detail["Other"]


def test_views_and_times(spark):
    text = "class V(APIView):\n    def get(self): pass\n    def other(self): pass\nclass W:\n    def get(self): pass\n@app.head('/x')\ndef h(): pass\n"
    rows = spark.createDataFrame(python_code.rows_of("a.py", text), python_code.ROWS)
    got = {(r["owner"], r["name"]): r["role"] for r in python_code.functions(rows).collect()}
    assert got == {("V", "get"): "django_handler", ("V", "other"): None, ("W", "get"): None, (None, "h"): "fastapi_route"}
    assert store.iso_times(spark.createDataFrame([(1_700_000_000_123,)], "ts long")).first()["ts_iso"] == "2023-11-14T22:13:20.123Z"
    burst = spark.createDataFrame([("r", D(2024, 1, 1), [f"f{i:03d}" for i in range(120)]), ("s", D(2024, 1, 1), [])], "repository string, start timestamp, paths array<string>")
    assert [(r["portion"], len(r["paths"])) for r in debounce.portions(burst).orderBy("portion").collect()] == [(0, 50), (1, 50), (2, 20)]
