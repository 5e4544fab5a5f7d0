import pytest

from loomgraph.llm import code_docs

GOOD = "Walks up the chain of owners until a free shard is found."


@pytest.mark.parametrize(
    ("language", "name", "source", "documented"),
    [
        ("java", "run", f"/**\n * {GOOD}\n * @param x y\n */\n@Override\npublic int run(int x) {{\n  return 1;\n}}", True),
        ("java", "run", f"/* {GOOD} */\npublic int run(int x) {{ }}", False),
        ("java", "run", f"// {GOOD}\npublic int run(int x) {{ }}", False),
        ("java", "run", f"/** {GOOD} */\nprivate int other;\n\npublic int run() {{ }}", False),
        ("java", "run", f'public int run() {{\n  var s = "/** {GOOD} */";\n}}', False),
        ("java", "run", "/**\n * @param x the value that is passed to the other service for later\n */\npublic int run(int x) { }", False),
        ("java", "run", "/** {@inheritDoc} */\npublic int run(int x) { }", False),
        ("java", "validateOpenBucket", "/** Validates the open bucket. */\npublic void validateOpenBucket() { }", False),
        ("java", "run", f"/**\r\n * TODO: rename\r\n * {GOOD}\r\n */\r\npublic int run() {{ }}", True),
        ("java", "run", "/**\n * Copyright Somebody. All rights reserved. Licensed under the terms in the file.\n */\nint run() { }", False),
        ("java", "run", "/**\n * if (a == null) { return null; }\n * foo.bar(baz);\n */\nint run() { }", False),
        ("typescript", "load", f"/** {GOOD} */\n@Get('x')\nasync load(a: string): Promise<void> {{ }}", True),
        ("scala", "load", f"/**\n  * {GOOD}\n  */\n@tailrec\ndef load(a: Int): Int = 1", True),
        ("csharp", "Load", f"/// <summary>\n/// {GOOD}\n/// </summary>\npublic int Load() {{ }}", True),
        ("csharp", "Load", '/// <param name="x">the value that is passed to the other service for later</param>\npublic int Load(int x) { }', False),
        ("go", "Load", f"// {GOOD}\nfunc (s *S) Load() error {{\n}}", True),
        ("go", "Load", f"// {GOOD}\n\nfunc (s *S) Load() error {{\n}}", False),
        ("python", "load", f"def load(self):\n    '''{GOOD}'''\n    return 1", True),
        ("python", "load", f"def load(\n    self,\n    x: dict[str, int],\n) -> int:\n    # note\n    r\"\"\"{GOOD}\n\n    Args:\n        x: y\n    \"\"\"", True),
        ("python", "load", f'def load(self):\n    x = 0\n    """{GOOD}"""', False),
        ("python", "load", f"# {GOOD}\ndef load(self):\n    return 1", False),
        ("python", "load", '"""' + GOOD + '"""\ndef load(self):\n    return 1', False),
        ("python", "load", "def load(self):\n    '''\n    Returns\n    -------\n    list of all the values that were found in the table\n    '''", False),
        ("java", "run", "/** Prüft vor dem Schreiben, ob der Eintrag noch gültig ist. */\nint run() { }", True),
        ("java", "run", "/** 値が見つからない場合は空のリストを返します。 */\nint run() { }", True),
        ("cobol", "run", f"/** {GOOD} */\nint run() {{ }}", False),
        ("java", "run", "", False),
        ("java", None, f"/** {GOOD} */\nint run() {{ }}", False),
    ],
)
def test_documented(language, name, source, documented):
    assert (code_docs.pair(source, name, language) is not None) == documented


def test_code_is_the_body():
    code, text = code_docs.pair(f"/** {GOOD} */\nint run() {{\n  if (a) {{ b(); }}\n}}\n\nint other() {{ }}", "run", "java")
    assert code == "int run() {\n  if (a) { b(); }\n}" and text == GOOD
    code, _ = code_docs.pair(f"def f(a,\n      b):\n    '''{GOOD}'''\n    if a:\n        return b\n\ndef g(): pass", "f", "python")
    assert code.endswith("return b")


DOC = f"/** {GOOD} */\n"
BODIES = {
    "python": [
        "def f(a):\n    \'\'\'DOC\n\nA line at column 0: ( [ {\n    \'\'\'\n    x = \'\'\'\nelse\n\'\'\'\n    return x  # )",
        "def f(a):\n    \'\'\'DOC\'\'\'\n# a note at column 0\n    return [\n1,\n]",
        "def f(a):\n    \'\'\'DOC\'\'\'",
        "def f(\n    a='(',\n):\n    \'\'\'DOC\'\'\'\n    s = '\\'{'\n    return s\n    # the end",
    ],
    "java": [
        "int f() {\n  /* { */\n  // }}\n  return 1;\n}",
        'int f() {\n  var s = """\n    }\n    "} \\""" {\n    """;\n  return s;\n}',
        "int f() {\n  char c = '{', d = '\\'', e = '\\u007b';\n  String s = \"}\\\"}\";\n}",
        "int f(int a,\n      int b)\n    throws X\n{\n  return a;\n}",
        "abstract int f();",
    ],
    "csharp": ['int f() {\n  var s = @"\n}"" {";\n  var t = $"{s}}}";\n}', "int f() => 1;"],
    "typescript": ["f({ a, b }: P): { c: number } {\n  const s = `}\n${a}`, r = /[{/]}/g;\n  return s;\n}", "const f = (a) =>\n  a + 1", "const f = (a) => a + 1"],
    "scala": ["def f(a: Int): Int = a + 1", "def f(a: Int): Int =\n  a +\n    1", "def f() = {\n  /* { /* } */ } */\n  val s = \"\"\"}\n}\"\"\"\n  val c = '{'\n  s\n}", "def f(a: Int): Int = a match {\n  case 1 => 2\n}"],
    "go": ["func (s *S) f() interface{} {\n\tx := `}\n}`\n\tr := '{'\n\treturn x // }\n}"],
}
OTHER = {"python": "\n\ndef g():\n    pass", "java": "\n\nint g() { }", "csharp": "\n\nint g() { }", "typescript": "\n\ng() { }", "scala": "\n\ndef g() = 2", "go": "\n\nfunc g() { }"}


@pytest.mark.parametrize(("language", "body"), [(language, b) for language, bodies in BODIES.items() for b in bodies])
def test_bodies(language, body):
    doc = {"python": "", "go": f"// {GOOD}\n", "csharp": f"/// {GOOD}\n"}.get(language, DOC)
    body = body.replace("DOC", GOOD)
    for after in ("", OTHER[language]):
        code, text = code_docs.pair(doc + body + after, "f", language)
        assert code == body
        assert text.startswith(GOOD[:-1])


def test_declarations_in_strings_are_none():
    source = f'String s = """\n/** {GOOD} */\nint f() {{ }}\n""";\nint f() {{ }}'
    assert code_docs.pair(source, "f", "java") is None


def test_table(spark):
    rows = [("1", "java", "run", "C#run()", f"/** {GOOD} */\nint run() {{ }}", "x"), ("2", "java", "run", None, None, "x"), ("1", "java", "run", "C#run()", f"/** {GOOD} */\nint run() {{ }}", "x"), ("3", "java", None, "C#run()", f"/** {GOOD} */\nint run() {{ }}", "x"), ("4", None, "run", None, "text " * 50_000, "x")]
    df = spark.createDataFrame(rows, "id string, language string, method_name string, signature string, source string, description string")
    assert sorted(r["id"] for r in code_docs.code_pairs(df).collect()) == ["1", "1", "3"]
    assert code_docs.code_pairs(df.limit(0)).count() == 0
