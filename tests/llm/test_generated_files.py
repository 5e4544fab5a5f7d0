import random

import numpy as np
import pytest
import xxhash

from loomgraph.llm import generated_files as g


def numbered(files):
    """Tokens, members, files and hashes of files that are lists of members."""
    table, tokens, members, of = {}, [], [], []
    for f, texts in enumerate(files):
        for s in texts:
            for w in s.split():
                tokens.append(table.setdefault(w, len(table)))
                members.append(len(of))
            of.append(f)
    hashes = np.array([xxhash.xxh64_intdigest(w) | 1 for w in table] + [0], np.uint64)
    return np.array(tokens, np.int32), np.array(members, np.int64), np.array(of, np.int64), hashes


def test_grammar_shortens_what_repeats():
    rng = random.Random(1)
    noise = " ".join(str(rng.random()) for _ in range(200))
    out = g.grammars(*numbered([["a b c d " * 50], [noise], ["x " * 64]]))
    assert out["final"][0] <= 12 and out["final"][1] == 200 and out["final"][2] <= 4 and out["rules"][1] == 0


def test_grammar_sees_what_repeats_between_members_of_a_file():
    getter = "public int get {i} ( ) {{ return value {i} ; }}"
    apart = g.grammars(*numbered([[getter.format(i=i)] for i in range(50)]))
    together = g.grammars(*numbered([[getter.format(i=i) for i in range(50)]]))
    assert apart["rules"].sum() == 0
    assert together["final"][0] + 2 * together["rules"][0] < 0.5 * apart["final"].sum()


def test_grammar_does_not_depend_on_the_other_files():
    rng = random.Random(2)
    texts = [[" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 90))) for _ in range(3)] for _ in range(20)]
    together = g.grammars(*numbered(texts))
    for i, members in enumerate(texts):
        alone = g.grammars(*numbered([members]))
        if alone["final"].size:
            assert (alone["final"][0], alone["rules"][0]) == (together["final"][i], together["rules"][i])


def test_long_runs_are_compressed_whole():
    rng = random.Random(3)
    run = " ".join(f"t{rng.random()}" for _ in range(900))
    out = g.grammars(*numbered([[run + " middle " + run]]))
    assert out["final"][0] <= 60  # more rounds than 40 would be needed from one end


def test_copies_that_differ_in_a_token_share_rules():
    lines = [f"call{i} ( arg{i} , {i} ) ;" for i in range(60)]
    a = " ".join(lines)
    lines[30] = lines[30].replace("arg30", "other")
    files, rules, sizes = g.phrases(*numbered([[a], ["z " + " ".join(lines)], ["p q r s " * 20]]))
    of = [dict(zip(rules[files == f].tolist(), sizes[files == f].tolist(), strict=True)) for f in range(3)]
    assert sum(n for h, n in of[0].items() if h in of[1]) > 0.75 * 420 and not set(of[0]) & set(of[2])


MARKED = ["m/node_modules/x/a.js", "m/build/generated/sources/A.java", "m/target/generated-sources/t/A.java", "m/vendor/lib/a.go", "m\\third_party\\lib\\A.java", "./m/obj/Debug/A.g.cs", "m/src/a_pb2.py", "m/src/gen/a_pb.ts", "m/internal/x/a.pb.go", "m/src/a.min.js", "m/dist/main.0a1b2c3d.js", "m/src/assets/lib-1.2.3.js", "m/src/X/A.Designer.cs", "m/packages/Lib.1.2/A.cs", "m/internal/zz_generated_a.go", "m/venv/lib/python3/site-packages/x/a.py"]
PLAIN = ["m/src/main/java/org/x/vendor/VendorA.java", "m/src/App/External/A.cs", "m/src/App/Build/A.cs", "m/src/x/vendor-a.ts", "m/internal/x/generated_a.go", "m/src/a_generated_b.py", "m/tests/x/vendor/test_a.py", "build.py", "m/src/distance.go"]


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p in MARKED + PLAIN], "p string")
    got = {r["p"] for r in df.filter(g.marked_path(df["p"])).collect()}
    assert got == set(MARKED)


@pytest.mark.parametrize(
    ("line", "mark"),
    [("// Code generated by tool v1.2. DO NOT EDIT.", 1), ("/* @generated by tool */", 1), ("# <auto-generated> produced by tool </auto-generated>", 1), ("// Automatisch von tool erzeugt - nicht von Hand ändern", 1), ("// This file was automatically created by tool from a.idl", 1), ("/*lib 1.2 - copied from upstream, keep in sync with the lib release */", 2), ("/*! lib v1.2.3 | (c) lib contributors | BSD-3 */", 2), ("/** Auto-generated method stub */", 0), ("// do not edit the order of these checks", 0), ("// Copyright Somebody. All rights reserved.", 0), ('emit("Code generated by tool. DO NOT EDIT.");', 0)],
)
def test_banners(line, mark):
    assert g.banner(f"\n{line}\n\nint f() {{ }}") == mark
    assert g.banner(f"int f() {{\n{line}\n}}") == 0


def test_files(spark):
    mini = "".join(f"function {a}({b}){{return {b}.{a}||{i}}};var {a}={b}?{a}:void 0;" for i, (a, b) in enumerate(zip("abcdefghijklmnop", "qrstuvwxyzabcdef", strict=True)))
    data = "int[] t() { return { " + ", ".join(f"0x{i * 2654435761 % 65536:04x}" for i in range(150)) + " }; }"
    hand = "public int sum(int[] values) {\n  int total = 0;\n  for (int value : values) { total += value; }\n  return total;\n}\n"
    shared = "int shared() { " + " ".join(f"call{i}(arg{i});" for i in range(40)) + " }"
    rows = [("m/src/mini.js", mini, None), ("m/src/Data.java", data, False), ("m/src/Hand.java", hand, True), ("m/src/Hand.java", None, True), ("m/src/Banner.java", "// Generated by tool, do not modify!\n" + hand, None), (None, hand, None), ("m/src/Null.java", None, True), ("m/src/Empty.java", "", True)]
    rows += [(f"{r}/src/Copy.java", shared.replace("arg9)", f"{r})"), None) for r in "xyz"]
    rows += [("m/src/Many.java", f"  public String get{chr(65 + i // 26)}x{chr(97 + i % 26)}() {{\n    return this.n{chr(97 + i % 26)}{chr(65 + i // 26)};\n  }}\n", None) for i in range(60)]
    rows += [("m/src/Flags.java", hand + f"// {i}", True) for i in range(2)] + [("m/src/Mixed.java", hand + f"// {i}", i > 0) for i in range(3)]
    rows.append(("m/src/Long.java", "x = y;\n" * 700_000, None))
    methods = [(p, f"{i}", s, flag) for i, (p, s, flag) in enumerate(rows)]
    methods += [("m/src/Again.java", "same", hand + hand[::-1] * i, None) for i in range(30)]
    classes = [("m/src/Ann.java", ['@Generated("tool")']), ("m/src/Ann.cs", ["[CompilerGenerated]", None]), ("m/src/Member.java", ["@GeneratedValue"]), ("m/src/Hand.java", None), (None, ['@Generated("tool")'])]
    m = spark.createDataFrame(methods, "file_path string, id string, source string, generated boolean").selectExpr("*", "timestamp'2024-01-01' as indexed_at", "1 as tokens", "2 as rest")
    c = spark.createDataFrame(classes, "file_path string, annotations array<string>")
    got = {r["file_path"]: r for r in g.judged_files(m, c).collect()}
    found = {"mini.js": "minified", "Data.java": "data", "Banner.java": "tool", "Ann.java": "annotated", "Ann.cs": "annotated", "Many.java": "written", "Flags.java": "flagged"}
    for name, mark in found.items():
        assert got[f"m/src/{name}"][mark], name
    assert {p for p, r in got.items() if not r["by_hand"]} == {*(f"m/src/{n}" for n in found), "x/src/Copy.java", "y/src/Copy.java", "z/src/Copy.java"}
    assert {"m/src/Null.java", "m/src/Empty.java", "m/src/Long.java", "m/src/Again.java"} <= set(got) and None not in got
    twice = {r["file_path"]: r for r in g.judged_files(m.unionByName(m), c.unionByName(c)).collect()}
    assert twice == got
    assert g.judged_files(m.limit(0), c.limit(0)).count() == 0
