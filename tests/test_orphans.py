from datetime import datetime as D

import pytest

from loomgraph.operators import orphans as o

CLASS = "id string, indexed_at timestamp_ntz, deleted_at timestamp_ntz"
METHOD = "id string, class_id string, indexed_at timestamp_ntz, deleted_at timestamp_ntz"
CALL = "id string, caller_method_id string, resolved_candidates_json string, indexed_at timestamp_ntz, refs string, exists string"


def brute(methods, calls, classes):
    """Straight from the definition, in plain Python."""
    import json

    def end(at):
        return D(at.year + at.month // 12, at.month % 12 + 1, 1)

    def norm(x):
        return x.strip(" ").lower()

    def missing(target, key, at):
        return not any(r[0] and norm(r[0]) == key and r[-2] and r[-2] < end(at) and (r[-1] is None or r[-1] >= end(at)) for r in target)

    out = set()

    def see(table, field, row, at, value, target):
        if at and value and norm(value) and missing(target, norm(value), at):
            out.add((table, field, row, at.strftime("%Y-%m"), norm(value)))

    for i, c, at, _ in methods:
        see("methods", "class_id", i, at, c, classes)
    for i, c, j, at in (r[:4] for r in calls):
        see("callsites", "caller_method_id", i, at, c, methods)
        try:
            values = json.loads(j or "")
        except ValueError:
            continue
        for v in values if isinstance(values, list) else []:
            see("callsites", "resolved_candidates_json", i, at, v, methods)
    return out


CLASSES = [("c1", D(2024, 1, 5), None), ("c2", D(2024, 3, 1), None), ("c3", D(2024, 1, 1), D(2024, 2, 1)), ("c3", D(2024, 4, 1), None), ("c4", D(2024, 5, 1), D(2024, 4, 1)), (None, D(2024, 1, 1), None), ("c5", None, None)]
METHODS = [("m1", " C1 ", D(2024, 1, 31, 23), None), ("m2", "c2", D(2024, 2, 29), None), ("m2", "c2", D(2024, 3, 1), D(2024, 6, 1)), ("m3", "c3", D(2024, 1, 2), None), ("m4", "c3", D(2024, 2, 2), None), ("m5", "c3", D(2024, 4, 2), None), ("m6", "", D(2024, 1, 1), None), ("m7", None, D(2024, 1, 1), None), ("m8", "c4", D(2024, 6, 1), None), ("m9", "nope", D(2024, 12, 31), None), ("m9", "nope", D(2024, 12, 31), None), ("mx", "c5", D(2024, 7, 1), None), ("my", "zz", None, None)]
CALLS = [("k1", "m1", '["m2", "M9 "]', D(2024, 2, 1), "", ""), ("k2", "gone", '["m1"', D(2024, 2, 1), "", ""), ("k3", None, "[]", D(2024, 2, 1), "", ""), ("k4", " ", None, D(2024, 2, 1), "", ""), ("k5", "m2", '[null, "q"] x', D(2024, 7, 1), "", ""), ("k6", "m2", '{"a": 1}', D(2024, 7, 1), "", ""), ("k7", "m1", '[ "q" , null, "m1"]', D(2024, 7, 1), "", ""), ("k8", "m1", "['q2']", D(2024, 7, 1), "", "")]


def found(spark, methods, calls, classes):
    df = o.code_graph_orphans(spark.createDataFrame(methods, METHOD), spark.createDataFrame(calls, CALL), spark.createDataFrame(classes, CLASS))
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_definition(spark):
    assert found(spark, METHODS, CALLS, CLASSES) == brute(METHODS, CALLS, CLASSES)


def test_empty_tables(spark):
    assert found(spark, [], [], []) == set()
    assert found(spark, METHODS[:1], [], []) == {("methods", "class_id", "m1", "2024-01", "c1")}


def test_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(o, "HOT_ROWS", 5)
    monkeypatch.setattr(o, "HOT_SHARE", 10)
    methods = [(f"m{i}", "hot" if i % 2 else f"c{i % 7}", D(2024, 1, 1), None) for i in range(200)]
    assert found(spark, methods, [], CLASSES) == brute(methods, [], CLASSES)


def test_state_is_the_same_in_batches(spark):
    classes = spark.createDataFrame(CLASSES, CLASS)
    parts = [o.existence_deltas(classes.filter("id = 'c3'"), "classes"), o.existence_deltas(classes.filter("id <> 'c3'"), "classes")]
    whole = o.merged_state(o.existence_deltas(classes, "classes"))
    rows = lambda df: sorted(tuple(r) for r in df.filter("exists <> 0").collect())
    assert rows(o.merged_state(*parts)) == rows(whole)


@pytest.mark.parametrize(("text", "n"), [('["a","b"]', 2), ("[]", 0), ("[null]", 1), ('["a"', None), ('["a"] x', None), ("", None), (None, None), ('"a"', None), ('{"a":[]}', None), ("['a']", None), ('["a",]', None), (' [ "a\\"b" ] ', 1)])
def test_json_ids(spark, text, n):
    got = spark.createDataFrame([(text,)], "j string").select(o.json_ids("j").alias("x")).first()["x"]
    assert (None if got is None else len(got)) == n
