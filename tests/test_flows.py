"""Stack traces as texts have them, odd ones too."""

from loomgraph.operators import flows

TEXT = "boom\n\tat a.b.C.run(C.java:12)\n\tat a.b.C.run(C.java:7741234567890123456789)\n  File \"/x/y.py\", line 2147483648, in go\n  File \"/x/y.py\", line 3, in go\n"


def test_line_numbers_that_no_int_holds(spark):
    got = flows.stack_frames(spark.createDataFrame([(1, TEXT)], "id int, text string")).orderBy("position").collect()
    assert [(r["class"], r["method"], r["file"], r["line"]) for r in got] == [("a.b.C", "run", "C.java", 12), ("a.b.C", "run", "C.java", None), (None, "go", "y.py", None), (None, "go", "y.py", 3)]


def test_frames_without_a_line_are_matched_by_name(spark):
    fields = "id string, class_full_name string, method_name string, file_path string, start_line int, end_line int"
    methods = spark.createDataFrame([("m1", "a.b.C", "run", "/s/C.java", 10, 20), ("m2", "y", "go", "/x/y.py", 1, 2), ("m3", "y", "go", "/x/y.py", 3, 4)], fields)
    got = flows.matched_frames(flows.stack_frames(spark.createDataFrame([(1, TEXT)], "id int, text string")), methods).orderBy("position").collect()
    assert [(r["line"], r["status"], r["method_id"]) for r in got] == [(12, "matched", "m1"), (None, "matched", "m1"), (None, "ambiguous", None), (3, "matched", "m3")]
