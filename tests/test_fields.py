"""Fields of single sources and snapshot pointers, stated row by row."""

from pyspark.sql import functions as F

from recordlake.functions import fields
from recordlake.operators import coverage, store


def values(spark, make, rows):
    return [r[0] for r in spark.createDataFrame([(v,) for v in rows], "v string").select(make(F.col("v"))).collect()]


def test_titles_and_classes(spark):
    assert values(spark, fields.theme_number, ["Tema 007 x", "tema 0", "Temas 5", "", None]) == [7, 0, None, None, None]
    assert values(spark, fields.title_status, ["a (b) (  c  d ) ", "(x) y", "", None]) == ["c d", None, None, None]
    assert [tuple(s) for s in values(spark, fields.split_class_subject, [" A / b/c ", "A ", "", None])] == [("A", "b/c"), ("A", None), (None, None), (None, None)]


def test_json_values(spark):
    assert values(spark, fields.json_strings, ['{"a\\"b":"x\\ny","c":[1,"",{"d" : "e:"}]}', "[]", None]) == [["x\ny", "", "e:"], [], None]
    assert values(spark, fields.json_text, ['{"id":3,"nome":""}', '[{"nome":" a "},"b",{}]', " c ", None]) == ["3", "a; b", "c", ""]
    assert values(spark, fields.endpoint_like, ["/API/x", "https://a/Juris", "api/search", "/none"]) == [True, True, False, False]


def test_embedded_files(spark):
    found = values(spark, fields.embedded_file, ["YWJj", "!", "", None])
    assert found[0]["bytes"] == 3 and found[0]["sha256"].startswith("ba7816bf") and found[1:] == [None] * 3


def test_late_and_missing_answers(spark):
    routed = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    answers = spark.createDataFrame([("a", 5, 2, None), ("b", 50, 3, None)], "source string, elapsed_ms int, returned int, error string")
    rows = {r["source"]: tuple(r)[1:] for r in coverage.with_deadline(routed, answers, 10).collect()}
    assert rows == {"a": (2, None, True), "b": (0, "TimeoutError", False), "c": (0, "TimeoutError", False)}


def test_last_snapshot_is_current(spark, tmp_path):
    for n in (1, 2):
        store.save_snapshot(spark, {"t": spark.range(n)}, str(tmp_path), f"v{n}")
        assert store.load_snapshot(spark, str(tmp_path), "t").count() == n
