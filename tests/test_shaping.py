import json
import random

import pytest
from pyspark.sql import functions as F

from diffloom.functions import scalars
from diffloom.operators import annotate as an
from diffloom.operators import classify as cl
from diffloom.operators import gather as ga
from diffloom.operators import shaping as sh
from diffloom.sources import annotation_json as aj
from diffloom.sources import sinks
from diffloom.sources.diffs import read_diffs
from tests_data import documents


def test_adjusted_paths(spark):
    paths = {".": (0, "."), "a": (1, "a"), "a/b": (2, "..b"), "a/b/*": (2, "..b/*"), "a/b/**": (3, "...b/**"), "./*": (1, "./*"), "**": (1, "**")}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r[0]: (r[1], r[2]) for r in df.select("p", scalars.adjusted_depth(F.col("p")), scalars.adjusted_name(F.col("p"))).collect()} == paths


def test_orders(spark):
    assert sh.by_type(["+:type.other", "x", "+:type.test", "-:type.code", "+:type.code"]) == ["-:type.code", "+:type.code", "+:type.test", "x", "+:type.other"]
    rows = spark.createDataFrame([("b/a",), (".",), ("a",), ("a/b/c",)], "p string")
    assert [r.p for r in rows.orderBy(*sh.by_depth(F.col("p"))).collect()] == [".", "a", "b/a", "a/b/c"]


def test_votes(spark):
    flat = spark.createDataFrame([("i", "u1", "bug", 3), ("i", "u1", "bug", 1), ("i", "u2", "doc", 1), ("i", None, "doc", 1), ("j", "u1", "doc", 2)], "id string, user string, label string, line int")
    nested = sh.nested_votes(flat, ["id"])
    assert {r.id: r.votes for r in nested.collect()}["i"] == {"u1": {"bug": [1, 3]}, "u2": {"doc": [1]}}
    back = {tuple(r) for r in sh.flat_votes(nested, ["id"]).collect()}
    assert back == {tuple(r) for r in flat.filter("user IS NOT NULL").collect()}
    wide = {(r.id, r.line): (r.user_u1, r.user_u2) for r in sh.wide_users(flat.filter("user IS NOT NULL"), ["id"]).collect()}
    assert wide == {("i", 1): ("bug", "doc"), ("i", 3): ("bug", None), ("j", 2): ("doc", None)}


def test_names_totals_and_differences(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5), (None, 2)], "k string, n int")
    assert [r[0] for r in df.select(sh.renamed(F.col("k"), {"a": "alpha"})).collect()] == ["alpha", "b", None]
    assert {tuple(r) for r in sh.with_total(df, "k", [F.sum("n").alias("n")]).collect()} == {("a", 1), ("b", 5), (None, 2), ("(all)", 8)}
    assert {r.k for r in sh.missing_from(df.select("k").unionByName(df.select("k")), spark.createDataFrame([("a",)], "k string")).collect()} == {"b", None}


def test_median_interval(spark):
    rng = random.Random(3)
    values = [rng.gauss(50, 10) for _ in range(400)]
    r = sh.median_interval(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v").first()
    assert r.low <= r.median <= r.high and 0.5 < r.high - r.low < 6
    many = sh.median_interval(spark.range(3000).select((F.col("id") % 3).alias("v")), "v").first()
    assert (many.median, many.low, many.high) == (1, 1, 1)
    assert tuple(sh.median_interval(spark.createDataFrame([], "v double"), "v").first()) == (None, None, None)


def test_functions_of_users(spark):
    df = spark.createDataFrame([("a", 3), ("b", None), ("a", 4)], "k string, n int")
    assert {r.key: r.n for r in ga.mapped_counts(df, lambda k, n: {k: int(n or 0), "rows": 1}).collect()} == {"a": 7, "b": 0, "rows": 3}
    lines = an.annotated_lines(spark.createDataFrame([("p", "diff --git a/m.py b/m.py\n--- a/m.py\n+++ b/m.py\n@@ -1 +1,2 @@\n-x\n+import y\n+z\n")], "patch_id string, text string"), callback=cl.python_callback(lambda tokens: "import" if tokens[0][2] == "import" else None))
    assert {(r.side, r.file_line_no): r.type for r in lines.collect()} == {("-", 1): "code", ("+", 1): "import", ("+", 2): "code"}


def test_documents_written_and_read(spark, tmp_path):
    d = documents(spark).filter("patch_id = 'p'").withColumn("patch_id", F.lit("ab" + "c" * 38))
    for fan_out, name in ((False, "ab" + "c" * 38), (True, "ab/" + "c" * 38)):
        folder = tmp_path / str(fan_out)
        assert sinks.write_documents(d, str(folder), fan_out) == 1
        written = [p for p in folder.rglob("*") if p.is_file()]
        assert [str(p).endswith(f"/annotation/{name}.v2.json") for p in written] == [True]
        assert json.loads(written[0].read_text())["changes"]["a.py"]["purpose"] == "programming"
    back = aj.read_annotations(spark, str(tmp_path / "False")).first()
    assert back.changes == d.first().changes and back.patch_id == "ab" + "c" * 38
    assert sinks.write_documents(d, str(tmp_path / "placed"), place=F.lit("x/y.json")) == 1 and (tmp_path / "placed/x/y.json").exists()


def test_diffs_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([("ab" + "1" * 38, "diff one\n"), ("cd" + "2" * 38, None)], "patch_id string, text string")
    for fan_out in (True, False):
        folder = tmp_path / str(fan_out) / "bug-1" / "patches"
        assert sinks.write_diffs(rows, str(folder), fan_out) == 2
        assert {(r.bug_id, r.patch_id, r.text) for r in read_diffs(spark, str(tmp_path / str(fan_out)), fan_out).collect()} == {("bug-1", "ab" + "1" * 38, "diff one\n")}
        assert sorted(p.stat().st_size for p in folder.rglob("*.diff")) == [0, 9]  # Spark doesn't list empty files


@pytest.mark.parametrize("n", [0, 3])
def test_report_in_one_file(spark, tmp_path, n):
    rows = spark.createDataFrame([(f"k{i % 2}", i, None) for i in range(n)], "dataset string, n int, empty string").repartition(3)
    assert sinks.write_report(rows, str(tmp_path / "a/report.json")) == n
    assert sorted(r["n"] for r in json.loads((tmp_path / "a/report.json").read_text())) == list(range(n))
    assert sinks.write_report(rows, str(tmp_path / "b.json"), key="dataset") == n
    got = json.loads((tmp_path / "b.json").read_text())
    assert {k: sorted(x["n"] for x in v) for k, v in got.items()} == ({"k0": [0, 2], "k1": [1]} if n else {})
    assert not n or "\n        {" in (tmp_path / "b.json").read_text()


def test_records_and_timelines(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\noops,y\n")
    got = {(r.a, r.b, r._damaged) for r in aj.read_records(spark, str(tmp_path / "x.csv"), "a int, b string").collect()}
    assert got == {(1, "x", None), (None, "y", "oops,y")}
    (tmp_path / "x.json").write_text('{"a": 1}\n{"a"\n')
    assert {(r.a, r._damaged is None) for r in aj.read_records(spark, str(tmp_path / "x.json"), "a int", "json").collect()} == {(1, True), (None, False)}
    (tmp_path / "t.timeline.json").write_text('{"d": [{"bug_id": "b", "+:count": 3, "x": 1.5}, {"bug_id": "7"}], "none": []}')
    rows = aj.read_timeline(spark, str(tmp_path / "t.timeline.json"), ["+:count", "-:count"]).collect()
    assert [(r.dataset, r["+:count"], r["-:count"], r.counts) for r in rows] == [("d", 3, None, {"+:count": 3}), ("d", None, None, {"bug_id": 7})]
