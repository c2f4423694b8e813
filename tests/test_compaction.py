import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from diffloom.operators.compaction import (
    clean_bug, clean_patch, compact, compact_annotation_files, documents_in, layout_of, plan_groups, split_documents,
)

A, B, C = "a" * 40, "b" * 40, "c" * 40
SCHEMA = "file_path string, bug_id string, patch_id string, n_bytes bigint, modified_at timestamp, content string, document int"


def doc(patch, **more):
    return json.dumps({"commit_metadata": {"id": patch}, "changes": {"f.py": {"type": "programming"}}, **more})


def test_documents_in_takes_complete_objects_only():
    assert [d for d, _ in documents_in('{"a": 1}')] == [{"a": 1}]
    assert [d for d, _ in documents_in('[{"a": 1}, {}, null, 3, {"b": 2}]')] == [{"a": 1}, {"b": 2}]
    assert [d for d, _ in documents_in('{"a": 1}\n{"b":\n{"c": 3}\n')] == [{"a": 1}, {"c": 3}]
    for none in (None, "", "  \n", "null", "{}", "[]", "3", '"x"', '{"a": {"b": 1}', '{\n "a": [\n {},\n  0\n'):
        assert documents_in(none) == []


def test_documents_in_takes_every_intact_line():
    for first in ("null", "3", "oops", '"a": 1}', "# note"):
        assert [d for d, _ in documents_in(first + '\n{"b": 2}\n{"c": 3}\n')] == [{"b": 2}, {"c": 3}]
    for mark in ("\u2028", "\u2029", "\x85"):
        assert [d for d, _ in documents_in(f'{{"a": "x{mark}y"}}\n{{"b": 2}}')] == [{"a": f"x{mark}y"}, {"b": 2}]
    for end in ("\r\n", "\r"):
        assert [d for d, _ in documents_in(end.join(['{"a": 1}', '{"b":', '{"c": 3}']))] == [{"a": 1}, {"c": 3}]


def test_ids():
    assert clean_bug("crawl/tarvik-1/annotation/x.json", None) == "tarvik-1"
    assert clean_bug(None, " Tarvik-1/ ") == "tarvik-1"
    assert clean_bug(None, None) is None
    assert clean_patch({}, f"d/b/{A[:2].upper()}/{A[2:].upper()}.v2.json", None) == A
    assert clean_patch({}, None, A + ".diff.json") == A
    assert clean_patch({"commit_metadata": {"id": B.upper()}}, f"d/b/{A}.json", None) == B
    assert clean_patch({"commit_metadata": None}, "d/b/batch-1.json", None) is None


def test_layouts():
    assert layout_of({"changes": {}}) == "v2"
    assert layout_of({"commit_metadata": {}, "f": {}}) == "v1.5"
    assert layout_of({"f": {}}) == "v1"


def test_each_document_once(spark):
    early, late = datetime(2024, 1, 1), datetime(2024, 2, 1)
    rows = [
        (f"x/bug-1/{A}.json", "bug-1", f"{A}.json", 1, early, doc(A, old=True), 1),
        (f"x/bug-1/{A}.json", "bug-1", f"{A}.json", 1, early, doc(A, old=True), 2),
        (f"x/bug-1/annotation/{A[:2]}/{A[2:]}.json", "BUG-1", None, 1, late, doc(A), 3),
        (f"x/bug-2/{A}.json", None, None, 1, None, doc(A), 4),
        ("x/bug-1/batch-1.jsonl", "bug-1", None, 1, None, doc(B) + "\n" + doc(C)[:-5], 5),
        (f"x/bug-1/{C}.json", "bug-1", None, 0, early, "null", 6),
        (None, None, None, None, None, None, None),
    ]
    files = spark.createDataFrame(rows, SCHEMA)
    done = compact_annotation_files(files, target_bytes=1)
    got = {(r.bug_id, r.patch_id): json.loads(r.document) for r in done.table.collect()}
    assert set(got) == {("bug-1", A), ("bug-2", A), ("bug-1", B)}
    assert "old" not in got["bug-1", A]
    assert done.groups.agg(F.sum("n_rows")).first()[0] == 3


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    done = compact_annotation_files(empty)
    assert done.table.count() == 0
    assert done.groups.count() == 0


def test_groups_hold_about_the_target(spark):
    rows = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 7 + 1).alias("n"), F.lit("x").alias("group_text"))
    plan = plan_groups(rows, ("k",), "n", target_bytes=100)
    sizes = [r.s for r in plan.groupBy("group_no").agg(F.sum("bytes").alias("s")).collect()]
    total = rows.agg(F.sum("n")).first()[0]
    assert sum(sizes) == total
    assert max(sizes) < 100 + 7
    assert len(sizes) == -(-total // 100)
    done = compact(rows, ("k",), "n", target_bytes=1000)
    assert sorted(r.k for r in done.table.select("k").collect()) == list(range(2000))
    names = done.table.select(F.input_file_name().alias("f")).distinct().count()
    assert names == done.groups.count()


def test_clashing_column_and_null_key(spark):
    rows = spark.createDataFrame([(1, 5, 9), (2, None, None)], "k int, n bigint, group_no int")
    done = compact(rows, ("k",), "n", target_bytes=3)
    assert sorted((r.k, r.group_no) for r in done.table.collect()) == [(1, 9), (2, None)]
    with pytest.raises(RuntimeError):
        compact(rows.withColumn("k", F.lit(None).cast("int")).limit(1), ("k",), "n")


def test_repeated_keys_are_refused(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "b")], "k int, n bigint, t string")
    with pytest.raises(RuntimeError):
        compact(rows, ("k",), "n", target_bytes=3)


@pytest.mark.parametrize("sent_starts", [10**6, 0])
def test_newest_is_kept(spark, sent_starts):
    early, late = datetime(2024, 1, 1), datetime(2024, 2, 1)
    rows = spark.createDataFrame(
        [("b", "p", 2, None, "zz", "x"), ("b", "p", 2, None, "aa", "x"), ("b", "p", 9, None, "a", "y"), ("c", "p", 1, early, "old", "x"), ("c", "p", 1, late, "new", "x"), ("c", "p", 1, late, "new", "x"), ("c", "q", None, None, None, None)],
        "bug_id string, patch_id string, n_bytes bigint, modified_at timestamp, document string, rank string",
    )
    done = compact(rows, target_bytes=3, newest=("modified_at", "n_bytes", "document"), sent_starts=sent_starts)
    assert sorted((r.bug_id, r.patch_id, r.document) for r in done.table.collect()) == [("b", "p", "a"), ("c", "p", "new"), ("c", "q", None)]
    assert done.table.columns == rows.columns
    assert done.groups.agg(F.sum("bytes")).first()[0] == 10


def test_contents_are_shuffled_once(spark, tmp_path, monkeypatch):
    """The plan that writes has one exchange of contents, however often a key is repeated."""
    plans = []
    from pyspark.sql import DataFrameWriter

    real = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, **k: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), real(self, path, **k))[1])
    rows = spark.range(50).select((F.col("id") % 40).alias("k"), F.col("id").alias("n"), F.lit("text").alias("content"))
    compact(rows, ("k",), "n", target_bytes=100, path=str(tmp_path / "out"), newest=("n",))
    exchanges = [line for line in plans[-1].splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    contents = [line for line in exchanges if "REPARTITION" in line.upper()]
    assert len(contents) == 1
    assert "REPARTITION" in exchanges[0].upper()  # none above it
    table = spark.read.parquet(str(tmp_path / "out"))
    assert table.count() == 40 and table.select(F.max("n")).first()[0] == 49


def test_long_documents(spark):
    long = doc(A, text="x" * 2_000_000)
    files = spark.createDataFrame([(f"x/bug-1/{A}.json", "bug-1", None, 1, None, long, 1)], SCHEMA)
    assert split_documents(files).first().n_bytes == len(long)
