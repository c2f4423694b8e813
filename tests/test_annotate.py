import pytest
from pyspark.sql import functions as F

from diffloom.operators import annotate as an
from diffloom.operators import classify as cl
from diffloom.sources.diffs import diff_lines
from diffloom.sources.lexing import lex_lines

TEXT = '''commit 0123456789012345678901234567890123456789

diff --git a/src/a.py b/src/a.py
index 1111111..2222222 100644
--- a/src/a.py
+++ b/src/a.py
@@ -3,4 +3,5 @@ def f():
     x = 1
-    y = 2
+    # note
+    y = 3
+
     return x
@@ -20,2 +21,2 @@
-old()
+"""text"""
 z = 1
diff --git a/README.md b/docs.md
similarity index 90%
rename from README.md
rename to docs.md
index 1111111..2222222 100644
--- a/README.md
+++ b/docs.md
@@ -1,2 +1,2 @@
-one
+two
 end
diff --git a/new.c b/new.c
new file mode 100644
index 0000000..2222222
--- /dev/null
+++ b/new.c
@@ -0,0 +1,2 @@
+int a;
+/* b */
diff --git a/gone.txt b/gone.txt
deleted file mode 100644
index 2222222..0000000
--- a/gone.txt
+++ /dev/null
@@ -1 +0,0 @@
-bye
diff --git a/img.png b/img.png
index 1111111..2222222 100644
Binary files a/img.png and b/img.png differ
diff --git a/sub b/sub
index 1111111..2222222 160000
--- a/sub
+++ b/sub
@@ -1 +1 @@
-Subproject commit 1111111
+Subproject commit 2222222
'''


def patches(spark, *texts):
    return spark.createDataFrame([(f"p{i}", t, "x") for i, t in enumerate(texts)], "patch_id string, text string, file_name string")


def test_lines(spark):
    rows = {(r.file_name, r.side, r.hunk_idx, r.id): r for r in an.annotated_lines(patches(spark, TEXT)).collect()}
    assert {k: r.type for k, r in rows.items() if k[0] == "src/a.py"} == {
        ("src/a.py", "-", 0, 1): "code", ("src/a.py", "+", 0, 2): "documentation", ("src/a.py", "+", 0, 3): "code", ("src/a.py", "+", 0, 4): "code", ("src/a.py", "-", 1, 0): "code", ("src/a.py", "+", 1, 1): "documentation",
    }
    assert [rows["src/a.py", "+", 0, i].in_hunk_chg_idx for i in (2, 3, 4)] == [0, 1, 2]  # of its own side
    assert [rows["src/a.py", "+", 0, i].file_line_no for i in (2, 3, 4)] == [4, 5, 6]
    assert rows["src/a.py", "-", 1, 0].file_line_no == 20
    # documentation: both sides count, under each side's name; the line is one token
    assert rows["README.md", "-", 0, 0].in_hunk_chg_idx == 0 and rows["docs.md", "+", 0, 1].in_hunk_chg_idx == 1
    assert [(t.idx, t.type, t.text) for t in rows["docs.md", "+", 0, 1].tokens] == [(0, ["Text"], "two\n")]
    assert rows["new.c", "+", 0, 1].type == "documentation" and rows["gone.txt", "-", 0, 0].purpose == "documentation"
    assert not [k for k in rows if k[0] in ("sub", "img.png")]
    for r in rows.values():
        assert "".join(t.text for t in r.tokens).endswith("\n")


def test_whole_images_decide(spark):
    """A line inside a string over many lines is documentation only if the whole file is known."""
    text = "diff --git a/m.py b/m.py\n--- a/m.py\n+++ b/m.py\n@@ -2,1 +2,1 @@\n-old words\n+new words\n"
    blobs = spark.createDataFrame([("p0", "m.py", "+", '"""first\nnew words\nlast"""\n', 1)], "patch_id string, file_name string, side string, content string, type int")
    kinds = lambda b: {r.side: r.type for r in an.annotated_lines(patches(spark, text), b).collect()}
    assert kinds(None) == {"+": "code", "-": "code"}
    assert kinds(blobs) == {"+": "documentation", "-": "code"}
    far = blobs.withColumn("content", F.lit("one line only\n"))
    assert [r.tokens for r in an.annotated_lines(patches(spark, text), far).filter("side = '+'").collect()] == [[]]


def test_callback_goes_before_comments(spark):
    rows = an.annotated_lines(patches(spark, TEXT), callback=cl.CALLBACKS["bugfix"]).filter("file_name = 'src/a.py' AND hunk_idx = 0 AND side = '+'").orderBy("id").collect()
    assert [r.type for r in rows] == ["documentation", "bug(fix)", "code"]


def test_metrics(spark):
    m = {r.patch_id: r for r in an.patch_metrics(diff_lines(patches(spark, TEXT, None, "no diff"))).collect()}
    assert set(m) == {"p0"}
    want = {
        "n_files": 6, "n_binary_files": 1, "n_submodules": 1, "n_added_files": 1, "n_removed_files": 1, "n_file_renames": 1, "n_hunks": 5, "n_mod": 3, "n_rem": 1, "n_add": 4, "patch_size": 8, "n_lines_added": 7, "n_lines_removed": 4,
        "n_lines_all": 15, "n_groups": 5, "spread_inner": 0, "hunk_span_src": 19, "hunk_span_dst": 21, "hunk_spread_src": 15, "hunk_spread_dst": 14, "groups_spread": 15,
    }
    assert {k: m["p0"][k] for k in want} == want


def test_documents(spark):
    d = {r.patch_id: r for r in an.annotate(patches(spark, TEXT, None, "")).collect()}
    assert set(d) == {"p0"}
    changes = d["p0"].changes
    assert set(changes) == {"src/a.py", "README.md", "docs.md", "new.c", "gone.txt", "/dev/null", "img.png"}
    assert changes["src/a.py"].language == "Python" and changes["/dev/null"].language == "/dev/null"
    assert [x.id for x in changes["src/a.py"]["+"]] == [2, 3, 4, 1] and [x.hunk_idx for x in changes["src/a.py"]["+"]] == [0, 0, 0, 1]
    assert changes["img.png"]["+"] == [] and changes["new.c"]["-"] == []
    assert d["p0"].diff_metadata["n_submodules"] == 1 and "spread_inner" not in d["p0"].diff_metadata


def test_no_rows(spark):
    empty = patches(spark, TEXT).limit(0)
    assert an.annotate(empty).count() == an.annotated_lines(empty).count() == an.patch_metrics(diff_lines(empty)).count() == 0


@pytest.mark.parametrize("text", ["a = 1\rb = 2\nc = 3\n", "x = '\x0c'\n\x0c\ny z\n", "'''a\r\nb\r\n'''\r\nc"])
def test_only_line_feeds_end_lines(text):
    lines = lex_lines("m.py", text)
    assert ["".join(v for _, _, v in x) for x in lines] == [x for x in text.split("\n") for x in [x + "\n"]][: len(lines) - 1] + ["".join(v for _, _, v in lines[-1])]
    assert len(lines) == len([x for x in text.split("\n") if x]) + text.count("\n\n")
