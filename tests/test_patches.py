import subprocess

import pytest
from pyspark.sql import functions as F

from diffloom.functions import scalars
from diffloom.operators import chunks as ch
from diffloom.operators import classify as cl
from diffloom.sources import annotation_json as aj
from diffloom.sources import diffs, sinks
from diffloom.sources.lexing import lex_lines, with_tokens

PATCH = """commit 1111111111111111111111111111111111111111
tree 2222222222222222222222222222222222222222
parent 3333333333333333333333333333333333333333
author A U Thor <author@mail.example> 1112354055 +0200
committer Joe <joe@mail.example> 1112354056 -0530
gpgsig -----BEGIN
 xyz
 -----END

    Fix it

    More

diff --git a/src/main.py b/src/main.py
index 1234567..89abcde 100644
--- a/src/main.py
+++ b/src/main.py
@@ -1,7 +1,8 @@ def x():
 keep
-old one
--- dashes
+new one
+++ pluses
+three
 middle
 last
-gone
 end
 tail
@@ -20,3 +21,3 @@
 a
-b
+c
 d
diff --git a/old.txt b/new.txt
similarity index 100%
rename from old.txt
rename to new.txt
diff --git a/run.sh b/run.sh
old mode 100644
new mode 100755
diff --git a/img.png b/img.png
new file mode 100644
index 0000000..1234567
Binary files /dev/null and b/img.png differ
diff --git "a/d\\303\\251j\\303\\240" "b/d\\303\\251j\\303\\240"
deleted file mode 100644
index 1234567..0000000
--- "a/d\\303\\251j\\303\\240"
+++ /dev/null
@@ -1 +0,0 @@
-x
\\ No newline at end of file
"""


def lines(spark, text=PATCH):
    return diffs.diff_lines(spark.createDataFrame([("p", text)], "patch_id string, text string"))


def test_parse_diff():
    files = diffs.parse_diff(PATCH)
    assert [(f["source"], f["target"]) for f in files] == [("src/main.py", "src/main.py"), ("old.txt", "new.txt"), ("run.sh", "run.sh"), ("/dev/null", "img.png"), ("déjà", "/dev/null")]
    assert [len(f["hunks"]) for f in files] == [2, 0, 0, 0, 1]
    body = files[0]["hunks"][0][4]
    assert [r[0] for r in body] == [" ", "-", "-", "+", "+", "+", " ", " ", "-", " ", " "]
    assert body[2][3] == "-- dashes" and body[4][3] == "++ pluses"
    assert files[1]["rename"] and files[3]["binary"]
    assert (files[2]["pre"], files[2]["post"]) == ("100644", "100755")
    assert files[4]["hunks"][0][4] == [("-", 1, None, "x"), ("\\", None, None, " No newline at end of file")]
    assert diffs.parse_diff(None) == diffs.parse_diff("") == diffs.parse_diff("no diff here") == []


def test_unquote():
    assert diffs.unquote('"a\\tb\\"c\\\\d\\303\\251"') == 'a\tb"c\\dé'
    assert diffs.unquote("plain") == "plain"
    with pytest.raises(ValueError):
        diffs.unquote('"\\q"')


def test_lines_and_metrics(spark):
    df = lines(spark)
    first = df.filter("file_idx = 0 AND hunk_idx IS NOT NULL")
    got = {r.hunk_idx: r for r in ch.hunk_metrics(first).collect()}
    assert (got[0].n_mod, got[0].n_rem, got[0].n_add, got[0].n_groups, got[0].spread_inner, got[0].patch_size, got[0].n_lines_all) == (2, 1, 1, 2, 2, 4, 11)
    assert (got[1].n_mod, got[1].n_groups, got[1].spread_inner) == (1, 1, 0)
    spread = ch.file_spreads(first).first()
    # last changed line of the first hunk is old line 6; the next hunk changes old line 21
    assert (spread.n_hunks, spread.hunk_span_src, spread.groups_spread) == (2, 21, 2 + 14)
    assert df.filter("file_idx = 1").first().hunk_idx is None
    added = first.filter("line_type = '+'")
    assert {(r["first"], r["last"]) for r in ch.extents(added, ["file_idx"], "target_line_no").collect()} == {(2, 4), (22, 22)}


def test_conservation(spark):
    """Removed lines are removed or modified, added ones added or modified."""
    for r in ch.hunk_metrics(lines(spark).filter("hunk_idx IS NOT NULL")).collect():
        assert r.n_lines_removed == r.n_rem + r.n_mod
        assert r.n_lines_added == r.n_add + r.n_mod


def test_numbers_agree_with_the_parser(spark):
    df = lines(spark).filter("hunk_idx IS NOT NULL AND line_type <> '\\\\'")
    again = ch.hunk_line_numbers(df.withColumnsRenamed({"source_line_no": "s0", "target_line_no": "t0"}))
    assert again.filter("NOT source_line_no <=> s0 OR NOT target_line_no <=> t0").count() == 0


def test_no_lines(spark):
    empty = lines(spark, "")
    assert empty.count() == 0
    assert ch.hunk_metrics(empty).count() == ch.file_spreads(empty).count() == 0


def test_parse_commit():
    c = diffs.parse_commit(PATCH)
    assert c["id"] == "1" * 40 and c["parents"] == ["3" * 40] and c["message"] == "Fix it\n\nMore"
    assert diffs.parse_commit("") is None
    assert diffs.parse_commit("From: x\n\nbody")["id"] is None


def test_parse_blame():
    a, b = "a" * 40, "b" * 40
    text = f"{a} 1 1 2\nauthor X\nfilename f\n\tone\n{a} 2 2\n\ttwo\n{b} 3 3 1\nprevious {a} f\nfilename f\n\tthree\n"
    got = diffs.parse_blame(text)
    assert [(g["commit"][0], g["final"], g["line"], g["previous"]) for g in got] == [("a", 1, "one", None), ("a", 2, "two", None), ("b", 3, "three", f"{a} f")]
    assert diffs.parse_name_status("A\tn\nD\to\nR100\to\tn\nM\tm") == [(None, "n"), ("o", None), ("o", "n"), ("m", "m")]


def test_read_and_write_diffs(spark, tmp_path):
    (tmp_path / "ds" / "bug-1" / "patches").mkdir(parents=True)
    (tmp_path / "ds" / "bug-1" / "patches" / ("f" * 40 + ".diff")).write_text(PATCH)
    (tmp_path / "ds" / "bug-1" / "patches" / "v1...v2.diff").write_text(PATCH)
    rows = diffs.read_diffs(spark, str(tmp_path / "ds")).collect()
    assert [(r.bug_id, r.patch_id) for r in rows] == [("bug-1", "1" * 40)]
    sinks.write_diffs(spark.createDataFrame([("ab" + "c" * 38, PATCH)], "patch_id string, text string"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "ab" / ("c" * 38 + ".diff")).read_text() == PATCH


@pytest.mark.parametrize(
    ("path", "language", "kind", "purpose"),
    [
        ("src/main.cpp", "C++", "programming", "programming"), ("INSTALL", "Text", "prose", "documentation"), ("README.md", "Markdown", "prose", "documentation"), ("docs/index.rst", "reStructuredText", "prose", "documentation"),
        ("tests/test_cli.py", "Python", "programming", "test"), ("requirements.txt", "Pip Requirements", "data", "project"), ("Makefile", "Makefile", "programming", "project"), ("pyproject.toml", "TOML", "data", "project"),
        (".github/workflows/ci.yml", "YAML", "data", "data"), (".unknownprojectrc", "unknown", "other", "other"), (".gitignore", "Ignore List", "data", "project"), ("/dev/null", "/dev/null", "other", "other"), ("scripts/kconfig/x.l", "Lex", "programming", "programming"), ("Kconfig.x", "unknown", "other", "other"),
    ],
)
def test_classify(spark, path, language, kind, purpose):
    r = cl.classify(spark.createDataFrame([(path,), (None,)], "file_name string")).filter("file_name IS NOT NULL").first()
    assert (r.path_language, r.path_type, r.path_purpose) == (language, kind, purpose)


def test_overrides(spark):
    rules = cl.Rules(extension_overrides={".py": "Lua"}, filename_overrides={"X": "C"}, purposes=(("lib/**/*.py", "library"),))
    got = {r.file_name: (r.path_language, r.path_purpose) for r in cl.classify(spark.createDataFrame([("a/lib/x/m.py",), ("X",)], "file_name string"), rules).collect()}
    assert got == {"a/lib/x/m.py": ("Lua", "library"), "X": ("C", "programming")}


def test_rules_as_texts(spark):
    rules = cl.Rules().updated(extensions=[".xyz:C", ".py:Lua"], filenames=["Makefile.lib:Makefile"], purposes=["Makefile.*:project", "*.xyz"], purpose_to_type=["test"])
    rows = cl.classify(spark.createDataFrame([("scripts/Makefile.lib",), ("a.xyz",), ("b.py",)], "file_name string"), rules).collect()
    assert {r.file_name: (r.path_language, r.path_purpose) for r in rows} == {"scripts/Makefile.lib": ("Makefile", "project"), "a.xyz": ("C", "*.xyz"), "b.py": ("Lua", "programming")}
    assert rules.purpose_to_type == {"documentation": "documentation", "test": "test"}
    assert cl.Rules().updated(purposes=["", "*.py:all"]).purposes == (("*.py", "all"),)
    assert cl.Rules().updated(extensions=[""]).extension_overrides == {}
    assert [cl.colon_pair(x) for x in ("a:b", "a", "a:b:c", ":b")] == [("a", "b"), ("a", "a"), ("a", "b"), ("", "b")]


def test_a_finder_in_place_of_the_tables(spark):
    df = spark.createDataFrame([("x.foo",), ("docs",), (None,), ("test.foo",)], "file_name string")
    got = {r.file_name: (r.path_language, r.path_type, r.path_purpose) for r in cl.classify(df, finder=lambda p: ("Foo", "prose")).collect()}
    assert got == {"x.foo": ("Foo", "prose", "documentation"), "docs": ("Foo", "prose", "documentation"), None: (None, None, None), "test.foo": ("Foo", "prose", "test")}


def test_load_catalogue(spark, tmp_path):
    (tmp_path / "l.yml").write_text("Foo:\n  type: programming\n  extensions: ['.l', '.foo']\n  filenames: [Foofile, 'a b']\nLex:\n  extensions: ['.l']\nRoff:\n  type: markup\n  primary_extension: ['.9']\n")
    rules = cl.Rules(catalogue=cl.load_catalogue(str(tmp_path / "l.yml")))
    paths = ["x.l", "kconfig/x.l", "y.foo", "Foofile", "m.9", "spark/m.9"]
    got = {r.file_name: (r.path_language, r.path_type) for r in cl.classify(spark.createDataFrame([(p,) for p in paths], "file_name string"), rules).collect()}
    assert got == {"x.l": ("Foo", "programming"), "kconfig/x.l": ("Lex", "other"), "y.foo": ("Foo", "programming"), "Foofile": ("Foo", "programming"), "m.9": ("Roff", "markup"), "spark/m.9": ("Text", "other")}


def test_line_types(spark):
    tok = lambda *xs: [(i, list(k), t) for i, (k, t) in enumerate(xs)]
    ws, name, note, doc = (("Text", "Whitespace"), " "), (("Name",), "x"), (("Comment", "Single"), "# x"), (("Literal", "String", "Doc"), "'x'")
    rows = [(1, "programming", tok(note, ws)), (2, "programming", tok(ws)), (3, "programming", tok(name, note)), (4, "documentation", tok(name)), (5, "test", tok(doc)), (6, "test", None), (7, None, tok(name))]
    df = spark.createDataFrame(rows, f"i int, purpose string, tokens {aj.TOKEN.join(['array<', '>'])}")
    got = {r.i: r.t for r in df.select("i", cl.line_type(F.col("purpose"), F.col("tokens")).alias("t")).collect()}
    assert got == {1: "documentation", 2: "code", 3: "code", 4: "documentation", 5: "documentation", 6: "test", 7: None}


def test_lexing(spark):
    got = lex_lines("x.py", '"""a\nb"""\nx = 1  # c\n')
    assert len(got) == 3
    assert "".join(t for line in got for _, _, t in line) == '"""a\nb"""\nx = 1  # c\n'
    assert [line[0][0] for line in got] == [0, 5, 10]
    df = spark.createDataFrame([(1, "x.py", "# c\n\ny = 2"), (2, None, None), (3, "odd.zzz", "")], "file_id bigint, file_name string, content string")
    kinds = {(r.file_id, r.line_no): r.k for r in with_tokens(df).select("file_id", "line_no", cl.line_type(F.lit("programming"), F.col("tokens")).alias("k")).collect()}
    assert kinds == {(1, 1): "documentation", (1, 2): "code", (1, 3): "code"}


def test_layouts_give_one_schema(spark, tmp_path):
    line = {"id": 1, "type": "code", "purpose": "programming", "tokens": [[0, ["Name"], "x"]]}
    files = {"a.py": {"language": "Python", "type": "programming", "purpose": "programming", "+": [line], "-": []}}
    import json

    docs = {"v2": {"commit_metadata": {"id": "x"}, "changes": files, "diff_metadata": {"n_files": 1}}, "v1.5": {"commit_metadata": {"id": "x"}, **files, "n_files": 1}, "v1": files}
    d = tmp_path / "ds" / "bug-1" / "annotation"
    d.mkdir(parents=True)
    for name, doc in docs.items():
        (d / f"{name}.json").write_text(json.dumps(doc))
    got = {r.format_version: r for r in aj.read_annotations(spark, str(tmp_path)).collect()}
    assert set(got) == set(docs)
    for r in got.values():
        assert r.bug_id == "bug-1" and r.dataset == "ds"
        assert r.changes["a.py"]["+"][0].tokens[0].text == "x"
    assert got["v1.5"].diff_metadata == got["v2"].diff_metadata == {"n_files": 1}


def test_reports(spark, tmp_path):
    (tmp_path / "x.timeline.json").write_text('{"x": [{"bug_id": "b", "+:count": 3}, {"bug_id": "c"}]}')
    (tmp_path / "x.lines-stats.json").write_text("{}")
    found = aj.find_reports(spark, str(tmp_path)).collect()
    assert [r.name for r in found] == ["x"]
    rows = aj.read_timeline(spark, found[0].file_path).collect()
    assert [(r.dataset, r.record.get("+:count")) for r in rows] == [("x", "3"), ("x", None)]
    assert spark.range(1).select(aj.companion(F.lit("d/x.timeline.json"))).first()[0] == "d/x.lines-stats.json"


def test_git_log(spark, tmp_path):
    from diffloom.sources.gitlog import GitLog

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    try:
        git("init", "-q")
    except FileNotFoundError:
        pytest.skip("no git")
    for i in range(3):
        (tmp_path / "f.txt").write_text("\n".join(map(str, range(i + 1))) + "\n")
        git("add", "f.txt")
        git("commit", "-q", "-m", f"change {i}")
    spark.dataSource.register(GitLog)
    rows = spark.read.format("gitlog").option("path", str(tmp_path)).option("commitsPerPartition", 2).load().collect()
    assert sorted(r.message for r in rows) == ["change 0", "change 1", "change 2"]
    assert all(r.diff.startswith("diff --git") for r in rows)
    assert sorted(len(r.parents) for r in rows) == [0, 1, 1]


def test_scalars(spark):
    df = spark.createDataFrame([("a/b/c.py",), ("x",), ("/dev/null",), ("",)], "p string")
    got = {r.p: (r.d, r.s, r.u) for r in df.select("p", scalars.depth(F.col("p")).alias("d"), scalars.shorten(F.col("p"), 2).alias("s"), scalars.parent(F.col("p")).alias("u")).collect()}
    assert got["a/b/c.py"] == (3, "a/b/**", "a/b") and got["x"] == (1, "x", ".") and got[""][0] == 0
    links = [tuple(x) for x in df.filter("p = 'a/b/c.py'").select(F.explode(scalars.ancestors(F.col("p"))).alias("e")).select("e.*").collect()]
    assert links == [(".", "a"), ("a", "a/b"), ("a/b", "a/b/c.py")]
    dev = [tuple(x) for x in df.filter("p = '/dev/null'").select(F.explode(scalars.ancestors(F.col("p"))).alias("e")).select("e.*").collect()]
    assert dev == [("/", "/dev"), ("/dev", "/dev/null")]
