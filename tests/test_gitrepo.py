import subprocess

import pytest
from pyspark.sql import functions as F

from diffloom.operators import annotate as an
from diffloom.sources import gitrepo as gr
from diffloom.sources.diffs import diff_lines
from diffloom.sources.gitlog import GitLog


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")

    def git(*a):
        return subprocess.run(["git", "-C", str(path), "-c", "user.name=A", "-c", "user.email=a@x", *a], check=True, capture_output=True, text=True).stdout.strip()

    try:
        git("init", "-q", "-b", "main")
    except FileNotFoundError:
        pytest.skip("no git")
    ids = []

    def commit(message, **files):
        for name, text in files.items():
            (path / name.replace("_", ".")).write_text(text)
        git("add", "-A")
        git("commit", "-q", "-m", message)
        ids.append(git("rev-parse", "HEAD"))

    commit("first", a_py="one = 1\ntwo = 2\nthree = 3\n", b_txt="text\n")
    commit("second", a_py='one = 1\n"""\nnote\n"""\nthree = 3\n')
    git("mv", "b.txt", "c.txt")
    commit("third", a_py='one = 1\n"""\nother\n"""\nthree = 3\n')
    git("tag", "v1")
    git("branch", "side", ids[1])
    return str(path), ids


def requests(spark, ids, prev=None):
    return spark.createDataFrame([(i, prev) for i in ids], "commit string, prev string")


def test_single_questions(repo):
    path, ids = repo
    r = gr.Repository(path)
    assert r.tags() == ["v1"] and r.oid("v1") == ids[2] and r.oid("nothing") is None
    assert r.is_commit(ids[0]) and not r.is_commit("HEAD:a.py") and r.branch() == "main"
    assert r.merged_into(ids[1], ["refs/heads"]) == ["refs/heads/main", "refs/heads/side"] and r.merged_into(ids[2], ["refs/heads/side"]) == [] and r.merged_into(ids[0]) == ["refs/heads/main"]
    assert r.config("core.bare", "bool") == "false" and r.config("no.such") is None
    meta = r.metadata(ids[1])
    assert (meta["id"], meta["parents"], meta["message"]) == (ids[1], [ids[0]], "second")
    with pytest.raises(RuntimeError):
        r.metadata("nothing")


def test_trees_and_changes(spark, repo):
    path, ids = repo
    assert {tuple(r) for r in gr.tree_files(requests(spark, ids[1:]), path).collect()} == {(ids[1], "a.py"), (ids[1], "b.txt"), (ids[2], "a.py"), (ids[2], "c.txt")}
    changed = {(r.commit, r.status, r.old, r.new) for r in gr.changed_files(requests(spark, ids), path).collect()}
    assert changed == {(ids[0], "A", None, "a.py"), (ids[0], "A", None, "b.txt"), (ids[1], "M", "a.py", "a.py"), (ids[2], "M", "a.py", "a.py"), (ids[2], "R", "b.txt", "c.txt")}


def test_single_diffs(spark, repo):
    path, ids = repo
    texts = {r.commit: r.text for r in gr.single_diffs(requests(spark, ids), path).collect()}
    assert "new file mode" in texts[ids[0]] and "rename from b.txt" in texts[ids[2]]
    assert "+note" not in texts[ids[2]] and "+other" in gr.single_diffs(requests(spark, [ids[2]], ids[0]), path).first().text


def test_images_and_validity(spark, repo):
    path, ids = repo
    wanted = spark.createDataFrame([(ids[0], "b.txt"), (ids[2], "b.txt"), (None, "x"), (ids[0], "a\nb"), (f"{ids[1]}^", "a.py")], "commit string, path string")
    assert [r.content for r in gr.images(wanted.coalesce(1), path).collect()] == ["text\n", None, None, None, "one = 1\ntwo = 2\nthree = 3\n"]
    objects = spark.createDataFrame([(ids[0], 1), ("0" * 40, 2), (None, 3), ("HEAD:a.py", 4)], "object string, n int")
    assert {r.n for r in gr.valid_objects(objects, path).collect()} == {1, 4}
    assert {r.n for r in gr.valid_objects(objects, path, "commit").collect()} == {1}


def test_survival(spark, repo):
    path, ids = repo
    rows = {(r.commit, r.path, r.line_no): r.survived for r in gr.changes_survival(requests(spark, ids[1:]), path).collect()}
    assert rows == {(ids[1], "a.py", 2): True, (ids[1], "a.py", 3): False, (ids[1], "a.py", 4): True, (ids[2], "a.py", 3): True}
    assert {r.commit: (r.survived, r.total) for r in gr.survival_shares(requests(spark, ids[1:]), path).collect()} == {ids[1]: (2, 3), ids[2]: (1, 1)}
    assert {tuple(r) for r in gr.added_extents(requests(spark, ids[1:]), path).collect()} == {(ids[1], "a.py", 2, 4), (ids[2], "a.py", 3, 3)}


def test_log_with_whole_images(spark, repo):
    """From the history to annotated lines: only the whole file shows that the changed line stands in a string."""
    path, ids = repo
    spark.dataSource.register(GitLog)
    log = spark.read.format("gitlog").option("path", path).option("commitsPerPartition", 2).option("copies", "all").load()
    assert {r.commit_id for r in log.collect()} == set(ids)
    patches = log.select(F.col("commit_id").alias("patch_id"), F.col("diff").alias("text")).filter(F.col("commit_id") == ids[2])
    kinds = lambda blobs: {(r.side, r.file_line_no): r.type for r in an.annotated_lines(patches, blobs).collect()}
    assert kinds(gr.blobs_of(diff_lines(patches), path)) == {("+", 3): "documentation", ("-", 3): "documentation"}
    with pytest.raises(Exception, match="git|bad"):
        spark.read.format("gitlog").option("path", path).option("revisions", "nothing").load().collect()


def test_commands(spark, repo, tmp_path, capsys):
    """From a history to patches, documents and a report, by the command line."""
    import json

    from diffloom.__main__ import main

    path, ids = repo
    assert main(["patches", path, str(tmp_path / "bug-1" / "patches")], spark) == 0
    assert main(["annotate", str(tmp_path / "bug-1" / "patches"), str(tmp_path / "a"), "--ext-to-language", ".py:Lua", "--line-callback", "bugfix"], spark) == 0
    assert main(["from-repo", path, str(tmp_path / "b"), "--use-repo", "--bug", "demo"], spark) == 0
    assert main(["lines-stats", str(tmp_path / "b"), str(tmp_path / "stats.json")], spark) == 0
    assert capsys.readouterr().out.split()[:3] == ["3", "3", "3"]
    document = json.loads(next((tmp_path / "a").rglob(f"{ids[0]}.v2.json")).read_text())
    assert document["changes"]["a.py"]["language"] == "Lua" and document["changes"]["a.py"]["+"][0]["type"] == "bug(fix)"
    assert json.loads((tmp_path / "b" / "demo" / "annotation" / f"{ids[2]}.v2.json").read_text())["changes"]["a.py"]["+"][0]["type"] == "documentation"
    rows = json.loads((tmp_path / "stats.json").read_text())
    assert {(r["file_name"], r["key"]): r["n"] for r in rows if r["patch_id"] == ids[2] and r["side"] == "+"}["a.py", "type.documentation"] == 1
