from diffloom.plans import document_queries as dq

DIFF = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n-a\n+b\n+c\n"


def test_lex_lines_reads_files_of_every_purpose(spark, tmp_path):
    rows = [
        (1, "a.py", "Python", "programming", "# c\nx = 1\n"), (2, "t.py", "Python", "test", "y = 2"), (3, "d.json", "JSON", "data", "{\n}\n"), (4, "Makefile", None, "project", "all:\n"), (5, "n.py", "Python", None, "z = 3\n# d"),
        (6, "r.md", "Markdown", "documentation", "one\r\n\r\ntwo\nthree"), (7, "e.md", "Markdown", "documentation", ""), (8, "v.md", None, "documentation", None),
    ]
    spark.createDataFrame(rows, "file_id long, file_name string, language string, purpose string, content string").write.parquet(str(tmp_path / "source_files.parquet"))
    got = {(r.language, r.kind): r.n for r in dq.lex_lines(spark, str(tmp_path)).collect()}
    assert got == {("Python", "documentation"): 2, ("Python", "code"): 1, ("Python", "test"): 1, ("JSON", "data"): 2, (None, "project"): 1, ("Python", None): 1, ("Markdown", "documentation"): 4}


def test_diff_documents_of_any_source(spark, tmp_path):
    rows = [(1, "patches", DIFF), (2, None, DIFF), (3, "mailing_list", "See:\n" + DIFF), (4, "forum", "no diff\n--- a\n"), (5, "readme", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.patch_id: (r.n_files, r.n_hunks, r.n_added, r.n_removed) for r in dq.diff_documents(spark, str(tmp_path)).collect()}
    assert got == {k: (1, 1, 2, 1) for k in ("1", "2", "3")}
