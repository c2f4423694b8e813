"""Small annotation documents for tests."""

from diffloom.sources.annotation_json import CHANGES, META


def documents(spark):
    line = lambda i, kind, purpose: (i, 0, 0, i, kind, purpose, None)
    meta = ("p", ["q"], "t", ("A <a>", "A", "a", 1, "+0000"), ("C <c>", "C", "c", 2, "+0000"), "m")
    changes = {
        "a.py": ("Python", "programming", "programming", [line(1, "code", "programming"), line(2, "documentation", "programming")], [line(1, "code", "programming")]),
        "r.md": ("Markdown", "prose", "documentation", [line(1, "code", "documentation")], None),
    }
    rows = [("b", "p", meta, changes, {"n_files": 2, "zero": 0}), ("b", "q", None, {"c.py": ("Python", "programming", "programming", None, []), "gone": None}, None), ("b", "empty", None, None, None)]
    return spark.createDataFrame(rows, f"bug_id string, patch_id string, commit_metadata {META}, changes {CHANGES}, diff_metadata map<string,bigint>")
