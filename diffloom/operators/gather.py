"""Reports gathered from annotation documents: purposes, line statistics, timelines and added lines.

All work on documents with commit_metadata, changes and diff_metadata; counts are kept long, (key, n) rows, until a
report asks for columns. A key without a count is absent, as 0 and absent mean the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line types that a file's purpose decides, whatever the lines hold.
PURPOSE_TO_TYPE = {"documentation": "documentation"}


def distinct_documents(annotations: DataFrame) -> DataFrame:
    """One document per (bug_id, patch_id): of several the one that says most, then the one whose digest is greatest.

    A document says more the longer its changes are as text, then its metrics and its metadata. Only documents of repeated keys
    are grouped, and compared by lengths and digests; where those keys are few, the others aren't shuffled at all. Documents
    without changes or metadata stay, with null in their place.
    """
    rest = ["commit_metadata", "changes", "diff_metadata"]
    repeated = annotations.groupBy(F.col("bug_id").alias("_bug"), F.col("patch_id").alias("_patch")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    marked = annotations.select("bug_id", "patch_id", *rest).join(repeated, F.col("bug_id").eqNullSafe(F.col("_bug")) & F.col("patch_id").eqNullSafe(F.col("_patch")), "left")
    once = marked.filter("_n IS NULL").select("bug_id", "patch_id", *rest)
    text = [F.coalesce(F.to_json(c), F.lit("")) for c in ("changes", "diff_metadata", "commit_metadata")]
    rank = F.struct(*[F.length(t) for t in text], F.sha2(F.concat_ws("\n", *text), 256))
    best = marked.filter("_n > 1").groupBy("bug_id", "patch_id").agg(F.max_by(F.struct(*rest), rank).alias("d"))
    return once.unionByName(best.select("bug_id", "patch_id", *[F.col(f"d.{c}").alias(c) for c in rest]))


def changed_files(documents: DataFrame) -> DataFrame:
    """(bug_id, patch_id, file_name, language, type, purpose, plus, minus): the changed files with their lines."""
    rows = documents.select("bug_id", "patch_id", F.explode("changes").alias("file_name", "f"))
    return rows.select("bug_id", "patch_id", "file_name", "f.language", "f.type", "f.purpose", F.col("f.`+`").alias("plus"), F.col("f.`-`").alias("minus"))


def changed_lines(documents: DataFrame) -> DataFrame:
    """One row per changed line: its file's columns, side, and the line's id, type and purpose."""
    sides = F.array(F.struct(F.lit("+").alias("side"), F.col("plus").alias("lines")), F.struct(F.lit("-").alias("side"), F.col("minus").alias("lines")))
    rows = changed_files(documents).select("bug_id", "patch_id", "file_name", F.col("purpose").alias("file_purpose"), F.explode(sides).alias("s"))
    rows = rows.select("bug_id", "patch_id", "file_name", "file_purpose", "s.side", F.explode("s.lines").alias("line"))
    return rows.select("bug_id", "patch_id", "file_name", "file_purpose", "side", F.col("line.id").alias("line_id"), F.col("line.type").alias("line_type"), F.col("line.purpose").alias("line_purpose"))


def by_purpose(rules: dict[str, str] | None = None) -> Column:
    """The type of a line, overridden where its file's purpose decides it."""
    kind, purpose, override = F.col("line_type"), F.col("file_purpose"), None
    for p, t in (PURPOSE_TO_TYPE if rules is None else rules).items():
        override = F.when(purpose == p, t) if override is None else override.when(purpose == p, t)
    return kind if override is None else F.coalesce(override, kind)


def purpose_counter(documents: DataFrame) -> DataFrame:
    """(kind, purpose, n): files, added and removed lines by purpose. Nulls aren't counted."""
    files = changed_files(documents).filter("purpose IS NOT NULL").groupBy("purpose").agg(F.count(F.lit(1)).alias("n")).select(F.lit("files").alias("kind"), "purpose", "n")
    lines = changed_lines(documents).filter("line_purpose IS NOT NULL").groupBy("side", F.col("line_purpose").alias("purpose")).agg(F.count(F.lit(1)).alias("n"))
    named = lines.select(F.when(F.col("side") == "+", "added").otherwise("removed").alias("kind"), "purpose", "n")
    return files.unionByName(named)


def purpose_per_file(documents: DataFrame) -> DataFrame:
    """(bug_id, patch_id, file_name, purpose) of every changed file."""
    return changed_files(documents).select("bug_id", "patch_id", "file_name", "purpose")


def lines_stats(documents: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(bug_id, patch_id, file_name, side, key, n): ``count``, ``type.X`` and ``purpose.X`` of ``+``, ``-`` and ``+/-``.

    ``+/-`` has no ``count``. Lines without type or purpose count only for ``count``.
    """
    lines = changed_lines(documents).withColumn("line_type", by_purpose(rules=rules))
    keys = F.array(F.lit("count"), F.concat(F.lit("type."), "line_type"), F.concat(F.lit("purpose."), "line_purpose"))
    # one side first, then both: the second sum is over counts
    one = lines.select("bug_id", "patch_id", "file_name", "side", F.explode(keys).alias("key")).filter("key IS NOT NULL")
    one = one.groupBy("bug_id", "patch_id", "file_name", "side", "key").agg(F.count(F.lit(1)).alias("n"))
    both = F.explode(F.array("side", F.when(F.col("key") != "count", "+/-")))
    rows = one.select("bug_id", "patch_id", "file_name", both.alias("side"), "key", "n").filter("side IS NOT NULL")
    return rows.groupBy("bug_id", "patch_id", "file_name", "side", "key").agg(F.sum("n").alias("n"))


def timeline_counts(documents: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(bug_id, patch_id, key, n): ``file_names``, ``language:X``, ``type:X``, ``purpose:X`` of files, ``±:count``,
    ``±:type.X``, ``±:purpose.X`` of lines, and ``diff.X`` of the document; only counts above 0."""
    files = changed_files(documents)
    keys = F.array(F.lit("file_names"), F.concat(F.lit("language:"), "language"), F.concat(F.lit("type:"), "type"), F.concat(F.lit("purpose:"), "purpose"))
    of_files = files.select("bug_id", "patch_id", F.explode(keys).alias("key"), F.lit(1).alias("n"))
    lines = changed_lines(documents).withColumn("line_type", by_purpose(rules=rules))
    keys = F.array(F.concat("side", F.lit(":count")), F.concat("side", F.lit(":type."), "line_type"), F.concat("side", F.lit(":purpose."), "line_purpose"))
    of_lines = lines.select("bug_id", "patch_id", F.explode(keys).alias("key"), F.lit(1).alias("n"))
    of_diff = documents.select("bug_id", "patch_id", F.explode("diff_metadata").alias("key", "n")).select("bug_id", "patch_id", F.concat(F.lit("diff."), "key").alias("key"), "n")
    rows = of_files.unionByName(of_lines).unionByName(of_diff.withColumn("n", F.col("n").cast("bigint")))
    return rows.filter("key IS NOT NULL").groupBy("bug_id", "patch_id", "key").agg(F.sum("n").alias("n")).filter("n > 0")


def commit_columns(documents: DataFrame) -> DataFrame:
    """Author's and committer's fields and n_parents of every document."""
    parts = ("timestamp", "tz_info", "name", "email")
    who = [F.col(f"commit_metadata.{w}.{p}").alias(f"{w}_{p}") for w in ("author", "committer") for p in parts]
    return documents.select("bug_id", "patch_id", *who, F.size("commit_metadata.parents").alias("n_parents"))


def timeline_wide(documents: DataFrame, keys: list[str] | None = None, rules: dict[str, str] | None = None) -> DataFrame:
    """One row per document with a column for each of ``keys`` (null where there is no count) and the commit's fields.

    Without ``keys`` there is one for each key that occurs, up to Spark's limit of pivot values. A column's name is its key with
    ``_`` for signs, ``p`` for + and ``m`` for -.
    """
    counts = timeline_counts(documents, rules)
    counts = (counts.filter(F.col("key").isin(*keys)) if keys else counts).groupBy("bug_id", "patch_id")
    wide = (counts.pivot("key", keys) if keys else counts.pivot("key")).agg(F.sum("n"))
    named = wide.select("bug_id", "patch_id", *[F.col(f"`{k}`").alias(column_name(k)) for k in keys or wide.columns[2:]])
    return commit_columns(documents).join(named, ["bug_id", "patch_id"], "left")


def column_name(key: str) -> str:
    key = key.replace("+:", "p_").replace("-:", "m_")
    return "".join(ch if ch.isalnum() else "_" for ch in key).strip("_")


def added_lines(documents: DataFrame) -> DataFrame:
    """The added lines with their place, type and purpose."""
    return changed_lines(documents).filter("side = '+'").drop("side", "file_purpose")


def mapped_counts(rows: DataFrame, mapper: Callable[..., dict[str, int]]) -> DataFrame:
    """(key, n): sums of the counts that ``mapper`` gives for each row, called with the row's values.

    Counts are summed in each batch before they leave it. Any report that adds up by keys can be made so; those above are faster.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts: Counter = Counter()
            for row in pdf.itertuples(index=False, name=None):
                counts.update(mapper(*[None if isinstance(v, float) and v != v else v for v in row]))
            yield pd.DataFrame(list(counts.items()), columns=["key", "n"])

    return rows.mapInPandas(run, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def totals_positive(documents: DataFrame) -> DataFrame:
    """(bug_id, key, n): the documents' metrics summed by bug; sums that aren't positive vanish."""
    rows = documents.select("bug_id", F.explode("diff_metadata").alias("key", "n"))
    return rows.groupBy("bug_id", "key").agg(F.sum("n").alias("n")).filter("n > 0")
