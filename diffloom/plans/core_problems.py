"""Queries of the two general data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.operators.compaction import compact_annotation_files
from diffloom.operators.inlining import branch_ends, inline_annotations
from diffloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (bug_id, patch_id) of the documents in the consolidated files."""
    return compact_annotation_files(table(spark, sf_dir, "annotation_files")).table.select("bug_id", "patch_id")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and bytes of each consolidated file, with a target size that gives several."""
    return compact_annotation_files(table(spark, sf_dir, "annotation_files"), target_bytes=1 << 20).groups.select(
        F.col("group_no").cast("bigint").alias("group_no"), "n_rows", "bytes"
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ends of every branch of annotations.changes."""
    return branch_ends(inline_annotations(table(spark, sf_dir, "annotations")))


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p5_found": p5_found}

SQL = {
    "p1_found": r"""
WITH files AS (
    SELECT lower(split_part(file_path, '/', 2)) AS bug_id, lower(file_path) AS path, trim(content, E' \t\r\n') AS content
    FROM annotation_files WHERE content IS NOT NULL
), parts AS (
    SELECT bug_id, path, CASE WHEN json_valid(content) THEN [content] ELSE string_split(content, E'\n') END AS texts FROM files
), texts AS (
    SELECT bug_id, path, trim(unnest(texts), E' \t\r\n') AS text FROM parts
), valid AS (
    SELECT bug_id, path, CASE WHEN json_valid(text) THEN text::JSON END AS j FROM texts
), documents AS (
    SELECT bug_id, path, j FROM valid WHERE json_type(j) = 'OBJECT'
    UNION ALL
    SELECT bug_id, path, unnest(json_extract(j, '$[*]')) AS j FROM valid WHERE json_type(j) = 'ARRAY'
), keyed AS (
    SELECT bug_id, lower(coalesce(json_extract_string(j, '$.commit_metadata.id'),
               replace(regexp_extract(path, '([0-9a-f]{2}/?[0-9a-f]{38})[.][a-z0-9.]*$', 1), '/', ''))) AS patch_id
    FROM documents WHERE json_type(j) = 'OBJECT' AND len(json_keys(j)) > 0
)
SELECT DISTINCT bug_id, patch_id FROM keyed WHERE length(patch_id) = 40
""",
    "p5_found": """
WITH files AS (
    SELECT bug_id, patch_id, unnest(map_entries(changes)) AS e FROM annotations
), sides AS (
    SELECT bug_id, patch_id, e.key AS file_name, '+' AS side, e.value."+" AS lines FROM files
    UNION ALL
    SELECT bug_id, patch_id, e.key, '-', e.value."-" FROM files
), lines AS (
    SELECT bug_id, patch_id, file_name, side, unnest(lines) AS line FROM sides
), ends AS (
    SELECT bug_id, patch_id, e.key AS file_name, '' AS side, -1 AS line_id, -1 AS token_idx FROM files
    WHERE coalesce(len(e.value."+"), 0) + coalesce(len(e.value."-"), 0) = 0
    UNION ALL
    SELECT bug_id, patch_id, file_name, side, coalesce(line.id, -1), -1 FROM lines WHERE coalesce(len(line.tokens), 0) = 0
    UNION ALL
    SELECT bug_id, patch_id, file_name, side, coalesce(id, -1), coalesce(token.idx, -1)
    FROM (SELECT bug_id, patch_id, file_name, side, line.id AS id, unnest(line.tokens) AS token FROM lines)
)
SELECT DISTINCT * FROM ends
""",
}
