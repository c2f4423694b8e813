"""Queries that shape and order reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.functions import scalars
from diffloom.functions.labels import clean_label
from diffloom.operators import flow as fl
from diffloom.operators import gather as ga
from diffloom.operators import shaping as sh
from diffloom.plans.document_queries import DOCS, HELD, KINDS, SPLIT, _documents, _kind_counts
from diffloom.plans.rater_queries import BASE
from diffloom.session import table

ITEM_KEYS = ["id", "file", "image"]


def adjusted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and shown name of every node of directories, with ``*`` for a directory's files."""
    edges = fl.files_to_directories(fl.split_directories(_kind_counts(spark, sf_dir)))
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.filter(~fl.kind_of_node(F.col("dst"))).select(F.col("dst").alias("node"))).distinct()
    return nodes.select("node", scalars.adjusted_depth(F.col("node")).alias("depth"), scalars.adjusted_name(F.col("node")).alias("shown"))


def columns_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of line types with their place in reports."""
    keys = ga.timeline_counts(_documents(spark, sf_dir)).filter(F.col("key").contains(":type.")).select("key").distinct()
    return keys.select("key", sh.type_rank(F.col("key")).alias("place"))


def shallow_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten paths that come first from the root down."""
    paths = table(spark, sf_dir, "source_files").filter("file_name <> ''").select("file_name").distinct()
    return paths.orderBy(*sh.by_depth(F.col("file_name"))).limit(10)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "df_inter_rater").filter(~F.coalesce("auto", F.lit(False)))
    return rows.withColumn("label", clean_label(F.col("annotation"))).filter("label IS NOT NULL AND user IS NOT NULL").select(*ITEM_KEYS, "line", "user", "label")


def votes_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes nested by user and label as raters' files hold them, and flat again."""
    return sh.flat_votes(sh.nested_votes(_labelled(spark, sf_dir), ITEM_KEYS), ITEM_KEYS)


def votes_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for each user, from nested votes."""
    return sh.wide_users(votes_flattened(spark, sf_dir), ITEM_KEYS)


def lines_with_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each changed line with its hunk's last changed place and its file's changed lines."""
    both = F.explode(F.array(F.struct(F.lit("+").alias("side"), F.col("plus").alias("lines")), F.struct(F.lit("-").alias("side"), F.col("minus").alias("lines"))))
    lines = ga.changed_files(_documents(spark, sf_dir)).select("bug_id", "patch_id", "file_name", both.alias("s")).select("bug_id", "patch_id", "file_name", "s.side", F.explode("s.lines").alias("l"))
    rows = lines.select("bug_id", "patch_id", "file_name", "side", F.col("l.id").alias("line_id"), F.col("l.hunk_idx").alias("hunk_idx"), F.col("l.in_hunk_chg_idx").alias("place"))
    return sh.with_places(rows, ["bug_id", "patch_id", "file_name"], "hunk_idx", "place")


def date_range_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last commit of each dataset and of all."""
    rows = table(spark, sf_dir, "timeline").filter("dataset IS NOT NULL").select("dataset", F.col("`author.timestamp`").alias("at"))
    return sh.with_total(rows, "dataset", [F.min("at").alias("first"), F.max("at").alias("last"), F.count_if(F.col("at").isNull()).alias("without")])


def bugs_without_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bugs of the timeline that no rater's row names, each once."""
    return sh.missing_from(table(spark, sf_dir, "timeline").select("bug_id"), table(spark, sf_dir, "df_inter_rater").select(F.col("bug").alias("bug_id")))


def recoded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by image and kind in raters' words: ``-`` is beforeChange, ``code`` is bug(fix)."""
    lines = ga.changed_lines(_documents(spark, sf_dir))
    image, kind = sh.renamed(F.col("side"), {"-": "beforeChange", "+": "afterChange"}), sh.renamed(F.col("line_type"), {"code": "bug(fix)"})
    return lines.groupBy(image.alias("image"), kind.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def author_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patches of the author who is named most often, of equal ones the first by name."""
    rows = table(spark, sf_dir, "timeline").select("dataset", "bug_id", "patch_id", F.col("`author.name`").alias("author")).filter("author IS NOT NULL").distinct()
    top = rows.groupBy("author").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "author").limit(1)
    return rows.join(F.broadcast(top.select("author")), "author", "left_semi")


def processed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that reports are made of, with their files."""
    return _documents(spark, sf_dir).select("bug_id", "patch_id", F.coalesce(F.greatest(F.size("changes"), F.lit(0)), F.lit(0)).alias("n_files"))


def mapped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of texts by source, counted by a function in Python."""
    return ga.mapped_counts(table(spark, sf_dir, "documents").select("source", "text"), lambda source, text: {f"{source or 'none'}": len(text or "")})


def median_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median number of files of a patch, with its interval."""
    return sh.median_interval(table(spark, sf_dir, "timeline"), "file_names")


QUERIES = {f.__name__: f for f in (
    adjusted_paths, columns_in_order, shallow_paths, votes_flattened, votes_by_user, lines_with_places, date_range_total, bugs_without_labels, recoded_lines, author_rows, processed_documents, mapped_counts, median_interval,
)}

_LINES = """ln AS (SELECT bug_id, patch_id, file_name, side, l.id AS line_id, l.hunk_idx AS hunk_idx, l.in_hunk_chg_idx AS place FROM (
    SELECT bug_id, patch_id, file_name, '+' AS side, unnest(plus) AS l FROM files UNION ALL SELECT bug_id, patch_id, file_name, '-', unnest(minus) FROM files))"""
_VOTES = f"{BASE}, v AS (SELECT DISTINCT id, file, image, line, u, label FROM labels WHERE u IS NOT NULL)"

SQL = {
    "adjusted_paths": f"""WITH {DOCS}, {KINDS}, {SPLIT}, {HELD}, nodes AS (SELECT src AS node FROM holders UNION SELECT dst FROM holders WHERE dst NOT LIKE 'type.%'),
        d AS (SELECT node, CASE WHEN node = '.' THEN 0 ELSE len(string_split(node, '/')) - (suffix(node, '/*'))::INT END AS depth, string_split(regexp_replace(node, '/[*]+$', ''), '/') AS stem FROM nodes)
        SELECT node, depth::INT AS depth, CASE WHEN len(stem) < 2 THEN node ELSE repeat('.', depth) || stem[-1] || CASE WHEN suffix(node, '/*') THEN '/*' ELSE '' END END AS shown FROM d""",
    "columns_in_order": f"""WITH {DOCS}, k AS (SELECT DISTINCT side || ':type.' || CASE WHEN file_purpose = 'documentation' THEN 'documentation' ELSE line_type END AS key FROM lines WHERE line_type IS NOT NULL OR file_purpose = 'documentation')
        SELECT key, (CASE WHEN contains(key, 'type.code') THEN 1 WHEN contains(key, 'type.documentation') THEN 2 WHEN contains(key, 'type.test') THEN 3 WHEN contains(key, 'type.data') THEN 4 WHEN contains(key, 'type.markup') THEN 5 WHEN contains(key, 'type.other') THEN 99 ELSE 10 END)::INT AS place FROM k""",
    "shallow_paths": "SELECT file_name FROM (SELECT DISTINCT file_name FROM source_files WHERE file_name <> '') ORDER BY CASE WHEN file_name = '.' THEN 0 ELSE len(string_split(file_name, '/')) END, file_name LIMIT 10",
    "votes_flattened": f'WITH {_VOTES} SELECT id, file, image, u AS "user", label, line FROM v WHERE line IS NOT NULL',
    "votes_by_user": f"WITH {_VOTES}, w AS (SELECT id, file, image, line, 'user_' || u AS u, label FROM v WHERE line IS NOT NULL) SELECT * FROM (PIVOT w ON u USING min(label) GROUP BY id, file, image, line)",
    "lines_with_places": f"WITH {DOCS}, {_LINES} SELECT *, max(place) OVER (PARTITION BY bug_id, patch_id, file_name, hunk_idx) + 1 AS hunk_changed, count(*) OVER (PARTITION BY bug_id, patch_id, file_name) AS file_changed FROM ln",
    "date_range_total": """SELECT coalesce(dataset, '(all)') AS dataset, min("author.timestamp") AS first, max("author.timestamp") AS last, count(*) FILTER ("author.timestamp" IS NULL) AS without FROM timeline WHERE dataset IS NOT NULL GROUP BY ROLLUP (dataset)""",
    "bugs_without_labels": "SELECT DISTINCT bug_id FROM timeline WHERE NOT EXISTS (SELECT 1 FROM df_inter_rater WHERE bug IS NOT DISTINCT FROM bug_id)",
    "recoded_lines": f"WITH {DOCS} SELECT CASE side WHEN '-' THEN 'beforeChange' ELSE 'afterChange' END AS image, CASE line_type WHEN 'code' THEN 'bug(fix)' ELSE line_type END AS label, count(*) AS n FROM lines GROUP BY 1, 2",
    "author_rows": """WITH r AS (SELECT DISTINCT dataset, bug_id, patch_id, "author.name" AS author FROM timeline WHERE "author.name" IS NOT NULL) SELECT author, dataset, bug_id, patch_id FROM r WHERE author = (SELECT author FROM r GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
    "processed_documents": f"WITH {DOCS} SELECT bug_id, patch_id, coalesce(cardinality(changes), 0)::INT AS n_files FROM docs",
    "mapped_counts": "SELECT coalesce(nullif(source, ''), 'none') AS key, sum(length(coalesce(text, '')))::BIGINT AS n FROM documents GROUP BY 1",
}
