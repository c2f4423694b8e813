"""Queries of the problems about labels and training text, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.llm import consensus as c3
from diffloom.llm import handwritten as c4
from diffloom.llm import leakage as c6
from diffloom.llm import mixing as c7
from diffloom.llm import names as c2
from diffloom.llm import prose_model as c8
from diffloom.session import table


#: The rank file of a byte-level BPE.
TOKENIZER = os.environ.get("DIFFLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of rows whose author means the same person or organisation."""
    return c2.linked_pairs(table(spark, sf_dir, "author_stats"))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, spellings and commits of each entity."""
    rows = c2.entity_rows(table(spark, sf_dir, "author_stats")).filter("entity IS NOT NULL")
    return rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("author").alias("n_spellings"), F.sum("count").alias("commits"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most probable label of each item that a rater labelled."""
    return c3.consensus(table(spark, sf_dir, "df_inter_rater")).items.select("id", "file", "image", "line", "annotation")


def p3_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes and reliability of each user."""
    return c3.consensus(table(spark, sf_dir, "df_inter_rater")).annotators


def p3_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Krippendorff's alpha over all raters' labels."""
    return c3.krippendorff(table(spark, sf_dir, "df_inter_rater")).select(*[F.round(c, 6).alias(c) for c in ("alpha", "observed", "expected")])


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c4.label_files(table(spark, sf_dir, "source_files").filter("purpose = 'programming'"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The programming files that nobody wrote by hand for the project."""
    return _labels(spark, sf_dir).filter("label <> 'handwritten'").select("file_id").distinct()


def p4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programming files by label."""
    return _labels(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and item where the document holds the item's passage or a good part of it."""
    return c6.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that leaked, with the number of documents that hold each."""
    return c6.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def _mixture(spark: SparkSession, sf_dir: str) -> c7.Mixture:
    return c7.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), TOKENIZER)


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected copies with their slots."""
    return _mixture(spark, sf_dir).selection


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that each source reached."""
    return _mixture(spark, sf_dir).shares


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are keyword-stuffed or link-list pages."""
    return c8.score_pages(table(spark, sf_dir, "documents")).filter("spam").select("doc_id").distinct()


QUERIES = {"p2_found": p2_found, "p2_entities": p2_entities, "p3_found": p3_found, "p3_raters": p3_raters, "p3_agreement": p3_agreement, "p4_found": p4_found, "p4_labels": p4_labels, "p6_found": p6_found, "p6_items": p6_items, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found}

_LABELS = ", ".join(f"'{x}'" for x in c3.LABELS)
_ALIASES = " ".join(f"WHEN word = '{a}' THEN '{b}'" for a, b in c3.ALIASES.items())
_NEAR = " ".join(f"WHEN levenshtein(word, '{k}') <= {2 if len(k) > 7 else 1} THEN '{k}'" for k in c3.LABELS)
_VOTES = f"""
votes AS (
    SELECT DISTINCT id, file, image, line, coalesce(u, '') AS u,
           CASE WHEN word IN ({_LABELS}) THEN word {_ALIASES} {_NEAR} ELSE 'other' END AS label
    FROM (SELECT id, file, image, line, "user" AS u, regexp_replace(lower(annotation), '[^\\p{{L}}]+', '', 'g') AS word FROM df_inter_rater
          WHERE NOT coalesce(auto, false) AND trim(regexp_replace(annotation, '\\s+', ' ', 'g')) <> '')
)"""

SQL: dict[str, str] = {
    "p3_agreement": f"""
WITH {_VOTES}, cells AS (SELECT id, file, image, line, label, count(*)::DOUBLE AS c FROM votes GROUP BY ALL
), units AS (SELECT id, file, image, line, sum(c) AS m, sum(c * c) AS c2 FROM cells GROUP BY ALL HAVING sum(c) > 1
), labels AS (
    SELECT label, sum(c) AS c FROM cells JOIN units ON cells.id IS NOT DISTINCT FROM units.id AND cells.file IS NOT DISTINCT FROM units.file
        AND cells.image IS NOT DISTINCT FROM units.image AND cells.line IS NOT DISTINCT FROM units.line GROUP BY label
), s AS (SELECT (SELECT sum((m * m - c2) / (m - 1)) FROM units) AS d, sum(c) AS n, sum(c * c) AS s2 FROM labels)
SELECT round(1 - (d / n) / ((n * n - s2) / (n * (n - 1))), 6) AS alpha, round(d / n, 6) AS observed, round((n * n - s2) / (n * (n - 1)), 6) AS expected FROM s
""",
}
