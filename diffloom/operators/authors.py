"""Authors: rankings, usual names, core authors, value ranges and what their lines are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usual(rows: DataFrame, by: str, column: str) -> DataFrame:
    """(by, column): the value of ``column`` most frequent in each group; of equals the least. Nulls don't count."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(by, column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(by).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(column))


def authors_info(rows: DataFrame, sums: list[str], by: str = "author_email", name: str = "author_name") -> DataFrame:
    """Per address: the sum of each of ``sums`` and the usual name. Rows without address don't count."""
    kept = rows.filter(F.col(by).isNotNull())
    totals = kept.groupBy(by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
    return totals.join(usual(kept, by, name), by, "left")


def top(rows: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    """The ``n`` rows with the greatest ``column``; of equals the least ``tie``."""
    return rows.orderBy(F.desc(column), tie).limit(n)


def core_authors(counts: DataFrame, share: float, author: str = "author", n: str = "n") -> DataFrame:
    """The least number of authors, most commits first, who have more than ``share`` of all, with those tied with the last.

    The order is one total order over authors; sums run over equal counts first, so that no window holds more rows than
    there are different counts.
    """
    levels = counts.groupBy(F.col(n).alias("level")).agg(F.count(F.lit(1)).alias("k"))
    size = F.col("level") * F.col("k")
    w = Window.orderBy(F.desc("level"))  # over distinct counts
    sums = levels.select("level", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"), F.sum(size).over(Window.partitionBy(F.lit(1))).alias("total"))
    least = sums.filter(F.col("above") <= F.col("total") * share).agg(F.min("level")).first()[0]
    return counts.filter(F.col(n) >= F.lit(least))


#: Kinds of lines that are told apart; any other is ``other``.
KINDS = ("code", "documentation", "test", "data", "markup", "project")


def contribution_mix(kinds: DataFrame) -> DataFrame:
    """(kind, n, perc) of lines (kind, n): kinds that aren't known go to ``other``."""
    named = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("other")
    sums = kinds.groupBy(named.alias("kind")).agg(F.sum("n").alias("n"))
    return sums.withColumn("perc", F.try_divide(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy(F.lit(1)))))


def value_range(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row with ``<c>_min`` and ``<c>_max``; 0 and 1 for a column that isn't there."""
    parts = []
    for c in columns:
        known = c in rows.columns
        parts += [(F.min(c) if known else F.lit(0)).alias(f"{c}_min"), (F.max(c) if known else F.lit(1)).alias(f"{c}_max")]
    return rows.agg(*parts)
