"""Sizes and spreads of patches: groups of changed lines, distances between hunks, extents and survival of lines.

Lines come as (patch columns, file_idx, hunk_idx, line_idx, line_type, source_line_no, target_line_no); a group is a maximal run
of ``-`` and ``+`` lines of a hunk. Everything is windows over a hunk or a file, then sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE = ("patch_id", "file_idx")
HUNK = (*FILE, "hunk_idx")
#: Numbers that are made at a time where gaps are filled.
PIECE = 4096


def changed() -> Column:
    return F.col("line_type").isin("-", "+")


def numbered_groups(lines: DataFrame, keys: tuple[str, ...] = HUNK, order: tuple[str, ...] = ("line_idx",)) -> DataFrame:
    """Lines with ``is_changed``, ``starts`` (a group starts here) and ``group_no``, counted from 1 within their hunk."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = lines.withColumn("is_changed", changed())
    out = out.withColumn("starts", F.col("is_changed") & ~F.coalesce(F.lag("is_changed").over(w), F.lit(False)))
    return out.withColumn("group_no", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def groups(lines: DataFrame, keys: tuple[str, ...] = HUNK, order: tuple[str, ...] = ("line_idx",)) -> DataFrame:
    """One row per group: its lines by sign, first and last places by side, first sign, and the context lines before it.

    ``context`` counts the lines between the group and the one before, null for the first.
    """
    n = numbered_groups(lines, keys, order)
    where = F.struct(*order)
    between = n.filter("NOT is_changed AND group_no > 0 AND line_type = ' '").groupBy(*keys, (F.col("group_no") + 1).alias("group_no")).agg(F.count(F.lit(1)).alias("context"))
    found = n.filter("is_changed").groupBy(*keys, "group_no").agg(
        F.sum((F.col("line_type") == "-").cast("int")).alias("k"), F.sum((F.col("line_type") == "+").cast("int")).alias("m"), F.min_by("line_type", where).alias("first_sign")
    )
    return found.join(between, [*keys, "group_no"], "left")


def hunk_metrics(lines: DataFrame, keys: tuple[str, ...] = HUNK, order: tuple[str, ...] = ("line_idx",)) -> DataFrame:
    """Per hunk with changes: n_mod, n_rem, n_add, patch_size, n_groups, spread_inner and the line counts.

    A group of k removed and m added lines has min(k, m) modified ones; spread_inner sums the context lines between groups.
    """
    g = groups(lines, keys, order)
    both = F.least("k", "m")
    sums = g.groupBy(*keys).agg(
        F.sum(both).alias("n_mod"), F.sum(F.col("k") - both).alias("n_rem"), F.sum(F.col("m") - both).alias("n_add"), F.count(F.lit(1)).alias("n_groups"),
        F.coalesce(F.sum(F.when(F.col("group_no") > 1, F.coalesce("context", F.lit(0)))), F.lit(0)).alias("spread_inner"), F.sum("m").alias("n_lines_added"), F.sum("k").alias("n_lines_removed"),
    )
    every = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines_all"))
    return sums.join(every, list(keys)).withColumn("patch_size", F.col("n_mod") + F.col("n_rem") + F.col("n_add"))


def hunk_ends(lines: DataFrame) -> DataFrame:
    """Per hunk: first and last line of each side, and the first and last changed line of each side with their signs."""
    at = lambda c, f: f(F.when(changed(), F.col(c)))
    by = lambda f: f(F.when(changed(), F.struct("line_idx", "line_type")))
    return lines.groupBy(*HUNK).agg(
        F.min("source_line_no").alias("src_start"), F.max("source_line_no").alias("src_end"), F.min("target_line_no").alias("dst_start"), F.max("target_line_no").alias("dst_end"),
        at("source_line_no", F.min).alias("src_first"), at("source_line_no", F.max).alias("src_last"), at("target_line_no", F.min).alias("dst_first"), at("target_line_no", F.max).alias("dst_last"),
        by(F.min)["line_type"].alias("type_first"),
    )


def file_spreads(lines: DataFrame) -> DataFrame:
    """Per file: n_hunks, hunk_span and hunk_spread by side, and groups_spread, the lines between groups within and across hunks.

    Between hunks the distance is measured on the side of the last group's first sign if the next hunk's first group has the
    same; else on that side up to the next hunk's start, and from there on the other side. A side a hunk doesn't have counts 0.
    """
    last = groups(lines).groupBy(*HUNK).agg(F.max_by("first_sign", "group_no").alias("type_last"), F.coalesce(F.sum("context"), F.lit(0)).alias("inner"))
    h = hunk_ends(lines).join(last, list(HUNK), "left")
    w = Window.partitionBy(*FILE).orderBy("hunk_idx")
    prev = lambda c: F.lag(c).over(w)
    side = lambda kind, c: F.when(kind == "-", F.col(f"src_{c}")).otherwise(F.col(f"dst_{c}"))
    before, kind = prev("type_last"), F.col("type_first")
    old_last = F.when(before == "-", prev("src_last")).otherwise(prev("dst_last"))
    same = side(kind, "first") - old_last - 1
    other = side(before, "start") - old_last - 1 + side(kind, "first") - side(kind, "start")
    h = h.withColumns({"across": F.when(before.isNotNull(), F.coalesce(F.when(before == kind, same).otherwise(other), F.lit(0))), "src_gap": F.col("src_start") - prev("src_end"), "dst_gap": F.col("dst_start") - prev("dst_end")})
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return h.groupBy(*FILE).agg(
        F.count(F.lit(1)).alias("n_hunks"), (F.max("src_end") - F.min("src_start")).alias("hunk_span_src"), (F.max("dst_end") - F.min("dst_start")).alias("hunk_span_dst"),
        zero("src_gap").alias("hunk_spread_src"), zero("dst_gap").alias("hunk_spread_dst"), (zero("inner") + zero("across")).alias("groups_spread"),
    )


def extents(numbers: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, first, last): the maximal runs of consecutive line numbers."""
    w = Window.partitionBy(*keys).orderBy(number)
    runs = numbers.select(*keys, number).distinct().withColumn("_run", F.col(number) - F.row_number().over(w))
    return runs.groupBy(*keys, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_run")


def survival(blame: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, survived, total): lines that no later commit changed (``previous`` is null), and all."""
    return blame.groupBy(*keys).agg(F.count_if(F.col("previous").isNull()).alias("survived"), F.count(F.lit(1)).alias("total"))


def hunk_line_numbers(lines: DataFrame, keys: tuple[str, ...] = HUNK, order: tuple[str, ...] = ("line_idx",)) -> DataFrame:
    """Lines with their numbers in both images, counted from their hunk's source_start and target_start."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda kinds: F.coalesce(F.sum(F.col("line_type").isin(*kinds).cast("int")).over(w), F.lit(0))
    return lines.withColumns(
        {
            "source_line_no": F.when(F.col("line_type").isin("-", " "), F.col("source_start") + seen(["-", " "])),
            "target_line_no": F.when(F.col("line_type").isin("+", " "), F.col("target_start") + seen(["+", " "])),
        }
    )


def front_fill(rows: DataFrame, keys: list[str], number: str, value: str) -> DataFrame:
    """Every number from the least to the greatest of each group, with the last value at or before it.

    Numbers are made in pieces, so that a stray one far away is no long array.
    """
    ends = rows.groupBy(*keys).agg(F.min(number).alias("a"), F.max(number).alias("z"))
    pieces = ends.select(*keys, "z", F.explode(F.sequence("a", "z", F.lit(PIECE))).alias("a"))
    every = pieces.select(*keys, F.explode(F.sequence("a", F.least(F.col("a") + (PIECE - 1), "z"))).alias(number)).join(rows.select(*keys, number, value), [*keys, number], "left")
    w = Window.partitionBy(*keys).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn(value, F.last(value, ignorenulls=True).over(w))


def line_coordinates(lines: DataFrame, keys: tuple[str, ...] = HUNK, order: tuple[str, ...] = ("line_idx",)) -> DataFrame:
    """Lines with ``line_id``, their place in the hunk from 1, and ``in_hunk_chg_idx``, the place among changed ones (null for others)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    count = F.sum(changed().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumns({"line_id": F.row_number().over(w), "in_hunk_chg_idx": F.when(changed(), count)})
