"""Shapes and orders of reports: sort keys, short names, nested votes, places beside lines, totals, and intervals by resampling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The order of columns of line types; other columns come after these and before ``type.other``.
TYPE_ORDER = ("type.code", "type.documentation", "type.test", "type.data", "type.markup")
OTHER_TYPES, LAST_TYPE = 10, 99


def type_rank(name: Column) -> Column:
    """The place of a column of line types in reports."""
    out = F.when(F.lit(False), 0)
    for i, kind in enumerate(TYPE_ORDER, 1):
        out = out.when(name.contains(kind), i)
    return out.when(name.contains("type.other"), LAST_TYPE).otherwise(OTHER_TYPES)


def by_type(columns: list[str]) -> list[str]:
    """Names of columns in the order of :func:`type_rank`, equal ones as they came."""
    rank = lambda c: next((i for i, kind in enumerate(TYPE_ORDER, 1) if kind in c), LAST_TYPE if "type.other" in c else OTHER_TYPES)
    return sorted(columns, key=rank)


def by_depth(path: Column) -> list[Column]:
    """Order of paths from the root down, and by name within a depth; ``.`` comes first."""
    return [F.when(path == ".", 0).otherwise(F.size(F.split(path, "/"))), path]


def renamed(column: Column, names: Mapping[str, str]) -> Column:
    """Values by their other names; those without one, and null, stay."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[column], column) if names else column


def flat_votes(nested: DataFrame, keys: list[str], votes: str = "votes") -> DataFrame:
    """(keys, user, label, line) of nested votes: a map of users to maps of labels to arrays of lines. Nulls at any level give no rows."""
    users = nested.select(*keys, F.explode(votes).alias("user", "_labels"))
    labels = users.select(*keys, "user", F.explode("_labels").alias("label", "_lines"))
    return labels.select(*keys, "user", "label", F.explode("_lines").alias("line"))


def nested_votes(flat: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, votes): the other way round, lines in order."""
    lines = flat.filter("user IS NOT NULL AND label IS NOT NULL").groupBy(*keys, "user", "label").agg(F.array_sort(F.collect_set("line")).alias("_lines"))
    labels = lines.groupBy(*keys, "user").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "_lines")))).alias("_labels"))
    return labels.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("user", "_labels"))).alias("votes"))


def wide_users(flat: DataFrame, keys: list[str], users: list[str] | None = None) -> DataFrame:
    """(keys, line, user_<name>, ...): a column for each user with the label given, of several the first by name."""
    wide = flat.groupBy(*keys, "line")
    wide = (wide.pivot("user", users) if users else wide.pivot("user")).agg(F.min("label"))
    return wide.select(*keys, "line", *[F.col(f"`{c}`").alias(f"user_{c}") for c in wide.columns[len(keys) + 1 :]])


def with_places(lines: DataFrame, file: list[str], hunk: str, index: str) -> DataFrame:
    """``lines`` with ``hunk_changed``, the greatest ``index`` of their hunk and one more, and ``file_changed``, the changed lines of their file."""
    w_hunk, w_file = Window.partitionBy(*file, hunk), Window.partitionBy(*file)
    return lines.withColumns({"hunk_changed": F.max(index).over(w_hunk) + 1, "file_changed": F.count(F.lit(1)).over(w_file)})


def with_total(rows: DataFrame, key: str, aggregates: list[Column], name: str = "(all)") -> DataFrame:
    """``aggregates`` by ``key``, and one row over all rows, named ``name``."""
    return rows.groupBy(key).agg(*aggregates).unionByName(rows.agg(*aggregates).withColumn(key, F.lit(name)))


def missing_from(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """The distinct rows of ``wanted`` that aren't in ``there``; nulls are values."""
    return wanted.subtract(there)


def median_interval(rows: DataFrame, column: str, replicates: int = 200, holds: float = 0.95, seed: int = 1) -> DataFrame:
    """(median, low, high) of a column by a Poisson bootstrap: each replicate counts a value as often as a Poisson variable says.

    Values are counted first, so a replicate costs as much as there are different values, and its weights follow from the seed, the
    value and the replicate alone: a lost executor changes nothing. Sums of many Poisson variables are taken as normal. Nulls don't
    count; no values give one row of nulls.
    """
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    uniform = lambda k: (F.pmod(F.xxhash64("v", "replicate", F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * F.pi() * uniform(1))
    # few: by the inverse of the distribution, term by term; many: normal
    n = F.col("n").cast("double")
    start = F.struct(F.exp(-n).alias("term"), F.exp(-n).alias("total"), F.lit(0).alias("k"))
    more = lambda x, i: F.struct((x["term"] * n / i).alias("term"), (x["total"] + x["term"] * n / i).alias("total"), (x["k"] + (uniform(0) > x["total"]).cast("int")).alias("k"))
    few = F.aggregate(F.sequence(F.lit(1), F.lit(39)), start, more, lambda x: x["k"])
    weight = F.when(F.col("n") <= 12, few).otherwise(F.greatest(F.round(F.col("n") + F.sqrt("n") * normal), F.lit(0))).cast("bigint")
    drawn = counts.select("v", "n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")).select("v", "replicate", weight.alias("w")).filter("w > 0")
    medians = drawn.groupBy("replicate").agg(F.percentile("v", F.lit(0.5), F.col("w")).alias("m"))
    ends = medians.agg(F.percentile("m", F.lit((1 - holds) / 2)).alias("low"), F.percentile("m", F.lit((1 + holds) / 2)).alias("high"))
    own = counts.agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("median"))
    return own.select(own["median"], ends.select("low").scalar().alias("low"), ends.select("high").scalar().alias("high"))
