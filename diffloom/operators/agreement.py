"""Agreement of raters: pairs, joins that tell where a row comes from, votes, confusion, kappa and chi-square."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = ("id", "file", "image", "line")


def rater_pairs(labels: DataFrame, keys: tuple[str, ...] = ITEM, user: str = "user", label: str = "label") -> DataFrame:
    """(user_a, user_b, n, n_same) for every two raters, user_a < user_b, over the items that both labelled."""
    a = labels.select(*keys, F.col(user).alias("user_a"), F.col(label).alias("label_a"))
    b = labels.select(*keys, F.col(user).alias("user_b"), F.col(label).alias("label_b"))
    both = a.join(b, list(keys)).filter("user_a < user_b")
    return both.groupBy("user_a", "user_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label_a") == F.col("label_b")).alias("n_same"))


def with_indicator(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on ``keys``, in which nulls match, with ``_merge``: left_only, right_only or both."""
    a, b = left.withColumn("_l", F.lit(True)).alias("a"), right.withColumn("_r", F.lit(True)).alias("b")
    on = None
    for k in keys:
        same = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = same if on is None else on & same
    joined = a.join(b, on, "full")
    where = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    key = [F.when(F.col("_l").isNotNull(), F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys]
    rest = [F.col(f"a.{c}") for c in left.columns if c not in keys] + [F.col(f"b.{c}") for c in right.columns if c not in keys]
    return joined.select(*key, *rest, where.alias("_merge"))


def vote(labels: DataFrame, order: list[str], keys: tuple[str, ...] = ITEM, label: str = "label", least: int = 2) -> DataFrame:
    """(keys, label, votes, n_reviewers, agreed): the most frequent label; of equals the first in ``order``, then by name.

    ``agreed`` tells whether at least ``least`` raters gave it.
    """
    counts = labels.groupBy(*keys, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("votes"))
    rank = F.coalesce(*[F.when(F.col("label") == x, i) for i, x in enumerate(order)], F.lit(len(order)))
    best = counts.groupBy(*keys).agg(F.min_by(F.struct("label", "votes"), F.struct(-F.col("votes"), rank, F.col("label"))).alias("b"), F.sum("votes").alias("n_reviewers"))
    return best.select(*keys, "b.label", "b.votes", "n_reviewers", (F.col("b.votes") >= least).alias("agreed"))


def votes_against(consensus: DataFrame, auto: DataFrame, keys: tuple[str, ...] = ITEM) -> DataFrame:
    """(class, n): how many raters agreed, and whether with the tool: ``2U == A``, ``3U != A``, else ``other``."""
    both = consensus.join(auto.select(*keys, F.col("label").alias("auto_label")), list(keys))
    text = F.concat(F.col("votes").cast("string"), F.when(F.col("label") == F.col("auto_label"), "U == A").otherwise("U != A"))
    return both.groupBy(F.when(F.col("agreed"), text).otherwise("other").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, share): pairs of labels, and their share among those with the same ``a``."""
    counts = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def fleiss_kappa(labels: DataFrame, raters: int, keys: tuple[str, ...] = ITEM, label: str = "label") -> DataFrame:
    """One row: Fleiss' kappa over the items with exactly ``raters`` labels; null if there is none or only one label occurs."""
    return _fleiss(_rated(labels, keys, label).filter(F.col("n") == raters), [])


def fleiss_by_raters(labels: DataFrame, keys: tuple[str, ...] = ITEM, label: str = "label") -> DataFrame:
    """Fleiss' kappa for each number of labels an item has, as it needs a constant one; items with one label aren't pairable."""
    return _fleiss(_rated(labels, keys, label).filter("n > 1"), [F.col("n").cast("bigint").alias("raters")])


def _rated(labels: DataFrame, keys: tuple[str, ...], label: str) -> DataFrame:
    cells = labels.groupBy(*keys, F.col(label).alias("label")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    return cells.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("c2"), F.collect_list(F.struct("label", "c")).alias("cells"))


def _fleiss(items: DataFrame, by: list[Column]) -> DataFrame:
    agree = (F.col("c2") - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    long = items.select(F.explode("cells").alias("x"), agree.alias("p"), F.col("n").alias("n"))
    by_label = long.groupBy("n", "x.label").agg(F.sum("x.c").alias("c"), F.sum(F.col("p") * F.col("x.c") / F.col("n")).alias("p"))
    sums = by_label.groupBy(*by).agg(F.max("n").alias("n"), F.sum("c").alias("t"), F.sum(F.col("c") * F.col("c")).alias("c2"), F.sum("p").alias("p"))
    seen, chance = F.col("p") / (F.col("t") / F.col("n")), F.col("c2") / (F.col("t") * F.col("t"))
    own = [c for c in sums.columns if c not in ("n", "t", "c2", "p")]
    return sums.select(*own, (F.col("t") / F.col("n")).cast("bigint").alias("n_items"), seen.alias("observed"), chance.alias("expected"), F.try_divide(seen - chance, 1 - chance).alias("kappa"))


def chi_square(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the chi-square statistic of two columns' contingency table, its degrees of freedom and the number of rows."""
    cells = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("o"))
    cells = cells.withColumns({"ra": F.sum("o").over(Window.partitionBy("a")), "rb": F.sum("o").over(Window.partitionBy("b"))})
    # cells without rows count through the margins: sum(o^2 / e) - n
    sums = cells.agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("rb"))).alias("q"), F.sum("o").alias("n"), F.countDistinct("a").alias("da"), F.countDistinct("b").alias("db"))
    return sums.select((F.col("n") * F.col("q") - F.col("n")).alias("statistic"), ((F.col("da") - 1) * (F.col("db") - 1)).alias("dof"), F.col("n").cast("bigint").alias("n"))


def shares_by(rows: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    """Per group the percentage of each of ``values`` among its rows with one of them, as columns."""
    counts = rows.filter(F.col(column).isin(*values)).groupBy(*keys).pivot(column, values).agg(F.count(F.lit(1))).fillna(0, values)
    total: Column = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return counts.select(*keys, *[F.try_divide(F.col(v) * 100.0, total).alias(v) for v in values])


def count_of_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(size, n): how many groups have how many rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
