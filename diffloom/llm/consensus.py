"""Consensus from several annotators' labels: a mean-field variational confusion model.

Every annotator has a confusion matrix with a Dirichlet prior on each row, the classes have a Dirichlet prior, and
each item has one latent class. An update is two group-bys: votes are joined with the annotators' expected log
probabilities and summed by item (E step), and the items' posteriors are summed by annotator and label (M step).

Items with the same votes have the same posterior, so the updates run over distinct vote patterns with their counts. The
votes are stored once, partitioned and sorted by pattern. While the annotators' rates are few enough to be sent to every task,
an update shuffles nothing but its partial sums; beyond that they are joined on (user, label, salt), so that no annotator,
however many votes are theirs, is one task. Only the annotators' counts are stored between updates.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.functions.labels import ALIASES, LABELS, clean_label  # noqa: F401 - ALIASES is read from here
from diffloom.session import cut, cut_sorted, release

ITEM = ("id", "file", "image", "line")

#: Prior counts: of a right label, of each wrong one, and of each class.
PRIOR_RIGHT, PRIOR_WRONG, PRIOR_CLASS = 2.3, 0.3, 1.0
#: Updates at most; a model that still moves then says so in a warning and in Consensus.converged.
ITERATIONS = 100
#: The updates end when no expected log count of an annotator moves more than this in one of them.
TOLERANCE = 0.01
#: After so many updates each time, it is looked whether they may end.
CHECKED = 5
#: Pairs of annotator and label up to which the rates are sent to every task (about 100 bytes each); into so many parts
#: an annotator's votes are spread beyond.
SENT_PAIRS, SALTS = 100_000, 32
#: Probability that an interval of reliability holds.
HOLDS = 0.95
#: The name under which the class shares stand among the annotators; no annotator has it.
CLASSES = "(classes)\t"


def digamma(x: str) -> str:
    """SQL of the digamma function of a positive value: six steps up, then the asymptotic series."""
    steps = " + ".join(f"1 / (({x}) + {i})" for i in range(6))
    y = f"(({x}) + 6)"
    z = f"(1 / ({y} * {y}))"
    return f"(ln({y}) - 0.5D / {y} - {z} * (1D / 12 - {z} * (1D / 120 - {z} / 252)) - ({steps}))"


def votes_of(labels: DataFrame) -> DataFrame:
    """(item columns, user, label) of the labels that raters set (auto is false), each once.

    Null and blank labels are none. A null part of an item's key is a value like any other; a null user is one
    annotator. A rater who gave an item two labels has two votes.
    """
    kept = labels.filter(~F.coalesce("auto", F.lit(False))).select(*ITEM, F.coalesce("user", F.lit("")).alias("user"), clean_label(F.col("annotation")).alias("label"))
    return kept.filter(F.col("label").isNotNull()).distinct()


def patterns_of(votes: DataFrame) -> DataFrame:
    """(item columns, votes, h1, h2): each item once with its sorted votes, an array of (user, label), and 128 bits that stand for it."""
    items = votes.groupBy(*ITEM).agg(F.array_sort(F.collect_list(F.struct("user", "label"))).alias("votes"))
    return items.select("*", F.xxhash64("votes").alias("h1"), F.xxhash64(F.lit(1), "votes").alias("h2"))


@dataclass(frozen=True)
class Consensus:
    """items (item columns, annotation, certainty, n_votes), annotators, their rows and the class shares of a fitted model."""

    items: DataFrame
    annotators: DataFrame
    rows: DataFrame
    classes: DataFrame
    updates: int
    converged: bool


def _q(k: int) -> str:
    return f"q{k}"


def _each(text: str, joint: str = ", ") -> str:
    """``text`` for each class, with its number for # and its name for @."""
    return joint.join(text.replace("#", str(k)).replace("@", name) for k, name in enumerate(LABELS))


# One update in SQL, as a plan made of Column calls takes the driver longer to build than the executors to run. The digamma
# function stands in it once: all rates are values of one array.
_PRIOR = f"CASE WHEN user = '{CLASSES}' THEN {PRIOR_CLASS}D WHEN label = '@' THEN {PRIOR_RIGHT}D ELSE {PRIOR_WRONG}D END"
_ALL = f"CASE WHEN user = '{CLASSES}' THEN {_each('q#', ' + ')} + {PRIOR_CLASS * len(LABELS)}D ELSE t# + {PRIOR_RIGHT + PRIOR_WRONG * (len(LABELS) - 1)}D END"
_N = len(LABELS)
RATES = f"""
SELECT user, label, {_each(f"d[#] - d[# + {_N}] AS e#")} FROM (
    SELECT user, label, transform(array({_each("a#")}, {_each("b#")}), x -> {digamma("x")}) AS d FROM (
        SELECT user, label, {_each(f"q# + {_PRIOR} AS a#")}, {_each(f"{_ALL} AS b#")}
        FROM {{counts}} JOIN (SELECT user, {_each("sum(q#) AS t#")} FROM {{counts}} GROUP BY user) USING (user)))"""
#: Posteriors of every vote's pattern under the annotators' rates (E step).
POSTERIOR = f"""
WITH scores AS (SELECT h1, h2, user, label, n, {_each("sum(e#) OVER w AS s#")} FROM {{met}} WINDOW w AS (PARTITION BY h1, h2)),
weights AS (SELECT h1, h2, user, label, n, {_each("exp(s# - top) AS w#")} FROM (SELECT *, greatest({_each("s#")}) AS top FROM scores))
SELECT h1, h2, user, label, n, {_each("w# / total AS q#")} FROM (SELECT *, {_each("w#", " + ")} AS total FROM weights)"""
#: The same from each item's share of votes; the vote of the classes itself is none.
FIRST = f"""
WITH shares AS (SELECT h1, h2, user, label, n, {_each("sum(CASE WHEN label = '@' THEN 1D ELSE 0D END) OVER w + 0.05D AS w#")} FROM {{votes}} WINDOW w AS (PARTITION BY h1, h2))
SELECT h1, h2, user, label, n, {_each("w# / total AS q#")} FROM (SELECT *, {_each("w#", " + ")} AS total FROM shares)"""
#: Expected counts of every annotator's labels from these posteriors (M step).
COUNTS = f"SELECT user, label, {_each('sum(n * q#) AS q#')} FROM {{posterior}} GROUP BY user, label"
MOVED = f"""SELECT max(greatest({_each(f"abs(ln(x.q# + {PRIOR_WRONG}D) - ln(y.q# + {PRIOR_WRONG}D))")})) FROM {{a}} x JOIN {{b}} y ON x.user = y.user AND x.label = y.label"""


def _met(votes: DataFrame, counts: DataFrame, few: bool) -> DataFrame:
    """Votes with the expected log probabilities of their annotators."""
    rates = counts.sparkSession.sql(RATES, counts=counts)
    if few:
        return votes.join(F.broadcast(rates), ["user", "label"])
    salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return votes.withColumn("salt", F.pmod("h1", F.lit(SALTS)).cast("int")).join(salted, ["user", "label", "salt"]).drop("salt")


def consensus(labels: DataFrame, iterations: int = ITERATIONS, sent_pairs: int = SENT_PAIRS) -> Consensus:
    """Fit the model to all votes of ``labels`` (id, file, image, line, annotation, user, auto) and label each item.

    annotators has, per user, the number of votes, the posterior mean of being right, and an interval of it; see
    :func:`reliability`. Ties go to the label that comes first in :data:`LABELS`. ``sent_pairs`` changes the plan, never the
    rows. Empty input gives empty frames.
    """
    k_all = range(len(LABELS))
    spark = labels.sparkSession
    items = cut(patterns_of(votes_of(labels)))
    patterns = items.groupBy("h1", "h2").agg(F.count(F.lit(1)).cast("double").alias("n"), F.first("votes").alias("votes"))
    # the class shares act on an item like one more vote, of which the annotator is CLASSES
    with_classes = F.concat(F.col("votes"), F.array(F.struct(F.lit(CLASSES).alias("user"), F.lit("").alias("label"))))
    votes = patterns.select("h1", "h2", "n", F.explode(with_classes).alias("v")).select("h1", "h2", "n", "v.user", "v.label")
    votes = cut_sorted(cut(votes), "h1", "h2")
    counts = cut(spark.sql(COUNTS, posterior=spark.sql(FIRST, votes=votes)))
    few = counts.count() <= sent_pairs
    updates, converged = 1, False
    while updates < iterations and not converged:
        before, counts = counts, cut(spark.sql(COUNTS, posterior=spark.sql(POSTERIOR, met=_met(votes, counts, few))))
        if updates % CHECKED == 0:  # one number
            converged = (spark.sql(MOVED, a=counts, b=before).first()[0] or 0.0) < TOLERANCE
        release(before)
        updates += 1
    if not converged and updates >= ITERATIONS:
        warnings.warn(f"the annotators still moved after {updates} updates", stacklevel=2)
    q = spark.sql(POSTERIOR, met=_met(votes, counts, few)).filter(F.col("user") == CLASSES)

    best = F.greatest(*[F.col(_q(k)) for k in k_all])
    label = F.coalesce(*[F.when(F.col(_q(k)) == best, F.lit(name)) for k, name in enumerate(LABELS)])
    answers = q.select("h1", "h2", label.alias("annotation"), best.alias("certainty"))
    answered = items.join(answers, ["h1", "h2"]).select(*ITEM, "annotation", "certainty", F.size("votes").alias("n_votes"))
    shares = counts.filter(F.col("user") == CLASSES).select(F.explode(F.array(*[F.struct(F.lit(name).alias("label"), F.col(_q(k)).alias("n_items")) for k, name in enumerate(LABELS)])).alias("x")).select("x.*")
    return Consensus(answered, reliability(counts), confusion_rows(counts), shares, updates, converged)


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularized incomplete beta function by its continued fraction (Lentz)."""
    turned = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(turned, 1 - x, x), np.where(turned, b, a), np.where(turned, a, b)
    front = np.array([lgamma(p + q) - lgamma(p) - lgamma(q) for p, q in zip(a, b)])
    with np.errstate(divide="ignore"):
        front = np.exp(front + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(abs(d) < tiny, tiny, d)
    h = d
    for m in range(1, 400):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + t * d, 1 + t / c
            d, c = 1 / np.where(abs(d) < tiny, tiny, d), np.where(abs(c) < tiny, tiny, c)
            h = h * d * c
    return np.where(turned, 1 - front * h, front * h)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The value below which a Beta(a, b) variable lies with probability ``p``, by halving."""
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(50):
        middle = (low + high) / 2
        below = beta_cdf(middle, a, b) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def _with_interval(rows: DataFrame) -> DataFrame:
    """``rows`` with low and high of Beta(a, b) in place of a and b."""
    kept = [f for f in rows.schema.fields if f.name not in ("a", "b")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = pdf["a"].to_numpy(float), pdf["b"].to_numpy(float)
            yield pdf[[f.name for f in kept]].assign(low=beta_quantile((1 - HOLDS) / 2, a, b), high=beta_quantile((1 + HOLDS) / 2, a, b))

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", low double, high double")


def _diagonals(counts: DataFrame) -> DataFrame:
    """(user, k, label, a, all, share): the posterior of each row of each annotator: Beta(a, all - a) of being right for class k, and the share of class k."""
    every = counts.filter(F.col("user") != CLASSES).groupBy("user").agg(*[F.sum(F.when(F.col("label") == name, F.col(_q(k))).otherwise(0.0)).alias(f"r{k}") for k, name in enumerate(LABELS)], *[F.sum(_q(k)).alias(f"t{k}") for k in range(_N)])
    prior = PRIOR_RIGHT + PRIOR_WRONG * (_N - 1)
    rows = every.select("user", F.explode(F.array(*[F.struct(F.lit(name).alias("label"), (F.col(f"r{k}") + PRIOR_RIGHT).alias("a"), (F.col(f"t{k}") + prior).alias("all"), F.col(f"t{k}").alias("n")) for k, name in enumerate(LABELS)])).alias("x")).select("user", "x.*")
    classes = counts.filter(F.col("user") == CLASSES)
    total = sum((F.col(_q(k)) for k in range(_N)), F.lit(PRIOR_CLASS * _N))
    shares = classes.select(F.explode(F.array(*[F.struct(F.lit(name).alias("label"), ((F.col(_q(k)) + PRIOR_CLASS) / total).alias("share")) for k, name in enumerate(LABELS)])).alias("x")).select("x.*")
    return rows.join(F.broadcast(shares), "label")  # one row a label


def confusion_rows(counts: DataFrame) -> DataFrame:
    """(user, label, n, reliability, low, high): for each class, how often an annotator names it: the Dirichlet row's posterior.

    n is the expected number of votes on items of that class. low and high are exact quantiles of the posterior, which for one
    cell of a Dirichlet row is a Beta distribution.
    """
    rows = _diagonals(counts)
    return _with_interval(rows.select("user", "label", "n", (F.col("a") / F.col("all")).alias("reliability"), "a", (F.col("all") - F.col("a")).alias("b")))


def reliability(counts: DataFrame) -> DataFrame:
    """(user, n_votes, reliability, low, high): the posterior of giving the right label to an item of the table.

    It is the mean of the rows' posteriors, weighted with the class shares. Rows are independent in the model, so mean and
    variance are exact; low and high are quantiles of the Beta distribution with that mean and variance.
    """
    a, every, share = F.col("a"), F.col("all"), F.col("share")
    right = a / every
    moments = _diagonals(counts).groupBy("user").agg(F.sum("n").alias("n"), F.sum(share * right).alias("m"), F.sum(share * share * right * (1 - right) / (every + 1)).alias("v"))
    size = F.col("m") * (1 - F.col("m")) / F.col("v") - 1
    rows = moments.select("user", F.round("n").cast("bigint").alias("n_votes"), F.col("m").alias("reliability"), (F.col("m") * size).alias("a"), ((1 - F.col("m")) * size).alias("b"))
    return _with_interval(rows)


def krippendorff(labels: DataFrame) -> DataFrame:
    """One row: nominal Krippendorff alpha over all votes, with the observed and expected disagreement.

    Items with one vote aren't pairable and don't count. alpha is null if no item is pairable or only one label
    occurs.
    """
    cells = votes_of(labels).groupBy(*ITEM, "label").agg(F.count(F.lit(1)).cast("double").alias("c"))
    units = cells.groupBy(*ITEM).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("c2"), F.collect_list(F.struct("label", "c")).alias("cells"))
    units = units.filter("m > 1").withColumn("x", F.explode("cells"))
    share = (F.col("m") * F.col("m") - F.col("c2")) / (F.col("m") - 1) * F.col("x.c") / F.col("m")
    by_label = units.groupBy("x.label").agg(F.sum("x.c").alias("c"), F.sum(share).alias("d"))
    sums = by_label.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s2"), F.sum("d").alias("d"))
    expected = (F.col("n") * F.col("n") - F.col("s2")) / (F.col("n") * (F.col("n") - 1))
    seen = F.col("d") / F.col("n")
    return sums.select(F.when(expected > 0, 1 - seen / expected).alias("alpha"), seen.alias("observed"), F.when(F.col("n") > 1, expected).alias("expected"))
