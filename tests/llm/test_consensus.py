import math
import random

import pytest
from pyspark.sql import functions as F

from diffloom.llm import consensus as c

SCHEMA = "id string, file string, image string, line int, annotation string, user string, auto boolean, votes int"


def frame(spark, rows):
    return spark.createDataFrame([(i, "f", "afterChange", n, a, u, auto, 1) for i, n, a, u, auto in rows], SCHEMA)


def test_clean_label(spark):
    raw = ["Bug-Fix", " bugfix\n", "docs", "DOCUMENTATION", "tests", "cosmetic.", "refactor", "refactorng", "huh", "", "  ", None, "!!"]
    got = [r[1] for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string").select("i", c.clean_label(F.col("x"))).orderBy("i").collect()]
    assert got == ["bugfix", "bugfix", "documentation", "documentation", "test", "cosmetic", "refactoring", "refactoring", "other", None, None, None, "other"]


def test_digamma(spark):
    xs = [0.1, 0.5, 1.0, 3.7, 25.0, 1e4]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").selectExpr(c.digamma("x")).collect()]
    for x, g in zip(xs, got):
        h = 1e-5
        assert g == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), abs=1e-4)


def test_reliable_rater_beats_two_bad_ones(spark):
    rng = random.Random(1)
    rows, truth = [], {}
    for n in range(400):
        truth[n] = rng.choice(c.LABELS[:4])
        for u, right in (("good", 0.97), ("fair", 0.8), ("noise1", 0.2), ("noise2", 0.2)):
            label = truth[n] if rng.random() < right else rng.choice(c.LABELS[:4])
            rows.append(("i", n, label, u, False))
    done = c.consensus(frame(spark, rows))
    got = {r.line: r.annotation for r in done.items.collect()}
    assert sum(got[n] == truth[n] for n in truth) / 400 > 0.93
    r = {x.user: x for x in done.annotators.collect()}
    assert r["good"].reliability > r["fair"].reliability > r["noise1"].reliability
    assert all(x.low <= x.reliability <= x.high for x in r.values())
    assert sum(x.n_items for x in done.classes.collect()) == pytest.approx(400)


def test_matches_plain_updates(spark):
    """The same updates in plain Python."""
    rng = random.Random(3)
    votes = {n: {(u, rng.choice("012") if rng.random() < 0.4 else str(n % 3)) for u in "abc"} for n in range(60)}
    names = {str(i): x for i, x in enumerate(c.LABELS)}
    rows = [("i", n, names[k], u, False) for n, vs in votes.items() for u, k in vs]
    iterations = 6
    got = {r.line: r.annotation for r in c.consensus(frame(spark, rows), iterations=iterations).items.collect()}
    K = range(6)
    dg = lambda x: (math.lgamma(x + 1e-5) - math.lgamma(x - 1e-5)) / 2e-5
    q = {n: [(sum(int(k) == j for _, k in vs) + 0.05) for j in K] for n, vs in votes.items()}
    q = {n: [x / sum(v) for x in v] for n, v in q.items()}
    for _ in range(iterations):
        theta = {u: [[c.PRIOR_RIGHT if i == j else c.PRIOR_WRONG for j in K] for i in K] for u in "abc"}
        pi = [c.PRIOR_CLASS + sum(q[n][j] for n in q) for j in K]
        for n, vs in votes.items():
            for u, k in vs:
                for j in K:
                    theta[u][j][int(k)] += q[n][j]
        for n, vs in votes.items():
            s = [dg(pi[j]) - dg(sum(pi)) + sum(dg(theta[u][j][int(k)]) - dg(sum(theta[u][j])) for u, k in vs) for j in K]
            w = [math.exp(x - max(s)) for x in s]
            q[n] = [x / sum(w) for x in w]
    assert got == {n: c.LABELS[max(K, key=lambda j: q[n][j])] for n in q}


def test_what_is_no_vote(spark):
    rows = [("i", 1, "test", "a", True), ("i", 2, None, "a", False), ("i", 3, "  ", "a", False), ("i", 4, "odd", "a", False), ("i", 5, "test", "a", False), ("i", 5, "TEST", "a", False), ("i", 5, "test", None, None), (None, None, "docs", "b", False)]
    got = {(r.id, r.line): (r.annotation, r.n_votes) for r in c.consensus(frame(spark, rows)).items.collect()}
    assert got == {("i", 4): ("other", 1), ("i", 5): ("test", 2), (None, None): ("documentation", 1)}


def test_tie_goes_to_the_first_label(spark):
    rows = [("i", 1, "test", "a", False), ("i", 1, "bugfix", "b", False)]
    assert c.consensus(frame(spark, rows), iterations=1).items.first().annotation == "bugfix"


def test_no_rows(spark):
    done = c.consensus(frame(spark, []))
    assert done.items.count() == 0
    assert done.annotators.count() == 0
    assert c.krippendorff(frame(spark, [])).first().alpha is None


def test_krippendorff(spark):
    # all agree but one pair: a hand-counted alpha
    rows = [("i", n, a, u, False) for n, (x, y) in enumerate([("test", "test"), ("test", "test"), ("bugfix", "bugfix"), ("bugfix", "test")]) for u, a in (("a", x), ("b", y))]
    r = c.krippendorff(frame(spark, rows)).first()
    seen, expected = 2 / 8, (64 - 25 - 9) / (8 * 7)
    assert r.alpha == pytest.approx(1 - seen / expected)
    same = [("i", n, "test", u, False) for n in range(3) for u in "ab"]
    assert c.krippendorff(frame(spark, same)).first().alpha is None


def test_beta_quantiles():
    """Against sums over a fine grid."""
    import numpy as np

    a, b = np.array([2.3, 40.0, 1200.5, 0.9, 9.0]), np.array([1.5, 3.0, 60.0, 4.0, 9.0])
    for p in (0.025, 0.5, 0.975):
        for got, x, y in zip(c.beta_quantile(p, a, b), a, b):
            grid = (np.arange(400_000) + 0.5) / 400_000
            mass = np.exp((x - 1) * np.log(grid) + (y - 1) * np.log1p(-grid) - (math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y))) / 400_000
            assert mass[grid <= got].sum() == pytest.approx(p, abs=2e-3)


def test_salted_join_gives_the_same(spark):
    rng = random.Random(5)
    rows = [("i", n, rng.choice(c.LABELS), u, False) for n in range(50) for u in "abc"]
    df = frame(spark, rows)
    few, many = c.consensus(df, iterations=4), c.consensus(df, iterations=4, sent_pairs=0)
    key = lambda r: (r.line, r.annotation, round(r.certainty, 9))
    assert sorted(map(key, few.items.collect())) == sorted(map(key, many.items.collect()))


def test_rows_and_intervals(spark):
    """A rater who is sure of tests and guesses elsewhere has a high row for tests; intervals narrow with votes."""
    rng = random.Random(2)
    rows = []
    for n in range(600):
        right = c.LABELS[n % 3 + 1]
        for u, sure in (("a", 1.0), ("b", 1.0), ("c", 1.0 if right == "test" else 0.34)):
            rows.append(("i", n, right if rng.random() < sure else rng.choice(c.LABELS[1:4]), u, False))
        if n < 30:
            rows.append(("i", n, right, "rare", False))
    done = c.consensus(frame(spark, rows))
    assert done.converged
    assert done.updates < c.ITERATIONS
    row = {(r.user, r.label): r for r in done.rows.collect()}
    assert row["c", "test"].low > 0.9 > 0.7 > row["c", "documentation"].high
    r = {x.user: x for x in done.annotators.collect()}
    assert r["rare"].high - r["rare"].low > 2 * (r["a"].high - r["a"].low)
    assert all(0 <= x.low <= x.reliability <= x.high <= 1 for x in r.values())
