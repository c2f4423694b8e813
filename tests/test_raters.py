import pytest

from diffloom.plans import rater_queries as rq

SCHEMA = "id string, file string, image string, line int, user string, annotation string, auto boolean, fcat string, ds string, bug string"


@pytest.fixture
def rated(spark, tmp_path):
    """Writes (line, user, annotation[, auto]) as df_inter_rater and gives the folder."""

    def write(rows):
        full = [("d_b", "f", "afterChange", line, user, label, *(auto or [False]), "code", "d", "b") for line, user, label, *auto in rows]
        spark.createDataFrame(full, SCHEMA).write.parquet(str(tmp_path / "df_inter_rater.parquet"))
        return str(tmp_path)

    return write


def test_wide_votes_has_every_rater(spark, rated):
    df = rq.wide_votes(spark, rated([(1, "E1", "test"), (1, "U1", "bugfix"), (2, "U12", "other"), (3, None, "cosmetic"), (4, "U2", "test", True)]))
    assert df.columns == ["id", "file", "image", "line", "null", "E1", "U1", "U12"]
    assert {tuple(r)[3:] for r in df.collect()} == {(1, None, "test", "bugfix", None), (2, None, None, None, "other"), (3, "cosmetic", None, None, None)}


def test_other_spellings_count(spark, rated):
    folder = rated([(1, "E1", "Bug-Fix"), (1, "E2", "bug fix"), (1, "E3", "docs"), (2, "E1", "cosmetic."), (2, "E2", "tests"), (2, "E3", "refactor"), (2, "U1", "refactoring"), (3, "E1", "zzz"), (4, "E1", " "), (4, "E2", None), (1, "E1", "bug fix", True)])
    got = {r.line: (r.label, r.votes, r.n_reviewers) for r in rq.consensus_vote(spark, folder).collect()}
    assert got == {1: ("bugfix", 2, 3), 2: ("refactoring", 2, 4), 3: ("other", 1, 1)}
    assert {r.user: (r.n, r.n_same) for r in rq.user_against_auto(spark, folder).collect()} == {"E1": (1, 1), "E2": (1, 1), "E3": (1, 0)}


def test_fleiss_kappa_for_each_number_of_raters(spark, rated):
    two = [(1, "a", "test"), (1, "b", "test"), (2, "a", "test"), (2, "b", "other")]
    three = [(3, "a", "bugfix"), (3, "b", "bugfix"), (3, "c", "test"), (4, "a", "test"), (4, "b", "test"), (4, "c", "test")]
    got = {r.raters: (r.n_items, r.observed, r.expected, r.kappa) for r in rq.fleiss_kappa(spark, rated([*two, *three, (5, "a", "test")])).collect()}
    assert got[2] == pytest.approx((2, 0.5, (3 / 4) ** 2 + (1 / 4) ** 2, (0.5 - 0.625) / 0.375), abs=1e-6)
    assert got[3] == pytest.approx((2, 2 / 3, (2 / 6) ** 2 + (4 / 6) ** 2, (2 / 3 - 5 / 9) / (4 / 9)), abs=1e-6)
    assert set(got) == {2, 3}
