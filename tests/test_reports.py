import pytest
from pyspark.sql import functions as F

from diffloom.operators import agreement as ag
from diffloom.operators import flow as fl
from diffloom.operators import gather as ga
from tests_data import documents


def test_purpose_counter(spark):
    got = {(r.kind, r.purpose): r.n for r in ga.purpose_counter(documents(spark)).collect()}
    assert got == {("files", "programming"): 2, ("files", "documentation"): 1, ("added", "programming"): 2, ("added", "documentation"): 1, ("removed", "programming"): 1}


def test_lines_stats_and_override(spark):
    stats = lambda rules: {(r.file_name, r.side, r.key): r.n for r in ga.lines_stats(documents(spark), rules).collect()}
    plain, override = stats({}), stats(None)
    assert plain["a.py", "+", "count"] == 2 and plain["a.py", "+/-", "type.code"] == 2
    assert ("a.py", "+/-", "count") not in plain
    assert plain["r.md", "+", "type.code"] == 1 and ("r.md", "+", "type.code") not in override
    assert override["r.md", "+", "type.documentation"] == 1


def test_timeline(spark):
    counts = {(r.patch_id, r.key): r.n for r in ga.timeline_counts(documents(spark)).collect()}
    assert counts["p", "file_names"] == 2 and counts["p", "+:count"] == 3 and counts["p", "diff.n_files"] == 2
    assert ("p", "diff.zero") not in counts
    wide = {r.patch_id: r for r in ga.timeline_wide(documents(spark), ["+:count", "-:type.code", "diff.n_files"]).collect()}
    assert (wide["p"].p_count, wide["p"].m_type_code, wide["p"].author_name, wide["p"].n_parents) == (3, 1, "A", 1)
    assert wide["empty"].p_count is None


def test_distinct_documents(spark):
    d = documents(spark)
    assert ga.distinct_documents(d.unionByName(d)).count() == d.count()


def edges(df):
    return {(r.src, r.dst): r.n for r in df.collect()}


def counts(spark):
    return spark.createDataFrame([("a/b/x.py", "type.code", 5), ("a/b/y.py", "type.test", 2), ("a/z.py", "type.code", 1), ("top.py", "type.code", 3), ("a/bc/w.py", "type.code", 1)], "file_name string, kind string, n int")


def test_directory_rollup(spark):
    e = edges(fl.directory_rollup(counts(spark)))
    assert e == {("a/b", "type.code"): 5, ("a/b", "type.test"): 2, ("a", "type.code"): 1, (".", "type.code"): 3, ("a/bc", "type.code"): 1, ("a", "a/b"): 7, ("a", "a/bc"): 1, (".", "a"): 9}


def unbalanced(e, root="."):
    """Inner nodes into which not as much flows as out."""
    into, out = {}, {}
    for (a, b), n in e.items():
        out[a] = out.get(a, 0) + n
        into[b] = into.get(b, 0) + n
    return {x for x in {*into, *out} - {root} if not x.startswith("type.") and into.get(x) != out.get(x)}


def deep_counts(spark, seed=1):
    import random

    rng = random.Random(seed)
    rows = {}
    for _ in range(150):
        path = "/".join(rng.choice("abc") for _ in range(rng.randrange(0, 5))) + f"/f{rng.randrange(9)}.py"
        rows[path.lstrip("/"), f"type.{rng.choice(['code', 'test'])}"] = rng.randrange(1, 40)
    return spark.createDataFrame([(*k, n) for k, n in rows.items()], "file_name string, kind string, n int")


def test_own_files_and_tail(spark):
    rolled = fl.directory_rollup(counts(spark))
    own = edges(fl.own_files(rolled))
    assert own["a", "__a__"] == 1 and own["__a__", "type.code"] == 1 and ("a", "type.code") not in own
    tail = edges(fl.reduce_tail(rolled))
    assert tail == {(".", "a"): 9, (".", "type.code"): 3, ("a", "type.code"): 7, ("a", "type.test"): 2}
    assert edges(fl.reduce_tail(fl.reduce_tail(rolled))) == tail  # no directory lies in another any more
    # with own nodes too: a's own node goes with its sub-directories
    assert edges(fl.reduce_tail(fl.own_files(rolled)))["a", "type.code"] == 7
    # a directory of the deepest level that doesn't end there keeps it
    kept = spark.createDataFrame([(".", "a", 3), ("a", "a/b", 3), ("a/b", "other", 3)], "src string, dst string, n int")
    assert edges(fl.reduce_tail(kept)) == edges(kept)


def test_thin_out(spark):
    own = fl.own_files(fl.directory_rollup(counts(spark)))
    thin = edges(fl.thin_out(own, 0.2))
    assert ("a", "a/bc") not in thin and not [k for k in thin if k[0] == "a/bc"]
    assert thin["a", "type.code"] == 1 and thin["a", "a/b"] == 7 and thin["a", "__a__"] == 1


@pytest.mark.parametrize("share", [0.01, 0.05, 0.2, 0.9])
def test_what_flows_in_flows_out(spark, share):
    c = deep_counts(spark)
    total = sum(r.n for r in c.collect())
    own = fl.own_files(fl.directory_rollup(c))
    for e in (own, fl.thin_out(own, share), fl.reduce_tail(own), fl.process(c, share), fl.process(c, share, most_files=10)):
        e = edges(e)
        assert not unbalanced(e)
    assert sum(r.n for r in fl.kind_totals(fl.process(c, share)).collect()) == total
    flow = edges(fl.process_patches(c, 2, 1000 * share))
    assert not unbalanced(flow)
    assert sum(n for (_, b), n in flow.items() if b.startswith("type.")) == total


def test_depth_and_width_limits(spark):
    split = fl.files_to_directories(fl.split_directories(counts(spark)))
    assert edges(split)["a/b", "a/b/*"] == 7 and edges(split)["./*", "type.code"] == 3
    shallow = edges(fl.limit_depth(split, 1))
    assert shallow == {(".", "a"): 9, (".", "./*"): 3, ("./*", "type.code"): 3, ("a", "a/*"): 1, ("a/*", "type.code"): 1, ("a", "a/**"): 8, ("a/**", "type.code"): 6, ("a/**", "type.test"): 2}
    wide = edges(fl.limit_width(split, 1))  # a/bc and a/* are thin, a/b isn't
    assert wide == {(".", "a"): 9, (".", "./*"): 3, ("./*", "type.code"): 3, ("a", "a/b"): 7, ("a/b", "a/b/*"): 7, ("a/b/*", "type.code"): 5, ("a/b/*", "type.test"): 2, ("a", "a/**"): 2, ("a/**", "type.code"): 2}


def test_labels_and_lines(spark):
    df = spark.createDataFrame([(".", "a,b", 1), ("a,b", "type.code", 2)], "src string, dst string, n int")
    assert {r.line for r in fl.mermaid(fl.labels(df, "r")).collect()} == {'{r},"a,b",1', '"a,b",[code],2'}


def test_no_edges(spark):
    empty = counts(spark).limit(0)
    assert fl.process(empty).count() == 0
    assert fl.process(empty, 0.1, most_files=3).count() == 0
    assert fl.process_patches(empty, 2, 1).count() == 0
    assert fl.reduce_tail(fl.directory_rollup(empty)).count() == 0


SCHEMA = "id string, file string, image string, line int, user string, label string"


def test_vote_pairs_and_kappa(spark):
    rows = [("i", "f", "x", n, u, lab) for n, labs in enumerate([("a", "a", "b"), ("b", "a", "c"), ("b", "b", "b")]) for u, lab in zip("pqr", labs)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.line: (r.label, r.votes, r.agreed) for r in ag.vote(df, ["c", "b", "a"]).collect()}
    assert got == {0: ("a", 2, True), 1: ("c", 1, False), 2: ("b", 3, True)}
    assert {(r.user_a, r.user_b): (r.n, r.n_same) for r in ag.rater_pairs(df).collect()} == {("p", "q"): (3, 2), ("p", "r"): (3, 1), ("q", "r"): (3, 1)}
    k = ag.fleiss_kappa(df, 3).first()
    observed = ((4 + 1 - 3) / 6 + 0 + 1) / 3
    expected = (3 / 9) ** 2 + (5 / 9) ** 2 + (1 / 9) ** 2
    assert k.kappa == pytest.approx((observed - expected) / (1 - expected))
    assert ag.fleiss_kappa(df, 5).first().kappa is None


def test_indicator_matches_nulls(spark):
    a = spark.createDataFrame([(1, None, "l"), (2, "x", "l")], "k int, m string, a string")
    b = spark.createDataFrame([(1, None, "r"), (3, "x", "r")], "k int, m string, b string")
    assert {(r.k, r._merge) for r in ag.with_indicator(a, b, ["k", "m"]).collect()} == {(1, "both"), (2, "left_only"), (3, "right_only")}


def test_chi_square(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30
    r = ag.chi_square(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    want = sum((o - e) ** 2 / e for o, e in ((10, 20), (20, 10), (30, 20), (0, 10)))
    assert r.statistic == pytest.approx(want)
    assert (r.dof, r.n) == (1, 60)


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) == len({n.lower() for n in entry.queries()})
    assert F is not None
