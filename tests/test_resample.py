from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from diffloom.functions.buckets import RULES, bucket
from diffloom.operators import authors as au
from diffloom.operators import chunks as ch
from diffloom.operators import resample as rs

EDGES = ["2024-01-01 00:00:00", "2024-01-14 23:59:59", "2024-01-15 00:00:00", "2024-01-31 23:00:00", "2024-02-01 00:00:00", "2024-02-28 12:00:00", "2024-02-29 12:00:00", "2023-12-31 23:59:59", "2024-03-31 00:00:00", "2024-04-07 10:00:00", "2024-04-08 00:00:00"]


def rows(spark):
    at = [(datetime.fromisoformat(t), f"a{i % 3}", i, None if i == 4 else float(i)) for i, t in enumerate(EDGES)]
    return spark.createDataFrame(at, "author_date timestamp, who string, n int, x double")


@pytest.mark.parametrize("rule", RULES)
def test_buckets_are_those_of_calendar_libraries(spark, rule):
    got = rs.resample(rows(spark), rule, {"n": "sum"}).orderBy("bucket").collect()
    series = pd.Series(range(len(EDGES)), index=pd.to_datetime(EDGES)).sort_index().resample(rule).sum()
    assert [(str(r.bucket), r.n) for r in got] == [(str(t.date()), int(v)) for t, v in series.items()]


@pytest.mark.parametrize("how", list(rs.AGGREGATES))
def test_aggregates(spark, how):
    got = {str(r.bucket): r.x for r in rs.resample(rows(spark), "ME", {"x": how}).collect()}
    frame = pd.DataFrame({"x": [None if i == 4 else float(i) for i in range(len(EDGES))]}, index=pd.to_datetime(EDGES)).sort_index()
    want = getattr(frame.resample("ME").x, how)()
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx({str(t.date()): v for t, v in want.items() if not pd.isna(v)})


def test_groups_have_no_gaps_filled_until_densified(spark):
    grouped = rs.resample(rows(spark), "W", {"n": "sum"}, by="who")
    assert grouped.count() == grouped.select("who", "bucket").distinct().count()
    dense = rs.densify(grouped, "W", "who")
    for r in dense.groupBy("who").agg(F.min("bucket").alias("a"), F.max("bucket").alias("z"), F.count(F.lit(1)).alias("k")).collect():
        assert r.k == (r.z - r.a).days // 7 + 1
    assert dense.agg(F.sum("n")).first()[0] == sum(range(len(EDGES)))


def test_no_rows(spark):
    empty = rows(spark).limit(0)
    assert rs.resample(empty, "W", {"n": "sum"}).count() == 0
    assert rs.resample(empty, "ME", {"n": "sum"}, by="who").count() == 0
    assert rs.histogram(empty, "x", 1).count() == 0
    assert rs.bihistogram(empty, "n", "x", 1).count() == 0


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        bucket(F.lit(None).cast("timestamp"), "Y")


def test_since(spark):
    assert rs.since(rows(spark), "2024.02.01").count() == sum(t >= "2024-02-01" for t in EDGES)
    assert rs.since(rows(spark), "no date").count() == len(EDGES)


def test_percents(spark):
    df = spark.createDataFrame([(10, 0, 4), (0, 0, 0)], "p_count int, m_count int, p_code int")
    got = rs.percents(df, ["code", "test"]).collect()
    assert (got[0].p_code_perc, got[0].m_code_perc, got[0].code_perc, got[0].p_test_perc) == (0.4, None, 0.4, 0.0)
    assert got[1].p_code_perc is None


def test_histogram_closes_its_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 4.9, 5, 9, 10, 11, -1)], "x double")
    assert {r.bin: r.n for r in rs.histogram(df, "x", 5, 0, 10).collect()} == {0.0: 2, 5.0: 3}


def test_local_times(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 23, 30), "+0130"), (datetime(2024, 1, 1, 0, 10), "-0530"), (datetime(2024, 1, 1), "?")], "author_date timestamp, author_tz string")
    got = [(r.hour_utc, r.hour_local, r.weekday, r.day_name) for r in rs.local_times(df).collect()]
    assert got == [(23, 1, 1, "Tuesday"), (0, 18, 6, "Sunday"), (0, None, None, None)]


def test_rolling(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(5)], "g string, t int, x int")
    got = [r.rolling_mean for r in rs.rolling(df, "x", 3, ["t"], ["g"]).orderBy("t").collect()]
    assert got == [None, None, 1.0, 2.0, 3.0]


@pytest.mark.parametrize(("share", "want"), [(0.0, "a"), (0.3, "a"), (0.4, "abc"), (0.79, "abc"), (0.8, "abcd"), (1.0, "abcd")])
def test_core_authors(spark, share, want):
    counts = spark.createDataFrame([("a", 4), ("b", 2), ("c", 2), ("d", 2)], "author string, n int")
    got = sorted(r.author for r in au.core_authors(counts, share).collect())
    assert "".join(got) == {"abc": "abcd"}.get(want, want)  # b, c and d are tied


def test_core_authors_of_nobody(spark):
    assert au.core_authors(spark.createDataFrame([], "author string, n int"), 0.5).count() == 0


def test_usual_name_breaks_ties(spark):
    df = spark.createDataFrame([("m", "b"), ("m", "a"), ("m", None), ("k", "z")], "author_email string, author_name string")
    assert {r.author_email: r.author_name for r in au.usual(df, "author_email", "author_name").collect()} == {"m": "a", "k": "z"}


def test_stream_gives_the_batch_answer(spark, tmp_path):
    from diffloom.streaming import timeline_stream as ts

    start = datetime(2024, 1, 1)
    data = [(1 if i % 5 else 2, int((start + timedelta(hours=31 * i)).timestamp()), 10 if i % 7 else None, i) for i in range(60)]
    schema = "n_parents int, `author.timestamp` bigint, `committer.timestamp` bigint, `+:count` bigint"
    df = spark.createDataFrame(data, schema)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    for rule in ("W", "ME"):
        name = f"by_{rule.lower()}"
        query = ts.run_to_memory(ts.bucket_counts(ts.commit_stream(spark, str(tmp_path / "in"), schema), rule), name)
        query.processAllAvailable()
        query.stop()
        assert {tuple(r) for r in spark.table(name).collect()} == {tuple(r) for r in ts.bucket_counts(df, rule).collect()}
    weekly = {r.week: r.n_commits for r in ts.weekly_counts(df).collect()}
    assert weekly == {r.bucket: r.n_commits for r in ts.bucket_counts(df, "W").collect()}


def test_describe_by_sketches(spark):
    rows = spark.range(10_001).select(F.col("id").alias("a"))
    exact, near = (rs.describe(rows, ["a"], accuracy).first() for accuracy in (None, 1000))
    assert (exact.q25, exact.q50, exact.q75) == (2500, 5000, 7500)
    assert all(abs(near[q] - exact[q]) <= 20 for q in ("q25", "q50", "q75"))


def test_front_fill_over_a_wide_gap(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 9000, "b"), ("k", 9001, None), ("l", 5, "c")], "k string, n int, v string")
    got = {(r.k, r.n): r.v for r in ch.front_fill(rows, ["k"], "n", "v").collect()}
    assert len(got) == 9002 and got["k", 8999] == "a" and got["k", 9001] == "b" and got["l", 5] == "c"
