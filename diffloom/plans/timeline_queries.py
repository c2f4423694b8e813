"""Queries over the timeline of commits, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.functions import scalars
from diffloom.functions.buckets import RULES, bucket
from diffloom.operators import authors as au
from diffloom.operators import resample as rs
from diffloom.session import table

VALUES = ("n_commits", "p_count", "m_count", "patch_size")


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.commits(table(spark, sf_dir, "timeline"))


def _text(df: DataFrame, *dates: str) -> DataFrame:
    return df.withColumns({d: F.col(d).cast("string") for d in dates})


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`") for f in df.schema.fields])


def resample_all(rule: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(rs.resample(_commits(spark, sf_dir), rule, dict.fromkeys(VALUES, "sum")), "bucket")


def resample_by_author(rule: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(rs.resample(_commits(spark, sf_dir), rule, dict.fromkeys(VALUES, "sum"), by="author_email"), "bucket")


def resample_month(how: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rs.resample(_commits(spark, sf_dir), "ME", {"n_commits": "sum", "p_count": how, "m_count": how})
    return _rounded(_text(out.withColumns({c: F.col(c).cast("double") for c in ("p_count", "m_count")}), "bucket"))


def author_weekly_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = rs.resample(_commits(spark, sf_dir), "W", {"n_commits": "sum", "p_count": "sum"}, by="author_email")
    return _text(rs.densify(grouped, "W", "author_email"), "bucket")


def percent_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"p_count": "sum", "m_count": "sum", "p_code": "sum", "p_documentation": "sum"}
    weekly = rs.resample(_commits(spark, sf_dir), "W", values)
    return _rounded(_text(rs.percents(weekly, ["code", "documentation"]), "bucket"))


def authors_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.authors_info(_commits(spark, sf_dir), ["n_commits", "p_count", "m_count", "file_names", "patch_size", "n_files"])


def authors_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = au.authors_info(_commits(spark, sf_dir), ["n_commits", "p_count"])
    return au.top(info, "n_commits", 10, "author_email")


def author_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commits(spark, sf_dir).filter("author_name IS NOT NULL").groupBy("author_name").agg(F.count(F.lit(1)).alias("n"))


def core_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _commits(spark, sf_dir).filter("author_email IS NOT NULL").groupBy(F.col("author_email").alias("author")).agg(F.count(F.lit(1)).alias("n"))
    return au.core_authors(counts, 0.5)


def core_authors_by_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "author_stats").filter("author IS NOT NULL AND `count` IS NOT NULL")
    return au.core_authors(stats.groupBy("author").agg(F.sum("count").alias("n")), 0.8)


def value_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return au.value_range(_commits(spark, sf_dir), ["p_count", "m_count", "patch_size", "not_there"])


def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rs.since(_commits(spark, sf_dir), "2024.01.01")
    return _text(rows.agg(F.min("author_date").alias("first"), F.max("author_date").alias("last"), F.max("committer_date").alias("last_committed")).select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first", "last", "last_committed")]))


def date_range_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rs.plain(table(spark, sf_dir, "timeline"))
    return rows.groupBy("dataset").agg(F.min("author_timestamp").alias("first"), F.max("author_timestamp").alias("last"), F.count_if(F.col("author_timestamp").isNull()).alias("without"))


def heatmap_hour_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.periodicity(_commits(spark, sf_dir))


def hist_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.periodicity(_commits(spark, sf_dir)).groupBy("hour_local").agg(F.sum("n_commits").alias("n_commits"))


def hist_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.periodicity(_commits(spark, sf_dir)).groupBy("weekday").agg(F.sum("n_commits").alias("n_commits"))


def local_time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rs.local_times(_commits(spark, sf_dir))
    local = F.date_format("author_date_local", "yyyy-MM-dd HH:mm:ss").alias("author_date_local")
    return rows.select("bug_id", "patch_id", "hour_utc", local, "hour_local", "weekday", "day_name")


def bihist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.bihistogram(_commits(spark, sf_dir), "p_count", "m_count", 10)


def hist_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.histogram(_commits(spark, sf_dir), "patch_size", 5, 0, 100)


def describe_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rs.describe(_commits(spark, sf_dir), ["p_count", "m_count", "patch_size", "n_hunks"]))


def describe_by_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rs.plain(table(spark, sf_dir, "timeline"))
    with_merges = rs.describe(t, ["p_count"]).withColumn("merges", F.lit("with"))
    return _rounded(with_merges.unionByName(rs.describe(t.filter("n_parents = 1"), ["p_count"]).withColumn("merges", F.lit("without"))))


def fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _commits(spark, sf_dir).groupBy(F.window("author_date", "17 minutes", startTime="5 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekly = rs.resample(_commits(spark, sf_dir), "W", {"n_commits": "sum"}, by="author_email")
    return _rounded(_text(rs.rolling(weekly, "n_commits", 3, ["bucket"], ["author_email"]), "bucket"))


def non_merge_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commits(spark, sf_dir).select("dataset", "bug_id", "patch_id", "author_timestamp", "committer_timestamp")


def from_date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.since(_commits(spark, sf_dir), "2024.06.01").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


def from_date_not_a_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.since(_commits(spark, sf_dir), "last week").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


def ratio_of_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _commits(spark, sf_dir)
    a = rs.resample(c.filter("dataset = 'crawl'"), "ME", {"n_commits": "sum"}).withColumnRenamed("n_commits", "a")
    b = rs.resample(c, "ME", {"n_commits": "sum"}).withColumnRenamed("n_commits", "b")
    return _rounded(_text(a.join(b, "bucket").select("bucket", rs.ratio(F.col("a"), F.col("b")).alias("share")), "bucket"))


def series_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = _commits(spark, sf_dir).groupBy(bucket(F.col("author_date"), "ME").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    ends = monthly.agg(F.min("bucket").alias("a"), F.add_months(F.max("bucket"), 3).alias("z"))
    every = ends.select(F.explode(F.sequence(F.trunc("a", "month"), F.trunc("z", "month"), F.expr("INTERVAL 1 MONTH"))).alias("m")).select(F.last_day("m").alias("bucket"))
    return _text(every.join(monthly, "bucket", "left").fillna(0, ["n"]), "bucket")


def names_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: the counts of each kind of file in the timeline, whatever columns there are."""
    t = table(spark, sf_dir, "timeline")
    keys = [c for c in t.columns if c.startswith(("language:", "type:", "purpose:"))]
    parts = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").alias("n")) for c in keys])
    return t.select(F.explode(parts).alias("e")).select("e.*").filter("n IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n"))


def gravatar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _commits(spark, sf_dir).filter("author_email IS NOT NULL").select("author_email").distinct()
    return rows.select("author_email", scalars.avatar_url(F.col("author_email")).alias("url"))


def time_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _commits(spark, sf_dir).agg(F.max("author_date").alias("d"))
    months = F.explode(F.array(*[F.lit(n) for n in (1, 3, 6, 12, 24)])).alias("months")
    ranges = last.select("d", months).select("months", F.date_format(F.add_months("d", -F.col("months")), "yyyy.MM.dd").alias("since"))
    return last.select(F.lit(None).cast("int").alias("months"), F.lit("").alias("since")).unionByName(ranges)  # all of it


def humanised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _commits(spark, sf_dir).groupBy("dataset").agg(F.sum("p_count").alias("n"), F.max("author_date").alias("d"))
    return rows.select("dataset", scalars.thousands(F.col("n")).alias("lines"), F.date_format("d", "d MMM yyyy").alias("last"), F.date_format("d", "yyyy-MM").alias("month"), F.format_string("%-14s: %6d lines", F.col("dataset"), F.col("n")).alias("label"))


def round_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _commits(spark, sf_dir).select("p_count").distinct()
    return rows.select("p_count", scalars.round_10s(F.col("p_count")).alias("up"), scalars.width_limit(F.col("p_count")).alias("width"))


def latest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest commit of each dataset not after a given time."""
    rows = _commits(spark, sf_dir).filter("author_timestamp <= 1718000000")
    return rows.groupBy("dataset").agg(F.max_by("patch_id", F.struct("author_timestamp", "patch_id")).alias("patch_id"), F.max("author_timestamp").alias("author_timestamp"))


def root_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rs.plain(table(spark, sf_dir, "timeline"))
    return rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_parents") == 0).alias("roots"), F.count_if(F.col("n_parents") > 1).alias("merges"), F.min("author_timestamp").alias("oldest"))


def gathered_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches once: the row gathered first."""
    t = rs.plain(table(spark, sf_dir, "timeline"))
    kept = t.groupBy("bug_id", "patch_id").agg(F.count(F.lit(1)).alias("n"), F.min("gathered_at").alias("gathered_at"))
    return kept.select("bug_id", "patch_id", "n", F.date_format("gathered_at", "yyyy-MM-dd HH:mm:ss").alias("gathered_at"))


QUERIES = {
    **{f"resample_{r.lower()}_all": partial(resample_all, r) for r in RULES}, **{f"resample_{r.lower()}_by_author": partial(resample_by_author, r) for r in ("W", "ME", "QE", "SME")},
    **{f"resample_me_{h}": partial(resample_month, h) for h in ("mean", "median", "max", "min", "std")},
    **{f.__name__: f for f in (
        author_weekly_dense, percent_columns, authors_info, authors_top_n, author_counts, core_authors, core_authors_by_commits, value_range, date_range, date_range_by_dataset,
        heatmap_hour_weekday, hist_hour, hist_weekday, local_time_split, bihist, hist_range, describe_commits, describe_by_merge, fixed_window, rolling_mean, non_merge_dated, from_date_filter,
        from_date_not_a_date, ratio_of_frames, series_extended, names_of_columns, gravatar, time_ranges, humanised, round_10s, latest_before, root_rows, gathered_twice,
    )},
}

COMMITS = """
commits AS (
    SELECT dataset, bug_id, patch_id, file_names, "+:count" AS p_count, "-:count" AS m_count, "+:type.code" AS p_code, "+:type.documentation" AS p_documentation,
           "diff.patch_size" AS patch_size, "diff.n_files" AS n_files, "diff.n_hunks" AS n_hunks, "author.name" AS author_name, "author.email" AS author_email, "author.tz_info" AS author_tz,
           "author.timestamp" AS author_timestamp, "committer.timestamp" AS committer_timestamp, make_timestamp("author.timestamp" * 1000000) AS author_date,
           make_timestamp("committer.timestamp" * 1000000) AS committer_date, 1 AS n_commits
    FROM timeline WHERE n_parents = 1 AND "author.timestamp" IS NOT NULL AND "committer.timestamp" IS NOT NULL
)"""
BUCKETS = {
    "D": "author_date::DATE", "W": "(date_trunc('week', author_date)::DATE + 6)", "ME": "last_day(author_date)", "QE": "last_day(date_trunc('quarter', author_date) + INTERVAL 2 MONTH)",
    "SME": "CASE WHEN author_date::DATE = last_day(author_date) THEN last_day(author_date) WHEN day(author_date) >= 15 THEN make_date(year(author_date), month(author_date), 15) ELSE last_day(author_date - INTERVAL 1 MONTH) END",
}
_MONTHS = "SELECT unnest(generate_series(date_trunc('month', (SELECT min(bucket) FROM found)), date_trunc('month', (SELECT max(bucket) FROM found)), INTERVAL {0} MONTH)) AS m"
SPINES = {
    "D": "SELECT unnest(generate_series((SELECT min(bucket) FROM found), (SELECT max(bucket) FROM found), INTERVAL 1 DAY))::DATE AS bucket",
    "W": "SELECT unnest(generate_series((SELECT min(bucket) FROM found), (SELECT max(bucket) FROM found), INTERVAL 7 DAY))::DATE AS bucket",
    "ME": f"SELECT last_day(m) AS bucket FROM ({_MONTHS.format(1)})", "QE": f"SELECT last_day(m) AS bucket FROM ({_MONTHS.format(3)})",
    "SME": f"SELECT bucket FROM (SELECT unnest([(m + INTERVAL 14 DAY)::DATE, last_day(m)]) AS bucket FROM ({_MONTHS.format(1)})) WHERE bucket BETWEEN (SELECT min(bucket) FROM found) AND (SELECT max(bucket) FROM found)",
}


def _resample_sql(rule: str, aggregates: dict[str, str], where: str = "true") -> str:
    sums = ", ".join(f"{a} AS {c}" for c, a in aggregates.items())
    out = ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" if a.startswith("sum") else f"round({c}, 6) AS {c}" for c, a in aggregates.items())
    return f"WITH {COMMITS}, found AS (SELECT {BUCKETS[rule]} AS bucket, {sums} FROM commits WHERE {where} GROUP BY 1), spine AS ({SPINES[rule]}) SELECT spine.bucket::VARCHAR AS bucket, {out} FROM spine LEFT JOIN found ON spine.bucket = found.bucket"


def _grouped_sql(rule: str, values: tuple[str, ...] = VALUES) -> str:
    sums = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in values)
    return f"SELECT author_email, {BUCKETS[rule]} AS bucket, {sums} FROM commits WHERE author_email IS NOT NULL GROUP BY 1, 2"


_TZ = "CASE WHEN regexp_full_match(author_tz, '[-+][0-9]{4}') THEN (CASE WHEN author_tz[1] = '-' THEN -1 ELSE 1 END) * (author_tz[2:3]::INT * 3600 + author_tz[4:5]::INT * 60) END"
LOCAL = f"locals AS (SELECT *, author_date + to_seconds({_TZ}) AS local FROM commits)"
_HEAT = f"""WITH {COMMITS}, {LOCAL}, seen AS (SELECT isodow(local) - 1 AS weekday, hour(local) AS hour_local, count(*) AS n FROM locals WHERE local IS NOT NULL GROUP BY 1, 2),
cells AS (SELECT w.w AS weekday, h.h AS hour_local FROM (SELECT unnest(range(7)) AS w) w, (SELECT unnest(range(24)) AS h) h),
heat AS (SELECT cells.weekday::INT AS weekday, cells.hour_local::INT AS hour_local, coalesce(n, 0) AS n_commits FROM cells LEFT JOIN seen ON cells.weekday = seen.weekday AND cells.hour_local = seen.hour_local)"""


def _describe_sql(source: str, columns: list[str]) -> str:
    one = "SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c})::DOUBLE AS max FROM {s}"
    return " UNION ALL ".join(one.format(c=c, s=source) for c in columns)


_CORE = "levels AS (SELECT n AS level, count(*) AS k FROM counts GROUP BY 1), sums AS (SELECT level, coalesce(sum(level * k) OVER (ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(level * k) OVER () AS total FROM levels) SELECT author, n FROM counts WHERE n >= (SELECT min(level) FROM sums WHERE above <= total * {0})"
_KIND = "SELECT 'code' AS kind, \"+:type.code\" AS n FROM timeline UNION ALL SELECT 'documentation', \"+:type.documentation\" FROM timeline UNION ALL SELECT 'other', \"-:count\" FROM timeline"
_PERC = lambda a, b: f"round({a}::DOUBLE / nullif({b}, 0), 6)"

SQL = {
    **{f"resample_{r.lower()}_all": _resample_sql(r, {c: f"sum({c})" for c in VALUES}) for r in RULES},
    **{f"resample_{r.lower()}_by_author": f"WITH {COMMITS} SELECT author_email, bucket::VARCHAR AS bucket, {', '.join(VALUES)} FROM ({_grouped_sql(r)})" for r in ("W", "ME", "QE", "SME")},
    **{f"resample_me_{h}": _resample_sql("ME", {"n_commits": "sum(n_commits)", "p_count": f"{s}(p_count)::DOUBLE", "m_count": f"{s}(m_count)::DOUBLE"}) for h, s in (("mean", "avg"), ("median", "median"), ("max", "max"), ("min", "min"), ("std", "stddev_samp"))},
    "author_weekly_dense": f"""WITH {COMMITS}, g AS ({_grouped_sql("W", ("n_commits", "p_count"))}), ends AS (SELECT author_email, min(bucket) AS a, max(bucket) AS z FROM g GROUP BY 1),
        spine AS (SELECT author_email, unnest(generate_series(a, z, INTERVAL 7 DAY))::DATE AS bucket FROM ends)
        SELECT spine.author_email, spine.bucket::VARCHAR AS bucket, coalesce(n_commits, 0) AS n_commits, coalesce(p_count, 0) AS p_count FROM spine LEFT JOIN g ON spine.author_email = g.author_email AND spine.bucket = g.bucket""",
    "percent_columns": f"WITH r AS ({_resample_sql('W', {c: f'sum({c})' for c in ('p_count', 'm_count', 'p_code', 'p_documentation')})}) SELECT *, {_PERC('p_code', 'p_count')} AS p_code_perc, {_PERC('0', 'm_count')} AS m_code_perc, {_PERC('p_code', '(p_count + m_count)')} AS code_perc, {_PERC('p_documentation', 'p_count')} AS p_documentation_perc, {_PERC('0', 'm_count')} AS m_documentation_perc, {_PERC('p_documentation', '(p_count + m_count)')} AS documentation_perc FROM r",
    "authors_info": f"""WITH {COMMITS}, names AS (SELECT author_email, author_name, row_number() OVER (PARTITION BY author_email ORDER BY count(*) DESC, author_name) AS rn FROM commits WHERE author_email IS NOT NULL AND author_name IS NOT NULL GROUP BY 1, 2)
        SELECT c.author_email, coalesce(sum(n_commits), 0)::BIGINT AS n_commits, coalesce(sum(p_count), 0)::BIGINT AS p_count, coalesce(sum(m_count), 0)::BIGINT AS m_count, coalesce(sum(file_names), 0)::BIGINT AS file_names, coalesce(sum(patch_size), 0)::BIGINT AS patch_size, coalesce(sum(n_files), 0)::BIGINT AS n_files, any_value(names.author_name) AS author_name
        FROM commits c LEFT JOIN names ON c.author_email = names.author_email AND rn = 1 WHERE c.author_email IS NOT NULL GROUP BY 1""",
    "authors_top_n": f"""WITH {COMMITS}, names AS (SELECT author_email, author_name, row_number() OVER (PARTITION BY author_email ORDER BY count(*) DESC, author_name) AS rn FROM commits WHERE author_name IS NOT NULL GROUP BY 1, 2)
        SELECT c.author_email, sum(n_commits)::BIGINT AS n_commits, coalesce(sum(p_count), 0)::BIGINT AS p_count, any_value(names.author_name) AS author_name FROM commits c LEFT JOIN names ON c.author_email = names.author_email AND rn = 1 WHERE c.author_email IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "author_counts": f"WITH {COMMITS} SELECT author_name, count(*) AS n FROM commits WHERE author_name IS NOT NULL GROUP BY 1",
    "core_authors": f"WITH {COMMITS}, counts AS (SELECT author_email AS author, count(*) AS n FROM commits WHERE author_email IS NOT NULL GROUP BY 1), {_CORE.format(0.5)}",
    "core_authors_by_commits": f"WITH counts AS (SELECT author, sum(count)::BIGINT AS n FROM author_stats WHERE author IS NOT NULL AND count IS NOT NULL GROUP BY 1), {_CORE.format(0.8)}",
    "value_range": f"WITH {COMMITS} SELECT min(p_count) AS p_count_min, max(p_count) AS p_count_max, min(m_count) AS m_count_min, max(m_count) AS m_count_max, min(patch_size) AS patch_size_min, max(patch_size) AS patch_size_max, 0 AS not_there_min, 1 AS not_there_max FROM commits",
    "date_range": f"WITH {COMMITS} SELECT strftime(min(author_date), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(author_date), '%Y-%m-%d %H:%M:%S') AS last, strftime(max(committer_date), '%Y-%m-%d %H:%M:%S') AS last_committed FROM commits WHERE author_date >= TIMESTAMP '2024-01-01'",
    "date_range_by_dataset": 'SELECT dataset, min("author.timestamp") AS first, max("author.timestamp") AS last, count(*) FILTER ("author.timestamp" IS NULL) AS without FROM timeline GROUP BY 1',
    "heatmap_hour_weekday": f"{_HEAT} SELECT * FROM heat", "hist_hour": f"{_HEAT} SELECT hour_local, sum(n_commits)::BIGINT AS n_commits FROM heat GROUP BY 1", "hist_weekday": f"{_HEAT} SELECT weekday, sum(n_commits)::BIGINT AS n_commits FROM heat GROUP BY 1",
    "local_time_split": f"WITH {COMMITS}, {LOCAL} SELECT bug_id, patch_id, hour(author_date)::INT AS hour_utc, strftime(local, '%Y-%m-%d %H:%M:%S') AS author_date_local, hour(local)::INT AS hour_local, (isodow(local) - 1)::INT AS weekday, dayname(local) AS day_name FROM locals",
    "bihist": f"""WITH {COMMITS}, top AS (SELECT ceil(greatest(max(p_count), max(m_count)) / 10.0) * 10 AS z FROM commits),
        a AS (SELECT least(floor(p_count / 10.0) * 10, z - 10)::DOUBLE AS bin, count(*) AS n FROM commits, top WHERE p_count BETWEEN 0 AND z GROUP BY 1), b AS (SELECT least(floor(m_count / 10.0) * 10, z - 10)::DOUBLE AS bin, count(*) AS n FROM commits, top WHERE m_count BETWEEN 0 AND z GROUP BY 1)
        SELECT coalesce(a.bin, b.bin) AS bin, coalesce(a.n, 0) AS n_up, coalesce(-b.n, 0) AS n_down FROM a FULL JOIN b ON a.bin = b.bin""",
    "hist_range": f"WITH {COMMITS} SELECT least(floor(patch_size / 5.0) * 5, 95)::DOUBLE AS bin, count(*) AS n FROM commits WHERE patch_size BETWEEN 0 AND 100 GROUP BY 1",
    "describe_commits": f"WITH {COMMITS} {_describe_sql('commits', ['p_count', 'm_count', 'patch_size', 'n_hunks'])}",
    "describe_by_merge": f"""WITH a AS (SELECT "+:count" AS p_count FROM timeline), b AS (SELECT "+:count" AS p_count FROM timeline WHERE n_parents = 1) SELECT *, 'with' AS merges FROM ({_describe_sql('a', ['p_count'])}) UNION ALL SELECT *, 'without' FROM ({_describe_sql('b', ['p_count'])})""",
    "fixed_window": f"WITH {COMMITS} SELECT strftime(make_timestamp(((floor((author_timestamp - 300) / 1020.0) * 1020 + 300) * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM commits GROUP BY 1",
    "rolling_mean": f"""WITH {COMMITS}, g AS ({_grouped_sql("W", ("n_commits",))}) SELECT author_email, bucket::VARCHAR AS bucket, n_commits, CASE WHEN count(*) OVER w = 3 THEN round(avg(n_commits) OVER w, 6) END AS rolling_mean, CASE WHEN count(*) OVER w = 3 THEN round(stddev_samp(n_commits) OVER w, 6) END AS rolling_std FROM g WINDOW w AS (PARTITION BY author_email ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "non_merge_dated": f"WITH {COMMITS} SELECT dataset, bug_id, patch_id, author_timestamp, committer_timestamp FROM commits",
    "from_date_filter": f"WITH {COMMITS} SELECT dataset, count(*) AS n FROM commits WHERE author_date >= TIMESTAMP '2024-06-01' GROUP BY 1", "from_date_not_a_date": f"WITH {COMMITS} SELECT dataset, count(*) AS n FROM commits GROUP BY 1",
    "ratio_of_frames": f"WITH a AS ({_resample_sql('ME', {'n_commits': 'sum(n_commits)'}, chr(100) + 'ataset = ' + chr(39) + 'crawl' + chr(39))}), b AS ({_resample_sql('ME', {'n_commits': 'sum(n_commits)'})}) SELECT a.bucket, round(a.n_commits::DOUBLE / nullif(b.n_commits, 0), 6) AS share FROM a JOIN b ON a.bucket = b.bucket",
    "series_extended": f"""WITH {COMMITS}, m AS (SELECT last_day(author_date) AS bucket, count(*) AS n FROM commits GROUP BY 1), spine AS (SELECT last_day(unnest(generate_series(date_trunc('month', (SELECT min(bucket) FROM m)), date_trunc('month', (SELECT max(bucket) FROM m)) + INTERVAL 3 MONTH, INTERVAL 1 MONTH))) AS bucket)
        SELECT spine.bucket::VARCHAR AS bucket, coalesce(n, 0) AS n FROM spine LEFT JOIN m ON spine.bucket = m.bucket""",
    "names_of_columns": "SELECT key, sum(n)::BIGINT AS n FROM (UNPIVOT (SELECT COLUMNS('^(language|type|purpose):') FROM timeline) ON * INTO NAME key VALUE n) GROUP BY 1",
    "gravatar": f"WITH {COMMITS} SELECT DISTINCT author_email, 'https://www.gravatar.com/avatar/' || sha256(lower(trim(author_email))) || '?s=16&d=retro' AS url FROM commits WHERE author_email IS NOT NULL",
    "time_ranges": f"WITH {COMMITS}, m AS (SELECT unnest([1, 3, 6, 12, 24])::INT AS months) SELECT months, strftime((SELECT max(author_date) FROM commits)::DATE - to_months(months), '%Y.%m.%d') AS since FROM m UNION ALL SELECT NULL, ''",
    "humanised": f"WITH {COMMITS}, s AS (SELECT dataset, sum(p_count)::BIGINT AS n, max(author_date) AS d FROM commits GROUP BY 1) SELECT dataset, format('{{:,}}', n) AS lines, strftime(d, '%-d %b %Y') AS last, strftime(d, '%Y-%m') AS month, printf('%-14s: %6d lines', dataset, n) AS label FROM s",
    "round_10s": f"""WITH {COMMITS}, x AS (SELECT DISTINCT p_count FROM commits) SELECT p_count, CASE WHEN p_count > 0 THEN ceil(p_count / pow(10, floor(log10(p_count)))) * pow(10, floor(log10(p_count))) ELSE 1.0 END::DOUBLE AS up,
        CASE WHEN p_count > 0 THEN floor(p_count / 10.0 / pow(10, floor(log10(p_count / 10.0)))) * pow(10, floor(log10(p_count / 10.0))) ELSE 0.0 END::DOUBLE AS width FROM x""",
    "latest_before": f"WITH {COMMITS} SELECT dataset, patch_id, author_timestamp FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY author_timestamp DESC, patch_id DESC) AS rn FROM commits WHERE author_timestamp <= 1718000000) WHERE rn = 1",
    "root_rows": 'SELECT dataset, count(*) AS n, count(*) FILTER (n_parents = 0) AS roots, count(*) FILTER (n_parents > 1) AS merges, min("author.timestamp") AS oldest FROM timeline GROUP BY 1',
    "gathered_twice": "SELECT bug_id, patch_id, count(*) AS n, strftime(min(gathered_at), '%Y-%m-%d %H:%M:%S') AS gathered_at FROM timeline GROUP BY 1, 2",
}
