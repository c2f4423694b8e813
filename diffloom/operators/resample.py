"""Timelines: cleaning, resampling by calendar buckets, percent columns, local time, histograms and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.functions.buckets import bucket, spine
from diffloom.functions.scalars import tz_seconds

#: Aggregates by name; std is that of a sample.
AGGREGATES = {"sum": F.sum, "mean": F.avg, "median": F.median, "max": F.max, "min": F.min, "std": F.stddev_samp}
#: Timeline columns by the plain names used inside.
PLAIN = {
    "+:count": "p_count", "-:count": "m_count", "+:type.code": "p_code", "+:type.documentation": "p_documentation", "+:purpose.programming": "p_programming",
    "diff.n_files": "n_files", "diff.n_hunks": "n_hunks", "diff.patch_size": "patch_size", "diff.groups_spread": "groups_spread", "author.timestamp": "author_timestamp",
    "author.tz_info": "author_tz", "author.name": "author_name", "author.email": "author_email", "committer.timestamp": "committer_timestamp", "committer.name": "committer_name",
}


def plain(timeline: DataFrame) -> DataFrame:
    """Timeline columns that need quoting, renamed; ``language:X`` and the like keep theirs with ``_``."""
    return timeline.select(*[F.col(f"`{c}`").alias(PLAIN.get(c, c.replace(":", "_").replace("/", "").replace(".", "_"))) for c in timeline.columns])


def commits(timeline: DataFrame) -> DataFrame:
    """Commits with one parent and both timestamps, with author_date, committer_date (UTC) and n_commits = 1."""
    kept = plain(timeline).filter("n_parents = 1 AND author_timestamp IS NOT NULL AND committer_timestamp IS NOT NULL")
    return kept.withColumns({"author_date": F.timestamp_seconds("author_timestamp"), "committer_date": F.timestamp_seconds("committer_timestamp"), "n_commits": F.lit(1)})


def since(rows: DataFrame, date: str, column: str = "author_date") -> DataFrame:
    """Rows from a date ``YYYY.MM.DD`` on; all rows if it isn't a date."""
    at = F.try_to_timestamp(F.lit(date), F.lit("yyyy.MM.dd"))
    return rows.filter(F.coalesce(F.col(column) >= at, at.isNull()))


def resample(rows: DataFrame, rule: str, values: dict[str, str], date: str = "author_date", by: str | None = None) -> DataFrame:
    """Aggregates of ``values`` (column to name of an aggregate) by bucket, and by a group if ``by`` is given.

    Without a group every bucket from the first to the last is there: an empty one sums to 0, other aggregates are null.
    With a group only observed pairs are. A sum over nulls is 0. Rows without a date, or group, take no part.
    """
    kept = rows.filter(F.col(date).isNotNull()) if by is None else rows.filter(F.col(date).isNotNull() & F.col(by).isNotNull())
    keys = [by] if by else []
    sums = {c: AGGREGATES[how](F.col(c)) for c, how in values.items()}
    found = kept.groupBy(*keys, bucket(F.col(date), rule).alias("bucket")).agg(*[a.alias(c) for c, a in sums.items()])
    if by is None:
        ends = found.agg(F.min("bucket").alias("a"), F.max("bucket").alias("z"))
        found = ends.select(F.explode(spine(F.col("a"), F.col("z"), rule)).alias("bucket")).join(found, "bucket", "left")
    return found.withColumns({c: F.coalesce(c, F.lit(0)) for c, how in values.items() if how == "sum"})


def densify(grouped: DataFrame, rule: str, by: str) -> DataFrame:
    """Grouped buckets with the missing ones between each group's first and last, where every value is 0."""
    values = [c for c in grouped.columns if c not in (by, "bucket")]
    ends = grouped.groupBy(by).agg(F.min("bucket").alias("a"), F.max("bucket").alias("z"))
    every = ends.select(by, F.explode(spine(F.col("a"), F.col("z"), rule)).alias("bucket"))
    return every.join(grouped, [by, "bucket"], "left").fillna(0, values)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b)


def percents(rows: DataFrame, parts: list[str], total: str = "count") -> DataFrame:
    """``p_<part>_perc`` and so on: the share of each part in the count of its side; a missing column counts 0.

    ``<part>_perc`` is the share in both sides together. All are null where the count is 0.
    """
    get = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in rows.columns else F.lit(0)
    new = {}
    for part in parts:
        for side in "pm":
            new[f"{side}_{part}_perc"] = ratio(get(f"{side}_{part}"), get(f"{side}_{total}"))
        new[f"{part}_perc"] = ratio(get(f"p_{part}") + get(f"m_{part}"), get(f"p_{total}") + get(f"m_{total}"))
    return rows.withColumns(new)


def local_times(rows: DataFrame) -> DataFrame:
    """hour_utc, author_date_local, hour_local, weekday (Monday is 0) and day_name from author_date and author_tz."""
    local = (F.col("author_date").cast("double") + tz_seconds(F.col("author_tz"))).cast("timestamp")
    return rows.withColumns({"hour_utc": F.hour("author_date"), "author_date_local": local}).withColumns(
        {"hour_local": F.hour("author_date_local"), "weekday": F.weekday("author_date_local"), "day_name": F.date_format("author_date_local", "EEEE")}
    )


def periodicity(rows: DataFrame) -> DataFrame:
    """Commits by local weekday and hour, with all 168 cells."""
    seen = local_times(rows).filter("hour_local IS NOT NULL").groupBy("weekday", "hour_local").agg(F.count(F.lit(1)).alias("n_commits"))
    cells = rows.sparkSession.range(168).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour_local"))
    return cells.join(seen, ["weekday", "hour_local"], "left").fillna(0, ["n_commits"])


def histogram(rows: DataFrame, column: str, width: float, low: float = 0.0, high: float | None = None) -> DataFrame:
    """(bin, n): counts of half-open bins of ``width`` from ``low``, of which the last is closed; what lies outside is dropped.

    ``high`` is the end of the last bin, else the least multiple of ``width`` not below the greatest value.
    """
    x = F.col(column).cast("double")
    if high is None:
        top = rows.agg(F.ceil((F.max(x) - low) / width) * width + low).first()[0]
        high = float(top) if top is not None else low
    inside = rows.filter((x >= low) & (x <= high))
    last = low + (max(1, round((high - low) / width)) - 1) * width
    place = F.least(F.floor((x - low) / width) * width + low, F.lit(last))
    return inside.groupBy(place.cast("double").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def bihistogram(rows: DataFrame, up: str, down: str, width: float) -> DataFrame:
    """(bin, n_up, n_down): two histograms over the same bins; counts of the second are negative."""
    high = rows.agg(F.greatest(F.max(up), F.max(down))).first()[0]
    high = float(-(-high // width) * width) if high is not None else 0.0
    a = histogram(rows, up, width, 0.0, high).withColumnRenamed("n", "n_up")
    b = histogram(rows, down, width, 0.0, high).select("bin", (-F.col("n")).alias("n_down"))
    return a.join(b, "bin", "full").fillna(0)


def describe(rows: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) of numeric columns; quantiles are interpolated.

    Exact quantiles need all different values of a column in one task. With ``accuracy`` they are within 1/accuracy of their rank and
    come from sketches that merge, for columns of very many values.
    """
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("e.*")
    function = f"approx_percentile(x, {{}}, {accuracy})" if accuracy else "percentile(x, {})"
    quantiles = [F.expr(function.format(q)).alias(n) for n, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
    return long.groupBy("column").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), *quantiles, F.max("x").alias("max"))


def rolling(rows: DataFrame, column: str, size: int, order: list[str], by: list[str]) -> DataFrame:
    """Mean and standard deviation of the last ``size`` rows of each group; null until there are so many."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(size - 1), 0)
    full = F.count(F.lit(1)).over(w) == size
    return rows.withColumns({"rolling_mean": F.when(full, F.avg(column).over(w)), "rolling_std": F.when(full, F.stddev_samp(column).over(w))})
