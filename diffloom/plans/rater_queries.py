"""Queries over raters' labels and of scalar functions on literals, with their SQL."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.functions import scalars
from diffloom.functions.labels import ALIASES, clean_label
from diffloom.functions.labels import LABELS as ALL_LABELS
from diffloom.operators import agreement as ag
from diffloom.session import table


LABELS = list(ALL_LABELS)


def _clean(spark: SparkSession, sf_dir: str, auto: bool = False) -> DataFrame:
    """Labels in any spelling as those of :data:`LABELS`, without null and blank ones; one row per item, user and label."""
    rows = table(spark, sf_dir, "df_inter_rater").filter(F.coalesce("auto", F.lit(False)) == auto)
    rows = rows.withColumn("label", clean_label(F.col("annotation"))).filter(F.col("label").isNotNull())
    return rows.select("id", "file", "image", "line", "user", "label", "fcat", "ds", "bug").distinct()


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields])


def pair_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.rater_pairs(_clean(spark, sf_dir))


def user_against_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that raters and the tool labelled, on all keys, and how often they agree."""
    tool = _clean(spark, sf_dir, auto=True).select("id", "file", "image", "line", F.col("label").alias("tool"))
    both = _clean(spark, sf_dir).join(tool, list(ag.ITEM))
    return both.groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("tool")).alias("n_same"))


def outer_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by whether raters, the tool or both labelled them."""
    a = _clean(spark, sf_dir).select(*ag.ITEM).distinct()
    b = _clean(spark, sf_dir, auto=True).select(*ag.ITEM).distinct()
    return ag.with_indicator(a, b, list(ag.ITEM)).groupBy("_merge").agg(F.count(F.lit(1)).alias("n"))


def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.vote(_clean(spark, sf_dir), LABELS)


def left_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label beside its item's consensus."""
    labels = _clean(spark, sf_dir)
    agreed = ag.vote(labels, LABELS).filter("agreed").select(*ag.ITEM, F.col("label").alias("consensus"))
    return labels.join(agreed, list(ag.ITEM), "left").groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("consensus")).alias("n_agree"), F.count_if(F.col("consensus").isNull()).alias("n_open"))


def users_vs_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = _clean(spark, sf_dir, auto=True).groupBy(*ag.ITEM).agg(F.min("label").alias("label"))
    return ag.votes_against(ag.vote(_clean(spark, sf_dir), LABELS), tool)


def wide_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a column for each rater of the table, by a pivot in place of outer joins; labels without a user are in the column ``null``."""
    return _clean(spark, sf_dir).groupBy(*ag.ITEM).pivot("user").agg(F.min("label"))


def left_only_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that the tool labelled and no rater did."""
    return _clean(spark, sf_dir, auto=True).select(*ag.ITEM).distinct().join(_clean(spark, sf_dir), list(ag.ITEM), "left_anti")


def confusion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _clean(spark, sf_dir)
    best = ag.vote(labels, LABELS).select(*ag.ITEM, F.col("label").alias("consensus"))
    return _rounded(ag.confusion(labels.join(best, list(ag.ITEM)), "consensus", "label"))


def share_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ag.confusion(_clean(spark, sf_dir), "fcat", "label"))


def pivot_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ag.shares_by(_clean(spark, sf_dir), ["ds"], "label", LABELS))


def label_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By dataset, how many bugs have tests at least as often as documentation and that as fixes, and so on for each order.

    Bugs are told apart by whether any label is refactoring or other (``_tc``) or none is (``_no_tc``).
    """
    s = ag.shares_by(_clean(spark, sf_dir), ["bug", "ds"], "label", LABELS).withColumn("tc", F.col("refactoring") + F.col("other") > 0)
    orders = itertools.permutations(["test", "documentation", "bugfix"])
    counts = [F.count_if((F.col(a) >= F.col(b)) & (F.col(b) >= F.col(c)) & (F.col("tc") == tc)).alias(f"{a[0]}{b[0]}{c[0]}{'_tc' if tc else '_no_tc'}") for a, b, c in orders for tc in (True, False)]
    return s.groupBy("ds").agg(F.count(F.lit(1)).alias("bugs"), *counts, F.count_if((F.col("test") > 0) & (F.col("cosmetic") > 0)).alias("with_tests_and_style"))


def fleiss_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kappa for each number of labels an item has, so that every pairable item is in one row."""
    return _rounded(ag.fleiss_by_raters(_clean(spark, sf_dir)))


def chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ag.chi_square(_clean(spark, sf_dir), "fcat", "label"))


def count_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.count_of_counts(_clean(spark, sf_dir), list(ag.ITEM))


def match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By dataset and file kind, labels and those that are their item's consensus, and their ratio."""
    labels = _clean(spark, sf_dir)
    best = ag.vote(labels, LABELS).select(*ag.ITEM, F.col("label").alias("consensus"))
    rows = labels.join(best, list(ag.ITEM)).groupBy("ds", "fcat").agg(F.count(F.lit(1)).alias("every"), F.count_if(F.col("label") == F.col("consensus")).alias("matches"))
    return _rounded(rows.withColumn("ratio", F.col("matches") / F.col("every")))


def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their kind, once; of several kinds the first by name."""
    rows = table(spark, sf_dir, "df_inter_rater").select("id", "file", "fcat").distinct()
    return ag.first_of(rows, ["id", "file"], ["fcat"])


def split_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "df_inter_rater").select("id", "image").distinct()
    short = F.when(F.col("image") == "beforeChange", "-").when(F.col("image") == "afterChange", "+")
    return rows.select("id", "image", F.split_part("id", F.lit("_"), F.lit(1)).alias("ds"), F.split_part("id", F.lit("_"), F.lit(2)).alias("bug"), short.alias("side"))


def union_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of labels by raters and by the tool, one above the other, with 0 where one side has none."""
    a = _clean(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("by_raters"))
    b = _clean(spark, sf_dir, auto=True).groupBy("label").agg(F.count(F.lit(1)).alias("by_tool"))
    return a.unionByName(b, allowMissingColumns=True).fillna(0, ["by_raters", "by_tool"]).groupBy("label").agg(F.sum("by_raters").alias("by_raters"), F.sum("by_tool").alias("by_tool"))


def except_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who labelled no line of documentation as such."""
    rows = _clean(spark, sf_dir)
    return rows.select("user", "fcat").exceptAll(rows.filter("label = 'documentation'").select("user", "fcat")).groupBy("user", "fcat").agg(F.count(F.lit(1)).alias("n"))


def unpivot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _clean(spark, sf_dir).groupBy("ds").pivot("label", LABELS).agg(F.count(F.lit(1)))
    return wide.unpivot(["ds"], LABELS, "label", "n")


def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir).cube("ds", "fcat").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")).select("ds", "fcat", "n", F.col("level").cast("int").alias("level"))


def lookup_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their orders, customers, nations and regions; orders with exactly one urgent line's flag."""
    t = lambda name: table(spark, sf_dir, name)
    once = t("lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("l_orderkey")
    lines = t("lineitem").join(once, "l_orderkey", "left_semi")
    joined = lines.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = joined.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("o_orderkey").alias("orders"))


def _literals(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


AUTHOR_LINES = ["A U Thor <author@mail.example> 1112354055 +0200", "Joe <j@x> <y@z> 0 -0530", "no address 12 +0000", "X <> 99 +0000"]
HEADERS = ["old mode 100644\nnew mode 100755", "new file mode 100644\nindex 0000000..1234567", "deleted file mode 160000\nindex 1234567..0000000", "index 1234567..89abcde 100644", "similarity index 90%"]
STATUS = ["A\tnew.py", "D\told.py", "M\tsame.py", "R087\told.py\tnew.py", "C100\ta.py\tb.py", "T\tlink"]
SHORTLOG = ["     3\tA U Thor", "    12\tJoe\tRandom", "1\tX"]
DATES = ["Thu Apr 7 22:13:13 2005 +0200", "Sat Dec 31 23:59:59 2022 -0530"]
IDS = ["CVE-2021-21332", "CVE-2019-1", "other"]


def parse_authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark, "line", AUTHOR_LINES).select("line", scalars.authorship(F.col("line")).alias("a")).select("line", "a.*")


def file_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark, "header", HEADERS).select("header", scalars.file_mode(F.col("header"), "pre").alias("pre"), scalars.file_mode(F.col("header"), "post").alias("post"))


def name_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda i: F.nullif(F.split_part("line", F.lit("\t"), F.lit(i)), F.lit(""))
    return _literals(spark, "line", STATUS).select("line", scalars.name_status(part(1), part(2), part(3)).alias("x")).select("line", "x.*")


def shortlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark, "line", SHORTLOG).select("line", scalars.shortlog(F.col("line")).alias("x")).select("line", "x.*")


def log_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.regexp_replace("text", r"^\w+ ", "")
    return _literals(spark, "text", DATES).select("text", F.date_format(F.to_timestamp(rest, "MMM d HH:mm:ss yyyy Z"), "yyyy-MM-dd HH:mm:ss").alias("at"))


def id_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _literals(spark, "id", IDS).select("id", F.nullif(F.split_part("id", F.lit("-"), F.lit(2)), F.lit("")).alias("year"))


QUERIES = {f.__name__: f for f in (
    pair_agreement, user_against_auto, outer_indicator, consensus_vote, left_consensus, users_vs_auto, wide_votes, left_only_lines, confusion_pairs, share_by_group, pivot_share, label_structure, fleiss_kappa, chi_square, count_of_counts,
    match_stats, distinct_rows, split_ids, union_fill, except_users, unpivot_labels, cube_counts, lookup_chain, parse_authorship, file_mode, name_status, shortlog, log_dates, id_years,
)}

_IN = ", ".join(f"'{x}'" for x in LABELS)
_ALIASES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items())
_NEAR = " ".join(f"WHEN levenshtein(word, '{k}') <= {2 if len(k) > 7 else 1} THEN '{k}'" for k in LABELS)
BASE = f"""
words AS (SELECT id, file, image, line, "user" AS u, regexp_replace(lower(annotation), '[^\\p{{L}}]+', '', 'g') AS word, fcat, ds, bug, coalesce(auto, false) AS auto FROM df_inter_rater WHERE trim(regexp_replace(annotation, '\\s+', ' ', 'g')) <> ''),
raw AS (SELECT DISTINCT id, file, image, line, u, CASE WHEN word IN ({_IN}) THEN word ELSE coalesce(CASE word {_ALIASES} END, CASE {_NEAR} END, 'other') END AS label, fcat, ds, bug, auto FROM words),
labels AS (SELECT * FROM raw WHERE NOT auto), tool AS (SELECT * FROM raw WHERE auto)"""
_RANK = "CASE label " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(LABELS)) + " END"
VOTE = f"""
cells AS (SELECT id, file, image, line, label, count(*) AS votes FROM labels GROUP BY ALL),
vote AS (SELECT id, file, image, line, label, votes, n_reviewers, votes >= 2 AS agreed FROM (SELECT *, sum(votes) OVER w::BIGINT AS n_reviewers, row_number() OVER (PARTITION BY id, file, image, line ORDER BY votes DESC, {_RANK}) AS rn FROM cells WINDOW w AS (PARTITION BY id, file, image, line)) WHERE rn = 1)"""
_SHARES = "SELECT {0}, " + ", ".join(f"count(*) FILTER (label = '{x}') * 100.0 / count(*) AS {x}" for x in LABELS) + " FROM labels GROUP BY {0}"
_ORDERS = [("test", "documentation", "bugfix"), ("test", "bugfix", "documentation"), ("documentation", "test", "bugfix"), ("documentation", "bugfix", "test"), ("bugfix", "test", "documentation"), ("bugfix", "documentation", "test")]


def _values(name: str, values: list[str]) -> str:
    return "(VALUES " + ", ".join("('" + v.replace("'", "''") + "')" for v in values) + f") t({name})"


_AUTH = scalars.AUTHORSHIP
SQL = {
    "pair_agreement": f"WITH {BASE} SELECT a.u AS user_a, b.u AS user_b, count(*) AS n, count(*) FILTER (a.label = b.label) AS n_same FROM labels a JOIN labels b ON a.id = b.id AND a.file = b.file AND a.image = b.image AND a.line = b.line AND a.u < b.u GROUP BY 1, 2",
    "user_against_auto": f'WITH {BASE} SELECT a.u AS "user", count(*) AS n, count(*) FILTER (a.label = b.label) AS n_same FROM labels a JOIN tool b USING (id, file, image, line) GROUP BY 1',
    "outer_indicator": f"WITH {BASE}, a AS (SELECT DISTINCT id, file, image, line, 1 AS l FROM labels), b AS (SELECT DISTINCT id, file, image, line, 1 AS r FROM tool) SELECT CASE WHEN r IS NULL THEN 'left_only' WHEN l IS NULL THEN 'right_only' ELSE 'both' END AS _merge, count(*) AS n FROM a FULL JOIN b USING (id, file, image, line) GROUP BY 1",
    "consensus_vote": f"WITH {BASE}, {VOTE} SELECT * FROM vote",
    "left_consensus": f'WITH {BASE}, {VOTE}, c AS (SELECT id, file, image, line, label AS consensus FROM vote WHERE agreed) SELECT u AS "user", count(*) AS n, count(*) FILTER (label = consensus) AS n_agree, count(*) FILTER (consensus IS NULL) AS n_open FROM labels LEFT JOIN c USING (id, file, image, line) GROUP BY 1',
    "users_vs_auto": f"WITH {BASE}, {VOTE}, a AS (SELECT id, file, image, line, min(label) AS auto_label FROM tool GROUP BY ALL) SELECT CASE WHEN agreed THEN votes::VARCHAR || CASE WHEN label = auto_label THEN 'U == A' ELSE 'U != A' END ELSE 'other' END AS class, count(*) AS n FROM vote JOIN a USING (id, file, image, line) GROUP BY 1",
    "wide_votes": f"WITH {BASE}, named AS (SELECT id, file, image, line, coalesce(u, 'null') AS u, label FROM labels) SELECT id, file, image, line, COLUMNS(* EXCLUDE (id, file, image, line)) FROM (PIVOT named ON u USING min(label) GROUP BY id, file, image, line)",
    "left_only_lines": f"WITH {BASE} SELECT DISTINCT id, file, image, line FROM tool ANTI JOIN labels USING (id, file, image, line)",
    "confusion_pairs": f"WITH {BASE}, {VOTE}, p AS (SELECT v.label AS consensus, l.label AS label, count(*) AS n FROM labels l JOIN vote v USING (id, file, image, line) GROUP BY 1, 2) SELECT consensus, label, n, round(n / sum(n) OVER (PARTITION BY consensus), 6)::DOUBLE AS share FROM p",
    "share_by_group": f"WITH {BASE}, p AS (SELECT fcat, label, count(*) AS n FROM labels GROUP BY 1, 2) SELECT fcat, label, n, round(n / sum(n) OVER (PARTITION BY fcat), 6)::DOUBLE AS share FROM p",
    "pivot_share": f"WITH {BASE}, s AS ({_SHARES.format('ds')}) SELECT ds, " + ", ".join(f"round({x}, 6)::DOUBLE AS {x}" for x in LABELS) + " FROM s",
    "label_structure": f"WITH {BASE}, s AS ({_SHARES.format('bug, ds')}) SELECT ds, count(*) AS bugs, " + ", ".join(f"count(*) FILTER ({a} >= {b} AND {b} >= {c} AND refactoring + other {op} 0) AS {a[0]}{b[0]}{c[0]}{name}" for a, b, c in _ORDERS for op, name in ((">", "_tc"), ("=", "_no_tc"))) + ", count(*) FILTER (test > 0 AND cosmetic > 0) AS with_tests_and_style FROM s GROUP BY 1",
    "fleiss_kappa": f"""WITH {BASE}, cells AS (SELECT id, file, image, line, label, count(*)::DOUBLE AS c FROM labels GROUP BY ALL), i AS (SELECT id, file, image, line, sum(c)::BIGINT AS n, sum(c * c) AS c2 FROM cells GROUP BY ALL HAVING sum(c) > 1),
        p AS (SELECT n, count(*) AS k, avg((c2 - n) / (n * (n - 1))) AS seen FROM i GROUP BY n), j AS (SELECT i.n, label, sum(c) AS c FROM cells JOIN i ON cells.id IS NOT DISTINCT FROM i.id AND cells.file IS NOT DISTINCT FROM i.file AND cells.image IS NOT DISTINCT FROM i.image AND cells.line IS NOT DISTINCT FROM i.line GROUP BY 1, 2),
        q AS (SELECT n, sum(pow(c / (n * k), 2)) AS chance FROM j JOIN p USING (n) GROUP BY 1)
        SELECT n AS raters, k AS n_items, round(seen, 6) AS observed, round(chance, 6) AS expected, round((seen - chance) / nullif(1 - chance, 0), 6) AS kappa FROM p JOIN q USING (n)""",
    "chi_square": f"""WITH {BASE}, o AS (SELECT fcat AS a, label AS b, count(*)::DOUBLE AS o FROM labels WHERE fcat IS NOT NULL GROUP BY 1, 2), a AS (SELECT a, sum(o) AS ra FROM o GROUP BY 1), b AS (SELECT b, sum(o) AS rb FROM o GROUP BY 1), n AS (SELECT sum(o) AS n FROM o)
        SELECT round(sum(pow(coalesce(o, 0) - ra * rb / n, 2) / (ra * rb / n)), 6) AS statistic, (count(DISTINCT a.a) - 1) * (count(DISTINCT b.b) - 1) AS dof, any_value(n)::BIGINT AS n FROM a, b, n LEFT JOIN o ON o.a = a.a AND o.b = b.b""",
    "count_of_counts": f"WITH {BASE} SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM labels GROUP BY id, file, image, line) GROUP BY 1",
    "match_stats": f"WITH {BASE}, {VOTE}, m AS (SELECT ds, fcat, count(*) AS every, count(*) FILTER (l.label = v.label) AS matches FROM labels l JOIN vote v USING (id, file, image, line) GROUP BY 1, 2) SELECT *, round(matches / every, 6) AS ratio FROM m",
    "distinct_rows": "SELECT id, file, min(fcat) AS fcat FROM df_inter_rater GROUP BY 1, 2",
    "split_ids": "SELECT DISTINCT id, image, split_part(id, '_', 1) AS ds, split_part(id, '_', 2) AS bug, CASE image WHEN 'beforeChange' THEN '-' WHEN 'afterChange' THEN '+' END AS side FROM df_inter_rater",
    "union_fill": f"WITH {BASE} SELECT label, count(*) FILTER (NOT auto) AS by_raters, count(*) FILTER (auto) AS by_tool FROM (FROM labels UNION ALL FROM tool) GROUP BY 1",
    "except_users": f"""WITH {BASE} SELECT "user", fcat, count(*) AS n FROM (SELECT u AS "user", fcat FROM labels EXCEPT ALL SELECT u, fcat FROM labels WHERE label = 'documentation') GROUP BY 1, 2""",
    "unpivot_labels": f"WITH {BASE}, d AS (SELECT DISTINCT ds FROM labels), k AS (SELECT unnest([{_IN}]) AS label) SELECT d.ds, k.label, (SELECT nullif(count(*), 0) FROM labels l WHERE l.ds = d.ds AND l.label = k.label) AS n FROM d, k",
    "cube_counts": f"WITH {BASE} SELECT ds, fcat, count(*) AS n, grouping_id(ds, fcat)::INT AS level FROM labels GROUP BY CUBE (ds, fcat)",
    "lookup_chain": "SELECT r_name, count(*) AS lines, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) = 1) GROUP BY 1",
    "parse_authorship": f"SELECT line, CASE WHEN m THEN regexp_extract(line, '{_AUTH}', 1) END AS author, CASE WHEN m THEN regexp_extract(line, '{_AUTH}', 2) END AS name, CASE WHEN m THEN regexp_extract(line, '{_AUTH}', 3) END AS email, CASE WHEN m THEN regexp_extract(line, '{_AUTH}', 4)::BIGINT END AS timestamp, CASE WHEN m THEN regexp_extract(line, '{_AUTH}', 5) END AS tz_info FROM (SELECT line, regexp_matches(line, '{_AUTH}') AS m FROM {_values('line', AUTHOR_LINES)})",
    "file_mode": f"SELECT header, coalesce(nullif(regexp_extract(header, '(?m)^(?:old|deleted file) mode ([0-7]{{6}})$', 1), ''), nullif(regexp_extract(header, '(?m)^index [0-9a-f.]+ ([0-7]{{6}})$', 1), '')) AS pre, coalesce(nullif(regexp_extract(header, '(?m)^(?:new|new file) mode ([0-7]{{6}})$', 1), ''), nullif(regexp_extract(header, '(?m)^index [0-9a-f.]+ ([0-7]{{6}})$', 1), '')) AS post FROM {_values('header', HEADERS)}",
    "name_status": f"SELECT line, CASE WHEN line[1] = 'A' THEN NULL ELSE split_part(line, chr(9), 2) END AS old, CASE WHEN line[1] = 'D' THEN NULL WHEN line[1] IN ('R', 'C') THEN split_part(line, chr(9), 3) ELSE split_part(line, chr(9), 2) END AS new FROM {_values('line', STATUS)}",
    "shortlog": f"SELECT line, trim(split_part(line, chr(9), 1))::BIGINT AS count, split_part(line, chr(9), 2) AS author FROM {_values('line', SHORTLOG)}",
    "log_dates": f"SELECT text, strftime(strptime(text, '%a %b %-d %H:%M:%S %Y %z')::TIMESTAMPTZ AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at FROM {_values('text', DATES)}",
    "id_years": f"SELECT id, nullif(split_part(id, '-', 2), '') AS year FROM {_values('id', IDS)}",
}
