import pytest
from pyspark.sql import functions as F

from diffloom.operators.inlining import analyse, branch_ends, inline_annotations, numbered, shared_inline

TOKEN = "struct<idx:int,type:array<string>,text:string>"
LINE = f"struct<id:int,hunk_idx:int,in_hunk_chg_idx:int,file_line_no:int,type:string,purpose:string,tokens:array<{TOKEN}>>"
PERSON = "author:string,name:string,email:string,timestamp:bigint,tz_info:string"
SCHEMA = (
    "bug_id string, patch_id string, format_version string, "
    f"commit_metadata struct<id:string,parents:array<string>,tree:string,author:struct<{PERSON}>,committer:struct<{PERSON.replace('author', 'committer')}>,message:string>, "
    f"changes map<string,struct<language:string,type:string,purpose:string,`+`:array<{LINE}>,`-`:array<{LINE}>>>, diff_metadata map<string,bigint>, doc_no int"
)


def line(i, *tokens, none=False):
    return (i, 0, 0, i, "code", "programming", None if none else [(t, ["Name"], "x") for t in tokens])


def rows(spark):
    meta = ("p", ["q", None], "t", ("A <a>", "A", "a", 1, "+0000"), None, "m")
    return spark.createDataFrame(
        [
            ("b", "p", "v2", meta, {"f": ("Python", "programming", None, [line(1, 0, 4), line(2)], [line(1, none=True)]), "g": None, "h": ("C", None, None, [], None)}, {"n": 1}, 7),
            ("b", "p", "v2", meta, {"f": ("Python", "programming", None, [line(1, 0, 4), line(2)], [line(1, none=True)]), "g": None, "h": ("C", None, None, [], None)}, {"n": 1}, 7),
            ("b", "p", "v2", meta, {"f": ("Python", "programming", None, [line(1, 0, 9)], None)}, None, 7),
            ("b", "q", None, None, None, None, None),
            (None, None, None, None, {"z": ("C", None, None, None, [line(3, 1)])}, {}, None),
        ],
        SCHEMA,
    )


def test_graph(spark):
    from pyspark.sql.types import _parse_datatype_string

    node = analyse(_parse_datatype_string(SCHEMA), names={("changes",): "files", ("changes", "+"): "lines"})
    files = next(c for c in node.children if c.name == "files")
    assert files.is_map
    assert [c.name for c in files.children] == ["lines"]
    assert files.children[0].branches == [("+",), ("-",)]
    assert ("commit_metadata", "author", "name") in node.inlined


def test_tables_and_foreign_keys(spark):
    t = inline_annotations(rows(spark))
    assert set(t) == {"patches", "files", "lines", "tokens", "token_types", "parents", "metrics"}
    assert t["patches"].count() == 4  # one was delivered twice
    for child, parent, key in (
        ("files", "patches", ["bug_id", "patch_id", "doc_no"]),
        ("lines", "files", ["bug_id", "patch_id", "doc_no", "files_key"]),
        ("tokens", "lines", ["bug_id", "patch_id", "doc_no", "files_key", "branch", "lines_pos"]),
        ("token_types", "tokens", ["bug_id", "patch_id", "doc_no", "files_key", "branch", "lines_pos", "tokens_pos"]),
    ):
        up = t[parent].alias("u")
        on = [F.col(f"c.{k}").eqNullSafe(F.col(f"u.{k}")) for k in key]
        assert t[child].alias("c").join(up, on, "left_anti").count() == 0
        assert t[parent].groupBy(*key).count().filter("count > 1").count() == 0
        assert t[parent].agg(F.sum(f"n_{child}")).first()[0] == t[child].count()
    assert t["parents"].select("value").collect()[0].value == "q"
    assert t["metrics"].first().n == 1 if "n" in t["metrics"].columns else t["metrics"].first().value == 1


def test_branch_ends(spark):
    got = {tuple(r) for r in branch_ends(inline_annotations(rows(spark))).collect()}
    assert got == {
        ("b", "p", "f", "+", 1, 0), ("b", "p", "f", "+", 1, 4), ("b", "p", "f", "+", 1, 9), ("b", "p", "f", "+", 2, -1), ("b", "p", "f", "-", 1, -1),
        ("b", "p", "g", "", -1, -1), ("b", "p", "h", "", -1, -1), (None, None, "z", "-", 3, 1),
    }


def test_no_rows(spark):
    t = inline_annotations(spark.createDataFrame([], SCHEMA))
    assert all(x.count() == 0 for x in t.values())
    assert branch_ends(t).count() == 0


def test_clashing_names_and_null_elements(spark):
    df = spark.createDataFrame(
        [(1, (5, (6,)), [(1, None), None], [["a"], []])], "k int, a struct<k:int,b:struct<k:int>>, xs array<struct<k:int,ys:array<int>>>, nested array<array<string>>"
    )
    t = shared_inline(df, ("k",), materialise=False)
    assert t["root"].columns[:3] == ["k", "doc_no", "a_k"]
    assert [tuple(r) for r in t["xs"].select("xs_pos", "k_").orderBy("xs_pos").collect()] == [(0, 1), (1, None)]
    inner = next(v for n, v in t.items() if n not in ("root", "xs", "xs_ys", "nested"))
    assert inner.count() == 1


def test_numbered(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c")], "k int, v string")
    got = [(r.k, r.v, r.doc_no) for r in numbered(df, ("k",)).collect()]
    assert sorted((str(k), v) for k, v, _ in got) == [("1", "a"), ("1", "b"), ("None", "c")]
    assert len({n for k, _, n in got if k == 1}) == 2


@pytest.mark.parametrize("n", [30_000])
def test_long_lists(spark, n):
    df = spark.range(1).select(F.col("id").alias("k"), F.sequence(F.lit(1), F.lit(n)).alias("xs"))
    t = shared_inline(df, ("k",), materialise=False)
    assert t["xs"].count() == n


def test_one_type_below_different_parents_shares_a_table(spark):
    person = "struct<name:string,mails:array<struct<box:string>>>"
    rows = spark.createDataFrame([("k", [("a", [("m1",), ("m2",)])], {"x": [("b", [("m3",)]), None]})], f"id string, authors array<{person}>, groups map<string,array<{person}>>")
    t = shared_inline(rows, ("id",))
    people = {(r.parent, r.authors_pos, r.name, r.n_authors_mails if "n_authors_mails" in r else None) for r in t["authors"].collect()}
    assert {(p, n) for p, _, n, _ in people} == {("root", "a"), ("groups", "b"), ("groups", None)}
    mails = t["authors_mails"].collect()
    assert {r.box for r in mails} == {"m1", "m2", "m3"}
    assert len([x for x in t if "mails" in x]) == 1
    assert all((r.authors_pos is None) != (r.groups_key is None) for r in mails)


def test_numbers_of_null_keys(spark):
    rows = spark.createDataFrame([(None, i % 7) for i in range(30)] + [("k", 1), ("k", 2), ("k", 2)], "id string, v int")
    got = {(r.id, r.v): r.doc_no for r in numbered(rows, ("id",)).collect()}
    assert sorted(got, key=str) == sorted([(None, i) for i in range(7)] + [("k", 1), ("k", 2)], key=str)
    assert len(set(got.values())) == len(got)
    assert got == {(r.id, r.v): r.doc_no for r in numbered(rows.repartition(3, "v"), ("id",)).collect()}
