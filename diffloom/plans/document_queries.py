"""Queries over annotation documents, changed lines and source files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.functions import scalars
from diffloom.operators import annotate as an
from diffloom.operators import authors as au
from diffloom.operators import chunks as ch
from diffloom.operators import classify as cl
from diffloom.operators import flow as fl
from diffloom.operators import gather as ga
from diffloom.operators import resample as rs
from diffloom.sources.annotation_json import normalised
from diffloom.sources.diffs import diff_lines
from diffloom.sources.lexing import with_tokens
from diffloom.session import table



def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ga.distinct_documents(table(spark, sf_dir, "annotations"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields])


def purpose_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ga.purpose_counter(_documents(spark, sf_dir))


def purpose_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ga.purpose_per_file(_documents(spark, sf_dir))


def lines_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ga.lines_stats(_documents(spark, sf_dir), rules={})


def lines_stats_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ga.lines_stats(_documents(spark, sf_dir))


def timeline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ga.timeline_counts(_documents(spark, sf_dir))


def timeline_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for every key that occurs: names of languages, types and metrics, of which a corpus has a few dozens."""
    return ga.timeline_wide(_documents(spark, sf_dir))


def added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ga.added_lines(_documents(spark, sf_dir))


def totals_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ga.totals_positive(_documents(spark, sf_dir))


def commit_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ga.commit_columns(_documents(spark, sf_dir))


def describe_per_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = ga.changed_lines(_documents(spark, sf_dir)).groupBy("bug_id", "patch_id").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("file_name").alias("n_files"))
    return _rounded(rs.describe(per, ["n_lines", "n_files"]))


def _kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ga.changed_lines(_documents(spark, sf_dir)).filter("line_type IS NOT NULL AND file_name IS NOT NULL AND file_name <> ''")
    return lines.groupBy("file_name", F.concat(F.lit("type."), "line_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def file_linetype_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kind_counts(spark, sf_dir)


def top_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kind_counts(spark, sf_dir).groupBy("file_name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "file_name").limit(10)


def author_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by author and kind; a patch gathered twice has the author first by name."""
    lines = ga.changed_lines(_documents(spark, sf_dir)).filter("line_type IS NOT NULL")
    authors = rs.plain(table(spark, sf_dir, "timeline")).groupBy("bug_id", "patch_id").agg(F.min("author_name").alias("author"))
    per_patch = lines.groupBy("bug_id", "patch_id", "line_type").agg(F.count(F.lit(1)).alias("n"))
    return per_patch.join(authors, ["bug_id", "patch_id"]).groupBy("author", "line_type").agg(F.sum("n").alias("n"))


def selected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the files that have the most lines, limited by a semi join."""
    counts = _kind_counts(spark, sf_dir)
    chosen = counts.groupBy("file_name").agg(F.sum("n").alias("t")).filter("t >= 10").select("file_name")
    return counts.join(chosen, "file_name", "left_semi")


def dir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.directory_rollup(_kind_counts(spark, sf_dir))


def split_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.split_directories(_kind_counts(spark, sf_dir))


def file_to_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.files_to_directories(fl.split_directories(_kind_counts(spark, sf_dir)))


def own_file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.own_files(fl.directory_rollup(_kind_counts(spark, sf_dir)))


def sankey_depth_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.limit_depth(file_to_dir(spark, sf_dir), 1)


def sankey_width_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.limit_width(file_to_dir(spark, sf_dir), 20)


def sankey_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.reduce_tail(fl.directory_rollup(_kind_counts(spark, sf_dir)))


def sankey_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.thin_out(own_file_nodes(spark, sf_dir), 0.02)


def sankey_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.labels(fl.process(_kind_counts(spark, sf_dir), share=0.01, most_files=200), "root")


def sankey_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow of the patches of the author who has the most, of equal ones the first by name; each patch counts once."""
    timeline = rs.plain(table(spark, sf_dir, "timeline")).filter("author_name IS NOT NULL").select("bug_id", "patch_id", "author_name").distinct()
    most = timeline.groupBy("author_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "author_name").limit(1)
    patches = timeline.join(F.broadcast(most), "author_name", "left_semi").select("bug_id", "patch_id").distinct()
    lines = ga.changed_lines(_documents(spark, sf_dir)).filter("line_type IS NOT NULL AND file_name <> ''").join(patches, ["bug_id", "patch_id"], "left_semi")
    counts = lines.groupBy("file_name", F.concat(F.lit("type."), "line_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return fl.process_patches(counts, 2, 5)


def sankey_mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.mermaid(fl.labels(fl.directory_rollup(_kind_counts(spark, sf_dir)), "root"))


def line_type_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.kind_totals(fl.directory_rollup(_kind_counts(spark, sf_dir)))


def dir_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = fl.directory_rollup(_kind_counts(spark, sf_dir))
    return edges.filter(~fl.kind_of_node(F.col("dst"))).select("src").intersect(edges.filter(fl.kind_of_node(F.col("dst"))).select("src"))


def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "source_files").filter("file_name IS NOT NULL AND file_name <> ''").select("file_name").distinct()
    return rows.select("file_name", F.explode(scalars.ancestors(F.col("file_name"))).alias("e")).select("file_name", "e.parent", "e.child")


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "source_files").filter("file_name IS NOT NULL AND file_name <> ''").select("file_name").distinct()
    p = F.col("file_name")
    return rows.select(p, scalars.depth(p).alias("depth"), scalars.shorten(p, 2).alias("short"), scalars.parent(p).alias("parent"), cl.basename(p).alias("base"), cl.suffix(p).alias("suffix"))


def classify_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "source_files").select("file_name").distinct()
    return cl.classify(rows)


def classify_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule and exception on a path of its own."""
    return cl.classify(spark.createDataFrame([(case[0],) for case in CASES], "file_name string"))


def classified_against_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cl.classify(table(spark, sf_dir, "source_files"))
    return rows.groupBy("purpose", "path_purpose", "type", "path_type").agg(F.count(F.lit(1)).alias("n"))


def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of the timeline without any source file."""
    t = table(spark, sf_dir, "timeline").select("bug_id", "patch_id").distinct()
    return t.join(table(spark, sf_dir, "source_files").select("bug_id", "patch_id"), ["bug_id", "patch_id"], "left_anti")


def without_dev_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ga.changed_files(_documents(spark, sf_dir)).filter("file_name <> '/dev/null'").groupBy("language", "type").agg(F.count(F.lit(1)).alias("n"))


def nunique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_files").groupBy("bug_id").agg(F.countDistinct("patch_id").alias("patches"), F.countDistinct("file_name").alias("files"), F.countDistinct("language").alias("languages"))


def line_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by what their tokens are: empty, blank, comment."""
    docs = _documents(spark, sf_dir)
    lines = ga.changed_files(docs).select("purpose", F.explode(F.concat(F.coalesce("plus", F.array()), F.coalesce("minus", F.array()))).alias("l"))
    tokens = F.coalesce(F.col("l.tokens"), F.array().cast("array<struct<idx:int,type:array<string>,text:string>>"))
    flags = lines.select("purpose", cl.line_is_empty(tokens).alias("is_empty"), cl.line_is_whitespace(tokens).alias("is_blank"), cl.line_is_comment(tokens).alias("is_comment"), cl.line_type(F.col("purpose"), F.col("l.tokens")).alias("decided"))
    return flags.groupBy("purpose", "is_empty", "is_blank", "is_comment", "decided").agg(F.count(F.lit(1)).alias("n"))


def line_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of both sides by the kind that each of the callbacks gives them."""
    sides = F.explode(F.array(F.struct(F.lit("+").alias("side"), F.col("plus").alias("lines")), F.struct(F.lit("-").alias("side"), F.col("minus").alias("lines"))))
    lines = ga.changed_files(_documents(spark, sf_dir)).select("purpose", sides.alias("s")).select("purpose", "s.side", F.explode("s.lines").alias("l"))
    tokens = F.coalesce(F.col("l.tokens"), F.array().cast("array<struct<idx:int,type:array<string>,text:string>>"))
    kinds = F.explode(F.array(*[F.struct(F.lit(name).alias("callback"), cl.line_type(F.col("purpose"), tokens, f(tokens)).alias("kind")) for name, f in cl.CALLBACKS.items()]))
    return lines.select("side", kinds.alias("k")).groupBy("side", "k.callback", "k.kind").agg(F.count(F.lit(1)).alias("n"))


def contribution_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each kind in all changed lines, added and removed."""
    lines = ga.changed_lines(_documents(spark, sf_dir)).filter("line_type IS NOT NULL").groupBy(F.col("line_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return _rounded(au.contribution_mix(lines))


def line_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "source_files").filter("content IS NOT NULL").select("language", F.explode(F.split("content", "\n")).alias("text"))
    return lines.groupBy("language", scalars.line_kind(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _hunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source lines as lines of hunks: comments as removed, calls as added ones, each file one hunk that starts at line 10."""
    files = table(spark, sf_dir, "source_files").filter("content IS NOT NULL")
    lines = files.select(F.col("bug_id").alias("patch_id"), F.col("file_id").alias("file_idx"), F.lit(0).alias("hunk_idx"), F.posexplode(F.split("content", "\n")).alias("line_idx", "value"))
    kind = F.when(F.col("value").rlike(r"^\s*(#|//|/\*)"), "-").when(F.col("value").rlike(r"\)[;:]?\r?$"), "+").otherwise(" ")
    return lines.select("patch_id", "file_idx", "hunk_idx", "line_idx", kind.alias("line_type"), F.lit(10).alias("source_start"), F.lit(20).alias("target_start"))


def chunk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.hunk_metrics(_hunk_lines(spark, sf_dir))


def hunk_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ch.hunk_line_numbers(_hunk_lines(spark, sf_dir))
    return lines.groupBy("file_idx").agg(F.max("source_line_no").alias("last_source"), F.max("target_line_no").alias("last_target"), F.sum("source_line_no").alias("sum_source"), F.sum("target_line_no").alias("sum_target"))


def hunk_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ch.line_coordinates(_hunk_lines(spark, sf_dir))
    return lines.groupBy("file_idx").agg(F.max("line_id").alias("n_lines"), F.max("in_hunk_chg_idx").alias("n_changed"), F.sum("in_hunk_chg_idx").alias("sum_changed"))


def file_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreads of files whose lines are cut into hunks of ten."""
    lines = ch.hunk_line_numbers(_hunk_lines(spark, sf_dir))
    cut = lines.withColumn("hunk_idx", (F.col("line_idx") / 10).cast("int"))
    return ch.file_spreads(cut).drop("patch_id")


def extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = _hunk_lines(spark, sf_dir).filter("line_type = '+'").select("file_idx", "line_idx")
    return ch.extents(added, ["file_idx"], "line_idx")


def front_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hunk_lines(spark, sf_dir).filter("line_type <> ' '").select("file_idx", "line_idx", "line_type")
    filled = ch.front_fill(rows, ["file_idx"], "line_idx", "line_type")
    return filled.groupBy("file_idx", "line_type").agg(F.count(F.lit(1)).alias("n"))


def hunk_line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines of each file beside the greatest changed place of each side."""
    lines = ga.changed_lines(_documents(spark, sf_dir))
    return lines.groupBy("bug_id", "patch_id", "file_name").agg(F.max("line_id").alias("last_id"), F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("side") == "+").alias("n_added"))


def line_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a project that a later patch changes again, as lines with a successor."""
    from pyspark.sql import Window

    files = table(spark, sf_dir, "source_files").select("bug_id", "file_name", "file_id", F.regexp_replace("bug_id", r"-\d+$", "").alias("project"))
    later = files.withColumn("previous", F.lead("file_id").over(Window.partitionBy("project", "file_name").orderBy("file_id")))
    return ch.survival(later, ["project"])


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return rows.select("doc_id", F.length(scalars.clean_text(F.col("text"))).alias("n"), F.md5(scalars.clean_text(F.col("text"))).alias("digest"))


def json_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "n"))
    return rows.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))


def format_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "annotation_files").groupBy(scalars.format_version(F.col("file_path")).alias("version")).agg(F.count(F.lit(1)).alias("n"))


def skipped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by directory, without names that hold ``...`` and with the name up to its first dot."""
    rows = table(spark, sf_dir, "annotation_files").filter("file_path NOT LIKE '%...%'")
    return rows.groupBy(F.split_part("file_path", F.lit("/"), F.lit(1)).alias("dataset"), F.length(F.substring_index(F.regexp_extract("file_path", r"([^/]*)$", 1), ".", 1)).alias("stem_length")).agg(F.count(F.lit(1)).alias("n"))


def normalise_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = normalised(table(spark, sf_dir, "annotation_files"))
    return docs.groupBy("format_version").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.map_keys("changes"))).alias("files"), F.count("commit_metadata.id").alias("with_id"))


def diff_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the patches among the documents of any source, parsed as unified diffs; a text without a diff gives no row."""
    patches = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("patch_id"), "text")
    lines = diff_lines(patches)
    return lines.groupBy("patch_id").agg(F.countDistinct("file_idx").alias("n_files"), F.countDistinct("file_idx", "hunk_idx").alias("n_hunks"), F.count_if(F.col("line_type") == "+").alias("n_added"), F.count_if(F.col("line_type") == "-").alias("n_removed"))


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("patch_id"), "text")


def patch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sizes, spreads and file counts of the diffs among the documents."""
    return an.patch_metrics(diff_lines(_patches(spark, sf_dir)))


def annotated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and length of every changed line of the diffs among the documents, by its tokens."""
    lines = an.annotated_lines(_patches(spark, sf_dir))
    size = F.aggregate("tokens", F.lit(0), lambda n, t: n + F.length(t["text"]))
    return lines.select("patch_id", "file_name", "side", "id", "hunk_idx", "in_hunk_chg_idx", "file_line_no", size.alias("n_chars"))


def annotated_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of annotation documents made of the diffs among the documents, by purpose, side and kind."""
    files = ga.changed_files(an.annotate(_patches(spark, sf_dir)).withColumn("bug_id", F.lit(None).cast("string")))
    both = F.explode(F.array(F.struct(F.lit("+").alias("side"), F.col("plus").alias("lines")), F.struct(F.lit("-").alias("side"), F.col("minus").alias("lines"))))
    return files.select("purpose", both.alias("s")).select("purpose", "s.side", F.explode("s.lines").alias("line")).groupBy("purpose", "side", "line.type").agg(F.count(F.lit(1)).alias("n"))


def lex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all files by what their tokens are, lexed; those of documentation are documentation without the lexer."""
    files = table(spark, sf_dir, "source_files")
    prose = F.col("purpose").eqNullSafe("documentation")
    lexed = with_tokens(files.filter(~prose), keys=("language", "purpose")).select("language", cl.line_type(F.col("purpose"), F.col("tokens")).alias("kind"), F.lit(1).alias("n"))
    # line ends, and what follows the last one
    plain = files.filter(prose).select("language", F.lit("documentation").alias("kind"), F.regexp_count("content", F.lit(r"[^\r\n]*+(?:\r\n|\r|\n)|[^\r\n]++")).alias("n")).filter("n > 0")
    return lexed.unionByName(plain).groupBy("language", "kind").agg(F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (
    purpose_counter, purpose_per_file, lines_stats, lines_stats_override, timeline_counts, timeline_wide, added_lines, totals_positive, commit_columns, describe_per_patch, file_linetype_counts, top_changed_files,
    author_line_counts, selected_files, dir_rollup, split_dirs, file_to_dir, own_file_nodes, sankey_depth_limit, sankey_width_limit, sankey_tail, sankey_thin, sankey_process, sankey_author, sankey_mermaid, line_type_totals, dir_intersect, ancestors,
    path_functions, classify_paths, classify_cases, classified_against_given, missing_keys, without_dev_null, nunique_keys, line_flags, line_callbacks, contribution_mix, line_kind, chunk_metrics, hunk_file_lines, hunk_coordinates, file_spreads, extents, front_fill,
    hunk_line_totals, line_survival, clean_text, json_explode, format_version, skipped_names, normalise_layouts, diff_documents, patch_metrics, annotated_lines, annotated_kinds, lex_lines,
)}

# Repeated documents of this data are equal, so any of them will do; which one is taken if they aren't is tested apart.
DOCS = """
docs AS (
    SELECT bug_id, patch_id, commit_metadata, changes, diff_metadata FROM
        (SELECT *, row_number() OVER (PARTITION BY bug_id, patch_id ORDER BY (changes IS NULL), length(changes::VARCHAR) DESC, (diff_metadata IS NULL), (commit_metadata IS NULL)) AS rn FROM annotations) WHERE rn = 1
), files AS (
    SELECT bug_id, patch_id, e.key AS file_name, e.value.language AS language, e.value.type AS type, e.value.purpose AS purpose, e.value."+" AS plus, e.value."-" AS minus
    FROM (SELECT bug_id, patch_id, unnest(map_entries(changes)) AS e FROM docs)
), lines AS (
    SELECT bug_id, patch_id, file_name, file_purpose, side, l.id AS line_id, l.type AS line_type, l.purpose AS line_purpose, l.tokens AS tokens FROM (
        SELECT bug_id, patch_id, file_name, purpose AS file_purpose, '+' AS side, unnest(plus) AS l FROM files UNION ALL SELECT bug_id, patch_id, file_name, purpose, '-', unnest(minus) FROM files)
)"""
TYPED = "typed AS (SELECT * REPLACE (CASE WHEN file_purpose = 'documentation' THEN 'documentation' ELSE line_type END AS line_type) FROM lines)"
KINDS = "kinds AS (SELECT file_name, 'type.' || line_type AS kind, count(*) AS n FROM lines WHERE line_type IS NOT NULL AND file_name <> '' GROUP BY 1, 2)"
PARENT = "CASE WHEN contains({0}, '/') THEN nullif(regexp_replace({0}, '/[^/]*$', ''), '') ELSE '.' END"


def _ancestors_sql(path: str) -> str:
    """A list of {parent, child} of a path."""
    parts = f"string_split(ltrim({path}, '/'), '/')"
    lead = f"(CASE WHEN {path} LIKE '/%' THEN '/' ELSE '' END)"
    top = f"(CASE WHEN {path} LIKE '/%' THEN '/' ELSE '.' END)"
    return f"list_transform(range(1, len({parts}) + 1), lambda i: {{'parent': CASE WHEN i = 1 THEN {top} ELSE {lead} || array_to_string({parts}[1:i - 1], '/') END, 'child': {lead} || array_to_string({parts}[1:i], '/')}})"


ROLLUP = f"""per_dir AS (SELECT {PARENT.format('file_name')} AS dir, kind, sum(n)::BIGINT AS n FROM kinds GROUP BY 1, 2), links AS (SELECT unnest({_ancestors_sql('dir')}) AS e, n FROM per_dir WHERE dir NOT IN ('.', '/')),
rollup_edges AS (SELECT src, dst, sum(n)::BIGINT AS n FROM (SELECT dir AS src, kind AS dst, n FROM per_dir UNION ALL SELECT e.parent, e.child, n FROM links) GROUP BY 1, 2)"""
BOTH = "both_dirs AS (SELECT src FROM {0} WHERE dst NOT LIKE 'type.%' INTERSECT SELECT src FROM {0} WHERE dst LIKE 'type.%')"
OWN = f"""{BOTH.format('rollup_edges')}, own AS (SELECT src, dst, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN dst LIKE 'type.%' AND src IN (FROM both_dirs) THEN '__' || src || '__' ELSE src END AS src, dst, n FROM rollup_edges UNION ALL SELECT src, '__' || src || '__', n FROM rollup_edges WHERE dst LIKE 'type.%' AND src IN (FROM both_dirs)) GROUP BY 1, 2)"""
DEPTH = "(CASE WHEN {0} IN ('', '.') THEN 0 ELSE len(string_split({0}, '/')) END)"


SPLIT = f"split_links AS (SELECT unnest({_ancestors_sql('file_name')}) AS e, n FROM kinds), split_edges AS (SELECT src, dst, sum(n)::BIGINT AS n FROM (SELECT e.parent AS src, e.child AS dst, n FROM split_links UNION ALL SELECT file_name, kind, n FROM kinds) GROUP BY 1, 2)"
HELD = f"""held AS (SELECT DISTINCT src AS node, {PARENT.format('src')} || '/*' AS holder FROM split_edges WHERE dst LIKE 'type.%'),
holders AS (SELECT coalesce(a.holder, src) AS src, coalesce(b.holder, dst) AS dst, sum(n)::BIGINT AS n FROM split_edges LEFT JOIN held a ON a.node = src LEFT JOIN held b ON b.node = dst GROUP BY 1, 2)"""


def _depth_sql(edges: str, most: int) -> str:
    parts = lambda c: f"(CASE WHEN {c} = '.' THEN 0 WHEN {c} LIKE '%/*' THEN len(string_split({c}, '/')) - 1 ELSE len(string_split({c}, '/')) END)"
    cut = lambda c: f"array_to_string(string_split({c}, '/')[1:{most}], '/') || '/**'"
    return f"""shallow AS (SELECT src, dst, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN {parts('src')} <= {most} THEN src ELSE {cut('src')} END AS src, dst, n FROM {edges} WHERE dst LIKE 'type.%'
        UNION ALL SELECT src, CASE WHEN {parts('dst')} <= {most} THEN dst ELSE {cut('dst')} END, n FROM {edges} WHERE dst NOT LIKE 'type.%' AND {parts('src')} <= {most}) GROUP BY 1, 2)"""


def _width_sql(edges: str, most: int) -> str:
    below = "({0} = d OR starts_with({0}, d || '/'))"
    return f"""slim AS (SELECT DISTINCT dst AS d FROM {edges} WHERE dst NOT LIKE 'type.%' AND n <= {most}),
    topmost AS (SELECT d FROM slim WHERE NOT EXISTS (SELECT 1 FROM slim o WHERE starts_with(slim.d, o.d || '/'))),
    wide AS (SELECT src, dst, sum(n)::BIGINT AS n FROM (
        SELECT src, dst, n FROM {edges} WHERE NOT EXISTS (SELECT 1 FROM topmost WHERE {below.format('dst')} OR {below.format('src')})
        UNION ALL SELECT {PARENT.format('d')}, {PARENT.format('d')} || '/**', n FROM {edges} JOIN topmost ON {below.format('src')} WHERE dst LIKE 'type.%'
        UNION ALL SELECT {PARENT.format('d')} || '/**', dst, n FROM {edges} JOIN topmost ON {below.format('src')} WHERE dst LIKE 'type.%') GROUP BY 1, 2)"""


def _tail_sql(edges: str) -> str:
    level = "len({0}) - len(replace({0}, '/', ''))"
    return f"""deep AS (SELECT max({level.format('src')}) AS m FROM {edges}), final AS (SELECT bool_and(dst LIKE 'type.%') AS ok FROM {edges}, deep WHERE {level.format('src')} = m),
    last_dirs AS (SELECT DISTINCT dst AS node, src AS into_dir FROM {edges}, deep, final WHERE ok AND m > 0 AND dst NOT LIKE 'type.%' AND {level.format('dst')} = m),
    tail AS (SELECT src, dst, sum(n)::BIGINT AS n FROM (SELECT coalesce(into_dir, src) AS src, dst, n FROM {edges} LEFT JOIN last_dirs ON node = src WHERE dst NOT IN (SELECT node FROM last_dirs)) GROUP BY 1, 2)"""


def _thin_sql(edges: str, share: float) -> str:
    return f"""total AS (SELECT sum(n) * {share} AS least FROM {edges} WHERE src = '.'),
    slight AS (SELECT DISTINCT e.dst AS node, e.src AS into_dir FROM {edges} e, total WHERE e.src <> '.' AND e.dst <> '__' || e.src || '__' AND EXISTS (SELECT 1 FROM {edges} o WHERE o.src = e.dst AND o.n < least)
        AND NOT EXISTS (SELECT 1 FROM {edges} o WHERE o.src = e.dst AND o.dst NOT LIKE 'type.%') AND (SELECT sum(n) FROM {edges} o WHERE o.src = e.dst) < least),
    thin AS (SELECT src, dst, sum(n)::BIGINT AS n FROM (
        SELECT src, dst, n FROM {edges} WHERE src NOT IN (SELECT node FROM slight) AND dst NOT IN (SELECT node FROM slight)
        UNION ALL SELECT into_dir, dst, n FROM {edges} JOIN slight ON src = node) GROUP BY 1, 2)"""


def _label_sql(c: str) -> str:
    return f"regexp_replace(CASE WHEN {c} = '.' THEN '{{root}}' ELSE {c} END, '^type[.](.*)$', '[\\1]')"


#: Paths with the language, type and purpose that the rules must give, each a rule or an exception of its own.
CASES = [
    ("src/main.cpp", "C++", "programming", "programming"), ("INSTALL", "Text", "prose", "documentation"), ("ChangeLog", "Text", "prose", "documentation"), ("README.md", "Markdown", "prose", "documentation"), ("docs/index.rst", "reStructuredText", "prose", "documentation"),
    ("tests/test_cli.py", "Python", "programming", "test"), ("src/Contest.java", "Java", "programming", "test"), ("requirements.txt", "Pip Requirements", "data", "project"), (".gitignore", "Ignore List", "data", "project"), ("Makefile", "Makefile", "programming", "project"),
    ("pyproject.toml", "TOML", "data", "project"), (".github/workflows/ci.yml", "YAML", "data", "data"), (".devcontainer/Dockerfile", "Dockerfile", "programming", "project"), (".unknownprojectrc", "unknown", "other", "other"), ("rust/kernel/condvar.rs", "Rust", "programming", "programming"),
    ("conanfile.py", "Python", "programming", "project"), ("x/info/index.json", "JSON", "data", "project"), ("index.json", "JSON", "data", "data"), ("a/b.cabal", "unknown", "other", "project"), ("MANIFEST.in", "Text", "prose", "project"), ("setup.py", "Python", "programming", "programming"), ("tox.ini", "INI", "data", "data"),
    ("Dockerfile.dev", "unknown", "other", "other"), ("app/view.tsx", "TSX", "programming", "programming"), ("x.S", "unknown", "other", "other"), ("rpm/pkg.spec", "RPM Spec", "data", "data"), ("lib/pkg.spec", "Python", "programming", "programming"), ("man/tool.1", "Roff", "markup", "markup"), ("docs/spark.1", "Text", "prose", "documentation"),
    ("scripts/kconfig/zconf.l", "Lex", "programming", "programming"), ("lex/scan.l", "Roff", "markup", "markup"), ("m4/ax.m4", "M4", "programming", "programming"), ("configure.ac", "M4Sugar", "programming", "programming"), ("build.cake", "C#", "programming", "project"), ("page.html", "HTML", "markup", "markup"), ("page.htm", "HTML", "markup", "markup"),
    ("t/basic.t", "Perl", "programming", "programming"), ("a/docs", "unknown", "other", "documentation"), ("a/docs/x.bin", "unknown", "other", "other"), ("/dev/null", "/dev/null", "other", "other"), ("README.MD", "Markdown", "prose", "documentation"), ("x.asm", "ASM", "other", "other"), ("go.mod", "Text", "prose", "project"), ("Makefile1", "unknown", "other", "other"),
]
_BASE, _SUFFIX = "regexp_extract(file_name, '([^/]*)$', 1)", "regexp_extract(regexp_extract(file_name, '([^/]*)$', 1), '^.+([.][^.]+)$', 1)"
#: What the files of the tables are: only a few names and suffixes occur in them.
CLASSIFIED = f"""classified AS (SELECT *, CASE WHEN file_name IS NULL THEN NULL WHEN contains(lower(file_name), 'test') THEN 'test' WHEN {_BASE} IN ('Makefile', 'package.json', 'setup.cfg', 'pyproject.toml', 'requirements.txt', 'go.mod') THEN 'project'
    WHEN path_type = 'prose' THEN 'documentation' ELSE path_type END AS path_purpose FROM (SELECT *, CASE WHEN file_name IS NULL THEN NULL WHEN path_language IN ('YAML', 'JSON') THEN 'data' WHEN path_language = 'Markdown' THEN 'prose' WHEN path_language IN ('unknown', '/dev/null') THEN 'other' ELSE 'programming' END AS path_type
    FROM (SELECT *, CASE WHEN file_name IS NULL THEN NULL WHEN {_BASE} = 'Makefile' THEN 'Makefile' WHEN file_name = '/dev/null' THEN file_name ELSE CASE {_SUFFIX} WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.c' THEN 'C' WHEN '.java' THEN 'Java' WHEN '.go' THEN 'Go' WHEN '.md' THEN 'Markdown' WHEN '.yml' THEN 'YAML' WHEN '.json' THEN 'JSON' ELSE 'unknown' END END AS path_language FROM {{0}})))"""


def _classify_sql() -> dict[str, str]:
    rows = ", ".join("(" + ", ".join(f"'{x}'" for x in case) + ")" for case in CASES)
    return {
        "classify_paths": f"WITH {CLASSIFIED.format('(SELECT DISTINCT file_name FROM source_files)')} SELECT file_name, path_language, path_type, path_purpose FROM classified",
        "classified_against_given": f"WITH {CLASSIFIED.format('source_files')} SELECT purpose, path_purpose, type, path_type, count(*) AS n FROM classified GROUP BY ALL",
        "classify_cases": f"SELECT * FROM (VALUES {rows}) t(file_name, path_language, path_type, path_purpose)",
    }


def _stats_sql(lines: str) -> str:
    return f"""one AS (SELECT bug_id, patch_id, file_name, side, unnest(['count', 'type.' || line_type, 'purpose.' || line_purpose]) AS key FROM {lines}), per_side AS (SELECT bug_id, patch_id, file_name, side, key, count(*) AS n FROM one WHERE key IS NOT NULL GROUP BY ALL)
    SELECT * FROM per_side UNION ALL SELECT bug_id, patch_id, file_name, '+/-', key, sum(n)::BIGINT FROM per_side WHERE key <> 'count' GROUP BY 1, 2, 3, 5"""


COUNTS = f"""{TYPED}, keyed AS (
    SELECT bug_id, patch_id, unnest(['file_names', 'language:' || language, 'type:' || type, 'purpose:' || purpose]) AS key, 1 AS n FROM files
    UNION ALL SELECT bug_id, patch_id, unnest([side || ':count', side || ':type.' || line_type, side || ':purpose.' || line_purpose]), 1 FROM typed
    UNION ALL SELECT bug_id, patch_id, 'diff.' || e.key, e.value FROM (SELECT bug_id, patch_id, unnest(map_entries(diff_metadata)) AS e FROM docs)
), counts AS (SELECT bug_id, patch_id, key, sum(n)::BIGINT AS n FROM keyed WHERE key IS NOT NULL GROUP BY ALL HAVING sum(n) > 0)"""
COMMIT = ", ".join(f"commit_metadata.{w}.{p} AS {w}_{p}" for w in ("author", "committer") for p in ("timestamp", "tz_info", "name", "email")) + ", len(commit_metadata.parents)::INT AS n_parents"
_COMMENT = "(coalesce(t.type[1] = 'Comment', false) OR coalesce(t.type[1] = 'Literal' AND t.type[2] = 'String' AND t.type[3] = 'Doc', false))"
_BLANK = r"(coalesce(t.type[1] = 'Text' AND t.type[2] = 'Whitespace', false) OR coalesce(trim(regexp_replace(t.text, '\s+', '', 'g')) = '', false))"
TOKENS = f"""flagged AS (SELECT file_purpose, side, len(tk) = 1 AND coalesce(tk[1].text IN (chr(10), chr(13) || chr(10)), false) AS is_empty, len(list_filter(tk, lambda t: NOT {_BLANK})) = 0 AS is_blank,
    len(list_filter(tk, lambda t: {_COMMENT})) > 0 AND len(list_filter(tk, lambda t: NOT ({_COMMENT} OR {_BLANK}))) = 0 AS is_comment FROM (SELECT *, coalesce(tokens, []) AS tk FROM lines))"""
HUNKS = r"""
raw AS (SELECT bug_id AS patch_id, file_id AS file_idx, unnest(string_split(content, chr(10))) AS value, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_idx FROM source_files WHERE content IS NOT NULL),
hl AS (SELECT patch_id, file_idx, 0 AS hunk_idx, line_idx, CASE WHEN regexp_matches(value, '^\s*(#|//|/\*)') THEN '-' WHEN regexp_matches(value, '\)[;:]?\r?$') THEN '+' ELSE ' ' END AS line_type FROM raw)"""
NUMBERED = """nums AS (SELECT *, CASE WHEN line_type IN ('-', ' ') THEN 10 + coalesce(sum((line_type IN ('-', ' '))::INT) OVER w, 0) END AS s, CASE WHEN line_type IN ('+', ' ') THEN 20 + coalesce(sum((line_type IN ('+', ' '))::INT) OVER w, 0) END AS t
    FROM hl WINDOW w AS (PARTITION BY patch_id, file_idx ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""

DIFFS = r"""
dl AS (SELECT doc_id::VARCHAR AS patch_id, unnest(string_split(text, chr(10))) AS v, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents WHERE contains(text, 'diff --git ')),
dm AS (SELECT *, sum(starts_with(v, 'diff --git ')::INT) OVER w AS fno, sum(regexp_matches(v, '^@@ -[0-9]+(,[0-9]+)? [+][0-9]+(,[0-9]+)? @@')::INT) OVER w AS hno, regexp_matches(v, '^@@ -[0-9]+(,[0-9]+)? [+][0-9]+(,[0-9]+)? @@') AS h FROM dl WINDOW w AS (PARTITION BY patch_id ORDER BY i)),
names AS (SELECT patch_id, fno, regexp_extract(v, '^diff --git a/(.*) b/.*$', 1) AS source_file, regexp_extract(v, '^diff --git a/.* b/(.*)$', 1) AS target_file FROM dm WHERE starts_with(v, 'diff --git ')),
heads AS (SELECT patch_id, fno, hno, row_number() OVER (PARTITION BY patch_id, fno ORDER BY hno) - 1 AS hunk_idx, regexp_extract(v, '^@@ -([0-9]+)', 1)::INT AS sa, coalesce(nullif(regexp_extract(v, '^@@ -[0-9]+,([0-9]+)', 1), ''), '1')::INT AS la,
    regexp_extract(v, '[+]([0-9]+)', 1)::INT AS sb, coalesce(nullif(regexp_extract(v, '[+][0-9]+,([0-9]+)', 1), ''), '1')::INT AS lb FROM dm WHERE h AND fno > 0),
body AS (SELECT dm.*, hunk_idx, sa, la, sb, lb, CASE WHEN v = '' OR v = chr(13) THEN ' ' ELSE v[1] END AS sign FROM dm JOIN heads USING (patch_id, fno, hno) WHERE NOT h),
seen AS (SELECT *, coalesce(sum((sign IN ('-', ' '))::INT) OVER w, 0) AS a, coalesce(sum((sign IN ('+', ' '))::INT) OVER w, 0) AS b FROM body WINDOW w AS (PARTITION BY patch_id, fno, hno ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fit AS (SELECT *, bool_and(sign IN ('+', '-', ' ') AND (a < la OR b < lb) AND NOT (v = '' AND i = n)) OVER (PARTITION BY patch_id, fno, hno ORDER BY i) AS ok FROM seen),
rows_ AS (SELECT patch_id, fno, hunk_idx, sa, sb, sign, v, row_number() OVER w - 1 AS id, CASE WHEN sign <> '+' THEN (sa + a)::INT END AS s, CASE WHEN sign <> '-' THEN (sb + b)::INT END AS t, sign <> ' ' AS c FROM fit WHERE ok WINDOW w AS (PARTITION BY patch_id, fno, hunk_idx ORDER BY i))"""
RUNS = """
st AS (SELECT *, c AND NOT coalesce(lag(c) OVER w, false) AS first_of FROM rows_ WINDOW w AS (PARTITION BY patch_id, fno, hunk_idx ORDER BY id)),
gn AS (SELECT *, sum(first_of::INT) OVER (PARTITION BY patch_id, fno, hunk_idx ORDER BY id) AS g FROM st),
g0 AS (SELECT patch_id, fno, hunk_idx, g, count(*) FILTER (c AND sign = '-') AS k, count(*) FILTER (c AND sign = '+') AS m, count(*) FILTER (NOT c) AS after, min_by(sign, id) FILTER (c) AS lead_sign FROM gn WHERE g > 0 GROUP BY 1, 2, 3, 4),
gr AS (SELECT *, g = max(g) OVER (PARTITION BY patch_id, fno, hunk_idx) AS is_last FROM g0),
hm AS (SELECT patch_id, fno, hunk_idx, 1 AS n_hunks, sum(least(k, m)) AS n_mod, sum(k - least(k, m)) AS n_rem, sum(m - least(k, m)) AS n_add, sum(greatest(k, m)) AS patch_size, sum(m) AS n_lines_added, sum(k) AS n_lines_removed, count(*) AS n_groups,
    coalesce(sum(after) FILTER (NOT is_last), 0) AS spread_inner, max(lead_sign) FILTER (is_last) AS last_sign, max(lead_sign) FILTER (g = 1) AS first_sign FROM gr GROUP BY 1, 2, 3),
he AS (SELECT patch_id, fno, hunk_idx, count(*) AS n_lines_all, min(s) AS s0, max(s) AS s1, min(t) AS t0, max(t) AS t1, min(s) FILTER (c) AS cs0, max(s) FILTER (c) AS cs1, min(t) FILTER (c) AS ct0, max(t) FILTER (c) AS ct1 FROM rows_ GROUP BY 1, 2, 3),
hh AS (SELECT *, lag(s1) OVER w AS ps1, lag(t1) OVER w AS pt1, lag(last_sign) OVER w AS before_sign, CASE lag(last_sign) OVER w WHEN '-' THEN lag(cs1) OVER w WHEN '+' THEN lag(ct1) OVER w END AS old_last FROM he LEFT JOIN hm USING (patch_id, fno, hunk_idx) WINDOW w AS (PARTITION BY patch_id, fno ORDER BY hunk_idx)),
fs AS (SELECT patch_id, fno, max(s1) - min(s0) AS hunk_span_src, max(t1) - min(t0) AS hunk_span_dst, sum(s0 - ps1) AS hunk_spread_src, sum(t0 - pt1) AS hunk_spread_dst, sum(coalesce(spread_inner, 0)) + sum(coalesce(CASE WHEN before_sign = first_sign THEN CASE first_sign WHEN '-' THEN cs0 ELSE ct0 END - old_last - 1
    ELSE CASE before_sign WHEN '-' THEN s0 ELSE t0 END - old_last - 1 + CASE first_sign WHEN '-' THEN cs0 - s0 ELSE ct0 - t0 END END, 0)) AS groups_spread FROM hh GROUP BY 1, 2)"""
_SIZES = ("n_hunks", "n_mod", "n_rem", "n_add", "patch_size", "n_lines_added", "n_lines_removed", "n_lines_all", "n_groups", "spread_inner")

SQL = {
    "patch_metrics": f"""WITH {DIFFS}, {RUNS}, fc AS (SELECT names.patch_id, count(*) AS n_files, count(*) FILTER (NOT EXISTS (SELECT 1 FROM rows_ r WHERE r.patch_id = names.patch_id AND r.fno = names.fno)) AS n_binary_files, count(*) FILTER (source_file <> target_file) AS n_file_renames FROM names GROUP BY 1),
        z AS (SELECT patch_id, {', '.join(f'sum({c}) AS {c}' for c in _SIZES)} FROM hh WHERE n_groups IS NOT NULL GROUP BY 1), sp AS (SELECT patch_id, {', '.join(f'sum(greatest(coalesce({c}, 0), 0)) AS {c}' for c in an.SPREADS)} FROM fs GROUP BY 1)
        SELECT patch_id, n_files, n_binary_files, 0::BIGINT AS n_submodules, 0::BIGINT AS n_added_files, 0::BIGINT AS n_removed_files, n_file_renames, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in (*_SIZES, *an.SPREADS))} FROM fc LEFT JOIN z USING (patch_id) LEFT JOIN sp USING (patch_id)""",
    "annotated_lines": f"""WITH {DIFFS} SELECT patch_id, CASE sign WHEN '+' THEN target_file ELSE source_file END AS file_name, sign AS side, id::INT AS id, hunk_idx::INT AS hunk_idx,
        CASE WHEN regexp_matches(lower(source_file), '[.](md|rst|txt)$') AND NOT contains(lower(source_file), 'test') THEN (sum(c::INT) OVER h)::INT - 1 ELSE row_number() OVER (PARTITION BY patch_id, fno, hunk_idx, sign ORDER BY id)::INT - 1 END AS in_hunk_chg_idx, CASE sign WHEN '+' THEN t ELSE s END AS file_line_no, length(v)::INT AS n_chars
        FROM rows_ JOIN names USING (patch_id, fno) WHERE c WINDOW h AS (PARTITION BY patch_id, fno, hunk_idx ORDER BY id)""",
    "purpose_counter": f"WITH {DOCS} SELECT 'files' AS kind, purpose, count(*) AS n FROM files WHERE purpose IS NOT NULL GROUP BY 2 UNION ALL SELECT CASE side WHEN '+' THEN 'added' ELSE 'removed' END, line_purpose, count(*) FROM lines WHERE line_purpose IS NOT NULL GROUP BY 1, 2",
    "purpose_per_file": f"WITH {DOCS} SELECT bug_id, patch_id, file_name, purpose FROM files",
    "lines_stats": f"WITH {DOCS}, {_stats_sql('lines')}", "lines_stats_override": f"WITH {DOCS}, {TYPED}, {_stats_sql('typed')}",
    "timeline_counts": f"WITH {DOCS}, {COUNTS} SELECT * FROM counts",
    "timeline_wide": f"""WITH {DOCS}, {COUNTS}, named AS (SELECT bug_id, patch_id, trim(regexp_replace(replace(replace(key, '+:', 'p_'), '-:', 'm_'), '[^a-zA-Z0-9]', '_', 'g'), '_') AS name, n FROM counts)
        SELECT c.*, COLUMNS(p.* EXCLUDE (bug_id, patch_id)) FROM (SELECT bug_id, patch_id, {COMMIT} FROM docs) c LEFT JOIN (PIVOT named ON name USING sum(n)::BIGINT GROUP BY bug_id, patch_id) p ON c.bug_id = p.bug_id AND c.patch_id = p.patch_id""",
    "added_lines": f"WITH {DOCS} SELECT bug_id, patch_id, file_name, line_id, line_type, line_purpose FROM lines WHERE side = '+'",
    "totals_positive": f"WITH {DOCS} SELECT bug_id, e.key, sum(e.value)::BIGINT AS n FROM (SELECT bug_id, unnest(map_entries(diff_metadata)) AS e FROM docs) GROUP BY 1, 2 HAVING sum(e.value) > 0",
    "commit_columns": f"WITH {DOCS} SELECT bug_id, patch_id, {COMMIT} FROM docs",
    "describe_per_patch": f"WITH {DOCS}, per AS (SELECT bug_id, patch_id, count(*) AS n_lines, count(DISTINCT file_name) AS n_files FROM lines GROUP BY 1, 2) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c})::DOUBLE AS max FROM per" for c in ("n_lines", "n_files")),
    "file_linetype_counts": f"WITH {DOCS}, {KINDS} SELECT * FROM kinds", "top_changed_files": f"WITH {DOCS}, {KINDS} SELECT file_name, sum(n)::BIGINT AS n FROM kinds GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "author_line_counts": f"WITH {DOCS}, a AS (SELECT bug_id, patch_id, min(\"author.name\") AS author FROM timeline GROUP BY 1, 2) SELECT author, line_type, count(*) AS n FROM lines JOIN a USING (bug_id, patch_id) WHERE line_type IS NOT NULL GROUP BY 1, 2",
    "selected_files": f"WITH {DOCS}, {KINDS} SELECT * FROM kinds WHERE file_name IN (SELECT file_name FROM kinds GROUP BY 1 HAVING sum(n) >= 10)",
    "dir_rollup": f"WITH {DOCS}, {KINDS}, {ROLLUP} SELECT * FROM rollup_edges",
    "split_dirs": f"WITH {DOCS}, {KINDS}, {SPLIT} SELECT * FROM split_edges",
    "file_to_dir": f"WITH {DOCS}, {KINDS}, {SPLIT}, {HELD} SELECT * FROM holders",
    "own_file_nodes": f"WITH {DOCS}, {KINDS}, {ROLLUP}, {OWN} SELECT * FROM own",
    "sankey_depth_limit": f"WITH {DOCS}, {KINDS}, {SPLIT}, {HELD}, {_depth_sql('holders', 1)} SELECT * FROM shallow",
    "sankey_width_limit": f"WITH {DOCS}, {KINDS}, {SPLIT}, {HELD}, {_width_sql('holders', 20)} SELECT * FROM wide",
    "sankey_tail": f"WITH {DOCS}, {KINDS}, {ROLLUP}, {_tail_sql('rollup_edges')} SELECT * FROM tail",
    "sankey_thin": f"WITH {DOCS}, {KINDS}, {ROLLUP}, {OWN}, {_thin_sql('own', 0.02)} SELECT * FROM thin",
    "sankey_process": f"WITH {DOCS}, {KINDS.replace('kinds AS', 'all_kinds AS')}, kinds AS (SELECT * FROM all_kinds WHERE file_name IN (SELECT file_name FROM all_kinds GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 200)), {ROLLUP}, {OWN}, {_thin_sql('own', 0.01)} SELECT {_label_sql('src')} AS src, {_label_sql('dst')} AS dst, n FROM thin",
    "sankey_author": f"""WITH {DOCS}, a AS (SELECT DISTINCT bug_id, patch_id, "author.name" AS author FROM timeline WHERE "author.name" IS NOT NULL), best AS (SELECT author FROM a GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
        kinds AS (SELECT file_name, 'type.' || line_type AS kind, count(*) AS n FROM lines WHERE line_type IS NOT NULL AND file_name <> '' AND (bug_id, patch_id) IN (SELECT (bug_id, patch_id) FROM a SEMI JOIN best USING (author)) GROUP BY 1, 2),
        {SPLIT}, {HELD}, {_depth_sql('holders', 2)}, {_width_sql('shallow', 5)} SELECT * FROM wide""",
    "sankey_mermaid": f"WITH {DOCS}, {KINDS}, {ROLLUP} SELECT {_label_sql('src')} || ',' || {_label_sql('dst')} || ',' || n::VARCHAR AS line FROM rollup_edges",
    "line_type_totals": f"WITH {DOCS}, {KINDS}, {ROLLUP} SELECT dst, sum(n)::BIGINT AS n FROM rollup_edges WHERE dst LIKE 'type.%' GROUP BY 1",
    "dir_intersect": f"WITH {DOCS}, {KINDS}, {ROLLUP}, {BOTH.format('rollup_edges')} SELECT src FROM both_dirs",
    "ancestors": f"SELECT file_name, e.parent AS parent, e.child AS child FROM (SELECT file_name, unnest({_ancestors_sql('file_name')}) AS e FROM (SELECT DISTINCT file_name FROM source_files WHERE file_name <> ''))",
    "path_functions": f"SELECT file_name, {DEPTH.format('file_name')}::INT AS depth, CASE WHEN {DEPTH.format('file_name')} > 2 THEN array_to_string(string_split(file_name, '/')[1:2], '/') || '/**' ELSE file_name END AS short, {PARENT.format('file_name')} AS parent, regexp_extract(file_name, '([^/]*)$', 1) AS base, regexp_extract(regexp_extract(file_name, '([^/]*)$', 1), '^.+([.][^.]+)$', 1) AS suffix FROM (SELECT DISTINCT file_name FROM source_files WHERE file_name <> '')",
    **_classify_sql(),
    "missing_keys": "SELECT DISTINCT bug_id, patch_id FROM timeline t ANTI JOIN source_files s USING (bug_id, patch_id)",
    "without_dev_null": f"WITH {DOCS} SELECT language, type, count(*) AS n FROM files WHERE file_name <> '/dev/null' GROUP BY ALL",
    "nunique_keys": "SELECT bug_id, count(DISTINCT patch_id) AS patches, count(DISTINCT file_name) AS files, count(DISTINCT language) AS languages FROM source_files GROUP BY 1",
    "line_flags": f"WITH {DOCS}, {TOKENS} SELECT file_purpose AS purpose, is_empty, is_blank, is_comment, CASE WHEN file_purpose = 'documentation' THEN 'documentation' WHEN is_comment THEN 'documentation' WHEN file_purpose = 'programming' THEN 'code' ELSE file_purpose END AS decided, count(*) AS n FROM flagged GROUP BY ALL",
    "line_callbacks": f"""WITH {DOCS}, {TOKENS}, k AS (SELECT *, unnest(['empty', 'whitespace', 'bugfix']) AS callback FROM flagged)
        SELECT side, callback, CASE WHEN file_purpose = 'documentation' THEN 'documentation' WHEN callback = 'empty' AND is_empty THEN 'empty' WHEN callback = 'whitespace' AND is_blank THEN 'whitespace' WHEN callback = 'bugfix' AND NOT is_blank AND NOT is_comment THEN 'bug(fix)'
            WHEN is_comment THEN 'documentation' WHEN file_purpose = 'programming' THEN 'code' ELSE file_purpose END AS kind, count(*) AS n FROM k GROUP BY 1, 2, 3""",
    "contribution_mix": f"""WITH {DOCS}, m AS (SELECT CASE WHEN line_type IN ({', '.join(f"'{k}'" for k in au.KINDS)}) THEN line_type ELSE 'other' END AS kind, count(*) AS n FROM lines WHERE line_type IS NOT NULL GROUP BY 1)
        SELECT kind, n, round(n * 100.0 / sum(n) OVER (), 6)::DOUBLE AS perc FROM m""",
    "line_kind": r"SELECT language, CASE WHEN length(regexp_replace(text, '[\r\n]+$', '')) = 0 THEN 'empty' WHEN regexp_replace(text, '\s+', '', 'g') = '' THEN 'whitespace' WHEN regexp_matches(text, '^\s*(#i[^n]|#in[^c]|#[^i]|#$|//|/\*|\*|--|;)') THEN 'comment' ELSE 'code' END AS kind, count(*) AS n FROM (SELECT language, unnest(string_split(content, chr(10))) AS text FROM source_files WHERE content IS NOT NULL) GROUP BY ALL",
    "chunk_metrics": f"""WITH {HUNKS}, marked AS (SELECT *, line_type <> ' ' AS c, line_type <> ' ' AND NOT coalesce(lag(line_type <> ' ') OVER w, false) AS st FROM hl WINDOW w AS (PARTITION BY patch_id, file_idx, hunk_idx ORDER BY line_idx)),
        g AS (SELECT *, sum(st::INT) OVER (PARTITION BY patch_id, file_idx, hunk_idx ORDER BY line_idx) AS no FROM marked), gr AS (SELECT patch_id, file_idx, hunk_idx, no, count(*) FILTER (c AND line_type = '-') AS k, count(*) FILTER (c AND line_type = '+') AS m, count(*) FILTER (NOT c) AS after FROM g WHERE no > 0 GROUP BY ALL),
        last AS (SELECT *, no = max(no) OVER (PARTITION BY patch_id, file_idx, hunk_idx) AS is_last FROM gr), every AS (SELECT patch_id, file_idx, hunk_idx, count(*) AS n_lines_all FROM hl GROUP BY ALL)
        SELECT patch_id, file_idx, hunk_idx, sum(least(k, m))::BIGINT AS n_mod, sum(k - least(k, m))::BIGINT AS n_rem, sum(m - least(k, m))::BIGINT AS n_add, count(*) AS n_groups, coalesce(sum(after) FILTER (NOT is_last), 0)::BIGINT AS spread_inner, sum(m)::BIGINT AS n_lines_added, sum(k)::BIGINT AS n_lines_removed, any_value(n_lines_all) AS n_lines_all, sum(greatest(k, m))::BIGINT AS patch_size
        FROM last JOIN every USING (patch_id, file_idx, hunk_idx) GROUP BY 1, 2, 3""",
    "hunk_file_lines": f"WITH {HUNKS}, {NUMBERED} SELECT file_idx, max(s)::BIGINT AS last_source, max(t)::BIGINT AS last_target, sum(s)::BIGINT AS sum_source, sum(t)::BIGINT AS sum_target FROM nums GROUP BY 1",
    "hunk_coordinates": f"WITH {HUNKS}, x AS (SELECT *, row_number() OVER w AS i, CASE WHEN line_type <> ' ' THEN sum((line_type <> ' ')::INT) OVER w END AS c FROM hl WINDOW w AS (PARTITION BY patch_id, file_idx ORDER BY line_idx)) SELECT file_idx, max(i)::INT AS n_lines, max(c)::BIGINT AS n_changed, sum(c)::BIGINT AS sum_changed FROM x GROUP BY 1",
    "file_spreads": f"""WITH {HUNKS}, {NUMBERED}, rows_ AS (SELECT patch_id, file_idx AS fno, line_idx // 10 AS hunk_idx, line_idx AS id, line_type AS sign, s::INT AS s, t::INT AS t, line_type <> ' ' AS c FROM nums), {RUNS}, nh AS (SELECT patch_id, fno, count(*) AS n_hunks FROM he GROUP BY 1, 2)
        SELECT fno AS file_idx, n_hunks, hunk_span_src::BIGINT AS hunk_span_src, hunk_span_dst::BIGINT AS hunk_span_dst, coalesce(hunk_spread_src, 0)::BIGINT AS hunk_spread_src, coalesce(hunk_spread_dst, 0)::BIGINT AS hunk_spread_dst, groups_spread::BIGINT AS groups_spread FROM fs JOIN nh USING (patch_id, fno)""",
    "extents": f"WITH {HUNKS}, r AS (SELECT file_idx, line_idx, line_idx - row_number() OVER (PARTITION BY file_idx ORDER BY line_idx) AS run FROM hl WHERE line_type = '+') SELECT file_idx, min(line_idx)::INT AS first, max(line_idx)::INT AS last FROM r GROUP BY file_idx, run",
    "front_fill": f"""WITH {HUNKS}, k AS (SELECT file_idx, line_idx, line_type FROM hl WHERE line_type <> ' '), e AS (SELECT file_idx, unnest(generate_series(min(line_idx), max(line_idx))) AS line_idx FROM k GROUP BY file_idx),
        f AS (SELECT e.file_idx, last_value(line_type IGNORE NULLS) OVER (PARTITION BY e.file_idx ORDER BY e.line_idx) AS line_type FROM e LEFT JOIN k ON e.file_idx = k.file_idx AND e.line_idx = k.line_idx) SELECT file_idx, line_type, count(*) AS n FROM f GROUP BY 1, 2""",
    "hunk_line_totals": f"WITH {DOCS} SELECT bug_id, patch_id, file_name, max(line_id) AS last_id, count(*) AS n_lines, count(*) FILTER (side = '+') AS n_added FROM lines GROUP BY 1, 2, 3",
    "line_survival": r"WITH f AS (SELECT regexp_replace(bug_id, '-[0-9]+$', '') AS project, file_name, file_id FROM source_files), l AS (SELECT *, lead(file_id) OVER (PARTITION BY project, file_name ORDER BY file_id) AS previous FROM f) SELECT project, count(*) FILTER (previous IS NULL) AS survived, count(*) AS total FROM l GROUP BY 1",
    "clean_text": r"WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[*/\\\t\n]', '', 'g'), '\s+', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(t)::INT AS n, md5(t) AS digest FROM c",
    "json_explode": "WITH e AS (SELECT event_type, unnest(json_keys(props)) AS key, props FROM events) SELECT event_type, key, count(*) AS rows, sum(json_extract(props, '$.' || key)::BIGINT)::BIGINT AS n FROM e GROUP BY 1, 2",
    "format_version": "SELECT CASE WHEN lower(file_path) LIKE '%.v2.json' THEN 'v2' WHEN lower(file_path) LIKE '%.v1.5.json' THEN 'v1.5' WHEN lower(file_path) LIKE '%.v1.json' THEN 'v1' ELSE 'v1.5' END AS version, count(*) AS n FROM annotation_files GROUP BY 1",
    "skipped_names": "SELECT split_part(file_path, '/', 1) AS dataset, length(split_part(regexp_extract(file_path, '([^/]*)$', 1), '.', 1))::INT AS stem_length, count(*) AS n FROM annotation_files WHERE file_path NOT LIKE '%...%' GROUP BY 1, 2",
}
