"""Patches annotated: every changed line with its kind and tokens, and the sizes and spreads of whole patches.

A patch is one row with its text, and all that is known of a line lies in that row, so parsing and lexing are map-only: no shuffle
until lines are gathered into documents. Images of whole files, where there are any, are joined in by (patch, file, side).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.operators import chunks as ch
from diffloom.operators import classify as cl
from diffloom.sources.diffs import diff_lines, parse_diff
from diffloom.sources.lexing import FRAME_LINES, TOKENS, lex_lines

SUBMODULE = "160000"
IMAGE_SCHEMA = (
    "patch_id string, file_idx int, source_file string, target_file string, mode_pre string, mode_post string, hunk_idx int, side string, "
    "lines array<struct<id:int,in_hunk_side:int,in_hunk:int,file_line_no:int,changed:boolean,value:string>>"
)
_LINE = "id int, hunk_idx int, in_hunk_chg_idx int, file_line_no int, type string, purpose string, tokens " + TOKENS
LINE_STRUCT = f"struct<{', '.join(x.replace(' ', ':', 1) for x in _LINE.split(', '))}>"


def _images(patch: str, text: str | None) -> Iterator[tuple]:
    for f, x in enumerate(parse_diff(text)):
        head = (patch, f, x["source"], x["target"], x["pre"], x["post"])
        if not x["hunks"]:
            yield (*head, None, None, None)
        for h, (_, _, _, _, rows) in enumerate(x["hunks"]):
            for side in "+-":
                lines, of_side, of_hunk = [], 0, 0
                for i, (kind, a, b, value) in enumerate(rows):
                    if kind in (side, " "):
                        lines.append({"id": i, "in_hunk_side": of_side, "in_hunk": of_hunk, "file_line_no": a if side == "-" else b, "changed": kind == side, "value": value + "\n"})
                        of_side += kind == side
                    of_hunk += kind in "+-"
                if of_side:
                    yield (*head, h, side, lines)


def hunk_images(patches: DataFrame, text: str = "text") -> DataFrame:
    """One row per hunk and side that it changes: the lines of the hunk's image on that side; a file without hunks is one row with nulls."""
    names = [x.split()[0] for x in IMAGE_SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, n = [], 0
            for patch, t in zip(pdf["patch_id"], pdf[text]):
                for row in _images(patch, t if isinstance(t, str) else None):
                    rows.append(row)
                    n += 1 + len(row[-1] or ())
                if n >= FRAME_LINES:
                    yield pd.DataFrame(rows, columns=names).astype({"file_idx": "Int32", "hunk_idx": "Int32"})
                    rows, n = [], 0
            yield pd.DataFrame(rows, columns=names).astype({"file_idx": "Int32", "hunk_idx": "Int32"})

    return patches.select("patch_id", text).mapInPandas(parse, IMAGE_SCHEMA)


def file_path() -> Column:
    """The name that decides what a hunk's file is: the source, or the target of a new file."""
    return F.when(F.col("source_file") == "/dev/null", F.col("target_file")).otherwise(F.col("source_file"))


def is_submodule() -> Column:
    """Whether a changed file is a link to a commit of another repository, on either side."""
    return F.coalesce(F.col("mode_pre") == SUBMODULE, F.lit(False)) | F.coalesce(F.col("mode_post") == SUBMODULE, F.lit(False))


def lexed(images: DataFrame, whole: bool) -> DataFrame:
    """``images`` with ``tokens``, an array for each changed line: from ``content``, the file's image, where it isn't null, else from the hunk's.

    Rows whose ``plain`` is true aren't lexed: each line is one token of text.
    """
    kept = [f for f in images.schema.fields if f.name not in ("lines", "content", "plain")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple = (None, None, None)
        for pdf in batches:
            rows, n = [], 0
            contents = pdf["content"] if whole else [None] * len(pdf)
            for *own, path, plain, lines, content in zip(*[pdf[f.name] for f in kept], pdf["path"], pdf["plain"], pdf["lines"], contents):
                if plain:
                    found = {x["id"]: [(0, ["Text"], x["value"])] for x in lines}
                elif isinstance(content, str):
                    if last[:2] != (path, content):
                        last = (path, content, lex_lines(path or "", content))
                    found = {x["id"]: last[2][x["file_line_no"] - 1] if 0 < x["file_line_no"] <= len(last[2]) else [] for x in lines}
                else:
                    by_line = lex_lines(path or "", "".join(x["value"] for x in lines))
                    found = dict(zip((x["id"] for x in lines), by_line))
                out = [
                    {"id": x["id"], "in_hunk": x["in_hunk"], "in_hunk_side": x["in_hunk_side"], "file_line_no": x["file_line_no"], "tokens": [{"idx": a, "type": p, "text": v} for a, p, v in found.get(x["id"], [])]}
                    for x in lines
                    if x["changed"]
                ]
                rows.append((*own, out))
                n += len(out)
                if n >= FRAME_LINES:
                    yield pd.DataFrame(rows, columns=[*[f.name for f in kept], "line"])
                    rows, n = [], 0
            yield pd.DataFrame(rows, columns=[*[f.name for f in kept], "line"])

    schema = f"{kinds}, line array<struct<id:int,in_hunk:int,in_hunk_side:int,file_line_no:int,tokens:{TOKENS}>>"
    return images.mapInPandas(run, schema)


def annotated_lines(patches: DataFrame, blobs: DataFrame | None = None, rules: cl.Rules | None = None, callback=None, text: str = "text") -> DataFrame:
    """(patch_id, file_idx, file_name, side, id, hunk_idx, in_hunk_chg_idx, file_line_no, type, purpose, tokens) of every changed line of ``patches`` (patch_id, text).

    ``id`` is the line's place in its hunk, from 0. ``in_hunk_chg_idx`` counts the changed lines before it in its hunk: on its own
    side, or on both where the file's purpose decides the type and nothing is lexed. Files of submodules have no lines. ``blobs``
    (patch_id, file_name, side, content) holds images of whole files; where one is missing the hunk's lines are lexed by themselves.
    ``callback`` takes the array of a line's tokens and gives its type or null. A null text or one without a diff has no lines.
    """
    rules = rules or cl.Rules()
    images = hunk_images(patches, text).filter(F.col("hunk_idx").isNotNull() & ~is_submodule()).withColumn("path", file_path())
    images = cl.classify(images, rules, "path").withColumn("plain", F.coalesce(F.col("path_purpose").isin(*rules.purpose_to_type), F.lit(False)))
    images = images.withColumn("file_name", F.when(F.col("side") == "+", F.col("target_file")).otherwise(F.col("source_file")))
    images = images.select("patch_id", "file_idx", "file_name", "path", "path_purpose", "hunk_idx", "side", "lines", "plain")
    if blobs is not None:
        images = images.join(blobs.select("patch_id", "file_name", "side", "content"), ["patch_id", "file_name", "side"], "left")
    decided = F.col("path_purpose").isin(*rules.purpose_to_type)
    rows = lexed(images, blobs is not None).select("*", F.explode("line").alias("x"))
    tokens = F.col("x.tokens")
    kind = cl.line_type(F.col("path_purpose"), tokens, callback(tokens) if callback else None, rules)
    index = F.when(decided, F.col("x.in_hunk")).otherwise(F.col("x.in_hunk_side"))
    return rows.select("patch_id", "file_idx", "file_name", "side", "x.id", "hunk_idx", index.alias("in_hunk_chg_idx"), "x.file_line_no", kind.alias("type"), F.col("path_purpose").alias("purpose"), "x.tokens")


FILE_COUNTS = ("n_files", "n_binary_files", "n_submodules", "n_added_files", "n_removed_files", "n_file_renames")
SIZES = ("n_hunks", "n_mod", "n_rem", "n_add", "patch_size", "n_lines_added", "n_lines_removed", "n_lines_all", "n_groups", "spread_inner")
SPREADS = ("hunk_span_src", "hunk_span_dst", "hunk_spread_src", "hunk_spread_dst", "groups_spread")
METRICS = FILE_COUNTS + SIZES + SPREADS


def patch_metrics(lines: DataFrame) -> DataFrame:
    """(patch_id, metrics) of the lines of :func:`diffloom.sources.diffs.diff_lines`: sums of its files' metrics, of which negative ones count 0.

    A file without hunks counts as binary. A submodule counts as a file and for nothing else. Of added, removed and renamed a
    file is the first that fits. Only hunks with changes count.
    """
    files = lines.groupBy("patch_id", "file_idx").agg(
        F.first("source_file").alias("source_file"), F.first("target_file").alias("target_file"), F.first("mode_pre").alias("mode_pre"), F.first("mode_post").alias("mode_post"),
        F.bool_or("is_rename").alias("renamed"), F.max("hunk_idx").isNull().alias("bare"),
    )
    one = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    added, removed = F.col("source_file") == "/dev/null", F.col("target_file") == "/dev/null"
    files = files.select(
        "patch_id", F.lit(1).cast("bigint").alias("n_files"), one(F.col("bare")).alias("n_binary_files"), one(~F.col("bare") & is_submodule()).alias("n_submodules"), one(added).alias("n_added_files"), one(removed & ~added).alias("n_removed_files"),
        one(~F.coalesce(added | removed, F.lit(False)) & (F.col("renamed") | (F.col("source_file") != F.col("target_file")))).alias("n_file_renames"),
    )
    inside = lines.filter(F.col("hunk_idx").isNotNull() & ~is_submodule())
    hunks = ch.hunk_metrics(inside).withColumn("n_hunks", F.lit(1))
    spreads = ch.file_spreads(inside).drop("n_hunks")
    least = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("bigint").alias(c)
    zeros = lambda names: [F.lit(0).cast("bigint").alias(n) for n in names]
    rows = files.select("*", *zeros(SIZES + SPREADS))
    rows = rows.unionByName(hunks.select("patch_id", *[least(c) for c in SIZES], *zeros(FILE_COUNTS + SPREADS)))
    rows = rows.unionByName(spreads.select("patch_id", *[least(c) for c in SPREADS], *zeros(FILE_COUNTS + SIZES)))
    return rows.groupBy("patch_id").agg(*[F.sum(c).alias(c) for c in METRICS])


def as_map(metrics: DataFrame) -> DataFrame:
    """(patch_id, diff_metadata): the metrics above 0 as a map."""
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in METRICS]), lambda x: x["value"] > 0)
    return metrics.select("patch_id", F.map_from_entries(pairs).alias("diff_metadata"))


def annotate(patches: DataFrame, blobs: DataFrame | None = None, rules: cl.Rules | None = None, callback=None, text: str = "text") -> DataFrame:
    """(patch_id, changes, diff_metadata): the annotation document of every patch of ``patches`` (patch_id, text) that has a diff.

    changes maps each name of a changed file, ``/dev/null`` included, to its language, type, purpose and annotated lines of both sides;
    submodules are left out. A patch_id that occurs twice is one patch with all its files.
    """
    rules = rules or cl.Rules()
    lines = annotated_lines(patches, blobs, rules, callback, text)
    line = F.struct("id", "hunk_idx", "in_hunk_chg_idx", "file_line_no", "type", "purpose", "tokens")
    placed = F.struct("file_idx", "hunk_idx", "id", line.alias("line"))
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, placed))), lambda x: x["line"]).alias(s)
    sides = lines.groupBy("patch_id", "file_name").agg(side("+"), side("-"))
    parsed = diff_lines(patches, text)
    heads = parsed.filter(~is_submodule()).select("patch_id", F.explode(F.array("source_file", "target_file")).alias("file_name")).filter("file_name IS NOT NULL").distinct()
    named = cl.classify(heads, rules).join(sides, ["patch_id", "file_name"], "left")
    none = F.array().cast(f"array<{LINE_STRUCT}>")
    value = F.struct(F.col("path_language").alias("language"), F.col("path_type").alias("type"), F.col("path_purpose").alias("purpose"), F.coalesce(F.col("+"), none).alias("+"), F.coalesce(F.col("-"), none).alias("-"))
    changes = named.groupBy("patch_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("file_name").alias("key"), value.alias("value"))))).alias("changes"))
    return as_map(patch_metrics(parsed)).join(changes, "patch_id", "left").select("patch_id", "changes", "diff_metadata")
