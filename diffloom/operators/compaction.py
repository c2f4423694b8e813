"""Consolidation of very many small files: a frozen manifest, cut into groups of about one target size.

Documents are taken out of the files and frozen as a table. Its manifest, keys and sizes without contents, has one row for each
key. The plan is SQL only: the manifest is ordered by (hash bucket, key), its bytes summed by window, and the running sum is
cut at multiples of the target size, so that a group is an interval of keys. Contents are shuffled once: each goes to its
group by the intervals' starts, where the newest one of each key is kept and written. Counts, bytes and a checksum of the keys
are reconciled.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffloom.session import cut, new_path, release, remove

#: Size a written group should have.
TARGET_BYTES = 128 * 1024 * 1024
#: Into at least, and at most, so many hash buckets the manifest is ordered, one for each group in between; the only window that
#: isn't partitioned has as many rows.
BUCKETS, BUCKETS_MOST = 4096, 1 << 20
#: Starts of groups, one for each bucket and group that meet, up to which they go to every task (about 100 bytes each).
SENT_STARTS = 2_000_000

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("bug_id", T.StringType()),
        T.StructField("patch_id", T.StringType()),
        T.StructField("layout", T.StringType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("document", T.StringType()),
    ]
)

_HEX40 = re.compile(r"^[0-9a-f]{40}$")
_NAME = re.compile(r"(?:^|/)([0-9a-f]{2})/?([0-9a-f]{38})(?=\.|$)")


def _loaded(text: str):
    """The value of a JSON text; null for a damaged one."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def documents_in(text: str | None) -> list[tuple[dict, str]]:
    """The complete JSON objects in a file's text, each with its own text.

    A text is one object, an array of objects, or one object per line. Damaged JSON is no document; in a file of
    lines the intact lines count, whatever the others hold. Nulls, empty objects and other values are none either.
    """
    text = (text or "").lstrip("\ufeff").strip()
    value = _loaded(text)
    if isinstance(value, dict):
        return [(value, text)] if value else []
    if isinstance(value, list):
        return [(x, json.dumps(x, ensure_ascii=False)) for x in value if isinstance(x, dict) and x]
    found = []
    # other characters that end lines may stand in a string; a line that is damaged as a whole may have old line ends
    for line in text.split("\n"):
        for part in [line] if "\r" not in line or _loaded(line) is not None else line.split("\r"):
            part = part.strip()
            value = _loaded(part) if part[:1] == "{" else None
            if isinstance(value, dict) and value:
                found.append((value, part))
    return found


def layout_of(document: dict) -> str:
    """``v2`` (three parts), ``v1.5`` (all at top level) or ``v1`` (files only)."""
    if "changes" in document:
        return "v2"
    return "v1.5" if "commit_metadata" in document or "diff_metadata" in document else "v1"


def clean_bug(path: str | None, entered: str | None) -> str | None:
    """bug_id in lower case: the second part of the path, else what was entered, without blanks and slashes."""
    parts = [p for p in (path or "").strip().replace("\\", "/").split("/") if p not in ("", ".")]
    bug = parts[1] if len(parts) > 2 else (entered or "")
    return bug.strip().strip("/").strip().lower() or None


def clean_patch(document: dict, path: str | None, listed: str | None) -> str | None:
    """patch_id as 40 lower-case hex digits: the document's own id, else the file's name with or without fan-out."""
    meta = document.get("commit_metadata")
    own = str(meta.get("id") or "").strip().lower() if isinstance(meta, dict) else ""
    if _HEX40.match(own):
        return own
    for name in (path, listed):
        if m := _NAME.search((name or "").strip().replace("\\", "/").lower()):
            return m[1] + m[2]
    return None


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, bug, patch, when, text in zip(pdf.file_path, pdf.bug_id, pdf.patch_id, pdf.modified_at, pdf.content):
            for document, own in documents_in(text):
                key = clean_bug(path, bug), clean_patch(document, path, patch)
                if None not in key:
                    rows.append((*key, layout_of(document), len(own.encode("utf-8", "replace")), when, own))
        yield pd.DataFrame(rows, columns=DOCUMENT_SCHEMA.names)


def split_documents(files: DataFrame) -> DataFrame:
    """One row per complete document in ``files`` (file_path, bug_id, patch_id, modified_at, content).

    Null and empty contents give no rows; a document of which neither the file's name nor its own metadata tell the
    patch gives none. Other columns of ``files``, whatever their names, are ignored. Rows listed twice give their
    documents twice; :func:`compact` keeps one.
    """
    columns = ["file_path", "bug_id", "patch_id", "modified_at", "content"]
    return files.select(*columns).mapInPandas(_split, DOCUMENT_SCHEMA)


@dataclass(frozen=True)
class Compacted:
    """What :func:`compact` wrote: the table, its folder, and one row per group with its rows and bytes."""

    table: DataFrame
    path: str
    groups: DataFrame


PLAN = """
WITH manifest AS (
    SELECT {keys}, coalesce({size}, 0L) AS bytes, {bucket} AS bucket FROM {{frozen}}
), bases AS (
    SELECT bucket, sum(bytes) OVER (ORDER BY bucket ROWS UNBOUNDED PRECEDING) - bytes AS base
    FROM (SELECT bucket, sum(bytes) AS bytes FROM manifest GROUP BY bucket)
), positions AS (
    SELECT {keys}, manifest.bytes, manifest.bucket,
           bases.base + sum(manifest.bytes) OVER (PARTITION BY manifest.bucket ORDER BY {keys} ROWS UNBOUNDED PRECEDING)
               - manifest.bytes AS start
    FROM manifest JOIN bases ON manifest.bucket = bases.bucket
)
SELECT {keys}, bytes, bucket, CAST(start DIV {target} AS INT) AS group_no FROM positions
"""


def _quoted(keys: tuple[str, ...]) -> str:
    return ", ".join(f"`{k}`" for k in keys)


def _bucket(keys: tuple[str, ...], buckets: int) -> str:
    return f"pmod(xxhash64({_quoted(keys)}), {buckets})"


def plan_groups(frozen: DataFrame, keys: tuple[str, ...], size: str, target_bytes: int = TARGET_BYTES, buckets: int = BUCKETS) -> DataFrame:
    """The bucket and group of each row of the frozen manifest; ``keys`` must be unique in it.

    Every group starts within its own interval of ``target_bytes``, so that no group holds more than the target and
    one row. A null size counts as 0 bytes. An empty manifest gives an empty plan.
    """
    text = PLAN.format(keys=_quoted(keys), size=f"`{size}`", bucket=_bucket(keys, buckets), target=int(target_bytes))
    return frozen.sparkSession.sql(text, frozen=frozen)


def group_starts(plan: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(bucket, starts): in each bucket, the first key and the number of each group that has rows there, in order."""
    first = plan.groupBy("bucket", "group_no").agg(F.min(F.struct(*keys)).alias("first"))
    return first.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("first", "group_no"))).alias("starts"))


def _totals(df: DataFrame, keys: tuple[str, ...], size: str) -> tuple:
    # decimals, as the sum of many hashes doesn't fit a bigint
    hashes = F.sum(F.xxhash64(*keys).cast("decimal(38,0)"))
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(hashes, F.lit(0))).first())


def _free(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


def compact(
    rows: DataFrame, keys: tuple[str, ...] = ("bug_id", "patch_id"), size: str = "n_bytes", target_bytes: int = TARGET_BYTES, path: str | None = None, newest: tuple[str, ...] = (), sent_starts: int = SENT_STARTS
) -> Compacted:
    """Write ``rows`` as few files of about ``target_bytes`` each, one row for each of ``keys``.

    Of rows with equal keys the one that is greatest by the columns ``newest``, nulls being least, is kept; without ``newest`` the keys
    must be unique. ``rows`` is frozen first, so that planning and writing see the same rows even if the source changes or an executor is
    lost. Raises ``RuntimeError`` if a key is null, if it is repeated without ``newest``, or if written rows, bytes or keys differ from
    the manifest's. Other columns are written as they are, also one named ``group_no``; each file is sorted by key. ``sent_starts`` changes
    the plan, never the rows. An empty input writes one empty file.
    """
    spark = rows.sparkSession
    at, path = new_path(spark, "frozen"), path or new_path(spark, "compacted")
    try:
        rows.write.parquet(at)
        frozen = spark.read.schema(rows.schema).parquet(at)
        # the manifest reads keys, sizes and what tells the newest, no contents
        size_of = F.max_by(F.col(size), F.struct(*newest)) if newest else F.max(size)
        manifest = cut(frozen.groupBy(*keys).agg(size_of.alias(size), F.count(F.lit(1)).alias(_free("n", rows.columns))))
        count, every, hashes, listed, nulls = manifest.agg(
            F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.xxhash64(*keys).cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum(_free("n", rows.columns)), F.lit(0)),
            F.count_if(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 1),
        ).first()
        if nulls or (not newest and listed != count):
            raise RuntimeError(f"{nulls} keys are null, and {listed} rows have {count} keys")
        n_groups = max(1, -(-every // int(target_bytes)))
        buckets = min(max(BUCKETS, n_groups), BUCKETS_MOST)
        starts = group_starts(plan_groups(manifest, keys, size, target_bytes, buckets), keys)
        group, bucket = _free("group_no", rows.columns), _free("bucket", rows.columns)
        starts = starts.select(F.col("bucket").alias(bucket), F.col("starts").alias("_starts"))
        placed = frozen.withColumn(bucket, F.expr(_bucket(keys, buckets))).join(F.broadcast(starts) if n_groups + buckets <= sent_starts else starts, bucket)
        number = F.element_at(F.filter("_starts", lambda x: x["first"] <= F.struct(*keys)), -1)["group_no"]
        grouped = placed.select(*rows.columns, number.alias(group)).repartitionById(n_groups, F.col(group))
        if newest:
            # a key's rows are in one group: no other shuffle
            rank = _free("rank", rows.columns)
            by = Window.partitionBy(group, *keys).orderBy(*[F.col(c).desc_nulls_last() for c in newest])
            grouped = grouped.withColumn(rank, F.row_number().over(by)).filter(F.col(rank) == 1).drop(rank)
        grouped.sortWithinPartitions(group, *keys).write.mode("overwrite").parquet(path)
        release(manifest)
        written = spark.read.parquet(path)
        before, after = (count, every, hashes), _totals(written, keys, size)
        if before != after:
            raise RuntimeError(f"{path} holds rows, bytes and keys {after}, but {before} were frozen")
    finally:
        remove(spark, at)
    groups = written.groupBy(F.col(group).alias("group_no")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("bytes"))
    return Compacted(written.select(*rows.columns), path, groups)


def compact_annotation_files(files: DataFrame, target_bytes: int = TARGET_BYTES, path: str | None = None) -> Compacted:
    """The annotation documents of very many small JSON files, each (bug_id, patch_id) once, in few files.

    Of several documents of a key the one modified last is kept (null is oldest); then the larger, then the one of the greater digest.
    """
    documents = split_documents(files).withColumn("digest", F.unhex(F.sha2("document", 256)))
    done = compact(documents, target_bytes=target_bytes, path=path, newest=("modified_at", "n_bytes", "digest"))
    return Compacted(done.table.drop("digest"), done.path, done.groups)
