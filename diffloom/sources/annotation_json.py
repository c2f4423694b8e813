"""Annotation documents in JSON, of all layouts, as rows of one schema; and the reports made of them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.operators.compaction import documents_in, layout_of

TOKEN = "struct<idx:int,type:array<string>,text:string>"
LINE = f"struct<id:int,hunk_idx:int,in_hunk_chg_idx:int,file_line_no:int,type:string,purpose:string,tokens:array<{TOKEN}>>"
CHANGES = f"map<string,struct<language:string,type:string,purpose:string,`+`:array<{LINE}>,`-`:array<{LINE}>>>"
PERSON = "struct<{0}:string,name:string,email:string,timestamp:bigint,tz_info:string>"
META = f"struct<id:string,parents:array<string>,tree:string,author:{PERSON.format('author')},committer:{PERSON.format('committer')},message:string>"
SCHEMA = f"format_version string, commit_metadata {META}, changes {CHANGES}, diff_metadata map<string,bigint>"


def split_layout(document: dict) -> tuple[dict | None, dict | None, dict | None]:
    """(commit_metadata, changes, diff_metadata) of a document of any layout.

    With everything at top level, what is an object without a purpose and named commit_metadata is that, other objects are
    files, and plain numbers are metrics.
    """
    if "changes" in document:
        return document.get("commit_metadata"), document["changes"], document.get("diff_metadata")
    metrics = dict(document.get("diff_metadata") or {}) if isinstance(document.get("diff_metadata"), dict) and "purpose" not in document["diff_metadata"] else {}
    meta, files = None, {}
    for key, value in document.items():
        if key == "commit_metadata" and isinstance(value, dict) and "purpose" not in value:
            meta = value
        elif key == "diff_metadata" and metrics:
            continue
        elif isinstance(value, dict) or value is None:
            files[key] = value
        elif isinstance(value, (int, float)):
            metrics[key] = int(value)
    return meta, files, metrics or None


def _tokens(tokens: list | None) -> list[dict] | None:
    if tokens is None:
        return None
    return [{"idx": t[0], "type": t[1], "text": t[2]} if isinstance(t, list) else t for t in tokens]


def _normal(document: dict) -> str:
    meta, changes, metrics = split_layout(document)
    if isinstance(changes, dict):
        for value in changes.values():
            for side in "+-":
                for line in (value or {}).get(side) or ():
                    if isinstance(line, dict) and "tokens" in line:
                        line["tokens"] = _tokens(line["tokens"])
    return json.dumps({"format_version": layout_of(document), "commit_metadata": meta, "changes": changes, "diff_metadata": metrics})


def normalised(files: DataFrame) -> DataFrame:
    """(file_path, format_version, commit_metadata, changes, diff_metadata): every complete document in ``files`` (file_path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, _normal(d)) for p, t in zip(pdf["file_path"], pdf["content"]) for d, _ in documents_in(t if isinstance(t, str) else None)]
            yield pd.DataFrame(rows, columns=["file_path", "j"])

    flat = files.select("file_path", "content").mapInPandas(run, "file_path string, j string")
    return flat.select("file_path", F.from_json("j", SCHEMA).alias("d")).select("file_path", "d.*")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """All documents in JSON files below ``path``, with bug_id and dataset from their directories; names with ``...`` are skipped."""
    raw = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    files = raw.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content")).filter(~F.col("file_path").contains("..."))
    parts = F.split("file_path", "/")
    up = F.when(F.element_at(parts, -2).isin("annotation", "annotations"), 1).otherwise(0)
    docs = normalised(files)
    return docs.withColumns({"bug_id": F.element_at(parts, -2 - up), "dataset": F.try_element_at(parts, -3 - up), "patch_id": F.regexp_extract("file_path", r"([^/]*?)(\.v[\d.]+)?\.json$", 1)})


def report_name(path: Column) -> Column:
    """The name of a report: its file's name up to the first dot."""
    return F.substring_index(F.regexp_extract(path, r"([^/]*)$", 1), ".", 1)


def find_reports(spark: SparkSession, path: str, kind: str = "timeline") -> DataFrame:
    """(file_path, name) of reports ``*.<kind>.*json`` below ``path``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}*.json").load(path)
    return found.select(F.col("path").alias("file_path"), report_name(F.col("path")).alias("name"))


def read_timeline(spark: SparkSession, path: str, counts: list[str] | None = None) -> DataFrame:
    """(dataset, record, counts): the records of timeline reports, {dataset: [record, ...]}, each a map of its values as text.

    counts has the record's whole numbers; ``counts`` gives them columns of their own, null where a record has none. A report without
    records gives no rows.
    """
    raw = spark.read.format("text").option("wholetext", "true").load(path)
    rows = raw.select(F.explode(F.from_json("value", "map<string,array<map<string,string>>>")).alias("dataset", "records"))
    rows = rows.select("dataset", F.explode("records").alias("record"))
    rows = rows.withColumn("counts", F.map_filter(F.transform_values("record", lambda _, v: F.when(v.rlike(r"^-?\d+$"), v.try_cast("bigint"))), lambda _, v: v.isNotNull()))
    return rows.select("*", *[F.col("counts")[k].alias(k) for k in counts or ()])


def read_records(spark: SparkSession, path: str, schema: str, kind: str = "csv", **options: str) -> DataFrame:
    """Records of CSV (with a header) or JSON files in ``schema``; a record that doesn't fit it is null but for ``_damaged``, its text."""
    given = {"header": "true", "multiLine": "true"} if kind == "csv" else {}
    return spark.read.format(kind).schema(f"{schema}, _damaged string").options(columnNameOfCorruptRecord="_damaged", **(given | options)).load(path)


def companion(path: Column) -> Column:
    """The line statistics beside a timeline report."""
    return F.replace(path, F.lit(".timeline."), F.lit(".lines-stats."))
