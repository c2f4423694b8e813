"""Writers: documents as JSON files by patch, reports, diffs in fan-out folders, and CSV."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_files(rows: DataFrame, folder: str) -> int:
    """Write each row of ``rows`` (place, text) as the file ``place`` below ``folder``; the number of files.

    ``folder`` must be one that all executors share. A file is written beside its place and then moved there, so that a task that
    runs twice leaves whole files. Of equal places the last one written stays.
    """
    from pyarrow import fs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        made: set[str] = set()
        for pdf in batches:
            for place, text in zip(pdf["place"], pdf["text"]):
                path = f"{base}/{place}"
                above = path.rpartition("/")[0]
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                beside = f"{above}/.{uuid.uuid4().hex}"
                with system.open_output_stream(beside) as out:
                    out.write((text or "").encode())
                system.move(beside, path)
            yield pd.DataFrame({"n": [len(pdf)]})

    return rows.select("place", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def fanned(patch: Column, suffix: str, fan_out: bool) -> Column:
    """A patch's file name: its id and ``suffix``, with ``fan_out`` in a folder of the first two digits."""
    return F.concat(F.substring(patch, 1, 2), F.lit("/"), F.substr(patch, F.lit(3)), F.lit(suffix)) if fan_out else F.concat(patch, F.lit(suffix))


def _tokens_as_lists(text: str) -> str:
    document = json.loads(text)
    for value in (document.get("changes") or {}).values():
        for side in "+-":
            for line in (value or {}).get(side) or ():
                if line and line.get("tokens") is not None:
                    line["tokens"] = [[t.get("idx"), t.get("type"), t.get("text")] for t in line["tokens"]]
    return json.dumps(document, ensure_ascii=False)


def write_documents(documents: DataFrame, path: str, fan_out: bool = False, place: Column | None = None) -> int:
    """Each document as a file ``<bug_id>/annotation/<patch_id>.v2.json``, or where ``place`` puts it; tokens are [offset, type, text].

    ``read_annotations`` reads them back; with ``fan_out`` a file is ``<first two digits>/<rest>.v2.json``.
    """
    parts = [c for c in ("commit_metadata", "changes", "diff_metadata") if c in documents.columns]
    place = place if place is not None else F.concat(F.coalesce("bug_id", F.lit("none")), F.lit("/annotation/"), fanned(F.col("patch_id"), ".v2.json", fan_out))

    @F.pandas_udf("string")
    def lists(texts: pd.Series) -> pd.Series:
        return texts.map(_tokens_as_lists)

    return write_files(documents.select(place.alias("place"), lists(F.to_json(F.struct(*parts))).alias("text")), path)


def write_report(rows: DataFrame, path: str, key: str | None = None, indent: int = 4) -> int:
    """A report as one JSON file: a list of records, or with ``key`` an object with a list for each of its values, in their order.

    One task writes it as a stream, so it may be larger than a task's memory; the folder is made. The number of records is given back.
    """
    from pyarrow import fs

    columns = [c for c in rows.columns if c != key]
    ordered = rows.select(*([F.col(key).cast("string").alias("_key")] if key else [F.lit("").alias("_key")]), F.to_json(F.struct(*columns)).alias("_text"))
    ordered = ordered.orderBy("_key").coalesce(1) if key else ordered.coalesce(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, place = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        system.create_dir(place.rpartition("/")[0], recursive=True)
        beside, n, last, pad = f"{place.rpartition('/')[0]}/.{uuid.uuid4().hex}", 0, None, " " * indent
        with system.open_output_stream(beside) as out:
            out.write(b"{" if key else b"[")
            for pdf in batches:
                for k, text in zip(pdf["_key"], pdf["_text"]):
                    k = "null" if k is None or k != k else k
                    if key and (n == 0 or k != last):
                        out.write((("" if n == 0 else f"\n{pad}],") + f"\n{pad}{json.dumps(k, ensure_ascii=False)}: [").encode())
                        first, last = True, k
                    else:
                        first = n == 0
                    record = json.dumps(json.loads(text), indent=indent, ensure_ascii=False).replace("\n", "\n" + pad * (2 if key else 1))
                    out.write((("" if first else ",") + "\n" + pad * (2 if key else 1) + record).encode())
                    n += 1
            out.write(((f"\n{pad}]" if key and n else "") + ("\n" if n else "") + ("}" if key else "]") + "\n").encode())
        system.move(beside, place)
        yield pd.DataFrame({"n": [n]})

    n = ordered.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not n:  # no rows may be no task
        list(run(iter(())))
    return n


def write_diffs(patches: DataFrame, path: str, fan_out: bool = True) -> int:
    """Texts of patches, each a file ``<first two digits>/<rest>.diff``, or ``<patch_id>.diff``; ``read_diffs`` reads them back."""
    return write_files(patches.select(fanned(F.col("patch_id"), ".diff", fan_out).alias("place"), "text"), path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """A column of text lines, such as those of a Sankey table."""
    lines.write.mode("overwrite").text(path)
