"""``python -m diffloom``: patches to annotation documents, documents to reports, and histories to patches."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffloom.operators import annotate as an
from diffloom.operators import classify as cl
from diffloom.operators import gather as ga
from diffloom.session import share_package
from diffloom.sources import annotation_json as aj
from diffloom.sources import gitrepo as gr
from diffloom.sources import sinks
from diffloom.sources.diffs import diff_lines, read_diffs
from diffloom.sources.gitlog import GitLog


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="diffloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def rules(x: argparse.ArgumentParser) -> None:
        x.add_argument("--ext-to-language", action="append", default=[], metavar="EXT:LANGUAGE", help="'' empties the table")
        x.add_argument("--filename-to-language", action="append", default=[], metavar="NAME:LANGUAGE")
        x.add_argument("--pattern-to-purpose", action="append", default=[], metavar="PATTERN:PURPOSE")
        x.add_argument("--purpose-to-annotation", action="append", default=[], metavar="PURPOSE:TYPE")
        x.add_argument("--languages", help="a catalogue in YAML")
        x.add_argument("--line-callback", choices=sorted(cl.CALLBACKS), help="lines with a type of their own")
        x.add_argument("--fan-out", action="store_true", help="folders of the ids' first two digits")

    for name, text in (("annotate", "a folder of *.diff and *.patch files"), ("from-repo", "the commits of a git repository")):
        x = sub.add_parser(name, help=f"annotation documents of {text}")
        x.add_argument("source")
        x.add_argument("target", help="folder of the documents")
        rules(x)
        if name == "from-repo":
            x.add_argument("revisions", nargs="*", default=["HEAD"])
            x.add_argument("--use-repo", action="store_true", help="lex whole files")
            x.add_argument("--bug", help="name of the bug or project, by default the repository's")
    x = sub.add_parser("patches", help="the diffs of a git repository's commits as files")
    x.add_argument("source")
    x.add_argument("target")
    x.add_argument("revisions", nargs="*", default=["HEAD"])
    x.add_argument("--fan-out", action="store_true")
    for name in REPORTS:
        x = sub.add_parser(name, help="a report on a folder of annotation documents")
        x.add_argument("source")
        x.add_argument("target", help="the report's JSON file")
        x.add_argument("--purpose-to-annotation", action="append", default=[], metavar="PURPOSE:TYPE")
    return p


def _purpose_types(args: argparse.Namespace) -> dict[str, str]:
    return cl.Rules(purpose_to_type={}).updated(purpose_to_type=args.purpose_to_annotation).purpose_to_type


REPORTS = {
    "purpose-counter": lambda d, a: ga.purpose_counter(d), "purpose-per-file": lambda d, a: ga.purpose_per_file(d), "lines-stats": lambda d, a: ga.lines_stats(d, _purpose_types(a)),
    "timeline": lambda d, a: ga.timeline_wide(d, rules=_purpose_types(a)), "added-lines": lambda d, a: ga.added_lines(d),
}


def _log(spark: SparkSession, path: str, revisions: list[str]) -> DataFrame:
    spark.dataSource.register(GitLog)
    rows = spark.read.format("gitlog").option("path", path).option("revisions", " ".join(revisions)).load()
    return rows.select(F.col("commit_id").alias("patch_id"), F.col("diff").alias("text"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command; the number of documents, files or records written is printed."""
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("diffloom").getOrCreate()
    share_package(spark)
    if args.command in REPORTS:
        documents = ga.distinct_documents(aj.read_annotations(spark, args.source))
        n = sinks.write_report(REPORTS[args.command](documents, args), args.target)
    elif args.command == "patches":
        n = sinks.write_diffs(_log(spark, args.source, args.revisions), args.target, args.fan_out)
    else:
        rules = cl.Rules(**({"catalogue": cl.load_catalogue(args.languages)} if args.languages else {}))
        rules = rules.updated(args.ext_to_language, args.filename_to_language, args.pattern_to_purpose, args.purpose_to_annotation)
        callback = cl.CALLBACKS[args.line_callback] if args.line_callback else None
        if args.command == "annotate":
            patches, blobs, bugs = read_diffs(spark, args.source), None, None
            bugs = patches.groupBy("patch_id").agg(F.min("bug_id").alias("bug_id"))
        else:
            patches = _log(spark, args.source, args.revisions)
            blobs = gr.blobs_of(diff_lines(patches), args.source) if args.use_repo else None
            bugs = patches.select("patch_id", F.lit(args.bug or args.source.rstrip("/").rpartition("/")[2]).alias("bug_id"))
        documents = an.annotate(patches, blobs, rules, callback).join(bugs, "patch_id")
        n = sinks.write_documents(documents.withColumn("commit_metadata", F.struct(F.col("patch_id").alias("id"))), args.target, args.fan_out)
    print(n)
    return 0


if __name__ == "__main__":
    sys.exit(main())
