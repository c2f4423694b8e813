"""What git knows of commits, as rows: trees, single diffs, images of files, validity, blame and the survival of lines.

Functions on a frame of requests run ``git`` where the rows are, one process for many rows where git has a batch mode. They need
the program on every executor and the repository on a shared path. :class:`Repository` asks single questions, from the driver.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.operators import chunks as ch
from diffloom.sources.diffs import diff_lines, parse_blame, parse_commit

#: Fixed value: the id of the tree without entries, against which a first commit is compared.
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
BINARY = "utf-8", "backslashreplace"


def run_git(path: str, *args: str, given: bytes | None = None, missing_ok: bool = False) -> str | None:
    """The output of a git command; raises ``RuntimeError`` with git's words if it fails, or gives None with ``missing_ok``."""
    done = subprocess.run(["git", "-C", path, *args], input=given, capture_output=True)
    if done.returncode:
        if missing_ok:
            return None
        raise RuntimeError(f"git {' '.join(args)}: {done.stderr.decode(*BINARY).strip()}")
    return done.stdout.decode(*BINARY)


class Repository:
    """Questions about one repository that have one short answer."""

    def __init__(self, path: str):
        self.path = path

    def tags(self) -> list[str]:
        return run_git(self.path, "tag", "--list").split("\n")[:-1]

    def oid(self, name: str) -> str | None:
        """The id of any object's name, None if there is no such object."""
        found = run_git(self.path, "rev-parse", "--verify", "--quiet", "--end-of-options", name, missing_ok=True)
        return found.strip() if found else None

    def is_commit(self, name: str) -> bool:
        return self.oid(f"{name}^{{commit}}") is not None

    def branch(self) -> str | None:
        """The current branch, None for a detached head."""
        found = run_git(self.path, "symbolic-ref", "--quiet", "--short", "HEAD", missing_ok=True)
        return found.strip() if found else None

    def merged_into(self, commit: str, patterns: Iterable[str] = ("HEAD",)) -> list[str]:
        """The references of ``patterns`` (HEAD, or patterns of names) that contain ``commit``."""
        refs = []
        for pattern in patterns:
            name = f"refs/heads/{self.branch()}" if pattern == "HEAD" and self.branch() else pattern
            refs += run_git(self.path, "for-each-ref", f"--contains={commit}", "--format=%(refname)", "--", name).split()
        return refs

    def config(self, name: str, kind: str | None = None) -> str | None:
        found = run_git(self.path, "config", *([f"--type={kind}"] if kind else []), "--get", name, missing_ok=True)
        return None if found is None else found.rstrip("\n")

    def metadata(self, commit: str = "HEAD") -> dict:
        """Id, tree, parents, author, committer and message of a commit."""
        return parse_commit(run_git(self.path, "log", "--max-count=1", "--format=raw", "--end-of-options", commit)) or {}

    def format_patch(self, revisions: str, folder: str) -> list[str]:
        """Mail patches of a range of commits, written to ``folder``; their paths."""
        return run_git(self.path, "format-patch", "--output-directory", folder, revisions).split("\n")[:-1]


def _each(requests: DataFrame, schema: str, answer: Callable[[tuple], Iterable[tuple]]) -> DataFrame:
    """For each row of ``requests`` the rows that ``answer`` gives, after the row's own columns."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    names = [*requests.columns, *[x.split()[0] for x in schema.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                found = [(*row, *x) for x in answer(tuple(None if isinstance(v, float) and v != v else v for v in row))]
                if found:
                    yield pd.DataFrame(found, columns=names)

    return requests.mapInPandas(run, f"{kinds}, {schema}")


def tree_files(commits: DataFrame, repo: str) -> DataFrame:
    """(commit, path): all files of each commit's tree."""
    return _each(commits.select("commit"), "path string", lambda r: [(p,) for p in run_git(repo, "ls-tree", "-r", "-z", "--name-only", "--full-tree", r[0]).split("\0")[:-1]])


def _against(repo: str, commit: str, prev: str | None) -> str:
    return prev or (f"{commit}^" if run_git(repo, "rev-parse", "--verify", "--quiet", f"{commit}^", missing_ok=True) else EMPTY_TREE)


def changed_files(commits: DataFrame, repo: str) -> DataFrame:
    """(commit, prev, status, old, new) of each file that differs between ``commit`` and ``prev``, or its first parent where that is null."""

    def answer(r: tuple) -> Iterator[tuple]:
        parts = run_git(repo, "diff", "--name-status", "-z", "--find-renames", _against(repo, *r), r[0], "--").split("\0")[:-1]
        while parts:
            status = parts.pop(0)
            first = parts.pop(0)
            last = parts.pop(0) if status[0] in "RC" else first
            yield status[0], None if status[0] == "A" else first, None if status[0] == "D" else last

    return _each(commits.select("commit", "prev"), "status string, old string, new string", answer)


def single_diffs(commits: DataFrame, repo: str) -> DataFrame:
    """(commit, prev, text): the diff of each commit against ``prev``; against its first parent where that is null, and the empty tree for a first commit."""
    return _each(commits.select("commit", "prev"), "text string", lambda r: [(run_git(repo, "diff", "--find-renames", _against(repo, *r), r[0], "--"),)])


def images(requests: DataFrame, repo: str) -> DataFrame:
    """(commit, path, content): files at commits, from one process a batch; a null content where there is no such file. Bytes that are no UTF-8 are escaped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for pdf in batches:
                found = []
                for commit, path in zip(pdf["commit"], pdf["path"]):
                    if not isinstance(commit, str) or not isinstance(path, str) or "\n" in path:
                        found.append(None)
                        continue
                    git.stdin.write(f"{commit}:{path}\n".encode())
                    git.stdin.flush()
                    head = git.stdout.readline().split()
                    if len(head) == 3 and head[1] in (b"blob", b"tree", b"commit", b"tag"):
                        content = git.stdout.read(int(head[2]) + 1)[:-1]
                        found.append(content.decode(*BINARY) if head[1] == b"blob" else None)
                    elif head[-1:] in ([b"missing"], [b"ambiguous"], [b"submodule"]):
                        found.append(None)
                    else:
                        raise RuntimeError(f"git cat-file: {head}")
                yield pdf[["commit", "path"]].assign(content=found)

    return requests.select("commit", "path").mapInPandas(run, "commit string, path string, content string")


def valid_objects(objects: DataFrame, repo: str, kind: str | None = None) -> DataFrame:
    """The rows of ``objects`` (object, ...) that are objects of the repository, of ``kind`` if given (``commit``), from one process a batch."""
    schema = objects.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            named = [x if isinstance(x, str) and x and "\n" not in x else "-" for x in pdf["object"]]
            out = run_git(repo, "cat-file", "--batch-check=%(objecttype)", given="".join(f"{x}\n" for x in named).encode()).split("\n")[:-1]
            keep = [(x == kind if kind else x in ("commit", "tree", "blob", "tag")) for x in out]
            yield pdf[keep]

    return objects.mapInPandas(run, schema)


def blame(requests: DataFrame, repo: str, until: str = "HEAD") -> DataFrame:
    """(commit, path, blamed, original, final, line, previous): the lines that ``path`` has at ``commit``, and the last commit up to ``until`` that still has each.

    previous is null for a line that is still there. A file that isn't there at ``commit`` has no lines.
    """

    def answer(r: tuple) -> list[tuple]:
        ids = [run_git(repo, "rev-parse", "--verify", "--quiet", f"{x}^{{commit}}", missing_ok=True) for x in (r[0], until)]
        if ids[0] == ids[1]:  # nothing came after: git has no range to blame, and every line is there
            content = run_git(repo, "cat-file", "blob", f"{r[0]}:{r[1]}", missing_ok=True) or ""
            return [(r[0], i, i, line, None) for i, line in enumerate(content.removesuffix("\n").split("\n"), 1) if content]
        text = run_git(repo, "blame", "--reverse", "--porcelain", f"{r[0]}..{until}", "--", r[1], missing_ok=True)
        return [(x["commit"], x["original"], x["final"], x["line"], x["previous"]) for x in parse_blame(text)]

    return _each(requests.select("commit", "path"), "blamed string, original int, final int, line string, previous string", answer)


def changes_survival(commits: DataFrame, repo: str, until: str = "HEAD") -> DataFrame:
    """(commit, path, line_no, blamed, previous, survived) of each line that a commit of ``commits`` (commit, prev) added.

    Added lines meet the blame of their file on their number in the new image. Lines of submodules and of deleted files have
    no blame: survived is null for them.
    """
    diffs = single_diffs(commits, repo).select(F.col("commit").alias("patch_id"), "text")
    added = diff_lines(diffs).filter("line_type = '+'").select(F.col("patch_id").alias("commit"), F.col("target_file").alias("path"), F.col("target_line_no").alias("line_no"))
    lines = blame(added.select("commit", "path").distinct(), repo, until).select("commit", "path", F.col("final").alias("line_no"), "blamed", "previous")
    joined = added.join(lines, ["commit", "path", "line_no"], "left")
    return joined.withColumn("survived", F.when(F.col("blamed").isNotNull(), F.col("previous").isNull()))


def survival_shares(commits: DataFrame, repo: str, until: str = "HEAD") -> DataFrame:
    """(commit, survived, total) of the added lines that have a blame."""
    return ch.survival(changes_survival(commits, repo, until).filter("survived IS NOT NULL"), ["commit"])


def added_extents(commits: DataFrame, repo: str) -> DataFrame:
    """(commit, path, first, last): the runs of added lines of each file."""
    diffs = single_diffs(commits, repo).select(F.col("commit").alias("patch_id"), "text")
    added = diff_lines(diffs).filter("line_type = '+'").select(F.col("patch_id").alias("commit"), F.col("target_file").alias("path"), F.col("target_line_no").alias("line_no"))
    return ch.extents(added, ["commit", "path"], "line_no")


def blobs_of(lines: DataFrame, repo: str) -> DataFrame:
    """(patch_id, file_name, side, content): the images of whole files that :func:`diffloom.operators.annotate.annotated_lines` takes, for the files of ``lines``."""
    names = F.explode(F.array(F.struct(F.lit("-").alias("side"), F.col("source_file").alias("file_name")), F.struct(F.lit("+").alias("side"), F.col("target_file").alias("file_name"))))
    files = lines.select("patch_id", names.alias("f")).select("patch_id", "f.side", "f.file_name").filter("file_name IS NOT NULL AND file_name <> '/dev/null'").distinct()
    at = F.when(F.col("side") == "-", F.concat("patch_id", F.lit("^"))).otherwise(F.col("patch_id"))
    wanted = files.withColumns({"commit": at, "path": F.col("file_name")})
    found = images(wanted.select("commit", "path").distinct(), repo)
    return wanted.join(found, ["commit", "path"]).select("patch_id", "file_name", "side", "content")
