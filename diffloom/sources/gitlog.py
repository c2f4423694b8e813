"""A data source over a local git repository: commits with their metadata and diffs.

``spark.dataSource.register(GitLog)``, then ``spark.read.format("gitlog").option("path", repo).load()``. Ids of commits are
listed once; each partition streams its part of them, and a commit is one row. The option ``copies`` finds copies among
changed files (``changed``) or all files (``all``). Reading needs the ``git`` program on every executor and the repository on a
shared path; a git process that fails, fails the task.
"""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from diffloom.sources.diffs import parse_commit

SCHEMA = "commit_id string, parents array<string>, tree string, author string, committer string, message string, diff string"


COPIES = {"": [], "changed": ["--find-copies"], "all": ["--find-copies", "--find-copies-harder"]}


class Commits(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class GitLogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", ".")
        self.revisions = options.get("revisions", "HEAD").split()
        self.rows = int(options.get("commitsPerPartition", 1000))
        self.copies = COPIES[options.get("copies", "")]

    def _git(self, *args: str) -> list[str]:
        return ["git", "-C", self.path, *args]

    def partitions(self) -> list[Commits]:
        ids = subprocess.run(self._git("rev-list", *self.revisions), capture_output=True, text=True, check=True).stdout.split()
        return [Commits(ids[i : i + self.rows]) for i in range(0, len(ids), self.rows)] or [Commits([])]

    def read(self, partition: Commits) -> Iterator[tuple]:
        if not partition.ids:
            return
        command = self._git("log", "--format=raw", "--patch", "-z", "--diff-merges=first-parent", "--find-renames", *self.copies, "--no-walk=unsorted", "--stdin")
        with tempfile.TemporaryFile() as wanted, tempfile.TemporaryFile() as said:
            wanted.write("".join(f"{x}\n" for x in partition.ids).encode())
            wanted.seek(0)
            with subprocess.Popen(command, stdin=wanted, stdout=subprocess.PIPE, stderr=said) as run:
                rest = b""
                while block := run.stdout.read(1 << 20):
                    *done, rest = (rest + block).split(b"\0")
                    for text in done:
                        yield from self._row(text)
                yield from self._row(rest)
            if run.returncode:
                said.seek(0)
                raise RuntimeError(f"git log: {said.read().decode(errors='replace').strip()}")

    def _row(self, raw: bytes) -> Iterator[tuple]:
        text = raw.decode("utf-8", "backslashreplace")
        c = parse_commit(text)
        if c and c["id"]:
            at = text.find("diff --git ")
            yield c["id"], c["parents"], c["tree"], c["author"], c["committer"], c["message"], text[at:] if at >= 0 else ""


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GitLogReader:
        return GitLogReader(self.options)
