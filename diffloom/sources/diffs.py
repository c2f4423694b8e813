"""Unified diffs as rows: whole files or texts in, one row per line of every hunk out.

Parsing a diff needs the lengths that hunk headers promise, so it is done in Python, one text at a time in Arrow
batches; everything after that is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_SCHEMA = (
    "patch_id string, file_idx int, source_file string, target_file string, is_rename boolean, is_binary boolean, mode_pre string, mode_post string, hunk_idx int, "
    "source_start int, source_length int, target_start int, target_length int, line_idx int, line_type string, source_line_no int, target_line_no int, value string"
)
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_MODES = {"old mode": "pre", "deleted file mode": "pre", "new mode": "post", "new file mode": "post"}
_ESCAPES = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, '"': 34, "\\": 92}


def unquote(name: str) -> str:
    """A path as git prints it: with its escapes undone if it stands in quotes."""
    if len(name) < 2 or name[0] != '"' or name[-1] != '"':
        return name
    out, i, body = bytearray(), 0, name[1:-1]
    while i < len(body):
        if body[i] != "\\":
            out += body[i].encode()
            i += 1
        elif m := re.match(r"[0-3][0-7]{2}", body[i + 1 :]):
            out.append(int(m[0], 8))
            i += 4
        elif body[i + 1 : i + 2] in _ESCAPES:
            out.append(_ESCAPES[body[i + 1]])
            i += 2
        else:
            raise ValueError(f"unknown escape in {name}")
    return out.decode("utf-8", "replace")


def strip_side(name: str) -> str:
    name = unquote(name.split("\t")[0].rstrip("\r"))
    return name if name == "/dev/null" else re.sub(r"^[ab]/", "", name)


def parse_diff(text: str | None) -> list[dict]:
    """The files of a diff in their order, each with its names, modes and hunks; text around them is skipped.

    A hunk is read by the lengths its header gives, so that a removed line ``-- x`` isn't taken for a file header. A hunk cut
    short ends with the text. Null and empty texts have no files.
    """
    files: list[dict] = []
    at: dict | None = None
    lines = (text or "").split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        if line.startswith("diff --git "):
            m = re.match(r'diff --git ("(?:[^"\\]|\\.)*"|a/.*?) ("(?:[^"\\]|\\.)*"|b/.*)$', line.rstrip("\r"))
            at = {"source": strip_side(m[1]) if m else None, "target": strip_side(m[2]) if m else None, "rename": False, "binary": False, "pre": None, "post": None, "hunks": []}
            files.append(at)
        elif line.startswith("--- ") and i + 1 < len(lines) and lines[i + 1].startswith("+++ "):
            if at is None or at["hunks"]:
                at = {"source": None, "target": None, "rename": False, "binary": False, "pre": None, "post": None, "hunks": []}
                files.append(at)
            at["source"], at["target"] = strip_side(line[4:]), strip_side(lines[i + 1][4:])
            i += 1
        elif at is not None and not at["hunks"] and line.startswith(("rename from ", "rename to ")):
            at["rename"] = True
            at["source" if line.startswith("rename from") else "target"] = unquote(line.split(" ", 2)[2].rstrip("\r"))
        elif at is not None and (line.startswith("Binary files ") or line.startswith("GIT binary patch")):
            at["binary"] = True
        elif at is not None and not at["hunks"] and (m := re.match(r"(old mode|new mode|deleted file mode|new file mode) (\d{6})", line)):
            at[_MODES[m[1]]] = m[2]
            if m[1] == "deleted file mode":
                at["target"] = "/dev/null"
            elif m[1] == "new file mode":
                at["source"] = "/dev/null"
        elif at is not None and (m := re.match(r"index [0-9a-f]+\.\.[0-9a-f]+ (\d{6})", line)):
            at["pre"], at["post"] = at["pre"] or m[1], at["post"] or m[1]
        elif at is not None and (m := _HUNK.match(line)):
            i = _hunk(at, m, lines, i + 1)
            continue
        i += 1
    return files


def _hunk(at: dict, m: re.Match, lines: list[str], i: int) -> int:
    start_a, len_a, start_b, len_b = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
    a, b, rows = start_a, start_b, []
    while i < len(lines):
        line = lines[i]
        sign = line[:1]
        if sign == "\\":
            rows.append(("\\", None, None, line[1:]))
            i += 1
            continue
        if a >= start_a + len_a and b >= start_b + len_b:
            break
        if sign == "-":
            rows.append(("-", a, None, line[1:]))
            a += 1
        elif sign == "+":
            rows.append(("+", None, b, line[1:]))
            b += 1
        elif sign in (" ", "") or line == "\r":
            if sign == "" and i == len(lines) - 1:
                break  # what follows the last line end
            rows.append((" ", a, b, line[1:]))
            a, b = a + 1, b + 1
        else:
            break
        i += 1
    at["hunks"].append((start_a, len_a, start_b, len_b, rows))
    return i


def _rows(patch: str, text: str | None) -> Iterator[tuple]:
    for f, x in enumerate(parse_diff(text)):
        head = (patch, f, x["source"], x["target"], x["rename"], x["binary"] or not x["hunks"] and not x["rename"] and x["pre"] == x["post"], x["pre"], x["post"])
        if not x["hunks"]:
            yield (*head, *[None] * 10)
        for h, (sa, la, sb, lb, rows) in enumerate(x["hunks"]):
            for n, (kind, a, b, value) in enumerate(rows):
                yield (*head, h, sa, la, sb, lb, n, kind, a, b, value)


def diff_lines(patches: DataFrame, text: str = "text") -> DataFrame:
    """All lines of all hunks of ``patches`` (patch_id, text); a file without hunks is one row with nulls."""
    names = [x.split()[0] for x in LINE_SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for patch, t in zip(pdf["patch_id"], pdf[text]) for r in _rows(patch, t if isinstance(t, str) else None)]
            yield pd.DataFrame(rows, columns=names).astype({n: "Int32" for n in names if n.endswith(("_idx", "_no", "start", "length"))})

    return patches.select("patch_id", text).mapInPandas(parse, LINE_SCHEMA)


def read_diffs(spark: SparkSession, path: str, fan_out: bool = False) -> DataFrame:
    """(file_path, bug_id, patch_id, text) of ``*.diff`` and ``*.patch`` files below ``path``; names with ``...`` are skipped.

    The patch is the file's name, or with ``fan_out`` its directory of two digits and the name; the bug is the directory above
    ``patches``, or the one above the file. Bytes that are no UTF-8 become replacement characters.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{diff,patch}").load(path)
    parts = F.split("path", "/")
    name = F.regexp_replace(F.element_at(parts, -1), r"\.(diff|patch)$", "")
    patch = F.concat(F.element_at(parts, -2), name) if fan_out else name
    up = 3 if fan_out else 2
    bug = F.when(F.element_at(parts, -up) == "patches", F.try_element_at(parts, F.lit(-up - 1))).otherwise(F.element_at(parts, -up))
    rows = raw.filter(~F.col("path").contains("...")).select(F.col("path").alias("file_path"), bug.alias("bug_id"), patch.alias("patch_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    own = F.regexp_extract("text", r"(?m)^commit ([0-9a-f]{40})\b", 1)
    return rows.withColumn("patch_id", F.coalesce(F.nullif(own, F.lit("")), "patch_id"))


def parse_commit(text: str | None) -> dict | None:
    """Header of a raw commit: id, tree, parents, author and committer lines, message. Signatures are skipped; null for an empty text."""
    if not text:
        return None
    out: dict = {"id": None, "tree": None, "parents": [], "author": None, "committer": None, "message": ""}
    lines = text.replace("\r\n", "\n").split("\n")
    i = 0
    while i < len(lines) and lines[i]:
        key, _, value = lines[i].partition(" ")
        if key == "commit":
            out["id"] = value.split()[0]
        elif key == "parent":
            out["parents"].append(value)
        elif key in ("tree", "author", "committer"):
            out[key] = value
        i += 1
    body = []
    for line in lines[i + 1 :]:
        if line.startswith("diff --git "):
            break
        body.append(line[4:] if line.startswith("    ") else line)
    out["message"] = "\n".join(body).strip("\n")
    return out


def parse_blame(text: str | None) -> list[dict]:
    """Lines of ``git blame --porcelain``: commit, original, final, line, original_filename, and previous if a later commit changed it."""
    known: dict[str, dict] = {}
    out: list[dict] = []
    at: dict | None = None
    for line in (text or "").split("\n"):
        m = re.match(r"([0-9a-f]{40}) (\d+) (\d+)", line)
        if m and (at is None or "line" in at):
            at = {"commit": m[1], "original": int(m[2]), "final": int(m[3])}
        elif at is not None and line.startswith("\t"):
            head = known.setdefault(at["commit"], {})
            at |= {"line": line[1:], "original_filename": head.get("filename"), "previous": head.get("previous")}
            out.append(at)
        elif at is not None and " " in line:
            key, _, value = line.partition(" ")
            known.setdefault(at["commit"], {})[key] = value
    return out


def parse_name_status(text: str | None) -> list[tuple[str | None, str | None]]:
    """(old, new) paths of the lines of ``git diff --name-status``."""
    out = []
    for line in (text or "").splitlines():
        status, *paths = line.split("\t")
        if paths:
            kind = status[:1]
            out.append((None if kind == "A" else paths[0], None if kind == "D" else paths[-1]))
    return out
