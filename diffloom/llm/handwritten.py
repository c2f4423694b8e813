"""Source files nobody wrote by hand: belief propagation over directory trees.

Every file has one of five labels, and so has every directory, as the kind of files it mostly holds. What is seen of a file
is a set of marks: how its lines repeat, how dense it is, how much of it is data, notices, names, and whether other
projects hold the same text. How likely each mark is under each label is learnt from the counts of all sets of marks, by
expectation maximisation from stated starting rates. The marks are evidence for a file's own label, a directory's name
for its directory's. Messages go from the files up to the root of their project and down again, which is exact on a tree, so
that a file's parent and siblings decide where its own evidence is weak.

Trees are worked on in units: subtrees of a bounded number of directories, each in one task, then the few large directories
above them, then the units again. The number of jobs doesn't depend on the depth.

Copies of third-party code are recognised by their content: five-word shingles, MinHash bands and the number of
projects that hold the same band. Bands are aggregated, never expanded into pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffloom.llm import shingling
from diffloom.session import cut

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")

# P(child's label | its directory's label), rows by the directory's label.
FILE_GIVEN_DIR = (
    (0.90, 0.04, 0.01, 0.03, 0.02),
    (0.12, 0.82, 0.02, 0.02, 0.02),
    (0.15, 0.02, 0.77, 0.03, 0.03),
    (0.004, 0.01, 0.01, 0.97, 0.006),
    (0.30, 0.03, 0.02, 0.02, 0.63),
)
DIR_GIVEN_PARENT = (
    (0.90, 0.03, 0.02, 0.03, 0.02),
    (0.10, 0.84, 0.02, 0.02, 0.02),
    (0.10, 0.02, 0.80, 0.05, 0.03),
    (0.005, 0.005, 0.005, 0.98, 0.005),
    (0.25, 0.02, 0.02, 0.02, 0.69),
)
ROOT_PRIOR = (0.90, 0.03, 0.02, 0.03, 0.02)

# Evidence of directory names, as natural logs against handwritten.
DIR_NAMES = {
    "vendored": (8.0, "vendor vendors vendored third_party third-party thirdparty node_modules bower_components deps _vendor extern external externals contrib site-packages"),
    "generated": (2.5, "gen generated autogen auto_generated codegen __generated__"),
    "minified": (1.0, "dist static assets bundle bundles min"),
    "blob": (0.5, "data fixtures blobs"),
}

#: The marks of a file, with the rates at which expectation maximisation starts, by label.
MARKS = {
    "generator": (0.003, 0.60, 0.05, 0.02, 0.15),  # a comment at an end of the file says that a tool made it
    "template": (0.003, 0.80, 0.05, 0.02, 0.05),  # lines repeat the shapes of lines before
    "tool_name": (0.003, 0.30, 0.02, 0.02, 0.02),  # named as tools name their output
    "minified_name": (0.003, 0.02, 0.40, 0.02, 0.02),
    "dense": (0.003, 0.02, 0.90, 0.03, 0.05),  # short names and hardly a blank
    "data": (0.003, 0.10, 0.03, 0.02, 0.95),  # most letters of its code are in data
    "notice": (0.05, 0.05, 0.10, 0.30, 0.03),  # one word of licence, release or origin in comments at the ends, not the project's own
    "notices": (0.005, 0.02, 0.10, 0.50, 0.02),  # several such words
    "lines": (0.90, 0.90, 0.20, 0.95, 0.10),  # has some lines that are neither data nor comments
    "copied": (0.0005, 0.02, 0.10, 0.80, 0.02),  # another project holds the same text
}
START_SHARES = (0.80, 0.06, 0.04, 0.06, 0.04)
#: The starting rates count as so many files of each label, and the updates are this many.
START_FILES, UPDATES = 50.0, 100

#: Share of lines that repeat the shape of a line up to four lines before, from which a body counts as a template.
TEMPLATE_SHARE, TEMPLATE_LINES = 0.75, 6
#: Share of letters in data from which a file is mainly data; share of short names, and most blanks, of dense code.
DATA_SHARE, SHORT_NAMES, DENSE_BLANKS, DENSE_LETTERS = 0.55, 0.4, 0.09, 200

#: Five words a shingle; bands for a similarity of 0.8: at least two of 16 bands of 5 are met with probability 0.985.
SHINGLE, BANDS, ROWS, BANDS_MET = 5, 16, 5, 2
#: Files without a text class are spread over so many keys where text classes are joined.
SALTS = 1024
#: Directories of a unit at most.
UNIT_DIRS = 20_000

_COMMENT = re.compile(r"\s*(?:#(?!include|!|define|pragma|if|endif)|//|/\*|\*|--|;|%|<!--|\"\"\"|''')")
_GENERATOR = re.compile(
    r"(?i)\b(?:auto|automatically|machine)[ -]?(?:generated|made|written|created)\b|\bgenerated (?:by|from|code|file|with)\b|@generated|\bcode generated\b|"
    r"\bdo not (?:edit|modify|change|touch)\b|\bauto-?gen"
)
_NOTICE = re.compile(r"(?i)\blicen[cs]ed?\b|\bpermission|\bspdx|\bupstream\b|\ball rights reserved\b|\bcopyright\b|\(c\)|\bv?\d+\.\d+\.\d+\b")
_TOOL_NAME = re.compile(r"(?i)(?:^|/)zz_generated|_pb2(?:_grpc)?\.\w+$|\.pb\.\w+$|\.g\.\w+$|\.tab\.\w+$|\.gen(?:erated)?\.\w+$|_generated\.\w+$|\.designer\.\w+$")
_MIN_NAME = re.compile(r"(?i)[.-]min\.\w+$|\.bundle\.\w+$|\.chunk\.\w+$|\.[0-9a-f]{8,}\.\w+$")
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'')
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_DIGITS = re.compile(r"\d+")
_HEX = re.compile(r"0[xX][0-9a-fA-F]+")
_RECORD = re.compile(r"^[\w.+-]+(?:[,;\t|] *[\w. +-]*){2,}$")
_BASE64 = re.compile(r"[A-Za-z0-9+/=]{60,}")
_WORD = re.compile(r"\w+")
_PROJECT = re.compile(r"-\d+$")


#: Comments among so many first and last lines are looked at for notices.
FIRST_LINES, LAST_LINES = 12, 3


def content_marks(name: str, text: str, project: str) -> int:
    """The marks of a file's name and whole text, as bits in the order of :data:`MARKS`; copies are none of them."""
    lines = [x for line in text.splitlines() if (x := line.strip())]
    code, comments = [], []
    for i, line in enumerate(lines):
        (comments if _COMMENT.match(line) else code).append((i, line))
    edges = [line for i, line in comments if i < FIRST_LINES or i >= len(lines) - LAST_LINES]
    total = blob = 0
    shapes: list[str] = []
    for _, line in code:
        total += len(line)
        bare = _HEX.sub("0", _STRING.sub("s", line))
        names = _NAME.findall(bare)
        if (len(line) > 12 and not [n for n in names if n != "s"]) or _RECORD.match(line.strip("\"'`;,")) or _BASE64.search(line):
            blob += len(line)
        else:
            shapes.append(_DIGITS.sub("0", _NAME.sub("w", bare)))
    data = total > 0 and blob / total >= DATA_SHARE
    n = len(shapes)
    template = max((sum(map(str.__eq__, shapes, shapes[p:])) / (n - p) for p in (1, 2, 3, 4)), default=0.0) if n >= TEMPLATE_LINES else 0.0
    names = _NAME.findall(text)
    short = sum(len(x) <= 2 for x in names) / len(names) if names else 0.0
    blanks = len(text.split()) / len(text) if text else 1.0
    dense = len(text) >= DENSE_LETTERS and short >= SHORT_NAMES and blanks <= DENSE_BLANKS
    notices = {m.lower() for x in edges if not (project and project in x.lower()) for m in _NOTICE.findall(x)}
    marks = (
        any(_GENERATOR.search(x) for x in edges), template >= TEMPLATE_SHARE and not data, _TOOL_NAME.search(name), _MIN_NAME.search(name), dense and not data, data,
        len(notices) == 1, len(notices) > 1, n >= TEMPLATE_LINES,
    )
    return sum(1 << i for i, m in enumerate(marks) if m)


def project_of(bug: str | None) -> str:
    """The project of a bug_id: without the number at its end."""
    return _PROJECT.sub("", bug or "")


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    a, b = shingling.seeds(BANDS * ROWS)
    for pdf in batches:
        rows = []
        for key, bug, name, text in zip(pdf["file_id"], pdf["bug_id"], pdf["file_name"], pdf["content"]):
            name = (name or "").replace("\\", "/").strip("/")
            text = text if isinstance(text, str) else ""
            project = project_of(bug)
            words = shingling.shingles(shingling.word_hashes(_WORD.findall(text)), SHINGLE)
            keys = shingling.bands(shingling.minhash(words, a, b), ROWS) if len(words) >= SHINGLE else np.empty(0, np.int64)
            rows.append((key, project, name.rpartition("/")[0], content_marks(name, text, project), keys, int(shingling.mixed(keys.view(np.uint64)).sum().view(np.int64)) if len(keys) else None))
        yield pd.DataFrame(rows, columns=["file_id", "project", "dir", "marks", "bands", "text_class"])


def marked(files: DataFrame) -> DataFrame:
    """(file_id, project, dir, marks) of every file.

    A null content or name has no marks. Files whose text, up to small changes, is also in another project are copied.
    """
    kind = files.schema["file_id"].dataType.simpleString()
    schema = f"file_id {kind}, project string, dir string, marks int, bands array<bigint>, text_class bigint"
    found = cut(files.select("file_id", "bug_id", "file_name", "content").mapInPandas(_marks, schema))
    # equal texts first: a third of all files may be one text
    texts = found.filter(F.col("text_class").isNotNull()).groupBy("text_class").agg(F.first("bands").alias("bands"), F.min("project").alias("p0"), F.max("project").alias("p1"))
    keys = texts.select("text_class", "p0", "p1", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("p0").alias("p0"), F.max("p1").alias("p1")).filter("p0 < p1").select("band")
    copies = keys.select("text_class", "band").join(shared, "band").groupBy("text_class").agg(F.count(F.lit(1)).alias("met"))
    copies = copies.filter(F.col("met") >= BANDS_MET).select("text_class", F.lit(0).alias("salt"), F.lit(1 << list(MARKS).index("copied")).alias("copied"))
    # short texts have no class: their nulls would all be one task
    salt = F.when(F.col("text_class").isNull(), F.pmod(F.xxhash64("file_id", "dir"), F.lit(SALTS))).otherwise(0).cast("int")
    joined = found.drop("bands").withColumn("salt", salt).join(copies, ["text_class", "salt"], "left")
    return joined.select("file_id", "project", "dir", (F.col("marks") + F.coalesce("copied", F.lit(0))).alias("marks"))


def learn(marks: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Natural logs of the likelihood of each of ``marks`` (sets of marks, each ``n`` times) under each label.

    Expectation maximisation of a latent class model: marks are independent given the label.
    """
    on = ((marks[:, None] >> np.arange(len(MARKS))) & 1).astype(float)
    start, shares0 = np.array(list(MARKS.values())), np.array(START_SHARES)
    rates, shares = start, shares0
    for _ in range(UPDATES):
        logs = on @ np.log(rates) + (1 - on) @ np.log(1 - rates)
        weight = np.log(shares) + logs
        weight = np.exp(weight - weight.max(1, keepdims=True))
        weight *= (n / weight.sum(1))[:, None]
        each = weight.sum(0)
        rates = (on.T @ weight + START_FILES * start) / (each + START_FILES)
        shares = (each + START_FILES * shares0) / (each.sum() + START_FILES)
    return on @ np.log(rates) + (1 - on) @ np.log(1 - rates)


def _through(logs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Logs of the sums over k of ``table[j][k]`` times the exponential of ``logs[..., k]``."""
    top = logs.max(-1, keepdims=True)
    return top + np.log(np.exp(logs - top) @ table.T)


_FILE, _DIR = np.array(FILE_GIVEN_DIR), np.array(DIR_GIVEN_PARENT)
M, P, T = ([f"{x}{k}" for k in range(5)] for x in "mpt")


def _name_evidence(path: str) -> list[float]:
    last = path.rpartition("/")[2].lower()
    return [0.0, *(weight if last in names.split() else 0.0 for weight, names in (DIR_NAMES[x] for x in LABELS[1:]))]


class Tree:
    """A tree of directories below ``root``, from those of ``paths`` with their evidence; directories between are added."""

    def __init__(self, root: str, paths: list[str], evidence: np.ndarray):
        self.at: dict[str, int] = {}
        parents: list[int] = []
        depths: list[int] = []

        def add(path: str) -> int:
            chain = []
            while path not in self.at and path != root:
                chain.append(path)
                path = path.rpartition("/")[0]
            if path not in self.at:  # the root itself
                self.at[path] = len(parents)
                parents.append(-1)
                depths.append(0)
            above = self.at[path]
            for p in reversed(chain):
                self.at[p] = len(parents)
                parents.append(above)
                depths.append(depths[above] + 1)
                above = self.at[p]
            return above

        own = [add(p) for p in paths]
        self.parents, self.depths = np.array(parents), np.array(depths)
        self.belief = np.array([_name_evidence(p) for p in self.at])
        np.add.at(self.belief, own, evidence)
        self.own = np.array(own)
        # up, level by level
        self.sent = np.zeros_like(self.belief)
        order = np.argsort(self.depths, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(self.depths[order])) + 1)
        for level in reversed(self.levels):
            self.sent[level] = _through(self.belief[level], _DIR)
            if level[0] != 0:
                np.add.at(self.belief, self.parents[level], self.sent[level])

    def down(self, above: np.ndarray | None) -> np.ndarray:
        """Log beliefs of all directories, given the log belief of the root's parent without the root's message."""
        out = self.belief.copy()
        out[0] += np.log(ROOT_PRIOR) if above is None else _through(above, _DIR.T)
        for level in self.levels[1:]:
            out[level] += _through(out[self.parents[level]] - self.sent[level], _DIR.T)
        return out


def _up_unit(pdf: pd.DataFrame) -> pd.DataFrame:
    """The message of a unit's root to its parent."""
    unit = pdf["unit"].iloc[0]
    tree = Tree(unit, pdf["dir"].tolist(), pdf[M].to_numpy())
    return pd.DataFrame([[pdf["project"].iloc[0], unit.rpartition("/")[0], *tree.sent[0]]], columns=["project", "dir", *M])


def _top(pdf: pd.DataFrame) -> pd.DataFrame:
    """Beliefs of a project's large directories."""
    pdf = pdf.sort_values("dir")
    tree = Tree("", pdf["dir"].tolist(), pdf[M].to_numpy())
    found = tree.down(None)[tree.own]
    return pd.DataFrame(found, columns=P).assign(project=pdf["project"].iloc[0], dir=pdf["dir"].to_numpy())[["project", "dir", *P]]


def _down_unit(pdf: pd.DataFrame) -> pd.DataFrame:
    """Beliefs of a unit's directories; t is the belief of its root's parent, null where the root is the project's."""
    tree = Tree(pdf["unit"].iloc[0], pdf["dir"].tolist(), pdf[M].to_numpy())
    above = pdf[T].iloc[0].to_numpy(float)
    found = tree.down(None if np.isnan(above).any() else above - tree.sent[0])[tree.own]
    return pd.DataFrame(found, columns=P).assign(project=pdf["project"].to_numpy(), dir=pdf["dir"].to_numpy())[["project", "dir", *P]]


_DOUBLES = lambda names: ", ".join(f"{n} double" for n in names)


def _ancestors(path: Column) -> Column:
    """``path``, all directories above it, and '' for the root."""
    parts = F.split(path, "/")
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))


def directory_beliefs(dirs: DataFrame, unit_dirs: int = UNIT_DIRS) -> DataFrame:
    """(project, dir, p0..p4): log beliefs of the directories of ``dirs`` (project, dir, m0..m4), each once, m the sums of their files' messages.

    Each project has one tree. Directories without files of their own are nodes too. ``unit_dirs`` changes the plan, never the
    rows: a directory with more than so many below it is large, and a unit is what lies below a large one's child that isn't.
    """
    above = dirs.select("project", "dir", F.explode(_ancestors(F.col("dir"))).alias("above"))
    large = cut(above.groupBy("project", "above").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > unit_dirs).select("project", "above"))
    depth = F.when(F.col("above") == "", 0).otherwise(F.size(F.split("above", "/")))
    deepest = above.join(large, ["project", "above"]).groupBy("project", "dir").agg(F.max(depth).alias("d"))
    parts = F.split("dir", "/")
    unit = F.when(F.col("d").isNull(), "").when((F.col("d") < F.size(parts)) & (F.col("dir") != ""), F.array_join(F.slice(parts, 1, F.col("d") + 1), "/"))
    placed = cut(dirs.join(deepest, ["project", "dir"], "left").select("project", "dir", *M, unit.alias("unit")))
    small = placed.filter("unit IS NOT NULL")
    # the large directories: their files' messages, and those of the units below them
    sent = small.filter("unit <> ''").groupBy("project", "unit").applyInPandas(_up_unit, f"project string, dir string, {_DOUBLES(M)}")
    own = large.select("project", F.col("above").alias("dir"), *[F.lit(0.0).alias(m) for m in M])
    tops = own.unionByName(placed.filter("unit IS NULL").select("project", "dir", *M)).unionByName(sent).groupBy("project", "dir").agg(*[F.sum(m).alias(m) for m in M])
    top = cut(tops.groupBy("project").applyInPandas(_top, f"project string, dir string, {_DOUBLES(P)}"))
    parent = F.when(F.col("unit") == "", None).otherwise(F.when(F.col("unit").contains("/"), F.regexp_replace("unit", r"/[^/]*$", "")).otherwise(""))
    told = small.withColumn("parent", parent).join(top.select("project", F.col("dir").alias("parent"), *[F.col(p).alias(t) for p, t in zip(P, T)]), ["project", "parent"], "left")
    below = told.groupBy("project", "unit").applyInPandas(_down_unit, f"project string, dir string, {_DOUBLES(P)}")
    return below.unionByName(top.join(placed.filter("unit IS NULL").select("project", "dir"), ["project", "dir"], "left_semi"))


def propagate(files: DataFrame, marks: np.ndarray, logs: np.ndarray, unit_dirs: int = UNIT_DIRS) -> DataFrame:
    """(file_id, label, b0..b4): log beliefs of every file of ``files`` (file_id, project, dir, marks).

    ``logs`` has the log likelihoods of each of ``marks``. Files of one directory with the same marks are one case.
    """
    spark = files.sparkSession
    sent = _through(logs, _FILE)
    table = spark.createDataFrame(pd.DataFrame(np.column_stack([marks, sent]), columns=["marks", *M]).astype({"marks": "int32"}), f"marks int, {_DOUBLES(M)}") if len(marks) else None
    if table is None:
        return files.select("file_id", F.lit(LABELS[0]).alias("label"), *[F.lit(0.0).alias(f"b{k}") for k in range(5)])
    cases = cut(files.groupBy("project", "dir", "marks").agg(F.count(F.lit(1)).alias("n")))
    known = cases.join(F.broadcast(table), "marks")  # a row for each set of marks: 1024 at most
    dirs = cut(known.groupBy("project", "dir").agg(*[F.sum(F.col("n") * F.col(m)).alias(m) for m in M]))
    beliefs = directory_beliefs(dirs, unit_dirs)
    row = {int(x): i for i, x in enumerate(marks)}

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(LABELS)
        for pdf in batches:
            at = [row[x] for x in pdf["marks"]]
            b = logs[at] + _through(pdf[P].to_numpy() - sent[at], _FILE.T)
            yield pd.DataFrame(b, columns=[f"b{k}" for k in range(5)]).assign(label=names[b.argmax(1)], project=pdf["project"].to_numpy(), dir=pdf["dir"].to_numpy(), marks=pdf["marks"].to_numpy())

    decided = cases.join(beliefs, ["project", "dir"]).select("project", "dir", "marks", *P)
    decided = decided.mapInPandas(decide, f"{_DOUBLES([f'b{k}' for k in range(5)])}, label string, project string, dir string, marks int")
    return files.join(decided, ["project", "dir", "marks"]).select("file_id", "label", *[f"b{k}" for k in range(5)])


def label_files(files: DataFrame, unit_dirs: int = UNIT_DIRS) -> DataFrame:
    """(file_id, label, beliefs) of every row of ``files`` (file_id, bug_id, file_name, content).

    Repeated rows are labelled each; ties go to the earlier of :data:`LABELS`, so an empty or null content in an ordinary
    folder is handwritten. A null bug_id or file_name is an empty one. Other columns are ignored. An empty table gives an
    empty frame.
    """
    found = cut(marked(files))
    counts = found.groupBy("marks").agg(F.count(F.lit(1)).alias("n")).toPandas()  # 1024 rows at most
    marks = counts["marks"].to_numpy(np.int64)
    return propagate(found, marks, learn(marks, counts["n"].to_numpy(float)), unit_dirs)
