import random

import numpy as np
import pytest

from diffloom.llm import handwritten as h

SCHEMA = "file_id bigint, bug_id string, file_name string, content string, label string"


def code(seed, n=30):
    r = random.Random(seed)
    w = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3))
    shapes = [lambda: f"    {w()} = {w()}({w()}, {r.randrange(99)})", lambda: f"    for {w()} in {w()}:\n        {w()}.append({w()})", lambda: f"    if {w()} > {w()}:\n        return {w()}", lambda: f"def {w()}({w()}, {w()}=None):", lambda: f"    {w()}.{w()}({w()}, \"{w()}\")"]
    return "\n".join(r.choice(shapes)() for _ in range(n)) + "\n"


def accessors(seed):
    r = random.Random(seed)
    return "\n".join(f"  def get_{r.randrange(10**6)}(self):\n    return self._v[{i}]" for i in range(20))


def blob(seed):
    r = random.Random(seed)
    return "T = (\n" + "\n".join("    " + ", ".join(str(r.randrange(256)) for _ in range(16)) + "," for _ in range(20)) + "\n)\n"


MINIFIED = "".join(f"function a{i}(b,c){{return b?c:a{i}(c,{i})}}var d{i}=e.f||{{}};" for i in range(60))


def labels(spark, rows):
    return {r.file_id: r.label for r in h.label_files(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}


def test_labels(spark):
    third = code(1000, 40)
    changed = third.replace("\n", "  # x\n", 1)
    rows = [(i, "alfa-1", f"src/alfa/m{i}.py", code(i)) for i in range(12)] + [(100 + i, "beta-2", f"src/beta/m{i}.py", code(50 + i)) for i in range(12)]
    rows += [
        (201, "alfa-1", "src/alfa/gen.py", "# Code generated by idl v1. DO NOT EDIT.\n" + accessors(1)), (202, "alfa-1", "src/alfa/acc.py", accessors(2)), (203, "alfa-1", "src/alfa/table.py", blob(3)), (204, "alfa-1", "static/a.js", MINIFIED),
        (205, "alfa-1", "vendor/lib/x.py", third), (206, "beta-2", "src/beta/own.py", changed), (207, "beta-2", "third_party/other/y.py", code(77)), (208, "beta-3", "src/beta/speaks.py", "head = 'Code generated by x. DO NOT EDIT.'\n" + code(78)),
        (209, "beta-3", "vendor_api/z.py", code(79)), (210, "beta-3", "src/beta/small.py", code(80) + "T = (1, 2, 3,\n 4, 5, 6, 7, 8, 9)\n"),
    ]
    got = labels(spark, rows)
    want = {201: "generated", 202: "generated", 203: "blob", 204: "minified", 205: "vendored", 206: "vendored", 207: "vendored", 208: "handwritten", 209: "handwritten", 210: "handwritten"}
    assert {k: got[k] for k in want} == want
    assert all(got[i] == "handwritten" for i in got if i < 200)


def test_edges(spark):
    rows = [(1, None, None, None), (2, "a-1", "x.py", ""), (3, "a-1", "a/b/c/d/e/f/x.py", "x = 1"), (None, "a-1", "y.py", "y = 2"), (4, "a-1", "big.py", code(5, 4000)), (4, "a-1", "big.py", code(5, 4000))]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    out = h.label_files(df).collect()
    assert len(out) == len(rows)
    assert {r.label for r in out} == {"handwritten"}
    assert h.label_files(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit_dirs", [10, 1, 2])
def test_propagation_is_exact(spark, unit_dirs):
    """Beliefs on a small tree against the sum over all labellings, as one unit and as several."""
    import itertools
    import math

    rng = random.Random(2)
    dirs = ["", "a", "a/b", "a/b/c", "x"]
    at = ["", "a", "a", "a/b/c", "x"]
    e = [[rng.uniform(-2, 2) for _ in range(5)] for _ in at]
    df = spark.createDataFrame([(i, "p", d, i) for i, d in enumerate(at)], "file_id int, project string, dir string, marks int")
    got = {r.file_id: [r[f"b{k}"] for k in range(5)] for r in h.propagate(df, np.arange(5), np.array(e), unit_dirs).collect()}
    mass = {i: [0.0] * 5 for i in range(5)}
    for lab in itertools.product(range(5), repeat=5):
        of = dict(zip(dirs, lab))
        prior = h.ROOT_PRIOR[of[""]] * math.prod(h.DIR_GIVEN_PARENT[of[d.rpartition("/")[0]]][of[d]] for d in dirs[1:])
        sums = {i: [h.FILE_GIVEN_DIR[of[d]][k] * math.exp(e[i][k]) for k in range(5)] for i, d in enumerate(at)}
        for i in sums:
            others = math.prod(sum(sums[j]) for j in sums if j != i)
            for k in range(5):
                mass[i][k] += prior * others * sums[i][k]
    for i in mass:
        a = [math.log(x) for x in mass[i]]
        assert [x - a[0] for x in a] == pytest.approx([x - got[i][0] for x in got[i]], abs=1e-6)


def test_very_deep_path(spark):
    deep = "/".join(f"d{i}" for i in range(300)) + "/x.py"
    rows = [(1, "a-1", deep, code(1)), (2, "a-1", "vendor/" + deep, code(2)), (3, "a-1", "y.py", code(3))]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    for unit_dirs in (h.UNIT_DIRS, 1):
        assert {r.file_id for r in h.label_files(df, unit_dirs).collect()} == {1, 2, 3}


def test_siblings_decide(spark):
    """A file that looks like any other counts as third-party among copies of third-party files, and not elsewhere."""
    third = [code(900 + i, 40) for i in range(6)]
    rows = [(i, "alfa-1", f"src/m{i}.py", code(i)) for i in range(30)] + [(100 + i, "beta-2", f"src/m{i}.py", code(100 + i)) for i in range(30)]
    rows += [(200 + i, "alfa-1", f"vendor/lib/t{i}.py", t) for i, t in enumerate(third)] + [(300 + i, "beta-2", f"vendor/lib/t{i}.py", t) for i, t in enumerate(third)]
    rows += [(400, "alfa-1", "vendor/lib/own.py", code(777)), (401, "alfa-1", "src/own.py", code(778))]
    got = labels(spark, rows)
    assert got[400] == "vendored"
    assert got[401] == "handwritten"


def test_rates_are_learnt():
    """Marks that no label starts with, but that go with a label's others, become evidence for it."""
    names = list(h.MARKS)
    bit = lambda *x: sum(1 << names.index(n) for n in x)
    marks = np.array([bit("lines"), bit("template", "lines", "tool_name"), bit("template", "lines")])
    before = h.learn(marks, np.array([1.0, 1e-9, 1e-9]))
    after = h.learn(marks, np.array([9000.0, 900.0, 50.0]))
    gain = lambda x: (x[1, 1] - x[1, 0]) - (x[2, 1] - x[2, 0])
    assert gain(after) > gain(before)


def test_bands_find_changed_copies():
    """Recall of two bands met, on texts with a shingle similarity of 0.8."""
    from diffloom.llm import shingling

    a, b = shingling.seeds(h.BANDS * h.ROWS)
    rng = np.random.default_rng(0)
    met = 0
    for _ in range(400):
        both, one, two = (rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) for n in (800, 100, 100))
        x, y = (shingling.bands(shingling.minhash(np.concatenate([both, z]), a, b), h.ROWS) for z in (one, two))
        met += len(np.intersect1d(x, y)) >= h.BANDS_MET
    assert met / 400 > 0.96


@pytest.mark.parametrize(("bug", "project"), [("tarvik-12", "tarvik"), ("a-b-3", "a-b"), ("plain", "plain"), (None, "")])
def test_project(bug, project):
    assert h.project_of(bug) == project
