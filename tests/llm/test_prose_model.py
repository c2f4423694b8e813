import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffloom.llm import prose_model as m

FRAMES = ["The {} {} {} the {} of {} {}.", "Nobody {} the {} before {}, so {} {} were {}.", "If our {} {} a {} {}, its {} must be {} first.", "We never {} {} {} while the {} is {} by {}.", "Why does this {} not {} all {} that {} {} in {}?"]


def prose(seed, n=12):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(r.randrange(2, 4)))
    return " ".join(r.choice(FRAMES).format(*[word() for _ in range(6)]) for _ in range(n))


def spam(spark, texts):
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)]
    return {r.doc_id for r in m.score_pages(spark.createDataFrame(rows, "doc_id bigint, text string, spam string, high double")).filter("spam").collect()}


KEY = ["cheap", "best", "buy", "online", "free", "top"]
PAGES = [
    ", ".join(f"{random.Random(i).choice(KEY)} log viewer {random.Random(i + 99).choice(KEY)}" for i in range(40)), " ".join(random.Random(i).choice([*KEY, "log", "viewer", "merge", "bot"]) for i in range(120)),
    "\n".join(f"frozen commit {i} - https://a{i}.example/x?id={i}" for i in range(25)), " ".join(f"#best{x}Viewer{i}" for i, x in enumerate("LogMergeTestLint" * 2)), "\n".join(f"log viewer in Town{chr(97 + i % 26)}burg" for i in range(40)),
    "Our log viewer is the top log viewer for log viewer users. " * 12, "\n".join(f"Home > Log Viewer > {w.title()} Offer" for w in KEY * 6), "A word before. " + " | ".join(["Log Viewer", "Buy", "Cheap", "Merge Bot"] * 20),
]
TECHNICAL = [
    "Options\n\n" + "\n".join(f"--drop-{i} PATH   limit of the cache, default {i}" for i in range(20)), "\n".join(f" src/lib/file{i}.py | {i} ++--" for i in range(20)),
    "diff --git a/x.py b/x.py\nindex 74a7c6ec..ee8b9a32 100644\n" + "\n".join(f"+    value_{i} = call_{i}(x, {i})" for i in range(20)), "\n".join(f"| run {i} | {i * 3} | {i * 7} |" for i in range(20)),
]


def test_pages(spark):
    told = [prose(i) for i in range(60)] + [prose(99) + "\n\nSee also:\n" + "\n".join(f"{prose(i, 1)} http://x.example/{i}" for i in range(4))]
    texts = [*told, *TECHNICAL, *PAGES]
    got = spam(spark, texts)
    assert got == set(range(len(told) + len(TECHNICAL), len(texts)))


def test_models_decide(spark):
    """With flat models, all n-grams and words alike, no page is flagged: nothing beside the perplexities flags one."""
    texts = [*[prose(i) for i in range(60)], *TECHNICAL, *PAGES]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    real = m.fitted(df)
    flat = m.ProseModel(np.full_like(real.grams, real.grams.mean() / 8), real.words)
    pages = set(range(60 + len(TECHNICAL), len(texts)))
    high = {r.doc_id for r in m.score_pages(df, model=real).filter(F.col("high") >= m.HIGH_SHARE).collect()}
    assert len(high & pages) >= len(pages) / 2  # the class model by itself
    without = {r.doc_id for r in m.score_pages(df, model=flat).filter(F.col("high") >= m.HIGH_SHARE).collect()}
    assert not without
    assert {r.doc_id for r in m.score_pages(df, model=real).filter("spam").collect()} == pages


def test_high_side_on_held_out_pages(spark):
    """Pages and prose of another seed than the model's."""
    model = m.fitted(spark.createDataFrame([(i, prose(i)) for i in range(80)], "doc_id bigint, text string"))
    r = random.Random(7)
    salad = [" ".join(r.choice([*KEY, "log", "viewer", "merge", "bot"]) for _ in range(60)) for _ in range(40)]
    out = m.score([*[prose(1000 + i) for i in range(40)], *salad], model)
    flagged = out["high"] >= m.HIGH_SHARE
    assert flagged[:40].sum() == 0
    assert flagged[40:].sum() >= 38


def test_learning_bits():
    """Against counts kept token by token."""
    import math
    from collections import Counter

    rng = random.Random(4)
    items, page = [rng.randrange(5) for _ in range(400)], sorted(rng.randrange(6) for _ in range(400))
    base = [(i + 1) / 20 for i in items]
    got = m.learning_bits(np.array(page), np.array(items, np.uint64), np.array(base), (1, 2))
    seen, kept = Counter(), []
    for i, (p, w) in enumerate(zip(base, items)):
        at = page[i]
        for size in (1, 2):
            context = tuple(items[max(0, i - size) : i]) if i >= size else (0,) * (size - i) + tuple(items[:i])
            p = (seen[at, size, context, w] + p) / (seen[at, size, context] + 1)
        for size in (1, 2):
            context = tuple(items[max(0, i - size) : i]) if i >= size else (0,) * (size - i) + tuple(items[:i])
            seen[at, size, context] += 1
            seen[at, size, context, w] += 1
        kept.append(-math.log2(p))
    assert got == pytest.approx(kept)


def test_edges(spark):
    texts = [None, "", "  \n ", "!!!", "word", prose(1), prose(1), "x" * 200_000, "lorem " + "buy viewer " * 20_000]
    got = spam(spark, texts)
    assert 8 in got and not got & {0, 1, 2, 3, 4, 5, 6}
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert m.score_pages(empty).count() == 0
    assert m.train(empty).count() == 0
    assert spam(spark, [None, ""]) == set()


def test_classes():
    ((classes, letters, words),) = m.sentences("The quick `foo_bar` reads lib/a.py in 3 #tags.")
    assert classes == "DwcwpPnt."
    assert len(words) == 5
    p = m.read(["Aa bb cc dd ee ff gg hh the ii."])
    last = [int(g) % m.N_CLASSES for g in p.grams[p.counted]]
    n = len(m.GROUPS)
    assert last[:8] == [n, n + 1, n + 2, n + 3, n + 4, n + 5, n + 5, n + 5][: len(last[:8])]
    assert last[8:10] == [m.GROUPS.index("D"), n]


def test_sentences_of_a_portion_dont_mix():
    one, two = m.read(["The a b."]), m.read(["The a b.", None, "The a b."])
    assert (two.grams[two.counted] == np.tile(one.grams[one.counted], 2)).all()
    assert two.page.tolist() == [0, 2]


def test_model_sums_to_one():
    p = m.read([prose(i) for i in range(20)])
    grams, n = np.unique(p.grams[p.counted], return_counts=True)
    model = m.fit(grams, n.astype(float))
    assert np.exp2(-model.grams.reshape(-1, m.N_CLASSES)).sum(1) == pytest.approx(1, abs=1e-3)
    assert model.words.sum() <= 1
