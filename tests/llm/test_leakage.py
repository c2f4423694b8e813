import random

import pytest

from diffloom.llm import leakage as m

WORDS = [a + b + c for a in ("ba", "de", "fi", "go", "ku") for b in ("lan", "mer", "nis", "por") for c in ("t", "k", "s", "m", "r")]


def text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string, containment string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r.containment for r in m.leaks(d, i, **more).collect()}


def test_words():
    assert m.words_of("<b>Cach</b>ing the­ ​sp​lit `Foo_bar`, Épée") == ["cach", "ing", "the", "split", "foo", "bar", "epee"]
    assert m.words_of("сache") == ["cache"]  # a Cyrillic first letter
    assert m.words_of(None) == m.words_of("") == []


def test_passage():
    assert m.passage_of("a b\nc d\nwhy?") == "a b\nc d"
    assert m.passage_of("only one") == "only one"
    assert m.passage_of(None) == ""


@pytest.mark.parametrize("limit", [m.ITEM_SHINGLES, 0])
def test_matches_brute_force(spark, limit):
    r = random.Random(7)
    items = [(i, text(i, r.randrange(20, 90)) + "\nWhich one is it?") for i in range(40)]
    docs = []
    for d in range(150):
        words = text(1000 + d, r.choice([5, 40, 150, 600, 2500])).split()
        if d % 2:
            passage = m.passage_of(items[r.randrange(40)][1]).split()
            n = max(1, int(len(passage) * r.choice([0.1, 0.35, 0.6, 1.0])))
            part = [w for w in passage[:n] if r.random() > 0.03]
            at = r.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((d, " ".join(words), "x", "y"))
    want = {}
    for d, t, *_ in docs:
        whole = set(m.sequence_of(t).tolist())
        for i, q in items:
            s = set(m.sequence_of(m.passage_of(q)).tolist())
            if (share := len(s & whole) / len(s)) >= m.CONTAINED:
                want[d, i] = share
    got = run(spark, docs, items, item_shingles=limit)
    assert len(want) > 40
    assert set(got) <= set(want)
    assert len(got) >= 0.97 * len(want)
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_shared_passages_short_items_and_edges(spark):
    p = text(1, 60)
    items = [(1, p + "\nWhy?"), (2, p + "\nHow?"), (3, "\nWhy?"), (4, None), (5, "kulant porsek denist gomert fipork balank"), (6, "")]
    docs = [(1, "x y z " + p + " tail", "a", "b"), (1, p, "a", "b"), (2, None, "a", "b"), (3, "", "a", "b"), (4, "Why? How?", "a", "b"), (5, "so kulant porsek denist gomert fipork balank it is", "a", "b"), (6, text(9, 20000) + " " + p, "a", "b")]
    for limit in (m.ITEM_SHINGLES, 0):
        got = run(spark, docs, items, item_shingles=limit)
        assert set(got) == {(1, 1), (1, 2), (5, 5), (6, 1), (6, 2)}
    assert run(spark, [], items) == {}
    assert run(spark, docs, []) == {}


def test_hashes_needed_give_the_recall():
    for item, largest in ((20, 64), (60, 256), (60, 384)):
        n = m.hashes_needed(item, largest)
        common = m.CONTAINED * item
        assert 1 - (1 - common / (largest + item - common)) ** n >= m.RECALL


def test_key_filter(spark):
    import numpy as np

    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000, dtype=np.int64)
    have, others = keys[:500], keys[500:]
    known = m.key_filter(spark.createDataFrame([(int(k),) for k in have], "key bigint"), bits=1 << 20)
    assert len(known) == 1 << 17
    assert set(m.kept(have, known)) == set(have)
    assert len(m.kept(others, known)) < 20
    assert not m.key_filter(spark.createDataFrame([], "key bigint"), bits=1 << 20).any()
