import pytest
from pyspark.sql import functions as F

from diffloom.llm import mixing as m
from diffloom.llm.queries import TOKENIZER

DOCS = "doc_id bigint, text string, source string, tokens int, slot int"
TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, sizes, words=6):
    rows = [(i, " ".join(["word"] * (words + i % 5)), s, 1, 1) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("slots", [{"a": 5, "b": 3, "c": 2}, {"a": 9, "b": 1}, {"a": 1}, {"a": 370, "b": 311, "c": 190, "d": 129}, {x: 1 + ord(x) % 5 for x in "abcdefghijklmn"}])
def test_no_source_strays_by_a_block(slots):
    taken, period = dict.fromkeys(slots, 0), sum(slots.values())
    for slot, (s, i) in enumerate(m.pfair(slots), 1):
        assert i == taken[s]
        taken[s] += 1
        assert all(abs(taken[x] - k * slot / period) < 1 for x, k in slots.items())
    assert taken == slots


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.99999, "b": 0.00001}, {"a": 1.0}])
def test_each_period_gives_the_weights(weights):
    slots, block = m.blocks_of(weights, 1000)
    every = sum(slots[s] * block[s] for s in slots)
    assert all(slots[s] * block[s] / every == pytest.approx(w) for s, w in weights.items())
    assert max(block.values()) <= 500


def strays(mixture, targets, skip=()):
    """The greatest distance of a source's tokens from its share after any slot: of the slots' tokens and of all tokens so far."""
    taken, every, far, ahead, last = dict.fromkeys(targets, 0), 0, 0.0, 0.0, 0
    rows = mixture.selection.groupBy("slot", "source").agg(F.sum("tokens").alias("tokens"), F.collect_list("doc_id").alias("ids")).orderBy("slot").collect()
    for r in rows:
        clock = (r.slot + 1) / mixture.period_slots * mixture.period_tokens
        taken[r.source] += r.tokens
        every += r.tokens
        if not set(r.ids) & set(skip):
            far = max([far, *(abs(taken[x] - w * clock) for x, w in targets.items())])
            ahead = max([ahead, *(abs(taken[x] - w * every) for x, w in targets.items())])
        last = r.slot
    return far, ahead, last


def test_shares_caps_and_deviation(spark):
    d = docs(spark, {"a": 3000, "b": 300, "c": 900, "other": 50})
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2), ("none", 0.1, 3)], TARGETS)
    mix = m.mix(d, t, TOKENIZER, block_tokens=200)
    s = {r.source: r for r in mix.shares.collect()}
    assert set(s) == {"a", "b", "c"}
    for r in s.values():
        assert r.share == pytest.approx(r.target_share, abs=0.01)
        assert r.repeats <= r.max_repeats + 1e-9
    copies = mix.selection.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("copy_no").alias("k"), F.first("source").alias("source")).collect()
    assert all(r.n == r.k <= s[r.source].max_repeats for r in copies)
    assert max(x.repeats / x.max_repeats for x in s.values()) > 0.98  # as large as the caps allow
    far, ahead, last = strays(mix, {x: s[x].target_share for x in s})
    assert far < 200
    assert ahead < 200
    assert last > 100


def test_a_very_long_document_leaves_the_others_slots(spark):
    """The slots of the other sources are the same with and without it, and they stay within a block."""
    d = docs(spark, {"a": 3000, "b": 3000})
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], TARGETS)
    long = spark.createDataFrame([(99_999, "long " * 8_000, "a", 1, 1)], DOCS)
    short, mixed = (m.mix(x, t, TOKENIZER, block_tokens=200, total_tokens=70_000) for x in (d, d.unionByName(long)))
    of_b = [{(r.doc_id, r.copy_no): r.slot for r in x.selection.filter("source = 'b'").collect()} for x in (short, mixed)]
    assert of_b[0] == of_b[1]
    taken = 0
    for r in mixed.selection.filter("source = 'b'").orderBy("slot", "start").collect():
        taken += r.tokens
        assert abs(taken - (r.slot + 1) / mixed.period_slots * mixed.period_tokens / 2) < 200
    slots = [r.slot for r in mixed.selection.filter("source = 'a'").orderBy("slot").collect()]
    assert 99_999 in {r.doc_id for r in mixed.selection.collect()}
    assert max(b - a for a, b in zip(slots, slots[1:])) > 60  # its source pays back, half before and half after


def test_smaller_total(spark):
    d, t = docs(spark, {"a": 100, "b": 100}), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    half = m.mix(d, t, TOKENIZER, total_tokens=400)
    assert half.selection.agg(F.sum("tokens")).first()[0] == pytest.approx(400, abs=12)
    assert m.mix(d, t, TOKENIZER, total_tokens=10**9).total_tokens == m.mix(d, t, TOKENIZER).total_tokens


def test_edges(spark):
    d = docs(spark, {"a": 10}).unionByName(spark.createDataFrame([(0, "word word", "a", 1, 1), (50, None, "a", 1, 1), (51, "", "a", 1, 1), (52, "x", None, 1, 1), (53, "long " * 50_000, "a", 1, 1)], DOCS))
    t = spark.createDataFrame([("a", 0.4, 2), ("a", 0.2, 1), ("b", None, 1), (None, 0.1, 1), ("c", 0.3, 0)], TARGETS)
    mix = m.mix(d, t, TOKENIZER)
    ids = [r.doc_id for r in mix.selection.collect()]
    assert sorted(ids) == [*range(10), 53]
    assert mix.shares.first().share == 1.0
    for empty in (m.mix(d.limit(0), t, TOKENIZER), m.mix(d, t.limit(0), TOKENIZER)):
        assert empty.selection.count() == 0
        assert empty.shares.count() == 0


def test_tokens(spark):
    got = {r.doc_id: r.tokens for r in m.count_tokens(spark.createDataFrame([(1, "Hello world", "a", 1, 1), (2, "", "a", 1, 1), (3, None, "a", 1, 1)], DOCS), TOKENIZER).collect()}
    assert got == {1: 2, 2: 0, 3: 0}
