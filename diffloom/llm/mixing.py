"""Mixing sources to target weights: Pfair block scheduling.

Sizes are tokens of a public tokenizer. The total is the largest that every source can give its share of, without
taking a document more often than the source allows. Each source's documents, in a fixed scattered order, repeated as
often as needed, form one stream that is cut into blocks. A source with k of the P slots of a period has its block i
released at slot floor(i P / k) and due at ceil((i + 1) P / k); of the released blocks, each slot takes the one that is due
first. After any slot every source is then less than one block from its share of the slots.

One period is scheduled, and the schedule repeats, so that the number of slots has no bound. k is a source's weight in
slots, rounded up; the source's blocks are smaller by as much as that rounds, so that each period gives the exact weights.
A document belongs to the block in which its middle lies. One that is longer than a block leaves the blocks it covers
without another document: its source pays back what it took ahead, and the slots of the other sources are as they were.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from diffloom.session import cut

#: The pattern that cuts texts before a byte-level BPE (fixed by the tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens by which no source may stray from its share, documents longer than that set apart.
BLOCK_TOKENS = 16_384
#: Slots of one period, before rounding.
PERIOD = 4096
#: Into so many parts the documents of a source are ordered, so that no source is in one task.
PARTS = 1024


def count_tokens(documents: DataFrame, tokenizer: str, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, source, tokens) of every document; a null text has 0 tokens. The rank file (about 1 MB) goes to the tasks."""
    ranks_file = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    kind = documents.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.value.splitlines()) if a}
        encoder = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            sizes = [len(encoder.encode_ordinary(t)) if isinstance(t, str) else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": sizes})

    return documents.select("doc_id", "source", "text").mapInPandas(count, f"doc_id {kind}, source string, tokens bigint")


def pfair(slots: dict[str, int]) -> list[tuple[str, int]]:
    """(source, number of its block, from 0) of each slot of one period: earliest deadline first among released blocks.

    ``slots`` has the slots of each source, at least 1; the period is their sum. A block that every source has in time
    always exists, as the weights sum to 1.
    """
    period = sum(slots.values())
    release = lambda s, i: i * period // slots[s]
    due = lambda s, i: -(-(i + 1) * period // slots[s])
    waiting = [(0, due(s, 0), s, 0) for s in sorted(slots)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            r, d, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (d, r, s, i))
        _, _, s, i = heapq.heappop(ready)
        out.append((s, i))
        heapq.heappush(waiting, (release(s, i + 1), due(s, i + 1), s, i + 1))
    return out


def blocks_of(weights: dict[str, float], block_tokens: float, period: int = PERIOD) -> tuple[dict[str, int], dict[str, float]]:
    """Slots in a period, and tokens in a block, of each source.

    A source's blocks are at most half of ``block_tokens``: the other half is for the document whose middle a block's end
    doesn't reach. Blocks of a source with few slots are smaller still; what the others' roundings add is taken off.
    """
    slots = {s: max(1, math.ceil(w * period - 1e-9)) for s, w in weights.items()}
    largest = block_tokens / 2 / (1 + sum(1 / k for k in slots.values()))
    every = largest * min(slots[s] / w for s, w in weights.items())
    return slots, {s: w * every / slots[s] for s, w in weights.items()}


@dataclass(frozen=True)
class Mixture:
    """selection (doc_id, source, copy_no, tokens, slot, start), shares by source, and the tokens of a period and its slots."""

    selection: DataFrame
    shares: DataFrame
    total_tokens: float
    period_tokens: float
    period_slots: int


SELECTION = "source string, copy_no int, tokens bigint, slot bigint, start bigint"
SHARES = "source string, target_share double, max_repeats int, tokens_available bigint, tokens_taken bigint, share double, repeats double"


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str, total_tokens: float | None = None, block_tokens: int = BLOCK_TOKENS) -> Mixture:
    """Select and order documents so that each source of ``targets`` (source, target_share, max_repeats) gives its share.

    Sorted by (slot, start) the selection is the mixture. Documents of other or no sources, and those without tokens,
    take no part; a repeated doc_id is one document. A target of null or 0 share or repeats, or without documents, gives
    nothing and the other shares are scaled up; a source named twice has the sum of its shares and the smaller cap.
    ``total_tokens`` asks for less than the largest total; more isn't given. No documents give an empty selection.

    After any slot, each source's tokens differ from its share of the tokens of the slots so far by less than
    ``block_tokens``, or by half of that and half of a document where that document is longer than ``block_tokens``.
    ``tokenizer`` is the path of a byte-level BPE's rank file.
    """
    spark = documents.sparkSession
    wanted = targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source")
    wanted = wanted.agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    goals = {r.source: (float(r.target_share), int(r.max_repeats)) for r in wanted.collect()}  # a table of sources, not of documents
    kept = count_tokens(documents.filter(F.col("source").isin(*goals)) if goals else documents.limit(0), tokenizer).filter("tokens > 0")
    sized = cut(kept.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("x")).select("doc_id", "x.source", "x.tokens"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    parts = cut(sized.groupBy("source", part.alias("part")).agg(F.sum("tokens").alias("tokens")))
    sums = parts.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()  # a row a source
    have = {r.source: int(r.tokens) for r in sums}
    kind = documents.schema["doc_id"].dataType.simpleString()
    if not have:
        return Mixture(spark.createDataFrame([], f"doc_id {kind}, {SELECTION}"), spark.createDataFrame([], SHARES), 0.0, 0.0, 0)
    scale = sum(goals[s][0] for s in have)
    weights = {s: goals[s][0] / scale for s in have}
    most = min(goals[s][1] * have[s] / weights[s] for s in have)
    total = min(most, total_tokens) if total_tokens else most
    slots, block = blocks_of(weights, block_tokens)

    bases = parts.withColumn("base", F.sum("tokens").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("source", "part").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("part", part).withColumn("before", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    placed = placed.join(bases.select("source", "part", F.coalesce("base", F.lit(0)).alias("base")), ["source", "part"])
    placed = placed.select("doc_id", "source", "tokens", (F.col("base") + F.col("before")).alias("begin"))
    needs = [(s, float(weights[s] * total), have[s], goals[s][1], block[s], slots[s]) for s in sorted(have)]
    needs = spark.createDataFrame(needs, "source string, need double, have bigint, cap int, block double, slots bigint")
    # a copy is taken while its middle lies within what the source has to give
    last = F.ceil((F.col("need") - F.col("begin") - F.col("tokens") / 2) / F.col("have")).cast("int")
    copies = placed.join(F.broadcast(needs), "source").withColumn("n", F.greatest(F.least(last, "cap"), F.lit(0)))
    copies = copies.filter("n > 0").select("doc_id", "source", "tokens", "begin", "have", "block", "slots", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"))
    copies = copies.withColumn("start", F.col("begin") + (F.col("copy_no") - 1) * F.col("have"))
    plan = pfair(slots)
    schedule = spark.createDataFrame([(s, i, slot) for slot, (s, i) in enumerate(plan)], "source string, turn bigint, slot bigint")  # PERIOD rows and one a source
    number = F.floor((F.col("start") + F.col("tokens") / 2) / F.col("block"))
    numbered = copies.withColumn("no", number).withColumn("turn", F.pmod("no", "slots")).withColumn("period", F.floor(F.col("no") / F.col("slots")))
    placed = numbered.join(F.broadcast(schedule), ["source", "turn"])
    selection = placed.select("doc_id", "source", F.col("copy_no").cast("int").alias("copy_no"), "tokens", (F.col("period") * len(plan) + F.col("slot")).alias("slot"), "start")
    return Mixture(selection, shares_of(selection, goals, have, weights), total, sum(block[s] * slots[s] for s in slots), len(plan))


def shares_of(selection: DataFrame, goals: dict, have: dict[str, int], weights: dict[str, float]) -> DataFrame:
    """The share of all selected tokens that each source reached, and how often its tokens were taken on average."""
    spark = selection.sparkSession
    taken = selection.groupBy("source").agg(F.sum("tokens").alias("tokens_taken"))
    every = F.sum("tokens_taken").over(Window.partitionBy(F.lit(1)))  # one row a source
    table = spark.createDataFrame([(s, weights[s], goals[s][1], have[s]) for s in sorted(have)], "source string, target_share double, max_repeats int, tokens_available bigint")
    joined = table.join(taken, "source", "left").withColumn("tokens_taken", F.coalesce("tokens_taken", F.lit(0)))
    return joined.select("source", "target_share", "max_repeats", "tokens_available", "tokens_taken", (F.col("tokens_taken") / every).alias("share"), (F.col("tokens_taken") / F.col("tokens_available")).alias("repeats"))

