"""Evaluation passages in a corpus: size-partitioned MinHash containment search, verified by exact shingle containment.

An item's passage is short and the documents are long, so their Jaccard similarity is low even if a document holds the
whole passage. Documents are therefore partitioned by their number of shingles. From a partition's largest size and the
item's own size follows the Jaccard similarity that the wanted containment implies, and from that how many hash
functions are compared. Documents beyond the largest partition are cut into overlapping windows, so whole texts are
searched and the number of hash functions stays bounded.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm import shingling
from diffloom.session import cut

#: Words a shingle, and the share of a passage's shingles that a document must hold.
SHINGLE, CONTAINED = 5, 0.2
#: With this probability a document that holds so much of a passage is a candidate.
RECALL = 0.99
#: Upper sizes of the partitions, in shingles.
SIZES = (64, 128, 192, 256, 384)
#: Words of a passage that one window is sure to hold whole; longer items get windows of their own length.
OVERLAP = 128

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
#: Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁһԛԝвкмнтАВЕКМНОРСТУХІЈЅαοερυνικτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijsdhqwbkmhtABEKMHOPCTYXIJSaoepuviktABEZHIKMNOPTYX",
)


def words_of(text: str | None) -> list[str]:
    """Lower-case words: without markup, invisible characters, accents and look-alike letters; signs part words."""
    if not text:
        return []
    text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_LOOKALIKES)
        text = "".join(ch for ch in text if not unicodedata.category(ch) in ("Cf", "Mn"))
    return _WORD.findall(text.casefold())


def passage_of(text: str | None) -> str:
    """An item without its last line, the question; an item of one line is all passage."""
    body, _, last = (text or "").rstrip().rpartition("\n")
    return body if body.strip() else last


def hashes_needed(item: int, largest: int, contained: float = CONTAINED, recall: float = RECALL) -> int:
    """How many hash functions find a document of up to ``largest`` shingles that holds ``contained`` of ``item`` ones."""
    common = contained * item
    jaccard = common / (largest + item - common)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(jaccard, 0.999))))


def sequence_of(text: str | None) -> np.ndarray:
    """Hashes of all shingles of a text in their order; a text of fewer words is one shingle."""
    words = shingling.word_hashes(words_of(text))
    n = len(words)
    if n == 0:
        return words
    size = min(SHINGLE, n)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = shingling.mixed(out * np.uint64(3) + words[i : n - size + 1 + i])
    return out


class Search:
    """The sizes, hash functions and partitions that a set of items asks for."""

    def __init__(self, shortest: int, longest: int):
        self.longest = longest
        self.window = max(SIZES[-1], 2 * longest)
        self.step = self.window - max(OVERLAP, longest)
        limits = [s for s in SIZES if s < self.window] + [self.window]
        self.partitions = [(s, hashes_needed(shortest, s)) for s in limits]
        self.a, self.b = shingling.seeds(self.partitions[-1][1])

    def item_keys(self, shingles: np.ndarray) -> np.ndarray:
        return shingling.bands(shingling.minhash(shingles, self.a, self.b), 1)

    def document_keys(self, sequence: np.ndarray) -> np.ndarray:
        """Keys of all windows of a document, each by as many functions as its partition asks for."""
        whole = np.unique(sequence)
        if len(whole) <= self.window:
            parts = [whole] if len(whole) else []
        else:
            parts = [np.unique(sequence[i : i + self.window]) for i in range(0, max(1, len(sequence) - self.window + self.step), self.step)]
        keys = []
        for part in parts:
            n = next(n for size, n in self.partitions if len(part) <= size)
            keys.append(shingling.bands(shingling.minhash(part, self.a[:n], self.b[:n]), 1))
        return np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)


#: Items with fewer shingles are found by any shared shingle, as so small a containment would take very many functions.
SHORT = 16
#: Up to so many shingles of items are sent to every task (about 100 bytes each); beyond, candidates come by a join.
ITEM_SHINGLES = 1_000_000
#: Bits of the filter that is sent to every task in the join: 16 MB.
FILTER_BITS = 1 << 27


def _items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(k, np.unique(sequence_of(passage_of(t))).view(np.int64)) for k, t in zip(pdf["item_id"], pdf["text"])]
        yield pd.DataFrame([r for r in rows if len(r[1])], columns=["item_id", "shingles"])


def leaks(documents: DataFrame, items: DataFrame, item_shingles: int = ITEM_SHINGLES) -> DataFrame:
    """(doc_id, item_id, containment) of each document that holds at least :data:`CONTAINED` of an item's passage.

    Every document is searched, whole. Null and empty texts hold nothing; an item without words is held by nothing; an
    item of one line is all passage. Items that share a passage each count. Repeated rows of a key give one row. Other
    columns are ignored. Empty tables give an empty frame.
    """
    spark = documents.sparkSession
    item_kind, doc_kind = items.schema["item_id"].dataType.simpleString(), documents.schema["doc_id"].dataType.simpleString()
    known = cut(items.select("item_id", "text").mapInPandas(_items, f"item_id {item_kind}, shingles array<bigint>"))
    size = F.size("shingles")
    sizes = known.agg(F.sum(size), F.max(size), F.min(F.when(size >= SHORT, size))).first()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, containment double"
    if not sizes[0]:
        return spark.createDataFrame([], schema)
    search = Search(sizes[2] or SHORT, sizes[1])
    texts = documents.select("doc_id", "text")
    if sizes[0] <= item_shingles:
        found = texts.mapInPandas(_searcher(search, known), schema)
    else:
        found = _joined(search, known, texts, schema, doc_kind, item_kind)
    return found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def _searcher(search: Search, known: DataFrame):
    """The search with all items at each task: MinHash candidates, then exact containment, in one pass without a shuffle."""
    rows = [(r[0], np.array(r[1], np.int64).view(np.uint64)) for r in known.collect()]  # its size was checked
    sent = known.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sent.value
        by_key: dict[int, list[int]] = {}
        by_shingle: dict[int, list[int]] = {}
        for i, (_, shingles) in enumerate(rows):
            for key in (search.item_keys(shingles).tolist() if len(shingles) >= SHORT else ()):
                by_key.setdefault(key, []).append(i)
            for key in (shingles.tolist() if len(shingles) < SHORT else ()):
                by_shingle.setdefault(key, []).append(i)
        short = np.array(sorted(by_shingle), np.uint64)
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                sequence = sequence_of(text if isinstance(text, str) else None)
                if not len(sequence):
                    continue
                candidates = {i for key in search.document_keys(sequence).tolist() if key in by_key for i in by_key[key]}
                whole = np.unique(sequence)
                if len(short):
                    candidates |= {i for key in np.intersect1d(whole, short).tolist() for i in by_shingle[key]}
                for i in candidates:
                    item, shingles = rows[i]
                    share = np.isin(shingles, whole, assume_unique=True).mean()
                    if share >= CONTAINED:
                        out.append((doc, item, float(share)))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "containment"])

    return run


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of one hash over ``keys`` (key): bytes of fixed size, whatever the number of keys."""
    place = F.pmod("key", F.lit(bits)) + 1
    parts = keys.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():  # 4 KB each, as many as the filter has bits
        part = np.frombuffer(r.bits, np.uint8)
        out[(r.bucket - 1) * len(part) : r.bucket * len(part)] = part
    return out


def kept(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The keys that the filter may hold."""
    place = np.mod(keys, len(known) * 8)
    return keys[(known[place >> 3] >> (place & 7)) & 1 == 1]


def _joined(search: Search, known: DataFrame, texts: DataFrame, schema: str, doc_kind: str, item_kind: str) -> DataFrame:
    """The search for any number of items: candidates by a join on keys, verified beside their texts.

    Keys of documents meet a filter of the items' keys before they leave the text, and texts without any key that may be an
    item's go no further.
    """

    def item_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, shingles in zip(pdf["item_id"], pdf["shingles"]):
                shingles = np.asarray(shingles, np.int64)
                rows.append((item, search.item_keys(shingles.view(np.uint64)) if len(shingles) >= SHORT else shingles))
            yield pd.DataFrame(rows, columns=["item_id", "keys"])

    # the keys of long items are MinHash keys, those of short ones their shingles
    wanted = cut(known.mapInPandas(item_keys, f"item_id {item_kind}, keys array<bigint>").select("item_id", F.explode("keys").alias("key")))
    sent = known.sparkSession.sparkContext.broadcast(key_filter(wanted.select("key")))

    def doc_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                sequence = sequence_of(text if isinstance(text, str) else None)
                whole = np.unique(sequence).view(np.int64)
                keys = np.union1d(kept(search.document_keys(sequence), sent.value), kept(whole, sent.value))
                if len(keys):
                    rows.append((doc, keys, whole))
            yield pd.DataFrame(rows, columns=["doc_id", "keys", "shingles"])

    docs = cut(texts.mapInPandas(doc_keys, f"doc_id {doc_kind}, keys array<bigint>, shingles array<bigint>"))
    pairs = docs.select("doc_id", F.explode("keys").alias("key")).join(wanted, "key").select("doc_id", "item_id").distinct()
    both = pairs.join(docs.select("doc_id", F.col("shingles").alias("whole")), "doc_id").join(known, "item_id")
    share = F.size(F.array_intersect("shingles", "whole")) / F.size("shingles")
    return both.select("doc_id", "item_id", share.cast("double").alias("containment")).filter(F.col("containment") >= CONTAINED)
