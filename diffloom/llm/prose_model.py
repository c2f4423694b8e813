"""Keyword-stuffed and link-list pages, found by the perplexity of word-class sequences.

Texts become sequences of classes: function words by their kind, content words by their place in a run of them, links, tags,
numbers and marks. A class 5-gram model is trained on the prose sentences of all documents, and with it the frequencies of
their words. A page is flagged if its perplexity is abnormal:

* high: most of its letters stand in sentences that the class model finds more perplexing than prose of that length;
* low: a model that learns the page's own n-grams while it reads finds its words, or its classes, far more predictable than those
  of any prose. It starts from the frequencies of words in prose, or from equal classes.

The one rule beside the models: sentences with the marks of code, paths, options or measured values are technical. They aren't
prose, but what they list is no advertisement, so they count for neither side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Function words of English, German, French and Spanish by kind.
FUNCTION_WORDS = {
    "D": "the a an this that these those each every any some no both all most our my your their its his her one der die das den dem des ein eine einen "
    "einem einer jeder jede jedes kein keine unser unsere le la les un une des du ce cette chaque notre el los las una unos unas cada nuestro nuestra",
    "P": "of in on at to for from by with into over under after before since behind during between through without within near nach in im am an auf aus bei "
    "mit von vom zu zum zur ohne durch unter dans sur sous pour par avec sans de à en pendant avant après con sin por para desde sobre durante",
    "C": "and or but nor yet so as if than because while when whenever although unless once until where provided und oder aber weil wenn obwohl dass als "
    "et ou mais parce que quand si y o pero porque cuando aunque",
    "R": "it they we you i he she them us who whom which what whatever nobody there here sie er es wir ihr man sich il elle ils elles nous vous se qui lo "
    "nosotros ellos quien que",
    "A": "is are was were be been being has have had do does did can cannot could will would shall should may might must ist sind war waren hat haben wird "
    "werden kann soll muss est sont était a ont avons peut doit es son está están fue ha han hemos puede debe",
    "Q": "not never always often rarely only rather more less than why how please nicht nie immer nur noch warum ne pas jamais toujours seulement pourquoi no nunca siempre "
    "solo sólo",
}
KIND = {word: kind for kind, words in FUNCTION_WORDS.items() for word in words.split()}

TOKEN = re.compile(
    r"(?P<url>(?:https?://|www\.)[^\s)>\]\"']+)|(?P<html></?\w[^>]*>)|(?P<code>`[^`]*`|\w+\(\)|\b\w*_\w+|\b[a-z]+[A-Z]\w*|--?[A-Za-z][\w-]+|@@)|"
    r"(?P<path>\.?[\w-]+(?:/[\w.-]+)+|\b\w+\.(?:py|js|java|go|c|h|md|json|ya?ml|txt|sh|toml|cfg)\b)|(?P<tag>#\w+)|(?P<chain>[^\W_]+(?:-[^\W_]+){2,})|"
    r"(?P<hex>\b(?=[a-f]*\d)[0-9a-f]{7,40}\b)|(?P<number>\d[\d.,:%]*)|(?P<word>[^\W\d_]+(?:['’-][^\W\d_]+)*)|(?P<mixed>\w+)|(?P<mark>[^\w\s])"
)
_SOFT = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])

# In texts of classes every class is one character: function words are upper-case letters, marks themselves, w is a content word.
CLASS = {"url": "u", "html": "h", "code": "c", "path": "p", "hex": "x", "tag": "t", "chain": "k", "number": "n", "mixed": "n"}
FUNCTION = "".join(FUNCTION_WORDS)
START, END = "^", "$"
#: The classes of the model, several characters for one; the places of a content word in its run follow, the last for all later ones.
GROUPS = (START, END, *FUNCTION, "u", "tk", "n", "cpx", ".?!", ",;", ":", "|", ">-*#/", "()[]\"'h")
RUN = 6
#: Classes, one more for all other characters; length of an n-gram; number of n-grams there can be.
N_CLASSES = len(GROUPS) + RUN + 1
ORDER = 5
N_GRAMS = N_CLASSES**ORDER
#: Buckets of words' hashes, and the part of the probability that all buckets share equally.
BUCKETS, EQUAL = 1 << 16, 0.1


def _lookup(groups: tuple[str, ...]) -> np.ndarray:
    table = np.full(256, N_CLASSES - 1, np.uint8)
    for i, chars in enumerate(groups):
        table[[ord(c) for c in chars]] = i
    table[ord("w")] = len(groups)
    return table


def _marked(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[[ord(c) for c in chars]] = 1
    return table


_CLASSES = _lookup(GROUPS)
_IS = {name: _marked(chars) for name, chars in {"function": FUNCTION, "technical": "cpx", "code": "c", "braces": "{}=", "pipe": "|", "number": "n"}.items()}

#: A prose sentence, for training: so many words at least, of which such a share are function words, and an end mark.
PROSE_WORDS, PROSE_SHARE = 6, 0.2

#: (classes, letters, hashes of words, whether a sentence ends) of chunks between blanks, while there are fewer than this.
_KNOWN: dict[str, tuple[str, int, tuple[int, ...], bool]] = {}
_KNOWN_MOST = 200_000


def _chunk(chunk: str) -> tuple[str, int, tuple[int, ...], bool]:
    out, words, letters = [], [], 0
    for m in TOKEN.finditer(chunk):
        kind, text = m.lastgroup, m[0]
        if kind == "word":
            low = text.lower()
            out.append(KIND.get(low, "w"))
            words.append(crc32(low.encode()))
            letters += len(text)
        elif kind == "mark":
            out.append(text if text.isascii() else "%")
        else:
            out.append(c := CLASS[kind])
            if kind in ("tag", "chain", "mixed"):
                words.append(crc32(text.lower().encode()))
            if c not in "hn" or kind == "mixed":
                letters += len(text)
    classes = "".join(out)
    if len(_KNOWN) >= _KNOWN_MOST:
        _KNOWN.clear()
    _KNOWN[chunk] = found = (classes, letters, tuple(words), classes.rstrip("\"')]*")[-1:] in (".", "?", "!"))
    return found


def sentences(text: str) -> Iterator[tuple[str, int, list[int]]]:
    """(classes, letters, hashes of words) of each sentence of each line; a sentence ends with a chunk that ends with . ? or !"""
    for line in (text if text.isascii() else text.translate(_SOFT)).splitlines():
        parts: list[str] = []
        words: list[int] = []
        letters = 0
        for chunk in line.split():
            classes, n, own, ends = _KNOWN.get(chunk) or _chunk(chunk)
            parts.append(classes)
            letters += n
            words += own
            if ends:
                yield "".join(parts), letters, words
                parts, words, letters = [], [], 0
        if parts:
            yield "".join(parts), letters, words


@dataclass(frozen=True)
class Pages:
    """Sentences of some texts as arrays: one value a sentence (page, letters, words, tokens, first), a class (grams, ends) or a word."""

    page: np.ndarray
    letters: np.ndarray
    n_words: np.ndarray
    n_tokens: np.ndarray
    chars: np.ndarray
    first: np.ndarray
    grams: np.ndarray
    counted: np.ndarray
    words: np.ndarray

    def count(self, what: str) -> np.ndarray:
        """How many classes of a kind each sentence has."""
        return np.add.reduceat(_IS[what][self.chars], self.first)


def read(texts: list, once: bool = False) -> Pages | None:
    """The sentences of ``texts``; ``once`` leaves out those whose classes the same text had before. None if there are none."""
    page, letters, n_words, parts = [], [], [], []
    words: list[int] = []
    for i, text in enumerate(texts):
        if not isinstance(text, str):
            continue
        seen: set[str] = set()
        for classes, n, own in sentences(text):
            if once:
                if classes in seen:
                    continue
                seen.add(classes)
            page.append(i)
            letters.append(n)
            n_words.append(len(own))
            parts.append(classes)
            words += own
    if not parts:
        return None
    pad = START * (ORDER - 1)
    chars = np.frombuffer((pad + f"{END}{pad}".join(parts) + END).encode("latin-1", "replace"), np.uint8)
    n_tokens = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    first = np.concatenate(([0], np.cumsum(n_tokens + ORDER - 1)[:-1]))
    classes = _CLASSES[chars].astype(np.int64)
    # the place of each content word in its run
    at = np.arange(len(chars))
    content = chars == ord("w")
    since = at - np.maximum.accumulate(np.where(content, 0, at))
    classes[content] += np.minimum(since[content], RUN) - 1
    grams = np.zeros(len(chars), np.int64)
    for back in range(ORDER - 1, 0, -1):
        grams[back:] += classes[: len(chars) - back] * N_CLASSES**back
    grams += classes
    return Pages(np.array(page), np.array(letters), np.array(n_words), n_tokens, chars, first, grams, chars != ord(START), np.array(words, np.uint64))


def is_prose(p: Pages) -> np.ndarray:
    n = p.n_words + p.count("code")
    last = p.first + p.n_tokens + ORDER - 3  # the class before the end
    ends = np.zeros(len(n), bool)
    for back in range(3):
        ends |= np.isin(p.chars[np.maximum(last - back, p.first)], [ord(c) for c in ".?!"])
    return (n >= PROSE_WORDS) & ends & (p.count("function") >= PROSE_SHARE * n)


#: Characters of text that are worked on at a time, one text at least.
AT_ONCE = 1 << 20


def _portions(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    size = pdf["text"].str.len().fillna(0).cumsum().to_numpy() // AT_ONCE
    for _, part in pdf.groupby(size, sort=False):
        yield part


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    grams, words = np.zeros(N_GRAMS, np.int64), np.zeros(BUCKETS, np.int64)
    for pdf in batches:
        for part in _portions(pdf):
            if (p := read(part["text"].tolist(), once=True)) is None:
                continue
            prose = is_prose(p)
            # each token's sentence is prose, and it's no padding
            kept = np.repeat(prose, p.n_tokens + ORDER - 1) & p.counted
            found, n = np.unique(p.grams[kept], return_counts=True)
            grams[found] += n
            words += np.bincount((p.words[np.repeat(prose, p.n_words)] % BUCKETS).astype(np.int64), minlength=BUCKETS)
    for offset, counts in ((0, grams), (N_GRAMS, words)):
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"gram": at + offset, "n": counts[at]})


def train(documents: DataFrame) -> DataFrame:
    """(gram, n): class n-gram and word bucket counts over the prose sentences of all documents, buckets after the n-grams.

    Sentences of the same classes train the model once a page. Null and empty texts have none. There are at most
    N_GRAMS + BUCKETS rows (about 10 million), whatever the corpus.
    """
    return documents.select("text").mapInPandas(_count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class ProseModel:
    """Bits of each class n-gram's last class given the others, and of each word bucket: two tables of fixed size."""

    grams: np.ndarray
    words: np.ndarray


def fit(gram: np.ndarray, n: np.ndarray) -> ProseModel:
    """Witten-Bell interpolation of the n-grams of all orders, from the counts of the longest."""
    counts = np.zeros(N_GRAMS, np.float32)
    counts[gram[gram < N_GRAMS]] = n[gram < N_GRAMS]
    p = np.full((1, N_CLASSES), 1 / N_CLASSES, np.float32)
    for order in range(1, ORDER + 1):
        c = counts.reshape(-1, N_CLASSES**order).sum(0).reshape(-1, N_CLASSES)
        every, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True, dtype=np.int32)
        lower = np.tile(p, (N_CLASSES if order > 1 else 1, 1))
        p = np.where(every > 0, (c + kinds * lower) / np.maximum(every + kinds, 1), lower).astype(np.float32).reshape(-1, N_CLASSES)
        p = p if order == ORDER else p.reshape(-1, N_CLASSES)
    words = np.zeros(BUCKETS)
    words[gram[gram >= N_GRAMS] - N_GRAMS] = n[gram >= N_GRAMS]
    shares = words / max(words.sum(), 1)
    return ProseModel(-np.log2(np.maximum(p.reshape(-1), 1e-9)), (EQUAL / BUCKETS + (1 - EQUAL) * shares))


def _before(keys: np.ndarray) -> np.ndarray:
    """How often each key stood before its place."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    at = np.arange(len(keys))
    out = np.empty(len(keys), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def learning_bits(page: np.ndarray, items: np.ndarray, p: np.ndarray, contexts: tuple[int, ...]) -> np.ndarray:
    """Bits of each of ``items`` under a model that learns its page: it starts with ``p`` and interpolates, for each number of items
    in ``contexts``, what followed the same context before on the page, weighted by how often the context occurred."""
    for size in contexts:
        key = page.astype(np.uint64) * _MIX[0]
        for back in range(size, 0, -1):
            shifted = np.concatenate((np.zeros(min(back, len(items)), np.uint64), items[:-back]))
            key = (key ^ shifted) * _MIX[1]
            key ^= key >> np.uint64(29)
        same = (key ^ (items + _MIX[0])) * _MIX[1]
        known, followed = _before(key), _before(same)
        p = (followed + p) / (known + 1)
    return -np.log2(p)


#: A sentence is abnormal from so many bits a class, and more by the second value over the root of its length: short ones vary more.
HIGH_BITS, HIGH_SPREAD = 2.3, 8.0
#: A page is flagged if such a share of its letters outside technical sentences, and so many, stand in abnormal sentences ...
HIGH_SHARE, HIGH_LETTERS = 0.6, 80
#: ... or if so many words have at most so many bits each, or so many classes, under the models that learn the page.
LOW_WORDS, LOW_WORD_BITS = 12, 7.3
LOW_CLASSES, LOW_CLASS_BITS = 40, 1.2
#: A sentence that starts with one word and a colon, with so many words at most, is a header or trailer and counts as technical.
HEADER_WORDS = 6

SCORES = "letters double, technical double, high_letters double, high double, bits double, n_words double, word_bits double, n_classes double, class_bits double"
NAMES = [x.split()[0] for x in SCORES.split(", ")]


def is_technical(p: Pages) -> np.ndarray:
    """Sentences with code, paths or options among every twelve words, braces, table cells with numbers, and headers."""
    marks = p.count("technical")
    n = p.n_words + marks
    start, then = p.chars[p.first + ORDER - 1], p.chars[np.minimum(p.first + ORDER, len(p.chars) - 1)]
    header = (p.n_words <= HEADER_WORDS) & (then == ord(":")) & ((start == ord("w")) | np.isin(start, [ord(c) for c in FUNCTION]))
    return ((marks * 12 >= n) & (marks > 0)) | (p.count("braces") > 0) | ((p.count("pipe") > 0) & (3 * p.count("number") >= p.n_words)) | header


def score(texts: list, model: ProseModel) -> pd.DataFrame:
    """The scores of each text; a share or mean of nothing is 0, bits of nothing are infinite."""
    out = np.zeros((len(texts), len(NAMES)))
    out[:, [6, 8]] = np.inf
    if (p := read(texts)) is not None:
        told = (p.letters > 0) & ~is_technical(p)
        size = p.n_tokens + ORDER - 1
        bits = np.add.reduceat(np.where(p.counted, model.grams[p.grams], 0), p.first)
        high = told & (bits / p.n_tokens > HIGH_BITS + HIGH_SPREAD / np.sqrt(p.n_tokens))
        total = lambda w: np.bincount(p.page, w, len(texts))
        every, ours = total(p.letters), total(p.letters * told)
        tokens = total(p.n_tokens * told)
        of_word = np.repeat(told, p.n_words)
        word_page, words = np.repeat(p.page, p.n_words)[of_word], p.words[of_word]
        word_bits = learning_bits(word_page, words, model.words[(words % BUCKETS).astype(np.int64)], (1, 2))
        of_class = np.repeat(told, size) & p.counted
        class_page, classes = np.repeat(p.page, size)[of_class], p.grams[of_class] % N_CLASSES
        class_bits = learning_bits(class_page, classes.astype(np.uint64), np.full(len(classes), 1 / N_CLASSES), (1, 2, ORDER - 1))
        n_words = np.bincount(word_page, minlength=len(texts))
        mean = lambda values, n, none: np.divide(values, n, out=np.full(len(texts), none), where=n > 0)
        out = np.column_stack([
            every, mean(every - ours, every, 0.0), total(p.letters * high), mean(total(p.letters * high), ours, 0.0), mean(total(bits * told), tokens, 0.0),
            n_words, mean(np.bincount(word_page, word_bits, len(texts)), n_words, np.inf), tokens, mean(np.bincount(class_page, class_bits, len(texts)), tokens, np.inf),
        ])
    return pd.DataFrame(out, columns=NAMES)


def is_spam() -> Column:
    """Whether a page with these scores is flagged."""
    high = (F.col("high") >= HIGH_SHARE) & (F.col("high_letters") >= HIGH_LETTERS)
    words = (F.col("n_words") >= LOW_WORDS) & (F.col("word_bits") <= LOW_WORD_BITS)
    classes = (F.col("n_classes") >= LOW_CLASSES) & (F.col("class_bits") <= LOW_CLASS_BITS)
    return high | words | classes


def fitted(documents: DataFrame) -> ProseModel:
    """The model of :func:`train`, on the driver: its size has a bound, which is checked."""
    rows = train(documents).limit(N_GRAMS + BUCKETS + 1).toPandas()
    if len(rows) > N_GRAMS + BUCKETS:
        raise ValueError("more n-grams than the classes allow")
    return fit(rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(float))


def score_pages(documents: DataFrame, key: str = "doc_id", model: ProseModel | None = None) -> DataFrame:
    """(key, scores, spam) of every document, under the model trained on all of them or under ``model``.

    Null and empty texts have 0 letters and aren't flagged. Each row is judged by itself, so repeated rows get the
    same answer; other columns, whatever their names, are ignored. An empty table gives an empty frame.
    """
    known = documents.sparkSession.sparkContext.broadcast(model or fitted(documents))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _portions(pdf):
                out = score(part["text"].tolist(), known.value)
                out.insert(0, key, part[key].to_numpy())
                yield out

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, "text").mapInPandas(run, f"`{key}` {kind}, {SCORES}").withColumn("spam", is_spam())
