"""Hashed word and character n-gram features, shared by the two classifiers, and their bounded training samples."""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)


def bucket(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def word_features(word: str) -> list[int]:
    """Buckets of the word and of the character n-grams of the word between < and >; long words give more of them."""
    marked = f"<{word}>"
    grams = {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)}
    return [bucket("w " + word), *map(bucket, sorted(grams))]


def _crc_steps() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


CRC_STEPS = _crc_steps()
WORD_MARK = zlib.crc32(b"w ")


CHUNK = 1 << 16


def word_sums(words: list[str], weights: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Sum of the weights of a word's features, and their number, for each of ``words``; as by ``word_features``."""
    out = np.zeros((len(words), 2))
    for lo in range(0, len(words), chunk):
        some = words[lo : lo + chunk]
        plain = np.fromiter(map(str.isascii, some), dtype=bool, count=len(some))
        part = np.zeros((len(some), 2))
        part[plain] = _plain_sums([w for w in some if w.isascii()], weights)
        part[~plain] = _wide_sums([w for w in some if not w.isascii()], weights)
        out[lo : lo + chunk] = part
    return out


def _plain_sums(words: list[str], weights: np.ndarray) -> np.ndarray:
    """``word_sums`` of at most ``CHUNK`` ASCII words: word number and bytes of a gram fit 56 bits, so that a sort finds the
    distinct grams of each word, and all are hashed at once."""
    if not words:
        return np.zeros((0, 2))
    raw = np.frombuffer("".join(f"<{w}>" for w in words).encode(), dtype=np.uint8)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    whole = np.fromiter((zlib.crc32(w.encode(), WORD_MARK) for w in words), dtype=np.int64, count=len(words))
    total, n = weights[whole & (BUCKETS - 1)], np.ones(len(words))
    for length in GRAMS:
        last = len(raw) - length + 1
        if last < 1:
            break
        gram = word[:last].copy()
        for k in range(length):
            gram = (gram << 8) | raw[k : last + k]
        gram = gram[word[:last] == word[length - 1 :]]
        gram.sort()
        gram = gram[np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: len(gram)])]
        crc = np.full(len(gram), 0xFFFFFFFF, dtype=np.uint32)
        for k in range(length - 1, -1, -1):
            crc = CRC_STEPS[(crc ^ (gram >> (8 * k)).astype(np.uint32)) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        mine = gram >> (8 * length)
        total = total + np.bincount(mine, weights=weights[~crc & np.uint32(BUCKETS - 1)], minlength=len(words))
        n = n + np.bincount(mine, minlength=len(words))
    return np.stack([total, n], axis=1)


def _wide_sums(words: list[str], weights: np.ndarray) -> np.ndarray:
    """As ``_plain_sums``, for words of any characters: two sort keys hold the word number and five code points."""
    if not words:
        return np.zeros((0, 2))
    text = "".join(f"<{w}>" for w in words)
    char, raw = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64), np.frombuffer(text.encode(), dtype=np.uint8)
    byte = np.r_[0, np.cumsum(1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF))]
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    whole = np.fromiter((zlib.crc32(w.encode(), WORD_MARK) for w in words), dtype=np.int64, count=len(words))
    total, n = weights[whole & (BUCKETS - 1)], np.ones(len(words))
    for length in GRAMS:
        last = len(char) - length + 1
        if last < 1:
            break
        at = np.flatnonzero(word[:last] == word[length - 1 :])
        high, low = (word[at] << 42) | (char[at] << 21) | char[at + 1], np.zeros(len(at), dtype=np.int64)
        for k in range(2, length):
            low = (low << 21) | char[at + k]
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        at = at[order][np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])][: len(at)]]
        begin, end = byte[at], byte[at + length]
        crc = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
        for k in range(int((end - begin).max(initial=0))):
            live = np.flatnonzero(begin + k < end)
            crc[live] = CRC_STEPS[(crc[live] ^ raw[begin[live] + k]) & 0xFF] ^ (crc[live] >> np.uint32(8))
        total = total + np.bincount(word[at], weights=weights[~crc & np.uint32(BUCKETS - 1)], minlength=len(words))
        n = n + np.bincount(word[at], minlength=len(words))
    return np.stack([total, n], axis=1)


class WordTable:
    """Per distinct word a row of numbers, made once by ``make`` and kept up to ``limit`` words."""

    def __init__(self, make, width: int, limit: int = 300_000) -> None:
        self.make, self.limit, self.index = make, limit, {}
        self.rows = np.zeros((1024, width))

    def at(self, words: list[str]) -> np.ndarray:
        """Rows of ``words``, one for each."""
        if len(self.index) > self.limit:
            self.index.clear()
        for w in set(words).difference(self.index):
            n = len(self.index)
            if n == len(self.rows):
                self.rows = np.r_[self.rows, np.zeros_like(self.rows)]
            self.rows[n] = self.make(w)
            self.index[w] = n
        return self.rows[np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))]


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo ``modulus``; null for a null identifier."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def training_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int) -> tuple[DataFrame, float]:
    """doc_id, text, y of at most ``per_class`` labelled rows of each class, those with the smallest hash of doc_id; and
    the log odds of class 1 among all allowed labels, less those in the sample.

    Both the order and the bound are the same at every size. Labels that differ within a doc_id are left out.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & allowed)
    clear = ids.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("doc_id", "y")
    few = None
    for y in (0, 1):
        part = clear.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        few = part if few is None else few.unionByName(part)
    n = {r["y"]: r["n"] for r in clear.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    odds = lambda cap: math.log(max(1, min(cap, n.get(1, 0))) / max(1, min(cap, n.get(0, 0))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(few), "doc_id"), odds(1 << 62) - odds(per_class)  # at most 2 * per_class identifiers


def adagrad(weights: np.ndarray, state: np.ndarray, at: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """One sparse step on rows ``at`` (repeats are summed)."""
    rows, back = np.unique(at, return_inverse=True)
    total = np.zeros((len(rows), *weights.shape[1:]))
    np.add.at(total, back, gradient)
    state[rows] += total * total
    weights[rows] -= rate * total / np.sqrt(state[rows] + 1e-8)
