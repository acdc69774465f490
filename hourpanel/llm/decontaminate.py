"""Benchmark decontamination: word n-gram seeds join training passages to test items, then Smith-Waterman scores them.

1. Items and documents become lower-cased words; a seed is a gram of ``GRAM`` words (of one word for items too short for it).
2. How many seeds a leak must hold follows from the score alone. An alignment of ``m`` equal words and ``e`` edits scores
   2m - e, which for a leak is at least 2 * least * L (L: words of the item). Its equal words form at most e + 1 runs, so at
   least m - e - 1 >= (2 * least - 1) * L - 1 pairs of neighbours stay equal, m itself is at least least * L, and it lies
   within (3 - 2 * least) * L words of the document. So with ``least`` = 0.6 no leak is without seeds, wherever its edits are.
3. One pass over the documents meets their grams with those of the items, and takes the passages where an item has its
   count of seeds, and then its count of equal words, within that reach; a word counts at most as often as the item has
   it, since equal words are at different places of the item. Everyday phrases alone reach no count. The seeds of at most
   ``TABLE_WORDS`` item words are held at a time; a larger benchmark takes more passes. The words of a slice of documents
   are hashed and looked up at once.
4. Passages are aligned with their items by words (Smith-Waterman: ``MATCH``, ``MISMATCH``, ``GAP``). The score over the
   item's best possible score is the reported ``ratio``; ``LEAK`` or more is a leak.

All counts are necessary conditions, so the result equals an alignment of all documents with all items (tested). How often
a gram or an item occurs plays no part in it, and no text is shuffled.

Defined cases: null or wordless texts and items never match; repeated documents give one row per doc_id and item (the best
alignment); rows without doc_id or item_id take part under null; items with equal text are reported one by one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourpanel.session import materialise

from .common import id_text, slices, spans, word_hashes

GRAM = 2
MATCH, MISMATCH, GAP = 2, -1, -1
LEAK = 0.6
TABLE_BITS = 22
#: Words of items whose seeds are sent to the tasks at once.
TABLE_WORDS = 1 << 20
#: Meetings of seeds and items that are sorted at once, but for those of a single document.
MEETINGS = 1 << 20
_LEAKS = "doc_id long, item_id long, score long, ratio double, end_word long"


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, given the words' hashes."""
    if len(words) < n or n == 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ words[k : len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 4 << 20):
        words, size = word_hashes(batch.column("text").to_pylist())
        words = np.split(words, np.cumsum(size)[:-1])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([w.tobytes() for w in words], type=pa.binary()), pa.array([len(w) for w in words], type=pa.int64())], names=["item_id", "item", "size"])


def items_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, item (word hashes), size (its words)."""
    return id_text(benchmark, id_col, text_col).mapInArrow(_item_rows, "item_id long, item binary, size long")


class Seeds:
    """The seeds of some items: which items hold a gram, and how many an item needs within which reach."""

    def __init__(self, ids: list[int | None], items: list[np.ndarray], least: float) -> None:
        self.ids, self.items = ids, items
        size = np.array([len(w) for w in items])
        pairs = np.ceil((2 * least - 1) * size - 1 - 1e-9).astype(np.int64)
        self.words = np.maximum(1, np.ceil(least * size - 1e-9).astype(np.int64))
        self.gram = np.where(pairs >= 1, GRAM, 1)  # without a pair for certain, single words are the seeds
        self.need = np.where(pairs >= 1, pairs, self.words)
        self.bags = [np.unique(w, return_counts=True) for w in items]
        self.reach = np.maximum(size, np.floor((3 - 2 * least) * size + 1e-9).astype(np.int64))
        self.held: dict[int, tuple[np.ndarray, ...]] = {}
        for n in np.unique(self.gram).tolist():
            own = [np.unique(gram_hashes(items[i], n)) for i in np.flatnonzero(self.gram == n)]
            grams, owner = np.concatenate(own), np.repeat(np.flatnonzero(self.gram == n), [len(g) for g in own])
            order = np.argsort(grams, kind="stable")
            grams, first, count = np.unique(grams[order], return_index=True, return_counts=True)
            self.held[n] = grams, first, count, owner[order]

    def table(self, n: int) -> np.ndarray:
        bits = np.zeros(1 << TABLE_BITS, dtype=bool)
        bits[self.held[n][0] & np.uint64((1 << TABLE_BITS) - 1)] = True
        return bits

    def passages(self, words: np.ndarray, size: np.ndarray, tables: dict[int, np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, from, to): every stretch of ``words`` that may hold a leak of the item. The words are those of texts
        of ``size`` words, one after the other."""
        text = np.repeat(np.arange(len(size)), size)
        end = np.cumsum(size)
        for n, (grams, first, count, owner) in self.held.items():
            h = gram_hashes(words, n)
            at = np.flatnonzero(tables[n][h & np.uint64((1 << TABLE_BITS) - 1)])
            at = at[text[at] == text[at + n - 1]]
            j = np.minimum(np.searchsorted(grams, h[at]), len(grams) - 1)
            same = grams[j] == h[at]
            at, j = at[same], j[same]
            part = (np.cumsum(np.bincount(text[at], count[j], minlength=len(size))) // MEETINGS)[text[at]]
            cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
            for at, j in zip(np.split(at, cuts), np.split(j, cuts), strict=True):
                yield from self._near(words, text, end - size, end, n, at, first[j], count[j], owner)

    def _near(self, words: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int, at: np.ndarray, first: np.ndarray, times: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        who, at = owner[spans(first, times)], np.repeat(at, times)
        total = len(who)
        if not total:
            return
        group = text[at] * len(self.items) + who
        order = np.argsort(group, kind="stable")
        who, at, group = who[order], at[order], group[order]
        last = np.arange(total) + self.need[who] - 1
        fits = np.flatnonzero(last < total)
        last = last[fits]
        fits = fits[(group[last] == group[fits]) & (at[last] - at[fits] <= self.reach[who[fits]] - n)]
        if not len(fits):
            return
        who, group, low, high = who[fits], group[fits], at[fits], at[fits + self.need[who[fits]] - 1] + n
        mine = text[low]
        low, high = np.maximum(begin[mine], high - self.reach[who]), np.minimum(end[mine], low + self.reach[who])
        new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (low[1:] > high[:-1])])  # both grow within an item
        for t, i, a, b in zip(mine[new].tolist(), who[new].tolist(), low[new].tolist(), high[np.r_[new[1:], len(who)] - 1].tolist(), strict=True):
            bag, most = self.bags[i]
            j = np.minimum(np.searchsorted(bag, words[a:b]), len(bag) - 1)
            equal = bag[j] == words[a:b]
            if np.minimum(np.bincount(j[equal], minlength=len(bag)), most).sum() < self.words[i]:
                continue
            here = np.r_[0, np.cumsum(equal)]
            wide = min(int(self.reach[i]), b - a)
            if (here[wide:] - here[: len(here) - wide]).max() >= self.words[i]:
                yield t, i, a, b


def align(words: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Best local alignment: its score and where in ``words`` it ends. One vector step per word of the item."""
    best, end = 0, 0
    row, steps = np.zeros(len(words) + 1, dtype=np.int64), np.arange(len(words) + 1) * GAP
    for w in item:
        here = np.zeros_like(row)
        here[1:] = np.maximum(np.maximum(row[:-1] + np.where(words == w, MATCH, MISMATCH), row[1:] + GAP), 0)
        row = np.maximum.accumulate(here - steps) + steps  # gaps along the passage
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _leaks(batches: Iterator[pa.RecordBatch], seeds: Seeds, least: float) -> Iterator[pa.RecordBatch]:
    tables = {n: seeds.table(n) for n in seeds.held}
    types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
    for batch in slices(batches, "text", 4 << 20):
        out, docs = [], batch.column("doc_id").to_pylist()
        words, size = word_hashes(batch.column("text").to_pylist())
        begin = (np.cumsum(size) - size).tolist()
        for t, i, low, high in seeds.passages(words, size, tables):
            score, end = align(words[low:high], seeds.items[i])
            ratio = score / (MATCH * len(seeds.items[i]))
            if ratio >= least:
                out.append((docs[t], seeds.ids[i], score, ratio, low + end - begin[t]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "item_id", "score", "ratio", "end_word"])


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAK) -> DataFrame:
    """doc_id, item_id, score, ratio, end_word (just after the copy): one row per document and leaked item."""
    items = materialise(items_of(benchmark).where("size > 0"), "items")
    parts = -(-(items.agg(F.sum("size")).first()[0] or 0) // TABLE_WORDS)
    own, found = id_text(docs), []
    for part in range(parts):
        some = items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(parts)) == part).select("item_id", "item").collect()
        if some:
            seeds = Seeds([r.item_id for r in some], [np.frombuffer(r.item, dtype=np.uint64) for r in some], least)
            found.append(own.mapInArrow(lambda it, seeds=seeds: _leaks(it, seeds, least), _LEAKS))
    if not found:
        return docs.sparkSession.createDataFrame([], _LEAKS)
    best = reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "ratio", "end_word")).alias("b"))
    return best.select("doc_id", "item_id", "b.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAK) -> DataFrame:
    """``docs`` without the documents that hold a leaked item."""
    bad = leaks(docs, benchmark, least).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("bad_id")), "left_anti")
