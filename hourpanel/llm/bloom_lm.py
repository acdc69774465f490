"""Language-model scores from a log-frequency Bloom filter of word pairs.

A text's tokens are its lower-cased words and one end. A pass over the training texts adds up words and word pairs (the
first word is paired with the start of the text) inside each task and ships them in packed cells of hash ranges; every
cell becomes exact word counts and one piece of a log-frequency Bloom filter: a pair with count c is inserted at the levels
1 .. q, where q is its count on a logarithmic scale. A reader probes level after level until one is missing and takes the
smallest count of the last level it found. The filter is cut into segments of at most ``SEGMENT`` bytes; the texts are
scored once for each segment with only that segment broadcast, so what is broadcast is bounded at any corpus size and no
pair is left out. More pairs mean more passes.

The model backs off from pairs to words. With P the estimated count of (h, w), c the exact word counts and m = ``WEIGHT``:

    p(w | h) = P / (c(h) + m)                              if the filter holds the pair
             = m / (c(h) + m) * (c(w) + 1) / (N + V + 1)   otherwise

As estimates are lower ends of their levels, the probabilities after h sum to at most one but for false positives (about
one absent pair in 80). The logarithm of a text is a sum of one term a pair and terms a word, so exact word counts can be met
elsewhere: the most frequent words, at most ``TOP``, are sent to the tasks; every other word of a text goes
as a row (text, word, how often as token, as history, as backed-off word) to an equi-join with the counts.

Words are told apart by a 64-bit hash of their bytes.

Defined cases: null text is empty (only the end); a null doc_id is neither held out nor learned from (``held_out`` is null);
repeated rows are learned from one by one and scored alike; without training texts every probability is 1 (score 0); other
columns are ignored. A long text is read in pieces cut at white space.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourpanel.session import materialise

from .common import id_text, most_frequent, slices
from .subwords import remainder

SEGMENT = 64 << 20
TOP = 1 << 18
#: Weight of the word model after every history.
WEIGHT = 32.0
#: Scale of the levels, bits for each inserted level, probes a level.
BASE, BITS, PROBES = 1.5, 10, 4
CELLS = 1 << 10
#: Bytes of text that are read at once; a task holds about 100 times as many bytes of numbers.
PIECE = 1 << 20
#: Bytes of text whose keys are counted together.
COUNTED = 8 << 20
HELD = 1 << 22  # pairs a task holds before it ships them

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
START, END = np.uint64(1), np.uint64(2)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; one to one."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def pairs(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(before * _M1 + mix(after + _M3))


class Words:
    """Hashes of the words of many texts at once."""

    def __init__(self) -> None:
        value = mix(np.arange(256, dtype=np.uint64) + _M1)
        value[65:91] = value[97:123]
        self.value = value
        self.space = np.zeros(256, dtype=bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.power = self.inverse = np.ones(0, dtype=np.uint64)

    def _piece(self, raw: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of every word; ``starts_at``: where texts begin."""
        if len(raw) > len(self.power):
            factor = int(_M1) | 1
            self.power = np.cumprod(np.full(len(raw), factor, dtype=np.uint64))
            self.inverse = np.cumprod(np.full(len(raw), pow(factor, -1, 1 << 64), dtype=np.uint64))
        inside = ~self.space[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[starts_at] = True
        edge[[0, -1]] = True
        cut = np.flatnonzero(edge)
        first, last = cut[:-1], cut[1:]
        word = inside[first]
        first, last = first[word], last[word]
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.value[raw] * self.power[: len(raw)], dtype=np.uint64)])
        return mix((total[last] - total[first]) * self.inverse[first] + (last - first).astype(np.uint64)), first

    def of(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and number of the text of every word, in order; ``offsets``: where texts begin, and the end of the last."""
        hashes, texts, at, end = [], [], int(offsets[0]), int(offsets[-1])
        while at < end:
            stop = min(end, at + PIECE)
            while stop < end:
                space = np.flatnonzero(self.space[raw[at:stop]])
                if len(space):
                    stop = at + int(space[-1]) + 1
                    break
                stop = min(end, stop + PIECE)  # one word longer than a piece
            inner = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, stop, "left")]
            found, first = self._piece(raw[at:stop], inner - at)
            hashes.append(found)
            texts.append(np.searchsorted(offsets, first + at, "right") - 1)
            at = stop
        if not hashes:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        return np.concatenate(hashes), np.concatenate(texts)


def sequences(words: Words, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts of a batch, each text closed by an end, and the number of each token's text."""
    column = batch.column("text")
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    token, text = words.of(raw, offsets)
    n = batch.num_rows
    place = np.searchsorted(text, np.arange(n), "right")
    return np.insert(token, place, END), np.insert(text, place, np.arange(n))


def histories(token: np.ndarray, text: np.ndarray) -> np.ndarray:
    before = np.concatenate([np.full(1, START), token[:-1]])
    before[np.concatenate([np.ones(1, dtype=bool), text[1:] != text[:-1]])] = START
    return before


class Tally:
    """Counts of 64-bit keys, merged when they grow."""

    def __init__(self) -> None:
        self.key, self.n, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        key, n = np.unique(keys, return_counts=True)
        self.key.append(key)
        self.n.append(n)
        self.held += len(key)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        key, n = summed(self.key, self.n)
        self.key, self.n, self.held = [], [], 0
        return key, n


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([np.ones(1, dtype=bool), key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _packed(kind: str, key: np.ndarray, n: np.ndarray, cells: int) -> pa.RecordBatch:
    """Ascending keys and counts as one row a cell: 8 bytes a key, then 1, 4 or 8 bytes a count."""
    cell = (key >> np.uint64(64 - int(cells).bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    ends = np.append(first[1:], len(key))
    rows = []
    for a, b in zip(first.tolist(), ends.tolist(), strict=True):
        size = np.uint8 if n[a:b].max() < 256 else np.int64
        rows.append(key[a:b].astype("<u8").tobytes() + n[a:b].astype(size).tobytes())
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows)), pa.array(cell[first].astype(np.int32)), pa.array((ends - first).astype(np.int32)), pa.array(rows, type=pa.binary())], names=["kind", "cell", "n", "body"])


def _unpacked(n: int, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    counts = np.frombuffer(body, dtype=np.uint8 if len(body) == 9 * n else np.int64, offset=8 * n)
    return np.frombuffer(body, dtype="<u8", count=n), counts.astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    words, of_words, of_pairs = Words(), Tally(), Tally()
    for batch in slices(batches, "text", COUNTED):
        token, text = sequences(words, batch)
        of_words.add(token)
        of_pairs.add(pairs(histories(token, text), token))
        for kind, tally in (("word", of_words), ("pair", of_pairs)):
            if tally.held > HELD:
                yield _packed(kind, *tally.take(), cells)
    for kind, tally in (("word", of_words), ("pair", of_pairs)):
        if tally.held:
            yield _packed(kind, *tally.take(), cells)


def levels(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / math.log(BASE) + 1e-9).astype(np.int64)


def places(key: np.ndarray, level: int, bits: np.ndarray) -> np.ndarray:
    """``PROBES`` bit numbers below ``bits`` (one a key) for a level: a row a probe."""
    a = mix(key + np.uint64(level * int(_M1) & (1 << 64) - 1))
    b = mix(a) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % bits.astype(np.uint64) for i in range(PROBES)])


def filter_piece(key: np.ndarray, count: np.ndarray) -> bytes:
    """Bits of one cell; their number follows from what is inserted, rounded up to whole bytes."""
    q = levels(count)
    size = -(-int(q.sum()) * BITS // 8)
    out = np.zeros(8 * size, dtype=bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        at = key[q >= level]
        out[places(at, level, np.full(len(at), 8 * size)).ravel().astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


class Filter:
    """The cells ``first`` .. ``last`` - 1 of the log-frequency filter, one after another."""

    def __init__(self, first: int, last: int, sizes: np.ndarray, body: bytes, of: int) -> None:
        self.first, self.last, self.shift = first, last, np.uint64(64 - int(of).bit_length() + 1)
        self.size, self.start = sizes, np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(sizes)])
        self.body = np.frombuffer(body, dtype=np.uint8)

    def mine(self, key: np.ndarray) -> np.ndarray:
        cell = (key >> self.shift).astype(np.int64)
        return (cell >= self.first) & (cell < self.last)

    def counts(self, key: np.ndarray) -> np.ndarray:
        """Smallest count of the highest level found without a gap, 0 if the first is missing; for keys of these cells."""
        cell = (key >> self.shift).astype(np.int64) - self.first
        start, bits = self.start[cell], 8 * self.size[cell]
        found, active, level = np.zeros(len(key), dtype=np.int64), np.flatnonzero(bits), 1
        while len(active):
            at = places(key[active], level, bits[active]).astype(np.int64)
            hit = (self.body[start[active] + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).all(axis=0)
            active = active[hit]
            found[active] = level
            level += 1
        return np.where(found > 0, np.ceil(BASE ** (np.maximum(found, 1) - 1.0) - 1e-9), 0.0)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of kind and cell to exact word counts and filter pieces; one cell is held at a time."""
    schema = pa.schema([("kind", pa.string()), ("cell", pa.int32()), ("body", pa.binary()), ("word", pa.int64()), ("n", pa.int64())])

    def made(at: tuple, held: list) -> pa.RecordBatch:
        key, n = summed(*map(list, zip(*held, strict=True)))
        if at[0] == "pair":
            rows = [[at[0]], [at[1]], [filter_piece(key, n)], [None], [len(key)]]
        else:
            rows = [[at[0]] * len(key), [at[1]] * len(key), [None] * len(key), key.view(np.int64), n]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    now, held = None, []
    for batch in batches:
        for kind, cell, n, body in zip(*(batch.column(c).to_pylist() for c in ("kind", "cell", "n", "body")), strict=True):
            if held and (kind, cell) != now:
                yield made(now, held)
                held = []
            now = (kind, cell)
            held.append(_unpacked(n, body))
    if held:
        yield made(now, held)


_PART = "doc_id long, text_hash long, n_bytes long, copies long, n_tokens long, n_known long, base double, model double, word long, n_word long, n_backoff long"


def _score(batches: Iterator[pa.RecordBatch], send, first: bool, weight: float) -> Iterator[pa.RecordBatch]:
    """A row of sums a text, and a row for each of its words that is not among the most frequent ones.

    The ``first`` pass counts tokens, base and histories; every pass adds the pairs of its own segment.
    """
    words, known, filter_ = Words(), send.value["known"], send.value["filter"]
    top, top_n, total, end = known["word"], known["n"].astype(np.float64), known["total"], known["end"]
    log_word, log_history, log_total = np.log10(top_n + 1), np.log10(top_n + weight), math.log10(total)
    schema = pa.schema([(c.split()[0], pa.float64() if c.endswith("double") else pa.int64()) for c in _PART.split(", ")])

    for batch in slices(batches, "text", PIECE):
        n = batch.num_rows
        token, text = sequences(words, batch)
        key = pairs(histories(token, text), token)
        unique, back = np.unique(token, return_inverse=True)
        at = np.minimum(np.searchsorted(top, unique), len(top) - 1)
        common = (top[at] == unique)[back]
        at = at[back]
        mine = filter_.mine(key)
        estimate = np.zeros(len(key))
        asked, where = np.unique(key[mine], return_inverse=True)
        estimate[mine] = filter_.counts(asked)[where]
        seen, absent = estimate > 0, mine & (estimate == 0)
        term = np.zeros(len(key))
        term[seen] = np.log10(estimate[seen])
        term[absent] = math.log10(weight) - log_total
        term += np.where(absent & common, log_word[at], 0.0)
        base = tokens = n_known = np.zeros(n)
        if first:
            tokens = np.bincount(text, minlength=n)
            n_known = np.bincount(text, common & (top_n[at] > 0), minlength=n)
            base = np.bincount(text, np.where(common, log_word[at], 0.0), minlength=n) - tokens * log_total
            # every token but the end is the history of the next one; the start of a text is the first one's
            term -= np.where(common & (token != END), log_history[at], 0.0) + np.where(token == END, math.log10(end + weight), 0.0)
        rare = ~common & (absent | first)
        order = np.lexsort((token[rare], text[rare]))
        r_text, r_word, r_back = text[rare][order], token[rare][order], absent[rare][order]
        starts = np.flatnonzero((np.diff(r_text, prepend=-1) != 0) | (np.diff(r_word, prepend=np.uint64(0)) != 0))
        n_word = np.diff(np.append(starts, len(r_text)))
        n_back = np.add.reduceat(r_back.astype(np.int64), starts) if len(starts) else n_word
        row = np.concatenate([np.arange(n), r_text[starts]])
        sums = lambda x, kind: np.concatenate([np.asarray(x, dtype=kind), np.zeros(len(starts), dtype=kind)])
        words_only = lambda x: pa.array(np.concatenate([np.zeros(n, dtype=np.int64), x]), mask=np.arange(len(row)) < n)
        keys = [batch.column(c).take(pa.array(row)) for c in ("doc_id", "text_hash", "n_bytes")]
        numbers = [sums(np.full(n, int(first)), np.int64), sums(tokens, np.int64), sums(n_known, np.int64), sums(base, float), sums(np.bincount(text, term, minlength=n), float)]
        own = [words_only(r_word[starts].view(np.int64)), words_only(n_word if first else np.zeros_like(n_word)), words_only(n_back)]
        yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, numbers), *own], schema=schema)


def _segments(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of cells of at most ``limit`` bytes (or one cell) that cover all cells."""
    out, first, held = [], 0, 0
    for cell, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            out.append((first, cell))
            first, held = cell, 0
        held += size
    return [*out, (first, len(sizes))]


def score(docs: DataFrame, top: int = TOP, segment: int = SEGMENT, weight: float = WEIGHT, cells: int = CELLS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    ``cells`` is a power of two; a cell must fit a task, so larger corpora want more of them.
    """
    spark = docs.sparkSession
    texts = id_text(docs)
    held_out = remainder(F.col("doc_id"), 7) == 2
    counted = texts.where(~held_out).select("text").mapInArrow(lambda it: _count(it, cells), "kind string, cell int, n int, body binary")
    counted = counted.repartition("cell").sortWithinPartitions("kind", "cell").mapInArrow(_cells, "kind string, cell int, body binary, word long, n long")
    counted = materialise(counted, "counts")
    vocabulary, pieces = counted.where("kind = 'word'").select("word", "n"), counted.where("kind = 'pair'").select("cell", "body")
    train_tokens, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_end = vocabulary.where(F.col("word") == int(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = most_frequent(vocabulary.where(F.col("word") != int(END)), "n", top).toPandas()  # at most ``top`` rows
    word = np.append(frequent["word"].to_numpy(np.int64).view(np.uint64), END)
    order = np.argsort(word)
    known = {"word": word[order], "n": np.append(frequent["n"].to_numpy(np.int64), n_end)[order], "total": train_tokens + distinct + 1, "end": n_end}
    sizes = np.zeros(cells, dtype=np.int64)
    for r in pieces.select("cell", F.length("body").alias("n")).collect():  # a number a cell
        sizes[r["cell"]] = r["n"]
    keyed = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    parts = None
    for i, (a, b) in enumerate(_segments(sizes, segment)):
        body = bytearray(int(sizes[a:b].sum()))  # ``segment`` bytes
        for r in pieces.where(F.col("cell").between(a, b - 1)).toLocalIterator():
            at = int(sizes[a : r["cell"]].sum())
            body[at : at + len(r["body"])] = r["body"]
        send = spark.sparkContext.broadcast({"known": known, "filter": Filter(a, b, sizes[a:b], bytes(body), cells)})
        part = materialise(keyed.mapInArrow(lambda it, s=send, f=i == 0: _score(it, s, f, weight), _PART), "scores")
        send.destroy()
        parts = part if parts is None else parts.unionByName(part)
    key, zero = ["doc_id", "text_hash", "n_bytes"], F.lit(0).cast("long")
    c = F.coalesce(F.col("n"), zero)
    total = math.log10(known["total"])
    met = parts.where("word is not null").join(vocabulary, "word", "left").select(
        *key, zero.alias("copies"), zero.alias("n_tokens"), F.when(c > 0, F.col("n_word")).otherwise(zero).alias("n_known"),
        (F.col("n_word") * F.log10(c + 1)).alias("base"), (F.col("n_backoff") * F.log10(c + 1) - F.col("n_word") * F.log10(c + F.lit(weight))).alias("model"),
    )
    sums = parts.where("word is null").select(met.columns).unionByName(met).groupBy(*key).agg(*[F.sum(x).alias(x) for x in met.columns[3:]])
    each = lambda x: F.col(x) / F.col("copies")
    one = sums.select(
        "doc_id", held_out.alias("held_out"), each("n_tokens").cast("long").alias("n_tokens"), each("n_known").cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), F.round(each("base"), 9).alias("base_score"), F.round(each("model"), 9).alias("score"), "copies",
    )
    many = one.withColumn("from", F.explode(F.sequence(zero, F.col("copies") - 1, F.lit(1 << 16).cast("long"))))
    return many.withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + (1 << 16), F.col("copies")) - 1))).drop("copies", "from", "copy")
