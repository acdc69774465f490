"""Removal of repeated byte strings with suffix sorting split over the cluster.

Rule: a byte goes when a string of ``LENGTH`` bytes that covers it also starts earlier (smaller doc_id, or earlier in the
same document). Strings are judged on the input.

1. Documents with the same text collapse to the smallest doc_id; of the others everything goes (if long enough).
2. Every string of ``LENGTH`` bytes names an anchor inside itself: the leftmost of its ``GRAM``-byte grams with the smallest
   hash. Equal strings name equal anchors at equal distance, so only anchors whose hash occurs twice matter.
3. The strings around a repeated anchor, one short context of at most ``2 * LENGTH`` bytes, go to the task of the anchor's
   hash; equal contexts are collapsed before the shuffle. An anchor found over ``HOT`` times is keyed by the hash of
   each single string instead, which spreads it.
4. There the strings of the contexts are ordered by deep-shallow suffix sorting: a multikey sort on eight-byte characters
   to ``SHALLOW`` bytes, then blind tries for groups that still agree. A leaf holds equal strings; all but its earliest go.

The text is shuffled once, by row key, and that exchange serves every join. Results do not depend on hashes: the sort
compares bytes. Row keys are 64-bit hashes of doc_id and text.

Defined cases: null text is empty; texts shorter than ``LENGTH`` bytes stay whole; repeated rows (same doc_id and text)
count as one document and share its result; rows of one doc_id with different texts are separate documents, ordered by
key; a null doc_id comes after all others; other columns are ignored or, in ``cleaned``, carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

LENGTH = 100
GRAM = 24
SHALLOW = 16
HOT = 50_000
PIECE = 1 << 18
LAST = (1 << 63) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Anchors:
    """Finds the anchors of many byte strings at once; tables of powers are made once per task."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE) -> None:
        self.length, self.gram, self.piece = length, gram, piece
        n = 2 * piece + length
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)], dtype=np.uint64)
            self.back = np.cumprod(np.r_[np.uint64(1), np.full(n, inverse)], dtype=np.uint64)

    def pieces(self, texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
        """Groups of (text, offset, bytes); long texts in overlapping parts so that no string is lost."""
        group, size = [], 0
        for i, text in enumerate(texts):
            for at in range(0, max(0, len(text) - self.length + 1), self.piece):
                part = text[at : at + self.piece + self.length - 1]
                if group and size + len(part) > self.piece + self.length:
                    yield group
                    group, size = [], 0
                group.append((i, at, part))
                size += len(part)
        if group:
            yield group

    def __call__(self, group: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        """(text, anchor's offset, first string, last string that name it, hash) for every run of strings with one anchor."""
        lengths = np.array([len(b) for *_, b in group])
        raw = np.frombuffer(b"".join(b for *_, b in group), dtype=np.uint8)
        ends = np.cumsum(lengths)
        n, width = len(raw), self.length - self.gram + 1
        with np.errstate(over="ignore"):
            total = np.r_[np.uint64(0), np.cumsum((raw + np.uint64(1)) * self.power[:n], dtype=np.uint64)]
            h = (total[self.gram :] - total[: n - self.gram + 1]) * self.back[: n - self.gram + 1]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        blocks = np.full(-(-len(key) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        blocks[: len(key)] = key
        blocks = blocks.reshape(-1, width)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - self.length + 1
        anchor = (np.minimum(after[:starts], before[width - 1 : width - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        part = np.repeat(np.arange(len(group)), lengths)[:starts]
        inside = np.flatnonzero(np.arange(starts) + self.length <= ends[part])
        anchor, part = anchor[inside], part[inside]
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
        last = np.r_[first[1:], len(anchor)] - 1
        part, anchor = part[first], anchor[first]
        shift = np.array([at for _, at, _ in group])[part] - (ends - lengths)[part]
        text = np.array([i for i, *_ in group])[part]
        return text, anchor + shift, inside[first] + shift, inside[last] + shift, h[anchor]


def _pack_at(anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (anchor << 16) | ((anchor - first) << 8) | (anchor - last)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = Anchors()
    for batch in slices(batches, "text"):
        keys = batch.column("k").to_numpy(zero_copy_only=False)
        for group in find.pieces(batch.column("text").to_pylist()):
            text, anchor, first, last, h = find(group)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[text]), pa.array(_pack_at(anchor, first, last))], names=["h", "k", "at"])


#: A context: strings that start at ``start`` ... ``start + n - 1`` of a document; ``lead``: from the first to the anchor.
#: Without a body: a run of ``n`` bytes from ``start`` that goes.
_CONTEXT = "h long, k long, id long, start long, n int, lead int, body binary"
_CONTEXT_NAMES = ["h", "k", "id", "start", "n", "lead", "body"]


def _merged(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(k, id, start, end) with the runs of each k that touch put together."""
    out: list[tuple[int, int, int, int]] = []
    for k, id_, start, end in sorted(runs):
        if out and out[-1][0] == k and start <= out[-1][3]:
            out[-1] = (k, id_, out[-1][2], max(end, out[-1][3]))
        else:
            out.append((k, id_, start, end))
    return out


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of the repeated anchors; of equal contexts in a batch the earliest stays, the strings of the others go."""
    import xxhash

    for batch in slices(batches, "text", 8 << 20):
        seen: dict[tuple, tuple[int, int, int]] = {}
        gone = []

        def meet(key: tuple, at: tuple[int, int, int], seen: dict = seen, gone: list = gone) -> None:
            other = seen.setdefault(key, at)
            if other != at:
                seen[key], (id_, k, start) = min(other, at), max(other, at)
                gone.append((k, id_, start, start + key[2] + LENGTH - 1))

        found = batch.column("found")
        ends = np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False)).tolist()
        anchors = list(zip(*(found.flatten().field(c).to_pylist() for c in ("at", "h", "hot")), strict=True))  # no dict each
        begin = 0
        for k, id_, text, end in zip(*(batch.column(c).to_pylist() for c in ("k", "id", "text")), ends, strict=True):
            mine, begin = anchors[begin:end], end
            for at, h, hot in mine:
                anchor, first, last = at >> 16, (at >> 8) & 255, at & 255
                start, n = anchor - first, first - last + 1
                body = text[start : start + n - 1 + LENGTH]
                if not hot:
                    meet((h, body, n, first), (id_, k, start))
                    continue
                for i in range(n):
                    one = body[i : i + LENGTH]
                    meet((xxhash.xxh64_intdigest(one) - (1 << 63), one, 1, 0), (id_, k, start + i))
        rows = [(k, k, id_, start, end - start, 0, None) for k, id_, start, end in _merged(gone)] + [(h, k, id_, start, n, lead, body) for (h, body, n, lead), (id_, k, start) in seen.items()]
        if rows:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_CONTEXT_NAMES)


def _words_at(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every position, as one big-endian number; the end is padded."""
    padded, out = np.r_[raw, np.zeros(7, np.uint8)], np.zeros(len(raw), dtype=np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(raw)]
    return out


def _classes(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal rows together, and the class number along that order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order, np.cumsum(new)


def equal_strings(raw: np.ndarray, at: np.ndarray, group: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of ``raw`` at ``at`` that agree with another of their group in ``length`` bytes: (suffixes, leaf) in parts.

    Shallow: a multikey sort, one eight-byte character a level; a suffix alone in its class leaves. Deep: in every
    remaining class a blind trie grows level by level. Its first suffix is the spine; every other branches off at the
    first character that differs (or ends in the spine's leaf) and goes on below that branch with those that took it.
    """
    words, rows = _words_at(raw), np.arange(len(at))
    label = group
    for depth in [*range(0, min(shallow, length - 8), 8)]:
        order, label = _classes(label, words[at[rows] + depth])
        rows = rows[order]
        many = np.bincount(label)[label] > 1
        rows, label = rows[many], label[many]
    depths = [*range(0, length - 8, 8), length - 8]
    while len(rows):
        order = np.argsort(label, kind="stable")
        rows, label = rows[order], label[order]
        begin = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
        spine = np.repeat(rows[begin], np.diff(np.r_[begin, len(rows)]))
        branch, char = np.full(len(rows), length), np.zeros(len(rows), dtype=np.uint64)
        for depth in depths:
            same = np.flatnonzero(branch == length)
            mine = words[at[rows[same]] + depth]
            off = same[mine != words[at[spine[same]] + depth]]
            branch[off] = depth
            char[off] = words[at[rows[off]] + depth]
        leaf = branch == length
        yield rows[leaf], spine[leaf]
        rows, label, branch, char = rows[~leaf], label[~leaf], branch[~leaf], char[~leaf]
        if len(rows):
            order, label = _classes(label, branch, char)
            rows = rows[order]
            many = np.bincount(label)[label] > 1
            rows, label = rows[many], label[many]


def gone_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """k, start, end of the bytes that go, from whole groups of contexts."""
    whole = batch.column("body").is_valid()
    done, batch = batch.filter(pc.invert(whole)), batch.filter(whole)
    h, k, ids, start, n, lead = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _CONTEXT_NAMES[:6])
    gone_k, gone_start, gone_n = (done.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "start", "n"))
    out = [(gone_k, gone_start, gone_start + gone_n)]
    if batch.num_rows > 1:
        _, offsets, data = batch.column("body").buffers()
        offsets = np.frombuffer(offsets, dtype=np.int32)[: batch.num_rows + 1]  # filtered arrays start at 0
        raw = np.frombuffer(data, dtype=np.uint8)[: offsets[-1]]
        row = np.repeat(np.arange(batch.num_rows), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        group = np.cumsum(np.r_[False, h[1:] != h[:-1]])[row]
        ids, key, start = ids[row], k[row], start[row] + step
        gone = np.zeros(len(row), dtype=bool)
        for some, leaf in equal_strings(raw, offsets[:-1][row] + step, group * (2 * LENGTH) + lead[row] - step + LENGTH):
            if len(some):
                order = np.lexsort((start[some], key[some], ids[some], leaf))
                first = np.r_[True, leaf[order][1:] != leaf[order][:-1]]
                earliest = some[order][first][np.cumsum(first) - 1]
                mine = some[order]
                gone[mine[(start[mine] != start[earliest]) | (key[mine] != key[earliest])]] = True
        hit = np.flatnonzero(gone)
        if len(hit):
            fresh = np.r_[True, (np.diff(hit) != 1) | (row[hit][1:] != row[hit][:-1])]
            first, last = hit[fresh], hit[np.r_[fresh[1:], True]]
            out.append((key[first], start[first], start[last] + LENGTH))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["k", "start", "end"])


def _sort_groups(batches: Iterator[pa.RecordBatch], chunk: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Input sorted by h: whole groups, some megabytes at a time; the last, perhaps open group waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in slices(batches, "body", chunk):
        held.append(batch)
        if sum(b.nbytes for b in held) < chunk:
            continue
        rows = pa.concat_batches(held)
        h = rows.column("h").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(h, h[-1]))
        if cut:
            yield gone_runs(rows.slice(0, cut))
        held = [rows.slice(cut)]
    if held:
        yield gone_runs(pa.concat_batches(held))


def _rows(docs: DataFrame, more: Sequence[Column] = ()) -> DataFrame:
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    return docs.select(F.xxhash64(id_, text).alias("k"), id_.alias("id"), text.alias("text"), *more)


def repeated_runs(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """k and the runs (start, end) of bytes that go, for every row key that loses some. ``rows``: k, id, text, and more.

    Every use takes all columns of ``rows``, so that one exchange of the texts serves them all.
    """
    versions = rows.select("k", "id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n"))
    first = versions.groupBy("sha").agg(F.min(F.struct("id", "k")).alias("f"), F.max("n").alias("n"))
    kept = first.where(F.col("n") >= LENGTH).select(F.col("f.k").alias("k"))
    copies = versions.where(F.col("n") >= LENGTH).join(first.select("sha", F.col("f.k").alias("first")), "sha").where("k != first")
    copied = copies.select("k", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    anchors = rows.join(kept, "k").mapInArrow(_anchor_rows, "h long, k long, at long")
    repeated = anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", (F.col("n") > hot).alias("hot"))
    both = lambda df: df.withColumn("bit", F.col("h").bitwiseAND(1).cast("byte"))  # noqa: E731  an exchange of its own below the join, which can then split a frequent h
    found = both(anchors).join(both(repeated), ["bit", "h"]).groupBy("k").agg(F.collect_set(F.struct("at", "h", "hot")).alias("found"))
    contexts = rows.join(found, "k").mapInArrow(_context_rows, _CONTEXT)
    runs = contexts.repartition("h").sortWithinPartitions("h").mapInArrow(_sort_groups, "k long, start long, end long")
    return runs.unionByName(copied).groupBy("k").agg(F.collect_set(F.struct("start", "end")).alias("runs"))


def _removed_mask(n: int, runs: list[dict] | None) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int32)
    for r in runs or ():
        edge[r["start"]] += 1
        edge[r["end"]] -= 1
    return np.cumsum(edge[:n]) > 0


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        out = []
        for id_, text, runs in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "runs")), strict=True):
            gone = _removed_mask(len(text), runs)
            kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if runs else text
            out.append((None if id_ == LAST else id_, len(text), len(text) - len(kept), int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = _rows(docs)
    return rows.join(repeated_runs(rows), "k", "left").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts, stays = [], []
        for raw, null, runs in zip(*(batch.column(c).to_pylist() for c in ("text", "null", "runs")), strict=True):
            if runs:
                raw = np.frombuffer(raw, dtype=np.uint8)[~_removed_mask(len(raw), runs)].tobytes()
            texts.append(None if null else raw.decode("utf-8", "ignore"))
            stays.append(not runs or bool(texts[-1]))
        columns = [pa.array(texts, type=pa.string()) if n == "text" else batch.column(f"own_{i}") for i, n in enumerate(names)]
        yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays))


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated bytes; bytes of a character that is cut in two go too. ``n_chars``, if any, follows.

    A document that loses all of its text is left out; one that was empty before stays.
    """
    names = docs.columns
    own = [F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(names) if c != "text"]
    rows = _rows(docs, [F.col("text").isNull().alias("null"), *own])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    cut = rows.join(repeated_runs(rows), "k", "left").mapInArrow(lambda it: _cut(it, names), schema)
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut
