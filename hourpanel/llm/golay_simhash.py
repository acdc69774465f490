"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A document's 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a 23-bit word. The perfect
binary Golay code (23, 12) maps every word to the one codeword within three bits. The keys of a segment are the codewords
of the word and of its 23 one-bit neighbours: one key if the word lies within two bits of its codeword, six otherwise.
With at most three errors over three segments, at least two segments have at most one error each (3+0+0, 2+1+0, 1+1+1).
So for some pair of segments the own codewords of one fingerprint are among the keys of the other, and rows meet under
(pair, codeword, codeword). Rows that meet are compared exactly; the result is every link at ``MAX_BITS`` or fewer.

Distinct fingerprints only take part, so copies cost nothing. A bucket yields a spanning set of its links, not all pairs.

Defined cases: null or wordless text has fingerprint zero; fewer than three words hash the whole sequence; repeated rows
and repeated doc_id values keep one result per row; a null doc_id takes part, and the component is named by the smallest
non-null doc_id (null if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices
from .components import connected_components

WIDTH = 3
SEED = 42
MAX_BITS = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the perfect binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprint(text: str, width: int = WIDTH) -> int:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only the six blanks split
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        some = words[at : at + (1 << 16) + width - 1]
        grams = map(b" ".join, zip(*[some[k:] for k in range(width)], strict=False)) if len(words) >= width else [b" ".join(some)]
        h = np.fromiter((digest(g, SEED) for g in grams), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def _keyed_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        (found,) = _fingerprints(iter([batch]))
        yield found.append_column("key", batch.column("key"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    return id_text(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


class Golay:
    """Syndrome decoding of 23-bit words; tables of 4,096 and 2,048 entries are derived from the generator."""

    def __init__(self) -> None:
        def residue(x: np.ndarray) -> np.ndarray:
            for k in range(22, 10, -1):
                x = np.where((x >> k) & 1, x ^ (GENERATOR << (k - 11)), x)
            return x

        ints = np.arange(1 << 12, dtype=np.int64)
        self.low, self.high = residue(ints), residue(ints[: 1 << 11] << 12)
        one = 1 << np.arange(23, dtype=np.int64)
        two = (one[:, None] | one[None, :]).ravel()
        three = np.unique(np.concatenate([[0], one, two, (two[:, None] | one[None, :]).ravel()]))  # all patterns of 0 to 3 errors
        self.error = np.zeros(1 << 11, dtype=np.int64)
        self.error[self.syndrome(three)] = three

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.low[x & 0xFFF] ^ self.high[x >> 12]

    def index(self, x: np.ndarray) -> np.ndarray:
        """Message bits of the nearest codeword."""
        return (x ^ self.error[self.syndrome(x)]) >> 11

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Rows of 24 sorted indices, of the word and its neighbours; repeats are marked -1."""
        near = np.sort(self.index(x[:, None] ^ np.concatenate([[0], 1 << np.arange(23, dtype=np.int64)])[None, :]), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        return near


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    return [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def bucket_keys(code: Golay, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every bucket a fingerprint enters: all key pairs of each pair of segments."""
    keys = [code.keys(s) for s in _segments(fp)]
    packed = []
    for k in keys:  # up to six per row, moved to the front
        order = np.argsort(k < 0, axis=1, kind="stable")[:, :6]
        packed.append(np.take_along_axis(k, order, axis=1))
    rows, out = [], []
    for number, (i, j) in enumerate(PAIRS):
        a, b = packed[i][:, :, None], packed[j][:, None, :]
        r, s, t = np.nonzero((a >= 0) & (b >= 0))
        rows.append(r)
        out.append((number << 24) | (packed[i][r, s] << 12) | packed[j][r, t])
    return np.concatenate(rows), np.concatenate(out)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Golay()
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fp = batch.column("fp").slice(at, 4096).to_numpy(zero_copy_only=False)
            rows, keys = bucket_keys(code, fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(fp[rows])], names=["key", "fp"])


def _spanning(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect one bucket: each visited row takes its unvisited neighbours, so a row is taken once."""
    rest, found = fp, []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= MAX_BITS
            if near.any():
                found += [(x, y) for y in rest[near]]
                front += list(rest[near])
                rest = rest[~near]
    return found


def bucket_links(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Links inside whole buckets (sorted by key). Pairs of neighbours at once; larger buckets one by one."""
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[begin, len(key)])
    found = []
    for n in (2, 3, 4):
        at = begin[size == n]
        for i in range(n):
            for j in range(i + 1, n):
                a, b = fp[at + i], fp[at + j]
                near = (np.bitwise_count(a ^ b) <= MAX_BITS) & (a != b)
                found.append(np.stack([a[near], b[near]], axis=1))
    for at, n in zip(begin[size > 4], size[size > 4], strict=True):
        links = _spanning(np.unique(fp[at : at + n]))
        if links:
            found.append(np.array(links, dtype=np.uint64))
    return np.concatenate(found) if found else np.zeros((0, 2), dtype=np.uint64)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by key; the last, perhaps open bucket of a batch waits for the next one. Links seen before are left out."""
    keep_key, keep_fp, seen = [], [], set()

    def linked() -> pa.RecordBatch:
        pairs = np.unique(np.sort(bucket_links(np.concatenate(keep_key), np.concatenate(keep_fp)), axis=1), axis=0)
        fresh = [p for p in map(tuple, pairs.tolist()) if p not in seen]
        if len(seen) < 1_000_000:  # only saves repeats; distinct() follows
            seen.update(fresh)
        out = np.array(fresh, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        fp = fp.view(np.uint64)
        cut = int(np.searchsorted(key, key[-1]))  # start of the bucket that may go on
        if cut or (keep_key and keep_key[-1][-1] != key[0]):
            keep_key.append(key[:cut])
            keep_fp.append(fp[:cut])
            yield linked()
            keep_key, keep_fp = [], []
        keep_key.append(key[cut:])
        keep_fp.append(fp[cut:])
    if keep_key:
        yield linked()


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, enough to connect all that differ in ``MAX_BITS`` or fewer bits."""
    keyed = distinct.select("fp").mapInArrow(_emit_keys, "key int, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_link, "a long, b long").distinct()


def _named(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """fp, root of every distinct fingerprint of ``prints`` (doc_id, fp, ...), and root, component_id."""
    from hourpanel.session import materialise

    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(fingerprint_links(distinct)).withColumnRenamed("node", "fp")
    named = materialise(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    return named.select("fp", "root"), named.groupBy("root").agg(F.min("first").alias("component_id"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``."""
    from hourpanel.session import materialise

    prints = materialise(fingerprints(docs), "fingerprints")
    named, smallest = _named(prints)
    by_print = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest doc_id, then the smallest hash of its text.

    Components are of texts, not of identifiers: two texts under one doc_id may lie in different components and both stay.
    Of repeated rows (same doc_id and text) one stays. A row without doc_id cannot be named by a component and is kept.
    """
    from hourpanel.session import materialise

    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    held = docs.where("doc_id is not null")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("key"))
    prints = materialise(texts.mapInArrow(_keyed_fingerprints, "doc_id long, fp long, key long"), "fingerprints")
    named, _ = _named(prints)
    first = prints.where("doc_id is not null").join(named, "fp").groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("f"))
    first = first.select(F.col("f.doc_id").alias("first_id"), F.col("f.key").alias("first_key"))
    kept = held.join(first, (F.col("doc_id").cast("long") == F.col("first_id")) & (key == F.col("first_key")), "left_semi")
    own = kept.withColumn("_text_key", key).dropDuplicates(["doc_id", "_text_key"]).drop("_text_key")
    return own.unionByName(docs.where("doc_id is null"))
