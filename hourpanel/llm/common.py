"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the identifier (long) and the text; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (a lambda variable is never computed again)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def most_frequent(counts: DataFrame, n: str, top: int) -> DataFrame:
    """Rows with the largest ``n`` (at least 1), at most ``top`` of them: all above a bound that a histogram of at most a
    thousand steps gives. A sort with a limit would send as many rows from every task."""
    step = F.floor(F.log2(n) * 16)
    held = counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect()
    least, rows = None, 0
    for r in held:
        rows += r["rows"]
        if rows > top:
            break
        least = r["step"]
    return counts.where(F.lit(False)) if least is None else counts.where(step >= least)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each; a longer single value stays whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if col.nbytes <= limit:
            yield batch
            continue
        lengths = np.array([0 if v is None else v for v in pc.binary_length(col).to_pylist()])
        at, size = 0, 0
        for i, n in enumerate(lengths):
            if i > at and size + n > limit:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += int(n)
        yield batch.slice(at)


_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def run_hashes(raw: bytes, first: np.ndarray, last: np.ndarray, seed: int = 0, long: int = 512) -> np.ndarray:
    """64-bit hashes of ``raw[first:last]``, eight bytes of all runs at a time; the same on every machine."""
    import xxhash

    eight = np.ndarray(len(raw) + 1, dtype="<u8", buffer=raw + bytes(8), strides=(1,))
    left = last - first
    out = (left.astype(np.uint64) ^ np.uint64(seed)) * _SPREAD
    live, at = np.flatnonzero(left <= long), first
    if len(live) < len(left):
        for i in np.flatnonzero(left > long).tolist():
            out[i] = xxhash.xxh64_intdigest(raw[first[i] : last[i]], seed)
        at, left = at[live], left[live]
    while len(live):
        h = (out[live] ^ (eight[at] & _LOW_BYTES[np.minimum(left, 8)])) * _SPREAD
        out[live] = h ^ (h >> np.uint64(29))
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices first, first + 1, ... of every span of ``count``, one span after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


_WORD_BYTES = np.array([b > 0x7F or chr(b).isalnum() or b == 0x5F for b in range(256)])


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (``\\w+``) of all texts, one text after the other; how many words each has."""
    lower = [t.lower().encode() for t in texts]
    raw = b"\n".join([b"", *lower, b""])
    byte = np.frombuffer(raw, dtype=np.uint8)
    held = _WORD_BYTES[byte]
    lead = np.flatnonzero(byte > 0xBF)
    if len(lead):  # characters beyond ASCII: two to four bytes, of which the first tells how many
        size = 2 + (byte[lead] > 0xDF) + (byte[lead] > 0xEF)
        code = byte[lead] & (0x7F >> size)
        code = code.astype(np.int64)
        for k in range(1, 4):
            more = np.flatnonzero(size > k)
            code[more] = (code[more] << 6) | (byte[lead[more] + k] & 0x3F)
        some, which = np.unique(code, return_inverse=True)
        other = ~np.array([chr(c).isalnum() for c in some.tolist()])[which]
        held[spans(lead[other], size[other])] = False
    edge = np.flatnonzero(held[1:] != held[:-1]) + 1  # the first and the last byte are separators
    first, last = edge[::2], edge[1::2]
    begin = np.cumsum([1, *[len(t) + 1 for t in lower]])
    return run_hashes(raw, first, last), np.diff(np.searchsorted(first, begin))
