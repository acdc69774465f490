"""What one task of the suffix sort and of the language model holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from hourpanel.llm import bloom_lm, suffix_dedup


def peak_mb(work) -> float:
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def texts(n: int, size: int) -> pa.RecordBatch:
    rng = np.random.default_rng(5)
    letters = rng.integers(97, 123, (n, size), dtype=np.uint8)
    letters[:, ::6] = 32
    return pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([r.tobytes().decode() for r in letters])], names=["k", "text"])


def test_words_of_eight_megabytes():
    batch = texts(800, 10_000)
    assert peak_mb(lambda: bloom_lm.sequences(bloom_lm.Words(), batch)) < 150


def test_anchors_of_eight_megabytes():
    batch = texts(800, 10_000)
    batch = batch.set_column(1, "text", batch.column("text").cast(pa.binary()))
    assert peak_mb(lambda: sum(b.num_rows for b in suffix_dedup._anchor_rows(iter([batch])))) < 100
