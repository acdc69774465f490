"""Batch scoring of the quality classifier against a loop over the words of each text."""

import sys

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from hourpanel.llm import quality_classifier
from hourpanel.llm.subwords import BUCKETS, word_features, word_sums

WEIGHTS = np.random.default_rng(3).normal(size=BUCKETS)
BIAS = 0.25


def by_loop(text):
    at, counts = quality_classifier.features(text, {})
    total = counts.sum()
    z = (WEIGHTS[at] * counts).sum() / total + BIAS if total else BIAS
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def by_batch(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    out = list(quality_classifier._score(iter([batch]), WEIGHTS, BIAS))
    return [s for b in out for s in b.column("score").to_pylist()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t  é", max_size=30), min_size=1, max_size=6))
def test_batches_equal_loops(texts):
    assert np.allclose(by_batch(texts), [by_loop(t) for t in texts], rtol=0, atol=1e-12)


def test_white_space_is_the_same_in_training_and_scoring():
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    doc, _, _ = quality_classifier.coded_words(pa.array([f"a{c}a" for c in chars]))
    n = np.bincount(doc, minlength=len(chars))
    assert [c for c, k in zip(chars, n, strict=True) if k == 2] == [c for c in chars if c.isspace()]


def test_long_text_and_empty_batch():
    words = [f"w{i % 977}" for i in range(200_000)]
    assert np.allclose(by_batch([" ".join(words), "", "one"]), [by_loop(" ".join(words)), by_loop(""), by_loop("one")], rtol=0, atol=1e-12)
    assert by_batch([]) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abé<>電𝒳", min_size=1, max_size=12), max_size=20))
def test_word_sums_equal_word_features(words):
    got = word_sums([*words, "aaaaaaaa", "xyz" * 500, "電電電電電電", "é"], WEIGHTS, chunk=7)
    for w, (total, n) in zip([*words, "aaaaaaaa", "xyz" * 500, "電電電電電電", "é"], got, strict=True):
        at = word_features(w)
        assert n == len(at) and np.isclose(total, WEIGHTS[at].sum(), rtol=0, atol=1e-9)
