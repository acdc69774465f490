"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output, trained in numpy.

A document is the bag of its words, their character n-grams and one mark for each pair of neighbouring words that says
whether the pair stood in the document before. Every bucket has a learned vector; their average goes through a softmax
over the two classes. Training is stochastic gradient descent on at most ``PER_CLASS`` labelled rows of each class (the
bound is the parameter); the features of these rows are counted by the tasks and only they reach the driver. Averages and
softmax are linear up to the output, so a task needs one number per bucket to score, and works through whole texts; there each distinct word of a batch is
looked up once. The bias is set to the share of the classes among all allowed labels.

Defined cases: null or wordless texts score by the output's bias alone; without labels of both classes every score is 0.5;
a null doc_id is not held out; repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices
from .subwords import BUCKETS, adagrad, bucket, remainder, training_sample, word_features, word_sums

PER_CLASS = 2_000
DIM = 8
EPOCHS = 4
BATCH = 32
RATE = 0.15
SLICE = 16 << 20  # bytes of text scored at a time
HELD_MODULUS, HELD_REST = 3, 1
PAIR_MARKS = ("pair seen", "pair new")


def features(text: str, memo: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a document and their counts."""
    words = text.split()
    bag = np.zeros(BUCKETS, dtype=np.int32)
    for word, n in Counter(words).items():
        if word not in memo:
            if len(memo) > 200_000:
                memo.clear()
            memo[word] = word_features(word)
        np.add.at(bag, memo[word], n)
    pairs = max(0, len(words) - 1)
    new = len(set(zip(words, words[1:], strict=False)))
    bag[bucket(PAIR_MARKS[0])] += pairs - new
    bag[bucket(PAIR_MARKS[1])] += new
    at = np.flatnonzero(bag)
    return at.astype(np.int32), bag[at]


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[str, list[int]] = {}
    for batch in slices(batches, "text"):
        rows = [features(t, memo) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), pa.array([a.tobytes() for a, _ in rows]), pa.array([c.tobytes() for _, c in rows])],
            names=["doc_id", "y", "at", "counts"],
        )


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Embeddings and softmax by stochastic gradient descent; returns what they come to: a number per bucket, and a bias."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    table_state, out, bias = np.zeros_like(table), np.zeros((DIM, 2)), np.zeros(2)
    share = [c / c.sum() for _, c in bags]
    prior = np.bincount(y, minlength=2) / len(y)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            at = np.concatenate([bags[i][0] for i in some])
            part = np.concatenate([share[i] for i in some])
            doc = np.repeat(np.arange(len(some)), [len(bags[i][0]) for i in some])
            rows = table[at]
            hidden = np.add.reduceat(rows * part[:, None], np.r_[0, np.flatnonzero(np.diff(doc)) + 1], axis=0)
            z = hidden @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = p - np.eye(2)[y[some]]
            error *= (0.5 / prior[y[some]])[:, None]
            back = error @ out.T
            out -= rate * hidden.T @ error
            bias -= rate * error.mean(axis=0)
            adagrad(table, table_state, at, back[doc] * part[:, None], rate)
    return (table @ (out[:, 1] - out[:, 0])), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Weights per bucket and bias, from rows that are not held out."""
    allowed = remainder(F.col("doc_id"), HELD_MODULUS) != HELD_REST
    sample, shift = training_sample(docs, labels, label, allowed, per_class)
    rows = sample.mapInArrow(_feature_rows, "doc_id long, y int, at binary, counts binary").toPandas().sort_values(["doc_id", "at"])
    bags = [(np.frombuffer(a, np.int32), np.frombuffer(c, np.int32)) for a, c in zip(rows["at"], rows["counts"], strict=True)]
    full = [i for i, (a, _) in enumerate(bags) if len(a)]
    y = rows["y"].to_numpy()
    if len(set(y[full])) < 2:
        return np.zeros(BUCKETS), 0.0
    weights, bias = train([bags[i] for i in full], y[full])
    return weights, bias + shift


def coded_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Document and code of every word occurrence, in order, and the distinct words that the codes stand for."""
    lists = pc.utf8_split_whitespace(text)
    doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.list_flatten(lists).dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = words.dictionary.to_pylist()
    if "" in distinct:  # white space at the ends of a text
        blank = distinct.index("")
        real = code != blank
        doc, code = doc[real], code[real]
    return doc, code, distinct


def new_pairs(doc: np.ndarray, code: np.ndarray, n_words: int, n_docs: int) -> np.ndarray:
    """Distinct pairs of neighbouring words per document."""
    inside = doc[1:] == doc[:-1]
    pair = ((doc[:-1] * n_words + code[:-1]) * n_words + code[1:])[inside]  # a slice holds under 2^24 words and 2^14 texts
    pair.sort()
    first = pair[np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])]
    return np.bincount(first // max(1, n_words * n_words), minlength=n_docs)


def _score(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    seen, new = (weights[bucket(m)] for m in PAIR_MARKS)
    for batch in slices(batches, "text", SLICE):
        n_docs = batch.num_rows
        doc, code, words = coded_words(batch.column("text"))
        rows = word_sums(words, weights)
        total, parts = (np.bincount(doc, weights=rows[code, i], minlength=n_docs) for i in (0, 1))
        pairs = np.maximum(np.bincount(doc, minlength=n_docs) - 1, 0)
        fresh = new_pairs(doc, code, len(words), n_docs)
        z = (total + (pairs - fresh) * seen + fresh * new) / np.maximum(parts + pairs, 1) + bias
        z = np.clip(z, -35, 35)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])


def scores(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # one number for each of BUCKETS
    scored = id_text(docs).mapInArrow(lambda it: _score(it, sent.value, bias), "doc_id long, score double")
    held = F.coalesce(remainder(F.col("doc_id"), HELD_MODULUS) == HELD_REST, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, fit(docs, labels))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the classifier does not reject, with their columns as they are."""
    weights, bias = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            text = batch.column(at).fill_null("")
            bare = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), type=pa.int64()), text], names=["doc_id", "text"])
            good = [s >= 0.5 for part in _score(iter([bare]), sent.value, bias) for s in part.column("score").to_pylist()]
            yield batch.filter(pa.array(good, type=pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
