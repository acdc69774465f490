"""Toxicity classifier that is regularised by counterfactual texts.

A document is the set of its lower-cased words; a word is described by hashed features, itself and its character n-grams,
whose weights add up to the word's score. A logistic model sums the words' scores after ``bend``: scores below 1 hardly
count, so the small scores of the many plain words of a long text do not add up to anything. Each training text has a counterfactual twin in which the terms of an identity
group are swapped for other terms of that group; a text without such a term gets one put into its sentence in the middle.
Training lowers the usual loss and ``BALANCE`` times the squared change of the output between a text and its twin, so that
naming a group by itself moves no score.

Training uses at most ``PER_CLASS`` labelled rows of each class (the bound is the parameter); tasks find the
words of both texts, and only these reach the driver, which makes the features of every distinct word once. Scoring needs a number per bucket and reads whole texts.

Defined cases: null or wordless texts score by the bias alone; without labels of both classes every score is 0.5; a null
doc_id is not held out; repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import array
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices
from .subwords import BUCKETS, WordTable, adagrad, remainder, training_sample, word_features

PER_CLASS = 2_000
EPOCHS = 6
BATCH = 32
RATE = 0.2
SHRINK = 1e-3
BALANCE = 1.0
SLOPE = 0.02
HELD_MODULUS, HELD_REST = 5, 0
_WORD = re.compile(r"[^\W\d_]+").findall

#: Terms that name groups of people, by kind of group; terms of one line are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("mujeres", "hombres", "frauen", "männer", "femmes", "hommes"),
)
_GROUP = {term: group for group in IDENTITY_TERMS for term in group}


def counterfactual(text: str) -> str:
    """The text with every identity term swapped; one is put into the middle sentence if there is none.

    Which term is chosen depends only on the text.
    """
    pick = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    swapped = 0

    def other(match: re.Match) -> str:
        nonlocal swapped
        group = _GROUP.get(match[0].lower())
        if group is None:
            return match[0]
        swapped += 1
        rest = [t for t in group if t != match[0].lower()]
        return rest[(pick + swapped) % len(rest)]

    out = re.sub(r"[^\W\d_]+", other, text)
    if swapped:
        return out
    sentences = text.split(".")
    at = len(sentences) // 2
    group = IDENTITY_TERMS[pick % len(IDENTITY_TERMS)]
    sentences[at] += " " + group[(pick >> 8) % len(group)]
    return ".".join(sentences)


def bend(score: np.ndarray) -> np.ndarray:
    return SLOPE * score + np.maximum(score - 1, 0)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct words one after the other, and how many belong to each word."""
    return Bags([distinct_words(text)], Vocabulary())[0]


def distinct_words(text: str) -> str:
    """The distinct words in order, separated by spaces."""
    return " ".join(sorted(set(_WORD(text.lower()))))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = batch.column("text").to_pylist()
        arrays = [pa.array(map(distinct_words, some), type=pa.string()) for some in (texts, map(counterfactual, texts))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *arrays], names=["doc_id", "y", "words", "twin_words"])


class Vocabulary:
    """Numbers of words, and the buckets of each, one word after the other."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.buckets, self.ends = array.array("i"), array.array("q", [0])

    def numbers(self, words: list[str]) -> np.ndarray:
        for w in words:
            if w not in self.number:
                self.number[w] = len(self.number)
                self.buckets.extend(word_features(w))
                self.ends.append(len(self.buckets))
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int32, count=len(words))


class Bags:
    """Texts held as numbers of words; item ``i`` is what ``features`` gives for text ``i``."""

    def __init__(self, texts: Iterable[str], vocabulary: Vocabulary) -> None:
        self.vocabulary, self.texts = vocabulary, [vocabulary.numbers(t.split(" ")) if t else np.zeros(0, np.int32) for t in texts]

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        words, ends = self.texts[i], np.frombuffer(self.vocabulary.ends, dtype=np.int64)
        last = ends[words + 1]
        sizes = last - ends[words]
        at = np.arange(sizes.sum()) + np.repeat(last - np.cumsum(sizes), sizes)
        return (np.frombuffer(self.vocabulary.buckets, dtype=np.int32)[at] if len(at) else np.zeros(0, np.int32)), sizes.astype(np.int32)


def train(own: Sequence, twin: Sequence, y: np.ndarray, balance: float = BALANCE, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights per bucket and bias by stochastic gradient descent on loss + balance * (change of the output) ** 2."""
    rng = np.random.default_rng(seed)
    weights, state, bias = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0

    def total(bags: Sequence, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, the slope of the document's output in each of them, their document; and the outputs."""
        held = [bags[i] for i in some]
        at, sizes = np.concatenate([a for a, _ in held]), np.concatenate([n for _, n in held])
        word = np.repeat(np.arange(len(sizes)), sizes)
        doc = np.repeat(np.arange(len(some)), [len(n) for _, n in held])
        score = np.bincount(word, weights[at], minlength=len(sizes))
        return at, (SLOPE + (score > 1))[word], doc[word], np.bincount(doc, bend(score), minlength=len(some)) + bias

    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            at, n, doc, z = total(own, some)
            twin_at, twin_n, twin_doc, twin_z = total(twin, some)
            p, q = (1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (z, twin_z))
            change = 2 * balance * (p - q)
            g, twin_g = (p - y[some]) + change * p * (1 - p), -change * q * (1 - q)
            every = np.concatenate([at, twin_at])
            slope = np.concatenate([g[doc] * n, twin_g[twin_doc] * twin_n])
            adagrad(weights, state, every, slope + SHRINK * weights[every], rate)
            bias -= 0.1 * rate * g.mean()
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, balance: float = BALANCE) -> tuple[np.ndarray, float]:
    """Weights per bucket and bias, from rows that are not held out."""
    allowed = remainder(F.col("doc_id"), HELD_MODULUS) != HELD_REST
    sample, shift = training_sample(docs, labels, label, allowed, per_class)
    rows = sample.mapInArrow(_word_rows, "doc_id long, y int, words string, twin_words string").toPandas().sort_values(["doc_id", "words"])
    y = rows["y"].to_numpy()
    if len(set(y)) < 2:
        return np.zeros(BUCKETS), 0.0
    vocabulary = Vocabulary()
    weights, bias = train(Bags(rows["words"], vocabulary), Bags(rows["twin_words"], vocabulary), y, balance)
    return weights, bias + shift


def _score(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    table = WordTable(lambda word: bend(weights[word_features(word)].sum()), 1)
    for batch in slices(batches, "text"):
        out = [table.at(sorted(set(_WORD(t.lower())))).sum() + bias for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], names=["doc_id", "score"])


def scores(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    weights, bias = model
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # one number for each of BUCKETS
    scored = id_text(docs).mapInArrow(lambda it: _score(it, sent.value, bias), "doc_id long, score double")
    held = F.coalesce(remainder(F.col("doc_id"), HELD_MODULUS) == HELD_REST, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, fit(docs, labels))
