"""Packing documents into training sequences with neighbours found by BM25.

Every document becomes its token ids and a closing id 0. Runs of ``WINDOW`` ids fill sequences of their own; the rest of a
document, its tail, shares a sequence with lexically near tails. Tails are dealt to shards by a similarity key (the
smallest hash of their rarer tokens), every shard holds an inverted index over token ids with BM25 weights, and a seed
tail's query returns unused neighbours, best first, that fill its window; a neighbour that is too long is cut, and what is
left of it stays unused for a later window. The last rest of a shard goes into sequences whose lengths are powers of two,
which need no padding.

Document frequencies and lengths cover all documents; there are as many counts as the vocabulary has tokens, and that
table, bounded by ``VOCABULARY``, is what is sent to the tasks. A shard holds at most ``SHARD`` tails.

Ids are those that ``tokenizers`` gives. The byte-level vocabulary splits a text by a fixed pattern before any merge, so a
word's ids come from a bounded memo, filled through the vocabulary's ranks by one call for all new words of a slice of
texts; tests compare with ``tokenizers`` itself.

Defined cases: null text is empty (only the closing id); repeated rows are packed one by one; a row without doc_id too.
"""

from __future__ import annotations

import array
import base64
import re
import secrets
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourpanel.session import materialise

from .common import id_text, run_hashes, slices, spans

WINDOW = 1024
SHARD = 512
VOCABULARY = 1 << 16
K1, B = 1.2, 0.75
#: A token counts as rare for the similarity key when at most this share of the documents holds it.
RARE_SHARE = 0.05
END_ID = 0
SPECIAL = "<|endoftext|>"
_DOUBLED = re.compile(r"\s\s").search

_PASS_ONE = "kind string, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, tail binary, token int, n long"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Memo:
    """Token ids as little-endian unsigned 32-bit bytes; holds those of words seen before, each with the space before it.

    The vocabulary's pattern never joins what stands before a single space to what follows it, so a text without doubled
    white space or white space at its end is the concatenation of its words' ids. Any other text is encoded whole. Words
    are told apart by 64-bit hashes whose seed differs from task to task.
    """

    def __init__(self, vocabulary: tuple[str, str, str], limit: int = 1_000_000) -> None:
        import tiktoken

        self.path, ranks, pattern = vocabulary
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.sizes = np.zeros(VOCABULARY, dtype=np.int64)
        self.sizes[list(merges.values())] = list(map(len, merges))  # bytes of a token
        self.limit, self.whole, self.seed = limit, None, secrets.randbits(63)
        self.clear()

    def clear(self) -> None:
        self.words, self.first, self.count = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.held = np.zeros(0, dtype="<u4")

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode words, those after a space as one text, and keep the ids; where they begin and how many they are."""
        spaced = np.fromiter((w[:1] == b" " for w in words), dtype=bool, count=len(words))
        text = b"".join(w for w in words if w[:1] == b" ").decode()
        ids = np.array(self.encode(text), dtype="<u4")
        ends = np.cumsum([len(w) for w in words if w[:1] == b" "])
        count = np.zeros(len(words), dtype=np.int64)
        count[spaced] = np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1, prepend=0)
        alone = [self.encode(w.decode()) for w in words if w[:1] != b" "]  # at the start of a text
        count[~spaced] = [len(i) for i in alone]
        first = np.zeros(len(words), dtype=np.int64)
        for some in (spaced, ~spaced):
            first[some] = np.cumsum(count[some]) - count[some] + (0 if some is spaced else len(ids))
        first += len(self.held)
        self.held = np.concatenate([self.held, ids, np.array([i for a in alone for i in a], dtype="<u4")])
        return first, count

    def plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that are cut before every space."""
        if len(self.words) > self.limit or len(self.held) > 10 * self.limit:
            self.clear()
        texts = [t.encode() for t in texts]
        raw = b"".join(texts)
        cut = np.frombuffer(raw, dtype=np.uint8) == 32
        cut[np.cumsum([0, *map(len, texts[:-1])])] = True
        first = np.flatnonzero(cut)
        last = np.r_[first[1:], len(raw)]
        word = run_hashes(raw, first, last, self.seed)
        order = np.argsort(word)
        new = np.r_[True, word[order[1:]] != word[order[:-1]]]
        which = np.empty(len(order), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        one = order[new]  # a place of every different word, by hash
        at = np.searchsorted(self.words, word[one])
        missing = np.r_[self.words, np.zeros(1, dtype=np.uint64)][at] != word[one]
        missing |= at == len(self.words)
        if missing.any():
            some = one[missing]
            begin, count = self.learn([raw[a:b] for a, b in zip(first[some].tolist(), last[some].tolist(), strict=True)])
            self.words, self.first, self.count = (np.insert(old, at[missing], own) for old, own in ((self.words, word[some]), (self.first, begin), (self.count, count)))
            at = at + np.cumsum(missing) - missing
        count = self.count[at][which]
        ids = self.held[spans(self.first[at][which], count)].tobytes()
        ends = 4 * np.cumsum(np.add.reduceat(count, np.searchsorted(first, np.cumsum([0, *map(len, texts[:-1])]))))
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def all_ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        plain = [bool(t) and not t[-1].isspace() and not _DOUBLED(t) and SPECIAL not in t for t in texts]
        cut = iter(self.plain([t for t, p in zip(texts, plain, strict=True) if p]) if any(plain) else [])
        return [next(cut) if p else self.ids_whole(t) for t, p in zip(texts, plain, strict=True)]

    def ids(self, text: str) -> bytes:
        return self.all_ids([text])[0]

    def ids_whole(self, text: str) -> bytes:
        if SPECIAL in text:  # the special token's own string has an id of its own
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return array.array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array.array("I", self.encode(text)).tobytes()


def default_vocabulary() -> tuple[str, str, str]:
    """The vocabulary's file for ``tokenizers``, the same as ranks, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _tokenise(batches: Iterator[pa.RecordBatch], window: int, vocabulary: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    """Full windows, tails and, at the end, how many of the documents seen hold each token."""
    memo, df = Memo(vocabulary), np.zeros(VOCABULARY, dtype=np.int64)
    schema = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("tail", pa.binary()), ("token", pa.int32()), ("n", pa.int64())])
    size = 4 * window
    for batch in slices(batches, "text", 4 << 20):
        rows, raws = [], [ids + b"\0\0\0\0" for ids in memo.all_ids(batch.column("text").to_pylist())]
        at = np.repeat(np.arange(len(raws)) * VOCABULARY, [len(raw) // 4 for raw in raws]) + np.frombuffer(b"".join(raws), dtype="<u4")
        at.sort()
        df += np.bincount(at[np.r_[True, at[1:] != at[:-1]]] % VOCABULARY, minlength=VOCABULARY)
        for doc, raw in zip(batch.column("doc_id").to_pylist(), raws, strict=True):
            total = len(raw) // 4
            for at in range(0, len(raw) - size + 1, size):
                rows.append(("full", doc, at // 4, window, zlib.crc32(raw[at : at + size]), total, None, None, None))
            if len(raw) % size:
                at = len(raw) - len(raw) % size
                rows.append(("tail", doc, at // 4, (len(raw) - at) // 4, None, total, raw[at:], None, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    held = np.flatnonzero(df)
    nothing = [pa.nulls(len(held), type=f.type) for f in list(schema)[1:7]]
    yield pa.RecordBatch.from_arrays([pa.array(["count"] * len(held)), *nothing, pa.array(held.astype(np.int32)), pa.array(df[held])], schema=schema)


def _similarity_keys(batches: Iterator[pa.RecordBatch], rare: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds ``near``: two small hashes of a tail's rarer tokens; tails that share much get the same key often."""
    spread = ((np.arange(VOCABULARY, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)  # all different
    none = 1 << 24  # above all of them
    for batch in slices(batches, "tail", 4 << 20):
        tails = batch.column(batch.schema.get_field_index("tail")).to_pylist()
        length = np.array([len(raw) // 4 for raw in tails])
        first, ids = np.cumsum(length) - length, np.frombuffer(b"".join(tails), dtype="<u4")
        value = np.where(rare[ids], spread[ids], none)
        common = np.repeat(np.minimum.reduceat(value, first) == none, length)  # no rarer token
        value[common] = spread[ids[common]]
        low = np.minimum.reduceat(value, first)
        value[value == np.repeat(low, length)] = none
        high = np.minimum.reduceat(value, first)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low << 24 | np.where(high == none, low, high))], names=[*batch.schema.names, "near"])


class Index:
    """Inverted index of one shard: for every token the tails that hold it, with their BM25 weights."""

    def __init__(self, tails: list[np.ndarray], lengths: np.ndarray, idf: np.ndarray, mean_length: float) -> None:
        unique = [np.unique(t, return_counts=True) for t in tails]
        self.terms = [u for u, _ in unique]
        token = np.concatenate([u for u, _ in unique])
        tail = np.repeat(np.arange(len(tails)), [len(u) for u, _ in unique])
        tf = np.concatenate([c for _, c in unique]).astype(np.float64)
        weight = idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[tail] / mean_length))
        order = np.argsort(token, kind="stable")
        tokens, first = np.unique(token[order], return_index=True)
        last, tail, weight = np.r_[first[1:], len(order)], tail[order], weight[order]
        shared = np.flatnonzero(last - first > 1)  # a token of one tail brings it no neighbour
        self.at = np.full(VOCABULARY, -1)
        self.at[tokens[shared]] = np.arange(len(shared))
        held = list(zip(first[shared].tolist(), last[shared].tolist(), strict=True))
        self.tail, self.weight = [tail[a:b] for a, b in held], [weight[a:b] for a, b in held]
        self.n = len(tails)

    def scores(self, seed: int) -> np.ndarray:
        """Scores of all tails, but for what the seed's own tokens add to itself alone."""
        at = self.at[self.terms[seed]]
        at = at[at >= 0].tolist()
        if not at:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.tail[i] for i in at]), np.concatenate([self.weight[i] for i in at]), minlength=self.n)


def pack_shard(tails: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (tail, from, length). All are full, but for the last ones, whose lengths are powers of two."""
    lengths = np.array([len(t) for t in tails])
    index = Index(tails, lengths, idf, mean_length)
    used = np.zeros(len(tails), dtype=np.int64)  # ids of a tail that are placed
    sequences, rest = [], []
    for seed in np.argsort(-lengths, kind="stable"):
        if used[seed] >= lengths[seed]:
            continue
        score = index.scores(seed)
        score[seed] = np.inf
        open_ = np.flatnonzero(used < lengths)
        sequence, room = [], window
        for t in open_[np.argsort(-score[open_], kind="stable")]:
            n = min(room, int(lengths[t] - used[t]))
            sequence.append((int(t), int(used[t]), n))
            used[t] += n
            room -= n
            if room == 0:
                break
        if room == 0:
            sequences.append(sequence)
        else:
            rest = sequence  # everything left in the shard
    total, size = sum(n for *_, n in rest), window
    while total:
        while size > total:
            size //= 2
        sequence, room = [], size
        while room:
            t, at, n = rest[0]
            take = min(room, n)
            sequence.append((t, at, take))
            rest = ([(t, at + take, n - take)] if take < n else []) + rest[1:]
            room -= take
        sequences.append(sequence)
        total -= size
    return sequences


def _pack(batches: Iterator[pa.RecordBatch], idf: np.ndarray, mean_length: float, window: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 40 | 1 << 39  # apart from the ids of full windows
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    held: list[dict] = []

    def packed(rows: list[dict]) -> pa.RecordBatch:
        nonlocal number
        tails, out = [np.frombuffer(r["tail"], dtype="<u4") for r in rows], []
        for sequence in pack_shard(tails, idf, mean_length, window):
            offset = 0
            for t, at, n in sequence:
                out.append((rows[t]["doc_id"], rows[t]["start"] + at, n, zlib.crc32(tails[t][at : at + n].tobytes()), rows[t]["doc_tokens"], number, offset))
                offset += n
            number += 1
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], names=names)

    for batch in batches:
        held += batch.to_pylist()
        while len(held) >= SHARD:
            yield packed(held[:SHARD])
            held = held[SHARD:]
    if held:
        yield packed(held)


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: tuple[str, str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    vocabulary = vocabulary or default_vocabulary()
    first = materialise(id_text(docs).mapInArrow(lambda it: _tokenise(it, window, vocabulary), _PASS_ONE), "tokens")
    counts = first.where("kind = 'count'").groupBy("token").agg(F.sum("n").alias("n")).toPandas()  # at most VOCABULARY rows
    df = np.zeros(VOCABULARY)
    df[counts["token"].to_numpy()] = counts["n"].to_numpy()
    tail_rows = first.where("kind = 'tail'").select("doc_id", "start", "length", "doc_tokens", "tail")
    n_docs = df[END_ID]  # every document ends with it
    n_tails, mean_length = tail_rows.agg(F.count("*"), F.avg("length")).first()
    rare, idf = df <= max(1.0, RARE_SHARE * n_docs), np.log1p((n_docs - df + 0.5) / (df + 0.5))
    full = first.where("kind = 'full'").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("own"))
    full = full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.shiftright("own", 33) * (1 << 40) + F.col("own").bitwiseAND((1 << 33) - 1)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    keyed = tail_rows.mapInArrow(lambda it: _similarity_keys(it, rare), "doc_id long, start long, length long, doc_tokens long, tail binary, near long")
    order = ["near", "doc_id", "start"]
    dealt = keyed.repartitionByRange(max(1, -(-n_tails // (16 * SHARD))), *order).sortWithinPartitions(*order).drop("near")
    return full.unionByName(dealt.mapInArrow(lambda it: _pack(it, idf, mean_length or 1.0, window), _PIECES))
