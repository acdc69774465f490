"""Alignment of two tokenizers over the bytes they both cover.

A text becomes tokens of a byte-level vocabulary (A, over space and text) and of a piece vocabulary (B, which adds the
space). Both cover the same bytes, so token-byte incidence matrices in compressed sparse rows give the links: row i of A
times B transposed, row by row after Gustavson, holds the number of bytes that token i shares with every token of B. Bytes
where tokens of both end cut the text into groups; the product of the token-group matrices links tokens of one group, and
its row sums (their number) come without writing the links out.

Words repeat, so most of the work is done once a word: neither vocabulary joins what stands before white space to what
follows it (checked when the piece vocabulary is read), and a text of spaces and line feeds only is cut before every run of them;
units, each with the white space before it, are encoded and multiplied together when first met and kept in a bounded memo.
Any other text is encoded whole. Tests compare both ways.

How many documents hold an id pair linked is counted over all documents: tasks add up before the exchange. The most
frequent pairs, at most ``TOP``, are sent to the tasks; the other pairs of a document meet their counts in an equi-join.

Defined cases: a null or empty text, or one whose joined bytes differ from space and text (U+2581, for one), has zeros and
an empty digest; repeated rows count as documents of their own; a row without doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourpanel.session import materialise

from .common import id_text, most_frequent, slices

TOP = 1 << 18
#: Units and characters that the memo holds; bytes multiplied at once; pairs a task counts before it ships them.
MEMO, MEMO_CHARS, BLOCK, HELD = 300_000, 1 << 24, 1 << 20, 1 << 22
PIECE_BITS = 16


class Csr:
    """Sparse rows: the entries of row i are ``column[first[i]:first[i + 1]]`` with ``value`` alike."""

    def __init__(self, first: np.ndarray, column: np.ndarray, value: np.ndarray, width: int) -> None:
        self.first, self.column, self.value, self.width = first, column, value, width

    @classmethod
    def of_ranges(cls, ends: np.ndarray) -> Csr:
        """Row i covers the columns from the end of row i - 1 to its own."""
        n = int(ends[-1]) if len(ends) else 0
        return cls(np.concatenate([np.zeros(1, dtype=np.int64), ends]), np.arange(n), np.ones(n, dtype=np.int64), n)

    @classmethod
    def of_labels(cls, label: np.ndarray, width: int) -> Csr:
        """Row i has its only entry in column ``label[i]``."""
        return cls(np.arange(len(label) + 1), label, np.ones(len(label), dtype=np.int64), width)

    def transposed(self) -> Csr:
        order = np.argsort(self.column, kind="stable")
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))[order]
        return Csr(np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(np.bincount(self.column, minlength=self.width))]), row, self.value[order], len(self.first) - 1)

    def times(self, other: Csr) -> Csr:
        """Product by rows: every entry of a row brings the other's row of its column; equal columns are added up."""
        size = np.diff(other.first)[self.column]
        row = np.repeat(np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)), size)
        start = np.repeat(other.first[self.column] - np.cumsum(size) + size, size)
        at = start + np.arange(len(start))
        key, value = row * other.width + other.column[at], np.repeat(self.value, size) * other.value[at]
        if len(key) and (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        total = np.add.reduceat(value, new) if len(new) else value
        row, column = np.divmod(key[new], max(1, other.width))
        return Csr(np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(np.bincount(row, minlength=len(self.first) - 1))]), column, total, other.width)

    def applied(self, vector: np.ndarray) -> np.ndarray:
        """Product with a column vector."""
        return np.bincount(np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)), self.value * vector[self.column], minlength=len(self.first) - 1).astype(np.int64)


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in A and in B of tokens that share bytes, and how many they share, in order.

    Bytes are taken in blocks that end where tokens of both end, so that memory follows the block, not the text.
    """
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    found, at = [], 0
    while at < (a_ends[-1] if len(a_ends) else 0):
        far = common[max(np.searchsorted(common, at + BLOCK, "right") - 1, np.searchsorted(common, at, "right"))]
        a0, a1 = np.searchsorted(a_ends, [at, far], "right")
        b0, b1 = np.searchsorted(b_ends, [at, far], "right")
        links = Csr.of_ranges(a_ends[a0:a1] - at).times(Csr.of_ranges(b_ends[b0:b1] - at).transposed())
        found.append((np.repeat(np.arange(a0, a1), np.diff(links.first)), links.column + b0, links.value))
        at = int(far)
    if not found:
        return tuple(np.zeros((3, 0), dtype=np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the groups, and the group of each token of A and of B."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return common, np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)


def group_links(a_group: np.ndarray, b_group: np.ndarray, n: int) -> Csr:
    """Tokens of A by tokens of B that share a group."""
    return Csr.of_labels(a_group, n).times(Csr.of_labels(b_group, n).transposed())


def n_group_links(a_group: np.ndarray, b_group: np.ndarray, n: int) -> np.ndarray:
    """Row sums of ``group_links``, from two products with a vector."""
    in_group = Csr.of_labels(b_group, n).transposed().applied(np.ones(len(b_group), dtype=np.int64))
    return Csr.of_labels(a_group, n).applied(in_group)


class Tokenizers:
    """Both vocabularies: ids of a text and the bytes of each id."""

    def __init__(self, ranks: str, pattern: str, pieces: str) -> None:
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.a = tiktoken.Encoding("alignment", pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.a_bytes = [b""] * (max(merges.values()) + 1)
        for piece, rank in merges.items():
            self.a_bytes[rank] = piece
        model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.b = lambda texts: model.encode(texts, num_threads=1)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        #: No piece goes from text over a space, nor holds a line feed: then texts may be cut before white space.
        self.cuts = not any(re.search("[^▁]▁|\n", p) for p in names)
        (self.blank,) = (i for i, p in enumerate(names) if p == "▁")

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[bool]]:
        """Ids of ``texts``, which begin with white space, and whether both cover exactly their bytes.

        B puts a space before a text: the first one of a text is left to it, a line feed's text loses it again.
        """
        a = [np.array(self.a(t), dtype=np.int64) for t in texts]
        b = []
        for t, ids in zip(texts, self.b([t[1:] if t[0] == " " else t for t in texts]), strict=True):
            if t == " ":
                ids = [self.blank]
            b.append(np.array(ids if t[0] == " " else ids[1:], dtype=np.int64))
        same = []
        for t, x, y in zip(texts, a, b, strict=True):
            raw = t.encode()
            same.append(raw == b"".join(map(self.a_bytes.__getitem__, x.tolist())) and raw == b"".join(map(self.b_bytes.__getitem__, y.tolist())))
        return a, b, same


    def joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and of B over all units and how many each unit has, encoded as one text; none if that does not give
        their bytes with a cut after each unit. Units begin with white space and end without."""
        text = "".join(units)
        raw, ends = text.encode(), np.cumsum([len(u.encode()) for u in units])
        out = []
        for ids, size, pieces in ((self.a(text), self.a_size, self.a_bytes), (self.b(text[1:]) if text[0] == " " else self.b(text)[1:], self.b_size, self.b_bytes)):
            if raw != b"".join(map(pieces.__getitem__, ids)):
                return None
            ids = np.array(ids, dtype=np.int64)
            mine = np.cumsum(size[ids])
            last = np.searchsorted(mine, ends)
            if (mine[last] != ends).any():
                return None
            out += [ids, np.diff(last, prepend=-1)]
        return tuple(out)


def default_vocabularies() -> tuple[str, str, str]:
    """Ranks and pattern of A, the model of B."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


class Ragged:
    """Rows of different lengths, appended and gathered."""

    def __init__(self, kind) -> None:
        self.first, self.body, self.n = np.zeros(1, dtype=np.int64), np.zeros(1 << 16, dtype=kind), 0

    def extend(self, sizes: np.ndarray, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.body):
            self.body = np.concatenate([self.body, np.zeros_like(self.body)])
        self.body[self.n : self.n + len(values)] = values
        self.n += len(values)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of ``rows`` one after another, and how many each has."""
        size = self.first[rows + 1] - self.first[rows]
        start = np.repeat(self.first[rows] - np.cumsum(size) + size, size)
        return self.body[start + np.arange(len(start))], size


class Units:
    """Alignment of text units, each computed once: numbers (n_a, n_b, n_groups, n_links, n_group_links), groups as text,
    and the id pairs of their links."""

    EXOTIC = re.compile(r"[^\S \n]")
    CUT = re.compile(r"[ \n]+[^ \n]*")

    def __init__(self, tokenizers: Tokenizers) -> None:
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.numbers = np.zeros((1024, 5), dtype=np.int64)
        self.faithful = np.zeros(1024, dtype=bool)
        self.groups: list[str] = []
        self.links = Ragged(np.uint32)

    def cut(self, text: str) -> list[str]:
        """Units of a text that begins with a space."""
        return self.CUT.findall(text) if self.tokenizers.cuts and not self.EXOTIC.search(text) else [text]

    def learn(self, units: list[str]) -> None:
        """Align ``units``, each of them new."""
        t = self.tokenizers
        self.chars += sum(map(len, units))
        plain = [u for u in units if t.cuts and not u[-1].isspace() and not self.EXOTIC.search(u)]
        plain.sort(key=lambda u: u[0] != " ")
        alone = [u for u in units if u[-1].isspace() or not t.cuts or self.EXOTIC.search(u)]
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            found = t.joined(some)
            if found:
                self._keep(some, *found, np.ones(len(some), dtype=bool))
            else:
                alone += some
        for at in range(0, len(alone), 4096):
            some = alone[at : at + 4096]
            a, b, same = t.ids(some)
            a, b = ([x if ok else x[:0] for x, ok in zip(ids, same, strict=True)] for ids in (a, b))
            self._keep(some, np.concatenate(a), np.array([len(x) for x in a]), np.concatenate(b), np.array([len(x) for x in b]), np.array(same))

    def _keep(self, units: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, same: np.ndarray) -> None:
        t, m, n = self.tokenizers, len(units), len(self.groups)
        a_ends, b_ends = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
        a_at, b_at, _ = overlaps(a_ends, b_ends)
        common, a_group, b_group = groups(a_ends, b_ends)
        a_unit = np.repeat(np.arange(m), n_a)
        shared = np.bincount(a_unit, n_group_links(a_group, b_group, len(common)), minlength=m)
        n_groups = np.bincount(a_unit[np.searchsorted(a_ends, common)], minlength=m)
        links = np.bincount(a_unit[a_at], minlength=m)
        self.links.extend(links, (a[a_at] << PIECE_BITS | b[b_at]).astype(np.uint32))
        while n + m > len(self.numbers):
            self.numbers, self.faithful = np.concatenate([self.numbers, self.numbers * 0]), np.concatenate([self.faithful, self.faithful])
        self.numbers[n : n + m] = np.stack([n_a, n_b, n_groups, links, shared], axis=1)
        self.faithful[n : n + m] = same
        a_text, b_text = list(map(str, a.tolist())), list(map(str, b.tolist()))
        both = [",".join(a_text[i:j]) + "|" + ",".join(b_text[k:l]) for (i, j), (k, l) in zip(_spans(a_group), _spans(b_group), strict=True)]
        bounds = np.cumsum(n_groups).tolist()
        self.groups += [";".join(both[i:j]) for i, j in zip([0, *bounds], bounds, strict=False)]
        self.index.update(zip(units, range(n, n + m), strict=True))

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the units of each text; an empty array where the tokens do not give the text."""
        if len(self.index) > MEMO or self.chars > MEMO_CHARS:
            self.clear()
        cut = [self.cut(" " + t) if t else [] for t in texts]
        self.learn(list(dict.fromkeys(u for units in cut for u in units if u not in self.index)))
        out = []
        for text, units in zip(texts, cut, strict=True):
            at = np.fromiter(map(self.index.__getitem__, units), dtype=np.int64, count=len(units))
            if not self.faithful[at].all() and len(units) > 1:  # judged by its joined bytes, as a whole
                whole = " " + text
                if whole not in self.index:
                    self.learn([whole])
                at = np.array([self.index[whole]])
            out.append(at if self.faithful[at].all() else at[:0])
        return out


def _spans(group: np.ndarray) -> zip:
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return zip(first.tolist(), np.append(first[1:], len(group))[: len(first)].tolist(), strict=True)


def _encoded(batches: Iterator[pa.RecordBatch], vocabularies: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    """A row a document with its digest and id pairs, and rows of kind pair: how many documents of this task hold each."""
    units, keys, counts, held = Units(Tokenizers(*vocabularies)), [], [], 0
    numbers = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")
    schema = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in numbers], ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()), ("pair", pa.int64()), ("n", pa.int64())])

    def shipped() -> pa.RecordBatch:
        key, n = _summed(np.concatenate(keys), np.concatenate(counts))
        keys[:], counts[:] = [key[:0]], [n[:0]]
        full = {"kind": pa.array(["pair"] * len(key)), "pair": pa.array(key.astype(np.int64)), "n": pa.array(n)}
        return pa.RecordBatch.from_arrays([full.get(f.name, pa.nulls(len(key), f.type)) for f in schema], schema=schema)

    for batch in slices(batches, "text", 2 << 20):
        found = units.of(batch.column("text").to_pylist())
        n = len(found)
        doc = np.repeat(np.arange(n), [len(x) for x in found])
        unit = np.concatenate([np.zeros(0, dtype=np.int64), *found])
        own, times = np.unique(doc << 32 | unit, return_counts=True)  # distinct units of a document
        pair, size = units.links.gather(own & 0xFFFFFFFF)
        key = (np.repeat(own >> 32, size).astype(np.uint64) << np.uint64(32)) | pair
        key, total = _summed(key, np.repeat(times, size))
        pair = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        bounds = np.searchsorted((key >> np.uint64(32)).astype(np.int64), np.arange(n + 1))
        held_by = _summed(pair, np.ones(len(pair), dtype=np.int64))
        keys.append(held_by[0])
        counts.append(held_by[1])
        held += len(held_by[0])
        sums = [np.bincount(doc, units.numbers[unit, i], minlength=n).astype(np.int64) for i in range(5)]
        text = [";".join(map(units.groups.__getitem__, x.tolist())) for x in found]
        digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text]
        spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        arrays = [pa.array(["doc"] * n), batch.column("doc_id"), *map(pa.array, sums), pa.array(digests)]
        arrays += [pa.array([pair[i:j].astype("<u4").tobytes() for i, j in spans], type=pa.binary()), pa.array([_small(total[i:j]) for i, j in spans], type=pa.binary())]
        yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)
        if held > HELD:
            yield shipped()
            held = 0
    if held:
        yield shipped()


def _small(n: np.ndarray) -> bytes:
    return n.astype(np.uint8 if n.max(initial=0) < 256 else np.int64).tobytes()


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([np.ones(1, dtype=bool), key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


_MET = "row long, n_best long, count_sum long, pair long, times long"


def _meet(batches: Iterator[pa.RecordBatch], send) -> Iterator[pa.RecordBatch]:
    """Sums over a document's frequent pairs, and a row for each of its other pairs."""
    top, count, best = send.value
    for batch in batches:
        n = batch.num_rows
        pairs = [np.frombuffer(p, dtype="<u4") for p in batch.column("pairs").to_pylist()]
        times = [np.frombuffer(t, dtype=np.uint8 if len(t) == len(p) else np.int64).astype(np.int64) for p, t in zip(pairs, batch.column("times").to_pylist(), strict=True)]
        row = np.repeat(np.arange(n), [len(p) for p in pairs])
        pair, times = np.concatenate([np.zeros(0, dtype=np.uint32), *pairs]), np.concatenate([np.zeros(0, dtype=np.int64), *times])
        unique, back = np.unique(pair, return_inverse=True)
        at = np.minimum(np.searchsorted(top, unique), max(0, len(top) - 1))
        known = (top[at] == unique)[back] if len(top) else np.zeros(len(pair), dtype=bool)
        at = at[back][known]
        total, n_best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        np.add.at(total, row[known], times[known] * count[at])
        np.add.at(n_best, row[known], times[known] * best[at])
        ids = batch.column("row").to_numpy()
        rest = np.flatnonzero(~known)
        none = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_best), pa.array(total), none, none], names=["row", "n_best", "count_sum", "pair", "times"])
        if len(rest):
            zero = pa.array(np.zeros(len(rest), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row[rest]]), zero, zero, pa.array(pair[rest].astype(np.int64)), pa.array(times[rest])], names=["row", "n_best", "count_sum", "pair", "times"])


def digest(docs: DataFrame, vocabularies: tuple[str, str, str] | None = None, top: int = TOP) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_group_links of every row of ``docs``."""
    spark = docs.sparkSession
    vocabularies = vocabularies or default_vocabularies()
    kinds = "kind string, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_group_links long, groups_sha256 string, pairs binary, times binary, pair long, n long"
    first = materialise(id_text(docs).mapInArrow(lambda it: _encoded(it, vocabularies), kinds).withColumn("row", F.monotonically_increasing_id()), "alignments")
    held = first.where("kind = 'pair'").groupBy("pair").agg(F.sum("n").alias("n"))
    side = F.shiftright("pair", PIECE_BITS).alias("a")
    most = held.groupBy(side).agg(F.max("n").alias("most"))
    held = materialise(held.select("pair", "n", side).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "pairs")
    frequent = most_frequent(held, "n", top).toPandas().sort_values("pair")  # at most ``top`` rows
    send = spark.sparkContext.broadcast((frequent["pair"].to_numpy().astype(np.uint32), frequent["n"].to_numpy(np.int64), frequent["best"].to_numpy(np.int64)))
    met = materialise(first.where("kind = 'doc'").select("row", "pairs", "times").mapInArrow(lambda it: _meet(it, send), _MET), "links")
    send.destroy()
    rest = met.where("pair is not null").join(held, "pair").select("row", (F.col("times") * F.col("best")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_group_links"]
    zero = F.lit(0).cast("long")
    about = first.where("kind = 'doc'").select("row", "doc_id", *numbers, "groups_sha256", zero.alias("n_best"), zero.alias("count_sum"))
    sums = met.where("pair is null").select("row", "n_best", "count_sum").unionByName(rest)
    sums = sums.select("row", F.lit(None).cast("long").alias("doc_id"), *[F.lit(None).cast("long").alias(c) for c in numbers], F.lit(None).cast("string").alias("groups_sha256"), "n_best", "count_sum")
    one = about.unionByName(sums).groupBy("row").agg(*[F.max(c).alias(c) for c in ("doc_id", *numbers, "groups_sha256")], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return one.select("doc_id", *numbers[:4], "n_best", "count_sum", "groups_sha256", "n_group_links")


_ALIGNED = "doc_id long, a array<bigint>, b array<bigint>, a_group array<bigint>, b_group array<bigint>, links array<struct<a:bigint,b:bigint,bytes:bigint>>"


def _aligned(batches: Iterator[pa.RecordBatch], vocabularies: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    t = Tokenizers(*vocabularies)
    for batch in slices(batches, "text", 2 << 20):
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            a, b, same = (x[0] for x in t.ids([" " + text])) if text else (np.zeros(0, dtype=np.int64),) * 2 + (False,)
            if not same:
                a, b = a[:0], b[:0]
            a_ends, b_ends = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
            _, a_group, b_group = groups(a_ends, b_ends)
            links = [dict(zip(("a", "b", "bytes"), x, strict=True)) for x in zip(*(v.tolist() for v in overlaps(a_ends, b_ends)), strict=True)]
            rows.append({"doc_id": doc, "a": a.tolist(), "b": b.tolist(), "a_group": a_group.tolist(), "b_group": b_group.tolist(), "links": links})
        ints = pa.list_(pa.int64())
        schema = pa.schema([("doc_id", pa.int64()), ("a", ints), ("b", ints), ("a_group", ints), ("b_group", ints), ("links", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("bytes", pa.int64())])))])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def align(docs: DataFrame, vocabularies: tuple[str, str, str] | None = None) -> DataFrame:
    """Per document the ids of both tokenizers, the group of each token, and the links with the bytes they share."""
    vocabularies = vocabularies or default_vocabularies()
    return id_text(docs).mapInArrow(lambda it: _aligned(it, vocabularies), _ALIGNED)
