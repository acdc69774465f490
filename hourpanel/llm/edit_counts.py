"""Token counts that follow edits: a segment tree of pre-tokens per document, re-encoded only where an edit touched it.

The vocabulary's pattern splits a text into pre-tokens that are encoded alone, so a text's count is the sum over them. A
tree's leaves are runs of about ``LEAF`` characters that end between pre-tokens; an inner node sums ``FANOUT`` children.
Trees are stored as a table with a row per document: the leaves' characters, and the sums level by level as arrays. So a
document, however long, is one row with its text, and one task's work.

An edit replaces ``length`` characters from ``start`` by ``insert``. Trees meet the edits of their document first, both
small; only then do they meet the texts by row key, so a text crosses the shuffle once. The leaves that an edit touches are
found by their offsets. A touched leaf is re-encoded together with boundary context: its neighbours, because a pre-token may
now reach over the leaf's edge. If the new split does not meet an old leaf's start again, one more leaf is taken, until it
does. Only the changed leaves and the sums above them are computed anew; where the number of leaves changes, the leaves
behind it have new places, and the sums above those are computed anew too.

Defined cases: null text is empty and has a tree with no leaf; an edit beyond the end appends there, a negative start
counts as 0, a null insert as empty; edits of one document refer to its state before all of them, in order of start, and
where they overlap the part already replaced is skipped, equal edits count once; edits of unknown documents do nothing; repeated rows (same doc_id
and text) share one tree and give a row each; of rows of one doc_id with different texts all get the document's edits.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourpanel.session import materialise

from .common import id_text, slices

LEAF = 512
FANOUT = 16


class Counter(dict):
    """Tokens of a pre-token, remembered up to ``limit``; ``cut`` splits a text into pre-tokens."""

    def __init__(self, vocabulary: tuple[str, str], limit: int = 300_000) -> None:
        import base64

        import regex
        import tiktoken

        ranks, pattern = vocabulary
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.cut, self.limit = regex.compile(pattern).findall, limit

    def __missing__(self, piece: str) -> int:
        if len(self) > self.limit:
            self.clear()
        n = len(self.encode(piece))
        if len(piece) < 100:
            self[piece] = n
        return n

    def leaves(self, text: str) -> list[tuple[str, int]]:
        """(text, tokens) of the leaves of ``text``."""
        out, part, size, total = [], [], 0, 0
        for piece in self.cut(text):
            part.append(piece)
            size += len(piece)
            total += self[piece]
            if size >= LEAF:
                out.append(("".join(part), total))
                part, size, total = [], 0, 0
        if part:
            out.append(("".join(part), total))
        return out


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def inner_sums(leaves: list[int]) -> list[list[int]]:
    """Levels above the leaves, up to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sum(low[i : i + FANOUT]) for i in range(0, len(low), FANOUT)])
    return levels[1:]


def renewed_sums(levels: list[list[int]], leaves: list[int], changed: set[int]) -> tuple[list[list[int]], int]:
    """Levels above ``leaves`` from those of the old tree, and how many sums were computed: those above ``changed`` places."""
    out, low, computed = [], leaves, 0
    for old, above in zip(levels, [*levels[1:], *[[]] * 64], strict=False):
        if len(low) <= 1:
            break
        if len(low) != len(old):
            changed = changed | {len(low) - 1} | set(range(len(old), len(low)))
        size = -(-len(low) // FANOUT)
        changed = {i // FANOUT for i in changed} | set(range(len(above), size))
        new = [*above[:size], *[0] * (size - len(above))]
        for i in changed:
            new[i] = sum(low[i * FANOUT : (i + 1) * FANOUT])
        computed += len(changed)
        out.append(new)
        low = new
    if len(low) > 1:  # the tree has become higher
        more = inner_sums(low)
        out, computed = out + more, computed + sum(map(len, more))
    return out, computed


_TREE = "k long, doc_id long, leaf_chars array<int>, levels array<array<int>>"


def _plant(batches: Iterator[pa.RecordBatch], vocabulary: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    count = Counter(vocabulary)
    for batch in slices(batches, "text"):
        rows = []
        for text in batch.column("text").to_pylist():
            leaves = count.leaves(text)
            tokens = [n for _, n in leaves]
            rows.append(([len(t) for t, _ in leaves], [tokens, *inner_sums(tokens)] if leaves else []))
        yield pa.RecordBatch.from_arrays(
            [batch.column("k"), batch.column("doc_id"), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.list_(pa.int32())))],
            names=["k", "doc_id", "leaf_chars", "levels"],
        )


def trees(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """k (row key), doc_id, characters of the leaves, token sums from the leaves to the root. Texts stay where they are."""
    vocabulary = vocabulary or default_vocabulary()
    keyed = id_text(docs).withColumn("k", F.xxhash64("doc_id", "text"))
    return keyed.mapInArrow(lambda it: _plant(it, vocabulary), _TREE)


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The new text, and (old start, old end, inserted characters) of every edit."""
    parts, at, done = [], 0, []
    for start, length, insert in sorted(edits):
        start = min(max(start, at), len(text))
        end = min(max(start + max(length, 0), start), len(text))
        parts += [text[at:start], insert]
        done.append((start, end, len(insert)))
        at = end
    return "".join([*parts, text[at:]]), done


def recount(count: Counter, text: str, chars: list[int], levels: list[list[int]], edits: list[tuple[int, int, str]]) -> tuple[str, list[int], list[list[int]], int]:
    """The edited text, its tree, and the characters that were encoded again."""
    new, done = apply_edits(text, edits)
    begin = [0]
    for n in chars:
        begin.append(begin[-1] + n)
    tokens = levels[0] if levels else []
    touched = sorted({i for s, e, _ in done for i in range(max(0, bisect_right(begin, s) - 3), min(len(chars), bisect_right(begin, e) + 1))})
    shift = lambda old: sum(n - (e - s) for s, e, n in done if e <= old)  # noqa: E731  of a place that no edit covers
    out_chars, out_tokens, changed, encoded, i = [], [], set(), 0, 0  # changed: leaves encoded again or at a new place
    if not chars:
        leaves = count.leaves(new)
        out_chars, out_tokens, encoded = [len(t) for t, _ in leaves], [n for _, n in leaves], len(new)
    touched_set = set(touched)
    while i < len(chars):
        if i not in touched_set:
            if i != len(out_chars):
                changed.add(len(out_chars))
            out_chars.append(chars[i])
            out_tokens.append(tokens[i])
            i += 1
            continue
        first = begin[i] + shift(begin[i]) if i else 0
        last = i
        while True:
            while last < len(chars) and last in touched_set:
                last += 1
            # one leaf of context behind: the split is good if it comes back to that leaf's start
            context = min(last + 1, len(chars))
            stop = begin[last] + shift(begin[last]) if last < len(chars) else len(new)
            end = begin[context] + shift(begin[context]) if context < len(chars) else len(new)
            ahead = new[end : end + 1]
            pieces = count.cut(new[first:end] + ahead)
            place, met = first, last >= len(chars)
            for n, piece in enumerate(pieces):
                if place == stop:
                    pieces, met = pieces[:n], True
                    break
                place += len(piece)
            encoded += end - first
            if met:
                break
            touched_set.add(last)
        part, size, total = [], 0, 0
        for piece in pieces:
            size += len(piece)
            total += count[piece]
            if size >= LEAF:
                changed.add(len(out_chars))
                out_chars.append(size)
                out_tokens.append(total)
                size, total = 0, 0
        if size:
            changed.add(len(out_chars))
            out_chars.append(size)
            out_tokens.append(total)
        i = last
    return new, out_chars, [out_tokens, *renewed_sums(levels, out_tokens, changed)[0]] if out_tokens else [], encoded


_RESULT = "doc_id long, n_chars long, n_leaves long, n_tokens_before long, n_tokens long, n_edits long, reencoded_chars long"


def _recount_rows(batches: Iterator[pa.RecordBatch], vocabulary: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    count = Counter(vocabulary)
    for batch in slices(batches, "text"):
        out = []
        for r in batch.to_pylist():
            edits = [(e["start"], e["length"], e["insert"]) for e in r["edits"] or ()]
            before = r["levels"][-1][0] if r["levels"] else 0
            new, chars, levels, encoded = recount(count, r["text"], r["leaf_chars"], r["levels"], edits) if edits else (r["text"], r["leaf_chars"], r["levels"], 0)
            out.append((r["doc_id"], len(new), len(chars), before, levels[-1][0] if levels else 0, len(edits), encoded))
        names = [c.split()[0] for c in _RESULT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], names=names)


def counts_after(docs: DataFrame, planted: DataFrame, edits: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Token counts of every row of ``docs`` before and after ``edits`` (doc_id, start, length, insert), from stored trees."""
    vocabulary = vocabulary or default_vocabulary()
    edit = F.struct(F.coalesce(F.col("start"), F.lit(0)).cast("long").alias("start"), F.coalesce(F.col("length"), F.lit(0)).cast("long").alias("length"), F.coalesce(F.col("insert"), F.lit("")).alias("insert"))
    per_doc = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("edited")).agg(F.collect_set(edit).alias("edits"))
    own = planted.select("k", "doc_id", "leaf_chars", "levels").join(per_doc, F.col("doc_id") == F.col("edited"), "left")
    due = own.select("k", "leaf_chars", "levels", "edits").dropDuplicates(["k"])
    both = id_text(docs).withColumn("k", F.xxhash64("doc_id", "text")).join(due, "k")
    return both.select("doc_id", "text", "leaf_chars", "levels", "edits").mapInArrow(lambda it: _recount_rows(it, vocabulary), _RESULT)


def revision(docs: DataFrame) -> DataFrame:
    """Edits made from the documents themselves, three for each: a cut in the middle, a source line above, an ending."""
    n = F.length(F.coalesce("text", F.lit("")))
    edit = lambda start, length, insert: F.struct(start.cast("long").alias("start"), F.lit(length).cast("long").alias("length"), insert.alias("insert"))
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    made = F.array(
        edit(n / 2, 40, F.substring("text", 3, 17)),
        edit(F.lit(0), 0, F.concat(F.lit("source: "), source, F.lit("\n"))),
        edit(n, 0, F.concat(F.lit("\n"), source)),
    )
    return docs.select("doc_id", F.explode(made).alias("e")).select("doc_id", "e.*")


def revised_counts(docs: DataFrame) -> DataFrame:
    """Counts of every document before and after ``revision``, from trees that are stored first."""
    return counts_after(docs, materialise(trees(docs), "trees"), revision(docs))
