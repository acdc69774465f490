"""Words that are hashed, encoded or looked up many at a time, against one at a time."""

import random
import re

import numpy as np
import pyarrow as pa

from hourpanel.llm import bm25_packing, decontaminate
from hourpanel.llm.common import run_hashes, spans, word_hashes

RNG = random.Random(8)
WORD = lambda: "".join(RNG.choice("aebño日𝄞") for _ in range(RNG.choice([1, 2, 3, 7, 8, 9, 30])))


def test_run_hashes():
    words = [WORD().encode() for _ in range(500)] + [b"", b"\0", b"\0\0", b"q" * 511, b"q" * 512, b"q" * 513, b"q" * 2000, b"q" * 2001]
    words += words[::-1]
    last = np.cumsum([len(w) for w in words])
    got = run_hashes(b"".join(words), last - [len(w) for w in words], last, 3).tolist()
    assert len(set(zip(words, got))) == len(set(words)) == len(set(got))
    assert spans(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_memo_encodes_new_words_at_once():
    from tokenizers import Tokenizer

    vocabulary = bm25_packing.default_vocabulary()
    whole = Tokenizer.from_file(vocabulary[0])
    texts = [" ".join(RNG.choice([WORD(), WORD() + ".\n" + WORD(), "it's", "12,5"]) for _ in range(RNG.choice([1, 30]))) for _ in range(60)]
    texts += ["", " ", " a", "a ", "\na b", "a\n", "a  b", "a 　b", "x\x1c y", "<|endoftext|> x", "q" * 3000 + " r", "end.\nNext one", "nb  z", texts[0]]
    for limit in (1_000_000, 20):
        memo, calls = bm25_packing.Memo(vocabulary, limit), []
        encode = memo.encode
        memo.encode = lambda text: calls.append(text) or encode(text)  # noqa: B023
        for _ in range(2):
            got = memo.all_ids(texts)
            assert [np.frombuffer(ids, dtype="<u4").tolist() for ids in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(calls) < 3 * len(texts)


def test_similarity_keys_of_many_tails():
    rare = np.random.default_rng(1).random(bm25_packing.VOCABULARY) < 0.5
    tails = [np.random.default_rng(i).integers(0, 1 << 16, n, dtype="<u4") for i, n in enumerate([1, 1, 2, 3, 50, 1023, 1, 2])]
    tails += [np.flatnonzero(~rare)[:k].astype("<u4") for k in (1, 2, 9)] + [np.array([7, 7, 7], dtype="<u4")]
    got = list(bm25_packing._similarity_keys(iter([pa.RecordBatch.from_pydict({"tail": [t.tobytes() for t in tails]})]), rare))
    assert [n for b in got for n in b.column("near").to_pylist()] == [key(t, rare) for t in tails]


def key(tail, rare):
    ids = np.unique(tail).tolist()
    few = sorted(i * 0x9E3779B97F4A7C15 % (1 << 64) >> 40 for i in [i for i in ids if rare[i]] or ids)[:2]
    return few[0] << 24 | few[-1]


def test_word_hashes():
    chars = [*"aZ_9 \n.éΣİß日—½𝄞𐐀¿ǆ٣😀", "\u00a0", "\u0301", "\x1c", "\0"]
    texts = ["".join(RNG.choice(chars) for _ in range(RNG.randrange(40))) for _ in range(2000)] + ["", " ", "ΑΣ", "a" * 3000, "A" * 3000]
    got, size = word_hashes(texts)
    words = [re.findall(r"\w+", t.lower()) for t in texts]
    assert size.tolist() == [len(w) for w in words]
    flat = [w for own in words for w in own]
    assert len(set(zip(flat, got.tolist()))) == len(set(flat)) == len(set(got.tolist()))


def leaks_of(texts, items, meetings, monkeypatch):
    """Leaks as (text, item, score, end), and how many alignments they took."""
    monkeypatch.setattr(decontaminate, "MEETINGS", meetings)
    words, size = word_hashes(items)
    seeds = decontaminate.Seeds(list(range(len(items))), np.split(words, np.cumsum(size)[:-1]), 0.6)
    calls, align = [], decontaminate.align
    monkeypatch.setattr(decontaminate, "align", lambda *a: calls.append(1) or align(*a))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    got = [(r["doc_id"], r["item_id"], r["score"], r["end_word"]) for b in decontaminate._leaks(iter([batch]), seeds, 0.6) for r in b.to_pylist()]
    monkeypatch.undo()
    return got, len(calls)


def test_slices_of_documents_give_what_single_documents_give(monkeypatch):
    some = lambda n: " ".join(f"w{RNG.randrange(60)}" for _ in range(n))
    items = [some(n) for n in (2, 5, 6, 12, 30, 30)]
    texts = [some(RNG.randrange(80)) for _ in range(60)] + ["", items[4], items[5] + " " + items[5], some(40) + " " + items[3], items[4][:60], items[4][60:], *items[:3]]
    want = [(k, *row[1:]) for k, t in enumerate(texts) for row in leaks_of([t], items, 1 << 20, monkeypatch)[0]]
    assert len(want) > 4
    for meetings in (1 << 20, 3):
        assert sorted(leaks_of(texts, items, meetings, monkeypatch)[0]) == sorted(want)


def test_everyday_words_take_no_alignment(monkeypatch):
    item = "of the first kind and of the second kind and of the third kind that we saw in an old house near the sea one cold day"
    got, calls = leaks_of(["of the kind and " * 200, "x " + item.upper()], [item], 1 << 20, monkeypatch)
    assert [g[:2] for g in got] == [(1, 0)] and calls == 1
