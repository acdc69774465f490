"""Clusters, token alignment and language-model scores against brute force, with the defined edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hourpanel.llm import bloom_lm, centroid_clusters, token_alignment

RNG = random.Random(5)
WORDS = [a + b for a in "ka lo mi tu sen ra vor el".split() for b in "ta ne li o us am".split()]
SENTENCE = lambda n: " ".join(RNG.choice(WORDS) for _ in range(n))
CLASHING = "doc_id long, text string, n int, word string, row int, pair string, kind string, cell int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w", 2, "p", "doc", 3) for i, t in rows], CLASHING).repartition(3)


@pytest.fixture(scope="module")
def rows():
    out = [(i, SENTENCE(30 + i)) for i in range(40)]
    out += [(100, None), (101, ""), (102, " \n "), (103, out[0][1].upper()), (104, "a ▁ b"), (105, "tab\tx\r\ny;\r\n"), (106, "<|endoftext|> <s> <0x41>")]
    out += [(107, "nb  x  y\n\n z \n"), (108, "日本語 é ﬁ\0x"), (109, "x\x1cy it's"), (110, "\nlead"), (111, SENTENCE(20_000)), (112, "q" * 3000)]
    return [*out, (0, out[0][1]), (0, out[0][1]), (None, out[1][1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows)


# Clusters


def brute_clusters(vectors, clusters, rounds, seed=2):
    """Rows (vec_id, list) to assignments, in plain integers."""
    whole = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in whole if i is not None)
    at = [v for _, v in order[:clusters]]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), k) for k, c in enumerate(at))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in whole]
        new = []
        for k, c in enumerate(at):
            mine = [v for (_, v), o in zip(whole, own, strict=True) if o == k]
            new.append([sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else c)
        at = new
    found = [(i, *near(v)[::-1]) for i, v in whole]
    per = Counter()
    for _, k, d in found:
        per[k] += d
    return sorted(((i, k, d, per[k], sum(per.values()), hashlib.sha256(",".join(map(str, at[k])).encode()).hexdigest()) for i, k, d in found), key=repr)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(0, 1, 8).astype(np.float32).tolist()) for i in range(150)]
    good += [(200 + i, [0.5] * 8) for i in range(30)] + [(7, good[7][1]), (7, good[7][1]), (None, good[3][1]), (300, [-1e3] * 8), (301, [0.0] * 8)]
    bad = [(400, None), (401, [1.0] * 7), (402, [1.0] * 7 + [None]), (403, [1.0] * 7 + [float("nan")]), (404, [1.0] * 7 + [float("inf")]), (405, [])]
    vectors = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in good + bad], "vec_id long, embedding array<float>, cluster int, v string, n string").repartition(3)
    for clusters, rounds in ((9, 3), (200, 1), (1, 2)):
        got = centroid_clusters.cluster(vectors, clusters, rounds, components=8)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters(good, clusters, rounds)
    assert centroid_clusters.cluster(vectors.where("vec_id >= 400"), components=8).count() == 0
    with pytest.raises(Exception, match="too large"):
        centroid_clusters.cluster(spark.createDataFrame([(1, [1e9] * 8)], "vec_id long, embedding array<float>"), components=8).collect()


def test_search_rejects_most_centroids_and_keeps_ties():
    rng = np.random.default_rng(5)
    at = rng.integers(-100, 100, (40, 64)) + rng.integers(-300, 300, (40, 1))
    at[30], at[12] = at[5], at[5]
    x = np.concatenate([at, rng.integers(-100, 100, (500, 64)) + rng.integers(-300, 300, (500, 1))])
    number, distance, exact = centroid_clusters.Centroids(at).nearest(x)
    d = ((x[:, None] - at[None]) ** 2).sum(axis=2)
    assert (number == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all() and number[30] == 5
    assert exact < 0.7 * d.size


# Alignment


def spelled(ids, pieces):
    return [pieces[i] for i in ids]


def brute_alignment(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok, sp = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a_tok.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    held, out = Counter(), []
    for i, text in rows:
        a = b = a_at = b_at = []
        if text:
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            a_bytes = [bytes(byte_of[c] for c in a_tok.id_to_token(x)) for x in a]
            b_bytes = [bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a = b = []
            else:
                a_at = [k for k, x in enumerate(a_bytes) for _ in x]
                b_at = [k for k, x in enumerate(b_bytes) for _ in x]
        links = list(dict.fromkeys(zip(a_at, b_at, strict=True)))
        cuts = [k + 1 for k in range(len(a_at)) if k + 1 == len(a_at) or (a_at[k] != a_at[k + 1] and b_at[k] != b_at[k + 1])]
        parts = [[list(dict.fromkeys(at[s:e])) for at in (a_at, b_at)] for s, e in zip([0, *cuts], cuts, strict=False)]
        groups = ";".join("|".join(",".join(str(ids[k]) for k in p) for ids, p in zip((a, b), part, strict=True)) for part in parts)
        pairs = [(a[x], b[y]) for x, y in links]
        held.update(set(pairs))
        out.append((i, len(a), len(b), len(parts), pairs, hashlib.sha256(groups.encode()).hexdigest() if a else "", sum(len(p) * len(q) for p, q in parts)))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return sorted(((i, n_a, n_b, n_g, len(p), sum(held[q] == most[q[0]] for q in p), sum(held[q] for q in p), sha, g) for i, n_a, n_b, n_g, p, sha, g in out), key=repr)


def test_alignment_equals_brute_force(docs, rows):
    want = brute_alignment(rows)
    assert sum(w[1] == 0 for w in want) == 4  # null twice, empty, U+2581
    for top in (1 << 18, 40):  # with and without pairs that meet their counts in the join
        assert sorted(map(tuple, token_alignment.digest(docs, top=top).collect()), key=repr) == want


def test_alignment_of_whole_texts(docs, rows):
    want = {r[0]: r for r in brute_alignment(rows) if r[0] is not None}
    for r in token_alignment.align(docs.where("doc_id is not null")).collect():
        w = want[r.doc_id]
        assert (len(r.a), len(r.b), len(set(r.a_group)), len(r.links)) == w[1:5] and (not r.a or sum(x.bytes for x in r.links) == len((" " + dict(rows)[r.doc_id]).encode()))
    assert token_alignment.digest(docs.limit(0)).count() == 0


def test_sparse_products():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, y = rng.integers(0, 3, (7, 9)) * (rng.random((7, 9)) < 0.4), rng.integers(0, 3, (9, 5)) * (rng.random((9, 5)) < 0.4)

        def sparse(m):
            r, c = np.nonzero(m)
            return token_alignment.Csr(np.searchsorted(r, np.arange(len(m) + 1)), c, m[r, c], m.shape[1])

        def dense(s):
            out = np.zeros((len(s.first) - 1, s.width), dtype=int)
            out[np.repeat(np.arange(len(s.first) - 1), np.diff(s.first)), s.column] = s.value
            return out

        assert (dense(sparse(x).times(sparse(y))) == x @ y).all() and (dense(sparse(x).transposed()) == x.T).all()
        assert (sparse(x).applied(np.arange(9)) == x @ np.arange(9)).all()
    a, b = np.array([2, 5, 6, 9]), np.array([1, 5, 9])
    common, ga, gb = token_alignment.groups(a, b)
    links = token_alignment.group_links(ga, gb, len(common))
    assert (np.diff(links.first) == token_alignment.n_group_links(ga, gb, len(common))).all() and links.column.tolist() == [0, 1, 0, 1, 2, 2]


def test_overlaps_do_not_depend_on_the_block(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = (np.append(np.flatnonzero(rng.random(4000) < 0.3) + 1, 5000) for _ in range(2))
    whole = token_alignment.overlaps(a, b)
    monkeypatch.setattr(token_alignment, "BLOCK", 50)
    assert all((x == y).all() for x, y in zip(whole, token_alignment.overlaps(a, b), strict=True)) and whole[2].sum() == 5000


# Language model


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute_scores(rows, weight):
    held_out = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 7 == 2
    word, pair = Counter(), Counter()
    for i, t in rows:
        if held_out(i) is False:
            w = tokens(t)
            word.update(w)
            pair.update(zip([1, *w], w, strict=False))
    total = sum(word.values()) + len(word) + 1
    level = lambda n: math.ceil(1.5 ** math.floor(math.log(n) / math.log(1.5) + 1e-9) - 1e-9)
    out = []
    for i, t in rows:
        w, model = tokens(t), 0.0
        for h, x in zip([1, *w], w, strict=False):
            n = word[None] if h == 1 else word[h]
            model += math.log10(level(pair[h, x]) / (n + weight)) if pair[h, x] else math.log10(weight / (n + weight) * (word[x] + 1) / total)
        out.append((i, held_out(i), len(w), sum(word[x] > 0 for x in w), sum(word.values()), sum(math.log10((word[x] + 1) / total) for x in w), model))
    return sorted(out, key=repr)


def test_scores_equal_brute_force(docs, rows):
    want = brute_scores(rows, bloom_lm.WEIGHT)
    for settings in ({}, {"top": 5, "segment": 3000}):  # one segment; many, and most words by the join
        got = sorted(map(tuple, bloom_lm.score(docs, **settings).collect()), key=repr)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert all(abs(g[5] - w[5]) < 1e-6 for g, w in zip(got, want, strict=True))
        # false positives lift some absent pairs, by about 1 in 80
        gap = [abs(g[6] - w[6]) / w[2] for g, w in zip(got, want, strict=True)]
        assert sum(x < 1e-6 for x in gap) > 0.5 * len(gap) and sum(g[6] - w[6] for g, w in zip(got, want, strict=True)) < 0.05 * sum(w[2] for w in want)


def test_pairs_tell_order_from_disorder(spark):
    phrase = WORDS * 3
    some = [(i, " ".join(phrase[i % 40 : i % 40 + 50])) for i in range(140)]
    held = next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2)
    other = next(i for i in range(held + 1, 1200) if zlib.crc32(str(i).encode()) % 7 == 2)
    by = {r.doc_id: r for r in bloom_lm.score(docs_of(spark, [*some, (held, " ".join(phrase[5:55])), (other, " ".join(sorted(phrase[5:55], reverse=True)))])).collect()}
    assert by[held].score > by[held].base_score + 20 and by[held].score > by[other].score + 20 and abs(by[held].base_score - by[other].base_score) < 1e-6


def test_scores_of_nothing(spark):
    assert bloom_lm.score(docs_of(spark, [])).count() == 0
    unlearned = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (only,) = bloom_lm.score(docs_of(spark, [(unlearned, "a b")])).collect()
    assert only.train_tokens == only.n_known == 0 and only.n_tokens == 3 and only.base_score == only.score == 0


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(6)
    key = np.unique(rng.integers(0, 1 << 63, 40_000).astype(np.uint64) << np.uint64(1))
    count = rng.zipf(1.7, len(key)).clip(1, 5000)
    cell = (key >> np.uint64(62)).astype(int)
    pieces = [bloom_lm.filter_piece(key[cell == c], count[cell == c]) for c in range(4)]
    found = bloom_lm.Filter(0, 4, np.array([len(p) for p in pieces]), b"".join(pieces), 4).counts(key)
    exact = np.ceil(bloom_lm.BASE ** (bloom_lm.levels(count) - 1.0) - 1e-9)
    assert (found >= exact).all() and (exact <= count).all() and (found == exact).mean() > 0.97
    absent = bloom_lm.mix(rng.integers(0, 1 << 63, 40_000).astype(np.uint64))
    assert (bloom_lm.Filter(0, 4, np.array([len(p) for p in pieces]), b"".join(pieces), 4).counts(absent) > 0).mean() < 0.02


def test_words_do_not_depend_on_pieces(monkeypatch):
    import pyarrow as pa

    texts = pa.RecordBatch.from_arrays([pa.array([SENTENCE(500), None, "", "One  tWo\x0bone", SENTENCE(300) + " ", "x" * 700, "é one"])], names=["text"])
    whole = bloom_lm.sequences(bloom_lm.Words(), texts)
    monkeypatch.setattr(bloom_lm, "PIECE", 64)
    cut = bloom_lm.sequences(bloom_lm.Words(), texts)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    expected = [len(tokens(t)) for t in texts.column("text").to_pylist()]
    assert np.bincount(whole[1]).tolist() == expected
    four = whole[0][whole[1] == 3]
    assert four[0] == four[2] != four[1] and four[0] in whole[0][whole[1] == 6]
