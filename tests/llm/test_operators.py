"""Each text operator against a brute-force form, with nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns whose names clash with inner ones."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from hourpanel.llm import (
    bm25_packing, components, decontaminate, edit_counts, golay_simhash, line_frequency, quality_classifier, suffix_dedup, template_extraction, toxicity, warc_bundles,
)

RNG = random.Random(3)
WORDS = [a + b for a in "ka lo mi tu sen ra vor el".split() for b in "ta ne li o us am".split()]
SENTENCE = lambda n: " ".join(RNG.choice(WORDS) for _ in range(n))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, fp string, start int, runs string, h string, key string, words string"


def docs_of(spark, rows, schema=SCHEMA):
    full = [(i, t, "en", s, None if t is None else len(t), 5, "x", 1, "y", "z", "q", "w") for i, t, s in rows]
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="module")
def rows():
    base = [SENTENCE(60) for _ in range(8)]
    long = " ".join(SENTENCE(40) for _ in range(150))
    out = [(i, t, "a") for i, t in enumerate(base)]
    out += [(20, base[0], "a"), (21, base[0] + " tail words here", "b"), (22, base[1].upper(), "b"), (23, "", "a"), (24, None, None), (25, " \n\t ", "b"), (26, long, "a")]
    out += [(27, base[2] + "\n" + base[3] + "\n" + base[2], "c"), (28, "na " * 90, "a"), (29, "é" * 80 + base[4] + "日本語テキスト" * 20, "c"), (30, "one two", "a"), (30, "one two", "a"), (None, base[5], "a")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark):
    return docs_of(spark, [])


def duck(spark, docs, sql):
    con = duckdb.connect()
    documents = docs.toPandas()
    con.register("documents", documents)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted((tuple(dict(zip(names, r, strict=True)).items()) for r in got.fetchall()), key=repr)


def test_line_rules_equal_sql(spark):
    common = "this line stands on every page of the host 12"
    some = [(i, "\n".join([common, SENTENCE(30), SENTENCE(30)] if i % 2 else [common, SENTENCE(9)]), "a") for i in range(130)]
    some += [(200, "x y z x y z x y z", "a"), (201, None, "a"), (202, SENTENCE(20) + "\n" + "a\n" * 40, None), (203, "#*$ %&|<> q", "b"), (204, (SENTENCE(3) + " ") * 30, "b")]
    docs = docs_of(spark, some)
    got = line_frequency.judge(docs)
    rows = sorted((tuple(sorted(r.asDict().items())) for r in got.collect()), key=repr)
    want = sorted((tuple(sorted(dict(r).items())) for r in duck(spark, docs, line_frequency.ORACLE_SQL)), key=repr)
    assert rows == want
    lost = {r.doc_id: r.n_lost_words for r in got.collect()}
    assert lost[1] == len(common.split()) and lost[200] == 0
    cut = line_frequency.clean_text(docs)
    assert cut.columns == docs.columns and common not in cut.where("doc_id = 1").first().text


def test_line_rules_edge_cases(docs, rows, nothing):
    got = line_frequency.judge(docs).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 30 for r in got) == 2
    assert {r.doc_id for r in got if r.n_words == 0} == {23, 24, 25} and all(not r.kept for r in got if r.n_words < 50)
    assert next(r for r in got if r.doc_id == 28).base_failed
    assert line_frequency.judge(nothing).count() == 0


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs, rows, nothing):
    got = golay_simhash.components(docs).collect()
    assert len(got) == len(rows)
    prints = {(r.doc_id, r.fingerprint) for r in got}
    assert prints == {(i, format(brute_fingerprint(t), "016x")) for i, t, _ in rows}
    nodes = {format(brute_fingerprint(t), "016x") for _, t, _ in rows}
    root = {n: {n} for n in nodes}
    for a in nodes:
        for b in nodes:
            if (int(a, 16) ^ int(b, 16)).bit_count() <= 3 and root[a] is not root[b]:
                both = root[a] | root[b]
                for n in both:
                    root[n] = both
    want = {n: min((i for i, t, _ in rows if i is not None and format(brute_fingerprint(t), "016x") in root[n]), default=None) for n in nodes}
    assert all(r.component_id == want[r.fingerprint] for r in got)
    kept = golay_simhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (20, 22, 24)").count() == 0 and kept.where("doc_id = 30").count() == 1 and kept.where("doc_id is null").count() == 1
    assert golay_simhash.components(nothing).count() == 0


def test_every_component_keeps_a_text(spark):
    """Two texts of one doc_id are judged apart; repeated rows and near copies are not."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    docs = docs_of(spark, [(5, a, None), (5, b, None), (5, b, None), (3, b, None), (9, a, None), (7, c, None), (7, c, None)])
    assert sorted((r.doc_id, r.text[:1]) for r in golay_simhash.keep_first(docs).collect()) == [(3, "b"), (5, "a"), (7, "c")]


def test_golay_code():
    code = golay_simhash.Golay()
    x = np.arange(0, 1 << 23, 1013)
    word = x ^ code.error[code.syndrome(x)]
    assert (code.syndrome(word) == 0).all() and np.bitwise_count(x ^ word).max() <= 3 and len(np.unique(code.error)) == 2048
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)) for _ in a], dtype=np.uint64)
    both = [set(zip(*map(np.ndarray.tolist, golay_simhash.bucket_keys(code, v)), strict=True)) for v in (a, a ^ flips)]
    met = {r for r, k in both[0] & both[1]}
    assert met == set(range(len(a)))


def test_components_of_chains(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[201] == 200 and len(got) == 103


def brute_repeats(pairs):
    seen, out = set(), {}
    for i, t in sorted(pairs, key=lambda p: (p[0] is None, p[0])):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(b[s : s + 100])
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, docs, rows, nothing):
    got = suffix_dedup.digest(docs).collect()
    want = brute_repeats({i: t for i, t, _ in rows}.items())
    assert len(got) == len(rows) and {r.doc_id: tuple(r)[1:] for r in got} == want
    assert want[28][1] > 0 and want[27][1] > 0  # overlapping and later repeats in one text
    cut = suffix_dedup.cleaned(docs)
    texts = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns and 20 not in texts and texts[23].text == "" and texts[24].text is None and texts[27].n_chars == len(texts[27].text)
    assert suffix_dedup.digest(nothing).count() == 0 and suffix_dedup.cleaned(nothing).count() == 0


def test_suffix_dedup_frequent_anchors(spark):
    passage = SENTENCE(30)
    some = [(i, SENTENCE(5) + " " + passage + " " + SENTENCE(6)) for i in range(40)]
    rows = suffix_dedup._rows(spark.createDataFrame(some, "doc_id long, text string"))
    for hot in (5, 50_000):  # keyed by single strings, or by anchors
        runs = {r.k: sorted((x.start, x.end) for x in r.runs) for r in suffix_dedup.repeated_runs(rows, hot).collect()}
        got = {r.id: int(suffix_dedup._removed_mask(len(r.text), [dict(start=a, end=b) for a, b in runs.get(r.k, [])]).sum()) for r in rows.collect()}
        assert got == {i: v[1] for i, v in brute_repeats(some).items()}


def test_equal_strings_groups():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    raw[1000:1300] = raw[:300]
    at = np.arange(0, 2800)
    leaf = {}
    for some, lead in suffix_dedup.equal_strings(raw, at, np.zeros(len(at), dtype=np.int64)):
        leaf |= dict(zip(some.tolist(), lead.tolist(), strict=True))
    text, groups = raw.tobytes(), {}
    for i in at.tolist():
        groups.setdefault(text[i : i + 100], []).append(i)
    for same in groups.values():
        if len(same) > 1:
            assert len({leaf[i] for i in same}) == 1
    assert len(set(leaf.values())) >= sum(len(g) > 1 for g in groups.values())


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(bm25_packing.default_vocabulary()[0]).encode
    want = {i: np.array([*encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for i, t, _ in rows}
    got = bm25_packing.pack(docs).toPandas()
    for doc, part in got[got.doc_id != 30].groupby("doc_id", dropna=False):
        doc = None if doc != doc else int(doc)
        part = part.sort_values("start")
        ids = want[doc]
        assert (part.start.to_numpy() == np.r_[0, part.length.cumsum().to_numpy()[:-1]]).all() and part.length.sum() == len(ids) == part.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(part.start, part.length, part.ids_crc32, strict=True))
    assert got[got.doc_id == 30].length.sum() == 2 * len(want[30])
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        total = part.length.sum()
        assert (part.offset.to_numpy() == np.r_[0, part.length.cumsum().to_numpy()[:-1]]).all() and total <= 1024 and (total == 1024 or total & (total - 1) == 0)
    assert bm25_packing.pack(nothing).count() == 0


def test_memo_equals_tokenizers():
    from tokenizers import Tokenizer

    vocabulary = bm25_packing.default_vocabulary()
    whole, memo = Tokenizer.from_file(vocabulary[0]), bm25_packing.Memo(vocabulary, 10)
    odd = ["", " ", "a", " a", "a ", "a  b", "a \n b", "it's don't'll 's", "x y z", "tab\t x", "<|endoftext|> x", "½ ²³ Ⅷ 12", "日本 語", "a\x1cb c", "end.\nNext one", "\n\n a"]
    for text in [*odd, *(SENTENCE(20) for _ in range(5))]:
        assert np.frombuffer(memo.ids(text), dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_bm25_prefers_shared_words():
    tails = [np.array([1, 2, 3, 4] * 100), np.array([9, 8, 7] * 100), np.array([1, 2, 3, 5] * 50), np.array([20, 21] * 90)]
    idf = np.ones(bm25_packing.VOCABULARY)
    first = bm25_packing.pack_shard(tails, idf, 200.0, window=512)[0]
    assert [t for t, *_ in first] == [0, 2]


def brute_align(words, item):
    best = np.zeros((len(item) + 1, len(words) + 1), dtype=int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(words) + 1):
            same = decontaminate.MATCH if item[i - 1] == words[j - 1] else decontaminate.MISMATCH
            best[i, j] = max(0, best[i - 1, j - 1] + same, best[i - 1, j] + decontaminate.GAP, best[i, j - 1] + decontaminate.GAP)
    return best.max()


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        words, item = rng.integers(0, 6, rng.integers(1, 40)), rng.integers(0, 6, rng.integers(1, 20))
        assert decontaminate.align(words, item)[0] == brute_align(words, item)


def test_decontamination(spark, nothing):
    items = [(1, SENTENCE(30)), (2, SENTENCE(40)), (3, "tu ra"), (4, None), (5, ""), (None, SENTENCE(25))]
    edited = items[0][1].split()
    edited[7:8] = ["changed"]
    edited[20:21] = ["other", "words"]
    filler = lambda n: " ".join(f"w{RNG.randrange(5000)}" for _ in range(n))
    some = [(1, filler(50) + " " + items[0][1] + " " + filler(9), "a"), (2, filler(9) + " " + " ".join(edited) + " " + filler(300), "a"), (3, items[1][1].upper().replace(" ", ", "), "b")]
    some += [(4, filler(80), "a"), (5, filler(40) + " " + " ".join(items[1][1].split()[:7]) + " " + filler(40), "a"), (6, None, "a"), (7, "", "a"), (8, filler(3) + " tu ra", "a"), (1, some[0][1], "a"), (9, items[5][1], "a")]
    docs = docs_of(spark, some)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.ratio for r in decontaminate.leaks(docs, benchmark).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (8, 3), (9, None)} and got[1, 1] == 1.0 and 0.6 < got[2, 1] < 1
    clean = decontaminate.without_leaks(docs, benchmark)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {4, 5, 6, 7}
    assert decontaminate.leaks(nothing, benchmark).count() == 0
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0 and decontaminate.without_leaks(docs, benchmark.limit(0)).count() == len(some)


def test_decontamination_same_edit_in_many_documents(spark):
    item = [f"i{k}" for k in range(25)]
    edited = [*item[:12], "other", *item[13:]]
    docs = docs_of(spark, [*((i, f"w{i} " + " ".join(edited) + f" v{i}", "a") for i in range(5)), (5, " ".join(item), "a")])
    got = decontaminate.leaks(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {r.doc_id: round(r.ratio, 2) for r in got.collect()} == {**dict.fromkeys(range(5), 0.94), 5: 1.0}


def test_decontamination_equals_alignment_of_all(spark):
    rng = random.Random(8)
    common = [f"c{k}" for k in range(12)]
    items = [[rng.choice(common) if rng.random() < 0.4 else f"i{n}x{k}" for k in range(size)] for n, size in enumerate([1, 2, 3, 4, 5, 6, 7, 10, 15, 25, 40, 56])]
    some = []
    for item in items:
        fifth = ["new" if k % 5 == 4 else w for k, w in enumerate(item)]  # four equal words in a row at most
        apart = [x for k, w in enumerate(item) for x in ([w, "new"] if k % 5 < 4 else [w])]  # hardly two
        halves = [x for k, w in enumerate(item) for x in ([w, "new"] if k % 2 else [w])]
        short = [w for k, w in enumerate(item) if k % 4]
        noisy = [rng.choice(common) if rng.random() < 0.2 else w for w in item]
        for copy in (item, fifth, apart, halves, short, noisy, item[: len(item) // 2]):
            some.append([rng.choice(common) for _ in range(rng.randrange(30))] + copy + [rng.choice(common) for _ in range(rng.randrange(30))])
    some += [[rng.choice(common) for _ in range(200)] for _ in range(5)]
    want = {(d, i): best / (2 * len(item)) for d, words in enumerate(some) for i, item in enumerate(items) if (best := brute_align(words, item)) >= 0.6 * 2 * len(item)}
    docs = docs_of(spark, [(d, " ".join(words), "a") for d, words in enumerate(some)])
    got = decontaminate.leaks(docs, spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.ratio for r in got} == want and len(got) == len(want) > 60


def labelled(spark, bad, kind):
    some, labels = [], []
    for i in range(240):
        y = i % 2
        words = SENTENCE(25).split()
        if y == bad:
            words = [w + "!!" for w in words] if kind == "quality" else [*words[:8], "blorg" + RNG.choice(["a", "ist", "um"]), *words[8:], "zarg"]
        some.append((i, " ".join(words), "a"))
        labels.append((i, y, y, "k"))
    some += [(900, None, "a"), (901, "", "a"), (None, SENTENCE(5), "a"), (902, SENTENCE(4000), "a")]
    labels += [(None, 1, 1, "k"), (900, None, None, "k")]
    return docs_of(spark, some), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, source string")


@pytest.mark.parametrize(("module", "bad", "column", "modulus", "rest"), [(quality_classifier, 0, "quality", 3, 1), (toxicity, 1, "toxic", 5, 0)])
def test_classifiers(spark, nothing, module, bad, column, modulus, rest):
    docs, labels = labelled(spark, bad, column)
    got = module.classify(docs, labels).toPandas()
    truth = labels.toPandas().dropna(subset=["doc_id", column])
    both = got.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(int(i)).encode()) % modulus == rest)).all()
    assert (held.predicted == held[column]).mean() > 0.97 and len(held) > 20
    again = module.classify(docs.repartition(5), labels.repartition(4)).toPandas()
    assert np.allclose(got.sort_values("doc_id").score.to_numpy(), again.sort_values("doc_id").score.to_numpy())
    assert module.classify(nothing, labels).count() == 0
    assert set(module.classify(docs, labels.limit(0)).toPandas().score) == {0.5}


def test_quality_filter(spark):
    docs, labels = labelled(spark, 0, "quality")
    kept = quality_classifier.accepted(docs, labels)
    want = {r.doc_id for r in quality_classifier.classify(docs, labels).collect() if r.predicted}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_counterfactual_training_ignores_groups(spark):
    assert "women" not in toxicity.counterfactual("all women here").split() and len(toxicity.counterfactual("plain text. more").split()) == 4
    bags, twins, y = [], [], []
    for i in range(400):  # the group's name goes with the label, and so do the insults, more weakly
        bad = i % 2
        words = SENTENCE(12) + (" muslims" if bad and i % 3 else "") + (" zarg blorg" if bad and i % 4 else "")
        bags.append(toxicity.features(words))
        twins.append(toxicity.features(toxicity.counterfactual(words)))
        y.append(bad)
    gap = {}
    for balance in (0.0, 20.0):
        weights, bias = toxicity.train(bags, twins, np.array(y), balance)
        table = lambda w, weights=weights: weights[toxicity.word_features(w)].sum()
        gap[balance] = abs(table("muslims") - table("christians"))
    assert gap[20.0] < 0.5 * gap[0.0]


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="<p>no</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>{nav}</a></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div><div id=content><h1>Title {n} &amp; more</h1><p>First&nbsp;para {text}<br>second   line <b>bold</b></p><ul><li>one<li>two</ul>
<form><input><label>Mail</label></form><div class="ad-box"><p>Buy!</p></div><p>Last {text}</div><div class="comments"><p>nice post</p></div><aside>more</aside><footer>&copy; x</footer></body></html>"""


def test_extraction(spark):
    some = [(i, f"http://h.example/{i}", PAGE.format(nav=f"n{i}", n=i, text=SENTENCE(30))) for i in range(6)]
    some += [(10, "http://one.example/", "<p>alone<p>second</p><nav>menu</nav>"), (11, None, None), (12, "nonsense", ""), (13, "http://h.example/13", "plain &lt;text&gt; <b>only</b>"), (14, "http://b.example", "<article><header><h2>H</h2></header>x<p>open <i")]
    some.append(some[0])
    pages = spark.createDataFrame([(*r, "e", 1) for r in some], "page_id long, url string, html string, host string, key int")
    got = {r.page_id: r for r in template_extraction.extract(pages).collect()}
    para = re.search(r"First&nbsp;para (.*?)<br>", some[2][2])[1]
    assert got[2].text == f"Title 2 & more\nFirst para {para} second line bold\none\ntwo\nLast {para}" and got[2].n_chars == len(got[2].text)
    assert got[10].text == "alone\nsecond" and got[11].text == "" and got[12].text == "" and got[13].text == "plain <text> only" and got[14].text == "H\nx\nopen"
    assert template_extraction.extract(pages).count() == len(some) and template_extraction.extract(pages.limit(0)).count() == 0
    bare = pages.selectExpr("'h' as host", "page_id as key", "html").where("page_id < 6").distinct()
    assert template_extraction.article_slots(bare).first().slot == "/html/body/div[content]"


def extracted(spark, pages):
    rows = [(i, f"http://{host}/{i}", page) for i, (host, page) in enumerate(pages)]
    return {r.page_id: r.text for r in template_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_extraction_drops_repeated_runs(spark):
    notice, advert = SENTENCE(15), SENTENCE(4)
    text = [SENTENCE(30) for _ in range(8)]
    page = "<html><head><title>t</title></head><body><div class=x7f><p>{0}</p><p>" + notice + "</p><p>{1}</p><div class=q1><p>" + advert + "</p></div></div><div class=x8><p>" + SENTENCE(60) + "</p></div></body></html>"
    pages = [("n.example", page.format(text[i], text[i + 1])) for i in range(6)]
    got = extracted(spark, [*pages, *[pages[0]] * 20])  # exact copies have one vote
    assert got == {i: "\n".join(text[j : j + 2]) for i, j in enumerate([*range(6), *[0] * 20])}


def test_extraction_drops_repeated_single_words(spark):
    text = [SENTENCE(30) for _ in range(6)]
    page = "<html><head><title>t</title></head><body><div class=x7f><h4>Advertisement</h4><p>{0}</p><p>Share</p><table><tr><td>yes<td>no</table></div></body></html>"
    assert extracted(spark, [("w.example", page.format(t)) for t in text]) == {i: f"{t}\nyes\nno" for i, t in enumerate(text)}


def test_template_classes_equal_occurrence_vectors(spark):
    """Tokens share a class exactly when they occur equally often on every page; repeated rows make no false classes."""
    r = random.Random(11)
    pages = {("h", k): {f"t{i}": r.choice([0, 1, 1, 2]) if i % 3 else 1 for i in range(12)} for k in range(8)}
    pages |= {("g", k): {"x": int(k in (1, 2, 3, 4)), "y": int(k in (1, 2, 3, 5)), "z": 1, "u": 1} for k in range(1, 6)}
    times = {("g", 4): 2, ("g", 5): 2, ("h", 3): 3}
    held = [key for key in pages for _ in range(times.get(key, 1))]
    rows = [(h, k, t, n, int(t[1:] or 0)) for h, k in held for t, n in pages[h, k].items() if n]
    sizes = spark.createDataFrame([(h, sum(x == h for x, _ in held)) for h in "gh"], "host string, host_pages long")
    got: dict = {}
    for row in template_extraction.template_classes(spark.createDataFrame(rows, "host string, key long, token string, n long, at int"), sizes).collect():
        got.setdefault((row.host, row["class"]), set()).add(row.token)
    want: dict = {}
    for host, token in {(h, t) for h, _, t, *_ in rows}:
        vector = tuple(pages[key].get(token, 0) for key in held if key[0] == host)
        if 2 * sum(n > 0 for n in vector) >= len(vector):
            want.setdefault((host, vector), set()).add(token)
    assert sorted(map(sorted, got.values())) == sorted(sorted(c) for c in want.values() if len(c) > 1)


def test_extraction_keeps_whole_articles(spark):
    text = [SENTENCE(30) for _ in range(6)]
    ways = ["<div class='content with-sidebar'>{}</div>", "<div id='page' class='no-sidebar'>{}</div>", "<section class='search-result'>{}</section>", "<div class='post share'>{}</div>"]
    side = "<div class=comments><p>" + SENTENCE(8) + " {}</p></div><div class=sidebar><p>{} more of it</p></div>"
    pages = [(f"h{k}.example", "<html><head><title>t</title></head><body>" + way.format(f"<p>{t}</p>" + side.format(i, i)) + "</body></html>") for k, way in enumerate(ways) for i, t in enumerate(text)]
    pages += [("alone.example", ways[0].format(f"<p>{text[0]}</p>")), ("many.example", "<p>" + text[1] + "</p><div class=comments><p>" + SENTENCE(50) + "</p></div>")]
    pages += [("bare.example", f"<html><head><meta charset=utf-8><title>t</title><body><p>{t}</p></body></html>") for t in text]
    pages += [("short.example", f"<head><title>t</title>{text[0]}")]
    want = [*text * len(ways), text[0], text[1], *text, text[0]]
    assert extracted(spark, pages) == dict(enumerate(want))


def test_warc_round_trip(spark, tmp_path):
    import zstandard

    big = "<p>" + SENTENCE(4000) + "</p>"
    some = [(i, f"http://x/{i}", big if i in (3, 5, 9) else "tiny" if i % 2 else SENTENCE(40) + "é\r\n\r\n") for i in range(1, 60)]
    some += [(70, None, None), (71, "http://y z/\n", ""), (3, "http://x/3", big), (None, "http://n", "null id")]
    pages = spark.createDataFrame([(*r, "e", 1) for r in some], "page_id long, url string, html string, first string, record_id int")
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_bundles.round_trip(pages).collect()]
    want = []
    for i, _, h in some:
        raw = (h or "").encode()
        later = h == big and i != 3
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if later else "response", 3 if later else None))
    assert Counter(got) == Counter(want)
    bundles, index = warc_bundles.write(pages.repartition(2))
    one = index.orderBy("record_id").limit(1)
    assert warc_bundles.read(bundles, one).count() == 1
    assert warc_bundles.export(bundles, str(tmp_path)).count() == len(list(tmp_path.iterdir()))
    for path in tmp_path.iterdir():
        body = path.read_bytes()
        frames = warc_bundles.read_seek_table(body)
        plain = b"".join(zstandard.ZstdDecompressor().decompress(body[a : a + n]) for a, n in frames)
        assert zstandard.ZstdDecompressor().stream_reader(body, read_across_frames=True).read() == plain and plain.startswith(b"WARC/1.1")
    assert warc_bundles.round_trip(pages.limit(0)).count() == 0


def test_edit_counts(spark, docs, rows, nothing):
    count = edit_counts.Counter(edit_counts.default_vocabulary(), 50)
    rng = random.Random(5)
    for _ in range(300):
        text = RNG.choice([SENTENCE(200), "", "a", "\n\n", SENTENCE(90) + "\n  x"])
        leaves = count.leaves(text)
        tokens = [n for _, n in leaves]
        edges = [sum(len(t) for t, _ in leaves[:i]) for i in range(len(leaves) + 1)]
        edits = [(rng.choice([*edges, rng.randint(-2, len(text) + 3)]), rng.choice([0, 1, 600]), rng.choice(["", " ", "\n ", "don't", SENTENCE(120)])) for _ in range(rng.randint(1, 3))]
        new, chars, levels, encoded = edit_counts.recount(count, text, [len(t) for t, _ in leaves], [tokens, *edit_counts.inner_sums(tokens)] if tokens else [], edits)
        assert sum(chars) == len(new) and (levels[-1][0] if levels else 0) == len(count.encode(new))
    got = edit_counts.revised_counts(docs).collect()
    assert len(got) == len(rows) and all(r.n_edits == 3 for r in got if r.doc_id is not None)
    by = {r.doc_id: r for r in got}
    assert by[26].reencoded_chars < by[26].n_chars / 4
    for i, t, s in rows:
        t, s, n = t or "", s or "", len(t or "")
        new, _ = edit_counts.apply_edits(t, [(n // 2, 40, t[2:19]), (0, 0, f"source: {s}\n"), (n, 0, "\n" + s)]) if i is not None else (t, [])
        assert by[i].n_tokens_before == len(count.encode(t)) and by[i].n_tokens == len(count.encode(new)), i
    assert edit_counts.revised_counts(nothing).count() == 0


def test_edits_renew_only_sums_above_changed_leaves(monkeypatch):
    rng = random.Random(6)
    for _ in range(400):
        old, new = ([rng.randrange(9) for _ in range(rng.choice([1, 2, 16, 17, 255, 256, 257, 300, 5000]))] for _ in range(2))
        new = rng.choice([new, old, old[: rng.randint(1, len(old))], old + new])
        changed = {i for i in range(len(new)) if i >= len(old) or old[i] != new[i]}
        got, computed = edit_counts.renewed_sums([old, *edit_counts.inner_sums(old)], new, changed)
        assert got == edit_counts.inner_sums(new)
    leaves = [rng.randrange(9) for _ in range(5000)]
    assert edit_counts.renewed_sums([leaves, *edit_counts.inner_sums(leaves)], [*leaves[:77], 50, *leaves[78:]], {77})[1] == 4
    count = edit_counts.Counter(edit_counts.default_vocabulary())
    text = " ".join(SENTENCE(40) for _ in range(400))
    parts = count.leaves(text)
    tokens = [n for _, n in parts]
    levels = [tokens, *edit_counts.inner_sums(tokens)]
    told = []
    real = edit_counts.renewed_sums
    monkeypatch.setattr(edit_counts, "renewed_sums", lambda *a: told.append(real(*a)) or told[-1])
    for _ in range(30):
        edits = [(rng.randrange(len(text)), rng.choice([0, 3, 900]), rng.choice(["", "x", SENTENCE(200)]))]
        new, chars, got, _ = edit_counts.recount(count, text, [len(t) for t, _ in parts], levels, edits)
        assert got[1:] == edit_counts.inner_sums(got[0]) and got[-1][0] == len(count.encode(new))
    same = edit_counts.recount(count, text, [len(t) for t, _ in parts], levels, [(len(text) // 2, 1, text[len(text) // 2])])
    assert same[2] == levels and told[-1][1] < len(levels[1]) / 2
