import os
import random
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash

from tessera.llm import bpe, html_text, lang_id, packing, simhash
from tessera.llm.common import shared_dir, tokenizer_path


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lang_id._new(3, 4, rng).items()}
    x = rng.integers(97, 123, (6, 5)).astype(np.uint8)
    y = np.array([0, 1, 2, 1, 0])
    p32 = {k: v.astype(np.float32) for k, v in p.items()}
    _, g = lang_id.loss_and_gradients(p32, x, y)
    for k in p:
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in p[k].shape)
            if k[0] == "W":
                at = (int(x[0, 0]), at[1])
            q = {n: v.copy() for n, v in p32.items()}
            q[k][at] += 0.01
            up = lang_id.loss_and_gradients(q, x, y)[0]
            q[k][at] -= 0.02
            assert g[k][at] == pytest.approx((up - lang_id.loss_and_gradients(q, x, y)[0]) / 0.02, abs=2e-3)


WORDS = {"en": "the and of with that from this which".split(), "de": "und der die das nicht über für einen".split()}


def test_language_learns_and_marks_unknown(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(30)), lang, "s") for i in range(160) for lang in [("en", "de")[i % 2]]]
    rows += [(900, None, "en", "s"), (901, "123 !!", None, "s"), (902, "", "de", "s"), (None, "the and of", None, "s"), (1, rows[1][1], "de", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = lang_id.fit(df)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in lang_id.annotate(df, model).collect()}
    held = [(i, t, lang) for i, t, lang, _ in rows[:160] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i, t][0] == lang for i, t, lang in held]) > 0.95
    assert got[900, None] == got[901, "123 !!"] == got[902, ""] == ("und", 0.0) and got[None, "the and of"][0] == "en"
    assert lang_id.fit(df.limit(0)) is None and lang_id.annotate(df.limit(0), None).count() == 0
    assert {r.lang_pred for r in lang_id.annotate(df, None).collect()} == {"und"}


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h))


def plain_components(rows):
    f = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(f)))
    for i in range(len(f)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    best = {}
    for r, (i, _) in zip(root, rows, strict=True):
        best[r] = min([x for x in (best.get(r), i) if x is not None], default=None)
    return sorted(((str(i), x, str(best[r])) for (i, _), x, r in zip(rows, f, root, strict=True)))


@pytest.mark.parametrize("limit", [simhash.LIMIT, 8])
def test_simhash_against_brute_force(spark, limit):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(120)] for _ in range(6)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = "zz"
        rows.append((i, " ".join(w)))
    rows += [(None, rows[0][1]), (500, None), (501, ""), (502, " \t"), (503, "One"), (504, "one"), (503, "One")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df, limit=limit).collect()
    assert sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in got) == plain_components(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("m", [5, 6, 7, 8])
def test_pigeonhole_keys_find_every_close_pair(spark, m):
    rng = np.random.default_rng(m)
    f = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = []
    for x in f.tolist():
        for b in rng.choice(64, 4, replace=False):
            x ^= 1 << int(b)
        near.append(x)
    masks = [k % 2**64 for k in simhash.masks(m)]
    assert all(any(int(a) & k == b & k for k in masks) for a, b in zip(f, near, strict=True))
    for a, b in zip(f.tolist(), near, strict=True):  # and under one finer mask of each of those
        for k in masks:
            if a & k == b & k:
                assert any(a & x == b & x for x in (y % 2**64 for y in simhash.finer(k, m)))


def test_html_cases():
    page = """<html><head><title>T</title><script>var t="</p>";</script></head><body><div class="top menu"><a>m</a></div><article><header><h1>Head &amp; line</h1></header>
    <p>First  paragraph<br>goes on &lt;here&gt; for a while.<p>Second<b> one</b>.<ul><li>a<li>b</ul><section class="comments"><p>I disagree</p></section><form>send</form></article>
    <aside>side</aside><div id="cookie-notice">We use cookies</div><footer>foot</footer>"""
    assert html_text.main_text(page) == "Head & line\nFirst paragraph goes on <here> for a while.\nSecond one.\na\nb"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("just text &copy; <b>bold") == "just text © bold"
    assert html_text.main_text("<p>" + "word " * 50_000) == ("word " * 50_000).strip()


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "old"), (None, None, None, "old")], "page_id long, url string, html string, text string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extracted(df).collect()) == [("1", "x", 1), ("None", "", 0)]
    assert html_text.extracted(df.limit(0)).count() == 0


TRICKY = [" ", "\n", "\t", "\x1c", "\x85", "\xa0", "a", "The", "É", "ß", "日本", "😀", "1", "<|endoftext|>", "!", "'s", "don't", "́", "Σ", "‍", "　", ""]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    lib, mine, rng = Tokenizer.from_file(path), bpe.Tokenizer(path), random.Random(4)
    texts = ["".join(rng.choice(TRICKY) for _ in range(rng.randint(0, 15))) for _ in range(500)] + ["ab" * 2000, "é" * 300, "x y " * 3000]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids and mine.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in bpe.round_trips(df, path).collect()) == [0, 0, 2, 2]
    assert bpe.decode(bpe.encode(df, path), path).where("coalesce(text, '') <> decoded").count() == 0
    assert bpe.round_trips(df.limit(0), path).count() == 0


def test_word_tokenizer_equals_the_library():
    tok, rng = packing.WordTokenizer(tokenizer_path("word_bpe_49k.json")), random.Random(6)
    texts = ["".join(rng.choice([*TRICKY, "<|startoftext|>", "Word,", "ÀÇÉ."]) for _ in range(rng.randint(0, 15))) for _ in range(1500)]
    for t, ids in zip(texts, tok.encode_batch(texts), strict=True):
        assert ids.tolist() == tok.lib.encode(t, add_special_tokens=False).ids


def test_word_tokenizer_forgets_and_cuts_long_texts(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 200)
    monkeypatch.setattr(packing, "CHARS", 500)
    tok, rng = packing.WordTokenizer(tokenizer_path("word_bpe_49k.json")), random.Random(7)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abcdeé.,7'") for _ in range(rng.randint(1, 9))) for _ in range(rng.choice([0, 5, 40, 300]))) for _ in range(6)] + ["x" * 1200, "a\n" * 700]
        for t, ids in zip(texts, tok.encode_batch(texts), strict=True):
            assert ids.tolist() == tok.lib.encode(t, add_special_tokens=False).ids


def test_word_tokenizer_dictionary_is_small():
    tok, rng = packing.WordTokenizer(tokenizer_path("word_bpe_49k.json")), random.Random(9)
    words = list({"".join(rng.choice("abcdeghilmnorstu") for _ in range(8)) for _ in range(40_000)})
    tok.encode_batch(["a"])
    tracemalloc.start()
    for a in range(0, len(words), 2_000):
        tok.encode_batch([" ".join(words[a : a + 2_000])])
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 64 * len(words)


def test_packing_leaves_no_tokens_behind_and_restores_the_batch_size(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(20)], "doc_id long, text string")
    assert packing.packed(docs, tokenizer_path("word_bpe_49k.json")).count() >= 20
    assert not [x for x in os.listdir(shared_dir(spark).removeprefix("file://")) if x.startswith("packing-tokens")]
    assert spark.conf.get(name) == before


def test_packing_statistics_count_every_document(spark):
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 300, rng.integers(0, 80)).astype("<u2") for _ in range(1500)]
    rows = spark.createDataFrame([(d.tobytes(), len(d)) for d in docs], "ids binary, n long").repartition(7)
    df, n, total = packing.statistics(rows, 300, 2)
    assert df.tolist() == np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=300).tolist()
    assert (n, total) == (1500, sum(map(len, docs)))


def test_packing_holds_every_id_once(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(rng.choice([0, 3, 200, 5000]))) for _ in range(60)] + [None, ""]
    rows = [(i if i else None, t, 0) for i, t in enumerate(texts)]
    path = tokenizer_path("word_bpe_49k.json")
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, start int"), path, shard_tokens=40_000).collect()
    tok = packing.WordTokenizer(path)
    full = {i: np.append(tok.encode_batch([t or ""])[0].astype("<u4"), np.uint32(1)) for i, t, _ in rows}
    for i, ids in full.items():
        at = 0
        for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_scores_are_full_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.choice(400, rng.integers(1, 120), p=np.arange(400, 0, -1) / 80_200).astype(np.uint16) for _ in range(150)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=400)
    idf = np.log1p((150 - df + 0.5) / (df + 0.5))
    mean = np.mean([len(d) for d in docs])
    index = packing.Index(docs, idf, mean)
    assert 0 < index.matrix.shape[0] < 400 and len(index.doc)  # both ways of keeping postings are used
    for seed in (0, 7, 149):
        want = np.zeros(150)
        for k, d in enumerate(docs):
            for t in set(docs[seed].tolist()):
                tf = (d == t).sum()
                want[k] += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        assert np.allclose(index.scores(seed), want, rtol=1e-4)


def test_packing_prefers_lexical_neighbours():
    a, b = np.arange(10, 110, dtype=np.uint16), np.arange(500, 600, dtype=np.uint16)
    docs = [np.tile(x, 5) for x in (a, b, a, b, a, b, a, b)]
    idf = np.ones(1000)
    for seq in packing.pack(docs, idf, 500.0, window=2000):
        assert len({d % 2 for d, _, _ in seq}) == 1
