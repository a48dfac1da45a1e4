import hashlib
import random

import numpy as np

from tessera.llm import audio, repeats
from tessera.llm.suffix_array import suffix_array


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(0)
    for _ in range(400):
        s = rng.integers(1, rng.integers(2, 5), rng.integers(0, 60))
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def brute(rows, least=50):
    first, none = {}, 1 << 62
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - least + 1):
            w = b[a : a + least]
            first[w] = min(first.get(w, none + 1), none if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cov = bytearray(len(b))
        for a in range(len(b) - least + 1):
            if first[b[a : a + least]] < (none if i is None else i):
                cov[a : a + least] = b"\1" * least
        n = sum(1 for a in range(len(b)) if cov[a] and (a == 0 or not cov[a - 1]))
        out.append((str(i), len(b), sum(cov), n, hashlib.sha256(bytes(c for c, v in zip(b, cov, strict=True) if not v)).hexdigest()))
    return sorted(out)


def test_repeats_against_brute_force(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(30, 120))) for _ in range(8)] + ["a" * 300, "é" * 80, "", " "]
    rows = []
    for i in range(250):
        t = "".join(rng.choice(pool) if rng.random() < 0.7 else "".join(rng.choice("abc ") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 6)))
        rows.append((rng.choice([i, i, i, None, i // 2]), t if rng.random() > 0.03 else None))
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, mark int").repartition(5)
    assert sorted((str(r.doc_id), *r[1:]) for r in repeats.removed(df).collect()) == brute(rows)
    unique = [(i, t) for i, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(unique, "doc_id long, text string").repartition(3)
    assert sorted((str(r.doc_id), *r[1:]) for r in repeats.removed(df).collect()) == brute(unique)
    assert repeats.removed(df.limit(0)).count() == 0


def test_repeats_removes_from_texts(spark):
    p = "0123456789" * 6
    rows = [(1, "x " + p), (2, p + " tail"), (3, None)]
    got = {r.doc_id: r.text for r in repeats.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "x " + p, 2: " tail", 3: None}


def plain_fingerprint(x):
    """The fingerprint with plain sums over the image in place of the integral image."""
    image, sounds = audio.chroma(x)
    out = []
    for t in range(len(image) - audio.SPAN + 1):
        if not sounds[t : t + audio.SPAN].all():
            out.append(-1)
            continue
        word = 0
        area = lambda t0, n, y, h: image[t + t0 : t + t0 + n, y : y + h].sum()  # noqa: B023, E731
        for kind, y, h, w in audio.FILTERS:
            half, up = w // 2, h // 2
            if kind == 0:
                a, b = area(0, w, y, h) * 12 / h, (image[t : t + w].sum() - area(0, w, y, h)) * 12 / (12 - h)
            elif kind == 1:
                a, b = area(0, half, y, h), area(half, half, y, h)
            elif kind == 2:
                a, b = area(0, w, y, up), area(0, w, y + up, h - up)
            else:
                a = area(0, half, y, up) + area(half, half, y + up, h - up)
                b = area(0, half, y + up, h - up) + area(half, half, y, up)
            v = np.log((1 + a) / (1 + b))
            word = word << 2 | [0, 1, 3, 2][int(v > -audio.STEP) + int(v > 0) + int(v > audio.STEP)]
        out.append(word)
    return np.array(out, np.int64)


def plain_align(query, other):
    """Votes of all offsets counted one by one; then the bits at the best one."""
    votes = {}
    for i, q in enumerate(query.tolist()):
        for j, r in enumerate(other.tolist()):
            if q >= 0 and q == r:
                votes[j - i] = votes.get(j - i, 0) + 1
    if not votes:
        return None
    offset = min(votes, key=lambda o: (-votes[o], o))
    if votes[offset] < audio.votes_needed(int((query >= 0).sum())):
        return None
    both = [(q, other[i + offset]) for i, q in enumerate(query.tolist()) if 0 <= i + offset < len(other) and q >= 0 and other[i + offset] >= 0]
    bits = sum((int(q) ^ int(r)).bit_count() for q, r in both)
    return (offset, votes[offset], len(both), bits) if bits <= audio.ERROR * 32 * len(both) else None


def test_alignment_finds_the_offset():
    rng = np.random.default_rng(1)
    tune = audio.melody(list(rng.normal(size=64)), 0)
    a = audio.fingerprint(tune)
    assert (a == plain_fingerprint(tune)).mean() > 0.99
    b = audio.fingerprint(np.concatenate([np.zeros(audio.HOP * 5), tune + rng.normal(0, 0.002, len(tune))]))
    [(_, offset, votes, overlap, bits)] = audio.Block([a]).matches(b)
    assert offset == 5 and votes > 0.5 * len(a) and bits < 0.1 * 32 * overlap
    assert audio.Block([a]).matches(audio.fingerprint(audio.melody(list(rng.normal(size=64)), 0))) == []


def test_votes_in_pieces():
    rng = np.random.default_rng(4)
    prints = [rng.integers(-1, 6, rng.integers(0, 30)) for _ in range(12)]
    block = audio.Block(prints)
    for _ in range(30):
        other = rng.integers(-1, 6, rng.integers(0, 40))
        whole, cut = block.votes(other), block.votes(other, most=7)
        assert all((x == y).all() for x, y in zip(whole, cut, strict=True))


def test_wav_forms():
    x = np.sin(np.arange(8000) / 5)
    assert np.allclose(audio.read_wav(audio.write_wav(x)), x, atol=1e-3)
    assert len(audio.read_wav(audio.write_wav(x, rate=8000))) == 4000
    assert len(audio.read_wav(b"not audio")) == len(audio.read_wav(None)) == 0


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 24))
    rows = [(i, [float(v) for v in base[i % 6] + rng.normal(0, 0.02, 24)]) for i in range(60)] + [(20, [0.0] * 3)]
    rows += [(100, None), (None, [1.0, 2.0]), (101, [None, float("nan")])]
    rows += [(67, rows[60 % 7][1]), (60 + 7 * 20, rows[60 % 7][1])]  # equal recordings: the pause depends on the id modulo 7
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, votes int").repartition(3)
    prints = [(i, plain_fingerprint(audio.read_wav(audio.sonify(v, i or 0)))) for i, v in rows]
    near = [(i, audio.fingerprint(audio.read_wav(audio.sonify(v, i or 0)))) for i, v in rows]
    assert all(len(p) == len(q) and (len(p) == 0 or (p == q).mean() > 0.95) for (_, p), (_, q) in zip(prints, near, strict=True))
    prints = near  # sums in another order may fall on the other side of a step
    least = {}
    for i, p in prints:
        if p.tobytes() not in least or least[p.tobytes()] is None or i is not None and i < least[p.tobytes()]:
            least[p.tobytes()] = i
    members = {k: sum(p.tobytes() == k for _, p in prints) for k in least}
    asking = {p.tobytes() for i, p in prints if i is not None and i % 20 == 0}
    found = {(a, b): x for a in asking for b in least if (x := plain_align(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)))}
    got = audio.search(df, "vec_id", "embedding", vectors=True, block=300, share=1).collect()
    want = [(least[a], least[b], members[b], *x) for (a, b), x in found.items()]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20
    # Components over queries and recordings.
    comp = {k: k for k in least}
    for _ in least:
        for a, b in found:
            comp[a] = comp[b] = min(comp[a], comp[b])
    low = {}
    for k, r in comp.items():
        low[r] = min([x for x in (low.get(r), least[k]) if x is not None], default=None)
    rows_of = {}
    for i, p in prints:
        k = p.tobytes()
        query = i is not None and i % 20 == 0
        if query:
            n = max(1, sum(members[b] for a, b in found if a == k)) - 1
        else:
            n = sum(sum(q.tobytes() == a and j is not None and j % 20 == 0 for j, q in prints) for a, b in found if b == k)
        rows_of.setdefault(str(i), []).append((str(i), str(least[k]), str(low[comp[k]]), query, n))
    for n, parts in ((300, 1), (10_000, 4)):
        got = audio.links(df, "vec_id", "embedding", vectors=True, block=n, share=parts).collect()
        assert sorted((str(r.id), str(r.class_id), str(r.component_id), r.is_query, r.n_links) for r in got) == sorted(x for v in rows_of.values() for x in v)
        for r in got:
            if r.match_id is not None:
                assert r.is_query and r.match_id != r.class_id
    assert audio.search(df.limit(0), "vec_id", "embedding", vectors=True).count() == audio.links(df.limit(0), "vec_id", "embedding", vectors=True).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as pipe

    rng = random.Random(5)
    words = {"en": "the and of with that from this which".split(), "de": "und der die das nicht über für einen".split()}
    docs = [(i, " ".join(rng.choice(words[g]) + str(rng.randint(0, 40)) * (rng.random() < 0.5) for _ in range(60)), g, "s", 0) for i in range(80) for g in [("en", "de")[i % 2]]]
    docs += [(200, None, None, "s", 0), (201, "12 34", "en", "s", 5), (202, "  " + docs[4][1].replace(" ", "  "), "en", "s", 1), (203, docs[5][1] + " the", "de", "s", 1), (204, docs[7][1] + " token=abcdef123 und", "de", "s", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    a = pipe.language_id(spark, df, "").cache()
    assert a.columns == df.columns and {r.doc_id for r in a.collect()} == {d[0] for d in docs} - {200, 201}
    b = pipe.exact_dedup(spark, a, "").cache()
    assert {r.doc_id for r in b.collect()} == {d[0] for d in docs} - {200, 201, 4}
    c = pipe.near_dedup(spark, b, "").cache()
    # What is left by brute force: the smallest id of each component of five-word similarity 0.8.
    left = sorted((r.doc_id, r.text) for r in b.collect())
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in left)]
    root = list(range(len(left)))
    for i in range(len(left)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert c.columns == df.columns and {r.doc_id for r in c.collect()} == {left[r][0] for r in root} and 203 not in {left[r][0] for r in root}
    d = pipe.secret_scan(spark, c, "").cache()
    texts = {r.doc_id: r for r in d.collect()}
    assert set(texts) == {r.doc_id for r in c.collect()}
    if 204 in texts:
        assert "[SECRET]" in texts[204].text and texts[204].n_chars == len(texts[204].text)
    pieces = pipe.packing(spark, d, "")
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(texts)


def test_pipeline_of_empty_tables_and_clashing_names(spark):
    import corpus_pipeline as pipe

    schema = "doc_id long, text string, lang string, source string, n_chars long, _key string, id string, fp long, score double, start int, spans string"
    names = [f.split()[0] for f in schema.split(", ")]
    empty = spark.createDataFrame([], schema)
    words = "the and of with that from this which".split()
    rows = [(i, " ".join(words[(i * k) % 8] for k in range(20)) + f" {i}", "en", "s", 5, "k", "i", 1, 0.5, 3, "x") for i in range(40)]
    full = spark.createDataFrame(rows, schema)
    for docs in (empty, full):
        for _, apply in pipe.STAGES[:-1]:
            out = apply(spark, docs, "")
            assert out.columns == names
            docs = out.cache()
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert {r.doc_id for r in pipe.STAGES[-1][1](spark, docs, "").select("doc_id").distinct().collect()} == ids


def test_very_long_texts(spark):
    from tessera.llm import bpe, lang_id, simhash
    from tessera.llm.common import tokenizer_path

    rng = random.Random(11)
    long = " ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 99_999)}" for _ in range(150_000))
    rows = [(1, long, "en"), (2, "x " + long, "en"), (3, "short text", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert got[1].component_id == got[2].component_id == 1 and got[3].component_id == 3
    got = {r.doc_id: r for r in repeats.removed(df).collect()}
    assert got[2].n_removed == len(long) and got[2].n_spans == 1 and got[1].n_removed == got[3].n_removed == 0
    got = {r.doc_id: r for r in bpe.round_trips(df, tokenizer_path("byte_bpe_50k.json")).collect()}
    assert all(got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t, _ in rows)
    assert {r.lang_pred for r in lang_id.annotate(df, lang_id.fit(df)).collect()} == {"en"}
