import random

import numpy as np

from tessera.llm import common, components, shingles, simhash


def components_of(rows, linked):
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if linked(rows[i][1], rows[j][1]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return root


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("abcdefgh") * rng.randint(5, 9)
    return " ".join(words)


def corpus(rng):
    base = [[rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.choice([20, 60, 200]))] for _ in range(8)]
    rows = [(i, edited(rng, rng.choice(base), rng.choice([0, 1, 1, 2, 3, 4]))) for i in range(200)]
    return rows + [(300, None), (301, " "), (302, "One"), (303, "one"), (304, "one two"), (305, " ".join(base[0][:15])), (306, " ".join(base[0][:14]))]


def test_shingle_components_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    rows = corpus(rng)
    root = components_of(rows, lambda a, b: jaccard(a, b) >= 0.8)
    want = sorted((i, min(j for r, (j, _) in zip(root, rows, strict=True) if r == k)) for k, (i, _) in zip(root, rows, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for often in (3, 10**9):  # the order of shingles does not matter
        monkeypatch.setattr(shingles, "OFTEN", often)
        assert sorted(map(tuple, shingles.near_duplicates(df).collect())) == want
    assert sorted(r.doc_id for r in shingles.deduplicate(df).collect()) == sorted({k for _, k in want})
    assert shingles.near_duplicates(df.limit(0)).count() == shingles.deduplicate(df.limit(0)).count() == 0


def test_the_pipeline_drops_near_copies_of_similarity_four_fifths(spark):
    import corpus_pipeline as pipe

    rng = random.Random(2)
    words = [rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(150)]
    rows, k = [(0, " ".join(words), "x")], 1
    while len(rows) < 30:
        t = edited(rng, words, 2)
        if jaccard(rows[0][1], t) >= 0.8:
            rows.append((k, t, "x"))
            k += 1
    assert any((simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(t)).bit_count() > 4 for _, t, _ in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, note string")
    got = pipe.near_dedup(spark, df, "").collect()
    assert [tuple(r) for r in got] == [rows[0]]


def test_components_without_ids_and_repeated_ids_keep_a_row_each(spark):
    rng = random.Random(3)
    a, b, c, d = (" ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(80)) for _ in range(4))
    rows = [(None, a), (None, a + " "), (None, b), (5, c), (5, d), (None, c), (5, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for kept in (simhash.deduplicate(df), shingles.deduplicate(df)):
        assert sorted((str(r.doc_id), r.text.strip()) for r in kept.collect()) == sorted([("None", a), ("None", b), ("5", c), ("5", d)])


def joined(n, pairs, start=None):
    root = list(range(n)) if start is None else list(start)
    for a, b in pairs:
        root = [root[b] if r == root[a] else r for r in root]
    return [root.index(r) for r in root]


def test_searches_connect_what_all_pairs_connect():
    rng = np.random.default_rng(4)
    for most in (12, 90, 700, 3000):
        base = rng.integers(0, 2**63, (3, most)).astype(np.uint64)
        sets = [np.zeros(0, np.uint64)]
        for _ in range(120):  # about a tenth of the shingles replaced, some left out
            x = base[rng.integers(3)][: rng.integers(most * 3 // 4, most + 1)].copy()
            at = rng.random(len(x)) < rng.uniform(0, 0.2)
            x[at] = rng.integers(0, 2**63, at.sum())
            sets.append(np.unique(x))
        sets.sort(key=len)
        n, cls = np.array([len(x) for x in sets]), np.arange(len(sets))
        pairs = [(a, b) for a in range(len(sets)) for b in range(a)]
        sized = [(a, b) for a, b in pairs if 5 * n[b] >= 4 * n[a]]
        want = [(a, b) for a, b in sized if n[b] and shingles.similar(sets[a], sets[b])]
        bins = [shingles.binned(x) for x in sets]
        for start in (cls, np.where(rng.random(len(cls)) < 0.3, np.minimum(cls, 5), cls)):  # some are in one component already
            a, b = shingles.set_links(cls, start, sets)
            assert len(a) < len(sets) and {*zip(a.tolist(), b.tolist(), strict=True)} <= {*want, *((y, x) for x, y in want)}
            assert joined(len(sets), zip(a.tolist(), b.tolist(), strict=True), start) == joined(len(sets), want, start)
            a, b = shingles.near_roots(n, start, bins)
            near = [(x, y) for x, y in sized if 9 * shingles.apart([bins[x]], [bins[y]])[0] <= n[x] + n[y]]
            assert len(a) < len({*start.tolist()})
            assert joined(len(sets), zip(a, b, strict=True), start) == joined(len(sets), near, start)
        full = [b"\xff" * len(x) for x in bins]  # bins that may hold more rule nothing out
        assert joined(len(sets), zip(*shingles.near_roots(n, cls, full), strict=True)) == joined(len(sets), sized)


def test_a_large_group_of_near_copies_makes_no_table_of_its_pairs(spark, monkeypatch):
    rng = random.Random(6)
    words = [rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(150)]
    rows = [(i, edited(rng, words, rng.choice([2, 3, 3, 4, 5]))) for i in range(400)]
    sizes, staged = {}, common.staged

    def counted(df, label):
        out = staged(df, label)
        sizes[label] = max(sizes.get(label, 0), out[0].count())
        return out

    for module in (common, components, shingles):
        monkeypatch.setattr(module, "staged", counted)
    monkeypatch.setattr(shingles, "LIMIT", 20_000, raising=False)  # three parts
    got = sorted(map(tuple, shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    sets = [shingles.shingles(t) for _, t in rows]
    pairs = [(a, b) for a in range(400) for b in range(a) if shingles.similar(sets[a], sets[b])]
    assert got == [*enumerate(joined(400, pairs))]
    assert len(pairs) > 1500 and max(v for k, v in sizes.items() if k != "shingles-shared") <= 10 * len(rows), sizes
