import random
from collections import Counter

import numpy as np

from tessera.llm import near_dedup as nd
from tessera.llm import queries
from test_exact_and_bpe import ODD, docs


def bag(t):
    w = (t or "").lower().encode().split()
    return Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def jaccard(a, b):
    low, high = sum((a & b).values()), sum((a | b).values())
    return low / high if high else 1.0


def words(rng, n):
    return [f"w{rng.randint(0, 3000)}" for _ in range(n)]


def edited(rng, w, k):
    w = list(w)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
    return w


def test_signature_is_unbiased_for_weighted_jaccard():
    rng = np.random.default_rng(1)
    for high in (2, 30):
        hits, want = 0, 0.0
        for _ in range(60):
            items = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
            a, b = rng.integers(0, high, len(items)), rng.integers(0, high, len(items))
            pa_, pb = a > 0, b > 0
            x = nd.bag_minhash(items[pa_], a[pa_], 512)
            y = nd.bag_minhash(items[pb], b[pb], 512)
            hits += (x == y).sum()
            want += np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs(hits / 512 / 60 - want / 60) < 0.012


def test_signatures_do_not_depend_on_their_company():
    rng = np.random.default_rng(2)
    bags = [np.unique(rng.integers(0, 900, n).astype(np.uint64), return_counts=True) for n in (0, 1, 2, 40, 500, 5000, 0, 3)]
    many = nd.bag_minhashes(bags)
    assert all((many[i] == nd.bag_minhash(*b)).all() for i, b in enumerate(bags)) and not many[0].any()
    assert [len(g) for g in nd.together(["a" * 5, "b" * 9, "c"], 10)] == [2, 1]


def test_hashes_do_not_depend_on_place_or_segments():
    a = nd.word_hashes("the cat  sat\non É the mat " + "z" * 5000)
    b = nd.word_hashes("on é The")
    assert a[0] == a[5] == b[2] and a[3] == b[0] and a[4] == b[1] and len(a) == 8
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    h = nd.word_hashes(long)
    assert len(h) == 200_000 and (h[:977] == h[977 * 100 : 977 * 101]).all()
    assert len(nd.word_hashes("y" * 700_000 + " a")) == 2


def test_overlap_is_exact():
    rng = random.Random(4)
    for _ in range(50):
        a = words(rng, rng.randint(1, 80)) * rng.choice([1, 2])
        b = edited(rng, a, 2)
        x, y = (nd.shingles(nd.word_hashes(" ".join(t))) for t in (a, b))
        assert abs(nd.overlap(x, y) - jaccard(bag(" ".join(a)), bag(" ".join(b)))) < 1e-12


def classes_by_brute_force(texts):
    bags = [bag(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (bool(bags[i]) == bool(bags[j])) and jaccard(bags[i], bags[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)
    rng = random.Random(9)
    texts = list(ODD)
    for n in (5, 30, 80, 200, 400):
        for _ in range(6):
            base = words(rng, n)
            texts.append(" ".join(base))
            texts += [" ".join(edited(rng, base, max(1, n // 60))) for _ in range(rng.choice([0, 1, 3]))]
    star = words(rng, 200)
    texts += [" ".join(edited(rng, star, 4)) for _ in range(45)] + [" ".join(star)] * 5 + [" ".join(star).upper()]
    chain = words(rng, 300)
    for _ in range(8):
        texts.append(" ".join(chain))
        chain = edited(rng, chain, 4)
    got = {r.doc_id: r for r in nd.near_duplicates(docs(spark, texts)).collect()}
    want = classes_by_brute_force(texts)
    assert len(got) == len(texts)
    assert {i: r.class_id for i, r in got.items()} == dict(enumerate(want))
    kept = nd.keep_representatives(docs(spark, texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))


def family(rng, size):
    """Texts around a similarity of 0.75 to each other; few pairs of them reach 0.8."""
    base = words(rng, 350)
    return [" ".join(edited(rng, base, 5)) for _ in range(size)]


def test_links_among_many_near_misses_are_found(spark):
    texts = family(random.Random(21), 120)
    want = classes_by_brute_force(texts)
    assert 10 < len(set(want)) < 110
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(docs(spark, texts)).collect()} == dict(enumerate(want))


def test_links_across_blocks_are_found(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    texts = family(random.Random(22), 120)
    want = classes_by_brute_force(texts)
    assert 10 < len(set(want)) < 110
    assert {r.doc_id: r.class_id for r in nd.near_duplicates(docs(spark, texts)).collect()} == dict(enumerate(want))


def test_edges_of_the_contract(spark):
    d = docs(spark, ["a b c d e f", "A b c  d e f", None, "", "x"], [3, 3, None, 8, 9])
    rows = sorted((r.doc_id or -1, r.class_id or -1, r.n_equal) for r in nd.near_duplicates(d).collect())
    assert rows == [(-1, -1, 2), (3, 3, 2), (3, 3, 2), (8, 8, 2), (9, 9, 1)]
    kept = nd.keep_representatives(d)
    assert kept.columns == d.columns and kept.count() == 4
    assert nd.near_duplicates(d.limit(0)).count() == 0


def test_unlike_texts_of_one_id_all_stay(spark):
    from tessera.llm import near_dedup

    text = lambda seed: " ".join(f"w{seed}x{i}" for i in range(30))
    rows = [(1, text(1), 0, 0), (1, text(2), 0, 0), (2, text(3), 0, 0), (2, "  " + text(3).upper() + "\n", 0, 0), (3, text(3), 0, 0), (None, text(1), 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _mark int, _words int")
    kept = near_dedup.keep_representatives(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text.split()[0].lower()) for r in kept.collect()) == [(0, "w1x0"), (1, "w1x0"), (1, "w2x0"), (2, "w3x0")]
    assert near_dedup.keep_representatives(df.limit(0)).count() == 0
