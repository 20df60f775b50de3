import hashlib
import math
import random
import re
from zlib import crc32

import pytest

from tessera.llm import queries, resampling

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, order=2):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, order=2, buckets=10_000, least=20, percent=25, seed=7):
    count = lambda texts: [sum(col) for col in zip(*map(one, texts))] or [0] * buckets

    def one(t):
        c = [0] * buckets
        for f in features(t, order)[1]:
            c[crc32(f.encode()) % buckets] += 1
        return c

    s, t = count([x for _, x in rows]), count(target)
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + buckets) / ((a + 1) * (T + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, x in rows:
        n, fs = features(x, order)
        w = sum(gain[crc32(f.encode()) % buckets] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order_of = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(order_of[: len(order_of) * percent // 100], 1):
        r[5] = rank
    return out


ODD = [None, "", "  ", "One", "A b-C_d é日本 Ünïcode X9 9x", "a\x00b\x7fc ½ ² ́x", "word " * 500, "日本語" * 4000, "ab" * 5000 + " tail"]


def test_query_equals_brute_force(spark):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").select(*c).collect()]
    want = brute(read("documents", "doc_id", "text"), [r[0] for r in read("benchmark", "text")])
    got = queries.op12_importance_resampling(spark, SMALL)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted((w[0], *w[2:]) for w in want)
    assert sum(w[5] is not None for w in want) > 20


@pytest.mark.parametrize("order,buckets,least,percent", [(1, 50, 1, 50), (2, 10_000, 3, 25), (3, 997, 0, 100)])
def test_orders_odd_texts_nulls_and_repeats(spark, order, buckets, least, percent):
    rng = random.Random(order)
    rows = [(i if i % 7 else None, t) for i, t in enumerate(ODD + [" ".join(rng.choices(["the", "Of", "x1", "é", "zz"], k=rng.randrange(60))) for _ in range(80)])]
    target = [None, "the of the of x1", "zz"]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _score int, weight int")
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "body string"), target_text_col="body", order=order,
                              buckets=buckets, least_words=least, percent=percent)
    want = brute(rows, target, order, buckets, least, percent)
    plain = lambda r: sorted((tuple(x[:5]) for x in r), key=str)
    got = [tuple(r) for r in got.collect()]
    assert plain(got) == plain(want)
    ranks = sorted(r[5] for r in got if r[5] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == sum(w[5] is not None for w in want)
    by_rank = sorted((r for r in got if r[5]), key=lambda r: r[5])
    assert [(r[4], r[0]) for r in by_rank] == [(w[4], w[0]) for w in sorted((w for w in want if w[5]), key=lambda w: w[5])]


def test_pieces_of_any_size_give_the_same_features():
    for text in filter(None, ODD):
        data = text.encode()
        for order in (1, 2, 3, 4):
            want = sorted(crc32(f.encode()) for f in features(text, order)[1])
            for size in (1, 5, 64, 1 << 20):
                got = list(resampling.runs(data, order, size))
                assert sorted(c for _, found in got for c in found) == want and sum(n for n, _ in got) == features(text)[0]


def test_ranks_with_one_hot_score_and_repeated_rows(spark):
    rows = [(1, 5)] * 3000 + [(i, i % 3) for i in range(2, 900)]
    df = spark.createDataFrame(rows, "_id long, _score long").repartition(6)
    got = sorted((r._rank, r._score, r._id) for r in resampling.ranked(df).collect())
    assert [(s, i) for _, s, i in got] == [(s, i) for i, s in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert [g[0] for g in got] == list(range(1, len(rows) + 1))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(empty, empty).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    (r,) = resampling.resample(one, empty, least_words=1, percent=100).collect()
    assert (r.n_features, r["rank"]) == (5, 1) and r.weight == brute([(1, "a b c")], [])[0][3]
