import hashlib
import random

import numpy as np
import pytest

import oracle_harness
from tessera.llm import codebooks, queries

SMALL = "/root/testdata/sf0.001"


def brute(rows, parts=8, size=16, rounds=6, scale=4096):
    """rows: (id, vector, label), ids distinct; plain Lloyd rounds in Python numbers."""
    kept = sorted((i, [int(np.floor(scale * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    cut = lambda w, p: w[p * len(w) // parts : (p + 1) * len(w) // parts]
    codes, errors, finals = [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        xs = [cut(w, p) for _, w, _ in kept]
        book = [list(x) for x in xs[:size]]
        near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
        for _ in range(rounds):
            at = [near(x)[1] for x in xs]
            for e in range(len(book)):
                mine = [x for x, a in zip(xs, at) if a == e]
                if mine:
                    book[e] = [sum(col) // len(mine) for col in zip(*mine)]
        for n, x in enumerate(xs):
            d, e = near(x)
            codes[n] += f"{e:02x}"
            errors[n] += d
        finals += [v for c in book for v in c]
    return [(i, c, e) for (i, _, _), c, e in zip(kept, codes, errors)], hashlib.sha256(",".join(map(str, finals)).encode()).hexdigest()


def vectors(rng, n, width, spread):
    return [[round(rng.choice(spread) + rng.random() / 50, 4) for _ in range(width)] for _ in range(n)]


@pytest.mark.parametrize("n,width,spread", [(300, 64, (-1, 0, 1)), (300, 8, (-0.5, 0.0, 0.003)), (9, 16, (0, 1)), (1, 8, (2,)), (200, 24, (7.0,))])
def test_equals_plain_rounds(spark, n, width, spread):
    rng = random.Random(n + width)
    rows = [(3 * i - 40, v, rng.choice([None, 1, 2])) for i, v in enumerate(vectors(rng, n, width, spread))]
    rows += [(900, None, 1), (-900, [None] * width, 1), (-901, [float("nan")] * width, 1), (901, [float("inf")] * width, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, _w int, code int")
    codes, books = codebooks.compress(df)
    want, digest = brute(rows)
    assert sorted((r.vec_id, r.code, r.error) for r in codes.collect()) == want
    assert codebooks.books_digest(books) == digest


def test_equal_vectors_tie_to_the_lower_entry(spark):
    rows = [(i, [0.25] * 8 if i < 20 else [float(i)] * 8, 1) for i in range(40)]
    codes, books = codebooks.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    want, digest = brute(rows)
    assert sorted((r.vec_id, r.code, r.error) for r in codes.collect()) == want and codebooks.books_digest(books) == digest


def test_nearest_skips_work_and_stays_exact():
    rng = np.random.default_rng(1)
    entries = rng.integers(-4000, 4000, (16, 8))
    x = np.repeat(entries, 200, axis=0) + rng.integers(-700, 700, (3200, 8))
    plain = codebooks.squared(x[:, None], entries[None])
    codes, least, _ = codebooks.nearest(x, np.zeros(len(x), np.uint8), entries, np.ones(16, bool))
    assert (codes == plain.argmin(1)).all() and (least == plain.min(1)).all()
    again, _, looked = codebooks.nearest(x, codes, entries, np.ones(16, bool))
    assert (again == codes).all() and looked < 15 * len(x) / 4
    assert codebooks.nearest(x, codes, entries, np.zeros(16, bool))[2] == 0
    for moved_one in range(16):  # one entry moves: the assignment stays exact
        moved = np.arange(16) == moved_one
        after = np.where(moved[:, None], entries + rng.integers(-900, 900, (16, 8)), entries)
        now, least, _ = codebooks.nearest(x, codes, after, moved)
        plain = codebooks.squared(x[:, None], after[None])
        assert (now == plain.argmin(1)).all() and (least == plain.min(1)).all()


def test_repeats_null_ids_lengths_and_empty(spark):
    kind = "vec_id long, embedding array<double>, label int"
    rows = [(1, [0.5] * 8, 1), (1, [0.5] * 8, 1), (None, [0.1] * 8, None), (2, [0.3] * 16, 2), (3, [0.2] * 9, 2), (4, [], 2), (5, [9e9] * 8, 2), (6, [0.7] * 8, 3)]
    codes, books = codebooks.compress(spark.createDataFrame(rows, kind))
    got = sorted((r.vec_id or 0, r.code, r.error, r.label) for r in codes.collect())
    assert books.shape == (8, 3, 1) and [g[0] for g in got] == [0, 1, 1, 6] and all(g[2] == 0 for g in got)
    assert [g[1][:2] for g in got] == ["02", "00", "00", "01"]
    codes, books = codebooks.compress(spark.createDataFrame([], kind))
    assert codes.count() == 0 and books.size == 0


def test_query_equals_sql(spark):
    con = oracle_harness.duck(SMALL)
    assert oracle_harness.compare(spark, "op13", queries.op13_vector_codes, queries.ORACLE_SQL["op13_vector_codes"], SMALL, con)["status"] == "ok"
