import hashlib
import random

import pytest

from tessera.llm import line_dedup, queries

SMALL = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, least=10):
    first, last = {}, float("inf")
    for i, t in rows:
        for k in map(key, (t or "").split("\n")):
            if len(k) >= least:
                first[k] = min(first.get(k, last), last if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == (last if i is None else i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def texts(rng, n):
    known = ["short", "A long enough line", "  a LONG enough line\t", "\x0b\rA long enough line\xa0", "another repeated line", "é" * 10, "É" * 10,
             "x" * 9, "", "  ", "日本語の十文字以上の行です"]
    for _ in range(n):
        size = rng.choice([0, 1, 3, 64, 65, 200])
        yield "\n".join(rng.choice(known + [f"unique line {rng.randrange(10**6)}"] * 4) for _ in range(size))


def test_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice([i, i, i, 5, None]), rng.choice([t, t, t, None])) for i, t in enumerate(texts(rng, 150))]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, line_dedup.drop_lines(df).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("least_hot,hot", [(1, 2), (0, 10**9), (3, 50)])
def test_hot_path_gives_the_same_bitmaps(spark, least_hot, hot):
    rng = random.Random(7)
    df = spark.createDataFrame([(i % 90 if i % 17 else None, t) for i, t in enumerate(texts(rng, 120))], "doc_id long, text string")
    plain = line_dedup.repeated_lines(df, least_hot=10**9)
    forced = line_dedup.repeated_lines(df, least_hot=least_hot, hot=hot)
    as_rows = lambda maps: sorted(map(str, maps.collect()))
    assert as_rows(plain) == as_rows(forced) and plain.count() > 50


def test_bitmap_lists_only_words_that_lose_lines(spark):
    many = "\n".join(f"line number {i} of the first" for i in range(200))
    other = "\n".join(f"line number {i} of the first" if i in (0, 63, 130) else f"other line {i}....." for i in range(200))
    df = spark.createDataFrame([(1, many), (2, other)], "doc_id long, text string")
    (row,) = line_dedup.repeated_lines(df).collect()
    bits = lambda *lost: ~sum(1 << b for b in lost) if 63 not in lost else ~(sum(1 << b for b in lost) - (1 << 64))
    assert row.doc_id == 2 and [(w.word, w.bits) for w in row["keep"]] == [(0, bits(0, 63)), (2, bits(2))]


def test_clashing_names_strings_as_ids_and_empty(spark):
    df = spark.createDataFrame([("b", "the same long line", 1, 2, 3), ("a", "the same long line", 1, 2, 3)], "id string, body string, _id int, _pos int, keep int")
    assert sorted(map(tuple, line_dedup.drop_lines(df, "id", "body").collect())) == [("a", "the same long line", 1, 0), ("b", "", 1, 1)]
    assert line_dedup.drop_lines(df.limit(0), "id", "body").count() == 0
    assert line_dedup.repeated_lines(df.limit(0), "id", "body").count() == 0


def test_very_long_text(spark):
    lines = [f"a line of some length {i}" for i in range(60_000)]
    df = spark.createDataFrame([(2, "\n".join(lines)), (1, "\n".join(lines[::3]))], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.drop_lines(df).collect()}
    assert (got[2].n_lines, got[2].n_dropped, got[1].n_dropped) == (60_000, 20_000, 0)
    assert got[2].text == "\n".join(x for i, x in enumerate(lines) if i % 3)


def test_native_with_one_range_exchange_before_the_bitmaps(spark):
    df = queries.op11_line_dedup(spark, SMALL)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert physical.count("rangepartitioning") == 1 and "SinglePartition" not in physical
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = {w[0]: (w[2], w[3], hashlib.sha256(w[1].encode()).hexdigest()) for w in brute(rows)}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()} == want
