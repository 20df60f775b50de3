import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import exact_dedup, queries, word_bpe

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "A b", "a B", "a b", "É b", "é b", "İ Σας ΟΔΟΣ", "x" * 5000, "The Cat's  12345 <|endoftext|>x<|startoftext|>",
       "é ́a  b c\x1cd \x1c \x1f", "don't WE'LL '' 've 's's", "日本語 テスト 😀😀", "a\x00b ﻿", "ab" * 3000 + "\n\t" + "zq" * 700, "<|endoftext|", "½ ² ٣ Ⅷ"]


def docs(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame(list(zip(ids, texts, ["x"] * len(texts))), "doc_id long, text string, kept string")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("runs,fan_in", [(256, 16), (27, 3), (8, 2), (64, 4)])
def test_exact_dedup_brute_force(spark, runs, fan_in):
    rng = random.Random(1)
    texts = ODD + [rng.choice(["Hot copy", "hot COPY", "ÀB", "àb", "Éa", "Ⅷ", "ⅷ", None, ""]) for _ in range(300)]
    ids = list(range(len(texts)))
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs(spark, texts, ids), runs=runs, fan_in=fan_in).collect()}
    assert len(got) == len(texts)
    groups = {}
    for i, t in zip(ids, texts):
        groups.setdefault(lower(t), []).append(i)
    for t, members in groups.items():
        for i in members:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(members), len(members), i == max(members))
            assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_nulls_repeats_empty(spark):
    d = docs(spark, ["a", "a", "A", "b"], [1, 1, None, None])
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(d).collect())
    assert got == [(-1, -1, 1, True), (-1, 1, 3, False), (1, 1, 3, True)]
    kept = exact_dedup.keep_first(d)
    assert kept.columns == d.columns and sorted(r.text for r in kept.collect()) == ["a", "b"]
    assert exact_dedup.exact_duplicates(d.limit(0)).count() == 0


def test_exact_dedup_is_native(spark):
    plan = queries.op6_exact_dedup(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_runs_meet_in_binomial_rounds(spark):
    runs = spark.range(64).select(F.col("id").cast("int").alias("r"))
    for step, fan_in in ((1, 2), (2, 2), (8, 2), (1, 4), (16, 4)):
        got = {x.r: x.t for x in runs.select("r", exact_dedup.receiver(F.col("r"), step, fan_in).alias("t")).collect()}
        assert all(got[r + j * step] == r for r in range(0, 64, step * fan_in) for j in range(fan_in))
    assert [exact_dedup.run_count(n) for n in (1, 16, 17, 211, 4096)] == [16, 16, 64, 256, 4096]


@pytest.mark.parametrize("keep,want", [("max", 9), ("min", 2)])
def test_merge_sorts_and_keeps_the_best_id(spark, keep, want):
    rows = [(0, b"k", 1, 7, i, 2) for i in (5, 9, None, 2)] + [(0, b"l", 1, 7, None, 1), (4, b"k", 1, 7, 1, 1)]
    merged = exact_dedup.merge_runs(spark.createDataFrame(rows, "_run int, _sha binary, _bytes int, _check long, _best long, _n long"), keep)
    assert {(r._run, bytes(r._sha)): (r._best, r._n) for r in merged.collect()} == {(0, b"k"): (want, 8), (0, b"l"): (None, 1), (4, b"k"): (1, 1)}
    plan = merged._jdf.queryExecution().toString()
    assert "SortAggregate" in plan and "HashAggregate" not in plan


def test_keep_first_with_clashing_names(spark):
    rows = [(1, "a", "x", "y", 0, 0), (2, "A", "x", "y", 0, 0), (None, "b", None, None, 1, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _mark_id string, _mark_sha string, _run int, _best int")
    for keep, first in (("max", 2), ("min", 1)):
        kept = exact_dedup.keep_first(d, keep=keep)
        assert kept.columns == d.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, first]


def test_bpe_equals_library(spark):
    tk = Tokenizer.from_file(queries.WORD_VOCAB)
    texts = ODD + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    d = docs(spark, texts)
    want = [tk.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids = {r.doc_id: r.ids for r in word_bpe.encode_texts(d, queries.WORD_VOCAB).collect()}
    for i, w in enumerate(want):
        assert ids[i] == w, texts[i]
    for r in word_bpe.encode_digests(d, queries.WORD_VOCAB).collect():
        w = want[r.doc_id]
        assert r.n_tokens == len(w)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, w)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tk.decode(w, skip_special_tokens=False).encode()).hexdigest()
    back = word_bpe.decode_ids(word_bpe.encode_texts(d, queries.WORD_VOCAB), queries.WORD_VOCAB)
    assert {r.doc_id: r.text for r in back.collect()} == {i: tk.decode(w, skip_special_tokens=False) for i, w in enumerate(want)}
    assert word_bpe.encode_texts(d.limit(0), queries.WORD_VOCAB).count() == 0


def test_forced_cuts_split_words_certainly():
    bpe = word_bpe.loaded(queries.WORD_VOCAB)
    rng = random.Random(3)
    cut = 0
    for _ in range(2000):
        w = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyzqxzjv0123") for _ in range(rng.randint(1, 60)))
        ids = [bpe.inner[b] for b in w[:-1]] + [bpe.last[w[-1]]]
        cut += len(bpe.cuts(w))
        assert bpe.encode_word(w) == word_bpe.merge(ids, bpe.merges) == word_bpe._merge_long(ids, bpe.merges)
    assert cut > 1000
