import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing, prefix_counts, queries, word_bpe
from tessera.llm.common import Recent, values_of
from test_exact_and_bpe import ODD, SMALL, docs


def corpus(spark):
    return ODD + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


@pytest.mark.parametrize("window", [4096, 64, 1])
def test_packing_equals_library_and_is_gapless(spark, window):
    texts = corpus(spark) if window > 1 else ODD
    tk = Tokenizer.from_file(queries.WORD_VOCAB)
    want = {i: [*tk.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    pieces = packing.pack(docs(spark, texts).repartition(5), queries.WORD_VOCAB, window)
    rows = pieces.withColumn("crc", F.crc32("ids")).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for d, rs in by_doc.items():
        rs.sort(key=lambda r: r.start)
        assert [r.start for r in rs] == [sum(x.length for x in rs[:k]) for k in range(len(rs))]
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rs]).tolist()
        assert ids == want[d] and all(r.doc_tokens == len(ids) for r in rs)
        assert all(r.crc == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in rs)
    total = sum(map(len, want.values()))
    sizes = []
    for s in sorted(by_seq):
        rs = sorted(by_seq[s], key=lambda r: r.offset)
        assert [r.offset for r in rs] == [sum(x.length for x in rs[:k]) for k in range(len(rs))]
        sizes.append(sum(r.length for r in rs))
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert sizes[: total // window] == [window] * (total // window)
    tail = sizes[total // window :]
    assert sum(tail) == total % window and all(n & (n - 1) == 0 for n in tail) and len(set(tail)) == len(tail)


def test_sequences_and_empty(spark):
    d = docs(spark, ODD)
    made = packing.sequences(packing.pack(d, queries.WORD_VOCAB, 256)).collect()
    assert all(len(r.ids) == 4 * r.length for r in made)
    assert packing.pack(d.limit(0), queries.WORD_VOCAB).count() == 0
    with pytest.raises(ValueError):
        packing.pack(d, queries.WORD_VOCAB, 100)


def test_counts_equal_library(spark):
    tk = Tokenizer.from_file(queries.BYTE_VOCAB)
    texts = corpus(spark)
    got = {r.doc_id: r for r in prefix_counts.token_counts(docs(spark, texts), queries.BYTE_VOCAB, 100).collect()}
    for i, t in enumerate(texts):
        n = len(tk.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 100), repr(t)
        fit = got[i].fit_chars
        assert len(tk.encode((t or "")[:fit], add_special_tokens=False).ids) <= 100
        if fit < len(t or ""):
            assert len(tk.encode(t[: fit + 1], add_special_tokens=False).ids) > 100
    assert prefix_counts.token_counts(docs(spark, texts).limit(0), queries.BYTE_VOCAB).count() == 0


def test_every_prefix_equals_library():
    tk = Tokenizer.from_file(queries.BYTE_VOCAB)
    counter = prefix_counts.loaded(queries.BYTE_VOCAB)
    rng = random.Random(5)
    made = ["".join(rng.choice(["a", "the", " ", "  ", "\n", "'", "re", "ll", "'ve", "é", "日", "!", "1", "\x1c", "\xa0", "😀", "<|endoftext|>", "<|end"]) for _ in range(40)) for _ in range(40)]
    for t in [x for x in ODD if x and len(x) < 100] + made:
        assert list(counter.prefixes(t)) == [len(tk.encode(t[: i + 1], add_special_tokens=False).ids) for i in range(len(t))], repr(t)


def test_compatible_equals_merging_the_joined_bytes():
    counter = prefix_counts.loaded(queries.BYTE_VOCAB)
    assert counter.one_way
    rng = random.Random(11)
    ids = list(counter.bytes_of)
    near = [(a, b) for t in rng.sample(ids, 3000) for n in range(1, len(counter.bytes_of[t])) if (a := counter.id_of.get(counter.bytes_of[t][:n])) is not None
            and (b := counter.id_of.get(counter.bytes_of[t][n:])) is not None]
    same = [(t, t) for t in rng.sample(ids, 500)] + [(counter.id_of[b"a" * i], counter.id_of[b"a" * j]) for i in (1, 2, 3, 4) for j in (1, 2, 3, 4) if b"a" * i in counter.id_of and b"a" * j in counter.id_of]
    for a, b in near + same + [(rng.choice(ids), rng.choice(ids)) for _ in range(20_000)]:
        joined = [counter.single[c] for c in counter.bytes_of[a] + counter.bytes_of[b]]
        assert counter.compatible(a, b) == (word_bpe.merge(joined, counter.merges) == [a, b]), (counter.bytes_of[a], counter.bytes_of[b])


def test_memory_is_bounded_by_weight():
    memory = Recent(lambda keys: [len(k) for k in keys], 100)
    long = ["x" * 5000 + str(i) for i in range(50)]
    held = lambda: sum(memory.FIXED + memory.PER_CHARACTER * len(k) for g in (memory.young, memory.old) for k in g)
    for i in range(300):
        keys = [long[i % 50], *(f"{i}-{j}" + "y" * (j * 37 % 1500) for j in range(10)), "often"]
        known = memory.ready(keys)
        assert all(known[k] == len(k) for k in keys)
        assert held() < 2 * memory.most + 2 * sum(memory.FIXED + memory.PER_CHARACTER * len(k) for k in keys)
    memory.ready([])
    assert not any(len(k) > memory.LONGEST for g in (memory.young, memory.old) for k in g)


def test_many_long_texts_without_white_space(spark):
    tk = Tokenizer.from_file(queries.BYTE_VOCAB)
    texts = [("日本語テキスト" * 20_000)[i:] + str(i) for i in range(6)] + ["ab0" * 100_000]
    got = {r.doc_id: r.n_tokens for r in prefix_counts.token_counts(docs(spark, texts), queries.BYTE_VOCAB).collect()}
    assert got == {i: len(tk.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_prefix_tables_in_spark(spark):
    d = docs(spark, ["the cat's hat", "", None])
    got = {r.doc_id: r.counts for r in prefix_counts.prefix_token_counts(d, queries.BYTE_VOCAB).collect()}
    assert got[1] == [] and got[2] == [] and len(got[0]) == 13 and got[0][-1] == 4


def test_values_of_lists_equal_those_of_each_key():
    made = []
    memory = Recent(lambda keys: made.extend(keys) or [k.encode() * 2 for k in keys], 50)
    rng = random.Random(7)
    for _ in range(60):
        lists = [[str(rng.randrange(200)) * rng.choice([1, 1, 1, 900]) for _ in range(rng.randrange(40))] for _ in range(5)] + [[]]
        assert values_of(memory, lists) == [[k.encode() * 2 for k in keys] for keys in lists]
    made.clear()
    values_of(memory, [["a", "b", "a"], ["b"]])
    values_of(memory, [["b", "a"]])
    assert made == ["a", "b"]
