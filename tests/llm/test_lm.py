import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import lm, queries
from test_exact_and_bpe import ODD, SMALL, docs


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def check_base(rows, texts):
    train = Counter()
    ends = 0
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            train.update(words(t))
            ends += 1
    n, v = sum(train.values()) + ends, len(train) + bool(ends)
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ws = words(texts[r.doc_id])
        counts = [train[w] for w in ws] + [ends]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws) + 1, sum(c > 0 for c in counts), n)
        assert math.isclose(r.base_score, sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in counts), rel_tol=1e-9)


def test_base_and_score_on_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 500)
    rows = queries.op3_lm_scoring(spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    check_base(rows, texts)
    assert all(r.score < 0 for r in rows)


def test_model_beats_the_base_on_held_out_texts(spark):
    held = [r for r in queries.op3_lm_scoring(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark):
    texts = dict(enumerate(ODD * 2))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    check_base(lm.score_texts(docs(spark, ODD * 2), held, queries.WORD_VOCAB).collect(), texts)
    d = docs(spark, ["a b", "a b", "a c"], [1, 1, 1])
    got = lm.score_texts(d, F.lit(False), queries.WORD_VOCAB).collect()
    assert sorted(r.n_tokens for r in got) == [3, 3] and {r.train_tokens for r in got} == {9}
    none = lm.score_texts(d, F.lit(True), queries.WORD_VOCAB).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and abs(r.base_score) < 1e-12 and r.score < 0 for r in none)
    assert lm.score_texts(d.limit(0), F.lit(True), queries.WORD_VOCAB).count() == 0


def model(vocabulary=50, training=3000):
    rng = np.random.default_rng(3)
    size = vocabulary + 1
    ids = rng.integers(0, vocabulary, training)
    keys, n = np.unique(np.append(ids[:-1] * size + (ids[1:] + ids[:-1]) % vocabulary, [size * size + 3]), return_counts=True)
    m = lm.from_counts(np.bincount(ids, minlength=size).astype(float), keys, n.astype(float))
    m.parameters = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in m.parameters.items()}
    return m


def test_pair_table_finds_all_keys():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 10**12, 5000))
    table = lm.PairTable(keys, np.arange(len(keys)) + 1.0)
    assert (table.get(keys) == np.arange(len(keys)) + 1).all() and (table.get(np.setdiff1d(keys + 1, keys)) == 0).all()
    assert lm.PairTable(keys[:0], np.zeros(0)).get(keys).sum() == 0


def test_tasks_hold_as_many_of_the_frequent_as_they_may(spark):
    counts = spark.createDataFrame([(i - 5, n) for i, n in enumerate([1] * 40 + [2] * 30 + [3] * 20 + [100_000] * 4)], "at long, n long")
    assert [lm.least_held(counts, "n", most) for most in (100, 94, 93, 54, 53, 24, 23, 4)] == [0, 0, 1, 1, 2, 2, 3, 3]
    assert counts.filter(F.col("n") > lm.least_held(counts, "n", 3)).count() <= 3  # beyond the counts told apart
    at, n = lm.held(counts.filter("n > 2"), "at", "n")
    assert at.tolist() == list(range(65, 89)) and n.tolist() == [3] * 20 + [100_000] * 4
    assert len(lm.held(counts.limit(0), "at", "n")[0]) == 0 and lm.least_held(counts.limit(0), "n", 3) == 0


def test_words_of_joined_texts_are_those_of_each():
    texts = ["", "One two\tone", " ", "é ONE\x0bx", "a" * 70_000, "", "b c " * 20_000, "two"]
    got = [(i, h) for words, owner in lm.joined_words(texts) for h, i in zip(words.tolist(), owner.tolist())]
    assert got == [(i, h) for i, t in enumerate(texts) for h in lm.byte_word_hashes(lm.lower_bytes(t)).tolist()]


def test_key_counts_and_pairs_of_streams_are_whole():
    rng = np.random.default_rng(6)
    arrays = [rng.integers(0, 3000, 700_000) for _ in range(7)] + [np.zeros(0, np.int64)]
    got = Counter()
    for keys, n in lm.key_counts(arrays):
        assert (np.diff(keys) > 0).all()
        got.update(dict(zip(keys.tolist(), n.tolist())))
    assert got == Counter(np.concatenate(arrays).tolist()) and list(lm.key_counts([])) == []
    m, size = model(), 51
    streams = [np.array(s, np.int64) for s in ([], [7, 7, 7, 7], [3, 4])]
    m.pairs = lm.PairTable(np.array([7 * size + 7]), np.ones(1))
    _, row, key, times = lm.stream_scores(m, streams)
    assert list(zip(row.tolist(), key.tolist(), times.tolist())) == [
        (0, size * size + 50, 1), (1, 7 * size + 50, 1), (1, size * size + 7, 1), (2, 3 * size + 4, 1), (2, 4 * size + 50, 1), (2, size * size + 3, 1)]
    m.pairs = lm.PairTable(np.zeros(0, np.int64), np.zeros(0))
    _, row, key, times = lm.stream_scores(m, streams)
    assert (1, 7 * size + 7, 3) in list(zip(row.tolist(), key.tolist(), times.tolist())) and int(times.sum()) == 9


def test_rare_pairs_count_as_much_as_held_ones(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["red", "blue", "cat", "dog", "runs", "sits"], 30)) + f" only{i % 9}" for i in range(60)]
    held = F.col("doc_id") % 10 == 0

    def scores():
        return {r.doc_id: r.score for r in lm.score_texts(docs(spark, texts), held, queries.WORD_VOCAB).collect()}

    whole = scores()
    for pairs in (100, 1):  # the first holds few pairs in the tasks, the other none
        monkeypatch.setattr(lm, "PAIRS", pairs)
        some = scores()
        assert some.keys() == whole.keys() and all(math.isclose(some[i], whole[i], rel_tol=1e-4) for i in whole)


def test_every_training_text_is_counted_and_trained_on_once(spark):
    texts = [np.array([i, i + 1, 7], "<u2") for i in range(200)]
    train = spark.createDataFrame([(i, t.tobytes()) for i, t in enumerate(texts)], "_id long, _ids binary")
    counts = {r.at: r.n for r in lm.pair_counts(train, 301, np.dtype("<u2")).collect()}
    want = Counter(int(a) * 301 + int(b) for t in texts for a, b in zip([301, *t], [*t, 300]))
    assert counts == want
    rounds = [train.filter(lm.in_round(r)).select("_id").collect() for r in range(lm.ROUNDS)]
    assert sorted(x._id for some in rounds for x in some) == list(range(200)) and all(rounds)


def test_windows_count_each_id_once_and_batches_agree():
    m = model()
    rng = np.random.default_rng(4)
    streams = [rng.integers(0, 50, n) for n in (0, 1, 7, 8, 9, 31, 32, 33, 55, 56, 57, 200, 2000)]
    x, y, counted, owner = lm.windows(streams, m.end)
    for i, s in enumerate(streams):
        assert y[owner == i][counted[owner == i]].tolist() == [*s, m.end]
    together = lm.log_probabilities(m, streams)
    alone = [lm.log_probabilities(m, [s])[0] for s in streams]
    assert np.allclose(together, alone, rtol=1e-4)


def test_causal_and_a_distribution():
    m = model()
    for start in ([], [3, 4], list(range(40))):
        x, y, counted, _ = lm.windows([np.array(start, np.int64)], m.end)
        at = tuple(np.argwhere(counted & (y == m.end))[-1])
        total = 0.0
        for i in range(m.end + 1):
            y[at] = i
            logs, _ = lm.forward(m, x, y)
            total += float(np.exp(logs[at] + m.log_in_class(x[at][None], np.array([i]))[0]))
        assert abs(total - 1) < 1e-4
    one, two = np.arange(30), np.append(np.arange(20), 49 - np.arange(10))
    (x, y, _, _), (z, w, _, _) = lm.windows([one], m.end), lm.windows([two], m.end)
    assert np.allclose(lm.forward(m, x, y)[0][0, :19], lm.forward(m, z, w)[0][0, :19])


def test_gradients_are_right():
    m = model()
    m.parameters = {k: v.astype(np.float64) for k, v in m.parameters.items()}
    x, y, counted, _ = lm.windows([np.arange(40) % 50, np.arange(5)], m.end)
    loss = lambda: -(lm.forward(m, x, y)[0] * counted).sum() / counted.sum()
    g = lm.gradients(m, lm.forward(m, x, y)[1], counted)
    rng = np.random.default_rng(1)
    for name, v in m.parameters.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in v.shape)
            if name == "embed":
                at = (int(lm.bucket_of(np.array([rng.integers(0, 40)]))[0]), at[1])
            old = v[at]
            v[at] = old + 1e-5
            up = loss()
            v[at] = old - 1e-5
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-5 - g[name][at]) < 2e-5, name


def test_batch_gradients_leave_out_only_places_that_do_not_count():
    m = model()
    x, y, counted, _ = lm.windows([np.arange(200) % 50, np.arange(5), np.arange(40) % 7], m.end)
    later = ~counted[:, : lm.CONTEXT].any(axis=1)
    assert later.any() and not later.all()
    assert lm.forward(m, x[later], y[later], lm.CONTEXT)[1]["a"].shape[1] == lm.STRIDE
    for some in (slice(None), later, ~later):
        want = lm.gradients(m, lm.forward(m, x[some], y[some])[1], counted[some])
        got = lm.batch_gradients(m, x[some], y[some], counted[some])
        assert got.keys() == want.keys() == m.parameters.keys()
        assert all(np.allclose(got[k], want[k], rtol=1e-3, atol=1e-6) for k in want)


def test_training_lowers_the_loss():
    m = model()
    rng = np.random.default_rng(0)
    streams = [np.tile(rng.permutation(50)[:5], 20) for _ in range(300)]
    before = lm.log_probabilities(m, streams).sum()
    lm.trained(m, [streams] * 4)
    assert lm.log_probabilities(m, streams).sum() > before


def test_unlike_texts_without_an_id_stay_apart(spark):
    texts = [f"text number {i} of many {i * 7919 % 1009}" for i in range(1500)]
    d = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert lm.score_texts(d, F.lit(False), queries.WORD_VOCAB).count() == 1500
