import zlib

import numpy as np

from tessera.llm import queries, toxicity
from test_exact_and_bpe import ODD, docs

DIR = "/root/testdata/sf0.1"


def test_held_out_quality_and_contract(spark):
    rows = queries.op1_toxicity(spark, DIR).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    n = spark.read.parquet(f"{DIR}/documents.parquet").count()
    assert len(rows) == n
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.98
    assert sum(p for p, t in held if t) / sum(t for _, t in held) > 0.9


def test_label_model_finds_rates_and_shares_weight_of_copies():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.3
    rate1, rate0 = np.array([0.6, 0.5, 0.4, 0.5]), np.array([0.05, 0.1, 0.02, 0.05])
    votes = np.where(y[:, None], rng.random((6000, 4)) < rate1, rng.random((6000, 4)) < rate0).astype(float)
    votes = np.column_stack([votes, votes[:, 0]])
    m = toxicity.fit_label_model(votes, np.ones(6000), (np.full(5, 8.0), np.full(5, 3.0)), (20.0, 50.0))
    assert m.correlation[0, 4] > 0.99 and abs(m.weight[0] - 0.5) < 0.1 and m.weight[1] > 0.8
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.85


def test_edges(spark):
    texts = [*ODD, *[f"you are a scum{i} fool word{i}" for i in range(40)], *[f"a fine day with word{i}" for i in range(60)]]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(len(ODD) + i, 1 if i < 40 else 0, None) for i in range(100)] + [(0, None, None), (None, 1, None), (len(ODD), 0, None)],
                                   "doc_id long, toxic int, text string")
    model = toxicity.fit(toxicity.labelled_sample(d, labels))
    assert "=fool" in model.voters and "^scu" in model.voters
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert len(got) == len(texts) and all(got[len(ODD) + i].predicted == (i < 40) for i in range(100))
    assert got[0].score == got[1].score < 0.5
    kept = toxicity.drop_toxic(d, model)
    assert kept.columns == d.columns and kept.count() == len(texts) - 40
    none = toxicity.fit(toxicity.labelled_sample(d, labels.limit(0)))
    assert {r.predicted for r in toxicity.score(d, none).collect()} == {0}
    assert toxicity.score(d.limit(0), model).count() == 0
    assert toxicity.labelled_sample(d, labels, max_rows=10).count() < 40
