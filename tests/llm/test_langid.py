import zlib

import numpy as np

from tessera.llm import langid, queries
from test_exact_and_bpe import ODD, docs

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_contract(spark):
    rows = queries.op7_language_id(spark, DIR).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98


def test_mixture_and_edges(spark):
    d = spark.read.parquet(f"{DIR}/documents.parquet")
    model = langid.train(d)
    texts = {x: " ".join(r.text for r in d.filter(d.lang == x).limit(5).collect())[:3000] for x in ("en", "de", "fr")}
    _, _, langs, shares = model.infer(texts["en"] + " " + texts["de"])
    assert set(langs) == {"en", "de"} and min(shares) > 0.3
    assert model.infer(texts["fr"])[2] == ["fr"]
    got = {r.doc_id: r for r in langid.identify(docs(spark, [*ODD, "123 !? __"]), model).collect()}
    assert len(got) == len(ODD) + 1
    for i in (0, 1, 2, len(ODD)):
        assert got[i].lang_pred == "und" and got[i].score == 0.0
    empty = langid.train(d.limit(0))
    assert empty.languages == [] and empty.infer("abc")[0] == "und"
    assert langid.identify(d.limit(0), model).count() == 0


def test_long_text_counts_in_segments():
    text = "abc déf " * 300_000
    assert langid.trigram_counts(text).sum() == len(f" {text} ".encode()) - 2
    short = langid.trigram_counts("abc")
    assert short.sum() == 3 and np.count_nonzero(short) <= 3
