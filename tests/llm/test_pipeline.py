import random
import tempfile

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import queries
from tessera.llm.secrets import redacted
from test_exact_and_bpe import ODD, lower
from test_near_dedup import classes_by_brute_force, edited, words


def tables(spark, texts, labels):
    path = tempfile.mkdtemp(prefix="tessera-test-")
    rows = [(i, t, "en", "s", len(t) if t is not None else 7) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def fixture():
    rng = random.Random(11)
    texts = list(ODD)
    toxic = set()
    for _ in range(120):
        base = words(rng, rng.choice([6, 40, 120]))
        if rng.random() < 0.3:
            base[rng.randrange(len(base))] = "scoundrel"
            base[rng.randrange(len(base))] = "vermin"
            toxic.add(len(texts))
        texts.append(" ".join(base))
        if rng.random() < 0.2:
            texts.append(texts[-1].upper())
            toxic |= {len(texts) - 1} & {x + 1 for x in toxic}
        if len(base) > 100 and rng.random() < 0.5:
            texts.append(" ".join(edited(rng, base, 2)))
            toxic |= {len(texts) - 1} if "scoundrel" in texts[-1] or "vermin" in texts[-1] else set()
    texts += ["my token = abcdef123456 " + " ".join(words(rng, 30)), "AKIA" + "A1B2" * 4 + " key"]
    return texts, toxic


def test_stages_equal_brute_force(spark):
    texts, toxic = fixture()
    path = tables(spark, list(enumerate(texts)), [(i, 1, int(i in toxic)) for i in range(0, len(texts) - 2)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = list(range(len(texts)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        got = {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            kept = [i for i in kept if not any(w in (texts[i] or "").lower() for w in ("scoundrel", "vermin"))]
        elif name == "exact_dedup":
            last = {lower(texts[i]): i for i in kept}
            kept = sorted(last.values())
        elif name == "near_dedup":
            kept = sorted({kept[c] for c in classes_by_brute_force([texts[i] for i in kept])})
        else:
            texts = [t if t is None else redacted(t, "[secret]") for t in texts]
            assert all(got[i].n_chars == (len(texts[i]) if texts[i] is not None else 7) for i in kept)
        assert sorted(got) == kept and all(got[i].text == texts[i] for i in kept), name
        docs = spark.createDataFrame(out.collect(), out.schema)
    tk = Tokenizer.from_file(queries.WORD_VOCAB)
    pieces = corpus_pipeline.run(spark, path).collect()
    ids = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert ids == {i: [*tk.encode(texts[i] or "", add_special_tokens=False).ids, 2] for i in kept}


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "null id text"), (1, None), (1, None), (2, "a b"), (2, "a b"), (3, "A B"), (4, "")]
    path = tables(spark, rows, [(1, None, None), (None, 1, 1)])
    out = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, 3), (False, 4), (True, 0)]
    empty = tables(spark, [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0
