"""Language identification by mixture inference over n-grams.

Training counts hashed byte trigrams of the labelled texts per language, in Spark.  Each document is then read
as a mixture: expectation-maximisation estimates the proportions of the languages from the likelihoods of its
trigrams, and the set of languages is the one with the best penalised likelihood (half the logarithm of the
number of independent trigrams for each proportion that is free).  The prediction is the language with the
largest proportion in that set.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, small_batches, text_of, to_batch

BUCKETS = 1 << 14
SEGMENT = 1 << 20  # bytes of a long text that are counted at a time
SMOOTHING = 0.5
ROUNDS = 25
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def trigram_counts(text: str) -> np.ndarray:
    """Counts of the hashed byte trigrams of the lower-cased text, all of it."""
    data = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    out = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(data) - 2, SEGMENT):
        a = data[start : start + SEGMENT + 2].astype(np.uint32)
        code = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761)
        out += np.bincount(code >> np.uint32(18), minlength=BUCKETS)
    return out


@dataclass
class LanguageModel:
    """Learned languages, in order, and the log probability of each bucket in each (languages x buckets)."""

    languages: list[str]
    log_p: np.ndarray

    def infer(self, text: str) -> tuple[str, float, list[str], list[float]]:
        """Predicted language, its score (its proportion among all languages), the chosen set and its proportions."""
        if not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0, [], []
        counts = trigram_counts(text)
        seen = np.flatnonzero(counts)
        c = counts[seen].astype(np.float64)
        logs = self.log_p[:, seen]
        single = logs @ c
        shift = logs.max(axis=0)
        p = np.exp(logs - shift)
        base = float(shift @ c)
        shares, full = proportions(p, c)
        penalty = 0.5 * np.log(max(c.sum() / 3, 2.0))
        order = np.argsort(-shares, kind="stable")
        best = int(single.argmax())
        chosen, found, value = [best], np.ones(1), single[best] - base
        for size in range(2, len(order) + 1):
            if full - (size - 1) * penalty <= value:  # no set of this size can be better
                break
            some = order[:size]
            s, ll = proportions(p[some], c)
            if ll - (size - 1) * penalty > value:
                chosen, found, value = list(some), s, ll - (size - 1) * penalty
        top = chosen[int(found.argmax())]
        names = [self.languages[i] for i in chosen]
        return self.languages[top], float(min(1.0, max(0.0, shares[top]))), names, [float(x) for x in found]


def proportions(p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture proportions by expectation-maximisation and the log likelihood they reach."""
    share = np.full(len(p), 1.0 / len(p))
    total = c.sum()
    for _ in range(ROUNDS):
        mix = share @ p
        new = share * (p @ (c / mix)) / total
        if np.abs(new - share).max() < 1e-4:
            share = new
            break
        share = new
    return share, float(c @ np.log(share @ p))


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """Learn from rows whose language is not null; null texts count as empty.

    Each task adds up its counts per language, so what is shuffled and read back is bounded by buckets and
    languages, not by rows.  Without rows the model has no language and predicts ``und``.
    """
    small_batches(df.sparkSession)

    def count(it):
        sums: dict[str, np.ndarray] = {}
        for b, texts in batches(it, "_text"):
            for lang, text in zip(b.column("_lang").to_pylist(), texts):
                counts = trigram_counts(text)
                if lang in sums:
                    sums[lang] += counts
                else:
                    sums[lang] = counts
        for lang, counts in sums.items():
            seen = np.flatnonzero(counts)
            yield to_batch({"lang": [lang] * len(seen), "bucket": seen, "n": counts[seen]}, {"lang": pa.string(), "bucket": pa.int32(), "n": pa.int64()})

    rows = df.select(F.col(lang_col).cast("string").alias("_lang"), text_of(text_col).alias("_text")).filter("_lang IS NOT NULL")
    parts = rows.mapInArrow(count, "lang string, bucket int, n long")
    table = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[table["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int), table["bucket"].to_numpy(int)] = table["n"]
    log_p = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS))
    return LanguageModel(languages, log_p)


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score, langs, shares`` of whole texts.

    ``und`` with score 0 and no languages if the text is null or has no letter, or nothing was learned.  Ties go
    to the language first in order.  Repeated rows give repeated rows, an empty table none; other columns are
    not read.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    types = {"lang_pred": pa.string(), "score": pa.float64(), "langs": pa.list_(pa.string()), "shares": pa.list_(pa.float64())}

    def run(it):
        for b, texts in batches(it, "_text"):
            found = [shared.value.infer(t) for t in texts]
            out = to_batch({name: [f[i] for f in found] for i, name in enumerate(types)}, types)
            yield pa.RecordBatch.from_arrays([b.column("_id"), *out.columns], names=["_id", *types])

    id_type = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    schema = f"_id {id_type}, lang_pred string, score double, langs array<string>, shares array<double>"
    return picked.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
