"""Toxicity by weak supervision: many weak voters, a generative label model, a linear classifier.

Voters are induced from a bounded sample of labelled texts: lexicon voters (a word occurs), pattern voters (a
word with a certain beginning occurs) and density voters (how many words, and what share of the words, any of the
others hits); the annotator who gave the label is one more voter.  A label model explains their votes by a hidden label: expectation-
maximisation estimates the prior, how often each voter fires under either label (its accuracy), and the
correlations of voters given the label; voters that repeat each other share their weight.  Its posterior labels,
not the given ones, train a logistic regression over the same kinds of features, which scores every text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, batches, small_batches, text_of, written

MAX_LABELLED = 20_000  # labelled texts that are learned from, in expectation; a hash of the id picks them
VOTERS, FEATURES = 300, 4000  # lexicon and pattern voters of the label model, features of the classifier
LEAST_FIRED = 4  # toxic texts of the sample that a feature occurs in
LEAST_ODDS, LEAST_Z = 1.5, 5.0  # log odds ratio of a feature between the labels, and that over its standard error
DENSITIES = (0.0005, 0.002, 0.004, 0.007, 0.011, 0.016)  # edges of the classes of the share of words hit
HITS = (1, 2, 3, 5)  # edges of the classes of the number of words hit
BEGINNINGS = (3, 4, 5, 6)
ROUNDS = 20
WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """Lexicon feature and pattern features of a lower-case word."""
    return [f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n)]


def features(text: str) -> set[str]:
    return {f for w in set(WORD.findall(text.lower())) for f in features_of(w)}


ANNOTATOR = ("@clean", "@toxic")
DENSITY_FEATURES = [*(f"%{i}" for i in range(len(DENSITIES) + 1)), *(f"#{i}" for i in range(len(HITS) + 1))]


def found_in(words: list[str], of: dict[str, tuple[str, ...]]) -> set[str]:
    """Features of a text from those that each of its words has (``of``), with the classes of density and hits."""
    hit = [fs for w in words if (fs := of[w])]
    share = len(hit) / max(1, len(words))
    return {f"%{bisect_right(DENSITIES, share)}", f"#{bisect_right(HITS, len(hit))}"}.union(*hit)


@dataclass
class LabelModel:
    """Generative model of votes: log odds without votes, firing rates under toxic and clean, within-label correlations, weights."""

    start: float
    toxic_rate: np.ndarray
    clean_rate: np.ndarray
    correlation: np.ndarray
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of the toxic label for rows of 0/1 votes; a voter that doesn't fire abstains."""
        odds = self.start + votes @ self.evidence()
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


    def balanced(self, votes: np.ndarray, n: np.ndarray, share: float) -> "LabelModel":
        """The same model with the start that gives the toxic label the known share of all texts."""
        low, high = -100.0, 100.0
        for _ in range(60):
            middle = (low + high) / 2
            at = replace(self, start=middle)
            low, high = (middle, high) if n @ at.posterior(votes) < share * n.sum() else (low, middle)
        return at

    def evidence(self) -> np.ndarray:
        """What each firing voter adds to the log odds."""
        return np.log(self.toxic_rate / self.clean_rate) * self.weight


def fit_label_model(votes: np.ndarray, n: np.ndarray, seen: tuple[np.ndarray, np.ndarray], totals: tuple[float, float]) -> LabelModel:
    """Expectation-maximisation over distinct vote rows (``n`` texts each).

    ``seen`` says how often each voter fired in labelled toxic and clean texts, ``totals`` how many of these there
    are: prior counts that keep voters of different languages, which never fire together, from drifting apart.  The
    share of toxic texts is held at that of the labels.
    """
    share = (totals[0] + 0.01) / (sum(totals) + 1)
    voters = votes.shape[1]
    rates = [(s + e) / (t + 1) for s, t, e in zip(seen, totals, (0.5, 0.01))]
    model = LabelModel(0.0, *rates, np.eye(voters), np.ones(voters)).balanced(votes, n, share)
    for _ in range(ROUNDS):
        p = model.posterior(votes)
        masses = (n * p, n * (1 - p))
        rates = [np.clip((m @ votes + s + e) / (m.sum() + t + 1), 1e-6, 1 - 1e-6) for m, s, t, e in zip(masses, seen, totals, (0.5, 0.01))]
        shared = np.zeros((voters, voters))
        for m, rate in zip(masses, rates):
            spread = votes - rate
            shared += (spread * m[:, None]).T @ spread
        scale = np.sqrt(np.maximum(np.diag(shared), 1e-12))
        correlation = shared / np.outer(scale, scale)
        np.fill_diagonal(correlation, 1.0)
        weight = 1 / np.maximum(1.0, (np.clip(correlation, 0, 1) ** 2).sum(axis=1))
        model = LabelModel(0.0, *rates, correlation, weight).balanced(votes, n, share)
    return model


@dataclass
class ToxicityModel:
    """Bias and weights of the linear classifier; ``labels`` is the label model it was taught by, for inspection."""

    bias: float
    weights: dict[str, float]
    voters: list[str] = field(default_factory=list)
    labels: LabelModel | None = None

    def score(self, found: set[str]) -> float:
        odds = self.bias + sum(self.weights.get(f, 0.0) for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(odds, -500, 500))))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                    max_rows: int = MAX_LABELLED) -> DataFrame:
    """``text, label`` of at most about ``max_rows`` labelled documents, picked by a hash of their id.

    The labels picked have a bounded size, so they are sent to the documents, whose texts do not move.  Of several
    labels of one id the toxic one counts.
    """
    own = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    share = min(1.0, max_rows / max(1, own.count()))
    picked = own.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text"))
    return texts.join(F.broadcast(picked), "_id").select("text", "label")


def fit(sample: DataFrame) -> ToxicityModel:
    """Learn from ``text, label`` rows.  Without rows of both labels, or without voters, the score is the prior."""
    spark = sample.sparkSession
    small_batches(spark)
    sample = written(sample, "toxicity-sample")
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    prior = (toxic + 0.01) / (toxic + clean + 1)
    constant = ToxicityModel(float(np.log(prior / (1 - prior))), {})
    if not toxic or not clean:
        return constant

    def count(it):
        for b, texts in batches(it, "text"):
            sums = (Counter(), Counter())
            for text, label in zip(texts, b.column("label").to_pylist()):
                sums[int(label == 1)].update(features(text))
            names = list(sums[0].keys() | sums[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([s[f] for f in names], pa.int64()) for s in (sums[1], sums[0]))], names=["feature", "a", "b"])

    counts = sample.mapInArrow(count, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    up, down = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(up / (toxic - F.col("a") + 0.5)) - F.log(down / (clean - F.col("b") + 0.5))
    ranked = counts.filter(F.col("a") >= LEAST_FIRED).withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / up + 1 / down))
    top = ranked.filter((F.col("odds") > LEAST_ODDS) & (F.col("z") > LEAST_Z)).orderBy(F.desc("z"), "feature").limit(FEATURES).collect()
    if not top:
        return constant
    lexicon = {r["feature"] for r in top}
    voters = [*(r["feature"] for r in top[:VOTERS]), *DENSITY_FEATURES, *ANNOTATOR]
    place = {f: i for i, f in enumerate(voters)}

    def vote(it):
        memory = Recent(lambda words: (tuple(f for f in features_of(w) if f in lexicon) for w in words), 300_000)
        for b, texts in batches(it, "text"):
            split = [WORD.findall(t.lower()) for t in texts]
            found = [sorted(found_in(ws, memory.ready(set(ws)))) for ws in split]
            given = b.column("label").to_pylist()
            fired = [sorted(place[f] for f in (*fs, ANNOTATOR[int(y == 1)]) if f in place) for fs, y in zip(found, given)]
            columns = [pa.array(found, pa.list_(pa.string())), pa.array(fired, pa.list_(pa.int32())), b.column("label")]
            yield pa.RecordBatch.from_arrays(columns, names=["found", "votes", "label"])

    voted = written(sample.mapInArrow(vote, "found array<string>, votes array<int>, label int"), "toxicity-votes")
    rows = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == 1).cast("int")).alias("a")).collect()  # at most the sample
    votes = np.zeros((len(rows), len(voters)), np.float64)
    for i, r in enumerate(rows):
        votes[i, r["votes"]] = 1
    n, a = (np.array([r[k] for r in rows], float) for k in ("n", "a"))
    model = fit_label_model(votes, n, (a @ votes, (n - a) @ votes), (toxic, clean))

    given = F.array(*[F.lit(float(w)) for w in model.evidence()])
    odds = F.aggregate("votes", F.lit(float(model.start)), lambda acc, j: acc + F.element_at(given, j + 1))
    taught = voted.withColumn("p", 1 / (1 + F.exp(-odds)))
    names = [*sorted(lexicon), *DENSITY_FEATURES]
    vectors = CountVectorizerModel.from_vocabulary(names, inputCol="found", outputCol="vector", binary=True).transform(taught)
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("p").alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - F.col("p")).alias("w"))))
    train = vectors.select("vector", both.alias("t")).select("vector", "t.y", "t.w").filter("w > 1e-9")
    fitted = LogisticRegression(featuresCol="vector", labelCol="y", weightCol="w", maxIter=60, regParam=1e-4, standardization=False).fit(train)
    learned = {f: float(w) for f, w in zip(names, fitted.coefficients.toArray())}
    return ToxicityModel(float(fitted.intercept), learned, voters, model)


def _scorer(model: ToxicityModel):
    """Scores of a list of texts, in a task."""
    known = model.weights
    memory = Recent(lambda words: (tuple(f for f in features_of(w) if f in known) for w in words), 300_000)

    def scores(texts: list[str]) -> list[float]:
        split = (WORD.findall(t.lower()) for t in texts)
        return [model.score(found_in(ws, memory.ready(set(ws)))) for ws in split]

    return scores


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, predicted`` of whole texts (score from 0 to 1; predicted 1 from 0.5 on).

    Null and empty texts have the score of a text without features.  Repeated rows give repeated rows, an
    empty table none; other columns are not read.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(it):
        scores = _scorer(shared.value)
        for b, texts in batches(it, "_text"):
            s = np.array(scores(texts))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["_id", "score", "predicted"])

    id_type = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    return picked.mapInArrow(run, f"_id {id_type}, score double, predicted int").withColumnRenamed("_id", id_col)


def drop_toxic(df: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df``, with all columns, whose text scores below the threshold."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(it):
        scores = _scorer(shared.value)
        for b in it:
            if b.num_rows:
                s = np.array(scores([t or "" for t in b.column(at).to_pylist()]))
                yield b.filter(pa.array(s < threshold))

    return df.mapInArrow(run, df.schema)
