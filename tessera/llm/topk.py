"""Exact top-k by inner product: term-at-a-time accumulation over blocks.

A vector is a sparse row of (term, weight).  Candidates are dealt into blocks by a hash of their id, queries
into blocks too, and each pair of blocks is one unit of work of bounded size.  In a unit the candidates become
postings (term -> rows and weights); the queries' weights of one term after another are scattered, times the
postings' weights, into a dense array of scores.  Every candidate is scored, none is skipped.  Partition
selection finds the best k of each query in the unit; a ranked window merges the units' few winners.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAFE = 1 << 26  # weights below this have exact 64-bit products and sums of up to 2048 terms
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
STRIP = 128  # queries scored together: the dense array is STRIP x CANDIDATE_BLOCK


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a long array; null if the vector is null or holds null or non-finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def postings(rows: list[list[int]], dtype) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """term -> (rows that have it, their weights), zero weights left out."""
    sizes = [len(r) for r in rows]
    if not rows or not sum(sizes):
        return {}
    term = np.concatenate([np.arange(n) for n in sizes])
    row = np.repeat(np.arange(len(rows)), sizes)
    weight = np.array([w for r in rows for w in r], dtype)
    keep = np.flatnonzero(weight != 0)
    order = keep[np.argsort(term[keep], kind="stable")]
    terms, firsts = np.unique(term[order], return_index=True)
    return {int(t): (row[part], weight[part]) for t, part in zip(terms, np.split(order, firsts[1:]))}


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the earlier position."""
    n = len(scores)
    if n <= k:
        return np.argsort(-scores, kind="stable")
    bar = np.partition(scores, n - k)[n - k]
    above = np.flatnonzero(scores > bar)
    chosen = np.concatenate([above, np.flatnonzero(scores == bar)[: k - len(above)]])
    return chosen[np.argsort(-scores[chosen], kind="stable")]


def unit_winners(q_ids: list[int], q_rows: list[list[int]], c_ids: list[int], c_rows: list[list[int]], k: int) -> list[tuple[int, int, int]]:
    """(query id, candidate id, score) of the k best candidates of each query in one unit."""
    order = np.argsort(np.array(c_ids, np.int64), kind="stable")
    ids = np.array(c_ids, np.int64)[order]
    rows = [c_rows[i] for i in order]
    top = max((abs(w) for r in (*q_rows, *rows) for w in (min(r, default=0), max(r, default=0))), default=0)
    dtype = np.int64 if top < SAFE and max(map(len, rows), default=0) <= 2048 else object
    of_candidates = postings(rows, dtype)
    out = []
    for start in range(0, len(q_ids), STRIP):
        some = q_rows[start : start + STRIP]
        scores = np.zeros((len(some), len(rows)), dtype)
        for term, (with_term, weights) in postings(some, dtype).items():
            if term in of_candidates:
                found, own = of_candidates[term]
                if len(found) == len(rows):
                    for q, w in zip(with_term, weights):
                        scores[q] += w * own
                else:
                    for q, w in zip(with_term, weights):
                        scores[q, found] += w * own
        for q, query in enumerate(q_ids[start : start + STRIP]):
            others = np.flatnonzero(ids != query)
            kept = others[best(scores[q, others], k)]
            out += [(query, int(ids[i]), int(scores[q, i])) for i in kept]
    return out


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", weights_col: str = "weights") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of each query with the other rows.

    ``weights_col`` is a long array (position = term); rows where it or the id is null take no part.  A query is
    not its own candidate.  Rows that repeat an id with equal weights count once.  Ties go to the smaller id.
    Vectors of different lengths meet in their common terms; an empty vector scores 0 with all.  An empty table,
    or one without queries, gives no rows.  Scores must fit a long.  Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(id_col).isNotNull() & F.col(weights_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(weights_col).alias("_w"), F.coalesce(is_query, F.lit(False)).alias("_q"))
    rows = rows.groupBy("_id", "_w").agg(F.max("_q").alias("_q"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_q").cast("long")).alias("q")).first()
    q_blocks = max(1, -(-(sizes["q"] or 0) // QUERY_BLOCK))
    c_blocks = max(1, -(-sizes["n"] // CANDIDATE_BLOCK))
    block = lambda n, salt: F.pmod(F.xxhash64("_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.filter("_q").select("_id", "_w", F.lit(True).alias("_as_query"), block(q_blocks, 1).alias("_qb"), every(c_blocks).alias("_cb"))
    candidates = rows.select("_id", "_w", F.lit(False).alias("_as_query"), every(q_blocks).alias("_qb"), block(c_blocks, 2).alias("_cb"))
    units = queries.unionByName(candidates)

    def run(table: pa.Table) -> pa.Table:
        ids, weights, role = (table.column(c).to_pylist() for c in ("_id", "_w", "_as_query"))
        q = [i for i, r in enumerate(role) if r]
        c = [i for i, r in enumerate(role) if not r]
        won = unit_winners([ids[i] for i in q], [weights[i] for i in q], [ids[i] for i in c], [weights[i] for i in c], k)
        return pa.table({name: pa.array([w[n] for w in won], pa.int64()) for n, name in enumerate(("query_id", "vec_id", "score"))})

    winners = units.groupBy("_qb", "_cb").applyInArrow(run, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = winners.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
