"""Registered queries of the text operators: name -> (spark, sf_dir) -> DataFrame, and their DuckDB statements."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codebooks, exact_dedup, langid, line_dedup, lm, near_dedup, packing, prefix_counts, resampling, secrets, topk, toxicity, word_bpe
from .common import crc_mod, read_table, written

WORD_VOCAB = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from labelled documents that are not held out."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic").filter(crc_mod(F.col("doc_id"), 5) != 0)
    model = toxicity.fit(toxicity.labelled_sample(docs, labels))
    return toxicity.score(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: counts and digest of the base patterns, and all spans."""
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    base = secrets.of_kind(F.col("spans"), *secrets.BASE_KINDS)
    count = lambda kind: F.size(secrets.of_kind(F.col("spans"), kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.BASE_KINDS), F.sha2(secrets.joined(base), 256).alias("base_sha256"),
                        secrets.joined(F.col("spans")).alias("spans"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and attention model scores of every text, learned from the documents that are not held out."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return lm.score_texts(docs, crc_mod(F.col("doc_id"), 10) == 0, WORD_VOCAB)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of ``documents`` in windows of 4096 tokens."""
    pieces = packing.pack(read_table(spark, sf_dir, "documents", "doc_id", "text"), WORD_VOCAB)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector with all others."""
    vectors = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    weights = vectors.select("vec_id", topk.quantized(F.col("embedding"), 256).alias("weights"))
    return topk.top_k(weights, F.pmod("vec_id", F.lit(50)) == 0, 5)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of ``documents``: the row with the largest doc_id of equal texts stays."""
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the documents that are not held out."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.train(docs.filter(crc_mod(F.col("doc_id"), 4) != 2))
    found = langid.identify(docs, model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "langs", "shares")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text and their decoding, as digests."""
    return word_bpe.encode_digests(read_table(spark, sf_dir, "documents", "doc_id", "text"), WORD_VOCAB)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text from prefix tables, with the longest prefix within 512 tokens."""
    return prefix_counts.token_counts(read_table(spark, sf_dir, "documents", "doc_id", "text"), BYTE_VOCAB, limit=512)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of ``documents``: counts and the digest of what stays."""
    kept = line_dedup.drop_lines(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the word statistics of ``benchmark``."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    drawn = resampling.resample(docs, read_table(spark, sf_dir, "benchmark", "text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of ``embeddings`` with their errors, and the digest of the codebooks."""
    vectors = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    codes, books = codebooks.compress(vectors)
    codes = written(codes, "codebooks-codes")
    of_label = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    rows = codes.join(of_label, F.col("label").eqNullSafe(F.col("_label")))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(codebooks.books_digest(books)).alias("codebooks_sha256"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_secret_scan": op2_secret_scan,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_packing": op4_packing,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_language_id": op7_language_id,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_token_counts": op9_token_counts,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_line_dedup": op11_line_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_vector_codes": op13_vector_codes,
}



def _codes_sql(parts: int = 8, size: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Every round of k-means on the parts of ``embeddings``, each as a table of its own."""
    mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"  # floored, also below zero
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
                               FROM embeddings WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"""p AS MATERIALIZED (SELECT vec_id, label, q AS part, list_slice(w, 1 + q * len(w) // {parts}, (q + 1) * len(w) // {parts}) AS x
                               FROM v, range({parts}) AS t(q))""",
        f"b0 AS MATERIALIZED (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS INTEGER) AS entry, x AS c FROM p QUALIFY entry < {size})",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, label, part, any_value(x) AS x, min(struct_pack(d := d, entry := entry)) AS near
                     FROM (SELECT p.*, entry, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x, c)]) AS BIGINT) AS d
                           FROM p JOIN b{r} USING (part)) GROUP BY vec_id, label, part)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, o.c) AS c FROM b{r} o LEFT JOIN (
                         SELECT part, entry, list({mean} ORDER BY i) AS c FROM (
                             SELECT part, near.entry AS entry, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, 1025) AS t(i)
                             WHERE i <= len(x) GROUP BY ALL) GROUP BY part, entry) m USING (part, entry))""")
    return f"""WITH {", ".join(steps)},
        e AS (SELECT vec_id, label, string_agg(printf('%02x', near.entry), '' ORDER BY part) AS code, CAST(sum(near.d) AS BIGINT) AS error
              FROM a{rounds} GROUP BY vec_id, label),
        l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM e GROUP BY label),
        h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, label_error, codebooks_sha256 FROM e JOIN l ON e.label IS NOT DISTINCT FROM l.label, h"""


ORACLE_SQL = {
    "op5_exact_top_k": """
        WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
                   WHERE embedding IS NOT NULL
                     AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.w, c.w)]) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op6_exact_dedup": """
        WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
                   FROM documents),
             g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h)
        SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, n.h AS text_sha256
        FROM n JOIN g ON n.h = g.h
    """,
    "op11_line_dedup": """
        WITH l AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
             x AS (SELECT doc_id, r, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM l),
             k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
             f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
             m AS (SELECT k.*, coalesce(k.doc_id <> f.first, false) AS lost FROM k LEFT JOIN f ON k.key = f.key)
        SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count_if(lost) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
        FROM m GROUP BY r
    """,
    "op13_vector_codes": _codes_sql(),
}
