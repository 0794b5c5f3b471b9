"""The queries of this subpackage: one for each operator, over its whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import bpe, capfilter, interp, licences, lines, negatives, packing, pieces, pii, quality_net, rules, runs, simhash


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, 64 bits, links at 3 or fewer differing bits."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at a cosine of 0.98 or more within a label."""
    return capfilter.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids by the public 50k ranks, and of what they decode to."""
    return bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of quality label 1, learned on four folds of five."""
    return quality_net.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in ten documents or more go."""
    out = lines.drop_frequent_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, log-likelihood ratio and verdict."""
    out = rules.quality_rules(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    return out.drop("text")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities by the interpolated model and by the base one."""
    return interp.score(_read(spark, sf_dir, "documents"))


def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans."""
    return pii.digests(pii.private_spans(_read(spark, sf_dir, "documents")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document."""
    return licences.scan(_read(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every document, those that the contract plants among them."""
    return runs.digests(runs.periodic_runs(runs.with_planted_runs(_read(spark, sf_dir, "documents"))))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids by the public 32k model, of what they decode to, and of their byte spans."""
    return pieces.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives within the window of each of five positives of every fiftieth vector."""
    return negatives.hard_negatives(negatives.prepared(_read(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_embedding_near_dedup, op3_byte_bpe, op4_quality_classifier, op5_line_dedup, op6_quality_rules, op7_lm_scoring, op8_private_data, op9_best_fit_packing, op10_licence_scan, op11_periodic_runs, op12_sentence_pieces, op13_hard_negatives)}

ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
),
frequent AS (SELECT key AS hot FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(hot)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent ON key = hot GROUP BY doc_id
""",
    "op13_hard_negatives": """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM fine a JOIN fine b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
""",
}
