"""A training corpus from raw documents: quality rules, line dedup, near-duplicates, private data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and but for the last returns the columns
of documents. Results are written as Parquet between stages.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import lines, packing, pii, rules, simhash
from tracemill.llm.store import scratch, stored

#: Not in SQL: hashed n-gram models, fingerprints and tokenizers have no DuckDB twin.
ORACLE_SQL = None
TOKENIZER = "byte_bpe_50k.json"


def _wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns in one, so that none clashes with those that an operator adds."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that fail the base rules or the log-likelihood ratio go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.quality_rules(_wrapped(docs), labels).where("kept").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines in ten documents or more go; a document that loses all its lines goes too."""
    kept = lines.drop_frequent_lines(_wrapped(docs), min_docs=10).where("n_dropped = 0 or n_dropped < n_lines")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return kept.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 on five-word shingles of a Jaccard similarity of 0.8 or more; the smallest doc_id of a group stays.

    At 0.8 two sets have a cosine of 8/9, and 19 of 128 bits differ on average, seldom over 30. Rows without a doc_id can't
    stand for a group and stay, copies of them once.
    """
    groups = simhash.near_duplicates(docs.select("doc_id", "text"), words=5, bits=128, radius=30, keys=simhash.two_segment_keys, similarity=0.8)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    rows = _wrapped(docs)
    some = rows.join(first, "doc_id", "left_semi").unionByName(rows.where("doc_id is null"))
    return some.dropDuplicates(["doc_id", "text"]).select("_row.*")


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: every span is replaced by its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: every document's pieces with their sequence and place."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), 2048)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("private_data", private_data), ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the written result of the one before; what a stage stored for itself goes when it is done."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = stored(stage(spark, docs, sf_dir), name)
            keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
