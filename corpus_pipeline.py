"""A corpus pipeline of five stages: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor
kept; ``run`` writes each stage's result as Parquet into the shared folder
and reads it again for the next.  All stages but the last return the
columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapix.llm import jaccard_join, mixing, packing, quality, secret_scan
from terrapix.sources.store import materialize, shared_path

MIX_KEEP = 0.8  # budget of the mixing stage, as a share of its input's tokens


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality classifier accepts (score of 0.7 or more).

    Labels come from ``labels`` outside the held-out fold; where none fit the
    documents, no row is rejected.
    """
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = quality.train(quality.training_rows(docs, labels))
    return docs.where(quality.scorer(model)(F.col("text")) >= quality.THRESHOLD)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents linked by a Jaccard similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, secrets replaced by a mark and ``n_chars`` brought up to date."""
    return secret_scan.redact_secrets(docs, shared_path(spark, "llm-ledger"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows sampled so that sources, languages and length bands meet their target weights."""
    mixed = mixing.mix_documents(docs, keep=MIX_KEEP).where("sampled")
    return mixed.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, part, n_tokens, bin_id, capacity, offset) for every piece of every row."""
    return packing.pack_documents(docs.select("doc_id", mixing.word_tokens(F.col("text")).alias("n_tokens")))


STAGES = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("secret_scan", secrets_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

# The classifier, the sampling hash and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
