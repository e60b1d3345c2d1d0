"""The registered queries of this subpackage, each over its whole table, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapix.llm import (context_tree, filter_audit, fingerprint, jaccard_join, mixing, packing, periodic_runs, quality,
                          secret_scan, substring_dedup, token_store, topk, url_filter)
from terrapix.llm.oracle import ORACLE_SQL  # noqa: F401
from terrapix.sources.store import shared_path

URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
             ("net/es/", "block"), ("net/fr/", "block"))


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", "text")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return (jaccard_join.jaccard_links(documents(spark, sf))
            .select("doc_id", "class_id", "text_id", "copies", "n_links"))


def op2_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "rule string, verdict string")
    pages = read(spark, sf, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return (substring_dedup.remove_repeats(documents(spark, sf))
            .select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def op4_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.scan_versions(documents(spark, sf), shared_path(spark, "llm-ledger"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    spans = secret_scan.span_string(F.col("spans"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op5_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", mixing.word_tokens(F.col("text")).alias("n_tokens"))
    return packing.pack_documents(docs)


def op6_token_store(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "llm-tokens")
    token_store.write_shards(documents(spark, sf), path, tokenizer_path())
    return token_store.document_tokens(spark, path)


def op7_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.nearest(documents(spark, sf))


def op8_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf, "documents").select("doc_id", "text", "lang", "source"), with_row=False)


def op9_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    model = quality.train(quality.training_rows(docs, read(spark, sf, "labels")))
    score = quality.scorer(model)
    return (docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int")))


def op10_threshold_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read(spark, sf, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.pmod(F.col("vec_id"), F.lit(20)) == 0)


def op11_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit_filters(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op12_context_tree(spark: SparkSession, sf: str) -> DataFrame:
    return context_tree.score_documents(documents(spark, sf))


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periodic_runs.periodic_runs(documents(spark, sf), loop=True)


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_url_filter, op3_suffix_dedup, op4_secret_scan, op5_best_fit_packing, op6_token_store,
    op7_document_fingerprints, op8_source_mixing, op9_quality_classifier, op10_threshold_topk, op11_filter_audit,
    op12_context_tree, op13_periodic_runs)}
