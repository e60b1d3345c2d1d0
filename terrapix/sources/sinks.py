"""Sinks and dataset readers with declared schemas.

Every writer writes the distributed rows directly (no driver round trip).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapix.operators.report import RUN_METRICS_SCHEMA, good_runs

# A small file costs its opening, not its bytes, by which Spark sizes tasks: documents written by one task, a file each,
# and the scan's tasks that one task of ``read_run_files`` takes over.
RUN_FILES_WRITTEN = 100
RUN_SCANS_MERGED = 32


def write_samples(df: DataFrame, path: str) -> None:
    """Training samples as Parquet, one directory per year.

    Dynamic partition overwrite replaces only the years present in ``df``,
    so one year can be rebuilt without touching the others.  Rows are brought
    together by year first, by a rebalance that adaptive execution cuts where a
    year is large and merges where years are small: a year has about its
    bytes over the advised partition size files, not one from every task.
    """
    (df.hint("rebalance", F.col("year")).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic")
       .partitionBy("year")
       .parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line (one file per partition)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Run-metrics rows as JSON lines (nested structs and year arrays kept)."""
    df.write.mode("overwrite").json(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Prediction rows as Parquet, overwriting."""
    df.write.mode("overwrite").parquet(path)


def write_run_files(docs: DataFrame, path: str, key: str = "run_id") -> None:
    """Run documents (``key`` and one text column) as text, in a file each: ``path/key=.../part-*.txt``.

    The tasks follow the number of documents, and a key's rows come together in one
    task: its file is the same however the input is split.
    """
    tasks = max(1, math.ceil(docs.count() / RUN_FILES_WRITTEN))
    docs.repartition(tasks, key).write.partitionBy(key).text(path)


def read_run_metrics(spark: SparkSession, path: str, pattern: str = "*_metrics.json",
                     multiline: bool = True) -> DataFrame:
    """All run-metrics documents under ``path`` whose file name matches ``pattern``.

    Pretty-printed documents need ``multiline``.  Unreadable files are kept
    with ``_corrupt_record`` set and their ``source_file`` (see
    ``unreadable_runs``); ``good_runs`` drops them.
    """
    return (spark.read.schema(RUN_METRICS_SCHEMA)
            .option("multiLine", multiline)
            .option("pathGlobFilter", pattern)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .json(path)
            .withColumn("source_file", F.input_file_name()))


def read_run_files(spark: SparkSession, path: str, pattern: str = "*_metrics.json") -> DataFrame:
    """One row for each file under ``path`` whose name matches ``pattern``, read whole: ``source_file``, ``n_bytes``,
    the parsed fields, and ``status`` with the ``reason`` why a file is to be skipped.

    Files of any layout are read (pretty-printed ones too).  ``skipped`` are
    files that are not JSON (cut off, blank, not UTF-8) or no object; ``partial`` ones
    are objects with a field of another type, which is null here; the rest is ``read``.
    A file of no bytes has no row: Spark's listing leaves such files out.
    Spark opens only a few small files in a task; their tasks are merged, without a shuffle, to
    some for each core and more where there are very many files.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    tasks = max(8 * spark.sparkContext.defaultParallelism, math.ceil(found.rdd.getNumPartitions() / RUN_SCANS_MERGED))
    files = (found.coalesce(tasks)
             .select(F.col("path").alias("source_file"), F.col("length").alias("n_bytes"),
                     F.try_validate_utf8(F.col("content").cast("string")).alias("value")))
    parsed = F.from_json("value", RUN_METRICS_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    # A document of any kind, with its leaves as text: null where the text is no JSON.
    kind = F.expr("try_variant_get(try_parse_json(value), '$', 'variant')")
    is_object = F.expr("schema_of_variant(try_parse_json(value)) like 'OBJECT%'")
    reason = (F.when(kind.isNull(), "not JSON").when(~is_object, "not an object")
              .when(F.col("m._corrupt_record").isNotNull(), "a field of another type"))
    fields = [f.name for f in RUN_METRICS_SCHEMA.fields if f.name != "_corrupt_record"]
    status = (F.when(F.col("reason").isNull(), "read").when(F.col("reason") == "a field of another type", "partial")
              .otherwise("skipped"))
    return (files.withColumn("m", parsed).withColumn("reason", reason).withColumn("status", status)
            .select("source_file", "n_bytes", "status", "reason", *[F.col(f"m.{f}").alias(f) for f in fields]))


def unreadable_runs(runs: DataFrame) -> DataFrame:
    """Files that were not parsed in full (to report): not JSON, or a field of another type."""
    # A pruned field is not parsed, so all are named here for their faults to show.
    fields = [f.name for f in RUN_METRICS_SCHEMA.fields if f.name != "_corrupt_record"]
    parsed = F.coalesce(F.length(F.to_json(F.struct(*fields))), F.lit(0)) >= 0
    return runs.filter(F.col("_corrupt_record").isNotNull() & parsed).select("source_file")


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


__all__ = ["good_runs", "load_model", "read_run_files", "read_run_metrics", "save_model", "unreadable_runs", "write_csv",
           "write_metrics", "write_predictions", "write_run_files", "write_samples"]
