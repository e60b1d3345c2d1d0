"""Reports: class imbalance per year, run-metrics leaderboard."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapix.functions.spectral import safe_div
from terrapix.operators.metrics import small_histogram
from terrapix.operators.prefix import running_totals

# ---------------------------------------------------------------------------
# Published report layout.
# ---------------------------------------------------------------------------
IMBALANCE_HIST_BINS = 15
LEADERBOARD_TOP_N = 10
METRIC_NAMES = ("val_auc", "val_pr_auc", "test_auc", "test_pr_auc")
HYPERPARAMETER_NAMES = ("max_depth", "eta", "subsample", "colsample_bytree",
                        "min_child_weight", "reg_lambda", "reg_alpha")
DISPLAY_COLUMNS = ("app_name", "val_auc", "test_auc", "val_pr_auc", "test_pr_auc", "max_depth", "eta",
                   "subsample", "colsample_bytree", "min_child_weight", "reg_lambda")
# ---------------------------------------------------------------------------

# Whole numbers may be written with a fraction (8.0), so all are read as doubles.
WHOLE_HYPERPARAMETERS = ("max_depth",)

RUN_METRICS_SCHEMA = T.StructType([
    T.StructField("config_path", T.StringType()),
    T.StructField("app_name", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("model_output_path", T.StringType()),
    T.StructField("samples_path", T.StringType()),
    T.StructField("dataset_info", T.StructType([
        T.StructField("train_samples", T.LongType()), T.StructField("val_samples", T.LongType()),
        T.StructField("test_samples", T.LongType()),
        T.StructField("train_years", T.ArrayType(T.IntegerType())),
        T.StructField("val_years", T.ArrayType(T.IntegerType())),
        T.StructField("test_years", T.ArrayType(T.IntegerType())),
        T.StructField("pos_count", T.LongType()), T.StructField("neg_count", T.LongType()),
        T.StructField("weight_ratio", T.DoubleType()),
    ])),
    T.StructField("hyperparameters", T.StructType(
        [T.StructField(h, T.DoubleType()) for h in HYPERPARAMETER_NAMES])),
    T.StructField("metrics", T.StructType([T.StructField(m, T.DoubleType()) for m in METRIC_NAMES])),
    T.StructField("_corrupt_record", T.StringType()),
])


# ----------------------------------------------------------------- imbalance

def imbalance_by_year(labels: DataFrame) -> DataFrame:
    """Per year: total / positive / negative / nodata pixels, percentages,
    neg:pos ratio (infinity without positives) and raster width / height.
    One aggregate over the label rows (partial counts before the shuffle)."""
    c = labels.groupBy("year").agg(
        F.count("*").alias("total_pixels"),
        F.count(F.when(F.col("presence") == 1, 1)).alias("positive_pixels"),
        F.count(F.when(F.col("presence") == 0, 1)).alias("negative_pixels"),
        (F.max("col_idx") + 1).alias("width"),
        (F.max("row_idx") + 1).alias("height"))
    return imbalance_from_counts(c)


def imbalance_from_counts(c: DataFrame) -> DataFrame:
    """Percentages and ratio from per-year counts
    (``year total_pixels positive_pixels negative_pixels width height``)."""
    tot = F.col("total_pixels").cast("double")
    pos = F.col("positive_pixels").cast("double")
    neg = F.col("negative_pixels").cast("double")
    return c.select(
        "year", "total_pixels", "positive_pixels", "negative_pixels",
        (F.col("total_pixels") - F.col("positive_pixels") - F.col("negative_pixels")).alias("nodata_pixels"),
        (safe_div(pos, tot) * 100.0).alias("positive_pct"),
        (safe_div(neg, tot) * 100.0).alias("negative_pct"),
        F.when(pos > 0, neg / pos).otherwise(F.lit(float("inf"))).alias("imbalance_ratio"),
        F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"),
    )


def imbalance_summary(by_year: DataFrame) -> DataFrame:
    """Cross-year summary (one row): year count, means (mean of yearly ratios),
    min / max positive % with its year (earliest year on ties), totals."""
    lo = F.min(F.struct(F.col("positive_pct"), F.col("year")))
    hi = F.max(F.struct(F.col("positive_pct"), (-F.col("year")).alias("ny")))
    return by_year.agg(
        F.count("*").alias("n_years"),
        F.avg(F.col("positive_pixels").cast("double")).alias("mean_positive_pixels"),
        F.avg("positive_pct").alias("mean_positive_pct"),
        F.avg("imbalance_ratio").alias("mean_imbalance_ratio"),
        lo.alias("_lo"), hi.alias("_hi"),
        F.sum("positive_pixels").cast("long").alias("total_positive_pixels"),
        F.sum("negative_pixels").cast("long").alias("total_negative_pixels"),
    ).select(
        "n_years", "mean_positive_pixels", "mean_positive_pct", "mean_imbalance_ratio",
        F.col("_lo.positive_pct").alias("min_positive_pct"), F.col("_lo.year").alias("min_positive_year"),
        F.col("_hi.positive_pct").alias("max_positive_pct"), (-F.col("_hi.ny")).alias("max_positive_year"),
        "total_positive_pixels", "total_negative_pixels",
    )


def imbalance_hist(by_year: DataFrame, bins: int = IMBALANCE_HIST_BINS) -> DataFrame:
    """Histogram of yearly positive percentages (all bins, also empty).

    The table has a row for each calendar year, so its values fit one row, and
    the labels behind it are evaluated once for the range and the bins.
    """
    return small_histogram(by_year, "positive_pct", bins)


# --------------------------------------------------------------- run metrics

def parse_run_metrics(docs: DataFrame, col: str = "js") -> DataFrame:
    """Parse run-metrics JSON text; malformed documents keep ``_corrupt_record``."""
    parsed = F.from_json(col, RUN_METRICS_SCHEMA,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return docs.select(parsed.alias("m")).select("m.*")


def good_runs(runs: DataFrame) -> DataFrame:
    """Run documents that are JSON at all.

    A document with a field of another type keeps its other fields (that one
    is null) and is still listed by ``unreadable_runs``.
    """
    parsed = [F.col(f.name).isNotNull() for f in RUN_METRICS_SCHEMA.fields if f.name != "_corrupt_record"]
    return runs.filter(reduce(or_, parsed, F.col("_corrupt_record").isNull()))


def flatten_run_metrics(runs: DataFrame) -> DataFrame:
    """One flat leaderboard row per run: name (``'unknown'`` when absent),
    four metrics (NULL when absent or NaN) and seven hyperparameters (NULL when absent)."""
    def number(c: str) -> Column:
        return F.when(~F.isnan(c), F.col(c))

    return good_runs(runs).select(
        F.coalesce(F.col("app_name"), F.lit("unknown")).alias("app_name"),
        *[number(f"metrics.{m}").alias(m) for m in METRIC_NAMES],
        *[F.col(f"hyperparameters.{h}").cast("long" if h in WHOLE_HYPERPARAMETERS else "double").alias(h)
          for h in HYPERPARAMETER_NAMES],
    )


def leaderboard(flat: DataFrame, top_n: int | None = LEADERBOARD_TOP_N,
                columns=DISPLAY_COLUMNS) -> DataFrame:
    """Runs by validation AUC, best first (NULLs last), ties by name, with their ``rank``.

    ``top_n`` rows of the display columns (``TakeOrderedAndProject``: a
    per-partition top-n, then a merge of n rows per partition), or all runs,
    ranked by running totals.
    """
    order = [F.col("val_auc").desc_nulls_last(), F.col("app_name").asc()]
    shown = [c for c in columns if c in flat.columns]
    if top_n is not None:
        out = flat.orderBy(*order).limit(int(top_n))
        return out.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), *shown)
    ranked = running_totals(flat, [], order, {"rank": F.lit(1)})
    return ranked.orderBy("cum_rank").select(F.col("cum_rank").alias("rank"), *shown)


def best_model(flat: DataFrame) -> DataFrame:
    """Best run by validation AUC (with its other metrics) and, separately,
    the best test AUC over all runs.  One global aggregate; the winner is the
    leaderboard's first row (NULL AUCs last, ties by name)."""
    order = F.struct(F.col("val_auc").isNull().alias("nul"), (-F.col("val_auc")).alias("neg"),
                     F.col("app_name"))
    best = F.min_by(F.struct(*[F.col(c) for c in ("app_name", *METRIC_NAMES)]), order)
    return flat.agg(F.count("*").alias("n_models"), best.alias("b"),
                    F.max("test_auc").alias("max_test_auc")).select(
        "n_models",
        F.col("b.app_name").alias("best_app_name"),
        *[F.col(f"b.{m}").alias(f"best_{m}") for m in METRIC_NAMES],
        "max_test_auc")
