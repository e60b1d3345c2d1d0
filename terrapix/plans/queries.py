"""Named end-to-end queries over the driver's tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame computed over
whole tables.  Floating-point outputs are rounded (6 places for
reflectance-scale values, 9 for ratios/areas) so that an independent SQL
engine can be compared value by value; the library functions themselves
never round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapix.functions.paths import path_year as path_year_col
from terrapix.operators import catalog, composite, metrics, model, observe, report, samples, territory
from terrapix.sources import fixtures as fx
from terrapix.sources import sinks, tables
from terrapix.sources.store import shared_path

BANDS = composite.COMPOSITE_BANDS


def rounded(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    """Round every float/double column (or ``only`` these) to ``digits`` places, as double."""
    cols = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and (only is None or f.name in only):
            cols[f.name] = F.round(F.col(f.name).cast("double"), digits)
    return df.withColumns(cols) if cols else df


# ------------------------------------------------------------ composite stage

def q_eligible_obs(spark: SparkSession, sf: str) -> DataFrame:
    return observe.eligible_observations(fx.raw_obs(spark, sf))


def q_spectral_indices(spark: SparkSession, sf: str) -> DataFrame:
    so = observe.spectral_observations(fx.raw_obs(spark, sf))
    # 7 places: reflectances have 7 decimals, so 6 would hit exact rounding ties.
    return rounded(so.select("scene_id", "pixel_id", "year", "sensor", *BANDS), 7)


def q_composite_ndvi(spark: SparkSession, sf: str) -> DataFrame:
    so = observe.spectral_observations(fx.raw_obs(spark, sf))
    return rounded(composite.median_ndvi(so))


def composite_table(spark: SparkSession, sf: str) -> DataFrame:
    return composite.yearly_composite(observe.spectral_observations(fx.raw_obs(spark, sf)))


def q_composite_full(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(composite_table(spark, sf))


# ------------------------------------------------------------ territory stage

def labels_table(spark: SparkSession, sf: str) -> DataFrame:
    return territory.presence_labels(fx.grid(spark, sf), fx.edges(spark, sf))


def q_presence_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labels_table(spark, sf)


# A north-up raster of 30 m pixels in projected coordinates.
RASTER_30M = territory.Raster(x0=500_000.0, y0=4_100_300.0, dx=30.0, dy=-30.0, n_cols=10, n_rows=10)


def q_presence_labels_30m(spark: SparkSession, sf: str) -> DataFrame:
    def x(c: str):
        return F.col(c) * 30.0 + 500_000.0

    def y(c: str):
        return F.lit(4_100_300.0) - F.col(c) * 30.0

    grid = fx.grid(spark, sf).withColumns({"px": x("px"), "py": y("py")})
    edges = fx.edges(spark, sf).withColumns({"x1": x("x1") + 7.0, "x2": x("x2") + 7.0,
                                             "y1": y("y1") - 11.0, "y2": y("y2") - 11.0})
    return territory.presence_labels(grid, edges, RASTER_30M)


def q_territory_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Open rings of the territory fixture, closed and exploded to edges."""
    s = tables.read_table(spark, sf, "supplier", ["s_suppkey"])
    ax, ay = (F.col("s_suppkey") * 3 % 7).cast("double"), (F.col("s_suppkey") * 5 % 7).cast("double")
    ring = F.array(*[F.struct((ax + a).alias("x"), (ay + b).alias("y")) for a, b in ((0.0, 0.0), (4.0, 1.0), (1.0, 4.0))])
    rings = s.select(F.col("s_suppkey").alias("poly_id"), (F.lit(1995) + F.col("s_suppkey") % 28).cast("int").alias("year"),
                     ring.alias("ring"))
    return territory.ring_edges(territory.valid_territories(rings))


def q_presence_labels_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Territories with holes and overlapping parts, burned; archives among the files are left out."""
    parts = territory.valid_parts(fx.territory_parts(spark, sf), skip=".zip")
    return territory.presence_labels(fx.grid(spark, sf), territory.part_edges(parts))


def q_study_area(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(territory.study_area(fx.edges(spark, sf)))


def q_path_year(spark: SparkSession, sf: str) -> DataFrame:
    p = fx.paths(spark, sf)
    return p.select("file_id", "path", path_year_col("path").alias("year"))


def q_path_year_free(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that only the last tier dates, or none."""
    p = fx.free_year_paths(spark, sf)
    return p.select("file_id", "path", path_year_col("path").alias("year"))


def q_imbalance_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.imbalance_by_year(labels_table(spark, sf)))


def q_imbalance_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.imbalance_summary(report.imbalance_by_year(labels_table(spark, sf))))


def q_imbalance_hist(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(report.imbalance_hist(report.imbalance_by_year(labels_table(spark, sf))))


# -------------------------------------------------------------- sample stage

def aligned_table(spark: SparkSession, sf: str) -> DataFrame:
    a = samples.align_pixels(composite_table(spark, sf), labels_table(spark, sf), fx.nlcd(spark, sf))
    return samples.valid_pixels(a)


def q_aligned_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(aligned_table(spark, sf))


def sample_table(spark: SparkSession, sf: str) -> DataFrame:
    return samples.stratified_sample(aligned_table(spark, sf))


def q_stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sample_table(spark, sf))


def q_stratified_sample_capped(spark: SparkSession, sf: str) -> DataFrame:
    """The sampler with a cap that is reached and three negatives for each positive."""
    out = samples.stratified_sample(labels_table(spark, sf), max_pos=5, neg_ratio=3.0, seed=7)
    return out.select("year", "pixel_id", "presence")


def q_samples_written(spark: SparkSession, sf: str) -> DataFrame:
    """Samples written by year and read back with their declared schema, training years only."""
    path = shared_path(spark, "samples")
    sinks.write_samples(labels_table(spark, sf), path)
    schema = "pixel_id int, row_idx int, col_idx int, presence int, year int"
    return tables.read_samples(spark, path, schema).filter(model.in_years("year", model.TRAIN_YEARS))


def q_report_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The yearly imbalance report as CSV, read back."""
    path = shared_path(spark, "report")
    by_year = q_imbalance_by_year(spark, sf)
    sinks.write_csv(by_year, path)
    return spark.read.schema(by_year.schema).option("header", True).csv(path)


def q_sample_totals(spark: SparkSession, sf: str) -> DataFrame:
    return samples.sample_totals(sample_table(spark, sf))


# --------------------------------------------------------- model evaluation

def q_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return model.split_counts(fx.scored(spark, sf))


def q_class_weights(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.scored(spark, sf)
    tr = s.filter(model.in_years("year", model.TRAIN_YEARS))
    return rounded(model.add_class_weight(tr), 9)


def q_roc_auc_exact(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.curve_areas(fx.scored(spark, sf)), 9)


def q_roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.roc_curve(fx.scored(spark, sf)), 9)


def q_roc_curve_compact(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.roc_curve(fx.scored(spark, sf), compact=True), 9)


def q_bounded_sample_check(spark: SparkSession, sf: str) -> DataFrame:
    """The plotting sample of at most about 5,000 rows: from the table, the same each time, near its bound."""
    bound = 5000
    s = fx.scored(spark, sf)
    key = [F.col(c) for c in s.columns]
    draws = [metrics.bounded_sample(s, bound).groupBy(*key).agg(F.count("*").alias(n)) for n in ("n1", "n2")]
    counted = s.groupBy(*key).agg(F.count("*").alias("n")).join(draws[0], s.columns, "full").join(draws[1], s.columns, "full")
    n, n1, n2 = (F.coalesce(F.col(c), F.lit(0)) for c in ("n", "n1", "n2"))
    size = F.sum(n1)
    return counted.agg(F.sum(n).alias("total"), F.every(n1 <= n).alias("subset"), F.every(n1 == n2).alias("repeatable"),
                       (F.abs(size - F.least(F.sum(n), F.lit(bound))) <= 6 * F.sqrt(F.lit(bound))).alias("near_bound"),
                       (F.sum(n) > bound).alias("drawn"))


def q_pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.pr_curve(fx.scored(spark, sf)), 9)


def q_confusion_at_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.confusion(fx.scored(spark, sf), metrics.DEFAULT_THRESHOLD), 9)


def q_prob_histogram(spark: SparkSession, sf: str) -> DataFrame:
    h = metrics.histogram(fx.scored(spark, sf), "prob", metrics.PROB_HIST_BINS, by="presence", density=True)
    return rounded(h, 6)


def q_predictions_written(spark: SparkSession, sf: str) -> DataFrame:
    """Positive-class probabilities taken from a vector, written as predictions and read back."""
    from pyspark.ml.functions import array_to_vector

    path = shared_path(spark, "predictions")
    s = fx.scored(spark, sf)
    vec = s.withColumn("probability", array_to_vector(F.array(1 - F.col("prob"), F.col("prob"))))
    sinks.write_predictions(metrics.scores(vec), path)
    p = spark.read.parquet(path)
    return p.groupBy("true_label", F.round(F.col("predicted_prob").cast("double"), 6).alias("predicted_prob")).agg(
        F.count("*").alias("n"))


# -------------------------------------------------------------- scene catalog

def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.scenes(spark, sf)
    return catalog.union_catalogs(s.filter(F.col("collection") == "A"), s.filter(F.col("collection") == "B"))


def q_aoi_scene_topk(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.least_cloudy(_catalog(spark, sf), fx.aoi(spark, sf), k=catalog.TOP_K)


def q_aoi_scene_count(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.scenes_per_aoi(_catalog(spark, sf), fx.aoi(spark, sf))


# --------------------------------------------------------------- leaderboard

def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return report.flatten_run_metrics(report.parse_run_metrics(fx.trials(spark, sf)))


def q_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return report.leaderboard(_runs(spark, sf), report.LEADERBOARD_TOP_N)


def q_leaderboard_full(spark: SparkSession, sf: str) -> DataFrame:
    return report.leaderboard(_runs(spark, sf), None)


def q_run_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Run documents written as JSON, read back from the files, ranked in full."""
    path = shared_path(spark, "runs")
    sinks.write_metrics(report.good_runs(report.parse_run_metrics(fx.trials(spark, sf))).drop("_corrupt_record"), path)
    runs = sinks.read_run_metrics(spark, path, pattern="*.json", multiline=False)
    return report.leaderboard(report.flatten_run_metrics(runs), None)


def q_run_files(spark: SparkSession, sf: str) -> DataFrame:
    """Run documents in a file each, as printed over several lines, read whole; what is skipped is reported with its reason."""
    path = shared_path(spark, "run-files")
    sinks.write_run_files(fx.run_documents(spark, sf), path)
    runs = sinks.read_run_files(spark, path, pattern="*.txt")
    run_id = F.regexp_extract("source_file", r"run_id=(\d+)/", 1).cast("long")
    return runs.select(run_id.alias("run_id"), "n_bytes", "status", "reason", "app_name", F.col("metrics.val_auc").alias("val_auc"),
                       F.col("metrics.test_auc").alias("test_auc"), F.col("hyperparameters.max_depth").alias("max_depth"))


def q_best_model(spark: SparkSession, sf: str) -> DataFrame:
    return report.best_model(_runs(spark, sf))


# ------------------------------------------------------------ model training


def q_feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Feature stages fitted on the training years, applied to every composite pixel-year; the vector as columns.

    Some bands are blanked and one class occurs in later years only, so that skipped rows and unseen classes show.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    p, y = F.col("pixel_id"), F.col("year")
    rows = (composite_table(spark, sf).join(fx.nlcd(spark, sf), "pixel_id")
            .select("year", "pixel_id", *[F.col(b).cast("double").alias(b) for b in BANDS], "nlcd_class")
            .withColumn("NIR", F.when((p + y) % 17 == 0, F.lit(None)).when((p + y) % 19 == 0, F.lit(float("nan")))
                        .otherwise(F.col("NIR")))
            .withColumn("nlcd_class", F.when((y >= 2016) & (p % 5 == 0), 99).otherwise(F.col("nlcd_class"))))
    fitted = Pipeline(stages=model.feature_stages()).fit(rows.filter(model.in_years("year", model.TRAIN_YEARS)))
    out = fitted.transform(rows).withColumn("f", vector_to_array("features"))
    n = len(BANDS)
    hot = F.array_position(F.slice("f", F.lit(n + 1), F.size("f") - n), F.lit(1.0)).cast("int") - 1
    return rounded(out.select("year", "pixel_id", "nlcd_class", F.col("nlcd_indexed").cast("int").alias("nlcd_indexed"),
                              F.size("f").alias("n_features"), hot.alias("hot"),
                              *[F.col("f")[i].alias(f"f{i}") for i in range(n)]))


def q_train_eval_gbt(spark: SparkSession, sf: str) -> DataFrame:
    return model.train_eval(aligned_table(spark, sf), app_name="gbt_registered")


def q_tuning_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """One model for each distinct set of hyperparameters in the run documents; what they leave out is the published default.

    Areas are reported as whether they exist and lie in [0, 1] (a fit's value has no SQL form), years as text.
    """
    names = list(report.HYPERPARAMETER_NAMES)
    sets = _runs(spark, sf).select(*names).distinct().orderBy(*names).collect()  # configurations, not data
    trials = [{"app_name": f"trial_{i}", **{k: v for k, v in r.asDict().items() if v is not None}}
              for i, r in enumerate(sets)]
    runs = model.tuning_sweep(aligned_table(spark, sf), trials, ledger=shared_path(spark, "sweep"))
    areas = ("val_auc", "val_pr_auc", "test_auc", "test_pr_auc")
    return rounded(runs.select(
        "app_name", "train_samples", "val_samples", "test_samples", "pos_count", "neg_count", "weight_ratio", *names[:2], "num_round",
        *names[2:], *[F.concat_ws(",", F.col(y).cast("array<string>")).alias(y) for y in ("train_years", "val_years", "test_years")],
        *[F.col(a).between(0, 1).alias(f"{a}_found") for a in areas]), 9)


def banded(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows with one feature of at most twenty values, so that every split between two of them is tried."""
    return fx.scored(spark, sf).withColumn("band", F.floor(F.col("prob") * 20).cast("double"))


def _one_split_model(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """A pipeline of one weighted tree with one split, fitted on the training years and saved: (rows, path)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    rows = banded(spark, sf)
    weighted = model.add_class_weight(rows.filter(model.in_years("year", model.TRAIN_YEARS)))
    fitted = Pipeline(stages=[VectorAssembler(inputCols=["band"], outputCol="features"),
                              model.gbt({"maxDepth": 1, "maxIter": 1})]).fit(weighted)
    path = shared_path(spark, "model")
    sinks.save_model(fitted, path)
    return rows, path


def q_one_split_model(spark: SparkSession, sf: str) -> DataFrame:
    """Node table of a saved one-split model: its threshold and leaf values."""
    _, path = _one_split_model(spark, sf)
    nodes = model.tree_nodes(spark, path)
    return rounded(nodes.select("tree", "weight", "node", "feature", "threshold", "left", "right", "prediction", "n_rows"), 9)


def q_node_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Validation rows scored by joins on the saved model's nodes, by their score."""
    from pyspark.ml.feature import VectorAssembler

    rows, path = _one_split_model(spark, sf)
    val = VectorAssembler(inputCols=["band"], outputCol="features").transform(rows.filter(model.in_years("year", model.VAL_YEARS)))
    scored = model.node_scores(val, model.tree_nodes(spark, path))
    return scored.groupBy("band", F.round("prob", 9).alias("prob")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("presence") == 1, 1)).alias("positives"))


def q_saved_model_eval(spark: SparkSession, sf: str) -> DataFrame:
    """The saved model loaded again and evaluated on later years."""
    rows, path = _one_split_model(spark, sf)
    out = model.evaluate_saved(spark, path, rows, "2019-2023")
    return rounded(out.select(F.concat_ws(",", F.col("eval_years").cast("array<string>")).alias("eval_years"), "total_samples",
                              "eval_samples", "pos_count", "neg_count", "class_ratio", "roc_auc", "pr_auc"), 9)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "eligible_obs": q_eligible_obs,
    "spectral_indices": q_spectral_indices,
    "composite_ndvi": q_composite_ndvi,
    "composite_full": q_composite_full,
    "presence_labels": q_presence_labels,
    "presence_labels_30m": q_presence_labels_30m,
    "presence_labels_parts": q_presence_labels_parts,
    "territory_rings": q_territory_rings,
    "study_area": q_study_area,
    "path_year": q_path_year,
    "path_year_free": q_path_year_free,
    "imbalance_by_year": q_imbalance_by_year,
    "imbalance_summary": q_imbalance_summary,
    "imbalance_hist": q_imbalance_hist,
    "aligned_pixels": q_aligned_pixels,
    "stratified_sample": q_stratified_sample,
    "stratified_sample_capped": q_stratified_sample_capped,
    "samples_written": q_samples_written,
    "report_csv": q_report_csv,
    "sample_totals": q_sample_totals,
    "split_counts": q_split_counts,
    "class_weights": q_class_weights,
    "roc_auc_exact": q_roc_auc_exact,
    "roc_curve": q_roc_curve,
    "roc_curve_compact": q_roc_curve_compact,
    "pr_curve": q_pr_curve,
    "bounded_sample_check": q_bounded_sample_check,
    "confusion_at_threshold": q_confusion_at_threshold,
    "prob_histogram": q_prob_histogram,
    "predictions_written": q_predictions_written,
    "aoi_scene_topk": q_aoi_scene_topk,
    "aoi_scene_count": q_aoi_scene_count,
    "leaderboard": q_leaderboard,
    "leaderboard_full": q_leaderboard_full,
    "run_documents": q_run_documents,
    "run_files": q_run_files,
    "best_model": q_best_model,
    "feature_rows": q_feature_rows,
    "train_eval_gbt": q_train_eval_gbt,
    "tuning_sweep": q_tuning_sweep,
    "one_split_model": q_one_split_model,
    "node_scores": q_node_scores,
    "saved_model_eval": q_saved_model_eval,
}
