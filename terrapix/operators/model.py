"""Feature pipeline, weighted gradient-boosted trees, temporal evaluation, sweeps."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapix.functions.years import TEST_YEARS, TRAIN_YEARS, VAL_YEARS, in_years, split_label, year_list
from terrapix.operators.composite import COMPOSITE_BANDS
from terrapix.operators.metrics import curve_areas
from terrapix.operators.prefix import literal_rows
from terrapix.sources.store import discard, materialize

# ---------------------------------------------------------------------------
# Published model settings.
# ---------------------------------------------------------------------------
NUMERIC_FEATURES = COMPOSITE_BANDS  # BLUE GREEN RED NIR SWIR1 SWIR2 NDVI EVI NDWI NBR BSI NDSI
GBT_DEFAULTS = {"maxDepth": 10, "maxIter": 100, "stepSize": 0.1, "seed": 42}
# ---------------------------------------------------------------------------

PART_BYTES = 16 << 20     # of a shared feature table: bytes in one partition
MAX_CONCURRENT = 8        # fits at one time
MAX_BROADCAST_NODES = 1_000_000  # tree nodes that are sent to all tasks; more are joined by shuffles

# Config names of the second trainer mapped onto GBTClassifier parameters.
TRIAL_PARAM_MAP = {
    "max_depth": "maxDepth",
    "eta": "stepSize",
    "subsample": "subsamplingRate",
    "num_round": "maxIter",
    "min_child_weight": "minInstancesPerNode",
    "gamma": "minInfoGain",
}


def split_counts(df: DataFrame, train=TRAIN_YEARS, val=VAL_YEARS, test=TEST_YEARS) -> DataFrame:
    """Rows per (split, class) in one aggregate, instead of one count job each."""
    return (df.select(split_label("year", train, val, test).alias("split"), "presence")
            .filter(F.col("split").isNotNull())
            .groupBy("split", "presence").agg(F.count("*").alias("n")))


def weight_ratio(train: DataFrame):
    """neg/pos over the training rows (1.0 without positives), as a scalar
    subquery Column: evaluated once on the cluster, no join, no driver trip."""
    c = train.agg(F.count(F.when(F.col("presence") == 1, 1)).alias("p"),
                  F.count(F.when(F.col("presence") == 0, 1)).alias("n"))
    return c.select(F.when(F.col("p") > 0, F.col("n").cast("double") / F.col("p"))
                    .otherwise(F.lit(1.0)).alias("ratio")).scalar()


def add_class_weight(train: DataFrame, col: str = "weight") -> DataFrame:
    """Positives weigh neg/pos, negatives 1.0."""
    return train.withColumn(col, F.when(F.col("presence") == 1, weight_ratio(train)).otherwise(F.lit(1.0)))


def feature_stages(numeric=NUMERIC_FEATURES) -> list:
    """Land cover indexed (unseen kept) and one-hot encoded (last slot dropped),
    assembled with the numeric features; rows with NULL/NaN are skipped."""
    return [
        StringIndexer(inputCol="nlcd_class", outputCol="nlcd_indexed", handleInvalid="keep"),
        OneHotEncoder(inputCols=["nlcd_indexed"], outputCols=["nlcd_encoded"], dropLast=True),
        VectorAssembler(inputCols=[*numeric, "nlcd_encoded"], outputCol="features", handleInvalid="skip"),
    ]


def gbt(params: dict | None = None) -> GBTClassifier:
    """Weighted GBT classifier; ``params`` use GBTClassifier names."""
    p = {**GBT_DEFAULTS, **(params or {})}
    return GBTClassifier(labelCol="presence", featuresCol="features", weightCol="weight", **p)


def trial_params(trial: dict) -> dict:
    """Map a trial config (second trainer's names) to GBTClassifier params.

    ``colsample_bytree`` becomes a fractional ``featureSubsetStrategy``;
    ``reg_lambda`` / ``reg_alpha`` / ``missing`` have no equivalent and are
    ignored; the run row records the first two as given.
    """
    out = {}
    for k, v in trial.items():
        if v is None:
            continue
        if k in TRIAL_PARAM_MAP:
            name = TRIAL_PARAM_MAP[k]
            out[name] = int(v) if name in ("maxDepth", "maxIter", "minInstancesPerNode") else float(v)
        elif k == "colsample_bytree":
            out["featureSubsetStrategy"] = "all" if float(v) >= 1.0 else str(float(v))
    if "minInstancesPerNode" in out:
        out["minInstancesPerNode"] = max(1, out["minInstancesPerNode"])
    return out


def train(df: DataFrame, params: dict | None = None, train_years=TRAIN_YEARS) -> PipelineModel:
    """Fit the feature pipeline + weighted GBT on the training years."""
    tr = add_class_weight(df.filter(in_years("year", train_years)))
    return Pipeline(stages=[*feature_stages(), gbt(params)]).fit(tr)


def positive_probability(pred: DataFrame) -> DataFrame:
    """``prob`` = P(class 1) from the model's probability vector (built-in, no UDF)."""
    return pred.withColumn("prob", vector_to_array("probability")[1])


def evaluate(model: PipelineModel, df: DataFrame) -> DataFrame:
    """One-row exact ROC / PR areas of ``model`` on ``df`` (all rows)."""
    return curve_areas(positive_probability(model.transform(df)), "presence", "prob")


EVAL_SCHEMA = T.StructType([
    T.StructField("model_path", T.StringType()), T.StructField("eval_years", T.ArrayType(T.IntegerType())),
    T.StructField("timestamp", T.StringType()),
    T.StructField("total_samples", T.LongType()), T.StructField("eval_samples", T.LongType()),
    T.StructField("pos_count", T.LongType()), T.StructField("neg_count", T.LongType()),
    T.StructField("class_ratio", T.DoubleType()),
    T.StructField("roc_auc", T.DoubleType()), T.StructField("pr_auc", T.DoubleType()),
])


def evaluate_saved(spark, model_path: str, samples: DataFrame, years) -> DataFrame:
    """Load a saved pipeline, score the given years, return one metrics row.

    Counts come from one conditional aggregate (the published script runs
    four separate count jobs); ``class_ratio`` is NULL without positives.
    """
    model = PipelineModel.load(model_path)
    ys = year_list(years)
    sel = in_years("year", ys)
    c = samples.agg(F.count("*").alias("total"), F.count(F.when(sel, 1)).alias("ev"),
                    F.count(F.when(sel & (F.col("presence") == 1), 1)).alias("pos"),
                    F.count(F.when(sel & (F.col("presence") == 0), 1)).alias("neg")).first()
    areas = evaluate(model, samples.filter(sel)).first()
    row = (model_path, ys, datetime.now(timezone.utc).isoformat(), c["total"], c["ev"], c["pos"], c["neg"],
           (c["neg"] / c["pos"]) if c["pos"] else None, areas["roc_auc"], areas["pr_auc"])
    return literal_rows(spark, [row], EVAL_SCHEMA)


RUN_SCHEMA = T.StructType([
    T.StructField("app_name", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("train_samples", T.LongType()), T.StructField("val_samples", T.LongType()),
    T.StructField("test_samples", T.LongType()),
    T.StructField("pos_count", T.LongType()), T.StructField("neg_count", T.LongType()),
    T.StructField("weight_ratio", T.DoubleType()),
    T.StructField("max_depth", T.LongType()), T.StructField("eta", T.DoubleType()),
    T.StructField("num_round", T.LongType()),
    *[T.StructField(h, T.DoubleType()) for h in ("subsample", "colsample_bytree", "min_child_weight", "reg_lambda", "reg_alpha")],
    *[T.StructField(f"{s}_years", T.ArrayType(T.IntegerType())) for s in ("train", "val", "test")],
    T.StructField("model_output_path", T.StringType()),
    T.StructField("val_auc", T.DoubleType()), T.StructField("val_pr_auc", T.DoubleType()),
    T.StructField("test_auc", T.DoubleType()), T.StructField("test_pr_auc", T.DoubleType()),
])


def recorded(trial: dict, native: bool) -> list[float | None]:
    """The other hyperparameters of a trial as given, whether the trainer has them or not; null where not given."""
    subsample = trial.get("subsamplingRate" if native else "subsample")
    child = trial.get("minInstancesPerNode" if native else "min_child_weight")
    rest = [None if native else trial.get(h) for h in ("colsample_bytree", "reg_lambda", "reg_alpha")]
    return [None if v is None else float(v) for v in (subsample, rest[0], child, *rest[1:])]


def run_documents(runs: DataFrame, config_path: str | None = None, samples_path: str | None = None) -> DataFrame:
    """Run rows as nested run documents: what ``write_metrics`` writes and ``read_run_metrics`` reads."""
    def part(names: list[str]):
        return F.struct(*[F.col(n) for n in names])

    return runs.select(
        F.lit(config_path).cast("string").alias("config_path"), "app_name", "timestamp", "model_output_path",
        F.lit(samples_path).cast("string").alias("samples_path"),
        part(["train_samples", "val_samples", "test_samples", "train_years", "val_years", "test_years",
              "pos_count", "neg_count", "weight_ratio"]).alias("dataset_info"),
        part(["max_depth", "eta", "num_round", "subsample", "colsample_bytree", "min_child_weight", "reg_lambda",
              "reg_alpha"]).alias("hyperparameters"),
        part(["val_auc", "val_pr_auc", "test_auc", "test_pr_auc"]).alias("metrics"))


def train_eval(df: DataFrame, params: dict | None = None, app_name: str = "gbt",
               train_years=TRAIN_YEARS, val_years=VAL_YEARS, test_years=TEST_YEARS,
               model_path: str | None = None) -> DataFrame:
    """Fit on the training years, score validation and test, return one run row."""
    return tuning_sweep(df, [{"app_name": app_name, **(params or {})}], train_years, val_years, test_years,
                        native=True, model_path=model_path)


def trial_key(trial: dict, years: Iterable, data: Iterable) -> str:
    """A name for one run: its configuration, its years and a fingerprint of the rows it was trained on."""
    named = {k: v for k, v in trial.items() if v is not None}
    return hashlib.sha256(json.dumps([named, [str(y) for y in years], [str(d) for d in data]], sort_keys=True).encode()).hexdigest()[:24]


def read_ledger(spark, ledger: str) -> dict[str, dict]:
    """The finished runs of a ledger by their key: one row for each trial ever finished there."""
    schema = T.StructType([T.StructField("run_key", T.StringType()), *RUN_SCHEMA.fields])
    try:
        rows = spark.read.schema(schema).json(f"{ledger.rstrip('/')}/run-*").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise
    return {r["run_key"]: r.asDict() for r in rows}


def table_parts(n_rows: int, n_features: int) -> int:
    """Partitions of a feature table: by its size, one for a small table, whose trees are bound by the number of tasks."""
    return max(1, -(-n_rows * (8 * n_features + 64) // PART_BYTES))


def tuning_sweep(df: DataFrame, trials: list[dict], train_years=TRAIN_YEARS, val_years=VAL_YEARS,
                 test_years=TEST_YEARS, native: bool = False, model_path: str | None = None,
                 ledger: str | None = None) -> DataFrame:
    """Fit and score one model per trial on a shared, materialised feature table, one run row each in the trials' order.

    The land-cover indexer / encoder / assembler are fitted once and the
    assembled splits are written once to the checkpoint folder, in partitions
    by size.  Fits are driven by threads, each in a FAIR pool of its own (where
    the session schedules fairly), so that the small jobs of one trial's trees
    do not wait for another's; every fit and scoring is a Spark job over the
    shared table.  ``trials`` use the second trainer's names (``max_depth``,
    ``eta``, ...) unless ``native`` (GBTClassifier names).  A run that ends is
    written to ``ledger`` at once, a folder that the cluster shares; a sweep
    that starts again with the same rows takes finished runs from there.
    """
    spark = df.sparkSession
    split = split_label("year", train_years, val_years, test_years)
    # Materialise the split rows once: counts, feature fit and assembly all read them.
    rows = materialize(df.withColumn("split", split).filter(F.col("split").isNotNull()), "split-rows")
    print_of = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(rows.columns)]).cast("decimal(38,0)"))
    cnt, prints = {}, []
    for r in (rows.groupBy("split", "presence").agg(F.count("*").alias("n"), print_of.alias("p"))
              .orderBy("split", "presence").collect()):  # <= 6 rows
        cnt[r["split"], r["presence"]] = r["n"]
        prints.append((r["split"], r["presence"], r["n"], r["p"]))
    pos, neg = cnt.get(("train", 1), 0), cnt.get(("train", 0), 0)
    ratio = neg / pos if pos > 0 else 1.0
    years = [year_list(y) for y in (train_years, val_years, test_years)]
    keys = [trial_key({**t, "native": native, "model_path": model_path}, years, prints) for t in trials]
    finished = read_ledger(spark, ledger) if ledger else {}
    todo = [i for i, k in enumerate(keys) if k not in finished]
    weighted = rows.withColumn("weight", F.when(F.col("presence") == 1, F.lit(ratio)).otherwise(F.lit(1.0)))
    if todo:
        feats = Pipeline(stages=feature_stages()).fit(weighted.filter(F.col("split") == "train"))
        n_features = len(NUMERIC_FEATURES) + len(feats.stages[0].labels)
        parts = table_parts(sum(cnt.values()), n_features)
        assembled = materialize(feats.transform(weighted).select("split", "year", "presence", "weight", "features")
                                .repartition(parts), "features")
        train_df = assembled.filter(F.col("split") == "train")
        scored_df = assembled.filter(F.col("split").isin("val", "test"))

    def run(i: int) -> tuple:
        t = dict(trials[i])
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{i}")
        name = t.pop("app_name", "trial")
        params = dict(t) if native else trial_params(t)
        model = gbt({"cacheNodeIds": parts > 1, **params}).fit(train_df)
        if model_path:
            PipelineModel(stages=[feats, model]).write().overwrite().save(f"{model_path.rstrip('/')}/{name}")
        scored = positive_probability(model.transform(scored_df))
        # Both splits' areas in one pass (grouped by split).
        areas = {r["split"]: (r["roc_auc"], r["pr_auc"])
                 for r in curve_areas(scored, "presence", "prob", by=["split"]).collect()}
        val, test = areas.get("val", (None, None)), areas.get("test", (None, None))
        p = {**GBT_DEFAULTS, **params}
        row = (name, datetime.now(timezone.utc).isoformat(),
               pos + neg, cnt.get(("val", 1), 0) + cnt.get(("val", 0), 0),
               cnt.get(("test", 1), 0) + cnt.get(("test", 0), 0), pos, neg, float(ratio),
               int(p["maxDepth"]), float(p["stepSize"]), int(p["maxIter"]), *recorded(t, native), *years,
               f"{model_path.rstrip('/')}/{name}" if model_path else None, *val, *test)
        if ledger:
            (literal_rows(spark, [row], RUN_SCHEMA).withColumn("run_key", F.lit(keys[i]))
             .write.mode("overwrite").json(f"{ledger.rstrip('/')}/run-{keys[i]}"))
        return row

    done: dict[int, tuple] = {}
    if todo:
        with ThreadPoolExecutor(min(MAX_CONCURRENT, len(todo))) as pool:
            done = dict(zip(todo, pool.map(inheritable_thread_target(spark)(run), todo)))
        discard(assembled)
    discard(rows)
    out = [done[i] if i in done else tuple(finished[k][f.name] for f in RUN_SCHEMA.fields) for i, k in enumerate(keys)]
    return literal_rows(spark, out, RUN_SCHEMA) if out else spark.createDataFrame([], RUN_SCHEMA)


# ------------------------------------------------------------------ trees as tables

def tree_nodes(spark, model_path: str) -> DataFrame:
    """The trees of a saved pipeline as a table: one row a node.

    (tree, weight, node, feature, threshold, categories, left, right,
    prediction, n_rows): rows whose ``feature`` is at most ``threshold`` (or, where
    the feature is categorical, among ``categories``) go to ``left``;
    leaves have no feature, children, threshold or categories.  ``weight`` is
    the tree's share in the ensemble.
    """
    stage = f"{model_path.rstrip('/')}/stages/*_GBTClassifier_*"
    nodes = spark.read.parquet(f"{stage}/data")
    weights = spark.read.parquet(f"{stage}/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("weight"))
    n = F.col("nodeData")
    inner = n["leftChild"] >= 0
    ordered = n["split"]["numCategories"] < 0
    values = n["split"]["leftCategoriesOrThreshold"]
    return (nodes.select(
        F.col("treeID").alias("tree"), n["id"].alias("node"),
        F.when(inner, n["split"]["featureIndex"]).alias("feature"),
        F.when(inner & ordered, F.get(values, F.lit(0))).alias("threshold"),
        F.when(inner & ~ordered, values).alias("categories"),
        F.when(inner, n["leftChild"]).alias("left"), F.when(inner, n["rightChild"]).alias("right"),
        n["prediction"].alias("prediction"), n["rawCount"].alias("n_rows"))
        .join(weights, "tree")
        .select("tree", "weight", "node", "feature", "threshold", "categories", "left", "right", "prediction", "n_rows"))


def node_scores(rows: DataFrame, nodes: DataFrame, features: str = "features") -> DataFrame:
    """``rows`` with ``margin`` and ``prob``, the ensemble's score and positive probability, by joins on its nodes.

    Every row starts at each tree's root; a join on (tree, node) a level sends
    it to a child.  The node table is sent to all tasks where it has at most
    ``MAX_BROADCAST_NODES`` rows.  Leaves are summed by row; the sums
    are partial before the shuffle, so a row's trees do not travel apart.
    """
    table = materialize(nodes, "tree-nodes")
    n, trees = table.agg(F.count("*"), F.max("tree")).first()
    if not n:
        raise ValueError("a model has at least one node")
    hint = F.broadcast if n <= MAX_BROADCAST_NODES else (lambda t: t)
    keyed = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "scored-rows")
    step = hint(table.select("tree", "node", "feature", "threshold", "categories", "left", "right"))
    at = (keyed.select("_row", vector_to_array(features).alias("_x"))
          .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(int(trees))))).withColumn("node", F.lit(0)))
    value = F.get(F.col("_x"), F.col("feature"))
    left = F.when(F.col("categories").isNull(), value <= F.col("threshold")).otherwise(F.array_contains("categories", value))
    for _ in range(tree_depth(table)):
        at = (at.join(step, ["tree", "node"])
              .select("_row", "_x", "tree", F.when(F.col("feature").isNull(), F.col("node")).when(left, F.col("left"))
                      .otherwise(F.col("right")).alias("node")))
    margin = (at.select("_row", "tree", "node").join(hint(table.select("tree", "node", "weight", "prediction")), ["tree", "node"])
              .groupBy("_row").agg(F.sum(F.col("weight") * F.col("prediction")).alias("margin")))
    return (keyed.join(margin, "_row").withColumn("prob", 1 / (1 + F.exp(-2 * F.col("margin")))).drop("_row"))


def tree_depth(nodes: DataFrame) -> int:
    """Levels of splits below a root, of the deepest tree."""
    level, depth = nodes.filter("node = 0"), 0
    while True:
        kids = (level.filter("left is not null").select("tree", F.explode(F.array("left", "right")).alias("node")))
        level = materialize(nodes.join(kids, ["tree", "node"]), "tree-level")
        if level.isEmpty():
            return depth
        depth += 1
