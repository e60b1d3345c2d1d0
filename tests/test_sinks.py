"""Round trips of every source / sink, and a saved model re-evaluated."""

import json
import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from terrapix.operators.model import (
    evaluate,
    evaluate_saved,
    positive_probability,
    run_documents,
    train,
    trial_params,
    tuning_sweep,
)
from terrapix.operators.metrics import scores
from terrapix.sources.sinks import (
    read_run_metrics,
    unreadable_runs,
    write_csv,
    write_metrics,
    write_predictions,
    write_samples,
)
from terrapix.sources.tables import SAMPLE_SCHEMA, read_samples
from terrapix.operators.report import flatten_run_metrics, leaderboard

FEATURES = ["BLUE", "GREEN", "RED", "NIR", "SWIR1", "SWIR2", "NDVI", "EVI", "NDWI", "NBR", "BSI", "NDSI"]


def samples_pdf(n=600, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"year": rng.integers(1995, 2023, n).astype("int32"),
                        "presence": (rng.random(n) < 0.3).astype("int32"),
                        "nlcd_class": rng.choice([11, 21, 42, 71], n).astype("int32")})
    for i, f in enumerate(FEATURES):
        pdf[f] = rng.random(n) + pdf["presence"] * (0.3 if i % 3 == 0 else 0.0)
    return pdf


def test_samples_round_trip_and_partition_pruning(spark, tmp_path):
    path = str(tmp_path / "samples")
    df = spark.createDataFrame(samples_pdf(), SAMPLE_SCHEMA)
    write_samples(df, path)
    assert os.path.isdir(os.path.join(path, "year=1995"))
    back = read_samples(spark, path)
    assert back.count() == df.count()
    q = back.filter(F.col("year").isin(2019, 2020))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert q.count() == df.filter(F.col("year").isin(2019, 2020)).count()
    # dynamic overwrite replaces one year only
    write_samples(df.filter("year = 1995").limit(3), path)
    assert read_samples(spark, path).filter("year = 1995").count() == 3
    assert read_samples(spark, path).filter("year = 1996").count() == df.filter("year = 1996").count()


def files_by_year(path):
    return {d: len([f for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet")])
            for d in os.listdir(path) if d.startswith("year=")}


def test_small_years_have_one_file_and_a_large_year_is_split(spark, tmp_path):
    df = spark.createDataFrame(samples_pdf(), SAMPLE_SCHEMA).repartition(8)
    write_samples(df, str(tmp_path / "small"))
    assert set(files_by_year(str(tmp_path / "small")).values()) == {1}
    big = spark.range(400_000).select(F.when(F.col("id") % 50 == 0, F.lit(1996) + F.col("id") % 4).otherwise(1995).cast("int").alias("year"),
                                      F.xxhash64("id").alias("a"), F.xxhash64("id", "id").alias("b")).repartition(8)
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "1m")
    try:
        write_samples(big, str(tmp_path / "big"))
    finally:
        spark.conf.set(key, before)
    files = files_by_year(str(tmp_path / "big"))
    assert 4 <= files["year=1995"] <= 12 and all(n == 1 for y, n in files.items() if y != "year=1995")
    assert spark.read.parquet(str(tmp_path / "big")).count() == 400_000


def test_run_files_are_read_whole_and_skipped_ones_reported(spark, tmp_path):
    from terrapix.sources.sinks import read_run_files

    text = {"a": json.dumps({"app_name": "a", "metrics": {"val_auc": 0.7}}, indent=2), "blank": "\n", "broken": "{ \n no json",
            "list": "[\n1]", "word": '"text"', "odd": json.dumps({"app_name": "odd", "hyperparameters": {"max_depth": "deep"}}, indent=2),
            "none": "{}", "cut": json.dumps({"app_name": "cut", "metrics": {"val_auc": 0.7}}, indent=2)[:-3]}
    for name, t in text.items():
        (tmp_path / f"{name}_metrics.json").write_text(t)
    (tmp_path / "notes.json").write_text("{}")
    rows = {r["source_file"].rsplit("/", 1)[1].removesuffix("_metrics.json"): r for r in read_run_files(spark, str(tmp_path)).collect()}
    assert {n: (r["status"], r["reason"]) for n, r in rows.items()} == {
        "a": ("read", None), "none": ("read", None), "odd": ("partial", "a field of another type"),
        "broken": ("skipped", "not JSON"), "blank": ("skipped", "not JSON"), "cut": ("skipped", "not JSON"),
        "list": ("skipped", "not an object"), "word": ("skipped", "not an object")}
    assert rows["a"]["metrics"]["val_auc"] == 0.7 and rows["odd"]["app_name"] == "odd"
    assert all(r["n_bytes"] == len(text[n]) for n, r in rows.items())


def test_run_documents_are_written_by_many_tasks_in_a_file_each(spark, tmp_path, monkeypatch):
    from terrapix.plans import queries

    src, out = tmp_path / "tables", tmp_path / "files"
    # One input file, read by one task; key 5 comes twice.
    spark.createDataFrame([(i,) for i in [*range(450), 5]], "s_suppkey long").coalesce(1).write.parquet(str(src / "supplier.parquet"))
    monkeypatch.setattr(queries, "shared_path", lambda _, label: str(out))
    rows = {r["run_id"]: r for r in queries.q_run_files(spark, str(src)).collect()}
    files = {d: [f for f in os.listdir(out / d) if f.endswith(".txt")] for d in os.listdir(out) if d.startswith("run_id=")}
    assert set(files) == {f"run_id={i}" for i in range(450)} and all(len(f) == 1 for f in files.values())
    assert len({f[0].split("-")[1] for f in files.values()}) == 5
    assert len(rows) == 450 and rows[5]["n_bytes"] == 2 * rows[4]["n_bytes"] and rows[13]["app_name"] == "trial_13"
    kinds = {7: "partial", 8: "skipped", 9: "skipped"}
    assert all(r["status"] == kinds.get(i % 10, "read") for i, r in rows.items())


def test_no_run_documents_make_no_files(spark, tmp_path):
    from terrapix.sources.sinks import read_run_files, write_run_files

    write_run_files(spark.createDataFrame([], "run_id long, value string"), str(tmp_path / "f"))
    assert read_run_files(spark, str(tmp_path / "f"), pattern="*.txt").collect() == []


def test_many_small_run_files_are_read_by_few_tasks(spark, tmp_path):
    from terrapix.sources.sinks import read_run_files

    cores = spark.sparkContext.defaultParallelism
    for i in range(16 * cores):
        (tmp_path / f"{i}_metrics.json").write_text(json.dumps({"app_name": str(i)}))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "1k")  # a task for each file
    try:
        files = read_run_files(spark, str(tmp_path))
        assert files.rdd.getNumPartitions() == 8 * cores
        assert sorted(int(r["app_name"]) for r in files.collect()) == list(range(16 * cores))
    finally:
        spark.conf.set(key, before)


def test_run_metrics_files(spark, tmp_path):
    d = tmp_path / "metrics"
    d.mkdir()
    for name, val in (("a", 0.7), ("b", 0.8)):
        (d / f"{name}_metrics.json").write_text(json.dumps(
            {"app_name": name, "metrics": {"val_auc": val, "test_auc": val - 0.1},
             "hyperparameters": {"max_depth": 8, "eta": 0.1},
             "dataset_info": {"train_years": [1995, 1996], "pos_count": 5}}, indent=2))
    (d / "c_metrics.json").write_text(json.dumps({"app_name": "c", "hyperparameters": {"max_depth": 8.0}}))
    (d / "odd_metrics.json").write_text(json.dumps({"app_name": "odd", "hyperparameters": {"max_depth": "deep"}}))
    (d / "broken_metrics.json").write_text("{ this is not json")
    (d / "notes.json").write_text(json.dumps({"app_name": "ignored"}, indent=2))
    runs = read_run_metrics(spark, str(d))
    flat = flatten_run_metrics(runs)
    assert sorted((r["app_name"], r["max_depth"]) for r in flat.collect() if r["max_depth"]) == [("a", 8), ("b", 8), ("c", 8)]
    assert "odd" in [r["app_name"] for r in flat.collect()] and flat.count() == 4
    bad = [r["source_file"] for r in unreadable_runs(runs).collect()]
    assert sorted(b.rsplit("/", 1)[1] for b in bad) == ["broken_metrics.json", "odd_metrics.json"]
    assert runs.filter("app_name = 'a'").select("dataset_info.train_years").first()[0] == [1995, 1996]


def test_csv_json_parquet_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "x"), (2, None, "y")], "k int, v double, s string")
    write_csv(df, str(tmp_path / "c"))
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert back.columns == ["k", "v", "s"] and back.count() == 2
    write_metrics(df.select(F.struct("k", "v").alias("metrics"), "s"), str(tmp_path / "j"))
    assert sorted(r["metrics"]["k"] for r in spark.read.json(str(tmp_path / "j")).collect()) == [1, 2]
    write_predictions(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_model_save_load_same_auc(spark, tmp_path):
    df = spark.createDataFrame(samples_pdf(800, 1), SAMPLE_SCHEMA)
    model = train(df, {"maxDepth": 2, "maxIter": 3})
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    years = {"start": 2016, "end": 2023}
    ev = evaluate_saved(spark, path, df, years).collect()[0]
    direct = evaluate(model, df.filter(F.col("year").isin(list(range(2016, 2023))))).collect()[0]
    assert ev["roc_auc"] == direct["roc_auc"] and ev["pr_auc"] == direct["pr_auc"]
    assert ev["eval_samples"] == ev["pos_count"] + ev["neg_count"]
    assert 0.5 < ev["roc_auc"] <= 1.0
    s = scores(model.transform(df)).first()
    assert 0.0 <= s["predicted_prob"] <= 1.0
    assert positive_probability(model.transform(df)).filter("prob < 0 OR prob > 1").count() == 0


def test_sweep_rows_become_documents_on_the_leaderboard(spark, tmp_path):
    df = spark.createDataFrame(samples_pdf(600, 2), SAMPLE_SCHEMA)
    trials = [{"app_name": "deep", "max_depth": 3, "eta": 0.2, "num_round": 2, "subsample": 0.8, "reg_lambda": 5.0},
              {"app_name": "flat", "max_depth": 1, "num_round": 1, "min_child_weight": 2, "colsample_bytree": 1.0}]
    runs = tuning_sweep(df, trials)
    write_metrics(run_documents(runs, "configs/x.yaml", "samples/54m"), str(tmp_path / "runs"))
    back = read_run_metrics(spark, str(tmp_path / "runs"), pattern="*.json", multiline=False)
    assert unreadable_runs(back).count() == 0
    first = back.filter("app_name = 'deep'").first()
    assert first["dataset_info"]["train_years"] == list(range(1995, 2016)) and first["config_path"] == "configs/x.yaml"
    flat = {r["app_name"]: r for r in flatten_run_metrics(back).collect()}
    assert (flat["deep"]["max_depth"], flat["deep"]["subsample"], flat["deep"]["reg_lambda"], flat["deep"]["min_child_weight"]) == (3, 0.8, 5.0, None)
    assert (flat["flat"]["min_child_weight"], flat["flat"]["colsample_bytree"], flat["flat"]["eta"]) == (2.0, 1.0, 0.1)
    board = leaderboard(flatten_run_metrics(back), None).collect()
    assert [r["rank"] for r in board] == [1, 2] and board[0]["val_auc"] >= board[1]["val_auc"]
    assert board[0]["val_auc"] == max(r["val_auc"] for r in runs.collect())


def test_trial_parameters_map_to_the_trainer():
    got = trial_params({"max_depth": 8.0, "eta": "0.1", "subsample": 0.8, "min_child_weight": 0, "colsample_bytree": 0.6,
                        "reg_alpha": 1, "missing": 0, "gamma": None, "num_round": 300})
    assert got == {"maxDepth": 8, "stepSize": 0.1, "subsamplingRate": 0.8, "minInstancesPerNode": 1,
                   "featureSubsetStrategy": "0.6", "maxIter": 300}
