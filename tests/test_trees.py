"""Trees as tables, saved models, concurrent sweeps and their ledger."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from terrapix.operators import model
from terrapix.sources.store import shared_path


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(5)
    n = 900
    bands = {b: rng.random(n) for b in model.NUMERIC_FEATURES}
    pdf = pd.DataFrame({"year": rng.integers(1995, 2023, n).astype("int32"), "nlcd_class": rng.choice([11, 21, 41, 90], n).astype("int32"), **bands})
    pdf["presence"] = ((pdf.NDVI + 0.3 * (pdf.nlcd_class == 41) + 0.2 * rng.random(n)) > 0.8).astype("int32")
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("params", [{"maxDepth": 4, "maxIter": 5}, {"maxDepth": 1, "maxIter": 3}, {"maxDepth": 0, "maxIter": 1}])
@pytest.mark.parametrize("broadcast", [10 ** 6, 0])
def test_node_scores_equal_the_model(spark, samples, params, broadcast, monkeypatch):
    monkeypatch.setattr(model, "MAX_BROADCAST_NODES", broadcast)
    fitted = model.train(samples, params)
    path = shared_path(spark, "test-model")
    fitted.write().overwrite().save(path)
    nodes = model.tree_nodes(spark, path)
    gbt = fitted.stages[-1]
    assert nodes.count() == gbt.totalNumNodes
    assert model.tree_depth(nodes) == max(t.depth for t in gbt.trees)
    want = model.positive_probability(fitted.transform(samples)).select("features", F.col("prob").alias("want"))
    got = model.node_scores(want, nodes).select("prob", "want").toPandas()
    assert len(got) == samples.count()
    assert np.allclose(got.prob, got.want, rtol=0, atol=1e-12)


def test_categorical_splits_are_read(spark, samples):
    fitted = model.train(samples.withColumn("presence", (F.col("nlcd_class") == 41).cast("int")), {"maxDepth": 2, "maxIter": 2})
    path = shared_path(spark, "test-model")
    fitted.write().overwrite().save(path)
    nodes = model.tree_nodes(spark, path)
    assert nodes.filter("categories is not null").count() > 0
    got = model.node_scores(model.positive_probability(fitted.transform(samples)).withColumnRenamed("prob", "want"), nodes)
    assert got.filter(F.abs(F.col("prob") - F.col("want")) > 1e-12).count() == 0


def test_a_sweep_takes_finished_runs_from_its_ledger(spark, samples, monkeypatch):
    ledger = shared_path(spark, "test-ledger")
    trials = [{"app_name": f"t{d}", "max_depth": d, "num_round": 2, "eta": 0.2, "reg_lambda": 1.0} for d in (1, 2, 3)]
    first = model.tuning_sweep(samples, trials[:2], ledger=ledger).collect()
    fits = []
    real = model.gbt
    monkeypatch.setattr(model, "gbt", lambda p: fits.append(p["maxDepth"]) or real(p))
    again = model.tuning_sweep(samples, trials, ledger=ledger).collect()
    assert fits == [3]
    assert [r["app_name"] for r in again] == ["t1", "t2", "t3"]
    assert [r.asDict() for r in again[:2]] == [r.asDict() for r in first]
    # Other rows are another run, whatever its name.
    fits.clear()
    model.tuning_sweep(samples.filter("nlcd_class <> 90"), trials[:1], ledger=ledger).collect()
    assert fits == [1]


def test_a_sweep_gives_what_single_fits_give(spark, samples):
    trials = [{"app_name": f"t{d}", "maxDepth": d, "maxIter": 3} for d in (1, 2, 3, 4)]
    rows = model.tuning_sweep(samples, trials, native=True).collect()
    for t, r in zip(trials, rows):
        alone = model.train(samples, {k: v for k, v in t.items() if k != "app_name"})
        want = model.evaluate(alone, samples.filter(model.in_years("year", model.VAL_YEARS))).first()
        assert r["app_name"] == t["app_name"] and r["max_depth"] == t["maxDepth"]
        assert r["val_auc"] == pytest.approx(want["roc_auc"], abs=1e-9)
    assert model.tuning_sweep(samples, []).count() == 0


def test_feature_tables_are_cut_by_size():
    assert model.table_parts(1_000, 20) == 1
    assert model.table_parts(10_000_000, 20) == -(-10_000_000 * 224 // model.PART_BYTES)


def test_feature_pipeline_is_reused(samples):
    stages = Pipeline(stages=model.feature_stages()).fit(samples).stages
    assert [type(s).__name__ for s in stages] == ["StringIndexerModel", "OneHotEncoderModel", "VectorAssembler"]
