"""ROC/PR areas, curves, confusion counts and histograms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from terrapix.operators.metrics import confusion, curve_areas, histogram, pr_curve, roc_curve


def scored(seed, n=3000):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    p = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)  # rounded: many ties
    return pd.DataFrame({"presence": y.astype("int32"), "prob": p})


def mann_whitney(y, p):
    pos, neg = p[y == 1], p[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


def test_areas_match_evaluator_and_rank_form(spark):
    pdf = scored(5)
    df = spark.createDataFrame(pdf)
    a = curve_areas(df, num_partitions=6).collect()[0]
    assert a["roc_auc"] == pytest.approx(mann_whitney(pdf.presence.to_numpy(), pdf.prob.to_numpy()), abs=1e-12)
    ev = df.withColumn("presence", df.presence.cast("double"))
    for metric, col in (("areaUnderROC", "roc_auc"), ("areaUnderPR", "pr_auc")):
        e = BinaryClassificationEvaluator(labelCol="presence", rawPredictionCol="prob", metricName=metric, numBins=0)
        assert a[col] == pytest.approx(e.evaluate(ev), abs=1e-9)
    assert a["baseline"] == pytest.approx(pdf.presence.mean())
    assert a["pr_auc_trapezoid"] >= a["pr_auc"] - 1e-12


def test_curves_monotone(spark):
    df = spark.createDataFrame(scored(6))
    roc = roc_curve(df, num_partitions=4).toPandas().sort_values("threshold", ascending=False, na_position="first")
    assert (np.diff(roc.fpr) >= 0).all() and (np.diff(roc.tpr) >= 0).all()
    assert roc.fpr.iloc[-1] == 1.0 and roc.tpr.iloc[-1] == 1.0
    pr = pr_curve(df).toPandas().sort_values("threshold", ascending=False, na_position="first")
    assert (np.diff(pr.recall) >= 0).all() and pr.recall.iloc[-1] == 1.0
    assert (roc.fpr.iloc[0], roc.tpr.iloc[0], pr.recall.iloc[0], pr.precision.iloc[0]) == (0, 0, 0, 1)
    assert roc_curve(df.limit(0)).count() == 0


def test_confusion_single_class_and_sums(spark):
    df = spark.createDataFrame(pd.DataFrame({"presence": [0, 0, 0], "prob": [0.1, 0.7, 0.5]}))
    c = confusion(df, 0.5).collect()[0]
    assert (c["tp"], c["fp"], c["tn"], c["fn"]) == (0, 2, 1, 0)
    assert c["precision"] == 0.0 and c["recall"] == 0.0 and c["f1"] == 0.0
    pdf = scored(8)
    c = confusion(spark.createDataFrame(pdf), 0.5).collect()[0]
    assert c["tp"] + c["fp"] + c["tn"] + c["fn"] == len(pdf)
    assert c["tp"] == int(((pdf.prob >= 0.5) & (pdf.presence == 1)).sum())


def test_histogram_density_and_counts(spark):
    pdf = scored(9)
    h = histogram(spark.createDataFrame(pdf), "prob", 50, by="presence", density=True).toPandas()
    for cls, g in h.groupby("presence"):
        vals = pdf.prob[pdf.presence == cls].to_numpy()
        counts, edges = np.histogram(vals, bins=50)
        g = g.sort_values("bin")
        assert g["count"].tolist() == counts.tolist()
        assert np.allclose(g["lo"], edges[:-1]) and np.allclose(g["hi"], edges[1:])
        assert ((g.hi - g.lo) * g.density).sum() == pytest.approx(1.0)


def test_bounded_sample(spark):
    from terrapix.operators.metrics import bounded_sample

    df = spark.range(20000)
    s = bounded_sample(df, max_rows=2000, seed=42)
    n = s.count()
    assert 1500 < n < 2500 and n == bounded_sample(df, max_rows=2000, seed=42).count()
    assert bounded_sample(df, max_rows=50000).count() == 20000
    assert 800 < bounded_sample(df, fraction=0.05).count() < 1200


@pytest.mark.parametrize("values", [[3.0], [1.0, 1.0, None, float("nan")], [0.1 * i for i in range(31)], [None], []])
def test_small_histogram_equals_the_large_one(spark, values):
    from terrapix.operators.metrics import histogram, small_histogram

    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = [sorted(map(tuple, f(df, "x", 15).collect())) for f in (histogram, small_histogram)]
    assert rows[0] == rows[1]


def test_yearly_histogram_evaluates_its_labels_once(spark):
    from conftest import SF001
    from terrapix.operators.report import imbalance_by_year, imbalance_hist
    from terrapix.plans.queries import labels_table

    def scans(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Scan parquet")

    by_year = imbalance_by_year(labels_table(spark, SF001))
    assert scans(imbalance_hist(by_year)) == scans(by_year)


@pytest.mark.parametrize("rows", [[], [(0.5, 1)], [(0.5, 1), (0.4, 0)], "many", "straight"])
def test_compact_curve_leaves_out_points_between_equal_steps(spark, rows):
    from terrapix.operators.metrics import roc_curve

    if rows == "many":
        rows = [(i % 37 / 37, (i * i) % 3 // 2) for i in range(400)]
    if rows == "straight":  # every step alike: only the ends stay
        rows = [(i / 50, y) for i in range(50) for y in (0, 1)]
    df = spark.createDataFrame(rows, "prob double, presence int")
    steps = [(s, sum(y for p, y in rows if p == s), sum(1 - y for p, y in rows if p == s))
             for s in sorted({p for p, _ in rows}, reverse=True)]
    n_pos, n_neg = sum(s[1] for s in steps), sum(s[2] for s in steps)
    want, tp, fp = [], 0, 0
    for i, (score, pos, neg) in enumerate(steps):
        tp, fp = tp + pos, fp + neg
        if i in (0, len(steps) - 1) or (pos, neg) != steps[i + 1][1:]:
            want.append((score, fp / n_neg if n_neg else 0.0, tp / n_pos if n_pos else 0.0))
    got = [tuple(r) for r in roc_curve(df, compact=True).collect()]
    assert sorted(r for r in got if r[0] is not None) == sorted(want)
    assert [r[1:] for r in got if r[0] is None] == [(0.0, 0.0)] * bool(rows)
    assert roc_curve(df).count() == len(steps) + bool(rows)
