"""running_totals / exact_medians against brute force, including a hot key
that spans many range partitions."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrapix.operators.prefix import exact_medians, running_totals, split_medians


def frame(seed, n=3000, keys=4, hot=0.6):
    rng = np.random.default_rng(seed)
    k = np.where(rng.random(n) < hot, 0, rng.integers(1, keys, n))
    return pd.DataFrame({"k": k.astype("int64"), "o": rng.permutation(n).astype("int64"),
                         "w": rng.integers(1, 5, n).astype("int64")})


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_running_totals_keyed(spark, parts):
    pdf = frame(parts)
    out = running_totals(spark.createDataFrame(pdf), ["k"], ["o"], {"w": "w"}, with_total=True,
                         num_partitions=parts).toPandas().sort_values(["k", "o"])
    ref = pdf.sort_values(["k", "o"]).assign(cum=lambda d: d.groupby("k")["w"].cumsum(),
                                             tot=lambda d: d.groupby("k")["w"].transform("sum"))
    assert out["cum_w"].tolist() == ref["cum"].tolist()
    assert out["tot_w"].tolist() == ref["tot"].tolist()


def test_running_totals_global_descending(spark):
    pdf = frame(7)[["o", "w"]]
    out = running_totals(spark.createDataFrame(pdf), [], [F.col("o").desc()], {"w": "w"},
                         with_total=True, num_partitions=5).toPandas().sort_values("o", ascending=False)
    ref = pdf.sort_values("o", ascending=False)
    assert out["cum_w"].tolist() == ref["w"].cumsum().tolist()
    assert set(out["tot_w"]) == {int(pdf["w"].sum())}


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_running_totals_in_slices(spark, parts):
    """Slices by quantiles: a hot key, a null and equal values that share a slice, falling order."""
    pdf = frame(parts + 1)
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.col("o") == 5, None).otherwise(F.col("o") % 50))
    order = [F.col("x").desc_nulls_last(), "o"]
    out = running_totals(df, ["k"], order, {"w": "w"}, with_total=True, num_partitions=parts, along=-F.col("x"))
    got = out.toPandas().sort_values(["k", "o"])
    ref = pdf.assign(x=lambda d: np.where(d["o"] == 5, 1e9, -(d["o"] % 50))).sort_values(["k", "x", "o"])
    ref = ref.assign(cum=ref.groupby("k")["w"].cumsum(), tot=ref.groupby("k")["w"].transform("sum"))
    ref = ref.sort_values(["k", "o"])
    assert got["cum_w"].tolist() == ref["cum"].tolist()
    assert got["tot_w"].tolist() == ref["tot"].tolist()


def test_running_totals_in_slices_shuffle_rows_once(spark):
    df = spark.range(50_000).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("o"), F.lit(1).alias("w"))
    out = running_totals(df, ["k"], ["o"], {"w": "w"}, num_partitions=16, along=F.col("o"))
    plan = out._jdf.queryExecution().executedPlan().toString().split("Subquery subquery")[0]
    rows = [line for line in plan.splitlines() if "Exchange" in line and "broadcast" not in line.lower()]
    assert sum("rangepartitioning" in line for line in rows) == 0
    assert sorted(out.select("cum_w").toPandas().groupby("cum_w").size().tolist())[-1] <= 3
    # one for the rows, one for partial totals of a slice, one for totals of a key, one to join them back
    assert len(rows) <= 4


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-5, 5) | st.none()), min_size=1, max_size=60),
       st.integers(1, 6), st.sampled_from([0, 10, 4096]))
def test_exact_medians_property(spark, rows, parts, limit):
    pdf = pd.DataFrame(rows, columns=["k", "v"]).astype({"v": "float64"})
    out = exact_medians(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k long, v double"),
                        ["k"], ["v"], counts={"n": "v"}, num_partitions=parts, max_group_rows=limit).toPandas()
    ref = pdf.dropna().groupby("k")["v"].agg(["median", "count"])
    got = out.set_index("k").sort_index()
    assert list(got.index) == list(ref.index)
    assert np.allclose(got["v"].to_numpy(), ref["median"].to_numpy())
    assert got["n"].tolist() == ref["count"].tolist()


def test_exact_medians_match_builtin_on_hot_group(spark):
    pdf = frame(11, n=5000, keys=3, hot=0.9).assign(x=lambda d: (d["o"] % 97) / 7.0, y=lambda d: d["w"] * 1.5)
    df = spark.createDataFrame(pdf)
    ours = split_medians(df, ["k"], ["x", "y"], num_partitions=12).toPandas().set_index("k").sort_index()
    ref = df.groupBy("k").agg(F.median("x").alias("x"), F.median("y").alias("y")).toPandas().set_index("k").sort_index()
    assert np.allclose(ours.to_numpy(), ref.to_numpy())


def test_exact_medians_split_only_the_large_keys(spark):
    pdf = frame(5, n=2000, keys=6, hot=0.7).assign(x=lambda d: (d["o"] % 89) / 3.0)
    df = spark.createDataFrame(pdf)
    ours = exact_medians(df, ["k"], ["x"], counts={"n": "x"}, max_group_rows=200).toPandas().set_index("k").sort_index()
    ref = pdf.groupby("k")["x"].agg(["median", "count"])
    assert (ref["count"] > 200).any() and (ref["count"] <= 200).any()
    assert np.allclose(ours["x"], ref["median"]) and ours["n"].tolist() == ref["count"].tolist()


@pytest.mark.parametrize("hold", [64, 4096])
def test_split_medians_select_in_rounds(spark, hold):
    """Spread, tied, skewed, null, NaN, infinite and one-sided columns, odd and even counts, over several rounds."""
    rng = np.random.default_rng(3)
    n = 20_000
    k = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 5, n))
    spread = rng.normal(size=n) * 10.0 ** rng.integers(-8, 9, n)
    pdf = pd.DataFrame({"k": k.astype("int64"), "spread": spread, "tied": (rng.integers(0, 10, n) > 3) * 1.0,
                        "steep": rng.random(n) ** 40, "half": np.where(np.arange(n) % 2, 1.0, -1.0),
                        "ends": np.where(rng.random(n) < 0.6, np.inf, spread)})
    df = (spark.createDataFrame(pdf).withColumn("nulls", F.when(F.col("spread") > 0, F.col("steep")))
          .withColumn("nan", F.when(F.col("steep") > 1e-3, F.lit(float("nan"))).otherwise(F.col("spread")))
          .withColumn("none", F.lit(None).cast("double")))
    names = [*pdf.columns[1:], "nulls", "nan", "none"]
    got = split_medians(df, ["k"], names, counts={"m": "nulls"}, num_partitions=5, hold=hold).toPandas()
    ref = df.groupBy("k").agg(*[F.median(v).alias(v) for v in names], F.count("nulls").alias("m")).toPandas()
    got, ref = (x.set_index("k").sort_index().astype("float64") for x in (got, ref))
    assert got.index.tolist() == ref.index.tolist() and got.columns.tolist() == ref.columns.tolist()
    assert got.equals(ref)


def test_split_medians_read_the_source_once(spark):
    read = spark.sparkContext.accumulator(0)

    def note(it):
        for pdf in it:
            read.add(len(pdf))
            yield pdf

    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.xxhash64("id").cast("double").alias("x"))
    got = split_medians(df.mapInPandas(note, df.schema), ["k"], ["x"], hold=64).toPandas()
    assert len(got) == 2 and read.value == 5000
