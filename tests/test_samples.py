"""Exact stratified selection: brute-force ranking and the published rules."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from terrapix.operators.samples import sample_totals, stratified_sample


def keys(pdf, seed):
    return [int(hashlib.md5(f"{seed}:{y}:{p}".encode()).hexdigest()[:15], 16) for y, p in zip(pdf["year"], pdf["pixel_id"])]


def aligned(seed, n=4000):
    rng = np.random.default_rng(seed)
    pix = rng.choice(100000, n, replace=False)
    year = rng.integers(1995, 1999, n)
    pres = (rng.random(n) < np.where(year == 1996, 0.9, 0.2)).astype(int)  # 1996: more positives than negatives
    return pd.DataFrame({"pixel_id": pix.astype("int32"), "year": year.astype("int32"), "presence": pres.astype("int32"),
                         "NDVI": rng.random(n)})


@pytest.mark.parametrize("max_pos,ratio,seed,max_bucket", [(50, 1.0, 42, 10_000), (10**6, 1.0, 42, 10_000), (30, 2.5, 7, 10_000),
                                                           (50, 1.0, 42, 0), (333, 0.5, 1, 0), (0, 1.0, 1, 5)])
def test_stratified_sample_matches_brute_force(spark, max_pos, ratio, seed, max_bucket):
    pdf = aligned(3)
    got = stratified_sample(spark.createDataFrame(pdf), max_pos=max_pos, neg_ratio=ratio, seed=seed,
                            max_bucket=max_bucket).toPandas()
    pdf["h"] = keys(pdf, seed)
    want = []
    for y, g in pdf.groupby("year"):
        pos = g[g.presence == 1].sort_values(["h", "pixel_id"])
        neg = g[g.presence == 0].sort_values(["h", "pixel_id"])
        n_pos = min(len(pos), max_pos)
        n_neg = min(len(neg), math.floor(n_pos * ratio))
        want += list(zip(pos.year[:n_pos], pos.pixel_id[:n_pos])) + list(zip(neg.year[:n_neg], neg.pixel_id[:n_neg]))
    assert sorted(zip(got.year, got.pixel_id)) == sorted((int(a), int(b)) for a, b in want)
    cols = ["pixel_id", "year", "presence", "NDVI"]
    tot = sample_totals(spark.createDataFrame(got[cols], "pixel_id int, year int, presence int, NDVI double")).collect()[0]
    assert tot["total"] == len(want) and tot["positives"] + tot["negatives"] == len(want)
    for y, g in got.groupby("year"):
        assert (g.presence == 1).sum() <= max_pos


def test_buckets_are_refined_until_they_are_small(spark, monkeypatch):
    from terrapix.operators import samples

    monkeypatch.setattr(samples, "DIGIT_BITS", 2)  # two bits a round: many rounds for 4,000 rows
    pdf = aligned(8)
    got = stratified_sample(spark.createDataFrame(pdf), max_pos=77, neg_ratio=1.5, max_bucket=3).toPandas()
    pdf["h"] = keys(pdf, 42)
    want = []
    for _, g in pdf.groupby("year"):
        pos = g[g.presence == 1].sort_values(["h", "pixel_id"])[:77]
        want += [*zip(pos.year, pos.pixel_id)]
        neg = g[g.presence == 0].sort_values(["h", "pixel_id"])[:math.floor(len(pos) * 1.5)]
        want += [*zip(neg.year, neg.pixel_id)]
    assert sorted(zip(got.year, got.pixel_id)) == sorted(want)


def test_pixels_at_a_fixed_distance_are_drawn_independently(spark):
    """At a rate of 0.1, pixels 1,000,003 apart are drawn together about 0.1 x 0.1 of the time, not always."""
    n, stride = 20_000, 1_000_003
    rows = spark.range(3 * n).select(
        F.lit(2000).alias("year"), F.lit(1).alias("presence"),
        (F.col("id") % n + F.floor(F.col("id") / n) * stride).cast("int").alias("pixel_id"))
    got = {r["pixel_id"] for r in stratified_sample(rows, max_pos=3 * n // 10).collect()}
    assert len(got) == 3 * n // 10
    times = np.bincount([sum(p + k * stride in got for k in range(3)) for p in range(n)], minlength=4)
    want = n * np.array([0.9 ** 3, 3 * 0.1 * 0.81, 3 * 0.01 * 0.9, 0.001])
    assert (np.abs(times - want) < 5 * np.sqrt(want) + 5).all()


def test_input_is_evaluated_once(spark):
    seen = spark.sparkContext.accumulator(0)
    pdf = aligned(4, 500)

    def count(it):
        for part in it:
            seen.add(len(part))
            yield part

    df = spark.createDataFrame(pdf).mapInPandas(count, "pixel_id int, year int, presence int, NDVI double")
    assert stratified_sample(df, max_pos=20, max_bucket=2).count() > 0
    assert seen.value == 500


def test_nothing_to_draw(spark):
    df = spark.createDataFrame(aligned(4, 50)).filter("presence = 0")
    assert stratified_sample(df).count() == 0
    assert stratified_sample(df.limit(0)).count() == 0
