"""Yearly growing-season median composites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapix.functions.spectral import BAND_NAMES, INDEX_NAMES, SEASON_END, SEASON_START, sensors_for_year
from terrapix.operators.prefix import exact_medians

COMPOSITE_BANDS = BAND_NAMES + INDEX_NAMES
COMPOSITE_TAG = "median_growing_season"


def yearly_composite(
    obs: DataFrame,
    keys: tuple[str, ...] = ("year", "pixel_id"),
    bands: tuple[str, ...] = COMPOSITE_BANDS,
    as_float: bool = True,
    with_metadata: bool = True,
    num_partitions: int | None = None,
) -> DataFrame:
    """Per pixel-year median of every band plus ``pixel_count``.

    ``obs`` holds one row per (scene, pixel) with the bands already scaled,
    masked and indexed (``spectral_observations``); the merged sensors are just
    rows of the same DataFrame (bag union).  All years are computed in one job.
    Each band's median is taken independently over its own observations, and
    ``pixel_count`` counts the observations with an NDVI value, also where
    ``bands`` leaves NDVI out.
    """
    keys = list(keys)
    values = list(dict.fromkeys([*bands, "NDVI"]))
    out = exact_medians(obs, keys, values, counts={"pixel_count": "NDVI"}, num_partitions=num_partitions)
    out = out.withColumn("pixel_count", F.col("pixel_count").cast("double"))
    if as_float:
        out = out.withColumns({b: F.col(b).cast("float") for b in [*bands, "pixel_count"]})
    if with_metadata:
        y = F.col("year")
        out = out.withColumns({
            "start_date": F.make_date(y, F.lit(SEASON_START[0]), F.lit(SEASON_START[1])),
            "end_date": F.make_date(y, F.lit(SEASON_END[0]), F.lit(SEASON_END[1])),
            "sensors": sensors_for_year(y),
            "composite": F.lit(COMPOSITE_TAG),
        })
    return out.select(*keys, *bands, "pixel_count",
                      *(["start_date", "end_date", "sensors", "composite"] if with_metadata else []))


def median_ndvi(obs: DataFrame, keys: tuple[str, ...] = ("year", "pixel_id"),
                num_partitions: int | None = None) -> DataFrame:
    """Minimum slice of the composite: median NDVI and observation count."""
    keys = list(keys)
    med = exact_medians(obs, keys, ["NDVI"], counts={"pixel_count": "NDVI"}, num_partitions=num_partitions)
    return med.select(*keys, F.col("NDVI").alias("median_ndvi"), "pixel_count")
