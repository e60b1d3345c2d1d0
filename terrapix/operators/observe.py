"""Scene / observation filtering and per-observation band maths.

All steps are narrow transformations (no shuffle): they fuse into the scan's
whole-stage-codegen stage and the simple comparisons reach the Parquet reader
as pushed filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapix.functions.spectral import (
    BAND_NAMES,
    MAX_CLOUD,
    SEASON_END,
    SEASON_START,
    clamp01,
    clear_sky,
    date_in,
    eligible_sensor,
    harmonised_band,
    index_columns,
    month_day_in,
    scaled_dn,
)

RAW_BANDS = ("b1", "b2", "b3", "b4", "b5", "b6", "b7")


def filter_scenes(
    scenes: DataFrame,
    bounds: tuple[float, float, float, float] | None = None,
    start: str | None = None,
    end: str | None = None,
    max_cloud: float = MAX_CLOUD,
    date_col: str = "acquired",
    cloud_col: str = "cloud",
) -> DataFrame:
    """Bounds / date ``[start, end)`` / strict cloud filters on a scene catalog.

    ``bounds`` is ``(x0, y0, x1, y1)``; a scene is kept when its footprint
    columns ``x0 y0 x1 y1`` intersect it.
    """
    cond = F.col(cloud_col) < F.lit(float(max_cloud))
    if start is not None and end is not None:
        cond = cond & date_in(date_col, start, end)
    if bounds is not None:
        bx0, by0, bx1, by1 = bounds
        cond = cond & (F.col("x0") <= bx1) & (F.lit(bx0) <= F.col("x1")) \
            & (F.col("y0") <= by1) & (F.lit(by0) <= F.col("y1"))
    return scenes.filter(cond)


def eligible_observations(
    obs: DataFrame,
    max_cloud: float = MAX_CLOUD,
    season_start=SEASON_START,
    season_end=SEASON_END,
) -> DataFrame:
    """Keep observations in the growing season, under the cloud threshold,
    from a sensor flying that year, with a clear-sky QA word."""
    return obs.filter(
        month_day_in("month", "day", season_start, season_end)
        & (F.col("cloud_cover") < F.lit(float(max_cloud)))
        & eligible_sensor("sensor", "year")
        & clear_sky("qa_pixel")
    )


def harmonise_bands(obs: DataFrame, drop_raw: bool = True) -> DataFrame:
    """Map sensor-specific raw bands to BLUE..SWIR2 surface reflectance."""
    # Two projections: the scaled value is a column of its own, so the clamp
    # references it instead of repeating the sensor CASE (keeps codegen small).
    scaled = obs.withColumns({f"_sr_{n}": scaled_dn(harmonised_band(n)) for n in BAND_NAMES})
    out = scaled.withColumns({n: clamp01(f"_sr_{n}") for n in BAND_NAMES}).drop(*[f"_sr_{n}" for n in BAND_NAMES])
    return out.drop(*[c for c in RAW_BANDS if c in out.columns]) if drop_raw else out


def add_indices(df: DataFrame) -> DataFrame:
    """Append NDVI, EVI, NDWI, NBR, BSI and NDSI computed per observation."""
    return df.withColumns(index_columns())


def spectral_observations(obs: DataFrame, max_cloud: float = MAX_CLOUD) -> DataFrame:
    """Eligible observations with harmonised reflectance and the six indices."""
    return add_indices(harmonise_bands(eligible_observations(obs, max_cloud)))
