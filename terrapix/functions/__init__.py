"""Column-level functions (built-in Spark expressions only)."""

from terrapix.functions.paths import file_stem, path_year
from terrapix.functions.spectral import (
    BAND_NAMES,
    INDEX_NAMES,
    bsi,
    clamp01,
    clear_sky,
    date_in,
    eligible_sensor,
    evi,
    harmonised_band,
    index_columns,
    month_day_in,
    norm_diff,
    reflectance,
    safe_div,
    scaled_dn,
    sensors_for_year,
)
from terrapix.functions.years import in_years, split_label, year_list

__all__ = [
    "BAND_NAMES",
    "INDEX_NAMES",
    "bsi",
    "clamp01",
    "clear_sky",
    "date_in",
    "eligible_sensor",
    "evi",
    "file_stem",
    "harmonised_band",
    "in_years",
    "index_columns",
    "month_day_in",
    "norm_diff",
    "path_year",
    "reflectance",
    "safe_div",
    "scaled_dn",
    "sensors_for_year",
    "split_label",
    "year_list",
]
