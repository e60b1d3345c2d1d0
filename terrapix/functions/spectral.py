"""Column expressions for Landsat surface-reflectance observations.

Every function here returns a ``Column`` built from built-in Spark
expressions, so it stays inside whole-stage codegen and can be used in
``select``/``filter``/``withColumns`` on batch or streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the published pipeline's constants)
# ---------------------------------------------------------------------------
# Collection 2 Level-2 surface reflectance: reflectance = DN * 0.0000275 - 0.2,
# clamped to [0, 1].
SR_SCALE = 0.0000275
SR_OFFSET = -0.2
# QA_PIXEL bits that must all be clear: 1 dilated cloud, 3 cloud,
# 4 cloud shadow, 5 snow.  1<<1 | 1<<3 | 1<<4 | 1<<5 == 58.
QA_MASK_BITS = (1, 3, 4, 5)
# Sensor eras, inclusive year bounds (None = open end):
# L5 up to 2011, L7 from 1999, L8 from 2013, L9 from 2022.
SENSOR_ERAS = {
    "L5": (None, 2011),
    "L7": (1999, None),
    "L8": (2013, None),
    "L9": (2022, None),
}
# Raw band names per sensor family, in the order
# BLUE, GREEN, RED, NIR, SWIR1, SWIR2.
BAND_NAMES = ("BLUE", "GREEN", "RED", "NIR", "SWIR1", "SWIR2")
BANDS_L5_L7 = ("b1", "b2", "b3", "b4", "b5", "b7")
BANDS_L8_L9 = ("b2", "b3", "b4", "b5", "b6", "b7")
INDEX_NAMES = ("NDVI", "EVI", "NDWI", "NBR", "BSI", "NDSI")
# Growing season: 1 May (inclusive) to 30 September (exclusive).
SEASON_START = (5, 1)
SEASON_END = (9, 30)
# Default scene cloud-cover threshold (strictly below).
MAX_CLOUD = 60.0
# ---------------------------------------------------------------------------

QA_MASK = sum(1 << b for b in QA_MASK_BITS)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """``num / den`` with 0.0 for a zero denominator (ANSI division raises)."""
    num, den = _c(num), _c(den)
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def clear_sky(qa) -> Column:
    """True when none of the cloud / shadow / snow QA bits is set."""
    return _c(qa).bitwiseAND(QA_MASK) == 0


def scaled_dn(dn) -> Column:
    """``DN * scale + offset`` (unclamped surface reflectance)."""
    return _c(dn).cast("double") * F.lit(SR_SCALE) + F.lit(SR_OFFSET)


def clamp01(x) -> Column:
    """Clamp to [0, 1]; NULL stays NULL and NaN stays NaN (``least`` /
    ``greatest`` alone would turn them into numbers)."""
    x = _c(x)
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def reflectance(dn) -> Column:
    """Scale a raw DN to surface reflectance and clamp it to [0, 1].

    For wide projections prefer ``scaled_dn`` into its own column and
    ``clamp01`` over that column: the scaled value is then computed once
    instead of being repeated inside the clamp.
    """
    return clamp01(scaled_dn(dn))


def norm_diff(a, b) -> Column:
    """Normalised difference ``(a - b) / (a + b)``, 0 when ``a + b == 0``."""
    a, b = _c(a), _c(b)
    return safe_div(a - b, a + b)


def evi(nir, red, blue) -> Column:
    """Enhanced vegetation index ``2.5 * (N - R) / (N + 6R - 7.5B + 1)``."""
    nir, red, blue = _c(nir), _c(red), _c(blue)
    return F.lit(2.5) * safe_div(nir - red, nir + F.lit(6.0) * red - F.lit(7.5) * blue + F.lit(1.0))


def bsi(swir1, red, nir, blue) -> Column:
    """Bare-soil index ``((S1 + R) - (N + B)) / ((S1 + R) + (N + B))``."""
    s, r, n, b = _c(swir1), _c(red), _c(nir), _c(blue)
    return safe_div((s + r) - (n + b), (s + r) + (n + b))


def index_columns(prefix: str = "") -> dict[str, Column]:
    """The six spectral indices over columns ``BLUE..SWIR2`` (optionally prefixed)."""
    B, G, R, N, S1, S2 = (F.col(prefix + n) for n in BAND_NAMES)
    return {
        "NDVI": norm_diff(N, R),
        "EVI": evi(N, R, B),
        "NDWI": norm_diff(G, N),
        "NBR": norm_diff(N, S2),
        "BSI": bsi(S1, R, N, B),
        "NDSI": norm_diff(G, S1),
    }


def eligible_sensor(sensor, year) -> Column:
    """True when ``sensor`` flew in ``year`` according to ``SENSOR_ERAS``."""
    sensor, year = _c(sensor), _c(year)
    cond = F.lit(False)
    for name, (lo, hi) in SENSOR_ERAS.items():
        c = sensor == name
        if lo is not None:
            c = c & (year >= lo)
        if hi is not None:
            c = c & (year <= hi)
        cond = cond | c
    return cond


def sensors_for_year(year) -> Column:
    """Comma-joined eligible sensors for ``year`` (e.g. ``"L7,L8"``)."""
    year = _c(year)
    parts = []
    for name, (lo, hi) in SENSOR_ERAS.items():
        c = F.lit(True)
        if lo is not None:
            c = c & (year >= lo)
        if hi is not None:
            c = c & (year <= hi)
        parts.append(F.when(c, F.lit(name)))
    return F.concat_ws(",", *parts)


def month_day_in(month, day, start=SEASON_START, end=SEASON_END) -> Column:
    """``[start, end)`` test on (month, day) pairs inside one year.

    Works without building a date, so 29 February in a non-leap year
    cannot raise under ANSI mode.
    """
    md = _c(month) * 100 + _c(day)
    return (md >= start[0] * 100 + start[1]) & (md < end[0] * 100 + end[1])


def date_in(d, start, end) -> Column:
    """Half-open date range ``start <= d < end``."""
    d = _c(d)
    return (d >= F.lit(start).cast("date")) & (d < F.lit(end).cast("date"))


def harmonised_band(name: str, sensor="sensor") -> Column:
    """Common band ``name`` picked from the sensor's raw band columns."""
    i = BAND_NAMES.index(name)
    return F.when(_c(sensor).isin("L5", "L7"), F.col(BANDS_L5_L7[i])).otherwise(F.col(BANDS_L8_L9[i]))
