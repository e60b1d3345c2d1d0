"""Hand cases for the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from terrapix.functions import (
    clear_sky,
    eligible_sensor,
    evi,
    month_day_in,
    norm_diff,
    path_year,
    reflectance,
    sensors_for_year,
    year_list,
)


def one(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_qa_bits(spark):
    # bits 1, 3, 4, 5 mask; bits 0, 2, 6, 7 do not
    vals = [1 << b for b in range(8)] + [0, 66, 64]
    got = one(spark, clear_sky("qa"), "qa int", [(v,) for v in vals])
    assert got == [True, False, True, False, False, False, True, True, True, False, True]


def test_reflectance_scale_and_clamp(spark):
    got = one(spark, reflectance("dn"), "dn long", [(0,), (7273,), (20000,), (50000,), (None,)])
    assert got[0] == 0.0
    assert got[1] == pytest.approx(7273 * 0.0000275 - 0.2)
    assert got[2] == pytest.approx(0.35)
    assert got[3] == 1.0
    assert got[4] is None


def test_reflectance_keeps_nan(spark):
    got = one(spark, reflectance("x"), "x double", [(float("nan"),)])
    assert math.isnan(got[0])


def test_zero_denominators(spark):
    got = one(spark, norm_diff("a", "b"), "a double, b double", [(0.0, 0.0), (0.3, 0.1)])
    assert got == [0.0, pytest.approx(0.5)]
    # N + 6R - 7.5B + 1 == 0 -> 0
    got = one(spark, evi("n", "r", "b"), "n double, r double, b double", [(0.5, 0.0, 0.2), (0.4, 0.1, 0.1)])
    assert got[0] == 0.0
    assert got[1] == pytest.approx(2.5 * 0.3 / (0.4 + 0.6 - 0.75 + 1))


@pytest.mark.parametrize("sensor,year,ok", [
    ("L5", 2011, True), ("L5", 2012, False), ("L7", 1998, False), ("L7", 1999, True),
    ("L7", 2012, True), ("L8", 2012, False), ("L8", 2013, True), ("L9", 2021, False), ("L9", 2022, True),
])
def test_sensor_eras(spark, sensor, year, ok):
    assert one(spark, eligible_sensor("s", "y"), "s string, y int", [(sensor, year)]) == [ok]


def test_sensors_for_year(spark):
    got = one(spark, sensors_for_year("y"), "y int", [(1998,), (1999,), (2012,), (2013,), (2022,)])
    assert got == ["L5", "L5,L7", "L7", "L7,L8", "L7,L8,L9"]


def test_season_window(spark):
    rows = [(5, 1), (4, 30), (9, 29), (9, 30), (2, 29), (7, 15)]
    got = one(spark, month_day_in("m", "d"), "m int, d int", rows)
    assert got == [True, False, True, False, False, True]


PATHS = [
    ("/d/x/2008_agate_mcp.shp", 2008),
    ("/d/x/ter1996.shp", 1996),
    ("/d/x/2000_all.shp", 2000),
    ("/d/x/pack_2007.shp", 2007),
    ("/d/x/pack_2007_mcp.shp", 2007),
    ("/d/2013 mcps/agate.shp", 2013),
    ("/d/2014 MCPs/agate.shp", 2014),
    ("/d/2021 Wolf Territory/agate.shp", 2021),
    ("/d/2022_Wolf Territories/agate.shp", 2022),
    ("/d/2008/agate.shp", 2008),
    ("/d/x/1990_agate.shp", None),          # out of range, nothing else
    ("/d/wolves 2019 final/agate.shp", 2019),  # tier 3: free 4-digit run
    ("/d/agate2015.shp", 2015),             # tier 3
    ("/d/x/ter1990_2005.shp", 2005),        # first hit out of range, later pattern wins
    ("/d/none/agate.shp", None),
    ("/d/1999 and 2003 survey/x.shp", 2003),  # tier 3 skips a run after '/'
]


def test_path_year(spark):
    got = one(spark, path_year("p"), "p string", [(p,) for p, _ in PATHS])
    assert got == [y for _, y in PATHS]


def test_year_list():
    assert year_list([1995, 1996]) == [1995, 1996]
    assert year_list({"start": 2016, "end": 2019}) == [2016, 2017, 2018]
    assert year_list("2019-2023") == [2019, 2020, 2021, 2022]
    with pytest.raises(ValueError):
        year_list(2019)


def test_in_years_pushed_to_scan(spark, tmp_path):
    from terrapix.functions import in_years

    p = str(tmp_path / "t")
    spark.range(100).select((F.col("id") % 30 + 1995).cast("int").alias("year")).write.parquet(p)
    plan = spark.read.parquet(p).filter(in_years("year", "2016-2019"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "In(year, [2016,2017,2018])" in plan
