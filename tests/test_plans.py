"""Physical-plan checks: pushdown, pruning, top-k, no Python, no nested loops."""

from conftest import SF001
from terrapix.operators import catalog, composite, observe
from terrapix.sources import fixtures as fx


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    p = observe.spectral_observations(fx.raw_obs(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    schema = p.split("ReadSchema: ")[1].split("\n")[0]
    assert "l_quantity" not in schema and "l_returnflag" not in schema and "l_orderkey" in schema


def test_top_k_uses_window_group_limit(spark):
    s = fx.scenes(spark, SF001)
    p = plan(catalog.least_cloudy(s, fx.aoi(spark, SF001)))
    assert "WindowGroupLimit" in p


def test_spatial_join_is_an_equi_join(spark):
    p = plan(catalog.aoi_scenes(fx.scenes(spark, SF001), fx.aoi(spark, SF001)))
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p


def test_composite_has_no_python(spark):
    c = composite.yearly_composite(observe.spectral_observations(fx.raw_obs(spark, SF001)))
    p = plan(c)
    for bad in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert bad not in p
