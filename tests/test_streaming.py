"""The streaming ingest produces the same rows as the batch observation stage."""

from conftest import SF001
from terrapix.operators.observe import spectral_observations
from terrapix.sources import fixtures as fx
from terrapix.streaming import RAW_OBS_SCHEMA, ingest_observations, observation_stream


def test_stream_equals_batch(spark, tmp_path):
    raw = fx.raw_obs(spark, SF001).select(*[f.name for f in RAW_OBS_SCHEMA.fields])
    src = str(tmp_path / "incoming")
    raw.repartition(4).write.parquet(src)
    out = str(tmp_path / "observations")
    ingest_observations(observation_stream(spark, src, max_files_per_trigger=1), out).awaitTermination(300)
    got = spark.read.parquet(out)
    want = spectral_observations(raw)
    cols = sorted(want.columns)
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert want.select(cols).exceptAll(got.select(cols)).count() == 0
    # A second table gets all rows too, and a second run over the first adds none.
    other = str(tmp_path / "other")
    ingest_observations(observation_stream(spark, src), other).awaitTermination(300)
    ingest_observations(observation_stream(spark, src), out).awaitTermination(300)
    assert spark.read.parquet(other).count() == spark.read.parquet(out).count() == want.count()
