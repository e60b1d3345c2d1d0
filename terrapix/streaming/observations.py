"""Incremental ingest of scene observations.

Only the stateless observation stage runs on a stream: season / cloud /
sensor / QA filters, band harmonisation, scaling and indices are per-row
expressions, so the same functions apply to a streaming DataFrame.  The
composite (a median over a whole season) stays a batch job over the
ingested table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from terrapix.operators.observe import spectral_observations

RAW_OBS_SCHEMA = T.StructType([
    T.StructField("scene_id", T.LongType()), T.StructField("sensor", T.StringType()),
    T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType()),
    T.StructField("day", T.IntegerType()), T.StructField("pixel_id", T.IntegerType()),
    T.StructField("cloud_cover", T.DoubleType()), T.StructField("qa_pixel", T.IntegerType()),
    *[T.StructField(f"b{i}", T.LongType()) for i in range(1, 8)],
])


def observation_stream(spark: SparkSession, source_dir: str, schema: T.StructType = RAW_OBS_SCHEMA,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of eligible, scaled and indexed observations from
    Parquet files arriving under ``source_dir``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return spectral_observations(reader.parquet(source_dir))


def ingest_observations(stream: DataFrame, out_path: str, available_now: bool = True) -> StreamingQuery:
    """Append the stream to a year-partitioned Parquet table.

    Progress is kept beside the table it describes (``_progress``, a name that
    readers skip), so a restarted job resumes where that table stopped and
    another table starts from the beginning.  ``available_now`` processes what
    is there and stops.
    """
    ck = f"{out_path.rstrip('/')}/_progress"
    w = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", ck).partitionBy("year"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(out_path)
