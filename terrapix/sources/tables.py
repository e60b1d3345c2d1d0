"""Readers for the driver's parquet tables and for our own datasets."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Schema of a published training-sample table (one row per sampled pixel-year).
SAMPLE_SCHEMA = T.StructType(
    [T.StructField("year", T.IntegerType()), T.StructField("presence", T.IntegerType()),
     T.StructField("nlcd_class", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in
       ("BLUE", "GREEN", "RED", "NIR", "SWIR1", "SWIR2", "NDVI", "EVI", "NDWI", "NBR", "BSI", "NDSI")]
)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan one driver table; ``columns`` prunes the Parquet read schema."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def read_samples(spark: SparkSession, path: str, schema: T.StructType = SAMPLE_SCHEMA) -> DataFrame:
    """Scan a training-sample directory with a declared schema (no inference).

    ``year`` may be a partition directory (``year=1995/``) or a data column;
    with the former, ``year`` filters prune whole directories.
    """
    return spark.read.schema(schema).parquet(path)
