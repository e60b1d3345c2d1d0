"""Session helpers."""

from __future__ import annotations

from pyspark.sql import SparkSession

from terrapix.sources.store import checkpoint_root


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "terrapix") -> SparkSession:
    """A local session for tests and benchmarks (clusters bring their own)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark
