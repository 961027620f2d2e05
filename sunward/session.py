"""Session settings the library is designed for."""

import os

from pyspark.sql import SparkSession


# HotSpot does not compile methods over 8000 bytes of bytecode. Spark fuses up to 64 KB by
# default, so long physics expressions would run interpreted; above this limit Spark falls
# back to several smaller compiled stages instead.
RUNTIME_SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the expressions of this library are written for."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores="*", shuffle_partitions=8, app="sunward") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return prepare(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SUNWARD_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
        .getOrCreate()
    )
