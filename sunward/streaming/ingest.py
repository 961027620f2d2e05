"""Bounded ingestion of growing tables.

A directory that gains Parquet files is read in bounded batches; finished
files are remembered in the checkpoint, so a restarted run resumes where it
stopped instead of reading everything again. Nothing is aggregated on the
way: no row can arrive too late to be kept.
"""

from pyspark.sql import DataFrame, SparkSession, types as T


def new_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 64) -> DataFrame:
    """Streaming scan of a Parquet directory, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write everything available now in bounded batches, then return."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start(path)
    query.awaitTermination()
