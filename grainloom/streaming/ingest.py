"""Ingest of corpus parts as a stream: each new file is filtered once; progress is the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from grainloom.operators import filters


def ingest_parts(spark: SparkSession, source: str, schema: StructType | str, sink: str, checkpoint: str, files_per_trigger: int = 16) -> None:
    """Filter the parquet files of a folder that no earlier call has seen, and append what passes to ``sink``.

    Runs until the present files are done. A call that is repeated after a loss takes up where the checkpoint ends.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    kept = filters.apply_filters(stream)
    query = kept.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def reason_counts(stream: DataFrame) -> DataFrame:
    """Running counts of drop reasons of a stream of filtered documents."""
    return filters.filter_funnel(stream, "subset")
