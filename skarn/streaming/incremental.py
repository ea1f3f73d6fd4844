"""Incremental scoring: files that arrive as a stream of rows are linted or scored batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from skarn.functions import text as X
from skarn.operators import prompts


def arrivals(spark: SparkSession, folder: str, schema: StructType, per_batch: int = 100) -> DataFrame:
    """Parquet files that land in a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def linted(stream: DataFrame, key: str, content: str) -> DataFrame:
    """Prompt lint of each row; stateless, so it streams as it is."""
    return prompts.lint(stream, key, content)


def sizes(stream: DataFrame, time: str, key: str, content: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Lines and tokens by window of arrival and key; rows later than ``late`` drop out and state is bounded by it."""
    rows = stream.withWatermark(time, late)
    return rows.groupBy(F.window(time, window), key).agg(F.count("*").alias("n"), F.sum(X.code_loc(F.col(content))).alias("loc"), F.sum(X.token_estimate(F.col(content))).alias("tokens"))


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``sink`` once for each batch; it must overwrite by batch number to be exactly-once."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
