"""Questions that arrive over time: a stream whose state is the checkpoint of rows that succeeded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillon.operators import assemble


def questions(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def processed(stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, schema: str, keys: list[str], error: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch: what has no row without an error at ``path`` goes through ``step`` and is appended.

    A batch that is replayed finds its rows there and adds none, so restarts are harmless. Keys are
    unique and no event time exists, so nothing waits for a watermark.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], schema).write.mode("append").parquet(path)

    def batch(df: DataFrame, _: int) -> None:
        prior = df.sparkSession.read.schema(schema).parquet(path)
        step(assemble.pending(df.dropDuplicates(keys), prior, keys, error)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
