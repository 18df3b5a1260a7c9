"""Calls that fail are tried again later: a keyed record of each row's attempts, and timers for its back-off."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What stands beside a row on its way: which attempt comes next, and when, in milliseconds (0: at once).
WAY = {"attempt": IntegerType(), "due_ms": LongType()}


class Attempts(StatefulProcessor):
    """Lets each attempt of a key through once, when it is due.

    A key's record is the last attempt that was let through. A row whose attempt isn't the next one is a repeat,
    of the input or of a batch that was run again, and is dropped; of several rows with one attempt the first counts. A row
    that isn't due yet waits in the state with a timer.
    """

    def __init__(self, schema: StructType) -> None:
        self.schema, self.columns = schema, schema.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "attempt int")
        self.waiting = handle.getValueState("waiting", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else -1
        waits = self.waiting.exists()
        for row in rows:
            if waits or row["attempt"] != last + 1:
                continue
            if row["due_ms"] <= timerValues.getCurrentProcessingTimeInMs():
                last = row["attempt"]
                self.last.update((last,))
                yield row
            else:
                waits = True
                self.waiting.update(tuple(row[c] for c in self.columns))
                self.handle.registerTimer(row["due_ms"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.waiting.exists():
            row = Row(*self.columns)(*self.waiting.get())
            self.waiting.clear()
            self.last.update((row["attempt"],))
            yield row

    def close(self) -> None:
        pass


def _has_rows(spark: SparkSession, path: str, schema: str) -> bool:
    """Whether ``path`` exists and holds a row; asked through a read, so it may be in any store that Spark knows."""
    try:
        return not spark.read.schema(schema).parquet(path).isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def retried(stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, keys: list[str], error: str, most: int = 4, wait_ms: int = 2000, every: str = "1 second", partitions: int | None = None) -> StreamingQuery:
    """A running query that puts each row of ``stream`` through ``step``, at most ``most`` times.

    ``step`` returns a row for each of its rows: the keys, ``error`` and what else a result has. A row with an error comes again
    after ``wait_ms``, then twice and four times that, and so on; meanwhile it rests in keyed state and no task sleeps. Its last error
    stays. Results are in ``path/results``, one row a key (``results`` reads them). A batch's replies are written before anything
    else, and a batch that runs again, after the driver was lost, takes them from there: what was answered isn't asked twice;
    only calls whose replies weren't written yet are repeated. Null keys are a key like others; rows that repeat a
    key count once. A key's state is one number for as long as ``path`` is kept; it holds the row only while the row waits. ``partitions`` of the
    state (the session's shuffle partitions otherwise) stay as they are for as long as ``path`` is kept.
    """
    spark, way = stream.sparkSession, StructType(list(stream.schema.fields))
    for name, kind in WAY.items():
        way.add(name, kind)
    spark.createDataFrame([], way).write.mode("append").parquet(f"{path}/again")
    work, columns = stream.columns, [*stream.columns, "attempt", "due_ms"]
    first = stream.select("*", F.lit(0).alias("attempt"), F.lit(0).cast("long").alias("due_ms"))
    again = spark.readStream.schema(way).parquet(f"{path}/again").select(*columns)

    def batch(df: DataFrame, number: int) -> None:
        session, place, mark = df.sparkSession, f"{path}/replies/batch={number}", f"{path}/answered/batch={number}"
        df.write.mode("overwrite").parquet(f"{path}/due")  # the state is gone through once, whatever follows
        due = session.read.schema(df.schema).parquet(f"{path}/due")
        if due.isEmpty():
            return
        if not _has_rows(session, mark, "id long"):
            rows = due.select(F.struct(*work).alias("row"), "attempt", *[F.col(k).alias(f"_{k}") for k in keys])
            replies = step(due.select(*work))
            out = replies.select(F.struct(*replies.columns).alias("result"), (F.coalesce(F.col(error), F.lit("")) != "").alias("failed"), *[F.col(k).alias(f"_{k}") for k in keys])
            same = [F.col(f"r._{k}").eqNullSafe(F.col(f"o._{k}")) for k in keys]
            met = rows.alias("r").join(out.alias("o"), same).select("row", "attempt", "result", "failed")
            met.withColumn("at_ms", F.lit(int(time.time() * 1000))).write.mode("overwrite").parquet(place)
            session.range(1).write.mode("overwrite").parquet(mark)
        replies = session.read.parquet(place)
        final = ~F.col("failed") | (F.col("attempt") + 1 >= most)
        replies.where(final).select("result.*", (F.col("attempt") + 1).alias("attempts")).write.mode("overwrite").parquet(f"{path}/results/batch={number}")
        later = (F.col("at_ms") + F.lit(wait_ms) * F.pow(F.lit(2.0), F.col("attempt"))).cast("long").alias("due_ms")
        replies.where(~final).select("row.*", (F.col("attempt") + 1).alias("attempt"), later).write.mode("append").parquet(f"{path}/again")

    wanted = {PROVIDER: ROCKSDB} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)  # a query keeps the settings that it starts with
    try:
        due = first.union(again).groupBy(*keys).transformWithState(Attempts(way), way, "Append", "ProcessingTime")
        return due.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/state").trigger(processingTime=every).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that are done, with columns ``schema`` of the step and the number of their attempts."""
    return spark.read.schema(f"{schema}, attempts int").option("recursiveFileLookup", "true").parquet(f"{path}/results")


def settled(query: StreamingQuery, spark: SparkSession, path: str, schema: str, rows: int, seconds: float) -> DataFrame:
    """The results once there are ``rows`` of them, for inputs whose number of keys is known; the query is stopped then."""
    end = time.monotonic() + seconds
    try:
        while time.monotonic() < end:
            if query.awaitTermination(1):
                raise RuntimeError("the query ended early")
            if _has_rows(spark, f"{path}/results/batch=*", schema) and results(spark, path, schema).count() >= rows:
                return results(spark, path, schema)
        raise TimeoutError(f"fewer than {rows} results after {seconds} s")
    finally:
        query.stop()
