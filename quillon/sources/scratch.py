"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple, tuple] = {}


def root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one only where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _write(df: DataFrame) -> str:
    """The folder of ``df`` as a table; what was shuffled for it is garbage then, which the driver is asked to collect, so that no disk keeps it."""
    path = f"{root(df.sparkSession)}/quillon-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    return path


def written(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``build()``, written when the session first asks for ``key`` and read from there later."""
    place = (spark.sparkContext.applicationId, *key)
    if place not in _WRITTEN:
        df = build()
        _WRITTEN[place] = _write(df), df.schema
    path, schema = _WRITTEN[place]
    return spark.read.schema(schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """``df``, written and read back."""
    return df.sparkSession.read.schema(df.schema).parquet(_write(df))
