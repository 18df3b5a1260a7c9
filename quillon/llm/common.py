"""What the operators of this subpackage share: scratch tables, connected components, text keys.

Nothing here keeps data on a driver or on an executor's own disk: lineage is cut by
Parquet tables in the folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources import scratch

#: ASCII white space, as the contracts of the operators have it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame, spark: SparkSession) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: a lost executor loses none of it.

    What was shuffled on the way is garbage then; the driver is asked to collect it, so that the executors'
    disks don't keep it until memory runs short.
    """
    path = f"{scratch.root(spark)}/quillon-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxed(docs: DataFrame, **keys: Column) -> DataFrame:
    """``docs`` with each row in one struct ``row``, beside ``keys``, so that no name of a column can clash; ``row.*`` opens it."""
    return docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in keys.items()])


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the documents that no model learns from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, spark: SparkSession, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(id, component)``, component the smallest id reachable.

    Alternates large-star and small-star steps, which need a number of rounds that
    grows with the logarithm of the longest chain; every round is two shuffles of
    the edges and ends in a written table. Ids without an edge to another id do not
    appear. Null ids are ignored.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    pairs = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), spark)
    for _ in range(rounds):
        # settled: every id either points to one smaller id or is pointed to
        ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up")))).alias("x"))
        if ends.groupBy("x.id").agg(F.sum("x.up").alias("up"), F.min("x.up").alias("low")).where("up > 1 OR (up = 1 AND low = 0)").isEmpty():
            break
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: the larger neighbours of each node move to the least of its neighbourhood
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.where("a <> b").distinct()
        # small star: the smaller neighbours, and the node itself, move to the least of them
        low = moved.groupBy("a").agg(F.min("b").alias("m"))
        near = moved.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = materialize(near.union(low.select("a", F.col("m").alias("b"))).distinct(), spark)
    else:
        raise RuntimeError("connected components did not settle")
    roots = pairs.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return roots.union(roots.select(F.col("component").alias("id"), "component").distinct())
