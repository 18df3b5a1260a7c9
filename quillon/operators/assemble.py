"""Long and wide forms, unions, upserts, resumption."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.checks import require, together, unique
from quillon.sources import scratch


def namespaced(df: DataFrame, prefix: str, fields: list[str], keys: list[str]) -> DataFrame:
    """Keys and the fields that ``df`` has, renamed prefix__field."""
    return df.select(*keys, *[F.col(f).alias(f"{prefix}__{f}") for f in fields if f in df.columns])


def widened(base: DataFrame, long: DataFrame, cell: str, cells: list[str], fields: list[str], key: str = "query_id") -> DataFrame:
    """``base`` with the fields of each cell as cell__field: one aggregation for all cells instead of a join each."""
    picked = [F.first(F.when(F.col(cell) == c, F.col(f)), ignorenulls=True).alias(f"{c}__{f}") for c in cells for f in fields]
    return base.join(long.where(F.col(cell).isin(cells)).groupBy(key).agg(*picked), key, "left")


def lengthened(wide: DataFrame, cells: dict[str, dict[str, str]], keys: list[str]) -> DataFrame:
    """One row per key and cell; ``cells`` maps a cell's name to its columns by field."""
    fields = list(next(iter(cells.values())))
    rows = F.array(*[F.struct(F.lit(name).alias("cell"), *[F.col(columns[f]).alias(f) for f in fields]) for name, columns in cells.items()])
    return wide.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def stacked(*frames: DataFrame) -> DataFrame:
    """Union by name; columns that lack are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def upserted(*batches: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the latest batch for each key; earlier batches come first."""
    rows = stacked(*[b.withColumn("_batch", F.lit(i)) for i, b in enumerate(batches)])
    latest = Window.partitionBy(*keys).orderBy(F.desc("_batch"))
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "_batch")


def succeeded(prior: DataFrame, error: str) -> DataFrame:
    return prior.where(F.coalesce(F.col(error), F.lit("")) == "")


def pending(work: DataFrame, prior: DataFrame, keys: list[str], error: str) -> DataFrame:
    """Rows of ``work`` without a prior row that succeeded."""
    return work.join(succeeded(prior, error).select(*keys), keys, "left_anti")


def cohort(rows: DataFrame, packaged: DataFrame, keys: tuple[str, ...] = ("question", "golden_answer")) -> DataFrame:
    """Rows whose keys, as text, occur in ``packaged``."""
    on = [F.col(f"a.{k}").cast("string") == F.col(f"b.{k}").cast("string") for k in keys]
    return rows.alias("a").join(packaged.select(*keys).alias("b"), on, "left_semi")


def lookup(rows: DataFrame, table: DataFrame, key: str, value: str, order: str | Column, name: str) -> DataFrame:
    """``rows`` with a value by key; of repeated keys the last in ``order`` wins."""
    last = table.groupBy(key).agg(F.max_by(value, order).alias(name))
    return rows.join(last, key, "left")


def aligned(rows: DataFrame, source: DataFrame, ordinal: str, key: Column, source_key: Column) -> DataFrame:
    """Source ordinal of each row: by position where the keys agree, else by a key that is unique; null if neither."""
    s = source.select(F.col(ordinal).alias("_o"), source_key.alias("_k"))
    unique = s.groupBy("_k").agg(F.count(F.lit(1)).alias("_c"), F.min("_o").alias("_u")).where("_c = 1").select("_k", "_u")
    df = rows.withColumn("_key", key).join(s.select(F.col("_o").alias("_p"), F.col("_k").alias("_pk")), F.col(ordinal) == F.col("_p"), "left")
    df = df.join(unique, F.col("_key") == F.col("_k"), "left")
    return df.withColumn("matched_row", F.when(F.col("_pk") == F.col("_key"), F.col("_p")).otherwise(F.col("_u"))).drop("_p", "_pk", "_k", "_u", "_key")


def ordered_list(df: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """Distinct values of each group in order of their first occurrence."""
    rows = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(group).agg(F.array_distinct(F.transform(rows, lambda x: x[value])).alias(name))


def by_enumeration(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Sorted as ``values`` enumerates them, the others last."""
    at = F.array_position(F.array(*map(F.lit, values)), F.col(column))
    return df.orderBy(F.when(at == 0, len(values) + 1).otherwise(at), column)


def ordinals(df: DataFrame, group: str, order: str | Column, name: str = "source_row", keep: Callable[[DataFrame], DataFrame] = scratch.kept) -> DataFrame:
    """Running number from 0 within each group, without a group having to fit into a task.

    The rows are range-partitioned by group, order and a number of their own, so that neither one group nor many equal
    places make a large partition. A row's number is its place in its partition, less the place where its group begins there, plus the rows of the
    group in the partitions before; the counts for that are a row for each partition and group. ``keep`` writes the sorted rows, which are read
    twice: a range partitioning that is worked out again may fall differently.
    """
    place = F.monotonically_increasing_id()
    line = df.withColumn("_order", F.col(order) if isinstance(order, str) else order).withColumn("_own", place)
    line = line.repartitionByRange(group, "_order", "_own").sortWithinPartitions(group, "_order", "_own").drop("_order", "_own")
    line = keep(line.withColumn("_part", F.spark_partition_id()).withColumn("_place", place.bitwiseAND(F.lit((1 << 33) - 1))))
    counts = line.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    out = line.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_p")))
    return out.withColumn(name, (F.col("_place") + F.col("_start")).cast("long")).select(*[c for c in df.columns if c != name], name)


def matched(a: DataFrame, b: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("", "_other")) -> DataFrame:
    """The inner join of two tables in which each key occurs once; columns that both have get a suffix each. Raises on repeated keys."""
    require(together(unique(a, keys), unique(b, keys)))
    both = set(a.columns) & set(b.columns) - set(keys)
    named = lambda df, suffix: df.withColumnsRenamed({c: c + suffix for c in both})
    return named(a, suffixes[0]).join(named(b, suffixes[1]), keys)


def differing(joined: DataFrame, columns: list[str], suffixes: tuple[str, str] = ("", "_other")) -> DataFrame:
    """Rows of ``matched`` whose columns of the same name differ, nulls being equal."""
    return joined.where(reduce(lambda x, y: x | y, [~F.col(c + suffixes[0]).eqNullSafe(F.col(c + suffixes[1])) for c in columns]))


def by_position(a: DataFrame, b: DataFrame, group: str, order_a: str, order_b: str, same: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, faults): the n-th row of each group beside the n-th of the other table, in orders that both tables name, and the places
    where a row lacks on one side or columns of ``same`` differ. Places are explicit numbers, never those in a file."""
    x, y = ordinals(a, group, order_a, "_at"), ordinals(b, group, order_b, "_at")
    y = y.select("_at", group, *[F.col(c).alias(f"_{c}") for c in same], *[c for c in b.columns if c not in a.columns], F.lit(True).alias("_there"))
    j = x.withColumn("_here", F.lit(True)).join(y, [group, "_at"], "full_outer")
    wrong = reduce(lambda p, q: p | q, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same], F.col("_here").isNull() | F.col("_there").isNull())
    helpers = ["_here", "_there", *[f"_{c}" for c in same]]
    return j.where(~wrong).drop("_at", *helpers), j.where(wrong).select(group, F.col("_at").alias("position"))
