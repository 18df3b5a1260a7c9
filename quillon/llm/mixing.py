"""Mixing sources to target weights by Pareto order sampling (operator 9): DataFrame functions only.

A source with target T and size S takes floor(T/S) certain whole copies of every
document. The rest, R words, is a Pareto order sample with unequal inclusion odds: a document's inclusion
probability p grows with its size, p = min(1, c * size), and c is such that R words are expected; documents with
p = 1 are certain. All others have the rank (u / (1-u)) / (p / (1-p)) with a keyed uniform number u, and documents
are taken in rank order, the certain ones first, until the next would overrun R; then those behind it that still fit,
in a second pass of the same kind. At the end one more document, the one whose size is nearest to what is left,
closes the gap, also where all that fit together stay under R. Only the documents of one narrow bin of ranks for each
source are sorted; a histogram of bins places all others, and c comes from a histogram of sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD, boxed, materialize, table

#: Bins of ranks on either side of rank 1, near which a sample ends; a source's sorted part is one bin.
BINS = 1 << 15
#: u has so many bits: 13 hexadecimal digits of an MD5.
U_BITS = 52
#: The order is gone through so often; what doesn't fit any more is passed over.
PASSES = 2


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str) -> Column:
    """The keyed 52-bit number behind u of a row; without an id it hangs on the text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.col("text").cast("binary"))), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name).cast("binary")), 1, 13), 16, 10).cast("long")


def measures(seed: str) -> dict[str, Column]:
    return {"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string"), "size": words_in(F.col("text")), "u": draw(seed)}


def targets(by_source: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target: shares by weight of all words, at most ``most`` times a source's size.

    Sources come in code point order, null last, and take the weights in turn. The excess of capped
    sources goes to the others by weight until none is above its cap. Reads one row for each source.
    """
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (((F.row_number().over(order) - 1) % len(weights)) + 1).cast("int"))
    t = by_source.withColumn("w", w).withColumn("cap", (F.col("source_size") * most).cast("long"))
    # the sources with the least cap for their weight reach it first: level k has the first k capped
    line = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = line.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    t = t.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))))  # never 0: its own weight is in it
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    t = t.withColumn("level", F.first(fits, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = F.least(F.col("cap").cast("double"), F.col("level") * F.col("w"))
    return t.select("source", "source_size", F.coalesce(share, F.col("cap").cast("double")).alias("target"))


def by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right``, which has a row for each source; null is a source too."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def inclusion(base: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, c): a document that fits has the inclusion probability min(1, c * size); no row if all that fit are certain.

    With the sizes in falling order, the first size that isn't certain gives c: of the words left beside all
    larger documents, a share in proportion to size is expected from this one and the smaller ones.
    """
    before = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    n = base.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    n = by_source(n, plan.select("source", "rest")).where("size <= rest")
    square = F.col("n").cast("decimal(18,0)") * F.col("size").cast("decimal(10,0)") * F.col("size").cast("decimal(10,0)")
    larger = F.coalesce(F.sum(F.col("n") * F.col("size")).over(before), F.lit(0))
    square = F.sum(square).over(Window.partitionBy("source")) - F.coalesce(F.sum(square).over(before), F.lit(0))
    c = (F.col("rest") - larger) / square.cast("double")
    return n.withColumn("c", c).where(F.col("c") * F.col("size") < 1).groupBy("source").agg(F.max_by("c", "size").alias("c"))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows(size, rest, u, c)`` with fits, p, rank and its bin; rank and bin are null where a document can't be in the sample."""
    unit = (F.col("u") + 0.5) / float(1 << U_BITS)
    rows = rows.withColumn("fits", (F.col("size") > 0) & (F.col("size") <= F.col("rest")))
    rows = rows.withColumn("p", F.when(F.col("fits"), F.coalesce(F.least(F.lit(1.0), F.col("c") * F.col("size")), F.lit(1.0))))
    rows = rows.withColumn("rank", F.when(F.col("p") >= 1, F.lit(0.0)).when(F.col("fits"), (unit / (1 - unit)) * (1 - F.col("p")) / F.col("p")))
    # BINS is a power of two and division rounds in one direction, so bins keep the order of ranks
    return rows.withColumn("bin", F.when(F.col("rank") < 1, F.floor(F.col("rank") * float(BINS))).when(F.col("fits"), 2 * BINS - F.floor(F.try_divide(F.lit(float(BINS)), F.col("rank")))).cast("long"))


def cut_off(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """(source, out, words): the place where the words of ``rows(source, left, bin, place, size)`` first exceed ``left``, null if nowhere, and the words before it."""
    bins = materialize(rows.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.min("left").alias("left")), spark)
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = bins.withColumn("before", before).groupBy("source").agg(F.min(F.when(F.col("before") + F.col("words") > F.col("left"), F.struct("bin", "before"))).alias("cut"), F.sum("words").alias("all"))
    ends = materialize(ends, spark)
    edge = by_source(rows, ends.where("cut IS NOT NULL").select("source", "cut")).where(F.col("bin") == F.col("cut.bin"))
    edge = edge.withColumn("upto", F.col("cut.before") + F.sum("size").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    out = edge.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min("place").alias("out"))
    inner = by_source(edge, out).where(F.col("place") < F.col("out")).groupBy("source").agg(F.sum("size").alias("inner"))
    ends = by_source(by_source(ends, out, "left"), inner, "left")
    return ends.select("source", "out", F.coalesce(F.col("cut.before") + F.coalesce("inner", F.lit(0)), F.col("all")).alias("words"))


def mix(docs: DataFrame, spark: SparkSession, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken (= copies * size).

    Null text has size 0; documents of size 0 take the whole copies only. Null is a source of its own,
    the last. Rows without an id draw u by their text. Ties of rank go by doc_id, then size; rows that agree in
    all of these are taken or left together. An empty table gives an empty result. Other columns are not read. No document
    takes more than ``most`` copies. The same rows give the same result in any order and partitioning.
    """
    return mixed(docs, spark, seed, weights, most).drop("source", "p", "u")


def mixed(docs: DataFrame, spark: SparkSession, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of ``mix`` with their source, u, and p, the probability of a copy beyond the whole ones (null: can't be in the sample)."""
    base = materialize(docs.select(*[c.alias(k) for k, c in measures(seed).items()]), spark)
    plan = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.try_divide("target", "source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = materialize(plan, spark)
    plan = materialize(by_source(plan, inclusion(base, plan), "left"), spark)
    rows = ranked(by_source(base, plan)).withColumn("place", F.struct("rank", "doc_id", "size"))
    state, inside = plan.select("source", F.col("rest").alias("left0")), F.lit(False)
    for k in range(PASSES):
        open_now = F.col("fits") & (F.col("size") <= F.col(f"left{k}")) & ~inside
        ends = cut_off(by_source(rows, state).where(open_now).withColumn("left", F.col(f"left{k}")), spark)
        state = by_source(state, ends.select("source", F.col("out").alias(f"out{k}"), "words"), "left")
        state = materialize(state.withColumn(f"left{k + 1}", F.col(f"left{k}") - F.coalesce("words", F.lit(0))).drop("words"), spark)
        inside = inside | (open_now & (F.col(f"out{k}").isNull() | (F.col("place") < F.col(f"out{k}"))))
    gap = F.col(f"left{PASSES}")
    key, miss = F.struct("u", F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "size"), F.abs(F.col("size") - gap)
    last = by_source(rows, state).where((F.col("size") > 0) & ~inside & (miss < gap)).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), key.alias("key"))).alias("last"))
    state = materialize(by_source(state, last, "left"), spark)
    extra = (inside & (F.col("rest") > 0)) | F.coalesce(key == F.col("last.key"), F.lit(False))
    copies = F.least(F.col("whole") + extra.cast("int"), F.lit(most)).cast("long")
    return by_source(rows, state).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "p", "u")


def mixed_rows(docs: DataFrame, spark: SparkSession, seed: str = "mix", **kw) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all columns stay, and may have any other names.

    Null texts and empty ones take a source's whole copies. Rows that repeat an id, or have none, go by their own
    source and size. An empty table gives an empty result.
    """
    keys = list(measures(seed))
    take = mixed(docs, spark, seed, **kw).groupBy(*keys).agg(F.max("copies").alias("copies")).where("copies > 0").alias("take")
    same = [F.col(f"rows.{k}").eqNullSafe(F.col(f"take.{k}")) for k in keys]
    joined = boxed(docs, **measures(seed)).alias("rows").join(take, same)
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), spark)


ORACLE = r"""
WITH b AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(text), '')), 1, 13) AS BIGINT) AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap FROM b GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level FROM w),
f AS (SELECT min_by(level, cap / w) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), f.level * w), CAST(cap AS DOUBLE)) AS target FROM l LEFT JOIN f ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT *, greatest(0.0, target - whole * source_size) AS rest FROM p),
h AS (SELECT r.source, rest, size, count(*) AS n FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source WHERE size > 0 AND size <= rest GROUP BY ALL),
i AS (SELECT source, size, (rest - CAST(coalesce(sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
  / CAST(sum(n * size * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS c FROM h),
j AS (SELECT source, max_by(c, size) AS c FROM i WHERE c * size < 1 GROUP BY source),
x AS (SELECT b.*, source_size, target, whole, rest, (u + 0.5) / 4503599627370496.0 AS unit, size > 0 AND size <= rest AS fits, coalesce(least(1.0, c * size), 1.0) AS share
  FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source LEFT JOIN j ON b.source IS NOT DISTINCT FROM j.source),
k AS (SELECT *, CASE WHEN fits THEN CASE WHEN share >= 1 THEN 0.0 ELSE (unit / (1 - unit)) * (1 - share) / share END END AS rank FROM x),
c AS (SELECT *, CASE WHEN fits THEN sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) END AS upto FROM k),
o AS (SELECT source, min(row(rank, doc_id, size)) AS cut FROM c WHERE rest > 0 AND upto > rest GROUP BY source),
n AS (SELECT c.*, rest > 0 AND fits AND (o.cut IS NULL OR row(rank, doc_id, size) < o.cut) AS inside FROM c LEFT JOIN o ON c.source IS NOT DISTINCT FROM o.source),
g AS (SELECT source, any_value(rest) - sum(CASE WHEN inside THEN size ELSE 0 END) AS gap FROM n GROUP BY source),
a AS (SELECT n.*, gap, fits AND NOT inside AND size <= gap AS again FROM n JOIN g ON n.source IS NOT DISTINCT FROM g.source),
d AS (SELECT *, sum(CASE WHEN again THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto2 FROM a),
q AS (SELECT source, min(row(rank, doc_id, size)) AS cut FROM d WHERE again AND upto2 > gap GROUP BY source),
v AS (SELECT d.* EXCLUDE (gap), inside OR (again AND (q.cut IS NULL OR row(rank, doc_id, size) < q.cut)) AS taken FROM d LEFT JOIN q ON d.source IS NOT DISTINCT FROM q.source),
y AS (SELECT source, any_value(rest) - sum(CASE WHEN taken THEN size ELSE 0 END) AS gap FROM v GROUP BY source),
z AS (SELECT v.source, min(row(abs(size - gap), u, doc_id, size)) AS best FROM v JOIN y ON v.source IS NOT DISTINCT FROM y.source WHERE NOT taken AND size > 0 AND abs(size - gap) < gap GROUP BY v.source),
m AS (SELECT v.*, least(3, whole + CASE WHEN taken OR (u = z.best[2] AND doc_id = z.best[3]) THEN 1 ELSE 0 END) AS copies FROM v LEFT JOIN z ON v.source IS NOT DISTINCT FROM z.source)
SELECT doc_id, size, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(copies * size AS BIGINT) AS taken FROM m
"""
