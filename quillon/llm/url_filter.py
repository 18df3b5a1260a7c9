"""URL filter (operator 7): a blocked Bloom filter passes possible hits to an exact hash join.

The listed entries are pairs of host and path prefix. Of each URL the candidates are all
parent domains of its host with those prefixes of its path whose length occurs in the list.
The filter, of a bounded number of bytes, is broadcast and drops nearly all candidates that are not
listed; the join with the list decides on the rest, so false positives cannot show.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import shuffle_width, table

#: (verdict, host, path); the fixed list of the query.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
BLOCK_WORDS = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def entry_key(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def bloom_words(keys: DataFrame, spark: SparkSession, bits_per_key: int = 16, most_bytes: int = 64 << 20, hashes: tuple[str, str] = ("xxhash64(key)", "xxhash64(key, 1)")) -> np.ndarray:
    """The filter over ``keys(key)``: blocks of eight words, one bit set in each word of a key's block.

    Bits are combined in Spark; what reaches the driver is the filter, at most ``most_bytes``. A list
    too long for that makes the filter denser, which costs false positives and no result. ``hashes`` are two expressions of ``key``.
    """
    n = keys.count()
    blocks = int(max(1, min(most_bytes // 64, -(-n * bits_per_key // 512))))
    h1, h2 = map(F.expr, hashes)
    bits = [F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h2, {6 * i}) & 63 AS int))")).alias(f"m{i}") for i in range(BLOCK_WORDS)]
    rows = keys.select(h1.alias("h1"), h2.alias("h2")).select(F.pmod(F.expr("shiftrightunsigned(h1, 16)"), F.lit(blocks)).alias("b"), "h2")
    words = np.zeros((blocks, BLOCK_WORDS), dtype=np.int64)
    got = rows.groupBy("b").agg(*bits).toPandas()
    words[got["b"].to_numpy(dtype=np.int64)] = got.drop(columns="b").to_numpy(dtype=np.int64)
    return words.reshape(-1).view(np.uint64)


def may_hold(words: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """For arrays of both hashes, whether the filter may hold the key."""
    blocks = len(words) // BLOCK_WORDS
    at = (h1.view(np.uint64) >> np.uint64(16)) % np.uint64(blocks) * np.uint64(BLOCK_WORDS)
    h2, ok = h2.view(np.uint64), np.ones(len(h1), dtype=bool)
    for i in range(BLOCK_WORDS):
        ok &= (words[at + np.uint64(i)] >> ((h2 >> np.uint64(6 * i)) & np.uint64(63))) & np.uint64(1) == 1
    return ok


def filter_urls(pages: DataFrame, rules: DataFrame, spark: SparkSession, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of each row of ``pages``; ``rules(verdict, host, path)``.

    The longest rule that fits wins (of equal ones the block). A url that is null, empty or without
    ``://`` has empty host and path and fits no rule. Without a fitting rule the verdict is ``default``.
    Repeated rows get equal verdicts; an empty table gives an empty result; an empty list
    leaves every verdict at ``default``. Other columns, the page text above all, are not read.
    """
    host, path = split_url(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND host <> ''")
    listed = rules.groupBy(F.struct("host", "path").alias("pair")).agg(F.max("verdict").alias("rule_verdict"))
    listed = listed.select(entry_key(F.col("pair.host"), F.col("pair.path")).alias("key"), F.col("pair.host").alias("rule_host"), "rule_verdict")
    words = spark.sparkContext.broadcast(bloom_words(listed.select("key"), spark))
    lengths = sorted(r[0] for r in rules.select(F.length("path").alias("n")).distinct().collect())  # bounded by the longest path
    ends = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    labels = F.split("host", r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pair = F.flatten(F.transform(F.filter(hosts, lambda h: h != ""), lambda h: F.transform(ends, lambda n: F.struct(h.alias("host"), F.concat(h, F.substring(F.col("path"), F.lit(1), n)).alias("key")))))
    # a verdict hangs on host and path alone, so each pair is looked up once
    sites = pages.select("host", "path").where("host <> ''").distinct()
    sites = sites.repartition(shuffle_width(spark), "host", "path").withColumn("cand", pair)  # few bytes, but work in each row
    sites = sites.withColumn("h1", F.transform("cand", lambda c: F.xxhash64(c["key"]))).withColumn("h2", F.transform("cand", lambda c: F.xxhash64(c["key"], F.lit(1))))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = b.column("h1"), b.column("h2")
            flat = lambda x: x.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
            ok = may_hold(words.value, flat(h1), flat(h2))
            hit = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(h1.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)), pa.array(ok))
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("path"), b.column("cand"), hit], ["host", "path", "cand", "hit"])

    kept = sites.mapInArrow(probe, "host string, path string, cand array<struct<host:string,key:string>>, hit array<boolean>")
    kept = kept.select("host", "path", F.explode(F.filter(F.arrays_zip("cand", "hit"), lambda x: x["hit"])).alias("x")).select("host", "path", F.col("x.cand.key").alias("key"), F.col("x.cand.host").alias("rule_host"))
    hits = kept.join(listed, ["key", "rule_host"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), F.col("rule_verdict"), F.col("key"))).alias("best"))
    out = pages.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages"), rules, spark)


ORACLE = r"""
WITH r AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
s AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM r),
p AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM s),
q AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM q
"""
