"""Joins by containment of one normalized text in another, found by equal keys instead of testing pairs.

Containment isn't bound to token borders: a needle's first token may be the end of a longer one, its last the beginning of one.
All tokens between them stand whole in any text that holds it. So a needle of three or more tokens is looked up by the rarest run of
whole tokens inside it; one of two tokens by the vocabulary's tokens that end like its first or begin like its last, one of a single token by those that hold it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run has so many tokens, fewer only where a needle has no such run inside.
RUN = 2


def runs(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens, joined by spaces; none where there are fewer."""
    if n == 1:
        return tokens
    shifted = [F.slice(tokens, i + 1, F.greatest(F.size(tokens) - n + 1, F.lit(0))) for i in range(n)]
    out = shifted[0]
    for s in shifted[1:]:
        out = F.zip_with(out, s, lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def _inner(tokens: Column) -> Column:
    """The tokens that stand whole in any text that holds this needle."""
    return F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0)))


def candidates(needles: DataFrame, texts: DataFrame, run: int = RUN, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(needle_id, text_id): pairs that a key of each needle finds; every text that holds the needle is among them.

    ``needles(needle_id, needle)``, ``texts(text_id, text)``, normalized. Keys are counted over all texts, and
    each needle is probed by its rarest; a needle with a key that no text has finds nothing. Counts are combined where the texts are read;
    ``keep`` may write the chosen keys: where they are seen to be few, no other key of a text is shuffled.
    """
    n = needles.where("needle <> ''").select("needle_id", F.split("needle", " ", -1).alias("t"))
    t = texts.where("text <> ''").select("text_id", F.split("text", " ", -1).alias("t"))
    found = []
    for width in range(1, run + 1):  # needles whose inner tokens make runs of this width, and no wider ones
        fits = (F.size("t") - 2 >= width) if width == run else (F.size("t") - 2 == width)
        keys = n.where(fits).select("needle_id", F.explode(F.array_distinct(runs(_inner(F.col("t")), width))).alias("key"))
        held = t.select("text_id", F.explode(runs(F.col("t"), width)).alias("key")).join(keys.select("key").distinct(), "key", "left_semi")
        rare = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        probe = keys.join(rare, "key", "left").groupBy("needle_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("best"))
        probe = keep(probe.where("best.n > 0").select("needle_id", F.col("best.key").alias("key")))
        found.append(probe.join(held, "key").select("needle_id", "text_id"))
    found += _short(n, t)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def _short(n: DataFrame, t: DataFrame) -> list[DataFrame]:
    """Candidates for needles of one or two tokens, by parts of the vocabulary's tokens."""
    short = n.where(F.size("t") <= 2)
    first, last = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    by = F.when(F.size("t") == 1, "any").when(F.length(first) >= F.length(last), "end").otherwise("start")
    keys = short.select("needle_id", by.alias("by"), F.when(by == "start", last).otherwise(first).alias("part"))
    # the lengths of parts that are asked for, in one row, none without a short needle: then no text is looked at
    asked = keys.agg(F.collect_set(F.length("part")).alias("sizes")).where(F.size("sizes") > 0)
    held = t.crossJoin(F.broadcast(asked)).select("text_id", "sizes", F.explode("t").alias("token")).distinct()
    words = held.select("token", "sizes").distinct().select("token", F.explode("sizes").alias("size")).where(F.length("token") >= F.col("size"))
    at = F.explode(F.sequence(F.lit(1), F.length("token") - F.col("size") + 1)).alias("at")
    parts = words.select("token", "size", at).select("token", F.expr("substring(token, at, size)").alias("part"), (F.col("at") == 1).alias("first"), (F.col("at") + F.col("size") - 1 == F.length("token")).alias("last"))
    met = keys.join(parts, "part").where("by = 'any' OR (by = 'end' AND last) OR (by = 'start' AND first)").select("needle_id", "token").distinct()
    return [met.join(held, "token").select("needle_id", "text_id")]


def possible(needles: DataFrame, texts: DataFrame, least_tokens: int = RUN + 2) -> DataFrame:
    """``needles`` without most of those that no text holds: the first run inside a needle of ``least_tokens`` or more tokens is a run of some text.

    For many needles and few texts, whose runs go to the needles.
    """
    t = F.split("needle", " ", -1)
    known = texts.where("text <> ''").select(F.explode(runs(F.split("text", " ", -1), RUN)).alias("_run")).distinct()
    first = F.when(F.size(t) >= least_tokens, F.concat_ws(" ", F.get(t, F.lit(1)), F.get(t, F.lit(2))))
    marked = needles.withColumn("_run", first)
    return marked.where("_run IS NOT NULL").join(known, "_run", "left_semi").drop("_run").unionByName(marked.where("_run IS NULL").drop("_run"))


def containing(needles: DataFrame, texts: DataFrame, run: int = RUN, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(needle_id, text_id): the pairs in which the text holds the needle as a string. Empty needles and nulls are held by nothing.

    ``keep`` may write the candidates: where they are seen to be few, no text is shuffled. Needles without a candidate go before they meet the texts.
    """
    pairs = keep(candidates(needles, texts, run))
    met = needles.select("needle_id", "needle").join(pairs.select("needle_id").distinct(), "needle_id", "left_semi")
    both = texts.select("text_id", "text").join(pairs, "text_id").join(met, "needle_id")
    return both.where(F.contains("text", "needle")).select("needle_id", "text_id").distinct()
