"""Columns picked by what a table has: decided while the plan is built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T


def reordered(df: DataFrame, first: list[str], renamed: dict[str, str] | None = None) -> DataFrame:
    """Renamed columns, ``first`` in front and the rest behind in their order."""
    df = df.withColumnsRenamed(renamed or {})
    return df.select(*first, *[c for c in df.columns if c not in first])


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def without(df: DataFrame, names: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> DataFrame:
    return df.drop(*[c for c in df.columns if c in names or c.startswith(prefixes or ("\0",))])


def named(df: DataFrame, prefix: str, infix: str, suffix: str) -> list[str]:
    """Column names by their parts."""
    return [c for c in df.columns if c.startswith(prefix) and infix in c and c.endswith(suffix)]


def context_of(df: DataFrame, candidates: tuple[str, ...] = ("retrieved_context", "neural_retrieved"), top_k: int = 4) -> Column:
    """The first context column that the table has, else its excerpts that aren't blank, parted by empty lines."""
    for c in candidates:
        if c in df.columns:
            return F.coalesce(F.col(c), F.lit(""))
    parts = F.array(*[F.coalesce(F.col(f"excerpt_{k}"), F.lit("")) for k in range(1, top_k + 1) if f"excerpt_{k}" in df.columns])
    return F.array_join(F.filter(parts, lambda x: ~T.is_blank(x)), "\n\n")


def excerpt_unit_id(df: DataFrame, parts: tuple[str, ...] = ("doc_id", "paragraph_idx", "subparagraph_idx")) -> Column:
    """An explicit unit_id where there is one, else the components that are there."""
    made = T.compound_id(*[F.col(p) for p in parts if p in df.columns])
    return F.coalesce(F.nullif(F.col("unit_id"), F.lit("")), made) if "unit_id" in df.columns else made


def method_rows(df: DataFrame, method: str, aliases: dict[str, tuple[str, ...]], column: str = "retrieval_method") -> DataFrame:
    """Rows of a method by its name or one of its older names, under the name it has now."""
    return df.where(F.col(column).isin(method, *aliases.get(method, ()))).withColumn(column, F.lit(method))


def of_dataset(df: DataFrame, dataset: str) -> DataFrame:
    return df.where(F.lower("dataset") == dataset.lower())


def sorted_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted by those of the keys that the table has."""
    found = [k for k in keys if k in df.columns]
    return df.orderBy(*found) if found else df


def role_swapped(df: DataFrame, target: str, answer: str = "golden_answer", evidence: str = "reference_evidence") -> DataFrame:
    """What was the answer becomes the evidence, and ``target`` the answer."""
    return df.withColumns({evidence: F.col(answer), answer: F.col(target)})
