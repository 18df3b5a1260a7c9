"""Sources: every one has a schema or takes one, and prunes to the columns asked for."""

from __future__ import annotations

import hashlib
import urllib.parse
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "query_id string, split string, source_row long, question string, golden_answer string, allowed_doc_ids array<string>, dataset string"
EXCERPT = "struct<rank:int,unit_id:string,doc_id:string,text:string,score:double>"
HIT = "struct<rank:int,unit_id:string,doc_id:string,paragraph_idx:int,subparagraph_idx:int,text:string,score:double,context:array<struct<unit_id:string,text:string>>>"
RETRIEVAL = f"query_id string, arm string, retrieved_items array<{EXCERPT}>, retrieved_count long, retrieval_error string"


def parquet(spark: SparkSession, path: str, *columns: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A Parquet table or glob of files; fails at once if a required column lacks."""
    df = spark.read.parquet(path)
    missing = [c for c in (*columns, *required) if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    return df.select(*columns) if columns else df


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return parquet(spark, f"{sf_dir}/{name}.parquet", *columns)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def json_documents(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One object a file, such as the summaries of many runs or a configuration."""
    return spark.read.schema(schema).option("multiLine", True).json(glob)


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a header; empty strings stay text, only the sentinel is null, quotes and line ends in fields are kept."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "")
    return (reader.schema(schema) if schema else reader).csv(path).na.fill("")  # bare empty fields come as the sentinel


def routed(spark: SparkSession, root: str, **parts: str) -> DataFrame:
    """A partitioned table cut down to partitions, such as dataset=, arm= or model=."""
    df = spark.read.parquet(root)
    for name, value in parts.items():
        df = df.where(F.col(name) == value)
    return df


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for pdf in batches:
        sums = []
        for uri in pdf["path"]:
            system, path = fs.FileSystem.from_uri(urllib.parse.quote(uri, safe="/:") if uri.startswith("file:") else uri)
            digest = hashlib.sha256()
            with system.open_input_stream(path, buffer_size=1 << 20) as f:
                while block := f.read(1 << 20):
                    digest.update(block)
            sums.append(digest.hexdigest())
        yield pdf.assign(sha256=sums)


def files(spark: SparkSession, root: str, skip: str = r"/(\.git|__pycache__|\.pytest_cache)/|\.pyc$") -> DataFrame:
    """(path, bytes, sha256) of all files under ``root`` except those that match ``skip``; files are read in blocks, whatever their size."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(~F.col("path").rlike(skip))
    return found.select("path", F.col("length").alias("bytes")).mapInPandas(_hashed, "path string, bytes long, sha256 string")


def parts(spark: SparkSession, glob: str, *columns: str) -> DataFrame:
    """The rows of all files that ``glob`` matches, with ``part`` and ``part_row``: sorted by both they stand as in the files, taken in the order of their paths."""
    df = parquet(spark, glob, *columns)
    return df.select(*df.columns, F.col("_metadata.file_path").alias("part"), F.col("_metadata.row_index").alias("part_row"))
