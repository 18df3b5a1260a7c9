"""Archives and Parquet footers, read where the data is: on executors, a task for each member or block of files."""

from __future__ import annotations

import csv
import gzip
import io
import urllib.parse
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StringType, StructType

#: Rows of a member that go to Spark at a time.
ROWS = 4096


def opened(path: str):
    """A file of any store that Arrow knows, which can be sought in."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(urllib.parse.quote(path, safe="/:")) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


@dataclass
class Member(ds.InputPartition):
    """One member of an archive, found by its entry in the central directory."""

    archive: str
    member: str
    kind: str

    def __init__(self, archive: str, member: str, kind: str):
        super().__init__(0)
        self.archive, self.member, self.kind = archive, member, kind


def _table(z: zipfile.ZipFile, member: str, kind: str):
    """A member as a Parquet file, or as rows of dictionaries with empty fields as empty texts."""
    stream = z.open(member)
    if kind == "parquet":
        import pyarrow.parquet as pq

        return pq.ParquetFile(pa.PythonFile(stream, mode="r"))
    raw = gzip.GzipFile(fileobj=stream) if kind.endswith(".gz") else stream
    return csv.DictReader(io.TextIOWrapper(raw, encoding="utf-8", newline=""))


class ArchiveReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.names, options
        from pyspark.sql.pandas.types import to_arrow_schema

        self.arrow = to_arrow_schema(schema)

    def partitions(self) -> list[Member]:
        return [Member(self.options["path"], self.options["member"], self.options["kind"])]

    def read(self, part: Member) -> Iterator[pa.RecordBatch]:
        with opened(part.archive) as f, zipfile.ZipFile(f) as z:
            table = _table(z, part.member, part.kind)
            if part.kind == "parquet":
                for b in table.iter_batches(batch_size=ROWS, columns=self.names):
                    yield pa.RecordBatch.from_arrays([b.column(c).cast(self.arrow.field(c).type) for c in self.names], schema=self.arrow)
                return
            rows: list[dict] = []
            for row in table:
                rows.append(row)
                if len(rows) == ROWS:
                    yield self.batch(rows)
                    rows = []
            if rows:
                yield self.batch(rows)

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] or "" for r in rows], pa.string()) for c in self.names], schema=self.arrow)


class ArchiveSource(ds.DataSource):
    """A member of a zip file: its rows are unpacked as they are read, nothing is written anywhere."""

    @classmethod
    def name(cls) -> str:
        return "quillon_archive"

    def schema(self) -> StructType:
        o = self.options
        with opened(o["path"]) as f, zipfile.ZipFile(f) as z:
            table = _table(z, o["member"], o["kind"])
            if o["kind"] == "parquet":
                return from_arrow_schema(table.schema_arrow)
            out = StructType()
            for name in table.fieldnames or []:
                out = out.add(name, StringType())
            return out

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(schema, dict(self.options))


def archive(spark: SparkSession, path: str, members: dict[str, str], columns: list[str] | None = None) -> DataFrame:
    """The union of an archive's members, columns that lack filled with null.

    ``members`` maps a member's name to ``parquet``, ``csv`` or ``csv.gz``; ``columns`` reads no others. Fields of CSV members are texts, empty ones
    too. The driver reads the members' headings only.
    """
    spark.dataSource.register(ArchiveSource)
    out = None
    for name, kind in members.items():
        reader = spark.read.format("quillon_archive").options(path=path, member=name, kind=kind)
        part = reader.load()
        if columns is not None:
            part = reader.schema(StructType([f for f in part.schema if f.name in columns])).load()
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


FOOTER = "path string, bytes long, rows long, row_groups int, columns int, column string, nulls long, least string, greatest string"


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    for pdf in batches:
        for path, size in zip(pdf["path"], pdf["bytes"], strict=True):
            with opened(path) as f:
                meta = pq.read_metadata(f)
            out = []
            for j in range(meta.num_columns):
                stats = [meta.row_group(i).column(j).statistics for i in range(meta.num_row_groups)]
                known = all(s is not None and s.has_min_max or s is not None and s.num_values == 0 for s in stats)
                ends = [(s.min, s.max) for s in stats if s is not None and s.has_min_max]
                low, high = (str(min(a for a, _ in ends)), str(max(b for _, b in ends))) if known and ends else (None, None)
                nulls = sum(s.null_count for s in stats) if all(s is not None and s.has_null_count for s in stats) else None
                out.append((path, size, meta.num_rows, meta.num_row_groups, meta.num_columns, meta.schema.column(j).path, nulls, low, high))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FOOTER.split(", ")]).astype({"nulls": "Int64"})


def footers(spark: SparkSession, *roots: str) -> DataFrame:
    """FOOTER: a row for each column of every Parquet file under ``roots``, from the footers alone: one job however many files.

    Least and greatest values are texts, null where a row group doesn't say.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(list(roots))
    files = found.select("path", F.col("length").alias("bytes"))  # lengths come with the listing, no content is read
    return files.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(_footers, FOOTER)
