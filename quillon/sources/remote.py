"""Remote services as Spark data sources: a SQL database, and a ranked search that batches and streams can read.

A service is reached through a function that executors import, named MODULE:FUNCTION. Filters, columns and limits go to the
service; every task asks for one part, so a lost executor costs that part alone.
"""

from __future__ import annotations

import importlib
import json
import urllib.parse
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

#: Ids that one statement takes at most; longer lists are dealt to several tasks.
IDS = 500
#: Questions that one task sends.
PAGE = 16
#: Rows of a reply that are fetched at a time.
FETCH = 1000


def named(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Part(ds.InputPartition):
    """One statement with its bound values."""

    statement: str
    values: tuple

    def __init__(self, statement: str, values: tuple):
        super().__init__(0)
        self.statement, self.values = statement, values


_COMPARED = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def condition(f: ds.Filter) -> tuple[str, tuple] | None:
    """A filter as SQL with a mark for each bound value; None for one that isn't pushed. Values are never written into the text."""
    if isinstance(f, ds.Not):
        inner = condition(f.child)
        return inner and (f"NOT ({inner[0]})", inner[1])
    column = ".".join(map(_quoted, f.attribute)) if len(f.attribute) == 1 else None
    if not column:
        return None
    for kind, sign in _COMPARED.items():
        if type(f) is kind:
            return f"{column} {sign} ?", (f.value,)
    if isinstance(f, ds.In):
        return f"{column} IN ({', '.join('?' * len(f.value))})", tuple(f.value)
    if isinstance(f, ds.IsNotNull):
        return f"{column} IS NOT NULL", ()
    if isinstance(f, ds.IsNull):
        return f"{column} IS NULL", ()
    return None


class SqlReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options, self.pushed = schema, options, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if condition(f) is None:
                yield f
            else:
                self.pushed.append(f)

    def partitions(self) -> list[Part]:
        """A statement for each chunk of the longest list of ids, else for each slice of the partition column, else one."""
        lists = [f for f in self.pushed if isinstance(f, ds.In)]
        split = max(lists, key=lambda f: len(f.value), default=None)
        rest = [condition(f) for f in self.pushed if f is not split]
        if split:
            ids = sorted(set(split.value), key=repr)
            slices = [condition(ds.In(split.attribute, tuple(ids[i : i + IDS]))) for i in range(0, len(ids), IDS)]
        elif self.options.get("partitioncolumn"):
            n, column = int(self.options.get("numpartitions", 8)), _quoted(self.options["partitioncolumn"])
            slices = [(f"{column} % {n} = ?" + (f" OR {column} IS NULL" if not i else ""), (i,)) for i in range(n)]
        else:
            slices = [("1 = 1", ())]
        columns = ", ".join(_quoted(c) for c in self.schema.names)
        table = _quoted(self.options["table"])
        return [Part(f"SELECT {columns} FROM {table} WHERE " + " AND ".join(f"({c})" for c, _ in [*rest, s]), tuple(v for _, values in [*rest, s] for v in values)) for s in slices]

    def read(self, part: Part) -> Iterator[tuple]:
        connection = named(self.options["connect"])(self.options.get("address", ""))
        try:
            cursor = connection.cursor()
            cursor.execute(part.statement, part.values)
            while rows := cursor.fetchmany(FETCH):
                yield from map(tuple, rows)
        finally:
            connection.close()


class SqlSource(ds.DataSource):
    """A table of a database behind a DB-API ``connect(address)``; the columns of the schema that the reader is given are all that is asked for."""

    @classmethod
    def name(cls) -> str:
        return "quillon_sql"

    def reader(self, schema: StructType) -> SqlReader:
        return SqlReader(schema, dict(self.options))


def sql_table(spark: SparkSession, connect: str, address: str, table: str, schema: str, **options: object) -> DataFrame:
    """Columns of a remote table. Comparisons, lists of ids and null tests that follow go to the database as bound values.

    ``partitionColumn`` (a number that isn't negative) and ``numPartitions`` read it in parallel; a long list of ids is dealt to several statements in any case.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqlSource)
    return spark.read.format("quillon_sql").schema(schema).options(connect=connect, address=address, table=table, **options).load()


def sql_units(spark: SparkSession, connect: str, address: str, level: str, doc_ids: list[str] | None = None, table: str = "units", **options: object) -> DataFrame:
    """(doc_id, unit_id, text) of one level, of certain documents if ids are given: level and ids are filters of the database."""
    df = sql_table(spark, connect, address, table, "retrieval_level string, doc_id string, unit_id string, text string", **options)
    df = df.where(df["retrieval_level"] == level)
    return (df.where(df["doc_id"].isin(doc_ids)) if doc_ids is not None else df).select("doc_id", "unit_id", "text")


# ranked search ---------------------------------------------------------------------------------------

HITS = "query_id string, rank int, unit_id string, doc_id string, paragraph_idx int, subparagraph_idx int, text string, score double, context array<struct<unit_id:string,text:string>>, retrieval_error string"


@dataclass
class Page(ds.InputPartition):
    """Questions whose ids are above ``low`` and not above ``high``."""

    low: str
    high: str

    def __init__(self, low: str, high: str):
        super().__init__(0)
        self.low, self.high = low, high


def _dataset(path: str):
    import pyarrow.dataset as pads
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(urllib.parse.quote(path, safe="/:")) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return pads.dataset(inner, filesystem=system, format="parquet")


def ids_above(path: str, low: str, high: str | None) -> list[str]:
    """The ids of the questions in a range, in order: one column of the table."""
    import pyarrow.dataset as pads

    wanted = pads.field("query_id") > low
    wanted = wanted if high is None else wanted & (pads.field("query_id") <= high)
    return sorted(set(_dataset(path).to_table(columns=["query_id"], filter=wanted).column(0).to_pylist()))


class _Search:
    """What batches and streams of searches have in common."""

    def __init__(self, options: dict):
        self.options = options

    def pages(self, low: str, high: str | None) -> list[Page]:
        ids, size = ids_above(self.options["questions"], low, high), int(self.options.get("page", PAGE))
        ends = [ids[min(i + size, len(ids)) - 1] for i in range(0, len(ids), size)]
        return [Page(a, b) for a, b in zip([low, *ends], ends, strict=False)]

    def read(self, page: Page) -> Iterator[tuple]:
        """The hits of a page's questions; a question that fails is one row with its error."""
        import pyarrow.dataset as pads

        search = named(self.options["search"])
        settings = json.loads(self.options.get("settings", "{}"))
        limit = int(self.options.get("limit", 4))
        columns = ["query_id", "question", "allowed_doc_ids"]
        asked = (pads.field("query_id") > page.low) & (pads.field("query_id") <= page.high)
        # one question at a time: the ids that it allows can be many
        table = _dataset(self.options["questions"]).to_table(columns=columns, filter=asked).sort_by("query_id")
        for i in range(table.num_rows):
            [row] = table.slice(i, 1).to_pylist()
            request = {"query": row["question"], "allowed_doc_ids": row["allowed_doc_ids"], "limit": limit, **settings}
            try:
                hits = search(request, self.options.get("address", ""))[:limit]
            except Exception as e:  # a question's failure is data
                yield row["query_id"], None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]
                continue
            for rank, hit in enumerate(hits, 1):
                parts = [hit.get("paragraph_idx"), hit.get("subparagraph_idx")]
                made = "|".join(map(str, [hit["doc_id"], *[p for p in parts if p is not None]]))
                around = [(c["unit_id"], c["text"]) for c in hit.get("context") or []]
                yield row["query_id"], rank, hit.get("unit_id") or made, hit["doc_id"], *parts, hit["text"], hit.get("score"), around, ""


class SearchReader(_Search, ds.DataSourceReader):
    def partitions(self) -> list[Page]:
        return self.pages("", None)


class SearchStream(_Search, ds.DataSourceStreamReader):
    """Offsets are ids of questions: a batch is the ids between two, and what a restart replays."""

    def initialOffset(self) -> dict:
        return {"query_id": ""}

    def latestOffset(self) -> dict:
        ids = ids_above(self.options["questions"], "", None)
        return {"query_id": ids[-1] if ids else ""}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self.pages(start["query_id"], end["query_id"])

    def commit(self, end: dict) -> None:
        return None


class SearchSource(ds.DataSource):
    """Hits of ``search(request, address)`` for the questions of a Parquet table: a task for each page of questions."""

    @classmethod
    def name(cls) -> str:
        return "quillon_search"

    def schema(self) -> str:
        return HITS

    def reader(self, schema: StructType) -> SearchReader:
        return SearchReader(dict(self.options))

    def streamReader(self, schema: StructType) -> SearchStream:
        return SearchStream(dict(self.options))


def search_hits(spark: SparkSession, questions: str, search: str, address: str = "", limit: int = 4, streaming: bool = False, page: int = PAGE, **settings: object) -> DataFrame:
    """HITS of a ranked search service for the questions (query_id, question, allowed_doc_ids) of a Parquet table.

    ``search`` names a function of a request (query, allowed_doc_ids, limit and the settings) and an address; limit, settings and allowed ids
    go to the service. A stream goes on with questions whose ids are above all that it has done; those ids must rise.
    """
    spark.dataSource.register(SearchSource)
    reader = (spark.readStream if streaming else spark.read).format("quillon_search")
    return reader.options(questions=questions, search=search, address=address, limit=limit, page=page, settings=json.dumps(settings)).load()
