"""A reader of responses that are linked by cursors, stored as files: `spark.read.format("spindrift_pages").load(path)`.

A response is a JSON object with `results`, `has_more` and `next_cursor`, as a listing service gives it; a fetcher stores each
under `<path>/collection=<name>/cursor=<cursor>/`, the first one under the cursor `start`. A collection is one partition, whose task follows
its cursors and holds one response at a time. Filters on `collection` leave partitions out, filters on `modified_at` items; both
are pushed down. As a stream, the offset of a collection is the cursor to read next: a cursor whose response isn't
stored yet is where the stream waits, and where it goes on when started again.

Results in odd cases: a response without results adds nothing; `has_more` without a cursor ends the collection; a missing response
is an error in a batch, unless the option `open` is true; cursors that come back to an earlier one are an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

SCHEMA = "collection string, cursor string, position int, id string, modified_at timestamp, item string"
START = "start"


def _system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path.rstrip("/")))


def _folders(path: str, prefix: str) -> list[str]:
    system, own = _system(path)
    found = system.get_file_info(pyarrow.fs.FileSelector(own, allow_not_found=True))
    return sorted(x.base_name.removeprefix(prefix) for x in found if x.base_name.startswith(prefix))


def _response(path: str, collection: str, cursor: str) -> dict | None:
    """A stored response; null if there is none."""
    system, own = _system(path)
    found = system.get_file_info(pyarrow.fs.FileSelector(f"{own}/collection={collection}/cursor={cursor}", allow_not_found=True))
    files = [x for x in found if not x.base_name.startswith(("_", "."))]
    if not files:
        return None
    with system.open_input_stream(files[0].path) as source:
        return json.loads(source.read())


def _next(response: dict) -> str | None:
    return (response.get("next_cursor") or None) if response.get("has_more") else None


def _time(text: str | None) -> datetime | None:
    try:
        when = datetime.fromisoformat(text)
    except (TypeError, ValueError):
        return None
    return when if when.tzinfo is None else when.astimezone(timezone.utc).replace(tzinfo=None)


@dataclass
class Chain(InputPartition):
    """The responses of a collection from one cursor to another, which is left out; to None is to the end."""

    collection: str
    first: str
    until: str | None = None


def _rows(path: str, chain: Chain, open_end: bool, field: str, after: list[tuple[datetime, bool]]) -> Iterator[tuple]:
    cursor, seen = chain.first, set()
    while cursor is not None and cursor != chain.until:
        if cursor in seen:
            raise ValueError(f"{chain.collection}: the cursor {cursor} comes again")
        seen.add(cursor)
        response = _response(path, chain.collection, cursor)
        if response is None:
            if open_end:
                return
            raise FileNotFoundError(f"{chain.collection}: no response for the cursor {cursor}")
        for n, item in enumerate(response.get("results") or []):
            when = _time(item.get(field))
            if all(when is not None and (when > least or (equal and when == least)) for least, equal in after):
                yield chain.collection, cursor, n, str(item.get("id") or ""), when, json.dumps(item, ensure_ascii=False)
        cursor = _next(response)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spindrift_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> PagedStreamReader:
        return PagedStreamReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.field = options["path"], options.get("modified", "last_edited_time")
        self.open_end = str(options.get("open", "false")).lower() == "true"
        self.only: set[str] | None = None
        self.after: list[tuple[datetime, bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            match f:
                case EqualTo(("collection",), value):
                    self.only = {value} if self.only is None else self.only & {value}
                case In(("collection",), values):
                    self.only = set(values) if self.only is None else self.only & set(values)
                case GreaterThan(("modified_at",), value) | GreaterThanOrEqual(("modified_at",), value):
                    self.after.append((value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value, isinstance(f, GreaterThanOrEqual)))
                case _:
                    yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [Chain(c, START) for c in _folders(self.path, "collection=") if self.only is None or c in self.only]

    def read(self, partition: Chain) -> Iterator[tuple]:
        return _rows(self.path, partition, self.open_end, self.field, self.after)


class PagedStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.field = options["path"], options.get("modified", "last_edited_time")
        self.at: dict[str, str] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """For each collection the first cursor without a stored response; `` past the end."""
        for collection in _folders(self.path, "collection="):
            cursor = self.at.get(collection, START)
            while cursor and (response := _response(self.path, collection, cursor)) is not None:
                cursor = _next(response) or ""
            self.at[collection] = cursor
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Chain(c, start.get(c, START), until or None) for c, until in sorted(end.items()) if start.get(c, START) not in (until, "")]

    def read(self, partition: Chain) -> Iterator[tuple]:
        return _rows(self.path, partition, False, self.field, [])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)


def store_responses(items: DataFrame, path: str, size: int = 100, first: int = 0, end: bool = True) -> None:
    """Stores items (collection, ordinal, item) as responses of so many items each. first: the number of the first
    response, when a collection goes on; end: whether the last response is the collection's end."""
    n = F.floor(F.col("ordinal") / size).cast("int")
    pages = items.groupBy("collection", n.alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "item"))), lambda x: x["item"]), ",").alias("results"))
    from pyspark.sql import Window as W

    last = F.col("n") == F.max("n").over(W.partitionBy("collection"))
    name = lambda k: F.when(k == 0, START).otherwise(F.concat(F.lit("c"), k.cast("string")))
    more = ~last | F.lit(not end)
    body = F.concat(F.lit('{"results":['), "results", F.lit('],"has_more":'), more.cast("string"), F.when(more, F.concat(F.lit(',"next_cursor":"'), name(F.col("n") + first + 1), F.lit('"'))).otherwise(""), F.lit("}"))
    rows = pages.select(body.alias("value"), "collection", name(F.col("n") + first).alias("cursor"))
    rows.repartition("collection", "cursor").write.mode("append").partitionBy("collection", "cursor").text(path)
