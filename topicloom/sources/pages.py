"""Paged feeds as Spark sources.

Two ways in. JSON page files in a folder are read by Spark itself, batch or
stream. Any other feed goes through the ``page_feed`` data source: the driver
handles page *cursors* only, every page is fetched inside a task, and its body
is parsed by Spark.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator, Sequence

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

from topicloom.schemas import ARTICLE_PAGE, TICKET_FIELD_PAGE, TICKET_PAGE


class BrokenPage(ValueError):
    """A page, or a record in it, that cannot be read."""


def read_page_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row per page; the text of a page that does not parse is kept aside."""
    return spark.read.schema(schema).json(path, mode="PERMISSIVE")


def stream_page_files(spark: SparkSession, path: str, schema: T.StructType,
                      max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("mode", "PERMISSIVE")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def _broken(pages: DataFrame, records: str) -> Column:
    """Why a page cannot be applied, or null: its text does not parse, it has no list of
    records, or a record has no id."""
    reasons = [F.when(F.col(records).isNull(), f"a page has no {records}"),
               F.when(F.exists(records, lambda r: r.isNull() | r["id"].isNull()), f"one of {records} has no id")]
    if "_corrupt_record" in pages.columns:
        reasons.insert(0, F.when(F.col("_corrupt_record").isNotNull(), "a page does not parse"))
    return F.coalesce(*reasons)


def page_rejects(pages: DataFrame, records: str) -> DataFrame:
    """``account_id, reason`` of every page that ``sound_pages`` would stop at."""
    return pages.select("account_id", _broken(pages, records).alias("reason")).filter("reason is not null")


def sound_pages(pages: DataFrame, records: str) -> DataFrame:
    """``pages``, failing the job that reads them at the first broken one.

    A stream's batch then fails before its offset is committed, so a feed never passes
    a page it could not apply.
    """
    reason = _broken(pages, records)
    checked = F.when(reason.isNotNull(), F.raise_error(F.concat(F.lit(f"{BrokenPage.__name__}: "), reason)))
    return pages.withColumn(records, F.when(reason.isNull(), F.col(records)).otherwise(checked))


def _placed(pages: DataFrame, records: str) -> DataFrame:
    """One row per record, with a ``position`` that grows along a page and, where pages
    are numbered, along the feed."""
    number = F.col("page") if "page" in pages.columns else F.lit(0)
    rows = sound_pages(pages, records).select(
        "account_id", number.cast("long").alias("page"), F.posexplode(records).alias("at", "r"))
    return rows.select("account_id", "r.*", (F.shiftleft("page", 32) + F.col("at")).alias("position"))


def tickets_of(pages: DataFrame) -> DataFrame:
    """Feed tickets of all pages (pages concatenated, duplicates kept), with their place."""
    return _placed(pages, "tickets")


def articles_of(pages: DataFrame) -> DataFrame:
    return _placed(pages, "articles").drop("position")


def placed_articles(pages: DataFrame) -> DataFrame:
    """Feed articles with their place, so that the last of several versions is known."""
    return _placed(pages, "articles")


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    return tickets_of(read_page_files(spark, path, TICKET_PAGE))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return articles_of(read_page_files(spark, path, ARTICLE_PAGE))


def read_ticket_fields(spark: SparkSession, path: str) -> DataFrame:
    """Field metadata with its position, so that a later equal title can win."""
    pages = sound_pages(read_page_files(spark, path, TICKET_FIELD_PAGE), "ticket_fields")
    return pages.select("account_id", F.posexplode("ticket_fields").alias("ordinal", "f")).select(
        "account_id", "f.*", "ordinal")


class FolderTransport:
    """Default transport: one file per page, named so that names sort in feed order."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def _open(self) -> tuple[pyarrow.fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return pyarrow.fs.FileSystem.from_uri(self.path)
        return pyarrow.fs.LocalFileSystem(), self.path

    def cursors(self, after: str) -> list[str]:
        """Cursors of the pages after ``after`` that exist now, in order."""
        files, path = self._open()
        infos = files.get_file_info(pyarrow.fs.FileSelector(path))
        names = (i.base_name for i in infos if i.type == pyarrow.fs.FileType.File)
        return sorted(n for n in names if n[0] not in "._" and n > after)

    def fetch(self, cursor: str) -> Iterator[str]:
        """The page or pages behind a cursor, as JSON text."""
        files, path = self._open()
        with files.open_input_stream(f"{path}/{cursor}") as stream:
            text = stream.read().decode("utf-8")
        yield from (line for line in text.splitlines() if line.strip())


def _transport(options: dict[str, str]):
    name = options.get("transport")
    if not name:
        return FolderTransport(options)
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)(options)


class _Page(InputPartition):
    def __init__(self, cursor: str):
        super().__init__(cursor)
        self.cursor = cursor


class _Pages:
    def __init__(self, options: dict[str, str]):
        self.options = options

    def fetch(self, page: _Page) -> Iterator[tuple[str, str]]:
        for body in _transport(self.options).fetch(page.cursor):
            yield page.cursor, body


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.pages = _Pages(options)

    def partitions(self) -> Sequence[InputPartition]:
        start = self.pages.options.get("start", "")
        return [_Page(c) for c in _transport(self.pages.options).cursors(start)]

    def read(self, partition: _Page) -> Iterator[tuple[str, str]]:
        return self.pages.fetch(partition)


class _StreamReader(DataSourceStreamReader):
    """Offset = cursor of the last page taken.

    One batch takes every page that is there, so a run that stops after the
    pages now available drains the feed.
    """

    def __init__(self, options: dict[str, str]):
        self.pages = _Pages(options)
        self.newest = options.get("start", "")

    def initialOffset(self) -> dict:
        return {"cursor": self.pages.options.get("start", "")}

    def latestOffset(self) -> dict:
        newer = _transport(self.pages.options).cursors(self.newest)
        if newer:
            self.newest = newer[-1]
        return {"cursor": self.newest}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        cursors = _transport(self.pages.options).cursors(start["cursor"])
        return [_Page(c) for c in cursors if c <= end["cursor"]]

    def read(self, partition: _Page) -> Iterator[tuple[str, str]]:
        return self.pages.fetch(partition)


class PageFeed(DataSource):
    """``spark.read/readStream.format("page_feed").option("path", ...)``.

    Options: ``path``; ``start`` (cursor to resume after); ``transport``
    (``module:factory`` of an object with ``cursors(after)`` and ``fetch(cursor)``).
    """

    @classmethod
    def name(cls) -> str:
        return "page_feed"

    def schema(self) -> str:
        return "cursor string, body string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _BatchReader(dict(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def parsed_pages(feed: DataFrame, schema: T.StructType) -> DataFrame:
    """Bodies of a ``page_feed`` as page rows, next to their cursor."""
    return feed.select("cursor", F.from_json("body", schema).alias("page")).select("cursor", "page.*")


