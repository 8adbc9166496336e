"""Feeds of which a page tells where the next one begins.

``page_chain`` is a stream over one or several such feeds, say one for each account.
Where a page is known only from the page before it, there is no list of pages to plan
from. The source therefore walks a feed ahead of the batches: it fetches a page, stores
it unchanged in a *stage* in the shared folder, reads from it where the next one is, and
goes on until the feed says it has ended. An offset is the number of the last staged page
with the position after it. Tasks read staged pages only, so

- a batch that is replayed reads the same bytes, whatever the feed says by then,
- a restart goes on behind the last staged page, which may be ahead of the last batch,
- the feed is asked for each page once.

A page that tells no next position, or one that leads back to itself, stops the stream
before it is staged. At the end of a feed the position stays, and the next start of the
stream asks there again; an answer without records is not kept.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from topicloom.sources.pages import BrokenPage

Position = dict  # {"cursor": "..."} or {"start_time": seconds}

# Feeds walked side by side.
WALKERS = 8


@dataclass(frozen=True)
class Links:
    """How pages of a kind of feed name their records, the next position and the end."""

    records: str
    position: str
    field: str

    def ended(self, page: dict) -> bool:
        return bool(page.get("end_of_stream")) if self.position == "cursor" else page.get("next_page") is None


# --- Fixed values: field names of cursor-paged tickets and time-paged articles ---
LINKS = {
    "cursor": Links("tickets", "cursor", "after_cursor"),
    "time": Links("articles", "start_time", "end_time"),
}
# --- end of fixed values ---


def _files(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


class Stage:
    """Pages of one feed, numbered from 1 in the order of the chain."""

    def __init__(self, path: str, feed: str):
        self.files, top = _files(path)
        self.path = f"{top}/{feed.encode().hex() or 'only'}"

    def _name(self, number: int) -> str:
        return f"{self.path}/page-{number:010d}.json"

    def last(self) -> int:
        """Number of the last page; 0 if there is none."""
        found = self.files.get_file_info(pyarrow.fs.FileSelector(self.path, allow_not_found=True))
        names = [i.base_name for i in found if i.type == pyarrow.fs.FileType.File and i.base_name.startswith("page-")]
        return max((int(n[5:15]) for n in names), default=0)

    def read(self, number: int) -> dict:
        with self.files.open_input_stream(self._name(number)) as stream:
            return json.loads(stream.read())

    def write(self, number: int, body: str, after: Position) -> None:
        """In full or not at all: a name starting with ``page-`` is a whole page."""
        self.files.create_dir(self.path, recursive=True)
        draft = f"{self.path}/draft-{number:010d}.json"
        with self.files.open_output_stream(draft) as stream:
            stream.write(json.dumps({"body": body, "after": after}).encode())
        self.files.move(draft, self._name(number))


class FolderChain:
    """Default transport: pages below ``path`` in folders named ``feed=<feed>/at=<position>``.

    Where there is no folder for a position the feed ends for now.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def page(self, feed: str, position: Position) -> str:
        (at,) = position.values()
        files, top = _files(self.path)
        found = files.get_file_info(pyarrow.fs.FileSelector(f"{top}/feed={feed}/at={at}", allow_not_found=True))
        names = [i.path for i in found if i.type == pyarrow.fs.FileType.File and i.base_name[0] not in "._"]
        if not names:
            return '{"end_of_stream": true}'
        (name,) = names
        with files.open_input_stream(name) as stream:
            return stream.read().decode()


class _Walk:
    """One feed and its stage."""

    def __init__(self, options: dict[str, str], feed: str):
        self.options, self.feed = options, feed
        self.links, self.stage = LINKS[options["follow"]], Stage(options["stage"], feed)

    def offset(self, number: int) -> dict:
        """After a staged page; after none, where the feed begins."""
        if number:
            after = self.stage.read(number)["after"]
        else:
            kind, first = self.options["start_kind"], self.options["start"]
            after = {kind: int(first) if kind == "start_time" else first}
        return {"page": number, "after": json.dumps(after)}

    def advance(self, transport, most: int) -> dict:
        """Stage the pages there are now, at most ``most``; the offset after them."""
        number = self.stage.last()
        offset = self.offset(number)
        for _ in range(most):
            position = json.loads(offset["after"])
            body = transport.page(self.feed, position)
            page, after = self._follow(body, position)
            ended = self.links.ended(page)
            if not page.get(self.links.records) and ended:
                break
            number += 1
            self.stage.write(number, body, after)
            offset = {"page": number, "after": json.dumps(after)}
            if ended:
                break
        return offset

    def _follow(self, body: str, position: Position) -> tuple[dict, Position]:
        try:
            page = json.loads(body)
        except ValueError as error:
            raise BrokenPage(f"{BrokenPage.__name__}: a page does not parse, at {position}") from error
        if not isinstance(page, dict):
            raise BrokenPage(f"{BrokenPage.__name__}: a page is no object, at {position}")
        after = {self.links.position: page.get(self.links.field)}
        ended = self.links.ended(page)
        if None in after.values():
            # Nothing to go on from: at the end, the next start asks here again.
            if not ended:
                raise BrokenPage(f"{BrokenPage.__name__}: a page has no {self.links.field}, at {position}")
            after = position
        if after == position and not ended:
            raise BrokenPage(f"{BrokenPage.__name__}: a page leads back to itself, at {position}")
        return page, after


class _StagedPage(InputPartition):
    def __init__(self, feed: str, number: int):
        super().__init__((feed, number))
        self.feed, self.number = feed, number


class _ChainReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.feeds = json.loads(options["feeds"])

    def initialOffset(self) -> dict:
        return {feed: _Walk(self.options, feed).offset(0) for feed in self.feeds}

    def latestOffset(self) -> dict:
        module, _, factory = self.options.get("transport", f"{__name__}:FolderChain").partition(":")
        transport = getattr(importlib.import_module(module), factory)(self.options)
        most = int(self.options.get("max_pages", 1_000_000))
        with ThreadPoolExecutor(WALKERS) as pool:
            offsets = pool.map(lambda feed: _Walk(self.options, feed).advance(transport, most), self.feeds)
            return dict(zip(self.feeds, offsets))

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [_StagedPage(feed, number) for feed in end
                for number in range(start.get(feed, {}).get("page", 0) + 1, end[feed]["page"] + 1)]

    def read(self, partition: _StagedPage) -> Iterator[tuple[str, int, str]]:
        page = Stage(self.options["stage"], partition.feed).read(partition.number)
        yield partition.feed, partition.number, page["body"]


class PageChain(DataSource):
    """``spark.readStream.format("page_chain")``: ``feed, page, body``.

    Options: ``stage`` (folder that driver and tasks share); ``follow`` (``cursor`` or
    ``time``); ``start`` (first position) and ``start_kind`` (``cursor`` or ``start_time``:
    a cursor-paged feed begins at a time, too); ``feeds`` (JSON list of names); ``transport`` (``module:factory`` of an object with ``page(feed, position)``,
    which returns JSON text); ``max_pages`` of a feed in one batch.
    """

    @classmethod
    def name(cls) -> str:
        return "page_chain"

    def schema(self) -> str:
        return "feed string, page long, body string"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _ChainReader(dict(self.options))


def stream_chain(spark: SparkSession, stage: str, follow: str, start: int | str, feeds: Sequence[str],
                 schema: T.StructType, **options: str) -> DataFrame:
    """Pages of cursor- or time-paged feeds as rows of ``schema``, in order of ``feed, page``.

    ``start`` is a time in seconds, or a cursor to go on from. A page without an account
    is of the account its feed is named after.
    """
    spark.dataSource.register(PageChain)
    kind = "start_time" if isinstance(start, int) else "cursor"
    reader = spark.readStream.format("page_chain").options(
        stage=stage, follow=follow, start=str(start), start_kind=kind, feeds=json.dumps(list(feeds)), **options)
    pages = reader.load().select("feed", "page", F.from_json("body", schema).alias("p")).select("feed", "page", "p.*")
    return pages.withColumn("account_id", F.coalesce("account_id", "feed"))

