"""Searches and listings as Spark sources: ``spark.read.format("article_search")`` and ``"prefix_listing"``.

Each query or prefix is a partition of its own, so many are read side by side, and a
lost task reads its own again; retries are inside the reader.  ``pages`` names a
folder of recorded replies to read in place of the network, as ``record`` writes
them; it must be mounted wherever tasks run.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.sources import remote


def page_key(url: str) -> str:
    return hashlib.md5(url.encode(), usedforsecurity=False).hexdigest()


def record(replies: DataFrame, folder: str) -> None:
    """Writes replies (url, body), each a line, to a folder by the digest of their URL."""
    replies.select(F.md5("url").alias("key"), "body").repartition("key").write.mode("overwrite").partitionBy("key").text(folder)


def recorded(folder: str) -> remote.Opener:
    """Opens recorded replies; one that isn't there is an OSError, as a failing request is."""
    folder = folder.removeprefix("file://").removeprefix("file:")

    def opener(url: str, timeout: float) -> bytes:
        own, body = os.path.join(folder, f"key={page_key(url)}"), []
        for name in sorted(x for x in os.listdir(own) if x.startswith("part-")):
            with open(os.path.join(own, name), "rb") as page:
                body.append(page.read())
        return b"".join(body)

    return opener


class _Asked(InputPartition):
    def __init__(self, what: str):
        super().__init__(what)
        self.what = what


class _Reader(DataSourceReader):
    """Reads each of the JSON list in the option ``over``; ``tries`` and ``wait`` are those of the requests."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[_Asked]:
        return [_Asked(x) for x in json.loads(self.options["over"])]

    def opened(self) -> remote.Opener:
        below = recorded(self.options["pages"]) if self.options.get("pages") else remote._open
        tries, wait = int(self.options.get("tries", 3)), float(self.options.get("wait", 1.5))
        return lambda url, timeout: remote.http_get(url, timeout, tries, wait, below)


class _SearchReader(_Reader):
    def read(self, partition: _Asked) -> Iterator[tuple]:
        ids = remote.search_ids(partition.what, int(self.options.get("most", 100)), self.options.get("first"), self.options.get("last"), self.opened())
        yield from ((partition.what, n, x) for n, x in enumerate(ids, 1))


class _ListingReader(_Reader):
    def read(self, partition: _Asked) -> Iterator[tuple]:
        found = remote.list_prefixes(self.options["bucket"], partition.what, self.opened())
        latest = remote.latest_prefix(found)
        yield from ((partition.what, x, x == latest) for x in found)


class ArticleSearch(DataSource):
    """(query, pos, id): the ids that each of the queries ``over`` finds, in order."""

    @classmethod
    def name(cls) -> str:
        return "article_search"

    def schema(self) -> str:
        return "query string, pos int, id string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(self.options)


class PrefixListing(DataSource):
    """(prefix, folder, latest): the folders below each of the prefixes ``over``, and which has the largest number at its end."""

    @classmethod
    def name(cls) -> str:
        return "prefix_listing"

    def schema(self) -> str:
        return "prefix string, folder string, latest boolean"

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (ArticleSearch, PrefixListing):
        spark.dataSource.register(source)
