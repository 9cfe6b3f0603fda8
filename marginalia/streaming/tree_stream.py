"""A stream of the files that appear below a folder."""

from __future__ import annotations

import os
import time
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..storage import posix_path

SCHEMA = "path string, modified timestamp, length bigint"


class Share(InputPartition):
    """What one task lists: the files of a folder, and the folders below it when ``deep``.

    Of a folder with very many entries it is one share of ``shares``, by a hash of the entry name.
    """

    def __init__(self, folder: str, deep: bool, after: int, upto: int, share: int = 0, shares: int = 1):
        super().__init__((folder, share))
        self.folder, self.deep, self.after, self.upto = folder, deep, after, upto
        self.share, self.shares = share, shares


def _is_folder(entry: os.DirEntry) -> bool:
    """Whether an entry is a folder; one that cannot be looked at, such as a link loop, is none."""
    try:
        return entry.is_dir()
    except OSError:
        return False


class SourceTreeStream(DataSource):
    """``source_tree``: file names as they appear, hidden ones included; contents are read downstream.

    The offset is a point in time: a batch holds the files whose inode changed after the last
    offset, up to its own. Both ends are fixed when the batch is planned, so a batch that runs again
    sees the same files. A file that changes is seen again. Options: ``path``, ``list_partitions``
    (shares of the listing, 256) and ``settle_ms`` (age a change must have to be picked up, 0).
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> "SourceTreeReader":
        return SourceTreeReader(self.options)


class SourceTreeReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.wanted = int(options.get("list_partitions", 256))
        self.settle_ns = int(options.get("settle_ms", 0)) * 1_000_000

    def initialOffset(self) -> dict:
        return {"ns": 0}

    def latestOffset(self) -> dict:
        return {"ns": time.time_ns() - self.settle_ns}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        """Open folders breadth-first until there are enough shares.

        A folder with more subfolders than wanted is not kept here: tasks divide its entries.
        """
        after, upto = start["ns"], end["ns"]
        shares: list[Share] = []
        waiting = [self.root]
        while waiting and len(shares) + len(waiting) < self.wanted:
            folder = waiting.pop(0)
            try:
                with os.scandir(folder) as entries:
                    below = list(islice((e.path for e in entries if _is_folder(e)), self.wanted + 1))
            except OSError:
                continue
            if len(below) > self.wanted:
                shares += [Share(folder, True, after, upto, i, self.wanted) for i in range(self.wanted)]
            else:
                shares.append(Share(folder, False, after, upto))
                waiting += below
        return shares + [Share(folder, True, after, upto) for folder in waiting]

    def read(self, partition: Share) -> Iterator[tuple]:
        todo = [partition.folder]
        shares = partition.shares
        while todo:
            try:
                entries = os.scandir(todo.pop())
            except OSError:
                continue
            with entries:
                for entry in entries:
                    if shares > 1 and zlib.crc32(os.fsencode(entry.name)) % shares != partition.share:
                        continue
                    try:
                        if entry.is_dir():
                            if partition.deep:
                                todo.append(entry.path)
                            continue
                        info = entry.stat()
                    except OSError:
                        continue
                    if partition.after < info.st_ctime_ns <= partition.upto:
                        yield entry.path, datetime.fromtimestamp(info.st_mtime, timezone.utc), info.st_size
            shares = 1  # only the first folder is divided


def read_tree_stream(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(SourceTreeStream)
    return spark.readStream.format("source_tree").option("path", posix_path(root)).options(**options).load()
