"""Source trees as tables.

Built-in file sources skip names that start with ``_`` or ``.``, which source trees are full of
(``__init__.py``). So directories are listed by tasks, level by level, and the files' bytes are read
by tasks after the listing was dealt out by path: neither a project with most of the files nor a
deep folder ends up in one task, and the driver never holds a listing.
"""

from __future__ import annotations

import os
import stat
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..storage import posix_path, run_dir

LISTED = ("project string, path string, is_dir boolean, modified timestamp, length bigint, id string, linked boolean, "
          "above array<string>, names array<string>")
BATCH_BYTES = 64 << 20
# What a task reads, about.
TASK_BYTES = 256 << 20
# Entries that one task looks at; those of a folder with more are dealt out by name.
FOLDER_ENTRIES = 10_000


def _id(info: os.stat_result) -> str:
    return f"{info.st_dev}:{info.st_ino}"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = ["project", "path", "is_dir", "modified", "length", "id", "linked", "above", "names"]
    frame = pd.DataFrame(rows, columns=columns)
    frame["modified"] = pd.to_datetime(frame["modified"] // 1000, unit="us", utc=True)
    return frame


def _folder_rows(project: str, folder: str, linked: bool, above: list[str], names: list[str] | None, most: int) -> Iterator[tuple]:
    """What a folder, or the ``names`` in it, holds. Unreadable folders and entries are left out, and links to a folder above.

    A folder with more than ``most`` entries gives rows of as many names, so that it is read once, however large it is.
    """
    try:
        own = _id(os.stat(folder))
        entries = os.scandir(folder) if names is None else None
    except OSError:
        return
    if entries is not None:
        with entries:
            names = [e.name for e in islice(entries, most + 1)]
            if len(names) > most:
                rest = chain(names, (e.name for e in entries))
                while lot := list(islice(rest, most)):
                    yield project, folder, True, 0, 0, own, linked, above, lot
                return
    below = [*above, own]
    for name in names:
        path = os.path.join(folder, name)
        try:
            info = os.stat(path)
            link = linked or os.path.islink(path)
        except OSError:
            continue
        if not stat.S_ISDIR(info.st_mode):
            yield project, path, False, info.st_mtime_ns, info.st_size, None, link, None, None
        elif _id(info) not in below:
            yield project, path, True, info.st_mtime_ns, info.st_size, _id(info), link, below, None


def _list_folders(most: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in frame.itertuples(index=False):
                given = None if at.names is None else list(at.names)
                rows = _folder_rows(at.project, at.path, bool(at.linked), list(at.above), given, most)
                some: list[tuple] = []
                for row in rows:
                    some.append(row)
                    # Many names are a frame of their own.
                    if len(some) == 10_000 or row[-1] is not None:
                        yield _frame(some)
                        some = []
                if some:
                    yield _frame(some)

    return run


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``: ``path, modified, length``. One job per level of the tree."""
    return list_trees(spark, {"": root}).drop("project")


def list_trees(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """All files of several projects: ``project, path, modified, length``. One job per level of the deepest tree.

    Links are followed. A link to a folder above it is a loop and is not entered. Any other folder is entered by its own
    path, and once more below links: by the link of the lowest level, of those the first by path. The folders entered
    below links are a table that each level is joined against, so that links that lead to each other end. A folder of
    very many entries is read once, and its names are dealt out to several tasks of the next job.
    """
    base = run_dir(spark, "listing")
    start = [(p, posix_path(root), False, [], None) for p, root in roots.items()]
    level, folders = 0, spark.createDataFrame(start, "project string, path string, linked boolean, above array<string>, names array<string>")
    entered = f"{base}.entered"
    while True:
        out = f"{base}/level={level}"
        folders.mapInPandas(_list_folders(FOLDER_ENTRIES), LISTED).write.parquet(out)
        found = spark.read.schema(LISTED).parquet(out).filter("is_dir")
        if found.isEmpty():
            break
        # Folders whose names are dealt out have been entered already.
        new = found.filter("linked and names is null").groupBy("project", "id").agg(F.min(F.struct("path", "above")).alias("f"))
        if level:
            new = new.join(spark.read.schema("project string, id string").parquet(entered), ["project", "id"], "left_anti")
        new.select("project", "id", "f.path", "f.above").write.parquet(f"{entered}/level={level}")
        new = spark.read.schema("project string, id string, path string, above array<string>").parquet(f"{entered}/level={level}")
        whole = F.lit(None).cast("array<string>").alias("names")
        folders = (
            found.filter("not linked and names is null").select("project", "path", "linked", "above", whole)
            .unionByName(new.select("project", "path", F.lit(True).alias("linked"), "above", whole))
            .unionByName(found.filter("names is not null").select("project", "path", "linked", "above", "names"))
            # Deal the next level out evenly, however its folders are spread.
            .repartition(spark.sparkContext.defaultParallelism * 4)
        )
        level += 1
    files = spark.read.schema(LISTED).parquet(base).filter("not is_dir")
    return files.select("project", "path", "modified", "length")


def _read_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add each file's bytes; a file that cannot be read has NULL. Batches are bounded by bytes."""
    for frame in frames:
        start, size = 0, 0
        lengths = frame["length"].tolist()
        for i, length in enumerate([*lengths, None]):
            if length is not None and (i == start or size + length <= BATCH_BYTES):
                size += length
                continue
            piece = frame.iloc[start:i].copy()
            contents = []
            for path in piece["path"]:
                try:
                    with open(path, "rb") as file:
                        contents.append(file.read())
                except OSError:
                    contents.append(None)
            piece["content"] = contents
            if len(piece):
                yield piece
            start, size = i, length or 0


def read_files(files: DataFrame) -> DataFrame:
    """``files`` with a binary ``content``, read by tasks that got their share of the paths."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(_read_files, f"{schema}, content binary")


def partitions_for(files: DataFrame) -> int:
    """How many tasks are to read listed files, by their bytes."""
    total = files.agg(F.sum("length")).first()[0] or 0
    return max(files.sparkSession.sparkContext.defaultParallelism * 4, -(-total // TASK_BYTES))


def source_tree_scan(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = None,
                     partitions: int | None = None) -> DataFrame:
    """Every file below ``root``: ``path, modified, length, content``.

    ``extensions`` drops other files before any byte is read.
    """
    files = list_tree(spark, root)
    if extensions is not None:
        files = source_file_filter(files, extensions)
    return read_files(files.repartition(partitions or partitions_for(files), "path"))


def source_file_filter(df: DataFrame, extensions: tuple[str, ...] = tx.SOURCE_EXTENSIONS) -> DataFrame:
    """Keep paths whose last extension is in the list; case matters."""
    return df.filter(tx.extension(F.col("path")).isin(*extensions))


def decode_text(df: DataFrame) -> DataFrame:
    """Binary ``content`` as text; files that are not UTF-8 are left out, see ``decode_rejects``."""
    return df.filter(_valid()).withColumn("content", F.col("content").cast("string"))


def decode_rejects(df: DataFrame) -> DataFrame:
    """The files ``decode_text`` leaves out, unreadable ones included."""
    return df.filter(~_valid()).drop("content")


def _valid():
    return F.coalesce(F.is_valid_utf8(F.col("content").cast("string")), F.lit(False))


def read_record_file(spark: SparkSession, path: str) -> DataFrame:
    """The lines of stored record files as ``record``; lines that are not UTF-8 are left out."""
    return spark.read.text(path).filter(F.is_valid_utf8("value")).withColumnRenamed("value", "record")
