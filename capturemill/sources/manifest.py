"""Image listings and artifact listings from folders.

A tree is listed level by level, each folder of a level by one of many tasks, so a fleet of captures is never walked
by the driver.  Contents are not read, and files without bytes are listed like any other.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturemill.functions.columns import base_name
from capturemill.session import checkpointed
from capturemill.sources.ranges import file_system

# Fixed value: image file extensions, matched without case.
IMAGE_FILES = r"\.(png|jpe?g|tiff?)$"
ENTRIES = "path string, size bigint, mtime timestamp, folder boolean"
WILD = frozenset("*?[")


def _entries(folder: str, pattern: str | None) -> list[tuple]:
    """Files and folders in one folder, by a pattern for their names; linked folders are not entered."""
    system, inner = file_system(folder)
    local = isinstance(system, fs.LocalFileSystem)
    scheme = "file:" if local else folder[:folder.index(inner)]
    rows = []
    for entry in system.get_file_info(fs.FileSelector(inner)):
        below = entry.type == fs.FileType.Directory
        if (pattern is None or fnmatchcase(entry.base_name, pattern)) and not (below and local and os.path.islink(entry.path)):
            rows.append((scheme + entry.path, None if below else entry.size, entry.mtime, below))
    return rows


def _listed(level: DataFrame, pattern: str | None) -> DataFrame:
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                rows = pd.DataFrame(_entries(folder, pattern), columns=["path", "size", "mtime", "folder"])
                yield rows.astype({"size": "Int64"}).assign(mtime=pd.to_datetime(rows["mtime"], utc=True))

    return level.select("path").repartition(level.sparkSession.sparkContext.defaultParallelism, "path").mapInPandas(look, ENTRIES)


def listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Files under a folder: (path, name, size, mtime), empty files too.

    Names in the path may have wildcards (``*``, ``?``, ``[...]``); a path that names a file gives that file.  With
    ``recursive`` off only the files in the folder itself are listed.
    """
    parts = path.rstrip("/").split("/")
    fixed = next((n for n, part in enumerate(parts) if WILD & set(part)), len(parts))
    patterns, root = parts[fixed:], "/".join(parts[:fixed])
    system, inner = file_system(root or "/")
    kind = system.get_file_info(inner).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(f"no such file or folder: {root}")
    if kind == fs.FileType.File:  # seen from its folder
        parent, _, name = root.rpartition("/")
        root, patterns = parent, [name]
    level, found = spark.createDataFrame([(root or "/",)], "path string"), []
    for n, pattern in enumerate([*patterns, None], 1):
        entries = checkpointed(_listed(level, pattern))
        level = entries.where("folder")
        if n >= len(patterns):
            found.append(entries.where("NOT folder"))
    while recursive and level.limit(1).count():
        entries = checkpointed(_listed(level, None))
        level = entries.where("folder")
        found.append(entries.where("NOT folder"))
    files = reduce(DataFrame.unionByName, found)
    return files.select("path", base_name(F.col("path")).alias("name"), "size", "mtime")


def image_manifest(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Image files under a folder; all levels unless ``recursive`` is off."""
    return listing(spark, path, recursive).where(F.lower("path").rlike(IMAGE_FILES))


def artifact_listing(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts below ``path/<capture>/``: (capture_id, name, size)."""
    files = listing(spark, path)
    return files.select(
        F.regexp_extract("path", r"/(\d+)/[^/]+$", 1).try_cast("long").alias("capture_id"), "name", "size"
    )
