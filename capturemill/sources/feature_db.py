"""Feature and match databases: fleets of SQLite files, read inside tasks."""

from __future__ import annotations

import os
import shutil
import sqlite3
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capturemill.session import checkpointed
from capturemill.sources.ranges import file_system
from capturemill.sources.sparse_model import capture_from_path

# The three questions asked of each database.
QUESTIONS = {
    "image": "SELECT image_id, NULL, name FROM images",
    "keypoints": "SELECT image_id, rows, NULL FROM keypoints",
    "pair": "SELECT pair_id, rows, NULL FROM two_view_geometries",
}
FETCH = 50_000
COLUMNS = "path string, kind string, id bigint, rows bigint, name string, problem string"


def _answers(path: str) -> Iterator[pd.DataFrame]:
    """Rows of one database, copied next to the task because SQLite needs a local file."""
    system, inner = file_system(path)
    with tempfile.TemporaryDirectory() as folder:
        local = os.path.join(folder, "features.db")
        with system.open_input_stream(inner) as source, open(local, "wb") as target:
            shutil.copyfileobj(source, target)
        try:
            base = sqlite3.connect(f"file:{local}?mode=ro", uri=True)
            try:
                for kind, sql in QUESTIONS.items():
                    found = base.execute(sql)
                    while rows := found.fetchmany(FETCH):
                        ids, counts, names = zip(*rows)
                        yield _frame(path, kind, ids, counts, names, [None] * len(rows))
            finally:
                base.close()
        except sqlite3.Error as problem:
            yield _frame(path, "problem", [None], [None], [None], [str(problem)])


def _frame(path, kind, ids, counts, names, told) -> pd.DataFrame:
    return pd.DataFrame({
        "path": path, "kind": kind, "id": pd.array(ids, dtype="Int64"), "rows": pd.array(counts, dtype="Int64"),
        "name": pd.Series(names, dtype=object), "problem": pd.Series(told, dtype=object),
    })


def load_feature_db(
    spark: SparkSession, path: str, capture: Callable[[Column], Column] = capture_from_path, pattern: str = "*.db"
) -> dict[str, DataFrame]:
    """Tables ``images``, ``keypoints``, ``pairs`` and ``problems`` of all databases below a folder.

    Each database is read once; the four tables share the checkpointed rows.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch["path"]:
                yield from _answers(file)

    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(path).select("path").repartition(spark.sparkContext.defaultParallelism)
    )
    rows = checkpointed(files.mapInPandas(read, COLUMNS).withColumn("capture_id", capture(F.col("path"))))

    def of(kind: str, *columns) -> DataFrame:
        return rows.where(F.col("kind") == kind).select("capture_id", *columns)

    return {
        "images": of("image", F.col("id").alias("image_id"), "name"),
        "keypoints": of("keypoints", F.col("id").alias("image_id"), "rows"),
        "pairs": of("pair", F.col("id").alias("pair_id"), "rows"),
        "problems": of("problem", "path", "problem"),
    }
