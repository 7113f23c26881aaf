"""Binary sparse models: fleets of points3D.bin and images.bin files.

Records have variable length.  Small files are one unit of work each; of a large file
each byte range is searched for the records it holds (:mod:`capturemill.sources.chains`), and
ranges are then decoded by as many tasks.  No file is read from its front to its end by one task.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturemill.session import checkpointed
from capturemill.sources.chains import Reader, Step, record_ranges
from capturemill.sources.ranges import SPLIT_BYTES, FileCursor, in_batches

# Record layouts, little-endian.
POINT_RECORD = "<QdddBBBd"
IMAGE_RECORD = "<IdddddddI"
COUNT = "<Q"
TRACK_ITEM_BYTES = 8
POINT2D_BYTES = 24
LARGEST_ID = 2**63 - 1
POINT = np.dtype([("id", "<u8"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("error", "<f8"), ("length", "<u8")])
BLOCK_BYTES = 8 << 20

POINT_COLUMNS = (
    "path string, point3d_id bigint, x double, y double, z double, r smallint, g smallint, b smallint, error double, "
    "track array<struct<image_id:bigint,point2d_idx:bigint>>, problem string"
)
POINT_ARROW = pa.schema([
    ("path", pa.string()), ("point3d_id", pa.int64()), *((c, pa.float64()) for c in "xyz"), *((c, pa.int16()) for c in "rgb"),
    ("error", pa.float64()), ("track", pa.list_(pa.struct([("image_id", pa.int64()), ("point2d_idx", pa.int64())]))), ("problem", pa.string()),
])
POSE_COLUMNS = (
    "path string, image_id bigint, q array<double>, t array<double>, camera_id bigint, name string, "
    "n_points2d bigint, problem string"
)


def _take(cursor: FileCursor, layout: str) -> tuple:
    return struct.unpack(layout, cursor.exactly(struct.calcsize(layout)))


def capture_from_path(path: F.Column) -> F.Column:
    """Capture number: the nearest folder above the file whose name is a number."""
    return F.regexp_extract(path, r"^.*/(\d+)/", 1).try_cast("long")


def load_sparse_points(
    spark: SparkSession, path: str, capture: Callable[[F.Column], F.Column] = capture_from_path, tracks: bool = True,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Points of all points3D.bin files below a folder.

    A damaged file gives the points before the damage, then one row with only
    ``problem`` set.  ``tracks=False`` skips the tracks while decoding.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from _point_batches(r["path"], r["at"], r["records"], r["problem"], tracks)

    ranges = _ranges(spark, path, "points3D.bin", _after_point, split_bytes)
    return ranges.mapInArrow(decode, POINT_COLUMNS).withColumn("capture_id", capture(F.col("path")))


def _point_batches(file: str, at: int, count: int, problem: str | None, tracks: bool) -> Iterator[pa.RecordBatch]:
    """Points of one range, decoded block by block: a walk over the track lengths finds the records, arrays the rest.

    A track that the file cuts short keeps its whole items.
    """
    head = POINT.itemsize
    cursor = FileCursor(file, at)
    data, left = b"", 0 if problem else count
    try:
        while left and not problem:
            data += cursor.take(BLOCK_BYTES)
            ended = cursor.left == 0
            places, sizes, place = [], [], 0
            while left and place + head <= len(data):
                size = int.from_bytes(data[place + head - 8:place + head], "little") * TRACK_ITEM_BYTES
                if place + head + size > len(data):
                    if not ended:
                        break
                    size = (len(data) - place - head) // TRACK_ITEM_BYTES * TRACK_ITEM_BYTES
                    places.append(place)
                    sizes.append(size)
                    place, left = len(data), left - 1
                    break
                places.append(place)
                sizes.append(size)
                place, left = place + head + size, left - 1
            found, problem = _points_at(file, data, np.array(places, np.int64), np.array(sizes, np.int64), tracks)
            if found.num_rows:
                yield found
            data = data[place:]
            if left and ended and not problem:
                fixed = struct.calcsize(POINT_RECORD)
                problem = f"file ends {(fixed if len(data) < fixed else head) - len(data)} bytes early"
    finally:
        cursor.close()
    if problem:
        yield pa.RecordBatch.from_pylist([{"path": file, "problem": problem}], schema=POINT_ARROW)


def _points_at(file: str, data: bytes, places: np.ndarray, sizes: np.ndarray, tracks: bool) -> tuple[pa.RecordBatch, str | None]:
    """Records at some places of a block, up to the first whose id does not fit; and what is wrong with that."""
    raw = np.frombuffer(data, np.uint8)
    rows = raw[places[:, None] + np.arange(POINT.itemsize)].view(POINT).ravel() if len(places) else np.zeros(0, POINT)
    large = np.flatnonzero(rows["id"] > LARGEST_ID)
    problem = None
    if len(large):
        problem = f"point id {rows['id'][large[0]]} does not fit a signed 64-bit number"
        rows, places, sizes = rows[:large[0]], places[:large[0]], sizes[:large[0]]
    track = pa.nulls(len(rows), POINT_ARROW.field("track").type)
    if tracks:
        ends = np.cumsum(sizes)
        at = np.arange(int(sizes.sum())) + np.repeat(places + POINT.itemsize - (ends - sizes), sizes)
        items = raw[at].view("<u4").astype(np.int64).reshape(-1, 2)
        pairs = pa.StructArray.from_arrays([pa.array(items[:, 0]), pa.array(items[:, 1])], ["image_id", "point2d_idx"])
        offsets = np.concatenate([[0], ends // TRACK_ITEM_BYTES]).astype(np.int32)
        track = pa.ListArray.from_arrays(offsets, pairs)
    columns = [pa.array([file] * len(rows), pa.string()), pa.array(rows["id"].astype(np.int64))]
    columns += [pa.array(rows[c]) for c in "xyz"] + [pa.array(rows[c].astype(np.int16)) for c in "rgb"]
    columns += [pa.array(rows["error"]), track, pa.nulls(len(rows), pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=POINT_ARROW), problem


def load_poses(
    spark: SparkSession, path: str, capture: Callable[[F.Column], F.Column] = capture_from_path,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Camera poses of all images.bin files below a folder; damage is told as for points."""
    def pose(cursor: FileCursor) -> tuple:
        ident, *numbers, camera = _take(cursor, IMAGE_RECORD)
        name = cursor.until(b"\x00").decode("utf-8", errors="ignore")
        points = _take(cursor, COUNT)[0]
        cursor.skip(points * POINT2D_BYTES)
        return ident, numbers[:4], numbers[4:], camera, name, points

    return _decoded(spark, path, "images.bin", pose, POSE_COLUMNS, capture, split_bytes)


RANGE_COLUMNS = "path string, at bigint, records bigint, problem string"


# Records of images hold thousands of image points, so a range may begin far from the next record.
IMAGE_WINDOW = 1 << 19


def _after_point(reader: Reader, place: int) -> int | None:
    length = reader.number(place + POINT.itemsize - 8, 8)
    after = None if length is None else place + POINT.itemsize + length * TRACK_ITEM_BYTES
    return after if after is not None and after <= reader.size else None


def _after_image(reader: Reader, place: int) -> int | None:
    at = place + struct.calcsize(IMAGE_RECORD)
    while (end := (name := reader.take(at, 256)).find(b"\x00")) < 0:
        if len(name) < 256:
            return None
        at += 256
    points = reader.number(at + end + 1, 8)
    after = None if points is None else at + end + 9 + points * POINT2D_BYTES
    return after if after is not None and after <= reader.size else None


def _ranges(spark: SparkSession, path: str, file_name: str, step: Step, split_bytes: int, window: int | None = None) -> DataFrame:
    """Ranges of records (path, at, records, problem) of all files of a name."""
    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file in batch["path"]:
                cursor = FileCursor(file)
                try:
                    rows.append((file, 8, _take(cursor, COUNT)[0], None))
                except EOFError as problem:
                    rows.append((file, 0, 0, str(problem)))
                finally:
                    cursor.close()
            yield pd.DataFrame(rows, columns=["path", "at", "records", "problem"])

    slots = spark.sparkContext.defaultParallelism
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", file_name).load(path).select("path", "length")
    ranges = files.repartition(slots).mapInPandas(heads, RANGE_COLUMNS)
    large = files.where(F.col("length") > split_bytes)
    if large.limit(1).count():
        counted = ranges.join(large, "path").select(
            "path", F.col("length").alias("size"), F.col("at").alias("start"), F.col("records").alias("count"), F.lit(None).cast("string").alias("layout"))
        cut = record_ranges(checkpointed(counted), lambda _: step, split_bytes, **({"window": window} if window else {}))
        ranges = ranges.join(large, "path", "left_anti").unionByName(cut.withColumn("problem", F.lit(None).cast("string")))
    return ranges.repartition(slots, "path", "at")


def _decoded(spark, path, file_name, record, columns, capture, split_bytes) -> DataFrame:
    names = [field.split(" ")[0] for field in columns.split(", ")]
    width = len(names) - 2

    def rows_of(file: str, at: int, count: int, problem: str | None) -> Iterator[tuple]:
        cursor = FileCursor(file, at)
        try:
            for _ in range(count):
                yield file, *record(cursor), None
        except Exception as damage:  # noqa: BLE001 - told in the row
            problem = str(damage)
        finally:
            cursor.close()
        if problem:
            yield file, *[None] * width, problem

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                for rows in in_batches(rows_of(r.path, r.at, r.records, r.problem)):
                    yield pd.DataFrame({
                        name: pd.Series([row[i] for row in rows], dtype=object) for i, name in enumerate(names)
                    })

    ranges = _ranges(spark, path, file_name, _after_image, split_bytes, IMAGE_WINDOW)
    return ranges.mapInPandas(decode, columns).withColumn("capture_id", capture(F.col("path")))


def good_rows(decoded: DataFrame) -> DataFrame:
    """Rows that were read, without the bookkeeping columns."""
    return decoded.where(F.col("problem").isNull()).drop("problem", "path")


def problems(decoded: DataFrame) -> DataFrame:
    """One row per damaged file."""
    return decoded.where(F.col("problem").isNotNull()).select("capture_id", "path", "problem")
