"""Text export of meshes as PLY and OBJ."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capturemill.sources.ranges import READ_BLOCK, file_system
from capturemill.session import checkpointed


def _number(name: str):
    return F.col(name).cast("double").cast("string")


def _joined(*parts):
    return F.concat_ws(" ", *parts)


def obj_text(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """OBJ lines as (mesh_id, section, id, value): vertices, texture coordinates, faces.

    Vertices may carry u and v, numbered alike; ids count from 0 and are written from 1.
    """
    lines = vertices.select(
        "mesh_id", F.lit(1).alias("section"), F.col("vertex_id").alias("id"),
        _joined(F.lit("v"), _number("x"), _number("y"), _number("z")).alias("value"),
    )
    textured = {"u", "v"} <= set(vertices.columns)
    if textured:
        lines = lines.unionByName(vertices.select(
            "mesh_id", F.lit(2).alias("section"), F.col("vertex_id").alias("id"),
            _joined(F.lit("vt"), _number("u"), _number("v")).alias("value"),
        ))

    def corner(name: str):
        index = (F.col(name) + 1).cast("string")
        return F.concat_ws("/", index, index) if textured else index

    return lines.unionByName(faces.select(
        "mesh_id", F.lit(3).alias("section"), F.col("face_id").alias("id"),
        _joined(F.lit("f"), corner("v0"), corner("v1"), corner("v2")).alias("value"),
    ))


def ply_text(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """ASCII PLY lines as (mesh_id, section, id, value): header, vertices, faces.

    Colours r, g, b are written where the vertices have them.
    """
    colored = {"r", "g", "b"} <= set(vertices.columns)
    counts = vertices.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("nv")).join(
        faces.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("nf")), "mesh_id", "left"
    ).fillna(0, ["nf"])
    head = [F.lit("ply"), F.lit("format ascii 1.0"), F.concat(F.lit("element vertex "), F.col("nv"))]
    head += [F.lit(f"property float {a}") for a in "xyz"]
    head += [F.lit(f"property uchar {c}") for c in ("red", "green", "blue")] if colored else []
    head += [F.concat(F.lit("element face "), F.col("nf")), F.lit("property list uchar int vertex_indices"),
             F.lit("end_header")]
    header = counts.select("mesh_id", F.lit(0).alias("section"), F.posexplode(F.array(*head)).alias("id", "value"))
    body = vertices.select(
        "mesh_id", F.lit(1).alias("section"), F.col("vertex_id").alias("id"),
        _joined(_number("x"), _number("y"), _number("z"),
                *([F.col(c).cast("int").cast("string") for c in ("r", "g", "b")] if colored else [])).alias("value"),
    )
    triangles = faces.select(
        "mesh_id", F.lit(2).alias("section"), F.col("face_id").alias("id"),
        _joined(F.lit("3"), "v0", "v1", "v2").alias("value"),
    )
    return header.unionByName(body).unionByName(triangles)


def write_lines(lines: DataFrame, folder: str, partitions: int | None = None, mode: str = "overwrite") -> None:
    """Write export lines as ordered text parts below ``folder/mesh_id=<id>/``.

    Lines are range-partitioned by mesh, section and id: parts sorted by file name
    form the file, so a huge mesh is written by many tasks.  ``partitions=1`` gives
    one part per mesh.
    """
    count = partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartitionByRange(count, "mesh_id", "section", "id").sortWithinPartitions("mesh_id", "section", "id")
    ordered.select("mesh_id", "value").write.mode(mode).partitionBy("mesh_id").text(folder)


def write_obj(vertices: DataFrame, faces: DataFrame, folder: str, partitions: int | None = None) -> None:
    write_lines(obj_text(vertices, faces), folder, partitions)


def write_ply(vertices: DataFrame, faces: DataFrame, folder: str, partitions: int | None = None) -> None:
    write_lines(ply_text(vertices, faces), folder, partitions)


def join_parts(spark: SparkSession, parts: str, folder: str, suffix: str) -> DataFrame:
    """One file ``folder/<mesh id><suffix>`` per mesh from the ordered parts that :func:`write_lines` left below ``parts``.

    The lengths of the parts that sort before a part add up to its place in the file.  Where files can be written
    at a place (local and mounted paths) every part is copied to its own by a task of its own, into a new file that takes
    its name when all parts are in; a task that runs twice writes the same bytes.  On other file systems, which only append,
    a mesh is one task that holds a block at a time.  Windows see the parts of one mesh, as many as there were writing
    tasks.  Gives (mesh_id, path, bytes, parts).
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(parts)
    mesh = F.regexp_extract("path", r"/mesh_id=([^/]*)/[^/]*$", 1)
    # only names and lengths are read here
    listed = listed.select(mesh.alias("mesh"), "path", "length")
    by_name = Window.partitionBy("mesh").orderBy("path")
    placed = listed.withColumns({
        "start": F.coalesce(F.sum("length").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "target": F.concat(F.lit(f"{folder.rstrip('/')}/"), F.col("mesh"), F.lit(suffix)),
    })
    if urlparse(folder).scheme in ("", "file"):
        mark = uuid.uuid4().hex
        # a row per part and few bytes a row: dealt one by one, or a task would copy many parts
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        copied = placed.repartition(tasks, "path").mapInPandas(lambda rows: _copied(rows, mark), "mesh string, target string, bytes long")
        # all parts are in, and not written again, before a file gets its name
        whole = checkpointed(copied).groupBy("mesh", "target").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("parts"))
        done = whole.mapInPandas(lambda rows: _renamed(rows, mark), "mesh string, target string, bytes long, parts long")
    else:
        done = placed.groupBy("mesh", "target").applyInArrow(_appended, "mesh string, target string, bytes long, parts long")
    return checkpointed(done).select(F.col("mesh").alias("mesh_id"), F.col("target").alias("path"), "bytes", "parts")


def _blocks(path: str) -> Iterator[bytes]:
    system, inner = file_system(path)
    with system.open_input_stream(inner) as source:
        while block := source.read(READ_BLOCK):
            yield block


def _local(target: str) -> str:
    return unquote(urlparse(target).path) if target.startswith("file:") else target


def _copied(batches: Iterator[pd.DataFrame], mark: str) -> Iterator[pd.DataFrame]:
    """Parts copied to their places in files that are not named yet."""
    for batch in batches:
        sizes = []
        for path, start, target in zip(batch["path"], batch["start"], batch["target"], strict=True):
            os.makedirs(os.path.dirname(_local(target)), exist_ok=True)
            out = os.open(f"{_local(target)}.{mark}", os.O_CREAT | os.O_WRONLY, 0o644)
            with os.fdopen(out, "wb") as sink:
                sink.seek(start)
                sizes.append(sum(sink.write(block) for block in _blocks(path)))
        yield batch[["mesh", "target"]].assign(bytes=sizes)


def _renamed(batches: Iterator[pd.DataFrame], mark: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for target in map(_local, batch["target"]):
            if os.path.exists(f"{target}.{mark}"):  # else a lost task has renamed it before
                os.replace(f"{target}.{mark}", target)
        yield batch


def _appended(parts: pa.Table) -> pa.Table:
    """The parts of one mesh in order, by a stream that only appends."""
    rows = sorted(zip(parts["path"].to_pylist(), parts["target"].to_pylist(), strict=True))
    system, inner = file_system(rows[0][1])
    with system.open_output_stream(inner) as sink:
        size = sum(sink.write(block) for path, _ in rows for block in _blocks(path))
    return pa.table({"mesh": parts["mesh"][:1], "target": parts["target"][:1], "bytes": [size], "parts": [len(rows)]})
