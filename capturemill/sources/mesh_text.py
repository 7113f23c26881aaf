"""OBJ and MTL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capturemill.functions.columns import base_name
from capturemill.operators.numbering import numbered
from capturemill.sources.text_lines import numbered_lines


def mesh_from_path(path: Column) -> Column:
    """Mesh number: the nearest folder named by a number, plain or as ``mesh_id=<number>``."""
    return F.regexp_extract(path, r"^.*/(?:mesh_id=)?(\d+)(?:/|$)", 1).try_cast("long")


def obj_lines(
    spark: SparkSession, path: str, mesh: Callable[[Column], Column] = mesh_from_path, pattern: str = "*.obj",
    parts: bool = False,
) -> DataFrame:
    """Lines of OBJ files as (mesh_id, seq, parts); blank lines and comments are dropped."""
    lines = numbered_lines(spark, path, pattern, parts)
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    words = F.split(text, r"\s+")
    return lines.where((text != "") & ~text.startswith("#")).select(
        mesh(F.col("path")).alias("mesh_id"), "seq", words.alias("parts")
    )


def parse_obj(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertices, texture coordinates and face corners from OBJ lines (mesh_id, seq, parts).

    Indices become 0-based; a corner without texture index gets -1; only the first
    three corners of a face are read.
    """
    kind = F.element_at("parts", 1)

    def rows(name: str, index: str, fields: dict[str, int]) -> DataFrame:
        kept = lines.where(kind == name).select(
            "mesh_id", "seq", *[F.element_at("parts", at).cast("double").alias(f) for f, at in fields.items()]
        )
        return numbered(kept, ["mesh_id"], "seq", index, start=0).select("mesh_id", index, *fields)

    faces = numbered(lines.where(kind == "f"), ["mesh_id"], "seq", "face_id", start=0)
    corners = faces.select("mesh_id", "face_id", F.posexplode(F.slice("parts", 2, 3)).alias("n", "text"))
    pieces = F.split("text", "/")
    vt = F.nullif(F.try_element_at(pieces, F.lit(2)), F.lit(""))
    corners = corners.select(
        "mesh_id", "face_id", (F.col("n") + 1).alias("corner"),
        (F.element_at(pieces, 1).cast("long") - 1).alias("v_idx"),
        F.coalesce(vt.cast("long") - 1, F.lit(-1).cast("long")).alias("vt_idx"),
        (F.col("face_id") * 4 + F.col("n") + 1).alias("pos"),
    )
    return rows("v", "v_idx", {"x": 2, "y": 3, "z": 4}), rows("vt", "vt_idx", {"u": 2, "v": 3}), corners


def load_obj(
    spark: SparkSession, path: str, mesh: Callable[[Column], Column] = mesh_from_path, pattern: str = "*.obj",
    parts: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``obj_v``, ``obj_vt`` and ``obj_corner`` of all OBJ files below a folder.

    ``parts`` reads the ordered text parts of an export as one file per folder.
    """
    return parse_obj(obj_lines(spark, path, mesh, pattern, parts))


def mtl_lines(spark: SparkSession, path: str, mesh: Callable[[Column], Column] = mesh_from_path) -> DataFrame:
    """Lines of MTL files as (mesh_id, seq, line)."""
    return numbered_lines(spark, path, "*.mtl").select(mesh(F.col("path")).alias("mesh_id"), "seq", "line")


def texture_names(lines: DataFrame) -> DataFrame:
    """Every texture named by a material file, in order: (mesh_id, seq, texture)."""
    name = F.regexp_extract("line", r"^\s*map_Kd\S*\s+(.*\S)", 1)
    return lines.select("mesh_id", "seq", name.alias("texture")).where(F.col("texture") != "")


def texture_map(lines: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The texture file of each mesh: (mesh_id, texture), null when there is none.

    The first ``map_Kd`` counts, looked up by its full name, then by its base name.
    Meshes whose material names no texture take the smallest image artifact with
    ``texture`` in its name.  ``artifacts`` is (mesh_id, name).
    """
    named = texture_names(lines).groupBy("mesh_id").agg(F.min_by("texture", "seq").alias("wanted"))
    # one join and one grouping by mesh, which share their exchange and order; a file passes by and is not kept
    rows = artifacts.select("mesh_id", F.col("name").alias("file")).unionByName(
        lines.select("mesh_id", F.lit(None).cast("string").alias("file")))
    low, base = F.lower("file"), base_name(F.col("wanted"))
    likely = low.rlike(r"\.(png|jpe?g)$") & F.contains(low, F.lit("texture")) & F.col("mesh_id").isNotNull()
    found = rows.join(named.hint("merge"), "mesh_id", "left").groupBy("mesh_id").agg(
        F.first("wanted").alias("wanted"), F.bool_or(F.col("file") == F.col("wanted")).alias("exact"),
        F.bool_or(F.col("file") == base).alias("by_base"), F.min(F.when(likely, F.col("file"))).alias("guess"))
    return found.select("mesh_id", F.when(F.col("wanted").isNull(), F.col("guess")).when(
        F.col("exact"), F.col("wanted")).when(F.col("by_base"), base).alias("texture"))
