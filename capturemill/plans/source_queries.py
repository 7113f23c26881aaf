"""Queries that write a lens to files and read it back through the sources."""

import os
import struct
import uuid

import pandas as pd
from pyspark.sql import functions as F

from capturemill.plans.catalog import query
from capturemill.session import shared_folder
from capturemill.sources import captures, manifest, mesh_export, mesh_text, ply, sparse_model, text_lines
from capturemill.sources.ranges import file_system


def _folder(spark):
    return f"{shared_folder(spark)}/files-{uuid.uuid4()}"


@query("log_text_round_trip", "log_lines", sql="""
    SELECT tool, line, CAST(row_number() OVER (PARTITION BY tool ORDER BY seq) AS BIGINT) AS seq FROM log_lines""")
def log_text_round_trip(spark, lens):
    """Lines written as ordered text parts per tool, read back with their line numbers."""
    folder = _folder(spark)
    lens("log_lines").repartitionByRange(8, "tool", "seq").sortWithinPartitions("tool", "seq").select(
        "tool", "line"
    ).write.partitionBy("tool").text(folder)
    lines = text_lines.numbered_lines(spark, folder, "*.txt", parts=True)
    return lines.select(F.regexp_extract("path", "tool=([a-z]+)", 1).alias("tool"), "line", "seq")


TEXT_VERTICES = "SELECT mesh_id, vertex_id, x, y, round(round(CAST(CAST(z AS FLOAT) AS DOUBLE), 9), 6) AS z"


def _mesh(lens):
    ordered = lens("vertices").withColumns({c: F.pmod(F.col("vertex_id") * m, F.lit(256)) for c, m in (("r", 1), ("g", 7), ("b", 13))})
    return ordered, lens("faces").withColumn("face_id", F.col("face_id"))


@query("ply_vertices_round_trip", "vertices", "faces", sql=f"""
    {TEXT_VERTICES}, vertex_id % 256 AS r, vertex_id * 7 % 256 AS g, vertex_id * 13 % 256 AS b FROM vertices""")
def ply_vertices_round_trip(spark, lens):
    folder = _folder(spark)
    mesh_export.write_ply(*_mesh(lens), folder, partitions=4)
    vertices, _ = ply.load_ply_text(spark, folder, pattern="part-*", parts=True)
    return vertices.select("mesh_id", "vertex_id", "x", "y", "z", "r", "g", "b")


@query("ply_faces_round_trip", "vertices", "faces", sql="""
    SELECT mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY face_id) - 1 AS face_id, v0, v1, v2 FROM faces""")
def ply_faces_round_trip(spark, lens):
    folder = _folder(spark)
    mesh_export.write_ply(*_mesh(lens), folder, partitions=4)
    _, faces = ply.load_ply_text(spark, folder, pattern="part-*", parts=True)
    return faces.select("mesh_id", "face_id", "v0", "v1", "v2")


@query("obj_vertices_round_trip", "vertices", "faces", sql="""
    SELECT mesh_id, vertex_id AS v_idx, x, y, round(round(z, 9), 6) AS z FROM vertices""")
def obj_vertices_round_trip(spark, lens):
    folder = _folder(spark)
    mesh_export.write_obj(lens("vertices"), lens("faces"), folder, partitions=4)
    return mesh_text.load_obj(spark, folder, pattern="part-*", parts=True)[0]


@query("obj_corners_round_trip", "vertices", "faces", sql="""
    WITH f AS (SELECT mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY face_id) - 1 AS face_id, v0, v1, v2 FROM faces)
    SELECT mesh_id, face_id, c AS corner, CASE c WHEN 1 THEN v0 WHEN 2 THEN v1 ELSE v2 END AS v_idx,
      CAST(-1 AS BIGINT) AS vt_idx, face_id * 4 + c AS pos FROM f JOIN (VALUES (1), (2), (3)) t(c) ON true""")
def obj_corners_round_trip(spark, lens):
    folder = _folder(spark)
    mesh_export.write_obj(lens("vertices"), lens("faces"), folder, partitions=4)
    return mesh_text.load_obj(spark, folder, pattern="part-*", parts=True)[2]


@query("obj_file_round_trip", "vertices", "faces", sql="""
    SELECT mesh_id, vertex_id AS v_idx, x, y, round(round(z, 9), 6) AS z FROM vertices""")
def obj_file_round_trip(spark, lens):
    """Vertices read from one file per mesh, joined from ordered parts."""
    folder = _folder(spark)
    mesh_export.write_obj(lens("vertices"), lens("faces"), f"{folder}/parts", partitions=4)
    mesh_export.join_parts(spark, f"{folder}/parts", f"{folder}/files", ".obj")
    return mesh_text.load_obj(spark, f"{folder}/files", lambda path: F.regexp_extract(path, r"/(\d+)\.obj$", 1).try_cast("long"))[0]


@query("captures_round_trip", "artifacts", "models", sql="SELECT * FROM models")
def captures_round_trip(spark, lens):
    """All captures with models, each given its scene, saved and loaded back."""
    folder = _folder(spark)
    scenes = lens("models").select("capture_id", F.lit("scene.mvs").alias("name"), F.lit(1000).cast("bigint").alias("size")).distinct()
    held = lens("artifacts").where("name <> 'scene.mvs'").unionByName(scenes)
    captures.save_captures({"artifacts": held.join(scenes.select("capture_id"), "capture_id", "left_semi"), "models": lens("models")}, folder)
    return captures.load_captures(spark, folder, ["models"])["models"].select("capture_id", "model", "size")


def _written_files(files, folder):
    """Write (path, bytes) rows as files of so many bytes below the folder."""
    def write(batches):
        for rows in batches:
            for path, size in zip(rows["path"], rows["bytes"], strict=True):
                _write(f"{folder}/{path}", b"x" * int(size))
            yield rows[["path"]]

    files.select("path", "bytes").mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    return folder


@query("artifact_listing", "artifacts", sql="SELECT capture_id, name, size FROM artifacts")
def artifact_listing(spark, lens):
    """A file for each artifact, as large as the table says, listed without reading any."""
    files = lens("artifacts").select(F.concat_ws("/", "capture_id", "name").alias("path"), F.col("size").alias("bytes"))
    return manifest.artifact_listing(spark, _written_files(files, _folder(spark)))


# Image files of all kinds, some in folders of their own, some empty, and files that are none.
ENDINGS = (".jpg", ".JPEG", ".png", ".tif", ".TIFF", ".txt", ".jpg.bak", ".Png")


def _image_folder(spark, lens):
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("image_id") % 8 + 1).cast("int"))
    name = F.concat(F.expr("left(name, length(name) - 4)"), ending)
    below = F.when(F.col("image_id") % 3 == 0, F.concat(F.lit("more/"), F.col("capture_id"), F.lit("/"))).otherwise("")
    files = lens("images").select(F.concat(below, name).alias("path"), (F.col("image_id") % 5).alias("bytes"))
    return _written_files(files, _folder(spark))


IMAGES_SQL = """
    SELECT left(name, length(name) - 4) || CASE image_id % 8 """ + " ".join(
    f"WHEN {i} THEN '{e}'" for i, e in enumerate(ENDINGS)) + """ END AS name, image_id % 5 AS size
    FROM images WHERE image_id % 8 NOT IN (5, 6)"""


@query("image_manifest", "images", sql=IMAGES_SQL)
def image_manifest(spark, lens):
    """Image files of any level, by ending whatever its case."""
    return manifest.image_manifest(spark, _image_folder(spark, lens)).select("name", "size")


@query("image_manifest_flat", "images", sql=IMAGES_SQL + " AND image_id % 3 > 0")
def image_manifest_flat(spark, lens):
    """Image files of the topmost level only."""
    return manifest.image_manifest(spark, _image_folder(spark, lens), recursive=False).select("name", "size")


@query("log_lines", "log_lines", sql="""
    WITH placed AS (SELECT tool, line, row_number() OVER (PARTITION BY tool ORDER BY seq) AS place FROM log_lines)
    SELECT tool, CAST(2 * place - 1 AS BIGINT) AS seq, line FROM placed""")
def log_lines(spark, lens):
    """Lines between blank ones and with blanks around them, read as one file per tool, trimmed, the blank lines dropped."""
    folder = _folder(spark)
    texts = lens("log_lines").select("tool", "seq", F.explode(F.array(
        F.struct(F.lit(0).alias("n"), F.concat(F.lit(" \t"), "line", F.lit("  ")).alias("line")),
        F.struct(F.lit(1).alias("n"), F.lit(" \t ").alias("line")),
    )).alias("e")).select("tool", "seq", "e.n", "e.line")
    # a file of its own for each tool, written in order by one task per tool
    texts.repartition("tool").sortWithinPartitions("tool", "seq", "n").select("tool", "line").write.partitionBy("tool").text(folder)
    return text_lines.log_lines(spark, folder, "*.txt").select(F.regexp_extract("path", "tool=([a-z]+)", 1).alias("tool"), "seq", "line")


# Material text: the number of a customer is a mesh, three lines each.
MATERIALS = """
    lines AS (SELECT CAST(image_id AS BIGINT) AS mesh_id, CAST(1 AS BIGINT) AS seq, 'newmtl a' AS line FROM camera_tags
      UNION ALL SELECT image_id, 2, CASE image_id % 3 WHEN 0 THEN '  map_Kd maps/skin ' || image_id || '.png' ELSE 'Ns 10' END
      FROM camera_tags
      UNION ALL SELECT image_id, 3, CASE image_id % 2 WHEN 0 THEN 'map_Kd other.jpg' ELSE 'Kd 1 1 1' END FROM camera_tags),
    files AS (SELECT image_id AS mesh_id, 'skin ' || image_id || '.png' AS name FROM camera_tags WHERE image_id % 4 > 0
      UNION ALL SELECT image_id, 'b_Texture.JPG' FROM camera_tags WHERE image_id % 5 > 0
      UNION ALL SELECT image_id, 'a_texture.png' FROM camera_tags WHERE image_id % 5 > 2
      UNION ALL SELECT image_id, 'other.jpg' FROM camera_tags WHERE image_id % 7 > 1)"""


@query("texture_map", "camera_tags", sql=f"""
    WITH {MATERIALS}
    SELECT i AS mesh_id, CASE
      WHEN i % 3 = 0 THEN CASE WHEN i % 4 > 0 THEN 'skin ' || i || '.png' END
      WHEN i % 2 = 0 THEN CASE WHEN i % 7 > 1 THEN 'other.jpg' END
      ELSE (SELECT min(name) FROM files f WHERE f.mesh_id = i AND lower(name) LIKE '%texture%') END AS texture
    FROM (SELECT image_id AS i FROM camera_tags) m""")
def texture_map(spark, lens):
    tags = lens("camera_tags").select(F.col("image_id").alias("mesh_id"))
    m = F.col("mesh_id")
    text = F.array(
        F.lit("newmtl a"),
        F.when(m % 3 == 0, F.concat(F.lit("  map_Kd maps/skin "), m, F.lit(".png"))).otherwise("Ns 10"),
        F.when(m % 2 == 0, "map_Kd other.jpg").otherwise("Kd 1 1 1"),
    )
    lines = tags.select("mesh_id", F.posexplode(text).alias("seq", "line"))
    names = F.array_compact(F.array(
        F.when(m % 4 > 0, F.concat(F.lit("skin "), m, F.lit(".png"))), F.when(m % 5 > 0, F.lit("b_Texture.JPG")),
        F.when(m % 5 > 2, F.lit("a_texture.png")), F.when(m % 7 > 1, F.lit("other.jpg")),
    ))
    return mesh_text.texture_map(lines, tags.select("mesh_id", F.explode(names).alias("name")))


# --- binary files written by tasks ---------------------------------------------------------------

# Rows per written file; bounds what one task holds.
FILE_ROWS = 5_000


def _write(path: str, data: bytes) -> None:
    system, inner = file_system(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    with system.open_output_stream(inner) as out:
        out.write(data)


def _written(df, folder, encode, key, name):
    """Write slices of each capture to ``folder/<slice>/<capture>/<name>``; gives the folder.

    A slice is a stretch of at most ``FILE_ROWS`` ids, so no task holds a capture.
    """
    def write(rows: pd.DataFrame) -> pd.DataFrame:
        slice_, capture = int(rows["slice"].iloc[0]), int(rows["capture_id"].iloc[0])
        path = f"{folder}/s{slice_}/{capture}/{name}"
        _write(path, encode(rows))
        return pd.DataFrame({"path": [path]})

    sliced = df.withColumn("slice", F.floor(F.col(key) / F.lit(FILE_ROWS)))
    sliced.groupBy("capture_id", "slice").applyInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    return folder


def _point_file(rows: pd.DataFrame) -> bytes:
    out = [struct.pack("<Q", len(rows))]
    for r in rows.itertuples():
        track = [r.point3d_id % 7, r.point3d_id % 11][: r.point3d_id % 3]
        out.append(struct.pack("<QdddBBBdQ", r.point3d_id, r.x, r.y, r.z, r.r, r.g, r.b, r.error, len(track)))
        out += [struct.pack("<II", image, n) for n, image in enumerate(track)]
    return b"".join(out)


@query("sparse_points_round_trip", "points3d", sql="""
    SELECT capture_id, point3d_id, round(x, 6) AS x, y, z, r, g, b, error, point3d_id % 3 AS track_length,
      CASE WHEN point3d_id % 3 > 0 THEN point3d_id % 7 END AS first_image FROM points3d""")
def sparse_points_round_trip(spark, lens):
    """Points written as points3D.bin files by the tasks and decoded again."""
    folder = _written(lens("points3d"), _folder(spark), _point_file, "point3d_id", "points3D.bin")
    loaded = sparse_model.good_rows(sparse_model.load_sparse_points(spark, folder))
    return loaded.select(
        "capture_id", "point3d_id", "x", "y", "z", "r", "g", "b", "error", F.size("track").alias("track_length"),
        F.try_element_at("track", F.lit(1))["image_id"].alias("first_image"),
    )


def _pose_file(rows: pd.DataFrame) -> bytes:
    out = [struct.pack("<Q", len(rows))]
    for r in rows.itertuples():
        out.append(struct.pack("<IdddddddI", r.image_id, r.qw, r.qx, r.qy, r.qz, r.tx, r.ty, r.tz, 3))
        out.append(f"é{r.image_id}.jpg".encode() + b"\x00" + struct.pack("<Q", r.image_id % 4) + bytes(24 * (r.image_id % 4)))
    return b"".join(out)


@query("poses_round_trip", "poses", sql="""
    SELECT capture_id, image_id, """ + ", ".join(f"round(round({c}, 9), 6) + 0.0 AS {c}" for c in ("qw", "qz", "tx", "tz")) + """,
      CAST(3 AS BIGINT) AS camera_id, 'é' || image_id || '.jpg' AS name, image_id % 4 AS n_points2d FROM poses""")
def poses_round_trip(spark, lens):
    """Poses written as images.bin files by the tasks and decoded again."""
    folder = _written(lens("poses"), _folder(spark), _pose_file, "image_id", "images.bin")
    return sparse_model.good_rows(sparse_model.load_poses(spark, folder)).select(
        "capture_id", "image_id", F.col("q")[0].alias("qw"), F.col("q")[3].alias("qz"),
        F.col("t")[0].alias("tx"), F.col("t")[2].alias("tz"), "camera_id", "name", "n_points2d",
    )


# --- binary PLY and textured OBJ -----------------------------------------------------------------

def _ply_file(rows: pd.DataFrame, listed: bool) -> bytes:
    """A binary file of the points in order of their ids, each three of them a triangle."""
    rows = rows.sort_values("point3d_id")
    count, head = len(rows), ["ply", "format binary_little_endian 1.0", f"element vertex {len(rows)}"]
    head += [f"property float {a}" for a in "xyz"] + [f"property uchar {c}" for c in ("red", "green", "blue")]
    head += ["property list uchar uint view_indices"] if listed else []
    head += [f"element face {count // 3}", "property list uchar int vertex_indices", "end_header"]
    out = ["\n".join(head).encode() + b"\n"]
    for r in rows.itertuples():
        out.append(struct.pack("<fffBBB", r.x, r.y, r.z, r.r, r.g, r.b))
        if listed:
            views = [r.point3d_id % 5, r.point3d_id % 9][: r.point3d_id % 3]
            out.append(struct.pack(f"<B{len(views)}I", len(views), *views))
    out += [struct.pack("<Biii", 3, n, n + 1, n + 2) for n in range(0, count // 3 * 3, 3)]
    return b"".join(out)


def _ply_files(spark, lens, listed):
    def encode(rows: pd.DataFrame) -> bytes:
        return _ply_file(rows, listed)

    folder = _written(lens("points3d"), _folder(spark), encode, "point3d_id", "cloud.ply")
    return ply.load_ply(spark, folder)


FLOATS = ", ".join(f"round(round(CAST(CAST({a} AS FLOAT) AS DOUBLE), 9), 6) AS {a}" for a in "xyz")
TRIANGLES = f"""
    SELECT capture_id AS mesh_id, CAST(sum(n // 3) AS BIGINT) AS faces, CAST(sum(3 * (n // 3 * (n // 3 - 1) // 2)) AS BIGINT) AS first_corners
    FROM (SELECT capture_id, count(*) AS n FROM points3d GROUP BY capture_id, floor(point3d_id / {FILE_ROWS})) s GROUP BY 1"""


def _triangle_counts(faces):
    return faces.where("v1 = v0 + 1 AND v2 = v0 + 2").groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("faces"), F.sum("v0").alias("first_corners"))


@query("binary_ply_vertices", "points3d", sql=f"SELECT capture_id AS mesh_id, {FLOATS}, r, g, b FROM points3d")
def binary_ply_vertices(spark, lens):
    """Points written as binary PLY files of fixed records, read by byte ranges."""
    return _ply_files(spark, lens, False)[0].select("mesh_id", "x", "y", "z", "r", "g", "b")


@query("binary_ply_faces", "points3d", sql=TRIANGLES)
def binary_ply_faces(spark, lens):
    return _triangle_counts(_ply_files(spark, lens, False)[1])


@query("listed_ply_vertices", "points3d", sql=f"""
    SELECT capture_id AS mesh_id, {FLOATS}, r, g, b, point3d_id % 3 AS views,
      CASE WHEN point3d_id % 3 > 0 THEN point3d_id % 5 END AS first_view FROM points3d""")
def listed_ply_vertices(spark, lens):
    """The same points with a list of views each, so that no record has a fixed place."""
    return _ply_files(spark, lens, True)[0].select(
        "mesh_id", "x", "y", "z", "r", "g", "b", F.size("views").alias("views"), F.try_element_at("views", F.lit(1)).alias("first_view"))


@query("listed_ply_faces", "points3d", sql=TRIANGLES)
def listed_ply_faces(spark, lens):
    return _triangle_counts(_ply_files(spark, lens, True)[1])


def _textured(spark, lens):
    folder = _folder(spark)
    vertices = lens("vertices").withColumns({"u": F.col("x") / 20, "v": F.col("y") / 128})
    mesh_export.write_obj(vertices, lens("faces"), folder, partitions=4)
    return mesh_text.load_obj(spark, folder, pattern="part-*", parts=True)


@query("obj_texture_round_trip", "vertices", "faces", sql="""
    SELECT mesh_id, vertex_id AS vt_idx, round(round(x / 20, 9), 6) AS u, round(round(y / 128, 9), 6) AS v FROM vertices""")
def obj_texture_round_trip(spark, lens):
    return _textured(spark, lens)[1]


@query("obj_textured_corners_round_trip", "vertices", "faces", sql="""
    WITH f AS (SELECT mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY face_id) - 1 AS face_id, v0, v1, v2 FROM faces)
    SELECT mesh_id, face_id, c AS corner, CASE c WHEN 1 THEN v0 WHEN 2 THEN v1 ELSE v2 END AS v_idx,
      CASE c WHEN 1 THEN v0 WHEN 2 THEN v1 ELSE v2 END AS vt_idx, face_id * 4 + c AS pos
    FROM f JOIN (VALUES (1), (2), (3)) t(c) ON true""")
def obj_textured_corners_round_trip(spark, lens):
    return _textured(spark, lens)[2]
