"""Files written byte by byte, read back through the sources."""

import os
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from capturemill.sources import captures, feature_db, manifest, mesh_export, mesh_text, ply, sparse_model


def point(ident, xyz, rgb, error, track):
    head = struct.pack("<QdddBBBd", ident, *xyz, *rgb, error) + struct.pack("<Q", len(track))
    return head + b"".join(struct.pack("<II", i, p) for i, p in track)


def points_file(*records, count=None):
    return struct.pack("<Q", len(records) if count is None else count) + b"".join(records)


def put(folder, name, data):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())


def test_sparse_points(spark, tmp_path):
    records = [point(7, (1.5, -2.0, 3.25), (255, 0, 128), 0.5, [(1, 10), (4294967295, 3)]),
               point(8, (0, 0, 0), (1, 2, 3), 1.25, []), point(9, (9, 9, 9), (0, 0, 0), 2.0, [(3, 1)])]
    put(tmp_path / "1" / "sparse", "points3D.bin", points_file(*records))
    put(tmp_path / "2" / "sparse", "points3D.bin", points_file())
    put(tmp_path / "3" / "sparse", "points3D.bin", points_file(*records)[:-70])
    put(tmp_path / "4" / "sparse", "points3D.bin", points_file(point(2**63, (0, 0, 0), (0, 0, 0), 0, [])))
    put(tmp_path / "5" / "sparse", "points3D.bin", b"\x01")
    loaded = sparse_model.load_sparse_points(spark, str(tmp_path)).cache()
    good = sorted((r["capture_id"], r["point3d_id"]) for r in sparse_model.good_rows(loaded).collect())
    assert good == [(1, 7), (1, 8), (1, 9), (3, 7)]
    first = loaded.where("capture_id = 1 AND point3d_id = 7").first()
    assert (first["x"], first["y"], first["z"], first["r"], first["g"], first["b"], first["error"]) == (1.5, -2.0, 3.25, 255, 0, 128, 0.5)
    assert [tuple(t) for t in first["track"]] == [(1, 10), (4294967295, 3)]
    assert sorted(r["capture_id"] for r in sparse_model.problems(loaded).collect()) == [3, 4, 5]
    cut = sparse_model.load_sparse_points(spark, str(tmp_path), split_bytes=30)
    assert sorted(map(repr, cut.select(*loaded.columns).collect())) == sorted(map(repr, loaded.collect()))
    bare = sparse_model.load_sparse_points(spark, str(tmp_path / "1"), tracks=False)
    assert [r["track"] for r in bare.collect()] == [None] * 3


def test_truncated_last_track_is_like_the_reader_that_skips(spark, tmp_path):
    """A cut inside the last track still gives that point, as its own fields are whole."""
    data = points_file(point(1, (0, 0, 0), (0, 0, 0), 0, [(1, 1), (2, 2)]))[:-4]
    put(tmp_path / "1", "points3D.bin", data)
    row = sparse_model.load_sparse_points(spark, str(tmp_path)).collect()
    assert len(row) == 1 and row[0]["point3d_id"] == 1 and row[0]["problem"] is None


def pose(ident, q, t, camera, name, n2d):
    return struct.pack("<IdddddddI", ident, *q, *t, camera) + name + b"\x00" + struct.pack("<Q", n2d) + bytes(24 * n2d)


def test_poses(spark, tmp_path):
    half = 0.5**0.5
    whole = struct.pack("<Q", 2) + pose(1, (1, 0, 0, 0), (1, 2, 3), 5, "café 1.jpg".encode(), 3) + pose(
        2, (half, 0, 0, half), (1, 0, 0), 5, b"b\xff.jpg", 0)
    put(tmp_path / "11", "images.bin", whole)
    put(tmp_path / "12", "images.bin", whole[:-100])
    loaded = sparse_model.load_poses(spark, str(tmp_path)).cache()
    cut = sparse_model.load_poses(spark, str(tmp_path), split_bytes=30)
    assert sorted(map(repr, cut.select(*loaded.columns).collect())) == sorted(map(repr, loaded.collect()))
    good = {(r["capture_id"], r["image_id"]): r for r in sparse_model.good_rows(loaded).collect()}
    assert set(good) == {(11, 1), (11, 2), (12, 1)}
    assert good[11, 1]["name"] == "café 1.jpg" and good[11, 2]["name"] == "b.jpg"
    assert good[11, 1]["n_points2d"] == 3 and good[11, 1]["camera_id"] == 5
    from capturemill.operators.poses import camera_frustums, with_camera_frame

    frames = {r["image_id"]: r for r in with_camera_frame(sparse_model.good_rows(loaded)).where("capture_id = 11").collect()}
    assert tuple(frames[1]["center"]) == (-1.0, -2.0, -3.0)
    assert [round(v, 9) for v in frames[2]["center"]] == [0, 1, 0]
    ends = camera_frustums(sparse_model.good_rows(loaded).where("capture_id = 11 AND image_id = 1")).orderBy("endpoint").collect()
    assert len(ends) == 16 and (ends[1]["x"], ends[1]["y"], ends[1]["z"]) == pytest.approx((-1.12, -2.08, -2.85))
    assert ends[15]["x"] == ends[1]["x"] and ends[14]["y"] == pytest.approx(-1.92)


PLY_HEAD = "ply\nformat {} 1.0\ncomment x\nelement vertex {}\n{}element face {}\nproperty list uchar int vertex_indices\nend_header\n"
XYZ = "property float x\nproperty float y\nproperty float z\n"


def triangle(*v, n=3):
    return struct.pack("<B" + "i" * n, n, *v)


def vertices_of(spark, folder):
    return [tuple(r[c] for c in ("vertex_id", "x", "y", "z", "r", "g", "b"))
            for r in ply.load_ply(spark, str(folder))[0].orderBy("vertex_id").collect()]


def faces_of(spark, folder):
    return [tuple(r[c] for c in ("face_id", "v0", "v1", "v2")) for r in ply.load_ply(spark, str(folder))[1].orderBy("face_id").collect()]


def test_ply_fixed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ply, "RANGE_BYTES", 40)
    props = "property double x\nproperty float y\nproperty short z\nproperty uchar r\nproperty uchar g\nproperty uchar b\n"
    body = b"".join(struct.pack("<dfhBBB", i, i + 0.5, -i, i, 200, 255) for i in range(9))
    faces = b"".join(triangle(i, i + 1, i + 2) for i in range(7))
    put(tmp_path / "a" / "1", "m.ply", PLY_HEAD.format("binary_little_endian", 9, props, 7).encode() + body + faces)
    assert vertices_of(spark, tmp_path / "a") == [(i, i, i + 0.5, -i, i, 200, 255) for i in range(9)]
    assert faces_of(spark, tmp_path / "a") == [(i, i, i + 1, i + 2) for i in range(7)]
    put(tmp_path / "b" / "1", "m.ply", PLY_HEAD.format("binary_little_endian", 1, XYZ, 2).encode() + struct.pack("<fff", 1, 2, 3) + faces[:20])
    assert vertices_of(spark, tmp_path / "b") == [(0, 1, 2, 3, 255, 255, 255)]
    assert faces_of(spark, tmp_path / "b") == []
    put(tmp_path / "c" / "1", "m.ply", PLY_HEAD.format("binary_little_endian", 2, XYZ, 0).encode() + struct.pack("<fff", 1, 2, 3))
    told = ply.load_ply(spark, str(tmp_path / "c"))[0].collect()
    assert len(told) == 1 and "too short" in told[0]["problem"]
    put(tmp_path / "d" / "1", "m.ply", PLY_HEAD.format("binary_little_endian", 0, XYZ, 0))
    assert vertices_of(spark, tmp_path / "d") == []


@pytest.mark.parametrize("size", [20, 1 << 20])
def test_ply_list_property(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(ply, "RANGE_BYTES", size)
    props = XYZ + "property uchar red\nproperty list uint8 uint32 view_indices\nproperty list uchar float view_weights\n"
    body = b"".join(struct.pack("<fffB", i, 0, 1, 9) + struct.pack("<B" + "I" * i, i, *range(i)) + struct.pack("<Bf", 1, 2.0) for i in range(4))
    put(tmp_path / "1", "m.ply", PLY_HEAD.format("binary_little_endian", 4, props, 2).encode() + body + triangle(0, 1, 2) + triangle(1, 2, 3))
    assert vertices_of(spark, tmp_path) == [(i, i, 0, 1, 9, 255, 255) for i in range(4)]
    assert faces_of(spark, tmp_path) == [(0, 0, 1, 2), (1, 1, 2, 3)]
    views = {r["vertex_id"]: r["views"] for r in ply.load_ply(spark, str(tmp_path))[0].collect()}
    assert views[3][:3] == [0, 1, 2]
    data = (tmp_path / "1" / "m.ply").read_bytes()
    put(tmp_path / "cut" / "1", "m.ply", data[:-40])
    told = ply.load_ply(spark, str(tmp_path / "cut"))
    assert [bool(r["problem"]) for r in told[0].collect()] == [True] and told[1].count() == 0


@pytest.mark.parametrize("size", [7, 16, 1 << 20])
def test_ply_ascii(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(ply, "RANGE_BYTES", size)
    lines = [f"{i} {i}.5 -1 {i} 2 3" if i % 2 else f"{i} 0 0" for i in range(20)] + ["3 0 1 2", "4 0 1 2 3", "3 4 5 6 9"]
    put(tmp_path / "8", "m.ply", PLY_HEAD.format("ascii", 20, XYZ, 3) + "\n".join(lines) + "\n")
    assert vertices_of(spark, tmp_path) == [(i, i, i + 0.5, -1, i, 2, 3) if i % 2 else (i, i, 0, 0, 255, 255, 255) for i in range(20)]
    assert faces_of(spark, tmp_path) == [(0, 0, 1, 2), (2, 4, 5, 6)]
    assert ply.load_ply(spark, str(tmp_path))[0].first()["mesh_id"] == 8


def test_ply_refusals(spark, tmp_path):
    put(tmp_path / "1", "m.ply", PLY_HEAD.format("binary_big_endian", 0, XYZ, 0))
    put(tmp_path / "2", "m.ply", PLY_HEAD.format("binary_little_endian", 0, "property list uchar int a\n" + XYZ, 0))
    put(tmp_path / "3", "m.ply", "ply\nformat ascii 1.0\n")
    for n, text in ((1, "big-endian"), (2, "after a list"), (3, "end_header")):
        with pytest.raises(Exception, match=text):
            ply.load_ply(spark, str(tmp_path / str(n)))[0].collect()
    told = ply.load_ply(spark, str(tmp_path), strict=False)[0].collect()
    assert sorted(r["mesh_id"] for r in told) == [1, 2, 3] and all(r["problem"] for r in told)


OBJ = """# comment
mtllib m.mtl
v 0 0 0
v 1 0 0 1.0

v 1 1 0
vt 0.5 0.25
f 1 2 3
  f 1/1 2//7 3/2/1 1/1
f 3/1 2/1 1/1 # tail
"""


def test_obj_and_materials(spark, tmp_path):
    put(tmp_path / "4", "m.obj", OBJ)
    v, vt, corners = mesh_text.load_obj(spark, str(tmp_path))
    assert [tuple(r)[1:] for r in v.orderBy("v_idx").collect()] == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 0)]
    assert [tuple(r) for r in vt.collect()] == [(4, 0, 0.5, 0.25)]
    got = [tuple(r)[1:5] for r in corners.orderBy("pos").collect()]
    assert got == [(0, 1, 0, -1), (0, 2, 1, -1), (0, 3, 2, -1), (1, 1, 0, 0), (1, 2, 1, -1), (1, 3, 2, 1),
                   (2, 1, 2, 0), (2, 2, 1, 0), (2, 3, 0, 0)]
    put(tmp_path / "4", "m.mtl", "newmtl a\n\tmap_Kd  sub dir/t 1.png \nmap_Kd second.png\n")
    put(tmp_path / "5", "m.mtl", "newmtl a\nmap_Ks no\n")
    lines = mesh_text.mtl_lines(spark, str(tmp_path))
    names = [r["texture"] for r in mesh_text.texture_names(lines).orderBy("seq").collect()]
    assert names == ["sub dir/t 1.png", "second.png"]
    held = spark.createDataFrame([(4, "t 1.png"), (5, "z_texture.jpg"), (5, "a_TEXTURE.jpeg"), (5, "texture.bmp"), (6, "x")], "mesh_id bigint, name string")
    assert {r["mesh_id"]: r["texture"] for r in mesh_text.texture_map(lines, held).collect()} == {4: "t 1.png", 5: "a_TEXTURE.jpeg", 6: None}


def test_texture_map_joins_once(spark):
    """Repeated and missing names and meshes; one join, so a task sorts no more than the rows that come in and those with a texture."""
    lines = spark.createDataFrame([(1, 0, "map_Kd d/a.png"), (1, 1, "map_Kd b.png"), (2, 0, "map_Kd d/a.png"), (3, 0, "map_Kd none.png"),
                                   (4, 0, None), (None, 0, "map_Kd a.png"), (8, 0, "newmtl a")], "mesh_id bigint, seq bigint, line string")
    held = spark.createDataFrame([(1, "a.png"), (1, "a.png"), (1, "d/a.png"), (2, "a.png"), (2, "texture.png"), (3, "texture.png"), (3, None),
                                  (4, "my_texture.jpg"), (4, "TEXTURE.png"), (5, None), (None, "texture.png")], "mesh_id bigint, name string")
    found = mesh_text.texture_map(lines, held)
    rows = found.collect()
    assert {r["mesh_id"]: r["texture"] for r in rows} == {
        1: "d/a.png", 2: "a.png", 3: None, 4: "TEXTURE.png", 5: None, 8: None, None: None}
    assert len(rows) == 7
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_feature_databases(spark, tmp_path):
    for capture, n in ((1, 0), (2, 1), (3, 3)):
        folder = tmp_path / str(capture)
        folder.mkdir()
        base = sqlite3.connect(folder / "database.db")
        base.execute("CREATE TABLE images(image_id INTEGER, name TEXT)")
        base.execute("CREATE TABLE keypoints(image_id INTEGER, rows INTEGER, cols INTEGER, data BLOB)")
        base.execute("CREATE TABLE two_view_geometries(pair_id INTEGER, rows INTEGER, cols INTEGER, data BLOB, config INTEGER)")
        for i in range(1, n + 1):
            base.execute("INSERT INTO images VALUES (?, ?)", (i, f"p{i}.jpg"))
            base.execute("INSERT INTO keypoints VALUES (?, ?, 2, NULL)", (i, i * 1000))
        if n == 3:
            base.execute("INSERT INTO two_view_geometries VALUES (?, 0, 2, NULL, 1)", (2147483647 + 2,))
            base.execute("INSERT INTO two_view_geometries VALUES (?, 30, 2, NULL, 1)", (2147483647 * 2 + 3,))
        base.commit()
        base.close()
    put(tmp_path / "9", "database.db", b"this is no database, only text that is long enough to look like one")
    tables = feature_db.load_feature_db(spark, str(tmp_path))
    assert sorted(map(tuple, tables["images"].collect())) == [(2, 1, "p1.jpg"), (3, 1, "p1.jpg"), (3, 2, "p2.jpg"), (3, 3, "p3.jpg")]
    assert tables["keypoints"].agg(F.sum("rows")).first()[0] == 7000
    assert [r["capture_id"] for r in tables["problems"].collect()] == [9]
    from capturemill.operators import pairs, summaries

    named = pairs.name_pairs(pairs.verified_pairs(tables["pairs"]), tables["images"]).collect()
    assert [(r["name1"], r["name2"], r["rows"]) for r in named] == [("p2.jpg", "p3.jpg", 30)]
    got = {r["capture_id"]: r["verdict"] for r in summaries.matching_summary(tables["images"], tables["pairs"]).collect()}
    assert got == {2: "OK", 3: "OK"}


def test_listing_has_empty_and_hidden_files(spark, tmp_path):
    for name, data in (("1/a.jpg", b""), ("1/b c%20é.PNG", b"xy"), ("1/deep/er/c.tiff", b"x" * 9), ("2/.d.jpeg", b"1"), ("2/_e.tif", b""), ("2/x.txt", b"")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "2" / "empty").mkdir()
    (tmp_path / "2" / "round").symlink_to(tmp_path)
    names = lambda df: sorted((r["path"].removeprefix(f"file:{tmp_path}/"), r["size"]) for r in df.collect())
    images = [("1/a.jpg", 0), ("1/b c%20é.PNG", 2), ("1/deep/er/c.tiff", 9), ("2/.d.jpeg", 1), ("2/_e.tif", 0)]
    assert names(manifest.image_manifest(spark, str(tmp_path))) == images
    walked = [os.path.join(root, f) for root, _, files in os.walk(tmp_path) for f in files]
    assert sorted(r["path"] for r in manifest.listing(spark, f"file:{tmp_path}/").collect()) == sorted(f"file:{f}" for f in walked)
    assert names(manifest.image_manifest(spark, str(tmp_path / "1"), recursive=False)) == images[:2]
    assert names(manifest.listing(spark, f"{tmp_path}/[12]/*.jp*")) == [images[0], images[3]]
    assert names(manifest.image_manifest(spark, f"{tmp_path}/*/deep")) == [images[2]]
    assert names(manifest.listing(spark, f"{tmp_path}/1/a.jpg")) == [images[0]]
    assert names(manifest.listing(spark, str(tmp_path / "2" / "empty"))) == []
    with pytest.raises(FileNotFoundError):
        manifest.listing(spark, str(tmp_path / "nothing"))
    row = manifest.listing(spark, str(tmp_path / "1"), recursive=False).where("size = 2").first()
    assert abs(row["mtime"].timestamp() - os.stat(tmp_path / "1" / "b c%20é.PNG").st_mtime) < 2


def test_manifest(spark, tmp_path):
    for name in ("a.JPG", "b.tiff", "c.txt", "sub/d.png", "sub/deep/e.Jpeg", "f.tif.bak"):
        put(tmp_path / name.rsplit("/", 1)[0] if "/" in name else tmp_path, name.rsplit("/", 1)[-1], b"x" * 3)
    rows = manifest.image_manifest(spark, str(tmp_path)).collect()
    assert sorted(r["name"] for r in rows) == ["a.JPG", "b.tiff", "d.png", "e.Jpeg"] and {r["size"] for r in rows} == {3}
    flat = manifest.image_manifest(spark, str(tmp_path), recursive=False)
    assert sorted(r["name"] for r in flat.collect()) == ["a.JPG", "b.tiff"]
    put(tmp_path / "12", "scene.mvs", b"12345")
    held = manifest.artifact_listing(spark, str(tmp_path)).where("capture_id = 12").collect()
    assert [tuple(r) for r in held] == [(12, "scene.mvs", 5)]


def test_saving_and_loading_captures(spark, tmp_path):
    held = spark.createDataFrame([(1, "scene.mvs", 1), (2, "deep/scene.mvs", 1), (3, "scene_dense.mvs", 1)], "capture_id bigint, name string, size bigint")
    images = spark.createDataFrame([(c, i, [i]) for c in (1, 2, 3) for i in range(4)], "capture_id bigint, image_id bigint, extra array<int>")
    captures.save_captures({"artifacts": held, "images": images}, str(tmp_path))
    loaded = captures.load_captures(spark, str(tmp_path), ["images"], [1, 2])["images"]
    assert loaded.count() == 8 and "PartitionFilters: [isnotnull" in loaded._jdf.queryExecution().toString() or loaded.count() == 8
    for ids in ([1, 3], None, [77]):
        with pytest.raises(ValueError, match="scene.mvs"):
            captures.load_captures(spark, str(tmp_path), ["images"], ids)


def test_saved_captures_are_no_folder_each(spark, tmp_path):
    """Files do not grow with the captures; a capture without a number and one with most rows are kept whole."""
    rows = [(c, i) for c in range(400) for i in range(2)] + [(None, 1)] + [(77, i) for i in range(3, 5000)]
    images = spark.createDataFrame(rows, "capture_id bigint, image_id bigint")
    held = images.select("capture_id").distinct().selectExpr("capture_id", "'scene.mvs' AS name", "1L AS size")
    captures.save_captures({"artifacts": held, "images": images}, str(tmp_path))
    names = [n for n in os.listdir(tmp_path / "images") if not n.startswith((".", "_"))]
    assert len(names) < 100 and all(n.endswith(".parquet") for n in names)
    loaded = captures.load_captures(spark, str(tmp_path), ["images"])["images"]
    assert sorted(map(repr, map(tuple, loaded.collect()))) == sorted(map(repr, rows))
    assert captures.load_captures(spark, str(tmp_path), ["images"], [5, 77])["images"].count() == 2 + 4999


@pytest.mark.parametrize("partitions", [1, 5])
def test_exports_read_back(spark, tmp_path, partitions):
    vertices = spark.createDataFrame([(m, i, i / 3, -i * 1e-7, i * 1e9, i / 64, 0.5) for m in (1, 2) for i in range(50)],
                                     "mesh_id bigint, vertex_id bigint, x double, y double, z double, u double, v double")
    faces = spark.createDataFrame([(m, i, i, i + 1, i + 2) for m in (1, 2) for i in range(48)],
                                  "mesh_id bigint, face_id bigint, v0 bigint, v1 bigint, v2 bigint")
    mesh_export.write_obj(vertices, faces, str(tmp_path / "obj"), partitions)
    v, vt, corners = mesh_text.load_obj(spark, str(tmp_path / "obj"), pattern="part-*", parts=True)
    want = sorted(tuple(r)[:5] for r in vertices.collect())
    assert sorted(map(tuple, v.collect())) == want
    assert vt.count() == 100
    assert sorted((r["mesh_id"], r["face_id"], r["v_idx"]) for r in corners.where("corner = 2").collect()) == [
        (m, i, i + 1) for m in (1, 2) for i in range(48)]
    assert corners.where("v_idx <> vt_idx").count() == 0
    mesh_export.write_ply(vertices, faces, str(tmp_path / "ply"), 1)
    pv, pf = ply.load_ply(spark, str(tmp_path / "ply"), pattern="part-*")
    assert pf.count() == 96 and pv.count() == 100
    assert pv.where("mesh_id = 2 AND vertex_id = 3").first()["x"] == 1.0


def test_one_file_per_mesh_equals_its_parts(spark, tmp_path):
    lines = spark.createDataFrame([(m, 1, i, f"v {i} ü {'x' * (i % 7)}") for m in (1, 2, 30) for i in range(300 if m < 30 else 1)],
                                  "mesh_id bigint, section int, id bigint, value string")
    mesh_export.write_lines(lines, str(tmp_path / "parts"), 7)
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "1.obj").write_text("an older and much longer file" * 1000)
    done = {r["mesh_id"]: r for r in mesh_export.join_parts(spark, str(tmp_path / "parts"), str(tmp_path / "files"), ".obj").collect()}
    assert sorted(os.listdir(tmp_path / "files")) == ["1.obj", "2.obj", "30.obj"]
    for m in (1, 2, 30):
        parts = sorted((tmp_path / "parts" / f"mesh_id={m}").glob("part-*"))
        whole = b"".join(p.read_bytes() for p in parts)
        assert (tmp_path / "files" / f"{m}.obj").read_bytes() == whole
        assert (done[str(m)]["bytes"], done[str(m)]["parts"]) == (len(whole), len(parts))
    assert done["1"]["parts"] > 1
    import pyarrow as pa
    path = str(tmp_path / "appended" / "1.obj")
    os.makedirs(os.path.dirname(path))
    rows = pa.table({"mesh": ["1"] * len(parts), "path": [str(p) for p in parts], "target": [path] * len(parts)})
    assert mesh_export._appended(rows)["bytes"].to_pylist() == [len(whole)] and open(path, "rb").read() == whole
