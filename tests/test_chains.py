"""Records of large files found by ranges, against hopping through the file."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from capturemill.sources import chains, ply, sparse_model


def point(ident, track):
    return struct.pack("<QdddBBBdQ", ident, ident * 0.5, 1.0, -2.0, 1, 2, 3, 0.25, len(track)) + b"".join(struct.pack("<II", *t) for t in track)


def image(ident, name, points):
    return struct.pack("<IdddddddI", ident, 1, 0, 0, 0, ident, 2, 3, 7) + name.encode() + b"\x00" + struct.pack("<Q", points) + b"\x01" * (24 * points)


def as_track(raw):
    raw += bytes(-len(raw) % 8)
    return list(struct.iter_unpack("<II", raw))


def write(folder, capture, name, count, records):
    path = folder / str(capture) / name
    path.parent.mkdir(parents=True)
    path.write_bytes(struct.pack("<Q", count) + b"".join(records))
    return path


def hops(path, step):
    reader, place, out = chains.Reader(str(path)), 8, []
    while place is not None and place < reader.size:
        out.append(place)
        place = step(reader, place)
    reader.close()
    return out


def cloud(draw, n):
    """Points with tracks of any length, some of which look like points themselves, one after the other."""
    records = []
    for i in range(n):
        kind = draw.random()
        if kind < 0.2:  # a chain of false records inside a track
            track = as_track(b"".join(point(10**6 + j, [(1, 0)] * draw.randrange(3)) for j in range(draw.randrange(1, 12))))
        elif kind < 0.3:
            track = [(0, 0)] * draw.randrange(60)
        else:
            track = [(draw.randrange(2**31), draw.randrange(2**31)) for _ in range(draw.randrange(0, 9))]
        records.append(point(i, track))
    return records


@pytest.mark.parametrize("split", [64, 700, 9_000])
def test_points_of_large_files_equal_the_hop(spark, tmp_path, split):
    draw = random.Random(split)
    for capture in range(3):
        write(tmp_path, capture, "points3D.bin", 300, cloud(draw, 300))
    whole = sparse_model.load_sparse_points(spark, str(tmp_path))
    cut = sparse_model.load_sparse_points(spark, str(tmp_path), split_bytes=split)
    columns = [c for c in whole.columns if c != "path"]
    assert sorted(map(repr, cut.select(*columns).collect())) == sorted(map(repr, whole.select(*columns).collect()))
    assert cut.count() == 900


def test_ranges_begin_where_the_hop_has_records(spark, tmp_path):
    path = write(tmp_path, 1, "points3D.bin", 400, cloud(random.Random(1), 400))
    ranges = sparse_model._ranges(spark, str(tmp_path), "points3D.bin", sparse_model._after_point, 2_000).orderBy("at").collect()
    places = hops(path, sparse_model._after_point)
    assert sum(r["records"] for r in ranges) == 400 and len(ranges) > 8
    assert [places[sum(r["records"] for r in ranges[:n])] for n in range(len(ranges))] == [r["at"] for r in ranges]


def test_chains_from_all_places_agree_with_hops(tmp_path):
    path = write(tmp_path, 1, "points3D.bin", 200, cloud(random.Random(2), 200))
    places = hops(path, sparse_model._after_point)
    reader = chains.Reader(str(path))
    end = reader.size // 2
    links = {e: (x, n) for e, x, n in chains.followed(reader, sparse_model._after_point, range(8, 3000), end)}
    exit_ = next(p for p in places if p >= end)
    for n, place in enumerate(places):
        if place < 3000:
            assert links[place] == (exit_, places.index(exit_) - n)
            assert chains.hopped(reader, sparse_model._after_point, place, end) == (place, *links[place])
    reader.close()


def test_a_range_is_read_once_and_no_task_reads_a_file(spark, tmp_path, monkeypatch):
    """Following chains reads a range and one block more at most."""
    monkeypatch.setattr(chains, "BLOCK", 4096)
    path = write(tmp_path, 1, "points3D.bin", 20_000, cloud(random.Random(3), 20_000))
    size = path.stat().st_size
    at, split = size // 3, 200_000
    reader = chains.Reader(str(path))
    assert chains.followed(reader, sparse_model._after_point, range(at, at + chains.WINDOW), at + split)
    assert reader.bytes_read <= 2 * split < size
    reader.close()


@pytest.mark.parametrize("damage", ["cut", "many", "few", "long track"])
def test_damaged_large_files(spark, tmp_path, damage):
    records = [point(i, [(i, 1)] * (i % 5)) for i in range(120)]
    count = {"many": 150, "few": 60}.get(damage, 120)
    if damage == "long track":  # the track claims more than the file has
        records[70] = struct.pack("<QdddBBBdQ", 70, 0, 0, 0, 1, 2, 3, 0, 10**9) + records[70][51:]
    path = write(tmp_path, 1, "points3D.bin", count, records)
    if damage == "cut":
        path.write_bytes(path.read_bytes()[:-700])
    whole = sparse_model.load_sparse_points(spark, str(tmp_path))
    cut = sparse_model.load_sparse_points(spark, str(tmp_path), split_bytes=500)
    columns = [c for c in whole.columns if c != "path"]
    assert sorted(map(repr, cut.select(*columns).collect())) == sorted(map(repr, whole.select(*columns).collect()))


def test_images_with_long_records(spark, tmp_path):
    draw = random.Random(4)
    for capture in range(2):
        write(tmp_path, capture, "images.bin", 60, [image(i, f"é{'n' * draw.randrange(300)}{i}.jpg", draw.choice([0, 3, 400])) for i in range(60)])
    whole = sparse_model.load_poses(spark, str(tmp_path))
    for split in (900, 20_000):
        cut = sparse_model.load_poses(spark, str(tmp_path), split_bytes=split)
        columns = [c for c in whole.columns if c != "path"]
        assert sorted(map(repr, cut.select(*columns).collect())) == sorted(map(repr, whole.select(*columns).collect()))
    assert whole.where(F.col("problem").isNull()).count() == 120


def ply_file(draw, n, faces):
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\n"
    head += "property list uchar uint view_indices\nproperty list ushort uchar tags\n"
    head += f"element face {faces}\nproperty list uchar int vertex_indices\nend_header\n"
    body = []
    for i in range(n):
        views, tags = draw.randrange(0, 6), draw.randrange(0, 40)
        body.append(struct.pack("<fff", i, -i, 0.5) + struct.pack(f"<B{views}I", views, *[draw.randrange(9) for _ in range(views)])
                    + struct.pack("<H", tags) + bytes(draw.randrange(256) for _ in range(tags)))
    return head.encode() + b"".join(body) + b"".join(struct.pack("<Biii", 3, i, i + 1, i + 2) for i in range(faces))


@pytest.mark.parametrize("cut", [0, 30])
def test_listed_ply_of_large_files(spark, tmp_path, monkeypatch, cut):
    draw = random.Random(6)
    for capture in (1, 2):
        data = ply_file(draw, 500, 40)
        (tmp_path / str(capture)).mkdir()
        (tmp_path / str(capture) / "m.ply").write_bytes(data[:len(data) - cut - 40 * 13] if cut and capture == 2 else data)
    whole = [[tuple(r) for r in t.drop("path", "problem").collect()] for t in ply.load_ply(spark, str(tmp_path))]
    monkeypatch.setattr(ply, "RANGE_BYTES", 3_000)
    tables = ply.load_ply(spark, str(tmp_path))
    assert [sorted(map(repr, (tuple(r) for r in t.drop("path", "problem").collect()))) for t in tables] == [sorted(map(repr, w)) for w in whole]
    assert tables[0].where("problem IS NOT NULL").count() == bool(cut)
    assert len(whole[0]) == (501 if cut else 1000)
    # headers are read once, at the start; neither table lists the files or opens a header again
    assert all("binaryFile" not in t._jdf.queryExecution().toString() for t in tables)
