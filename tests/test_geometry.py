"""Tracks, matching, clouds, meshes and components against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from capturemill.operators import graph, matching, mesh, pairs, points, tracks


def skewed_observations(spark, seed=1):
    """Small tracks, and two points seen by every image of a capture."""
    rng = random.Random(seed)
    rows = [(1, p, i) for p in range(60) for i in rng.sample(range(90), 3)]
    rows += [(1, p, i) for p in (1000, 1001) for i in range(90)] + [(2, 1000, i) for i in range(5)]
    rows += rows[:20]
    return rows, spark.createDataFrame(rows, "capture_id bigint, point3d_id bigint, image_id bigint").repartition(4)


def test_covisibility_with_hot_points(spark):
    rows, df = skewed_observations(spark)
    want = {}
    by_point = {}
    for c, p, i in set(rows):
        by_point.setdefault((c, p), []).append(i)
    for (c, _), seen in by_point.items():
        for a, b in itertools.combinations(sorted(seen), 2):
            want[c, a, b] = want.get((c, a, b), 0) + 1
    for chunk in (10**6, 16, 3, 1):
        got = {tuple(r)[:3]: r["shared"] for r in tracks.covisibility(df, chunk).collect()}
        assert got == want


def brute_views(rows, k):
    by_image = {}
    for c, p, i in set(rows):
        by_image.setdefault((c, i), set()).add(p)
    want = set()
    for (c, i), mine in by_image.items():
        near = sorted((-len(mine & other), j) for (d, j), other in by_image.items() if d == c and j != i and mine & other)
        want |= {(c, i, j, -n, rank) for rank, (n, j) in enumerate(near[:k(c)], 1)}
    return want


@pytest.mark.parametrize("degree", [2, 4, 10_000])
def test_best_views_equal_the_full_join(spark, degree):
    rows, df = skewed_observations(spark)
    found = tracks.best_views(df, 3, degree, growth=4, chunk=16)
    assert {(r["capture_id"], r["image_id"], r["neighbor_id"], r["shared"], r["rank"]) for r in found.collect()} == brute_views(rows, lambda c: 3)
    views = spark.createDataFrame([(1, 2), (2, 4), (3, 1)], "capture_id bigint, number_views bigint")
    found = tracks.best_views(df, views, degree, growth=4, chunk=16)
    assert {(r["capture_id"], r["image_id"], r["neighbor_id"], r["shared"], r["rank"]) for r in found.collect()} == brute_views(
        rows, {1: 2, 2: 4}.get)


def test_best_views_do_not_write_the_pairs_of_hot_points(spark, monkeypatch):
    """A walk of 400 images: neighbours share twelve points, and all see three points of the horizon."""
    rows = [(1, i * 12 + n, j) for i in range(399) for n in range(12) for j in (i, i + 1)]
    rows += [(1, 100_000 + n, i) for n in range(3) for i in range(400)]
    df = spark.createDataFrame(rows, "capture_id bigint, point3d_id bigint, image_id bigint")
    written, keep = [], tracks.checkpointed

    def counted(table):
        kept = keep(table)
        if {"image_id1", "image_id2"} <= set(kept.columns) or "neighbor_id" in kept.columns:
            written.append(kept.count())
        return kept

    monkeypatch.setattr(tracks, "checkpointed", counted)
    found = tracks.best_views(df, 2, degree=16, growth=8, chunk=64)
    assert {(r["capture_id"], r["image_id"], r["neighbor_id"], r["shared"], r["rank"]) for r in found.collect()} == brute_views(rows, lambda c: 2)
    # 398 inner images are settled at once; the two ends have one neighbour only and go on with all points
    assert sum(written) < 5_000 < 400 * 399 // 2


def test_best_views_run_no_round_that_settles_nothing(spark, monkeypatch):
    """Each image has more hot points than cheap ones, so the cheap ones alone settle none."""
    rng = random.Random(4)
    rows = [(1, p, i) for p in range(200) for i in rng.sample(range(30), 2 if p % 4 == 0 else 5)]
    df = spark.createDataFrame([*rows, (1, None, 3), (1, None, 4)], "capture_id bigint, point3d_id bigint, image_id bigint")
    rounds, write = [], tracks._shared

    def counted(seen, *rest):
        rounds.append(seen)
        return write(seen, *rest)

    monkeypatch.setattr(tracks, "_shared", counted)
    found = tracks.best_views(df, 3, degree=2, growth=4)
    assert {(r["capture_id"], r["image_id"], r["neighbor_id"], r["shared"], r["rank"]) for r in found.collect()} == brute_views(rows, lambda c: 3)
    assert len(rounds) == 1


def test_best_views_read_the_table_of_views_once(spark):
    """The table (capture_id, number_views) may be as dear as the densify rule that makes it."""
    rows, df = skewed_observations(spark)
    asked = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def views(capture):
        asked.add(1)
        return capture + 1

    k = spark.range(1, 3).select(F.col("id").alias("capture_id"), views.asNondeterministic()("id").alias("number_views"))
    found = tracks.best_views(df, k, 10_000)
    assert {(r["capture_id"], r["image_id"], r["neighbor_id"], r["shared"], r["rank"]) for r in found.collect()} == brute_views(rows, lambda c: c + 1)
    assert asked.value == 2


def test_best_views_of_an_empty_table(spark):
    assert tracks.best_views(spark.createDataFrame([], "capture_id bigint, point3d_id bigint, image_id bigint"), 3).count() == 0


def test_min_views_by_track(spark):
    track = lambda *ids: [{"image_id": i, "point2d_idx": 0} for i in ids]
    df = spark.createDataFrame([(1, 1, track(1, 1, 2)), (1, 2, track(1, 2, 3)), (1, 3, [])],
                               "capture_id bigint, point3d_id bigint, track array<struct<image_id:bigint,point2d_idx:bigint>>")
    assert [r["point3d_id"] for r in tracks.min_views(df, 3).collect()] == [2]
    assert sorted(r["point3d_id"] for r in tracks.min_views(df, 2).collect()) == [1, 2]
    assert tracks.explode_tracks(df).count() == 6


def test_exhaustive_plan_states_every_pair(spark):
    images = spark.createDataFrame([(c, i * 3) for c, n in ((1, 1), (2, 7), (3, 120)) for i in range(n)], "capture_id bigint, image_id bigint")
    rows = pairs.exhaustive_pairs(images).collect()
    for c, n in ((1, 1), (2, 7), (3, 120)):
        mine = [r for r in rows if r["capture_id"] == c]
        assert sum(r["partners"] for r in mine) == n * (n - 1) // 2
        stated = {(r["position"], j) for r in mine if r["first_partner"] for j in range(r["first_partner"], r["last_partner"] + 1)}
        assert stated == set(itertools.combinations(range(1, n + 1), 2))
    named = images.withColumn("name", F.when(F.col("image_id") > 0, F.concat(F.lit("n"), "image_id")))
    blocks = pairs.pair_blocks(named).orderBy("capture_id", "block").collect()
    assert [(b["block"], b["last_block"], b["images"]) for b in blocks if b["capture_id"] == 3] == [(1, 3, 50), (2, 3, 50), (3, 3, 20)]
    assert sum(b["image_pairs"] for b in blocks if b["capture_id"] == 3) == 120 * 119 // 2
    assert blocks[-3]["first_name"] == "Image 1" and blocks[-1]["last_name"] == "n357"


def brute_matches(desc, wanted, ratio, max_distance):
    out = set()
    for c, a, b in wanted:
        left = {f: d for (cc, i, f), d in desc.items() if (cc, i) == (c, a)}
        right = {f: d for (cc, i, f), d in desc.items() if (cc, i) == (c, b)}
        for f, d in left.items():
            near = sorted((float(np.sqrt(((d - e) ** 2).sum())), g) for g, e in right.items())
            if len(near) > 1 and near[0][0] < ratio * near[1][0] and (max_distance is None or near[0][0] <= max_distance):
                out.add((c, a, b, f, near[0][1]))
    return out


@pytest.mark.parametrize("chunk", [3, 1024])
def test_matching_equals_brute_force_in_any_chunking(spark, chunk):
    rng = np.random.default_rng(2)
    desc = {}
    sizes = {(1, 1): 40, (1, 2): 25, (1, 3): 1, (2, 1): 4, (2, 2): 6}
    for (c, i), n in sizes.items():
        for k in range(n):
            desc[c, i, 100 * i + k] = rng.normal(size=8).astype(np.float32).astype(np.float64)
    for k in range(10):
        desc[1, 2, 200 + k] = desc[1, 1, 100 + k] + 0.01 * k
    desc[1, 2, 224] = desc[1, 2, 223]
    desc = {k: v.astype(np.float32).astype(np.float64) for k, v in desc.items()}
    df = spark.createDataFrame([(*k, v.tolist()) for k, v in desc.items()],
                               "capture_id bigint, image_id bigint, feature_id bigint, descriptor array<double>")
    wanted = [(1, 1, 2), (1, 1, 3), (1, 2, 3), (2, 1, 2)]
    pair = spark.createDataFrame(wanted, "capture_id bigint, image_id1 bigint, image_id2 bigint")
    for ratio, far in ((0.8, None), (0.95, 1.5)):
        found = matching.match_descriptors(df, pair, ratio, far, chunk=chunk)
        got = {tuple(r)[:5] for r in found.collect()}
        assert got == brute_matches(desc, wanted, ratio, far)
    few = matching.match_descriptors(df, pair, 0.8, max_matches=2, chunk=chunk).where("image_id1 = 1 AND image_id2 = 2")
    assert sorted(r["feature1"] for r in few.collect()) == [100, 101]
    counts = {r["pair_id"] % 2147483647: r["rows"] for r in matching.match_counts(
        matching.match_descriptors(df, pair, chunk=chunk), pair).where("capture_id = 1").collect()}
    assert counts[3] == 0


def test_relaxed_retry_only_for_empty_captures(spark):
    def unit(angle):
        return [float(np.cos(angle)), float(np.sin(angle))]

    rows = [(1, 1, 1, unit(0)), (1, 2, 2, unit(0.01)), (1, 2, 3, unit(2.0)),
            (2, 1, 1, unit(0)), (2, 2, 2, unit(0.50)), (2, 2, 3, unit(0.56)),
            (3, 1, 1, unit(0))]
    df = spark.createDataFrame(rows, "capture_id bigint, image_id bigint, feature_id bigint, descriptor array<double>")
    pair = spark.createDataFrame([(1, 1, 2), (2, 1, 2)], "capture_id bigint, image_id1 bigint, image_id2 bigint")
    got = sorted((r["capture_id"], r["feature2"], r["relaxed"]) for r in matching.match_with_relaxed_retry(df, pair).collect())
    assert got == [(1, 2, False), (2, 2, True)]


def test_percentiles_are_exact_with_outliers_and_ties(spark):
    rng = np.random.default_rng(4)
    clouds = {1: rng.normal(size=30_000), 2: np.concatenate([np.zeros(5000), [1e12, -1e12]]), 3: np.array([5.0]),
              4: np.round(rng.normal(size=20_000), 1)}
    rows = [(c, float(v), float(-v), float(v * v)) for c, vs in clouds.items() for v in vs]
    df = spark.createDataFrame(rows, "capture_id bigint, x double, y double, z double").repartition(6)
    qs = (0.0, 0.01, 0.37, 0.99, 1.0)
    got = {(r["capture_id"], r["axis"], r["q"]): r["value"] for r in points.exact_percentiles(df, qs).collect()}
    for c, vs in clouds.items():
        for axis, values in (("x", vs), ("y", -vs), ("z", vs * vs)):
            for q in qs:
                assert got[c, axis, q] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-12)


def test_roi_border(spark):
    df = spark.range(101).selectExpr("1L AS capture_id", "CAST(id AS DOUBLE) AS x", "0D AS y", "1D AS z")
    box = points.roi_boxes(df, scale=1.0).first()
    assert (box["roi_min_x"], box["roi_max_x"]) == (1.0, 99.0)
    assert points.roi_boxes(df, scale=1.0, border=100).first()["roi_max_x"] == 148.0
    assert points.roi_boxes(df, scale=1.0, border=-3).first()["roi_min_x"] == -2.0
    assert points.crop_to_roi(df, scale=1.0).count() == 99
    report = points.roi_report(df, scale=1.0, approximate=True).first()
    assert report["kept"] + report["removed"] == 101


def test_normalising_flat_cloud(spark):
    df = spark.createDataFrame([(1, 2.0, 2.0, 2.0)], "capture_id bigint, x double, y double, z double")
    assert tuple(points.normalize_coordinates(df, 2).first()) == (1, 0.0, 0.0, 0.0)
    assert points.normalize_coordinates(df, 0).first() == df.first()
    assert points.bounds(df).first()["distance"] == 0.1


def test_split_keeps_every_point_and_limit(spark):
    rng = np.random.default_rng(9)
    xy = np.concatenate([rng.normal(size=(3000, 2)), np.tile([[0.25, 0.25]], (400, 1))])
    df = spark.createDataFrame([(1, i, float(x), float(y), 0.0) for i, (x, y) in enumerate(xy)],
                               "capture_id bigint, point3d_id bigint, x double, y double, z double")
    split = points.split_subscenes(df, 100)
    assert split.select("point3d_id").distinct().count() == len(xy) == split.count()
    sizes = points.subscene_sizes(df, 100).collect()
    assert all(r["points"] <= 100 or r["undivided"] for r in sizes)
    assert [r["points"] for r in sizes if r["undivided"]] == [400]


def test_split_equals_brute_force_over_several_passes(spark):
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.random((500, 2)), 0.7 + 1e-5 * rng.random((700, 2)), np.tile([[0.1, 0.9]], (30, 1))])
    df = spark.createDataFrame([(c, i, float(x), float(y)) for c in (1, 2) for i, (x, y) in enumerate(xy)],
                               "capture_id bigint, point3d_id bigint, x double, y double")
    low, high = xy.min(axis=0), xy.max(axis=0)
    grid = np.minimum(((xy - low) / (high - low) * 2.0 ** 52).astype(np.int64), 2 ** 52 - 1)
    want = {}
    for level in range(53):
        cells = [tuple(g) for g in (grid >> (52 - level)).tolist()]
        sizes = {}
        for c in cells:
            sizes[c] = sizes.get(c, 0) + 1
        for i, c in enumerate(cells):
            if i not in want and (sizes[c] <= 20 or level == 52):
                want[i] = (level, *c, sizes[c] > 20)
    got = points.split_subscenes(df, 20).collect()
    assert len(got) == 2 * len(xy)
    assert all((r["level"], r["cell_x"], r["cell_y"], r["undivided"]) == want[r["point3d_id"]] for r in got)


@pytest.mark.parametrize("rows", [0, 40, 200_000])
def test_split_is_the_same_by_broadcast_and_by_shuffle(spark, monkeypatch, rows):
    """The passes have few cells or more than a broadcast may hold; points without a coordinate are kept."""
    rng = np.random.default_rng(6)
    xy = np.concatenate([rng.random((300, 2)), 0.7 + 1e-5 * rng.random((300, 2)), 0.2 + 1e-9 * rng.random((90, 2))])
    df = spark.createDataFrame([*((1, i, float(x), float(y)) for i, (x, y) in enumerate(xy)), (1, 9_001, None, 0.5), (1, 9_002, 0.5, None)],
                               "capture_id bigint, point3d_id bigint, x double, y double")
    want = points.split_subscenes(df, 20).collect()
    monkeypatch.setattr(points, "SMALL_TABLE_ROWS", rows)
    got = points.split_subscenes(df, 20).collect()
    assert sorted(got) == sorted(want) and len(got) == len(xy) + 2
    by_cell = {}
    for r in want:
        by_cell[tuple(r)[4:]] = by_cell.get(tuple(r)[4:], 0) + 1
    assert {tuple(r)[1:5]: r["points"] for r in points.subscene_sizes(df, 20).collect()} == by_cell


@pytest.mark.parametrize("split", ["split_subscenes", "subscene_sizes"])
def test_split_reads_its_points_once(spark, split):
    """The points may be as dear as the joins that make them."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def place(i):
        asked.add(1)
        return float(i * 7 % 1000)

    df = spark.range(1000).select(F.lit(1).cast("long").alias("capture_id"), F.col("id").alias("point3d_id"),
                                  place.asNondeterministic()("id").alias("x"), (F.col("id") % 10).cast("double").alias("y"))
    assert len(getattr(points, split)(df, 50).collect()) > 1
    assert asked.value == 1000


def test_split_goes_on_in_a_crowded_corner(spark):
    """99 % of the points lie in a square a hundred-millionth as wide as the capture."""
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.random((60, 2)), 0.3 + 1e-8 * rng.random((5940, 2))])
    df = spark.createDataFrame([(1, i, float(x), float(y), 0.0) for i, (x, y) in enumerate(xy)],
                               "capture_id bigint, point3d_id bigint, x double, y double, z double")
    sizes = points.subscene_sizes(df, 50).collect()
    assert sum(r["points"] for r in sizes) == 6000
    assert all(r["points"] <= 50 and not r["undivided"] for r in sizes) and max(r["level"] for r in sizes) > 26


def union_find(edges):
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {a: find(a) for a in list(root)}


def test_components(spark):
    rng = random.Random(8)
    edges = {1: [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1800)],
             2: [(i, i + 1) for i in range(500)] + [(9000, 9000)], 3: [(0, i) for i in range(1, 800)]}
    rows = [(g, *e) for g, es in edges.items() for e in es]
    df = spark.createDataFrame(rows, "capture_id bigint, u bigint, v bigint").repartition(9)
    got = {(r["capture_id"], r["node"]): r["component"] for r in graph.connected_components(df).collect()}
    want = {(g, n): c for g, es in edges.items() for n, c in union_find(es).items()}
    assert got == want


def plain_components(rows):
    """Smallest node of each component, by a union-find over (group, u, v)."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for g, u, v in rows:
        a, b = sorted((find((g, u)), find((g, v))))
        root[b] = a
    return {x: find(x)[1] for x in list(root)}


@pytest.mark.parametrize("shape", ["low hub", "high hub", "two hubs", "path", "comb"])
def test_components_of_hubs_and_paths(spark, shape, monkeypatch):
    """Stars about their smallest and their largest node, a path in random order, stars on a path; small shares, so all hubs are dealt."""
    draw, n = random.Random(7), 3000
    ids = draw.sample(range(10**9), n)
    rows = {
        "low hub": [(1, -5, i) for i in ids], "high hub": [(1, i, 2 * 10**9) for i in ids],
        "two hubs": [(1, 0 if i % 2 else 2 * 10**9, i) for i in ids] + [(1, ids[0], ids[1]), (2, 0, ids[3])],
        "path": [(1, a, b) for a, b in zip(ids, ids[1:], strict=False)],
        "comb": [(1, ids[i // 100 * 100], ids[i]) for i in range(n)] + [(1, ids[i], ids[i + 100]) for i in range(0, n - 100, 100)],
    }[shape]
    draw.shuffle(rows)
    # one edge per task at first, so that nothing is contracted beforehand
    monkeypatch.setattr(graph, "CONTRACT_EDGES", 1)
    monkeypatch.setattr(graph, "LEAST_HUB", 20)
    df = spark.createDataFrame(rows, "capture_id long, u long, v long").repartition(8)
    got = {(r["capture_id"], r["node"]): r["component"] for r in graph.connected_components(df).collect()}
    assert got == plain_components(rows)


def test_no_task_reads_a_hub_as_a_whole(spark):
    rows = [(1, 10**6, i) for i in range(8000)] + [(1, 2 * 10**6 + i, -1) for i in range(8000)]
    links = spark.createDataFrame(rows, "g long, high long, low long")
    lots = graph._lots(links, "g", 2000)
    assert {end: [tuple(r) for r in table.collect()] for end, table in lots.items()} == {"high": [(1, 10**6, 4)], "low": [(1, -1, 4)]}
    ends = links.select("g", F.col("low").alias("node"), F.col("high").alias("other"))
    least = ends.groupBy("g", "node").agg(F.min("other").alias("m"))
    plan = graph._with_least(ends, least, "g", lots["low"])
    assert plan.count() == len(rows)
    dealt = ends.join(lots["low"], ["g", "node"], "left").withColumn("lot", F.pmod(F.xxhash64("other"), F.coalesce("lots", F.lit(1))))
    assert dealt.groupBy("g", "node", "lot").count().agg(F.max("count")).first()[0] < 2 * 2000


@pytest.mark.parametrize("most", [40, 1000])
def test_components_of_near_numbers_need_no_rounds(spark, monkeypatch, most):
    """A grid in random order is contracted by ranges; the few nodes that ranges share are left, and go to one task."""
    wide, high = 20, 100
    rows = [(g, n, n + step) for g in (1, 2) for n in range(wide * high) for step in (1, wide)
            if n // wide + step // wide < high and n % wide + step % wide < wide and (g == 1 or n // wide != 50)]
    random.Random(4).shuffle(rows)
    rounds = []
    whole = graph._round
    monkeypatch.setattr(graph, "CONTRACT_EDGES", most)
    monkeypatch.setattr(graph, "_round", lambda *args: rounds.append(args[2]) or whole(*args))
    df = spark.createDataFrame(rows, "capture_id long, u long, v long").repartition(8)
    got = {(r["capture_id"], r["node"]): r["component"] for r in graph.connected_components(df).collect()}
    assert got == plain_components(rows)
    assert all(count < len(rows) // 8 for count in rounds) and (most == 40 or not rounds)


def test_components_of_nothing(spark):
    empty = spark.createDataFrame([], "capture_id bigint, u bigint, v bigint")
    assert graph.connected_components(empty).count() == 0


# A square of two triangles, a far-away triangle, and a face without area.
V = [(7, 0, 0.0, 0.0, 0.0), (7, 1, 1.0, 0.0, 0.0), (7, 2, 1.0, 1.0, 0.0), (7, 3, 0.0, 1.0, 0.0),
     (7, 4, 9.0, 0.0, 0.0), (7, 5, 9.0, 2.0, 0.0), (7, 6, 10.0, 0.0, 0.0), (7, 7, 5.0, 5.0, 5.0)]
T = [(7, 0, 0, 1, 2), (7, 1, 0, 2, 3), (7, 2, 4, 6, 5)]


@pytest.fixture
def square(spark):
    vertices = spark.createDataFrame(V, "mesh_id bigint, vertex_id bigint, x double, y double, z double")
    return vertices, spark.createDataFrame(T, "mesh_id bigint, face_id bigint, v0 bigint, v1 bigint, v2 bigint")


def test_mesh_measures(spark, square):
    vertices, faces = square
    areas = {r["face_id"]: (r["area"], r["nz"]) for r in mesh.face_geometry(faces, vertices).collect()}
    assert areas == {0: (0.5, 1.0), 1: (0.5, 1.0), 2: (1.0, 1.0)}
    flat = spark.createDataFrame([(7, 9, 0, 0, 1)], faces.schema)
    row = mesh.face_geometry(flat, vertices).first()
    assert (row["area"], row["nx"]) == (0.0, None)
    assert mesh.boundary_edges(faces).count() == 7
    holes = mesh.hole_count(faces).first()
    assert (holes["edges"], holes["boundary_edges"], holes["loops"], holes["non_manifold_edges"]) == (8, 7, 2, 0)
    normals = {r["vertex_id"]: r["nz"] for r in mesh.estimate_normals(vertices, faces).collect()}
    assert normals == {**{i: 1.0 for i in range(7)}, 7: None}


def test_spurious_faces(spark, square):
    vertices, faces = square
    assert sorted(r["face_id"] for r in mesh.remove_spurious(faces, vertices, 20, 2).collect()) == [0, 1]
    assert sorted(r["face_id"] for r in mesh.remove_spurious(faces, vertices, 1.4, 1).collect()) == [0, 1]
    report = mesh.spurious_report(faces, vertices, 1.4, 3).first()
    assert (report["kept"], report["long_edge_removed"], report["small_component_removed"]) == (0, 1, 2)
    lost = spark.createDataFrame([(7, 9, 0, 1, 99)], faces.schema)
    assert mesh.spurious_report(faces.union(lost), vertices, 20, 1).first()["long_edge_removed"] == 1


def test_smoothing_many_rounds(spark, square):
    vertices, faces = square
    near = {}
    for _, _, *f in T:
        for a, b in itertools.permutations(f, 2):
            near.setdefault(a, set()).add(b)
    at = {i: np.array(p) for _, i, *p in V}
    for _ in range(5):
        at = {i: (np.mean([at[j] for j in sorted(near[i])], axis=0) if i in near else p) for i, p in at.items()}
    for r in mesh.smooth_mesh(vertices, faces, 5).collect():
        assert np.allclose([r["x"], r["y"], r["z"]], at[r["vertex_id"]])


def test_sampling(spark, square):
    vertices, faces = square
    counts = {r["face_id"]: r["samples"] for r in mesh.sample_counts(faces, vertices, n=1001).collect()}
    assert sum(counts.values()) == 1001 and abs(counts[2] - 500) <= 1
    drawn = mesh.sample_mesh(faces, vertices, density=12_000.0, seed=3)
    a, b = (sorted(map(tuple, drawn.repartition(n).collect())) for n in (1, 6))
    assert a == b and len(a) == 24_000
    square_points = np.array([r[3:] for r in a if r[1] < 2])
    assert (square_points >= 0).all() and (square_points <= 1).all()
    assert np.allclose(square_points.mean(axis=0), [0.5, 0.5, 0.0], atol=0.02)
    other = mesh.sample_mesh(faces, vertices, density=12_000.0, seed=4)
    assert sorted(map(tuple, other.collect())) != a


def test_unpack_obj(spark):
    v = spark.createDataFrame([(1, i, float(i), 0.0, 0.0) for i in range(3)], "mesh_id bigint, v_idx bigint, x double, y double, z double")
    vt = spark.createDataFrame([(1, 0, 0.5, 0.25)], "mesh_id bigint, vt_idx bigint, u double, v double")
    corners = [(1, 0, 1, 2, 0, 1), (1, 0, 2, 1, -1, 2), (1, 0, 3, 0, 7, 3), (1, 1, 1, 2, 0, 5), (1, 1, 2, 2, -1, 6), (1, 1, 3, 1, -1, 7)]
    df = spark.createDataFrame(corners, "mesh_id bigint, face_id bigint, corner int, v_idx bigint, vt_idx bigint, pos bigint")
    vertices, faces = mesh.unpack_obj(df, v, vt)
    got = [(r["x"], r["u"], r["v"]) for r in vertices.orderBy("vertex_id").collect()]
    assert got == [(2.0, 0.5, 0.75), (1.0, 0.0, 1.0), (0.0, 0.0, 1.0), (2.0, 0.0, 1.0)]
    assert [tuple(r)[1:] for r in faces.orderBy("face_id").collect()] == [(0, 0, 1, 2), (1, 0, 3, 1)]
    assert mesh.unresolved_corners(df, v.where("v_idx < 2")).count() == 3


def joins_of(spark, build):
    """Text of a plan whose joins are broadcast only where the library says so."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return build()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def few_captures(spark):
    return spark.range(400).selectExpr("id % 2 AS capture_id", "id AS point3d_id", "id * 1.5D AS x", "id % 20 * 1D AS y", "1D AS z")


def test_restoring_shuffles_no_points(spark):
    cloud = few_captures(spark)
    plan = joins_of(spark, lambda: points.restore_coordinates(points.normalize_coordinates(cloud, 2), points.normalization(cloud, 2)))
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
