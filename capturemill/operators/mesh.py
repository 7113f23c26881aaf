"""Triangle meshes: corners, geometry, boundaries, cleaning, smoothing, sampling, normals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturemill.functions.columns import flip_v, long_div
from capturemill.operators.graph import connected_components
from capturemill.operators.numbering import dense_first_seen_index, running_folds
from capturemill.session import checkpointed, small_side

AXES = ("x", "y", "z")
MESH = ["mesh_id"]


# --- indexed corners ---------------------------------------------------------------------------

def resolve_corners(corners: DataFrame, obj_vt: DataFrame) -> DataFrame:
    """Texture coordinates of face corners; a missing or unknown one is (0, 0), then v is flipped."""
    found = corners.join(obj_vt.select(*MESH, "vt_idx", "u", "v"), [*MESH, "vt_idx"], "left")
    u, v = F.coalesce("u", F.lit(0.0)), F.coalesce("v", F.lit(0.0))
    return found.select(*corners.columns, u.alias("u"), flip_v(v).alias("v"))


def unresolved_corners(corners: DataFrame, obj_v: DataFrame) -> DataFrame:
    """Corners whose vertex does not exist; a single-file reader would stop there."""
    return corners.join(obj_v.select(*MESH, "v_idx"), [*MESH, "v_idx"], "left_anti").select(*corners.columns)


def unpack_obj(corners: DataFrame, obj_v: DataFrame, obj_vt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One vertex per distinct (v, vt) pair, numbered by first use, and faces over those numbers.

    ``corners`` is (mesh_id, face_id, corner 1..3, v_idx, vt_idx, pos).
    """
    index = dense_first_seen_index(corners, MESH, ["v_idx", "vt_idx"], "pos", "vertex_id")
    placed = index.join(obj_v, [*MESH, "v_idx"])
    vertices = resolve_corners(placed, obj_vt).select(
        *MESH, "vertex_id", *[F.col(a).cast("float").alias(a) for a in AXES],
        F.col("u").cast("float").alias("u"), F.col("v").cast("float").alias("v"),
    )
    numbered_corners = corners.join(index.drop("first_seen"), [*MESH, "v_idx", "vt_idx"])
    faces = numbered_corners.groupBy(*MESH, "face_id").agg(*[
        F.max(F.when(F.col("corner") == n + 1, F.col("vertex_id"))).alias(f"v{n}") for n in range(3)
    ])
    return vertices, faces


# --- geometry ----------------------------------------------------------------------------------

def _cross(a: str, b: str, c: str):
    """Cross product of (b - a) and (c - a)."""
    p = [F.col(f"{b}{x}") - F.col(f"{a}{x}") for x in AXES]
    q = [F.col(f"{c}{x}") - F.col(f"{a}{x}") for x in AXES]
    return [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]


def _length(parts):
    return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])


def with_corner_positions(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with the positions of their three corners (p0x .. p2z), by one join over corners."""
    corners = faces.select(*MESH, "face_id", F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "vertex_id"))
    positions = vertices.select(*MESH, "vertex_id", *[F.col(a).cast("double").alias(a) for a in AXES])
    placed = corners.join(positions, [*MESH, "vertex_id"], "left")
    return placed.groupBy(*MESH, "face_id").agg(
        *[F.max(F.when(F.col("corner") == n, F.col("vertex_id"))).alias(f"v{n}") for n in range(3)],
        *[F.max(F.when(F.col("corner") == n, F.col(a))).alias(f"p{n}{a}") for n in range(3) for a in AXES],
    )


def face_geometry(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edge lengths, area and unit normal of each face (normal null when degenerate)."""
    placed = with_corner_positions(faces, vertices)

    def edge(m: int, n: int):
        return _length([F.col(f"p{n}{a}") - F.col(f"p{m}{a}") for a in AXES])

    cross = _cross("p0", "p1", "p2")
    measured = placed.withColumns({f"c{a}": c for a, c in zip(AXES, cross)}).withColumn(
        "twice", _length([F.col(f"c{a}") for a in AXES])
    )
    return measured.select(
        *MESH, "face_id", "v0", "v1", "v2",
        edge(0, 1).alias("edge01"), edge(1, 2).alias("edge12"), edge(2, 0).alias("edge20"),
        (F.col("twice") / 2.0).alias("area"),
        *[F.when(F.col("twice") > 0, F.col(f"c{a}") / F.col("twice")).alias(f"n{a}") for a in AXES],
    )


def _undirected_edges(faces: DataFrame) -> DataFrame:
    """The three edges of each face as (u < v), one row per face and edge."""
    def edge(a: str, b: str):
        return F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))

    return faces.select(*MESH, F.explode(F.array(edge("v0", "v1"), edge("v1", "v2"), edge("v2", "v0"))).alias("e")).select(
        *MESH, "e.u", "e.v"
    )


def edge_uses(faces: DataFrame) -> DataFrame:
    """How many faces use each undirected edge."""
    return _undirected_edges(faces).groupBy(*MESH, "u", "v").agg(F.count(F.lit(1)).alias("uses"))


def boundary_edges(faces: DataFrame) -> DataFrame:
    """Edges used by exactly one face."""
    return edge_uses(faces).where(F.col("uses") == 1).select(*MESH, "u", "v")


def hole_count(faces: DataFrame) -> DataFrame:
    """Boundary loops (components of the boundary edges) and edge counts of each mesh."""
    uses = checkpointed(edge_uses(faces))
    totals = uses.groupBy(*MESH).agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_if(F.col("uses") == 1).alias("boundary_edges"),
        F.count_if(F.col("uses") > 2).alias("non_manifold_edges"),
    )
    loops = connected_components(uses.where(F.col("uses") == 1), "mesh_id").where(
        F.col("node") == F.col("component")
    ).groupBy(*MESH).agg(F.count(F.lit(1)).alias("loops"))
    return totals.join(loops, MESH, "left").fillna(0, ["loops"])


# --- cleaning ----------------------------------------------------------------------------------

def _without_long_edges(faces: DataFrame, vertices: DataFrame, factor: float) -> DataFrame:
    """Faces with a flag for an edge longer than ``factor`` times the mean face edge of the mesh."""
    geometry = face_geometry(faces, vertices)
    around = F.col("edge01") + F.col("edge12") + F.col("edge20")
    mean = small_side(geometry.groupBy(*MESH).agg((F.sum(around) / (F.count(around) * 3)).alias("mean_edge")))
    longest = F.greatest("edge01", "edge12", "edge20")
    return geometry.join(mean, MESH).select(
        *MESH, "face_id", "v0", "v1", "v2",
        (around.isNull() | (longest > F.col("mean_edge") * factor)).alias("long_edge"),
    )


def face_components(faces: DataFrame) -> DataFrame:
    """Faces with the component of the surface they belong to (faces sharing a vertex)."""
    edges = faces.select(*MESH, F.col("v0").alias("u"), F.col("v1").alias("v")).unionByName(
        faces.select(*MESH, F.col("v1").alias("u"), F.col("v2").alias("v"))
    )
    labels = connected_components(edges, "mesh_id").withColumnRenamed("node", "v0")
    return faces.join(labels, [*MESH, "v0"])


def _spurious(faces: DataFrame, vertices: DataFrame, factor: float, min_faces: int) -> DataFrame:
    flagged = checkpointed(_without_long_edges(faces, vertices, factor))
    # sizes and faces both read the components
    grouped = checkpointed(face_components(flagged.where(~F.col("long_edge"))))
    sizes = grouped.groupBy(*MESH, "component").agg(F.count(F.lit(1)).alias("component_faces"))
    return flagged.where("long_edge").withColumn("fate", F.lit("long_edge")).select(
        *MESH, "face_id", "v0", "v1", "v2", "fate"
    ).unionByName(
        grouped.join(sizes, [*MESH, "component"]).select(
            *MESH, "face_id", "v0", "v1", "v2",
            F.when(F.col("component_faces") < min_faces, "small_component").otherwise("kept").alias("fate"),
        )
    )


def remove_spurious(faces: DataFrame, vertices: DataFrame, factor: float = 20.0, min_faces: int = 2) -> DataFrame:
    """Drop faces with an over-long edge, then surface components under ``min_faces`` faces.

    Over-long means more than ``factor`` times the mean face edge of the mesh; a face
    with an unknown vertex counts as over-long.
    """
    return _spurious(faces, vertices, factor, min_faces).where(F.col("fate") == "kept").drop("fate")


def spurious_report(faces: DataFrame, vertices: DataFrame, factor: float = 20.0, min_faces: int = 2) -> DataFrame:
    """Faces kept and removed, by reason."""
    fate = F.col("fate")
    return _spurious(faces, vertices, factor, min_faces).groupBy(*MESH).agg(
        F.count_if(fate == "kept").alias("kept"),
        F.count_if(fate == "long_edge").alias("long_edge_removed"),
        F.count_if(fate == "small_component").alias("small_component_removed"),
    )


def smooth_mesh(vertices: DataFrame, faces: DataFrame, iters: int = 2) -> DataFrame:
    """Move every vertex to the mean of its edge neighbours, ``iters`` times; isolated ones stay."""
    edges = _undirected_edges(faces).distinct()
    around = edges.select(*MESH, F.col("u").alias("vertex_id"), F.col("v").alias("neighbor")).unionByName(
        edges.select(*MESH, F.col("v").alias("vertex_id"), F.col("u").alias("neighbor"))
    )
    around = checkpointed(around) if iters > 1 else around
    rest = [c for c in vertices.columns if c not in AXES]
    now = vertices
    for turn in range(iters):
        at = now.select(*MESH, F.col("vertex_id").alias("neighbor"), *AXES)
        means = around.join(at, [*MESH, "neighbor"]).groupBy(*MESH, "vertex_id").agg(
            *[F.avg(a).alias(f"m{a}") for a in AXES]
        )
        now = now.join(means, [*MESH, "vertex_id"], "left").select(
            *rest, *[F.coalesce(F.col(f"m{a}"), F.col(a).cast("double")).alias(a) for a in AXES]
        )
        if turn % 3 == 2 and turn + 1 < iters:
            now = checkpointed(now)
    return now.select(*vertices.columns)


def estimate_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Area-weighted mean normal of each vertex, unit length; null when degenerate or unused."""
    placed = with_corner_positions(faces, vertices)
    cross = _cross("p0", "p1", "p2")
    spread = placed.select(
        *MESH, F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"), *[c.alias(f"c{a}") for a, c in zip(AXES, cross)]
    )
    sums = spread.groupBy(*MESH, "vertex_id").agg(*[F.sum(f"c{a}").alias(f"s{a}") for a in AXES])
    length = _length([F.col(f"s{a}") for a in AXES])
    unit = sums.select(
        *MESH, "vertex_id", *[F.when(length > 1e-12, F.col(f"s{a}") / length).alias(f"n{a}") for a in AXES]
    )
    return vertices.select(*MESH, "vertex_id").join(unit, [*MESH, "vertex_id"], "left")


# --- sampling ----------------------------------------------------------------------------------

# Areas are summed as whole multiples of the largest face over this, so sums do not depend on order.
AREA_STEPS = 1 << 31
DRAW_CHUNK = 10_000
# Draws are whole numbers modulo this prime, so other engines can repeat them.
PRIME = 2_147_483_647


def sample_counts(
    faces: DataFrame, vertices: DataFrame, n: int | None = None, density: float | None = None
) -> DataFrame:
    """How many samples each face gets: ``n`` per mesh, or ``density`` per unit area.

    Face number k gets floor(A_k n / A) - floor(A_(k-1) n / A) samples, A_k being the
    area up to k in face order, so the counts of a mesh add up to n exactly.
    """
    if (n is None) == (density is None):
        raise ValueError("give either n or density")
    geometry = checkpointed(face_geometry(faces, vertices).select(*MESH, "face_id", "area"))
    largest = small_side(geometry.groupBy(*MESH).agg(F.max("area").alias("largest")))
    weighed = geometry.join(largest, MESH).where(F.col("largest") > 0).withColumn(
        "weight", F.bround(F.col("area") / F.col("largest") * AREA_STEPS).cast("long")
    )
    totals = weighed.groupBy(*MESH).agg(F.sum("weight").alias("total"), F.max("largest").alias("top"))
    if n is None:
        wanted = F.floor(F.col("total") * (F.col("top") / AREA_STEPS) * density).cast("long")
    else:
        wanted = F.lit(n).cast("long")
    totals = small_side(totals.select(*MESH, "total", wanted.alias("samples")))
    upto = running_folds(weighed, MESH, "face_id", {"upto": ("sum", F.col("weight"))}).join(totals, MESH)

    def share(area):
        scaled = area.cast("decimal(20,0)") * F.col("samples").cast("decimal(18,0)")
        return F.call_function("div", scaled, F.col("total").cast("decimal(20,0)"))

    return upto.select(
        *MESH, "face_id", (share(F.col("upto")) - share(F.col("upto") - F.col("weight"))).cast("long").alias("samples")
    )


def sample_mesh(
    faces: DataFrame, vertices: DataFrame, n: int | None = None, density: float | None = None, seed: int = 0
) -> DataFrame:
    """Points on the surface, uniform by area; draws depend on (mesh, face, number, seed) only.

    A draw is a chain of multiplications and fifth powers modulo a prime, of which the fifth power is
    a permutation.
    """
    counts = sample_counts(faces, vertices, n, density).where(F.col("samples") > 0)
    # corners are joined to chunks of draws, so that only faces and chunks are shuffled, never the points
    chunks = counts.join(with_corner_positions(faces, vertices), [*MESH, "face_id"]).withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0).cast("long"), long_div(F.col("samples") - 1, DRAW_CHUNK)))
    ).repartition(*MESH, "face_id", "__chunk")
    first = F.col("__chunk") * DRAW_CHUNK
    draws = chunks.withColumn(
        "draw", F.explode(F.sequence(first, F.least(first + DRAW_CHUNK, F.col("samples")) - 1))
    )

    def fifth(x):
        square = F.pmod(x * x, F.lit(PRIME))
        return F.pmod(F.pmod(square * square, F.lit(PRIME)) * x, F.lit(PRIME))

    def part(x):
        return F.pmod(x.cast("long"), F.lit(PRIME))

    draws = draws.withColumn("__a", part(part(F.col("face_id")) * 48_271 + part(F.col("draw")) + 1))
    for column in MESH:
        draws = draws.withColumn("__a", part(fifth(F.col("__a")) * 69_621 + part(F.col(column)) + 2))
    draws = draws.withColumn("__a", fifth(F.col("__a"))).withColumns({
        f"__s{stream}": part(F.col("__a") * 39_373 + (2 * seed + 3 + stream)) for stream in (1, 2)})

    def uniform(stream: int):
        return fifth(F.col(f"__s{stream}")).cast("double") / float(PRIME)

    placed = draws.withColumns({"__r": F.sqrt(uniform(1)), "__s": uniform(2)})
    r, s = F.col("__r"), F.col("__s")
    return placed.select(*MESH, "face_id", "draw", *[
        ((1 - r) * F.col(f"p0{a}") + r * (1 - s) * F.col(f"p1{a}") + r * s * F.col(f"p2{a}")).alias(a) for a in AXES
    ])
