"""Queries over meshes."""

from capturemill.operators import mesh
from capturemill.operators.numbering import dense_first_seen_index
from capturemill.plans.catalog import query


@query("resolve_corners", "corners", "texcoords", sql="""
    SELECT c.mesh_id, face_id, corner, v_idx, c.vt_idx, pos, round(coalesce(u, 0), 6) AS u,
      round(round(1 - coalesce(v, 0), 9), 6) AS v
    FROM corners c LEFT JOIN texcoords t ON t.vt_idx = c.vt_idx AND t.mesh_id = c.mesh_id""")
def resolve_corners(spark, lens):
    return mesh.resolve_corners(lens("corners"), lens("texcoords"))


@query("unresolved_corners", "corners", "vertices", sql="""
    SELECT * FROM corners c WHERE NOT EXISTS (SELECT 1 FROM vertices v WHERE v.vertex_id = c.v_idx AND v.mesh_id = c.mesh_id)""")
def unresolved_corners(spark, lens):
    known = lens("vertices").withColumnRenamed("vertex_id", "v_idx")
    return mesh.unresolved_corners(lens("corners"), known)


@query("dense_first_seen_index", "corners", sql="""
    SELECT mesh_id, v_idx, vt_idx, first_seen, row_number() OVER (PARTITION BY mesh_id ORDER BY first_seen) - 1 AS index
    FROM (SELECT mesh_id, v_idx, vt_idx, min(pos) AS first_seen FROM corners GROUP BY 1, 2, 3) f""")
def first_seen_index(spark, lens):
    return dense_first_seen_index(lens("corners"), ["mesh_id"], ["v_idx", "vt_idx"], "pos")


UNPACKED = """
    idx AS (SELECT mesh_id, v_idx, vt_idx, row_number() OVER (PARTITION BY mesh_id ORDER BY min(pos)) - 1 AS vertex_id
            FROM corners GROUP BY 1, 2, 3)"""


def _unpacked(lens):
    held = lens("vertices").withColumnRenamed("vertex_id", "v_idx")
    return mesh.unpack_obj(lens("corners"), held, lens("texcoords"))


@query("unpack_obj_vertices", "corners", "vertices", "texcoords", sql=f"""
    WITH {UNPACKED}
    SELECT i.mesh_id, i.vertex_id, p.x, p.y, round(round(CAST(CAST(p.z AS FLOAT) AS DOUBLE), 9), 6) AS z,
      round(round(CAST(CAST(coalesce(t.u, 0) AS FLOAT) AS DOUBLE), 9), 6) AS u,
      round(round(CAST(CAST(1 - coalesce(t.v, 0) AS FLOAT) AS DOUBLE), 9), 6) AS v
    FROM idx i JOIN vertices p ON p.mesh_id = i.mesh_id AND p.vertex_id = i.v_idx
    LEFT JOIN texcoords t ON t.mesh_id = i.mesh_id AND t.vt_idx = i.vt_idx""")
def unpack_obj_vertices(spark, lens):
    return _unpacked(lens)[0]


@query("unpack_obj_faces", "corners", "vertices", "texcoords", sql=f"""
    WITH {UNPACKED}
    SELECT c.mesh_id, c.face_id, """ + ", ".join(
    f"max(vertex_id) FILTER (WHERE corner = {n + 1}) AS v{n}" for n in range(3)
) + """ FROM corners c JOIN idx i ON i.mesh_id = c.mesh_id AND i.v_idx = c.v_idx AND i.vt_idx = c.vt_idx GROUP BY 1, 2""")
def unpack_obj_faces(spark, lens):
    return _unpacked(lens)[1]


PLACED = "placed AS (SELECT f.*, " + ", ".join(
    f"p{n}.{a} AS p{n}{a}" for n in range(3) for a in "xyz"
) + " FROM faces f " + " ".join(
    f"LEFT JOIN vertices p{n} ON p{n}.mesh_id = f.mesh_id AND p{n}.vertex_id = f.v{n}" for n in range(3)
) + ")"


def _difference(m: int, n: int, a: str) -> str:
    return f"(p{n}{a} - p{m}{a})"


def _length(parts: list[str]) -> str:
    return "sqrt(" + " + ".join(f"{p} * {p}" for p in parts) + ")"


P, Q = [[_difference(0, n, a) for a in "xyz"] for n in (1, 2)]
CROSS = [f"({P[i]} * {Q[j]} - {P[j]} * {Q[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
GEOMETRY = f"{PLACED}, crossed AS (SELECT *, {CROSS[0]} AS cx, {CROSS[1]} AS cy, {CROSS[2]} AS cz FROM placed), " + (
    "geometry AS (SELECT *, " + ", ".join(
        f"{_length([_difference(m, n, a) for a in 'xyz'])} AS edge{m}{n}" for m, n in ((0, 1), (1, 2), (2, 0))
    ) + ", sqrt(cx * cx + cy * cy + cz * cz) AS twice FROM crossed)"
)


def _six(text: str) -> str:
    return f"round(round({text}, 9), 6) + 0.0"


@query("face_geometry", "faces", "vertices", sql=f"WITH {GEOMETRY} SELECT mesh_id, face_id, v0, v1, v2, " + ", ".join(
    [f"{_six(e)} AS {e}" for e in ("edge01", "edge12", "edge20")] + [f"{_six('twice / 2')} AS area"]
    + [f"CASE WHEN twice > 0 THEN {_six(f'c{a} / twice')} END AS n{a}" for a in "xyz"]
) + " FROM geometry")
def face_geometry(spark, lens):
    return mesh.face_geometry(lens("faces"), lens("vertices"))


EDGES = """
    sides AS (SELECT mesh_id, unnest([least(v0, v1), least(v1, v2), least(v2, v0)]) AS u,
                     unnest([greatest(v0, v1), greatest(v1, v2), greatest(v2, v0)]) AS v FROM faces),
    uses AS (SELECT mesh_id, u, v, count(*) AS uses FROM sides GROUP BY 1, 2, 3)"""


@query("boundary_edges", "faces", sql=f"WITH {EDGES} SELECT mesh_id, u, v FROM uses WHERE uses = 1")
def boundary_edges(spark, lens):
    return mesh.boundary_edges(lens("faces"))


@query("hole_count", "faces", sql=f"""
    WITH {EDGES},
    rim AS (SELECT mesh_id, u, v FROM uses WHERE uses = 1 UNION ALL SELECT mesh_id, v, u FROM uses WHERE uses = 1),
    reach(mesh_id, u, v) AS (SELECT DISTINCT mesh_id, u, u FROM rim UNION
      SELECT r.mesh_id, r.u, e.v FROM reach r JOIN rim e ON e.mesh_id = r.mesh_id AND e.u = r.v)
    SELECT t.*, coalesce(loops, 0) AS loops FROM (SELECT mesh_id, count(*) AS edges,
        count(*) FILTER (WHERE uses = 1) AS boundary_edges, count(*) FILTER (WHERE uses > 2) AS non_manifold_edges
      FROM uses GROUP BY 1) t
    LEFT JOIN (SELECT mesh_id, count(DISTINCT root) AS loops FROM (SELECT mesh_id, u, min(v) AS root FROM reach GROUP BY 1, 2) r
      GROUP BY 1) l ON l.mesh_id = t.mesh_id""")
def hole_count(spark, lens):
    return mesh.hole_count(lens("faces"))


FACTOR, MIN_FACES = 3.0, 20
BENT = GEOMETRY.replace("vertices p", "bent_vertices p")
FATES = f"""
    mean AS (SELECT mesh_id, sum(edge01 + edge12 + edge20) / (count(*) * 3) AS m FROM geometry GROUP BY 1),
    flagged AS (SELECT g.mesh_id, face_id, v0, v1, v2, greatest(edge01, edge12, edge20) > m * {FACTOR} AS long_edge
                FROM geometry g JOIN mean ON mean.mesh_id = g.mesh_id),
    good AS (SELECT * FROM flagged WHERE NOT long_edge),
    link AS (SELECT mesh_id, v0 AS u, v1 AS v FROM good UNION SELECT mesh_id, v1, v0 FROM good
      UNION SELECT mesh_id, v1, v2 FROM good UNION SELECT mesh_id, v2, v1 FROM good),
    reach(mesh_id, u, v) AS (SELECT DISTINCT mesh_id, u, u FROM link UNION
      SELECT r.mesh_id, r.u, e.v FROM reach r JOIN link e ON e.mesh_id = r.mesh_id AND e.u = r.v),
    root AS (SELECT mesh_id, u, min(v) AS component FROM reach GROUP BY 1, 2),
    labelled AS (SELECT g.*, component, count(*) OVER (PARTITION BY g.mesh_id, component) AS n
                 FROM good g JOIN root r ON r.mesh_id = g.mesh_id AND r.u = g.v0),
    fates AS (SELECT mesh_id, face_id, v0, v1, v2, 'long_edge' AS fate FROM flagged WHERE long_edge UNION ALL
      SELECT mesh_id, face_id, v0, v1, v2, CASE WHEN n < {MIN_FACES} THEN 'small_component' ELSE 'kept' END FROM labelled)"""


@query("remove_spurious", "faces", "bent_vertices", sql=f"""
    WITH {BENT}, {FATES} SELECT mesh_id, face_id, v0, v1, v2 FROM fates WHERE fate = 'kept'""")
def remove_spurious(spark, lens):
    return mesh.remove_spurious(lens("faces"), lens("bent_vertices"), FACTOR, MIN_FACES)


@query("spurious_report", "faces", "bent_vertices", sql=f"""
    WITH {BENT}, {FATES} SELECT mesh_id, count(*) FILTER (WHERE fate = 'kept') AS kept,
      count(*) FILTER (WHERE fate = 'long_edge') AS long_edge_removed,
      count(*) FILTER (WHERE fate = 'small_component') AS small_component_removed FROM fates GROUP BY 1""")
def spurious_report(spark, lens):
    return mesh.spurious_report(lens("faces"), lens("bent_vertices"), FACTOR, MIN_FACES)


def _smoothed(source: str) -> str:
    means = ", ".join(f"avg(p.{a}) AS {a}" for a in "xyz")
    moved = ", ".join(f"coalesce(m.{a}, s.{a}) AS {a}" for a in "xyz")
    return f"""(SELECT s.mesh_id, s.vertex_id, {moved} FROM {source} s LEFT JOIN (
      SELECT n.mesh_id, n.u AS vertex_id, {means} FROM near n JOIN {source} p ON p.mesh_id = n.mesh_id AND p.vertex_id = n.v
      GROUP BY 1, 2) m ON m.mesh_id = s.mesh_id AND m.vertex_id = s.vertex_id)"""


@query("smooth_mesh", "vertices", "faces", sql=f"""
    WITH {EDGES}, near AS (SELECT mesh_id, u, v FROM uses UNION ALL SELECT mesh_id, v, u FROM uses),
    once AS {_smoothed("vertices")}, twice AS {_smoothed("once")}
    SELECT mesh_id, vertex_id, """ + ", ".join(f"{_six(a)} AS {a}" for a in "xyz") + " FROM twice")
def smooth_mesh(spark, lens):
    return mesh.smooth_mesh(lens("vertices"), lens("faces"), 2)


@query("estimate_normals", "vertices", "faces", sql=f"""
    WITH {GEOMETRY},
    spread AS (SELECT mesh_id, unnest([v0, v1, v2]) AS vertex_id, cx, cy, cz FROM geometry),
    sums AS (SELECT mesh_id, vertex_id, sum(cx) AS sx, sum(cy) AS sy, sum(cz) AS sz FROM spread GROUP BY 1, 2),
    unit AS (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS n FROM sums)
    SELECT p.mesh_id, p.vertex_id, """ + ", ".join(
    f"CASE WHEN n > 1e-12 THEN {_six(f's{a} / n')} END AS n{a}" for a in "xyz"
) + " FROM vertices p LEFT JOIN unit u ON u.mesh_id = p.mesh_id AND u.vertex_id = p.vertex_id")
def estimate_normals(spark, lens):
    return mesh.estimate_normals(lens("vertices"), lens("faces"))


SAMPLES = f"""{GEOMETRY}, top AS (SELECT mesh_id, max(twice / 2) AS largest FROM geometry GROUP BY 1),
    weighed AS (SELECT g.mesh_id, face_id, CAST(round_even(twice / 2 / largest * 2147483648, 0) AS HUGEINT) AS w
                FROM geometry g JOIN top ON top.mesh_id = g.mesh_id),
    upto AS (SELECT *, sum(w) OVER (PARTITION BY mesh_id ORDER BY face_id ROWS UNBOUNDED PRECEDING) AS c,
                    sum(w) OVER (PARTITION BY mesh_id) AS total FROM weighed),
    samples AS (SELECT mesh_id, face_id, CAST(c * 5000 // total - (c - w) * 5000 // total AS BIGINT) AS samples FROM upto)"""


@query("sample_counts", "faces", "vertices", sql=f"WITH {SAMPLES} SELECT * FROM samples")
def sample_counts(spark, lens):
    return mesh.sample_counts(lens("faces"), lens("vertices"), n=5000)


def _fifth(x: str) -> str:
    """The fifth power modulo the prime, each product below 2**62."""
    square = f"({x} * {x} % {mesh.PRIME})"
    return f"({square} * {square} % {mesh.PRIME} * {x} % {mesh.PRIME})"


SEED = 7
DRAWS = f"""
    d0 AS (SELECT mesh_id, face_id, unnest(range(samples)) AS draw FROM samples),
    d1 AS (SELECT *, (face_id % {mesh.PRIME} * 48271 + draw % {mesh.PRIME} + 1) % {mesh.PRIME} AS a FROM d0),
    d2 AS (SELECT *, ({_fifth('a')} * 69621 + mesh_id % {mesh.PRIME} + 2) % {mesh.PRIME} AS b FROM d1),
    d3 AS (SELECT *, ({_fifth('b')} * 39373 + {2 * SEED + 4}) % {mesh.PRIME} AS s1,
                     ({_fifth('b')} * 39373 + {2 * SEED + 5}) % {mesh.PRIME} AS s2 FROM d2),
    d4 AS (SELECT mesh_id, face_id, draw, sqrt(CAST({_fifth('s1')} AS DOUBLE) / {mesh.PRIME}.0) AS r,
                  CAST({_fifth('s2')} AS DOUBLE) / {mesh.PRIME}.0 AS s FROM d3)"""


@query("sample_mesh", "faces", "vertices", sql=f"""
    WITH {SAMPLES}, {DRAWS}
    SELECT d.mesh_id, d.face_id, draw, """ + ", ".join(
    f"round(round((1 - r) * p0{a} + r * (1 - s) * p1{a} + r * s * p2{a}, 9), 6) AS {a}" for a in "xyz"
) + " FROM d4 d JOIN placed f ON f.mesh_id = d.mesh_id AND f.face_id = d.face_id")
def sample_mesh(spark, lens):
    return mesh.sample_mesh(lens("faces"), lens("vertices"), n=5000, seed=SEED)
