"""Mesh measures, contact graphs, removal plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import contact as C, mesh as G
from ..operators.metrics import PART
from ..operators.removal import removal_plan
from . import duck
from .poses import rounded
from .registry import query

DENSE, SPARSE = duck.mesh(fx.MESH_DENSE), duck.mesh(fx.MESH_SPARSE)


def _v(spark, sf, orders=fx.MESH_DENSE):
    return fx.vertices(spark, sf, orders)


def _f(spark, sf, orders=fx.MESH_DENSE):
    return fx.faces(spark, sf, orders)


# Fixture face f has the corners f, f + 1 and f + 2.
GEOM = """geom AS (SELECT name, part_idx, f_idx, ux, uy, uz, sqrt(ux*ux+uy*uy+uz*uz) AS len,
    (ax*(by_*cz-bz*cy)+ay*(bz*cx-bx*cz)+az*(bx*cy-by_*cx))/6 AS vol,
    ax, ay, az, bx, by_, bz, cx, cy, cz FROM (
  SELECT *, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS ux, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS uy,
            (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS uz FROM (
  SELECT name, part_idx, v_idx AS f_idx, x AS ax, y AS ay, z AS az,
         lead(x, 1) OVER g AS bx, lead(y, 1) OVER g AS by_, lead(z, 1) OVER g AS bz,
         lead(x, 2) OVER g AS cx, lead(y, 2) OVER g AS cy, lead(z, 2) OVER g AS cz
  FROM verts WINDOW g AS (PARTITION BY name, part_idx ORDER BY v_idx)) WHERE cx IS NOT NULL))"""
MEASURES = """meas AS (SELECT name, part_idx, sum(len)/2 AS area, sum(vol) AS volume FROM geom GROUP BY name, part_idx)"""
PRIO = """prio AS (SELECT name, part_idx, volume, CAST(CASE WHEN r = 1 THEN n - 1 ELSE r - 2 END AS BIGINT) AS prio FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(volume, 9) DESC, part_idx) AS r,
         count(*) OVER (PARTITION BY name) AS n FROM meas))"""
SHARED = """spots AS (SELECT DISTINCT name, part_idx, round_even(x, 5) AS x, round_even(y, 5) AS y, round_even(z, 5) AS z FROM verts),
common AS (SELECT a.name, a.part_idx, b.part_idx AS other, x, y, z FROM spots a JOIN spots b USING (name, x, y, z) WHERE a.part_idx <> b.part_idx),
corners AS (SELECT name, part_idx, f_idx, 0 AS slot, a AS v_idx FROM faces UNION ALL SELECT name, part_idx, f_idx, 1, b FROM faces
  UNION ALL SELECT name, part_idx, f_idx, 2, c FROM faces),
shared AS MATERIALIZED (SELECT k.name, k.part_idx, k.f_idx, m.other FROM corners k
  JOIN verts v ON v.name=k.name AND v.part_idx=k.part_idx AND v.v_idx=k.v_idx
  JOIN common m ON m.name=k.name AND m.part_idx=k.part_idx AND m.x=round_even(v.x,5) AND m.y=round_even(v.y,5) AND m.z=round_even(v.z,5)
  GROUP BY ALL HAVING count(DISTINCT slot) = 3),
labelled AS MATERIALIZED (SELECT f.name, f.part_idx, f.f_idx, f.a, f.b, f.c, coalesce(max(s.other), -1) AS shared_with
  FROM faces f LEFT JOIN shared s ON s.name=f.name AND s.part_idx=f.part_idx AND s.f_idx=f.f_idx GROUP BY ALL)"""
EDGES = """edges AS (SELECT DISTINCT a.name, a.part_idx AS i, b.part_idx AS j FROM verts a JOIN verts b
  ON a.name=b.name AND a.part_idx < b.part_idx AND round_even(a.x,5)=round_even(b.x,5)
  AND round_even(a.y,5)=round_even(b.y,5) AND round_even(a.z,5)=round_even(b.z,5))"""
SCALE = """sc AS (SELECT name, greatest(1.0, max(s)) AS mesh_scale FROM (
  SELECT name, part_idx, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS s FROM verts GROUP BY ALL) GROUP BY name)"""


@query("a01_object_scale", f"WITH {DENSE}, {SCALE} SELECT v.name, part_idx, v_idx, mesh_scale, {duck.rs(['x/mesh_scale', 'y/mesh_scale', 'z/mesh_scale'], ['x', 'y', 'z'])} FROM verts v JOIN sc USING (name)")
def object_scale(spark, sf):
    df = G.scale_to_unit(_v(spark, sf))
    return df.select(*PART, "v_idx", "mesh_scale", *rounded(map(F.col, "xyz"), "xyz"))


@query("a02_piece_area", f"WITH {DENSE}, {GEOM}, {MEASURES} SELECT name, part_idx, {duck.r('area', 'area')} FROM meas")
def piece_area(spark, sf):
    df = G.piece_measures(_v(spark, sf), _f(spark, sf))
    return df.select(*PART, *rounded([F.col("area")], ["area"]))


@query("a03_piece_volume", f"WITH {DENSE}, {GEOM}, {MEASURES} SELECT name, part_idx, {duck.r('volume', 'volume')} FROM meas")
def piece_volume(spark, sf):
    df = G.piece_measures(_v(spark, sf), _f(spark, sf))
    return df.select(*PART, *rounded([F.col("volume")], ["volume"]))


@query(
    "m01_face_normals",
    f"WITH {DENSE}, {GEOM} SELECT name, part_idx, f_idx, "
    + duck.rs([f"CASE WHEN len > 0 THEN {u}/len ELSE 0 END" for u in ("ux", "uy", "uz")], ("fnx", "fny", "fnz"))
    + " FROM geom",
)
def face_normals(spark, sf):
    names = ("fnx", "fny", "fnz")
    df = G.face_geometry(_v(spark, sf), _f(spark, sf))
    return df.select(*PART, "f_idx", *rounded(map(F.col, names), names))


@query("w12_removal_priority", f"WITH {DENSE}, {GEOM}, {MEASURES}, {PRIO} SELECT name, part_idx, {duck.r('volume', 'volume')}, prio FROM prio")
def removal_priority(spark, sf):
    df = G.removal_priority(G.piece_measures(_v(spark, sf), _f(spark, sf)))
    return df.select(*PART, *rounded([F.col("volume")], ["volume"]), "prio")


@query(
    "t03_volume_order",
    f"WITH {DENSE}, {GEOM}, {MEASURES} SELECT name, part_idx, CAST(row_number() OVER (PARTITION BY name ORDER BY round(volume, 9) DESC, part_idx) - 1 AS BIGINT) AS volume_rank FROM meas",
)
def volume_order(spark, sf):
    from ..operators.ordering import with_rank

    m = G.piece_measures(_v(spark, sf), _f(spark, sf)).withColumn(
        "_d", -F.round("volume", G.VOLUME_DIGITS)
    )
    return with_rank(m, ["name"], ["_d", "part_idx"], "volume_rank").select(*PART, "volume_rank")


@query("j01_vertex_contact", f"WITH {SPARSE}, {EDGES} SELECT name, i, j FROM edges")
def vertex_contact(spark, sf):
    return C.contact_edges(_v(spark, sf, fx.MESH_SPARSE))


@query("j02_shared_faces", f"WITH {DENSE}, {SHARED} SELECT name, part_idx, f_idx, other FROM shared")
def shared_faces(spark, sf):
    return C.shared_faces(_v(spark, sf), _f(spark, sf))


def labelled(spark, sf):
    f = _f(spark, sf)
    return C.label_faces(f, C.shared_faces(_v(spark, sf), f))


@query("j03_face_partner_label", f"WITH {DENSE}, {SHARED} SELECT name, part_idx, f_idx, shared_with FROM labelled")
def face_labels(spark, sf):
    return labelled(spark, sf).select(*PART, "f_idx", "shared_with")


@query(
    "j04_face_contact_graph",
    f"""WITH {DENSE}, {SHARED}, up AS (SELECT DISTINCT name, part_idx AS i, shared_with AS j FROM labelled WHERE shared_with > part_idx)
    SELECT name, i, j FROM up UNION ALL SELECT name, j AS i, i AS j FROM up""",
)
def face_contact_graph(spark, sf):
    return C.face_contact_edges(labelled(spark, sf))


# Object n receives the first two pieces of object n+1 as distractors.
@query(
    "j05_distractor_pieces",
    f"""WITH {DENSE}, {SHARED}, n AS MATERIALIZED (SELECT name, max(part_idx)+1 AS np FROM verts GROUP BY name),
    foreign_faces AS MATERIALIZED (SELECT name - 1 AS name, part_idx, f_idx, a, b, c FROM faces WHERE part_idx < 2)
    SELECT name, part_idx, f_idx, a, b, c, shared_with, false AS redundant FROM labelled
    UNION ALL SELECT name, np + part_idx, f_idx, a, b, c, -1, true FROM n JOIN foreign_faces USING (name)""",
)
def distractor_pieces(spark, sf):
    sizes = _v(spark, sf).groupBy("name").agg((F.max("part_idx") + 1).alias("num_parts"))
    redundant = sizes.select(
        "name", (F.col("name") + 1).alias("src_name"),
        F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("rank"),
    ).withColumn("src_piece", F.col("rank"))
    return C.add_distractors(labelled(spark, sf), sizes, redundant, 2)


@query(
    "u01_common_vertices",
    f"WITH {SPARSE}, s AS (SELECT DISTINCT name, part_idx, round_even(x,5)+0.0 AS x, round_even(y,5)+0.0 AS y, round_even(z,5)+0.0 AS z FROM verts) "
    "SELECT a.name, a.part_idx, b.part_idx AS other, x, y, z FROM s a JOIN s b USING (name, x, y, z) WHERE a.part_idx <> b.part_idx",
)
def common_vertices(spark, sf):
    df = C.common_vertices(_v(spark, sf, fx.MESH_SPARSE))
    return df.select(*PART, "other", F.col("_rx").alias("x"), F.col("_ry").alias("y"), F.col("_rz").alias("z"))


_CC = f"""WITH RECURSIVE {SPARSE}, {EDGES},
sym AS (SELECT name, i, j FROM edges UNION ALL SELECT name, j, i FROM edges),
nodes AS (SELECT DISTINCT name, part_idx FROM verts),
reach AS (SELECT name, part_idx, part_idx AS root FROM nodes UNION
  SELECT s.name, s.j, r.root FROM reach r JOIN sym s ON s.name = r.name AND s.i = r.part_idx)"""


@query("a22_connected_components", f"{_CC} SELECT name, part_idx, min(root) AS component FROM reach GROUP BY name, part_idx")
def connected_components(spark, sf):
    v = _v(spark, sf, fx.MESH_SPARSE)
    return C.connected_components(v.select(*PART).distinct(), C.contact_links(v))


def plan(spark, sf, orders=fx.MESH_SPARSE):
    v, f = _v(spark, sf, orders), _f(spark, sf, orders)
    pieces = v.select(*PART).distinct()
    measured = pieces.join(G.piece_measures(v, f), PART, "left").fillna(0.0, ["volume"])
    return removal_plan(G.removal_priority(measured), C.contact_edges(v))


# The pieces left of an object are the bits of a number (fixture objects have seven pieces at most).  Everything
# reached from the lowest bit is found by spreading seven times; a rest is whole if that is all of it.
_REACH = """list_reduce(range(7), lambda r, _: r | list_bit_or(list_transform(range(7), lambda p: CASE WHEN r >> p & 1 = 1 THEN nb[p + 1] & m ELSE 0 END)), m & -m)"""


def plan_sql(mesh: str) -> str:
    """Greedy peel: in every step the first piece in order whose removal leaves one component."""
    return f"""WITH RECURSIVE {mesh}, {GEOM}, {MEASURES}, {EDGES},
    pieces AS (SELECT DISTINCT name, part_idx FROM verts),
    vols AS (SELECT name, part_idx, coalesce(volume, 0) AS volume FROM pieces LEFT JOIN meas USING (name, part_idx)),
    ordered AS (SELECT name, part_idx, CASE WHEN r = 1 THEN n ELSE r - 1 END AS prio FROM (
      SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(volume, 9) DESC, part_idx) AS r, count(*) OVER (PARTITION BY name) AS n FROM vols)),
    near AS (SELECT name, p, bit_or(CASE WHEN i = p THEN 1::BIGINT << j WHEN j = p THEN 1::BIGINT << i ELSE 0 END) AS nb
      FROM (SELECT o.name, g.p, e.i, e.j FROM (SELECT DISTINCT name FROM pieces) o, (SELECT unnest(range(7)) AS p) g LEFT JOIN edges e ON e.name = o.name) GROUP BY ALL),
    graph AS (SELECT name, list(nb ORDER BY p) AS nb FROM near GROUP BY name),
    whole AS (SELECT name, m FROM (SELECT name, m, {_REACH} AS r FROM graph, (SELECT unnest(range(1, 128)) AS m) g) WHERE r = m),
    sets AS (SELECT name, list(part_idx ORDER BY prio) AS pieces_in_order, CAST(sum(1::BIGINT << part_idx) AS BIGINT) AS alive FROM ordered GROUP BY name),
    good AS (SELECT name, list(m) AS wholes FROM whole GROUP BY name),
    walk AS (
      SELECT name, CAST(-1 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS part_idx, alive, pieces_in_order, wholes FROM sets JOIN good USING (name)
      UNION ALL
      SELECT name, step + 1, pick, alive - (1::BIGINT << pick), pieces_in_order, wholes FROM (
        SELECT *, list_filter(pieces_in_order, lambda p: alive >> p & 1 = 1 AND list_contains(wholes, alive - (1::BIGINT << p)))[1] AS pick FROM walk) WHERE pick IS NOT NULL),
    plan AS (SELECT name, step, part_idx FROM walk WHERE step >= 0)"""


@query("d01_removal_plan", f"{plan_sql(SPARSE)} SELECT name, step, part_idx FROM plan")
def removal_plan_query(spark, sf):
    return plan(spark, sf)


@query(
    "j06_piece_removal",
    f"{plan_sql(SPARSE)} SELECT name, part_idx FROM pieces WHERE (name, part_idx) NOT IN (SELECT (name, part_idx) FROM plan WHERE step < 2)",
)
def piece_removal(spark, sf):
    pieces = _v(spark, sf, fx.MESH_SPARSE).select(*PART).distinct()
    return C.without_removed(pieces, plan(spark, sf), 2)
