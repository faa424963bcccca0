"""Point-cloud preparation, budgets, sampling, anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.rand import hash_uniform
from ..operators import cloud as K, mesh as G, sampling as S
from ..operators.metrics import PART
from ..session import materialize
from . import duck
from .meshes import DENSE, GEOM, MEASURES, SHARED, labelled
from .metrics import part_sizes
from .poses import rounded
from .registry import query

XYZ = ("x", "y", "z")
CENTRED = duck.PTS + """,
mids AS (SELECT name, part_idx, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, count(*) AS n_points FROM pts GROUP BY ALL),
cent AS (SELECT name, part_idx, pt_idx, x-mx AS x, y-my AS y, z-mz AS z, mx, my, mz FROM pts JOIN mids USING (name, part_idx)),
scl AS (SELECT name, part_idx, max(greatest(abs(x), abs(y), abs(z))) AS scale, count(*) AS n_points FROM cent GROUP BY ALL)"""
BUDGET = 5000


@query(
    "a04_recenter",
    f"WITH {CENTRED} SELECT name, part_idx, pt_idx, {duck.rs(XYZ + ('mx', 'my', 'mz'), XYZ + ('gt_tx', 'gt_ty', 'gt_tz'))} FROM cent",
)
def recenter(spark, sf):
    names = XYZ + ("gt_tx", "gt_ty", "gt_tz")
    return K.recenter(fx.points(spark, sf)).select(*PART, "pt_idx", *rounded(map(F.col, names), names))


@query("a05_part_scale", f"WITH {CENTRED} SELECT name, part_idx, {duck.r('scale', 'scale')}, n_points FROM scl")
def part_scale(spark, sf):
    df = K.part_scales(K.recenter(fx.points(spark, sf)), zero_as_one=True)
    return df.select(*PART, *rounded([F.col("scale")], ["scale"]), "n_points")


@query(
    "m39_scale_unscale",
    f"""WITH {CENTRED} SELECT name, part_idx, pt_idx, {duck.rs(['x/scale', 'y/scale', 'z/scale'], ('sx', 'sy', 'sz'))},
    {duck.rs(XYZ, XYZ)} FROM cent JOIN scl USING (name, part_idx)""",
)
def scale_unscale(spark, sf):
    centred = K.recenter(fx.points(spark, sf))
    parts = K.part_scales(centred)
    small = K.divide_by_scale(centred, parts).drop("scale").withColumns({f"s{c}": F.col(c) for c in "xyz"})
    names = ("sx", "sy", "sz") + XYZ
    return K.multiply_by_scale(small, parts).select(
        *PART, "pt_idx", *rounded(map(F.col, names), names)
    )


_SHUFFLED = duck.shuffled("pt_idx", "n", duck.key(1116, "'shuffle'", "name", "part_idx"))


@query(
    "w08_shuffle_points",
    f"WITH {duck.PTS} SELECT name, part_idx, pt_idx, {_SHUFFLED} AS order_idx FROM "
    "(SELECT *, count(*) OVER (PARTITION BY name, part_idx) AS n FROM pts)",
)
def shuffle_points(spark, sf):
    return K.shuffle(fx.points(spark, sf)).select(*PART, "pt_idx", "order_idx")


_OBJECT_TURN, _PART_TURN = duck.quaternion(1116, "'object'", "name"), duck.quaternion(1116, "name", "part_idx")
_TURNED = ("x", "y", "z", "nx", "ny", "nz", "gt_qw", "gt_qx", "gt_qy", "gt_qz")


@query(
    "m13_random_rotation",
    f"""WITH {duck.PTS},
    turns AS (SELECT name, part_idx, {', '.join(f'{v} AS o{c}' for v, c in zip(_OBJECT_TURN, 'wxyz'))},
      {', '.join(f'{v} AS p{c}' for v, c in zip(_PART_TURN, 'wxyz'))} FROM (SELECT DISTINCT name, part_idx FROM pts)),
    whole AS (SELECT name, part_idx, pt_idx, pw, px, py, pz,
      {', '.join(f'{v} AS {c}' for v, c in zip(duck.matvec(duck.mat(('ow', 'ox', 'oy', 'oz')), ('x', 'y', 'z')), ('wx', 'wy', 'wz')))},
      {', '.join(f'{v} AS {c}' for v, c in zip(duck.matvec(duck.mat(('ow', 'ox', 'oy', 'oz')), ('nx', 'ny', 'nz')), ('mx', 'my', 'mz')))}
      FROM pts JOIN turns USING (name, part_idx)),
    centred AS (SELECT * REPLACE ({', '.join(f'w{c} - avg(w{c}) OVER (PARTITION BY name, part_idx) AS w{c}' for c in 'xyz')}) FROM whole)
    SELECT name, part_idx, pt_idx, {duck.rs(duck.matvec(duck.mat(('pw', 'px', 'py', 'pz')), ('wx', 'wy', 'wz')), _TURNED[:3])},
      {duck.rs(duck.matvec(duck.mat(('pw', 'px', 'py', 'pz')), ('mx', 'my', 'mz')), _TURNED[3:6])},
      {duck.rs(('pw', '-px', '-py', '-pz'), _TURNED[6:])} FROM centred""",
)
def random_rotation(spark, sf):
    whole = K.rotate_objects(fx.points(spark, sf))
    turned = K.rotate_parts(K.recenter(whole))
    return turned.select(*PART, "pt_idx", *rounded(map(F.col, _TURNED), _TURNED))


@query(
    "m44_seeded_randomness",
    f"WITH {duck.PTS} SELECT name, part_idx, pt_idx, {duck.uniform(1116, 'name', 'part_idx', 'pt_idx')} AS u FROM pts",
)
def seeded_randomness(spark, sf):
    return fx.points(spark, sf).select(
        *PART, "pt_idx", hash_uniform(1116, *PART, "pt_idx").alias("u")
    )


_SIZES = duck.PTS + """,
sizes AS (SELECT name, part_idx, n_points, np AS num_parts, CASE WHEN np >= 3 THEN 1 ELSE 0 END AS redundancy FROM (
  SELECT *, count(*) OVER (PARTITION BY name) AS np FROM (
    SELECT name, part_idx, count(*) AS n_points FROM pts GROUP BY ALL)))"""


@query(
    "w05_anchor_part",
    f"""WITH {_SIZES} SELECT name, part_idx AS anchor FROM (
      SELECT *, row_number() OVER (PARTITION BY name ORDER BY n_points DESC, part_idx) AS rn FROM sizes
      WHERE part_idx < num_parts - redundancy) WHERE rn = 1""",
)
def anchor_part(spark, sf):
    return K.anchor_parts(part_sizes(spark, sf))


@query(
    "t02_largest_smallest_part",
    f"""WITH {_SIZES} SELECT name, max(part_idx) FILTER (hi = 1) AS largest, max(part_idx) FILTER (lo = 1) AS smallest FROM (
      SELECT *, row_number() OVER (PARTITION BY name ORDER BY n_points DESC, part_idx) AS hi,
                row_number() OVER (PARTITION BY name ORDER BY n_points, part_idx) AS lo FROM sizes) GROUP BY name""",
)
def largest_smallest(spark, sf):
    return part_sizes(spark, sf).groupBy("name").agg(
        F.max_by("part_idx", F.struct("n_points", -F.col("part_idx"))).alias("largest"),
        F.min_by("part_idx", F.struct("n_points", "part_idx")).alias("smallest"),
    )


@query("p10_anchor_eligibility", f"WITH {_SIZES} SELECT name, part_idx, n_points FROM sizes WHERE n_points > 0.05*300")
def anchor_eligibility(spark, sf):
    return K.eligible_anchors(part_sizes(spark, sf), 300).select(*PART, "n_points")


@query(
    "t08_random_references",
    f"""WITH {_SIZES}, can AS (SELECT * FROM sizes WHERE n_points > 0.05*100),
    fixed AS (SELECT name, arg_min(part_idx, {duck.key(1116, "'anchor'", 'name', 'part_idx')}) AS anchor FROM can GROUP BY name),
    more AS (SELECT name, part_idx, num_parts, count(*) OVER (PARTITION BY name) AS m,
      row_number() OVER (PARTITION BY name ORDER BY {duck.key(1116, "'more'", 'name', 'part_idx')}, part_idx) AS r
      FROM can JOIN fixed USING (name) WHERE part_idx <> anchor),
    chosen AS (SELECT name, part_idx FROM more WHERE num_parts > 2 AND {duck.uniform(1116, "'if'", 'name')} > 1.0::DOUBLE/num_parts
      AND r <= floor({duck.uniform(1116, "'how many'", 'name')} * least(m, num_parts - 2)) + 1)
    SELECT s.name, s.part_idx, n_points, coalesce(s.part_idx = anchor, false) OR c.part_idx IS NOT NULL AS is_ref
    FROM sizes s LEFT JOIN fixed f ON s.name = f.name LEFT JOIN chosen c ON s.name = c.name AND s.part_idx = c.part_idx""",
)
def random_references(spark, sf):
    return K.mark_references(part_sizes(spark, sf), 100, random_anchor=True, multi_ref=True).select(
        *PART, "n_points", "is_ref"
    )


@query("p17_anchor_free", f"WITH {_SIZES} SELECT name, part_idx, false AS is_ref FROM sizes")
def anchor_free(spark, sf):
    return K.clear_references(part_sizes(spark, sf)).select(*PART, "is_ref")


_ALLOC = f"""alloc AS (SELECT name, part_idx, CAST(20 + floor(({BUDGET} - 20*p)*area/total) AS BIGINT) AS n FROM (
  SELECT *, count(*) OVER (PARTITION BY name) AS p, sum(area) OVER (PARTITION BY name) AS total FROM meas)),
budget AS (SELECT name, part_idx, CAST(n + CASE WHEN rn = 1 THEN {BUDGET} - sum(n) OVER (PARTITION BY name) ELSE 0 END AS BIGINT) AS n_points FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, part_idx) AS rn FROM alloc))"""


@query("w06_point_budget", f"WITH {DENSE}, {GEOM}, {MEASURES}, {_ALLOC} SELECT name, part_idx, n_points FROM budget")
def point_budget(spark, sf):
    measures = G.piece_measures(fx.vertices(spark, sf), fx.faces(spark, sf))
    return S.allocate_budget(measures, BUDGET).select(*PART, "n_points")


@query(
    "t06_face_area_intervals",
    f"WITH {DENSE}, {GEOM} SELECT name, part_idx, f_idx, {duck.rs(['sum(len/2) OVER w - len/2', 'sum(len/2) OVER w'], ('lo', 'hi'))} "
    "FROM geom WINDOW w AS (PARTITION BY name, part_idx ORDER BY f_idx)",
)
def face_area_intervals(spark, sf):
    # written once: the sums of the blocks and the running sums both read it
    areas = materialize(G.face_geometry(fx.vertices(spark, sf), fx.faces(spark, sf)).select(*PART, "f_idx", "area"), "areas")
    return S.cumulative_area(areas).select(
        *PART, "f_idx", *rounded([F.col("lo"), F.col("hi")], ("lo", "hi"))
    )


def _geometry(spark, sf):
    """Face geometry, written once: counts and draws both read it."""
    return materialize(G.face_geometry(fx.vertices(spark, sf), fx.faces(spark, sf)), "geometry")


def _counts(geometry, budget=500):
    return S.allocate_budget(G.measured(geometry), budget)


_SAMPLED = ("x", "y", "z", "nx", "ny", "nz")


def _sampled_sql(budget: str) -> str:
    """Draws on the faces of every piece, by whole-number weights."""
    draw = [duck.uniform(1116, f"'{stream}'", "name", "part_idx", "pt_idx") for stream in ("uniform", "uniform1", "uniform2")]
    corner = {c: (f"a{c}", f"b{'y_' if c == 'y' else c}", f"c{c}") for c in "xyz"}
    return f"""WITH {DENSE}, {GEOM}, {MEASURES}, {SHARED}, {_ALLOC.replace('5000', budget)},
    weighted AS (SELECT *, CAST(ceil(len/2 / max(len/2) OVER (PARTITION BY name, part_idx) * 4294967296) AS BIGINT) AS w FROM geom WHERE len > 0),
    spans AS (SELECT *, sum(w) OVER (PARTITION BY name, part_idx ORDER BY f_idx) - w AS lo, sum(w) OVER (PARTITION BY name, part_idx) AS total FROM weighted),
    asks AS (SELECT name, part_idx, unnest(range(0, n_points)) AS pt_idx FROM budget),
    draws AS (SELECT name, part_idx, pt_idx, CAST(least(floor({draw[0]} * total), total - 1) AS BIGINT) AS pos, {draw[1]} AS r1, {draw[2]} AS r2
      FROM asks JOIN (SELECT DISTINCT name, part_idx, CAST(total AS BIGINT) AS total FROM spans) USING (name, part_idx)),
    folded AS (SELECT name, part_idx, pt_idx, pos, CASE WHEN r1 + r2 > 1 THEN 1 - r1 ELSE r1 END AS s, CASE WHEN r1 + r2 > 1 THEN 1 - r2 ELSE r2 END AS t FROM draws),
    drawn AS (SELECT d.name, d.part_idx, d.pt_idx, f.f_idx,
      {', '.join(f'{a} + (({b} - {a}) * s + ({c_} - {a}) * t) AS {c}' for c, (a, b, c_) in corner.items())},
      ux/len AS nx, uy/len AS ny, uz/len AS nz
      FROM folded d ASOF JOIN spans f ON d.name = f.name AND d.part_idx = f.part_idx AND d.pos >= f.lo)"""


@query(
    "t06_uniform_surface_sampling",
    f"""{_sampled_sql('500')} SELECT name, part_idx, pt_idx, f_idx, {duck.rs(_SAMPLED, _SAMPLED)},
    CASE WHEN shared_with <> -1 THEN CAST(1 AS BIGINT) ELSE 0 END AS frac FROM drawn JOIN labelled USING (name, part_idx, f_idx)""",
)
def uniform_sampling(spark, sf):
    geometry = _geometry(spark, sf)
    drawn = S.sample_geometry(geometry, labelled(spark, sf), _counts(geometry))
    return drawn.select(*PART, "pt_idx", "f_idx", *rounded(map(F.col, _SAMPLED), _SAMPLED), "frac")


def _even(spark, sf):
    geometry = _geometry(spark, sf)
    return S.sample_geometry(geometry, labelled(spark, sf), _counts(geometry, 200), "poisson")


@query("t07_even_surface_sampling")
def even_sampling(spark, sf):
    return _even(spark, sf).select(*PART, "pt_idx", "f_idx", *_SAMPLED, "frac")


@query(
    "t07_even_sampling_invariants",
    f"""WITH {DENSE}, {GEOM}, {MEASURES}, {_ALLOC.replace('5000', '200')}
    SELECT name, part_idx, n_points AS n, true AS numbered, true AS spaced, true AS on_surface FROM budget""",
)
def even_invariants(spark, sf):
    """Per piece: as many points as wanted, thinned ones a radius apart, all on the plane of their face."""
    geometry = _geometry(spark, sf)
    counts = materialize(_counts(geometry, 200), "counts")
    weights = materialize(S.face_weights(geometry), "weights")
    even = S.spread_points(geometry, counts, weights=weights)
    points = S.sample_even(geometry, counts, weights=weights, spread=even).join(geometry.drop("area", "volume"), [*PART, "f_idx"])
    off = F.abs(sum(((F.col(c) - F.col(f"a{c}")) * F.col(f"fn{c}") for c in "xyz"), F.lit(0.0)))
    whole = points.groupBy(*PART).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_distinct("pt_idx") == F.max("pt_idx") + 1).alias("numbered"),
        (F.max(off) < 1e-9).alias("on_surface"),
    )
    close = S.close_pairs(even).select(*PART, F.lit(False).alias("spaced")).distinct()
    return whole.join(close, PART, "left").select(*PART, "n", "numbered", F.coalesce("spaced", F.lit(True)).alias("spaced"), "on_surface")


def _face_table(spark, sf, budget):
    """Faces with their corners and the wanted points of their piece, as the table function reads them."""
    geometry = _geometry(spark, sf)
    return geometry.join(_counts(geometry, budget).select(*PART, "n_points"), PART)


@query(
    "x01_table_function",
    f"{_sampled_sql('500')} SELECT name, part_idx, pt_idx, f_idx, {duck.rs(_SAMPLED, _SAMPLED)} FROM drawn",
)
def table_function(spark, sf):
    from ..functions.tables import register

    register(spark)
    _face_table(spark, sf, 500).createOrReplaceTempView("sherdloom_faces")
    drawn = spark.sql("SELECT * FROM sample_surface(TABLE(sherdloom_faces) PARTITION BY (name, part_idx), 'uniform', 1116)")
    return drawn.select(*PART, "pt_idx", "f_idx", *rounded(map(F.col, _SAMPLED), _SAMPLED))


@query(
    "x02_sample_strategies",
    f"""WITH {DENSE}, {GEOM}, {MEASURES}, {_ALLOC.replace('5000', '200')}
    SELECT strategy, name, part_idx, n_points AS n_equal FROM budget, (SELECT unnest(['uniform', 'poisson']) AS strategy) s""",
)
def sample_strategies(spark, sf):
    """Points that the table function and the DataFrame sampler have in common, for both strategies."""
    from ..functions.tables import STRATEGIES, register

    register(spark)
    geometry = _geometry(spark, sf)
    counts = materialize(_counts(geometry, 200), "counts")
    geometry.join(counts.select(*PART, "n_points"), PART).createOrReplaceTempView("sherdloom_faces")
    out = None
    for strategy in STRATEGIES:
        mine = S.SAMPLERS[strategy](geometry, counts)
        theirs = spark.sql(f"SELECT * FROM sample_surface(TABLE(sherdloom_faces) PARTITION BY (name, part_idx), '{strategy}', 1116)")
        key = [*PART, "pt_idx", "f_idx"]
        places = [f"cast(round({c}, 6) * 1000000 as long) AS {c}" for c in "xyz"]
        both = mine.selectExpr(*key, *places).join(theirs.selectExpr(*key, *places), [*key, *XYZ])
        part = both.groupBy(*PART).agg(F.count(F.lit(1)).alias("n_equal")).withColumn("strategy", F.lit(strategy))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "t06_points_per_part_counts",
    f"WITH {DENSE}, {GEOM}, {MEASURES}, {_ALLOC.replace('5000', '500')} SELECT name, part_idx, n_points AS n FROM budget",
)
def sampled_counts(spark, sf):
    return uniform_sampling(spark, sf).groupBy(*PART).agg(F.count("*").alias("n"))


# Every face is sampled once here, so the label and normal gathers can be checked.
def _one_per_face(spark, sf):
    return G.face_geometry(fx.vertices(spark, sf), fx.faces(spark, sf)).select(
        *PART, F.col("f_idx").alias("pt_idx"), "f_idx",
        F.col("fnx").alias("nx"), F.col("fny").alias("ny"), F.col("fnz").alias("nz"),
    )


@query(
    "p07_fracture_label_from_faces",
    f"WITH {DENSE}, {SHARED} SELECT name, part_idx, f_idx AS pt_idx, CASE WHEN shared_with <> -1 THEN CAST(1 AS BIGINT) ELSE 0 END AS frac FROM labelled",
)
def fracture_label(spark, sf):
    return S.label_points(_one_per_face(spark, sf), labelled(spark, sf)).select(*PART, "pt_idx", "frac")


@query("p09_missing_shared_faces", f"WITH {DENSE} SELECT name, part_idx, f_idx AS pt_idx, CAST(0 AS BIGINT) AS frac FROM faces")
def missing_shared_faces(spark, sf):
    return S.label_points(_one_per_face(spark, sf), fx.faces(spark, sf)).select(*PART, "pt_idx", "frac")


@query(
    "p08_face_normal_gather",
    f"WITH {DENSE}, {GEOM} SELECT name, part_idx, f_idx AS pt_idx, "
    + duck.rs([f"CASE WHEN len > 0 THEN {u}/len ELSE 0 END" for u in ("ux", "uy", "uz")], ("nx", "ny", "nz"))
    + " FROM geom",
)
def face_normal_gather(spark, sf):
    names = ("nx", "ny", "nz")
    return _one_per_face(spark, sf).select(*PART, "pt_idx", *rounded(map(F.col, names), names))
