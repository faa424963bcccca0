"""Voxel grids, space-filling curves, pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.curve import ORDERS, binary_to_gray, gray_to_binary, with_cell, with_code
from ..operators import curves as V
from ..operators.metrics import PART
from . import duck
from .poses import rounded
from .registry import query

SIZE = 0.1
DEPTH = 5  # a unit vector's coordinates span at most 2 / 0.1 = 20 cells
PT = [*PART, "pt_idx"]

GRID = duck.PTS + f""",
grid AS (SELECT name, part_idx, pt_idx, x, y, z, CAST(floor((x-lx)/{SIZE}) AS BIGINT) AS gx,
  CAST(floor((y-ly)/{SIZE}) AS BIGINT) AS gy, CAST(floor((z-lz)/{SIZE}) AS BIGINT) AS gz
  FROM pts, (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pts))"""


def grid(spark, sf):
    return V.with_grid(fx.points(spark, sf), SIZE)


def _z(x: str, y: str, z: str) -> str:
    return "(" + " + ".join(
        f"((({c} >> {i}) & 1) << {3*i+s})" for i in range(DEPTH) for c, s in ((x, 2), (y, 1), (z, 0))
    ) + ")"


def _hilbert_sql(src: str, x: str, y: str, z: str, out: str) -> str:
    """CTEs for the Hilbert index of (x, y, z): one step per bit and axis."""
    stages = [f"h0 AS (SELECT *, {x} AS a0, {y} AS a1, {z} AS a2 FROM {src})"]
    n = 0
    for bit in range(DEPTH - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in range(3):
            on = f"((a{axis} >> {bit}) & 1) = 1"
            flip = f"CASE WHEN {on} THEN {low} ELSE xor(a0, a{axis}) & {low} END"
            swap = f"CASE WHEN {on} THEN 0 ELSE xor(a0, a{axis}) & {low} END"
            new = {f"a{axis}": f"xor(a{axis}, {swap})"}
            new["a0"] = f"xor(a0, {flip})"
            rep = ", ".join(f"{e} AS {c}" for c, e in new.items())
            stages.append(f"h{n+1} AS (SELECT * REPLACE ({rep}) FROM h{n})")
            n += 1
    stages.append(f"hg0 AS (SELECT *, CAST({_z('a0', 'a1', 'a2')} AS BIGINT) AS g FROM h{n})")
    for i, s in enumerate((8, 4, 2, 1)):
        stages.append(f"hg{i+1} AS (SELECT * REPLACE (xor(g, g >> {s}) AS g) FROM hg{i})")
    stages.append(f"{out} AS (SELECT *, g AS code FROM hg4)")
    return ",\n".join(stages)


@query("m23_voxel_grid", f"WITH {GRID} SELECT name, part_idx, pt_idx, gx, gy, gz FROM grid")
def voxel_grid(spark, sf):
    return grid(spark, sf).select(*PT, *V.GRID)


@query(
    "m24_curve_depth",
    f"""WITH {GRID} SELECT name, CASE WHEN t > 0 THEN CAST(length(bin(t)) AS BIGINT) ELSE 0 END AS depth
    FROM (SELECT name, max(greatest(gx, gy, gz)) AS t FROM grid GROUP BY name)""",
)
def curve_depth(spark, sf):
    return V.depth_table(grid(spark, sf), ["name"])


@query("m25_z_order_code", f"WITH {GRID} SELECT name, part_idx, pt_idx, CAST({_z('gx', 'gy', 'gz')} AS BIGINT) AS code FROM grid")
def z_order(spark, sf):
    return with_code(grid(spark, sf), "z", DEPTH).select(*PT, "code")


@query("m25_z_order_decode", f"WITH {GRID} SELECT name, part_idx, pt_idx, gx, gy, gz, name AS batch FROM grid")
def z_order_decode(spark, sf):
    coded = with_code(grid(spark, sf), "z", DEPTH, batch="name").drop(*V.GRID)
    return with_cell(coded, "z", DEPTH).select(*PT, *V.GRID, "batch")


@query(
    "m26_hilbert_code",
    f"WITH {GRID}, {_hilbert_sql('grid', 'gx', 'gy', 'gz', 'coded')} SELECT name, part_idx, pt_idx, code FROM coded",
)
def hilbert(spark, sf):
    return with_code(grid(spark, sf), "hilbert", DEPTH).select(*PT, "code")


@query("m27_hilbert_decode", f"WITH {GRID} SELECT name, part_idx, pt_idx, gx, gy, gz, name AS batch FROM grid")
def hilbert_decode(spark, sf):
    coded = with_code(grid(spark, sf), "hilbert", DEPTH, batch="name").drop(*V.GRID)
    return with_cell(coded, "hilbert", DEPTH).select(*PT, *V.GRID, "batch")


@query(
    "m27_gray_code_round_trip",
    f"WITH {GRID} SELECT name, part_idx, pt_idx, CAST(xor(c, c >> 1) AS BIGINT) AS gray, c AS code FROM (SELECT *, CAST({_z('gx', 'gy', 'gz')} AS BIGINT) AS c FROM grid)",
)
def gray_round_trip(spark, sf):
    coded = with_code(grid(spark, sf), "z", DEPTH).withColumn("gray", binary_to_gray(F.col("code")))
    return coded.select(*PT, "gray", gray_to_binary(F.col("gray")).alias("code"))


_ORDERS_SQL = f"""
zs AS (SELECT 'z' AS axis_order, name, part_idx, pt_idx, CAST((name << {3*DEPTH}) + {_z('gx', 'gy', 'gz')} AS BIGINT) AS code FROM grid
  UNION ALL SELECT 'z-trans', name, part_idx, pt_idx, CAST((name << {3*DEPTH}) + {_z('gy', 'gx', 'gz')} AS BIGINT) FROM grid),
two AS (SELECT 'hilbert' AS axis_order, *, gx AS ux, gy AS uy FROM grid UNION ALL SELECT 'hilbert-trans', *, gy, gx FROM grid),
{_hilbert_sql('two', 'ux', 'uy', 'gz', 'coded')}"""


@query(
    "m28_batched_curve_codes",
    f"WITH {GRID}, {_ORDERS_SQL} SELECT * FROM zs UNION ALL SELECT axis_order, name, part_idx, pt_idx, CAST((name << {3*DEPTH}) + code AS BIGINT) FROM coded",
)
def batched_codes(spark, sf):
    g = grid(spark, sf)
    out = None
    for o in ORDERS:
        one = with_code(g, o, DEPTH, batch="name").select(F.lit(o).alias("axis_order"), *PT, "code")
        out = one if out is None else out.unionByName(one)
    return out


@query("m29_sparse_voxels", f"WITH {GRID} SELECT DISTINCT name AS batch, gx, gy, gz FROM grid")
def sparse_voxels(spark, sf):
    return V.sparse_voxels(grid(spark, sf))


@query("m29_sparse_shape", f"WITH {GRID} SELECT max(gx)+96 AS sx, max(gy)+96 AS sy, max(gz)+96 AS sz FROM grid")
def sparse_shape(spark, sf):
    return V.sparse_shape(grid(spark, sf))


_CODED = f"{GRID}, coded AS (SELECT *, CAST({_z('gx', 'gy', 'gz')} AS BIGINT) AS code FROM grid)"


@query(
    "w03_serialized_order",
    f"WITH {_CODED} SELECT name, part_idx, pt_idx, code, CAST(row_number() OVER (PARTITION BY name ORDER BY code, part_idx, pt_idx) - 1 AS BIGINT) AS rank FROM coded",
)
def serialized_order(spark, sf):
    return V.serialize(grid(spark, sf), DEPTH, "z", ["name"]).select(*PT, "code", "rank")


@query(
    "w04_curve_tiles",
    f"WITH {_CODED} SELECT name, part_idx, pt_idx, CAST((row_number() OVER (PARTITION BY name, part_idx ORDER BY code, pt_idx) - 1) // 4 AS BIGINT) AS tile FROM coded",
)
def curve_tiles(spark, sf):
    return V.tiles(grid(spark, sf), DEPTH, 4).select(*PT, "tile")


@query("t04_curve_clustered_layout", f"WITH {_CODED} SELECT name, part_idx, pt_idx, code FROM coded")
def clustered_layout(spark, sf):
    return V.clustered(grid(spark, sf), DEPTH).select(*PT, "code")


_CURVE_KEY = duck.key(1116, "o", "name")


@query(
    "t09_random_curve_order",
    f"""WITH {duck.PTS} SELECT name, string_agg(o, ',' ORDER BY {_CURVE_KEY}, o) AS orders
    FROM (SELECT DISTINCT name FROM pts), (SELECT unnest([{', '.join(f"'{o}'" for o in ORDERS)}]) AS o) g GROUP BY name""",
)
def random_curve_order(spark, sf):
    return V.order_permutation(fx.points(spark, sf), ORDERS).select(
        "name", F.array_join("orders", ",").alias("orders")
    )


@query(
    "u04_distinct_voxel_codes",
    f"WITH {_CODED} SELECT code, count(*) AS n, CAST(row_number() OVER (ORDER BY code) - 1 AS BIGINT) AS cluster FROM coded GROUP BY code",
)
def distinct_codes(spark, sf):
    return V.voxel_counts(with_code(grid(spark, sf), "z", DEPTH).select("code"))


_FEATS = ("nx", "ny", "nz")
_POOLED = f"""{duck.PTS + GRID[len(duck.PTS):]},
coded AS (SELECT *, CAST({_z('gx', 'gy', 'gz')} AS BIGINT) AS code FROM grid JOIN (SELECT name, part_idx, pt_idx, nx, ny, nz FROM pts) USING (name, part_idx, pt_idx)),
pooled AS (SELECT name, code >> 3 AS cluster, {{folds}}, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n,
  arg_min(gx, part_idx*1000+pt_idx) >> 1 AS gx, arg_min(gy, part_idx*1000+pt_idx) >> 1 AS gy, arg_min(gz, part_idx*1000+pt_idx) >> 1 AS gz,
  min(part_idx*1000+pt_idx) // 1000 AS head_part_idx, min(part_idx*1000+pt_idx) % 1000 AS head_pt_idx FROM coded GROUP BY name, code >> 3)"""


def _pool_sql(fold: str) -> str:
    return _POOLED.replace("{folds}", ", ".join(f"{fold}({c}) AS f_{c}" for c in _FEATS))


def _pool(spark, sf, reduce):
    coded = with_code(grid(spark, sf), "z", DEPTH)
    return coded, V.voxel_pool(coded, 1, list(_FEATS), reduce)


def _register_pool(reduce: str, fold: str):
    names = ("f_nx", "f_ny", "f_nz", "x", "y", "z")

    @query(
        f"a19_voxel_pool_{reduce}",
        f"WITH {_pool_sql(fold)} SELECT name, cluster, n, gx, gy, gz, {duck.rs(names, names)} FROM pooled",
    )
    def pool(spark, sf):
        return _pool(spark, sf, reduce)[1].select(
            "name", "cluster", "n", *V.GRID, *rounded(map(F.col, names), names)
        )


for _reduce, _fold in (("max", "max"), ("min", "min"), ("mean", "avg"), ("sum", "sum")):
    _register_pool(_reduce, _fold)


@query(
    "w11_voxel_head_row",
    f"WITH {_pool_sql('max')} SELECT name, cluster, CAST(head_part_idx AS BIGINT) AS head_part_idx, CAST(head_pt_idx AS BIGINT) AS head_pt_idx FROM pooled",
)
def voxel_head(spark, sf):
    return _pool(spark, sf, "max")[1].select("name", "cluster", "head_part_idx", "head_pt_idx")


@query(
    "j13_voxel_unpool",
    f"WITH {_pool_sql('max')} SELECT c.name, c.part_idx, c.pt_idx, {duck.rs(['c.nx+f_nx', 'c.ny+f_ny', 'c.nz+f_nz'], ('ux', 'uy', 'uz'))} "
    "FROM coded c JOIN pooled p ON p.name = c.name AND p.cluster = c.code >> 3",
)
def voxel_unpool(spark, sf):
    coded, pooled = _pool(spark, sf, "max")
    out = V.voxel_unpool(coded, pooled, 1, list(_FEATS))
    return out.select(*PT, *rounded([F.col(f"u_{c}") for c in _FEATS], ("ux", "uy", "uz")))
