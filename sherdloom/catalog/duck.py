"""DuckDB text of the fixture views and small SQL builders for the oracles."""

from __future__ import annotations

from ..functions.rand import PRIME, ROUND_FACTORS

VEC = """vec AS (
  SELECT vec_id, CAST(floor(sqrt(CAST(vec_id AS DOUBLE))) AS BIGINT) AS name,
         vec_id - CAST(floor(sqrt(CAST(vec_id AS DOUBLE))) AS BIGINT)
                * CAST(floor(sqrt(CAST(vec_id AS DOUBLE))) AS BIGINT) AS part_idx,
         CAST(embedding AS DOUBLE[]) AS e
  FROM embeddings)"""

_PTS_BODY = """
  SELECT name, part_idx, pt_idx, x, y, z, ax/an AS nx, ay/an AS ny, az/an AS nz,
         CASE WHEN z > 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS frac
  FROM (SELECT *, sqrt(ax*ax + ay*ay + az*az) AS an FROM (
    SELECT name, part_idx, i AS pt_idx, e[3*i+1] AS x, e[3*i+2] AS y, e[3*i+3] AS z,
           e[3*((i+1)%21)+1] AS ax, e[3*((i+1)%21)+2] AS ay, e[3*((i+1)%21)+3] AS az
    FROM vec, (SELECT unnest(range(0, 21)) AS i) g {where}))"""

PTS = VEC + ",\npts AS (" + _PTS_BODY.format(where="WHERE i < 5 + vec_id % 17") + ")"
PTS_FIXED = VEC + ",\npts AS (" + _PTS_BODY.format(where="") + ")"

POSE_BODY = """pose AS (
  SELECT name, part_idx, e[1] AS gt_tx, e[2] AS gt_ty, e[3] AS gt_tz,
    e[4]/ng AS gt_qw, e[5]/ng AS gt_qx, e[6]/ng AS gt_qy, e[7]/ng AS gt_qz,
    e[1]+0.1*e[8] AS pr_tx, e[2]+0.1*e[9] AS pr_ty, e[3]+0.1*e[10] AS pr_tz,
    pw/np AS pr_qw, px/np AS pr_qx, py/np AS pr_qy, pz/np AS pr_qz
  FROM (SELECT *, sqrt(e[4]*e[4]+e[5]*e[5]+e[6]*e[6]+e[7]*e[7]) AS ng,
               sqrt(pw*pw+px*px+py*py+pz*pz) AS np
        FROM (SELECT *, e[4]+0.2*e[11] AS pw, e[5]+0.2*e[12] AS px,
                     e[6]+0.2*e[13] AS py, e[7]+0.2*e[14] AS pz FROM vec)))"""
POSE = VEC + ",\n" + POSE_BODY
PTS_POSE = PTS + ",\n" + POSE_BODY

SEG = PTS + """,
seg AS (SELECT name, part_idx, pt_idx, frac AS gt, 8*z+4*x AS logit,
               1/(1+exp(-(8*z+4*x))) AS score FROM pts)"""


def mesh(orders: int) -> str:
    return f"""verts AS MATERIALIZED (
  SELECT name, part_idx, row_number() OVER (PARTITION BY name, part_idx
           ORDER BY l_orderkey, l_partkey, l_suppkey, l_quantity, l_discount, l_tax) - 1 AS v_idx, x, y, z
  FROM (SELECT *, CAST(floor(l_orderkey / {orders}.0) AS BIGINT) AS name,
               CAST(l_linenumber - 1 AS BIGINT) AS part_idx,
               CAST(CAST(floor(l_quantity) AS INT) % 10 AS DOUBLE) AS x,
               CAST(CAST(round(l_discount*100) AS INT) % 6 AS DOUBLE) AS y,
               CAST(CAST(round(l_tax*100) AS INT) % 3 AS DOUBLE) AS z FROM lineitem)),
faces AS MATERIALIZED (
  SELECT name, part_idx, v_idx AS f_idx, v_idx AS a, v_idx+1 AS b, v_idx+2 AS c
  FROM (SELECT *, count(*) OVER (PARTITION BY name, part_idx) AS nv FROM verts) WHERE v_idx <= nv-3)"""


SPLITS = """splits AS (SELECT o_orderpriority AS category, o_orderstatus AS split,
  CAST(o_orderkey AS VARCHAR) AS name FROM orders)"""
PARTS = """parts AS (SELECT DISTINCT l_orderkey AS name, CAST(l_linenumber AS BIGINT) AS part_idx FROM lineitem)"""


def r(expr: str, name: str, digits: int = 6) -> str:
    """Rounded output column; adding 0.0 folds negative zero."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def rs(exprs, names, digits: int = 6) -> str:
    return ", ".join(r(e, n, digits) for e, n in zip(exprs, names))


def q4(prefix: str) -> tuple[str, ...]:
    return tuple(f"{prefix}{c}" for c in "wxyz")


def v3(prefix: str) -> tuple[str, ...]:
    return tuple(f"{prefix}{c}" for c in "xyz")


def mat(q) -> list[str]:
    """Row-major rotation matrix of a quaternion, as SQL text."""
    w, x, y, z = q
    s = f"(2.0/({w}*{w}+{x}*{x}+{y}*{y}+{z}*{z}))"
    return [
        f"(1-{s}*({y}*{y}+{z}*{z}))", f"({s}*({x}*{y}-{z}*{w}))", f"({s}*({x}*{z}+{y}*{w}))",
        f"({s}*({x}*{y}+{z}*{w}))", f"(1-{s}*({x}*{x}+{z}*{z}))", f"({s}*({y}*{z}-{x}*{w}))",
        f"({s}*({x}*{z}-{y}*{w}))", f"({s}*({y}*{z}+{x}*{w}))", f"(1-{s}*({x}*{x}+{y}*{y}))",
    ]


def matvec(m, v) -> list[str]:
    return [f"({m[3*i]}*{v[0]}+{m[3*i+1]}*{v[1]}+{m[3*i+2]}*{v[2]})" for i in range(3)]


def hamilton(a, b) -> list[str]:
    """Quaternion product as SQL text."""
    (aw, ax, ay, az), (bw, bx, by, bz) = a, b
    return [
        f"({aw}*{bw}-{ax}*{bx}-{ay}*{by}-{az}*{bz})",
        f"({aw}*{bx}+{ax}*{bw}+{ay}*{bz}-{az}*{by})",
        f"({aw}*{by}-{ax}*{bz}+{ay}*{bw}+{az}*{bx})",
        f"({aw}*{bz}+{ax}*{by}-{ay}*{bx}+{az}*{bw})",
    ]


def signed(q, w: str) -> list[str]:
    return [f"(CASE WHEN {w} < 0 THEN -({c}) ELSE {c} END)" for c in q]


def key(*parts) -> str:
    """60-bit digest of the seed and the keys; text parts come quoted."""
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(map(str, parts))})), 1, 15) AS BIGINT)"


def uniform(*parts) -> str:
    return f"(CAST({key(*parts)} >> 7 AS DOUBLE) / 9007199254740992)"


def normal(seed, *parts) -> str:
    u1, u2 = uniform(seed, "'n1'", *parts), uniform(seed, "'n2'", *parts)
    return f"(sqrt(-2 * ln(1 - {u1})) * cos(2 * pi() * {u2}))"


def quaternion(seed, *parts) -> list[str]:
    u1, u2, u3 = (uniform(seed, f"'q{i}'", *parts) for i in range(3))
    a, b = f"sqrt(1 - {u1})", f"sqrt({u1})"
    s, c = f"(2 * pi() * {u2})", f"(2 * pi() * {u3})"
    return [f"({b} * cos({c}))", f"({a} * sin({s}))", f"({a} * cos({s}))", f"({b} * sin({c}))"]


def shuffled(position: str, n: str, key: str) -> str:
    """Where a position of [0, n) goes under the keyed swap-or-not permutation."""
    turn = f"((({key}) % {PRIME} * f + (({key}) >> 29) % {PRIME}) % {PRIME})"
    mirror = f"(({turn} % {n} + {n} - x) % {n})"
    coin = f"(((greatest(x, {mirror}) + 1) * ({turn} * 48271 % {PRIME} + 1) % {PRIME}) >> 11) % 2"
    rounds = "[" + ", ".join(f"{f}::BIGINT" for f in ROUND_FACTORS) + "]"
    return f"list_reduce({rounds}, lambda x, f: CASE WHEN {coin} = 1 THEN {mirror} ELSE x END, CAST({position} AS BIGINT))"
