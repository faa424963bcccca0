"""Rotation and rigid-pose functions over the pose table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import rot
from ..operators.metrics import gt_q, gt_t, PART, pr_q, pr_t
from . import duck
from .registry import query



def pt():
    return rot.cols("x", "y", "z")


GQ, PQ = duck.q4("gt_q"), duck.q4("pr_q")
GT, PT_ = duck.v3("gt_t"), duck.v3("pr_t")
_JOIN = "FROM pts JOIN pose USING (name, part_idx)"


def rounded(values, names, digits: int = 6):
    return [(F.round(v, digits) + 0.0).alias(n) for v, n in zip(values, names)]


def _matrix_names(prefix="r"):
    return [f"{prefix}{i}{j}" for i in range(3) for j in range(3)]


_RM = duck.matvec(duck.mat(GQ), ("x", "y", "z"))


@query(
    "m02_rotate_points",
    f"WITH {duck.PTS_POSE} SELECT name, part_idx, pt_idx, {duck.rs(_RM, ('rx', 'ry', 'rz'))} {_JOIN}",
)
def rotate_points(spark, sf):
    df = fx.points(spark, sf).join(fx.poses(spark, sf), PART)
    return df.select(*PART, "pt_idx", *rounded(rot.rotate(gt_q(), pt()), ("rx", "ry", "rz")))


@query(
    "m03_transform_points",
    f"WITH {duck.PTS_POSE} SELECT name, part_idx, pt_idx, "
    + duck.rs([f"{a}+{b}" for a, b in zip(duck.matvec(duck.mat(PQ), ("x", "y", "z")), PT_)], ("wx", "wy", "wz"))
    + f" {_JOIN}",
)
def transform_points(spark, sf):
    df = fx.points(spark, sf).join(fx.poses(spark, sf), PART)
    return df.select(*PART, "pt_idx", *rounded(rot.transform(pr_t(), pr_q(), pt()), ("wx", "wy", "wz")))


@query(
    "m04_quaternion_to_matrix",
    f"WITH {duck.POSE} SELECT name, part_idx, {duck.rs(duck.mat([f'(3*{c})' for c in GQ]), _matrix_names())} FROM pose",
)
def quaternion_to_matrix(spark, sf):
    scaled = rot.scale(gt_q(), F.lit(3.0))  # not unit length on purpose
    return fx.poses(spark, sf).select(*PART, *rounded(rot.to_matrix(scaled), _matrix_names()))


def _euler_sql(q):
    m = duck.mat(q)
    return [f"degrees(atan2(-{m[5]}, {m[8]}))", f"degrees(asin(least(1, greatest(-1, {m[2]}))))",
            f"degrees(atan2(-{m[1]}, {m[0]}))"]


@query(
    "m05_euler_xyz",
    f"WITH {duck.POSE} SELECT name, part_idx, {duck.rs(_euler_sql(PQ), ('ex', 'ey', 'ez'))} FROM pose",
)
def euler_xyz(spark, sf):
    return fx.poses(spark, sf).select(*PART, *rounded(rot.euler_xyz(pr_q()), ("ex", "ey", "ez")))


def _orders_sql() -> str:
    # The six orders from matrix entries of the unit quaternion, in each order's own
    # Tait-Bryan form.
    m = duck.mat(GQ)
    e = {f"{i}{j}": m[3 * i + j] for i in range(3) for j in range(3)}

    def a(s):
        return f"degrees(asin(least(1, greatest(-1, {s}))))"

    def t(y, x):
        return f"degrees(atan2({y}, {x}))"

    rows = {
        "xyz": (t("-" + e["12"], e["22"]), a(e["02"]), t("-" + e["01"], e["00"])),
        "yzx": (t("-" + e["12"], e["11"]), t("-" + e["20"], e["00"]), a(e["10"])),
        "zxy": (a(e["21"]), t("-" + e["20"], e["22"]), t("-" + e["01"], e["11"])),
        "xzy": (t(e["21"], e["11"]), t(e["02"], e["00"]), a("-" + e["01"])),
        "yxz": (a("-" + e["12"]), t(e["02"], e["22"]), t(e["10"], e["11"])),
        "zyx": (t(e["21"], e["22"]), a("-" + e["20"]), t(e["10"], e["00"])),
    }
    return " UNION ALL ".join(
        f"SELECT name, part_idx, '{o}' AS axis_order, {duck.rs(v, ('ex', 'ey', 'ez'))} FROM pose"
        for o, v in rows.items()
    )


@query("m06_euler_all_orders", f"WITH {duck.POSE} {_orders_sql()}")
def euler_all_orders(spark, sf):
    df = fx.poses(spark, sf)
    orders = ("xyz", "yzx", "zxy", "xzy", "yxz", "zyx")
    per_order = [
        F.struct(F.lit(o).alias("axis_order"), *rounded(rot.euler(gt_q(), o), ("ex", "ey", "ez")))
        for o in orders
    ]
    return df.select(*PART, F.inline(F.array(*per_order)))


@query(
    "m07_quaternion_reorder_inverse",
    f"WITH {duck.POSE} SELECT name, part_idx, "
    + duck.rs([GQ[1], GQ[2], GQ[3], GQ[0]], ("s0", "s1", "s2", "s3")) + ", "
    + duck.rs([GQ[0], f"-{GQ[1]}", f"-{GQ[2]}", f"-{GQ[3]}"], ("iw", "ix", "iy", "iz")) + " FROM pose",
)
def quaternion_reorder(spark, sf):
    last = rot.wxyz_to_xyzw(gt_q())
    inverse = rot.conjugate(rot.xyzw_to_wxyz(last))
    return fx.poses(spark, sf).select(
        *PART, *rounded(last, ("s0", "s1", "s2", "s3")), *rounded(inverse, ("iw", "ix", "iy", "iz"))
    )


_ALIGN = f"""align AS (
  SELECT *, {", ".join(f"{e} AS {n}" for e, n in zip(
      duck.hamilton(GQ, (PQ[0], f'(-{PQ[1]})', f'(-{PQ[2]})', f'(-{PQ[3]})')), ('hw', 'hx', 'hy', 'hz')))}
  FROM pose)"""
_AQ = ("hw", "hx", "hy", "hz")
_AT = [f"({g} - {m})" for g, m in zip(GT, duck.matvec(duck.mat(_AQ), PT_))]


@query(
    "m08_anchor_alignment",
    f"WITH {duck.POSE}, {_ALIGN} SELECT name, part_idx, "
    + duck.rs(duck.signed(_AQ, "hw"), ("aw", "ax", "ay", "az")) + ", "
    + duck.rs(_AT, ("atx", "aty", "atz")) + " FROM align",
)
def anchor_alignment(spark, sf):
    t, q = rot.anchor_alignment(gt_t(), gt_q(), pr_t(), pr_q())
    return fx.poses(spark, sf).select(
        *PART, *rounded(q, ("aw", "ax", "ay", "az")), *rounded(t, ("atx", "aty", "atz"))
    )


# log of the rotation through its matrix: angle from the trace, axis from the
# antisymmetric part.
_M = duck.mat(GQ)
_TH = f"acos(least(1, greatest(-1, ({_M[0]}+{_M[4]}+{_M[8]}-1)/2)))"
_LOG = [f"(th/(2*sin(th)))*({a}-{b})" for a, b in ((_M[7], _M[5]), (_M[2], _M[6]), (_M[3], _M[1]))]
_LOG_SQL = f"logs AS (SELECT *, {', '.join(f'{e} AS {n}' for e, n in zip(_LOG, ('lx', 'ly', 'lz')))} FROM (SELECT *, {_TH} AS th FROM pose))"


@query(
    "m09_axis_angle_conversions",
    f"WITH {duck.POSE}, {_LOG_SQL} SELECT name, part_idx, {duck.rs(('lx', 'ly', 'lz'), ('lx', 'ly', 'lz'))}, "
    + duck.rs(duck.signed(GQ, GQ[0]), ("bw", "bx", "by", "bz")) + ", "
    + duck.rs(_M, _matrix_names()) + " FROM logs",
)
def axis_angle_conversions(spark, sf):
    """quaternion -> axis-angle -> quaternion -> matrix -> quaternion."""
    df = rot.with_tuple(fx.poses(spark, sf), ("lx", "ly", "lz"), rot.log_map(gt_q()))
    df = rot.with_tuple(df, ("ew", "ex", "ey", "ez"), rot.exp_map(rot.cols("lx", "ly", "lz")))
    df = rot.with_tuple(df, _matrix_names(), rot.to_matrix(rot.cols("ew", "ex", "ey", "ez")))
    back = rot.matrix_to_quaternion(rot.cols(*_matrix_names()))
    return df.select(
        *PART, *rounded(rot.cols("lx", "ly", "lz"), ("lx", "ly", "lz")),
        *rounded(back, ("bw", "bx", "by", "bz")),
        *rounded(rot.cols(*_matrix_names()), _matrix_names()),
    )


# exp of half the log is the rotation half way: same axis, half the angle.
_HALF = ["cos(th/4)"] + [f"sin(th/4)/th*{c}" for c in ("lx", "ly", "lz")]


@query(
    "m10_log_exp_maps",
    f"WITH {duck.POSE}, {_LOG_SQL} SELECT name, part_idx, {duck.r('th', 'angle')}, "
    + duck.rs(_HALF, ("hw", "hx", "hy", "hz")) + " FROM logs",
)
def log_exp_maps(spark, sf):
    df = rot.with_tuple(fx.poses(spark, sf), ("lx", "ly", "lz"), rot.log_map(gt_q()))
    w = rot.cols("lx", "ly", "lz")
    return df.select(
        *PART, *rounded([rot.norm(w)], ["angle"]),
        *rounded(rot.exp_map(rot.scale(w, F.lit(0.5))), ("hw", "hx", "hy", "hz")),
    )


@query(
    "m11_rotation_6d",
    f"WITH {duck.POSE} SELECT name, part_idx, {duck.rs(duck.mat(PQ)[:6], [f'd{i}' for i in range(6)])} FROM pose",
)
def rotation_6d(spark, sf):
    return fx.poses(spark, sf).select(
        *PART, *rounded(rot.rotation_6d(pr_q()), [f"d{i}" for i in range(6)])
    )


_REL_Q = duck.hamilton(PQ, (GQ[0], f"(-{GQ[1]})", f"(-{GQ[2]})", f"(-{GQ[3]})"))
_REL = f"rel AS (SELECT *, {', '.join(f'{e} AS {n}' for e, n in zip(_REL_Q, _AQ))} FROM pose)"


@query(
    "m12_reassembly_transform",
    f"WITH {duck.POSE}, {_REL} SELECT name, part_idx, {duck.rs(duck.mat(_AQ), _matrix_names())}, "
    + duck.rs([f"{p}-{m}" for p, m in zip(PT_, duck.matvec(duck.mat(_AQ), GT))], ("tx", "ty", "tz")) + " FROM rel",
)
def reassembly_transform(spark, sf):
    t, r = rot.relative_pose(gt_t(), gt_q(), pr_t(), pr_q())
    return fx.poses(spark, sf).select(
        *PART, *rounded(r, _matrix_names()), *rounded(t, ("tx", "ty", "tz"))
    )


@query(
    "m12_pose_matrix",
    f"WITH {duck.POSE} SELECT name, part_idx, "
    + duck.rs(
        [*duck.mat(GQ)[0:3], GT[0], *duck.mat(GQ)[3:6], GT[1], *duck.mat(GQ)[6:9], GT[2], "0.0", "0.0", "0.0", "1.0"],
        [f"m{i}{j}" for i in range(4) for j in range(4)],
    ) + " FROM pose",
)
def pose_matrix(spark, sf):
    names = [f"m{i}{j}" for i in range(4) for j in range(4)]
    return fx.poses(spark, sf).select(*PART, *rounded(rot.pose_matrix(gt_t(), gt_q()), names))


_REF = """anchor AS (SELECT name, gt_tx AS agx, gt_ty AS agy, gt_tz AS agz,
  pr_tx AS apx, pr_ty AS apy, pr_tz AS apz, {q} FROM pose WHERE part_idx = 0)"""
_REF = _REF.format(q=", ".join(
    f"{e} AS {n}" for e, n in zip(duck.hamilton(GQ, (PQ[0], f"(-{PQ[1]})", f"(-{PQ[2]})", f"(-{PQ[3]})")), _AQ)))
_ALQ = duck.hamilton(_AQ, PQ)
_ALT = [
    f"({m} + {g} - {n})" for m, g, n in zip(
        duck.matvec(duck.mat(_AQ), PT_), ("agx", "agy", "agz"),
        duck.matvec(duck.mat(_AQ), ("apx", "apy", "apz")))
]


@query(
    "j15_reference_alignment",
    f"""WITH {duck.POSE}, {_REF},
    al AS (SELECT name, part_idx, {', '.join(f'{e} AS {n}' for e, n in zip(_ALQ, ('lw', 'lx', 'ly', 'lz')))},
           {', '.join(f'{e} AS {n}' for e, n in zip(_ALT, ('ltx', 'lty', 'ltz')))} FROM pose JOIN anchor USING (name))
    SELECT name, part_idx, {duck.rs(('ltx', 'lty', 'ltz'), ('tx', 'ty', 'tz'))},
    {duck.rs(duck.signed(('lw', 'lx', 'ly', 'lz'), 'lw'), ('qw', 'qx', 'qy', 'qz'))} FROM al""",
)
def reference_alignment(spark, sf):
    from ..operators.poses import align_to_reference

    poses = fx.poses(spark, sf).withColumn("is_ref", F.col("part_idx") == 0)
    return align_to_reference(poses).select(
        *PART, *rounded(pr_t(), ("tx", "ty", "tz")), *rounded(pr_q(), ("qw", "qx", "qy", "qz"))
    )
