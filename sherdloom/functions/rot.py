"""Rotation and rigid-pose algebra on plain double columns.

Quaternions are scalar first.  A quaternion is a 4-tuple of columns, a vector a
3-tuple, a matrix a row-major 9-tuple; nothing here needs a UDF, so a pose
expression stays inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

Vec = Sequence[Column]

_SMALL_ANGLE = 1e-6


def cols(*names: str) -> tuple[Column, ...]:
    return tuple(F.col(n) for n in names)


def dot(a: Vec, b: Vec) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        total = total + x * y
    return total


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Vec, b: Vec) -> tuple[Column, ...]:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def sub(a: Vec, b: Vec) -> tuple[Column, ...]:
    return tuple(x - y for x, y in zip(a, b))


def add(a: Vec, b: Vec) -> tuple[Column, ...]:
    return tuple(x + y for x, y in zip(a, b))


def scale(a: Vec, s) -> tuple[Column, ...]:
    return tuple(x * s for x in a)


def conjugate(q: Vec) -> tuple[Column, ...]:
    return q[0], -q[1], -q[2], -q[3]


def raw_multiply(a: Vec, b: Vec) -> tuple[Column, ...]:
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return (
        aw * bw - ax * bx - ay * by - az * bz,
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
    )


def standardize(q: Vec) -> tuple[Column, ...]:
    """The representative with a non-negative real part."""
    return tuple(F.when(q[0] < 0, -c).otherwise(c) for c in q)


def multiply(a: Vec, b: Vec) -> tuple[Column, ...]:
    return standardize(raw_multiply(a, b))


def normalize(q: Vec) -> tuple[Column, ...]:
    n = norm(q)
    return tuple(c / n for c in q)


def rotate(q: Vec, v: Vec) -> tuple[Column, ...]:
    """Vector part of q (0, v) conj(q).  A non-unit q also scales by |q|^2."""
    w, u = q[0], q[1:]
    keep = w * w - dot(u, u)
    along = F.lit(2.0) * dot(u, v)
    turn = cross(u, v)
    return tuple(
        keep * v[i] + along * u[i] + F.lit(2.0) * w * turn[i] for i in range(3)
    )


def transform(t: Vec, q: Vec, v: Vec) -> tuple[Column, ...]:
    return add(rotate(q, v), t)


def to_matrix(q: Vec) -> tuple[Column, ...]:
    """Row-major rotation matrix; dividing by |q|^2 normalises on the way."""
    w, x, y, z = q
    s = F.lit(2.0) / dot(q, q)
    one = F.lit(1.0)
    return (
        one - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w),
        s * (x * y + z * w), one - s * (x * x + z * z), s * (y * z - x * w),
        s * (x * z - y * w), s * (y * z + x * w), one - s * (x * x + y * y),
    )


def matrix_vector(m: Vec, v: Vec) -> tuple[Column, ...]:
    return tuple(dot(m[3 * i : 3 * i + 3], v) for i in range(3))


def matrix_multiply(a: Vec, b: Vec) -> tuple[Column, ...]:
    return tuple(
        dot(a[3 * i : 3 * i + 3], (b[j], b[3 + j], b[6 + j]))
        for i in range(3)
        for j in range(3)
    )


def transpose(m: Vec) -> tuple[Column, ...]:
    return tuple(m[3 * j + i] for i in range(3) for j in range(3))


def matrix_to_quaternion(m: Vec) -> tuple[Column, ...]:
    """Standardised quaternion of a rotation matrix.

    Divides by the largest of the four components so the division is never near
    zero, which keeps half turns accurate.
    """
    m00, m01, m02, m10, m11, m12, m20, m21, m22 = m
    sizes = (
        1.0 + m00 + m11 + m22,
        1.0 + m00 - m11 - m22,
        1.0 - m00 + m11 - m22,
        1.0 - m00 - m11 + m22,
    )
    rows = (
        (sizes[0], m21 - m12, m02 - m20, m10 - m01),
        (m21 - m12, sizes[1], m10 + m01, m02 + m20),
        (m02 - m20, m10 + m01, sizes[2], m12 + m21),
        (m10 - m01, m02 + m20, m12 + m21, sizes[3]),
    )
    top = F.greatest(*sizes)
    half = F.lit(2.0) * F.sqrt(top)
    picked = []
    for k in range(4):
        pick = F.when(sizes[0] == top, rows[0][k])
        for r in range(1, 4):
            pick = pick.when(sizes[r] == top, rows[r][k])
        picked.append(pick / half)
    return standardize(tuple(picked))


def log_map(q: Vec) -> tuple[Column, ...]:
    """Axis-angle vector of a rotation, angle in [0, pi].  q must be unit length."""
    w, x, y, z = standardize(q)
    n = norm((x, y, z))
    half = F.atan2(n, w)
    factor = F.when(
        half * 2.0 < _SMALL_ANGLE, F.lit(2.0) + half * half / 3.0
    ).otherwise(half * 2.0 / n)
    return x * factor, y * factor, z * factor


def exp_map(w: Vec) -> tuple[Column, ...]:
    """Standardised unit quaternion of an axis-angle vector."""
    angle = norm(w)
    half = angle * 0.5
    s = F.when(angle < _SMALL_ANGLE, F.lit(0.5) - angle * angle / 48.0).otherwise(
        F.sin(half) / angle
    )
    return standardize((F.cos(half), w[0] * s, w[1] * s, w[2] * s))


def euler_xyz(q: Vec, degrees: bool = True) -> tuple[Column, ...]:
    """Intrinsic XYZ angles; the sine is clamped so rounding cannot give NaN."""
    m = to_matrix(q)
    angles = (
        F.atan2(-m[5], m[8]),
        F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), m[2]))),
        F.atan2(-m[1], m[0]),
    )
    return tuple(F.degrees(a) for a in angles) if degrees else angles


def euler(q: Vec, order: str = "xyz", epsilon: float = 0.0, degrees: bool = True):
    """Angles about x, y and z for any of the six axis orders, without normalising.

    One rule covers the orders.  With the order written (i, j, k) and ``p`` its
    parity (+1 for a cyclic order, -1 otherwise), the middle angle is an arcsine
    and the outer two are arctangents of the same quadratic forms in q.
    """
    axes = ["xyz".index(c) for c in order]
    if sorted(axes) != [0, 1, 2]:
        raise ValueError(f"unknown axis order {order!r}")
    i, j, k = axes
    p = 1.0 if (j - i) % 3 == 1 else -1.0
    w, v = q[0], q[1:]
    bound = 1.0 - epsilon
    middle = F.lit(2.0) * (w * v[j] + v[i] * v[k] * p)
    out: list = [None, None, None]
    out[j] = F.asin(F.greatest(F.lit(-bound), F.least(F.lit(bound), middle)))
    out[i] = F.atan2(
        F.lit(2.0) * (w * v[i] - v[j] * v[k] * p),
        F.lit(1.0) - F.lit(2.0) * (v[i] * v[i] + v[j] * v[j]),
    )
    out[k] = F.atan2(
        F.lit(2.0) * (w * v[k] - v[i] * v[j] * p),
        F.lit(1.0) - F.lit(2.0) * (v[j] * v[j] + v[k] * v[k]),
    )
    return tuple(F.degrees(a) for a in out) if degrees else tuple(out)


def rotation_6d(q: Vec) -> tuple[Column, ...]:
    return to_matrix(q)[:6]


def xyzw_to_wxyz(q: Vec) -> tuple[Column, ...]:
    return q[3], q[0], q[1], q[2]


def wxyz_to_xyzw(q: Vec) -> tuple[Column, ...]:
    return q[1], q[2], q[3], q[0]


def pose_matrix(t: Vec, q: Vec) -> tuple[Column, ...]:
    """Row-major 4x4 homogeneous matrix of a pose."""
    m = to_matrix(q)
    zero, one = F.lit(0.0), F.lit(1.0)
    return (*m[0:3], t[0], *m[3:6], t[1], *m[6:9], t[2], zero, zero, zero, one)


def relative_pose(gt_t: Vec, gt_q: Vec, pred_t: Vec, pred_q: Vec):
    """Pose (t, R row-major) that carries ground-truth placement to the prediction."""
    r = matrix_multiply(to_matrix(pred_q), transpose(to_matrix(gt_q)))
    return sub(pred_t, matrix_vector(r, gt_t)), r


def anchor_alignment(gt_t: Vec, gt_q: Vec, pred_t: Vec, pred_q: Vec):
    """Rigid motion (t, q) that puts a predicted anchor onto its ground truth."""
    q = multiply(gt_q, conjugate(pred_q))
    return sub(gt_t, rotate(q, pred_t)), q


def stage(df: DataFrame, tag: str, values: Vec) -> tuple[DataFrame, tuple[Column, ...]]:
    """Compute ``values`` once as helper columns ``_tag0..`` and refer to them.

    Composed rotations mention their inputs many times; without a stage between
    them the expression grows with every composition.
    """
    names = [f"_{tag}{i}" for i in range(len(values))]
    return df.withColumns(dict(zip(names, values))), cols(*names)


def with_tuple(df: DataFrame, names: Sequence[str], values: Vec) -> DataFrame:
    return df.withColumns(dict(zip(names, values)))
