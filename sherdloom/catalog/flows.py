"""Schedules, noising, integration, training pairs, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import rot, schedule as S
from ..functions.embed import frequency_embedding
from ..operators import metrics as M
from ..operators.metrics import PART
from ..operators.poses import PR_COLS, integrate, pin_reference
from ..plans import training as TR
from ..plans.evaluate import trajectory_errors
from . import duck
from .poses import GQ, GT, PQ, PT_, _euler_sql, rounded
from .registry import query

_T = "CAST(event_id % 1000 + 1 AS DOUBLE)"


def _times(spark, sf):
    return fx.events(spark, sf).select("event_id", (F.col("event_id") % 1000 + 1).cast("double").alias("t"))


def sig(kind: str, t: str) -> str:
    return {
        "linear": f"{t}/1000",
        "piecewise-linear": f"CASE WHEN {t} <= 700 THEN {t}/700*0.1 ELSE 0.1+({t}-700)/300*0.9 END",
        "piecewise-quadratic": f"CASE WHEN {t} <= 700 THEN 0.1*({t}/700)*({t}/700) ELSE 0.1+0.9*(({t}-700)/300)*(({t}-700)/300) END",
        "exponential": f"exp(-5*(1-{t}/1000))",
    }[kind]


@query(
    "m14_sigma_schedules",
    " UNION ALL ".join(
        f"SELECT event_id, '{k}' AS kind, {duck.r(sig(k, _T), 'sigma')} FROM events" for k in S.SIGMA_SCHEDULES
    ),
)
def sigma_schedules(spark, sf):
    kinds = [
        F.struct(F.lit(k).alias("kind"), *rounded([S.sigma(F.col("t"), 1000, k)], ["sigma"]))
        for k in S.SIGMA_SCHEDULES
    ]
    return _times(spark, sf).select("event_id", F.inline(F.array(*kinds)))


@query("m15_stochastic_epsilon", f"SELECT event_id, {duck.r(f'sqrt(0.01*{_T}/1000*(1-{_T}/1000)+0.01)', 'eps')} FROM events")
def stochastic_epsilon(spark, sf):
    return _times(spark, sf).select(
        "event_id", *rounded([S.stochastic_epsilon(F.col("t") / 1000)], ["eps"])
    )


@query(
    "w09_sigma_steps",
    f"SELECT event_id, {duck.r('-0.05', 'delta')}, {duck.r('(20 - event_id % 20)/20.0', 'sigma')} FROM events",
)
def sigma_steps(spark, sf):
    table = S.sigma_table(spark, 20)
    rows = fx.events(spark, sf).select("event_id", (F.col("event_id") % 20).alias("step"))
    return rows.join(F.broadcast(table), "step").select(
        "event_id", *rounded([F.col("delta"), F.col("sigma")], ("delta", "sigma"))
    )


@query(
    "j12_sigma_lookup",
    f"SELECT event_id, {duck.r('CASE WHEN event_id % 3 = 0 THEN (event_id % 40 + 1)/80.0 ELSE (event_id % 40 + 1)/40.0 END', 'sigma')} FROM events WHERE event_id % 40 % 3 = event_id % 3",
)
def sigma_lookup(spark, sf):
    """Every third timestep of the schedule comes three times; its second sigma counts."""
    table = S.sigma_table(spark, 40).select("step", "timestep", "sigma")
    place = F.round(F.col("sigma") * 40).cast("long") - 1
    third = table.where(place % 3 == 0)
    again = third.select((F.col("step") + 100).alias("step"), "timestep", (F.col("sigma") / 2).alias("sigma"))
    more = third.select((F.col("step") + 200).alias("step"), "timestep", (F.col("sigma") / 4).alias("sigma"))
    rows = fx.events(spark, sf).where("event_id % 40 % 3 = event_id % 3").select(
        "event_id", ((F.col("event_id") % 40 + 1).cast("double") / 40 * 1000).alias("timestep")
    )
    found = S.sigma_lookup(rows, table.unionByName(again).unionByName(more))
    return found.select("event_id", *rounded([F.col("sigma")], ["sigma"]))


def _abar(kind: str, t: str) -> str:
    return {
        "cosine": f"pow(cos(({t}+0.008)/1.008*pi()/2), 2)",
        "exp": f"exp({t}*-12.0)",
        "piece_wise": f"CASE WHEN {t}*1000 <= 700 THEN 1-0.1*pow({t}*1000/700, 2) ELSE 0.9*(1-pow(({t}*1000-700)/300, 2)) END",
    }[kind]


_I = "CAST(event_id % 1000 AS DOUBLE)"
_KINDS = ("cosine", "exp", "piece_wise")


@query(
    "m19_betas_from_alpha_bar",
    " UNION ALL ".join(
        f"SELECT event_id, '{k}' AS kind, {duck.r('least(1-(' + _abar(k, f'(({_I}+1)/1000)') + ')/(' + _abar(k, f'({_I}/1000)') + '), 0.999)', 'beta')} FROM events"
        for k in _KINDS
    ),
)
def betas(spark, sf):
    out = None
    rows = fx.events(spark, sf).select("event_id", (F.col("event_id") % 1000).alias("step"))
    for k in _KINDS:
        one = rows.join(F.broadcast(S.beta_table(spark, 1000, k)), "step").select(
            "event_id", F.lit(k).alias("kind"), *rounded([F.col("beta")], ["beta"])
        )
        out = one if out is None else out.unionByName(one)
    return out


def _running(step: str) -> str:
    """The running product of 1 - beta: it telescopes to alpha_bar where beta is not clipped.

    Of the 1000 piece-wise steps only the last one is clipped, to 0.999.
    """
    now, after = f"(CAST({step} AS DOUBLE)/1000)", f"((CAST({step} AS DOUBLE)+1)/1000)"
    return f"CASE WHEN {step} = 999 THEN 0.001*({_abar('piece_wise', now)}) ELSE {_abar('piece_wise', after)} END"


@query("w10_cumulative_alpha", f"SELECT event_id, {duck.r(_running('(event_id % 1000)'), 'alpha_bar')} FROM events")
def cumulative_alpha(spark, sf):
    rows = fx.events(spark, sf).select("event_id", (F.col("event_id") % 1000).alias("step"))
    return rows.join(F.broadcast(S.beta_table(spark)), "step").select(
        "event_id", *rounded([F.col("alpha_bar")], ["alpha_bar"])
    )


# ---- noising: truth = gt pose, noise = predicted pose -------------------------

_S = "((part_idx % 10 + 1)/11.0::DOUBLE)"


def _polar(q, prefix: str) -> str:
    """Half angle and unit axis of a quaternion taken with non-negative real part."""
    w, x, y, z = q
    n = f"sqrt({x}*{x}+{y}*{y}+{z}*{z})"
    s = f"(CASE WHEN {w} < 0 THEN -1 ELSE 1 END)"
    return (
        f"atan2({n}, abs({w})) AS {prefix}h, {s}*{x}/{n} AS {prefix}x, {s}*{y}/{n} AS {prefix}y, {s}*{z}/{n} AS {prefix}z"
    )


def _turn(prefix: str, factor: str) -> list[str]:
    return [f"cos({prefix}h*{factor})"] + [f"sin({prefix}h*{factor})*{prefix}{c}" for c in "xyz"]


_NOISE = f"""pol AS (SELECT *, {_S} AS s, {_polar(PQ, 'n')} FROM pose),
tq AS (SELECT *, {', '.join(f'{e} AS {n}' for e, n in zip(_turn('n', 's'), ('ew', 'ex', 'ey', 'ez')))} FROM pol),
noised AS (SELECT *, {', '.join(f'{e} AS {n}' for e, n in zip(duck.hamilton(('ew', 'ex', 'ey', 'ez'), GQ), ('rw', 'rx', 'ry', 'rz')))},
  {', '.join(f'(1-s)*{g}+s*{p} AS x{c}' for g, p, c in zip(GT, PT_, 'xyz'))},
  {', '.join(f'{p}-{g} AS v{c}' for g, p, c in zip(GT, PT_, 'xyz'))},
  {', '.join(f'2*nh*n{c} AS w{c}' for c in 'xyz')} FROM tq)"""
_RQ = ("rw", "rx", "ry", "rz")
_XQ = ("xw", "xqx", "xqy", "xqz")
_NOISED_SQL = (
    duck.rs(("xx", "xy", "xz"), ("xx", "xy", "xz")) + ", " + duck.rs(duck.signed(_RQ, "rw"), _XQ)
    + ", " + duck.rs(("vx", "vy", "vz", "wx", "wy", "wz"), ("vx", "vy", "vz", "wx", "wy", "wz"))
)


def _sigma():
    return (F.col("part_idx") % 10 + 1) / F.lit(11.0)


_POSE_OUT = ("xx", "xy", "xz", *_XQ)
_FIELD_OUT = ("vx", "vy", "vz", "wx", "wy", "wz")


def _noised(spark, sf):
    df = fx.poses(spark, sf).withColumn("s", _sigma())
    return S.flow_noise(
        df, M.gt_t(), M.gt_q(), M.pr_t(), M.pr_q(), F.col("s"), _POSE_OUT, _FIELD_OUT
    )


@query("m16_flow_noising", f"WITH {duck.POSE}, {_NOISE} SELECT name, part_idx, {_NOISED_SQL} FROM noised")
def flow_noising(spark, sf):
    df = _noised(spark, sf)
    return df.select(*PART, *rounded(map(F.col, _POSE_OUT + _FIELD_OUT), _POSE_OUT + _FIELD_OUT))


@query(
    "m18_denoised_estimate",
    f"WITH {duck.POSE} SELECT name, part_idx, {duck.rs(GT, ('tx', 'ty', 'tz'))}, {duck.rs(duck.signed(GQ, GQ[0]), ('qw', 'qx', 'qy', 'qz'))} FROM pose",
)
def denoised_estimate(spark, sf):
    """Noising followed by the estimate with the true field gives the truth back."""
    df = _noised(spark, sf)
    t, r = S.denoised(
        rot.cols("xx", "xy", "xz"), rot.cols(*_XQ),
        rot.cols("vx", "vy", "vz"), rot.cols("wx", "wy", "wz"), F.col("s"),
    )
    return df.select(*PART, *rounded(t, ("tx", "ty", "tz")), *rounded(r, ("qw", "qx", "qy", "qz")))


def _path_sql(steps: int, delta: str) -> str:
    """Pose after step k of a field that is constant over the steps."""
    w2 = "sqrt(wx*wx+wy*wy+wz*wz)"
    return f"""fld AS (SELECT name, part_idx, 0.1*e[15] AS vx, 0.1*e[16] AS vy, 0.1*e[17] AS vz,
      0.1*e[18] AS wx, 0.1*e[19] AS wy, 0.1*e[20] AS wz FROM vec),
    stp AS (SELECT p.*, f.* EXCLUDE (name, part_idx), k AS step, {delta} AS dl FROM pose p JOIN fld f USING (name, part_idx),
      (SELECT unnest(range(-1, {steps})) AS k) g),
    rotd AS (SELECT *, cos({w2}*dl/2) AS ew, sin({w2}*dl/2)*wx/{w2} AS ex, sin({w2}*dl/2)*wy/{w2} AS ey, sin({w2}*dl/2)*wz/{w2} AS ez FROM stp),
    path AS (SELECT *, {', '.join(f'{e} AS {n}' for e, n in zip(duck.hamilton(('ew', 'ex', 'ey', 'ez'), PQ), _RQ))},
      {', '.join(f'{p}+dl*v{c} AS x{c}' for p, c in zip(PT_, 'xyz'))} FROM rotd)"""


_PATH = _path_sql(20, "-(k+1)/20.0::DOUBLE")
_PATH_OUT = duck.rs(("xx", "xy", "xz"), ("tx", "ty", "tz")) + ", " + duck.rs(
    duck.signed(_RQ, "rw"), ("qw", "qx", "qy", "qz")
)


def _signed_pose():
    return rounded(rot.cols("tx", "ty", "tz"), ("tx", "ty", "tz")) + rounded(
        rot.standardize(rot.cols("qw", "qx", "qy", "qz")), ("qw", "qx", "qy", "qz")
    )


def _trajectory(spark, sf):
    return integrate(fx.poses(spark, sf), fx.field(spark, sf), S.sigma_table(spark, 20))


@query("m17_euler_step", f"WITH {duck.POSE}, {_PATH} SELECT name, part_idx, {_PATH_OUT} FROM path WHERE step = 0")
def euler_step(spark, sf):
    df = fx.poses(spark, sf).join(fx.field(spark, sf, 1), PART)
    t, q = S.euler_step(
        M.pr_t(), M.pr_q(), rot.cols("vx", "vy", "vz"), rot.cols("wx", "wy", "wz"), F.lit(-0.05)
    )
    return df.select(*PART, *rounded(t, ("tx", "ty", "tz")), *rounded(q, ("qw", "qx", "qy", "qz")))


_KICK = [duck.normal(1116, f"'{i}'", "name", "part_idx") for i in range(6)]
_KICKED = duck.hamilton(_RQ, ("kw", "kx", "ky", "kz"))


@query(
    "m17_langevin_step",
    f"""WITH {duck.POSE}, {_path_sql(1, '-0.05::DOUBLE')},
    kicks AS (SELECT *, {', '.join(f'{z} AS z{i}' for i, z in enumerate(_KICK))}, 0.05*sqrt(0.05::DOUBLE) AS spread FROM path WHERE step = 0),
    turned AS (SELECT *, spread*sqrt(z3*z3+z4*z4+z5*z5) AS angle FROM kicks),
    kicked AS (SELECT *, cos(angle/2) AS kw, {', '.join(f'sin(angle/2)*spread*z{i + 3}/angle AS k{c}' for i, c in enumerate('xyz'))} FROM turned)
    SELECT name, part_idx, {duck.rs([f'x{c}+spread*z{i}' for i, c in enumerate('xyz')], ('tx', 'ty', 'tz'))},
      {duck.rs(duck.signed(_KICKED, _KICKED[0]), ('qw', 'qx', 'qy', 'qz'))} FROM kicked""",
)
def langevin_step(spark, sf):
    from ..functions.rand import hash_normal

    df = fx.poses(spark, sf).join(fx.field(spark, sf, 1), PART)
    z = [hash_normal(1116, F.lit(str(i)), *PART) for i in range(6)]
    names = ("tx", "ty", "tz", "qw", "qx", "qy", "qz")
    df = S.langevin_step(
        df, M.pr_t(), M.pr_q(), rot.cols("vx", "vy", "vz"), rot.cols("wx", "wy", "wz"),
        F.lit(-0.05), 0.05, z[:3], z[3:], names,
    )
    q = rot.standardize(rot.cols(*names[3:]))
    return df.select(*PART, *rounded(map(F.col, names[:3]), names[:3]), *rounded(q, names[3:]))


@query("m17_integrate_20_steps", f"WITH {duck.POSE}, {_PATH} SELECT name, part_idx, {_PATH_OUT} FROM path WHERE step = 19")
def integrate_20(spark, sf):
    return _trajectory(spark, sf).where("step = 19").select(*PART, *_signed_pose())


@query("d08_trajectory", f"WITH {duck.POSE}, {_PATH} SELECT name, part_idx, step, {_PATH_OUT} FROM path")
def trajectory(spark, sf):
    return _trajectory(spark, sf).select(*PART, "step", *_signed_pose())


_STEP_ERR = ", ".join(
    f"least(abs({a}-{b}), 360-abs({a}-{b})) AS d{i}"
    for i, (a, b) in enumerate(zip(_euler_sql(_RQ), _euler_sql(GQ)))
)


@query(
    "d08_trajectory_errors",
    f"""WITH {duck.POSE}, {_PATH} SELECT name, part_idx, step,
    {duck.r('sqrt(((xx-gt_tx)*(xx-gt_tx)+(xy-gt_ty)*(xy-gt_ty)+(xz-gt_tz)*(xz-gt_tz))/3)', 'rmse_t')},
    {duck.r('sqrt((d0*d0+d1*d1+d2*d2)/3)', 'rmse_r')} FROM (SELECT *, {_STEP_ERR} FROM path)""",
)
def trajectory_error(spark, sf):
    df = trajectory_errors(_trajectory(spark, sf), fx.poses(spark, sf))
    return df.select(*PART, "step", *rounded([F.col("rmse_t"), F.col("rmse_r")], ("rmse_t", "rmse_r")))


_REFERENCE = "(part_idx = 0)"


@query(
    "p16_reference_override",
    f"""WITH {duck.POSE} SELECT name, part_idx,
    {duck.rs([f'CASE WHEN {_REFERENCE} THEN {g} ELSE {p} END' for g, p in zip(GT + GQ, PT_ + PQ)], PR_COLS)},
    {duck.r(f'CASE WHEN {_REFERENCE} THEN 0 ELSE pr_tx - gt_tx END', 'vx')} FROM pose""",
)
def reference_override(spark, sf):
    df = fx.poses(spark, sf).withColumn("vx", F.col("pr_tx") - F.col("gt_tx"))
    df = pin_reference(df, F.col("part_idx") == 0, ("vx",))
    return df.select(*PART, *rounded(map(F.col, PR_COLS + ["vx"]), PR_COLS + ["vx"]))


def _training_input(spark, sf):
    df = fx.poses(spark, sf).withColumns(dict(zip(TR.NOISE_COLS, [F.col(c) for c in PR_COLS])))
    return df.withColumn("train_index", F.col("name") * 37 % 1000).withColumn(
        "is_ref", F.col("part_idx") == 0
    )


_TRAIN = _NOISE.replace(_S, "((1000 - name*37 % 1000)/1000.0::DOUBLE)")
_PIN = [f"CASE WHEN {_REFERENCE} THEN {g} ELSE {p} END" for g, p in zip(GT, ("xx", "xy", "xz"))]
_PINQ = [f"CASE WHEN {_REFERENCE} THEN {g} ELSE {p} END" for g, p in zip(GQ, duck.signed(_RQ, "rw"))]
_PINV = [f"CASE WHEN {_REFERENCE} THEN 0 ELSE {c} END" for c in ("vx", "vy", "vz", "wx", "wy", "wz")]


@query(
    "d06_training_pairs",
    f"WITH {duck.POSE}, {_TRAIN} SELECT name, part_idx, {duck.r('s', 'sigma')}, {duck.r('s*1000', 'timestep')}, "
    + duck.rs(_PIN + _PINQ, TR.NOISED_COLS) + ", " + duck.rs(_PINV, TR.FIELD_COLS) + " FROM noised",
)
def training_pairs(spark, sf):
    names = ("sigma", "timestep", *TR.NOISED_COLS, *TR.FIELD_COLS)
    return TR.flow_pairs(_training_input(spark, sf)).select(*PART, *rounded(map(F.col, names), names))


_DRAWN_NOISE = [*[duck.normal(1116, f"'{c}'", "name", "part_idx") for c in "xyz"], *duck.quaternion(1116, "'noise'", "name", "part_idx")]


@query(
    "m22_training_timestep",
    f"""WITH {duck.POSE} SELECT name, part_idx, CAST(floor({duck.uniform(1116, "'timestep'", 'name')} * 1000) AS BIGINT) AS train_index,
    {duck.rs(_DRAWN_NOISE, TR.NOISE_COLS)} FROM pose""",
)
def training_timestep(spark, sf):
    df = TR.with_noise(TR.with_timestep(fx.poses(spark, sf)))
    return df.select(*PART, "train_index", *rounded(map(F.col, TR.NOISE_COLS), TR.NOISE_COLS))


# ---- diffusion ------------------------------------------------------------------

_AB = f"({_running('(name*37 % 1000)')})"
_DIFF = f"""pol AS (SELECT *, {_AB} AS ab, {_polar(GQ, 'g')} FROM pose),
mix AS (SELECT *, {', '.join(f'sqrt(ab)*2*gh*g{c}+sqrt(1-ab)*{n} AS u{c}' for c, n in zip('xyz', PQ[:3]))} FROM pol),
dn AS (SELECT *, {', '.join(f'sqrt(ab)*{g}+sqrt(1-ab)*{p} AS x{c}' for g, p, c in zip(GT, PT_, 'xyz'))},
  sqrt(ux*ux+uy*uy+uz*uz) AS un FROM mix)"""
_DQ = ["cos(un/2)"] + [f"sin(un/2)*u{c}/un" for c in "xyz"]


@query(
    "m20_diffusion_noising",
    f"WITH {duck.POSE}, {_DIFF} SELECT name, part_idx, "
    + duck.rs(
        [f"CASE WHEN {_REFERENCE} THEN {g} ELSE {v} END" for g, v in zip(GT + GQ, ["xx", "xy", "xz"] + duck.signed(_DQ, "cos(un/2)"))],
        TR.NOISED_COLS,
    ) + " FROM dn",
)
def diffusion_noising(spark, sf):
    df = _training_input(spark, sf).withColumn("train_index", F.col("name") * 37 % 1000)
    df = TR.diffusion_pairs(df, S.beta_table(spark))
    return df.select(*PART, *rounded(map(F.col, TR.NOISED_COLS), TR.NOISED_COLS))




_STEP = "(name*37 % 1000)"
_REVERSED = f"""sched AS (SELECT *, {_STEP} AS step, {_running(_STEP)} AS ab, CASE WHEN {_STEP} = 0 THEN 1.0::DOUBLE ELSE {_running(f'({_STEP} - 1)')} END AS abp FROM pose),
pol AS (SELECT *, {_polar(GQ, 'g')}, sqrt(abp)*(1-ab/abp)/(1-ab) AS cs, sqrt(ab/abp)*(1-abp)/(1-ab) AS cn,
  CASE WHEN step > 0 THEN sqrt(greatest((1-abp)/(1-ab)*(1-ab/abp), 1e-20)) ELSE 0 END AS spread,
  {', '.join(f"{duck.normal(1116, repr(f'm21{i}'), 'name', 'part_idx')} AS z{i}" for i in range(6))} FROM sched)"""


def _reverse_sql(kind: str) -> str:
    o = {c: f"0.3*{p}" for c, p in zip("xyz", PT_)}
    ow = {c: f"0.3*{p}" for c, p in zip("xyz", PQ[1:])}

    def start(x, out):
        return {
            "epsilon": f"({x}-sqrt(1-ab)*{out})/sqrt(ab)",
            "sample": out,
            "v_prediction": f"sqrt(ab)*{x}-sqrt(1-ab)*{out}",
        }[kind]

    t = [f"cs*({start(g, o[c])})+cn*{g}+z{i}*spread" for i, (g, c) in enumerate(zip(GT, "xyz"))]
    u = [f"cs*({start(f'(2*gh*g{c})', ow[c])})+cn*2*gh*g{c}+z{i + 3}*spread" for i, c in enumerate("xyz")]
    return f"""SELECT name, part_idx, '{kind}' AS kind, {duck.rs(t, ('tx', 'ty', 'tz'))},
    {duck.rs(duck.signed(['cos(un/2)'] + [f'sin(un/2)*u{c}/un' for c in 'xyz'], 'cos(un/2)'), ('qw', 'qx', 'qy', 'qz'))}
    FROM (SELECT *, sqrt(ux*ux+uy*uy+uz*uz) AS un FROM (SELECT *, {', '.join(f'{e} AS u{c}' for e, c in zip(u, 'xyz'))} FROM pol))"""


_PRED = ("epsilon", "sample", "v_prediction")


@query(
    "m21_diffusion_reverse_step",
    f"WITH {duck.POSE}, {_REVERSED} " + " UNION ALL ".join(_reverse_sql(k) for k in _PRED),
)
def diffusion_reverse(spark, sf):
    """One reverse step of every object from its own place in the schedule, with noise above step 0."""
    from ..functions.rand import hash_normal

    table = S.beta_table(spark).select("step", "alpha_bar")
    before = table.select((F.col("step") + 1).alias("step"), F.col("alpha_bar").alias("alpha_prev"))
    schedule = table.join(before, "step", "left").fillna(1.0, ["alpha_prev"])  # as long as the schedule
    df = fx.poses(spark, sf).withColumn("step", F.col("name") * 37 % 1000).join(F.broadcast(schedule), "step")
    z = [f"z{i}" for i in range(6)]
    df = df.withColumns({n: hash_normal(1116, F.lit(f"m21{i}"), *PART) for i, n in enumerate(z)})
    out_t = rot.scale(M.pr_t(), F.lit(0.3))
    out_r = rot.scale(M.pr_q()[1:], F.lit(0.3))
    out = None
    for k in _PRED:
        names = ("tx", "ty", "tz", "qw", "qx", "qy", "qz")
        one = S.diffusion_step(
            df, M.gt_t(), M.gt_q(), out_t, out_r, F.col("alpha_bar"), F.col("alpha_prev"), names, k,
            rot.cols(*z[:3]), rot.cols(*z[3:]), F.col("step"),
        )
        q = rot.standardize(rot.cols(*names[3:]))
        one = one.select(*PART, F.lit(k).alias("kind"), *rounded(map(F.col, names[:3]), names[:3]), *rounded(q, names[3:]))
        out = one if out is None else out.unionByName(one)
    return out


# ---- losses -----------------------------------------------------------------------

_LOSS_FIELDS = [f"{s}_{c}" for s in "ft" for c in ("vx", "vy", "vz", "wx", "wy", "wz")]


def _loss_rows(spark, sf):
    e = F.col("e")
    fields = fx._vectors(spark, sf).select(
        *PART, *[(0.1 * e[14 + i]).alias(n) for i, n in enumerate(_LOSS_FIELDS)]
    )
    return fx.poses(spark, sf).join(fields, PART)


_LOSS_SQL = f"lf AS (SELECT name, part_idx, {', '.join(f'0.1*e[{15+i}] AS {n}' for i, n in enumerate(_LOSS_FIELDS))} FROM vec)"
_VEC = "+".join(f"(f_{c}-t_{c})*(f_{c}-t_{c})" for c in ("vx", "vy", "vz", "wx", "wy", "wz"))
_TR = "+".join(f"({p}-{g})*({p}-{g})" for p, g in zip(PT_, GT))
_RT = "+".join(f"({p}-{g})*({p}-{g})" for p, g in zip(PQ, GQ))
_DOT = "+".join(f"{p}*{g}" for p, g in zip(PQ, GQ))
_LOSS_COLS = ("vec_mse_loss", "trans_mse_loss", "rot_mse_loss", "rot_rmse")


@query(
    "a23_flow_losses",
    f"""WITH {duck.POSE}, {_LOSS_SQL} SELECT name, {duck.rs([f'avg(({_VEC})/6)', f'avg(({_TR})/3)', f'avg(({_RT})/4)',
    f'sqrt(avg(pow(degrees(acos(least(1, greatest(-1, {_DOT})))), 2)))'], _LOSS_COLS)} FROM pose JOIN lf USING (name, part_idx) GROUP BY name""",
)
def flow_losses(spark, sf):
    df = M.flow_losses(_loss_rows(spark, sf), ["name"])
    return df.select("name", *rounded(map(F.col, _LOSS_COLS), _LOSS_COLS))


@query(
    "a24_diffusion_loss",
    f"""WITH {duck.POSE}, {_LOSS_SQL} SELECT name % 3 AS batch, {duck.r(f'avg(({_VEC})/6)', 'mse_loss')}
    FROM pose JOIN lf USING (name, part_idx) WHERE part_idx <> 0 GROUP BY name % 3""",
)
def diffusion_loss(spark, sf):
    comps = ("vx", "vy", "vz", "wx", "wy", "wz")
    df = _loss_rows(spark, sf).withColumn("batch", F.col("name") % 3)
    loss = M.diffusion_loss(
        df, [f"f_{c}" for c in comps], [f"t_{c}" for c in comps], F.col("part_idx") == 0, ["batch"]
    )
    return loss.select("batch", *rounded([F.col("mse_loss")], ["mse_loss"]))


@query(
    "a25_step_and_epoch_metrics",
    f"""SELECT event_type AS stage, CAST(dayofmonth(ts) AS BIGINT) AS epoch, count(*) AS steps, {duck.r('avg(value)', 'metric_mean')}
    FROM events GROUP BY ALL""",
)
def epoch_metrics(spark, sf):
    log = fx.events(spark, sf).select(
        F.col("event_type").alias("stage"), F.dayofmonth("ts").cast("long").alias("epoch"), "value"
    )
    return M.epoch_means(log).select(
        "stage", "epoch", "steps", *rounded([F.col("metric_mean")], ["metric_mean"])
    )


_EMB = " UNION ALL ".join(
    [f"SELECT name, part_idx, {i} AS dim, {c} AS v FROM pose" for i, c in enumerate(GT + GQ)]
    + [
        f"SELECT name, part_idx, {7 + k*14 + f*7 + i} AS dim, {fn}({c}*{2**k}.0) AS v FROM pose"
        for k in range(10) for f, fn in enumerate(("sin", "cos")) for i, c in enumerate(GT + GQ)
    ]
)


@query(
    "m36_frequency_embedding",
    f"WITH {duck.POSE} SELECT name, part_idx, CAST(dim AS BIGINT) AS dim, {duck.r('v', 'v')} FROM ({_EMB})",
)
def frequency(spark, sf):
    emb = frequency_embedding(list(M.gt_t() + M.gt_q()))
    return fx.poses(spark, sf).select(*PART, F.posexplode(emb).alias("dim", "v")).select(
        *PART, F.col("dim").cast("long").alias("dim"), *rounded([F.col("v")], ["v"])
    )
