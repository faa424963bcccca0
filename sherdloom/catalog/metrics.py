"""Evaluation metrics over poses, points and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import metrics as M
from . import duck
from .poses import GQ, GT, PQ, PT_, _euler_sql, rounded
from .registry import query

_DIFF = [f"({p}-{g})" for p, g in zip(PT_, GT)]
_SQ = "+".join(f"{d}*{d}" for d in _DIFF)
_ANG = ", ".join(
    f"least(abs({a}-{b}), 360-abs({a}-{b})) AS d{i}"
    for i, (a, b) in enumerate(zip(_euler_sql(PQ), _euler_sql(GQ)))
)
ERR = f"""err AS (SELECT name, part_idx, ({_SQ})/3 AS t_mse, sqrt(({_SQ})/3) AS t_rmse,
  (abs({_DIFF[0]})+abs({_DIFF[1]})+abs({_DIFF[2]}))/3 AS t_mae,
  (d0*d0+d1*d1+d2*d2)/3 AS r_mse, sqrt((d0*d0+d1*d1+d2*d2)/3) AS r_rmse, (d0+d1+d2)/3 AS r_mae
  FROM (SELECT *, {_ANG} FROM pose))"""


@query(
    "a10_translation_metrics",
    f"WITH {duck.POSE}, {ERR} SELECT name, {duck.rs(['avg(t_mse)', 'avg(t_rmse)', 'avg(t_mae)'], ['mse_t', 'rmse_t', 'mae_t'])} FROM err GROUP BY name",
)
def translation_metrics(spark, sf):
    kinds = ("mse", "rmse", "mae")
    values = [M.valid_mean(M.translation_error(M.pr_t(), M.gt_t(), k)) for k in kinds]
    return fx.poses(spark, sf).groupBy("name").agg(*rounded(values, [f"{k}_t" for k in kinds]))


@query(
    "a11_rotation_metrics",
    f"WITH {duck.POSE}, {ERR} SELECT name, {duck.rs(['avg(r_mse)', 'avg(r_rmse)', 'avg(r_mae)'], ['mse_r', 'rmse_r', 'mae_r'])} FROM err GROUP BY name",
)
def rotation_metrics(spark, sf):
    kinds = ("mse", "rmse", "mae")
    values = [M.valid_mean(M.rotation_error(M.pr_q(), M.gt_q(), k)) for k in kinds]
    return fx.poses(spark, sf).groupBy("name").agg(*rounded(values, [f"{k}_r" for k in kinds]))


@query(
    "a11_pose_rmse_by_object",
    f"WITH {duck.POSE}, {ERR} SELECT name, {duck.rs(['avg(t_rmse)', 'avg(r_rmse)'], ['rmse_t', 'rmse_r'])} FROM err GROUP BY name",
)
def pose_rmse(spark, sf):
    df = M.pose_metrics(fx.poses(spark, sf))
    return df.select("name", *rounded(map(F.col, ("rmse_t", "rmse_r")), ("rmse_t", "rmse_r")))


def seg_sql(keys: str = "") -> str:
    sel = f"{keys}, " if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {sel}tp, fp, fn, tn,
      {duck.r('CASE WHEN tp+fp+fn+tn=0 THEN 0 ELSE (tp+tn)/(tp+fp+fn+tn) END', 'accuracy')},
      {duck.r('CASE WHEN tp+fn=0 THEN 0 ELSE tp/(tp+fn) END', 'recall')},
      {duck.r('CASE WHEN tp+fp=0 THEN 0 ELSE tp/(tp+fp) END', 'precision')},
      {duck.r('CASE WHEN 2*tp+fp+fn=0 THEN 0 ELSE 2*tp/(2*tp+fp+fn) END', 'f1')},
      {duck.r('1-(2*pg+1e-6)/(sp+sg+1e-6)', 'dice_loss')}
    FROM (SELECT {sel}count(*) FILTER (score > 0.5 AND gt = 1) AS tp,
            count(*) FILTER (score > 0.5 AND gt = 0) AS fp,
            count(*) FILTER (score <= 0.5 AND gt = 1) AS fn,
            count(*) FILTER (score <= 0.5 AND gt = 0) AS tn,
            sum(score*gt) AS pg, sum(score) AS sp, sum(gt) AS sg FROM seg {grp})"""


_SEG_COLS = ("accuracy", "recall", "precision", "f1", "dice_loss")


def _seg_out(df, keys=()):
    return df.select(
        *keys, "tp", "fp", "fn", "tn", *rounded(map(F.col, _SEG_COLS), _SEG_COLS)
    )


@query("a07_segmentation_metrics", f"WITH {duck.SEG} {seg_sql()}")
def segmentation_metrics(spark, sf):
    return _seg_out(M.segmentation_report(fx.scores(spark, sf)))


@query("a08_dice_loss", f"WITH {duck.SEG} SELECT name, {duck.r('1-(2*sum(score*gt)+1e-6)/(sum(score)+sum(gt)+1e-6)', 'dice_loss')} FROM seg GROUP BY name")
def dice_loss(spark, sf):
    p, g = F.col("score"), F.col("gt").cast("double")
    return fx.scores(spark, sf).groupBy("name").agg(
        *rounded([M.dice_loss(F.sum(p * g), F.sum(p), F.sum(g))], ["dice_loss"])
    )


@query(
    "a06_fracture_points_per_part",
    f"WITH {duck.PTS} SELECT name, part_idx, CAST(sum(frac) AS BIGINT) AS n_frac FROM pts GROUP BY name, part_idx",
)
def fracture_points(spark, sf):
    return fx.points(spark, sf).groupBy(*M.PART).agg(F.sum("frac").alias("n_frac"))


@query(
    "a09_valid_mean",
    f"""WITH {duck.POSE}, v AS (SELECT name, CASE WHEN gt_tx < 0 THEN CAST('NaN' AS DOUBLE) ELSE sqrt(gt_tx) END AS val FROM pose)
    SELECT name, {duck.r('sum(CASE WHEN isnan(val) THEN 0 ELSE val END)/count(*)', 'valid_mean')} FROM v GROUP BY name""",
)
def valid_mean(spark, sf):
    value = F.sqrt(F.col("gt_tx"))  # NaN where negative
    return fx.poses(spark, sf).groupBy("name").agg(
        *rounded([M.valid_mean(value)], ["valid_mean"])
    )


def placed_sql(where: str = "") -> str:
    g = [f"{m}+{t}" for m, t in zip(duck.matvec(duck.mat(GQ), ("x", "y", "z")), GT)]
    p = [f"{m}+{t}" for m, t in zip(duck.matvec(duck.mat(PQ), ("x", "y", "z")), PT_)]
    cols = ", ".join(f"{e} AS {n}" for e, n in zip(g + p, ("gx", "gy", "gz", "px", "py", "pz")))
    return f"placed AS (SELECT name, part_idx, pt_idx, {cols} FROM pts JOIN pose USING (name, part_idx) {where})"


_D2 = "((a.gx-b.px)*(a.gx-b.px)+(a.gy-b.py)*(a.gy-b.py)+(a.gz-b.pz)*(a.gz-b.pz))"


def nn_sql(same_part: bool) -> str:
    on = "a.name=b.name" + (" AND a.part_idx=b.part_idx" if same_part else "")
    return f"""fwd AS (SELECT a.name, a.part_idx, a.pt_idx, min({_D2}) AS d2
      FROM placed a JOIN placed b ON {on} GROUP BY ALL),
    bwd AS (SELECT b.name, b.part_idx, b.pt_idx, min({_D2}) AS d2
      FROM placed a JOIN placed b ON {on} GROUP BY ALL)"""


CD_PART = """pcd AS (SELECT f.name, f.part_idx, f.m + w.m AS chamfer
  FROM (SELECT name, part_idx, avg(d2) AS m FROM fwd GROUP BY ALL) f
  JOIN (SELECT name, part_idx, avg(d2) AS m FROM bwd GROUP BY ALL) w USING (name, part_idx))"""
CD_SHAPE = """scd AS (SELECT name, avg(cd) AS shape_cd FROM (
  SELECT name, part_idx, avg(f.d2 + w.d2) AS cd FROM fwd f JOIN bwd w USING (name, part_idx, pt_idx)
  GROUP BY ALL) GROUP BY name)"""


def _placed(spark, sf, variable=True):
    return M.placed_points(fx.points(spark, sf, variable), fx.poses(spark, sf))


@query(
    "j07_pose_broadcast_to_points",
    f"WITH {duck.PTS_POSE}, {placed_sql()} SELECT name, part_idx, pt_idx, {duck.rs(('gx', 'gy', 'gz', 'px', 'py', 'pz'), ('gx', 'gy', 'gz', 'px', 'py', 'pz'))} FROM placed",
)
def pose_broadcast(spark, sf):
    names = ("gx", "gy", "gz", "px", "py", "pz")
    return _placed(spark, sf).select(*M.PART, "pt_idx", *rounded(map(F.col, names), names))


@query(
    "j09_nearest_neighbour_distances",
    f"WITH {duck.PTS_POSE}, {placed_sql()}, {nn_sql(False)} "
    f"SELECT 'gt' AS side, name, part_idx, pt_idx, {duck.r('d2', 'd2', 9)} FROM fwd UNION ALL "
    f"SELECT 'pred' AS side, name, part_idx, pt_idx, {duck.r('d2', 'd2', 9)} FROM bwd",
)
def nearest_neighbours(spark, sf):
    found = M.placement_distances(_placed(spark, sf), ["name"])
    side = F.when(F.col("side") == 0, "gt").otherwise("pred")
    return found.select(side.alias("side"), *M.PART, "pt_idx", *rounded([F.col("d2")], ["d2"], 9))


_FIXED = duck.PTS_FIXED + ",\n" + duck.POSE_BODY
_ACC = "SELECT name, round(CAST(count(*) FILTER (chamfer < 0.01) AS DOUBLE)/count(*), 6) + 0.0 AS part_acc, count(*) AS num_parts FROM pcd GROUP BY name"


@query("a12_part_accuracy_fixed_n", f"WITH {_FIXED}, {placed_sql()}, {nn_sql(True)}, {CD_PART} {_ACC}")
def part_accuracy_fixed(spark, sf):
    df = M.part_accuracy(M.part_chamfer(_placed(spark, sf, variable=False)))
    return df.select("name", *rounded([F.col("part_acc")], ["part_acc"]), "num_parts")


# The last part of objects with three or more parts plays the redundant part.
_KEEP = (
    "WHERE (name, part_idx) NOT IN "
    "(SELECT (name, max(part_idx)) FROM vec GROUP BY name HAVING count(*) >= 3)"
)


@query(
    "a13_part_accuracy_variable_n",
    f"WITH {duck.PTS_POSE}, {placed_sql(_KEEP)}, {nn_sql(True)}, {CD_PART} {_ACC}",
)
def part_accuracy_variable(spark, sf):
    df = M.part_accuracy(M.part_chamfer(_without_redundant(spark, sf)))
    return df.select("name", *rounded([F.col("part_acc")], ["part_acc"]), "num_parts")


def part_sizes(spark, sf):
    """n_points and num_parts per part, one redundant part in objects of >= 3 parts."""
    sizes = fx.points(spark, sf).groupBy(*M.PART).agg(F.count("*").alias("n_points"))
    per_object = sizes.groupBy("name").agg(F.count("*").alias("num_parts"))
    return sizes.join(per_object, "name").withColumn(
        "redundancy", (F.col("num_parts") >= 3).cast("long")
    )


def _without_redundant(spark, sf):
    kept = M.drop_redundant(part_sizes(spark, sf), F.col("redundancy")).select(*M.PART)
    return _placed(spark, sf).join(kept, M.PART, "left_semi")


@query(
    "p06_valid_without_redundancy",
    f"WITH {duck.PTS}, n AS (SELECT name, part_idx, count(*) AS n_points FROM pts GROUP BY ALL) "
    "SELECT name, part_idx, CAST(rn AS BIGINT) AS valid_rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY part_idx) AS rn, "
    "count(*) OVER (PARTITION BY name) AS np FROM n) WHERE rn <= np - CASE WHEN np >= 3 THEN 1 ELSE 0 END",
)
def valid_without_redundancy(spark, sf):
    kept = M.drop_redundant(part_sizes(spark, sf), F.col("redundancy"))
    return kept.select(*M.PART, "valid_rank")


@query(
    "a14_shape_chamfer_fixed_n",
    f"WITH {_FIXED}, {placed_sql()}, {nn_sql(False)}, {CD_SHAPE} SELECT name, {duck.r('shape_cd', 'shape_cd')} FROM scd",
)
def shape_chamfer_fixed(spark, sf):
    df = M.shape_chamfer(_placed(spark, sf, variable=False))
    return df.select("name", *rounded([F.col("shape_cd")], ["shape_cd"]))


@query(
    "a15_shape_chamfer_variable_n",
    f"WITH {duck.PTS_POSE}, {placed_sql(_KEEP)}, {nn_sql(False)}, {CD_SHAPE} SELECT name, {duck.r('shape_cd', 'shape_cd')} FROM scd",
)
def shape_chamfer_variable(spark, sf):
    df = M.shape_chamfer(_without_redundant(spark, sf))
    return df.select("name", *rounded([F.col("shape_cd")], ["shape_cd"]))


_REPORT_SQL = f"""placed AS (SELECT * FROM ({placed_sql(_KEEP)[len('placed AS ('):-1]})),
{nn_sql(True)}, {CD_PART},
sfwd AS (SELECT a.name, a.part_idx, a.pt_idx, min({_D2}) AS d2 FROM placed a JOIN placed b ON a.name=b.name GROUP BY ALL),
sbwd AS (SELECT b.name, b.part_idx, b.pt_idx, min({_D2}) AS d2 FROM placed a JOIN placed b ON a.name=b.name GROUP BY ALL),
scd AS (SELECT name, avg(cd) AS shape_cd FROM (
  SELECT name, part_idx, avg(f.d2 + w.d2) AS cd FROM sfwd f JOIN sbwd w USING (name, part_idx, pt_idx) GROUP BY ALL) GROUP BY name),
kerr AS (SELECT name, avg(t_rmse) AS rmse_t, avg(r_rmse) AS rmse_r FROM err {_KEEP} GROUP BY name),
report AS (SELECT name, CAST(count(*) FILTER (chamfer < 0.01) AS DOUBLE)/count(*) AS part_acc,
  any_value(rmse_t) AS rmse_t, any_value(rmse_r) AS rmse_r, any_value(shape_cd) AS shape_cd
  FROM pcd JOIN kerr USING (name) JOIN scd USING (name) GROUP BY name)"""
REPORT = f"WITH {duck.PTS_POSE}, {ERR}, {_REPORT_SQL}"
REPORT_COLS = ("part_acc", "rmse_t", "rmse_r", "shape_cd")


def report(spark, sf):
    from ..plans.evaluate import evaluation_report

    return evaluation_report(
        fx.points(spark, sf), fx.poses(spark, sf), part_sizes(spark, sf), F.col("redundancy")
    )


@query("d07_evaluation_report", f"{REPORT} SELECT name, {duck.rs(REPORT_COLS, REPORT_COLS)} FROM report")
def evaluation_report_query(spark, sf):
    return report(spark, sf).select("name", *rounded(map(F.col, REPORT_COLS), REPORT_COLS))


@query(
    "p18_display_units",
    f"{REPORT} SELECT name, {duck.rs(('part_acc', 'rmse_t*1e2', 'rmse_r', 'shape_cd*1e3'), REPORT_COLS)} FROM report",
)
def display_units(spark, sf):
    df = M.display_units(report(spark, sf))
    return df.select("name", *rounded(map(F.col, REPORT_COLS), REPORT_COLS))


@query("a16_run_summary", f"{REPORT} SELECT {duck.rs([f'avg({c})' for c in REPORT_COLS], REPORT_COLS)} FROM report")
def run_summary(spark, sf):
    return M.run_summary(report(spark, sf)).select(*rounded(map(F.col, REPORT_COLS), REPORT_COLS))


@query(
    "a17_leaderboard",
    f"""{REPORT}, b AS (SELECT name % 2 AS dataset, name % 3 AS subset, part_idx % 2 AS model, t_rmse, r_rmse, chamfer
      FROM err JOIN pcd USING (name, part_idx))
    SELECT dataset, subset, model, count(*) AS n, {duck.rs(['avg(t_rmse)', 'avg(r_rmse)', 'avg(CASE WHEN chamfer < 0.01 THEN 1.0 ELSE 0.0 END)'], ['rmse_t', 'rmse_r', 'part_acc'])}
    FROM b GROUP BY dataset, subset, model""",
)
def leaderboard(spark, sf):
    from ..plans.evaluate import leaderboard as board

    chamfer = M.part_chamfer(_without_redundant(spark, sf))
    rows = fx.poses(spark, sf).join(chamfer, M.PART).select(
        (F.col("name") % 2).alias("dataset"), (F.col("name") % 3).alias("subset"),
        (F.col("part_idx") % 2).alias("model"),
        M.translation_error(M.pr_t(), M.gt_t()).alias("rmse_t"),
        M.rotation_error(M.pr_q(), M.gt_q()).alias("rmse_r"),
        (F.col("chamfer") < M.PART_CD_THRESHOLD).cast("double").alias("part_acc"),
    )
    cols = ("rmse_t", "rmse_r", "part_acc")
    return board(rows, cols).select(
        "dataset", "subset", "model", "n", *rounded(map(F.col, cols), cols)
    )
