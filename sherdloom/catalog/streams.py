"""Progress streams.  The events arrive in three portions; the query is resumed
from its checkpoint after each, so state crosses runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..session import fresh_path
from ..streaming import progress as PR
from . import duck
from .poses import rounded
from .registry import query

PORTIONS = 3


def resumed(spark, sf, build, mode, keys=()):
    """What a stream writes of all messages, which arrive in portions of event time."""
    folder, out, state = (fresh_path(spark, t) for t in ("arrivals", "stream", "stream-state"))
    rows = fx.messages(spark, sf)
    first, last = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    portion = F.floor((F.unix_micros("ts") - first) * PORTIONS / (last - first + 1))
    rows = fx.messages(spark, sf, spread=True)
    stream = None
    for n in range(PORTIONS):
        rows.where(portion == n).write.mode("append").parquet(folder)
        stream = build(PR.typed_progress(PR.read_messages(spark, folder)))
        PR.run_available(stream, mode, out, state)
    return PR.written(stream, mode, out, list(keys))


_TYPE = """CASE event_type WHEN 'view' THEN 'transformation' WHEN 'click' THEN 'fracture_segmentation'
  WHEN 'purchase' THEN 'metrics' WHEN 'error' THEN 'end' ELSE CASE WHEN k % 2 = 0 THEN 'mesh_scale' ELSE 'input' END END"""
PROG = f"""raw AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, event_id % 97 AS lacks FROM events),
told AS (SELECT user_id AS run_id, event_id AS seq, ts, k, value, {_TYPE} AS said,
  CASE WHEN lacks = 5 THEN 'not JSON' WHEN lacks = 6 THEN 'unknown type'
    WHEN lacks = 7 AND event_type = 'view' THEN 'incomplete poses' END AS error FROM raw),
prog AS (SELECT * EXCLUDE (said), CASE WHEN error IS NULL OR error = 'incomplete poses' THEN said END AS type FROM told),
good AS (SELECT * FROM prog WHERE error IS NULL)"""
_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM prog)"
_MEASURED = {"part_accuracy": "value/100", "shape_cd": "value*2", "rmse_r": "k", "rmse_t": "k/10.0::DOUBLE"}
_PARTS = "range(0, k % 3 + 1)"
_POINTS = f"list_transform({_PARTS}, lambda p: (k + p) % 4 + 1)"


@query(
    "st01_typed_progress",
    f"""WITH {PROG} SELECT run_id, seq, type, error, {duck.r("CASE WHEN type = 'mesh_scale' THEN value END", 'scale')},
    CASE WHEN type = 'transformation' THEN CAST(k // 21 AS INT) END AS iter, CASE WHEN type = 'transformation' THEN CAST(k % 21 - 1 AS INT) END AS step,
    CASE WHEN error IS NULL AND type IN ('input', 'transformation') THEN CAST(k % 3 + 1 AS INT) END AS n_poses,
    {duck.r(f"CASE WHEN error IS NULL AND type IN ('input', 'transformation') THEN list_sum(list_transform({_PARTS}, lambda p: (p+1)*(value + p + 2*k + 3*p + 4 + 5*p/10.0::DOUBLE + 6*k/100.0::DOUBLE + 7*value/100))) END", 'pose_sum')},
    CASE WHEN type IN ('input', 'fracture_segmentation') THEN array_to_string({_POINTS}, ',') END AS points,
    {', '.join(duck.r(f"CASE WHEN type = 'metrics' THEN {v} END", m) for m, v in _MEASURED.items())} FROM prog""",
)
def typed_progress(spark, sf):
    df = resumed(spark, sf, lambda p: p, "append")
    weights = F.array(*[F.lit(float(k)) for k in range(1, 8)])
    dot = lambda p: F.aggregate(F.zip_with(F.concat(p["t"], p["q"]), weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    poses = F.aggregate("poses", F.lit(0.0), lambda acc, p: acc + (p["part_idx"] + 1) * dot(p))
    return df.select(
        "run_id", "seq", "type", "error", "iter", "step",
        F.size("poses").alias("n_poses"), F.array_join(F.transform("points", lambda n: n.cast("string")), ",").alias("points"),
        *rounded([F.col("scale"), poses, *map(F.col, PR.METRICS)], ("scale", "pose_sum", *PR.METRICS)),
    )


@query(
    "st02_latest_pose",
    f"""WITH {PROG}, opens AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(type) OVER w = 'end' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh
      FROM good WINDOW w AS (PARTITION BY run_id ORDER BY ts, seq)),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts, seq) AS sid FROM opens),
    spans AS (SELECT run_id, sid, min(ts) AS opened, count(*) AS n_events, bool_or(type = 'end') AS ended, max(ts) AS last FROM runs GROUP BY run_id, sid),
    over AS (SELECT * FROM spans WHERE ended OR last + INTERVAL 30 MINUTE <= {_CLOSED} OR sid < (SELECT max(sid) FROM spans x WHERE x.run_id = spans.run_id)),
    moves AS (SELECT run_id, sid, seq, k, value, k // 21 AS iter, k % 21 - 1 AS step, unnest({_PARTS}) AS part_idx FROM runs WHERE type = 'transformation'),
    newest AS (SELECT *, row_number() OVER (PARTITION BY run_id, sid, part_idx ORDER BY iter DESC, step DESC, seq DESC) AS rn FROM moves)
    SELECT run_id, opened, CAST(part_idx AS INT) AS part_idx, CAST(iter AS INT) AS iter, CAST(step AS INT) AS step, n_events, ended,
      {duck.rs(['value + part_idx', 'k', 'part_idx', '1', 'part_idx/10.0::DOUBLE', 'k/100.0::DOUBLE', 'value/100'], ('tx', 'ty', 'tz', 'qw', 'qx', 'qy', 'qz'))}
    FROM newest JOIN over USING (run_id, sid) WHERE rn = 1""",
)
def latest_pose(spark, sf):
    df = resumed(spark, sf, PR.latest_poses, "append")
    names = ("tx", "ty", "tz", "qw", "qx", "qy", "qz")
    values = [F.col("t")[i] for i in range(3)] + [F.col("q")[i] for i in range(4)]
    return df.select(
        "run_id", F.col("opened").cast("timestamp_ntz").alias("opened"), "part_idx", "iter", "step", "n_events", "ended",
        *rounded(values, names),
    )


@query(
    "st03_epoch_accumulators",
    f"""WITH {PROG} SELECT CAST(ts AS DATE) AS epoch, count(*) AS n, {', '.join(duck.r(f'avg({v})', m) for m, v in _MEASURED.items())}
    FROM good WHERE type = 'metrics' GROUP BY 1 HAVING CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS TIMESTAMP) <= {_CLOSED}""",
)
def epoch_accumulators(spark, sf):
    df = resumed(spark, sf, PR.epoch_accumulators, "append")
    return df.select("epoch", "n", *rounded(map(F.col, PR.METRICS), PR.METRICS))


@query(
    "st04_metric_windows",
    f"""WITH {PROG} SELECT date_trunc('hour', ts) AS start, count(*) AS n, {', '.join(duck.r(f'avg({v})', m) for m, v in _MEASURED.items())}
    FROM good WHERE type = 'metrics' GROUP BY 1 HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= {_CLOSED}""",
)
def metric_windows(spark, sf):
    df = resumed(spark, sf, PR.metric_windows, "append")
    return df.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", *rounded(map(F.col, PR.METRICS), PR.METRICS))


@query(
    "st05_run_sessions",
    f"""WITH {PROG}, s AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts, seq) AS sid FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY run_id ORDER BY ts, seq) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM good))
    SELECT min(ts) AS opened, run_id, count(*) AS n, bool_or(type = 'end') AS ended FROM s GROUP BY run_id, sid
    HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}""",
)
def run_sessions(spark, sf):
    df = resumed(spark, sf, PR.run_sessions, "append")
    return df.select(F.col("opened").cast("timestamp_ntz").alias("opened"), "run_id", "n", "ended")
