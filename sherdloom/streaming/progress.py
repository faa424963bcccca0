"""Live progress of assembly runs as Structured Streaming jobs.

The reference behaviour has no time axis, so the event-time rules are ours: a
10 minute watermark everywhere, 1 hour metric windows, 30 minute run gap.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WATERMARK = "10 minutes"
METRIC_WINDOW = "1 hour"
EPOCH = "1 day"
RUN_GAP = "30 minutes"
_GAP = 30 * 60 * 10**6  # the same in microseconds
EVENT_TYPES = (  # fixed values
    "mesh_scale", "input", "transformation", "fracture_segmentation", "metrics", "end",
)
# Names of the metrics in a message.
METRICS = {
    "part_accuracy": "Part Accuracy", "shape_cd": "Shape CD (10<sup>-3</sup>)",
    "rmse_r": "RMSE(R) (Degrees)", "rmse_t": "RMSE(T) (10<sup>-2</sup>)",
}

# A message is JSON text: its type and, under ``data``, what that type carries.
MESSAGE = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("message", T.StringType()),
    ]
)


def read_messages(spark: SparkSession, folder: str, files: str = "*.parquet", per_trigger: int = 1000) -> DataFrame:
    """Message files of a folder as a stream."""
    return (
        spark.readStream.schema(MESSAGE)
        .option("pathGlobFilter", files)
        .option("maxFilesPerTrigger", per_trigger)
        .parquet(folder)
    )


def typed_progress(messages: DataFrame) -> DataFrame:
    """Messages decoded by type; ``error`` says why a message could not be, else it is null.

    Columns that a type does not carry are null: ``scale``; ``poses`` with ``iter`` and ``step``;
    ``points``, the number of points of every part, of inputs and segmentations; the metrics.
    """
    parsed = messages.withColumn("_v", F.try_parse_json("message"))
    kind = F.try_variant_get("_v", "$.type", "string")
    parsed = parsed.withColumn("type", F.when(kind.isin(*EVENT_TYPES), kind))

    def data(path: str, of: str, *types: str) -> Column:
        return F.when(F.col("type").isin(*types), F.try_variant_get("_v", "$.data" + path, of))

    numbers, clouds = "array<array<double>>", "array<array<array<double>>>"
    fields = {
        "scale": data("", "double", "mesh_scale"),
        "iter": data(".iter", "int", "transformation"),
        "step": data(".step", "int", "transformation"),
        "_t": F.coalesce(data(".translation", numbers, "transformation"), data(".initial_translation", numbers, "input")),
        "_q": F.coalesce(data(".rotation", numbers, "transformation"), data(".initial_rotation", numbers, "input")),
        "_c": F.coalesce(data(".pointclouds", clouds, "input"), data("", clouds, "fracture_segmentation")),
        **{name: data(f"['{text}']", "double", "metrics") for name, text in METRICS.items()},
    }
    decoded = parsed.withColumns(fields)
    whole = (F.size("_t") == F.size("_q")) & F.forall("_t", lambda x: F.size(x) == 3) & F.forall("_q", lambda x: F.size(x) == 4)
    pose = F.transform(
        "_t", lambda t, i: F.struct(i.alias("part_idx"), t.alias("t"), F.get("_q", i).alias("q"))
    )
    no = F.lit(False)
    broken = (
        F.when(F.col("_v").isNull(), F.lit("not JSON"))
        .when(F.col("type").isNull(), F.lit("unknown type"))
        .when((F.col("type") == "mesh_scale") & F.col("scale").isNull(), F.lit("no scale"))
        .when((F.col("type") == "input") & ~(F.coalesce(whole, no) & F.col("_c").isNotNull()), F.lit("incomplete input"))
        .when(
            (F.col("type") == "transformation") & ~(F.coalesce(whole, no) & F.col("iter").isNotNull() & F.col("step").isNotNull()),
            F.lit("incomplete poses"),
        )
        .when((F.col("type") == "fracture_segmentation") & F.col("_c").isNull(), F.lit("no points"))
        .when((F.col("type") == "metrics") & F.coalesce(*METRICS).isNull(), F.lit("no metrics"))
    )
    return decoded.select(
        "run_id", "seq", "ts", "type", "scale", "iter", "step",
        F.when(F.coalesce(whole, no), pose).alias("poses"),
        F.when(broken.isNull(), F.transform("_c", F.size)).alias("points"), *METRICS, broken.alias("error"),
    )


POSE_STATE = "iter int, step int, seq long, t array<double>, q array<double>"
LATEST_POSE = (
    "run_id long, opened long, part_idx int, iter int, step int, t array<double>, q array<double>, n_events long, ended boolean"
)


class LatestPoses(StatefulProcessor):
    """The newest pose of every part of a run, given out when the run ends.

    A run ends with its 'end' event, or when it was silent for RUN_GAP: a later event then
    opens a new run, and without one an event-time timer closes it.  State holds open runs only.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.poses = handle.getMapState("poses", "part_idx int", POSE_STATE)
        self.run = handle.getValueState("run", "opened long, last long, n long")

    def _close(self, run_id, run, poses, ended: bool) -> Iterator[Row]:
        for part, (iter_, step, _, t, q) in sorted(poses.items()):
            yield Row(
                run_id=run_id, opened=run[0], part_idx=part, iter=iter_, step=step, t=t, q=q, n_events=run[2], ended=ended
            )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        run = tuple(self.run.get()) if self.run.exists() else None
        poses = {k[0]: tuple(v) for k, v in self.poses.iterator()} if run else {}
        for row in sorted(rows, key=lambda r: (r.at, r.seq)):
            if run and row.at - run[1] > _GAP:
                yield from self._close(key[0], run, poses, False)
                run, poses = None, {}
            run = (run[0], max(run[1], row.at), run[2] + 1) if run else (row.at, row.at, 1)
            if row.type == "transformation":
                for p in row.poses:
                    new = (row.iter, row.step, row.seq, list(p["t"]), list(p["q"]))
                    if p["part_idx"] not in poses or poses[p["part_idx"]][:3] < new[:3]:
                        poses[p["part_idx"]] = new
            elif row.type == "end":
                yield from self._close(key[0], run, poses, True)
                run, poses = None, {}
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.poses.clear()
        if run is None:
            self.run.clear()
        else:
            self.run.update(run)
            for part, pose in poses.items():
                self.poses.updateValue((part,), pose)
            self.handle.registerTimer((run[1] + _GAP) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.run.exists():
            poses = {k[0]: tuple(v) for k, v in self.poses.iterator()}
            yield from self._close(key[0], tuple(self.run.get()), poses, False)
            self.run.clear()
            self.poses.clear()

    def close(self) -> None:
        pass


def latest_poses(progress: DataFrame) -> DataFrame:
    """Newest pose per run and part: a later (iter, step) replaces an earlier one.

    What a trigger brings of one run is sorted by its task; ``per_trigger`` of the reader bounds it.
    """
    spark = progress.sparkSession
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    good = progress.withWatermark("ts", WATERMARK).where("error IS NULL")
    events = good.select("run_id", "seq", "ts", F.unix_micros("ts").alias("at"), "type", "iter", "step", "poses")
    found = events.groupBy("run_id").transformWithState(
        statefulProcessor=LatestPoses(), outputStructType=LATEST_POSE, outputMode="append", timeMode="eventTime"
    )
    return found.withColumn("opened", F.timestamp_micros("opened"))


def epoch_accumulators(progress: DataFrame) -> DataFrame:
    """Evaluation means of an epoch (a day here), given out once when the watermark passes its end.

    Tasks add up before the shuffle, so a busy epoch is no hot key; state holds open epochs only.
    """
    metrics = progress.withWatermark("ts", WATERMARK).where("error IS NULL AND type = 'metrics'")
    return metrics.groupBy(F.window("ts", EPOCH)).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in METRICS]
    ).select(F.to_date("window.start").alias("epoch"), "n", *METRICS)


def metric_windows(progress: DataFrame) -> DataFrame:
    """Step metrics averaged per tumbling window, final once the watermark passes."""
    w = F.window("ts", METRIC_WINDOW)
    return (
        progress.withWatermark("ts", WATERMARK)
        .where("error IS NULL AND type = 'metrics'")
        .groupBy(w)
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in METRICS])
        .select(F.col("window.start").alias("start"), "n", *METRICS)
    )


def run_sessions(progress: DataFrame) -> DataFrame:
    """Run lifecycle: opens with its first event, closes by a gap; ``ended`` if it said so."""
    return (
        progress.withWatermark("ts", WATERMARK)
        .where("error IS NULL")
        .groupBy(F.session_window("ts", RUN_GAP), "run_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max((F.col("type") == "end").cast("int")).cast("boolean").alias("ended"),
        )
        .select(F.col("session_window.start").alias("opened"), "run_id", "n", "ended")
    )


def run_available(stream: DataFrame, mode: str, out: str, state: str) -> None:
    """Process everything that has arrived, write it below ``out`` and stop.

    Append output is written as it comes.  In update and complete mode every
    micro-batch goes to a folder of its own number; overwriting that folder makes
    a replayed batch harmless.
    """
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option(
        "checkpointLocation", state
    )
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:

        def save(batch: DataFrame, number: int) -> None:
            batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(
                f"{out}/batch={number}"
            )

        query = writer.foreachBatch(save).start()
    query.awaitTermination()


def written(stream: DataFrame, mode: str, out: str, keys: list[str]) -> DataFrame:
    """What a stream has written so far; outside append mode the newest row per key."""
    spark = stream.sparkSession
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "_batch").alias("_r"))
    return newest.select("_r.*")
