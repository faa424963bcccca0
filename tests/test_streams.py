"""Progress streams: decoding, runs that end or fall silent, epochs that close once, state that goes."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sherdloom.session import fresh_path
from sherdloom.streaming import progress

START = datetime(2024, 5, 1, 8)


def poses(step, iter_=0, parts=2, at=0.0):
    return {"type": "transformation", "data": {
        "translation": [[at, float(p), 0.0] for p in range(parts)], "rotation": [[1, 0, 0, 0]] * parts, "step": step, "iter": iter_,
    }}


class Arrivals:
    """A folder that messages arrive in, and a stream over it that is resumed after each portion."""

    def __init__(self, spark, build):
        self.spark, self.build, self.seq = spark, build, 0
        self.folder, self.out, self.state = (fresh_path(spark, t) for t in ("in", "out", "state"))

    def send(self, *messages):
        rows = []
        for run, minute, body in messages:
            text = body if isinstance(body, str) or body is None else json.dumps(body)
            rows.append((run, self.seq, START + timedelta(minutes=minute), text))
            self.seq += 1
        df = self.spark.createDataFrame(rows, progress.MESSAGE).coalesce(1)
        df.write.mode("append").parquet(self.folder)
        stream = self.build(progress.typed_progress(progress.read_messages(self.spark, self.folder)))
        progress.run_available(stream, "append", self.out, self.state)
        return progress.written(stream, "append", self.out, []).collect()

    def held(self, variable):
        reader = self.spark.read.format("statestore").option("path", self.state).option("stateVarName", variable)
        return reader.load().count()


@pytest.mark.parametrize("message, kind, error", [
    ({"type": "mesh_scale", "data": 2.5}, "mesh_scale", None),
    ({"type": "mesh_scale", "data": "wide"}, "mesh_scale", "no scale"),
    (poses(3), "transformation", None),
    ({"type": "transformation", "data": {"translation": [[0, 0, 0]], "step": 1, "iter": 1}}, "transformation", "incomplete poses"),
    ({"type": "transformation", "data": {"translation": [[0, 0]], "rotation": [[1, 0, 0, 0]], "step": 1, "iter": 1}}, "transformation", "incomplete poses"),
    ({"type": "fracture_segmentation", "data": [[[0, 0, 0]], []]}, "fracture_segmentation", None),
    ({"type": "fracture_segmentation", "data": None}, "fracture_segmentation", "no points"),
    ({"type": "metrics", "data": {"Part Accuracy": 0.5}}, "metrics", None),
    ({"type": "metrics", "data": {}}, "metrics", "no metrics"),
    ({"type": "input", "data": {"pointclouds": [[]], "initial_translation": [[0, 0, 0]], "initial_rotation": [[1, 0, 0, 0]]}}, "input", None),
    ({"type": "input", "data": {"pointclouds": [[]]}}, "input", "incomplete input"),
    ({"type": "end", "data": None}, "end", None),
    ({"type": "restart"}, None, "unknown type"), ({"data": 1}, None, "unknown type"), ("[1, 2]", None, "unknown type"),
    ('{"type": "end"', None, "not JSON"), ("", None, "not JSON"), (None, None, "not JSON"),
])
def test_messages_are_decoded_by_type(spark, message, kind, error):
    text = message if isinstance(message, str) or message is None else json.dumps(message)
    rows = spark.createDataFrame([(1, 2, START, text)], progress.MESSAGE)
    got = progress.typed_progress(rows).first()
    assert (got.run_id, got.seq, got.type, got.error) == (1, 2, kind, error)
    if error is None and kind == "transformation":
        assert (got.iter, got.step) == (0, 3) and [(p.part_idx, p.t, p.q) for p in got.poses] == [
            (0, [0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0], [1.0, 0.0, 0.0, 0.0])
        ]
    assert got.points == ([1, 0] if kind == "fracture_segmentation" and not error else [0] if kind == "input" and not error else None)
    assert got.part_accuracy == (0.5 if kind == "metrics" and not error else None)


def test_runs_give_their_newest_poses_once_and_leave_no_state(spark):
    a = Arrivals(spark, progress.latest_poses)
    assert a.send((7, 0, poses(5, at=5.0)), (7, 1, poses(2, 1, at=21.0)), (8, 1, poses(1)), (7, 2, poses(9, at=9.0))) == []
    assert a.held("run") == 2 and a.held("poses") == 4
    rows = a.send((7, 3, poses(1, 1, parts=1, at=11.0)), (7, 4, {"type": "end", "data": None}), (8, 5, "broken"), (8, 6, {"type": "end"}))
    # (iter, step) decides, not the time of arrival.
    assert sorted((r.run_id, r.part_idx, r.iter, r.step, r.t[0], r.n_events, r.ended) for r in rows) == [
        (7, 0, 1, 2, 21.0, 5, True), (7, 1, 1, 2, 21.0, 5, True), (8, 0, 0, 1, 0.0, 2, True), (8, 1, 0, 1, 0.0, 2, True),
    ]
    assert a.held("run") == 0 and a.held("poses") == 0
    # The same id opens a new run: what it held before does not count any more.
    rows = a.send((7, 5, poses(0, 0, parts=1, at=1.0)), (7, 6, {"type": "end"}))
    assert [(r.part_idx, r.iter, r.step, r.n_events) for r in rows if r.opened == START + timedelta(minutes=5)] == [(0, 0, 0, 2)]


def test_silent_runs_are_closed_by_a_timer(spark):
    a = Arrivals(spark, progress.latest_poses)
    assert a.send((1, 0, poses(4, parts=1))) == []
    rows = a.send((2, 100, poses(4, parts=1)))  # another run moves the watermark past the gap
    assert [(r.run_id, r.ended, r.n_events) for r in rows] == [(1, False, 1)]
    assert a.held("run") == 1
    rows = a.send((2, 140, poses(1, parts=1, at=3.0)), (2, 141, {"type": "end"}))  # silence within one portion
    assert sorted((r.run_id, r.step, r.ended) for r in rows) == [(1, 4, False), (2, 1, True), (2, 4, False)]
    assert a.held("run") == 0


def test_epochs_close_once(spark):
    a = Arrivals(spark, progress.epoch_accumulators)
    metrics = lambda v: {"type": "metrics", "data": {"Part Accuracy": v}}
    assert a.send((1, 0, metrics(0.5)), (2, 60, metrics(1.0)), (2, 61, {"type": "metrics", "data": {}})) == []
    rows = a.send((1, 24 * 60, metrics(0.0)))
    assert [(r.epoch.day, r.n, r.part_accuracy, r.rmse_r) for r in rows] == [(1, 2, 0.75, None)]
    rows = a.send((1, 3 * 24 * 60, metrics(0.25)), (1, 24 * 60 + 1, metrics(1.0)))  # in the epoch that is open still
    assert sorted((r.epoch.day, r.n, r.part_accuracy) for r in rows) == [(1, 2, 0.75), (2, 2, 0.5)]
    state = spark.read.format("statestore").load(a.state)
    assert state.count() == 1  # the open epoch


def test_messages_of_the_fixture(spark):
    from sherdloom import fixtures

    got = progress.typed_progress(fixtures.messages(spark, "/root/testdata/sf0.001"))
    kinds = {r["type"]: r["count"] for r in got.groupBy("type").count().collect()}
    assert set(kinds) == {*progress.EVENT_TYPES, None}
    assert {r.error for r in got.where(F.col("error").isNotNull()).collect()} == {"not JSON", "unknown type", "incomplete poses"}


def test_messages_are_built_by_many_tasks(spark):
    """A file of events is one task; the messages of a portion are dealt over several, with the same rows."""
    from sherdloom import fixtures as fx

    plain, dealt = (fx.messages(spark, "/root/testdata/sf0.001", spread=s) for s in (False, True))
    assert "REPARTITION_BY_COL" in dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, dealt.collect()))
