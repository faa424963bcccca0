"""Thinning in tasks and by joins, draws of a piece as arrays, and what even sampling computes once."""

import math
import random

import numpy as np
from pyspark.sql import Row, functions as F

from sherdloom.catalog import clouds
from sherdloom.functions import tables
from sherdloom.functions.rand import key_of, keys_of, uniform_of, uniforms_of
from sherdloom.operators import sampling
from sherdloom.operators.thinning import thin


def _points(spark, parts=12):
    rng = random.Random(8)
    rows = []
    for p in range(parts):
        for k in range(rng.randrange(1, 120)):
            at = [rng.choice([0.0, rng.uniform(-2, 2)]) for _ in "xyz"]
            rows.append((p // 5, p % 5, k, *at, 0.2 + 0.1 * p, f"row {k}"))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "name long, part_idx long, pt_idx long, x double, y double, z double, radius double, tag string")


def _rounds(points, key, radius):
    """The rounds of one part, spelled out."""
    cells = {}
    for i in sorted(range(len(points)), key=lambda i: (key[i], i)):
        cells.setdefault(tuple(math.floor(c / radius) for c in points[i]), []).append(i)

    def near(i, others):
        return [o for o in others if sum((a - b) ** 2 for a, b in zip(points[i], points[o])) < radius * radius]

    kept = set()
    while cells:
        ahead = [held[0] for held in cells.values()]
        chosen = [i for i in ahead if all((key[i], i) <= (key[o], o) for o in near(i, ahead))]
        kept |= set(chosen)
        cells = {c: left for c, held in cells.items() if (left := [i for i in held if not near(i, chosen)])}
    return kept


def test_array_rounds_are_the_rounds():
    rng = np.random.default_rng(3)
    part, xyz, radius, key = [], [], [], []
    for p in range(9):
        n = int(rng.integers(1, 90))
        part += [p] * n
        xyz.append(rng.uniform(-2, 2, (n, 3)) * (1, 1, 0 if p % 2 else 1))
        radius += [(0.1, 0.5, 3.0)[p % 3]] * n
        key += rng.integers(0, 5 if p == 4 else 1 << 60, n).tolist()
    part, xyz, radius, key = np.array(part), np.concatenate(xyz), np.array(radius), np.array(key)
    got = thin(part, np.arange(len(part)), key, xyz, radius)
    for p in range(9):
        own = np.flatnonzero(part == p)
        assert set(np.flatnonzero(got[own])) == _rounds(xyz[own].tolist(), key[own].tolist(), radius[own][0]), p


def test_parts_are_thinned_in_a_task_and_large_ones_by_joins(spark, monkeypatch):
    points = _points(spark)
    tags, real = [], sampling.materialize
    monkeypatch.setattr(sampling, "materialize", lambda df, tag: tags.append(tag) or real(df, tag))
    got = sorted(map(tuple, sampling.thin_out(points, 7).collect()))
    assert "ahead" not in tags and 0 < len(got) < points.count()
    monkeypatch.setattr(sampling, "_HELD_POINTS", 1)  # parts that go on in the next batch
    assert sorted(map(tuple, sampling.thin_out(points, 7).collect())) == got
    monkeypatch.setattr(sampling, "PART_POINTS", 50)
    assert sorted(map(tuple, sampling.thin_out(points, 7).collect())) == got and "ahead" in tags
    sizes = points.groupBy("name", "part_idx").agg(F.count("*").alias("_n"))
    for limit in (50, 1000):
        monkeypatch.setattr(sampling, "PART_POINTS", limit)
        placed = {}
        for r in sampling._thinned(points, sizes, 7).collect():
            placed.setdefault((r.name, r.part_idx), []).append((r.pt_idx, r["_r"]))
        assert all([p[1] for p in sorted(held)] == list(range(len(held))) for held in placed.values())


def test_even_sampling_spreads_its_points_once(spark, monkeypatch):
    spread, weighed = [], []
    real_spread, real_weights = sampling.spread_points, sampling.face_weights
    monkeypatch.setattr(sampling, "spread_points", lambda *a, **k: spread.append(1) or real_spread(*a, **k))
    monkeypatch.setattr(sampling, "face_weights", lambda *a, **k: weighed.append(1) or real_weights(*a, **k))
    rows = clouds.even_invariants(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.numbered and r.spaced and r.on_surface for r in rows)
    assert (len(spread), len(weighed)) == (1, 1)


def test_draws_of_numbers_below_n():
    assert keys_of(5, 300, "even", 12, "a b").tolist() == [key_of(5, "even", 12, "a b", k) for k in range(300)]
    assert uniforms_of(5, 300, "u", None).tolist() == [uniform_of(5, "u", None, k) for k in range(300)]
    assert len(keys_of(5, 0, "u")) == len(uniforms_of(5, -2, "u")) == 0


def test_faces_are_read_by_place(monkeypatch):
    """A row's names are looked up once a call, whatever order and further columns the table has."""
    rng = np.random.default_rng(2)
    columns = ["more", *reversed(tables.FACE_COLUMNS)]
    rows = []
    for k in range(30):
        values = {"more": "x", "name": "n", "part_idx": 3, "f_idx": 29 - k, "n_points": 40, "area": (None, 0.0, 1.5)[min(k, 2)]}
        values |= {c: float(v) for c, v in zip(tables.FACE_COLUMNS[5:], rng.uniform(size=12))}
        rows.append(Row(**{c: values[c] for c in columns}))
    picked = []
    real = tables.itemgetter
    monkeypatch.setattr(tables, "itemgetter", lambda *at: picked.append(at) or real(*at))
    for strategy in tables.STRATEGIES:
        call = tables.SampleSurface()
        for row in rows:
            call.eval(row, strategy, 1116)
        points = list(call.terminate())
        assert [p[:3] for p in points] == [("n", 3, k) for k in range(40)]
        by_face = {r.f_idx: r for r in rows}
        assert all(by_face[p[3]].area == 1.5 and p[7:] == tuple(by_face[p[3]][c] for c in ("fnx", "fny", "fnz")) for p in points)
    assert len(picked) == 2
