"""Joins that grow with the tables: what is broadcast, vertices by block, ranks across partitions."""

import random

from pyspark.sql import functions as F

from sherdloom import fixtures
from sherdloom.operators import contact, mesh, ordering, removal, sampling
from sherdloom.session import materialize, tune, tune_tables
from sherdloom.sources import mesh_files


def test_a_table_of_small_files_is_not_broadcast(spark):
    """Repeated values pack a million rows into a few hundred kB, which a driver would unpack."""
    mixed = F.pmod(F.xxhash64("id"), F.lit(350))
    rows = spark.range(1_000_000).select(mixed.alias("k"), F.lit(1.0).alias("x"), F.floor(mixed / 7).alias("y"))
    kept = spark.conf.get("spark.sql.sources.fileCompressionFactor")
    try:
        tune_tables(spark)
        held = materialize(rows, "packed")
        plan = held.join(held.select("k", F.col("y").alias("z")), "k")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", kept)
        tune(spark)


def _piece(part, numbers, corners, shift=0.0):
    return [(1, part, v, float(v % 50), float(v // 50), shift) for v in numbers], [(1, part, k, *c) for k, c in enumerate(corners)]


def _frames(spark, made):
    v = spark.createDataFrame([r for m in made for r in m[0]], "name long, part_idx long, v_idx long, x double, y double, z double")
    f = spark.createDataFrame([r for m in made for r in m[1]], "name long, part_idx long, f_idx long, a long, b long, c long")
    return v, f


def test_faces_across_blocks_and_gaps(spark):
    """Faces of one block, of several, of numbers with gaps, and with a corner that is missing."""
    rng = random.Random(5)
    dense, gaps = range(3000), sorted(rng.sample(range(5000), 2000))
    made = [
        _piece(0, dense, [tuple(rng.sample(dense, 3)) for _ in range(200)] + [(k, k + 1, k + 51) for k in range(0, 2900, 50)]),
        _piece(1, gaps, [tuple(rng.sample(gaps, 3)) for _ in range(200)] + [(0, 1, 4999)]),
    ]
    v, f = _frames(spark, made)
    at = {(r[1], r[2]): r[3:] for m in made for r in m[0]}
    found = {(r.part_idx, r.f_idx): r for r in mesh.face_geometry(v, f).collect()}
    spots = {}
    for (part, _), p in at.items():
        spots.setdefault(p, set()).add(part)
    shared = set()
    for m in made:
        for _, part, f_idx, *corners in m[1]:
            places = [at.get((part, c)) for c in corners]
            r = found.get((part, f_idx))
            assert (r is None) == all(p is None for p in places)
            if r is not None:
                assert [(r[f"{q}x"], r[f"{q}y"], r[f"{q}z"]) for q in "abc"] == [p or (None,) * 3 for p in places]
            if None not in places:
                shared |= {(part, f_idx, o) for o in set.intersection(*[spots[p] for p in places]) - {part}}
    assert {tuple(r)[1:] for r in contact.shared_faces(v, f).collect()} == shared and shared


def test_rank_goes_on_across_partitions(spark):
    """A key that fills many range partitions is numbered through; null keys are left out."""
    rows = [("big", k % 1000, k) for k in range(20_000)] + [("a", 0, 1), ("a", 0, 0), ("z", 5, 5), (None, 1, 1)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "key string, v long, id long").repartition(5)
    got = {(r["key"], r["id"]): r["rank"] for r in ordering.with_rank(df, ["key"], ["v", "id"]).collect()}
    want = {}
    for key in ("big", "a", "z"):
        want |= {(key, r[2]): n for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]))}
    assert got == want


def test_fixture_faces_are_read_without_a_join(spark):
    f = fixtures.faces(spark, "/root/testdata/sf0.001")
    assert "Join" not in f._jdf.queryExecution().executedPlan().toString()
    v = fixtures.vertices(spark, "/root/testdata/sf0.001").groupBy("name", "part_idx").count()
    faces = f.groupBy("name", "part_idx").agg(F.count("*").alias("n"), F.max("c").alias("last"))
    assert v.join(faces, ["name", "part_idx"], "left").where("coalesce(n, 0) <> greatest(count - 2, 0) OR last <> count - 1").isEmpty()


def test_objects_are_peeled_many_to_a_batch(spark):
    """Objects are rows of one pass, not a cogroup each; the plan is that of each object alone."""
    names = spark.range(300).select(F.col("id").alias("name"))
    line = names.select("name", F.explode(F.sequence(F.lit(0).cast("long"), F.col("name") % 5)).alias("part_idx"))
    edges = line.where("part_idx > 0").select("name", (F.col("part_idx") - 1).alias("i"), F.col("part_idx").alias("j"))
    plan = removal.removal_plan(line.withColumn("prio", F.col("part_idx")), edges)
    assert "CoGroup" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in plan.collect():
        got.setdefault(r.name, []).append((r.step, r.part_idx))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(s, s) for s in range(k % 5)] for k in range(300) if k % 5}


def test_listed_files_are_read_by_many_tasks(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"{k}.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\n")
    listed = spark.createDataFrame([(str(tmp_path / f"{k}.obj"),) for k in range(40)], "path string").coalesce(1)
    rows = mesh_files.read_listed(listed)
    assert rows.select(F.spark_partition_id()).distinct().count() > 1 and rows.count() == 40 * 4


def test_a_point_looks_into_few_blocks_of_cells(spark):
    """No pair is missed or met twice, and points are copied far less than into 27 cells."""
    rng = random.Random(3)
    rows = [(1, 0, k, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(-3, 3), 0.4) for k in range(800)]
    df = spark.createDataFrame(rows, "name long, part_idx long, pt_idx long, x double, y double, z double, radius double")
    want = sorted((p[2], q[2]) for p in rows for q in rows if p[2] < q[2] and sum((p[i] - q[i]) ** 2 for i in (3, 4, 5)) < 0.16)
    assert sorted((r.pt_idx, r.other) for r in sampling.close_pairs(df).collect()) == want
    assert sampling._around(sampling._in_cells(df.withColumn("_h", F.lit(0)))).count() < 8 * 800


def test_a_long_row_of_pieces_is_peeled_in_its_task(spark, monkeypatch):
    """An object of more pieces but few edges is one row too, and its plan needs no search a step."""
    searched = []
    real = removal._removable
    monkeypatch.setattr(removal, "_removable", lambda *a: searched.append(1) or real(*a))
    n = 5000
    assert removal._peel(list(range(n)), [(k, k + 1) for k in range(n - 1)]) == list(range(n - 1))
    assert len(searched) <= 2
    monkeypatch.undo()
    monkeypatch.setattr(removal, "_peel_distributed", None)
    line = spark.range(1500).select(F.lit(7).cast("long").alias("name"), F.col("id").alias("part_idx"), F.col("id").alias("prio"))
    edges = line.where("part_idx > 0").select("name", (F.col("part_idx") - 1).alias("i"), F.col("part_idx").alias("j"))
    plan = removal.removal_plan(line, edges)
    assert sorted((r.step, r.part_idx) for r in plan.collect()) == [(k, k) for k in range(1499)]


def test_faces_of_one_list_are_not_shuffled_again(spark):
    """Strips across blocks are whole in one list; repeated faces count once."""
    made = [_piece(p, range(2100), [(k, k + 1, k + 2) for k in range(2098)] + ([(5, 6, 7)] if p else [])) for p in (0, 1)]
    v, f = _frames(spark, made)
    f = f.unionByName(f.where("f_idx = 1022"))
    found = mesh.face_geometry(v, f)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 2
    assert found.count() == 2098 * 2 + 1
    got = contact.shared_faces(v, f).collect()
    assert len(got) == len(set(got)) == 2098 * 2 + 1
