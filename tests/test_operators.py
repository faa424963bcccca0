"""Operators against brute force on small hand-made inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sherdloom.session import materialize
from sherdloom.functions import curve, rot, schedule
from sherdloom.operators import cloud, contact, mesh, metrics, ordering, packing, removal, sampling
from sherdloom.plans import prepare
from sherdloom.session import fresh_path
from sherdloom.sources import gallery, meshes, splits, store


def cube(name, part, dx=0.0):
    v = [(x + dx, y, z) for x in (0.0, 1.0) for y in (0.0, 1.0) for z in (0.0, 1.0)]
    f = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]
    vs = pd.DataFrame([(name, part, i, *p) for i, p in enumerate(v)], columns=["name", "part_idx", "v_idx", "x", "y", "z"])
    fs = pd.DataFrame([(name, part, i, *t) for i, t in enumerate(f)], columns=["name", "part_idx", "f_idx", "a", "b", "c"])
    return vs, fs


def row_of_cubes(spark, n=3, name=1):
    made = [cube(name, i, float(i)) for i in range(n)]
    return (
        spark.createDataFrame(pd.concat([m[0] for m in made])),
        spark.createDataFrame(pd.concat([m[1] for m in made])),
    )


def test_cube_measures_and_contacts(spark):
    v, f = row_of_cubes(spark, 3)
    m = {r.part_idx: r for r in mesh.piece_measures(v, f).collect()}
    assert all(abs(r.area - 6) < 1e-9 and abs(abs(r.volume) - 1) < 1e-9 for r in m.values())
    edges = {(r.i, r.j) for r in contact.contact_edges(v).collect()}
    assert edges == {(0, 1), (1, 2)}
    shared = contact.shared_faces(v, f)
    counts = {(r.part_idx, r.other): r["count"] for r in shared.groupBy("part_idx", "other").count().collect()}
    assert counts == {(0, 1): 2, (1, 0): 2, (1, 2): 2, (2, 1): 2}
    labelled = contact.label_faces(f, shared)
    assert labelled.where("part_idx = 1 AND shared_with = 2").count() == 2
    graph = {(r.i, r.j) for r in contact.face_contact_edges(labelled).collect()}
    assert graph == {(0, 1), (1, 0), (1, 2), (2, 1)}


def test_tetrahedron_volume_and_scale(spark):
    v = spark.createDataFrame(
        [(1, 0, 0, 0.0, 0.0, 0.0), (1, 0, 1, 4.0, 0.0, 0.0), (1, 0, 2, 0.0, 1.0, 0.0), (1, 0, 3, 0.0, 0.0, 1.0)],
        "name long, part_idx long, v_idx long, x double, y double, z double",
    )
    f = spark.createDataFrame(
        [(1, 0, 0, 0, 2, 1), (1, 0, 1, 0, 1, 3), (1, 0, 2, 0, 3, 2), (1, 0, 3, 1, 2, 3)],
        "name long, part_idx long, f_idx long, a long, b long, c long",
    )
    assert abs(mesh.piece_measures(v, f).first().volume - 4 / 6) < 1e-9
    assert mesh.object_scale(v).first().mesh_scale == 4.0


def test_rounding_is_half_even_and_folds_negative_zero(spark):
    rows = [(1, 0, 0, 0.125, -0.001, 0.0), (1, 1, 0, 0.12, 0.0, 0.0), (1, 2, 0, 0.13, 0.0, 0.0)]
    v = spark.createDataFrame(rows, "name long, part_idx long, v_idx long, x double, y double, z double")
    assert {(r.i, r.j) for r in contact.contact_edges(v, 2).collect()} == {(0, 1)}


def test_components_of_a_long_chain(spark):
    n = 60
    nodes = spark.range(n).select(F.lit(1).alias("name"), F.col("id").alias("part_idx"))
    order = np.random.default_rng(1).permutation(n)
    pairs = [(1, int(min(a, b)), int(max(a, b))) for a, b in zip(order[:40], order[1:40])]
    edges = spark.createDataFrame(pairs, "name int, i long, j long")
    got = {r.part_idx: r.component for r in contact.connected_components(nodes, edges).collect()}
    low = int(order[:40].min())
    assert all(got[int(p)] == low for p in order[:40])
    assert all(got[int(p)] == p for p in order[40:])


def brute_peel(order, edges):
    def whole(alive):
        if not alive:
            return False
        seen, todo = set(), [next(iter(alive))]
        while todo:
            p = todo.pop()
            if p in seen:
                continue
            seen.add(p)
            todo += [b for a, b in edges if a == p and b in alive] + [a for a, b in edges if b == p and a in alive]
        return seen == alive

    alive, out = set(order), []
    for _ in order:
        pick = next((p for p in order if p in alive and whole(alive - {p})), None)
        if pick is None:
            break
        alive.discard(pick)
        out.append(pick)
    return out


GRAPHS = {
    1: ([2, 0, 1, 3], {(0, 1), (1, 2), (2, 3)}),
    2: ([0, 1, 2], set()),
    3: ([1, 0], set()),
    4: ([0, 1, 2], {(0, 1)}),
}


@pytest.mark.parametrize("task_pieces", [1024, 0])
def test_removal_plan_both_ways(spark, task_pieces):
    graphs = GRAPHS if task_pieces else {k: GRAPHS[k] for k in (3, 4)}
    prio = [(k, p, i) for k, (order, _) in graphs.items() for i, p in enumerate(order)]
    edges = [(k, a, b) for k, (_, es) in graphs.items() for a, b in es]
    got = removal.removal_plan(
        spark.createDataFrame(prio, "name long, part_idx long, prio long"),
        spark.createDataFrame(edges, "name long, i long, j long"), task_pieces,
    ).collect()
    for k, (order, es) in graphs.items():
        steps = [r.part_idx for r in sorted(got, key=lambda r: r.step) if r["name"] == k]
        assert steps == brute_peel(order, es), k


def test_removal_plan_over_the_whole_table(spark):
    """The registered query against the sequential rule, object by object."""
    from sherdloom import fixtures
    from sherdloom.catalog import meshes as queries

    sf = "/root/testdata/sf0.001"
    v = fixtures.vertices(spark, sf, fixtures.MESH_SPARSE)
    f = fixtures.faces(spark, sf, fixtures.MESH_SPARSE)
    measured = v.select("name", "part_idx").distinct().join(
        mesh.piece_measures(v, f), ["name", "part_idx"], "left"
    ).fillna(0.0, ["volume"])
    prio = mesh.removal_priority(measured).toPandas().sort_values(["name", "prio"])
    edges = contact.contact_edges(v).toPandas()
    got = queries.plan(spark, sf).toPandas().sort_values(["name", "step"])
    taken = {n: g["part_idx"].tolist() for n, g in got.groupby("name")}
    near = {n: set(zip(g["i"], g["j"])) for n, g in edges.groupby("name")}
    for n, g in prio.groupby("name"):
        assert taken.get(n, []) == brute_peel(g["part_idx"].tolist(), near.get(n, set())), n


def test_prefix_sum_crosses_blocks(spark):
    idx = [0, 5, 65535, 65536, 70000, 200000, 2**31 + 7]
    rows = [(k, i, float(n + 1)) for k in (1, 2) for n, i in enumerate(idx)]
    df = spark.createDataFrame(rows, "k int, i long, v double")
    got = ordering.prefix_sum(df, ["k"], "i", "v", "s").orderBy("k", "i").collect()
    assert [r.s for r in got] == [1.0, 3, 6, 10, 15, 21, 28] * 2


def test_ranks_on_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 < 2, 1).otherwise(2).alias("k"), F.xxhash64("id").alias("h"), "id")
    got = ordering.with_rank(df, ["k"], ["h", "id"]).toPandas()
    want = got.sort_values(["k", "h", "id"]).groupby("k").cumcount()
    assert (want == got["rank"].loc[want.index]).all()


def test_explode_range_is_whole(spark):
    df = spark.createDataFrame([(1, 70000), (2, 0), (3, 3)], "k int, n long")
    got = ordering.explode_range(df, "n", "i").groupBy("k").agg(F.count("*").alias("c"), F.max("i").alias("m"))
    assert {(r.k, r.c, r.m) for r in got.collect()} == {(1, 70000, 69999), (3, 3, 2)}


def test_hilbert_is_a_bijection_of_unit_steps(spark):
    depth, n = 3, 8
    cells = spark.range(n**3).select(
        (F.col("id") % n).alias("gx"), (F.floor(F.col("id") / n) % n).alias("gy"), F.floor(F.col("id") / n**2).alias("gz")
    )
    coded = curve.with_code(cells, "hilbert", depth)
    pdf = coded.toPandas().sort_values("code")
    assert pdf["code"].tolist() == list(range(n**3))
    assert (pdf[["gx", "gy", "gz"]].diff().abs().sum(axis=1).iloc[1:] == 1).all()
    back = curve.with_cell(coded.withColumnsRenamed({"gx": "ax", "gy": "ay", "gz": "az"}), "hilbert", depth)
    assert back.where("gx <> ax OR gy <> ay OR gz <> az OR batch <> 0").count() == 0


def test_z_code_known_value_and_full_depth(spark):
    df = spark.createDataFrame([(5, 3, 6), (65535, 0, 65535)], "gx long, gy long, gz long")
    coded = curve.with_code(df, "z", 16)
    assert coded.first().code == 350
    back = curve.with_cell(coded.withColumnsRenamed({"gx": "ax", "gy": "ay", "gz": "az"}), "z", 16)
    assert back.where("gx = ax AND gy = ay AND gz = az").count() == 2
    with pytest.raises(ValueError):
        curve.check_depth(17)


def quats(spark, n=200):
    q = np.random.default_rng(5).normal(size=(n, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    q[0], q[1] = [1, 0, 0, 0], [0, 1, 0, 0]  # identity and a half turn
    q[2] = [1, 1e-9, 0, 0]
    return spark.createDataFrame(pd.DataFrame(q, columns=list("wxyz")))


def test_rotation_round_trips(spark):
    df = quats(spark)
    q = rot.cols(*"wxyz")
    df, w = rot.stage(df, "log", rot.log_map(q))
    df, e = rot.stage(df, "exp", rot.exp_map(w))
    df, m = rot.stage(df, "mat", rot.to_matrix(q))
    df, b = rot.stage(df, "back", rot.matrix_to_quaternion(m))
    same = F.abs(F.abs(rot.dot(q, e)) - 1) + F.abs(F.abs(rot.dot(q, b)) - 1)
    off = df.select(F.max(same).alias("s"), F.max(F.abs(rot.norm(rot.matrix_vector(m, q[1:])) - rot.norm(q[1:]))).alias("l")).first()
    assert off.s < 1e-12 and off.l < 1e-12


def test_opposite_quaternions_rotate_alike(spark):
    q = rot.cols(*"wxyz")
    v = (F.lit(0.3), F.lit(-1.0), F.lit(2.0))
    a, b = rot.rotate(q, v), rot.rotate(tuple(-c for c in q), v)
    assert quats(spark).select(F.max(rot.norm(rot.sub(a, b)))).first()[0] < 1e-12


def test_perfect_prediction_scores_zero(spark):
    df = quats(spark, 50).select(
        (F.monotonically_increasing_id() % 5).alias("name"), F.monotonically_increasing_id().alias("part_idx"),
        *[F.col("w").alias(f"{s}_t{c}") for s in ("gt", "pr") for c in "xyz"],
        *[F.col(c).alias(f"{s}_q{c}") for s in ("gt", "pr") for c in "wxyz"],
    )
    for r in metrics.pose_metrics(df).collect():
        assert r.rmse_t == 0 and r.rmse_r == 0
    pts = df.select("name", "part_idx", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pt_idx")).selectExpr(
        "*", "rand(1) as x", "rand(2) as y", "rand(3) as z"
    )
    acc = metrics.part_accuracy(metrics.part_chamfer(metrics.placed_points(pts, df))).collect()
    assert all(r.part_acc == 1 for r in acc)


def test_budget_adds_up(spark):
    rows = [(k, p, float(p * p + 0.1)) for k in range(5) for p in range(k + 1)]
    parts = spark.createDataFrame(rows, "name long, part_idx long, area double")
    got = sampling.allocate_budget(parts, 500, 20)
    assert {r.s for r in got.groupBy("name").agg(F.sum("n_points").alias("s")).collect()} == {500}
    assert got.agg(F.min("n_points")).first()[0] >= 20
    with pytest.raises(ValueError):
        sampling.check_budget(100, 20, 20)


def test_uniform_samples_cover_faces_by_area(spark):
    v, f = row_of_cubes(spark, 1)
    v = v.withColumn("x", F.col("x") * 3)  # the four long sides are three times larger
    geometry = mesh.face_geometry(v, f)
    counts = spark.createDataFrame([(1, 0, 6000)], "name long, part_idx long, n_points long")
    got = sampling.sample_uniform(geometry, counts).toPandas()
    assert sorted(got["pt_idx"]) == list(range(6000))
    inside = got[["x", "y", "z"]]
    on_side = ((inside["x"] % 3).abs() < 1e-9) | ((inside["y"] % 1).abs() < 1e-9) | ((inside["z"] % 1).abs() < 1e-9)
    assert on_side.all() and inside.min().min() >= 0 and inside.max().max() <= 3
    area = geometry.toPandas().set_index("f_idx")["area"].sort_index()
    per_face = got.groupby("f_idx").size().reindex(area.index, fill_value=0)
    want = 6000 * area / area.sum()
    assert (abs(per_face - want) < 5 * np.sqrt(want)).all()


def test_thinning_is_spaced_and_full(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.uniform(0, 1, (300, 3)), columns=list("xyz"))
    pdf["name"], pdf["part_idx"], pdf["pt_idx"], pdf["radius"] = 1, 0, np.arange(300), 0.2
    df = spark.createDataFrame(pdf)
    kept = sorted(r.pt_idx for r in sampling.thin_out(df, 7).collect())
    xyz = pdf[["x", "y", "z"]].to_numpy()
    gap = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    assert (gap[np.ix_(kept, kept)] + np.eye(len(kept)) >= 0.2**2).all()  # no two within the radius
    assert (gap[:, kept].min(axis=1) < 0.2**2).all()  # and no further point has room
    assert sorted(r.pt_idx for r in sampling.thin_out(df.repartition(7), 7).collect()) == kept


def test_thinning_of_surfaces_over_each_other(spark):
    """Ten thousand candidates in one cell: a cell puts forward one of them, so pairs stay linear."""
    rows = spark.range(10_000).select(
        F.lit(1).alias("name"), F.lit(0).alias("part_idx"), F.col("id").alias("pt_idx"),
        *[(F.rand(3 + k) * 0.9).alias(c) for k, c in enumerate("xyz")], F.lit(1.0).alias("radius"),
    )
    rows = materialize(rows, "crowd")
    kept = materialize(sampling.thin_out(rows).withColumn("_h", F.lit(0)), "kept")
    assert sampling.close_pairs(kept).count() == 0 and 1 <= kept.count() <= 8
    assert sampling.thin_out(rows.where("false")).count() == 0


def face_table(spark, n_points, strategy):
    v, f = row_of_cubes(spark, 2)
    counts = v.select("name", "part_idx").distinct().withColumn("n_points", F.lit(n_points).cast("long"))
    geometry = mesh.face_geometry(v, f)
    return geometry, counts, sampling.SAMPLERS[strategy](geometry, counts)


@pytest.mark.parametrize("strategy", ["uniform", "poisson"])
def test_table_function_gives_the_sampler_rows(spark, strategy):
    from sherdloom.functions.tables import register

    geometry, counts, drawn = face_table(spark, 70, strategy)
    register(spark)
    geometry.join(counts, ["name", "part_idx"]).createOrReplaceTempView("test_faces")
    text = f"SELECT * FROM sample_surface(TABLE(test_faces) PARTITION BY (name, part_idx), '{strategy}', 1116)"
    table = spark.sql(text)
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, drawn.select(*table.columns).collect()))
    single = text.replace("PARTITION BY (name, part_idx)", "WITH SINGLE PARTITION")  # pieces are kept apart
    assert sorted(map(tuple, spark.sql(single).collect())) == sorted(map(tuple, spark.sql(text).collect()))
    with pytest.raises(Exception, match="knows the strategies"):
        spark.sql(text.replace(f"'{strategy}'", "'grid'")).collect()
    with pytest.raises(Exception, match="misses the columns n_points"):
        geometry.createOrReplaceTempView("test_bare")
        spark.sql("SELECT * FROM sample_surface(TABLE(test_bare) PARTITION BY (name, part_idx))").collect()


def test_last_mark_across_partitions(spark):
    from sherdloom.operators.asof import with_last_mark

    rng = np.random.default_rng(4)
    marks = [(k, int(at), 100 * k + i) for k in range(3) for i, at in enumerate(sorted({0, *rng.integers(0, 5000, 40 * k)}))]
    asked = [(int(k), int(at), f"q{i}") for i, (k, at) in enumerate(zip(rng.integers(0, 3, 2000), rng.integers(0, 5000, 2000)))]
    got = with_last_mark(
        spark.createDataFrame(asked, "k int, at long, tag string"), spark.createDataFrame(marks, "k int, at long, v long"), ["k"], "at", "v"
    )
    want = {(k, at, tag, max((a, v) for kk, a, v in marks if kk == k and a <= at)[1]) for k, at, tag in asked}
    assert {(r.k, r.at, r.tag, r.v) for r in got.collect()} == want


def test_computed_order_is_a_fair_permutation(spark):
    from sherdloom.functions.rand import hash_key, shuffled_position

    for n in (1, 2, 3, 10, 257, 1000):
        key = hash_key(5, F.lit("any"))
        at = [r[0] for r in spark.range(n).select(shuffled_position(F.col("id"), F.lit(n).cast("long"), key)).collect()]
        assert sorted(at) == list(range(n))
    n, keys = 20, 4000  # every position goes everywhere equally often
    rows = spark.range(keys).crossJoin(spark.range(n).withColumnRenamed("id", "i"))
    rows = rows.select("i", shuffled_position(F.col("i"), F.lit(n).cast("long"), hash_key(5, "id")).alias("at"), "id")
    counts = rows.groupBy("i", "at").count().toPandas()["count"]
    assert len(counts) == n * n and ((counts - keys / n) ** 2 / (keys / n)).sum() < 361 + 5 * np.sqrt(2 * 361)
    beside = rows.alias("a").join(rows.alias("b"), F.expr("a.id = b.id AND a.i + 1 = b.i")).where("b.at = a.at + 1").count()
    assert abs(beside - keys * (n - 1) / n) < 6 * np.sqrt(keys * (n - 1) / n)  # neighbours part as often as by chance


def test_shuffle_refuses_gaps(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 0, 2)], "name long, part_idx long, pt_idx long")
    with pytest.raises(Exception, match="not numbered without gaps"):
        cloud.shuffle(df).collect()


def test_even_sampling_fills_the_count(spark):
    v, f = row_of_cubes(spark, 1)
    counts = spark.createDataFrame([(1, 0, 60)], "name long, part_idx long, n_points long")
    got = sampling.sample_surface(v, f, counts, "poisson").toPandas()
    assert sorted(got["pt_idx"]) == list(range(60)) and (got["frac"] == 0).all()


def test_clouds_take_counts_and_draws_from_one_geometry(spark, monkeypatch):
    """Faces meet their corners once, and draws carry no corners through running sums and merges."""
    made, summed = [], []
    real, real_sum = mesh.face_geometry, sampling.prefix_sum
    for module in (mesh, sampling):
        monkeypatch.setattr(module, "face_geometry", lambda v, f: made.append(1) or real(v, f))
    monkeypatch.setattr(sampling, "prefix_sum", lambda df, *rest: summed.append(df.columns) or real_sum(df, *rest))
    v, f = row_of_cubes(spark, 2)
    points, parts = prepare.weighted_clouds(v, f, 100, 20, 2)
    assert points.count() == 100 and sorted(r.n_points for r in parts.collect()) == [50, 50]
    assert len(made) == 1 and not {"ax", "fnx", "volume"} & set(summed[0])


def test_merge_writes_no_marks_but_the_last(spark, monkeypatch):
    from sherdloom.operators import asof

    written = []
    monkeypatch.setattr(asof, "materialize", lambda df, tag: written.append(materialize(df, tag)) or written[-1])
    marks = spark.range(5000).select(F.lit(1).alias("k"), (2 * F.col("id")).alias("at"), F.col("id").alias("mark"))
    asked = spark.range(300).select(F.lit(1).alias("k"), (31 * F.col("id")).alias("at"), F.col("id").alias("n"))
    got = asof.with_last_mark(asked, marks, ["k"], "at", "mark").collect()
    assert sorted((r.n, r.mark) for r in got) == [(n, 31 * n // 2) for n in range(300)]
    rows = written[0].groupBy("_pid").agg(F.count_if(F.col("_kind") == 0).alias("n")).collect()
    assert max(r.n for r in rows) == 1


def test_posed_points_return_home(spark):
    v, f = row_of_cubes(spark, 2)
    for made in (prepare.uniform_clouds(v, f, 40), prepare.weighted_clouds(v, f, 100, 5, 4)):
        points, parts = made
        back = prepare.restore_points(points, parts)
        off = sum(((F.col(f"b{c}") - F.col(f"gt_{c}")) ** 2 for c in "xyz"), F.lit(0.0))
        assert back.agg(F.max(off)).first()[0] < 1e-18
        assert points.agg(F.max(F.greatest(*[F.abs(F.col(c)) for c in "xyz"]))).first()[0] == pytest.approx(1.0)
        assert parts.where("is_ref").groupBy("name").count().where("count <> 1").count() == 0


def test_reference_marks_respect_their_bounds(spark):
    rows = [(k, p, 10 + p, 8, 0) for k in range(200) for p in range(8)]
    parts = spark.createDataFrame(rows, "name long, part_idx long, n_points long, num_parts long, redundancy long")
    got = cloud.mark_references(parts, 100, multi_ref=True).groupBy("name").agg(F.count_if("is_ref").alias("r")).toPandas()
    assert got["r"].between(1, 1 + 6).all() and (got["r"] > 1).mean() > 0.7
    eligible = cloud.mark_references(parts, 300, random_anchor=True).where("is_ref")
    assert eligible.where("n_points <= 15").count() == 0 and eligible.count() == 200


def test_padding_refuses_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 0), (1, 25)], "name long, part_idx long")
    with pytest.raises(Exception, match="part index above 20"):
        packing.pad_parts(df, F.lit(1.0), 20, F.lit(0.0), "a").collect()


def test_mesh_files(spark, tmp_path):
    import struct

    root = tmp_path / "data"
    ok, bad = root / "jar" / "fractured_0", root / "cup" / "mode_1"
    ok.mkdir(parents=True), bad.mkdir(parents=True)
    (ok / "piece_10.ply").write_text(
        "ply\nformat ascii 1.0\ncomment x\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\n"
        "element face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n"
    )
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    body = b"".join(struct.pack("<fffB", *p, 7) for p in ((0, 0, 0), (2, 0, 0), (0, 2, 0))) + struct.pack("<Biii", 3, 0, 1, 2)
    (ok / "piece_2.ply").write_bytes(head + body)
    (ok / "piece_3.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nvn 0 0 1\nf 1/1/1 2//1 -1\n")
    (bad / "piece_0.ply").write_text("ply\nformat ascii 1.0\nend")
    (bad / "piece_1.obj").write_text("v 0 0 0\nf 1 2 9\n")
    pieces, v, f, errors = meshes.mesh_tables(meshes.read_mesh_files(spark, str(root)), str(root).strip("/"))
    assert [(r["name"], r.piece, r.part_idx) for r in pieces.orderBy("part_idx").collect()] == [
        ("jar/fractured_0", "piece_2", 0), ("jar/fractured_0", "piece_3", 1), ("jar/fractured_0", "piece_10", 2)
    ]
    assert v.count() == 10 and f.where("part_idx = 2").count() == 2
    assert {r["name"] for r in errors.collect()} == {"cup/mode_1"}


def test_split_files_with_plain_names(spark, tmp_path):
    (tmp_path / "everyday.train.txt").write_text("jar/a \n\n cup/b\n")
    (tmp_path / "artifact.val.txt").write_text("pot/c\n")
    got = {tuple(r) for r in splits.read_split_lists(spark, str(tmp_path)).collect()}
    assert got == {("everyday", "train", "jar/a"), ("everyday", "train", "cup/b"), ("artifact", "val", "pot/c")}


def test_unreadable_gallery_is_empty(spark, tmp_path):
    (tmp_path / "g.json").write_text("not json")
    assert gallery.read_gallery(spark, str(tmp_path / "g.json")).count() == 0


def test_removal_and_redundancy_exclude_each_other(spark):
    parts = spark.createDataFrame([(1, 0)], "name long, part_idx long")
    with pytest.raises(ValueError):
        splits.part_count_filter(parts, removal=1, redundancy=1)


def test_schedules_reject_unknown_kinds(spark):
    with pytest.raises(ValueError):
        schedule.sigma(F.lit(1.0), 10, "cubic")
    with pytest.raises(ValueError):
        schedule.alpha_bar(F.lit(0.1), "cubic")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_never_become_cross_products(spark):
    v, f = row_of_cubes(spark, 3)
    for df in (contact.contact_edges(v), contact.shared_faces(v, f), mesh.piece_measures(v, f)):
        text = plan_of(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_noised_poses_can_be_filtered_on(spark):
    """A filter on a composed rotation must not be expanded through its stages."""
    df = quats(spark, 20).select(
        *[F.lit(0.1).alias(f"gt_t{c}") for c in "xyz"], *[F.col(c).alias(f"gt_q{c}") for c in "wxyz"]
    )
    out, field = [f"o{i}" for i in range(7)], [f"f{i}" for i in range(6)]
    noised = schedule.flow_noise(
        df, metrics.gt_t(), metrics.gt_q(), metrics.gt_t(), metrics.gt_q(), F.lit(0.5), out, field
    )
    assert noised.where("o3 >= 0 AND o4 < 2 AND f3 < 7").count() == 20
