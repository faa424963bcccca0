"""Block neighbour search against brute force, copies and crowded cells included."""

import numpy as np
import pandas as pd
import pytest

from sherdloom.operators import neighbors as N


def cloud(seed=3, n=400):
    rng = np.random.default_rng(seed)
    tight = rng.normal(0, 1e-4, (n // 3, 3))  # a third of the points in one spot
    wide = rng.uniform(-1, 1, (n // 3, 3))
    copies = np.repeat([[0.5, 0.5, 0.5]], n - 2 * (n // 3), axis=0)  # and a pile of copies
    xyz = np.concatenate([tight, wide, copies])
    return pd.DataFrame(
        {"name": np.where(np.arange(n) % 7 == 0, 2, 1), "pt_idx": np.arange(n), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}
    )


def brute_d2(a, b):
    d = a[:, None, :] - b[None, :, :]
    return d[..., 0] ** 2 + d[..., 1] ** 2 + d[..., 2] ** 2


@pytest.mark.parametrize("block_bits,fanout", [(2, 1), (8, 5)])
def test_knn_is_exact(spark, monkeypatch, block_bits, fanout):
    monkeypatch.setattr(N, "FANOUT_BITS", fanout)
    pdf = cloud()
    got = N.knn(spark.createDataFrame(pdf), 5, ["name"], ["pt_idx"], block_bits).toPandas()
    want = []
    for name, g in pdf.groupby("name"):
        ids = g["pt_idx"].to_numpy()
        d2 = brute_d2(g[["x", "y", "z"]].to_numpy(), g[["x", "y", "z"]].to_numpy())
        np.fill_diagonal(d2, np.inf)
        for i in range(len(g)):
            best = sorted(zip(d2[i], ids))[:5]
            want += [(name, ids[i], n, d, r + 1) for r, (d, n) in enumerate(best)]
    want = pd.DataFrame(want, columns=["name", "q_pt_idx", "n_pt_idx", "d2", "nn"])
    key = ["name", "q_pt_idx", "nn"]
    pd.testing.assert_frame_equal(
        got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True),
        check_dtype=False,
    )


@pytest.mark.parametrize("block_bits,fanout", [(2, 1), (8, 5)])
def test_mutual_nearest_is_exact(spark, monkeypatch, block_bits, fanout):
    monkeypatch.setattr(N, "FANOUT_BITS", fanout)
    a, b = cloud(3).assign(side=0), cloud(4).assign(side=1)
    b["x"] += 0.01
    both = pd.concat([a, b])
    got = N.mutual_nearest(spark.createDataFrame(both), ["name"], ["pt_idx"], block_bits=block_bits).toPandas()
    assert len(got) == len(both)
    for (side, name), g in got.groupby(["side", "name"]):
        mine = both[(both.side == side) & (both.name == name)].set_index("pt_idx")
        other = both[(both.side != side) & (both.name == name)]
        d2 = brute_d2(mine.loc[g.pt_idx, ["x", "y", "z"]].to_numpy(), other[["x", "y", "z"]].to_numpy())
        np.testing.assert_array_equal(g.d2.to_numpy(), d2.min(axis=1))


def test_blocks_stay_bounded_on_one_hot_key(spark):
    pdf = cloud(n=900).assign(name=1)
    blocks = N._blocks(spark.createDataFrame(pdf), ["name"], ["pt_idx"], 4)
    assert blocks.agg({"n": "max"}).first()[0] <= 16
    assert blocks.agg({"n": "sum"}).first()[0] == 900


def test_few_points_give_what_they_have(spark):
    pdf = pd.DataFrame({"name": [1, 1, 2], "pt_idx": [0, 1, 0], "x": [0.0, 1, 2], "y": 0.0, "z": 0.0})
    got = N.knn(spark.createDataFrame(pdf), 4, ["name"], ["pt_idx"]).collect()
    assert sorted((r["name"], r.q_pt_idx, r.n_pt_idx) for r in got) == [(1, 0, 1), (1, 1, 0)]


def test_pairs_of_blocks_stay_few_beside_a_far_wider_object(spark):
    rng = np.random.default_rng(5)
    n, k = 100_000, 16
    xyz = np.concatenate([rng.uniform(0, 1, (n, 3)), rng.uniform(0, 1e7, (1000, 3))])
    pdf = pd.DataFrame({"name": np.repeat([1, 2], [n, 1000]), "pt_idx": np.arange(n + 1000)})
    pdf[["x", "y", "z"]] = xyz
    points, keys = spark.createDataFrame(pdf), ["name"]
    blocks, levels = N._number(N._blocks(points, keys, ["pt_idx"], N.BLOCK_BITS), keys)
    asking = N.with_bound(blocks, blocks, keys, k + 1, levels, N.BLOCK_BITS)
    pairs = N.candidate_pairs(asking, blocks, keys, k + 1, levels)
    assert pairs.count() <= 40 * blocks.count()
    answers = N._match(blocks, blocks, levels, keys, [points.schema["pt_idx"]], k + 1, N.BLOCK_BITS)
    assert answers.count() == (k + 1) * len(pdf)
