"""Exact nearest-neighbour joins over blocks of points.

Points of one key are laid out along a space-filling curve in the key's own box and
cut into blocks of at most ``block`` points, so a block has the same size wherever
points crowd together.  Blocks form a tree of boxes.

The search takes two passes.  A query block first descends to the few boxes that are
nearest as a whole and takes distances there; the largest k-th distance among its
points bounds the search.  It then descends again, keeps only boxes within that bound,
and its task streams their points past, holding the k best of each query.

Copies are folded first: queries are distinct locations, and of the points at one
location only as many as can ever be answers stay on the data side.  So neither a
crowded key nor a pile of equal points is paired with itself, and the result is
exact: a box is dropped only when enough closer points are known to exist.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import materialize

BLOCK_BITS = 8  # 256 points per block
FANOUT_BITS = 5  # 32 boxes per tree node
SEEDS = 4  # boxes per query block that the first pass looks into
OUT_ROWS = 50_000  # answers that a task holds before it hands them on
_ROW_BITS = 33
_GRID_BITS = 20
_XYZ = ("x", "y", "z")


@F.pandas_udf(T.LongType())
def _curve(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
    """Hilbert index of grid cells; whole batches, as the column form is slow at this depth."""
    a = np.stack([x, y, z]).astype(np.int64)
    for bit in range(_GRID_BITS - 1, 0, -1):
        low = (1 << bit) - 1
        for axis in range(3):
            is_set = (a[axis] >> bit & 1).astype(bool)
            differing = (a[0] ^ a[axis]) & low
            a[0] ^= np.where(is_set, low, differing)
            a[axis] ^= np.where(is_set | (axis == 0), 0, differing)
    a[1] ^= a[0]
    a[2] ^= a[1]
    turn = np.zeros_like(a[0])
    for bit in range(_GRID_BITS - 1, 0, -1):
        turn ^= (a[2] >> bit & 1) * ((1 << bit) - 1)
    a ^= turn
    code = np.zeros_like(a[0])
    for bit in range(_GRID_BITS - 1, -1, -1):
        for axis in range(3):
            code = code << 1 | (a[axis] >> bit & 1)
    return pd.Series(code)


def _blocks(points: DataFrame, keys: list[str], ids: list[str], block_bits: int) -> DataFrame:
    """One row per block: key, node number, box and the block's points as arrays."""
    box = points.groupBy(*keys).agg(
        *[F.min(c).alias(f"_lo{c}") for c in _XYZ],
        F.greatest(*[F.max(c) - F.min(c) for c in _XYZ]).alias("_w"),
    )
    side = float((1 << _GRID_BITS) - 1)
    cell = {
        f"_c{c}": F.when(F.col("_w") > 0, (F.col(c) - F.col(f"_lo{c}")) / F.col("_w") * side)
        .otherwise(0.0)
        .cast("long")
        for c in _XYZ
    }
    laid_out = (
        points.join(box, keys)
        .withColumns(cell)
        .withColumn("_z", _curve(*cell))
    )
    order = [*keys, "_z", *_XYZ, *ids]
    number = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    numbered = (
        laid_out.select(*keys, *ids, *_XYZ, "_z")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("pid", F.shiftright("_mid", _ROW_BITS))
        .withColumn("loc", F.shiftright(number, block_bits))
    )
    # At most 2**block_bits rows per group by construction of ``loc``.
    return materialize(
        numbered.groupBy(*keys, "pid", "loc").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.min(c).alias(f"lo_{c}") for c in _XYZ],
            *[F.max(c).alias(f"hi_{c}") for c in _XYZ],
            F.sort_array(F.collect_list(F.struct(*ids, *_XYZ))).alias("pts"),
        ),
        "blocks",
    )


def _number(blocks: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Give blocks one integer ``node`` that stays consecutive along the curve.

    Also returns the number of tree levels above the leaves, sized by the key that
    spans the most blocks; four scalars reach the driver for it.
    """
    spans = blocks.groupBy(*keys).agg(
        F.max("loc").alias("_hi"),
        (F.max("pid") - F.min("pid")).alias("_pids"),
        (F.max("loc") - F.min("loc")).alias("_locs"),
        F.count(F.lit(1)).alias("_blocks"),
    )
    top = spans.agg(F.max("_hi"), F.max("_pids"), F.max("_locs"), F.max("_blocks")).first()
    max_loc, pids, locs, most = (int(v or 0) for v in top)
    loc_bits = max_loc.bit_length()
    span_bits = (pids + 1).bit_length() + loc_bits if pids else locs.bit_length()
    node = F.shiftleft("pid", loc_bits).bitwiseOR(F.col("loc"))
    levels = max(0, -(-span_bits // FANOUT_BITS) - 1)
    # Two nodes' worth of blocks is as much as a node and its neighbour would hold anyway.
    return blocks.withColumn("node", node), 0 if most <= 2 << FANOUT_BITS else levels


def _gap(lo_a, hi_a, lo_b, hi_b) -> Column:
    """Smallest distance between two intervals."""
    return F.greatest(lo_b - hi_a, lo_a - hi_b, F.lit(0.0))


def _reach(lo_a, hi_a, lo_b, hi_b) -> Column:
    """Largest distance between two intervals."""
    return F.greatest(hi_b - lo_a, hi_a - lo_b)


def _total(fn) -> Column:
    parts = [fn(F.col(f"q_lo_{c}"), F.col(f"q_hi_{c}"), F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in _XYZ]
    return sum((p * p for p in parts[1:]), parts[0] * parts[0])


def _prune(pairs: DataFrame, keys: list[str], need: int) -> DataFrame:
    """Drop boxes beyond the bound, and beyond the nearest box certain to hold enough points.

    The second test only helps query blocks without a bound.
    """
    far = F.when(F.col("n") >= need, _total(_reach)).otherwise(F.lit(float("inf")))
    pairs = pairs.withColumn("_near", _total(_gap)).where(F.col("_near") <= F.col("bound"))
    nearest = F.min(far).over(Window.partitionBy(*keys, "q_node"))
    return (
        pairs.withColumn("_far", nearest * (1.0 + 1e-9))
        .where(F.col("_near") <= F.col("_far"))
        .drop("_far")
    )


def _level(d: DataFrame, keys: list[str], level: int) -> DataFrame:
    """Boxes of the tree ``level`` steps above the blocks."""
    box = [f"{e}_{c}" for e in ("lo", "hi") for c in _XYZ]
    leaves = d.select(*keys, "node", "n", *box)
    if level == 0:
        return leaves
    ends = [getattr(F, fn)(f"{e}_{c}").alias(f"{e}_{c}") for e, fn in (("lo", "min"), ("hi", "max")) for c in _XYZ]
    up = F.shiftright("node", level * FANOUT_BITS)
    return leaves.withColumn("node", up).groupBy(*keys, "node").agg(F.sum("n").alias("n"), *ends)


def _descend(q: DataFrame, d: DataFrame, keys: list[str], levels: int, keep) -> DataFrame:
    """(q_node, node) pairs that ``keep`` leaves on the way from the top to the blocks."""
    box = [f"{e}_{c}" for e in ("lo", "hi") for c in _XYZ]
    carried = [c for c in ("bound",) if c in q.columns]
    asking = [*keys, "q_node", *[f"q_{b}" for b in box], *carried]
    q_box = q.select(*keys, F.col("node").alias("q_node"), *[F.col(b).alias(f"q_{b}") for b in box], *carried)
    pairs = keep(q_box.join(_level(d, keys, levels), keys))
    for level in range(levels - 1, -1, -1):
        below = _level(d, keys, level).withColumn("_up", F.shiftright("node", FANOUT_BITS))
        pairs = keep(
            pairs.select(*asking, F.col("node").alias("_up")).join(below, [*keys, "_up"]).drop("_up")
        )
    return pairs


def _seed_pairs(q: DataFrame, d: DataFrame, keys: list[str], need: int, levels: int, block_bits: int) -> DataFrame:
    """The few data blocks of each query block that lie nearest as a whole."""
    most = max(SEEDS, -(-2 * need // (1 << block_bits)))

    def keep(pairs):
        best = Window.partitionBy(*keys, "q_node").orderBy(F.col("n") < need, _total(_reach), "node")
        return pairs.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= most).drop("_r")

    pairs = _descend(q, d, keys, levels, keep)
    return pairs.select(*keys, "q_node", "node", _total(_gap).alias("near"))


def candidate_pairs(q: DataFrame, d: DataFrame, keys: list[str], need: int, levels: int) -> DataFrame:
    """(q_node, node, near) pairs of blocks that have to be compared.

    ``q`` holds a squared distance ``bound`` within which every point of the query
    block has its answers.  A block without a bound has infinity there.
    """
    pairs = _descend(q, d, keys, levels, lambda pairs: _prune(pairs, keys, need))
    return pairs.select(*keys, "q_node", "node", F.col("_near").alias("near"))


def _codes(values: pa.Array) -> np.ndarray:
    """Numbers in the order of the values."""
    if pa.types.is_integer(values.type) or pa.types.is_floating(values.type):
        return values.to_numpy(zero_copy_only=False)
    return np.unique(np.array(values.to_pylist(), object), return_inverse=True)[1]


class _Asking:
    """The locations of one query block with the k best distances seen so far."""

    def __init__(self, key: list[pa.Scalar], xyz: list[np.ndarray], k: int) -> None:
        self.key, self.xyz, self.k = key, xyz, k
        self.best = np.full((len(xyz[0]), k), np.inf)
        self.edge = np.full(len(xyz[0]), np.inf)
        self.at: list[np.ndarray] = []
        self.d2: list[np.ndarray] = []
        self.ids: list[list[pa.Array]] = []

    def meet(self, near: float, xyz: list[np.ndarray], ids: list[pa.Array] | None) -> None:
        """Data points of one block, ordered by id; ``ids`` None keeps distances only."""
        if near > self.edge.max() * (1.0 + 1e-9):
            return
        d2 = sum(np.subtract.outer(a, b) ** 2 for a, b in zip(self.xyz, xyz))
        low = np.partition(d2, self.k - 1, axis=1)[:, : self.k] if d2.shape[1] > self.k else d2
        both = np.concatenate([self.best, low], axis=1)
        self.best = np.partition(both, self.k - 1, axis=1)[:, : self.k]
        self.edge = self.best.max(1)
        if ids is None:
            return
        at, hit = np.nonzero(d2 <= self.edge[:, None])
        dist = d2[at, hit]
        if len(at) and np.bincount(at).max() > self.k:  # equal distances: the first ids
            order = np.lexsort((hit, dist, at))
            at, hit, dist = at[order], hit[order], dist[order]
            first = np.arange(len(at)) - np.searchsorted(at, at) < self.k
            at, hit, dist = at[first], hit[first], dist[first]
        if len(at):
            self.at.append(at)
            self.d2.append(dist)
            self.ids.append([v.take(pa.array(hit)) for v in ids])

    def answers(self) -> list[pa.Array]:
        """Key, location, ids, distance and place (from 1) of the k best."""
        if not self.at:
            return []
        at, d2 = np.concatenate(self.at), np.concatenate(self.d2)
        ids = [pa.concat_arrays(v) for v in zip(*self.ids)]
        keep = np.flatnonzero(d2 <= self.edge[at])
        at, d2, ids = at[keep], d2[keep], [v.take(pa.array(keep)) for v in ids]
        order = np.lexsort((*[_codes(v) for v in reversed(ids)], d2, at))
        at, d2 = at[order], d2[order]
        place = np.arange(len(at)) - np.searchsorted(at, at) + 1
        keep = place <= self.k
        return [
            *[pa.repeat(v, int(keep.sum())) for v in self.key],
            *[pa.array(c[at[keep]]) for c in self.xyz],
            *[v.take(pa.array(order[keep])) for v in ids],
            pa.array(d2[keep]), pa.array(place[keep].astype(np.int32)),
        ]


def _streamer(keys: list[str], ids: list[str], k: int, bound_only: bool):
    """Arrow-batch function over rows in order: a query block, then its data blocks."""
    names = [*keys, "q_node", "bound"] if bound_only else [*keys, *_XYZ, *[f"n_{c}" for c in ids], "d2", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, ready, rows = None, [], 0

        def close():
            nonlocal rows
            if asking is None:
                return
            if bound_only:
                bound = float(asking.edge.max()) * (1.0 + 1e-9)
                out = [*[pa.repeat(v, 1) for v in asking.key], pa.array([bound])]
            else:
                out = asking.answers()
            if out:
                ready.append(pa.RecordBatch.from_arrays(out, names=names))
                rows += ready[-1].num_rows

        for b in batches:
            side, near = b.column("side").to_numpy(), b.column("near").to_numpy()
            lists = {c: (b.column(c).offsets.to_numpy(), b.column(c).values) for c in (*_XYZ, *ids)}
            points = [(lists[c][0], lists[c][1].to_numpy()) for c in _XYZ]
            head = [*keys, "q_node"] if bound_only else keys
            for r in range(b.num_rows):
                xyz = [v[at[r] : at[r + 1]] for at, v in points]
                if side[r] == 0:
                    close()
                    asking = _Asking([b.column(c)[r] for c in head], xyz, k)
                    if rows > OUT_ROWS:
                        yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                        ready, rows = [], 0
                elif bound_only:
                    asking.meet(near[r], xyz, None)
                else:
                    own = [lists[c] for c in ids]
                    asking.meet(near[r], xyz, [v[at[r] : at[r + 1]] for at, v in own])
        close()
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    return run


def _stream(q, d, pairs, keys: list[str], ids: list[T.StructField], k: int, bound_only: bool) -> DataFrame:
    """Query blocks and the data blocks they are paired with, brought together by query block.

    Data blocks of one query block come nearest first and pass one at a time.
    """
    names = [f.name for f in ids]
    at = [F.col(f"pts.{c}").alias(c) for c in _XYZ]
    none = [F.lit(None).cast(T.ArrayType(f.dataType)).alias(f.name) for f in ids]
    asks = q.select(
        *keys, F.col("node").alias("q_node"), F.lit(0).alias("side"), F.lit(0.0).alias("near"), *at, *none
    )
    data = d.select(*keys, "node", *at, *[F.col(f"pts.{c}").alias(c) for c in names])
    met = pairs.join(data, [*keys, "node"]).select(
        *keys, "q_node", F.lit(1).alias("side"), "near", *_XYZ, *names
    )
    # A fixed number of partitions: by bytes these rows look small, by distances they are not.
    parts = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = asks.unionByName(met).repartition(parts, *keys, "q_node").sortWithinPartitions(*keys, "q_node", "side", "near")
    key_fields = [T.StructField(c, q.schema[c].dataType) for c in keys]
    double = T.DoubleType()
    if bound_only:
        schema = T.StructType([*key_fields, T.StructField("q_node", T.LongType()), T.StructField("bound", double)])
    else:
        schema = T.StructType(
            key_fields + [T.StructField(c, double) for c in _XYZ]
            + [T.StructField(f"n_{f.name}", f.dataType) for f in ids]
            + [T.StructField("d2", double), T.StructField("place", T.IntegerType())]
        )
    return rows.mapInArrow(_streamer(keys, names, k, bound_only), schema)


def with_bound(q: DataFrame, d: DataFrame, keys: list[str], k: int, levels: int, block_bits: int) -> DataFrame:
    """Query blocks with the squared distance ``bound`` that holds all their answers.

    A tree of one level is compared without a first pass.
    """
    if levels == 0:
        return q.withColumn("bound", F.lit(float("inf")))
    seeds = _seed_pairs(q, d, keys, k, levels, block_bits)
    bounds = _stream(q, d, seeds, keys, [], k, True).withColumnRenamed("q_node", "node")
    return q.join(bounds, [*keys, "node"], "left").fillna(float("inf"), ["bound"])


def _match(
    q: DataFrame, d: DataFrame, levels: int, keys: list[str], ids: list[T.StructField], k: int, block_bits: int
) -> DataFrame:
    """The k best per query location: keys, location, n_ids, d2 and place."""
    asking = with_bound(q, d, keys, k, levels, block_bits)
    return _stream(q, d, candidate_pairs(asking, d, keys, k, levels), keys, ids, k, False)


def mutual_nearest(
    points: DataFrame, keys: list[str], ids: list[str], side: str = "side",
    block_bits: int = BLOCK_BITS, written: bool = False,
) -> DataFrame:
    """Squared distance ``d2`` of every point to the nearest point of the other side.

    ``side`` is 0 or 1.  Both directions run as one job over one set of blocks.
    A key with points on one side only gives no row, as an inner join would.
    """
    within = ["_of", *keys]
    at = [*within, *_XYZ]
    points = points.withColumn("_of", F.col(side).cast("int"))
    if not written:  # box, range sample, blocks and the last join all read the points
        points = materialize(points, "sides")
    blocks = _blocks(points.select(*at).distinct(), within, [], block_bits)
    mine, levels = _number(blocks, within)
    other = mine.withColumn("_of", F.lit(1) - F.col("_of"))
    nearest = _match(mine, other, levels, within, [], 1, block_bits).select(*at, "d2")
    return points.drop(side).join(nearest, at).select(F.col("_of").alias(side), *keys, *ids, "d2")


def knn(
    points: DataFrame, k: int, keys: list[str], ids: list[str], block_bits: int = BLOCK_BITS
) -> DataFrame:
    """The k nearest other points of every point inside its key.

    Columns: keys, ``q_<id>``, ``n_<id>``, ``d2``, ``nn`` (1..k).  Equal distances
    are ordered by id.  Keys with fewer than k+1 points give what they have.
    """
    at = [*keys, *_XYZ]
    points = materialize(points.select(*at, *ids), "located")  # read by box, sample, blocks and join
    # k+1 answers per location, one of which may be the asking point itself; the
    # row_number filter is applied before the shuffle as well (window group limit).
    here = Window.partitionBy(*at).orderBy(*ids)
    data = points.withColumn("_c", F.row_number().over(here)).where(F.col("_c") <= k + 1)
    data = data.withColumn("_asks", F.col("_c") == 1).drop("_c")  # one copy asks for all
    d, levels = _number(_blocks(data, keys, [*ids, "_asks"], block_bits), keys)
    q = d.withColumn("pts", F.filter("pts", lambda p: p["_asks"])).where(F.size("pts") > 0)
    top = _match(q, d, levels, keys, [points.schema[c] for c in ids], k + 1, block_bits)
    asked = points.select(*at, *[F.col(c).alias(f"q_{c}") for c in ids]).join(top, at)
    itself = F.lit(True)
    for c in ids:
        itself = itself & (F.col(f"q_{c}") == F.col(f"n_{c}"))
    order = Window.partitionBy(*keys, *[f"q_{c}" for c in ids]).orderBy("place")
    return (
        asked.where(~itself)
        .withColumn("nn", F.row_number().over(order).cast("long"))
        .where(F.col("nn") <= k)
        .select(*keys, *[f"q_{c}" for c in ids], *[f"n_{c}" for c in ids], "d2", "nn")
    )
