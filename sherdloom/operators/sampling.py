"""Point budgets and surface sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions import rot
from ..functions.rand import DEFAULT_SEED, hash_key, hash_uniform
from ..session import materialize
from .asof import with_last_mark
from .mesh import face_geometry, with_normals
from .metrics import PART
from .ordering import explode_range, prefix_sum, with_rank, with_sum_block
from .thinning import thin

OVERSAMPLE = 3  # fixed value: candidates drawn per even sample
PART_POINTS = 1 << 16  # points of a part that are thinned in one task; larger parts take many
_HELD_POINTS = 1 << 15  # points of whole parts that a task thins at once
WEIGHT_UNITS = float(1 << 32)


def allocate_budget(parts: DataFrame, num_points: int, min_points: int = 20) -> DataFrame:
    """n_points per part: a floor each, the rest by area, the remainder to the largest.

    ``parts`` has ``area``.  The shares of an object add up to ``num_points``.
    An object whose parts cannot all have the floor is an error.
    """
    totals = parts.groupBy("name").agg(
        F.sum("area").alias("_total"), F.count(F.lit(1)).alias("_p")
    )
    share = F.floor((num_points - min_points * F.col("_p")) * F.col("area") / F.col("_total"))
    short = F.concat(
        F.lit(f"{num_points} points cannot give every part {min_points} points: object "),
        F.col("name").cast("string"), F.lit(" has parts: "), F.col("_p").cast("string"),
    )
    share = F.when(F.col("_p") * min_points > num_points, F.raise_error(short).cast("long")).otherwise(share)
    split = parts.join(totals, "name").withColumn("_n", (F.lit(min_points) + share).cast("long"))
    rest = split.groupBy("name").agg(
        (F.lit(num_points) - F.sum("_n")).alias("_rest"),
        F.max_by("part_idx", F.struct(F.col("_n"), -F.col("part_idx"))).alias("_top"),
    )
    extra = F.when(F.col("part_idx") == F.col("_top"), F.col("_rest")).otherwise(0)
    return (
        split.join(rest, "name")
        .withColumn("n_points", F.col("_n") + extra)
        .drop("_total", "_p", "_n", "_rest", "_top")
    )


def check_budget(num_points: int, max_parts: int, min_points: int = 20) -> None:
    if max_parts * min_points > num_points:
        raise ValueError(
            f"{num_points} points cannot give {max_parts} parts {min_points} points each"
        )


def cumulative_area(geometry: DataFrame) -> DataFrame:
    """Faces with the area interval [lo, hi) they cover inside their part."""
    df = prefix_sum(geometry, PART, "f_idx", "area", "hi")
    return df.withColumn("lo", F.col("hi") - F.col("area"))


def face_weights(geometry: DataFrame) -> DataFrame:
    """Faces with area, as whole-number weights ``_w`` and where the interval they cover in their part begins.

    A weight counts in units of 2**-32 of the part's largest face, rounded up.  Whole numbers add up
    exactly, so neighbouring intervals meet without a gap that could lose a draw, in any order.
    Rows hold nothing else of the face, and meet the largest one by block of their running sum.
    """
    sized = with_sum_block(geometry.where("area > 0").select(*PART, "f_idx", "area"), "f_idx")
    tops = sized.groupBy(*PART, "_b2").agg(F.max("area").alias("_top"))
    largest = tops.groupBy(*PART).agg(F.max("_top").alias("_max"))
    weighted = sized.join(tops.join(largest, PART).drop("_top"), [*PART, "_b2"]).withColumn(
        "_w", F.ceil(F.col("area") / F.col("_max") * WEIGHT_UNITS).cast("long")
    ).drop("area", "_max")
    summed = prefix_sum(weighted, PART, "f_idx", "_w", "hi")
    return summed.select(*PART, "f_idx", (F.col("hi") - F.col("_w")).alias("lo"), "_w")


def sample_uniform(
    geometry: DataFrame, counts: DataFrame, seed: int = DEFAULT_SEED, stream: str = "uniform",
    weights: DataFrame | None = None,
) -> DataFrame:
    """``n_points`` independent surface points per part, faces drawn by area.

    A draw falls into the area interval of its face: draws and interval starts are merged in
    order, which is linear in both.  Barycentric draws with r1 + r2 > 1 are folded back into
    the triangle.  Parts without area get no points.  ``weights`` are written ``face_weights``, if there are any.
    """
    faces = materialize(face_weights(geometry), "weights") if weights is None else weights
    totals = faces.groupBy(*PART).agg(F.max(F.col("lo") + F.col("_w")).alias("_total"))
    plan = counts.select(*PART, "n_points").join(totals, PART)
    draws = explode_range(plan, "n_points", "pt_idx").select(
        *PART, "pt_idx",
        F.least(
            F.floor(hash_uniform(seed, F.lit(stream), *PART, "pt_idx") * F.col("_total")),
            F.col("_total") - 1,
        ).cast("long").alias("lo"),
    )
    hit = with_last_mark(draws, faces, PART, "lo", "f_idx").drop("lo")
    corners = [f"{p}{x}" for p in "abc" for x in "xyz"]
    hit = with_normals(hit.join(geometry.where("area > 0").select(*PART, "f_idx", *corners), [*PART, "f_idx"]))
    r1 = hash_uniform(seed, F.lit(stream + "1"), *PART, "pt_idx")
    r2 = hash_uniform(seed, F.lit(stream + "2"), *PART, "pt_idx")
    hit = hit.withColumns({"_r1": r1, "_r2": r2}).withColumn("_fold", F.col("_r1") + F.col("_r2") > 1)
    s = F.when(F.col("_fold"), 1 - F.col("_r1")).otherwise(F.col("_r1"))
    t = F.when(F.col("_fold"), 1 - F.col("_r2")).otherwise(F.col("_r2"))
    a, b, c = (rot.cols(*[f"{p}{x}" for x in "xyz"]) for p in "abc")
    at = rot.add(a, rot.add(rot.scale(rot.sub(b, a), s), rot.scale(rot.sub(c, a), t)))
    return hit.select(
        *PART, "pt_idx", "f_idx",
        *[v.alias(n) for v, n in zip(at, "xyz")],
        F.col("fnx").alias("nx"), F.col("fny").alias("ny"), F.col("fnz").alias("nz"),
    )


_CELL = ("_gx", "_gy", "_gz")


def _in_cells(points: DataFrame) -> DataFrame:
    """The points with the grid cell of one radius that they lie in."""
    return points.withColumns({g: F.floor(F.col(c) / F.col("radius")).cast("long") for g, c in zip(_CELL, "xyz")})


def _cells(at: Column) -> Column:
    """The block of four cells of an axis in which a cell lies."""
    return F.shiftright(at, 2)


def _around(points: DataFrame) -> DataFrame:
    """The points under each block of cells that holds one of the 27 around their own, columns renamed to o_*.

    Of the two blocks at most that an axis reaches, both are the same one half of the time.
    """
    out = points
    for c in _CELL:
        out = out.withColumn(c, F.explode(F.array_distinct(F.array(_cells(F.col(c) - 1), _cells(F.col(c) + 1)))))
    return out.select(*[F.col(c).alias(f"o_{c}") for c in (*PART, *_CELL, "_h", "pt_idx", "x", "y", "z")])


def _met() -> Column:
    """A point and another one of ``_around`` share a block of cells and lie within the radius."""
    gap = rot.sub(rot.cols("x", "y", "z"), rot.cols("o_x", "o_y", "o_z"))
    met = rot.dot(gap, gap) < F.col("radius") ** 2
    for c in PART:
        met = met & (F.col(c) == F.col(f"o_{c}"))
    for c in _CELL:
        met = met & (_cells(F.col(c)) == F.col(f"o_{c}"))
    return met


def close_pairs(points: DataFrame) -> DataFrame:
    """(part, pt_idx, other) for points of a part that lie within their ``radius``."""
    at = _in_cells(points.select(*PART, "pt_idx", "x", "y", "z", "radius", F.lit(0).cast("long").alias("_h")))
    found = at.join(_around(at), _met() & (F.col("pt_idx") < F.col("o_pt_idx")))
    return found.select(*PART, "pt_idx", F.col("o_pt_idx").alias("other"))


def thin_out(points: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """A subset with no two points of a part within ``radius``, to which no further point can be added.

    In every round each grid cell of one radius puts forward its open point of smallest hash; of
    those, the ones that precede all others within the radius are kept, and what lies within the
    radius of a kept point is closed.  A cell puts forward one point however many it holds, so a
    point meets 27 others at most, also where surfaces lie over each other.  Rounds grow with the
    logarithm of the number of points.  Parts of PART_POINTS at most go through their rounds in a
    task, which holds a few of them; larger ones meet by joins, with the same result.
    """
    points = materialize(points, "candidates")
    sizes = points.groupBy(*PART).agg(F.count(F.lit(1)).alias("_n"))
    return _thinned(points, sizes, seed).drop("_r")


def _thinned(points: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """``thin_out`` of parts that have ``_n`` points, and the place ``_r`` of what is kept by ``pt_idx``."""
    large = materialize(sizes.where(F.col("_n") > PART_POINTS).select(*PART), "large-parts")
    if large.isEmpty():
        return _thinned_in_tasks(points, seed)
    points = materialize(points, "candidates")
    small = _thinned_in_tasks(points.join(large, PART, "left_anti"), seed)
    wide = _thinned_by_joins(points.join(large, PART, "left_semi"), seed)
    return small.unionByName(with_rank(wide, PART, ["pt_idx"], "_r"))


def _thinned_in_tasks(points: DataFrame, seed: int) -> DataFrame:
    # Hashes are made where they are used: a shuffle cannot pack them.
    laid = points.repartition(*PART).sortWithinPartitions(*PART)
    keyed = laid.withColumn("_h", hash_key(seed, F.lit("prio"), *PART, "pt_idx"))
    columns, schema = points.columns, StructType([*points.schema.fields]).add("_r", "long")

    def kept(parts: pa.Table, part: np.ndarray) -> pa.Table:
        pt_idx, key, radius = (parts[c].to_numpy() for c in ("pt_idx", "_h", "radius"))
        stay = np.flatnonzero(thin(part, pt_idx, key, np.stack([parts[c].to_numpy() for c in "xyz"], axis=1), radius))
        stay = stay[np.lexsort((pt_idx[stay], part[stay]))]
        begins = np.searchsorted(part[stay], part[stay])
        return parts.take(pa.array(stay)).select(columns).append_column("_r", pa.array(np.arange(len(stay)) - begins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < _HELD_POINTS:
                continue
            table = pa.Table.from_batches(held)
            part = _numbers(table)
            whole = int(np.searchsorted(part, part[-1]))  # the last part may go on
            if whole:
                yield from kept(table.slice(0, whole), part[:whole]).to_batches()
            held, n = table.slice(whole).combine_chunks().to_batches(), n - whole
        if n:
            table = pa.Table.from_batches(held)
            yield from kept(table, _numbers(table)).to_batches()

    return keyed.mapInArrow(run, schema)


def _numbers(rows: pa.Table) -> np.ndarray:
    """A number for the part of every row; the rows of a part follow each other."""
    fresh = np.zeros(rows.num_rows, bool)
    for c in PART:
        column = rows[c].combine_chunks()
        fresh[1:] |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
    return np.cumsum(fresh)


def _thinned_by_joins(points: DataFrame, seed: int) -> DataFrame:
    key = [*PART, "pt_idx"]
    open_ = points.select(*key, "x", "y", "z", "radius", hash_key(seed, F.lit("prio"), *key).alias("_h"))
    open_ = materialize(_in_cells(open_), "open")
    met = _met()
    earlier = F.struct(F.col("o__h"), F.col("o_pt_idx")) < F.struct(F.col("_h"), F.col("pt_idx"))
    chosen = None
    while not open_.isEmpty():
        first = F.min(F.struct("_h", "pt_idx", "x", "y", "z", "radius")).alias("p")
        ahead = materialize(open_.groupBy(*PART, *_CELL).agg(first).select(*PART, *_CELL, "p.*"), "ahead")
        kept = materialize(ahead.join(_around(ahead), met & earlier, "left_anti"), "kept")
        open_ = materialize(open_.join(_around(kept), met, "left_anti"), "open")
        chosen = kept.select(*key) if chosen is None else chosen.unionByName(kept.select(*key))
    if chosen is None:
        return points
    return points.join(chosen, key, "left_semi")


def spread_points(
    geometry: DataFrame, counts: DataFrame, seed: int = DEFAULT_SEED, weights: DataFrame | None = None
) -> DataFrame:
    """Points of every part at least ``radius`` apart, numbered, no more than ``n_points``.

    Draws three candidates per wanted point and thins them at radius sqrt(area / (3 n)).
    """
    area = geometry.groupBy(*PART).agg(F.sum("area").alias("_area"))
    wanted = counts.select(*PART, "n_points").where("n_points > 0").join(area, PART).where("_area > 0").withColumn(
        "radius", F.sqrt(F.col("_area") / (OVERSAMPLE * F.col("n_points")))
    )
    wanted = materialize(wanted.select(*PART, "radius", "n_points"), "wanted")
    dense = wanted.select(*PART, (F.col("n_points") * OVERSAMPLE).alias("n_points"))
    candidates = sample_uniform(geometry, dense, seed, "even", weights).join(wanted, PART)
    even = _thinned(candidates, dense.groupBy(*PART).agg(F.sum("n_points").alias("_n")), seed)
    even = even.where(F.col("_r") < F.col("n_points"))
    return materialize(even.drop("pt_idx", "n_points").withColumnRenamed("_r", "pt_idx"), "even")


def sample_even(
    geometry: DataFrame, counts: DataFrame, seed: int = DEFAULT_SEED, weights: DataFrame | None = None,
    spread: DataFrame | None = None,
) -> DataFrame:
    """Evenly spaced surface points, topped up uniformly to ``n_points`` per part.

    ``spread`` are ``spread_points`` of the same geometry, counts and seed, if they are there already.
    """
    if weights is None:
        weights = materialize(face_weights(geometry), "weights")
    even = (spread_points(geometry, counts, seed, weights) if spread is None else spread).drop("radius")
    have = even.groupBy(*PART).agg(F.count(F.lit(1)).alias("_have"))
    short = counts.select(*PART, "n_points").join(have, PART, "left").select(
        *PART, F.coalesce("_have", F.lit(0)).alias("_have"),
        (F.col("n_points") - F.coalesce("_have", F.lit(0))).alias("n_points"),
    )
    short = materialize(short, "short")
    filler = (
        sample_uniform(geometry, short.drop("_have"), seed, "top-up", weights)
        .join(short.select(*PART, "_have"), PART)
        .withColumn("pt_idx", F.col("pt_idx") + F.col("_have"))
        .drop("_have")
    )
    return even.unionByName(filler)


SAMPLERS = {"uniform": sample_uniform, "poisson": sample_even}


def sample_surface(
    vertices: DataFrame, faces: DataFrame, counts: DataFrame, strategy: str = "uniform",
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Points, normals and fracture label of every part by the named strategy."""
    geometry = materialize(face_geometry(vertices, faces), "geometry")
    return sample_geometry(geometry, faces, counts, strategy, seed)


def sample_geometry(
    geometry: DataFrame, faces: DataFrame, counts: DataFrame, strategy: str = "uniform", seed: int = DEFAULT_SEED,
) -> DataFrame:
    """``sample_surface`` of a written ``face_geometry``, which counts may be taken from too."""
    return label_points(SAMPLERS[strategy](geometry, counts, seed), faces)


def label_points(points: DataFrame, faces: DataFrame) -> DataFrame:
    """``frac`` = 1 where the sampled face is shared with another piece."""
    if "shared_with" not in faces.columns:
        faces = faces.withColumn("shared_with", F.lit(-1).cast("long"))
    label = faces.select(
        *PART, "f_idx",
        (F.coalesce("shared_with", F.lit(-1)) != -1).cast("long").alias("frac"),
    )
    return points.join(label, [*PART, "f_idx"])
