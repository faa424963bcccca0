"""Mesh measures: scale, face geometry, area, volume and removal priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rot
from .metrics import PART
from .ordering import with_rank

_XYZ = ("x", "y", "z")
VOLUME_DIGITS = 9
BLOCK_BITS = 10  # vertex numbers of one list: 2**BLOCK_BITS
EDGE = 8  # numbers of the following block that a list holds too, so faces of near numbers have one list


def object_scale(vertices: DataFrame) -> DataFrame:
    """Per object max(1, largest bounding-box side of any piece); it never enlarges."""
    sides = vertices.groupBy(*PART).agg(
        F.greatest(*[F.max(c) - F.min(c) for c in _XYZ]).alias("_side")
    )
    return sides.groupBy("name").agg(
        F.greatest(F.lit(1.0), F.max("_side")).alias("mesh_scale")
    )


def scale_to_unit(vertices: DataFrame) -> DataFrame:
    """Vertices divided by their object's scale."""
    df = vertices.join(object_scale(vertices), "name")
    return df.withColumns({c: F.col(c) / F.col("mesh_scale") for c in _XYZ})


def block(v: str) -> Column:
    return F.shiftright(v, BLOCK_BITS)


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of vertices under the block of their number, a block and its edge in one task."""
    held = F.array_distinct(F.array(block("v_idx"), F.greatest(F.shiftright(F.col("v_idx") - EDGE, BLOCK_BITS), F.lit(0))))
    return rows.where("v_idx IS NOT NULL").withColumn("_block", F.explode(held)).repartition(*PART, "_block")


def vertex_blocks(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """(keys, _at, _from, _dense): vertex number -> value of every block, in order.

    ``keys`` are the piece, the block and what else divides its rows; a number has one row there.
    A block without gaps is dense: its values are found by place.
    """
    lists = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("v_idx", value.alias("value")))).alias("_at"),
        F.min("v_idx").alias("_from"), (F.count("v_idx") == F.max("v_idx") - F.min("v_idx") + 1).alias("_dense"),
    )
    return lists.withColumn("_at", F.map_from_entries("_at"))


def at_vertex(v: str, own: bool = True) -> Column:
    """A list's value of a vertex; null where there is none or, if ``own``, it lies in another block."""
    place = F.get(F.map_values("_at"), (F.col(v) - F.col("_from")).cast("int"))
    found = F.when(F.col("_dense"), place).otherwise(F.try_element_at("_at", F.col(v)))
    return F.when(block(v) == F.col("_block"), found) if own else found


def with_lists(faces: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Faces with the values ``_a``, ``_b``, ``_c`` of their corners.

    A face whose corners are in one list has all values there and is one row (a list: ``lists`` may have
    several of a block).  The others, a second table, are a row for every block of a corner and have its
    values; without such faces, which is looked up first, there is none.
    """
    faces = faces.select(*PART, "f_idx", "a", "b", "c")
    corners = [F.col(c) for c in "abc"]
    home = F.shiftright(F.least(*corners), BLOCK_BITS)
    near = (F.shiftright(F.greatest(*corners) - EDGE, BLOCK_BITS) <= home) & (home >= 0)
    for c in corners:
        near = near & c.isNotNull()
    one = faces.where(near).withColumn("_block", home).repartition(*PART, "_block").distinct()
    one = one.join(lists, [*PART, "_block"]).withColumns({f"_{c}": at_vertex(c, own=False) for c in "abc"})
    several = faces.where(~near)
    if several.isEmpty():
        return one, None
    under = F.explode(F.array_distinct(F.array_compact(F.array(*map(block, "abc")))))
    several = several.withColumn("_block", under).join(lists, [*PART, "_block"])
    return one, several.withColumns({f"_{c}": at_vertex(c) for c in "abc"})


def face_geometry(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Corner positions, area, signed volume share and unit normal of every face.

    Faces meet their vertices block by block and take their corners by number.  Corners of several
    blocks fold together; all other faces are whole where they met.  Faces of neighbouring numbers
    lie in one task, so what is summed up by piece shrinks there.  A face without area has a zero
    normal.
    """
    once = in_blocks(vertices).groupBy(*PART, "_block", "v_idx").agg(*[F.max(c).alias(c) for c in _XYZ])
    one, several = with_lists(faces, vertex_blocks(once, [*PART, "_block"], F.struct(*_XYZ)))

    def corners(met: DataFrame) -> DataFrame:
        met = met.where("_a IS NOT NULL OR _b IS NOT NULL OR _c IS NOT NULL")
        return met.select(*PART, "f_idx", *[F.col(f"_{p}")[c].alias(f"{p}{c}") for p in "abc" for c in _XYZ])

    whole = corners(one)
    if several is not None:
        top = [F.max(f"{p}{c}").alias(f"{p}{c}") for p in "abc" for c in _XYZ]
        whole = whole.unionByName(corners(several).groupBy(*PART, "f_idx").agg(*top))
    a, b, c = (rot.cols(*[f"{p}{x}" for x in _XYZ]) for p in "abc")
    return with_normals(whole, F.col("_len") / 2.0, rot.dot(a, rot.cross(b, c)) / 6.0)


def with_normals(faces: DataFrame, area: Column | None = None, volume: Column | None = None) -> DataFrame:
    """Faces with the unit normal of their corners, and other values that may use its length ``_len``."""
    a, b, c = (rot.cols(*[f"{p}{x}" for x in _XYZ]) for p in "abc")
    faces = rot.with_tuple(faces, ("_ux", "_uy", "_uz"), rot.cross(rot.sub(b, a), rot.sub(c, a)))
    u = rot.cols("_ux", "_uy", "_uz")
    faces = faces.withColumn("_len", rot.norm(u))
    unit = [F.when(F.col("_len") > 0, x / F.col("_len")).otherwise(0.0) for x in u]
    measures = {n: v for n, v in (("area", area), ("volume", volume)) if v is not None}
    return faces.withColumns({**measures, **dict(zip(("fnx", "fny", "fnz"), unit))}).drop("_ux", "_uy", "_uz", "_len")


def piece_measures(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Area and signed volume of every piece."""
    return measured(face_geometry(vertices, faces))


def measured(geometry: DataFrame) -> DataFrame:
    """Area and signed volume of the pieces of ``face_geometry``."""
    return geometry.groupBy(*PART).agg(
        F.sum("area").alias("area"), F.sum("volume").alias("volume")
    )


def removal_priority(measures: DataFrame) -> DataFrame:
    """0-based order of removal attempts: volume descending, the largest piece last.

    Volumes equal to nine digits go by part index: a sum of floats depends on the
    order of its terms, and the plan must not.
    """
    measures = measures.withColumn("_vol", F.round("volume", VOLUME_DIGITS))
    largest = measures.groupBy("name").agg(
        F.max_by("part_idx", F.struct("_vol", -F.col("part_idx"))).alias("_top")
    )
    keyed = measures.join(largest, "name").select(
        *PART, "volume",
        (F.col("part_idx") == F.col("_top")).cast("int").alias("_last"),
        (-F.col("_vol")).alias("_desc"),
    )
    return with_rank(keyed, ["name"], ["_last", "_desc", "part_idx"], "prio").drop("_last", "_desc")
