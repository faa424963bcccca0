"""Contact between pieces: shared vertices, shared faces, graphs, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..session import materialize
from .mesh import in_blocks, vertex_blocks, with_lists
from .metrics import PART

DECIMALS = 5  # fixed value: digits kept when vertices are compared
_POS = ["_rx", "_ry", "_rz"]
TILE_PIECES = 512  # piece numbers of a list of pieces at one position


def _positions(vertices: DataFrame, decimals: int) -> DataFrame:
    """Vertices with half-even rounded coordinates as the match key."""
    return vertices.withColumns(
        # adding zero folds -0.0, which would not match 0.0 as a key
        {r: F.bround(F.col(c), decimals) + 0.0 for r, c in zip(_POS, "xyz")}
    )


def _tiled(spots: DataFrame) -> DataFrame:
    """(name, position, tile, pieces): the pieces of a position in lists of TILE_PIECES numbers."""
    tile = F.floor(F.col("part_idx") / TILE_PIECES).cast("long").alias("_tile")
    return spots.groupBy("name", *_POS, tile).agg(F.sort_array(F.collect_set("part_idx")).alias("_pieces"))


def _meetings(spots: DataFrame) -> DataFrame:
    """(name, position, i, j) with i < j for every two pieces that share a position.

    Pieces of one list meet inside their row.  Objects of more pieces have several lists, and every
    two lists of a position are a row that is dealt to a task of its own before its pieces meet;
    where no object has more, which is looked up first, nothing is dealt.
    """
    tiled = _tiled(spots)
    one = tiled.where(F.size("_pieces") > 1).select(
        "name", *_POS, "_pieces", F.posexplode("_pieces").alias("_at", "i")
    ).select("name", *_POS, "i", F.explode(F.expr("slice(_pieces, _at + 2, size(_pieces))")).alias("j"))
    if spots.where(F.col("part_idx") >= TILE_PIECES).isEmpty():
        return one
    upper = tiled.where("_tile > 0").select("name", *_POS, F.col("_tile").alias("_upper"), F.col("_pieces").alias("_others"))
    two = tiled.join(upper, ["name", *_POS]).where("_tile < _upper").repartition("name", *_POS, "_tile", "_upper")
    two = two.select("name", *_POS, "_others", F.explode("_pieces").alias("i")).select(
        "name", *_POS, "i", F.explode("_others").alias("j")
    )
    return one.unionByName(two)


def common_vertices(vertices: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """(name, part_idx, other, position) for positions two pieces have in common.

    The lists of a position name a piece once, so a vertex repeated many times
    inside one piece is matched once.
    """
    met = _meetings(_positions(vertices, decimals).select(*PART, *_POS))
    both = F.explode(F.array(F.struct(F.col("i").alias("p"), F.col("j").alias("q")), F.struct(F.col("j").alias("p"), F.col("i").alias("q"))))
    return met.withColumn("_b", both).select("name", *_POS, F.col("_b.p").alias("part_idx"), F.col("_b.q").alias("other"))


def contact_edges(vertices: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """Edges (i < j) between pieces that have a rounded vertex in common."""
    return _meetings(_positions(vertices, decimals).select(*PART, *_POS)).select("name", "i", "j").distinct()


def contact_links(vertices: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """Edges (i < j) that reach the same pieces as ``contact_edges``, one per piece and position.

    Every piece hangs on the smallest piece of each of its positions; m pieces at one position
    give m - 1 links instead of m (m - 1) / 2 edges.
    """
    spots = _positions(vertices, decimals).select(*PART, *_POS).distinct()
    lowest = spots.groupBy("name", *_POS).agg(F.min("part_idx").alias("i"))
    linked = spots.join(lowest, ["name", *_POS]).where("i < part_idx")
    return linked.select("name", "i", F.col("part_idx").alias("j")).distinct()


def shared_faces(vertices: DataFrame, faces: DataFrame, decimals: int = DECIMALS) -> DataFrame:
    """(name, part_idx, f_idx, other): all three corners lie on vertices of the other piece."""
    spots = _positions(vertices, decimals).select(*PART, "v_idx", *_POS)
    others = F.array_remove("_pieces", F.col("part_idx"))
    near = spots.join(_tiled(spots), ["name", *_POS]).select(*PART, "v_idx", "_tile", others.alias("_others"))
    near = in_blocks(near.where(F.size("_others") > 0))
    here = [*PART, "_block", "_tile"]
    once = near.groupBy(*here, "v_idx").agg(F.flatten(F.collect_list("_others")).alias("_others"))
    one, several = with_lists(faces, vertex_blocks(once, here, F.col("_others")))
    # A face of one list is through with its pieces; one that reaches into other blocks collects
    # the corners of all.
    through = one.select(*PART, "f_idx", F.explode(F.array_intersect(F.array_intersect("_a", "_b"), "_c")).alias("other"))
    if several is None:
        return through
    none = F.array().cast(T.ArrayType(vertices.schema["part_idx"].dataType))
    every = F.concat(*[F.coalesce(f"_{p}", none) for p in "abc"])
    hits = several.select(*PART, "f_idx", every.alias("_every"), F.explode(F.array_distinct(every)).alias("other"))
    n = F.size("_every") - F.size(F.array_remove("_every", F.col("other")))
    far = hits.groupBy(*PART, "f_idx", "other").agg(F.sum(n).alias("_n")).where("_n = 3").drop("_n")
    return through.unionByName(far)


def label_faces(faces: DataFrame, shared: DataFrame) -> DataFrame:
    """Faces with ``shared_with`` = largest touching piece, -1 when there is none."""
    top = shared.groupBy(*PART, "f_idx").agg(F.max("other").alias("_w"))
    return (
        faces.join(top, [*PART, "f_idx"], "left")
        .withColumn("shared_with", F.coalesce(F.col("_w"), F.lit(-1).cast("long")))
        .drop("_w")
    )


def face_contact_edges(labelled: DataFrame) -> DataFrame:
    """Both directions of every edge i < j for which a face of i is labelled j."""
    up = labelled.where("shared_with > part_idx").select(
        "name", F.col("part_idx").alias("i"), F.col("shared_with").alias("j")
    ).distinct()
    return up.unionByName(up.select("name", F.col("j").alias("i"), F.col("i").alias("j")))


def _star(edges: DataFrame, up: bool) -> DataFrame:
    """One star step: hang neighbours of a node on its smallest neighbour.

    ``up`` moves the neighbours above the node, otherwise those below and itself.
    """
    if up:
        pairs = edges.unionByName(edges.select("name", F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(
            "name", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        )
    low = pairs.groupBy("name", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = pairs.join(low, ["name", "u"])
    if up:
        moved = tied.where("v > u").select("name", F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = tied.select("name", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("name", "u", F.col("m").alias("v"))
        )
    return moved.where("u <> v").distinct()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, part_idx, component): component = smallest part index it reaches.

    Alternates the two star steps until the edge set stands still; the number of
    rounds grows with the logarithm of the graph, not with its diameter.
    """
    e = edges.select("name", F.col("i").alias("u"), F.col("j").alias("v")).where("u <> v").distinct()
    e = materialize(e, "cc")
    before = None
    while True:
        mark = e.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("name", "u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(mark) == before or mark[0] == 0:
            break
        before = tuple(mark)
        e = materialize(_star(_star(e, up=True), up=False), "cc")
    low = e.groupBy("name", F.greatest("u", "v").alias("part_idx")).agg(
        F.min(F.least("u", "v")).alias("_c")
    )
    return (
        nodes.select(*PART)
        .join(low, PART, "left")
        .select(*PART, F.coalesce("_c", "part_idx").alias("component"))
    )


def add_distractors(
    faces: DataFrame, sizes: DataFrame, redundant: DataFrame, count: int
) -> DataFrame:
    """Append the faces of each object's first ``count`` foreign pieces.

    ``redundant`` is (name, rank, src_name, src_piece).  The pieces follow the
    object's own parts, carry no shared faces and are not rescaled.
    """
    foreign = (
        redundant.where(F.col("rank") < count)
        .join(sizes.select("name", "num_parts"), "name")
        .join(
            faces.select(
                F.col("name").alias("src_name"), F.col("part_idx").alias("src_piece"),
                "f_idx", "a", "b", "c",
            ),
            ["src_name", "src_piece"],
        )
        .select(
            "name", (F.col("num_parts") + F.col("rank")).alias("part_idx"), "f_idx", "a", "b", "c",
            F.lit(-1).cast("long").alias("shared_with"), F.lit(True).alias("redundant"),
        )
    )
    own = faces.select(
        *PART, "f_idx", "a", "b", "c", "shared_with", F.lit(False).alias("redundant")
    )
    return own.unionByName(foreign)


def without_removed(pieces: DataFrame, removals: DataFrame, count: int) -> DataFrame:
    """Pieces that stay after the first ``count`` removal steps."""
    gone = removals.where(F.col("step") < count).select(*PART)
    return pieces.join(gone, PART, "left_anti")
