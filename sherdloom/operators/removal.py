"""Removal plan: which pieces can be taken away without splitting the object."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .contact import connected_components
from .metrics import PART

# Objects up to this many pieces are peeled inside one task, and larger ones that have no more pieces
# and edges together than these can have; the others step through distributed component counts.
TASK_PIECES = 1024


def _removable(neigh: list[set], alive: set) -> set:
    """Pieces whose removal leaves exactly one component, found in one pass.

    In a connected rest those are all but the cut points; in a rest of two components
    a piece that is a component of its own.
    """
    parts: list[set] = []
    cuts: set = set()
    depth: dict[int, int] = {}
    low: dict[int, int] = {}
    for root in sorted(alive):
        if root in depth:
            continue
        depth[root] = low[root] = 0
        seen, branches = {root}, 0
        walk = [(root, -1, iter(neigh[root] & alive))]
        while walk:
            at, up, rest = walk[-1]
            step = next((n for n in rest if n != up), None)
            if step is None:
                walk.pop()
                if up >= 0:
                    low[up] = min(low[up], low[at])
                    if up == root:
                        branches += 1
                    elif low[at] >= depth[up]:
                        cuts.add(up)
            elif step in depth:
                low[at] = min(low[at], depth[step])
            else:
                depth[step] = low[step] = depth[at] + 1
                seen.add(step)
                walk.append((step, at, iter(neigh[step] & alive)))
        if branches > 1:
            cuts.add(root)
        parts.append(seen)
    if len(parts) == 1:
        return alive - cuts if len(alive) > 1 else set()
    return {p for part in parts if len(part) == 1 for p in part} if len(parts) == 2 else set()


def _peel(order: list, edges: Iterable[tuple]) -> list:
    """The pieces that go, first to last; ``order`` lists the object's pieces by priority."""
    at = {p: n for n, p in enumerate(order)}
    neigh: list[set] = [set() for _ in order]
    for i, j in edges:
        if i in at and j in at and i != j:
            neigh[at[i]].add(at[j])
            neigh[at[j]].add(at[i])
    alive, taken = set(range(len(order))), []
    first = 0
    while True:
        # A removal leaves one component.  There the first piece may go at once if it hangs on one other.
        while taken and first not in alive:
            first += 1
        if taken and len(alive) > 1 and len(neigh[first]) == 1:
            pick = first
        else:
            pick = min(_removable(neigh, alive), default=None)
        if pick is None:
            return taken
        alive.discard(pick)
        for n in neigh[pick]:
            neigh[n].discard(pick)
        taken.append(order[pick])


def _peel_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, taken) of rows (name, order, i, j)."""
    for b in batches:
        lists = zip(b.column(1), b.column(2), b.column(3))
        taken = [_peel(order.as_py(), zip(i.as_py(), j.as_py())) for order, i, j in lists]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(taken, pa.list_(pa.int64()))], names=["name", "taken"])


def _peel_distributed(pieces: DataFrame, edges: DataFrame) -> DataFrame:
    """Same plan for objects of any size: every round tests one piece per object.

    An object's cursor is the priority of the last piece that could not go; a
    successful removal resets it.
    """
    left = materialize(
        pieces.select(*PART, "prio", F.lit(-1).cast("long").alias("cursor"), F.lit(0).cast("long").alias("step")),
        "peel",
    )
    taken = []
    while True:
        tries = left.where(F.col("prio") > F.col("cursor"))
        pick = materialize(
            tries.groupBy("name").agg(
                F.min_by("part_idx", "prio").alias("pick"), F.min("prio").alias("at")
            ),
            "pick",
        )
        if pick.isEmpty():
            break
        rest = left.join(pick, "name").where("part_idx <> pick")
        kept = edges.join(rest.select("name", F.col("part_idx").alias("i")), ["name", "i"]).join(
            rest.select("name", F.col("part_idx").alias("j")), ["name", "j"]
        )
        whole = (
            connected_components(rest, kept)
            .groupBy("name")
            .agg((F.min("component") == F.max("component")).alias("ok"))
        )
        verdict = materialize(
            pick.join(whole, "name", "left").withColumn("ok", F.coalesce("ok", F.lit(False))), "verdict"
        )
        gone = left.join(verdict, "name").where("ok AND part_idx = pick")
        taken.append(materialize(gone.select("name", "step", "part_idx"), "taken"))
        # objects without a verdict have no piece left to try and are finished
        left = materialize(
            left.join(verdict, "name")
            .where("NOT (ok AND part_idx = pick)")
            .select(
                *PART, "prio",
                F.when(F.col("ok"), F.lit(-1).cast("long")).otherwise(F.col("at")).alias("cursor"),
                (F.col("step") + F.col("ok").cast("long")).alias("step"),
            ),
            "peel",
        )
    out = pieces.select("name", F.lit(0).cast("long").alias("step"), "part_idx").limit(0)
    for t in taken:
        out = out.unionByName(t)
    return out


def removal_plan(
    priority: DataFrame, edges: DataFrame, task_pieces: int = TASK_PIECES
) -> DataFrame:
    """(name, step, part_idx): greedy peel in priority order.

    Each step removes the first piece whose removal leaves exactly one component,
    so the last piece always stays.  ``priority`` is (name, part_idx, prio),
    ``edges`` is (name, i, j).
    """
    name_type = priority.schema["name"].dataType.simpleString()
    sizes = priority.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    sized = materialize(priority.join(sizes, "name"), "priority")
    large = sized.where(F.col("_n") > task_pieces).select("name", "_n").distinct()
    some = not large.isEmpty()
    small, near = sized, edges
    if some:
        links = edges.join(large, "name", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("_e"))
        size = F.col("_n") + F.coalesce("_e", F.lit(0))
        large = materialize(large.join(links, "name", "left").where(size > task_pieces * (task_pieces + 1) // 2).select("name"), "large")
        small, near = (rows.join(large, "name", "left_anti") for rows in (sized, edges))
    # An object is one row: its pieces in order and its edges.
    order = small.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("prio", "part_idx"))).alias("_o"))
    ends = near.groupBy("name").agg(F.collect_set(F.struct("i", "j")).alias("_e"))
    none = F.array().cast("array<long>")
    objects = order.join(ends, "name", "left").select(
        "name", F.col("_o")["part_idx"].cast("array<long>").alias("order"),
        *[F.coalesce(F.col("_e")[c].cast("array<long>"), none).alias(c) for c in "ij"],
    )
    # Lists are short and their peel is not: few bytes must not end up in one task.
    tasks = int(priority.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = objects.repartition(tasks, "name").mapInArrow(_peel_rows, f"name {name_type}, taken array<long>").select(
        "name", F.posexplode("taken").alias("step", "part_idx")
    ).withColumn("step", F.col("step").cast("long"))
    if not some or large.isEmpty():
        return plan
    big, far = (rows.join(large, "name", "left_semi") for rows in (sized, edges))
    return plan.unionByName(_peel_distributed(big, far))
