"""Removal plans keep the type of object names."""

from pyspark.sql import functions as F

from sherdloom.operators.removal import removal_plan


def test_string_names(spark):
    pieces = spark.range(4).select(F.lit("vase").alias("name"), F.col("id").alias("part_idx"), F.col("id").alias("prio"))
    edges = spark.createDataFrame([("vase", k, k + 1) for k in range(3)], "name string, i long, j long")
    numbered = removal_plan(pieces.withColumn("name", F.lit(1).cast("long")), edges.withColumn("name", F.lit(1).cast("long")))
    named = removal_plan(pieces, edges)
    assert named.schema["name"].dataType.simpleString() == "string"
    steps = lambda df: sorted((r.step, r.part_idx) for r in df.collect())
    assert steps(named) == steps(numbered) and {r.name for r in named.collect()} == {"vase"}


def test_removable_pieces_match_trying_each():
    import random

    from sherdloom.operators.removal import _removable

    def components(neigh, alive):
        n, left = 0, set(alive)
        while left:
            n, todo = n + 1, [left.pop()]
            while todo:
                near = neigh[todo.pop()] & left
                left -= near
                todo.extend(near)
        return n

    rng = random.Random(0)
    for _ in range(3000):
        size = rng.randrange(1, 9)
        neigh = [set() for _ in range(size)]
        for _ in range(rng.randrange(0, 2 * size)):
            a, b = rng.randrange(size), rng.randrange(size)
            if a != b:
                neigh[a].add(b)
                neigh[b].add(a)
        alive = {p for p in range(size) if rng.random() < 0.9}
        want = {p for p in alive if components(neigh, alive - {p}) == 1}
        assert _removable(neigh, alive) == want
