"""The fragment store: committed batches, repeated and failed writes, lookups; crowded contact positions."""

import glob
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sherdloom.operators import contact
from sherdloom.session import fresh_path, materialize
from sherdloom.sources import store


def objects(spark, lo, hi, parts=2):
    rows = spark.range(lo, hi).select(F.concat(F.lit("o"), F.lpad("id", 6, "0")).alias("name"), F.lit("everyday").alias("category"))
    return rows.withColumn("part_idx", F.explode(F.array(*[F.lit(k).cast("long") for k in range(parts)])))


def test_batches_are_committed_once(spark):
    path = fresh_path(spark, "store")
    with pytest.raises(FileNotFoundError):
        store.read_store(spark, path)
    store.write_store(objects(spark, 0, 50), path, "a")
    store.write_store(objects(spark, 0, 80), path, "b")  # 30 of these are new
    before = sorted(map(tuple, store.read_store(spark, path).collect()))
    assert len(before) == 160
    store.write_store(objects(spark, 0, 80), path, "b")
    store.write_store(objects(spark, 0, 50), path, "a")
    assert sorted(map(tuple, store.read_store(spark, path).collect())) == before
    assert Counter(r.batch for r in store.committed(spark, path).collect()) == {"a": 50, "b": 30}


def test_a_write_that_breaks_off_is_not_seen(spark, monkeypatch):
    path = fresh_path(spark, "store")
    store.write_store(objects(spark, 0, 20), path, "a")
    # Data without a manifest entry: the job went away in between.
    store.only_new(objects(spark, 10, 40), store.committed(spark, path)).write.partitionBy("category").parquet(f"{path}/data/batch=b")
    assert store.read_store(spark, path).count() == 40
    store.write_store(objects(spark, 10, 40), path, "b")
    assert store.read_store(spark, path).count() == 80


def test_names_may_be_numbers(spark):
    path = fresh_path(spark, "store")
    rows = spark.range(100).select(F.lit("everyday").alias("category"), F.col("id").alias("name"), F.lit(0).alias("part_idx"))
    store.write_store(rows, path, "a")
    store.write_store(rows, path, "b")
    found = store.lookup(spark, path, 7)
    assert found.count() == 1 and "EqualTo(name,7)" in found._jdf.queryExecution().toString()


def test_lookup_reads_one_row_group(spark):
    path = fresh_path(spark, "store")
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", "false")  # counts rows, not whole batches
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "65536")
    try:
        # Names in no order: every row group spans nearly all of them, so only Bloom filters can tell.
        rows = objects(spark, 0, 20_000).withColumn("name", F.substring(F.md5("name"), 1, 12))
        store.write_store(rows, path, "a")
        name = rows.first().name
        groups = sum(pq.ParquetFile(f).num_row_groups for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True))
        found = store.lookup(spark, path, name)
        scan = found.select("name", "part_idx")
        assert scan.count() == 2 and groups > 4
        plan = scan._jdf.queryExecution().executedPlan()
        scan.collect()
        leaves = plan.collectLeaves()
        read = leaves.head().metrics().apply("numOutputRows").value()
        assert 0 < read <= 40_000 / groups * 2
        assert store.lookup(spark, path, "nobody").count() == 0
    finally:
        hadoop.unset("parquet.block.size")
        spark.conf.set("spark.sql.parquet.enableVectorizedReader", "true")


def crowd(spark, pieces):
    """Pieces that all touch one position, and each the next one at a position of its own."""
    at = spark.range(pieces).select(F.lit(1).alias("name"), F.col("id").alias("part_idx"))
    v = lambda df, x: df.select("name", "part_idx", F.lit(0).cast("long").alias("v_idx"), x.alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return v(at, F.lit(-1.0)).unionByName(v(at, F.col("part_idx") * 1.0)).unionByName(v(at, F.col("part_idx") + 1.0))


def test_tiles_of_a_crowded_position_give_all_edges(spark, monkeypatch):
    monkeypatch.setattr(contact, "TILE_PIECES", 16)
    v = crowd(spark, 100)
    edges = [(r.i, r.j) for r in contact.contact_edges(v).collect()]
    assert sorted(edges) == [(i, j) for i in range(100) for j in range(i + 1, 100)]
    common = contact.common_vertices(v).groupBy("part_idx", "other").count().collect()
    assert len(common) == 100 * 99
    assert all(r["count"] == 1 + (abs(r.part_idx - r.other) == 1) for r in common)


def test_ten_thousand_pieces_at_one_position(spark):
    v = materialize(crowd(spark, 10_000), "crowd")
    spots = v.where("x = -1").select("name", "part_idx", *[F.col(c).alias(p) for c, p in zip("xyz", contact._POS)])
    tiled = contact._tiled(spots)
    assert tiled.agg(F.max(F.size("_pieces"))).first()[0] <= contact.TILE_PIECES
    links = contact.contact_links(v)
    assert links.count() <= 2 * 10_000  # linear, where the edges are fifty million
    parts = contact.connected_components(v.select("name", "part_idx").distinct(), links)
    assert parts.agg(F.count_distinct("component"), F.count("*")).first()[:] == (1, 10_000)
