"""Inputs beyond a documented range are errors, not wrong rows."""

import pytest
from pyspark.sql import functions as F

from sherdloom.functions import curve, schedule
from sherdloom.operators.ordering import prefix_sum


def test_cells_beyond_the_depth(spark):
    cells = spark.createDataFrame([(1, 2, 8, 0)], "gx long, gy long, gz long, b long")
    with pytest.raises(Exception, match="does not fit"):
        curve.with_code(cells, "z", 3).collect()
    assert curve.with_code(cells, "z", 4, batch="b").count() == 1
    with pytest.raises(Exception, match="does not fit"):
        curve.with_code(cells.withColumn("b", F.lit(-1)), "z", 4, batch="b").collect()


def test_running_sum_beyond_its_levels(spark):
    rows = spark.createDataFrame([("k", 1 << 32, 1.0)], "k string, i long, v double")
    with pytest.raises(Exception, match="outside the range"):
        prefix_sum(rows, ["k"], "i", "v", "s").collect()
    assert prefix_sum(rows, ["k"], "i", "v", "s", levels=3).first()["s"] == 1.0


def test_unknown_timesteps(spark):
    rows = spark.createDataFrame([(500.0,), (501.0,)], "timestep double")
    table = schedule.sigma_table(spark, 4)
    with pytest.raises(Exception, match="not in the schedule"):
        schedule.sigma_lookup(rows, table).collect()
    assert schedule.sigma_lookup(rows.where("timestep = 500"), table).count() == 1
