"""The most used expressions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

_FUNCTIONS = {
    "quat_rotate": (
        "qw DOUBLE, qx DOUBLE, qy DOUBLE, qz DOUBLE, x DOUBLE, y DOUBLE, z DOUBLE",
        "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>",
        """named_struct(
          'x', (qw*qw - qx*qx - qy*qy - qz*qz)*x + 2*(qx*x + qy*y + qz*z)*qx + 2*qw*(qy*z - qz*y),
          'y', (qw*qw - qx*qx - qy*qy - qz*qz)*y + 2*(qx*x + qy*y + qz*z)*qy + 2*qw*(qz*x - qx*z),
          'z', (qw*qw - qx*qx - qy*qy - qz*qz)*z + 2*(qx*x + qy*y + qz*z)*qz + 2*qw*(qx*y - qy*x))""",
    ),
    "z_code": (
        "gx BIGINT, gy BIGINT, gz BIGINT",
        "BIGINT",
        """aggregate(sequence(0, 15), 0L, (acc, i) -> acc
          | shiftleft(shiftright(gx, i) & 1L, 3*i + 2)
          | shiftleft(shiftright(gy, i) & 1L, 3*i + 1)
          | shiftleft(shiftright(gz, i) & 1L, 3*i))""",
    ),
    "angle_gap": (
        "a DOUBLE, b DOUBLE", "DOUBLE", "least(abs(a - b), 360 - abs(a - b))",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions; returns their names."""
    for name, (args, returns, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    return sorted(_FUNCTIONS)
