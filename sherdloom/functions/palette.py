"""Display colours of pieces."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# RGB of the data set view, one per piece, repeating.
DATASET_COLORS = [
    (254, 138, 24), (201, 26, 9), (35, 120, 65), (0, 85, 191), (242, 112, 94),
    (252, 151, 172), (75, 159, 74), (0, 143, 155), (245, 205, 47), (67, 84, 163),
    (179, 215, 209), (199, 210, 60), (255, 128, 13),
]

# RGB of the ad-hoc input view.
INPUT_COLORS = [
    (0, 204, 0), (204, 0, 0), (0, 0, 204), (127, 127, 0), (127, 0, 127), (0, 127, 127),
    (76, 153, 0), (153, 0, 76), (76, 0, 153), (153, 76, 0), (76, 0, 153), (153, 0, 76),
    (204, 51, 127), (204, 51, 127), (51, 204, 127), (51, 127, 204), (127, 51, 204),
    (127, 204, 51), (76, 76, 178), (76, 178, 76), (178, 76, 76),
]


def color(part_idx: Column, palette: list[tuple[int, int, int]]) -> tuple[Column, Column, Column]:
    """Red, green and blue of a piece."""
    at = (part_idx % len(palette)).cast("int")
    return tuple(
        F.get(F.array(*[F.lit(c[i]).cast("long") for c in palette]), at) for i in range(3)
    )
