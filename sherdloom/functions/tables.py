"""Table functions that SQL can call."""

from __future__ import annotations

import math
from operator import itemgetter

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..operators.sampling import OVERSAMPLE, WEIGHT_UNITS
from ..operators.thinning import thin
from .rand import DEFAULT_SEED, keys_of, uniforms_of

_CORNERS = [f"{p}{x}" for p in "abc" for x in "xyz"]
_NORMAL = ["fnx", "fny", "fnz"]
FACE_COLUMNS = ("name", "part_idx", "f_idx", "n_points", "area", *_CORNERS, *_NORMAL)
STRATEGIES = ("uniform", "poisson")


class SampleSurface:
    """Surface points of the piece whose faces a partition of the table argument holds.

    ``SELECT * FROM sample_surface(TABLE(faces) PARTITION BY (name, part_idx), 'uniform', 1116)``
    reads the columns FACE_COLUMNS of every face (others are ignored) and gives the points that
    ``sample_uniform`` or, for 'poisson', ``sample_even`` gives, to the last bit.  A call holds
    one piece, as the reader of its mesh file does; for pieces beyond a task's memory the
    DataFrame samplers do the same with bounded tasks.  Several pieces in one partition are kept apart.
    """

    @staticmethod
    def analyze(faces: AnalyzeArgument, strategy: AnalyzeArgument = None, seed: AnalyzeArgument = None) -> AnalyzeResult:
        if not faces.isTable:
            raise ValueError("sample_surface takes a table of faces: TABLE(...) PARTITION BY (name, part_idx)")
        fields = {f.name: f for f in faces.dataType.fields}
        missing = [c for c in FACE_COLUMNS if c not in fields]
        if missing:
            raise ValueError(f"sample_surface misses the columns {', '.join(missing)}")
        if strategy is not None and strategy.value not in STRATEGIES:
            raise ValueError(f"sample_surface knows the strategies {', '.join(STRATEGIES)}")
        keys = [StructField(c, fields[c].dataType) for c in ("name", "part_idx")]
        return AnalyzeResult(
            StructType(
                [*keys, StructField("pt_idx", LongType()), StructField("f_idx", LongType()),
                 *[StructField(c, DoubleType()) for c in ("x", "y", "z", "nx", "ny", "nz")]]
            )
        )

    def __init__(self) -> None:
        self.pieces: dict[tuple, tuple[int, list]] = {}
        self.strategy, self.seed = "uniform", DEFAULT_SEED
        self.pick = None  # takes FACE_COLUMNS out of a row; a row looks a name up in all its names

    def eval(self, faces, strategy="uniform", seed=DEFAULT_SEED):
        if self.pick is None:
            self.strategy, self.seed = strategy, seed
            self.pick = itemgetter(*map(faces.__fields__.index, FACE_COLUMNS))
        name, part_idx, f_idx, n_points, area, *values = self.pick(tuple(faces))
        held = self.pieces.get((name, part_idx))
        if held is None:
            held = self.pieces[name, part_idx] = (n_points, [])
        if area is not None and area > 0:
            held[1].append((f_idx, area, *values))

    def terminate(self):
        for piece, (n, rows) in self.pieces.items():
            if rows:
                sampler = Piece(piece, rows, self.seed)
                f_idx, values = (sampler.even if self.strategy == "poisson" else sampler.uniform)(n)
                for pt_idx, (face, row) in enumerate(zip(f_idx.tolist(), values.tolist())):
                    yield (*piece, pt_idx, face, *row)


class Piece:
    """The faces of one piece and the draws on them: face numbers, and points with normals."""

    def __init__(self, piece: tuple, rows: list[tuple], seed: int) -> None:
        self.piece, self.seed = piece, seed
        rows = sorted(rows)
        self.f_idx = np.array([r[0] for r in rows])
        faces = np.array([r[1:] for r in rows], dtype=np.float64)
        area = faces[:, 0]
        self.corners, self.normals = faces[:, 1:10].reshape(-1, 3, 3), faces[:, 10:]
        self.area = math.fsum(area)
        weights = np.ceil(area / area.max() * WEIGHT_UNITS).astype(np.int64)
        hi = np.cumsum(weights)
        self.lo, self.total = hi - weights, int(hi[-1])

    def uniform(self, n: int, stream: str = "uniform") -> tuple[np.ndarray, np.ndarray]:
        draw, s, t = (uniforms_of(self.seed, n, stream + suffix, *self.piece) for suffix in ("", "1", "2"))
        at = np.minimum(np.floor(draw * self.total).astype(np.int64), self.total - 1)
        face = np.searchsorted(self.lo, at, "right") - 1
        fold = s + t > 1
        s, t = (np.where(fold, 1 - v, v)[:, None] for v in (s, t))
        a, b, c = (self.corners[face, k] for k in range(3))
        return self.f_idx[face], np.concatenate([a + ((b - a) * s + (c - a) * t), self.normals[face]], axis=1)

    def even(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates thinned in rounds, the first ``n`` of what is kept, and uniform draws for the rest."""
        radius = math.sqrt(self.area / (OVERSAMPLE * n)) if n > 0 else 1.0
        f_idx, values = self.uniform(OVERSAMPLE * n, "even")
        m = len(f_idx)
        keys = keys_of(self.seed, m, "prio", *self.piece)
        kept = np.flatnonzero(thin(np.zeros(m, np.int64), np.arange(m), keys, values[:, :3], np.full(m, radius)))[: max(n, 0)]
        more, rest = self.uniform(n - len(kept), "top-up")
        return np.concatenate([f_idx[kept], more]), np.concatenate([values[kept], rest])


def register(spark: SparkSession) -> list[str]:
    """Make the table functions known to a session; returns their names."""
    spark.udtf.register("sample_surface", udtf(SampleSurface))
    return ["sample_surface"]
