"""PLY and OBJ files into vertex and face tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.metrics import PART
from ..operators.ordering import with_rank
from ..session import materialize

_SLICE = 1 << 16
MAX_TEXT_LINES = 1 << 20
_PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2",
    "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4",
    "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8",
}
_SCHEMA = (
    "path string, kind string, idx long, x double, y double, z double, a long, b long, c long, error string"
)


def _fan(polygons: list[list[int]]) -> np.ndarray:
    tri = [(p[0], p[i], p[i + 1]) for p in polygons for i in range(1, len(p) - 1)]
    return np.array(tri, dtype="int64").reshape(-1, 3)


def _ply_header(data: bytes):
    end = data.index(b"end_header")
    body = data.index(b"\n", end) + 1
    elements, fmt = [], None
    for line in data[:end].decode("ascii").splitlines():
        word = line.split()
        if word[:1] == ["format"]:
            fmt = word[1]
        elif word[:1] == ["element"]:
            elements.append((word[1], int(word[2]), []))
        elif word[:1] == ["property"]:
            elements[-1][2].append(word[1:])
    return fmt, elements, body


def _triangles(data: bytes, at: int, count: int, props: list) -> tuple[np.ndarray, int] | None:
    """Faces that are all triangles, read as one table, and where they end; None for others."""
    fields, corners = [], None
    for p in props:
        if p[0] != "list":
            fields.append((p[-1], _PLY_TYPES[p[0]]))
        elif p[-1] in ("vertex_indices", "vertex_index"):
            corners = p[-1]
            fields += [("_n", _PLY_TYPES[p[1]]), (corners, _PLY_TYPES[p[2]], (3,))]
        else:
            return None
    dtype = np.dtype(fields)
    if corners is None or at + dtype.itemsize * count > len(data):
        return None
    table = np.frombuffer(data, dtype, count, at)
    if (table["_n"] != 3).any():
        return None
    return table[corners].astype("int64").reshape(-1, 3), at + dtype.itemsize * count


def _even_lines(lines: list[str], count: int, width: int, dtype: type) -> np.ndarray | None:
    """Lines of equally many plain numbers, ``width`` at least, read as one table; None for others."""
    if count < 1 or len(lines) != count:
        return None
    try:
        table = np.loadtxt(lines, dtype, comments=None, ndmin=2)
    except ValueError:
        return None
    return table if len(table) == count and table.shape[1] >= width else None


def parse_ply(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (V, 3) and triangles (F, 3) of an ascii or little-endian PLY file."""
    fmt, elements, at = _ply_header(data)
    if fmt not in ("ascii", "binary_little_endian"):
        raise ValueError(f"unsupported PLY format {fmt}")
    lines = data[at:].decode("ascii").split("\n") if fmt == "ascii" else None
    line = 0
    xyz, polygons, triangles = np.empty((0, 3)), [], None
    for name, count, props in elements:
        has_list = any(p[0] == "list" for p in props)
        if lines is not None:
            held = lines[line : line + max(count, 0)]
            line += len(held)
            if len(held) < count:
                raise StopIteration
            if name == "vertex":
                order = [p[-1] for p in props]
                cols = [order.index(c) for c in "xyz"]
                table = _even_lines(held, count, max(cols) + 1, float)
                if table is not None:
                    xyz = table[:, cols]
                else:
                    xyz = np.array([[float(r[c]) for c in cols] for r in map(str.split, held)]).reshape(-1, 3)
            elif name == "face":
                table = _even_lines(held, count, 4, np.int64)
                if table is not None and (table[:, 0] == 3).all():
                    triangles = table[:, 1:4]
                else:
                    triangles = None
                    polygons = [[int(v) for v in r[1 : 1 + int(r[0])]] for r in map(str.split, held)]
        elif not has_list:
            dtype = np.dtype([(p[-1], _PLY_TYPES[p[0]]) for p in props])
            table = np.frombuffer(data, dtype, count, at)
            at += dtype.itemsize * count
            if name == "vertex":
                xyz = np.stack([table[c].astype("f8") for c in "xyz"], axis=1)
        elif name == "face" and (found := _triangles(data, at, count, props)) is not None:
            triangles, at = found
        else:
            for _ in range(count):
                for p in props:
                    if p[0] == "list":
                        size = np.dtype(_PLY_TYPES[p[1]])
                        item = np.dtype(_PLY_TYPES[p[2]])
                        n = int(np.frombuffer(data, size, 1, at)[0])
                        at += size.itemsize
                        values = np.frombuffer(data, item, n, at)
                        at += item.itemsize * n
                        if name == "face" and p[-1] in ("vertex_indices", "vertex_index"):
                            polygons.append([int(v) for v in values])
                    else:
                        at += np.dtype(_PLY_TYPES[p[0]]).itemsize
    return xyz, _fan(polygons) if triangles is None else triangles


def parse_obj(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles of an OBJ file; indices may be negative or carry slashes."""
    xyz, polygons = [], []
    for line in data.decode("utf-8").splitlines():
        word = line.split()
        if word[:1] == ["v"]:
            xyz.append([float(v) for v in word[1:4]])
        elif word[:1] == ["f"]:
            idx = [int(v.split("/")[0]) for v in word[1:]]
            polygons.append([i - 1 if i > 0 else len(xyz) + i for i in idx])
    return np.array(xyz, dtype="f8").reshape(-1, 3), _fan(polygons)


def _plain(rows: pd.DataFrame) -> pd.DataFrame:
    """Text columns as Python strings, which every Arrow conversion accepts."""
    return rows.astype({c: object for c in ("path", "kind", "error")})


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _SCHEMA.split(", ")]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                read = parse_obj if path.lower().endswith(".obj") else parse_ply
                xyz, tri = read(bytes(content))
                if len(tri) and (tri.min() < 0 or tri.max() >= len(xyz)):
                    raise ValueError("face index out of range")
            except Exception as problem:  # a bad file becomes a row, not a failed job
                row = {"path": path, "kind": "error", "error": str(problem)}
                yield _plain(pd.DataFrame([row], columns=columns))
                continue
            for kind, values, names in (("v", xyz, "xyz"), ("f", tri, "abc")):
                for lo in range(0, len(values), _SLICE):
                    part = pd.DataFrame(values[lo : lo + _SLICE], columns=list(names))
                    part["path"], part["kind"] = path, kind
                    part["idx"] = np.arange(lo, lo + len(part))
                    yield _plain(part.reindex(columns=columns))


def mesh_rows(files: DataFrame) -> DataFrame:
    """Vertex, face and error rows of files given as (path, content)."""
    return files.select("path", "content").mapInPandas(_parse, _SCHEMA)


def read_mesh_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, content) of mesh files below a folder or of an explicit list."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{ply,obj}")
        .load(paths)
        .select("path", "content")
    )


def mesh_tables(files: DataFrame, root: str = "") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pieces, vertices, faces, errors) of mesh files given as (path, content)."""
    return tables_of(mesh_rows(files), root)


def tables_of(rows: DataFrame, root: str = "") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pieces, vertices, faces, errors) of the rows of mesh files.

    The object is the folder below ``root``, the piece the file stem.  Pieces are
    numbered by length and name, so piece_2 comes before piece_10.  An object with
    an unreadable piece is left out and appears in ``errors``.
    """
    rows = materialize(rows, "mesh-rows")
    name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    if root:
        name = F.regexp_replace(name, r"^.*?" + root.strip("/") + "/", "")

    def named(table: DataFrame) -> DataFrame:
        return table.withColumn("name", name).withColumn("piece", F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1))

    # Names are taken from a path once a file, not once a row.
    errors = materialize(named(rows.where("kind = 'error'")).select("name", "piece", "error"), "mesh-errors")
    files = materialize(named(rows.select("path").distinct()), "mesh-names")
    good = files.select("name", "piece").distinct().join(errors.select("name").distinct(), "name", "left_anti")
    stems = good.withColumn("_len", F.length("piece"))
    pieces = materialize(
        with_rank(stems, ["name"], ["_len", "piece"], "part_idx").drop("_len"), "pieces"
    )
    numbered = materialize(files.join(pieces, ["name", "piece"]).select("path", *PART), "mesh-files")
    vertices = rows.where("kind = 'v'").join(numbered, "path").select(*PART, F.col("idx").alias("v_idx"), "x", "y", "z")
    faces = rows.where("kind = 'f'").join(numbered, "path").select(*PART, F.col("idx").alias("f_idx"), "a", "b", "c")
    return pieces, vertices, faces, errors


def to_ply(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(name, part_idx, content): ascii PLY text of every piece, one file per row.

    A text of more than ``MAX_TEXT_LINES`` vertices or faces is refused up front.
    """

    def bounded(idx):
        return F.when(F.col(idx) < MAX_TEXT_LINES, F.col(idx)).otherwise(
            F.raise_error(F.lit("piece too large for a text file")).cast("long")
        ).alias(idx)

    v_lines = vertices.groupBy(*PART).agg(
        F.sort_array(
            F.collect_list(F.struct(bounded("v_idx"), F.concat_ws(" ", "x", "y", "z").alias("line")))
        ).alias("v")
    )
    f_lines = faces.groupBy(*PART).agg(
        F.sort_array(
            F.collect_list(F.struct(bounded("f_idx"), F.concat_ws(" ", F.lit("3"), "a", "b", "c").alias("line")))
        ).alias("f")
    )
    header = F.concat(
        F.lit("ply\nformat ascii 1.0\nelement vertex "), F.size("v").cast("string"),
        F.lit("\nproperty double x\nproperty double y\nproperty double z\nelement face "),
        F.coalesce(F.size("f"), F.lit(0)).cast("string"),
        F.lit("\nproperty list uchar int vertex_indices\nend_header\n"),
    )
    lines = F.concat(F.transform("v", lambda s: s["line"]), F.coalesce(F.transform("f", lambda s: s["line"]), F.array()))
    return v_lines.join(f_lines, PART, "left").select(
        *PART, F.concat(header, F.array_join(lines, "\n"), F.lit("\n")).alias("content")
    )
