"""Mesh files as a Spark data source: ``spark.read.format("mesh_files")``.

Reading lists the files below a folder (or those named in a list), groups them by size and
parses each group in a task of its own; a file that cannot be read or parsed becomes a row of
kind 'error'.  The option ``kinds`` leaves out rows that nobody asks for.  Writing takes one text per row and puts it
in place under its final name only when it is complete, so a task that runs twice
leaves one file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage,
)

from .meshes import parse_obj, parse_ply

GROUP_BYTES = 4 << 20  # files of one task
KINDS = ("v", "f", "error")
_SLICE = 1 << 16
SCHEMA = "path string, kind string, idx long, x double, y double, z double, a long, b long, c long, error string"
_ARROW = pa.schema(
    [("path", pa.string()), ("kind", pa.string()), ("idx", pa.int64()),
     *[(c, pa.float64()) for c in "xyz"], *[(c, pa.int64()) for c in "abc"], ("error", pa.string())]
)
SUFFIXES = (".ply", ".obj")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path inside it; plain paths are local."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
    return fs.LocalFileSystem(), path


@dataclass
class FileGroup(InputPartition):
    paths: list[str]


def _parsed(path: str) -> tuple[np.ndarray, np.ndarray] | str:
    """Vertices and triangles of one file, or why it cannot be read or parsed."""
    try:
        system, inner = _open(path)
        with system.open_input_stream(inner) as file:
            data = file.read()
        xyz, tri = (parse_obj if path.lower().endswith(".obj") else parse_ply)(data)
        if len(tri) and (tri.min() < 0 or tri.max() >= len(xyz)):
            raise ValueError("face index out of range")
    except Exception as problem:  # a bad file becomes a row, not a failed job
        return f"{type(problem).__name__}: {problem}"
    return xyz, tri


def _slices(path: str, kinds: tuple[str, ...]) -> Iterator[tuple[str, str, int, np.ndarray | str]]:
    """(path, kind, first number, values) of one file, _SLICE rows at most; an error is its text."""
    found = _parsed(path)
    if isinstance(found, str):
        if "error" in kinds:
            yield path, "error", 0, found
        return
    for kind, values in zip("vf", found):
        if kind in kinds:
            for lo in range(0, len(values), _SLICE):
                yield path, kind, lo, values[lo : lo + _SLICE]


def mesh_batches(paths: Iterable[str], kinds: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of the files; a file that cannot be read or parsed gives one error row.

    Small files share a batch, as a batch costs as much as the rows of a hundred of them.
    """
    held, n = [], 0
    for path in paths:
        for part in _slices(path, kinds):
            size = 1 if part[1] == "error" else len(part[3])
            if held and n + size > _SLICE:
                yield _batch(held)
                held, n = [], 0
            held.append(part)
            n += size
    if held:
        yield _batch(held)


def _batch(parts: list[tuple[str, str, int, np.ndarray | str]]) -> pa.RecordBatch:
    paths, kinds, firsts, values = zip(*parts)
    sizes = np.array([1 if k == "error" else len(v) for k, v in zip(kinds, values)])
    start = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    of = np.repeat(np.arange(len(parts)), sizes)  # the part of every row
    kind = np.array([KINDS.index(k) for k in kinds])[of]
    columns = {
        "path": pa.DictionaryArray.from_arrays(pa.array(of), pa.array(paths, pa.string())).cast(pa.string()),
        "kind": pa.DictionaryArray.from_arrays(pa.array(kind), pa.array(KINDS, pa.string())).cast(pa.string()),
        "idx": pa.array(np.arange(n) - (start - np.array(firsts))[of], mask=kind == KINDS.index("error")),
    }
    for name, letters, dtype in (("v", "xyz", np.float64), ("f", "abc", np.int64)):
        own = kind == KINDS.index(name)
        table = np.zeros((n, 3), dtype)
        if own.any():
            table[own] = np.concatenate([v for k, v in zip(kinds, values) if k == name])
        columns |= {c: pa.array(np.ascontiguousarray(table[:, k]), mask=~own) for k, c in enumerate(letters)}
    errors = [v if k == "error" else None for k, v in zip(kinds, values)]
    if any(e is not None for e in errors):
        columns["error"] = pa.array(errors, pa.string()).take(pa.array(of))
    return pa.RecordBatch.from_arrays(
        [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW
    )


class MeshReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.roots = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.group_bytes = int(options.get("groupbytes", GROUP_BYTES))
        self.kinds = tuple(options.get("kinds", ",".join(KINDS)).split(","))

    def _files(self) -> Iterator[tuple[str, int]]:
        for root in self.roots:
            system, inner = _open(root)
            info = system.get_file_info(inner)
            prefix = root[: len(root) - len(inner)] if root.endswith(inner) else "file://"
            if info.type != fs.FileType.Directory:
                yield root, max(info.size or 0, 0)  # a missing file is found out by its reader
                continue
            below = system.get_file_info(fs.FileSelector(inner, recursive=True))
            for each in sorted(below, key=lambda i: i.path):
                if each.type == fs.FileType.File and each.path.lower().endswith(SUFFIXES):
                    yield prefix + each.path, each.size

    def partitions(self) -> list[FileGroup]:
        groups, held = [], 0
        for path, size in self._files():
            if not groups or held + size > self.group_bytes:
                groups.append(FileGroup([]))
                held = 0
            groups[-1].paths.append(path)
            held += size
        return groups or [FileGroup([])]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        yield from mesh_batches(partition.paths, self.kinds)


class MeshWriter(DataSourceWriter):
    """Rows (file, content): each content becomes the file of that name below the folder."""

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def write(self, iterator) -> WriterCommitMessage:
        for row in iterator:
            system, inner = _open(f"{self.folder}/{row['file']}")
            folder, name = inner.rsplit("/", 1)
            system.create_dir(folder, recursive=True)
            unfinished = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(unfinished) as out:
                out.write(row["content"].encode() if isinstance(row["content"], str) else bytes(row["content"]))
            system.move(unfinished, inner)
        return WriterCommitMessage()


class MeshFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mesh_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MeshReader:
        return MeshReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> MeshWriter:
        return MeshWriter(self.options["path"])


def _known(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(MeshFiles)
    return spark


def read_meshes(
    spark: SparkSession, paths: str | list[str], group_bytes: int = GROUP_BYTES, kinds: tuple[str, ...] = KINDS
) -> DataFrame:
    """Vertex, face and error rows of the mesh files below a folder, or of a list of files and folders."""
    reader = _known(spark).read.format("mesh_files").option("groupBytes", group_bytes).option("kinds", ",".join(kinds))
    return reader.load(paths) if isinstance(paths, str) else reader.option("paths", json.dumps(paths)).load()


def read_listed(files: DataFrame, path: str = "path") -> DataFrame:
    """The same rows for a table of file paths, however long: every task reads the files of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from mesh_batches((p.as_py() for b in batches for p in b.column(0)), KINDS)

    # Paths are short and files are not: a table of few bytes must not end up in one task.
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select(F.col(path).cast("string").alias("path")).repartition(tasks).mapInArrow(run, SCHEMA)


def write_meshes(texts: DataFrame, folder: str) -> None:
    """Write rows (file, content) below ``folder``; writing them again leaves the same files."""
    _known(texts.sparkSession)
    texts.select("file", "content").write.format("mesh_files").mode("append").save(folder)
