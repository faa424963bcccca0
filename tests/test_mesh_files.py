"""Mesh files through the data source: formats, groups, broken and missing files, repeated writes."""

import struct

import numpy as np
from pyspark.sql import functions as F

from sherdloom.session import fresh_path
from sherdloom.sources import mesh_files, meshes

TETRA = ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1.5)], [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)])


def ascii_ply(vertices, faces):
    head = f"ply\nformat ascii 1.0\nelement vertex {len(vertices)}\nproperty float x\nproperty float y\nproperty float z\n"
    head += f"element face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n"
    return head + "".join(" ".join(map(str, v)) + "\n" for v in vertices) + "".join(
        f"{len(f)} {' '.join(map(str, f))}\n" for f in faces
    )


def binary_ply(vertices, faces):
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(vertices)}\nproperty float x\nproperty float y\nproperty double z\n"
    head += f"element face {len(faces)}\nproperty uchar colour\nproperty list uchar int vertex_indices\nend_header\n"
    body = b"".join(struct.pack("<ffd", *v) for v in vertices)
    return head.encode() + body + b"".join(struct.pack(f"<BB{len(f)}i", 7, len(f), *f) for f in faces)


def obj(vertices, faces):
    return "".join(f"v {x} {y} {z}\n" for x, y, z in vertices) + "".join(
        "f " + " ".join(f"{k + 1}//1" for k in f) + "\n" for f in faces
    )


def folder_of(spark, files):
    folder = fresh_path(spark, "mesh-test")
    rows = [(name, bytearray(text.encode() if isinstance(text, str) else text)) for name, text in files.items()]
    mesh_files.write_meshes(spark.createDataFrame(rows, "file string, content binary").repartition(3), folder)
    return folder


def rows_of(df):
    return sorted(
        (r.path.rsplit("/", 1)[1], r.kind, r.idx, *[v for v in (r.x, r.y, r.z, r.a, r.b, r.c) if v is not None]) for r in df.collect()
    )


def expected(name):
    v, f = TETRA
    return [(name, "v", k, *map(float, p)) for k, p in enumerate(v)] + [(name, "f", k, *t) for k, t in enumerate(f)]


def test_formats_groups_and_broken_files(spark):
    quads = ([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], [(0, 1, 2, 3)])
    folder = folder_of(spark, {
        "a/p0.ply": ascii_ply(*TETRA), "a/p1.ply": binary_ply(*TETRA), "b/p2.obj": obj(*TETRA), "b/p3.ply": binary_ply(*quads),
        "c/p4.ply": ascii_ply(*TETRA)[:60], "c/p5.ply": ascii_ply(TETRA[0], [(0, 1, 9)]), "c/notes.txt": "not a mesh",
        "d/p6.ply": "",
    })
    got = mesh_files.read_meshes(spark, folder, group_bytes=1)
    assert got.rdd.getNumPartitions() == 7  # one file a task
    assert mesh_files.read_meshes(spark, folder).rdd.getNumPartitions() == 1
    rows = rows_of(got)
    for name in ("p0.ply", "p1.ply", "p2.obj"):
        assert [r for r in rows if r[0] == name] == sorted(expected(name))
    assert [r[3:] for r in rows if r[:2] == ("p3.ply", "f")] == [(0, 1, 2), (0, 2, 3)]
    assert [r[0] for r in rows if r[1] == "error"] == ["p4.ply", "p5.ply", "p6.ply"]
    assert "out of range" in got.where("kind = 'error' AND path LIKE '%p5%'").first().error
    pieces, vertices, _, errors = meshes.tables_of(got, folder.rsplit("/", 1)[1])
    assert {r.name for r in pieces.collect()} == {"a", "b"} and {r.name for r in errors.collect()} == {"c", "d"}
    assert vertices.where("name = 'a'").count() == 8


def test_rows_nobody_asks_for_are_not_made(spark):
    folder = folder_of(spark, {"a/p0.ply": ascii_ply(*TETRA), "a/p1.ply": "ply"})
    assert {r.kind for r in mesh_files.read_meshes(spark, folder, kinds=("f",)).collect()} == {"f"}
    assert {r.kind for r in mesh_files.read_meshes(spark, folder, kinds=("v", "error")).collect()} == {"v", "error"}
    # A filter on one reading leaves the next one whole.
    rows = mesh_files.read_meshes(spark, folder)
    assert rows.where("kind = 'f'").count() == 4 and rows.count() == 9


def test_lists_of_paths(spark):
    folder = folder_of(spark, {"a/p0.ply": ascii_ply(*TETRA), "b/p1.obj": obj(*TETRA)})
    paths = [f"{folder}/a/p0.ply", f"{folder}/b/p1.obj", f"{folder}/b/gone.ply"]
    as_list = rows_of(mesh_files.read_meshes(spark, paths))
    table = spark.createDataFrame([(p, 1) for p in paths], "path string, kind int").repartition(2)
    assert rows_of(mesh_files.read_listed(table)) == as_list
    assert [r[:2] for r in as_list if r[1] == "error"] == [("gone.ply", "error")]
    assert mesh_files.read_listed(table.where("false")).count() == 0
    empty = fresh_path(spark, "mesh-empty")
    spark.range(0).write.parquet(empty)
    assert mesh_files.read_meshes(spark, empty).count() == 0


def test_writing_again_leaves_the_same_files(spark):
    files = {"a/p0.ply": ascii_ply(*TETRA)}
    folder = folder_of(spark, files)
    before = rows_of(mesh_files.read_meshes(spark, folder))
    df = spark.createDataFrame([("a/p0.ply", files["a/p0.ply"])], "file string, content string")
    mesh_files.write_meshes(df, folder)
    assert rows_of(mesh_files.read_meshes(spark, folder)) == before


def test_binary_triangles_are_read_as_a_table():
    rng = np.random.default_rng(1)
    v = rng.uniform(size=(500, 3)).astype("f4").astype("f8")
    f = rng.integers(0, 500, (900, 3))
    xyz, tri = meshes.parse_ply(binary_ply(v.tolist(), f.tolist()))
    assert (xyz == v).all() and (tri == f).all()
    mixed = [*f.tolist()[:5], [1, 2, 3, 4], *f.tolist()[5:9]]
    _, tri = meshes.parse_ply(binary_ply(v.tolist(), mixed))
    assert len(tri) == 11 and tri[5:7].tolist() == [[1, 2, 3], [1, 3, 4]]


def test_small_files_share_a_batch(spark, tmp_path):
    """Rows keep their order and numbers, whatever files and kinds a batch holds."""
    quads = ([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)], [(0, 1, 2, 3)])
    files = {f"p{k}.ply": ascii_ply(*TETRA) for k in range(50)} | {
        "q.ply": ascii_ply(*quads), "r.obj": obj(*TETRA), "s.ply": "ply", "t.ply": ascii_ply(TETRA[0], []),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / name) for name in (*files, "gone.ply")]
    batches = list(mesh_files.mesh_batches(paths, mesh_files.KINDS))
    assert len(batches) == 1
    rows = [(r["path"].rsplit("/", 1)[1], r["kind"], r["idx"], *[r[c] for c in "xyzabc" if r[c] is not None]) for r in batches[0].to_pylist()]
    assert rows[: 8 * 50] == [r for k in range(50) for r in expected(f"p{k}.ply")]
    assert [r for r in rows if r[:2] == ("q.ply", "f")] == [("q.ply", "f", 0, 0, 1, 2), ("q.ply", "f", 1, 0, 2, 3)]
    assert [r[:3] for r in rows if r[1] == "error"] == [("s.ply", "error", None), ("gone.ply", "error", None)]
    assert [r for r in rows if r[0] == "t.ply"] == expected("t.ply")[:4]
    assert all((r["error"] is None) == (r["kind"] != "error") for r in batches[0].to_pylist())
    large = tmp_path / "large.ply"
    large.write_text(ascii_ply([(k, 0, 0.5) for k in range(70_000)], [(0, 1, 2)] * 3))
    got = [b.to_pylist() for b in mesh_files.mesh_batches([paths[0], str(large), paths[0]], ("v",))]
    assert max(map(len, got)) <= 1 << 16 and sum(map(len, got)) == 70_008
    assert [(r["idx"], r["x"]) for b in got for r in b if r["path"] == str(large)] == [(k, float(k)) for k in range(70_000)]


def test_lines_of_other_forms_are_read_as_before():
    """Plain even lines are read as a table; all others line by line, with the same numbers and refusals."""
    head = "ply\nformat ascii 1.0\nelement vertex 3\nproperty double z\nproperty double x\nproperty double y\nelement face {}\nproperty list uchar int vertex_indices\nend_header\n"
    body = "3 1 2\n6  4e0\t5\r\n9 7 -8.5 99\n"
    for spelled in (body, body.replace(" 99", ""), body.replace("4e0", "4_0")):
        xyz, tri = meshes.parse_ply((head.format(3) + spelled + "3 0 1 2\n4 0 1 2 0\n2 0 1\n").encode())
        assert xyz.tolist() == [[1, 2, 3], [40.0 if "_" in spelled else 4, 5, 6], [7, -8.5, 9]]
        assert tri.tolist() == [[0, 1, 2], [0, 1, 2], [0, 2, 0]]
    _, tri = meshes.parse_ply((head.format(2) + body + "3 0 1 2\n3 2 1 0\n").encode())
    assert tri.tolist() == [[0, 1, 2], [2, 1, 0]]
    for bad, problem in (("3 0 1 2.0\n", ValueError), ("3 0 1 2\n", StopIteration), ("", StopIteration)):
        try:
            meshes.parse_ply((head.format(1 if "." in bad else 3) + body + bad).encode())
        except problem:
            continue
        raise AssertionError(bad)


def test_names_are_taken_once_a_file(spark):
    """Only the paths of files meet the patterns for object and piece, not every row."""
    folder = folder_of(spark, {"a/p0.ply": ascii_ply(*TETRA), "a/p1.ply": ascii_ply(*TETRA), "b/p0.ply": "ply"})
    _, vertices, faces, errors = meshes.tables_of(mesh_files.read_meshes(spark, folder), folder.rsplit("/", 1)[1])
    for table in (vertices, faces):
        assert "regexp" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert vertices.count() == 8 and [tuple(r)[:2] for r in errors.collect()] == [("b", "p0")]
    twice = mesh_files.read_meshes(spark, folder)
    assert meshes.tables_of(twice.unionByName(twice), folder.rsplit("/", 1)[1])[2].count() == 16


def test_preparation_reads_written_meshes(spark, monkeypatch):
    """The joins that number the pieces run once, not once for each table of the store."""
    from sherdloom.plans import prepare

    folder = folder_of(spark, {"a/p0.ply": ascii_ply(*TETRA), "a/p1.obj": obj(*TETRA)})
    _, vertices, faces, _ = meshes.tables_of(mesh_files.read_meshes(spark, folder), folder.rsplit("/", 1)[1])
    made = prepare.prepare_objects(vertices, faces)
    for name in ("vertices", "faces", "measures"):
        assert "mesh-rows" not in " ".join(made[name].inputFiles()), name
    assert "Join" not in made["vertices"]._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.part_idx, r.area > 0) for r in made["measures"].collect()} == {(0, True), (1, True)}
    assert [tuple(r) for r in made["edges"].collect()] == [("a", 0, 1)] and made["faces"].where("shared_with >= 0").count() == 8
