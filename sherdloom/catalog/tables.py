"""Sources, sinks, predicates, set operations and packing."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import palette
from ..functions.rand import DEFAULT_SEED
from ..operators import metrics as M, packing as P
from ..operators.contact import contact_edges
from ..operators.metrics import PART
from ..plans import segmentation as SEG
from ..session import fresh_path, materialize
from ..sources import gallery as GA, mesh_files as MF, meshes as ME, results as R, splits as SP, store as ST
from . import duck
from .clouds import _SIZES
from .flows import _PATH, _RQ, _trajectory
from .meshes import DENSE, EDGES
from .metrics import ERR, _REPORT_SQL, part_sizes
from .poses import GQ, GT, PQ, PT_, rounded
from .registry import query

MAIN = ("1-URGENT", "2-HIGH")
_NP = f"{duck.PARTS}, np AS (SELECT name, count(*) AS num_parts FROM parts GROUP BY name)"


@query("s01_split_list_scan", f"WITH {duck.SPLITS} SELECT category, split, name FROM splits")
def split_list_scan(spark, sf):
    path = fresh_path(spark, "lists")
    named = F.concat("category", F.lit("."), "split", F.lit(".txt"))
    fx.splits(spark, sf).select(named.alias("list"), F.concat(F.lit("  "), "name", F.lit(" ")).alias("value")).write.partitionBy("list").text(path)
    return SP.read_split_lists(spark, path)


@query("s02_flatten_split_lists", f"WITH {duck.SPLITS} SELECT name FROM splits")
def flatten(spark, sf):
    return SP.flatten_names(fx.splits(spark, sf))


def _files(spark, sf):
    """File paths: even orders hold mesh files themselves, odd ones in sub-folders."""
    folder = (
        F.when(F.col("name") % 2 == 0, F.lit(""))
        .when(F.col("part_idx") % 3 == 0, F.lit("fractured_0/"))
        .when(F.col("part_idx") % 3 == 1, F.lit("mode_1/"))
        .otherwise(F.lit("notes/"))
    )
    return fx.parts(spark, sf).select(
        F.concat(F.col("name").cast("string"), F.lit("/"), folder, F.lit("piece_"), "part_idx", F.lit(".ply")).alias("path")
    )


@query(
    "p02_fracture_folders",
    f"""WITH {duck.SPLITS}, {duck.PARTS} SELECT category, split, s.name FROM splits s JOIN (SELECT DISTINCT name FROM parts WHERE name % 2 = 0) p ON s.name = CAST(p.name AS VARCHAR)
    UNION ALL SELECT category, split, s.name || '/' || f FROM splits s JOIN (
      SELECT DISTINCT name, CASE WHEN part_idx % 3 = 0 THEN 'fractured_0' ELSE 'mode_1' END AS f FROM parts WHERE name % 2 = 1 AND part_idx % 3 < 2) p ON s.name = CAST(p.name AS VARCHAR)""",
)
def fracture_folders(spark, sf):
    return SP.expand_fractures(fx.splits(spark, sf), SP.folder_entries(_files(spark, sf)))


@query(
    "s01_missing_objects",
    f"WITH {duck.SPLITS}, {duck.PARTS} SELECT category, split, name FROM splits WHERE name NOT IN (SELECT CAST(name AS VARCHAR) FROM parts)",
)
def missing_objects(spark, sf):
    missing = SP.missing_objects(fx.splits(spark, sf), SP.folder_entries(_files(spark, sf)))
    return missing.select("category", "split", "name")


@query(
    "p03_piece_files",
    f"WITH {duck.PARTS} SELECT CAST(name AS VARCHAR) AS dir, 'piece_' || part_idx AS piece FROM parts WHERE name % 2 = 0 "
    "UNION ALL SELECT name || CASE WHEN part_idx % 3 = 0 THEN '/fractured_0' WHEN part_idx % 3 = 1 THEN '/mode_1' ELSE '/notes' END, 'piece_' || part_idx FROM parts WHERE name % 2 = 1",
)
def piece_files(spark, sf):
    return SP.piece_files(SP.folder_entries(_files(spark, sf)))


# Every tenth object has a file that breaks off, which drops the object.
BROKEN = "name % 10 = 3"
_WHOLE = "whole AS (SELECT * FROM verts WHERE NOT name % 10 = 3), whole_faces AS (SELECT * FROM faces WHERE NOT name % 10 = 3)"


def mesh_folder(spark, sf):
    """A folder of mesh files, one folder per object and one file per piece."""
    folder = fresh_path(spark, "meshes")
    pieces = ME.to_ply(fx.vertices(spark, sf), fx.faces(spark, sf))
    broken = pieces.where(BROKEN).select("name").distinct().select(
        F.concat_ws("/", "name", F.lit("piece_9.ply")).alias("file"),
        F.lit("ply\nformat ascii 1.0\nelement vertex 9\nproperty double x\n").alias("content"),
    )
    MF.write_meshes(
        pieces.select(F.concat_ws("/", "name", F.concat(F.lit("piece_"), "part_idx", F.lit(".ply"))).alias("file"), "content")
        .unionByName(broken), folder,
    )
    return folder


def mesh_folder_tables(rows, folder):
    """(pieces, vertices, faces, errors) of a folder's rows, objects under their numbers."""
    return [
        t.withColumn("name", F.col("name").cast("long"))
        for t in ME.tables_of(rows, folder.rsplit("/", 1)[1])
    ]


@query(
    "s03_mesh_file_scan",
    f"""WITH {DENSE}, {_WHOLE} SELECT name, part_idx, v_idx, x, y, z, 'v' AS kind FROM whole
    UNION ALL SELECT name, part_idx, f_idx, CAST(a AS DOUBLE), CAST(b AS DOUBLE), CAST(c AS DOUBLE), 'f' FROM whole_faces
    UNION ALL SELECT DISTINCT name, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 'error' FROM verts WHERE {BROKEN}""",
)
def mesh_file_scan(spark, sf):
    folder = mesh_folder(spark, sf)
    _, vertices, faces, errors = mesh_folder_tables(MF.read_meshes(spark, folder), folder)
    rows = vertices.withColumn("kind", F.lit("v")).unionByName(
        faces.select(
            *PART, F.col("f_idx").alias("v_idx"),
            *[F.col(p).cast("double").alias(q) for p, q in zip("abc", "xyz")], F.lit("f").alias("kind"),
        )
    )
    return rows.unionByName(errors.select("name", F.lit("error").alias("kind")), allowMissingColumns=True)


@query(
    "s10_ad_hoc_mesh_list",
    f"""WITH {DENSE}, n AS (SELECT name, CAST(count(DISTINCT part_idx) AS BIGINT) AS num_parts, count(*) AS n_vertices, {duck.r('sum(x + 2*y + 3*z)', 'places')}
      FROM verts WHERE NOT {BROKEN} GROUP BY name),
    m AS (SELECT name, count(*) AS n_faces, CAST(sum(a + 2*b + 3*c) AS BIGINT) AS corners FROM faces GROUP BY name)
    SELECT name, num_parts, n_vertices, places, n_faces, corners, greatest(5, num_parts) AS padded FROM n JOIN m USING (name)""",
)
def ad_hoc_meshes(spark, sf):
    """The files of a list of paths, which is a table itself."""
    folder = mesh_folder(spark, sf)
    listed = MF.read_meshes(spark, folder).select("path").distinct()
    _, vertices, faces, _ = mesh_folder_tables(MF.read_listed(listed), folder)
    places = F.col("x") + 2 * F.col("y") + 3 * F.col("z")
    n = vertices.groupBy("name").agg(
        F.count_distinct("part_idx").alias("num_parts"), F.count(F.lit(1)).alias("n_vertices"), F.sum(places).alias("places")
    )
    m = faces.groupBy("name").agg(
        F.count(F.lit(1)).alias("n_faces"), F.sum(F.col("a") + 2 * F.col("b") + 3 * F.col("c")).alias("corners")
    )
    return n.join(m, "name").select(
        "name", "num_parts", "n_vertices", *rounded([F.col("places")], ["places"]), "n_faces", "corners",
        F.greatest(F.lit(5).cast("long"), F.col("num_parts")).alias("padded"),
    )


def _stored(spark, sf):
    path = fresh_path(spark, "store")
    rows = fx.parts(spark, sf).withColumn("name", F.col("name").cast("string"))
    table = rows.join(SP.unique_names(fx.splits(spark, sf)), "name")
    odd = F.pmod(F.hash("name"), F.lit(2)) == 1
    ST.write_store(table.where(odd), path, "first")
    ST.write_store(table, path, "second")  # adds the objects that the first batch left out
    ST.write_store(table, path, "second")  # a repeated run adds nothing
    return path


_STORED = f"{duck.SPLITS}, {duck.PARTS}, stored AS (SELECT s.category, s.split, s.name, part_idx FROM parts p JOIN splits s ON s.name = CAST(p.name AS VARCHAR))"


@query("s04_fragment_store_write", f"WITH {_STORED} SELECT category, split, name, part_idx FROM stored")
def fragment_store(spark, sf):
    return ST.read_store(spark, _stored(spark, sf)).select("category", "split", "name", "part_idx")


@query("s05_fragment_store_lookup", f"WITH {_STORED} SELECT name, part_idx FROM stored WHERE name = '100'")
def store_lookup(spark, sf):
    return ST.lookup(spark, _stored(spark, sf), "100").select("name", "part_idx")


@query(
    "u06_ingest_dedupe",
    f"WITH {duck.SPLITS} SELECT name, min(category) AS category, min(split) AS split FROM splits GROUP BY name",
)
def ingest_dedupe(spark, sf):
    twice = fx.splits(spark, sf)
    return SP.unique_names(twice.unionByName(twice)).select("name", "category", "split")


def _case(cols, i, n):
    return "CASE part_idx % " + str(n) + " " + " ".join(f"WHEN {k} THEN {c[i]}" for k, c in enumerate(cols)) + " END"


@query(
    "s06_display_meshes",
    f"""WITH {DENSE} SELECT name, part_idx, v_idx, x, y, z, {', '.join(f'CAST({_case(palette.DATASET_COLORS, i, 13)} AS BIGINT) AS {c}' for i, c in enumerate('rgb'))},
    {', '.join(f'CAST({_case(palette.INPUT_COLORS, i, 21)} AS BIGINT) AS i{c}' for i, c in enumerate('rgb'))} FROM verts""",
)
def display_meshes(spark, sf):
    p = F.col("part_idx")
    return fx.vertices(spark, sf).select(
        *PART, "v_idx", "x", "y", "z",
        *[v.alias(c) for v, c in zip(palette.color(p, palette.DATASET_COLORS), "rgb")],
        *[v.alias(f"i{c}") for v, c in zip(palette.color(p, palette.INPUT_COLORS), "rgb")],
    )


@query("s07_category_all", f"WITH {duck.SPLITS} SELECT category, split, name FROM splits WHERE category IN ('1-URGENT', '2-HIGH') AND split = 'F'")
def category_all(spark, sf):
    return SP.names_for(fx.splits(spark, sf), "all", "F", MAIN)


@query("s08_multi_root", f"WITH {duck.SPLITS} SELECT category, split, name FROM splits WHERE category IN ('1-URGENT', '2-HIGH', '5-LOW')")
def multi_root(spark, sf):
    roots = [fresh_path(spark, "root") for _ in range(2)]
    s = fx.splits(spark, sf)
    s.where("category <> '5-LOW'").write.parquet(roots[0])
    s.where("category = '5-LOW'").write.parquet(roots[1])
    return SP.multi_root(spark, [*MAIN, "5-LOW"], roots[0], {"5-LOW": roots[1]})


_VIEW = """SELECT s.category, s.name, num_parts, '{stage}' AS stage FROM splits s JOIN np ON s.name = CAST(np.name AS VARCHAR)
  WHERE s.split = '{split}' AND num_parts >= 2 + {rem} AND num_parts <= 6"""


@query(
    "s09_stage_views",
    f"WITH {duck.SPLITS}, {_NP} " + " UNION ALL ".join(
        _VIEW.format(stage=st, split=sp, rem=rem) for st, sp, rem in (("train", "F", 0), ("val", "O", 0), ("test", "O", 1))
    ),
)
def stage_views(spark, sf):
    files = {"train": "F", "val": "O"}
    splits = fx.splits(spark, sf)
    out = None
    for stage in ("train", "val", "test"):
        view = SP.stage_view(stage, num_removal=1)
        sizes = SP.part_count_filter(fx.parts(spark, sf), 2, 6, view["removal"], view["redundancy"])
        rows = splits.where(F.col("split") == files[view["split"]]).join(
            sizes.withColumn("name", F.col("name").cast("string")), "name"
        ).select("category", "name", "num_parts", F.lit(stage).alias("stage"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "s11_presampled_export",
    f"""WITH {DENSE}, {EDGES}, o AS (SELECT name, count(DISTINCT part_idx) AS num_parts FROM verts GROUP BY name)
    SELECT 'train' AS split, (SELECT count(*) FROM o) AS num_samples, CAST(21 AS BIGINT) AS num_points, name, num_parts,
      (SELECT count(*) FROM verts v WHERE v.name = o.name) AS n_points, CAST(coalesce(n_edges, 0) AS BIGINT) AS n_edges, CAST(coalesce(edge_sum, 0) AS BIGINT) AS edge_sum
    FROM o LEFT JOIN (SELECT name, count(*) AS n_edges, sum(i * 100 + j) AS edge_sum FROM edges GROUP BY name) e USING (name)""",
)
def presampled_export(spark, sf):
    """Vertices as points, with the contact graph of their pieces."""
    path = fresh_path(spark, "export")
    pts = fx.vertices(spark, sf).withColumnRenamed("v_idx", "pt_idx")
    parts = pts.groupBy(*PART).agg(F.count(F.lit(1)).alias("n_points"))
    edges = contact_edges(pts)
    ST.export_sampled(pts, parts, edges, path, {"split": "train", "num_points": 21})
    meta = spark.read.json(f"{path}/dataset_meta")
    whole = spark.read.parquet(f"{path}/parts").groupBy("name").agg(
        F.count(F.lit(1)).alias("num_parts"), F.sum("n_points").alias("n_points")
    )
    graph = spark.read.parquet(f"{path}/edges").groupBy("name").agg(
        F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("i") * 100 + F.col("j")).alias("edge_sum")
    )
    return whole.join(graph, "name", "left").fillna(0, ["n_edges", "edge_sum"]).crossJoin(F.broadcast(meta))


@query(
    "s12_gallery_manifest",
    "SELECT 'c' || c_custkey AS id, c_mktsegment AS dataset, 'nation' || c_nationkey AS subset, 'f/' || c_custkey AS folder, "
    "CAST(k AS BIGINT) AS pos, 'piece_' || k || '.ply' AS file FROM customer, (SELECT unnest(range(0, 3)) AS k) g WHERE k <= c_custkey % 3",
)
def gallery_manifest(spark, sf):
    path = fresh_path(spark, "gallery")
    c = fx.table(spark, sf, "customer")
    files = F.transform(
        F.sequence(F.lit(0), (F.col("c_custkey") % 3).cast("int")),
        lambda k: F.concat(F.lit("piece_"), k.cast("string"), F.lit(".ply")),
    )
    key = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    entity = F.struct(
        key.alias("id"), F.col("c_mktsegment").alias("dataset"),
        F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("subset"),
        F.concat(F.lit("f/"), F.col("c_custkey").cast("string")).alias("folder"), files.alias("files"),
    )
    # one manifest per customer and line: a manifest is a single document
    c.select(F.array(key).alias("idList"), F.create_map(key, entity).alias("entities")).write.json(path)
    got = GA.read_gallery(spark, path, multi_line=False)
    return got.withColumn("pos", F.col("pos").cast("long"))


def _last_poses(spark, sf, trajectory):
    """True poses beside the last ones of the trajectory, which the documents are about."""
    end = trajectory.where("step = 19").select(*PART, *[F.col(c).alias(f"pr_{c}") for c in ("tx", "ty", "tz", "qw", "qx", "qy", "qz")])
    return fx.poses(spark, sf).select(*PART, *R.GT_COLS).join(end, PART)


def _write_documents(spark, sf):
    """Poses, metrics of the last poses, and the pieces taken away or added, of every object.

    The pieces of an object stand in a row; the plan takes the first one away, and the last of
    three pieces or more is redundant.  The trajectory, its last poses and the sizes are written once:
    every list of pieces reads them.
    """
    from ..operators.removal import removal_plan
    from ..plans.evaluate import evaluation_report

    path = fresh_path(spark, "results")
    trajectory = materialize(_trajectory(spark, sf), "trajectory")
    poses = materialize(_last_poses(spark, sf, trajectory), "poses")
    parts = materialize(part_sizes(spark, sf), "sizes")
    report = evaluation_report(fx.points(spark, sf), poses, parts, F.col("redundancy")).drop("num_parts")
    names = poses.select(*PART, F.concat(F.lit("piece_"), "part_idx").alias("piece"))
    sizes = parts.select(*PART, "num_parts", "redundancy")
    row = names.select("name", F.col("part_idx").alias("i"), (F.col("part_idx") + 1).alias("j"))
    row = row.join(names.select("name", F.col("part_idx").alias("j")), ["name", "j"], "left_semi")
    plan = removal_plan(names.select(*PART, F.col("part_idx").alias("prio")), row).where("step = 0")
    redundant = names.join(sizes, PART).where("part_idx >= num_parts - redundancy")
    listed = R.piece_names(names, "pieces")
    for rows, out in ((names.join(plan, PART, "left_semi"), "removal_pieces"), (redundant, "redundant_pieces")):
        listed = listed.join(R.piece_names(rows.select(*PART, "piece"), out), ["name", "chunk"], "left")
    summary = listed.fillna("", ["removal_pieces", "redundant_pieces"]).join(report, "name").join(
        sizes.select("name", "num_parts").distinct(), "name"
    ).withColumn("mesh_scale", F.lit(1.0))
    R.write_results(R.result_documents(poses, trajectory, summary), path)
    return R.read_results(spark, path)


def documents(spark, sf):
    """Result documents of every object, written as JSON and read back."""
    return fx.cached(spark, sf, "documents", lambda: _write_documents(spark, sf))


# The evaluation of the last poses: they take the place of the predicted ones.
_LAST = f"""{_PATH}, last AS (SELECT name, part_idx, {', '.join(GT + GQ)}, {', '.join(f'{v} AS {c}' for v, c in zip(('xx', 'xy', 'xz', *_RQ), PT_ + PQ))} FROM path WHERE step = 19)"""
_LAST_REPORT = re.sub(r"\bpose\b", "last", f"{ERR}, {_REPORT_SQL}")
_DOCUMENTS = f"""WITH {duck.PTS_POSE}, {_LAST}, {_LAST_REPORT},
told AS (SELECT name, count(*) AS num_parts, string_agg('piece_' || part_idx, ',' ORDER BY part_idx) AS pieces,
  CASE WHEN count(*) >= 2 THEN 'piece_0' ELSE '' END AS removal_pieces,
  CASE WHEN count(*) >= 3 THEN 'piece_' || (count(*) - 1) ELSE '' END AS redundant_pieces FROM pose GROUP BY name)"""
_MEASURED = ("part_acc", "rmse_t", "rmse_r", "shape_cd")


@query(
    "s13_result_documents",
    f"{_DOCUMENTS} SELECT CAST(name AS VARCHAR) AS name, CAST(0 AS BIGINT) AS chunk, num_parts, num_parts AS n_gt, CAST(21 AS BIGINT) AS n_steps, "
    f"pieces, removal_pieces, redundant_pieces, {duck.rs(_MEASURED, _MEASURED)}, {duck.r('(SELECT sum(gt_tx) FROM pose p WHERE p.name = told.name)', 'sum_tx')} FROM told JOIN report USING (name)",
)
def result_documents(spark, sf):
    first = F.aggregate("gt_trans_rots", F.lit(0.0), lambda a, p: a + p[0])
    return documents(spark, sf).select(
        "name", "chunk", "num_parts", F.size("gt_trans_rots").cast("long").alias("n_gt"),
        F.size("pred_trans_rots").cast("long").alias("n_steps"), "pieces", "removal_pieces", "redundant_pieces",
        *rounded([*map(F.col, _MEASURED), first], (*_MEASURED, "sum_tx")),
    )


@query(
    "s14_assembly_documents",
    f"{_DOCUMENTS} SELECT l.name, part_idx, num_parts, redundant_pieces, {duck.rs(_MEASURED, _MEASURED)}, {duck.rs((*PT_, *GT), (*R.PR_COLS[:3], *R.GT_COLS[:3]))} FROM last l JOIN told USING (name) JOIN report USING (name)",
)
def assembly_documents(spark, sf):
    path = fresh_path(spark, "assembly")
    R.write_assemblies(documents(spark, sf), path)
    back = R.read_assemblies(spark, path)
    poses = R.assembly_poses(back)
    about = back.select("name", "chunk", "num_parts", "redundant_pieces", *_MEASURED)
    names = [*_MEASURED, *R.PR_COLS[:3], *R.GT_COLS[:3]]
    return poses.join(about, ["name", "chunk"]).select(
        F.col("name").cast("long").alias("name"), "part_idx", "num_parts", "redundant_pieces", *rounded(map(F.col, names), names)
    )


@query(
    "s15_result_read_back",
    f"WITH {duck.POSE}, {_PATH} SELECT CAST(name AS VARCHAR) AS name, part_idx, {duck.rs(GT + GQ, R.GT_COLS)}, {duck.rs(['xx', 'xy', 'xz'], R.PR_COLS[:3])} FROM path WHERE step = 19",
)
def result_read_back(spark, sf):
    names = [*R.GT_COLS, *R.PR_COLS[:3]]
    return R.final_poses(documents(spark, sf)).select("name", "part_idx", *rounded(map(F.col, names), names))


@query(
    "m43_json_trajectory_round_trip",
    f"WITH {duck.POSE}, {_PATH} SELECT CAST(name AS VARCHAR) AS name, part_idx, step + 1 AS step, {duck.rs(['xx', 'xy', 'xz'], ['tx', 'ty', 'tz'])} FROM path",
)
def json_round_trip(spark, sf):
    rows = R.trajectory_rows(documents(spark, sf))
    return rows.select("name", "part_idx", "step", *rounded(map(F.col, ("tx", "ty", "tz")), ("tx", "ty", "tz")))


@query(
    "d09_reassembly_replay",
    f"""WITH {duck.PTS_POSE}, {_LAST}, back AS (SELECT name, part_idx, pt_idx, {', '.join(f'{e} AS u{c}' for e, c in zip(duck.matvec(
        [duck.mat(GQ)[3*j+i] for i in range(3) for j in range(3)], [f'({p}-{t})' for p, t in zip('xyz', GT)]), 'xyz'))},
      pr_qw, pr_qx, pr_qy, pr_qz, pr_tx, pr_ty, pr_tz FROM pts JOIN last USING (name, part_idx))
    SELECT name, part_idx, pt_idx, {duck.rs([f'{m}+{t}' for m, t in zip(duck.matvec(duck.mat(duck.q4('pr_q')), ('ux', 'uy', 'uz')), duck.v3('pr_t'))], 'xyz')} FROM back""",
)
def reassembly_replay(spark, sf):
    """Points moved as the stored documents say."""
    from ..plans.evaluate import replay

    stored = R.final_poses(documents(spark, sf)).withColumn("name", F.col("name").cast("long"))
    return replay(fx.points(spark, sf), stored).select(
        *PART, "pt_idx", *rounded(map(F.col, "xyz"), "xyz")
    )


@query(
    "s16_metrics_csv",
    f"WITH {duck.SEG} SELECT name, {duck.r('1-(2*sum(score*gt)+1e-6)/(sum(score)+sum(gt)+1e-6)', 'dice_loss')} FROM seg GROUP BY name",
)
def metrics_csv(spark, sf):
    path = fresh_path(spark, "csv")
    R.write_metrics_csv(M.segmentation_report(fx.scores(spark, sf), ["name"]), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(
        F.col("name").cast("long").alias("name"),
        *rounded([F.col("dice_loss").cast("double")], ["dice_loss"]),
    )


@query(
    "s17_ordered_batches",
    f"WITH {duck.SPLITS} SELECT name, CAST((row_number() OVER (ORDER BY name) - 1) // 32 AS BIGINT) AS batch_id FROM (SELECT DISTINCT name FROM splits)",
)
def ordered_batches(spark, sf):
    return P.batches(fx.splits(spark, sf).select("name").distinct(), 32, seed=None)


_BATCH_PLACE = duck.shuffled("r", "n", duck.key(DEFAULT_SEED, "'batches'"))


@query(
    "s17_shuffled_batches",
    f"""WITH {duck.SPLITS} SELECT name, {_BATCH_PLACE} // 32 AS batch_id FROM (
      SELECT name, row_number() OVER (ORDER BY name) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT name FROM splits))""",
)
def shuffled_batches(spark, sf):
    return P.batches(fx.splits(spark, sf).select("name").distinct(), 32, DEFAULT_SEED)


@query(
    "t05_limited_batches",
    f"WITH {duck.SPLITS} SELECT name, batch_id FROM (SELECT name, CAST((row_number() OVER (ORDER BY name) - 1) // 32 AS BIGINT) AS batch_id FROM (SELECT DISTINCT name FROM splits)) WHERE batch_id < 5",
)
def limited_batches(spark, sf):
    return ordered_batches(spark, sf).where("batch_id < 5")


@query("p01_part_count_filter", f"WITH {_NP} SELECT name, num_parts FROM np WHERE num_parts >= 2 AND num_parts <= 5 AND num_parts > 0")
def part_count_filter(spark, sf):
    return SP.part_count_filter(fx.parts(spark, sf), 2, 5)


@query("p01_part_count_filter_redundant", f"WITH {_NP} SELECT name, num_parts FROM np WHERE num_parts >= 1 AND num_parts <= 4 AND num_parts > 2")
def part_count_redundant(spark, sf):
    return SP.part_count_filter(fx.parts(spark, sf), 1, 6, redundancy=2)


@query("p04_valid_parts", f"WITH {_SIZES} SELECT name, part_idx, n_points FROM sizes WHERE n_points <> 0")
def valid_parts(spark, sf):
    return part_sizes(spark, sf).where("n_points <> 0").select(*PART, "n_points")


@query("p05_valid_pairs", f"WITH {duck.PARTS} SELECT a.name, a.part_idx AS i, b.part_idx AS j FROM parts a JOIN parts b USING (name) WHERE a.part_idx <> b.part_idx")
def valid_pairs(spark, sf):
    return P.valid_pairs(fx.parts(spark, sf).withColumn("n_points", F.lit(1)))


@query("p11_binarise_scores", f"WITH {duck.SEG} SELECT name, part_idx, pt_idx, score > 0.5 AS pred FROM seg")
def binarise(spark, sf):
    return fx.scores(spark, sf).select(
        *PART, "pt_idx", SEG.binarise(SEG.sigmoid(F.col("logit"))).alias("pred")
    )


@query(
    "p12_teacher_forcing",
    f"WITH {duck.SEG} SELECT name, part_idx, pt_idx, 'train' AS mode, gt = 1 AS used FROM seg UNION ALL SELECT name, part_idx, pt_idx, 'test', score > 0.5 FROM seg",
)
def teacher_forcing(spark, sf):
    s = fx.scores(spark, sf)
    modes = [
        s.select(*PART, "pt_idx", F.lit(m).alias("mode"), SEG.segmentation_used(m, F.col("gt"), F.col("score")).alias("used"))
        for m in ("train", "test")
    ]
    return modes[0].unionByName(modes[1])


@query(
    "p13_fracture_points_packed",
    f"WITH {duck.SEG} SELECT name, part_idx, CAST(0 AS BIGINT) AS chunk, count(*) AS n, string_agg(CAST(pt_idx AS VARCHAR), ',' ORDER BY pt_idx) AS members FROM seg WHERE score > 0.5 GROUP BY name, part_idx",
)
def fracture_points_packed(spark, sf):
    packed = P.pack_points(fx.scores(spark, sf).where(SEG.binarise(F.col("score"))), ["score"])
    return packed.select(
        *PART, "chunk", "n", F.array_join(F.transform("pts", lambda p: p["pt_idx"].cast("string")), ",").alias("members")
    )


@query("p14_train_view_without_meshes", f"WITH {DENSE} SELECT name, part_idx, count(*) AS n FROM verts GROUP BY ALL")
def train_view(spark, sf):
    return fx.vertices(spark, sf).groupBy(*PART).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p19_point_features",
    f"WITH {duck.PTS} SELECT name, part_idx, pt_idx, {duck.rs(('x', 'y', 'z', 'nx', 'ny', 'nz', 'x*y'), [f'f{i}' for i in range(7)])} FROM pts",
)
def point_features(spark, sf):
    pts = fx.points(spark, sf).withColumn("g", F.col("x") * F.col("y"))
    fused = SEG.fused_features(F.array("x", "y", "z", "nx", "ny", "nz"), ["g"])
    df = pts.select(*PART, "pt_idx", fused.alias("f"))
    return df.select(*PART, "pt_idx", *rounded([F.col("f")[i] for i in range(7)], [f"f{i}" for i in range(7)]))


@query(
    "a18_fragment_mean_pool",
    f"WITH {duck.VEC} SELECT name, CAST(d - 1 AS BIGINT) AS dim, {duck.r('avg(e[d])', 'mean')} FROM vec, (SELECT unnest(range(1, 65)) AS d) g GROUP BY name, d",
)
def mean_pool(spark, sf):
    rows = fx._vectors(spark, sf).select("name", F.posexplode("e").alias("dim", "v"))
    return rows.groupBy("name", F.col("dim").cast("long").alias("dim")).agg(*rounded([F.avg("v")], ["mean"]))


@query("a20_points_per_batch", f"WITH {duck.PTS} SELECT name, count(*) AS n FROM pts GROUP BY name")
def points_per_batch(spark, sf):
    return P.batch_counts(fx.points(spark, sf), ["name"])


@query(
    "a26_dataset_stats",
    f"WITH {duck.SPLITS}, {_NP} SELECT category, split, count(*) AS objects, CAST(sum(num_parts) AS BIGINT) AS pieces, min(num_parts) AS fewest, max(num_parts) AS most FROM splits s JOIN np ON s.name = CAST(np.name AS VARCHAR) GROUP BY category, split",
)
def dataset_stats(spark, sf):
    parts = fx.parts(spark, sf).withColumn("name", F.col("name").cast("string"))
    return ST.dataset_stats(fx.splits(spark, sf), parts)


@query("a26_parts_histogram", f"WITH {_NP} SELECT num_parts, count(*) AS objects FROM np GROUP BY num_parts")
def parts_histogram(spark, sf):
    return ST.parts_histogram(fx.parts(spark, sf))


_OFF = f"""{_SIZES}, off AS (SELECT name, part_idx, n_points, CAST(sum(n_points) OVER (PARTITION BY name ORDER BY part_idx) AS BIGINT) AS end_offset FROM sizes)"""


@query("w01_point_offsets", f"WITH {_OFF} SELECT name, part_idx, end_offset - n_points AS start_offset, end_offset FROM off")
def point_offsets(spark, sf):
    return P.point_offsets(part_sizes(spark, sf)).select(*PART, "start_offset", "end_offset")


@query("w02_offset_to_batch", f"WITH {_OFF} SELECT name, pos, part_idx AS batch FROM off, LATERAL (SELECT unnest(range(end_offset - n_points, end_offset)) AS pos) g")
def offset_to_batch(spark, sf):
    return P.offsets_to_batch(P.point_offsets(part_sizes(spark, sf)))


@query("w07_running_valid_parts", f"WITH {_SIZES} SELECT name, part_idx, CAST(row_number() OVER (PARTITION BY name ORDER BY part_idx) AS BIGINT) AS valid_rank FROM sizes")
def running_valid(spark, sf):
    return M.drop_redundant(part_sizes(spark, sf), 0).select(*PART, "valid_rank")


@query(
    "w13_object_part_offsets",
    f"WITH {_NP} SELECT name, CAST(sum(num_parts) OVER (ORDER BY name) - num_parts AS BIGINT) AS start_part, CAST(sum(num_parts) OVER (ORDER BY name) AS BIGINT) AS end_part FROM np",
)
def object_part_offsets(spark, sf):
    objects = fx.parts(spark, sf).groupBy("name").agg(F.count(F.lit(1)).alias("num_parts"))
    return P.object_offsets(objects, ["name"]).select("name", "start_part", "end_part")


@query(
    "m40_pad_and_unpad",
    f"WITH {duck.PARTS} SELECT name, part_idx - 1 AS part_idx, part_idx * 1.5::DOUBLE AS value, CAST(20 AS BIGINT) AS width FROM (SELECT name, row_number() OVER (PARTITION BY name ORDER BY part_idx) AS part_idx FROM parts)",
)
def pad_and_unpad(spark, sf):
    from ..operators.ordering import prefix_sum

    dense = prefix_sum(fx.parts(spark, sf), ["name"], "part_idx", F.lit(1), "n").select(
        "name", (F.col("n") - 1).alias("part_idx"), (F.col("n") * 1.5).alias("v")
    )
    padded = P.pad_parts(dense, F.col("v"), 20, F.lit(0.0), "arr")
    width = padded.select("name", F.size("arr").cast("long").alias("width"))
    return P.unpad_parts(padded, "arr").join(width, "name")


@query("m41_pack_and_unpack", f"WITH {duck.PTS} SELECT name, part_idx, pt_idx, {duck.rs('xyz', 'xyz')} FROM pts")
def pack_and_unpack(spark, sf):
    packed = P.pack_points(fx.points(spark, sf), ["x", "y", "z"], chunk=8)
    return P.unpack_points(packed).select(*PART, "pt_idx", *rounded(map(F.col, "xyz"), "xyz"))


@query(
    "m42_string_operations",
    f"""WITH {duck.PARTS} SELECT name, part_idx, name || '/pieces/' || part_idx AS ref, trim('  ' || name || ' ') AS trimmed,
    'piece_' || part_idx AS stem, true AS is_ply, true AS is_piece FROM parts""",
)
def string_operations(spark, sf):
    p = fx.parts(spark, sf)
    file = F.concat(F.lit("piece_"), "part_idx", F.lit(".ply"))
    return p.select(
        *PART, F.concat_ws("/", "name", F.lit("pieces"), "part_idx").alias("ref"),
        F.trim(F.concat(F.lit("  "), F.decode(F.encode(F.col("name").cast("string"), "utf-8"), "utf-8"), F.lit(" "))).alias("trimmed"),
        F.substring(file, F.lit(1), F.length(file) - 4).alias("stem"),
        F.endswith(file, F.lit(".ply")).alias("is_ply"),
        F.startswith(file, F.lit("piece")).alias("is_piece"),
    )


@query(
    "u02_union_of_categories",
    f"WITH {duck.SPLITS} SELECT category, split, name FROM splits WHERE category = '1-URGENT' UNION ALL SELECT category, split, name FROM splits WHERE category = '5-LOW'",
)
def union_categories(spark, sf):
    s = fx.splits(spark, sf)
    return s.where("category = '1-URGENT'").unionByName(s.where("category = '5-LOW'"))


@query(
    "u03_own_and_added_pieces",
    f"WITH {duck.PARTS} SELECT name, part_idx, false AS added FROM parts UNION ALL SELECT name, part_idx + 7, true FROM parts WHERE part_idx = 1",
)
def own_and_added(spark, sf):
    p = fx.parts(spark, sf)
    return p.withColumn("added", F.lit(False)).unionByName(
        p.where("part_idx = 1").select("name", (F.col("part_idx") + 7).alias("part_idx"), F.lit(True).alias("added"))
    )


@query("u05_pieces_minus_removed", f"WITH {duck.PARTS} SELECT name, part_idx FROM parts EXCEPT SELECT name, part_idx FROM parts WHERE part_idx <= 2")
def pieces_minus_removed(spark, sf):
    p = fx.parts(spark, sf)
    return p.exceptAll(p.where("part_idx <= 2"))


@query(
    "d10_model_comparison",
    f"""WITH {duck.SEG}, two AS (SELECT 'baseline' AS model, gt, score FROM seg UNION ALL SELECT 'hybrid', gt, (score + gt) / 2 FROM seg),
    c AS (SELECT model, count(*) FILTER (score > 0.5 AND gt = 1) AS tp, count(*) FILTER (score > 0.5 AND gt = 0) AS fp, count(*) FILTER (score <= 0.5 AND gt = 1) AS fn FROM two GROUP BY model)
    SELECT model, {duck.r('2*tp/(2*tp+fp+fn)', 'f1')}, {duck.r('tp/(tp+fn)', 'recall')}, CAST(row_number() OVER (ORDER BY 2*tp/(2*tp+fp+fn) DESC, tp/(tp+fn) DESC, model) - 1 AS BIGINT) AS place FROM c""",
)
def model_comparison(spark, sf):
    s = fx.scores(spark, sf)
    both = s.select(F.lit("baseline").alias("model"), "gt", "score").unionByName(
        s.select(F.lit("hybrid").alias("model"), "gt", ((F.col("score") + F.col("gt")) / 2).alias("score"))
    )
    return SEG.compare_models(both).select("model", *rounded([F.col("f1"), F.col("recall")], ("f1", "recall")), "place")


def _geo(spark, sf):
    from ..operators.geometry import surface_features
    from ..session import materialize

    return materialize(surface_features(fx.points(spark, sf), 8), "features")


@query("d11_fracture_classifier")
def fracture_classifier(spark, sf):
    """Scores of the points of held-out objects."""
    from ..operators.geometry import feature_columns

    training, test = SEG.held_out(_geo(spark, sf))
    model = SEG.train_classifier(training, feature_columns())
    return SEG.score_points(model, test).select(*PART, "pt_idx", "gt", "score")


_HELD_OUT = f"{duck.uniform(DEFAULT_SEED, repr('held out'), 'name')} < 0.3"


@query(
    "d11_held_out_points",
    f"WITH {duck.SEG} SELECT name, part_idx, pt_idx, gt, true AS scored FROM seg WHERE {_HELD_OUT}",
)
def held_out_points(spark, sf):
    """Every point of a held-out object has a label and a probability; no object is on both sides."""
    rows = fracture_classifier(spark, sf)
    return rows.select(*PART, "pt_idx", "gt", F.col("score").between(0, 1).alias("scored"))


@query("d12_ablation_table")
def ablation(spark, sf):
    return SEG.ablation_table(_geo(spark, sf)).select("head", "model", "accuracy", "recall", "precision", "f1", "dice_loss")


@query(
    "x07_batch_scorer",
    f"WITH {duck.PTS} SELECT name, part_idx, pt_idx, {duck.r('1/(1+exp(-(3*x-2*nz)))', 'score')} FROM pts",
)
def batch_scorer(spark, sf):
    from ..plans.scoring import score_batches

    def model(batch):
        import numpy as np

        return 1.0 / (1.0 + np.exp(-(3.0 * batch["x"] - 2.0 * batch["nz"])))

    scored = score_batches(fx.points(spark, sf), model, ["x", "nz"])
    return scored.select(*PART, "pt_idx", *rounded([F.col("score")], ["score"]))


@query(
    "x01_sql_functions",
    f"WITH {duck.PTS_POSE} SELECT name, part_idx, pt_idx, "
    + duck.rs(duck.matvec(duck.mat(GQ), ("x", "y", "z")), ("rx", "ry", "rz"))
    + f", {duck.r('least(abs(degrees(x)-degrees(y)), 360-abs(degrees(x)-degrees(y)))', 'gap')}, "
    "CAST(((pt_idx & 1) << 2) + ((pt_idx >> 1 & 1) << 5) + ((pt_idx >> 2 & 1) << 8) + ((pt_idx >> 3 & 1) << 11) + ((pt_idx >> 4 & 1) << 14) AS BIGINT) AS code "
    "FROM pts JOIN pose USING (name, part_idx)",
)
def sql_functions(spark, sf):
    from ..functions.sql import register

    register(spark)
    fx.points(spark, sf).join(fx.poses(spark, sf), PART).createOrReplaceTempView("sherdloom_placed")
    return spark.sql(
        """SELECT name, part_idx, pt_idx, round(r.x, 6) + 0.0D AS rx, round(r.y, 6) + 0.0D AS ry,
                  round(r.z, 6) + 0.0D AS rz, round(gap, 6) + 0.0D AS gap, code
           FROM (SELECT *, quat_rotate(gt_qw, gt_qx, gt_qy, gt_qz, x, y, z) AS r,
                        angle_gap(degrees(x), degrees(y)) AS gap, z_code(pt_idx, 0, 0) AS code
                 FROM sherdloom_placed)"""
    )
