"""Neighbour joins and local surface features."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import geometry as G
from ..operators.metrics import PART
from ..operators.neighbors import knn
from . import duck
from .poses import rounded
from .registry import query

PT = [*PART, "pt_idx"]
K = 8

NEAR = duck.PTS + f""",
near AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY name, part_idx, pt_idx ORDER BY d2, n_pt_idx) AS nn FROM (
    SELECT a.name, a.part_idx, a.pt_idx, b.pt_idx AS n_pt_idx, b.x AS bx, b.y AS by_, b.z AS bz,
           a.nx*b.nx + a.ny*b.ny + a.nz*b.nz AS agree,
           (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) AS d2
    FROM pts a JOIN pts b ON a.name=b.name AND a.part_idx=b.part_idx AND a.pt_idx<>b.pt_idx)) WHERE nn <= {K})"""


def _cov(div: str) -> str:
    return f"""cov AS (SELECT name, part_idx, pt_idx, count(*) AS k,
  {', '.join(f'covar_pop({a}, {b})*count(*)/{div} AS {n}' for a, b, n in (('bx', 'bx', 'cxx'), ('bx', 'by_', 'cxy'), ('bx', 'bz', 'cxz'), ('by_', 'by_', 'cyy'), ('by_', 'bz', 'cyz'), ('bz', 'bz', 'czz')))},
  1 - avg(agree) AS disagree FROM near GROUP BY name, part_idx, pt_idx)"""


# Eigenvalues as roots of the characteristic cubic.
_EIG = """eig AS (SELECT *, q + 2*p*cos(a) AS l0, q + 2*p*cos(a + 2*pi()/3) AS l2, 3*q - (q + 2*p*cos(a)) - (q + 2*p*cos(a + 2*pi()/3)) AS l1 FROM (
  SELECT *, acos(least(1, greatest(-1, CASE WHEN p > 0 THEN det/(2*p*p*p) ELSE 0 END)))/3 AS a FROM (
  SELECT *, sqrt(((cxx-q)*(cxx-q)+(cyy-q)*(cyy-q)+(czz-q)*(czz-q)+2*(cxy*cxy+cxz*cxz+cyz*cyz))/6) AS p,
    (cxx-q)*((cyy-q)*(czz-q)-cyz*cyz)-cxy*(cxy*(czz-q)-cyz*cxz)+cxz*(cxy*cyz-(cyy-q)*cxz) AS det FROM (
  SELECT *, (cxx+cyy+czz)/3 AS q FROM cov))))"""
_UNBIASED, _BIASED = _cov("greatest(count(*)-1, 1)"), _cov("count(*)")


@query("j08_knn_in_fragment", f"WITH {NEAR} SELECT name, part_idx, pt_idx, n_pt_idx, {duck.r('d2', 'd2', 9)}, nn FROM near")
def knn_in_fragment(spark, sf):
    found = knn(fx.points(spark, sf), K, PART, ["pt_idx"])
    return found.select(
        *PART, F.col("q_pt_idx").alias("pt_idx"), "n_pt_idx", *rounded([F.col("d2")], ["d2"], 9), "nn"
    )


@query(
    "t01_nearest_three",
    f"WITH {NEAR} SELECT name, part_idx, pt_idx, n_pt_idx, nn FROM near WHERE nn <= 3",
)
def nearest_three(spark, sf):
    found = knn(fx.points(spark, sf), 3, PART, ["pt_idx"])
    return found.select(*PART, F.col("q_pt_idx").alias("pt_idx"), "n_pt_idx", "nn")


@query(
    "a21_local_covariance",
    f"WITH {NEAR}, {_UNBIASED} SELECT name, part_idx, pt_idx, k, {duck.rs(G.COV, G.COV)} FROM cov",
)
def local_covariance(spark, sf):
    df = G.local_covariance(G.neighbour_rows(fx.points(spark, sf), K))
    return df.select(*PT, "k", *rounded(map(F.col, G.COV), G.COV))


@query(
    "m30_covariance_eigenvalues",
    f"WITH {NEAR}, {_UNBIASED}, {_EIG} SELECT name, part_idx, pt_idx, {duck.rs(('l0', 'l1', 'l2'), ('l0', 'l1', 'l2'))} FROM eig",
)
def covariance_eigenvalues(spark, sf):
    df = G.with_eigenvalues(G.local_covariance(G.neighbour_rows(fx.points(spark, sf), K)))
    names = ("l0", "l1", "l2")
    return df.select(*PT, *rounded(map(F.col, names), names))


@query(
    "m32_curvature",
    f"WITH {NEAR}, {_UNBIASED}, {_EIG} SELECT name, part_idx, pt_idx, {duck.r('l2/greatest(l0+l1+l2, 1e-8)', 'curvature')} FROM eig",
)
def curvature(spark, sf):
    df = G.with_eigenvalues(G.local_covariance(G.neighbour_rows(fx.points(spark, sf), K)))
    return df.select(*PT, *rounded([G.curvature()], ["curvature"]))


@query("m30_local_normals")
def local_normals(spark, sf):
    cov = G.local_covariance(G.neighbour_rows(fx.points(spark, sf), K))
    return G.with_local_normal(cov).select(*PT, "pnx", "pny", "pnz")


def _axis_sql(src: str, lam: str, out: str, v: str) -> str:
    """Unit eigenvector for an eigenvalue: the longest cross product of two rows of C - lam I."""
    rows = (
        (f"(cxx-{lam})", "cxy", "cxz"), ("cxy", f"(cyy-{lam})", "cyz"), ("cxz", "cyz", f"(czz-{lam})"),
    )

    def cross(r, q):
        return (
            f"({r[1]}*{q[2]}-{r[2]}*{q[1]})", f"({r[2]}*{q[0]}-{r[0]}*{q[2]})", f"({r[0]}*{q[1]}-{r[1]}*{q[0]})",
        )

    pairs = [cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    cols = ", ".join(f"{e} AS {v}{n}{c}" for n, p in enumerate(pairs) for e, c in zip(p, "xyz"))
    sizes = ", ".join(f"{v}{n}x*{v}{n}x+{v}{n}y*{v}{n}y+{v}{n}z*{v}{n}z AS {v}s{n}" for n in range(3))
    pick = ", ".join(
        f"CASE WHEN {v}s0 >= {v}s1 AND {v}s0 >= {v}s2 THEN {v}0{c}/sqrt({v}s0) WHEN {v}s1 >= {v}s2 THEN {v}1{c}/sqrt({v}s1) ELSE {v}2{c}/sqrt({v}s2) END AS {v}{c}"
        for c in "xyz"
    )
    return f"{out} AS (SELECT *, {pick} FROM (SELECT *, {sizes} FROM (SELECT *, {cols} FROM {src})))"


# The trigonometric root is refined once by its Rayleigh quotient.
_RAY = "(v{0}*v{0}*cxx+v{1}*v{1}*cyy+v{2}*v{2}*czz+2*(v{0}*v{1}*cxy+v{0}*v{2}*cxz+v{1}*v{2}*cyz))".format(*"xyz")
FEATURES = f"""WITH {NEAR}, {_UNBIASED}, {_EIG}, {_axis_sql('eig', 'l2', 'ax1', 'v')},
ray AS (SELECT *, {_RAY} AS lr FROM ax1), {_axis_sql('ray', 'lr', 'ax2', 'w')},
mids AS (SELECT name, part_idx, pt_idx, avg(bx) AS mx, avg(by_) AS my, avg(bz) AS mz FROM near GROUP BY ALL),
rough AS (SELECT name, part_idx, pt_idx, avg(abs((bx-mx)*wx+(by_-my)*wy+(bz-mz)*wz)) AS roughness
  FROM near JOIN mids USING (name, part_idx, pt_idx) JOIN ax2 USING (name, part_idx, pt_idx) GROUP BY ALL),
feat AS (SELECT p.name, p.part_idx, p.pt_idx, p.nx, p.ny, p.nz, abs(p.nx*wx+p.ny*wy+p.nz*wz) AS normal_consistency,
  lr/greatest(cxx+cyy+czz, 1e-8) AS curvature, roughness
  FROM pts p JOIN ax2 USING (name, part_idx, pt_idx) JOIN rough USING (name, part_idx, pt_idx))"""


def _features(spark, sf):
    return G.surface_features(fx.points(spark, sf), K)


def _feature_query(name: str, columns: list[str]):
    @query(name, f"{FEATURES} SELECT name, part_idx, pt_idx, {duck.rs(columns, columns)} FROM feat")
    def features(spark, sf):
        return _features(spark, sf).select(*PT, *rounded(map(F.col, columns), columns))


_feature_query("m31_normal_consistency", ["normal_consistency"])
_feature_query("m33_roughness", ["roughness"])
_feature_query("m34_surface_features", G.feature_columns())
_feature_query("p20_feature_ablation_columns", G.feature_columns(use_normals=False, use_roughness=False))


@query(
    "m35_notes_features",
    f"""WITH {NEAR}, {_BIASED}, {_EIG} SELECT name, part_idx, pt_idx,
    {duck.r('CASE WHEN l0+l1+l2 > 1e-8 THEN l2/(l0+l1+l2) ELSE 0 END', 'surface_variation')},
    {duck.r('(l0-l2)/2', 'mean_curvature')}, {duck.r('disagree', 'normal_consistency')} FROM eig""",
)
def notes_features(spark, sf):
    names = ("surface_variation", "mean_curvature", "normal_consistency")
    return G.notes_features(fx.points(spark, sf), K).select(*PT, *rounded(map(F.col, names), names))


# Fragments cut to two points have one neighbour each and are degenerate.
@query(
    "p15_degenerate_fragments",
    f"""WITH {duck.PTS}, c AS (SELECT * FROM pts WHERE pt_idx < 2)
    SELECT name, part_idx, pt_idx, 0.0::DOUBLE AS normal_consistency, 0.0::DOUBLE AS nx, 0.0::DOUBLE AS ny,
           0.0::DOUBLE AS nz, 0.0::DOUBLE AS curvature, 0.0::DOUBLE AS roughness FROM c""",
)
def degenerate_fragments(spark, sf):
    few = fx.points(spark, sf).where("pt_idx < 2")
    return G.surface_features(few, K).select(*PT, *G.feature_columns())
