"""The query catalogue: operators over geometry made from the provided tables, and DuckDB SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmesh.functions import geometry as G
from driftmesh.operators import idw, multi, neighbors, patches, points, structured, symmetry, transfer
from driftmesh.operators.common import shared_dir
from driftmesh.options import WarpOptions
from driftmesh.plans.kernels import sample_sphere
from driftmesh.plans.mesh import Mesh
from driftmesh.plans.warp import Warper
from driftmesh.sources import openfoam, plot3d

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def r8(column, digits: int = 8):
    return F.round(column, digits) + F.lit(0.0)


def r8s(expression: str, digits: int = 8) -> str:
    return f"round({expression}, {digits}) + 0.0"


def rounded(df: DataFrame, *names: str, digits: int = 8) -> DataFrame:
    return df.withColumns({n: r8(F.col(n), digits) for n in names})


# geometry from the tables


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surf(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("pt_id"), ((k % 10) / 10.0).alias("x"), (((k * 7) % 13) / 13.0).alias("y"), (F.col("s_acctbal") / 10000.0).alias("z"))


def vol(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("node_id"), F.col("c_nationkey").alias("zone_id"), ((k % 37) / 37.0).alias("x0"), (((k * 5) % 41) / 41.0).alias("y0"), (F.col("c_acctbal") / 10000.0).alias("z0")
    )


def lattice(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    i, j = (k % 40).cast("long"), F.floor(k / 40)
    return read(spark, sf_dir, "part").select(k.alias("pt_id"), i.alias("i"), j.alias("j"), (i / 40.0).alias("x"), (j / 40.0).alias("y"), (F.col("p_retailprice") / 20000.0).alias("z"))


def emb(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pt_id"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])


def crowded(spark, sf_dir) -> DataFrame:
    """Points of which many coincide."""
    k = F.col("o_custkey")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pt_id"), ((k % 30) / 10.0).alias("x"), ((k % 7) / 10.0).alias("y"), ((k % 4) / 10.0).alias("z"))


def boundary(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    kinds = F.array(*[F.lit(t) for t in BC_KINDS])
    return read(spark, sf_dir, "nation").select(
        k.cast("int").alias("patch_id"), F.when(k % 4 != 0, F.concat(F.lit(" "), F.col("n_name"))).alias("family"), F.get(kinds, (k % len(BC_KINDS)).cast("int")).alias("bc_type")
    )


BC_KINDS = ("BCWall", "BCSymmetryPlane", "BCWallViscous", "BCFarfield", "BCWallInviscid", "BCGeneral")
PLANE_Z = (((0.0, 0.0, 0.0), (0.0, 0.0, 1.0)),)
PLANES_ZY = (*PLANE_Z, ((0.0, 0.0, 0.0), (0.0, 1.0, 0.0)))
EXACT = WarpOptions(eval_mode="exact", use_rotations=False)

SURF = "surf as (select s_suppkey as pt_id, (s_suppkey % 10) / cast(10 as double) as x, ((s_suppkey * 7) % 13) / cast(13 as double) as y, s_acctbal / cast(10000 as double) as z from supplier)"
VOL = "vol as (select c_custkey as node_id, c_nationkey as zone_id, (c_custkey % 37) / cast(37 as double) as x0, ((c_custkey * 5) % 41) / cast(41 as double) as y0, c_acctbal / cast(10000 as double) as z0 from customer)"
LATTICE = "lattice as (select p_partkey as pt_id, p_partkey % 40 as i, p_partkey // 40 as j, (p_partkey % 40) / cast(40 as double) as x, (p_partkey // 40) / cast(40 as double) as y, p_retailprice / cast(20000 as double) as z from part)"
EMB = "emb as (select vec_id as pt_id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z from embeddings)"
CROWDED = "crowded as (select o_orderkey as pt_id, (o_custkey % 30) / cast(10 as double) as x, (o_custkey % 7) / cast(10 as double) as y, (o_custkey % 4) / cast(10 as double) as z from orders)"
BOUNDARY = "boundary as (select cast(n_nationkey as int) as patch_id, case when n_nationkey % 4 <> 0 then ' ' || n_name end as family, " + f"{list(BC_KINDS)}[n_nationkey % 6 + 1] as bc_type from nation)"
EXTENT = "centre as (select avg(x) as mx, avg(y) as my, avg(z) as mz from surf), extent as (select max(sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2)) as ldef from surf, centre)"
QUADS = "quads as (select a.pt_id as face_id, a.pt_id as n1, b.pt_id as n2, c.pt_id as n3, d.pt_id as n4 from lattice a join lattice b on b.i = a.i + 1 and b.j = a.j join lattice c on c.i = a.i + 1 and c.j = a.j + 1 join lattice d on d.i = a.i and d.j = a.j + 1)"


def props_sql(src: str, out: str) -> str:
    """CTEs that end in {out}(face_id, area, nx, ny, nz) for quads over the points of src."""
    pts = ", ".join(f"p{k}.{c} as {c}{k}" for k in range(1, 5) for c in "xyz")
    joins = " ".join(f"join {src} p{k} on p{k}.pt_id = q.n{k}" for k in range(1, 5))
    ctr = ", ".join(f"({c}1 + {c}2 + {c}3 + {c}4) / 4 as m{c}" for c in "xyz")
    fans = []
    for k in range(1, 5):
        n = k % 4 + 1
        r = {c: (f"({c}{k} - m{c})", f"({c}{n} - m{c})") for c in "xyz"}
        for c, (a, b) in zip("xyz", (("y", "z"), ("z", "x"), ("x", "y"))):
            fans.append(f"{r[a][0]} * {r[b][1]} - {r[b][0]} * {r[a][1]} as c{c}{k}")
    sizes = ", ".join(f"sqrt(cx{k} ** 2 + cy{k} ** 2 + cz{k} ** 2 + 1e-15) as s{k}" for k in range(1, 5))
    sums = ", ".join(" + ".join(f"c{c}{k} / s{k}" for k in range(1, 5)) + f" as u{c}" for c in "xyz")
    return (
        f"{out}_a as (select q.face_id, {pts} from quads q {joins}), {out}_b as (select *, {ctr} from {out}_a), {out}_c as (select face_id, {', '.join(fans)} from {out}_b), "
        f"{out}_d as (select *, {sizes} from {out}_c), {out}_e as (select face_id, 0.5 * (s1 + s2 + s3 + s4) as area, {sums} from {out}_d), "
        f"{out} as (select face_id, area, ux / sqrt(ux ** 2 + uy ** 2 + uz ** 2) as nx, uy / sqrt(ux ** 2 + uy ** 2 + uz ** 2) as ny, uz / sqrt(ux ** 2 + uy ** 2 + uz ** 2) as nz from {out}_e)"
    )


CORNERS = "corners as (select face_id, unnest([n1, n2, n3, n4]) as node, unnest([0, 1, 2, 3]) as pos from quads)"


def normals_sql(props: str, out: str) -> str:
    return f"{out} as (select node, sum(area / 4) as a, sum(area / 4 * nx) / sum(area / 4) as nx, sum(area / 4 * ny) / sum(area / 4) as ny, sum(area / 4 * nz) / sum(area / 4) as nz from corners join {props} using (face_id) group by node)"


ROTATION = [
    "1 - (1 - cos(t)) * (ay * ay + az * az)", "(1 - cos(t)) * ax * ay - sin(t) * az", "(1 - cos(t)) * ax * az + sin(t) * ay",
    "(1 - cos(t)) * ax * ay + sin(t) * az", "1 - (1 - cos(t)) * (ax * ax + az * az)", "(1 - cos(t)) * ay * az - sin(t) * ax",
    "(1 - cos(t)) * ax * az - sin(t) * ay", "(1 - cos(t)) * ay * az + sin(t) * ax", "1 - (1 - cos(t)) * (ax * ax + ay * ay)",
]
MATRIX = [f"m{i}{j}" for i in "123" for j in "123"]


def rotation_sql(src: str, out: str) -> str:
    """CTEs that add m11..m33 to src, which has (nx, ny, nz) and (mx, my, mz)."""
    return (
        f"{out}_a as (select *, ny * mz - nz * my as cx, nz * mx - nx * mz as cy, nx * my - ny * mx as cz from {src}), "
        f"{out}_b as (select *, sqrt(cx ** 2 + cy ** 2 + cz ** 2 + 1e-30) as len from {out}_a), "
        f"{out}_c as (select *, case when len < 1.4901161193847656e-08 then 1 else cx / len end as ax, case when len < 1.4901161193847656e-08 then 0 else cy / len end as ay, case when len < 1.4901161193847656e-08 then 0 else cz / len end as az, "
        f"case when len < 1.4901161193847656e-08 then 0 else acos(greatest(-1, least(1, (nx * mx + ny * my + nz * mz) / sqrt(nx ** 2 + ny ** 2 + nz ** 2 + 1e-30) / sqrt(mx ** 2 + my ** 2 + mz ** 2 + 1e-30)))) end as t from {out}_b), "
        f"{out} as (select *, {', '.join(f'{e} as {m}' for e, m in zip(ROTATION, MATRIX))} from {out}_c)"
    )


def weight_sql(d2: str, area: str = "1", a=3, b=5, alpha=0.25, ldef: str = "ldef", eps: str = "1e-15") -> str:
    return f"{area} * (pow({ldef} / sqrt({d2} + {eps}), {a}) + pow(cast({alpha} as double), {b}) * pow({ldef} / sqrt({d2} + {eps}), {b}))"


def warp_sql(a=3, b=5, alpha=0.25, fact=1.0, signs=("1",), select="", disp="0.05 * z") -> str:
    """The exact warp of vol by surf moved in x by disp, without rotations; signs: (sy, sz) of each mirror image."""
    pairs = " union all ".join(
        f"select v.node_id, {weight_sql('(v.x0 - s.x) ** 2 + ' + f'({sy} * v.y0 - s.y) ** 2 + ({sz} * v.z0 - s.z) ** 2', '1', a, b, alpha, f'(ldef * cast({fact} as double))')} as w, cast({disp.replace('z', 's.z')} as double) as dx from vol v, surf s, extent" for sy, sz in signs
    )
    return f"select {select}node_id, {r8s('x0 + num / den')} as x, {r8s('y0')} as y, {r8s('z0')} as z from vol join (select node_id, sum(w * dx) as num, sum(w) as den from ({pairs}) group by node_id) using (node_id)"


HEAD = f"with {SURF}, {VOL}, {EXTENT} "
SHEAR = lambda df: df.withColumn("x", F.col("x") + 0.05 * F.col("z"))


# the warp


@query(HEAD + warp_sql(signs=(("1", "1"),)))
def warp_exact_disp(spark, sf_dir):
    return rounded(Warper.from_areas(surf(spark, sf_dir), options=EXACT).warp(vol(spark, sf_dir), SHEAR), "x", "y", "z")


@query(HEAD + warp_sql(signs=(("1", "1"),)))
def warp_exact_join(spark, sf_dir):
    s = surf(spark, sf_dir)
    ldef = points.extent(s).first()[0]
    moved = s.select("x", "y", "z", F.lit(1.0).alias("a"), (0.05 * F.col("z")).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))
    return rounded(idw.exact_warp_join(vol(spark, sf_dir), moved, ldef), "x", "y", "z")


@query(HEAD + warp_sql(signs=(("1", "1"), ("1", "-1"))))
def warp_exact_mirror_1(spark, sf_dir):
    return rounded(Warper.from_areas(surf(spark, sf_dir), options=EXACT, planes=PLANE_Z).warp(vol(spark, sf_dir), SHEAR), "x", "y", "z")


@query(HEAD + warp_sql(signs=(("1", "1"), ("1", "-1"), ("-1", "1"), ("-1", "-1"))))
def warp_exact_mirror_2(spark, sf_dir):
    return rounded(Warper.from_areas(surf(spark, sf_dir), options=EXACT, planes=PLANES_ZY).warp(vol(spark, sf_dir), SHEAR), "x", "y", "z")


@query(
    HEAD.rstrip() + ", sums as (select node_id, sum(w) as w, sum(w * dx) as dx, sum(sy * w * dy) as dy, sum(sz * w * dz) as dz from (select v.node_id, sy, sz, cast(0.05 as double) * s.z as dx, cast(0.03 as double) * s.x as dy, cast(0.02 as double) * s.y as dz, "
    + weight_sql("(v.x0 - s.x) ** 2 + (sy * v.y0 - s.y) ** 2 + (sz * v.z0 - s.z) ** 2")
    + f" as w from vol v, surf s, extent, (select unnest([1, 1, -1, -1]) as sy, unnest([1, -1, 1, -1]) as sz)) group by node_id) select node_id, {r8s('x0 + dx / w')} as x, {r8s('y0 + dy / w')} as y, {r8s('z0 + dz / w')} as z from vol join sums using (node_id)"
)
def warp_exact_mirror_normal(spark, sf_dir):
    """Motions with components along the planes' normals, which the images turn round."""
    moved = lambda df: df.select("pt_id", (F.col("x") + 0.05 * F.col("z")).alias("x"), (F.col("y") + 0.03 * F.col("x")).alias("y"), (F.col("z") + 0.02 * F.col("y")).alias("z"))
    return rounded(Warper.from_areas(surf(spark, sf_dir), options=EXACT, planes=PLANES_ZY).warp(vol(spark, sf_dir), moved), "x", "y", "z")


SWEEP = ((3.0, 5.0, 0.25, 1.0), (4.0, 6.0, 0.3, 2.0), (2.0, 4.0, 0.1, 0.5))


@query(HEAD + " union all ".join(warp_sql(a, b, al, f, (("1", "1"),), f"cast({i} as int) as case_id, ") for i, (a, b, al, f) in enumerate(SWEEP)))
def warp_options_sweep(spark, sf_dir):
    s, v = surf(spark, sf_dir), vol(spark, sf_dir)
    out = None
    for i, (a, b, al, f) in enumerate(SWEEP):
        o = WarpOptions(eval_mode="exact", use_rotations=False, a_exp=a, b_exp=b, alpha=al, ldef_fact=f)
        part = Warper.from_areas(s, options=o).warp(v, SHEAR).select(F.lit(i).alias("case_id"), "node_id", "x", "y", "z")
        out = part if out is None else out.unionByName(part)
    return rounded(out, "x", "y", "z")


@query(HEAD + " union all ".join(warp_sql(signs=(("1", "1"),), select=f"'{n}' as \"case\", ", disp=f"{k} * z") for n, k in (("half", 0.025), ("whole", 0.05))))
def warp_many_deformations(spark, sf_dir):
    s = surf(spark, sf_dir)
    moved = {n: s.withColumn("x", F.col("x") + k * F.col("z")) for n, k in (("half", 0.025), ("whole", 0.05))}
    return rounded(Warper.from_areas(s, options=EXACT).warp_many(vol(spark, sf_dir), moved), "x", "y", "z")


def _lattice_warper(spark, sf_dir, **options) -> Warper:
    p = lattice(spark, sf_dir)
    return Warper(p, points.lattice_quads(p), WarpOptions(**options))


BEND = lambda df: df.withColumn("z", F.col("z") + 0.1 * F.col("x") * F.col("x"))
BENT = "bent as (select pt_id, i, j, x, y, z + cast(0.1 as double) * x * x as z from lattice)"
FACED = f"with {LATTICE}, {QUADS}, {CORNERS}, {BENT}, {props_sql('lattice', 'f0')}, {props_sql('bent', 'f1')}, {normals_sql('f0', 'n0')}, {normals_sql('f1', 'n1')}, "
FLAGS = "flags as (select node, bool_or(abs(f0.nx * n0.nx + f0.ny * n0.ny + f0.nz * n0.nz) < cos(30 * pi() / 180)) as is_corner from corners join f0 using (face_id) join n0 using (node) group by node), "


def state_sql(bent: str, normals: str, name: str) -> str:
    """CTEs that end in {name}(node, a, sx, sy, sz, m11..m33, b1..b3) for the lattice moved to bent, with its normals."""
    turned = ", ".join(f"case when is_corner then n0.n{c} else q.n{c} end as m{c}" for c in "xyz")
    offsets = ", ".join(f"b.{c} - (m{i}1 * l.x + m{i}2 * l.y + m{i}3 * l.z) as b{i}" for i, c in zip("123", "xyz"))
    return (
        f"{name}_t as (select n0.node, n0.a, n0.nx, n0.ny, n0.nz, {turned} from n0 join {normals} q using (node) join flags using (node)), {rotation_sql(f'{name}_t', f'{name}_r')}, "
        f"{name} as (select r.*, l.x as sx, l.y as sy, l.z as sz, {offsets} from {name}_r r join lattice l on l.pt_id = r.node join {bent} b on b.pt_id = r.node), "
    )


def turned_sums_sql(state: str, out: str) -> str:
    """A CTE {out}(node_id, dx, dy, dz): the motion of vol by the state."""
    parts = ", ".join(f"sum(w * (m{i}1 * x0 + m{i}2 * y0 + m{i}3 * z0 + b{i} - {c}0)) / sum(w) as d{c}" for i, c in zip("123", "xyz"))
    return f"{out} as (select node_id, {parts} from (select v.*, s.*, {weight_sql('(x0 - sx) ** 2 + (y0 - sy) ** 2 + (z0 - sz) ** 2', 'a')} as w from vol v, {state} s, extent) group by node_id)"


MOVED = state_sql("bent", "n1", "state") + "surf as (select pt_id, x, y, z from lattice), " + EXTENT + f", {VOL}, "


@query(FACED + FLAGS + MOVED + turned_sums_sql("state", "sums") + f" select node_id, {r8s('x0 + dx', 6)} as x, {r8s('y0 + dy', 6)} as y, {r8s('z0 + dz', 6)} as z from vol join sums using (node_id)")
def warp_exact_rot(spark, sf_dir):
    return rounded(_lattice_warper(spark, sf_dir, eval_mode="exact").warp(vol(spark, sf_dir), BEND), "x", "y", "z", digits=6)


@query(HEAD + f"select node_id, {r8s('sum(w)', 4)} as denominator from (select v.node_id, {weight_sql('(v.x0 - s.x) ** 2 + (v.y0 - s.y) ** 2 + (v.z0 - s.z) ** 2')} as w from vol v, surf s, extent) group by node_id")
def denominator_exact(spark, sf_dir):
    return rounded(Warper.from_areas(surf(spark, sf_dir), options=EXACT).denominators(vol(spark, sf_dir)), "denominator", digits=4)


@query(f"with {SURF}, {EXTENT} select {r8s('ldef')} as ldef0 from extent")
def ldef_extent(spark, sf_dir):
    return rounded(points.extent(surf(spark, sf_dir)), "ldef0")


# faces and nodes


@query(FACED + f"x as (select 1) select face_id, {r8s('area')} as area, {r8s('nx', 6)} as nx, {r8s('ny', 6)} as ny, {r8s('nz', 6)} as nz from f0")
def polygon_props(spark, sf_dir):
    p = lattice(spark, sf_dir)
    return rounded(rounded(points.face_props(points.lattice_quads(p), p).drop("k"), "area"), "nx", "ny", "nz", digits=6)


@query(FACED + f"x as (select 1) select node, {r8s('a')} as a, {r8s('nx', 6)} as nx, {r8s('ny', 6)} as ny, {r8s('nz', 6)} as nz from n0")
def node_area_normal(spark, sf_dir):
    p = lattice(spark, sf_dir)
    q = points.lattice_quads(p)
    return rounded(rounded(points.node_normals(q, points.face_props(q, p)), "a"), "nx", "ny", "nz", digits=6)


@query(FACED + FLAGS + "x as (select 1) select node, is_corner from flags")
def corner_flags(spark, sf_dir):
    p = lattice(spark, sf_dir)
    q = points.lattice_quads(p)
    props = points.face_props(q, p)
    return points.corner_flags(q, props, points.node_normals(q, props), 30.0)


@query(f"with {VOL}, two as (select node_id, x0 as nx, y0 as ny, z0 + 1 as nz, y0 as mx, z0 as my, x0 + 1 as mz from vol), {rotation_sql('two', 'rot')} select node_id, {', '.join(f'{r8s(m, 6)} as {m}' for m in MATRIX)} from rot")
def rotation_matrix(spark, sf_dir):
    one = F.lit(1.0)
    m = G.rotation_matrix((F.col("x0"), F.col("y0"), F.col("z0") + one), (F.col("y0"), F.col("z0"), F.col("x0") + one))
    return rounded(vol(spark, sf_dir).select("node_id", *[c.alias(n) for c, n in zip(m, MATRIX)]), *MATRIX, digits=6)


@query(
    f"with {LATTICE}, {QUADS}, p as (select pt_id, x, y + cast(0.01 as double) * i * i as y, z from lattice), "
    "e as (select q.patch_id, unnest([q.n1, q.n2]) as a, unnest([q.n2, q.n3]) as b, unnest([q.n3, q.n4]) as c from (select *, face_id // 40 % 5 as patch_id from quads) q), "
    "t as (select e.patch_id, (c.y - b.y) * (a.z - b.z) - (c.z - b.z) * (a.y - b.y) as cx, (c.z - b.z) * (a.x - b.x) - (c.x - b.x) * (a.z - b.z) as cy, (c.x - b.x) * (a.y - b.y) - (c.y - b.y) * (a.x - b.x) as cz "
    "from e join p a on a.pt_id = e.a join p b on b.pt_id = e.b join p c on c.pt_id = e.c), "
    "u as (select patch_id, avg(cx / sqrt(cx ** 2 + cy ** 2 + cz ** 2)) as x, avg(cy / sqrt(cx ** 2 + cy ** 2 + cz ** 2)) as y, avg(cz / sqrt(cx ** 2 + cy ** 2 + cz ** 2)) as z from t group by patch_id) "
    f"select cast(patch_id as int) as patch_id, {r8s('x / sqrt(x ** 2 + y ** 2 + z ** 2)', 6)} as nx, {r8s('y / sqrt(x ** 2 + y ** 2 + z ** 2)', 6)} as ny, {r8s('z / sqrt(x ** 2 + y ** 2 + z ** 2)', 6)} as nz from u"
)
def patch_average_normal(spark, sf_dir):
    p = lattice(spark, sf_dir)
    faces = points.lattice_quads(p).withColumn("patch_id", (F.floor(F.col("face_id") / 40) % 5).cast("int"))
    return rounded(symmetry.patch_normals(faces, p.select("pt_id", "x", (F.col("y") + 0.01 * F.col("i") * F.col("i")).alias("y"), "z")), "nx", "ny", "nz", digits=6)


def _flat(q: DataFrame) -> DataFrame:
    return q.select("face_id", *[F.get("nodes", F.lit(i)).alias(f"n{i + 1}") for i in range(4)])


@query(f"with {LATTICE}, {QUADS} select * from quads")
def lattice_quads_low(spark, sf_dir):
    return _flat(points.lattice_quads(lattice(spark, sf_dir)))


@query(f"with {LATTICE}, {QUADS} select face_id, n1, n4 as n2, n3, n2 as n4 from quads")
def lattice_quads_high(spark, sf_dir):
    return _flat(points.lattice_quads(lattice(spark, sf_dir), high=True))


@query(f"with {LATTICE}, {QUADS}, {CORNERS} select face_id, cast(4 as int) as k, cast(pos as int) as pos, node from corners")
def face_incidence(spark, sf_dir):
    return points.incidence(points.lattice_quads(lattice(spark, sf_dir)))


@query(f"with {LATTICE}, {QUADS}, {CORNERS} select max(n) as max_faces from (select count(*) as n from corners group by node)")
def max_faces_per_node(spark, sf_dir):
    return points.max_faces_per_node(points.lattice_quads(lattice(spark, sf_dir)))


@query(f"with {CROWDED} select pt_id, min(pt_id) over (partition by x, y, z) as rep_id from crowded")
def point_merge(spark, sf_dir):
    return points.point_merge(crowded(spark, sf_dir))


@query(f"with {EMB}, g as (select pt_id, round(x * 20) as x, round(y * 20) as y, cast(0 as double) as z from emb) select a.pt_id, min(b.pt_id) as rep_id from g a join g b on (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1 group by a.pt_id")
def point_merge_tolerance(spark, sf_dir):
    e = emb(spark, sf_dir).select("pt_id", F.round(F.col("x") * 20).alias("x"), F.round(F.col("y") * 20).alias("y"), F.lit(0.0).alias("z"))
    return points.point_merge(e, 1.0)


@query(f"with {CROWDED} select x, y, z, min(pt_id) as pt_id from crowded group by x, y, z")
def first_occurrence(spark, sf_dir):
    return points.first_occurrence(crowded(spark, sf_dir))


@query(f"with {CROWDED} select pt_id, row_number() over (order by z, y, x, pt_id) - 1 as u_id from crowded")
def lexsort_rank(spark, sf_dir):
    return points.lexsort_rank(crowded(spark, sf_dir))


@query(f"with {LATTICE}, {QUADS} select face_id, cast(sum(4) over (order by face_id) - 4 as bigint) as begin, cast(sum(4) over (order by face_id) as bigint) as stop from quads")
def csr_pointers(spark, sf_dir):
    return points.csr_pointers(points.lattice_quads(lattice(spark, sf_dir)))


@query(f"with {VOL} select zone_id, count(*) as n, cast(sum(count(*)) over (order by zone_id) - count(*) as bigint) as \"offset\" from vol group by zone_id")
def rank_offsets(spark, sf_dir):
    return points.offsets(vol(spark, sf_dir).groupBy("zone_id").agg(F.count(F.lit(1)).alias("n")), "zone_id", "n")


@query(f"with {SURF}, {VOL}, a as (select node_id, 0 as part, x0, y0, z0 from vol), m as (select max(node_id) + 1 as k from vol) select node_id, cast(part as int) as part, x0, y0, z0 from a union all select pt_id + k, 1, x, y, z from surf, m")
def merge_grids(spark, sf_dir):
    s = surf(spark, sf_dir).select(F.col("pt_id").alias("node_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("z").alias("z0"))
    return points.merge_grids([vol(spark, sf_dir), s])


# neighbours

D2 = "(a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2"


def knn_sql(k: int, where: str = "true") -> str:
    return f'with {EMB} select q_id, cast(r as int) as "rank", pt_id, {r8s("d2")} as d2 from (select a.pt_id as q_id, b.pt_id, {D2} as d2, row_number() over (partition by a.pt_id order by {D2}, b.pt_id) as r from emb a join emb b on {where}) where r <= {k}'


@query(knn_sql(5))
def knn(spark, sf_dir):
    e = emb(spark, sf_dir)
    return rounded(neighbors.knn(neighbors.with_ids(e), e, 5), "d2")


@query(knn_sql(3, "abs(a.pt_id - b.pt_id) >= 10"))
def knn_decorrelated(spark, sf_dir):
    e = emb(spark, sf_dir)
    return rounded(neighbors.knn(neighbors.with_ids(e), e, 3, decorrelate=10), "d2")


@query(f"with {EMB} select a.pt_id as q_id, b.pt_id, {r8s(D2)} as d2 from emb a join emb b on {D2} <= cast(0.1 as double) * cast(0.1 as double)")
def r_nearest(spark, sf_dir):
    e = emb(spark, sf_dir)
    return rounded(neighbors.r_nearest(neighbors.with_ids(e), e, 0.1), "d2")


@query(f"with {EMB} select a.pt_id as q_id, count(b.pt_id) as n from emb a left join emb b on {D2} <= cast(0.05 as double) * cast(0.05 as double) and abs(a.pt_id - b.pt_id) >= 1 group by a.pt_id")
def r_count(spark, sf_dir):
    e = emb(spark, sf_dir)
    return neighbors.r_count(neighbors.with_ids(e), e, 0.05, decorrelate=1)


@query(knn_sql(4, "abs(a.pt_id - b.pt_id) >= 2"))
def brute_knn(spark, sf_dir):
    e = emb(spark, sf_dir)
    return rounded(neighbors.brute_knn(neighbors.with_ids(e), e, 4, decorrelate=2), "d2")


@query(f"with {EMB}, g as (select pt_id, round(x * 20) as x, round(y * 20) as y, cast(0 as double) as z from emb) select a.pt_id as q_id, b.pt_id, {D2} as d2 from g a join g b on {D2} < 4")
def brute_within(spark, sf_dir):
    e = emb(spark, sf_dir).select("pt_id", F.round(F.col("x") * 20).alias("x"), F.round(F.col("y") * 20).alias("y"), F.lit(0.0).alias("z"))
    return neighbors.brute_within(neighbors.with_ids(e), e, 2.0, strict=True)


@query(f"with {CROWDED}, r as (select pt_id, sqrt(x * x + y * y + z * z) as radius from crowded) select pt_id, {r8s('radius')} as radius, row_number() over (order by radius, pt_id) - 1 as \"rank\" from r")
def radius_rank(spark, sf_dir):
    return rounded(points.radius_rank(crowded(spark, sf_dir)), "radius")


@query(f"with {EMB}, g as (select pt_id, round(x * 20) as x, round(y * 20) as y, cast(0 as double) as z from emb) select a.pt_id, min(b.pt_id) as rep_id from g a join g b on {D2} < 2.25 group by a.pt_id")
def radius_merge(spark, sf_dir):
    e = emb(spark, sf_dir).select("pt_id", F.round(F.col("x") * 20).alias("x"), F.round(F.col("y") * 20).alias("y"), F.lit(0.0).alias("z"))
    return points.radius_merge(e, 1.5)


@query(f"with {EMB} select pt_id, x <= (select avg(x) from emb) as is_left from emb")
def mean_split(spark, sf_dir):
    return points.mean_split(emb(spark, sf_dir), "x")


@query(f"with {EMB} select pt_id, row_number() over (order by y, pt_id) <= (select (count(*) + 1) // 2 from emb) as is_left from emb")
def median_split(spark, sf_dir):
    return points.median_split(emb(spark, sf_dir), "y")


@query(f"with {EMB} select pt_id as q_id, case when pt_id % 2 = 0 then pt_id + 1 else 0 end as found from emb")
def point_in_tree(spark, sf_dir):
    e = emb(spark, sf_dir)
    away = neighbors.with_ids(e).withColumn("x", F.when(F.col("q_id") % 2 == 0, F.col("x")).otherwise(F.col("x") + 1000))
    return neighbors.point_in_tree(away, e)


@query(f"with {VOL} select node_id, {r8s('greatest(0.25 - x0, x0 - 0.75, 0) ** 2 + greatest(0.25 - y0, y0 - 0.75, 0) ** 2 + greatest(0.25 - z0, z0 - 0.75, 0) ** 2')} as d2 from (select node_id, x0, y0, z0 from vol)")
def distance_to_box(spark, sf_dir):
    lo, hi = (F.lit(0.25),) * 3, (F.lit(0.75),) * 3
    return vol(spark, sf_dir).select("node_id", r8(G.distance_to_box(G.vector("x0", "y0", "z0"), lo, hi)).alias("d2"))


KNOTS = ", ".join(map(str, G.ERROR_KNOTS))


@query(
    f"with k as (select c_custkey as node_id, cast(2.1370001 as double) + (c_custkey % 700) as ratio from customer), t as (select [{KNOTS}] as s) "
    f"select node_id, {r8s('case when ratio >= 640 then 1.0 / 640 else (1 - (ratio - lo) / (hi - lo)) / lo + (ratio - lo) / (hi - lo) / hi end', 6)} as err "
    "from (select node_id, ratio, list_max(list_filter(s, lambda v: v <= ratio)) as lo, coalesce(list_min(list_filter(s, lambda v: v > ratio)), 640.0) as hi from k, t)"
)
def error_lookup(spark, sf_dir):
    errors = F.array(*[F.lit(1.0 / k) for k in G.ERROR_KNOTS])
    k = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), (F.lit(2.1370001) + F.col("c_custkey") % 700).alias("ratio"))
    return k.select("node_id", r8(G.error_at(errors, F.col("ratio")), 6).alias("err"))


# patches, sections, instances


@query(f"with {BOUNDARY} select * from boundary where lower(bc_type) like 'bcwall%'")
def wall_filter(spark, sf_dir):
    return patches.wall_filter(boundary(spark, sf_dir))


@query(f"with {BOUNDARY} select * from boundary where bc_type = 'BCSymmetryPlane'")
def symmetry_filter(spark, sf_dir):
    return patches.symmetry_filter(boundary(spark, sf_dir))


def _wanted(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "nation").filter("n_nationkey % 3 = 0").select(F.concat(F.lower("n_name"), F.lit(" ")).alias("name"))


@query(f"with {BOUNDARY} select * from boundary where lower(trim(family)) in (select lower(n_name) from nation where n_nationkey % 3 = 0)")
def family_select(spark, sf_dir):
    return patches.family_select(boundary(spark, sf_dir), _wanted(spark, sf_dir))


@query("select lower(n_name) as name from nation where n_nationkey % 3 = 0 and n_nationkey % 4 = 0")
def missing_families(spark, sf_dir):
    return patches.missing_families(boundary(spark, sf_dir), _wanted(spark, sf_dir))


@query(f"with {BOUNDARY} select patch_id, bc_type, coalesce(family, case bc_type when 'BCSymmetryPlane' then 'sym' when 'BCFarfield' then 'far' when 'BCGeneral' then 'general' else 'wall' end) as family from boundary")
def default_family(spark, sf_dir):
    return patches.default_family(boundary(spark, sf_dir)).select("patch_id", "bc_type", "family")


@query("select p_partkey as elem_id, cast(min(n_nationkey) as int) as sec_id from part join nation on p_partkey between n_nationkey * 70 and n_nationkey * 70 + 80 group by p_partkey")
def elem_to_section(spark, sf_dir):
    k = F.col("n_nationkey").cast("long")
    sections = read(spark, sf_dir, "nation").select(k.cast("int").alias("sec_id"), (k * 70).alias("elem_start"), (k * 70 + 80).alias("elem_end"))
    return patches.elem_to_section(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("elem_id")), sections)


@query("select c_custkey as node_id, cast(c_nationkey as int) as block_id, cast(r_regionkey as int) as inst_id from customer join region on c_nationkey >= r_regionkey * 5 and c_nationkey < r_regionkey * 5 + 3")
def block_to_instance(spark, sf_dir):
    k = F.col("r_regionkey").cast("int")
    inst = read(spark, sf_dir, "region").select(k.alias("inst_id"), (k * 5).alias("block_lo"), (k * 5 + 3).alias("block_hi"))
    return patches.block_to_instance(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").cast("int").alias("block_id")), inst)


@query("select c_custkey as dof, cast(r_regionkey as int) as inst_id from customer join region on c_custkey >= r_regionkey * 200 and c_custkey < r_regionkey * 200 + 150")
def instance_mask(spark, sf_dir):
    k = F.col("r_regionkey").cast("long")
    inst = read(spark, sf_dir, "region").select(k.cast("int").alias("inst_id"), (k * 200).alias("dof_lo"), (k * 200 + 150).alias("dof_hi"))
    return patches.instance_mask(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dof")), inst)


@query("select inst_id, node, row_number() over (partition by inst_id order by node) - 1 as local_id from (select distinct cast(l_linenumber as int) as inst_id, l_partkey as node from lineitem)")
def filtered_reindex(spark, sf_dir):
    return patches.filtered_reindex(read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("int").alias("inst_id"), F.col("l_partkey").alias("node")))


# orderings and balance


def _map(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("solver_dof"), F.col("l_partkey").alias("common_dof"))


MAP = "map as (select l_orderkey * 10 + l_linenumber as solver_dof, l_partkey as common_dof from lineitem)"


@query(f"with {MAP}, {LATTICE} select solver_dof, {r8s('z')} as value from map join lattice on pt_id = common_dof")
def warp_to_solver(spark, sf_dir):
    return rounded(transfer.warp_to_solver(_map(spark, sf_dir), lattice(spark, sf_dir).select(F.col("pt_id").alias("common_dof"), F.col("z").alias("value"))), "value")


@query(f"with {MAP} select p_partkey as common_dof, {r8s('coalesce(sum((solver_dof % 97) / cast(97 as double)), 0)', 6)} as value from part left join map on common_dof = p_partkey group by p_partkey")
def solver_to_warp_add(spark, sf_dir):
    m = _map(spark, sf_dir)
    values = m.select("solver_dof", ((F.col("solver_dof") % 97) / 97.0).alias("value")).distinct()
    return rounded(transfer.solver_to_warp(m, values, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("common_dof"))), "value", digits=6)


def _costs(spark, sf_dir) -> DataFrame:
    return vol(spark, sf_dir).select("node_id", (F.lit(1.0) + F.col("node_id") % 5).alias("cost"))


COSTS = "costs as (select c_custkey as node_id, cast(1 + c_custkey % 5 as double) as cost from customer), cums as (select *, sum(cost) over (order by node_id) as cum from costs)"


@query(f"with {COSTS} select * from cums")
def cost_prefix(spark, sf_dir):
    return transfer.cost_prefix(_costs(spark, sf_dir))


@query(f"with {COSTS} select node_id, cast(least(7, floor((cum - cost) / (select sum(cost) / 8 from costs))) as int) as part_id from cums")
def cost_bins(spark, sf_dir):
    return transfer.cost_bins(_costs(spark, sf_dir), 8)


@query(f"with {COSTS}, b as (select node_id, cast(least(7, floor((cum - cost) / (select sum(cost) / 8 from costs))) as int) as part_id from cums) select part_id, min(node_id) as first_node from b group by part_id")
def cost_splits(spark, sf_dir):
    return transfer.splits(transfer.cost_bins(_costs(spark, sf_dir), 8))


@query(f"with {COSTS}, b as (select node_id, cast(least(7, floor((cum - cost) / (select sum(cost) / 8 from costs))) as int) as part_id from cums) select min(node_id) as node_id, part_id from b group by part_id")
def bin_changes(spark, sf_dir):
    return transfer.bin_changes(transfer.cost_bins(_costs(spark, sf_dir), 8))


@query("with b as (select c_custkey * (case when c_custkey % 3 = 0 then 1000003 else 1 end) + c_custkey % 7 * 50000017 as node_id, cast(c_custkey % 11 // 4 as int) as part_id from customer) select node_id, part_id from (select *, lag(part_id) over (order by node_id) as p from b) where p is null or p <> part_id")
def bin_changes_with_gaps(spark, sf_dir):
    k = F.col("c_custkey")
    node = k * F.when(k % 3 == 0, 1000003).otherwise(1) + k % 7 * 50000017
    return transfer.bin_changes(read(spark, sf_dir, "customer").select(node.cast("long").alias("node_id"), F.floor(k % 11 / 4).cast("int").alias("part_id")))


@query(f"with {VOL} select {r8s('sum(x0 + y0 + z0)', 6)} as total, count(*) as n from vol")
def grid_checksum(spark, sf_dir):
    return rounded(transfer.checksum(vol(spark, sf_dir).select(F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("z0").alias("z"))), "total", digits=6)


@query(f"with {VOL} select zone_id, count(*) as n_nodes from vol group by zone_id")
def zone_counts(spark, sf_dir):
    return vol(spark, sf_dir).groupBy("zone_id").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(f"with {VOL} select * from vol where node_id % 100 = 0")
def strided_sample(spark, sf_dir):
    return transfer.strided(vol(spark, sf_dir))


@query(f"with {VOL} select node_id * 3 + i as dof, case i when 0 then x0 when 1 then y0 else z0 end as value from vol, (select unnest([0, 1, 2]) as i)")
def flat_dofs(spark, sf_dir):
    return transfer.flatten(vol(spark, sf_dir).select("node_id", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("z0").alias("z")))


# symmetry


@query(f"with {SURF} select pt_id, cast(k as int) as image, {r8s('x')} as x, {r8s('case when k & 2 > 0 then -y else y end')} as y, {r8s('case when k & 1 > 0 then -z else z end')} as z from surf, (select unnest([0, 1, 2, 3]) as k)")
def mirror_images(spark, sf_dir):
    return rounded(symmetry.mirror_images(surf(spark, sf_dir), PLANES_ZY), "x", "y", "z")


NORMAL = (0.6, 0.0, 0.8)


@query(f"with {SURF}, d as (select pt_id, x * cast(0.6 as double) + z * cast(0.8 as double) as d from surf) select pt_id as plane_id, {r8s('d * cast(0.6 as double)')} as fx, {r8s('d * cast(0 as double)')} as fy, {r8s('d * cast(0.8 as double)')} as fz, cast(0.6 as double) as nx, cast(0 as double) as ny, cast(0.8 as double) as nz from d")
def plane_foot(spark, sf_dir):
    planes = surf(spark, sf_dir).select(F.col("pt_id").alias("plane_id"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), *[F.lit(v).alias(f"n{c}") for v, c in zip(NORMAL, "xyz")])
    return rounded(symmetry.plane_feet(planes), "fx", "fy", "fz")


@query("with p as (select n_nationkey % 5 as h, min(n_nationkey) as f from nation group by h) select cast(row_number() over (order by f) - 1 as int) as plane_id, cast(h as double) as z from p")
def plane_dedupe(spark, sf_dir):
    keys = [r[0] for r in read(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # 25 rows
    found = symmetry.unique_planes([((float(k), float(k) / 2, float(k % 5)), (0.0, 0.0, 1.0 if k % 2 else -1.0)) for k in keys])
    return spark.createDataFrame([(i, float(p[2])) for i, (p, _) in enumerate(found)], "plane_id int, z double")


# several components


def _components(spark, sf_dir):
    s = surf(spark, sf_dir)
    make = lambda r, k: Warper.from_areas(s.filter(F.col("pt_id") % 2 == r), options=EXACT)
    shear = lambda k: lambda df: df.withColumn("x", F.col("x") + k * F.col("z"))
    return multi.MultiWarper([multi.Component("Left", make(0, 0.05), shear(0.05)), multi.Component("right", make(1, 0.02), shear(0.02))])


def _zoned(spark, sf_dir) -> DataFrame:
    return vol(spark, sf_dir).withColumn("instance", F.when(F.col("zone_id") < 10, "left").when(F.col("zone_id") < 20, "Right"))


def _multi_sql() -> str:
    parts = []
    for name, r, k, lo in (("l", 0, 0.05, 0), ("r", 1, 0.02, 10)):
        parts.append(
            f"{name}s as (select * from surf where pt_id % 2 = {r}), {name}c as (select avg(x) as mx, avg(y) as my, avg(z) as mz from {name}s), {name}e as (select max(sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2)) as ldef from {name}s, {name}c), "
            f"{name} as (select v.node_id, sum(w * cast({k} as double) * z) / sum(w) as dx from (select v.node_id, s.z, {weight_sql('(v.x0 - s.x) ** 2 + (v.y0 - s.y) ** 2 + (v.z0 - s.z) ** 2')} as w from vol v, {name}s s, {name}e where zone_id >= {lo} and zone_id < {lo + 10}) v group by v.node_id)"
        )
    return f"with {SURF}, {VOL}, {', '.join(parts)} select node_id, {r8s('x0 + coalesce(l.dx, r.dx, 0)')} as x, {r8s('y0')} as y, {r8s('z0')} as z from vol left join l using (node_id) left join r using (node_id)"


@query(_multi_sql())
def multi_warp(spark, sf_dir):
    return rounded(_components(spark, sf_dir).warp(_zoned(spark, sf_dir)), "x", "y", "z")


@query(_multi_sql())
def multi_overlay(spark, sf_dir):
    return rounded(_components(spark, sf_dir).solver_grid(_zoned(spark, sf_dir)), "x", "y", "z")


# derivatives

WEIGHTS = f"ws as (select v.node_id, s.pt_id, {weight_sql('(v.x0 - s.x) ** 2 + (v.y0 - s.y) ** 2 + (v.z0 - s.z) ** 2')} as w from vol v, surf s, extent), shares as (select node_id, pt_id, w / sum(w) over (partition by node_id) as w from ws) "


def _tangent(spark, sf_dir) -> DataFrame:
    return surf(spark, sf_dir).select("pt_id", F.col("y").alias("dx"), F.col("z").alias("dy"), (F.col("x") * 2).alias("dz"))


def _seeds(spark, sf_dir) -> DataFrame:
    return vol(spark, sf_dir).select("node_id", F.col("y0").alias("vx"), F.col("z0").alias("vy"), (F.col("x0") + 1).alias("vz"))


@query(HEAD.rstrip() + f", {WEIGHTS} select node_id, {r8s('sum(w * y)')} as dx, {r8s('sum(w * z)')} as dy, {r8s('sum(w * x * 2)')} as dz from shares join surf using (pt_id) group by node_id")
def jvp_exact_norot(spark, sf_dir):
    return rounded(Warper.from_areas(surf(spark, sf_dir), options=EXACT).jvp(vol(spark, sf_dir), None, _tangent(spark, sf_dir)), "dx", "dy", "dz")


@query(HEAD.rstrip() + f", {WEIGHTS} select pt_id, {r8s('sum(w * y0)', 6)} as dx, {r8s('sum(w * z0)', 6)} as dy, {r8s('sum(w * (x0 + 1))', 6)} as dz from shares join vol using (node_id) group by pt_id")
def vjp_exact_norot(spark, sf_dir):
    return rounded(Warper.from_areas(surf(spark, sf_dir), options=EXACT).vjp(vol(spark, sf_dir), None, _seeds(spark, sf_dir)), "dx", "dy", "dz", digits=6)


def _dot_products(w: Warper, v: DataFrame, deform, tangent: DataFrame, seeds: DataFrame) -> DataFrame:
    total = lambda a, b, key, n: a.join(b, key).agg(F.sum(sum(F.col(x) * F.col(y) for x, y in n)).alias("s"))
    forward = total(w.jvp(v, deform, tangent), seeds, "node_id", [("dx", "vx"), ("dy", "vy"), ("dz", "vz")])
    back = total(w.vjp(v, deform, seeds).select("pt_id", *[F.col(f"d{c}").alias(f"b{c}") for c in "xyz"]), tangent, "pt_id", [("bx", "dx"), ("by", "dy"), ("bz", "dz")])
    return forward.select(F.lit("forward").alias("product"), r8(F.col("s"), 6).alias("value")).unionByName(back.select(F.lit("transposed").alias("product"), r8(F.col("s"), 6).alias("value")))


@query(HEAD.rstrip() + f", {WEIGHTS}, d as (select sum(w * (s.y * v.y0 + s.z * v.z0 + s.x * 2 * (v.x0 + 1))) as s from shares join surf s using (pt_id) join vol v using (node_id)) select p as product, {r8s('s', 6)} as value from d, (select unnest(['forward', 'transposed']) as p)")
def dot_product_test(spark, sf_dir):
    w = Warper.from_areas(surf(spark, sf_dir), options=EXACT)
    return _dot_products(w, vol(spark, sf_dir), None, _tangent(spark, sf_dir), _seeds(spark, sf_dir))


STEP = "2e-5"


def _shifted(sign: str, name: str) -> str:
    t = {"x": "l.y", "y": "l.z", "z": "l.x * l.y"}
    return f"{name} as (select b.pt_id, b.i, b.j, " + ", ".join(f"b.{c} {sign} cast({STEP} as double) * {t[c]} as {c}" for c in "xyz") + " from bent b join lattice l using (pt_id)), "


#: The derivative of the warp with rotations along a motion of the surface, by central differences.
DIFFERENCES = (
    FACED + FLAGS + f"surf as (select pt_id, x, y, z from lattice), {EXTENT}, {VOL}, "
    + "".join(_shifted(sign, f"b{n}") + props_sql(f"b{n}", f"g{n}") + ", " + normals_sql(f"g{n}", f"h{n}") + ", " + state_sql(f"b{n}", f"h{n}", f"s{n}") for sign, n in (("+", "p"), ("-", "m")))
    + turned_sums_sql("sp", "up") + ", " + turned_sums_sql("sm", "um")
    + ", slope as (select node_id, " + ", ".join(f"(up.d{c} - um.d{c}) / (2 * cast({STEP} as double)) as d{c}" for c in "xyz") + " from up join um using (node_id))"
)


def _lattice_tangent(spark, sf_dir) -> DataFrame:
    return lattice(spark, sf_dir).select("pt_id", F.col("y").alias("dx"), F.col("z").alias("dy"), (F.col("x") * F.col("y")).alias("dz"))


@query(DIFFERENCES + f" select node_id, {r8s('dx', 4)} as dx, {r8s('dy', 4)} as dy, {r8s('dz', 4)} as dz from slope")
def jvp_rot(spark, sf_dir):
    return rounded(_lattice_warper(spark, sf_dir, eval_mode="exact").jvp(vol(spark, sf_dir), BEND, _lattice_tangent(spark, sf_dir)), "dx", "dy", "dz", digits=4)


@query(DIFFERENCES + f" select node_id, {r8s('dx', 4)} as dx, {r8s('dy', 4)} as dy, {r8s('dz', 4)} as dz from slope")
def complex_step(spark, sf_dir):
    return rounded(_lattice_warper(spark, sf_dir, eval_mode="exact").complex_step(vol(spark, sf_dir), BEND, _lattice_tangent(spark, sf_dir)), "dx", "dy", "dz", digits=4)


@query(DIFFERENCES + f", d as (select sum(dx * y0 + dy * z0 + dz * (x0 + 1)) as s from slope join vol using (node_id)) select p as product, {r8s('s', 3)} as value from d, (select unnest(['forward', 'transposed']) as p)")
def dot_product_rot(spark, sf_dir):
    w = _lattice_warper(spark, sf_dir, eval_mode="exact")
    return rounded(_dot_products(w, vol(spark, sf_dir), BEND, _lattice_tangent(spark, sf_dir), _seeds(spark, sf_dir)), "value", digits=3)


# the tree: with leaves of half the points it has a root and two leaves, which SQL can follow

TOLERANCE = 0.05


def _split_warper(spark, sf_dir, **options) -> Warper:
    p = lattice(spark, sf_dir)
    return _lattice_warper(spark, sf_dir, bucket_size=max(1, p.count() // 2), err_tol=TOLERANCE, **options)


def _far(spark, sf_dir) -> DataFrame:
    return vol(spark, sf_dir).select("node_id", *[(F.col(f"{c}0") * 6).alias(f"{c}0") for c in "xyz"])


_SAMPLES = "[" + ", ".join("[" + ", ".join(f"cast({float(v)!r} as double)" for v in p) + "]" for p in sample_sphere()) + "]"
_KNOT_LIST = "[" + ", ".join(f"cast({k} as double)" for k in G.ERROR_KNOTS) + "]"
SPLIT = (
    FACED + f"surf as (select pt_id, x, y, z from lattice), {EXTENT}, {VOL}, far as (select node_id, x0 * 6 as x0, y0 * 6 as y0, z0 * 6 as z0 from vol), "
    "u as (select l.pt_id, l.x, l.y, l.z, n0.a, row_number() over (order by l.z, l.y, l.x) as u_id from lattice l join n0 on n0.node = l.pt_id), "
    "c as (select count(*) as n, avg(x) as cx, avg(y) as cy, avg(z) as cz, sum(a) as ta from u), r as (select max(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)) as rad from u, c), "
    f"rays as (select k, t * rad as reach, p[1] * t * rad as px, p[2] * t * rad as py, p[3] * t * rad as pz from (select unnest({_KNOT_LIST}) as t, unnest(range(1, 13)) as k), (select unnest({_SAMPLES}) as p), r), "
    f"errs as (select k, sqrt(avg((exact - whole) ** 2)) as err from (select k, px, py, pz, sum({weight_sql('(px + cx - u.x) ** 2 + (py + cy - u.y) ** 2 + (pz + cz - u.z) ** 2', 'u.a', eps='0')}) as exact, "
    f"any_value({weight_sql('px ** 2 + py ** 2 + pz ** 2', 'ta', eps='0')}) as whole from rays, u, c, extent group by k, px, py, pz) group by k), "
    f"known as (select list(err order by k) as es, {_KNOT_LIST} as ts from errs), "
    "dist as (select f.*, (x0 - cx) ** 2 + (y0 - cy) ** 2 + (z0 - cz) ** 2 as d2, sqrt((x0 - cx) ** 2 + (y0 - cy) ** 2 + (z0 - cz) ** 2) / rad as ratio, sqrt((x0 - cx) ** 2 + (y0 - cy) ** 2 + (z0 - cz) ** 2 + 1e-16) / rad > 5 as wide from far f, c, r), "
    f"near as (select node_id, sum({weight_sql('(x0 - u.x) ** 2 + (y0 - u.y) ** 2 + (z0 - u.z) ** 2', 'u.a', eps='1e-16')}) as s from far, u, extent group by node_id), "
    f"den as (select d.*, case when wide then {weight_sql('d2', 'ta', eps='1e-16')} else s end as den0 from dist d join near using (node_id), c, extent), "
    "slot as (select *, greatest(1, len(list_filter(ts, lambda t: t <= ratio))) as k from den, known), "
    f"told as (select *, ratio >= 2 and (case when k >= 12 then es[12] else es[k] + (ratio - ts[k]) / (ts[k + 1] - ts[k]) * (es[k + 1] - es[k]) end) < cast({TOLERANCE} as double) * den0 as whole from slot), "
)


@query(SPLIT + f"x as (select 1) select cast(k - 1 as int) as knot, {r8s('err * 1000', 7)} as err from errs")
def error_profile(spark, sf_dir):
    tree = _split_warper(spark, sf_dir).tree_frame()
    return tree.filter("left_id >= 0").select(F.posexplode("err").alias("knot", "err")).select("knot", r8(F.col("err") * 1000, 7).alias("err"))


@query(SPLIT + f"x as (select 1) select node_id, {r8s('den0', 6)} as denominator from den")
def denominator_estimate(spark, sf_dir):
    return rounded(_split_warper(spark, sf_dir).denominators(_far(spark, sf_dir), estimate=True), "denominator", digits=6)


@query(SPLIT + f"x as (select 1) select node_id, {r8s('den0', 6)} as denominator, {r8s('case when whole then 1.6 / n else (0.5 + n) / n end')} as cost from told, c")
def dry_run_cost(spark, sf_dir):
    return rounded(rounded(_split_warper(spark, sf_dir).costs(_far(spark, sf_dir)), "denominator", digits=6), "cost")


_WHOLE = ", ".join(f"avg({m}) as {m}" for m in (*MATRIX, "b1", "b2", "b3"))


@query(
    SPLIT + FLAGS + state_sql("bent", "n1", "state")
    + f"pairs as (select t.node_id, x0, y0, z0, {', '.join((*MATRIX, 'b1', 'b2', 'b3'))}, {weight_sql('(x0 - sx) ** 2 + (y0 - sy) ** 2 + (z0 - sz) ** 2', 'a')} as w from told t, state, extent where not whole "
    + f"union all select t.node_id, x0, y0, z0, {', '.join('m.' + m for m in (*MATRIX, 'b1', 'b2', 'b3'))}, {weight_sql('d2', 'ta', eps='0')} from told t, (select {_WHOLE} from state) m, c, extent where whole), "
    + "sums as (select node_id, " + ", ".join(f"sum(w * (m{i}1 * x0 + m{i}2 * y0 + m{i}3 * z0 + b{i} - {c}0)) / sum(w) as d{c}" for i, c in zip("123", "xyz")) + " from pairs group by node_id) "
    + f"select node_id, {r8s('x0 + dx', 6)} as x, {r8s('y0 + dy', 6)} as y, {r8s('z0 + dz', 6)} as z from far join sums using (node_id)"
)
def warp_fast(spark, sf_dir):
    return rounded(_split_warper(spark, sf_dir).warp(_far(spark, sf_dir), BEND), "x", "y", "z", digits=6)


@query(
    "with recursive t(level, size, nodes) as (select 0, count(*), cast(1 as bigint) from part union all select level + 1, s, cast(sum(n) as bigint) from "
    "(select level, unnest([size - size // 2, size // 2]) as s, nodes as n from t where size > 9) group by level, s) "
    "select cast(level as int) as level, cast(sum(nodes) as bigint) as nodes, cast(sum(nodes * size) as bigint) as points, cast(max(size) as int) as largest from t group by level"
)
def tree_level_stats(spark, sf_dir):
    return _lattice_warper(spark, sf_dir).tree_sizes().groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("points"), F.max("n").alias("largest"))


@query(f"with {LATTICE}, c as (select max(x) - min(x) >= max(y) - min(y) and max(x) - min(x) >= max(z) - min(z) as by_x, max(y) - min(y) >= max(z) - min(z) as by_y, (count(*) + 1) // 2 as half from lattice), "
    "o as (select pt_id, row_number() over (order by case when by_x then x when by_y then y else z end, z, y, x) <= half as is_left from lattice, c) select is_left, count(*) as n, min(pt_id) as first_pt, max(pt_id) as last_pt from o group by is_left")  # fmt: skip
def tree_first_split(spark, sf_dir):
    w = _split_warper(spark, sf_dir)
    t = w.tree
    rows = [(bool(side == 0), int(t.u[k] - t.l[k]), *(int(f(w.pt_ids[w.surface.rep[w.order[t.l[k] : t.u[k]]]])) for f in (min, max))) for side, k in enumerate((t.left[0], t.right[0]))]
    return spark.createDataFrame(rows, "is_left boolean, n long, first_pt long, last_pt long")


# without a SQL form: checked by properties in the tests


@query()
def warp_fast_tree(spark, sf_dir):
    return rounded(_lattice_warper(spark, sf_dir).warp(vol(spark, sf_dir), BEND), "x", "y", "z", digits=6)


@query()
def vjp_rot(spark, sf_dir):
    return rounded(_lattice_warper(spark, sf_dir, eval_mode="exact").vjp(vol(spark, sf_dir), BEND, _seeds(spark, sf_dir)), "dx", "dy", "dz", digits=6)


@query()
def verify_deriv(spark, sf_dir):
    w = _lattice_warper(spark, sf_dir, eval_mode="exact")
    return w.verify(vol(spark, sf_dir), BEND(lattice(spark, sf_dir)).select("pt_id", "x", "y", "z"), _seeds(spark, sf_dir), 0, 3)


# meshes from tables


def _zones(spark, sf_dir) -> DataFrame:
    r = F.col("r_regionkey").cast("int")
    z = read(spark, sf_dir, "region").select(r.alias("zone_id"), (r + 3).alias("il"), F.lit(4).alias("jl"), (r % 2 + 2).alias("kl"))
    return z.withColumn("n_vertices", (F.col("il") * F.col("jl") * F.col("kl")).cast("long")).withColumn("structured", F.lit(True))


def _ranges(zones: DataFrame) -> DataFrame:
    """Four faces of each zone: low i, high i, low j, high k."""
    il, jl, kl = (F.col(c) for c in ("il", "jl", "kl"))
    one = F.lit(1)
    of = lambda *ends: F.array(F.array(*ends[:3]), F.array(*ends[3:]))
    faces = [of(one, one, one, one, jl, kl), of(il, one, one, il, jl, kl), of(one, one, one, il, one, kl), of(one, one, kl, il, jl, kl)]
    kinds = ("BCWallViscous", "BCFarfield", "BCSymmetryPlane", "BCWall")
    rows = F.array(*[F.struct(F.lit(k).alias("boco_id"), F.lit(kind).alias("bc_type"), f.alias("pt_range")) for k, (f, kind) in enumerate(zip(faces, kinds))])
    return zones.select("zone_id", F.explode(rows).alias("b")).select("zone_id", "b.boco_id", "b.bc_type", F.lit(None).cast("string").alias("family"), "b.pt_range")


_RANGE_SQL = (
    "z as (select cast(r_regionkey as int) as zone_id, r_regionkey + 3 as il, 4 as jl, r_regionkey % 2 + 2 as kl from region), o as (select *, sum(il * jl * kl) over (order by zone_id) - il * jl * kl as off from z), "
    "p as (select zone_id * 4 + b as patch_id, b, case when b < 2 then jl else il end as ni, case when b = 3 then jl else kl end as nj, case when b < 2 then il else 1 end as si, case when b = 3 then il else il * jl end as sj, "
    "off + case b when 1 then il - 1 when 3 then il * jl * (kl - 1) else 0 end as first, b in (0, 2) as low from o, (select unnest([0, 1, 2, 3]) as b)), "
    "q as (select *, first + si * i + sj * j as n1, first + si * (i + 1) + sj * j as n2, first + si * (i + 1) + sj * (j + 1) as n3, first + si * i + sj * (j + 1) as n4 "
    "from (select *, unnest(range(0, ni - 1)) as i from (select *, unnest(range(0, nj - 1)) as j from p)))"
)


@query(f"with {_RANGE_SQL} select cast(row_number() over (order by patch_id, j, i) - 1 as bigint) as face_id, cast(patch_id as int) as patch_id, cast(n1 as bigint) as n1, cast(case when low then n2 else n4 end as bigint) as n2, cast(n3 as bigint) as n3, cast(case when low then n4 else n2 end as bigint) as n4 from q")
def structured_patch_faces(spark, sf_dir):
    zones = _zones(spark, sf_dir)
    f = structured.patch_faces(structured.patch_ranges(zones, _ranges(zones)))
    return f.select("face_id", "patch_id", *[F.get("nodes", F.lit(i)).alias(f"n{i + 1}") for i in range(4)])


@query(f"with {_RANGE_SQL} select cast(patch_id as int) as patch_id, cast(j * ni + i as bigint) as pos, cast(first + si * i + sj * j as bigint) as node from (select *, unnest(range(0, ni)) as i from (select *, unnest(range(0, nj)) as j from p))")
def structured_patch_nodes(spark, sf_dir):
    zones = _zones(spark, sf_dir)
    return structured.patch_nodes(structured.patch_ranges(zones, _ranges(zones)))


@query("select zone_id, off as \"offset\" from (select cast(r_regionkey as int) as zone_id, cast(sum((r_regionkey + 3) * 4 * (r_regionkey % 2 + 2)) over (order by r_regionkey) - (r_regionkey + 3) * 4 * (r_regionkey % 2 + 2) as bigint) as off from region)")
def zone_offsets(spark, sf_dir):
    return structured.zone_offsets(_zones(spark, sf_dir)).select("zone_id", "offset")


def _streams(spark, sf_dir) -> DataFrame:
    """Sections of each zone: mixed triangles and quads, quads, tetrahedra, mixed triangles and tetrahedra."""
    r = F.col("r_regionkey").cast("int")
    z = read(spark, sf_dir, "region").select(r.alias("zone_id"), (r + 10).cast("long").alias("m"))
    e = lambda f: F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), f))
    run = lambda i, kind, k: F.array(*[F.lit(kind).cast("long")] * bool(kind), *[i + n for n in range(1, k + 1)])
    mixed = e(lambda i: F.when((i + F.col("zone_id")) % 3 == 0, run(i, 7, 4)).otherwise(run(i, 5, 3)))
    solid = e(lambda i: F.when(i % 2 == 0, run(i, 10, 4)).otherwise(run(i, 5, 3)))
    parts = [(0, 20, mixed), (1, 7, e(lambda i: run(i * 2, 0, 4))), (2, 10, e(lambda i: run(i * 3, 0, 4))), (3, 20, solid)]
    rows = F.array(*[F.struct(F.lit(k).alias("sec_id"), F.lit(t).alias("elem_type"), (F.col("m") * k + 1).alias("elem_start"), c.alias("conn")) for k, t, c in parts])
    return z.select("zone_id", F.explode(rows).alias("s")).select("zone_id", "s.sec_id", "s.elem_type", "s.elem_start", "s.conn")


_ELEMENTS = (
    "el as (select zone_id, sec_id, m * sec_id + 1 + i as elem_id, case sec_id when 0 then case when (i + zone_id) % 3 = 0 then 7 else 5 end when 1 then 7 when 2 then 10 else case when i % 2 = 0 then 10 else 5 end end as elem_type, "
    "i * case sec_id when 1 then 2 when 2 then 3 else 1 end + 1 as a from (select cast(r_regionkey as int) as zone_id, r_regionkey + 10 as m, unnest(range(0, r_regionkey + 10)) as i from region), (select unnest([0, 1, 2, 3]) as sec_id)), "
    "els as (select zone_id, cast(sec_id as int) as sec_id, cast(elem_id as bigint) as elem_id, cast(elem_type as int) as elem_type, a, case when elem_type = 5 then 3 else 4 end as k from el)"
)


@query(f"with {_ELEMENTS} select zone_id, sec_id, elem_id, elem_type, array_to_string(range(a, a + k), ',') as nodes from els")
def decode_elements(spark, sf_dir):
    return structured.decode_elements(_streams(spark, sf_dir)).withColumn("nodes", F.array_join(F.col("nodes").cast("array<string>"), ","))


@query("select cast(r_regionkey as int) as zone_id, cast(s as int) as sec_id from region, (select unnest([0, 1]) as s)")
def surface_sections(spark, sf_dir):
    streams = _streams(spark, sf_dir)
    return patches.surface_sections(streams.select("zone_id", "sec_id", "elem_type"), structured.decode_elements(streams)).select("zone_id", "sec_id")


@query("with s as (select n_regionkey as zone_id, cast(n_nationkey as int) as sec_id, row_number() over (partition by n_regionkey order by n_nationkey) as r, n_nationkey % 4 = 0 as late from nation), t as (select *, (r - 1) * 100 + 1 + late::int as elem_start, r * 100 as elem_end from s), "
    "u as (select *, coalesce(lag(elem_end) over (partition by zone_id order by elem_start, sec_id), 0) + 1 as expected from t) select cast(zone_id as int) as zone_id, sec_id, cast(expected as bigint) as expected, cast(elem_start as bigint) as elem_start from u where expected <> elem_start")  # fmt: skip
def section_gaps(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).cast("long")
    s = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("int").alias("zone_id"), F.col("n_nationkey").cast("int").alias("sec_id"), rank.alias("r"), (F.col("n_nationkey") % 4 == 0).cast("long").alias("late"))
    return patches.section_gaps(s.select("zone_id", "sec_id", ((F.col("r") - 1) * 100 + 1 + F.col("late")).alias("elem_start"), (F.col("r") * 100).alias("elem_end")))


def _element_bocos(spark, sf_dir) -> DataFrame:
    """Two conditions a zone: some elements of the first two sections, and some that no surface section has."""
    r = F.col("r_regionkey").cast("int")
    z = read(spark, sf_dir, "region").select(r.alias("zone_id"), (r + 10).cast("long").alias("m"))
    rows = F.array(*[F.struct(F.lit(k).alias("boco_id"), F.sequence(F.lit(a).cast("long"), F.col("m") * 2 + b, F.lit(3).cast("long")).alias("elements")) for k, (a, b) in enumerate(((1, 0), (2, 5)))])
    return z.select("zone_id", F.explode(rows).alias("b")).select("zone_id", "b.boco_id", "b.elements", F.lit("wing").alias("family"), F.lit("BCWall").alias("bc_type"))


_BOCO_ELEMENTS = "be as (select zone_id, b as boco_id, unnest(range(case b when 0 then 1 else 2 end, m * 2 + case b when 0 then 1 else 6 end, 3)) as elem_id from (select cast(r_regionkey as int) as zone_id, r_regionkey + 10 as m from region), (select unnest([0, 1]) as b))"


def _element_zones(spark, sf_dir) -> DataFrame:
    r = F.col("r_regionkey").cast("int")
    return read(spark, sf_dir, "region").select(r.alias("zone_id"), (r * 7 + 50).cast("long").alias("n_vertices"), *[F.lit(0).alias(c) for c in ("il", "jl", "kl")], F.lit(False).alias("structured"))


@query(f"with {_ELEMENTS}, {_BOCO_ELEMENTS}, zo as (select r_regionkey as zone_id, sum(r_regionkey * 7 + 50) over (order by r_regionkey) - (r_regionkey * 7 + 50) as off from region), "
    "m as (select be.zone_id * 2 + boco_id as patch_id, be.elem_id, a, k, off from be join els using (zone_id, elem_id) join zo using (zone_id) where elem_type in (5, 7) and sec_id < 2) "
    "select cast(row_number() over (order by patch_id, elem_id) - 1 as bigint) as face_id, cast(patch_id as int) as patch_id, array_to_string(list_transform(range(a, a + k), lambda n: cast(n - 1 + off as bigint)), ',') as nodes from m")  # fmt: skip
def boco_faces(spark, sf_dir):
    found = Mesh.unstructured(None, _element_zones(spark, sf_dir), _streams(spark, sf_dir), _element_bocos(spark, sf_dir), EXACT)
    return found.faces.withColumn("nodes", F.array_join(F.col("nodes").cast("array<string>"), ","))


@query(f"with {_ELEMENTS}, {_BOCO_ELEMENTS} select be.zone_id, cast(boco_id as int) as boco_id, count(*) as n from be left join (select * from els where elem_type in (5, 7) and sec_id < 2) e using (zone_id, elem_id) where e.a is null group by be.zone_id, boco_id")
def unmatched_elements(spark, sf_dir):
    flat = structured.decode_elements(_streams(spark, sf_dir)).filter("sec_id < 2")
    return structured.unmatched_elements(_element_bocos(spark, sf_dir), flat)


def _block(spark, sf_dir, options: WarpOptions) -> Mesh:
    """One zone, the lattice in two layers: a wall below, a symmetry plane at y = 0."""
    p = lattice(spark, sf_dir).select("pt_id", "x", "y", "z")
    n = p.count()
    layers = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    volume = p.select("*", layers).select((F.col("pt_id") + F.col("k") * n).alias("node_id"), F.lit(0).alias("zone_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("z") + 0.5 * F.col("k")).alias("z0"))
    zones = spark.createDataFrame([(0, True, 40, n // 40, 2, 2 * n)], "zone_id int, structured boolean, il int, jl int, kl int, n_vertices long")
    rows = [(0, 0, "BCWallViscous", "Wing", [[1, 1, 1], [40, n // 40, 1]]), (0, 1, "BCSymmetryPlane", None, [[1, 1, 1], [40, 1, 2]]), (0, 2, "BCFarfield", None, [[1, 1, 2], [40, n // 40, 2]])]
    return Mesh.structured(volume, zones, spark.createDataFrame(rows, "zone_id int, boco_id int, bc_type string, family string, pt_range array<array<int>>"), options)


LAYERS = "cnt as (select count(*) as n from lattice), block as (select pt_id + k * n as node_id, x as x0, y as y0, z + cast(0.5 as double) * k as z0 from lattice, cnt, (select unnest([0, 1]) as k))"


@query(
    FACED + f"surf as (select pt_id, x, y, z from lattice), {EXTENT}, {LAYERS}, sums as (select node_id, sum(w) as w, sum(w * sy * dy) as dy, sum(w * dz) as dz from (select b.node_id, sy, cast(0.02 as double) * s.x as dy, cast(0.1 as double) * s.x * s.x as dz, "
    + weight_sql("(b.x0 - s.x) ** 2 + (sy * b.y0 - s.y) ** 2 + (b.z0 - s.z) ** 2", "n0.a")
    + f" as w from block b, surf s join n0 on n0.node = s.pt_id, extent, (select unnest([1, -1]) as sy)) group by node_id) select node_id, {r8s('x0')} as x, {r8s('y0 + dy / w')} as y, {r8s('z0 + dz / w')} as z from block join sums using (node_id)"
)
def mesh_warp(spark, sf_dir):
    """From tables to the warped grid: the default surface of walls, planes found by themselves."""
    mesh = _block(spark, sf_dir, EXACT)
    moved = lambda d: d.select("pt_id", "x", (F.col("y") + 0.02 * F.col("x")).alias("y"), (F.col("z") + 0.1 * F.col("x") * F.col("x")).alias("z"))
    return rounded(mesh.warper().warp(mesh.volume, moved), "x", "y", "z")


@query(f"with {LATTICE}, {QUADS} select f.name as family, f.chosen, case when f.chosen then (select count(*) from quads) else 0 end as n_faces from (select 'wing' as name, true as chosen union all select 'sym', false union all select 'far', false) f")
def mesh_surface_families(spark, sf_dir):
    mesh = _block(spark, sf_dir, WarpOptions(eval_mode="exact", use_rotations=False, specified_surfaces=("WING ",)))
    counts = mesh.surface().groupBy("patch_id").agg(F.count(F.lit(1)).alias("n_faces"))
    named = mesh.patches.select("patch_id", F.lower("family").alias("family"))
    return named.join(counts, "patch_id", "left").select("family", F.col("n_faces").isNotNull().alias("chosen"), F.coalesce("n_faces", F.lit(0)).cast("long").alias("n_faces"))


@query("select " + ", ".join(f"cast({v} as double) as {c}" for c, v in (("px", 0), ("py", 0), ("pz", 0), ("nx", 0), ("ny", 1), ("nz", 0))))
def mesh_planes(spark, sf_dir):
    planes = _block(spark, sf_dir, EXACT).planes()
    rows = [(*(round(v, 8) + 0.0 for v in p), *(round(abs(v), 8) + 0.0 for v in n)) for p, n in planes]
    return spark.createDataFrame(rows, "px double, py double, pz double, nx double, ny double, nz double").select(*[F.col(c) for c in ("px", "py", "pz", "nx", "ny", "nz")])


@query(f"with {LATTICE}, {LAYERS}, map as (select l_orderkey * 10 + l_linenumber as solver_dof, l_partkey * 3 + l_linenumber % 3 as common_dof from lineitem) select solver_dof, case common_dof % 3 when 0 then x0 when 1 then y0 else z0 end as value from map join block on node_id = common_dof // 3")
def mesh_solver_grid(spark, sf_dir):
    k = F.col("l_linenumber").cast("long")
    solver = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + k).alias("solver_dof"), (F.col("l_partkey") * 3 + k % 3).alias("common_dof"))
    return _block(spark, sf_dir, EXACT).set_external_indices(solver).solver_grid()


# several instances over one volume


def _multi_mesh(spark, sf_dir) -> multi.MultiMesh:
    rows = [(0, "Left", 0, 10), (1, "right ", 10, 20), (2, "rest", 20, 25)]
    instances = spark.createDataFrame(rows, "inst_id int, name string, block_lo int, block_hi int")
    mesh = multi.MultiMesh(vol(spark, sf_dir), instances, {"LEFT": EXACT, "Right": EXACT})
    mesh.set_external_indices(_map(spark, sf_dir))
    p, f = lattice(spark, sf_dir), _blocked_faces(spark, sf_dir)
    mesh.set_surface(p, f)
    mesh.set_coordinates(BEND(p))
    return mesh


def _blocked_faces(spark, sf_dir) -> DataFrame:
    return points.lattice_quads(lattice(spark, sf_dir)).withColumn("block_id", (F.floor(F.col("face_id") / 40) % 25).cast("int"))


def _instance_sql(name: str, lo: int) -> str:
    """CTEs {name}s: nodes of the instance's faces with their areas; {name}w: shares of the weights at its zones' nodes."""
    return (
        f"{name}a as (select c.node, sum(f0.area / 4) as a from corners c join f0 using (face_id) where face_id // 40 % 25 >= {lo} and face_id // 40 % 25 < {lo + 10} group by c.node), "
        f"{name}s as (select l.pt_id, l.x, l.y, l.z, q.a from {name}a q join lattice l on l.pt_id = q.node), {name}c as (select avg(x) as mx, avg(y) as my, avg(z) as mz from {name}s), "
        f"{name}e as (select max(sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2)) as ldef from {name}s, {name}c), "
        f"{name}w as (select *, w / sum(w) over (partition by node_id) as share from (select v.node_id, s.pt_id, s.x, {weight_sql('(v.x0 - s.x) ** 2 + (v.y0 - s.y) ** 2 + (v.z0 - s.z) ** 2', 's.a')} as w from vol v, {name}s s, {name}e where zone_id >= {lo} and zone_id < {lo + 10})), "
    )


INSTANCES = FACED + f"{VOL}, " + _instance_sql("l", 0) + _instance_sql("r", 10) + "both_w as (select * from lw union all select * from rw) "


@query(INSTANCES + f"select node_id, {r8s('any_value(x0)')} as x, {r8s('any_value(y0)')} as y, {r8s('any_value(z0) + coalesce(sum(share * cast(0.1 as double) * x * x), 0)')} as z from vol left join both_w using (node_id) group by node_id")
def multi_mesh_warp(spark, sf_dir):
    return rounded(_multi_mesh(spark, sf_dir).warp(), "x", "y", "z")


@query(INSTANCES + f"select pt_id, {r8s('sum(share * y0)', 6)} as dx, {r8s('sum(share * z0)', 6)} as dy, {r8s('sum(share * (x0 + 1))', 6)} as dz from both_w join vol using (node_id) group by pt_id")
def multi_mesh_vjp(spark, sf_dir):
    return rounded(_multi_mesh(spark, sf_dir).vjp(_seeds(spark, sf_dir)), "dx", "dy", "dz", digits=6)


@query(INSTANCES + f"select node_id, {r8s('coalesce(sum(share * s.y), 0)')} as dx, {r8s('coalesce(sum(share * s.z), 0)')} as dy, {r8s('coalesce(sum(share * s.x * s.y), 0)')} as dz from vol left join both_w using (node_id) left join lattice s using (pt_id) group by node_id")
def multi_mesh_jvp(spark, sf_dir):
    return rounded(_multi_mesh(spark, sf_dir).jvp(_lattice_tangent(spark, sf_dir)), "dx", "dy", "dz")


@query(f"with {LATTICE}, {QUADS}, {CORNERS} select inst_id, node, row_number() over (partition by inst_id order by node) - 1 as local_id from (select distinct cast(least(2, face_id // 40 % 25 // 10) as int) as inst_id, node from corners)")
def multi_mesh_local_points(spark, sf_dir):
    return _multi_mesh(spark, sf_dir).local_points(_blocked_faces(spark, sf_dir))


@query(f"with {LATTICE}, {BENT} select pt_id, {r8s('x')} as x, {r8s('y')} as y, {r8s('z')} as z from bent")
def multi_mesh_surface(spark, sf_dir):
    return rounded(_multi_mesh(spark, sf_dir).coordinates(), "x", "y", "z")


@query(INSTANCES + f", m as (select node_id, any_value(zone_id) as zone_id, any_value(x0) as x, any_value(y0) as y, any_value(z0) + coalesce(sum(share * cast(0.1 as double) * x * x), 0) as z from vol left join both_w using (node_id) group by node_id) select case when zone_id < 10 then 'left' else 'right' end as instance, node_id * 3 + i as dof, {r8s('case i when 0 then x when 1 then y else z end')} as value from m, (select unnest([0, 1, 2]) as i) where zone_id < 20")
def multi_mesh_warp_grids(spark, sf_dir):
    grids, _ = _multi_mesh(spark, sf_dir).warp_grids()
    out = None
    for name, grid in grids.items():
        part = grid.select(F.lit(name).alias("instance"), "dof", r8(F.col("value")).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


# files


@query(f"with {SURF} select pt_id as node, x, y, z from surf")
def openfoam_scan(spark, sf_dir):
    case = f"{shared_dir(spark)}/case-{uuid.uuid4().hex}"
    openfoam.write_points(surf(spark, sf_dir).withColumnRenamed("pt_id", "node_id"), f"{case}/constant/polyMesh/points", single=True)
    return openfoam.read_points(spark, case).drop("part")


@query(f"with {VOL}, l as (select *, row_number() over (partition by zone_id order by node_id) - 1 as local from vol) select cast(zone_id as int) as zone_id, local, x0, y0, z0 from l")
def plot3d_roundtrip(spark, sf_dir):
    order = Window.partitionBy("zone_id").orderBy("node_id")
    v = vol(spark, sf_dir).withColumn("zone_id", F.col("zone_id").cast("int")).withColumn("local", F.row_number().over(order).cast("long") - 1)
    zones = v.groupBy("zone_id").agg(F.count(F.lit(1)).cast("int").alias("il")).withColumns({"jl": F.lit(1), "kl": F.lit(1)})
    sizes = [(r["il"], 1, 1) for r in zones.orderBy("zone_id").collect()]  # one row a zone
    written = plot3d.write_volume(v, zones).select(F.struct("zone_id", F.hex("record").alias("r")).alias("z"))
    body = written.agg(F.array_join(F.transform(F.array_sort(F.collect_list("z")), lambda z: z["r"]), "").alias("body"))
    file = body.select(F.lit("grid.xyz").alias("path"), F.unhex(F.concat(F.lit(plot3d.head(sizes).hex()), "body")).alias("content"))
    names = spark.createDataFrame([(i, int(r["zone_id"])) for i, r in enumerate(zones.orderBy("zone_id").collect())], "place int, zone int")
    return plot3d.decode(file).join(F.broadcast(names), F.col("zone_id") == F.col("place")).select(F.col("zone").alias("zone_id"), "local", "x0", "y0", "z0")

