"""Properties of the warp that need no golden data, and the relational operators on small tables."""

import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftmesh.operators import idw, multi, neighbors, patches, points, symmetry, transfer
from driftmesh.options import WarpOptions
from driftmesh.plans import kernels as K
from driftmesh.plans import warp
from driftmesh.plans.warp import SurfaceTooLarge, Warper, blocked_warp

N = 8


@pytest.fixture(scope="module")
def mesh(spark):
    pts = [(j * N + i, i, j, i / (N - 1), j / (N - 1), 0.1 * (i * j) / N**2) for j in range(N) for i in range(N)]
    p = spark.createDataFrame(pts, "pt_id long, i long, j long, x double, y double, z double").cache()
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(rng.uniform(-1, 2, (90, 3)))], "node_id long, x0 double, y0 double, z0 double").cache()
    return p, points.lattice_quads(p).cache(), v


def out(df, cols=("x", "y", "z"), key="node_id"):
    t = df.toPandas().sort_values(key)
    return t[list(cols)].to_numpy()


def start(v):
    return out(v, ("x0", "y0", "z0"))


@pytest.mark.parametrize("mode", ["exact", "fast"])
def test_identity_and_translation(mesh, mode):
    p, f, v = mesh
    w = Warper(p, f, WarpOptions(eval_mode=mode))
    assert np.allclose(out(w.warp(v, lambda d: d)), start(v), atol=1e-12)
    assert np.allclose(out(w.warp(v, lambda d: d.withColumn("y", F.col("y") + 0.3))), start(v) + [0, 0.3, 0], atol=1e-9)


def test_interpolation_symmetry_and_convexity(spark, mesh):
    p, f, _ = mesh
    w = Warper(p, f, WarpOptions(eval_mode="exact", use_rotations=False))
    bend = lambda d: d.withColumn("z", F.col("z") + 0.2 * F.col("x"))
    near = p.select(F.col("pt_id").alias("node_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("z").alias("z0"))
    assert np.allclose(out(w.warp(near, bend)), out(bend(p), key="pt_id"), atol=1e-9)
    plane = (((0.0, 0.0, 0.0), (0.0, 0.0, 1.0)),)
    on = spark.createDataFrame([(k, 0.1 * k, 0.5, 0.0) for k in range(5)], "node_id long, x0 double, y0 double, z0 double")
    assert np.allclose(out(Warper(p, f, w.options, planes=plane).warp(on, bend))[:, 2], 0, atol=1e-12)
    moved = out(w.warp(mesh[2], bend)) - start(mesh[2])
    assert moved[:, 2].min() >= -1e-12 and moved[:, 2].max() <= 0.2 + 1e-12 and np.allclose(moved[:, :2], 0)


def test_partitions_do_not_matter_and_blocks_agree(spark, mesh):
    p, f, v = mesh
    w = Warper(p, f, WarpOptions(eval_mode="exact"))
    bend = lambda d: d.withColumn("z", F.col("z") + 0.2 * F.col("x") * F.col("x"))
    one, many = out(w.warp(v.coalesce(1), bend)), out(w.warp(v.repartition(16), bend))
    assert np.allclose(one, many, atol=1e-12)
    m, b = w.surface.motion(w._positions(bend))
    rows = [(k, *map(float, x), float(a), *map(float, mm.ravel()), *map(float, bb)) for k, (x, a, mm, bb) in enumerate(zip(w.surface.xu0, w.surface.area, m, b))]
    names = ["u_id", "x0", "y0", "z0", "a", *[f"m{i}{j}" for i in "123" for j in "123"], "b1", "b2", "b3"]
    surface = spark.createDataFrame(rows, names)
    assert np.allclose(out(blocked_warp(v, surface, w.weights.ldef, w.options, block_rows=20)), one, atol=1e-10)


def test_declarative_form_agrees(spark, mesh):
    p, _, v = mesh
    o = WarpOptions(eval_mode="exact", use_rotations=False)
    planes = (((0.0, 0.0, 0.0), (0.0, 0.0, 1.0)),)
    w = Warper.from_areas(p, options=o, planes=planes)
    s = p.select("x", "y", "z", F.lit(1.0).alias("a"), (0.1 * F.col("y")).alias("dx"), F.lit(0.0).alias("dy"), (0.2 * F.col("x")).alias("dz"))
    want = out(w.warp(v, p.select("pt_id", (F.col("x") + 0.1 * F.col("y")).alias("x"), "y", (F.col("z") + 0.2 * F.col("x")).alias("z"))))
    assert np.allclose(out(idw.exact_warp_join(v, s, w.weights.ldef, planes=planes)), want, atol=1e-10)


@pytest.mark.parametrize("mode", ["exact", "fast"])
@pytest.mark.parametrize("rotations", [True, False])
def test_products_are_adjoint_and_match_differences(spark, mesh, mode, rotations):
    p, f, v = mesh
    planes = (((0.0, 0.0, 0.0), (0.0, 0.0, 1.0)),)
    w = Warper(p, f, WarpOptions(eval_mode=mode, use_rotations=rotations), planes=planes)
    deform = p.select("pt_id", "x", "y", (F.col("z") + 0.15 * F.col("x") * F.col("x")).alias("z"))
    tangent = p.select("pt_id", (F.col("y") * 0.3).alias("dx"), (F.col("x") * F.col("x")).alias("dy"), F.col("x").alias("dz"))
    seeds = v.select("node_id", F.sin("x0").alias("vx"), F.cos("y0").alias("vy"), F.col("z0").alias("vz"))
    j, back = out(w.jvp(v, deform, tangent), ("dx", "dy", "dz")), out(w.vjp(v, deform, seeds), ("dx", "dy", "dz"), "pt_id")
    left = (j * out(seeds, ("vx", "vy", "vz"))).sum()
    assert np.isclose(left, (back * out(tangent, ("dx", "dy", "dz"), "pt_id")).sum(), rtol=1e-9)
    h = 1e-6
    step = lambda s: out(w.warp(v, deform.join(tangent, "pt_id").select("pt_id", *[(F.col(c) + s * F.col(f"d{c}")).alias(c) for c in "xyz"])))
    assert np.allclose((step(h) - step(-h)) / (2 * h), j, atol=1e-5)
    assert np.allclose(out(w.complex_step(v, deform, tangent), ("dx", "dy", "dz")), j, atol=1e-9)


def test_fast_is_close_to_exact_and_verify(spark, mesh):
    p, f, v = mesh
    bend = p.select("pt_id", "x", "y", (F.col("z") + 0.15 * F.col("x") * F.col("x")).alias("z"))
    exact = out(Warper(p, f, WarpOptions(eval_mode="exact")).warp(v, bend)) - start(v)
    fast = out(Warper(p, f, WarpOptions(err_tol=5e-5)).warp(v, bend)) - start(v)
    assert np.median(np.linalg.norm(fast - exact, axis=1) / np.linalg.norm(exact, axis=1)) < 0.05
    seeds = v.select("node_id", F.sin("x0").alias("vx"), F.cos("y0").alias("vy"), F.col("z0").alias("vz"))
    table = Warper(p, f, WarpOptions(eval_mode="exact")).verify(v, bend, seeds, 3, 6).toPandas()
    assert table.err_pct.abs().max() < 1e-2 and table.dof.tolist() == [3, 4, 5]


def test_size_check_and_bad_input(spark, mesh):
    p, f, v = mesh
    with pytest.raises(SurfaceTooLarge):
        Warper(p, f, most_surface=10)
    with pytest.raises(ValueError):
        Warper(p, f).warp(v, p.filter("pt_id > 3"))
    with pytest.raises(ValueError):
        WarpOptions(eval_mode="quick")
    assert WarpOptions.of({"aExp": 4, "EVALMODE": "Exact", "symmetryPlanes": [[[0, 0, 0], [0, 0, 1]]]}).eval_mode == "exact"
    with pytest.raises(ValueError):
        WarpOptions.of({"nosuch": 1})


def test_many_deformations_agree_with_single_ones(mesh):
    p, f, v = mesh
    w = Warper(p, f, WarpOptions(eval_mode="exact", use_rotations=False))
    cases = {k: p.select("pt_id", (F.col("x") + float(k) * F.col("y")).alias("x"), "y", "z") for k in ("0.1", "0.2")}
    both = w.warp_many(v, cases).toPandas()
    for k, d in cases.items():
        assert np.allclose(both[both["case"] == k].sort_values("node_id")[["x", "y", "z"]].to_numpy(), out(w.warp(v, d)), atol=1e-12)


def test_components_leave_the_background(spark, mesh):
    p, f, v = mesh
    vol = v.withColumn("instance", F.when(F.col("node_id") < 30, "A").when(F.col("node_id") < 60, "b "))
    up = lambda d: d.withColumn("z", F.col("z") + 1.0)
    m = multi.MultiWarper([multi.Component("a", Warper(p, f), up), multi.Component("B", Warper(p, f), lambda d: d)])
    moved = out(m.warp(vol)) - start(v)
    assert np.allclose(moved[:30], [0, 0, 1]) and np.allclose(moved[30:], 0)
    assert np.allclose(out(m.solver_grid(vol)), out(m.warp(vol)))
    tangent = p.select("pt_id", F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))
    j = out(m.jvp(vol, {"a": tangent}), ("dx", "dy", "dz"))
    assert np.allclose(j[:30], [1, 0, 0]) and np.allclose(j[30:], 0)
    seeds = v.select("node_id", F.lit(1.0).alias("vx"), F.lit(0.0).alias("vy"), F.lit(0.0).alias("vz"))
    assert np.isclose(m.vjp(vol, seeds).agg(F.sum("dx")).first()[0], 60)


def test_neighbours_with_few_points_and_none(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 50.0, 0.0, 0.0)], "pt_id long, x double, y double, z double")
    q = neighbors.with_ids(p)
    got = {(r.q_id, r.rank): (r.pt_id, r.d2) for r in neighbors.knn(q, p, 2).collect()}
    assert got[(1, 1)] == (1, 0.0) and got[(1, 2)] == (2, 0.0) and got[(3, 2)] == (1, 49.0**2) and len(got) == 8
    assert neighbors.knn(q, p, 9).count() == 16
    assert neighbors.knn(q, p.filter("pt_id > 9"), 2).count() == 0
    assert {r.q_id: r.n for r in neighbors.r_count(q, p, 1.0).collect()} == {0: 3, 1: 3, 2: 3, 3: 1}
    assert {r.q_id: r.found for r in neighbors.point_in_tree(q, p.filter("pt_id = 3")).collect()} == {0: 0, 1: 0, 2: 0, 3: 4}


def test_running_sums_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    got = points.running(df, ["a", "b"], F.col("b"), "s", buckets=13).toPandas().sort_values(["a", "b"])
    assert (got.s.to_numpy() == got.b.cumsum().to_numpy()).all()
    assert points.running(df.filter("b < 0"), ["a", "b"], F.col("b"), "s").count() == 0


def test_patch_selection_and_errors(spark):
    b = spark.createDataFrame([(0, " Wing ", "BCWall"), (1, None, "BCFarfield"), (2, "sym1", "BCSymmetryPlane")], "patch_id int, family string, bc_type string")
    wanted = spark.createDataFrame([("WING",), ("tail",)], "name string")
    assert [r.patch_id for r in patches.family_select(b, wanted).collect()] == [0]
    assert [r.patch_id for r in patches.family_select(b, None).collect()] == [0]
    assert patches.check_selection(b, wanted) == ["tail"]
    f = spark.createDataFrame([(0, 0, [1, 2, 3]), (1, 1, [2, 3, 4])], "face_id long, patch_id int, nodes array<long>")
    assert [r.face_id for r in patches.select_surface(f, b).collect()] == [0]
    with pytest.raises(ValueError):
        patches.check_selection(b, wanted.filter("name = 'tail'"))
    assert {r.patch_id: r.family for r in patches.default_family(b).collect()} == {0: " Wing ", 1: "far", 2: "sym1"}
    with pytest.raises(Exception, match="no negative"):
        patches.require(b, F.col("patch_id") > 0, "no negative").collect()


def test_symmetry_planes_from_patches(spark):
    pts = spark.createDataFrame([(10 * k + i, float(np.cos(i)), float(np.sin(i)) * (-1) ** k, 2.0) for k in (0, 1) for i in range(6)], "pt_id long, x double, y double, z double")
    faces = spark.createDataFrame([(k, k, [10 * k + i for i in range(6)]) for k in (0, 1)], "face_id long, patch_id int, nodes array<long>")
    b = spark.createDataFrame([(0, "s", "BCSymmetryPlane"), (1, "s", "BCSymmetryPlane")], "patch_id int, family string, bc_type string")
    planes = symmetry.derive_planes(b, faces, pts)
    assert len(planes) == 1 and np.allclose(np.abs(planes[0][1]), [0, 0, 1]) and np.allclose(planes[0][0], [0, 0, 2])
    with pytest.raises(ValueError):
        symmetry.derive_planes(b, faces, pts, structured=False)


def test_intervals_of_any_length_and_parts_with_gaps(spark):
    lengths = [1, 2, 3, 4, 5, 7, 8, 1000, 10**12]
    cut = [(k, 5 * k, 5 * k + n) for k, n in enumerate(lengths)] + [(99, 7, 7)]
    keys = sorted({x for _, lo, hi in cut for x in (lo - 1, lo, hi - 1, hi)} | {10**11})
    got = patches.interval_join(spark.createDataFrame([(x,) for x in keys], "key long"), "key", spark.createDataFrame(cut, "id int, lo long, hi long"), "lo", "hi")
    assert sorted((r.key, r.id) for r in got.collect()) == sorted((x, k) for x in keys for k, lo, hi in cut if lo <= x < hi)
    bins = spark.createDataFrame([(0, 0), (1, 0), (1_000_000, 0), (1_000_001, 1), (10**12, 1), (10**13, 0)], "node_id long, part_id int")
    for buckets in (1, 3, 64):
        assert sorted(tuple(r) for r in transfer.bin_changes(bins, buckets).collect()) == [(0, 0), (1_000_001, 1), (10**13, 0)]


def test_merging_near_and_far_from_the_origin(spark):
    from driftmesh.plans.nodal import merge_points

    near = np.array([[1.05, 1.05, 1.05], [1.95, 1.95, 1.05], [1.05, 1.05, 1.55]])
    reps, link = merge_points(near, 1.0)
    assert reps.tolist() == [0, 1] and link[0] == link[2] != link[1]
    far = [(k, 3e7 + k // 2, -5e8, 1e-9 * (k // 2)) for k in range(40)]
    got = {r.pt_id: r.rep_id for r in points.point_merge(spark.createDataFrame(far, "pt_id long, x double, y double, z double")).collect()}
    assert got == {k: k - k % 2 for k in range(40)}


def test_multi_mesh_in_order_and_written_by_instance(spark, mesh, tmp_path):
    from driftmesh.sources import mesh_table

    p, f, v = mesh
    zoned = v.withColumn("zone_id", (F.col("node_id") % 3).cast("int"))
    instances = spark.createDataFrame([(0, "A", 0, 1), (1, "b ", 1, 2)], "inst_id int, name string, block_lo int, block_hi int")
    faces = f.withColumn("block_id", F.lit(0))
    m = multi.MultiMesh(zoned, instances, {"a": WarpOptions(eval_mode="exact", use_rotations=False)})
    with pytest.raises(NameError):
        m.set_surface(p, faces)
    m.set_external_indices(spark.range(9).select(F.col("id").alias("solver_dof"), F.col("id").alias("common_dof")))
    m.set_surface(p, faces)
    m.set_coordinates(p.withColumn("z", F.col("z") + 0.5))
    moved = m.warp()
    d = out(moved) - start(v)
    zone = zoned.toPandas().sort_values("node_id").zone_id.to_numpy()
    assert np.allclose(d[zone == 0], [0, 0, 0.5]) and np.allclose(d[zone != 0], 0)
    grids, dofs = m.warp_grids()
    assert list(grids) == ["a"] and grids["a"].count() == dofs == 3 * int((zone == 0).sum())
    assert m.solver_grid().count() == 9
    mesh_table.write_moved(zoned, moved, instances, f"{tmp_path}/w")
    assert {x.name for x in tmp_path.glob("w/instance=*")} == {"instance=A", "instance=b%20", "instance=background"} or {r.instance.strip() for r in spark.read.parquet(f"{tmp_path}/w").select("instance").distinct().collect()} == {"A", "b", "background"}
    with pytest.raises(ValueError, match="no instance"):
        multi.MultiMesh(zoned, instances, {"c": WarpOptions()})


def test_dofs_round_trip_and_scatter(spark):
    n = spark.createDataFrame([(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)], "node_id long, x double, y double, z double")
    assert out(transfer.unflatten(transfer.flatten(n))).tolist() == [[1, 2, 3], [4, 5, 6]]
    m = spark.createDataFrame([(0, 5), (1, 5), (2, 6)], "solver_dof long, common_dof long")
    got = transfer.solver_to_warp(m, spark.createDataFrame([(0, 1.0), (1, 2.0)], "solver_dof long, value double"), spark.createDataFrame([(5,), (6,), (7,)], "common_dof long"))
    assert {r.common_dof: r.value for r in got.collect()} == {5: 3.0, 6: 0.0, 7: 0.0}


def test_errors_of_a_large_tree_are_dealt_over_tasks(spark, monkeypatch):
    from driftmesh.plans import catalogue, warp

    one = catalogue._lattice_warper(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(warp, "SMALL_TREE", 0)
    many = catalogue._lattice_warper(spark, "/root/testdata/sf0.001")
    assert not many.tree.err.any()  # sizes of nodes need none
    sizes = {(r.level, r.n) for r in many.tree_sizes().collect()}
    assert not many.tree.err.any() and sizes == {(r.level, r.n) for r in one.tree_frame().select("level", "n").collect()}
    many.tree_frame()
    assert many.tree.err.any() and np.allclose(many.tree.err, one.tree.err, rtol=1e-12)


def test_verify_takes_all_steps_from_one_pass(spark, mesh, monkeypatch):
    from driftmesh.plans import warp as module

    p, f, v = mesh
    bend = p.select("pt_id", "x", "y", (F.col("z") + 0.15 * F.col("x") * F.col("x")).alias("z"))
    seeds = v.select("node_id", F.sin("x0").alias("vx"), F.cos("y0").alias("vy"), F.col("z0").alias("vz"))
    passes, plain = [], Warper._evaluator
    monkeypatch.setattr(Warper, "_evaluator", lambda *a: passes.append(1) or plain(*a))
    for options in ({"eval_mode": "exact"}, {"eval_mode": "exact", "use_rotations": False}, {"err_tol": 5e-5}):
        w = Warper(p, f, WarpOptions(**options), planes=(((0.0, 0.0, 0.0), (0.0, 0.0, 1.0)),))
        tables = []
        for most, want in ((1 << 24, 1), (1, 6)):
            monkeypatch.setattr(module, "MOST_COLUMN_VALUES", most)
            passes.clear()
            tables.append(w.verify(v, bend, seeds, 3, 6).toPandas())
            assert len(passes) == want and tables[-1].err_pct.abs().max() < 1e-2
        assert np.allclose(tables[0][["ad", "fd"]], tables[1][["ad", "fd"]], rtol=1e-6)
    assert w.verify(v, bend, seeds, 3, 3).count() == 0


def test_fast_warp_with_large_leaves_is_that_of_small_ones(mesh, monkeypatch):
    p, f, v = mesh
    w = Warper(p, f, WarpOptions(bucket_size=N * N // 2, err_tol=1e-9))
    columns = w._motion_columns(w._positions(lambda df: df.withColumn("z", F.col("z") + 0.1 * F.col("x") * F.col("x"))))
    r = start(v)
    plain = w._evaluator(columns, True)(r)
    monkeypatch.setattr(K, "MANY", N)
    monkeypatch.setattr(K, "CLUSTER", 4)
    sizes, sums = [], K.Clusters.sums
    monkeypatch.setattr(K.Clusters, "sums", lambda self, r: sizes.append(len(self.x)) or sums(self, r))
    for got, known in zip(w._evaluator(columns, True)(r), plain):
        np.testing.assert_allclose(got, known, rtol=1e-11, atol=1e-12)
    assert sizes == [N * N // 2] * 4  # both leaves went that way, for the estimate and for the sums


def test_batches_are_gathered(monkeypatch):
    monkeypatch.setattr(warp, "GATHERED", 10)
    parts = [pa.record_batch({"a": pa.array(range(k, k + n), pa.int64())}) for k, n in ((0, 4), (4, 7), (11, 0), (11, 25), (36, 1))]
    got = list(warp.gathered(iter(parts)))
    assert [b.num_rows for b in got] == [11, 25, 1]
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(37))
    assert list(warp.gathered(iter([]))) == []


def test_faces_are_worked_out_once_and_keep_their_nodes(spark, tmp_path):
    def seen(batches):
        for batch in batches:
            (tmp_path / uuid.uuid4().hex).write_text(str(batch.num_rows))
            yield batch

    points = spark.createDataFrame([(10, 0.0, 0.0, 0.0), (7, 1.0, 0.0, 0.0), (30, 1.0, 1.0, 0.0), (4, 0.0, 1.0, 0.0), (90, 2.0, 0.5, 0.0)], "pt_id long, x double, y double, z double")
    rows = [(2, [7, 90, 30]), (1, [10, 7, 30, 4])]
    faces = spark.createDataFrame(rows, "face_id long, nodes array<int>").mapInArrow(seen, "face_id long, nodes array<int>")
    s = Warper(points, faces, WarpOptions(use_rotations=False)).surface
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 2
    ids = np.array([4, 7, 10, 30, 90])[s.rep]
    assert [ids[s.faces.conn[a:b]].tolist() for a, b in zip(s.faces.ptr, s.faces.ptr[1:])] == [[10, 7, 30, 4], [7, 90, 30]]
    with pytest.raises(KeyError):
        Warper(points, spark.createDataFrame([(1, [10, 7, 31])], "face_id long, nodes array<long>"))


@pytest.mark.parametrize("turns", [True, False])
def test_exact_mode_of_a_large_surface_goes_by_clusters(mesh, monkeypatch, turns):
    """Warp, derivatives and tables that do not go into plans, against those of a small surface."""
    p, f, v = mesh
    bend = lambda df: df.withColumn("z", F.col("z") + 0.1 * F.col("x") * F.col("x"))
    tangent = p.select("pt_id", F.col("y").alias("dx"), F.col("z").alias("dy"), (F.col("x") * 2).alias("dz"))
    seeds = v.select("node_id", F.col("y0").alias("vx"), F.col("z0").alias("vy"), (F.col("x0") + 1).alias("vz"))

    def results():
        w = Warper(p, f, WarpOptions(eval_mode="exact", use_rotations=turns), planes=(((0, 0, 0), (0, 0, 1)),))
        d = ("dx", "dy", "dz")
        return w, [out(w.warp(v, bend)), out(w.jvp(v, bend, tangent), d), out(w.complex_step(v, bend, tangent), d), out(w.vjp(v, bend, seeds), d, "pt_id"), out(w.denominators(v), ("denominator",))]

    w, plain = results()
    assert w.clusters is None
    for module, name, value in ((K, "MANY", N), (K, "CLUSTER", 4), (warp, "PLAN_ROWS", 10), (warp, "SUMS_ROW", 7)):
        monkeypatch.setattr(module, name, value)
    w, found = results()
    assert w.clusters is not None and "tree" not in vars(w)  # whose building an exact sum does not need
    for got, known in zip(found, plain):
        np.testing.assert_allclose(got, known, rtol=1e-9, atol=1e-11)


def test_a_large_join_is_summed_and_keeps_all_rows_of_a_place(mesh, monkeypatch):
    p, _, v = mesh
    planes = (((0.0, 0.0, 0.0), (0.0, 0.0, 1.0)),)
    s = p.select("x", "y", "z", (F.col("x") + 0.5).alias("a"), (0.1 * F.col("y")).alias("dx"), F.lit(0.0).alias("dy"), (0.2 * F.col("x")).alias("dz"))
    s = s.union(s.filter("x > 0.5").withColumn("dx", F.col("dx") + 1))
    joined = idw.exact_warp_join(v, s, 1.2, planes=planes)
    monkeypatch.setattr(idw, "JOINED_ROWS", 10)
    summed = idw.exact_warp_join(v, s, 1.2, planes=planes)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan(joined) and "Join" not in plan(summed)
    np.testing.assert_allclose(out(summed), out(joined), atol=1e-11)
