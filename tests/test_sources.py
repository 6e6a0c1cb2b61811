import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmesh.options import WarpOptions
from driftmesh.plans.warp import Warper
from driftmesh.sources import fixtures, mesh_table, openfoam, plot3d, restart

HEAD = "/*---*\\\n| x |\n\\*---*/\nFoamFile\n{{\n    format      {kind};\n    object      {name};\n}}\n// * * //\n\n"


def poly_mesh(folder, kind="ascii"):
    folder.mkdir(parents=True)
    write = lambda name, body: (folder / name).write_text(HEAD.format(kind=kind, name=name) + body)
    write("points", "12\n(\n" + "\n".join(f"({x} {y} {z}e0)" for z in (0, 1) for y in (0, 1) for x in (0, 1, 2)) + "\n)\n\n// end\n")
    faces = [(1, 4, 10, 7), (0, 6, 9, 3), (2, 5, 11, 8), (0, 1, 7, 6), (1, 2, 8, 7)]
    write("faces", f"{len(faces)}\n(\n" + "\n".join(f"4({' '.join(map(str, f))})" for f in faces) + "\n)\n")
    write("owner", "5\n(\n0\n0\n1\n0\n1\n)\n")
    write("neighbour", "1\n(\n1\n)\n")
    write("boundary", "3\n(\n    slip\n    {\n        type            patch;\n        nFaces          2;\n        startFace       1;\n    }\n    sides\n    {\n        type symmetry;\n        inGroups 1(symmetry);\n        nFaces 2;\n        startFace 3;\n    }\n    none\n    {\n        type wall;\n        nFaces 0;\n        startFace 5;\n    }\n)\n")


def test_poly_mesh_in_parts(spark, tmp_path):
    for k in (0, 1):
        poly_mesh(tmp_path / f"processor{k}" / "constant" / "polyMesh")
    case = str(tmp_path)
    p = openfoam.read_points(spark, case)
    assert p.count() == 24 and p.filter("part = 1 and node = 5").first()[2:] == (2.0, 1.0, 0.0)
    f, b = openfoam.read_faces(spark, case), openfoam.read_boundary(spark, case)
    assert f.filter("part = 0 and face = 2").first().nodes == [2, 5, 11, 8]
    assert {(r.name, r.bc_type, r.n_faces, r.start_face) for r in b.filter("part = 0").collect()} == {("slip", "patch", 2, 1), ("sides", "symmetry", 2, 3), ("none", "wall", 0, 5)}
    assert sorted((r.part, r.face) for r in openfoam.surface_faces(f, b).collect()) == [(0, 1), (0, 2), (1, 1), (1, 2)]
    cells = openfoam.read_cells(spark, case)
    assert [(r.owner, r.neighbour) for r in cells.filter("part = 0").orderBy("face").collect()] == [(0, 1), (0, None), (1, None), (0, None), (1, None)]
    out = tmp_path / "tec"
    openfoam.write_tecplot(p.filter("part = 0"), f.filter("part = 0"), cells.filter("part = 0"), str(out))
    lines = "".join(x.read_text() for x in sorted(out.glob("part-*"))).splitlines()
    assert lines[5] == "NODES=12" and len(lines) == 11 + 36 + 5 + 5 + 5 + 5 and lines[-5:] == ["2", "0", "0", "0", "0"] and lines[11:14] == ["0", "1", "2"]


def test_single_case_and_points_round_trip(spark, tmp_path):
    poly_mesh(tmp_path / "case" / "constant" / "polyMesh")
    p = openfoam.read_points(spark, str(tmp_path / "case"))
    nodes = p.select(F.col("node").alias("node_id"), (F.col("x") / 3).alias("x"), "y", "z")
    openfoam.write_points(nodes, str(tmp_path / "out"))
    text = "".join(x.read_text() for x in sorted((tmp_path / "out").glob("part-*")))
    (tmp_path / "again" / "constant" / "polyMesh").mkdir(parents=True)
    (tmp_path / "again" / "constant" / "polyMesh" / "points").write_text(text)
    again = openfoam.read_points(spark, str(tmp_path / "again")).orderBy("node").toPandas()
    assert (again[["x", "y", "z"]].to_numpy() == nodes.orderBy("node_id").toPandas()[["x", "y", "z"]].to_numpy()).all()


def test_binary_case_raises(spark, tmp_path):
    poly_mesh(tmp_path / "constant" / "polyMesh", "binary")
    with pytest.raises(Exception, match="binary file"):
        openfoam.read_points(spark, str(tmp_path)).collect()


def test_plot3d_round_trip(spark, tmp_path):
    sizes = [(2, 3, 2), (1, 2, 2)]
    rng = np.random.default_rng(2)
    blocks = [rng.normal(size=(3, int(np.prod(s)))) for s in sizes]
    raw = plot3d.head(sizes) + b"".join(plot3d.record(b.tobytes()) for b in blocks)
    (tmp_path / "a.xyz").write_bytes(raw)
    v = plot3d.read_volume(spark, str(tmp_path / "a.xyz"))
    t = v.orderBy("node_id").toPandas()
    assert len(t) == 16 and np.allclose(t[["x0", "y0", "z0"]].to_numpy().T, np.concatenate(blocks, axis=1)) and t.node_id.tolist() == list(range(16))
    plot3d.save(v, v.select("zone_id", "il", "jl", "kl").distinct(), str(tmp_path / "b.xyz"))
    assert (tmp_path / "b.xyz").read_bytes() == raw
    (tmp_path / "c.xyz").write_bytes(raw[:-3] + b"abc")
    with pytest.raises(Exception, match="broken record"):
        plot3d.read_volume(spark, str(tmp_path / "c.xyz")).collect()
    assert plot3d.zone_name(0) == "Domain.    1"


def test_plot3d_surface(spark, tmp_path):
    pts = np.array([[i, j, 0.0] for j in range(3) for i in range(4)]).T
    (tmp_path / "s.xyz").write_bytes(plot3d.head([(4, 3)]) + plot3d.record(np.ascontiguousarray(pts).tobytes()))
    p, f = plot3d.read_surface(spark, str(tmp_path / "s.xyz"))
    assert p.count() == 12 and f.count() == 6 and f.orderBy("face_id").first().nodes == [0, 1, 5, 4]
    w = Warper(p, f, WarpOptions(eval_mode="exact"))
    assert np.isclose(w.surface.area.sum(), 6.0, atol=1e-6)
    again = Warper.from_plot3d(spark, str(tmp_path / "s.xyz"), WarpOptions(bucket_size=2))
    openfoam.write_tree_centres(again.tree_frame(), str(tmp_path / "tree"))
    lines = "".join(x.read_text() for x in sorted((tmp_path / "tree").glob("part-*"))).splitlines()
    assert lines[1] == 'Zone T="level0" I=1' and lines[2] == "1.5 1 0"


def test_native_tables_and_stub(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0)], "node_id long, zone_id int, x0 double, y0 double, z0 double")
    mesh_table.write_mesh(str(tmp_path / "m"), by_zone=True, volume=df)
    assert mesh_table.read_mesh(spark, str(tmp_path / "m"), "volume").count() == 1
    with pytest.raises(ValueError):
        mesh_table.write_mesh(str(tmp_path / "n"), nosuch=df)


def test_restart_cache_is_used_verified_and_rebuilt(spark, tmp_path):
    p = spark.createDataFrame([(k, k % 5 / 5, k // 5 / 5, 0.0) for k in range(25)], "pt_id long, x double, y double, z double")
    v = spark.createDataFrame([(k, 0.1 * k, 0.3, 1.0) for k in range(40)], "node_id long, x0 double, y0 double, z0 double")
    w = Warper.from_areas(p)
    path = str(tmp_path / "cache")
    first = restart.cached_costs(w, v, path, stride=10).orderBy("node_id").toPandas()
    assert restart.cached_costs(w, v, path, stride=10).orderBy("node_id").toPandas().equals(first)
    place = f"{path}/{restart.fingerprint(w, v)}"
    spark.createDataFrame(first.assign(denominator=first.denominator * 2)).write.mode("overwrite").parquet(place)
    assert np.allclose(restart.cached_costs(w, v, path, stride=10).orderBy("node_id").toPandas().denominator, first.denominator)


def test_solver_json(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"meshInd": [4, 5, 4],\n "pts": [[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0.5]],\n "conn": [0, 1, 3, 0, 3, 2], "faceSizes": [3, 3], "cgnsBlockIDs": [7, 8]}')
    got = fixtures.read_solver_json(spark, str(tmp_path / "s.json"))
    assert [tuple(r) for r in got["solver_map"].orderBy("solver_dof").collect()] == [(0, 4), (1, 5), (2, 4)]
    assert [tuple(r) for r in got["faces"].orderBy("face_id").collect()] == [(0, 7, [0, 1, 3]), (1, 8, [0, 3, 2])]
    assert got["points"].filter("pt_id = 3").first()[1:] == (1.0, 1.0, 0.5)
