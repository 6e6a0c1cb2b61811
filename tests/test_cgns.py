"""CGNS files of our own making: structured, unstructured, groups of every storage, and the way back."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmesh.options import WarpOptions
from driftmesh.plans.mesh import Mesh
from driftmesh.sources import cgns, hdf5


def node(label, data=None, **children):
    if isinstance(data, str):
        data = np.frombuffer(data.encode(), np.int8)
    text = lambda v: np.array(v.encode(), "S33")
    return hdf5.Group({"label": text(label), "type": np.array(b"R8", "S3"), "flags": np.array([1], "<i4")}, children, {} if data is None else {" data": np.asarray(data)})


def grid(xyz, shape):
    return node("GridCoordinates_t", **{f"Coordinate{c}": node("DataArray_t", xyz[:, i].reshape(shape)) for i, c in enumerate("XYZ")})


def condition(kind, family=None, **where):
    names = {} if family is None else {"FamilyName": node("FamilyName_t", family)}
    return node("BC_t", kind, **names, **where)


def lattice(il, jl, kl, shift=0.0):
    k, j, i = np.meshgrid(np.arange(kl), np.arange(jl), np.arange(il), indexing="ij")
    return np.stack([i.ravel() / 4 + shift, j.ravel() / 4, k.ravel() / 2], axis=1).astype(float)


def structured_file(tables, zones=2):
    made = {}
    for z in range(zones):
        il, jl, kl = 5 + z, 4, 3
        sizes = np.array([[il, jl, kl], [il - 1, jl - 1, kl - 1], [0, 0, 0]], "<i4")
        span = lambda lo, hi: node("IndexRange_t", np.array([lo, hi], "<i4"))
        made[f"Zone{z:02d}"] = node(
            "Zone_t", sizes, ZoneType=node("ZoneType_t", "Structured"), GridCoordinates=grid(lattice(il, jl, kl, 10.0 * z), (kl, jl, il)),
            ZoneBC=node("ZoneBC_t", wall=condition("BCWallViscous", "Wing", PointRange=span([1, 1, 1], [il, jl, 1])), zmax=condition("BCFarfield", PointRange=span([1, 1, kl], [il, jl, kl])), sym=condition("BCSymmetryPlane", PointRange=span([1, 1, 1], [il, 1, kl]))),
        )
    return hdf5.encode(hdf5.Group(groups={"CGNSLibraryVersion": node("CGNSLibraryVersion_t", np.array([3.1], "<f4")), "Base": node("CGNSBase_t", np.array([3, 3], "<i4"), **made)}), tables)


def unstructured_file():
    xyz = lattice(3, 3, 2)
    mixed = np.array([7, 1, 2, 5, 4, 5, 2, 3, 6, 5, 2, 6, 5, 7, 4, 5, 8, 7], "<i4")
    sections = {
        "Skin": node("Elements_t", np.array([20, 0], "<i4"), ElementRange=node("IndexRange_t", np.array([1, 4], "<i4")), ElementConnectivity=node("DataArray_t", mixed)),
        "Solid": node("Elements_t", np.array([10, 0], "<i4"), ElementRange=node("IndexRange_t", np.array([5, 6], "<i4")), ElementConnectivity=node("DataArray_t", np.array([1, 2, 4, 10, 2, 3, 5, 11], "<i4"))),
    }
    lists = {"wall": condition("BCWall", "Body", ElementList=node("IndexArray_t", np.array([1, 2, 5], "<i4"))), "rest": condition("BCFarfield", ElementRange=node("IndexRange_t", np.array([3, 4], "<i4")))}
    zone = node("Zone_t", np.array([[18], [2], [0]], "<i4"), ZoneType=node("ZoneType_t", "Unstructured"), GridCoordinates=grid(xyz, (18,)), ZoneBC=node("ZoneBC_t", **lists), **sections)
    return hdf5.encode(hdf5.Group(groups={"Base": node("CGNSBase_t", np.array([3, 3], "<i4"), Zone=zone)})), xyz


@pytest.mark.parametrize("tables", [False, True])
def test_structured_file_to_warped_grid_and_back(spark, tmp_path, tables):
    content = structured_file(tables)
    (tmp_path / "m.cgns").write_bytes(content)
    options = WarpOptions(grid_file=str(tmp_path / "m.cgns"), eval_mode="exact", use_rotations=False)
    mesh = Mesh.read(spark, options)
    got = mesh.volume.orderBy("node_id").toPandas()
    want = np.concatenate([lattice(5, 4, 3), lattice(6, 4, 3, 10.0)])
    assert np.array_equal(got[["x0", "y0", "z0"]].to_numpy(), want) and got.zone_id.tolist() == [0] * 60 + [1] * 72
    names = {(r.family, r.bc_type) for r in mesh.patches.collect()}
    assert names == {("Wing", "BCWallViscous"), ("far", "BCFarfield"), ("sym", "BCSymmetryPlane")}
    first = mesh.surface().orderBy("face_id").first()
    assert first.nodes == [0, 1, 6, 5] and mesh.surface().count() == 4 * 3 + 5 * 3
    ((point, normal),) = mesh.planes()
    assert np.allclose(point, 0) and np.allclose(np.abs(normal), [0, 1, 0])
    warper = mesh.warper()
    moved = warper.warp(mesh.volume, lambda d: d.withColumn("z", F.col("z") + 0.25))
    assert np.allclose(moved.orderBy("node_id").toPandas()[["x", "y", "z"]].to_numpy(), want + [0, 0, 0.25])
    files = spark.read.format("binaryFile").load(options.grid_file)
    cgns.save(cgns.overwrite(files, moved), f"file://{tmp_path}/out.cgns")
    again = (tmp_path / "out.cgns").read_bytes()
    assert len(again) == len(content) and cgns.with_coordinates(again, want) == content
    back = Mesh.cgns(spark, str(tmp_path / "out.cgns"), options).volume.orderBy("node_id").toPandas()
    assert np.allclose(back[["x0", "y0", "z0"]].to_numpy(), want + [0, 0, 0.25])
    solver = spark.range(10).select(F.col("id").alias("solver_dof"), (F.col("id") * 3 + 2).alias("common_dof"))
    assert {round(r.value, 9) for r in mesh.set_external_indices(solver).solver_grid(moved).collect()} == {0.25}
    with pytest.raises(ValueError, match="external"):
        mesh.solver_grid()


def test_unstructured_file(spark, tmp_path):
    content, xyz = unstructured_file()
    (tmp_path / "u.cgns").write_bytes(content)
    mesh = Mesh.cgns(spark, str(tmp_path / "u.cgns"), WarpOptions(symmetry_planes=(), specified_surfaces=("body",)))
    faces = {r.face_id: (r.patch_id, r.nodes) for r in mesh.faces.collect()}
    assert sorted(faces.values()) == [(0, [1, 5, 4]), (0, [3, 4, 7, 6]), (1, [0, 1, 4, 3]), (1, [1, 2, 5])]  # rest, then wall; element 5 is solid
    assert sorted(r.nodes for r in mesh.surface().collect()) == [[0, 1, 4, 3], [1, 2, 5]]
    assert np.allclose(mesh.volume.orderBy("node_id").toPandas()[["x0", "y0", "z0"]].to_numpy(), xyz)
    assert mesh.warper().warp(mesh.volume, lambda d: d).count() == 18
    with pytest.raises(ValueError, match="given in the options"):
        Mesh.cgns(spark, str(tmp_path / "u.cgns"), WarpOptions(symmetry_surfaces=("body",))).planes()
    with pytest.raises(ValueError, match="no surface"):
        Mesh.cgns(spark, str(tmp_path / "u.cgns"), WarpOptions(specified_surfaces=("nosuch",))).surface()


def test_meshes_that_are_refused():
    def base(cells=3, kind="<f8"):
        zone = node("Zone_t", np.array([[2, 2, 2], [1, 1, 1], [0, 0, 0]], "<i4"), GridCoordinates=node("GridCoordinates_t", **{f"Coordinate{c}": node("DataArray_t", np.zeros((2, 2, 2), kind)) for c in "XYZ"}))
        return hdf5.encode(hdf5.Group(groups={"Base": node("CGNSBase_t", np.array([cells, 3], "<i4"), Zone=zone)}))

    assert len(list(cgns._volume(base()))) == 1
    with pytest.raises(ValueError, match="three dimensions"):
        cgns.zones_of(base(cells=2))
    with pytest.raises(ValueError, match="doubles"):
        list(cgns._volume(base(kind="<f4")))
    with pytest.raises(ValueError, match="not an HDF5"):
        hdf5.File(b"no")
    with pytest.raises(ValueError, match="no base"):
        cgns.zones_of(hdf5.encode(hdf5.Group()))


def dense_group(links):
    """A file whose root keeps its links in a heap of one block, with an index of one leaf, and a header of version 2."""
    out = bytearray(hdf5.encode(hdf5.Group(datasets={n: np.arange(v) for n, v in links.items()})))
    old = hdf5.File(bytes(out)).node(hdf5.File(bytes(out)).root).children

    def put(raw):
        out.extend(b"\0" * (-len(out) % 8))
        out.extend(raw)
        return len(out) - len(raw)

    block, records = bytearray(b"FHDB" + bytes(1 + 8 + 4)), []
    for n, at in old.items():
        raw = struct.pack("<BBB", 1, 0, len(n)) + n.encode() + struct.pack("<Q", at)
        records.append(struct.pack("<IBIH", 0, 0, len(block), len(raw)))
        block += raw
    root = put(bytes(block) + bytes(512 - len(block)))
    heap = put(b"FRHP" + struct.pack("<BHHBI", 0, 7, 0, 0, 4096) + struct.pack("<12Q", *[0] * 12) + struct.pack("<HQQHHQH", 4, 512, 65536, 32, 1, root, 0))
    leaf = put(b"BTLF" + bytes([0, 5]) + b"".join(records))
    index = put(b"BTHD" + struct.pack("<BBIHHBBQHQ", 0, 5, 512, 11, 0, 100, 40, leaf, len(records), len(records)))
    body = struct.pack("<BHB", hdf5.LINK_INFO, 18, 0) + struct.pack("<BBQQ", 0, 0, heap, index)
    top = put(b"OHDR" + struct.pack("<BBB", 2, 0, len(body)) + body + bytes(4))
    out[64:72] = struct.pack("<Q", top)
    return bytes(out)


def test_groups_with_many_links():
    links = {f"name{k}": k + 1 for k in range(12)}
    file = hdf5.File(dense_group(links))
    found = file.node(file.root).children
    assert {n: file.values(file.node(at).dataset).tolist() for n, at in found.items()} == {n: list(range(k)) for n, k in links.items()}


def test_poly_mesh_as_one_object(spark, tmp_path):
    from .test_sources import poly_mesh

    for k in (0, 1):
        poly_mesh(tmp_path / f"processor{k}" / "constant" / "polyMesh")
    mesh = Mesh.read(spark, WarpOptions(grid_file=str(tmp_path), file_type="OpenFOAM", eval_mode="exact", symmetry_planes=()))
    assert mesh.volume.count() == 24 and sorted(r.nodes for r in mesh.surface().collect()) == [[0, 6, 9, 3], [2, 5, 11, 8], [12, 18, 21, 15], [14, 17, 23, 20]]
    assert mesh.costs().count() == 24
