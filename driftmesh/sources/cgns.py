"""CGNS files in HDF5: zones, coordinates, boundary conditions and element sections as tables, and coordinates written back.

A file is one row, read whole by Spark's reader and parsed where it lies; tables come out in bounded batches. The first
base counts, and its cells must have three dimensions; coordinates are doubles. Structured zones have their conditions as
ranges of points, unstructured ones as ranges or lists of elements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftmesh.sources import hdf5

BATCH = 65_536
#: How a node's own data are called in the file.
DATA = " data"


class Tree:
    """A node of the file: its label, data and children by name."""

    def __init__(self, file: hdf5.File, address: int):
        self.file, self.node = file, file.node(address)

    def _text(self, name: str) -> str:
        value = self.node.attributes.get(name)
        return "" if value is None or not value.size else bytes(value.ravel()[0]).split(b"\0")[0].decode().strip()

    @property
    def label(self) -> str:
        return self._text("label")

    def dataset(self) -> hdf5.Dataset | None:
        at = self.node.children.get(DATA)
        return None if at is None else self.file.node(at).dataset

    def data(self) -> np.ndarray | None:
        found = self.dataset()
        return None if found is None else self.file.values(found)

    def text(self) -> str:
        found = self.data()
        return "" if found is None else found.tobytes().split(b"\0")[0].decode().strip()

    def children(self, label: str | None = None) -> list[tuple[str, Tree]]:
        every = [(n, Tree(self.file, at)) for n, at in self.node.children.items() if n != DATA]
        return [(n, t) for n, t in every if label is None or t.label == label]

    def child(self, name: str) -> Tree | None:
        at = self.node.children.get(name)
        return None if at is None else Tree(self.file, at)


def zones_of(content: bytes) -> list[tuple[str, Tree, np.ndarray, bool]]:
    """(name, node, sizes, structured) of the first base's zones, by name; raises where the mesh is of another kind."""
    file = hdf5.File(content)
    bases = Tree(file, file.root).children("CGNSBase_t")
    if not bases:
        raise ValueError("no base in the file")
    base = bases[0][1]
    if int(base.data().ravel()[0]) != 3:
        raise ValueError("cells must have three dimensions")
    out = []
    for name, zone in sorted(base.children("Zone_t"), key=lambda z: z[0]):
        kind = zone.child("ZoneType")
        out.append((name, zone, np.asarray(zone.data(), np.int64), (kind.text() if kind else "Structured") == "Structured"))
    if len({s for *_, s in out}) > 1:
        raise ValueError("structured and unstructured zones in one mesh")
    return out


def coordinates(zone: Tree) -> list[hdf5.Dataset]:
    grid = zone.children("GridCoordinates_t")
    found = [grid[0][1].child(f"Coordinate{c}") for c in "XYZ"] if grid else [None]
    if any(f is None for f in found):
        raise ValueError("a zone lacks coordinates")
    sets = [f.dataset() for f in found]
    if any(d.kind.kind != "f" or d.kind.itemsize != 8 for d in sets):
        raise ValueError("coordinates must be doubles")
    return sets


def _zones(content: bytes):
    for k, (name, _, sizes, structured) in enumerate(zones_of(content)):
        il, jl, kl = (int(n) for n in sizes[0]) if structured else (0, 0, 0)
        yield [k], [name], [structured], [il], [jl], [kl], [int(np.prod(sizes[0])) if structured else int(sizes.ravel()[0])], [0 if structured else int(sizes.ravel()[1])]


def _volume(content: bytes):
    at = 0
    for k, (_, zone, _, _) in enumerate(zones_of(content)):
        xyz = [zone.file.values(d).ravel() for d in coordinates(zone)]
        for lo in range(0, len(xyz[0]), BATCH):
            part = [x[lo : lo + BATCH].astype(float) for x in xyz]
            yield np.arange(at + lo, at + lo + len(part[0])), np.full(len(part[0]), k, np.int32), *part
        at += len(xyz[0])


def _bocos(content: bytes):
    for k, (_, zone, _, structured) in enumerate(zones_of(content)):
        conditions = [b for _, group in zone.children("ZoneBC_t") for b in group.children("BC_t")]
        for b, (name, node) in enumerate(sorted(conditions, key=lambda c: c[0])):
            family = node.child("FamilyName")
            ranged, listed = node.child("PointRange") or node.child("ElementRange"), node.child("PointList") or node.child("ElementList")
            points = elements = None
            if structured:
                if ranged is None:
                    raise ValueError(f"condition {name} of a structured zone has no range of points")
                points = np.asarray(ranged.data(), np.int64).reshape(2, 3).tolist()
            elif ranged is not None:
                lo, hi = np.asarray(ranged.data(), np.int64).ravel().tolist()
                elements = np.arange(lo, hi + 1)
            elif listed is not None:
                elements = np.asarray(listed.data(), np.int64).ravel()
            else:
                raise ValueError(f"condition {name} has neither a range nor a list of elements")
            yield [k], [b], [name], [node.text()], [family.text() if family else None], [points], [elements]


def _streams(content: bytes):
    for k, (_, zone, _, _) in enumerate(zones_of(content)):
        found = sorted(zone.children("Elements_t"), key=lambda s: int(np.asarray(s[1].child("ElementRange").data()).ravel()[0]))
        for s, (_, node) in enumerate(found):
            lo = int(np.asarray(node.child("ElementRange").data()).ravel()[0])
            yield [k], [s], [int(node.data().ravel()[0])], [lo], [np.asarray(node.child("ElementConnectivity").data(), np.int64).ravel()]


_KINDS = {
    "zones": (_zones, "zone_id int, name string, structured boolean, il int, jl int, kl int, n_vertices long, n_elements long"),
    "volume": (_volume, "node_id long, zone_id int, x0 double, y0 double, z0 double"),
    "bocos": (_bocos, "zone_id int, boco_id int, name string, bc_type string, family string, pt_range array<array<long>>, elements array<long>"),
    "streams": (_streams, "zone_id int, sec_id int, elem_type int, elem_start long, conn array<long>"),
}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<array<long>>": pa.list_(pa.list_(pa.int64()))}


def decode(files: DataFrame, table: str) -> DataFrame:
    """One table (zones, volume, bocos, streams) of a file given as a row with `content`."""
    make, ddl = _KINDS[table]
    columns = [c.split(" ") for c in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for cells in make(batch.column(0)[k].as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(cells, columns)], names=[n for n, _ in columns])

    return files.select("content").mapInArrow(run, ddl)


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a file, for plans.mesh.Mesh; sections are the streams without their numbers."""
    files = spark.read.format("binaryFile").load(path)
    return {name: decode(files, name) for name in _KINDS}


def with_coordinates(content: bytes, xyz: np.ndarray) -> bytes:
    """The file with other coordinates: everything else stays byte for byte. xyz: all nodes in file order."""
    out, at = bytearray(content), 0
    for _, zone, _, _ in zones_of(content):
        sets = coordinates(zone)
        n = int(np.prod(sets[0].shape, dtype=np.int64))
        for c, d in enumerate(sets):
            out[d.address : d.address + d.size] = np.ascontiguousarray(xyz[at : at + n, c]).astype(d.kind).tobytes()
        at += n
    if at != len(xyz):
        raise ValueError(f"{len(xyz)} nodes for a file of {at}")
    return bytes(out)


def overwrite(files: DataFrame, moved: DataFrame) -> DataFrame:
    """(content): the file of one row with the moved nodes (node_id, x, y, z), all of them, in place of its own. A file is
    written by one task, as the format has it in one piece."""
    from pyspark.sql import functions as F

    def write(content: pa.Table, nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("node_id")
        xyz = np.stack([nodes[c].to_numpy() for c in "xyz"], axis=1)
        return pa.table({"content": pa.array([with_coordinates(r, xyz) for r in content["content"].to_pylist()], pa.binary())})

    one = F.lit(1).alias("k")
    return files.select(one, "content").groupBy("k").cogroup(moved.select(one, "node_id", "x", "y", "z").groupBy("k")).applyInArrow(write, "content binary")


def save(files: DataFrame, path: str) -> None:
    """Writes a row's content as a file, on any store that Spark's file systems reach."""
    from driftmesh.sources.files import save_bytes

    rows = files.select("content").take(2)
    if len(rows) != 1:
        raise ValueError("one file at a time")
    save_bytes(files.sparkSession, path, [bytes(rows[0]["content"])])
