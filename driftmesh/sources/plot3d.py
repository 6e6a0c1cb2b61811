"""PLOT3D grids: Fortran-unformatted, several zones, doubles, no blanking; volumes and surfaces.

A file is one binary row, decoded record by record in an Arrow map; zones come out as rows of numbers in bounded batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmesh.sources.files import save_bytes

BATCH = 65_536


def records(content: bytes) -> Iterator[bytes]:
    """The payloads of length-marked records; a marker that disagrees with its partner raises."""
    at = 0
    while at < len(content):
        (n,) = struct.unpack_from("<i", content, at)
        if n < 0 or content[at + 4 + n : at + 8 + n] != content[at : at + 4]:
            raise ValueError(f"broken record at byte {at}")
        yield content[at + 4 : at + 4 + n]
        at += 8 + n


def record(payload: bytes) -> bytes:
    mark = struct.pack("<i", len(payload))
    return mark + payload + mark


def _decode(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                parts = records(batch.column(1)[k].as_py())
                (zones,) = struct.unpack("<i", next(parts))
                sizes = np.frombuffer(next(parts), "<i4").reshape(zones, dims)
                at = 0
                for zone, size in enumerate(sizes):
                    xyz = np.frombuffer(next(parts), "<f8").reshape(3, -1)
                    n = int(np.prod(size))
                    if xyz.shape[1] != n:
                        raise ValueError(f"zone {zone} has {xyz.shape[1]} nodes, its size says {n}")
                    for lo in range(0, n, BATCH):
                        hi = min(n, lo + BATCH)
                        ids = np.arange(lo, hi)
                        full = [int(s) for s in size] + [1] * (3 - dims)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([batch.column(0)[k].as_py()] * (hi - lo)), pa.array(np.full(hi - lo, zone, np.int32)), *[pa.array(np.full(hi - lo, s, np.int32)) for s in full], pa.array(ids + at), pa.array(ids), *[pa.array(xyz[i, lo:hi]) for i in range(3)]],
                            names=["file", "zone_id", "il", "jl", "kl", "node_id", "local", "x0", "y0", "z0"],
                        )
                    at += n

    return run


def _read(spark: SparkSession, path: str, dims: int) -> DataFrame:
    return decode(spark.read.format("binaryFile").load(path).select("path", "content"), dims)


def decode(files: DataFrame, dims: int = 3) -> DataFrame:
    """Nodes of files given as rows (path, content)."""
    return files.select("path", "content").mapInArrow(_decode(dims), "file string, zone_id int, il int, jl int, kl int, node_id long, local long, x0 double, y0 double, z0 double")


def read_volume(spark: SparkSession, path: str) -> DataFrame:
    """(file, zone_id, il, jl, kl, node_id, local, x0, y0, z0): nodes zone by zone, i fastest; node_id within the file."""
    return _read(spark, path, 3)


def read_surface(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Points (pt_id, x, y, z) and faces (face_id, zone_id, nodes): the quads of each zone, in its orientation."""
    nodes = _read(spark, path, 2)
    pts = nodes.select(F.col("node_id").alias("pt_id"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("z0").alias("z"))
    i, j = F.col("local") % F.col("il"), F.floor(F.col("local") / F.col("il"))
    inner = nodes.filter((i < F.col("il") - 1) & (j < F.col("jl") - 1))
    n = F.col("node_id")
    quads = inner.select(n.alias("face_id"), "zone_id", F.array(n, n + 1, n + 1 + F.col("il"), n + F.col("il")).alias("nodes"))
    return pts, quads


def zone_name(zone: int) -> str:
    return f"Domain.{zone + 1:5d}"


def write_volume(volume: DataFrame, zones: DataFrame) -> DataFrame:
    """(zone_id, record): each zone's record; zone_sizes() and these, in order, are the file. volume: (zone_id, local, x0,
    y0, z0); a zone is written by one task, as the format has it in one record."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("local")
        payload = b"".join(np.ascontiguousarray(table[c].to_numpy(), "<f8").tobytes() for c in ("x0", "y0", "z0"))
        return pa.table({"zone_id": pa.array([table["zone_id"][0].as_py()], pa.int32()), "record": pa.array([record(payload)], pa.binary())})

    return volume.select("zone_id", "local", "x0", "y0", "z0").groupBy("zone_id").applyInArrow(pack, "zone_id int, record binary").join(zones.select("zone_id"), "zone_id", "left_semi")


def head(sizes: list[tuple[int, ...]]) -> bytes:
    return record(struct.pack("<i", len(sizes))) + record(np.array(sizes, "<i4").tobytes())


def save(volume: DataFrame, zones: DataFrame, path: str) -> None:
    """Writes a file zone by zone, holding one zone at a time, on any store that Spark's file systems reach."""
    rows = zones.select("zone_id", "il", "jl", "kl").orderBy("zone_id").collect()  # a row a zone

    def parts():
        yield head([(r["il"], r["jl"], r["kl"]) for r in rows])
        for r in write_volume(volume, zones).orderBy("zone_id").toLocalIterator():
            yield bytes(r["record"])

    save_bytes(volume.sparkSession, path, parts())
