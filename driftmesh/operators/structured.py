"""Surfaces of zoned meshes from their tables: point ranges of structured zones, elements of unstructured ones.

Tables are those of driftmesh.schema; node ids are 0-based over all zones, i fastest, zone after zone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmesh.operators.points import offsets, running
from driftmesh.schema import ELEMENT_NODES, MIXED, SURFACE_ELEMENTS


def zone_offsets(zones: DataFrame) -> DataFrame:
    """zones with `offset`, the id of each zone's first node."""
    return offsets(zones, "zone_id", "n_vertices")


def kind_of(zones: DataFrame) -> bool:
    """Whether the mesh is structured; zones of both kinds raise."""
    found = zones.agg(F.bool_and("structured").alias("all"), F.bool_or("structured").alias("any")).first()
    if found["all"] != found["any"]:
        raise ValueError("structured and unstructured zones in one mesh")
    return bool(found["all"])


def patch_ranges(zones: DataFrame, bocos: DataFrame) -> DataFrame:
    """One row a boundary condition: patch_id (dense, by zone and place), family, bc_type, and its lattice: sizes ni, nj,
    ids first + step_i * i + step_j * j, and whether it lies on the low side of its zone.

    The fixed direction is the first whose range is one node wide; the others follow in order.
    """
    at = lambda side, d: F.get(F.get("pt_range", F.lit(side)), F.lit(d)).cast("long")
    fixed = F.when(at(0, 0) == at(1, 0), 0).when(at(0, 1) == at(1, 1), 1).when(at(0, 2) == at(1, 2), 2)
    met = bocos.join(F.broadcast(zone_offsets(zones).select("zone_id", "il", "jl", "kl", "offset")), "zone_id")
    steps = F.array(F.lit(1).cast("long"), F.col("il").cast("long"), F.col("il").cast("long") * F.col("jl"))
    sizes = F.array(*[at(1, d) - at(0, d) + 1 for d in range(3)])
    a, b = F.when(F.col("fixed") == 0, 1).otherwise(0), F.when(F.col("fixed") == 2, 1).otherwise(2)
    flat = F.when(fixed.isNull(), F.raise_error(F.lit("a boundary condition's range is not a face")).cast("int")).otherwise(fixed)
    first = F.col("offset") + sum(((at(0, d) - 1) * F.get(steps, F.lit(d)) for d in range(3)), F.lit(0).cast("long"))
    low = F.get(F.array(*[at(0, d) for d in range(3)]), F.col("fixed")) == 1
    ranged = met.withColumn("fixed", flat).select(
        "zone_id", "boco_id", "family", "bc_type", F.get(sizes, a).alias("ni"), F.get(sizes, b).alias("nj"), F.get(steps, a).alias("step_i"), F.get(steps, b).alias("step_j"), first.alias("first"), low.alias("low")
    )
    dense = running(ranged, ["zone_id", "boco_id"], F.lit(1).cast("long"), "__rank")
    return dense.withColumn("patch_id", (F.col("__rank") - 1).cast("int")).drop("__rank")


def _node(i: Column, j: Column) -> Column:
    return F.col("first") + F.col("step_i") * i + F.col("step_j") * j


def patch_faces(ranges: DataFrame) -> DataFrame:
    """(face_id, patch_id, nodes): the quads of each patch, i fastest, turned round on high faces; ids run over patches."""
    counted = ranges.withColumn("n", (F.col("ni") - 1) * (F.col("nj") - 1))
    placed = running(counted, ["patch_id"], F.col("n"), "begin", exclusive=True).filter("n > 0")
    cells = placed.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nj") - 2))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ni") - 2)))
    i, j = F.col("i"), F.col("j")
    n1, n2, n3, n4 = _node(i, j), _node(i + 1, j), _node(i + 1, j + 1), _node(i, j + 1)
    nodes = F.when(F.col("low"), F.array(n1, n2, n3, n4)).otherwise(F.array(n1, n4, n3, n2))
    return cells.select((F.col("begin") + j * (F.col("ni") - 1) + i).alias("face_id"), "patch_id", nodes.alias("nodes"))


def patch_nodes(ranges: DataFrame) -> DataFrame:
    """(patch_id, pos, node): the lattice nodes of each patch, i fastest."""
    cells = ranges.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nj") - 1))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ni") - 1)))
    return cells.select("patch_id", (F.col("j") * F.col("ni") + F.col("i")).alias("pos"), _node(F.col("i"), F.col("j")).alias("node"))


def decode_elements(streams: DataFrame) -> DataFrame:
    """(zone_id, sec_id, elem_id, elem_type, nodes) from the sections' lists of numbers (driftmesh.schema.STREAMS).

    A mixed section names each element's type before its nodes; a type without a known number of nodes, or a list that
    ends within an element, raises. Elements count from elem_start; nodes are as in the list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                zone, sec, kind, start = (batch.column(c)[k].as_py() for c in range(4))
                conn = batch.column(4)[k].values.to_numpy()
                if kind == MIXED:
                    begins, kinds, at, listed = [], [], 0, conn.tolist()
                    while at < len(listed):
                        kinds.append(listed[at])
                        begins.append(at + 1)
                        at += 1 + ELEMENT_NODES[listed[at]]
                    sizes = np.array([ELEMENT_NODES[t] for t in kinds], np.int64)
                    begins = np.array(begins, np.int64)
                else:
                    n, rest = divmod(len(conn), ELEMENT_NODES[kind])
                    at = len(conn) + rest
                    kinds, sizes, begins = [kind] * n, np.full(n, ELEMENT_NODES[kind]), np.arange(n) * ELEMENT_NODES[kind]
                if at != len(conn):
                    raise ValueError(f"section {sec} of zone {zone} ends within an element")
                for lo in range(0, len(kinds), 65_536):
                    part = slice(lo, min(lo + 65_536, len(kinds)))
                    ends = np.cumsum(sizes[part])
                    places = np.arange(int(ends[-1])) + np.repeat(begins[part] - (ends - sizes[part]), sizes[part])
                    m = part.stop - lo
                    nodes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(conn[places], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([zone] * m, pa.int32()), pa.array([sec] * m, pa.int32()), pa.array(start + np.arange(lo, part.stop), pa.int64()), pa.array(kinds[part], pa.int32()), nodes],
                        names=["zone_id", "sec_id", "elem_id", "elem_type", "nodes"],
                    )

    rows = streams.select("zone_id", "sec_id", "elem_type", "elem_start", F.col("conn").cast("array<long>"))
    return rows.mapInArrow(run, "zone_id int, sec_id int, elem_id long, elem_type int, nodes array<long>")


def boco_faces(bocos: DataFrame, elements: DataFrame, zones: DataFrame) -> DataFrame:
    """(face_id, patch_id, nodes) of the boundary conditions' elements (zone_id, boco_id, elements), as far as a surface
    section has them; nodes, counted from 1 within a zone, become ids over all zones."""
    dense = running(bocos.select("zone_id", "boco_id"), ["zone_id", "boco_id"], F.lit(1).cast("long"), "__rank")
    named = bocos.join(dense.select("zone_id", "boco_id", (F.col("__rank") - 1).cast("int").alias("patch_id")), ["zone_id", "boco_id"])
    asked = named.select("zone_id", "patch_id", F.posexplode("elements").alias("pos", "elem_id"))
    flat = elements.filter(F.col("elem_type").isin(*SURFACE_ELEMENTS)).select("zone_id", "elem_id", "nodes")
    met = asked.join(flat, ["zone_id", "elem_id"]).join(F.broadcast(zone_offsets(zones).select("zone_id", "offset")), "zone_id")
    moved = met.select("patch_id", "pos", F.transform("nodes", lambda n: n - 1 + F.col("offset")).alias("nodes"))
    return running(moved, ["patch_id", "pos"], F.lit(1).cast("long"), "__rank").select((F.col("__rank") - 1).alias("face_id"), "patch_id", "nodes")


def unmatched_elements(bocos: DataFrame, elements: DataFrame) -> DataFrame:
    """(zone_id, boco_id, n): elements of boundary conditions that no surface section has."""
    asked = bocos.select("zone_id", "boco_id", F.explode("elements").alias("elem_id"))
    flat = elements.filter(F.col("elem_type").isin(*SURFACE_ELEMENTS)).select("zone_id", "elem_id")
    return asked.join(flat, ["zone_id", "elem_id"], "left_anti").groupBy("zone_id", "boco_id").agg(F.count(F.lit(1)).alias("n"))
