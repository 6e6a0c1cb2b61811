"""JSON files of a solver's surface and index arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_solver_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """solver_map (solver_dof, common_dof), points (pt_id, x, y, z), faces (face_id, block_id, nodes)."""
    kind = "meshInd array<long>, pts array<array<double>>, conn array<long>, faceSizes array<long>, cgnsBlockIDs array<int>"
    raw = spark.read.json(path, schema=kind, multiLine=True)
    ends = F.aggregate("faceSizes", F.array(F.lit(0).cast("long")), lambda a, k: F.concat(a, F.array(F.element_at(a, -1) + k)))
    faces = raw.select("conn", "cgnsBlockIDs", "faceSizes", ends.alias("ends")).select("conn", "cgnsBlockIDs", "ends", F.posexplode("faceSizes").alias("face_id", "k"))
    nodes = F.slice("conn", (F.get("ends", F.col("face_id")) + 1).cast("int"), F.col("k").cast("int"))
    return {
        "solver_map": raw.select(F.posexplode("meshInd").alias("solver_dof", "common_dof")).select(F.col("solver_dof").cast("long").alias("solver_dof"), "common_dof"),
        "points": raw.select(F.posexplode("pts").alias("pt_id", "p")).select(F.col("pt_id").cast("long").alias("pt_id"), *[F.get("p", F.lit(i)).alias(c) for i, c in enumerate("xyz")]),
        "faces": faces.select(F.col("face_id").cast("long").alias("face_id"), F.get("cgnsBlockIDs", F.col("face_id")).alias("block_id"), nodes.alias("nodes")),
    }
