"""The native format: a mesh as a folder of Parquet tables, one for each table of driftmesh.schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("volume", "points", "faces", "patches", "zones", "bocos", "sections", "elements")


def write_mesh(path: str, by_zone: bool = False, mode: str = "errorifexists", **tables: DataFrame) -> None:
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"unknown tables {sorted(unknown)}")
    for name, df in tables.items():
        writer = df.write.mode(mode)
        (writer.partitionBy("zone_id") if by_zone and "zone_id" in df.columns else writer).parquet(f"{path}/{name}")


def read_mesh(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def write_instances(path: str, volume: DataFrame, mode: str = "errorifexists") -> None:
    """One folder for each component of a volume with an `instance` column."""
    volume.write.mode(mode).partitionBy("instance").parquet(path)


def write_moved(volume: DataFrame, moved: DataFrame, instances: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The whole grid, moved nodes laid over it, one folder for each instance name and one for the background."""
    from driftmesh.operators.multi import overlay
    from driftmesh.operators.patches import block_to_instance

    held = block_to_instance(volume.withColumn("block_id", F.col("zone_id")), instances).join(F.broadcast(instances.select("inst_id", "name")), "inst_id").select("node_id", F.col("name").alias("instance"))
    placed = overlay(volume, moved).join(volume.select("node_id", "zone_id"), "node_id").join(held, "node_id", "left")
    write_instances(path, placed.withColumn("instance", F.coalesce("instance", F.lit("background"))), mode)
