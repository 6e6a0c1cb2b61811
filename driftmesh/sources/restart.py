"""A cache of denominators and costs, reused only if it fits the mesh and a sample of it verifies."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.operators.transfer import strided
from driftmesh.plans.warp import Warper

TOLERANCE = 1e-10


def fingerprint(warper: Warper, volume: DataFrame) -> str:
    """Of the surface, the options that weights depend on, and the number and sum of the volume's nodes."""
    size = volume.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node_id", "x0", "y0", "z0").cast("decimal(38,0)")).alias("s")).first()
    options = {k: v for k, v in asdict(warper.options).items() if k in ("a_exp", "b_exp", "ldef_fact", "alpha", "err_tol", "bucket_size")}
    text = json.dumps([options, warper.planes, size["n"], str(size["s"]), hashlib.sha256(warper.x.tobytes() + warper.area.tobytes()).hexdigest()])
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def cached_costs(warper: Warper, volume: DataFrame, path: str, stride: int = 100) -> DataFrame:
    """(node_id, denominator, cost) from path, or computed and written there if it is missing, foreign or wrong."""
    spark = volume.sparkSession
    place = f"{path}/{fingerprint(warper, volume)}"
    try:
        found = spark.read.parquet(place)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        found = None
    if found is not None:
        sample = strided(found, stride).join(warper.costs(strided(volume, stride)).withColumnRenamed("denominator", "__d"), "node_id", "full")
        wrong = F.coalesce(F.abs(F.col("denominator") - F.col("__d")) > TOLERANCE * F.abs(F.col("__d")), F.lit(True))
        if sample.filter(wrong).isEmpty():
            return found
    warper.costs(volume).write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
