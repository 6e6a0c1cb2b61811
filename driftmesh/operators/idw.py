"""The exact warp without rotations as a plain join and aggregate: the declarative form of the kernel, which a large surface
goes through, as a row for each pair would cost many times its sum."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.functions.geometry import distance2, idw_weight, mirror_vector, vector
from driftmesh.operators.symmetry import mirror_images

#: Surface rows that may be broadcast, and those up to which they meet the volume in a join.
MOST_ROWS, JOINED_ROWS = 200_000, 10_000


def exact_warp_join(volume: DataFrame, surface: DataFrame, ldef: float, a_exp: float = 3.0, b_exp: float = 5.0, alpha: float = 0.25, planes=()) -> DataFrame:
    """(node_id, x, y, z): volume (node_id, x0, y0, z0), surface (x, y, z, a, dx, dy, dz).

    The surface side is broadcast behind a check of its size; beyond it, plans.warp.blocked_warp takes the surface in blocks.
    """
    n = surface.count()
    if n > MOST_ROWS:
        raise ValueError(f"{n} surface rows, {MOST_ROWS} at most; use blocked_warp")
    if n > JOINED_ROWS:
        return _summed_warp(volume, surface, ldef, a_exp, b_exp, alpha, planes)
    images = mirror_images(volume.select("node_id", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("z0").alias("z")), planes)
    s = surface.select(*[F.col(c).alias(f"s{c}") for c in "xyz"], "a", "dx", "dy", "dz")
    w = idw_weight(F.col("a"), distance2(vector("x", "y", "z"), vector("sx", "sy", "sz")), F.lit(ldef), a_exp, b_exp, alpha)
    pairs = images.join(F.broadcast(s), F.lit(True)).withColumn("w", w)  # every volume row meets the bounded block
    sums = pairs.groupBy("node_id", "image").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("dx", "dy", "dz")], F.sum("w").alias("w"))
    back = [F.when(F.col("image") == k, F.struct(*[v.alias(c) for v, c in zip(mirror_vector(vector("dx", "dy", "dz"), planes, k), "xyz")])) for k in range(1 << len(planes))]
    total = sums.withColumn("m", F.coalesce(*back)).groupBy("node_id").agg(*[F.sum(f"m.{c}").alias(c) for c in "xyz"], F.sum("w").alias("w"))
    moved = [(F.col(f"{c}0") + F.coalesce(F.try_divide(F.col(c), F.col("w")), F.lit(0.0))).alias(c) for c in "xyz"]
    return volume.join(total, "node_id").select("node_id", *moved)


def _summed_warp(volume: DataFrame, surface: DataFrame, ldef: float, a_exp: float, b_exp: float, alpha: float, planes) -> DataFrame:
    """exact_warp_join with a node's pairs summed where they are made; rows of one place are added up before."""
    from driftmesh.functions.geometry import EPS_KERNEL
    from driftmesh.plans import kernels as K
    from driftmesh.plans.warp import _frame, _volume

    table = surface.select(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "a", "dx", "dy", "dz")]).toArrow()  # MOST_ROWS at most
    part = np.stack([c.to_numpy() for c in table.columns], axis=1)
    x, place = np.unique(part[:, :3], axis=0, return_inverse=True)
    columns = np.zeros((len(x), 4))
    np.add.at(columns, place.ravel(), part[:, 3:4] * np.concatenate([part[:, 4:], np.ones((len(part), 1))], axis=1))
    shared = volume.sparkSession.sparkContext.broadcast(K.Clusters(x, np.ones(len(x)), columns, K.Weights(ldef, a_exp, b_exp, alpha), EPS_KERNEL))

    def moved(r: np.ndarray) -> np.ndarray:
        num, den = np.zeros(r.shape), np.zeros(len(r))
        for k in range(1 << len(planes)):
            sums = shared.value.sums(K.mirror_points(r, planes, k))
            num += K.mirror_vectors(sums[:, :3], planes, k)
            den += sums[:, 3]
        return r + np.divide(num, den[:, None], out=np.zeros(r.shape), where=den[:, None] != 0)

    return _volume(volume).mapInArrow(_frame(moved, ["node_id", "x", "y", "z"]), "node_id long, x double, y double, z double")
