"""Neighbours in space: fixed radius, k nearest, counts; all by cells, none by products of tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmesh.operators.common import materialize, spread

#: Points that the brute-force searches broadcast, and distances that they hold at a time.
MOST_POINTS, HELD = 2_000_000, 1 << 20


def r_nearest(queries: DataFrame, points: DataFrame, radius: float, decorrelate: int = 0) -> DataFrame:
    """(q_id, pt_id, d2) of the points within the radius, borders included.

    queries: (q_id, x, y, z); points: (pt_id, x, y, z). Points live in cells as wide as the radius; a query asks its own
    and the 26 around it. decorrelate: leave out points whose id is closer to the query's than that.
    """
    r = max(radius, 1e-300)
    homes = points.select("pt_id", "x", "y", "z", *[F.floor(F.col(c) / r).alias(f"c{c}") for c in "xyz"])
    asks = queries.select("q_id", *[F.col(c).alias(f"q{c}") for c in "xyz"])
    for c in "xyz":
        asks = asks.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"q{c}") / r) - 1, F.floor(F.col(f"q{c}") / r) + 1)))
    d2 = sum((F.col(c) - F.col(f"q{c}")) * (F.col(c) - F.col(f"q{c}")) for c in "xyz")
    out = asks.join(homes, ["cx", "cy", "cz"]).select("q_id", "pt_id", d2.alias("d2")).filter(F.col("d2") <= radius * radius)
    return out.filter(F.abs(F.col("q_id") - F.col("pt_id")) >= decorrelate) if decorrelate else out


def r_count(queries: DataFrame, points: DataFrame, radius: float, decorrelate: int = 0) -> DataFrame:
    """(q_id, n): how many points are within the radius; none counts as 0."""
    found = r_nearest(queries, points, radius, decorrelate).groupBy("q_id").agg(F.count(F.lit(1)).alias("n"))
    return queries.select("q_id").join(found, "q_id", "left").select("q_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _nearest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_id").orderBy("d2", "pt_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn(queries: DataFrame, points: DataFrame, k: int, radius: float | None = None, decorrelate: int = 0) -> DataFrame:
    """(q_id, rank, pt_id, d2): the k nearest points, ties by id.

    Queries that find k points within the radius are done; the others ask again at twice the radius. The first radius
    follows from the points' density unless given. Fewer than k come back only if there are no more.
    """
    box = points.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"]).first()
    if not box["n"]:
        return queries.sparkSession.createDataFrame([], "q_id long, rank int, pt_id long, d2 double")
    reach = queries.agg(*[f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"]).first()
    sides = [max(box[f"hi{c}"], reach[f"hi{c}"] or box[f"hi{c}"]) - min(box[f"lo{c}"], reach[f"lo{c}"] if reach[f"lo{c}"] is not None else box[f"lo{c}"]) for c in "xyz"]
    most = sum(s * s for s in sides) ** 0.5 or 1.0
    r = radius or max(most * (k / max(box["n"], 1)) ** (1 / 3) * 0.5, most * 1e-6)
    left, out = queries.select("q_id", "x", "y", "z"), None
    while True:
        # half again as many are asked for at the last step, when the whole box is in reach
        whole = r >= most * 1.0000001
        found = materialize(_nearest(r_nearest(left, points, r, decorrelate), k), "knn")
        full = found.groupBy("q_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("q_id")
        done = found if whole else found.join(full, "q_id", "left_semi")
        out = done if out is None else out.unionByName(done)
        if whole:
            break
        left = materialize(left.join(full, "q_id", "left_anti"), "knn-left")
        if left.isEmpty():
            break
        r *= 2
    return out.select("q_id", "rank", "pt_id", "d2")


def point_in_tree(queries: DataFrame, points: DataFrame, tol: float = 1e-6) -> DataFrame:
    """(q_id, found): the nearest point within tol, counted from 1 as pt_id + 1; 0 where there is none."""
    near = _nearest(r_nearest(queries, points, tol), 1).select("q_id", "pt_id")
    return queries.select("q_id").join(near, "q_id", "left").select("q_id", F.coalesce(F.col("pt_id") + 1, F.lit(0)).cast("long").alias("found"))


def with_ids(points: DataFrame) -> DataFrame:
    """Points as their own queries, for the variants around existing points."""
    return points.select(F.col("pt_id").alias("q_id"), "x", "y", "z")


def _brute(queries: DataFrame, points: DataFrame, pick, decorrelate: int, ddl: str) -> DataFrame:
    """Every query against every point, in blocks; the points' side is counted before it is broadcast. pick(d2, ids) gives
    the chosen places of a row of distances, in order."""
    n = points.count()
    if n > MOST_POINTS:
        raise ValueError(f"{n} points, {MOST_POINTS} at most for a search by brute force; use knn or r_nearest")
    table = points.select(F.col("pt_id").cast("long"), *[F.col(c).cast("double") for c in "xyz"]).toArrow().sort_by("pt_id")
    shared = points.sparkSession.sparkContext.broadcast((table["pt_id"].to_numpy(), np.stack([table[c].to_numpy() for c in "xyz"], axis=1)))
    names = [c.split()[0] for c in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        step = max(1, HELD // max(1, len(ids)))
        for batch in batches:
            q, r = batch.column(0).to_numpy(), np.stack([batch.column(i).to_numpy() for i in (1, 2, 3)], axis=1)
            for at in range(0, len(q), step):
                d2 = sum((r[at : at + step, c, None] - x[None, :, c]) ** 2 for c in range(3))
                if decorrelate:
                    d2[np.abs(q[at : at + step, None] - ids) < decorrelate] = np.inf
                chosen = [pick(row) for row in d2]
                sizes = [len(c) for c in chosen]
                flat = np.concatenate(chosen).astype(np.int64) if chosen else np.zeros(0, np.int64)
                rows = np.repeat(np.arange(len(chosen)), sizes)
                found = {"q_id": q[at + rows], "rank": np.concatenate([np.arange(1, s + 1) for s in sizes]).astype(np.int32) if sizes else np.zeros(0, np.int32), "pt_id": ids[flat], "d2": d2[rows, flat]}
                yield pa.RecordBatch.from_arrays([pa.array(found[c]) for c in names], names=names)

    return spread(queries.select(F.col("q_id").cast("long"), *[F.col(c).cast("double") for c in "xyz"])).mapInArrow(run, ddl)


def brute_knn(queries: DataFrame, points: DataFrame, k: int, decorrelate: int = 0) -> DataFrame:
    """(q_id, rank, pt_id, d2) as knn gives, by comparing everything."""

    def pick(d2: np.ndarray) -> np.ndarray:
        near = np.flatnonzero(d2 <= np.partition(d2, k - 1)[k - 1]) if len(d2) > k else np.arange(len(d2))
        near = near[np.isfinite(d2[near])]
        return near[np.argsort(d2[near], kind="stable")[:k]]  # places ascend with ids

    return _brute(queries, points, pick, decorrelate, "q_id long, rank int, pt_id long, d2 double")


def brute_within(queries: DataFrame, points: DataFrame, radius: float, decorrelate: int = 0, strict: bool = False) -> DataFrame:
    """(q_id, pt_id, d2) as r_nearest gives, by comparing everything; strict: the border is left out."""
    r2 = radius * radius
    return _brute(queries, points, lambda d2: np.flatnonzero(d2 < r2 if strict else d2 <= r2), decorrelate, "q_id long, pt_id long, d2 double")
