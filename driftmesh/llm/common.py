"""What the operators share: reading tables, batches of rows, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmesh.operators.common import BROADCAST_ROWS, SALTS, discard, fresh, look_up, materialize, shared_dir, small_side

__all__ = ["BROADCAST_ROWS", "SALTS", "connected_components", "crc_of_id", "discard", "fresh", "give_back", "giving_back", "look_up", "materialize", "partition_slots", "shared_dir", "slices", "small_side", "table"]

#: Rows that a Python kernel turns into objects at a time; bounds its memory whatever the Arrow batch is.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Returns memory that this process has freed to the system: else a worker that waits for its next task, or whose
    executor runs a stage without Python, keeps the most that it ever held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def giving_back(kernel: Callable) -> Callable:
    """A map over batches that gives memory back when it ends, or is ended."""

    @wraps(kernel)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def partition_slots(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(u, v) edges of longs -> (node, root): root is the smallest node of the component, itself among its nodes.

    Alternating large-star and small-star steps: every round links nodes to the least neighbour with one aggregate,
    combined before its shuffle, and one look-up, which is broadcast or salted, so that a node with most of the edges does
    not meet them in one task. Rounds end when the set of edges stays as it was; it is then a star around each root. Each
    round is written to the shared folder and the one before is deleted.
    """

    def star(e: DataFrame, small: bool, edges: int) -> DataFrame:
        # e has u > v. Small: a node's lesser neighbours go to the least of them. Large: its greater ones do.
        both = e if small else e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = look_up(both, least, "u", most_rows=2 * edges)
        out = (joined if small else joined.filter("v > u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        if small:
            out = out.unionByName(least.select("u", F.col("m").alias("v")))
        return out.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    current = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = materialize(current, "edges")

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(current)
    for _ in range(max_rounds if before[0] else 0):
        after_df = materialize(star(star(current, False, before[0]), True, before[0]), "edges")
        after = mark(after_df)
        discard(current)
        current = after_df
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
