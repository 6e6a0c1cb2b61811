"""Between orderings of degrees of freedom, and the balance of work over partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.operators.points import previous, running


def warp_to_solver(solver_map: DataFrame, values: DataFrame) -> DataFrame:
    """(solver_dof, value): each solver dof takes the value at its common dof; several may share one."""
    return solver_map.join(values, "common_dof").select("solver_dof", "value")


def solver_to_warp(solver_map: DataFrame, values: DataFrame, common: DataFrame) -> DataFrame:
    """(common_dof, value): values of all solver dofs at a common dof add up; 0 where there is none."""
    sums = solver_map.join(values, "solver_dof").groupBy("common_dof").agg(F.sum("value").alias("value"))
    return common.select("common_dof").join(sums, "common_dof", "left").select("common_dof", F.coalesce("value", F.lit(0.0)).alias("value"))


def flatten(nodes: DataFrame) -> DataFrame:
    """(dof, value) from (node_id, x, y, z): three in a row for each node."""
    parts = F.array(*[F.struct((F.col("node_id") * 3 + i).alias("dof"), F.col(c).alias("value")) for i, c in enumerate("xyz")])
    return nodes.select(F.explode(parts).alias("d")).select("d.dof", "d.value")


def unflatten(dofs: DataFrame) -> DataFrame:
    at = lambda i: F.max(F.when(F.pmod("dof", F.lit(3)) == i, F.col("value")))
    return dofs.groupBy(F.floor(F.col("dof") / 3).alias("node_id")).agg(at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def cost_prefix(costs: DataFrame) -> DataFrame:
    """(node_id, cost, cum): running cost in node order."""
    return running(costs, ["node_id"], F.col("cost"), "cum").select("node_id", "cost", "cum")


def cost_bins(costs: DataFrame, parts: int) -> DataFrame:
    """(node_id, part_id): contiguous parts of about equal cost; a part is the floor of the running cost over the mean."""
    total = costs.agg(F.sum("cost")).first()[0] or 1.0
    bins = F.least(F.lit(parts - 1), F.floor((F.col("cum") - F.col("cost")) / F.lit(total / parts)).cast("int"))
    return cost_prefix(costs).select("node_id", bins.alias("part_id"))


def splits(bins: DataFrame) -> DataFrame:
    """(part_id, first_node): where each part begins."""
    return bins.groupBy("part_id").agg(F.min("node_id").alias("first_node"))


def bin_changes(bins: DataFrame, buckets: int | None = None) -> DataFrame:
    """(node_id, part_id) of the nodes where the part differs from that of the node before, whatever gaps ids have."""
    seen = previous(bins, ["node_id"], "part_id", "before", buckets)
    return seen.filter(F.col("before").isNull() | (F.col("before") != F.col("part_id"))).select("node_id", "part_id")


def checksum(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.sum(F.col("x") + F.col("y") + F.col("z")).alias("total"), F.count(F.lit(1)).alias("n"))


def strided(nodes: DataFrame, stride: int = 100, key: str = "node_id") -> DataFrame:
    """Every stride-th node: the operator of a check by samples."""
    return nodes.filter(F.pmod(F.col(key), F.lit(stride)) == 0)
