"""Boundary patches: walls, families, sections and instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmesh.operators.common import fresh
from driftmesh.schema import DEFAULT_FAMILIES, MIXED, SURFACE_ELEMENTS, SURFACE_FACE_TYPES, SYMMETRY_TYPE, WALL_TYPES


def _plain(column: str):
    return F.lower(F.trim(F.col(column)))


def wall_filter(patches: DataFrame) -> DataFrame:
    return patches.filter(_plain("bc_type").isin(*WALL_TYPES))


def symmetry_filter(patches: DataFrame) -> DataFrame:
    return patches.filter(_plain("bc_type") == SYMMETRY_TYPE)


def surface_face_filter(patches: DataFrame) -> DataFrame:
    """Patches of a polyhedral case that form the surface: by type, never by name, and not empty."""
    return patches.filter(_plain("bc_type").isin(*SURFACE_FACE_TYPES) & (F.col("n_faces") > 0))


def surface_sections(sections: DataFrame, elements: DataFrame) -> DataFrame:
    """Sections (zone_id, sec_id, elem_type, ...) of triangles or quads, or mixed ones that hold nothing else.

    elements: (zone_id, sec_id, elem_type), each element's own type.
    """
    kinds = elements.groupBy("zone_id", "sec_id").agg(F.min(F.col("elem_type").isin(*SURFACE_ELEMENTS)).alias("__flat"))
    met = sections.join(kinds, ["zone_id", "sec_id"], "left")
    return met.filter(F.col("elem_type").isin(*SURFACE_ELEMENTS) | ((F.col("elem_type") == MIXED) & F.coalesce("__flat", F.lit(False)))).drop("__flat")


def section_gaps(sections: DataFrame) -> DataFrame:
    """(zone_id, sec_id, expected, elem_start) of sections that do not begin where the one before ends. A zone's sections
    are few, so a window over a zone will do."""
    before = F.lag("elem_end").over(Window.partitionBy("zone_id").orderBy("elem_start", "sec_id"))
    seen = sections.select("zone_id", "sec_id", (F.coalesce(before, F.lit(0)) + 1).cast("long").alias("expected"), "elem_start")
    return seen.filter(F.col("elem_start") != F.col("expected"))


def default_family(bocos: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """bocos with the family filled in by type where it has none."""
    spark = bocos.sparkSession
    known = spark.createDataFrame(list((table or DEFAULT_FAMILIES).items()), "__type string, __family string")  # a fixed list
    filled = F.coalesce(F.when(F.trim("family") != "", F.col("family")), F.col("__family"))
    return bocos.join(F.broadcast(known), _plain("bc_type") == F.lower("__type"), "left").withColumn("family", filled).drop("__type", "__family")


def missing_families(patches: DataFrame, wanted: DataFrame, name: str = "family") -> DataFrame:
    """The wanted names (name) that no patch has, in lower case."""
    asked = wanted.select(_plain("name").alias("name")).distinct()
    return asked.join(patches.select(_plain(name).alias("name")).distinct(), "name", "left_anti")


def family_select(patches: DataFrame, wanted: DataFrame | None, name: str = "family") -> DataFrame:
    """Patches of the wanted families, names compared without case; all walls where none are asked for."""
    if wanted is None:
        return wall_filter(patches)
    asked = wanted.select(_plain("name").alias("__name")).distinct()
    return patches.join(asked, _plain(name) == F.col("__name"), "left_semi")


def check_selection(patches: DataFrame, wanted: DataFrame, name: str = "family") -> list[str]:
    """The unknown names, for a warning; raises if nothing is selected."""
    if family_select(patches, wanted, name).isEmpty():
        raise ValueError("no surface is selected")
    return sorted(r["name"] for r in missing_families(patches, wanted, name).collect())


def select_surface(faces: DataFrame, patches: DataFrame, wanted: DataFrame | None = None, name: str = "family") -> DataFrame:
    """Faces (face_id, patch_id, nodes) of the patches that form the surface: the named families, or all walls."""
    return faces.join(family_select(patches, wanted, name).select("patch_id"), "patch_id", "left_semi")


def interval_join(rows: DataFrame, key: str, intervals: DataFrame, lo: str, hi: str) -> DataFrame:
    """rows with the intervals lo <= key < hi that hold them.

    An interval lies in buckets as wide as its length rounded up to a power of two, two at most, whatever its length; a
    row asks in its bucket of every width that occurs. No product, and no interval is cut into many.
    """
    size, level, bucket = (fresh(c, rows, intervals) for c in ("size", "level", "bucket"))
    real = intervals.filter(F.col(hi) > F.col(lo)).withColumn(size, (F.col(hi) - F.col(lo)).cast("long"))
    wide = real.withColumn(level, (F.length(F.bin(F.greatest(F.col(size) - 1, F.lit(0)))) - F.when(F.col(size) > 1, 0).otherwise(1)).cast("int")).drop(size)
    width = lambda c: F.pow(F.lit(2.0), F.col(c)).cast("long")
    of = lambda x, c: F.floor(x / width(c))
    cut = wide.withColumn(bucket, F.explode(F.array_distinct(F.array(of(F.col(lo), level), of(F.col(hi) - 1, level)))))
    levels = [r[0] for r in wide.select(level).distinct().collect()]  # 63 at most
    asks = rows.withColumn(level, F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn(bucket, of(F.col(key), level))
    return asks.join(cut, [level, bucket]).filter((F.col(key) >= F.col(lo)) & (F.col(key) < F.col(hi))).drop(level, bucket)


def elem_to_section(elements: DataFrame, sections: DataFrame) -> DataFrame:
    """(elem_id, sec_id): the first section whose range, ends included, holds the element; others are left out."""
    open_ended = sections.select("sec_id", F.col("elem_start").alias("__lo"), (F.col("elem_end") + 1).alias("__hi"))
    return interval_join(elements.select("elem_id"), "elem_id", open_ended, "__lo", "__hi").groupBy("elem_id").agg(F.min("sec_id").alias("sec_id"))


def block_to_instance(blocks: DataFrame, instances: DataFrame) -> DataFrame:
    return interval_join(blocks, "block_id", instances.select("inst_id", "block_lo", "block_hi"), "block_lo", "block_hi").drop("block_lo", "block_hi")


def instance_mask(dofs: DataFrame, instances: DataFrame) -> DataFrame:
    """dofs (dof) with the instance whose half-open range holds them."""
    return interval_join(dofs, "dof", instances.select("inst_id", "dof_lo", "dof_hi"), "dof_lo", "dof_hi").drop("dof_lo", "dof_hi")


def filtered_reindex(nodes: DataFrame) -> DataFrame:
    """(inst_id, node, local_id): distinct surface nodes of each instance, dense from 0 in order."""
    from driftmesh.operators.points import running

    distinct = nodes.select("inst_id", "node").distinct()
    ranked = running(distinct, ["inst_id", "node"], F.lit(1).cast("long"), "__rank")
    first = ranked.groupBy("inst_id").agg(F.min("__rank").alias("__first"))
    return ranked.join(first, "inst_id").select("inst_id", "node", (F.col("__rank") - F.col("__first")).alias("local_id"))


def require(frame: DataFrame, ok, message: str) -> DataFrame:
    """frame, whose job fails with the message on a row that is not ok."""
    return frame.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
