"""One object from a mesh's tables to its warped grid: surface, symmetry planes, orderings, costs, output."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmesh.operators import patches as P
from driftmesh.operators import structured as S
from driftmesh.operators.symmetry import derive_planes
from driftmesh.operators.transfer import flatten, warp_to_solver
from driftmesh.options import WarpOptions
from driftmesh.plans.warp import Warper


@dataclass
class Mesh:
    """volume: (node_id, zone_id, x0, y0, z0) in file order, which is the common ordering; faces: (face_id, patch_id, nodes
    as node_ids); patches: (patch_id, family, bc_type)."""

    volume: DataFrame
    faces: DataFrame
    patches: DataFrame
    options: WarpOptions
    is_structured: bool = False
    solver_map: DataFrame | None = None

    @classmethod
    def structured(cls, volume: DataFrame, zones: DataFrame, bocos: DataFrame, options: WarpOptions) -> Mesh:
        if not S.kind_of(zones):
            raise ValueError("the zones are unstructured")
        ranges = S.patch_ranges(zones, bocos)
        named = P.default_family(ranges).select("patch_id", "family", "bc_type")
        return cls(volume, S.patch_faces(ranges), named, options, True)

    @classmethod
    def unstructured(cls, volume: DataFrame, zones: DataFrame, streams: DataFrame, bocos: DataFrame, options: WarpOptions, sections: DataFrame | None = None) -> Mesh:
        """sections, if given, must follow one another without gaps."""
        if sections is not None and not P.section_gaps(sections).isEmpty():
            raise ValueError("element sections have gaps")
        elements = S.decode_elements(streams)
        kept = P.surface_sections(streams.select("zone_id", "sec_id", "elem_type"), elements).select("zone_id", "sec_id")
        flat = elements.join(F.broadcast(kept), ["zone_id", "sec_id"], "left_semi")
        dense = S.running(bocos.select("zone_id", "boco_id", "family", "bc_type"), ["zone_id", "boco_id"], F.lit(1).cast("long"), "__rank")
        named = dense.select((F.col("__rank") - 1).cast("int").alias("patch_id"), "family", "bc_type")
        return cls(volume, S.boco_faces(bocos, flat, zones), named, options)

    @classmethod
    def cgns(cls, spark: SparkSession, path: str, options: WarpOptions) -> Mesh:
        from driftmesh.sources import cgns

        t = cgns.read(spark, path)
        if S.kind_of(t["zones"]):
            return cls.structured(t["volume"], t["zones"], t["bocos"], options)
        sizes = t["streams"].select("zone_id", "sec_id", "elem_type", "elem_start", F.size("conn").alias("n"))
        decoded = S.decode_elements(t["streams"]).groupBy("zone_id", "sec_id").agg(F.count(F.lit(1)).alias("n_elements"))
        sections = sizes.join(decoded, ["zone_id", "sec_id"]).withColumn("elem_end", F.col("elem_start") + F.col("n_elements") - 1)
        return cls.unstructured(t["volume"], t["zones"], t["streams"], t["bocos"], options, sections)

    @classmethod
    def read(cls, spark: SparkSession, options: WarpOptions) -> Mesh:
        """The mesh of options.grid_file; its kind is options.file_type."""
        if options.grid_file is None:
            raise ValueError("grid_file is not set")
        if options.file_type == "plot3d":
            raise ValueError("a PLOT3D grid has no boundary conditions; give its surface to Warper.from_plot3d")
        return (cls.cgns if options.file_type == "cgns" else cls.openfoam)(spark, options.grid_file, options)

    @classmethod
    def openfoam(cls, spark: SparkSession, case: str, options: WarpOptions) -> Mesh:
        """A polyhedral case, cut up or not: parts follow one another, equal nodes of two parts stay apart."""
        from driftmesh.operators.points import offsets, running
        from driftmesh.sources import openfoam as O

        nodes = O.read_points(spark, case)
        parts = offsets(nodes.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part", "n").select("part", "offset")
        volume = nodes.join(F.broadcast(parts), "part").select((F.col("node") + F.col("offset")).alias("node_id"), F.col("part").alias("zone_id"), *[F.col(c).alias(f"{c}0") for c in "xyz"])
        found = O.surface_faces(O.read_faces(spark, case), O.read_boundary(spark, case)).join(F.broadcast(parts), "part")
        names = found.select("part", "name", "bc_type").distinct()
        dense = running(names, ["part", "name"], F.lit(1).cast("long"), "__rank").select("part", "name", "bc_type", (F.col("__rank") - 1).cast("int").alias("patch_id"))
        moved = found.join(F.broadcast(dense.select("part", "name", "patch_id")), ["part", "name"]).select("part", "face", "patch_id", F.transform("nodes", lambda n: n + F.col("offset")).alias("nodes"))
        faces = running(moved, ["part", "face"], F.lit(1).cast("long"), "__rank").select((F.col("__rank") - 1).alias("face_id"), "patch_id", "nodes")
        # every patch of a surface type counts as a wall of such a case
        return cls(volume, faces, dense.select("patch_id", F.col("name").alias("family"), F.lit("BCWall").alias("bc_type")), options)

    def _names(self, given) -> DataFrame | None:
        return None if given is None else self.volume.sparkSession.createDataFrame([(n,) for n in given], "name string")

    def surface(self) -> DataFrame:
        """Faces of the families that the options name, or of all walls; names that no patch has give a warning."""
        wanted = self._names(self.options.specified_surfaces)
        if wanted is not None:
            unknown = P.check_selection(self.patches, wanted)
            if unknown:
                warnings.warn(f"no patch is called {', '.join(unknown)}", stacklevel=2)
        chosen = P.select_surface(self.faces, self.patches, wanted)
        if chosen.isEmpty():
            raise ValueError("no surface is selected")
        return chosen

    def planes(self) -> tuple:
        """Those that the options give, else those of the symmetry patches; only structured meshes have the latter."""
        if self.options.symmetry_planes is not None:
            return tuple(self.options.symmetry_planes)
        families = self._names(self.options.symmetry_surfaces)
        if not self.is_structured and families is None and P.symmetry_filter(self.patches).isEmpty():
            return ()
        points = self.volume.select(F.col("node_id").alias("pt_id"), *[F.col(f"{c}0").alias(c) for c in "xyz"])
        return tuple(derive_planes(self.patches, self.faces, points, families, self.is_structured))

    def surface_points(self) -> DataFrame:
        """(pt_id, x, y, z) of the nodes that the surface's faces use; a point's id is its node's."""
        used = self.surface().select(F.explode("nodes").alias("node_id")).distinct()
        return self.volume.join(used, "node_id", "left_semi").select(F.col("node_id").alias("pt_id"), *[F.col(f"{c}0").alias(c) for c in "xyz"])

    def warper(self) -> Warper:
        faces = self.surface().select("face_id", "nodes")
        return Warper(self.surface_points(), faces, replace(self.options, symmetry_planes=None), planes=self.planes())

    # orderings

    def set_external_indices(self, solver_map: DataFrame) -> Mesh:
        """solver_map: (solver_dof, common_dof), 0-based; several solver dofs may share one."""
        return replace(self, solver_map=solver_map)

    def common_grid(self, moved: DataFrame | None = None) -> DataFrame:
        """(dof, value) in file order, of the moved nodes or of the mesh as it was read."""
        return flatten(self.volume.select("node_id", *[F.col(f"{c}0").alias(c) for c in "xyz"]) if moved is None else moved)

    warp_grid = common_grid  # rows have no order but their ids', so the warp's own ordering has the same rows

    def solver_grid(self, moved: DataFrame | None = None) -> DataFrame:
        """(solver_dof, value): each solver dof takes its node's value."""
        if self.solver_map is None:
            raise ValueError("set the external indices first")
        return warp_to_solver(self.solver_map, self.common_grid(moved).withColumnRenamed("dof", "common_dof"))

    def costs(self) -> DataFrame:
        """(node_id, denominator, cost), from the restart table that the options name if it fits and verifies."""
        warper = self.warper()
        if self.options.restart_file is None:
            return warper.costs(self.volume)
        from driftmesh.sources.restart import cached_costs

        return cached_costs(warper, self.volume, self.options.restart_file)
