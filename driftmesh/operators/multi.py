"""Several components that warp on their own, over one volume: instances, background and overlay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.operators.patches import block_to_instance, filtered_reindex
from driftmesh.operators.transfer import flatten, warp_to_solver
from driftmesh.options import WarpOptions
from driftmesh.plans.warp import Warper


@dataclass
class Component:
    name: str
    warper: Warper
    deform: object = None


def overlay(default: DataFrame, moved: DataFrame) -> DataFrame:
    """(node_id, x, y, z): the moved position where a node has one, else that of the default grid (node_id, x0, y0, z0)."""
    m = moved.select("node_id", *[F.col(c).alias(f"m{c}") for c in "xyz"])
    return default.join(m, "node_id", "left").select("node_id", *[F.coalesce(f"m{c}", f"{c}0").alias(c) for c in "xyz"])


class MultiWarper:
    """Components by name over a volume (node_id, instance, x0, y0, z0); nodes of other instances stay in place.

    All components run in one job: their frames are branches of one union, not a loop of actions.
    """

    def __init__(self, components: list[Component]):
        names = [c.name.strip().lower() for c in components]
        if len(set(names)) != len(names):
            raise ValueError("component names differ, whatever their case")
        self.components = dict(zip(names, components))

    def _own(self, volume: DataFrame, name: str) -> DataFrame:
        return volume.filter(F.lower(F.trim("instance")) == name)

    def _rest(self, volume: DataFrame) -> DataFrame:
        return volume.filter(~F.coalesce(F.lower(F.trim("instance")).isin(*self.components), F.lit(False)))

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def warp(self, volume: DataFrame) -> DataFrame:
        moved = [c.warper.warp(self._own(volume, n), c.deform) for n, c in self.components.items()]
        return self._union([*moved, self._rest(volume).select("node_id", *[F.col(f"{c}0").alias(c) for c in "xyz"])])

    def solver_grid(self, volume: DataFrame) -> DataFrame:
        """The default grid with the components' moved nodes laid over it."""
        return overlay(volume, self._union([c.warper.warp(self._own(volume, n), c.deform) for n, c in self.components.items()]))

    def jvp(self, volume: DataFrame, tangents: dict[str, DataFrame]) -> DataFrame:
        """Zero for the background and for components without a tangent."""
        parts = [c.warper.jvp(self._own(volume, n), c.deform, tangents[n]) for n, c in self.components.items() if n in tangents]
        still = volume.filter(~F.coalesce(F.lower(F.trim("instance")).isin(*tangents), F.lit(False))) if tangents else volume
        return self._union([*parts, still.select("node_id", *[F.lit(0.0).alias(f"d{c}") for c in "xyz"])])

    def vjp(self, volume: DataFrame, seeds: DataFrame) -> DataFrame:
        """(pt_id, dx, dy, dz): products of all components, added where they share surface points."""
        parts = [c.warper.vjp(self._own(volume, n), c.deform, seeds) for n, c in self.components.items()]
        return self._union(parts).groupBy("pt_id").agg(*[F.sum(f"d{c}").alias(f"d{c}") for c in "xyz"])


class MultiMesh:
    """Instances over the zones of one volume, each with a surface and options of its own; others are background.

    volume: (node_id, zone_id, x0, y0, z0); instances: (inst_id, name, block_lo, block_hi), half-open ranges of zones;
    options: by the names of the instances that are warped. The external indices come before the surface.
    """

    def __init__(self, volume: DataFrame, instances: DataFrame, options: dict[str, WarpOptions], planes=()):
        rows = [(r["inst_id"], r["name"].strip().lower()) for r in instances.select("inst_id", "name").orderBy("inst_id").collect()]  # a row an instance
        self.options = {name.strip().lower(): o for name, o in options.items()}
        unknown = set(self.options) - {name for _, name in rows}
        if unknown:
            raise ValueError(f"no instance is called {', '.join(sorted(unknown))}")
        self.ids = {name: inst_id for inst_id, name in rows if name in self.options}
        self.instances, self.planes = instances, planes
        named = instances.select("inst_id", F.lower(F.trim("name")).alias("instance"))
        held = block_to_instance(volume.withColumn("block_id", F.col("zone_id")), instances).join(F.broadcast(named), "inst_id").select("node_id", "instance")
        self.volume = volume.join(held, "node_id", "left")
        self.solver_map = self.points = self.faces = self.warper = None

    def set_external_indices(self, solver_map: DataFrame) -> None:
        """(solver_dof, common_dof) of all instances in one numbering."""
        self.solver_map = solver_map

    def split_faces(self, faces: DataFrame) -> DataFrame:
        """(inst_id, face_id, nodes): faces (face_id, block_id, nodes) by the instance that their block belongs to."""
        return block_to_instance(faces, self.instances).select("inst_id", "face_id", "nodes")

    def local_points(self, faces: DataFrame) -> DataFrame:
        """(inst_id, node, local_id): the surface's points of each instance, dense from 0, beside their full ids."""
        return filtered_reindex(self.split_faces(faces).select("inst_id", F.explode("nodes").alias("node")))

    def set_surface(self, points: DataFrame, faces: DataFrame) -> None:
        """points: (pt_id, x, y, z) of all instances; faces: (face_id, block_id, nodes as pt_ids)."""
        if self.solver_map is None:
            raise NameError("set the external indices before the surface")
        split = self.split_faces(faces)
        self.points = points.select("pt_id", "x", "y", "z")
        parts = []
        for name, inst_id in self.ids.items():
            own = split.filter(F.col("inst_id") == inst_id)
            used = own.select(F.explode("nodes").alias("pt_id")).distinct()
            parts.append(Component(name, Warper(points.join(used, "pt_id", "left_semi"), own.select("face_id", "nodes"), self.options[name], self.planes)))
        self.warper = MultiWarper(parts)
        self.set_coordinates(self.points)

    def coordinates(self) -> DataFrame:
        """(pt_id, x, y, z) of all points as they are now."""
        return self.points

    def set_coordinates(self, points: DataFrame) -> None:
        """New positions of all points, of every instance in one table."""
        self.points = points.select("pt_id", "x", "y", "z")
        for c in self.warper.components.values():
            own = c.warper.points_frame().select("pt_id")
            c.deform = self.points.join(F.broadcast(own), "pt_id", "left_semi")

    def warp(self) -> DataFrame:
        return self.warper.warp(self.volume)

    def warp_grids(self) -> tuple[dict[str, DataFrame], int]:
        """The moved (dof, value) of each instance that is warped, and the number of dofs of them all."""
        moved = self.warp().join(self.volume.select("node_id", "instance"), "node_id")
        grids = {name: flatten(moved.filter(F.col("instance") == name)) for name in self.ids}
        return grids, 3 * self.volume.filter(F.col("instance").isin(*self.ids)).count()

    def solver_grid(self) -> DataFrame:
        """(solver_dof, value): the whole grid with the instances laid over it, in the solver's numbering."""
        return warp_to_solver(self.solver_map, flatten(self.warper.solver_grid(self.volume)).withColumnRenamed("dof", "common_dof"))

    def jvp(self, tangent: DataFrame) -> DataFrame:
        """tangent: (pt_id, dx, dy, dz) of all points; zero for the background."""
        parts = {n: tangent.join(F.broadcast(c.warper.points_frame().select("pt_id")), "pt_id", "left_semi") for n, c in self.warper.components.items()}
        return self.warper.jvp(self.volume, parts)

    def vjp(self, seeds: DataFrame) -> DataFrame:
        """(pt_id, dx, dy, dz), added over instances."""
        return self.warper.vjp(self.volume, seeds)
