"""Symmetry planes: from patches, made unique, and the mirror images they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.functions.geometry import cross, minus, mirror_point, plane_foot, vector


def mirror_images(points: DataFrame, planes) -> DataFrame:
    """(id columns of points, image, x, y, z): 2^planes rows for each point."""
    others = [c for c in points.columns if c not in "xyz"]
    images = [F.struct(F.lit(k).alias("image"), *[v.alias(c) for v, c in zip(mirror_point(vector("x", "y", "z"), planes, k), "xyz")]) for k in range(1 << len(planes))]
    return points.select(*others, F.explode(F.array(*images)).alias("m")).select(*others, "m.image", "m.x", "m.y", "m.z")


def patch_normals(faces: DataFrame, points: DataFrame) -> DataFrame:
    """(patch_id, nx, ny, nz): the unit mean of unit normals of triangles over each three corners that follow one another
    within a face.

    faces: (face_id, patch_id, nodes); points: (pt_id, x, y, z). Faces are groups of their corners, patches fold by
    partial sums, so a patch of any size is spread over tasks.
    """
    corners = faces.select("patch_id", "face_id", F.posexplode("nodes").alias("pos", "pt_id")).join(points.select("pt_id", "x", "y", "z"), "pt_id")
    grouped = corners.groupBy("patch_id", "face_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z"))).alias("c"))
    three = grouped.filter(F.size("c") >= 3).select("patch_id", "c", F.explode(F.sequence(F.lit(0), F.size("c") - 3)).alias("j"))
    at = lambda k: tuple(F.get("c", F.col("j") + k)[x] for x in "xyz")
    c = cross(minus(at(2), at(1)), minus(at(0), at(1)))
    sized = three.select("patch_id", *[v.alias(f"c{k}") for v, k in zip(c, "xyz")])
    size = F.sqrt(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy") + F.col("cz") * F.col("cz"))
    units = sized.select("patch_id", *[F.try_divide(F.col(f"c{k}"), size).alias(f"n{k}") for k in "xyz"])
    mean = units.groupBy("patch_id").agg(*[F.avg(f"n{k}").alias(f"m{k}") for k in "xyz"])
    length = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz"))
    return mean.select("patch_id", *[F.try_divide(F.col(f"m{k}"), length).alias(f"n{k}") for k in "xyz"])


def unique_planes(planes: list[tuple[tuple[float, float, float], tuple[float, float, float]]]) -> list:
    """The first of each group of one plane, in order, with its point nearest the origin. Dozens at most, on the driver."""
    kept: list = []
    for p, n in planes:
        for q, m in kept:
            d = [a - b for a, b in zip(p, q)]
            out = abs(sum(a * b for a, b in zip(d, m))) * sum(b * b for b in m) ** 0.5 / (sum(a * a for a in d) ** 0.5 + 1e-30)
            if abs(sum(a * b for a, b in zip(n, m))) >= 0.99 and out <= 1e-8:
                break
        else:
            kept.append((tuple(p), tuple(n)))
    return [(tuple(sum(a * b for a, b in zip(p, n)) * c for c in n), n) for p, n in kept]


def plane_feet(planes: DataFrame) -> DataFrame:
    foot = plane_foot(vector("px", "py", "pz"), vector("nx", "ny", "nz"))
    return planes.select("plane_id", *[v.alias(f"f{c}") for v, c in zip(foot, "xyz")], "nx", "ny", "nz")


def derive_planes(patches: DataFrame, faces: DataFrame, points: DataFrame, families: DataFrame | None = None, structured: bool = True) -> list:
    """Planes of the symmetry patches (patch_id, family, bc_type) or of the families named, through the first corner of the
    first face; for structured meshes only."""
    from driftmesh.operators.patches import family_select, symmetry_filter

    if not structured:
        raise ValueError("symmetry planes of an unstructured mesh must be given in the options")
    chosen = symmetry_filter(patches) if families is None else family_select(patches, families)
    own = faces.join(chosen.select("patch_id"), "patch_id", "left_semi")
    first = own.groupBy("patch_id").agg(F.min_by(F.get("nodes", F.lit(0)), "face_id").alias("pt_id")).join(points, "pt_id")
    rows = patch_normals(own, points).join(first, "patch_id").orderBy("patch_id").collect()  # a row a patch
    return unique_planes([((r["x"], r["y"], r["z"]), (r["nx"], r["ny"], r["nz"])) for r in rows if r["nx"] is not None])
