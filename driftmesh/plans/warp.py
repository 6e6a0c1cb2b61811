"""Warping volume nodes by a moving surface, and the products of the warp's derivative.

The surface, of bounded and checked size, is prepared on the driver and broadcast; volume nodes stream through Arrow
kernels without a shuffle. The transposed product sends one block of partial sums per task to a small aggregation.
Surfaces beyond the bound go through blocked_warp, which sums over blocks of the surface instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmesh.functions.geometry import EPS_KERNEL
from driftmesh.operators.common import spread
from driftmesh.options import WarpOptions
from driftmesh.plans import kernels as K
from driftmesh.plans.nodal import Surface

#: Surface nodes that are prepared on the driver and broadcast: some 400 bytes each with rotations.
MOST_SURFACE = 2_000_000
#: Points of a tree whose error profile is worked out on the driver; that of a larger one is dealt over tasks.
SMALL_TREE = 20_000
#: Values of the columns of all cases that verify() broadcasts at a time.
MOST_COLUMN_VALUES = 1 << 24
#: Positions that a kernel takes at a time, if a task has so many: the more, the closer together are those of a group.
GATHERED = 1 << 18
#: Surface nodes whose sums of the transposed product make a row.
SUMS_ROW = 1 << 13
#: Rows of a table of the surface's size that go into a plan; more are broadcast, as the driver holds what a plan has.
PLAN_ROWS = 1 << 16

Planes = tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]


class SurfaceTooLarge(ValueError):
    pass


def _array(df: DataFrame, key: str, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and the columns beside them, of a table known to be small."""
    table = df.select(F.col(key).cast("long").alias(key), *[F.col(c).cast("double").alias(c) for c in columns]).toArrow().sort_by(key)
    return table[key].to_numpy(), np.stack([table[c].to_numpy() for c in columns], axis=1) if table.num_rows else np.zeros((0, len(columns)))


def _volume(volume: DataFrame) -> DataFrame:
    """(node_id, x0, y0, z0) over as many tasks as run at a time: a node costs a sum over the surface."""
    return spread(volume.select(F.col("node_id").cast("long").alias("node_id"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "z0")]))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of GATHERED rows or somewhat more, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= GATHERED:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _frame(kernel, names: list[str]):
    """An Arrow map from (node_id, positions, more) to (node_id, results)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            if batch.num_rows:
                values = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns)], axis=1)
                out = kernel(values)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(out[:, i])) for i in range(out.shape[1])]], names=names)

    return run


def _local(spark, **columns: np.ndarray) -> DataFrame:
    """A DataFrame of arrays of the driver: longs, else doubles."""
    n = len(next(iter(columns.values())))
    if n <= PLAN_ROWS:
        return spark.createDataFrame(pa.table(columns))
    shared = spark.sparkContext.broadcast(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                own = slice(part * PLAN_ROWS, (part + 1) * PLAN_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[own])) for c in shared.value.values()], names=list(shared.value))

    schema = ", ".join(f"{name} {'long' if c.dtype.kind == 'i' else 'double'}" for name, c in columns.items())
    parts = -(-n // PLAN_ROWS)
    return spark.range(0, parts, 1, parts).mapInArrow(run, schema)


class Warper:
    """A prepared surface. points: (pt_id, x, y, z); faces: (face_id, nodes as pt_ids); planes: (point, unit normal)."""

    def __init__(self, points: DataFrame, faces: DataFrame, options: WarpOptions | None = None, planes: Planes | None = None, most_surface: int = MOST_SURFACE):
        self.options = o = options or WarpOptions()
        self.spark = points.sparkSession
        self.planes = tuple(planes if planes is not None else o.symmetry_planes or ())
        n = points.count()
        if n > most_surface:
            raise SurfaceTooLarge(f"{n} surface points, {most_surface} at most; use blocked_warp")
        self.pt_ids, xyz = _array(points, "pt_id", ["x", "y", "z"])
        faces = faces.select("face_id", "nodes").persist()  # else the joins behind it run for the count and again
        try:
            n = faces.count()
            if n > 4 * most_surface:
                raise SurfaceTooLarge(f"{n} surface faces, {4 * most_surface} at most; use blocked_warp")
            nodes = pa.concat_arrays([pa.array([], pa.list_(pa.int64())), *faces.toArrow().sort_by("face_id")["nodes"].cast(pa.list_(pa.int64())).chunks])
        finally:
            faces.unpersist()
        if nodes.null_count or nodes.flatten().null_count:
            raise ValueError("a face has nodes, and none is null")
        polygons = np.diff(nodes.offsets.to_numpy()), self._places(nodes.flatten().to_numpy())
        self.surface = Surface.build(xyz, polygons, o.use_rotations, o.corner_angle if o.zero_corner_rotations else None)
        self._prepare()

    @classmethod
    def from_areas(cls, points: DataFrame, areas: np.ndarray | None = None, options: WarpOptions | None = None, planes: Planes | None = None, most_surface: int = MOST_SURFACE) -> Warper:
        """A surface of points without faces: each node has the given area, one by default; no rotations."""
        self = cls.__new__(cls)
        self.options, self.spark = options or WarpOptions(use_rotations=False), points.sparkSession
        self.planes = tuple(planes if planes is not None else self.options.symmetry_planes or ())
        n = points.count()
        if n > most_surface:
            raise SurfaceTooLarge(f"{n} surface points, {most_surface} at most; use blocked_warp")
        self.pt_ids, xyz = _array(points, "pt_id", ["x", "y", "z"])
        self.surface = Surface.build(xyz, [], False, None)
        given = np.ones(len(xyz)) if areas is None else areas
        self.surface.area = given[self.surface.rep]
        self.surface.free = self.surface.area == 0
        self._prepare()
        return self

    @classmethod
    def from_plot3d(cls, spark, path: str, options: WarpOptions | None = None, planes: Planes | None = None) -> Warper:
        """The surface of a PLOT3D surface file, in the file's orientation."""
        from driftmesh.sources.plot3d import read_surface

        points, faces = read_surface(spark, path)
        return cls(points, faces, options, planes)

    def _prepare(self) -> None:
        o, s = self.options, self.surface
        self.weights = K.Weights(s.ldef0 * o.ldef_fact, o.a_exp, o.b_exp, o.alpha)
        self._profiled = False
        #: Of a large surface in the exact mode: its sums go by clusters, and over their order.
        self.clusters = K.Clusters(s.xu0, s.area, None, self.weights, EPS_KERNEL) if o.eval_mode != "fast" and len(s.xu0) >= K.MANY else None

    @cached_property
    def tree(self) -> K.Tree | None:
        s = self.surface
        return K.build_tree(s.xu0, s.area, self.weights, self.options.bucket_size, errors=False) if len(s.xu0) else None

    @cached_property
    def order(self) -> np.ndarray:
        """Nodes in the order of the tree, as x and area have them."""
        return self.tree.order if self.tree else np.zeros(0, np.int64)

    @cached_property
    def x(self) -> np.ndarray:
        return self.surface.xu0[self.order]

    @cached_property
    def area(self) -> np.ndarray:
        return self.surface.area[self.order]

    @property
    def summed_order(self) -> np.ndarray:
        """Nodes in the order in which their columns are summed."""
        return self.order if self.clusters is None else self.clusters.order

    def _places(self, ids: np.ndarray) -> np.ndarray:
        """Where points of these ids stand."""
        at = np.searchsorted(self.pt_ids, ids, side="right") - 1
        found = at >= 0
        found[found] = self.pt_ids[at[found]] == ids[found]
        if not found.all():
            raise KeyError(int(ids[~found][0]))
        return at

    # shared by the kernels

    def _profile(self) -> None:
        """The tree's errors, once, for those who use them; in the exact mode they stay zero."""
        t = self.tree
        if self._profiled or t is None or self.options.eval_mode != "fast":
            return
        self._profiled = True
        inner = np.flatnonzero(t.left >= 0)
        with np.errstate(divide="ignore"):
            known = t.l, t.u, t.centre, 1 / t.inv_r, t.area, self.x, self.area, self.weights
        if len(self.x) <= SMALL_TREE or not len(inner):
            t.err[inner] = K.profile(inner, *known)
            return
        shared, parts = self.spark.sparkContext.broadcast((inner, known)), 4 * self.spark.sparkContext.defaultParallelism

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            inner, known = shared.value
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    mine = inner[part::parts]
                    err = K.profile(mine, *known)
                    yield pa.RecordBatch.from_arrays([pa.array(mine), *[pa.array(np.ascontiguousarray(c)) for c in err.T]], names=names)

        names = ["node", *[f"e{k}" for k in range(t.err.shape[1])]]
        table = self.spark.range(0, parts, 1, parts).mapInArrow(run, "node long, " + ", ".join(f"{c} double" for c in names[1:])).toArrow()  # a row a node
        t.err[table["node"].to_numpy()] = np.stack([table[c].to_numpy() for c in names[1:]], axis=1)

    def _positions(self, deform: DataFrame | Callable[[DataFrame], DataFrame] | None, dtype=float) -> np.ndarray:
        """Coordinates of the unique nodes after a deformation; of the surface as built without one."""
        if deform is None:
            return self.surface.xu0
        if callable(deform):
            deform = deform(self.points_frame())
        # no more than one row beyond the surface is collected
        ids, xyz = _array(deform.limit(len(self.pt_ids) + 1), "pt_id", ["x", "y", "z"])
        if not np.array_equal(ids, self.pt_ids):
            raise ValueError("a deformation has the points of the surface, each once")
        return xyz[self.surface.rep]

    def points_frame(self) -> DataFrame:
        x = self.surface.xu0[self.surface.link]
        return _local(self.spark, pt_id=self.pt_ids, x=x[:, 0], y=x[:, 1], z=x[:, 2])

    def _motion_columns(self, xu: np.ndarray, dxu: np.ndarray | None = None, step: float | None = None) -> np.ndarray:
        """Columns of a motion, of its tangent along dxu, or of a complex motion's imaginary part over a step; the ones last."""
        turns = self.options.use_rotations
        out = np.ones((len(self.surface.xu0), 13 if turns else 4))
        for at, m, b in self.surface.motions(xu, dxu, self.summed_order):
            if step is not None:
                m, b = m.imag / step, b.imag / step
            if turns:
                out[at, :9] = m.reshape(-1, 9)
            out[at, -4:-1] = b
        return out

    def _evaluator(self, columns: np.ndarray, motion: bool):
        """positions -> (displacement, denominator); motion: subtract the position that rotations add. Columns of several
        cases, the ones last, give three columns of displacements a case from weights computed once."""
        weights, planes, o = self.weights, self.planes, self.options
        fast = o.eval_mode == "fast" and self.tree is not None and self.tree.left[0] >= 0
        if fast:
            self._profile()
        turns, width, cases = o.use_rotations, 12 if o.use_rotations else 3, columns.shape[1] // (12 if o.use_rotations else 3)
        if self.clusters is not None:
            shared = self.spark.sparkContext.broadcast(self.clusters.holding(columns))
        else:
            shared = self.spark.sparkContext.broadcast((self.x, self.area, self.tree if fast else None, columns, K.node_means(self.tree, columns) if fast else None))
        err_tol = o.err_tol

        def summing(images: list[np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
            if isinstance(shared.value, K.Clusters):
                return shared.value.sums
            x, area, tree, columns, means = shared.value
            if tree is None:
                return lambda p: K.exact_sums(p, x, area, columns, weights)
            tol = err_tol * sum(K.estimate_denominators(tree, x, area, p, weights) for p in images)
            return lambda p: K.fast_sums(tree, p, x, area, columns, means, weights, tol)

        def evaluate(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            images = [K.mirror_points(r, planes, k) for k in range(1 << len(planes))]
            of = summing(images)
            num, den = np.zeros((len(r), 3 * cases)), np.zeros(len(r))
            for k, p in enumerate(images):
                sums = of(p)
                w = sums[:, -1]
                for case in range(cases):
                    mine = sums[:, case * width : (case + 1) * width]
                    if turns:
                        part = np.einsum("qij,qj->qi", mine[:, :9].reshape(-1, 3, 3), p) + mine[:, 9:12]
                        if motion:
                            part = part - w[:, None] * p
                    else:
                        part = mine
                    num[:, 3 * case : 3 * case + 3] += K.mirror_vectors(part, planes, k)
                den += w
            return np.divide(num, den[:, None], out=np.zeros_like(num), where=den[:, None] > 0), den

        return evaluate

    # the warp

    def warp(self, volume: DataFrame, deform: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(node_id, x, y, z): volume nodes (node_id, x0, y0, z0) moved along with the surface."""
        evaluate = self._evaluator(self._motion_columns(self._positions(deform)), True)
        rows = _volume(volume)
        return rows.mapInArrow(_frame(lambda r: r + evaluate(r)[0], ["node_id", "x", "y", "z"]), "node_id long, x double, y double, z double")

    def warp_many(self, volume: DataFrame, deforms: dict[str, DataFrame]) -> DataFrame:
        """(case, node_id, x, y, z) of several deformations in one pass: weights are computed once for all."""
        names = list(deforms)
        turns = self.options.use_rotations
        if turns or self.options.eval_mode == "fast" or self.clusters is not None:
            parts = [self.warp(volume, deforms[n]).withColumn("case", F.lit(n)) for n in names]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out.select("case", "node_id", "x", "y", "z")
        blocks = [self._motion_columns(self._positions(deforms[n])) for n in names]
        columns = np.concatenate([*[b[:, :3] for b in blocks], blocks[0][:, 3:]], axis=1)
        x, area, weights, planes = self.x, self.area, self.weights, self.planes

        def run(batches):
            for batch in batches:
                r = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)], axis=1)
                total = np.zeros((len(r), columns.shape[1]))
                for k in range(1 << len(planes)):
                    sums = K.exact_sums(K.mirror_points(r, planes, k), x, area, columns, weights)
                    for c in range(len(names)):
                        sums[:, 3 * c : 3 * c + 3] = K.mirror_vectors(sums[:, 3 * c : 3 * c + 3], planes, k)
                    total += sums
                for c, name in enumerate(names):
                    moved = r + total[:, 3 * c : 3 * c + 3] / total[:, -1:]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(r)), batch.column(0), *[pa.array(np.ascontiguousarray(moved[:, i])) for i in range(3)]], names=["case", "node_id", "x", "y", "z"])

        rows = _volume(volume)
        return rows.mapInArrow(run, "case string, node_id long, x double, y double, z double")

    def denominators(self, volume: DataFrame, estimate: bool = False) -> DataFrame:
        """(node_id, denominator): the sum of weights over the surface and its mirror images."""
        weights, planes = self.weights, self.planes
        clusters = None if estimate else self.clusters
        x, area, tree = (None, None, None) if clusters is not None else (self.x, self.area, self.tree)

        def kernel(r):
            den = np.zeros(len(r))
            for k in range(1 << len(planes)):
                p = K.mirror_points(r, planes, k)
                den += clusters.sums(p)[:, 0] if clusters is not None else K.estimate_denominators(tree, x, area, p, weights) if estimate else K.exact_sums(p, x, area, np.ones((len(x), 1)), weights)[:, 0]
            return den[:, None]

        rows = _volume(volume)
        return rows.mapInArrow(_frame(kernel, ["node_id", "denominator"]), "node_id long, denominator double")

    def costs(self, volume: DataFrame) -> DataFrame:
        """(node_id, denominator, cost): a dry run of the fast kernel, cost in shares of an exact evaluation."""
        self._profile()
        x, area, tree, weights, planes, tol = self.x, self.area, self.tree, self.weights, self.planes, self.options.err_tol

        def kernel(r):
            images = [K.mirror_points(r, planes, k) for k in range(1 << len(planes))]
            den = sum(K.estimate_denominators(tree, x, area, p, weights) for p in images)
            cost = sum(K.costs(tree, p, tol * den) for p in images) / len(x)
            return np.stack([den, cost], axis=1)

        rows = _volume(volume)
        return rows.mapInArrow(_frame(kernel, ["node_id", "denominator", "cost"]), "node_id long, denominator double, cost double")

    # derivatives

    def jvp(self, volume: DataFrame, deform, tangent: DataFrame) -> DataFrame:
        """(node_id, dx, dy, dz): the derivative of the warp at a deformation, times surface motions (pt_id, dx, dy, dz)."""
        ids, d = _array(tangent, "pt_id", ["dx", "dy", "dz"])
        if not np.array_equal(ids, self.pt_ids):
            raise ValueError("a tangent has the points of the surface, each once")
        evaluate = self._evaluator(self._motion_columns(self._positions(deform), d[self.surface.rep]), False)
        rows = _volume(volume)
        return rows.mapInArrow(_frame(lambda r: evaluate(r)[0], ["node_id", "dx", "dy", "dz"]), "node_id long, dx double, dy double, dz double")

    def vjp(self, volume: DataFrame, deform, seeds: DataFrame) -> DataFrame:
        """(pt_id, dx, dy, dz): seeds on volume nodes (node_id, vx, vy, vz) times the derivative, on the surface's points.

        Seeds without a row count as zero. Of coincident points only the first receives a value.
        """
        weights, planes, o = self.weights, self.planes, self.options
        fast, turns = o.eval_mode == "fast" and self.tree is not None and self.tree.left[0] >= 0, o.use_rotations
        if fast:
            self._profile()
        n, order = len(self.surface.xu0), self.summed_order
        width, err_tol = 12 if turns else 3, o.err_tol
        shared = self.spark.sparkContext.broadcast((self.x, self.area, self.tree) if self.clusters is None else self.clusters)

        def kernels(images: list[np.ndarray]) -> tuple[Callable, Callable]:
            """(positions -> denominators, positions and seeds -> sums for each node)."""
            if isinstance(shared.value, K.Clusters):
                return shared.value.sums, shared.value.transposed
            x, area, tree = shared.value
            one = np.ones((n, 1))
            if not fast:
                return lambda p: K.exact_sums(p, x, area, one, weights), lambda p, seeds: K.transposed_sums(p, seeds, x, area, weights)
            tol = err_tol * sum(K.estimate_denominators(tree, x, area, p, weights) for p in images)
            return lambda p: K.fast_sums(tree, p, x, area, one, np.ones((len(tree.l), 1)), weights, tol), lambda p, seeds: K.fast_transposed(tree, p, seeds, x, area, weights, tol)

        def columns(s: np.ndarray, p: np.ndarray) -> np.ndarray:
            return np.concatenate([(s[:, :, None] * p[:, None, :]).reshape(-1, 9), s], axis=1) if turns else s

        def shares(v: np.ndarray, den: np.ndarray) -> np.ndarray:
            return np.divide(v, den[:, None], out=np.zeros_like(v), where=den[:, None] > 0)

        def rows_of(total: np.ndarray, part: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([total[part * SUMS_ROW : (part + 1) * SUMS_ROW].tobytes()])], names=["part", "sums"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n, width))
            for batch in gathered(batches):
                values = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)], axis=1)
                r, v = values[:, :3], values[:, 3:]
                if isinstance(shared.value, K.Clusters) and not planes:  # one image: its weights serve both sums
                    total += shared.value.transposed(r, lambda places, sums: columns(shares(v[places], sums[:, 0]), r[places]), width)
                    continue
                images = [K.mirror_points(r, planes, k) for k in range(1 << len(planes))]
                denominators, transposed = kernels(images)
                s = shares(v, sum(denominators(p)[:, 0] for p in images))
                for k, p in enumerate(images):
                    total += transposed(p, columns(K.mirror_vectors(s, planes, k, reverse=True), p))
            for part in range(-(-n // SUMS_ROW)):
                if total[part * SUMS_ROW : (part + 1) * SUMS_ROW].any():
                    yield rows_of(total, part)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                    found = np.frombuffer(sums.as_buffer())
                    totals[part] = totals[part] + found if part in totals else found.copy()
            for part, sums in totals.items():
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([sums.tobytes()])], names=["part", "sums"])

        rows = _volume(volume).join(seeds.select("node_id", "vx", "vy", "vz"), "node_id").select("x0", "y0", "z0", "vx", "vy", "vz")
        schema, slots = "part long, sums binary", self.spark.sparkContext.defaultParallelism
        summed = rows.mapInArrow(run, schema).repartition(max(1, min(slots, -(-n // SUMS_ROW))), "part").mapInArrow(add, schema)
        acc = np.zeros((n, width))
        for part, sums in summed.toLocalIterator():  # a row of bounded size for SUMS_ROW nodes
            acc[order[part * SUMS_ROW : (part + 1) * SUMS_ROW]] = np.frombuffer(sums).reshape(-1, width)
        mbar = acc[:, :9].reshape(-1, 3, 3) if turns else np.zeros((n, 3, 3))
        xbar = self.surface.motion_adjoint(self._positions(deform), mbar, acc[:, -3:])
        out = np.zeros((len(self.pt_ids), 3))
        out[self.surface.rep] = xbar
        return _local(self.spark, pt_id=self.pt_ids, dx=out[:, 0], dy=out[:, 1], dz=out[:, 2])

    def complex_step(self, volume: DataFrame, deform, tangent: DataFrame, h: float = 1e-40) -> DataFrame:
        """(node_id, dx, dy, dz) as jvp gives, by a step of size h along the imaginary axis. Weights are real, so sums of the
        motion's imaginary part are the imaginary part of its sums."""
        _, d = _array(tangent, "pt_id", ["dx", "dy", "dz"])
        xu = self._positions(deform) + 1j * h * d[self.surface.rep]
        evaluate = self._evaluator(self._motion_columns(xu, step=h), False)
        rows = _volume(volume)
        return rows.mapInArrow(_frame(lambda r: evaluate(r)[0], ["node_id", "dx", "dy", "dz"]), "node_id long, dx double, dy double, dz double")

    def verify(self, volume: DataFrame, deform: DataFrame, seeds: DataFrame, dof_start: int = 0, dof_end: int = 10, h: float = 1e-6) -> DataFrame:
        """(dof, ad, fd, err_pct): the transposed product against central differences, for some surface dofs."""
        ad = _array(self.vjp(volume, deform, seeds), "pt_id", ["dx", "dy", "dz"])[1].ravel()
        base = _array(deform, "pt_id", ["x", "y", "z"])[1]
        dofs = range(max(0, dof_start), min(dof_end, base.size))
        steps = [(dof, sign * h) for dof in dofs for sign in (1, -1)]
        seeded = _volume(volume).join(seeds.select("node_id", "vx", "vy", "vz"), "node_id").select("x0", "y0", "z0", "vx", "vy", "vz")

        def work(steps: list[tuple[int, float]]) -> np.ndarray:
            """The seeds' products with the motions of the steps, weights computed once for all."""
            blocks = []
            for dof, step in steps:
                moved = base.copy()
                moved.ravel()[dof] += step
                blocks.append(self._motion_columns(moved[self.surface.rep]))
            evaluate = self._evaluator(np.concatenate([*[b[:, :-1] for b in blocks], blocks[0][:, -1:]], axis=1), True)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        values = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)], axis=1)
                        motion = evaluate(values[:, :3])[0].reshape(len(values), -1, 3)
                        sums = np.einsum("qcj,qj->c", motion, values[:, 3:])
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["case", "value"])

            got = seeded.mapInArrow(run, "case long, value double").groupBy("case").agg(F.sum("value").alias("value")).toArrow()
            out = np.zeros(len(steps))
            out[got["case"].to_numpy()] = got["value"].to_numpy()
            return out

        most = max(1, MOST_COLUMN_VALUES // max(1, len(self.surface.xu0)) // (12 if self.options.use_rotations else 3))
        found = np.concatenate([np.zeros(0), *[work(steps[at : at + most]) for at in range(0, len(steps), most)]]).reshape(-1, 2)
        rows = []
        for dof, values in zip(dofs, found):
            fd = (values[0] - values[1]) / (2 * h)
            mean = 0.5 * (fd + ad[dof])
            rows.append((dof, float(ad[dof]), float(fd), float((fd - ad[dof]) / mean * 100) if mean else 0.0))
        return self.spark.createDataFrame(rows, "dof long, ad double, fd double, err_pct double")

    # tables

    def nodal_frame(self) -> DataFrame:
        """(u_id, rep_pt_id, x0, y0, z0, a, nx, ny, nz, is_corner) of the unique nodes."""
        s = self.surface
        return self.spark.createDataFrame(pa.table({
            "u_id": np.arange(len(s.xu0)), "rep_pt_id": self.pt_ids[s.rep], "x0": s.xu0[:, 0], "y0": s.xu0[:, 1], "z0": s.xu0[:, 2], "a": s.area,
            "nx": s.normals0[:, 0], "ny": s.normals0[:, 1], "nz": s.normals0[:, 2], "is_corner": s.corner,
        }))

    def tree_sizes(self) -> DataFrame:
        """(level, n) of the tree's nodes."""
        return self.spark.createDataFrame(pa.table({"level": self.tree.level.astype(np.int32), "n": (self.tree.u - self.tree.l).astype(np.int32)}))

    def tree_frame(self) -> DataFrame:
        self._profile()
        t = self.tree
        ids = np.arange(len(t.l))
        return self.spark.createDataFrame(pa.table({
            "node_id": ids.astype(np.int32), "parent_id": t.parent.astype(np.int32), "left_id": t.left.astype(np.int32), "right_id": t.right.astype(np.int32), "level": t.level.astype(np.int32),
            "l": t.l.astype(np.int32), "u": (t.u - 1).astype(np.int32), "n": (t.u - t.l).astype(np.int32), "cx": t.centre[:, 0], "cy": t.centre[:, 1], "cz": t.centre[:, 2],
            "inv_r": np.where(np.isfinite(t.inv_r), t.inv_r, 0.0), "a": t.area, "err": pa.array(list(t.err), pa.list_(pa.float64())),
        }))


def blocked_warp(volume: DataFrame, surface: DataFrame, ldef: float, options: WarpOptions, planes: Planes = (), block_rows: int = 200_000) -> DataFrame:
    """The exact warp for a surface of any size: surface (x0, y0, z0, a, m11..m33, b1..b3) is taken in blocks of bounded
    size by id, each broadcast in turn; partial sums of a node meet in one aggregate. Needs u_id, dense from 0."""
    from driftmesh.operators.common import materialize

    spark = volume.sparkSession
    weights = K.Weights(ldef, options.a_exp, options.b_exp, options.alpha)
    last = surface.agg(F.max("u_id")).first()[0]
    names = [f"m{i}{j}" for i in "123" for j in "123"] + ["b1", "b2", "b3"]
    rows = _volume(volume)
    total = None
    for at in range(0, (-1 if last is None else last) + 1, block_rows):
        _, part = _array(surface.filter((F.col("u_id") >= at) & (F.col("u_id") < at + block_rows)), "u_id", ["x0", "y0", "z0", "a", *names])
        shared = spark.sparkContext.broadcast(part)

        def kernel(r, shared=shared):
            part = shared.value
            columns = np.concatenate([part[:, 4:], np.ones((len(part), 1))], axis=1)
            num, den = np.zeros(r.shape), np.zeros((len(r), 1))
            for k in range(1 << len(planes)):
                p = K.mirror_points(r, planes, k)
                sums = K.exact_sums(p, part[:, :3], part[:, 3], columns, weights)
                num += K.mirror_vectors(np.einsum("qij,qj->qi", sums[:, :9].reshape(-1, 3, 3), p) + sums[:, 9:12] - sums[:, 12:] * p, planes, k)
                den += sums[:, 12:]
            return np.concatenate([num, den], axis=1)

        partial = materialize(rows.mapInArrow(_frame(kernel, ["node_id", "nx", "ny", "nz", "den"]), "node_id long, nx double, ny double, nz double, den double"), "partial")
        total = partial if total is None else total.unionByName(partial)
    if total is None:
        return rows.select("node_id", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("z0").alias("z"))
    sums = total.groupBy("node_id").agg(*[F.sum(c).alias(c) for c in ("nx", "ny", "nz", "den")])
    moved = [(F.col(f"{c}0") + F.coalesce(F.try_divide(F.col(f"n{c}"), F.col("den")), F.lit(0.0))).alias(c) for c in "xyz"]
    return rows.join(sums, "node_id").select("node_id", *moved)
