"""Numeric kernels over blocks of volume nodes: exact sums, the pruned tree, and their transposes.

A block is an array of positions (q, 3). `source` holds one row per surface node, in tree order. Weights depend on
original positions only, so denominators and areas are fixed; rotations and offsets change from warp to warp.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass, field

import numpy as np

from driftmesh.functions.geometry import EPS_KERNEL, ERROR_KNOTS

#: The number that places most sample points of the error profile (they lie off the sphere, as the profile
#: expects), the ratio beyond which the estimate takes a node whole, and what keeps its distances from zero.
SAMPLE_PHI = 2.1180339887498949
ESTIMATE_RATIO = 5.0
EPS_ESTIMATE = 1e-16
#: Costs of a visit and of an accepted node; a leaf costs its number of points.
COST_VISIT, COST_ACCEPT = 0.5, 1.1

#: Pairs of volume and surface nodes that a kernel holds at a time; they stay in a core's cache.
PAIRS = 1 << 17
#: Surface nodes that a block of pairs spans at most, so that its columns stay in the cache as well.
SPAN = 1 << 11
#: Positions that walk the tree together.
GROUP = 256
#: Points from which sums go by clusters, and those of the least cluster.
MANY, CLUSTER = 1 << 15, 1 << 9
#: Half-widths from which a cluster counts as far, and the error of its interpolation there.
FAR, FAR_ERROR = 3.0, 1e-12


def power(q: np.ndarray, e: float) -> np.ndarray:
    """q to the e; small whole exponents by products."""
    if e != int(e) or not 1 <= e <= 16:
        return q**e
    out, base, n = None, q, int(e)
    while n:
        if n & 1:
            out = base if out is None else out * base
        n >>= 1
        base = base * base if n else base
    return out


@dataclass(frozen=True)
class Weights:
    ldef: float
    a_exp: float
    b_exp: float
    alpha: float

    def of(self, area: np.ndarray, d2: np.ndarray, eps: float) -> np.ndarray:
        q2 = d2 + eps
        if self.a_exp % 2 == 1 and self.b_exp == self.a_exp + 2:  # one root, and no power beyond the lesser
            np.divide(self.ldef**2, q2, out=q2)
            w = np.sqrt(q2)
            for _ in range(int(self.a_exp) // 2):
                w *= q2
            q2 *= self.alpha**self.b_exp
            q2 += 1.0
            w *= q2
        else:
            q = np.sqrt(q2, out=q2)
            np.divide(self.ldef, q, out=q)
            w = power(q, self.b_exp) * self.alpha**self.b_exp
            w += power(q, self.a_exp)
        w *= area
        return w


def squared_distances(r: np.ndarray, x: np.ndarray) -> np.ndarray:
    lines = np.ascontiguousarray(x.T)
    out = r[:, 0, None] - lines[0]
    out *= out
    for c in (1, 2):
        d = r[:, c, None] - lines[c]
        d *= d
        out += d
    return out


def mirror_points(r: np.ndarray, planes, image: int) -> np.ndarray:
    for j, (p, n) in enumerate(planes):
        if image >> j & 1:
            n = np.asarray(n, float)
            r = r - 2 * ((r - np.asarray(p, float)) @ n)[:, None] * n
    return r


def mirror_vectors(v: np.ndarray, planes, image: int, reverse: bool = False) -> np.ndarray:
    order = [j for j in range(len(planes)) if image >> j & 1]
    for j in reversed(order) if reverse else order:
        n = np.asarray(planes[j][1], float)
        v = v - 2 * (v @ n)[:, None] * n
    return v


@dataclass
class Tree:
    """Balanced splits of points: node k covers order[l:u]; children after parents; see build_tree."""

    order: np.ndarray
    l: np.ndarray  # noqa: E741
    u: np.ndarray
    left: np.ndarray
    right: np.ndarray
    parent: np.ndarray
    level: np.ndarray
    centre: np.ndarray
    inv_r: np.ndarray
    area: np.ndarray
    err: np.ndarray
    clusters: dict = field(default_factory=dict, compare=False)  # of large leaves, see leaf_sums()

    @property
    def leaf(self) -> np.ndarray:
        return self.left < 0


def sample_sphere() -> np.ndarray:
    """Twenty directions about a centre: a cube's corners and three rectangles."""
    f, g = SAMPLE_PHI, 1 / SAMPLE_PHI
    pts = [(x, y, z) for z in (-1, 1) for y in (-1, 1) for x in (-1, 1)]
    pts += [(0, y, z) for z in (-f, f) for y in (-g, g)]
    pts += [(x, y, 0) for y in (-f, f) for x in (-g, g)]
    pts += [(x, 0, z) for x in (-f, f) for z in (-g, g)]
    return np.array(pts) / np.sqrt(3.0)


def build_tree(x: np.ndarray, area: np.ndarray, weights: Weights, bucket: int = 8, errors: bool = True, spread_points: int | None = None) -> Tree:
    """Splits at the median of the widest axis, ties by place, until at most bucket + 1 points are left; profiles the error
    of taking a node whole, at twelve distances. spread_points: judge the width by so many first points of a node."""
    order, table = _splits(x, bucket, spread_points)
    l, u, left, right, parent, level = table.T  # noqa: E741
    pts, a = x[order], area[order]
    n = (u - l).astype(float)
    sums = np.concatenate([np.zeros((1, 3)), np.cumsum(pts, axis=0)])
    centre = (sums[u] - sums[l]) / np.maximum(n, 1)[:, None]
    radius, totals = np.zeros(len(l)), np.zeros(len(l))
    for k in range(int(level.max()) + 1):
        here = np.flatnonzero((level == k) & (u > l))
        points, own = _ranges(l[here], u[here])
        starts = np.cumsum(u[here] - l[here]) - (u[here] - l[here])
        radius[here] = np.sqrt(np.maximum.reduceat(((pts[points] - centre[here][own]) ** 2).sum(axis=1), starts)) if len(here) else 0
        totals[here] = np.add.reduceat(a[points], starts) if len(here) else 0
    with np.errstate(divide="ignore"):
        inv_r = 1 / radius
    tree = Tree(order, l, u, left, right, parent, level, centre, inv_r, totals, np.zeros((len(l), len(ERROR_KNOTS))))
    if errors:
        inner = np.flatnonzero(left >= 0)
        tree.err[inner] = profile(inner, l, u, centre, radius, totals, pts, a, weights)
    return tree


def _ranges(l: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """(all places of the ranges l to u, one after the other, the range of each)."""
    sizes = u - l
    own = np.repeat(np.arange(len(l)), sizes)
    return np.arange(int(sizes.sum())) + (l - (np.cumsum(sizes) - sizes))[own], own


def _splits(x: np.ndarray, bucket: int, spread_points: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(order, rows of l, u, left, right, parent, level): a level at a time, then numbered parents first, left before
    right."""
    order, n = np.arange(len(x)), len(x)
    lo, hi, parent, levels, first = np.zeros(1, np.int64), np.full(1, n, np.int64), np.full(1, -1), [], 0
    while len(lo):
        split = np.flatnonzero(hi - lo - 1 > bucket)
        levels.append((lo, hi, parent, split))
        if len(split):
            low, high = lo[split], hi[split]
            points, own = _ranges(low, high)
            pts = x[order[points]]
            starts = np.cumsum(high - low) - (high - low)
            judged = np.ones(len(points), bool) if spread_points is None else np.arange(len(points)) - starts[own] < spread_points
            top = np.maximum.reduceat(np.where(judged[:, None], pts, -np.inf), starts, axis=0)
            axis = np.argmax(top - np.minimum.reduceat(np.where(judged[:, None], pts, np.inf), starts, axis=0), axis=1)
            order[points] = order[points][np.lexsort((order[points], pts[np.arange(len(points)), axis[own]], own))]
            half = low + (high - low + 1) // 2
            parent = np.repeat(first + split, 2)
            first += len(lo)
            lo, hi = np.stack([low, half], axis=1).ravel(), np.stack([half, high], axis=1).ravel()
        else:
            lo = hi = np.zeros(0, np.int64)
    # numbers level by level -> numbers parents first
    at = np.cumsum([0, *[len(lo) for lo, *_ in levels]])
    size = np.ones(at[-1], np.int64)
    for k in range(len(levels) - 1, 0, -1):
        np.add.at(size, levels[k][2], size[at[k] : at[k + 1]])
    name, table = np.zeros(at[-1], np.int64), np.full((at[-1], 6), -1, np.int64)
    for k, (lo, hi, parent, _) in enumerate(levels):
        mine = np.arange(at[k], at[k + 1])
        if k:
            is_right = np.arange(len(lo)) % 2 == 1
            name[mine] = name[parent] + 1 + np.where(is_right, size[mine - 1], 0)
            table[name[parent], 2 + is_right] = name[mine]
            table[name[mine], 4] = name[parent]
        table[name[mine], 0], table[name[mine], 1], table[name[mine], 5] = lo, hi, k
    return order, table


def profile(nodes, l, u, centre, radius, totals, pts, a, weights: Weights) -> np.ndarray:  # noqa: E741
    """Of each node the error of taking it whole, at the knots: nodes of one size together, in blocks of bounded size."""
    rays, knots = sample_sphere(), np.array(ERROR_KNOTS)
    out = np.zeros((len(nodes), len(knots)))
    unit = (rays[None] * knots[:, None, None]).reshape(-1, 3)
    sizes = (u - l)[nodes]
    for n in np.unique(sizes):
        held = np.flatnonzero(sizes == n)
        step = max(1, PAIRS // (len(unit) * int(n)))
        for at in range(0, len(held), step):
            mine = nodes[held[at : at + step]]
            own = l[mine][:, None] + np.arange(n)
            sources, areas = [pts[own, c][:, None] for c in range(3)], a[own][:, None]
            offsets = unit * radius[mine][:, None, None]
            places = centre[mine][:, None] + offsets
            exact = np.empty(places.shape[:2])
            rows = max(1, PAIRS // (len(mine) * int(n)))
            for p in range(0, len(unit), rows):
                d2 = sum((places[:, p : p + rows, None, c] - sources[c]) ** 2 for c in range(3))
                exact[:, p : p + rows] = weights.of(areas, d2, 0.0).sum(axis=2)
            whole = weights.of(totals[mine][:, None], (offsets**2).sum(axis=2), 0.0)
            out[held[at : at + step]] = np.sqrt(((exact - whole) ** 2).reshape(len(mine), len(knots), -1).mean(axis=2))
    return out


def node_error(err: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    return np.interp(ratio, ERROR_KNOTS, err)


def blocks(q: int, n: int) -> Iterator[tuple[slice, slice]]:
    """Parts of q positions with parts of n surface nodes, PAIRS at a time, that cover all pairs."""
    span = max(1, min(n, SPAN))
    rows = max(1, PAIRS // span)
    for at in range(0, q, rows):
        for start in range(0, n, span):
            yield slice(at, at + rows), slice(start, start + span)


def exact_sums(r: np.ndarray, x: np.ndarray, area: np.ndarray, columns: np.ndarray, weights: Weights, eps: float = EPS_KERNEL) -> np.ndarray:
    """sum_i W_i columns_i for each position: (q, k). columns: (n, k)."""
    out = np.zeros((len(r), columns.shape[1]), columns.dtype)
    for mine, theirs in blocks(len(r), len(x)):
        out[mine] += weights.of(area[theirs], squared_distances(r[mine], x[theirs]), eps) @ columns[theirs]
    return out


def transposed_sums(r: np.ndarray, seeds: np.ndarray, x: np.ndarray, area: np.ndarray, weights: Weights) -> np.ndarray:
    """sum_q W_qi seeds_q for each surface node: (n, k)."""
    out = np.zeros((len(x), seeds.shape[1]))
    for mine, theirs in blocks(len(r), len(x)):
        out[theirs] += weights.of(area[theirs], squared_distances(r[mine], x[theirs]), EPS_KERNEL).T @ seeds[mine]
    return out


def _lagrange(t: np.ndarray, p: int) -> np.ndarray:
    """The p polynomials over Chebyshev points, at t in [-1, 1]: (len(t), p)."""
    k = np.arange(p)
    at_points = np.cos(np.outer((k + 0.5) * np.pi / p, k))  # (point, degree)
    at_points[:, 1:] *= 2
    return np.cos(np.outer(np.arccos(np.clip(t, -1, 1)), k)) @ at_points.T / p


class Clusters:
    """sum_i W_i columns_i over many surface nodes, all of them, to rounding: those near a group of positions one by one,
    those of a far cluster through the Chebyshev points of its box, at which they put their columns.

    The weight is a power of the distance, so along each side of a box it is analytic up to the distance of the positions;
    the number of points by which the error falls below FAR_ERROR follows from that distance in half-widths of the side.
    """

    def __init__(self, x: np.ndarray, area: np.ndarray, columns: np.ndarray | None, weights: Weights, eps: float):
        self.weights, self.eps = weights, eps
        self.order, table = _splits(x, CLUSTER, None)
        self.x, self.area = x[self.order], area[self.order]
        self.columns = self.area[:, None] if columns is None else self.area[:, None] * columns[self.order]
        self.l, self.u, self.left, self.right, parent, level = table.T
        self.low, self.high = np.empty((len(table), 3)), np.empty((len(table), 3))
        for k in range(int(level.max()), -1, -1):
            here = np.flatnonzero(level == k)
            ends = here[self.left[here] < 0]
            if len(ends):
                points, _ = _ranges(self.l[ends], self.u[ends])
                starts = np.cumsum(self.u[ends] - self.l[ends]) - (self.u[ends] - self.l[ends])
                self.low[ends], self.high[ends] = (f.reduceat(self.x[points], starts) for f in (np.minimum, np.maximum))
            inner = here[self.left[here] >= 0]
            self.low[inner] = np.minimum(self.low[self.left[inner]], self.low[self.right[inner]])
            self.high[inner] = np.maximum(self.high[self.left[inner]], self.high[self.right[inner]])
        half = (self.high - self.low) / 2
        self.reach = FAR * half.max(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            q = self.reach[:, None] / half
            needed = np.ceil(-np.log(FAR_ERROR) / np.log(q + np.sqrt(1 + q * q))) + 1
        self.points = np.where(half > 0, needed, 1).astype(np.int64)
        self.few = self.u - self.l <= self.points.prod(axis=1)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def holding(self, columns: np.ndarray) -> Clusters:
        """These clusters with other columns, given in their order and overwritten."""
        out = copy(self)
        columns *= self.area[:, None]
        out.columns, out.known = columns, {}
        return out

    def _shares(self, node: int) -> Iterator[tuple[slice, np.ndarray]]:
        """What each point of a cluster puts at each of its stand-ins, a part of the points at a time."""
        centre, half = (self.low[node] + self.high[node]) / 2, (self.high[node] - self.low[node]) / 2
        n = self.points[node]
        step = max(1, PAIRS * 8 // int(n.prod()))
        for at in range(self.l[node], self.u[node], step):
            part = slice(at, min(at + step, self.u[node]))
            a, b, c = (_lagrange((self.x[part, c] - centre[c]) / (half[c] or 1.0), n[c]) for c in range(3))
            yield part, ((a[:, :, None] * b[:, None, :]).reshape(len(a), -1, 1) * c[:, None, :]).reshape(len(a), -1)

    def _places(self, node: int) -> np.ndarray:
        """Where a cluster's stand-ins are."""
        centre, half, n = (self.low[node] + self.high[node]) / 2, (self.high[node] - self.low[node]) / 2, self.points[node]
        lines = [centre[c] + half[c] * np.cos((np.arange(n[c]) + 0.5) * np.pi / n[c]) for c in range(3)]
        return np.stack([g.ravel() for g in np.meshgrid(*lines, indexing="ij")], axis=1)

    def stand_ins(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and columns that stand for a cluster."""
        if node not in self.known:
            self.known[node] = self._places(node), sum(shares.T @ self.columns[part] for part, shares in self._shares(node))
        return self.known[node]

    def meetings(self, r: np.ndarray) -> Iterator[tuple[np.ndarray, list[int], list[int]]]:
        """(places of positions that lie together, clusters far from them, clusters to be taken one by one)."""
        order, table = _splits(r, GROUP, None)
        for start, end in table[table[:, 2] < 0, :2]:
            places = order[start:end]
            mine = r[places]
            low, high = mine.min(axis=0), mine.max(axis=0)
            nodes, far, near = np.zeros(1, np.int64), [], []
            while len(nodes):
                gap = np.maximum(np.maximum(self.low[nodes] - high, low - self.high[nodes]), 0)
                is_far = ~self.few[nodes] & ((gap * gap).sum(axis=1) >= self.reach[nodes] ** 2)
                end = ~is_far & (self.few[nodes] | (self.left[nodes] < 0))
                far += nodes[is_far].tolist()
                near += nodes[end].tolist()
                nodes = nodes[~is_far & ~end]
                nodes = np.concatenate([self.left[nodes], self.right[nodes]])
            yield places, far, near

    def sums(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros((len(r), self.columns.shape[1]), self.columns.dtype)
        for places, far, near in self.meetings(r) if len(r) else ():
            parts = [self.stand_ins(k) for k in far] + [(self.x[self.l[k] : self.u[k]], self.columns[self.l[k] : self.u[k]]) for k in near]
            x, columns = (np.concatenate(p) for p in zip(*parts))
            out[places] = exact_sums(r[places], x, np.ones(len(x)), columns, self.weights, self.eps)
        return out

    def transposed(self, r: np.ndarray, seeds: np.ndarray | Callable[[np.ndarray, np.ndarray], np.ndarray], width: int | None = None) -> np.ndarray:
        """transposed_sums over the points in their order: what far clusters are given at their stand-ins, their points share.

        seeds may be worked out, in so many columns, from places of positions and their sums over columns, by the same weights."""
        out, given, stands = np.zeros((len(self.x), width or seeds.shape[1])), {}, {}
        for places, far, near in self.meetings(r) if len(r) else ():
            for k in far:
                if k not in given:
                    stands[k] = self._places(k)
                    given[k] = np.zeros((len(stands[k]), out.shape[1]))
            x = np.concatenate([stands[k] for k in far] + [self.x[self.l[k] : self.u[k]] for k in near])
            if callable(seeds):
                columns = np.concatenate([self.stand_ins(k)[1] for k in far] + [self.columns[self.l[k] : self.u[k]] for k in near])
                held, found, back = [], np.zeros((len(places), columns.shape[1])), np.zeros((len(x), out.shape[1]))
                for mine, theirs in blocks(len(places), len(x)):
                    held.append((mine, theirs, self.weights.of(np.ones(len(x[theirs])), squared_distances(r[places[mine]], x[theirs]), self.eps)))
                    found[mine] += held[-1][2] @ columns[theirs]
                own = seeds(places, found)
                for mine, theirs, w in held:
                    back[theirs] += w.T @ own[mine]
            else:
                back = transposed_sums(r[places], seeds[places], x, np.ones(len(x)), self.weights)
            at = 0
            for target in [given[k] for k in far] + [out[self.l[k] : self.u[k]] for k in near]:
                target += back[at : at + len(target)]
                at += len(target)
        for k, sums in given.items():
            for part, shares in self._shares(k):
                out[part] += shares @ sums
        out *= self.area[:, None]
        return out


def leaf_sums(tree: Tree, apart: dict[int, list[np.ndarray]], r: np.ndarray, x: np.ndarray, area: np.ndarray, columns: np.ndarray | None, weights: Weights, eps: float, out: np.ndarray) -> None:
    """Adds to out the sums over leaves of MANY points or more; apart: of each the positions that need it."""
    for node, parts in apart.items():
        key, own = (node, id(columns), eps), slice(tree.l[node], tree.u[node])
        if key not in tree.clusters:
            tree.clusters[key] = Clusters(x[own], area[own], None if columns is None else columns[own], weights, eps), columns
        places = np.concatenate(parts)
        out[places] += tree.clusters[key][0].sums(r[places])


def groups(r: np.ndarray) -> list[np.ndarray]:
    """Places of positions that lie together: by the order of a space-filling key, GROUP at a time."""
    if len(r) <= GROUP:
        return [np.arange(len(r))]
    low, high = r.min(axis=0), r.max(axis=0)
    cells = ((r - low) / np.where(high > low, high - low, 1.0) * 1023).astype(np.int64)
    key = np.zeros(len(r), np.int64)
    for bit in range(10):
        for c in range(3):
            key |= (cells[:, c] >> bit & 1) << (3 * bit + c)
    return np.array_split(np.argsort(key, kind="stable"), -(-len(r) // GROUP))


def walk(tree: Tree, r: np.ndarray, accept):
    """Yields (nodes, mask, distances, whole) for a group of positions, a level of the tree at a time: leaves (whole False,
    mask: which positions need them) and nodes taken whole (mask: by which positions).

    accept(nodes, distances, mask) -> which positions of the mask take which node whole: every position decides for itself.
    """
    nodes, mask = np.zeros(1, np.int64), np.ones((1, len(r)), bool)
    while len(nodes):
        leaf = tree.left[nodes] < 0
        if leaf.any():
            yield nodes[leaf], mask[leaf], None, False
            nodes, mask = nodes[~leaf], mask[~leaf]
        if not len(nodes):
            return
        d = np.sqrt(squared_distances(tree.centre[nodes], r))
        whole = accept(nodes, d, mask)
        taken = whole.any(axis=1)
        if taken.any():
            yield nodes[taken], whole[taken], d[taken], True
        mask &= ~whole
        alive = mask.any(axis=1)
        nodes, mask = nodes[alive], mask[alive]
        nodes, mask = np.concatenate([tree.left[nodes], tree.right[nodes]]), np.concatenate([mask, mask])


def near_enough(tree: Tree, tol_den: np.ndarray):
    """Accepts a node from twice its radius on where its error is below the tolerance times the denominator."""

    def accept(nodes, d, mask):
        ratio = d * tree.inv_r[nodes, None]
        out = mask & (ratio >= 2.0)
        k, q = np.nonzero(out)
        out[k, q] = _errors(tree.err, nodes[k], ratio[k, q]) < tol_den[q]
        return out

    return accept


def _errors(err: np.ndarray, nodes: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """node_error of each node at its ratio."""
    knots = np.asarray(ERROR_KNOTS)
    at = np.clip(np.searchsorted(knots, ratio, side="right") - 1, 0, len(knots) - 2)
    share = np.clip((ratio - knots[at]) / (knots[at + 1] - knots[at]), 0.0, 1.0)
    low = err[nodes, at]
    return low + share * (err[nodes, at + 1] - low)


def leaf_points(tree: Tree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points of the nodes, the node's place among them for each point)."""
    sizes = tree.u[nodes] - tree.l[nodes]
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(nodes)), sizes)
    return np.arange(int(ends[-1])) + np.repeat(tree.l[nodes] - (ends - sizes), sizes), own


def terms(tree: Tree, r: np.ndarray, x: np.ndarray, area: np.ndarray, weights: Weights, accept, eps: float, apart: dict[int, list[np.ndarray]] | None = None, places: np.ndarray | None = None):
    """Leaves of MANY points go into apart, if given, with those of the places that need them. Yields (weights (sources, positions), points, nodes): those of leaves' points (nodes None) and of nodes taken whole
    (points None), for the positions that need them and zero for the others, in blocks of bounded size."""
    step = max(1, PAIRS // max(1, len(r)))
    for nodes, mask, d, whole in walk(tree, r, accept):
        if whole:
            for at in range(0, len(nodes), step):
                part = slice(at, at + step)
                yield weights.of(tree.area[nodes[part], None], d[part] ** 2, 0.0 if eps == EPS_KERNEL else eps) * mask[part], None, nodes[part]
        else:
            if apart is not None:
                large = tree.u[nodes] - tree.l[nodes] >= MANY
                for k, needed in zip(nodes[large].tolist(), mask[large]):
                    apart[k].append(places[needed])
                nodes, mask = nodes[~large], mask[~large]
                if not len(nodes):
                    continue
            points, own = leaf_points(tree, nodes)
            for at in range(0, len(points), step):
                part = points[at : at + step]
                yield weights.of(area[part, None], squared_distances(x[part], r), eps) * mask[own[at : at + step]], part, None


def estimate_denominators(tree: Tree, x: np.ndarray, area: np.ndarray, r: np.ndarray, weights: Weights) -> np.ndarray:
    out, apart = np.zeros((len(r), 1)), defaultdict(list)
    far = lambda nodes, d, mask: mask & (np.sqrt(d * d + EPS_ESTIMATE) * tree.inv_r[nodes, None] > ESTIMATE_RATIO)
    for places in groups(r):
        for w, _, _ in terms(tree, r[places], x, area, weights, far, EPS_ESTIMATE, apart, places):
            out[places, 0] += w.sum(axis=0)
    leaf_sums(tree, apart, r, x, area, None, weights, EPS_ESTIMATE, out)
    return out[:, 0]


def fast_sums(tree: Tree, r: np.ndarray, x: np.ndarray, area: np.ndarray, columns: np.ndarray, means: np.ndarray, weights: Weights, tol_den: np.ndarray) -> np.ndarray:
    """exact_sums with far nodes taken whole; means: of columns over each tree node."""
    out, apart = np.zeros((len(r), columns.shape[1]), columns.dtype), defaultdict(list)
    for places in groups(r):
        for w, points, nodes in terms(tree, r[places], x, area, weights, near_enough(tree, tol_den[places]), EPS_KERNEL, apart, places):
            out[places] += w.T @ (columns[points] if nodes is None else means[nodes])
    leaf_sums(tree, apart, r, x, area, columns, weights, EPS_KERNEL, out)
    return out


def fast_transposed(tree: Tree, r: np.ndarray, seeds: np.ndarray, x: np.ndarray, area: np.ndarray, weights: Weights, tol_den: np.ndarray) -> np.ndarray:
    out, of_nodes = np.zeros((len(x), seeds.shape[1])), np.zeros((len(tree.l), seeds.shape[1]))
    for places in groups(r):
        for w, points, nodes in terms(tree, r[places], x, area, weights, near_enough(tree, tol_den[places]), EPS_KERNEL):
            if nodes is None:
                out[points] += w @ seeds[places]  # a point is in one leaf
            else:
                of_nodes[nodes] += w @ seeds[places]
    # what a node took whole is shared evenly by the points under it: down the tree, children after parents
    share = of_nodes / np.maximum(tree.u - tree.l, 1)[:, None]
    for k in range(len(tree.l)):
        if tree.parent[k] >= 0:
            share[k] += share[tree.parent[k]]
    for k in np.flatnonzero(tree.left < 0):
        out[tree.l[k] : tree.u[k]] += share[k]
    return out


def node_means(tree: Tree, columns: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros((1, columns.shape[1]), columns.dtype), np.cumsum(columns, axis=0)])
    return (sums[tree.u] - sums[tree.l]) / np.maximum(tree.u - tree.l, 1)[:, None]


def costs(tree: Tree, r: np.ndarray, tol_den: np.ndarray) -> np.ndarray:
    """Operations that the fast kernel would need, in units of one surface point."""
    out = np.zeros(len(r))
    for places in groups(r):
        inner = near_enough(tree, tol_den[places])

        def accept(nodes, d, mask, places=places, inner=inner):
            out[places] += COST_VISIT * mask.sum(axis=0)
            return inner(nodes, d, mask)

        for nodes, mask, _, whole in walk(tree, r[places], accept):
            out[places] += (np.full(len(nodes), COST_ACCEPT) if whole else (tree.u - tree.l)[nodes]) @ mask
    return out
