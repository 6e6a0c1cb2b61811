"""Properties of surface nodes in numpy, with tangents and adjoints: areas, normals, corners, rotations, offsets.

Everything here is of the size of the surface. Faces come as CSR: face f has the nodes conn[ptr[f]:ptr[f + 1]].
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from driftmesh.functions.geometry import EPS_AREA, EPS_MAGNITUDE, LEAST_AXIS

#: Faces, and nodes, whose vectors and rotations are worked out at a time: the steps between take many times their size.
BLOCK = 1 << 16


def _near_pairs(points: np.ndarray, tol: float) -> np.ndarray:
    """Pairs of rows within tol of each other, in the order of x (distances in that order first).

    Points are parted at gaps on each axis in turn until no part is parted further; only points of one part can be near.
    """
    part, parts, order = np.zeros(len(points), np.int64), 0, np.arange(len(points))
    while parts < (now := int(part.max(initial=-1)) + 1):
        parts = now
        for c in range(points.shape[1]):
            order = np.lexsort((points[:, c], part))
            apart = (np.diff(part[order]) != 0) | (np.diff(points[order, c]) > 2 * tol)  # twice: a gap's rounding parts nothing
            part[order] = np.concatenate([[0], np.cumsum(apart)])
    ends = np.searchsorted(part[order], part[order], side="right")
    found, shift, at = [np.zeros((0, 2), np.int64)], 1, np.arange(len(points))
    while len(at := at[ends[at] > at + shift]):
        a, b = order[at], order[at + shift]
        near = ((points[a] - points[b]) ** 2).sum(axis=1) <= tol * tol
        found.append(np.stack([a[near], b[near]], axis=1))
        shift += 1
    pairs = np.concatenate(found)
    if not len(pairs):
        return pairs
    place = np.empty(len(points), np.int64)
    place[np.argsort(points[:, 0], kind="stable")] = np.arange(len(points))
    pairs = np.where((place[pairs[:, 0]] < place[pairs[:, 1]])[:, None], pairs, pairs[:, ::-1])
    return pairs[np.lexsort((place[pairs[:, 0]], place[pairs[:, 1]] - place[pairs[:, 0]]))]


def merge_points(points: np.ndarray, tol: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """(representatives' places, place among them for each point): the first point of each cluster stands for it.

    Unique points come in the order of (z, y, x), whatever order the input had.
    """
    exact, first, inverse = np.unique(points, axis=0, return_index=True, return_inverse=True)
    inverse = inverse.ravel()
    rep = np.arange(len(exact))
    for i, j in _near_pairs(exact, tol):
        lo, hi = sorted((i, j), key=lambda k: first[k])
        rep[hi] = min(rep[hi], rep[lo], key=lambda k: first[k])
    while not np.array_equal(rep, rep[rep]):
        rep = rep[rep]
    stays = np.unique(rep)
    stays = stays[np.lexsort((exact[stays, 0], exact[stays, 1], exact[stays, 2]))]
    place = np.empty(len(exact), np.int64)
    place[stays] = np.arange(len(stays))
    return first[stays], place[rep[inverse]]


@dataclass
class Faces:
    ptr: np.ndarray
    conn: np.ndarray
    blocks: list = field(default_factory=list)  # (places of faces, nodes) by number of corners, BLOCK at most

    def __post_init__(self):
        sizes = np.diff(self.ptr)
        for k in np.unique(sizes):
            same = np.flatnonzero(sizes == k)
            for at in range(0, len(same), BLOCK):
                which = same[at : at + BLOCK]
                self.blocks.append((which, self.conn[self.ptr[which][:, None] + np.arange(k)]))


def _polygons(corners: np.ndarray):
    """Area and unit normal of polygons (m, k, 3), and what the derivatives need."""
    rays = corners - corners.mean(axis=1, keepdims=True)
    after = np.roll(rays, -1, axis=1)
    c = np.cross(rays, after)
    m = np.sqrt((c * c).sum(axis=2) + EPS_AREA)
    s = (c / m[..., None]).sum(axis=1)
    size = np.sqrt((s * s).sum(axis=1))
    return 0.5 * m.sum(axis=1), s / size[:, None], (rays, after, c, m, size)


def node_normals(x: np.ndarray, faces: Faces) -> tuple[np.ndarray, np.ndarray]:
    """(area share, normal weighted by it, not of unit length) of each node; free nodes have neither."""
    area, vec = np.zeros(len(x)), np.zeros_like(x)
    for _, nodes in faces.blocks:
        a, n, _ = _polygons(x[nodes])
        share = np.repeat(a / nodes.shape[1], nodes.shape[1])
        np.add.at(area, nodes.ravel(), share)
        np.add.at(vec, nodes.ravel(), share[:, None] * np.repeat(n, nodes.shape[1], axis=0))
    return area, np.divide(vec, area[:, None], out=np.zeros_like(vec), where=area[:, None] != 0)


def corner_flags(x: np.ndarray, faces: Faces, normals: np.ndarray, angle: float) -> np.ndarray:
    flags = np.zeros(len(x), bool)
    least = np.cos(np.radians(angle))
    for _, nodes in faces.blocks:
        _, n, _ = _polygons(x[nodes])
        sharp = np.abs((n[:, None] * normals[nodes]).sum(axis=2)) < least
        flags[nodes[sharp]] = True
    return flags


def _skew(v: np.ndarray) -> np.ndarray:
    out = np.zeros((*v.shape[:-1], 3, 3), v.dtype)
    out[..., 0, 1], out[..., 0, 2], out[..., 1, 2] = -v[..., 2], v[..., 1], -v[..., 0]
    out[..., 1, 0], out[..., 2, 0], out[..., 2, 1] = v[..., 2], -v[..., 1], v[..., 0]
    return out


def _size(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=-1) + EPS_MAGNITUDE)


@dataclass
class Turn:
    """A rotation of n0 into the direction of n at every node, and what its derivatives need."""

    n0: np.ndarray
    n: np.ndarray

    def __post_init__(self):
        self.c = np.cross(self.n0, self.n)
        self.length = _size(self.c)
        self.turned = np.real(self.length) >= LEAST_AXIS
        safe = np.where(self.turned, self.length, 1.0)[:, None]
        self.axis = np.where(self.turned[:, None], self.c / safe, np.array([1.0, 0, 0]))
        self.size = _size(self.n)
        self.unit0, self.unit = self.n0 / _size(self.n0)[:, None], self.n / self.size[:, None]
        arg = (self.unit0 * self.unit).sum(axis=1)
        self.arg = np.where(np.real(arg) > 1.0, 1.0, arg)
        self.angle = np.where(self.turned, np.arccos(np.where(self.turned, self.arg, 1.0)), 0.0)
        self.skew = _skew(self.axis)
        self.square = self.skew @ self.skew
        self.sin, self.cos = np.sin(self.angle)[:, None, None], np.cos(self.angle)[:, None, None]
        self.matrix = np.eye(3) + self.sin * self.skew + (1 - self.cos) * self.square

    def _arc(self) -> np.ndarray:
        """-1 / sqrt(1 - arg^2), zero where the angle does not change."""
        room = 1 - self.arg**2
        ok = self.turned & (np.real(room) > 0)
        return np.where(ok, -1 / np.sqrt(np.where(ok, room, 1.0)), 0.0)

    def tangent(self, dn: np.ndarray) -> np.ndarray:
        dc = np.cross(self.n0, dn)
        along = (self.c * dc).sum(axis=1) / np.where(self.turned, self.length, 1.0)
        daxis = (dc - self.axis * along[:, None]) / np.where(self.turned, self.length, 1.0)[:, None]
        dunit = (dn - self.unit * (self.unit * dn).sum(axis=1)[:, None]) / self.size[:, None]
        dangle = (self._arc() * (self.unit0 * dunit).sum(axis=1))[:, None, None]
        da = _skew(daxis)
        out = (self.skew * self.cos + self.square * self.sin) * dangle + self.sin * da + (1 - self.cos) * (self.skew @ da + da @ self.skew)
        return np.where(self.turned[:, None, None], out, 0.0)

    def adjoint(self, mbar: np.ndarray) -> np.ndarray:
        angle_bar = ((self.skew * self.cos + self.square * self.sin) * mbar).sum(axis=(1, 2))
        t = self.skew.transpose(0, 2, 1)
        abar = self.sin * mbar + (1 - self.cos) * (mbar @ t + t @ mbar)
        axis_bar = np.stack([abar[:, 2, 1] - abar[:, 1, 2], abar[:, 0, 2] - abar[:, 2, 0], abar[:, 1, 0] - abar[:, 0, 1]], axis=1)
        cbar = (axis_bar - self.axis * (self.axis * axis_bar).sum(axis=1)[:, None]) / np.where(self.turned, self.length, 1.0)[:, None]
        unit_bar = (self._arc() * angle_bar)[:, None] * self.unit0
        nbar = np.cross(cbar, self.n0) + (unit_bar - self.unit * (self.unit * unit_bar).sum(axis=1)[:, None]) / self.size[:, None]
        return np.where(self.turned[:, None], nbar, 0.0)


def normals_tangent(x: np.ndarray, dx: np.ndarray, faces: Faces) -> np.ndarray:
    area, darea, vec, dvec = np.zeros(len(x)), np.zeros(len(x)), np.zeros_like(x), np.zeros_like(x)
    for _, nodes in faces.blocks:
        k = nodes.shape[1]
        a, n, (rays, after, c, m, size) = _polygons(x[nodes])
        d = dx[nodes]
        dr = d - d.mean(axis=1, keepdims=True)
        dc = np.cross(dr, after) + np.cross(rays, np.roll(dr, -1, axis=1))
        dm = (c * dc).sum(axis=2) / m
        ds = (dc / m[..., None] - c * (dm / m**2)[..., None]).sum(axis=1)
        dn = (ds - n * (n * ds).sum(axis=1)[:, None]) / size[:, None]
        da = 0.5 * dm.sum(axis=1)
        for target, value in ((area, a / k), (darea, da / k)):
            np.add.at(target, nodes.ravel(), np.repeat(value, k))
        np.add.at(vec, nodes.ravel(), np.repeat((a / k)[:, None] * n, k, axis=0))
        np.add.at(dvec, nodes.ravel(), np.repeat((da / k)[:, None] * n + (a / k)[:, None] * dn, k, axis=0))
    ok = area != 0
    safe = np.where(ok, area, 1.0)[:, None]
    return np.where(ok[:, None], (dvec * safe - vec * darea[:, None]) / safe**2, 0.0)


def normals_adjoint(x: np.ndarray, nbar: np.ndarray, faces: Faces) -> np.ndarray:
    area, normal = node_normals(x, faces)
    ok = area != 0
    safe = np.where(ok, area, 1.0)
    vec_bar = np.where(ok[:, None], nbar / safe[:, None], 0.0)
    area_bar = -(vec_bar * normal).sum(axis=1)
    out = np.zeros_like(x)
    for _, nodes in faces.blocks:
        k = nodes.shape[1]
        a, n, (rays, after, c, m, size) = _polygons(x[nodes])
        share_bar = (area_bar[nodes] + (vec_bar[nodes] * n[:, None]).sum(axis=2)).sum(axis=1)
        n_bar = (a / k)[:, None] * vec_bar[nodes].sum(axis=1)
        s_bar = (n_bar - n * (n * n_bar).sum(axis=1)[:, None]) / size[:, None]
        c_bar = s_bar[:, None] / m[..., None] - c * ((c * s_bar[:, None]).sum(axis=2) / m**3)[..., None]
        c_bar = c_bar + 0.5 * (share_bar / k)[:, None, None] * c / m[..., None]
        r_bar = np.cross(after, c_bar) + np.roll(np.cross(c_bar, rays), 1, axis=1)
        np.add.at(out, nodes.ravel(), (r_bar - r_bar.mean(axis=1, keepdims=True)).reshape(-1, 3))
    return out


@dataclass
class Surface:
    """Unique nodes of a surface in (z, y, x) order with their fixed properties.

    rep: the first input row of each node; link: the node of each input row. Only rep's coordinates are used.
    """

    xu0: np.ndarray
    faces: Faces
    rep: np.ndarray
    link: np.ndarray
    use_rotations: bool = True
    corner_angle: float | None = 30.0

    def __post_init__(self):
        self.area, self.normals0 = node_normals(self.xu0, self.faces)
        self.free = self.area == 0
        self.corner = corner_flags(self.xu0, self.faces, self.normals0, self.corner_angle) if self.corner_angle is not None else np.zeros(len(self.xu0), bool)
        self.ldef0 = float(np.sqrt(((self.xu0 - self.xu0.mean(axis=0)) ** 2).sum(axis=1).max())) if len(self.xu0) else 0.0

    @classmethod
    def build(cls, points: np.ndarray, faces: list | tuple[np.ndarray, np.ndarray], use_rotations: bool = True, corner_angle: float | None = 30.0, tol: float = 1e-12) -> Surface:
        rep, link = merge_points(points, tol)
        # faces: lists of nodes, or the sizes of all faces and their nodes, one face after the other
        sizes, nodes = faces if isinstance(faces, tuple) else ([len(f) for f in faces], np.concatenate(faces) if len(faces) else [])
        ptr = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        conn = link[np.asarray(nodes, np.int64)]
        return cls(points[rep], Faces(ptr, conn), rep, link, use_rotations, corner_angle)

    def _turns(self) -> np.ndarray:
        return ~(self.corner | self.free) if self.use_rotations else np.zeros(len(self.xu0), bool)

    def motion(self, xu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(M, B) of every node: rotations (n, 3, 3) and offsets (n, 3)."""
        return self._joined(self.motions(xu), xu.dtype)

    def motion_tangent(self, xu: np.ndarray, dxu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._joined(self.motions(xu, dxu), float)

    def _joined(self, parts, dtype) -> tuple[np.ndarray, np.ndarray]:
        m, b = np.empty((len(self.xu0), 3, 3), dtype), np.empty((len(self.xu0), 3), dtype)
        for at, *found in parts:
            m[at], b[at] = found
        return m, b

    def motions(self, xu: np.ndarray, dxu: np.ndarray | None = None, order: np.ndarray | None = None):
        """Yields (places, M, B), nodes in the given order, BLOCK at a time; of the tangent along dxu, if given."""
        order = np.arange(len(self.xu0)) if order is None else order
        if self.use_rotations:
            turns = self._turns()
            _, n = node_normals(xu, self.faces) if not np.iscomplexobj(xu) else _complex_normals(xu, self.faces)
            dn = None if dxu is None else normals_tangent(xu, dxu, self.faces)
        for at in range(0, len(order), BLOCK):
            own = order[at : at + BLOCK]
            m = np.broadcast_to(np.eye(3, dtype=xu.dtype), (len(own), 3, 3)).copy() if dxu is None else np.zeros((len(own), 3, 3))
            if self.use_rotations:
                turned = turns[own]
                turn = Turn(self.normals0[own[turned]], n[own[turned]])
                m[turned] = turn.matrix if dxu is None else turn.tangent(dn[own[turned]])
            b = (xu if dxu is None else dxu)[own] - np.einsum("nij,nj->ni", m, self.xu0[own])
            b[self.free[own]] = 0
            yield slice(at, at + len(own)), m, b

    def motion_adjoint(self, xu: np.ndarray, mbar: np.ndarray, bbar: np.ndarray) -> np.ndarray:
        bbar = np.where(self.free[:, None], 0.0, bbar)
        out = bbar.copy()
        if self.use_rotations:
            turns = np.flatnonzero(self._turns())
            _, n = node_normals(xu, self.faces)
            nbar = np.zeros_like(xu)
            for at in range(0, len(turns), BLOCK):
                own = turns[at : at + BLOCK]
                nbar[own] = Turn(self.normals0[own], n[own]).adjoint(mbar[own] - bbar[own, :, None] * self.xu0[own, None, :])
            out += normals_adjoint(xu, nbar, self.faces)
        return out


def _complex_normals(x: np.ndarray, faces: Faces) -> tuple[np.ndarray, np.ndarray]:
    """node_normals for complex-step derivatives."""
    area, vec = np.zeros(len(x), complex), np.zeros(x.shape, complex)
    for _, nodes in faces.blocks:
        a, n, _ = _polygons(x[nodes])
        share = np.repeat(a / nodes.shape[1], nodes.shape[1])
        np.add.at(area, nodes.ravel(), share)
        np.add.at(vec, nodes.ravel(), share[:, None] * np.repeat(n, nodes.shape[1], axis=0))
    return area, np.divide(vec, area[:, None], out=np.zeros_like(vec), where=area[:, None] != 0)
