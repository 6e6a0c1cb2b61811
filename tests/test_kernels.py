"""Numeric kernels against each other, finite differences and plain loops; no Spark."""

import time

import numpy as np
import pytest

from driftmesh.plans import kernels as K
from driftmesh.plans.nodal import Surface, Turn, merge_points

RNG = np.random.default_rng(0)


def sheet(n=10):
    pts = np.array([(i / (n - 1), j / (n - 1), 0.15 * np.sin(3 * i / (n - 1)) * np.cos(2 * j / (n - 1))) for j in range(n) for i in range(n)])
    quads = [[j * n + i, j * n + i + 1, (j + 1) * n + i + 1, (j + 1) * n + i] for j in range(n - 1) for i in range(n - 1)]
    quads[3] = quads[3][:3]
    return pts, quads


@pytest.fixture(scope="module")
def surface():
    return Surface.build(*sheet())


def test_sums_match_a_plain_loop(surface):
    w = K.Weights(surface.ldef0, 3.0, 5.0, 0.25)
    r, cols = RNG.uniform(-1, 2, (5, 3)), RNG.normal(size=(len(surface.xu0), 4))
    got = K.exact_sums(r, surface.xu0, surface.area, cols, w)
    for q in range(5):
        want = np.zeros(4)
        for x, a, c in zip(surface.xu0, surface.area, cols):
            d = w.ldef / np.sqrt(((r[q] - x) ** 2).sum() + 1e-15)
            want += a * (d**3 + 0.25**5 * d**5) * c
        assert np.allclose(got[q], want, rtol=1e-12)


def test_tangent_adjoint_and_complex_step_agree(surface):
    xu = surface.xu0 + 0.02 * RNG.normal(size=surface.xu0.shape)
    dx = RNG.normal(size=xu.shape)
    dm, db = surface.motion_tangent(xu, dx)
    h = 1e-6
    (m1, b1), (m0, b0) = surface.motion(xu + h * dx), surface.motion(xu - h * dx)
    assert np.abs((m1 - m0) / (2 * h) - dm).max() < 1e-5 and np.abs((b1 - b0) / (2 * h) - db).max() < 1e-5
    mb, bb = RNG.normal(size=dm.shape), RNG.normal(size=db.shape)
    assert np.isclose((mb * dm).sum() + (bb * db).sum(), (surface.motion_adjoint(xu, mb, bb) * dx).sum(), rtol=1e-10)
    assert np.allclose(surface.motion(xu + 1j * 1e-40 * dx)[0].imag / 1e-40, dm, atol=1e-8)


def test_rotation_turns_one_normal_into_the_other():
    a, b = RNG.normal(size=(50, 3)), RNG.normal(size=(50, 3))
    m = Turn(a, b).matrix
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    assert np.allclose(np.einsum("nij,nj->ni", m, unit(a)), unit(b), atol=1e-6)
    assert np.allclose(Turn(a, a).matrix, np.eye(3), atol=1e-6)


def test_tree_partitions_points_and_a_single_leaf_is_exact(surface):
    w = K.Weights(surface.ldef0, 3.0, 5.0, 0.25)
    t = K.build_tree(surface.xu0, surface.area, w, 8)
    inner = np.flatnonzero(t.left >= 0)
    assert (t.l[t.left[inner]] == t.l[inner]).all() and (t.u[t.right[inner]] == t.u[inner]).all() and (t.u[t.left[inner]] == t.l[t.right[inner]]).all()
    assert np.allclose(t.area[inner], t.area[t.left[inner]] + t.area[t.right[inner]])
    assert (t.u - t.l)[t.left < 0].max() <= 9 and (t.u - t.l)[t.left < 0].sum() == len(surface.xu0)
    one = K.build_tree(surface.xu0, surface.area, w, len(surface.xu0))
    r, cols = RNG.uniform(-1, 2, (7, 3)), RNG.normal(size=(len(surface.xu0), 4))
    assert np.allclose(K.fast_sums(one, r, surface.xu0, surface.area, cols, K.node_means(one, cols), w, np.ones(7)), K.exact_sums(r, surface.xu0, surface.area, cols, w))


def test_fast_converges_and_transposes(surface):
    w = K.Weights(surface.ldef0, 3.0, 5.0, 0.25)
    t = K.build_tree(surface.xu0, surface.area, w, 8)
    x, a = surface.xu0[t.order], surface.area[t.order]
    r, cols = RNG.uniform(-3, 4, (60, 3)), RNG.normal(size=(len(x), 3))
    exact = K.exact_sums(r, x, a, np.ones((len(x), 1)), w)
    errors = []
    for tol in (1e-2, 1e-4, 1e-8):
        limit = tol * K.estimate_denominators(t, x, a, r, w)
        fast = K.fast_sums(t, r, x, a, np.ones((len(x), 1)), np.ones((len(t.l), 1)), w, limit)
        errors.append(np.abs(fast / exact - 1).max())
    assert errors[0] >= errors[1] >= errors[2] and errors[2] < 1e-6
    seeds = RNG.normal(size=(60, 3))
    limit = 5e-4 * K.estimate_denominators(t, x, a, r, w)
    forward = (K.fast_sums(t, r, x, a, cols, K.node_means(t, cols), w, limit) * seeds).sum()
    assert np.isclose(forward, (K.fast_transposed(t, r, seeds, x, a, w, limit) * cols).sum(), rtol=1e-9)
    assert (K.costs(t, r, limit) > 0).all()


def test_merging_keeps_the_first_and_sorts_by_z_y_x():
    pts = np.array([[1.0, 0, 0], [0, 0, 0], [1.0, 0, 0], [0, 0, 1e-13], [0, 1, -1]])
    rep, link = merge_points(pts, 1e-12)
    assert rep.tolist() == [4, 1, 0] and link.tolist() == [2, 1, 2, 1, 0]


def test_free_nodes_have_no_weight():
    pts, quads = sheet(4)
    s = Surface.build(np.vstack([pts, [[9.0, 9, 9]]]), quads)
    assert s.area[s.link[-1]] == 0
    m, b = s.motion(s.xu0 + 0.1)
    assert np.isfinite(m).all() and np.isfinite(b).all() and (b[s.link[-1]] == 0).all()
    dm, db = s.motion_tangent(s.xu0, RNG.normal(size=s.xu0.shape))
    assert np.isfinite(dm).all() and np.isfinite(db).all()


def test_mirrors_undo_themselves():
    planes = (((0.2, 0, 0), (1.0, 0, 0)), ((0, 0, 0), (0.0, 0.6, 0.8)))
    r = RNG.normal(size=(5, 3))
    for k in range(4):
        back = K.mirror_vectors(K.mirror_vectors(r, planes, k), planes, k, reverse=True)
        assert np.allclose(back, r)
    assert np.allclose(K.mirror_points(r, planes, 1)[:, 0], 0.4 - r[:, 0])


def test_merge_of_points_that_share_a_coordinate_takes_no_pairs_of_them():
    i = np.arange(240_000)
    p = np.stack([i % 4 / 4, i // 4 / 40, i % 20_000 / 200_000], axis=1)
    p[1] = p[0] + 4e-13
    p[2] = p[1] + 4e-13
    begun = time.perf_counter()
    rep, link = merge_points(p)
    assert time.perf_counter() - begun < 15  # pairs of one x: 7.2e9
    assert len(rep) == len(p) - 2 and link[0] == link[1] == link[2] and rep[link[0]] == 0


def test_blocks_bound_both_sides_and_cover_all_pairs(monkeypatch):
    n, q = 3 * K.SPAN + 5, 70
    r, x, area, cols, seeds = RNG.uniform(size=(q, 3)), RNG.uniform(size=(n, 3)), RNG.uniform(size=n), RNG.normal(size=(n, 4)), RNG.normal(size=(q, 2))
    for a_exp, b_exp in ((3.0, 5.0), (2.0, 4.0), (1.0, 3.0), (2.5, 4.5)):
        w = K.Weights(1.3, a_exp, b_exp, 0.25)
        d = w.ldef / np.sqrt(((r[:, None] - x) ** 2).sum(axis=2) + 1e-15)
        want = area * (d**a_exp + 0.25**b_exp * d**b_exp)
        assert np.allclose(K.exact_sums(r, x, area, cols, w), want @ cols, rtol=1e-9, atol=1e-9 * np.abs(want).sum())
        assert np.allclose(K.transposed_sums(r, seeds, x, area, w), want.T @ seeds, rtol=1e-9, atol=1e-9)
    shapes, plain = [], K.squared_distances
    monkeypatch.setattr(K, "squared_distances", lambda r, x: shapes.append((len(r), len(x))) or plain(r, x))
    K.exact_sums(r, x, area, cols, w)
    K.transposed_sums(r, seeds, x, area, w)
    assert max(s[1] for s in shapes) <= K.SPAN and max(a * b for a, b in shapes) <= K.PAIRS and sum(a * b for a, b in shapes) == 2 * n * q


def test_large_leaves_are_summed_by_clusters(monkeypatch):
    """A leaf of many points, most of them far: all count, to rounding, and few pairs are worked out."""
    rng = np.random.default_rng(8)
    n, q = 70_000, 300
    k = np.arange(n)
    x = np.stack([k % 40 / 40, k // 40 / 40, rng.uniform(0.05, 0.1, n)], axis=1)
    x[:50] = x[0]
    r = np.concatenate([rng.uniform(0, 6, (q - 2, 3)), x[[0, 777]]])
    area, weights = rng.random(n), K.Weights(20.0, 3, 5, 0.25)
    tree = K.build_tree(x, area, weights, n // 2, errors=False)
    x, area = x[tree.order], area[tree.order]
    columns = np.concatenate([rng.normal(size=(n, 3)), np.ones((n, 1))], axis=1)
    den = K.exact_sums(r, x, area, np.ones((n, 1)), weights, K.EPS_ESTIMATE)[:, 0]
    exact, size = (K.exact_sums(r, x, area, c, weights) for c in (columns, np.abs(columns)))
    pairs, of = [], K.Weights.of
    monkeypatch.setattr(K.Weights, "of", lambda self, area, d2, eps: pairs.append(d2.size) or of(self, area, d2, eps))
    for _ in range(2):  # the second time from known clusters
        np.testing.assert_allclose(K.estimate_denominators(tree, x, area, r, weights), den, rtol=1e-12)
        sums = K.fast_sums(tree, r, x, area, columns, K.node_means(tree, columns), weights, np.zeros(q))
        assert (np.abs(sums - exact) / size).max() < 1e-12
    assert sum(pairs) < 4 * n * q / 3
    other = np.ones((n, 2))  # other columns are not mistaken for those known
    np.testing.assert_allclose(K.fast_sums(tree, r, x, area, other, K.node_means(tree, other), weights, np.zeros(q))[:, 1], exact[:, 3], rtol=1e-12)


def test_clusters_sum_and_transpose_as_all_pairs_do(monkeypatch):
    """A long strip of points and positions at its start: all pairs count, to rounding, most of them through stand-ins."""
    rng = np.random.default_rng(9)
    n, q = 60_000, 200
    k = np.arange(n)
    x = np.stack([k % 40 / 40, k // 40 / 40, rng.uniform(0.05, 0.1, n)], axis=1)
    r = np.concatenate([rng.uniform(0, 1, (q - 1, 3)), x[[777]]])
    area, w, seeds, columns = rng.random(n), K.Weights(20.0, 3, 5, 0.25), rng.normal(size=(q, 3)), rng.normal(size=(n, 4))
    c = K.Clusters(x, area, None, w, K.EPS_KERNEL)
    exact, size = (K.exact_sums(r, x, area, v, w) for v in (columns, np.abs(columns)))
    back, back_size = (K.transposed_sums(r, v, x, area, w)[c.order] for v in (seeds, np.abs(seeds)))
    pairs, of = [], K.Weights.of
    monkeypatch.setattr(K.Weights, "of", lambda self, area, d2, eps: pairs.append(d2.size) or of(self, area, d2, eps))
    assert (np.abs(c.holding(columns[c.order]).sums(r) - exact) / size).max() < 1e-12
    assert (np.abs(c.transposed(r, seeds) - back) / back_size).max() < 1e-12
    assert sum(pairs) < n * q
    both = c.transposed(r, lambda places, sums: seeds[places] / sums, 3)
    assert np.allclose(both, c.transposed(r, seeds / c.sums(r)), rtol=1e-10, atol=1e-12 * np.abs(both).max())
    assert not c.transposed(r[:0], seeds[:0]).any() and c.sums(r[:0]).shape == (0, 1)


def test_motions_in_blocks_are_those_of_all_nodes(monkeypatch):
    from driftmesh.plans import nodal

    pts, quads = sheet(12)
    moved, d = pts + 0.02 * RNG.normal(size=pts.shape), RNG.normal(size=pts.shape)
    whole = Surface.build(pts, quads)
    monkeypatch.setattr(nodal, "BLOCK", 17)
    parts = Surface.build(pts, quads)
    assert max(len(nodes) for _, nodes in parts.faces.blocks) == 17
    for a, b in zip((*whole.motion(moved), *whole.motion_tangent(moved, d)), (*parts.motion(moved), *parts.motion_tangent(moved, d))):
        assert np.allclose(a, b, rtol=1e-12, atol=1e-14)
    order = np.arange(len(whole.xu0))[::-1]
    assert [len(m) for _, m, _ in parts.motions(moved, order=order)][0] == 17
    assert np.allclose(np.concatenate([b for _, _, b in parts.motions(moved, order=order)]), whole.motion(moved)[1][::-1], atol=1e-14)
