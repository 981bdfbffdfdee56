"""Numeric kernels: they recover known motions, and equal brute force."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scanloom.functions import rigid
from scanloom.operators.graphs import spectral
from scanloom.operators.matching import assign, assign_edges


def motion(rng, angle=0.5, shift=1.0):
    return rigid.exp(np.concatenate([rng.uniform(-shift, shift, 3), rng.uniform(-angle, angle, 3)]))


@pytest.mark.parametrize("seed", range(5))
def test_exp_log(seed):
    twist = np.random.default_rng(seed).uniform(-1.5, 1.5, 6)
    assert np.allclose(rigid.log(rigid.exp(twist)), twist)


def test_log_near_pi():
    pose = rigid.exp(np.array([0.3, -0.2, 0.1, np.pi - 1e-9, 0, 0]))
    assert np.isclose(np.linalg.norm(rigid.log(pose)[3:]), np.pi, atol=1e-6)


@pytest.mark.parametrize("seed", range(5))
def test_fit_recovers_motion(seed):
    rng = np.random.default_rng(seed)
    a, pose = rng.normal(size=(10, 3)) * 5, motion(rng, 3.0, 9.0)
    assert np.allclose(rigid.fit(a, rigid.move(pose, a)), pose)


def test_fit_never_mirrors():
    a = np.random.default_rng(1).normal(size=(6, 3))
    assert np.isclose(np.linalg.det(rigid.fit(a, a * [1, 1, -1])[:3, :3]), 1)


def test_downsample_truncates_toward_zero():
    points = np.array([[0.1, 0, 0], [-0.1, 0, 0], [0.3, 0, 0], [-0.3, 0, 0]])
    assert len(rigid.downsample(points, 0.25)) == 3  # 0.1 and -0.1 share the cell at 0


def scene(rng, n=3000):
    """Floor and two walls, sampled densely, with blobs."""
    flat = rng.uniform(-8, 8, (n, 2))
    floor = np.column_stack([flat, rng.normal(0, 0.005, n)])
    wall = np.column_stack([rng.normal(8.3, 0.005, n), flat[:, 0], rng.uniform(0, 3, n)])
    side = np.column_stack([flat[:, 0], rng.normal(-8.3, 0.005, n), rng.uniform(0, 3, n)])
    blobs = (rng.uniform(-6, 6, (12, 3))[:, None] + rng.normal(0, 0.3, (12, 60, 3))).reshape(-1, 3)
    return np.concatenate([floor, wall, side]), blobs


def test_icp_recovers_small_motion():
    rng = np.random.default_rng(3)
    _, blobs = scene(rng)
    pose = rigid.exp(np.array([0.15, -0.1, 0.05, 0.01, -0.01, 0.02]))
    found = rigid.icp(blobs, rigid.move(pose, blobs), np.eye(4))
    assert np.linalg.norm(rigid.log(found @ np.linalg.inv(pose))) < 0.1


def test_plane_refine_recovers_small_motion():
    rng = np.random.default_rng(4)
    flat, _ = scene(rng, 8000)
    pose = rigid.exp(np.array([0.05, -0.05, 0.04, 0.002, -0.002, 0.004]))
    found = rigid.plane_refine(rigid.planes(flat), rigid.planes(rigid.move(pose, flat)), np.eye(4))
    assert np.linalg.norm(rigid.log(found @ np.linalg.inv(pose))) < 0.03


def test_empty_clouds():
    none = np.zeros((0, 3))
    assert np.array_equal(rigid.icp(none, none, np.eye(4)), np.eye(4))
    assert rigid.planes(none).shape == (0, 6)
    assert np.array_equal(rigid.plane_refine(np.zeros((0, 6)), np.zeros((0, 6)), np.eye(4)), np.eye(4))
    assert rigid.Grid(none, 1.0).nearest(np.ones((2, 3)))[0].tolist() == [-1, -1]


def test_ransac_recovers_pose_among_outliers():
    rng = np.random.default_rng(5)
    a, pose = rng.uniform(-30, 30, (20, 3)), motion(rng, 0.3, 3.0)
    b = rigid.move(pose, a)
    wrong = b.copy()
    wrong[:6] += rng.uniform(5, 9, (6, 3))
    found, inliers, score = rigid.ransac(a, wrong, a, b, 100, 1)
    assert np.allclose(found, pose, atol=1e-6) and inliers > 8 and score > 0.99
    assert rigid.ransac(a, wrong, a, b, 100, 1, matched_within=0.2)[1] == 14
    assert rigid.ransac(a[:0], b[:0], a, b, 100, 1)[2] == 0


def test_ransac_inliers_are_of_the_nodes_given():
    """Nodes without a match count only if they are passed; matched mode takes all steps."""
    rng = np.random.default_rng(8)
    a, pose = rng.uniform(-30, 30, (12, 3)), motion(rng, 0.3, 3.0)
    b = rigid.move(pose, a)
    lonely = rng.uniform(60, 90, (30, 3))
    assert rigid.ransac(a[:6], b[:6], a[:6], b[:6], 1, 3)[1] == 6
    assert rigid.ransac(a[:6], b[:6], np.vstack([a, lonely]), np.vstack([b, -lonely]), 1, 3)[1] == 12
    noisy = b + rng.normal(0, 0.05, b.shape)
    few, many = (rigid.ransac(a, noisy, a, noisy, steps, 3, matched_within=0.12) for steps in (1, 200))
    assert many[1] > few[1] and many[1] > 6


def one_at_a_time(match_a, match_b, a, b, steps, seed):
    """The search by its definition: a hypothesis after the other, all pairs of nodes."""
    draws, pose, most, loss = np.random.default_rng(seed), np.eye(4), 0, 0.0
    for _ in range(steps):
        own = draws.integers(0, len(match_a), 3)
        tried = rigid.fit(match_a[own], match_b[own])
        moved = rigid.move(tried, a)
        apart = np.abs(np.trunc(moved / 0.2)[:, None] - np.trunc(b / 0.2)[None]).max(axis=2)
        gaps = np.where(apart <= 1, np.linalg.norm(moved[:, None] - b[None], axis=2), np.inf).min(axis=1)
        gaps = gaps[np.isfinite(gaps)]
        if len(gaps) > most:
            pose, most, loss = tried, len(gaps), gaps.mean()
            if most > 8 or (most > 2 and most > 0.5 * len(a)):
                break
    return pose, most, np.exp(-loss) if most >= 3 else 0.0


@pytest.mark.parametrize("seed", range(12))
def test_hypotheses_at_once_equal_one_at_a_time(seed):
    rng = np.random.default_rng(seed)
    a, pose = rng.uniform(-30, 30, (5 + 3 * seed, 3)), motion(rng, 0.3, 3.0)
    b = rigid.move(pose, a) + rng.normal(0, 0.04, a.shape)
    b[: len(b) // 2] += rng.uniform(3, 9, (len(b) // 2, 3))
    pose, most, score = rigid.ransac(a, b, a, b, 100, seed)
    want = one_at_a_time(a, b, a, b, 100, seed)
    assert np.allclose(pose, want[0]) and most == want[1] and np.isclose(score, want[2])


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 60), st.integers(0, 40), st.integers(0, 10**6))
def test_grid_equals_brute_force(n, m, seed):
    rng = np.random.default_rng(seed)
    held, asked = rng.uniform(-2, 2, (n, 3)).round(1), rng.uniform(-3, 3, (m, 3)).round(1)
    index, d2 = rigid.Grid(held, 0.5).nearest(asked)
    for q, i, gap in zip(asked, index, d2, strict=True):
        near = np.abs(np.trunc(held / 0.5) - np.trunc(q / 0.5)).max(axis=1, initial=0) <= 1
        if not near.any():
            assert i == -1 and gap == np.inf
        else:
            assert near[i] and np.isclose(gap, ((held[near] - q) ** 2).sum(axis=1).min()) and np.isclose(((held[i] - q) ** 2).sum(), gap)


def test_a_capped_grid_keeps_the_first_of_a_voxel():
    held = np.array([[0.9, 0.9, 0.9], [0.1, 0.1, 0.1], [0.5, 0.5, 0.5]])
    assert rigid.Grid(held, 1.0, 1).nearest(held)[0].tolist() == [0, 0, 0]
    assert rigid.Grid(held, 1.0).nearest(held)[0].tolist() == [0, 1, 2]


def test_normal_equations_equal_jacobian_sums():
    rng = np.random.default_rng(6)
    s, q = rng.normal(size=(7, 3)), rng.normal(size=(7, 3))
    jac = np.concatenate([np.hstack([np.eye(3), -rigid.hat(p)]) for p in s])
    jtj, jtr = rigid.normal_equations(s, q)
    assert np.allclose(jtj, jac.T @ jac) and np.allclose(jtr, jac.T @ (s - q).ravel())


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_equals_brute_force(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 9, (n, m)).astype(float)
    found = assign(cost)
    used = found[found >= 0]
    assert len(used) == min(n, m) == len(set(used.tolist()))
    total = cost[np.flatnonzero(found >= 0), used].sum()
    if n <= m:
        best = min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))
    else:
        best = min(sum(cost[r, j] for j, r in enumerate(p)) for p in itertools.permutations(range(n), m))
    assert total == best


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 8), st.integers(0, 10**6))
def test_edges_give_the_most_matches_of_the_least_cost(n, seed):
    rng = np.random.default_rng(seed)
    a, b, cost = rng.integers(0, 5, n), rng.integers(0, 5, n), rng.integers(0, 5, n) / 10  # some repeat
    found = assign_edges(a, b, cost)
    fits = lambda own: len(set(a[own])) == len(set(b[own])) == len(own)
    every = (list(own) for size in range(n + 1) for own in itertools.combinations(range(n), size))
    best = min((-len(own), round(cost[own].sum(), 6)) for own in every if fits(own))
    assert fits(found) and (-len(found), round(cost[found].sum(), 6)) == best


def test_many_small_components_take_no_matrix_of_all():
    """100,000 nodes a side: a matrix of them would have 10^10 entries."""
    n = 100_000
    a, b = np.arange(n), np.arange(n)
    found = assign_edges(np.append(a, a[::2]), np.append(b, b[::2] + 1), np.append(np.full(n, 0.2), np.full(n // 2, 0.1)))
    assert len(found) == n


def test_spectral_rows_sum_to_one():
    adjacency = (np.random.default_rng(7).random((6, 6)) < 0.5).astype(float)
    adjacency = np.maximum(adjacency, adjacency.T)
    np.fill_diagonal(adjacency, 1)
    found = spectral(adjacency, 30)
    assert found.shape == (6, 30) and np.allclose(found.sum(axis=1), 1) and (found[:, 6:] == 0).all()


def test_pairs_of_two_objects_do_not_draw_the_pose():
    dice = np.random.default_rng(8)
    centres, normals = dice.normal(size=(40, 3)) * 20, dice.normal(size=(40, 3))
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    pose = rigid.exp(np.array([0.15, -0.1, 0.05, 0.003, -0.003, 0.006]))
    a, b = np.hstack([centres, normals]), np.hstack([rigid.move(pose, centres), normals @ pose[:3, :3].T])
    b[:5, :3] += 0.4 * b[:5, 3:]  # planes of something else nearby
    assert np.allclose(rigid.refine_pairs(a, b, np.eye(4)), pose, atol=1e-6)
