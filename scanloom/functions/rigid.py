"""Dense numeric kernels on one pair of scans: rigid fits, ICP, RANSAC, planes."""

from __future__ import annotations

import numpy as np

# Fixed values of the registration.
ICP_VOXEL, ICP_MAP, ICP_CAP, ICP_RADIUS, ICP_STEPS, ICP_STOP = 0.25, 1.0, 5, 0.5, 500, 1e-4
PLANE_DOWN, PLANE_VOXEL, PLANE_POINTS, PLANE_FLAT, PLANE_STEPS = 0.25, 1.0, 8, 0.005, 100
# Three standard deviations, as a multiple of the median; what is near enough whatever the median.
PLANE_TRIM, PLANE_EXACT = 4.45, 1e-3
# So many pairs of planes, and so much of them in the direction that they hold least, settle a pose.
PLANE_MANY, PLANE_HOLD = 24, 0.02
# How far points look for their partners, in turn, and the motion at which one turn ends.
SOFT_REACH, SOFT_STEPS, SOFT_STOP = (0.5, 0.25, 0.12, 0.05), 50, 1e-6
NORMAL_LIMIT, PLANE_LIMIT, PLANE_D2 = 0.2, 0.5, 3.0
INLIER_VOXEL, NO_LOSS = 0.2, 1e6
#: So many points look for their nearest, or are moved by hypotheses, at a time.
AT_ONCE = 8192


def hat(v: np.ndarray) -> np.ndarray:
    x, y, z = v
    return np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])


def exp(step: np.ndarray) -> np.ndarray:
    """The 4x4 motion of a twist: translation part first."""
    v, w = step[:3], step[3:]
    angle = np.linalg.norm(w)
    k = hat(w)
    if angle < 1e-10:
        r, left = np.eye(3) + k, np.eye(3) + k / 2
    else:
        a, b = np.sin(angle) / angle, (1 - np.cos(angle)) / angle**2
        r = np.eye(3) + a * k + b * k @ k
        left = np.eye(3) + b * k + (1 - a) / angle**2 * k @ k
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, left @ v
    return out


def log(pose: np.ndarray) -> np.ndarray:
    """The twist of a motion."""
    r, t = pose[:3, :3], pose[:3, 3]
    angle = np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))
    skew = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) / 2
    if angle < 1e-10:
        return np.concatenate([t - np.cross(skew, t) / 2, skew])
    if np.pi - angle < 1e-6:  # the axis from the symmetric part
        axis = np.sqrt(np.maximum((np.diag(r) + 1) / 2, 0))
        lead = int(np.argmax(axis))
        axis = np.where(np.arange(3) == lead, axis, np.sign(r[lead] + r[:, lead]) * axis)
        w = axis / np.linalg.norm(axis) * angle
    else:
        w = skew * angle / np.sin(angle)
    k = hat(w)
    half = angle / 2
    inverse = np.eye(3) - k / 2 + (1 - half / np.tan(half)) / angle**2 * k @ k
    return np.concatenate([inverse @ t, w])


def fit_moments(mean_a: np.ndarray, mean_b: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """The rigid motion a -> b from means and centred cross-covariance sum(a b'); of each
    where there are several (n, 3), (n, 3), (n, 3, 3)."""
    u, _, vt = np.linalg.svd(cross)
    v, ut = np.swapaxes(vt, -1, -2), np.swapaxes(u, -1, -2)
    sign = np.where(np.linalg.det(v @ ut) < 0, -1.0, 1.0)
    mirror = np.ones((*sign.shape, 3))
    mirror[..., 2] = sign
    out = np.zeros((*sign.shape, 4, 4))
    out[..., :3, :3] = (v * mirror[..., None, :]) @ ut
    out[..., :3, 3] = mean_b - (out[..., :3, :3] @ mean_a[..., None])[..., 0]
    out[..., 3, 3] = 1
    return out


def fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rigid motion that takes a to b with the least squared error; of each where there
    are several sets of points (n, points, 3)."""
    mean_a, mean_b = a.mean(axis=-2), b.mean(axis=-2)
    cross = np.swapaxes(a - mean_a[..., None, :], -1, -2) @ (b - mean_b[..., None, :])
    return fit_moments(mean_a, mean_b, cross)


def move(pose: np.ndarray, points: np.ndarray) -> np.ndarray:
    """points after pose, or after each of several poses (n, 4, 4)."""
    return points @ np.swapaxes(pose[..., :3, :3], -1, -2) + pose[..., None, :3, 3]


def _voxels(points: np.ndarray, size: float) -> np.ndarray:
    return np.trunc(points / size).astype(np.int64)


def downsample(points: np.ndarray, size: float) -> np.ndarray:
    """The first point of each voxel, in their order."""
    if not len(points):
        return points
    _, first = np.unique(_voxels(points, size), axis=0, return_index=True)
    return points[np.sort(first)]


class Grid:
    """Points by voxel, up to cap in each, for nearest-neighbour search in 27 voxels. Voxels
    are numbers made of their places among the occupied ones of each axis, sorted."""

    def __init__(self, points: np.ndarray, size: float, cap: int | None = None):
        self.size = size
        cells = _voxels(points, size)
        self.axes = [np.unique(cells[:, i]) for i in range(3)]
        codes = self._code([np.searchsorted(axis, cells[:, i]) for i, axis in enumerate(self.axes)])
        order = np.argsort(codes, kind="stable")
        self.codes, first, count = np.unique(codes[order], return_index=True, return_counts=True)
        self.count = count if cap is None else np.minimum(count, cap)
        self.first = first
        self.points, self.order = points[order], order

    def _code(self, places: list[np.ndarray]) -> np.ndarray:
        x, y, z = places
        return (x * len(self.axes[1]) + y) * len(self.axes[2]) + z

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index (-1: none) and squared distance of each query's nearest point."""
        best, d2 = np.full(len(queries), -1, dtype=np.int64), np.full(len(queries), np.inf)
        for start in range(0, len(queries) if len(self.codes) else 0, AT_ONCE):
            some = slice(start, start + AT_ONCE)
            best[some], d2[some] = self._nearest(queries[some])
        return best, d2

    def _nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, d2 = np.full(len(queries), -1, dtype=np.int64), np.full(len(queries), np.inf)
        wanted = _voxels(queries, self.size)[:, :, None] + np.array([-1, 0, 1])
        places, there = [], []
        for i, axis in enumerate(self.axes):
            place = np.minimum(np.searchsorted(axis, wanted[:, i]), len(axis) - 1)
            places.append(place)
            there.append(axis[place] == wanted[:, i])
        wide = lambda xyz: (xyz[0][:, :, None, None], xyz[1][:, None, :, None], xyz[2][:, None, None, :])
        code = self._code(wide(places)).reshape(len(queries), 27)
        x, y, z = wide(there)
        cell = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        held = (x & y & z).reshape(len(queries), 27) & (self.codes[cell] == code)
        count = np.where(held, self.count[cell], 0).ravel()
        of_query = count.reshape(-1, 27).sum(axis=1)
        asked = np.flatnonzero(of_query)
        if not len(asked):
            return best, d2
        before = np.cumsum(count) - count
        near = np.repeat(self.first[cell].ravel() - before, count) + np.arange(count.sum())
        gaps = ((np.repeat(queries, of_query, axis=0) - self.points[near]) ** 2).sum(axis=1)
        starts = (np.cumsum(of_query) - of_query)[asked]
        least = np.minimum.reduceat(gaps, starts)
        hit = np.flatnonzero(gaps == np.repeat(least, of_query[asked]))
        first = hit[np.searchsorted(hit, starts)]  # of equally near ones the first
        best[asked], d2[asked] = self.order[near[first]], least
        return best, d2


def normal_equations(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """J'J and J'r of residuals s - q with J = [I | -hat(s)]."""
    residual = source - target
    jtj, jtr = np.zeros((6, 6)), np.zeros(6)
    jtj[:3, :3] = len(source) * np.eye(3)
    total = source.sum(axis=0)
    jtj[:3, 3:] = -hat(total)
    jtj[3:, :3] = hat(total)
    jtj[3:, 3:] = np.eye(3) * (source**2).sum() - source.T @ source
    jtr[:3] = residual.sum(axis=0)
    jtr[3:] = np.cross(source, residual).sum(axis=0)
    return jtj, jtr


def icp(a: np.ndarray, b: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """Point-to-point ICP of a onto b, from a first guess."""
    if not len(a) or not len(b):
        return guess
    target = downsample(b, ICP_VOXEL)
    grid = Grid(target, ICP_MAP, ICP_CAP)
    source = move(guess, downsample(a, ICP_VOXEL))
    total = np.eye(4)
    for _ in range(ICP_STEPS):
        index, d2 = grid.nearest(source)
        met = d2 < ICP_RADIUS**2
        if met.sum() < 3:
            break
        jtj, jtr = normal_equations(source[met], target[index[met]])
        step = exp(-np.linalg.lstsq(jtj, jtr, rcond=None)[0])
        source, total = move(step, source), step @ total
        if np.linalg.norm(log(step)) < ICP_STOP:
            break
    return total @ guess


def planes(points: np.ndarray) -> np.ndarray:
    """Centre and normal of each flat voxel."""
    points = downsample(points, PLANE_DOWN)
    if not len(points):
        return np.zeros((0, 6))
    keys, back = np.unique(_voxels(points, PLANE_VOXEL), axis=0, return_inverse=True)
    back = back.ravel()
    out = []
    for i in np.flatnonzero(np.bincount(back) >= PLANE_POINTS):
        own = points[back == i]
        mean = own.mean(axis=0)
        values, vectors = np.linalg.eigh(own.T @ own / len(own) - np.outer(mean, mean))
        if values[0] <= PLANE_FLAT:
            out.append(np.concatenate([mean, vectors[:, 0]]))
    return np.array(out).reshape(-1, 6)


def plane_pairs(a: np.ndarray, b: np.ndarray, pose: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Planes of a and those of b that they lie on under a pose."""
    if not len(a) or not len(b):
        return np.zeros((0, 6)), np.zeros((0, 6))
    index, d2 = Grid(b[:, :3], PLANE_VOXEL).nearest(move(pose, a[:, :3]))
    met = index >= 0
    a, b, d2 = a[met], b[index[met]], d2[met]
    normal = a[:, 3:] @ pose[:3, :3].T
    turn = np.minimum(np.linalg.norm(normal - b[:, 3:], axis=1), np.linalg.norm(normal + b[:, 3:], axis=1))
    off = np.abs(((move(pose, a[:, :3]) - b[:, :3]) * b[:, 3:]).sum(axis=1))
    ok = (turn < NORMAL_LIMIT) & (off < PLANE_LIMIT) & (d2 < PLANE_D2)
    return a[ok], b[ok]


def plane_refine(a: np.ndarray, b: np.ndarray, pose: np.ndarray) -> np.ndarray:
    """Point-to-plane refinement from the planes of both sides; pairs are fixed once."""
    return refine_pairs(*plane_pairs(a, b, pose), pose)


def refine_pairs(a: np.ndarray, b: np.ndarray, pose: np.ndarray) -> np.ndarray:
    """The pose at which centres of a lie on their planes of b. Planes of two objects may
    make a pair: what is far off, for these pairs, after a fit is left out of the next, as
    long as six are left."""
    return refine_and_judge(a, b, pose)[0]


def refine_and_judge(a: np.ndarray, b: np.ndarray, pose: np.ndarray) -> tuple[np.ndarray, bool]:
    """The pose of refine_pairs(), and whether the pairs settle it: few planes, or planes
    that nearly agree in their normals, let a pose slide along them."""
    if len(a) < 6:
        return pose, False
    while True:
        pose = _fit_planes(a, b, pose)
        moved = move(pose, a[:, :3])
        off = np.abs(((moved - b[:, :3]) * b[:, 3:]).sum(axis=1))
        near = off <= max(PLANE_TRIM * np.median(off), PLANE_EXACT)
        if near.all() or near.sum() < 6:
            break
        a, b = a[near], b[near]
    arm = moved - moved.mean(axis=0)
    arm /= max(np.sqrt((arm**2).sum(axis=1).mean()), 1e-9)
    jac = np.hstack([b[:, 3:], np.cross(arm, b[:, 3:])])
    return pose, len(a) >= PLANE_MANY and np.linalg.eigvalsh(jac.T @ jac / len(a))[0] >= PLANE_HOLD


def soft_icp(a: np.ndarray, b: np.ndarray, pose: np.ndarray) -> np.ndarray:
    """The pose at which points of a lie on points of b. A point goes to the mean of the
    points around it, weighted by nearness, at first of a wide surrounding: of points in
    rows the nearest alone would often be the neighbour of the right one."""
    if not len(a) or not len(b):
        return pose
    width = max(1, AT_ONCE * 8 // len(b))
    for reach in SOFT_REACH:
        for _ in range(SOFT_STEPS):
            moved, target, weight = move(pose, a), np.zeros_like(a), np.zeros(len(a))
            for at in range(0, len(a), width):
                own = slice(at, at + width)
                d2 = ((moved[own, None] - b[None]) ** 2).sum(axis=2)
                near = np.where(d2 < (3 * reach) ** 2, np.exp(-d2 / (2 * reach * reach)), 0.0)
                weight[own], target[own] = near.sum(axis=1), near @ b
            met = weight > 0
            if met.sum() < 3:
                break
            step = fit(moved[met][None], (target[met] / weight[met, None])[None])[0]
            pose = step @ pose
            if np.abs(move(step, moved) - moved).max() < SOFT_STOP:
                break
    return pose


def _fit_planes(a: np.ndarray, b: np.ndarray, pose: np.ndarray) -> np.ndarray:
    """Least squares by damped Gauss-Newton steps."""
    damp = 1e-4

    def residuals(p: np.ndarray) -> np.ndarray:
        return ((move(p, a[:, :3]) - b[:, :3]) * b[:, 3:]).sum(axis=1)

    now = residuals(pose)
    for _ in range(PLANE_STEPS):
        moved = move(pose, a[:, :3])
        jac = np.hstack([b[:, 3:], np.cross(moved, b[:, 3:])])
        jtj = jac.T @ jac
        step = -np.linalg.solve(jtj + damp * np.diag(np.diag(jtj) + 1e-9), jac.T @ now)
        tried = exp(step) @ pose
        new = residuals(tried)
        if new @ new <= now @ now:
            gain = now @ now - new @ new
            pose, now, damp = tried, new, max(damp / 3, 1e-12)
            if gain <= 1e-12 * max(now @ now, 1e-300) or np.linalg.norm(step) < 1e-10:
                break
        else:
            damp *= 4
            if damp > 1e8:
                break
    return pose


def ransac(match_a: np.ndarray, match_b: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int, seed: int, matched_within: float | None = None) -> tuple[np.ndarray, int, float]:
    """Pose, inliers and score exp(-mean distance). Inliers are nodes of a with a
    node of b in the 27 voxels around them, and enough of them end the search; with
    matched_within instead matched pairs nearer than that, over all steps. Samples are
    of three matches, with replacement. Hypotheses are fitted and counted many at a time,
    in the order of their draws, of which the first with the most inliers wins."""
    pose, most, loss = np.eye(4), 0, NO_LOSS
    if not len(match_a):
        return pose, most, 0.0
    chosen = np.random.default_rng(seed).integers(0, len(match_a), (steps, 3))
    grid = Grid(b, INLIER_VOXEL) if matched_within is None else None
    moved = a if matched_within is None else match_a
    width, done = 8, 0  # few at first, as most searches end early
    while done < steps:
        own = chosen[done : done + width]
        done += len(own)
        tried = fit(match_a[own], match_b[own])
        there = move(tried, moved)
        if grid is None:
            gaps = np.linalg.norm(there - match_b, axis=2)
            met = gaps < matched_within
        else:
            index, d2 = grid.nearest(there.reshape(-1, 3))
            met, gaps = ((x.reshape(len(own), -1)) for x in (index >= 0, np.sqrt(d2)))
        counts = met.sum(axis=1)
        for i in np.flatnonzero(counts > np.maximum.accumulate(np.append(most, counts))[:-1]):
            pose, most, loss = tried[i], int(counts[i]), float(gaps[i][met[i]].mean())
            if grid is not None and (most > 8 or (most > 2 and most > 0.5 * len(a))):
                done = steps
                break
        width = min(4 * width, max(8, AT_ONCE // max(len(moved), 1)))
    return pose, most, float(np.exp(-loss)) if most >= 3 else 0.0
