"""Dense and sequential algorithms as numpy functions on one tile, building or scene, for grouped Arrow batches.

Every group is bounded by its tile's pixels, its scene's lines or its building's boxes.
"""

from __future__ import annotations

import numpy as np

# --- raster tiles -----------------------------------------------------------------------------------------------------


def disk_count(mask: np.ndarray, radius: int) -> np.ndarray:
    """Occupied cells within a disk around each cell, by running sums along rows: O(cells * radius)."""
    h, w = mask.shape
    sums = np.zeros((h, w + 1), np.int64)
    sums[:, 1:] = np.cumsum(mask, axis=1)
    out = np.zeros((h, w), np.int64)
    cols = np.arange(w)
    for dr in range(-radius, radius + 1):
        half = int(np.sqrt(radius * radius - dr * dr))
        row = sums[:, np.minimum(cols + half + 1, w)] - sums[:, np.maximum(cols - half, 0)]
        a, b = max(0, -dr), min(h, h - dr)
        if a < b:
            out[a:b] += row[a + dr : b + dr]
    return out


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    return disk_count(mask, radius) > 0


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    """Outside the tile counts as empty."""
    size = sum(2 * int(np.sqrt(radius * radius - d * d)) + 1 for d in range(-radius, radius + 1))
    return disk_count(mask, radius) == size


def close(mask: np.ndarray, radius: int, edge: str = "tile") -> np.ndarray:
    """Closing; edge ``tile`` erodes with an empty outside, ``global`` pads first so that edges stay."""
    if edge == "global":
        wide = np.pad(mask, 2 * radius)
        return erode(dilate(wide, radius), radius)[2 * radius : -2 * radius or None, 2 * radius : -2 * radius or None]
    return erode(dilate(mask, radius), radius)


def close_line(mask: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Closing by a line of odd length ``size`` along an axis."""
    moved = np.moveaxis(mask, axis, 1)
    half, w = size // 2, moved.shape[1]
    cols = np.arange(w)

    def count(m):
        s = np.concatenate([np.zeros((len(m), 1), np.int64), np.cumsum(m, axis=1)], axis=1)
        return s[:, np.minimum(cols + half + 1, w)] - s[:, np.maximum(cols - half, 0)]

    return np.moveaxis(count(count(moved) > 0) == 2 * half + 1, 1, axis)


def label(mask: np.ndarray) -> np.ndarray:
    """8-connected components, numbered from 1 in scan order of their first cell; 0 outside."""
    h, w = mask.shape
    names = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    big = h * w + 1
    while True:
        wide = np.pad(np.where(mask, names, big), 1, constant_values=big)
        low = np.min([wide[1 + i : 1 + i + h, 1 + j : 1 + j + w] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        new = np.where(mask, np.minimum(low, names), 0)
        flat = np.concatenate([[0], new.ravel()])
        for _ in range(4):  # follow names to their cells' names, so that long components need few rounds
            flat[1:] = flat[flat[1:]]
        new = flat[1:].reshape(h, w)
        if (new == names).all():
            break
        names = new
    kinds, codes = np.unique(names, return_inverse=True)
    return (codes.reshape(h, w) + (0 if kinds[0] == 0 else 1)).astype(np.int64)


def propagate(core: np.ndarray, within: np.ndarray) -> np.ndarray:
    """Components of ``within`` that hold a core cell, and the core itself."""
    names = label(within)
    return np.isin(names, np.unique(names[core & within])) & within | core


def fill_nearest(values: np.ndarray) -> np.ndarray:
    """NaN cells take the value of the nearest valid cell (Euclidean), exactly: nearest in each row, then over rows."""
    valid = np.isfinite(values)
    if not valid.any() or valid.all():
        return values.copy()
    h, w = values.shape
    cols = np.arange(w)
    left = np.maximum.accumulate(np.where(valid, cols, -(10**9)), axis=1)
    right = np.minimum.accumulate(np.where(valid, cols, 10**9)[:, ::-1], axis=1)[:, ::-1]
    near = np.where(cols - left <= right - cols, left, right)
    d2 = np.where(np.abs(near) < 10**8, (near - cols).astype(float) ** 2, np.inf)
    out, rows = values.copy(), np.arange(h)
    for c in np.flatnonzero((~valid).any(axis=0)):
        need = np.flatnonzero(~valid[:, c])
        cost = (need[:, None] - rows[None, :]).astype(float) ** 2 + d2[None, :, c]
        best = cost.argmin(axis=1)
        out[need, c] = values[best, near[best, c]]
    return out


def nearest_in_row(cols: np.ndarray, width: int) -> np.ndarray:
    """For each of ``width`` columns the place in ``cols`` (ascending) of the nearest one; of two the left one."""
    at = np.arange(width)
    right = np.searchsorted(cols, at)
    left = np.maximum(right - 1, 0)
    right = np.minimum(right, len(cols) - 1)
    return np.where(np.abs(at - cols[left]) <= np.abs(cols[right] - at), left, right)


def nearest_over_rows(d2: np.ndarray) -> np.ndarray:
    """For each row of a column the row r that makes (distance to r)^2 + d2[r] smallest; of several the first.

    Steps away from every row at once, until no farther row can be nearer; infinite d2 stand for rows without a cell.
    """
    n = len(d2)
    best, took, k = d2.astype(float), np.arange(n), 1
    while k < n and k * k <= best.max():
        for to, of in ((slice(k, n), slice(0, n - k)), (slice(0, n - k), slice(k, n))):
            cost, row = d2[of] + k * k, np.arange(n)[of]
            nearer = (cost < best[to]) | ((cost == best[to]) & (row < took[to]))
            best[to], took[to] = np.where(nearer, cost, best[to]), np.where(nearer, row, took[to])
        k += 1
    return took


def seam_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[set[tuple[int, int]], np.ndarray]:
    """Component ids of two bands side by side that one closed patch joins, and the cells that bridge them.

    A bridge cell is one that only the closing fills, in a patch that joins components of both bands; it holds the
    smallest of them, all other cells 0.
    """
    band = np.concatenate([left, right], axis=1)
    patch = close(band > 0, radius)
    names, pairs, bridge = label(patch), set(), np.zeros(band.shape, np.int64)
    for k in range(1, int(names.max()) + 1):
        here = names == k
        a, b = (set(np.unique(x[y]).tolist()) - {0} for x, y in ((left, here[:, : left.shape[1]]), (right, here[:, left.shape[1] :])))
        pairs |= {(i, j) for i in a for j in b}
        if a and b:
            bridge[here & (band == 0)] = min(a | b)
    return pairs, bridge


class Unions:
    """Disjoint sets with path halving; the smaller name leads."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# --- lines ------------------------------------------------------------------------------------------------------------


def mean_shift_1d(values: np.ndarray, weights: np.ndarray, bandwidth: float, rounds: int = 300) -> np.ndarray:
    """Label of each value: flat-kernel mean shift on weighted values, modes within the bandwidth merge, heaviest first."""
    at = values.astype(float).copy()
    for _ in range(rounds):
        near = np.abs(at[:, None] - values[None, :]) <= bandwidth
        new = (near * weights * values).sum(1) / np.maximum((near * weights).sum(1), 1e-12)
        if np.abs(new - at).max(initial=0) < 1e-3 * bandwidth:
            break
        at = new
    mass = (np.abs(at[:, None] - values[None, :]) <= bandwidth) @ weights
    modes: list[float] = []
    for i in np.lexsort((at, -mass)):
        if all(abs(at[i] - m) > bandwidth for m in modes):
            modes.append(float(at[i]))
    return np.abs(at[:, None] - np.array(modes)[None, :]).argmin(1) if modes else np.zeros(0, np.int64)


def snap_orthogonal(peaks: list[int], totals: np.ndarray, low: float = 85, high: float = 95, spans: tuple[int, ...] = (4, 6)) -> list[int]:
    """Peaks in label order: of two nearly at right angles the weaker moves to the heaviest bin near the exact one, the first
    of equals; of two equally heavy ones none moves."""
    peaks = list(peaks)
    for i in range(len(peaks)):
        for j in range(i + 1, len(peaks)):
            d = abs(peaks[i] - peaks[j]) % 180
            if low <= min(d, 180 - d) <= high and totals[peaks[i]] != totals[peaks[j]]:
                weak, strong = (i, j) if totals[peaks[i]] < totals[peaks[j]] else (j, i)
                target = (peaks[strong] - 90) % 180
                for span in spans:
                    bins = [(target + k) % 180 for k in range(-span, span + 1)]
                    best = max(bins, key=lambda b: totals[b])
                    if totals[best] > 0:
                        peaks[weak] = best
                        break
    return peaks


def suppress_parallel(lines: np.ndarray, weight: np.ndarray, angle: float, least: float) -> list[int]:
    """Indices of the lines kept when, heaviest first, those nearer than ``least`` (across the angle) to one kept go."""
    normal = np.array([-np.sin(np.radians(angle)), np.cos(np.radians(angle))])
    across = (lines.reshape(-1, 2, 2).mean(1) @ normal) if len(lines) else np.zeros(0)
    kept: list[int] = []
    for i in np.argsort(-weight, kind="stable"):
        if all(abs(across[i] - across[k]) >= least for k in kept):
            kept.append(int(i))
    return kept


def polygonize(segments: np.ndarray, digits: int = 6) -> list[list[tuple[float, float]]]:
    """Bounded faces of an arrangement of segments (n, 4), counter-clockwise, by a walk over half-edges."""
    points: dict[int, list[tuple[float, float]]] = {i: [] for i in range(len(segments))}
    for i, (ax, ay, bx, by) in enumerate(segments):
        points[i] += [(ax, ay), (bx, by)]
        for j in range(i):
            cx, cy, dx, dy = segments[j]
            det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if abs(det) > 1e-12:
                t, u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
                if -1e-9 <= t <= 1 + 1e-9 and -1e-9 <= u <= 1 + 1e-9:
                    p = (ax + t * (bx - ax), ay + t * (by - ay))
                    points[i].append(p)
                    points[j].append(p)
    near: dict[tuple, set] = {}
    for i, (ax, ay, bx, by) in enumerate(segments):
        ps = sorted({(round(x, digits) + 0.0, round(y, digits) + 0.0) for x, y in points[i]}, key=lambda p: (p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay))
        for p, q in zip(ps, ps[1:]):
            near.setdefault(p, set()).add(q)
            near.setdefault(q, set()).add(p)
    ends = [p for p in near if len(near[p]) < 2]
    while ends:  # dangling edges bound no face
        p = ends.pop()
        for q in near.pop(p, ()):
            near[q].discard(p)
            if len(near[q]) < 2:
                ends.append(q)
    turn = {p: sorted(qs, key=lambda q, p=p: np.arctan2(q[1] - p[1], q[0] - p[0])) for p, qs in near.items() if qs}
    seen, faces = set(), []
    for p in sorted(turn):
        for q in turn[p]:
            if (p, q) in seen:
                continue
            ring, a, b = [], p, q
            while (a, b) not in seen:
                seen.add((a, b))
                ring.append(a)
                order = turn[b]
                a, b = b, order[(order.index(a) - 1) % len(order)]
            area = sum(u[0] * v[1] - v[0] * u[1] for u, v in zip(ring, ring[1:] + ring[:1]))
            if area > 1e-9:
                faces.append(ring)
    return faces


# --- polygons ---------------------------------------------------------------------------------------------------------


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Monotone chain, counter-clockwise; fewer than three points come back as they are."""
    ps = sorted(set(map(tuple, points)))
    if len(ps) < 3:
        return np.array(ps, float).reshape(-1, 2)

    def half(order):
        out: list[tuple] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(ps) + half(reversed(ps)), float)


def expand(ring: np.ndarray, factor: float = 1.1) -> np.ndarray:
    """The ring scaled about the middle of its bounds."""
    if len(ring) < 3:
        return ring
    middle = (ring.min(0) + ring.max(0)) / 2
    return middle + (ring - middle) * factor


def dissolve(rings: list[list[tuple[float, float]]]) -> list[list[tuple[float, float]]]:
    """Outer rings of the union of rings that share whole edges: edges met in both directions go, the rest is traced."""
    edges: dict[tuple, int] = {}
    for ring in rings:
        area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))
        ring = list(ring) if area > 0 else list(reversed(ring))
        for e in zip(ring, ring[1:] + ring[:1]):
            if edges.get(e[::-1]):
                edges[e[::-1]] -= 1
            else:
                edges[e] = edges.get(e, 0) + 1
    after: dict[tuple, list] = {}
    for (p, q), n in sorted(edges.items()):
        after.setdefault(p, []).extend([q] * n)
    out = []
    while any(after.values()):
        start = min(p for p, qs in after.items() if qs)
        ring, at, came = [], start, None
        while True:
            ring.append(at)
            options = after[at]
            # At a point that several rings touch, the sharpest left turn stays on the same outline.
            if came is not None and len(options) > 1:
                back = np.arctan2(came[1] - at[1], came[0] - at[0])
                options.sort(key=lambda q, a=at, b=back: (b - np.arctan2(q[1] - a[1], q[0] - a[0])) % (2 * np.pi))
            came, at = at, options.pop(0)
            if at == start:
                break
        if sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1])) > 0:
            out.append(ring)
    return out


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (index triples) by Bowyer and Watson."""
    n = len(points)
    span = max(float(np.ptp(points, axis=0).max()), 1e-9) if n else 1.0
    middle = points.mean(0) if n else np.zeros(2)
    ps = np.vstack([points, middle + span * np.array([[-30.0, -20.0], [30.0, -20.0], [0.0, 40.0]])])
    triangles = {(n, n + 1, n + 2): _circle(ps, (n, n + 1, n + 2))}
    for i in range(n):
        bad = [t for t, (x, y, r2) in triangles.items() if (ps[i, 0] - x) ** 2 + (ps[i, 1] - y) ** 2 < r2 * (1 - 1e-12)]
        count: dict[tuple, int] = {}
        for t in bad:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                count[tuple(sorted(e))] = count.get(tuple(sorted(e)), 0) + 1
            del triangles[t]
        for (a, b), k in count.items():
            if k == 1 and (circle := _circle(ps, (a, b, i))):
                triangles[(a, b, i)] = circle
    return np.array([t for t in triangles if max(t) < n], np.int64).reshape(-1, 3)


def _circle(ps: np.ndarray, t: tuple[int, int, int]) -> tuple[float, float, float] | None:
    (ax, ay), (bx, by), (cx, cy) = ps[list(t)]
    det = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    if abs(det) < 1e-15:
        return None
    x = ((ax**2 + ay**2) * (by - cy) + (bx**2 + by**2) * (cy - ay) + (cx**2 + cy**2) * (ay - by)) / det
    y = ((ax**2 + ay**2) * (cx - bx) + (bx**2 + by**2) * (ax - cx) + (cx**2 + cy**2) * (bx - ax)) / det
    return x, y, (ax - x) ** 2 + (ay - y) ** 2


def alpha_areas(points: np.ndarray, alphas: list[float]) -> list[float]:
    """For each alpha, the area of the triangles whose circumradius is at most 1 / alpha."""
    points = np.unique(points, axis=0)
    kept = [(t, circle[2]) for t in delaunay(points) if (circle := _circle(points, tuple(t)))]
    if not kept:
        return [0.0] * len(alphas)
    a, b, c = points[np.array([t for t, _ in kept])].transpose(1, 0, 2)
    area = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) / 2
    radius2 = np.array([r for _, r in kept])
    return [float(area[radius2 <= 1 / (alpha * alpha)].sum()) for alpha in alphas]


def alpha_polygons(points: np.ndarray, alphas: list[float]) -> list[list[float]]:
    """For each alpha, the areas of the alpha shape's polygons: triangles that share an edge are of one polygon."""
    points, out = np.unique(points, axis=0), []
    kept = [(tuple(t), circle[2]) for t in delaunay(points) if (circle := _circle(points, tuple(t)))]
    size = [abs(float(np.linalg.det(points[[b, c]] - points[a]))) / 2 for (a, b, c), _ in kept]
    for alpha in alphas:
        here, edge, sets = [k for k, (_, r2) in enumerate(kept) if r2 <= 1 / (alpha * alpha)], {}, Unions()
        for k in here:
            a, b, c = sorted(kept[k][0])
            for side in ((a, b), (b, c), (a, c)):
                sets.join(k, edge.setdefault(side, k))
        areas: dict[int, float] = {}
        for k in here:
            areas[sets.find(k)] = areas.get(sets.find(k), 0.0) + size[k]
        out.append([x for x in areas.values() if x > 0])
    return out


def buffered_in_box(ring: np.ndarray, by: float, box: tuple[float, float, float, float]) -> float:
    """Area inside x0, y0, x1, y1 of a convex ring (one and two points too) widened by ``by``; arcs of 64 chords a turn."""
    turn = np.arange(64) * (np.pi / 32)
    around = np.stack([np.cos(turn), np.sin(turn)], axis=1) * by
    shape = [tuple(p) for p in convex_hull((np.asarray(ring, float)[:, None, :] + around[None]).reshape(-1, 2))]
    for axis, at, sign in ((0, box[0], 1), (1, box[1], 1), (0, box[2], -1), (1, box[3], -1)):
        cut = []
        for p, q in zip(shape, shape[1:] + shape[:1]):
            u, v = sign * (p[axis] - at), sign * (q[axis] - at)
            if u >= 0:
                cut.append(p)
            if (u < 0) != (v < 0):
                cut.append(tuple(a + (b - a) * u / (u - v) for a, b in zip(p, q)))
        shape = cut
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(shape, shape[1:] + shape[:1]))) / 2


def alpha_area(points: np.ndarray, alpha: float) -> float:
    return alpha_areas(points, [alpha])[0]


def prune_boxes(points_in: list[set[int]], coverage: list[float], lam: float = 1.0, a: float = 0.001, threshold: float = 0.0008, least: float = 0.5) -> list[int]:
    """Boxes kept: while leaving one out lowers lam * mean(1 / (n + a)) by more than the threshold, the first such goes."""
    kept = list(range(len(points_in)))
    cost = lambda ks: lam * float(np.mean([1 / (len(points_in[k]) + a) for k in ks])) if ks else float("nan")
    again = True
    while again and len(kept) > 1:
        again = False
        for k in kept:
            if cost(kept) - cost([x for x in kept if x != k]) > threshold:
                kept.remove(k)
                again = True
                break
    return [k for k in kept if coverage[k] >= least]


def ground_filter(heights: np.ndarray, resolution: float = 1.5, rigidness: int = 3, rounds: int = 500, step: float = 0.65, top: float | None = None, settled: float = 0.005) -> np.ndarray:
    """A cloth dropped on the inverted heights of a grid (Zhang et al., 2016); the surface it comes to rest on.

    An approximation on a regular grid: every round the cloth falls, then neighbours pull each other together. It falls
    from above ``top``, the greatest inverted height (of the grid, if not given), until no cell moves by ``settled``.
    """
    floor = -fill_nearest(heights)
    cloth = np.full(floor.shape, (np.nanmax(floor) if top is None else top) + 10.0)
    fixed, fall = np.zeros(floor.shape, bool), 0.2 * step * step
    before = cloth + fall
    for _ in range(rounds):
        moved = np.where(fixed, cloth, cloth + (cloth - before) * 0.99 - fall)
        before = cloth
        for _ in range(rigidness):
            wide = np.pad(moved, 1, mode="edge")
            mean = (wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:]) / 4
            moved = np.where(fixed, moved, moved + 0.5 * (mean - moved))
        hit = moved <= floor
        cloth = np.where(hit, floor, moved)
        fixed |= hit
        if np.abs(cloth - before).max(initial=0) <= settled:
            break
    return -cloth
