"""The queries over all points against brute force at sf0.01; none is about an empty or a single group."""

from collections import defaultdict

import duckdb
import numpy as np
import pytest

from plumbline.plans import QUERIES
from plumbline.plans.fixtures import POINTS_SQL

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def p():
    return duckdb.connect().execute(f"WITH {POINTS_SQL.replace('FROM events', f'''FROM '{SF}/events.parquet' ''')} FROM points ORDER BY id").df()


def cells_of(p):
    e = p[p.cls == "error"]
    return set(zip((e.y // 6).astype(int), (e.x // 2).astype(int)))


def reached(start, around):
    """start -> the smallest member of what it reaches."""
    out, left = {}, set(start)
    while left:
        todo, found = [left.pop()], set()
        while todo:
            found.add(at := todo.pop())
            new = left & set(around(at))
            left -= new
            todo += new
        out |= dict.fromkeys(found, min(found))
    return out


def in_box(p, k):
    x0, y0 = k // 5 * 30, k % 5 * 144
    return p[(p.x > x0) & (p.x < x0 + 30) & (p.y > y0) & (p.y < y0 + 144)], x0, y0


def test_boxes(spark, p):
    raw, cover, n = {}, {}, {}
    for k in range(25):
        q, x0, y0 = in_box(p[p.cls == "error"], k)
        occ = {(min(9, int((x - x0) // 3)), min(11, int((y - y0) // 12))) for x, y in zip(q.x, q.y)}
        grown = {(i + a, j + b) for i, j in occ for a, b in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= i + a < 10 and 0 <= j + b < 12}
        raw[k], cover[k], n[k] = len(occ) / 120, len(grown) / 120, len(q)
    got = QUERIES["a10_coverage_all"](spark, SF).collect()
    assert {r["box"]: r["raw"] for r in got} == pytest.approx(raw, abs=1e-6) and {r["box"]: r["coverage"] for r in got} == pytest.approx(cover, abs=1e-6)
    assert 0 < min(raw.values()) < max(cover.values())
    kept = {k: v >= 70 for k, v in n.items()}
    side = lambda k: [j for j in range(25) if abs(j // 5 - k // 5) + abs(j % 5 - k % 5) == 1]
    final = {k: kept[k] or all(kept[j] for j in side(k)) for k in kept}
    got = QUERIES["j14_rescue_all"](spark, SF).collect()
    assert {r["box"]: (r["kept"], r["final"]) for r in got} == {k: (kept[k], final[k]) for k in kept}
    assert 0 < sum(kept.values()) < sum(final.values())


def test_points(spark, p):
    got = {r["cls"]: r for r in QUERIES["j08_nn_spacing_all"](spark, SF).collect()}
    for cls, g in p.groupby("cls"):
        xy = g[["x", "y"]].to_numpy()
        d = np.array([np.partition(np.hypot(*(xy - q).T), 1)[1] for q in xy])
        d = d[d > 0]
        assert (got[cls]["n"], *(got[cls][q] for q in ("q50", "q75", "q90"))) == pytest.approx((len(d), *np.quantile(d, (0.5, 0.75, 0.9))), abs=1e-6)
    xy, ids = p[["x", "y"]].to_numpy(), p.id.to_numpy()
    want = reached(range(len(p)), lambda i: np.flatnonzero(((xy - xy[i]) ** 2).sum(1) <= 1.5**2).tolist())
    got = {r["id"]: r["cluster"] for r in QUERIES["m17_distance_clusters_all"](spark, SF).collect()}
    assert got == {int(ids[i]): int(ids[j]) for i, j in want.items()} and 1 < len(set(got.values())) < len(got)
    truths = defaultdict(list)
    for x, i, y in p[p.cls.isin(["signup", "click"])][["x", "id", "y"]].itertuples(index=False):
        truths[x].append((y, i))
    taken, want = set(), {}
    for x, i, y in p[~p.cls.isin(["signup", "click"])].sort_values("id")[["x", "id", "y"]].itertuples(index=False):
        d, gt = min(((y - t) ** 2, g) for t, g in truths[x])
        hit = d < 25 and gt not in taken
        taken |= {gt} if hit else set()
        want[i] = (gt, int(hit))
    got = {r["pred"]: (r["gt"], r["tp"]) for r in QUERIES["j20_greedy_match_all"](spark, SF).collect()}
    assert got == want and 0 < sum(tp for _, tp in want.values()) < len(want)


def test_cells(spark, p):
    g, width = cells_of(p), int(p.x.max() // 2) + 1
    height = int(p.y.max() // 6) + 1
    want = reached(g, lambda a: [(a[0] + i, a[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    got = {(r["row"], r["col"]): r["component"] for r in QUERIES["m06_components_all"](spark, SF).collect()}
    assert got == {k: r * width + col for k, (r, col) in want.items()} and len(set(got.values())) > 100
    disk = [(i, j) for i in range(-3, 4) for j in range(-3, 4) if i * i + j * j <= 9]
    grown = {(r + i, col + j) for r, col in g for i, j in disk}
    closed = {(r, col) for r, col in grown if 0 <= r < height and 0 <= col < width and all((r + i, col + j) in grown for i, j in disk)}
    assert {tuple(r) for r in QUERIES["m03_closing_all"](spark, SF).collect()} == closed and g < closed
    diamond = [(i, j) for i in range(-3, 4) for j in range(-3, 4) if abs(i) + abs(j) <= 3]
    assert {tuple(r) for r in QUERIES["m05_dilate_all"](spark, SF).collect()} == {(r + i, col + j) for r, col in g for i, j in diamond}
