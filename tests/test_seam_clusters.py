"""Several patches at one border: every bridge cell goes to the components that its own patch joins."""

from plumbline.operators import kernels, tiles


def block(r0, c0, name, n=3, wide=5):
    return [(r, c, name) for r in range(r0, r0 + n) for c in range(c0, c0 + wide)]


def test_bridges_and_clusters(spark):
    rows = block(3, 4, 1) + block(3, 11, 2) + block(12, 4, 5) + block(12, 11, 7)  # two joined patches at the border 9 | 10
    rows += block(21, 4, 8, 1, 1) + block(21, 6, 9, 1, 1)  # a patch that joins nothing over the border
    rows += [(r, c, 2) for r in range(3, 6) for c in range(16, 19)] + block(3, 21, 4)  # 2 reaches the next border
    cells = spark.createDataFrame(rows, "row int, col int, component long")
    pairs, bridge = tiles.seams(cells, 30, 10, 4, 2)
    assert {tuple(r) for r in pairs.collect()} == {(1, 2), (5, 7), (2, 4)}
    found = {(r["row"], r["col"]): r["a"] for r in bridge.collect()}
    assert found[(4, 9)] == found[(4, 10)] == 1 and found[(13, 9)] == found[(13, 10)] == 5 and found[(4, 19)] == found[(4, 20)] == 2
    assert not any(r > 18 for r, _ in found)
    clusters = tiles.seam_clusters(cells, pairs, bridge).collect()
    at = {(r["row"], r["col"]): r["cluster"] for r in clusters}
    assert len(at) == len(clusters) == len(set(rows)) + len(found)
    root = {1: 1, 2: 1, 4: 1, 5: 5, 7: 5, 8: 8, 9: 9}
    assert at == {(r, c): root[n] for r, c, n in rows} | {k: root[n] for k, n in found.items()}


def test_seam_kernel_tells_patches_apart():
    import numpy as np

    left, right = np.zeros((20, 6), int), np.zeros((20, 6), int)
    left[3:6, 2:5], right[3:6, 0:3], left[12:15, 2:5], right[12:15, 0:3] = 7, 9, 4, 2
    pairs, bridge = kernels.seam_pairs(left, right, 2)
    assert pairs == {(7, 9), (4, 2)} and bridge[4, 5] == 7 and bridge[13, 5] == 2
