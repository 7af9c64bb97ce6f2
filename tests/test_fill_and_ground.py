"""Fill and cloth on a raster of several tiles against the same kernel on the whole grid."""

import numpy as np

from plumbline.operators import kernels, tiles


def frame(spark, grid):
    rows = [(int(r), int(c), float(grid[r, c])) for r, c in np.argwhere(np.isfinite(grid))]
    return spark.createDataFrame(rows, "row int, col int, z double")


def grid_of(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert np.isnan(out[r["row"], r["col"]])
        out[r["row"], r["col"]] = r["z"]
    return out


def test_fill_is_exact_over_the_whole_raster(spark):
    rng = np.random.default_rng(3)
    grid = np.where(rng.random((37, 100)) < 0.02, rng.random((37, 100)), np.nan)
    grid[:, 30:70] = np.nan
    grid[0:9] = np.nan
    got = grid_of(tiles.filled(frame(spark, grid), grid.shape), grid.shape)
    assert np.isfinite(got).all() and (got == kernels.fill_nearest(grid)).all()
    known = np.argwhere(np.isfinite(grid))
    for i, j in np.ndindex(grid.shape):
        d = ((known - [i, j]) ** 2).sum(1)
        assert got[i, j] in [grid[tuple(p)] for p in known[d == d.min()]]
    assert tiles.filled(frame(spark, grid).limit(0), (5, 5)).count() == 0


def test_ground_does_not_depend_on_tiles(spark):
    rng = np.random.default_rng(4)
    grid = np.add.outer(np.linspace(0, 3, 25), np.linspace(0, 4, 70)) + rng.random((25, 70)) / 4
    grid[6:16, 14:22] += 15
    grid[5:20, 45:60] += 9
    grid[rng.random(grid.shape) < 0.3] = np.nan
    grid[:, 33:38] = np.nan
    for tile, rounds in ((8, 4), (8, 40), (100, 40)):
        whole = kernels.ground_filter(grid, rounds=rounds, settled=0.0)
        assert np.allclose(grid_of(tiles.ground(frame(spark, grid), tile, grid.shape, rounds=rounds), grid.shape), whole)
