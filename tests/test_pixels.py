"""Luminance grids against NumPy and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.operators import pixels as P

W, H = 7, 5
RNG = np.random.default_rng(11)
GRIDS = [RNG.integers(0, 256, (H, W)) for _ in range(12)] + [np.full((H, W), 90), np.zeros((H, W), int), np.where(np.arange(H * W).reshape(H, W) % 9 < 6, 220, 30)]


@pytest.fixture(scope="module")
def df(spark):
    rows = [(k, g.ravel().tolist()) for k, g in enumerate(GRIDS)] + [(90, None), (91, [1, 2]), (92, [None] * (W * H)), (93, [])]
    return spark.createDataFrame(rows, "k int, g array<int>").persist()


def found(df, column):
    return {r.k: r.x for r in df.select("k", column.alias("x")).collect()}


def test_quarter_turns(df):
    got = found(df, P.turned(F.col("g"), W, H, 90))
    for k, g in enumerate(GRIDS):
        assert got[k] == np.rot90(g, -1).ravel().tolist()
    assert got[90] is got[91] is got[92] is got[93] is None
    back = df.withColumn("g", P.turned(F.col("g"), W, H, 90)).withColumn("g", P.turned(F.col("g"), H, W, 270))
    assert {k: v for k, v in found(back, F.col("g")).items() if k < 90} == {k: g.ravel().tolist() for k, g in enumerate(GRIDS)}
    assert found(df, P.turned(F.col("g"), W, H, -90)) == found(df, P.turned(F.col("g"), W, H, 270))


def test_reduction_keeps_the_sum_of_covered_areas(df):
    got = found(df, P.reduced(F.col("g"), W, H, 3))
    w, h = 3, round(H / (W / 3))
    for k, g in enumerate(GRIDS):
        fine = np.kron(g, np.ones((h, w)))  # every pixel in h x w parts
        want = fine.reshape(h, H, w, W).mean((1, 3))
        assert np.allclose(np.array(got[k]).reshape(h, w), want) and np.isclose(np.mean(got[k]), g.mean())
    assert found(df, P.reduced(F.col("g"), W, H, 9))[0] == GRIDS[0].ravel().tolist() and got[91] is None


def test_stretch_and_brightness(df):
    got = found(df.where("k < 90"), P.stretched(F.col("g"), 0.1))
    level = lambda x: np.clip(np.floor(x + 0.5), 0, 255).astype(int)
    for k, g in enumerate(GRIDS):
        o = np.sort(g.ravel())
        low, high = o[3], o[-4]
        want = level((g - low) * 255.0 / (high - low)) if high > low else g
        assert got[k] == want.ravel().tolist()
    lit = found(df.where("k < 90"), P.brightened(F.col("g")))
    for k, g in enumerate(GRIDS):
        assert lit[k] == level(g * (1.08 if g.mean() < 155 else 0.96 if g.mean() > 225 else 1.0)).ravel().tolist()


def test_sharpening(df):
    got = found(df, P.sharpened(F.col("g"), W, H, 1.5))
    for k, g in enumerate(GRIDS):
        want = g.astype(float).copy()
        for r in range(1, H - 1):
            for c in range(1, W - 1):
                smooth = (g[r - 1 : r + 2, c - 1 : c + 2].sum() + 4 * g[r, c]) / 13
                want[r, c] = smooth + (g[r, c] - smooth) * 1.5
        assert np.abs(np.array(got[k]) - np.clip(np.floor(want + 0.5), 0, 255).ravel()).max() <= 1e-9
    assert got[90] is None and got[13] == [0] * (W * H)


def test_threshold_and_region(df):
    got = {r.k: r.region for r in P.bright_region(df, "g", W, H).collect()}

    def around(m, of):
        return np.array([[of(m[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2]) for c in range(W)] for r in range(H)])

    for k, g in enumerate(GRIDS):
        best = None
        for t in sorted(set(g.ravel().tolist()))[:-1]:
            low, high = g[g <= t], g[g > t]
            spread = len(low) * len(high) * (low.mean() - high.mean()) ** 2
            if best is None or spread > best[0] * (1 + 1e-12):
                best = (spread, t)
        assert got[k].threshold == (best and best[1])
        if best is None:
            assert got[k].mask is None
            continue
        m = (g > best[1]).astype(int)
        for of in (np.max, np.max, np.min, np.min, np.min, np.max):
            m = around(m, of)
        assert got[k].mask == m.ravel().tolist() and got[k].is_region == (0.12 <= m.mean() <= 0.95)
    assert all(got[k].threshold is None and got[k].mask is None for k in (90, 91, 92, 93))
