"""Edges, regions and perspective against flood fill, plain loops and a linear solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.operators import contours as C
from inkfold.operators import pixels

W, H = 9, 7
RNG = np.random.default_rng(5)
MASKS = [(RNG.random((H, W)) < p).astype(int) for p in (0.1, 0.3, 0.4, 0.5, 0.6, 0.9) for _ in range(4)] + [np.zeros((H, W), int), np.ones((H, W), int), np.indices((H, W)).sum(0) % 2]


def flood(mask):
    """Regions as sets of places, by walking from pixel to pixel."""
    left, out = {(r, c) for r in range(H) for c in range(W) if mask[r, c]}, []
    while left:
        todo, seen = [min(left)], set()
        while todo:
            r, c = todo.pop()
            if (r, c) in left:
                left.discard((r, c))
                seen.add((r, c))
                todo += [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        out.append({r * W + c for r, c in seen})
    return out


def frame(spark, grids):
    rows = [(k, np.asarray(g).ravel().tolist()) for k, g in enumerate(grids)] + [(90, None), (91, [1]), (92, [None] * (W * H))]
    return spark.createDataFrame(rows, "k int, g array<int>")


def test_regions_are_those_of_flood_fill(spark):
    got = {r.k: r.x for r in frame(spark, MASKS).select("k", C.regions(F.col("g"), W, H, 99).alias("x")).collect()}
    for k, m in enumerate(MASKS):
        assert sorted((r.place, r.size) for r in got[k]) == sorted((min(s), len(s)) for s in flood(m))
        assert [r.area for r in got[k]] == sorted((r.area for r in got[k]), reverse=True)
    assert got[90] is got[91] is got[92] is None and got[25][0].area == (W - 1) * (H - 1)
    assert sorted((p.x, p.y) for p in got[25][0].corners) == [(0, 0), (0, H - 1), (W - 1, 0), (W - 1, H - 1)]
    top = {r.k: r.x for r in frame(spark, MASKS).select("k", C.regions(F.col("g"), W, H, 2).alias("x")).collect()}
    assert all(top[k] == got[k][:2] for k in range(len(MASKS)))


def test_a_long_region_is_one():
    spiral = np.zeros((61, 61), bool)
    for d in range(0, 30, 2):
        spiral[d, d : 61 - d] = spiral[60 - d, d : 61 - d] = spiral[d : 61 - d, 60 - d] = spiral[d + 2 : 61 - d, d] = True
        spiral[d + 2, d : d + 2] = True
    labels = C.region_labels(spiral[None])[0]
    assert set(labels[spiral].tolist()) == {0} and (labels[~spiral] == -1).all()


def test_edges_by_plain_loops(spark):
    grids = [RNG.integers(0, 256, (H, W)) for _ in range(10)] + [np.where(np.arange(W) < 4, 10, 14 + 40 * (np.arange(H)[:, None] > 2)) * np.ones((H, W), int), np.full((H, W), 7)]
    got = {r.k: r.x for r in frame(spark, grids).select("k", C.edges(F.col("g"), W, H, 200, 500).alias("x")).collect()}
    for k, g in enumerate(grids):
        at = lambda r, c: float(g[min(max(r, 0), H - 1), min(max(c, 0), W - 1)])  # noqa: E731, B023
        size, thin = {}, set()
        slope = {}
        for r in range(H):
            for c in range(W):
                gx = at(r - 1, c + 1) + 2 * at(r, c + 1) + at(r + 1, c + 1) - at(r - 1, c - 1) - 2 * at(r, c - 1) - at(r + 1, c - 1)
                gy = at(r + 1, c - 1) + 2 * at(r + 1, c) + at(r + 1, c + 1) - at(r - 1, c - 1) - 2 * at(r - 1, c) - at(r - 1, c + 1)
                size[r, c], slope[r, c] = abs(gx) + abs(gy), (gx, gy)
        for (r, c), (gx, gy) in slope.items():
            angle = np.degrees(np.arctan2(abs(gy), abs(gx)))
            dr, dc = (0, 1) if angle < 22.5 else (1, 0) if angle > 67.5 else (1, 1) if gx * gy >= 0 else (1, -1)
            if size[r, c] > size.get((r - dr, c - dc), -1) and size[r, c] >= size.get((r + dr, c + dc), -1) and size[r, c] > 200:
                thin.add((r, c))
        m = np.zeros((H, W), int)
        for r, c in thin:
            m[r, c] = 1
        want = set().union(*[s for s in flood(m) if any(size[p // W, p % W] > 500 for p in s)])
        assert {p for p, x in enumerate(got[k]) if x} == want
    assert got[90] is got[91] is got[92] is None


def solved(quad, w, h):
    """The homography of four point pairs by the 8 x 8 linear system."""
    a, b = [], []
    for (u, v), (x, y) in zip([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)], quad, strict=True):
        a += [[u, v, 1, 0, 0, 0, -x * u, -x * v], [0, 0, 0, u, v, 1, -y * u, -y * v]]
        b += [x, y]
    return np.append(np.linalg.solve(np.array(a, float), np.array(b, float)), 1).reshape(3, 3)


QUADS = [[(0, 0), (8, 0), (8, 6), (0, 6)], [(1, 1), (7, 0.5), (8, 6), (0.5, 5)], [(2.2, 1.1), (6.3, 1.9), (5.8, 4.4), (1.7, 3.9)], [(-1, -1), (9, 0), (8, 7), (0, 6)]]


def test_warp_equals_the_linear_system(spark):
    g = RNG.integers(0, 256, (H, W))
    rows = [(k, g.ravel().tolist(), q, w, h) for k, (q, w, h) in enumerate((q, w, h) for q in QUADS for w, h in [(9, 7), (5, 4), (2, 11)])]
    rows += [(90, None, QUADS[0], 3, 3), (91, g.ravel().tolist(), [(1, 1)] * 4, 3, 3), (92, g.ravel().tolist(), QUADS[0], 1, 3), (93, g.ravel().tolist(), None, 3, 3)]
    df = spark.createDataFrame([(k, a, [(float(x), float(y)) for x, y in q] if q else None, w, h) for k, a, q, w, h in rows], "k int, g array<int>, q array<struct<x double, y double>>, w int, h int")
    got = {r.k: r.x for r in df.select("k", C.warped(F.col("g"), F.col("q"), W, H, F.col("w"), F.col("h")).alias("x")).collect()}
    assert got[0] == g.ravel().tolist()  # the whole grid is itself
    for k, _, q, w, h in rows[:-4]:
        m = solved(q, w, h)
        for v in range(h):
            for u in range(w):
                x, y, z = m @ [u, v, 1]
                x, y = x / z, y / z
                c, r = int(np.floor(x + 1e-9)), int(np.floor(y + 1e-9))
                pick = lambda r, c: float(g[r, c]) if 0 <= r < H and 0 <= c < W else 0.0
                want = (pick(r, c) * (1 - x + c) + pick(r, c + 1) * (x - c)) * (1 - y + r) + (pick(r + 1, c) * (1 - x + c) + pick(r + 1, c + 1) * (x - c)) * (y - r)
                assert abs(got[k][v * w + u] - want) <= 0.501
    assert all(got[k] is None for k in (90, 91, 92, 93))


def test_bright_masks_are_those_by_columns(spark):
    grids = [RNG.integers(0, 256, (H, W)) for _ in range(6)] + [np.where(np.indices((H, W)).sum(0) < 8, 200, 30), np.full((H, W), 5)]
    by_columns = {r.k: r.region.mask for r in pixels.bright_region(frame(spark, grids), "g", W, H).collect()}
    for k, m in enumerate(C.bright_mask(np.array(grids, float))):
        assert m.ravel().astype(int).tolist() == (by_columns[k] or [0] * (W * H))


def test_least_box_is_the_least_of_all_turns():
    for _ in range(20):
        outline = C.hull(RNG.integers(0, 30, (12, 2)))
        turns = [np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) for t in np.linspace(0, np.pi / 2, 2000)]
        least = min(np.prod(np.ptp(outline @ t.T, axis=0)) for t in turns)
        assert C.area_of(C.least_box(outline)) <= least + 1e-6


@pytest.mark.parametrize("tilt", [0.0, 0.12])
def test_a_bright_card_is_cropped_upright(spark, tilt):
    w, h = 60, 48
    y, x = np.mgrid[:h, :w]
    u, v = (x - 30) * np.cos(tilt) + (y - 24) * np.sin(tilt), -(x - 30) * np.sin(tilt) + (y - 24) * np.cos(tilt)
    image = np.where((abs(u) <= 17) & (abs(v) <= 10), 230, 20)
    image = np.where((abs(u + 8) <= 2) & (abs(v) <= 8), 120, image)
    rows = [(1, image.ravel().tolist(), "x"), (2, np.full(w * h, 9).tolist(), "y"), (3, None, "z")]
    df = spark.createDataFrame(rows, "k int, g array<int>, _found string")
    out = C.cropped(df, "g", w, h, least=(20, 10), reach=1, times=1)
    assert out.columns == ["k", "g", "_found", "crop"]
    got = {r.k: r.crop for r in out.collect()}
    crop = got[1]
    assert abs(crop.width - 35) <= 6 and abs(crop.height - 21) <= 6 and len(crop.pixels) == crop.width * crop.height
    inner = np.array(crop.pixels).reshape(crop.height, crop.width)[4:-4, 4:-4]
    assert (inner > 100).mean() > 0.97 and (inner < 160).any()
    assert got[2] is None and got[3] is None
