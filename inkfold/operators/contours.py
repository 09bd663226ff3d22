"""Edges, connected regions, corners and perspective of luminance grids.

Regions grow until nothing changes, which columns cannot say: they are found in Arrow batches, many grids in one array, in blocks
of a bounded number of pixels. What follows a region's corners (their order, size, sampling) is columns again. Grids are as in
`pixels`; a broken one (null, another number of values, nulls inside) has no edges, no regions and no crop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import layout, pixels

# The two edge thresholds, the share of an outline's length within which a corner is straight, how many of the largest
# regions are looked at and the least share of the image for each, the least crop and the sides' ratio of a card.
WEAK, STRONG, STRAIGHT = 30, 90, 0.02
LARGEST, LEAST_SHARE = 8, 0.08
LEAST_WIDTH, LEAST_HEIGHT, LEAST_RATIO, MOST_RATIO = 180, 100, 1.15, 2.25
BLOCK = 4_000_000  # pixels that are worked on at once
NEAR = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]
REGIONS = "array<struct<place:int,size:int,area:double,corners:array<struct<x:double,y:double>>,box:array<struct<x:double,y:double>>>>"


def _moved(a: np.ndarray, r: int, c: int, beyond: float) -> np.ndarray:
    """a[:, y + r, x + c], and `beyond` outside."""
    out = np.full_like(a, beyond)
    h, w = a.shape[1:]
    out[:, max(0, -r) : h - max(0, r), max(0, -c) : w - max(0, c)] = a[:, max(0, r) : h + min(0, r), max(0, c) : w + min(0, c)]
    return out


def smoothed(a: np.ndarray) -> np.ndarray:
    """Each value the mean of its 5 x 5 neighbourhood, weighted 1 4 6 4 1 both ways; the border is repeated outward."""
    for axis in (1, 2):
        n = a.shape[axis]
        a = sum(k * np.take(a, np.clip(np.arange(n) + d, 0, n - 1), axis) for d, k in zip((-2, -1, 0, 1, 2), (1, 4, 6, 4, 1), strict=True)) / 16
    return a


def edge_mask(a: np.ndarray, weak: float = WEAK, strong: float = STRONG) -> np.ndarray:
    """Where the gradient is greatest across itself: above `strong`, or above `weak` and joined to such a pixel through others."""
    h, w = a.shape[1:]
    at = lambda r, c: a[:, np.clip(np.arange(h) + r, 0, h - 1)[:, None], np.clip(np.arange(w) + c, 0, w - 1)]
    gx = sum(k * (at(d, 1) - at(d, -1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(k * (at(1, d) - at(-1, d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    size = np.abs(gx) + np.abs(gy)
    flat, steep = np.abs(gy) < np.abs(gx) * np.tan(np.pi / 8), np.abs(gy) > np.abs(gx) * np.tan(3 * np.pi / 8)
    thin = np.zeros(a.shape, bool)
    for where, (r, c) in ((flat, (0, 1)), (steep, (1, 0)), (~flat & ~steep & (gx * gy >= 0), (1, 1)), (~flat & ~steep & (gx * gy < 0), (1, -1))):
        thin |= where & (size > _moved(size, -r, -c, -1)) & (size >= _moved(size, r, c, -1))
    labels = region_labels(thin & (size > weak))
    return _with_any(labels, size > strong)


def _with_any(labels: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The regions of which a pixel is wanted."""
    n, cells = len(labels), labels[0].size if len(labels) else 0
    flat = np.where(labels >= 0, labels + np.arange(n)[:, None, None] * cells, -1)
    good = np.zeros(n * cells + 1, bool)
    good[flat[(flat >= 0) & wanted]] = True
    return good[flat] & (flat >= 0)


def around(mask: np.ndarray, reach: int, grow: bool) -> np.ndarray:
    """The mask grown or shrunk by a square of that reach; beyond the edge nothing counts."""
    for _ in range(reach):
        parts = [_moved(mask, r, c, not grow) for r, c in NEAR]
        mask = mask | np.logical_or.reduce(parts) if grow else mask & np.logical_and.reduce(parts)
    return mask


def region_labels(mask: np.ndarray) -> np.ndarray:
    """For each marked pixel the first place (row by row) of its region, pixels touching by side or corner; -1 elsewhere. Places
    are passed to neighbours and then looked up at the place passed on, so that long regions take few rounds."""
    n, h, w = mask.shape
    none = h * w
    labels = np.where(mask, np.arange(h * w).reshape(h, w), none)
    while True:
        least = np.minimum.reduce([labels, *[_moved(labels, r, c, none) for r, c in NEAR]])
        least = np.where(mask, least, none)
        wide = np.concatenate([least.reshape(n, -1), np.full((n, 1), none)], 1)
        least = np.minimum(least, np.take_along_axis(wide, least.reshape(n, -1), 1).reshape(n, h, w))
        if (least == labels).all():
            return np.where(mask, labels, -1)
        labels = least


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the least convex outline, in turn."""
    points = sorted(set(map(tuple, points.tolist())))
    if len(points) < 3:
        return np.array(points, float)

    def half(order: list) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]), float)


def area_of(outline: np.ndarray) -> float:
    x, y = outline[:, 0], outline[:, 1]
    return float(abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2)


def straightened(outline: np.ndarray, share: float = STRAIGHT) -> np.ndarray:
    """The outline without corners that are nearer to the line of their neighbours than a share of its length, the nearest first."""
    allowed = share * np.linalg.norm(outline - np.roll(outline, -1, 0), axis=1).sum()
    while len(outline) > 3:
        a, b = np.roll(outline, 1, 0), np.roll(outline, -1, 0)
        d = b - a
        off = np.abs(d[:, 0] * (outline[:, 1] - a[:, 1]) - d[:, 1] * (outline[:, 0] - a[:, 0])) / np.maximum(np.linalg.norm(d, axis=1), 1e-12)
        k = int(off.argmin())
        if off[k] > allowed:
            break
        outline = np.delete(outline, k, 0)
    return outline


def least_box(outline: np.ndarray) -> np.ndarray:
    """The rectangle of least area around a convex outline: one of its sides lies on one of the outline's."""
    best, found = np.inf, outline
    for side in np.roll(outline, -1, 0) - outline:
        if not side.any():
            continue
        u = side / np.linalg.norm(side)
        turn = np.array([u, [-u[1], u[0]]])
        p = outline @ turn.T
        (x0, y0), (x1, y1) = p.min(0), p.max(0)
        if (x1 - x0) * (y1 - y0) < best:
            best, found = (x1 - x0) * (y1 - y0), np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]]) @ turn
    return found


def _described(labels: np.ndarray, most: int) -> list[dict]:
    """The largest regions of one image by the area of their outlines, then by size and place. An outline needs each row's first and
    last pixel alone."""
    y, x = np.nonzero(labels >= 0)
    if not len(y):
        return []
    of = labels[y, x]
    out = []
    order = np.lexsort((x, y, of))
    y, x, of = y[order], x[order], of[order]
    row_first = np.r_[True, (of[1:] != of[:-1]) | (y[1:] != y[:-1])]
    row_last = np.r_[row_first[1:], True]
    places, begins = np.unique(of, return_index=True)
    for place, a, b in zip(places, begins, np.r_[begins[1:], len(of)], strict=True):
        edge = row_first[a:b] | row_last[a:b]
        outline = hull(np.column_stack([x[a:b][edge], y[a:b][edge]]))
        out.append({"place": int(place), "size": int(b - a), "area": area_of(outline), "outline": outline})
    out = sorted(out, key=lambda r: (-r["area"], -r["size"], r["place"]))[:most]
    points = lambda p: [{"x": float(px), "y": float(py)} for px, py in p]
    return [{"place": r["place"], "size": r["size"], "area": r["area"], "corners": points(straightened(r["outline"])), "box": points(least_box(r["outline"]))} for r in out]


def _batched(width: int, height: int, kind: str, work: Callable[[np.ndarray], list]) -> Callable[[Column], Column]:
    """A column function: work on blocks of whole grids as one (n, height, width) array; null for the broken ones."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        step = max(1, BLOCK // (width * height))
        for grids in batches:
            out: list = [None] * len(grids)
            for begin in range(0, len(grids), step):
                part = {k: g for k, g in enumerate(grids.iloc[begin : begin + step], begin) if g is not None and len(g) == width * height and not pd.isna(g).any()}
                if part:
                    found = work(np.array([np.asarray(g, float) for g in part.values()]).reshape(-1, height, width))
                    for k, value in zip(part, found, strict=True):
                        out[k] = value
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def edges(grid: Column, width: int, height: int, weak: float = WEAK, strong: float = STRONG) -> Column:
    """0/1 for each pixel of a grid (of numbers): the edges of edge_mask."""
    return _batched(width, height, "array<int>", lambda a: [m.ravel().astype(int).tolist() for m in edge_mask(a, weak, strong)])(grid)


def regions(mask: Column, width: int, height: int, most: int = LARGEST) -> Column:
    """The `most` largest regions of a 0/1 grid, by the area inside their convex outline through pixel centres, then by size and
    place: struct<place (of the first pixel), size (in pixels), area, corners (of the straightened outline), box (the least
    rectangle around it)>."""
    return _batched(width, height, REGIONS, lambda a: [_described(x, most) for x in region_labels(a > 0)])(mask)


def edge_regions(grid: Column, width: int, height: int, reach: int = 3, times: int = 3) -> Column:
    """The largest regions that edges enclose or fill: smoothed, edges, grown once, then closed several times."""

    def work(a: np.ndarray) -> list:
        m = around(edge_mask(smoothed(a)), reach, True)
        m = around(around(m, reach * times, True), reach * times, False)
        return [_described(x, LARGEST) for x in region_labels(m)]

    return _batched(width, height, REGIONS, work)(grid)


def split_level(a: np.ndarray) -> int | None:
    """The threshold of pixels.threshold of one image of whole levels, from its histogram."""
    counts = np.bincount(a.ravel().astype(int), minlength=pixels.LEVELS)
    n, below, sums = a.size, np.cumsum(counts), np.cumsum(counts * np.arange(pixels.LEVELS))
    gap = (sums * n - sums[-1] * below).astype(float)
    parts = (counts > 0) & (below < n)
    return int(np.argmax(np.where(parts, gap * gap / np.maximum(below * (n - below), 1), -1))) if parts.any() else None


def bright_mask(a: np.ndarray, reach: int = 1) -> np.ndarray:
    """What is brighter than each image's split level, closed twice and opened once; nothing in an image of one level. The mask of
    pixels.bright_region, at any size of image."""
    a = np.clip(np.floor(a + 0.5), 0, pixels.LEVELS - 1)
    m = np.array([x > t if (t := split_level(x)) is not None else np.zeros(x.shape, bool) for x in a])
    return around(around(around(around(m, 2 * reach, True), 2 * reach, False), reach, False), reach, True)


def bright_regions(grid: Column, width: int, height: int, reach: int = 1, most: int = 5) -> Column:
    """The largest bright regions, as `regions` gives them."""
    return _batched(width, height, REGIONS, lambda a: [_described(x, most) for x in region_labels(bright_mask(a, reach))])(grid)


def sides(quad: Column) -> tuple[Column, Column]:
    """Whole width and height of a crop by ordered corners (top left, top right, bottom right, bottom left): the longer of each two
    opposite sides."""
    long = lambda a, b: F.sqrt((F.get(quad, a)["x"] - F.get(quad, b)["x"]) ** 2 + (F.get(quad, a)["y"] - F.get(quad, b)["y"]) ** 2)
    return F.floor(F.greatest(long(2, 3), long(1, 0))).cast("int"), F.floor(F.greatest(long(1, 2), long(0, 3))).cast("int")


def is_card(width: Column, height: Column, least: tuple[int, int] = (LEAST_WIDTH, LEAST_HEIGHT)) -> Column:
    """Whether a crop is large enough and its sides have a card's ratio."""
    ratio = F.greatest(width, height) / F.nullif(F.least(width, height), F.lit(0))
    return F.coalesce((width >= least[0]) & (height >= least[1]) & ratio.between(LEAST_RATIO, MOST_RATIO), F.lit(False))


def warped(grid: Column, quad: Column, width: int, height: int, to_width: Column, to_height: Column) -> Column:
    """What lies within ordered corners as an upright grid of that size. The eight parameters that take the upright corners to the
    quad are solved in closed form, so every new pixel asks where it comes from; values between pixels are mixed by distance, and
    places outside count 0. Null where the quad has no area, a side has fewer than two pixels or the grid is broken."""
    x, y = ([F.get(quad, k)[c] for k in range(4)] for c in "xy")
    dx1, dx2, sx = x[1] - x[2], x[3] - x[2], x[0] - x[1] + x[2] - x[3]
    dy1, dy2, sy = y[1] - y[2], y[3] - y[2], y[0] - y[1] + y[2] - y[3]
    area = dx1 * dy2 - dx2 * dy1
    g, h = (sx * dy2 - dx2 * sy) / F.nullif(area, F.lit(0.0)), (dx1 * sy - sx * dy1) / F.nullif(area, F.lit(0.0))
    # One array, computed once for a row: lambdas below name its elements.
    made = F.array(x[1] - x[0] + g * x[1], x[3] - x[0] + h * x[3], x[0], y[1] - y[0] + g * y[1], y[3] - y[0] + h * y[3], y[0], g, h)

    def sampled(p: Column) -> Column:
        def at(r: Column, c: Column) -> Column:
            inside = (r >= 0) & (r < height) & (c >= 0) & (c < width)
            return F.when(inside, F.get(grid, (r * width + c).cast("int")).cast("double")).otherwise(0.0)

        def mixed(s: Column) -> Column:
            r, c = F.floor(s["y"]), F.floor(s["x"])
            fy, fx = s["y"] - r, s["x"] - c
            return pixels.level((at(r, c) * (1 - fx) + at(r, c + 1) * fx) * (1 - fy) + (at(r + 1, c) * (1 - fx) + at(r + 1, c + 1) * fx) * fy)

        def source(k: Column) -> Column:
            u, v = (k % to_width).cast("double") / (to_width - 1), F.floor(k / to_width).cast("double") / (to_height - 1)
            below = p[6] * u + p[7] * v + 1
            return F.struct(((p[0] * u + p[1] * v + p[2]) / F.nullif(below, F.lit(0.0))).alias("x"), ((p[3] * u + p[4] * v + p[5]) / F.nullif(below, F.lit(0.0))).alias("y"))

        return F.transform(F.transform(F.sequence(F.lit(0), to_width * to_height - 1), source), mixed)

    good = pixels.is_whole(grid, width, height) & (to_width > 1) & (to_height > 1) & (area != 0)
    return F.when(good, F.get(F.transform(F.array(made), sampled), 0))


def cropped(df: DataFrame, grid: str, width: int, height: int, name: str = "crop", least: tuple[int, int] = (LEAST_WIDTH, LEAST_HEIGHT), reach: int = 3, times: int = 3) -> DataFrame:
    """df with `name`: struct<quad, width, height, pixels> of the card in each image, or null. The first of the largest edge
    regions that fills its share and whose outline has four corners is taken if it is_card; otherwise the first bright region
    that has the ratio and lies off the border, by its least rectangle. Steps are columns of their own, so that none is repeated."""
    held = {c.lower() for c in df.columns}
    found, bright, quad, size = (next(n for k in range(99) if (n := f"_{w}{'_' * k}") not in held) for w in ("found", "bright", "quad", "size"))
    out = df.withColumn(found, edge_regions(F.col(grid), width, height, reach, times))
    out = out.withColumn(bright, bright_regions(F.col(grid), width, height, reach))
    ordered = lambda points: layout.expanded(layout.corners(points), width=F.lit(float(width)), height=F.lit(float(height)))
    low = lambda points, c: F.array_min(F.transform(points, lambda p: p[c]))
    high = lambda points, c: F.array_max(F.transform(points, lambda p: p[c]))
    margin = 4 if min(width, height) > 40 else 0

    def off_border(r: Column) -> Column:
        p = r["corners"]
        return (low(p, "x") > margin) & (low(p, "y") > margin) & (high(p, "x") + 1 < width - margin) & (high(p, "y") + 1 < height - margin)

    share = lambda r: r["area"] / (width * height)
    four = F.filter(found, lambda r: (share(r) >= LEAST_SHARE) & (F.size(r["corners"]) == 4))
    boxes = F.filter(bright, lambda r: share(r).between(pixels.LEAST_REGION, pixels.MOST_REGION) & (F.size(r["box"]) == 4) & off_border(r))
    every = F.concat(F.coalesce(F.transform(four, lambda r: r["corners"]), F.array()), F.coalesce(F.transform(boxes, lambda r: r["box"]), F.array()))
    out = out.withColumn(quad, F.transform(every, ordered))
    out = out.withColumn(quad, F.get(F.filter(quad, lambda q: is_card(*sides(q), least)), 0))
    w, h = sides(F.col(quad))
    out = out.withColumn(size, F.struct(w.alias("w"), h.alias("h")))
    w, h = F.col(size)["w"], F.col(size)["h"]
    crop = F.struct(F.col(quad).alias("quad"), w.alias("width"), h.alias("height"), warped(F.col(grid), F.col(quad), width, height, w, h).alias("pixels"))
    return out.withColumn(name, F.when(F.col(quad).isNotNull(), crop)).drop(found, bright, quad, size)
