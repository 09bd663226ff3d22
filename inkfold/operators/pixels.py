"""Luminance grids by columns: one row holds an image's values row by row, all of one size, from 0 to 255.

The steps of preparing a photographed card that need no image library: rotation, reduction, contrast, brightness, sharpening, and
the bright region by the threshold that best parts dark from bright. Steps that are told a size give null for a null grid and for
one that has not width x height values or holds a null. Each names its grid many times: give it a column, not an expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 256
# What share of the darkest and of the brightest pixels is cut, the luminance outside which brightness is changed with
# its factors, the sharpening of contrast and detail, and which share of an image a bright region may take.
CUT, DIM, GLARE, BRIGHTER, DARKER, BOOST = 0.01, 155.0, 225.0, 1.08, 0.96, 1.08
LEAST_REGION, MOST_REGION = 0.12, 0.95


def level(x: Column) -> Column:
    """A whole value from 0 to 255: halves go up."""
    return F.least(F.greatest(F.floor(x + 0.5), F.lit(0)), F.lit(LEVELS - 1)).cast("int")


def is_whole(grid: Column, width: int, height: int) -> Column:
    """Whether the grid has all its values."""
    return F.coalesce((F.size(grid) == width * height) & ~F.exists(grid, lambda x: x.isNull()), F.lit(False))


def picked(grid: Column, places: list[int]) -> Column:
    return F.transform(F.lit(places), lambda k: F.get(grid, k))


def turned(grid: Column, width: int, height: int, degrees: int) -> Column:
    """The grid turned clockwise by a multiple of 90 degrees (then it is height wide): a permutation of its places."""
    at = [[r * width + c for c in range(width)] for r in range(height)]
    for _ in range(degrees // 90 % 4):
        at = [list(row) for row in zip(*at[::-1], strict=True)]
    return F.when(is_whole(grid, width, height), picked(grid, [k for row in at for k in row]))


def reduced(grid: Column, width: int, height: int, to: int) -> Column:
    """The grid with its longer side `to` pixels at most, each the mean of the area that it covers, parts of pixels by their
    share. A smaller grid stays as it is."""
    scale = max(width, height) / to
    if scale <= 1:
        return F.when(is_whole(grid, width, height), grid)
    w, h = max(1, round(width / scale)), max(1, round(height / scale))

    def shares(n: int, m: int) -> list[list[tuple[int, float]]]:
        edges = [(k * n / m, (k + 1) * n / m) for k in range(m)]
        return [[(i, min(b, i + 1) - max(a, i)) for i in range(n) if min(b, i + 1) > max(a, i)] for a, b in edges]

    cells = []
    for row in shares(height, h):
        for column in shares(width, w):
            parts = [(r * width + c, x * y) for r, x in row for c, y in column]
            total = F.lit(0.0)
            for k, share in parts:
                total = total + F.get(grid, F.lit(k)) * share
            cells.append(total / sum(share for _, share in parts))
    return F.when(is_whole(grid, width, height), F.array(*cells))


def stretched(grid: Column, cut: float = CUT) -> Column:
    """Contrast by the quantiles: the value at place floor(n cut) of the sorted pixels becomes 0, the one as far from the end 255, and
    between them the values are spread evenly. A grid of one value stays."""
    ordered = F.array_sort(grid)
    n = F.size(grid)
    low, high = F.get(ordered, F.floor(n * cut).cast("int")), F.get(ordered, (n - 1 - F.floor(n * cut)).cast("int"))
    return F.when(high > low, F.transform(grid, lambda x: level((x - low) * 255.0 / (high - low)))).otherwise(F.transform(grid, level))


def mean(grid: Column) -> Column:
    return F.aggregate(grid, F.lit(0.0), lambda a, x: a + x) / F.size(grid)


def brightened(grid: Column) -> Column:
    """Dim grids brighter, glaring ones darker, by their mean luminance."""
    factor = F.when(mean(grid) < DIM, BRIGHTER).when(mean(grid) > GLARE, DARKER).otherwise(1.0)
    return F.transform(grid, lambda x: level(x * factor))


def sharpened(grid: Column, width: int, height: int, by: float = BOOST) -> Column:
    """Each inner pixel moved away from the weighted mean of its 3 x 3 neighbourhood (itself five times, its neighbours once) by
    the factor; the border stays."""
    cells = []
    for r in range(height):
        for c in range(width):
            x = F.get(grid, F.lit(r * width + c))
            if 0 < r < height - 1 and 0 < c < width - 1:
                near = F.lit(0.0)
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):
                        near = near + F.get(grid, F.lit((r + dr) * width + c + dc)) * (5.0 if dr == dc == 0 else 1.0)
                cells.append(level(near / 13.0 + (x - near / 13.0) * by))
            else:
                cells.append(level(x * F.lit(1.0)))
    return F.when(is_whole(grid, width, height), F.array(*cells))


def threshold(pixels: Column) -> Column:
    """Of whole levels: the level t for which the classes x <= t and x > t differ most (the variance between them, by counts and sums
    in whole numbers; of equal ones the least t); null for a grid of one level."""
    n, total = F.size(pixels).cast("long"), F.aggregate(pixels, F.lit(0).cast("long"), lambda a, x: a + x)

    def spread(t: Column) -> Column:
        below = F.filter(pixels, lambda x: x <= t)
        count, sums = F.size(below).cast("long"), F.aggregate(below, F.lit(0).cast("long"), lambda a, x: a + x)
        gap = sums * n - total * count
        return F.struct(((gap * gap).cast("double") / (count * (n - count))).alias("spread"), (-t).alias("less"))

    levels = F.filter(F.array_sort(F.array_distinct(pixels)), lambda t: t < F.array_max(pixels))
    return (-F.array_max(F.transform(levels, spread))["less"]).cast("int")


def _around(mask: Column, width: int, height: int, most: bool) -> Column:
    near = [[k * width + j for k in range(max(0, r - 1), min(height, r + 2)) for j in range(max(0, c - 1), min(width, c + 2))] for r in range(height) for c in range(width)]
    each = lambda ks: F.transform(ks, lambda k: F.get(mask, k))
    return F.transform(F.lit(near), lambda ks: F.array_max(each(ks)) if most else F.array_min(each(ks)))


def grown(mask: Column, width: int, height: int) -> Column:
    """A mask with every pixel that touches a marked one, diagonally too."""
    return F.when(mask.isNotNull(), _around(mask, width, height, True))


def shrunk(mask: Column, width: int, height: int) -> Column:
    """A mask without the pixels that touch an unmarked one; beyond the edge nothing counts."""
    return F.when(mask.isNotNull(), _around(mask, width, height, False))


def bright_region(df: DataFrame, grid: str, width: int, height: int, name: str = "region") -> DataFrame:
    """df with `name`: threshold, mask (1 above the threshold, closed twice, then opened, so that specks and gaps go) and is_region
    (whether the marked share is that of a card before its ground); all null for grids of one level and for broken ones. The steps
    are projections of their own, so that none repeats the one before."""
    held = {c.lower() for c in df.columns}
    level_, mask = (next(n for k in range(99) if (n := f"_{w}{'_' * k}") not in held) for w in ("level", "mask"))
    out = df.withColumn(level_, F.when(is_whole(F.col(grid), width, height), F.transform(grid, lambda x: level(x * F.lit(1.0)).cast("long"))))
    out = out.withColumn(name, threshold(F.col(level_)))
    out = out.withColumn(mask, F.when(F.col(name).isNotNull(), F.transform(level_, lambda x: F.when(x > F.col(name), 1).otherwise(0))))
    for step in (grown, grown, shrunk, shrunk, shrunk, grown):
        out = out.withColumn(mask, step(F.col(mask), width, height))
    share = F.aggregate(mask, F.lit(0), lambda a, x: a + x) / F.size(mask)
    region = F.struct(F.col(name).alias("threshold"), F.col(mask).alias("mask"), share.between(LEAST_REGION, MOST_REGION).alias("is_region"))
    return out.withColumn(name, region).drop(level_, mask)
