"""Recognised blocks: boxes, direction, reading order, text, font sizes, rotation. A block is (text, box, font_size)."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..schema import BLOCKS

# The keys that hold a node's text and box, in order, and the thresholds of a box's shape.
TEXT_KEYS = ("text", "content", "transcription", "value", "label")
BOX_KEYS = ("box", "bbox", "bounding_box", "points", "polygon", "quad")
TALL, WIDE, TALL_LEAST = 2.2, 0.75, 3


def bounds(flat: Column) -> Column:
    """[x1, y1, x2, y2] of coordinates x, y, x, y, ...; fewer than four give null."""
    side = lambda k: F.filter(flat, lambda _, i: i % 2 == k)
    return F.when(F.size(flat) >= 4, F.array(F.array_min(side(0)), F.array_min(side(1)), F.array_max(side(0)), F.array_max(side(1))))


def _coordinate(box: Column, k: int) -> Column:
    return F.coalesce(F.get(box, k), F.lit(0.0))


def shape_ratio(box: Column) -> Column:
    """Height over width, each at least 1; null for a box of fewer than four numbers."""
    return F.when(F.size(box) >= 4, F.greatest(F.lit(1.0), F.get(box, 3) - F.get(box, 1)) / F.greatest(F.lit(1.0), F.get(box, 2) - F.get(box, 0)))


def orientation(blocks: Column) -> Column:
    """(horizontal, vertical): how many boxes are wide and how many are tall."""
    count = lambda test: F.size(F.filter(blocks, lambda b: F.coalesce(test(shape_ratio(b["box"])), F.lit(False))))
    return F.struct(count(lambda r: r <= WIDE).alias("horizontal"), count(lambda r: r >= TALL).alias("vertical"))


def direction(horizontal: Column, vertical: Column) -> Column:
    return F.when((vertical >= TALL_LEAST) & (vertical > horizontal), "vertical").otherwise("horizontal")


def reading_order(blocks: Column, way: Column) -> Column:
    """Blocks from top to bottom and left to right; vertical writing from right to left, then down. Equal places keep their
    order."""
    def keyed(b: Column, i: Column) -> Column:
        x, y = _coordinate(b["box"], 0), _coordinate(b["box"], 1)
        tall = way == "vertical"
        return F.struct(F.when(tall, -x).otherwise(y).alias("a"), F.when(tall, y).otherwise(x).alias("b"), i.alias("i"), b.alias("block"))

    return F.transform(F.array_sort(F.transform(blocks, keyed), lambda p, q: F.when(F.struct(p["a"], p["b"], p["i"]) < F.struct(q["a"], q["b"], q["i"]), -1).otherwise(1)), lambda x: x["block"])


def reading_ranks(rows: DataFrame, group: str, tall: bool, ties: str, hold: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows (group, ties, box) with `rank`, from 1: the place of each box in the reading order of its group, which may be of
    any size. Rows are dealt by ranges of group and place, numbered inside each range, and the counts of the ranges before
    are added; no group is gathered. hold stores the dealt rows, as their ranges must not be drawn twice."""
    x, y = _coordinate(F.col("box"), 0), _coordinate(F.col("box"), 1)
    order = [-x, y] if tall else [y, x]
    keyed = rows.withColumns({"_a": order[0], "_b": order[1]})
    place = [group, "_a", "_b", ties]
    dealt = hold(keyed.repartitionByRange(*place).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", group).orderBy("_a", "_b", ties)
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = dealt.groupBy("_range", group).agg(F.count("*").alias("_n")).select(F.col("_range").alias("_r"), F.col(group).alias("_g"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    numbered = dealt.withColumn("_i", F.row_number().over(inside))
    met = numbered.join(F.broadcast(ahead), (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return met.select(*rows.columns, (F.col("_i") + F.col("_ahead")).cast("long").alias("rank"))


def block_text(blocks: Column) -> Column:
    return F.trim(F.array_join(F.transform(blocks, lambda b: b["text"]), "\n"))


def nearest_rank(sizes: Column, share: float = 0.8) -> Column:
    """The size at place int(n * share) of the sorted sizes, null as 0; 0 where there are none."""
    s = F.array_sort(F.transform(sizes, lambda x: F.coalesce(x, F.lit(0.0))))
    return F.when(F.size(s) > 0, F.get(s, F.floor(F.size(s) * F.lit(share)).cast("int"))).otherwise(F.lit(0.0))


def marked_text(blocks: Column) -> Column:
    """Block texts by line, with a mark before those of the largest sizes."""
    limit = nearest_rank(F.transform(blocks, lambda b: b["font_size"]))
    filled = F.filter(blocks, lambda b: F.trim(F.coalesce(b["text"], F.lit(""))) != "")
    return F.array_join(F.transform(filled, lambda b: F.concat(F.when((limit > 0) & (F.coalesce(b["font_size"], F.lit(0.0)) >= limit), "【大文字】").otherwise(""), F.trim(b["text"]))), "\n")


def rotation_score(text: Column, horizontal: Column, vertical: Column, original: Column, original_vertical: Column) -> Column:
    """How well a rotated image reads; 0 if it lost too much text or has too few wide boxes."""
    n, n0 = (F.char_length(F.replace(F.coalesce(t, F.lit("")), F.lit("\n"), F.lit(""))) for t in (text, original))
    poor = (n < F.greatest(F.lit(20.0), n0 * 0.65)) | (horizontal < F.greatest(F.lit(3), original_vertical))
    return F.when(poor, 0.0).otherwise(horizontal - vertical + n / 20)


def best_rotation(attempts: DataFrame, key: str = "image_id") -> DataFrame:
    """The attempt of the greatest score of each image; of equal ones the first."""
    best = Window.partitionBy(key).orderBy(F.col("score").desc_nulls_last(), F.col("attempt"))
    return attempts.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def _floats(items: list) -> list[float] | None:
    """The items as numbers; None if one is none."""
    try:
        return [float(x) for x in items]
    except (TypeError, ValueError):
        return None


def _box(raw: object) -> list[float] | None:
    """Corners x1, y1, x2, y2 of a box in any of three forms: an object of a corner and a size, four plain numbers (as they
    are), or points and coordinates in a row. Points that are not numeric are left out; fewer than four coordinates are none."""
    if isinstance(raw, dict):
        corner = _floats([raw.get(k) for k in ("x", "y", "width", "height")])
        return corner and [*corner[:2], corner[0] + corner[2], corner[1] + corner[3]]
    items = raw if isinstance(raw, list) else []
    points = [p for p in (_floats(x[:2] if isinstance(x, list) and len(x) > 1 else [x]) for x in items) if p]
    flat = list(itertools.chain.from_iterable(points))
    if len(flat) < 4:
        return None
    plain = len(items) == 4 and all(not isinstance(x, list) for x in items)
    return flat[:4] if plain else _hull(flat)


def _hull(flat: list[float]) -> list[float]:
    xs, ys = flat[::2], flat[1::2]
    return [min(xs), min(ys), max(xs), max(ys)]


def _nodes(root: object) -> Iterator[dict]:
    """All objects of a JSON value, parents first, in order."""
    rest = [root]
    while rest:
        node = rest.pop()
        if isinstance(node, dict):
            yield node
            rest += [v for v in reversed(node.values()) if isinstance(v, (dict, list))]
        elif isinstance(node, list):
            rest += reversed(node)


def parse_blocks(raw: str | None) -> list[dict]:
    """Blocks of an engine's result in JSON of any nesting: each text with its box once, a size from the box's height. A
    result without blocks is one block of its own text."""
    try:
        root = json.loads(raw) if raw else None
    except ValueError:
        root = None
    out = {}
    for node in _nodes(root):
        text = next((v.strip() for k in TEXT_KEYS if isinstance(v := node.get(k), str) and v.strip()), None)
        if text:
            box = _box(next((v for k in BOX_KEYS if (v := node.get(k))), None))
            out.setdefault((text, tuple(box or ())), {"text": text, "box": box, "font_size": max(0.0, box[3] - box[1]) if box else 0.0})
    whole = (raw or "").strip()
    return list(out.values()) or ([{"text": whole, "box": None, "font_size": 0.0}] if whole else [])


@pandas_udf(BLOCKS)
def blocks_of(s: pd.Series) -> pd.Series:
    """parse_blocks() of a column; the depth of the JSON is unbounded, which no built-in walks."""
    return s.map(parse_blocks)


def corners(points: Column) -> Column:
    """Four (x, y) points as top left, top right, bottom right, bottom left: by least and greatest sum and difference."""
    by = lambda f, greatest: F.get(F.array_sort(points, lambda p, q: F.when(f(p) == f(q), 0).when((f(p) > f(q)) == F.lit(greatest), -1).otherwise(1)), 0)
    total, apart = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(by(total, False), by(apart, False), by(total, True), by(apart, True))


def expanded(points: Column, share: float = 0.015, width: Column | None = None, height: Column | None = None) -> Column:
    """Points moved away from their centre by a share, inside the image."""
    n = F.size(points)
    centre = lambda k: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[k]) / n
    inside = lambda c, most: F.greatest(F.lit(0.0), c) if most is None else F.least(F.greatest(F.lit(0.0), c), most - 1)
    move = lambda p, k, most: inside(centre(k) + (p[k] - centre(k)) * (1 + share), most)
    return F.transform(points, lambda p: F.struct(move(p, "x", width).alias("x"), move(p, "y", height).alias("y")))


def is_portrait(width: Column, height: Column) -> Column:
    return height > width * 1.15
