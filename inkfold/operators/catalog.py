"""The card with its images: nesting, wide and long forms, overlay, combined text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, first_filled
from ..schema import OVERLAID

#: Where the image of each name is: (side, column); the last is the fallback of a thumbnail.
IMAGE_OF = {"original": "original_image_path", "processed": "processed_image_path", "thumbnail": "thumbnail_path", "back-original": "back_original_image_path", "back-processed": "back_processed_image_path", "back-thumbnail": "back_thumbnail_path"}


def side_rank(side: Column) -> Column:
    """Front first, then back, then the rest."""
    return F.when(side == "front", 0).when(side == "back", 1).otherwise(2)


def hydrate(cards: DataFrame, images: DataFrame, key: str = "id", child: str = "card_id", rank: Column | None = None, order: str = "created_at", fields: list[str] | None = None, name: str = "images") -> DataFrame:
    """cards with an array of their child rows in order; an empty one where there are none."""
    rank = side_rank(F.col("side")) if rank is None else rank
    fields = fields or [c for c in images.columns if c != child]
    item = F.struct(rank.alias("_rank"), F.col(order).alias("_order"), F.struct(*fields).alias("row"))
    nested = images.groupBy(child).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["row"]).alias(name))
    joined = cards.join(nested.withColumnRenamed(child, "_child"), F.col(key) == F.col("_child"), "left").drop("_child")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))


def overlay(cards: DataFrame, images: DataFrame, fields: list[str] | None = None, key: str = "id", child: str = "card_id") -> DataFrame:
    """cards with their image rows' fields over their own: front under the field's name, back under back_<name>, other sides
    ignored. An image row's null overwrites too."""
    fields = [f for f in (fields or OVERLAID) if f in images.columns]
    sides = {"front": "", "back": "back_"}
    aggs = [F.max(F.when(F.col("side") == s, F.struct(F.lit(1).alias("has"), *fields))).alias(f"_{s}") for s in sides]
    wide = images.groupBy(F.col(child).alias("_child")).agg(*aggs)
    out = cards.join(wide, F.col(key) == F.col("_child"), "left")
    new = {p + f: F.when(F.col(f"_{s}").isNotNull(), F.col(f"_{s}")[f]) for s, p in sides.items() for f in fields}
    keep = [F.when(F.col(f"_{'back' if c.startswith('back_') else 'front'}").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in cards.columns]
    return out.select(*keep, *[v.alias(c) for c, v in new.items() if c not in cards.columns])


def sides_of(cards: DataFrame, fields: dict[str, tuple[str, str]], key: str = "id", present: tuple[str, str] | None = None) -> DataFrame:
    """Wide to long: (card_id, side, fields): the front of each card, and the back where its first field is filled."""
    pair = F.array(*[F.struct(F.lit(side).alias("side"), *[F.col(cols[i]).alias(name) for name, cols in fields.items()]) for i, side in enumerate(("front", "back"))])
    first = next(iter(fields))
    rows = cards.select(F.col(key).alias("card_id"), F.explode(pair).alias("s")).select("card_id", "s.*")
    return rows.where((F.col("side") == "front") | blank_to_null(F.col(first).cast("string")).isNotNull())


def backfill(images: DataFrame, cards: DataFrame, fields: dict[str, tuple[str, str]], key: str = "id") -> DataFrame:
    """images, with the rows of cards for the (card, side) that have none."""
    new = sides_of(cards, fields, key).join(images.select("card_id", "side"), ["card_id", "side"], "left_anti")
    return images.unionByName(new, allowMissingColumns=True)


def combined_text(images: DataFrame, text: str = "ocr_text", by: str = "card_id", label: Column | None = None, rank: Column | None = None, order: str = "created_at") -> DataFrame:
    """(card, combined): the texts of a card's images, front first, blank ones left out, each under a header."""
    label = F.when(F.col("side") == "back", "【裏面】").otherwise("【表面】") if label is None else label
    rank = side_rank(F.col("side")) if rank is None else rank
    body = F.trim(F.col(text))
    item = F.when(blank_to_null(body).isNotNull(), F.struct(rank.alias("r"), F.col(order).alias("o"), F.concat(label, F.lit("\n"), body).alias("t")))
    per = images.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("l"))
    return per.select(by, F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("combined"))


def image_path(name: str) -> Column:
    """The stored path of a named image; a thumbnail falls back to the processed and then the original image."""
    prefix = "back_" if name.startswith("back-") else ""
    if name.endswith("thumbnail"):
        return F.coalesce(*[blank_to_null(F.col(prefix + c)) for c in ("thumbnail_path", "processed_image_path", "original_image_path")])
    return F.col(IMAGE_OF[name])


def public_user(users: DataFrame) -> DataFrame:
    return users.select("line_user_id", "display_name", "picture_url", "status", "role")


def labels(cards: DataFrame) -> DataFrame:
    """What a list shows of each card."""
    return cards.select("id", first_filled(F.col("person_name"), F.col("company_name"), "-").alias("name"), first_filled(F.col("company_name"), "-").alias("company"), "status")
