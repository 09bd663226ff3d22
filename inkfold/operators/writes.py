"""The catalogue's writes as functions of present tables and a batch of changes: new cards, back images, queued jobs, results of
processing, recognition and extraction, users and sessions. Each gives the new rows or the tables after the change; store
them with merge.Snapshots. Keys must be unique in a batch of changes; a change whose row does not exist changes nothing.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions import text as T
from ..schema import EXTRACTED


def updated(table: DataFrame, changes: DataFrame, on: dict[str, str], values: dict[str, Column | str | None]) -> DataFrame:
    """table, with the given columns set in the rows that a change meets (on: table column to change column). A Column speaks of
    the change's columns as n.<name>; a str or None is a constant."""
    marked = changes.withColumn("_hit", F.lit(True)).alias("n")
    met = table.alias("o").join(marked, [F.col(f"o.{a}") == F.col(f"n.{b}") for a, b in on.items()], "left")
    hit = F.col("n._hit").isNotNull()
    new = {c: v if isinstance(v, Column) else F.lit(v).cast(table.schema[c].dataType) for c, v in values.items() if c in table.columns}
    return met.select(*[F.when(hit, new[c]).otherwise(F.col(f"o.{c}")).alias(c) if c in new else F.col(f"o.{c}").alias(c) for c in table.columns])


def hex_id() -> Column:
    """A random identifier of 32 hexadecimal digits."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def with_defaults(rows: DataFrame, **values: object) -> DataFrame:
    """rows with nulls replaced by the column's default; columns that they lack are added."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in values.items()})


def image_rows(new: DataFrame, side: str, now: str) -> DataFrame:
    """Rows of card_images for new originals (card_id, path, sha256, direction)."""
    return new.select(F.concat_ws(":", F.col("card_id").cast("string"), F.lit(side)).alias("id"), "card_id", F.lit(side).alias("side"), F.col("path").alias("original_image_path"), F.col("sha256").alias("original_sha256"), F.coalesce("direction", F.lit("horizontal")).alias("ocr_direction"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))


def job_rows(wanted: DataFrame, now: str, kind: str = "process_card") -> DataFrame:
    """Queued jobs (card_id[, type][, job_id]); a job without an id gets a random one."""
    job = F.coalesce(F.col("job_id").cast("string"), hex_id()) if "job_id" in wanted.columns else hex_id()
    return wanted.select(job.alias("id"), "card_id", (F.col("type") if "type" in wanted.columns else F.lit(kind)).alias("type"), F.lit("queued").alias("status"), F.lit(0).cast("long").alias("attempts"), F.lit(now).alias("created_at"))


def new_cards(new: DataFrame, now: str) -> dict[str, DataFrame]:
    """Rows of cards, card_images and jobs for new front images (card_id, path, sha256, direction[, job_id])."""
    card = new.select(F.col("card_id").alias("id"), F.lit("queued").alias("status"), F.col("path").alias("original_image_path"), F.col("sha256").alias("original_sha256"), F.coalesce("direction", F.lit("horizontal")).alias("ocr_direction"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
    return {"cards": card, "card_images": image_rows(new, "front", now), "jobs": job_rows(new, now)}


def enqueued(cards: DataFrame, jobs: DataFrame, wanted: DataFrame, now: str) -> dict[str, DataFrame]:
    """Tables after jobs are asked for (card_id, type[, job_id]): a queued job each, and cards queued without an error."""
    keys = wanted.select("card_id").distinct()
    after = updated(cards, keys, {"id": "card_id"}, {"status": "queued", "error_message": None, "updated_at": now})
    return {"cards": after, "jobs": jobs.unionByName(job_rows(wanted, now), allowMissingColumns=True)}


#: What a new back image takes from the card: results of the one before.
BACK_RESULTS = ("back_processed_image_path", "back_thumbnail_path", "back_ocr_text", "back_ocr_blocks_json", "back_ocr_duration_ms")


def back_images(cards: DataFrame, new: DataFrame, now: str) -> dict[str, DataFrame]:
    """Cards after new back images (card_id, path, sha256, direction[, job_id]) whose earlier results are void, with the rows
    to upsert into card_images and to add to jobs."""
    values = {"status": "queued", "back_original_image_path": F.col("n.path"), "back_original_sha256": F.col("n.sha256"), "back_ocr_direction": F.col("n.direction"), "error_message": None, "updated_at": now}
    return {"cards": updated(cards, new, {"id": "card_id"}, values | dict.fromkeys(BACK_RESULTS)), "card_images": image_rows(new, "back", now), "jobs": job_rows(new, now)}


def _sided(cards: DataFrame, images: DataFrame, results: DataFrame, fields: dict[str, str], status: str, now: str, extra: dict[str, Column | str | None]) -> dict[str, DataFrame]:
    """Both tables after results of sides (card_id, side, ...): fields maps stored columns to the results'. Images take their own
    side's row; a card its front's under the column's name and its back's under back_<name>; other sides are ignored."""
    results = results.where(F.col("side").isin("front", "back"))
    own = updated(images, results, {"card_id": "card_id", "side": "side"}, {c: F.col(f"n.{r}") for c, r in fields.items()} | {"updated_at": now})
    sides = [F.max(F.when(F.col("side") == s, F.struct(*fields.values()))).alias(s) for s in ("front", "back")]
    wide = results.groupBy("card_id").agg(*sides)
    values: dict[str, Column | str | None] = {"status": status, "updated_at": now} | extra
    for side, prefix in (("front", ""), ("back", "back_")):
        for c, r in fields.items():
            if prefix + c in cards.columns:
                values[prefix + c] = F.when(F.col(f"n.{side}").isNotNull(), F.col(f"n.{side}")[r]).otherwise(F.col(f"o.{prefix + c}"))
    return {"cards": updated(cards, wide, {"id": "card_id"}, values), "card_images": own}


def processed(cards: DataFrame, images: DataFrame, results: DataFrame, now: str) -> dict[str, DataFrame]:
    """Tables after images were prepared (card_id, side, processed, thumbnail): recognition is next."""
    return _sided(cards, images, results, {"processed_image_path": "processed", "thumbnail_path": "thumbnail"}, "ocr_processing", now, {"error_message": None})


def recognised(cards: DataFrame, images: DataFrame, results: DataFrame, now: str) -> dict[str, DataFrame]:
    """Tables after texts were read (card_id, side, text, blocks_json, ms): extraction is next."""
    return _sided(cards, images, results, {"ocr_text": "text", "ocr_blocks_json": "blocks_json", "ocr_duration_ms": "ms"}, "extracting", now, {})


def extracted(cards: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """Cards after fields were extracted (card_id, raw, ms and the extracted fields as text): normalised, and ready."""
    normal = {"person_name_kana": T.kana_field, "company_name": T.company, "address": T.address, "tel": T.phone, "mobile": T.phone, "fax": T.phone}
    clean = results.select("card_id", "raw", "ms", *[normal.get(f, T.text)(F.col(f)).alias(f) for f in EXTRACTED if f in results.columns])
    values = {f: F.col(f"n.{f}") for f in EXTRACTED if f in results.columns}
    return updated(cards, clean, {"id": "card_id"}, values | {"status": "ready", "extracted_json": F.col("n.raw"), "extraction_duration_ms": F.col("n.ms"), "error_message": None, "updated_at": now})


def activated(users: DataFrame, keys: DataFrame, now: str) -> DataFrame:
    return updated(users, keys.select("line_user_id").distinct(), {"line_user_id": "line_user_id"}, {"status": "active", "last_seen_at": now, "updated_at": now})


def without_sessions(sessions: DataFrame, ended: DataFrame) -> DataFrame:
    return sessions.join(ended.select("token_hash"), "token_hash", "left_anti")


def exists(wanted: DataFrame, table: DataFrame, key: str, of: str = "id") -> DataFrame:
    """wanted with `found`: whether the table has its key."""
    known = table.select(F.col(of).alias("_known")).distinct()
    return wanted.join(known, F.col(key) == F.col("_known"), "left").withColumn("found", F.col("_known").isNotNull()).drop("_known")


def valid_request(direction: Column | None = None, side: Column | None = None, degrees: Column | None = None) -> Column:
    """Whether what is given lies in its domain."""
    domains = ((direction, ("auto", "horizontal", "vertical")), (side, ("front", "back")), (degrees, (-90, 90)))
    out = F.lit(True)
    for value, domain in domains:
        out = out & F.coalesce(value.isin(*domain), F.lit(False)) if value is not None else out
    return out


def contained(path: Column) -> Column:
    """Whether a relative path stays inside its root: at no step do its '..' outnumber the names before them."""
    step = lambda d, p: F.when(d < 0, d).when(p.isin("", "."), d).when(p == "..", d - 1).otherwise(d + 1)
    return ~path.startswith("/") & ~F.contains(path, F.lit("\u0000")) & (F.aggregate(F.split(path, "/"), F.lit(0), step) >= 0)


def job_outcome(kind: Column, has_card: Column, n_images: Column, combined: Column, is_card: Column) -> Column:
    """(next, error): what a claimed job comes to before extraction: done without its card, error, not_card or extract."""
    blank = F.trim(F.coalesce(combined, F.lit(""))) == ""
    name = F.when(~has_card, "done").when(kind == "reextract", F.when(blank, "error").otherwise("extract")).when(n_images == 0, "error").when(~F.coalesce(is_card, F.lit(False)), "not_card").otherwise("extract")
    why = F.when(name == "error", F.when(kind == "reextract", "no recognised text").otherwise("no images"))
    return F.struct(name.alias("next"), why.alias("error"))


def chosen_rotation(direction: Column, found: Column, portrait: Column, attempts: Column) -> Column:
    """The degrees by which an image is turned, 0 for none. Only a portrait image that was asked for as auto and read as vertical
    is tried; of the attempts (degrees, direction, score) that read as horizontal the first of the greatest score over 0 wins."""
    fine = F.filter(attempts, lambda a: (a["direction"] == "horizontal") & (a["score"] > 0))
    best = F.aggregate(fine, F.struct(F.lit(0).alias("degrees"), F.lit(0.0).alias("score")), lambda b, a: F.when(a["score"] > b["score"], F.struct(a["degrees"].cast("int").alias("degrees"), a["score"].cast("double").alias("score"))).otherwise(b))
    return F.when((direction == "auto") & (found == "vertical") & portrait, best["degrees"]).otherwise(0)


def upload_summary(files: DataFrame, by: str, name: str, order: str) -> DataFrame:
    """(by, summary) of uploads (name, duplicate, error): a line for each file of a batch, in order."""
    line = F.when(F.col("error").isNotNull(), F.concat(F.lit("NG: "), name, F.lit(": "), "error")).otherwise(F.concat(F.lit("OK: "), name, F.when(F.col("duplicate"), " (duplicate)").otherwise(" (queued)")))
    per = files.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("all"))
    return per.select(by, F.array_join(F.transform("all", lambda x: x["l"]), "\n").alias("summary"))


@pandas_udf(StringType())
def pretty(raw: pd.Series) -> pd.Series:
    """JSON with line breaks; what is no JSON stays as it is. No built-in indents a value of any shape."""

    def one(x: str | None) -> str | None:
        try:
            return json.dumps(json.loads(x), ensure_ascii=False, indent=2) if x else x
        except ValueError:
            return x

    return raw.map(one)


def as_items(rows: DataFrame) -> DataFrame:
    """One JSON object for each row, under `item`: a list is written as lines, not gathered into one row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("item"))


def local_date(iso: Column, zone: str = "UTC") -> Column:
    """An ISO time as local date and time; '-' where there is none."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(F.try_to_timestamp(F.nullif(iso, F.lit(""))), zone), "yyyy-MM-dd HH:mm:ss"), F.lit("-"))
