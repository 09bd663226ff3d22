"""Catalogue search: any of several spellings of a query, in any of several fields."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import HIRAGANA, KATAKANA, LOWER, UPPER, ascii_folded, despaced, first_filled, with_query


def variants(query: str) -> list[str]:
    """Spellings to look for: as typed, NFKC, and NFKC without white space, each also in hiragana and in katakana."""
    wide = unicodedata.normalize("NFKC", query).strip()
    to_hira, to_kata = str.maketrans(KATAKANA, HIRAGANA), str.maketrans(HIRAGANA, KATAKANA)
    spelled = (v for base in (query.strip(), wide, re.sub(r"\s+", "", wide)) for v in (base, base.translate(to_hira), base.translate(to_kata)))
    return [v for v in dict.fromkeys(spelled) if v]


def like(c: Column, needle: str, folded: bool = False) -> Column:
    """SQL LIKE '%needle%' that folds A-Z alone: % and _ in the needle are wildcards, a backslash is a backslash. folded: the
    column is so already."""
    wanted, c = needle.translate(str.maketrans(UPPER, LOWER)), c if folded else ascii_folded(c)
    if "%" in wanted or "_" in wanted:
        return c.like("%" + wanted.replace("\\", "\\\\") + "%")
    return F.contains(c, F.lit(wanted))


def prepared(df: DataFrame, fields: list[str]) -> DataFrame:
    """df with each field folded (_f_<name>), and without spaces (_d_<name>): once for all needles of matches(). Both are
    generated columns, as the optimiser would copy the expressions of a projection into each needle's test."""
    fold = lambda c: F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(ascii_folded(F.col(c)))
    bare = lambda c: F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit("　"), F.lit(""))
    once = lambda cols: F.inline(F.array(F.struct(*cols)))
    df = df.select("*", once([fold(f).alias(f"_f_{f}") for f in fields]))
    return df.select("*", once([bare(F.col(f"_f_{f}")).alias(f"_d_{f}") for f in fields]))


def matches(query: str, fields: list[str], ready: bool = False, typed: bool = False) -> Column | None:
    """Predicate of a search; None for a query of white space, which filters nothing. ready: over the columns of prepared().
    typed: no spelling but the typed one, so that a phrase is not met across other spaces."""
    found = variants(query)[:1] if typed else variants(query)
    if not found:
        return None
    sides = lambda f: (F.col(f"_f_{f}"), F.col(f"_d_{f}")) if ready else (F.col(f), despaced(F.col(f)))
    terms = [like(side, v, ready) for v in found for f in fields for side in sides(f)]
    return F.coalesce(reduce(or_, [F.coalesce(t, F.lit(False)) for t in terms]), F.lit(False))


def search(cards: DataFrame, query: str | None = None, status: str | None = None, owner: str | None = None, fields: list[str] | None = None, drop: tuple[str, ...] = (), order: tuple[str, str] = ("created_at", "id"), status_col: str = "status", owner_col: str = "owner_line_user_id", typed: bool = False) -> DataFrame:
    """Cards, newest first (ties by id), without heavy columns. An empty parameter filters nothing; an owner scopes the
    search to that owner's cards. typed: the query as typed, without its other spellings."""
    out = cards
    if status:
        out = out.where(F.col(status_col) == status)
    if owner:
        out = out.where(F.col(owner_col) == owner)
    if query and (found := matches(query, fields or [], ready=True, typed=typed)) is not None:
        out = prepared(out, fields or []).where(found).select(*out.columns)
    return out.drop(*drop).orderBy(F.col(order[0]).desc(), F.col(order[1]).desc())


def top_with_rest(found: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    """The first n rows with their rank, the number of all rows and how many are left out. The total is aggregated beside
    the ordered limit, so no task sees all rows."""
    top = found.orderBy(*order).limit(n)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    total = found.agg(F.count("*").alias("total"))
    return ranked.crossJoin(F.broadcast(total)).withColumn("remaining", F.greatest(F.col("total") - n, F.lit(0)))


def result_line(person: Column, company: Column, tags: Column, card: Column, app_url: str = "") -> Column:
    """A found card in a reply: its name, the company if that is not the name, its tags, and where to see it."""
    filled = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    name = first_filled(person, company, "-")
    beside = F.when(filled(person).isNotNull(), filled(company))
    parts = [F.concat_ws(" / ", name, beside), F.concat(F.lit("["), filled(tags), F.lit("]"))]
    link = [with_query(F.lit(app_url), F.concat(F.lit("card="), card.cast("string")))] if app_url else []
    return F.concat_ws(" ", *parts, *link)


def display_name(person: Column, company: Column, otherwise: str = "-") -> Column:
    return first_filled(person, company, otherwise)


def reply_text(top: DataFrame, name: str, lead: str = "{total} found") -> DataFrame:
    """One text of a search's result: a line for each row by rank, then how many remain."""
    lines = top.agg(F.array_sort(F.collect_list(F.struct("rank", F.col(name).alias("name")))).alias("l"), F.max("total").alias("total"), F.max("remaining").alias("remaining"))
    body = F.transform("l", lambda x: F.concat_ws(". ", x["rank"].cast("string"), x["name"]))
    tail = F.when(F.col("remaining") > 0, F.array(F.concat(F.lit("+"), F.col("remaining").cast("string")))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.replace(F.lit(lead), F.lit("{total}"), F.coalesce(F.col("total"), F.lit(0)).cast("string")))
    return lines.select(F.array_join(F.concat(head, body, tail), "\n").alias("reply"))


# The texts of replies, in this engine's own words; a caller may pass others.
REPLIES = {
    "taken": "The image has been received.",
    "known": "This card is already in the catalogue.",
    "see": "Open it: {url}",
    "later": "Results appear in the catalogue when they are ready.",
    "suspended": "This account is suspended.",
    "register": "Please register to use the catalogue. The administrator can help.",
    "register_at": "Please register to use the catalogue: {url}",
}


def accepted_reply(card: Column, duplicate: Column, app_url: str = "", replies: dict[str, str] = REPLIES) -> Column:
    """Answer to an image: whether its card is new or known, and where to see it."""
    where = F.replace(F.lit(replies["see"]), F.lit("{url}"), with_query(F.lit(app_url), F.concat(F.lit("card="), card))) if app_url else F.lit(replies["later"])
    return F.concat_ws("\n", F.when(duplicate, replies["known"]).otherwise(replies["taken"]), where)


def registration_reply(status: Column, app_url: str = "", replies: dict[str, str] = REPLIES) -> Column:
    """Answer to a user who may not use the catalogue, by their status (null: unknown)."""
    ask = replies["register_at"].replace("{url}", app_url) if app_url else replies["register"]
    return F.when(F.coalesce(status, F.lit("")) == "suspended", replies["suspended"]).otherwise(ask)
