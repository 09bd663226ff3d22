"""Whether a recognised text is a business card: weighted signals."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfkc, trimmed

# Signal patterns, word lists and weights; a card has a score of LEAST or more.
SIGNALS = {
    "email": (3, r"(?i)[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}", ()),
    "phone": (2, r"(?i)tel|phone|mobile|fax|電話|携帯|直通|(?U)\b0\d{1,4}-?\d{1,4}-?\d{3,4}\b", ()),
    "website": (1, r"(?i)https?://|www\.|\.co\.jp|\.com|\.jp", ()),
    "address": (2, r"〒?\d{3}-?\d{4}", ("東京都", "北海道", "府", "県", "市", "区", "町", "村", "丁目", "番地")),
    "company": (2, "", ("株式会社", "有限会社", "合同会社", "合名会社", "合資会社", "社団法人", "財団法人", "医療法人", "学校法人", "office", "corporation", "corp", "co.,", "ltd", "inc")),
    "title": (1, "", ("代表", "取締役", "社長", "部長", "課長", "係長", "営業", "担当", "manager", "president", "director")),
}
LEAST, LEAST_CHARS, LEAST_LINES = 3, 18, 3


def signals(text: Column, only: tuple[str, ...] = tuple(SIGNALS)) -> dict[str, Column]:
    """Each signal as a boolean, of a normalised text."""
    lower, out = F.lower(text), {}
    for name in only:
        _, pattern, words = SIGNALS[name]
        tests = ([text.rlike(pattern)] if pattern else []) + [F.contains(lower, F.lit(w)) for w in words]
        out[name] = tests[0]
        for t in tests[1:]:
            out[name] = out[name] | t
    return out


def classified(text: Column, normalise: bool = True, only: tuple[str, ...] = tuple(SIGNALS)) -> dict[str, Column]:
    """score, is_card and reason (the signals, or that there is too little text) of a recognised text."""
    t = nfkc(text) if normalise else F.coalesce(text, F.lit(""))
    bare = trimmed if normalise else F.trim
    enough = (F.char_length(F.regexp_replace(t, r"(?U)\s+", "")) >= LEAST_CHARS) & (F.size(F.filter(F.split(t, "\\R"), lambda x: bare(x) != "")) >= LEAST_LINES)
    found = signals(t, only)
    score = sum((F.when(c, SIGNALS[n][0]).otherwise(0) for n, c in found.items()), F.lit(0))
    names = F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in found.items()])), ", ")
    total = F.when(enough, score).otherwise(0)
    return {"score": total, "is_card": total >= LEAST, "reason": F.when(enough, names).otherwise("too little text")}


def classify(df: DataFrame, text: str = "text", normalise: bool = True, only: tuple[str, ...] = tuple(SIGNALS)) -> DataFrame:
    """df with score, is_card and reason. As classified(), step by step: the text is normalised and lower-cased once and each
    signal is tested once, since expressions in branches are not shared."""
    t, bare = F.col("_t"), trimmed if normalise else F.trim
    rows = df.withColumn("_t", nfkc(text) if normalise else F.coalesce(F.col(text), F.lit("")))
    enough = (F.char_length(F.regexp_replace(t, r"(?U)\s+", "")) >= LEAST_CHARS) & (F.size(F.filter(F.split(t, "\\R"), lambda x: bare(x) != "")) >= LEAST_LINES)
    rows = rows.withColumns({"_low": F.lower("_t"), "_enough": enough})
    tests = {}
    for name in only:
        _, pattern, words = SIGNALS[name]
        found = [F.contains("_low", F.lit(w)) for w in words]
        if pattern:
            found.append(F.contains(t, F.lit("@")) & t.rlike(pattern) if name == "email" else t.rlike(pattern))
        tests[f"_{name}"] = F.col("_enough") & reduce(or_, found)
    rows = rows.withColumns(tests)
    score = sum((F.when(F.col(f"_{n}"), SIGNALS[n][0]).otherwise(0) for n in only), F.lit(0))
    names = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_{n}"), n) for n in only])), ", ")
    return rows.withColumns({"score": score, "reason": F.when(F.col("_enough"), names).otherwise("too little text")}).withColumn("is_card", F.col("score") >= LEAST).drop("_t", "_low", "_enough", *tests)
