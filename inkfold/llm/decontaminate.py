"""Benchmark decontamination: a prefix-filtered set join between benchmark windows and documents. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, save, table

WINDOW, SHINGLE = 10, 3
#: Windows of the benchmark that are broadcast at once: about 300 bytes each, so 15 MB at most. More go in further blocks.
BLOCK = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; a text of ASCII alone takes the faster function."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _once(c: Column) -> Column:
    """A generated column: Catalyst would otherwise copy its expression into each lambda that uses it."""
    return F.explode(F.array(c))


def _shingles(w: Column, size: int) -> Column:
    """A hash for each word position: the `size` words that begin there (fewer at the end, which verification rejects)."""
    return F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]))


def _windows(items: DataFrame, window: int) -> DataFrame:
    """(window array, items array): distinct windows, each with the ids of its items."""
    w = items.select("item_id", _once(words(F.col("text"))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("window"))
    return cut.groupBy("window").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))


def _prefixes(words_of: DataFrame, windows: DataFrame, shingle: int, sizes: list[int]) -> DataFrame:
    """Each window with its prefix token: the rarest of its shingles in the corpus (for exact containment a prefix of
    one token is enough), that token's offset, and the lengths."""
    tokens = None
    for size in sizes:
        mine = windows.where(F.least(F.size("window"), F.lit(shingle)) == size)
        hashes = F.slice(_shingles(F.col("window"), size), F.lit(1), F.size("window") - size + 1)
        mine = mine.select("window", "items", F.lit(size).alias("size"), F.posexplode(hashes).alias("offset", "token"))
        tokens = mine if tokens is None else tokens.union(mine)
    tokens = save(tokens)
    rare = None
    for size in sizes:
        wanted = tokens.where(F.col("size") == size).select("token").distinct()
        for block in range(max(1, math.ceil(wanted.count() / (20 * BLOCK)))):
            part = wanted.where(F.pmod(F.xxhash64("token"), F.lit(max(1, math.ceil(wanted.count() / (20 * BLOCK))))) == block)
            seen = words_of.select(F.explode(_shingles(F.col("w"), size)).alias("token")).join(F.broadcast(part), "token").groupBy("token").count()
            seen = seen.withColumn("size", F.lit(size))
            rare = seen if rare is None else rare.union(seen)
    rare = rare.withColumnsRenamed({"token": "t", "size": "s"})
    ranked = tokens.join(rare, (tokens.token == rare.t) & (tokens["size"] == rare.s), "left").select("window", "items", "size", "offset", "token", F.coalesce("count", F.lit(0)).alias("n"))
    first = Window.partitionBy("window").orderBy("n", "offset")
    return save(ranked.withColumn("r", F.row_number().over(first)).where("r = 1").select("window", "items", "size", "offset", "token", F.size("window").alias("len")))


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, n_words, start, len, items): every occurrence of a benchmark window in a document, and for each row of
    docs one row with start -1. key: a hash of the text, so that rows of one id and other texts stay apart."""
    windows = save(_windows(benchmark, window))
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("window"), F.lit(shingle))).distinct().collect())
    words_of = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), _once(words(F.col("text"))).alias("w"))
    always = docs.sparkSession.createDataFrame([([], [], 0, 0, 0, 0)], "window array<string>, items array<string>, size int, offset int, token long, len int")
    prefixes, blocks = always.limit(0), 1
    if sizes:
        prefixes = _prefixes(words_of, windows, shingle, sizes)
        blocks = max(1, math.ceil(prefixes.count() / BLOCK))
    listed = F.concat(*[_shingles(F.col("w"), size) for size in sizes]) if sizes else F.array().cast("array<bigint>")
    tokens = words_of.select("doc_id", "key", "w", F.size("w").alias("n_words"), _once(listed).alias("tokens"))
    places = F.col("n_words") * len(sizes)
    #: Positions of one shingle size follow those of another; place -1 meets the row `always`.
    size_at = F.element_at(F.array(*[F.lit(s) for s in sizes] or [F.lit(0)]), (F.col("at") / F.greatest("n_words", F.lit(1))).cast("int") + 1)
    start = F.pmod(F.col("at"), F.greatest("n_words", F.lit(1))) - F.col("offset")
    out = None
    for block in range(blocks):
        part = prefixes if blocks == 1 else prefixes.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        wanted = [r[0] for r in part.select("token").distinct().collect()]
        part = part.union(always.select(*prefixes.columns)) if block == 0 else part
        # The tokens of a block are a literal set: only places that hold one leave the row, so that long word arrays are
        # not copied for each of their words.
        found = F.filter(F.sequence(F.lit(0), places - 1), lambda i: F.get("tokens", i).isin(wanted)) if wanted else F.array().cast("array<int>")
        found = F.when(places > 0, found).otherwise(F.array().cast("array<int>"))
        found = F.concat(F.array(F.lit(-1)), found) if block == 0 else found
        listed = tokens.select("doc_id", "key", "w", "n_words", "tokens", found.alias("found"))
        placed = listed.select("doc_id", "key", "w", "n_words", "tokens", F.explode("found").alias("at"))
        placed = placed.select("doc_id", "key", "w", "n_words", "at", F.when(F.col("at") < 0, F.lit(0)).otherwise(F.get("tokens", F.col("at"))).alias("token"))
        met = placed.join(F.broadcast(part), "token")
        within = (start >= 0) & (start + F.col("len") <= F.col("n_words"))  # positional and length bounds
        exact = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("window")
        kept = met.where(F.when(F.col("at") < 0, F.col("len") == 0).otherwise(F.when((F.col("len") > 0) & (F.col("size") == size_at) & within, exact).otherwise(False)))
        kept = kept.select("doc_id", "key", F.col("n_words").cast("long").alias("n_words"), F.when(F.col("at") < 0, -1).otherwise(start).alias("start"), "len", "items")
        out = kept if out is None else out.union(kept)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, n_words, n_hit, items) of each row of docs: words inside any occurrence of a window, and the item ids
    (strings, sorted) whose windows occur.

    Texts are whole; a null or empty text has no words; an item with fewer words than a window is one window, without
    words it is none; items that are null or repeat count once; an item whose id is null marks words but is not listed.
    Repeated rows of docs stay; other columns are ignored; empty tables give no rows or no hits."""
    found = occurrences(docs, benchmark, window)
    order = Window.partitionBy("doc_id", "key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    new = F.when(F.col("len") > 0, F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(order), F.lit(0))))).otherwise(0)
    per = found.withColumn("new", new).groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"), F.sum("new").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count_if(F.col("len") == 0).alias("rows")
    )
    return per.select("doc_id", "key", "n_words", "n_hit", "items", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))).drop("col")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark window occurs."""
    theirs, ours, of = fresh(docs, "id", "key", "of")
    bad = contamination(docs, benchmark, window).where("n_hit > 0").select(F.col("doc_id").alias(theirs), F.col("key").alias(ours)).distinct()
    keyed = docs.withColumn(of, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    return keyed.join(bad, F.col(theirs).eqNullSafe(F.col("doc_id")) & (F.col(ours) == F.col(of)), "left_anti").drop(of)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS x FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(x) AS k FROM win),
pos AS (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0),
cut AS (SELECT r, i, k, list_slice(w, i, i + k - 1) AS x FROM pos, sizes WHERE i + k - 1 <= len(w)),
hit AS (SELECT r, i, k, item_id FROM cut JOIN win USING (x)),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT r, i, k FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (r) LEFT JOIN items t USING (r)
"""
