"""Secrets in text, with DataFrame functions only: base patterns, and strings that look drawn at random.

Two first-order Markov models of characters, one of random strings and one of ordinary identifiers, are trained from labelled
samples. A long run of key characters is a secret if its log-likelihood ratio under the two is above a threshold that
the samples calibrate."""

from __future__ import annotations

import math
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table
from .pii import matches, meets

KINDS = ("assign", "access", "hex", "random")

# The base patterns, and the fewest characters of what they must hold. The guard before a run of hex digits keeps the
# scan linear: a run's own start, or the end of the previous match (\G), is the leftmost start.
PATTERNS = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?:(?<![0-9a-f])|\G)[0-9a-f]++",
}
VALUE = r"(?i)^(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]++)"
LEAST = {"assign": 6, "access": 20, "hex": 24}
# What a text must hold to have a match of a kind.
HINTS = {"assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}", "random": r"[A-Za-z0-9+/_=-]{20}"}
# A run that may be a secret, and a word that an identifier is made of: no part of a longer string.
RUN, WORD = r"(?:(?<![A-Za-z0-9+/_=-])|\G)[A-Za-z0-9+/_=-]++", r"(?<![A-Za-z0-9])[A-Za-z][a-z]{2,}+(?![A-Za-z0-9])"
LEAST_RUN = 20
#: The models' alphabet: a character is its place here, or 0 beyond it.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
STATES = len(ALPHABET) + 1
#: Share of ordinary samples that may lie above the threshold.
FALSE_ALARMS = 1e-4
_SPANS = "array<struct<start:int,end:int,value:string>>"


def _passes(kind: str, value: Column) -> Column:
    if kind == "assign":
        return F.char_length(F.regexp_extract(value, VALUE, 1)) >= LEAST[kind]
    return F.char_length(value) >= LEAST.get(kind, LEAST_RUN)


def _found(text: Column, kind: str) -> Column:
    spans = matches(text, PATTERNS.get(kind, RUN), partial(_passes, kind))
    return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast(_SPANS))


def samples(docs: DataFrame) -> DataFrame:
    """(value, random, held_out), labelled by how they are made from the distinct words of docs (text): words joined as in
    identifiers are ordinary; digests of a word in base 64, base 32 letters, hex digits and mixtures are random. Every word of
    the corpus gives samples. A quarter of the words is held out of training, to calibrate."""
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).select("w")
    low, seed = F.lower("w"), F.sha2(F.col("w"), 256)
    other = F.reverse(low)  # a second word-like part
    ordinary = [low, F.concat_ws("_", low, low), F.concat(low, F.initcap(low), F.initcap(other)), F.upper(F.concat_ws("_", low, other)), F.concat_ws("-", low, low, low), F.concat(low, F.lit("/"), other, F.lit("_"), F.length("w").cast("string"))]
    coded = F.base64(F.unhex(seed))
    upper = F.upper(F.substring(F.regexp_replace(coded, "[^A-Za-z0-9]", ""), 1, 24))
    random = [F.substring(coded, 1, 40), F.regexp_replace(coded, "[+/=]", ""), upper, seed, F.upper(seed), F.translate(coded, "+/=", "-_")]
    made = [F.struct(v.alias("value"), F.lit(False).alias("random")) for v in ordinary] + [F.struct(v.alias("value"), F.lit(True).alias("random")) for v in random]
    held = F.pmod(F.crc32(F.col("w").cast("binary")), F.lit(4)) == 0
    return words.select(F.explode(F.array(*made)).alias("s"), held.alias("held_out")).select("s.*", "held_out")


def _codes(value: Column) -> Column:
    """The places of a string's characters in the alphabet, with 0 before the first."""
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    return F.concat(F.array(F.lit(0)), F.transform(F.split(value, ""), lambda c: place(c)))


def transitions(labelled: DataFrame) -> list[float]:
    """The log-likelihood ratio of each character given the one before it, random against ordinary, with one added to each count: a
    list by (before, character). What the driver gets is a count for each pair of characters and label."""
    codes = labelled.select("random", _codes(F.col("value")).alias("c"))
    pairs = codes.select("random", F.explode(F.zip_with(F.col("c"), F.slice("c", 2, 1_000_000_000), lambda a, b: F.when(b.isNotNull(), a * STATES + b))).alias("pair"))
    counted = pairs.where(F.col("pair").isNotNull()).groupBy("random", "pair").agg(F.count("*").alias("n")).collect()
    counts = {r: [1] * (STATES * STATES) for r in (False, True)}
    for row in counted:
        counts[row["random"]][row["pair"]] += row["n"]
    rows = {r: [sum(c[k : k + STATES]) for k in range(0, len(c), STATES)] for r, c in counts.items()}
    return [math.log(counts[True][k] / rows[True][k // STATES]) - math.log(counts[False][k] / rows[False][k // STATES]) for k in range(STATES * STATES)]


def ratio(value: Column, table_: list[float]) -> Column:
    """Mean log-likelihood ratio for a character of a string; null for an empty one."""
    weights = F.lit([round(x, 6) for x in table_])
    state = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))

    def step(a: Column, c: Column) -> Column:
        code = F.instr(F.lit(ALPHABET), c)
        return F.struct(code.alias("before"), (a["sum"] + F.get(weights, a["before"] * STATES + code)).alias("sum"))

    total = F.aggregate(F.split(value, ""), state, step, lambda a: a["sum"])
    return F.when(F.char_length(value) > 0, total / F.char_length(value))


def fit(labelled: DataFrame) -> dict:
    """The models' ratios, from samples (value, random, held_out) that are not held out, and a threshold: the least mean ratio, in
    steps of 1/100 from 0 on, that all but FALSE_ALARMS of the held-out ordinary samples lie below."""
    table_ = transitions(labelled.where(~F.col("held_out")))
    steps = labelled.where(F.col("held_out") & (F.char_length("value") > 0)).select("random", F.ceil(ratio(F.col("value"), table_) * 100).alias("step")).groupBy("random", "step").agg(F.count("*").alias("n")).collect()
    ordinary = sorted((r["step"], r["n"]) for r in steps if not r["random"])
    total, above, threshold = sum(n for _, n in ordinary), 0, 0
    for step, n in reversed(ordinary):
        above += n
        if above > FALSE_ALARMS * total:
            threshold = max(0, step)
            break
    random = [(r["step"], r["n"]) for r in steps if r["random"]]
    caught = sum(n for s, n in random if s > threshold) / max(1, sum(n for _, n in random))
    return {"ratios": table_, "threshold": threshold / 100, "caught": caught}


def _apart(found: DataFrame) -> DataFrame:
    """found without the runs that overlap a base span. Spans of one kind are in order and do not overlap each other, so a run is
    looked up in each kind by binary search."""
    return found.withColumn("at_random", F.filter("at_random", lambda s: ~reduce(or_, [meets(f"at_{k}", s) for k in KINDS[:-1]])))


def secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end,score>>) of each row of docs (doc_id, text), by start, then kind as in KINDS.

    Base spans always stay, without a score; a run of LEAST_RUN key characters or more that overlaps none of them stays as kind
    `random` if its mean log-likelihood ratio is above the threshold. labelled: samples (value, random, held_out); by default
    those that samples() makes from docs. Whole texts, offsets in code points; a null or empty text has no spans; each of
    repeated rows gets its own, and null ids stay; other columns are ignored; no rows give no rows."""
    model = fit(save(samples(docs)) if labelled is None else labelled)
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = rows.select("doc_id", *[_found(text, k).alias(f"at_{k}") for k in KINDS])
    apart = _apart(found)
    form = lambda k: lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("k"), s["end"].alias("end"), F.lit(k).alias("kind"), (ratio(s["value"], model["ratios"]) if k == "random" else F.lit(None).cast("double")).alias("score"))
    scored = apart.select("doc_id", *[F.transform(f"at_{k}", form(k)).alias(f"at_{k}") for k in KINDS])
    kept = F.concat(*[F.col(f"at_{k}") for k in KINDS[:-1]], F.filter("at_random", lambda s: s["score"] > model["threshold"]))
    return scored.select("doc_id", F.transform(F.array_sort(kept), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))).alias("spans"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:-1]], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
