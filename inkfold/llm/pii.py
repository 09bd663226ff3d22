"""Personal data by weak supervision, with DataFrame functions only: regex, gazetteer and context labelers vote on candidate
spans, expectation-maximisation estimates how reliable each is, and a span classifier is trained on the result."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, table

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive repeats and the guards before a run keep the scan linear; with no retries they
# match what the plain patterns match: a run's own start, or the end of the previous match (\G), is the leftmost start.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# Wider candidates that base patterns miss, in each kind.
WIDER = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\x20at\x20|@)\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9A-Fa-f:])|\G)(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20. –-][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\(0?[0-9]{2,4}\)[\x20-]?|0[0-9]{1,4}[\x20./-]|[0-9]{3}[\x20./-])[0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![0-9])",
}

# Words in the context of a span, and gazetteers of domains and calling codes.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel|kontakt|reach)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|login|logged|from|serveur|servidor)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|carte|karte|tarjeta|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|teléfono|téléphone|appel)\b",
}
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "jp", "it", "nl", "eu", "us")
#: Fewest spans of a kind from which the model is estimated; with fewer, the priors hold.
LEAST_SPANS = 20
#: Matches of a text that are placed together, and code points of a text that contexts are cut from.
PAGE, PIECE = 64, 1024
ROUNDS, PRIOR = 50, 0.5


_SPANS = "array<struct<start:int,end:int,value:string>>"


def _nothing() -> Column:
    return F.array().cast(_SPANS)


def matches(text: Column, pattern: str, passes: Callable[[Column], Column] = lambda value: F.lit(True)) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches that pass, in code points. The text is split at
    the same matches; a match begins behind all gaps and matches before it. The length of each page of PAGE matches comes first,
    then the pages' starts, then the places inside each page: a step of an aggregate copies its array, so no array is long."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = lambda m: F.coalesce(F.char_length(m), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(F.char_length(g).alias("gap"), size(m).alias("size"), m.alias("value")))

    def located(ps: Column) -> Column:
        pages = F.sequence(F.lit(0), F.floor(F.greatest(F.size(ps) - 1, F.lit(0)) / PAGE).cast("int"))
        page = lambda i: F.transform(F.sequence(i * PAGE, F.least(i * PAGE + PAGE, F.size(ps)) - 1), lambda k: F.get(ps, k))
        lengths = F.transform(pages, lambda i: F.aggregate(page(i), F.lit(0), lambda a, p: a + p["gap"] + p["size"]))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(lengths, begin, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"])

        def step(a: Column, p: Column) -> Column:
            start = a["at"] + p["gap"]
            end = start + p["size"]
            span = F.array(F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value")))
            return F.struct(end.alias("at"), F.when(p["value"].isNotNull() & passes(p["value"]), F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

        inside = lambda i, at: F.aggregate(page(i), F.struct(at.alias("at"), _nothing().alias("spans")), step, lambda a: a["spans"])
        return F.flatten(F.zip_with(pages, starts, inside))

    # One element, so that the pairs are a variable of the lambda and found once.
    return F.get(F.transform(F.array(pairs), located), 0)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    n = F.char_length(digits)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.char_length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = F.char_length(_digits(value))
        return F.when(n.between(13, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with an array column for each kind: the base spans (start, end, value), in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    likely = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike("[0-9][.][0-9]"), "card": text.rlike("[0-9]")}
    out = docs.select("doc_id", text.alias("text"))
    spans = {k: F.when(likely[k], matches(F.col("text"), PATTERNS[k], partial(_passes, k))).otherwise(_nothing()) for k in KINDS}
    return out.select("doc_id", "text", *[spans[k].alias(k) for k in KINDS])


def _labelers(kind: str, value: Column, before: Column, after: Column) -> dict[str, Column]:
    """Votes on a span: 1 personal data, 0 not, null abstains."""
    digits = F.char_length(_digits(value))
    vote = lambda yes, no=None: F.when(yes, 1).when(no, 0) if no is not None else F.when(yes, 1)
    shape = {"email": value.rlike(PATTERNS["email"].replace(r"(?:(?<![A-Za-z0-9._%+-])|\G)", "^") + "$"), "ip": value.rlike(r"^[0-9]++(?:\.[0-9]++){3}$"), "card": digits.between(13, 19), "phone": digits.between(9, 15)}[kind]
    strict = {"email": ~value.rlike(r"\.\.|^\.|-\."), "ip": _passes("ip", value) & ~value.rlike(r"^0|\.0[0-9]"), "card": F.when(digits.between(13, 19), luhn(_digits(value))).otherwise(False), "phone": value.rlike(r"^\+|^\(|^0")}[kind]
    gazetteer = {"email": F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1)).isin(*DOMAINS), "ip": ~value.rlike(r"^(?:0|127|255|22[4-9]|23[0-9])\."), "card": value.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"), "phone": value.rlike(r"^\+(?:1|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-9]|7|8[0-9]|9[0-9])|^\(?0[1-9]")}[kind]
    context = (before.rlike(CONTEXT[kind]) | after.rlike(CONTEXT[kind])).cast("boolean")
    clash = before.rlike(r"[0-9A-Za-z_=/#]$") | after.rlike(r"^[0-9A-Za-z_=/]") | before.rlike(r"(?i)(?:version|licen[cs]e|isbn|no\.|page|token|v)\s?[=:\"']?\s*$")
    return {"shape": vote(shape, ~shape), "strict": vote(strict, ~strict), "gazetteer": vote(gazetteer, ~gazetteer), "context": vote(context), "clash": F.when(clash, 0)}


# What a text must hold to have a wider candidate of a kind.
HINTS = {"email": r"@|(?i)\bat\b", "ip": ":", "card": "[0-9]{4}", "phone": "[0-9]{3}"}


def meets(spans: str, s: Column) -> Column:
    """Whether s overlaps one of the spans, which are in order and do not overlap each other: a binary search for the first one that
    ends behind the start of s."""
    halve = lambda b: F.floor((b["low"] + b["high"]) / 2).cast("int")

    def step(b: Column, _: Column) -> Column:
        behind = (b["low"] < b["high"]) & (F.get(spans, halve(b))["end"] > s["start"])
        return F.struct(F.when(behind | (b["low"] >= b["high"]), b["low"]).otherwise(halve(b) + 1).alias("low"), F.when(behind, halve(b)).otherwise(b["high"]).alias("high"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    first = F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), step)["low"]
    return F.when(F.size(spans) > 0, F.coalesce(F.get(spans, first)["start"] < s["end"], F.lit(False))).otherwise(False)


def candidates(found: DataFrame) -> DataFrame:
    """(doc_id, text key, kind, start, end, base, features): base spans, and wider ones that overlap no base span. The
    features are the labelers' votes and the span's shape, as small integers. One pass over the texts: the spans of all kinds
    are one array, exploded once; a span takes along its context, not the text."""
    text = F.col("text")
    wide = {k: F.when(text.rlike(HINTS[k]), matches(text, WIDER[k])).otherwise(_nothing()).alias(f"wide_{k}") for k in KINDS}
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    found = found.select("doc_id", "key", pieces.alias("pieces"), *KINDS, *wide.values())

    def part(low: Column, size: Column) -> Column:
        """size code points from low, found in two pieces: a substring of the text would count from its start."""
        i = F.floor(low / PIECE).cast("int")
        return F.substring(F.concat(F.get("pieces", i), F.coalesce(F.get("pieces", i + 1), F.lit(""))), low - i * PIECE + 1, size)

    def span(kind: str, base: bool) -> Callable[[Column], Column]:
        def made(s: Column) -> Column:
            before = part(F.greatest(s["start"] - 40, F.lit(0)), F.least(s["start"], F.lit(40)))
            after = F.coalesce(part(s["end"], F.lit(20)), F.lit(""))
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(base).alias("base"), before.alias("before"), after.alias("after"))

        return made

    free = lambda s: ~reduce(or_, [meets(k, s) for k in KINDS])
    parts = [p for k in KINDS for p in (F.transform(k, span(k, True)), F.transform(F.filter(f"wide_{k}", free), span(k, False)))]
    # explode_outer: explode would first filter by the size of the array, and so compute every span twice.
    spans = found.select("doc_id", "key", F.explode_outer(F.concat(*parts)).alias("s")).where(F.col("s").isNotNull()).select("doc_id", "key", "s.*")
    votes = {k: _labelers(k, F.col("value"), F.col("before"), F.col("after")) for k in KINDS}

    def vote(name: str) -> Column:
        out = F.lit(None).cast("int")
        for k in KINDS:
            out = F.when(F.col("kind") == k, votes[k][name]).otherwise(out)
        return F.coalesce(out, F.lit(-1)).alias(name)

    shape = F.least(F.floor(F.char_length("value") / 4), F.lit(6)).cast("int")
    marks = F.least(F.char_length(F.regexp_replace("value", "[0-9A-Za-z]", "")), F.lit(6))
    return spans.select("doc_id", "key", "kind", "start", "end", "base", *[vote(n) for n in VOTES], shape.alias("length"), marks.cast("int").alias("marks"))


VOTES = ("shape", "strict", "gazetteer", "context", "clash")


def reliabilities(counts: list[tuple[tuple[int, ...], float]]) -> tuple[float, list[tuple[list[float], list[float]]], list[float]]:
    """EM of a naive Bayes model with a hidden class, over vote patterns and their counts: the share of personal data, each
    labeler's distribution of votes (abstain, no, yes) given either class, and each pattern's posterior. Starts from
    labelers that are right three times in four."""
    total = sum(n for _, n in counts)
    share, votes = PRIOR, [([0.5, 0.125, 0.375], [0.5, 0.375, 0.125]) for _ in VOTES]
    posterior = [share] * len(counts)
    for _ in range(ROUNDS if total >= LEAST_SPANS else 1):
        for i, (pattern, _) in enumerate(counts):
            odds = math.log(share) - math.log(1 - share) + sum(math.log(votes[k][0][v + 1]) - math.log(votes[k][1][v + 1]) for k, v in enumerate(pattern))
            posterior[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        if total < LEAST_SPANS:
            break
        yes = sum(n * p for (_, n), p in zip(counts, posterior, strict=True))
        share = min(0.98, max(0.02, (yes + 2) / (total + 4)))
        votes = [tuple([(sum(n * (p if side == 0 else 1 - p) for (pattern, n), p in zip(counts, posterior, strict=True) if pattern[k] == v) + 4 * start[side][v + 1]) / ((yes if side == 0 else total - yes) + 4) for v in (-1, 0, 1)] for side in (0, 1)) for k, start in enumerate([([0.5, 0.125, 0.375], [0.5, 0.375, 0.125])] * len(VOTES))]
    return share, votes, posterior


def span_weights(counts: list[tuple[tuple[int, ...], float, float]]) -> list[float]:
    """Logistic weights of span features (bias last) on soft labels, by gradient steps over distinct feature rows."""
    if not counts:
        return []
    width = len(counts[0][0])
    w, total = [0.0] * (width + 1), sum(n for _, n, _ in counts)
    for _ in range(300):
        grad = [0.01 * x for x in w]
        for x, n, y in counts:
            z = w[-1] + sum(a * b for a, b in zip(w, x, strict=False))
            d = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * n / total
            for k in range(width):
                grad[k] += d * x[k]
            grad[-1] += d
        w = [a - 1.0 * g for a, g in zip(w, grad, strict=True)]
    return w


def _indicators() -> list[Column]:
    """0/1 features of a span for the classifier."""
    return [(F.col(v) == x).cast("int") for v in VOTES for x in (0, 1)] + [(F.col("length") >= k).cast("int") for k in (2, 3, 4, 5)] + [(F.col("marks") >= k).cast("int") for k in (1, 2, 4)]


def classified(spans: DataFrame) -> DataFrame:
    """The rows of candidates() with `score` of the final classifier. Each kind has its own model; what the driver gets are
    counts of distinct vote patterns (3^5 at most) and of distinct features (3^5 * 7 * 7 at most)."""
    score = F.lit(0.0)
    counted = spans.groupBy("kind", *VOTES, "length", "marks").agg(F.count("*").alias("n")).select("kind", *VOTES, "n", *[c.alias(f"x{i}") for i, c in enumerate(_indicators())]).collect()
    for kind in KINDS:
        rows = [r for r in counted if r["kind"] == kind]
        patterns: dict[tuple[int, ...], float] = {}
        for r in rows:
            p = tuple(r[v] for v in VOTES)
            patterns[p] = patterns.get(p, 0) + r["n"]
        order = sorted(patterns.items())
        _, _, posterior = reliabilities(order)
        soft = {p: q for (p, _), q in zip(order, posterior, strict=True)}
        x = {}
        for r in rows:
            features = tuple(r[f"x{i}"] for i in range(len(_indicators())))
            n, y = x.get(features, (0, 0.0))
            x[features] = (n + r["n"], y + r["n"] * soft[tuple(r[v] for v in VOTES)])
        w = span_weights([(k, n, y / n) for k, (n, y) in sorted(x.items())])
        if w:
            z = F.lit(w[-1])
            for a, c in zip(w, _indicators(), strict=False):
                z = z + F.lit(a) * c
            score = F.when(F.col("kind") == kind, 1 / (1 + F.exp(-z))).otherwise(score)
    return spans.withColumn("score", score)


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end,base,score>>) of each row of docs, ordered by kind as in KINDS, then start.

    Base spans always stay, with their score; a wider span stays if the classifier gives it the threshold. Whole texts; a
    null or empty text has no spans; repeated rows stay, each with its spans; other columns are ignored."""
    keyed = base_spans(docs.select("doc_id", "text")).withColumn("key", F.xxhash64("text"))
    spans = save(candidates(keyed).distinct())
    kept = classified(spans).where(F.col("base") | (F.col("score") >= threshold))
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    per = kept.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct(kind.alias("k"), "start", "end", "kind", "base", "score"))).alias("spans"))
    per = per.withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    none = F.array().cast(per.schema["spans"].dataType)
    return rows.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k)))
    return found.select("doc_id", *[count(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
