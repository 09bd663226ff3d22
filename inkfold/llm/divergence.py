"""How far the sources of a language differ in their words: a sort-based streaming audit.

Three sorted streams. (1) The tokens of a block of documents are sorted by (lang, source, term, document) and scanned run by run into
partial runs. (2) Partial runs are dealt by (lang, term), sorted by (lang, term, source) and scanned: a run gives a term's
document frequency and its count in each source. (3) Kept terms are dealt and sorted again behind a row of their language's
sources and totals; the scan of a block of terms emits partial sums for pairs of sources and the block's leading terms."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, slices, table, text_buffer

LEAST_DOCUMENTS, TOP = 10, 10
#: A term is a run of ASCII letters and of anything beyond ASCII; shares are whole numbers of this unit.
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UNIT_STEPS = 3  # 1000 ** 3 = 1,000,000,000
#: Bytes of text whose tokens are sorted together, and cells (terms x sources) of a block of the last scan.
BLOCK, CELLS = 16_000_000, 2_000_000

_PARTIAL = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])
_PARTIAL_DDL = "lang string, term string, source string, docs long, n long"
_RUN_DDL = "lang string, term string, docs long, sources array<string>, counts array<long>"
_OUT = "lang string, source string, part string, item string, value long"


def _partial_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of (lang, source, term) in blocks of documents. The empty term marks a group: it is emitted for each, with no
    documents, so that groups without terms are known."""
    for whole in batches:
        for batch in slices(whole, "text", BLOCK):
            raw, at = text_buffer(batch.column("text"))
            groups: dict[tuple[str, str], int] = {}
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.int64)
            order = np.argsort(group, kind="stable")  # so that a document's place tells its group
            data, index = raw.tobytes(), {}
            found = [np.array([index.setdefault(t, len(index)) for t in _TERM.findall(data[at[i] : at[i + 1]].lower())], np.int64) for i in order.tolist()]
            key, n = np.unique(np.concatenate([f * len(order) + k for k, f in enumerate(found)]), return_counts=True)
            term, of = key // len(order), group[order][key % len(order)]
            first = np.nonzero(np.diff(term, prepend=-1) | np.diff(of, prepend=-1))[0]
            names, keys = [*index, b""], list(groups)
            terms = np.concatenate([term[first], np.full(len(keys), len(names) - 1)])
            ofs = np.concatenate([of[first], np.arange(len(keys))])
            none = np.zeros(len(keys), np.int64)
            docs = np.concatenate([np.diff(np.append(first, len(key))), none])
            counts = np.concatenate([np.add.reduceat(n, first) if len(first) else n, none])
            pick = lambda values, which: pa.array(values, pa.string()).take(pa.array(which))
            yield pa.RecordBatch.from_arrays([pick([k[0] for k in keys], ofs), pick(names, terms), pick([k[1] for k in keys], ofs), pa.array(docs), pa.array(counts)], schema=_PARTIAL)


def _starts(t: pa.Table, *by: str) -> np.ndarray:
    """Where the values of sorted columns change, the first row included."""
    new = np.ones(t.num_rows, bool)
    new[1:] = False
    for c in by:
        x = t.column(c).combine_chunks()
        new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    return np.nonzero(new)[0]


def _merged(t: pa.Table) -> pa.Table:
    """Rows of one (lang, term, source) summed; t is sorted."""
    at = _starts(t, "lang", "term", "source")
    sums = [pa.array(np.add.reduceat(t.column(c).to_numpy(), at)) for c in ("docs", "n")]
    return pa.table([*[t.column(c).take(pa.array(at)) for c in ("lang", "term", "source")], *sums], schema=_PARTIAL)


def _term_runs(least: int):
    """Scan (lang, term, source)-sorted partial runs: a row for each term of at least so many documents, and for each language's
    mark. Of an open term only its sums by source are carried into the next batch."""

    def closed(t: pa.Table) -> pa.RecordBatch:
        at = _starts(t, "lang", "term")
        docs, bounds = np.add.reduceat(t.column("docs").to_numpy(), at), np.append(at, t.num_rows).astype(np.int32)
        listed = lambda c, kind: pa.ListArray.from_arrays(pa.array(bounds), t.column(c).combine_chunks().cast(kind))
        heads = [t.column(c).take(pa.array(at)).combine_chunks() for c in ("lang", "term")]
        out = pa.RecordBatch.from_arrays([*heads, pa.array(docs), listed("source", pa.string()), listed("n", pa.int64())], names=["lang", "term", "docs", "sources", "counts"])
        return out.filter(pc.or_(pa.array(docs >= least), pc.equal(heads[1], "")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _PARTIAL.empty_table()
        for batch in batches:
            if not batch.num_rows:
                continue
            t = _merged(pa.concat_tables([held, pa.Table.from_batches([batch]).cast(_PARTIAL)]))
            last = int(_starts(t, "lang", "term")[-1])
            held = t.slice(last)
            if last:
                yield closed(t.slice(0, last))
        if held.num_rows:
            yield closed(held)

    return run


def shares(counts: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact in 64 bits for totals up to 9 * 10^15: a long division in steps of 1000."""
    below = np.asarray(total, np.int64) + 2 * terms
    rest, out = counts.astype(np.int64) + 2, np.zeros(counts.shape, np.int64)
    whole, rest = rest // below, rest % below
    for _ in range(UNIT_STEPS):
        rest = rest * 1000
        out, rest = out * 1000 + rest // below, rest % below
    return 1 + whole * 1000**UNIT_STEPS + out


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of shares."""
    return (p - q) ** 2 // (p + q)


class _Block:
    """Terms of one language that are compared together."""

    def __init__(self, lang: str, sources: list[str], totals: list[int], terms: int):
        self.lang, self.sources, self.totals, self.v = lang, sources, np.array(totals, np.int64), terms
        self.place = {s: k for k, s in enumerate(sources)}
        self.clear()

    def clear(self) -> None:
        self.terms: list[str] = []
        self.at: list[tuple[int, list[str], list[int]]] = []

    def add(self, term: str, sources: list[str], counts: list[int]) -> bool:
        self.at.append((len(self.terms), sources, counts))
        self.terms.append(term)
        return len(self.terms) * max(1, len(self.sources)) >= CELLS

    def zeros(self) -> list[tuple]:
        return [(self.lang, a, "pair", b, 0) for a in self.sources for b in self.sources if a != b]

    def out(self, top: int) -> list[tuple]:
        """Partial sums of all pairs of sources over the block, and the block's leading terms of each source."""
        c = np.zeros((len(self.terms), len(self.sources)), np.int64)
        for i, sources, counts in self.at:
            c[i, [self.place[s] for s in sources]] = counts
        p, q = shares(c, self.totals, self.v), shares(c.sum(1), int(self.totals.sum()), self.v)
        rows = []
        for k, source in enumerate(self.sources):
            rows += [(self.lang, source, "pair", other, int(x)) for j, (other, x) in enumerate(zip(self.sources, gap(p[:, [k]], p).sum(0), strict=True)) if j != k]
            more = np.nonzero((c[:, k] > 0) & (p[:, k] > q))[0]
            value = gap(p[more, k], q[more])
            rows += [(self.lang, source, "term", self.terms[more[i]], int(value[i])) for i in np.argsort(-value, kind="stable")[:top]]
        self.clear()
        return rows


def _compared(top: int):
    """Scan rows sorted by (lang, term): a language's own row, whose term is empty, comes first."""
    form = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, form, strict=True)], schema=form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for lang, term, part, terms, sources, counts in zip(*[batch.column(c).to_pylist() for c in ("lang", "term", "part", "terms", "sources", "counts")], strict=True):
                if term == "":
                    if block and block.terms:
                        yield made(block.out(top))
                    block = _Block(lang, sources, counts, terms)
                    if part == 0:
                        yield made(block.zeros())
                elif block.add(term, sources, counts):
                    yield made(block.out(top))
        if block and block.terms:
            yield made(block.out(top))

    return run


def term_counts(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, docs, sources, counts) of every term in at least so many documents of its language, with the sources that
    hold it; and one row with an empty term for each language, with all its sources. Each row of docs is a document."""
    words = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = words.mapInArrow(_partial_runs, _PARTIAL_DDL)
    return partial.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(_term_runs(least), _RUN_DDL)


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) over docs (text, lang, source): for each source of a language its divergence from
    every other source (part `pair`), and the terms that it has more of than the whole language (part `term`, the first `top`).

    A null text, lang or source is an empty one. Only A-Z are lower-cased. A repeated row is a document of its own; a document
    without terms still makes its group known; a language without kept terms gives pairs of value 0, a lone source none; equal
    values rank by item in UTF-8 order; other columns are ignored; no rows give no rows. Whole texts, exact whole numbers.

    The result holds a row for each two sources of a language, and each of its terms is compared for each two."""
    spark = docs.sparkSession
    runs = save(term_counts(docs, least))
    is_term = F.col("term") != ""
    counted = runs.where(is_term).select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = runs.where(~is_term).select("lang", F.explode("sources").alias("source")).join(counted, ["lang", "source"], "left")
    sizes = runs.where(is_term).groupBy("lang").agg(F.count("*").alias("terms"))
    # A language's row is as long as it has sources; the result is as long as the square of that.
    heads = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("s")).join(sizes, "lang", "left")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heads = heads.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "lang", F.lit("").alias("term"), F.coalesce("terms", F.lit(0).cast("long")).alias("terms"), F.col("s.source").alias("sources"), F.col("s.n").alias("counts"))
    terms = runs.where(is_term).select(F.pmod(F.xxhash64("lang", "term"), F.lit(parts)).cast("int").alias("part"), "lang", "term", F.lit(0).cast("long").alias("terms"), "sources", "counts")
    stream = heads.unionByName(terms).repartitionById(parts, F.col("part")).sortWithinPartitions("lang", "term")
    found = save(stream.mapInArrow(_compared(top), _OUT))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = pairs.unionByName(found.where("part = 'term'")).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(any_value(s.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) d
      LEFT JOIN (SELECT c.lang, c.source, sum(c.n) AS n FROM c JOIN k USING (lang, term) GROUP BY ALL) s USING (lang, source) GROUP BY d.lang, d.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * v.v) AS p,
        1 + 1000000000::HUGEINT * (k.n + 2) // (v.total + 2 * v.v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, value::BIGINT AS value,
      row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
