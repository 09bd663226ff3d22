"""Embedding near-duplicates by lattice hashing: random projections decoded to E8 points, in several tables."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_saved, extended, save, table
from .components import connected_components

COSINE = 0.98
#: A cell is a pair of E8 points, of two blocks of 8 projections, at any number of rows: 6e-8 of random pairs share one. Two
#: unit vectors of cosine 0.98 are 0.2 apart, so a block's projections differ by about 0.57 / WIDTH; E8 cells have an inner
#: radius of 0.71. With PROBES neighbours beside its own cell, such a pair meets in a table with probability 0.64.
BLOCKS, TABLES, PROBES, WIDTH = 2, 6, 11, 1.1
#: Tables that are joined at once: 24 cells for each vector are on disk at a time.
AT_ONCE = 2
#: Neighbouring cells of a block that probes combine.
NEAR = 12
#: Bytes of vectors that are worked on at once.
PIECE = 8_000_000
SEED = 17


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-1, 1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((-1, 1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


MINIMAL = _minimal()


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum."""
    out = np.rint(x)
    odd = np.nonzero(out.sum(1) % 2)[0]
    gap = x[odd] - out[odd]
    worst = np.abs(gap).argmax(1)
    out[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return out


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: whole or half coordinates, whichever is nearer."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(nearer[:, None], half, whole)


def cells(units: np.ndarray, first: int = 0, last: int = TABLES) -> np.ndarray:
    """(rows, tables, 1 + probes) hashed cells in the tables first to last: a vector's own, then the neighbours that its
    projection is nearest to."""
    rng = np.random.default_rng(SEED)
    mix = rng.integers(1 << 62, 1 << 63, (TABLES, BLOCKS, 8)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(units), last - first, 1 + PROBES), np.uint64)
    for t in range(last):
        plane = rng.standard_normal((units.shape[1], 8 * BLOCKS)) / WIDTH
        if t < first:
            continue
        at = units @ plane
        own, cost, shift = np.zeros((len(units), 1), np.uint64), np.zeros((len(units), 1)), np.zeros((len(units), 1), np.uint64)
        for b in range(BLOCKS):
            here = at[:, 8 * b : 8 * b + 8]
            point = decode(here)
            own[:, 0] += ((2 * point).astype(np.int64).view(np.uint64) * mix[t, b]).sum(1)
            # A step to a neighbouring cell costs how much farther that cell's point is; steps in several blocks add up.
            away = -((here - point) @ MINIMAL.T) + 1
            best = np.argpartition(away, NEAR, axis=1)[:, :NEAR]
            step = ((2 * MINIMAL).astype(np.int64).view(np.uint64) * mix[t, b]).sum(1)[best]
            cost = (cost[:, :, None] + np.pad(np.take_along_axis(away, best, 1), ((0, 0), (1, 0)))[:, None]).reshape(len(units), -1)
            shift = (shift[:, :, None] + np.pad(step, ((0, 0), (1, 0)))[:, None]).reshape(len(units), -1)
        best = 1 + np.argpartition(cost[:, 1:], PROBES, axis=1)[:, :PROBES]
        out[:, t - first, 0] = own[:, 0]
        out[:, t - first, 1:] = own + np.take_along_axis(shift, best, 1)
        out[:, t - first] ^= np.uint64(t * 0x9E3779B97F4A7C15 % (1 << 64))
        out[:, t - first] *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors (in double precision, null components as NaN) of a list column, by length, in pieces of
    bounded size; null and empty lists are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    at = np.cumsum(sizes) - sizes
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy() + 0.0
    for size in np.unique(sizes[sizes > 0]):
        rows = np.nonzero(sizes == size)[0]
        step = max(1, PIECE // (8 * int(size)))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            yield some, flat[at[some][:, None] + np.arange(size)]


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their greatest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batch with `key`: a 128-bit digest of the components, null where a vector or its label links with nothing."""
    for batch in batches:
        keys: list[bytes | None] = [None] * batch.num_rows
        named = batch.column("label").is_valid().to_numpy(zero_copy_only=False)
        for rows, x in _matrices(batch.column("embedding")):
            fine = np.isfinite(x).all(1) & (x != 0).any(1) & named[rows]
            for i in np.nonzero(fine)[0]:
                keys[rows[i]] = hashlib.blake2b(x[i].tobytes(), digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "key"])


def _hashed(first: int, last: int):
    """(node, label, size, cell, own) of each vector in the tables first to last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrices(batch.column("embedding")):
                for k in range(0, len(rows), 1000):
                    some = pa.array(rows[k : k + 1000])
                    found = cells(_units(x[k : k + 1000]), first, last)
                    own = np.zeros(found.shape, bool)
                    own[:, :, 0] = True
                    repeated = np.repeat(np.arange(len(some)), found[0].size)
                    each = lambda name: batch.column(name).take(some).take(pa.array(repeated))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([each("node"), each("label"), pa.array(np.full(len(repeated), x.shape[1], np.int32)), pa.array(found.view(np.int64).ravel()), pa.array(own.ravel())], names=["node", "label", "size", "cell", "own"])

    return run


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates (of one length) whose cosine, in double precision, is COSINE or more."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for (rows, x), (_, y) in zip(_matrices(batch.column("va")), _matrices(batch.column("vb")), strict=True):
            keep[rows] = (_units(x) * _units(y)).sum(1) >= COSINE
        mask = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


def near_duplicates(rows: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of rows (vec_id, embedding, label).

    Links join vectors of one label whose cosine is COSINE or more; equal vectors are one class, which is hashed and compared
    once, and its copies count as links of each other. A vector that is null, empty, zero, of another length, or holds null
    or non-finite components, and one without a label, links with nothing; a null vec_id takes part but names no
    component; repeated rows are vectors of their own; other columns are ignored; no rows give no rows.

    Recall: a pair of cosine 0.98 shares one of the tables' probed cells with a measured probability of 0.998, at any number
    of rows (tests hold it against all pairs)."""
    given = rows.select("vec_id", "embedding", "label")
    keyed = given.mapInArrow(_keyed, extended(given, key="binary"))
    groups = keyed.where("key is not null").groupBy("label", "key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    groups = save(groups.withColumn("node", F.monotonically_increasing_id()))
    kind = given.schema["label"].dataType.simpleString()
    found = []
    for k in range(0, TABLES, AT_ONCE):
        hashed = save(groups.select("node", "label", "embedding").mapInArrow(_hashed(k, min(k + AT_ONCE, TABLES)), f"node long, label {kind}, size int, cell long, own boolean"))
        own = hashed.where("own").select("label", "size", "cell", F.col("node").alias("b"))
        met = hashed.select("label", "size", "cell", F.col("node").alias("a")).join(own, ["label", "size", "cell"]).where("a <> b")
        found.append(save(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
        drop_saved(hashed)
    pairs = reduce(DataFrame.union, found).distinct()
    vectors = groups.select("node", "embedding")
    full = pairs.join(vectors.select(F.col("node").alias("a"), F.col("embedding").alias("va")), "a").join(vectors.select(F.col("node").alias("b"), F.col("embedding").alias("vb")), "b")
    links = save(full.mapInArrow(_close, "a long, b long"))
    for some in found:
        drop_saved(some)
    near = links.union(links.select("b", "a")).join(groups.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    parts = connected_components(links)
    named = groups.join(parts, "node", "left").join(near, "node", "left")
    named = save(named.select("label", "key", "copies", "least", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("component", "node").alias("component")))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    final = named.join(ids, "component").select(F.col("label").alias("l"), F.col("key").alias("k"), (F.col("others") + F.col("copies") - 1).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "label", "key").join(final, (F.col("key") == F.col("k")) & (F.col("label") == F.col("l")), "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
