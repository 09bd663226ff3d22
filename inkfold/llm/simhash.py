"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, save, slices, table, text_buffer
from .components import connected_components

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Bytes of a text whose words are held at once.
PIECE = 1_000_000
_GAP = re.compile(rb"[\x20\x09-\x0d]")


def word_pieces(text: bytes, overlap: int, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text (bytes: A-Z lower-cased, white space of ASCII only), cut at white space into pieces of bounded size;
    each piece begins with the last `overlap` words of those before."""
    begin, held = 0, []
    while begin < len(text):
        end = len(text)
        if end - begin > size:
            gap = _GAP.search(text, begin + size)
            end = gap.start() if gap else end
        new = text[begin:end].lower().split()
        if new:
            yield held + new
            held = (held + new)[-overlap:] if overlap else []
        begin = end


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits: each is 1 if set in over half of the XXH64 hashes of the shingles, repeats included. Fewer words than a
    shingle are one; no words: 0."""
    bits, n, few = np.zeros(64, np.int64), 0, []
    for k, words in enumerate(word_pieces(text, shingle - 1)):
        few = words if k == 0 or len(words) < shingle else few
        m = len(words) - shingle + 1
        if m < 1:
            continue
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(m)), np.uint64, m)
        n += m
        for at in range(0, m, 100_000):
            bits += np.unpackbits(hashes[at : at + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(few), SEED) if few else 0
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            raw, at = text_buffer(batch.column("text"))
            out = np.fromiter((fingerprint(raw[at[i] : at[i + 1]].tobytes()) for i in range(batch.num_rows)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(out.view(np.int64))], names=["doc_id", "key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp long) of each row of docs (doc_id, text); key: a hash of the text."""
    rows = docs.select("doc_id", _key(F.col("text")).alias("key"), "text")
    return rows.mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, fp long")


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that differ in 1 or 2 bits, each pair once.

    Two segments of 32 bits. Of two bits that differ, at most one lies in the high segment, or both do and the low
    segments are equal. So the table of high segments is probed with each ball of radius 1 and the table of low
    segments with radius 0. Two high segments one bit apart meet once, as only zeros are flipped; candidates are
    verified on all 64 bits."""
    high = lambda c: F.shiftrightunsigned(c, 32)
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    apart: Column = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    stored = fps.select(F.col("fp").alias("b"), high(F.col("fp")).alias("key"))
    flips = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("h").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    ball = fps.select(F.col("fp").alias("a"), high(F.col("fp")).alias("h")).select("a", "h", F.explode(F.array_distinct(F.concat(F.array("h"), flips))).alias("key"))
    near = ball.join(stored, "key").where((apart <= DISTANCE) & ((F.col("key") != F.col("h")) | (F.col("a") < F.col("b")))).select("a", "b")
    other = fps.select(F.col("fp").alias("a"), low(F.col("fp")).alias("key")).join(fps.select(F.col("fp").alias("b"), low(F.col("fp")).alias("key")), "key")
    far = other.where((F.col("a") < F.col("b")) & (apart == DISTANCE) & (F.bit_count(high(F.col("a").bitwiseXOR(F.col("b")))) == 2)).select("a", "b")
    return near.union(far)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp, component_id) of each row: the least doc_id that links of up to 2 differing bits reach.

    Rows of one fingerprint are one node, so copies are never paired. A null or empty text has fingerprint 0 and links
    like any other; a text of any length is read whole, piece by piece; a null doc_id is never a component_id unless no row of the component has an id; repeated rows stay;
    other columns are ignored; no rows give no rows."""
    rows = save(fingerprints(docs))
    nodes = save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(links(nodes.select("fp")))
    joined = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = save(joined)
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    final = save(named.join(ids, "component").select(F.col("fp").alias("of"), "component_id"))
    return rows.join(final, rows.fp == final.of).select("doc_id", "key", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is the least of their group. Repeated rows of that id and
    text stay; rows without an id stay if their whole group has none."""
    theirs, ours, of = fresh(docs, "id", "key", "of")
    found = near_duplicates(docs)
    gone = save(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(theirs), F.col("key").alias(ours)).distinct())
    keyed = docs.withColumn(of, _key(F.col("text")))
    return keyed.join(gone, F.col(theirs).eqNullSafe(F.col("doc_id")) & (F.col(ours) == F.col(of)), "left_anti").drop(of)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
