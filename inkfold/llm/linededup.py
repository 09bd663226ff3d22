"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard, union-find over distinct lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_saved, fresh, save, slices, table, text_buffer
from .components import connected_components

#: Characters of a shingle, the Jaccard similarity of near-duplicates, and the fewest characters of a line that is compared:
#: shorter ones ("All rights reserved.") recur in clean documents.
SHINGLE, SIMILARITY, LEAST = 8, 0.8, 24
#: 8 bands of 4 minima: two lines of Jaccard 0.8 share a band with probability 1 - (1 - 0.8^4)^8 = 0.985, of 0.9 with 0.9996.
BANDS, ROWS = 8, 4
#: Bins of the one-permutation signature; its minima are dealt to the bands.
BINS = BANDS * ROWS
#: Lines and bytes of a cell, about, where lines of several components share a bucket.
CELL_LINES, CELL_BYTES = 256, 500_000
#: Pairs of lines of a cell that are compared one by one, which is then faster than a matrix product; the links are the same.
FEW_PAIRS = 16
#: Characters hashed at once; longer lines are hashed in pieces and compared by residues.
PIECE = 1_000_000
#: Words of the fixed-size Bloom filters (2 MB) that keep lines without any candidate out of shuffles.
BLOOM_WORDS = 1 << 18
_ODD, _UP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_PLANES = (_ODD, np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_BAND_COLUMNS = [f"b{k}" for k in range(BANDS)]
#: A-Z become a-z, white space but the newline becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in b"\t\x0b\x0c\r" else c for c in range(256))


def _planes(text: bytes) -> list[bytes]:
    """The characters' low bytes and, where some need more, their second and third bytes."""
    if text.isascii():
        return [text]
    chars = text.decode("utf-8", "replace")
    try:
        return [chars.encode("latin-1")]
    except UnicodeEncodeError:
        wide = np.frombuffer(chars.encode("utf-32-le"), np.uint8).reshape(-1, 4)
        return [wide[:, k].tobytes() for k in range(3)]


def _hashed(planes: list[bytes]) -> np.ndarray:
    """A hash of the SHINGLE characters that begin at each place; characters of one plane hash alike beside any others."""
    n = len(planes[0]) - SHINGLE + 1
    x = np.ndarray((n,), "<u8", planes[0], strides=(1,)) * _PLANES[0]
    for plane, odd in zip(planes[1:], _PLANES[1:], strict=False):
        x ^= np.ndarray((n,), "<u8", plane, strides=(1,)) * odd
    x ^= x >> np.uint64(31)
    x *= _UP
    x ^= x >> np.uint64(29)
    return x


def _pieces(line: bytes) -> Iterator[np.ndarray]:
    """Hashes of all shingles of a line, a piece at a time."""
    planes = _planes(line)
    for at in range(0, max(1, len(planes[0]) - SHINGLE + 1), PIECE):
        yield _hashed([p[at : at + PIECE + SHINGLE - 1] for p in planes])


def _distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, sorted; sorting short arrays in place is faster than np.unique."""
    values.sort()
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def shingles(line: bytes) -> np.ndarray:
    """Distinct hashes of the line's shingles, sorted."""
    return _distinct(_hashed(_planes(line)))


def _shared(p: np.ndarray, q: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    p, q = (p, q) if len(p) < len(q) else (q, p)
    return int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())


def similar(x: bytes, y: bytes) -> bool:
    """Whether the distinct shingles of two lines have a Jaccard similarity of SIMILARITY or more, in bounded memory."""
    turns = 1 + (len(x) + len(y)) // (2 * PIECE)
    both = every = 0
    for r in range(turns):
        p, q = (_distinct(np.concatenate([h[h % np.uint64(turns) == r] for h in _pieces(line)])) for line in (x, y))
        both += _shared(p, q) if len(p) and len(q) else 0
        every += len(p) + len(q)
    return both >= SIMILARITY * (every - both)


def _signature(least: np.ndarray) -> np.ndarray:
    """(lines, BANDS) of int64 from the least hash of each bin; an empty bin borrows from the next filled one, offset by the
    distance."""
    places = np.where(np.tile(least != _NONE, 2), np.arange(2 * BINS), 2 * BINS)
    ahead = np.minimum.accumulate(places[:, ::-1], axis=1)[:, ::-1][:, :BINS]
    away = (ahead - np.arange(BINS)).astype(np.uint64)
    least = np.take_along_axis(least, ahead % BINS, axis=1) + away * _ODD
    out = np.zeros((len(least), BANDS), np.uint64)
    for k in range(ROWS):
        out = (out ^ least[:, k * BANDS : (k + 1) * BANDS]) * _UP
        out ^= out >> np.uint64(32)
    return (out * _ODD + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _bin(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)


def bands(lines: list[bytes]) -> np.ndarray:
    """(lines, BANDS) of int64. One-permutation MinHash: a hash's high bits choose its bin and the least of each is kept."""
    least = np.full((len(lines), BINS), _NONE, np.uint64)
    short = [i for i, x in enumerate(lines) if len(x) <= PIECE]
    if short:
        text = b"\n".join([lines[i] for i in short])
        planes = _planes(text)
        lengths = np.fromiter(map(len, (lines[i] for i in short)) if len(planes[0]) == len(text) else map(len, text.decode("utf-8", "replace").split("\n")), np.int64, len(short))
        own, starts = lengths - SHINGLE + 1, np.cumsum(lengths + 1) - (lengths + 1)
        owner = np.repeat(np.arange(len(short), dtype=np.int64), own)
        hashes = _hashed(planes)[np.arange(len(owner)) + np.repeat(starts - (np.cumsum(own) - own), own)]
        held = np.full(len(short) * BINS, _NONE, np.uint64)
        np.minimum.at(held, owner * BINS + _bin(hashes), hashes)
        least[short] = held.reshape(-1, BINS)
    for i in set(range(len(lines))) - set(short):
        for hashes in _pieces(lines[i]):
            np.minimum.at(least[i], _bin(hashes), hashes)
    return _signature(least)


def compared_lines(text: bytes, least: int) -> Iterator[tuple[int, bytes]]:
    """Number and compared form (A-Z lower-cased, white space as one space) of the lines of `least` characters or more."""
    least = max(least, SHINGLE)
    for k, line in enumerate(text.translate(_FOLD).split(b"\n")):
        if len(line) >= least:
            line = b" ".join(line.split()) if b"  " in line else line.strip(b" ")
            if len(line) >= least and (len(line) >= 4 * least or line.isascii() or len(line.decode("utf-8", "replace")) >= least):
                yield k, line


def _digests(lines: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))


def _line_keys(least: int):
    """A row for each compared line: its document, number, 64-bit key and, once in a batch for each key, its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 500_000):
                raw, at = text_buffer(batch.column("text"))
                data, rows, numbers, lines = raw.tobytes(), [], [], []
                for i in range(batch.num_rows):
                    for k, line in compared_lines(data[at[i] : at[i + 1]], least):
                        rows.append(i)
                        numbers.append(k)
                        lines.append(line)
                if not lines:
                    continue
                keys = _digests(lines)
                _, first = np.unique(keys, return_index=True)
                first.sort()
                signed, old = np.zeros((len(lines), BANDS), np.int64), np.ones(len(lines), bool)
                signed[first], old[first] = bands([lines[i] for i in first]), False
                take = pa.array(np.array(rows, np.int64))
                columns = [batch.column("doc_id").take(take), batch.column("doc_key").take(take), pa.array(np.array(numbers, np.int32)), pa.array(keys.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(signed[:, k], mask=old) for k in range(BANDS)], names=["doc_id", "doc_key", "line_no", "key", *_BAND_COLUMNS])

    return run


def _held(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return (bloom[(keys >> np.uint64(6)) & np.uint64(BLOOM_WORDS - 1)] >> (keys & np.uint64(63))) & np.uint64(1) > 0


def _bloom(keys: DataFrame, column: str) -> np.ndarray:
    """The keys' bits, gathered by Spark into BLOOM_WORDS words at most."""
    word = F.shiftrightunsigned(column, 6).bitwiseAND(F.lit(BLOOM_WORDS - 1).cast("long"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(column).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    out = np.zeros(BLOOM_WORDS, np.int64)
    found = keys.groupBy(word.cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def _likely_bands(bloom: np.ndarray):
    """(key, band) of the bands that the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in _BAND_COLUMNS:
                band = batch.column(name)
                hit = pa.array(_held(bloom, band.to_numpy().view(np.uint64)))
                yield pa.RecordBatch.from_arrays([batch.column("key").filter(hit), band.filter(hit)], names=["key", "band"])

    return run


def _line_texts(bloom: np.ndarray, least: int):
    """(key, line) of the compared lines whose key the filter may hold."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2_000_000):
                raw, at = text_buffer(batch.column("text"))
                data = raw.tobytes()
                found = [line for i in range(batch.num_rows) for _, line in compared_lines(data[at[i] : at[i + 1]], least)]
                keys = _digests(found)
                hit = np.nonzero(_held(bloom, keys))[0]
                keys, first = np.unique(keys[hit], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array([found[hit[i]] for i in first], pa.binary())], names=["key", "line"])

    return texts


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of lines (a, b, la, lb) that are similar."""
    for whole in batches:
        for batch in slices(whole, "lb", 2_000_000):
            known: dict[int, np.ndarray] = {}
            held, keep = 0, []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("la"), batch.column("lb"), strict=True):
                x, y = x.as_py(), y.as_py()
                if max(len(x), len(y)) > PIECE:
                    keep.append(similar(x, y))
                    continue
                if a not in known:
                    known, held = ({}, 0) if held > 2_000_000 else (known, held)
                    known[a] = shingles(x)
                    held += len(known[a])
                p, q = known[a], shingles(y)
                both = _shared(p, q) if min(len(p), len(q)) >= SIMILARITY * max(len(p), len(q)) else 0
                keep.append(both >= SIMILARITY * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


def linked_parts(lines: list[bytes], parts: np.ndarray, left: np.ndarray) -> set[tuple[int, int]]:
    """Pairs of parts of which a line of `left` and another line are similar. What two lines share is counted exactly: pair by
    pair in a small cell, else by a product of 0/1 matrices over the shingles of the left lines, some columns at a time."""
    if not left.any():
        return set()
    if max(map(len, lines)) > PIECE:
        return {(int(parts[i]), int(parts[j])) for i in np.nonzero(left)[0] for j in range(len(lines)) if parts[i] != parts[j] and similar(lines[i], lines[j])}
    sets = [shingles(x) for x in lines]
    if left.sum() * len(lines) <= FEW_PAIRS:
        near = lambda p, q: min(len(p), len(q)) >= SIMILARITY * max(len(p), len(q)) and (n := _shared(p, q)) >= SIMILARITY * (len(p) + len(q) - n)
        return {(int(parts[i]), int(parts[j])) for i in np.nonzero(left)[0] for j in range(len(sets)) if parts[i] != parts[j] and near(sets[i], sets[j])}
    sizes = np.array([len(s) for s in sets])
    wanted = _distinct(np.concatenate([s for s, l in zip(sets, left, strict=True) if l]))
    every = np.concatenate(sets)
    column = np.minimum(np.searchsorted(wanted, every), len(wanted) - 1)
    some = wanted[column] == every
    row, column = np.repeat(np.arange(len(sets)), sizes)[some], column[some]
    both = np.zeros((int(left.sum()), len(sets)), np.float32)
    for at in range(0, len(wanted), 8192):
        mine = (column >= at) & (column < at + 8192)
        held = np.zeros((len(sets), min(8192, len(wanted) - at)), np.float32)
        held[row[mine], column[mine] - at] = 1
        both += held[left] @ held.T
    close = (both >= SIMILARITY * (sizes[left][:, None] + sizes - both)) & (parts[left][:, None] != parts)
    i, j = np.nonzero(close)
    return set(zip(parts[left][i].tolist(), parts[j].tolist(), strict=True))


def _linked_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links between parts (a, b) of each cell, one cell at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            cell = batch.column("cell")[k].values
            found = sorted(linked_parts(cell.field("line").to_pylist(), cell.field("part").to_numpy(), cell.field("left").to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def _key(c: Column) -> Column:
    return F.xxhash64(F.coalesce(c, F.lit("")))


def _cells(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """(cell array<left, part, line>): of every bucket that holds several parts, the lines outside its largest part against all
    its lines, in cells of bounded size. Only lines of other parts than the largest are copied to several cells of it."""
    per = placed.groupBy("band", "part").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    per = per.groupBy("band").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max_by("size", F.struct("n", "part")).alias("main_size"), F.max("n").alias("main_n"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("parts"))
    n_cells = lambda n, size: F.greatest(F.ceil(n / CELL_LINES), F.ceil(size / CELL_BYTES))
    mixed = save(per.where("parts > 1").select("band", "main", n_cells(F.col("n") - F.col("main_n"), F.col("size") - F.col("main_size")).alias("lefts"), n_cells(F.col("n"), F.col("size")).alias("rights")))
    rows = placed.join(mixed, "band").withColumn("other", F.col("part") != F.col("main"))
    of = lambda cells: F.pmod(F.xxhash64("key"), cells)
    every = lambda cells: F.sequence(F.lit(0).cast("long"), cells - 1)
    single = (F.col("lefts") == 1) & (F.col("rights") == 1)
    to = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), left.alias("left"))
    as_left = F.when(F.col("other") & ~single, F.transform(every(F.col("rights")), lambda j: to(of(F.col("lefts")), j, F.lit(True)))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,left:boolean>>"))
    as_right = F.transform(every(F.col("lefts")), lambda i: to(i, of(F.col("rights")), F.col("other") & single))
    dealt = rows.select("band", "key", "part", F.explode(F.concat(as_left, as_right)).alias("to"))
    return dealt.join(texts.select("key", "line"), "key").groupBy("band", "to.i", "to.j").agg(F.collect_list(F.struct(F.col("to.left").alias("left"), "part", "line")).alias("cell")).select("cell")


def classes(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lines, parts): every line of `least` characters or more as (doc_id, doc_key, line_no, key), and the component of each
    distinct line that shares a band with another, as (key, component).

    Two rounds of exact comparison: the lines of a bucket with its least line; then, where a bucket still holds several
    components, the lines outside the largest of them with all lines of the bucket. So a large group of near copies costs a
    few comparisons for each line, no bucket is gathered whole, and no link of the banding that joins two components is lost."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", _key(F.col("text")).alias("doc_key"), "text")
    lines = save(keyed.mapInArrow(_line_keys(least), f"doc_id {kind}, doc_key long, line_no int, key long, {', '.join(f'{b} long' for b in _BAND_COLUMNS)}"))
    signed = save(lines.groupBy("key").agg(F.count("*").alias("n"), *[F.min(b).alias(b) for b in _BAND_COLUMNS]))
    buckets = save(signed.select("key", F.explode(F.array(*_BAND_COLUMNS)).alias("band")).groupBy("band").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z").select("band", "a"))
    met = save(signed.drop("n").mapInArrow(_likely_bands(_bloom(buckets, "band")), "key long, band long").join(buckets, "band"))
    wanted = save(met.select("key").distinct())
    found = docs.select("text").mapInArrow(_line_texts(_bloom(wanted, "key"), least), "key long, line binary")
    texts = save(found.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("line").alias("line")))
    first = met.where("key <> a").select("a", F.col("key").alias("b")).distinct()
    pairs = first.join(texts.select(F.col("key").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("key").alias("b"), F.col("line").alias("lb")), "b")
    linked = save(pairs.select("a", "b", "la", "lb").mapInArrow(_verified, "a long, b long"))
    parts = connected_components(linked).select(F.col("node").alias("key"), "component")
    part = save(wanted.join(parts, "key", "left").select("key", F.coalesce("component", "key").alias("part")))
    placed = save(met.select("band", "key").join(part, "key").join(texts.select("key", F.octet_length("line").alias("size")), "key"))
    joined = connected_components(save(_cells(placed, texts).mapInArrow(_linked_cells, "a long, b long")))
    grouped = wanted.join(part, "key").join(joined, F.col("part") == joined.node, "left").select("key", F.coalesce("component", "part").alias("class"))
    whole = save(signed.select("key", "n").join(grouped, "key", "left").where("n > 1 or class is not null").select("key", F.coalesce("class", "key").alias("class")))
    for done in (signed, buckets, met, wanted, texts, linked, part, placed):
        drop_saved(done)
    return lines.select("doc_id", "doc_key", "line_no", "key"), whole


def _drops(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, doc_key, n, marks): of each document that has lines to drop, their number, and a byte for each line up to the
    last of them, `1` where it goes: so that a line is looked up in constant time. The first line of a class, by doc_id
    (null last), then text hash and number, stays."""
    lines, named = classes(docs, least)
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "doc_key", "line_no")
    met = save(lines.join(named, "key").select("class", place.alias("place")))
    keep = save(met.groupBy("class").agg(F.min("place").alias("keep")))  # a plain exchange, so that Spark can split a hot class
    gone = met.join(keep, "class").where(~F.col("place").eqNullSafe(F.col("keep"))).select("place.doc_id", "place.doc_key", "place.line_no")
    listed = gone.groupBy("doc_id", "doc_key").agg(F.sort_array(F.collect_set("line_no")).alias("drops"))
    before = F.concat(F.array(F.lit(-1).cast(gone.schema["line_no"].dataType)), F.slice("drops", 1, F.size("drops") - 1))
    marks = F.array_join(F.zip_with("drops", before, lambda d, b: F.concat(F.repeat(F.lit("0"), (d - b - 1).cast("int")), F.lit("1"))), "").cast("binary")
    out = save(listed.select("doc_id", "doc_key", F.size("drops").alias("n"), marks.alias("marks")))
    for done in (lines, named, met, keep):
        drop_saved(done)
    return out


def dedup_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with all their columns, `text` without the lines that near-repeat an earlier one, and n_lines, n_dropped.

    Lines part at \\n and are compared by their characters, A-Z lower-cased and white space as one space; lines of fewer
    than `least` characters (8 at least, one shingle) stay. A null text stays null, an empty one empty; a document may end
    up empty but its row stays. Repeated rows of one id and text count as one document and get the same text; of equal lines
    the first by doc_id stays. Lines of any length are compared whole. A column n_lines or n_dropped is replaced."""
    theirs, ours, of, n, marks = fresh(docs, "id", "key", "of", "n", "marks")
    found = _drops(docs, least).toDF(theirs, ours, n, marks)
    base = docs.drop("n_lines", "n_dropped").withColumn(of, _key(F.col("text")))
    met = base.join(found, F.col("doc_id").eqNullSafe(F.col(theirs)) & (F.col(of) == F.col(ours)), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: F.substring(marks, i + 1, F.lit(1)) != F.lit(b"1")), "\n")
    whole = F.col(n).isNull()
    columns = [F.when(whole, F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in base.columns if c != of]
    return met.select(*columns, F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"), F.when(whole, 0).otherwise(F.col(n)).cast("long").alias("n_dropped"))


def without_repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of docs with their own columns alone, the text deduplicated; n_chars, where there is one, follows it."""
    out = dedup_lines(docs, least)
    changed = F.col("n_dropped") > 0
    return out.select(*[F.when(changed, F.char_length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
