"""Language-model scores by deleted interpolation: bigram, unigram and uniform estimates, mixed by how often the context was
seen, with weights that expectation-maximisation learns on held-out counts.

Documents are dealt into chunks of a bounded size. Each chunk asks for the counts of its distinct n-grams: sorted 64-bit
hashes, parted by their high bits into buckets. A bucket's task sums the counts of all chunks and answers each of them in
its own order. So a frequent n-gram costs a row for each chunk, not for each occurrence, and no count is dropped."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, save, slices, table, text_buffer

#: Bytes of text of a chunk, and about how many distinct n-grams of all chunks one bucket sums.
CHUNK, BUCKET = 6_000_000, 400_000
#: Context-frequency buckets: 0, 1, 2-3, 4-7, ... occurrences.
CONTEXTS = 40
ROUNDS, BINS_A_UNIT = 60, 16
_MARK = lambda b: np.uint64(xxhash.xxh3_64_intdigest(b))
#: Words hold no white space, so these are no word's hashes.
END, START = _MARK(b"\n"), _MARK(b"\n\n")
_ODD, _UP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def unpack(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk: its documents, the hashes of its distinct words, and its tokens as places among them. Documents that
    EM is held out on are chunks of their own."""
    for whole in batches:
        for batch in slices(whole, "text", CHUNK):
            raw, at = text_buffer(batch.column("text"))
            data, part = raw.tobytes(), batch.column("part").to_numpy()
            for tuning in (False, True):
                rows = np.nonzero((part == 2) == tuning)[0]
                if not len(rows):
                    continue
                index: dict[bytes, int] = {b"\n": 0}
                lists = [np.array([index.setdefault(w, len(index)) for w in data[at[i] : at[i + 1]].lower().split()] + [0], np.uint32) for i in rows]
                words = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index))
                tokens = np.concatenate(lists)
                sizes = np.array([len(x) for x in lists], np.int64)
                ids = batch.column("doc_id").take(pa.array(rows))
                as_list = lambda x: pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), x)
                chunk = xxhash.xxh3_64_intdigest(pack(words) + pack(tokens) + repr(ids.to_pylist()).encode()) >> 1
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([tuning]), as_list(ids), as_list(pa.array(part[rows])), as_list(pa.array(sizes)), pa.array([len(tokens)], pa.int64()), pa.array([pack(words)], pa.binary()), pa.array([pack(tokens)], pa.binary())], names=["chunk", "tuning", "ids", "parts", "sizes", "n", "words", "tokens"])


class Chunk:
    """The distinct n-grams of a chunk, in order of their hashes, and where each token finds its own."""

    def __init__(self, row: dict):
        self.sizes, self.part = np.array(row["sizes"], np.int64), np.array(row["parts"], np.int32)
        words, tokens = unpack(row["words"], np.uint64), unpack(row["tokens"], np.uint32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        first = np.cumsum(self.sizes) - self.sizes
        before = np.concatenate([[0], tokens[:-1]])
        before[first] = len(words)  # each text begins behind START
        hashes = np.concatenate([words, [START]])
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.one, self.word, self.context = hashes[order], place[tokens], place[before]
        code, inverse = np.unique(before * len(words) + tokens, return_inverse=True)
        two = (hashes[code // len(words)] * _ODD ^ (hashes[code % len(words)] + np.uint64(1)) * _UP) * _ODD
        two ^= two >> np.uint64(29)
        order = np.argsort(two)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.two, self.pair = two[order], place[inverse]

    def counts(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each n-gram: occurrences in training documents, and in those among them that EM is held out on."""
        keys, at, of = (self.one, self.word, self.part[self.doc]) if order == 1 else (self.two, self.pair, self.part[self.doc])
        out = [np.bincount(at[of >= k], minlength=len(keys)) for k in (1, 2)]
        if order == 1:
            start = int(np.searchsorted(self.one, START))
            for k in (1, 2):
                out[k - 1][start] = (self.part >= k).sum()
        return out[0].astype(np.uint32), out[1].astype(np.uint32)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one by one, so that one chunk at a time is unpacked."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def _asked(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                chunk, out = Chunk(row), []
                for order, keys in ((1, chunk.one), (2, chunk.two)):
                    every, tuning = chunk.counts(order)
                    bounds = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else np.array([0, len(keys)])
                    for bucket in np.nonzero(np.diff(bounds))[0].tolist():
                        a, b = bounds[bucket], bounds[bucket + 1]
                        out.append((row["chunk"], order, bucket, pack(np.diff(keys[a:b], prepend=np.uint64(0))), pack(every[a:b]), pack(tuning[a:b])))
                yield pa.RecordBatch.from_pylist([dict(zip(("chunk", "gram", "bucket", "keys", "every", "tuning"), x, strict=True)) for x in out], schema=_ASKED)

    return run


_ASKED = pa.schema([("chunk", pa.int64()), ("gram", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("every", pa.binary()), ("tuning", pa.binary())])
_ANSWER = "chunk long, gram int, bucket int, every binary, tuning binary, n_every long, v_every long, n_main long, v_main long"


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    """One bucket: total counts for each chunk's n-grams, and the bucket's share of tokens and distinct tokens."""
    group = group.sort_values("chunk")
    keys = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in group["keys"]]
    names, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    every, tuning = (np.bincount(inverse, np.concatenate([unpack(x, np.uint32) for x in group[c]]), len(names)).astype(np.uint32) for c in ("every", "tuning"))
    ends = np.cumsum([len(k) for k in keys])
    token = (names != START) & (group["gram"].iloc[0] == 1)
    main = every - tuning
    sums = [int(every[token].sum(dtype=np.int64)), int((every[token] > 0).sum()), int(main[token].sum(dtype=np.int64)), int((main[token] > 0).sum())]
    rows = []
    for k, (chunk, end) in enumerate(zip(group["chunk"], ends, strict=True)):
        mine = inverse[end - len(keys[k]) : end]
        rows.append((chunk, group["gram"].iloc[0], group["bucket"].iloc[0], pack(every[mine]), pack(tuning[mine]), *(sums if k == 0 else [0] * 4)))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _ANSWER.split(", ")])


def _answered(row: dict) -> tuple[Chunk, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """A chunk and, for each order, the corpus counts of its n-grams (all training, held out for EM), in its own order."""
    chunk, got = Chunk(row), {1: [], 2: []}
    for a in sorted(row["answers"], key=lambda a: (a["gram"], a["bucket"])):
        got[a["gram"]].append((unpack(a["every"], np.uint32), unpack(a["tuning"], np.uint32)))
    return chunk, {k: tuple(np.concatenate([x[i] for x in v]).astype(np.int64) for i in range(2)) for k, v in got.items()}


def _unigram(c: np.ndarray, n: int, v: int, share: float) -> np.ndarray:
    """Unigram maximum likelihood mixed with a uniform estimate over the known tokens and one unknown."""
    return share * c / max(n, 1) + (1 - share) / (v + 1) if n else np.full(len(c), 1 / (v + 1))


def _context(c: np.ndarray) -> np.ndarray:
    """Context-frequency bucket of a count."""
    return np.minimum(np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))).astype(np.int64) + 1, 0), CONTEXTS - 1)


def _ratios(share: float | None, n: int, v: int):
    """Held-out tokens by context bucket and rounded log ratio of the higher estimate to the lower one (none: it is 0), under
    the counts that leave out the held-out documents. share None: unigram against uniform, all in bucket 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                chunk, got = _answered(row)
                one, two = (got[k][0] - got[k][1] for k in (1, 2))
                if share is None:
                    bucket, high, low = np.zeros(len(chunk.word), np.int64), one[chunk.word] / max(n, 1), np.full(len(chunk.word), 1 / (v + 1))
                else:
                    seen = one[chunk.context]
                    bucket, high, low = _context(seen), two[chunk.pair] / np.maximum(seen, 1), _unigram(one, n, v, share)[chunk.word]
                step = np.where(high > 0, np.rint(np.log(np.maximum(high, 1e-300) / low) * BINS_A_UNIT), -(10**6)).astype(np.int64)
                code, counts = np.unique(bucket * 4_000_000 + step + 2_000_000, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code // 4_000_000), pa.array(code % 4_000_000 - 2_000_000), pa.array(counts)], names=["context", "step", "n"])

    return run


def mixture(steps: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> float:
    """EM for the weight of the higher estimate: it moves to the mean posterior that the higher one made the token. One token
    of either kind is added, so that the weight stays inside 0 and 1."""
    ratio, weight = np.where(steps == -(10**6), 0.0, np.exp(steps / BINS_A_UNIT)), 0.5
    for _ in range(rounds):
        weight = float((counts * (weight * ratio / (weight * ratio + 1 - weight))).sum() + 1) / (counts.sum() + 2)
    return weight


def _scores(model: dict):
    n, v, share = model["n"], model["v"], model["share"]
    weights = np.array(model["weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            for k, row in enumerate(_rows(batch)):
                chunk, got = _answered(row)
                one, two = got[1][0], got[2][0]
                c = one[chunk.word]
                base = np.log10((one + 0.5) / (n + 0.5 * (v + 1)))[chunk.word]
                seen = one[chunk.context]
                w = np.where(seen > 0, weights[_context(seen)], 0.0)
                p = w * two[chunk.pair] / np.maximum(seen, 1) + (1 - w) * _unigram(one, n, v, share)[chunk.word]
                add = lambda x, d=chunk.doc, m=len(chunk.sizes): np.bincount(d, x, m)
                yield pa.RecordBatch.from_arrays([ids[k].values, pa.array(chunk.part == 0), pa.array(chunk.sizes), pa.array(add(c > 0).astype(np.int64)), pa.array(np.full(len(chunk.sizes), n)), pa.array(add(base)), pa.array(add(np.log10(p)))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def scored(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs (doc_id, text).

    Tokens: A-Z lower-cased words, then one end. Documents whose crc32 bucket of 5 is 1 are held out of training; of the
    others those whose bucket of 25 is 2 are left out while EM fits the weights, and counted in the end. A null or empty
    text is one end; a null id counts as empty text for the buckets; repeated rows count and are scored each; other columns
    are ignored; no rows give no rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held, tuned = crc_bucket(F.col("doc_id"), 5) == 1, crc_bucket(F.col("doc_id"), 25) == 2
    rows = docs.select("doc_id", "text", F.when(held, 0).when(tuned, 2).otherwise(1).alias("part"))
    form = f"chunk long, tuning boolean, ids array<{kind}>, parts array<int>, sizes array<long>, n long, words binary, tokens binary"
    chunks = rows.mapInArrow(_chunks, form)
    chunks = save(chunks.withColumn("chunk", F.xxhash64("chunk", F.spark_partition_id(), F.monotonically_increasing_id())))
    total = chunks.agg(F.sum("n")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total / BUCKET))))
    asked = chunks.mapInArrow(_asked(bits), "chunk long, gram int, bucket int, keys binary, every binary, tuning binary")
    answers = save(asked.groupBy("gram", "bucket").applyInPandas(_summed, _ANSWER))
    s = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_every", "v_every", "n_main", "v_main")]).first()
    listed = answers.select("chunk", F.struct("gram", "bucket", "every", "tuning").alias("a"))

    def met(some: DataFrame) -> DataFrame:
        wanted = some.select("chunk")
        grouped = (listed if some is chunks else listed.join(wanted, "chunk", "left_semi")).groupBy("chunk").agg(F.collect_list("a").alias("answers"))
        return some.join(grouped, "chunk")

    def counted(share: float | None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        found = met(chunks.where("tuning")).mapInArrow(_ratios(share, s.n_main, s.v_main), "context long, step long, n long").groupBy("context", "step").agg(F.sum("n").alias("n")).toArrow()
        c, step, n = (found[x].to_numpy() for x in ("context", "step", "n"))
        return {int(k): (step[c == k], n[c == k]) for k in np.unique(c)}

    share = mixture(*counted(None).get(0, (np.zeros(0), np.zeros(0))))
    learned = {k: mixture(*x) for k, x in counted(share).items() if k and x[1].sum() >= 50}
    near = lambda k: learned[min(learned, key=lambda j: (abs(j - k), j))] if learned else 0.5
    model = {"n": int(s.n_every), "v": int(s.v_every), "share": share, "weights": [near(k) for k in range(CONTEXTS)]}
    return met(chunks).mapInArrow(_scores(model), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
