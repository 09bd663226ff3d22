"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tokens of either tokenizer are the two sides of a bipartite graph, joined where their byte ranges overlap. Union-find gives its
connected components, which are exactly the minimal groups. Texts are cut into units where neither tokenizer has a token
across the cut, so that a unit's graph is solved once in a chunk of texts. Pairs of ids are counted by document with plain
grouping and joined back to the chunks that hold them."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, slices, table, text_buffer
from .lm import pack, unpack

TOKENIZER_A, TOKENIZER_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text of a chunk: its distinct pairs of ids are one request each.
CHUNK = 6_000_000
#: A pair of ids is one number: the A id times this, plus the B id.
WIDE = 1 << 20
#: A unit begins before a space or newline that stands between two other characters: no pre-token of A holds a white space behind
#: another character, and no piece of B does.
#: Fixed value: the pre-tokens of a byte-level vocabulary. Units of more characters are left to the library that does not recurse.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 10_000
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_TOKENIZERS: dict[str, Tokenizers] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if it is a visible Latin-1
    character, and else the next one from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, loaded from the contents of their files, and the bytes of every id."""

    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        import tiktoken
        import tokenizers

        self.slow_a = tokenizers.Tokenizer.from_str(a)
        self.slow_a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        letters, special = byte_alphabet(), {t.content for t in self.slow_a.get_added_tokens_decoder().values()}
        vocabulary = {t: i for t, i in self.slow_a.get_vocab().items() if t not in special}
        self.bytes_a = {i: bytes([letters[c] for c in t]) for t, i in vocabulary.items()}
        merges = json.loads(a)["model"]["merges"]
        at = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        if at != sorted(at):
            raise ValueError("the ids of A do not follow the order of its merges")
        self.quick_a = tiktoken.Encoding("a", pat_str=PRE_TOKENS, mergeable_ranks={x: i for i, x in self.bytes_a.items()}, special_tokens={})
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.vocab_size())]
        self.size_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.space = self.b.piece_to_id("▁")

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A ids and B ids of each unit. Units begin with a space, which B adds itself, or with a newline, before which B's own
        space is taken away again. Short units take the quicker of two libraries that give A's ids."""
        quick, slow = self.quick_a.encode_ordinary, self.slow_a.encode
        of_a = [quick(u) if len(u) <= LONG else slow(u, add_special_tokens=False).ids for u in units]
        of_b = self.b.encode([u[1:] if u[:1] == " " else u for u in units], num_threads=1)
        return of_a, [b if u[:1] == " " else b[1:] if b[:1] == [self.space] else [] for u, b in zip(units, of_b, strict=True)]

    def given_back(self, units: list[str], of_a: list[list[int]], of_b: list[list[int]]) -> np.ndarray:
        """Whether the tokens of either side are the unit's bytes: of all units together if that holds, and else of each."""
        raw, fine = [u.encode() for u in units], np.ones(len(units), bool)
        for side, names in ((of_a, self.bytes_a), (of_b, self.bytes_b)):
            told = [b"".join([names[i] for i in x]) for x in side]
            if told != raw:
                fine &= np.array([x == u for x, u in zip(told, raw, strict=True)], bool)
        return fine


def components(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Union-find over n nodes and the edges (x, y): each node's root, the smallest node of its component. All edges hook the
    larger root below the smaller one, then paths are halved until every node points at its root."""
    parent = np.arange(n)
    while len(x):
        a, b = parent[x], parent[y]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        apart = parent[x] != parent[y]
        x, y = x[apart], y[apart]
    return parent


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an A and a B token whose byte ranges overlap. Between two neighbouring ends of either side lies one such overlap."""
    ends = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


class Units:
    """Distinct units of a chunk, aligned together: tokens, groups and links of unit k lie at at_x[k]:at_x[k + 1]."""

    def __init__(self, tools: Tokenizers, units: list[str]):
        coded = tools.encode(units)
        self.fine = tools.given_back(units, *coded)
        if not self.fine.all():
            coded = tuple([x if fine else [] for x, fine in zip(side, self.fine.tolist(), strict=True)] for side in coded)
        a, b = (np.fromiter(chain.from_iterable(side), np.int64) for side in coded)
        self.at_a, self.at_b = (np.concatenate([[0], np.cumsum(np.fromiter(map(len, side), np.int64, len(side)))]) for side in coded)
        ends = lambda ids, sizes: np.cumsum(sizes[ids])
        left, right = overlaps(ends(a, tools.size_a), ends(b, tools.size_b))
        root = components(left, len(a) + right, len(a) + len(b))
        roots, group = np.unique(root, return_inverse=True)
        group_a, group_b = group[: len(a)], group[len(a) :]
        unit_of_group = np.searchsorted(self.at_a, roots, "right") - 1  # a root is the first A token of its component
        self.at_group = np.searchsorted(unit_of_group, np.arange(len(units) + 1))
        self.pairs, self.link = np.unique(a[left] * WIDE + b[right], return_inverse=True)
        self.at_link = np.searchsorted(left, self.at_a)
        self.text = self._texts(a, b, group_a, group_b, len(roots))

    def _texts(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, groups: int) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each unit: all tokens in order of group and side, each with the mark behind it, as one string
        that is cut at the units' ends."""
        ids, side = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        order = np.argsort(np.concatenate([group_a, group_b]) * 2 + side, kind="stable")
        ids, side, group = ids[order], side[order], np.concatenate([group_a, group_b])[order]
        last = (np.diff(group, append=groups) != 0) | (np.diff(side, append=0) != 0)
        marks = np.where(last, side + 1, 0)
        whole = "".join(chain.from_iterable(zip(map(str, ids.tolist()), map(",|;".__getitem__, marks.tolist()), strict=True)))
        ends = np.concatenate([[0], np.cumsum(np.searchsorted(10 ** np.arange(1, 19), ids, "right") + 2)])
        at = ends[np.searchsorted(group, self.at_group)].tolist()
        return [whole[i : j - 1] if j > i else "" for i, j in zip(at[:-1], at[1:], strict=True)]


def spread(at: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of picked sets, set k's being at[k]:at[k + 1]: for each the place in `picked`, and the member."""
    sizes = at[picked + 1] - at[picked]
    of = np.repeat(np.arange(len(picked)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(at[picked], sizes)


def packed(x: np.ndarray) -> bytes:
    """32-bit numbers, compressed; nothing for none."""
    return pack(x) if len(x) else b""


def unpacked(raw: bytes) -> np.ndarray:
    return unpack(raw, np.uint32) if raw else np.zeros(0, np.uint32)


_LISTS = "pairs array<long>, docs array<int>"


def _chunks(a: str, b: bytes, kind: pa.DataType):
    """Rows of documents, with what they need of their chunk's pairs, and one row of a chunk with its distinct pairs and the number
    of its documents that hold each."""
    form = pa.schema([("chunk", pa.int64()), ("doc_id", kind), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("held", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha256(a.encode() + b).hexdigest()
        tools = _TOKENIZERS[key] = _TOKENIZERS.get(key) or Tokenizers(a, b)
        for whole in batches:
            for batch in slices(whole, "text", CHUNK):
                raw, at = text_buffer(batch.column("text"))
                data, index = raw.tobytes(), {}
                texts = [_CUT.split(" " + data[at[i] : at[i + 1]].decode()) if at[i + 1] > at[i] else [] for i in range(batch.num_rows)]
                used = [np.array([index.setdefault(u, len(index)) for u in t], np.int64) for t in texts]
                del texts, data
                units = Units(tools, list(index))
                used = [u if units.fine[u].all() else u[:0] for u in used]
                sizes = np.array([len(u) for u in used], np.int64)
                code, n = np.unique(np.repeat(np.arange(len(used)), sizes) * len(index) + np.concatenate([*used, np.zeros(0, np.int64)]), return_counts=True)
                doc, unit = code // max(1, len(index)), code % max(1, len(index))
                sums = [np.bincount(doc, np.diff(x)[unit] * n, len(used)).astype(np.int64) for x in (units.at_a, units.at_b, units.at_group, units.at_link)]
                of, link = spread(units.at_link, unit)
                code, place = np.unique(doc[of] * len(units.pairs) + units.link[link], return_inverse=True)
                times = np.bincount(place, n[of], len(code)).astype(np.uint32)
                doc, pair = code // max(1, len(units.pairs)), code % max(1, len(units.pairs))
                held, pair, counted = np.unique(pair, return_inverse=True, return_counts=True)
                at = np.searchsorted(doc, np.arange(len(used) + 1)).tolist()
                parts = [(pair[i:j].astype(np.uint32), times[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
                texts = units.text
                digests = [hashlib.sha256(";".join([texts[k] for k in u.tolist()]).encode()).hexdigest() if len(u) else "" for u in used]
                none: list = [None] * len(used)
                columns = [batch.column("doc_id").to_pylist(), *[x.tolist() for x in sums], digests, [packed(np.diff(p, prepend=np.uint32(0))) for p, _ in parts], [packed(t) for _, t in parts], none, none]
                chunk, end = uuid.uuid4().int >> 65, [None] * 8 + [units.pairs[held], counted]
                rows = [[chunk] * (len(used) + 1), *[[*c, e] for c, e in zip(columns, end, strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, form, strict=True)], schema=form)

    return run


def _answered(kind: pa.DataType):
    """Documents sorted behind their chunk's row, which has the corpus counts of the chunk's pairs in order."""
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    form = pa.schema([(n, kind if n == "doc_id" else pa.string() if n == "groups_sha256" else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best, chunk = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            rows = []
            columns = [batch.column(n) for n in ("n_a", "n_b", "n_groups", "n_links", "doc_id", "groups_sha256", "held", "times")]
            for k, (of, head) in enumerate(zip(batch.column("chunk").to_pylist(), batch.column("head").to_pylist(), strict=True)):
                if head:
                    got = batch.column("answers")[k].values
                    chunk, order = of, np.argsort(got.field("place").to_numpy())
                    count, best = (got.field(n).to_numpy()[order] for n in ("count", "best"))
                    continue
                n_a, n_b, n_groups, n_links, doc, text, held, times = (c[k].as_py() for c in columns)
                at, times = np.cumsum(unpacked(held)), unpacked(times).astype(np.int64)
                if len(at) and of != chunk:
                    raise ValueError("a document came before the counts of its chunk")
                rows.append((doc, n_a, n_b, n_groups, n_links, int(times @ best[at]), int(times @ count[at]), text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), form, strict=True)], schema=form)

    return run


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents two ids are linked, and 1 if none of the A id's pairs is in more. An A id has
    at most as many pairs as B has ids."""
    total = chunks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", 20)))
    return total.withColumn("best", (F.col("count") == most).cast("long"))


def _files(a: str, b: str) -> tuple[str, bytes]:
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:  # on the driver; tasks get the contents, a few MB each
        return f.read(), g.read()


def aligned(docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs (doc_id, text).

    A encodes a space and the text, B the text, to which it adds the space. A text that is null or empty, or that either side's
    tokens do not give back byte for byte (U+2581 for B), has no tokens: zeros and an empty digest. Whole texts; a long one is
    a chunk of its own, and a run of characters without space or newline is encoded in one call. Each of repeated rows is a
    document and counts; null ids stay; other columns are ignored; no rows give no rows. Equal counts are all an A id's best."""
    kind = docs.schema["doc_id"].dataType
    arrow, ddl = docs.select("doc_id").limit(0).toArrow().schema.field(0).type, kind.simpleString()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_files(a, b))
    run = lambda batches: _chunks(*shared.value, arrow)(batches)
    form = f"chunk long, doc_id {ddl}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held binary, times binary, {_LISTS}"
    rows = save(docs.select("doc_id", "text").mapInArrow(run, form))
    chunks = rows.where(F.col("pairs").isNotNull()).select("chunk", "pairs", "docs")
    asked = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    answer = F.collect_list(F.struct("place", "count", "best")).alias("answers")
    heads = asked.join(pair_counts(chunks), "pair").groupBy("chunk").agg(answer).select("chunk", F.lit(True).alias("head"), "answers")
    texts = rows.where(F.col("pairs").isNull()).drop("pairs", "docs").withColumn("head", F.lit(False))
    stream = texts.unionByName(heads, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", F.desc("head"))
    return stream.mapInArrow(_answered(arrow), f"doc_id {ddl}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
