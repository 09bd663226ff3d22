"""Toxicity by compression distance: the windows of a text are compressed with a dictionary of ordinary text and with one
of toxic text, and the differences of the lengths are calibrated to a score."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, extended, labelled, slices, table, text_buffer, with_columns

#: Labelled documents that the dictionaries and thresholds are fitted on, at most, and the bytes of their texts together, at
#: most. The ordinary dictionary is trained on TRAIN_WINDOWS of their windows, drawn at random.
MAX_LABELLED, TRAIN_BYTES, TRAIN_WINDOWS = 6000, 32_000_000, 20_000
WINDOW, STEP, LEVEL, DICTIONARY = 96, 64, 6, 16_384
THRESHOLD = 0.5
#: A word beginning is toxic if it is in this many toxic documents, and so many times as frequent as in ordinary ones.
LEAST_DOCS, LEAST_RATIO = 8, 8
_BETWEEN, _WORD, _GAP = re.compile(rb"[^a-z\x80-\xff]+"), re.compile(rb"[a-z\x80-\xff]+"), b"  "


def normal(text: bytes) -> bytes:
    """A-Z lower-cased; two spaces before each word, so that a match of a word's beginning outweighs one inside a word."""
    return _BETWEEN.sub(_GAP, b" " + text.lower())


def windows(text: bytes) -> list[bytes]:
    """Overlapping windows that cover the whole text; one empty window of an empty text."""
    return [text[i : i + WINDOW] for i in range(0, max(1, len(text) - WINDOW + STEP), STEP)]


def window_groups(text: bytes, at_once: int = 50_000) -> Iterator[list[bytes]]:
    """The windows of a text of any length, a bounded number at a time."""
    last = max(1, len(text) - WINDOW + STEP)
    for at in range(0, last, STEP * at_once):
        yield [text[i : i + WINDOW] for i in range(at, min(last, at + STEP * at_once), STEP)]


def _distinct(texts: list[bytes]) -> list[int]:
    """Positions of the texts that share none of 8 minima of word shingles with an earlier one."""
    seen: set[tuple[int, int]] = set()
    keep = []
    for i, text in enumerate(texts):
        w = text.split()
        h = np.array([xxhash.xxh3_64_intdigest(b" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))], np.uint64)
        mine = [(k, int((h * np.uint64(2 * k + 1) * np.uint64(0x9E3779B97F4A7C15)).min())) for k in range(8)]
        if not any(m in seen for m in mine):
            keep.append(i)
        seen.update(mine)
    return keep


def toxic_stems(texts: list[bytes], labels: np.ndarray) -> list[bytes]:
    """Beginnings of words that set toxic texts apart from ordinary ones, the most frequent first."""
    tokens, docs, words, n = [Counter(), Counter()], [Counter(), Counter()], [0, 0], [0, 0]
    for i in _distinct(texts):
        side, counts, begun = int(labels[i]), Counter(_WORD.findall(texts[i])), Counter()
        for w, m in counts.items():
            for k in range(4, min(len(w), 12) + 1):
                begun[w[:k]] += m
        size = sum(counts.values())
        words[side] += size
        n[side] += 1
        for p, m in begun.items():
            tokens[side][p] += min(m, 3 + size // 50)
            docs[side][p] += 1
    if not n[0] or not n[1]:
        return []
    fine = {p for p, d in docs[1].items() if d >= LEAST_DOCS and tokens[1][p] / words[1] >= LEAST_RATIO * (tokens[0][p] + 1) / words[0] and d / n[1] >= LEAST_RATIO / 2 * (docs[0][p] + 1) / n[0]}
    longer: dict[bytes, list[bytes]] = {}
    for p in fine:
        longer.setdefault(p[:-1], []).append(p)
    out = set()
    for p in fine:
        if not any(p[:k] in fine for k in range(4, len(p))):
            while more := [q for q in longer.get(p, []) if tokens[1][q] >= 0.7 * tokens[1][p]]:
                p = max(more, key=lambda q: (tokens[1][q], q))
            out.add(p)
    return sorted(out, key=lambda p: (-tokens[1][p], p))


def _dictionary(samples: list[bytes]) -> bytes:
    """Content that zstandard trains on the samples; of too few samples, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


class Scorer:
    """Both dictionaries and the calibrated weights."""

    def __init__(self, model: dict):
        self.model = model
        self.press = []
        for content in (model["ordinary"], model["toxic"] + model["ordinary"]):
            held = zstandard.ZstdCompressionDict(content or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.press.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def features(self, texts: list[bytes]) -> np.ndarray:
        """How many windows are shorter under the toxic dictionary, by how much, and how many windows there are."""
        ordinary, toxic = self.press
        out = np.zeros((len(texts), 21))
        for i, text in enumerate(texts):
            d = np.concatenate([np.array([len(ordinary(w)) - len(toxic(w)) for w in cut], np.int64) for cut in window_groups(normal(text))])
            n = len(d)
            k = np.array([(d >= h).sum() for h in range(1, 7)] + [(d <= -h).sum() for h in (1, 2)])
            gain = np.maximum(d, 0).sum()
            out[i] = [*np.log1p(k), *np.log((k + 0.5) / (n + 2)), np.log(n), d.max() / 4, gain / n, d.sum() / n, np.sqrt(gain)]
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        m = self.model
        x = np.c_[(self.features(texts) - m["mean"]) / m["scale"], np.ones(len(texts))] @ m["weights"]
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 5) -> dict:
    """The model. Weights are fitted by Newton steps; the intercept moves so that the score 0.5 is where F1 on the training
    documents is best. Without texts every score is close to 0; without toxic texts too."""
    texts = [t.lower() for t in texts]
    rng, cut = np.random.default_rng(seed), [w for t, y in zip(texts, labels, strict=True) if y == 0 for w in windows(normal(t))]
    model = {"ordinary": _dictionary([cut[i] for i in rng.permutation(len(cut))[:TRAIN_WINDOWS]]), "toxic": b"".join(_GAP + s for s in reversed(toxic_stems(texts, labels)))}
    model |= {"mean": np.zeros(21), "scale": np.ones(21), "weights": np.concatenate([np.zeros(21), [-5.0]])}
    if not len(texts) or labels.min() == labels.max():
        return model | ({"weights": np.concatenate([np.zeros(21), [5.0]])} if len(texts) and labels.min() > 0 else {})
    x = Scorer(model).features(texts)
    model |= {"mean": x.mean(0), "scale": x.std(0) + 1e-6}
    a, w = np.c_[(x - model["mean"]) / model["scale"], np.ones(len(x))], np.zeros(22)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 0.3 * np.eye(22), a.T @ (p - labels) + 0.3 * w)
    z = a @ w
    order = np.argsort(-z, kind="stable")
    caught = np.cumsum(labels[order])
    f1 = 2 * caught / (np.arange(1, len(z) + 1) + labels.sum())
    best = int(np.argmax(f1))
    w[-1] -= (z[order[best]] + z[order[min(best + 1, len(z) - 1)]]) / 2
    return model | {"weights": w}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_LABELLED) -> dict:
    """Train on a bounded sample of labelled documents; see common.labelled."""
    return train(*labelled(docs, labels, label, most, TRAIN_BYTES))


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """docs with all their columns and `score` (replaced if there is one). A null text is an empty text; every text is
    scored whole; equal texts score alike, and each of repeated rows is scored; no rows give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 20 KB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, at = text_buffer(batch.column("text"))
                data = raw.tobytes()
                yield with_columns(batch, score=pa.array(scorer.scores([data[at[i] : at[i + 1]] for i in range(batch.num_rows)]), pa.float64()))

    return docs.mapInArrow(score, extended(docs, score="double"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
