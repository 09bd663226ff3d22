"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, extended, fresh, labelled, slices, table, text_buffer, with_columns

#: Bytes of a passage; the last of a text may be shorter.
PASSAGE = 512
#: Labelled documents that the model is fitted on, at most, and the bytes of their texts together, at most: the driver holds
#: about twice these bytes of features.
MAX_LABELLED, TRAIN_BYTES = 4000, 32_000_000
#: Passages that are encoded at once (32 kB of counters each), and the bytes of a piece of a longer text.
AT_ONCE, PIECE = 1024, 512 * PASSAGE
CLASSES, HASHED, HIDDEN, ATTENTION, EPOCHS = 12, 128, 32, 16, 40
WIDTH = CLASSES * CLASSES + HASHED + 6
THRESHOLD = 0.3


def _class_table() -> np.ndarray:
    """Byte classes: control, newline, space, digit, upper, lower vowel, lower consonant, comma and stop, other marks,
    brackets and bars, symbols, beyond ASCII."""
    kind = np.full(256, 11, np.uint8)
    kind[:32] = 0
    kind[127] = 0
    for chars, k in (("\n", 1), (" \t", 2), ("0123456789", 3), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4), ("aeiou", 5), ("bcdfghjklmnpqrstvwxyz", 6), (",.", 7), ("!?;:'\"-", 8), ("()[]{}<>|/\\_", 9), ("#$%&*+=@^`~", 10)):
        kind[np.frombuffer(chars.encode(), np.uint8)] = k
    return kind


_KIND = _class_table()


def encode(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the texts, and the number of passages of each text (1 for an empty one).

    A passage's features: shares of byte-class pairs, shares of hashed byte triples, distinct and repeated triples, words
    that equal one of the two before them, its length, and whether it is empty."""
    lengths = np.diff(offsets)
    counts = np.maximum(1, -(-lengths // PASSAGE))
    total, first = int(counts.sum()), np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(lengths)), lengths)
    passage = first[owner] + (np.arange(len(raw)) - offsets[owner]) // PASSAGE
    kinds = _KIND[raw].astype(np.int64)
    out = np.zeros((total, WIDTH), np.float32)
    size = np.bincount(passage, minlength=total).astype(np.float32)
    norm = np.maximum(size, 1)[:, None]
    if len(raw) > 1:
        pair = passage[1:] * (CLASSES * CLASSES) + kinds[:-1] * CLASSES + kinds[1:]
        same = passage[1:] == passage[:-1]
        out[:, : CLASSES * CLASSES] = np.bincount(pair[same], minlength=total * CLASSES * CLASSES).reshape(total, -1) / norm
    if len(raw) > 2:
        wide = raw.astype(np.uint32)
        triple = ((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761)) >> np.uint32(20)
        same = passage[2:] == passage[:-2]
        code = passage[2:] * 4096 + triple
        held = np.bincount(code[same], minlength=total * 4096).reshape(total, 4096)
        out[:, CLASSES * CLASSES : -6] = held.reshape(total, HASHED, -1).sum(2) / norm
        out[:, -6] = (held > 0).sum(1) / norm[:, 0]
        out[:, -5] = (held > 2).sum(1) / norm[:, 0]
    before = np.concatenate([[0], kinds[:-1]])[: len(raw)]
    before[offsets[:-1][lengths > 0]] = 0  # no word runs from one text into the next
    begins = np.nonzero((kinds > 2) & (before <= 2))[0]
    if len(begins) > 2:
        within = np.arange(len(raw)) - np.repeat(np.concatenate([[0], begins]), np.diff(np.concatenate([[0], begins, [len(raw)]])))
        letters = np.where((kinds == 5) | (kinds == 6) | (kinds == 4) | (kinds == 11), raw | np.uint8(32), 0).astype(np.int64)
        word = np.add.reduceat(letters * (within * within + 7 * within + 3), begins)
        for k in (1, 2):
            again = (word[k:] == word[:-k]) & (word[k:] != 0) & (owner[begins[k:]] == owner[begins[:-k]])
            out[:, -5 + k] = np.bincount(passage[begins[k:]][again], minlength=total) * 6 / norm[:, 0]
    out[:, -2] = size / PASSAGE
    out[:, -1] = size == 0
    return np.sqrt(out), counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def passages(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of the texts' passages and the number of the text of each, a bounded group at a time. A text longer than PIECE
    is encoded piece by piece."""
    cuts = [(a, min(a + PIECE, offsets[i + 1]), i) for i in range(len(offsets) - 1) for a in range(offsets[i], max(offsets[i + 1], offsets[i] + 1), PIECE)]
    begin = 0
    while begin < len(cuts):
        end, held = begin, 0
        while end < len(cuts) and (end == begin or held + (cuts[end][1] - cuts[end][0]) // PASSAGE + 1 <= AT_ONCE):
            held += (cuts[end][1] - cuts[end][0]) // PASSAGE + 1
            end += 1
        at = np.array([c[0] for c in cuts[begin:end]] + [cuts[end - 1][1]], np.int64)
        x, counts = encode(raw[at[0] : at[-1]], at - at[0])
        yield x, np.repeat(np.array([c[2] for c in cuts[begin:end]]), counts)
        begin = end


def _hidden(p: dict[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    """Each passage's hidden representation and its gated attention before the softmax."""
    pre = ((x - p["mean"]) * p["scale"]) @ p["W"] + p["b"]
    h = np.maximum(pre, 0)
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    return {"pre": pre, "h": h, "t": t, "g": g, "e": (t * g) @ p["w"]}


def _forward(p: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Encoder, gated attention over each document's passages, and the score of the weighted passage representation."""
    starts, of = np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)
    s = _hidden(p, x)
    e = np.exp(s["e"] - np.maximum.reduceat(s["e"], starts)[of])
    a = e / np.add.reduceat(e, starts)[of]
    z = np.add.reduceat(a[:, None] * s["h"], starts)
    return s | {"of": of, "starts": starts, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}


def scores(p: dict[str, np.ndarray], raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Score of each text, 0 to 1, to six digits in double precision, so that it does not depend on the texts beside it. The
    softmax over a text's passages is summed up group by group."""
    p, n = {k: np.asarray(v, np.float64) for k, v in p.items()}, len(offsets) - 1
    top, total, z = np.full(n, -np.inf), np.zeros(n), np.zeros((n, HIDDEN))
    for x, of in passages(raw, offsets):
        s = _hidden(p, x)
        most = top.copy()
        np.maximum.at(most, of, s["e"])
        ease = np.where(np.isfinite(top), np.exp(np.where(np.isfinite(top), top, 0) - np.where(np.isfinite(most), most, 0)), 0)
        a = np.exp(s["e"] - most[of])
        total, z, top = total * ease, z * ease[:, None], most
        np.add.at(total, of, a)
        np.add.at(z, of, a[:, None] * s["h"])
    return np.round(_sigmoid(z / np.maximum(total, 1e-300)[:, None] @ p["c"] + p["d"]), 6)


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit by Adam on the documents' log loss. With no texts the scores are a half."""
    rng = np.random.default_rng(seed)
    p = {"W": rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.2, (HIDDEN, ATTENTION)), "U": rng.normal(0, 0.2, (HIDDEN, ATTENTION)), "w": rng.normal(0, 0.2, ATTENTION), "c": rng.normal(0, 0.2, HIDDEN), "d": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()} | {"mean": np.zeros(WIDTH, np.float32), "scale": np.ones(WIDTH, np.float32)}
    if not texts:
        return p | {"c": np.zeros(HIDDEN, np.float32)}
    parts = [list(passages(np.frombuffer(t, np.uint8), np.array([0, len(t)]))) for t in texts]
    counts, x = np.array([sum(len(of) for _, of in part) for part in parts]), np.concatenate([f for part in parts for f, _ in part])
    p["mean"], p["scale"] = x.mean(0), 1 / (x.std(0) + 0.02)
    first, free = np.cumsum(counts) - counts, [k for k in p if k not in ("mean", "scale")]
    moment, square, step = {k: np.zeros_like(p[k]) for k in free}, {k: np.zeros_like(p[k]) for k in free}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            rows = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in some])
            s = _forward(p, x[rows], counts[some])
            of, h, a = s["of"], s["h"], s["a"]
            ds = ((s["score"] - labels[some]) / len(some)).astype(np.float32)
            dz = ds[:, None] * p["c"]
            da = (dz[of] * h).sum(1)
            de = a * (da - np.add.reduceat(a * da, s["starts"])[of])
            dt, dg = de[:, None] * p["w"] * s["g"] * (1 - s["t"] ** 2), de[:, None] * p["w"] * s["t"] * s["g"] * (1 - s["g"])
            dh = (a[:, None] * dz[of] + dt @ p["V"].T + dg @ p["U"].T) * (s["pre"] > 0)
            scaled = (x[rows] - p["mean"]) * p["scale"]
            grads = {"W": scaled.T @ dh + 1e-4 * p["W"], "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (s["t"] * s["g"]).T @ de, "c": s["z"].T @ ds, "d": ds.sum(keepdims=True)}
            step += 1
            for k in free:
                moment[k] = 0.9 * moment[k] + 0.1 * grads[k]
                square[k] = 0.999 * square[k] + 0.001 * grads[k] ** 2
                rate = 3e-3 * (1 - epoch / epochs)
                p[k] = (p[k] - rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED) -> dict[str, np.ndarray]:
    """Train on a bounded sample of labelled documents; see common.labelled."""
    return train(*labelled(docs, labels, label, most, TRAIN_BYTES))


def scored(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """docs with all their columns and `score` (replaced if there is one). A null text is an empty text; every text is
    scored whole, in bounded memory; equal texts score alike, and each of repeated rows is scored; a column of any other
    name stays; no rows give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 50 KB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1_000_000):
                yield with_columns(batch, score=pa.array(scores(shared.value, *text_buffer(batch.column("text"))), pa.float64()))

    return docs.mapInArrow(score, extended(docs, score="double"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their own columns alone, that score the threshold or more."""
    (mark,) = fresh(docs, "mark")
    given = docs.withColumnRenamed("score", mark)
    kept = scored(given, fit(docs, labels)).where(F.col("score") >= threshold)
    return kept.select(*[F.col(f"`{mark}`").alias(c) if c.lower() == "score" else F.col(f"`{c}`") for c in docs.columns])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
