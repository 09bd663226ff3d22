"""SimHash, language model, classifiers and the pipeline against plain Python on small tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from inkfold.llm import decontaminate, lm, quality, simhash, toxicity


def words(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")


def tokens(text):
    return [w for w in words(text) if w]


def texts(n, seed=2):
    rng = random.Random(seed)
    pool = ["the", "The", "a", "model", "of", "text", "é", "日本", "count", "data", "spark", "x1"]
    out = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    for k in range(0, n, 3):  # near copies
        w = out[k].split(" ")
        w[rng.randrange(len(w))] = rng.choice(pool)
        out.append(rng.choice([" ", "\n"]).join(w))
    return [*out, *out[:5], None, "", " \t"]


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").repartition(3)


def plain_fingerprint(text):
    w = tokens(text)
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def test_simhash(spark, tmp_path):
    rows = texts(150)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    prints = [plain_fingerprint(t) for t in rows]
    part = components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, str(tmp_path)).collect()}
    assert got == {i: (f"{prints[i]:016x}", part[i]) for i in range(len(rows))}


def test_links_are_all_pairs_within_two_bits(spark):
    rng = random.Random(7)
    some = [rng.getrandbits(64) for _ in range(60)]
    some += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in some] + [x ^ (7 << rng.randrange(60)) for x in some] + [0, 1, 3, 1 << 63, 3 << 62]
    some = sorted(set(some))
    signed = [x - (1 << 64) if x >> 63 else x for x in some]
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {tuple(sorted((signed[i], signed[j]))) for i in range(len(some)) for j in range(i) if (some[i] ^ some[j]).bit_count() <= 2}


def test_fingerprints_of_long_texts_read_in_pieces():
    text = " ".join(random.Random(3).choice(["ab", "c", "def", "é"]) for _ in range(3000)).encode() + b"  end"
    pieces = [w for k, piece in enumerate(simhash.word_pieces(text, 2, 100)) for w in (piece if k == 0 else piece[2:])]
    assert pieces == text.lower().split()
    whole = simhash.fingerprint(text)
    keep, simhash.word_pieces.__defaults__ = simhash.word_pieces.__defaults__, (100,)
    try:
        assert simhash.fingerprint(text) == whole == plain_fingerprint(text.decode())
    finally:
        simhash.word_pieces.__defaults__ = keep


def plain_model(rows):
    """Base scores and scores, with dictionaries and one pass per formula."""
    bucket = lambda i, n: zlib.crc32(str(i).encode()) % n
    part = [0 if bucket(i, 5) == 1 else 2 if bucket(i, 25) == 2 else 1 for i in range(len(rows))]
    docs = [[*tokens(t), "\n"] for t in rows]

    def counts(least, most):
        one, two, start = Counter(), Counter(), 0
        for d, p in zip(docs, part, strict=True):
            if least <= p <= most:
                start += 1
                one.update(d)
                two.update(zip(["\n\n", *d[:-1]], d, strict=True))
        return one, two, start

    def estimates(model, d, share):
        one, two, start = model
        n, v = sum(one.values()), len(one)
        for prev, w in zip(["\n\n", *d[:-1]], d, strict=True):
            seen = start if prev == "\n\n" else one[prev]
            uni = share * one[w] / n + (1 - share) / (v + 1)
            yield seen, two[prev, w] / max(seen, 1), uni, one[w] / n, 1 / (v + 1)

    def em(pairs):
        ratios = Counter(-(10**6) if high <= 0 else int(np.rint(math.log(high / low) * lm.BINS_A_UNIT)) for high, low in pairs)
        weight, total = 0.5, sum(ratios.values())
        for _ in range(lm.ROUNDS):
            post = sum(n * (weight * r / (weight * r + 1 - weight)) for s, n in ratios.items() for r in [0.0 if s == -(10**6) else math.exp(s / lm.BINS_A_UNIT)])
            weight = (post + 1) / (total + 2)
        return weight

    main, held = counts(1, 1), [d for d, p in zip(docs, part, strict=True) if p == 2]
    share = em([(u, low) for d in held for *_, u, low in estimates(main, d, 1.0)])
    by = {}
    for d in held:
        for seen, high, low, _, _ in estimates(main, d, share):
            by.setdefault(0 if seen == 0 else int(math.log2(seen)) + 1, []).append((high, low))
    learned = {k: em(x) for k, x in by.items() if k and len(x) >= 50}
    near = lambda k: learned[min(learned, key=lambda j: (abs(j - k), j))] if learned else 0.5
    full = counts(1, 2)
    n, v = sum(full[0].values()), len(full[0])
    out = {}
    for i, d in enumerate(docs):
        score = 0.0
        for seen, high, low, _, _ in estimates(full, d, share):
            w = near(int(math.log2(seen)) + 1) if seen else 0.0
            score += math.log10(w * high + (1 - w) * low)
        base = sum(math.log10((full[0][w] + 0.5) / (n + 0.5 * (v + 1))) for w in d)
        out[i] = (part[i] == 0, len(d), sum(full[0][w] > 0 for w in d), n, base, score)
    return out


def test_language_model(spark, monkeypatch):
    rows = texts(240, 5)
    want = plain_model(rows)
    for chunk, bucket in ((lm.CHUNK, lm.BUCKET), (700, 60)):  # one chunk and bucket, and many
        monkeypatch.setattr(lm, "CHUNK", chunk)
        monkeypatch.setattr(lm, "BUCKET", bucket)
        got = {r.doc_id: tuple(r)[1:] for r in lm.scored(frame(spark, rows)).collect()}
        assert got.keys() == want.keys()
        for i in want:
            assert got[i][:4] == want[i][:4]
            assert got[i][4:] == pytest.approx(want[i][4:], rel=1e-9)


def attended(p, x):
    """One document's score, passage by passage."""
    sig = lambda z: 1 / (1 + math.exp(-z))
    hidden = [np.maximum(((row - p["mean"]) * p["scale"]) @ p["W"] + p["b"], 0) for row in x]
    e = [float((np.tanh(h @ p["V"]) * (1 / (1 + np.exp(-(h @ p["U"]))))) @ p["w"]) for h in hidden]
    a = [math.exp(k - max(e)) for k in e]
    return sig(float(sum(k / sum(a) * h for k, h in zip(a, hidden, strict=True)) @ p["c"]) + float(p["d"][0]))


def test_quality_scores_do_not_depend_on_the_batch(monkeypatch):
    rng = random.Random(4)
    some = [("".join(rng.choice("abcde fghij. ") for _ in range(n))).encode() for n in (0, 5, 511, 512, 513, 3000, 40)]
    model = quality.train([s * 3 for s in some], np.array([0, 1, 1, 0, 1, 0, 1], np.float32), epochs=3)
    alone = [quality.scores(model, np.frombuffer(s, np.uint8), np.array([0, len(s)]))[0] for s in some]
    raw, at = np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)])
    assert np.allclose(quality.scores(model, raw, at), alone, atol=1e-6)
    monkeypatch.setattr(quality, "AT_ONCE", 2)
    assert np.allclose(quality.scores(model, raw, at), alone, atol=1e-6)
    for s, score in zip(some, alone, strict=True):
        x = np.concatenate([f for f, _ in quality.passages(np.frombuffer(s, np.uint8), np.array([0, len(s)]))])
        assert score == pytest.approx(attended(model, x), abs=1e-5)


def test_toxicity_windows_cover_the_text_and_are_grouped(monkeypatch):
    text = toxicity.normal(b"some words of a text that goes on and on " * 50)
    whole = toxicity.windows(text)
    assert [w for g in toxicity.window_groups(text, 3) for w in g] == whole and sum(len(g) for g in toxicity.window_groups(text)) == len(whole)
    assert toxicity.windows(b"") == [b""] == next(toxicity.window_groups(b""))


def test_samples_are_distinct_and_bounded(spark):
    from inkfold.llm.common import labelled

    docs = spark.createDataFrame([(i, f"text {i} " * 10) for i in range(30) for _ in range(40)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] * 2, "doc_id long, quality int")
    some, marks = labelled(docs, labels, "quality", 4000, 10**9)
    trained = [i for i in range(30) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(some) == sorted((f"text {i} " * 10).encode() for i in trained) and len(marks) == len(trained)
    assert [int(m) for m in marks] == [int(s.split()[1]) % 2 for s in some]
    few, _ = labelled(docs, labels, "quality", 4000, 200)
    assert few == some[: len(few)] and 0 < sum(map(len, few)) <= 200
    assert len(labelled(docs, labels, "quality", 3, 10**9)[0]) == 3


def test_pipeline_keeps_what_each_stage_should_keep(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randint(3, 8)))
    sentence = lambda: " ".join(word() for _ in range(12)).capitalize() + "."
    prose = lambda: "\n".join(" ".join(sentence() for _ in range(3)) for _ in range(4))
    junk = lambda: " ".join(f"{rng.choice('#$%&*')*3}{rng.randint(0, 99)}|" for _ in range(80))
    good, bad = [prose() for _ in range(120)], [junk() for _ in range(120)]
    item, line = " ".join(word() for _ in range(14)), sentence() + " " + sentence()
    rows = list(enumerate(good + bad))
    rows += [(1000, good[3]), (1001, good[5] + "\n" + prose() + "\n" + item.upper() + " and more."), (1002, prose() + "\n" + line), (1003, prose() + "\n" + line.upper())]
    docs = [(i, t, "en", "s", len(t)) for i, t in rows]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, kind).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id: r.text for r in now.collect()}
        assert k == len(corpus_pipeline.STAGES) - 1 or now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(seen["quality"]) == set(range(120)) | {1000, 1001, 1002, 1003}
    assert seen["line_dedup"][1000] == "\n" * 3 or seen["line_dedup"][1000] == ""
    assert seen["line_dedup"][1003].count("\n") == 3 and line in seen["line_dedup"][1002] and good[5] not in seen["line_dedup"][1001]
    assert set(seen["near_duplicates"]) == set(range(120)) | {1000, 1001, 1002, 1003}  # an emptied copy is a text of its own
    assert set(seen["decontamination"]) == set(seen["near_duplicates"]) - {1001}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in now.collect()) and set(seen["encoding"]) == set(seen["decontamination"])
    whole = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == set(seen["encoding"])
    assert decontaminate.contamination(now.select("doc_id", "text"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).where("n_hit > 0").count() == 0
