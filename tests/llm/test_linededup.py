"""Line deduplication against all pairs of lines."""

import random

import numpy as np

from inkfold.llm import linededup as L


def compared(line):
    return " ".join("".join(c.lower() if c.isascii() else c for c in line).replace("\t", " ").split(" ")).strip()


def grams(line):
    return {line[i : i + 8] for i in range(len(line) - 7)}


def jaccard(x, y):
    p, q = grams(x), grams(y)
    return len(p & q) / len(p | q)


def brute(rows, banded, least=L.LEAST):
    """Kept text of each document: all pairs of distinct lines (if banded, those that share a band), union-find by hand."""
    form = lambda line: " ".join(x for x in compared(line).split(" ") if x)
    places = [(i, k, form(line)) for i, text in rows for k, line in enumerate((text or "").split("\n")) if len(form(line)) >= least]
    distinct = sorted({x for _, _, x in places})
    signed = L.bands([x.encode() for x in distinct])
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(distinct):
        for j in range(i):
            if (not banded or (signed[i] == signed[j]).any()) and jaccard(x, distinct[j]) >= 0.8:
                root[find(x)] = find(distinct[j])
    seen, drop = set(), set()
    for i, k, x in sorted(places):
        if find(x) in seen:
            drop.add((i, k))
        seen.add(find(x))
    return {i: None if text is None else "\n".join(line for k, line in enumerate(text.split("\n")) if (i, k) not in drop) for i, text in rows}


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeéoßu日本語") for _ in range(rng.randint(2, 9)))
    bases = [" ".join(word() for _ in range(rng.randint(6, 30))) for _ in range(40)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = rng.choice(bases).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = word()
            lines.append(rng.choice([" ", "  ", "\t"]).join(words) if rng.random() < 0.3 else " ".join(words).upper() if rng.random() < 0.1 else " ".join(words))
        rows.append((i, "\n".join(lines + ["Short one.", ""] * rng.randint(0, 1))))
    rows += [(200, None), (201, ""), (202, "これは長い日本語の一行であり、空白を一つも含まないが、重複は除かれるべきである。"), (203, "これは長い日本語の一行であり、空白を一つも含まないが、重複は除かれるべきである。")]
    return rows


def test_texts_are_those_of_all_banded_pairs(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, banded=True)
    for lines, size in ((L.CELL_LINES, L.CELL_BYTES), (3, 200)):  # buckets in one cell, and dealt over many
        monkeypatch.setattr(L, "CELL_LINES", lines)
        monkeypatch.setattr(L, "CELL_BYTES", size)
        got = {r.doc_id: r.text for r in L.dedup_lines(df).collect()}
        assert got == want
    assert got[203] == "" and got[200] is None and sum(len(x or "") for x in want.values()) < 0.7 * sum(len(x or "") for _, x in rows)
    every = brute(rows, banded=False)
    assert sum(every[i] == want[i] for i in every) >= 0.97 * len(rows)


def test_recall_of_the_bands():
    rng = np.random.default_rng(3)
    met, n = 0, 0
    while n < 1500:
        x = "".join(rng.choice(list("abcdefgh "), 260))
        y = list(x)
        for at in rng.integers(0, 260, 4):
            y[at] = "z"
        y = "".join(y)
        if 0.8 <= jaccard(x, y) <= 0.84:
            a, b = L.bands([x.encode(), y.encode()])
            met, n = met + bool((a == b).any()), n + 1
    assert met / n > 0.97


def test_long_lines_are_compared_whole(spark, monkeypatch):
    x = "".join(chr(97 + (i * i * 7 + i // 13) % 26) for i in range(30_000))
    near, far = x[:14_000] + "ZZZZ" + x[14_004:], x[:15_000] + x[:15_000][::-1]
    lines = [t.lower().encode() for t in (x, near, far)]
    signed = L.bands(lines)
    monkeypatch.setattr(L, "PIECE", 4_000)
    assert (L.bands(lines) == signed).all()
    assert L.similar(lines[0], lines[1]) and not L.similar(lines[0], lines[2])
    rows = [(1, x), (2, near), (3, far)]
    got = {r.doc_id: len(r.text) for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 30_000, 2: 0, 3: 30_000}


def test_hashes_do_not_depend_on_the_lines_beside():
    lines = ["plain ascii line of words", "ligne accentuée très ordinaire", "行の中の文字は何でもよいのです。本当に、そうなのです。"]
    alone = [L.bands([x.encode()])[0] for x in lines]
    assert (L.bands([x.encode() for x in lines]) == np.array(alone)).all()


def test_clashing_columns(spark):
    kind = "doc_id long, text string, drops string, _id string, _key string, _of string, n_lines string"
    line = "a line that is long enough to be compared"
    got = L.dedup_lines(spark.createDataFrame([(1, line, "a", "b", "c", "d", "e"), (2, line, "a", "b", "c", "d", "e")], kind))
    assert {(r.doc_id, r.text, r.drops, r["_id"], r.n_dropped) for r in got.collect()} == {(1, line, "a", "b", 0), (2, "", "a", "b", 1)}
    assert L.without_repeated_lines(spark.createDataFrame([], kind)).count() == 0


def test_small_and_large_cells_give_the_same_links(monkeypatch):
    rng = random.Random(8)
    for _ in range(60):
        base = "".join(rng.choice("abcdefg ") for _ in range(120))
        lines = [(base[: rng.randint(60, 120)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 12)))).encode() for _ in range(rng.randint(1, 5))]
        parts, left = np.array([rng.randint(1, 3) for _ in lines]), np.array([rng.random() < 0.6 for _ in lines])
        found = []
        for few in (0, 1000):
            monkeypatch.setattr(L, "FEW_PAIRS", few)
            found.append(L.linked_parts(lines, parts, left))
        assert found[0] == found[1]
