"""Divergence of sources against plain Python, and its edge cases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkfold.llm import divergence as M

FORM = "text string, lang string, source string"


def brute(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = term.findall((text or "").translate(low))
        groups[lang].add(source)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= least}
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = lambda n, m, v=len(kept): 1 + 10**9 * (n + 2) // (m + 2 * v)
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        p = {(s, t): share(counts[lang, s][t], total[s]) for s in sources for t in kept}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = sorted((-sum(gap(p[s, t], p[o, t]) for t in kept), o.encode()) for o in sources - {s})
            terms = sorted((-gap(p[s, t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s, t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(found)]
    return sorted(out)


def answer(spark, rows, least=3, top=4):
    return sorted(map(tuple, M.divergence(spark.createDataFrame(rows, FORM), least, top).collect()))


def test_equals_plain_python_whatever_the_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["the", "The", "Ärger", "ärger", "x1y", "漢字", "don't", "a" * 300, "é-b", "z", "ZZ", "\x7f", "_q"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 12))), str(rng.choice(["en", "de", ""])), str(rng.choice(["hot", "hot", "hot", "s1", "s2", "ß"]))) for _ in range(300)]
    rows += [(None, "en", "s9"), ("", "xx", "only"), ("a b", None, None), ("the the", "en", None), ("one off", "lone", "p"), ("", "lone", "q")] + [("same text the", "de", "copy")] * 40
    want = brute(rows, 3, 4)
    assert answer(spark, rows) == want
    monkeypatch.setattr(M, "CELLS", 5)  # a block for each term or two
    block = M._Block("x", ["a", "b"], [10, 20], 2)
    assert block.add("t", ["a"], [1]) is False and block.add("u", ["b"], [1]) is False and block.add("v", ["b"], [1]) is True


def test_runs_that_cross_batches_and_many_sources(spark):
    rows = [("shared word", "en", f"s{k:04d}") for k in range(60)] * 3
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert answer(spark, rows) == brute(rows, 3, 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_small_blocks_give_the_same(spark):
    form = "lang string, term string, part int, terms long, sources array<string>, counts array<long>"
    head = ("en", "", 0, 3, ["a", "b"], [4, 5])
    terms = [("en", t, 0, 0, s, c) for t, s, c in (("x", ["a"], [3]), ("y", ["a", "b"], [1, 2]), ("z", ["b"], [3]))]
    batch = lambda rows: spark.createDataFrame(rows, form).coalesce(1).toArrow().to_batches()[0]
    whole = [r for b in M._compared(9)(iter([batch([head, *terms])])) for r in b.to_pylist()]
    cut = [r for b in M._compared(9)(iter([batch([head, terms[0]]), batch(terms[1:])])) for r in b.to_pylist()]
    assert whole == cut and sum(r["part"] == "pair" for r in whole) == 2 + 2


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    counts, totals = rng.integers(0, 9 * 10**14, 50), rng.integers(9 * 10**14, 9 * 10**15, 50)
    for c, n in zip(counts.tolist(), totals.tolist(), strict=True):
        assert int(M.shares(np.array([c]), n, 12345)[0]) == 1 + 10**9 * (c + 2) // (n + 2 * 12345)
    assert int(M.shares(np.array([0]), 0, 1)[0]) == 1 + 10**9


def test_empty_table_and_clashing_columns(spark):
    assert answer(spark, []) == []
    rows = [("one two", "en", "a"), ("one", "en", "b"), ("one", "en", "b")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], FORM + ", term int, n int, Part int")
    assert sorted(map(tuple, M.divergence(df, 3, 4).collect())) == brute(rows, 3, 4)


@pytest.mark.parametrize("n", [40_000])
def test_one_long_text(spark, n):
    rows = [(" ".join(f"w{'abcdefghij'[k % 10]}{'é' * (k % 7)}" for k in range(n)), "en", s) for s in ("a", "b", "b")]
    assert answer(spark, rows) == brute(rows, 3, 4)
