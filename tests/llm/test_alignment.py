"""Alignment of two tokenizers against a plain walk over both token lists, and its parts against plain versions."""

import bisect
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkfold.llm import alignment as M

TEXTS = [
    "Hello world, hello tokenizers!", "", None, "   leading and  double   spaces ", "line\nbreak\n\nand\ttabs\r\n", "naïve café 漢字仮名交じり文 🙂🙃", "<|endoftext|> is plain <s> text </s> <0x41>",
    "a▁b has the mark", "x" * 3000, " " * 500, "can't we've I'll it's", "ends in space ", "\nstarts with newline", "a b　 c", "Hello world, hello tokenizers!", "ﬁ ligature é", "\x00\x01 control",
]


def brute(texts):
    a_files, b_files = M._files(M.TOKENIZER_A, M.TOKENIZER_B)
    tools = M.Tokenizers(a_files, b_files)
    rows, links, count = [], [], Counter()
    for t in texts:
        raw = (" " + (t or "")).encode()
        a = tools.slow_a.encode(raw.decode(), add_special_tokens=False).ids if t else []
        b = tools.b.encode(t) if t else []
        if b"".join(tools.bytes_a[i] for i in a) != raw or b"".join(tools.bytes_b[i] for i in b) != raw:
            a, b = [], []
        spans = lambda ids, names: list(zip(np.cumsum([0, *[len(names[i]) for i in ids]])[:-1].tolist(), np.cumsum([len(names[i]) for i in ids]).tolist(), ids, strict=True))
        at_a, at_b = spans(a, tools.bytes_a), spans(b, tools.bytes_b)
        met, j = [], 0
        for s, e, i in at_a:
            while j and at_b[j - 1][1] > s:
                j -= 1
            while j < len(at_b) and at_b[j][0] < e:
                if at_b[j][1] > s:
                    met.append((i, at_b[j][2]))
                j += 1
        cuts = sorted({e for _, e, _ in at_a} & {e for _, e, _ in at_b})
        held = [([], []) for _ in cuts]
        for k, side in enumerate((at_a, at_b)):
            for _, e, i in side:
                held[bisect.bisect_left(cuts, e)][k].append(str(i))
        groups = ["|".join(",".join(side) for side in g) for g in held]
        rows.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
        links.append(met)
        count.update(set(met))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(k, *r[:3], len(m), sum(count[p] == best[p[0]] for p in m), sum(count[p] for p in m), r[3]) for k, (r, m) in enumerate(zip(rows, links, strict=True))]


def test_equals_a_plain_walk(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, M.aligned(df).collect()))
    want = brute(TEXTS)
    assert got == want
    assert want[7][1:] == (0, 0, 0, 0, 0, 0, "")  # U+2581 is not given back
    assert want[0][1:] == want[14][1:]  # repeated rows are alike, and count twice


def test_edge_cases(spark):
    form = "doc_id string, text string, chunk int, Head int, n_a int"
    rows = [(None, "some text", 1, 1, 1), (None, None, 1, 1, 1), ("x", "some text", 2, 2, 2), ("x", "some text", 2, 2, 2)]
    got = M.aligned(spark.createDataFrame(rows, form))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = sorted(map(tuple, got.collect()), key=lambda r: (r[0] is not None, r[1]))
    assert [r[0] for r in found] == [None, None, "x", "x"] and found[2] == found[3] and found[0][1:] == (0, 0, 0, 0, 0, 0, "")
    assert found[2][6] == 3 * found[2][4]  # each link is in three documents
    assert M.aligned(spark.createDataFrame([], form)).collect() == []


@pytest.mark.parametrize("text", ["word " * 60_000, "ab" * 40_000, " \n" * 20_000, "日本語" * 10_000])
def test_long_texts(spark, text):
    assert sorted(map(tuple, M.aligned(spark.createDataFrame([(0, text)], "doc_id long, text string")).collect()))[0][1:4] == brute([text])[0][1:4]


def test_union_find():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (5, 3), (200, 90), (300, 1000)):
        x, y = rng.integers(0, n, m), rng.integers(0, n, m)
        root = M.components(x, y, n)
        want = list(range(n))
        for _ in range(n):
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                want[a] = want[b] = min(want[a], want[b])
        assert root.tolist() == want
    chain = np.arange(9999)
    assert (M.components(chain, chain + 1, 10_000) == 0).all()


def test_byte_alphabet():
    letters = M.byte_alphabet()
    assert sorted(letters.values()) == list(range(256)) and len(letters) == 256 and letters["Ġ"] == 32 and letters["A"] == 65


def test_chunks_do_not_change_results(spark, monkeypatch):
    tools = M._files(M.TOKENIZER_A, M.TOKENIZER_B)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], names=["doc_id", "text"])
    rows = lambda: sorted((r["doc_id"], r["n_a"], r["n_links"], r["groups_sha256"]) for b in M._chunks(*tools, pa.int64())(iter([batch])) for r in b.to_pylist() if r["doc_id"] is not None)
    whole = rows()
    monkeypatch.setattr(M, "CHUNK", 10)
    assert rows() == whole
