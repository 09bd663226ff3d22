"""SentencePiece ids against the model's own library."""

import random

import pytest
import sentencepiece

from inkfold.llm import pieces as P


@pytest.fixture(scope="module")
def tables():
    return P.load()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def ids(encoder, texts):
    flat, at = encoder.encode([t.encode() for t in texts])
    return [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def fuzz(n, seed=4):
    rng = random.Random(seed)
    bits = ["the ", "tokenization", " ", "  ", "     ", "\n", "\n\n", "é", "日本語", "東京都", "😀", "aaaa", "ing", "Ünï", "!?", "123", "\t", "x", "\x00", "word", " a", "ст", "नम", "ar"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_ids_are_the_librarys(tables, library):
    texts = [t.replace("\x00", "") for t in fuzz(1500)] + ["", " ", "a"]
    assert ids(P.Encoder(tables), texts) == [library.encode(t) for t in texts]


@pytest.mark.parametrize("batch", [37, 400])
def test_long_texts_are_cut_where_ids_do_not_change(tables, library, monkeypatch, batch):
    monkeypatch.setattr(P, "BATCH", batch)
    monkeypatch.setattr(P, "_LONG_UNIT", 20)
    rng = random.Random(1)
    texts = [t.replace("\x00", "") * 3 for t in fuzz(80, 9)]
    texts += ["".join(rng.choice("abcdehilnorst") for _ in range(3000)), "日本語の文は空白を含まない。" * 100, "é" * 500, "a" * 700, "x" + " " * 300 + "y", "internationalization" * 60]
    for t in texts:
        assert ids(P.Encoder(tables), [t, "next text"]) == [library.encode(t), library.encode("next text")], t[:80]


def test_suffix_ranges_are_all_occurrences(tables):
    encoder = P.Encoder(tables)
    text = b"the theory of the three thermal things in internationalization"
    begin, piece = encoder._edges(text + b"\0")
    want = sorted((i, k) for k, p in enumerate(tables["pieces"]) for i in range(len(text)) if text.startswith(p, i))
    assert sorted(zip(begin.tolist(), piece.tolist(), strict=True)) == want


def test_decoding_nulls_ties_and_clashing_columns(spark):
    kind = "doc_id long, text string, ids string, n_tokens string, round_trip string, piece int"
    rows = [(1, "one  two", "a", "b", "c", 3)] * 2 + [(2, None, None, None, None, 4), (None, "", "a", "b", "c", 5)]
    out = P.encode(spark.createDataFrame(rows, kind))
    assert sorted(out.columns) == sorted(kind.replace(",", "").split(" ")[::2]) and out.where("round_trip").count() == 4
    assert out.where("doc_id = 1").select("ids").distinct().count() == 1
    back = P.decode(spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")).collect()
    assert {(r.k, r.text) for r in back} == {(1, None), (2, "")}
