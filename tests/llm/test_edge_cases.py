"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import time

import pytest
from pyspark.sql import functions as F

from inkfold.llm import decontaminate, embeddings, html, linededup, lm, pieces, pii, quality, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, score string, ids string, fp string"
LONG = " ".join(f"w{i % 997}" for i in range(60_000))
CLASH = (7, "a", "b", "c")


def rows():
    texts = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, ""), (3, None), (None, "eight nine ten"), (None, None), (4, LONG), (5, "\n\n \t"), (6, "one two three four five six seven")]
    return [(i, t, None, "s", None, *CLASH) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 1), (None, 1, 1), (6, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "TWO three"), (1, None), (2, ""), (None, "eight"), (3, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")


def outcome(df):
    return sorted(map(repr, df.collect()))


def test_decontamination(docs, none, items):
    got = decontaminate.contamination(docs, items).collect()
    assert len(got) == 9
    by = {(r.doc_id, r.n_words): r for r in got}
    assert by[1, 7].n_hit == 2 and by[1, 7]["items"] == ["1"]
    assert by[None, 3].n_hit == 1 and by[None, 3]["items"] == []
    assert by[4, 60_000]["items"] == ["3"] and by[4, 60_000].n_hit == 12 * 60 + (12 if 60_000 % 997 >= 12 else 0)
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.clean(docs, items).columns == docs.columns and decontaminate.clean(docs, items).count() == 4


def test_quality_and_toxicity(docs, none, labels):
    for m in (quality, toxicity):
        for some in (labels, labels.limit(0)):
            out = m.scored(docs, m.fit(docs, some))
            assert out.count() == 9 and out.where("score between 0 and 1").count() == 9
            assert dict(out.dtypes)["score"] == "double" and set(out.columns) == set(docs.columns)
            assert out.where("text like 'one%'").select("score").distinct().count() == 1
        assert m.scored(none, m.fit(none, labels)).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_simhash(docs, none):
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == 8 and got[1, next(f for d, f in got if d == 1)] == 1
    assert {c for (d, f), c in got.items() if d in (2, 3, 5)} == {2} and got[None, 0] == 2
    assert {c for (d, f), c in got.items() if d == 6} == {1}
    assert simhash.near_duplicates(docs).count() == 9 and simhash.near_duplicates(none).count() == 0
    assert simhash.one_of_each(docs).columns == docs.columns
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in simhash.one_of_each(docs).collect()) == [(0, 14), (1, 33), (1, 33), (2, 0), (4, len(LONG))]


def test_lines(docs, none):
    out = linededup.dedup_lines(docs)
    assert out.count() == 9 and linededup.dedup_lines(none).count() == 0
    assert {r.text for r in out.where("doc_id = 6").collect()} == {""} and out.where("doc_id = 1 and text like 'one%'").count() == 2
    assert linededup.without_repeated_lines(docs).columns == docs.columns
    assert out.where("doc_id = 3 and text is null").count() == 1


def test_pieces(docs, none):
    out = pieces.encode(docs)
    assert out.count() == 9 and out.where("round_trip").count() == 9 and dict(out.dtypes)["ids"] == "array<int>"
    assert pieces.encode(none).count() == 0
    back = pieces.decode(out.drop("text"))
    assert outcome(back.select("doc_id", "text")) == outcome(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def test_language_model(docs, none):
    out = lm.scored(docs)
    assert out.count() == 9 and lm.scored(none).count() == 0
    assert sorted(r.doc_id or 0 for r in out.where("n_tokens = 1").collect()) == [0, 2, 3, 5]  # empty, null or white space: one end
    assert out.where("score <= 0 and base_score <= 0").count() == 9
    assert {r.held_out for r in lm.scored(docs.where("doc_id = 4")).collect()} <= {True, False}


def test_html(spark):
    page = "<html><body><nav><a href=/>Menu</a></nav><article><h1>T &amp; t</h1><p>First  text, here.<p>Second <b>bold</b>er text.</article><footer>Foot</footer>"
    deep = "<div>" * 3000 + "<p>deep text that is long enough to be read as content, surely.</p>"
    df = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", " \n", "x"), (4, "u", "<p" * 1000, "x"), (5, "u", deep, "x"), (6, "u", "<script>var a='<p>';</script>", "x")], "page_id long, url string, html string, text string")
    got = html.extracted(df).collect()
    assert len(got) == 8 and [r.text for r in got if r.page_id == 1] == ["T & t\n\nFirst text, here.\n\nSecond bolder text."] * 2
    assert all(r.n_chars == len(r.text) for r in got) and {r.text for r in got if r.page_id in (2, 3, None, 6)} == {""}
    assert html.extracted(df.limit(0)).count() == 0


def test_other_operators_ignore_clashing_columns(spark, docs):
    assert pii.personal_data(docs).count() == 9
    kind = "vec_id long, embedding array<float>, label int, node long, vector string, key string"
    assert embeddings.near_duplicates(spark.createDataFrame([(1, [1.0, 2.0], 1, 5, "v", "k")], kind)).first().kept


def test_columns_that_clash_in_another_case_stay(spark):
    docs = spark.createDataFrame([(k, "a plain text of several words " * 3, 5.0, [1], True) for k in range(6)], "doc_id long, text string, Score double, Ids array<int>, Round_Trip boolean")
    marks = spark.createDataFrame([(k, k % 2, 0) for k in range(6)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, marks, threshold=0.0)
    assert kept.columns == docs.columns and [r.Score for r in kept.collect()] == [5.0] * 6
    coded = pieces.encode(docs)
    assert coded.columns == ["doc_id", "text", "Score", "ids", "n_tokens", "round_trip"] and len(coded.select("ids").first()[0]) > 3
    scored = quality.scored(docs, quality.fit(docs, marks))
    assert scored.columns == ["doc_id", "text", "Ids", "Round_Trip", "score"] and scored.select("score").count() == 6


def test_many_equal_lines_of_one_text_take_linear_time(spark):
    line = "the very same line of a text again and again"
    took = []
    for n in (20_000, 40_000):
        df = spark.createDataFrame([(1, "\n".join([line] * n) + "\nshort"), (2, line)], "doc_id long, text string")
        start = time.time()
        found = {r.doc_id: r for r in linededup.dedup_lines(df).collect()}
        took.append(time.time() - start)
        assert found[1].text == line + "\nshort" and (found[1].n_lines, found[1].n_dropped) == (n + 1, n - 1) and found[2].text == ""
    assert took[1] < 3 * took[0] + 5
