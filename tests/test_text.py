"""Scalar functions: values derived by hand, and properties."""

import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkfold.functions import text as t
from inkfold.operators import search
from inkfold.schema import EXTRACTED

GOLDEN = {
    "phone": [("（０４６５）８１－５８７７", "0465-81-5877"), ("+81-3-1234-5678", "03-1234-5678"), ("+81 (0)3-1234-5678", "0-3-1234-5678"), ("81-1234", "01234"), ("03 1234 5678 内線12", "03-1234-5678-12"), (None, ""), ("", "")],
    "address": [("朝日町一丁目五三番一号", "朝日町1丁目53番1号"), ("一番町", "一番町"), ("三田", "三田"), ("四谷", "四谷"), (None, "")],
    "company": [("株式会社ABC", "株式会社 ABC"), ("ABC株式会社", "ABC 株式会社"), ("株式会社", "株式会社"), (None, "")],
    "kana_field": [("ヤマダ　タロウ", "やまだ たろう"), ("YAMADA", ""), (None, "")],
    "tags": [("#a, b、a\n c  d", "a, b, c d"), (None, ""), (" , ", "")],
    "search_query": [("/search 山田", "山田"), ("検索　山田", "山田"), ("S x", "x"), ("search x", "search x"), ("  s s x ", "s x")],
}


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_golden(spark, name):
    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(GOLDEN[name])], "i int, v string")
    got = {r.i: r.x for r in rows.select("i", getattr(t, name)(F.col("v")).alias("x")).collect()}
    assert [got[i] for i in range(len(GOLDEN[name]))] == [w for _, w in GOLDEN[name]]


@pytest.mark.parametrize(("number", "value"), [("五三", 53), ("十", 10), ("二十三", 23), ("千二百", 1200), ("一万二千", 12000), ("〇五", 5), ("二十万", 210000), ("千万", 10010000), ("", None), ("x", None)])
def test_kanji_numbers(number, value):
    assert t.kanji_number(number) == value


def test_strict_kanji_numbers():
    assert [t.kanji_number(x, strict=True) for x in ("二十万", "千万", "一万二千", "万")] == [200000, 10000000, 12000, 10000]


def test_variants():
    assert search.variants("ｶﾅ") == ["ｶﾅ", "カナ", "かな"]
    assert search.variants(" 　") == []
    assert len(search.variants("ｶ ナ")) <= 9


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet=t.KATAKANA, max_size=20))
def test_kana_round_trip(s):
    assert s.translate(str.maketrans(t.KATAKANA, t.HIRAGANA)).translate(str.maketrans(t.HIRAGANA, t.KATAKANA)) == s


def test_normalisers_are_idempotent(spark):
    rows = spark.createDataFrame([(x,) for x in ["株式会社ABC", " a,#b ,, c", "ヤマダ タロウ", "+81 3 12", "81-81", "（株）x 株式会社", None]], "v string")
    for f in (t.company, t.tags, t.kana_field, t.phone, t.collapsed):
        once = rows.select(f(F.col("v")).alias("v"))
        assert [r.v for r in once.select(f(F.col("v")).alias("v")).collect()] == [r.v for r in once.collect()], f.__name__


def test_like_agrees_with_sqlite(spark):
    values = ["abc", "ABC", "É", "é", "a%b", "a_b", "a\\b", "a　b", "", None, "x"]
    con = sqlite3.connect(":memory:")
    for needle in ["abc", "AbC", "é", "%", "_", "a_b", "\\", "a\\", "B", "%b_"]:
        want = [con.execute("select ? like ?", (v, f"%{needle}%")).fetchone()[0] for v in values]
        got = [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(search.like(F.col("v"), needle).cast("int").alias("x")).collect()]
        assert got == want, needle


def test_search_of_white_space_filters_nothing(spark):
    cards = spark.createDataFrame([{"id": "1", "created_at": "2024", "person_name": "山 田", "status": "ready"}], "id string, created_at string, person_name string, status string")
    find = lambda q: search.search(cards, q, fields=["person_name"]).count()
    assert (find("　 "), find("山田"), find("x"), find(None)) == (1, 1, 0, 1)


def test_variant_text(spark):
    row = spark.sql("""select parse_json('{"a": " x ", "b": [1], "c": {"k": 1}, "d": 2}') v, parse_json(null) n""")
    got = row.select(*[t.string_or_empty(F.try_variant_get("v", f"$.{k}", "variant")).alias(k) for k in "abcde"], t.string_or_empty(F.col("n")).alias("n")).first()
    assert tuple(got) == ("x", "[1]", '{"k":1}', "2", "", "")
    assert len(EXTRACTED) == 12


def plain_kanji(number):
    """One digit after another, with three sums: the stored reading that must be kept."""
    if not any(ch in t.UNITS for ch in number):
        return int("".join(str(t.DIGITS[ch]) for ch in number))
    units = {u: n for u, n in t.UNITS.items() if u != "万"}
    total, group, digit = 0, 0, 0
    for ch in number:
        if ch in units:
            group, digit = group + units[ch] * (digit or 1), 0
        elif ch == "万":
            total, group, digit = total + 10000 * (group + (digit or 1)), 0, 0
        else:
            digit = t.DIGITS[ch]
    return total + group + digit


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="".join(t.DIGITS) + "".join(t.UNITS) * 3, min_size=1, max_size=9))
def test_kanji_numbers_of_any_order(number):
    assert t.kanji_number(number) == plain_kanji(number)
