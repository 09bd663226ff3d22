"""Personal data against plain regular expressions."""

import hashlib
import random
import re
import time

import regex

from inkfold.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def fine(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(PLAIN[k], text or "") if fine(k, m[0])]


def texts():
    rng = random.Random(3)
    bits = ["a@b.co", "@", ".", "x", "_", "1", "12", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-0100", "+", " ", "-", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "é", "😀", "\n", "0000000000000", "(", ")", "c_d@e.f", "%", "999", "日"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    return [*out, "", None, "a@b.c_d@e.f", "9" * 20_000, "a" * 20_000, "1.1." * 3000, "+1 " * 2000, "a@b.co 10.0.0.1 " * 700, "a@b.co " * 256, "a@b.co " * 257, "mail bob (at) site (dot) com now", "call (020) 7946-0958", "١٢٣٤٥٦٧٨٩٠١٢٣"]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rows = list(enumerate(texts()))
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r["spans"] for r in found}
    for i, text in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in by[i] if s["base"]] == brute(text), text


def test_wider_spans_are_those_that_meet_no_base_span(spark):
    rng = random.Random(5)
    bits = ["bob (at) site (dot) com", "a@b.co", "a [at] b.org", " ", " ", ", ", "4111 1111 1111 1111", "1234.5678.1234.5678", "020 7946 0958", "(020) 7946-0958", "+44 20 7946 0958", "1:2:3:4:5:6:7:8", "10.0.0.1", "555-123-4567", "x", "é😀"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(900, ""), (901, None), (902, "bob (at) site (dot) com " * 300)]
    keyed = pii.base_spans(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("key", pii.F.xxhash64("text"))
    got = {(r.doc_id, r.kind, r.start, r.end) for r in pii.candidates(keyed).where("not base").collect()}
    want = set()
    for i, text in rows:
        base = brute(text)
        for k in pii.KINDS:
            for m in regex.finditer(pii.WIDER[k], text or ""):
                if regex.search(pii.HINTS[k], text) and not any(s < m.end() and m.start() < e for _, s, e in base):
                    want.add((i, k, m.start(), m.end()))
    assert got == want and len(want) > 300


def test_wider_spans_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "mail bob (at) site (dot) com now", 5)] * 2 + [(None, "a@b.com", 1), (None, None, 2)], "doc_id long, text string, key long")
    found = pii.personal_data(df).collect()
    assert sorted(len(r["spans"]) for r in found) == [0, 1, 1, 1]
    assert {(s["kind"], s["base"]) for r in found if r["doc_id"] == 1 for s in r["spans"]} == {("email", False)}


def test_every_text_is_read_once(spark):
    df = spark.createDataFrame([(1, "mail bob (at) site (dot) com now")], "doc_id long, text string")
    plan = pii.candidates(pii.base_spans(df).withColumn("key", pii.F.xxhash64("text")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("{1,%d}" % pii.PIECE) == 1  # the pieces that contexts are cut from
    assert plan.count("regexp_extract_all") == 2 * len(pii.KINDS) + 1


def test_empty_table(spark):
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_reliabilities_find_the_better_labeler():
    counts = [((1, 1, 1, -1, -1), 400), ((0, 0, 0, -1, 0), 300), ((1, 0, 1, -1, -1), 20), ((0, 1, 0, -1, 0), 60)]
    share, votes, posterior = pii.reliabilities(counts)
    assert 0.4 < share < 0.7 and posterior[0] > 0.9 > 0.1 > posterior[1]
    assert votes[0][0][2] > votes[1][0][2] - 0.2


def test_query_digest(spark, tmp_path):
    spark.createDataFrame([(7, "x a@b.com 10.0.0.1")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = pii.op10_pii(spark, str(tmp_path)).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 0, 0)
    assert row.base_sha256 == hashlib.sha256(b"email:2:9,ip:10:18").hexdigest() and row.spans == "email:2:9,ip:10:18"


def test_contexts_are_the_characters_beside_a_span(spark):
    """Contexts are cut from pieces of a text; a word that decides a vote counts wherever a piece ends."""
    texts = ["é" * k + " phone 020 7946 0958 😀" for k in range(980, 1030)] + ["x" * k + " 020 7946 0958 phone" for k in range(1000, 1015)]
    keyed = pii.base_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumn("key", pii.F.xxhash64("text"))
    rows = pii.candidates(keyed).where("not base").collect()
    assert len(rows) == len(texts) and all(r.context == 1 for r in rows)


def test_cost_grows_with_the_text(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, " ".join(f"ab{i}@x.org" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        assert pii.candidates(pii.base_spans(docs).withColumn("key", pii.F.xxhash64("text"))).count() == n
        return time.time() - began

    seconds(100)
    small = seconds(10_000)
    assert seconds(40_000) < 6 * small + 5
