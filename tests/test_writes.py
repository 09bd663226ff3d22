"""Write operators on small rows."""

import json

import pytest
from pyspark.sql import functions as F

from inkfold.operators import search
from inkfold.operators import writes as w
from inkfold.schema import CARD_IMAGES, CARDS, JOBS, LINE_USERS
from inkfold.sources import models

NOW = "2024-01-01T00:00:00+00:00"


def table(spark, schema, *rows):
    return spark.createDataFrame([{f.name: r.get(f.name, None if f.nullable else "old") for f in schema.fields} for r in rows], schema)


@pytest.fixture(scope="module")
def cards(spark):
    return table(spark, CARDS, {"id": "1", "status": "ready", "ocr_text": "front", "back_ocr_text": "back", "error_message": "e"}, {"id": "2", "status": "ready", "ocr_text": "x"})


def by(df, key="id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_new_cards(spark):
    new = spark.createDataFrame([("c", "p", "s", None, "j")], "card_id string, path string, sha256 string, direction string, job_id string")
    out = w.new_cards(new, NOW)
    assert by(out["cards"])["c"] | {} == {"id": "c", "status": "queued", "original_image_path": "p", "original_sha256": "s", "ocr_direction": "horizontal", "created_at": NOW, "updated_at": NOW}
    assert by(out["card_images"])["c:front"]["side"] == "front" and by(out["jobs"])["j"]["type"] == "process_card"
    for name, schema in (("cards", CARDS), ("card_images", CARD_IMAGES), ("jobs", JOBS)):
        assert set(out[name].columns) <= set(schema.fieldNames())
    ids = [r.id for r in w.job_rows(new.drop("job_id").union(new.drop("job_id")), NOW).collect()]
    assert len(set(ids)) == 2 and all(len(i) == 32 for i in ids)


def test_back_image_voids_results_and_enqueues(spark, cards):
    new = spark.createDataFrame([("1", "p", "s", "auto"), ("9", "p", "s", "auto")], "card_id string, path string, sha256 string, direction string")
    out = w.back_images(cards, new, NOW)
    got = by(out["cards"])
    assert (got["1"]["status"], got["1"]["back_ocr_text"], got["1"]["back_original_image_path"], got["1"]["error_message"], got["1"]["ocr_text"]) == ("queued", None, "p", None, "front")
    assert got["2"] == by(cards)["2"] and len(got) == 2
    jobs = w.enqueued(cards, table(spark, JOBS), spark.createDataFrame([("2", "reextract")], "card_id string, type string"), NOW)
    assert by(jobs["cards"])["2"]["status"] == "queued" and jobs["jobs"].first().type == "reextract"


def test_results_of_sides(spark, cards):
    images = table(spark, CARD_IMAGES, *[{"id": f"1:{s}", "card_id": "1", "side": s} for s in ("front", "back")])
    some = spark.createDataFrame([("1", "back", "t", "[]", 5), ("1", "other", "no", "", 0), ("1", "other", "no", "", 0)], "card_id string, side string, text string, blocks_json string, ms long")
    out = w.recognised(cards, images, some, NOW)
    got = by(out["cards"])["1"]
    assert (got["status"], got["ocr_text"], got["back_ocr_text"], got["back_ocr_duration_ms"], got["error_message"]) == ("extracting", "front", "t", 5, "e")
    assert {k: v["ocr_text"] for k, v in by(out["card_images"]).items()} == {"1:front": None, "1:back": "t"}
    made = w.processed(cards, images, spark.createDataFrame([("1", "front", "p", "t"), ("1", "back", "q", None)], "card_id string, side string, processed string, thumbnail string"), NOW)
    got = by(made["cards"])["1"]
    assert (got["status"], got["processed_image_path"], got["back_processed_image_path"], got["back_thumbnail_path"], got["error_message"]) == ("ocr_processing", "p", "q", None, None)


def test_extraction(spark, cards):
    answer = spark.createDataFrame([("1", json.dumps({"company": "ABC株式会社", "tel": "+81-3-1234-5678"}, ensure_ascii=False), 7)], "card_id string, answer string, ms long")
    fields = models.fields(F.col("answer"))
    rows = answer.select("card_id", "ms", *[c.alias(n) for n, c in fields.items() if n != "failed"], F.try_variant_get(models.json_object(F.col("answer")), "$.company", "string").alias("company"))
    got = by(w.extracted(cards, models.with_aliases(rows), NOW))["1"]
    assert (got["company_name"], got["tel"], got["email"], got["status"], got["extraction_duration_ms"], got["error_message"]) == ("ABC 株式会社", "03-1234-5678", "", "ready", 7, None)


def test_users_sessions_and_existence(spark):
    users = table(spark, LINE_USERS, {"line_user_id": "a"}, {"line_user_id": "b"})
    assert {k: v["status"] for k, v in by(w.activated(users, users.where("line_user_id = 'a'"), NOW), "line_user_id").items()} == {"a": "active", "b": "old"}
    hashes = spark.createDataFrame([("x",), ("y",)], "token_hash string")
    assert [r.token_hash for r in w.without_sessions(hashes, hashes.where("token_hash = 'x'")).collect()] == ["y"]
    asked = spark.createDataFrame([("a",), ("z",), (None,)], "who string")
    assert {r.who: r.found for r in w.exists(asked, users, "who", "line_user_id").collect()} == {"a": True, "z": False, None: False}


def test_guards(spark):
    paths = {"a/b.png": True, "a/../b": True, "../b": False, "a/../../b": False, "/etc/x": False, "a/./b": True, "a/../../a/b": False, "": True}
    df = spark.createDataFrame(list(paths), "string").toDF("p")
    assert {r.p: r.x for r in df.select("p", w.contained(F.col("p")).alias("x")).collect()} == paths
    asked = spark.createDataFrame([("auto", "front", 90), ("up", "front", 90), ("auto", "side", 90), ("auto", "back", 45), (None, "back", 90)], "d string, s string, g int")
    assert [r.x for r in asked.select(w.valid_request(F.col("d"), F.col("s"), F.col("g")).alias("x")).collect()] == [True, False, False, False, False]


def test_job_outcomes_and_rotation(spark):
    kind = "k string, has boolean, n int, text string, card boolean"
    rows = [("process_card", False, 0, None, None), ("reextract", True, 0, " ", None), ("reextract", True, 0, "t", None), ("process_card", True, 0, "t", True), ("process_card", True, 1, "t", False), ("process_card", True, 1, "t", None), ("process_card", True, 2, "t", True)]
    got = [r.o.next for r in spark.createDataFrame(rows, kind).select(w.job_outcome(*[F.col(c) for c in ("k", "has", "n", "text", "card")]).alias("o")).collect()]
    assert got == ["done", "error", "extract", "error", "not_card", "not_card", "extract"]
    kind = "d string, f string, p boolean, a array<struct<degrees int, direction string, score double>>"
    tries = [(90, "horizontal", 4.0), (-90, "horizontal", 5.0), (45, "vertical", 9.0)]
    rows = [("auto", "vertical", True, tries), ("auto", "vertical", False, tries), ("vertical", "vertical", True, tries), ("auto", "horizontal", True, tries), ("auto", "vertical", True, [(90, "horizontal", 0.0)]), ("auto", "vertical", True, [(90, "horizontal", 2.0), (-90, "horizontal", 2.0)]), ("auto", "vertical", True, [])]
    got = [r.x for r in spark.createDataFrame(rows, kind).select(w.chosen_rotation(F.col("d"), F.col("f"), F.col("p"), F.col("a")).alias("x")).collect()]
    assert got == [-90, 0, 0, 0, 0, 90, 0]


def test_texts(spark):
    files = spark.createDataFrame([("b", "x", False, None, 1), ("b", "y", True, None, 2), ("b", "z", False, "too big", 3)], "b string, name string, duplicate boolean, error string, o int")
    assert w.upload_summary(files, "b", "name", "o").first().summary == "OK: x (queued)\nOK: y (duplicate)\nNG: z: too big"
    df = spark.createDataFrame([('{"a":1}', "2024-01-01T00:00:00+00:00"), ("no", ""), (None, None)], "j string, t string")
    got = df.select(w.pretty(F.col("j")).alias("j"), w.local_date(F.col("t"), "Asia/Tokyo").alias("t")).collect()
    assert "\n" in got[0].j and [r.j for r in got[1:]] == ["no", None] and [r.t for r in got] == ["2024-01-01 09:00:00", "-", "-"]
    assert w.as_items(df.select("t").limit(1)).first().item == '{"t":"2024-01-01T00:00:00+00:00"}'
    assert tuple(w.with_defaults(df.select("t"), t="d", role="user").collect()[2]) == ("d", "user")


def test_replies(spark):
    df = spark.createDataFrame([("c1", True, "suspended"), ("c2", False, None)], "c string, d boolean, s string")
    got = df.select(search.accepted_reply(F.col("c"), F.col("d"), "https://x/?a=1").alias("u"), search.accepted_reply(F.col("c"), F.col("d")).alias("v"), search.registration_reply(F.col("s"), "https://x").alias("r"), search.registration_reply(F.col("s")).alias("q")).collect()
    assert got[0].u.split("\n") == [search.REPLIES["known"], "Open it: https://x/?a=1&card=c1"] and got[1].v == f"{search.REPLIES['taken']}\n{search.REPLIES['later']}"
    assert got[0].r == got[0].q == search.REPLIES["suspended"] and got[1].r.endswith("catalogue: https://x") and got[1].q.endswith("The administrator can help.")
