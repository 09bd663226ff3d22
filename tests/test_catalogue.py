"""Catalogue operators on small rows."""

import json
import os
import struct
import zlib

from pyspark.sql import functions as F

from inkfold.operators import catalog, classify, layout, lookup, merge, queue
from inkfold.schema import JOBS, LINE_EVENTS
from inkfold.sources import images, models, settings
from inkfold.streaming import events

NOW = "2024-01-01T00:00:00+00:00"


def rows(spark, kind, *values):
    return spark.createDataFrame(list(values), kind)


def test_combined_text(spark):
    df = rows(spark, "card_id string, side string, ocr_text string, created_at string", ("1", "back", "B", "1"), ("1", "front", " A ", "2"), ("2", "front", "A", "1"), ("2", "back", "  ", "1"), ("3", "back", None, "1"))
    got = {r.card_id: r.combined for r in catalog.combined_text(df).collect()}
    assert got == {"1": "【表面】\nA\n\n【裏面】\nB", "2": "【表面】\nA", "3": ""}


def test_overlay_overwrites_with_null(spark):
    cards = rows(spark, "id string, ocr_text string, back_ocr_text string", ("1", "old", "oldback"), ("2", "kept", None))
    found = catalog.overlay(cards, rows(spark, "card_id string, side string, ocr_text string", ("1", "front", None), ("1", "back", "new"), ("1", "side", "no")), ["ocr_text"])
    assert {r.id: (r.ocr_text, r.back_ocr_text) for r in found.collect()} == {"1": (None, "new"), "2": ("kept", None)}


def test_hydrate_orders_and_keeps_childless(spark):
    cards = rows(spark, "id string", ("1",), ("2",))
    kids = rows(spark, "card_id string, side string, created_at string", ("1", "x", "0"), ("1", "back", "0"), ("1", "front", "9"), ("1", "front", "1"))
    got = {r.id: [(k.side, k.created_at) for k in r.images] for r in catalog.hydrate(cards, kids).collect()}
    assert got == {"1": [("front", "1"), ("front", "9"), ("back", "0"), ("x", "0")], "2": []}


def test_upsert_twice_is_once(spark):
    t = rows(spark, "k string, a string, b string", ("1", "x", "y"), ("2", "x", "y"))
    c = rows(spark, "k string, a string", ("2", None), ("3", "z"))
    for policy in (merge.take_new, merge.coalesce_new, merge.keep_old):
        once = merge.upsert(t, c, ["k"], {"a": policy})
        assert sorted(map(tuple, merge.upsert(once, c, ["k"], {"a": policy}).collect())) == sorted(map(tuple, once.collect()))
    got = {r.k: (r.a, r.b) for r in merge.upsert(t, c, ["k"], {"b": merge.reset}).collect()}
    assert got == {"1": ("x", "y"), "2": (None, None), "3": ("z", None)}


def test_cascade(spark):
    keys = rows(spark, "id string", ("1",))
    kids = rows(spark, "card_id string, n int", ("1", 1), ("2", 2), (None, 3))
    out = merge.delete_cascade(keys, "id", {"images": (kids, "card_id")}, {"events": (kids, "card_id")})
    assert sorted(r.n for r in out["images"].collect()) == [2, 3]
    assert {r.n: r.card_id for r in out["events"].collect()} == {1: None, 2: "2", 3: None}


def test_snapshots(spark, tmp_path):
    s = merge.Snapshots(spark, f"file://{tmp_path}")
    assert s.read("t") is None
    s.write("t", rows(spark, "k int", (1,)))
    old = s.read("t")
    s.write("t", old.union(old))
    assert (old.count(), s.read("t").count(), s.version("t")) == (1, 2, 2)
    os.makedirs(tmp_path / "t" / "v3")  # a crash within a write leaves no success file
    assert s.read("t").count() == 2 and s.write("t", old) == 3 and s.read("t").count() == 1


def test_first_per_is_sort_and_take(spark):
    values = [(i % 5, (i * 7) % 11, i) for i in range(60)]
    got = {r.k: r.i for r in lookup.first_per(rows(spark, "k int, o int, i int", *values), ["k"], [F.col("o"), F.col("i")]).collect()}
    assert got == {k: min((o, i) for kk, o, i in values if kk == k)[1] for k in range(5)}


def test_evolution_and_hash_backfill(spark):
    cards = rows(spark, "id string, original_image_path string, original_sha256 string", ("1", "a", None), ("2", "b", ""), ("3", "a", "kept"))
    files = rows(spark, "path string, content binary", ("a", b"abc"))
    got = {r.id: r.original_sha256 for r in merge.with_hashes(cards, files).collect()}
    assert got["1"].startswith("ba7816bf") and not got["2"] and got["3"] == "kept"
    assert merge.evolved(cards, {"new": "long", "id": "string"}).dtypes[-1] == ("new", "bigint")


def test_boxes_and_blocks():
    assert layout.parse_blocks(json.dumps({"words": [{"content": " a ", "points": [[10, 20], [30, 20], [30, 40], [10, 40]]}, {"text": "b", "box": {"x": 1, "y": 2, "width": 3, "height": 4}}, {"text": "b", "box": {"x": 1, "y": 2, "width": 3, "height": 4}}, {"text": "c", "bbox": [5, 6, 1, 2]}]})) == [
        {"text": "a", "box": [10, 20, 30, 40], "font_size": 20.0}, {"text": "b", "box": [1, 2, 4, 6], "font_size": 4.0}, {"text": "c", "box": [5, 6, 1, 2], "font_size": 0.0}]
    assert layout.parse_blocks("") == [] and layout.parse_blocks(None) == [] and layout.parse_blocks("plain")[0]["text"] == "plain"
    deep = "[" * 400 + '{"text": "x", "child": {"label": "y"}}' + "]" * 400
    assert [b["text"] for b in layout.parse_blocks(deep)] == ["x", "y"]


def test_direction_and_order(spark):
    got = rows(spark, "h int, v int", (0, 3), (3, 3), (0, 2)).select(layout.direction(F.col("h"), F.col("v")).alias("d")).collect()
    assert [r.d for r in got] == ["vertical", "horizontal", "horizontal"]
    df = rows(spark, "b array<struct<text string, box array<double>, font_size double>>", ([("1", [0.0, 5.0], 1.0), ("2", None, 9.0), ("3", [9.0, 5.0, 1.0, 1.0], 2.0), ("4", [0.0, 5.0], None)],))
    r = df.select(*[F.transform(layout.reading_order(F.col("b"), F.lit(w)), lambda x: x["text"]).alias(w) for w in ("vertical", "horizontal")], layout.marked_text(F.col("b")).alias("m")).first()
    assert r.vertical == ["3", "2", "1", "4"] and r.horizontal == ["2", "1", "4", "3"]
    assert r.m == "1\n【大文字】2\n3\n4"


def test_rotation(spark):
    df = rows(spark, "t string, h int, v int", ("x" * 40, 5, 1), ("x" * 10, 5, 1), ("x" * 40, 2, 1))
    assert [r.s for r in df.select(layout.rotation_score(F.col("t"), F.col("h"), F.col("v"), F.lit("y" * 40), F.lit(3)).alias("s")).collect()] == [6.0, 0.0, 0.0]
    best = layout.best_rotation(rows(spark, "image_id string, attempt int, score double", ("a", 1, 2.0), ("a", 2, 2.0), ("b", 1, None), ("b", 2, 0.0)))
    assert {r.image_id: r.attempt for r in best.collect()} == {"a": 1, "b": 2}


def test_corners(spark):
    p = rows(spark, "p array<struct<x double, y double>>", ([(10.0, 0.0), (0.0, 10.0), (0.0, 0.0), (10.0, 10.0)],))
    r = p.select(layout.corners(F.col("p")).alias("c"), layout.expanded(F.col("p"), 0.1, F.lit(20.0), F.lit(20.0)).alias("e")).first()
    assert [(a.x, a.y) for a in r.c] == [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert [(round(a.x, 6), round(a.y, 6)) for a in r.e] == [(10.5, 0), (0, 10.5), (0, 0), (10.5, 10.5)]


def test_classifier(spark):
    df = rows(spark, "t string", ("short",), ("株式会社サンプル\n営業部長 山田太郎\n東京都千代田区1-2-3\n電話 03-1234-5678\nyamada@example.co.jp",), ("one line that is long enough to pass the first test",), (None,), ("aaaa aaaa aaaa aaaa\nbbbb bbbb\ncccc cccc",))
    found = classify.classified(F.col("t"))
    got = [tuple(r) for r in df.select(found["score"].alias("s"), found["is_card"].alias("c"), found["reason"].alias("r")).collect()]
    assert [(s, c) for s, c, _ in got] == [(0, False), (11, True), (0, False), (0, False), (0, False)]
    assert got[1][2] == "email, phone, website, address, company, title"


def test_claim_and_finish(spark):
    jobs = spark.createDataFrame([(None, None, None, str(i), str(i), "process_card", "queued", f"2024-01-0{i}", 0) for i in (3, 1, 2)], "error_message string, started_at string, finished_at string, id string, card_id string, type string, status string, created_at string, attempts long")
    picked, after = queue.claim(jobs, NOW, 2)
    assert sorted((r.id, r.attempts, r.status) for r in picked.collect()) == [("1", 0, "running"), ("2", 0, "running")]
    assert {r.id: (r.status, r.attempts) for r in after.collect()} == {"1": ("running", 1), "2": ("running", 1), "3": ("queued", 0)}
    done = queue.finished(after, rows(spark, "id string, error string", ("1", None), ("2", "x" * 3000)), NOW)
    assert {r.id: (r.status, len(r.error_message or "")) for r in done.collect()} == {"1": ("done", 0), "2": ("error", 2000), "3": ("queued", 0)}
    assert {r.id: r.status for r in events.reclaim(after, "2025").collect()}["1"] == "queued"


def test_event_stream_is_at_most_once(spark, tmp_path):
    body = lambda *e: json.dumps({"events": list(e)})
    a = {"type": "message", "webhookEventId": "e1", "source": {"userId": "u"}, "message": {"id": "m1", "type": "text", "text": "x"}}
    b = {"type": "message", "source": {"userId": "v"}, "message": {"id": "m2", "type": "image"}}
    users = rows(spark, "line_user_id string, status string", ("u", "active"))
    tables = merge.Snapshots(spark, f"file://{tmp_path}/tables")
    for k, lines in enumerate(([body(a, a, b, {"type": "message"})], [body(a), "not json", body()])):
        os.makedirs(tmp_path / "in", exist_ok=True)
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(lines))
        events.handle_events(spark, spark.readStream.text(f"{tmp_path}/in"), tables, users, f"{tmp_path}/log", lambda: NOW).awaitTermination()
    log = merge.Log(spark, tables.root, "line_events", LINE_EVENTS)
    assert {r.id: r.status for r in log.read().collect()} == {"e1": "searched", "m2": "unauthorized"} and log.read().columns == LINE_EVENTS.fieldNames()
    again = events.parsed(spark.read.text(f"{tmp_path}/in/1.txt"))
    events.log_batch(spark, tables, users, lambda: NOW)(again, 1)  # a batch that is run again
    assert log.read().count() == 2


def test_jobs_run_once(spark, tmp_path):
    tables = merge.Snapshots(spark, f"file://{tmp_path}/tables")
    tables.write("jobs", spark.createDataFrame([{"id": "1", "card_id": "c", "type": "reextract", "status": "queued", "created_at": "1", "attempts": 0}], JOBS))
    work = lambda picked: picked.select("id", F.lit(None).cast("string").alias("error"))
    assert events.run_jobs(spark, tables, work, lambda: NOW) == 1 and events.run_jobs(spark, tables, work, lambda: NOW) == 0
    assert tables.read("jobs").first().status == "done"


def test_images(spark, tmp_path):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0))
    jpg = b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xc0\x00\x0b\x08\x00\x09\x00\x0b\x01\x01\x11\x00"
    for name, data in (("a.png", png), ("b.png", png), ("c.jpg", jpg), ("d.txt", b"no"), ("big.png", png + b"0" * 5000)):
        (tmp_path / name).write_bytes(data)
    found = images.read(spark, str(tmp_path), 4000)
    assert sorted((r.name, r.type, r.width, r.height) for r in found.collect()) == [("a.png", "png", 7, 5), ("b.png", "png", 7, 5), ("c.jpg", "jpg", 11, 9)]
    held = found.where("type = 'jpg'").select("sha256", F.lit("card").alias("card_id"), F.lit("1").alias("created_at"))
    new, repeated = images.new_files(found, held)
    assert [r.name for r in new.collect()] == ["a.png"] and [r.card_id for r in repeated.collect()] == ["card"]


def test_models(spark):
    df = rows(spark, "id int, content binary", (1, b"Mail a@b.co\nTel +1 415 555 0100"), (2, None))
    out = models.apply_model(df, "content", "result", models.text_passthrough)
    got = {r.id: r for r in out.collect()}
    assert got[2].result is None and got[2].result_error and len(layout.parse_blocks(got[1].result)) == 2
    answers = rows(spark, "a string", ('```json\n{"email": " x ", "tel": null, "tags": [1]}\n```',), ('sure: {"email": "y"} ok',), ("[1]",), (None,))
    got = answers.select(*[c.alias(n) for n, c in models.fields(F.col("a")).items()]).collect()
    assert [(r.email, r.tel, r.failed) for r in got] == [("x", "", False), ("y", "", False), ("", "", True), ("", "", True)]


def test_settings():
    got = settings.load({"max_upload_mb": "50", "autorotate": "no", "invite_codes": "a, b,,", "other": "x"})
    assert (got["max_upload_mb"], got["autorotate"], got["invite_codes"], got["session_hours"]) == (50, False, ("a", "b"), 720) and "other" not in got


def test_touch_and_users(spark):
    users = spark.createDataFrame([("a", "b", None, "u", "active", "user", NOW, NOW)], "display_name string, picture_url string, last_seen_at string, line_user_id string, status string, role string, created_at string, updated_at string")
    seen = lookup.touched(users, users, "line_user_id", last_seen_at=F.lit("now"))
    assert seen.first().last_seen_at == "now" and catalog.public_user(seen).columns == ["line_user_id", "display_name", "picture_url", "status", "role"]
