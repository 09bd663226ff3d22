"""Commits over several tables, the file sink and the stream of uploads: crashes, second writers, repeats and restarts."""

import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from inkfold.operators.commits import Commit, Conflict, Tables
from inkfold.operators.writes import new_cards
from inkfold.plans import queries as q
from inkfold.sources import files, settings
from inkfold.sources.files import FileSink, contained
from inkfold.streaming import uploads
from inkfold.streaming.uploads import FILES, receive, upload_batch

PNG = bytes.fromhex("89504E470D0A1A0A")


def _new(spark, *ids):
    return spark.createDataFrame([(i, f"in/{i}", f"sha{i}", "horizontal", f"job{i}") for i in ids], "card_id string, path string, sha256 string, direction string, job_id string")


def _add(spark, *ids):
    return lambda c: [c.append(k, v) for k, v in new_cards(_new(spark, *ids), "t").items()]


def _ids(tables, name):
    rows = tables.read(name)
    return None if rows is None else sorted(r[0] for r in rows.select("id").collect())


def test_all_tables_or_none_whatever_write_fails(spark, tmp_path, monkeypatch):
    tables = Tables(spark, f"file://{tmp_path}/t")
    tables.transact(_add(spark, "a"))
    put, publish = Commit._put, Tables._publish
    for crash in range(4):
        done = []

        def failing(self, name, rows, keep, done=done, crash=crash):
            if len(done) == crash:
                raise RuntimeError("crash")
            done.append(name)
            put(self, name, rows, keep)

        def broken(self, state):
            raise RuntimeError("crash")

        monkeypatch.setattr(Commit, "_put", failing)
        if crash == 3:
            monkeypatch.setattr(Tables, "_publish", broken)
        with pytest.raises(RuntimeError):
            tables.transact(_add(spark, "b"))
        monkeypatch.setattr(Commit, "_put", put)
        monkeypatch.setattr(Tables, "_publish", publish)
        assert tables.version() == 1
        assert [_ids(tables, n) for n in ("cards", "card_images", "jobs")] == [["a"], ["a:front"], ["joba"]]
    assert len(tables.vacuum(older_than_ms=0)) == 0 + 1 + 2 + 3
    tables.transact(_add(spark, "b"))
    assert _ids(tables, "cards") == ["a", "b"] and _ids(tables, "jobs") == ["joba", "jobb"]


def test_second_writer_loses_and_retries(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t")
    tables.transact(_add(spark, "a"))
    late = tables.begin()
    _add(spark, "late")(late)
    tables.transact(_add(spark, "b"))
    with pytest.raises(Conflict):
        late.commit()
    assert _ids(tables, "cards") == ["a", "b"]
    tried = []

    def change(commit):
        tried.append(commit.version)
        _add(spark, "c")(commit)
        if len(tried) == 1:
            Tables(spark, tables.root).transact(_add(spark, "d"))

    tables.transact(change)
    assert tried == [2, 3] and _ids(tables, "cards") == ["a", "b", "c", "d"]
    assert _ids(tables, "card_images") == ["a:front", "b:front", "c:front", "d:front"]


def test_versions_batches_compaction_and_vacuum(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t")
    assert tables.version() == 0 and tables.read("cards") is None and tables.vacuum() == []
    assert tables.transact(_add(spark, "a"), "s", 0) == 1
    assert tables.transact(_add(spark, "x"), "s", 0) is None
    assert tables.transact(_add(spark, "b"), "s", 1) == 2
    assert _ids(tables, "cards") == ["a", "b"]
    assert sorted(r.id for r in tables.read("cards", version=1).collect()) == ["a"]
    tables.compact("cards")
    assert len(tables.state()["tables"]["cards"]["folders"]) == 1 and _ids(tables, "cards") == ["a", "b"]
    assert len(tables.vacuum(keep=1)) == 0  # too young to go
    assert len(tables.vacuum(keep=1, older_than_ms=0)) == 2
    assert _ids(tables, "cards") == ["a", "b"] and tables.version() == 3
    tables.transact(lambda c: c.replace("cards", c.read("cards").where("id = 'a'").select("id")))
    assert tables.read("cards").columns == ["id"] and _ids(tables, "cards") == ["a"]
    tables.transact(lambda c: c.append("cards", c.read("cards").limit(0)))
    assert _ids(tables, "cards") == ["a"]


def _files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_file_sink_batch(spark, tmp_path):
    spark.dataSource.register(FileSink)
    rows = spark.createDataFrame([("a.bin", b"1"), ("deep/b.bin", b""), ("none", None), (None, b"x"), ("日本.bin", b"\x00\xff")], "name string, content binary").repartition(3)
    for _ in range(2):
        rows.write.format("file_sink").mode("append").save(str(tmp_path / "out"))
        assert _files(tmp_path / "out") == ["a.bin", "deep/b.bin", "日本.bin"]
    assert (tmp_path / "out/日本.bin").read_bytes() == b"\x00\xff"
    rows.limit(0).write.format("file_sink").mode("append").save(str(tmp_path / "empty"))
    with pytest.raises(Exception, match="only adds"):
        rows.write.format("file_sink").mode("overwrite").save(str(tmp_path / "out"))


def test_file_sink_leaves_nothing_of_an_aborted_write(spark, tmp_path):
    spark.dataSource.register(FileSink)
    good = spark.createDataFrame([(f"{k}.bin", b"x") for k in range(20)], "name string, content binary").repartition(4)
    bad = good.unionByName(spark.createDataFrame([("../out.bin", b"x")], good.schema))
    with pytest.raises(Exception, match="inside the folder"):
        bad.write.format("file_sink").mode("append").save(str(tmp_path / "out"))
    assert _files(tmp_path) == []
    for name in ("", "/etc/x", "a/../../b", "."):
        with pytest.raises(ValueError):
            contained(name)


def test_file_sink_stream_runs_again_alike(spark, tmp_path):
    spark.dataSource.register(FileSink)
    rows = spark.createDataFrame([(f"{k}.bin", bytes([k])) for k in range(9)], "name string, content binary")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    for k in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        stream.writeStream.format("file_sink").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        assert _files(tmp_path / "out") == sorted(f"{n}.bin" for n in range(9))


def test_file_sink_moves_a_new_folder_whole_and_fills_one_that_is_there(tmp_path, monkeypatch):
    store, root = files.opened(str(tmp_path / "out"))
    moves = []

    class Counted:
        def __getattr__(self, name):
            return getattr(store, name)

        def move(self, source, target):
            moves.append(os.path.relpath(target, root))
            store.move(source, target)

    monkeypatch.setattr(files, "opened", lambda folder: (Counted(), root))
    rows = lambda k, names: [Row(name=n, content=b"%d" % k) for n in names]
    for k in range(2):  # the second time over what is there
        sink, moves[:] = files._Files(str(tmp_path / "out"), f"a{k}"), []
        first = sink.write(iter(rows(k, [f"a/b/{n}" for n in range(50)] + ["top"])))
        second = sink.write(iter(rows(k, ["a/b/50", "a/c/0", "a/c/1"])))
        assert not moves
        sink.commit([first, None, second, files.Written("/nowhere", 0)])
        if not k:
            assert sorted(moves) == ["a", "a/b/50", "a/c", "top"]
        assert _files(tmp_path / "out") == sorted([f"a/b/{n}" for n in range(51)] + ["a/c/0", "a/c/1", "top"])
        assert {(tmp_path / "out" / n).read_bytes() for n in _files(tmp_path / "out")} == {b"%d" % k}


def test_many_small_files_are_read_in_few_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for k in range(400):
        (tmp_path / "in" / f"{k}.bin").write_bytes(b"x")
    read = lambda: spark.read.format("binaryFile").load(str(tmp_path / "in")).rdd.getNumPartitions()
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    with files.small_files(spark):
        assert read() <= 4
    assert read() > 8 and spark.conf.get(name) == before
    tasks, held = [], q._held
    monkeypatch.setattr(q, "_held", lambda df: tasks.append(df.rdd.getNumPartitions()) or held(df))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert q.QUERIES["file_sink"](spark, str(tmp_path)).count() == 400 and tasks[0] <= 4


def test_files_are_listed_and_read_by_tasks_as_spark_reads_them(spark, tmp_path):
    spark.dataSource.register(FileSink)
    folder, names = str(tmp_path / "in 1%20#é"), ["a", "b c.png", "deep/x%41.bin", "deep/er/日本.bin", "deep/er/z.gz", "e", "_a=b/c"]
    rows = spark.createDataFrame([(n, bytes(k)) for k, n in enumerate(names, 1)] + [("empty", b""), ("_no", b"x"), (".no/a", b"x"), ("a._COPYING_", b"x")], files.SCHEMA)
    rows.repartition(3).write.format("file_sink").mode("append").save(folder)
    seen = files.listed(spark, folder, f"file://{tmp_path}/listed")
    got = sorted(map(tuple, files.contents(seen, folder).collect()))
    want = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")
    assert [(p, n, c) for p, _, n, c in got if n] == sorted(map(tuple, want.collect()))
    assert {p[len(f"file:{folder}/") :]: len(c) for p, _, _, c in got} == {n: k for k, n in enumerate(names, 1)} | {"empty": 0}
    at = os.stat(f"{folder}/a").st_mtime
    assert {abs(t.timestamp() - at) < 0.001 for t in [r.modificationTime for r in seen.where("path like '%/a'").collect()]} == {True}
    with pytest.raises(FileNotFoundError):
        files.listed(spark, f"{folder}/none", f"file://{tmp_path}/none")


def test_contents_are_read_in_bounded_batches_and_tasks(spark, tmp_path, monkeypatch):
    for k in range(60):
        (tmp_path / "in" / str(k % 7)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / str(k % 7) / f"{k}.bin").write_bytes(bytes([k]) * k)
    monkeypatch.setattr(files, "FILES_A_TASK", 5)
    monkeypatch.setattr(files, "BATCH_BYTES", 40)
    read = files.contents(files.listed(spark, f"{tmp_path}/in", f"file://{tmp_path}/listed"), f"{tmp_path}/in")
    assert read.rdd.getNumPartitions() == 12
    assert sorted(bytes(r.content) for r in read.collect()) == sorted(bytes([k]) * k for k in range(60))


def test_file_sink_keeps_file_names_off_the_driver_and_reads_empty_files(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(0, "x", "en"), (1, "", "de"), (2, None, "de"), (3, "y", None)], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plans, held = [], q._held
    monkeypatch.setattr(q, "_held", lambda df: plans.append(df._jdf.queryExecution().toString()) or held(df))
    got = {r.name: r.length for r in q.QUERIES["file_sink"](spark, str(tmp_path)).collect()}
    assert got == {f"{n:012d}.png": length for n, length in enumerate((9, 0, 0, 9))}
    assert "MapInArrow" in plans[0] and "binaryFile" not in plans[0]


def test_an_upload_stream_takes_all_files_in_few_tasks_and_keeps_no_contents(spark, tmp_path, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 300).cast("string").alias("text"), F.lit("en").alias("lang"))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    seen, register = [], uploads.register
    monkeypatch.setattr(uploads, "register", lambda commit, rows, *more: seen.append((rows.columns, rows.rdd.getNumPartitions())) or register(commit, rows, *more))
    got = q.QUERIES["stream_uploads"](spark, str(tmp_path)).collect()
    assert [c for c, _ in seen] == [["path", "type", "sha256", "refused"]] and seen[0][1] <= 4
    assert sorted(r.name for r in got if r.outcome == "queued") == [f"{n:012d}.png" for n in range(300)] and len(got) == 400


def _outcomes(tables):
    return sorted((os.path.basename(r.path), r.outcome) for r in tables.read("uploads").collect())


def test_uploads_once_within_and_across_batches_and_restarts(spark, tmp_path):
    tables, folder = Tables(spark, f"file://{tmp_path}/t"), tmp_path / "in"
    folder.mkdir()
    put = lambda name, raw: (folder / name).write_bytes(raw)
    go = lambda: receive(spark, str(folder), tables, f"file://{tmp_path}/c", lambda: "t", settings.load({"max_upload_mb": "1"})).awaitTermination()
    put("a.png", PNG + b"1"), put("b.png", PNG + b"1"), put("c.png", PNG + b"2"), put("d.txt", b"text"), put("e.png", PNG + bytes(2 << 20)), put("f.png", b"")
    go()
    assert _outcomes(tables) == [("a.png", "queued"), ("b.png", "duplicate"), ("c.png", "queued"), ("d.txt", "no image"), ("e.png", "too large")]  # an empty file is no row of the source
    put("g.png", PNG + b"2"), put("h.jpg", b"\xff\xd8\xff3")
    go()
    go()
    assert _outcomes(tables)[-2:] == [("g.png", "duplicate"), ("h.jpg", "queued")]
    cards, images, jobs = (tables.read(n).collect() for n in ("cards", "card_images", "jobs"))
    assert len(cards) == len(images) == len(jobs) == 3
    by_name = {os.path.basename(r.path): r.card_id for r in tables.read("uploads").collect()}
    assert by_name["a.png"] == by_name["b.png"] and by_name["c.png"] == by_name["g.png"] and by_name["d.txt"] is None
    assert {r.id for r in cards} == {by_name[n] for n in ("a.png", "c.png", "h.jpg")} == {r.card_id for r in jobs}


def test_an_upload_stream_keeps_names_in_tables_and_not_in_the_log_of_its_source(spark, tmp_path):
    tables, folder, log = Tables(spark, f"file://{tmp_path}/t"), tmp_path / "in dir", tmp_path / "c"
    for k in range(30):
        (folder / str(k % 4)).mkdir(parents=True, exist_ok=True)
        (folder / str(k % 4) / f"{k} %41.png").write_bytes(PNG + bytes([k // 2]))
    receive(spark, str(folder), tables, f"file://{log}", lambda: "t", settings.load({}), files_a_batch=None).awaitTermination()
    assert [o for _, o in _outcomes(tables)].count("queued") == 15 and tables.version() == 1
    assert {r.path for r in tables.read("uploads").collect()} == {f"file:{folder}/{k % 4}/{k} %41.png" for k in range(30)}
    logs = [(d, f) for d, _, names in os.walk(log / "sources") for f in names if not f.endswith(".crc")]
    assert logs and not any(".png" in open(os.path.join(d, f)).read() for d, f in logs)
    assert os.listdir(log / "arrivals") == ["found"]


def test_upload_batches_are_of_the_size_given_and_take_the_oldest_first(spark, tmp_path, monkeypatch):
    tables, folder, sizes = Tables(spark, f"file://{tmp_path}/t"), tmp_path / "in", []
    folder.mkdir()
    for k in range(11):  # the names' order is not that of their times
        (folder / f"{k * 7 % 11:02d}.png").write_bytes(PNG + b"same")
        os.utime(folder / f"{k * 7 % 11:02d}.png", (10**9 + k, 10**9 + k))
    register = uploads.register
    monkeypatch.setattr(uploads, "register", lambda commit, seen, now: sizes.append(sorted(r.path[-6:-4] for r in seen.collect())) or register(commit, seen, now))
    go = lambda n: receive(spark, str(folder), tables, f"file://{tmp_path}/c", lambda: "t", settings.load({}), files_a_batch=n).awaitTermination()
    go(4)
    order = [f"{k * 7 % 11:02d}" for k in range(11)]
    assert sizes == [sorted(order[:4]), sorted(order[4:8]), sorted(order[8:])]
    assert [r.path[-6:-4] for r in tables.read("uploads").where("outcome = 'queued'").collect()] == [min(order[:4])]
    go(4)
    (folder / "new.png").write_bytes(PNG + b"new")
    go(4)
    assert sizes[3:] == [["ew"]] and tables.read("uploads").count() == 12


def test_uploads_met_by_a_run_that_crashed_are_taken_once(spark, tmp_path):
    tables, folder = Tables(spark, f"file://{tmp_path}/t"), tmp_path / "in"
    folder.mkdir()
    (folder / "a.png").write_bytes(PNG + b"1")

    def go(fail=False, log="c"):
        receive(spark, str(folder), tables, f"file://{tmp_path}/{log}", lambda: 1 / 0 if fail else "t", settings.load({}), files_a_batch=None).awaitTermination()

    with pytest.raises(Exception, match="division"):
        go(fail=True)
    (folder / "b.png").write_bytes(PNG + b"1")
    go()
    assert _outcomes(tables) == [("a.png", "queued"), ("b.png", "duplicate")]
    (folder / "c.png").write_bytes(PNG + b"1")
    go(log="of_a_version_without_arrivals")  # what uploads holds is not new
    assert [r.path[-5:] for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/of_a_version_without_arrivals/arrivals/found").collect()] == ["c.png"]


def test_an_upload_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    tables = Tables(spark, f"file://{tmp_path}/t")
    batch = spark.createDataFrame([("x/a.png", None, 9, bytearray(PNG + b"1"))], FILES)
    run = upload_batch(tables, lambda: "t", settings.load({}))
    run(batch, 0)
    run(batch, 0)
    assert tables.version() == 1 and tables.read("cards").count() == 1
    run(batch, 1)
    assert tables.read("cards").count() == 1 and sorted(r.outcome for r in tables.read("uploads").collect()) == ["duplicate", "queued"]
    run(batch.limit(0), 2)
    assert tables.version() == 3
