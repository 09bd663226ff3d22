"""The reply sink: failures as rows, and batches that are run again."""

from inkfold.operators.commits import Tables
from inkfold.streaming.replies import delivered, reply_batch

ROWS = [("1", "u1", "hello"), ("2", "bad", "x"), ("3", None, "x"), ("4", "u2", ""), ("5", "u2", "again")]


def _sender(folder):
    def send(to, text):
        if to == "bad":
            raise ConnectionError("refused " + "y" * 3000)
        with open(f"{folder}/{to}", "a", encoding="utf-8") as f:
            f.write(text + "\n")

    return send


def test_failures_are_rows(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id string, to string, text string").repartition(2)
    got = {r.id: r.failure for r in delivered(df, _sender(tmp_path)).collect()}
    assert got["1"] is got["5"] is None and got["2"].startswith("ConnectionError: refused") and len(got["2"]) == 2000
    assert got["3"] == got["4"] == "ValueError: no receiver or no text"
    assert delivered(df.limit(0), _sender(tmp_path)).collect() == []


def test_a_batch_is_sent_and_stored_once(spark, tmp_path):
    (tmp_path / "out").mkdir()
    tables, df = Tables(spark, f"file://{tmp_path}/t"), spark.createDataFrame(ROWS, "id string, to string, text string")
    run = reply_batch(tables, _sender(tmp_path / "out"))
    for number in (0, 0, 1):
        run(df, number)
    assert (tmp_path / "out/u1").read_text() == "hello\n" * 2 and tables.read("replies").count() == 10
    assert tables.read("replies").where("failure is not null").count() == 6
