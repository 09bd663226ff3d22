"""Fixed-length intervals as state of a stream: over several batches, a restart, ties, nulls and the timer."""

from datetime import datetime, timedelta

from pyspark.sql import Row

from inkfold.operators.commits import Tables
from inkfold.streaming.sessions import Intervals, intervals, last_states, state_store

START = datetime(2024, 1, 1)
FORM = "user string, ts timestamp"


def plain(events, hours):
    out, opened = {}, {}
    for user, at in sorted((u, t) for u, t in events if u is not None and t is not None):
        if user not in opened or at >= opened[user] + timedelta(hours=hours):
            opened[user] = at
        out[user, opened[user]] = out.get((user, opened[user]), 0) + 1
    return sorted((u, o, o + timedelta(hours=hours), n) for (u, o), n in out.items())


def test_batches_and_restarts_equal_one_pass(spark, tmp_path):
    at = lambda h, m=0: START + timedelta(hours=h, minutes=m)
    batches = [
        [("a", at(0)), ("a", at(1)), ("b", at(0, 30)), ("a", at(1)), (None, at(1)), ("c", None)],
        [("a", at(1, 59)), ("a", at(2)), ("b", at(2, 29))],
        [("a", at(9)), ("b", at(2, 30)), ("b", at(30))],
        [("a", at(40)), ("b", at(31, 59))],
    ]
    tables = Tables(spark, f"file://{tmp_path}/t")
    source, seen = str(tmp_path / "in"), []
    spark.createDataFrame([], FORM).write.parquet(source)
    for batch in batches:
        spark.createDataFrame(batch, FORM).coalesce(1).write.mode("append").parquet(source)
        seen += batch
        with state_store(spark):
            found = intervals(spark.readStream.schema(FORM).parquet(source), "user", "ts", "2 hours")
            keep = lambda rows, number: tables.transact(lambda c: c.append("s", rows), "s", number)
            found.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
        got = sorted(map(tuple, last_states(tables.read("s")).collect()))
        assert got == plain(seen, 2)
    state = spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / "log"))
    assert state.count() <= 2  # what has ended is forgotten


class _Store:
    """Counts what a processor asks of the state store."""

    def __init__(self):
        self.held, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_a_batch_sets_one_timer_for_a_key_however_many_intervals_it_opens():
    store, processor = _Store(), Intervals(10)
    processor.init(store)
    feed = lambda *at: [tuple(r) for r in processor.handleInputRows(("k",), (Row(at=x) for x in at), None)]
    out = feed(*range(0, 5000, 5))
    assert [r[1:] for r in map(tuple, out)] == [(x, x + 10, 2) for x in range(0, 5000, 10)]
    assert store.held == (4990, 2) and store.timers == {processor._timer(4990)} and store.calls == 1
    assert feed(4999) == [("k", 4990, 5000, 3)] and store.calls == 1
    assert [r[1] for r in feed(5000, 7000)] == [5000, 7000] and store.timers == {processor._timer(7000)} and store.calls == 3
