"""The inbound event log and the job queue as streams.

An event is handled at most once, for ever: ids already in the log are left out by an anti-join with it in each micro-batch,
so no watermark forgets them and no state grows in memory. A batch that is run again after a crash finds its ids in the log
or not at all, since a batch is written as one version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import Log, Snapshots, new_only
from ..operators.queue import claim, finished, route
from ..schema import JOBS, LINE_EVENTS, WEBHOOK


def parsed(raw: DataFrame, body: str = "value") -> DataFrame:
    """One row for each event of the request bodies; a body that is no such JSON has none. The id is the event's own or its
    message's; events without any are dropped."""
    events = raw.select(F.explode(F.from_json(body, WEBHOOK)["events"]).alias("e"))
    rows = events.select(F.coalesce("e.webhookEventId", "e.message.id").alias("id"), F.col("e.type").alias("event_type"), F.col("e.source.userId").alias("line_user_id"), F.col("e.message.id").alias("message_id"), F.col("e.message.type").alias("message_type"), F.col("e.message.text").alias("text"))
    return rows.where("id is not null")


def routed(events: DataFrame, users: DataFrame) -> DataFrame:
    """Events with what becomes of each."""
    known = users.select(F.col("line_user_id").alias("_user"), F.col("status").alias("_status"))
    met = events.join(known, F.col("line_user_id") == F.col("_user"), "left")
    return met.withColumn("status", route(F.col("event_type"), F.col("_status"), F.col("message_type"), F.col("text"))).drop("_user", "_status")


def log_batch(spark: SparkSession, tables: Snapshots, users: DataFrame, now: Callable[[], str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: new events are routed and added to the log line_events, a folder for each batch."""

    def run(batch: DataFrame, number: int) -> None:
        log = Log(spark, tables.root, "line_events", LINE_EVENTS)
        fresh = new_only(log.read(but=number), batch, ["id"], [F.col("event_type"), F.col("message_id"), F.col("text")])
        rows = routed(fresh, users).withColumns({"created_at": F.lit(now()), "updated_at": F.lit(now())})
        log.append(rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in LINE_EVENTS.fields]), number)

    return run


def handle_events(spark: SparkSession, source: DataFrame, tables: Snapshots, users: DataFrame, checkpoint: str, now: Callable[[], str]) -> StreamingQuery:
    """Run over what a stream of request bodies holds by now."""
    return parsed(source).writeStream.foreachBatch(log_batch(spark, tables, users, now)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_jobs(spark: SparkSession, tables: Snapshots, work: Callable[[DataFrame], DataFrame], now: Callable[[], str], n: int = 1) -> int:
    """Claim up to n jobs, do them (work: claimed rows to (id, error)), store the outcome. Gives how many were claimed. Jobs
    that a crash left running are claimed again by `reclaim` first."""
    jobs = tables.read("jobs", spark.createDataFrame([], JOBS))
    picked, after = claim(jobs, now(), n)
    tables.write("jobs", after)
    tables.write("jobs", finished(tables.read("jobs"), work(picked), now()))
    return picked.count()


def reclaim(jobs: DataFrame, before: str) -> DataFrame:
    """Jobs that have been running since before a time are queued again."""
    stuck = (F.col("status") == "running") & (F.col("started_at") < before)
    return jobs.withColumn("status", F.when(stuck, "queued").otherwise(F.col("status")))


def deduplicated(events: DataFrame, key: str, within: str | None = None, time: str = "ts") -> DataFrame:
    """A stream with each key once: for ever (state grows with the keys), or with `within` for that long in event time."""
    if within:
        return events.withWatermark(time, within).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])
