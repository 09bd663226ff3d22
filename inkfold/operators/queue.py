"""The job queue and the event log as tables: claiming, finishing, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clipped


def next_jobs(jobs: DataFrame, n: int = 1, order: tuple[str, str] = ("created_at", "id")) -> DataFrame:
    """The n oldest queued jobs: an ordered limit, of which each task sends n rows."""
    return jobs.where(F.col("status") == "queued").orderBy(*order).limit(n)


def claim(jobs: DataFrame, now: str, n: int = 1, order: tuple[str, str] = ("created_at", "id")) -> tuple[DataFrame, DataFrame]:
    """(claimed, jobs after): the claimed rows are as they were, except their status; in the table attempts has grown. One
    writer at a time: Structured Streaming gives that for a checkpoint."""
    picked = next_jobs(jobs, n, order)
    marks = picked.select(F.col("id").alias("_id"))
    met = jobs.join(marks, jobs.id == marks._id, "left")
    new = {"status": F.lit("running"), "attempts": F.col("attempts") + 1, "started_at": F.lit(now)}
    after = met.select(*[F.when(F.col("_id").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])
    return picked.withColumn("status", F.lit("running")), after


def finished(jobs: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """Jobs with the outcome of their runs: results (id, error). An error fails the job, its message cut to 2,000 characters."""
    met = jobs.join(results.select(F.col("id").alias("_id"), F.col("error").alias("_error")), F.col("id") == F.col("_id"), "left")
    new = {"status": F.when(F.col("_error").isNull(), "done").otherwise("error"), "error_message": clipped(F.col("_error")), "finished_at": F.lit(now)}
    return met.select(*[F.when(F.col("_id").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def card_status(cards: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """Cards of failed jobs are in error: results (card_id, error)."""
    bad = results.where("error is not null").groupBy(F.col("card_id").alias("_id")).agg(F.max("error").alias("_error"))
    met = cards.join(bad, F.col("id") == F.col("_id"), "left")
    new = {"status": F.lit("error"), "error_message": clipped(F.col("_error")), "updated_at": F.lit(now)}
    return met.select(*[F.when(F.col("_id").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in cards.columns])


def orphans_done(jobs: DataFrame, cards: DataFrame, now: str) -> DataFrame:
    """Running jobs whose card is gone are done."""
    met = jobs.join(cards.select(F.col("id").alias("_card")), F.col("card_id") == F.col("_card"), "left")
    gone = (F.col("status") == "running") & F.col("_card").isNull()
    new = {"status": F.lit("done"), "finished_at": F.lit(now)}
    return met.select(*[F.when(gone, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def requeued(jobs: DataFrame, leases: DataFrame) -> DataFrame:
    """Running jobs whose last lease has expired are queued again, with the attempts they have had: leases (key the job's id, opened,
    state), as a stream of them gives its last states. A job that has no lease stays as it is."""
    held = {c.lower() for c in jobs.columns}
    job, state = (next(n for k in range(99) if (n := f"_{w}{'_' * k}") not in held) for w in ("job", "state"))
    last = leases.groupBy(F.col("key").alias(job)).agg(F.max_by("state", "opened").alias(state))
    met = jobs.join(last, F.col("id").cast("string") == F.col(job), "left")
    stuck = (F.col("status") == "running") & (F.col(state) == "expired")
    return met.select(*[F.when(stuck, F.lit("queued")).otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in jobs.columns])


def route(kind: Column, user: Column, message: Column, text: Column) -> Column:
    """What becomes of an inbound event: by the user's status first, then by what it holds."""
    return F.when(user.isNull() | (user != "active"), "unauthorized").when(kind != "message", "ignored").when((message == "text") & (F.trim(text) != ""), "searched").when(message == "image", "queued").otherwise("ignored")
