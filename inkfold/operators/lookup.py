"""Lookups: by key, first row of each key, duplicates by content hash, live sessions, active jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_key(df: DataFrame, **key: object) -> DataFrame:
    """Rows whose columns equal the given values; the equalities reach the Parquet scan."""
    for name, value in key.items():
        df = df.where(F.col(name) == value)
    return df


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. `order` must break ties. Plans to a window group limit before the shuffle, so a hot key
    sends one row of each task."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def hashed(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))


def duplicates(hashes: DataFrame, images: DataFrame, legacy: DataFrame | None = None, order: tuple[str, str] = ("created_at", "card_id"), owner: str | None = None) -> DataFrame:
    """(sha256, card_id): the oldest card that holds each wanted hash. images: (sha256, card_id, created_at[, owner]); legacy,
    of the same columns, counts only where images have no such hash; with owner, only that owner's cards."""
    kept = ["sha256", "card_id", order[0]]
    scoped = lambda df: df.where(F.col("owner") == owner) if owner else df
    found = scoped(images).select(*kept, F.lit(0).alias("priority"))
    if legacy is not None:
        found = found.unionByName(scoped(legacy).select(*kept, F.lit(1).alias("priority")))
    wanted = hashes.select("sha256").where("sha256 is not null").distinct()
    best = found.join(wanted, "sha256", "left_semi").groupBy("sha256").agg(F.min(F.struct("priority", order[0], order[1])).alias("best"))
    return best.select("sha256", F.col("best.card_id").alias("card_id"))


def live_sessions(sessions: DataFrame, users: DataFrame, now: str) -> DataFrame:
    """Sessions that have not ended, of active users, with the user's columns."""
    live = sessions.where(F.col("expires_at") > now).select("token_hash", "line_user_id", "expires_at")
    return live.join(users.where(F.col("status") == "active"), "line_user_id")


def active_jobs(jobs: DataFrame, states: tuple[str, ...] = ("queued", "running"), key: str = "card_id", order: tuple[str, str] = ("created_at", "id")) -> DataFrame:
    """The oldest active job of each card: a card in this table takes no other job."""
    return first_per(jobs.where(F.col("status").isin(*states)), [key], [F.col(order[0]), F.col(order[1])])


def touched(df: DataFrame, keys: DataFrame, on: str, **values: Column) -> DataFrame:
    """df with the given columns set where its key is among keys."""
    marked = df.join(keys.select(on).distinct().withColumn("_hit", F.lit(True)), on, "left")
    return marked.select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])
