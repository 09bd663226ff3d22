"""Uploaded images as a stream: each new content becomes one card with its image and job, in one commit."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.commits import Commit, Tables
from ..operators.lookup import duplicates, first_per
from ..operators.writes import new_cards
from ..sources.files import FILES as FILES
from ..sources.files import LISTED, contents, listed
from ..sources.images import image_type, inspection

STREAM = "uploads"


def _batches(new: DataFrame, files_a_batch: int, into: str) -> list[DataFrame]:
    """Rows of a table in batches of so many, the oldest first; tasks number them, the driver adds up a count for each task."""
    spark, task, place = new.sparkSession, F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    new.orderBy("modificationTime", "path").withColumn("at", F.monotonically_increasing_id()).write.parquet(f"{into}/sorted")
    ordered, starts, total = spark.read.schema(f"{LISTED}, at long").parquet(f"{into}/sorted"), [], 0
    for k, n in sorted(ordered.groupBy(task.alias("task")).count().collect()):
        starts.append((k, total))
        total += n
    numbered = ordered.join(F.broadcast(spark.createDataFrame(starts, "task long, start long")), task == F.col("task"))
    numbered = numbered.withColumn("batch", F.floor((place + F.col("start")) / files_a_batch)).drop("at", "task", "start")
    numbered.repartition("batch").write.partitionBy("batch").parquet(f"{into}/batches")
    return [spark.read.schema(LISTED).parquet(f"{into}/batches/batch={k}") for k in range(-(-total // files_a_batch))]


def arrived(spark: SparkSession, folder: str, log: str, files_a_batch: int | None = 1000, known: DataFrame | None = None) -> DataFrame:
    """A stream of the names (path, modificationTime, length) of files of a folder and those below it, but empty ones: those that
    are there by now, and neither in `known` (path) nor in the folder `log`, are added to that, and the stream reads it. So it
    holds each path once, and names are in tables, where Spark's file source keeps them on the driver. A batch has at most
    files_a_batch files, the oldest first. None: all that are there as one batch."""
    run, found = f"{log}/run-{uuid.uuid4().hex}", f"{log}/found"
    at = lambda path: spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at(log).getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at(found))
    new = listed(spark, folder, f"{run}/listed").where("length > 0")
    for seen in (spark.read.schema(LISTED).option("recursiveFileLookup", "true").parquet(found), known):
        new = new if seen is None else new.join(seen.select("path"), "path", "left_anti")
    new.select("path", "modificationTime", "length").write.parquet(f"{run}/new")
    new = spark.read.schema(LISTED).parquet(f"{run}/new")
    total = new.count()
    batches = _batches(new, files_a_batch, run) if files_a_batch and total > files_a_batch else [new] if total else []
    for batch in batches:  # each in a new folder, as a write that crashed may leave files in its own; one file each where sizes are given
        (batch.coalesce(1) if files_a_batch else batch).write.parquet(f"{found}/{uuid.uuid4().hex}")
    store.delete(at(run), True)
    stream = spark.readStream.schema(LISTED).option("recursiveFileLookup", "true")
    return (stream.option("maxFilesPerTrigger", 1) if files_a_batch else stream).parquet(found)


def judged(files: DataFrame, max_bytes: int, structure: bool = False) -> DataFrame:
    """(path, type, sha256, refused) of uploaded files: what is larger than the limit, or no JPEG or PNG, is refused and says
    why; with `structure` also what is cut off or damaged."""
    large, kind = F.col("length") > max_bytes, image_type(F.col("content"))
    refused = F.when(large, "too large").when(kind.isNull(), "no image")
    if structure:
        files = files.withColumn("_whole", inspection(F.when(~large, F.col("content")))["whole"])
        refused = F.coalesce(refused, F.when(~F.col("_whole"), "damaged"))
    return files.select("path", kind.alias("type"), F.when(refused.isNull(), F.sha2("content", 256)).alias("sha256"), refused.alias("refused"))


def register(commit: Commit, seen: DataFrame, now: str) -> None:
    """Add a batch of judged() files to cards, card_images, jobs and uploads. The first path of each content that no card holds
    becomes a card, whose id is made of its content, so that a batch run again gives the same ones. uploads (path, sha256,
    outcome, card_id) has a row for each file: queued, duplicate (with the card that holds its content), or why it was refused."""
    good = seen.where("refused is null")
    images = commit.read("card_images")
    cards = first_per(good, ["sha256"], [F.col("path")]).select("sha256", "path", F.substring("sha256", 1, 32).alias("card_id"), F.lit("horizontal").alias("direction"), F.concat(F.lit("job-"), F.substring("sha256", 1, 28)).alias("job_id"))
    held = None if images is None else duplicates(good, images.withColumnRenamed("original_sha256", "sha256"))
    fresh = cards if held is None else cards.join(held, "sha256", "left_anti")
    known = fresh.select("sha256", "card_id") if held is None else fresh.select("sha256", "card_id").unionByName(held)
    new = fresh.withColumn("is_new", F.lit(True)).select("sha256", "path", "is_new")
    outcome = F.coalesce("refused", F.when(F.col("is_new"), "queued").otherwise("duplicate"))
    log = seen.join(known, "sha256", "left").join(new, ["sha256", "path"], "left").select("path", "sha256", outcome.alias("outcome"), "card_id", F.lit(now).alias("created_at"))
    for name, rows in new_cards(fresh, now).items():
        commit.append(name, rows)
    commit.append("uploads", log)


def upload_batch(tables: Tables, now: Callable[[], str], settings: Mapping[str, object], stream: str = STREAM, structure: bool = False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that commits each batch once, however often it is run. Files are read once; what is kept of them
    are their names and hashes, not their contents."""

    def run(files: DataFrame, number: int) -> None:
        seen = judged(files, int(settings["max_upload_mb"]) << 20, structure).persist()
        try:
            tables.transact(lambda commit: register(commit, seen, now()), stream, number)
        finally:
            seen.unpersist()

    return run


def receive(spark: SparkSession, folder: str, tables: Tables, checkpoint: str, now: Callable[[], str], settings: Mapping[str, object], files_a_batch: int | None = 1000, structure: bool = False) -> StreamingQuery:
    """Run over what a folder of uploads holds by now. Names of files that a run has met are in `arrivals` of the checkpoint."""
    names = arrived(spark, folder, f"{checkpoint}/arrivals", files_a_batch, tables.read("uploads"))
    commit = upload_batch(tables, now, settings, structure=structure)
    run = lambda files, number: commit(contents(files, folder), number)
    return names.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
