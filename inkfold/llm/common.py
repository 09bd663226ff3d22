"""Helpers that the operators of this package share: table access, the shared folder, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, read by Spark (the path may be in any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, one of our own if driver and executors
    are one process (tests); on a cluster there is no folder to guess."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def save(df: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared folder and read it again: cuts the lineage, and survives lost executors."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/inkfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._inkfold_path = path
    return out


def drop_saved(df: DataFrame) -> None:
    """Delete the files of a saved DataFrame that nothing reads any more."""
    path = getattr(df, "_inkfold_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for internal columns that clash with no column of df."""
    held = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in held:
            name += "_"
        names.append(name)
        held.add(name.lower())
    return names


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (one more than rows) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, at: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part hold about `most` bytes; one longer text is a part of its own."""
    raw, offsets = text_buffer(batch.column(at))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def with_columns(batch: pa.RecordBatch, **new: pa.Array) -> pa.RecordBatch:
    """Add columns to a batch; one of the same name, in any case, is replaced."""
    names = [n for n in batch.schema.names if n.lower() not in new]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(new.values()), names=names + list(new))


def extended(df: DataFrame, **new: str) -> str:
    """The DDL schema of with_columns() over the rows of df."""
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name.lower() not in new] + [f"`{n}` {t}" for n, t in new.items()])


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int) -> tuple[list[bytes], np.ndarray]:
    """Whole texts and 0/1 labels of a bounded sample of the labelled documents whose crc32 bucket of 5 is not 0: in the order
    of a hash of id and text, up to `most` documents, each if it still fits into `most_bytes` together with those before. So
    the sample depends on the rows alone. Rows of one id and text count once; null labels and null ids teach nothing; of
    several labels of an id the least counts."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.min(label).alias("mark"))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("whole")).withColumn("key", F.xxhash64("whole"))
    met = keyed.select("doc_id", "key", F.octet_length("whole").alias("size")).distinct().join(marks, "doc_id")
    first = met.select("doc_id", "key", "mark", "size", F.xxhash64("doc_id", "key").alias("place")).orderBy("place").limit(most).collect()
    chosen, room = [], most_bytes
    for row in first:
        if row["size"] <= room:
            chosen.append((row["doc_id"], row["key"], int(row["mark"] > 0), len(chosen)))
            room -= row["size"]
    if not chosen:
        return [], np.zeros(0, np.float32)
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame(chosen, f"doc_id {kind}, key long, mark int, place int")
    texts = keyed.join(F.broadcast(wanted), ["doc_id", "key"]).groupBy("place").agg(F.first("whole").alias("whole"))
    found = {r["place"]: bytes(r["whole"]) for r in texts.collect()}
    return [found[k] for k in range(len(chosen))], np.array([c[2] for c in chosen], np.float32)
