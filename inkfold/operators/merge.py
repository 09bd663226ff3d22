"""Mutations of keyed tables as new snapshots: upsert, insert if absent, patches, cascading deletes, sweeps.

Each is a function of the present table and the changes. `Snapshots` stores the results as versioned Parquet folders, of which
a reader sees the last whole one; `Log` stores batches side by side. Versions of several tables are not one transaction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Policy = Callable[[Column, Column, Column], Column]


def take_new(old: Column, new: Column, hit: Column) -> Column:
    return F.when(hit, new).otherwise(old)


def keep_old(old: Column, new: Column, hit: Column) -> Column:
    return old


def coalesce_new(old: Column, new: Column, hit: Column) -> Column:
    """The new value unless it is null."""
    return F.coalesce(new, old)


def reset(old: Column, new: Column, hit: Column) -> Column:
    """Null wherever the row was replaced."""
    return F.when(~hit, old)


def flagged(flag: str) -> Policy:
    """The new value, null or not, where the change's flag is true."""
    return lambda old, new, hit: F.when(hit & F.coalesce(F.col(f"n.{flag}"), F.lit(False)), new).otherwise(old)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], policy: dict[str, Policy] | None = None, default: Policy = take_new, insert: bool = True) -> DataFrame:
    """One row for each key of both. A row of both is merged column by column; a row of changes alone is inserted (its missing
    columns null) unless insert is off. Keys must be unique in each input."""
    policy = policy or {}
    n = changes.withColumn("_hit", F.lit(True))
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    met = table.withColumn("_had", F.lit(True)).alias("o").join(n.alias("n"), on, "full" if insert else "left")
    had, hit = F.coalesce(F.col("_had"), F.lit(False)), F.coalesce(F.col("_hit"), F.lit(False))
    out = []
    for c in table.columns:
        old, new = F.col(f"o.{c}"), F.col(f"n.{c}") if c in changes.columns else F.lit(None).cast(table.schema[c].dataType)
        if c in keys:
            out.append(F.when(had, old).otherwise(new).alias(c))
        elif c in changes.columns or c in policy:
            out.append(F.when(had, policy.get(c, default)(old, new, hit)).otherwise(new).alias(c))
        else:
            out.append(old.alias(c))
    return met.select(*out)


def new_only(table: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The incoming rows whose key the table does not have, the first of each key."""
    from .lookup import first_per

    return first_per(incoming.where(" and ".join(f"{k} is not null" for k in keys)), keys, order).join(table.select(*keys), keys, "left_anti")


def patch(table: DataFrame, changes: DataFrame, key: str, allowed: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Set what a change's map holds: changes (key, values map<string,string>). Names outside `allowed` are ignored; each
    value goes through its column's normaliser. A row whose map has no allowed name stays as it is."""
    wanted = [c for c in table.columns if c in allowed]
    met = table.join(changes.select(F.col(key).alias("_key"), F.col("values").alias("_values")), F.col(key) == F.col("_key"), "left")
    has = lambda c: F.coalesce(F.map_contains_key("_values", c), F.lit(False))
    return met.select(*[F.when(has(c), allowed[c](F.col("_values")[c])).otherwise(F.col(c)).alias(c) if c in wanted else F.col(c) for c in table.columns])


def delete_cascade(keys: DataFrame, key: str, cascade: dict[str, tuple[DataFrame, str]], clear: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """The tables without the rows of the given keys: rows of `cascade` go, references in `clear` become null."""
    gone = keys.select(F.col(key).alias("_gone")).distinct()
    out = {name: df.join(gone, df[on] == gone._gone, "left_anti") for name, (df, on) in cascade.items()}
    for name, (df, on) in clear.items():
        met = df.join(gone, df[on] == gone._gone, "left")
        out[name] = met.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == on else F.col(c) for c in df.columns])
    return out


def sweep(table: DataFrame, column: str, normal: Callable[[Column], Column]) -> DataFrame:
    """table with the column normalised, and `changed`: whether it differs from before. Only changed rows need a write."""
    new = table.withColumn("_new", normal(F.col(column)))
    return new.withColumn("changed", ~F.col("_new").eqNullSafe(F.col(column))).withColumn(column, F.col("_new")).drop("_new")


def evolved(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """table with the columns that it lacks, null, of the given types."""
    return table.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in table.columns])


def with_hashes(cards: DataFrame, files: DataFrame, path: str = "original_image_path", sha: str = "original_sha256") -> DataFrame:
    """Missing hashes filled from file contents: files (path, content). A card whose file is missing stays without."""
    known = files.select(F.col("path").alias("_path"), F.sha2("content", 256).alias("_sha"))
    met = cards.join(known, cards[path] == known._path, "left")
    return met.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("_sha")).alias(c) if c == sha else F.col(c) for c in cards.columns])


class Snapshots:
    """Versioned tables in a folder that Spark's file systems reach. A version is a numbered folder, whole once Spark has
    written its success file; the greatest whole one is read, so there is always one and a crash leaves the version before.
    One writer at a time for a table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _versions(self, name: str) -> list[int]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(p.getName()[1:]) for p in found if p.getName()[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def version(self, name: str) -> int | None:
        return max(self._versions(name), default=None)

    def read(self, name: str, empty: DataFrame | None = None) -> DataFrame | None:
        version = self.version(name)
        return empty if version is None else self.spark.read.parquet(f"{self.root}/{name}/v{version}")

    def write(self, name: str, df: DataFrame) -> int:
        """The table's next version."""
        version = (self.version(name) or 0) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{version}")  # over what a crash left there
        return version


class Log:
    """A table that only grows: each batch is a folder of its own, written once under the batch's number. Written again after a
    crash, it holds the same rows; earlier batches are never rewritten."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: T.StructType):
        self.spark, self.at, self.schema = spark, f"{root}/{name}", schema

    def read(self, but: int | None = None) -> DataFrame:
        """All rows; `but` leaves out one batch."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.at)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])).parquet(self.at)
        return (rows if but is None else rows.where(F.col("batch") != but)).drop("batch")

    def append(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.at}/batch={batch}")
