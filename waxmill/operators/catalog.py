"""Changes to catalogue tables as new snapshots: nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waxmill.functions.text import blocks
from waxmill.operators.ranking import keep_best


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """existing and the incoming rows of new keys, of several the first in this order."""
    fresh = keep_best(incoming, keys, order).join(existing.select(*keys).distinct(), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """existing with whole rows replaced by the incoming ones of the same keys, of several the first in this order.

    Columns that incoming lacks become null, as a replaced row keeps nothing.
    """
    winners = keep_best(incoming, keys, order)
    return existing.join(winners.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(winners.select(*(c for c in existing.columns if c in winners.columns)), allowMissingColumns=True)


def delete_keys(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """existing without the rows of these keys."""
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti").select(*existing.columns)


def repoint(existing: DataFrame, changes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """existing with `column` replaced where changes (one row a key) hold a value for the key."""
    new = changes.select(*keys, F.col(column).alias("__new"))
    return existing.join(new, keys, "left").withColumn(column, F.coalesce("__new", column)).select(*existing.columns)


def reindex(index: DataFrame, fingerprints: DataFrame, key: str) -> DataFrame:
    """index (block, key, pos) with all blocks of the keys in fingerprints (key, fingerprint) replaced."""
    fresh = fingerprints.select(F.col(key), F.posexplode(blocks("fingerprint")).alias("pos", "block"))
    return delete_keys(index, fingerprints, [key]).unionByName(fresh.select(*index.columns))


def add_blocks_of_new(known: DataFrame, fingerprints: DataFrame, key: str) -> DataFrame:
    """known (block, key, pos) and the blocks of those keys that have none yet."""
    fresh = fingerprints.join(known.select(key).distinct(), key, "left_anti")
    return known.unionByName(fresh.select(F.col(key), F.posexplode(blocks("fingerprint")).alias("pos", "block")).select(*known.columns))


def prune(tables: dict[str, tuple[DataFrame, str]], manifest: DataFrame, path: str = "path") -> dict[str, DataFrame]:
    """Each table (rows, name of its path column) without the rows whose path is in no row of the manifest."""
    there = manifest.select(F.col(path).alias("__path")).distinct()
    return {name: rows.join(there, F.col(column) == F.col("__path"), "left_semi") for name, (rows, column) in tables.items()}


def add_missing_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with those of the columns (name: type) that it lacks, null."""
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in columns.items() if name not in df.columns})


def stamped(before: DataFrame, after: DataFrame, keys: list[str], column: str, now: Column | None = None) -> DataFrame:
    """after, with `column` set to the time of writing in the rows that are new or differ from before (one row a key each)."""
    values = [c for c in after.columns if c not in (*keys, column)]
    old = before.select(*keys, F.struct(*values).alias("__old"))
    joined = after.join(old, keys, "left")
    same = F.col("__old").isNotNull() & F.col("__old").eqNullSafe(F.struct(*values))
    return joined.withColumn(column, F.when(same, F.col(column)).otherwise(now if now is not None else F.current_timestamp())).select(*after.columns)


def create_missing(spark: SparkSession, folder: str, schemas: dict[str, StructType]) -> list[str]:
    """Write an empty first snapshot of every table that has none, and return their names; tables that exist are left alone."""
    made = [name for name in schemas if latest_snapshot(spark, f"{folder}/{name}") is None]
    for name in made:
        write_snapshot(spark.createDataFrame([], schemas[name]), f"{folder}/{name}", 0)
    return made


def write_snapshot(df: DataFrame, folder: str, version: int) -> str:
    """Write a table's new version beside the earlier ones; readers take the latest whose _SUCCESS exists, so a failed write changes nothing."""
    target = f"{folder}/version={version:012d}"
    df.write.mode("overwrite").parquet(target)
    return target


def _complete_versions(spark: SparkSession, folder: str) -> list[str]:
    """The folders of the complete versions, oldest first."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/_SUCCESS"))
    return sorted(str(s.getPath().getParent()) for s in done or [])


def latest_snapshot(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The latest complete version, or the latest of a smaller number than `before`; None if there is none."""
    versions = [v for v in _complete_versions(spark, folder) if before is None or int(v.rpartition("=")[2]) < before]
    return spark.read.parquet(versions[-1]) if versions else None


def drop_versions(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Delete all but the latest `keep` complete versions; how many were deleted. What still reads an older one fails."""
    old = _complete_versions(spark, folder)[:-keep]
    for path in old:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return len(old)
