"""Upkeep: files without a hash, rows without a file, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waxmill.functions.text import stem


def missing_hashes(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """The files (path) that no row of hashes (path) names."""
    return files.join(hashes.select("path").distinct(), "path", "left_anti")


def ghosts(tables: dict[str, DataFrame], manifest: DataFrame) -> DataFrame:
    """table_name, path: what tables hold and the manifest doesn't."""
    there = manifest.select("path").distinct()
    parts = [df.select(F.lit(name).alias("table_name"), "path").filter(F.col("path").isNotNull()).distinct().join(there, "path", "left_anti").select("table_name", "path") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def repair_status(decoded: Column, duration: Column) -> Column:
    """OK, ERROR (can't be decoded) or DELETED (decoded to nothing)."""
    return F.when(~F.coalesce(decoded, F.lit(False)), "ERROR").when(F.coalesce(duration > 0, F.lit(False)), "OK").otherwise("DELETED")


def repair_plan(files: DataFrame, target: str) -> DataFrame:
    """path, dst, arguments: one conversion to FLAC per file (path), sound only, without metadata, decoding errors passed over; `repair_status` judges its result."""
    dst = F.concat(F.lit(target.rstrip("/") + "/"), stem("path"), F.lit(".flac"))
    return files.select("path", dst.alias("dst"), F.array(F.lit("-err_detect"), F.lit("ignore_err"), F.lit("-i"), F.col("path"), *map(F.lit, ("-vn", "-map_metadata", "-1", "-c:a", "flac", "-y")), dst).alias("arguments"))


def write_report(results: DataFrame, folder: str) -> None:
    """The failures as lines of text."""
    results.filter(F.col("status") != "OK").select(F.concat_ws("\t", "status", "path", "message").alias("value")).write.mode("overwrite").text(folder)
