"""Per-key results when a few keys hold most rows.

Keys that hold a large share of the rows are found with a frequent-items sketch (one mergeable pass of fixed memory), sent to
every task as a broadcast of at most 1/row_share keys, and counted on the pair (key, owner), which spreads one key over all
tasks. All other keys go through one ordinary shuffle on the key alone. The two parts are united; no row is dropped or sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waxmill.session import materialize

#: A key with at least this share of the rows is treated as heavy; there can be at most 1/ROW_SHARE of them.
ROW_SHARE = 0.002


def heavy_keys(df: DataFrame, key: str, row_share: float = ROW_SHARE) -> DataFrame:
    """The keys that may hold at least row_share of df's rows, as a one-column table of at most 2/row_share rows.

    The sketch overestimates a count by less than row_share/8 of the rows and never misses a key above that share. It only
    decides how a key is processed, never what its result is. Null keys are not looked at.
    """
    spark = df.sparkSession
    tracked = 1 << max(10, int(12 / row_share).bit_length())
    most = min(int(2 / row_share), tracked)
    found = df.filter(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k({key}, {most}, {tracked})").alias("top"), F.count("*").alias("n")).first()
    rows = [(x["item"],) for x in found["top"] or [] if x["count"] >= row_share * found["n"]]
    return spark.createDataFrame(rows, df.select(F.col(key)).schema)


def _owned(df: DataFrame, key: str, owner: str) -> DataFrame:
    """key and the owner as 128 bits of its hash (a, b), written once so that expressions for keys and owners are not computed in every pass; rows without an owner left out."""
    pairs = df.select(F.col(key).alias("key"), F.col(owner).alias("owner")).filter(F.col("owner").isNotNull())
    # chained hashes: with the constant first, the second doesn't follow from the first
    return materialize(pairs.select("key", F.xxhash64("owner").alias("a"), F.xxhash64(F.lit(1), "owner").alias("b")), "owned")


def _counted(owned: DataFrame, row_share: float) -> DataFrame:
    pairs = owned.filter(F.col("key").isNotNull())
    heavy = F.broadcast(heavy_keys(pairs, "key", row_share))
    hot = pairs.join(heavy, "key", "left_semi").dropDuplicates(["key", "a", "b"])
    cold = pairs.join(heavy, "key", "left_anti").repartition("key").dropDuplicates(["key", "a", "b"])
    counted = [part.groupBy("key").agg(F.count("*").alias("owners")) for part in (hot, cold)]
    return counted[0].unionByName(counted[1])


def distinct_owner_counts(df: DataFrame, key: str, owner: str, row_share: float = ROW_SHARE) -> DataFrame:
    """key, owners: the number of distinct owners of every key, told apart by 128 bits of hash.

    Rows whose key or owner is null are left out; repeated rows count once; an empty table gives an empty result; other
    columns of df are ignored, whatever their names.
    """
    return _counted(_owned(df, key, owner), row_share).withColumnRenamed("key", key)


def widespread_keys(df: DataFrame, key: str, owner: str, share: float, row_share: float = ROW_SHARE) -> DataFrame:
    """key, owners, all_owners: the keys held by at least `share` of all distinct owners of df, with exact counts.

    Owners of rows with a null key count among all owners.
    """
    owned = _owned(df, key, owner)
    total = owned.select("a", "b").distinct().agg(F.count("*").alias("all_owners"))
    # one row of totals
    found = _counted(owned, row_share).join(F.broadcast(total), F.col("owners") >= F.col("all_owners") * F.lit(share), "inner")
    return found.withColumnRenamed("key", key)
