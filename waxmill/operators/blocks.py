"""Candidates by shared blocks of fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waxmill.functions.similarity import matching_ratio
from waxmill.functions.text import blocks
from waxmill.operators.ranking import keep_best
from waxmill.operators.skew import ROW_SHARE, heavy_keys
from waxmill.session import default_partitions


def block_index(fingerprints: DataFrame, key: str, fingerprint: str = "fingerprint") -> DataFrame:
    """key, pos, block: a row for each block of each fingerprint."""
    return fingerprints.select(F.col(key), F.posexplode(blocks(fingerprint)).alias("pos", "block"))


def block_candidates(probes: DataFrame, index: DataFrame, probe: str, key: str, least: int, row_share: float = ROW_SHARE) -> DataFrame:
    """probe, key, shared: all pairs with at least `least` distinct blocks in common.

    probes (probe, block) and index (key, block). Blocks that hold row_share of the index are heavy, which decides how their pairs are made and
    never whether: of two sets that share `least` blocks, some shared block is left when least - 1 of the probe's are set aside, so each probe's
    heaviest ones make no pairs and are compared afterwards, for the pairs there are. Pairs of the other heavy blocks are made in parts, by
    a hash of the key; light blocks are joined as they are.
    """
    left = probes.select(probe, "block").dropna().distinct()
    right = index.select(key, "block").dropna().distinct()
    heavy = heavy_keys(right, "block", row_share)
    # at most 2 / row_share blocks
    weights = F.broadcast(right.join(F.broadcast(heavy), "block", "left_semi").groupBy("block").agg(F.count("*").alias("__n")))
    heaviest = Window.partitionBy(probe).orderBy(F.desc("__n"), "block")
    hot = left.join(weights, "block").withColumn("__place", F.row_number().over(heaviest))
    parts = default_partitions(left.sparkSession)
    spread = hot.filter(F.col("__place") >= least).select(probe, "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part"))
    held = right.join(weights, "block", "left_semi")
    placed = held.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    met_hot = spread.repartition(parts, "block", "__part").join(placed.repartition(parts, "block", "__part"), ["block", "__part"])
    met_light = left.join(weights, "block", "left_anti").join(right.join(weights, "block", "left_anti"), "block")
    met = met_light.select(probe, key).unionByName(met_hot.select(probe, key)).groupBy(probe, key).agg(F.count("*").alias("__met"))
    if least > 1:
        # at most least - 1 and 2 / row_share blocks
        aside = hot.filter(F.col("__place") < least).groupBy(probe).agg(F.collect_set("block").alias("__a"))
        met = met.join(aside, probe, "left").join(held.groupBy(key).agg(F.collect_set("block").alias("__b")), key, "left")
        met = met.withColumn("__met", F.col("__met") + F.coalesce(F.size(F.array_intersect("__a", "__b")), F.lit(0)))
    return met.select(probe, key, F.col("__met").cast("bigint").alias("shared")).filter(F.col("shared") >= least)


def best_match(pairs: DataFrame, probe: str, key: str, a: Column, b: Column, least: float = 0.0, autojunk: bool = True) -> DataFrame:
    """probe, key, ratio: of each probe's pairs the one of the highest similarity, then the smallest key; at least `least`."""
    rated = pairs.withColumn("ratio", matching_ratio(a, b, autojunk)).filter(F.col("ratio") >= least)
    return keep_best(rated, [probe], [F.desc("ratio"), F.asc(key)]).select(probe, key, "ratio")
