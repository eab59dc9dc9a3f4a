"""The N best items of every group, however large the groups are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waxmill.session import materialize

#: Score classes of the histograms; more give a tighter threshold, never another result.
SCORE_CLASSES = 64
#: At most so many groups, the largest, get a threshold, which is a row of two numbers sent to every task.
MOST_THRESHOLDS = 20_000
#: Groups of fewer items than this many times N need no threshold.
LEAST_FACTOR = 16


def top_n(items: DataFrame, group: str, item: str, score: str, tie: str, n: int, classes: int = SCORE_CLASSES) -> DataFrame:
    """group, rank_no, item, score, tie: the n items of every group with the highest scores, numbered from 1.

    Each item counts once per group, represented by its row with the highest score, then the smallest tie key; equal scores
    are ordered by the smaller tie key, then the smaller item. Rows whose group, item, score or tie key is null, or whose
    score is not a number, are left out; groups of fewer items are returned whole; an empty table gives an empty result; other columns are
    ignored.

    A histogram of each large group over score classes (the same class edges for all groups, quantiles of all scores) gives the
    highest class edge above which the group still has n items. Groups are large from (all items) / MOST_THRESHOLDS items on, so that
    there are no more than MOST_THRESHOLDS of them, whose thresholds are broadcast: items below drop out where they are read. Then
    every task keeps its n best of each group before the shuffle, so that a group of any size, or any number of ties, is n rows per task there.
    """
    rows = items.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"), F.col(tie).alias("t")).dropna().filter(~F.isnan("s"))
    best = materialize(rows.groupBy("g", "i").agg(F.min(F.struct((-F.col("s")).alias("s"), F.col("t").alias("t"))).alias("b")).select("g", "i", (-F.col("b.s")).alias("s"), F.col("b.t").alias("t")), "topn")
    total, edges = best.agg(F.count("*"), F.percentile_approx("s", [k / classes for k in range(1, classes)], 10_000)).first()
    edges = sorted(set(edges or []))
    kind = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= F.col("s"))) if edges else F.lit(0)
    thresholds = F.broadcast(_thresholds(best.select("g", kind.alias("class")), n, max(LEAST_FACTOR * n, total // MOST_THRESHOLDS)))
    survivors = best.withColumn("class", kind).join(thresholds, "g", "left").filter(F.col("least").isNull() | (F.col("class") >= F.col("least")))
    place = Window.partitionBy("g").orderBy(F.desc("s"), "t", "i")
    ranked = survivors.withColumn("rank_no", F.row_number().over(place)).filter(F.col("rank_no") <= n)
    return ranked.select(F.col("g").alias(group), "rank_no", F.col("i").alias(item), F.col("s").alias(score), F.col("t").alias(tie))


def _thresholds(classed: DataFrame, n: int, more_than: int) -> DataFrame:
    """g, least: for each group of more items the first class, from above, at which n items are reached.

    Counts are made per group and class before any shuffle, and a group is then a row of at most SCORE_CLASSES counts.
    """
    histogram = classed.groupBy("g", "class").agg(F.count("*").alias("n")).groupBy("g").agg(F.sum("n").alias("all"), F.collect_list(F.struct("class", "n")).alias("counts")).filter(F.col("all") > more_than)
    down = F.reverse(F.array_sort("counts"))
    # the items down to each class, until there are n
    reached = F.aggregate(down, F.struct(F.lit(0).cast("bigint").alias("so_far"), F.lit(0).alias("least")), lambda a, c: F.when(a["so_far"] >= n, a).otherwise(F.struct((a["so_far"] + c["n"]).alias("so_far"), c["class"].alias("least"))))
    return histogram.select("g", reached["least"].alias("least"))
