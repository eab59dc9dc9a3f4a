"""Ranks, running values and best rows, also where one group holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waxmill.session import materialize


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in this order (make it total). Only one row per key and task is shuffled. Null keys are a group."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__place = 1").drop("__place")


def best_value(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """keys, name: the largest `value` (a struct to choose by) of each key, combined before the shuffle."""
    return df.groupBy(*keys).agg(F.max(value).alias(name))


def losers(df: DataFrame, keys: list[str], id: str, order: list[Column]) -> DataFrame:
    """The rows that keep_best leaves out, with `winner`, the id of the row it keeps."""
    best = keep_best(df, keys, order).select(*keys, F.col(id).alias("winner"))
    return df.join(best, keys).filter(F.col(id) != F.col("winner"))


def _sliced(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """df in ordered slices, `__slice` being their numbers: a large group is spread over several of them."""
    slices = df.repartitionByRange(*(F.col(g).asc_nulls_first() for g in group), *order).withColumn("__slice", F.spark_partition_id())
    return materialize(slices, "slices")


def distributed_rank(df: DataFrame, group: list[str], order: list[Column], name: str = "rank_no") -> DataFrame:
    """Adds the row number (from 1) within the group in this order, without bringing a group together in one task.

    Rows are sorted into ordered slices over all tasks; a row's number is its number in its slice plus the rows of the
    group in earlier slices, a table of one row per group and slice. Rows that tie in the whole order are numbered in any order. group may be empty.
    """
    rows = _sliced(df, group, order)
    keys = [F.col(g) for g in group]
    counts = rows.groupBy(*group, "__slice").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy(*keys, F.col("__slice")).orderBy(*order))
    joined = rows.withColumn("__within", within).alias("r").join(before.alias("b"), [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, "__slice")])
    return joined.select(*(F.col(f"r.{c}") for c in df.columns), (F.col("__before") + F.col("__within")).alias(name))


def running_max(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the largest value so far over all rows in this order, slice by slice in parallel."""
    rows = _sliced(df.withColumn("__value", value), [], order)
    tops = rows.groupBy("__slice").agg(F.max("__value").alias("__top"))
    # one row per slice
    carried = tops.withColumn("__carried", F.max("__top").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))).drop("__top")
    so_far = F.max("__value").over(Window.partitionBy("__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("__so_far", so_far).join(carried, "__slice")
    return joined.select(*df.columns, F.greatest("__so_far", "__carried").alias(name))


def paginate(df: DataFrame, order: list[Column], size: int = 10) -> DataFrame:
    """Adds row_no (from 1) over all rows and page_no (from 0)."""
    ranked = distributed_rank(df, [], order, "row_no")
    return ranked.withColumn("page_no", F.floor((F.col("row_no") - 1) / size).cast("int"))


def rate_slots(events: DataFrame, ts_us: str, id: str, gap_us: int) -> DataFrame:
    """Adds slot_us: the earliest times, at least a gap apart and not before the event, that a first-come limiter gives.

    With n the place of an event, its slot is the largest (time - gap * place) so far, plus gap * n.
    """
    order = [F.col(ts_us).asc_nulls_first(), F.col(id).asc_nulls_first()]
    placed = distributed_rank(events, [], order, "__n")
    reached = running_max(placed, order, F.col(ts_us) - F.col("__n") * F.lit(gap_us), "__m")
    return reached.select(*events.columns, (F.col("__m") + F.col("__n") * F.lit(gap_us)).alias("slot_us"))


def carry_forward(df: DataFrame, run: list[str], order: list[Column], touched: Column, value: Column, name: str) -> DataFrame:
    """Adds the value of the last earlier row of the run that was touched; a touched row may set it to null.

    A run of any length is spread over ordered slices: within a slice the value is carried along, and a table of one row per run
    and slice says what comes in from the slices before.
    """
    rows = _sliced(df.withColumn("__touch", F.when(touched, F.struct(value.alias("v")))), run, order)
    keys = [F.col(r) for r in run]
    here = Window.partitionBy(*keys, F.col("__slice")).orderBy(*order)
    ends = rows.withColumn("__last", F.last("__touch", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = ends.groupBy(*run, "__slice").agg(F.any_value("__last").alias("__last"))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__carried", F.last("__last", ignorenulls=True).over(earlier)).drop("__last")
    so_far = F.last("__touch", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1))
    joined = rows.withColumn("__so_far", so_far).alias("r").join(carried.alias("c"), [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*run, "__slice")])
    return joined.select(*(F.col(f"r.{c}") for c in df.columns), F.coalesce("__so_far", "__carried")["v"].alias(name))


def every_nth(df: DataFrame, order: list[Column], n: int, name: str = "batch_no") -> DataFrame:
    """Adds the number (from 0) of the row's batch of n rows in this order."""
    ranked = distributed_rank(df, [], order, "__n")
    return ranked.withColumn(name, F.floor((F.col("__n") - 1) / n).cast("bigint")).drop("__n")


def number_collisions(df: DataFrame, target: list[str], order: list[Column], taken: DataFrame | None = None) -> DataFrame:
    """Adds collision_no: 0 for the first row of a target name, then 1, 2, ...; one more where the target is among `taken`.

    A name that very many rows have is numbered in slices (see distributed_rank).
    """
    numbered = distributed_rank(df, target, order, "collision_no").withColumn("collision_no", F.col("collision_no").cast("int") - 1)
    if taken is None:
        return numbered
    existing = taken.select(*target).distinct().withColumn("__taken", F.lit(1))
    return numbered.join(existing, target, "left").withColumn("collision_no", (F.col("collision_no") + F.coalesce("__taken", F.lit(0))).cast("int")).drop("__taken")


def is_last(df: DataFrame, group: list[str], order: list[Column], name: str = "is_last") -> DataFrame:
    """Adds whether the row is the last of its (small) group."""
    ahead = F.lead(F.lit(1)).over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, ahead.isNull())
