"""References to records that do not exist, or that came later than the reference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Parent:
    """A table that is referred to: its rows, the key, and the period in which a row came."""

    name: str
    rows: DataFrame
    key: Column
    period: Column


@dataclass(frozen=True)
class Reference:
    """A column that refers to a parent's key."""

    table: str
    rows: DataFrame
    key: Column
    period: Column
    parent: str


def orphan_references(parents: list[Parent], references: list[Reference]) -> DataFrame:
    """table_name, ref_key, period, kind, n_rows: every reference whose target is in no row (`missing`) or whose target's
    first period is after the referring row's (`late`).

    Parent and child keys are united in one long table of (parent, key, tag, period), which is counted before it is shuffled,
    so that a key referred to by a third of all rows is a handful of rows per task; the parent flag and first period of a
    key are then found over its few (table, period) rows. Null keys refer to nothing. A null period is before all others on
    the referring side and unknown, hence not late, on the parent's side. Repeated rows add to n_rows only.
    """
    long = None
    for p in parents:
        part = p.rows.select(F.lit(p.name).alias("parent"), p.key.alias("ref_key"), F.lit(None).cast("string").alias("table_name"), p.period.cast("int").alias("period"))
        long = part if long is None else long.unionByName(part)
    for r in references:
        part = r.rows.select(F.lit(r.parent).alias("parent"), r.key.alias("ref_key"), F.lit(r.table).alias("table_name"), r.period.cast("int").alias("period"))
        long = part if long is None else long.unionByName(part)
    counted = long.filter(F.col("ref_key").isNotNull()).groupBy("parent", "ref_key", "table_name", "period").agg(F.count("*").alias("n_rows"))
    same_key = Window.partitionBy("parent", "ref_key")
    is_parent = F.col("table_name").isNull()
    flagged = counted.withColumns(
        {
            "has_parent": F.max(is_parent).over(same_key),
            "unknown_period": F.coalesce(F.max(is_parent & F.col("period").isNull()).over(same_key), F.lit(False)),
            "first_period": F.min(F.when(is_parent, F.col("period"))).over(same_key),
        }
    ).filter(~is_parent)
    late = ~F.col("unknown_period") & (F.col("period").isNull() | (F.col("first_period") > F.col("period")))
    kind = F.when(~F.col("has_parent"), "missing").when(late, "late")
    return flagged.select("table_name", "ref_key", "period", kind.alias("kind"), "n_rows").filter(F.col("kind").isNotNull())


def orphan_summary(orphans: DataFrame) -> DataFrame:
    """table_name, period, kind, n_keys, n_rows: orphan references per table and period."""
    return orphans.groupBy("table_name", "period", "kind").agg(F.count("*").alias("n_keys"), F.sum("n_rows").alias("n_rows"))
