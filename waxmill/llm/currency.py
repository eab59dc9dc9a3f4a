"""Which of several versions of a record is the current one, and its values where times can't tell.

Versions are ordered by their timestamps. Where the latest place is shared, by equal times or because all are missing, currency reasoning
takes over: from the timestamped histories of all records it learns which value of an attribute follows which (a file goes from
unprocessed to processed, an unknown format becomes known, ...) and drops precedences that contradict stronger ones. What is left is a
partial order of values; in each group of versions it orders the values that occur there. Field by field the topologically
latest value is taken: one that no other value of the group follows. Values that the order doesn't relate stay incomparable, and are
decided between by the version as a whole.

Groups without such a tie are settled by their times alone, and if there is no tie at all nothing is learned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waxmill.session import materialize


@dataclass(frozen=True)
class Precedence:
    """later: per attribute and value all values that follow it; support: per attribute the transitions behind it."""

    later: dict[str, dict[str, set[str]]]
    support: dict[str, int]


def _closed(edges: list[tuple[str, str, int]]) -> tuple[dict[str, set[str]], int]:
    """All that follows each value along the accepted edges, and their weight. Stronger edges are taken first; one that would close a cycle contradicts them and is dropped."""
    after: dict[str, set[str]] = {}
    total = 0
    for earlier, later, net in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if earlier in after.get(later, ()):
            continue
        total += net
        gained = {later} | after.get(later, set())
        for x in [earlier, *(x for x, follows in after.items() if earlier in follows)]:
            after.setdefault(x, set()).update(gained)
    return after, total


def learn_precedence(rows: DataFrame, entity: str, ts: str, states: list[str]) -> Precedence:
    """Learn value-transition precedence from the timestamped rows.

    states: columns of text with few distinct values each (classes of values, say); the (column, from, to) counts that reach
    the driver are bounded by the squares of those numbers, never by the rows. Rows without a timestamp or entity and null
    values teach nothing. A value follows another if it did so more often than the reverse.
    """
    in_time = Window.partitionBy(entity).orderBy(ts)
    dated = rows.filter(F.col(ts).isNotNull() & F.col(entity).isNotNull()).select(entity, ts, *states)
    previous = dated.select("*", *(F.lag(s).over(in_time).alias(f"__before_{s}") for s in states), F.lag(ts).over(in_time).alias("__before"))
    moves = F.array(*(F.struct(F.lit(s).alias("column"), F.col(f"__before_{s}").alias("earlier"), F.col(s).alias("later")) for s in states))
    changed = previous.filter(F.col("__before") < F.col(ts)).select(F.explode(F.filter(moves, lambda m: m["earlier"] != m["later"])).alias("m"))
    counts = {(r["column"], r["earlier"], r["later"]): r["n"] for r in changed.groupBy("m.column", "m.earlier", "m.later").agg(F.count("*").alias("n")).collect()}
    later, support = {}, {}
    for s in states:
        net = [(a, b, n - counts.get((s, b, a), 0)) for (c, a, b), n in counts.items() if c == s]
        later[s], support[s] = _closed([e for e in net if e[2] > 0])
    return Precedence(later, support)


def tied_versions(rows: DataFrame, entity: str, ts: str) -> DataFrame:
    """entity hash, ts: where rows that differ share an entity and a time. A few numbers per row are shuffled, combined before it."""
    # the places of the values are hashed with them, as null values leave a hash as it is
    row = F.xxhash64(*(x for i, c in enumerate(rows.columns) for x in (F.lit(i), F.col(c))))
    at = rows.filter(F.col(entity).isNotNull()).select(F.xxhash64(entity).alias("__entity"), F.col(ts).alias("__ts"), row.alias("__row"))
    ends = at.groupBy("__entity", "__ts").agg(F.min("__row").alias("a"), F.max("__row").alias("b"))
    return ends.filter(F.col("a") != F.col("b")).select("__entity", "__ts")


def current_versions(rows: DataFrame, entity: str, ts: str, states: dict[str, Column], precedence: Precedence | None = None) -> DataFrame:
    """One row for each entity, with all columns of `rows`: its current version.

    The row with the latest timestamp (null is earliest). Where different rows share that place, each column named in `states` takes
    its topologically latest value among them by the learned precedence, the other columns those of one of them: the row with a latest
    value in the best supported attribute, then the next, and at last by all its values, so that the choice never depends
    on where rows are stored. Rows without an entity are left out. Repeated rows count once.

    states: by column the attribute to reason about, an expression of few values (a class of the column's values, say).
    """
    kept = rows.columns
    ties = materialize(tied_versions(rows, entity, ts), "ties")
    by_value = [F.col(c).desc_nulls_last() for c in sorted(kept) if c not in (entity, ts)]
    latest = Window.partitionBy(entity).orderBy(F.col(ts).desc_nulls_last(), *by_value)
    first = rows.filter(F.col(entity).isNotNull()).withColumn("__place", F.row_number().over(latest)).filter(F.col("__place") == 1).drop("__place")
    if ties.isEmpty():
        return first
    open_entities = _open(first, ties, entity, ts)
    names = {f"__state_{i}": expression.cast("string") for i, expression in enumerate(states.values())}
    column_of = dict(zip(names, states, strict=True))
    order = precedence or learn_precedence(rows.withColumns(names), entity, ts, list(names))
    ranked = sorted(names, key=lambda s: -order.support.get(s, 0))
    tied = rows.withColumns(names).join(open_entities, F.col(entity).eqNullSafe(F.col("__key")) & F.col(ts).eqNullSafe(F.col("__ts")), "left_semi")
    # the few values of each attribute that occur in a group
    there = tied.groupBy(F.col(entity).alias("__key")).agg(*(F.collect_set(s).alias(f"__all{s}") for s in names))
    both = tied.join(there, F.col(entity) == F.col("__key"))

    def undominated(s: str) -> Column:
        """Whether no value of the group follows this one."""
        follows = order.later.get(s) or {}
        if not follows:
            return F.lit(True)
        table = F.create_map(*(x for v, after in sorted(follows.items()) for x in (F.lit(v), F.array(*(F.lit(a) for a in sorted(after))))))
        return ~F.coalesce(F.arrays_overlap(F.try_element_at(table, F.col(s)), F.col(f"__all{s}")), F.lit(False))

    both = both.withColumns({f"__top{s}": undominated(s) for s in names})
    values = [F.col(c).isNotNull() for c in sorted(kept)] + [F.col(c) for c in sorted(kept)]
    whole = F.struct(*(F.col(f"__top{s}").alias(f"t{i}") for i, s in enumerate(ranked)), *(v.alias(f"v{i}") for i, v in enumerate(values)))
    field = {column_of[s]: F.max_by(F.struct(F.col(column_of[s]).alias("v")), F.struct(F.col(f"__top{s}").alias("top"), whole.alias("whole")))["v"] for s in names}
    built = both.groupBy("__key").agg(F.max_by(F.struct(*kept), whole).alias("__row"), *(e.alias(f"__field_{c}") for c, e in field.items()))
    built = built.select(*(F.col(f"__field_{c}").alias(c) if c in field else F.col(f"__row.{c}").alias(c) for c in kept))
    settled = first.join(open_entities.select("__key"), F.col(entity) == F.col("__key"), "left_anti")
    return settled.select(*kept).unionByName(built)


def _open(first: DataFrame, ties: DataFrame, entity: str, ts: str) -> DataFrame:
    """__key, __ts: the entities whose latest place is shared by rows that differ."""
    latest = first.select(F.col(entity).alias("__key"), F.xxhash64(entity).alias("__h"), F.col(ts).alias("__ts"))
    at = ties.withColumnsRenamed({"__ts": "__tie_ts"})
    return materialize(latest.join(at, (F.col("__h") == F.col("__entity")) & F.col("__ts").eqNullSafe(F.col("__tie_ts")), "left_semi").select("__key", "__ts"), "open")
