"""Filling fixed-capacity containers with texts.

Sizes are whole numbers of tokens up to the capacity, so the whole instance is a histogram of at most `capacity` counts, however
many documents there are. The plan is made on that histogram: first the reduction of Martello and Toth fixes, for all items of a
size at once, the sets that provably dominate every alternative; best fit (decreasing) places the rest, again whole counts at a
time. Documents then find their container by their size and their rank within it, in parallel.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waxmill.llm.tokens import DEFAULT_RANKS, token_counts
from waxmill.session import default_partitions, materialize

CAPACITY = 8192


@dataclass
class Plan:
    """Of the items of `size`, those of rank `first` to `first + n - 1` go to the containers from `bin` on, `each` to one."""

    capacity: int
    bins: int = 0
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    placed: dict[int, int] = field(default_factory=dict)
    fixed_bins: int = 0

    def place(self, size: int, n: int, first_bin: int, each: int) -> None:
        first = self.placed.get(size, 0)
        self.rows.append((size, first, n, first_bin, each))
        self.placed[size] = first + n

    def open(self, n: int) -> int:
        self.bins += n
        return self.bins - n


class _Counts:
    """Counts by size, with the sizes in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.sizes = sorted(self.n)

    def take(self, size: int, n: int) -> None:
        self.n[size] -= n
        if not self.n[size]:
            del self.n[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def largest(self, limit: int) -> int | None:
        at = bisect_left(self.sizes, limit + 1)
        return self.sizes[at - 1] if at else None

    def smallest(self, k: int, above: int = 0) -> list[int]:
        """The k smallest items larger than `above`."""
        out: list[int] = []
        for s in self.sizes[bisect_left(self.sizes, above + 1) :]:
            out += [s] * min(self.n[s], k - len(out))
            if len(out) == k:
                break
        return out

    def best_pair(self, room: int) -> tuple[int, int] | None:
        """The two items of the largest sum that fit, of these the one with the largest item."""
        best, lo, hi = None, 0, len(self.sizes) - 1
        while lo <= hi:
            a, b = self.sizes[hi], self.sizes[lo]
            if a + b > room or (lo == hi and self.n[a] < 2):
                hi -= 1
            else:
                if best is None or (a + b, a) > (sum(best), best[0]):
                    best = (a, b)
                lo += 1
        return best


def _dominating(rest: _Counts, size: int, capacity: int) -> tuple[int, ...] | None:
    """The companions of an item of `size` (already taken out of rest) that dominate all others; None if the criterion finds none."""
    room = capacity - size
    small = rest.smallest(3)
    fit = sum(np.cumsum(small) <= room) if small else 0
    if fit == 0:
        return ()
    most = rest.largest(room)
    if fit == 1 or most == room:
        return (most,)
    if fit == 2:
        a, b = rest.best_pair(room)
        if most >= a + b:
            return (most,)
        if a == most:
            larger = rest.smallest(2, above=b)
            if len(larger) < 2 or sum(larger) > room:
                return (a, b)
    return None


def reduce_dominated(counts: dict[int, int], plan: Plan) -> dict[int, int]:
    """Fix dominating sets in the plan; the counts that remain. Sweeps from the largest size down until nothing more is fixed."""
    rest, changed = _Counts(counts), True
    while changed:
        changed = False
        for size in sorted(rest.sizes, reverse=True):
            while size in rest.n:
                rest.take(size, 1)
                others = _dominating(rest, size, plan.capacity)
                if others is None:
                    rest.n[size] = rest.n.get(size, 0) + 1
                    if rest.n[size] == 1:
                        insort(rest.sizes, size)
                    break
                # the same set stays dominating while all its sizes last; rest lacks one item of `size`
                need = {s: others.count(s) + (s == size) for s in {size, *others}}
                m = min((rest.n.get(s, 0) + (s == size)) // k for s, k in need.items())
                first = plan.open(m)
                for s, k in need.items():
                    plan.place(s, k * m, first, k)
                    if k * m - (s == size):
                        rest.take(s, k * m - (s == size))
                plan.fixed_bins += m
                changed = True
    return rest.n


def best_fit(counts: dict[int, int], plan: Plan) -> None:
    """Best fit in decreasing order: each item goes to the open container with the least room that still takes it.

    Items of one size fill containers of one room alike, so whole runs of containers are filled at a time.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, n))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                left = rooms[at]
                first, bins = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop(at)
            else:
                left, bins = plan.capacity, -(-n // (plan.capacity // size))
                first = plan.open(bins)
            each = left // size
            full = min(bins, n // each)
            if full:
                plan.place(size, full * each, first, each)
                put(left - each * size, first, full)
                n -= full * each
            if full < bins:
                if n:
                    # fewer than `each` are left
                    plan.place(size, n, first + full, n)
                    put(left - n * size, first + full, 1)
                    full, n = full + 1, 0
                put(left, first + full, bins - full)


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """counts: items by size, 1 to capacity."""
    plan = Plan(capacity)
    best_fit(reduce_dominated(counts, plan), plan)
    return plan


def _ranked(items: DataFrame, by: list[str]) -> DataFrame:
    """Adds `rank`, the place (from 0) of each item among those of its size, without bringing a size together in one task."""
    shards = max(16, 2 * default_partitions(items.sparkSession))
    sharded = items.withColumn("shard", F.pmod(F.xxhash64(*by), F.lit(shards)).cast("int"))
    counts = sharded.groupBy("size", "shard").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("shard")) - F.col("n")).select("size", "shard", "before")
    within = F.row_number().over(Window.partitionBy("size", "shard").orderBy(*by))
    return sharded.withColumn("within", within).join(before, ["size", "shard"]).withColumn("rank", F.col("before") + F.col("within") - 1).drop("shard", "within", "before")


def _items(docs: DataFrame, id: str, text: str, capacity: int, ranks_file: str) -> tuple[DataFrame, DataFrame, Plan]:
    """(sizes of the texts, items with their sizes, the plan)."""
    # rows without an id are told apart, once and for all as they are written
    tag = F.when(F.col(id).isNull(), F.monotonically_increasing_id())
    sizes = materialize(token_counts(docs.select(F.col(id).alias("id"), tag.alias("tag"), F.col(text).alias("text")), "text", ranks_file), "sizes")
    cut = sizes.filter("tokens > 0").select("id", "tag", "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / capacity).cast("int"))).alias("piece_no"))
    items = cut.select("id", "tag", "piece_no", F.least(F.lit(capacity), F.col("tokens") - F.col("piece_no") * capacity).cast("int").alias("size"))
    # at most `capacity` rows
    counts = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}
    return sizes, items, make_plan(counts, capacity)


def plan_summary(docs: DataFrame, id: str, text: str, capacity: int = CAPACITY, ranks_file: str = DEFAULT_RANKS) -> DataFrame:
    """items, tokens, containers, fixed_containers (by the reduction), least_containers (what the tokens need), best_fit_containers (best fit without the reduction): one row about the packing of these texts."""
    _, items, plan = _items(docs, id, text, capacity, ranks_file)
    alone = Plan(capacity)
    best_fit(plan.placed, alone)
    tokens = sum(size * n for size, n in plan.placed.items())
    row = (sum(plan.placed.values()), tokens, plan.bins, plan.fixed_bins, -(-tokens // capacity), alone.bins)
    return items.sparkSession.createDataFrame([row], "items long, tokens long, containers long, fixed_containers long, least_containers long, best_fit_containers long")


def pack(docs: DataFrame, id: str, text: str, capacity: int = CAPACITY, ranks_file: str = DEFAULT_RANKS) -> DataFrame:
    """id, piece_no, tokens, container: the container of every text, by tokens of a public tokenizer.

    A text is cut only if it alone exceeds the capacity: into pieces of `capacity` tokens and the rest, numbered from 0. Null and
    empty texts hold no tokens and take no room: their container is -1. Every row is an item of its own, also rows repeated or
    with a null id. An empty table gives an empty result; other columns are ignored.
    """
    sizes, items, plan = _items(docs, id, text, capacity, ranks_file)
    rows = np.array(sorted(plan.rows), dtype=np.int64).reshape(-1, 5)
    sizes_of, firsts, bins, each = rows[:, 0], rows[:, 1], rows[:, 3], rows[:, 4]
    # one number for (size, rank), for a single binary search
    span = np.int64(1) << 48
    starts = sizes_of * span + firsts

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at = np.searchsorted(starts, f["size"].to_numpy(np.int64) * span + f["rank"].to_numpy(np.int64), side="right") - 1
            container = bins[at] + (f["rank"].to_numpy(np.int64) - firsts[at]) // each[at]
            yield pd.DataFrame({"id": f["id"], "piece_no": f["piece_no"], "tokens": f["size"], "container": container})

    schema = sizes.select("id").schema.add("piece_no", "integer").add("tokens", "integer").add("container", "long")
    placed = _ranked(items, ["id", "tag", "piece_no"]).select("id", "piece_no", "size", "rank").mapInPandas(assign, schema)
    empty = sizes.filter("tokens = 0").select("id", F.lit(0).alias("piece_no"), F.lit(0).alias("tokens"), F.lit(-1).cast("bigint").alias("container"))
    return placed.unionByName(empty).withColumnRenamed("id", id)


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """container, n_items, used, unused: each container's contents summed up."""
    filled = packed.filter("container >= 0").groupBy("container").agg(F.count("*").alias("n_items"), F.sum("tokens").alias("used"))
    return filled.withColumn("unused", F.lit(capacity) - F.col("used"))
