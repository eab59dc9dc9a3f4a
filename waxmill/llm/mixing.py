"""Mixing sources to target shares of tokens.

Entropy balancing: of all document rates that give each source its tokens, those nearest to the base rates (in relative entropy over
documents) are exponentially tilted by the documents' tokens, rate = base * exp(lambda of the source * tokens), limited by the source's
largest number of repeats. A source that must shrink gives up long documents before short ones, one that must grow repeats long ones
first; that moves the fewest documents away from being used once. The multipliers solve a convex dual by Newton's iterations. The sums
these need depend on a document only through its source and tokens, so one distributed pass counts classes of tokens per source, and the
iterations run over those counts. Rates become whole copies by order sampling with a hash of the text, the threshold of which is set by
a histogram so that each source meets its tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waxmill.functions.ids import strip_blanks
from waxmill.llm.tokens import DEFAULT_RANKS, token_counts
from waxmill.session import materialize

#: Newton stops when every source is within this share of its tokens.
TOLERANCE = 1e-12
MOST_ITERATIONS = 200
#: Token counts up to EXACT are classes of their own, larger ones are classed by 1/FINE of their doublings.
EXACT, FINE = 2048, 1024
#: Classes of the sampling histograms; two levels of them leave 1/CLASSES**2 of a source undecided, which is rounded to the nearer side.
CLASSES = 1024
#: A text of more than this share of the tokens wanted from its source is rounded before the others.
LARGE_UNIT = 1 / 50


@dataclass(frozen=True)
class Target:
    share: float
    max_repeats: int


def source_name(source: Column) -> Column:
    """A source in one spelling: lower case, words joined by one `_`; the empty string for none."""
    return F.coalesce(F.regexp_replace(strip_blanks(F.lower(source)), r"[\s_-]+", "_"), F.lit(""))


def size_class(tokens: Column) -> Column:
    """The class of a token count; less than EXACT + 64 * FINE of them exist."""
    doublings = F.log2(F.greatest(tokens, F.lit(EXACT)) / F.lit(EXACT))
    return F.when(tokens < EXACT, tokens).otherwise(F.lit(EXACT) + F.floor(doublings * FINE)).cast("int")


def tilted_rates(documents: np.ndarray, tokens: np.ndarray, wanted: float, most: float, base: float = 1.0) -> tuple[np.ndarray, float, int]:
    """(rate of each class, lambda, iterations): rates min(most, base * exp(lambda * tokens of a document)) that give the wanted tokens.

    documents, tokens: of each class the number of documents and all their tokens. Newton's steps on the convex dual, whose gradient is the
    tokens that are missing; a step that leaves the interval known to hold the solution is replaced by its middle.
    """
    mean = tokens / documents
    scale = tokens.sum() / documents.sum()
    x = mean / scale
    if wanted <= 0:
        return np.zeros(len(x)), -np.inf, 0
    if wanted >= most * tokens.sum():
        return np.full(len(x), float(most)), np.inf, 0

    def rates(at: float) -> np.ndarray:
        return np.minimum(most, base * np.exp(np.minimum(700.0, at * x)))

    low, high, at = -1.0, 1.0, 0.0
    while tokens @ rates(low) > wanted:
        low *= 2
    while tokens @ rates(high) < wanted:
        high *= 2
    for step in range(MOST_ITERATIONS):
        rate = rates(at)
        gap = wanted - tokens @ rate
        if abs(gap) <= TOLERANCE * wanted:
            break
        low, high = (at, high) if gap > 0 else (low, at)
        slope = float((tokens * x * rate * (rate < most)).sum())
        at = at + gap / slope if slope > 0 else np.inf
        if not low < at < high:
            at = (low + high) / 2
    return rates(at), at / scale, step


def _sums(rows: DataFrame, *by: str) -> dict[tuple, dict[int, int]]:
    """Tokens by class (the last of `by`), for each of the other columns; at most sources x 2 x CLASSES rows."""
    out: dict[tuple, dict[int, int]] = {}
    for r in rows.groupBy(*by).agg(F.sum("tokens").alias("t")).collect():
        out.setdefault(tuple(r[b] for b in by[:-1]), {})[r[by[-1]]] = r["t"]
    return out


def _cut(sums: dict[int, int], need: float, nearest: bool) -> tuple[int, float]:
    """The first class that is not taken whole, and the tokens still needed there."""
    at = 0
    while at < CLASSES and sums.get(at, 0) <= need:
        need -= sums.get(at, 0)
        at += 1
    if nearest and at < CLASSES and need > sums[at] / 2:
        need -= sums[at]
        at += 1
    return at, need


def _extra_thresholds(units: DataFrame, need: dict[str, float]) -> dict[tuple[str, bool], tuple[int, int]]:
    """Per source and stratum the class, and the class within it, below which units get one more copy, so that these add up to the tokens needed.

    Units that alone hold LARGE_UNIT of a source's need are decided first, to the sum of their own fractions; the many small ones then make
    up for what the large ones are off by.
    """
    spark = units.sparkSession
    first = _sums(units, "source", "large", "c1")
    expected = {r["source"]: r["t"] for r in units.filter("large").groupBy("source").agg(F.sum(F.col("tokens") * F.col("part")).alias("t")).collect()}
    cuts: dict[tuple[str, bool], tuple[int, int]] = {}
    rest = dict(need)
    for large in (True, False):
        want = {s: expected.get(s, 0.0) if large else max(0.0, rest[s]) for s in need}
        edges = {s: _cut(first.get((s, large), {}), want[s], False) for s in need}
        edge = F.broadcast(spark.createDataFrame([(s, c) for s, (c, _) in edges.items()], "source string, c1 int"))
        second = _sums(units.filter(F.col("large") == large).join(edge, ["source", "c1"]), "source", "c2")
        for s, (c1, left) in edges.items():
            c2, over = _cut(second.get((s,), {}), left, True)
            if large:
                rest[s] = need[s] - (want[s] - over)
                c1, c2, rest[s] = _within(rest[s], sum(first.get((s, False), {}).values()), c1, c2, second.get((s,), {}), first.get((s, True), {}))
            cuts[s, large] = (c1, c2)
    return cuts


def _within(rest: float, small: int, c1: int, c2: int, inner: dict[int, int], outer: dict[int, int]) -> tuple[int, int, float]:
    """The cut moved on, and what is then left, until the small units can make up for that; a class is taken only if that brings the sum nearer."""
    off = lambda r: max(0.0, r - small, -r)
    after = [(c1, c + 1, inner.get(c, 0)) for c in range(c2, CLASSES)] + [(c + 1, 0, outer.get(c, 0)) for c in range(c1 + 1, CLASSES)]
    at = (c1, c2)
    for next1, next2, tokens in after:
        if rest <= small or off(rest - tokens) >= off(rest) > 0 < tokens:
            break
        rest, at = rest - tokens, (next1, next2)
    return (*at, rest)


def feasible_total(available: dict[str, int], shares: dict[str, float], targets: dict[str, Target]) -> float:
    """The largest total at which every source with tokens can have its share within its repeats."""
    return min((targets[s].max_repeats * available[s] / shares[s] for s in shares if shares[s] > 0), default=0.0)


def mix(docs: DataFrame, id: str, text: str, source: str, targets: dict[str, Target], total: float | None = None, ranks_file: str = DEFAULT_RANKS) -> tuple[DataFrame, DataFrame]:
    """(selection, shares): the documents to take with their copies, and the shares reached.

    selection: id, source, tokens, copies (at least 1). Copies of one text are one unit: it is taken in the row of the smallest id
    among the sources with a target, and no text is used more often than that source allows. shares: one row for each target
    and each other source: target_share, reached_share, available_tokens, selected_tokens, documents, most_copies.

    total: the tokens wanted in all; by default as many as the scarcest source allows. Targets of sources without tokens are
    spread over the others in proportion. If `total` is more than a source can give, that source is used up to its limit.
    Texts that are null or empty, rows of sources without a target and rows with a null id are not taken; an empty table
    gives shares of 0; repeated rows are copies of one text; other columns are ignored.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(id).alias("id"), source_name(F.col(source)).alias("source"), F.md5(F.col(text)).alias("digest"), F.col(text).alias("text"))
    sized = materialize(token_counts(named, "text", ranks_file), "tokens")
    table = F.broadcast(spark.createDataFrame([(s, float(t.share), t.max_repeats) for s, t in targets.items()], "source string, target_share double, max_repeats int"))
    usable = sized.filter((F.col("tokens") > 0) & F.col("id").isNotNull()).join(table, "source", "left_semi")
    units = usable.groupBy("digest").agg(F.min(F.struct("id", "source")).alias("first"), F.min("tokens").alias("tokens"))
    units = materialize(units.select("first.id", "first.source", "tokens", size_class(F.col("tokens")).alias("class"), F.xxhash64("digest").alias("hash")), "units")

    # at most (EXACT + 64 * FINE) classes for each source of the targets
    counted = units.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).orderBy("source", "class").toPandas()
    available = {s: int(g["t"].sum()) for s, g in counted.groupby("source")}
    held = sum(targets[s].share for s in available)
    shares = {s: targets[s].share / held for s in available if held > 0}
    most = {s: targets[s].max_repeats for s in available}
    budget = feasible_total(available, shares, targets) if total is None else float(total)
    wanted = {s: min(most[s] * available[s], budget * shares.get(s, 0.0)) for s in available}

    plan, need = [], {}
    for s, g in counted.groupby("source"):
        t = g["t"].to_numpy(float)
        rate, _, _ = tilted_rates(g["n"].to_numpy(float), t, wanted[s], most[s])
        whole = np.minimum(most[s], np.floor(rate + 1e-9))
        part = np.where(whole < most[s], np.maximum(0.0, rate - whole), 0.0)
        need[s] = float(t @ part)
        plan += list(zip([s] * len(g), g["class"].tolist(), whole.astype(int).tolist(), part.tolist(), [need[s] * LARGE_UNIT] * len(g), strict=True))
    rates = F.broadcast(spark.createDataFrame(plan, "source string, class int, whole int, part double, large_from double"))
    # order sampling: units by a uniform number over the fraction of a copy that they should have, the smallest first
    uniform = (F.shiftrightunsigned("hash", 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    place = F.when(F.col("part") > 0, uniform / (uniform + F.col("part")))
    units = units.join(rates, ["source", "class"]).withColumn("large", F.col("tokens") > F.col("large_from"))
    units = units.withColumn("c1", F.floor(place * CLASSES).cast("int")).withColumn("c2", F.floor((place * CLASSES - F.col("c1")) * CLASSES).cast("int"))
    cuts = _extra_thresholds(units.filter(F.col("c1").isNotNull()), need) if need else {}
    state = F.broadcast(spark.createDataFrame([(s, large, *c) for (s, large), c in cuts.items()], "source string, large boolean, cut1 int, cut2 int"))
    extra = (F.col("c1") < F.col("cut1")) | ((F.col("c1") == F.col("cut1")) & (F.col("c2") < F.col("cut2")))
    copies = F.col("whole") + F.coalesce(extra, F.lit(False)).cast("int")
    selection = units.join(state, ["source", "large"], "left").select("id", "source", "tokens", copies.alias("copies")).filter("copies > 0")

    taken = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("selected_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    present = sized.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    # both sides of the joins have a row per source
    joined = present.join(table, "source", "full").join(taken, "source", "left")
    selected = F.coalesce("selected_tokens", F.lit(0))
    everything = F.broadcast(selection.agg(F.sum(F.col("tokens") * F.col("copies")).alias("all_tokens")))
    report = joined.join(everything).select(
        "source",
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce(selected / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"),
        F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
        selected.alias("selected_tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    return selection.withColumnRenamed("id", id), report
