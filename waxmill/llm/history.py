"""Deduplicating new batches against everything accepted before.

Exact values (hashes): a row repeats the first row of its value.

Near copies (texts within a share of edits): `TextHistory` keeps every accepted text with a bit-difference fingerprint (the parities
of its hashed character pairs, so that k edits change at most 4k bits) and, in a block table, with the blocks it is found by. A new
batch is looked up by exact matches of blocks, verified first by the Hamming distance of the fingerprints and then by the edit
distance of the texts, and what is accepted of it is appended.

k edits can't touch all of k+1 stretches of a text that don't overlap, so a text that agrees with it has one of them unchanged, moved by
at most k places. A stretch is known by the piece with the least hash in it, its block: k+1 blocks are stored of every text, and a new text
looks up the least pieces of all its stretches, neighbouring ones mostly having the same. Nothing is missed. Pieces that many texts hold
come last in the order of the hashes, and stretches that have only such pieces are passed over where others are enough; if not, those that
have only the most frequent ones are. Stretches are so much shorter than they could be that this is nearly always possible: a block of a piece that a share of
all texts holds would cost pairs that grow with the square of the texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waxmill.functions.ids import not_blank
from waxmill.session import default_partitions, materialize, scratch_path

#: Edits allowed, as a share of the longer text.
EDIT_SHARE = 0.05
#: Lengths of the stored text from which on longer stretches are used; below the first no edit is allowed and the whole text is the block.
CLASSES = (19, 38, 57, 114, 190)
#: Characters of a piece.
PIECE = 6
#: The part of a stretch that is given up so that some can be passed over.
SPARE = 0.2
#: Bits of the bit-difference fingerprint, in words of 64.
WORDS = 4
#: A piece held by these shares of the first batch's texts is common, or very common; so many of the most frequent are remembered. Neither changes what is found.
COMMON_SHARE, VERY_COMMON_SHARE, MOST_COMMON = 0.0002, 0.005, 1 << 16
#: The earliest so many texts of a block are compared first; the others only where an earlier partner may be among them.
HEAD = 64
#: The other texts of a block are compared in parts of about so many.
PART_TEXTS = 2_000
#: Characters worked on at once.
CHUNK = 1 << 20
#: Groups of batches made ready while one is matched.
AHEAD = 1
#: Batches that wait are added together until they have this share of the rows before them.
BACKLOG_SHARE = 0.25
#: What is left to decide in order is decided in one task once it is at most so many pairs (16 bytes each).
ONE_TASK_PAIRS = 2_000_000

TEXTS = "id bigint, text string, len int, bits array<bigint>"
PIECES = "id bigint, len int, piece bigint, first int, last int"


def most_edits(longer: Column) -> Column:
    """Edits allowed between two texts whose longer one has this many characters."""
    return F.floor(longer * F.lit(EDIT_SHARE) + F.lit(1e-9)).cast("int")


@dataclass(frozen=True)
class Stretch:
    """Of stored texts of `low` to `high - 1` characters: the length of a stretch and of the pieces in it."""

    low: int
    high: int
    size: int
    piece: int

    @property
    def width(self) -> int:
        """Pieces in a stretch."""
        return self.size - self.piece + 1


def reach(length: int) -> int:
    """Edits allowed between a text of this length and the longest text that can still agree with it."""
    return length // round(1 / EDIT_SHARE - 1)


def stretches() -> list[Stretch]:
    """Of every class of lengths: so many stretches as edits are within reach, and one more, find room in every text."""
    out = []
    for low, high in zip(CLASSES, (*CLASSES[1:], 1 << 31), strict=True):
        # beyond some thousand characters there is only more room
        room = min(n // (reach(n) + 1) for n in range(low, min(high, 4000)))
        size = room - max(1, int(room * SPARE)) if room > 10 else room
        out.append(Stretch(low, high, size, PIECE))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _pieces_hashed(codes: np.ndarray, seed: int, size: int) -> np.ndarray:
    """62-bit hashes of the pieces of `size` characters at every place."""
    n = max(0, len(codes) - size + 1)
    h = np.full(n, np.uint64(seed + 1))
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n] + np.uint64(1)
    return _mix(h) >> np.uint64(2)


#: Where the hashes of common and of very common pieces begin in their order.
COMMON, VERY_COMMON = np.uint64(1 << 62), np.uint64(1 << 63)


class Common:
    """The common pieces, very common ones given as -1 - hash; membership by a table of bits first."""

    def __init__(self, pieces: list[int]):
        given = np.array(pieces, dtype=np.int64)
        hashes = np.where(given < 0, -1 - given, given).view(np.uint64)
        order = np.argsort(hashes)
        self.sorted, self.mark = hashes[order], np.where(given < 0, VERY_COMMON, COMMON)[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.sorted & np.uint64(len(self.bits) - 1)).astype(np.int64)] = True

    def ordered(self, hashes: np.ndarray) -> np.ndarray:
        """The hashes with those of common pieces after all others, and those of very common ones last."""
        if not len(self.sorted):
            return hashes
        maybe = np.nonzero(self.bits[(hashes & np.uint64(len(self.bits) - 1)).astype(np.int64)])[0]
        at = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), len(self.sorted) - 1)
        out = hashes.copy()
        held = self.sorted[at] == hashes[maybe]
        out[maybe[held]] |= self.mark[at[held]]
        return out


def _slices(starts: np.ndarray, ends: np.ndarray, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, starts, ends) of about CHUNK characters together; a longer text comes in parts that overlap."""
    held: list[tuple[int, int, int]] = []
    total = 0
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        while True:
            c = min(b, a + CHUNK)
            held.append((i, a, c))
            total += c - a
            if total >= CHUNK:
                yield tuple(np.array(x) for x in zip(*held, strict=True))
                held, total = [], 0
            if c == b:
                break
            a = c - overlap
    if held:
        yield tuple(np.array(x) for x in zip(*held, strict=True))


def _gathered(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters of the parts one after the other, part of each, place of each in `codes`)."""
    sizes = ends - starts
    part = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return codes[place], part, place


Blocks = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sorted_blocks(found: list[Blocks]) -> Blocks:
    """(texts, blocks, places from 0), in order of text, block and place."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text, block, place = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((place, block, text))
    return text[order], block[order], place[order]


def blocks_of(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, common: Common) -> tuple[Blocks, Blocks]:
    """The blocks to store and the blocks to look up of the texts codes[start:end]; a block may come several times in a text."""
    lengths = ends - starts
    stored: list[Blocks] = []
    looked_up: list[Blocks] = []
    whole = np.nonzero((lengths < CLASSES[0]) & (lengths > 0))[0]
    for size in np.unique(lengths[whole]):
        mine = whole[lengths[whole] == size]
        text = codes[starts[mine][:, None] + np.arange(size)]
        h = np.full(len(mine), np.uint64(size))
        for j in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + text[:, j] + np.uint64(1)
        for out in (stored, looked_up):
            out.append((mine, _mix(h) >> np.uint64(1), np.zeros(len(mine), np.int64)))
    needed = lengths // round(1 / EDIT_SHARE - 1) + 1
    for c, kind in enumerate(stretches()):
        # a stored text that agrees is shorter or longer than this one by all edits at most
        mine = np.nonzero((lengths + needed - 1 >= kind.low) & (lengths - (lengths * EDIT_SHARE + 1e-9).astype(np.int64) < kind.high))[0]
        # passing over the stretches of common pieces alone, and those of very common ones alone
        free, count = np.zeros((2, len(starts)), np.int64), np.zeros((2, len(starts)), np.int64)
        chosen: tuple[list[Blocks], list[Blocks]] = ([], [])
        grid: list[Blocks] = []
        for texts, a, b in _slices(starts[mine], ends[mine], kind.size - 1):
            texts = mine[texts]
            chars, part, place = _gathered(codes, a, b)
            order = common.ordered(_pieces_hashed(chars, c, kind.piece))
            n = len(order) - kind.width + 1
            if n <= 0:
                continue
            least = order[:n].copy()
            for j in range(1, kind.width):
                np.minimum(least, order[j : j + n], out=least)
            at = np.zeros(n, np.int64)
            for j in range(kind.width - 1, -1, -1):
                hit = order[j : j + n] == least
                at[hit] = np.nonzero(hit)[0] + j
            inside = part[:n] == part[kind.size - 1 : kind.size - 1 + n]
            own = np.unique(at[inside])
            text = texts[part[own]]
            looked_up.append((text, order[own], place[own] - starts[text]))
            of = texts[part[:n]]
            fits = (lengths >= kind.low) & (lengths < kind.high)
            start = place[:n] - starts[of]
            on_grid = np.nonzero(inside & fits[of] & (start % kind.size == 0))[0]
            grid.append((of[on_grid], least[on_grid], place[at[on_grid]] - starts[of[on_grid]]))
            sizes = b - a
            first = np.cumsum(sizes) - sizes
            parts = list(zip(texts.tolist(), first.tolist(), sizes.tolist(), (a - starts[texts]).tolist(), strict=True))
            for level, limit in enumerate((COMMON, VERY_COMMON)):
                # stretches from left to right
                telling = np.where(inside & (least < limit), np.arange(n), n)
                following = np.minimum.accumulate(telling[::-1])[::-1].tolist()
                picked: list[int] = []
                for t, at0, size, from0 in parts:
                    # the second way only for texts that may lack some by the first
                    if not fits[t] or level and size == lengths[t] and count[0, t] >= needed[t]:
                        continue
                    i, end, left = at0 + max(0, int(free[level, t]) - from0), min(n, at0 + size - kind.size + 1), int(needed[t] - count[level, t])
                    while left and i < end and (i := following[i]) < end:
                        picked.append(i)
                        i += kind.size
                        left -= 1
                    free[level, t], count[level, t] = i - at0 + from0, needed[t] - left
                p = np.array(picked, dtype=np.int64)
                chosen[level].append((of[p], least[p], place[at[p]] - starts[of[p]]))
        way = np.where(count[0] >= needed, 0, np.where(count[1] >= needed, 1, 2))
        for k, blocks in enumerate((*chosen, grid)):
            stored += [tuple(x[way[t] == k] for x in (t, *rest)) for t, *rest in blocks]
    return _sorted_blocks(stored), _sorted_blocks(looked_up)


def _ranges(blocks: Blocks, texts: int) -> pa.ListArray:
    """For each text its blocks as structs of piece, first and last place."""
    text, block, place = blocks
    new = np.append(True, (text[1:] != text[:-1]) | (block[1:] != block[:-1]))[: len(text)]
    heads = np.nonzero(new)[0]
    tails = np.append(heads[1:], len(text)) - 1 if len(heads) else heads
    offsets = np.searchsorted(text[heads], np.arange(texts + 1)).astype(np.int32)
    pieces = pa.StructArray.from_arrays([pa.array(block[heads].view(np.int64)), pa.array(place[heads].astype(np.int32)), pa.array(place[tails].astype(np.int32))], names=["piece", "first", "last"])
    return pa.ListArray.from_arrays(pa.array(offsets), pieces)


def parities(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bit-difference fingerprint of each text, WORDS longs."""
    bits = 64 * WORDS
    odd = np.zeros((len(starts), bits), np.uint8)
    for texts, a, b in _slices(starts, ends, 1):
        chars, part, _ = _gathered(codes, a, b)
        pairs = (chars[:-1] * np.uint64(0x9E3779B97F4A7C15) + chars[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(17)
        inside = part[1:] == part[:-1]
        counts = np.bincount(part[:-1][inside] * bits + (pairs[inside] % np.uint64(bits)).astype(np.int64), minlength=len(texts) * bits)
        np.bitwise_xor.at(odd, texts, (counts & 1).astype(np.uint8).reshape(-1, bits))
    return np.packbits(odd, axis=1).view(np.int64).reshape(len(starts), WORDS)


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters of all texts, starts, ends)."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, ends - lengths, ends


def _in_parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that their texts have about CHUNK characters."""
    for batch in batches:
        ends = np.cumsum(pc.utf8_length(batch.column(text)).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")) - at)
            yield batch.slice(at, n)
            at += n


def prepare(texts: DataFrame, common: list[int]) -> DataFrame:
    """id, text, len, bits, stored, looked_up of texts (id, text): the fingerprint and the two lists of blocks, each block with its first and last place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Common(common)
        for part in _in_parts(batches, 1):
            n = part.num_rows
            codes, starts, ends = _coded(part.column(1))
            stored, looked_up = blocks_of(codes, starts, ends, known)
            bits = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * WORDS, pa.int32()), pa.array(parities(codes, starts, ends).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array((ends - starts).astype(np.int32)), bits, _ranges(stored, n), _ranges(looked_up, n)], names=["id", "text", "len", "bits", "stored", "looked_up"])

    blocks = "array<struct<piece: bigint, first: int, last: int>>"
    return texts.select("id", "text").mapInArrow(run, f"{TEXTS}, stored {blocks}, looked_up {blocks}")


def common_pieces(texts: DataFrame) -> list[int]:
    """At most MOST_COMMON hashes of the pieces that at least COMMON_SHARE of the texts hold, as Common takes them.

    A task passes on what two texts of a part hold, or COMMON_SHARE of a larger part, so a piece may be overlooked; that changes which blocks are chosen, never what is found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _in_parts(batches, 0):
            codes, starts, ends = _coded(part.column(0))
            keys, counts = [np.array([-1])], [np.array([part.num_rows])]
            for c, kind in enumerate(stretches()):
                mine = np.nonzero((ends - starts >= kind.low) & (ends - starts < kind.high))[0]
                for texts, a, b in _slices(starts[mine], ends[mine], kind.piece - 1):
                    chars, of, _ = _gathered(codes, a, b)
                    hashed = _pieces_hashed(chars, c, kind.piece)
                    n = len(hashed)
                    inside = of[:n] == of[kind.piece - 1 : kind.piece - 1 + n]
                    owner, hashed = texts[of[:n][inside]], hashed[inside]
                    order = np.lexsort((owner, hashed))
                    owner, hashed = owner[order], hashed[order]
                    new = np.append(True, (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1]))[: len(hashed)]
                    key, held = np.unique(hashed[new], return_counts=True)
                    often = held >= max(2, COMMON_SHARE * part.num_rows)
                    keys.append(key[often].view(np.int64))
                    counts.append(held[often])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts).astype(np.int64))], names=["piece", "n"])

    counted = materialize(texts.select("text").mapInArrow(run, "piece bigint, n bigint").groupBy("piece").agg(F.sum("n").alias("n")), "common")
    total = counted.filter("piece = -1").agg(F.max("n")).first()[0] or 0
    often = counted.filter((F.col("piece") >= 0) & (F.col("n") >= max(3.0, COMMON_SHARE * total)))
    very = max(3.0, VERY_COMMON_SHARE * total)
    return [-1 - r["piece"] if r["n"] >= very else r["piece"] for r in often.orderBy(F.desc("n"), "piece").limit(MOST_COMMON).collect()]


def hamming(a: str, b: str) -> Column:
    """Hamming distance of two fingerprints."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(WORDS)), F.lit(0))


def _old(pieces: DataFrame, *more: str) -> DataFrame:
    return pieces.select(F.col("id").alias("old"), F.col("len").alias("old_len"), "piece", F.col("first").alias("old_first"), F.col("last").alias("old_last"), *more)


def _near() -> Column:
    """Whether the lengths, and the places of the block, are as near as the edits allow, the old text being the earlier."""
    k = most_edits(F.greatest("old_len", "len"))
    return (F.col("old") < F.col("id")) & (F.abs(F.col("old_len") - F.col("len")) <= k) & (F.col("old_first") - k <= F.col("last")) & (F.col("first") - k <= F.col("old_last"))


def _few_bits(k: Column) -> Column:
    """Whether the fingerprints differ by no more than k edits can change."""
    return hamming("old_bits", "bits") <= 4 * k


def _verified(pairs: DataFrame, stored: DataFrame, new: DataFrame) -> DataFrame:
    """Those of the pairs (old, new) whose fingerprints and then texts are near enough; a pair of a text and itself is a mark and passed on.

    The fingerprints go with the pairs first; texts are fetched for what is left.
    """
    bits = stored.select(F.col("id").alias("old"), F.col("len").alias("old_len"), F.col("bits").alias("old_bits"))
    right = new.select(F.col("id").alias("new"), "len", "text", "bits")
    mark = F.col("old") == F.col("new")
    k = most_edits(F.greatest("old_len", "len"))
    close = pairs.distinct().join(bits, "old", "left").join(right, "new").filter(mark | _few_bits(k)).select("old", "new", "text")
    both = close.join(stored.select(F.col("id").alias("old"), F.col("text").alias("old_text")), "old", "left")
    k = most_edits(F.greatest(F.length("old_text"), F.length("text")))
    return both.filter(mark | (F.call_function("levenshtein", F.col("old_text"), F.col("text"), k) >= 0)).select("old", "new")


def _rest(old: DataFrame, new: DataFrame, stored: DataFrame, texts: DataFrame) -> DataFrame:
    """old, new: the pairs that are left for blocks of many texts, none later than `best`, compared by their fingerprints where they meet.

    The old ones of a block are spread over parts of about PART_TEXTS.
    """
    old = materialize(old, "rest")
    longest = old.groupBy("piece").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = 1 + longest // PART_TEXTS
    a = old.join(stored.select(F.col("id").alias("old"), F.col("bits").alias("old_bits")), "old").withColumn("part", F.pmod(F.xxhash64("old"), F.lit(parts)).cast("int"))
    b = new.join(texts.select("id", "bits"), "id").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0))
    met = _near() & (F.col("old") < F.coalesce("best", "id")) & _few_bits(most_edits(F.greatest("old_len", "len")))
    return a.join(b, ["piece", "part"]).filter(met).select("old", F.col("id").alias("new"))


def pairs_with_history(pieces: DataFrame, texts: DataFrame, new_pieces: DataFrame, new_texts: DataFrame) -> DataFrame:
    """old, new: pairs of a stored and a new text that agree; for every new text the one of the smallest `old` is among them.

    Blocks of more than HEAD stored texts: the earliest HEAD are compared first, then only those of the others that are earlier than the
    partner found so far. So a crowd of texts that all agree with each other costs HEAD pairs a block and new text.
    """
    looked_up = pieces.join(new_pieces.select("piece"), "piece", "left_semi")
    placed = looked_up.withColumn("place", F.row_number().over(Window.partitionBy("piece").orderBy("id"))).filter(F.col("place") <= HEAD + 1)
    more = F.col("place") > HEAD
    met = _old(placed, "place").join(new_pieces, "piece").filter(more | _near()).select(F.when(more, F.col("id")).otherwise(F.col("old")).alias("old"), F.col("id").alias("new"))
    early = materialize(_verified(met, texts, new_texts), "pairs")
    found, marked = early.filter("old <> new"), early.filter("old = new").select("new")
    if marked.isEmpty():
        return found
    best = found.groupBy(F.col("new").alias("id")).agg(F.min("old").alias("best"))
    last = materialize(placed.filter(F.col("place") == HEAD + 1).select("piece", F.col("id").alias("from")), "long")
    rest = pieces.join(last, "piece").filter(F.col("id") >= F.col("from")).drop("from")
    waiting = new_pieces.join(last.select("piece"), "piece", "left_semi").join(marked.withColumnRenamed("new", "id"), "id", "left_semi").join(best, "id", "left")
    return found.unionByName(materialize(_verified(_rest(_old(rest), waiting, texts, new_texts), texts, new_texts), "pairs"))


def pairs_within(stored: DataFrame, looked_up: DataFrame, texts: DataFrame, refused: DataFrame) -> DataFrame:
    """old, new: the pairs of a batch's texts that agree, except those that can't decide anything, and those of texts refused already (id).

    Where a block has more than HEAD texts, the texts that find no earlier one by any block are compared with all others to begin with: they
    are accepted, and what agrees with them is refused, so that it is no partner of later ones.
    """
    open_new = looked_up.join(refused, "id", "left_anti")
    every = lambda old: _old(old).join(open_new, "piece").filter(_near()).select("old", F.col("id").alias("new"))
    long = stored.groupBy("piece").agg(F.count("*").alias("n")).filter(F.col("n") > HEAD)
    if long.isEmpty():
        met = every(stored).distinct().join(refused.withColumnRenamed("id", "old"), "old", "left_anti")
        return materialize(_verified(met, texts, texts), "pairs")
    open_old = stored.join(refused, "id", "left_anti")
    first = open_old.groupBy("piece").agg(F.min("id").alias("first_id"))
    leaders = open_new.join(first, "piece", "left").groupBy("id").agg(F.bool_and(F.coalesce(F.col("first_id") >= F.col("id"), F.lit(True))).alias("leads")).filter("leads").select("id")
    leaders = materialize(leaders, "leaders")
    led = materialize(_verified(every(open_old.join(leaders, "id", "left_semi")), texts, texts), "pairs")
    best = led.groupBy(F.col("new").alias("id")).agg(F.min("old").alias("best"))
    still_open = open_old.join(best.select("id").union(leaders), "id", "left_anti")
    met = _rest(_old(still_open), open_new.join(best, "id", "left"), texts, texts)
    return led.unionByName(materialize(_verified(met, texts, texts), "pairs"))


def accept_in_order(pairs: DataFrame, one_task: int = ONE_TASK_PAIRS) -> DataFrame:
    """new, matched: of the texts in `pairs` (old, new; old came first; a written table), those that agree with an accepted one and the first such.

    A text without earlier partners is accepted, and one that agrees with no accepted earlier one. Texts without open partners are decided in
    rounds, each of which leaves fewer pairs; once `one_task` or fewer pairs are left, they are decided in order in one task.
    """
    open_pairs, refused = pairs, []
    while open_pairs.count() > one_task:
        accepted = open_pairs.select(F.col("old").alias("id")).distinct().join(open_pairs.select(F.col("new").alias("id")), "id", "left_anti")
        out = materialize(open_pairs.join(accepted.withColumnRenamed("id", "old"), "old", "left_semi").select("new").distinct(), "refused")
        refused.append(out)
        open_pairs = materialize(open_pairs.join(out, "new", "left_anti").join(out.select(F.col("new").alias("old")), "old", "left_anti").select("old", "new"), "edges")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches if b.num_rows]
        edges = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
        gone: set[int] = set()
        for old, new in edges[np.lexsort((edges[:, 0], edges[:, 1]))].tolist():
            if old not in gone:
                gone.add(new)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(gone), pa.int64())], names=["new"])

    every = open_pairs.coalesce(1).mapInArrow(decide, "new bigint")
    for part in refused:
        every = every.unionByName(part)
    return pairs.join(every.select(F.col("new").alias("old")), "old", "left_anti").groupBy("new").agg(F.min("old").alias("matched"))


@dataclass(frozen=True)
class Ready:
    """A batch before matching: rows (text, arrival), texts (one row each, by the earliest arrival) and their blocks."""

    rows: DataFrame
    texts: DataFrame
    stored: DataFrame
    looked_up: DataFrame
    placed: bool


@dataclass
class TextHistory:
    """Accepted texts in a folder, to which batches are added one at a time, in order.

    `texts` and `pieces` are bucketed tables (by id and by block) partitioned by batch: a batch is shuffled to the buckets and joined
    there, the history isn't moved. A batch appends only its own accepted texts. `found/batch=n`, written last, holds what the
    batch repeats and says that it is complete; a batch reads only complete batches before it and overwrites only its own
    parts, so adding one again, after a failure or not, changes nothing. Blocks are chosen by the pieces that are common in
    the first batch (`common`), which are kept with the history.
    """

    spark: SparkSession
    folder: str
    buckets: int | None = None
    _common: list[int] | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        tag = uuid.uuid4().hex
        self._texts, self._pieces = (f"waxmill_{x}_{tag}" for x in ("texts", "pieces"))
        self._own = [self._texts, self._pieces]
        if self._complete("common"):
            row = self.spark.read.parquet(f"{self.folder}/common").first()
            self._common, self.buckets = list(row["pieces"]), row["buckets"]
        else:
            self.buckets = self.buckets or max(8, default_partitions(self.spark))
        for name, schema, key, part in ((self._texts, TEXTS, "id", "texts"), (self._pieces, PIECES, "piece", "pieces")):
            self.spark.sql(f"CREATE TABLE {name} ({schema}, batch int) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{part}'")
            if self._paths(f"{part}/batch=*"):
                self.spark.catalog.recoverPartitions(name)

    def close(self) -> None:
        """Forget the tables' names; the folder stays."""
        for name in self._own:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _paths(self, pattern: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return [str(s.getPath().getParent().getName()) for s in found or []]

    def _complete(self, part: str) -> bool:
        return bool(self._paths(f"{part}/_SUCCESS"))

    def batches(self) -> list[int]:
        """The complete batches."""
        return sorted(int(p.removeprefix("batch=")) for p in self._paths("found/batch=*/_SUCCESS"))

    def _insert(self, df: DataFrame, table: str, key: str, batch_no: int, bucketed: bool = False) -> None:
        placed = df if bucketed else df.repartition(self.buckets, key)
        view = f"{table}_batch"
        placed.createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (batch = {int(batch_no)}) SELECT * FROM {view}")
        self.spark.catalog.dropTempView(view)

    def ready(self, rows: DataFrame, text: str, arrival: str, placed: bool = True) -> Ready:
        """A batch made ready for matching: its texts with fingerprints and blocks, the blocks placed in buckets where they will be looked up. Batches may be made ready ahead."""
        clean = rows.select(F.col(text).alias("text"), F.col(arrival).cast("bigint").alias("arrival")).filter(not_blank("text") & F.col("arrival").isNotNull())
        texts = clean.groupBy("text").agg(F.min("arrival").alias("id"))
        if self._common is None:
            texts = materialize(texts, "texts")
            self._common = common_pieces(texts)
            self.spark.createDataFrame([(self._common, self.buckets)], "pieces array<bigint>, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/common")
        new = materialize(prepare(texts, self._common), "batch")
        blocks = {name: new.select("id", "len", F.explode(name).alias("p")).select("id", "len", "p.*") for name in ("stored", "looked_up")}
        if placed:
            tag = uuid.uuid4().hex
            for name, pieces in blocks.items():
                table = f"waxmill_{name}_{tag}"
                pieces.repartition(self.buckets, "piece").write.format("parquet").bucketBy(self.buckets, "piece").option("path", scratch_path(self.spark, "pieces")).saveAsTable(table)
                self._own.append(table)
                blocks[name] = self.spark.table(table)
        return Ready(clean, new.select("id", "text", "len", "bits"), blocks["stored"], blocks["looked_up"], placed)

    def add(self, batch_no: int, rows: DataFrame, text: str, arrival: str) -> DataFrame:
        """Match the batch's rows, append the accepted ones, and return arrival, matched of the others.

        Batches must be added in order, starting with 0, the rows of which are all accepted. Null and blank texts agree with nothing,
        nor do rows without an arrival; equal texts agree; repeated rows count once; texts of any length are compared whole.
        """
        return self.match(batch_no, self.ready(rows, text, arrival, placed=batch_no > 0))

    def match(self, batch_no: int, batch: Ready) -> DataFrame:
        """add for a batch that is ready."""
        earlier = [b for b in self.batches() if b < batch_no]
        own, stored, looked_up = batch.texts, batch.stored, batch.looked_up
        if batch_no == 0:
            self._write_all(self.spark, lambda: self._insert(stored, self._pieces, "piece", 0, batch.placed), lambda: self._insert(own, self._texts, "id", 0))
            found = self.spark.createDataFrame([], "arrival bigint, matched bigint")
        else:
            known = self.spark.createDataFrame([], "new bigint, matched bigint")
            if earlier:
                there = F.col("batch").isin(earlier)
                old_pieces, old_texts = (self.spark.table(t).filter(there).drop("batch") for t in (self._pieces, self._texts))
                known = materialize(pairs_with_history(old_pieces, old_texts, looked_up, own).groupBy("new").agg(F.min("old").alias("matched")), "known")
            among = accept_in_order(pairs_within(stored, looked_up, own, known.select(F.col("new").alias("id"))))
            refused = materialize(known.unionByName(among), "refused")
            gone = refused.select(F.col("new").alias("id"))
            self._write_all(
                self.spark,
                lambda: self._insert(stored.join(gone, "id", "left_anti"), self._pieces, "piece", batch_no, batch.placed),
                lambda: self._insert(own.join(gone, "id", "left_anti"), self._texts, "id", batch_no),
            )
            of_text = own.select(F.md5("text").alias("digest"), "id").join(refused.withColumnRenamed("new", "id"), "id", "left").select("digest", F.coalesce("matched", "id").alias("matched"))
            found = batch.rows.select(F.md5("text").alias("digest"), "arrival").distinct().join(of_text, "digest").filter(F.col("matched") < F.col("arrival")).select("arrival", "matched")
        target = f"{self.folder}/found/batch={int(batch_no)}"
        found.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(found.schema).parquet(target)

    @staticmethod
    def _write_all(spark: SparkSession, *writes: Callable[[], None]) -> None:
        """Run the writes, which don't depend on each other, at the same time; an error of any is raised."""
        with ThreadPoolExecutor(len(writes)) as pool:
            for done in [pool.submit(inheritable_thread_target(spark)(w)) for w in writes]:
                done.result()


def near_repeats(rows: DataFrame, text: str, arrival: str, batch: str) -> DataFrame:
    """arrival, matched: the rows of later batches that agree with an accepted row of smaller arrival, and the smallest such.

    rows: everything that has arrived, history (batch 0, all accepted) and later batches, of which there may be some thousands. They are
    added to a `TextHistory` one after the other, small ones that wait anyway together (see backlog): rows are taken in order of arrival within what is added,
    so that the result doesn't depend on the grouping. A later row that agrees with no accepted one is accepted. Rows without a batch are left out; for nulls, blanks and repeated rows see TextHistory.add. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "arrived")
    kept = rows.select(F.col(text).alias("text"), F.col(arrival).cast("bigint").alias("arrival"), F.col(batch).cast("int").alias("batch"))
    kept.filter(not_blank("text") & F.col("arrival").isNotNull() & F.col("batch").isNotNull()).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    arrived = spark.read.schema("text string, arrival bigint, batch int").parquet(path)
    history = TextHistory(spark, scratch_path(spark, "history"))
    found = spark.createDataFrame([], "arrival bigint, matched bigint")
    sizes = {r["batch"]: r["n"] for r in arrived.groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()}
    groups = backlog(sizes)
    of = lambda group: arrived.filter(F.col("batch").isin(group))
    if groups:
        part = history.add(groups[0][-1], of(groups[0]), "text", "arrival")
        found = part if groups[0][-1] else found
    # the next group is made ready while one is matched
    with ThreadPoolExecutor(AHEAD) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(history.ready), of(g), "text", "arrival") for g in groups[1:]]
        for g, ready in zip(groups[1:], waiting, strict=True):
            found = found.unionByName(history.match(g[-1], ready.result()))
            # the driver gives up what the group has left behind (broadcasts, plans, shuffle files), however many there are
            spark.sparkContext._jvm.System.gc()
    history.close()
    return found


def backlog(sizes: dict[int, int], share: float = BACKLOG_SHARE) -> list[list[int]]:
    """Batches (rows by number) in groups to be added together: history (batch 0) alone, later ones until a group has this share of the rows before it."""
    groups: list[list[int]] = []
    before = held = 0
    for batch in sorted(sizes):
        if not groups or groups[-1] == [0] or held >= share * before:
            groups.append([])
            before, held = before + held, 0
        groups[-1].append(batch)
        held += sizes[batch]
    return groups


def exact_repeats(rows: DataFrame, keys: list[Column], arrival: str, batch: str) -> DataFrame:
    """arrival, matched: the rows of later batches whose keys all equal those of an earlier row, and the smallest such arrival.

    A row whose keys hold a null agrees with nothing; otherwise as near_repeats.
    """
    names = [f"k{i}" for i in range(len(keys))]
    clean = rows.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), F.col(arrival).cast("bigint").alias("arrival"), F.col(batch).cast("int").alias("batch")).dropna()
    first = clean.groupBy(*names).agg(F.min("arrival").alias("matched"))
    return clean.filter("batch > 0").distinct().join(first, names).filter(F.col("matched") < F.col("arrival")).select("arrival", "matched").distinct()
