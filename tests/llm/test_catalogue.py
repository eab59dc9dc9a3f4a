"""Best representatives, top N and deduplication against history on awkward tables, against SQL and plain versions."""

import math
import random
from collections import Counter

import brute
import oracle
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waxmill.llm import history as H
from waxmill.llm.best import best_representatives, format_class, usable_score
from waxmill.llm.currency import current_versions, learn_precedence
from waxmill.llm.history import TextHistory, accept_in_order, exact_repeats, near_repeats
from waxmill.llm.queries import ORACLE_SQL, QUERIES
from waxmill.llm.topn import top_n
from waxmill.session import scratch_path


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, small, name):
    assert oracle.compare(spark, small, QUERIES[name], ORACLE_SQL[name]) is None


VERSIONS = "path string, ts timestamp, state string, n int"


def versions(spark, rows):
    stamp = lambda t: None if t is None else pd.Timestamp(2024, 1, 1 + t).to_pydatetime()
    return spark.createDataFrame([(p, stamp(t), s, n) for p, t, s, n in rows], VERSIONS)


def test_precedence_decides_where_times_are_missing(spark):
    learned = [(f"p{i}", t, s, 0) for i in range(20) for t, s in ((1, "new"), (2, "seen"), (3, "done"))] + [("odd", 1, "done", 0), ("odd", 2, "seen", 0)]
    cases = [("a", None, "done", 1), ("a", None, "new", 2), ("b", None, "seen", 1), ("b", 1, "new", 2), ("c", 5, "new", 1), ("c", 5, "seen", 2), ("c", None, "done", 3), ("d", None, "never", 1), ("d", None, "new", 2), ("e", 1, "new", 9), ("e", 1, "new", 9), (None, 1, "new", 0)]
    df = versions(spark, learned + cases)
    precedence = learn_precedence(df, "path", "ts", ["state"])
    assert precedence.later["state"] == {"new": {"seen", "done"}, "seen": {"done"}}
    got = {r["path"]: (r["state"], r["n"]) for r in current_versions(df, "path", "ts", {"state": F.col("state")}).collect()}
    # "never" and "new" are incomparable: both are latest, and the row with the larger values is taken
    assert {k: got[k] for k in "abcde"} == {"a": ("done", 1), "b": ("new", 2), "c": ("seen", 2), "d": ("new", 2), "e": ("new", 9)}
    assert got["odd"] == ("seen", 0)
    assert None not in got
    assert current_versions(df.limit(0), "path", "ts", {"state": F.col("state")}).count() == 0


def test_nothing_is_learned_without_ties(spark, monkeypatch):
    monkeypatch.setattr("waxmill.llm.currency.learn_precedence", lambda *a: 1 / 0)
    df = versions(spark, [("a", None, "x", 1), ("a", None, "x", 1), ("a", 1, "y", 2), ("b", None, "z", 3)])
    assert sorted(tuple(r)[::2] for r in current_versions(df, "path", "ts", {"state": F.col("state")}).collect()) == [("a", "y"), ("b", "z")]


def plain_current(rows, follows):
    """rows: (path, ts, format, size, date of the text); follows: per field the set of (earlier, later)."""
    out = {}
    for path in {r[0] for r in rows}:
        mine = {r for r in rows if r[0] == path}
        top = max((r[1] is not None, r[1] or 0) for r in mine)
        mine = [r for r in mine if (r[1] is not None, r[1] or 0) == top]
        latest = {}
        for f in (2, 3):
            kind = lambda r: r[f] if f == 2 else str(r[f] is not None).lower()  # noqa: B023, E731
            best = [r for r in mine if not any((kind(r), kind(o)) in follows[f] for o in mine)]
            latest[f] = {r[f] for r in best}
        out[path] = latest
    return out


def test_fields_of_undated_versions(spark):
    """Planted: precedence decides format and size, field by field, also against each other and in a group of thousands."""
    rnd = random.Random(4)
    rows = []
    for i in range(60):
        path = f"dated{i}"
        rows += [(path, 1, "wav", None), (path, 2, "flac", 100 + i), (path, 3, "mp3" if i % 2 else "m4a", 200 + i)]
    tied = [("t0", None, "wav", 5), ("t0", None, "flac", None), ("t1", 7, "flac", None), ("t1", 7, "wav", 9), ("t1", 3, "mp3", 1), ("t2", None, "mp3", 3), ("t2", None, "m4a", 3), ("t3", None, "wav", None), ("t3", None, "wav", None)]
    tied += [("hot", None, rnd.choice(["wav", "flac"]), rnd.choice([None, 1])) for _ in range(3000)]
    df = versions(spark, [(p, t, f, n) for p, t, f, n in rows + tied])
    states = {"state": F.col("state"), "n": F.col("n").isNotNull()}
    got = {r["path"]: r for r in current_versions(df, "path", "ts", states).collect()}
    follows = {2: {("wav", "flac"), ("flac", "mp3"), ("flac", "m4a"), ("wav", "mp3"), ("wav", "m4a")}, 3: {("false", "true")}}
    want = plain_current(rows + tied, follows)
    assert set(got) == set(want)
    assert all(got[p]["state"] in w[2] and got[p]["n"] in w[3] for p, w in want.items())
    assert {p: (got[p]["state"], got[p]["n"]) for p in ("t0", "t1", "hot")} == {"t0": ("flac", 5), "t1": ("flac", 9), "hot": ("flac", 1)}
    # incomparable: the row is taken as a whole
    assert got["t2"]["state"] in ("mp3", "m4a")
    assert len(got) == len(current_versions(df, "path", "ts", states).collect())


def test_best_field_by_field(spark):
    rows = [("g", "b", 1.0, None), ("g", "a", 1.0, None), ("g", "c", None, "x"), ("one", "d", 1.0, "x"), ("none", "e", None, None), ("none", "f", None, None), (None, "h", 1.0, "x"), (None, "i", 1.0, "x")]
    hot = [("hot", f"k{i:05d}", float(i % 7), "x" if i == 77 else None) for i in range(3000)]
    df = spark.createDataFrame(rows + hot, "id string, path string, s double, f string").withColumns({"key": F.lit("clash"), "n_copies": F.lit(-1)})
    got = {r["id"]: tuple(r)[1:] for r in best_representatives(df, "id", "path", [F.col("s").isNull(), F.coalesce(-F.col("s"), F.lit(0.0))], {"f": F.col("f").isNotNull()}).collect()}
    assert got == {"g": ("a", 3, "c"), "none": ("e", 2, ""), "hot": ("k00006", 3000, "k00077")}
    assert best_representatives(df.limit(0), "id", "path", [F.col("s")], {}).count() == 0


def test_usable_values(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, -1.0), (3, math.nan), (4, math.inf), (5, 3.1e15), (6, 3.2e15), (7, None)], "i int, s double")
    assert [r["i"] for r in df.filter(usable_score(F.col("s")).isNotNull()).orderBy("i").collect()] == [0, 5]
    formats = spark.createDataFrame([(i, x) for i, x in enumerate([" .FLAC ", "..mp3", "wav\n", ".ogg", "?", "", None])], "i int, f string")
    assert [r[0] for r in formats.orderBy("i").select(format_class(F.col("f"))).collect()] == ["flac", "mp3", "wav", None, None, None, None]


def plain_top(rows, n):
    groups = {}
    for g, i, s, t in rows:
        if None not in (g, i, s, t) and not math.isnan(s):
            groups.setdefault(g, {}).setdefault(i, []).append((-s, t))
    return {(g, k, i) for g, items in groups.items() for k, (_, _, i) in enumerate(sorted((*min(v), i) for i, v in items.items())[:n], 1)}


@pytest.mark.parametrize("seed", range(3))
def test_top_n_as_plain(spark, seed):
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.4 else f"g{rnd.randint(0, 60)}", f"i{rnd.randint(0, 400)}", rnd.choice([1.0, 1.0, 2.0, rnd.random() * 1e15]), f"t{rnd.randint(0, 50):02d}") for _ in range(2500)]
    rows += [(None, "i", 1.0, "t"), ("g1", None, 1.0, "t"), ("g1", "i", None, "t"), ("g1", "i", math.nan, "t"), ("g1", "x", 9.9, None), ("tie", "b", 1.0, "t"), ("tie", "a", 1.0, "t"), ("inf", "a", math.inf, "t")] + rows[:50]
    df = spark.createDataFrame(rows, "album string, item string, score double, path string").withColumns({"g": F.lit("clash"), "s": F.lit("clash"), "class": F.lit(1)})
    got = {(r["album"], r["rank_no"], r["item"]) for r in top_n(df, "album", "item", "score", "path", 3, classes=8).collect()}
    assert got == plain_top(rows, 3)


def test_thresholds_drop_items_before_the_shuffle(spark):
    """A group of most items is cut by its threshold where it is read, and ranking starts before the shuffle."""
    hot = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 9000)).alias("album"), F.col("id").cast("string").alias("item"), (F.xxhash64("id") % 997).cast("double").alias("score"), F.lit("t").alias("path"))
    found = top_n(hot, "album", "item", "score", "path", 3)
    got = {(r["album"], r["rank_no"], r["item"]) for r in found.collect()}
    assert got == plain_top([tuple(r) for r in hot.collect()], 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("Initial Plan") :] if "Initial Plan" in plan else plan
    partial, exchange, join = (initial.index(x) for x in ("3, Partial", "Exchange hashpartitioning(g", "BroadcastHashJoin"))
    assert exchange < partial < join


def test_top_n_of_nothing(spark):
    assert top_n(spark.createDataFrame([], "a string, b string, c double, d string"), "a", "b", "c", "d", 3).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_plain_edit_distance(a, b):
    rows = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, rows[0] = rows[0], i
        for j, y in enumerate(b, 1):
            last, rows[j] = rows[j], min(rows[j] + 1, rows[j - 1] + 1, last + (x != y))
    assert brute.edit_distance(a, b) == rows[-1]


def edited(rnd, text, k):
    out = list(text)
    for _ in range(k):
        at = rnd.randrange(len(out))
        kind = rnd.randrange(3)
        if kind == 0:
            out[at] = rnd.choice("xyz")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rnd.choice("xyz"))
    return "".join(out)


def texts(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choices("ABCDEFGHIJKLMNOP", k=n)) for n in (1, 5, 18, 19, 20, 21, 32, 33, 34, 38, 39, 40, 57, 60, 100, 200, 340)]
    popular = "AAAAAAARI2kuEvCB"
    base += [popular * 3, popular * 20, "".join(rnd.choices("QRST", k=30)) + popular * 6 + "".join(rnd.choices("QRST", k=40))]
    rows, arrival = [], 0
    for batch in range(4):
        for b in base:
            for _ in range(3):
                arrival += rnd.randint(1, 3)
                rows.append((edited(rnd, b, rnd.randint(0, max(1, int(len(b) * 0.07)))) or "Q", arrival, batch))
    rows += [(None, arrival + 1, 3), ("", arrival + 2, 3), (" \n", arrival + 3, 3), ("x" * 20_000, arrival + 4, 1), ("x" * 19_990, arrival + 5, 2), ("é" * 25 + "ß" * 25, arrival + 6, 1), ("é" * 24 + "ß" * 26, arrival + 7, 2)]
    return rows + rows[:10]


@pytest.mark.parametrize("seed", range(2))
def test_near_repeats_as_plain(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame(rows, "fp string, arrival_no long, batch_no int").withColumns({"text": F.lit("clash"), "id": F.lit("clash"), "len": F.lit(0)})
    got = {(r["arrival"], r["matched"]) for r in near_repeats(df, "fp", "arrival_no", "batch_no").collect()}
    assert got == brute.near_repeats(rows)


def test_waiting_batches_are_added_in_groups():
    assert H.backlog({0: 100, 1: 10, 2: 10, 3: 10, 4: 5, 5: 40, 6: 1}) == [[0], [1, 2, 3], [4, 5], [6]]
    assert H.backlog({0: 1}) == [[0]]
    assert H.backlog({2: 5, 1: 5}) == [[1], [2]]
    assert H.backlog({}) == []


def test_batches_one_at_a_time(spark):
    rows = texts(7)
    history, got = TextHistory(spark, scratch_path(spark, "history")), set()
    for batch in range(4):
        part = spark.createDataFrame([r[:2] for r in rows if r[2] == batch], "fp string, arrival_no long")
        got |= {(r["arrival"], r["matched"]) for r in history.add(batch, part, "fp", "arrival_no").collect()}
    # the very long texts were added to earlier batches than their arrival says
    usual = [r for r in rows if r[0] is None or len(r[0]) < 1000 and "é" not in r[0]]
    assert {x for x in got if x[0] <= max(r[1] for r in usual)} == brute.near_repeats(usual)


@pytest.mark.parametrize("one_task", [0, 2, 100])
def test_chains_are_accepted_in_order(spark, one_task):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 8)] + [(0, 3)], "old long, new long")
    got = {(r["new"], r["matched"]) for r in accept_in_order(pairs, one_task).collect()}
    # 1 is accepted, 2 repeats it, 3 repeats 0, 4 is accepted as 3 isn't, ...
    assert got == {(2, 1), (3, 0), (5, 4), (7, 6)}


def stored_rows(history, table):
    return sorted(map(str, history.spark.table(table).collect()))


def test_a_batch_added_again_changes_nothing(spark, monkeypatch):
    rows = texts(3)
    history = TextHistory(spark, scratch_path(spark, "history"))
    part = lambda b: spark.createDataFrame([r[:2] for r in rows if r[2] == b], "fp string, arrival_no long")
    add = lambda b: sorted(tuple(r) for r in history.add(b, part(b), "fp", "arrival_no").collect())
    first = [add(b) for b in range(3)]
    assert first[1] and first[2]
    tables = [stored_rows(history, t) for t in (history._texts, history._pieces)]
    assert [add(b) for b in (0, 0, 1, 2, 1)] == [first[b] for b in (0, 0, 1, 2, 1)]
    assert [stored_rows(history, t) for t in (history._texts, history._pieces)] == tables
    # a batch that fails between its writes isn't seen, and is whole once it is added again
    insert = TextHistory._insert
    monkeypatch.setattr(TextHistory, "_insert", lambda self, df, table, *more: insert(self, df, table, *more) if table == history._pieces else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        add(3)
    monkeypatch.undo()
    assert history.batches() == [0, 1, 2]
    last = add(3)
    again = TextHistory(spark, history.folder)
    assert (again.batches(), again._common) == ([0, 1, 2, 3], history._common)
    assert sorted(tuple(r) for r in again.add(3, part(3), "fp", "arrival_no").collect()) == last
    assert stored_rows(again, again._texts) == stored_rows(history, history._texts)
    again.close()


def test_a_crowd_is_compared_with_its_first(spark, monkeypatch):
    """Many texts that all agree cost pairs with the earliest only, in the history and within a batch."""
    monkeypatch.setattr(H, "HEAD", 4)
    rnd = random.Random(5)
    crowds = [["".join(rnd.choices("ABCDEFGH", k=120))] * 60 for _ in range(3)]
    rows = [(edited(rnd, t, 1), 10 * i + j, b) for b, crowd in enumerate([crowds[:1], crowds[:2], crowds]) for j, c in enumerate(crowd) for i, t in enumerate(c, 100 * b)]
    rows = [(t, a, b) for a, (t, _, b) in enumerate(rows, 1)]
    counts = []
    seen = H._verified
    monkeypatch.setattr(H, "_verified", lambda *a: [counts.append(a[0].distinct().count()), seen(*a)][1])
    got = {(r["arrival"], r["matched"]) for r in near_repeats(spark.createDataFrame(rows, "fp string, a long, b int"), "fp", "a", "b").collect()}
    assert got == brute.near_repeats(rows)
    assert sum(counts) < 60 * 60


@pytest.mark.parametrize("seed", range(4))
def test_agreeing_texts_meet_in_a_block(seed):
    """Whatever the edits, also with common pieces everywhere."""
    rnd = random.Random(seed)
    for _ in range(150):
        n = rnd.choice([1, 7, 18, 19, 20, 21, 37, 38, 39, 40, 56, 57, 58, 59, 60, 100, 113, 114, 119, 120, 180, 189, 190, 200, 340, 700])
        base = ("".join(rnd.choices("ABCDEFGHIJ", k=n)) if rnd.random() < 0.5 else ("AAAAAAARI2kuEvCB" * 50)[:n])
        k = int(n * 0.05 + 1e-9)
        step = max(1, n // (k + 1))
        out = list(base)
        for i in range(k, 0, -1):
            at = min(len(out) - 1, i * step + rnd.randint(-1, 1))
            kind = rnd.randrange(3)
            out[at : at + 1] = ["z"] if kind == 0 else [] if kind == 1 else ["z", out[at]]
        pair = [base, "".join(out)]
        if not brute.agree(*pair):
            continue
        codes, starts, ends = H._coded(pa.array(pair))
        common = H.Common([int(x) for c, s in enumerate(H.stretches()) for x in H._pieces_hashed(codes, c, s.piece)[::2]] if rnd.random() < 0.5 else [])
        stored, looked_up = H.blocks_of(codes, starts, ends, common)
        for old, new in ((0, 1), (1, 0)):
            shift = int(max(map(len, pair)) * 0.05 + 1e-9)
            a = [(int(b), int(p)) for t, b, p in zip(*stored, strict=True) if t == old]
            b = [(int(b), int(p)) for t, b, p in zip(*looked_up, strict=True) if t == new]
            assert any(x == y and abs(p - q) <= shift for x, p in a for y, q in b), pair


@pytest.mark.parametrize("seed", range(2))
def test_agreeing_texts_meet_whatever_is_common(seed):
    """Common, very common and other pieces in any mixture: each way of choosing stretches misses nothing."""
    rnd, popular = random.Random(seed), "AAAAAAARI2kuEvCB"
    met = 0
    for _ in range(150):
        tokens = ["".join(rnd.choices("ABCDEFGHIJKLMNOP", k=16)) for _ in range(rnd.choice([2, 4, 8, 12, 14, 20]))]
        base = "".join(popular if rnd.random() < 0.4 else t for t in tokens)
        pair = [base, edited(rnd, base, int(len(base) * 0.05))]
        if not brute.agree(*pair):
            continue
        met += 1
        codes, starts, ends = H._coded(pa.array(pair))
        known = H._coded(pa.array([popular * 2 + (base if rnd.random() < 0.3 else "")]))[0]
        share = rnd.random()
        pieces = {int(x) for c, s in enumerate(H.stretches()) for x in H._pieces_hashed(known, c, s.piece)}
        stored, looked_up = H.blocks_of(codes, starts, ends, H.Common([-1 - x if rnd.random() < share else x for x in pieces]))
        for old, new in ((0, 1), (1, 0)):
            shift = int(max(map(len, pair)) * 0.05 + 1e-9)
            a = [(int(b), int(p)) for t, b, p in zip(*stored, strict=True) if t == old]
            b = [(int(b), int(p)) for t, b, p in zip(*looked_up, strict=True) if t == new]
            assert any(x == y and abs(p - q) <= shift for x, p in a for y, q in b), pair
    assert met > 50


def test_popular_parts_make_no_long_blocks(spark):
    """Texts of different content with runs of one popular part: no block holds a share of them all, which would cost pairs by the square."""
    rnd, popular = random.Random(12), "AAAAAAARI2kuEvCB"
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    rows = []
    for _ in range(2000):
        tokens = ["".join(rnd.choices(alphabet, k=16)) for _ in range(rnd.randint(10, 14))]
        at = rnd.randint(1, len(tokens) - 4)
        tokens[at : at + 3] = [popular] * 3
        rows.append("".join(tokens))
    common = H.common_pieces(spark.createDataFrame([(r,) for r in rows], "text string").coalesce(1))
    (text, block, _), _ = H.blocks_of(*H._coded(pa.array(rows)), H.Common(common))
    held = Counter(b for _, b in set(zip(text.tolist(), block.tolist(), strict=True)))
    assert max(held.values()) <= 0.01 * len(rows)


def test_long_texts_in_parts(monkeypatch):
    rnd = random.Random(9)
    text = "".join(rnd.choices("ABCDEFGHIJ", k=5000))
    whole = H.blocks_of(*H._coded(pa.array([text, "x" * 700])), H.Common([]))
    monkeypatch.setattr(H, "CHUNK", 333)
    parts = H.blocks_of(*H._coded(pa.array([text, "x" * 700])), H.Common([]))
    for a, b in zip(whole, parts, strict=True):
        assert {tuple(map(int, x)) for x in zip(*a, strict=True)} == {tuple(map(int, x)) for x in zip(*b, strict=True)}
    assert (H.parities(*H._coded(pa.array([text]))) == H.parities(*H._coded(pa.array([text])))).all()


def test_repeats_of_nothing(spark):
    none = spark.createDataFrame([], "t string, a long, b int")
    assert near_repeats(none, "t", "a", "b").count() == 0
    assert exact_repeats(none, [F.col("t")], "a", "b").count() == 0


def test_exact_repeats(spark):
    rows = [("r", "h", 1, 0), ("r", "h", 2, 0), ("r", "h", 3, 1), ("r", "H", 4, 1), ("q", "h", 5, 1), ("q", "h", 6, 2), ("r", None, 7, 1), ("r", None, 8, 1), ("q", "h", 6, 2)]
    df = spark.createDataFrame(rows, "recipe string, h string, arrival_no long, batch_no int").withColumn("matched", F.lit(0))
    got = sorted(tuple(r) for r in exact_repeats(df, [F.col("recipe"), F.lower("h")], "arrival_no", "batch_no").collect())
    assert got == [(3, 1), (4, 1), (6, 5)]
