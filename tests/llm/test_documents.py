"""Packing, mixing and subjects on awkward texts."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waxmill.llm import subjects as S
from waxmill.llm.mixing import Target, mix, source_name, tilted_rates
from waxmill.llm.packing import Plan, best_fit, containers, make_plan, pack, reduce_dominated
from waxmill.llm.queries import QUERIES
from waxmill.llm.tokens import DEFAULT_RANKS, count, encoding, parts


@pytest.fixture(scope="module")
def encoder():
    with open(DEFAULT_RANKS, "rb") as f:
        return encoding(f.read())


def test_parts_keep_every_token(encoder):
    rnd = random.Random(1)
    text = " ".join("".join(rnd.choices("abcdé,. 12\n", k=rnd.randint(1, 12))) for _ in range(80_000))
    assert len(list(parts(text))) > 2
    assert "".join(parts(text)) == text
    assert count(text, encoder) == len(encoder.encode_ordinary(text))
    assert [count(t, encoder) for t in (None, "", " ")] == [0, 0, 1]


def used(plan):
    out, items = defaultdict(int), Counter()
    for size, _, n, first, each in plan.rows:
        items[size] += n
        for k in range(n):
            out[first + k // each] += size
    return out, items


def fewest(items, capacity):
    """The least number of containers, by trying."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in sorted(set(bins)):
            if room >= items[i]:
                rest = list(bins)
                rest.remove(room)
                go(i + 1, [*rest, room - items[i]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_plans_hold_everything():
    rnd = random.Random(2)
    for _ in range(400):
        capacity = rnd.choice([3, 7, 20, 64])
        counts = Counter(rnd.randint(1, capacity) for _ in range(rnd.randint(0, 60)))
        plan = make_plan(dict(counts), capacity)
        full, items = used(plan)
        assert items == counts
        assert len(full) == plan.bins
        assert all(0 < x <= capacity for x in full.values())


def test_the_reduction_loses_no_container():
    rnd = random.Random(3)
    for _ in range(250):
        items = [rnd.randint(3, 20) for _ in range(rnd.randint(1, 9))]
        plan = Plan(20)
        rest = reduce_dominated(Counter(items), plan)
        left = list(itertools.chain.from_iterable([s] * n for s, n in rest.items()))
        assert plan.bins + (fewest(left, 20) if left else 0) == fewest(items, 20)


def test_the_reduction_saves_containers():
    """Instances on which best fit alone needs a container more."""
    rnd, saved = random.Random(11), 0
    for _ in range(3000):
        counts = Counter(rnd.choice([20, 26, 31, 33, 35, 37, 41, 50, 63, 65, 67, 69, 74]) for _ in range(rnd.randint(6, 11)))
        alone, plan = Plan(100), make_plan(dict(counts), 100)
        best_fit(dict(counts), alone)
        if plan.bins < alone.bins:
            saved += 1
            assert plan.fixed_bins > 0
            if saved <= 5:
                assert plan.bins >= fewest(list(counts.elements()), 100)
    assert saved > 0


def test_plan_of_the_documents(spark, small):
    row = QUERIES["p7_plan"](spark, small).first()
    assert row["containers"] == QUERIES["p7_containers"](spark, small).count()
    assert row["least_containers"] <= row["containers"] <= row["least_containers"] + 1
    assert row["items"] == QUERIES["p7_contents"](spark, small).filter("container >= 0").count()


def test_pack(spark, encoder):
    rnd = random.Random(4)
    word = lambda n: " ".join(rnd.choices(["record", "band", "song", "the", "of"], k=n))
    rows = [(i, word(rnd.randint(1, 40))) for i in range(300)] + [(900 + i, None) for i in range(3)] + [(910, ""), (911, word(700)), (912, word(64)), *[(None, "x")] * 40] + [(1000 + i, "same text") for i in range(200)]
    rows += [(5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc long, body string").withColumns({"id": F.lit("clash"), "tokens": F.lit("clash"), "size": F.lit(0)})
    packed = pack(df, "doc", "body", capacity=64)
    got = packed.collect()
    sizes = Counter()
    for r in got:
        sizes[r["doc"]] += r["tokens"]
    want = Counter()
    for d, t in rows:
        want[d] += count(t, encoder)
    assert sizes == want
    room = Counter()
    for r in got:
        if r["container"] >= 0:
            room[r["container"]] += r["tokens"]
    assert max(room.values()) <= 64
    assert len(room) <= -(-sum(room.values()) // 64) + 1
    assert {r["doc"] for r in got if r["container"] == -1} == {900, 901, 902, 910}
    assert {r["doc"] for r in got if r["piece_no"] > 0} == {911}
    assert [r["tokens"] for r in sorted((r for r in got if r["doc"] == 911), key=lambda r: r["piece_no"])][:-1] == [64] * (want[911] // 64)
    assert {r["container"]: r["used"] for r in containers(packed, 64).collect()} == dict(room)
    assert pack(df.limit(0), "doc", "body").count() == 0


def test_found_are_the_long_ones(spark, small, encoder):
    table = pd.read_parquet(f"{small}/documents.parquet")
    assert {r["doc_id"] for r in QUERIES["p7_found"](spark, small).collect()} == {r.doc_id for r in table.itertuples() if count(r.text, encoder) > 8192}


def test_mix(spark, encoder):
    rnd = random.Random(5)
    word = lambda: " ".join(rnd.choices(["record", "band", "song", "the", "of", "tape", "groove"], k=rnd.randint(3, 60)))
    rows = [(i, word(), rnd.choice(["Big One", "big_one", " BIG-one"])) for i in range(900)] + [(2000 + i, word(), "small") for i in range(60)] + [(3000 + i, "copied text of many", "small") for i in range(300)]
    rows += [(4000, None, "small"), (4001, "", "small"), (4002, word(), None), (4003, word(), "  "), (4004, word(), "other"), (None, word(), "small")] + rows[:5]
    df = spark.createDataFrame(rows, "doc long, body string, src string").withColumns({"id": F.lit("clash"), "source": F.lit("clash"), "tokens": F.lit(0)})
    targets = {"big_one": Target(0.6, 1), "small": Target(0.3, 3), "absent": Target(0.1, 2)}
    selection, shares = mix(df, "doc", "body", "src", targets)
    got = {r["source"]: r for r in shares.collect()}
    assert abs(got["big_one"]["reached_share"] - 2 / 3) < 0.01
    assert abs(got["small"]["reached_share"] - 1 / 3) < 0.01
    assert (got["absent"]["reached_share"], got["other"]["selected_tokens"], got[""]["documents"]) == (0.0, 0, 0)
    text_of = {d: t for d, t, _ in rows}
    uses, taken = Counter(), Counter()
    for r in selection.collect():
        assert r["tokens"] == count(text_of[r["doc"]], encoder)
        uses[text_of[r["doc"]]] += r["copies"]
        assert uses[text_of[r["doc"]]] <= targets[r["source"]].max_repeats
        taken[r["source"]] += r["tokens"] * r["copies"]
    assert dict(taken) == {s: got[s]["selected_tokens"] for s in taken}
    capped = {r["source"]: r for r in mix(df, "doc", "body", "src", targets, total=1e9)[1].collect()}
    assert (capped["big_one"]["most_copies"], capped["small"]["most_copies"]) == (1, 3)
    nothing = mix(df.limit(0), "doc", "body", "src", targets)
    assert nothing[0].count() == 0
    assert {r["reached_share"] for r in nothing[1].collect()} == {0.0}
    names = spark.createDataFrame([("A  b-C",), ("\ta_b_c ",), (None,), ("",)], "s string")
    assert [r[0] for r in names.coalesce(1).select(source_name(F.col("s"))).collect()] == ["a_b_c", "a_b_c", "", ""]


def by_bisection(tokens, wanted, most):
    """Rates of single documents, by halving an interval of the multiplier."""
    low, high = -50.0, 50.0
    rates = lambda x: [min(most, math.exp(min(700, x * t))) for t in tokens]
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(r * t for r, t in zip(rates(middle), tokens, strict=True)) < wanted else (low, middle)
    return rates(low), low


def divergence(rates):
    """Relative entropy to using every document once."""
    return sum(r * math.log(r) - r + 1 if r else 1.0 for r in rates)


@pytest.mark.parametrize("seed", range(6))
def test_tilted_rates_solve_the_dual(seed):
    rnd = random.Random(seed)
    tokens = [rnd.choice([1, 2, 5, 9, 30]) for _ in range(40)]
    most = rnd.choice([1, 2, 5])
    wanted = rnd.uniform(0.05, 0.95) * most * sum(tokens)
    counts = sorted(Counter(tokens).items())
    rate, multiplier, steps = tilted_rates(np.array([float(n) for _, n in counts]), np.array([float(t * n) for t, n in counts]), wanted, most)
    of = dict(zip((t for t, _ in counts), rate, strict=True))
    mine = [float(of[t]) for t in tokens]
    plain, x = by_bisection(tokens, wanted, most)
    assert max(abs(a - b) for a, b in zip(mine, plain, strict=True)) < 1e-6
    assert abs(multiplier - x) < 1e-6 and steps < 60
    assert abs(sum(r * t for r, t in zip(mine, tokens, strict=True)) - wanted) < 1e-6 * wanted
    # moving tokens from one document to another only takes the rates farther from the base
    for _ in range(200):
        i, j = rnd.sample(range(len(tokens)), 2)
        moved = list(mine)
        step = rnd.uniform(0, 0.05)
        moved[i] += step / tokens[i]
        moved[j] -= step / tokens[j]
        if moved[i] <= most and moved[j] >= 0:
            assert divergence(moved) >= divergence(mine) - 1e-9


def test_rates_at_their_limits():
    n, t = np.array([3.0, 1.0]), np.array([6.0, 50.0])
    assert tilted_rates(n, t, 0.0, 2)[0].tolist() == [0, 0]
    assert tilted_rates(n, t, 112.0, 2)[0].tolist() == [2, 2]
    assert tilted_rates(n, t, 56.0, 2)[1] == 0


def test_long_documents_are_tilted(spark):
    """A source that must shrink gives up its long documents first, one that must grow repeats them first."""
    rnd = random.Random(7)
    rows = [(1000 * k + i, " ".join(rnd.choices(["record", "band", "song", "tape"], k=rnd.choice([5, 50]))) + f" {k} {i}", s) for k, s in enumerate(("wide", "narrow")) for i in range(600 if k == 0 else 200)]
    df = spark.createDataFrame(rows, "doc long, body string, src string")
    selection, shares = mix(df, "doc", "body", "src", {"wide": Target(0.5, 1), "narrow": Target(0.5, 4)}, total=20_000)
    got = {r["source"]: r for r in shares.collect()}
    assert got["wide"]["available_tokens"] > 10_000 > got["narrow"]["available_tokens"]
    assert all(abs(r["reached_share"] - 0.5) < 0.003 for r in got.values())
    used = Counter()
    for r in selection.collect():
        used[r["source"], r["tokens"] > 25] += r["copies"]
    there = Counter((s, len(t.split()) > 25) for _, t, s in rows)
    rate = {k: used[k] / n for k, n in there.items()}
    assert rate["wide", False] > rate["wide", True] + 0.2
    assert rate["narrow", True] > rate["narrow", False] + 0.2


def sentences_of(text, notices=()):
    encoder = S.Encoder()
    words, number, _ = S.sentences(S.Lines.of(encoder.encode(pa.array([text]))), pa.array(list(notices), pa.int64()).to_numpy())
    out = defaultdict(list)
    for w, n in zip(words, number, strict=True):
        out[n].append(encoder.words[w])
    return [" ".join(out[n]) for n in sorted(out)]


def test_sentences():
    assert sentences_of("The band of Island pt. 2 knew it. It sang, once more! So they say?\n") == ["the band of island pt knew it", "it sang once more", "so they say"]
    assert sentences_of("== Heading of it ==\nOne line is here.\n01  Title and more  3:21\n") == ["one line is here"]
    assert sentences_of("<p>07:58:24 DEBUG comment=Ask them all twice.</p>") == ["debug ask them all twice"]
    assert sentences_of("no stops here\nnor there at all") == ["no stops here", "nor there at all"]
    assert len(sentences_of(" ".join(["word"] * 60))) == 4
    assert [sentences_of(t) for t in ("", " \n\t", "...", "12 34", "Two words.")] == [[]] * 5
    assert S.word_of("d'attente,") == "attente"
    assert S.word_of("half-time.") == "half-time"


def invented(seed, n=40):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(4)) for _ in range(n)})


TOPICS = {t: invented(t) for t in ("sport", "law", "music")}
FRAMES = ["It took them days to get from the {} to the {}.", "Somebody mentioned the {}, and soon everybody discussed the {}.", "Forget the {}; look at the {} instead.", "The {} came first and the {} followed later."]


def make(rnd, topics):
    return " ".join(rnd.choice(FRAMES).format(*rnd.sample(TOPICS[t], 2)) for t in topics)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(6)
    docs, truth = [], {}
    for i in range(1200):
        main = rnd.choice([["sport"], ["law"], ["sport", "law"], []])
        topics = [t for t in main for _ in range(4)] + ["music"] * (4 if main else 8)
        rnd.shuffle(topics)
        text = make(rnd, topics)
        if i % 3 == 0:
            text += "\nSign up for the law and sport letter | Share"
        docs.append((i, text))
        truth[i] = set(main) or {"music"}
    docs += [(5000 + i, docs[3][1]) for i in range(600)]
    truth |= {5000 + i: truth[3] for i in range(600)}
    docs += [(9000, None), (9001, ""), (9002, " \n"), (9003, "12 34"), (None, docs[0][1]), (9004, " ".join(docs[1][1] for _ in range(200)))] + docs[:5]
    truth[9004] = truth[1]
    samples = [(make(rnd, [t] * 3 + ["music"] * 2), "en", t) for t in TOPICS for _ in range(15)] + [(make(rnd, ["law"] * 4), "en", "sport"), (make(rnd, ["law"] * 4), "en", "nonsense")]
    return docs, truth, samples


def test_subjects(spark, corpus):
    docs, truth, samples = corpus
    df = spark.createDataFrame(docs, "doc long, body string").withColumns({"id": F.lit("clash"), "text": F.lit("clash"), "digest": F.lit(1)})
    found = S.subject_areas(df, "doc", "body", samples, ["law", "music", "sport"], "music")
    got = defaultdict(set)
    for r in found.collect():
        got[r["doc"]].add(r["subject"])
    assert not {None, 9000, 9001, 9002, 9003} & set(got)
    right = sum(got[k] == v for k, v in truth.items())
    assert right / len(truth) > 0.97, (right, len(truth), [(k, got[k], v) for k, v in truth.items() if got[k] != v][:10])


def test_subjects_of_nothing(spark, corpus):
    df = spark.createDataFrame([], "doc long, body string")
    assert S.subject_areas(df, "doc", "body", corpus[2], ["law", "music"], "music").count() == 0
    assert S.subject_areas(spark.createDataFrame([(1, "One short text is here.")], "doc long, body string"), "doc", "body", [], ["law", "music"], "music").collect()[0]["subject"] == "music"


def test_notices_are_lines_of_texts_that_differ(spark):
    rnd = random.Random(8)
    line = lambda n: " ".join("".join(rnd.choices("abcdefghijklmnopqrst", k=6)) for _ in range(n))
    log, repeated, notice = [line(6) for _ in range(20)], line(5), "follow us on the usual sites"
    # a tenth are near copies of one log, one log repeats a message, and a notice stands in texts of their own
    texts = ["\n".join([*log, line(6)]) for _ in range(30)] + ["\n".join([repeated] * 50)]
    texts += ["\n".join([notice, *(line(8) for _ in range(10))]) if i % 10 == 0 else "\n".join(line(8) for _ in range(10)) for i in range(270)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "digest string, text string")
    encoded = S.encode_texts(df).filter("digest is not null")
    wanted = S.Lines.of(S.Encoder().encode(pa.array([notice]))).hash.tolist()
    assert S.count_lines_and_words(encoded)[0] == wanted
