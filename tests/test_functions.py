"""Scalar expressions against golden values."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from waxmill.functions.ids import canonical_id, valid_path
from waxmill.functions.quality import quality_score
from waxmill.functions.similarity import matching_ratio
from waxmill.functions.text import blocks, decision, folder, normal_title, parse_flag, sanitise, search_terms, selected_numbers, stem, suffix, track_label, zfill

ID = "0d750307-c199-4a61-a731-fdf48faa8eb3"


def values(spark, rows, kind, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_ids(spark):
    rows = [ID, ID.upper(), ID.replace("-", ""), " {" + ID + "}\t", None, "", "e", "0" * 32, ID + "0", ID[:-1], "z" + ID[1:], ID + "\n"]
    assert values(spark, rows, "string", canonical_id) == [ID] * 4 + [None] * 7 + [ID]


def test_paths(spark):
    assert values(spark, ["/a ", " ", "\t\n", "", None], "string", valid_path) == ["/a ", None, None, None, None]
    paths = ["/a/b.c/x.y.MP3", "x", "/a/.hidden", "a/b.", None]
    assert values(spark, paths, "string", suffix) == [".mp3", "", "", ".", None]
    assert values(spark, paths, "string", stem) == ["x.y", "x", ".hidden", "b", None]
    assert values(spark, paths, "string", folder) == ["/a/b.c", "", "/a", "a", None]


@pytest.mark.parametrize(
    ("given", "clean"),
    [("AC/DC", "AC-DC"), ("Back\\Slash", "Back-Slash"), ("Motörhead: Live!", "Motörhead Live"), ("  padded  ", "padded"), ("", "Unknown"), (None, "Unknown"), ("01 - What's Up?.mp3", "01 - Whats Up.mp3"), ("Sigur Rós (½)", "Sigur Rós ½"), ("étude", "etude"), ("???", "Unknown"), ("..", "Unknown")],
)
def test_sanitise(spark, given, clean):
    assert values(spark, [given], "string", sanitise) == [clean]
    assert values(spark, [clean], "string", sanitise) == [clean]


def test_labels(spark):
    tracks = ["1", "3", "101", "A1", None]
    assert values(spark, tracks, "string", lambda c: track_label(c, F.lit("x"))) == ["01 x", "03 x", "01 x", "A1 x", None]
    assert values(spark, tracks, "string", zfill) == ["01", "03", "101", "A1", None]
    assert values(spark, [" Song ", None, "\tSong\n"], "string", normal_title) == ["song", "", "song"]
    assert [tuple(x) for x in values(spark, [" S", "q\n", "1,\t2", "9", "x", "", None], "string", lambda c: decision(c, F.lit(5)))] == [("skip", None), ("quit", None), ("select", [1, 2]), (None, None), (None, None), (None, None), (None, None)]
    assert values(spark, ["TRUE ", "1", "yes", "t", "false", "0", "", None], "string", lambda c: parse_flag(c, True)) == [True] * 4 + [False] * 3 + [True]
    assert values(spark, ["1, 3", "4", "x", "", None], "string", lambda c: selected_numbers(c, F.lit(3))) == [[1, 3], None, None, None, None]
    assert values(spark, ["b", "", None], "string", lambda c: search_terms(F.lit("a"), F.lit("t"), c)) == ['artist:"a" AND recording:"t" AND release:"b"'] + ['artist:"a" AND recording:"t"'] * 2


def test_blocks(spark):
    a, b = "A" * 16, "B" * 16
    assert values(spark, [a + b + "CCCCC", "", None], "string", blocks) == [[a, b, "CCCCC"], [], []]
    assert [len(x) for x in values(spark, ["x" * 256, "x" * 300], "string", blocks)] == [16, 16]


def test_quality(spark):
    rows = [(".flac", 16, 30000000, 44100, 900000), (".flac", 24, 30000000, 96000, 2800000), (".m4a", 16, 28000000, 44100, 850000), (".wav", 16, 50000000, 44100, 1411200), (".mp3", 16, 9000000, 44100, 320000), (".MP3", None, 9000000, None, 128000), (".wma", 16, 6000000, 44100, 192000), (".mp4", 16, 9000000, 44100, 256000)]
    df = spark.createDataFrame(rows, "e string, b int, s long, r int, k int")
    got = [r[0] for r in df.coalesce(1).select(quality_score(*(F.col(c) for c in "ebsrk"))).collect()]
    assert got == [3016000000030000.0, 3024000000030000.0, 2516000000028000.0, 2016000000050000.0, 1016000000009000.0, 1016000000009000.0, 516000000006000.06, 16000000009000.045]


def test_ratio_is_the_matcher_s(spark):
    rnd = random.Random(3)
    pairs = [("".join(rnd.choices("abcd", k=rnd.randint(0, 300))), "".join(rnd.choices("abcd", k=rnd.randint(0, 300)))) for _ in range(40)]
    df = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string")
    for junk in (True, False):
        for r in df.select("a", "b", matching_ratio(F.col("a"), F.col("b"), junk).alias("r")).collect():
            want = None if r["a"] is None or r["b"] is None else difflib.SequenceMatcher(None, r["a"], r["b"], autojunk=junk).ratio()
            assert r["r"] == want
