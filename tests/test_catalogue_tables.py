"""Schemas, stamps, evidence tables and running values over several slices."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from waxmill.operators.candidates import track_place
from waxmill.operators.catalog import create_missing, latest_snapshot, stamped, write_snapshot
from waxmill.operators.ranking import carry_forward, number_collisions
from waxmill.sources.evidence import CATALOGUE, encode_ambiguous, read_headers, read_tags, with_quality


def test_missing_tables_are_created_once(spark, tmp_path):
    folder = str(tmp_path)
    write_snapshot(spark.createDataFrame([("b", "i")], CATALOGUE["known_fingerprints"]), f"{folder}/known_fingerprints", 7)
    made = create_missing(spark, folder, CATALOGUE)
    assert sorted(made) == sorted(set(CATALOGUE) - {"known_fingerprints"})
    assert create_missing(spark, folder, CATALOGUE) == []
    assert latest_snapshot(spark, f"{folder}/files").schema == CATALOGUE["files"]
    assert latest_snapshot(spark, f"{folder}/known_fingerprints").count() == 1


def test_only_changed_rows_are_stamped(spark):
    then, now = datetime.datetime(2020, 1, 1), F.lit("2024-05-05 00:00:00").cast("timestamp")
    schema = "path string, title string, date_modified timestamp"
    before = spark.createDataFrame([("a", "x", then), ("b", "x", then), ("c", None, then)], schema)
    after = spark.createDataFrame([("a", "x", then), ("b", "y", then), ("c", None, then), ("d", "z", None)], schema)
    got = {r["path"]: r["date_modified"].year for r in stamped(before, after, ["path"], "date_modified", now).collect()}
    assert got == {"a": 2020, "b": 2024, "c": 2020, "d": 2024}
    fresh = stamped(before.limit(0), after, ["path"], "date_modified").collect()
    assert all(r["date_modified"].year >= 2024 for r in fresh)


#: Golden rows: extension, bits, size, rate, bit rate, score.
GOLDEN = [
    (".flac", 16, 30_000_000, 44_100, 900_000, 3016000000030000.0),
    (".flac", 24, 30_000_000, 96_000, 2_800_000, 3024000000030000.0),
    (".m4a", 16, 28_000_000, 44_100, 850_000, 2516000000028000.0),
    (".wav", 16, 50_000_000, 44_100, 1_411_200, 2016000000050000.0),
    (".mp3", 16, 9_000_000, 44_100, 320_000, 1016000000009000.0),
    (".mp3", 16, 9_000_000, 44_100, 128_000, 1016000000009000.0),
    (".wma", 16, 6_000_000, 44_100, 192_000, 516000000006000.06),
    (".mp4", 16, 9_000_000, 44_100, 256_000, 16000000009000.045),
]


def test_quality_by_headers(spark):
    files = spark.createDataFrame([(f"/m/{i}{g[0].upper()}", g[2]) for i, g in enumerate(GOLDEN)] + [("/m/none.mp3", 5), ("/m/bare.mp3", 1000)], "path string, length bigint")
    headers = spark.createDataFrame([(f"/m/{i}{g[0].upper()}", g[1], g[3], g[4]) for i, g in enumerate(GOLDEN)] + [("/m/bare.mp3", None, None, None)], "path string, bits int, sample_rate int, bitrate int")
    got = {r["path"]: r["quality"] for r in with_quality(files, headers).collect()}
    assert [got[f"/m/{i}{g[0].upper()}"]["score"] for i, g in enumerate(GOLDEN)] == [g[-1] for g in GOLDEN]
    assert got["/m/none.mp3"] is None
    assert (got["/m/bare.mp3"]["bits"], got["/m/bare.mp3"]["sample_rate"], got["/m/bare.mp3"]["bitrate"], got["/m/bare.mp3"]["format"]) == (16, 44100, 0, ".mp3")


def test_readers_pass_over_what_they_cannot_read(spark, tmp_path):
    (tmp_path / "a.mp3").write_bytes(b"no sound")
    files = spark.createDataFrame([(str(tmp_path / "a.mp3"),), ("/nowhere.flac",)], "path string")
    assert read_headers(files).count() == 0
    assert read_tags(files).count() == 0


def test_ambiguous_rows_keep_their_nulls(spark):
    row = spark.range(1).select(F.lit("p").alias("path"), F.array(F.struct(F.lit(0.5).alias("similarity"), F.lit(None).cast("string").alias("country"))).alias("candidates"), F.lit(None).cast("struct<score:double>").alias("quality"))
    got = encode_ambiguous(row).first()
    assert json.loads(got["candidates_json"]) == [{"similarity": 0.5, "country": None}]
    assert got["quality_json"] is None


def test_one_pass_takes_the_first_track(spark):
    media = [{"position": "1", "tracks": [{"position": "1", "title": "x"}, {"position": "2", "title": " SONG\t"}]}, {"position": "2", "tracks": [{"position": "5", "title": "y", "recording": {"id": "r"}}]}]
    df = spark.createDataFrame([(json.dumps(media),), (None,)], "t string").select(F.from_json("t", "array<struct<position:string,tracks:array<struct<position:string,title:string,recording:struct<id:string>>>>>").alias("m"))
    place = lambda passes: [tuple(r[0]) for r in df.coalesce(1).select(track_place(F.col("m"), F.lit("r"), F.lit("song"), passes)).collect()]
    assert place(2) == [("5", "2"), ("1", "1")]
    assert place(1) == [("2", "1"), ("1", "1")]


@pytest.mark.parametrize("runs", [1, 3])
def test_values_are_carried_over_slices(spark, runs):
    """Also where one run, or a run without a name, holds most rows."""
    rnd = random.Random(runs)
    rows = [(None if rnd.random() < 0.1 else f"r{rnd.randrange(runs)}", i, rnd.random() < 0.01, rnd.choice([None, f"v{i}"])) for i in range(4000)]
    df = spark.createDataFrame(rows, "run string, o long, t boolean, v string").repartition(8)
    got = {(r["run"], r["o"]): r["sticky"] for r in carry_forward(df, ["run"], [F.asc("o")], F.col("t"), F.col("v"), "sticky").collect()}
    held, want = {}, {}
    for run, o, t, v in rows:
        want[run, o] = held.get(run)
        if t:
            held[run] = v
    assert got == want
    numbers = number_collisions(df, ["run"], [F.asc("o")])
    seen, want = {}, {}
    for run, o, _, _ in rows:
        want[run, o] = seen.get(run, 0)
        seen[run] = want[run, o] + 1
    assert {(r["run"], r["o"]): r["collision_no"] for r in numbers.collect()} == want
