"""Ranking, upserts, candidates, plans and sources on small fixtures."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from waxmill.operators.blocks import best_match, block_candidates, block_index
from waxmill.operators.candidates import RECORDINGS, RESULTS, first_seen, flatten_response, flatten_search, is_answer, ranked, track_place, with_fallback
from waxmill.operators.catalog import add_blocks_of_new, add_missing_columns, delete_keys, insert_or_ignore, latest_snapshot, prune, repoint, upsert, write_snapshot
from waxmill.operators.ranking import carry_forward, distributed_rank, keep_best, losers, number_collisions, paginate, rate_slots
from waxmill.plans.maintenance import repair_status, write_report
from waxmill.plans.organise import empty_folders, file_actions, tag_plan
from waxmill.plans.views import register_album_tracks
from waxmill.queries.reference import most_similar
from waxmill.session import scratch_path
from waxmill.sources.config import read_config, read_folders, write_default_config
from waxmill.sources.manifest import excerpt_hashes, fingerprints, readable, scan_folder


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_distributed_rank_is_the_row_number(spark):
    rnd = random.Random(2)
    data = [("hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None]), rnd.randint(0, 50), i) for i in range(2000)]
    df = spark.createDataFrame(data, "g string, s int, id int")
    got = {r["id"]: r["rank_no"] for r in distributed_rank(df, ["g"], [F.desc("s"), F.asc("id")]).collect()}
    want = {}
    for g in {x[0] for x in data}:
        for k, x in enumerate(sorted((x for x in data if x[0] == g), key=lambda x: (-x[1], x[2])), 1):
            want[x[2]] = k
    assert got == want
    assert distributed_rank(df.limit(0), ["g"], [F.asc("id")]).count() == 0
    pages = {r["id"]: r["page_no"] for r in paginate(df, [F.asc("id")], 100).collect()}
    assert pages == {i: i // 100 for i in range(2000)}


def test_rate_slots_are_greedy(spark):
    rnd = random.Random(4)
    times = sorted(rnd.randint(0, 3_000_000) for _ in range(300))
    df = spark.createDataFrame(list(enumerate(times)), "id long, us long")
    want, free = {}, None
    for i, t in enumerate(times):
        slot = t if free is None else max(t, free)
        want[i], free = slot, slot + 20_000
    assert {r["id"]: r["slot_us"] for r in rate_slots(df, "us", "id", 20_000).collect()} == want


def test_keep_best_and_losers(spark):
    df = spark.createDataFrame([("a", 1, "p"), ("a", 2, "q"), ("a", 2, "o"), ("b", None, "r"), (None, 1, "s")], "k string, s int, id string")
    order = [F.col("s").desc_nulls_last(), F.asc("id")]
    assert {r["id"] for r in keep_best(df, ["k"], order).collect()} == {"o", "r", "s"}
    assert rows(losers(df, ["k"], "id", order).select("id", "winner")) == [("p", "o"), ("q", "o")]
    best = keep_best(df, ["k"], order)
    assert rows(keep_best(best.filter("k is not null"), ["k"], order)) == rows(best.filter("k is not null"))


def test_carry_forward_keeps_a_reset(spark):
    df = spark.createDataFrame([("r", 1, True, "a"), ("r", 2, False, "x"), ("r", 3, True, None), ("r", 4, False, "x"), ("q", 1, False, "x")], "run string, o int, t boolean, v string")
    got = {(r["run"], r["o"]): r["s"] for r in carry_forward(df, ["run"], [F.asc("o")], F.col("t"), F.col("v"), "s").collect()}
    assert got == {("r", 1): None, ("r", 2): "a", ("r", 3): "a", ("r", 4): None, ("q", 1): None}


def test_upserts(spark):
    old = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "k string, v string, w string")
    new = spark.createDataFrame([("b", "3"), ("c", "4"), ("c", "5")], "k string, v string")
    order = [F.desc("v")]
    assert rows(upsert(old, new, ["k"], order).fillna("-")) == [("a", "1", "x"), ("b", "3", "-"), ("c", "5", "-")]
    assert rows(insert_or_ignore(old.select("k", "v"), new, ["k"], order)) == [("a", "1"), ("b", "2"), ("c", "5")]
    assert rows(delete_keys(old, new, ["k"])) == [("a", "1", "x")]
    assert rows(repoint(old, new.filter("k = 'b'"), ["k"], "v")) == [("a", "1", "x"), ("b", "3", "y")]
    once = upsert(old, new, ["k"], order)
    assert rows(upsert(once, new, ["k"], order).fillna("-")) == rows(once.fillna("-"))
    assert add_missing_columns(new, {"w": "string", "v": "int"}).dtypes == [("k", "string"), ("v", "string"), ("w", "string")]
    kept = prune({"o": (old, "k")}, spark.createDataFrame([("a",), ("z",)], "path string"))
    assert rows(kept["o"]) == [("a", "1", "x")]


def test_snapshots(spark):
    folder = scratch_path(spark, "snapshots")
    assert latest_snapshot(spark, folder) is None
    for v in (1, 2, 10):
        write_snapshot(spark.range(v), folder, v)
    assert latest_snapshot(spark, folder).count() == 10


def test_blocks_of_new_ids_only(spark):
    known = spark.createDataFrame([("x" * 16, "a", 0)], "block string, id string, pos int")
    texts = spark.createDataFrame([("a", "y" * 16), ("b", "z" * 20), ("c", None)], "id string, fingerprint string")
    assert rows(add_blocks_of_new(known, texts, "id")) == [("x" * 16, "a", 0), ("z" * 4, "b", 1), ("z" * 16, "b", 0)]


def test_block_candidates_as_plain(spark):
    rnd = random.Random(5)
    pool = ["".join(rnd.choices("abcdefgh", k=16)) for _ in range(60)]
    texts = [(i, "".join(rnd.choice(pool) if rnd.random() < 0.7 else "H" * 16 for _ in range(rnd.randint(0, 16)))) for i in range(150)]
    index = block_index(spark.createDataFrame(texts, "id int, fingerprint string"), "id")
    probes = index.filter("id % 10 = 0").select(F.col("id").alias("probe"), "block")
    sets = {i: {t[k : k + 16] for k in range(0, len(t), 16)} for i, t in texts}
    got = {(r["probe"], r["id"]): r["shared"] for r in block_candidates(probes, index, "probe", "id", 3, row_share=0.1).collect()}
    want = {(p, i): len(sets[p] & sets[i]) for p in sets for i in sets if p % 10 == 0 and len(sets[p] & sets[i]) >= 3 and (sets[p] & sets[i]) - {"H" * 16}}
    assert got == want
    pairs = spark.createDataFrame([(1, 2, "abcd", "abcd"), (1, 3, "abcd", "abcx"), (4, 5, "aa", "zz")], "p int, k int, a string, b string")
    assert rows(best_match(pairs, "p", "k", F.col("a"), F.col("b"), 0.5)) == [(1, 2, 1.0)]


def test_block_candidates_by_heavy_blocks_alone(spark):
    rnd = random.Random(6)
    pool = ["".join(rnd.choices("abcdefgh", k=16)) for _ in range(12)]
    # a third are copies, and all blocks of the rest but a few are frequent too
    sets = {i: set(pool[:5]) if i % 3 == 0 else {*rnd.sample(pool, rnd.randint(1, 5)), f"own{i}"} for i in range(120)}
    index = spark.createDataFrame([(i, b) for i, s in sets.items() for b in s], "id int, block string")
    probes = index.filter("id % 10 = 0").select(F.col("id").alias("probe"), "block")
    for least in (1, 2, 4):
        got = {(r["probe"], r["id"]): r["shared"] for r in block_candidates(probes, index, "probe", "id", least, row_share=0.02).collect()}
        assert got == {(p, i): len(sets[p] & sets[i]) for p in sets for i in sets if p % 10 == 0 and len(sets[p] & sets[i]) >= least}


def test_most_similar_by_heavy_blocks_alone(spark):
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choices("abcdefghijklmnop", k=n))
    texts = {i: "H" * 16 + word(rnd.randint(20, 60)) for i in range(80)} | {80: word(40)}
    texts |= {i: texts[0] for i in (20, 41)} | {30: texts[33]}
    blocks_of = {i: {t[k : k + 16] for k in range(0, len(t), 16)} for i, t in texts.items()}
    want = {}
    for p in range(0, 81, 10):
        found = [(-SequenceMatcher(None, texts[p], texts[i]).ratio(), i) for i in texts if i != p and blocks_of[p] & blocks_of[i]]
        if found:
            want[p] = (min(found)[1], -min(found)[0])
    df = spark.createDataFrame(list(texts.items()), "arrival_no long, fingerprint string")
    assert {r["probe"]: (r["arrival_no"], r["ratio"]) for r in most_similar(df, F.col("arrival_no") % 10 == 0).collect()} == want
    assert len(want) == 8


TRACK = {"position": "2", "title": " Song ", "recording": {"id": "other"}}
RESPONSE = [
    {
        "id": "i1",
        "score": 0.9,
        "recordings": [
            {
                "id": "r1",
                "title": "",
                "artists": [],
                "releases": [
                    {"id": "A", "title": "First", "country": None, "artists": [], "date": {"year": 2001}, "mediums": [{"position": "1", "tracks": [TRACK]}, {"position": "2", "tracks": [{"position": "7", "title": "z", "recording": {"id": "r1"}}]}]},
                    {"id": "B", "title": None, "country": "US", "artists": [{"name": "X"}], "date": None, "mediums": None},
                ],
            }
        ],
    },
    {"id": "i2", "score": 0.8, "recordings": [{"id": "r2", "title": "T", "artists": None, "releases": [{"id": "A", "title": "Again", "country": "US"}]}]},
]


@pytest.fixture(scope="module")
def candidates(spark):
    df = spark.createDataFrame([("p", json.dumps(RESPONSE)), ("none", None), ("empty", "[]")], "path string, t string")
    return flatten_response(df.select("path", F.from_json("t", RESULTS).alias("results")))


def test_candidates(spark, candidates):
    once = first_seen(candidates)
    assert rows(once.select("release_id", "album_title", "similarity", "country", "date", "artist", "recording_title")) == [("A", "First", 0.9, "XX", "2001", "Unknown Artist", "Unknown"), ("B", "Unknown Album", 0.9, "US", "Unknown", "X", "Unknown")]
    assert [r["release_id"] for r in ranked(once).orderBy("rank_no").collect()] == ["B", "A"]
    owned = spark.createDataFrame([("i1", "A"), ("i1", None)], "result_id string, release_id string")
    assert [(r["release_id"], r["is_owned"]) for r in ranked(once, owned).orderBy("rank_no").collect()] == [("A", True), ("B", False)]
    place = once.filter("release_id = 'A'").select(track_place(F.col("mediums"), F.lit("r1"), F.lit("song")).alias("a"), track_place(F.col("mediums"), F.lit("none"), F.lit("song")).alias("b"), track_place(F.col("mediums"), F.lit("none"), F.lit("none")).alias("c")).first()
    assert [tuple(x) for x in place] == [("7", "2"), ("2", "1"), ("1", "1")]
    missing = once.filter("release_id = 'B'").select(track_place(F.col("mediums"), F.lit("r1"), F.lit("")).alias("a")).first()
    assert tuple(missing["a"]) == ("1", "1")
    both = with_fallback(once.select("path", "release_id"), spark.createDataFrame([("p", "no"), ("q", "yes")], "path string, release_id string"))
    assert rows(both) == [("p", "A"), ("p", "B"), ("q", "yes")]
    flags = spark.createDataFrame([("ok", [1]), ("ok", []), ("ok", None), ("no", [1]), (None, [1])], "s string, r array<int>")
    assert [r[0] for r in flags.coalesce(1).select(is_answer(F.col("s"), F.col("r"))).collect()] == [True, False, False, False, False]


def test_text_search_gives_the_same_rows(spark, candidates):
    found = [{"id": "r9", "title": "T", "ext:score": "87", "release-list": [{"id": "R", "title": "A", "date": "1999-02-01", "medium-list": [{"position": "2", "track-list": [{"number": "B3", "recording": {"id": "r9"}}]}]}, {"id": "Q", "date": None}]}, {"id": "r8", "ext:score": "x"}]
    df = spark.createDataFrame([("p", json.dumps(found)), ("n", None)], "path string, t string")
    flat = flatten_search(df.select("path", F.lit("who").alias("artist"), F.from_json("t", RECORDINGS).alias("recordings")))
    assert {r["artist"] for r in flat.collect()} == {"who"}
    assert flatten_search(df.select("path", F.lit("who").alias("artist"), F.from_json("t", RECORDINGS).alias("recordings")), 0).count() == 0
    assert flat.columns == candidates.columns
    got = flat.select("release_id", "similarity", "date", "country", "album_title", track_place(F.col("mediums"), F.lit("r9"), F.lit("none")).alias("place"))
    assert sorted((*tuple(r)[:5], tuple(r["place"])) for r in got.collect()) == [("Q", 0.87, "0000", "XX", "Unknown Album", ("1", "1")), ("R", 0.87, "1999", "XX", "A", ("B3", "2"))]
    assert first_seen(with_fallback(candidates, flat)).count() == 2


def test_file_plans(spark):
    moves = spark.createDataFrame([("s1", "/l/a/x.mp3", 1), ("s1", "/l/b/x.mp3", 2), ("s2", "/l/b/x.mp3", 1), ("s3", "noext", 1), ("s4", "noext", 1)], "src string, target string, o int")
    taken = spark.createDataFrame([("/l/a/x.mp3",)], "target string")
    got = rows(file_actions(moves, [F.asc("o")], taken))
    assert got == [("s1", "/l/a/x (1).mp3", "copy"), ("s1", "/l/b/x (1).mp3", "move"), ("s2", "/l/b/x.mp3", "move"), ("s3", "noext", "move"), ("s4", "noext (1)", "move")]
    assert rows(number_collisions(moves, ["target"], [F.asc("src")]).select("src", "target", "collision_no"))[-1] == ("s4", "noext", 1)
    tags = spark.createDataFrame([(".MP3", "t", None), (".m4a", "t", "3"), (".ogg", "t", "1")], "e string, t string, n string")
    assert [r[0] for r in tags.coalesce(1).select(tag_plan(F.col("e"), {"title": F.col("t"), "track_no": F.col("n")})).collect()] == [{"TIT2": "t"}, {"\xa9nam": "t", "trkn": "3/0"}, None]
    folders = spark.createDataFrame([("/a",), ("/a/b",), ("/c",), ("/c/d",)], "folder string")
    assert rows(empty_folders(folders, spark.createDataFrame([("/a/b/x",)], "path string"))) == [("/c", 1), ("/c/d", 2)]


def test_repairs_and_view(spark, tmp_path):
    df = spark.createDataFrame([("a", True, 3.0, ""), ("b", True, 0.0, "empty"), ("c", False, 1.0, "bad"), ("d", None, None, "?")], "path string, ok boolean, s double, message string")
    status = df.withColumn("status", repair_status(F.col("ok"), F.col("s")))
    assert [r["status"] for r in status.orderBy("path").collect()] == ["OK", "DELETED", "ERROR", "ERROR"]
    write_report(status, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == 3
    files = spark.createDataFrame([("p", "i", "3", "t", 1.0)], "path string, album_id string, track_no string, title string, quality_score double")
    albums = spark.createDataFrame([("i", "al", "ar")], "release_id string, album_title string, album_artist string")
    register_album_tracks(files, albums)
    register_album_tracks(files, albums)
    assert rows(spark.sql("SELECT title, path FROM album_tracks_V WHERE album_artist ILIKE 'AR'")) == [("03 t", "p")]


def test_manifest_and_config(spark, tmp_path):
    for name, data in {"a.MP3": b"x", "sub/b.flac": b"", "c.ogg": b"x"}.items():
        p = tmp_path / "m" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    found = scan_folder(spark, str(tmp_path / "m"))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["a.MP3", "b.flac"]
    assert [r["path"].rsplit("/", 1)[1] for r in readable(found).collect()] == ["a.MP3"]
    assert scan_folder(spark, str(tmp_path / "m"), audio_only=False).count() == 3
    assert [r["audio_hash"] for r in excerpt_hashes(readable(found), "seek15_len5_mono22k").collect()] == [None]
    assert [r["fingerprint"] for r in fingerprints(readable(found)).collect()] == [None]
    write_default_config(str(tmp_path / "c.json"))
    assert read_config(str(tmp_path / "c.json")).dry_run is True
    (tmp_path / "d.json").write_text('{"dry_run": "no", "prune": "Yes", "music_folder": null}')
    config = read_config(str(tmp_path / "d.json"))
    assert (config.dry_run, config.prune, config.music_folder, config.process) == (False, True, "", True)
    (tmp_path / "e.ini").write_text("[Settings]\nsource_dir = /a\ntarget_dir = /b\n")
    assert read_folders(str(tmp_path / "e.ini")) == ("/a", "/b")
    assert read_folders(str(tmp_path / "none.ini")) == (None, None)
