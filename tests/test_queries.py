"""Every query of the core against its SQL, over the whole small tables."""

from importlib import import_module

import oracle
import pytest
from pyspark.sql import functions as F

MODULES = [import_module(m) for m in ("waxmill.queries.core", "waxmill.queries.reference", "waxmill.queries.lookup")]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, con, name):
    assert oracle.compare(spark, small, QUERIES[name], SQL[name], con) is None


def test_those_without_sql_are_tested_elsewhere():
    # against plain versions: nested records in test_problems, the most similar text below
    assert set(QUERIES) - set(SQL) == {"p5_found", "p5_tracks", "p5_node_counts", "similarity_best_match"}


def test_nodes_are_counted_by_schema_path(spark, small):
    nodes = QUERIES["p5_found"](spark, small)
    got = {r["schema_path"].split(".")[-1].removesuffix("[]"): r["n_objects"] for r in QUERIES["p5_node_counts"](spark, small).collect()}
    assert set(got) == {"candidates_json", "release", "artists", "mediums", "tracks", "quality_json"}
    # every object of every distinct row; p5_found counts a place of a path once
    for name, node in (("candidates_json", "candidate"), ("artists", "artist"), ("mediums", "medium"), ("tracks", "track"), ("quality_json", "quality")):
        assert got[name] >= nodes.filter(F.col("node") == node).count() > 0
    tracks = QUERIES["p5_tracks"](spark, small).select("path", "candidate_no", "medium_no", "item_no").distinct()
    assert tracks.count() == nodes.filter("node = 'track'").count()


def test_the_most_similar_text_as_brute_force(spark, small):
    from difflib import SequenceMatcher

    texts = {tuple(r) for r in spark.read.parquet(f"{small.replace('0.001', '0.01')}/known_fingerprints.parquet").select("arrival_no", "fingerprint").collect() if r[0] is not None and (r[1] or "").strip(" \t\r\n")}
    cut = lambda t: {t[i : i + 16] for i in range(0, min(len(t), 256), 16)}
    want = {}
    for a, t in texts:
        if a % 100 == 0:
            met = [(-SequenceMatcher(None, t, u).ratio(), b) for b, u in texts if b != a and cut(t) & cut(u)]
            if met:
                want[a] = min(met)[1]
    got = {r["probe"]: r["arrival_no"] for r in QUERIES["similarity_best_match"](spark, small.replace("0.001", "0.01")).collect()}
    assert got == want


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["table_name", "ref_key", "batch_no", "kind"]
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_record_of_a_group_is_left_out(spark, small):
    from waxmill.queries.reference import current, releases

    files = current(spark, small).filter("acoustid_id is not null")
    slices = QUERIES["group_all_records"](spark, small).collect()
    assert sorted(p for r in slices for p in r["paths"].split("\n")) == sorted(r["path"] for r in files.select("path").collect())
    assert max(len(r["paths"].split("\n")) for r in slices) <= 100
    larger = small.replace("sf0.001", "sf0.01")
    ranks = QUERIES["candidate_rank_all"](spark, larger).collect()
    assert sorted(r["release_id"] for r in ranks) == sorted(r["release_id"] for r in releases(spark, larger).select("release_id").collect())
    assert max(r["rank_no"] for r in ranks) > 5


def test_dirty_tracks_and_lists(spark, tmp_path):
    """No track number is passed over, and answers are lists."""
    tracks = ["", "3/16", "7", "101", " 3", "+3", "-4", "0", "21", "1.5", "1e2", "A1", "99999999999", "1, 3", "1,3,", "2,x", ",", None]
    (tmp_path / "t").mkdir()
    spark.createDataFrame([("a", t) for t in tracks], "album_id string, track_no string").coalesce(1).write.parquet(str(tmp_path / "t" / "files.parquet"))
    folder = str(tmp_path / "t")
    con = oracle.connect(folder)
    for name in ("zfill_track_all", "selection_lists"):
        assert oracle.compare(spark, folder, QUERIES[name], SQL[name], con) is None
    got = {r["track_no"]: (r["padded"], r["label"], r["number"]) for r in QUERIES["zfill_track_all"](spark, folder).collect()}
    assert set(got) == set(tracks)
    assert (got[""], got["3/16"], got["7"], got["99999999999"]) == (("00", "00 x", None), ("3/16", "16 x", None), ("07", "07 x", 7), ("99999999999", "99 x", None))
    picks = {r["answer"]: r["picks"] for r in QUERIES["selection_lists"](spark, folder).collect()}
    assert {a for a in tracks if a is not None} < set(picks)
    assert {a: p for a, p in picks.items() if p is not None} == {"7": "7", " 3": "3", "+3": "3", "1, 3": "1,3"}
