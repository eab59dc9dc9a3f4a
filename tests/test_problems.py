"""Heavy keys, nested records and orphan references on awkward tables, against plain versions."""

import json
import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from waxmill.operators.nested import Node, label_nodes, node_table
from waxmill.operators.references import Parent, Reference, orphan_references, orphan_summary
from waxmill.operators.skew import distinct_owner_counts, heavy_keys, widespread_keys
from waxmill.queries.core import CANDIDATES, QUALITY, p5_found


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(1)
    rows = [("hot", f"o{rnd.randint(0, 900)}") for _ in range(3000)] + [(f"k{rnd.randint(0, 2000)}", f"o{rnd.randint(0, 900)}") for _ in range(6000)]
    rows += [(None, "o1"), ("k1", None), (None, None), ("", "o1"), ("x" * 5000, "o1")]
    return rows + rows[:500]


def test_counts_are_exact_under_skew(spark, skewed):
    df = spark.createDataFrame(skewed, "block string, who string").withColumns({"owners": F.lit(7), "owner": F.lit("clash"), "key": F.lit(1)})
    want = defaultdict(set)
    for k, o in skewed:
        if k is not None and o is not None:
            want[k].add(o)
    assert [r["block"] for r in heavy_keys(df, "block").collect()] == ["hot"]
    got = {r["block"]: r["owners"] for r in distinct_owner_counts(df, "block", "who").collect()}
    assert got == {k: len(v) for k, v in want.items()}
    everyone = len({o for _, o in skewed if o is not None})
    assert {r["block"] for r in widespread_keys(df, "block", "who", 1 / 50).collect()} == {k for k, v in want.items() if len(v) >= everyone / 50}


def test_counts_of_nothing(spark):
    df = spark.createDataFrame([], "block string, owner string")
    assert distinct_owner_counts(df, "block", "owner").count() == 0
    assert widespread_keys(df, "block", "owner", 0.02).count() == 0
    nulls = spark.createDataFrame([(None, None)], "block string, owner string")
    assert distinct_owner_counts(nulls, "block", "owner").count() == 0


def one(x):
    while isinstance(x, list) and len(x) == 1:
        x = x[0]
    return x if isinstance(x, dict) else None


def many(x):
    return [(i, y) for i, v in enumerate([x] if isinstance(x, dict) else x if isinstance(x, list) else []) if (y := one(v)) is not None]


def plain_nodes(candidates, quality):
    def value(text):
        try:
            while isinstance(text, str):
                text = json.loads(text)
            return text
        except ValueError:
            return None

    for c, x in many(value(candidates)):
        yield "candidate", c, -1, -1
        release = one(x.get("release")) or {}
        for i, _ in many(release.get("artists")):
            yield "artist", c, -1, i
        for m, y in many(release.get("mediums")):
            yield "medium", c, m, -1
            for t, _ in many(y.get("tracks")):
                yield "track", c, m, t
    if one(value(quality)) is not None:
        yield "quality", -1, -1, -1


def test_nested_found_as_plain(spark, small):
    table = pd.read_parquet(f"{small}/ambiguous_files.parquet")
    want = {(r.path, *n) for r in table.itertuples() if (r.path or "").strip(" \t\r\n") for n in plain_nodes(r.candidates_json, r.quality_json)}
    got = p5_found(spark, small).collect()
    assert {tuple(r) for r in got} == want
    assert len(got) == len(want)


def test_nested_shapes(spark):
    t = {"position": "A1", "title": "x"}
    texts = {
        "plain": [{"similarity": 1, "release": {"artists": [{"name": "a"}, None, 5], "mediums": [None, {"tracks": [t, None, t]}]}}],
        "object for array": {"release": [{"artists": {"name": "b"}, "mediums": {"tracks": t}}]},
        "nulls": [None, {"release": None}, {"release": {"artists": None, "mediums": []}}, 3, "x", []],
        "elsewhere": [{"artists": [{"name": "no"}], "tracks": [t], "recording": {"artists": [{"name": "no"}]}}],
    }
    rows = [(k, json.dumps(v)) for k, v in texts.items()]
    rows += [("text", json.dumps(json.dumps(texts["plain"]))), ("broken", rows[0][1][:-1]), ("more", rows[0][1] + "]"), ("nan", "[{}, NaN]"), ("empty", ""), ("blank", "  "), ("null", None), ("word", '"abc"'), ("number", "12"), ("deep", "[" * 100_000 + "]" * 100_000), (None, rows[0][1])]
    rows += [("long", json.dumps([texts["plain"][0]] * 3000)), rows[0]]
    df = spark.createDataFrame(rows, "path string, c string").withColumns({"key": F.lit("clash"), "node": F.lit("clash")})
    nodes = label_nodes(df, F.col("path"), {"c": CANDIDATES})
    found = defaultdict(list)
    for r in nodes.collect():
        found[r["key"]].append((r["node"], tuple(r["ordinals"])))
        assert r["dewey"][: len(r["parent_dewey"])] == r["parent_dewey"]
    count = lambda k, n: len([x for x in found[k] if x[0] == n])
    assert sorted(set(found)) == ["elsewhere", "long", "nulls", "object for array", "plain", "text"]
    assert sorted(x for x in set(found["plain"]) if x[0] != "release") == [("artist", (0, 0)), ("candidate", (0,)), ("medium", (0, 1)), ("track", (0, 1, 0)), ("track", (0, 1, 2))]
    assert set(found["text"]) == set(found["plain"])
    assert count("plain", "candidate") == 2
    assert set(found["object for array"]) == {("candidate", (0,)), ("release", (0,)), ("artist", (0, 0)), ("medium", (0, 0)), ("track", (0, 0, 0))}
    assert [x for x in sorted(found["nulls"]) if x[0] == "candidate"] == [("candidate", (1,)), ("candidate", (2,))]
    assert found["elsewhere"] == [("candidate", (0,))]
    assert count("long", "track") == 6000


def test_tables_link_to_their_parents(spark, small):
    df = spark.read.parquet(f"{small}/ambiguous_files.parquet").dropDuplicates(["path", "candidates_json"])
    nodes = label_nodes(df, F.col("path"), {"candidates_json": CANDIDATES, "quality_json": QUALITY})
    tracks = node_table(nodes, "track", ("c", "m", "t"), ("title",)).select("key", "document", "parent_dewey")
    media = node_table(nodes, "medium", ("c", "m")).select("key", "document", F.col("dewey").alias("parent_dewey"))
    assert tracks.count() > 0
    assert tracks.join(media, ["key", "document", "parent_dewey"], "left_anti").count() == 0


def test_no_documents(spark):
    assert label_nodes(spark.createDataFrame([], "path string, c string"), F.col("path"), {"c": Node("x")}).count() == 0


def test_orphans(spark):
    parents = spark.createDataFrame([("a", 0), ("a", 5), ("b", 3), (None, 0), ("n", None)], "id string, batch_no int").withColumn("kind", F.lit("clash"))
    children = spark.createDataFrame([("a", 0), ("b", 2), ("b", 3), ("b", 2), ("c", 1), ("c", None), ("b", None), (None, 1), ("n", 1), ("hot", 4)] + [("hot", 4)] * 500, "ref string, batch_no int").withColumn("table_name", F.lit("clash"))
    p = Parent("p", parents, F.col("id"), F.col("batch_no"))
    found = orphan_references([p], [Reference("t", children, F.col("ref"), F.col("batch_no"), "p")])
    want = {("t", "b", 2, "late", 2), ("t", "c", 1, "missing", 1), ("t", "c", None, "missing", 1), ("t", "b", None, "late", 1), ("t", "hot", 4, "missing", 501)}
    assert {tuple(r) for r in found.collect()} == want
    assert ("t", 4, "missing", 1, 501) in {tuple(r) for r in orphan_summary(found).collect()}
    none = orphan_references([p], [Reference("t", children.limit(0), F.col("ref"), F.col("batch_no"), "p")])
    assert none.count() == 0
    alone = orphan_references([Parent("p", parents.limit(0), F.col("id"), F.col("batch_no"))], [Reference("t", children, F.col("ref"), F.col("batch_no"), "p")])
    assert {r["kind"] for r in alone.collect()} == {"missing"}
