"""Ranked candidates out of nested lookup responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waxmill.functions.text import first_filled, normal_title
from waxmill.operators.ranking import keep_best

_ARTISTS = "array<struct<name:string>>"
#: A lookup response: results, their recordings and releases, the releases' media and tracks.
RELEASE = f"struct<id:string,title:string,country:string,artists:{_ARTISTS},date:struct<year:int>,mediums:array<struct<position:string,tracks:array<struct<position:string,title:string,recording:struct<id:string>>>>>>"
RESULTS = f"array<struct<id:string,score:double,recordings:array<struct<id:string,title:string,artists:{_ARTISTS},releases:array<{RELEASE}>>>>>"
#: A text search's response.
SEARCH_MEDIA = "array<struct<position:string,`track-list`:array<struct<number:string,recording:struct<id:string>>>>>"
RECORDINGS = f"array<struct<id:string,title:string,`ext:score`:string,`release-list`:array<struct<id:string,title:string,date:string,country:string,`medium-list`:{SEARCH_MEDIA}>>>>"


def is_answer(status: Column, results: Column) -> Column:
    """Whether a response holds results."""
    return F.coalesce((status == "ok") & (F.size(results) > 0), F.lit(False))


def flatten_response(responses: DataFrame) -> DataFrame:
    """A row per release in `results` of each `path`, with its place (pos) over results, recordings and releases, defaults filled in."""
    one = responses.select("path", F.posexplode("results").alias("r", "result"))
    two = one.select("path", "r", F.coalesce("result.score", F.lit(0.0)).alias("similarity"), F.col("result.id").alias("result_id"), F.posexplode("result.recordings").alias("c", "recording"))
    three = two.select("*", F.posexplode("recording.releases").alias("l", "release"))
    artist = F.coalesce(F.get("release.artists", F.lit(0))["name"], F.get("recording.artists", F.lit(0))["name"])
    return three.select(
        "path",
        F.struct("r", "c", "l").alias("pos"),
        "similarity",
        "result_id",
        F.col("recording.id").alias("recording_id"),
        first_filled("recording.title", default="Unknown").alias("recording_title"),
        F.col("release.id").alias("release_id"),
        first_filled("release.title", default="Unknown Album").alias("album_title"),
        first_filled(artist, default="Unknown Artist").alias("artist"),
        F.coalesce(F.col("release.date.year").cast("string"), F.lit("Unknown")).alias("date"),
        first_filled("release.country", default="XX").alias("country"),
        F.col("release.mediums").alias("mediums"),
    )


def answered(probes: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """The probes with their responses (key, status, results), where these hold results; a probe without a response has none."""
    return probes.join(responses, key).filter(is_answer(F.col("status"), F.col("results")))


#: A text search answers with so many recordings at most.
SEARCH_LIMIT = 5


def flatten_search(responses: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The same rows out of a text search (path, artist, recordings), of its first `limit` recordings.

    similarity is the service's score of 100 (0 without one), the year the date's first four characters, the artist the one that was searched for.
    Of the media the place alone is kept: the last medium's position, and the number of the recording's first track on the last medium that has it.
    """
    one = responses.select("path", "artist", F.posexplode(F.slice("recordings", 1, limit)).alias("c", "recording"))
    two = one.select("path", "artist", "c", "recording", F.posexplode("recording.release-list").alias("l", "release"))
    media = F.coalesce("release.medium-list", F.from_json(F.lit("[]"), SEARCH_MEDIA))
    disc = F.coalesce(F.try_element_at(media, F.lit(-1))["position"], F.lit("1"))
    found = F.transform(media, lambda m: F.get(F.filter(m["track-list"], lambda t: t["recording"]["id"] == F.col("recording.id")), F.lit(0)))
    hits = F.filter(found, lambda t: t.isNotNull())
    number = F.coalesce(F.when(F.size(hits) > 0, F.coalesce(F.try_element_at(hits, F.lit(-1))["number"], F.lit("1"))), F.lit("1"))
    return two.select(
        "path",
        F.struct(F.lit(0).alias("r"), "c", "l").alias("pos"),
        F.coalesce(F.col("recording.ext:score").try_cast("double") / 100.0, F.lit(0.0)).alias("similarity"),
        F.col("recording.id").alias("result_id"),
        F.col("recording.id").alias("recording_id"),
        first_filled("recording.title", default="Unknown").alias("recording_title"),
        F.col("release.id").alias("release_id"),
        first_filled("release.title", default="Unknown Album").alias("album_title"),
        "artist",
        F.coalesce(F.substring("release.date", 1, 4), F.lit("0000")).alias("date"),
        first_filled("release.country", default="XX").alias("country"),
        F.array(F.struct(disc.alias("position"), F.array(F.struct(number.alias("position"), F.col("recording.title").alias("title"), F.struct(F.col("recording.id").alias("id")).alias("recording"))).alias("tracks"))).alias("mediums"),
    )


def first_seen(candidates: DataFrame) -> DataFrame:
    """Each release of a path once, at its first place."""
    return keep_best(candidates, ["path", "release_id"], [F.asc("pos")])


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str = "path") -> DataFrame:
    """primary and the fallback's rows of those keys that primary doesn't have."""
    return primary.unionByName(fallback.join(primary.select(key).distinct(), key, "left_anti").select(*primary.columns))


def ranked(candidates: DataFrame, owned: DataFrame | None = None, home: str = "US") -> DataFrame:
    """Adds is_owned and rank_no (from 1): owned releases first, then similarity, home country, date as text (all descending), then place.

    owned: (result_id, release_id) pairs that are in the catalogue already.
    """
    if owned is None:
        flagged = candidates.withColumn("is_owned", F.lit(False))
    else:
        pairs = owned.select("result_id", "release_id").dropna().distinct().withColumn("is_owned", F.lit(True))
        flagged = candidates.join(pairs, ["result_id", "release_id"], "left").withColumn("is_owned", F.coalesce("is_owned", F.lit(False)))
    order = [F.desc("is_owned"), F.desc("similarity"), (F.col("country") == home).desc(), F.desc("date"), F.asc("pos")]
    return flagged.withColumn("rank_no", F.row_number().over(Window.partitionBy("path").orderBy(*order)))


def by_similarity(candidates: DataFrame) -> DataFrame:
    """Adds rank_no (from 1): by similarity alone, descending, then place."""
    return candidates.withColumn("rank_no", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("similarity"), F.asc("pos"))))


_TRACKS = "array<struct<position:string,title:string,recording:struct<id:string>>>"


def track_place(mediums: Column, recording_id: Column, title: Column, passes: int = 2) -> Column:
    """struct(track_no, disc_no) as text of a recording on a release: its first track by id, else by title in comparable form, else 1 and 1.

    All media are searched by id before any is searched by title; with one pass, the first track that has the id or the title is taken.
    """
    none = F.from_json(F.lit("[]"), _TRACKS)
    media = F.coalesce(mediums, F.from_json(F.lit("[]"), f"array<struct<position:string,tracks:{_TRACKS}>>"))
    tracks = F.flatten(F.transform(media, lambda m: F.transform(F.coalesce(m["tracks"], none), lambda t: F.struct(t["position"].alias("track_no"), m["position"].alias("disc_no"), t["title"].alias("title"), t["recording"]["id"].alias("id")))))
    same_id = lambda t: F.coalesce(t["id"] == recording_id, F.lit(False))
    same_title = lambda t: normal_title(t["title"]) == normal_title(title)
    first = lambda test: F.get(F.filter(tracks, test), F.lit(0))
    found = F.coalesce(first(same_id), first(same_title)) if passes == 2 else first(lambda t: same_id(t) | same_title(t))
    return F.struct(F.coalesce(found["track_no"], F.lit("1")).alias("track_no"), F.coalesce(found["disc_no"], F.lit("1")).alias("disc_no"))
