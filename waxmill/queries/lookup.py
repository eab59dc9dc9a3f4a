"""Queries of lookups and searches: nested responses, candidates, tracks on releases, tags and headers.

The test tables hold no responses of services, so these are built first: an order is a file that was looked up, its lines (a few per
order) are the results, and the SQL says what must come out of them without nesting anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waxmill.functions.ids import canonical_id, canonical_id_sql, clean_text, not_blank, strip_blanks_sql
from waxmill.functions.text import REPAIR_SUFFIXES, decision, is_audio, parse_flag, suffix
from waxmill.operators.blocks import block_index
from waxmill.operators.candidates import RECORDINGS, RESULTS, answered, by_similarity, first_seen, flatten_response, flatten_search, ranked, track_place
from waxmill.operators.catalog import add_blocks_of_new, stamped
from waxmill.operators.ranking import distributed_rank, every_nth, keep_best
from waxmill.plans.maintenance import repair_plan
from waxmill.plans.organise import empty_folders, tag_meta, tag_plan
from waxmill.queries.reference import _ALBUMS, _CURRENT, current, releases
from waxmill.sources.evidence import first_tag, with_quality
from waxmill.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL if there is one."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- responses -----------------------------------------------------------------------------------------------------

_IN_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_returnflag, l_linestatus, l_shipdate"
_LINES = f"""lines AS (SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_IN_ORDER}) - 1 AS r, l_linenumber, l_discount, l_quantity, l_returnflag, l_linestatus,
    CAST(l_partkey AS VARCHAR) AS recording_id, 'R' || (l_suppkey % 4) AS release_id, CASE WHEN l_suppkey % 3 = 0 THEN 'US' WHEN l_suppkey % 7 = 1 THEN NULL ELSE 'C' || (l_suppkey % 7) END AS country,
    CASE WHEN l_suppkey % 5 > 0 THEN year(l_shipdate) END AS year FROM lineitem)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """path (an order), lines: its few lines in order, as structs."""
    columns = [c.strip() for c in _IN_ORDER.split(",")]
    return read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("lines"))


def _release_id(line: Column) -> Column:
    return F.concat(F.lit("R"), (line["l_suppkey"] % 4).cast("string"))


def _country(line: Column) -> Column:
    return F.when(line["l_suppkey"] % 3 == 0, "US").when(line["l_suppkey"] % 7 == 1, F.lit(None)).otherwise(F.concat(F.lit("C"), (line["l_suppkey"] % 7).cast("string")))


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """path, status, results: a lookup's responses as JSON texts, read by their schema."""

    def result(line: Column) -> Column:
        year = F.when(line["l_suppkey"] % 5 > 0, F.year(line["l_shipdate"]))
        release = F.struct(_release_id(line).alias("id"), F.lit("").alias("title"), _country(line).alias("country"), F.struct(year.alias("year")).alias("date"))
        recording = F.struct(line["l_partkey"].cast("string").alias("id"), F.lit(None).cast("string").alias("title"), F.array(release).alias("releases"))
        return F.struct(line["l_partkey"].cast("string").alias("id"), line["l_discount"].alias("score"), F.array(recording).alias("recordings"))

    orders = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderstatus") == "P", "error").otherwise("ok").alias("status"))
    texts = _lines(spark, d).select("path", F.to_json(F.transform("lines", result)).alias("text"))
    return orders.join(texts, "path", "left").select("path", "status", F.from_json("text", RESULTS).alias("results"))


_CANDIDATES = f"""{_LINES},
  seen AS (SELECT lines.* FROM lines JOIN orders ON o_orderkey = path WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY path, release_id ORDER BY r) = 1),
  owned AS (SELECT DISTINCT recording_id, release_id, true AS is_owned FROM lines WHERE l_returnflag = 'R' AND path % 10 = 0)"""
_RANK = "ORDER BY coalesce(is_owned, false) DESC, l_discount DESC, coalesce(country, 'XX') = 'US' DESC, coalesce(CAST(year AS VARCHAR), 'Unknown') DESC, r"


@query(
    f"WITH {_CANDIDATES} SELECT path, release_id, recording_id, l_discount AS similarity, coalesce(country, 'XX') AS country, coalesce(CAST(year AS VARCHAR), 'Unknown') AS date, 'Unknown Album' AS album_title, 'Unknown Artist' AS artist, "
    f"coalesce(is_owned, false) AS is_owned, CAST(row_number() OVER (PARTITION BY path {_RANK}) AS INT) AS rank_no FROM seen LEFT JOIN owned USING (recording_id, release_id)"
)
def lookup_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate of every answered lookup, first seen, those of owned releases first."""
    files = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("path"))
    flat = first_seen(flatten_response(answered(files, _responses(spark, d), "path")))
    rows = read_table(spark, d, "lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 10 == 0))
    owned = rows.select(F.col("l_partkey").cast("string").alias("result_id"), F.concat(F.lit("R"), (F.col("l_suppkey") % 4).cast("string")).alias("release_id"))
    return ranked(flat, owned).select("path", "release_id", "recording_id", "similarity", "country", "date", "album_title", "artist", "is_owned", "rank_no")


@query(f"WITH {_CANDIDATES} SELECT path, release_id, l_discount AS similarity FROM seen WHERE l_discount >= 0.05 QUALIFY count(*) OVER (PARTITION BY path) = 1")
def lone_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The candidate of those lookups that have but one of at least a given similarity."""
    flat = first_seen(flatten_response(_responses(spark, d).filter("status = 'ok'"))).filter(F.col("similarity") >= 0.05)
    return flat.groupBy("path").agg(F.min("release_id").alias("release_id"), F.min("similarity").alias("similarity"), F.count("*").alias("n")).filter("n = 1").drop("n")


@query(f"WITH {_CANDIDATES}, e AS (SELECT path, release_id, r, l_discount AS similarity, lag(release_id) OVER (PARTITION BY path ORDER BY r) AS sticky FROM seen) SELECT path, release_id, similarity FROM e WHERE similarity >= 0.05 AND release_id < sticky")
def sticky_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of at least a given similarity whose release comes before the one seen before them."""
    from pyspark.sql import Window

    flat = first_seen(flatten_response(_responses(spark, d).filter("status = 'ok'")))
    before = F.lag("release_id").over(Window.partitionBy("path").orderBy("pos"))
    return flat.withColumn("sticky", before).filter((F.col("similarity") >= 0.05) & (F.col("release_id") < F.col("sticky"))).select("path", "release_id", "similarity")


# ---- searches ------------------------------------------------------------------------------------------------------


def _searches(spark: SparkSession, d: str) -> DataFrame:
    """path, artist, recordings: a text search's responses, likewise."""

    def recording(line: Column) -> Column:
        key = line["l_partkey"].cast("string")
        track = lambda number: F.struct(number.cast("string").alias("number"), F.struct(key.alias("id")).alias("recording"))
        other = F.struct(F.lit("99").alias("number"), F.struct(F.lit("other").alias("id")).alias("recording"))
        media = F.array(
            F.struct(F.lit("1").alias("position"), F.array(other, track(line["l_linenumber"]), track(F.lit(77))).alias("track-list")),
            F.struct(F.lit("2").alias("position"), F.when(line["l_quantity"].cast("int") % 2 == 0, F.array(track(line["l_quantity"].cast("int")))).otherwise(F.array(other)).alias("track-list")),
        )
        release = F.struct(_release_id(line).alias("id"), F.lit(None).cast("string").alias("title"), F.when(line["l_suppkey"] % 5 > 0, F.date_format(line["l_shipdate"], "yyyy-MM-dd")).alias("date"), _country(line).alias("country"), F.when(line["l_suppkey"] % 4 > 0, media).alias("medium-list"))
        score = F.when(line["l_linenumber"] % 4 > 0, line["l_quantity"].cast("int").cast("string"))
        return F.struct(key.alias("id"), F.lit("t").alias("title"), score.alias("ext:score"), F.array(release).alias("release-list"))

    texts = _lines(spark, d).select("path", F.to_json(F.transform("lines", recording)).alias("text"))
    return texts.select("path", F.concat(F.lit("artist "), (F.col("path") % 10).cast("string")).alias("artist"), F.from_json("text", RECORDINGS).alias("recordings"))


@query(
    f"WITH {_LINES}, five AS (SELECT *, CASE WHEN l_linenumber % 4 > 0 THEN CAST(l_quantity AS INT) / 100.0::DOUBLE ELSE 0.0 END AS similarity, release_id <> 'R0' AS has_media FROM lines WHERE r < 5) "
    "SELECT path, recording_id, release_id, similarity, 'artist ' || (path % 10) AS artist, coalesce(CAST(year AS VARCHAR), '0000') AS date, coalesce(country, 'XX') AS country, 'Unknown Album' AS album_title, "
    "CASE WHEN NOT has_media THEN '1' WHEN CAST(l_quantity AS INT) % 2 = 0 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) ELSE CAST(l_linenumber AS VARCHAR) END AS track_no, CASE WHEN has_media THEN '2' ELSE '1' END AS disc_no, "
    "CAST(row_number() OVER (PARTITION BY path ORDER BY similarity DESC, r) AS INT) AS rank_no FROM five"
)
def search_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of a text search's first five recordings by similarity, with the track on the last medium that has it."""
    flat = by_similarity(flatten_search(_searches(spark, d)))
    place = track_place(F.col("mediums"), F.col("recording_id"), F.lit(None).cast("string"))
    return flat.withColumn("place", place).select("path", "recording_id", "release_id", "similarity", "artist", "date", "country", "album_title", "place.track_no", "place.disc_no", "rank_no")


# ---- tracks on releases --------------------------------------------------------------------------------------------

_TRACKS = f"""{_LINES}, tracks AS (SELECT path, CAST(l_linenumber AS VARCHAR) AS track_no, CASE l_linestatus WHEN 'F' THEN '1' ELSE '2' END AS disc_no, l_linestatus, r, recording_id,
    'song ' || (l_linenumber % 3) AS title FROM lines), wanted AS (SELECT o_orderkey AS path, CASE WHEN o_custkey % 2 = 0 THEN (SELECT min(recording_id) FROM lines WHERE lines.path = o_orderkey) ELSE 'none' END AS recording_id, 'song ' || (o_custkey % 4) AS title FROM orders)"""


def _releases_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """path, mediums, recording_id, title: each order as a release of two media, and what is looked for on it."""

    def track(line: Column) -> Column:
        title = F.concat(F.when(line["l_linenumber"] % 2 == 0, F.lit("\tSong ")).otherwise(F.lit("SONG ")), (line["l_linenumber"] % 3).cast("string"), F.lit(" \n"))
        return F.struct(line["l_linenumber"].cast("string").alias("position"), title.alias("title"), F.struct(line["l_partkey"].cast("string").alias("id")).alias("recording"))

    medium = lambda no, kind: F.struct(F.lit(no).alias("position"), F.transform(F.filter("lines", lambda x: (x["l_linestatus"] == "F") == F.lit(kind)), track).alias("tracks"))
    media = _lines(spark, d).select("path", F.array(medium("1", True), medium("2", False)).alias("mediums"), F.array_min(F.transform("lines", lambda x: x["l_partkey"].cast("string"))).alias("least"))
    orders = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), "o_custkey")
    return orders.join(media, "path", "left").select("path", "mediums", F.when(F.col("o_custkey") % 2 == 0, F.col("least")).otherwise("none").alias("recording_id"), F.concat(F.lit("Song "), (F.col("o_custkey") % 4).cast("string")).alias("title"))


def _places(spark: SparkSession, d: str, passes: int) -> DataFrame:
    rows = _releases_of_orders(spark, d)
    return rows.select("path", track_place(F.col("mediums"), F.col("recording_id"), F.col("title"), passes).alias("place")).select("path", "place.track_no", "place.disc_no")


_HITS = "SELECT w.path, coalesce(arg_min(track_no, {0}), '1') AS track_no, coalesce(arg_min(disc_no, {0}), '1') AS disc_no FROM wanted w LEFT JOIN tracks t ON t.path = w.path AND (t.recording_id = w.recording_id OR t.title = w.title) GROUP BY w.path"


@query(f"WITH {_TRACKS} {_HITS.format('struct_pack(a := coalesce(t.recording_id <> w.recording_id, true), b := l_linestatus, c := r)')}")
def track_places(spark: SparkSession, d: str) -> DataFrame:
    """The place of a recording on a release: by its id on all media, else by its title."""
    return _places(spark, d, 2)


@query(f"WITH {_TRACKS} {_HITS.format('struct_pack(b := l_linestatus, c := r)')}")
def track_places_one_pass(spark: SparkSession, d: str) -> DataFrame:
    """The first track that has the id or the title."""
    return _places(spark, d, 1)


# ---- tags, headers, decisions --------------------------------------------------------------------------------------

_EXT = "lower(regexp_extract(list_last(string_split(path, '/')), '^.*[^.]([.][^.]*)$', 1))"
_WHOLE = f"CASE WHEN regexp_full_match({strip_blanks_sql('track_no')}, '[+-]?[0-9]+') THEN TRY_CAST({strip_blanks_sql('track_no')} AS INT) END"


@query(
    f"WITH {_CURRENT}, {_ALBUMS}, m AS (SELECT path, {_EXT} AS ext, coalesce(nullif(title, ''), 'Unknown') AS title, coalesce(nullif(album_title, ''), 'Unknown Album') AS album, coalesce(nullif(album_artist, ''), 'Unknown Artist') AS artist, "
    f"coalesce(track_no, '1') AS track_no, {_WHOLE.replace('track_no', 'coalesce(track_no, chr(49))')} AS whole FROM cur JOIN one ON album_id = release_id), "
    "t AS (SELECT *, unnest(['title', 'album', 'artist', 'album_artist', 'track_no', 'disc_no']) AS field FROM m), "
    "n AS (SELECT *, CASE ext WHEN '.mp3' THEN CASE field WHEN 'title' THEN 'TIT2' WHEN 'album' THEN 'TALB' WHEN 'artist' THEN 'TPE1' WHEN 'album_artist' THEN 'TPE2' WHEN 'track_no' THEN 'TRCK' ELSE 'TPOS' END "
    "WHEN '.wma' THEN CASE field WHEN 'title' THEN 'Title' WHEN 'album' THEN 'WM/AlbumTitle' WHEN 'artist' THEN 'Author' WHEN 'album_artist' THEN 'WM/AlbumArtist' WHEN 'track_no' THEN 'WM/TrackNumber' ELSE 'WM/PartOfSet' END "
    "WHEN '.m4a' THEN CASE field WHEN 'title' THEN chr(169) || 'nam' WHEN 'album' THEN chr(169) || 'alb' WHEN 'artist' THEN chr(169) || 'ART' WHEN 'album_artist' THEN 'aART' WHEN 'track_no' THEN 'trkn' ELSE 'disk' END "
    "ELSE CASE field WHEN 'title' THEN 'title' WHEN 'album' THEN 'album' WHEN 'artist' THEN 'artist' WHEN 'album_artist' THEN 'albumartist' WHEN 'track_no' THEN 'tracknumber' ELSE 'discnumber' END END AS tag "
    "FROM t WHERE ext IN ('.mp3', '.flac', '.wav', '.wma') OR (ext IN ('.m4a', '.mp4') AND whole IS NOT NULL)), "
    "x AS (SELECT path, CASE WHEN ext = '.mp4' THEN CASE field WHEN 'title' THEN chr(169) || 'nam' WHEN 'album' THEN chr(169) || 'alb' WHEN 'artist' THEN chr(169) || 'ART' WHEN 'album_artist' THEN 'aART' WHEN 'track_no' THEN 'trkn' ELSE 'disk' END ELSE tag END AS tag, "
    "CASE field WHEN 'title' THEN title WHEN 'album' THEN album WHEN 'artist' THEN artist WHEN 'album_artist' THEN artist WHEN 'track_no' THEN CASE WHEN ext IN ('.m4a', '.mp4') THEN whole || '/0' ELSE track_no END ELSE CASE WHEN ext IN ('.m4a', '.mp4') THEN '1/0' ELSE '1' END END AS value FROM n) "
    "SELECT path, tag, value FROM x"
)
def tag_plans(spark: SparkSession, d: str) -> DataFrame:
    """The tags to write for every file of a known release, one row each."""
    files = current(spark, d).join(releases(spark, d), F.col("album_id") == F.col("release_id"))
    place = F.struct(F.coalesce("track_no", F.lit("1")).alias("track_no"), F.lit("1").alias("disc_no"))
    meta = files.select("path", tag_meta(F.col("title"), F.col("album_title"), F.col("album_artist"), F.col("album_artist"), place, F.lit(None), F.col("release_id")).alias("m"))
    tags = tag_plan(suffix("path"), {f: F.col(f"m.{f}") for f in ("title", "album", "artist", "album_artist", "track_no", "disc_no")})
    return meta.select("path", F.explode(tags).alias("tag", "value"))


_BITS, _RATE, _BITRATE = "CASE batch_no % 3 WHEN 0 THEN NULL WHEN 1 THEN 16 ELSE 24 END", "CASE WHEN batch_no % 2 = 0 THEN 96000 END", "CASE WHEN batch_no % 4 > 0 THEN 320000 END"


@query(
    f"WITH {_CURRENT}, h AS (SELECT path, coalesce(file_size, 0) AS size, {_EXT} AS ext, {_BITS} AS bits, {_RATE} AS rate, {_BITRATE} AS bitrate, batch_no % 5 <> 4 AS readable FROM cur) "
    "SELECT path, CASE WHEN readable THEN CASE ext WHEN '.flac' THEN 3e15::DOUBLE WHEN '.m4a' THEN 2.5e15::DOUBLE WHEN '.wav' THEN 2e15::DOUBLE WHEN '.mp3' THEN 1e15::DOUBLE WHEN '.wma' THEN 5e14::DOUBLE ELSE 0.0::DOUBLE END "
    "+ coalesce(bits, 16)::DOUBLE * 1e12::DOUBLE + size::DOUBLE / 1000::DOUBLE + coalesce(rate, 44100)::DOUBLE / 1e6::DOUBLE + coalesce(bitrate, 0)::DOUBLE / 1e9::DOUBLE END AS score, "
    "CASE WHEN readable THEN ext END AS format, CASE WHEN readable THEN coalesce(bits, 16) END AS bits, CASE WHEN readable THEN coalesce(rate, 44100) END AS sample_rate FROM h"
)
def header_quality(spark: SparkSession, d: str) -> DataFrame:
    """The quality of every file by its header; files without one can't be read."""
    batch = F.col("batch_no")
    files = current(spark, d)
    bits = F.when(batch % 3 == 0, F.lit(None)).when(batch % 3 == 1, 16).otherwise(24)
    headers = files.filter(batch % 5 != 4).select("path", bits.cast("int").alias("bits"), F.when(batch % 2 == 0, 96000).alias("sample_rate"), F.when(batch % 4 > 0, 320000).alias("bitrate"))
    quality = with_quality(files.select("path", F.coalesce("file_size", F.lit(0)).alias("length")), headers)
    return quality.select("path", "quality.score", "quality.format", "quality.bits", "quality.sample_rate")


@query(f"WITH {_CURRENT} SELECT path, coalesce(title, '') AS title, coalesce(CASE WHEN title IS NOT NULL THEN acoustid_id END, '') AS artist FROM cur")
def first_tags(spark: SparkSession, d: str) -> DataFrame:
    """The first value of tags that have several, one or none."""
    tags = current(spark, d).select("path", F.when(F.col("title").isNotNull(), F.array("title", F.lit("second"))).otherwise(F.array().cast("array<string>")).alias("title"), F.when(F.col("title").isNotNull(), F.array("acoustid_id")).alias("artist"))
    return tags.select("path", first_tag(F.col("title")).alias("title"), first_tag(F.col("artist")).alias("artist"))


@query(
    "WITH e AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN ' TRUE' || chr(9) WHEN 1 THEN '1' WHEN 2 THEN 'Yes' || chr(10) WHEN 3 THEN 't' WHEN 4 THEN 'false' WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN event_type ELSE '0' END AS flag FROM events) "
    "SELECT event_id, CASE WHEN flag IS NULL THEN true ELSE event_id % 9 < 4 END AS by_true, CASE WHEN flag IS NULL THEN false ELSE event_id % 9 < 4 END AS by_false FROM e"
)
def flags_of_texts(spark: SparkSession, d: str) -> DataFrame:
    """Flags written in all usual ways, with either default."""
    n = F.col("event_id") % 9
    flag = F.when(n == 0, " TRUE\t").when(n == 1, "1").when(n == 2, "Yes\n").when(n == 3, "t").when(n == 4, "false").when(n == 5, "").when(n == 6, F.lit(None)).when(n == 7, F.col("event_type")).otherwise("0")
    return read_table(spark, d, "events").select("event_id", parse_flag(flag, True).alias("by_true"), parse_flag(flag, False).alias("by_false"))


@query(
    "WITH e AS (SELECT event_id, user_id % 12 AS a, event_id % 7 AS k FROM events) SELECT event_id, CASE WHEN k = 0 THEN 'skip' WHEN k = 1 THEN 'quit' WHEN k = 2 THEN NULL WHEN a BETWEEN 1 AND 9 THEN 'select' END AS action, "
    "CASE WHEN k > 2 AND a BETWEEN 1 AND 9 THEN a || ',' || 3 END AS picks FROM e"
)
def decisions(spark: SparkSession, d: str) -> DataFrame:
    """What answers say: skip, quit, a list of numbers, or nothing that counts."""
    n, a = F.col("event_id") % 7, (F.col("user_id") % 12).cast("string")
    answer = F.when(n == 0, "S ").when(n == 1, "\tq").when(n == 2, "x").otherwise(F.concat(F.lit(" "), a, F.lit(" ,\t3")))
    said = decision(answer, F.lit(9))
    return read_table(spark, d, "events").select("event_id", said["action"].alias("action"), F.array_join(said["picks"], ",").alias("picks"))


# ---- blocks, folders, batches --------------------------------------------------------------------------------------

_BLOCKS = "SELECT arrival_no, substr(fingerprint, i * 16 + 1, 16) AS block FROM known_fingerprints, range(16) t(i) WHERE i * 16 < length(fingerprint) AND arrival_no IS NOT NULL"


@query(
    f"WITH k AS (SELECT DISTINCT block, acoustid_id, pos FROM (SELECT nullif({strip_blanks_sql('block')}, '') AS block, {canonical_id_sql('acoustid_id')} AS acoustid_id, pos FROM known_blocks) WHERE block IS NOT NULL AND acoustid_id IS NOT NULL AND acoustid_id < '8'), "
    f"f AS (SELECT {canonical_id_sql('acoustid_id')} AS acoustid_id, max(fingerprint) AS fingerprint FROM known_fingerprints WHERE {canonical_id_sql('acoustid_id')} IS NOT NULL GROUP BY ALL) "
    "SELECT block, acoustid_id, pos FROM k UNION ALL SELECT substr(fingerprint, i * 16 + 1, 16), acoustid_id, CAST(i AS INT) FROM f, range(16) t(i) WHERE i * 16 < length(fingerprint) AND acoustid_id NOT IN (SELECT acoustid_id FROM k)"
)
def blocks_of_new(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of half the ids, and those of all ids that have none among them."""
    known = read_table(spark, d, "known_blocks").select(clean_text("block").alias("block"), canonical_id("acoustid_id").alias("acoustid_id"), "pos").filter("block is not null and acoustid_id < '8'").distinct()
    texts = read_table(spark, d, "known_fingerprints").select(canonical_id("acoustid_id").alias("acoustid_id"), "fingerprint").filter("acoustid_id is not null").groupBy("acoustid_id").agg(F.max("fingerprint").alias("fingerprint"))
    return add_blocks_of_new(known, texts, "acoustid_id")


@query(f"SELECT DISTINCT path FROM files WHERE {strip_blanks_sql('path')} <> '' AND {_EXT} IN ('.m4a', '.mp4', '.aac')")
def repair_files(spark: SparkSession, d: str) -> DataFrame:
    """The files that a repair looks at."""
    return read_table(spark, d, "files").filter(is_audio("path", REPAIR_SUFFIXES) & not_blank("path")).select("path").distinct()


@query(f"SELECT DISTINCT path, '/fixed/' || regexp_replace(list_last(string_split(path, '/')), '^(.*[^.])([.][^.]*)$', '\\1') || '.flac' AS dst FROM files WHERE {strip_blanks_sql('path')} <> '' AND {_EXT} IN ('.m4a', '.mp4', '.aac')")
def repair_plans(spark: SparkSession, d: str) -> DataFrame:
    """Where each of them is converted to."""
    return repair_plan(repair_files(spark, d), "/fixed").select("path", "dst")


@query(
    "WITH p AS (SELECT DISTINCT path FROM files WHERE path LIKE '%/%'), f AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM p), q AS (SELECT folder FROM f UNION SELECT folder || '/empty' FROM f) "
    "SELECT folder, CAST(len(string_split(folder, '/')) - 1 AS INT) AS depth FROM q WHERE folder LIKE '%/empty' AND folder NOT IN (SELECT folder FROM f) AND NOT EXISTS (SELECT 1 FROM p WHERE starts_with(p.path, q.folder || '/'))"
)
def folders_without_files(spark: SparkSession, d: str) -> DataFrame:
    """The folders that hold no file at any depth: an empty one beside the files of each folder."""
    files = read_table(spark, d, "files").filter(F.col("path").contains("/")).select("path").distinct()
    folders = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct()
    return empty_folders(folders.union(folders.select(F.concat("folder", F.lit("/empty")))), files).filter(F.col("folder").endswith("/empty"))


@query(
    "WITH a AS (SELECT path, max(title) AS title FROM files WHERE batch_no = 0 AND path IS NOT NULL GROUP BY ALL), b AS (SELECT path, max(title) AS title FROM files WHERE path IS NOT NULL GROUP BY ALL) "
    "SELECT path, b.title, CASE WHEN a.path IS NOT NULL AND a.title IS NOT DISTINCT FROM b.title THEN 'before' ELSE 'now' END AS stamp FROM b LEFT JOIN a USING (path)"
)
def write_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are new or have changed since batch 0 bear the time of writing, here a word."""
    titles = lambda rows: rows.filter("path is not null").groupBy("path").agg(F.max("title").alias("title")).withColumn("stamp", F.lit("before"))
    files = read_table(spark, d, "files")
    return stamped(titles(files.filter("batch_no = 0")), titles(files), ["path"], "stamp", F.lit("now"))


@query("SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 50 AS batch_no FROM events")
def fifty_at_a_time(spark: SparkSession, d: str) -> DataFrame:
    """Every event with the number of its batch of fifty."""
    return every_nth(read_table(spark, d, "events").select("event_id", "ts"), [F.asc("ts"), F.asc("event_id")], 50).select("event_id", "batch_no")


@query(
    f"WITH {_CURRENT}, a AS (SELECT DISTINCT acoustid_id, album_id FROM cur WHERE processed AND acoustid_id IS NOT NULL AND album_id IS NOT NULL), r AS (SELECT *, (row_number() OVER (PARTITION BY acoustid_id ORDER BY album_id) - 1) // 100 AS slice_no FROM a) "
    "SELECT acoustid_id, slice_no, count(*) AS n_albums, string_agg(album_id, ',' ORDER BY album_id) AS albums FROM r GROUP BY ALL"
)
def owned_slices(spark: SparkSession, d: str) -> DataFrame:
    """All albums of every recording, in slices of a hundred however many there are."""
    pairs = current(spark, d).filter("processed").select("acoustid_id", "album_id").dropna().distinct()
    placed = distributed_rank(pairs, ["acoustid_id"], [F.asc("album_id")]).withColumn("slice_no", F.floor((F.col("rank_no") - 1) / 100).cast("bigint"))
    return placed.groupBy("acoustid_id", "slice_no").agg(F.count("*").alias("n_albums"), F.array_join(F.array_sort(F.collect_list("album_id")), ",").alias("albums"))


@query(f"WITH b AS ({_BLOCKS}) SELECT arrival_no, count(DISTINCT block) AS blocks, min(block) AS least FROM b GROUP BY ALL")
def blocks_of_texts(spark: SparkSession, d: str) -> DataFrame:
    """How many different blocks each text has, and the least."""
    texts = keep_best(read_table(spark, d, "known_fingerprints").select("arrival_no", "fingerprint").dropna().distinct(), ["arrival_no", "fingerprint"], [F.asc("arrival_no")])
    pairs = block_index(texts, "arrival_no").select("arrival_no", "block").distinct()
    return pairs.groupBy("arrival_no").agg(F.count("*").alias("blocks"), F.min("block").alias("least"))
