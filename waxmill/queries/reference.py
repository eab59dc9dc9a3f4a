"""Queries of the catalogue's own operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waxmill.functions.ids import canonical_id, canonical_id_sql, clean_text, not_blank, strip_blanks, strip_blanks_sql, valid_path
from waxmill.functions.quality import quality_score
from waxmill.functions.similarity import matching_ratio
from waxmill.functions.text import base_name, folder, is_audio, normal_title, parse_flag, sanitise, selected_numbers, suffix, table_row, track_label, zfill
from waxmill.operators.blocks import best_match, block_candidates, block_index
from waxmill.operators.candidates import with_fallback
from waxmill.operators.catalog import delete_keys, insert_or_ignore, prune, reindex, repoint, upsert
from waxmill.operators.ranking import best_value, carry_forward, distributed_rank, is_last, keep_best, losers, number_collisions, paginate, rate_slots
from waxmill.plans.maintenance import ghosts, missing_hashes, repair_status
from waxmill.plans.organise import file_actions, target_path
from waxmill.plans.views import album_tracks
from waxmill.session import default_partitions
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


_PATH = f"CASE WHEN {strip_blanks_sql('path')} <> '' THEN path END"
_CURRENT = f"""cur AS (SELECT {_PATH} AS path, {canonical_id_sql("acoustid_id")} AS acoustid_id, {canonical_id_sql("album_id")} AS album_id, title, track_no, track_no_int,
    format, file_size, CASE WHEN isnan(quality_score) THEN NULL ELSE quality_score END AS score, processed, date_modified, batch_no
  FROM (SELECT DISTINCT * FROM files) WHERE {strip_blanks_sql("path")} <> ''
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY date_modified DESC NULLS LAST, batch_no DESC) = 1)"""
_ALBUMS = f"""one AS (SELECT {canonical_id_sql("release_id")} AS release_id, album_title, album_artist, release_date, country, batch_no FROM albums
  WHERE {canonical_id_sql("release_id")} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {canonical_id_sql("release_id")} ORDER BY batch_no, album_title NULLS FIRST, album_artist NULLS FIRST, release_date NULLS FIRST, country NULLS FIRST) = 1)"""


def current(spark: SparkSession, d: str) -> DataFrame:
    """The current row of every path, ids canonical, scores that aren't numbers null."""
    files = read_table(spark, d, "files").withColumns({"path": valid_path("path"), "acoustid_id": canonical_id("acoustid_id"), "album_id": canonical_id("album_id"), "score": F.when(~F.isnan("quality_score"), F.col("quality_score"))})
    latest = keep_best(files.filter(F.col("path").isNotNull()), ["path"], [F.col("date_modified").desc_nulls_last(), F.desc("batch_no")])
    return latest.select("path", "acoustid_id", "album_id", "title", "track_no", "track_no_int", "format", "file_size", "score", "processed", "date_modified", "batch_no")


def releases(spark: SparkSession, d: str) -> DataFrame:
    """Each release once, as it was first entered."""
    rows = read_table(spark, d, "albums").withColumn("release_id", canonical_id("release_id")).filter(F.col("release_id").isNotNull())
    return keep_best(rows, ["release_id"], [F.asc("batch_no"), *(F.col(c).asc_nulls_first() for c in ("album_title", "album_artist", "release_date", "country"))])


# ---- views, scans, predicates -------------------------------------------------------------------------------------


@query(f"WITH {_CURRENT}, {_ALBUMS} SELECT album_artist, album_title, right('00' || track_no, 2) || ' ' || title AS title, score AS quality_score, path FROM cur JOIN one ON album_id = release_id")
def album_tracks_view(spark: SparkSession, d: str) -> DataFrame:
    return album_tracks(current(spark, d).withColumnRenamed("score", "quality_score"), releases(spark, d))


@query(f"WITH {_CURRENT}, {_ALBUMS} SELECT path, album_title FROM cur JOIN one ON album_id = release_id WHERE lower(album_artist) LIKE lower('%VARIOUS%') ORDER BY album_title, path")
def artist_browse(spark: SparkSession, d: str) -> DataFrame:
    tracks = current(spark, d).join(releases(spark, d), F.col("album_id") == F.col("release_id"))
    return tracks.filter(F.lower("album_artist").like("%various%")).select("path", "album_title").orderBy("album_title", "path")


@query(f"SELECT DISTINCT path FROM files WHERE regexp_matches(lower(path), '[^/][.](mp3|flac|m4a|mp4|wma|wav)$') AND {strip_blanks_sql('path')} <> ''")
def scan_filter_ext(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "files").filter(is_audio("path") & not_blank("path")).select("path").distinct()


@query("SELECT DISTINCT path, list_last(string_split(path, '/')) AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, lower(regexp_extract(list_last(string_split(path, '/')), '^.*[^.]([.][^.]*)$', 1)) AS suffix FROM files WHERE path IS NOT NULL")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "files").filter(F.col("path").isNotNull()).select("path").distinct().select("path", base_name("path").alias("name"), folder("path").alias("folder"), suffix("path").alias("suffix"))


@query("SELECT DISTINCT path, title FROM files WHERE title ILIKE '%harbour%'")
def like_ci(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "files").filter(F.col("title").ilike("%harbour%")).select("path", "title").distinct()


@query("SELECT path, file_size, format FROM files WHERE format IN ('.flac', '.wav') AND processed AND file_size > 30000000")
def in_list_equality(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "files").filter(F.col("format").isin(".flac", ".wav") & F.col("processed") & (F.col("file_size") > 30000000)).select("path", "file_size", "format")


@query("SELECT count(*) FILTER (title IS NULL) AS no_title, count(*) FILTER (fingerprint IS NULL OR fingerprint = '') AS no_fingerprint, count(*) FILTER (album_id IS NOT NULL) AS with_album FROM files")
def null_guards(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "files").agg(F.count_if(F.col("title").isNull()).alias("no_title"), F.count_if(F.coalesce(F.length("fingerprint"), F.lit(0)) == 0).alias("no_fingerprint"), F.count_if(F.col("album_id").isNotNull()).alias("with_album"))


@query("SELECT path, album_id, track_no, title FROM files ORDER BY path, album_id, track_no, title, batch_no")
def order_by_unprojected(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "files").orderBy("path", "album_id", "track_no", "title", "batch_no").select("path", "album_id", "track_no", "title")


@query(f"SELECT lower({strip_blanks_sql('format')}) AS flag, CASE WHEN format IS NULL THEN true ELSE lower({strip_blanks_sql('format')}) IN ('true', '1', 'yes', 't') END AS parsed, count(*) AS n FROM files GROUP BY ALL")
def parse_flags(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "files").groupBy(F.lower(strip_blanks("format")).alias("flag"), parse_flag("format", True).alias("parsed")).agg(F.count("*").alias("n"))


# ---- joins ---------------------------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT path FROM files WHERE {strip_blanks_sql('path')} <> '' AND path NOT IN (SELECT path FROM files WHERE processed AND path IS NOT NULL)")
def pending_anti_join(spark: SparkSession, d: str) -> DataFrame:
    files = read_table(spark, d, "files").filter(not_blank("path"))
    return files.select("path").distinct().join(files.filter("processed").select("path"), "path", "left_anti")


@query(f"SELECT DISTINCT f.path FROM files f LEFT JOIN audio_hashes h ON f.path = h.path WHERE f.processed AND h.path IS NULL AND {strip_blanks_sql('f.path')} <> ''")
def missing_hash_rows(spark: SparkSession, d: str) -> DataFrame:
    files = read_table(spark, d, "files").filter(F.col("processed") & not_blank("path")).select("path").distinct()
    return missing_hashes(files, read_table(spark, d, "audio_hashes"))


@query(
    "SELECT DISTINCT 'fingerprint_index' AS table_name, path FROM fingerprint_index WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM files WHERE path IS NOT NULL) "
    "UNION ALL SELECT DISTINCT 'audio_hashes', path FROM audio_hashes WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM files WHERE path IS NOT NULL)"
)
def prune_set_difference(spark: SparkSession, d: str) -> DataFrame:
    return ghosts({"fingerprint_index": read_table(spark, d, "fingerprint_index"), "audio_hashes": read_table(spark, d, "audio_hashes")}, read_table(spark, d, "files"))


@query("WITH there AS (SELECT DISTINCT path FROM files WHERE processed AND path IS NOT NULL) SELECT 'fingerprint_index' AS table_name, count(*) AS n FROM fingerprint_index WHERE path IN (FROM there) UNION ALL SELECT 'audio_hashes', count(*) FROM audio_hashes WHERE path IN (FROM there)")
def cascade_prune(spark: SparkSession, d: str) -> DataFrame:
    kept = prune({n: (read_table(spark, d, n), "path") for n in ("fingerprint_index", "audio_hashes")}, read_table(spark, d, "files").filter("processed and path is not null"))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, df in kept.items()]
    return parts[0].unionByName(parts[1])


@query(f"WITH {_CURRENT} SELECT path, acoustid_id FROM cur WHERE acoustid_id IN (SELECT {canonical_id_sql('acoustid_id')} FROM known_fingerprints)")
def semi_join_known(spark: SparkSession, d: str) -> DataFrame:
    known = read_table(spark, d, "known_fingerprints").select(canonical_id("acoustid_id").alias("acoustid_id")).filter(F.col("acoustid_id").isNotNull())
    return current(spark, d).join(known, "acoustid_id", "left_semi").select("path", "acoustid_id")


@query(f"WITH {_CURRENT} SELECT DISTINCT h.audio_hash, h.recipe, h.path, coalesce(score, 0.0) AS score FROM audio_hashes h LEFT JOIN cur USING (path)")
def left_join_default_score(spark: SparkSession, d: str) -> DataFrame:
    hashes = read_table(spark, d, "audio_hashes").select("audio_hash", "recipe", "path")
    return hashes.join(current(spark, d).select("path", "score"), "path", "left").select("audio_hash", "recipe", "path", F.coalesce("score", F.lit(0.0)).alias("score")).distinct()


@query(f"WITH ids AS (SELECT DISTINCT {canonical_id_sql('acoustid_id')} AS acoustid_id FROM known_fingerprints), b AS (SELECT DISTINCT {canonical_id_sql('acoustid_id')} AS acoustid_id FROM known_blocks) SELECT acoustid_id, b.acoustid_id IS NOT NULL AS has_blocks FROM ids LEFT JOIN b USING (acoustid_id) WHERE acoustid_id IS NOT NULL")
def exists_flag(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda t: read_table(spark, d, t).select(canonical_id("acoustid_id").alias("acoustid_id")).dropna().distinct()
    return ids("known_fingerprints").join(ids("known_blocks").withColumn("has_blocks", F.lit(True)), "acoustid_id", "left").select("acoustid_id", F.coalesce("has_blocks", F.lit(False)).alias("has_blocks"))


@query(f"WITH {_CURRENT}, {_ALBUMS} SELECT DISTINCT acoustid_id, album_title, album_artist FROM cur JOIN one ON album_id = release_id WHERE processed AND acoustid_id IS NOT NULL")
def albums_of_recording(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d).filter("processed and acoustid_id is not null").join(releases(spark, d), F.col("album_id") == F.col("release_id")).select("acoustid_id", "album_title", "album_artist").distinct()


@query(
    f"WITH {_CURRENT}, h AS (SELECT DISTINCT recipe, lower({strip_blanks_sql('audio_hash')}) AS hash, path FROM audio_hashes WHERE {strip_blanks_sql('audio_hash')} <> ''), "
    "known AS (SELECT recipe, hash, max(score) AS known_score FROM h JOIN cur USING (path) WHERE batch_no = 0 GROUP BY ALL) "
    "SELECT h.path, h.recipe, h.hash, known_score, score > coalesce(known_score, 0.0) AS better FROM h JOIN cur USING (path) JOIN known USING (recipe, hash) WHERE batch_no > 0 AND score IS NOT NULL"
)
def hash_lookup_join(spark: SparkSession, d: str) -> DataFrame:
    """New files against the best history file of the same hash."""
    hashes = read_table(spark, d, "audio_hashes").select("recipe", F.lower(clean_text("audio_hash")).alias("hash"), "path").dropna().distinct()
    placed = hashes.join(current(spark, d).select("path", "score", "batch_no"), "path")
    known = placed.filter("batch_no = 0").groupBy("recipe", "hash").agg(F.max("score").alias("known_score"))
    new = placed.filter("batch_no > 0 and score is not null").join(known, ["recipe", "hash"])
    return new.select("path", "recipe", "hash", "known_score", (F.col("score") > F.coalesce("known_score", F.lit(0.0))).alias("better"))


# ---- groups and best rows ------------------------------------------------------------------------------------------


@query(f"WITH {_CURRENT} SELECT acoustid_id, count(DISTINCT album_id) AS n_albums, string_agg(DISTINCT album_id, ',' ORDER BY album_id) AS albums FROM cur WHERE processed AND acoustid_id IS NOT NULL AND album_id IS NOT NULL GROUP BY ALL")
def owned_sets(spark: SparkSession, d: str) -> DataFrame:
    pairs = current(spark, d).filter("processed").select("acoustid_id", "album_id").dropna().distinct()
    return pairs.groupBy("acoustid_id").agg(F.count("*").alias("n_albums"), F.array_join(F.array_sort(F.collect_list("album_id")), ",").alias("albums"))


@query(f"WITH {_CURRENT}, r AS (SELECT acoustid_id, path, row_number() OVER (PARTITION BY acoustid_id ORDER BY score DESC NULLS LAST, path) AS k FROM cur WHERE acoustid_id IS NOT NULL) SELECT acoustid_id, string_agg(path, chr(10) ORDER BY k) AS best_paths FROM r WHERE k <= 5 GROUP BY ALL")
def group_records(spark: SparkSession, d: str) -> DataFrame:
    """The five best files of every recording as one record."""
    ordered = Window.partitionBy("acoustid_id").orderBy(F.col("score").desc_nulls_last(), "path")
    five = current(spark, d).filter("acoustid_id is not null").withColumn("k", F.row_number().over(ordered)).filter("k <= 5")
    listed = five.groupBy("acoustid_id").agg(F.array_sort(F.collect_list(F.struct("k", "path"))).alias("r"))
    return listed.select("acoustid_id", F.array_join(F.transform("r", lambda x: x["path"]), "\n").alias("best_paths"))


#: Records in one slice of a group.
SLICE = 100


@query(f"WITH {_CURRENT}, r AS (SELECT acoustid_id, path, row_number() OVER (PARTITION BY acoustid_id ORDER BY score DESC NULLS LAST, path) - 1 AS k FROM cur WHERE acoustid_id IS NOT NULL) SELECT acoustid_id, k // 100 AS slice_no, string_agg(path, chr(10) ORDER BY k) AS paths FROM r GROUP BY ALL")
def group_all_records(spark: SparkSession, d: str) -> DataFrame:
    """All files of every recording, best first, in slices of SLICE; group_records is the top five of them."""
    ranked = distributed_rank(current(spark, d).filter("acoustid_id is not null").select("acoustid_id", "path", "score"), ["acoustid_id"], _best())
    sliced = ranked.withColumn("slice_no", F.floor((F.col("rank_no") - 1) / SLICE).cast("bigint"))
    listed = sliced.groupBy("acoustid_id", "slice_no").agg(F.array_sort(F.collect_list(F.struct("rank_no", "path"))).alias("r"))
    return listed.select("acoustid_id", "slice_no", F.array_join(F.transform("r", lambda x: x["path"]), "\n").alias("paths"))


@query(f"SELECT recipe, lower({strip_blanks_sql('audio_hash')}) AS hash, count(DISTINCT path) AS members, min(path) AS first_path FROM audio_hashes WHERE {strip_blanks_sql('audio_hash')} <> '' AND {strip_blanks_sql('path')} <> '' GROUP BY ALL HAVING count(DISTINCT path) > 1")
def exact_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "audio_hashes").select("recipe", F.lower(clean_text("audio_hash")).alias("hash"), valid_path("path").alias("path")).filter("hash is not null and path is not null").distinct()
    return rows.groupBy("recipe", "hash").agg(F.count("*").alias("members"), F.min("path").alias("first_path")).filter("members > 1")


@query("SELECT md5(text) AS digest, count(*) AS members, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def text_digests(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").filter("text is not null").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("members"), F.min("doc_id").alias("first_id"))


_BEST = "ORDER BY score DESC NULLS LAST, path"


def _best() -> list:
    return [F.col("score").desc_nulls_last(), F.asc("path")]


@query(f"WITH {_CURRENT} SELECT acoustid_id, album_id, path, score FROM cur WHERE acoustid_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY acoustid_id, album_id {_BEST}) = 1")
def keep_best_in_album(spark: SparkSession, d: str) -> DataFrame:
    return keep_best(current(spark, d).filter("acoustid_id is not null"), ["acoustid_id", "album_id"], _best()).select("acoustid_id", "album_id", "path", "score")


@query(f"WITH {_CURRENT} SELECT acoustid_id, max(score) AS score FROM cur WHERE acoustid_id IS NOT NULL GROUP BY ALL")
def keep_best_overall(spark: SparkSession, d: str) -> DataFrame:
    return best_value(current(spark, d).filter("acoustid_id is not null"), ["acoustid_id"], F.col("score"), "score")


@query(f"WITH {_CURRENT}, r AS (SELECT *, first(path) OVER (PARTITION BY acoustid_id {_BEST}) AS winner FROM cur WHERE acoustid_id IS NOT NULL) SELECT acoustid_id, path, winner FROM r WHERE path <> winner")
def dedup_losers(spark: SparkSession, d: str) -> DataFrame:
    return losers(current(spark, d).filter("acoustid_id is not null"), ["acoustid_id"], "path", _best()).select("acoustid_id", "path", "winner")


@query(f"WITH {_CURRENT} SELECT coalesce(format, 'none') AS status, processed, count(*) AS n FROM cur GROUP BY ALL")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d).groupBy(F.coalesce("format", F.lit("none")).alias("status"), "processed").agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT DISTINCT path, file_size, lower(regexp_extract(list_last(string_split(path, '/')), '^.*[^.]([.][^.]*)$', 1)) AS ext FROM files WHERE path IS NOT NULL) SELECT path, file_size, CASE ext WHEN '.flac' THEN 3e15 WHEN '.m4a' THEN 2.5e15 WHEN '.wav' THEN 2e15 WHEN '.mp3' THEN 1e15 WHEN '.wma' THEN 5e14 ELSE 0.0::DOUBLE END::DOUBLE + 16::DOUBLE * 1e12::DOUBLE + coalesce(file_size, 0)::DOUBLE / 1000::DOUBLE + 44100::DOUBLE / 1e6::DOUBLE + 0::DOUBLE AS score FROM f")
def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("int")
    return read_table(spark, d, "files").filter("path is not null").select("path", "file_size").distinct().select("path", "file_size", quality_score(suffix("path"), none, F.col("file_size"), none, none).alias("score"))


@query(f"WITH {_CURRENT} SELECT album_id, path, row_number() OVER (PARTITION BY album_id {_BEST}) AS rank_no FROM cur WHERE album_id IS NOT NULL")
def quality_rank(spark: SparkSession, d: str) -> DataFrame:
    """The place of every file in its release, the very large ones included."""
    return distributed_rank(current(spark, d).filter("album_id is not null").select("album_id", "path", "score"), ["album_id"], _best()).select("album_id", "path", F.col("rank_no").cast("bigint").alias("rank_no"))


@query(f"WITH {_ALBUMS} SELECT album_artist, release_id, batch_no FROM one QUALIFY row_number() OVER (PARTITION BY album_artist ORDER BY batch_no, release_id) = 1")
def first_seen_release(spark: SparkSession, d: str) -> DataFrame:
    return keep_best(releases(spark, d), ["album_artist"], [F.asc("batch_no"), F.asc("release_id")]).select("album_artist", "release_id", "batch_no")


@query(f"WITH {_ALBUMS}, r AS (SELECT *, row_number() OVER (PARTITION BY album_artist ORDER BY coalesce(country = 'US', false) DESC, release_date DESC NULLS LAST, release_id) AS rank_no FROM one) SELECT album_artist, release_id, rank_no FROM r WHERE rank_no <= 5")
def candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    """Five releases per artist: home country first, then the date as text, descending."""
    order = [F.coalesce(F.col("country") == "US", F.lit(False)).desc(), F.col("release_date").desc_nulls_last(), F.asc("release_id")]
    place = Window.partitionBy("album_artist").orderBy(*order)
    return releases(spark, d).withColumn("rank_no", F.row_number().over(place).cast("bigint")).filter("rank_no <= 5").select("album_artist", "release_id", "rank_no")


@query(f"WITH {_ALBUMS} SELECT album_artist, release_id, row_number() OVER (PARTITION BY album_artist ORDER BY coalesce(country = 'US', false) DESC, release_date DESC NULLS LAST, release_id) AS rank_no FROM one")
def candidate_rank_all(spark: SparkSession, d: str) -> DataFrame:
    """The place of every release of an artist, in the order of candidate_rank, which is the top five of it."""
    rows = releases(spark, d).select("album_artist", "release_id", "release_date", F.coalesce(F.col("country") == "US", F.lit(False)).alias("home"))
    order = [F.desc("home"), F.col("release_date").desc_nulls_last(), F.asc("release_id")]
    return distributed_rank(rows, ["album_artist"], order).select("album_artist", "release_id", F.col("rank_no").cast("bigint").alias("rank_no"))


@query(f"WITH {_CURRENT} SELECT acoustid_id, min(path) AS path FROM cur WHERE acoustid_id IS NOT NULL AND score >= 1e15 GROUP BY acoustid_id HAVING count(*) = 1")
def single_candidate(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d).filter("acoustid_id is not null and score >= 1e15").groupBy("acoustid_id").agg(F.min("path").alias("path"), F.count("*").alias("n")).filter("n = 1").drop("n")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def top1_per_group(spark: SparkSession, d: str) -> DataFrame:
    return keep_best(read_table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


# ---- blocks --------------------------------------------------------------------------------------------------------

_BLOCKS = f"SELECT DISTINCT {canonical_id_sql('acoustid_id')} AS acoustid_id, i AS pos, substr(fingerprint, i * 16 + 1, 16) AS block FROM known_fingerprints, range(16) t(i) WHERE i * 16 < length(fingerprint)"


@query(f"SELECT acoustid_id, CAST(pos AS INT) AS pos, block FROM ({_BLOCKS}) WHERE acoustid_id IS NOT NULL")
def block_rows(spark: SparkSession, d: str) -> DataFrame:
    texts = read_table(spark, d, "known_fingerprints").select(canonical_id("acoustid_id").alias("acoustid_id"), "fingerprint").filter("acoustid_id is not null")
    return block_index(texts, "acoustid_id").distinct().select("acoustid_id", "pos", "block")


@query(
    f"WITH f AS (SELECT path, max(fingerprint) AS fingerprint FROM files WHERE batch_no = 11 AND {strip_blanks_sql('path')} <> '' GROUP BY ALL), old AS (SELECT DISTINCT block, path, pos FROM fingerprint_index) "
    "SELECT block, path, pos FROM old WHERE path IS NULL OR path NOT IN (SELECT path FROM f) UNION ALL SELECT substr(fingerprint, i * 16 + 1, 16), path, CAST(i AS INT) FROM f, range(16) t(i) WHERE i * 16 < length(fingerprint)"
)
def block_reindex(spark: SparkSession, d: str) -> DataFrame:
    """The index with the blocks of the last batch's files replaced."""
    fresh = read_table(spark, d, "files").filter((F.col("batch_no") == 11) & not_blank("path")).groupBy("path").agg(F.max("fingerprint").alias("fingerprint"))
    return reindex(read_table(spark, d, "fingerprint_index").select("block", "path", "pos").distinct(), fresh, "path")


@query(f"SELECT DISTINCT path FROM fingerprint_index WHERE {strip_blanks_sql('block')} IN (SELECT {strip_blanks_sql('block')} FROM known_blocks WHERE pos = 0 AND {strip_blanks_sql('block')} <> '') AND path IS NOT NULL")
def block_in_list(spark: SparkSession, d: str) -> DataFrame:
    starts = read_table(spark, d, "known_blocks").filter("pos = 0").select(clean_text("block").alias("block")).dropna().distinct()
    return read_table(spark, d, "fingerprint_index").select(clean_text("block").alias("block"), "path").dropna().join(starts, "block", "left_semi").select("path").distinct()


def _known_texts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "known_fingerprints").select("arrival_no", "fingerprint").filter(not_blank("fingerprint")).dropna().distinct()


@query(
    f"WITH t AS (SELECT DISTINCT arrival_no, fingerprint FROM known_fingerprints WHERE {strip_blanks_sql('fingerprint')} <> '' AND arrival_no IS NOT NULL), "
    "b AS (SELECT DISTINCT arrival_no, substr(fingerprint, i * 16 + 1, 16) AS block FROM t, range(16) r(i) WHERE i * 16 < length(fingerprint)) "
    "SELECT p.arrival_no AS probe, k.arrival_no, count(*) AS shared FROM b p JOIN b k USING (block) WHERE p.arrival_no % 100 = 0 AND p.arrival_no <> k.arrival_no GROUP BY ALL HAVING count(*) >= 4"
)
def block_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Texts that share at least four blocks with those whose number is divisible by 100."""
    index = block_index(_known_texts(spark, d), "arrival_no")
    probes = index.filter(F.col("arrival_no") % 100 == 0).select(F.col("arrival_no").alias("probe"), "block")
    return block_candidates(probes, index, "probe", "arrival_no", 4).filter("probe <> arrival_no")


@query()
def similarity_best_match(spark: SparkSession, d: str) -> DataFrame:
    """The most similar text, of those that share a block, of each text whose number is divisible by 100."""
    return most_similar(_known_texts(spark, d), F.col("arrival_no") % 100 == 0)


def most_similar(texts: DataFrame, is_probe: Column) -> DataFrame:
    """probe, arrival_no, ratio: for each of the texts (arrival_no, fingerprint) that is_probe, the most similar other one that shares a block.

    Equal texts are one class, named by its smallest number, and rated once: a probe's best is the best of the other classes or a copy of its own.
    """
    two = texts.withColumn("__k", F.row_number().over(Window.partitionBy("fingerprint").orderBy("arrival_no"))).filter("__k <= 2")
    classes = two.groupBy("fingerprint").agg(F.min("arrival_no").alias("arrival_no"), F.max(F.when(F.col("__k") == 2, F.col("arrival_no"))).alias("second"))
    probes = texts.filter(is_probe).withColumnRenamed("arrival_no", "probe").join(classes, "fingerprint").select("probe", F.col("arrival_no").alias("own"), "second", "fingerprint")
    wanted = probes.select("own", "second", F.col("fingerprint").alias("wanted")).distinct()
    pairs = block_candidates(block_index(wanted, "own", "wanted"), block_index(classes, "arrival_no"), "own", "arrival_no", 1).filter("own <> arrival_no")
    # numbers alone are shuffled, and a text's pairs meet, for which the matcher then prepares it once
    placed = pairs.repartition(default_partitions(texts.sparkSession), "arrival_no")
    rated = placed.join(wanted, "own").join(classes.select("arrival_no", "fingerprint"), "arrival_no")
    others = best_match(rated, "own", "arrival_no", F.col("wanted"), F.col("fingerprint"))
    copies = wanted.filter("second is not null").select("own", "second", matching_ratio(F.col("wanted"), F.col("wanted")).alias("ratio"))
    own = probes.select("probe", "own")
    found = own.join(others, "own").select("probe", "arrival_no", "ratio").unionByName(own.join(copies, "own").select("probe", F.when(F.col("probe") == F.col("own"), F.col("second")).otherwise(F.col("own")).alias("arrival_no"), "ratio"))
    return keep_best(found, ["probe"], [F.desc("ratio"), F.asc("arrival_no")])


# ---- names, tracks, targets ----------------------------------------------------------------------------------------

_SANE = "trim(regexp_replace(translate(coalesce(nullif({0}, ''), 'Unknown'), '/\\', '--'), '[^\\p{{L}}\\p{{N}} _.\\-]', '', 'g'), ' ')"


def _sane(c: str) -> str:
    x = _SANE.format(c)
    return f"CASE WHEN {x} IN ('', '.', '..') THEN 'Unknown' ELSE {x} END"


@query(f"SELECT DISTINCT title, {_sane('title')} AS clean FROM files")
def sanitise_names(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "files").select("title").distinct().select("title", sanitise("title").alias("clean"))


@query("SELECT DISTINCT track_no, CASE WHEN length(track_no) >= 2 THEN track_no ELSE lpad(track_no, 2, '0') END AS padded, right('00' || track_no, 2) || ' x' AS label, TRY_CAST(track_no AS INT) AS number FROM files WHERE track_no IS NULL OR regexp_full_match(track_no, '[0-9]{1,9}|[A-Za-z].*')")
def zfill_track(spark: SparkSession, d: str) -> DataFrame:
    tracks = read_table(spark, d, "files").select("track_no").distinct().filter(F.col("track_no").isNull() | F.col("track_no").rlike("^([0-9]{1,9}|[A-Za-z].*)$"))
    return tracks.select("track_no", zfill("track_no").alias("padded"), track_label("track_no", F.lit("x")).alias("label"), F.col("track_no").try_cast("int").alias("number"))


def _whole_sql(text: str) -> str:
    """The whole number in a text as selected_numbers reads it; null for anything else and beyond 32 bits."""
    return f"CASE WHEN regexp_full_match({strip_blanks_sql(text)}, '[+-]?[0-9]+') THEN TRY_CAST({strip_blanks_sql(text)} AS INT) END"


@query(f"SELECT DISTINCT track_no, CASE WHEN length(track_no) >= 2 THEN track_no ELSE lpad(track_no, 2, '0') END AS padded, right('00' || track_no, 2) || ' x' AS label, {_whole_sql('track_no')} AS number FROM files")
def zfill_track_all(spark: SparkSession, d: str) -> DataFrame:
    """zfill_track over every track number, empty texts and forms such as 3/16 among them: those are padded and labelled as they are and are no number."""
    tracks = read_table(spark, d, "files").select("track_no").distinct()
    return tracks.select("track_no", zfill("track_no").alias("padded"), track_label("track_no", F.lit("x")).alias("label"), F.col("track_no").try_cast("int").alias("number"))


@query(f"SELECT DISTINCT title, lower({strip_blanks_sql("coalesce(title, '')")}) AS normal FROM files")
def normal_titles(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "files").select("title").distinct().select("title", normal_title("title").alias("normal"))


_TARGET = f"'/lib/' || ({_sane('album_artist')}) || '/' || ({_sane('album_title')}) || '/' || ({_sane('''(CASE WHEN length(coalesce(track_no, '1')) >= 2 THEN track_no ELSE lpad(coalesce(track_no, '1'), 2, '0') END) || ' - ' || coalesce(nullif(title, ''), 'Unknown') || coalesce(ext, '')''')})"
_TARGETS = f"{_CURRENT}, {_ALBUMS}, t AS (SELECT path, {_TARGET} AS target FROM (SELECT *, lower(regexp_extract(list_last(string_split(path, '/')), '^.*[^.]([.][^.]*)$', 1)) AS ext FROM cur) JOIN one ON album_id = release_id)"


def _targets(spark: SparkSession, d: str) -> DataFrame:
    joined = current(spark, d).join(releases(spark, d), F.col("album_id") == F.col("release_id"))
    return joined.select("path", target_path(F.lit("/lib"), F.col("album_artist"), F.col("album_title"), F.coalesce("track_no", F.lit("1")), F.col("title"), suffix("path")).alias("target"))


@query(f"WITH {_TARGETS} SELECT path, target FROM t")
def target_paths(spark: SparkSession, d: str) -> DataFrame:
    return _targets(spark, d)


@query(f"WITH {_TARGETS} SELECT path, target, row_number() OVER (PARTITION BY target ORDER BY path) - 1 AS collision_no FROM t")
def collision_names(spark: SparkSession, d: str) -> DataFrame:
    return number_collisions(_targets(spark, d), ["target"], [F.asc("path")]).withColumn("collision_no", F.col("collision_no").cast("bigint"))


@query(
    f"WITH {_TARGETS}, n AS (SELECT path AS src, target, list_last(string_split(target, '/')) AS base, row_number() OVER (PARTITION BY target ORDER BY path) - 1 AS n, row_number() OVER (PARTITION BY path ORDER BY target DESC) AS back FROM t), "
    "s AS (SELECT *, regexp_extract(base, '^.*[^.]([.][^.]*)$', 1) AS ending FROM n) "
    "SELECT src, regexp_extract(target, '^(.*)/[^/]*$', 1) || '/' || substr(base, 1, length(base) - length(ending)) || CASE WHEN n > 0 THEN ' (' || n || ')' ELSE '' END || ending AS dst, CASE WHEN back = 1 THEN 'move' ELSE 'copy' END AS op FROM s"
)
def file_action_plan(spark: SparkSession, d: str) -> DataFrame:
    """Source, destination and operation of every file of a known release."""
    return file_actions(_targets(spark, d).withColumnRenamed("path", "src"), [F.asc("target")])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1 THEN 'move' ELSE 'copy' END AS op FROM lineitem")
def move_or_copy(spark: SparkSession, d: str) -> DataFrame:
    rows = is_last(read_table(spark, d, "lineitem"), ["l_orderkey"], [F.asc(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("is_last"), "move").otherwise("copy").alias("op"))


@query("SELECT DISTINCT title, rpad(substr(coalesce(title, ''), 1, 25), 25, ' ') || ' | ' || rpad(substr(coalesce(format, ''), 1, 25), 25, ' ') || ' | 97%' AS line FROM files")
def listing_lines(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "files").select("title", table_row(F.col("title"), F.col("format"), F.lit(0.975)).alias("line")).distinct()


@query("SELECT DISTINCT track_no AS answer, CASE WHEN TRY_CAST(trim(track_no, ' ') AS INT) BETWEEN 1 AND 9 THEN TRY_CAST(trim(track_no, ' ') AS INT) END AS first_pick FROM files WHERE track_no IS NOT NULL AND regexp_full_match(track_no, '[0-9]+|[A-Za-z]+[0-9]*')")
def selection_parser(spark: SparkSession, d: str) -> DataFrame:
    answers = read_table(spark, d, "files").select(F.col("track_no").alias("answer")).distinct().filter(F.col("answer").rlike("^([0-9]+|[A-Za-z]+[0-9]*)$"))
    return answers.select("answer", F.get(selected_numbers("answer", F.lit(9)), F.lit(0)).alias("first_pick"))


_PICKS = f"list_transform(string_split(answer, ','), lambda x: {_whole_sql('x')})"


@query(
    "WITH a AS (SELECT track_no AS answer FROM files WHERE track_no IS NOT NULL UNION SELECT string_agg(DISTINCT track_no, ', ' ORDER BY track_no) FROM files WHERE track_no IS NOT NULL GROUP BY album_id) "
    f"SELECT answer, CASE WHEN len(list_filter({_PICKS}, lambda n: coalesce(n BETWEEN 1 AND 20, false))) = len({_PICKS}) THEN array_to_string({_PICKS}, ',') END AS picks FROM a"
)
def selection_lists(spark: SparkSession, d: str) -> DataFrame:
    """The whole list that an answer selects of 20, for every track number and every release's list of them; null if any part isn't a number from 1 to 20."""
    tracks = read_table(spark, d, "files").select("album_id", "track_no").filter(F.col("track_no").isNotNull())
    lists = tracks.groupBy("album_id").agg(F.array_join(F.array_sort(F.collect_set("track_no")), ", ").alias("answer")).select("answer")
    answers = tracks.select(F.col("track_no").alias("answer")).union(lists).distinct()
    return answers.select("answer", F.array_join(selected_numbers("answer", F.lit(20)), ",").alias("picks"))


# ---- JSON ----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    nation = read_table(spark, d, "nation")
    text = nation.select(F.to_json(F.struct(*nation.columns)).alias("t"))
    return text.select(F.from_json("t", nation.schema).alias("n")).select("n.*")


# ---- upserts and set operations ------------------------------------------------------------------------------------


@query(f"WITH a AS (SELECT path, max(title) AS title FROM files WHERE batch_no = 0 AND {strip_blanks_sql('path')} <> '' GROUP BY ALL), b AS (SELECT path, max(title) AS title FROM files WHERE batch_no > 0 AND {strip_blanks_sql('path')} <> '' GROUP BY ALL) SELECT path, title FROM a UNION ALL SELECT path, title FROM b WHERE path NOT IN (SELECT path FROM a)")
def fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    titles = lambda where: read_table(spark, d, "files").filter(F.expr(where) & not_blank("path")).groupBy("path").agg(F.max("title").alias("title"))
    return with_fallback(titles("batch_no = 0"), titles("batch_no > 0"))


_OLD = f"old AS (SELECT DISTINCT path, title, batch_no FROM files WHERE batch_no = 0 AND {strip_blanks_sql('path')} <> '' QUALIFY row_number() OVER (PARTITION BY path ORDER BY title DESC NULLS LAST) = 1)"
_NEW = f"new AS (SELECT DISTINCT path, title, batch_no FROM files WHERE batch_no > 0 AND {strip_blanks_sql('path')} <> '' QUALIFY row_number() OVER (PARTITION BY path ORDER BY batch_no DESC, title DESC NULLS LAST) = 1)"


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = read_table(spark, d, "files").filter(not_blank("path")).select("path", "title", "batch_no")
    return keep_best(files.filter("batch_no = 0"), ["path"], [F.col("title").desc_nulls_last()]), files.filter("batch_no > 0")


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM new UNION ALL SELECT * FROM old WHERE path NOT IN (SELECT path FROM new)")
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    return upsert(old, new, ["path"], [F.desc("batch_no"), F.col("title").desc_nulls_last()])


@query(f"WITH {_OLD}, n AS (SELECT DISTINCT path, title, batch_no FROM files WHERE batch_no > 0 AND {strip_blanks_sql('path')} <> '' QUALIFY row_number() OVER (PARTITION BY path ORDER BY batch_no, title NULLS FIRST) = 1) SELECT * FROM old UNION ALL SELECT * FROM n WHERE path NOT IN (SELECT path FROM old)")
def insert_first_wins(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    return insert_or_ignore(old, new, ["path"], [F.asc("batch_no"), F.col("title").asc_nulls_first()])


@query(f"WITH {_OLD}, {_NEW} SELECT old.path, coalesce(new.title, old.title) AS title, old.batch_no FROM old LEFT JOIN new USING (path)")
def repoint_rows(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    return repoint(old, keep_best(new, ["path"], [F.desc("batch_no"), F.col("title").desc_nulls_last()]), ["path"], "title")


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM old WHERE path NOT IN (SELECT path FROM new)")
def delete_superseded(spark: SparkSession, d: str) -> DataFrame:
    old, new = _old_new(spark, d)
    return delete_keys(old, new, ["path"])


# ---- order, runs, slots --------------------------------------------------------------------------------------------


@query(f"WITH {_ALBUMS}, r AS (SELECT release_id, row_number() OVER (ORDER BY release_id) AS row_no FROM one) SELECT release_id, row_no, CAST((row_no - 1) // 10 AS INT) AS page_no FROM r")
def pagination(spark: SparkSession, d: str) -> DataFrame:
    return paginate(releases(spark, d).select("release_id"), [F.asc("release_id")]).withColumn("row_no", F.col("row_no").cast("bigint"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sticky FROM events")
def sticky_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    return carry_forward(read_table(spark, d, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], F.col("event_type") == "signup", F.col("event_id"), "sticky").select("event_id", "sticky")


@query("WITH e AS (SELECT event_id, epoch_us(ts) AS us, row_number() OVER (ORDER BY ts, event_id) AS n FROM events) SELECT event_id, CAST(max(us - 350000 * n) OVER (ORDER BY n) + 350000 * n AS BIGINT) AS slot_us FROM e")
def rate_limit_slots(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events").select("event_id", F.unix_micros("ts").alias("us"))
    return rate_slots(events, "us", "event_id", 350_000).select("event_id", "slot_us")


@query("SELECT CASE WHEN text IS NULL THEN 'ERROR' WHEN length(text) > 0 THEN 'OK' ELSE 'DELETED' END AS status, count(*) AS n FROM documents GROUP BY ALL")
def repair_report(spark: SparkSession, d: str) -> DataFrame:
    status = repair_status(F.col("text").isNotNull(), F.length("text").cast("double"))
    return read_table(spark, d, "documents").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


