"""Queries of the training-data problems: best representative (1), top N (2), deduplication against history (4), packing (7), mixing (8), subjects (9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waxmill.functions.ids import canonical_id_sql, clean_text, strip_blanks_sql
from waxmill.llm.best import best_copy_order, best_representatives, current_files
from waxmill.llm.history import exact_repeats, near_repeats
from waxmill.llm.mixing import Target, mix
from waxmill.llm.packing import containers, pack, plan_summary
from waxmill.llm.subjects import subject_areas
from waxmill.llm.topn import top_n
from waxmill.sources.tables import read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The best copy of every recording with at least two current files, its format and its size taken field by field."""
    copies = current_files(read_table(spark, d, "files"), "acoustid_id", "format", "file_size", "quality_score")
    best = best_representatives(copies, "acoustid_id", "path", best_copy_order(), {"format": F.col("format").isNotNull(), "size": F.col("file_size").isNotNull()})
    return best.select("acoustid_id", "path", F.col("format_key").alias("format_path"), F.col("size_key").alias("size_path"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The three best recordings of every release."""
    rows = current_files(read_table(spark, d, "files"), "acoustid_id", "album_id", "quality_score")
    return top_n(rows, "album_id", "acoustid_id", "quality_score", "path", 3).select("album_id", "rank_no", "path")


#: The digest of an empty excerpt, which agrees with nothing.
EMPTY_EXCERPT = "d41d8cd98f00b204e9800998ecf8427e"


def p4_hash_repeats(spark: SparkSession, d: str) -> DataFrame:
    """The exact half of p4_found: hashes of one recipe that were there before."""
    hashes, value = read_table(spark, d, "audio_hashes"), F.lower(clean_text("audio_hash"))
    same = exact_repeats(hashes, [F.col("recipe"), F.when(value != EMPTY_EXCERPT, value)], "arrival_no", "batch_no")
    return same.select(F.lit("audio_hashes").alias("table_name"), F.col("arrival").alias("arrival_no"), F.col("matched").alias("matched_no"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows of each batch that repeat, or nearly repeat, something accepted before."""
    texts = read_table(spark, d, "known_fingerprints")
    near = near_repeats(texts, "fingerprint", "arrival_no", "batch_no")
    return p4_hash_repeats(spark, d).unionByName(
        near.select(F.lit("known_fingerprints").alias("table_name"), F.col("arrival").alias("arrival_no"), F.col("matched").alias("matched_no"))
    )


def p7_contents(spark: SparkSession, d: str) -> DataFrame:
    """The container of every text, or of every piece of a text that is longer than a container."""
    return pack(read_table(spark, d, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that had to be cut: those longer than a container."""
    return p7_contents(spark, d).filter("piece_no > 0").select("doc_id").distinct()


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Each container with its number of items and its unused room."""
    return containers(p7_contents(spark, d))


def p7_plan(spark: SparkSession, d: str) -> DataFrame:
    """How many containers there are, how many of them the reduction fixed, and how few there could be."""
    return plan_summary(read_table(spark, d, "documents"), "doc_id", "text")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = {r["source"]: Target(r["target_share"], r["max_repeats"]) for r in read_table(spark, d, "mix_targets").collect()}
    return mix(read_table(spark, d, "documents"), "doc_id", "text", "source", targets)


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    """The documents taken, with their copies."""
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mixed(spark, d)[1]


def _areas(spark: SparkSession, d: str) -> DataFrame:
    subjects = [r["subject"] for r in read_table(spark, d, "subjects").orderBy("subject").collect()]
    samples = [(r["text"], r["lang"], r["subject"].strip().lower()) for r in read_table(spark, d, "subject_samples").orderBy("sample_id").collect() if r["text"] and r["subject"]]
    return subject_areas(read_table(spark, d, "documents"), "doc_id", "text", samples, subjects, "music")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The subject areas of each document."""
    return _areas(spark, d).select("doc_id", "subject")


def p9_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The make-up of the corpus: documents by subject area."""
    return _areas(spark, d).groupBy("subject").agg(F.count("*").alias("documents"))


QUERIES = {q.__name__: q for q in (p1_found, p2_found, p4_found, p4_hash_repeats, p7_found, p7_contents, p7_containers, p7_plan, p8_selection, p8_shares, p9_found, p9_corpus)}

_FORMAT = f"regexp_replace({strip_blanks_sql('lower(format)')}, '^[.]+', '')"
_CURRENT = f"""
current AS (
  SELECT path, {canonical_id_sql("acoustid_id")} AS acoustid_id, {canonical_id_sql("album_id")} AS album_id,
    CASE WHEN {_FORMAT} IN ('mp3', 'flac', 'm4a', 'wav', 'wma', 'mp4') THEN {_FORMAT} END AS format,
    CASE WHEN file_size > 0 THEN file_size END AS file_size,
    CASE WHEN NOT isnan(quality_score) AND quality_score > 0 AND quality_score <= 3.1e15 THEN quality_score END AS score, date_modified
  FROM files WHERE {strip_blanks_sql("path")} <> ''
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY date_modified DESC NULLS LAST) = 1)
"""
_BEST = "score DESC NULLS LAST, file_size DESC NULLS LAST, date_modified DESC NULLS LAST, path"

_HASH = f"lower({strip_blanks_sql('audio_hash')})"
ORACLE_SQL = {
    "p4_hash_repeats": f"""WITH h AS (SELECT DISTINCT recipe, {_HASH} AS hash, arrival_no, batch_no FROM audio_hashes WHERE {_HASH} NOT IN ('', '{EMPTY_EXCERPT}') AND recipe IS NOT NULL AND arrival_no IS NOT NULL AND batch_no IS NOT NULL),
first AS (SELECT recipe, hash, min(arrival_no) AS matched_no FROM h GROUP BY ALL)
SELECT DISTINCT 'audio_hashes' AS table_name, arrival_no, matched_no FROM h JOIN first USING (recipe, hash) WHERE batch_no > 0 AND matched_no < arrival_no""",
    "p1_found": f"""WITH {_CURRENT},
ranked AS (SELECT *, row_number() OVER (PARTITION BY acoustid_id ORDER BY {_BEST}) AS place FROM current WHERE acoustid_id IS NOT NULL)
SELECT acoustid_id, arg_min(path, place) AS path,
  coalesce(arg_min(path, place) FILTER (format IS NOT NULL), '') AS format_path,
  coalesce(arg_min(path, place) FILTER (file_size IS NOT NULL), '') AS size_path
FROM ranked GROUP BY acoustid_id HAVING count(*) > 1""",
    "p2_found": f"""WITH {_CURRENT},
one AS (SELECT * FROM current WHERE acoustid_id IS NOT NULL AND album_id IS NOT NULL AND score IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY album_id, acoustid_id ORDER BY score DESC, path) = 1)
SELECT album_id, CAST(row_number() OVER (PARTITION BY album_id ORDER BY score DESC, path) AS INT) AS rank_no, path FROM one
QUALIFY row_number() OVER (PARTITION BY album_id ORDER BY score DESC, path) <= 3""",
}
