"""Queries of the general problems: heavy keys (3), nested records (5), orphan references (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waxmill.functions.ids import canonical_id, canonical_id_sql, clean_text, strip_blanks_sql, valid_path
from waxmill.operators.nested import Node, label_nodes, node_table
from waxmill.operators.references import Parent, Reference, orphan_references, orphan_summary
from waxmill.operators.skew import distinct_owner_counts, widespread_keys
from waxmill.sources.tables import read_table

#: A block held by at least this share of its table's owners is one of the few.
WIDESPREAD = 1 / 50


def _block_owners(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    index, known = read_table(spark, d, "fingerprint_index"), read_table(spark, d, "known_blocks")
    return {
        "fingerprint_index": index.select(clean_text("block").alias("block"), valid_path("path").alias("owner")),
        "known_blocks": known.select(clean_text("block").alias("block"), canonical_id("acoustid_id").alias("owner")),
    }


def p3_block_owners(spark: SparkSession, d: str) -> DataFrame:
    """The number of distinct files or recordings of every block."""
    parts = [distinct_owner_counts(df, "block", "owner").select(F.lit(name).alias("table_name"), "block", "owners") for name, df in _block_owners(spark, d).items()]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The blocks held by at least one in fifty of the owners of their table."""
    parts = [widespread_keys(df, "block", "owner", WIDESPREAD).select(F.lit(name).alias("table_name"), "block") for name, df in _block_owners(spark, d).items()]
    return parts[0].unionByName(parts[1])


#: The declared shape of the nested texts of ambiguous_files.
CANDIDATES = Node(
    "candidate",
    many=True,
    fields=("similarity", "recording_title", "album_title", "artist", "date", "country", "is_owned"),
    children={
        "release": Node(
            "release",
            fields=("id", "title", "country"),
            children={
                "artists": Node("artist", many=True, fields=("name",)),
                "mediums": Node("medium", many=True, fields=("position",), children={"tracks": Node("track", many=True, fields=("position", "title"))}),
            },
        )
    },
)
QUALITY = Node("quality", fields=("score", "format", "size", "bitrate", "sample_rate", "bits"))


def bare(node: Node) -> Node:
    """The same shape without any fields."""
    return Node(node.name, node.many, {k: bare(v) for k, v in node.children.items()})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """One row for each object of the nested texts, with its place."""
    nodes = label_nodes(read_table(spark, d, "ambiguous_files"), valid_path("path"), {"candidates_json": bare(CANDIDATES), "quality_json": bare(QUALITY)})
    node, at = F.col("node"), lambda i: F.coalesce(F.get("ordinals", F.lit(i)), F.lit(-1))
    item = F.when(node == "artist", at(1)).when(node == "track", at(2)).otherwise(F.lit(-1))
    return (
        nodes.filter(node != "release")
        .select(F.col("key").alias("path"), "node", at(0).alias("candidate_no"), F.when(node.isin("medium", "track"), at(1)).otherwise(F.lit(-1)).alias("medium_no"), item.alias("item_no"))
        .distinct()
    )


def p5_tracks(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of tracks, each with its file, its place and its medium's label."""
    nodes = label_nodes(read_table(spark, d, "ambiguous_files"), valid_path("path"), {"candidates_json": CANDIDATES})
    table = node_table(nodes, "track", ("candidate_no", "medium_no", "item_no"), ("position", "title"))
    label = lambda c: F.array_join(F.col(c).cast("array<string>"), ".").alias(c)
    return table.select(F.col("key").alias("path"), "document", label("dewey"), label("parent_dewey"), "candidate_no", "medium_no", "item_no", "position", "title").distinct()


def p5_node_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many objects each schema path holds over all files."""
    nodes = label_nodes(read_table(spark, d, "ambiguous_files").distinct(), valid_path("path"), {"candidates_json": bare(CANDIDATES), "quality_json": bare(QUALITY)})
    return nodes.groupBy("schema_path").agg(F.count("*").alias("n_objects"))


def catalogue_orphans(spark: SparkSession, d: str) -> DataFrame:
    files, albums = read_table(spark, d, "files"), read_table(spark, d, "albums")
    index, hashes = read_table(spark, d, "fingerprint_index"), read_table(spark, d, "audio_hashes")
    batch = F.col("batch_no")
    return orphan_references(
        [Parent("albums", albums, canonical_id("release_id"), batch), Parent("files", files, valid_path("path"), batch)],
        [
            Reference("files", files, canonical_id("album_id"), batch, "albums"),
            Reference("fingerprint_index", index, valid_path("path"), batch, "files"),
            Reference("audio_hashes", hashes, valid_path("path"), batch, "files"),
        ],
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """References whose target is missing or came in a later batch."""
    return catalogue_orphans(spark, d).select("table_name", "ref_key", F.col("period").alias("batch_no"), "kind")


def p6_orphans_by_batch(spark: SparkSession, d: str) -> DataFrame:
    """The same per table and batch: keys and rows."""
    return orphan_summary(catalogue_orphans(spark, d)).withColumnRenamed("period", "batch_no")


QUERIES = {q.__name__: q for q in (p3_found, p3_block_owners, p5_found, p5_tracks, p5_node_counts, p6_found, p6_orphans_by_batch)}

_OWNED = f"""
  SELECT 'fingerprint_index' AS table_name, nullif({strip_blanks_sql("block")}, '') AS block, CASE WHEN {strip_blanks_sql("path")} <> '' THEN path END AS owner FROM fingerprint_index
  UNION ALL
  SELECT 'known_blocks', nullif({strip_blanks_sql("block")}, ''), {canonical_id_sql("acoustid_id")} FROM known_blocks
"""
_COUNTS = "SELECT table_name, block, count(DISTINCT owner) AS owners FROM owned WHERE block IS NOT NULL AND owner IS NOT NULL GROUP BY ALL"
_REFS = f"""
WITH refs AS (
  SELECT 'files' AS table_name, {canonical_id_sql("album_id")} AS ref_key, batch_no, 'albums' AS parent FROM files
  UNION ALL SELECT 'fingerprint_index', CASE WHEN {strip_blanks_sql("path")} <> '' THEN path END, batch_no, 'files' FROM fingerprint_index
  UNION ALL SELECT 'audio_hashes', CASE WHEN {strip_blanks_sql("path")} <> '' THEN path END, batch_no, 'files' FROM audio_hashes),
targets AS (
  SELECT 'albums' AS parent, {canonical_id_sql("release_id")} AS ref_key, min(batch_no) AS first_batch FROM albums GROUP BY ALL
  UNION ALL SELECT 'files', path, min(batch_no) FROM files GROUP BY ALL),
orphans AS (
  SELECT table_name, ref_key, batch_no, CASE WHEN t.ref_key IS NULL THEN 'missing' ELSE 'late' END AS kind
  FROM refs LEFT JOIN targets t USING (parent, ref_key)
  WHERE ref_key IS NOT NULL AND (t.ref_key IS NULL OR t.first_batch > batch_no))
"""

ORACLE_SQL = {
    "p3_found": f"WITH owned AS ({_OWNED}), counts AS ({_COUNTS}), totals AS (SELECT table_name, count(DISTINCT owner) AS n FROM owned GROUP BY ALL) SELECT table_name, block FROM counts JOIN totals USING (table_name) WHERE owners >= n / 50.0",
    "p3_block_owners": f"WITH owned AS ({_OWNED}) {_COUNTS}",
    "p6_found": f"{_REFS} SELECT DISTINCT table_name, ref_key, batch_no, kind FROM orphans",
    "p6_orphans_by_batch": f"{_REFS} SELECT table_name, batch_no, kind, count(DISTINCT ref_key) AS n_keys, count(*) AS n_rows FROM orphans GROUP BY ALL",
}
