"""Views of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame

from waxmill.functions.text import track_label


def album_tracks(files: DataFrame, albums: DataFrame) -> DataFrame:
    """album_artist, album_title, title (with its track number), quality_score, path; files (album_id, ...) and albums (release_id, ...) in canonical ids, a row per release."""
    joined = files.join(albums, files["album_id"] == albums["release_id"])
    return joined.select("album_artist", "album_title", track_label("track_no", "title").alias("title"), "quality_score", "path")


def register_album_tracks(files: DataFrame, albums: DataFrame, name: str = "album_tracks_V") -> None:
    """Create or replace the view for SQL."""
    album_tracks(files, albums).createOrReplaceTempView(name)
