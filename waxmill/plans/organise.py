"""Target paths, tags and file actions as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waxmill.functions.ids import strip_blanks
from waxmill.functions.text import base_name, first_filled, folder, sanitise, stem, suffix, zfill
from waxmill.operators.ranking import is_last, number_collisions

#: The tag names of each kind of container, and the tags that are pairs of a number and a total, which is 0.
_FRAMES = {"title": "TIT2", "album": "TALB", "artist": "TPE1", "album_artist": "TPE2", "track_no": "TRCK", "disc_no": "TPOS"}
_PLAIN = {"title": "title", "album": "album", "artist": "artist", "album_artist": "albumartist", "track_no": "tracknumber", "disc_no": "discnumber"}
_ATOMS = {"title": "\xa9nam", "album": "\xa9alb", "artist": "\xa9ART", "album_artist": "aART", "track_no": "trkn", "disc_no": "disk"}
_WINDOWS = {"title": "Title", "album": "WM/AlbumTitle", "artist": "Author", "album_artist": "WM/AlbumArtist", "track_no": "WM/TrackNumber", "disc_no": "WM/PartOfSet"}
PAIRS = ("trkn", "disk")
TAG_NAMES = {".mp3": _FRAMES, ".flac": _PLAIN, ".wav": _PLAIN, ".m4a": _ATOMS, ".mp4": _ATOMS, ".wma": _WINDOWS}


def target_name(track: Column, title: Column, ext: Column) -> Column:
    return sanitise(F.concat(zfill(track), F.lit(" - "), first_filled(title, default="Unknown"), ext))


def target_path(root: Column, artist: Column, album: Column, track: Column, title: Column, ext: Column) -> Column:
    """root/artist/album/NN - title.ext, each part fit for a path."""
    return F.concat_ws("/", root, sanitise(artist), sanitise(album), target_name(track, title, ext))


def tag_plan(ext: Column, fields: dict[str, Column]) -> Column:
    """The tags to write, by the names of the file's kind of container; null for other kinds and without null fields.

    Pairs are written `number/0`; a number that isn't whole can't be one, and then nothing is written (null).
    """
    out = F.lit(None).cast("map<string,string>")
    for kind, names in TAG_NAMES.items():
        whole = F.lit(True)
        entries = []
        for field, name in names.items():
            if field not in fields:
                continue
            value = fields[field].cast("string")
            if name in PAIRS:
                number = strip_blanks(value).try_cast("int")
                whole &= number.isNotNull()
                value = F.concat(number.cast("string"), F.lit("/0"))
            entries += [F.lit(name), value]
        tags = F.when(whole, F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull()))
        out = F.when(F.lower(ext) == kind, tags).otherwise(out)
    return out


def tag_meta(recording_title: Column, album_title: Column, artist: Column, album_artist: Column, place: Column, year: Column, release_id: Column) -> Column:
    """The fields of a file's tags out of its chosen candidate, with their defaults."""
    who = first_filled(artist, default="Unknown Artist")
    return F.struct(
        first_filled(recording_title, default="Unknown").alias("title"),
        first_filled(album_title, default="Unknown Album").alias("album"),
        who.alias("artist"),
        F.coalesce(F.nullif(album_artist, F.lit("")), who).alias("album_artist"),
        place["track_no"].alias("track_no"),
        place["disc_no"].alias("disc_no"),
        F.coalesce(year.cast("string"), F.lit("0000")).alias("release_date"),
        release_id.alias("release_id"),
    )


def file_actions(moves: DataFrame, order: list[Column], taken: DataFrame | None = None) -> DataFrame:
    """src, dst, op of moves (src, target): a source's last target is a move, the others copies; names that collide, or are taken, get ` (n)`."""

    last = is_last(moves, ["src"], order)
    numbered = number_collisions(last, ["target"], [*order, F.asc("src")], taken)
    extra = F.when(F.col("collision_no") > 0, F.concat(F.lit(" ("), F.col("collision_no").cast("string"), F.lit(")"))).otherwise("")
    ending = F.right(base_name("target"), F.length(suffix("target")))
    renamed = F.concat_ws("/", F.nullif(folder("target"), F.lit("")), F.concat(stem("target"), extra, ending))
    return numbered.select("src", renamed.alias("dst"), F.when(F.col("is_last"), "move").otherwise("copy").alias("op"))


def empty_folders(folders: DataFrame, files: DataFrame) -> DataFrame:
    """folder, depth: the folders that hold no file at any depth, deepest first when ordered by depth descending."""
    parents = files.select(F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/")), lambda p: p != "")).alias("folder")).distinct()
    return folders.select("folder").distinct().join(parents, "folder", "left_anti").withColumn("depth", F.size(F.split("folder", "/")) - 1)
