"""Evidence about files as tables: stream headers, tags, and the schemas of the catalogue."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waxmill.functions.quality import quality_score
from waxmill.functions.text import suffix

HEADERS = "path string, bits int, sample_rate int, bitrate int"
TAGS = "path string, title array<string>, artist array<string>, album array<string>"


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
#: The catalogue's tables.
CATALOGUE = {
    "albums": _table(("release_id", _S), ("album_title", _S), ("album_artist", _S), ("release_date", _S), ("country", _S)),
    "files": _table(("path", _S), ("fingerprint", _S), ("acoustid_id", _S), ("title", _S), ("track_no", _S), ("track_no_int", _I), ("disc_no", _S), ("disc_no_int", _I), ("format", _S), ("file_size", _L), ("quality_score", _D), ("album_id", _S), ("processed", _B), ("date_modified", T.TimestampType())),
    "known_fingerprints": _table(("fingerprint", _S), ("acoustid_id", _S)),
    "known_blocks": _table(("block", _S), ("acoustid_id", _S), ("pos", _I)),
    "fingerprint_index": _table(("block", _S), ("path", _S), ("pos", _I)),
    "audio_hashes": _table(("audio_hash", _S), ("recipe", _S), ("path", _S)),
    "ambiguous_files": _table(("path", _S), ("candidates_json", _S), ("acoustid_id", _S), ("fingerprint", _S), ("quality_json", _S), ("audio_hash", _S)),
}


def _opened(path: str, easy: bool):
    """The file as the optional tag library reads it; None where the library or the file is missing or fails."""
    try:
        import mutagen

        return mutagen.File(path, easy=easy)
    except Exception:  # noqa: BLE001
        return None


def read_headers(manifest: DataFrame) -> DataFrame:
    """HEADERS of the files of a manifest, read on the executors with an optional library; files that can't be read have no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(p, getattr(a, "info", None)) for p in f["path"] if (a := _opened(p, False)) is not None]
            yield pd.DataFrame([(p, getattr(i, "bits_per_sample", None), getattr(i, "sample_rate", None), getattr(i, "bitrate", None)) for p, i in found], columns=["path", "bits", "sample_rate", "bitrate"])

    return manifest.select("path").mapInPandas(run, HEADERS)


def read_tags(manifest: DataFrame) -> DataFrame:
    """TAGS of the files of a manifest, read like headers; a tag may have several values or none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(p, a) for p in f["path"] if (a := _opened(p, True)) is not None]
            yield pd.DataFrame([(p, *(list(a.get(k) or []) for k in ("title", "artist", "album"))) for p, a in found], columns=["path", "title", "artist", "album"])

    return manifest.select("path").mapInPandas(run, TAGS)


def first_tag(values: Column) -> Column:
    """The first value of a tag; the empty string without one."""
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def with_quality(manifest: DataFrame, headers: DataFrame) -> DataFrame:
    """The files of a manifest (path, length) with `quality`, a struct of score, format, size, bitrate, sample_rate and bits; null for a file without a header, which can't be read."""
    joined = manifest.join(headers.select("path", "bits", "sample_rate", "bitrate", F.lit(True).alias("__read")), "path", "left")
    ext = suffix("path")
    quality = F.struct(
        quality_score(ext, F.col("bits"), F.col("length"), F.col("sample_rate"), F.col("bitrate")).alias("score"),
        ext.alias("format"),
        F.col("length").alias("size"),
        F.coalesce("bitrate", F.lit(0)).alias("bitrate"),
        F.coalesce("sample_rate", F.lit(44100)).alias("sample_rate"),
        F.coalesce("bits", F.lit(16)).alias("bits"),
    )
    return joined.select(*(manifest[c] for c in manifest.columns), F.when(F.col("__read"), quality).alias("quality"))


def encode_ambiguous(rows: DataFrame) -> DataFrame:
    """Rows with nested `candidates` and `quality` as they are kept: candidates_json and quality_json, texts of JSON with nulls spelled out."""
    text = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    return rows.withColumns({"candidates_json": text("candidates"), "quality_json": text("quality")}).drop("candidates", "quality")
