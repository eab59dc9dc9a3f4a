"""Text expressions of the catalogue: names, labels, paths, flags and blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waxmill.functions.ids import col, strip_blanks

#: The suffixes that are scanned, block width and blocks of a fingerprint, and the texts that mean true.
AUDIO_SUFFIXES = (".mp3", ".flac", ".m4a", ".mp4", ".wma", ".wav")
REPAIR_SUFFIXES = (".m4a", ".mp4", ".aac")
BLOCK_WIDTH, MOST_BLOCKS = 16, 16
TRUE_TEXTS = ("true", "1", "yes", "t")


def first_filled(*values: Column | str, default: str) -> Column:
    """The first value that is neither null nor empty, else the default."""
    return F.coalesce(*(F.nullif(col(v), F.lit("")) for v in values), F.lit(default))


def sanitise(name: Column | str) -> Column:
    """A name fit for a path: slashes become `-`; only letters, digits, blanks, `-`, `_` and `.` are kept; ends are trimmed.

    Null, empty, `.`, `..` and names of which nothing is left become `Unknown`.
    """
    kept = F.btrim(F.regexp_replace(F.translate(first_filled(name, default="Unknown"), "/\\", "--"), r"[^\p{L}\p{N} _.\-]", ""))
    return F.when(kept.isin("", ".", ".."), F.lit("Unknown")).otherwise(kept)


def zfill(text: Column | str, width: int = 2) -> Column:
    """Zeros put before the text up to the width; longer texts stay whole."""
    t = col(text).cast("string")
    return F.when(F.length(t) >= width, t).otherwise(F.lpad(t, width, "0"))


def track_label(track: Column | str, title: Column | str) -> Column:
    """The last two digits of the track number and the title; null if either is."""
    return F.concat(F.right(F.concat(F.lit("00"), col(track).cast("string")), F.lit(2)), F.lit(" "), col(title))


def normal_title(title: Column | str) -> Column:
    """The form in which titles are compared."""
    return F.lower(strip_blanks(F.coalesce(col(title), F.lit(""))))


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def suffix(path: Column | str) -> Column:
    """The last suffix of the path's file name with its dot, in lower case; empty if there is none. A leading dot is no suffix."""
    return F.lower(F.regexp_extract(base_name(path), r"^.*[^.](\.[^.]*)$", 1))


def stem(path: Column | str) -> Column:
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(path)))


def folder(path: Column | str) -> Column:
    """What comes before the last slash."""
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def is_audio(path: Column | str, suffixes: tuple[str, ...] = AUDIO_SUFFIXES) -> Column:
    return suffix(path).isin(*suffixes)


def decision(answer: Column | str, most: Column) -> Column:
    """struct(action, picks) of an answer: `s` skips, `q` quits (any case), a list of numbers selects; anything else is asked again (null)."""
    said = F.lower(strip_blanks(col(answer)))
    picks = selected_numbers(col(answer), most)
    action = F.when(said == "s", "skip").when(said == "q", "quit").when(picks.isNotNull(), "select")
    return F.struct(action.alias("action"), picks.alias("picks"))


def parse_flag(value: Column | str, default: bool = False) -> Column:
    """True for the usual texts of true, false for other texts, the default for null."""
    return F.coalesce(F.lower(strip_blanks(col(value).cast("string"))).isin(*TRUE_TEXTS), F.lit(default))


def blocks(fingerprint: Column | str) -> Column:
    """The first MOST_BLOCKS pieces of BLOCK_WIDTH characters; the last may be shorter; an empty array for null and empty."""
    f = col(fingerprint)
    n = F.least(F.ceil(F.coalesce(F.length(f), F.lit(0)) / BLOCK_WIDTH).cast("int"), F.lit(MOST_BLOCKS))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(f, i * BLOCK_WIDTH + 1, F.lit(BLOCK_WIDTH)))).otherwise(F.array().cast("array<string>"))


def selected_numbers(text: Column | str, most: Column) -> Column:
    """`1, 3` as [1, 3]; null if any part isn't a number from 1 to most."""
    numbers = F.transform(F.split(col(text), ","), lambda p: strip_blanks(p).try_cast("int"))
    return F.when(F.forall(numbers, lambda n: F.coalesce(n.between(1, most), F.lit(False))), numbers)


def search_terms(artist: Column, title: Column, album: Column) -> Column:
    """The text query of a lookup by tags; the album only where there is one."""
    quoted = lambda name, c: F.concat(F.lit(f'{name}:"'), F.coalesce(c, F.lit("")), F.lit('"'))
    return F.concat_ws(" AND ", quoted("artist", artist), quoted("recording", title), F.when(F.coalesce(album, F.lit("")) != "", quoted("release", album)))


def table_row(title: Column, artist: Column, similarity: Column) -> Column:
    """A line of a listing: title and artist cut and padded to 25 characters, the similarity in whole per cent."""
    cut = lambda c: F.rpad(F.substring(F.coalesce(c, F.lit("")), 1, 25), 25, " ")
    return F.concat_ws(" | ", cut(title), cut(artist), F.concat(F.floor(similarity * 100).cast("string"), F.lit("%")))
