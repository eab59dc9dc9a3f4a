"""Best representative of each duplicate group, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waxmill.functions.ids import canonical_id, strip_blanks, valid_path
from waxmill.llm.currency import current_versions

#: Fixed values of the catalogue: usable formats and the largest believable quality score.
USABLE_FORMATS = ("mp3", "flac", "m4a", "wav", "wma", "mp4")
LARGEST_SCORE = 3.1e15


def usable_score(score: Column) -> Column:
    """The score where it is finite, above 0 and believable; else null."""
    return F.when(~F.isnan(score) & (score > 0) & (score <= LARGEST_SCORE), score)


def usable_size(size: Column) -> Column:
    return F.when(size > 0, size)


def format_class(fmt: Column) -> Column:
    """The format in lower case without leading dots and blanks around it; null where it isn't usable."""
    name = F.regexp_replace(strip_blanks(F.lower(fmt)), r"^\.+", "")
    return F.when(name.isin(*USABLE_FORMATS), name)


def current_files(files: DataFrame, *columns: str) -> DataFrame:
    """The current row of every path, with canonical ids, usable values and the columns asked for.

    Where the latest versions share their time or have none, each field has its topologically latest value (see currency).
    """
    rows = files.select(
        valid_path("path").alias("path"),
        canonical_id("acoustid_id").alias("acoustid_id"),
        canonical_id("album_id").alias("album_id"),
        format_class(F.col("format")).alias("format"),
        usable_size(F.col("file_size")).alias("file_size"),
        usable_score(F.col("quality_score")).alias("quality_score"),
        "date_modified",
        F.col("processed").alias("processed"),
    )
    states = {
        "processed": F.coalesce(F.col("processed").cast("string"), F.lit("")),
        "format": F.coalesce(F.col("format"), F.lit("")),
        "file_size": F.col("file_size").isNotNull(),
        "quality_score": F.col("quality_score").isNotNull(),
        "acoustid_id": F.col("acoustid_id").isNotNull(),
        "album_id": F.col("album_id").isNotNull(),
    }
    return current_versions(rows, "path", "date_modified", states).select("path", "date_modified", *columns)


def best_representatives(copies: DataFrame, group: str, key: str, order: list[Column], fields: dict[str, Column]) -> DataFrame:
    """group, key, n_copies and, for each field, `<field>_key`: the surviving record of every group of at least two copies.

    key: the name of the column that identifies a copy, unique in the group and last in the order. order: ascending
    expressions, never null, that put the best copy first. fields: for each, the condition under which a copy's value is
    usable; `<field>_key` is the key of the first copy in order that has one, the empty string if there is none.

    The first copies are found as minima, which combine before the shuffle: a group of any size is one row per task.
    Null groups are left out; an empty table gives an empty result; columns of copies not named here are ignored.
    """
    place = F.struct(*(e.alias(f"o{i}") for i, e in enumerate(order)), F.col(key).alias("key"))
    firsts = [F.min(F.when(usable, place)).alias(f"__{name}") for name, usable in fields.items()]
    grouped = copies.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n_copies"), F.min(place).alias("__best"), *firsts)
    return grouped.filter(F.col("n_copies") > 1).select(group, F.col("__best.key").alias(key), "n_copies", *(F.coalesce(F.col(f"__{name}.key"), F.lit("")).alias(f"{name}_key") for name in fields))


def best_copy_order() -> list[Column]:
    """Copies with a usable score by score, then all by size, date and path; ascending, the best first."""
    score, size, date = F.col("quality_score"), F.col("file_size"), F.unix_micros(F.col("date_modified"))
    earliest = F.lit((1 << 63) - 1)
    return [score.isNull(), F.coalesce(-score, F.lit(0.0)), F.coalesce(-size, F.lit(0)), F.coalesce(-date, earliest)]
