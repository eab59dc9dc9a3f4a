"""Reading rules of keys: identifiers, paths and blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks are spaces, tabs and line ends.
BLANKS = " \t\r\n"
ZERO_ID = "0" * 32


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_blanks(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def not_blank(c: Column | str) -> Column:
    """False for null and for texts of blanks only."""
    return F.coalesce(F.length(strip_blanks(c)) > 0, F.lit(False))


def clean_text(c: Column | str) -> Column:
    """The text without blanks around it; null where nothing is left."""
    return F.nullif(strip_blanks(c), F.lit(""))


def valid_path(c: Column | str) -> Column:
    """The path byte by byte as stored; null where there is none."""
    return F.when(not_blank(c), col(c))


def canonical_id(c: Column | str) -> Column:
    """32 hexadecimal digits in lower case as 8-4-4-4-12, whatever their case, hyphens, braces and blanks around them; null for anything else and for 32 zeros."""
    digits = F.replace(F.lower(F.btrim(col(c), F.lit(BLANKS + "{}"))), F.lit("-"), F.lit(""))
    dashed = F.concat_ws("-", *(F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(digits.rlike("^[0-9a-f]{32}$") & (digits != ZERO_ID), dashed)


def canonical_id_sql(name: str) -> str:
    """The same rule as canonical_id for DuckDB."""
    digits = f"replace(lower(trim({name}, ' ' || chr(9) || chr(10) || chr(13) || '{{}}')), '-', '')"
    parts = " || '-' || ".join(f"substr({digits}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"CASE WHEN regexp_full_match({digits}, '[0-9a-f]{{32}}') AND {digits} <> '{ZERO_ID}' THEN {parts} END"


def strip_blanks_sql(name: str) -> str:
    return f"trim({name}, ' ' || chr(9) || chr(10) || chr(13))"
