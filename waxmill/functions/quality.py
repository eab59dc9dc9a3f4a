"""The quality score of a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of formats (any other has none), and the values assumed where a header lacks one.
FORMAT_WEIGHTS = {".flac": 3e15, ".m4a": 2.5e15, ".wav": 2e15, ".mp3": 1e15, ".wma": 5e14}
DEFAULT_BITS, DEFAULT_RATE, DEFAULT_BITRATE = 16, 44100, 0


def quality_score(ext: Column, bits: Column, size: Column, rate: Column, bitrate: Column) -> Column:
    """Weight of the format, then bits, size, sample rate and bit rate, as one double."""
    weights = F.create_map(*(F.lit(x) for pair in FORMAT_WEIGHTS.items() for x in pair))
    weight = F.coalesce(F.try_element_at(weights, F.lower(ext)), F.lit(0.0))
    number = lambda c, default: F.coalesce(c, F.lit(default)).cast("double")
    return weight + number(bits, DEFAULT_BITS) * 1e12 + number(size, 0) / 1000 + number(rate, DEFAULT_RATE) / 1e6 + number(bitrate, DEFAULT_BITRATE) / 1e9
