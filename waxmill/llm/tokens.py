"""Token counts of whole texts by a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

#: The rank file used unless another is named; it is read on the driver and sent to the tasks (under 1 MB).
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded in parts, cut where the pattern always cuts.
PART = 200_000


def encoding(ranks: bytes):
    """The encoder of a rank file's contents, made once per process.

    It is kept with the library, as this module's own state is new in every task that it is sent to.
    """
    import tiktoken

    kept = tiktoken.__dict__.setdefault("waxmill_encodings", {})
    key = hash(ranks)
    if key not in kept:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        kept[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return kept[key]


def parts(text: str) -> Iterator[str]:
    """The text in parts of about PART characters, cut only between a letter and a blank that a letter follows, which is always a token boundary."""
    start = 0
    while len(text) - start > PART:
        at = start + PART
        while at < len(text) - 1 and not (text[at] == " " and text[at - 1].isalpha() and text[at + 1].isalpha()):
            at += 1
        if at >= len(text) - 1:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def count(text: str | None, encoder) -> int:
    return 0 if not text else sum(len(encoder.encode_ordinary(p)) for p in parts(text))


def token_counts(df: DataFrame, text: str, ranks_file: str = DEFAULT_RANKS) -> DataFrame:
    """df with `tokens`, the number of tokens of the whole text, in place of the column `text`; 0 for null and empty texts."""
    ranks = Path(ranks_file).read_bytes()
    kept = [c for c in df.columns if c != text]
    schema = df.select(*kept).schema.add("tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(ranks)
        for b in batches:
            n = pa.array([count(t.as_py(), encoder) for t in b.column(len(kept))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*kept, "tokens"])

    return df.select(*kept, text).mapInArrow(run, schema)
