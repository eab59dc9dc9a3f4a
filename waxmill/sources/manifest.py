"""Files on disk as a table, and optional decoders."""

from __future__ import annotations

import json
import re
import shutil
import subprocess
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waxmill.functions.text import AUDIO_SUFFIXES, is_audio


def scan_folder(spark: SparkSession, folder: str, recursive: bool = True, audio_only: bool = True, suffixes: tuple[str, ...] = AUDIO_SUFFIXES) -> DataFrame:
    """path, length, modified of the files under a folder, with audio_only those of these suffixes in any case (REPAIR_SUFFIXES for repairs).

    The file source passes over empty files; they are added from its file index, with length 0 and no time, as a file that is
    empty does exist.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    listed = found.select("path", "length", F.col("modificationTime").alias("modified"))
    every = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(p)),) for p in found.inputFiles()], "path string")
    empty = every.join(listed.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified"))
    both = listed.unionByName(empty)
    return both.filter(is_audio("path", suffixes)) if audio_only else both


def readable(manifest: DataFrame) -> DataFrame:
    """Files that aren't empty."""
    return manifest.filter(F.col("length") > 0)


#: The two excerpts that are hashed, which can't be compared with each other: (start, seconds, further arguments).
RECIPES = {"seek15_len30_native": (15, 30, ()), "seek15_len5_mono22k": (15, 5, ("-map", "0:a:0", "-ac", "1", "-ar", "22050"))}


def excerpt_hashes(manifest: DataFrame, recipe: str, timeout_s: int = 15) -> DataFrame:
    """path, recipe, audio_hash by a decoder program on the executors; null where it is missing, fails or yields nothing."""
    import hashlib

    start, seconds, more = RECIPES[recipe]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program = shutil.which("ffmpeg")
        for f in frames:
            out = []
            for path in f["path"]:
                data = b""
                if program:
                    try:
                        data = subprocess.run([program, "-v", "error", "-ss", str(start), "-t", str(seconds), "-i", path, *more, "-f", "s16le", "-"], capture_output=True, timeout=timeout_s, check=True).stdout
                    except (OSError, subprocess.SubprocessError):
                        data = b""
                out.append(hashlib.md5(data).hexdigest() if data else None)
            yield pd.DataFrame({"path": f["path"], "recipe": recipe, "audio_hash": out})

    return manifest.select("path").mapInPandas(run, "path string, recipe string, audio_hash string")


def fingerprints(manifest: DataFrame, seconds: int = 120, timeout_s: int = 30) -> DataFrame:
    """path, duration, fingerprint by a fingerprinting program on the executors; nulls where it is missing or fails."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program = shutil.which("fpcalc")
        for f in frames:
            rows = []
            for path in f["path"]:
                answer: dict = {}
                if program:
                    try:
                        answer = json.loads(subprocess.run([program, "-json", "-length", str(seconds), path], capture_output=True, timeout=timeout_s, check=True).stdout)
                    except (OSError, ValueError, subprocess.SubprocessError):
                        answer = {}
                rows.append((path, answer.get("duration"), answer.get("fingerprint")))
            yield pd.DataFrame(rows, columns=["path", "duration", "fingerprint"])

    return manifest.select("path").mapInPandas(run, "path string, duration double, fingerprint string")


__all__ = ["AUDIO_SUFFIXES", "RECIPES", "excerpt_hashes", "fingerprints", "readable", "scan_folder"]
