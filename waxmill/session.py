"""Session construction, and written tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
#: Folders made under a checkpoint folder by this process, with their sessions.
_SCRATCH: dict[str, SparkSession] = {}


def build_session(app: str = "waxmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every query here assumes: UTC, AQE with skew handling, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only where that is unset and all work is done in this process is a temporary folder made.

    Anywhere else executors would write to disks of their own, so that an error is raised.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="waxmill-checkpoint-")
    return _OWN_DIRS[app]


def remove_scratch(*paths: str) -> None:
    """Delete these scratch folders, or all that this process has made; what reads them can't be computed again."""
    for path in paths or tuple(_SCRATCH):
        spark = _SCRATCH.pop(path, None)
        # the session may have ended
        with suppress(Exception):
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Deletes at its end what was written inside it under the checkpoint folder; results must have been written or collected by then."""
    before = set(_SCRATCH)
    try:
        yield
    finally:
        made = set(_SCRATCH) - before
        if made:
            remove_scratch(*made)


@atexit.register
def _clean_up() -> None:
    import shutil

    if _SCRATCH:
        remove_scratch()
    for path in _OWN_DIRS.values():
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder name under the shared checkpoint folder; deleted when the process ends, or the `scratch_scope` around it."""
    path = os.path.join(checkpoint_dir(spark), f"waxmill-{tag}-{uuid.uuid4().hex}")
    _SCRATCH[path] = spark
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and read it back.

    Unlike cache() the table survives the loss of executors, and unlike checkpoint() the rows are computed once, stored by
    column and compressed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def default_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
