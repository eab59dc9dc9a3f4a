"""Catalogue files as a stream: each micro-batch becomes a new snapshot; and state carried along a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from waxmill.operators.catalog import drop_versions, latest_snapshot, upsert, write_snapshot


def snapshot_stream(source: DataFrame, folder: str, checkpoint: str, keys: list[str], order: list[Column]) -> StreamingQuery:
    """Upsert every micro-batch of `source` into the versioned table in `folder`, the first row in this order winning over others of the batch and over older versions.

    A batch's version number is its epoch: it starts from the version before, so one that is run again after a failure overwrites only its own. Two
    versions are kept. Every batch writes the table anew: for tables much larger than their batches, put many files into one batch.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        before = latest_snapshot(batch.sparkSession, folder, before=epoch)
        after = upsert(before, batch, keys, order) if before is not None else upsert(batch.limit(0), batch, keys, order)
        write_snapshot(after, folder, epoch)
        drop_versions(batch.sparkSession, folder)

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parked_stream(source: DataFrame, folder: str, checkpoint: str, decided: Callable[[DataFrame], Column]) -> StreamingQuery:
    """Work that can't be decided yet is parked and taken up again with the next batch.

    decided: of the rows at hand (the batch and what is parked, as a DataFrame) the condition that one can be dealt with. These are
    written to `folder`/done/epoch=n, the others to the next version of `folder`/parked; a batch that is run again overwrites only its own.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        parked = latest_snapshot(spark, f"{folder}/parked", before=epoch)
        rows = batch if parked is None else parked.unionByName(batch)
        ready = F.coalesce(decided(rows), F.lit(False))
        rows.filter(ready).write.mode("overwrite").parquet(f"{folder}/done/epoch={epoch}")
        write_snapshot(rows.filter(~ready), f"{folder}/parked", epoch)
        drop_versions(spark, f"{folder}/parked")

    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parquet_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def sticky_values(events: DataFrame, run: str, order: str, touched: str, value: str) -> DataFrame:
    """run, order, sticky: along each run the value of the last touched row before, kept as state from batch to batch.

    events (run string, order long, touched boolean, value string); rows of a batch are taken in order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (held,) = state.get if state.exists else (None,)
        batch = pd.concat(list(frames)).sort_values(order)
        out = []
        for o, t, v in zip(batch[order], batch[touched], batch[value], strict=True):
            out.append((key[0], o, held))
            if t:
                held = v
        state.update((held,))
        yield pd.DataFrame(out, columns=[run, order, "sticky"])

    return events.select(run, order, touched, value).groupBy(run).applyInPandasWithState(step, f"{run} string, {order} long, sticky string", "held string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per kind and window of event time, closed once they are `late` behind."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"))
