"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from waxmill.operators.catalog import drop_versions, latest_snapshot, write_snapshot
from waxmill.operators.ranking import carry_forward
from waxmill.streaming.ingest import parked_stream, parquet_stream, snapshot_stream, sticky_values, windowed_counts


def test_snapshots_take_the_latest_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[("a", 1), ("b", 1)], [("b", 2), ("c", 2), ("c", 1)], [("a", 3)]]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, "k string, v int").coalesce(1).write.mode("append").parquet(source)
        stream = parquet_stream(spark, source, spark.createDataFrame([], "k string, v int").schema)
        snapshot_stream(stream, out, str(tmp_path / "cp"), ["k"], [F.desc("v")]).awaitTermination()
        assert i is not None
    assert sorted(tuple(r) for r in latest_snapshot(spark, out).collect()) == [("a", 3), ("b", 2), ("c", 2)]


def test_sticky_state_is_the_window(spark, tmp_path):
    source = str(tmp_path / "ev")
    rows = [("r", 1, True, "a"), ("r", 2, False, "x"), ("r", 3, True, None), ("q", 1, True, "z"), ("r", 4, False, "y"), ("q", 2, False, "y")]
    schema = "run string, o long, t boolean, v string"
    spark.createDataFrame(rows[:3], schema).coalesce(1).write.parquet(source)
    events = parquet_stream(spark, source, spark.createDataFrame([], schema).schema)
    for i in range(2):
        query = sticky_values(events, "run", "o", "t", "v").writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination()
        if i == 0:
            spark.createDataFrame(rows[3:], schema).coalesce(1).write.mode("append").parquet(source)
    got = {(r["run"], r["o"]): r["sticky"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = carry_forward(spark.createDataFrame(rows, schema), ["run"], [F.asc("o")], F.col("t"), F.col("v"), "sticky")
    assert got == {(r["run"], r["o"]): r["sticky"] for r in batch.collect()}


def test_windows(spark, small, tmp_path):
    table = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == table.count()


def test_an_epoch_run_again_reads_only_earlier_versions(spark, tmp_path):
    folder = str(tmp_path / "t")
    for version in range(4):
        write_snapshot(spark.createDataFrame([(version,)], "v int"), folder, version)
    assert latest_snapshot(spark, folder).first()["v"] == 3
    assert latest_snapshot(spark, folder, before=3).first()["v"] == 2
    assert drop_versions(spark, folder, keep=2) == 2
    assert latest_snapshot(spark, folder, before=2) is None
    assert latest_snapshot(spark, str(tmp_path / "none")) is None


def test_parked_work_is_taken_up_again(spark, tmp_path):
    """A row waits until a batch holds the key it refers to."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], "id long, needs long").schema
    waiting = []
    for batch in ([(1, None), (2, 5), (3, 9)], [(5, None)], [(9, 1), (10, None)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        ids = [r[0] for r in spark.read.parquet(source).collect()]
        parked_stream(parquet_stream(spark, source, schema), out, str(tmp_path / "cp"), lambda rows: F.col("needs").isNull() | F.col("needs").isin(ids)).awaitTermination()
        waiting.append(sorted(r["id"] for r in latest_snapshot(spark, f"{out}/parked").collect()))
    assert waiting == [[2, 3], [3], []]
    assert sorted(r["id"] for r in spark.read.parquet(f"{out}/done").collect()) == [1, 2, 3, 5, 9, 10]
