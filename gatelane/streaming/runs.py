"""Running streams to a table: append sinks, update logs, and their snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILES_PER_TRIGGER = 64  # bounds a micro-batch, and with it what stateful tasks hold
ROWS_PER_FILE = 20_000  # of a table rewritten in time order
FIRST_MILLIS = 1_000_000_000_000  # modification time of the first file in that order
STATE_CONF = "spark.sql.streaming.stateStore.providerClass"


def table_stream(spark: SparkSession, path: str, name: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """A stream over one parquet table, stored as a file or as a folder of files, with the table's own schema."""
    table = f"{path}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(table).schema).option("maxFilesPerTrigger", files_per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(table)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(table)
    # A stream reads folders; of the file's folder only the file itself is taken.
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(path)


def ordered_stream(table: DataFrame, *order: str | Column, rows_per_file: int | None = None) -> DataFrame:
    """A stream over a whole table in the order of ``order``, whatever order its files have.

    The table is rewritten into the shared folder as files that follow each other in that order; a file
    source takes files by modification time, which is set to match. Ties should be broken by ``order``.
    """
    spark, rows_per_file = table.sparkSession, rows_per_file or ROWS_PER_FILE
    path = scratch_path(spark, "ordered")
    files = max(1, -(-table.count() // rows_per_file))
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    table.repartitionByRange(files, *columns).sortWithinPartitions(*columns).write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    named = [s.getPath() for s in system.listStatus(place) if s.getPath().getName().startswith("part-")]
    # part-<partition>-...: the partition is the place in the order.
    named.sort(key=lambda p: (int(p.getName().split("-")[1]), p.getName()))
    for i, file in enumerate(named):
        system.setTimes(file, FIRST_MILLIS + 1000 * i, -1)
    if named and system.getFileStatus(named[-1]).getModificationTime() != FIRST_MILLIS + 1000 * (len(named) - 1):
        raise ValueError("spark.checkpoint.dir is in a store that does not keep modification times; a stream needs them for its order")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", FILES_PER_TRIGGER).parquet(path)


def append_to(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append every finished row to a parquet table."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def log_updates(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write each batch of changed aggregates as its own partition of an update log.

    Rewriting the partition of a replayed batch makes the sink idempotent.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of every key of an update log."""
    log = spark.read.parquet(path)
    values = [c for c in log.columns if c not in (*keys, "batch_id")]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
    return newest.select(*keys, "_v.*")


def _finish(query: StreamingQuery, name: str) -> None:
    """Wait for the end; fail when rows were dropped as late, as the table is then not that of all rows."""
    late, over = {}, False
    while not over:
        over = query.awaitTermination(1)  # only the newest hundred reports are kept
        for progress in query.recentProgress:
            late[progress["batchId"]] = max(late.get(progress["batchId"], 0), late_rows_of(progress))
    if any(late.values()):
        raise ValueError(f"{name}: {sum(late.values())} rows came behind the watermark and were dropped")


def collect_append(df: DataFrame, name: str) -> DataFrame:
    """Run an append stream over what is available now and return the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _finish(append_to(df, path, path + "-checkpoint"), name)
    return spark.read.schema(df.schema).parquet(path)


def collect_updates(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run an update stream over what is available now and return the final versions."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _finish(log_updates(df, path, path + "-checkpoint"), name)
    return latest(spark, path, keys)


def late_rows_of(progress) -> int:
    """Rows that stateful operators dropped behind the watermark in one progress report."""
    operators = progress.get("stateOperators") if isinstance(progress, dict) else progress["stateOperators"]
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for op in operators)


def late_rows(query: StreamingQuery) -> int:
    """Rows that stateful operators dropped behind the watermark, over the kept progress reports."""
    return sum(late_rows_of(progress) for progress in query.recentProgress)
