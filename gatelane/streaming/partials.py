"""Order-free stream aggregates: every micro-batch adds partial rows, which are merged when read.

Sums, bucket counts and quantile sketches merge in any order, so the partials need no state in the stream, no watermark and
no order of the input files; a row that comes late is in a later partial of its pane. Each batch writes a
partition of its own and rewrites it when it is replayed.

Where late rows must not change what was told, ``log_split`` keeps them apart: rows behind the watermark, the highest
time of earlier batches less the delay, go to a table with their lateness.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import bucket_index
from ..session import scratch_path

Reduce = Callable[[DataFrame], DataFrame]
SKETCH_K = 400  # KLL parameter: normalised rank error about 0.8 %


def pane(ts: str | Column, slide: int) -> Column:
    """Start of the pane of ``slide`` seconds that a time lies in, in seconds."""
    at = F.unix_seconds((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))
    return (F.floor(at / slide) * slide).cast("bigint")


def sum_panes(ts: str, keys: list[str], value: Column, slide: int) -> Reduce:
    return lambda rows: rows.groupBy(pane(ts, slide).alias("pane"), *keys).agg(F.sum(value).alias("value"))


def bucket_panes(ts: str, keys: list[str], latency: Column, slide: int) -> Reduce:
    """Latency bucket counts per pane and key, what a windowed quantile needs."""
    return lambda rows: rows.groupBy(pane(ts, slide).alias("pane"), *keys, bucket_index(latency).alias("bucket")).agg(F.count("*").alias("n"))


def sketch_panes(ts: str, keys: list[str], value: Column, slide: int, k: int = SKETCH_K) -> Reduce:
    """A mergeable quantile sketch per pane and key; null values are not in it."""
    return lambda rows: rows.groupBy(pane(ts, slide).alias("pane"), *keys).agg(F.kll_sketch_agg_double(value.cast("double"), k).alias("sketch"), F.count(value).alias("n"))


def merge_sums(partials: DataFrame, keys: list[str], value: str) -> DataFrame:
    return partials.groupBy(*keys).agg(F.sum(value).alias(value))


def merge_sketches(partials: DataFrame, keys: list[str | Column], k: int = SKETCH_K) -> DataFrame:
    """One sketch per key, of any coarser keys than the panes'."""
    return partials.filter("n > 0").groupBy(*keys).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n"))


def quantile(sketch: str | Column, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))


def save_part(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write the partition of a batch, over an earlier try."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_log(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """All partitions of a batch log; none is an empty table."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    return spark.read.schema(T.StructType([*like.schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path)


def start(stream: DataFrame, save, checkpoint: str, available_now: bool) -> StreamingQuery:
    """Run ``save(batch, batch_id)`` on every micro-batch."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def log_partials(stream: DataFrame, reduce: Reduce, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write what ``reduce`` makes of each batch as a partition of ``path``."""
    return start(stream, lambda batch, batch_id: save_part(reduce(batch), path, batch_id), checkpoint, available_now)


def log_split(stream: DataFrame, ts: str, delay: float, reduce: Reduce, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """``log_partials`` of the rows in time to ``path/panes``; late rows with ``lateness`` in seconds to ``path/late``.

    A row exactly at the watermark is in time, and so are rows without a time.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
        highest = batch.agg(F.max(at).alias("high"))
        earlier = read_log(spark, f"{path}/marks", highest).filter(F.col("batch_id") < batch_id).agg(F.max("high")).first()[0]
        behind = F.lit(False) if earlier is None else F.coalesce(at < earlier - delay, F.lit(False))
        late = batch.filter(behind).withColumn("lateness", F.lit(0.0 if earlier is None else earlier - delay) - at)
        save_part(reduce(batch.filter(~behind)), f"{path}/panes", batch_id)
        save_part(late, f"{path}/late", batch_id)
        save_part(highest, f"{path}/marks", batch_id)

    return start(stream, save, checkpoint, available_now)


def collect_partials(stream: DataFrame, reduce: Reduce, name: str) -> DataFrame:
    """Run over what is available now; all partial rows, one or more per pane and key."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, name)
    log_partials(stream, reduce, path, path + "-checkpoint").awaitTermination()
    return read_log(spark, path, reduce(spark.createDataFrame([], stream.schema))).drop("batch_id")


def collect_split(stream: DataFrame, ts: str, delay: float, reduce: Reduce, name: str) -> tuple[DataFrame, DataFrame]:
    """Run over what is available now: partial rows of the rows in time, and the late rows with their lateness."""
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, name)
    log_split(stream, ts, delay, reduce, path, path + "-checkpoint").awaitTermination()
    none = spark.createDataFrame([], stream.schema)
    late = none.withColumn("lateness", F.lit(0.0))
    return read_log(spark, f"{path}/panes", reduce(none)).drop("batch_id"), read_log(spark, f"{path}/late", late).drop("batch_id")
