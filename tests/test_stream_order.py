"""Streaming queries over folders of more files than one micro-batch takes, whose times overlap."""

import pytest
from pyspark.sql import functions as F

from gatelane.catalog import all_queries, all_sql, streams
from gatelane.streaming import metrics as SM
from gatelane.streaming import runs
from tests.compare import compare

SF = "/root/testdata/sf0.001"
NAMES = ["streaming_token_rate", "streaming_reroute_rate", "streaming_p95", "streaming_p95_5m", "streaming_pairing",
         "streaming_unanswered", "streaming_load", "streaming_cache", "cache_replay"]


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("many")
    for name in ("events", "embeddings", "conversations"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        df.repartition(70, F.xxhash64(*[c for c in df.columns if c != "embedding"])).write.option("maxRecordsPerFile", 1 if name == "conversations" else 9).parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", NAMES)
def test_overlapping_files_lose_nothing(spark, many_files, monkeypatch, name):
    for module, rows in ((runs, 1 if name in ("streaming_pairing", "streaming_unanswered") else 14), (streams, 7)):
        monkeypatch.setattr(module, "ROWS_PER_FILE" if module is runs else "VECTORS_PER_FILE", rows, raising=False)
    got = all_queries()[name](spark, many_files)
    state, _, detail = compare(spark, SF, lambda *_: got, all_sql()[name])
    assert state == "ok", detail


def test_dropped_rows_fail_the_run(spark, tmp_path):
    for second in (100_000, 100_001, 50):
        one = spark.createDataFrame([(second, "k", 1.0)], "ts long, k string, x double")
        one.select(F.timestamp_seconds("ts").alias("ts"), "k", "x").coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
    late = spark.readStream.schema("ts timestamp, k string, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "late"))
    with pytest.raises(ValueError, match="behind the watermark"):
        runs.collect_updates(SM.pane_sums(late, "ts", ["k"], F.col("x"), 10, "1 minute"), ["pane", "k"], "late-test")
