"""Partial rows of micro-batches, late rows, and the end of a stream of pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelane.streaming import metrics as SM
from gatelane.streaming import partials, runs

SCHEMA = "ts timestamp, k string, x double"


def arriving(spark, path, *batches):
    """A stream that takes the batches one by one."""
    for i, rows in enumerate(batches):
        one = spark.createDataFrame(rows, "ts long, k string, x double")
        one.select(F.timestamp_seconds("ts").alias("ts"), "k", "x").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


BATCHES = [(1000, "a", 1.0), (100_000, "a", 2.0)], [(50, "a", 4.0), (99_990, None, 8.0), (None, "a", 16.0)], [(1001, "b", 32.0), (99_940, "b", 64.0), (99_939, "b", 128.0)]


def test_sums_do_not_depend_on_the_order(spark, tmp_path):
    want = {(1000, "a"): 1.0, (100_000, "a"): 2.0, (50, "a"): 4.0, (99_990, None): 8.0, (None, "a"): 16.0, (1000, "b"): 32.0, (99_940, "b"): 64.0, (99_930, "b"): 128.0}
    for name, batches in (("one", BATCHES), ("two", BATCHES[::-1])):
        stream = arriving(spark, str(tmp_path / name), *batches)
        done = partials.collect_partials(stream, partials.sum_panes("ts", ["k"], F.col("x"), 10), "test-sums")
        assert {(r.pane, r.k): r.value for r in partials.merge_sums(done, ["pane", "k"], "value").collect()} == want


def test_late_rows_are_kept_apart(spark, tmp_path):
    stream = arriving(spark, str(tmp_path / "late"), *BATCHES)
    done, late = partials.collect_split(stream, "ts", 60, partials.sum_panes("ts", ["k"], F.col("x"), 10), "test-late")
    # The first batch sets the watermark to 99 940; a row at it is in time, and so is one without a time.
    assert sorted((r.x, r.lateness) for r in late.collect()) == [(4.0, 99_890.0), (32.0, 98_939.0), (128.0, 1.0)]
    assert sorted(r.value for r in done.collect()) == [1.0, 2.0, 8.0, 16.0, 64.0]


def test_an_empty_stream_has_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "none"))
    assert partials.collect_partials(stream, partials.sum_panes("ts", ["k"], F.col("x"), 10), "test-none").count() == 0
    assert [df.count() for df in partials.collect_split(stream, "ts", 60, partials.sum_panes("ts", ["k"], F.col("x"), 10), "test-nothing")] == [0, 0]


def test_sketches_merge_to_small_rank_errors(spark, tmp_path):
    values = np.random.default_rng(3).lognormal(size=12_000)
    batches = [[(int(i) * 10, "a" if i % 3 else "b", float(x)) for i, x in enumerate(values)][part::4] for part in range(4)]
    stream = arriving(spark, str(tmp_path / "sketch"), *batches, [(5, "a", None), (7, "c", None)])
    done = partials.collect_partials(stream, partials.sketch_panes("ts", ["k"], F.col("x"), 3600), "test-sketch")
    merged = partials.merge_sketches(done, ["k"]).select("k", "n", *[partials.quantile("sketch", q).alias(f"q{int(q * 100)}") for q in (0.05, 0.5, 0.95)]).collect()
    assert sorted((r.k, r.n) for r in merged) == [("a", 8000), ("b", 4000)]
    for r in merged:
        own = np.array([x for i, x in enumerate(values) if (i % 3 != 0) == (r.k == "a")])
        for q in (5, 50, 95):
            assert abs((own <= r[f"q{q}"]).mean() - q / 100) < 0.02


def test_the_last_requests_are_told(spark, tmp_path):
    kind = "request_id string, at long"
    asked = spark.createDataFrame([("a", 0), ("b", 100), ("c", 5000), ("d", 5001), ("", 5002), (None, 5003)], kind)
    answered = spark.createDataFrame([("a", 10), ("c", 5010)], kind)
    sides = {}
    for name, df, ts in (("q", asked, "request_ts"), ("r", answered, "response_ts")):
        df.select("request_id", F.timestamp_seconds(F.col("at") + 1000).alias(ts)).coalesce(1).write.parquet(str(tmp_path / name))
        sides[name] = spark.read.parquet(str(tmp_path / name)), spark.readStream.schema(f"request_id string, {ts} timestamp").parquet(str(tmp_path / name))
    told = runs.collect_append(SM.pair_stream(sides["q"][1], sides["r"][1], "request_id", "request_ts", "response_ts", "1 minute", "1 minute"), "test-told")
    rest = SM.withheld(sides["q"][0], sides["r"][0], told, "request_id", "request_ts", "response_ts", "1 minute")
    before, after = ({r.request_id: r.no_response for r in df.collect()} for df in (told, rest))
    assert before.get("a") is False and "d" not in before and after["d"] is True
    assert before | after == {"a": False, "b": True, "c": False, "d": True} and not before.keys() & after.keys()
