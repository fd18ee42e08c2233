"""Dense label indices and label maps of small and large vocabularies."""

import pytest
from pyspark.sql import functions as F

from gatelane.operators import corpus, prefix
from gatelane.sources import readers, sinks


@pytest.mark.parametrize("few", [0, 10_000])
def test_small_and_large_vocabularies_agree(spark, monkeypatch, few):
    monkeypatch.setattr(corpus, "FEW_LABELS", few)
    labels = ["b", "a", None, "\u00e9", "Z", "a", "zz", "\uff5e", "\U0001f600", ""]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    want = [None, "", "Z", "a", "b", "zz", "\u00e9", "\uff5e", "\U0001f600"]
    assert {(r.label, r.label_id) for r in corpus.label_index(df, "label").collect()} == {(x, i) for i, x in enumerate(want)}
    assert corpus.label_index(df.limit(0), "label").count() == 0
    numbers = spark.range(500).select((F.col("id") * 5 % 301 - 50).alias("label"))
    assert {(r.label, r.label_id) for r in corpus.label_index(numbers, "label").collect()} == {(i - 50, i) for i in range(301)}


def test_positions_of_repeated_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"))
    got = prefix.sorted_positions(df, "k").collect()
    assert sorted(r.position for r in got) == list(range(1000)) and [r.k for r in sorted(got, key=lambda r: r.position)] == sorted(i % 3 for i in range(1000))


def test_label_maps_in_parts(spark, tmp_path):
    index = corpus.label_index(spark.range(25).select(F.concat(F.lit("l"), "id").alias("label")), "label")
    for most, name in ((7, "parts"), (100, "whole")):
        sinks.save_label_maps(index, str(tmp_path / name), most=most)
        back = readers.read_label_map(spark, str(tmp_path / name), "type")
        assert {(r.label, r.idx) for r in back.collect()} == {(r.label, r.label_id) for r in index.collect()}
    assert sinks.label_maps(index, most=7).count() == 4 and sinks.label_maps(index).count() == 1
