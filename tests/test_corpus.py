import json

import pytest
from pyspark.sql import functions as F

from gatelane.functions import texts
from gatelane.functions import vectors as V
from gatelane.operators import corpus, metrics
from gatelane.operators.scorers import TextVectors
from gatelane.plans import metering, training
from gatelane.settings import CATEGORY_LABELS, load_label_file
from gatelane.sources import readers, sinks
from gatelane.streaming import metrics as SM
from gatelane.streaming import runs


def test_dominant_label(spark):
    df = spark.createDataFrame([(["B", "A", "B"],), (["B", "A"],), ([],)], "t array<string>")
    assert [r.x for r in df.select(corpus.dominant_label(F.col("t")).alias("x")).collect()] == ["B", "A", "NO_PII"]


def test_split_shares_and_partitions(spark):
    df = spark.range(3000).withColumn("label", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "rare").otherwise("cold"))
    one = corpus.split(df.repartition(1), "id", "label", digits=2).select("id", "label", "split")
    many = corpus.split(df.repartition(8), "id", "label", digits=1).select("id", "label", "split")
    assert sorted(one.collect()) == sorted(many.collect())
    counts = {(r.label, r.split): r.n for r in one.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert (counts["hot", "train"], counts["hot", "validation"], counts["hot", "test"]) == (700, 150, 150)
    with pytest.raises(ValueError):
        corpus.split(df, "id", "label", (0.5, 0.2, 0.2))


def test_missing_labels_are_a_stratum(spark):
    df = spark.range(200).withColumn("label", F.when(F.col("id") % 2 == 0, "a"))
    rows = corpus.split(df, "id", "label").groupBy("label", "split").agg(F.count("*").alias("n")).collect()
    assert {(r.label, r.split): r.n for r in rows}[None, "train"] == 70 and sum(r.n for r in rows) == 200


def test_tiny_labels_survive_the_split(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "id long, label string")
    rows = corpus.split(df, "id", "label").collect()
    assert len(rows) == 3 and {r.split for r in rows if r.label == "x"} == {"test"}


def test_prepare_drops_rare(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)] + [(99, "c"), (98, "c")], "id long, label string")
    prepared = training.prepare_corpus(df, "id")
    assert prepared.rows.count() == 20 and [(r.label, r.label_id) for r in prepared.labels.orderBy("label").collect()] == [("a", 0), ("b", 1)]
    assert training.prepare_corpus(df, "id", stratify=False).rows.count() == 20


@pytest.mark.parametrize("text,labels", [
    ("Mail john.doe@email.com now", [0, 1, 0]), ("Call 123-456-7890 or (555) 123-4567", [0, 1, 0, 0, 0]),
    ("SSN 123-45-6789", [0, 1]), ("Hi I'm Emily Davis here", [1, 1, 1, 1, 0]), ("The capital of France", [0, 0, 0, 0]),
    ("   two words ", [0, 0]), ("", []), ("A Lisa", [0, 1]),
])
def test_word_labels(spark, text, labels):
    row = spark.createDataFrame([(text,)], "t string").select(texts.word_pii_labels(F.col("t")).alias("l")).first()
    assert row.l == labels


def test_padding(spark):
    df = spark.createDataFrame([([1, 0, 1], [1, 1, 0])], "l array<int>, a array<int>")
    row = df.select(
        texts.pad_labels(F.col("l"), 5).alias("p"), texts.pad_labels(F.col("l"), 2).alias("c"), texts.mask_labels(F.col("l"), F.col("a")).alias("m"),
    ).first()
    assert (row.p, row.c, row.m) == ([1, 0, 1, 0, 0], [1, 0], [1, 0, -100])


def test_word_windows(spark):
    df = spark.createDataFrame([("a b  c d\ne",), ("",)], "t string")
    assert [r.w for r in df.select(texts.word_windows(F.col("t"), 2).alias("w")).collect()] == [["a b", "c d", "e"], [""]]


def test_generator(spark):
    none = corpus.generate_corpus(spark.range(300), "id", probability=0.0)
    assert none.filter("has_pii").count() == 0
    assert none.filter(F.exists("pii_labels", lambda x: x == 1)).count() == 0
    every = corpus.generate_corpus(spark.range(300), "id", probability=1.0)
    assert every.filter("has_pii").count() == 300 and every.select("category").distinct().count() == 10
    assert every.filter(F.size("pii_labels") != F.size(texts.words(F.col("text")))).count() == 0
    again = corpus.generate_corpus(spark.range(300).repartition(7), "id", probability=1.0)
    assert sorted(every.collect()) == sorted(again.collect())


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0, 9.0], [[1.0, 2.0], [3.0, 6.0]]), ([0.0, 0.0], [1.0], [])], "a array<double>, b array<double>, t array<array<double>>")
    rows = df.select(
        V.l2_normalize(F.col("a")).alias("u"), V.dot(F.col("a"), F.col("b")).alias("d"), V.cosine(F.col("a"), F.col("a")).alias("c"),
        V.mean_pool(F.col("t")).alias("m"),
    ).collect()
    assert rows[0].u == [0.6, 0.8] and rows[0].d == 3.0 and rows[0].c == pytest.approx(1.0) and rows[0].m == [2.0, 4.0]
    assert rows[1].u is None and rows[1].c is None and rows[1].m is None


def test_corpora_and_label_files(spark, tmp_path):
    spans = [{"full_text": "a", "spans": [{"entity_type": "AGE", "x": 1}]}, {"full_text": "b"}]
    (tmp_path / "spans.json").write_text(json.dumps(spans))
    rows = readers.read_span_corpus(spark, str(tmp_path / "spans.json")).collect()
    assert [(r.text, r.types) for r in rows] == [("a", ["AGE"]), ("b", [])]
    good = {"category_to_idx": {c: i for i, c in enumerate(CATEGORY_LABELS)}, "idx_to_category": {str(i): c for i, c in enumerate(CATEGORY_LABELS)}}
    path = tmp_path / "map.json"
    path.write_text(json.dumps(good))
    assert readers.read_label_map(spark, str(path), "category").count() == 14
    assert load_label_file(str(path))[9] == (9, "math")
    good["idx_to_category"]["0"] = "other name"
    path.write_text(json.dumps(good))
    with pytest.raises(ValueError):
        readers.read_label_map(spark, str(path), "category")
    with pytest.raises(ValueError):
        load_label_file(str(path))


def test_access_log_stream(spark, tmp_path):
    row = {f: "x" for f in readers.ACCESS_LOG_FIELDS}
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text(json.dumps(row) + "\n" + json.dumps({**row, "more": 1}) + "\n")
    out = runs.collect_append(readers.read_access_log(spark, str(tmp_path / "log"), stream=True), "log")
    assert out.count() == 2 and out.columns == readers.ACCESS_LOG_FIELDS


def test_histogram_quantile(spark):
    df = spark.createDataFrame([("a", x) for x in (0.005, 0.3, 0.4, 7.0)] + [("b", 50.0)], "k string, x double")
    hist = metrics.histogram(df, ["k"], F.col("x"))
    counts = [r.bucket_count for r in hist.filter("k = 'a'").orderBy("le_idx").collect()]
    assert counts == [1, 1, 1, 1, 1, 1, 3, 3, 3, 3, 4, 4]
    q = {r.k: r.quantile for r in metrics.histogram_quantile(hist, ["k"], 0.5).collect()}
    assert q["a"] == pytest.approx(0.25 + 0.25 * (2 - 1) / 2) and q["b"] == 10.0


def test_pairing_without_ids(spark):
    requests = spark.createDataFrame([("r1", "m", 1.0), (None, "m", 1.0), ("", "m", 1.0), ("r2", "", 1.0)], "rid string, served_model string, q_ts double")
    body = '{"usage":{"prompt_tokens":2,"completion_tokens":3}}'
    responses = spark.createDataFrame([("r1", 3.0, body), ("", 3.0, body), ("r2", 3.0, body)], "rid string, r_ts double, body string")
    served = metering.serve(requests, responses, "rid", "q_ts", "r_ts", "body")
    assert served.count() == 4 and served.filter("answered").count() == 2
    totals = metrics.counters(metrics.response_increments(served.filter("answered"), "served_model", F.col("prompt_tokens"), F.col("completion_tokens"), F.col("latency")))
    snap = {(r.name, tuple(sorted(r.labels.items()))): r.value for r in metrics.snapshot(totals).collect()}
    assert snap["llm_model_tokens_total", (("model", "m"),)] == 5.0  # the row without a model is skipped
    assert snap["llm_model_completion_latency_seconds_bucket", (("le", "2.5"), ("model", "m"))] == 1.0
    assert snap["llm_model_completion_latency_seconds_bucket", (("le", "1.0"), ("model", "m"))] == 0.0


def test_stream_pairing_keeps_unanswered(spark, tmp_path):
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    q = spark.range(6).select(F.concat(F.lit("r"), "id").alias("rid"), at(F.col("id") * 3600).alias("q_ts"))
    r = q.filter("rid <> 'r1'").select("rid", (F.col("q_ts") + F.expr("interval 5 seconds")).alias("r_ts"))
    q.coalesce(1).write.parquet(str(tmp_path / "q"))
    r.coalesce(1).write.parquet(str(tmp_path / "r"))
    qs = spark.readStream.schema(q.schema).parquet(str(tmp_path / "q"))
    rs = spark.readStream.schema(r.schema).parquet(str(tmp_path / "r"))
    rows = {x.rid: x.no_response for x in runs.collect_append(SM.pair_stream(qs, rs, "rid", "q_ts", "r_ts"), "pairs").collect()}
    assert rows["r1"] is True and not any(rows[f"r{i}"] for i in (0, 2, 3, 4, 5))


def test_word2vec_embedder(spark):
    df = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} common") for i in range(30)], "id int, text string")
    rows = TextVectors("word2vec", 8).fit(df, "text").embed(df, "text", "v").collect()
    assert all(abs(sum(x * x for x in r.v) - 1) < 1e-6 for r in rows)


def test_train_and_report(spark, tmp_path):
    df = spark.createDataFrame([(i, f"{'sun' if i % 2 else 'rain'} day {i % 7}", "ab"[i % 2]) for i in range(80)], "id long, text string, label string")
    prepared = training.prepare_corpus(df, "id")
    model = training.train(prepared.rows.filter("split = 'train'"), text="text", features=64, iterations=10)
    named = training.named_predictions(training.predict(model, prepared.rows.filter("split = 'test'")), prepared.labels)
    counts, report = training.report(named)
    assert {r.label: r.f1 for r in report.collect()}["weighted avg"] == 1.0
    path = str(tmp_path / "model")
    model.write().save(path)
    again = training.PipelineModel.load(path)
    assert training.predict(again, prepared.rows).count() == 80
    sinks.save_report(report, counts, named.agg(F.count("*").alias("n")), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def test_missing_labels_are_a_label(spark):
    from gatelane.operators import corpus as C
    from gatelane.plans.training import prepare_corpus

    df = spark.range(43).select("id", F.when(F.col("id") < 20, "a").when(F.col("id") < 23, None).otherwise("b").alias("label"))
    assert C.drop_rare(df, "label", 5).count() == 40
    half = spark.range(40).select("id", F.when(F.col("id") % 2 == 0, "a").alias("label"))
    done = prepare_corpus(half, "id", min_rows=5)
    assert done.rows.count() == 40 and done.labels.count() == 2
