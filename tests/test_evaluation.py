import json

import pytest
from pyspark.sql import functions as F

from gatelane.functions import texts
from gatelane.operators import evaluation as ev
from gatelane.operators import reports
from gatelane.plans import evaluation as plan
from gatelane.settings import load_config
from gatelane.sources import readers, sinks


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_answers(spark):
    # In the second reply the pattern backs off and takes the letter I of "is".
    replies = ["Answer: c", "the ANSWER is: (d) no, B", "answerE", "I choose b.", "xyz", "", "Answer is\nJ", "so the end is k", "1) A\n2) H\n"]
    assert column(spark, replies, texts.answer_letter) == ["C", "I", "E", "B", None, None, "J", "I", "H"]
    four = ["Answer: b then c", "answer\\s is c d", "only e f", "d"]
    assert column(spark, four, texts.answer_letter_four) == ["B", "D", None, "D"]
    assert column(spark, ["Answer: b then c"], lambda c: texts.answer_letter_four(c, True)) == ["C"]


def test_prompts(spark):
    questions = spark.createDataFrame([(1, "Q?", ["x", "N/A", "y"], "A", "c")], readers.MMLU_SCHEMA)
    prompt = plan.prompts(questions, True).first().prompt
    assert prompt.startswith("Question: Q?\n\nOptions:\nA) x\nC) y\n\n\nPlease solve")
    arc = spark.createDataFrame([("1", "Q?", (["A", "B"], ["x", "y"]), "A")], readers.ARC_SCHEMA)
    assert "Options:\nA) x\nB) y\n\n\nPlease choose" in plan.prompts(arc, four_choice=True).first().prompt


def test_too_many_options(spark):
    questions = spark.createDataFrame([(1, "Q?", [str(i) for i in range(11)], "A", "c")], readers.MMLU_SCHEMA)
    with pytest.raises(Exception, match="at most 10"):
        plan.prompts(questions).collect()


def test_names(spark):
    assert column(spark, ["org_model_x_cot", "phi4_direct"], texts.dir_model) == ["org/model_x", "phi4"]
    assert column(spark, ["a:direct", "a:cot", "b:direct:x"], texts.short_display) == ["a", "a:cot", "b:direct:x"]
    assert column(spark, ["gemma3:27b:cot"], texts.base_model) == ["gemma3:27b"]
    assert column(spark, ["gemma3:27b:cot"], lambda c: texts.base_model(c, True)) == ["gemma3"]


QUESTIONS = [(i, f"q{i}", ["a", "b"], "AB"[i % 2], f"c{i % 3}") for i in range(12)]


def replies(spark, good):
    rows = []
    for model in good:
        for i, _, _, answer, _ in QUESTIONS:
            right = good[model](i)
            rows.append((model, "cot", i, f"Answer: {answer if right else 'J'}", 0.5, True))
    rows.append(("down", "direct", 0, "ERROR", 1.0, False))
    return spark.createDataFrame(rows, "model string, approach string, question_id long, response string, response_time double, success boolean")


def test_evaluate_save_and_rank(spark, tmp_path):
    questions = spark.createDataFrame(QUESTIONS, readers.MMLU_SCHEMA)
    done = plan.evaluate(questions, replies(spark, {"org_big:1": lambda i: i % 3 != 0, "small": lambda i: i % 3 == 0, "auto": lambda i: True}))
    summary = {r.model: r for r in done.summary.collect()}
    assert summary["org_big:1"].overall_accuracy == pytest.approx(8 / 12)
    assert (summary["down"].overall_accuracy, summary["down"].avg_response_time, summary["down"].failed_queries) == (0.0, 0.0, 1)
    plan.save(done, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/results")).count() == 37
    ranked, best = plan.build_routing_table(spark, str(tmp_path / "out/analysis"), "*.json")
    rows = {(r.category, r.pos): r.model for r in ranked.collect()}
    assert rows == {("c0", 0): "small", ("c0", 1): "org_big:1", ("c1", 0): "org_big:1", ("c1", 1): "small", ("c2", 0): "org_big:1", ("c2", 1): "small"}
    assert best.first().default_model == "org_big:1"
    path = str(tmp_path / "config/config.yaml")
    sinks.export_config(ranked, best.first().default_model, path)
    config = load_config(path)
    assert config.default_model == "org_big:1" and config.categories[0].scores[0] == ("small", 1.0)

    analysis = sinks.analyses(done.summary, done.accuracies, ["model", "approach"])
    sinks.export_analyses(analysis.filter("model <> 'down'"), str(tmp_path / "files"))
    body = json.loads((tmp_path / "files/small_cot/analysis.json").read_text())
    assert body["category_accuracy"] == {"c0": 1.0, "c1": 0.0, "c2": 0.0}
    matrix = plan.accuracy_matrix(spark, str(tmp_path / "files"), ["c2", "c0", "c1"])
    assert matrix.columns == ["display_name", "c0", "c1", "c2", "Overall"]
    assert [r.display_name for r in matrix.collect()] == ["auto:cot", "org_big:1:cot", "small:cot"]


def test_sampling(spark):
    df = spark.range(1000).withColumn("c", F.when(F.col("id") < 900, "hot").when(F.col("id") < 997, "b").otherwise("few"))
    one, eight = [sorted(r.id for r in ev.sample_per_group(df.repartition(n), "c", "id", 5).collect()) for n in (1, 8)]
    assert one == eight and len(one) == 13
    assert len(ev.sample_overall(df, "id", 50).collect()) == 50 and ev.sample_overall(df, "id", 5000).count() == 1000


@pytest.mark.parametrize("n", [10, 999, 1000, 1001, 2500])
def test_samples_with_null_and_repeated_ids(spark, n):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 700).alias("ident"), (F.col("id") % 5).alias("x"),
        F.when(F.col("id") < 2800, "hot").alias("c"),
    )
    assert ev.sample_overall(df, "ident", n).count() == n
    per = {r.c: r["count"] for r in ev.sample_per_group(df, "c", "ident", n).groupBy("c").count().collect()}
    assert per == {"hot": min(n, 2800), None: min(n, 200)}
    one, two = [sorted(map(tuple, ev.sample_overall(df.repartition(k), "ident", n).collect()), key=repr) for k in (1, 7)]
    assert one == two


def test_unlisted_and_missing_labels_stay(spark):
    acc = spark.createDataFrame([("m", "x", 1.0), ("m", "y", 0.0), ("m", None, 0.5)], "display_name string, category string, accuracy double")
    row = ev.accuracy_matrix(acc, ["x", "z"]).first().asDict()
    assert row == {"display_name": "m", "null": 0.5, "x": 1.0, "y": 0.0, "z": 0.0, "Overall": 0.5}
    pairs = spark.createDataFrame([("a", "a"), ("a", "z"), ("z", "b"), ("z", "z"), (None, "a"), ("a", None)], "t string, p string")
    matrix = reports.confusion_matrix(reports.confusion(pairs, "t", "p"), ["a", "b"])
    assert matrix.columns == ["truth", "a", "b", "z", "null"]
    assert [tuple(r) for r in matrix.collect()] == [("a", 1, 0, 1, 1), ("b", 0, 0, 0, 0), ("z", 0, 1, 1, 0), (None, 1, 0, 0, 0)]


def test_unknown_categories(spark):
    questions = spark.createDataFrame(QUESTIONS, readers.MMLU_SCHEMA)
    with pytest.raises(ValueError, match="c0, c1, c2"):
        ev.filter_categories(questions, ["nope"])
    assert ev.filter_categories(questions, None).count() == 12


def test_report(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")] + [("b", "d")]
    df = spark.createDataFrame(pairs, "t string, p string")
    counts = reports.confusion(df, "t", "p")
    rows = {r.label: r for r in reports.classification_report(counts).collect()}
    assert rows["a"].precision == pytest.approx(0.75) and rows["a"].recall == pytest.approx(0.75)
    assert (rows["c"].precision, rows["c"].f1, rows["d"].recall, rows["d"].support) == (0.0, 0.0, 0.0, 0)
    assert rows["accuracy"].f1 == pytest.approx(5 / 8) and rows["weighted avg"].support == 8
    matrix = [tuple(r) for r in reports.confusion_matrix(counts, ["d", "b", "a", "c"]).collect()]
    assert matrix == [("a", 3, 1, 0, 0), ("b", 0, 2, 0, 1), ("c", 1, 0, 0, 0), ("d", 0, 0, 0, 0)]
    assert reports.accuracy(df.filter("t = 'x'"), "t", "p").first().accuracy == 0.0
    assert reports.classification_report(counts.filter("n < 0")).count() == 0


def test_token_match(spark):
    df = spark.createDataFrame([("a b c d".split(), "a x c".split()), ([], ["a"])], "l array<string>, r array<string>")
    rows = [r.m for r in df.select(reports.token_match(F.col("l"), F.col("r")).alias("m")).collect()]
    assert (rows[0].compared, rows[0].matches, [tuple(x) for x in rows[0].mismatches]) == (3, 2, [(1, "b", "x")])
    assert (rows[1].compared, rows[1].match_pct) == (0, 0.0)


def test_token_dump(spark, tmp_path):
    lines = ["title", "a\tb", "id\ttoken", "----"] + [f"{i}\tt{i}" for i in range(50)] + ["", "x\ty\tz", "50\tlast"]
    (tmp_path / "tokens.tsv").write_text("\n".join(lines) + "\n")
    dump = readers.read_token_dump(spark, str(tmp_path / "tokens.tsv"))
    rows = [tuple(r) for r in dump.orderBy("pos").collect()]
    assert rows == [*[(i, i, f"t{i}") for i in range(50)], (50, 50, "last")]
    other = dump.withColumn("token", F.when(F.col("pos") % 10 == 3, "z").otherwise(F.col("token")))
    assert tuple(reports.token_match_rows(dump, other).first())[:2] == (51, 46)
    assert [r.pos for r in reports.first_mismatches(dump, other, 3).collect()] == [3, 13, 23]
