"""Sources and sinks: tables are written in a file format and read back through its scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import pii_types
from ..operators import corpus, reports
from ..operators import evaluation as ev
from ..operators.similarity import centroids
from ..plans.evaluation import accuracy_matrix as matrix_of_files
from ..plans.evaluation import build_routing_table
from ..plans.evaluation import save as save_evaluation
from ..plans.metering import gateway_metrics
from ..plans.routing import route_requests
from ..session import scratch_path, spread
from ..settings import load_config, scores_table
from ..sources import readers, sinks
from .common import centroid_head, conversation_requests, document_requests, fixture_config, request_body, table
from .corpus import SQL as CORPUS_SQL
from .corpus import SQL_REPORT, _labelled, _predictions
from .evaluation import SQL as EVAL_SQL
from .evaluation import SQL_RESULTS, accuracies, evaluation_job_of, results
from .metering import SQL as METER_SQL
from .metering import SQL_BOUNDS, _paired
from .routing import CREATED, SQL_REQUESTS, SQL_ROUTED, route_documents, sql_pii_list
from .vectors import SQL as VECTOR_SQL

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def request_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies written as lines and scanned strictly."""
    reqs = conversation_requests(spark, sf_dir)
    path = scratch_path(spark, "requests")
    reqs.select(request_body(F.col("model"), F.col("messages"))).write.text(path)
    scanned = readers.read_requests(spark, path)
    return scanned.groupBy("ok", "model", F.size("messages").alias("n_messages")).agg(
        F.count("*").alias("n"), F.sum(F.length("user_content")).alias("user_chars")
    )


SQL["request_scan"] = f"""WITH {SQL_REQUESTS}
SELECT true AS ok, model, len(messages)::INT AS n_messages, count(*) AS n, sum(length(user_content))::BIGINT AS user_chars FROM split GROUP BY ALL"""


@query
def access_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log written as a proxy access log and scanned: requests and bytes by code."""
    ev_rows = table(spark, sf_dir, "events")
    code = F.when(F.col("event_type") == "error", "500").otherwise("200")
    values = {
        "time": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "protocol": F.lit("HTTP/1.1"), "request_method": F.lit("POST"),
        "request_path": F.concat(F.lit("/v1/"), "event_type"), "response_code": code, "response_flags": F.lit("-"),
        "bytes_received": F.length("props").cast("string"), "bytes_sent": F.floor("value").cast("string"),
        "duration": (F.col("user_id") * 3).cast("string"), "upstream_host": F.lit("h:1"), "upstream_cluster": F.lit("c"),
        "upstream_local_address": F.lit("l:1"), "request_id": F.col("event_id").cast("string"),
    }
    path = scratch_path(spark, "access-log")
    ev_rows.select(*[values[f].alias(f) for f in readers.ACCESS_LOG_FIELDS]).write.json(path)
    log = readers.read_access_log(spark, path)
    return log.groupBy("response_code", "request_path").agg(
        F.count("*").alias("n"), F.sum(F.col("bytes_sent").cast("bigint")).alias("bytes_sent"),
        F.sum(F.col("duration").cast("bigint")).alias("duration"), F.max("time").alias("last_time"),
    )


SQL["access_log_scan"] = """SELECT CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS response_code, '/v1/' || event_type AS request_path,
  count(*) AS n, sum(floor(value))::BIGINT AS bytes_sent, sum(user_id * 3)::BIGINT AS duration,
  strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_time FROM events GROUP BY ALL"""


@query
def span_corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written with entity spans, scanned, and labelled by their dominant type."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    spans = F.transform(pii_types(F.col("text")), lambda t: F.struct(t.alias("entity_type")))
    path = scratch_path(spark, "spans")
    docs.select(F.col("text").alias("full_text"), F.when(F.size(spans) > 0, spans).alias("spans")).write.json(path)
    rows = readers.read_span_corpus(spark, path, lines=True)
    return rows.groupBy(corpus.dominant_label(F.col("types")).alias("label")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


SQL["span_corpus_scan"] = f"""WITH t AS (SELECT text, list_sort({sql_pii_list('text')}) AS t FROM documents)
SELECT coalesce(t[1], 'NO_PII') AS label, count(*) AS n, sum(length(text))::BIGINT AS chars FROM t GROUP BY 1"""


@query
def prompt_corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt corpus in two parts, scanned as one."""
    rows = table(spark, sf_dir, "conversations").select(F.col("text").alias("prompt"), F.col("role").alias("type"), "turn")
    paths = [scratch_path(spark, "prompts-train"), scratch_path(spark, "prompts-test")]
    rows.filter("turn < 4").drop("turn").write.parquet(paths[0])
    rows.filter("turn >= 4").drop("turn").write.parquet(paths[1])
    union = readers.read_prompt_corpus(spark, *paths)
    return union.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


SQL["prompt_corpus_scan"] = "SELECT role AS label, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY role"


@query
def results_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detailed results written as CSV per model and approach, and read back."""
    path = scratch_path(spark, "results")
    sinks.save_results(results(spark, sf_dir).drop("display_name"), path)
    back = spark.read.option("header", True).csv(path)
    return back.groupBy("model", "approach").agg(
        F.count("*").alias("n"), F.count_if(F.col("is_correct") == "true").alias("n_correct"), F.count("predicted_answer").alias("n_predicted")
    )


SQL["results_sink"] = f"""WITH {SQL_RESULTS}
SELECT model, approach, count(*) AS n, count(*) FILTER (is_correct) AS n_correct, count(predicted_answer) AS n_predicted FROM results GROUP BY ALL"""


def _saved_analyses(spark: SparkSession, sf_dir: str) -> str:
    rows = results(spark, sf_dir)
    summary = ev.summarize(rows, "model", "approach")
    path = scratch_path(spark, "analysis")
    sinks.save_analyses(sinks.analyses(summary, ev.category_accuracy(rows, "model", "approach"), ["model", "approach"]), path)
    return path


@query
def routing_table_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing table built from stored analyses: folder names give model and approach."""
    ranked, _ = build_routing_table(spark, _saved_analyses(spark, sf_dir), "*.json")
    path = scratch_path(spark, "routing-table")
    sinks.save_routing_table(ranked, path)
    back = spark.read.parquet(path)
    return back.select("category", "pos", F.regexp_replace("model", "^org_", "org/").alias("model"), F.round("score", 6).alias("score"))


SQL["routing_table_from_files"] = EVAL_SQL["ranked_scores"].replace(
    "ORDER BY accuracy DESC, display_name", "ORDER BY accuracy DESC, replace(display_name, '/', '_')"
)


@query
def default_model_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default model from the same files, with the first underscore read as a slash."""
    _, best = build_routing_table(spark, _saved_analyses(spark, sf_dir), "*.json", faithful=True)
    return best.select("default_model", F.round("accuracy", 6).alias("accuracy"))


SQL["default_model_from_files"] = EVAL_SQL["default_model"].replace(
    "regexp_replace(display_name, ':(cot|direct)$', '') AS", "split_part(display_name, ':', 1) AS"
)


@query
def label_map_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label index written as maps in both directions and scanned again."""
    path = scratch_path(spark, "labels")
    sinks.save_label_maps(corpus.label_index(_labelled(spark, sf_dir), "label"), path)
    back = readers.read_label_map(spark, path, "source")
    return back.select("label", F.col("idx").alias("label_id"))


SQL["label_map_sink"] = CORPUS_SQL["label_index"]


@query
def report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report, confusion counts and accuracy written as one document; its report read back."""
    rows = _predictions(spark, sf_dir)
    counts = reports.confusion(rows, "truth", "predicted")
    path = scratch_path(spark, "report")
    sinks.save_report(reports.classification_report(counts), counts, reports.accuracy(rows, "truth", "predicted"), path)
    back = spark.read.json(path).select("accuracy", F.inline("classification_report"))
    return back.select("label", F.round("f1", 6).alias("f1"), "support", F.round("accuracy", 6).alias("accuracy"))


SQL["report_sink"] = f"""WITH {SQL_REPORT}
SELECT label, round(f1, 6) AS f1, support::BIGINT AS support, (SELECT round(avg((truth = predicted)::INT), 6) FROM p) AS accuracy FROM report"""


@query
def centroid_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids written and read back, one row per dimension."""
    path = scratch_path(spark, "centroids")
    sinks.save_centroids(centroids(table(spark, sf_dir, "embeddings"), "label", "embedding", "vec_id", 5), path)
    back = spark.read.parquet(path)
    return back.select("label", F.posexplode("centroid").alias("dim", "x")).select("label", "dim", F.round("x", 6).alias("mean"))


SQL["centroid_sink"] = VECTOR_SQL["label_centroids"]


@query
def audit_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt audit appended as text; lines counted by their kind."""
    items = table(spark, sf_dir, "benchmark").select(
        F.regexp_replace("text", "\n", " ").alias("prompt"), F.lit("A").alias("answer"), (F.col("item_id") % 3).cast("string").alias("category")
    )
    path = scratch_path(spark, "audit")
    sinks.append_audit(items, path)
    lines = spark.read.text(path).filter("value <> ''")
    return lines.groupBy(F.substring_index("value", ":", 1).alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars"))


SQL["audit_sink"] = """
SELECT 'Category' AS kind, count(*) AS n, sum(length('Category: ' || (item_id % 3)))::BIGINT AS chars FROM benchmark
UNION ALL SELECT 'Prompt', count(*), sum(length('Prompt: ' || text))::BIGINT FROM benchmark
UNION ALL SELECT 'Correct answer', count(*), sum(length('Correct answer: A'))::BIGINT FROM benchmark"""


@query
def rewritten_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewritten bodies of routed requests written out; their model and content read back."""
    routed = route_requests(
        document_requests(spark, sf_dir), fixture_config(), centroid_head(spark, sf_dir), category_input="embedding", created=F.lit(CREATED)
    )
    path = scratch_path(spark, "rewritten")
    sinks.save_rewritten(routed, path, "doc_id")
    back = spark.read.parquet(path)
    content = F.get_json_object("body", "$.messages[0].content")
    return back.select("doc_id", F.get_json_object("body", "$.model").alias("model"), F.md5(content).alias("content_md5"))


SQL["rewritten_sink"] = f"""WITH {SQL_ROUTED}
SELECT r.doc_id, r.served_model AS model, md5(d.text) AS content_md5 FROM routed r JOIN documents d USING (doc_id) WHERE r.outcome = 'routed'"""


@query
def metrics_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric snapshot with all its series written and read back; labels as text."""
    decided = route_documents(spark, sf_dir).withColumn("denied", F.filter(F.split("denied", " "), lambda t: t != ""))
    path = scratch_path(spark, "metrics")
    sinks.save_metrics(gateway_metrics(decided, _paired(spark, sf_dir), (F.col("doc_id") % 3000) / 1000), path)
    values = F.array_join(F.map_values("labels"), ">")
    return spark.read.parquet(path).select("name", values.alias("label_values"), F.round("value", 6).alias("value"))


SQL["metrics_sink"] = f"""WITH s AS ({METER_SQL["gateway_counter_snapshot"]}), b(i, le, x) AS (VALUES {SQL_BOUNDS.replace("'Infinity'", "'+Inf'")}),
h AS (SELECT name, CASE WHEN label_2 IS NOT NULL THEN label_1 || '>' ELSE '' END AS head, coalesce(label_2, label_1)::INT AS i, value FROM s WHERE name LIKE '%\\_bucket' ESCAPE '\\'),
k AS (SELECT DISTINCT name, head FROM h)
SELECT name, coalesce(label_1, '') || coalesce('>' || label_2, '') AS label_values, value FROM s WHERE name NOT LIKE '%\\_bucket' ESCAPE '\\'
UNION ALL SELECT k.name, k.head || le, coalesce(sum(value), 0) FROM k CROSS JOIN b LEFT JOIN h ON h.name = k.name AND h.head = k.head AND h.i <= b.i GROUP BY ALL"""


@query
def summary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of an evaluation written as files and read back with the name of their folder."""
    path = scratch_path(spark, "evaluation")
    save_evaluation(evaluation_job_of(spark, sf_dir), path)
    back = spark.read.json(f"{path}/summary")
    return back.select("dir", "approach", "total_questions", "successful_queries", "failed_queries", F.round("overall_accuracy", 6).alias("overall_accuracy"))


SQL["summary_files"] = f"""WITH {SQL_RESULTS}
SELECT replace(model, '/', '_') || '_' || approach AS dir, CASE approach WHEN 'cot' THEN 'Chain-of-Thought' ELSE 'Direct' END AS approach, count(*) AS total_questions,
  count(*) FILTER (success) AS successful_queries, count(*) FILTER (NOT success) AS failed_queries,
  round(coalesce(avg(is_correct::INT) FILTER (success), 0), 6) AS overall_accuracy FROM results GROUP BY ALL"""


@query
def matrix_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model by category matrix from stored analyses, with short display names."""
    wide = matrix_of_files(spark, _saved_analyses(spark, sf_dir), pattern="*.json")
    return wide.select("display_name", *[F.round(c, 6).alias(c) for c in wide.columns[1:]])


SQL["matrix_from_files"] = EVAL_SQL["accuracy_matrix"].replace("SELECT display_name, ", "SELECT replace(regexp_replace(display_name, ':direct$', ''), '/', '_') AS display_name, ", 1).replace("GROUP BY display_name", "GROUP BY ALL")


@query
def config_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Router configuration written to and read from the shared store: its routing table."""
    path = scratch_path(spark, "config")
    sinks.save_config(ev.ranked_scores(accuracies(spark, sf_dir)), "phi4", path)
    found = scores_table(spark, load_config(path, spark))
    return found.select("category", "pos", "model", F.round("score", 6).alias("score"))


SQL["config_scan"] = EVAL_SQL["ranked_scores"]


@query
def token_dump_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark items as a token dump, one file with its header, read back in file order."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("at", "word")).filter("trim(word) != ''")
    line = F.concat_ws("\t", F.length("word"), F.regexp_replace("word", "[^A-Za-z]", "?"))
    head = spark.range(readers.TOKEN_HEADER_LINES).select(F.lit(-1).cast("bigint").alias("item_id"), F.col("id").cast("int").alias("at"), F.lit("#").alias("value"))
    path = scratch_path(spark, "tokens")
    lines = head.unionByName(words.select("item_id", "at", line.alias("value")))
    # The format is one file.
    lines.coalesce(1).sortWithinPartitions("item_id", "at").select("value").write.text(path)
    return readers.read_token_dump(spark, path)


SQL["token_dump_scan"] = """
WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS spot FROM benchmark),
k AS (SELECT * FROM w WHERE trim(word) <> '')
SELECT row_number() OVER (ORDER BY item_id, spot) - 1 AS pos, length(word)::INT AS token_id, regexp_replace(word, '[^A-Za-z]', '?', 'g') AS token FROM k"""


@query
def question_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both question sets written as files and read back with their fixed schemas: options, labels and answers."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", F.split("text", " ").alias("w"))
    ten, four = scratch_path(spark, "questions"), scratch_path(spark, "choices")
    items.select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.slice("w", 1, 10).alias("options"),
        F.lit("A").alias("answer"), F.concat(F.lit("c"), F.col("item_id") % 5).alias("category"), F.lit(1).alias("unread"),
    ).write.parquet(ten)
    items.select(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"),
        F.struct(F.array(*[F.lit(x) for x in "ABCD"]).alias("label"), F.slice("w", 1, 4).alias("text")).alias("choices"), F.lit("B").alias("answerKey"),
    ).write.json(four)
    left = readers.read_mmlu_questions(spark, ten)
    right = readers.read_arc_questions(spark, four, "json").select(
        F.col("id").cast("bigint").alias("question_id"), F.array_join("choices.label", "").alias("labels"), F.array_join("choices.text", " ").alias("choices"), "answerKey"
    )
    return left.join(right, "question_id").select(
        "question_id", "category", "answer", F.array_join("options", " ").alias("options"), "labels", "choices", F.col("answerKey").alias("key")
    )


SQL["question_files"] = """
SELECT item_id AS question_id, 'c' || (item_id % 5) AS category, 'A' AS answer, array_to_string(string_split(text, ' ')[1:10], ' ') AS options,
  'ABCD' AS labels, array_to_string(string_split(text, ' ')[1:4], ' ') AS choices, 'B' AS key FROM benchmark"""
