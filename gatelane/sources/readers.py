"""Scans: requests, logs, label maps, benchmark questions, results and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..operators.prefix import running_totals
from ..plans.routing import parse_requests

# --- Fixed values: field names of the files ------------------------------------
ACCESS_LOG_FIELDS = [
    "time", "protocol", "request_method", "request_path", "response_code", "response_flags", "bytes_received",
    "bytes_sent", "duration", "upstream_host", "upstream_cluster", "upstream_local_address", "request_id",
]
ANALYSIS_SCHEMA = (
    "overall_accuracy double, category_accuracy map<string,double>, avg_response_time double, "
    "total_questions bigint, successful_queries bigint, failed_queries bigint"
)
MMLU_SCHEMA = "question_id bigint, question string, options array<string>, answer string, category string"
ARC_SCHEMA = "id string, question string, choices struct<label:array<string>,text:array<string>>, answerKey string"
SPAN_SCHEMA = "full_text string, spans array<struct<entity_type:string>>"
PROMPT_SCHEMA = "prompt string, type string"
TOKEN_HEADER_LINES = 4
# --------------------------------------------------------------------------------
ACCESS_LOG_SCHEMA = ", ".join(f"`{f}` string" for f in ACCESS_LOG_FIELDS)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request bodies, one JSON document per line, parsed strictly."""
    return parse_requests(spark.read.text(path).withColumnRenamed("value", "body"))


def read_access_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Proxy access log: JSON lines, all fields as text."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(ACCESS_LOG_SCHEMA).json(path)


def is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def read_label_map(spark: SparkSession, path: str, head: str) -> DataFrame:
    """``(head, idx, label)`` from a label-map file or a folder of them; the two directions must agree.

    A single file may be spread over lines; files in a folder hold one object per line. The comparison runs when this is called.
    """
    names = ("idx_to_label", "idx_to_category", "idx_to_pii", "idx_to_type")
    backward = [n.replace("idx_to_", "") + "_to_idx" for n in names]
    schema = ", ".join([f"{n} map<string,string>" for n in names] + [f"{n} map<string,int>" for n in backward])
    raw = spark.read.schema(schema).option("multiLine", not is_folder(spark, path)).json(path)
    there = raw.select(F.explode(F.coalesce(*names)).alias("idx", "label")).select(F.col("idx").cast("int"), "label")
    back = raw.select(F.explode(F.coalesce(*backward)).alias("label", "idx")).select("idx", "label")
    if not there.exceptAll(back).isEmpty() or not back.exceptAll(there).isEmpty():
        raise ValueError(f"label map {path} is not a bijection")
    return there.select(F.lit(head).alias("head"), "idx", "label")


def read_mmlu_questions(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(MMLU_SCHEMA).format(kind).load(path)


def read_arc_questions(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(ARC_SCHEMA).format(kind).load(path)


def read_evaluations(spark: SparkSession, path: str, pattern: str = "analysis.json", faithful: bool = False) -> DataFrame:
    """Category accuracies of all result folders: ``(display_name, model, approach, category, accuracy)``.

    Model and approach come from the folder name. By default only the approach suffix
    is cut off and the rest kept as written; ``faithful`` reads the first underscore
    as a slash.
    """
    raw = (
        spark.read.schema(ANALYSIS_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern).json(path)
        .select("*", F.col("_metadata.file_path").alias("_file"))
    )
    decode = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    folder = decode(F.element_at(F.split("_file", "/"), -2))
    # A partition folder carries its value escaped once more.
    value = F.when(folder.startswith("dir="), decode(F.regexp_replace(folder, "^dir=", ""))).otherwise(folder)
    named = raw.withColumn("_dir", value)
    model = texts.dir_model(F.col("_dir")) if faithful else F.regexp_replace("_dir", "_(cot|direct)$", "")
    rows = named.select(model.alias("model"), texts.dir_approach(F.col("_dir")).alias("approach"), F.explode("category_accuracy").alias("category", "accuracy"))
    return rows.select(texts.display_name(F.col("model"), F.col("approach")).alias("display_name"), "model", "approach", "category", "accuracy")


def read_span_corpus(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``(text, types)`` from a JSON array of texts with entity spans; missing spans count as none.

    ``lines`` reads one JSON object per line, the form that splits over many tasks.
    """
    raw = spark.read.schema(SPAN_SCHEMA).option("multiLine", not lines).json(path)
    types = F.transform(F.coalesce("spans", F.array().cast("array<struct<entity_type:string>>")), lambda s: s["entity_type"])
    return raw.select(F.col("full_text").alias("text"), types.alias("types"))


def read_prompt_corpus(spark: SparkSession, *paths: str, kind: str = "parquet") -> DataFrame:
    """``(text, label)`` of several corpus parts, one after the other."""
    parts = [spark.read.schema(PROMPT_SCHEMA).format(kind).load(p) for p in paths]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.select(F.col("prompt").alias("text"), F.col("type").alias("label"))


def read_token_dump(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, token_id, token)`` from a tab-separated dump with a four-line header.

    Lines are numbered per split and the splits' counts summed, so a large dump is
    not read by one task. Blank lines and lines without exactly two fields are skipped.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_line"))
    numbered = running_totals(lines, [], ["_line"], F.lit(1), F.shiftright("_line", 33))
    parts = F.split(F.rtrim("value"), "\t")
    body = numbered.filter((F.col("position") > TOKEN_HEADER_LINES) & (F.size(parts) == 2) & (F.trim("value") != ""))
    kept = running_totals(body.select("_line", parts.alias("_p")), [], ["_line"], F.lit(1), F.shiftright("_line", 33))
    return kept.select((F.col("position") - 1).alias("pos"), F.col("_p")[0].cast("int").alias("token_id"), F.col("_p")[1].alias("token"))
