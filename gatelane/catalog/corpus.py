"""Corpus preparation, word labels and classifier reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..functions.rules import pii_types
from ..operators import corpus, reports
from ..session import spread
from .common import sql_list, sql_text, table
from .routing import sql_pii_list

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), "doc_id")


NAME_PARTS = "|".join(sorted({p for n in texts.KNOWN_NAMES for p in n.split()}))


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {sql_text(texts.SPACES)}), lambda w: w <> '')"


def sql_word_labels(text: str) -> str:
    known = f"regexp_matches({text}, {sql_text(NAME_PARTS)})"
    pattern = sql_text(f"{texts.EMAIL}|{texts.PHONE}|{texts.SSN}")
    return (
        f"list_transform({sql_words(text)}, lambda w: (regexp_matches(w, {pattern}) OR "
        f"({known} AND regexp_matches(w, '^\\p{{Lu}}') AND length(w) > 1))::INT)"
    )


# ------------------------------------------------------------------ labels and splits
@query
def dominant_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent entity type of every document, from its span list and from span rows."""
    docs = documents(spark, sf_dir)
    # Two thirds of the documents carry their found types twice and one extra type.
    extra = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("PERSON"))).otherwise(F.array().cast("array<string>"))
    found = docs.select("doc_id", pii_types(F.col("text")).alias("t"), extra.alias("x"))
    spans = found.select("doc_id", F.concat("t", "x", "t").alias("types"))
    rows = spans.select("doc_id", F.explode_outer("types").alias("kind"))
    by_rows = corpus.dominant_label_rows(rows, "doc_id", "kind").withColumnRenamed("label", "label_rows")
    return spans.select("doc_id", corpus.dominant_label(F.col("types")).alias("label")).join(by_rows, "doc_id")


SQL["dominant_label"] = f"""
WITH t AS (SELECT doc_id, {sql_pii_list('text')} AS t, CASE WHEN doc_id % 3 = 0 THEN ['PERSON'] ELSE [] END AS x FROM documents),
s AS (SELECT doc_id, unnest(list_concat(list_concat(t, x), t)) AS k FROM t),
c AS (SELECT doc_id, k, count(*) AS n FROM s GROUP BY ALL),
b AS (SELECT doc_id, k FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) = 1)
SELECT doc_id, coalesce(k, 'NO_PII') AS label, coalesce(k, 'NO_PII') AS label_rows FROM documents LEFT JOIN b USING (doc_id)"""


@query
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.class_distribution(table(spark, sf_dir, "documents"), "source")


SQL["class_distribution"] = "SELECT source, count(*) AS n FROM documents GROUP BY source"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("label"))


@query
def rare_class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose source and language pair occurs at least three times."""
    return corpus.drop_rare(_labelled(spark, sf_dir), "label").select("doc_id", "label")


SQL["rare_class_filter"] = """WITH l AS (SELECT doc_id, source || '/' || lang AS label FROM documents)
SELECT doc_id, label FROM l QUALIFY count(*) OVER (PARTITION BY label) >= 3"""


@query
def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.label_index(_labelled(spark, sf_dir), "label")


SQL["label_index"] = """WITH l AS (SELECT DISTINCT source || '/' || lang AS label FROM documents)
SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS label_id FROM l"""


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    return rows.select("doc_id", F.concat_ws("-", "quality", "toxic").alias("label"))


SQL_POSITION = """p AS (SELECT doc_id, quality || '-' || toxic AS label,
  row_number() OVER (PARTITION BY quality, toxic ORDER BY md5('42:' || doc_id) || ':' || doc_id) AS r,
  count(*) OVER (PARTITION BY quality, toxic) AS n FROM labels)"""


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seventy, fifteen and fifteen percent per class."""
    return corpus.split(_classes(spark, sf_dir), "doc_id", "label").select("doc_id", "label", "split")


SQL["stratified_split"] = f"""WITH {SQL_POSITION}
SELECT doc_id, label, CASE WHEN r * 100 <= 70 * n THEN 'train' WHEN r * 100 <= 85 * n THEN 'validation' ELSE 'test' END AS split FROM p"""


@query
def stratified_split_80_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighty and twenty percent per class."""
    return corpus.split(_classes(spark, sf_dir), "doc_id", "label", (0.8, 0.2), ("train", "validation")).select("doc_id", "label", "split")


SQL["stratified_split_80_20"] = f"""WITH {SQL_POSITION}
SELECT doc_id, label, CASE WHEN r * 100 <= 80 * n THEN 'train' ELSE 'validation' END AS split FROM p"""


@query
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same shares over all rows, the way out when labels are too thin."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return corpus.split(docs, "doc_id", None).select("doc_id", "split")


SQL["random_split"] = """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id) || ':' || doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r * 100 <= 70 * n THEN 'train' WHEN r * 100 <= 85 * n THEN 'validation' ELSE 'test' END AS split FROM p"""


@query
def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and test parts of a corpus concatenated, with class counts per part."""
    rows = _classes(spark, sf_dir)
    parts = corpus.split(rows, "doc_id", "label", (0.8, 0.2), ("train", "test"))
    union = parts.filter("split = 'train'").unionByName(parts.filter("split = 'test'"))
    return union.groupBy("split", "label").agg(F.count("*").alias("n"))


SQL["corpus_union"] = f"""WITH {SQL_POSITION}
SELECT CASE WHEN r * 100 <= 80 * n THEN 'train' ELSE 'test' END AS split, label, count(*) AS n FROM p GROUP BY ALL"""


# ------------------------------------------------------------------ word labels
@query
def word_pii_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and flagged words of every whole document; one in four mentions a known name."""
    named = F.concat("text", F.when(F.col("doc_id") % 4 == 0, " Sincerely, Emily (555) 123-4567 or 555-123-4567").otherwise(""))
    rows = documents(spark, sf_dir).select("doc_id", named.alias("t"))
    labels = rows.select("doc_id", texts.word_pii_labels(F.col("t")).alias("l"))
    return labels.select("doc_id", F.size("l").alias("n_words"), F.aggregate("l", F.lit(0), lambda a, x: a + x).alias("n_pii"))


SQL["word_pii_labels"] = f"""
WITH t AS (SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN ' Sincerely, Emily (555) 123-4567 or 555-123-4567' ELSE '' END AS t FROM documents),
l AS (SELECT doc_id, {sql_word_labels('t')} AS l FROM t)
SELECT doc_id, len(l)::INT AS n_words, coalesce(list_sum(l), 0)::INT AS n_pii FROM l"""


@query
def pad_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word labels of every document cut or padded to 512 and masked behind the last word."""
    labels = documents(spark, sf_dir).select("doc_id", texts.word_pii_labels(F.col("text")).alias("l"))
    padded = labels.select("doc_id", F.size("l").alias("n"), texts.pad_labels(F.col("l"), 512).alias("p"))
    attention = F.transform(F.sequence(F.lit(1), F.lit(512)), lambda i: (i <= F.col("n")).cast("int"))
    masked = padded.withColumn("m", texts.mask_labels(F.col("p"), attention))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)
    return masked.select(
        "doc_id", F.size("p").alias("n_padded"), total("p").alias("n_pii"),
        F.size(F.filter("m", lambda x: x == texts.MASKED_LABEL)).alias("n_masked"),
    )


SQL["pad_labels"] = f"""WITH l AS (SELECT doc_id, {sql_word_labels('text')} AS l FROM documents)
SELECT doc_id, 512::INT AS n_padded, coalesce(list_sum(list_slice(l, 1, 512)), 0)::INT AS n_pii, greatest(512 - len(l), 0)::INT AS n_masked FROM l"""


@query
def token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document compared with those of the next, position by position."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    pairs = docs.join(following, "doc_id")
    compared = pairs.withColumn("c", reports.token_match(texts.words(F.col("text")), texts.words(F.col("next"))))
    first = F.get("c.mismatches", F.lit(0))
    return compared.select(
        "doc_id", F.col("c.compared").alias("compared"), F.col("c.matches").alias("matches"),
        F.round("c.match_pct", 6).alias("match_pct"), first["pos"].alias("first_pos"),
    )


SQL["token_match"] = f"""WITH w AS (SELECT doc_id, {sql_words('text')} AS w FROM documents),
j AS (SELECT a.doc_id, a.w AS x, b.w AS y, least(len(a.w), len(b.w)) AS m FROM w a JOIN w b ON b.doc_id = a.doc_id + 1),
p AS (SELECT doc_id, m, list_filter(range(1, m + 1), lambda i: x[i] = y[i]) AS same, list_filter(range(1, m + 1), lambda i: x[i] <> y[i]) AS diff FROM j)
SELECT doc_id, m::INT AS compared, len(same)::INT AS matches, round(CASE WHEN m > 0 THEN len(same) / m * 100 ELSE 0 END, 6) AS match_pct,
  (diff[1] - 1)::INT AS first_pos FROM p"""


@query
def truncate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept by truncation at the default length and at a given one."""
    words = documents(spark, sf_dir).select("doc_id", texts.words(F.col("text")).alias("w"))
    return words.select(
        "doc_id", F.size(texts.truncate_tokens(F.col("w"), 0)).alias("n_default"),
        F.array_join(texts.truncate_tokens(F.col("w"), 4), " ").alias("first_four"),
    )


SQL["truncate_tokens"] = f"""WITH w AS (SELECT doc_id, {sql_words('text')} AS w FROM documents)
SELECT doc_id, least(len(w), 512)::INT AS n_default, coalesce(array_to_string(list_slice(w, 1, 4), ' '), '') AS first_four FROM w"""


@query
def labelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generated, labelled sentence per document id."""
    made = corpus.generate_corpus(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return made.select("doc_id", "category", "has_pii", "text", F.array_join(F.col("pii_labels").cast("array<string>"), "").alias("pii_labels"))


def sql_pick(slot: str, n: str) -> str:
    return f"(('0x' || substr(md5('42:{slot}:' || doc_id), 1, 8))::BIGINT % {n})"


SQL["labelled_corpus"] = f"""
WITH b AS (SELECT doc_id, {sql_pick('category', str(len(corpus.TEMPLATES)))} AS c, {sql_pick('insert', '10000')} < 3000 AS has_pii,
  {sql_pick('kind', str(len(corpus.PERSONAL_DATA)))} AS k, {sql_pick('form', str(len(corpus.INSERTIONS)))} AS f, {sql_pick('sentence', '6')} AS s FROM documents),
v AS (SELECT *, [{", ".join(sql_list(x) for x in corpus.TEMPLATES.values())}][c + 1][s + 1] AS t,
  {sql_list(corpus.PERSONAL_DATA)}[k + 1] AS kind, [{", ".join(sql_list(x) for x in corpus.PERSONAL_DATA.values())}][k + 1] AS vals FROM b),
x AS (SELECT *, CASE WHEN has_pii THEN replace(replace(replace({sql_list(corpus.INSERTIONS)}[f + 1], '{{kind}}', kind),
  '{{value}}', vals[{sql_pick('value', 'len(vals)')} + 1]), '{{text}}', t) ELSE t END AS text FROM v)
SELECT doc_id, c::INT AS category, has_pii, text, array_to_string({sql_word_labels('text')}, '') AS pii_labels FROM x"""


# ------------------------------------------------------------------ reports
def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality as the true label, a noisy copy of it as the prediction."""
    rows = table(spark, sf_dir, "labels")
    return rows.select(
        "doc_id", F.concat(F.lit("q"), F.col("quality") + F.col("toxic")).alias("truth"),
        F.concat(F.lit("q"), F.when(F.col("doc_id") % 7 == 0, F.lit(2)).otherwise(F.col("quality"))).alias("predicted"),
    )


SQL_PREDICTIONS = """p AS (SELECT doc_id, 'q' || (quality + toxic) AS truth, 'q' || CASE WHEN doc_id % 7 = 0 THEN 2 ELSE quality END AS predicted FROM labels)"""
SQL_REPORT = f"""{SQL_PREDICTIONS},
l AS (SELECT DISTINCT truth AS label FROM p UNION SELECT DISTINCT predicted FROM p),
c AS (SELECT label, (SELECT count(*) FROM p WHERE truth = label AND predicted = label) AS tp,
  (SELECT count(*) FROM p WHERE truth = label) AS support, (SELECT count(*) FROM p WHERE predicted = label) AS claimed FROM l),
s AS (SELECT label, CASE WHEN claimed > 0 THEN tp / claimed ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
  CASE WHEN claimed + support > 0 THEN 2 * tp / (claimed + support) ELSE 0 END AS f1, support, tp FROM c),
report AS (SELECT label, precision, recall, f1, support FROM s
UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM s
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM s
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM s)"""


@query
def classifier_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.accuracy(_predictions(spark, sf_dir), "truth", "predicted").withColumn("accuracy", F.round("accuracy", 6))


SQL["classifier_accuracy"] = f"WITH {SQL_PREDICTIONS} SELECT round(avg((truth = predicted)::INT), 6) AS accuracy, count(*) AS n FROM p"


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = reports.confusion(_predictions(spark, sf_dir), "truth", "predicted")
    return reports.confusion_matrix(counts)


SQL["confusion_matrix"] = f"""WITH {SQL_PREDICTIONS}
SELECT l.truth, {", ".join(f"count(*) FILTER (predicted = 'q{i}') AS q{i}" for i in range(3))}
FROM (VALUES ('q0'), ('q1'), ('q2')) l(truth) LEFT JOIN p USING (truth) GROUP BY l.truth"""


@query
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = reports.confusion(_predictions(spark, sf_dir), "truth", "predicted")
    rows = reports.classification_report(counts)
    return rows.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


SQL["classification_report"] = f"""WITH {SQL_REPORT}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM report"""


@query
def weighted_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted F1 over unmasked word positions: rule labels against capitalisation."""
    docs = documents(spark, sf_dir).select("doc_id", F.concat("text", F.lit(" Best, Anna")).alias("t"))
    words = texts.words(F.col("t"))
    truth = texts.mask_labels(texts.word_pii_labels(F.col("t")), F.transform(words, lambda w: (F.length(w) > 2).cast("int")))
    guess = F.transform(words, lambda w: (w.rlike("^[A-Z]") & (F.length(w) > 4)).cast("int"))
    rows = docs.select("doc_id", truth.alias("truth"), guess.alias("predicted"))
    counts = reports.position_counts(rows, "truth", "predicted", texts.MASKED_LABEL)
    return reports.weighted_f1(counts).select(F.round("weighted_f1", 6).alias("weighted_f1"), "support")


SQL["weighted_f1"] = f"""
WITH d AS (SELECT text || ' Best, Anna' AS t FROM documents),
w AS (SELECT unnest({sql_words('t')}) AS w, unnest({sql_word_labels('t')}) AS truth FROM d),
p AS (SELECT truth, (regexp_matches(w, '^[A-Z]') AND length(w) > 4)::INT AS predicted FROM w WHERE length(w) > 2),
l AS (SELECT DISTINCT truth AS label FROM p UNION SELECT DISTINCT predicted FROM p),
c AS (SELECT label, count(*) FILTER (truth = label AND predicted = label) AS tp, count(*) FILTER (truth = label) AS support,
  count(*) FILTER (predicted = label) AS claimed FROM p, l GROUP BY label)
SELECT round(sum(CASE WHEN claimed + support > 0 THEN 2 * tp / (claimed + support) ELSE 0 END * support) / sum(support), 6) AS weighted_f1, sum(support)::BIGINT AS support FROM c"""
