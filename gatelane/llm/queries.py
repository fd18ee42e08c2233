"""Registered queries of the training-data operators, and their check SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, embedding_graph, importance, mixture, quality, sharding, simhash, suffix_index, token_graph, toxicity, url_reputation, warc
from .common import table

RULES = [
    url_reputation.Rule("net", "/", "block"),
    url_reputation.Rule("example.net", "/en/", "allow"),
    url_reputation.Rule("example.com", "/de/", "block"),
    url_reputation.Rule("org", "/fr/", "allow"),
]


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), RULES)


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op3_bpe_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return texts.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_mixture_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.mix_by_source(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.likelihood_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio"
    )


def op9_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_index.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),
    )


def op10_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print("fp").alias("fingerprint"), "component_id")


def op11_token_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = token_graph.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"), F.col("kept").cast("string").alias("kept_text"))


def op12_byte_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_bit_sliced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL_MIXTURE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS weight FROM per),
-- sources from the tightest limit on; those before the first that is not above it stay at the limit
ranked AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source) AS rn FROM weighed),
levels AS (
  SELECT *, ((SELECT sum(size) FROM sized) - coalesce(sum(3 * source_size) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
free AS (SELECT min(rn) AS rn, arg_min(level, rn) AS level FROM levels WHERE weight * level <= 3 * source_size),
goals AS (
  SELECT l.source, l.source_size, CASE WHEN l.rn >= f.rn THEN l.weight * f.level ELSE 3.0::DOUBLE * l.source_size END AS target
  FROM levels l, free f),
plans AS (
  SELECT *, floor(target)::BIGINT // greatest(source_size, 1) AS whole, floor(target)::BIGINT % greatest(source_size, 1) AS rest FROM goals),
ordered AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.rest,
    sum(size) OVER (PARTITION BY s.source ORDER BY md5('5:' || doc_id::VARCHAR), doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running
  FROM sized s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN rest > 0 AND 2 * running - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered"""

_LAST = "array_to_string(list_slice(string_split(host, '.'), -{n}, -1), '.')"
_SUFFIXES = ", ".join(f"'{s}'" for s in url_reputation.TWO_LABEL_SUFFIXES)
_STRENGTH = """
  SELECT CASE WHEN seen IS NULL OR whole <= chance OR seen <= chance THEN 10000.0::DOUBLE
    ELSE least(greatest(1 / ((seen - chance) / (whole - chance)) - 1, 1.0::DOUBLE), 10000.0::DOUBLE) END AS k
  FROM (SELECT sum(n * (good / n - m) * (good / n - m)) AS seen, sum(m * (1 - m)) AS chance, sum(n * m * (1 - m)) AS whole
        FROM (SELECT good::DOUBLE AS good, n::DOUBLE AS n, m FROM {source}) WHERE n > 0)"""
SQL_URLS = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(rule, rhost, rpath, action) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
ruled AS (
  SELECT p.page_id, p.host, p.path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM parts p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL),
hosts AS (
  SELECT host, coalesce(sum(quality) FILTER (quality IN (0, 1)), 0) AS good, count(quality) FILTER (quality IN (0, 1)) AS n
  FROM parts LEFT JOIN labels ON doc_id = page_id GROUP BY host),
named AS (
  SELECT *, CASE WHEN regexp_matches(host, '^\\d+(\\.\\d+){{3}}$') THEN host WHEN {_LAST.format(n=2)} IN ({_SUFFIXES}) THEN {_LAST.format(n=3)}
      ELSE {_LAST.format(n=2)} END AS domain,
    CASE WHEN regexp_matches(host, '^\\d+(\\.\\d+){{3}}$') THEN '' WHEN {_LAST.format(n=2)} IN ({_SUFFIXES}) THEN {_LAST.format(n=2)}
      ELSE {_LAST.format(n=1)} END AS suffix FROM hosts),
base AS (SELECT CASE WHEN sum(n) > 0 THEN sum(good) / sum(n) ELSE 0.5 END AS base FROM hosts),
s0 AS (SELECT suffix, sum(good) AS good, sum(n) AS n, any_value(base) AS m FROM named, base GROUP BY suffix),
ks AS ({_STRENGTH.format(source="s0")}),
s1 AS (SELECT suffix, (good + k * m) / (n + k) AS mean FROM s0, ks),
d0 AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n, any_value(mean) AS m FROM named JOIN s1 USING (suffix) GROUP BY domain, suffix),
kd AS ({_STRENGTH.format(source="d0")}),
d1 AS (SELECT domain, suffix, (good + k * m) / (n + k) AS m FROM d0, kd),
h0 AS (SELECT host, good, n, m FROM named JOIN d1 USING (domain, suffix)),
kh AS ({_STRENGTH.format(source="h0")}),
h1 AS (SELECT host, (good + k * m) / (n + k) AS mean, n + k AS weight FROM h0, kh)
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) < 0.6 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN h1 USING (host)"""
SQL_WARC = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f"""

SQL_AUDIT = """
WITH facts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e
  FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    {A: len(words) < 50, B: 100 * len(list_distinct(words)) < 65 * len(words),
     C: 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t), D: regexp_matches(t, '[#$%&*|]'), E: e} AS f
  FROM facts LEFT JOIN marks USING (doc_id)),
tall AS (
  SELECT part, good, toxic, [n FOR n IN ['A', 'B', 'C', 'D', 'E'] IF CASE n WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END] AS fails
  FROM failing),
kinds AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM tall GROUP BY ALL),
letters(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, step::INT AS step, filter_order[step] AS filter, string_split(left(filter_order, step - 1), '') AS before FROM orders, range(1, 6) r(step)),
counted AS (
  SELECT part, filter_order, step, any_value(filter) AS filter,
    coalesce(sum(n) FILTER (NOT list_contains(fails, filter) AND NOT list_has_any(fails, before)), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (list_contains(fails, filter) AND NOT list_has_any(fails, before)), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (list_contains(fails, filter) AND list_has_any(fails, before)), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = [filter]), 0)::BIGINT AS unique_fails,
    coalesce(sum(n_good) FILTER (list_contains(fails, filter) AND NOT list_has_any(fails, before)), 0)::BIGINT AS good_lost,
    coalesce(sum(n_toxic) FILTER (list_contains(fails, filter) AND NOT list_has_any(fails, before)), 0)::BIGINT AS toxic_lost
  FROM kinds, steps GROUP BY part, filter_order, step)
SELECT * EXCLUDE (filter), sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley FROM counted"""
SQL_IMPORTANCE = """
WITH steps(tab) AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) FROM range(256) r(n)),
d AS (
  SELECT doc_id, row_number() OVER () AS spot, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words
  FROM documents),
b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words
  FROM benchmark),
dw AS (SELECT spot, unnest(words) AS w FROM d),
bw AS (SELECT unnest(words) AS w FROM b),
vocabulary AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
hashed AS (
  SELECT w, xor(list_reduce(list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM vocabulary, steps),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (w) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT spot, sum(gain)::BIGINT AS weight FROM dw JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY spot),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM d LEFT JOIN weighed USING (spot)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank
FROM ranked"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_url_reputation, op2_warc_index, op3_bpe_forced_boundaries, op4_toxicity_cnn, op5_mixture_flow, op6_embedding_graph, op7_hypergeometric_shards,
        op8_quality_ratio, op9_suffix_family, op10_simhash_blocks, op11_token_graph, op12_byte_transducer, op13_bit_sliced_weights,
    )
}
SQL: dict[str, str] = {"op1_url_reputation": SQL_URLS, "op2_warc_index": SQL_WARC, "op5_mixture_flow": SQL_MIXTURE,
                       "op12_byte_transducer": SQL_AUDIT, "op13_bit_sliced_weights": SQL_IMPORTANCE}
