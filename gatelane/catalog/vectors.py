"""Similarity, heads, the semantic cache and model selection, on the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import cache, selection
from ..operators.screening import category_decision, pii_decision, with_label
from ..operators.similarity import BLOCK_ROWS, NearestCentroid, best_match, centroids, pair_similarity, root_pivots
from ..settings import (
    CATEGORY_LABELS, PII_LABELS, CacheOptions, default_config, labels_table, models_table, scores_table,
)
from .common import (
    SQL_CATEGORY_LABELS, SQL_CENTROIDS, SQL_HEAD, SQL_PII_LABELS, SQL_POLICY, SQL_SCORES, centroid_head,
    fixture_config, table,
)

QUERIES, SQL = {}, {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


@query
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of shifted embeddings: length before, length after, one component."""
    shifted = embeddings(spark, sf_dir).select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3 + 0.5).alias("v"))
    unit = shifted.withColumn("u", V.l2_normalize(F.col("v")))
    return unit.select(
        "vec_id", F.round(V.norm(F.col("v")), 6).alias("norm_before"), F.round(V.norm(F.col("u")), 6).alias("norm_after"),
        F.round(F.element_at("u", -1), 6).alias("last"),
    )


SQL["l2_normalize"] = """
WITH s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3 + 0.5) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM s)
SELECT vec_id, round(n, 6) AS norm_before,
  round(sqrt(list_dot_product(list_transform(v, lambda x: x / n), list_transform(v, lambda x: x / n))), 6) AS norm_after,
  round(v[-1] / n, 6) AS last FROM n"""


@query
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a short sequence of vectors per row: each vector with its successor and its reverse."""
    rows = embeddings(spark, sf_dir).select("vec_id", "embedding")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    tokens = rows.join(following, "vec_id").withColumn("tokens", F.array("embedding", "next", F.reverse("embedding")))
    pooled = tokens.select("vec_id", V.mean_pool(F.col("tokens")).alias("m"))
    return pooled.select("vec_id", F.round(F.get("m", F.lit(0)), 6).alias("first"), F.round(V.norm(F.col("m")), 6).alias("norm"))


SQL["mean_pool"] = """
WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y, list_reverse(a.embedding)::DOUBLE[] AS z
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
m AS (SELECT vec_id, list_transform(range(1, 65), lambda i: (x[i] + y[i] + z[i]) / 3) AS m FROM p)
SELECT vec_id, round(m[1], 6) AS first, round(sqrt(list_dot_product(m, m)), 6) AS norm FROM m"""


@query
def mean_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of all vectors of a label, one row per dimension."""
    means = centroids(embeddings(spark, sf_dir), "label", "embedding")
    return means.select("label", F.posexplode("centroid").alias("dim", "x")).select("label", "dim", F.round("x", 6).alias("mean"))


SQL["mean_by_label"] = """SELECT label, (i - 1)::INT AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean
FROM embeddings, range(1, 65) r(i) GROUP BY ALL"""


@query
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the first five vectors per label, one row per dimension."""
    means = centroids(embeddings(spark, sf_dir), "label", "embedding", "vec_id", 5)
    return means.select("label", F.posexplode("centroid").alias("dim", "x")).select("label", "dim", F.round("x", 6).alias("mean"))


SQL["label_centroids"] = f"WITH {SQL_CENTROIDS} SELECT label, (dim - 1)::INT AS dim, round(m, 6) AS mean FROM dims"


@query
def softmax_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and confidence of a linear softmax head on every vector."""
    scored = embeddings(spark, sf_dir).select("vec_id", centroid_head(spark, sf_dir).score(F.col("embedding")).alias("s"))
    return scored.select("vec_id", F.col("s.class").alias("class"), F.round("s.confidence", 6).alias("confidence"))


SQL["softmax_head"] = f"WITH {SQL_HEAD} SELECT vec_id, class, round(confidence, 6) AS confidence FROM head"


@query
def category_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and PII decision at the thresholds, and the raw label by join."""
    rows = embeddings(spark, sf_dir).select("vec_id", centroid_head(spark, sf_dir).score(F.col("embedding")).alias("s"))
    # Shift the class so that some indices are outside the vocabulary.
    shifted = rows.withColumn("t", F.struct((F.col("s.class") + 10).alias("class"), F.col("s.confidence").alias("confidence")))
    decided = shifted.select(
        "vec_id", F.col("t.class").alias("idx"),
        category_decision(F.col("s"), CATEGORY_LABELS, 0.6).alias("category"),
        category_decision(F.col("t"), CATEGORY_LABELS, 0.6).alias("shifted_category"),
        pii_decision(F.col("t"), PII_LABELS, 0.7).alias("pii"),
    )
    named = with_label(decided, labels_table(spark), "category", "idx", "raw_label")
    return named.select("vec_id", "category", "shifted_category", "pii", F.coalesce("raw_label", F.lit("Unknown")).alias("raw_label"))


SQL["category_decisions"] = f"""WITH {SQL_HEAD}, {SQL_CATEGORY_LABELS}, {SQL_PII_LABELS}
SELECT vec_id, CASE WHEN confidence >= 0.6 THEN coalesce(a.label, '') ELSE '' END AS category,
  CASE WHEN confidence >= 0.6 THEN coalesce(b.label, '') ELSE '' END AS shifted_category,
  CASE WHEN confidence >= 0.7 THEN coalesce(p.label, 'NO_PII') ELSE 'NO_PII' END AS pii,
  coalesce(b.label, 'Unknown') AS raw_label
FROM head h LEFT JOIN labels_cat a ON a.idx = h.class LEFT JOIN labels_cat b ON b.idx = h.class + 10
LEFT JOIN labels_pii p ON p.idx = h.class + 10"""


@query
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most similar label centroid for every vector; the ten centroids travel to the rows."""
    rows = embeddings(spark, sf_dir).select("vec_id", "embedding", "label")
    means = centroids(rows, "label", "embedding", "vec_id", 5)
    nearest = NearestCentroid(means.select("label", V.l2_normalize(F.col("centroid")).alias("centroid")))
    found = rows.select("vec_id", "label", nearest.match(F.col("embedding")).alias("n")).filter("n IS NOT NULL")
    return found.select("vec_id", "label", F.col("n.label").alias("predicted"), F.round("n.similarity", 6).alias("similarity"))


SQL["nearest_centroid"] = f"""WITH {SQL_HEAD}
SELECT e.vec_id, e.label, max_by(l.label, (round(l.z / 20, 9), -l.label))::INT AS predicted, round(max(round(l.z / 20, 9)), 6) AS similarity
FROM embeddings e JOIN logits l USING (vec_id) GROUP BY ALL"""


@query
def centroid_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the nearest-centroid rule, overall."""
    found = nearest_centroid(spark, sf_dir)
    return found.agg(
        F.coalesce(F.round(F.avg((F.col("label") == F.col("predicted")).cast("double")), 6), F.lit(0.0)).alias("accuracy"),
        F.count("*").alias("n"),
    )


SQL["centroid_accuracy"] = f"""WITH n AS ({SQL["nearest_centroid"]})
SELECT round(avg((label = predicted)::INT), 6) AS accuracy, count(*) AS n FROM n"""


@query
def best_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most similar other vector of the whole table, first on ties."""
    rows = embeddings(spark, sf_dir).select("vec_id", "embedding")
    found = best_match(rows, rows, "vec_id", "vec_id", exclude_self=True, pivots=root_pivots(rows, 4 * BLOCK_ROWS))
    return found.select("vec_id", "match_id", F.round("score", 6).alias("score"))


SQL["best_match_all"] = """
WITH p AS (SELECT a.vec_id, b.vec_id AS m, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT vec_id, max_by(m, (s, -m)) AS match_id, round(max(s), 6) AS score FROM p GROUP BY vec_id"""


@query
def best_match_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by pivot cells without a score floor: the nearest cell first, then those its answer leaves open."""
    rows = embeddings(spark, sf_dir)
    found = best_match(rows, rows, "vec_id", "vec_id", exclude_self=True, pivots=root_pivots(rows))
    return found.select("vec_id", "match_id", F.round("score", 6).alias("score"))


SQL["best_match_two_pass"] = SQL["best_match_all"]


@query
def best_match_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most similar other vector at 0.5 or more: identifiers are text, cells are laid out by pivots."""
    rows = embeddings(spark, sf_dir).select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("name"), "embedding")
    found = best_match(rows, rows, "name", "name", exclude_self=True, min_score=0.5, pivots=root_pivots(rows))
    return found.select("name", "match_id", F.round("score", 6).alias("score"))


SQL["best_match_pivots"] = """
WITH p AS (SELECT a.vec_id, b.vec_id AS m, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT lpad(vec_id::VARCHAR, 12, '0') AS name, lpad(max_by(m, (round(s, 9), -m))::VARCHAR, 12, '0') AS match_id, round(max(round(s, 9)), 6) AS score
FROM p WHERE s >= 0.5 GROUP BY vec_id"""


@query
def pair_similarity_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector and its successor; the last pair fails and scores -1."""
    rows = embeddings(spark, sf_dir)
    pairs = rows.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return pair_similarity(pairs, rows, "a", "b", "vec_id", "embedding").select("a", "b", F.round("similarity", 6).alias("similarity"))


SQL["pair_similarity_next"] = """
SELECT a.vec_id AS a, a.vec_id + 1 AS b, round(coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), -1), 6) AS similarity
FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


# ------------------------------------------------------------------ cache
def _cache_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every vector is a request at second ``vec_id``; its own answer is an entry ten seconds later.

    One entry in eight is still pending.
    """
    rows = embeddings(spark, sf_dir).select("vec_id", "embedding", F.concat(F.lit("model-"), F.col("label") % 3).alias("model"))
    requests = rows.withColumn("ts", F.col("vec_id"))
    entries = rows.withColumn("response_ts", F.when(F.col("vec_id") % 8 != 7, F.col("vec_id") + 10))
    return requests, entries


def _lookup(spark: SparkSession, sf_dir: str, ttl: int, expire: str = "on_read") -> DataFrame:
    requests, entries = _cache_sides(spark, sf_dir)
    found = cache.lookup(
        requests, entries, CacheOptions(0.3, 0, ttl), "vec_id", "vec_id", "model", "embedding", "ts", "response_ts", expire,
        pivots=0 if ttl else root_pivots(entries, 4 * BLOCK_ROWS),
    )
    return found.select("vec_id", "model", "hit", "match_id", F.round("score", 6).alias("score"))


SQL_LOOKUP = """
SELECT r.vec_id, r.model, m.m IS NOT NULL AS hit, m.m AS match_id, round(m.s, 6) AS score
FROM (SELECT vec_id, 'model-' || (label %% 3) AS model FROM embeddings) r LEFT JOIN (
  SELECT a.vec_id, max_by(b.vec_id, (round(d, 9), b.vec_id)) AS m, max(round(d, 9)) AS s FROM (
    SELECT a.vec_id AS q, b.vec_id AS e, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
    FROM embeddings a JOIN embeddings b ON a.label %% 3 = b.label %% 3 AND b.vec_id %% 8 <> 7 AND b.vec_id + 10 <= a.vec_id
      AND a.vec_id - (b.vec_id + 10) < %s) p
  JOIN embeddings a ON a.vec_id = p.q JOIN embeddings b ON b.vec_id = p.e WHERE round(d, 9) >= 0.3 GROUP BY a.vec_id) m USING (vec_id)"""


@query
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache hits without expiry: all earlier answered entries of the same model."""
    return _lookup(spark, sf_dir, 0)


SQL["cache_lookup"] = SQL_LOOKUP % "1e18"


@query
def cache_lookup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache hits with entries that expire after two hundred seconds."""
    return _lookup(spark, sf_dir, 200)


SQL["cache_lookup_ttl"] = SQL_LOOKUP % "200"


@query
def cache_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses per model."""
    return _lookup(spark, sf_dir, 200).groupBy("model").agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")
    )


SQL["cache_hit_counts"] = f"""WITH l AS ({SQL_LOOKUP % 200})
SELECT model, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM l GROUP BY model"""


@query
def cache_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest hundred entries after expiry, with pending entries counted."""
    _, entries = _cache_sides(spark, sf_dir)
    now = entries.count()
    stamped = entries.withColumn("ts", F.coalesce("response_ts", "vec_id"))
    fresh = cache.unexpired(stamped, F.col("ts"), F.lit(now), 300)
    return cache.keep_newest(fresh, "ts", "vec_id", 100).select("vec_id", "model", "ts")


SQL["cache_retention"] = """
WITH s AS (SELECT vec_id, 'model-' || (label % 3) AS model, CASE WHEN vec_id % 8 <> 7 THEN vec_id + 10 ELSE vec_id END AS ts FROM embeddings)
SELECT vec_id, model, ts FROM s WHERE (SELECT count(*) FROM embeddings) - ts < 300 ORDER BY ts DESC, vec_id DESC LIMIT 100"""


@query
def cache_expired_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries a read would find expired, without dropping them."""
    _, entries = _cache_sides(spark, sf_dir)
    return cache.count_expired(entries, F.coalesce("response_ts", "vec_id"), F.lit(entries.count()), 300)


SQL["cache_expired_count"] = """
SELECT count(*) FILTER ((SELECT count(*) FROM embeddings) - CASE WHEN vec_id % 8 <> 7 THEN vec_id + 10 ELSE vec_id END >= 300) AS n_expired,
  count(*) AS n_entries FROM embeddings"""


@query
def cache_lookup_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache hits when only the hundred entries answered last are kept."""
    requests, entries = _cache_sides(spark, sf_dir)
    found = cache.lookup(requests, entries, CacheOptions(0.3, 100, 0), "vec_id", "vec_id", "model", "embedding", "ts", "response_ts")
    return found.select("vec_id", "model", "hit", "match_id", F.round("score", 6).alias("score"))


SQL["cache_lookup_capped"] = """
WITH entries AS (SELECT vec_id, label % 3 AS m, embedding, vec_id + 10 AS at, row_number() OVER (ORDER BY vec_id) AS place FROM embeddings WHERE vec_id % 8 <> 7),
requests AS (SELECT v.vec_id, v.label % 3 AS m, v.embedding, (SELECT count(*) FROM entries e WHERE e.at <= v.vec_id) AS seen FROM embeddings v),
pairs AS (SELECT r.vec_id AS q, e.vec_id AS e, list_dot_product(r.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d
  FROM requests r JOIN entries e ON r.m = e.m AND e.place <= r.seen AND e.place > r.seen - 100),
best AS (SELECT q, max_by(e, (round(d, 9), e)) AS m, max(round(d, 9)) AS s FROM pairs WHERE d >= 0.3 GROUP BY q)
SELECT vec_id, 'model-' || (label % 3) AS model, b.m IS NOT NULL AS hit, b.m AS match_id, round(b.s, 6) AS score
FROM embeddings LEFT JOIN best b ON b.q = vec_id"""


def sql_replay(key: str) -> str:
    """One-by-one replay as a recursion over the log: ``pairs``, ``last`` (inserted ids) and ``hits``."""
    return f"""
pairs AS (SELECT q.vec_id AS q, e.vec_id AS e, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS s
  FROM embeddings q JOIN embeddings e ON {key.format(t='q')} = {key.format(t='e')} AND e.vec_id < q.vec_id),
near AS (SELECT v.vec_id, list(p.e) FILTER (p.s >= 0.3) AS near FROM embeddings v LEFT JOIN pairs p ON p.q = v.vec_id GROUP BY v.vec_id),
steps AS (SELECT -1::BIGINT AS i, []::BIGINT[] AS ins
  UNION ALL SELECT n.vec_id, CASE WHEN len(list_intersect(steps.ins, coalesce(n.near, []))) > 0 THEN steps.ins ELSE list_append(steps.ins, n.vec_id) END
  FROM steps JOIN near n ON n.vec_id = steps.i + 1),
last AS (SELECT unnest(ins) AS id FROM steps WHERE i = (SELECT max(i) FROM steps)),
hits AS (SELECT q, max_by(e, (s, e)) AS m, max(s) AS s FROM pairs JOIN last ON last.id = pairs.e WHERE s >= 0.3 GROUP BY q)"""


# ------------------------------------------------------------------ selection
def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).select("vec_id", centroid_head(spark, sf_dir).score(F.col("embedding")).alias("s"))
    return rows.select("vec_id", category_decision(F.col("s"), CATEGORY_LABELS, 0.6).alias("category"))


SQL_CLASSIFIED = f"""{SQL_HEAD}, {SQL_CATEGORY_LABELS}, {SQL_SCORES}, {SQL_POLICY},
classified AS (SELECT vec_id, CASE WHEN confidence >= 0.6 THEN coalesce(l.label, '') ELSE '' END AS category
  FROM head h LEFT JOIN labels_cat l ON l.idx = h.class)"""
SQL_TTFT = """
size(model, n) AS (VALUES ('phi4', 14e9), ('gemma3:27b', 27e9), ('mistral-small3.1', 22e9)),
ttft AS (SELECT model, (2 * n * 512.0 * 16384.0 / 312e12 + 2 * n / 2e12) * 1000 AS t FROM size)"""


@query
def best_model_per_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best model of each request's category by quality; the default without a category."""
    config = default_config()
    best = selection.best_models(scores_table(spark, config)).select(F.lower("category").alias("key"), F.col("model").alias("best"), "score")
    rows = _classified(spark, sf_dir).withColumn("key", F.lower("category"))
    return rows.join(best, "key", "left").select(
        "vec_id", "category", F.coalesce("best", F.lit(config.default_model)).alias("model"), "score"
    )


SQL["best_model_per_request"] = f"""WITH {SQL_CLASSIFIED},
best AS (SELECT category, model, score FROM scores QUALIFY row_number() OVER (PARTITION BY category ORDER BY score DESC, pos) = 1)
SELECT vec_id, c.category, coalesce(b.model, 'mistral-small3.1') AS model, b.score::DOUBLE AS score FROM classified c LEFT JOIN best b USING (category)"""


@query
def load_aware_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best model per category when every open request lowers a model's score.

    The load is the number of confident requests whose category names the model best.
    """
    config = default_config()
    scores = scores_table(spark, config)
    load = best_model_per_request(spark, sf_dir).groupBy("model").agg((F.count("*") % 5).cast("int").alias("load"))
    aware = selection.load_aware_scores(scores, selection.ttft_table(spark, config), load)
    return selection.best_models(aware).select("category", "model", F.round(F.col("score") * 1e6, 6).alias("score_e6"))


SQL["load_aware_best"] = f"""WITH {SQL_CLASSIFIED}, {SQL_TTFT},
best AS (SELECT category, model FROM scores QUALIFY row_number() OVER (PARTITION BY category ORDER BY score DESC, pos) = 1),
load AS (SELECT coalesce(b.model, 'mistral-small3.1') AS model, count(*) % 5 AS load FROM classified c LEFT JOIN best b USING (category) GROUP BY 1),
aware AS (SELECT s.category, s.model, s.pos, s.score / (t.t * (1 + coalesce(l.load, 0))) AS sc FROM scores s JOIN ttft t USING (model) LEFT JOIN load l USING (model))
SELECT category, model, round(sc * 1e6, 6) AS score_e6 FROM aware QUALIFY row_number() OVER (PARTITION BY category ORDER BY sc DESC, pos) = 1"""


@query
def best_from_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best model per request among those whose policy passes for a card number, and the ranking behind it."""
    config = fixture_config()
    cands = selection.candidate_table(scores_table(spark, config), models_table(spark, config))
    rows = _classified(spark, sf_dir).withColumn("category_key", F.lower("category")).join(cands, "category_key", "left")
    detected = F.when(F.col("vec_id") % 2 == 0, F.array(F.lit("CREDIT_CARD"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "vec_id", "category", selection.best_allowed(F.col("candidates"), detected).alias("model"),
        F.when(F.col("candidates").isNull(), 0).otherwise(F.size("candidates")).alias("n_candidates"),
    )


SQL["best_from_allowed"] = f"""WITH {SQL_CLASSIFIED},
ok AS (SELECT c.vec_id, s.model, s.score, s.pos FROM classified c JOIN scores s USING (category) JOIN policy p ON p.model = s.model
  WHERE c.vec_id % 2 = 1 OR p.allow_all OR list_contains(p.allowed, 'CREDIT_CARD')),
top AS (SELECT vec_id, max_by(model, (score, -pos)) AS model FROM ok GROUP BY vec_id),
n AS (SELECT category, count(*) AS n FROM scores GROUP BY category)
SELECT c.vec_id, c.category, t.model, coalesce(n.n, 0)::INT AS n_candidates FROM classified c LEFT JOIN top t USING (vec_id) LEFT JOIN n USING (category)"""


@query
def base_ttft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency estimate of every model that appears as a request model; unknown models get the defaults."""
    from .common import requested_model

    config = default_config()
    names = table(spark, sf_dir, "documents").select(requested_model(F.col("doc_id")).alias("model")).distinct()
    params = selection.model_parameters(names, models_table(spark, config))
    value = selection.ttft_ms(F.col("param_count"), F.col("batch_size"), F.col("context_size"), config.flops, config.hbm)
    return params.select("model", F.round(value, 3).alias("base_ttft"))


SQL["base_ttft"] = """
WITH names AS (SELECT DISTINCT CASE WHEN doc_id % 4 <> 0 THEN 'auto' ELSE ['phi4', 'gemma3:27b', 'mistral-small3.1', 'unlisted-model'][((doc_id // 4) % 4 + 1)::INT] END AS model FROM documents),
p(model, n, b, s) AS (VALUES ('phi4', 14e9, 512.0, 16384.0), ('gemma3:27b', 27e9, 512.0, 16384.0), ('mistral-small3.1', 22e9, 512.0, 16384.0)),
j AS (SELECT names.model, coalesce(n, 7e9) AS n, coalesce(b, 512.0) AS b, coalesce(s, 256.0) AS s FROM names LEFT JOIN p USING (model))
SELECT model, round((2 * n * b * s / 312e12 + 2 * n / 2e12) * 1000, 3) AS base_ttft FROM j"""


@query
def first_listed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First listed model for each vector's label read as a category index; some are out of range."""
    rows = embeddings(spark, sf_dir).select("vec_id", (F.col("label") * 2).cast("int").alias("category_idx"))
    return selection.first_listed(scores_table(spark, default_config()), "mistral-small3.1", rows).select("vec_id", "category_idx", "model")


SQL["first_listed_model"] = f"""WITH {SQL_SCORES}
SELECT vec_id, (label * 2)::INT AS category_idx, coalesce(s.model, 'mistral-small3.1') AS model
FROM embeddings e LEFT JOIN scores s ON s.category_idx = e.label * 2 AND s.pos = 0"""


@query
def latency_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total and mean latency per class of scored rows."""
    rows = embeddings(spark, sf_dir).select("vec_id", centroid_head(spark, sf_dir).score(F.col("embedding")).alias("s"))
    return rows.groupBy(F.col("s.class").alias("class")).agg(
        F.sum(F.col("vec_id") % 100).alias("total_ms"), F.round(F.avg(F.col("vec_id") % 100), 6).alias("mean_ms"), F.count("*").alias("n")
    )


SQL["latency_per_class"] = f"""WITH {SQL_HEAD}
SELECT class, sum(vec_id % 100)::BIGINT AS total_ms, round(avg(vec_id % 100), 6) AS mean_ms, count(*) AS n FROM head GROUP BY class"""

