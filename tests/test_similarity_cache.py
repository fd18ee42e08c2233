"""Similarity search and the cache against plain loops over small data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gatelane.operators import cache
from gatelane.operators.prefix import running_totals
from gatelane.operators.selection import inflight_load
from gatelane.operators.similarity import LinearHead, best_match
from gatelane.settings import CacheOptions
from gatelane.streaming import runs, state


def unit_rows(n, dim, seed, clusters=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    if clusters:
        v = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] * 3 + v * 0.4
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def table(spark, vectors, **cols):
    frame = pd.DataFrame({"id": range(len(vectors)), "v": [list(map(float, x)) for x in vectors], **cols})
    return spark.createDataFrame(frame)


@pytest.mark.parametrize("pivots,clusters", [(0, 0), (8, 6), (16, 0)])
def test_best_match_is_exact(spark, pivots, clusters):
    e, q = unit_rows(150, 8, 1, clusters), unit_rows(90, 8, 2, clusters)
    e[10] = e[5]  # a tie
    q[0] = e[10]
    found = best_match(table(spark, q), table(spark, e), "id", "id", "v", "v", pivots=pivots, block_rows=16)
    got = {r.id: (r.match_id, round(r.score, 6)) for r in found.collect()}
    scores = np.round(q @ e.T, 9)
    assert got == {i: (int(s.argmax()), round(float(s.max()), 6)) for i, s in enumerate(scores)}
    assert got[0][0] == 5


def test_threshold_with_pivots_is_exact(spark):
    e, q = unit_rows(300, 6, 3, 10), unit_rows(200, 6, 4, 10)
    args = ("id", "id", "v", "v")
    plain = best_match(table(spark, q), table(spark, e), *args, min_score=0.9, block_rows=32).collect()
    cells = best_match(table(spark, q), table(spark, e), *args, min_score=0.9, pivots=12, block_rows=32).collect()
    assert sorted(plain) == sorted(cells) and 0 < len(plain)


@pytest.mark.parametrize("pivots", [4, 30, 120])
@pytest.mark.parametrize("names", [False, True])
def test_pivots_without_the_query_itself(spark, pivots, names):
    v = unit_rows(120, 8, 6)
    df = table(spark, v)
    if names:
        df = df.withColumn("id", F.lpad(F.col("id").cast("string"), 5, "0"))
    found = best_match(df, df, "id", "id", "v", "v", exclude_self=True, pivots=pivots, block_rows=16)
    scores = np.round(v @ v.T, 9)
    np.fill_diagonal(scores, -2)
    assert {int(r.id): int(r.match_id) for r in found.collect()} == {i: int(s.argmax()) for i, s in enumerate(scores)}


def test_threshold_is_compared_with_the_exact_score(spark):
    q, e = table(spark, [[1.0, 0.0]]), table(spark, [[0.2999999996, 0.0]])
    assert best_match(q, e, "id", "id", "v", "v", min_score=0.3).count() == 0


def test_cells_shrink_with_the_table(spark):
    """Rows that meet grow clearly slower than the square of the table when near ones are asked for."""
    from gatelane.operators.similarity import _cells, _prepare, root_pivots

    met = []
    for n in (400, 1600):
        df = table(spark, unit_rows(n, 4, 7))
        rows = _prepare(df, "id", "v", [], None, {})
        q, e, cell = _cells(rows, rows, [], False, None, root_pivots(df), 0.98, False)
        asked, held = q.groupBy(*cell).agg(F.count("*").alias("a")), e.groupBy(*cell).agg(F.count("*").alias("b"))
        met.append(asked.join(held, cell).agg(F.sum(F.col("a") * F.col("b"))).first()[0])
    print("pairs that meet", met)
    assert met[0] < 400**2 / 2 and met[1] / met[0] < 12


def brute_lookup(requests, entries, threshold, latest):
    order = sorted((t, i) for i, (_, _, t) in enumerate(entries))
    out = []
    for i, (v, model, now) in enumerate(requests):
        seen = [j for t, j in order if t <= now][-latest:]
        near = [(round(float(v @ entries[j][0]), 9), entries[j][2], j) for j in seen if entries[j][1] == model]
        near = [x for x in near if x[0] >= threshold]
        out.append(max(near)[2] if near else None)
    return out


@pytest.mark.parametrize("latest", [1, 7, 500])
def test_lookup_sees_the_latest_entries(spark, latest):
    v = unit_rows(160, 5, 5, 9)
    model = np.array(["a" if i % 3 else "b" for i in range(160)])
    ts = np.array([float(i // 2) for i in range(160)])
    df = table(spark, v, model=model, ts=ts, resp=ts + 3)
    done = cache.lookup(df, df, CacheOptions(0.9, latest, 0), "id", "id", "model", "v", "ts", "resp", block_rows=16).orderBy("id").collect()
    want = brute_lookup([(v[i], model[i], ts[i]) for i in range(160)], [(v[i], model[i], ts[i] + 3) for i in range(160)], 0.9, latest)
    assert [None if r.match_id is None else int(r.match_id) for r in done] == want


@pytest.mark.parametrize("name", ["conversations", "events"])
def test_streams_read_files_and_folders(spark, tmp_path, name):
    source = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    source.repartition(5).write.parquet(str(tmp_path / "many" / f"{name}.parquet"))
    source.coalesce(1).write.parquet(str(tmp_path / "many" / f"{name}_old.parquet"))
    counts = []
    for folder in ("/root/testdata/sf0.001", str(tmp_path / "many")):
        read = runs.collect_append(runs.table_stream(spark, folder, name), "stream-test")
        counts.append((read.count(), read.distinct().count()))
    assert counts[0] == counts[1] == (source.count(), source.distinct().count())


STREAMS = ["streaming_route", "streaming_counters", "streaming_category_totals", "streaming_token_rate", "streaming_reroute_rate",
           "streaming_p95", "streaming_pairing", "streaming_cache", "streaming_load"]


@pytest.fixture(scope="module")
def folder_tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("folders")
    for name in ("documents", "events", "embeddings", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", STREAMS)
def test_streaming_queries_on_folder_tables(spark, folder_tables, name):
    from gatelane.catalog import all_queries

    rows = [sorted(map(tuple, all_queries()[name](spark, d).collect()), key=repr) for d in ("/root/testdata/sf0.001", folder_tables)]
    assert rows[0] and rows[0] == rows[1]


def test_lookup_rules(spark):
    v = np.eye(3)[[0, 0, 1]]
    entries = table(spark, v, model=["a", "b", "a"], resp=[10.0, 10.0, None]).withColumn("resp", F.when(~F.isnan("resp"), F.col("resp")))
    ask = table(spark, np.eye(3)[[0, 0, 0, 1]], model=["a", "a", "c", "a"], ts=[9.0, 75.0, 20.0, 20.0])
    run = lambda **k: [r.hit for r in cache.lookup(ask, entries, CacheOptions(1.0, 0, 60), "id", "id", "model", "v", "ts", "resp", **k).orderBy("id").collect()]
    assert run() == [False, False, False, False]  # too early, expired, other model, pending
    assert run(expire="on_write") == [False, True, False, False]
    off = cache.lookup(ask, entries, CacheOptions(enabled=False), "id", "id", "model", "v", "ts", "resp")
    assert not any(r.hit for r in off.collect())


def brute_fill(events):
    queues, out = {}, []
    for ts, is_response, ident, query in sorted(events):
        if not is_response:
            queues.setdefault(query, []).append(ident)
        elif queues.get(query):
            out.append((queues[query].pop(0), ident))
    return sorted(out)


def test_fill_is_a_queue(spark):
    rng = np.random.default_rng(6)
    # one query text holds half of the events
    events = [(float(t), bool(rng.integers(0, 2)), t, "hot" if rng.random() < 0.5 else f"q{rng.integers(0, 4)}") for t in range(600)]
    rows = spark.createDataFrame([(t, r, i, q) for t, r, i, q in events], "ts double, r boolean, id long, q string")
    pend = rows.filter("not r").select("q", F.col("id").alias("pid"), "ts")
    resp = rows.filter("r").select("q", F.col("id").alias("rid"), F.col("ts").alias("rts"))
    got = cache.fill(pend, resp, "q", "pid", "rid", "ts", "rts", bucket_seconds=37).collect()
    assert sorted((r.pid, r.rid) for r in got) == brute_fill(events)


def test_load_never_below_zero(spark):
    rng = np.random.default_rng(7)
    steps = [(i, "m" if rng.random() < 0.7 else "n", int(rng.choice([-1, 1]))) for i in range(500)]
    df = spark.createDataFrame(steps, "i int, model string, step int")
    got = {r.i: r.load for r in inflight_load(df, "model", ["i"], F.col("step"), F.floor(F.col("i") / 23)).collect()}
    load, expected = {}, {}
    for i, m, s in steps:
        load[m] = max(0, load.get(m, 0) + s)
        expected[i] = load[m]
    assert got == expected


def test_running_totals_without_key(spark):
    df = spark.range(100).withColumn("x", (F.col("id") % 7) - 3)
    rows = running_totals(df, [], ["id"], F.col("x"), F.floor(F.col("id") / 9)).orderBy("id").collect()
    sums = np.cumsum([(i % 7) - 3 for i in range(100)])
    assert [r.running for r in rows] == list(sums) and [r.position for r in rows] == list(range(1, 101))
    assert [r.running_min for r in rows] == list(np.minimum.accumulate(sums))


def test_head_ties_nulls_and_partitions(spark):
    head = LinearHead(np.array([[1.0, 0.0], [0.0, 1.0]]))
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 0.0]), (2, None)], "i int, v array<double>")
    for n in (1, 8):
        rows = df.repartition(n).select("i", head.score(F.col("v")).alias("s")).orderBy("i").collect()
        assert rows[0].s["class"] == 1 and abs(rows[0].s.confidence - 0.5) < 1e-12
        assert rows[1].s["class"] == 0 and rows[2].s is None


def test_retention(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "id int, ts double")
    assert sorted(r.id for r in cache.keep_newest(df, "ts", "id", 3).collect()) == [7, 8, 9]
    assert cache.keep_newest(df, "ts", "id", 0).count() == 10
    assert sorted(r.id for r in cache.unexpired(df, F.col("ts"), F.lit(10.0), 3).collect()) == [8, 9]
    assert cache.count_expired(df, F.col("ts"), F.lit(10.0), 3).first().n_expired == 8


# ------------------------------------------------------------------ streaming state
def cache_events(v, gap=0.5):
    rows = []
    for i, x in enumerate(v):
        x = [float(y) for y in x]
        rows.append(("r", "m", "request", f"{i:04d}", float(i), f"q{i}", x, None))
        rows.append(("r", "m", "response", f"{i:04d}", i + gap, f"q{i}", x, f"a{i}"))
    return rows


SCHEMA = "replica string, model string, kind string, request_id string, ts double, query string, vector array<double>, body string"


def run_cache(spark, tmp_path, rows, options, preload=None, name="in"):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(SCHEMA).parquet(path)
    out = runs.collect_append(state.cache_stream(stream, options, preload), "test-cache")
    return {r.request_id: (r.hit, r.match_id) for r in out.collect()}


def test_streaming_cache(spark, tmp_path):
    v = unit_rows(80, 5, 8, 6)
    got = run_cache(spark, tmp_path, cache_events(v), CacheOptions(0.9, 0, 30))
    expected = {}
    entries = []
    for i in range(80):
        live = [(round(float(v[i] @ v[j]), 9), j) for j in entries if i - (j + 0.5) < 30]
        near = [x for x in live if x[0] >= 0.9]
        if not near:
            entries.append(i)
        expected[f"{i:04d}"] = (bool(near), f"{max(near)[1]:04d}" if near else None)
    assert got == expected


def test_streaming_cache_cap_and_preload(spark, tmp_path):
    rows = cache_events(np.eye(4)[[0, 1, 2, 0]])
    assert run_cache(spark, tmp_path, rows, CacheOptions(0.9, 2, 0))["0003"][0] is False  # pushed out
    entry = [("r", "m", "old", "q", [1.0, 0.0, 0.0, 0.0], "cached", -1.0)]
    preload = spark.createDataFrame(entry, "replica string, model string, request_id string, query string, vector array<double>, body string, ts double")
    assert run_cache(spark, tmp_path, rows, CacheOptions(0.9, 0, 0), preload, "again")["0000"] == (True, "old")


def test_late_rows_are_counted(spark, tmp_path):
    from gatelane.streaming import metrics as SM

    path = str(tmp_path / "late")
    def add(*stamps):
        rows = [(s, "k", 1.0) for s in stamps]
        spark.createDataFrame(rows, "ts long, k string, x double").select(F.timestamp_seconds("ts").alias("ts"), "k", "x").coalesce(1).write.mode("append").parquet(path)
    add(1000, 100_000)
    stream = spark.readStream.schema("ts timestamp, k string, x double").parquet(path)
    panes = SM.pane_sums(stream, "ts", ["k"], F.col("x"), 10, "1 minute")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    runs.log_updates(panes, out, checkpoint).awaitTermination()
    add(50, 100_001)  # the first one is far behind the watermark
    query = runs.log_updates(panes, out, checkpoint)
    query.awaitTermination()
    assert runs.late_rows(query) == 1
    done = {r.pane: r.value for r in runs.latest(spark, out, ["pane", "k"]).collect()}
    assert done == {1000: 1.0, 100_000: 2.0}


def test_a_hot_bucket_is_cut_finer(spark):
    """All rows of one key in one bucket: the same sums, and no cell near the whole."""
    from gatelane.operators.prefix import _sized

    df = spark.range(3000).select("id", F.lit("k").alias("k"), (F.col("id") % 7 - 3).alias("v"), (F.col("id") / 10).alias("t"))
    coarse, fine = F.floor(F.col("t") / 3600), F.floor("t")
    plain = running_totals(df, ["k"], ["t", "id"], F.col("v"), coarse)
    cut = running_totals(df, ["k"], ["t", "id"], F.col("v"), coarse, fine, cell_rows=100)
    columns = ["id", "position", "running", "running_min", "running_min_before"]
    assert sorted(map(tuple, plain.select(columns).collect())) == sorted(map(tuple, cut.select(columns).collect()))
    largest = _sized(df, ["k"], coarse, fine, 100).groupBy("k", "_bucket").count().agg(F.max("count")).first()[0]
    assert largest <= 10
