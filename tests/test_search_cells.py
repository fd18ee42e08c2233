"""How much of the table the similarity search meets."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatelane.operators import cache, similarity
from gatelane.settings import CacheOptions
from tests.test_similarity_cache import table, unit_rows


@pytest.fixture
def met(monkeypatch):
    """Per call of the blocked search: query rows and block pairs."""
    calls, real = [], similarity._blocked

    def counted(queries, entries, cell, kernel, out, block_rows):
        blocks = lambda df, name: df.groupBy(*cell).agg(F.ceil(F.count("*") / block_rows).alias(name))
        pairs = blocks(queries, "a").join(blocks(entries, "b"), cell) if cell else blocks(queries, "a").crossJoin(blocks(entries, "b"))
        calls.append((queries.count(), pairs.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0))
        return real(queries, entries, cell, kernel, out, block_rows)

    monkeypatch.setattr(similarity, "_blocked", counted)
    return calls


@pytest.mark.parametrize("itself", [False, True])
def test_two_passes_without_a_floor_skip_most_cells(spark, met, itself):
    v = unit_rows(600, 12, 5, 24)
    df = table(spark, v)
    found = similarity.best_match(df, df, "id", "id", "v", "v", exclude_self=not itself, pivots=similarity.root_pivots(df), block_rows=64)
    scores = np.round(v @ v.T, 9)
    if not itself:
        np.fill_diagonal(scores, -2)
    assert {r.id: r.match_id for r in found.collect()} == {i: int(s.argmax()) for i, s in enumerate(scores)}
    (first, _), (more, _) = met
    assert first == 600 and first + more < 0.4 * 600 * similarity.root_pivots(df)


def test_two_passes_with_keys_times_and_no_candidate(spark):
    v = unit_rows(200, 6, 7, 8)
    df = table(spark, v, model=[f"m{i % 5 if i else 9}" for i in range(200)], ts=[float(i // 3) for i in range(200)])
    args = dict(query_id="id", entry_id="id", query_vector="v", entry_vector="v", on=["model"], query_time=F.col("ts"), entry_time=F.col("ts"), prefer="newest", exclude_self=True, block_rows=16)
    plain = similarity.best_match(df, df, **args).collect()
    assert sorted(plain) == sorted(similarity.best_match(df, df, pivots=9, **args).collect()) and 0 < len(plain) < 200
    assert similarity.best_match(df, df.limit(0), pivots=9, **args).count() == 0
    assert similarity.best_match(df.limit(0), df, pivots=9, **args).count() == 0


@pytest.mark.parametrize("latest", [1, 40, 64, 150])
def test_capped_lookup_meets_two_windows(spark, met, latest):
    pairs = []
    for n in (1000, 2000, 4000):
        rows = spark.range(n).select(
            "id", F.lit("m").alias("model"), F.array(F.cos("id"), F.sin("id")).alias("v"), F.timestamp_seconds("id").alias("ts"), F.timestamp_seconds(F.col("id") + 3).alias("response_ts")
        )
        found = cache.lookup(rows, rows, CacheOptions(0.5, latest, 0), "id", "id", "model", "v", "ts", "response_ts", block_rows=64)
        hits = {r.id: r.match_id for r in found.filter("hit").collect()}
        pairs.append(met.pop()[1])
        for i in (2, 3, 4, 63, 64, 129, 500, n - 1):
            seen = [e for e in range(max(0, i - 2 - latest), i - 2)]
            near = [(round(float(np.cos(i - e)), 9), e) for e in seen if np.cos(i - e) >= 0.5]
            assert hits.get(i) == (max(near)[1] if near else None), i
    assert pairs[2] <= 2.2 * pairs[1] <= 5 * pairs[0]


@pytest.mark.parametrize("floor", [None, 0.2])
def test_a_row_is_copied_to_few_bins_when_nothing_can_be_ruled_out(spark, monkeypatch, floor):
    """Without structure every cell has to be met; copies per row stay bounded while the cells grow in number."""
    sent, real = [], similarity._blocked
    v = unit_rows(3000, 24, 11)
    df = table(spark, v)

    def counted(queries, entries, cell, *args):
        sent.append(queries.count())
        return real(queries, entries, cell, *args)

    monkeypatch.setattr(similarity, "_blocked", counted)
    found = similarity.best_match(df, df, "id", "id", "v", "v", exclude_self=True, min_score=floor, pivots=200)
    scores = np.round(v @ v.T, 9)
    np.fill_diagonal(scores, -2)
    assert {r.id: r.match_id for r in found.collect()} == {i: int(s.argmax()) for i, s in enumerate(scores) if floor is None or s.max() >= floor}
    assert 3000 * 20 < sum(sent) <= 3000 * similarity.BINS


@pytest.mark.parametrize("itself", [False, True])
@pytest.mark.parametrize("newest", [False, True])
def test_blocks_beyond_the_row_bound_and_tiles(spark, monkeypatch, newest, itself):
    """Several blocks a side and several tiles a block, with ties, times, keys and an entry cap, equal plain loops."""
    monkeypatch.setattr(similarity, "BLOCKS", 2)
    monkeypatch.setattr(similarity, "GROUP_ROWS", 64)
    monkeypatch.setattr(similarity, "TILE", 16)
    v = np.repeat(unit_rows(150, 5, 12, 9), 2, axis=0)
    model, ts = np.array([f"m{i % 2}" for i in range(300)]), np.array([float(i * 7 % 50) for i in range(300)])
    df = table(spark, v, model=model, ts=ts)
    args = dict(query_id="id", entry_id="id", query_vector="v", entry_vector="v", on=["model"], query_time=F.col("ts"), entry_time=F.col("ts"),
                prefer="newest" if newest else "first", exclude_self=not itself, min_score=0.9, block_rows=16)
    scores = np.round(v @ v.T, 9)
    want = {}
    for i in range(300):
        seen = [j for j in range(300) if model[j] == model[i] and ts[j] <= ts[i] and v[i] @ v[j] >= 0.9 and (itself or j != i)]
        if seen:
            want[i] = max(seen, key=lambda j: (scores[i, j], (ts[j], j) if newest else -j))
    for pivots in (0, 12):
        assert {r.id: r.match_id for r in similarity.best_match(df, df, pivots=pivots, **args).collect()} == want


def test_blocks_grow_before_their_number(spark):
    """Without cells the copies of a row stop growing with the table until a task holds as many rows as it may."""
    pairs = []
    for n in (500, 4000, 16000):
        rows = similarity._prepare(spark.range(n).select("id", F.array(F.cos("id"), F.sin("id")).alias("v")), "id", "v", [], None, {})
        one = lambda q, e: pa.table({"n": [q.num_rows * e.num_rows]})
        pairs.append([r.n for r in similarity._blocked(rows, rows, [], one, "n bigint", 64).collect()])
        assert sum(pairs[-1]) == n * n
    assert [len(p) for p in pairs] == [8 * 8, similarity.BLOCKS**2, similarity.BLOCKS**2]
