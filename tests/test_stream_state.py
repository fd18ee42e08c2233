"""Keyed state of streams: what is written, and loads carried from batch to batch."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gatelane.settings import CacheOptions
from gatelane.streaming import state
from tests.test_similarity_cache import cache_events, unit_rows


class Map:
    """Stands for a map state and counts what is written."""

    def __init__(self):
        self.rows, self.written, self.removed = {}, [], []

    def iterator(self):
        return iter(list(self.rows.items()))

    def keys(self):
        return iter(list(self.rows))

    def updateValue(self, key, value):
        self.rows[key] = value
        self.written.append(key)

    def removeKey(self, key):
        del self.rows[key]
        self.removed.append(key)


class Handle:
    def __init__(self, entries):
        self.entries = entries

    def getMapState(self, *_):
        return self.entries


COLUMNS = ["replica", "model", "kind", "request_id", "ts", "query", "vector", "body"]


def run_batches(batches, options, expire="on_read"):
    entries, out, sizes = Map(), [], []
    for batch in batches:
        processor = state.CacheProcessor(options, expire)
        processor.init(Handle(entries))
        entries.written, entries.removed = [], []
        for part in processor.handleInputRows(("r", "m"), iter([pd.DataFrame(batch, columns=COLUMNS)]), None):
            out += [(r.request_id, r.hit, r.match_id) for r in part.itertuples()]
        sizes.append((len(entries.written), len(entries.removed), len(entries.rows)))
    return out, sizes


@pytest.mark.parametrize("options", [CacheOptions(0.9, 0, 0), CacheOptions(0.9, 0, 30), CacheOptions(0.9, 7, 0), CacheOptions(0.8, 5, 40), CacheOptions(2.0, 3, 0)])
def test_batches_of_any_size_agree(monkeypatch, options):
    events = sorted(cache_events(unit_rows(150, 5, 8, 9)), key=lambda r: r[4])
    one = run_batches([events], options)[0]
    for size in (1, 7, 64):
        assert run_batches([events[i : i + size] for i in range(0, len(events), size)], options)[0] == one
    monkeypatch.setattr(state, "BLOCK", 4)
    assert run_batches([events], options)[0] == one


def test_written_state_follows_the_changes():
    v = unit_rows(400, 6, 9, 400)
    events = sorted(cache_events(v), key=lambda r: r[4])
    batches = [events[i : i + 80] for i in range(0, 800, 80)]
    _, sizes = run_batches(batches, CacheOptions(2.0, 100, 0))  # nothing hits: 40 new entries a batch
    assert all(written <= 41 and removed <= 41 for written, removed, _ in sizes)
    assert sizes[-1][2] == 100 and sum(w for w, _, _ in sizes) < 450
    again = [(*r[:3], "x" + r[3], r[4] + 1000, *r[5:]) for r in events if r[2] == "request"][-100:]
    _, sizes = run_batches([*batches, again], CacheOptions(0.999, 0, 0))
    assert sizes[-1][:2] == (0, 0)  # all hit: nothing is written


def test_state_is_bounded_without_a_cap(monkeypatch):
    monkeypatch.setattr(state, "MOST_ENTRIES", 20)
    events = sorted(cache_events(unit_rows(90, 6, 9, 90)), key=lambda r: r[4])
    assert run_batches([events[:90], events[90:]], CacheOptions(2.0, 0, 0))[1][-1][2] == 20


def test_loads_go_on_from_batch_to_batch(spark, tmp_path):
    rng, path = random.Random(4), str(tmp_path / "in")
    rows = [(rng.choice(["a", "a", "a", "b", None]), "m", i, float(i // 3), rng.choice([1, -1, -1, 1, 1 if i % 50 < 25 else -1])) for i in range(900)]
    kind = "replica string, model string, event_id long, ts double, step int"
    for part in range(0, 900, 300):
        spark.createDataFrame(rows[part : part + 300], kind).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.event_id: (r.replica, r.load) for r in state.collect_load(stream).collect()}
    loads, want = {}, {}
    for replica, _, i, _, step in rows:
        loads[replica] = max(0, loads.get(replica, 0) + step)
        want[i] = (replica, loads[replica])
    assert got == want and any(x == 0 for _, x in want.values())
