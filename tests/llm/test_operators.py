"""Each operator against a plain version, with nulls, empty and long texts, ties, repeats, and empty tables."""

import hashlib
import itertools
import random
import time
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelane.llm import bpe, embedding_graph, graph, graph_core, mixture, quality, sharding, simhash, suffix_core, suffix_index, toxicity, url_reputation, warc
from gatelane.llm.common import prepare, written
from gatelane.llm.queries import RULES
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, n long, _one string, _unit int"


@pytest.fixture(scope="module")
def sp(spark):
    return prepare(spark)


def words(rng, n):
    return " ".join("".join(rng.choice(["an", "ble", "th", "er", "ou", "é", "ß", "!", "xi"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts(seed=1, n=60):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(1, 300)) for _ in range(n // 3)]
    passage, out = words(rng, 150), list(base)
    out += [b + " tail" for b in base[:10]] + base[:5] + base[:5]
    out += [words(rng, 20) + "\n" + passage + "\n" + words(rng, 20) for _ in range(6)]
    out += [None, None, "", " \t\n", "a", "a" * 900, "ab" * 700, words(rng, 6000), "x" * 401, "A b C", "a B c", "né " * 400]
    return out


def frame(sp, values, first=0):
    rows = [(first + i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 1, 2, "x", 3) for i, t in enumerate(values)]
    rows += [rows[0], rows[0], (None, values[1], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return sp.createDataFrame(rows, DOCS), [(r[0], r[1]) for r in rows]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def empty(sp):
    return sp.createDataFrame([], DOCS)


def test_components_of_chains_stars_and_loops(sp):
    edges = [(i, i + 1) for i in range(100, 180)] + [(1, i) for i in range(2, 40)] + [(5, 5), (None, 3), (7, None), (2, 1), (500, 501)]
    got = dict(map(tuple, graph.components(sp.createDataFrame(edges, "a long, b long")).collect()))
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == brute.components({x for e in real for x in e}, real)
    assert graph.components(sp.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(sp):
    docs, plain = frame(sp, texts())
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_print("fp"), "component_id")
    assert rows_of(got, *got.columns) == brute.simhash_rows(plain)
    assert simhash.near_duplicates(empty(sp)).count() == 0


def test_simhash_buckets_above_a_piece(sp, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 16)
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 1 << 62))
    values = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 20, (200, 2))} | {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 50)}
    links = simhash.near_links(sp.createDataFrame([(v,) for v in values], "fp long"))
    got = {r.node: r.component for r in graph.components(links).collect()}
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    want = brute.components(values, [(a, b) for a in values for b in values if a < b and near(a, b)])
    assert {v: got.get(v, v) for v in values} == want


def test_urls(sp):
    pages = [
        (1, "http://A.Example.NET/en/x?q=1", 1), (2, "https://example.net", 1), (3, "https://b.example.com/de/#t", 1), (4, "ftp://x.org/fr/y", 1),
        (5, None, 1), (6, "no scheme", 1), (7, "http://notnet/en/", 1), (8, "http://good.io/a", 1), (9, "http://bad.io/a", 1), (9, "http://bad.io/a", 1),
        (None, "http://bad.io/b", 1), (10, "://net/", 1), (11, "http://1.2.3.4/x", 1),
    ]
    pages += [(i, "http://bad.io/p", 1) for i in range(100, 160)] + [(i, "http://good.io/p", 1) for i in range(200, 260)]
    labels = [(i, 0, 0) for i in range(100, 160)] + [(i, 1, 0) for i in range(200, 260)] + [(1, None, 1), (None, 0, 0), (8, 7, 0)]
    left = sp.createDataFrame(pages, "page_id long, url string, good int")
    right = sp.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge(left, right, RULES).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2][:3] == ("example.net", "", None)
    assert got[3] == ("b.example.com", "/de/", "example.com/de/", "block")
    assert got[4] == ("x.org", "/fr/y", "org/fr/", "allow")
    assert got[5][:3] == got[6][:3] == ("", "", None)
    assert got[7][2] is None and got[10] == ("net", "/", "net/", "block")
    assert got[8][3] == "allow" and got[9][3] == "block" and got[None][3] == "block"
    assert url_reputation.judge(left, right, RULES).count() == len(pages)
    assert url_reputation.judge(left, right.limit(0), RULES).count() == len(pages)
    assert url_reputation.judge(left.limit(0), right, RULES).count() == 0


def test_reputation_shrinks_towards_the_domain(sp):
    outcomes = [(f"h{i}.good.io", 30, 30) for i in range(4)] + [(f"h{i}.bad.io", 1, 30) for i in range(4)] + [("new.good.io", 0, 0), ("new.bad.io", 0, 0), ("few.bad.io", 1, 1)]
    got = {r.host: r for r in url_reputation.reputation(sp.createDataFrame(outcomes, "host string, good long, n long")).collect()}
    assert got["new.good.io"].mean > 0.8 > 0.3 > got["new.bad.io"].mean
    assert got["new.bad.io"].mean < got["few.bad.io"].mean < 1
    assert all(r.low < r.mean for r in got.values())


def test_warc_round_trip(sp, tmp_path):
    big, other = "<p>é</p>" * 50, "y" * 100
    pages = [(1, "http://a.b.c/x", big, "z"), (2, "http://b.c", big, "z"), (3, None, big, None), (4, "http://a/\r\n x", other, ""), (5, "u", "y" * 99, ""),
             (6, "u", "y" * 99, ""), (7, "u", None, ""), (8, "u", "", ""), (None, "u", big, ""), (9, "http://a.b.c/x", "\r\n\r\nWARC/1.1" * 20, ""), (4, "http://a/\r\n x", other, "")]
    df = sp.createDataFrame(pages, "page_id long, url string, html string, file string")
    got = rows_of(warc.archive_and_read(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, _, html, _ in pages:
        body = (html or "").encode()
        same = [p for p, _, h, _ in pages if p is not None and (h or "").encode() == body]
        first = min(same) if same else None
        again = i is not None and len(body) >= 100 and i > first
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_warc_lookup_reads_few_blocks(sp, tmp_path):
    rows = [(i, f"com,h{i % 50:02d}){i:05d} {i}", "f", i, 1) for i in range(3000)] + [(i, "com,same) x", "g", i, 1) for i in range(400)]
    captures = sp.createDataFrame(rows, "page_id long, capture string, file string, offset long, length long")
    index = warc.build_index(captures, f"{tmp_path}/cdx", block=100)
    reader = warc.IndexReader(index)
    assert reader.find("com,h07)00007 7") == [[7, "f", 7, 1]]
    assert sorted(e[0] for e in reader.find("com,same) x")) == list(range(400))
    assert reader.find("com,none) 1") == [] and reader.find("") == []
    assert reader.block.cache_info().misses < 12
    asked = sp.createDataFrame([("com,same) x",), ("com,same) x",), ("com,h00)00000 0",), ("zzz",)], "capture string")
    assert warc.lookup(asked, index).count() == 401


def test_bpe_equals_the_library(sp):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(3)
    parts = ["a", "Th", "'s", "'", "re", "!", ".", ",", " ", "  ", "\n", "\t", "\xa0", "　", "\x1c", "é", "à", "ß", "日", "😀", "1", "<|endoftext|>", "​", "\x00", "́", "'S", "\x85"]
    values = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + texts(2)
    docs, plain = frame(sp, values)
    out = bpe.decode(bpe.encode(docs)).collect()
    assert len(out) == len(plain)
    got = Counter((r.doc_id, r.n_tokens, tuple(bpe.unpack(r.ids)), r.decoded) for r in out)
    want = Counter()
    for i, t in plain:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    assert bpe.decode(bpe.encode(empty(sp))).count() == 0


def test_bpe_forced_pairs_are_in_no_token():
    codec = bpe.codec(bpe.default_path())
    tokens = [t for i, t in enumerate(codec.bytes_of) if i not in codec.special.values()]
    inside = np.zeros((256, 256), bool)
    for t in tokens:
        for a, b in zip(t, t[1:]):
            inside[a, b] = True
    assert (codec.joined == inside).all() and not inside.all()


def test_broken_ids_decode_like_the_library():
    from tokenizers import Tokenizer

    library, codec, rng = Tokenizer.from_file(bpe.default_path()), bpe.codec(bpe.default_path()), random.Random(9)
    for _ in range(300):
        ids = [rng.randrange(50257) if rng.random() < 0.3 else rng.randrange(256) for _ in range(6)]
        assert codec.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_toxicity_learns_and_ignores_all_but_text(sp):
    rng = random.Random(5)
    bad, rows, labels = ["vilest", "cretin", "dummkopf"], [], []
    for i in range(900):
        own = words(rng, 40).split()
        if i % 4 == 0:
            own[rng.randrange(len(own))] = rng.choice(bad)
            own[rng.randrange(len(own))] = rng.choice(bad) + "."
        rows.append((i, " ".join(own), "xx", None, 0, 0, 0, "", 0))
        labels.append((i, int(i % 4 == 0), 1))
    docs = sp.createDataFrame(rows + [(None, None, None, None, None, None, None, None, None), (5000, "", "", "", 0, 0, 0, "", 0)], DOCS)
    marks = sp.createDataFrame(labels + [(None, 1, 0), (3, None, 0), (4, 9, 0)], "doc_id long, toxic int, text int")
    model = toxicity.fit(docs, marks)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(out) == 902 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert all(r.held_out == (crc32(str(i).encode()) % 5 == 0) for i, r in out.items() if i is not None)
    held = [r for i, r in out.items() if r.held_out and i is not None and i < 900]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.9
    again = toxicity.score(docs.withColumn("lang", F.lit("de")).withColumn("doc_id", F.col("doc_id") + 1), model).collect()
    assert Counter(r.score for r in again) == Counter(r.score for r in out.values())
    assert toxicity.filter_clean(docs, model).columns == docs.columns
    never = toxicity.fit(docs, marks.limit(0))
    assert toxicity.score(docs, never).filter("predicted = 1").count() == 0
    assert toxicity.score(empty(sp), model).count() == 0


def test_long_texts_pool_over_all_pieces(monkeypatch):
    model = toxicity.empty_model(0.0, 1)
    hashes = toxicity.word_hashes(" ".join(f"w{i}" for i in range(1000)).encode())
    whole = model.pooled([hashes, hashes[:1], hashes[:0]])
    monkeypatch.setattr(toxicity, "PIECE", 37)
    assert np.allclose(whole, model.pooled([hashes, hashes[:1], hashes[:0]]), atol=1e-5)


def test_mixture_targets_and_counts(sp):
    assert mixture.targets([100, 1000, 10], [5, 2, 1], 1110) == pytest.approx([300.0, 780.0, 30.0])
    assert mixture.targets([0, 0], [5, 2], 0) == [0.0, 0.0]
    docs, plain = frame(sp, texts(4))
    df = mixture.mix_by_source(docs)
    out = df.collect()
    assert len(out) == len(plain) and all(r.taken <= 3 * r.size for r in out)
    by = {}
    for r in out:
        by.setdefault(r.pattern, [0, 0, r.source_size, r.target])
        by[r.pattern][0] += r.size
        by[r.pattern][1] += r.taken
    assert set(by) == {'["s0"]', '["s1"]', '["s2"]', "[null]"}
    for pattern, (size, taken, given, target) in by.items():
        largest = max(r.size for r in out if r.pattern == pattern)
        assert size == given and abs(taken - target) <= largest / 2 + 1 and target <= 3 * size
    assert rows_of(df, "doc_id", "taken") == rows_of(mixture.mix_by_source(docs.repartition(7)), "doc_id", "taken")
    assert mixture.mix_by_source(empty(sp)).count() == 0
    taken = mixture.take(docs)
    assert taken.columns == docs.columns and taken.count() > 0 and mixture.take(empty(sp)).count() == 0


def test_mixture_with_overlapping_sources(sp):
    rows = [(i, ["a"], 10) for i in range(40)] + [(100 + i, ["a", "b"], 10) for i in range(40)] + [(200 + i, ["b", "b", "c"], 10) for i in range(10)] + [(300, [], 7)]
    done = mixture.mix(sp.createDataFrame(rows, "id long, m array<string>, size long"), "id", F.col("m"), F.col("size"), weights=(1, 1, 2))
    to = Counter()
    for members, source, given in done.flows:
        assert source in members
        to[source] += given
    goals = {s: t for s, _, t in done.sources}
    assert goals["c"] == 300 and to["c"] == 300  # the limit of its size
    assert all(abs(to[s] - goals[s]) <= 1 for s in "ab")
    assert done.documents.filter("doc_id = 300 AND taken = 0").count() == 1


def test_min_cost_flow_repeats_last():
    flows = mixture.min_cost_flow([100, 100], [[0], [0, 1]], [150, 50])
    assert flows == [{0: 100}, {0: 50, 1: 50}]
    assert sum(mixture.min_cost_flow([10], [[0]], [100])[0].values()) == 30


def test_vectors(sp):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(120, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, (base[i % 5] + rng.normal(size=12) * 0.08).tolist()) for i in range(60)]
    rows += [(2000 + i, base[7].tolist()) for i in range(30)] + [(2100, (3 * base[7]).tolist())]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 12), (3003, [float("nan")] + [1.0] * 11), (3004, [None] + [1.0] * 11), (3005, [float("inf")] * 12), (3006, [1e30] * 12), (None, base[7].tolist())]
    df = sp.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit(1)).withColumn("cell", F.lit("x"))
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = embedding_graph.near_duplicates(df)
    assert rows_of(got, "vec_id", "n_links", "component_id") == sorted(brute.vector_links(single), key=repr)
    assert got.filter("kept != (vec_id = component_id)").count() == 0
    assert embedding_graph.near_duplicates(df.limit(0)).count() == 0
    assert rows_of(embedding_graph.near_duplicates(df.filter("vec_id = 3000")), "vec_id", "n_links", "component_id") == [(3000, 0, 3000)]


def test_two_vectors_with_one_identifier(sp):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.05, 1.0]), (4, [-1.0, 0.0])]
    got = embedding_graph.near_duplicates(sp.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert rows_of(got, "vec_id", "n_links", "component_id") == [(1, 0, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]


def test_vectors_in_many_cells_and_pieces(sp, monkeypatch):
    monkeypatch.setattr(embedding_graph, "CELL", 40)
    monkeypatch.setattr(embedding_graph, "PIECE", 60)
    rng = np.random.default_rng(8)
    centre = rng.normal(size=16)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(500)] + [(1000 + i, (centre + rng.normal(size=16) * 0.1).tolist()) for i in range(200)]
    want = {i: (n, c) for i, n, c in brute.vector_links([(i, [float(np.float32(x)) for x in v]) for i, v in rows])}
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_graph.near_duplicates(sp.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.95


def test_follow_on_visits_reach_all_pieces(sp, monkeypatch):
    """Whatever cluster a query is led to, it visits every piece of it."""
    monkeypatch.setattr(embedding_graph, "CELL", 30)
    monkeypatch.setattr(embedding_graph, "PIECE", 25)
    rng = np.random.default_rng(12)
    rows = np.concatenate([c + rng.normal(size=(240, 16)) * 0.25 for c in rng.normal(size=(2, 16))])
    points = written(sp.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(rows)], "id long, copies long, vector array<double>"), "test-points")
    asked, cells, rounds, search = set(), set(), [], embedding_graph._search

    def watched(nodes, visits, *rest):
        cells.update(r.cell for r in nodes.select("cell").distinct().collect())
        asked.update((r.id, r.cell) for r in visits.select("id", "cell").collect())
        rounds.append(len(asked))
        return search(nodes, visits, *rest)

    monkeypatch.setattr(embedding_graph, "_search", watched)
    embedding_graph.link_points(points, 16, 0.9, 200, 2)
    assert len(rounds) > 1 and rounds[-1] > rounds[0]
    assert all((q, c) in asked for q, k in {(q, c // 100_000) for q, c in asked} for c in cells if c // 100_000 == k)


def test_clusters_grow_beyond_the_centres(sp, monkeypatch):
    """Two codebooks of bounded size name more clusters than either has rows; links are found as before, in every order of the rows."""
    monkeypatch.setattr(embedding_graph, "MOST_CENTRES", 8)
    monkeypatch.setattr(embedding_graph, "CELL", 15)
    monkeypatch.setattr(embedding_graph, "PIECE", 60)
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + rng.normal(size=16) * 0.3).tolist()) for i in range(900)] + [(2000 + i, (centres[0] + rng.normal(size=16) * 0.02).tolist()) for i in range(150)]
    clusters, search = set(), embedding_graph._search

    def watched(nodes, *rest):
        clusters.update(r.cluster for r in nodes.select("cluster").distinct().collect())
        return search(nodes, *rest)

    monkeypatch.setattr(embedding_graph, "_search", watched)
    want = {i: (n, c) for i, n, c in brute.vector_links([(i, [float(np.float32(x)) for x in v]) for i, v in rows])}
    df = sp.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = embedding_graph.near_duplicates(df)
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    assert len(clusters) > 20
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.95
    assert rows_of(found, "vec_id", "n_links") == rows_of(embedding_graph.near_duplicates(df.repartition(5)), "vec_id", "n_links")


def test_nearest_clusters_of_two_codebooks():
    rng = np.random.default_rng(5)
    rows, centres, codes = graph_core.unit(rng.normal(size=(200, 6))), graph_core.unit(rng.normal(size=(7, 6))), rng.normal(size=(9, 6)) * 0.2
    got = embedding_graph._clusters(rows, centres, codes, 7)
    every = (centres[:, None, :] + codes).reshape(-1, 6)
    for row, found in zip(rows, got):
        far = ((every - row) ** 2).sum(1)
        assert list(np.argsort(far, kind="stable")[:7]) == list(found)
    assert len(np.unique(embedding_graph._salt(rows))) == 200


@pytest.mark.parametrize("spread", [0.001, 0.02, 0.1, 0.5])
def test_whole_cells_in_range(spread):
    rng = np.random.default_rng(6)
    for _ in range(30):
        centre = rng.normal(size=8)
        nodes = graph_core.unit(centre + rng.normal(size=(40, 8)) * spread)
        queries = graph_core.unit(centre + rng.normal(size=(40, 8)) * rng.choice([0.01, 0.1, 0.3, 1.0]))
        covered = graph_core.covers(queries, nodes, 0.9)
        assert ((queries @ nodes.T).min(1) >= 0.9)[covered].all()
        if spread < 0.01:
            assert covered[(queries @ graph_core.unit(centre[None])[0]) > 0.93].all()


def test_visits_of_a_cell_are_bounded(sp, monkeypatch):
    """A cell that very many queries visit meets them in chunks, each with all nodes of the cell, each query once."""
    monkeypatch.setattr(embedding_graph, "VISITS", 50)
    nodes = sp.range(30).selectExpr("id", "id % 3 AS cell")
    visits = sp.range(2000).selectExpr("id", "CASE WHEN id < 1900 THEN 0L ELSE 1L END AS cell")
    copies, asked = embedding_graph._in_chunks(nodes, visits)
    groups = {(r.cell, r.chunk): r.n for r in asked.groupBy("cell", "chunk").agg(F.count("*").alias("n")).collect()}
    assert max(groups.values()) <= 100 and sum(groups.values()) == 2000
    found = {(r.cell, r.chunk): r.n for r in copies.groupBy("cell", "chunk").agg(F.countDistinct("id").alias("n")).collect()}
    assert all(found[g] == 10 for g in groups)


def test_repeats_far_into_a_text(sp):
    """A text of 9 MB whose last part, after 8 MiB, has a short period."""
    body = np.random.default_rng(3).integers(97, 123, 8_500_000, dtype=np.uint8).tobytes().decode() + "0" * 600_000
    row = suffix_index.remove_repeats(sp.createDataFrame([(1, body)], "doc_id long, text string")).first()
    assert [tuple(x) for x in row.spans] == [(8_500_000, 9_100_000)] and bytes(row.kept).decode() == body[:8_500_000]


def test_recall_is_audited(sp, monkeypatch):
    """A group that was found whole does not hide lost pairs, and the last attempt is judged too."""
    rng = np.random.default_rng(4)
    pairs = rng.normal(size=(100, 32))
    vectors = np.concatenate([rng.normal(size=32) + rng.normal(size=(200, 32)) * 0.01, pairs, pairs + 0.01])
    points = sp.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(vectors)], "id long, copies long, vector array<double>")
    counts = sp.createDataFrame([(i, 199) for i in range(200)], "id long, n long")
    got = embedding_graph.audit(points, counts, 0.9, 32)
    assert got.recall < 0.9 and got.links == 200 * 199 + 200
    seen = []
    monkeypatch.setattr(embedding_graph, "audit", lambda *a: seen.append(0) or embedding_graph.Audit(0.95, 0.5, 1))
    monkeypatch.setattr(embedding_graph, "link_points", lambda *a: (counts, points.selectExpr("id AS a", "id AS b")))
    with pytest.raises(ValueError, match="recall"):
        embedding_graph.near_duplicates(points, "id", "vector", attempts=1)
    assert len(seen) == 1 + embedding_graph.EXTRA


def test_shards(sp):
    docs, plain = frame(sp, texts(5))
    df = sharding.shard_documents(docs)
    out = df.collect()
    facts = Counter((i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t in plain)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == facts
    per = Counter(r.shard for r in out)
    assert set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in per.items())
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}
    columns = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert rows_of(df, *columns) == rows_of(sharding.shard_documents(docs.repartition(5)), *columns)
    assert rows_of(df, *columns) != rows_of(sharding.shard_documents(docs, seed=8), *columns)
    assert sharding.shard_documents(empty(sp)).count() == 0


def test_communication_matrix():
    parts, shards = np.array([5, 0, 17, 3]), sharding.shard_sizes(25, 4)
    matrix = sharding.communication_matrix(parts, shards, 1)
    assert matrix.sum(1).tolist() == parts.tolist() and matrix.sum(0).tolist() == shards.tolist()
    mean = np.mean([sharding.communication_matrix(parts, shards, s) for s in range(400)], axis=0)
    assert np.abs(mean - np.outer(parts, shards) / 25).max() < 0.35


def test_quality_counts(sp):
    rng = random.Random(2)
    line = words(rng, 8)
    values = texts(6) + [f"{line}\n{line}\n\n \n{line} ", "#a *b $|<>", "w " * 50, line + " x " + line, "a\x0bb\x0cc d e"]
    docs, plain = frame(sp, values)
    labels = sp.createDataFrame([(i, i % 2, 0) for i in range(0, 40, 3)] + [(0, 1, 0), (None, 1, 1), (2, None, 0)], "doc_id long, quality int, text int")
    out = quality.likelihood_filter(docs, labels)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    want = Counter()
    for i, t in plain:
        counts = brute.repeat_counts(t)
        want[(i, *counts, counts[0] < 10 or 100 * counts[4] > 20 * counts[0])] += 1
    assert got == want
    assert out.filter("kept AND base_failed").count() == 0
    assert quality.likelihood_filter(docs, labels.limit(0)).filter("ratio != 0").count() == 0
    assert quality.likelihood_filter(empty(sp), labels).count() == 0


def test_quality_ratio_tells_target_from_junk(sp):
    rng = random.Random(7)
    good, junk = [words(rng, 900) for _ in range(80)], [" | ".join(words(rng, 900).split()) for _ in range(40)]
    docs, _ = frame(sp, good + junk)
    labels = sp.createDataFrame([(i, 1) for i in range(0, 80, 2)] + [(i, 0) for i in range(80, 120, 2)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.likelihood_filter(docs, labels).filter("doc_id IS NOT NULL").collect()}
    assert all(kept[i] for i in range(80)) and not any(kept[i] for i in range(80, 120))


def test_suffix_repeats(sp):
    docs, plain = frame(sp, texts(8))
    want = Counter((i, *facts) for (i, _), facts in zip(plain, brute.repeats([(t or "").encode() for _, t in plain])))
    for batches in (1, 3):
        cut = suffix_index.remove_repeats(docs, batches=batches)
        got = cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")), F.size("spans"), F.sha2("kept", 256))
        assert Counter(map(tuple, got.collect())) == want
    assert suffix_index.remove_repeats(empty(sp)).count() == 0
    cleaned = suffix_index.cut_texts(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(plain)
    assert cleaned.filter("doc_id IS NOT NULL AND n_chars != length(coalesce(text, ''))").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_suffix_repeats_at_every_edge(sp, seed):
    """Matches of 390 to 420 bytes, at text ends, overlapping, periodic and chained."""
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    core = noise(1500)
    values = [noise(rng.randint(0, 300)) + core[a : a + n] + noise(rng.randint(0, 300)) for a, n in
              ((rng.randint(0, 1000), rng.choice([390, 399, 400, 401, 420, 480])) for _ in range(14))]
    values += [core[200:601], core[200:600], noise(50) + "z" * 410, noise(30) + "z" * 399 + noise(30), "z" * 400, ("xyz" * 200)[:401], "q" + "xyz" * 134, noise(2000), core * 2]
    df = sp.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    cut = suffix_index.remove_repeats(df)
    got = rows_of(cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("r"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h")), "doc_id", "n_bytes", "r", "s", "h")
    assert got == sorted(((i, *f) for i, f in enumerate(brute.repeats([v.encode() for v in values]))), key=repr)


@pytest.mark.parametrize("span", [80, 240, 1000])
def test_suffix_repeats_of_other_lengths(sp, span):
    docs, plain = frame(sp, texts(11))
    cut = suffix_index.remove_repeats(docs, span=span)
    got = cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")), F.size("spans"), F.sha2("kept", 256))
    assert Counter(map(tuple, got.collect())) == Counter((i, *f) for (i, _), f in zip(plain, brute.repeats([(t or "").encode() for _, t in plain], span)))


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 100, 3000).astype(np.uint8)
    anchors = suffix_core.window_anchors(text)
    for p in (0, 7, 1234, 2600):
        alone = suffix_core.window_anchors(np.ascontiguousarray(text[p : p + suffix_core.SPAN]))
        assert alone[0] == anchors[p] - p


def test_long_texts_go_in_chunks(monkeypatch):
    rng = np.random.default_rng(2)
    text = rng.integers(97, 123, 20_000).astype(np.uint8)
    whole = suffix_core.window_anchors(text)
    monkeypatch.setattr(suffix_core, "_CHUNK", 3_000)
    assert (suffix_core.window_anchors(text) == whole).all()


def test_index_family_levels(sp):
    batches = [sp.createDataFrame([(k,) for k in keys], "key long") for keys in ([1, 2, 2], [3, 1], [5], [6, 3], [7, 5])]
    family = suffix_index.Family()
    for batch in batches:
        family.add(batch)
    assert sorted(family.levels) == [0, 2]
    assert sorted(r.key for r in family.repeated().collect()) == [1, 2, 3, 5]


def test_family_in_order_of_content(sp, tmp_path):
    """Levels are sorted with right shared prefixes; a saved family takes a later batch and knows all repeats."""
    docs, _ = frame(sp, texts(12))
    halves = [docs.filter(F.coalesce(F.pmod("doc_id", F.lit(3)), F.lit(0)) == i) for i in range(3)]
    first = suffix_index.Family()
    first.add_documents(halves[0])
    first.add_documents(halves[1])
    first.save(str(tmp_path / "family"))
    first.close()
    family = suffix_index.Family.open(sp, str(tmp_path / "family"))
    family.add_documents(halves[2])
    assert sorted(family.levels) == [0, 1]
    every = suffix_index.anchors(suffix_index._keyed(docs, "doc_id", "text")).filter("key IS NOT NULL")
    times = Counter(r.key for r in every.select("key").collect())
    assert {r.key for r in family.repeated().collect()} == {k for k, n in times.items() if n > 1} != set()
    rows = 0
    for level in family.levels.values():
        for path in level.inputFiles():
            part = sp.read.parquet(path).collect()
            rows += len(part)
            heads = [bytes(r.head) for r in part]
            assert heads == sorted(heads) and len(set((h, r.key) for h, r in zip(heads, part))) == len(part)
            for a, b, r in zip(heads, heads[1:], part[1:]):
                assert r.lcp == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    one, two = ({r.key for r in family.levels[i].select("key").collect()} for i in (0, 1))
    assert one | two == set(times) and rows == len(one) + len(two)
    family.close()
    assert sp.read.parquet(str(tmp_path / "family" / "level-1")).count() == len(two)  # what was saved stays


def test_merge_scan_over_batches(sp):
    """Suffixes cut by a batch's end are one; those of arrays only looked at do not come out."""
    import pyarrow as pa

    rows = [(b"ab", 1, 1), (b"ab", 1, 2), (b"ab", 2, 0), (b"ac", 1, 0), (b"ac", 1, 1), (b"ac", 4, 1), (b"bb", 1, 1)]
    for size in (1, 2, 3, 7):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*p), (pa.binary(), pa.int64(), pa.int64()))], ["head", "key", "n"]) for p in parts]
        got = [tuple(r.values()) for b in suffix_index._merge_scan(batches) for r in b.to_pylist()]
        assert got == [(b"ab", 1, 3, None), (b"ac", 1, 2, 1), (b"ac", 4, 1, 2), (b"bb", 1, 1, 0)]
    assert list(suffix_index._merge_scan([])) == []


def best_flow(supply, serves, demand, passes=3):
    """Largest flow and its least cost, by trying everything."""
    states = {tuple(demand): (0, 0)}  # what is still wanted: flow and minus cost so far
    for words, mine in zip(supply, serves):
        after = {}
        for left, (flow, cost) in states.items():
            for given in itertools.product(*(range(min(left[s], passes * words) + 1) for s in mine)):
                if sum(given) <= passes * words:
                    rest = list(left)
                    for s, g in zip(mine, given):
                        rest[s] -= g
                    price = sum(i // words for i in range(sum(given)))
                    got = (flow + sum(given), cost - price)
                    after[tuple(rest)] = max(got, after.get(tuple(rest), got))
        states = after
    flow, cost = max(states.values())
    return flow, -cost


@pytest.mark.parametrize("seed", range(40))
def test_flow_is_the_best_one(seed):
    rng = random.Random(seed)
    m = rng.randint(1, 3)
    serves = [sorted(rng.sample(range(m), rng.randint(1, m))) for _ in range(rng.randint(1, 4))]
    supply = [rng.randint(0, 3) for _ in serves]
    demand = [rng.randint(0, 6) for _ in range(m)]
    flows = mixture.min_cost_flow(supply, serves, demand)
    given = [sum(f.values()) for f in flows]
    assert all(set(f) <= set(mine) and min(f.values(), default=1) > 0 for f, mine in zip(flows, serves))
    assert all(g <= 3 * w for g, w in zip(given, supply)) and all(sum(f.get(s, 0) for f in flows) <= d for s, d in enumerate(demand))
    assert (sum(given), sum(i // w for g, w in zip(given, supply) for i in range(g))) == best_flow(supply, serves, demand)


def test_flow_of_many_patterns():
    """Twenty thousand source sets take seconds."""
    rng = random.Random(1)
    serves = [sorted(rng.sample(range(200), rng.randint(1, 5))) for _ in range(20_000)]
    supply = [rng.randint(0, 10**9) for _ in serves]
    demand = [sum(supply) * rng.randint(0, 3) // 200 for _ in range(200)]
    begun = time.monotonic()
    flows = mixture.min_cost_flow(supply, serves, demand)
    assert time.monotonic() - begun < 60
    assert all(sum(f.values()) <= 3 * w for f, w in zip(flows, supply))
    assert all(sum(f.get(s, 0) for f in flows) <= d for s, d in enumerate(demand[:3]))


def test_discarded_tables_are_gone(sp):
    import os

    from gatelane.llm.common import discard, written

    df = written(sp.range(5), "gone")
    folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(folder)
    discard(df)
    assert not os.path.exists(folder)
