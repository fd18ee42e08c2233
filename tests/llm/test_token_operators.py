"""Word arrays, the token graph, the filter audit and importance resampling against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from gatelane.llm import audit, importance, quality, sharding, token_graph, toxicity
from gatelane.llm.common import prepare
from gatelane.llm.words import IS_CAPITAL, IS_POINT, IS_SYMBOL, Words
from tests.llm import brute
from tests.llm.test_operators import empty, frame, rows_of, texts

SPACED = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def sp(spark):
    return prepare(spark)


def odd_texts(seed=5):
    rng = random.Random(seed)
    parts = ["a", "Bc", "é", "日本", "😀", "#", "$x", "|", " ", "  ", "\n", "\t", "\x0b", "\x0c\r", "\x1c", "\x00", "\xa0", "x" * 63, "y" * 64, "z" * 65, "ZZ" * 100]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["", " ", "w", "w w", "q" * 70 + " " + "q" * 70 + " " + "q" * 71]


def test_words_of_a_batch():
    values = odd_texts()
    column = pa.array(["skipped", *values, "skipped"])[1:-1]
    words = Words(column)
    split = [re.findall(SPACED, t) for t in values]
    flat = [w.encode() for ws in split for w in ws]
    assert [words.bytes_of(i) for i in range(len(words))] == flat
    assert np.diff(words.first_word()).tolist() == [len(w) for w in split]
    assert words.distinct().tolist() == [len(set(w)) for w in split]
    assert words.counts(IS_POINT).tolist() == [len(t) for t in values]
    assert words.counts(IS_CAPITAL).tolist() == [len(re.findall("[A-Z]", t)) for t in values]
    assert words.counts(IS_SYMBOL).tolist() == [len(re.findall("[#$%&*|]", t)) for t in values]
    hashes = words.hashes().tolist()
    assert len(set(hashes)) == len(set(flat)) == len(set(zip(hashes, flat)))
    none = Words(pa.array([], pa.string()))
    assert len(none) == 0 and none.distinct().tolist() == [] and Words(pa.array(["", ""])).distinct().tolist() == [0, 0]


def test_spans_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(Words, "hashes", lambda self, seed=0: np.zeros(len(self), np.uint64))
    values = odd_texts(6)[:40]
    assert Words(pa.array(values)).distinct().tolist() == [len(set(re.findall(SPACED, t))) for t in values]


def graph_texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long = prose(60), prose(4000)
    out = [prose(rng.randint(1, 200)) for _ in range(20)]
    out += [f"{prose(rng.randint(0, 40))}\n {passage}\t{prose(rng.randint(0, 40))}" for _ in range(8)]
    out += [passage, passage + " end", " ".join(passage.split()[:34]), " ".join(passage.split()[:35]), " ".join(passage.split()[5:40])]
    out += [long, long[:9000] + " changed " + long[9000:], long + " " + passage + " " + long[:3000], out[0], out[0]]
    out += ["a " * 34, "a " * 35, "a " * 36, "a b c " * 200, "a " * 3000 + passage, "b a " * 60 + "x " + "b a " * 60, "", None, " \n"]
    return out + texts(9)


def test_token_graph(sp):
    docs, plain = frame(sp, graph_texts())
    got = [
        (r.doc_id, r.n_words, sum(s.end - s.begin for s in r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
        for r in token_graph.remove_repeats(docs).collect()
    ]
    want = [(i, *facts) for (i, _), facts in zip(plain, brute.repeated_words([t for _, t in plain]))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert token_graph.remove_repeats(empty(sp)).count() == 0


@pytest.mark.parametrize("width", [9, 20])
def test_token_graph_of_few_words(sp, width):
    """A tiny vocabulary: branches everywhere, and pieces that repeat inside their document."""
    rng = random.Random(width)
    values = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 120))) for _ in range(60)]
    docs, plain = frame(sp, values)
    got = [(r.doc_id, r.n_words, sum(s.end - s.begin for s in r.spans)) for r in token_graph.remove_repeats(docs, width=width).collect()]
    want = [(i, *facts[:2]) for (i, _), facts in zip(plain, brute.repeated_words([t for _, t in plain], width))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_copies_are_read_again_as_one_path(sp):
    text = " ".join(f"w{i}" for i in range(900))
    docs = sp.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string")
    one, two = token_graph._names("doc_id", "text")
    found = token_graph.pieces(docs.select(one.alias("d1"), two.alias("d2"), docs.text.cast("binary").alias("body")))
    assert found.count() > 5 * 20
    whole = token_graph.paths(found, token_graph.classes(found)).collect()
    assert [(r["first"], r["last"]) for r in whole] == [(0, 900 - 35)] * 5


def audit_rows(docs, labels):
    """docs: (doc_id, source, text)"""
    lowest = {}
    for i, _, t in docs:
        if i is not None:
            lowest[t or ""] = min(i, lowest.get(t or "", i))
    facts = []
    for i, source, t in docs:
        t = t or ""
        ws = re.findall(SPACED, t)
        fails = "A" * (len(ws) < 50) + "B" * (100 * len(set(ws)) < 65 * len(ws)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t))
        fails += "D" * bool(re.search("[#$%&*|]", t)) + "E" * (i is not None and i > lowest[t])
        facts.append((source or "", fails, any(q == 1 and d == i for d, q, _ in labels if d is not None), any(x == 1 and d == i for d, _, x in labels if d is not None)))
    out, total = {}, Counter()
    for part in {f[0] for f in facts}:
        for order in map("".join, permutations("ABCDE")):
            for step, name in enumerate(order):
                row = Counter()
                for p, fails, good, toxic in facts:
                    if p == part:
                        before = set(order[:step]) & set(fails)
                        row["removed"] += name in fails and not before
                        row["kept"] += name not in fails and not before
                        row["redundant"] += name in fails and bool(before)
                        row["unique"] += fails == name
                        row["good"] += name in fails and not before and good
                        row["toxic"] += name in fails and not before and toxic
                total[part, name] += row["removed"]
                out[part, order, step + 1] = tuple(row[c] for c in ("kept", "removed", "redundant", "unique", "good", "toxic"))
    return sorted((*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_interaction_audit(sp):
    docs, _ = frame(sp, texts(3)[:40] + ["Same Text"] * 4 + odd_texts(2)[:12])
    plain = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 50, 2)] + [(4, 1, 0), (4, None, 1), (None, 1, 1), (7, None, None), (9, 1, None)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    marks = sp.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, part int")
    got = audit.interaction_audit(docs, marks)
    assert rows_of(got, *got.columns) == sorted(audit_rows(plain, labels), key=repr)
    assert audit.interaction_audit(empty(sp), marks).count() == 0
    assert audit.interaction_audit(docs, marks.limit(0)).count() == 600 * len({p or "" for _, p, _ in plain})


def importance_rows(docs, target):
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    bucket = lambda w: crc32(w.encode()) % 10000
    own = Counter(bucket(w) for _, t in docs for w in split(t))
    aim = Counter(bucket(w) for t in target for w in split(t))
    S, T = own.total(), aim.total()
    rows = []
    for i, t in docs:
        ws = split(t)
        weight = sum(math.floor(1000 * math.log((aim[b] + 1) * (S + 10000) / ((own[b] + 1) * (T + 10000)))) for b in map(bucket, ws))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(ws), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = order[: 10 * len(order) // 100]
    place = {}
    for n, r in enumerate(drawn, 1):
        place.setdefault(r, []).append(n)
    return sorted(((*r, place[r].pop(0) if place.get(r) else None) for r in rows), key=repr)


def test_resampling(sp):
    docs, plain = frame(sp, texts(4, 300) + odd_texts(3))
    target = [t for _, t in plain[:15]] + [None, "", "a B"]
    aim = sp.createDataFrame([(t, i) for i, t in enumerate(target)], "text string, weight int")
    got = importance.resample(docs, aim)
    assert rows_of(got, *got.columns) == importance_rows(plain, target)
    assert importance.resample(empty(sp), aim).count() == 0
    assert [r.weight for r in importance.resample(docs, aim.limit(0)).collect()] is not None


def test_resampling_of_one_row_repeated(sp):
    docs = sp.createDataFrame([(5, "w " * 30)] * 500, "doc_id long, text string")
    ranks = sorted(r["rank"] for r in importance.resample(docs, docs.limit(1)).collect() if r["rank"])
    assert ranks == list(range(1, 51))


def test_sliced_weights_with_large_counts():
    rng = np.random.default_rng(1)
    rows, buckets = np.sort(rng.integers(0, 5, 20000)), rng.integers(0, 30, 20000)
    gain = rng.integers(-9000, 9000, importance.BUCKETS)
    want = [int(gain[buckets[rows == i]].sum()) for i in range(6)]
    assert importance.sliced_weights(rows, buckets, 6, importance.gain_planes(gain)).tolist() == want
    assert importance.sliced_weights(rows, buckets, 6, importance.gain_planes(gain * 0)).tolist() == [0] * 6


@pytest.mark.parametrize("total", [10**9, 10**10, 10**12])
def test_shards_of_very_many_rows(total):
    rng = np.random.default_rng(3)
    parts = rng.multinomial(total, np.full(9, 1 / 9))
    shards = sharding.shard_sizes(total, 8)
    deals = np.array([sharding.communication_matrix(parts, shards, (7, i)) for i in range(3)])
    assert (deals >= 0).all() and (deals.sum(axis=2) == parts).all() and (deals.sum(axis=1) == shards).all()
    want = parts[:, None] * (shards / total)[None, :]
    spread = np.sqrt(want * (1 - 1 / 8) * (1 - parts[:, None] / total))
    off = (deals - want) / spread
    assert abs(off.mean()) < 0.2 and 0.8 < off.std() < 1.2 and np.abs(off).max() < 6


def test_large_totals_follow_the_law(monkeypatch):
    """The sampler for large totals, made to draw small ones, against the exact probabilities."""
    monkeypatch.setattr(sharding, "_LIBRARY_LIMIT", 0)
    for good, bad, drawn in ((12, 20, 9), (5, 5, 10), (40, 3, 20), (7, 0, 3), (0, 9, 4), (30, 30, 0)):
        rng = np.random.default_rng(1)
        seen = Counter(sharding.hypergeometric(rng, good, bad, drawn) for _ in range(4000))
        for k in range(max(0, drawn - bad), min(good, drawn) + 1):
            p = math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn)
            assert abs(seen[k] - 4000 * p) < 5 * math.sqrt(4000 * p * (1 - p)) + 1
        assert sum(seen.values()) == 4000 and all(max(0, drawn - bad) <= k <= min(good, drawn) for k in seen)


def test_two_levels_deal_exact_counts(sp):
    counts = sp.createDataFrame([(i, (i * 37) % 11 + 1) for i in range(200)], "_part int, _n long")
    total = sum(r["_n"] for r in counts.collect())
    rows = {r["_part"]: r["_upto"] for r in sharding.part_cuts(counts, total, 8, 5, 15).collect()}
    deal = np.array([np.diff([0, *rows[i]]) for i in range(200)])
    assert (deal.sum(axis=0) == sharding.shard_sizes(total, 8)).all() and (deal >= 0).all()
    assert [int(x) for x in deal.sum(axis=1)] == [(i * 37) % 11 + 1 for i in range(200)]


def test_quality_verdict(sp):
    """The ratio by plain counting over the same buckets, and what it decides."""
    docs, plain = frame(sp, texts(12) + ["x | y | z " * 9, "good words here again " * 12])
    labels = sp.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 60, 2)] + [(0, 1), (None, 1), (4, None)], "doc_id long, quality int")
    trusted = {i for i in range(0, 60, 2) if i % 3 == 0}

    def grams(t):
        ws = (t or "").encode().split()
        hashed = [crc32(w) for w in ws]
        pairs = [(a * 0x100000001B3 + b + (1 << 33)) % 2**64 for a, b in zip(hashed, hashed[1:])]
        return ws, [h * 0x9E3779B97F4A7C15 % 2**64 >> 48 for h in hashed + pairs]

    raw, aim = Counter(), Counter()
    for i, t in plain:
        raw.update(grams(t)[1])
        aim.update(grams(t)[1] if i in trusted else ())
    n = quality.BUCKETS
    corpus = lambda b: (raw[b] + 1) / (raw.total() + n)
    score = lambda b: math.log((aim[b] + n * corpus(b)) / (aim.total() + n) / corpus(b))
    want = []
    for i, t in plain:
        ws, found = grams(t)
        ratio = sum(map(score, found)) / len(found) if found else 0.0
        counts = brute.repeat_counts(t)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        want.append((i, round(ratio, 9), not failed and ratio >= quality.LEAST))
    got = [(r.doc_id, round(r.ratio, 9), r.kept) for r in quality.likelihood_filter(docs, labels).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len({k for _, _, k in want}) == 2


def test_only_trusted_texts_move(sp, tmp_path):
    """The semi-join of the trusted rows reads the texts through a bloom filter of the identifiers, and puts the session's settings back."""
    sp.range(3000).selectExpr("id AS doc_id", "concat('text of ', id) AS text", "id AS _ident").write.parquet(f"{tmp_path}/d")
    sp.range(3000).selectExpr("id AS doc_id", "int(id % 50 = 0) AS quality").write.parquet(f"{tmp_path}/l")
    docs, labels = sp.read.parquet(f"{tmp_path}/d"), sp.read.parquet(f"{tmp_path}/l")
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = sp.conf.get(key)
    with quality.bloom_joins(sp):
        rows = quality.trusted_rows(docs, labels)
        assert "might_contain" in rows._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r.text for r in rows.collect()) == sorted(f"text of {i}" for i in range(0, 3000, 50))
    assert sp.conf.get(key) == before
    # Repeated labels count a row once, rows that repeat count each time.
    again = quality.trusted_rows(docs.filter("doc_id < 60").unionAll(docs.filter("doc_id = 50")), labels.unionAll(labels))
    assert sorted(r.text for r in again.collect()) == ["text of 0", "text of 50", "text of 50"]


def test_training_rows_are_bounded(sp):
    """A labelled identifier with very many rows counts once, and the words of the sample have a limit."""
    rng = random.Random(3)
    bad, good = "vile scum hate", "calm lake tree"
    rows = [(i, " ".join(rng.choice((bad if i % 2 else good).split()) for _ in range(30))) for i in range(200)] + [(1, f"other text {k}") for k in range(500)]
    docs = sp.createDataFrame(rows, "doc_id long, text string")
    labels = sp.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    told = {r.doc_id: r.predicted for r in toxicity.score(docs.filter("doc_id != 1"), model).collect()}
    assert sum(told[i] == i % 2 for i in told) > 0.95 * len(told)
    few = toxicity.fit(docs, labels, most_words=600)
    assert len(toxicity.score(docs, few).collect()) == 700
    assert toxicity.score(docs, toxicity.fit(docs, labels, most_words=0)).agg({"score": "max"}).first()[0] <= 1
