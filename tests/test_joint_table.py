"""The two-task model on a documents table: every language takes part, and tasks work on whole pieces of it."""

import random
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatelane.catalog import training
from gatelane.functions import texts
from gatelane.plans import joint


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """200 documents in 70 languages; some have none."""
    path = str(tmp_path_factory.mktemp("languages"))
    rows = [(i, f"word{i % 70} tail{i % 7} mail{i}@host.org", None if i % 40 == 39 else f"l{i % 70:02}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return path


def test_every_language_is_a_category(spark, many, monkeypatch):
    got = {r.ident: r.category for r in training._joint_rows(spark, many).collect()}
    assert len(got) == 200
    assert all(category == (None if i % 40 == 39 else i % 70) for i, category in got.items())
    shapes, train = [], joint.train_joint
    monkeypatch.setattr(joint, "train_joint", lambda rows, shape, *a: shapes.append(shape) or train(rows, shape, *a))
    out = training.joint_task_words(spark, many).collect()
    assert [s.classes for s in shapes] == [70]
    assert len(out) == 200 and all(r.n_words == 3 and r.within and r.loss_falls for r in out)


def test_a_large_vocabulary_is_numbered_alike(spark, many, monkeypatch):
    monkeypatch.setattr(training.corpus, "FEW_LABELS", 10)
    assert {r.ident: r.category for r in training._joint_rows(spark, many).collect()} == {i: None if i % 40 == 39 else i % 70 for i in range(200)}


def test_tables_without_a_language(spark, tmp_path):
    kind = "doc_id long, text string, lang string"
    spark.createDataFrame([(1, "a b", None), (2, None, None)], kind).write.parquet(f"{tmp_path}/nulls/documents.parquet")
    assert sorted((r.ident, r.category) for r in training._joint_rows(spark, f"{tmp_path}/nulls").collect()) == [(1, None), (2, None)]
    got = {r.doc_id: r.n_words for r in training.joint_task_words(spark, f"{tmp_path}/nulls").collect()}
    assert got == {1: 2, 2: 0}


def test_many_classes_meet_in_bounded_blocks(monkeypatch):
    """A task holds a bounded number of class shares, and the sums are those of all rows at once."""
    shape, rng = joint.Shape(500, 64, 4), np.random.default_rng(1)
    flat = shape.start(1)
    lists = lambda n, high: pa.array([rng.integers(0, high, n) for _ in range(300)], pa.list_(pa.int32()))
    rows = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([i * 7 % 500 for i in range(300)], pa.int32()), lists(15, 64), lists(3, 2)], ["ident", "category", "idx", "flags"])
    whole = np.concatenate(list(joint._partial(shape, flat)([rows]))[0]["v"].to_pylist())
    monkeypatch.setattr(joint, "PIECE_SHARES", 2_000)
    assert [b.num_rows for b in joint._pieces([rows], "flags", 500)] == [4] * 75
    assert np.allclose(np.concatenate(list(joint._partial(shape, flat)([rows]))[0]["v"].to_pylist()), whole)


def plain_indices(words, features):
    """The five hashes of every word of one text, word by word."""
    raw = [w.encode() for w in words]
    shapes = [re.sub(rb"[0-9]", b"0", re.sub(rb"[a-z]", b"a", re.sub(rb"[A-Z]", b"A", w))) for w in raw]
    short = [bytes(c for i, c in enumerate(s) if not i or s[i - 1] != c) for s in shapes]
    columns = [[crc32(b"w" + w) for w in raw], [crc32(b"s" + s) for s in shapes], [crc32(b"q" + s) for s in short]]
    columns += [[crc32(b"<" + w) for w in [b"", *raw][: len(raw)]], [crc32(b">" + w) for w in [*raw[1:], b""][: len(raw)]]]
    return np.array(columns, np.int64).reshape(5, -1).T % features


@pytest.mark.parametrize("features", [7, 2048, 1 << 16, 1 << 20])
def test_indices_are_those_of_single_words(features):
    rng = random.Random(features)
    word = lambda: "".join(rng.choice("aab1Zé漢-") for _ in range(rng.choice([1, 2, 5, 63, 64, 65, 300])))
    docs = [None, [], ["a"], *([word() for _ in range(rng.choice([0, 1, 2, 40]))] for _ in range(30)), []]
    flags = [None, [1], [], *([rng.choice([0, 1, None]) for _ in range(rng.choice([0, len(d), len(d) + 3]))] for d in docs[3:])]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(docs))), pa.array([0] * len(docs), pa.int32()), pa.array(docs, pa.list_(pa.string())), pa.array(flags, pa.list_(pa.int32()))],
        ["ident", "category", "words", "flags"],
    )
    for part in (batch, batch.slice(5, 20)):
        made = list(joint._indexed(features)([part]))
        got = np.concatenate([joint._indices(b.column("idx"), features) for b in made])
        assert (got == np.concatenate([plain_indices(d or [], features) for d in part["words"].to_pylist()])).all()
        told = [f for b in made for f in b.column("flags").to_pylist()]
        assert told == [[-100 if x is None else x for x in [*(f or []), *[None] * len(d or [])][: len(d or [])]] for d, f in zip(part["words"].to_pylist(), part["flags"].to_pylist())]


def test_a_word_costs_no_python_of_its_own(monkeypatch):
    """Hashes are made for different words together, and the sums of long texts by products: few calls, however many words."""
    rng, calls = np.random.default_rng(4), {"crc32": 0, "_summed": 0}
    docs = [[f"w{i}" for i in rng.integers(0, 3000, 1000)] for _ in range(60)]
    rows = pa.RecordBatch.from_arrays(
        [pa.array(range(60)), pa.array([0] * 60, pa.int32()), pa.array(docs, pa.list_(pa.string())), pa.array([[0] * 1000] * 60, pa.list_(pa.int32()))],
        ["ident", "category", "words", "flags"],
    )

    def counted(name, call):
        def run(*args):
            calls[name] += 1
            return call(*args)

        return run

    for name in calls:
        monkeypatch.setattr(joint, name, counted(name, getattr(joint, name)))
    made = list(joint._indexed(1 << 11)([rows]))
    shape = joint.Shape(4, 1 << 11, 8)
    list(joint._partial(shape, shape.start(1))(made))
    assert calls["crc32"] <= 10 * len(made) and calls["_summed"] == 0


def test_short_texts_have_the_same_sums(monkeypatch):
    """Texts too short for the matrix of texts and indices are summed word by word."""
    shape, rng = joint.Shape(3, 2048, 8), np.random.default_rng(5)
    flat = shape.start(2)
    sizes = rng.integers(0, 6, 500)
    lists = lambda n, high: pa.array([rng.integers(0, high, n * k) for k in sizes], pa.list_(pa.int32()))
    rows = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(rng.integers(0, 4, 500), pa.int32()), lists(joint.PER_WORD, 2048), lists(1, 2)], ["ident", "category", "idx", "flags"])
    assert joint._Piece(shape, rows).counts is None
    short = np.concatenate(list(joint._partial(shape, flat)([rows]))[0]["v"].to_pylist())
    monkeypatch.setattr(joint, "CELLS_PER_WORD", 1 << 20)
    assert joint._Piece(shape, rows).counts is not None
    assert np.allclose(np.concatenate(list(joint._partial(shape, flat)([rows]))[0]["v"].to_pylist()), short)


def test_words_are_cut_at_the_same_characters(spark):
    every = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x10000), 0x10000, 0x1F600, 0x10FFFF]]
    rows = spark.createDataFrame(pa.table({"c": every, "t": [f"a{c}b{c}{c}" for c in every]}))
    plain = F.filter(F.split("t", texts.SPACES), lambda w: w != "")
    assert rows.filter(~texts.words(F.col("t")).eqNullSafe(plain)).count() == 0
    assert rows.filter(F.size(texts.words(F.col("t"))) == 2).count() == 29


def test_labels_follow_the_plain_rule(spark):
    cases = ["", None, "a 555-12-3456 x", "mail me@host.org, (555) 123-4567.", "Xavier met Johnson in A Paris a@b.c 1234567890 x1234567890", "johnson Xavier", "Élan AJohn Be", "١٢٣-٤٥-٦٧٨٩ 123-45-67890"]
    rows = spark.createDataFrame([(t,) for t in cases], "t string").withColumn("w", texts.words(F.col("t")))
    pattern = re.compile(f"{texts.EMAIL}|{texts.PHONE}|{texts.SSN}", re.A)
    names = {part for name in texts.KNOWN_NAMES for part in name.split()}
    for r in rows.select("t", "w", texts.word_pii_labels(F.col("t")).alias("l"), texts.word_pii_labels(F.col("t"), F.col("w")).alias("given")).collect():
        named = r.t is not None and any(n in r.t for n in names)
        assert r.l == r.given == (None if r.t is None else [int(bool(pattern.search(w)) or named and w[0].isupper() and len(w) > 1) for w in r.w])
