"""The two-task model: its gradient, its training, and odd rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from gatelane.plans import joint

KIND = "id long, text string, category int, flags array<int>"
ODD = [(90, None, 1, None), (91, "", 0, []), (92, "a b c", None, [1]), (93, "a b", 7, [1, 0, 1]), (94, "x y", 0, [-100, None]), (None, "z", 1, [0])]


def rows_of(spark, extra=()):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        kind = i % 3
        words = [str(rng.choice(["red", "blue", "green"] if kind == 0 else ["one", "two", "six"] if kind == 1 else ["cat", "dog", "cow"])) for _ in range(rng.integers(2, 9))]
        marked = [w if rng.random() < 0.8 else "555-1234" for w in words]
        rows.append((i, " ".join(marked), kind, [int(w[0] == "5") for w in marked]))
    return spark.createDataFrame(rows + list(extra), KIND).repartition(3)


@pytest.fixture(scope="module")
def rows(spark):
    return joint.features(rows_of(spark, ODD), "id", "text", "category", "flags", 32)


def test_gradient_is_that_of_the_loss(rows):
    shape = joint.Shape(3, 32, 3)
    flat = shape.start(1)
    loss, grad = joint.loss_and_gradient(rows, shape, flat, (1.0, 0.7))
    rng = np.random.default_rng(5)
    for i in [*rng.choice(len(flat), 6, replace=False).tolist(), len(flat) - 1, 32 * 3]:
        near = [joint.loss_and_gradient(rows, shape, flat + d * np.eye(1, len(flat), i)[0], (1.0, 0.7))[0] for d in (1e-5, -1e-5)]
        assert grad[i] == pytest.approx((near[0] - near[1]) / 2e-5, abs=1e-6)


def test_blocks_and_parts_add_up(rows, monkeypatch):
    shape = joint.Shape(3, 32, 3)
    flat = shape.start(1)
    loss, grad = joint.loss_and_gradient(rows, shape, flat, (1.0, 0.7))
    monkeypatch.setattr(joint, "BLOCK", 10)
    monkeypatch.setattr(joint, "FAN_IN", 2)
    other_loss, other = joint.loss_and_gradient(rows, shape, flat, (1.0, 0.7))
    assert other_loss == pytest.approx(loss) and np.allclose(grad, other)


def test_both_tasks_are_learnt(spark):
    rows = joint.features(rows_of(spark), "id", "text", "category", "flags", 512)
    model = joint.train_joint(rows, joint.Shape(3, 512, 8), (1.0, 0.5), 15)
    assert all(b < a for a, b in zip(model.history, model.history[1:])) and model.history[-1] < 0.5 * model.history[0]
    scored = joint.joint_scores(model, rows).collect()
    assert np.mean([r.right for r in scored]) > 0.95
    assert sum(r.flags_right for r in scored) > 0.95 * sum(r.n_words for r in scored)


def test_odd_rows_and_an_empty_table(spark, rows):
    shape = joint.Shape(3, 32, 3)
    model = joint.JointModel(shape, shape.start(3), (1.0, 1.0))
    got = {r.ident: r for r in joint.joint_scores(model, rows).collect()}
    assert len(got) == 66 and got[90].n_words == got[91].n_words == 0
    assert [got[i].right is None for i in (90, 91, 92, 93, 94)] == [True, True, True, True, False]
    assert got[94].word_loss == 0 and got[92].word_loss > 0
    none = joint.features(spark.createDataFrame([], KIND), "id", "text", "category", "flags", 32)
    assert joint.loss_and_gradient(none, shape, shape.start(3), (1.0, 1.0))[0] == 0
    assert joint.train_joint(none, shape).history == [0.0] and joint.joint_scores(model, none).count() == 0


def test_a_task_holds_a_bounded_number_of_words():
    """The memory beside a batch does not follow its words, and the sums are those of single rows."""
    shape = joint.Shape(3, 64, 8)
    flat, rng = shape.start(1), np.random.default_rng(3)
    sizes = [0, 70_000, *[300] * 1500, 0]
    lists = lambda parts: pa.array(parts, pa.list_(pa.int32()))
    rows = pa.RecordBatch.from_arrays(
        [pa.array(range(len(sizes))), pa.array([i % 4 for i in range(len(sizes))], pa.int32()),
         lists([rng.integers(0, 64, joint.PER_WORD * n) for n in sizes]), lists([rng.integers(0, 2, n) for n in sizes])],
        ["ident", "category", "idx", "flags"],
    )
    tracemalloc.start()
    whole = list(joint._partial(shape, flat)([rows]))[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    single = list(joint._partial(shape, flat)(rows.slice(i, 1) for i in range(len(sizes))))[0]
    assert np.allclose(np.concatenate(whole["v"].to_pylist()), np.concatenate(single["v"].to_pylist()))
    assert peak < 60e6
    texts = pa.RecordBatch.from_arrays(
        [pa.array(range(400)), pa.array([0] * 400, pa.int32()), pa.array([None, *[[f"w{i % 7}" for i in range(1000)]] * 399], pa.list_(pa.string())), lists([[0]] * 400)],
        ["ident", "category", "words", "flags"],
    )
    made = list(joint._indexed(64)([texts]))
    assert pa.Table.from_batches(made)["ident"].to_pylist() == list(range(400))
    assert max(len(b.column("flags").flatten()) for b in made) <= joint.PIECE_WORDS
