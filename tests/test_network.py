"""The network: gradients, steps shared by tasks against one process, what it learns, storing."""

import numpy as np
import pytest

from quillspark.operators import graph, network

ROWS = "key long, features array<double>, label int"


def test_gradients_follow_finite_differences():
    sizes, rng = [5, 7, 6, 3], np.random.default_rng(2)
    flat = network.start(sizes, 3) + rng.normal(scale=0.1, size=len(network.start(sizes, 3)))
    x, y = rng.normal(size=(9, 5)), rng.integers(0, 3, 9)
    masks = [(rng.random((9, b)) >= 0.5) / 0.5 for b in sizes[1:-1]]

    def loss(p):
        logits, _, _ = network.forward(network.unpack(p, sizes), x, masks=masks)
        return -network.log_softmax(logits)[np.arange(9), y].mean()

    parts = network.unpack(flat, sizes)
    logits, held, _ = network.forward(parts, x, masks=masks)
    got = network.backward(parts, held, logits, y, masks)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-6 - got[i]) < 1e-5


def made(n, rng, classes=3):
    return [(i, (rng.normal(size=4) + 4 * np.eye(4)[i % classes]).tolist(), i % classes) for i in range(n)]


def test_learns_and_can_be_stored(spark, tmp_path):
    rows = made(360, np.random.default_rng(5))
    table = spark.createDataFrame([*rows[:300], (900, None, 1), (901, [0.0] * 4, None)], ROWS).repartition(3)
    valid = spark.createDataFrame(rows[300:], ROWS)
    net = network.fit(table, [4, 16, 8, 3], valid, epochs=6, batch=32, rate=1e-2)
    assert [e for e, *_ in net.losses] == list(range(6)) and net.losses[-1][1] < net.losses[0][1]
    assert net.losses[-1][3] > 0.9 and net.evaluate(valid) == pytest.approx(net.losses[-1][2:])
    net.save(spark, str(tmp_path / "net"))
    same = network.Network.load(spark, str(tmp_path / "net"))
    assert same.evaluate(valid) == pytest.approx(net.evaluate(valid)) and same.steps == net.steps >= 6 * 10  # more where the tasks' shares are uneven
    odd = net.predict(spark.createDataFrame([(1, None, 0), (2, [4.0, 0.0, 0.0, 0.0], 0)], ROWS)).orderBy("key").collect()
    assert (odd[0]["scores"], odd[0]["prediction"], odd[1]["prediction"]) == (None, None, 0)


def test_shared_steps_are_those_of_one_process(spark):
    """All in one batch: each task's half is normed by itself and the gradients are weighed by rows."""
    rng = np.random.default_rng(7)
    rows = made(40, rng)
    table = spark.createDataFrame(rows, ROWS)
    net = network.fit(table, [4, 6, 3], epochs=1, batch=400, workers=2, dropout=0.0)
    from pyspark.sql import functions as F

    dealt = graph._cut(table).withColumn("mixed", F.xxhash64("key", F.lit(1), F.lit(0))).repartition(2).select("*", F.spark_partition_id().alias("p")).collect()
    assert sorted(sum(r["p"] == p for r in dealt) for p in (0, 1)) == [20, 20]
    plain = network.Network.new([4, 6, 3], 1)
    gradient = 0
    for p in {r["p"] for r in dealt}:
        own = [rows[r["key"]] for r in dealt if r["p"] == p]
        parts = network.unpack(plain.flat, plain.sizes)
        y = np.array([r[2] for r in own])
        logits, held, _ = network.forward(parts, np.array([r[1] for r in own]))
        gradient = gradient + network.backward(parts, held, logits, y) * len(own) / 40
    plain.move(gradient, 1e-3)
    assert np.allclose(net.flat, plain.flat, atol=1e-9)


def test_tasks_meet_a_bounded_number_of_times(spark):
    """251 batches an epoch: each task takes its share of the steps, and all meet 16 times (once a batch before)."""
    rng = np.random.default_rng(11)
    rows = made(4010, rng)
    net = network.fit(spark.createDataFrame(rows, ROWS).repartition(3), [4, 16, 8, 3], spark.createDataFrame(made(300, rng), ROWS), epochs=1, batch=16, rate=1e-2)
    assert net.rounds == [network.ROUNDS] and 250 <= net.steps <= 256
    assert net.losses[0][3] > 0.9


def test_states_are_averaged_by_rows(spark, monkeypatch):
    """Two steps a task in one round: the mean of what two processes learn by themselves."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(network, "ROUNDS", 1)
    rows = made(41, np.random.default_rng(7))
    table = spark.createDataFrame(rows, ROWS)
    net = network.fit(table, [4, 6, 3], epochs=1, batch=22, workers=2, dropout=0.0)
    dealt = graph._cut(table).withColumn("mixed", F.xxhash64("key", F.lit(1), F.lit(0))).repartition(2).sortWithinPartitions("mixed", "key").select("*", F.spark_partition_id().alias("p")).collect()
    states, shares = [], []
    for p in (0, 1):
        own, plain = [rows[r["key"]] for r in dealt if r["p"] == p], network.Network.new([4, 6, 3], 1)
        for part in (own[:11], own[11:]):
            parts, y = network.unpack(plain.flat, plain.sizes), np.array([r[2] for r in part])
            logits, held, seen = network.forward(parts, np.array([r[1] for r in part]))
            plain.watch(seen)
            plain.move(network.backward(parts, held, logits, y), 1e-3)
        states.append(np.concatenate([plain.flat, plain.first, plain.second, *plain.running[0]]))
        shares.append(len(own) / 41)
    assert net.rounds == [1] and net.steps == 2
    assert np.allclose(np.concatenate([net.flat, net.first, net.second, *net.running[0]]), np.average(states, axis=0, weights=shares), atol=1e-9)


def test_no_rows(spark):
    net = network.fit(spark.createDataFrame([], ROWS), [4, 6, 3], epochs=1)
    assert net.losses == [(0, None, None, None)] and np.array_equal(net.flat, network.start([4, 6, 3], 1))
