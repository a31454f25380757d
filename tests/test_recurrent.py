"""The recurrent network: gradients against differences, learning, training by Spark, saved weights."""

import numpy as np
import pytest

from meshwork.operators.recurrent import Lstm, predict, train

XOR = [([[float(a)], [float(b)]], [float(a ^ b)]) for a in (0, 1) for b in (0, 1)]


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    m, x, t = Lstm(2, 3, 2, seed=4), rng.normal(size=(5, 4, 2)), rng.normal(size=(5, 2))
    m.values += rng.normal(size=len(m.values)) / 5
    got, _ = m.gradient(x, t)
    for k in range(len(m.values)):
        ends = []
        for d in (1e-5, -1e-5):
            m.values[k] += d
            ends.append(m.gradient(x, t)[1])
            m.values[k] -= d
        assert got[k] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4, abs=1e-6)


def test_gates_and_states():
    m = Lstm(3, 4, 1)
    s = m.step(np.ones((1, 3)), np.zeros((1, 4)), np.ones((1, 4)))
    assert all(((s[x] > 0) & (s[x] < 1)).all() for x in "ifo")
    np.testing.assert_allclose(s["c"], s["f"] + s["i"] * s["g"])
    np.testing.assert_allclose(s["h"], s["o"] * np.tanh(s["c"]))


def test_xor_is_learnt_and_weights_are_kept(tmp_path):
    m = Lstm(1, 8, 1, seed=2)
    x, t = np.array([s for s, _ in XOR]), np.array([y for _, y in XOR])
    for _ in range(4000):
        m.values = m.values - 0.3 * m.gradient(x, t)[0] / 4
    assert (np.round(m.run(x)[1]) == t).all()
    m.save(str(tmp_path / "m.json"))
    np.testing.assert_array_equal(Lstm.load(str(tmp_path / "m.json")).run(x)[1], m.run(x)[1])


def test_spark_trains_as_one_process_does(spark):
    rows = [(s, y) for s, y in XOR] * 5 + [(None, [1.0]), ([[1.0]], None), ([], [0.5])]
    df = spark.createDataFrame(rows, "s array<array<double>>, t array<double>")
    m, alone = Lstm(1, 3, 1, seed=3), Lstm(1, 3, 1, seed=3)
    errors = train(m, df, "s", "t", 3, 0.1)
    for _ in range(3):
        parts = [alone.gradient(np.array([s]).reshape(1, len(s), 1), np.array([t]))[0] for s, t in rows if s is not None and t is not None]
        alone.values = alone.values - 0.1 * sum(parts) / len(parts)
    np.testing.assert_allclose(m.values, alone.values, rtol=1e-9, atol=1e-12)
    assert errors == sorted(errors, reverse=True)
    got = {str(r["s"]): r["prediction"] for r in predict(m, df, "s").collect()}
    assert got["None"] is None and got["[]"] == pytest.approx(m.split(m.values)["shift"].tolist())
    assert train(m, df.limit(0), "s", "t", 2, 0.1) == []
