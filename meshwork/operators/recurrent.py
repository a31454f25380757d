"""A recurrent network of one LSTM layer with a linear output, trained by back-propagation through time.

Training is data-parallel: each task adds up the gradients of its sequences, Spark sums them by parameter, and the driver
makes one step of gradient descent per epoch. Only the parameters travel, whose number the sizes of the layers fix.

Cases: a null sequence or target takes no part in training, a null sequence has a null prediction, an empty one is
answered by the output's bias. Without any usable row the parameters stay as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Lstm:
    """Parameters lie in one vector; gates are its rows in the order input, forget, candidate, output."""

    def __init__(self, inputs: int, hidden: int, outputs: int, seed: int = 0):
        self.sizes = (inputs, hidden, outputs)
        self.shapes = {"gates": (4 * hidden, inputs + hidden), "bias": (4 * hidden,), "out": (outputs, hidden), "shift": (outputs,)}
        rng = np.random.default_rng(seed)
        parts = []
        for shape in self.shapes.values():
            reach = np.sqrt(6 / sum(shape)) if len(shape) == 2 else 0.0
            parts.append(rng.uniform(-reach, reach, shape).ravel())
        self.values = np.concatenate(parts)

    def split(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        """Views of a vector of parameters by name."""
        views, at = {}, 0
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            views[name] = vector[at : at + n].reshape(shape)
            at += n
        return views

    def step(self, x: np.ndarray, h: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
        """One step of a batch: the gates i, f, g, o, the cell state c and the hidden state h."""
        p, n = self.split(self.values), self.sizes[1]
        z = np.concatenate([x, h], axis=1) @ p["gates"].T + p["bias"]
        i, f, o = (_sigmoid(z[:, k * n : (k + 1) * n]) for k in (0, 1, 3))
        g = np.tanh(z[:, 2 * n : 3 * n])
        cell = f * c + i * g
        return {"i": i, "f": f, "g": g, "o": o, "c": cell, "h": o * np.tanh(cell), "x": x, "before_h": h, "before_c": c}

    def run(self, batch: np.ndarray) -> tuple[list[dict[str, np.ndarray]], np.ndarray]:
        """All steps of a batch (sequence, time, input) and the outputs after the last."""
        p = self.split(self.values)
        h = c = np.zeros((len(batch), self.sizes[1]))
        steps = []
        for t in range(batch.shape[1]):
            steps.append(self.step(batch[:, t], h, c))
            h, c = steps[-1]["h"], steps[-1]["c"]
        return steps, h @ p["out"].T + p["shift"]

    def gradient(self, batch: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, float]:
        """Sums over the batch of the squared error's gradient and of the squared error."""
        steps, y = self.run(batch)
        total = np.zeros_like(self.values)
        d, p = self.split(total), self.split(self.values)
        error = y - targets
        h = steps[-1]["h"] if steps else np.zeros((len(batch), self.sizes[1]))
        d["out"] += 2 * error.T @ h
        d["shift"] += 2 * error.sum(0)
        dh, dc = 2 * error @ p["out"], np.zeros_like(h)
        for s in reversed(steps):
            bent = np.tanh(s["c"])
            dc = dc + dh * s["o"] * (1 - bent**2)
            z = np.concatenate([dc * s["g"] * s["i"] * (1 - s["i"]), dc * s["before_c"] * s["f"] * (1 - s["f"]), dc * s["i"] * (1 - s["g"] ** 2), dh * bent * s["o"] * (1 - s["o"])], axis=1)
            d["gates"] += z.T @ np.concatenate([s["x"], s["before_h"]], axis=1)
            d["bias"] += z.sum(0)
            dh, dc = (z @ p["gates"])[:, self.sizes[0] :], dc * s["f"]
        return total, float((error**2).sum())

    def by_length(self, sequences: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and arrays of the sequences, those of one length together."""
        lengths = np.array([-1 if s is None else len(s) for s in sequences])
        for n in np.unique(lengths[lengths >= 0]):
            at = np.flatnonzero(lengths == n)
            yield at, np.array([[list(x) for x in sequences[k]] for k in at], float).reshape(len(at), n, self.sizes[0])

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump({"sizes": self.sizes, "values": self.values.tolist()}, f)

    @classmethod
    def load(cls, path: str) -> Lstm:
        with open(path) as f:
            kept = json.load(f)
        model = cls(*kept["sizes"])
        model.values = np.array(kept["values"])
        return model


def train(model: Lstm, df: DataFrame, sequence: str, target: str, epochs: int, rate: float) -> list[float]:
    """Trains model on columns sequence (array of arrays) and target (array); the mean squared error before each step."""
    usable = df.select(F.col(sequence).alias("s"), F.col(target).alias("t")).filter("s is not null and t is not null")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(model.values) + 2)
        for b in batches:
            targets = np.array([list(t) for t in b["t"]], float).reshape(len(b), model.sizes[2])
            for at, batch in model.by_length(b["s"].tolist()):
                gradient, error = model.gradient(batch, targets[at])
                total += np.concatenate([gradient, [error, len(at)]])
        yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    errors = []
    for _ in range(epochs):
        found = usable.mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
        if not len(found) or not found[-1]:
            break
        errors.append(float(found[-2] / found[-1]))
        model.values = model.values - rate * found[:-2] / found[-1]
    return errors


def predict(model: Lstm, df: DataFrame, sequence: str, name: str = "prediction") -> DataFrame:
    """df with the outputs (array) for column sequence."""

    @F.pandas_udf("array<double>")
    def answer(column: pd.Series) -> pd.Series:
        out: list = [None] * len(column)
        for at, batch in model.by_length(column.tolist()):
            for k, y in zip(at, model.run(batch)[1], strict=True):
                out[k] = y.tolist()
        return pd.Series(out)

    return df.withColumn(name, answer(F.col(sequence)))
