"""Adam over a table: an optimizer whose state is a number of its own (and two moments) for each row.

The states are columns of a stored table.  What a step does to a row follows from the row and from some numbers that all rows
share (the residual of the means, the scale of weights and gradients), so the steps since the table was written are done again
in each pass, and every ``keep`` steps a new generation is written and the one before it goes.  A step takes two passes, one
for the means and one for the largest gradient; learning rates that are tried are states side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .distributed import add_up
from .optimizers import AdamSoftmax

STATE = "x array<double>, a array<double>, b array<double>"


@dataclass
class Step:
    """What all rows share in a step: for each run the log of the scale, the residual, its product with the means, the largest gradient."""

    number: int
    scale: np.ndarray
    rest: np.ndarray  # runs x features
    along: np.ndarray
    largest: np.ndarray
    rates: np.ndarray  # 0 for runs that have ended


@dataclass
class Replay:
    """The steps since a table was written; all that tasks need to know of a solver."""

    log: bool
    steps: list[Step]

    def weights(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log scales and weights before they are divided by their sum."""
        if self.log:
            top = x.max(axis=0)
            return top, count[:, None] * np.exp(x - top)
        return np.zeros(x.shape[1]), count[:, None] * np.maximum(x, 0)

    def gradient(self, z: np.ndarray, count: np.ndarray, x: np.ndarray, step: Step) -> np.ndarray:
        g = z @ step.rest.T - step.along
        return (count[:, None] * np.exp(x - step.scale) if self.log else count[:, None]) * g

    def replayed(self, z: np.ndarray, count: np.ndarray, state: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        x, a, b = state
        for s in self.steps:
            g = self.gradient(z, count, x, s) / s.largest
            a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
            x = x - s.rates * (a / (1 - 0.9**s.number)) / (np.sqrt(b / (1 - 0.999**s.number)) + 1e-8)
        return x, a, b

    def rows(self, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z, count = np.vstack(b["_z"].to_numpy()), b["_count"].to_numpy(float)
        return z, count, self.replayed(z, count, tuple(np.vstack(b[c].to_numpy()) for c in ("x", "a", "b")))[0]


class RowStates:
    """The states of some runs on ``table``, which has ``_z`` (an array of features) and ``_count``."""

    def __init__(self, table: DataFrame, runs: int, log: bool, keep: int, start: DataFrame | None = None):
        zero = F.array_repeat(F.lit(0.0), runs)
        first = F.array_repeat(F.lit(0.0 if log else 1.0), runs) if start is None else F.array("_start")
        begun = (table if start is None else start).withColumn("_state", F.struct(first.alias("x"), zero.alias("a"), zero.alias("b")))
        self.log, self.keep, self.steps = log, keep, []
        self.stored = Scratch(begun)

    @property
    def table(self) -> DataFrame:
        return self.stored.table.select("_z", "_count", "_state.*")

    def means(self) -> tuple[np.ndarray, np.ndarray]:
        """Log of the scale and weighted means of each run."""
        known, width = Replay(self.log, self.steps), 2 + self.features

        def block(b: pd.DataFrame) -> np.ndarray:
            z, count, x = known.rows(b)
            top, w = known.weights(x, count)
            return np.column_stack([top, w.sum(axis=0), w.T @ z]).ravel()

        def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            a, b = a.reshape(-1, width).copy(), b.reshape(-1, width)
            top = np.maximum(a[:, 0], b[:, 0])
            a[:, 1:] = a[:, 1:] * np.exp(a[:, 0] - top)[:, None] + b[:, 1:] * np.exp(b[:, 0] - top)[:, None]
            a[:, 0] = top
            return a.ravel()

        found = add_up(self.table, block, merge, parts=self.parts).reshape(-1, width)
        return found[:, 0] + np.log(found[:, 1]), found[:, 2:] / found[:, 1:2]

    def largest(self, step: Step) -> np.ndarray:
        known = Replay(self.log, self.steps)

        def block(b: pd.DataFrame) -> np.ndarray:
            z, count, x = known.rows(b)
            return np.abs(known.gradient(z, count, x, step)).max(axis=0)

        return add_up(self.table, block, np.maximum, parts=self.parts)

    def advanced(self) -> DataFrame:
        """The stored table with its states as they are now."""
        known = Replay(self.log, self.steps)

        def now(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                z, count = np.vstack(b["_z"].to_numpy()), b["_count"].to_numpy(float)
                x, one, two = known.replayed(z, count, tuple(np.vstack(b[c].to_numpy()) for c in ("x", "a", "b")))
                yield pd.DataFrame({"x": list(x), "a": list(one), "b": list(two)})

        state = F.pandas_udf(now, STATE)(F.struct("_z", "_count", "_state.x", "_state.a", "_state.b"))
        return self.stored.table.withColumn("_state", state)

    def write(self) -> None:
        before, self.stored = self.stored, Scratch(self.advanced())
        self.steps = []
        before.drop()

    def run(self, optimizer: AdamSoftmax, mu: np.ndarray, rates: np.ndarray, n_iter: int, parts: int | None, go_on: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Error and iterations of each run, and the largest absolute error; runs that reach the tolerance stop.

        Those that do not take a step after the last measurement if others are to ``go_on`` from there.
        """
        self.features, self.parts = len(mu), parts
        live, err, worst, n = np.ones(len(rates), dtype=bool), np.full(len(rates), np.inf), np.full(len(rates), np.inf), np.zeros(len(rates), dtype=int)
        for i in range(1, n_iter + 1):
            scale, mean = self.means()
            rest = mean - mu
            now = (rest**2).sum(axis=1)
            n[live], err[live], worst[live] = i, now[live], np.abs(rest).max(axis=1, initial=0.0)[live]
            live &= err >= optimizer.abs_tol
            if not live.any() or (i == n_iter and not go_on):
                break
            step = Step(i, scale, rest, (mean * rest).sum(axis=1), np.ones(len(rates)), np.where(live, rates, 0.0))
            step.largest = np.maximum(self.largest(step), 1e-300)
            self.steps.append(step)
            if len(self.steps) >= self.keep:
                self.write()
        return err, n, worst


def adam_weights(optimizer: AdamSoftmax, table: DataFrame, mu: np.ndarray, name: str, keep: int = 25, parts: int | None = None) -> tuple[DataFrame, str, float, float, int]:
    """``table`` (with ``_z`` and ``_count``) with weights of mean 1, and status, error, largest error and iterations."""
    log = optimizer.parameterisation == "log"
    rates = np.array(optimizer.rates)
    tried = RowStates(table, len(rates), log, keep)
    err, n, _ = tried.run(optimizer, mu, rates, optimizer.n_tune_iter, parts, True)
    best = int(err.argmin())
    start = tried.advanced().withColumn("_start", F.element_at("_state.x", best + 1)).drop("_state")
    final = RowStates(table, 1, log, keep, start)
    tried.stored.drop()
    total, on = int(n.sum()), bool(err[best] >= optimizer.abs_tol)
    more, steps, worst = final.run(optimizer, mu, rates[best : best + 1], optimizer.n_iter if on else 1, parts, False)
    total += int(steps[0]) if on else 0
    for halving in range(1, optimizer.max_halvings + 1):
        if more[0] < optimizer.max_success_mse or not on:
            break
        start = final.advanced().withColumn("_start", F.element_at("_state.x", 1)).drop("_state")
        before, final = final, RowStates(table, 1, log, keep, start)
        before.stored.drop()
        more, steps, worst = final.run(optimizer, mu, rates[best : best + 1] / 2**halving, optimizer.n_iter, parts, False)
        total += int(steps[0])
    final.write()
    scale, _ = final.means()
    rows = table.agg(F.sum("_count")).first()[0]
    x = F.element_at("_state.x", 1)
    weight = F.exp(x - F.lit(float(scale[0]))) if log else F.greatest(x, F.lit(0.0)) * F.lit(float(np.exp(-scale[0])))
    out = final.stored.table.withColumn(name, weight * F.lit(float(rows))).drop("_state", "_z", "_start")
    return out, "Success" if more[0] < optimizer.max_success_mse else "Not-converged", float(more[0]), float(worst[0]), total
