"""Weight optimizers over whole tables: the state is a vector of the size of the features, never of the rows.

After any number of exponentiated-gradient steps the weights are w0 exp(-z theta) up to scale, with theta a small vector, and
the entropy dual has the same form.  So a pass over the rows only needs sums: of the weights, of weight times z, and for
Newton steps of weight times z z'.  A pass takes any number of thetas at once (learning rates side by side, or repetitions with
multiplicities of their own): each task turns its rows into one block of sums with a single matrix product per batch; those
are merged by ``fan_in`` tasks, and the driver adds up a row from each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..sources.scratch import Scratch
from .optimizers import Tilt, WeightResult, newton

FEW = 32  # partitions whose blocks the driver adds up itself


def compress(z: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Equal rows as one, with ``_count``; exact for every solver here.  Worth it where features take few values."""
    columns = columns or z.columns
    return z.groupBy(*[col(c) for c in columns]).agg(F.count("*").alias("_count"))


def add_up(table: DataFrame, block: Callable[[pd.DataFrame], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray], fan_in: int | None = None, parts: int | None = None) -> np.ndarray | None:
    """One array from all rows: a block for each batch, merged in its task, then by ``fan_in`` tasks, then on the driver.

    ``parts`` is the number of partitions, if known: few need no tasks to merge.
    """

    def of_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                found = block(b)
                total = found if total is None else merge(total, found)
        if total is not None:
            yield pd.DataFrame({"s": [total.tobytes()]})

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            for raw in b["s"]:
                found = np.frombuffer(raw)
                total = found if total is None else merge(total, found)
        if total is not None:
            yield pd.DataFrame({"s": [total.tobytes()]})

    sums = table.mapInPandas(of_task, "s binary")
    if parts is None or parts > FEW:
        sums = sums.repartition(fan_in or min(FEW, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInPandas(merged, "s binary")
    total = None
    for r in sums.collect():  # at most ``fan_in`` or FEW rows of the size of the sums
        found = np.frombuffer(r["s"])
        total = found if total is None else merge(total, found)
    return total


class Sums:
    """Sums of one tilt: log of the total weight, rows counted, weighted means of the log of base weights and of z, second moments."""

    def __init__(self, raw: np.ndarray, m: int, second: bool):
        top, s, self.n, lb = raw[:4]
        self.lse, self.log_base, self.mean = float(top + np.log(s)), float(lb / s), raw[4 : 4 + m] / s
        self.outer = raw[4 + m :].reshape(m, m) / s if second else None


def many_sums(z: DataFrame, columns: list[str], thetas: np.ndarray, second: bool = False, count: str | None = None, log_base: str | None = None, whose: list[int] | None = None, fan_in: int | None = None, parts: int | None = None) -> list[Sums] | None:
    """Sums for each row of ``thetas``, of weights count exp(log_base - z theta), from one pass; None without rows.

    With ``whose``, ``count`` is an array column, and ``whose[j]`` says which of its numbers the j-th tilt takes.
    """
    m, k = len(columns), len(thetas)
    width = 4 + m + (m * m if second else 0)

    def block(b: pd.DataFrame) -> np.ndarray:
        x = b[columns].to_numpy(float) if columns else np.zeros((len(b), 0))
        if whose is not None:
            c = np.vstack(b[count].to_numpy())[:, whose].astype(float)
        else:
            c = (b[count].to_numpy(float) if count else np.ones(len(b)))[:, None]
        lb = b[log_base].to_numpy(float) if log_base else np.zeros(len(b))
        score = np.where(c > 0, lb[:, None] - x @ thetas.T, -np.inf)
        top = score.max(axis=0)
        top = np.where(np.isfinite(top), top, -1e300)
        w = np.where(c > 0, c * np.exp(score - top), 0.0)
        out = np.zeros((k, width))
        out[:, 0], out[:, 1], out[:, 2], out[:, 3] = top, w.sum(axis=0), np.broadcast_to(c, w.shape).sum(axis=0), w.T @ np.where(np.isfinite(lb), lb, 0.0)
        out[:, 4 : 4 + m] = w.T @ x
        if second:
            for j in range(k):
                out[j, 4 + m :] = ((x * w[:, j : j + 1]).T @ x).ravel()
        return out.ravel()

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.reshape(k, width).copy(), b.reshape(k, width)
        top = np.maximum(a[:, 0], b[:, 0])
        fa, fb = np.exp(a[:, 0] - top)[:, None], np.exp(b[:, 0] - top)[:, None]
        n = a[:, 2] + b[:, 2]
        a = a * fa + b * fb
        a[:, 0], a[:, 2] = top, n
        return a.ravel()

    table = z.select(*[col(c) for c in dict.fromkeys([*columns, *([count] if count else []), *([log_base] if log_base else [])])])
    total = add_up(table, block, merge, fan_in, parts)
    return None if total is None else [Sums(r, m, second) for r in total.reshape(k, width)]


def tilted_sums(z: DataFrame, columns: list[str], theta: np.ndarray, second: bool, count: str | None = None, fan_in: int | None = None, log_base: str | None = None, parts: int | None = None) -> tuple[float, float, np.ndarray, np.ndarray | None]:
    """log of the sum of exp(-z theta), rows counted, weighted mean and weighted second moments (or None)."""
    found = many_sums(z, columns, np.asarray(theta, dtype=float)[None, :], second, count, log_base, fan_in=fan_in, parts=parts)
    if found is None:
        return -np.inf, 0.0, np.zeros(len(columns)), None
    return found[0].lse, float(found[0].n), found[0].mean, found[0].outer


class TableTilt(Tilt):
    """The tilt of a table: every state is a pass that sums small vectors, and a pass takes as many thetas as are asked for.

    ``log_base`` names the logs of base weights, which multiply the counts in weights but not in what divergence is taken from.
    """

    def __init__(self, z: DataFrame, mu: dict[str, float], columns: list[str], count: str | None = None, log_base: str | None = None, parts: int | None = None):
        self.table, self.columns, self.count, self.mu, self.base, self.parts = z, columns, count, np.array([mu[c] for c in columns]), log_base, parts
        ends = z.agg(*[f(col(c)).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("n")).first()
        self.width = np.array([(ends[f"hi{i}"] or 0.0) - (ends[f"lo{i}"] or 0.0) for i in range(len(columns))])
        self.start = self._sums(np.zeros((1, len(columns))))[0].lse  # log of the sum of base weights

    def _sums(self, thetas: np.ndarray, second: bool = False) -> list[Sums]:
        found = many_sums(self.table, self.columns, thetas, second, self.count, self.base, parts=self.parts)
        if found is None:
            raise ValueError("a table without rows has no weights")
        return found

    def states(self, thetas: np.ndarray) -> list[tuple[np.ndarray, float, float]]:
        return [(s.mean - self.mu, float(np.log(s.n) + s.log_base - t @ s.mean - s.lse), s.lse - self.start) for t, s in zip(thetas, self._sums(thetas), strict=True)]

    def state(self, theta: np.ndarray) -> tuple[np.ndarray, float, float]:
        return self.states(theta[None, :])[0]

    def batches(self, size: int, seed: int) -> Callable[[int, np.ndarray], np.ndarray]:
        """Samples are hash buckets of rows: a bucket is a partition of a stored table, so a step reads no other.

        Rows that stand for several are dealt over the buckets, so each bucket is like the table.  Every epoch takes all
        buckets, in an order of its own.
        """
        weight = (F.col(self.count) if self.count else F.lit(1)) * (F.exp(F.col(self.base)) if self.base else F.lit(1.0))
        n = max(1, -(-int(self.table.agg(F.sum(weight)).first()[0] or 0) // size))
        rows = self.table.withColumn("_all", F.col(self.count) if self.count else F.lit(1).cast("long"))
        at = F.xxhash64(F.lit(seed), *[col(c) for c in self.columns])
        ways = F.least(F.col("_all"), F.lit(n))
        dealt = rows.withColumn("_way", F.explode(F.sequence(F.lit(0).cast("long"), ways - 1)))
        some = F.floor(F.col("_all") / ways) + F.when(F.col("_way") < F.col("_all") % ways, 1).otherwise(0)
        kept = [col(c) for c in self.columns] + ([F.col(self.base)] if self.base else [])
        stored = Scratch(dealt.select(*kept, some.cast("long").alias("_some"), F.pmod(at + F.col("_way"), F.lit(n)).cast("int").alias("_bucket")).repartition("_bucket"), "_bucket")
        self.stored = getattr(self, "stored", [])
        self.stored.append(stored)

        def gap(i: int, theta: np.ndarray) -> np.ndarray:
            epoch, step = divmod(i, n)
            bucket = int(np.random.default_rng([seed, epoch]).permutation(n)[step])
            found = many_sums(stored.table.where(F.col("_bucket") == bucket), self.columns, theta[None, :], count="_some", log_base=self.base, parts=1)
            return np.zeros(len(theta)) if found is None else found[0].mean - self.mu

        return gap

    def drop(self) -> None:
        """Remove the stored samples."""
        for s in getattr(self, "stored", []):
            s.drop()


def newton_tilt(z: DataFrame, mu: dict[str, float], columns: list[str], count: str | None = None, tol: float = 1e-9, max_passes: int = 60, log_base: str | None = None, bound: Callable[[np.ndarray], np.ndarray] | None = None, parts: int | None = None) -> tuple[np.ndarray, WeightResult]:
    """theta with weighted means equal to ``mu``, by damped Newton steps: some ten passes instead of thousands of steps.

    With ``bound`` (a projection onto a convex set), the multipliers of lowest dual value in that set.
    """
    target = np.array([mu[c] for c in columns])
    last: dict = {}

    def dual(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        (s,) = many_sums(z, columns, theta[None, :], True, count, log_base, parts=parts) or (None,)
        if s is None:
            raise ValueError("a table without rows has no weights")
        last[theta.tobytes()] = s.mean
        return s.lse + float(target @ theta), target - s.mean, s.outer - np.outer(s.mean, s.mean)

    theta, moved, passes = newton(dual, len(columns), bound, tol, max_passes)
    rest = target - last[theta.tobytes()]
    return theta, WeightResult(np.zeros(0), "Success" if moved < 1e-6 else "Failure", float(rest @ rest), float(np.abs(rest).max(initial=0.0)), passes, nu=theta)


def newton_squares(z: DataFrame, mu: dict[str, float], columns: list[str], count: str | None = None, lam: float = 0.0, min_w: float = 0.0, bound: Callable[[np.ndarray], np.ndarray] | None = None, tol: float = 1e-10, max_passes: int = 80, parts: int | None = None) -> tuple[np.ndarray, WeightResult]:
    """Chi-square weights max(min_w, 1 - (z u + v) / (2 lam / n)) of mean 1: (u, v, half width of the rows' scores) and the result.

    Newton steps on the dual in (u, v).  Rows at ``min_w`` drop out of the second moments, which are those of the others, so a
    pass over the table finds the shift v (the projection onto the simplex) together with u.  Without ``lam`` the means are
    equal; with it ``bound`` keeps u in the dual ball of the distance.
    """
    m = len(columns)
    target = np.append(np.array([mu[c] for c in columns]), 1.0)
    n = z.agg(F.sum(F.col(count)) if count else F.count("*")).first()[0] or 0
    if not n:
        raise ValueError("a table without rows has no weights")
    half = lam / n if lam > 0 else 0.5

    def block(at: np.ndarray, b: pd.DataFrame) -> np.ndarray:
        x = np.column_stack([b[columns].to_numpy(float) if columns else np.zeros((len(b), 0)), np.ones(len(b))])
        c = b[count].to_numpy(float) if count else np.ones(len(b))
        t = x @ at
        free = 1 - t / (2 * half)
        w = np.maximum(min_w, free)
        inside = free > min_w
        value = -(c * (half * (w - 1) ** 2 + w * t)).sum() / n
        return np.concatenate([[value], x.T @ (c * w) / n, ((x[inside] * c[inside, None]).T @ x[inside]).ravel() / (2 * half * n)])

    table = z.select(*[col(c) for c in [*columns, *([count] if count else [])]])
    last: dict = {}

    def dual(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        raw = add_up(table, lambda b: block(at, b), np.add, parts=parts)
        last[at.tobytes()] = raw[1 : m + 2]
        return float(raw[0] + target @ at), target - raw[1 : m + 2], raw[m + 2 :].reshape(m + 1, m + 1)

    inside = (lambda x: np.append(bound(x[:-1]), x[-1])) if bound is not None and lam > 0 else None
    at, moved, passes = newton(dual, m + 1, inside, tol, max_passes)
    rest = (last[at.tobytes()] - target)[:m]
    return np.append(at, half), WeightResult(np.zeros(0), "Success" if moved < 1e-6 else "Failure", float(rest @ rest), float(np.abs(rest).max(initial=0.0)), passes, nu=at[:m])


def gradient_tilt(z: DataFrame, mu: dict[str, float], columns: list[str], alpha: float, steps: int, momentum: float = 0.9, count: str | None = None) -> np.ndarray:
    """theta after so many exponentiated-gradient steps; a pass for each."""
    target = np.array([mu[c] for c in columns])
    theta, velocity = np.zeros(len(columns)), np.zeros(len(columns))
    for _ in range(steps):
        _, _, mean, _ = tilted_sums(z, columns, theta, False, count)
        velocity = momentum * velocity + (mean - target)
        theta = theta + alpha * velocity
    return theta


def linear_score(columns: dict[str, Column] | list[str], theta: np.ndarray, start: Column | None = None) -> Column:
    """start - z theta as an expression."""
    named = {c: col(c) for c in columns} if isinstance(columns, list) else columns
    score = F.lit(0.0) if start is None else start
    for c, t in zip(named.values(), theta, strict=True):
        score = score - c * F.lit(float(t))
    return score


def tilt_weights(z: DataFrame, columns: list[str], theta: np.ndarray, count: str | None = None, name: str = "w") -> DataFrame:
    """``z`` with the weights as a column, of mean 1 over the rows counted; an expression, so nothing is stored."""
    lse, n, _, _ = tilted_sums(z, columns, theta, False, count)
    return z.withColumn(name, F.exp(linear_score(columns, theta) - F.lit(lse)) * F.lit(float(n)))


def weighted_residuals(z: DataFrame, mu: dict[str, float], w: Column) -> DataFrame:
    """``feature, residual``: weighted mean less mu, for each feature of ``mu``."""
    sums = z.agg(*[(F.sum(w * col(c)) / F.sum(w) - F.lit(v)).alias(f"r{i}") for i, (c, v) in enumerate(mu.items())])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("residual")) for i, c in enumerate(mu)])).alias("r")).select("r.*")
