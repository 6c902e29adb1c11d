"""Repetitions of any size: all of them on one stored table, whose rows carry an array of multiplicities.

A repetition that fits a task is solved there (``plans.estimate.run_repetitions``).  A larger one is a column of multiplicities;
the solvers of all repetitions ask side by side, and one pass over the table answers them all.  Measures and diagnostics of all
repetitions come from one ordered scan and two more passes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from . import local
from .distributed import add_up, many_sums
from .optimizers import Descent, WeightOptimizer, answer_all
from .resample import in_ranges, scan

MULT = "_mult"


def as_vectors(samples: DataFrame, reps: int) -> DataFrame:
    """Different rows of ``samples`` (``rep, mult`` and columns) with ``_mult``: how often each repetition takes them."""
    columns = [c for c in samples.columns if c not in ("rep", "mult", "row_id")]
    sums = samples.groupBy(*[col(c) for c in columns], "rep").agg(F.sum("mult").alias("mult"))
    taken = sums.groupBy(*[col(c) for c in columns]).agg(F.map_from_entries(F.collect_list(F.struct("rep", "mult"))).alias("_taken"))
    number = F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), lambda r: F.coalesce(F.try_element_at("_taken", r), F.lit(0)).cast("long"))
    return taken.select(*[col(c) for c in columns], number.alias(MULT))


class Scale:
    """How each repetition standardises: z-scores by its own moments, or nothing where all columns hold 0 and 1 only."""

    def __init__(self, table: DataFrame, names: list[str], mu: dict[str, float], reps: int, min_sd: float, log_base: str | None):
        found = table.agg(*[f(col(c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max), ("m", F.avg))], *[F.max(F.when(~col(c).isin(0, 1), 1)).alias(f"x{i}") for i, c in enumerate(names)]).first()
        self.names, self.log_base = names, log_base
        self.center = np.array([found[f"m{i}"] for i in range(len(names))])
        plain = all(found[f"x{i}"] is None for i in range(len(names)))
        # Centred before they are squared, so that large values lose no digits.
        self.table = table.withColumns({f"_c{i}": col(c) - F.lit(float(g)) for i, (c, g) in enumerate(zip(names, self.center, strict=True))})
        self.columns = [f"_c{i}" for i in range(len(names))]
        squared = self.table.withColumns({f"_s{i}": F.col(f"_c{i}") * F.col(f"_c{i}") for i in range(len(names))})
        whose, zero = list(range(reps)), np.zeros((reps, 2 * len(names)))
        first = many_sums(squared, [*self.columns, *[f"_s{i}" for i in range(len(names))]], zero, count=MULT, whose=whose)
        m = len(names)
        self.n = np.array([s.n for s in first])
        mean = np.vstack([s.mean[:m] for s in first])
        sd = np.sqrt(np.maximum(np.vstack([s.mean[m:] for s in first]) - mean**2, 0) * (self.n / np.maximum(self.n - 1, 1))[:, None])
        self.mean, self.sd = (np.zeros((reps, m)) - self.center, np.ones((reps, m))) if plain else (mean, sd)
        self.kept = np.ones((reps, m), dtype=bool) if plain else sd > min_sd
        self.sd = np.where(self.kept, self.sd, 1.0)
        self.mu = np.array([mu[c] for c in names]) - self.center
        self.target = np.where(self.kept, (self.mu - self.mean) / self.sd, 0.0)
        self.width = np.where(self.kept, np.array([found[f"hi{i}"] - found[f"lo{i}"] for i in range(m)]) / self.sd, 0.0)
        start = first if log_base is None else many_sums(self.table, self.columns, np.zeros((reps, m)), count=MULT, log_base=log_base, whose=whose)
        self.start = np.array([s.lse for s in start])

    def raw(self, thetas: np.ndarray, whose: list[int]) -> np.ndarray:
        return np.where(self.kept[whose], thetas / self.sd[whose], 0.0)

    def states(self, thetas: np.ndarray, whose: list[int]) -> list[tuple[np.ndarray, float, float]]:
        own = self.raw(thetas, whose)
        out = []
        for t, r, s in zip(own, whose, many_sums(self.table, self.columns, own, count=MULT, log_base=self.log_base, whose=whose), strict=True):
            gap = np.where(self.kept[r], (s.mean - self.mu) / self.sd[r], 0.0)
            out.append((gap, float(np.log(s.n) + s.log_base - t @ s.mean - s.lse), float(s.lse - self.start[r] + t @ self.mean[r])))
        return out


def run_vectors(samples: DataFrame, names: list[str], mu: dict[str, float], optimizer: WeightOptimizer, sets: list[tuple[str, ...]], reps: int, warm: bool = False, per_task: int = 20_000) -> DataFrame:
    """``rep, metric, value`` as from ``run_repetitions``, for repetitions of any size and optimizers that work by sums."""
    if not hasattr(optimizer, "ask"):
        raise ValueError(f"{optimizer.name} needs a repetition's rows in one task: lower n_max")
    stored = in_ranges(as_vectors(samples, reps), per_task, "_p")
    try:
        return _solved(stored.table, names, mu, optimizer, sets, reps, warm)
    finally:
        stored.drop()


def _solved(table: DataFrame, names: list[str], mu: dict[str, float], optimizer: WeightOptimizer, sets: list[tuple[str, ...]], reps: int, warm: bool) -> DataFrame:
    spark = table.sparkSession
    log_base = "_log_w0" if warm else None
    if warm:
        table = table.withColumn("_log_w0", F.log("_w0"))
    scale = Scale(table, names, mu, reps, optimizer.min_sd, log_base)
    cases = many_sums(table, ["_y"], np.zeros((reps, 1)), count=MULT, whose=list(range(reps)))
    both = [r for r in range(reps) if cases[r].n > 0 and 0 < cases[r].mean[0] < 1]
    reaches = {r: lambda step, r=r: float(np.abs(step) @ scale.width[r]) for r in both}
    ended: dict[int, Descent] = dict(zip(both, answer_all([optimizer.ask(scale.target[r], reaches[r]) for r in both], lambda t, whose: scale.states(t, [both[w] for w in whose])), strict=True))
    rows = [(r, k, float(v)) for r, d in ended.items() for k, v in (("Opt err", d.err), ("n iter", d.iterations))]
    good = [r for r, d in ended.items() if d.status == "Success"]
    if good:
        thetas = scale.raw(np.vstack([ended[r].theta for r in good]), good)
        sums = many_sums(scale.table, scale.columns, thetas, count=MULT, log_base=log_base, whose=good)
        lse, n = np.array([s.lse for s in sums]), np.array([s.n for s in sums])
        columns, center = scale.columns, scale.center

        def weights(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            """How often each repetition takes a row, and its weight there (of mean 1)."""
            c = np.vstack(b[MULT].to_numpy())[:, good].astype(float)
            x = b[names].to_numpy(float) - center
            score = (b[log_base].to_numpy(float)[:, None] if log_base else 0.0) - x @ thetas.T - lse
            return c, np.where(c > 0, np.exp(np.minimum(score, 700.0)) * n, 0.0)

        found = scan(scale.table.drop(*columns), lambda _, b: np.multiply(*weights(b)), "_y", "_p").collect()  # a row for each repetition
        for f in found:
            rows += [(good[f["rep"]], m, float(f[c])) for m, c in (("AUROC", "auroc"), ("Brier score", "brier"), ("Global calibration mean prediction", "mean_prediction"), ("Global calibration observed risk", "observed_risk")) if f[c] is not None]
        rows += _diagnostics(scale.table, names, mu, sets, weights, good)
    return spark.createDataFrame(rows, "rep int, metric string, value double")


def _diagnostics(table: DataFrame, names: list[str], mu: dict[str, float], sets: list[tuple[str, ...]], weights, good: list[int]) -> list[tuple[int, str, float]]:
    k, m = len(good), len(names)

    def extremes(b: pd.DataFrame) -> np.ndarray:
        c, w = weights(b)
        x = b[names].to_numpy(float)
        out = np.full((k, 2 * m + 1), -np.inf)
        for j in range(k):
            some = c[:, j] > 0
            if some.any():
                out[j] = np.concatenate([x[some].max(axis=0), -x[some].min(axis=0), [w[some, j].max()]])
        return out.ravel()

    top = add_up(table, extremes, np.maximum).reshape(k, 2 * m + 1)
    high, low = top[:, :m], -top[:, m : 2 * m]

    def totals(b: pd.DataFrame) -> np.ndarray:
        c, w = weights(b)
        x, y = b[names].to_numpy(float), b["_y"].to_numpy(float)
        cw = c * w
        with np.errstate(divide="ignore", invalid="ignore"):
            wlog = np.where(w > 0, cw * np.log(w), 0.0)
        used = np.where(w > 0, c, 0.0)
        middle = np.stack([((c > 0)[:, j, None] & (x > low[j]) & (x < high[j])).sum(axis=0) for j in range(k)])
        parts = [used.sum(axis=0), used.T @ y, cw.sum(axis=0), (cw * w).sum(axis=0), wlog.sum(axis=0), c.sum(axis=0)]
        return np.column_stack([*parts, cw.T @ x, cw.T @ x**2, middle]).ravel()

    found = add_up(table, totals, np.add).reshape(k, 6 + 3 * m)
    rows = []
    for j, r in enumerate(good):
        n_used, n_cases, s, s2, sl, n = found[j, :6]
        m1, s1, middle = found[j, 6 : 6 + m] / s, found[j, 6 + m : 6 + 2 * m] / s, found[j, 6 + 2 * m :]
        at = {c: i for i, c in enumerate(names)}
        scores = []
        for one in sets:
            i = at[one[0]]
            second = (mu[one[1]], m1[at[one[1]]]) if len(one) == 2 else (None, s1[i])
            scores.append(local.smd_score(len(one), mu[one[0]], second[0], m1[i], second[1], low[j, i], high[j, i], middle[i] > 0))
        scores = [x for x in scores if not np.isnan(x)]
        values = {"n": n_used, "n outcome": n_cases, "Max weight": top[j, 2 * m], "chi2 to uniform": n * s2 / s**2 - 1, "kl": np.log(n) + sl / s - np.log(s), "Max Weighted SMD": max(scores) if scores else np.nan}
        rows += [(r, f, float(v)) for f, v in values.items()]
    return rows
