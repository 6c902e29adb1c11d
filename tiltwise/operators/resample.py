"""Measures of many resamples or weightings at once, from one ordered scan of the different predictions.

Equal rows (outcome and prediction) are one cell with a number.  A resample is then a vector of numbers for cells, so what is
shuffled is a row for each cell, never one for each row and resample.  Cells are stored in ranges of predictions; each
range is a task that holds its cells' numbers for all resamples as a matrix, and leaves a row of sums for each resample.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..sources.scratch import Scratch

Matrix = Callable[[int, pd.DataFrame], np.ndarray]


def in_ranges(cells: DataFrame, per_task: int, p: str = "p") -> Scratch:
    """Cells stored with ``_range``: equal predictions are in one range, and ranges are in the order of predictions."""
    n = cells.count()
    ranges = max(1, -(-n // per_task))
    return Scratch(cells.repartitionByRange(ranges, col(p)).withColumn("_range", F.spark_partition_id()))


def scan(cells: DataFrame, matrix: Matrix, y: str = "y", p: str = "p") -> DataFrame:
    """``rep, auroc, brier, mean_prediction, observed_risk`` for each column of the matrix that ``matrix`` gives for a range.

    It gets the number of the range and its rows in the order of prediction and outcome.  The measures are null unless both
    classes have weight.
    """

    def sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([p, y], ignore_index=True)
        w = matrix(int(key[0]), rows)
        yv, pv = rows[y].to_numpy(float), rows[p].to_numpy(float)
        first = np.flatnonzero(np.concatenate(([True], pv[1:] != pv[:-1])))
        pos = np.add.reduceat(w * (yv == 1)[:, None], first, axis=0).astype(float)
        neg = np.add.reduceat(w * (yv != 1)[:, None], first, axis=0).astype(float)
        won = (pos * (np.cumsum(neg, axis=0) - neg / 2)).sum(axis=0)
        return pd.DataFrame({"rep": np.arange(w.shape[1], dtype=np.int32), "_range": key[0], "_pos": pos.sum(axis=0), "_neg": neg.sum(axis=0), "_won": won, "_w": w.sum(axis=0).astype(float), "_e": (yv - pv) ** 2 @ w, "_p": pv @ w, "_y": yv @ w})

    parts = cells.groupBy("_range").applyInPandas(sums, "rep int, _range int, _pos double, _neg double, _won double, _w double, _e double, _p double, _y double")
    below = Window.partitionBy("rep").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_won", F.col("_won") + F.col("_pos") * F.coalesce(F.sum("_neg").over(below), F.lit(0.0)))
    pairs = F.sum("_pos") * F.sum("_neg")
    out = parts.groupBy("rep").agg(pairs.alias("_pairs"), *[(F.sum(c) / F.sum(t)).alias(n) for c, t, n in (("_e", "_w", "brier"), ("_p", "_w", "mean_prediction"), ("_y", "_w", "observed_risk"))], F.sum("_won").alias("_won"))
    two = F.col("_pairs") > 0
    return out.select("rep", F.when(two, F.col("_won") / F.col("_pairs")).alias("auroc"), *[F.when(two, F.col(n)).alias(n) for n in ("brier", "mean_prediction", "observed_risk")])


def bootstrap_measures(df: DataFrame, y: str = "y", p: str = "p", reps: int = 100, seed: int = 1, per_task: int = 50_000) -> DataFrame:
    """The measures of ``reps`` resamples of all rows of ``df``, each as large as ``df``, drawn with replacement.

    A resample's draws are dealt to ranges first (a multinomial number for each), then to the cells of a range: exactly the
    numbers of independent draws.  Tasks draw by seed, resample and range from stored cells, so a lost task draws the same.
    """
    cells = in_ranges(df.groupBy(col(y).cast("double").alias("y"), col(p).cast("double").alias("p")).agg(F.count("*").alias("n")), per_task)
    held = {r["_range"]: r["n"] for r in cells.table.groupBy("_range").agg(F.sum("n").alias("n")).collect()}  # a row for each range
    order = sorted(held)
    totals = np.array([held[k] for k in order], dtype=np.int64)
    at = {k: i for i, k in enumerate(order)}

    def drawn(key: int, rows: pd.DataFrame) -> np.ndarray:
        n = rows["n"].to_numpy(np.int64)
        out = np.zeros((len(n), reps), dtype=np.int64)
        for r in range(reps):
            own = np.random.default_rng([seed, r]).multinomial(totals.sum(), totals / totals.sum())[at[key]]
            out[:, r] = np.random.default_rng([seed, r, key + 1]).multinomial(own, n / n.sum())
        return out

    found = scan(cells.table, drawn)
    # A row for each resample: small, and read more than once.
    out = df.sparkSession.createDataFrame(found.toPandas().astype(object).where(lambda t: t.notna(), None), "rep int, auroc double, brier double, mean_prediction double, observed_risk double")
    cells.drop()
    return out
