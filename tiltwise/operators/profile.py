"""Column profiles in two aggregates, however many columns there are."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, is_missing


@dataclass(frozen=True)
class ColumnProfile:
    name: str
    count: int
    missing: int
    low: float | None
    high: float | None
    mean: float | None
    sd: float | None  # of the sample
    arity: int  # distinct values: 0, 1, 2, or 3 for more; a missing value counts as one
    at_high: int  # rows with the highest value
    zero_one: bool  # nothing but 0 and 1


def profile(df: DataFrame, columns: list[str] | None = None, count: str | None = None) -> dict[str, ColumnProfile]:
    """Profile numeric columns; with ``count``, a row stands for as many equal ones as that column says.

    The first pass finds the extremes, the second counts what lies between them, so the exact arity needs neither a distinct
    aggregate nor an expand.  Both are single rows whose width grows with the number of columns, never with the rows.
    """
    columns = list(df.columns if columns is None else columns)
    if not columns:
        return {}
    x = {c: col(c).cast("double") for c in columns}
    valid = {c: F.when(~is_missing(x[c]), x[c]) for c in columns}
    times = F.col(count) if count else F.lit(1)

    def number(which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, times)), F.lit(0))

    first = df.agg(
        number(F.lit(True)).alias("n"),
        *[f(valid[c]).alias(f"{a}{i}") for i, c in enumerate(columns) for a, f in (("lo", F.min), ("hi", F.max))],
        *[number(valid[c].isNotNull()).alias(f"k{i}") for i, c in enumerate(columns)],
        *[(F.try_divide(F.sum(valid[c] * times), number(valid[c].isNotNull())) if count else F.avg(valid[c])).alias(f"av{i}") for i, c in enumerate(columns)],
        *([] if count else [F.stddev_samp(valid[c]).alias(f"sd{i}") for i, c in enumerate(columns)]),
    ).first()
    between: list[Column] = []
    for i, c in enumerate(columns):
        lo, hi = first[f"lo{i}"], first[f"hi{i}"]
        if lo is None:
            continue
        between.append(number((valid[c] > F.lit(lo)) & (valid[c] < F.lit(hi))).alias(f"mid{i}"))
        between.append(number(valid[c] == F.lit(hi)).alias(f"top{i}"))
        between.append(number((valid[c] != 0) & (valid[c] != 1)).alias(f"odd{i}"))
        if count:  # around the mean, which is known by now
            between.append(F.sum(times * (valid[c] - F.lit(first[f"av{i}"])) ** 2).alias(f"sq{i}"))
    second = df.agg(*between).first() if between else None
    out = {}
    for i, c in enumerate(columns):
        lo, hi, missing = first[f"lo{i}"], first[f"hi{i}"], first["n"] - first[f"k{i}"]
        if count:
            sd = math.sqrt(second[f"sq{i}"] / (first[f"k{i}"] - 1)) if first[f"k{i}"] > 1 else None
        else:
            sd = first[f"sd{i}"]
        values = 0 if lo is None else 1 if lo == hi else 3 if second[f"mid{i}"] else 2
        out[c] = ColumnProfile(c, first["n"], missing, lo, hi, first[f"av{i}"], sd, min(3, values + (missing > 0)), second[f"top{i}"] if lo is not None else 0, lo is not None and not missing and second[f"odd{i}"] == 0)
    return out


def profile_frame(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The profile as rows, one for each column of ``df``."""
    rows = [(p.name, p.count, p.missing, p.low, p.high, p.mean, p.sd, p.arity, p.at_high, p.zero_one) for p in profile(df, columns).values()]
    return df.sparkSession.createDataFrame(rows, "feature string, n long, missing long, low double, high double, mean double, sd double, arity int, at_high long, zero_one boolean")
