"""Simulated populations: an anchor model of two environments, its binary form, and samples from a published table.

Rows are functions of ``spark.range`` and seeded hashes of the row number, so that any task can be run again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import binary_from_normal, col
from ..operators.sampling import uniform


@dataclass(frozen=True)
class AnchorHyper:
    """Deviations of the model's random coefficients; the first coefficients of X on Y are fixed."""

    p: int = 10
    sigma_m_h: float = 0.2
    sigma_m_x: float = 0.2
    sigma_m_y: float = 0.2
    sigma_b_x_h: float = 1.0
    sigma_b_y_h: float = 1.0
    sigma_b_x_ah: float = 0.5
    b_y_x: tuple[float, ...] = (1.0, 1.0)
    b_y_xa: tuple[float, ...] = (-0.8, -0.2)
    sigma_b_y_x: float | None = None  # draw all coefficients of X on Y instead
    sigma_b_y_xa: float | None = None
    outcome_offset: float = 0.0
    n_binary: int = 0
    shape: tuple[float, float] = (1.0, 10.0)  # of the beta distribution of binary features' frequencies


def high_dimensional(p: int = 500, outcome_offset: float = 0.0, n_binary: int = 0, factor: float = 4.0, sigma_b_x_ah: float = 0.0) -> AnchorHyper:
    return AnchorHyper(p=p, sigma_b_x_ah=sigma_b_x_ah, b_y_x=(), b_y_xa=(), sigma_b_y_x=factor / math.sqrt(p), sigma_b_y_xa=factor / math.sqrt(p), outcome_offset=outcome_offset, n_binary=n_binary)


@dataclass(frozen=True)
class AnchorModel:
    hyper: AnchorHyper
    m_h: float
    m_y: float
    b_y_h: float
    m_x: np.ndarray = field(repr=False)
    b_x_h: np.ndarray = field(repr=False)
    b_x_ah: np.ndarray = field(repr=False)
    b_y_x: np.ndarray = field(repr=False)
    b_y_xa: np.ndarray = field(repr=False)
    frequencies: np.ndarray = field(repr=False)


def draw_model(hyper: AnchorHyper = AnchorHyper(), seed: int = 1) -> AnchorModel:
    rng = np.random.default_rng(seed)
    p = hyper.p

    def coefficients(fixed: tuple[float, ...], sigma: float | None) -> np.ndarray:
        return rng.normal(0, sigma, p) if sigma is not None else np.array([*fixed, *[0.0] * (p - len(fixed))])

    return AnchorModel(
        hyper, rng.normal(0, hyper.sigma_m_h), rng.normal(0, hyper.sigma_m_y), rng.normal(0, hyper.sigma_b_y_h), rng.normal(0, hyper.sigma_m_x, p), rng.normal(0, hyper.sigma_b_x_h, p),
        rng.normal(0, hyper.sigma_b_x_ah, p), coefficients(hyper.b_y_x, hyper.sigma_b_y_x), coefficients(hyper.b_y_xa, hyper.sigma_b_y_xa), rng.beta(*hyper.shape, p),
    )


def normal(seed: int, label: str, row: Column) -> Column:
    """A standard normal number from two hashes of the row."""
    u = F.greatest(uniform(F.lit(seed), F.lit(label + "r"), row), F.lit(2.0**-53))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(F.lit(seed), F.lit(label + "a"), row))


def sample_anchor(spark: SparkSession, model: AnchorModel, n: int, environment: float, seed: int) -> DataFrame:
    """``X1 ... Xp, Y``: 0 is the internal environment, 1 the external one.  The last ``n_binary`` features are binary."""
    p = model.hyper.p
    a, row = float(environment), F.col("id")
    df = spark.range(n).withColumn("_h", F.lit(a * model.m_h) + normal(seed, "h", row))
    features = [f"X{j + 1}" for j in range(p)]
    df = df.select("id", "_h", *[(F.lit(a * model.m_x[j]) + F.col("_h") * F.lit(float(model.b_x_h[j] + a * model.b_x_ah[j])) + normal(seed, f"x{j}", row)).alias(x) for j, x in enumerate(features)])
    n_binary = min(model.hyper.n_binary, p)
    if n_binary:
        df = to_binary(df, features[p - n_binary :], model.frequencies[p - n_binary :])
    logit = F.lit(a * model.m_y + model.hyper.outcome_offset) + F.col("_h") * F.lit(model.b_y_h)
    for j, x in enumerate(features):
        if (c := float(model.b_y_x[j] + a * model.b_y_xa[j])) != 0:
            logit = logit + col(x) * F.lit(c)
    outcome = F.when(uniform(F.lit(seed), F.lit("y"), row) < 1 / (1 + F.exp(-logit)), 1).otherwise(0)
    return df.select(*features, outcome.alias("Y"))


def to_binary(df: DataFrame, columns: list[str], frequencies: np.ndarray) -> DataFrame:
    """1 where a normal value is in the lower part of its own column that has the wanted frequency."""
    row = df.agg(*[f(col(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    fixed = {c: binary_from_normal(col(c), F.lit(row[f"m{i}"]), F.lit(row[f"s{i}"]), F.lit(float(q))).cast("double") for i, (c, q) in enumerate(zip(columns, frequencies, strict=True))}
    return df.select(*[fixed[c].alias(c) if c in fixed else col(c) for c in df.columns])


def anchor_data(spark: SparkSession, n: int = 1000, hyper: AnchorHyper = AnchorHyper(), seed: int = 1, external: float = 1.0) -> dict[str, DataFrame]:
    model = draw_model(hyper, seed)
    parts = (("internalTrain", 0.0), ("internalTest", 0.0), ("externalTest", external))
    return {name: sample_anchor(spark, model, n, a, seed * 1000 + i) for i, (name, a) in enumerate(parts)}


def binary_anchor_data(spark: SparkSession, n: int = 1000, seed: int = 1) -> dict[str, DataFrame]:
    """The anchor data with all features binary; frequencies are shared, means and deviations each table's own."""
    data = anchor_data(spark, n, seed=seed)
    frequencies = np.random.default_rng(seed + 1).beta(1, 10, 10)
    return {k: to_binary(d, [f"X{j + 1}" for j in range(10)], frequencies) for k, d in data.items()}


GENDER, AGE = "gender = MALE", "age group"


def sample_published(spark: SparkSession, table: dict[str, float], outcome: int, seed: int, skew: dict[str, float] | None = None) -> DataFrame:
    """Rows from a published table of percentages: ``gender``, age groups but the last, clinical features and ``Y``.

    ``table`` has ``n``, ``gender = MALE``, at least one ``age group...`` and any clinical rows.  A skew above 1 makes a row more
    frequent among men, keeping its frequency overall.
    """
    ages = [k for k in table if k.startswith(AGE)]
    if not ages:
        raise ValueError("the table has no age groups")
    clinical = [k for k in table if k not in (GENDER, "n", "%", *ages)]
    male, skew = table[GENDER] / 100, skew or {}

    def by_gender(name: str) -> tuple[float, float]:
        q, s = table[name] / 100, skew.get(name, 1.0)
        return q / (1 - male + s * male), q / (male + (1 - male) / s)

    df = spark.range(int(table["n"])).withColumn("gender", F.when(uniform(F.lit(seed), F.lit("g"), F.col("id")) < male, 1).otherwise(0))
    draw = uniform(F.lit(seed), F.lit("age"), F.col("id"))
    columns = [col("gender")]
    total = [sum(by_gender(a)[g] for a in ages) for g in (0, 1)]
    below = [0.0, 0.0]
    for a in ages[:-1]:
        upto = [below[g] + by_gender(a)[g] / total[g] for g in (0, 1)]
        inside = [(draw >= below[g]) & (draw < upto[g]) for g in (0, 1)]
        columns.append(F.when(F.when(col("gender") == 1, inside[1]).otherwise(inside[0]), 1).otherwise(0).alias(a))
        below = upto
    for c in clinical:
        q0, q1 = by_gender(c)
        columns.append(F.when(uniform(F.lit(seed), F.lit(c), F.col("id")) < F.when(col("gender") == 1, F.lit(q1)).otherwise(F.lit(q0)), 1).otherwise(0).alias(c))
    return df.select(*columns, F.lit(outcome).alias("Y"))


def sample_published_outcomes(spark: SparkSession, without: dict[str, float], with_outcome: dict[str, float], seed: int, skew0: dict | None = None, skew1: dict | None = None) -> DataFrame:
    """Both classes below each other, in the order of a seeded hash."""
    both = sample_published(spark, without, 0, seed, skew0).unionByName(sample_published(spark, with_outcome, 1, seed + 1, skew1))
    return both.orderBy(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
