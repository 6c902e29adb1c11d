"""Sampling operators.  A sample is a multiplicity for each row, not a copy of it.

Rows carry an id that is assigned once and stored, as ids made on the fly are not stable when a plan is run again.  Draws are
hashes of seed, repetition and id, so a lost task draws the same again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..sources.scratch import Scratch


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the hash of the keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") * F.lit(2.0**-53)


def python_round_half_even(x: float) -> int:
    return round(x)


def stratified_sizes(n0: int, n1: int, n_max: int) -> tuple[int, int]:
    """Sizes of the two classes in a sample of n_max: halves, or all of the class that is smaller than half and the rest of the other."""
    if n1 < n_max / 2:
        return min(n_max - n1, n0), n1
    if n0 < n_max / 2:
        return n0, min(n_max - n0, n1)
    half = python_round_half_even(n_max / 2)
    return half, n_max - half


def sampling_mode(n: int, n_max: int, stratified: bool = True) -> str:
    """"stratified" or "subset" where the cap is below three quarters of the rows, else "bootstrap"."""
    return ("stratified" if stratified else "subset") if n_max < 0.75 * n else "bootstrap"


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Dense ids from 0 in the order of partitions: counts for each partition are gathered (a row each) and added up.

    Rows are stored with their partition and place first, so that both sides of the join, and tasks that run again, number them
    alike.  The side with a row for each partition is stored too and sent to all tasks, so no row is shuffled.
    """
    tagged = Scratch(df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())).table
    sizes = tagged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_part", "_low", "_start")
    return tagged.join(F.broadcast(Scratch(starts).table), "_part").withColumn(name, F.col("_at") - F.col("_low") + F.col("_start")).drop("_part", "_at", "_low", "_start")


def _poisson(mean: float, u: Column) -> Column:
    """A Poisson number from a uniform one, by the distribution function; what lies beyond 1e-15 is not drawn."""
    steps, below, term = [], 0.0, math.exp(-mean)
    while below + term < 1 - 1e-15 and len(steps) < mean + 40 * (1 + math.sqrt(mean)):
        below += term
        steps.append(below)
        term *= mean / len(steps)

    def search(low: int, high: int) -> Column:  # how many steps are not above u, by a tree of comparisons
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(u < steps[middle], search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(steps))


def bootstrap(df: DataFrame, size: int, reps: int, seed: int = 1, row_id: str = "row_id", n: int | None = None, label: str = "") -> DataFrame:
    """``rep, mult`` and the columns of ``df``: each repetition draws ``size`` rows with replacement.

    Every row draws a Poisson number for each repetition by a hash, where it stands: of some five deviations fewer draws than
    ``size``, so that the few that are missing are drawn from all ids and added.  The numbers then are those of ``size`` draws,
    exactly, and no draw is shuffled but those few.  A row that has draws of both kinds comes twice; its numbers add up.
    """
    n = df.count() if n is None else n
    if n == 0 or size == 0:
        return df.select(F.lit(0).alias("rep"), F.lit(1).cast("long").alias("mult"), "*").where("false")
    spark, attempt = df.sparkSession, 0
    while True:
        mean = max(0.0, size - (5 + attempt) * math.sqrt(size) - 5 * attempt) / n
        rep = F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))
        drawn = df.withColumn("rep", rep).withColumn("_u", uniform(F.lit(seed), F.lit(label), F.lit(attempt), F.col("rep"), col(row_id)))
        own = drawn.withColumn("mult", _poisson(mean, F.col("_u")).cast("long")).drop("_u")
        totals = {r["rep"]: r["n"] for r in own.groupBy("rep").agg(F.sum("mult").alias("n")).collect()}  # a row for each repetition
        if max(totals.values()) <= size:
            break
        attempt += 1
    missing = spark.createDataFrame([(r, int(size - t)) for r, t in totals.items() if t < size], "rep int, k long")
    more = missing.select("rep", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("k"))
    more = more.groupBy("rep", F.floor(uniform(F.lit(seed), F.lit(label), F.lit("more"), F.col("rep"), F.col("k")) * n).cast("long").alias("_id")).agg(F.count("*").alias("_more"))
    columns = ["rep", "mult", *df.columns]
    if sum(size - t for t in totals.values()) <= 1_000_000:
        more = F.broadcast(more)  # so that no row is shuffled to be drawn once more
    added = more.join(df, F.col("_id") == col(row_id)).withColumnRenamed("_more", "mult")
    return own.where("mult > 0").select(*[col(c) for c in columns]).unionByName(added.select(*[col(c) for c in columns]))


def subset(df: DataFrame, size: int, reps: int, seed: int = 1, row_id: str = "row_id") -> DataFrame:
    """``rep, mult`` and the columns of ``df``: each repetition takes exactly ``size`` different rows.

    Hash buckets are counted first; whole buckets below the cut are taken and just the one at the cut is ordered.
    """
    copies = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_u", uniform(F.lit(seed), F.col("rep"), col(row_id)))
    copies = copies.withColumn("_bucket", F.floor(F.col("_u") * 4096).cast("int"))
    counts = copies.groupBy("rep", "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("rep").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("_upto", F.sum("_n").over(upto)).where(F.col("_upto") - F.col("_n") < size).withColumn("_left", F.lit(size) - F.col("_upto") + F.col("_n"))
    near = copies.join(counts, ["rep", "_bucket"])
    whole = near.where("_n <= _left")
    order = Window.partitionBy("rep", "_bucket").orderBy("_u", col(row_id))
    part = near.where("_n > _left").withColumn("_place", F.row_number().over(order)).where("_place <= _left").drop("_place")
    return whole.unionByName(part).withColumn("mult", F.lit(1).cast("long")).drop("_u", "_bucket", "_n", "_upto", "_left")


def stratified(df: DataFrame, y: str, n_max: int, reps: int, seed: int = 1) -> DataFrame:
    """``rep, mult`` and the columns of ``df``: each class is drawn with replacement to its size; ids are given by class."""
    parts = []
    counts = {r["y"]: r["n"] for r in df.groupBy(col(y).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}  # two rows
    sizes = dict(zip((0, 1), stratified_sizes(counts.get(0, 0), counts.get(1, 0), n_max), strict=True))
    for value in (0, 1):
        if sizes[value]:
            own = with_row_id(df.where(col(y) == value), "_own")
            parts.append(bootstrap(own, sizes[value], reps, seed, "_own", counts[value], f"class {value}").drop("_own"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upsample(df: DataFrame, y: str) -> DataFrame:
    """Repeat the rows of class 1 floor(n0 / n1) times if they are fewer than half of the others."""
    from .optimizers import upsampling

    row = df.agg(F.count(F.when(col(y) == 1, 1)).alias("n1"), F.count(F.when(col(y) == 0, 1)).alias("n0")).first()
    times = upsampling(row["n1"], row["n0"])
    if times == 1:
        return df
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(col(y) == 1, times).otherwise(1)))).drop("_copy")


def shuffle(df: DataFrame, seed: int, row_id: str) -> DataFrame:
    """Rows in the order of a seeded hash of their ids."""
    return df.orderBy(F.xxhash64(F.lit(seed), col(row_id)), col(row_id))


class Sampler(Protocol):
    """Where the repetitions of an estimation come from; give your own in the settings."""

    def draw(self, rows: DataFrame, n: int) -> DataFrame:
        """``rep`` (an int from 0), ``mult`` (a long above 0) and the columns of ``rows``, for each row that a repetition takes.

        ``rows`` has the outcome ``_y``, the prediction ``_p``, the features and ``row_id`` from 0 to ``n`` - 1.  A row may come
        more than once in a repetition; its numbers add up.
        """


@dataclass(frozen=True)
class ByMode:
    """The sampler unless another is given: by classes or a subset where ``n_max`` is a cap, else with replacement."""

    n_max: int
    reps: int
    stratified: bool = True
    seed: int = 1

    def draw(self, rows: DataFrame, n: int) -> DataFrame:
        mode, size = sampling_mode(n, self.n_max, self.stratified), min(n, self.n_max)
        if mode == "stratified":
            return stratified(rows, "_y", self.n_max, self.reps, self.seed)
        if mode == "subset":
            return subset(rows, size, self.reps, self.seed)
        return bootstrap(rows, size, self.reps, self.seed, n=n)
