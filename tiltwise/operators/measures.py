"""Performance measures, divergences of weights and standardised mean differences, as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import binary_smd, col, continuous_smd, log_likelihood, single_smd, squared_error, weighted_mean, x_log_x
from .transform import TransformSpec

#: Names of the reported measures and fields.
CORE_MEASURES = ("AUROC", "Brier score", "Global calibration mean prediction", "Global calibration observed risk")
WEIGHTING_CORE = ("Opt err", "n iter", "n outcome", "Max Weighted SMD")


def derived_fields(core: tuple[str, ...]) -> list[str]:
    """The core fields, then four for each of them; "Median" has four blanks after it."""
    return [*core, *(name for f in core for name in (f"95% lower {f}", f"Median    {f}", f"95% upper {f}", f"{f} sd"))]


def estimation_fields() -> list[str]:
    return derived_fields(CORE_MEASURES)


def weighting_fields() -> list[str]:
    return ["n repetitions", *derived_fields(WEIGHTING_CORE)]


def auroc(df: DataFrame, y: Column, p: Column, w: Column | None = None, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Weighted probability that a case is predicted higher than a control, ties counting half; one row for each group.

    Rows are summed by prediction before anything is ordered.  The running sum is taken in two steps so that no task holds
    all predictions: ranges of predictions are summed first, and each range then adds what lies below it.  With one class
    only, the value is null.
    """
    weight = w if w is not None else F.lit(1.0)
    points = df.groupBy(*by, p.cast("double").alias("_p")).agg(F.sum(F.when(y == 1, weight).otherwise(0.0)).alias("_pos"), F.sum(F.when(y == 1, 0.0).otherwise(weight)).alias("_neg"))
    points = points.withColumn("_range", _range_of(df, p))
    inside = Window.partitionBy(*by, "_range").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    points = points.withColumn("_below", F.sum("_neg").over(inside) - F.col("_neg") / 2)
    ranges = points.groupBy(*by, "_range").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"), F.sum(F.col("_pos") * F.col("_below")).alias("_won"))
    across = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_won", F.col("_won") + F.col("_pos") * F.coalesce(F.sum("_neg").over(across), F.lit(0.0)))
    pairs = F.sum("_pos") * F.sum("_neg")
    return ranges.groupBy(*by).agg((F.sum("_won") / F.when(pairs > 0, pairs)).alias("auroc"))


def _range_of(df: DataFrame, p: Column, ranges: int = 256) -> Column:
    """Which of about equally filled ranges a prediction ``_p`` is in, from approximate quantiles of all predictions."""
    edges = df.agg(F.percentile_approx(p.cast("double"), [i / ranges for i in range(1, ranges)], 10 * ranges).alias("e")).first()["e"]

    def search(low: int, high: int) -> Column:  # a tree of comparisons
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("_p") < F.lit(edges[middle]), search(low, middle)).otherwise(search(middle + 1, high))

    edges = sorted(set(edges or ()))
    return search(0, len(edges))


def measures(df: DataFrame, y: str = "y", p: str = "p", w: str | None = None, by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """``by, n, n_outcome, auroc, brier, mean_prediction, observed_risk, log_likelihood`` for rows of positive weight.

    The four measures and the likelihood are null unless both classes are there.
    """
    if w:
        df = df.where(col(w) > 0)
    yc, pc, wc = col(y), col(p), col(w) if w else None
    moments = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(yc == 1, 1).otherwise(0)).alias("n_outcome"), weighted_mean(squared_error(yc, pc), wc).alias("brier"),
        weighted_mean(pc, wc).alias("mean_prediction"), weighted_mean(yc, wc).alias("observed_risk"), weighted_mean(log_likelihood(yc, pc), wc).alias("log_likelihood"),
    )
    area = auroc(df, yc, pc, wc, by)
    joined = moments.join(area, list(by)) if by else moments.withColumn("auroc", area.scalar())
    two = (F.col("n_outcome") > 0) & (F.col("n_outcome") < F.col("n"))
    values = ("auroc", "brier", "mean_prediction", "observed_risk", "log_likelihood")
    return joined.select(*by, "n", "n_outcome", *[F.when(two, F.col(v)).alias(v) for v in values])


def measures_long(df: DataFrame, y: str = "y", p: str = "p", w: str | None = None) -> DataFrame:
    """The four reported measures as rows ``measure, value``."""
    one = measures(df, y, p, w)
    names = dict(zip(CORE_MEASURES, ("auroc", "brier", "mean_prediction", "observed_risk"), strict=True))
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(c).alias("value")) for n, c in names.items()])).alias("m")).select("m.*")


def weight_divergence(df: DataFrame, w: Column) -> DataFrame:
    """``max_weight, chi2_to_uniform, kl``: how far weights are from uniform.  One pass: sums of w, w^2 and w log w are enough."""
    sums = df.agg(F.count(F.lit(1)).alias("n"), F.max(w).alias("top"), F.sum(w).alias("s"), F.sum(w * w).alias("s2"), F.sum(x_log_x(w)).alias("sl"))
    n, s = F.col("n"), F.col("s")
    return sums.select(F.col("top").alias("max_weight"), (n * F.col("s2") / (s * s) - 1).alias("chi2_to_uniform"), (F.log(n) + F.col("sl") / s - F.log(s)).alias("kl"))


def smd_sets(spec: TransformSpec) -> list[tuple[str, ...]]:
    """Terms that are scored together: a variable with its square in the same stratum, else a term of its own."""
    sets: dict[tuple, list[str]] = {}
    for t in spec.terms:
        sets.setdefault((t.variable, t.stratum), []).append(t.name)
    return [tuple(names) for names in sets.values()]


def smd(z: DataFrame, mu: dict[str, float], sets: list[tuple[str, ...]], w: Column | None = None) -> DataFrame:
    """``feature, smd`` for each set of columns of ``z``: one aggregate over ``z``, then one row for each set.

    Two columns are a value and its square.  One column is two-valued if nothing lies strictly between its extremes, else
    its mean square less its mean stands for the variance.  Sets of other sizes have no score.
    """
    spark = z.sparkSession
    sets = [s for s in sets if len(s) in (1, 2)]
    names = list(dict.fromkeys(n for s in sets for n in s))
    bounds = z.agg(*[f(col(n)).alias(f"{a}{i}") for i, n in enumerate(names) for a, f in (("lo", F.min), ("hi", F.max))]).first()
    aggregates = []
    for i, n in enumerate(names):
        aggregates += [weighted_mean(col(n), w).alias(f"m{i}"), weighted_mean(col(n) * col(n), w).alias(f"s{i}")]
        aggregates.append(F.count(F.when((col(n) > F.lit(bounds[f"lo{i}"])) & (col(n) < F.lit(bounds[f"hi{i}"])), 1)).alias(f"mid{i}"))
    row = z.agg(*aggregates).first()
    at = {n: i for i, n in enumerate(names)}
    rows = []
    for s in sets:
        i = at[s[0]]
        kind = "continuous" if len(s) == 2 else "binary" if row[f"mid{i}"] == 0 and bounds[f"lo{i}"] < bounds[f"hi{i}"] else "single"
        rows.append((s[0], kind, float(mu[s[0]]), float(mu[s[1]]) if len(s) == 2 else None, float(row[f"m{i}"]), float(row[f"m{at[s[1]]}"] if len(s) == 2 else row[f"s{i}"]), float(bounds[f"lo{i}"]), float(bounds[f"hi{i}"])))
    table = spark.createDataFrame(rows, "feature string, kind string, m0 double, s0 double, m1 double, s1 double, low double, high double")
    m0, s0, m1, s1, low, high = (F.col(c) for c in ("m0", "s0", "m1", "s1", "low", "high"))
    score = F.when(F.col("kind") == "continuous", continuous_smd(m0, s0, m1, s1)).when(F.col("kind") == "binary", binary_smd(m0, m1, low, high)).otherwise(single_smd(m0, m1, s1))
    return table.select("feature", score.alias("smd"))


def max_smd(z: DataFrame, mu: dict[str, float], sets: list[tuple[str, ...]], w: Column | None = None) -> float | None:
    """The largest score; missing and undefined ones are passed over."""
    found = [r["smd"] for r in smd(z, mu, sets, w).collect() if r["smd"] is not None and not math.isnan(r["smd"])]  # a row for each set
    return max(found) if found else None


def post_diagnostics(z: DataFrame, w: str, mu: dict[str, float], sets: list[tuple[str, ...]], smd_scope: str = "all") -> dict[str, float | None]:
    """Field values of the four post-diagnostics; ``smd_scope="outcome"`` scores the outcome ``Y`` alone."""
    row = weight_divergence(z, col(w)).first()
    chosen = [s for s in sets if s == ("Y",)] if smd_scope == "outcome" else sets
    return {"Max weight": row["max_weight"], "chi2 to uniform": row["chi2_to_uniform"], "kl": row["kl"], "Max Weighted SMD": max_smd(z, mu, chosen, col(w))}
