"""Estimation of a model's performance on external data from its means.

Transform, diagnostics and summaries are aggregates.  Repetitions are independent: each is one group of different rows that is
solved in one task, or, above ``max_task_rows``, a column of multiplicities on one table, and all of them are solved by the same passes.
The whole table is solved without a sample by ``solve_whole``.
"""

from __future__ import annotations

import logging
import math
import time
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..operators import distributed, local, resample, sampling, vectors
from ..operators.measures import CORE_MEASURES, WEIGHTING_CORE, estimation_fields, measures, measures_long, smd_sets, weighting_fields
from ..operators.optimizers import AdamSoftmax, ConvexOptimizer, DualSGD, TunedExponentiatedGradient, WeightOptimizer, upsampling
from ..operators.rowstate import adam_weights
from ..operators.prediagnostics import PreDiagnosis, pre_diagnostics
from ..operators.summary import summary_fields, union_sections
from ..operators.transform import TransformSpec, normalise
from ..sources.scratch import Scratch

log = logging.getLogger(__name__)
WARN_SMD = 0.05
ROWS_IN_TASK = 50_000  # different rows that a task of a pass takes


@dataclass(frozen=True)
class EstimatorSettings:
    optimizer: WeightOptimizer = field(default_factory=TunedExponentiatedGradient)
    n_max: int = 20000
    n_repetitions: int = 1
    stratified: bool = True
    max_diff: float = 0.01
    max_wsmd: float = 0.05
    np_min_ratio: float = 4
    smd_scope: str = "all"  # or "outcome": score the column Y alone
    warm_steps: int = 0  # gradient passes over the whole table before the repetitions
    warm_alpha: float = 0.1
    seed: int = 1
    sampler: sampling.Sampler | None = None  # ``sampling.ByMode`` with the settings above unless given
    max_task_rows: int = 200_000  # repetitions of more different rows are solved together, as passes over one table


@dataclass
class Estimation:
    status: str
    pre: PreDiagnosis
    minutes: float | None = None
    repetitions: DataFrame | None = None  # rep, metric, value
    weighting: DataFrame | None = None  # field, value
    estimation: DataFrame | None = None
    extra: DataFrame | None = None  # fields that the two lists leave out
    results: DataFrame | None = None  # section, field, value_num, value_str


def smd_status(mean_smd: float | None, max_wsmd: float) -> str:
    if mean_smd is None or np.isnan(mean_smd):
        return "NULL-WSMD"
    if mean_smd > max_wsmd:
        log.error("max weighted SMD %s is above %s", mean_smd, max_wsmd)
        return "Large-WSMD"
    if mean_smd > WARN_SMD:
        log.warning("max weighted SMD %s is above %s", mean_smd, WARN_SMD)
    return "Success"


def one_repetition(z: np.ndarray, names: list[str], y: np.ndarray, p: np.ndarray, mult: np.ndarray, mu: dict[str, float], optimizer: WeightOptimizer, sets: list[tuple[str, ...]]) -> dict[str, float]:
    """Optimise, diagnose, measure.  Nothing without both classes; only error and iterations unless the optimizer succeeds."""
    if len(np.unique(y)) != 2:
        return {}
    keys = np.column_stack([z, y, p])
    distinct, at = np.unique(keys, axis=0, return_inverse=True)
    counts = np.bincount(at.ravel(), weights=mult)
    z, y, p = distinct[:, :-2], distinct[:, -2], distinct[:, -1]
    r = optimizer.optimize(z, np.array([mu[c] for c in names]), counts)
    out = {k: float(v) for k, v in (("Opt err", r.err), ("n iter", r.iterations)) if v is not None}
    if r.status == "Success" and np.isfinite(r.weights).all():
        w = r.weights
        used = w > 0
        out |= {"n": float(counts[used].sum()), "n outcome": float(counts[used] @ y[used])}
        out |= local.divergence(w, counts)
        out["Max Weighted SMD"] = local.max_smd({c: z[:, i] for i, c in enumerate(names)}, mu, sets, w * counts)
        out |= local.measures(y[used], p[used], (w * counts)[used])
    return out


def merged(samples: DataFrame, names: list[str], warm: bool = False) -> DataFrame:
    """Equal rows of a repetition as one; their numbers are added up where they stand, before a row is shuffled."""
    return samples.groupBy("rep", "_y", "_p", *[col(c) for c in names], *(["_w0"] if warm else [])).agg(F.sum("mult").alias("mult"))


def run_repetitions(samples: DataFrame, names: list[str], mu: dict[str, float], optimizer: WeightOptimizer, sets: list[tuple[str, ...]], warm: bool = False) -> DataFrame:
    """``rep, metric, value`` from ``rep, mult, _y, _p`` and the features; one group of different rows for each repetition."""

    def body(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = optimizer
        if warm:
            # Equal rows share their weight, so the start is looked up after rows are merged.
            order = np.column_stack([rows[names].to_numpy(float), rows["_y"], rows["_p"]])
            _, first = np.unique(order, axis=0, return_index=True)
            own = type(optimizer)(**{**optimizer.__dict__, "w0": rows["_w0"].to_numpy(float)[first]})
        found = one_repetition(rows[names].to_numpy(float), names, rows["_y"].to_numpy(float), rows["_p"].to_numpy(float), rows["mult"].to_numpy(float), mu, own, sets)
        return pd.DataFrame({"rep": key[0], "metric": list(found), "value": list(found.values())}, columns=["rep", "metric", "value"])

    return merged(samples, names, warm).groupBy("rep").applyInPandas(body, "rep int, metric string, value double")


def feature_sets(names: list[str], spec: TransformSpec | None, scope: str) -> list[tuple[str, ...]]:
    sets = smd_sets(spec) if spec else [(n,) for n in names]
    sets = [tuple(n for n in s if n in names) for s in sets]
    return [s for s in sets if s and (scope == "all" or s == ("Y",))]


def estimate_external(internal: DataFrame, mu: dict[str, float], settings: EstimatorSettings = EstimatorSettings(), y: str = "y", p: str = "p", spec: TransformSpec | None = None) -> Estimation:
    """``internal`` has outcome ``y``, prediction ``p`` and the transformed features under the names of ``mu``.

    The estimate is the mean over repetitions; it is given only if the status is ``Success``.
    """
    spark = internal.sparkSession
    names = [c for c in internal.columns if c not in (y, p)]
    pre = pre_diagnostics(internal.select(*[col(c) for c in names]), mu, settings.max_diff, settings.np_min_ratio, settings.n_max)
    log_rows = pre.frame(spark).select("field", "value_num", "value_str")
    failed = Estimation("Failure", pre, results=union_sections({"preDiagnosis": log_rows}))
    if pre.status != "Success":
        log.error("pre-diagnosis status %s", pre.status)
        return failed
    began = time.time()
    names = pre.represented
    mu = {c: mu[c] for c in names}
    rows = internal.where(pre.keep) if pre.keep is not None else internal
    rows = rows.select(col(y).cast("double").alias("_y"), col(p).cast("double").alias("_p"), *[col(c).cast("double").alias(c) for c in names])
    if settings.warm_steps:
        rows = warm_start(rows, names, mu, settings)
    rows = sampling.with_row_id(rows)
    sampler = settings.sampler or sampling.ByMode(settings.n_max, settings.n_repetitions, settings.stratified, settings.seed)
    samples = sampler.draw(rows, pre.n_rows)
    sets = feature_sets(names, spec, settings.smd_scope)
    warm, largest = bool(settings.warm_steps), min(pre.n_rows, settings.n_max)
    if settings.sampler is not None or largest > settings.max_task_rows:
        samples = Scratch(merged(samples, names, warm)).table
        largest = samples.groupBy("rep").count().agg(F.max("count")).first()[0] or 0
    if largest > settings.max_task_rows:
        reps = vectors.run_vectors(samples, names, mu, settings.optimizer, sets, settings.n_repetitions, warm).persist()
    else:
        reps = run_repetitions(samples, names, mu, settings.optimizer, sets, warm).persist()
    fields = summary_fields(reps).persist()
    found = {r["field"]: r["value"] for r in fields.collect()}  # five rows for each metric
    if not any(v is not None and not np.isnan(v) for v in found.values()):
        return failed
    n_good = reps.where("metric = 'Max Weighted SMD'").count()
    out = Estimation(smd_status(found.get("Max Weighted SMD"), settings.max_wsmd), pre, (time.time() - began) / 60, reps)
    counted = fields.unionByName(spark.createDataFrame([("n repetitions", float(n_good))], "field string, value double"))
    out.weighting = counted.where(F.col("field").isin(weighting_fields()))
    sections = {"preDiagnosis": log_rows, "weighting": out.weighting}
    if out.status == "Success":
        out.estimation = fields.where(F.col("field").isin(estimation_fields()))
        sections["estimation"] = out.estimation
    out.extra = fields.where(~F.col("field").isin([*weighting_fields(), *estimation_fields()]))
    sections["extra"] = out.extra
    out.results = union_sections(sections)
    return out


def warm_start(rows: DataFrame, names: list[str], mu: dict[str, float], settings: EstimatorSettings) -> DataFrame:
    """Add ``_w0``: weights after some gradient passes over all rows, on standardised columns."""
    scaled, target, moments = normalise(rows, mu, columns=names)
    kept = list(moments)
    theta = distributed.gradient_tilt(scaled, target, kept, settings.warm_alpha, settings.warm_steps)
    score = F.lit(0.0)
    for c, t in zip(kept, theta, strict=True):
        m, s = moments[c]
        score = score - (col(c) - F.lit(m)) / F.lit(s) * F.lit(float(t))
    return rows.withColumn("_w0", F.exp(F.least(F.greatest(score, F.lit(-60.0)), F.lit(60.0))))


@dataclass
class WholeSolution:
    """Weights of a whole table (its different rows with ``_count`` and a weight) and how solving ended; no weights unless it did.

    ``log`` is the optimizer's, a row for each state it saw (see ``summary.log_frame``); ``nu`` are its multipliers on
    standardised columns, by name.
    """

    status: str
    err: float | None
    max_abs_err: float | None
    iterations: int | None
    table: DataFrame | None
    log: list[tuple] = field(default_factory=list)
    nu: dict[str, float] | None = None

    @property
    def weights(self) -> DataFrame:
        if self.table is None:
            raise ValueError(f"no weights were found: {self.status}")
        return self.table


def solve_whole(z: DataFrame, mu: dict[str, float], optimizer: WeightOptimizer | None = None, max_local: int = 50_000, name: str = "w", w0: str | None = None, count: str | None = None) -> WholeSolution:
    """Weights for equal rows of ``z`` (its columns, ``_count`` and ``w``), with no sample and no cap.

    Without an optimizer, Newton steps on the dual run over the table.  With one, its own steps do: on the driver if the
    different rows are at most ``max_local``, else as passes over them.  W-MSE takes the same steps in both; CVX ends at the
    same optimum, by Newton steps over a table; the samples of dual SGD are drawn on the driver and are hash buckets of a
    table; Adam's states are columns of a stored table.  Columns that do not vary are left out, as by the optimizers.

    ``w0`` names a column of initial weights above 0 (Newton and W-MSE): the weights are ``w0`` tilted.  Others refuse it.

    ``z`` is read once, to merge equal rows.  ``count`` names its column of how many rows each stands for where that is done,
    as by ``different_rows``, so that several runs share it.
    """
    if getattr(optimizer, "w0", None) is not None:
        raise ValueError("rows of a table have no order: give their initial weights as a column, w0")
    if w0 is not None and optimizer is not None and not hasattr(optimizer, "w0"):
        raise ValueError(f"{optimizer.name} takes no initial weights")
    columns = [c for c in z.columns if c in mu and c not in (w0, count)]
    small = z.withColumnRenamed(count, "_count") if count else different_rows(z)
    if optimizer is not None:
        local_rows = small.limit(max_local + 1).toPandas()
        if len(local_rows) <= max_local:
            own = optimizer if w0 is None else replace(optimizer, w0=local_rows[w0].to_numpy(float))
            r = own.optimize(local_rows[columns].to_numpy(float), np.array([mu[c] for c in columns]), local_rows["_count"].to_numpy(float))
            good = r.status == "Success" and np.isfinite(r.weights).all()
            local_rows[name] = r.weights
            return WholeSolution(r.status, r.err, r.max_abs_err, r.iterations, z.sparkSession.createDataFrame(local_rows) if good else None, r.log)
    return _solve_table(small, mu, columns, optimizer, name, w0)


def different_rows(z: DataFrame) -> DataFrame:
    """Equal rows as one, with ``_count``, stored; the table goes with the session, as weights read it too."""
    return Scratch(distributed.compress(z, z.columns)).table


def _solve_table(small: DataFrame, mu: dict[str, float], columns: list[str], optimizer: WeightOptimizer | None, name: str, w0: str | None) -> WholeSolution:
    """As passes over the different rows, which are stored with their counts.

    They take as many tasks as they need, not as many as the table had: a few rows are a task, so a pass is short.
    """
    few = max(1, -(-small.count() // ROWS_IN_TASK))
    # Moments are those of all rows, by their counts.
    _, target, moments = normalise(small, mu, columns=columns, count="_count")
    plain = isinstance(optimizer, (TunedExponentiatedGradient, DualSGD, AdamSoftmax)) and all(set(c) <= {0, 1} for c in _two_values(small, columns))
    if plain:
        moments, target = {c: (0.0, 1.0) for c in columns}, {c: mu[c] for c in columns}  # 0/1 columns are not rescaled
    kept = list(moments)
    standard = {c: (col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in moments.items()}
    if isinstance(optimizer, AdamSoftmax):
        rows = small.withColumn("_z", F.array(*[e.cast("double") for e in standard.values()])).coalesce(few)
        table, status, err, worst, n = adam_weights(optimizer, rows, np.array([target[c] for c in kept]), name)
        return WholeSolution(status, err, worst, n, table if status == "Success" else None)
    base = F.log(col(w0).cast("double")) if w0 is not None else None
    case = None if getattr(optimizer, "outcome_column", None) is None else columns[optimizer.outcome_column]
    if plain and getattr(optimizer, "anchor_outcome", False) and case is not None:
        base = _anchored(small, case, mu[case], base)
    if isinstance(optimizer, DualSGD):
        sizes = {r["c"]: r["n"] for r in small.groupBy((col(case) == 1).alias("c")).agg(F.sum("_count").alias("n")).collect()}  # two rows
        times = upsampling(sizes.get(True, 0), sizes.get(False, 0))
        base = F.when(col(case) == 1, F.lit(math.log(times))).otherwise(0.0)
        copies = sizes.get(True, 0) * times + sizes.get(False, 0)
    scaled = small.select(*[e.alias(c) for c, e in standard.items()], "_count", *([base.alias("_log_base")] if base is not None else [])).coalesce(few).persist()
    log_base = "_log_base" if base is not None else None
    scaled.count()
    parts = scaled.rdd.getNumPartitions()
    try:
        if isinstance(optimizer, ConvexOptimizer) and optimizer.by_squares:
            found, r = distributed.newton_squares(scaled, target, kept, "_count", optimizer.lam, 0.0, optimizer.bound, parts=parts)
            u, v, half = found[:-2], found[-2], found[-1]
            weight = F.greatest(F.lit(0.0), 1 + (distributed.linear_score(standard, u) - F.lit(float(v))) / F.lit(float(2 * half)))
            ended = WholeSolution(r.status, r.err, r.max_abs_err, r.iterations, None, nu=dict(zip(kept, map(float, u), strict=True)))
        else:
            if optimizer is None or isinstance(optimizer, ConvexOptimizer):
                bound = optimizer.bound if optimizer is not None and optimizer.lam > 0 else None
                theta, r = distributed.newton_tilt(scaled, target, kept, "_count", log_base=log_base, bound=bound, parts=parts)
                ended = WholeSolution(r.status, r.err, r.max_abs_err, r.iterations, None)
            else:
                tilt = distributed.TableTilt(scaled, target, kept, "_count", log_base, parts)
                if isinstance(optimizer, DualSGD):
                    end = optimizer.solve(tilt, copies)
                    tilt.drop()
                elif hasattr(optimizer, "solve"):
                    end = optimizer.solve(tilt)
                else:
                    raise NotImplementedError(f"{optimizer.name} needs the rows themselves")
                theta, ended = end.theta, WholeSolution(end.status, end.err, end.worst, end.iterations, None, end.log)
            ended.nu = dict(zip(kept, map(float, theta), strict=True))
            lse, n, _, _ = distributed.tilted_sums(scaled, kept, theta, False, "_count", log_base=log_base, parts=parts)
            weight = F.exp(distributed.linear_score(standard, theta, base) - F.lit(lse)) * F.lit(n)
        if ended.status == "Success":
            ended.table = small.withColumn(name, weight)
        else:
            log.error("solving the whole table ended with %s", ended.status)
        return ended
    finally:
        scaled.unpersist()


def _anchored(small: DataFrame, case: str, share: float, base: Column | None) -> Column:
    """Logs of base weights under which the share of cases is the external one; as they were if a class is missing."""
    weight = F.col("_count") * (F.exp(base) if base is not None else F.lit(1.0))
    sizes = {r["c"]: r["n"] for r in small.groupBy((col(case) == 1).alias("c")).agg(F.sum(weight).alias("n")).collect()}  # two rows
    start = base if base is not None else F.lit(0.0)
    if min(sizes.get(True, 0), sizes.get(False, 0)) <= 0 or not 0 < share < 1:
        return start
    return start + F.when(col(case) == 1, F.lit(math.log(share / sizes[True]))).otherwise(F.lit(math.log((1 - share) / sizes[False])))


def _two_values(z: DataFrame, columns: list[str]) -> list[tuple]:
    """Smallest, largest and (if any) a value between them of each column."""
    parts = [e for i, c in enumerate(columns) for e in (F.min(col(c)).alias(f"a{i}"), F.max(col(c)).alias(f"b{i}"), F.max(F.when(~col(c).isin(0, 1), col(c))).alias(f"c{i}"))]
    row = z.agg(*parts).first()
    return [tuple(v for v in (row[f"a{i}"], row[f"b{i}"], row[f"c{i}"]) if v is not None) for i in range(len(columns))]


def estimate_internal(df: DataFrame, y: str = "y", p: str = "p", n_boot: int = 100, seed: int = 1) -> DataFrame:
    """``field, value``: counts, the four measures, and their summary over ``n_boot`` resamples of the rows."""
    rows = df.select(col(y).cast("double").alias("y"), col(p).cast("double").alias("p"))
    plain = measures_long(rows).select(F.col("measure").alias("field"), "value")
    counts = rows.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("n outcome"))
    counts = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), col(c).alias("value")) for c in ("n", "n outcome")])).alias("c")).select("c.*")
    drawn = resample.bootstrap_measures(rows, reps=n_boot, seed=seed)
    long = drawn.select("rep", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for m, c in zip(CORE_MEASURES, ("auroc", "brier", "mean_prediction", "observed_risk"), strict=True)])).alias("m")).select("rep", "m.*")
    summary = summary_fields(long).where(~F.col("field").isin(list(CORE_MEASURES)))
    return df.sparkSession.createDataFrame(counts.unionByName(plain).unionByName(summary).toPandas(), "field string, value double")  # 22 rows


def flagship(spark: SparkSession, data: DataFrame, features: list[str]) -> DataFrame:
    """``metric, internal, estimated, external`` from ``y, p, ext`` and features: only means of the external rows are used."""
    from ..operators.transform import fit_transform

    internal, external = data.where("ext = 0"), data.where("ext = 1")
    spec = fit_transform(internal.select("y", *features), "Table 1", "y", features)
    mu = spec.means(external)
    z = spec.apply(internal.withColumn("_y", F.col("y").cast("double")), keep=["_y", "p"])
    weighted = solve_whole(z, mu, TunedExponentiatedGradient()).weights
    weighted = weighted.withColumn("_w", F.col("w") * F.col("_count"))
    # One pass for the measures of both sides; the estimate is a table of different rows.
    columns = ("auroc", "brier", "mean_prediction", "observed_risk")
    sides = measures(data, by=["ext"]).withColumn("side", F.when(F.col("ext") == 0, "internal").otherwise("external"))
    all_three = sides.select("side", *columns).unionByName(measures(weighted, "_y", "p", "_w").select(F.lit("estimated").alias("side"), *columns))
    named = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(c, 6).alias("value")) for m, c in zip(CORE_MEASURES, columns, strict=True)])
    long = all_three.select("side", F.explode(named).alias("m")).select("side", "m.*")
    return long.groupBy("metric").agg(*[F.max(F.when(F.col("side") == s, F.col("value"))).alias(s) for s in ("internal", "estimated", "external")])


__all__ = ["CORE_MEASURES", "WEIGHTING_CORE", "Estimation", "WholeSolution", "EstimatorSettings", "different_rows", "estimate_external", "estimate_internal", "flagship", "solve_whole"]
