"""Summaries over repetitions, from rows ``rep, metric, value``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def summarise(reps: DataFrame) -> DataFrame:
    """``metric, lower, median, upper, sd, n`` for metrics whose smallest value is above -1.

    The interval is normal on the scale of log(1 + value); missing values are passed over, and the deviation of a single
    value is null.
    """
    value = F.when(~F.isnan("value"), F.col("value"))
    shifted = F.log1p(value)
    moments = reps.groupBy("metric").agg(F.min(value).alias("low"), F.avg(shifted).alias("m"), F.stddev_samp(shifted).alias("se"), F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    lower, upper = F.exp(F.col("m") - 1.96 * F.col("se")) - 1, F.exp(F.col("m") + 1.96 * F.col("se")) - 1
    return moments.where("low > -1").select("metric", lower.alias("lower"), "median", upper.alias("upper"), "sd", "n")


def summary_fields(reps: DataFrame) -> DataFrame:
    """The summary as rows ``field, value``, with the means of the metrics under their own names."""
    means = reps.where(~F.isnan("value")).groupBy("metric").agg(F.avg("value").alias("value")).select(F.col("metric").alias("field"), "value")
    named = [(F.concat(F.lit("95% lower "), "metric"), "lower"), (F.concat(F.lit("Median    "), "metric"), "median"), (F.concat(F.lit("95% upper "), "metric"), "upper"), (F.concat("metric", F.lit(" sd")), "sd")]
    long = summarise(reps).select(F.explode(F.array(*[F.struct(n.alias("field"), F.col(c).alias("value")) for n, c in named])).alias("f")).select("f.*")
    return means.unionByName(long)


#: Columns of the optimizers' logs, by their number.
LOG_COLUMNS = {3: ("primal_objective", "kl", "max_abs_err"), 4: ("dual_objective", "primal_objective", "norm", "max_abs_err")}


def log_frame(spark: SparkSession, log: list[tuple]) -> DataFrame:
    """An optimizer's log as a table with ``iter`` from 1."""
    names = LOG_COLUMNS[len(log[0]) if log else 3]
    rows = [(i, *(None if v is None else float(v) for v in row)) for i, row in enumerate(log, 1)]
    return spark.createDataFrame(rows, "iter int, " + ", ".join(f"{n} double" for n in names))


def block_means(log: DataFrame, size: int, iteration: str = "iter") -> DataFrame:
    """Means of an optimizer's log over blocks of ``size`` iterations."""
    values = [c for c in log.columns if c != iteration]
    return log.groupBy(F.floor((F.col(iteration) - 1) / size).alias("block")).agg(*[F.avg(c).alias(c) for c in values])


def union_sections(sections: dict[str, DataFrame]) -> DataFrame:
    """``section, field, value_num, value_str``: the tables of a result below each other."""
    out = None
    for name, df in sections.items():
        text = F.col("value_str") if "value_str" in df.columns else F.lit(None).cast("string")
        num = F.col("value_num") if "value_num" in df.columns else F.col("value").cast("double")
        part = df.select(F.lit(name).alias("section"), "field", num.alias("value_num"), text.alias("value_str"))
        out = part if out is None else out.unionByName(part)
    return out


def top_features(coefficients: DataFrame, k: int) -> DataFrame:
    """The k features with the largest coefficients by size; a top-k plan, not a full sort."""
    return coefficients.orderBy(F.abs("coefficient").desc(), "feature").limit(k)
