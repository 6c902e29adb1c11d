"""Tables in and out: Parquet and CSV, with schemas given rather than guessed, and means as small tables."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header.  Without a schema, columns are strings: guessing types would read the file twice."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def means_frame(spark: SparkSession, mu: dict[str, float]) -> DataFrame:
    """``feature, mu``: what an external site hands over."""
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in mu.items()], "feature string, mu double")


def read_means(df: DataFrame) -> dict[str, float]:
    """Means by name from ``feature, mu``; a row for each feature."""
    return {r["feature"]: r["mu"] for r in df.select("feature", F.col("mu").cast("double")).collect()}


def results_table(results: dict[str, DataFrame]) -> DataFrame:
    """Results of several runs side by side: ``field`` and a column for each run, as a full outer join by field."""
    out = None
    for name, df in results.items():
        part = df.select("field", F.col("value").alias(name))
        out = part if out is None else out.join(part, "field", "full_outer")
    return out


def log_to_file(path: str, level: int = logging.INFO) -> logging.Handler:
    """Write the package's log to a file; remove the handler to end that."""
    handler = logging.FileHandler(path)
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    logger = logging.getLogger("tiltwise")
    logger.addHandler(handler)
    logger.setLevel(level)
    return handler
