"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of ``documents``.  Every stage works on all rows that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltwise.llm.common import materialise
from tiltwise.llm.decontaminate import drop_overlapping
from tiltwise.llm.lines import dedup_lines
from tiltwise.llm.minhash import keep_one
from tiltwise.llm.mixing import mix_documents
from tiltwise.llm.quality import keep_quality
from tiltwise.llm.queries import WEIGHTS, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects (a score below 0.3).

    Every row is scored by its own text, null and empty ones as texts without words, long ones whole; so rows that repeat or
    share an id go or stay by their texts, with or without an id.  Columns pass through, whatever their names.  An empty
    table stays empty; without labels every score is 1 and all rows stay.
    """
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut chunks of lines that occur before; every document stays, with n_chars of what is left of it.

    Of what repeats the row of the smallest id keeps one (null ids come last; rows of the same id, or without one, are in the
    order of a hash of their texts, and rows of the same id and text are one document and cut nothing from each other).  A
    null text stays null, an empty one empty; other columns pass through, whatever their names.
    """
    cut = dedup_lines(docs.withColumn("n_chars", F.lit(None).cast("long")) if "n_chars" not in docs.columns else docs)
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of near-duplicates: that of the smallest id, or any if none has one.

    Rows go by their texts: copies without an id, under the same id and rows that repeat go, and an unrelated text that shares
    an id with a copy stays.  Null, empty and blank texts are copies of equal ones alone (null is empty).
    """
    return keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows whose text overlaps with an item of the benchmark, with or without an id.

    Null and empty texts stay; a clean text stays though a dropped one has its id; without a benchmark all stay.
    """
    return drop_overlapping(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: a row for each row of docs.

    A null or empty text has no words; a null source is a source of its own; rows that repeat are documents of their own.
    """
    return mix_documents(docs, WEIGHTS).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_copies), ("benchmark decontamination", leaks), ("mixing sources to target weights", mix)]

#: The first four stages have no SQL; the tests hold run() against the stages, whose operators have brute-force tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
