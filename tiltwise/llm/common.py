"""What the operators of this subpackage share: scratch tables, hosts and hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
LONG_MAX = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    It is set here only where the session has none, which is allowed on ``local`` masters alone: there every task runs on
    this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = "file://" + tempfile.mkdtemp(prefix="tiltwise-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def _folder(spark: SparkSession) -> str:
    """This session's scratch folder; the driver's JVM removes it when it ends."""
    found = spark.conf.get("tiltwise.scratch", None)
    if not found or not found.startswith(shared_dir(spark)):
        found = f"{shared_dir(spark)}/tiltwise/{uuid.uuid4().hex}"
        spark.conf.set("tiltwise.scratch", found)
        path, system = _hadoop(spark, found)
        system.deleteOnExit(path)
    return found


def _hadoop(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the plan starts anew there.

    A lost executor costs the tasks it ran, not what is stored.  The size of the table is then known to the planner,
    which broadcasts it in a join only if it is below ``spark.sql.autoBroadcastJoinThreshold``.  The table goes with
    ``discard``, or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove stored tables that nothing unwritten reads any more."""
    for t in tables:
        if t is not None:
            path, system = _hadoop(t.sparkSession, t._scratch)
            system.delete(path, True)


def digest_of(text: Column) -> Column:
    """16 bytes that stand for a text, null counting as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def one_of_each(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of ``keys``, the first by a hash of the whole row; null keys are equal.

    Spark keeps one row of each value in every task before it shuffles, so a row that repeats is no hot key.
    """
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c not in keys]) if len(docs.columns) > len(keys) else F.lit(0))
    return docs.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def join_dealt(many: DataFrame, few: DataFrame, key: str, by: Column, split: int = 100_000) -> DataFrame:
    """Inner join on ``key``, where a key may have any share of the rows of ``many``.

    Keys of more than ``split`` rows (more where the table is so large that over 100,000 keys could have them) are dealt to
    several tasks by a hash of ``by``, and their rows of ``few`` are copied to each.  So the list of those keys that all tasks
    get has 100,000 rows at most.
    """
    counts = materialise(many.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > split), "crowded")
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    if not total:
        discard(counts)
        return many.join(few.hint("merge"), key)
    bound = max(split, -(-total // 100_000))
    crowded = F.broadcast(counts.where(F.col("_rows") > bound).select(key, F.ceil(F.col("_rows") / bound).cast("int").alias("_ways")))
    ways = F.coalesce(F.col("_ways"), F.lit(1))
    dealt = many.join(crowded, key, "left").withColumn("_way", F.pmod(F.xxhash64(by), ways).cast("int")).drop("_ways")
    copies = few.join(crowded, key, "left").withColumn("_way", F.explode(F.sequence(F.lit(0), ways - 1))).drop("_ways")
    return dealt.join(copies.hint("merge"), [key, "_way"]).drop("_way")


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) text after the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lowered(host)


def lowered(text: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words, so that every bit of the result depends on every bit of ``x``."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


class WordHashes(dict):
    """Hash of each word, remembered; forgotten when the memory would exceed ``limit`` words."""

    def __init__(self, key=None, limit: int = 100_000):
        super().__init__()
        self.key, self.limit = key, limit

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        word_key = self.key(word) if self.key else word
        found = self[word] = xxhash.xxh3_64_intdigest(word_key.encode("utf-8", "surrogatepass")) if word_key else 0
        return found
