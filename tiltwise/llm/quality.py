"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each text becomes some twenty statistics.  Cosines of random projections of them approximate a Gaussian kernel; each
partition sums its part of the normal equations, which are solved once on the driver (their size depends on the number of
features alone).  A quarter of the training rows is kept from the fit and calibrates the scores to probabilities by the
pool-adjacent-violators rule.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

STATISTICS = (
    "log_words", "word_mean", "word_sd", "word_longest", "distinct", "repeats_last", "top_word", "short_words", "log_lines",
    "distinct_lines", "line_words", "upper", "digits", "other_bytes", "space", "stops", "exclaims", "bars", "symbols",
    "brackets", "quotes", "joints", "entropy", "run",
)
_CLASSES = {"stops": b".?", "exclaims": b"!", "bars": b"|", "symbols": b"#$%&*@^~+=_\\", "brackets": b"<>()[]{}/", "quotes": b"\"'`", "joints": b",;:-"}


def statistics_of(text: str | None) -> list[float]:
    """The statistics of one text, all finite; a null text counts as an empty one."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    words = (text or "").split()
    n, n_words = max(1, len(raw)), max(1, len(words))
    seen = np.bincount(raw, minlength=256).astype(float)
    lengths = np.fromiter(map(len, words), dtype=float, count=len(words)) if words else np.zeros(1)
    lines = [x for x in (text or "").split("\n") if x.strip()]
    top = max(Counter(words).values()) if words else 0
    share = seen[seen > 0] / n
    same = np.flatnonzero(np.diff(raw, prepend=-1, append=-1) if len(raw) else np.zeros(0))
    ascii_upper = seen[65:91].sum()
    letters = max(1.0, ascii_upper + seen[97:123].sum())
    return [
        np.log1p(len(words)), min(lengths.mean(), 50.0), min(lengths.std(), 50.0), np.log1p(lengths.max()), len(set(words)) / n_words,
        sum(map(operator.eq, words, words[1:])) / n_words, top / n_words, float((lengths <= 3).sum()) / n_words, np.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)), np.log1p(n_words / max(1, len(lines))), ascii_upper / letters, seen[48:58].sum() / n,
        seen[128:].sum() / n, (seen[9:14].sum() + seen[32]) / n, *(seen[list(chars)].sum() / n_words for chars in _CLASSES.values()),
        float(-(share * np.log2(share)).sum()), np.log1p(np.diff(same).max() if len(same) > 1 else 0),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x``: one row for each row of ``docs``, with the statistics as an array.  Texts are read whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "none": b["none"], "x": [statistics_of(t) for t in b["text"]]})

    own = F.col(f"`{id_col}`").cast("long")
    # Null ids are flagged, as pandas would make the others floating-point numbers.
    picked = docs.select(F.coalesce(own, F.lit(0)).alias("id"), own.isNull().alias("none"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInPandas(run, "id long, none boolean, x array<double>").select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "x")


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores, ascending
    levels: np.ndarray  # calibrated, not decreasing

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.projection + self.phase) * np.sqrt(2 / self.projection.shape[1])
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function of x nearest to y by weighted squares: means of pooled neighbours."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [s + t for s, t in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def fit(train: DataFrame, n_features: int = 320, ridge: float = 1e-3, width: float = 1.0, seed: int = 11, max_rows: int = 120_000, parts: int = 16) -> QualityModel | None:
    """Fit on ``train`` (``x``, ``y`` in 0/1, ``part`` in 0-3; part 3 calibrates); None without rows of both classes.

    At most about ``max_rows`` rows are used: beyond that, those with the lowest hash of their statistics.
    """
    total = train.count()
    if total > max_rows:
        train = train.where(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < int((1 << 30) * max_rows / total))
    train = train.coalesce(parts)
    dims = len(STATISTICS)
    sums = train.where("part < 3").select("y", *[F.col("x")[i].alias(f"x{i}") for i in range(dims)]).agg(
        F.count("*").alias("n"), F.sum("y").alias("n1"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(dims)], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(dims)]
    ).first()
    if not sums["n"] or sums["n1"] in (0, sums["n"]):
        return None
    mean = np.array([sums[f"m{i}"] for i in range(dims)])
    scale = np.array([max(sums[f"s{i}"] or 0.0, 1e-3) for i in range(dims)])
    rng = np.random.default_rng(seed)
    # Two widths, for coarse and fine differences.
    widths = np.where(np.arange(n_features) % 2, 0.5, 2.0) * width * np.sqrt(dims)
    model = QualityModel(mean, scale, rng.normal(size=(dims, n_features)) / widths, rng.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + 1), np.zeros(1), np.ones(1))

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((n_features + 1, n_features + 1)), np.zeros(n_features + 1)
        for batch in batches:
            if len(batch):
                z = model.features(np.stack(batch["x"]))
                a += z.T @ z
                b += z.T @ batch["y"].to_numpy(float)
        yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()]})

    # One row of (n_features + 1)^2 doubles from each of at most ``parts`` partitions.
    rows = train.where("part < 3").select("x", "y").mapInPandas(normal, "a binary, b binary").collect()
    a = sum(np.frombuffer(r["a"]).reshape(n_features + 1, n_features + 1) for r in rows)
    b = sum(np.frombuffer(r["b"]) for r in rows)
    model.weights = np.linalg.solve(a + ridge * sums["n"] * np.diag([1.0] * n_features + [0.0]) / n_features + 1e-9 * np.eye(n_features + 1), b)

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"raw": np.round(model.raw(np.stack(batch["x"])), 3), "y": batch["y"]})

    # Scores rounded to thousandths: a few thousand values at most.
    held = train.where("part = 3").select("x", "y").mapInPandas(raw, "raw double, y int").groupBy("raw").agg(F.avg("y").alias("y"), F.count("*").alias("n")).toPandas()
    if len(held):
        model.knots, model.levels = isotonic(held["raw"].to_numpy(), held["y"].to_numpy(), held["n"].to_numpy(float))
    else:
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


@dataclass
class Scorer:
    """A model, or the share of 1 among the labels where there is nothing to fit."""

    model: QualityModel | None
    plain: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.model.score(x) if self.model else np.full(len(x), self.plain)


def training_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, y, part`` of the labelled documents whose crc32 of the id is not 0 modulo 5."""
    labels = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    return labels.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0").select("doc_id", "y", (F.col("fold") - 1).alias("part"))


def train(stats: DataFrame, labels: DataFrame, **fit_options) -> Scorer:
    """Fit on the rows of ``stats`` (``doc_id, x``) that ``labels`` (of ``training_labels``) has."""
    rows = materialise(stats.join(labels, "doc_id").select("x", "y", "part"), "train")
    model = fit(rows, **fit_options)
    share = rows.agg(F.avg("y")).first()[0] if model is None else None
    discard(rows)
    return Scorer(model, 1.0 if share is None else share)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **fit_options) -> DataFrame:
    """Return ``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Training rows are the labelled documents (``labels``: ``doc_id, quality``) whose crc32 of the id is not 0 modulo 5.
    Labels that are null count as none; of several labels of a document the lowest holds.  Null and empty texts have
    statistics like any other and get a score.  Without training rows of both classes every score is the share of 1
    among the labels (1 without labels).  Rows that repeat get the same score; extra columns are ignored.
    """
    stats = materialise(document_statistics(docs, id_col, text_col), "statistics")
    scorer = train(stats, training_labels(labels), **fit_options)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "none": b["none"], "score": scorer.score(np.stack(b["x"]))})

    flagged = stats.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "x")
    scored = flagged.mapInPandas(run, "id long, none boolean, score double").select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "score")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 120_000, id_col: str = "doc_id", text_col: str = "text", **fit_options) -> DataFrame:
    """The rows of ``docs`` whose score is ``threshold`` or more, as they are.

    The model is that of ``score_documents``, fitted on about ``max_rows`` labelled documents at most (those with the lowest
    hash of their ids): only their statistics are taken beforehand, and all texts are scored where they are read.
    """
    stored = chosen = materialise(training_labels(labels), "labels")
    total = stored.count()
    if total > max_rows:
        chosen = stored.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / total))
    own = F.col(f"`{id_col}`").cast("long")
    # At most about ``max_rows`` ids are sent.
    few = docs.select(own.alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    scorer = train(document_statistics(few), chosen, max_rows=max_rows, **fit_options)
    discard(stored)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([statistics_of(t) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()])
                yield b.filter(pa.array(scorer.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
