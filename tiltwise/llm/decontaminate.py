"""Benchmark decontamination by spaced-seed hashing.

A mask says which tokens of a window count; the rest may differ.  Hashes of the masked windows of the benchmark, its seeds, are
joined with those of the documents.  Around each hit, document and item are laid over each other at that offset and the run with
the most matches is taken of those that are alike enough, so substituted tokens are tolerated.  It is an overlap if it
has enough matches, so none that meets the rule is lost once a mask hits.  Items shorter than every mask have one seed of all
their tokens and are found as they are.

The documents are scanned once, whatever the size of the benchmark.  Only a table of bits goes to the executors, whose size is
checked; what passes it is joined with the seeds by a shuffle.  Items of the same tokens are one, and a text that repeats is sent
once from each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, digest_of, discard, join_dealt, materialise, mix64

#: Positions of a window that count: three masks of weight six.
MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 5, 8, 9), (0, 2, 3, 4, 6, 9))
_EDGES = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "“”‘’«»…–—¿¡"


def normal_word(word: str) -> str:
    """Lower case, without punctuation around it; empty for what is punctuation alone."""
    return word.lower().strip(_EDGES)


def tokens_of(text: str | None, words: dict) -> np.ndarray:
    """Hashes of the words of a text that are not punctuation alone."""
    found = np.array([words[w] for w in (text or "").split()], dtype=U64)
    return found[found != 0] if len(found) else found


def seeds_of(tokens: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.zeros(0, dtype=U64)
    seed = np.full(n, U64(salt + 1))
    for at in mask:
        seed = seed * U64(0x9E3779B97F4A7C15) + tokens[at : at + n]
    return mix64(seed)


def masks_for(n: int, masks: tuple[tuple[int, ...], ...]) -> list[tuple[int, tuple[int, ...]]]:
    """Salt and mask of each kind of seed that an item of ``n`` tokens has: all tokens if it is shorter than every mask."""
    shortest = min(m[-1] + 1 for m in masks)
    return [(1000 + n, tuple(range(n)))] if 0 < n < shortest else list(enumerate(masks)) if n else []


class Bits:
    """Which seeds may be in the benchmark: a bit for each of three parts of a seed."""

    def __init__(self, power: int, words: np.ndarray):
        self.power, self.words = power, words

    @staticmethod
    def places(seed: np.ndarray, power: int) -> list[np.ndarray]:
        return [(seed >> U64(shift) & U64((1 << power) - 1)).astype(np.int64) for shift in (0, 18, 36)]

    @classmethod
    def of(cls, seeds: DataFrame, most_bits: int) -> Bits:
        """From the long column ``seed``: 64 bits or more for a seed, as long as that is at most ``most_bits`` bits in all."""
        power = min(int(most_bits).bit_length() - 1, max(16, (seeds.count() * 64).bit_length()))
        place = F.explode(F.array(*[F.shiftrightunsigned("seed", s).bitwiseAND((1 << power) - 1) for s in (0, 18, 36)]))
        marks = seeds.select(place.alias("p")).groupBy((F.col("p") / 32).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("bits"))
        words = np.zeros(1 << (power - 5), dtype=np.uint32)
        for r in marks.toLocalIterator():  # no more than ``most_bits`` / 32 rows
            words[r["word"]] = r["bits"]
        return cls(power, words)

    def may_have(self, seed: np.ndarray) -> np.ndarray:
        """Places in ``seed`` of those that may be there."""
        at = np.arange(len(seed))
        for shift in (0, 18, 36):
            p = (seed[at] >> U64(shift) & U64((1 << self.power) - 1)).astype(np.int64)
            at = at[(self.words[p >> 5] >> (p & 31).astype(np.uint32) & 1).astype(bool)]
        return at


def best_run(same: np.ndarray, min_share: float = 0.75) -> tuple[int, int]:
    """Start and end of the run with the most matches of those with the share ``min_share`` of matches or more.

    Of equal ones the shortest, then the first, so a run begins and ends with a match; empty if nothing matches.
    """
    starts = np.flatnonzero(same)
    if not len(starts):
        return 0, 0
    count = np.concatenate(([0], np.cumsum(same)))
    excess = count - min_share * np.arange(len(count))
    # For each start the furthest end at which the share is still met has the most matches.
    highest = np.maximum.accumulate(excess[::-1])
    ends = len(same) - np.searchsorted(highest, excess[starts] - 1e-9)
    matches = count[ends] - count[starts]
    ends = starts[count[ends] - 1] + 1  # without mismatches at the end
    best = np.lexsort((starts, ends - starts, -matches))[0]
    return int(starts[best]), int(ends[best])


def item_classes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, class_id`` of every item with a token: items of the same tokens are a class, named by its smallest id."""
    items = _items(benchmark, item_col, text_col)
    return items.join(items.groupBy("tokens").agg(F.min("id").alias("class_id")), "tokens").select(F.col("id").alias("item_id"), "class_id")


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes(normal_word)
        for b in batches:
            found = [tokens_of(t, words) for t in b["text"]]
            some = [n for n, t in enumerate(found) if len(t)]
            yield pd.DataFrame({"id": b["id"].iloc[some].to_numpy(), "none": b["none"].iloc[some].to_numpy(), "tokens": [found[n].tobytes() for n in some]})

    picked = _flagged(benchmark, item_col, text_col).withColumnRenamed("doc_id", "id")
    return picked.mapInPandas(tokens, "id long, none boolean, tokens binary").select(F.when(~F.col("none"), F.col("id")).alias("id"), "tokens")


def _flagged(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, none, text``: ids with a flag for null ones, which pandas would make floating-point numbers."""
    own = F.col(f"`{id_col}`").cast("long")
    return rows.select(F.coalesce(own, F.lit(0)).alias("doc_id"), own.isNull().alias("none"), F.col(f"`{text_col}`").alias("text"))


def _overlaps(docs: DataFrame, benchmark: DataFrame, min_matches: int, min_share: float, masks: tuple, most_bits: int, id_col: str, text_col: str, item_col: str, item_text_col: str, split: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """``doc_id, digest`` of rows with a possible hit, and the overlaps of each different text (by ``digest``); both stored."""
    items = _items(benchmark, item_col, item_text_col).groupBy("tokens").agg(F.min("id").alias("item_id"), F.count("*").alias("n_items"))
    items = materialise(items.withColumn("item", F.monotonically_increasing_id()), "items")

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for item, raw in zip(b["item"], b["tokens"], strict=True):
                tokens = np.frombuffer(raw, dtype=U64)
                for salt, mask in masks_for(len(tokens), masks):
                    seed = seeds_of(tokens, mask, salt)
                    found.append(np.column_stack([seed.view(np.int64), np.full(len(seed), item), np.arange(len(seed)), np.full(len(seed), len(tokens))]))
            if found:
                yield pd.DataFrame(np.concatenate(found), columns=["seed", "item", "place", "n"])

    wanted = materialise(items.select("item", "tokens").mapInPandas(seeds, "seed long, item long, place long, n long"), "seeds")
    short = sorted(r["n"] for r in wanted.where(F.col("n") < min(m[-1] + 1 for m in masks)).select("n").distinct().collect())  # fewer than a mask is long
    kinds = [*enumerate(masks), *[k for n in short for k in masks_for(n, masks)]]
    bits = Bits.of(wanted.select("seed").distinct(), most_bits)
    sent = docs.sparkSession.sparkContext.broadcast((bits.power, bits.words))  # at most ``most_bits`` bits

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, table, done = WordHashes(normal_word), Bits(*sent.value), set()
        for b in batches:
            out = []
            for d, none, text in zip(b["doc_id"], b["none"], b["text"], strict=True):
                tokens = tokens_of(text, words)
                found = [(seed[at], at) for salt, mask in kinds if len(at := table.may_have(seed := seeds_of(tokens, mask, salt)))]
                if found:
                    digest = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
                    fresh = digest not in done
                    done.add(digest)
                    hits = (np.concatenate([s for s, _ in found]).view(np.int64), np.concatenate([a for _, a in found])) if fresh else ([], [])
                    out.append((d, none, digest, tokens.tobytes() if fresh else None, *hits))
            yield pd.DataFrame(out, columns=["doc_id", "none", "digest", "tokens", "seeds", "places"])

    schema = "doc_id long, none boolean, digest binary, tokens binary, seeds array<long>, places array<long>"
    suspects = materialise(_flagged(docs, id_col, text_col).mapInPandas(scan, schema).withColumn("doc_id", F.when(~F.col("none"), F.col("doc_id"))), "suspects")
    hits = suspects.select("digest", F.explode(F.arrays_zip("seeds", "places")).alias("h")).select("digest", F.col("h.seeds").alias("seed"), F.col("h.places").alias("at"))
    laid = materialise(join_dealt(hits, wanted, "seed", F.col("digest"), split).select("digest", "item", "n", (F.col("at") - F.col("place")).alias("offset")).distinct(), "laid")
    # What of the text lies under the item: no text is sent whole, however many items it meets.
    texts = suspects.where("tokens is not null").select("digest", "tokens")
    size = (F.length("tokens") / 8).cast("long")
    first, last = F.greatest(F.lit(0).cast("long"), "offset"), F.least(size, F.col("offset") + F.col("n"))
    under = laid.join(texts.hint("merge"), "digest").select("digest", "item", "offset", first.alias("first"), F.substring("tokens", (first * 8 + 1).cast("int"), ((last - first) * 8).cast("int")).alias("part"))
    both = join_dealt(under, items.select("item", "item_id", "n_items", "tokens"), "item", F.col("digest"), split)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for digest, offset, start, part, item, n_items, tokens in zip(*(b[c] for c in ("digest", "offset", "first", "part", "item_id", "n_items", "tokens")), strict=True):
                own, here = np.frombuffer(tokens, dtype=U64), np.frombuffer(part, dtype=U64)
                skip = start - offset
                same = own[skip : skip + len(here)] == here
                a, z = best_run(same, min_share)
                matches = int(same[a:z].sum())
                if matches and matches >= min(min_matches, -(-3 * len(own) // 4)) and matches >= min_share * (z - a) - 1e-9:
                    out.append((digest, item, n_items, start + a, skip + a, z - a, matches))
            yield pd.DataFrame(out, columns=["digest", "item_id", "n_items", "doc_start", "item_start", "n_tokens", "n_matches"]).astype({"item_id": "Int64"})

    schema = "digest binary, item_id long, n_items long, doc_start long, item_start long, n_tokens long, n_matches long"
    # A text that several tasks have sent is laid more than once.
    verified = materialise(both.mapInPandas(compare, schema).distinct(), "overlaps")
    rows = materialise(suspects.select("doc_id", "digest").join(verified.select("digest").distinct().hint("merge"), "digest", "left_semi"), "found_rows")
    discard(items, wanted, suspects, laid)
    return rows, verified


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    min_matches: int = 12,
    min_share: float = 0.75,
    masks: tuple[tuple[int, ...], ...] = MASKS,
    most_bits: int = 1 << 27,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Return ``doc_id, item_id, n_items, doc_start, item_start, n_tokens, n_matches``: a row for each overlap.

    An overlap has at least ``min_matches`` equal tokens, or all but a quarter of an item that is shorter than that, and at
    least the share ``min_share`` of its tokens equal; an item shorter than the shortest mask must be there as it is.  One row
    comes for each document row, offset and item, where items of the same tokens (``n_items`` of them) are one, under their
    smallest id; ``item_classes`` lists them.  Tokens are words in lower case without punctuation around them.  Null and
    empty texts and items overlap with nothing; ids may be null or repeat; whole texts are read, of any length; other columns
    are ignored; without documents or items there are no rows.  ``most_bits`` bounds the table of bits that is sent to
    executors: with more than some 2 million seeds it lets more through to the join, and loses nothing.
    """
    rows, verified = _overlaps(docs, benchmark, min_matches, min_share, masks, most_bits, id_col, text_col, item_col, item_text_col)
    return rows.join(verified.hint("merge"), "digest").select("doc_id", "item_id", "n_items", "doc_start", "item_start", "n_tokens", "n_matches")


def drop_overlapping(
    docs: DataFrame,
    benchmark: DataFrame,
    min_matches: int = 12,
    min_share: float = 0.75,
    masks: tuple[tuple[int, ...], ...] = MASKS,
    most_bits: int = 1 << 27,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Return the rows of ``docs`` that ``find_overlaps`` finds nothing in, with all columns as they are.

    Rows go by their text, not by their id: a row without an id goes if its text overlaps, and a clean text stays though
    another row has its id.  Null and empty texts stay; rows that repeat stay or go together.
    """
    _, verified = _overlaps(docs, benchmark, min_matches, min_share, masks, most_bits, id_col, text_col, item_col, item_text_col)
    found = materialise(verified.select(F.col("digest").alias("_found")).distinct(), "contaminated")
    keyed = docs.withColumn("_digest", digest_of(F.col(f"`{text_col}`")))
    kept = keyed.join(found.hint("merge"), F.col("_digest") == F.col("_found"), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
