"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last two lines that are not blank says where a boundary is: on all lines but one in
``2 ** sparse`` (8).  Boundaries depend on the lines around them alone and so come back after an insertion.  A chunk goes from one
boundary to the next, both included, so chunks overlap in a line, have two lines or more, and are compared by content.  Lines
between two boundaries also end a chunk from the boundary before and begin one to the boundary after: wherever a repeated
run begins and ends among foreign lines, all of it is covered by chunks that lie within it, as long as a boundary does.

A chunk that occurs before is removed; the document with the smallest id keeps what repeats, once.  Hashes select what may
repeat; the bytes of just that are then grouped by their content.  A hash under which more than one content is found
removes nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG_MAX, discard, materialise

SIGN = 1 << 63


def boundaries(lines: list[str], sparse: int = 3, most: int = 8) -> list[bool]:
    """Whether each line (none blank) is a boundary: the first, the last, what the rolling hash says, and one in ``most`` at least."""
    found, before, last = [], 0, 0
    mask = (1 << sparse) - 1
    for i, line in enumerate(lines):
        now = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
        rolled = (before * 0x9E3779B97F4A7C15 + now) & 0xFFFFFFFFFFFFFFFF
        before = now
        found.append(i in (0, len(lines) - 1) or (rolled >> 29) & mask != 0 or i - last >= most)
        last = i if found[-1] else last
    return found


def chunks_of(text: str | None, sparse: int = 3, most: int = 8) -> list[tuple[int, int, int, str]]:
    """Hash, first line, end and content of each chunk, by their ends.

    Blank lines between a chunk's lines are part of it.  Those at the ends of the text go with its first and last chunk.
    """
    lines = (text or "").split("\n")
    full = [i for i, line in enumerate(lines) if line.strip()]
    if len(full) < 2:
        return []
    marks = boundaries([lines[i] for i in full], sparse, most)
    spans, before = [], 0
    for i in range(1, len(full)):
        spans.append((before, i))  # to a boundary, or to a line after one
        if marks[i]:
            spans += [(j, i) for j in range(before + 1, i)]
            before = i
    found = []
    for i, j in spans:
        content = "\n".join(lines[full[i] : full[j] + 1])
        key = xxhash.xxh3_64_intdigest(content.encode("utf-8", "surrogatepass")) - SIGN
        found.append((key, full[i] if i else 0, full[j] + 1 if j + 1 < len(full) else len(lines), content))
    return found


def dedup_lines(docs: DataFrame, sparse: int = 3, most: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return the rows of ``docs`` with repeated chunks of lines cut from the text, and ``n_lines``, ``n_removed``.

    A line goes if it is in a chunk whose content occurs in a document before, or ends earlier in this one.  Documents
    are in the order of their ids, null last; those of one id, or of none, in the order of a hash of their texts; rows of the
    same id and text are one document and cut nothing from each other.  What goes stays at its first place: a line of
    it goes there only if it is part of another chunk that occurs still earlier.  No row is dropped: a text all of which occurs
    before becomes empty, a null text stays null, an empty one empty, of any length.  Other columns pass through, but
    for earlier ones of the two names.  An empty table stays empty.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed") or c in (id_col, text_col)]
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    # The order of documents: by id, then by the hash of the text.
    inner = inner.withColumn("order", F.coalesce(F.col(key).cast("long"), F.lit(LONG_MAX))).withColumn("tie", F.xxhash64(text))

    def spans(t: str | None) -> list[tuple[int, int, int, str]]:
        return chunks_of(t, sparse, most)

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(h, d, e, n) for d, e, t in zip(b["order"], b["tie"], b["text"], strict=True) for h, n in Counter(h for h, *_ in spans(t)).items()]
            yield pd.DataFrame(rows, columns=["h", "order", "tie", "n"])

    at = materialise(inner.select("order", "tie", F.col(text).alias("text")).mapInPandas(hashes, "h long, order long, tie long, n long"), "chunks")
    place = F.struct("order", "tie")
    repeated = at.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("n").alias("n")).where("n > 1 or last > first")
    repeated = materialise(repeated.select("h", F.col("first.order").alias("first"), F.col("first.tie").alias("first_tie")), "repeated")

    def by_document(hashes: DataFrame) -> DataFrame:
        # A set for each document rather than a distinct of all rows: nothing then stands in the way of splitting a hot hash.
        found = at.join(hashes.hint("merge"), "h").groupBy("order", "tie").agg(F.collect_set(F.struct("h", "first", "first_tie")).alias("found"))
        found = materialise(found, "wanted").select(F.col("order").alias("_order"), F.col("tie").alias("_tie"), F.col("found.h").alias("hs"), F.col("found.first").alias("firsts"), F.col("found.first_tie").alias("ties"))
        # Always a merge join: a broadcast would serve small tables only, and texts move in the same way at every size.
        return inner.join(found.hint("merge"), (F.col("order") == F.col("_order")) & (F.col("tie") == F.col("_tie")), "left").drop("_order", "_tie")

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = set()
            for t, hs in zip(b[text], b["hs"], strict=True):
                if hs is not None:
                    hs = set(hs)
                    rows.update((h, c) for h, _, _, c in spans(t) if h in hs)
            yield pd.DataFrame(sorted(rows), columns=["h", "chunk"])

    joined = by_document(repeated)
    compared = joined.where("hs is not null").mapInPandas(contents, "h long, chunk string").groupBy("h", "chunk").count().groupBy("h").agg(F.count("*").alias("contents"))
    differing = materialise(compared.where("contents > 1").select("h"), "differing")
    if not differing.isEmpty():  # equal 64-bit hashes of different bytes: almost never
        joined = by_document(repeated.join(differing, "h", "left_anti"))
    discard(differing, repeated, at)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            texts, n_lines, n_removed = [], [], []
            for t, d, e, hs, firsts, ties in zip(*(b.column(at[c]).to_pylist() for c in (text, "order", "tie", "hs", "firsts", "ties")), strict=True):
                lines = 0 if t is None else t.count("\n") + 1
                kept, left = t, lines
                if hs is not None and t is not None:
                    before = {h: (o, i) < (d, e) for h, o, i in zip(hs, firsts, ties, strict=True)}
                    seen, gone = {}, set()
                    for h, start, end, _ in spans(t):
                        if h in before and (before[h] or seen.setdefault(h, end) <= start):
                            gone.update(range(start, end))
                    if gone:
                        out = [line for i, line in enumerate(t.split("\n")) if i not in gone]
                        kept, left = "\n".join(out), len(out)
                texts.append(kept)
                n_lines.append(lines)
                n_removed.append(lines - left)
            fixed = {text: pa.array(texts, b.schema.field(at[text]).type)}
            columns = {n: fixed.get(n, b.column(i)) for n, i in at.items() if n not in ("order", "tie", "hs", "firsts", "ties")}
            yield pa.RecordBatch.from_pydict(columns | {"n_lines": pa.array(n_lines, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema if f.name not in ("order", "tie"))
    out = joined.mapInArrow(cut, schema + ", n_lines long, n_removed long")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("n_lines").alias("n_lines"), F.col("n_removed").alias("n_removed"))
