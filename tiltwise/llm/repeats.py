"""Repeated byte strings by a depth-limited radix sort of sparse suffixes.

A suffix is only sorted through ``depth`` bytes (100), so groups that are equal at that depth are exactly the repeated windows.
Most suffixes need no sorting at all: of the 40-byte strings in a window, the one with the lowest hash is its anchor, and
equal windows have the same anchor at the same place.  So the passes go over anchors, one in some 32 bytes:

1. First digit: the anchor's 40 bytes.  Anchors that are alone drop out.
2. Next digits: two of 30 bytes to the left and two to the right.  Where all four agree with an earlier anchor, all bytes they
   span are repeated.  Anchors whose nearest digits agree with no other on either side drop out.
3. Last digit: what is still undecided (around the ends of repeats) is compared as whole windows.

Digits are hashes: 64 bits for the anchor, 64 for its four neighbours together, and 128 for a window.  So two contexts that differ
are taken for equal with a probability of 2 ** -64 if they share the anchor, and of 2 ** -128 otherwise, and two windows with one of
2 ** -128: among 10 ** 15 pairs of contexts with the same anchor, one with a probability of 5 * 10 ** -5.  That a single neighbour
is shared is told by 16 bits of it: a mistake there only sends windows to the last digit that need not go.

A batch sends the first of equal entries only, as the others are repeated whatever the rest of the corpus holds; so the
copies of a hot passage cost a message for each batch.  An anchor that has more than ``hot`` contexts within a batch goes to
the last pass at once, with all windows around it.  Messages are dealt to buckets of about ``bucket_bytes`` of text.  Rows that are
wholly equal are one document, sent once from each task and written as often as they were read.  Long texts are worked on
in pieces in every pass; beside them only intervals are held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG_MAX, U64, materialise, mix64

ANCHOR = 40
BASE = 0x9E3779B97F4A7C15
SECOND = 0xC2B2AE3D27D4EB4F
COVERED, LEFT, RIGHT, BOTH, WINDOW = 1, 2, 3, 4, 5
ANCHORS, FLAGS = 0, 1
PIECE = 1 << 20  # bytes of text that are worked on at once; a worker holds some 150 bytes for each


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if (base, n) in _POWERS:
        return _POWERS[base, n]
    if len(_POWERS) >= 4:
        _POWERS.clear()
    out = _POWERS[base, n] = np.ones(n, dtype=U64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * U64(pow(base, done, 1 << 64))
        done += more
    return out


class Hashes:
    """Hashes of any substring of some bytes, from running sums: those of equal strings are equal."""

    def __init__(self, raw: np.ndarray, base: int = BASE):
        size = max(PIECE, 1 << int(len(raw) + 1).bit_length())
        self.sums = np.zeros(len(raw) + 1, dtype=U64)
        np.cumsum((raw.astype(U64) + U64(1)) * _powers(base, size)[: len(raw)], out=self.sums[1:])
        self.inverse = _powers(pow(base, -1, 1 << 64), size)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


class Text:
    """Texts as one run of bytes.  A long text comes in pieces with enough of its neighbours' bytes around each."""

    def __init__(self, pieces: list[tuple[int, int, bytes, int, int]]):
        #: (document, place of the first byte in it, bytes, first and last + 1 place at which windows begin)
        self.doc = np.array([p[0] for p in pieces], dtype=np.int64)
        self.base = np.array([p[1] for p in pieces], dtype=np.int64)
        lengths = np.array([len(p[2]) for p in pieces], dtype=np.int64)
        self.low = np.array([p[3] for p in pieces], dtype=np.int64)
        self.high = np.array([p[4] for p in pieces], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(lengths)))
        self.raw = np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8)


def pieces_of(texts: list[bytes], depth: int) -> Iterator[Text]:
    halo, held, size = 2 * depth, [], 0
    for d, raw in enumerate(texts):
        for at in range(0, max(0, len(raw) - depth + 1), PIECE):
            low, high = at, min(at + PIECE, len(raw) - depth + 1)
            first, last = max(0, low - halo), min(len(raw), high + depth + halo)
            held.append((d, first, raw[first:last], low, high))
            size += last - first
            if size >= PIECE:
                yield Text(held)
                held, size = [], 0
    if held:
        yield Text(held)


def anchors_of(text: Text, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, place and hash of all anchors, a hash of the four digits around each, and 16 bits of either nearest digit."""
    sums = Hashes(text.raw)
    n, width = len(text.raw), depth - ANCHOR + 1
    if n < depth:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=U64),) * 2 + (np.zeros(0, dtype=np.uint32),)
    at = np.arange(n - ANCHOR + 1)
    keys = mix64(sums.of(at, at + ANCHOR))
    least, span = keys, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    piece = np.repeat(np.arange(len(text.doc)), np.diff(text.start))[: len(least)]
    place = np.arange(len(least)) - text.start[piece] + text.base[piece]
    window = np.flatnonzero((place >= text.low[piece]) & (place < text.high[piece]))
    if not len(window):
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=U64),) * 2 + (np.zeros(0, dtype=np.uint32),)
    low = least[window]
    # Windows one after the other mostly share their anchor.
    fresh = np.concatenate(([True], (low[1:] != low[:-1]) | (np.diff(window) != 1)))
    first, low = window[fresh], low[fresh]
    found = []
    for i in range(0, len(first), 1 << 16):
        f = first[i : i + (1 << 16)]
        # The first place where the lowest hash stands; if it comes again in a run of windows, a later one begins the next run.
        found.append(f + (keys[f[:, None] + np.arange(width)] == low[i : i + (1 << 16), None]).argmax(axis=1))
    again = np.flatnonzero(~fresh)
    if len(again):  # runs in which the anchor moves on to an equal one further right
        run = np.cumsum(fresh) - 1
        moved = window[again] > np.concatenate(found)[run[again]]
        late = window[again[moved]]
        for i in range(0, len(late), 1 << 16):
            f = late[i : i + (1 << 16)]
            found.append(f + (keys[f[:, None] + np.arange(width)] == least[f][:, None]).argmax(axis=1))
    anchor = np.unique(np.concatenate(found))
    piece = np.searchsorted(text.start, anchor, side="right") - 1
    begin, end = text.start[piece], text.start[piece + 1]
    step = (depth - ANCHOR) // 2
    around, near = np.zeros(len(anchor), dtype=U64), np.zeros(len(anchor), dtype=U64)
    for k, (left, right) in enumerate(((-2 * step, -step), (-step, 0), (ANCHOR, ANCHOR + step), (ANCHOR + step, ANCHOR + 2 * step))):
        a, b = np.clip(anchor + left, begin, end), np.clip(anchor + right, begin, end)
        digit = mix64(sums.of(a, b) + (b - a).astype(U64) * U64(SECOND))
        around = mix64(around * U64(BASE) + digit + U64(k + 1))
        if k in (1, 2):
            near = near << U64(16) | digit >> U64(48)
    return text.doc[piece], anchor - begin + text.base[piece], keys[anchor], around, near.astype(np.uint32)


def windows_of(raw: bytes, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash for the windows at ``starts``."""
    b = np.frombuffer(raw, dtype=np.uint8)
    one = mix64(Hashes(b).of(starts, starts + depth))
    two = mix64(Hashes(b, SECOND).of(starts, starts + depth) + U64(depth))
    return one, two


def joined(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals [low, high) that meet or overlap as one; in order."""
    some = high > low
    order = np.argsort(low[some], kind="stable")
    low, high = low[some][order], high[some][order]
    if not len(low):
        return low, high
    far = np.maximum.accumulate(high)
    fresh = np.concatenate(([True], low[1:] > far[:-1]))
    return low[fresh], far[np.append(np.flatnonzero(fresh)[1:] - 1, len(far) - 1)]


# Messages: a table of documents (a row of id, tie and home bucket for each) and columns of entries, as bytes.


def pack(table: np.ndarray, *columns: np.ndarray) -> bytes:
    parts = [np.array([len(table), len(columns[0])], dtype=np.int64).tobytes(), np.ascontiguousarray(table).tobytes()]
    return b"".join(parts + [np.ascontiguousarray(c).tobytes() for c in columns])


def unpack(raw: bytes, types: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
    docs, n = (int(x) for x in np.frombuffer(raw, dtype=np.int64, count=2))
    at = 16
    table = np.frombuffer(raw, np.int64, 3 * docs, at).reshape(docs, 3)
    at += 24 * docs
    out = []
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return table, out


def table_of(rows: pd.DataFrame) -> np.ndarray:
    return np.column_stack([rows[c].to_numpy(np.int64) for c in ("key", "tie", "home")]) if len(rows) else np.zeros((0, 3), np.int64)


ANCHOR_TYPES = (np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint8)  # key, all digits, nearest digits, document, place, hot
WINDOW_TYPES = (np.uint64, np.uint64, np.uint32, np.uint32)  # hash, its rest, document, place
FLAG_TYPES = (np.uint32, np.uint32, np.uint8)  # document, place, kind


def _sub(table: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    used, at = np.unique(doc, return_inverse=True)
    return table[used], at.astype(np.uint32)


def _deal(kind: int, table: np.ndarray, doc: np.ndarray, bucket: np.ndarray, columns: list[np.ndarray], out: list[tuple[int, int, bytes]], place: int) -> None:
    """Split entries by bucket; the documents' column goes to position ``place``."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True]))) if len(order) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rows = order[a:b]
        own, at = _sub(table, doc[rows])
        parts = [c[rows] for c in columns]
        out.append((int(bucket[rows[0]]), kind, pack(own, *parts[:place], at, *parts[place:])))


def _ranks(table: np.ndarray) -> np.ndarray:
    """The order of documents as dense ranks: equal (id, tie) have equal ranks."""
    order = np.lexsort((table[:, 1], table[:, 0]))
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = _same(table[order, 0], table[order, 1])
    return ranks


def _later(group: np.ndarray, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For entries sorted by (group, rank, place): whether an earlier place of the group comes before this one."""
    if not len(group):
        return np.zeros(0, dtype=bool)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    first = np.repeat(starts, np.diff(np.append(starts, len(group))))
    return (rank != rank[first]) | (place != place[first])


def _same(*columns: np.ndarray) -> np.ndarray:
    """Numbers of the groups of equal rows, for sorted columns."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(len(columns[0]) - 1, dtype=bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.concatenate(([0], np.cumsum(new)))


def _shared(key: np.ndarray) -> np.ndarray:
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[at] > 1


def remove_repeats(docs: DataFrame, depth: int = 100, hot: int = 64, bucket_bytes: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Return ``doc_id, n_bytes, n_removed, n_spans, spans, kept`` for every row of ``docs``.

    A byte goes if a string of ``depth`` bytes (at least 70) that covers it also begins earlier: in a document of smaller id,
    or further left in the same one.  Texts are UTF-8, a null text is empty; nothing is matched across documents and all is
    judged on the input.  ``spans`` are the removed runs as arrays of starts and ends, ``kept`` the remaining bytes (may end
    in the middle of a character; null unless ``keep_text``).  Null ids come last; rows that share an id and have different
    texts are documents in an order of their hashes, and rows that are wholly equal are one document.  Other columns are
    ignored.
    """
    if depth < ANCHOR + 30:
        raise ValueError("depth must be at least 70")
    width = depth - ANCHOR + 1
    half = (depth - ANCHOR) // 2
    # Only computed columns, so that both uses of the texts below have the same plan and share one exchange.
    doc_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    picked = docs.select(doc_id.isNull().alias("none"), F.coalesce(doc_id.cast("long"), F.lit(LONG_MAX)).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    picked = picked.withColumn("tie", F.xxhash64("text"))
    counted = materialise(picked.groupBy("key", "tie").agg(F.count("*").alias("copies"), F.count(F.when(F.col("none"), 1)).alias("nones"), F.sum(F.octet_length("text")).alias("bytes")), "rows")
    total = counted.agg(F.sum("bytes")).first()[0] or 0
    n = max(8, -(-total // bucket_bytes))
    messages = "bucket long, kind int, blob binary"
    columns = ["bucket", "kind", "blob"]

    def first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raws = [t.encode("utf-8", "surrogatepass") for t in b["text"]]
            table = table_of(b)
            ranks = _ranks(table)
            for text in pieces_of(raws, depth):
                doc, place, key, around, near_by = anchors_of(text, depth)
                order = np.lexsort((place, ranks[doc], around, key))
                doc, place, key, around, near_by = doc[order], place[order], key[order], around[order], near_by[order]
                group = _same(key, around)
                later = _later(group, ranks[doc], place)
                out: list[tuple[int, int, bytes]] = []
                flagged = doc[later]
                _deal(FLAGS, table, flagged, table[flagged, 2], [place[later].astype(np.uint32), np.full(later.sum(), COVERED, np.uint8)], out, 0)
                kept = np.flatnonzero(~later)
                # Of rows that are wholly equal, one entry is enough.
                kept = kept[np.concatenate(([True], group[kept][1:] != group[kept][:-1]))] if len(kept) else kept
                by_key = _same(key[kept])
                crowded = np.bincount(by_key)[by_key] > hot if len(kept) else np.zeros(0, dtype=bool)
                nth = np.arange(len(kept)) - np.flatnonzero(np.concatenate(([True], np.diff(by_key) != 0)))[by_key] if len(kept) else by_key
                straight = kept[crowded]  # too many contexts here: windows are compared at once
                _deal(FLAGS, table, doc[straight], table[doc[straight], 2], [place[straight].astype(np.uint32), np.full(len(straight), BOTH, np.uint8)], out, 0)
                sent = ~crowded | (nth == 0)  # one entry tells the bucket that the anchor is hot
                kept, crowded = kept[sent], crowded[sent]
                bucket = (key[kept] % U64(n)).astype(np.int64)
                _deal(ANCHORS, table, doc[kept], bucket, [key[kept], around[kept], near_by[kept], place[kept].astype(np.uint32), crowded.astype(np.uint8)], out, 3)
                yield pd.DataFrame(out, columns=columns)

    def gathered(blobs: list[bytes], types: tuple, place: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Messages as one table and columns; documents are numbered anew."""
        tables, parts, base = [], [], 0
        for raw in blobs:
            table, cols = unpack(raw, types)
            cols[place] = cols[place].astype(np.int64) + base
            base += len(table)
            tables.append(table)
            parts.append(cols)
        if not tables:
            return np.zeros((0, 3), np.int64), [np.zeros(0, t) for t in types]
        return np.concatenate(tables), [np.concatenate(c) for c in zip(*parts, strict=True)]

    def passed_on(rows: pd.DataFrame) -> tuple[list[bytes], list[tuple[int, int, bytes]]]:
        """Messages to work on, and flags that are only passed on."""
        work = rows["kind"].to_numpy() == ANCHORS
        return list(rows["blob"][work]), [(int(k), FLAGS, raw) for k, raw in zip(rows["bucket"][~work], rows["blob"][~work], strict=True)]

    def flags(table: np.ndarray, doc: np.ndarray, place: np.ndarray, kind: np.ndarray, out: list[tuple[int, int, bytes]]) -> None:
        _deal(FLAGS, table, doc, table[doc, 2], [place.astype(np.uint32), kind.astype(np.uint8)], out, 0)

    def second_pass(rows: pd.DataFrame) -> pd.DataFrame:
        blobs, out = passed_on(rows)
        table, (key, around, near_by, doc, place, crowded) = gathered(blobs, ANCHOR_TYPES, 3)
        order = np.argsort(key)
        group = _same(key[order])
        order = order[np.bincount(group)[group] > 1] if len(order) else order
        key, around, near_by, doc, place, crowded = key[order], around[order], near_by[order], doc[order], place[order], crowded[order]
        ranks = _ranks(table)[doc]
        order = np.lexsort((place, ranks, around, key))
        key, around, near_by, doc, place, crowded, ranks = key[order], around[order], near_by[order], doc[order], place[order], crowded[order], ranks[order]
        by_key, by_both = _same(key), _same(key, around)
        later = _later(by_both, ranks, place)
        is_hot = np.zeros(by_key[-1] + 1 if len(by_key) else 0, dtype=bool)
        np.logical_or.at(is_hot, by_key, crowded > 0)
        hot_row = is_hot[by_key] if len(by_key) else np.zeros(0, dtype=bool)
        flags(table, doc[later], place[later], np.full(later.sum(), COVERED), out)
        open_ = np.flatnonzero(~later & ~hot_row)
        open_ = open_[np.concatenate(([True], np.diff(by_both[open_]) != 0))] if len(open_) else open_
        k, d = key[open_], near_by[open_].astype(U64)
        left = _shared(mix64(k + (d >> U64(16)) * U64(SECOND) + U64(1)))
        right = _shared(mix64(k + (d & U64(0xFFFF)) * U64(SECOND) + U64(2)))
        kind = np.where(left & right, BOTH, np.where(left, LEFT, RIGHT))
        some = left | right
        flags(table, doc[open_[some]], place[open_[some]], kind[some], out)
        # Hot ones were told in their batch if they were crowded there; the others are told here.
        rest = np.flatnonzero(hot_row & (crowded == 0))
        flags(table, doc[rest], place[rest], np.full(len(rest), BOTH), out)
        return pd.DataFrame(out, columns=columns)

    def by_document(rows: pd.DataFrame) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        table, (doc, place, kind) = gathered(list(rows["blob"]), FLAG_TYPES, 0)
        ranks = _ranks(table)
        order = np.lexsort((place, ranks[doc]))
        doc, place, kind = doc[order], place[order].astype(np.int64), kind[order]
        group = _same(ranks[doc])
        edges = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0, [True]))) if len(group) else []
        return {(int(table[doc[a], 0]), int(table[doc[a], 1])): (place[a:b], kind[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)}

    def third_pass(texts: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        """Windows around the undecided anchors of a bucket of documents."""
        known = by_document(rows)
        hashes, tails, owners, places = [], [], [], []
        table = table_of(texts)
        ranks, done = _ranks(table), set()
        for i, t in enumerate(texts["text"]):
            here = (int(table[i, 0]), int(table[i, 1]))
            place, kind = known.get(here, (None, None))
            if place is None or here in done or not (kind > COVERED).any():
                continue
            done.add(here)
            raw = t.encode("utf-8", "surrogatepass")
            # Where windows begin that are not yet decided, as intervals.
            lows, highs = [], []
            for low, high, kinds in ((0, width - 1 - half, (RIGHT,)), (half, width - 1, (LEFT,)), (0, width - 1, (BOTH,))):
                a = place[np.isin(kind, kinds)]
                lows.append(np.maximum(a - high, 0))
                highs.append(np.minimum(a - low + 1, max(0, len(raw) - depth + 1)))
            low, high = joined(np.concatenate(lows), np.concatenate(highs))
            size = high - low
            starts = np.arange(size.sum()) + np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) if len(size) else low
            one, two, begin = np.zeros(len(starts), dtype=U64), np.zeros(len(starts), dtype=U64), 0
            while begin < len(starts):  # all windows that begin within a piece
                at, stop = starts[begin], np.searchsorted(starts, starts[begin] + PIECE)
                one[begin:stop], two[begin:stop] = windows_of(raw[at : starts[stop - 1] + depth], starts[begin:stop] - at, depth)
                begin = stop
            hashes.append(one)
            tails.append(two)
            owners.append(np.full(len(starts), i))
            places.append(starts)
        out: list[tuple[int, int, bytes]] = []
        if hashes:
            one, two, doc, place = np.concatenate(hashes), np.concatenate(tails), np.concatenate(owners), np.concatenate(places)
            order = np.lexsort((place, ranks[doc], two, one))
            one, two, doc, place = one[order], two[order], doc[order], place[order]
            later = _later(_same(one, two), ranks[doc], place)
            flags(table, doc[later], place[later], np.full(later.sum(), WINDOW), out)
            kept = ~later
            _deal(ANCHORS, table, doc[kept], (one[kept] % U64(n)).astype(np.int64), [one[kept], two[kept], place[kept].astype(np.uint32)], out, 2)
        return pd.DataFrame(out, columns=columns)

    def fourth_pass(rows: pd.DataFrame) -> pd.DataFrame:
        blobs, out = passed_on(rows)
        table, (one, two, doc, place) = gathered(blobs, WINDOW_TYPES, 2)
        order = np.argsort(one)
        group = _same(one[order])
        order = order[np.bincount(group)[group] > 1] if len(order) else order
        ranks = _ranks(table)[doc[order]]
        order2 = np.lexsort((place[order], ranks, two[order], one[order]))
        order, ranks = order[order2], ranks[order2]
        later = _later(_same(one[order], two[order]), ranks, place[order])
        order = order[later]
        flags(table, doc[order], place[order], np.full(len(order), WINDOW), out)
        return pd.DataFrame(out, columns=columns)

    def cut(texts: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        known = by_document(rows)
        out, done = [], set()
        for k, tie, t in zip(texts["key"], texts["tie"], texts["text"], strict=True):
            if (k, tie) in done:
                continue
            done.add((k, tie))
            raw = t.encode("utf-8", "surrogatepass")
            starts = ends = np.zeros(0, dtype=np.int64)
            place, kind = known.get((int(k), int(tie)), (None, None))
            if place is not None:
                a, w = place[kind == COVERED], place[kind == WINDOW]
                low = np.concatenate((np.maximum(a - 2 * half, 0), w))
                high = np.concatenate((np.minimum(a + ANCHOR + 2 * half, len(raw)), w + depth))
                long = high - low >= depth  # near an end of a text, what agrees may be shorter than a window
                starts, ends = joined(low[long], high[long])
            left = b"".join(raw[a:b] for a, b in zip(np.concatenate(([0], ends)).tolist(), np.concatenate((starts, [len(raw)])).tolist(), strict=True))
            out.append((int(k), int(tie), len(raw), len(raw) - len(left), len(starts), starts.tolist(), ends.tolist(), hashlib.sha256(left).hexdigest(), left if keep_text else None))
        return pd.DataFrame(out, columns=["key", "tie", "n_bytes", "n_removed", "n_spans", "starts", "ends", "kept_sha256", "kept"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows without those that this task has sent."""
        done: set = set()
        for b in batches:
            at = [b.schema.get_field_index(c) for c in ("key", "tie")]
            fresh = []
            for here in zip(*(b.column(i).to_pylist() for i in at), strict=True):
                fresh.append(here not in done)
                done.add(here)
            yield b if all(fresh) else b.filter(pa.array(fresh))

    # Every document has a bucket of its own hash, to which all flags of it go.
    picked = picked.withColumn("home", F.pmod(F.xxhash64("key", "tie"), F.lit(n)).cast("long")).select("home", "key", "tie", "text")
    near = picked.mapInPandas(first_pass, messages)
    found = materialise(near.groupBy("bucket").applyInPandas(second_pass, messages), "flags").select("bucket", "kind", "blob")
    texts = picked.mapInArrow(once, "home long, key long, tie long, text string").groupBy("home")
    found = found.withColumn("home", F.col("bucket"))
    windows = texts.cogroup(found.groupBy("home")).applyInPandas(third_pass, messages)
    more = windows.groupBy("bucket").applyInPandas(fourth_pass, messages).withColumn("home", F.col("bucket"))
    schema = "key long, tie long, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept_sha256 string, kept binary"
    out = texts.cogroup(found.unionByName(more).groupBy("home")).applyInPandas(cut, schema)
    # Rows that were equal, and ids that were null (or the largest number), come back.
    several = counted.where("copies > 1 or nones > 0").select(F.col("key").alias("_key"), F.col("tie").alias("_tie"), "copies", "nones")
    out = out.join(several, (F.col("key") == F.col("_key")) & (F.col("tie") == F.col("_tie")), "left")
    out = out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1)))))
    doc_id = F.when(F.col("nth") > F.coalesce("nones", F.lit(0)), F.col("key"))
    return out.select(doc_id.alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.arrays_zip("starts", "ends").alias("spans"), "kept_sha256", "kept")
