"""Documents packed into sequences: first-fit decreasing within randomised groups of documents.

Each document is tokenized once and stored: whole sequences of a long document as they are, what is left of it (its tail, less
than a sequence) as a row with a random number.  That number deals tails to groups, so a group holds about
``group_tokens`` whatever the rows are, a third of them being the same included.  A group is packed by first fit in decreasing
order; a tournament tree over the room left in its bins finds the first bin with enough room in log2 n steps.

First fit leaves some room.  As documents may be cut, the emptiest bins are taken apart to fill that room, and what then remains
of a group (less than a sequence) becomes sequences of powers of two, which need no padding.  So nothing is padded, and a group
has some more cuts than bins with room, and at most log2 ``size`` short sequences.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

CHUNK = 1 << 20  # characters that are tokenized at once
WORDS = 800_000  # words whose ids a worker remembers, some 200 bytes each

Encoder = Callable[[list[str]], list[bytes]]


class Words(dict):
    """Numbers of words; those that are new since their ids were last asked for are in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        found = self[word] = len(self)
        self.new.append(word)
        return found


class Known:
    """The ids of words that a task has met, as one run of ids with its starts."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        self.words, self.ids, self.starts = Words(), np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def learn(self, at_once: int = 64) -> None:
        """Encode new words, some at a time with blanks between: the offsets of tokens say whose they are."""
        words, self.words.new = self.words.new, []
        lists = [words[i : i + at_once] for i in range(0, len(words), at_once)]
        ids, starts = [self.ids], [self.starts]
        for i in range(0, len(lists), 64):
            some = lists[i : i + 64]
            for own, found in zip(some, self.tokenizer.encode_batch([" ".join(w) for w in some], add_special_tokens=False), strict=True):
                first = np.fromiter((o[0] for o in found.offsets), dtype=np.int64, count=len(found))
                after = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1)
                starts.append(starts[-1][-1] + np.searchsorted(first, after))
                ids.append(np.array(found.ids, dtype="<u4"))
        self.ids, self.starts = np.concatenate(ids), np.concatenate(starts)

    def look_up(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many there are of each."""
        first = self.starts[numbers]
        sizes = self.starts[numbers + 1] - first
        ends = np.cumsum(sizes)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)], sizes


def by_words(path: str, limit: int = WORDS) -> Callable[[], Encoder]:
    """An encoder for a vocabulary of the ``tokenizers`` library that never joins what white space parts.

    Its ids are then those of the runs between blanks, one after the other.  A worker process remembers the ids of words that
    its tasks have met, for as long as it runs tasks of this encoder.  Texts become little-endian 32-bit ids.  ``path`` must be
    readable where tasks run.
    """
    own = uuid.uuid4().hex

    def make() -> Encoder:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tokenizers

        # Tasks get copies of this package, so what outlives a task is kept with the library; one encoder's words at a time.
        kept = tokenizers.__dict__.setdefault("_tiltwise_words", {})
        if own not in kept:
            kept.clear()
            kept[own] = Known(tokenizers.Tokenizer.from_file(path))
        known = kept[own]

        def parts(text: str) -> Iterator[list[str]]:
            """Runs between blanks, some ``CHUNK`` characters at a time; other white space stays inside a run, for the library."""
            text, at = text.replace("\n", " ").replace("\t", " ").replace("\r", " "), 0
            while at < len(text):
                end = text.find(" ", at + CHUNK)
                end = len(text) if end < 0 else end
                yield text[at:end].split(" ")
                at = end

        def encode(texts: list[str]) -> list[bytes]:
            """Texts are taken together until they hold ``CHUNK`` characters, so that new words are encoded many at a time."""
            out: list[list[bytes]] = [[] for _ in texts]
            held: list[tuple[int, np.ndarray]] = []

            def told() -> None:
                nonlocal held
                known.learn()
                ids, sizes = known.look_up(np.concatenate([n for _, n in held])) if held else (known.ids[:0], known.starts[:0])
                ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum([len(n) for _, n in held], dtype=np.int64))].tolist()
                for (i, _), a, b in zip(held, ends[:-1], ends[1:], strict=True):
                    out[i].append(ids[a:b].tobytes())
                held = []
                if len(known.words) > limit or len(known.ids) > 16 * limit:
                    known.clear()

            size = 0
            for i, text in enumerate(texts):
                for words in parts(text):
                    held.append((i, np.array(list(map(known.words.__getitem__, words)), dtype=np.int64)))
                    size += len(words)
                    if size >= CHUNK // 4:
                        told()
                        size = 0
            told()
            return [p[0] if len(p) == 1 else b"".join(p) for p in out]

        return encode

    return make


class FirstFit:
    """A tournament tree over the room in bins: each node knows the most room below it."""

    def __init__(self, size: int, bins: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [size] * (2 * self.leaves)

    def place(self, length: int) -> int:
        """The first bin that has room for ``length``, which it then takes."""
        most, node = self.most, 1
        while node < self.leaves:
            node *= 2
            if most[node] < length:
                node += 1
        found = node - self.leaves
        most[node] -= length
        while node > 1:
            node //= 2
            most[node] = max(most[2 * node], most[2 * node + 1])
        return found


def first_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Items of each bin, by number; two bins are never both half empty, so their number is bounded."""
    tree = FirstFit(size, 2 * int(lengths.sum()) // size + 1)
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        at = tree.place(int(lengths[i]))
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def pack_group(lengths: np.ndarray, size: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length): each is of ``size`` or of a power of two."""
    bins = first_fit_decreasing(lengths, size)
    filled = np.array([int(lengths[b].sum()) for b in bins], dtype=np.int64)
    open_ = [k for k in np.argsort(-filled, kind="stable").tolist() if filled[k] < size]
    n_full = int(filled[open_].sum()) // size  # so many of them can be filled, by taking the others apart
    out = [[(i, 0, int(lengths[i])) for i in b] for b in bins]
    loose = [piece for k in open_[n_full:] for piece in out[k]]
    wanted = [k for k in open_[:n_full] if filled[k] < size]
    rest = sum(p[2] for p in loose) - sum(size - int(filled[k]) for k in wanted)
    targets = [(out[k], size - int(filled[k])) for k in wanted] + [([], 1 << b) for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    loose.reverse()
    for sequence, room in targets:
        while room:
            item, start, length = loose.pop()
            taken = min(room, length)
            sequence.append((item, start, taken))
            room -= taken
            if taken < length:
                loose.append((item, start + taken, length - taken))
    gone = set(open_[n_full:])
    return [s for k, s in enumerate(out) if k not in gone] + [s for s, _ in targets[len(wanted) :]]


def pack_documents(docs: DataFrame, encoder: Callable[[], Encoder], end_id: int | None = None, size: int = 4096, group_tokens: int = 2_000_000, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``: a row for each piece of a document.

    ``ids`` are the piece's token ids (little-endian, 32 bits each); ``start`` counts the document's ids before it, and
    ``offset`` those before it in its sequence, without gaps from 0.  Each id of each row of ``docs``, ``end_id`` after its last
    one included, is in exactly one piece.  ``size`` must be a power of two; every sequence is full or of a smaller power of two.

    A null text is empty (it has ``end_id`` alone, and no piece without one); null ids, ids that are shared and rows that repeat
    are documents of their own, told apart by their pieces only; an empty table has no pieces; other columns are ignored.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    # Ids travel as strings, as they may be null.
    picked = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    doc_id = F.col("doc_id").cast(docs.select(F.col(f"`{id_col}`")).schema[0].dataType).alias("doc_id")
    last = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
    step = 4 * size

    def tokenized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each whole sequence of a document and one for its tail; ``own`` numbers the rows of a task."""
        encode, part, nth = encoder(), TaskContext.get().partitionId(), 0
        for b in batches:
            at = 0
            while at < len(b):
                end, held = at, 0
                while end < len(b) and (end == at or held + len(b["text"].iat[end]) <= 4 * CHUNK):
                    held += len(b["text"].iat[end])
                    end += 1
                rows = []
                for doc_id, raw in zip(b["doc_id"].iloc[at:end], encode(b["text"].iloc[at:end].tolist()), strict=True):
                    raw += last
                    n = len(raw) // 4
                    for start in range(0, n, size):
                        ids = raw[4 * start : 4 * start + step]
                        rows.append((doc_id, start, n, len(ids) == step, part << 32 | nth, ids if len(ids) == step else _narrow(ids)))
                        nth += 1
                yield pd.DataFrame(rows, columns=["doc_id", "start", "doc_tokens", "whole", "own", "ids"])
                at = end

    stored = materialise(picked.mapInPandas(tokenized, "doc_id string, start long, doc_tokens long, whole boolean, own long, ids binary"), "tokens")
    # Sequences made of one piece have odd numbers, those of groups even ones.
    whole = stored.where("whole").select("doc_id", "start", F.lit(size).cast("long").alias("length"), "ids", "doc_tokens", (F.col("own") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    tails = stored.where("not whole")
    total = tails.agg(F.sum(F.col("doc_tokens") - F.col("start"))).first()[0] or 0
    groups = max(1, -(-total // group_tokens))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("own", ignore_index=True)  # so that a task that runs again packs alike
        lengths = (rows["doc_tokens"] - rows["start"]).to_numpy(np.int64)
        out = []
        base = int(rows["group"].iat[0]) << 32
        for k, sequence in enumerate(pack_group(lengths, size)):
            offset = 0
            for i, start, length in sequence:
                ids = _wide(rows["ids"].iat[i])[4 * start : 4 * (start + length)]
                out.append((rows["doc_id"].iat[i], int(rows["start"].iat[i]) + start, length, ids, int(rows["doc_tokens"].iat[i]), (base | k) * 2, offset))
                offset += length
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    schema = "doc_id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    grouped = tails.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "own"), F.lit(groups))).groupBy("group").applyInPandas(packed, schema)
    return whole.unionByName(grouped).select(doc_id, "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def _narrow(ids: bytes) -> bytes:
    """Two bytes for each id where all are below 65,536, behind a byte that says so."""
    wide = np.frombuffer(ids, dtype="<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if wide.max(initial=0) < 1 << 16 else b"\x04" + ids


def _wide(ids: bytes) -> bytes:
    return np.frombuffer(ids, dtype="<u2", offset=1).astype("<u4").tobytes() if ids[0] == 2 else ids[1:]
