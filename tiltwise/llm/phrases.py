"""Phrases whose words keep together, by growing contiguous patterns to the right.

As in PrefixSpan, every frequent word is a prefix with a projection: its occurrences, each with the words that follow it in its
piece (as many as a phrase may still grow by).  A task holds the projections of some prefixes and extends them depth-first: the
occurrences of a prefix are parted by their next word, what is still frequent is a phrase, and only its occurrences go on.

Occurrences with equal following words are one with a number, in every task before anything is shuffled, so a passage that a
third of the documents share is a message for each task.  A prefix that occurs more than ``heavy`` times has no single task:
its occurrences are dealt by all their words, so counts of its extensions come from several tasks and are added up, while those
of the longest phrases are whole.  ``heavy`` grows with the corpus beyond a million prefixes, so that their hashes (which all
tasks get) take 8 MB at most; a hash that stands for two words only splits one more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, materialise, mix64

NO_LANG = "und"
CHUNK = 2 << 20  # bytes of text that are split at once
#: Capital letters become small, marks that end a piece line feeds, tabs blanks: all are single bytes, in UTF-8 as well.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
END = b"\xff"  # in no UTF-8 text: stands for the end of a piece
MIX = 0x9E3779B97F4A7C15


class Numbers(dict):
    """Words of a task as numbers from 1, with a hash of language and word; 0 is the end of a piece."""

    def __init__(self, lang: str):
        super().__init__({END: 0})
        self.seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
        self.words, self.hashes = [END], [0]

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word, self.seed))
        return found


def runs(texts: list[str]) -> Iterator[bytes]:
    """Folded texts with ends between them, some ``CHUNK`` bytes at a time; a long text is one run."""
    held, size = [], 0
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass").translate(FOLD)
        held.append(raw)
        size += len(raw)
        if size >= CHUNK:
            yield b"\n".join(held) + b"\n"
            held, size = [], 0
    if held:
        yield b"\n".join(held) + b"\n"


def numbered(run: bytes, numbers: Numbers) -> np.ndarray:
    """The words of a run as numbers.  Blanks and line feeds are the only white space that is left, so they part all words."""
    return np.array(list(map(numbers.__getitem__, run.replace(b"\n", b" \xff ").split())), dtype=np.int64)


def windows(at: np.ndarray, longest: int) -> np.ndarray:
    """For each word: itself and those after it in its piece, ``longest`` in all; 0 from the end of the piece on."""
    padded = np.concatenate((at, np.zeros(longest, dtype=np.int64)))
    out = np.zeros((len(at), longest), dtype=np.int64)
    inside = np.ones(len(at), dtype=bool)
    for k in range(longest):
        column = padded[k : k + len(at)]
        inside &= column > 0
        out[:, k] = np.where(inside, column, 0)
    return out[at > 0]


def together(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows as one, in order; their counts added up."""
    if not len(rows):
        return rows, counts
    base, width = int(rows.max()) + 1, rows.shape[1]
    if base**width < 1 << 63:
        key = np.zeros(len(rows), dtype=np.int64)
        for k in range(width):
            key = key * base + rows[:, k]
        order = np.argsort(key, kind="stable")
        fresh = np.diff(key[order]) != 0
    else:
        order = np.lexsort(rows.T[::-1])
        fresh = (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
    first = np.flatnonzero(np.concatenate(([True], fresh)))
    return rows[order[first]], np.add.reduceat(counts[order], first)


def grow(rows: np.ndarray, counts: np.ndarray, pointers: np.ndarray, depth: int, least: int, whole: bool) -> Iterator[tuple[tuple[int, ...], int]]:
    """Phrases that extend the prefix which the rows at ``pointers`` share in their first ``depth`` words.

    A phrase is given with how often it occurs.  Unless ``whole``, other tasks hold occurrences of it too, so phrases that are
    shorter than the longest are given however rare they are here; those that are rare here have no longest phrase to give.
    """
    longest = rows.shape[1]
    following = rows[pointers, depth]
    pointers, following = pointers[following > 0], following[following > 0]
    if not len(pointers):
        return
    order = np.argsort(following, kind="stable")
    pointers, following = pointers[order], following[order]
    first = np.flatnonzero(np.concatenate(([True], following[1:] != following[:-1])))
    sums = np.add.reduceat(counts[pointers], first)
    prefix = tuple(rows[pointers[0], :depth].tolist())
    ends = np.append(first[1:], len(pointers))
    here, beyond = (1 if not whole and size < longest else least for size in (depth + 1, depth + 2))
    for k in np.flatnonzero(sums >= here).tolist():
        yield (*prefix, int(following[first[k]])), int(sums[k])
        if depth + 1 < longest and sums[k] >= beyond:
            yield from grow(rows, counts, pointers[first[k] : ends[k]], depth + 1, least, whole)


def folded(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def count_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 400_000) -> DataFrame:
    """``lang, word, f, h``: how often each word occurs in each language, and the hash by which it is dealt out."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[Numbers, np.ndarray]] = {}

        def told() -> Iterator[pd.DataFrame]:
            for lang, (numbers, sums) in held.items():
                some = np.flatnonzero(sums[1 : len(numbers.words)]) + 1
                for i in range(0, len(some), 50_000):
                    part = some[i : i + 50_000]
                    yield pd.DataFrame({"lang": lang, "word": [numbers.words[j].decode("utf-8", "surrogatepass") for j in part], "f": sums[part], "h": np.array([numbers.hashes[j] for j in part], dtype=U64).view(np.int64)})
            held.clear()

        for b in batches:
            for lang, texts in b.groupby("lang", sort=False)["text"]:
                for run in runs(texts.tolist()):
                    numbers, sums = held.get(lang) or (Numbers(lang), np.zeros(0, dtype=np.int64))
                    found = np.bincount(numbered(run, numbers))
                    longer = np.zeros(max(len(found), len(sums)), dtype=np.int64)
                    longer[: len(sums)] += sums
                    longer[: len(found)] += found
                    held[lang] = numbers, longer
                    if sum(len(n.words) for n, _ in held.values()) > most:
                        yield from told()
        yield from told()

    sums = folded(docs, text_col, lang_col).mapInPandas(counted, "lang string, word string, f long, h long")
    return sums.groupBy("lang", "word").agg(F.sum("f").alias("f"), F.first("h").alias("h"))


def frequent_phrases(docs: DataFrame, words: DataFrame, longest: int = 3, least: int = 10, heavy: int = 200_000, per_task: int = 250_000, text_col: str = "text", lang_col: str = "lang", most: int = 400_000) -> DataFrame:
    """``lang, phrase, size, a``: phrases of 2 to ``longest`` words (joined by blanks) that occur ``least`` times or more.

    ``words`` is the stored result of ``count_words`` for the same rows.
    """
    total = words.agg(F.sum("f")).first()[0] or 0
    bound = max(heavy, -(-total // 1_000_000))
    # At most a million words are that frequent; their hashes are all that tasks get of them.
    split = np.sort(np.array([r["h"] for r in words.where(F.col("f") > bound).select("h").collect()], dtype=np.int64).view(U64))
    parts = max(8, -(-total // per_task))

    def messages(lang: str, numbers: Numbers, rows: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        hashes = np.array(numbers.hashes, dtype=U64)
        own = hashes[rows[:, 0]]
        apart = np.isin(own, split)
        all_words = np.zeros(len(rows), dtype=U64)
        for k in range(rows.shape[1]):
            all_words = mix64(all_words * U64(MIX) + hashes[rows[:, k]] + U64(k + 1))
        bucket = (np.where(apart, all_words, mix64(own)) % U64(parts)).astype(np.int64)
        order = np.lexsort((bucket, apart))
        rows, counts, bucket, apart = rows[order], counts[order], bucket[order], apart[order]
        edges = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (apart[1:] != apart[:-1]), [True]))) if len(rows) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            used, at = np.unique(rows[a:b], return_inverse=True)
            told = b"\n".join(numbers.words[j] for j in used.tolist())  # a word holds no line feed; number 0, the end, comes first if it is used
            yield int(bucket[a]), lang, bool(apart[a]), told, at.astype(np.int32).tobytes(), counts[a:b].tobytes()

    columns = ["bucket", "lang", "apart", "words", "rows", "counts"]

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[Numbers, list, list]] = {}
        size = 0

        def told() -> Iterator[pd.DataFrame]:
            for lang in list(held):
                numbers, rows, counts = held.pop(lang)
                out = list(messages(lang, numbers, *together(np.concatenate(rows), np.concatenate(counts))))
                for i in range(0, len(out), 1000):
                    yield pd.DataFrame(out[i : i + 1000], columns=columns)

        for b in batches:
            for lang, texts in b.groupby("lang", sort=False)["text"]:
                for run in runs(texts.tolist()):
                    numbers, rows, counts = held.setdefault(lang, (Numbers(lang), [], []))
                    found = windows(numbered(run, numbers), longest)
                    found, n = together(found, np.ones(len(found), dtype=np.int64))
                    rows.append(found.astype(np.int32))
                    counts.append(n)
                    size += len(found)
                    if size > 2_000_000 or sum(len(h[0].words) for h in held.values()) > most:
                        yield from told()
                        size = 0
        yield from told()

    def extend(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        _, lang, apart = key
        numbers, words_of, rows, counts = {END: 0}, [END], [], []
        for told, raw, n in zip(found["words"], found["rows"], found["counts"], strict=True):
            local = []
            for w in told.split(b"\n"):
                if w not in numbers:
                    numbers[w] = len(words_of)
                    words_of.append(w)
                local.append(numbers[w])
            rows.append(np.array(local, dtype=np.int32)[np.frombuffer(raw, dtype=np.int32)].reshape(-1, longest))
            counts.append(np.frombuffer(n, dtype=np.int64))
        one, n = together(np.concatenate(rows), np.concatenate(counts))
        out = []
        first = np.flatnonzero(np.concatenate(([True], one[1:, 0] != one[:-1, 0])))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(one)], strict=True):
            if apart or n[a:b].sum() >= least:
                for phrase, f in grow(one, n, np.arange(a, b), 1, least, not apart):
                    out.append((lang, b" ".join(words_of[j] for j in phrase).decode("utf-8", "surrogatepass"), len(phrase), f))
        return pd.DataFrame(out, columns=["lang", "phrase", "size", "a"])

    projected = folded(docs, text_col, lang_col).mapInPandas(project, "bucket long, lang string, apart boolean, words binary, rows binary, counts binary")
    grown = projected.groupBy("bucket", "lang", "apart").applyInPandas(extend, "lang string, phrase string, size int, a long")
    return grown.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def exact_share(scale: int, a: Column, left: Column, right: Column) -> Column:
    """floor(scale a a / (left right)) of counts below 10 ** 15, in whole numbers of up to 38 digits."""
    whole = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(scale).cast("decimal(7,0)") * whole(a) * whole(a), whole(left) * whole(right))


def mine_phrases(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, inside_percent: int = 50, scale: int = 1_000_000, heavy: int = 200_000, per_task: int = 250_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Return ``lang, rank, phrase, a, l, r, n, score, size, k``: the phrases of each language by how well they keep together.

    Texts are lower-cased in A-Z, parted at ``.,;:!?`` and at line ends into pieces, and those at blanks and tabs into words.
    A phrase has 2 to ``longest`` words and ``a`` >= ``least`` occurrences within pieces, overlapping ones too.  Cut
    after ``k`` of its words, its parts occur ``l`` and ``r`` times; its score is floor(``scale`` a a / (l r)) at the cut where
    that is lowest (of equal ones the smallest ``k``).  A phrase whose words lie within a longer one that occurs
    ``inside_percent`` of a hundred times as often, or more, is left out.  ``n`` counts all words of the language.  Ranks go
    by score and ``a`` (both falling) and phrase (by its bytes); each language reports its first ``top``.

    A null text is empty; a null language is ``und``, as are rows that say so; rows that repeat count as often as they are
    there; without phrases, and for an empty table, there are no rows; other columns are ignored.
    """
    if longest < 2 or least < 1:
        raise ValueError("longest must be at least 2, least at least 1")
    words = materialise(count_words(docs, text_col, lang_col), "words")
    found = materialise(frequent_phrases(docs, words, longest, least, heavy, per_task, text_col, lang_col), "phrases")
    cuts = found.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    split = F.split("phrase", " ")
    side = F.explode(F.array(F.struct(F.lit(True).alias("left"), F.array_join(F.slice(split, F.lit(1), F.col("k")), " ").alias("part")), F.struct(F.lit(False).alias("left"), F.array_join(F.slice(split, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("part"))))
    sides = cuts.withColumn("side", side).select("lang", "phrase", "size", "a", "k", "side.left", "side.part")
    counts = words.where(F.col("f") >= least).select("lang", F.col("word").alias("part"), "f").unionByName(found.where(F.col("size") < longest).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    total = words.agg(F.sum("f")).first()[0] or 0
    sides = _with_counts(sides, counts, max(heavy * least, -(-total // 100_000)))
    # Equal phrases meet here, a row for each side of each cut.
    number = lambda left, k: F.max(F.when((F.col("left") == left) & (F.col("k") == k), F.col("f")))
    wide = sides.groupBy("lang", "phrase", "size", "a").agg(*[number(left, k).alias(f"{name}{k}") for k in range(1, longest) for left, name in ((True, "l"), (False, "r"))])
    scored = [F.when(F.col(f"l{k}").isNotNull(), F.struct(exact_share(scale, F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    lowest = F.least(*scored) if len(scored) > 1 else scored[0]
    candidates = wide.select("lang", "phrase", "size", "a", lowest.alias("cut")).select("lang", "phrase", "size", "a", "cut.*")
    # Words within longer phrases: of each run of words, how often the most frequent phrase around it occurs.
    inner = found.where(F.col("size") > 2).select("lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, m), " "))))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = candidates.join(inner, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * inside_percent)).drop("around")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # The first of each share first, so that no task orders all phrases of a language.
    kept = kept.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_nth") <= top).drop("_share", "_nth")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.where(F.col("rank") <= top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "size", "k")


def _with_counts(sides: DataFrame, counts: DataFrame, bound: int) -> DataFrame:
    """Add ``f``, the count of ``part``.

    A part that occurs f times is in at most f / least phrases on either side.  Those above ``bound`` occurrences are dealt to
    several keys, with as many copies of their count: a hundred thousand parts of each length at most, as counts of one length
    add up to no more than the corpus.  So their hashes may be sent to all tasks; parts of one hash are dealt alike.
    """
    key = F.xxhash64("lang", "part")
    many = F.broadcast(counts.where(F.col("f") > bound).groupBy(key.alias("_h")).agg(F.max(F.col("f") / bound).cast("int").alias("ways")))
    ways = F.coalesce(F.col("ways"), F.lit(1))
    dealt = sides.withColumn("_h", key).join(many, "_h", "left").withColumn("way", F.pmod(F.xxhash64("phrase", "k"), ways).cast("int")).drop("ways", "_h")
    copies = counts.withColumn("_h", key).join(many, "_h", "left").withColumn("way", F.explode(F.sequence(F.lit(0), ways - 1))).drop("ways", "_h")
    return dealt.join(copies, ["lang", "part", "way"]).drop("way")
