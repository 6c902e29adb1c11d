"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into m segments, and each segment's value is a key of the index.  If two codes differ in at most m r + s bits, one of
the first s + 1 segments differs in at most r bits, or one of the others in at most r - 1.  So a query looks up all values
of its segments at radius r, for r = 0, 1, ..., and leaves when its k-th verified distance is covered.  Once it has k codes,
segments that would cover more than the k-th distance are not looked up, and codes farther than that are not passed on.

The index is a table of (segment, value) keys and a radius is one join with it, so neither codes nor queries are sent everywhere.
A pair is met by several segments and radii but counted once: at its smallest segment distance, by the first segment that
has it, which both codes tell.  Only the k nearest of each query leave a task.  Rows with equal codes are one entry with their k
smallest ids, summed in two steps, and queries with equal codes are asked once, so a common vector is no hot key.  Values that
more than ``split`` entries have are split, and what asks for them is sent to each part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

WORD = 64
PROBES = 400_000  # rows that a task makes at once
FAR = 1 << 30  # the k-th distance of a query that has fewer than k codes


def pack(vectors: list, dims: int) -> np.ndarray:
    """Codes as rows of 64-bit words: bit i is set where component i is above 0; null components and missing ones are not."""
    words = max(1, -(-dims // WORD))
    bits = np.zeros((len(vectors), words * WORD), dtype=bool)
    for i, v in enumerate(vectors):
        bits[i, : len(v)] = np.array([x is not None and x > 0 for x in v], dtype=bool) if any(x is None for x in v) else np.asarray(v, dtype=float) > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def expected_cost(dims: int, n: int, k: int, m: int) -> float:
    """Rows that a query makes with ``m`` segments if bits are random: the codes it meets, and 8 times the values it asks for."""
    radius, reach, share = 0, 0, 0.0
    while reach < dims and (share := share + math.comb(dims, reach) / 2**dims) * n < k:
        reach += 1
    width, asked, met = max(1, round(dims / m)), 0, 0.0
    while True:
        for s in range(m):
            values = math.comb(width, radius)
            asked, met = asked + values, met + n * values / 2**width
            if m * radius + s >= reach:
                return 8 * asked + met
        radius += 1


def segments_of(dims: int, n: int, k: int = 10) -> list[tuple[int, int, int]]:
    """Word, lowest bit and width of each segment, as many as cost least; none goes across words."""
    dims = max(1, dims)
    few = max(1, -(-dims // 32))
    wanted = min(range(few, max(few, dims // 4) + 1), key=lambda m: expected_cost(dims, max(1, n), k, m))
    found = []
    for word in range(-(-dims // WORD)):
        used = min(WORD, dims - word * WORD)
        parts = max(1, round(wanted * used / dims))
        edges = [used * i // parts for i in range(parts + 1)]
        found += [(word, a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return found


def masks_of(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], dtype=np.int64)


def _value(words: Column, segment: tuple[int, int, int]) -> Column:
    word, low, width = segment
    return F.shiftrightunsigned(words[word], low).bitwiseAND(F.lit((1 << width) - 1 if width < WORD else -1))


def nearest_codes(vectors: DataFrame, queries: DataFrame, k: int = 10, split: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Return ``query_id, rank, vec_id, distance``: the ``k`` rows of ``vectors`` nearest to each row of ``queries``.

    Codes have a bit for each component, set where it is above 0; shorter vectors count as filled with unset bits.  The order
    is by distance, then id (null last); a query that is a row of ``vectors`` finds itself.  Rows that repeat are found
    each, and queries that repeat are answered each, with or without an id.  Null vectors are neither found nor searched
    for; empty ones are codes without a set bit.  With fewer than ``k`` rows, all are returned; without rows, nothing.
    Other columns are ignored.
    """
    size = F.max(F.size(f"`{vector_col}`"))
    dims = max(vectors.agg(size).first()[0] or 0, queries.agg(size).first()[0] or 0)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "none": b["none"], "code": list(pack(list(b["v"]), dims))})

    def coded(df: DataFrame) -> DataFrame:
        own = F.col(f"`{id_col}`").cast("long")
        picked = df.select(F.coalesce(own, F.lit(0)).alias("id"), own.isNull().alias("none"), F.col(f"`{vector_col}`").alias("v"))
        return picked.where("v is not null").mapInPandas(encode, "id long, none boolean, code array<long>")

    order = ["none", "id"]
    rows = coded(vectors).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("code", "part").orderBy(*order))).where(F.col("n") <= k)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy(*order))).where(F.col("n") <= k)
    entries = materialise(rows.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("none", "id"))).alias("ids")), "codes")
    counted = entries.agg(F.count("*").alias("entries"), F.sum(F.size("ids")).alias("rows")).first()
    wanted = min(k, counted["rows"] or 0)
    segments = segments_of(dims, counted["entries"], k)
    keys = F.array(*[F.struct(F.lit(s).alias("s"), _value(F.col("code"), seg).alias("v")) for s, seg in enumerate(segments)])
    index = entries.select(F.explode(keys).alias("key"), "code", "ids").select("key.s", "key.v", "code", "ids")
    hot = index.groupBy("s", "v").agg(F.count("*").alias("size")).where(F.col("size") > split).select("s", "v", F.ceil(F.col("size") / split).cast("int").alias("parts"))
    hot = materialise(hot, "hot_values")
    part = F.pmod(F.xxhash64("code"), F.coalesce("parts", F.lit(1))).cast("int")
    index = materialise(index.join(hot, ["s", "v"], "left").select("s", "v", part.alias("part"), "code", "ids"), "index")

    asked = materialise(coded(queries), "queries")
    active = materialise(asked.select("code").distinct().withColumn("q", F.monotonically_increasing_id()).withColumn("far", F.lit(FAR)), "asked")
    members = materialise(asked.join(active, "code").select("q", "id", "none"), "members")

    # Segment distances of a pair, and whether this segment and radius are the first to meet it.
    apart = [F.bit_count(_value(F.col("sought"), seg).bitwiseXOR(_value(F.col("code"), seg))) for seg in segments]
    first = F.lit(True)
    for s, d in enumerate(apart):
        first = first & ((d > F.col("radius")) | ((d == F.col("radius")) & (F.col("s") <= s)))
    distance = sum(apart[1:], apart[0]).cast("int")
    near = Window.partitionBy("q").orderBy("distance", "none", "id")
    nearest = Window.partitionBy("q").orderBy("distance", F.col("ids")[0]["none"], F.col("ids")[0]["id"])

    best, done, left = None, [], active.count()
    widest = max(width for _, _, width in segments)
    radii = [0, 1]
    while wanted and radii:

        def probe(batches: Iterator[pd.DataFrame], radii=tuple(radii)) -> Iterator[pd.DataFrame]:
            masks = [(s, r, masks_of(width, r)) for s, (_, _, width) in enumerate(segments) for r in radii]
            each = sum(len(m) for *_, m in masks)
            step = max(1, PROBES // max(1, each))
            for b in batches:
                for i in range(0, len(b), step):
                    own = b.iloc[i : i + step]
                    codes, far, q = np.stack([np.asarray(c, dtype=np.int64) for c in own["code"]]), own["far"].to_numpy(), own["q"].to_numpy()
                    out = {"q": [], "s": [], "radius": [], "v": [], "far": []} | {f"w{w}": [] for w in range(codes.shape[1])}
                    for s, r, mask in masks:
                        some = len(segments) * r + s <= far  # others have what they need
                        code, n = codes[some], int(some.sum())
                        word, low, width = segments[s]
                        value = (code[:, word].view(np.uint64) >> np.uint64(low) & np.uint64((1 << width) - 1)).view(np.int64)
                        out["v"].append((value[:, None] ^ mask).ravel())
                        out["q"].append(np.repeat(q[some], len(mask)))
                        out["far"].append(np.repeat(far[some], len(mask)))
                        out["s"].append(np.full(n * len(mask), s))
                        out["radius"].append(np.full(n * len(mask), r))
                        for w in range(code.shape[1]):
                            out[f"w{w}"].append(np.repeat(code[:, w], len(mask)))
                    yield pd.DataFrame({c: np.concatenate(parts) for c, parts in out.items()})

        words = [f"w{w}" for w in range(max(1, -(-dims // WORD)))]
        each = sum(math.comb(width, r) for _, _, width in segments for r in radii)
        spread = active.select("q", "code", "far").repartition(max(1, -(-left * each // PROBES)), "q")
        probes = spread.mapInPandas(probe, "q long, s int, radius int, v long, far int, " + ", ".join(f"{w} long" for w in words)).join(hot, ["s", "v"], "left")
        probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        met = probes.join(index.hint("merge"), ["s", "v", "part"]).withColumn("sought", F.array(*words)).where(first & (distance <= F.col("far"))).select("q", distance.alias("distance"), "ids")
        # An entry's smallest id stands for it: what is not among the first k entries has no row among the first k.
        met = met.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k).select("q", "distance", F.explode("ids").alias("row")).select("q", "distance", "row.none", "row.id")
        pool = met if best is None else met.unionByName(best.select("q", "distance", "none", "id"))
        ranked = materialise(pool.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k), "ranked")
        # Of segments beyond the k-th distance nothing was asked, and nothing was needed.
        covered = F.least(F.col("before"), F.lit(len(segments) * (radii[-1] + 1) - 1 if radii[-1] < widest else len(segments) * WORD))
        reached = ranked.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        state = active.select("q", "code", F.col("far").alias("before")).join(reached, "q", "left").withColumn("far", F.when(F.col("n") >= wanted, F.col("far")).otherwise(FAR))
        state = materialise(state.select("code", "q", "far", (F.col("far") <= covered).alias("ready")), "asked")
        ready = state.where("ready").select("q")
        done.append(materialise(ranked.join(ready, "q"), "done"))
        rest = materialise(ranked.join(ready, "q", "left_anti"), "best")
        discard(ranked, active, best)
        best, active = rest, state.where("not ready").select("code", "q", "far")
        active._scratch = state._scratch
        left = active.count()
        radii = [radii[-1] + 1] if radii[-1] < widest and left else []
    discard(entries, asked, index, hot)
    if not done:
        return members.select(F.col("q").alias("query_id"), F.lit(0).alias("rank"), F.col("q").alias("vec_id"), F.lit(0).alias("distance")).where("false")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    asker = members.select("q", F.when(~F.col("none"), F.col("id")).alias("query_id"))
    return found.join(asker, "q").select("query_id", F.col("rank").cast("int").alias("rank"), F.when(~F.col("none"), F.col("id")).alias("vec_id"), "distance")
