"""Near-duplicate classes by DartMinHash and banding.

A document is a weighted set: its five-word shingles with their numbers of occurrences.  Darts are thrown by hashing at
the plane of weight and rank: every unit cell of an element's weight region and every unit of rank holds Poisson(1) darts at
hashed places.  A dart falls on one of ``k`` coordinates, and of each coordinate the dart with the lowest rank stays.  Two
documents share it with probability equal to their weighted Jaccard similarity.  About k (ln k + 5) darts fill all
coordinates, whatever the size of the set.

Bands of ``rows`` coordinates are joined.  In each bucket, members are compared with one pivot rather than all with all;
links are verified on the whole sets, and connected components are taken.  Where members of a bucket are then in several
components, those outside of its largest one, its stragglers, are compared with all members of others, block by block.  Buckets in
which that is more than ``DENSE`` blocks (pages of one template, say) go through prefixes first: in the order of how rare elements
are in the bucket, two sets that are similar enough share one of the first fifth of their elements, so only members that share
such an element are compared.  Either way no link that shares a band is lost, no pairs are listed, and members that are
linked already are not compared with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, digest_of, discard, materialise, mix64, one_of_each
from .components import components

BANDS, ROWS, SHINGLE, SIMILARITY = 32, 5, 5, 0.8
BLOCK, DENSE, SPLIT = 256, 16, 4096
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def elements_of(text: str | None, words: dict, shingle: int = SHINGLE) -> np.ndarray:
    """The weighted set of a text as unit cells: a hash for each shingle and number of its occurrence.

    Words are what white space separates.  A text of fewer words than a shingle is one shingle; one without words is empty.
    """
    hashes = np.array([words[w] for w in (text or "").split()], dtype=U64)
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - shingle + 1)
    rolled = np.zeros(n, dtype=U64)
    for i in range(min(shingle, len(hashes))):
        rolled = rolled * U64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    rolled = np.sort(mix64(rolled))
    starts = np.flatnonzero(np.concatenate(([True], rolled[1:] != rolled[:-1])))
    nth = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    return mix64(rolled + nth.astype(U64) * U64(0xC2B2AE3D27D4EB4F))


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """A row of ``k`` lowest dart ranks for each set; the rank's bits tell which dart it is.  Sets may not be empty.

    Where a coordinate has no dart, twice as many are thrown: the first of them are the same, so what is filled stays.
    """
    darts = k * (math.log(k) + 5)
    best = throw(sets, k, darts)
    while len(bare := np.flatnonzero(np.isinf(best).any(axis=1))):
        darts *= 2
        best[bare] = throw([sets[i] for i in bare], k, darts)
    return best


def throw(sets: list[np.ndarray], k: int, darts: float) -> np.ndarray:
    sizes = np.array([len(s) for s in sets])
    units = np.ceil(darts / sizes).astype(np.int64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    cells = np.concatenate(sets)
    per_cell = units[doc]
    at = np.cumsum(per_cell) - per_cell
    rank = (np.arange(per_cell.sum()) - np.repeat(at, per_cell)).astype(U64)
    region = mix64(np.repeat(cells, per_cell) + rank * U64(0xA24BAED4963EE407))
    owner = np.repeat(doc, per_cell)
    hits = np.searchsorted(_POISSON, (region >> U64(11)).astype(float) * 2.0**-53, side="right")
    nth = (np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)).astype(U64)
    dart = mix64(np.repeat(region, hits) + (nth + U64(1)) * U64(0x9FB21C651E98DF25))
    coordinate = (dart % U64(k)).astype(np.int64)
    height = np.repeat(rank, hits).astype(float) + (mix64(dart) >> U64(11)).astype(float) * 2.0**-53
    best = np.full(len(sets) * k, np.inf)
    np.minimum.at(best, np.repeat(owner, hits) * k + coordinate, height)
    return best.reshape(len(sets), k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signature.view(U64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=U64), bits.shape[:2]).copy()
    for i in range(rows):
        key = mix64(key * U64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return key.view(np.int64)


def _block_links(rows: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """Links of the block's stragglers with its members in other components, one for each straggler and component.

    The members' cells are put in order once; a straggler's cells are looked up in all of them together.
    """
    members, stragglers = rows[~rows["straggler"]], rows[rows["straggler"]]
    if not len(members) or not len(stragglers):
        return []
    sets = [np.asarray(c, dtype=np.int64) for c in members["cells"]]
    sizes = np.array([len(c) for c in sets])
    cells, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(cells, kind="stable")
    cells, owner = cells[order], owner[order]
    nodes, roots = members["node"].to_numpy(), members["root"].to_numpy()
    out = []
    for node, root, own in zip(stragglers["node"], stragglers["root"], stragglers["cells"], strict=True):
        own = np.asarray(own, dtype=np.int64)
        low, size = np.searchsorted(cells, own, "left"), np.searchsorted(cells, own, "right")
        size = size - low
        low, size = low[size > 0], size[size > 0]
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((common >= (similarity - 1e-12) * (len(own) + sizes - common)) & (roots != root))
        _, first = np.unique(roots[near], return_index=True)
        out += [(max(node, n), min(node, n)) for n in nodes[near[first]].tolist()]
    return out


def _parts(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Of each bucket with several components: its largest one, its members and its stragglers."""
    parts = placed.groupBy(*keys, "root").agg(F.count("*").alias("n"))
    found = parts.groupBy(*keys).agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("s"), F.count("*").alias("parts"))
    return found.where("parts > 1").drop("parts")


def prefixes(dense: DataFrame, cells: DataFrame, similarity: float) -> DataFrame:
    """``key, cell, node, root``: of each member of a bucket (``key, node, root``) the elements that may link it with another.

    Elements are ordered by how many members of the bucket have them; the rarest ``1 - similarity`` of a set and one more
    are its prefix.  Two sets of that similarity have a common element in both prefixes, whatever the order.
    """
    parts = dense.join(cells.hint("merge"), "node").select("key", "node", "root", F.explode("cells").alias("cell"))
    parts = materialise(parts, "bucket_cells")
    held = materialise(parts.groupBy("key", "cell").agg(F.count("*").alias("held")).where("held > 1"), "held")
    ranked = parts.join(held.hint("merge"), ["key", "cell"], "left").groupBy("key", "node", "root").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("held", F.lit(1)).alias("held"), "cell"))).alias("all"))
    size = F.size("all") - F.ceil(F.size("all") * similarity - 1e-9).cast("int") + 1
    first = ranked.select("key", "node", "root", F.explode(F.slice("all", F.lit(1), size)).alias("e"))
    return first.where("e.held > 1").select("key", F.col("e.cell").alias("cell"), "node", "root")


def straggler_links(placed: DataFrame, cells: DataFrame, similarity: float, block: int = BLOCK, dense: int = DENSE, bin_cells: int = 1_000_000) -> DataFrame:
    """``a, b``: verified links between the components that meet in a bucket (``placed``: ``key, node, root``).

    In each bucket all members outside its largest component are compared with all members of other components.  Both are
    dealt to blocks of about ``block``; a pair of blocks is compared in one place and gives links only, so no pairs are
    listed and no bucket is gathered in one task.  Buckets of more than ``dense`` pairs of blocks are split by prefixes.  Pairs
    of blocks are dealt to groups of about ``bin_cells`` elements (or of one pair), so long texts take more groups.
    """
    buckets = materialise(_parts(placed, ["key"]), "buckets")
    crowded = F.col("n") * F.col("s") > block * block * dense
    own = placed.withColumn("cell", F.lit(0).cast("long")).join(buckets.where(~crowded).hint("merge"), "key")
    columns = ["key", "cell", "node", "root", "main", "n", "s"]
    own = own.select(*columns)
    if not (full := buckets.where(crowded)).isEmpty():
        split = materialise(prefixes(placed.join(full.select("key").hint("merge"), "key", "left_semi"), cells, similarity), "prefixes")
        own = own.unionByName(split.join(_parts(split, ["key", "cell"]).hint("merge"), ["key", "cell"]).select(*columns))
    n_blocks, s_blocks = F.ceil(F.col("n") / block).cast("int"), F.ceil(F.col("s") / block).cast("int")
    own = materialise(own.withColumn("n_blocks", n_blocks).withColumn("s_blocks", s_blocks).withColumn("draw", F.xxhash64("node")), "open")
    own = own.join(cells.hint("merge"), "node")
    sent = F.size("cells").cast("long") * (F.col("s_blocks") + F.when(F.col("root") != F.col("main"), F.col("n_blocks")).otherwise(0))
    bins = max(1, -(-(own.agg(F.sum(sent)).first()[0] or 0) // bin_cells))
    columns = ["key", "cell", "i", "j", "node", "root", "cells"]
    all_members = own.withColumn("i", F.pmod("draw", "n_blocks")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("s_blocks") - 1))).select(*columns, F.lit(False).alias("straggler"))
    outside = own.where("root <> main").withColumn("j", F.pmod("draw", "s_blocks")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(*columns, F.lit(True).alias("straggler"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        found: set[tuple[int, int]] = set()
        for _, one in rows.groupby(["key", "cell", "i", "j"], sort=False):
            found.update(_block_links(one, similarity))
        return pd.DataFrame(sorted(found), columns=["a", "b"])

    dealt = all_members.unionByName(outside).withColumn("bin", F.pmod(F.xxhash64("key", "cell", "i", "j"), F.lit(bins)))
    return dealt.groupBy("bin").applyInPandas(compare, "a long, b long").distinct()


def _classes(docs: DataFrame, similarity: float, shingle: int, bands: int, rows: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, digest`` of every row, and of every different text ``digest, rep, root, class_id, class_size``; both stored."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for b in batches:
            texts, start = list(b["text"]), 0
            while start < len(texts):
                sets, stop = [], start
                while stop < len(texts) and sum(map(len, sets)) < 80_000 and stop - start < 512:
                    sets.append(elements_of(texts[stop], words, shingle))
                    stop += 1
                keys: list = [[] for _ in sets]
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    for i, row in zip(full, band_keys(signatures([sets[i] for i in full], bands * rows), bands, rows), strict=True):
                        keys[i] = row
                yield pd.DataFrame({"id": b["id"].iloc[start:stop].to_numpy(), "none": b["none"].iloc[start:stop].to_numpy(), "digest": b["digest"].iloc[start:stop].to_numpy(), "keys": keys})
                start = stop

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("digest", digest_of(F.col("text")))
    # Null ids are flagged, as pandas would make the others floating-point numbers.
    flagged = picked.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "digest", "text")
    base = flagged.mapInPandas(first, "id long, none boolean, digest binary, keys array<long>")
    base = materialise(base.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "digest", "keys"), "signatures")
    # One node for each different text; its keys are those of the row with the smallest id (null only if no row has one).
    nodes = base.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialise(nodes, "nodes")
    marked = base.join(nodes, "digest").where(base["doc_id"].eqNullSafe(F.col("rep"))).select("node", "keys")
    entries = materialise(marked.select("node", F.explode("keys").alias("key")).distinct(), "entries")
    shared = entries.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).where("size > 1")
    # Pivots are compared with all others of their bucket, which are the ones that remain.
    members = materialise(entries.join(shared.hint("merge"), "key"), "members")
    discard(entries)
    rest = members.where("node <> pivot").select("key", "node", "pivot", "size")

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, done = WordHashes(), set()
        for b in batches:
            for n, t in zip(b["node"], b["text"], strict=True):
                if n not in done:  # rows that repeat as a whole
                    done.add(n)
                    yield pd.DataFrame({"node": [n], "cells": [elements_of(t, words, shingle).view(np.int64)]})

    # A text comes by the smallest id that has it, so that its copies are not gathered.
    wanted = members.select("node").distinct().join(nodes, "node").select("node", F.col("digest").alias("_digest"), "rep")
    texts = picked.join(wanted.hint("merge"), (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")
    cells = materialise(texts.mapInPandas(sets_of, "node long, cells array<long>"), "cells")

    # A pivot's set is sent once for each ``SPLIT`` members of its largest bucket, so no task gathers a large class.
    pairs = rest.groupBy(F.col("node").alias("a"), F.col("pivot").alias("b")).agg(F.max("size").alias("size"))
    pairs = materialise(pairs.withColumn("part", F.pmod(F.xxhash64("a"), F.ceil(F.col("size") / SPLIT))), "pairs")
    parts = pairs.groupBy("b").agg(F.max("size").alias("size")).select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / SPLIT) - 1)).alias("part"))
    one, two = cells.select(F.col("node").alias("a"), F.col("cells").alias("x")), cells.select(F.col("node").alias("b"), F.col("cells").alias("y"))
    two = parts.join(two.hint("merge"), "b")
    near = F.least(F.size("x"), F.size("y")) >= F.lit(similarity - 1e-12) * F.greatest(F.size("x"), F.size("y"))
    checked = pairs.select("a", "b", "part").join(one.hint("merge"), "a").join(two.hint("merge"), ["b", "part"]).where(near).withColumn("common", F.size(F.array_intersect("x", "y")))
    links = materialise(checked.where(F.col("common") >= F.lit(similarity - 1e-12) * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b"), "links")
    labels = components(links)
    placed = materialise(rest.join(labels.hint("merge"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "placed")
    more = materialise(straggler_links(placed, cells, similarity), "more_links")
    discard(placed, pairs, members, cells)
    if not more.isEmpty():
        discard(labels)
        labels = components(links.union(more))
    rooted = nodes.join(labels.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Classes are summed over different texts, and stored, so that the join with a large class can be split.
    rooted = materialise(rooted.select("digest", "root", "rep", "n"), "rooted")
    classes = materialise(rooted.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("n").alias("class_size")), "classes")
    named = materialise(rooted.join(classes.hint("merge"), "root").select("digest", "rep", "root", "class_id", "class_size"), "named")
    discard(links, more, labels, nodes, rooted, classes)
    return base.select("doc_id", "digest"), named


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Return ``doc_id, class_id, class_size``: one row for each row of ``docs``.

    ``class_id`` is the smallest id among the documents linked with it, directly or through others; links have a weighted
    Jaccard similarity of ``similarity`` or more, and equal texts are linked.  Texts without words (null, empty, blank)
    are linked only if they are equal, null counting as empty.  Null ids are kept and linked like others; the class of
    documents that all have none is null.  Rows that repeat are listed each, and different texts under one id are different
    documents.  Other columns are ignored; an empty table gives no rows.  A pair at 0.8 shares no band with probability
    (1 - 0.8 ** rows) ** bands: 3e-6 as set.
    """
    base, named = _classes(docs, similarity, shingle, bands, rows, id_col, text_col)
    return base.join(named.select("digest", "class_id", "class_size").hint("merge"), "digest").select("doc_id", "class_id", "class_size")


def keep_one(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Return one row of ``docs`` for each class of ``near_duplicates``, with all columns as they are.

    It is the row of the smallest id; a class without ids is kept by one of its rows.  The choice is by text, not by id, so
    copies under a null id or under the same id go, and a text that has a copy's id but is none stays.  Of rows with the kept
    text and id the first by a hash of the whole row stays.  An empty table stays empty.
    """
    _, named = _classes(docs, similarity, shingle, bands, rows, id_col, text_col)
    best = named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("rep"), F.col("digest").alias("digest"))).alias("kept"))
    kept = materialise(best.select(F.col("kept.digest").alias("_kept_digest"), F.col("kept.rep").alias("_kept_id")), "kept")
    discard(named)
    keyed = docs.withColumn("_digest", digest_of(F.col(f"`{text_col}`"))).withColumn("_id", F.col(f"`{id_col}`").cast("long"))
    first = one_of_each(keyed, ["_digest", "_id"])
    joined = first.join(kept.hint("merge"), (F.col("_digest") == F.col("_kept_digest")) & F.col("_id").eqNullSafe(F.col("_kept_id")), "left_semi")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
