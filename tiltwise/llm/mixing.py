"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks, in DataFrame functions only.

1. Targets: the mix has ``share`` times all words; sources get it by weight, none more than ``most`` times its own size.
2. Seats: the mix is cut into blocks of ``block`` words, and sources get blocks by the highest quotients
   target / (2 k + 1).  All but about two seats a source are certain beforehand, so only those quotients are ranked.
3. Shards: the documents of a source are dealt to shards by a hash of id and text, in proportion to its size; rows that are
   wholly equal are counted and spread over all shards of their source.  A source's seats go to its shards by the same method.
4. Blocks: the words of a shard, with documents in the order of a seeded hash, are cut into equal blocks.  The shard's quota
   takes every block a number of times; what is left over cuts the shard into as many stretches of blocks and takes a block
   of each, which a seeded hash chooses.  A document is taken by as many words as the blocks that are taken hold.

Only ids, sizes and hashes are shuffled, never texts.  No group is larger than a shard: about ``shard_words`` words, or one of
``shards`` parts of the corpus where that is more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

PRIME = (1 << 31) - 1


def div(a: Column, b: Column) -> Column:
    """Whole division of longs, never through doubles."""
    return F.call_function("div", a, b)


def words_in(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(*parts: Column | str) -> Column:
    """60 bits of the MD5 of the parts, as a non-negative long; any SQL engine can compute it."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """``source, source_size, n_docs, weight, target`` from ``source, size, copies``; one row for each source.

    Sources are ordered by code point, null last, and take the weights in turn.  Filling level: in the order of
    ``most * size / weight``, a source is capped as long as the level that the rest would get is not below its own.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("copies").alias("n_docs"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights)))
    sources = sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn))
    sources = sources.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("level", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    sources = sources.withColumn(
        "reached", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    )
    uncapped = F.when(F.col("level") > F.col("reached"), F.struct(F.col("rank"), F.col("reached")))
    sources = sources.withColumn("rank", F.row_number().over(rising)).withColumn("common", F.min(uncapped).over(everything)["reached"])
    target = F.least(F.col("cap"), F.coalesce(F.col("common") * F.col("weight"), F.col("cap")))
    return sources.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def seats(parties: DataFrame, within: list[str], name: list[str], votes: str, total: str) -> DataFrame:
    """Add the long column ``seats``: ``total`` seats go to the rows of each group ``within`` by Sainte-Lague.

    With q a row's exact share, its k-th seat comes at the multiplier (k - 1/2) / q.  As rounding moves the sum of n rows by
    n / 2 at most, seats below 1 - n / (2 total) are certain and those above 1 + n / (2 total) are out of reach; the
    few between are ranked.  Ties go to the first by ``name``.
    """
    group = Window.partitionBy(*within)
    exact = F.col(votes) * F.col(total) / F.when(F.sum(votes).over(group) > 0, F.sum(votes).over(group))
    spread = F.count("*").over(group) / (2.0 * F.greatest(F.col(total), F.lit(1))) + 1e-9
    parties = parties.withColumn("_q", F.coalesce(exact, F.lit(0.0))).withColumn("_spread", spread)
    parties = parties.withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_q") * (1 - F.col("_spread")) + 0.5)).cast("long"))
    parties = parties.withColumn("_most", F.greatest(F.col("_sure"), F.floor(F.col("_q") * (1 + F.col("_spread")) + 0.5).cast("long")))
    open_seats = F.col(total) - F.sum("_sure").over(group)
    parties = parties.withColumn("_open", open_seats)
    tried = parties.where("_most > _sure").select(*within, *[c for c in name if c not in within], "_q", "_sure", "_open", F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_k"))
    order = Window.partitionBy(*within).orderBy(((F.col("_k") - 0.5) / F.col("_q")), *[F.col(c).asc_nulls_last() for c in name], "_k")
    won = tried.withColumn("_rank", F.row_number().over(order)).where("_rank <= _open").groupBy(*within, *[c for c in name if c not in within]).agg(F.count("*").alias("_won"))
    keys = list(dict.fromkeys([*within, *name]))
    won = won.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "_won")
    joined = parties.join(won, [parties[k].eqNullSafe(won[f"_r_{k}"]) for k in keys], "left")
    return joined.withColumn("seats", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_q", "_spread", "_sure", "_most", "_open", "_won", *[f"_r_{k}" for k in keys])


def mix_documents(
    docs: DataFrame,
    weights: list[float],
    share: float = 1.5,
    most: int = 2,
    block: int = 32,
    shard_words: int = 16384,
    shards: int = 4096,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Return ``doc_id, size, source_size, target, taken, source, shard`` for every row of ``docs``.

    ``taken`` counts words with repeats, so a document whose blocks are all taken twice has twice its size; it is never
    more than ``most`` times the size, as a shard's quota stops at ``most`` passes over its blocks.  A null text has no
    words; a null source is a source of its own; rows that repeat are documents of their own.  An empty table gives no
    rows, and documents without a word are taken by 0 words.
    """
    text = F.col(f"`{text_col}`")
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), words_in(text).alias("size"), F.md5(F.coalesce(text, F.lit(""))).alias("digest"))
    # Equal rows are counted where they are read, so however often a row repeats it is no hot key.
    groups = materialise(picked.groupBy("doc_id", "source", "size", "digest").agg(F.count("*").alias("copies")), "sizes")
    sizes = groups.select("source", (F.col("size") * F.col("copies")).alias("size"), "copies")
    targets = source_targets(sizes, weights, share, most)
    everything = Window.partitionBy()
    targets = targets.withColumn("_all", F.round(F.sum("target").over(everything) / block).cast("long")).withColumn("_one", F.lit(1))
    per_shard = F.greatest(F.lit(float(shard_words)), F.ceil(F.sum(F.col("source_size") + F.col("n_docs")).over(everything) / shards))
    targets = targets.withColumn("n_shards", F.greatest(F.lit(1), F.ceil((F.col("source_size") + F.col("n_docs")) / per_shard)).cast("long"))
    # The sources' plan is small and read several times below.
    plan = materialise(seats(targets, ["_one"], ["source"], "target", "_all").drop("_one", "_all"), "plan")

    per_source = plan.select(F.col("source").alias("_source"), "source_size", "target", "n_shards", F.col("seats").alias("source_seats"))
    dealt = groups.join(per_source, groups["source"].eqNullSafe(per_source["_source"]), "left").drop("_source")
    dealt = dealt.withColumn("draw", hash_of(F.lit(seed), F.col("doc_id"), F.col("digest"))).withColumn("place", div(F.col("draw"), F.col("n_shards")))
    # The copies of a row go to different shards, as evenly as they can.
    dealt = dealt.withColumn("ways", F.least("copies", "n_shards")).withColumn("way", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1)))
    here = div(F.col("copies"), F.col("ways")) + F.when(F.col("way") < F.pmod("copies", "ways"), 1).otherwise(0)
    dealt = dealt.withColumn("copies", here).withColumn("shard", F.pmod(F.col("draw") + F.col("way"), F.col("n_shards"))).withColumn("words", F.col("size") * F.col("copies"))

    parts = dealt.groupBy("source", "shard", "source_seats").agg(F.sum("words").alias("shard_size"))
    parts = seats(parts, ["source", "source_seats"], ["source", "source_seats", "shard"], "shard_size", "source_seats")
    blocks = F.when(F.col("shard_size") > 0, F.greatest(F.lit(1), F.round(F.col("shard_size") / block))).otherwise(0).cast("long")
    parts = parts.withColumn("blocks", blocks).withColumn("quota", F.least(F.col("seats"), F.col("blocks") * most))
    parts = parts.withColumn("first", F.pmod(hash_of(F.lit(seed), F.col("source"), F.col("shard")), F.lit(PRIME)))
    parts = parts.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "blocks", "quota", "first")

    placed = Window.partitionBy("source", "shard").orderBy("place", F.col("doc_id").asc_nulls_last(), "size", "digest", "way")
    dealt = dealt.withColumn("before", F.sum("words").over(placed.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words"))
    dealt = dealt.join(parts, dealt["source"].eqNullSafe(parts["_source"]) & (dealt["shard"] == parts["_shard"])).drop("_source", "_shard")
    dealt = dealt.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("start", F.col("before") + F.col("copy") * F.col("size"))
    return dealt.select("doc_id", "size", "source_size", "target", _taken().alias("taken"), "source", "shard")


def drawn(first: Column, i: Column) -> Column:
    """A number below PRIME for stretch ``i`` of a shard: two rounds that are not linear, in products below 2 ** 63."""
    x = F.pmod(first + i * 1_103_515_245, F.lit(PRIME))
    x = F.pmod(x * (F.pmod(x, F.lit(65_521)) + 7_919), F.lit(PRIME))
    return F.pmod(x * (F.pmod(x, F.lit(65_519)) + 104_729), F.lit(PRIME))


def _taken() -> Column:
    """Words of the document in blocks of the mix; block j holds the words from ceil(j s / n) to ceil((j + 1) s / n)."""
    start, size, total, n = F.col("start"), F.col("size"), F.col("shard_size"), F.col("blocks")
    end = start + size
    over = F.pmod(F.col("quota"), n)

    def edge(j: Column) -> Column:
        return div(j * total + n - 1, n)

    def times(j: Column) -> Column:
        # Block j is in stretch i, the blocks from ceil(i n / over) on.
        i = div(j * over, n)
        low, high = div(i * n + over - 1, over), div((i + 1) * n + over - 1, over)
        chosen = low + F.pmod(drawn(F.col("first"), i), high - low)
        return div(F.col("quota"), n) + F.when((over > 0) & (chosen == j), 1).otherwise(0)

    def held(found: Column, j: Column) -> Column:
        return found + times(j) * F.greatest(F.lit(0).cast("long"), F.least(end, edge(j + 1)) - F.greatest(start, edge(j)))

    blocks = F.sequence(div(start * n, total), div((end - 1) * n, total))
    return F.when(size > 0, F.aggregate(blocks, F.lit(0).cast("long"), held)).otherwise(F.lit(0)).cast("long")
