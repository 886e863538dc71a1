"""Mixing sources to target weights by Sainte-Laguë apportionment. DataFrame operations only.

Blocks of equally many words are seats. Sources get seats by the highest quotients target / (2k - 1), then each source's seats go to its shards
in the same way by shard size, which gives every shard an integer quota; what a quota has beyond its shard's words goes on to the shards with the next
quotients. A shard lays its documents out in a seeded order and takes its first blocks. What a source's target has beyond its size is taken as whole
passes over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import fresh, materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that a shard has on average, in a table of up to MOST_SHARDS such shards; in a larger one shards grow, so that what is ranked stays bounded. A hot source
#: has as many shards as its share of the documents.
SHARD_DOCUMENTS, MOST_SHARDS = 2_000, 4_096
#: Seats shared out over the sources: so many at least, and so many for each shard. The words that a block has follow from it.
BLOCKS, SHARD_BLOCKS = 16_384, 32


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(parties: DataFrame, total: Column, weight: str, limit: str) -> DataFrame:
    """Adds ``target``: shares of ``total`` by weight that stop at ``limit``, the excess shared again by weight until none is above.

    parties: one row per party, a small table. With the parties in order of limit / weight, those before the first that its share doesn't reach are at
    their limits, and one level serves all others."""
    order = Window.orderBy(F.col(limit) / F.col(weight), "_n")
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = total - F.coalesce(F.sum(limit).over(before), F.lit(0))
    out = parties.withColumn("_n", F.monotonically_increasing_id()).withColumn("_level", rest / F.sum(weight).over(on))
    level = F.min(F.when(F.col("_level") < F.col(limit) / F.col(weight), F.struct(F.col(limit) / F.col(weight), "_n", "_level"))).over(Window.partitionBy())
    return out.withColumn("target", F.least(F.col(limit).cast("double"), F.coalesce(level["_level"] * F.col(weight), F.col(limit).cast("double")))).drop("_n", "_level")


def apportion(parties: DataFrame, within: list[str], vote: str, seats: str, key: list[str], slack: int | None) -> DataFrame:
    """Adds ``won``: seats by the highest quotients vote / (2k - 1) within each group; ties go to the smaller key.

    slack: a party's seats are looked for this far around its exact share; None: from none to all of the seats that its group has."""
    group = Window.partitionBy(*within)
    share = F.coalesce(F.try_divide(F.col(vote) * F.col(seats), F.sum(vote).over(group)), F.lit(0.0))
    low = F.lit(0) if slack is None else F.greatest(F.floor(share) - slack, F.lit(0))
    high = F.ceil(2 * share) + 2 if slack is None else F.ceil(share) + slack
    own = parties.withColumn("_low", low.cast("long")).withColumn("_high", high.cast("long"))
    own = own.withColumn("_left", F.col(seats) - F.sum("_low").over(group))
    bid = own.where(F.col(vote) > 0).select(*dict.fromkeys([*within, *key]), vote, "_left", F.explode(F.sequence(F.col("_low") + 1, F.greatest(F.col("_high"), F.col("_low") + 1))).alias("_k"))
    rank = F.row_number().over(group.orderBy(F.desc(F.col(vote) / (2 * F.col("_k") - 1)), *key, "_k"))
    names = list(dict.fromkeys([*within, *key]))
    won = bid.withColumn("_rank", rank).where("_rank <= _left").groupBy(*names).agg(F.count("*").alias("_won")).select(*[F.col(n).alias(f"_{n}") for n in names], "_won")
    match = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    return own.join(won, match, "left").withColumn("won", F.when(F.col(vote) > 0, F.col("_low") + F.coalesce("_won", F.lit(0))).otherwise(F.lit(0))).drop("_low", "_high", "_left", "_won", *[f"_{n}" for n in names])


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 42, blocks: int = BLOCKS, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    Size: words of the text (null: 0). Sources in code-point order, null last, take the weights in turn; ``share`` of all words
    is shared by weight, at most ``most`` times a source's words each. taken: words the mix takes of the document, repeats counted, ``most`` times its
    size at most. Repeated rows are documents of their own, told apart by nothing, so they stand side by side in the order. An empty table gives no rows; a
    corpus without words takes none."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), words_in(F.col(f"`{text_col}`").cast("string")).alias("size"))
    own = materialise(own.withColumn("place", F.xxhash64(F.col("doc_id"), F.lit(seed))), "sizes")
    sources = own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (turn % len(weights) + 1).cast("int"))).withColumn("limit", most * F.col("source_size"))
    everything = F.sum("source_size").over(Window.partitionBy())
    sources = water_fill(sources.withColumn("_all", share * everything), F.col("_all"), "weight", "limit")
    # Whole passes first; seats are for what is left of a target.
    passes = F.coalesce(F.floor(F.try_divide(F.col("target") + 1e-6, F.col("source_size"))), F.lit(0)).cast("long")
    sources = sources.withColumn("passes", passes).withColumn("part", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    per_shard = F.greatest(F.lit(shard_documents), F.ceil(F.sum("documents").over(Window.partitionBy()) / MOST_SHARDS))
    sources = sources.withColumn("shards", F.ceil(F.col("documents") / per_shard))
    block = F.greatest(F.ceil(F.sum("part").over(Window.partitionBy()) / F.greatest(F.lit(blocks), SHARD_BLOCKS * F.sum("shards").over(Window.partitionBy()))), F.lit(1)).cast("long")
    sources = sources.withColumn("block", block).withColumn("seats", F.round(F.sum("part").over(Window.partitionBy()) / F.col("block")).cast("long"))
    sources = apportion(sources.withColumn("_one", F.lit(1)), ["_one"], "part", "seats", ["source"], None).withColumnRenamed("won", "source_seats")
    sources = materialise(sources.select("source", "source_size", "target", "passes", "block", "source_seats", "shards"), "sources")
    here = sources.select(F.col("source").alias("_source"), *[c for c in sources.columns if c != "source"])
    own = own.join(here, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("shard", F.pmod(F.shiftright("place", 20), F.col("shards")))
    shards = own.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_seats").alias("source_seats"), F.first("block").alias("block"))
    shards = apportion(shards, ["source"], "shard_size", "source_seats", ["shard"], 2).withColumn("quota", F.least(F.col("won") * F.col("block"), F.col("shard_size")))
    # Words that a quota has beyond its shard go to the highest next quotients with room.
    whole, room = Window.partitionBy("source"), F.col("shard_size") - F.col("quota")
    before = F.coalesce(F.sum(room).over(whole.orderBy(F.desc(F.col("shard_size") / (2 * F.col("won") + 1)), "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = F.col("source_seats") * F.col("block") - F.sum("quota").over(whole)
    shards = shards.withColumn("more", F.greatest(F.least(over - before, room), F.lit(0)))
    shards = shards.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), (F.col("quota") + F.col("more")).alias("quota"))
    own = own.join(shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    order = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    part = F.greatest(F.least(F.col("quota") - F.coalesce(F.sum("size").over(order), F.lit(0)), F.col("size")), F.lit(0))
    taken = F.least(F.col("passes") * F.col("size") + F.when(F.col("passes") < most, part).otherwise(F.lit(0)), most * F.col("size"))
    return own.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **options: object) -> DataFrame:
    """The documents that the mix takes words of, once for each pass begun; columns as they were, whatever their names. Partly taken texts stay whole.

    Rows are found again by id: ids repeat only if their rows do, and rows without id are taken once each."""
    mixed_id, times, turn = fresh(docs, "mixed_id", "times", "turn")
    taken = mix(docs, text_col, id_col, source_col, **options).where("taken > 0 and doc_id is not null").groupBy("doc_id").agg(F.max(F.ceil(F.col("taken") / F.col("size"))).alias(times))
    taken = taken.select(F.col("doc_id").alias(mixed_id), times)
    own = docs.join(taken, F.col(f"`{id_col}`").cast("long") == F.col(mixed_id), "left")
    own = own.where(F.col(mixed_id).isNotNull() | F.col(f"`{id_col}`").isNull()).withColumn(turn, F.explode(F.sequence(F.lit(1), F.coalesce(times, F.lit(1)).cast("int"))))
    return own.select(*[F.col(f"`{c}`") for c in docs.columns])
