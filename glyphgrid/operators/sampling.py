"""Deterministic selection, batching and repeat factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def place_in_order(df: DataFrame, order: list[str], parts: int = 256) -> DataFrame:
    """Adds place (from 0) and total: the row's place in the whole table by order, whose first column is a number (nulls first).

    Quantiles of that column cut it into ranges; the ranges' counts give each its start, and rows are numbered inside their range only."""
    lead = F.col(order[0]).cast("double")
    cuts = sorted(set(df.select(lead.alias("v")).approxQuantile("v", [k / parts for k in range(1, parts)], 0.25 / parts)))
    split = F.size(F.filter(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>"), lambda c: c <= lead))
    rows = df.withColumn("_part", F.when(lead.isNull(), -1).otherwise(split))
    n = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = n.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("total"))  # a row a range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.join(F.broadcast(starts), "_part").withColumn("place", own - 1 + F.col("_start")).drop("_part", "_start")


def running(df: DataFrame, group: list[str], order: list[str], value: str | None = None, falling: bool = False, parts: int = 256) -> DataFrame:
    """Adds rank (from 1) and, with a value, cum (its sum so far) of each row in its group by order, whose first column is a number and falls if ``falling``.

    Like ``place_in_order``, in each group: quantiles of the first column over the whole table cut every group into ranges, so that a large group is many tasks."""
    lead = F.col(order[0]).cast("double")
    cuts = sorted(set(df.select(lead.alias("v")).approxQuantile("v", [k / parts for k in range(1, parts)], 0.25 / parts)))
    split = F.size(F.filter(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>"), lambda c: c <= lead))
    part = F.when(lead.isNull(), -1).otherwise(split)
    rows = df.withColumn("_part", -part if falling else part)
    by = [F.desc(order[0]) if falling else F.asc(order[0]), *order[1:]]
    inside = Window.partitionBy(*group, "_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("rank", F.count("*").over(inside)).withColumn("cum", F.sum(value).over(inside) if value else F.lit(None))
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = rows.groupBy(*group, "_part").agg(F.max("rank").alias("_n"), F.sum(value).alias("_s") if value else F.lit(0).alias("_s"))
    names = {c: f"_at_{c}" for c in [*group, "_part"]}
    starts = totals.select(*[F.col(c).alias(n) for c, n in names.items()], F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_s0"))
    out = rows.join(starts, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    out = out.withColumn("rank", F.col("rank") + F.col("_n0")).withColumn("cum", F.col("cum") + F.col("_s0")).drop("_part", "_n0", "_s0", *names.values())
    return out if value else out.drop("cum")


def quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """group and a column for each of ``shares`` (name to a share from 0 to 1): the exact quantile of the group's values, between two of them in proportion; null values don't count.

    Rows are ranked by ranges of the value, so that neither a task nor a buffer holds a group; of each group the few rows at the wanted ranks are kept. Groups without a value have no row."""
    own = df.select(*[F.col(f"`{c}`") for c in group], F.col(f"`{value}`").cast("double").alias("_value")).where("_value IS NOT NULL")
    own = written(own.withColumn("_all", F.lit(0)), "values")
    key = [*group, "_all"]
    counts = own.groupBy(*key).agg((F.count("*") - 1).alias("_last")).select(*[F.col(f"`{c}`").alias(f"_of_{c}") for c in key], "_last")
    at = {n: F.col("_last") * F.lit(float(p)) for n, p in shares.items()}
    ranked = running(own, key, ["_value"]).withColumn("_place", F.col("rank") - 1).join(counts, [F.col(f"`{c}`").eqNullSafe(F.col(f"`_of_{c}`")) for c in key])
    wanted = ranked.where(F.col("_place").isin(*[f(h).cast("long") for h in at.values() for f in (F.floor, F.ceil)]))
    value_at = lambda place: F.max(F.when(F.col("_place") == place.cast("long"), F.col("_value")))
    ends = [(n, value_at(F.floor(h)).alias(f"_lo_{n}"), value_at(F.ceil(h)).alias(f"_hi_{n}")) for n, h in at.items()]
    out = wanted.groupBy(*key, "_last").agg(*[c for _, lo, hi in ends for c in (lo, hi)])
    share = lambda n: at[n] - F.floor(at[n])
    return out.select(*[F.col(f"`{c}`") for c in group], *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * share(n)).alias(n) for n in shares])


def with_quantiles(stats: DataFrame, df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``stats``, a row a group, with the group's ``quantiles``; null where it has no value."""
    own = quantiles(df, group, value, shares).select(*[F.col(f"`{c}`").alias(f"_q_{c}") for c in group], *shares, F.lit(0).alias("_q"))
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"`_q_{c}`")) for c in group] or [F.lit(0) == F.col("_q")]
    return stats.join(F.broadcast(own) if not group else own, same, "left").drop("_q", *[f"_q_{c}" for c in group])  # without groups there is one row


def contiguous_shards(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Adds shard (from 0): the first n mod shards ones hold one row more."""
    out = place_in_order(df, order)
    small, extra = F.expr(f"total div {shards}"), F.col("total") % shards
    ahead = extra * (small + 1)
    shard = F.when(F.col("place") < ahead, F.floor(F.col("place") / (small + 1))).otherwise(extra + F.floor((F.col("place") - ahead) / F.greatest(small, F.lit(1))))
    return out.withColumn("shard", shard.cast("long")).drop("place", "total")


def leading_share(df: DataFrame, order: list[str], over: int, under: int) -> DataFrame:
    """Adds train: whether the row is among the first int(n * over / under) by order."""
    out = place_in_order(df, order)
    return out.withColumn("train", F.col("place") < F.expr(f"total * {over} div {under}")).drop("place", "total")


def full_batches(df: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """Adds batch (from 0 in each group); rows of incomplete batches go."""
    w = Window.partitionBy(*group)
    out = df.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    return out.withColumn("batch", F.floor(F.col("_r") / size)).where((F.col("batch") + 1) * size <= F.col("_n")).drop("_r", "_n")


def round_robin(df: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Adds turn: the row's number in its source, by which sources alternate."""
    return running(df, [source], order).withColumnRenamed("rank", "turn")


def repeat_factors(df: DataFrame, image: str, category: str, threshold: float) -> DataFrame:
    """image, factor: the largest max(1, sqrt(threshold / share of images with the category)) of its categories."""
    pairs = df.select(image, category).distinct()
    total = pairs.select(image).distinct().agg(F.count("*").alias("total"))
    share = pairs.groupBy(category).agg(F.count("*").alias("images")).crossJoin(F.broadcast(total))  # one row
    factor = F.greatest(F.lit(1.0), F.sqrt(F.lit(threshold) / (F.col("images") / F.col("total"))))
    return pairs.join(share.select(category, factor.alias("factor")), category).groupBy(image).agg(F.max("factor").alias("factor"))


def rows_between(df: DataFrame, order: list[str], start: int, count: int) -> DataFrame:
    return place_in_order(df, order).where(F.col("place").between(start, start + count - 1)).drop("place", "total")


def rotated(index: Column, total: Column, offset: int) -> Column:
    return F.pmod(index - offset, total)


def stochastic_repeats(df: DataFrame, factor: str, key: str, seed: int = 0) -> DataFrame:
    """Rows repeated floor(factor) times and once more with the fraction as probability, by a seeded value of the key. Adds copy (from 1)."""
    chance = F.conv(F.substring(seeded(F.col(key), seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    extra = (chance < F.col(factor) - F.floor(factor)).cast("int")
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest((F.floor(factor) + extra).cast("int"), F.lit(1)))))


def subset(df: DataFrame, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """int(n * ratio) rows in the order of a seeded value."""
    return df.orderBy(seeded(F.col(key), seed), key).limit(int(df.count() * ratio))


def dataset_repeat_factors(df: DataFrame, source: str, image: str, category: str, weights: DataFrame, threshold: float) -> DataFrame:
    """source, image, factor: each source's own repeat factors times its weight (1 if weights, of source and weight, has none), over the least of all."""
    pairs = df.select(source, image, category).distinct()
    total = pairs.select(source, image).distinct().groupBy(source).agg(F.count("*").alias("total"))
    share = pairs.groupBy(source, category).agg(F.count("*").alias("images")).join(total, source)
    own = share.select(source, category, F.greatest(F.lit(1.0), F.sqrt(F.lit(threshold) / (F.col("images") / F.col("total")))).alias("factor"))
    best = pairs.join(own, [source, category]).groupBy(source, image).agg(F.max("factor").alias("factor")).join(weights, source, "left")
    best = best.select(source, image, (F.col("factor") * F.coalesce("weight", F.lit(1.0))).alias("factor"))
    return best.crossJoin(best.agg(F.min("factor").alias("least"))).select(source, image, (F.col("factor") / F.col("least")).alias("factor"))  # one row


def padded_groups(df: DataFrame, group: str, order: list[str], size: int, columns: list[str]) -> DataFrame:
    """group, batch, members: structs of the columns in order, so many a batch, the last batch filled up with nulls."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = df.withColumn("_r", F.row_number().over(w) - 1).withColumn("batch", F.floor(F.col("_r") / size))
    own = rows.groupBy(group, "batch").agg(F.sort_array(F.collect_list(F.struct("_r", F.struct(*columns).alias("v")))).alias("m"))
    m = F.transform("m", lambda x: x["v"])
    return own.select(group, "batch", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.get(m, k)).alias("members"))


def chosen_frames(df: DataFrame, group: str, order: str, count: int, how: str, seed: int = 0) -> DataFrame:
    """The first, last or (by a seeded value) random ``count`` rows of each group."""
    by = {"first": [F.asc(order)], "last": [F.desc(order)], "random": [seeded(F.col(order), seed), F.asc(order)]}[how]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*by))).where(F.col("_r") <= count).drop("_r")


def length_grouped(df: DataFrame, length: str, order: list[str], batch: int, world: int) -> DataFrame:
    """Adds megabatch, chunk, slot (all from 0): runs of batch x world rows by order, each dealt to ``world`` chunks of like length.

    A megabatch's rows, longest first, go to the chunk of least length so far that isn't full; an uneven last one is dealt in turn. For a shuffle, order by
    a seeded hash. A megabatch is one array of batch x world rows."""
    size = batch * world
    placed = place_in_order(df, order).withColumn("megabatch", F.expr(f"place div {size}")).drop("total")
    item = F.struct((-F.col(length)).cast("double").alias("neg"), "place", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    own = placed.groupBy("megabatch").agg(F.sort_array(F.collect_list(item)).alias("items"))
    share = F.expr(f"size(items) div {world}")
    zero = lambda v, kind: F.array_repeat(F.lit(v).cast(kind), world)

    def step(s: Column, x: Column) -> Column:
        k = F.array_position(s["load"], F.array_min(s["load"])).cast("int") - 1
        count = F.get(s["count"], k)
        load = F.transform(s["load"], lambda v, i: F.when(i != k, v).when(count + 1 == share, F.lit(float("inf"))).otherwise(v - x["neg"]))
        counts = F.transform(s["count"], lambda v, i: v + (i == k).cast("int"))
        return F.struct(load.alias("load"), counts.alias("count"), F.array_append(s["at"], F.struct(k.alias("chunk"), count.alias("slot"))).alias("at"))

    start = F.struct(zero(0.0, "double").alias("load"), zero(0, "int").alias("count"), F.array().cast("array<struct<chunk:int,slot:int>>").alias("at"))
    in_turn = F.transform("items", lambda _, i: F.struct((i % world).cast("int").alias("chunk"), F.floor(i / world).cast("int").alias("slot")))
    at = F.when(F.size("items") % world == 0, F.aggregate("items", start, step, lambda s: s["at"])).otherwise(in_turn)
    rows = own.select("megabatch", F.inline(F.arrays_zip(F.col("items"), at.alias("at"))))
    return rows.select("items.row.*", "megabatch", "at.chunk", "at.slot")


def modality_grouped(df: DataFrame, length: str, images: str, order: list[str], batch: int, world: int, seed: int) -> DataFrame:
    """``df`` with megabatch and slot (both from 0): ``length_grouped`` rows with images (a column that is true) and rows without apart, so that a megabatch is of one kind, and the
    megabatches of both kinds in one seeded order.

    What each kind has left, its last megabatch, goes into one more at the end, in order. A table of one kind keeps the order of its megabatches. Within a megabatch chunks follow one another."""
    kinds = [length_grouped(df.where(test), length, order, batch, world).withColumn("_kind", F.lit(k)) for k, test in enumerate((F.coalesce(F.col(images), F.lit(False)), ~F.coalesce(F.col(images), F.lit(False))))]
    rows = written(kinds[0].unionByName(kinds[1]).withColumn("slot", (F.col("chunk") * batch + F.col("slot")).cast("long")), "grouped")
    last = {r["_kind"]: r["last"] for r in rows.groupBy("_kind").agg(F.max("megabatch").alias("last")).collect()}  # two kinds
    if len(last) < 2:
        size = F.count("*").over(Window.partitionBy("megabatch"))  # rows of a megabatch
        short = F.row_number().over(Window.partitionBy("megabatch").orderBy("chunk", "slot")) - 1
        return rows.withColumn("slot", F.when(size == batch * world, F.col("slot")).otherwise(short).cast("long")).drop("chunk", "_kind")
    left = F.col("megabatch") == F.when(F.col("_kind") == 0, last[0]).otherwise(last[1])
    names = rows.where(~left).select("_kind", "megabatch").distinct().withColumn("_seed", seeded(F.concat_ws("-", "_kind", "megabatch"), seed))
    placed = place_in_order(names.withColumn("_lead", F.conv(F.substring("_seed", 1, 8), 16, 10).cast("long")), ["_lead", "_seed"]).select("_kind", "megabatch", F.col("place").alias("_place"))
    own = rows.where(~left).join(placed, ["_kind", "megabatch"]).withColumn("megabatch", F.col("_place")).drop("_place")
    rest = rows.where(left).withColumn("slot", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1).cast("long")).withColumn("megabatch", F.lit(last[0] + last[1]).cast("long"))  # two megabatches at most
    return own.withColumn("megabatch", F.col("megabatch").cast("long")).unionByName(rest).drop("chunk", "_kind")


def seeded(key: Column, seed: int) -> Column:
    """A seeded value to order by that other engines can work out too: MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def epoch_order(df: DataFrame, key: str, seed: int, epoch: int, rank: int, world: int) -> DataFrame:
    """The rows of one rank in one epoch of an endless shuffled stream, with step (from 0): every ``world``-th of the epoch's order, from ``rank`` on.

    The order is that of a seeded value; places come from range counts, not from one window over the table."""
    mixed = df.withColumn("_hash", seeded(F.col(key), seed + epoch)).withColumn("_lead", F.conv(F.substring("_hash", 1, 12), 16, 10).cast("double"))
    placed = place_in_order(mixed, ["_lead", "_hash", key])
    return placed.where(F.col("place") % world == rank).withColumn("step", F.expr(f"place div {world}")).drop("_hash", "_lead", "place", "total")


def source_batches(df: DataFrame, source: str, order: list[str], batch: int, world: int) -> DataFrame:
    """Adds rank, batch and slot: each source gives whole batches to every rank alike and drops the rest; a batch is of one source. batch is the source's own number."""
    w = Window.partitionBy(source)
    own = df.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.expr(f"(count(*) over (partition by `{source}`) div {batch * world}) * {batch * world}"))
    own = own.where(F.col("_r") < F.col("_n"))
    turn = F.expr(f"_r div {world}")
    return own.withColumn("rank", (F.col("_r") % world).cast("int")).withColumn("batch", F.floor(turn / batch)).withColumn("slot", (turn % batch).cast("int")).drop("_r", "_n")


def balanced_sample(df: DataFrame, group: str, label: str, key: str, count: int, positive_share: float, background: int, seed: int = 0) -> DataFrame:
    """Up to ``count`` rows of each group with a label of 0 or more: positives (not ``background``) up to their share of it, then negatives up to what is left, by a seeded order."""
    positive = F.col(label) != background
    rank = F.row_number().over(Window.partitionBy(group, positive).orderBy(seeded(F.col(key), seed), key))
    rows = df.where(F.col(label) >= 0).withColumn("_positive", positive).withColumn("_rank", rank).where(F.col("_rank") <= count)
    most = int(count * positive_share)
    taken = F.least(F.sum(F.col("_positive").cast("int")).over(Window.partitionBy(group)), F.lit(most))
    return rows.withColumn("_taken", taken).where(F.when(F.col("_positive"), F.col("_rank") <= F.col("_taken")).otherwise(F.col("_rank") <= count - F.col("_taken"))).drop("_positive", "_rank", "_taken")


def weighted_stream(df: DataFrame, source: str, order: list[str], ratios: dict[str, int]) -> DataFrame:
    """Rows of the sources by turns: in each turn so many of a source as its ratio says, up to the first turn that a source can't fill. Adds turn (from 0)."""
    ratio = F.element_at(F.create_map(*[F.lit(v) for pair in ratios.items() for v in pair]), F.col(source))
    own = df.where(F.col(source).isin(*ratios)).withColumn("_ratio", ratio).withColumn("turn", F.floor((F.row_number().over(Window.partitionBy(source).orderBy(*order)) - 1) / ratio))
    full = own.groupBy(source).agg(F.floor(F.count("*") / F.first("_ratio")).alias("n"))
    last = full.agg(F.when(F.count("*") == len(ratios), F.min("n")).otherwise(0).alias("_turns"))  # one row
    return own.join(F.broadcast(last), F.col("turn") < F.col("_turns")).drop("_ratio", "_turns")


def concatenated(tables: list[DataFrame], order: list[str]) -> DataFrame:
    """All rows with source (the table's number) and index: the row's place in its table after all rows of the tables before."""
    out, before = None, 0
    for k, df in enumerate(tables):
        placed = place_in_order(df, order)
        rows = placed.withColumn("source", F.lit(k)).withColumn("index", F.col("place") + before).drop("place", "total")
        before += df.count()
        out = rows if out is None else out.unionByName(rows)
    return out


def consistent(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One row for each value of ``by`` with the columns' common values; columns that differ within one raise."""
    own = df.groupBy(*by).agg(*[F.min(c).alias(c) for c in columns], *[(F.min(c).eqNullSafe(F.max(c)) & (F.count(c).isin(0) | (F.count(c) == F.count("*")))).alias(f"_same_{c}") for c in columns])
    for c in columns:
        own = own.withColumn(c, F.when(F.col(f"_same_{c}"), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is not the same everywhere")).cast(dict(own.dtypes)[c])))
    return own.select(*by, *columns)


def time_left(df: DataFrame, key: str, iteration: str, seconds: str, most: int, last: int = 1000) -> DataFrame:
    """(key, iteration, eta_seconds): the median time of the last iterations times what is left of ``most``."""
    latest = df.groupBy(key).agg(F.max(iteration).alias("_now"))
    own = df.join(latest, key).where(F.col(iteration) > F.col("_now") - last)
    return own.groupBy(key).agg(F.max(iteration).alias(iteration), (F.percentile(seconds, F.lit(0.5)) * (most - F.max(iteration) - 1)).alias("eta_seconds"))


def top_proposals(df: DataFrame, group: str, box: str, score: str, order: str, width: Column, height: Column, least_side: float, most: int) -> DataFrame:
    """The ``most`` proposals of best score of each group after cutting them to the image and leaving out those with a side of ``least_side`` or less; box is the cut one."""
    from ..functions.box import clip, non_empty

    rows = df.withColumn(box, clip(F.col(box), width, height)).where(non_empty(F.col(box), least_side))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def random_points(df: DataFrame, keys: list[str], box: str, count: int, seed: int = 0) -> DataFrame:
    """keys, point (from 0), x, y, inside (x and y in the box's left upper part of 3/4): points of a box by a seeded value, alike in every run."""
    share = lambda axis: F.conv(F.substring(seeded(F.concat_ws("/", *keys, "point", F.lit(axis)), seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    own = df.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    b = F.col(box)
    rows = own.select(*keys, "point", (b["x1"] + (b["x2"] - b["x1"]) * share("x")).alias("x"), (b["y1"] + (b["y2"] - b["y1"]) * share("y")).alias("y"), b.alias("_b"))
    return rows.withColumn("inside", (F.col("x") <= F.col("_b.x1") + 0.75 * (F.col("_b.x2") - F.col("_b.x1"))) & (F.col("y") <= F.col("_b.y1") + 0.75 * (F.col("_b.y2") - F.col("_b.y1")))).drop("_b")


def stuff_labels(categories: DataFrame, thing: str, category: str) -> DataFrame:
    """(category, label): 0 for things, from 1 on for stuff by category; pixels without a category have 255. A row a category."""
    stuff = categories.where(~F.col(thing)).select(category, F.row_number().over(Window.orderBy(category)).alias("label"))
    return categories.where(F.col(thing)).select(category, F.lit(0).alias("label")).unionByName(stuff)
