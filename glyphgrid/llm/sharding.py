"""Sharding by vector bin packing over bytes, words and rows.

Items (groups of equal texts, or bundles of small groups) are placed one by one, the largest first, on the shard where the dot product of the
item with the shard's residual capacity is highest. What the driver places is bounded by parameters, whatever the corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise
from .mixing import words_in

#: A group above 1/LARGE of all bytes or rows is placed by itself, whole if a shard can take it, else in pieces no larger than that, so there are
#: at most 4 * LARGE items. All other groups fall by hash into COARSE bundles that hold 15/16 of them and FINE bundles that even things out.
LARGE, COARSE, FINE = 2_048, 2_048, 2_048
#: Weight of bytes, words and rows in the dot product: the law is that bytes are near equal.
WEIGHTS = (16.0, 1.0, 1.0)


def pack(items: np.ndarray, shards: int, fixed: np.ndarray | None = None) -> np.ndarray:
    """The shard of each row of ``items`` (one column a dimension, none negative): highest dot product with the residual capacity, ties to the lower shard.

    fixed: the shard of rows that are placed already, else -1."""
    total = items.sum(axis=0)
    unit = items / np.where(total > 0, total, 1) * shards
    left = np.ones((shards, items.shape[1]))
    weight = np.array(WEIGHTS[: items.shape[1]])
    place = np.full(len(items), -1, np.int64) if fixed is None else fixed.copy()
    np.subtract.at(left, place[place >= 0], unit[place >= 0])
    for k in np.lexsort((np.arange(len(items)), -unit.max(axis=1))):
        if place[k] < 0:
            place[k] = int(np.argmax(left @ (unit[k] * weight) if unit[k].any() else left.sum(axis=1)))
            left[place[k]] -= unit[k]
    return place


def place_whole(groups: np.ndarray, total: np.ndarray, shards: int) -> np.ndarray:
    """The shard that each group (bytes, words, rows) goes to whole, by the same product over those whose residual bytes and rows can take it; -1: none can."""
    unit = groups / np.where(total > 0, total, 1) * shards
    left = np.ones((shards, groups.shape[1]))
    place = np.full(len(groups), -1, np.int64)
    for k in np.lexsort((np.arange(len(groups)), -unit.max(axis=1))):
        room = (left[:, [0, 2]] >= unit[k, [0, 2]] - 1e-9).all(axis=1)
        if room.any():
            place[k] = int(np.argmax(np.where(room, left @ (unit[k] * np.array(WEIGHTS)), -np.inf)))
            left[place[k]] -= unit[k]
    return place


def shard(docs: DataFrame, shards: int = 8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, size (UTF-8 bytes and one), text_crc32, law ('bytes'), shard, slot, grown_shard (null), words.

    Shards have near equal bytes, words and rows; equal texts stay together unless no shard has the bytes or rows left to take their group. slot counts each
    shard's rows from 0 without gaps, bundle by bundle and by doc_id within. Null counts as the empty text; repeated rows are rows of their own; an
    empty table gives no rows."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), words_in(text).alias("words"), F.xxhash64(text).alias("group"))
    own = materialise(own.withColumn("rid", F.monotonically_increasing_id()), "sizes")
    sums = [F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count("*").alias("rows")]
    total = own.agg(*sums).first()
    large = own.groupBy("group").agg(*sums).withColumn("part", F.greatest(F.col("bytes") / max(1, total["bytes"] or 0), F.col("rows") / max(1, total["rows"])) * LARGE).where("part > 1")
    large = large.orderBy("group").collect()  # at most 2 * LARGE rows
    several = [r for r in large if r["rows"] > 1]  # placed first; single rows even things out after them
    whole = place_whole(np.array([[r["bytes"], r["words"], r["rows"]] for r in several], float).reshape(-1, 3), np.array([total["bytes"] or 0, total["words"] or 0, total["rows"]], float), shards)
    whole = {r["group"]: int(p) for r, p in zip(several, whole, strict=True) if p >= 0}
    pieces = [min(r["rows"], int(np.ceil(r["part"]))) for r in large]  # of a group placed whole all on its shard: no task numbers a large group by itself
    base = np.cumsum([0, *pieces]).tolist()
    fixed = {COARSE + FINE + b + k: whole[r["group"]] for r, n, b in zip(large, pieces, base, strict=False) if r["group"] in whole for k in range(n)}
    large = [(r["group"], n, b) for r, n, b in zip(large, pieces, base, strict=False)]
    spark = docs.sparkSession
    small = F.when(F.pmod("group", F.lit(16)) > 0, F.pmod(F.shiftright("group", 8), F.lit(COARSE))).otherwise(COARSE + F.pmod(F.shiftright("group", 8), F.lit(FINE)))
    if large:
        table = F.broadcast(spark.createDataFrame(large, "group long, pieces int, base long"))
        piece = COARSE + FINE + F.col("base") + F.pmod(F.xxhash64("doc_id", "rid"), F.col("pieces"))
        own = own.join(table, "group", "left").withColumn("bundle", F.when(F.col("pieces").isNotNull(), piece).otherwise(small))
    else:
        own = own.withColumn("bundle", small)
    bundles = own.groupBy("bundle").agg(*sums).orderBy("bundle").collect()  # bounded by the parameters above
    if not bundles:
        placed = spark.createDataFrame([], "bundle long, shard int, base_slot long")
    else:
        vector = np.array([[r["bytes"], r["words"], r["rows"]] for r in bundles], float)
        place, rows, filled = pack(vector, shards, np.array([fixed.get(r["bundle"], -1) for r in bundles])), vector[:, 2].astype(int), [0] * shards
        out = []
        for k, r in enumerate(bundles):
            s = int(place[k])
            out.append((r["bundle"], s, filled[s]))
            filled[s] += int(rows[k])
        placed = spark.createDataFrame(out, "bundle long, shard int, base_slot long")
    slot = F.col("base_slot") + F.row_number().over(Window.partitionBy("bundle").orderBy("doc_id", "rid")) - 1
    own = own.drop("base").withColumn("bundle", F.col("bundle").cast("long")).join(F.broadcast(placed), "bundle")
    return own.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "words")
