"""Curation of annotations: text validity, two-annotator merge, agreement, blur tags, crops, nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def invalid_text(text: Column, placeholders: tuple[str, ...], refusals: tuple[str, ...]) -> Column:
    """Missing, blank, a placeholder, quoted blank, or with a refusal phrase in any case."""
    t = F.coalesce(text, F.lit(""))
    refused = F.exists(F.array(*map(F.lit, refusals)), lambda p: F.contains(F.lower(t), F.lower(p))) if refusals else F.lit(False)
    return (F.trim(t) == "") | F.trim(t).isin(*placeholders) | t.rlike("^[\"']\\s*[\"']$") | refused


def merge_annotators(first: DataFrame, second: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """key, side1, side2: full outer on the key; of the second side's repeats the last by order stands."""
    last = second.groupBy(key).agg(F.max_by(text, order).alias("side2"))
    return first.select(key, F.col(text).alias("side1")).join(last, key, "full_outer")


def agreed_groups(merged: DataFrame, group: str) -> DataFrame:
    """Groups all of whose rows have equal text from both sides, null equal to null."""
    return merged.groupBy(group).agg(F.bool_and(F.col("side1").eqNullSafe(F.col("side2"))).alias("agreed")).where("agreed").select(group)


def tag(df: DataFrame, tags: DataFrame, key: str, tag_col: str, order: str, default: str) -> DataFrame:
    """Adds tag_col: the first tag of the key by order, or the default."""
    first = tags.groupBy(key).agg(F.min_by(tag_col, order).alias(tag_col))
    return df.join(first, key, "left").withColumn(tag_col, F.coalesce(tag_col, F.lit(default)))


def with_counts(images: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Images with their number of annotations, those without any dropped."""
    return images.join(annotations.groupBy(key).agg(F.count("*").alias("instances")), key)


def decremented(images: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """instances less the removed rows, never below zero; all images stay."""
    gone = removed.groupBy(key).agg(F.count("*").alias("_gone"))
    return images.join(gone, key, "left").withColumn("instances", F.greatest(F.col("instances") - F.coalesce("_gone", F.lit(0)), F.lit(0))).drop("_gone")


def sliding_windows(images: DataFrame, side: int, stride: int) -> DataFrame:
    """Adds x and y of every window of the side that fits width and height."""
    fits = images.where((F.col("width") >= side) & (F.col("height") >= side))
    ys = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("height") - side).cast("long"), F.lit(stride).cast("long")))
    return fits.withColumn("y", ys).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("width") - side).cast("long"), F.lit(stride).cast("long"))))


def diverse_top(crops: DataFrame, group: str, most: int, overlap: float) -> DataFrame:
    """Per group, crops by score (ties: lower id) that overlap none taken by more than ``overlap`` and share no instance; ``most`` at most.

    crops: group, crop_id, score, box, members (array)."""
    from ..functions.box import iou

    item = F.struct((-F.col("score")).alias("neg"), "crop_id", "box", "members")
    kind = f"array<struct<neg:double,crop_id:bigint,box:struct<x1:double,y1:double,x2:double,y2:double>,members:{dict(crops.dtypes)['members']}>>"
    clash = lambda acc, x: F.exists(acc, lambda k: (iou(k["box"], x["box"]) > overlap) | F.arrays_overlap(k["members"], x["members"]))
    fold = F.aggregate("items", F.array().cast(kind), lambda acc, x: F.when((F.size(acc) >= most) | clash(acc, x), acc).otherwise(F.array_append(acc, x)))
    taken = crops.groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("items")).select(group, F.posexplode(fold).alias("place", "k"))
    return taken.select(group, "place", F.col("k.crop_id").alias("crop_id"), (-F.col("k.neg")).alias("score"))


def patch_starts(size: Column, patch: int, stride: int) -> Column:
    """Starts of patches, the last one flush with the end."""
    last = F.greatest(size - patch, F.lit(0)).cast("long")
    return F.array_union(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long")), F.array(last))


def nested(annotations: DataFrame, group: str, key: str, value: str, order: str) -> DataFrame:
    """group, entries: map of key to value, the last by order of a repeated key."""
    last = annotations.groupBy(group, key).agg(F.max_by(value, order).alias("v"))
    return last.groupBy(group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "v")))).alias("entries"))


def remapped(df: DataFrame, column: str, mapping: DataFrame, source: str, target: str) -> DataFrame:
    """Category ids replaced through a mapping table; rows without one go."""
    return df.join(mapping.select(F.col(source).alias(column), F.col(target).alias("_to")), column).withColumn(column, F.col("_to")).drop("_to")


def latest(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def rolling_median(df: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """Adds median over the last ``size`` steps of order (a range, not a number of rows)."""
    w = Window.partitionBy(key).orderBy(order).rangeBetween(-(size - 1), 0)
    return df.withColumn("median", F.percentile(value, F.lit(0.5)).over(w))


def attached(images: DataFrame, annotations: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Images with annotations: an array of structs by order, empty for an image without any."""
    own = annotations.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias("annotations"))
    return images.join(own, key, "left").withColumn("annotations", F.coalesce("annotations", F.array()))


def tag_filter(images: DataFrame, annotations: DataFrame, key: str, tag_col: str, keep: str) -> tuple[DataFrame, DataFrame]:
    """Images of one tag that have an annotation, and the annotations of the images of that tag."""
    chosen = images.where(F.col(tag_col) == keep)
    notes = annotations.join(chosen.select(key).distinct(), key, "left_semi")
    return chosen.join(notes.select(key).distinct(), key, "left_semi"), notes


def cuts_no_box(region: Column, boxes: Column) -> Column:
    """Whether every box is inside the region or apart from it."""
    from ..functions.box import contains, overlaps

    return F.forall(boxes, lambda b: contains(region, b) | ~overlaps(region, b))


def nearest_same_text(left: DataFrame, right: DataFrame, group: str, left_key: str, right_key: str, least: float = 0.01) -> DataFrame:
    """group, left_key, right_key, closeness: the row of the same text whose corner is closest, 1 / (1 + dx + dy) above least; ties to the lower key.

    left and right: group, key, text, box."""
    a = left.select(group, left_key, "text", F.col("box").alias("a"))
    pairs = a.join(right.select(group, right_key, "text", F.col("box").alias("b")), [group, "text"])
    gap = F.abs(F.col("a.x1") - F.col("b.x1")) + F.abs(F.col("a.y1") - F.col("b.y1"))
    pairs = pairs.withColumn("closeness", 1 / (1 + gap)).where(F.col("closeness") > least)
    best = F.max_by(F.struct(right_key, "closeness"), F.struct("closeness", (-F.col(right_key)).alias("o")))
    return pairs.groupBy(group, left_key).agg(best.alias("b")).select(group, left_key, f"b.{right_key}", "b.closeness")


def crop_score(instances: Column, spread: Column) -> Column:
    return 0.7 * F.least(F.lit(1.0), instances / 10) + F.when(instances > 1, 0.3 * spread).otherwise(0.0)


def renumbered(annotations: DataFrame, categories: DataFrame, category: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Categories in use numbered from 1 by name, and the annotations with the new numbers; those of unknown categories go.

    categories: category, name. Several ids of one name become one."""
    used = annotations.select(category).distinct().join(categories, category)
    table = used.groupBy(name).agg(F.count("*").alias("merged")).withColumn("new_id", F.row_number().over(Window.orderBy(name)))  # a row a category
    ids = used.join(table, name).select(category, "new_id")
    return table.select("new_id", name, "merged"), annotations.join(ids, category).withColumn(category, F.col("new_id")).drop("new_id")
