"""Joins of boxes within an image: candidate pairs, one-to-one assignment, suppression, arg-max matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import box as B


def iou_pairs(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """image_id, gi, pi, iou of all pairs with iou >= threshold: a hash join on the image with the overlap as its residual."""
    g, p = gt.select("image_id", "gi", F.col("box").alias("gbox")), pred.select("image_id", "pi", F.col("box").alias("pbox"))
    pairs = g.join(p, "image_id")
    if threshold > 0:
        pairs = pairs.where(B.overlaps(F.col("gbox"), F.col("pbox")))
    return pairs.withColumn("iou", B.iou(F.col("gbox"), F.col("pbox"))).where(F.col("iou") >= threshold).select("image_id", "gi", "pi", "iou")


def greedy_match(pairs: DataFrame) -> DataFrame:
    """Pairs taken from the highest (iou, gi, pi) down, each side once: a fold over each image's sorted pairs."""
    ordered = F.sort_array(F.collect_list(F.struct("iou", "gi", "pi")), asc=False)
    start = F.array().cast("array<struct<iou:double,gi:bigint,pi:bigint>>")
    fold = F.aggregate("pairs", start, lambda acc, x: F.when(F.exists(acc, lambda k: (k["gi"] == x["gi"]) | (k["pi"] == x["pi"])), acc).otherwise(F.array_append(acc, x)))
    return pairs.groupBy("image_id").agg(ordered.alias("pairs")).select("image_id", F.inline(fold)).select("image_id", "gi", "pi", "iou")


def image_matches(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """image_id, num_gt, num_pred, matches (array of iou, gi, pi, truth, guess) of every image on either side: ``greedy_match`` with the texts along.

    Each side is shuffled once, by image, and what is derived from a match needs neither again. An image's pairs are held in its row."""
    g = gt.groupBy("image_id").agg(F.collect_list(F.struct("gi", "text", "box")).alias("g"))
    p = pred.groupBy("image_id").agg(F.collect_list(F.struct("pi", "text", "box")).alias("p"))
    pair = lambda x, y: F.struct(B.iou(x["box"], y["box"]).alias("iou"), x["gi"].alias("gi"), y["pi"].alias("pi"), x["text"].alias("truth"), y["text"].alias("guess"))
    near = F.flatten(F.transform("g", lambda x: F.transform(F.filter("p", lambda y: B.overlaps(x["box"], y["box"])), lambda y: pair(x, y))))
    ordered = F.sort_array(F.filter(near, lambda k: k["iou"] >= threshold), asc=False)
    start = F.array().cast("array<struct<iou:double,gi:bigint,pi:bigint,truth:string,guess:string>>")
    fold = F.aggregate(ordered, start, lambda acc, x: F.when(F.exists(acc, lambda k: (k["gi"] == x["gi"]) | (k["pi"] == x["pi"])), acc).otherwise(F.array_append(acc, x)))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return g.join(p, "image_id", "full_outer").select("image_id", size("g").alias("num_gt"), size("p").alias("num_pred"), F.coalesce(fold, start).alias("matches"))


def match_scores(images: DataFrame) -> DataFrame:
    """``image_matches`` with num_matched and, over an image's matches, mean_iou, matched_mean (of the reward), mean_ned, 0 without any, and exact_matches."""
    from ..functions import text as T

    n = F.size("matches")
    mean = lambda f: F.coalesce(F.try_divide(F.aggregate("matches", F.lit(0.0), lambda s, m: s + f(m)), n), F.lit(0.0))
    scores = {"mean_iou": lambda m: m["iou"], "matched_mean": lambda m: T.pair_reward(m["truth"], m["guess"]), "mean_ned": lambda m: T.ned(m["truth"], m["guess"])}
    exact = F.size(F.filter("matches", lambda m: m["truth"] == m["guess"])).cast("long")
    return images.select("*", n.cast("long").alias("num_matched"), *[mean(f).alias(c) for c, f in scores.items()], exact.alias("exact_matches"))


def unmatched(side: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    return side.join(matches, ["image_id", key], "left_anti")


def suppress(boxes: DataFrame, threshold: float, group: list[str], score: str = "score", ordinal: str = "gi") -> DataFrame:
    """Rows kept from the highest score down (ties: lower ordinal) if none kept before overlaps them by more than threshold."""
    item = F.struct((-F.col(score)).alias("neg"), F.col(ordinal).alias("ord"), F.col("box"))
    kind = f"array<struct<neg:double,ord:bigint,box:struct<x1:double,y1:double,x2:double,y2:double>>>"
    fold = F.aggregate("items", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda k: B.iou(k["box"], x["box"]) > threshold), acc).otherwise(F.array_append(acc, x)))
    kept = boxes.groupBy(*group).agg(F.sort_array(F.collect_list(item)).alias("items")).select(*group, F.explode(fold).alias("k"))
    return kept.select(*group, F.col("k.ord").alias(ordinal), (-F.col("k.neg")).alias(score), F.col("k.box").alias("box"))


def overlap_flags(boxes: DataFrame, threshold: float) -> DataFrame:
    """image_id, gi, overlapping: whether another box of the image overlaps by more than threshold."""
    a, b = boxes.select("image_id", "gi", F.col("box").alias("a")), boxes.select("image_id", F.col("gi").alias("gj"), F.col("box").alias("b"))
    hit = a.join(b, "image_id").where((F.col("gi") != F.col("gj")) & (B.iou(F.col("a"), F.col("b")) > threshold)).select("image_id", "gi").distinct().withColumn("overlapping", F.lit(True))
    return boxes.select("image_id", "gi").join(hit, ["image_id", "gi"], "left").withColumn("overlapping", F.coalesce("overlapping", F.lit(False)))


def best_truth(pairs: DataFrame) -> DataFrame:
    """Each prediction's truth of the highest iou, ties to the lower gi."""
    w = Window.partitionBy("image_id", "pi").orderBy(F.desc("iou"), "gi")
    return pairs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def voc_hits(pred: DataFrame, best: DataFrame, threshold: float = 0.5) -> DataFrame:
    """image_id, pi, score, tp: the first prediction by score of each truth that it overlaps by more than threshold is a hit, later ones aren't."""
    own = pred.select("image_id", "pi", "score").join(best, ["image_id", "pi"], "left")
    w = Window.partitionBy("image_id", "gi").orderBy(F.desc("score"), "pi")
    good = F.coalesce(F.col("iou") > threshold, F.lit(False))
    ranked = own.withColumn("_good", good).withColumn("_r", F.row_number().over(Window.partitionBy("image_id", "gi", "_good").orderBy(F.desc("score"), "pi")))
    return ranked.select("image_id", "pi", "score", (F.col("_good") & (F.col("_r") == 1)).cast("long").alias("tp"))


def threshold_labels(iou: Column, low: float, high: float) -> Column:
    """0 below low, -1 between, 1 from high on."""
    return F.when(iou < low, 0).when(iou < high, -1).otherwise(1)


def frame_pairs(boxes: DataFrame, video: str, frame: str, threshold: float) -> DataFrame:
    """Greedy one-to-one pairs of each frame's boxes with those of the frame before it in the video: video, frame, before, now, iou. boxes: video, frame, gi, box."""
    earlier = boxes.select(F.col(video), (F.col(frame) + 1).alias(frame), F.col("gi").alias("before"), F.col("box").alias("_a"))
    pairs = boxes.select(video, frame, F.col("gi").alias("now"), F.col("box").alias("_b")).join(earlier, [video, frame]).where(B.overlaps(F.col("_a"), F.col("_b")))
    pairs = pairs.withColumn("iou", B.iou(F.col("_a"), F.col("_b"))).where(F.col("iou") >= threshold)
    keyed = pairs.select(F.struct(video, frame).alias("image_id"), F.col("before").alias("gi"), F.col("now").alias("pi"), "iou")
    return greedy_match(keyed).select(f"image_id.{video}", f"image_id.{frame}", F.col("gi").alias("before"), F.col("pi").alias("now"), "iou")
