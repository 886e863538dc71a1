"""Datasets of annotated images: category maps, merged categories, kept images, proposals, reference crops, segment quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rle


def mapped_categories(annotations: Column, mapping: dict[int, int]) -> Column:
    """The annotations (array of struct with category_id) whose category is mapped, with the new one; null for null."""
    if not mapping:
        return F.filter(annotations, lambda a: F.lit(False))
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])
    known = F.filter(annotations, lambda a: a["category_id"].isin(*mapping))
    return F.transform(known, lambda a: a.withField("category_id", F.element_at(table, a["category_id"].cast("int"))))


def merged_categories(categories: DataFrame) -> DataFrame:
    """dataset, id, name, mapped_id, mapped_name, mixed over categories: dataset (an ordinal), id, name, mapped_id (null: itself), listed (null or true: taken).

    A category mapped to one that its own dataset doesn't take is known by that id's digits. The name of a target is what the last dataset calls it, else
    the own dataset's name of it. mixed: the target joins categories of different names."""
    rows = categories.withColumn("mapped_id", F.coalesce("mapped_id", "id"))
    own = rows.select("dataset", F.col("id").alias("mapped_id"), F.col("name").alias("_own"), F.coalesce("listed", F.lit(True)).alias("_taken"))
    taken = rows.where(F.coalesce("listed", F.lit(True))).join(own, ["dataset", "mapped_id"], "left")
    called = F.when((F.col("mapped_id") == F.col("id")) | F.coalesce("_taken", F.lit(False)), F.col("name")).otherwise(F.col("mapped_id").cast("string"))
    names = taken.groupBy(F.col("id").alias("mapped_id")).agg(F.max_by(called, "dataset").alias("_called"))
    kinds = taken.groupBy("mapped_id").agg((F.count_distinct("name") > 1).alias("mixed"))
    out = taken.join(names, "mapped_id", "left").join(kinds, "mapped_id")
    return out.select("dataset", "id", "name", "mapped_id", F.coalesce("_called", "_own").alias("mapped_name"), "mixed")


def has_own_instance(annotations: Column) -> Column:
    """Not null, and an annotation that is no crowd (is_crowd null counts as none)."""
    return F.coalesce(F.exists(annotations, lambda a: F.coalesce(a["is_crowd"], F.lit(0)) == 0), F.lit(False))


def visible_keypoints(annotations: Column) -> Column:
    """Keypoints (x, y, visibility in turn) with visibility above zero."""
    seen = F.transform(annotations, lambda a: F.size(F.filter(F.coalesce(a["keypoints"], F.array()), lambda v, i: (i % 3 == 2) & (v > 0))))
    return F.aggregate(seen, F.lit(0), lambda acc, n: acc + n)


def has_field(annotations: Column, *fields: str) -> Column:
    """An annotation with all the fields."""

    def whole(a: Column) -> Column:
        ok = F.lit(True)
        for f in fields:
            ok = ok & a[f].isNotNull()
        return ok

    return F.exists(annotations, whole)


def keep_images(images: DataFrame, general: Column | None, specific: list[Column]) -> DataFrame:
    """Images that meet the general condition and one of the specific ones; a part that isn't given doesn't ask for anything."""
    out = images if general is None else images.where(general)
    either = None
    for s in specific:
        either = s if either is None else either | s
    return out if either is None else out.where(F.coalesce(either, F.lit(False)))


def combined(datasets: list[tuple[DataFrame, dict[int, int]]], general: Column | None, specific: list[Column]) -> DataFrame:
    """All datasets' images (column annotations) with mapped categories, then the kept ones of them."""
    out = None
    for df, mapping in datasets:
        own = df.withColumn("annotations", mapped_categories(F.col("annotations"), mapping))
        out = own if out is None else out.unionByName(own)
    return keep_images(out, general, specific)


def category_histogram(images: DataFrame, *by: str) -> DataFrame:
    return images.select(*by, F.explode("annotations").alias("a")).groupBy(*by, F.col("a.category_id").alias("category_id")).agg(F.count("*").alias("n"))


def with_proposals(images: DataFrame, proposals: DataFrame, key: str) -> DataFrame:
    """Adds proposals: an image's (score, box) from the highest score down; empty where it has none."""
    own = proposals.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("score", "box")), asc=False).alias("proposals"))
    return images.join(own, key, "left").withColumn("proposals", F.coalesce("proposals", F.array().cast(own.schema["proposals"].dataType)))


def crop_similarity(a: Column, b: Column, side: float = 50.0) -> Column:
    """0.7 x share of instances (text, x, y) of a with an equal text near in b, of the smaller crop, + 0.3 x their mean nearness; 0 where the sizes are far apart."""
    na, nb = F.size(a), F.size(b)
    small = F.least(na, nb)
    near = lambda p, q, k: F.greatest(1 - F.abs(p[k] - q[k]) / side, F.lit(0.0))
    best = F.transform(a, lambda p: F.array_max(F.transform(F.filter(b, lambda q: q["text"] == p["text"]), lambda q: (near(p, q, "x") + near(p, q, "y")) / 2)))
    good = F.filter(best, lambda v: v > 0.5)
    value = 0.7 * F.size(good) / small + 0.3 * F.aggregate(good, F.lit(0.0), lambda s, v: s + v) / F.size(good)
    return F.when((F.abs(na - nb) > F.greatest(F.lit(3), F.floor(small / 2))) | (F.size(good) == 0), 0.0).otherwise(value)


def reference_crops(crops: DataFrame, references: DataFrame, threshold: float = 0.5) -> DataFrame:
    """image_id, crop_id, ref_id, similarity: each crop's most similar reference crop of its image (ties: lower ref_id) above the threshold, else nulls.

    Both hold image_id, instances (array of text, x, y) and crop_id or ref_id: one shuffle by image."""
    pairs = crops.join(references.select("image_id", "ref_id", F.col("instances").alias("_ref")), "image_id")
    pairs = pairs.select("image_id", "crop_id", "ref_id", crop_similarity(F.col("instances"), F.col("_ref")).alias("similarity")).where(F.col("similarity") > threshold)
    best = pairs.groupBy("image_id", "crop_id").agg(F.max(F.struct("similarity", (-F.col("ref_id")).alias("o"))).alias("b"))
    best = best.select("image_id", "crop_id", (-F.col("b.o")).alias("ref_id"), F.col("b.similarity").alias("similarity"))
    return crops.select("image_id", "crop_id").join(best, ["image_id", "crop_id"], "left")


def segment_quality(gt: DataFrame, pred: DataFrame, pairs: DataFrame, things: list[int]) -> DataFrame:
    """part (all, things, stuff), pq, sq, rq in percent: means over the categories that have a segment.

    gt, pred: cat, a row a segment; pairs: cat, iou of matched segments (iou above 0.5, so each side has one at most)."""
    n = lambda df, name: df.groupBy("cat").agg(F.count("*").alias(name))
    hits = pairs.groupBy("cat").agg(F.count("*").alias("tp"), F.sum("iou").alias("iou"))
    rows = n(gt, "g").join(n(pred, "p"), "cat", "full_outer").join(hits, "cat", "left").na.fill(0)
    half = (F.col("g") + F.col("p")) / 2  # tp + fp / 2 + fn / 2
    sq = F.when(F.col("tp") > 0, F.col("iou") / F.col("tp")).otherwise(0.0)
    rows = rows.select(F.explode(F.array(F.lit("all"), F.when(F.col("cat").isin(*things), "things").otherwise("stuff"))).alias("part"), (F.col("iou") / half).alias("pq"), sq.alias("sq"), (F.col("tp") / half).alias("rq"))
    return rows.groupBy("part").agg(*[(100 * F.avg(c)).alias(c) for c in ("pq", "sq", "rq")])


def panoptic_matches(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """cat, kind (tp, fp, fn), iou: a row for each segment that counts.

    gt: image_id, seg, cat (null: void), crowd, spans; pred: image_id, seg, cat, spans (see ``rle.spans_of``); segments of a side don't overlap. Segments of one category with
    an IoU above 0.5 match, void places of the truth left out of it; a crowd matches nothing. A guess without a match counts unless over half of it lies in void or in crowds
    of its category. Segments of an image meet by their ends first, then by their places."""
    size = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda t, x: t + x["last"] - x["first"])
    side = lambda df, p: df.where(F.size("spans") > 0).select("image_id", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "image_id"], size(F.col("spans")).alias(f"{p}_size"))
    g, h = side(gt.select("image_id", "seg", "cat", "crowd", "spans"), "g"), side(pred.select("image_id", "seg", "cat", "spans"), "p")
    ends = lambda c: (F.get(F.col(c), 0)["first"], F.try_element_at(F.col(c), F.lit(-1))["last"])
    (g0, g1), (p0, p1) = ends("g_spans"), ends("p_spans")
    both = rle.overlap(F.col("g_spans"), F.col("p_spans"))["both"]
    pairs = g.join(h, "image_id").where((g0 < p1) & (p0 < g1)).select("image_id", "g_seg", "g_cat", "g_crowd", "g_size", "p_seg", "p_cat", "p_size", both.alias("both")).where("both > 0")
    same = F.coalesce(F.col("g_cat") == F.col("p_cat"), F.lit(False))
    void, crowd = F.col("g_cat").isNull(), same & F.coalesce("g_crowd", F.lit(False))
    met = F.collect_list(F.when(same & ~crowd, F.struct("g_seg", "g_size", "both")))
    own = pairs.groupBy("image_id", "p_seg", "p_cat", "p_size").agg(F.sum(F.when(void, F.col("both")).otherwise(0)).alias("void"), F.sum(F.when(crowd, F.col("both")).otherwise(0)).alias("crowd"), met.alias("met"))
    iou = lambda x: x["both"] / (F.col("p_size") + x["g_size"] - x["both"] - F.col("void"))
    hit = F.get(F.filter(F.transform("met", lambda x: F.struct(x["g_seg"].alias("g_seg"), iou(x).alias("iou"))), lambda x: x["iou"] > 0.5), 0)
    own = own.select("image_id", "p_seg", "void", "crowd", hit.alias("hit"))
    guesses = h.select("image_id", "p_seg", "p_cat", "p_size").join(own, ["image_id", "p_seg"], "left")
    share = (F.coalesce("void", F.lit(0)) + F.coalesce("crowd", F.lit(0))) / F.col("p_size")
    counted = guesses.where(F.col("hit").isNotNull() | (share <= 0.5)).select(F.col("p_cat").alias("cat"), F.when(F.col("hit").isNotNull(), "tp").otherwise("fp").alias("kind"), F.col("hit.iou").alias("iou"))
    found = own.where("hit IS NOT NULL").select("image_id", F.col("hit.g_seg").alias("g_seg"))
    missed = g.where("g_cat IS NOT NULL AND NOT coalesce(g_crowd, false)").join(found, ["image_id", "g_seg"], "left_anti").select(F.col("g_cat").alias("cat"), F.lit("fn").alias("kind"), F.lit(None).cast("double").alias("iou"))
    return counted.unionByName(missed)


def panoptic_quality(matches: DataFrame, things: list[int]) -> DataFrame:
    """part (all, things, stuff), pq, sq, rq in percent, categories: means over the categories of ``panoptic_matches``."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    rows = matches.groupBy("cat").agg(n("tp").alias("tp"), (n("tp") + (n("fp") + n("fn")) / 2).alias("half"), F.coalesce(F.sum("iou"), F.lit(0.0)).alias("iou"))
    sq = F.when(F.col("tp") > 0, F.col("iou") / F.col("tp")).otherwise(0.0)
    rows = rows.select(F.explode(F.array(F.lit("all"), F.when(F.col("cat").isin(*things), "things").otherwise("stuff"))).alias("part"), (F.col("iou") / F.col("half")).alias("pq"), sq.alias("sq"), (F.col("tp") / F.col("half")).alias("rq"))
    return rows.groupBy("part").agg(*[(100 * F.avg(c)).alias(c) for c in ("pq", "sq", "rq")], F.count("*").alias("categories"))
