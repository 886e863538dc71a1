"""Text spotting: nearest lexicon words, end-to-end scores with regions that aren't cared for, submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import box as B
from ..functions import text as T
from ..sources.scratch import written
from . import matching, metrics, ranking

#: Characters that a word-spotting transcription has spaces for (fixed value).
SPECIAL_CHARACTERS = "'!?.:,*\"()·[]/"


#: Longest word that is found by its deletions, words of a block that longer or far ones are held against, and pieces of a key's far words.
LONGEST, BLOCK, PIECES = 40, 512, 32


def deletions(word: Column, most: int) -> Column:
    """The word and all that is left of it without up to ``most`` of its characters, each once. Two words within that edit distance have one of these in common."""
    if most == 0:
        return F.array(word)
    one = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.length(word))))
    one = F.array_distinct(F.array_prepend(one, word))
    return one if most == 1 else F.array_distinct(F.flatten(F.transform(one, lambda v: deletions(v, most - 1))))


def _least(pairs: DataFrame) -> DataFrame:
    """_key, _word, _best: of pairs with _upper, ord and shown the one of least distance, the first of several."""
    best = F.min(F.struct(F.levenshtein("_upper", "_word").alias("distance"), "ord", "shown"))
    return pairs.groupBy("_key", "_word").agg(best.alias("_best"))


def _within(words: DataFrame, lexicon: DataFrame, most: int) -> DataFrame:
    """``_least`` of words up to ``most`` edits from a lexicon word, found by equal deletions and verified."""
    probe = words.where(F.length("_word") <= LONGEST).select("_key", "_word", F.explode(deletions(F.col("_word"), most)).alias("_sign"))
    index = lexicon.where(F.length("_upper") <= LONGEST + most).select("_key", "_upper", "ord", "shown", F.explode(deletions(F.col("_upper"), most)).alias("_sign"))
    near = F.levenshtein("_upper", "_word", most)
    return _least(probe.join(index, ["_key", "_sign"]).where(near.between(0, most)))


def _far(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``_least`` of words that are near to nothing: each is held against its key's lexicon in blocks, a piece of the words at a time."""
    size = lexicon.groupBy("_key").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    dealt = lexicon.join(size, "_key").withColumn("_block", F.pmod(F.xxhash64("_upper"), "_blocks"))
    blocks = dealt.groupBy("_key", "_block").agg(F.collect_list(F.struct("_upper", "ord", "shown")).alias("_words")).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    pairs = words.withColumn("_piece", F.pmod(F.hash("_word"), F.lit(PIECES))).join(blocks, ["_key", "_piece"])
    best = F.array_min(F.transform("_words", lambda x: F.struct(F.levenshtein(x["_upper"], F.col("_word")).alias("distance"), x["ord"].alias("ord"), x["shown"].alias("shown"))))
    return pairs.select("_key", "_word", best.alias("_one")).groupBy("_key", "_word").agg(F.min("_one").alias("_best"))


def nearest_word(words: DataFrame, lexicon: DataFrame, key: str | None, word: str, keep_far: bool = True, cut: float = 2.5) -> DataFrame:
    """``words`` with match and distance: the lexicon word (lexicon: key if there is one, ord, word) of least edit distance, letters of either case alike, the first of several.

    Distinct words meet the lexicon by equal deletions: first one character each, then for those without a partner two; what is farther than that, or longer than LONGEST, is
    held against its key's lexicon in blocks. Null words and words of keys without a lexicon have null. keep_far: else a word ``cut`` or more away is null."""
    of = F.col(f"`{key}`") if key else F.lit(0)
    index = lexicon.where(F.col("word").isNotNull()).select(of.alias("_key"), F.upper("word").alias("_upper"), "ord", F.col("word").alias("shown"))
    index = written(index.groupBy("_key", "_upper").agg(F.min(F.struct("ord", "shown")).alias("s")).select("_key", "_upper", "s.*").where("_key IS NOT NULL"), "lexicon")
    rows = words.withColumns({"_key": of, "_word": F.upper(F.col(f"`{word}`"))})
    left = written(rows.select("_key", "_word").distinct().where("_key IS NOT NULL AND _word IS NOT NULL"), "words")
    found: list[DataFrame] = []
    for most in (1, 2):
        found.append(written(_within(left, index, most), "near"))
        left = left.join(found[-1], ["_key", "_word"], "left_anti")
    best = found[0].unionByName(found[1]).unionByName(_far(left, index))
    out = rows.join(best, ["_key", "_word"], "left")
    match = F.col("_best.shown") if keep_far else F.when(F.col("_best.distance") < cut, F.col("_best.shown"))
    return out.select(*[F.col(f"`{c}`") for c in words.columns if c not in ("match", "distance")], match.alias("match"), F.col("_best.distance").alias("distance"))


def recognition_by_lexicon(words: DataFrame, truth: str, guess: str, matches: dict[str, str]) -> DataFrame:
    """(lexicon, accuracy, edits): of the guess as it is and of each column of matches (lexicon name to column), letters of either case alike."""
    kinds = F.array(*[F.struct(F.lit(n).alias("lexicon"), F.lower(F.col(c)).alias("refined")) for n, c in {"none": guess, **matches}.items()])
    rows = words.select(F.lower(F.col(truth)).alias("_truth"), F.inline(kinds))
    return rows.groupBy("lexicon").agg(F.avg((F.col("refined") == F.col("_truth")).cast("int")).alias("accuracy"), F.sum(F.levenshtein("refined", "_truth")).cast("long").alias("edits"))


def spotting_word(text: Column) -> Column:
    """A truth as word spotting reads it: without a final 's and hyphens at its ends, special characters as spaces, stripped."""
    out = F.regexp_replace(F.regexp_replace(text, r"'[sS]\z", ""), r"^-+|-+\z", "")
    return F.regexp_replace(F.translate(out, SPECIAL_CHARACTERS, " " * len(SPECIAL_CHARACTERS)), r"^\s+|\s+\z", "")


def spotting_counts(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(image_id, gt_care, det_care, matched, correct) of every image on either side.

    gt: image_id, gi, text, box, care; pred: image_id, pi, text, box. A guess of which more than half lies in a region that isn't cared for counts nowhere. Others are
    matched in order, and are correct if the texts are equal, letters of either case alike."""
    off = gt.where(~F.col("care")).select("image_id", F.col("box").alias("region"))
    ignored = pred.join(off, "image_id").where(B.ioa(F.col("region"), F.col("box")) > threshold).select("image_id", "pi").distinct()
    truths, guesses = gt.where("care"), pred.join(ignored, ["image_id", "pi"], "left_anti")
    found = ranking.row_major(matching.iou_pairs(truths, guesses, threshold), threshold)
    texts = found.join(truths.select("image_id", "gi", F.col("text").alias("a")), ["image_id", "gi"]).join(guesses.select("image_id", "pi", F.col("text").alias("b")), ["image_id", "pi"])
    hits = texts.groupBy("image_id").agg(F.count("*").alias("matched"), F.count_if(F.upper("a") == F.upper("b")).alias("correct"))
    sides = gt.groupBy("image_id").agg(F.count_if("care").alias("gt_care")).join(guesses.groupBy("image_id").agg(F.count("*").alias("det_care")), "image_id", "full_outer")
    every = sides.join(pred.select("image_id").distinct(), "image_id", "full_outer").join(hits, "image_id", "left")
    return every.na.fill(0, ["gt_care", "det_care", "matched", "correct"])


def spotting_scores(counts: DataFrame, hits: str) -> DataFrame:
    """``counts`` with precision, recall and hmean of each image; without a truth to find recall is 1 and precision 1 or, if there are guesses, 0."""
    none, n, t, g = F.col("gt_care") == 0, F.col(hits), F.col("gt_care"), F.col("det_care")
    precision = F.when(none, F.when(g > 0, 0.0).otherwise(1.0)).otherwise(metrics.ratio(n, g))
    recall = F.when(none, F.lit(1.0)).otherwise(metrics.ratio(n, t))
    return counts.withColumn("precision", precision).withColumn("recall", recall).withColumn("hmean", metrics.f1(F.col("precision"), F.col("recall")))


def spotting_summary(counts: DataFrame) -> DataFrame:
    """(kind, precision, recall, hmean) over all images: end-to-end and detection only."""
    total = counts.agg(*[F.sum(c).alias(c) for c in ("gt_care", "det_care", "matched", "correct")])
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), metrics.ratio(F.col(c), F.col("det_care")).alias("precision"), metrics.ratio(F.col(c), F.col("gt_care")).alias("recall")) for k, c in (("end_to_end", "correct"), ("detection", "matched"))])
    return total.select(F.inline(kinds)).withColumn("hmean", metrics.f1(F.col("precision"), F.col("recall")))


def confidence_ap(hits: DataFrame, sample: str, score: str, order: str, positives: str) -> DataFrame:
    """(sample, ap): the precision at each hit (tp 1) in order of falling score, summed, over the sample's positives; 0 without any."""
    ranked = hits.groupBy(sample).agg(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(order).alias("o"), "tp"))).alias("r"), F.max(positives).alias("n"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("place"))

    def step(acc, x):
        hits_now = acc["hits"] + x["tp"].cast("long")
        return F.struct((acc["sum"] + F.when(x["tp"] == 1, hits_now / (acc["place"] + 1)).otherwise(0.0)).alias("sum"), hits_now.alias("hits"), (acc["place"] + 1).alias("place"))

    return ranked.select(sample, F.aggregate("r", start, step, lambda acc: metrics.ratio(acc["sum"], F.col("n"))).alias("ap"))


def submission(pred: DataFrame, points: str, text: str, score: str, least: float) -> DataFrame:
    """(image_id, content): a line x,y,...,####text for each detection of the least score or more, points clockwise and whole, text in ASCII, in order of pi; empty texts go.

    points: array of structs x, y."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    turned = F.when(B.clockwise(xs, ys), F.col(points)).otherwise(F.reverse(points))
    flat = F.array_join(F.transform(turned, lambda p: F.concat_ws(",", p["x"].cast("int").cast("string"), p["y"].cast("int").cast("string"))), ",")
    rows = pred.where(F.col(score) >= least).withColumn("_text", T.ascii_only(F.col(text))).where("_text <> ''").select("image_id", "pi", F.concat(flat, F.lit(",####"), "_text").alias("line"))
    return rows.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pi", "line"))), lambda x: x["line"]), "\n").alias("content"))
