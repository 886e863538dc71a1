"""Counts, rates, distributions, rewards and ranked metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import sampling


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def image_counts(gt: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """image_id, num_gt, num_pred, num_matched of every image on either side."""
    n = lambda df, name: df.groupBy("image_id").agg(F.count("*").alias(name))
    out = n(gt, "num_gt").join(n(pred, "num_pred"), "image_id", "full_outer").join(n(matches, "num_matched"), "image_id", "left")
    return out.na.fill(0, ["num_gt", "num_pred", "num_matched"])


def rates(counts: DataFrame, *by: str) -> DataFrame:
    """Micro precision, recall and F1, in all or by columns."""
    out = counts.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("num_gt", "num_pred", "num_matched")])
    out = out.withColumn("precision", ratio(F.col("num_matched"), F.col("num_pred"))).withColumn("recall", ratio(F.col("num_matched"), F.col("num_gt")))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def describe(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, population standard deviation, min, quartiles (interpolated), max."""
    own = written(df.select(*by, value), "described")
    out = own.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    out = sampling.with_quantiles(out, own, list(by), value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return out.select(*by, "n", "mean", "std", "lo", "p25", "p50", "p75", "hi")


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """bin, n over half-open bins, empty ones kept."""
    spark = df.sparkSession
    bin_ = F.lit(-1)
    for k in range(len(edges) - 1):
        bin_ = F.when((F.col(value) >= edges[k]) & (F.col(value) < edges[k + 1]), k).otherwise(bin_)
    counts = df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").na.fill(0, ["n"])


def compose_reward(counts: DataFrame, miss: float = 1.0, false_positive: float = 0.25) -> DataFrame:
    """Adds missed, false_positive, final_reward and final_reward_norm to counts with matched_mean."""
    out = counts.withColumn("missed", F.greatest(F.col("num_gt") - F.col("num_matched"), F.lit(0))).withColumn("false_positive", F.greatest(F.col("num_pred") - F.col("num_matched"), F.lit(0)))
    penalty = F.col("missed") * miss + F.col("false_positive") * false_positive
    return out.withColumn("final_reward", F.col("matched_mean") - penalty).withColumn("final_reward_norm", F.col("matched_mean") - penalty / F.greatest(F.col("num_gt"), F.lit(1)))


def count_bucket(n: Column) -> Column:
    return F.when(n <= 3, n.cast("string")).when(n <= 5, "4-5").when(n <= 10, "6-10").otherwise("11+")


def confusion(df: DataFrame, guess: str, truth: str) -> DataFrame:
    return df.groupBy(guess, truth).agg(F.count("*").alias("n"))


def class_scores(matrix: DataFrame, guess: str, truth: str) -> DataFrame:
    """cls, tp, pos_gt, pos_pred, iou, acc of every class that occurs."""
    gt = matrix.groupBy(F.col(truth).alias("cls")).agg(F.sum("n").alias("pos_gt"))
    pr = matrix.groupBy(F.col(guess).alias("cls")).agg(F.sum("n").alias("pos_pred"))
    tp = matrix.where(F.col(guess) == F.col(truth)).select(F.col(truth).alias("cls"), F.col("n").alias("tp"))
    out = gt.join(pr, "cls", "full_outer").join(tp, "cls", "left").na.fill(0, ["pos_gt", "pos_pred", "tp"])
    return out.withColumn("iou", ratio(F.col("tp"), F.col("pos_gt") + F.col("pos_pred") - F.col("tp"))).withColumn("acc", ratio(F.col("tp"), F.col("pos_gt")))


def polarity(df: DataFrame, guess: Column, truth: Column, *by: str) -> DataFrame:
    out = df.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in (("tp", guess & truth), ("fp", guess & ~truth), ("tn", ~guess & ~truth), ("fn", ~guess & truth))])
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return out.select("*", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), ratio(F.col("tp") + F.col("tn"), n).alias("accuracy"), ratio(F.col("tp") + F.col("fp"), n).alias("yes_ratio"))


def group_advantage(df: DataFrame, group: str, value: str, epsilon: float = 1e-4, limit: float | None = None) -> DataFrame:
    """Adds advantage: the clamped, centred value over the group's population deviation."""
    v = F.col(value) if limit is None else F.greatest(F.least(F.col(value), F.lit(limit)), F.lit(-limit))
    w = Window.partitionBy(group)
    return df.withColumn("advantage", (v - F.avg(v).over(w)) / (F.stddev_pop(v).over(w) + epsilon))


def ema_baseline(df: DataFrame, group: str, order: str, value: str, decay: float = 0.9) -> DataFrame:
    """group, baseline: the moving average after all values in order, from the first value on."""
    items = F.sort_array(F.collect_list(F.struct(order, value)))
    fold = F.aggregate("items", F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x[value]).otherwise(decay * acc + (1 - decay) * x[value]))
    return df.groupBy(group).agg(items.alias("items")).select(group, fold.alias("baseline"))


def detailed_histogram(df: DataFrame, value: str, bins: int, *by: str) -> DataFrame:
    """by, least, most, n, total, squares and counts of ``bins`` equal bins from the least to the most value, the last one closed."""
    range_ = df.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"), F.sum(value).alias("total"), F.sum(F.col(value) * F.col(value)).alias("squares"))
    joined = df.join(range_.select(*by, "least", "most"), list(by)) if by else df.crossJoin(F.broadcast(range_.select("least", "most")))  # one row
    place = F.least(F.floor((F.col(value) - F.col("least")) * bins / F.nullif(F.col("most") - F.col("least"), F.lit(0.0))), F.lit(bins - 1))
    counts = joined.where(F.col(value).isNotNull()).groupBy(*by, F.coalesce(place, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("c"))
    own = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"))  # a row a bin at most
    every = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)))
    out = range_.join(own, list(by)) if by else range_.crossJoin(F.broadcast(own))
    return out.withColumn("counts", every).drop("m")


def answer_accuracy(df: DataFrame, answer: str, truths: str) -> DataFrame:
    """Over all rows: the share whose answer is among its truths, and the mean of the best edit similarity to one of them, cut at 0.5."""
    from ..functions import text as T

    best = F.array_max(F.transform(truths, lambda t: T.anls(t, F.col(answer))))
    return df.agg(F.avg(F.array_contains(truths, F.col(answer)).cast("int")).alias("accuracy"), F.avg(best).alias("anls"))


def ensemble_accuracy(df: DataFrame, truth: str, own: str, other: str) -> DataFrame:
    """Accuracy of another model's answers, ours where it gave none; of either being right; and the share it gave none to."""
    used = F.coalesce(other, own)
    right = lambda c: F.coalesce(c == F.col(truth), F.lit(False)).cast("int")
    return df.agg(F.count("*").alias("total"), F.avg(right(used)).alias("accuracy"), F.avg(F.greatest(right(used), right(F.col(own)))).alias("upper_bound"), F.avg(F.col(other).isNull().cast("int")).alias("no_answer"))


def tag_scores(guesses: DataFrame, truths: DataFrame, tags: DataFrame, item: str, tag: str, epsilon: float = 1e-9) -> DataFrame:
    """(tag, precision, recall) of every tag of the list; a tag that was never guessed or never true has 0. Macro means are averages of its columns."""
    g = guesses.select(item, tag).distinct().withColumn("_g", F.lit(1))
    t = truths.select(item, tag).distinct().withColumn("_t", F.lit(1))
    counts = g.join(t, [item, tag], "full_outer").groupBy(tag).agg(F.sum(F.col("_g") * F.col("_t")).alias("both"), F.sum("_g").alias("g"), F.sum("_t").alias("t"))
    own = tags.select(tag).distinct().join(counts, tag, "left").na.fill(0, ["both", "g", "t"])
    return own.select(tag, (F.col("both") / (F.col("g") + epsilon)).alias("precision"), (F.col("both") / (F.col("t") + epsilon)).alias("recall"))


def bleu(df: DataFrame, guess: str, truths: str, most: int = 4) -> DataFrame:
    """Corpus BLEU of word arrays against arrays of word arrays: bleu, and the brevity penalty. Counts of one row's runs of words are summed as the rows are read."""
    from ..functions import text as T

    def matched(n: int) -> Column:
        own = T.ngrams(F.col(guess), n)
        count = lambda words, x: F.size(F.filter(words, lambda y: y == x))
        return F.aggregate(F.array_distinct(own), F.lit(0), lambda acc, x: acc + F.least(count(own, x), F.array_max(F.transform(truths, lambda t: count(T.ngrams(t, n), x)))))

    size = F.size(guess)
    nearest = F.array_min(F.transform(truths, lambda t: F.struct(F.abs(F.size(t) - size).alias("gap"), F.size(t).alias("size"))))["size"]
    sums = [F.sum(matched(n)).alias(f"m{n}") for n in range(1, most + 1)] + [F.sum(F.greatest(size - n + 1, F.lit(0))).alias(f"t{n}") for n in range(1, most + 1)]
    total = df.agg(*sums, F.sum(size).alias("guessed"), F.sum(nearest).alias("wanted"))
    logs = [F.log(F.col(f"m{n}") / F.col(f"t{n}")) for n in range(1, most + 1)]
    brevity = F.when(F.col("guessed") >= F.col("wanted"), 1.0).otherwise(F.exp(1 - F.col("wanted") / F.col("guessed")))
    geometric = F.when(F.least(*[F.col(f"m{n}") for n in range(1, most + 1)]) > 0, F.exp(sum(logs[1:], logs[0]) / most)).otherwise(0.0)
    return total.select((brevity * geometric).alias("bleu"), brevity.alias("brevity"))
