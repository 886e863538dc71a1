"""Reward tables: histograms with named bins, step statistics, image bonuses, comparison of models, checks against expected values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import sampling

#: Half-open bins of a reward, with the two points 0 and 1 apart.
REWARD_BINS = ((0.0, 0.0001, "=0.00"), (0.0001, 0.25, "(0,0.25)"), (0.25, 0.5, "[0.25,0.5)"), (0.5, 0.75, "[0.5,0.75)"), (0.75, 0.9999, "[0.75,1)"), (0.9999, 1.01, "=1.00"))
#: Fields of a reward row that step statistics are taken of.
FIELDS = ("num_gt", "num_pred", "num_matched", "missed", "false_positive", "matched_mean", "final_reward", "final_reward_norm", "mean_iou")
#: Least mean square error of a peak signal-to-noise ratio, and the two constants of the structural similarity.
LEAST_ERROR, SSIM_1, SSIM_2 = 1e-10, 0.01**2, 0.03**2


def named_histogram(df: DataFrame, value: str, bins: tuple[tuple[float, float, str], ...] = REWARD_BINS) -> DataFrame:
    """(label, n) for every bin, empty ones too; a value counts in the first bin that holds it, others nowhere."""
    label = F.coalesce(*[F.when((F.col(value) >= low) & (F.col(value) < high), F.lit(name)) for low, high, name in bins])
    counts = df.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(name,) for _, _, name in bins], "label string")
    return every.join(counts, "label", "left").na.fill(0, ["n"])


def step_statistics(rows: DataFrame, step: str, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(step, field, mean, least, most, std) of each field, and the rates of matched, missed and false guesses per truth (least, most, std null). One aggregation over the rows."""
    per = lambda c: F.col(c) / F.greatest(F.col("num_gt"), F.lit(1))
    rates = {"match_rate": per("num_matched"), "missed_rate": per("missed"), "false_positive_rate": per("false_positive")}
    none = F.lit(None).cast("double")
    stats = [F.struct(F.lit(f).alias("field"), F.avg(f).alias("mean"), F.min(F.col(f).cast("double")).alias("least"), F.max(F.col(f).cast("double")).alias("most"), F.stddev_pop(f).alias("std")) for f in fields]
    stats += [F.struct(F.lit(n).alias("field"), F.avg(c).alias("mean"), none.alias("least"), none.alias("most"), none.alias("std")) for n, c in rates.items()]
    return rows.groupBy(step).agg(F.array(*stats).alias("s")).select(step, F.inline("s"))


def psnr(error: Column) -> Column:
    """Peak signal-to-noise ratio of a mean square error of values in [0, 1]."""
    return 10.0 * F.log10(1.0 / F.greatest(error, F.lit(LEAST_ERROR)))


def psnr_bonus(error: Column, weight: float, denominator: float = 40.0) -> Column:
    share = psnr(error) / max(denominator, 1e-6)
    return F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)) * weight


def image_similarity(pixels: DataFrame, image: str, x: str, y: str) -> DataFrame:
    """(image, psnr, ssim) from one row a pixel, values cut to [0, 1]: structural similarity by the moments of the whole image, within [-1, 1]."""
    cut = lambda c: F.greatest(F.least(F.col(c).cast("double"), F.lit(1.0)), F.lit(0.0))
    a, b = F.col("_a"), F.col("_b")
    own = pixels.select(image, cut(x).alias("_a"), cut(y).alias("_b")).groupBy(image)
    own = own.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.covar_pop(a, b).alias("ab"), F.avg((a - b) * (a - b)).alias("error"))
    ma, mb = F.col("ma"), F.col("mb")
    ssim = ((2 * ma * mb + SSIM_1) * (2 * F.col("ab") + SSIM_2)) / ((ma * ma + mb * mb + SSIM_1) * (F.col("va") + F.col("vb") + SSIM_2))
    return own.select(image, psnr(F.col("error")).alias("psnr"), F.greatest(F.least(ssim, F.lit(1.0)), F.lit(-1.0)).alias("ssim"))


def compare_models(rows: DataFrame, model: str, reward: str) -> DataFrame:
    """One row a model: count, mean, spread, median and range of the reward, and means of its components."""
    mean = lambda c, n: F.avg(c).alias(n)
    truths = F.greatest(F.col("num_gt"), F.lit(1))
    rows = written(rows.select(model, reward, "num_gt", "matched_mean", "missed", "false_positive"), "compared")
    own = rows.groupBy(model).agg(
        F.count("*").alias("n"), mean(reward, "reward_mean"), F.stddev_pop(reward).alias("reward_std"), F.min(reward).alias("reward_min"), F.max(reward).alias("reward_max"),
        mean("matched_mean", "matched_mean"), mean(F.col("missed") / truths, "missed_per_gt"), mean(F.col("false_positive") / truths, "false_positive_per_gt"),
    )
    return sampling.with_quantiles(own, rows, [model], reward, {"reward_median": 0.5})


def macro_means(rows: DataFrame, matched_mean: str, over_truth: str) -> DataFrame:
    """Mean over the images with a match, and over the images with a truth."""
    return rows.agg(F.avg(F.when(F.col("num_matched") > 0, F.col(matched_mean))).alias("matched_only"), F.avg(F.when(F.col("num_gt") > 0, F.col(over_truth))).alias("over_truth"))


def reward_table(rows: DataFrame, variant: str = "final_reward") -> DataFrame:
    """The wide table of one step: the reward that was used, the variant it came from, their difference, the image measures and all components."""
    columns = ["num_gt", "num_pred", "num_matched", "missed", "false_positive", "matched_mean", "final_reward", "final_reward_norm", "mean_iou"]
    base = F.col(variant)
    return rows.select("image_id", F.col("selected").alias("selected_reward"), base.alias("base_reward"), (F.col("selected") - base).alias("psnr_bonus"), "psnr", "ssim", *columns)


def verified(results: DataFrame, expected: DataFrame) -> DataFrame:
    """``expected`` (task, metric, expected, tolerance) with ok: the result (task, metric, value) is there, finite and within the tolerance."""
    value = F.col("value")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return expected.join(results, ["task", "metric"], "left").withColumn("ok", F.coalesce(finite & (F.abs(value - F.col("expected")) <= F.col("tolerance")), F.lit(False)))


def policy_statistics(df: DataFrame, clip_range: float, kl_weight: float, *by: str) -> DataFrame:
    """Masked means of a clipped policy step (columns new, old, reference_kl, advantage, mask): loss, divergences, share of clipped ratios, mean ratio. Undefined numbers count as 0."""
    clean = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    log_ratio = F.greatest(F.least(clean("new") - clean("old"), F.lit(20.0)), F.lit(-20.0))
    ratio, advantage, mask = F.exp(F.col("_log")), clean("advantage"), clean("mask")
    held = F.greatest(F.least(ratio, F.lit(1.0 + clip_range)), F.lit(1.0 - clip_range))
    total = lambda c: F.sum(c * mask) / F.greatest(F.sum(mask), F.lit(1.0))
    own = df.withColumn("_log", log_ratio).groupBy(*by).agg(
        (-total(F.least(ratio * advantage, held * advantage))).alias("policy_loss"), total(0.5 * F.col("_log") * F.col("_log")).alias("approx_kl"), total(clean("reference_kl")).alias("reference_kl"),
        total((F.abs(ratio - 1.0) > clip_range).cast("double")).alias("clip_share"), total(ratio).alias("ratio_mean"),
    )
    return own.withColumn("kl_loss", kl_weight * F.col("reference_kl")).withColumn("total_loss", F.col("policy_loss") + F.col("kl_loss"))
