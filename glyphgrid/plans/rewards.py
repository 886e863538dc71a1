"""Queries of reward analytics over the matched views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import matching, metrics, rewards
from .detection import _COUNTS, _MATCH, _REWARD_ROWS, _REWARDED, _W, _images, _rewarded
from .registered import registrar
from .views import SQL, lines, table

QUERIES, ORACLE, query = registrar()

_FIN = f"{_W}, {_MATCH}, {_REWARDED}, {_COUNTS}, {_REWARD_ROWS}, iou AS (SELECT image_id, avg(iou) AS mean_iou FROM m GROUP BY 1), rows AS (SELECT fin.*, coalesce(iou.mean_iou, 0.0) AS mean_iou FROM fin LEFT JOIN iou USING (image_id))"


def _rows(spark, d):
    """The composed rewards with the mean overlap of each image's matches."""
    rows = matching.match_scores(_images(spark, d)).withColumn("matched_mean", F.round("matched_mean", 9))
    return metrics.compose_reward(rows.drop("matches", "mean_ned", "exact_matches"))


def _rounded(df, places, *keep):
    return df.select(*[F.col(c) if c in keep else (F.round(c, places) + F.lit(0.0)).alias(c) for c in df.columns])  # no negative zero


_BINS = ", ".join(f"({low}, {high}, '{name}')" for low, high, name in rewards.REWARD_BINS)


@query(f"{_W}, {_MATCH}, {_REWARDED} SELECT label, count(reward) AS n FROM (VALUES {_BINS}) b(lo, hi, label) LEFT JOIN rew ON reward >= lo AND reward < hi GROUP BY 1")
def a8_reward_histogram(spark, d):
    return rewards.named_histogram(_rewarded(spark, d), "reward")


@query(f"""{_FIN} SELECT CASE WHEN image_id % 2 = 0 THEN 'first' ELSE 'second' END AS model, count(*) AS n, round(avg(final_reward), 7) AS reward_mean, round(stddev_pop(final_reward), 7) AS reward_std, round(median(final_reward), 7) AS reward_median, round(min(final_reward), 7) AS reward_min, round(max(final_reward), 7) AS reward_max,
 round(avg(matched_mean), 7) AS matched_mean, round(avg(missed / greatest(num_gt, 1)), 7) AS missed_per_gt, round(avg(false_positive / greatest(num_gt, 1)), 7) AS false_positive_per_gt FROM rows GROUP BY 1""")
def a13_model_comparison(spark, d):
    rows = _rows(spark, d).withColumn("model", F.when(F.col("image_id") % 2 == 0, "first").otherwise("second"))
    return _rounded(rewards.compare_models(rows, "model", "final_reward"), 7, "model", "n")


_STATS = " UNION ALL ".join(
    [f"SELECT image_id % 20 AS step, '{f}' AS field, avg({f}) AS mean, min({f})::DOUBLE AS least, max({f})::DOUBLE AS most, stddev_pop({f}) AS std FROM rows GROUP BY 1" for f in rewards.FIELDS]
    + [f"SELECT image_id % 20, '{n}', avg({c} / greatest(num_gt, 1)), NULL, NULL, NULL FROM rows GROUP BY 1" for n, c in (("match_rate", "num_matched"), ("missed_rate", "missed"), ("false_positive_rate", "false_positive"))]
)


@query(f"{_FIN}, s AS ({_STATS}) SELECT step, field, round(mean, 7) AS mean, round(least, 7) AS least, round(most, 7) AS most, round(std, 7) AS std FROM s")
def a14_step_statistics(spark, d):
    rows = _rows(spark, d).withColumn("step", F.col("image_id") % 20)
    return _rounded(rewards.step_statistics(rows, "step"), 7, "step", "field")


@query("SELECT l_orderkey AS image_id, l_linenumber AS line, round(10 * log10(1 / greatest(l_discount * l_discount / 4, 1e-10)), 7) AS psnr, round(greatest(least(10 * log10(1 / greatest(l_discount * l_discount / 4, 1e-10)) / 40, 1), 0) * 0.3, 7) AS bonus FROM (SELECT l_orderkey, l_linenumber, l_discount::DOUBLE AS l_discount FROM lineitem)")
def a18_psnr_bonus(spark, d):
    error = F.col("l_discount").cast("double") * F.col("l_discount").cast("double") / 4
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("line"), F.round(rewards.psnr(error), 7).alias("psnr"), F.round(rewards.psnr_bonus(error, 0.3), 7).alias("bonus"))


@query(f"{_FIN}, o AS (SELECT rows.*, coalesce(s.t, 0.0) / greatest(num_gt, 1) AS over FROM rows LEFT JOIN (SELECT image_id, sum(reward) AS t FROM rew GROUP BY 1) s USING (image_id)) SELECT round(avg(matched_mean) FILTER (num_matched > 0), 7) AS matched_only, round(avg(over) FILTER (num_gt > 0), 7) AS over_truth FROM o")
def a19_macro_means(spark, d):
    rows = matching.match_scores(_images(spark, d)).withColumn("matched_mean", F.round("matched_mean", 9))
    total = F.aggregate("matches", F.lit(0.0), lambda s, m: s + T.pair_reward(m["truth"], m["guess"]))
    rows = rows.withColumn("over", total / F.greatest(F.col("num_gt"), F.lit(1)))
    return _rounded(rewards.macro_means(rows, "matched_mean", "over"), 7)


_PIXELS = "px AS (SELECT l_orderkey AS image_id, greatest(least(l_quantity::DOUBLE / 40, 1.0), 0.0) AS a, greatest(least(l_quantity::DOUBLE / 40 + l_discount::DOUBLE - 0.05, 1.0), 0.0) AS b FROM lineitem)"
_SIMILAR = f"{_PIXELS}, mo AS (SELECT image_id, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS ab, avg((a - b) * (a - b)) AS e FROM px GROUP BY 1), sim AS (SELECT image_id, 10 * log10(1 / greatest(e, 1e-10)) AS psnr, greatest(least((2 * ma * mb + 0.0001) * (2 * ab + 0.0009) / ((ma * ma + mb * mb + 0.0001) * (va + vb + 0.0009)), 1), -1) AS ssim FROM mo)"


def _similar(spark, d):
    x = F.col("l_quantity").cast("double") / 40
    pixels = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), x.alias("a"), (x + F.col("l_discount").cast("double") - 0.05).alias("b"))
    return rewards.image_similarity(pixels, "image_id", "a", "b")


@query(f"WITH {_SIMILAR} SELECT image_id, round(psnr, 6) AS psnr, round(ssim, 6) AS ssim FROM sim")
def a55_image_similarity(spark, d):
    return _rounded(_similar(spark, d), 6, "image_id")


@query(f"{_FIN}, {_SIMILAR} SELECT image_id, round(final_reward + greatest(least(psnr / 40, 1), 0) * 0.2, 6) + 0.0 AS selected_reward, round(final_reward, 6) + 0.0 AS base_reward, round(greatest(least(psnr / 40, 1), 0) * 0.2, 6) AS psnr_bonus, round(psnr, 6) AS psnr, round(ssim, 6) AS ssim, num_gt, num_pred, num_matched, missed, false_positive, round(matched_mean, 6) AS matched_mean, round(final_reward, 6) + 0.0 AS final_reward, round(final_reward_norm, 6) + 0.0 AS final_reward_norm, round(mean_iou, 6) AS mean_iou FROM rows JOIN sim USING (image_id)")
def p14_reward_table(spark, d):
    rows = _rows(spark, d).join(_similar(spark, d), "image_id")
    rows = rows.withColumn("selected", F.col("final_reward") + F.greatest(F.least(F.col("psnr") / 40, F.lit(1)), F.lit(0)) * 0.2)
    return _rounded(rewards.reward_table(rows), 6, "image_id", "num_gt", "num_pred", "num_matched", "missed", "false_positive")


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey", "l_orderkey"]


@query(f"SELECT {', '.join(f'round(avg({c}::DOUBLE), 4) AS {c[2:]}' for c in _MEASURES)} FROM lineitem")
def a51_measure_means(spark, d):
    return table(spark, d, "lineitem").agg(*[F.round(F.avg(F.col(c).cast("double")), 4).alias(c[2:]) for c in _MEASURES])


@query(f"""WITH r AS (SELECT l_returnflag AS task, 'quantity' AS metric, avg(l_quantity::DOUBLE) AS value FROM lineitem GROUP BY 1),
e(task, metric, expected, tolerance) AS (VALUES ('A', 'quantity', 25.5::DOUBLE, 1.0::DOUBLE), ('N', 'quantity', 90.0, 1.0), ('R', 'quantity', 25.5, 40.0), ('Z', 'quantity', 1.0, 1.0))
SELECT task, metric, expected, tolerance, round(value, 6) AS value, coalesce(isfinite(value) AND abs(value - expected) <= tolerance, false) AS ok FROM e LEFT JOIN r USING (task, metric)""")
def a53_verified(spark, d):
    results = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("task")).agg(F.avg(F.col("l_quantity").cast("double")).alias("value")).withColumn("metric", F.lit("quantity"))
    expected = spark.createDataFrame([("A", "quantity", 25.5, 1.0), ("N", "quantity", 90.0, 1.0), ("R", "quantity", 25.5, 40.0), ("Z", "quantity", 1.0, 1.0)], "task string, metric string, expected double, tolerance double")
    return rewards.verified(results, expected).withColumn("value", F.round("value", 6))


@query("""WITH p AS (SELECT l_orderkey % 10 AS g, greatest(least(l_discount::DOUBLE * 4 - l_tax::DOUBLE * 4, 20), -20) AS lr, l_tax::DOUBLE AS kl, l_quantity::DOUBLE / 25 - 1 AS adv, (l_linenumber % 4 <> 0)::INT::DOUBLE AS k FROM lineitem),
s AS (SELECT g, -sum(least(exp(lr) * adv, greatest(least(exp(lr), 1.2), 0.8) * adv) * k) / greatest(sum(k), 1) AS pl, sum(0.5 * lr * lr * k) / greatest(sum(k), 1) AS ak, sum(kl * k) / greatest(sum(k), 1) AS rk, sum((abs(exp(lr) - 1) > 0.2)::INT * k) / greatest(sum(k), 1) AS cs, sum(exp(lr) * k) / greatest(sum(k), 1) AS rm FROM p GROUP BY 1)
SELECT g, round(pl, 6) AS policy_loss, round(ak, 6) AS approx_kl, round(rk, 6) AS reference_kl, round(cs, 6) AS clip_share, round(rm, 6) AS ratio_mean, round(0.04 * rk, 6) AS kl_loss, round(pl + 0.04 * rk, 6) AS total_loss FROM s""")
def g20_policy_statistics(spark, d):
    c = lambda name: F.col(name).cast("double")
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 10).alias("g"), (c("l_discount") * 4).alias("new"), (c("l_tax") * 4).alias("old"), c("l_tax").alias("reference_kl"), (c("l_quantity") / 25 - 1).alias("advantage"), (F.col("l_linenumber") % 4 != 0).cast("double").alias("mask"))
    return _rounded(rewards.policy_statistics(rows, 0.2, 0.04, "g"), 6, "g")


@query(f"WITH RECURSIVE {SQL} SELECT l_orderkey % 3 AS rank, count(*) AS n, round(avg(l_discount::DOUBLE), 7) AS mean FROM lines GROUP BY 1")
def a54_merged_partials(spark, d):
    """Partial sums of each rank, merged: what a gather and a reduce between ranks would give."""
    own = lines(spark, d).groupBy(F.col("l_orderkey") % 12).agg(F.count("*").alias("n"), F.sum(F.col("l_discount").cast("double")).alias("s")).toDF("part", "n", "s")
    return own.groupBy((F.col("part") % 3).alias("rank")).agg(F.sum("n").alias("total"), F.sum("s").alias("s")).select("rank", F.col("total").alias("n"), F.round(F.col("s") / F.col("total"), 7).alias("mean"))
