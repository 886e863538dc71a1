"""Queries of the detection and reward families over the derived views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import box as B
from ..functions import text as T
from ..operators import curation, matching, metrics, sampling
from .views import SQL, guesses, table, truth

QUERIES, ORACLE = {}, {}

#: Pieces of SQL that several oracles share.
_W = f"WITH RECURSIVE {SQL}"
_IOU = "CASE WHEN {u} > 0 THEN {i} / {u} ELSE 0.0 END"


def _iou(a: str, b: str) -> str:
    i = f"(greatest(least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1),0.0)*greatest(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1),0.0))"
    return _IOU.format(i=i, u=f"(({a}.x2-{a}.x1)*({a}.y2-{a}.y1)+({b}.x2-{b}.x1)*({b}.y2-{b}.y1)-{i})")


_PAIRS = f"pairs AS (SELECT g.image_id, g.gi, p.pi, {_iou('g', 'p')} AS iou FROM gt g JOIN pred p USING (image_id) WHERE {_iou('g', 'p')} >= 0.5)"
_MATCH = f"""{_PAIRS},
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY iou DESC, gi DESC, pi DESC) AS rn FROM pairs),
step AS (SELECT image_id, rn, [gi] AS ug, [pi] AS up, true AS take FROM rk WHERE rn = 1
 UNION ALL SELECT r.image_id, r.rn, CASE WHEN ok THEN list_append(ug, r.gi) ELSE ug END, CASE WHEN ok THEN list_append(up, r.pi) ELSE up END, ok
 FROM (SELECT r.*, s.ug, s.up, NOT list_contains(s.ug, r.gi) AND NOT list_contains(s.up, r.pi) AS ok FROM step s JOIN rk r ON r.image_id = s.image_id AND r.rn = s.rn + 1) r),
m AS (SELECT rk.image_id, gi, pi, iou FROM rk JOIN step USING (image_id, rn) WHERE take)"""
_COUNTS = """cnt AS (SELECT image_id, coalesce(ng, 0) AS num_gt, coalesce(np, 0) AS num_pred, coalesce(nm, 0) AS num_matched
 FROM (SELECT image_id, count(*) AS ng FROM gt GROUP BY 1) FULL JOIN (SELECT image_id, count(*) AS np FROM pred GROUP BY 1) USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS nm FROM m GROUP BY 1) USING (image_id))"""
_REWARDED = """rew AS (SELECT m.image_id, gi, m.pi, greatest(1 - levenshtein(g.text, p.text) / greatest(length(g.text), 1), 0.0) AS reward, 1 - levenshtein(g.text, p.text) / greatest(length(g.text), length(p.text), 1) AS ned, (g.text = p.text) AS same
 FROM m JOIN gt g USING (image_id, gi) JOIN pred p ON p.image_id = m.image_id AND p.pi = m.pi)"""
_REWARD_ROWS = """fin AS (SELECT c.*, coalesce(r.mm, 0.0) AS matched_mean, greatest(num_gt - num_matched, 0) AS missed, greatest(num_pred - num_matched, 0) AS false_positive,
 coalesce(r.mm, 0.0) - (greatest(num_gt - num_matched, 0) * 1.0::DOUBLE + greatest(num_pred - num_matched, 0) * 0.25::DOUBLE) AS final_reward,
 coalesce(r.mm, 0.0) - (greatest(num_gt - num_matched, 0) * 1.0::DOUBLE + greatest(num_pred - num_matched, 0) * 0.25::DOUBLE) / greatest(num_gt, 1) AS final_reward_norm
 FROM cnt c LEFT JOIN (SELECT image_id, round(avg(reward), 9) AS mm FROM rew GROUP BY 1) r USING (image_id))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _images(spark: SparkSession, d: str) -> DataFrame:
    return matching.image_matches(truth(spark, d), guesses(spark, d))


def _matches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return truth(spark, d), guesses(spark, d), _images(spark, d).select("image_id", F.inline("matches")).select("image_id", "gi", "pi", "iou")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return _images(spark, d).select("image_id", "num_gt", "num_pred", F.size("matches").cast("long").alias("num_matched"))


def _rewarded(spark: SparkSession, d: str) -> DataFrame:
    m, a, b = _images(spark, d).select("image_id", F.inline("matches")), F.col("truth"), F.col("guess")
    return m.select("image_id", "gi", "pi", T.pair_reward(a, b).alias("reward"), T.ned(a, b).alias("ned"), (a == b).alias("same"))


def _final(spark: SparkSession, d: str) -> DataFrame:
    rows = matching.match_scores(_images(spark, d)).withColumn("matched_mean", F.round("matched_mean", 9))
    return metrics.compose_reward(rows.select("image_id", "num_gt", "num_pred", "num_matched", "matched_mean"))


@query(f"{_W}, {_PAIRS} SELECT image_id, gi, pi, iou FROM pairs")
def j1_iou_join(spark, d):
    return matching.iou_pairs(truth(spark, d), guesses(spark, d))


@query(f"{_W}, {_MATCH} SELECT image_id, gi, pi, iou FROM m")
def j2_greedy_match(spark, d):
    return matching.greedy_match(matching.iou_pairs(truth(spark, d), guesses(spark, d), 0.5))


@query(f"{_W}, {_MATCH} SELECT 'gt' AS side, image_id, gi AS idx FROM gt WHERE (image_id, gi) NOT IN (SELECT image_id, gi FROM m) UNION ALL SELECT 'pred', image_id, pi FROM pred WHERE (image_id, pi) NOT IN (SELECT image_id, pi FROM m)")
def j3_unmatched(spark, d):
    gt, pred, m = _matches(spark, d)
    side = lambda df, k, n: matching.unmatched(df, m, k).select(F.lit(n).alias("side"), "image_id", F.col(k).alias("idx"))
    return side(gt, "gi", "gt").unionByName(side(pred, "pi", "pred"))


@query(f"{_W}, {_MATCH}, {_REWARDED}, {_COUNTS} SELECT c.image_id, num_gt, num_pred, num_matched, coalesce(r.iou, 0.0) AS mean_iou, coalesce(w.ned, 0.0) AS mean_ned, coalesce(w.exact, 0)::BIGINT AS exact_matches FROM cnt c LEFT JOIN (SELECT image_id, round(avg(iou), 9) AS iou FROM m GROUP BY 1) r USING (image_id) LEFT JOIN (SELECT image_id, round(avg(ned), 9) AS ned, sum(same::INT) AS exact FROM rew GROUP BY 1) w USING (image_id)")
def a3_per_image_summary(spark, d):
    out = matching.match_scores(_images(spark, d))
    return out.select("image_id", "num_gt", "num_pred", "num_matched", F.round("mean_iou", 9).alias("mean_iou"), F.round("mean_ned", 9).alias("mean_ned"), "exact_matches")


_PRF = "sum(num_gt)::BIGINT AS num_gt, sum(num_pred)::BIGINT AS num_pred, sum(num_matched)::BIGINT AS num_matched, sum(num_matched)::DOUBLE / sum(num_pred)::DOUBLE AS precision, sum(num_matched)::DOUBLE / sum(num_gt)::DOUBLE AS recall"


@query(f"{_W}, {_MATCH}, {_COUNTS} SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM (SELECT {_PRF} FROM cnt)")
def a4_global_prf(spark, d):
    return metrics.rates(_counts(spark, d))


@query(f"{_W}, {_MATCH}, {_COUNTS} SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM (SELECT image_id % 2 AS chunk, {_PRF} FROM cnt GROUP BY 1)")
def a5_per_chunk(spark, d):
    return metrics.rates(_counts(spark, d).withColumn("chunk", F.col("image_id") % 2), "chunk")


@query(f"{_W}, {_MATCH} SELECT count(*) AS n, round(avg(iou), 8) AS mean, round(stddev_pop(iou), 8) AS std, min(iou) AS lo, round(quantile_cont(iou, 0.25), 8) AS p25, round(quantile_cont(iou, 0.5), 8) AS p50, round(quantile_cont(iou, 0.75), 8) AS p75, max(iou) AS hi FROM m")
def a6_describe(spark, d):
    out = metrics.describe(_matches(spark, d)[2], "iou")
    return out.select(*[F.round(c, 8).alias(c) if c in ("mean", "std", "p25", "p50", "p75") else F.col(c) for c in out.columns])


@query(f"{_W}, {_MATCH} SELECT b::INT AS bin, count(iou) AS n FROM range(5) t(b) LEFT JOIN m ON iou >= 0.5 + b * 0.1 AND iou < CASE WHEN b = 4 THEN 1.0001 ELSE 0.5 + (b + 1) * 0.1 END GROUP BY 1")
def a7_iou_histogram(spark, d):
    return metrics.histogram(_matches(spark, d)[2], "iou", [0.5, 0.6, 0.7, 0.8, 0.9, 1.0001])


@query(f"{_W}, {_MATCH}, {_REWARDED}, {_COUNTS}, {_REWARD_ROWS} SELECT image_id, missed, false_positive, matched_mean, round(final_reward, 6) AS final_reward, round(final_reward_norm, 6) AS final_reward_norm FROM fin")
def a17_reward_rows(spark, d):
    return _final(spark, d).select("image_id", "missed", "false_positive", "matched_mean", F.round("final_reward", 6).alias("final_reward"), F.round("final_reward_norm", 6).alias("final_reward_norm"))


@query(f"{_W}, {_MATCH}, {_REWARDED}, {_COUNTS}, {_REWARD_ROWS} SELECT CASE WHEN num_gt <= 3 THEN num_gt::VARCHAR WHEN num_gt <= 5 THEN '4-5' WHEN num_gt <= 10 THEN '6-10' ELSE '11+' END AS bucket, count(*) AS n, round(avg(final_reward), 7) AS mean, round(stddev_pop(final_reward), 7) AS std, round(median(final_reward), 7) AS med FROM fin GROUP BY 1")
def a9_gt_buckets(spark, d):
    v = "final_reward"
    out = metrics.describe(_final(spark, d).withColumn("bucket", metrics.count_bucket(F.col("num_gt"))), v, "bucket")
    return out.select("bucket", "n", *[F.round(c, 7).alias(n) for n, c in (("mean", "mean"), ("std", "std"), ("med", "p50"))])


@query(f"{_W}, {_MATCH}, {_REWARDED}, {_COUNTS}, {_REWARD_ROWS} SELECT avg((round(final_reward, 8) > 0)::INT) AS positive, avg((round(final_reward, 8) = 0)::INT) AS zero, avg((round(final_reward, 8) < 0)::INT) AS negative FROM fin")
def a10_sign_fractions(spark, d):
    v = F.round("final_reward", 8)
    return _final(spark, d).agg(F.avg((v > 0).cast("int")).alias("positive"), F.avg((v == 0).cast("int")).alias("zero"), F.avg((v < 0).cast("int")).alias("negative"))


@query(f"{_W}, {_MATCH}, {_REWARDED} SELECT avg((reward > 0.9999)::INT) AS perfect, avg((reward < 1e-9)::INT) AS zero, count(*) AS n FROM rew")
def a11_perfect_zero(spark, d):
    return _rewarded(spark, d).agg(F.avg((F.col("reward") > 0.9999).cast("int")).alias("perfect"), F.avg((F.col("reward") < 1e-9).cast("int")).alias("zero"), F.count("*").alias("n"))


@query(f"{_W}, {_MATCH}, {_COUNTS} SELECT round(avg(greatest(num_gt - num_matched, 0) / greatest(num_gt, 1)), 8) AS missed_rate, round(avg(greatest(num_pred - num_matched, 0) / greatest(num_gt, 1)), 8) AS false_rate FROM cnt")
def a12_component_means(spark, d):
    c = _counts(spark, d)
    rate = lambda a: F.round(F.avg(F.greatest(F.col(a) - F.col("num_matched"), F.lit(0)) / F.greatest(F.col("num_gt"), F.lit(1))), 8)
    return c.agg(rate("num_gt").alias("missed_rate"), rate("num_pred").alias("false_rate"))


@query(f"""{_W}, o AS (SELECT image_id, gi, score, x1, y1, x2, y2, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, gi) AS rn FROM gt),
st AS (SELECT image_id, rn, [rn] AS kept, true AS ok FROM o WHERE rn = 1
 UNION ALL SELECT image_id, rn, CASE WHEN ok THEN list_append(kept, rn) ELSE kept END, ok FROM (SELECT c.image_id, c.rn, s.kept, NOT EXISTS (SELECT 1 FROM o k WHERE k.image_id = c.image_id AND list_contains(s.kept, k.rn) AND {_iou('k', 'c')} > 0.3) AS ok FROM st s JOIN o c ON c.image_id = s.image_id AND c.rn = s.rn + 1))
SELECT o.image_id, o.gi, o.score FROM o JOIN st USING (image_id, rn) WHERE st.ok""")
def w1_suppress_duplicates(spark, d):
    return matching.suppress(truth(spark, d), 0.3, ["image_id"]).select("image_id", "gi", "score")


@query(f"{_W} SELECT a.image_id, a.gi, EXISTS (SELECT 1 FROM gt b WHERE b.image_id = a.image_id AND b.gi <> a.gi AND {_iou('a', 'b')} > 0.1) AS overlapping FROM gt a")
def w8_overlap_flag(spark, d):
    return matching.overlap_flags(truth(spark, d), 0.1)


@query("SELECT o_orderkey AS image_id, x, y FROM (SELECT o_orderkey, 200 + o_orderkey % 5 * 40 AS w, 160 + o_custkey % 3 * 50 AS h FROM orders) t, range(0, 400, 40) a(x), range(0, 400, 40) b(y) WHERE x <= w - 160 AND y <= h - 160")
def w6_sliding_windows(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), (200 + F.col("o_orderkey") % 5 * 40).alias("width"), (160 + F.col("o_custkey") % 3 * 50).alias("height"))
    return curation.sliding_windows(o, 160, 40).select("image_id", "x", "y")


@query(f"{_W} SELECT image_id, gi, text, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, gi) AS r FROM gt) WHERE r <= 3")
def w17_top_detections(spark, d):
    w = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "gi", "text")))
    top = truth(spark, d).groupBy("image_id").agg(F.slice(w, 1, 3).alias("t")).select("image_id", F.inline("t"))
    return top.select("image_id", "gi", "text", (-F.col("neg")).alias("score"))


@query(f"{_W} SELECT p.image_id, p.pi, p.score, coalesce(v.tp, 0)::BIGINT AS tp FROM pred p LEFT JOIN (SELECT image_id, pi, (row_number() OVER (PARTITION BY image_id, gi ORDER BY score DESC, pi) = 1)::BIGINT AS tp FROM (SELECT p.image_id, p.pi, p.score, g.gi, {_iou('g', 'p')} AS iou, row_number() OVER (PARTITION BY p.image_id, p.pi ORDER BY {_iou('g', 'p')} DESC, g.gi) AS r FROM pred p JOIN gt g USING (image_id)) WHERE r = 1 AND iou > 0.5) v USING (image_id, pi)")
def j22_voc_match(spark, d):
    gt, pred = truth(spark, d), guesses(spark, d)
    best = matching.best_truth(matching.iou_pairs(gt, pred, 0.0))
    return matching.voc_hits(pred, best, 0.5)


@query(f"{_W} SELECT image_id, (count(*))::BIGINT AS instances FROM gt WHERE score > 0.05 GROUP BY 1")
def a1_instance_counts(spark, d):
    gt = truth(spark, d)
    return curation.with_counts(gt.select("image_id").distinct(), gt.where("score > 0.05"), "image_id")


@query(f"{_W} SELECT image_id, greatest(count(*) - 2 * count(*) FILTER (score < 0.05), 0)::BIGINT AS instances FROM gt GROUP BY 1")
def a2_decremented_counts(spark, d):
    gt = truth(spark, d)
    gone = gt.where("score < 0.05")
    return curation.decremented(gt.groupBy("image_id").agg(F.count("*").alias("instances")), gone.unionByName(gone), "image_id")


@query(f"{_W} SELECT image_id FROM (SELECT coalesce(g.image_id, p.image_id) AS image_id, g.text AS a, p.text AS b FROM gt g FULL JOIN (SELECT image_id, gi, CASE WHEN image_id % 3 = 0 THEN text ELSE text || 'x' END AS text FROM gt WHERE gi % 4 <> 0) p ON g.image_id = p.image_id AND g.gi = p.gi) GROUP BY 1 HAVING bool_and(a IS NOT DISTINCT FROM b)")
def f4_agreed_images(spark, d):
    """The second annotator misses every fourth instance and reads two images of three otherwise."""
    key = F.concat_ws(":", "image_id", F.col("k"))
    a = truth(spark, d).withColumn("k", F.col("gi")).withColumn("id", key)
    b = a.where("gi % 4 <> 0").withColumn("text", F.when(F.col("image_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("x"))))
    merged = curation.merge_annotators(a, b, "id", "text", "k").withColumn("image_id", F.split("id", ":")[0].cast("long"))
    return curation.agreed_groups(merged, "image_id")


@query("SELECT o_orderkey AS image_id, coalesce((SELECT min_by(p.o_orderpriority, p.o_orderkey) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderkey % 3 = 0), 'Error: No Blur Data') AS tag FROM orders o")
def j6_blur_tag(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("tag"))
    tagged = curation.tag(o.select("o_orderkey", "o_custkey"), o.where("o_orderkey % 3 = 0"), "o_custkey", "tag", "o_orderkey", "Error: No Blur Data")
    return tagged.select(F.col("o_orderkey").alias("image_id"), "tag")


@query(f"{_W} SELECT (o - 1) // 8 AS batch, image_id, gi FROM (SELECT image_id, gi, row_number() OVER (PARTITION BY image_id % 7 ORDER BY image_id, gi) AS o, count(*) OVER (PARTITION BY image_id % 7) AS n FROM gt) WHERE ((o - 1) // 8 + 1) * 8 <= n")
def b5_full_batches(spark, d):
    gt = truth(spark, d).withColumn("g", F.col("image_id") % 7)
    return sampling.full_batches(gt, ["g"], ["image_id", "gi"], 8).select("batch", "image_id", "gi")


@query("SELECT image_id, round(max(factor), 9) AS factor FROM (SELECT DISTINCT l_orderkey AS image_id, l_suppkey % 50 AS cat FROM lineitem) JOIN (SELECT cat, greatest(1.0, sqrt(0.2 / (count(*) / (SELECT count(DISTINCT l_orderkey) FROM lineitem)))) AS factor FROM (SELECT DISTINCT l_orderkey, l_suppkey % 50 AS cat FROM lineitem) GROUP BY 1) USING (cat) GROUP BY 1")
def a21_repeat_factors(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_suppkey") % 50).alias("cat"))
    return sampling.repeat_factors(df, "image_id", "cat", 0.2).select("image_id", F.round("factor", 9).alias("factor"))


@query(f"{_W} SELECT image_id, gi, (x2-x1)*(y2-y1) AS area, greatest(least(x1, 100.0), 0.0) AS cx1, greatest(least(x2, 100.0), 0.0) AS cx2, (x1+x2)/2 AS mx, x2-x1 AS w, x1*0.5 AS sx1, (x1 >= 0 AND x2 <= 130 AND y1 >= 0 AND y2 <= 130) AS inside FROM gt")
def g6_box_algebra(spark, d):
    b = F.col("box")
    c, s = B.clip(b, F.lit(100), F.lit(100)), B.scale(b, F.lit(0.5), F.lit(0.5))
    outer = B.box(F.lit(0), F.lit(0), F.lit(130), F.lit(130))
    return truth(spark, d).select("image_id", "gi", B.area(b).alias("area"), c["x1"].alias("cx1"), c["x2"].alias("cx2"), ((b["x1"] + b["x2"]) / 2).alias("mx"), (b["x2"] - b["x1"]).alias("w"), s["x1"].alias("sx1"), B.contains(outer, b).alias("inside"))


@query(f"{_W} SELECT image_id, gi, (x2-x1)*(y2-y1) AS area FROM gt")
def g10_polygon_area(spark, d):
    b = F.col("box")
    return truth(spark, d).select("image_id", "gi", B.polygon_area(F.array(b["x1"], b["x2"], b["x2"], b["x1"]), F.array(b["y1"], b["y1"], b["y2"], b["y2"])).alias("area"))


@query(f"{_W} SELECT g.image_id, g.gi, h.gi AS gj, {_iou('g', 'h')} AS iou FROM gt g JOIN gt h ON g.image_id = h.image_id AND g.gi < h.gi")
def g3_pairwise_iou(spark, d):
    g = truth(spark, d).select("image_id", "gi", F.col("box").alias("a"))
    h = truth(spark, d).select("image_id", F.col("gi").alias("gj"), F.col("box").alias("b"))
    return g.join(h, "image_id").where("gi < gj").select("image_id", "gi", "gj", B.iou(F.col("a"), F.col("b")).alias("iou"))


@query(f"{_W} SELECT image_id, max_by(text, gi) AS text, count(*) AS n FROM gt GROUP BY 1")
def w12_latest(spark, d):
    gt = truth(spark, d)
    return curation.latest(gt, "image_id", "text", "gi").join(gt.groupBy("image_id").agg(F.count("*").alias("n")), "image_id")


@query(f"{_W} SELECT image_id, gi, CASE WHEN sd + 0.0001 > 0 THEN round((score - mu) / (sd + 0.0001), 4) + 0.0 END AS advantage FROM (SELECT image_id, gi, round(score * 100) AS score, avg(round(score * 100)) OVER (PARTITION BY image_id) AS mu, stddev_pop(round(score * 100)) OVER (PARTITION BY image_id) AS sd FROM gt)")
def a15_group_advantage(spark, d):
    return metrics.group_advantage(truth(spark, d).withColumn("score", F.round(F.col("score") * 100)), "image_id", "score").select("image_id", "gi", (F.round("advantage", 4) + 0.0).alias("advantage"))


@query(f"{_W}, e AS (SELECT image_id, gi, score AS b FROM gt WHERE gi = 1 UNION ALL SELECT g.image_id, g.gi, 0.9::DOUBLE * e.b + (1 - 0.9::DOUBLE) * g.score FROM e JOIN gt g ON g.image_id = e.image_id AND g.gi = e.gi + 1) SELECT image_id, round(max_by(b, gi), 9) AS baseline FROM e GROUP BY 1")
def a16_ema_baseline(spark, d):
    out = metrics.ema_baseline(truth(spark, d), "image_id", "gi", "score")
    return out.select("image_id", F.round("baseline", 9).alias("baseline"))


@query("SELECT l_orderkey AS image_id, l_partkey AS part FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag = 'R'")
def q1_selector(spark, d):
    from ..operators.selector import select

    return select(table(spark, d, "lineitem"), "l_quantity:float=10-20,l_returnflag=R").select(F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("part"))
