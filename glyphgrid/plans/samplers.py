"""Queries of samplers, streams of several sources, sets and answer metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import box as B

from ..operators import metrics, sampling
from .detection import _W
from .registered import registrar
from .views import guesses, lines, table, truth

QUERIES, ORACLE, query = registrar()


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), "o_custkey")


@query("SELECT id, step FROM (SELECT o_orderkey AS id, (row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) - 1) // 4 AS step, (row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) - 1) % 4 AS rank FROM orders) WHERE rank = 1")
def b1_epoch_order(spark, d):
    return sampling.epoch_order(_orders(spark, d), "id", 5, 2, 1, 4).select("id", "step")


@query("SELECT o_orderkey AS id FROM orders ORDER BY md5('3:' || o_orderkey), o_orderkey LIMIT 2")
def b13_two_rows(spark, d):
    return _orders(spark, d).orderBy(sampling.seeded(F.col("id"), 3), "id").limit(2).select("id")


@query("SELECT id, source, (r % 2)::INT AS rank, (r // 2) // 8 AS batch, ((r // 2) % 8)::INT AS slot FROM (SELECT o_orderkey AS id, o_orderpriority AS source, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) // 16 * 16 AS n FROM orders) WHERE r < n")
def b9_source_batches(spark, d):
    return sampling.source_batches(_orders(spark, d), "source", ["id"], 8, 2).select("id", "source", "rank", "batch", "slot")


@query(f"""{_W}, l AS (SELECT image_id % 40 AS g, image_id * 10 + gi AS id, CASE WHEN gi % 5 = 0 THEN -1 WHEN gi % 3 = 0 THEN 1 ELSE 9 END AS label FROM gt), r AS (SELECT *, row_number() OVER (PARTITION BY g, label <> 9 ORDER BY md5('0:' || id), id) AS r FROM l WHERE label >= 0),
n AS (SELECT *, least(count(*) FILTER (label <> 9) OVER (PARTITION BY g), 8) AS p FROM r) SELECT g, id, label FROM n WHERE CASE WHEN label <> 9 THEN r <= p ELSE r <= 32 - p END""")
def b10_balanced_sample(spark, d):
    gi = F.col("gi")
    rows = truth(spark, d).select((F.col("image_id") % 40).alias("g"), (F.col("image_id") * 10 + gi).alias("id"), F.when(gi % 5 == 0, -1).when(gi % 3 == 0, 1).otherwise(9).alias("label"))
    return sampling.balanced_sample(rows, "g", "label", "id", 32, 0.25, 9).select("g", "id", "label")


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS source, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 1 ELSE 2 END AS k, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS r FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')),
n AS (SELECT min(c // k) AS turns FROM (SELECT source, any_value(k) AS k, count(*) AS c FROM r GROUP BY 1)) SELECT id, source, r // k AS turn FROM r, n WHERE r // k < turns""")
def q11_weighted_stream(spark, d):
    return sampling.weighted_stream(_orders(spark, d), "source", ["id"], {"1-URGENT": 3, "2-HIGH": 1, "5-LOW": 2}).select("id", "source", "turn")


@query("SELECT 0 AS source, o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders UNION ALL SELECT 1, c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 + (SELECT count(*) FROM orders) FROM customer")
def u3_concatenated(spark, d):
    return sampling.concatenated([_orders(spark, d).select("id"), table(spark, d, "customer").select(F.col("c_custkey").alias("id"))], ["id"]).select("source", "id", "index")


@query("SELECT o_orderkey, any_value(o_orderpriority) AS priority, any_value(o_custkey) AS customer FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def u4_consistent(spark, d):
    own = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"))
    return sampling.consistent(own, ["o_orderkey"], ["priority", "customer"])


@query(f"{_W} SELECT g.image_id, coalesce(string_agg(g.text, ',' ORDER BY g.text), '') AS both FROM (SELECT DISTINCT image_id, text FROM gt) g JOIN (SELECT DISTINCT image_id, text FROM pred) p ON p.image_id = g.image_id AND p.text = g.text GROUP BY 1")
def u2_shared_texts(spark, d):
    """Texts that both sides of an image have, as a set operation on arrays."""
    texts = lambda df, c: df.groupBy("image_id").agg(F.collect_set("text").alias(c))
    own = texts(truth(spark, d), "a").join(texts(guesses(spark, d), "b"), "image_id").where(F.arrays_overlap("a", "b"))
    return own.select("image_id", F.array_join(F.sort_array(F.array_intersect("a", "b")), ",").alias("both"))


@query("SELECT l_suppkey % 10 AS job, max(l_orderkey) AS iteration, round(median(q) * (100000 - max(l_orderkey) - 1), 4) AS eta_seconds FROM (SELECT l_suppkey, l_orderkey, l_quantity::DOUBLE AS q, max(l_orderkey) OVER (PARTITION BY l_suppkey % 10) AS m FROM lineitem) WHERE l_orderkey > m - 1000 GROUP BY 1")
def w11_time_left(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("job"), F.col("l_orderkey").alias("iteration"), F.col("l_quantity").cast("double").alias("seconds"))
    return sampling.time_left(rows, "job", "iteration", "seconds", 100_000).withColumn("eta_seconds", F.round("eta_seconds", 4))


@query(f"{_W}, c AS (SELECT image_id, gi, score, greatest(least(x1, 100), 0) AS x1, greatest(least(y1, 90), 0) AS y1, greatest(least(x2, 100), 0) AS x2, greatest(least(y2, 90), 0) AS y2 FROM gt) SELECT image_id, gi, score, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, gi) AS r FROM c WHERE x2 - x1 > 10 AND y2 - y1 > 10) WHERE r <= 2")
def w16_top_proposals(spark, d):
    out = sampling.top_proposals(truth(spark, d), "image_id", "box", "score", "gi", F.lit(100), F.lit(90), 10.0, 2)
    return out.select("image_id", "gi", "score", "box.*")


@query(f"{_W} SELECT image_id, gi, text FROM gt ORDER BY image_id, gi")
def w18_sorted_ids(spark, d):
    return truth(spark, d).select("image_id", "gi", "text").orderBy("image_id", "gi")


_SHARE = "('0x' || substr(md5('4:' || image_id || '/' || gi || '/' || point || '/{a}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"{_W}, p AS (SELECT image_id, gi, point::INT AS point, x1, y1, x2, y2, x1 + (x2 - x1) * ({_SHARE.format(a='x')}) AS x, y1 + (y2 - y1) * ({_SHARE.format(a='y')}) AS y FROM gt, range(3) r(point)) SELECT image_id, gi, point, round(x, 7) AS x, round(y, 7) AS y, x <= x1 + 0.75 * (x2 - x1) AND y <= y1 + 0.75 * (y2 - y1) AS inside FROM p")
def q17_random_points(spark, d):
    out = sampling.random_points(truth(spark, d).select("image_id", "gi", "box"), ["image_id", "gi"], "box", 3, 4)
    return out.withColumn("x", F.round("x", 7)).withColumn("y", F.round("y", 7))


@query("WITH c AS (SELECT s_suppkey AS category, s_suppkey % 3 = 0 AS thing FROM supplier), m AS (SELECT category, 0 AS label FROM c WHERE thing UNION ALL SELECT category, row_number() OVER (ORDER BY category) FROM c WHERE NOT thing) SELECT l_orderkey AS image_id, l_linenumber AS segment, coalesce(label, 255)::INT AS label FROM lineitem LEFT JOIN m ON category = CASE WHEN l_linenumber = 7 THEN -1 ELSE l_suppkey END")
def q16_semantic_labels(spark, d):
    labels = sampling.stuff_labels(table(spark, d, "supplier").select(F.col("s_suppkey").alias("category"), (F.col("s_suppkey") % 3 == 0).alias("thing")), "thing", "category")
    segments = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("segment"), F.when(F.col("l_linenumber") != 7, F.col("l_suppkey")).alias("category"))
    return segments.join(labels, "category", "left").select("image_id", "segment", F.coalesce("label", F.lit(255)).cast("int").alias("label"))


@query("""SELECT l_orderkey AS image_id, l_linenumber AS line, '{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || ',"l_returnflag":"' || l_returnflag || '"}' AS shown FROM lineitem WHERE l_returnflag = 'R' AND l_quantity BETWEEN 45 AND 50""")
def q6_shown_entries(spark, d):
    from ..operators.selector import select

    out = select(table(spark, d, "lineitem"), "l_quantity:float=45-50,l_returnflag=R")
    return out.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("line"), F.to_json(F.struct("l_orderkey", "l_linenumber", "l_returnflag")).alias("shown"))


@query(f"{_W}, a AS (SELECT image_id, list(DISTINCT text) AS ts, max_by(text, gi) AS last FROM gt GROUP BY 1), p AS (SELECT image_id, max_by(text, pi) AS guess FROM pred GROUP BY 1), s AS (SELECT list_contains(ts, guess) AS hit, list_max(list_transform(ts, lambda t: 1 - levenshtein(t, guess) / greatest(length(t), length(guess), 1))) AS best FROM a JOIN p USING (image_id)) SELECT round(avg(hit::INT), 8) AS accuracy, round(avg(CASE WHEN best < 0.5 THEN 0.0 ELSE best END), 8) AS anls FROM s")
def a36_answer_accuracy(spark, d):
    truths = truth(spark, d).groupBy("image_id").agg(F.collect_set("text").alias("truths"))
    answer = guesses(spark, d).groupBy("image_id").agg(F.max_by("text", "pi").alias("answer"))
    return metrics.answer_accuracy(truths.join(answer, "image_id"), "answer", "truths").select(F.round("accuracy", 8).alias("accuracy"), F.round("anls", 8).alias("anls"))


@query("WITH r AS (SELECT o_custkey % 4 AS t, o_orderkey % 4 AS o, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 3 END AS x FROM orders) SELECT count(*) AS total, round(avg((coalesce(x, o) = t)::INT), 8) AS accuracy, round(avg((coalesce(x, o) = t OR o = t)::INT), 8) AS upper_bound, round(avg((x IS NULL)::INT), 8) AS no_answer FROM r")
def a39_ensemble(spark, d):
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 4).alias("t"), (F.col("o_orderkey") % 4).alias("o"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey") % 3).alias("x"))
    out = metrics.ensemble_accuracy(rows, "t", "o", "x")
    return out.select("total", *[F.round(c, 8).alias(c) for c in ("accuracy", "upper_bound", "no_answer")])


_TAGS = "g AS (SELECT DISTINCT l_orderkey AS i, (l_suppkey + l_linenumber % 2) % 12 AS tag FROM lineitem), t AS (SELECT DISTINCT l_orderkey AS i, l_suppkey % 12 AS tag FROM lineitem WHERE l_suppkey % 12 < 10), s AS (SELECT k AS tag, (SELECT count(*) FROM g JOIN t USING (i, tag) WHERE tag = k) / ((SELECT count(*) FROM g WHERE tag = k) + 1e-9) AS p, (SELECT count(*) FROM g JOIN t USING (i, tag) WHERE tag = k) / ((SELECT count(*) FROM t WHERE tag = k) + 1e-9) AS r FROM range(14) x(k))"


def _tag_scores(spark, d):
    rows = table(spark, d, "lineitem")
    g = rows.select(F.col("l_orderkey").alias("i"), ((F.col("l_suppkey") + F.col("l_linenumber") % 2) % 12).alias("tag"))
    t = rows.select(F.col("l_orderkey").alias("i"), (F.col("l_suppkey") % 12).alias("tag")).where("tag < 10")
    return metrics.tag_scores(g, t, spark.range(14).withColumnRenamed("id", "tag"), "i", "tag")


@query(f"WITH {_TAGS} SELECT tag, round(p, 8) AS precision, round(r, 8) AS recall FROM s")
def a42_tag_scores(spark, d):
    return _tag_scores(spark, d).select("tag", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))


@query(f"WITH {_TAGS} SELECT round(avg(p), 8) AS precision, round(avg(r), 8) AS recall FROM s")
def a42_tag_means(spark, d):
    return _tag_scores(spark, d).agg(F.round(F.avg("precision"), 8).alias("precision"), F.round(F.avg("recall"), 8).alias("recall"))


_GRAMS = "list_transform(range(1, greatest(len({w}) - {n} + 2, 1)), lambda k: array_to_string({w}[k : k + {n} - 1], ' '))"


def _bleu_sql() -> str:
    match = lambda n: f"(SELECT coalesce(sum(least(len(list_filter(cg, lambda y: y = x)), greatest(len(list_filter(ag, lambda y: y = x)), len(list_filter(bg, lambda y: y = x))))), 0) FROM (SELECT unnest(list_distinct({_GRAMS.format(w='c', n=n)})) AS x, {_GRAMS.format(w='c', n=n)} AS cg, {_GRAMS.format(w='a', n=n)} AS ag, {_GRAMS.format(w='b', n=n)} AS bg))"
    sums = ", ".join(f"sum({match(n)})::DOUBLE AS m{n}, sum(greatest(len(c) - {n} + 1, 0))::DOUBLE AS t{n}" for n in range(1, 5))
    near = "CASE WHEN abs(len(a) - len(c)) < abs(len(b) - len(c)) OR (abs(len(a) - len(c)) = abs(len(b) - len(c)) AND len(a) <= len(b)) THEN len(a) ELSE len(b) END"
    return f"""WITH w AS (SELECT string_split(regexp_replace(text, '[^ -~]', '', 'g'), ' ') AS v FROM benchmark), r AS (SELECT v[1:20] AS c, v[3:21] AS a, list_concat(v[1:9], v[11:24]) AS b FROM w),
s AS (SELECT {sums}, sum(len(c)) AS gs, sum({near}) AS ws FROM r) SELECT round(CASE WHEN gs >= ws THEN 1.0 ELSE exp(1 - ws / gs) END * exp((ln(m1 / t1) + ln(m2 / t2) + ln(m3 / t3) + ln(m4 / t4)) / 4), 8) AS bleu, round(CASE WHEN gs >= ws THEN 1.0 ELSE exp(1 - ws / gs) END, 8) AS brevity FROM s"""


@query(_bleu_sql())
def a37_bleu(spark, d):
    v = F.split(F.regexp_replace("text", "[^ -~]", ""), " ")
    rows = table(spark, d, "benchmark").select(F.slice(v, 1, 20).alias("c"), F.array(F.slice(v, 3, 19), F.concat(F.slice(v, 1, 9), F.slice(v, 11, 14))).alias("truths"))
    return metrics.bleu(rows, "c", "truths").select(F.round("bleu", 8).alias("bleu"), F.round("brevity", 8).alias("brevity"))


@query("""WITH v AS (SELECT l_returnflag AS f, l_quantity::DOUBLE AS q FROM lineitem), r AS (SELECT f, min(q) AS least, max(q) AS most, count(q) AS n, sum(q) AS total, sum(q * q) AS squares FROM v GROUP BY 1)
SELECT f, least, most, n, round(total, 4) AS total, round(squares, 4) AS squares, (SELECT string_agg(c::VARCHAR, ',' ORDER BY k) FROM (SELECT k, count(q) AS c FROM range(7) x(k) LEFT JOIN v ON v.f = r.f AND least(floor((q - least) * 7 / (most - least)), 6) = k GROUP BY 1)) AS counts FROM r""")
def g19_detailed_histogram(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_quantity").cast("double").alias("q"))
    out = metrics.detailed_histogram(rows, "q", 7, "f")
    return out.select("f", "least", "most", "n", F.round("total", 4).alias("total"), F.round("squares", 4).alias("squares"), F.array_join(F.transform("counts", lambda c: c.cast("string")), ",").alias("counts"))


@query(f"{_W} SELECT image_id, gi, x1 || ',' || y1 || ',' || (x2 - x1) || ',' || (y2 - y1) AS xywh, (x1 + x2) / 2 AS cx, round(w, 6) AS around_w, round(h, 6) AS around_h FROM (SELECT *, abs(cos(radians(gi * 25))) * 40 + abs(sin(radians(gi * 25))) * 30 AS w, abs(cos(radians(gi * 25))) * 30 + abs(sin(radians(gi * 25))) * 40 AS h FROM gt)")
def g7_box_modes(spark, d):
    b = F.col("box")
    xyxy = F.array(b["x1"], b["y1"], b["x2"], b["y2"])
    xywh = B.to_mode(xyxy, "xyxy", "xywh")
    turned = F.concat(F.slice(B.to_mode(xywh, "xywh", "xywha"), 1, 4), F.array(F.col("gi") * 25.0))
    rows = truth(spark, d).select("image_id", "gi", xywh.alias("xywh"), turned.alias("turned"), B.to_mode(turned, "xywha", "xyxy").alias("around"))
    size = lambda k: F.round(F.col("around")[k + 2] - F.col("around")[k], 6)
    return rows.select("image_id", "gi", F.array_join(F.transform("xywh", lambda v: v.cast("string")), ",").alias("xywh"), F.col("turned")[0].alias("cx"), size(0).alias("around_w"), size(1).alias("around_h"))


_ROT = "r AS (SELECT image_id, gi, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h, CASE WHEN gi % 2 = 0 THEN 360.5 * gi ELSE gi * 50.0 END AS deg FROM gt), n AS (SELECT *, ((deg + 180) % 360 + 360) % 360 - 180 AS ang, abs(cos(radians(deg))) AS c, abs(sin(radians(deg))) AS s FROM r)"


@query(f"""{_W}, {_ROT} SELECT image_id, gi, w * h AS area, round(ang, 6) AS angle, round(CASE WHEN abs(ang) <= 1 THEN least(w, greatest(least(cx + w / 2, 100), 0) - greatest(least(cx - w / 2, 100), 0)) ELSE w END, 6) AS clipped_w, round(CASE WHEN abs(ang) <= 1 THEN (greatest(least(cy - h / 2, 90), 0) + greatest(least(cy + h / 2, 90), 0)) / 2 ELSE cy END, 6) AS clipped_cy,
 cx - (c * w + s * h) / 2 >= 0 AND cy - (c * h + s * w) / 2 >= 0 AND cx + (c * w + s * h) / 2 <= 130 AND cy + (c * h + s * w) / 2 <= 130 AS inside, round(w * sqrt((2 * cos(radians(deg))) ** 2 + (0.5 * sin(radians(deg))) ** 2), 6) AS scaled_w, round(h * sqrt((2 * sin(radians(deg))) ** 2 + (0.5 * cos(radians(deg))) ** 2), 6) AS scaled_h, round(degrees(atan2(2 * sin(radians(deg)), 0.5 * cos(radians(deg)))), 5) AS scaled_angle FROM n""")
def g8_rotated_boxes(spark, d):
    b, gi = F.col("box"), F.col("gi")
    deg = F.when(gi % 2 == 0, gi * 360.5).otherwise(gi * 50.0)
    r = F.array((b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2, b["x2"] - b["x1"], b["y2"] - b["y1"], deg)
    clipped, scaled = B.rotated_clip(r, 100, 90), B.rotated_scale(r, 2.0, 0.5)
    return truth(spark, d).select("image_id", "gi", (r[2] * r[3]).alias("area"), F.round(B.normal_angle(r[4]), 6).alias("angle"), F.round(clipped[2], 6).alias("clipped_w"), F.round(clipped[1], 6).alias("clipped_cy"), B.rotated_inside(r, 130, 130).alias("inside"), F.round(scaled[2], 6).alias("scaled_w"), F.round(scaled[3], 6).alias("scaled_h"), F.round(scaled[4], 5).alias("scaled_angle"))


@query(f"{_W}, z AS (SELECT image_id, gi, [x1, x1 + 10, x1 + 5, x2] AS xs, [y1, y1 + 8, y2, y1 + 1] AS ys, x1 + 6 AS v FROM gt) SELECT image_id, gi, 3 AS n, round(ys[1] + 6 * (ys[2] - ys[1]) / 10, 6) AS first, round(ys[3] + (v - xs[3]) * (ys[4] - ys[3]) / (xs[4] - xs[3]), 6) AS last FROM z")
def g16_vertical_crossings(spark, d):
    b = F.col("box")
    xs, ys = F.array(b["x1"], b["x1"] + 10, b["x1"] + 5, b["x2"]), F.array(b["y1"], b["y1"] + 8, b["y2"], b["y1"] + 1)
    rows = truth(spark, d).select("image_id", "gi", B.vertical_crossings(xs, ys, b["x1"] + 6).alias("v"))
    return rows.select("image_id", "gi", F.size("v").alias("n"), F.round(F.col("v")[0], 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"))


@query(f"{_W} SELECT g.image_id, g.gi, p.pi, CASE WHEN u > 0 THEN i / u END AS iou FROM (SELECT *, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - i AS u FROM gt a JOIN pred b ON b.image_id = a.image_id AND b.pi = a.gi) t JOIN gt g ON g.image_id = t.image_id AND g.gi = t.gi JOIN pred p ON p.image_id = t.image_id AND p.pi = t.pi")
def g5_matched_iou(spark, d):
    own = truth(spark, d).join(guesses(spark, d).select("image_id", F.col("pi"), F.col("box").alias("other")), "image_id").where("gi = pi")
    return own.select("image_id", "gi", "pi", B.matched_iou(F.col("box"), F.col("other")).alias("iou"))


@query(f"{_W} SELECT a.image_id, a.gi, b.pi, CASE WHEN u > 0 THEN i / u ELSE 0.0 END AS iou FROM (SELECT a.image_id, a.gi, b.pi, greatest(least(a.x2 - 60, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i, greatest(a.x2 - 60 - a.x1, 0) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - i AS u FROM gt a JOIN pred b ON b.image_id = a.image_id AND b.pi = a.gi) t JOIN gt a ON a.image_id = t.image_id AND a.gi = t.gi JOIN pred b ON b.image_id = t.image_id AND b.pi = t.pi")
def g2_clamped_iou(spark, d):
    """Boxes whose sides may be negative: such an area counts as zero."""
    b = F.col("box")
    own = truth(spark, d).withColumn("box", B.box(b["x1"], b["y1"], b["x2"] - 60, b["y2"])).join(guesses(spark, d).select("image_id", "pi", F.col("box").alias("other")), "image_id").where("gi = pi")
    return own.select("image_id", "gi", "pi", B.iou(F.col("box"), F.col("other")).alias("iou"))


@query("SELECT l_orderkey AS id, count(*) AS n, min(l_quantity)::DOUBLE AS least FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0) GROUP BY 1")
def q19_gathered_records(spark, d):
    """Fixed records by id: packed to an array a record, gathered for a list of ids."""
    rows = lines(spark, d).join(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey").groupBy("l_orderkey").agg(F.array(F.max("o").cast("double"), F.min("l_quantity").cast("double")).alias("record"))
    ids = table(spark, d, "orders").where("o_custkey % 7 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return rows.join(ids, "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("id"), F.col("record")[0].cast("long").alias("n"), F.col("record")[1].alias("least"))
