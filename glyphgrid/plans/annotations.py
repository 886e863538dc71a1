"""Queries of joins, filters, projections, sampling and scores over the derived views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import box as B
from ..functions import text as T
from ..operators import curation, matching, sampling
from ..sources import readers
from .detection import _W, _iou
from .registered import registrar
from .views import guesses, table, truth

QUERIES, ORACLE, query = registrar()

_KEY = ["image_id", "gi"]


def _orders(spark, d, *columns):
    return table(spark, d, "orders").select(*columns)


def _side_by_side(spark, d):
    """Truth and guess of one line."""
    return truth(spark, d).join(guesses(spark, d).select("image_id", F.col("pi").alias("gi"), F.col("text").alias("guess"), F.col("box").alias("pbox")), _KEY)


_SIDE = "side AS (SELECT g.*, p.text AS guess FROM gt g JOIN pred p ON p.image_id = g.image_id AND p.pi = g.gi)"


@query(f"{_W} SELECT coalesce(g.image_id, p.image_id) AS image_id, coalesce(g.gi, p.pi) AS id, g.text AS side1, p.text AS side2, coalesce(g.score > 0.05, p.score > 0.05) AS has_text FROM gt g FULL JOIN pred p ON g.image_id = p.image_id AND g.gi = p.pi")
def j4_annotator_merge(spark, d):
    a, b = truth(spark, d), guesses(spark, d)
    a = a.select("image_id", F.col("gi").alias("id"), F.col("text").alias("side1"), (F.col("score") > 0.05).alias("h1"))
    b = b.select("image_id", F.col("pi").alias("id"), F.col("text").alias("side2"), (F.col("score") > 0.05).alias("h2"))
    return a.join(b, ["image_id", "id"], "full_outer").select("image_id", "id", "side1", "side2", F.coalesce("h1", "h2").alias("has_text"))


@query("SELECT l_orderkey AS image_id, l_linenumber AS line FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j7_tag_filter(spark, d):
    images = _orders(spark, d, F.col("o_orderkey").alias("image_id"), F.col("o_orderpriority").alias("tag"))
    notes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("line"))
    return curation.tag_filter(images, notes, "image_id", "tag", "1-URGENT")[1]


@query("SELECT o_orderkey AS image_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n, coalesce((SELECT string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS lines FROM orders")
def j8_attached(spark, d):
    images, notes = _orders(spark, d, F.col("o_orderkey").alias("image_id")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("line"))
    own = curation.attached(images, notes, "image_id", ["line"], "line")
    return own.select("image_id", F.size("annotations").cast("long").alias("n"), F.array_join(F.transform("annotations", lambda a: a["line"].cast("string")), ",").alias("lines"))


@query(f"{_W} SELECT coalesce(g.image_id, p.image_id) AS image_id, coalesce(a, 0) AS num_gt, coalesce(b, 0) AS num_pred FROM (SELECT image_id, count(*) AS a FROM gt GROUP BY 1) g FULL JOIN (SELECT image_id, count(*) AS b FROM pred WHERE score > 0.05 GROUP BY 1) p ON g.image_id = p.image_id")
def j9_union_of_keys(spark, d):
    n = lambda df, c: df.groupBy("image_id").agg(F.count("*").alias(c))
    return n(truth(spark, d), "num_gt").join(n(guesses(spark, d).where("score > 0.05"), "num_pred"), "image_id", "full_outer").na.fill(0)


@query(f"{_W}, c AS (SELECT g.image_id, g.gi, p.pi, 1 / (1 + abs(g.x1 - p.x1) + abs(g.y1 - p.y1)) AS closeness FROM gt g JOIN pred p ON g.image_id = p.image_id AND g.text = p.text) SELECT image_id, gi, pi, closeness FROM (SELECT *, row_number() OVER (PARTITION BY image_id, gi ORDER BY closeness DESC, pi) AS r FROM c WHERE closeness > 0.01) WHERE r = 1")
def j11_nearest_same_text(spark, d):
    return curation.nearest_same_text(truth(spark, d), guesses(spark, d), "image_id", "gi", "pi")


@query("SELECT l_orderkey AS image_id, l_linenumber AS line, o_orderpriority AS category FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def j16_category_lookup(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("line"), F.col("o_orderpriority").alias("category"))


@query(f"{_W} SELECT image_id, gi, x1 * 0.5 AS x1, y1 * 0.25 AS y1, round((x1 + x2) / 2 / 160, 4) AS cx, round((y1 + y2) / 2 / 150, 4) AS cy, CASE WHEN least(trunc(x2), 100) > trunc(x1) AND least(trunc(y2), 100) > trunc(y1) THEN (least(trunc(x2), 100) - trunc(x1)) * (least(trunc(y2), 100) - trunc(y1)) ELSE -1.0 END AS crop_area FROM gt")
def p5_scaled_boxes(spark, d):
    b = F.col("box")
    s, c, crop = B.scale(b, F.lit(0.5), F.lit(0.25)), B.centred(b), B.tight_crop(b, F.lit(100), F.lit(100))
    return truth(spark, d).select(*_KEY, s["x1"].alias("x1"), s["y1"].alias("y1"), F.round(c["cx"] / 160, 4).alias("cx"), F.round(c["cy"] / 150, 4).alias("cy"), F.coalesce(B.area(crop), F.lit(-1.0)).alias("crop_area"))


@query(f"{_W} SELECT image_id, string_agg('\"' || text || '\"', ', ' ORDER BY gi) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY gi) AS r FROM gt) WHERE r <= 8 GROUP BY 1")
def p9_prompt(spark, d):
    own = truth(spark, d).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("gi", "text"))).alias("t"))
    return own.select("image_id", T.prompt(F.transform("t", lambda x: x["text"])).alias("prompt"))


@query("SELECT o_orderkey AS image_id, row_number() OVER (ORDER BY o_orderkey) <= count(*) OVER () * 10 // 11 AS train FROM orders")
def p15_leading_share(spark, d):
    return sampling.leading_share(_orders(spark, d, F.col("o_orderkey").alias("image_id")), ["image_id"], 10, 11)


@query(f"{_W} SELECT image_id, gi, x1 + 0.5 AS k0, y1 + 0.5 AS k1, 2.0 AS k2, x2 + 0.5 AS k3 FROM gt")
def p20_keypoint_shift(spark, d):
    b = F.col("box")
    k = B.shifted_keypoints(F.array(b["x1"], b["y1"], F.lit(2.0), b["x2"]))
    return truth(spark, d).select(*_KEY, *[k[i].alias(f"k{i}") for i in range(4)])


@query(f"{_W} SELECT image_id, gi FROM gt WHERE score >= 0.05 AND x2 - x1 > 1e-5 AND y2 - y1 > 1e-5 AND x1 >= -1 AND y1 >= -1 AND x2 <= 131 AND y2 <= 131")
def f3_kept_instances(spark, d):
    b = F.col("box")
    return truth(spark, d).where((F.coalesce("score", F.lit(0.0)) >= 0.05) & B.non_empty(b, 1e-5) & B.within(b, F.lit(130), F.lit(130), 1.0)).select(*_KEY)


@query(f"{_W}, w AS (SELECT image_id, a.x, b.y FROM (SELECT DISTINCT image_id FROM gt), range(0, 81, 40) a(x), range(0, 81, 40) b(y)) SELECT w.image_id, x, y, count(*) FILTER (g.x1 >= x AND g.y1 >= y AND g.x2 <= x + 80 AND g.y2 <= y + 80) AS inside FROM w JOIN gt g USING (image_id) GROUP BY ALL HAVING bool_and((g.x1 >= x AND g.y1 >= y AND g.x2 <= x + 80 AND g.y2 <= y + 80) OR NOT (g.x1 < x + 80 AND x < g.x2 AND g.y1 < y + 80 AND y < g.y2)) AND inside BETWEEN 1 AND 50")
def f6_valid_crops(spark, d):
    images = truth(spark, d).groupBy("image_id").agg(F.collect_list("box").alias("boxes")).withColumn("width", F.lit(160)).withColumn("height", F.lit(160))
    crops = curation.sliding_windows(images, 80, 40).withColumn("region", B.box(F.col("x"), F.col("y"), F.col("x") + 80, F.col("y") + 80))
    inside = F.size(F.filter("boxes", lambda b: B.contains(F.col("region"), b))).cast("long")
    return crops.where(curation.cuts_no_box(F.col("region"), F.col("boxes")) & inside.between(1, 50)).select("image_id", "x", "y", inside.alias("inside"))


@query(f"{_W} SELECT p.image_id, p.pi FROM pred p WHERE EXISTS (SELECT 1 FROM gt g WHERE g.image_id = p.image_id AND g.score < 0.03 AND greatest(least(g.x2, p.x2) - greatest(g.x1, p.x1), 0) * greatest(least(g.y2, p.y2) - greatest(g.y1, p.y1), 0) / ((p.x2 - p.x1) * (p.y2 - p.y1)) > 0.5)")
def f16_not_cared_for(spark, d):
    off, p = truth(spark, d).where("score < 0.03").select("image_id", F.col("box").alias("a")), guesses(spark, d)
    return p.join(off, "image_id").where(B.ioa(F.col("a"), F.col("box")) > 0.5).select("image_id", "pi").distinct()


@query("SELECT doc_id, regexp_matches(split_part(text, ' ', 1), '^[A-Za-z0-9_]+$') AS plain, length(text) <= 200 AS short FROM documents WHERE text IS NOT NULL")
def f18_word_flags(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", " ")[0].rlike("^[A-Za-z0-9_]+$").alias("plain"), (F.length("text") <= 200).alias("short"))


@query(f"{_W}, {_SIDE} SELECT count(*) AS n, round(avg((text = guess)::INT), 9) AS accuracy, sum(levenshtein(text, guess))::BIGINT AS edits, round(avg(1 - levenshtein(text, guess) / greatest(length(text), length(guess), 1)), 9) AS ned FROM side")
def a43_recognition(spark, d):
    a, b = F.col("text"), F.col("guess")
    return _side_by_side(spark, d).agg(F.count("*").alias("n"), F.round(F.avg((a == b).cast("int")), 9).alias("accuracy"), F.sum(F.levenshtein(a, b)).alias("edits"), F.round(F.avg(T.ned(a, b)), 9).alias("ned"))


@query(f"{_W}, {_SIDE}, s AS (SELECT image_id, gi, len(list_intersect(list_distinct(string_split(text, '')), list_distinct(string_split(guess, '')))) AS nb, len(list_distinct(string_split(text, ''))) AS a, len(list_distinct(string_split(guess, ''))) AS b FROM side) SELECT image_id, gi, round(2 * (nb / (b + 1e-5)) * (nb / (a + 1e-5)) / (nb / (b + 1e-5) + nb / (a + 1e-5) + 1e-5), 9) AS f FROM s")
def a45_character_f(spark, d):
    return _side_by_side(spark, d).select(*_KEY, F.round(T.character_f(F.col("text"), F.col("guess")), 9).alias("f"))


@query(f"{_W} SELECT image_id, product(1 - gi / 16) AS confidence FROM gt GROUP BY 1")
def a46_confidence(spark, d):
    return truth(spark, d).groupBy("image_id").agg(F.collect_list(1 - F.col("gi") / 16).alias("s")).select("image_id", T.confidence(F.col("s")).alias("confidence"))


@query("SELECT o_orderpriority AS tag, count(*) AS n FROM orders GROUP BY 1")
def a50_tag_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("tag")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT DISTINCT l_orderkey % 3 AS source, l_orderkey AS image_id, l_suppkey % 50 AS cat FROM lineitem), t AS (SELECT source, count(DISTINCT image_id) AS total FROM x GROUP BY 1),
f AS (SELECT source, cat, greatest(1.0, sqrt(0.3 / (count(*) / any_value(total)))) AS factor FROM x JOIN t USING (source) GROUP BY 1, 2), b AS (SELECT source, image_id, max(factor) * CASE source WHEN 0 THEN 2.0 WHEN 1 THEN 0.5 ELSE 1.0 END AS factor FROM x JOIN f USING (source, cat) GROUP BY 1, 2)
SELECT source, image_id, round(factor / (SELECT min(factor) FROM b), 9) AS factor FROM b""")
def a22_dataset_repeat_factors(spark, d):
    df = table(spark, d, "lineitem").select((F.col("l_orderkey") % 3).alias("source"), F.col("l_orderkey").alias("image_id"), (F.col("l_suppkey") % 50).alias("cat"))
    weights = spark.createDataFrame([(0, 2.0), (1, 0.5)], "source long, weight double")
    return sampling.dataset_repeat_factors(df, "source", "image_id", "cat", weights, 0.3).select("source", "image_id", F.round("factor", 9).alias("factor"))


@query("SELECT l_suppkey % 50 AS cat, round(pow(count(*), -0.5), 12) AS weight FROM lineitem GROUP BY 1")
def a23_class_weights(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("cat")).agg(F.round(F.pow(F.count("*"), F.lit(-0.5)), 12).alias("weight"))


@query(f"""{_W}, o AS (SELECT *, gi % 2 AS cls, row_number() OVER (PARTITION BY image_id, gi % 2 ORDER BY score DESC, gi) AS rn FROM gt),
st AS (SELECT image_id, cls, rn, [rn] AS kept, true AS ok FROM o WHERE rn = 1
 UNION ALL SELECT image_id, cls, rn, CASE WHEN ok THEN list_append(kept, rn) ELSE kept END, ok FROM (SELECT c.image_id, c.cls, c.rn, s.kept, NOT EXISTS (SELECT 1 FROM o k WHERE k.image_id = c.image_id AND k.cls = c.cls AND list_contains(s.kept, k.rn) AND {_iou('k', 'c')} > 0.3) AS ok FROM st s JOIN o c ON c.image_id = s.image_id AND c.cls = s.cls AND c.rn = s.rn + 1))
SELECT image_id, cls, gi, score FROM o JOIN st USING (image_id, cls, rn) WHERE st.ok""")
def w2_suppress_by_class(spark, d):
    return matching.suppress(truth(spark, d).withColumn("cls", F.col("gi") % 2), 0.3, ["image_id", "cls"]).select("image_id", "cls", "gi", "score")


@query(f"{_W} SELECT image_id, round(0.7 * least(1.0, count(*) / 10) + CASE WHEN count(*) > 1 THEN 0.3 * (max(x2) - min(x1)) / 160 ELSE 0 END, 9) AS score FROM gt GROUP BY 1")
def w5_crop_scores(spark, d):
    spread = (F.max("box.x2") - F.min("box.x1")) / 160
    return truth(spark, d).groupBy("image_id").agg(F.round(curation.crop_score(F.count("*"), spread), 9).alias("score"))


@query("SELECT o_orderkey AS image_id FROM orders ORDER BY o_orderkey LIMIT 500")
def w14_first_rows(spark, d):
    return _orders(spark, d, F.col("o_orderkey").alias("image_id")).orderBy("image_id").limit(500)


@query("SELECT o_orderkey AS image_id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 12 AS page FROM orders")
def w19_pages(spark, d):
    return sampling.place_in_order(_orders(spark, d, F.col("o_orderkey").alias("image_id")), ["image_id"]).select("image_id", F.expr("place div 12").alias("page"))


@query("SELECT max_by(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS latest, o_custkey AS run FROM orders GROUP BY 2")
def w20_latest(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query(f"{_W} SELECT image_id FROM gt UNION SELECT image_id FROM pred")
def u1_key_union(spark, d):
    return truth(spark, d).select("image_id").union(guesses(spark, d).select("image_id")).distinct()


@query(f"{_W} SELECT 'im' || image_id AS name FROM gt EXCEPT SELECT 'im' || image_id FROM pred WHERE score >= 0.05")
def u5_name_difference(spark, d):
    name = F.concat(F.lit("im"), "image_id").alias("name")
    return truth(spark, d).select(name).distinct().join(guesses(spark, d).where("score >= 0.05").select(name), "name", "left_anti")


@query(f"{_W} SELECT (o - 1) // 4 AS batch, wide, image_id, gi FROM (SELECT image_id, gi, x2 > 100 AS wide, row_number() OVER (PARTITION BY x2 > 100, image_id % 16 ORDER BY image_id, gi) AS o, count(*) OVER (PARTITION BY x2 > 100, image_id % 16) AS n FROM gt) WHERE ((o - 1) // 4 + 1) * 4 <= n")
def b6_aspect_batches(spark, d):
    gt = truth(spark, d).select("image_id", "gi", (F.col("box.x2") > 100).alias("wide"), (F.col("image_id") % 16).alias("g"))
    return sampling.full_batches(gt, ["wide", "g"], _KEY, 4).select("batch", "wide", "image_id", "gi")


@query(f"{_W}, {_SIDE} SELECT image_id, gi, text = guess OR ('' || guess = substr(text, 2) AND contains('w0', substr(text, 1, 1))) OR (guess = left(text, length(text) - 1) AND contains('w0', right(text, 1))) OR (length(text) > 1 AND guess = substr(text, 2, length(text) - 2) AND contains('w0', substr(text, 1, 1)) AND contains('w0', right(text, 1))) AS same FROM side")
def t12_edge_match(spark, d):
    return _side_by_side(spark, d).select(*_KEY, T.same_but_edges(F.col("text"), F.col("guess"), "w0").alias("same"))


@query("SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE -1 END AS chunk FROM orders")
def t25_chunk_numbers(spark, d):
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("chunk_"), F.col("o_custkey"))).otherwise(F.concat(F.lit("chunk"), F.col("o_custkey")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.coalesce(T.chunk_number(name), F.lit(-1)).alias("chunk"))


@query(f"{_W} SELECT image_id, gi, true AS clockwise, (x2 - x1)::BIGINT AS run FROM gt")
def g14_clockwise(spark, d):
    b = F.col("box")
    right = B.clockwise(F.array(b["x1"], b["x2"], b["x2"], b["x1"]), F.array(b["y1"], b["y1"], b["y2"], b["y2"]))
    return truth(spark, d).select(*_KEY, right.alias("clockwise"), B.rle_area(F.array(b["x1"].cast("long"), (b["x2"] - b["x1"]).cast("long"), F.lit(7).cast("long"))).alias("run"))


#: Polygons of five kinds: clockwise, reversed, with crossing sides, on a line, and moved to where some leave the image.
_FOUR = """q AS (SELECT image_id, gi, CASE gi % 5 WHEN 0 THEN [[x1, y1], [x2, y1], [x2, y2], [x1, y2]] WHEN 1 THEN [[x1, y2], [x2, y2], [x2, y1], [x1, y1]] WHEN 2 THEN [[x1, y1], [x2, y2], [x2, y1], [x1, y2]] WHEN 3 THEN [[x1, y1], [x2, y2], [(x1 + x2) / 2, (y1 + y2) / 2], [x1, y1]] ELSE [[x1 - 50, y1], [x2 - 50, y1], [x2 - 40, y2], [x1 - 45, y2]] END AS p FROM gt)"""


def _turn_sql(a: int, b: int, c: int) -> str:
    return f"sign((p[{b}][1] - p[{a}][1]) * (p[{c}][2] - p[{a}][2]) - (p[{b}][2] - p[{a}][2]) * (p[{c}][1] - p[{a}][1]))"


def _meet_sql(a: int, b: int, c: int, d: int) -> str:
    on = lambda x, y, z: f"({_turn_sql(x, y, z)} = 0 AND p[{z}][1] BETWEEN least(p[{x}][1], p[{y}][1]) AND greatest(p[{x}][1], p[{y}][1]) AND p[{z}][2] BETWEEN least(p[{x}][2], p[{y}][2]) AND greatest(p[{x}][2], p[{y}][2]))"
    return f"(({_turn_sql(a, b, c)} <> {_turn_sql(a, b, d)} AND {_turn_sql(c, d, a)} <> {_turn_sql(c, d, b)}) OR {on(a, b, c)} OR {on(a, b, d)} OR {on(c, d, a)} OR {on(c, d, b)})"


_FLAT = " AND ".join(f"{_turn_sql(k % 4 + 1, (k + 1) % 4 + 1, (k + 2) % 4 + 1)} = 0" for k in range(4))
_AROUND = " + ".join(f"(p[{k}][1] * p[{k % 4 + 1}][2] - p[{k % 4 + 1}][1] * p[{k}][2])" for k in range(1, 5))


@query(f"{_W}, {_FOUR} SELECT image_id, gi, CASE WHEN list_min(list_transform(p, lambda v: v[1])) < 0 OR list_max(list_transform(p, lambda v: v[1])) > 160 OR list_max(list_transform(p, lambda v: v[2])) > 150 THEN 'outside' WHEN {_FLAT} THEN 'line' WHEN {_meet_sql(1, 2, 3, 4)} OR {_meet_sql(2, 3, 4, 1)} THEN 'crossing' WHEN {_AROUND} <= 0 THEN 'counterclockwise' END AS refused FROM q")
def g14_refused_polygons(spark, d):
    b, kind = F.col("box"), F.col("gi") % 5
    x1, y1, x2, y2 = (b[k] for k in ("x1", "y1", "x2", "y2"))
    line = lambda *points: F.concat_ws(",", *[v.cast("string") for p in points for v in p], F.lit("####x"))
    drawn = F.when(kind == 0, line((x1, y1), (x2, y1), (x2, y2), (x1, y2))).when(kind == 1, line((x1, y2), (x2, y2), (x2, y1), (x1, y1))).when(kind == 2, line((x1, y1), (x2, y2), (x2, y1), (x1, y2)))
    drawn = drawn.when(kind == 3, line((x1, y1), (x2, y2), ((x1 + x2) / 2, (y1 + y2) / 2), (x1, y1))).otherwise(line((x1 - 50, y1), (x2 - 50, y1), (x2 - 40, y2), (x1 - 45, y2)))
    return readers.checked_lines(truth(spark, d).select(*_KEY, drawn.alias("value")), 160.0, 150.0).select(*_KEY, "refused")


_BY_NAME = "cats AS (SELECT o AS gi, 'n' || (o % 4) AS name FROM (SELECT DISTINCT o FROM lines) WHERE o <= 6), named AS (SELECT name, row_number() OVER (ORDER BY name) AS new_id FROM (SELECT DISTINCT name FROM cats))"


@query(f"{_W}, {_BY_NAME} SELECT image_id, new_id AS cat, count(*) AS n FROM gt JOIN cats USING (gi) JOIN named USING (name) GROUP BY 1, 2")
def q15_renumbered(spark, d):
    notes = truth(spark, d).select("image_id", F.col("gi").alias("cat"))
    names = notes.select("cat").distinct().where("cat <= 6").select("cat", F.concat(F.lit("n"), F.col("cat") % 4).alias("name"))
    return curation.renumbered(notes, names, "cat", "name")[1].groupBy("image_id", F.col("cat").cast("long").alias("cat")).agg(F.count("*").alias("n"))


@query(f"{_W} SELECT image_id, (gi - 1) // 3 AS batch, count(*) AS filled, min(text) FILTER ((gi - 1) % 3 = 0) AS first FROM gt GROUP BY 1, 2")
def q12_padded_groups(spark, d):
    own = sampling.padded_groups(truth(spark, d), "image_id", ["gi"], 3, ["text"])
    return own.select("image_id", "batch", F.size(F.filter("members", lambda m: m.isNotNull())).cast("long").alias("filled"), F.col("members")[0]["text"].alias("first"))


@query(f"{_W} SELECT image_id, gi, score FROM gt WHERE score >= 0.08")
def q13_score_filter(spark, d):
    return truth(spark, d).where(F.col("score") >= 0.08).select("image_id", "gi", "score")


@query(f"{_W} SELECT image_id, gi FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY gi DESC) AS r FROM gt) WHERE r <= 2")
def q14_last_frames(spark, d):
    return sampling.chosen_frames(truth(spark, d), "image_id", "gi", 2, "last").select("image_id", "gi")


@query(r"""SELECT word, regexp_matches(c, '^[a-zA-Z\x{00C0}-\x{01BF}\x{01C4}-\x{027F}\x{0386}-\x{03FF}-]{3,}$') AND NOT regexp_matches(c, '[\x{00D7}\x{00F7}]') AS included FROM (SELECT word, trim(regexp_replace(trim(CASE WHEN regexp_matches(word, '''[sS]$') THEN left(word, length(word) - 2) ELSE word END, '-'), '[''!?.:,*"()\x{00B7}\[\]/]', ' ', 'g')) AS c FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents))""")
def f15_dictionary_words(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words.select("word", T.in_dictionary(F.col("word")).alias("included"))
