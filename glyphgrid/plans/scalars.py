"""Queries of single functions, filters, trackers' joins, outside functions and evaluators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import box as B
from ..functions import text as T
from ..operators import curation, datasets, matching, providers, sampling, selector
from ..sources import readers, sinks
from ..streaming import events, metric_log
from .detection import _W, _iou
from .files import _folder
from .registered import registrar
from .views import guesses, table, truth

QUERIES, ORACLE, query = registrar()

_WORDS = "w AS (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM documents WHERE text IS NOT NULL)"


def _words(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_replace("text", "[^ -~]", "").alias("t"))


def _side(spark, d):
    return truth(spark, d).join(guesses(spark, d).select("image_id", F.col("pi").alias("gi"), F.col("text").alias("guess")), ["image_id", "gi"])


_SIDE = "side AS (SELECT g.image_id, g.gi, g.text, p.text AS guess FROM gt g JOIN pred p ON p.image_id = g.image_id AND p.pi = g.gi)"


@query(f"WITH {_WORDS} SELECT doc_id, md5(trim(regexp_replace('fi  ' || t, '\\s+', ' ', 'g'))) AS h FROM w")
def t1_normalised(spark, d):
    return _words(spark, d).select("doc_id", F.md5(T.normalise(F.concat(F.lit("ﬁ  "), "t")).cast("binary")).alias("h"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN true ELSE o_orderstatus = 'F' END AS same FROM orders")
def t5_same_casefold(spark, d):
    k = F.col("o_orderkey") % 3
    a = F.when(k == 0, "Straße").when(k == 1, "ÀB").otherwise(F.lower("o_orderstatus"))
    b = F.when(k == 0, "STRASSE").when(k == 1, "àb").otherwise("F")
    return table(spark, d, "orders").select("o_orderkey", (T.casefold(a) == T.casefold(b)).alias("same"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber || ',' || (l_suppkey % 5 + 10) || ',' || l_linenumber AS codes FROM lineitem")
def t9_ctc_decode(spark, d):
    a, b, z = F.col("l_linenumber").cast("long"), (F.col("l_suppkey") % 5 + 10).cast("long"), F.lit(0).cast("long")
    codes = T.ctc_decode(F.array(a, a, z, b, b, b, z, z, a))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(codes, lambda c: c.cast("string")), ",").alias("codes"))


@query(f"{_W}, {_SIDE}, v AS (SELECT image_id, gi, 1 - levenshtein(text, guess) / greatest(length(text), length(guess), 1) AS v FROM side) SELECT image_id, gi, round(CASE WHEN v < 0.5 THEN 0.0 ELSE v END, 8) AS anls FROM v")
def t16_anls(spark, d):
    return _side(spark, d).select("image_id", "gi", F.round(T.anls(F.concat(F.lit(" "), F.upper("text")), F.col("guess")), 8).alias("anls"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'b' || chr(10) || 'c' WHEN 1 THEN 'only' ELSE '' END AS rest FROM orders")
def t22_without_lines(spark, d):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, "a\nb\nc").when(k == 1, "only").otherwise("a\n")
    return table(spark, d, "orders").select("o_orderkey", T.without_lines(text, 1).alias("rest"))


@query("SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'im' || o_custkey ELSE 'a/b.c/im' || o_custkey END AS key, CASE o_orderkey % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE '' END AS text FROM orders")
def p2_image_keys(spark, d):
    k = F.col("o_orderkey")
    path = F.when(k % 2 == 0, F.concat(F.lit("train/im"), "o_custkey", F.lit(".jpg"))).otherwise(F.concat(F.lit("a/b.c/im"), "o_custkey", F.lit(".png")))
    given = T.first_given(F.when(k % 3 == 0, "first"), F.when(k % 3 == 1, "second").otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", T.image_key(path).alias("key"), given.alias("text"))


@query(f"{_W} SELECT image_id, gi, CASE gi % 3 WHEN 0 THEN x1 WHEN 1 THEN x1 + y1 ELSE least(x1, y2) END AS x2, y1 AS y FROM gt")
def p4_boxes_of_any_form(spark, d):
    """Boxes from two corners, from corner and size, and from a polygon."""
    b, k = F.col("box"), F.col("gi") % 3
    pair = B.from_pairs(F.array(F.array(b["x2"], b["y1"]), F.array(b["x1"], b["y2"])))
    sized = B.from_xywh(b["x1"], b["y1"], b["y1"], b["y2"])
    around = B.polygon_box(F.array(b["x1"], b["y2"]), F.array(b["y1"], b["y2"]))
    x2 = F.when(k == 0, pair["x2"]).when(k == 1, sized["x2"]).otherwise(around["x1"])
    return truth(spark, d).select("image_id", "gi", x2.alias("x2"), F.when(k == 0, pair["y1"]).when(k == 1, sized["y1"]).otherwise(around["y1"]).alias("y"))


@query(f"{_W} SELECT image_id, gi, CASE WHEN least(x2::INT, 100) > x1::INT AND least(y2::INT, 90) > y1::INT THEN x1::INT::DOUBLE END AS left, CASE WHEN least(x2::INT, 100) > x1::INT AND least(y2::INT, 90) > y1::INT THEN least(y2::INT, 90)::DOUBLE END AS bottom, round((x1 + x2) / 2 / 130, 4) AS cx, round((y2 - y1) / 130, 4) AS h FROM gt")
def p10_tight_crops(spark, d):
    crop = B.tight_crop(F.col("box"), F.lit(100), F.lit(90))
    c = B.centred(F.col("box"))
    return truth(spark, d).select("image_id", "gi", crop["x1"].alias("left"), crop["y2"].alias("bottom"), F.round(c["cx"] / 130, 4).alias("cx"), F.round(c["h"] / 130, 4).alias("h"))


@query(f"{_W} SELECT image_id, gi, gi - 1 AS category FROM gt WHERE gi <= 5")
def p13_shifted_categories(spark, d):
    mapping = spark.createDataFrame([(k, k - 1) for k in range(1, 6)], "source long, target long")
    rows = truth(spark, d).select("image_id", "gi", F.col("gi").alias("category"))
    return curation.remapped(rows, "category", mapping, "source", "target").select("image_id", "gi", "category")


@query(f"{_W} SELECT image_id, gi, x1 || ',' || (60 - y1) || ',' || (x2 - 50) AS edges, x1 >= 10 AND y1 >= 10 AND x2 <= 120 AND y2 <= 120 AS contained, x1 >= -2 AND y1 >= -2 AND x2 <= 122 AND y2 <= 122 AS within, x2 - x1 > 39 AND y2 - y1 > 30 AS large FROM gt")
def g4_box_tests(spark, d):
    b = F.col("box")
    distances = B.edge_distances(F.lit(50.0), F.lit(60.0), b)
    edges = F.concat_ws(",", (50 - distances[0]).cast("string"), distances[1].cast("string"), distances[2].cast("string"))
    return truth(spark, d).select("image_id", "gi", edges.alias("edges"), B.contains(B.box(*map(F.lit, (10, 10, 120, 120))), b).alias("contained"), B.within(b, F.lit(120), F.lit(120), 2.0).alias("within"), (B.non_empty(b, 39.0) & (b["y2"] - b["y1"] > 30)).alias("large"))


@query(f"{_W} SELECT image_id, gi, greatest(x1, y1) AS x1, least(x1, x2 - 50) AS low FROM gt")
def g11_polygon_boxes(spark, d):
    b = F.col("box")
    around = B.polygon_box(F.array(b["x2"] - 50, b["x1"]), F.array(b["y1"], b["y2"]))
    return truth(spark, d).select("image_id", "gi", F.greatest(b["x1"], b["y1"]).alias("x1"), around["x1"].alias("low"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS n FROM orders")
def f20_options(spark, d):
    k = F.col("o_orderkey") % 3
    options = F.when(k == 0, F.array(F.lit("a"), F.lit("b"), F.lit("NaN"), F.lit("d"))).when(k == 1, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit(None).cast("string"), F.lit("b")))
    return table(spark, d, "orders").select("o_orderkey", F.size(T.until_blank_option(options)).alias("n"))


@query(f"{_W} SELECT image_id, gi FROM gt WHERE gi % 4 <> 1")
def f2_valid_boxes(spark, d):
    """Annotations with a box of four values."""
    b = F.col("box")
    rows = truth(spark, d).select("image_id", "gi", F.when(F.col("gi") % 4 == 1, F.array(b["x1"], b["y1"])).otherwise(F.array(b["x1"], b["y1"], b["x2"], b["y2"])).alias("bbox"))
    return rows.where(F.size("bbox") == 4).select("image_id", "gi")


@query(f"{_W} SELECT image_id, gi, CASE gi % 4 WHEN 0 THEN 2 ELSE 1 END AS n FROM gt WHERE gi % 4 <> 3")
def f12_valid_polygons(spark, d):
    b, k = F.col("box"), F.col("gi") % 4
    whole, odd, short = F.array(b["x1"], b["y1"], b["x2"], b["y1"], b["x2"], b["y2"]), F.array(*[b["x1"]] * 7), F.array(*[b["x1"]] * 4)
    polygons = F.when(k == 0, F.array(whole, whole)).when(k == 1, F.array(whole, odd)).when(k == 2, F.array(short, whole)).otherwise(F.array(short, odd))
    rows = truth(spark, d).select("image_id", "gi", F.size(B.valid_polygons(polygons)).alias("n"))
    return rows.where("n > 0")


@query(f"{_W} SELECT image_id, count(*) AS n FROM gt GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4")
def f8_bounded_counts(spark, d):
    return truth(spark, d).groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n").between(2, 4))


@query(f"{_W} SELECT image_id, bool_or(gi % 3 > 0) AS own, sum(CASE WHEN gi % 2 = 0 THEN 2 ELSE 1 END)::INT AS visible FROM gt GROUP BY 1")
def f10_own_instances(spark, d):
    note = F.struct((F.col("gi") % 3 == 0).cast("int").alias("is_crowd"), F.array(F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(0.0), F.lit(5.0), F.when(F.col("gi") % 2 == 0, 1.0).otherwise(0.0)).alias("keypoints"))
    rows = truth(spark, d).groupBy("image_id").agg(F.collect_list(note).alias("a"))
    return rows.select("image_id", datasets.has_own_instance(F.col("a")).alias("own"), datasets.visible_keypoints(F.col("a")).cast("int").alias("visible"))


@query(f"{_W} SELECT o_orderkey AS image_id, count(pi) AS n, coalesce(max(score), -1.0) AS best FROM orders LEFT JOIN pred ON image_id = o_orderkey GROUP BY 1")
def j27_attached_proposals(spark, d):
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    out = datasets.with_proposals(images, guesses(spark, d).select("image_id", "score", "box"), "image_id")
    return out.select("image_id", F.size("proposals").cast("long").alias("n"), F.coalesce(F.get(F.col("proposals"), F.lit(0))["score"], F.lit(-1.0)).alias("best"))


@query("SELECT l_orderkey AS image_id FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity = 17")
def q2_equality(spark, d):
    return selector.select(table(spark, d, "lineitem"), "l_returnflag=A,l_linestatus=F,l_quantity:int=17").select(F.col("l_orderkey").alias("image_id"))


@query("SELECT l_orderkey AS image_id, l_linenumber AS line FROM lineitem WHERE l_linenumber BETWEEN 2 AND 3 AND l_discount BETWEEN 0.05 AND 0.07")
def q3_ranges(spark, d):
    return selector.select(table(spark, d, "lineitem"), "l_linenumber:int=2-3,l_discount:float=0.05-0.07").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("line"))


@query("SELECT o_orderkey FROM orders")
def q4_match_all(spark, d):
    return selector.select(table(spark, d, "orders"), "*").select("o_orderkey")


@query("SELECT o_orderkey AS id FROM orders ORDER BY md5('9:' || o_orderkey), o_orderkey LIMIT (SELECT (count(*) * 0.3)::INT FROM orders)")
def b2_subset(spark, d):
    return sampling.subset(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", 0.3, 9)


@query("SELECT id, unnest(range(1, greatest(floor(f) + (('0x' || substr(md5('2:' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < f - floor(f))::INT, 1)::INT + 1))::INT AS copy FROM (SELECT o_orderkey AS id, 0.5 + o_custkey % 10 * 0.27::DOUBLE AS f FROM orders)")
def b3_stochastic_repeats(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.lit(0.5) + F.col("o_custkey") % 10 * F.lit(0.27)).alias("f"))
    return sampling.stochastic_repeats(rows, "f", "id", 2).select("id", "copy")


_FRAMES = "fr AS (SELECT image_id // 8 AS video, image_id % 8 AS frame, gi, x1 * 0.25 AS x1, y1 * 0.25 AS y1, x1 * 0.25 + 90 AS x2, y1 * 0.25 + 80 AS y2 FROM gt)"


@query(f"""{_W}, {_FRAMES}, pairs AS (SELECT b.video, b.frame, a.gi, b.gi AS pi, {_iou('a', 'b')} AS iou FROM fr a JOIN fr b ON b.video = a.video AND b.frame = a.frame + 1 WHERE {_iou('a', 'b')} >= 0.5),
rk AS (SELECT *, row_number() OVER (PARTITION BY video, frame ORDER BY iou DESC, gi DESC, pi DESC) AS rn FROM pairs),
step AS (SELECT video, frame, rn, [gi] AS ug, [pi] AS up, true AS take FROM rk WHERE rn = 1
 UNION ALL SELECT r.video, r.frame, r.rn, CASE WHEN ok THEN list_append(ug, r.gi) ELSE ug END, CASE WHEN ok THEN list_append(up, r.pi) ELSE up END, ok
 FROM (SELECT r.*, s.ug, s.up, NOT list_contains(s.ug, r.gi) AND NOT list_contains(s.up, r.pi) AS ok FROM step s JOIN rk r ON r.video = s.video AND r.frame = s.frame AND r.rn = s.rn + 1) r)
SELECT video, frame, gi AS before, pi AS now, round(iou, 8) AS iou FROM rk JOIN step USING (video, frame, rn) WHERE take""")
def j26_tracking_join(spark, d):
    b = F.col("box")
    boxes = truth(spark, d).select(F.expr("image_id div 8").alias("video"), (F.col("image_id") % 8).alias("frame"), "gi", B.box(b["x1"] * 0.25, b["y1"] * 0.25, b["x1"] * 0.25 + 90, b["y1"] * 0.25 + 80).alias("box"))
    return matching.frame_pairs(boxes, "video", "frame", 0.5).withColumn("iou", F.round("iou", 8))


@query(f"""{_W}, o AS (SELECT image_id, gi, score, x1, y1, x2, y2, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, gi) AS rn FROM gt),
st AS (SELECT image_id, rn, [rn] AS kept, true AS ok FROM o WHERE rn = 1
 UNION ALL SELECT image_id, rn, CASE WHEN ok THEN list_append(kept, rn) ELSE kept END, ok FROM (SELECT c.image_id, c.rn, s.kept, len(s.kept) < 3 AND NOT EXISTS (SELECT 1 FROM o k WHERE k.image_id = c.image_id AND list_contains(s.kept, k.rn) AND ({_iou('k', 'c')} > 0.1 OR k.gi % 4 = c.gi % 4)) AS ok FROM st s JOIN o c ON c.image_id = s.image_id AND c.rn = s.rn + 1))
SELECT o.image_id, o.gi AS crop_id, (row_number() OVER (PARTITION BY image_id ORDER BY rn) - 1)::INT AS place, score FROM o JOIN st USING (image_id, rn) WHERE st.ok""")
def w4_diverse_crops(spark, d):
    crops = truth(spark, d).select("image_id", F.col("gi").alias("crop_id"), "score", "box", F.array(F.col("gi") % 4).alias("members"))
    return curation.diverse_top(crops, "image_id", 3, 0.1).select("image_id", "crop_id", F.col("place").cast("int").alias("place"), "score")


@query("SELECT p_partkey % 12 AS id, 'c' || p_partkey % 3 AS name, (p_partkey % 40)::DOUBLE AS xmin, (p_partkey % 40 + 21)::DOUBLE AS xmax FROM part WHERE p_partkey <= 60")
def s18_voc_objects(spark, d):
    path = _folder(spark)
    own = table(spark, d, "part").where("p_partkey <= 60").select((F.col("p_partkey") % 12).alias("id"), F.format_string("<object><name>c%d</name><bndbox><xmin>%d</xmin><ymin>1</ymin><xmax>%d</xmax><ymax>9</ymax></bndbox></object>", F.col("p_partkey") % 3, F.col("p_partkey") % 40 + 1, F.col("p_partkey") % 40 + 21).alias("o"))
    whole = own.groupBy("id").agg(F.concat(F.lit("<annotation>"), F.array_join(F.collect_list("o"), ""), F.lit("</annotation>")).alias("value"))
    whole.repartition("id").write.partitionBy("id").text(path)
    parts = [readers.voc_objects(spark, f"{path}/id={k}").withColumn("id", F.lit(k).cast("long")) for k in range(12)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("id", "name", "xmin", "xmax")


@query("SELECT o_custkey AS question_id, max(o_orderkey) AS turn FROM orders GROUP BY 1")
def s27_answers(spark, d):
    path = _folder(spark)
    table(spark, d, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("turn"), F.col("o_orderpriority").alias("text")).write.json(path)
    return readers.questions(spark, path, "question_id", "turn").select("question_id", "turn")


@query("SELECT 'im' || o_orderkey AS image_id FROM orders")
def s34_image_ids(spark, d):
    path = _folder(spark)
    own = table(spark, d, "orders").select(F.concat(F.lit(" im"), "o_orderkey", F.lit(", x, y")).alias("v"))
    own.unionByName(spark.createDataFrame([("# comment",), ("",)], "v string")).write.text(path)
    return readers.id_filter(spark, path)


@query(f"{_W} SELECT image_id, gi, '[' || x1 || ',' || y1 || ']' AS corner FROM gt")
def k3_annotation_csv(spark, d):
    path = _folder(spark)
    sinks.write_csv(truth(spark, d).select("image_id", "gi", F.array("box.x1", "box.y1").alias("corner")), path)
    return spark.read.csv(path, header=True, schema="image_id bigint, gi bigint, corner string", escape='"')


@query("SELECT string_agg('| ' || f || ' | ' || n || ' | ' || printf('%.4f', q) || ' |', chr(10) ORDER BY f) AS body, 5 AS lines FROM (SELECT l_returnflag AS f, count(*) AS n, avg(l_quantity::DOUBLE) AS q FROM lineitem GROUP BY 1)")
def k11_report(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.avg(F.col("l_quantity").cast("double")).alias("mean")).orderBy("flag")
    text = sinks.markdown_table(rows).split("\n")
    return spark.createDataFrame([("\n".join(text[2:]), len(text))], "body string, lines int")


@query("""WITH e AS (SELECT event_type || (user_id % 10) AS metric, event_id // 40 AS iteration, value, event_id FROM events), l AS (SELECT metric, iteration, arg_max(value, event_id) AS value FROM e GROUP BY ALL)
SELECT metric, iteration, value, round(median(value) OVER (PARTITION BY metric ORDER BY iteration ROWS 19 PRECEDING), 9) AS median FROM l""")
def x2_newer_events(spark, d):
    """Events in three parts, each of which begins with a share of the one before, go through a query that is started anew for each."""
    own = table(spark, d, "events").select(F.concat("event_type", F.col("user_id") % 10).alias("metric"), F.expr("event_id div 40").alias("iteration"), "value", F.lit(True).alias("smooth"), F.col("event_id").alias("arrived"))
    top = own.agg(F.max("iteration")).first()[0] or 0
    folder = _folder(spark)
    for k in range(3):
        part = own.where(F.col("iteration").between(max(0, (2 * k - 1) * top // 6 + 1) if k else 0, (k + 1) * top // 3 if k < 2 else top))
        part.write.mode("append").parquet(f"{folder}/in")
        metric_log.append_metrics(events.read_events(spark, f"{folder}/in", own.schema), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("metric", "iteration", "value", F.round("median", 9).alias("median"))


@query("SELECT 'counts' AS evaluator, 'n' AS measure, count(*)::DOUBLE AS value FROM lineitem UNION ALL SELECT 'quantity', 'mean', round(avg(l_quantity::DOUBLE), 6) FROM lineitem")
def x6_evaluators(spark, d):
    """Two evaluators over three parts of a table: partial sums of each part, merged at the end."""
    count = providers.Evaluation(lambda t: t.agg(F.count("*").alias("n")), lambda p: p.agg(F.sum("n").alias("n")))
    mean = providers.Evaluation(lambda t: t.agg(F.sum(F.col("l_quantity").cast("double")).alias("s"), F.count("*").alias("n")), lambda p: p.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("mean")))
    both = providers.Evaluations({"counts": count, "quantity": mean})
    both.reset()
    rows = table(spark, d, "lineitem")
    for k in range(3):
        both.process(rows.where(F.col("l_orderkey") % 3 == k))
    return both.evaluate()


@query("SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey * 2 ELSE -1 END AS result FROM orders ORDER BY 1")
def x7_in_sequence(spark, d):
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"))
    results = table(spark, d, "orders").where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("ord"), (F.col("o_custkey") * 2).alias("result")).repartition(3)
    return providers.in_sequence(asked, results, "ord").na.fill(-1, ["result"])


@query("SELECT o_orderkey || '.jpg' AS file_name, k AS ord, 'w' || k AS text, k * 10.0::DOUBLE AS x, 0.5::DOUBLE AS score FROM orders, range(3) r(k) WHERE k < o_orderkey % 4")
def y1_spotter(spark, d):
    images = table(spark, d, "orders").select(F.concat("o_orderkey", F.lit(".jpg")).alias("file_name"))
    out = providers.spotted(images, lambda name: [(f"w{k}", [k * 10.0, 0.0, 1.0, 1.0], 0.5) for k in range(min(3, int(name[:-4]) % 4))])
    return out.select("file_name", "ord", "text", F.col("bbox")[0].alias("x"), "score")


@query("SELECT id, path, id % 2 = 0 AS has_text, CASE WHEN id % 2 = 0 THEN upper(path) ELSE '' END AS \"VLM\" FROM (SELECT o_orderkey AS id, 'p' || o_orderkey AS path FROM orders WHERE o_orderkey % 3 > 0)")
def y2_two_stage_reader(spark, d):
    crops = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("p"), "o_orderkey")).alias("path"))
    return providers.recognised(crops, lambda p: int(p[1:]) % 2 == 0, str.upper)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'Error: Processing Failed' ELSE 'level ' || o_orderkey % 4 END AS label FROM orders")
def y3_classifier(spark, d):
    def level(path: str) -> str:
        if int(path) % 4 == 0:
            raise OSError("no such image")
        return f"level {int(path) % 4}"

    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("path"))
    return providers.classified(images, "path", level).select("id", "label")


@query("SELECT o_orderkey AS image_id, 0.25::DOUBLE AS fixed, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::DOUBLE ELSE 0 END AS matched FROM orders")
def y4_reward_backends(spark, d):
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"))
    rows = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("image_id"), F.col("o_custkey").cast("double").alias("final"))
    fixed = providers.reward_backend("constant", value=0.25)(images).withColumnRenamed("reward", "fixed")
    return fixed.join(providers.reward_backend("matched", rows=rows, variant="final")(images).withColumnRenamed("reward", "matched"), "image_id")


@query("SELECT o_orderkey AS id, o_custkey::VARCHAR AS value, 'x' || o_custkey AS mapped FROM orders WHERE o_custkey % 3 > 0")
def y5_mapped_rows(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("value"))
    return providers.mapped_rows(rows, "id", "value", lambda v: f"x{v}" if int(v) % 3 else None)


@query(f"{_W}, {_SIDE} SELECT image_id, gi, upper(text) = upper(guess) AS plain, true AS spaced FROM side")
def q20_spaced_match(spark, d):
    """The match of the copy that keeps spaces, and of the one that strips them."""
    spaced = F.concat(F.substring("text", 1, 1), F.lit(" "), F.substring("text", 2, 99))
    same = lambda a, b: F.upper(a) == F.upper(b)
    return _side(spark, d).select("image_id", "gi", same("text", "guess").alias("plain"), same(F.replace(spaced, F.lit(" "), F.lit("")), F.col("text")).alias("spaced"))
