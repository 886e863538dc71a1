"""Queries of document forms over the derived views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curation, documents
from .detection import _W
from .registered import registrar
from .views import guesses, table, truth

QUERIES, ORACLE, query = registrar()


def _bbox(b):
    return F.array(b["x1"], b["y1"], b["x2"], b["y2"])


def _files(spark, d):
    return table(spark, d, "orders").select(F.concat(F.lit("dir/im"), "o_orderkey", F.lit(".x.jpg")).alias("file_name"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("blur_category"), "o_orderkey")


@query(f"""{_W} SELECT 'dir/im' || o_orderkey || '.x.jpg' AS original_image, 'dir/im' || o_orderkey || '.x' AS crop_id, 512 AS side, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE 'Error: Tag Missing' END AS blur_category,
 count(gi) AS n, coalesce(string_agg(CASE WHEN gi = 1 THEN '' ELSE text END || ':' || (CASE WHEN gi = 2 THEN 0 ELSE x2 END)::INT || ':' || (CASE WHEN gi = 3 THEN -1 ELSE gi END), ' ' ORDER BY gi), '') AS instances FROM orders LEFT JOIN gt ON image_id = o_orderkey GROUP BY ALL""")
def p6_final_entries(spark, d):
    notes = truth(spark, d).select(F.concat(F.lit("dir/im"), "image_id", F.lit(".x.jpg")).alias("file_name"), F.col("gi").alias("ord"), F.when(F.col("gi") != 3, F.col("gi")).alias("id"), F.when(F.col("gi") != 1, F.col("text")).alias("text"), F.when(F.col("gi") != 2, _bbox(F.col("box"))).alias("bbox"), "score")
    out = documents.final_entries(_files(spark, d).drop("o_orderkey"), notes, 512)
    shown = F.transform("text_instances", lambda x: F.concat_ws(":", x["text"], x["bbox"][2].cast("int").cast("string"), x["id"].cast("string")))
    return out.select("original_image", "crop_id", F.col("crop_region")[3].alias("side"), "blur_category", F.size("text_instances").cast("long").alias("n"), F.array_join(shown, " ").alias("instances"))


@query(f"{_W} SELECT 'train/' || image_id || '.jpg' AS original_image, CASE WHEN image_id % 2 = 0 AND gi % 3 = 0 THEN 'ref' || image_id || '-' || gi % 3 ELSE image_id || '_crop_' || gi % 3 END AS crop_id, CASE WHEN image_id % 2 = 0 AND gi % 3 = 0 THEN 256 ELSE 512 END AS side, CASE WHEN image_id % 4 = 0 THEN 'Very blurry' ELSE 'Not blurry' END AS blur_category, count(*) AS n, string_agg(text, ' ' ORDER BY gi) AS texts FROM gt GROUP BY image_id, gi % 3")
def p8_unnested(spark, d):
    gt = truth(spark, d).select(F.col("image_id").cast("string").alias("image_id"), (F.col("gi") % 3).cast("string").alias("crop"), "gi", F.struct("text", _bbox(F.col("box")).alias("bbox")).alias("v"))
    crops = gt.groupBy("image_id", "crop").agg(F.transform(F.sort_array(F.collect_list(F.struct("gi", "v"))), lambda x: x["v"]).alias("v"))
    nested = crops.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("crop", "v"))).alias("crops")).withColumn("blur_category", F.when(F.col("image_id").cast("long") % 4 == 0, "Very blurry"))
    references = gt.where("image_id % 2 = 0").select("image_id").distinct().select("image_id", F.lit(0).alias("ord"), F.concat(F.lit("ref"), "image_id", F.lit("-0")).alias("crop_id"), F.array(*map(F.lit, (0, 0, 256, 256))).alias("crop_region"))
    out = documents.unnested(nested, references)
    return out.select("original_image", "crop_id", F.col("crop_region")[2].alias("side"), "blur_category", F.size("instances").cast("long").alias("n"), F.array_join(F.transform("instances", lambda x: x["text"]), " ").alias("texts"))


@query("""WITH a AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN ' Not Blurry. ' WHEN 1 THEN 'slightly blurry' WHEN 2 THEN 'Very blurry..' WHEN 3 THEN 'I cannot determine that' WHEN 4 THEN 'The TEXT says so' WHEN 5 THEN 'level 3' ELSE 'hm' END AS answer FROM orders)
SELECT o_orderkey, answer, CASE o_orderkey % 7 WHEN 0 THEN 'Not blurry' WHEN 1 THEN 'Slightly blurry' WHEN 2 THEN 'Very blurry' WHEN 3 THEN 'Error: Cannot Classify' WHEN 4 THEN 'Error: Focused on Text' ELSE 'Error: Unknown Category' END AS category, CASE o_orderkey % 7 WHEN 3 THEN 'Error: Cannot Classify' WHEN 4 THEN 'Error: Focused on Text' WHEN 5 THEN 'Not blurry' ELSE 'Error: Unknown Category' END AS by_sharpness FROM a""")
def p11_blur_categories(spark, d):
    said = F.element_at(F.array(*map(F.lit, (" Not Blurry. ", "slightly blurry", "Very blurry..", "I cannot determine that", "The TEXT says so", "level 3", "hm"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    a = table(spark, d, "orders").select("o_orderkey", said.alias("answer"))
    return a.select("o_orderkey", "answer", documents.blur_category(F.col("answer")).alias("category"), documents.blur_category(F.col("answer"), sharpness=True).alias("by_sharpness"))


@query(f"{_W} SELECT coalesce(g.image_id * 100 + g.gi, p.image_id * 100 + p.pi) AS id, g.text AS first, p.text AS second, coalesce(g.score, p.score) AS score FROM gt g FULL JOIN pred p ON g.image_id = p.image_id AND g.gi = p.pi")
def p12_renamed_answers(spark, d):
    a = truth(spark, d).select((F.col("image_id") * 100 + F.col("gi")).alias("id"), "text", "score")
    b = guesses(spark, d).select((F.col("image_id") * 100 + F.col("pi")).alias("id"), "text", "score")
    return documents.renamed_answers(a, b, "id", "text", ("first", "second"))


@query("SELECT min('out/' || o_orderkey % 3 || '/restored_' || o_custkey || '.png') AS source, o_custkey || '.png' AS target FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey")
def p19_restored_names(spark, d):
    name = F.concat(F.lit("out/"), F.col("o_orderkey") % 3, F.when(F.col("o_orderkey") % 2 == 0, "/restored_").otherwise("/other_"), "o_custkey", F.lit(".png"))
    return documents.restored_names(table(spark, d, "orders").select(name.alias("path")), "path")


@query("WITH r AS (SELECT l_returnflag AS f, avg(l_quantity::DOUBLE) AS q, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1) SELECT 'by/' || f || '/quantity' AS name, round(q, 6) AS value FROM r UNION ALL SELECT 'by/' || f || '/rows', n FROM r UNION ALL SELECT 'all/rows', sum(n) FROM r UNION ALL SELECT 'all/deep/flags', count(*)::DOUBLE FROM r UNION ALL SELECT 'top', max(round(q, 6)) FROM r")
def p18_flat_results(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(F.col("l_quantity").cast("double")), 6).alias("q"), F.count("*").cast("double").alias("n"))
    one = r.agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", F.create_map(F.lit("quantity"), "q", F.lit("rows"), "n")))).alias("by"), F.struct(F.sum("n").alias("rows"), F.struct(F.count("*").alias("flags")).alias("deep")).alias("all"), F.max("q").alias("top"))
    return documents.flat_results(one)


@query("SELECT l_returnflag AS task, 'rows,quantity' AS names, printf('%.4f', count(*)::DOUBLE) || ',' || printf('%.4f', avg(l_quantity::DOUBLE)) AS values FROM lineitem GROUP BY 1")
def k12_main_metrics(spark, d):
    by = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("task")).agg(F.count("*").cast("double").alias("n"), F.avg(F.col("l_quantity").cast("double")).alias("q"))
    rows = by.select("task", F.inline(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(m).alias("metric"), F.col(c).alias("value")) for k, m, c in ((1, "quantity", "q"), (0, "rows", "n"), (2, "rows-N", "n"))])))
    return documents.main_metrics(rows)


@query("SELECT o_orderkey AS file, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, o_orderstatus) AS kind, o_custkey, n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def j14_panoptic_records(spark, d):
    segments = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.count("*").alias("n"))
    orders = table(spark, d, "orders")
    own = orders.select(F.col("o_orderkey").alias("file"), F.col("o_orderstatus").alias("kind"), "o_custkey").join(segments.select("file"), "file", "left_semi")
    other = segments.join(orders.select(F.col("o_orderkey").alias("file"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("kind")), "file")
    return documents.panoptic_records(own, other, "file")


_MANIFEST = "t AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey AS id, o_orderkey || '.png' AS file FROM orders WHERE o_orderkey % 3 > 0), p AS (SELECT o_orderkey AS id, o_orderpriority AS guess FROM orders WHERE o_orderkey % 2 = 0)"


@query(f"WITH {_MANIFEST} SELECT id, n, file, guess, false AS missing FROM t JOIN r USING (id) LEFT JOIN p USING (id) UNION ALL SELECT id, n, NULL, NULL, true FROM t WHERE id NOT IN (SELECT id FROM r)")
def j13_visual_manifest(spark, d):
    orders = table(spark, d, "orders").withColumn("id", F.col("o_orderkey"))
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    manifest, missing = documents.visual_manifest(t, orders.where("id % 3 > 0").select("id", F.concat("id", F.lit(".png")).alias("file")), orders.where("id % 2 = 0").select("id", F.col("o_orderpriority").alias("guess")), "id")
    return manifest.withColumn("missing", F.lit(False)).unionByName(missing.withColumn("missing", F.lit(True)), allowMissingColumns=True)


@query("SELECT id, n, source FROM (SELECT o_orderkey AS id, n, o_orderpriority AS source, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber > 1 GROUP BY 1) ON l_orderkey = o_orderkey) WHERE r <= 40")
def j12_paired_scenes(spark, d):
    high = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"))
    low = table(spark, d, "lineitem").where("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    return documents.paired_scenes(high, low, "id", "source", 40, ["id"])


@query("SELECT o_orderkey AS image_id, coalesce(list_sort(list(l_linenumber) FILTER (l_linenumber IS NOT NULL)), [])::VARCHAR AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' WHERE o_orderkey % 5 = 0 GROUP BY 1")
def f21_restricted(spark, d):
    rows = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("lines"))
    ids = table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("image_id"))
    return documents.restricted(rows, ids, "image_id", "lines").select("image_id", F.concat(F.lit("["), F.array_join("lines", ", "), F.lit("]")).alias("lines"))


@query("SELECT o_orderkey AS image_id FROM orders WHERE 200 + o_orderkey % 5 * 100 >= 400 AND 300 + o_custkey % 3 * 100 >= 400 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def f5_large_enough(spark, d):
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), (200 + F.col("o_orderkey") % 5 * 100).alias("width"), (300 + F.col("o_custkey") % 3 * 100).alias("height"))
    notes = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("image_id"))
    return documents.large_enough(images, notes, "image_id", 400).select("image_id")


@query("SELECT o_orderkey AS image_id FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def f9_kept_category(spark, d):
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_orderpriority").alias("tag"))
    return curation.tag_filter(images, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id")), "image_id", "tag", "2-HIGH")[0].select("image_id")


@query(f"{_W} SELECT image_id, gi, text FROM gt WHERE image_id NOT IN (SELECT image_id FROM gt WHERE image_id % 3 = 0 AND gi = 2)")
def j5_agreed_annotations(spark, d):
    key = F.concat_ws(":", "image_id", "gi")
    a = truth(spark, d).withColumn("id", key)
    b = a.withColumn("text", F.when((F.col("image_id") % 3 == 0) & (F.col("gi") == 2), F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    merged = curation.merge_annotators(a, b, "id", "text", "gi").withColumn("image_id", F.split("id", ":")[0].cast("long"))
    return truth(spark, d).join(curation.agreed_groups(merged, "image_id"), "image_id", "left_semi").select("image_id", "gi", "text")


_PROMPT = "CASE conv_id % 3 WHEN 0 THEN 'OCR tokens: a, b. Question: ' || q || ' Short answer:' WHEN 1 THEN 'Reference OCR token: x, y' || chr(10) || q || chr(10) || 'Answer.' ELSE q || chr(10) || 'Answer.' END"
_Q = "qs AS (SELECT conv_id, turn, 'What is ' || conv_id || ' of ' || turn || '?' AS q FROM conversations WHERE turn < 3)"


def _prompts(spark, d):
    q = F.concat(F.lit("What is "), "conv_id", F.lit(" of "), "turn", F.lit("?"))
    p = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("OCR tokens: a, b. Question: "), "q", F.lit(" Short answer:"))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("Reference OCR token: x, y\n"), "q", F.lit("\nAnswer."))).otherwise(F.concat("q", F.lit("\nAnswer.")))
    return table(spark, d, "conversations").where("turn < 3").withColumn("q", q).select("conv_id", "turn", "q", p.alias("prompt"))


@query(f"WITH {_Q} SELECT conv_id, turn, {_PROMPT} AS prompt, lower(q) AS question FROM qs")
def t19_prompt_questions(spark, d):
    return _prompts(spark, d).select("conv_id", "turn", "prompt", T.prompt_question(F.col("prompt")).alias("question"))


@query(f"WITH {_Q} SELECT conv_id AS image_id, turn, q AS question FROM qs WHERE turn = 1")
def j15_image_and_question(spark, d):
    p = _prompts(spark, d)
    notes = p.where("turn = 1").select(F.col("conv_id").alias("image_id"), F.col("q").alias("question"))
    return documents.by_image_and_question(p.select(F.col("conv_id").alias("image_id"), "turn", "prompt"), notes).select("image_id", "turn", "question")


@query("SELECT a.conv_id, a.text AS question, b.text AS first, c.text AS second, e.role AS review FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = 1 JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = 2 JOIN conversations e ON e.conv_id = a.conv_id AND e.turn = 3 WHERE a.turn = 0")
def j20_joined_answers(spark, d):
    turn = lambda k, c, n: table(spark, d, "conversations").where(F.col("turn") == k).select("conv_id", F.col(c).alias(n))
    return documents.joined_answers(turn(0, "text", "question"), turn(1, "text", "first"), turn(2, "text", "second"), turn(3, "role", "review"), key="conv_id")


_PUNCT = '[.!"()*#:;~]'


@query(rf"""WITH p AS (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM benchmark)
SELECT item_id, array_to_string(string_split(regexp_replace(regexp_replace(regexp_replace(lower(t), '{_PUNCT}', ' ', 'g'), '\s{{2,}}', ' ', 'g'), '^ +| +$', '', 'g'), ' ')[:12], ' ') AS caption, array_to_string(string_split(regexp_replace(regexp_replace(lower(t), '{_PUNCT}', '', 'g'), ' +$', ''), ' ')[:12], ' ') AS question FROM p""")
def t21_caption_forms(spark, d):
    p = table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "").alias("t"))
    return p.select("item_id", T.caption_form(F.col("t"), 12).alias("caption"), T.question_form(F.col("t"), 12).alias("question"))


@query("SELECT o_orderkey, [o_orderstatus, o_orderpriority, o_clerk][2] || ',' || o_clerk || ',' || o_orderstatus AS turned FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey::VARCHAR AS o_clerk FROM orders)")
def p17_turned_options(spark, d):
    options = F.array("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.turned_left(options), ",").alias("turned"))
