"""Queries of readers and writers: derived tables written to the scratch folder and read again, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import readers, sinks
from ..sources.json_document import Document
from ..sources.scratch import scratch_dir
from .detection import _W
from .registered import registrar
from .views import guesses, table, truth

QUERIES, ORACLE, query = registrar()


def _folder(spark) -> str:
    return f"{scratch_dir(spark)}/files-{uuid.uuid4().hex}"


def _b(b):
    return F.array(b["x1"], b["y1"], b["x2"], b["y2"])


def _flat(df, *keep):
    return df.select(*keep, "box.*")


@query(f"{_W} SELECT 'im' || image_id AS file_name, gi AS id, x1, y1, x2, y2, score, 'w' || gi AS rec FROM gt")
def s1_detection_document(spark, d):
    path = _folder(spark)
    notes = truth(spark, d).select(F.col("gi").alias("id"), F.concat(F.lit("im"), "image_id").alias("file_name"), _b(F.col("box")).alias("bbox"), "score", F.concat(F.lit("w"), "gi").alias("rec"))
    sinks.write_document(path, images=notes.select("file_name").distinct(), annotations=notes)
    b = F.col("bbox")
    return readers.detection_document(spark, path)[1].select("file_name", "id", *[b[k].alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))], "score", "rec")


@query("SELECT DISTINCT trim(o_orderpriority) AS value FROM orders UNION ALL SELECT 'last'")
def s2_text_list(spark, d):
    path = _folder(spark)
    own = table(spark, d, "orders").select(F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")).alias("v")).distinct()
    own.unionByName(spark.createDataFrame([("",), ("  ",), ("last",)], "v string")).write.text(path)
    return readers.text_list(spark, path)


@query("SELECT DISTINCT 'p=' || o_orderstatus AS folder, 'csv' AS kind FROM orders UNION ALL SELECT DISTINCT 'p=' || o_orderstatus, 'json' FROM orders WHERE o_orderstatus = 'F'")
def s3_files_below(spark, d):
    path = _folder(spark)
    own = table(spark, d, "orders").select(F.col("o_orderstatus").alias("p"), "o_orderkey")
    own.write.partitionBy("p").csv(f"{path}/a")
    own.where("p = 'F'").write.partitionBy("p").json(f"{path}/b")
    files = readers.files_with(spark, path, ".CSV", ".json")
    return files.select(F.regexp_extract("path", "(p=[^/]*)", 1).alias("folder"), F.regexp_extract("name", "[^.]*$", 0).alias("kind")).distinct()


@query("SELECT unnest(['a.jpg', 'b.png']) AS path")
def s4_listed_inputs(spark, d):
    return readers.listed_inputs(spark, ["a.jpg", "b.png"], ".jpg")


def _truth_arrays(spark, d):
    own = truth(spark, d).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("gi", "text", F.array(F.array("box.x1", "box.y1"), F.array("box.x2", "box.y2")).alias("bbox")))).alias("a"))
    return own.select(F.concat(F.lit("train/im"), "image_id", F.lit(".jpg")).alias("id"), F.transform("a", lambda x: x["text"]).alias("text"), F.transform("a", lambda x: x["bbox"]).alias("bbox"))


_TRUTH = "SELECT 'im' || image_id AS image_id, (gi - 1)::INT AS ord, text, x1, y1, x2, y2 FROM gt"


@query(f"{_W} {_TRUTH}")
def s5_lenient_truth(spark, d):
    path = _folder(spark)
    _truth_arrays(spark, d).write.parquet(path)
    rows = readers.ground_truth(spark, path)
    return rows.select(T.image_key(F.col("id")).alias("image_id"), "ord", "text", "x1", "y1", "x2", "y2")


@query(f"{_W} {_TRUTH}")
def s6_strict_truth(spark, d):
    path = _folder(spark)
    _truth_arrays(spark, d).write.parquet(path)
    return _flat(readers.strict_truth(spark, path), "image_id", "ord", "text")


def _guess_document(spark, d):
    b = F.col("box")
    corners = F.array(F.array("box.x1", "box.y1"), F.array("box.x2", "box.y1"), F.array("box.x2", "box.y2"), F.array("box.x1", "box.y2"))
    return guesses(spark, d).select(
        F.format_string("im%08d.jpg", "image_id").alias("file_name"), F.when(F.col("pi") % 2 == 0, F.col("text")).alias("text"), F.concat(F.lit("r"), "pi").alias("rec"),
        F.when(F.col("pi") % 3 > 0, F.array(b["x1"], b["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"])).alias("bbox"), corners.alias("polygon"), F.when(F.col("pi") % 5 > 0, F.col("score")).alias("score"), "pi",
    )


_GUESSES = "SELECT printf('im%08d', image_id) AS image_id, CASE WHEN pi % 2 = 0 THEN text ELSE 'r' || pi END AS text, x1, y1, x2, y2, CASE WHEN pi % 5 > 0 THEN score END AS score FROM pred"


@query(f"{_W} {_GUESSES}")
def s7_predictions_flat(spark, d):
    path = _folder(spark)
    sinks.write_document(path, annotations=_guess_document(spark, d).drop("pi"))
    return _flat(readers.predictions(spark, path, mode="xywh"), "image_id", "text", "score")


@query(f"{_W} {_GUESSES}")
def s7_predictions_nested(spark, d):
    path = _folder(spark)
    own = _guess_document(spark, d).groupBy("file_name").agg(F.sort_array(F.collect_list(F.struct("pi", "text", "rec", "bbox", "polygon", "score"))).alias("text_instances"))
    sinks.write_document(path, entries=own.select(F.lit("").alias("original_image"), F.col("file_name").alias("crop_id"), "text_instances"))
    return _flat(readers.predictions(spark, path, mode="xywh"), "image_id", "text", "score")


@query(f"{_W} SELECT * FROM ({_GUESSES}) WHERE coalesce(score, 0) >= 0.05")
def s8_scored_predictions(spark, d):
    path = _folder(spark)
    sinks.write_document(path, annotations=_guess_document(spark, d).drop("pi"))
    return _flat(readers.predictions(spark, path, mode="xywh", least_score=0.05), "image_id", "text", "score")


@query("SELECT l_orderkey AS num_gt, l_linenumber AS num_pred, l_discount::DOUBLE AS reward, l_returnflag AS chunk FROM lineitem")
def s9_typed_csv(spark, d):
    path = _folder(spark)
    own = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("double").alias("num_gt"), F.col("l_linenumber").alias("num_pred"), F.col("l_discount").cast("double").alias("reward"), F.col("l_returnflag").alias("chunk"))
    sinks.write_csv(own, path)
    return readers.typed_csv(spark, path, "num_gt bigint, num_pred bigint, reward double, chunk string")


@query("SELECT o_orderkey AS image_id, o_orderpriority AS category FROM orders")
def s10_columns_of_any_case(spark, d):
    path = _folder(spark)
    table(spark, d, "orders").select(F.col("o_orderkey").alias("Image_ID"), F.col("o_orderpriority").alias("CATEGORY")).write.csv(path, header=True)
    return readers.typed_csv(spark, path, "image_id bigint, category string")


@query("SELECT o_orderkey AS id, o_orderpriority AS label FROM orders")
def s11_sharded_rows(spark, d):
    path = _folder(spark)
    table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), "o_custkey").repartition(3, "id").write.parquet(path)
    return readers.sharded_rows(spark, path, columns=["id", "label"]).where("row_index >= 0").select("id", "label")


@query("SELECT id, r FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r BETWEEN 100 AND 149")
def s12_file_slice(spark, d):
    path = _folder(spark)
    table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).repartition(1).sortWithinPartitions("id").write.parquet(path)
    return readers.file_slice(spark, path, 100, 50).select("id", F.col("_metadata.row_index").alias("r"))


@query("SELECT o_orderkey AS id, o_orderstatus AS high, o_orderpriority AS low, 'pair' AS kind FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, o_orderstatus, 'one' FROM orders")
def s13_image_columns(spark, d):
    o = table(spark, d, "orders")
    pair = readers.image_columns(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("hq_img"), F.col("o_orderpriority").alias("lq_img_lv2")), 2)
    one = readers.image_columns(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("image")), 2)
    return pair.withColumn("kind", F.lit("pair")).unionByName(one.withColumn("kind", F.lit("one")))


@query("SELECT row_number() OVER (ORDER BY id) - 1 AS sample_index, id, label FROM (SELECT o_orderkey AS id, o_orderpriority AS label FROM orders ORDER BY o_orderkey LIMIT 60)")
def s14_manifest_rows(spark, d):
    path = _folder(spark)
    table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label")).repartition(3, "id").write.parquet(f"{path}/data")
    rows = readers.sharded_rows(spark, f"{path}/data", columns=["id"])
    from ..operators.sampling import place_in_order

    wanted = place_in_order(rows, ["id"]).where("place < 60").select(F.col("place").alias("sample_index"), F.concat(F.lit("data/"), "file").alias("parquet"), "row_index")
    sinks.write_manifest(wanted, f"{path}/list")
    return readers.manifest_rows(spark, readers.manifest(spark, f"{path}/list", 60), f"{path}/data").select("sample_index", "id", "label")


@query("SELECT o_orderkey AS sample_index, o_orderpriority AS label FROM orders ORDER BY 1 LIMIT 25")
def s15_manifest(spark, d):
    path = _folder(spark)
    table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_index"), F.col("o_orderpriority").alias("label")).write.json(path)
    return readers.manifest(spark, path, 25).select("sample_index", "label")


def _coco(spark, d):
    """A written document, its tables read again: categories have the ids 10, 20, ... and are numbered from 0."""
    path = _folder(spark)
    categories = spark.createDataFrame([(k, 10 * (k + 1), f"c{k}") for k in range(7)], "number long, id long, name string")
    notes = truth(spark, d).select("image_id", F.col("gi").alias("ord"), (F.col("gi") % 7).alias("category"), "box", (F.col("gi") % 6 == 0).cast("int").alias("iscrowd"))
    images = notes.select("image_id").distinct().select("image_id", F.concat("image_id", F.lit(".jpg")).alias("file_name"), F.lit(160).alias("width"), F.lit(150).alias("height"))
    tables = sinks.coco_tables(images, notes, categories)
    b, odd = F.col("bbox"), F.col("image_id") % 5
    x2, y2 = b[0] + b[2], b[1] + b[3]
    square = F.array(b[0], b[1], x2, b[1], x2, y2, b[0], y2)
    polygons = F.when(odd == 0, F.array(F.slice(square, 1, 4))).when(odd == 1, F.array(square, F.slice(square, 1, 5))).otherwise(F.array(square))
    codes = F.array(*[(F.col("id") % 90 + k).cast("int") for k in range(3)], F.lit(94), F.lit(95))
    notes = tables["annotations"].withColumns({"segmentation": polygons, "keypoints": F.array(b[0], b[1], F.lit(2.0)), "rec": codes, "bezier_pts": square})
    sinks.write_document(path, images=tables["images"], annotations=notes, categories=tables["categories"])
    return readers.coco_document(spark, path, "root")


_COCO = "c AS (SELECT image_id, gi, row_number() OVER (ORDER BY image_id, gi) AS id, x1, y1, x2, y2 FROM gt)"


@query(f"{_W}, {_COCO} SELECT id AS annotation_id, image_id, (gi % 7)::INT AS category, x1, x2 - x1 AS w, (gi % 6 = 0)::INT AS iscrowd, 1 AS polygons, x1 + 0.5 AS kx, 2.0 AS kv FROM c WHERE image_id % 5 <> 0")
def s16_coco_document(spark, d):
    n = _coco(spark, d)[1]
    return n.select("annotation_id", "image_id", F.col("category").cast("int").alias("category"), F.col("bbox")[0].alias("x1"), F.col("bbox")[2].alias("w"), "iscrowd", F.size("segmentation").alias("polygons"), F.col("keypoints")[0].alias("kx"), F.col("keypoints")[2].alias("kv"))


@query(f"{_W}, {_COCO} SELECT id AS annotation_id, 'root/' || image_id || '.jpg' AS file_name, list_reduce(list_transform(range(3), lambda k: chr((id % 90 + k + 32)::INT)), lambda a, b: a || b) AS text, y2 AS last FROM c WHERE image_id % 5 <> 0 AND id % 90 + 2 < 94")
def s17_text_document(spark, d):
    images, notes, _ = _coco(spark, d)
    own = notes.join(images, "image_id").where("annotation_id % 90 + 2 < 94")
    return own.select("annotation_id", "file_name", T.decode_codes(F.col("rec")).alias("text"), F.element_at("bezier_pts", -1).alias("last"))


@query(f"{_W}, {_COCO} SELECT id, image_id, 10 * (gi % 7 + 1) AS category_id, x1, y1, x2 - x1 AS w, y2 - y1 AS h, round((x2 - x1) * (y2 - y1), 3) AS area, (gi % 6 = 0)::INT AS iscrowd FROM c")
def k8_coco_export(spark, d):
    categories = spark.createDataFrame([(k, 10 * (k + 1), f"c{k}") for k in range(7)], "number long, id long, name string")
    notes = truth(spark, d).select("image_id", F.col("gi").alias("ord"), (F.col("gi") % 7).alias("category"), "box", (F.col("gi") % 6 == 0).cast("int").alias("iscrowd"))
    images = notes.select("image_id").distinct().select("image_id", F.lit("f").alias("file_name"), F.lit(160).alias("width"), F.lit(150).alias("height"))
    b = F.col("bbox")
    return sinks.coco_tables(images, notes, categories)["annotations"].select("id", "image_id", "category_id", *[b[k].alias(c) for k, c in enumerate(("x1", "y1", "w", "h"))], "area", "iscrowd")


@query(f"{_W} SELECT image_id, 10 * (pi % 7 + 1) AS category_id, x1, y1, x2 - x1 AS w, y2 - y1 AS h, score FROM pred")
def k9_coco_results(spark, d):
    categories = spark.createDataFrame([(k, 10 * (k + 1)) for k in range(7)], "number long, id long")
    b = F.col("bbox")
    out = sinks.coco_results(guesses(spark, d).withColumn("category", F.col("pi") % 7), categories)
    return out.select("image_id", "category_id", *[b[k].alias(c) for k, c in enumerate(("x1", "y1", "w", "h"))], "score")


@query(f"{_W} SELECT image_id * 100 + gi AS id, image_id, gi % 7 AS category_id, 'root/train/im' || image_id || '.jpg' AS file_name, x1, (x2 - x1) * (y2 - y1) AS area, 8::INT AS points, (image_id % 3)::INT AS partial FROM gt")
def s19_vocabulary_document(spark, d):
    path, b = _folder(spark), F.col("box")
    own = truth(spark, d)
    notes = own.select(
        (F.col("image_id") * 100 + F.col("gi")).alias("id"), "image_id", (F.col("gi") % 7 + 1).alias("category_id"), F.array(b["x1"], b["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]).alias("bbox"),
        ((b["x2"] - b["x1"]) * (b["y2"] - b["y1"])).alias("area"), F.array(F.array(b["x1"], b["y1"], b["x2"], b["y1"], b["x2"], b["y2"], b["x1"], b["y2"])).alias("segmentation"),
    )
    partial = F.slice(F.array(*[F.lit(k).cast("long") for k in range(3)]), F.lit(1), (F.col("id") % 3).cast("int"))
    images = own.select(F.col("image_id").alias("id")).distinct().select("id", F.lit(160).alias("width"), F.lit(150).alias("height"), F.concat(F.lit("http://host/x/train/im"), "id", F.lit(".jpg")).alias("coco_url"), partial.alias("not_exhaustive_category_ids"))
    sinks.write_document(path, images=images, annotations=notes)
    images, notes = readers.lvis_document(spark, path, "root/")
    rows = notes.join(images.select("image_id", "file_name", F.size("not_exhaustive_category_ids").alias("partial")), "image_id")
    return rows.select("id", "image_id", "category_id", "file_name", F.col("bbox")[0].alias("x1"), "area", F.size(F.col("segmentation")[0]).alias("points"), "partial")


@query(f"{_W} SELECT image_id, 'img/p' || image_id || '.jpg' AS file_name, 'lab/p' || image_id || '.png' AS label_file, gi AS segment, (CASE gi % 4 WHEN 0 THEN 5 WHEN 1 THEN 6 WHEN 2 THEN 50 ELSE 51 END)::BIGINT AS category, gi % 4 < 2 AS isthing FROM gt")
def s21_panoptic_document(spark, d):
    path = _folder(spark)
    segment = F.struct(F.col("gi").alias("id"), (F.col("gi") % 4 + 1).alias("category_id"), F.lit(0).alias("iscrowd"), F.lit(9).cast("long").alias("area"), _b(F.col("box")).alias("bbox"))
    own = truth(spark, d).groupBy("image_id").agg(F.sort_array(F.collect_list(segment)).alias("segments_info"))
    sinks.write_document(path, annotations=own.select(F.col("image_id").cast("string").alias("image_id"), F.concat(F.lit("p"), "image_id", F.lit(".png")).alias("file_name"), "segments_info"))
    rows = readers.panoptic_document(spark, path, "img/", "lab", {1: 5, 2: 6}, {3: 50, 4: 51})
    return rows.select("image_id", "file_name", "label_file", F.explode("segments").alias("s")).select("image_id", "file_name", "label_file", F.col("s.id").alias("segment"), F.col("s.category_id").alias("category"), F.col("s.isthing").alias("isthing"))


@query("SELECT DISTINCT 'fine/c=' || o_orderstatus AS folder, true AS both FROM orders")
def s20_sibling_listing(spark, d):
    path = _folder(spark)
    table(spark, d, "orders").select(F.col("o_orderstatus").alias("c"), "o_orderkey").write.partitionBy("c").csv(f"{path}/raw")
    own = readers.sibling_listing(spark, f"{path}/raw", ".csv", "fine", {"instances": "_instances.png", "labels": "_labels.png"})
    both = F.regexp_replace("instances", "_instances.png$", "") == F.regexp_replace("labels", "_labels.png$", "")
    return own.select(F.regexp_extract("instances", "^(fine/c=[^/]*)/", 1).alias("folder"), both.alias("both")).distinct()


@query("SELECT o_orderkey AS image_id, ['x\"y', 'plain', 'back\\slash', 'é'][o_orderkey % 4 + 1] AS text, 8::INT AS n, o_custkey::DOUBLE AS x FROM orders")
def s26_spotting_lines(spark, d):
    said = F.element_at(F.array(*map(F.lit, ('"x\\"y"', "plain", '"back\\\\slash"', "é"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    lines = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.concat_ws(",", "o_custkey", *[F.lit(str(k)) for k in range(7)], F.concat(F.lit("####"), said)).alias("value"))
    return readers.spotting_lines(lines).select("image_id", readers.unescaped(F.col("transcription")).alias("text"), F.size("coords").alias("n"), F.col("coords")[0].alias("x"))


@query("SELECT o_orderkey::VARCHAR AS index, 'What, ' || o_orderpriority || '?' AS question FROM orders")
def s28_tab_table(spark, d):
    path = _folder(spark)
    table(spark, d, "orders").select(F.col("o_orderkey").alias("index"), F.concat(F.lit("What, "), "o_orderpriority", F.lit("?")).alias("question")).write.csv(path, sep="\t", header=True)
    return readers.tab_table(spark, path)


@query("SELECT l_orderkey::VARCHAR AS item, 't' || l_linenumber AS tag FROM lineitem")
def s29_tag_lines(spark, d):
    path = _folder(spark)
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit(" t"), "l_linenumber")).alias("t"))
    own.select(F.concat_ws(",", F.col("l_orderkey").cast("string"), F.array_join("t", ",")).alias("value")).write.text(path)
    return readers.tag_lines(spark, path)


@query(f"{_W} SELECT image_id, count(*) AS n, string_agg(text, ' ' ORDER BY gi) AS texts, round(sum(round((x1 + x2) / 2 / 160, 4)), 4) AS cx, sum(length(text)) AS codes FROM gt WHERE image_id % 2 = 0 AND gi % 4 > 0 GROUP BY 1")
def s31_training_list(spark, d):
    notes = truth(spark, d).select(F.col("image_id").alias("file_name"), F.col("gi").alias("ord"), F.when(F.col("gi") % 4 > 0, F.col("text")).otherwise(F.repeat("text", 20)).alias("text"), "box")
    listing = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("file_name"))
    a = readers.training_list(listing, notes, 160.0, 150.0).select(F.col("file_name").alias("image_id"), F.col("annotations").alias("a"))
    codes = F.aggregate("a", F.lit(0).cast("long"), lambda t, x: t + F.size(F.filter(x["codes"], lambda c: c < 94)))
    return a.select("image_id", F.size("a").cast("long").alias("n"), F.array_join(F.transform("a", lambda x: x["text"]), " ").alias("texts"), F.round(F.aggregate("a", F.lit(0.0), lambda t, x: t + x["box"][0]), 4).alias("cx"), codes.cast("double").alias("codes"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '/mnt/new/a/' WHEN 1 THEN 'store/b/' ELSE 'c/d/' END || o_custkey AS path FROM orders")
def s32_remapped_paths(spark, d):
    start = F.when(F.col("o_orderkey") % 3 == 0, "s3:\\bucket\\a\\").when(F.col("o_orderkey") % 3 == 1, "old/b/").otherwise("c/d/")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), readers.remapped_path(F.concat(start, F.col("o_custkey").cast("string")), {"s3:/bucket/": "/mnt/new/", "old/": "store/"}).alias("path"))


@query("SELECT DISTINCT o_orderstatus AS image_id, upper('w' || o_custkey) AS word, CASE WHEN o_custkey % 2 = 0 THEN 'W' || o_custkey || ' shown' ELSE 'w' || o_custkey END AS display FROM orders")
def s33_lexicon_pairs(spark, d):
    path = _folder(spark)
    own = table(spark, d, "orders").select("o_orderstatus", "o_custkey").distinct()
    line = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("w"), "o_custkey", F.lit(" W"), "o_custkey", F.lit(" shown"))).otherwise(F.concat(F.lit("w"), "o_custkey"))
    for status in ("F", "O", "P"):  # one folder for each kind, as lexicons come
        own.where(F.col("o_orderstatus") == status).select(line.alias("value")).write.text(f"{path}/{status}")
    parts = [readers.lexicon_pairs(spark, f"{path}/{s}").withColumn("image_id", F.lit(s)) for s in ("F", "O", "P")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT l_orderkey AS name, l_orderkey % 4 AS chunk FROM lineitem GROUP BY 1")
def s35_across_chunks(spark, d):
    return readers.across_chunks(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("name"), (F.col("l_orderkey") % 4).alias("chunk")), "name", "chunk")


@query(f"{_W} SELECT image_id, gi, text FROM gt")
def k1_json_document(spark, d):
    path = _folder(spark)
    sinks.write_document(path, rows=truth(spark, d).select("image_id", "gi", "text"))
    return Document(spark, path).rows("rows", "image_id bigint, gi bigint, text string")


@query("SELECT o_orderkey AS id, '[1,' || o_custkey || ']' AS pair, false AS empty FROM orders")
def k2_csv(spark, d):
    path = _folder(spark)
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.lit(1).cast("long"), "o_custkey").alias("pair"))
    sinks.write_csv(own, f"{path}/a")
    sinks.write_csv(own.where("id < 0"), f"{path}/b", skip_empty=True)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/b")
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.csv(f"{path}/a", header=True, escape='"').select(F.col("id").cast("long").alias("id"), "pair", F.lit(there).alias("empty"))


@query("SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 400 AS shard, ceil(count(*) OVER () / 400)::BIGINT AS total FROM orders")
def k5_numbered_shards(spark, d):
    path = _folder(spark)
    sinks.write_numbered_shards(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), path, ["id"], 400)
    return spark.read.parquet(path).select("id", F.col("shard").cast("long").alias("shard"), F.col("of").cast("long").alias("total"))


@query("SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS ids, (SELECT count(*) FROM lineitem) AS listed FROM lineitem")
def k6_manifest_and_ids(spark, d):
    path = _folder(spark)
    summary = sinks.write_manifest(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), path, "l_orderkey")
    return summary.crossJoin(spark.read.text(f"{path}/ids").agg(F.count("*").alias("listed")))  # one row each


@query("SELECT o_orderkey || '.png' AS file_name, o_orderpriority AS prompt FROM orders")
def k13_prompt_log(spark, d):
    path = _folder(spark)
    own = table(spark, d, "orders").select(F.concat("o_orderkey", F.lit(".png")).alias("file_name"), F.col("o_orderpriority").alias("prompt"), "o_orderkey")
    for k in range(2):
        sinks.append_prompts(own.where(F.col("o_orderkey") % 2 == k), path)
    return spark.read.csv(path, header=True)


@query("SELECT o_custkey AS id, arg_min(o_orderkey, (o_orderkey % 3, '{\"id\":' || o_custkey || ',\"value\":' || o_orderkey || '}')) AS value FROM orders GROUP BY 1")
def k14_merged_ranks(spark, d):
    own = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("value"))
    return sinks.merged_ranks([own.where(F.col("value") % 3 == k) for k in range(3)], "id")


@query("SELECT printf('label-%09d', row_number() OVER (ORDER BY o_orderkey)) AS key, o_orderkey AS id FROM orders WHERE o_custkey % 4 > 0 AND o_orderkey % 7 > 0")
def k15_keyed_records(spark, d):
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 4 > 0, F.col("o_orderpriority")).otherwise("").alias("label"))
    return sinks.keyed_records(own, "label", F.col("id") % 7 > 0, ["id"]).select("key", "id")
