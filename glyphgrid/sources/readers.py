"""Readers of detection documents, tables and lists."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import place_in_order
from .json_document import Document

IMAGE = "file_name string, width int, height int, instances int"
ANNOTATION = "id bigint, file_name string, bbox array<double>, score double, rec string, polygon array<array<double>>, VLM string, has_text boolean"


def detection_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of a JSON document, read by byte ranges; a field of another type is null."""
    doc = Document(spark, path)
    return doc.rows("images", IMAGE), doc.rows("annotations", ANNOTATION)


def text_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank, stripped."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def id_filter(spark: SparkSession, path: str) -> DataFrame:
    """First CSV field of each line; # starts a comment."""
    return text_list(spark, path).where(~F.col("value").startswith("#")).select(F.trim(F.split("value", ",")[0]).alias("image_id"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    return text_list(spark, path).select(F.split("value", " ")[0].alias("word"), F.col("value").alias("display"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """id, ord, text, x1..y2 of a table with arrays of texts and corner pairs; pairs of another shape are passed over."""
    df = spark.read.parquet(path).select("id", F.posexplode(F.arrays_zip("text", "bbox")).alias("ord", "t"))
    b = F.col("t.bbox")
    return df.where((F.size(b) == 2) & F.forall(b, lambda c: F.size(c) == 2) & F.col("t.text").isNotNull()).select("id", "ord", F.col("t.text").alias("text"), b[0][0].alias("x1"), b[0][1].alias("y1"), b[1][0].alias("x2"), b[1][1].alias("y2"))


def spotting_lines(lines: DataFrame) -> DataFrame:
    """Adds coords (array of double) and transcription to lines 'x1,y1,...,####text' (column value)."""
    parts = F.split("value", ",####", 2)
    return lines.withColumn("coords", F.transform(F.split(parts[0], ","), lambda x: x.try_cast("double"))).withColumn("transcription", F.coalesce(F.get(parts, 1), F.lit("")))


def checked_lines(lines: DataFrame, width: float, height: float) -> DataFrame:
    """``spotting_lines`` with points (array of structs x, y) and refused: why a line's polygon can't be taken, null if it can (see ``box.refusal``; 'coordinates' of an odd number or that aren't numbers)."""
    from ..functions import box as B

    own, c = spotting_lines(lines), F.col("coords")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.expr("size(coords) div 2") - 1, F.lit(0))), lambda k: F.struct(F.get(c, 2 * k).alias("x"), F.get(c, 2 * k + 1).alias("y")))
    odd = (F.size(c) % 2 == 1) | F.exists(c, lambda v: v.isNull())
    return own.withColumn("points", pairs).withColumn("refused", F.when(odd, "coordinates").otherwise(B.refusal(F.col("points"), F.lit(width), F.lit(height))))


def manifest_rows(spark: SparkSession, manifest: DataFrame, data: str) -> DataFrame:
    """The rows that a manifest (parquet, row_index) points to, found by row number and by file: by the whole of the shorter of the two paths where the manifest's is relative, so equal names in two folders are told apart
    as far as the manifest tells them."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(data).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    m = manifest.select("sample_index", F.col("parquet").alias("_wanted"), F.regexp_replace("parquet", "^.*/", "").alias("_file"), F.col("row_index").alias("_row"))
    same = F.concat(F.lit("/"), F.regexp_replace("_path", "^[a-z0-9]+:/+", "")).endswith(F.concat(F.lit("/"), F.regexp_replace("_wanted", "^([a-z0-9]+:)?/+", "")))
    return m.join(rows, ["_file", "_row"]).where(same).drop("_file", "_row", "_path", "_wanted")


def questions(spark: SparkSession, path: str, key: str, order: str | None = None) -> DataFrame:
    """JSON lines, of rows with one key the last by order, or the largest as text where no order is given."""
    df = spark.read.json(path)
    by = F.col(order) if order else F.to_json(F.struct(*df.columns))
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), by).alias("r")).select("r.*")


def voc_objects(spark: SparkSession, path: str) -> DataFrame:
    """image, name and zero-based boxes of annotation XML files."""
    x = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    cols = {c: F.xpath("value", F.lit(f"/annotation/object/bndbox/{c}/text()")) for c in ("xmin", "ymin", "xmax", "ymax")}
    rows = x.select("file", F.inline(F.arrays_zip(F.xpath("value", F.lit("/annotation/object/name/text()")).alias("name"), *[v.alias(k) for k, v in cols.items()])))
    return rows.select("file", "name", *[(F.col(c).cast("double") - (1 if c.endswith("min") else 0)).alias(c) for c in cols])


_LVIS_IMAGE = "id bigint, width int, height int, coco_url string, not_exhaustive_category_ids array<bigint>, neg_category_ids array<bigint>"
_LVIS_NOTE = "id bigint, image_id bigint, category_id bigint, bbox array<double>, area double, segmentation array<array<double>>"


def lvis_document(spark: SparkSession, path: str, root: str, mapping: dict[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of a large-vocabulary JSON document.

    A file name is the root and the last two parts of the image's address. Categories are as the mapping says, without one less 1. An annotation without a
    polygon, or with one of under three points, raises, as does a repeated id."""
    doc = Document(spark, path)
    image = doc.rows("images", _LVIS_IMAGE)
    parts = F.split("coco_url", "/")
    name = F.concat_ws("/", F.lit(root.rstrip("/")), F.element_at(parts, -2), F.element_at(parts, -1))
    none = F.array().cast("array<bigint>")
    images = image.select(F.col("id").alias("image_id"), name.alias("file_name"), "height", "width", *[F.coalesce(c, none).alias(c) for c in ("not_exhaustive_category_ids", "neg_category_ids")])
    valid = (F.size("segmentation") > 0) & F.forall("segmentation", lambda p: (F.size(p) % 2 == 0) & (F.size(p) >= 6))
    table = F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair]) if mapping else None
    category = F.col("category_id") - 1 if table is None else F.element_at(table, F.col("category_id").cast("int")).cast("long")
    rows = doc.rows("annotations", _LVIS_NOTE)
    own = rows.groupBy("id").agg(F.count("*").alias("_n"), F.first(F.struct(*rows.columns)).alias("a")).select("_n", "a.*")
    whole = F.when(F.col("_n") > 1, F.raise_error(F.lit("annotation ids are not unique"))).when(F.coalesce(valid, F.lit(False)), F.col("segmentation")).otherwise(F.raise_error(F.lit("annotation with an invalid polygon")))
    return images, own.select("id", "image_id", "bbox", "area", category.alias("category_id"), whole.alias("segmentation"))


_PANOPTIC = "image_id string, file_name string, segments_info array<struct<id:bigint,category_id:bigint,iscrowd:int,area:bigint,bbox:array<double>>>"


def panoptic_document(spark: SparkSession, path: str, images: str, labels: str, things: dict[int, int], stuff: dict[int, int]) -> DataFrame:
    """image_id, file_name, label_file and the segments: category by the things' map, else by the stuff's (another one raises), and isthing."""
    doc = Document(spark, path).rows("annotations", _PANOPTIC)
    table = lambda m: F.create_map(*[F.lit(v).cast("long") for pair in m.items() for v in pair]) if m else F.create_map().cast("map<bigint,bigint>")
    a, b = table(things), table(stuff)

    def convert(s):
        thing = F.try_element_at(a, s["category_id"])
        category = F.coalesce(thing, F.try_element_at(b, s["category_id"]), F.raise_error(F.lit("category in neither map")).cast("long"))
        return s.withField("category_id", category).withField("isthing", thing.isNotNull())

    jpg = F.concat(F.lit(images.rstrip("/") + "/"), F.regexp_replace("file_name", r"(?<=.)\.[^./]*$", ""), F.lit(".jpg"))
    return doc.select(F.col("image_id").cast("long").alias("image_id"), jpg.alias("file_name"), F.concat(F.lit(labels.rstrip("/") + "/"), "file_name").alias("label_file"), F.transform("segments_info", convert).alias("segments"))


def _listing(spark: SparkSession, path: str, ending: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*" + ending).load(path).select("path")
    return files.withColumn("stem", F.expr(f"substr(regexp_replace(path, '^.*/', ''), 1, length(regexp_replace(path, '^.*/', '')) - {len(ending)})"))


def paired_listing(spark: SparkSession, images: str, labels: str, image_ending: str = ".jpg", label_ending: str = ".png") -> DataFrame:
    """stem, file_name, label_file: listings of equal length by place in sorted order whatever the names, others by equal stem. Only names are read."""
    a, b = _listing(spark, images, image_ending), _listing(spark, labels, label_ending)
    if a.count() != b.count():
        return a.select("stem", F.col("path").alias("file_name")).join(b.select("stem", F.col("path").alias("label_file")), "stem")
    # Places in sorted order without one window over a listing: names are cut by their first bytes, and numbered within a cut.
    lead = F.rpad(F.hex(F.substring(F.encode("stem", "UTF-8"), 1, 6)), 12, "0")
    number = lambda df: place_in_order(df.withColumn("_lead", F.conv(lead, 16, 10).cast("double")), ["_lead", "stem", "path"])
    left = number(a).select("place", F.col("path").alias("file_name"), "stem")
    return left.join(number(b).select("place", F.col("path").alias("label_file")), "place").select("stem", "file_name", "label_file")


def zip_entries(spark: SparkSession, path: str, pattern: str = "", all_entries: bool = False) -> DataFrame:
    """archive, key, content of the entries of ZIP files whose name starts with a match of the pattern; key is its first group or the name.

    Of equal keys in an archive the last stands. all_entries: another name raises. One archive is opened in one task."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = {}
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for entry in archive.namelist():
                        m = re.match(pattern, entry)
                        if m:
                            found[m.group(1) if m.re.groups else entry] = archive.read(entry)
                        elif all_entries:
                            raise ValueError(f"entry not valid: {entry}")
                yield pd.DataFrame({"archive": name, "key": list(found), "content": list(found.values())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(entries, "archive string, key string, content binary")


def files_with(spark: SparkSession, path: str, *endings: str) -> DataFrame:
    """path, name of all files below a folder that end in one of these, whatever their case. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    wanted = F.lower("path").rlike("(" + "|".join(re.escape(e.lower()) for e in endings) + ")$")
    return files.where(wanted).select("path", F.regexp_replace("path", "^.*/", "").alias("name"))


def listed_inputs(spark: SparkSession, inputs: list[str], *endings: str) -> DataFrame:
    """path of what a spotter is given: the files below one folder or glob, or an explicit list as it is."""
    if len(inputs) > 1:
        return spark.createDataFrame([(p,) for p in inputs], "path string")
    return files_with(spark, inputs[0], *endings).select("path")


def strict_truth(spark: SparkSession, path: str) -> DataFrame:
    """image_id, ord, text, box of a table with arrays of texts and corner pairs. Arrays of unequal length and boxes that aren't two corners raise; null arrays are empty."""
    from ..functions import box as B
    from ..functions import text as T

    df = spark.read.parquet(path).select("id", *[F.coalesce(c, F.array().cast(k)).alias(c) for c, k in (("text", "array<string>"), ("bbox", "array<array<array<double>>>"))])
    whole = F.when(F.size("text") == F.size("bbox"), F.arrays_zip("text", "bbox")).otherwise(F.raise_error(F.concat(F.lit("texts and boxes differ in number: "), F.col("id").cast("string"))).cast("array<struct<text:string,bbox:array<array<double>>>>"))
    return df.select(T.image_key(F.col("id").cast("string")).alias("image_id"), F.posexplode(whole).alias("ord", "t")).select("image_id", "ord", F.col("t.text").alias("text"), B.from_pairs(F.col("t.bbox")).alias("box"))


_GUESS = "file_name string, text string, rec string, VLM string, bbox array<double>, polygon array<array<double>>, score double"
_ENTRY = f"original_image string, crop_id string, text_instances array<struct<{_GUESS}>>"


def predictions(spark: SparkSession, path: str, text_fields: tuple[str, ...] = ("text", "rec", "VLM"), mode: str = "xyxy", least_score: float | None = None) -> DataFrame:
    """image_id, ord (grows along the document), text, box, score of a JSON document in either layout: a list of annotations, or entries with text instances.

    The text is the first given of the fields; the box that of the polygon where there is none. Records without a file name go; a document of neither layout raises. With
    ``least_score``, a missing score counts as 0."""
    from ..functions import box as B
    from ..functions import text as T

    doc = Document(spark, path)
    if not doc.keys & {"annotations", "entries"}:
        raise ValueError("document of an unknown layout")
    if "annotations" in doc.keys:
        own = doc.rows("annotations", _GUESS, order="_ord")
        rows = own.select(F.col("file_name").alias("file"), F.col("_ord").alias("ord"), F.struct(*[c for c in own.columns if c != "_ord"]).alias("a"))
    else:
        entry = doc.rows("entries", _ENTRY, order="_ord")
        nested = entry.select(F.coalesce(F.nullif("original_image", F.lit("")), "crop_id").alias("file"), "_ord", F.posexplode("text_instances").alias("k", "a"))
        rows = nested.select("file", (F.col("_ord") * (1 << 20) + F.col("k")).alias("ord"), "a")
    rows = rows.where("file <> ''")
    b, p = F.col("a.bbox"), F.col("a.polygon")
    corners = F.array(b[0], b[1], b[0] + b[2], b[1] + b[3]) if mode == "xywh" else b
    around = B.polygon_box(F.transform(p, lambda v: v[0]), F.transform(p, lambda v: v[1]))
    box = F.when(b.isNotNull(), F.when(F.size(b) == 4, B.box(corners[0], corners[1], corners[2], corners[3])).otherwise(F.raise_error(F.lit("box without four values")).cast("struct<x1:double,y1:double,x2:double,y2:double>"))).otherwise(around)
    out = rows.select(T.image_key(F.col("file")).alias("image_id"), "ord", F.coalesce(*[F.col(f"a.{f}") for f in text_fields], F.lit("")).alias("text"), box.alias("box"), F.col("a.score").alias("score"))
    return out if least_score is None else out.where(F.coalesce("score", F.lit(0.0)) >= least_score)


def typed_csv(spark: SparkSession, path: str, schema: str, most: int | None = None) -> DataFrame:
    """A CSV file with a header, columns found by name whatever their case and cast as the schema says; whole numbers may be written with a fraction of zeros. A column that isn't there raises."""
    from pyspark.sql.types import IntegralType, StructType

    raw = spark.read.csv(path, header=True)
    by = {c.lower(): c for c in raw.columns}
    fields = StructType.fromDDL(schema).fields
    missing = [f.name for f in fields if f.name.lower() not in by]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    cast = lambda f: F.col(f"`{by[f.name.lower()]}`").cast("double").cast(f.dataType) if isinstance(f.dataType, IntegralType) else F.col(f"`{by[f.name.lower()]}`").cast(f.dataType)
    out = raw.select(*[cast(f).alias(f.name) for f in fields])
    return out if most is None else out.limit(most)


def sharded_rows(spark: SparkSession, folder: str, patterns: tuple[str, ...] = ("train-*.parquet", "test-*.parquet", "*.parquet"), columns: list[str] | None = None) -> DataFrame:
    """Rows of a folder's Parquet shards with file and row_index, of the first pattern that names any file; no file at all raises."""
    from pyspark.errors import AnalysisException

    for pattern in patterns:
        try:
            df = spark.read.option("pathGlobFilter", pattern).parquet(folder)
        except AnalysisException as e:
            if e.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
                raise
            continue
        wanted = [F.col(f"`{c}`") for c in columns] if columns else [F.col("*")]
        return df.select(*wanted, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_index"))
    raise FileNotFoundError(f"no Parquet file in {folder}")


def file_slice(spark: SparkSession, path: str, start: int, count: int | None = None) -> DataFrame:
    """Rows [start, start + count) of one Parquet file, by its own row numbers."""
    at = F.col("_metadata.row_index")
    rows = spark.read.parquet(path).where(at >= start)
    return rows if count is None else rows.where(at < start + count)


def image_columns(df: DataFrame, level: int) -> DataFrame:
    """id, high, low whatever the layout: a pair of high and of low quality at a level, or one image that is both. Columns of neither layout raise."""
    if {"hq_img", f"lq_img_lv{level}"} <= set(df.columns):
        return df.select("id", F.col("hq_img").alias("high"), F.col(f"lq_img_lv{level}").alias("low"))
    if "image" in df.columns:
        return df.select("id", F.col("image").alias("high"), F.col("image").alias("low"))
    raise ValueError(f"no image columns among {df.columns}")


def manifest(spark: SparkSession, path: str, count: int) -> DataFrame:
    """The first ``count`` rows of a JSON-lines manifest by sample_index; fewer than that raise."""
    rows = spark.read.json(path).orderBy("sample_index").limit(count)
    if (n := rows.count()) < count:
        raise ValueError(f"the manifest has {n} rows, {count} are wanted")
    return rows


_COCO_IMAGE = "id bigint, file_name string, width int, height int"
_COCO_NOTE = "id bigint, image_id bigint, category_id bigint, bbox array<double>, area double, iscrowd int, segmentation array<array<double>>, keypoints array<double>, rec array<int>, bezier_pts array<double>"


def coco_document(spark: SparkSession, path: str, root: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of a detection JSON document. Category ids are numbered from 0 in their own order; polygons of under three points or an odd number of values go, and an
    annotation all of whose polygons went too; keypoints are moved by half a pixel. Texts (codes in rec) and curves come along as they are. A repeated annotation id raises."""
    from ..functions import box as B

    from pyspark.sql import Window

    doc = Document(spark, path)
    categories = doc.rows("categories", "id bigint, name string").withColumn("number", F.row_number().over(Window.orderBy("id")) - 1)  # a row a category
    images = doc.rows("images", _COCO_IMAGE).select(F.col("id").alias("image_id"), F.concat(F.lit(root.rstrip("/") + "/" if root else ""), "file_name").alias("file_name"), "width", "height")
    rows = doc.rows("annotations", _COCO_NOTE)
    once = F.when(F.count("*").over(Window.partitionBy("id")) == 1, True).otherwise(F.raise_error(F.lit("annotation ids are not unique")).cast("boolean"))
    valid = B.valid_polygons(F.col("segmentation"))
    own = rows.withColumn("_once", once).where(F.col("_once") & (F.col("segmentation").isNull() | (F.size("segmentation") == 0) | (F.size(valid) > 0)))
    own = own.join(F.broadcast(categories.select(F.col("id").alias("category_id"), "number")), "category_id")  # a row a category
    kept = own.select(F.col("id").alias("annotation_id"), "image_id", F.col("number").alias("category"), "bbox", F.coalesce("iscrowd", F.lit(0)).alias("iscrowd"), F.when(F.size(valid) > 0, valid).alias("segmentation"), B.shifted_keypoints(F.col("keypoints")).alias("keypoints"), "rec", "bezier_pts")
    return images, kept, categories


def sibling_listing(spark: SparkSession, images: str, ending: str, labels: str, siblings: dict[str, str]) -> DataFrame:
    """file and a path for each sibling: files below ``images`` that end so, with the folder swapped for ``labels`` and the ending for the sibling's. Only names are read."""
    files = files_with(spark, images, ending)
    at = F.expr("length(path)") - len(ending)
    inner = F.regexp_replace(F.expr(f"substr(path, 1, length(path) - {len(ending)})"), "^.*?" + re.escape(images.rstrip("/").rsplit("/", 1)[-1]) + "/", "")
    return files.where(at > 0).select(F.col("path").alias("file"), *[F.concat(F.lit(labels.rstrip("/") + "/"), inner, F.lit(e)).alias(n) for n, e in siblings.items()])


def tab_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def tag_lines(spark: SparkSession, path: str) -> DataFrame:
    """item, tag: a row for each tag of lines 'item,tag,tag,...'."""
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x))
    return text_list(spark, path).select(parts[0].alias("item"), F.explode(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).alias("tag")).where("tag <> ''")


def training_list(listing: DataFrame, annotations: DataFrame, width: float, height: float, most: int = 25) -> DataFrame:
    """A row for each listed file (file_name) that has a usable annotation (file_name, ord, text, box): boxes in centre form as shares of the image with four places, texts as codes. Texts of other than printable
    ASCII or of more than ``most`` characters don't count."""
    from ..functions import box as B
    from ..functions import text as T

    c = B.centred(F.col("box"))
    shares = F.array(*[F.round(v, 4) for v in (c["cx"] / width, c["cy"] / height, c["w"] / width, c["h"] / height)])
    own = annotations.where(T.printable_and_short(F.col("text"), most)).select("file_name", F.struct("ord", shares.alias("box"), "text", T.encode_codes(F.col("text"), most).alias("codes")).alias("a"))
    return listing.join(own.groupBy("file_name").agg(F.sort_array(F.collect_list("a")).alias("annotations")), "file_name")


def remapped_path(path, prefixes: dict[str, str]):
    """A path with back slashes turned and the first of the prefixes that it has replaced."""
    clean = F.regexp_replace(path, r"\\", "/")
    out = F.when(F.lit(False), clean)
    for old, new in prefixes.items():
        out = out.when(clean.startswith(old), F.concat(F.lit(new), F.substring(clean, len(old) + 1, 1 << 20)))
    return out.otherwise(clean)


def lexicon_pairs(spark: SparkSession, path: str, per_image: str | None = None) -> DataFrame:
    """word, display (and image_id) of lines 'WORD display text'; per_image: a pattern whose group is the image's id in the file's name."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("value")).where("value <> ''")
    word = F.split("value", " ")[0]
    pair = [F.upper(word).alias("word"), F.coalesce(F.nullif(F.substring("value", F.length(word) + 2, F.lit(1 << 20)), F.lit("")), word).alias("display")]
    return lines.select(*pair) if per_image is None else lines.select(F.regexp_extract("file", per_image, 1).alias("image_id"), *pair)


def across_chunks(chunks: DataFrame, name: str, chunk: str) -> DataFrame:
    """Names with their chunk; a name in more than one chunk raises."""
    own = chunks.groupBy(name).agg(F.count_distinct(chunk).alias("_n"), F.min(chunk).alias(chunk))
    return own.select(name, F.when(F.col("_n") == 1, F.col(chunk)).otherwise(F.raise_error(F.concat(F.lit("in several chunks: "), F.col(name).cast("string"))).cast(dict(own.dtypes)[chunk])).alias(chunk))


def unescaped(text):
    """A transcription in double quotes without them, with its escaped quotes and back slashes as they are meant; others as they are."""
    inner = F.regexp_replace(F.regexp_replace(F.substring(text, F.lit(2), F.length(text) - 2), r'\\"', '"'), r"\\\\", r"\\")
    return F.when((F.length(text) >= 2) & text.startswith('"') & text.endswith('"'), inner).otherwise(text)
