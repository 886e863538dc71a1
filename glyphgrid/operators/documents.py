"""Detection documents as tables: final entries, nested form and back, answers of annotators, restored files, results, merged panoptic records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from ..functions import text as T

#: What a blur classifier says, in either scale, and what is made of it (fixed values).
BLUR_LEVELS = {"not blurry": "Not blurry", "slightly blurry": "Slightly blurry", "very blurry": "Very blurry"}
SHARPNESS_LEVELS = {"level 1": "Very blurry", "level 2": "Slightly blurry", "level 3": "Not blurry"}
#: Kinds of answers that name no level, told by a pattern, the first that fits.
BLUR_ERRORS = ((r"cannot determine|unable to classify|information is insufficient", "Error: Cannot Classify"), (r"text|content|read", "Error: Focused on Text"))


def final_entries(images: DataFrame, annotations: DataFrame, side: int) -> DataFrame:
    """original_image, crop_id, crop_region, blur_category, text_instances of every image, also of one without annotations.

    images: file_name, blur_category; annotations: file_name, ord, id, text, bbox, score. Missing values: text empty, box of zeros, score 0, id -1, a tag that names the error."""
    zeros = F.array(*[F.lit(0.0)] * 4)
    instance = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("bbox", zeros).alias("bbox"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("id", F.lit(-1)).alias("id"))
    own = annotations.groupBy("file_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", instance.alias("i")))), lambda x: x["i"]).alias("text_instances"))
    out = images.join(own, "file_name", "left")
    empty = F.array().cast("array<struct<text:string,bbox:array<double>,score:double,id:bigint>>")
    region = F.array(F.lit(0), F.lit(0), F.lit(side), F.lit(side))
    return out.select(F.col("file_name").alias("original_image"), F.regexp_replace("file_name", r"(?<=[^/])\.[^./]*$", "").alias("crop_id"), region.alias("crop_region"), F.coalesce("blur_category", F.lit("Error: Tag Missing")).alias("blur_category"), F.coalesce(F.col("text_instances").cast("array<struct<text:string,bbox:array<double>,score:double,id:bigint>>"), empty).alias("text_instances"))


def unnested(nested: DataFrame, references: DataFrame | None = None, side: int = 512) -> DataFrame:
    """A row for each crop of nested records (image_id, blur_category, crops: map of crop to instances with text and bbox): original_image, crop_id, crop_region, blur_category, instances.

    references: image_id, crop_id, crop_region, ord; a crop of the same image in the same place of the order lends its name and region. Without one: the whole square, 'Not blurry', scores of 1."""
    rows = nested.select("image_id", "blur_category", F.explode("crops").alias("crop", "instances"))
    rows = rows.withColumn("instances", F.transform("instances", lambda x: F.struct(x["text"].alias("text"), x["bbox"].alias("bbox"), F.lit(1.0).alias("score"))))
    named = F.concat_ws("_", "image_id", F.lit("crop"), "crop")
    whole = F.array(F.lit(0), F.lit(0), F.lit(side), F.lit(side))
    if references is not None:
        rows = rows.join(references.select("image_id", F.col("ord").cast("string").alias("crop"), F.col("crop_id").alias("_id"), F.col("crop_region").alias("_region")), ["image_id", "crop"], "left")
        named, whole = F.coalesce("_id", named), F.coalesce("_region", whole)
    return rows.select(F.concat(F.lit("train/"), "image_id", F.lit(".jpg")).alias("original_image"), named.alias("crop_id"), whole.alias("crop_region"), F.coalesce("blur_category", F.lit("Not blurry")).alias("blur_category"), "instances")


def blur_category(answer: Column, sharpness: bool = False) -> Column:
    """The category that an answer names, without its case and full stops at the end; an error class for other answers."""
    clean = F.trim(F.regexp_replace(F.lower(F.trim(answer)), r"\.+$", ""))
    levels = SHARPNESS_LEVELS if sharpness else BLUR_LEVELS
    out = F.when(clean == next(iter(levels)), levels[next(iter(levels))])
    for said, category in list(levels.items())[1:]:
        out = out.when(clean == said, category)
    for pattern, error in BLUR_ERRORS:
        out = out.when(clean.rlike(pattern), error)
    return out.otherwise("Error: Unknown Category")


def renamed_answers(first: DataFrame, second: DataFrame, key: str, text: str, names: tuple[str, str]) -> DataFrame:
    """Rows of both sides by key with each side's text under a name of its own and the common text gone; other columns are the first side's where it has the key."""
    others = [c for c in first.columns if c not in (key, text)]
    a = first.select(key, F.col(text).alias(names[0]), F.struct(*others).alias("_a") if others else F.lit(None).alias("_a"))
    b = second.select(key, F.col(text).alias(names[1]), F.struct(*[c for c in others if c in second.columns]).alias("_b") if set(others) & set(second.columns) else F.lit(None).alias("_b"))
    joined = a.join(b, key, "full_outer")
    return joined.select(key, *names, *[F.coalesce(F.col(f"_a.{c}"), F.col(f"_b.{c}")).alias(c) if c in second.columns else F.col(f"_a.{c}").alias(c) for c in others])


def restored_names(files: DataFrame, path: str, prefix: str = "restored_") -> DataFrame:
    """(source, target) of files whose name has the prefix: the target has it stripped; of two files with one target the first by name counts."""
    name = F.regexp_replace(path, r"^.*/", "")
    own = files.where(name.startswith(prefix)).select(F.col(path).alias("source"), F.substring(name, len(prefix) + 1, 1 << 20).alias("target"))
    return own.groupBy("target").agg(F.min("source").alias("source")).select("source", "target")


def flat_results(results: DataFrame) -> DataFrame:
    """(name, value) of a one-row table of nested structs and maps of numbers; names are joined by a slash. One row a value, so small."""

    def walk(column: Column, kind, name: Column) -> list[Column]:
        if isinstance(kind, StructType):
            return [x for f in kind for x in walk(column[f.name], f.dataType, F.concat_ws("/", name, F.lit(f.name)))]
        if isinstance(kind, MapType):
            if isinstance(kind.valueType, MapType):
                inner = F.flatten(F.transform(F.map_entries(column), lambda e: F.transform(F.map_entries(e["value"]), lambda x: F.struct(F.concat_ws("/", name, e["key"], x["key"]).alias("name"), x["value"].cast("double").alias("value")))))
                return [inner]
            return [F.transform(F.map_entries(column), lambda e: F.struct(F.concat_ws("/", name, e["key"]).alias("name"), e["value"].cast("double").alias("value")))]
        return [F.array(F.struct(name.alias("name"), column.cast("double").alias("value")))]

    parts = [x for f in results.schema for x in walk(F.col(f.name), f.dataType, F.lit(f.name))]
    return results.select(F.inline(F.concat(*parts)))


def main_metrics(results: DataFrame) -> DataFrame:
    """(task, names, values): one comma-separated line a task of its metrics (task, ord, metric, value) but those with a hyphen in their name; values with four places."""
    own = results.where(~F.col("metric").contains("-")).groupBy("task").agg(F.sort_array(F.collect_list(F.struct("ord", "metric", F.format_string("%.4f", "value").alias("shown")))).alias("r"))
    line = lambda c: F.array_join(F.transform("r", lambda x: x[c]), ",")
    return own.select("task", line("metric").alias("names"), line("shown").alias("values"))


def panoptic_records(detection: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Columns of both records of one file, the second's where both have them; a file without its second record raises."""
    clash = [c for c in detection.columns if c in segments.columns and c != key]
    right = segments.withColumnsRenamed({c: f"_{c}" for c in clash}).withColumn("_found", F.lit(True))
    joined = detection.join(right, key, "left")
    checked = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no segments of "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    own = joined.withColumn("_checked", checked).where("_checked")
    return own.select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in clash else c for c in detection.columns if c != key], *[c for c in segments.columns if c != key and c not in clash])


def visual_manifest(truth: DataFrame, restored: DataFrame, guesses: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, missing): truths with their restored file and, where there is one, their guess; truths without a restored file."""
    return truth.join(restored, key).join(guesses, key, "left"), truth.join(restored.select(key).distinct(), key, "left_anti")


def paired_scenes(high: DataFrame, low: DataFrame, key: str, source: str, quota: int, order: list[str]) -> DataFrame:
    """Scenes that have both qualities, the first ``quota`` of each source by order. Ranked with a limit, so a source's scenes needn't meet in one task."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return high.join(low, key).withColumn("_rank", rank).where(F.col("_rank") <= quota).drop("_rank")


def restricted(groups: DataFrame, ids: DataFrame, key: str, value: str) -> DataFrame:
    """Every id with its values; an id without any keeps an empty array."""
    own = groups.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(value))
    kind = dict(own.dtypes)[value]
    return ids.select(key).distinct().join(own, key, "left").withColumn(value, F.coalesce(value, F.array().cast(kind)))


def large_enough(images: DataFrame, annotations: DataFrame, key: str, side: int) -> DataFrame:
    """Images of at least ``side`` in both dimensions that have an annotation."""
    return images.where((F.col("width") >= side) & (F.col("height") >= side)).join(annotations.select(key).distinct(), key, "left_semi")


def joined_answers(questions: DataFrame, *answers: DataFrame, key: str) -> DataFrame:
    """Questions with every answer table by key, in turn; a question that lacks one goes."""
    for a in answers:
        questions = questions.join(a, key)
    return questions


def by_image_and_question(answers: DataFrame, annotations: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Answers (image_id, prompt) with the annotation (image_id, question) of the question that their prompt holds, whatever its case."""
    own = answers.withColumn("_question", T.prompt_question(F.col(prompt)))
    other = annotations.withColumn("_question", F.lower("question")).withColumnRenamed("image_id", "_image")
    return own.join(other, (own["image_id"] == other["_image"]) & (own["_question"] == other["_question"])).drop(other["_question"]).drop("_question", "_image")
