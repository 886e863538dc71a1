"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgrid.llm import bpe, exact_dedup, language_id, mixing, simhash_dedup
from glyphgrid.llm._common import scratch_dir
from glyphgrid.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if no language has at least this share of it, or if the learned languages make it less likely, by so many nats a trigram, than a source without any language does.
LEAST_SHARE, LEAST_GAIN = 0.5, -1.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which one language has LEAST_SHARE or more and which the languages explain (LEAST_GAIN); those without a letter, other scripts, letter salad and mixtures without a main language go.

    Learns from the documents' own text and lang, over all of them; without any lang nothing can be told, and documents with a letter stay."""
    model = language_id.fit(docs, "text", "lang")
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    carried = docs.select("doc_id", "text", F.col("lang").alias("own_lang"), "source", "n_chars").withColumn("own_id", F.col("doc_id"))
    out = language_id.predict(carried, model, keep=["text", "own_lang", "source", "n_chars", "own_id"])
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE) & (F.col("gain") > LEAST_GAIN)).select(F.col("own_id").alias("doc_id"), "text", F.col("own_lang").alias("lang"), "source", "n_chars")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z and a-z alike), the row with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that SimHash finds and whose five-word shingles have a Jaccard similarity of 0.8 or more, the one with the smallest doc_id stays."""
    return simhash_dedup.simhash_dedup(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each pass that it makes over them."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of the text that they decode to."""
    return bpe.bpe_encode(docs, tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Language ID, near copies' components and BPE have no SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
