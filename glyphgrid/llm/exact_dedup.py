"""Exact dedup with counting quotient filters.

A filter splits a 64-bit fingerprint into a quotient (its high bits: which run) and a remainder (the rest, sorted in
its run, with a count). One filter is built per partition; filters merge without loss, run by run, by merging sorted
remainders. Only fingerprints whose merged count is above one have their texts compared byte for byte."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, freeing, materialise, text_array

#: Distinct fingerprints that one merged block of the filter is meant to hold; the number of blocks follows the table.
BLOCK_FINGERPRINTS = 500_000


class CountingQuotientFilter:
    """Sorted remainders by quotient, with counts; ``quotient_bits`` high bits are the quotient."""

    def __init__(self, quotient_bits: int, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.q, self.runs, self.remainders, self.counts = quotient_bits, runs, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, quotient_bits: int = 8) -> CountingQuotientFilter:
        """Of unsigned 64-bit fingerprints, repeats allowed; counts: how often each stands for itself (default once)."""
        distinct, back = np.unique(fingerprints.astype(np.uint64), return_inverse=True)
        total = np.bincount(back, weights=None if counts is None else counts, minlength=len(distinct)).astype(np.int64)
        shift = np.uint64(64 - quotient_bits)
        runs = np.searchsorted(distinct >> shift, np.arange((1 << quotient_bits) + 1, dtype=np.uint64))
        return cls(quotient_bits, runs, distinct & ((np.uint64(1) << shift) - np.uint64(1)), total)

    def run(self, quotient: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.runs[quotient], self.runs[quotient + 1])
        return self.remainders[part], self.counts[part]

    @staticmethod
    def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Of one quotient: the sorted remainders of all, equal ones with their counts added."""
        rest, count = (np.concatenate(x) for x in zip(*runs, strict=True))
        order = np.argsort(rest, kind="stable")  # merges already sorted pieces
        rest, count = rest[order], count[order]
        first = np.flatnonzero(np.concatenate(([True], rest[1:] != rest[:-1]))) if len(rest) else np.zeros(0, int)
        return rest[first], np.add.reduceat(count, first) if len(rest) else count


def _normalised(text: bytes) -> bytes:
    return text.lower()  # bytes.lower changes A-Z only


def exact_classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, raw_hash (XXH64 of the text as it is).

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text. The largest id of a group stays; of repeated rows with
    that same id exactly one is kept; null ids sort lowest. Empty input gives no rows. Other columns of ``docs`` are not read."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("raw_hash"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_normalised((t.as_py() or "").encode()) for t in batch.column(1)]
            fp = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(fp.view(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], names=["doc_id", "raw_hash", "fp", "text_sha256"])

    digests = source.mapInArrow(freeing(digest), "doc_id long, raw_hash long, fp long, text_sha256 string").withColumn("rid", F.monotonically_increasing_id())
    digests = materialise(digests, "digests")
    repeated = materialise(repeated_fingerprints(digests.select("fp")), "repeated")

    def with_fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_normalised(t) for t in text_array(batch, "text").cast(pa.large_binary()).to_pylist()]
            fp = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64)), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "fp", "norm"])

    # Byte verification: grouping by the text itself compares bytes, and copies collapse before the shuffle.
    suspects = source.select("doc_id", "text").mapInArrow(freeing(with_fingerprint), "doc_id long, fp long, norm string").join(repeated.select("fp"), "fp", "left_semi")
    classes = suspects.groupBy("fp", "norm").agg(F.max("doc_id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    classes = classes.select("fp", F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"), "keep", "n")
    # A repeated row shares its id with its twin: the lowest row number of the two stands.
    twins = digests.groupBy("fp", "text_sha256", "doc_id").agg(F.min("rid").alias("first_rid"), F.count("*").alias("t")).where("t > 1")
    out = digests.join(classes, ["fp", "text_sha256"], "left").join(twins.withColumnRenamed("doc_id", "twin_id"), [digests.fp == twins.fp, digests.text_sha256 == twins.text_sha256, digests.doc_id.eqNullSafe(F.col("twin_id"))], "left").select(digests["*"], "keep", "n", "first_rid")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    kept = F.col("doc_id").eqNullSafe(keep) & (F.col("rid") == F.coalesce("first_rid", "rid"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), kept.alias("kept"), "text_sha256", "raw_hash")


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(fp, n) of the values of the long column fp that occur more than once, by merged counting quotient filters."""
    rows = fingerprints.count()
    bits = max(4, int(np.ceil(np.log2(max(1, rows / BLOCK_FINGERPRINTS)))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.unique(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), return_counts=True) for b in batches]
        if not parts:
            return
        own = CountingQuotientFilter.build(*(np.concatenate(x) for x in zip(*parts, strict=True)), quotient_bits=bits)
        runs = [(q, *own.run(q)) for q in range(1 << bits)]
        runs = [r for r in runs if len(r[1])]
        yield pa.record_batch([pa.array([q for q, _, _ in runs], pa.int32()), pa.array([r.tobytes() for _, r, _ in runs], pa.binary()), pa.array([c.tobytes() for _, _, c in runs], pa.binary())], names=["quotient", "remainders", "counts"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        q = int(pdf["quotient"].iloc[0])
        rest, count = CountingQuotientFilter.merge_runs([(np.frombuffer(r, np.uint64), np.frombuffer(c, np.int64)) for r, c in zip(pdf["remainders"], pdf["counts"], strict=True)])
        many = count > 1
        return pd.DataFrame({"fp": ((np.uint64(q) << np.uint64(64 - bits)) | rest[many]).view(np.int64), "n": count[many]})

    filters = fingerprints.mapInArrow(freeing(build), "quotient int, remainders binary, counts binary")
    return filters.groupBy("quotient").applyInPandas(merge, "fp long, n long")


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of equal texts (the largest id), all columns as they were, whatever their names.

    Rows are told apart by id and text: of rows alike in both, one stays. An empty table stays empty."""
    name = lambda id_, hash_: F.concat_ws(":", F.coalesce(id_.cast("long").cast("string"), F.lit("")), hash_.cast("string"))
    key = fresh(docs, "key")[0]
    stay = exact_classes(docs, text_col, id_col).where("kept").select(name(F.col("doc_id"), F.col("raw_hash")).alias(key)).distinct()
    own = docs.withColumn(key, name(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))))
    # One key for the join and the grouping, so the texts are shuffled once.
    return own.join(stay, key, "left_semi").dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])
