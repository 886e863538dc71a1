"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

A document is a mask with one bit for each filter that it fails. Masks are counted by part first, so a table of any size becomes at most
2^filters cells a part; the cells are unpivoted against the steps of every order, a running bit-or over the steps before tells what an earlier
filter has removed already, and sums by step, then a total by filter over all orders, give the figures. DataFrame functions only."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, materialise

#: The separators of words, as a regular expression.
_GAP = r"[\x20\x09-\x0D]+"
#: More filters have more than 5,040 orders.
MOST_FILTERS = 7


def text_filters(text: Column) -> dict[str, Column]:
    """Conditions under which a text fails, null as empty: A under 200 words, B under half of the words distinct, C over 3 % capital letters A-Z, D any of ``#$%&*|``."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, _GAP), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def facts_of(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, part (null: empty), mask with bits 0 to 3 for the filters A to D that the row fails, digest (SHA-256 of the text)."""
    text, row = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{id_col}`").cast("long")
    bits = [F.when(test, F.lit(1 << k)).otherwise(0) for k, test in enumerate(text_filters(text).values())]
    return docs.select(row.alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), sum(bits[1:], bits[0]).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))


def with_copies(facts: DataFrame) -> DataFrame:
    """doc_id, part, mask: bit 4 is filter E, which fails a text that a smaller id has too.

    Texts are compared by digest, so only 32 bytes of each are shuffled: the smallest id of each text is a plain minimum, and rows meet it by
    (id, digest), keys of few rows however many copies a text has. Rows that repeat the smallest id all pass, so do rows without an id, which
    are no one's smaller copy either."""
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return facts.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def mask_cells(masks: DataFrame, counts: list[str] | None = None) -> DataFrame:
    """part, mask, n, and n_<name> for each column of ones and zeros in ``counts``: the rows of each mask of each part."""
    return masks.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.sum(F.col(f"`{c}`").cast("long")).alias(f"n_{c}") for c in counts or []))


def order_audit(cells: DataFrame, filters: str, counts: list[str] | None = None) -> DataFrame:
    """For each part of ``mask_cells``, each order of ``filters`` (one letter each; bit k of ``mask`` is the k-th letter) and each step: the figures of the filter at that step.

    kept: rows that no filter up to this step fails; removed: failed here first; redundant: failed here, but removed earlier; unique_fails:
    failed by this filter only; shapley: the filter's removed rows summed over all orders; <name>_lost: the removed rows of each of ``counts``. Steps that remove nothing have rows of zeros."""
    if not 1 <= len(filters) <= MOST_FILTERS or len(set(filters)) != len(filters):
        raise ValueError(f"1 to {MOST_FILTERS} different filters are needed")
    counts = counts or []
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    steps = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    place = F.instr(F.lit(filters), F.col("filter_order").substr(F.col("step"), F.lit(1))) - 1
    steps = steps.withColumn("bit", F.call_function("shiftleft", F.lit(1), place))
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("bit").over(before), F.lit(0)))
    mask, bit = F.col("mask"), F.col("bit")
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(F.col("earlier")) != 0

    def total(when: Column, of: str = "n") -> Column:
        return F.sum(F.when(when, F.col(of)).otherwise(F.lit(0).cast("long")))

    out = steps.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        *(total(fails & ~gone, f"n_{c}").alias(f"{c}_lost") for c in counts),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def filter_audit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "lang") -> DataFrame:
    """The audit of the filters A to E over all rows of ``docs``, by part (null and empty are one): part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost (``labels`` quality 1), toxic_lost (toxic 1), shapley.

    Rows without a label or an id are neither good nor toxic; of several labels of an id, one that says 1 is enough. Other columns of either table play
    no part. An empty table gives no rows."""
    facts = materialise(facts_of(docs, text_col, id_col, part_col), "facts")
    lab = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col("quality"), F.col("toxic")).where("doc_id IS NOT NULL")
    lab = lab.groupBy("doc_id").agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))))
    masks = with_copies(facts).join(lab, "doc_id", "left").fillna(0, ["good", "toxic"])
    cells = materialise(mask_cells(masks, ["good", "toxic"]), "cells")
    discard(facts)
    return order_audit(cells, "ABCDE", ["good", "toxic"])
