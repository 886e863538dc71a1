"""Phrase collocation mining by direct hashing and pruning.

One pass over the texts for each phrase length. A pass counts its phrases exactly and, beside them, throws the phrases that are one word longer
into a fixed number of buckets. The next pass only counts a phrase whose bucket holds enough of them and whose two parts without an end word
were frequent (Apriori); both tests are bitmaps of a fixed size, which let too much through but never too little, so counts stay exact. What a pass counted is a written table, from which
both the phrases and the bitmaps of the next pass are made."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, freeing, hash_ranges, materialise, mix, offsets_of, slices, text_array

#: log2 of the buckets. A worker's counters take a byte each (64 MB) for up to 255 wanted occurrences, a bitmap one bit (8 MB); fewer or more buckets only prune less or more.
BUCKET_BITS = 26
#: Text bytes that are counted at a time; log2 of the buckets of a block, in which bucket counts are put together.
SLICE, BLOCK_BITS = 2 << 20, 16
#: Pieces of a language's ranking, each cut to the wanted number before they are put together.
RANKING_PIECES = 16

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


class Grams:
    """The distinct phrases of one length in a slice of texts. id: at each word the phrase that begins there, -1 if none that is wanted; hash, text, count, lang, tail (its last word): of each phrase."""

    def __init__(self, values: pa.Array, lang: np.ndarray, langs: list[str]):
        """Phrases of one word. lang: the number in ``langs`` of each text's language."""
        off = offsets_of(values)
        data = _FOLD[np.frombuffer(values.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]] if len(values) else np.zeros(0, np.uint8)
        off = off - off[0]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        inside = ~_GAP[data]
        start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
        end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
        own = np.searchsorted(off, start, side="right") - 1  # each word's text; empty texts own none
        before = np.concatenate(([0], np.cumsum(_BREAK[data])))
        #: Whether the next word stands in the same piece.
        self.linked = (own[1:] == own[:-1]) & (before[start[1:]] == before[end[:-1]])
        place = np.concatenate(([0], np.cumsum(end - start)))
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(place), pa.py_buffer(data[inside])).dictionary_encode()
        text, code = words.dictionary, words.indices.to_numpy()
        size = max(1, len(text))
        found, self.id, self.count = np.unique(lang[own] * size + code, return_inverse=True, return_counts=True)
        self.lang, which = found // size, found % size
        self.text = self.tail = text.take(pa.array(which))
        at = offsets_of(text)
        self.word = hash_ranges(np.frombuffer(text.buffers()[2] or b"", np.uint8), at[:-1], at[1:])[which]  # of the last word
        self.hash = mix(np.array([xxhash.xxh64_intdigest(x, 1) for x in langs], np.uint64)[self.lang] ^ self.word)

    def buckets(self, bits: int) -> np.ndarray:
        return (self.hash >> np.uint64(64 - bits)).astype(np.int64)

    def keep(self, wanted: np.ndarray) -> None:
        """Only the wanted phrases stay."""
        number = np.where(wanted, np.cumsum(wanted) - 1, -1)
        self.id = np.where(self.id >= 0, number[self.id], -1)
        self.lang, self.hash, self.word, self.count = (x[wanted] for x in (self.lang, self.hash, self.word, self.count))
        mask = pa.array(wanted)
        self.text, self.tail = self.text.filter(mask), self.tail.filter(mask)

    def longer(self, texts: bool = True) -> Grams:
        """The phrases of one word more whose parts without the first and without the last word are both among these."""
        out = object.__new__(Grams)
        first, second = self.id[:-1], self.id[1:]
        has = np.flatnonzero(self.linked & (first >= 0) & (second >= 0))
        size = max(1, len(self.hash))
        found, number, out.count = np.unique(first[has] * size + second[has], return_inverse=True, return_counts=True)
        head, tail = found // size, found % size
        out.id = np.full(len(first), -1)
        out.id[has] = number
        out.linked = self.linked[:-1]
        out.lang, out.word = self.lang[head], self.word[tail]
        out.hash = mix(self.hash[head] * np.uint64(0x9FB21C651E98DF25) ^ out.word)
        if texts:
            out.tail = self.tail.take(pa.array(tail))
            out.text = pc.binary_join_element_wise(self.text.take(pa.array(head)), out.tail, pa.scalar(" ", pa.large_string()))
        return out


_RAW = "lang string, phrase string, bucket int, n long, block int, places binary, counts binary"


def _counts(size: int, frequent: list[Broadcast], crowded: Broadcast | None, last: bool, bucket_bits: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of three kinds: phrases of ``size`` words of each slice with their bucket and number; with a language alone, its words; and at a task's end, for each block
    of buckets, the places of those that phrases of one word more fell into and their counts, which stop at ``least``."""
    names, number = ["lang", "phrase", "bucket", "n", "block", "places", "counts"], np.min_scalar_type(least)
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def table(**columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.record_batch([columns[c].cast(t) if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds, strict=True)], names=names)

    def has(bits: Broadcast, grams: Grams) -> np.ndarray:
        at = grams.buckets(bucket_bits)
        return (bits.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None if last else np.zeros(1 << bucket_bits, number)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                coded = part.column(1).dictionary_encode()
                langs = coded.dictionary.to_pylist()
                grams = Grams(text_array(part, "text"), coded.indices.to_numpy().astype(np.int64), langs)
                if size == 1:
                    yield table(lang=pa.array(langs, pa.string()), n=pa.array(np.bincount(grams.lang, weights=grams.count, minlength=len(langs)).astype(np.int64)))
                for bits in frequent:
                    grams.keep(has(bits, grams))
                    grams = grams.longer()
                if crowded is not None:
                    grams.keep(has(crowded, grams))
                yield table(lang=pa.array(langs, pa.string()).take(pa.array(grams.lang)), phrase=grams.text, bucket=pa.array(grams.buckets(bucket_bits)), n=pa.array(grams.count))
                if total is not None:
                    more = grams.longer(texts=False)
                    at, which = np.unique(more.buckets(bucket_bits), return_inverse=True)
                    total[at] = np.minimum(total[at] + np.bincount(which, more.count, len(at)), least).astype(number)
        at = np.zeros(0, np.int64) if total is None else np.flatnonzero(total)
        if len(at):
            blocks, first = np.unique(at >> BLOCK_BITS, return_index=True)
            ends = np.append(first, len(at)).astype(np.int32)
            places, counts = (at & ((1 << BLOCK_BITS) - 1)).astype("<u2"), total[at]
            cut = lambda values: pa.BinaryArray.from_buffers(pa.binary(), len(blocks), [None, pa.py_buffer(ends * np.int32(values.itemsize)), pa.py_buffer(values)])
            for k in range(0, len(blocks), 64):
                yield table(block=pa.array(blocks), places=cut(places), counts=cut(counts)).slice(k, 64)

    return freeing(run)


def _crowded(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From bucket counts sorted by block: block, bits of the buckets with ``least`` or more. One block is held at a time."""
    number = np.min_scalar_type(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(1 << BLOCK_BITS, np.int64)

        def closed() -> pa.RecordBatch:
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for block, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    if now is not None:
                        yield closed()
                    now, total[:] = block, 0
                total[np.frombuffer(places, "<u2")] += np.frombuffer(counts, number)
        if now is not None:
            yield closed()

    return freeing(run)


def _crowded_bits(raw: DataFrame, bucket_bits: int, least: int) -> np.ndarray:
    """The buckets that hold ``least`` phrases or more, as bits."""
    blocks = raw.where("block IS NOT NULL").select("block", "places", "counts").repartition("block").sortWithinPartitions("block").mapInArrow(_crowded(least), "block int, bits binary").toArrow()
    out = np.zeros((max(1, 1 << bucket_bits >> BLOCK_BITS), 1 << BLOCK_BITS >> 6), np.uint64)
    for block, bits in zip(blocks.column("block").to_pylist(), blocks.column("bits").to_pylist(), strict=True):
        out[block] = np.frombuffer(bits, "<u8")
    return out.reshape(-1)


def _bitmap(buckets: DataFrame, bucket_bits: int) -> np.ndarray:
    """The buckets of a table as bits: 2^bucket_bits of them, so a bounded array whatever the table."""
    bits = buckets.groupBy(F.shiftright("bucket", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, bucket & 63)")).alias("bits")).toArrow()
    out = np.zeros(1 << bucket_bits >> 6, np.uint64)
    out[bits.column("at").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang", bucket_bits: int = BUCKET_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) of all phrases of 1 to ``longest`` words that occur ``least`` times or more in a language, and (lang, n) with the words of each language.

    Both are written tables. A text's pieces end at ``.,;:!?`` and line ends; words are what blanks and tabs part, A-Z in lower case; a phrase
    lies within a piece, occurrences may overlap. Null texts count as empty, null languages as ``und``."""
    if longest < 1 or least < 1 or not 6 <= bucket_bits <= 30:
        raise ValueError("phrases have a word at least and occur once at least; there are 2^6 to 2^30 buckets")
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    frequent: list[Broadcast] = []
    crowded, tables = None, []
    for size in range(1, longest + 1):
        raw = materialise(source.mapInArrow(_counts(size, frequent, crowded, size == longest, bucket_bits, least), _RAW), f"counts{size}")
        found = raw.where("lang IS NOT NULL").groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n"))
        tables.append(materialise(found.where((F.col("n") >= least) | F.col("bucket").isNull()), f"phrases{size}"))
        if size < longest:
            frequent.append(spark.sparkContext.broadcast(_bitmap(tables[-1].where("phrase IS NOT NULL"), bucket_bits)))
            crowded = spark.sparkContext.broadcast(_crowded_bits(raw, bucket_bits, least))
        discard(raw)
    words = materialise(tables[0].where("bucket IS NULL AND n > 0").select("lang", "n"), "words")
    out = None
    for size, t in enumerate(tables, 1):
        t = t.where("phrase IS NOT NULL").select("lang", "phrase", F.lit(size).alias("size"), F.col("n").alias("a"))
        out = t if out is None else out.unionByName(t)
    out = materialise(out, "phrases")
    discard(*tables)
    return out, words


def scored(phrases: DataFrame, share: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, score) of ``frequent_phrases`` with two words or more: the lowest score of all ways to cut a phrase in two, ties to the shortest first part.

    Phrases that lie inside a longer one with ``share`` per cent or more of their occurrences are left out. Scores are worked out in decimals
    of 38 digits: exact up to some 10^15 occurrences."""
    several = phrases.where("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = several.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.greatest(F.col("size") - 1, F.lit(1)))).alias("k"), "words")
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("first"), F.expr("array_join(slice(words, k + 1, size(words) - k), ' ')").alias("rest"))
    own = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cuts = cuts.join(own.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"]).join(own.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"])
    score = F.expr("(CAST(a AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(18, 0)) * 1000000) div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    longer = several.where("size > 2").select("lang", F.col("a").alias("most"), F.expr("flatten(transform(sequence(2, greatest(size - 1, 2)), n -> transform(sequence(1, greatest(size - n + 1, 1)), i -> array_join(slice(words, i, n), ' '))))").alias("inside"))
    longer = longer.select("lang", "most", F.explode("inside").alias("phrase")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    best = best.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, text_col: str = "text", lang_col: str = "lang", bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Each language's first ``top`` phrases by score, then occurrences (both descending), then the phrase in byte order: lang, rank (from 1), phrase, a, l, r, n, score.

    Repeated rows count each time; an empty table, or one without a phrase that is frequent enough, gives no rows."""
    phrases, words = frequent_phrases(docs, longest, least, text_col, lang_col, bucket_bits)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    piece = F.pmod(F.hash("phrase"), F.lit(RANKING_PIECES))
    first = scored(phrases).withColumn("piece", piece).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "piece").orderBy(*order))).where(F.col("rank") <= top)
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return out.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
