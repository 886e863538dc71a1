"""Substring dedup with suffix automata of reference shards.

Every window of WINDOW words has a content-defined anchor: the smallest hash of SEED words in it. Equal windows have equal anchors, so anchors
route text to reference shards: a shard is the distinct passages about one anchor. A passage that occurs as a whole more than once needs
no further look. For the rest each shard is made a suffix automaton with occurrence counts, and the passages are streamed through it for matching
statistics: where a suffix of WINDOW words has two occurrences, its words go. Words are compared by digests of 128 bits, runs of words by two hashes, one over each half of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, freeing, materialise, mix, powers, signed, slices, text_array, windows

WINDOW, SEED = 35, 8
#: Anchors whose repeats one task settles before the shuffle, and passages that one automaton holds at most; a larger shard is settled window by window.
LOCAL_ANCHORS, SHARD_PASSAGES = 500_000, 3_000
_FULL, _OPEN, _REFERENCE = 0, 1, 2
_LOW = np.uint64((1 << 28) - 1)
#: Rows of one anchor, or of one window's hash, that are held at once.
HELD = 2_000_000


class SuffixAutomaton:
    """Of several word sequences; count[s]: occurrences of the sequences that end in state s."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, arcs: dict[bytes, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, c: bytes, q: int) -> int:
        """The state of the sequences of q that end in p's and c."""
        if self.length[p] + 1 == self.length[q]:
            return q
        own = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = own
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = own
            p = self.link[p]
        return own

    def add(self, words: list[bytes]) -> None:
        last = 0
        for c in words:
            q = self.next[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
            else:
                own = self._state(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = own
                    p = self.link[p]
                if p >= 0:
                    self.link[own] = self._split(p, c, self.next[p][c])
                last = own
            self.count[last] += 1

    def close(self) -> None:
        """Counts of occurrences, from the longest sequences to their suffixes."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def repeated(self, words: list[bytes], size: int) -> list[bool]:
        """Of each run of ``size`` words of a sequence: whether it has a second occurrence. Words that lead nowhere end the match."""
        out, s, depth = [], 0, 0
        for k, c in enumerate(words):
            while s > 0 and c not in self.next[s]:
                s = self.link[s]
                depth = self.length[s]
            if c in self.next[s]:
                s, depth = self.next[s][c], depth + 1
            t = s
            if depth >= size:
                while self.length[self.link[t]] >= size:
                    t = self.link[t]
            if k >= size - 1:
                out.append(depth >= size and self.count[t] > 1)
        return out


def _sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    step = 1
    while 2 * step <= size:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = size - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(w: Words, hashes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (anchor hash, two hashes of all words of the run, text, first window, windows). Windows are numbered by word within their text."""
    n = len(hashes)
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if n < WINDOW:
        return none
    seeds = windows(hashes, SEED)
    best = _sliding_least((seeds & ~_LOW) | np.arange(len(seeds), dtype=np.uint64), WINDOW - SEED + 1)
    at = (best & _LOW).astype(np.int64)
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    valid = text[: n - WINDOW + 1] == text[WINDOW - 1 :]
    p = np.flatnonzero(valid)
    if not len(p):
        return none
    new = np.concatenate(([True], (at[p[1:]] != at[p[:-1]]) | (text[p[1:]] != text[p[:-1]])))
    first = p[new]
    count = np.diff(np.append(np.flatnonzero(new), len(p)))
    # Hashes over [first, first + count + WINDOW - 1), its length mixed in.
    power, inverse = powers(n + 1)
    both = []
    for values in (hashes, others):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power[:n], out=total[1:])
        both.append(mix((total[first + count + WINDOW - 1] - total[first]) * inverse[first] + count.astype(np.uint64)))
    own = text[first]
    return seeds[at[first]], *both, own, first - w.first[own], count


def _sorted_groups(batches: Iterator[pa.RecordBatch], keys: int, limit: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns as arrays, cut where one of the first ``keys`` columns changes, and of each row whether it belongs to a group that comes in pieces: one of more than ``limit``
    rows, cut where the next column changes."""
    held: list[np.ndarray] | None = None
    open_: list | None = None

    def piece(cut: int, goes_on: bool) -> tuple[list[np.ndarray], np.ndarray]:
        nonlocal held, open_
        out, held = [c[:cut] for c in held], [c[cut:] for c in held]
        flag = np.logical_and.reduce([c == x for c, x in zip(out, open_, strict=False)]) if open_ else np.zeros(cut, bool)
        open_ = [c[-1] for c in out[:keys]] if goes_on else None
        return out, flag | goes_on

    for batch in batches:
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
        if not len(held[0]):
            continue
        last = np.logical_and.reduce([c == c[-1] for c in held[:keys]])
        cut = 0 if last.all() else int(np.flatnonzero(~last)[-1]) + 1
        if cut:
            yield piece(cut, False)
        elif len(held[0]) > limit and (cut := int(np.searchsorted(held[keys], held[keys][-1]))):
            yield piece(cut, True)
    if held is not None and len(held[0]):
        yield piece(len(held[0]), False)


def _find_anchors(local: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """route, anchor, whole, other, key, first, windows, state. Repeats among ``local`` anchors or so of a task are settled here: one goes on as known to be
    repeated (state _REFERENCE), the others are _FULL and are dealt out by document."""

    def settle(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        anchor, whole, other, key, first, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((other, whole, anchor))
        anchor, whole, other, key, first, count = (x[order] for x in (anchor, whole, other, key, first, count))
        same = (anchor[1:] == anchor[:-1]) & (whole[1:] == whole[:-1]) & (other[1:] == other[:-1])
        later, earlier = np.concatenate(([False], same)), np.concatenate((same, [False]))
        state = np.where(later, _FULL, np.where(earlier, _REFERENCE, _OPEN)).astype(np.int8)
        route = np.where(later, mix(key.view(np.uint64)), anchor)
        columns = [signed(route), signed(np.where(later, np.uint64(0), anchor)), signed(whole), signed(other), pa.array(key), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(state)]
        return pa.record_batch(columns, names=["route", "anchor", "whole", "other", "key", "first", "windows", "state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(text_array(part, "text"))
                anchor, whole, other, text, first, count = anchors(w, *w.digests())
                parts.append((anchor, whole, other, part.column(0).to_numpy()[text], first, count))
                held += len(anchor)
                if held >= local:
                    yield settle(parts)
                    parts, held = [], 0
        if held:
            yield settle(parts)

    return run


def _mark(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows sorted by anchor, whole and other: anchor, key, first, windows, kind of all runs that have or may have repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (anchor, whole, other, key, first, count, state), cut in _sorted_groups(batches, 1, limit):
            settled = anchor == 0
            same_anchor = np.concatenate(([False], anchor[1:] == anchor[:-1]))
            same = same_anchor & np.concatenate(([False], (whole[1:] == whole[:-1]) & (other[1:] == other[:-1]))) & ~settled
            number = np.cumsum(~same) - 1  # of equal runs
            size = np.bincount(number)
            full = ((size > 1) | (np.bincount(number, state == _REFERENCE) > 0))[number]
            group = np.cumsum(~same_anchor) - 1
            several = (np.bincount(group, ~same) > 1)[group] | cut
            kind = np.where(settled | (full & (same | ~several)), _FULL, np.where(full, _REFERENCE, _OPEN)).astype(np.int8)
            keep = settled | full | several
            yield pa.record_batch([pa.array(anchor[keep]), pa.array(key[keep]), pa.array(first[keep]), pa.array(count[keep]), pa.array(kind[keep])], names=["anchor", "key", "first", "windows", "kind"])

    return run


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """anchor, key, first, kind, words (16 bytes each) of every run that is to be looked into or to be a reference."""
    for batch in batches:
        for part in slices(batch, "text"):
            w = Words(text_array(part, "text"))
            both = np.stack(w.digests(), axis=1)
            runs = part.column(1).combine_chunks() if isinstance(part.column(1), pa.ChunkedArray) else part.column(1)
            owner = np.repeat(np.arange(len(runs)), runs.value_lengths().to_numpy())
            flat = runs.flatten()
            anchor, first, count, kind = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            base = w.first[owner] + first
            words = [both[a : a + n + WINDOW - 1].tobytes() for a, n in zip(base.tolist(), count.tolist(), strict=True)]
            yield pa.record_batch([pa.array(anchor), part.column(0).take(pa.array(owner)), pa.array(first), pa.array(kind), pa.array(words, pa.binary())], names=["anchor", "key", "first", "kind", "words"])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of true flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


def _look_into(passages: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From passages sorted by anchor: key, first, windows of repeated windows (whole 0), or of single windows of shards of more than ``passages`` with their hashes (whole, other)."""

    def settle(shard: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int, int, int]]:
        if len(shard) < 2 or all(kind == _REFERENCE for _, _, kind, _ in shard):
            return []
        automaton, sequences = SuffixAutomaton(), [[w[k : k + 16] for k in range(0, len(w), 16)] for _, _, _, w in shard]
        for s in sequences:
            automaton.add(s)
        automaton.close()
        out = []
        for (key, first, kind, _), s in zip(shard, sequences, strict=True):
            if kind == _OPEN:
                start, size = _runs(np.array(automaton.repeated(s, WINDOW)))
                out += [(key, first + a, n, 0, 0) for a, n in zip(start.tolist(), size.tolist(), strict=True)]
        return out

    def windows_of(key: int, first: int, kind: int, words: bytes) -> list[tuple[int, int, int, int, int]]:
        halves = np.frombuffer(words, np.uint64).reshape(-1, 2).T
        both = zip(*(windows(x, WINDOW).view(np.int64).tolist() for x in halves), strict=True)
        return [(key, first + p, 1 if kind == _OPEN else 0, h | 1, g) for p, (h, g) in enumerate(both)]

    def table(rows: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
        key, first, count, whole, other = zip(*rows, strict=True) if rows else ([], [], [], [], [])
        return pa.record_batch([pa.array(key, pa.int64()), pa.array(first, pa.int32()), pa.array(count, pa.int32()), pa.array(whole, pa.int64()), pa.array(other, pa.int64())], names=["key", "first", "windows", "whole", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, large, rows = None, [], False, []
        for batch in batches:
            for anchor, *passage in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != now:
                    rows += settle(shard)
                    now, shard, large = anchor, [], False
                if large:
                    rows += windows_of(*passage)
                else:
                    shard.append(tuple(passage))
                    if len(shard) > passages:
                        for p in shard:
                            rows += windows_of(*p)
                        shard, large = [], True
                if len(rows) > 50_000:
                    yield table(rows)
                    rows = []
        yield table(rows + settle(shard))

    return run


def _same_windows(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From single windows sorted by their hashes: those with an equal neighbour; windows 0 marks a reference, which isn't returned itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (whole, other, key, first, count), cut in _sorted_groups(batches, 2, limit):
            same = (whole[1:] == whole[:-1]) & (other[1:] == other[:-1])
            keep = (np.concatenate(([False], same)) | np.concatenate((same, [False])) | cut) & (count > 0)
            yield pa.record_batch([pa.array(key[keep]), pa.array(first[keep]), pa.array(count[keep])], names=["key", "first", "windows"])

    return run


def repeated_spans(docs: DataFrame, passages: int = SHARD_PASSAGES, local: int = LOCAL_ANCHORS, held: int = HELD) -> DataFrame:
    """key, first, windows: all windows of WINDOW words that occur more than once in ``docs`` (key long, text string), as runs by word number."""
    found = docs.select("key", "text").mapInArrow(freeing(_find_anchors(local)), "route long, anchor long, whole long, other long, key long, first int, windows int, state byte")
    sorted_ = found.repartition("route").drop("route").sortWithinPartitions("anchor", "whole", "other")
    marks = materialise(sorted_.mapInArrow(freeing(_mark(held)), "anchor long, key long, first int, windows int, kind byte"), "marks")
    unsure = marks.where(F.col("kind") != _FULL).groupBy("key").agg(F.collect_list(F.struct("anchor", "first", "windows", "kind")).alias("runs"))
    texts = docs.select("key", "text").join(unsure, "key").select("key", "runs", "text").mapInArrow(freeing(_passages), "anchor long, key long, first int, kind byte, words binary")
    looked = texts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(freeing(_look_into(passages)), "key long, first int, windows int, whole long, other long")
    looked = materialise(looked, "looked")
    single = looked.where("whole <> 0").select("whole", "other", "key", "first", "windows").repartition("whole", "other").sortWithinPartitions("whole", "other", "key")
    single = single.mapInArrow(freeing(_same_windows(held)), "key long, first int, windows int")
    sure = marks.where(F.col("kind") != _OPEN).select("key", "first", "windows")
    return sure.unionByName(looked.where("whole = 0").select("key", "first", "windows")).unionByName(single)


def substring_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", passages: int = SHARD_PASSAGES, local: int = LOCAL_ANCHORS, held: int = HELD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_text (words that stay, joined by a space).

    A word goes if a window of 35 words over it occurs anywhere else too, in this document or another; all occurrences go. Null
    texts have no words. Repeated rows are documents of their own, so all windows of both go. An empty table gives no rows."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(own, passages, local, held).groupBy("key").agg(F.collect_list(F.struct("first", "windows")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode().split()
                if spans.is_valid and len(spans.values):
                    edge = np.zeros(len(words) + 1, np.int64)
                    first, count = (spans.values.field(k).to_numpy() for k in range(2))
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + count + WINDOW - 1, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words, n = list(compress(words, stay.tolist())), len(words)
                else:
                    n = len(words)
                total.append(n)
                gone.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.record_batch([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return own.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(freeing(cut), "doc_id long, n_words long, n_removed long, kept_text string")


def substring_digest(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of ``substring_dedup``."""
    return substring_dedup(docs, text_col, id_col).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
