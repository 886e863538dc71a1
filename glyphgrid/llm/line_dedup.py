"""Line dedup by a segment-partition edit join.

A line within k edits of another shares one of k + 1 segments with it, at a place that the two lengths and the segment's number bound. So
each line is indexed by its segments and probes, for every length that a partner may have, the few substrings that can match. Lines that meet are first held
against each other by their letters' counts, then by a banded bit-parallel edit distance. Equal lines (128 bits of XXH3) count once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import freeing, materialise, mix, offsets_of, powers, slices, text_array
from ._graph import connected_components

#: (shortest, longest, edits): what the shorter of two lines allows, by its characters. Below the first band only equal lines are near.
BANDS = ((4, 7, 1), (8, 1 << 40, 2))
SHORTEST, EDITS = BANDS[0][0], max(k for _, _, k in BANDS)
#: Rows of one key that a task holds: a key with more is cut into pieces of so many, and every two pieces meet in a task of their own. Pairs verified together; rows compared at once.
PIECE, BATCH, BLOCK = 4_096, 4_096, 1_024
#: Ids of lines with possible partners that are broadcast at most (8 bytes each); more of them are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_U = np.uint64


def edits_allowed(length: int) -> int:
    """Edits by which a line of ``length`` characters may differ from one that is as long or longer."""
    return next((k for low, high, k in BANDS if low <= length <= high), 0)


class _Lines:
    """Lines (runs between line feeds, empty ones left out) of a slice of texts, by characters."""

    def __init__(self, values: pa.Array):
        off = offsets_of(values)
        data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        self.codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = lead[off - off[0]]
        n = len(self.codes)
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        inside = self.codes != 10
        self.start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))[:n]))
        self.end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False]))[:n])) + 1
        self.text = np.searchsorted(at, self.start, side="right") - 1
        breaks = np.concatenate(([0], np.cumsum(~inside)))
        self.number = breaks[self.start] - breaks[at[self.text]]
        power, self._inverse = powers(n + 1)
        self._total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(self.codes.astype(np.uint64) + _U(1)) * power[:n], out=self._total[1:])
        self.size = self.end - self.start
        place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of each character's first byte
        raw, digest = data.tobytes(), xxhash.xxh3_128_digest
        both = b"".join([digest(raw[a:b]) for a, b in zip(place[self.start].tolist(), place[self.end].tolist(), strict=True)])
        #: Two 64-bit halves of each line's digest: candidates go by the first, equality by both.
        self.lid, self.lid2 = np.frombuffer(both, "<u8").reshape(-1, 2).T.copy()

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._total[end] - self._total[start]) * self._inverse[start])

    def letters(self, rows: np.ndarray) -> np.ndarray:
        """Counts of the line's characters in eight classes, four bits each, modulo 16."""
        size = self.size[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        at = np.repeat(self.start[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        kind = (mix(self.codes[at].astype(np.uint64)) >> _U(61)).astype(np.int64)
        count = np.bincount(owner * 8 + kind, minlength=len(rows) * 8).reshape(-1, 8).astype(np.uint64) & _U(15)
        return (count << (np.arange(8, dtype=np.uint64) * _U(4))).sum(axis=1, dtype=np.uint64)


def segment(length: np.ndarray | int, i: int, edits: int) -> tuple:
    """Start and size of segment i of a line cut into edits + 1 segments, the longer ones last."""
    base, rest = length // (edits + 1), length % (edits + 1)
    longer = np.maximum(0, i - (edits + 1 - rest))
    return i * base + longer, base + (i >= edits + 1 - rest)


def probe_places(delta: int, i: int, edits: int) -> range:
    """Shifts, from the segment's own start, at which a line ``delta`` characters longer is probed for segment i (from 0)."""
    low = max(-i, delta - (edits - i))
    high = min(i, delta + (edits - i))
    return range(low, high + 1)


def signatures(lines: _Lines, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, lid, pack) of the index and probe entries of lines. pack: letters | side | index? | delta | segment | shift."""
    size, lid, letters = lines.size[rows], lines.lid[rows], lines.letters(rows)
    keys, lids, packs = [], [], []
    for low, high, edits in BANDS:
        for delta in range(edits + 1):
            length = size - delta
            some = np.flatnonzero((length >= low) & (length <= high))
            for i in range(edits + 1):
                at, width = segment(length[some], i, edits)
                for shift in probe_places(delta, i, edits):
                    begin = lines.start[rows][some] + at + shift
                    keys.append(mix(lines.hash(begin, begin + width) ^ mix((length[some] * 8 + i).astype(np.uint64))))
                    lids.append(lid[some])
                    packs.append((letters[some] << _U(32)) | _U((int(delta == 0 and shift == 0) << 16) | (delta << 12) | (i << 8) | (shift + 64)))
    return np.concatenate(keys), np.concatenate(lids), np.concatenate(packs)


def _letters_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound, times two at most, of the edits between lines with these packs."""
    total = np.zeros(np.broadcast(a, b).shape, np.int64)
    for k in range(8):
        d = ((a >> _U(32 + 4 * k)) - (b >> _U(32 + 4 * k))) & _U(15)
        total += np.minimum(d, _U(16) - d).astype(np.int64)
    return total


def _may_link(own: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of rows of one key: whether one indexes, their letters are near and, where they have sides, these differ."""
    (lid, pack), (lid2, pack2) = own, other
    side, side2 = (pack >> _U(17)) & _U(3), (pack2 >> _U(17)) & _U(3)
    return (lid != lid2) & (((pack | pack2) >> _U(16)) & _U(1) > 0) & ((side != side2) | (side == 0)) & (_letters_apart(pack, pack2) <= 2 * EDITS)


def within_edits(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    """Whether each pair (longer or equal line first) is within ``edits`` edits: Hyyrö's banded bit-vectors, one word a pair, all pairs step by step together."""
    out = np.zeros(len(pairs), bool)
    order = sorted(range(len(pairs)), key=lambda k: len(pairs[k][0]))
    s = 0
    while s < len(order):
        most = max(1, (1 << 21) // max(1, len(pairs[order[min(len(order), s + 512) - 1]][0])))
        rows = order[s : s + min(512, most)]
        out[rows] = _banded([pairs[k] for k in rows], edits)
        s += len(rows)
    return out


def _banded(pairs: list[tuple[str, str]], k: int) -> np.ndarray:
    m, n = (np.array([len(p[j]) for p in pairs]) for j in (0, 1))
    if (m <= k).any() or (n <= k).any():
        return np.array([_plain_distance(a, b) <= k for a, b in pairs])
    width = int(m.max())
    rows = np.zeros((len(pairs), width + 2 * k), np.uint32)  # the longer lines, k cells of padding on either side
    columns = np.full((len(pairs), int(n.max())), 0xFFFFFFFF, np.uint32)
    for r, (a, b) in enumerate(pairs):
        rows[r, k : k + len(a)] = np.frombuffer(a.encode("utf-32-le"), np.uint32)
        columns[r, : len(b)] = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    rows[:, :k] = 0xFFFFFFFE
    # Bit 63 is the band's lowest row, j + k in column j.
    vp = np.full(len(pairs), ((1 << (k + 1)) - 1) << (63 - k), np.uint64)
    vn = np.zeros(len(pairs), np.uint64)
    score = np.full(len(pairs), k, np.int64)
    mask = np.full(len(pairs), 1 << 62, np.uint64)
    for j in range(columns.shape[1]):
        live = j < n
        eq = np.zeros(len(pairs), np.uint64)
        for d in range(2 * k + 1):
            column = rows[:, j + d] if j + d < rows.shape[1] else np.uint32(0xFFFFFFFD)
            eq |= ((column == columns[:, j]) & (j + d - k < m)).astype(np.uint64) << _U(63 - 2 * k + d)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        diagonal = live & (j < m - k)
        score += diagonal & ((d0 >> _U(63)) == 0)
        level = live & ~diagonal
        score += level & ((hp & mask) > 0)
        score -= level & ((hn & mask) > 0)
        mask = np.where(level, mask >> _U(1), mask)
        down = d0 >> _U(1)
        vp, vn = hn | ~(down | hp), down & hp
    return score <= k


def _plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _first_meeting(longer: str, shorter: str, edits: int) -> tuple[int, int]:
    """The first (segment, shift) at which the join lets two lines meet: where a link is counted."""
    delta = len(longer) - len(shorter)
    for i in range(edits + 1):
        at, width = segment(len(shorter), i, edits)
        for shift in probe_places(delta, i, edits):
            if longer[at + shift : at + shift + width] == shorter[at : at + width]:
                return i, shift
    return -1, 0


def _groups(batches: Iterator[pa.RecordBatch], limit: int | None = None) -> Iterator[tuple[bool, list]]:
    """Columns of whole keys from batches sorted by their first column: numbers as arrays, strings as lists. A key above ``limit``, if there is one, comes in pieces: True says that
    the last key goes on."""
    as_columns = lambda b: [c.to_pylist() if pa.types.is_string(c.type) else c.to_numpy().view(np.uint64) for c in b.columns]
    join = lambda x: sum(x, []) if isinstance(x[0], list) else np.concatenate(x)
    held: list[list] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        own = as_columns(batch)
        if held and own[0][-1] == held[0][0][-1] and own[0][0] == own[0][-1]:
            held.append(own)
            rows += batch.num_rows
            if limit is not None and rows > limit:
                columns = [join(x) for x in zip(*held, strict=True)]
                yield True, [c[:-1] for c in columns]
                held, rows = [[c[-1:] for c in columns]], 1
            continue
        key = own[0]
        cut = int(np.flatnonzero(key == key[-1])[0])
        ready = [join(x) for x in zip(*held, [c[:cut] for c in own], strict=True)]
        if len(ready[0]):
            yield False, ready
        held, rows = [[c[cut:] for c in own]], len(key) - cut
    if held:
        yield False, [join(x) for x in zip(*held, strict=True)]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(0, np.uint64)
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            lines = _Lines(text_array(part, "text"))
            _, rows = np.unique(lines.lid, return_index=True)
            rows = rows[(lines.size[rows] >= SHORTEST) & ~np.isin(lines.lid[rows], seen)]
            if len(seen) < 2_000_000:  # equal lines of one task are signed once, as far as memory allows
                seen = np.concatenate((seen, lines.lid[rows]))
            if len(rows):
                key, lid, pack = signatures(lines, rows)
                yield pa.record_batch([pa.array(x.view(np.int64)) for x in (key, lid, pack)], names=["key", "lid", "pack"])


def _partners(key: np.ndarray, lid: np.ndarray, pack: np.ndarray) -> np.ndarray:
    """Which rows, sorted by key, have a partner in their key that may be linked to them."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
    size = np.diff(np.append(first, len(key)))
    keep = np.zeros(len(key), bool)
    few = np.repeat(size <= 16, size)
    for d in range(1, 16):
        pair = np.flatnonzero((key[d:] == key[:-d]) & few[d:])
        pair = pair[_may_link((lid[pair], pack[pair]), (lid[pair + d], pack[pair + d]))]
        keep[pair] = keep[pair + d] = True
    for s, n in zip(first[size > 16], size[size > 16], strict=True):
        for a in range(s, s + n, BLOCK):
            block = slice(a, min(a + BLOCK, s + n))
            for b in range(s, s + n, BLOCK):
                other = slice(b, min(b + BLOCK, s + n))
                keep[block] |= _may_link((lid[block, None], pack[block, None]), (lid[None, other], pack[None, other])).any(axis=1)
    return keep


def _meet(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by key: those with a partner in their key (piece -1); of a key of more than ``limit`` rows all, numbered by pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, passed = None, 0  # the key that goes on, and its rows so far
        for goes_on, (key, lid, pack) in _groups(batches, limit):
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(first, len(key)))
            before = np.where(key[first] == open_key, passed, 0) if open_key is not None else np.zeros(len(first), np.int64)
            large = (size > limit) | (before > 0)
            large[-1] |= goes_on
            open_key, passed = (key[-1], int(before[-1] + size[-1])) if goes_on else (None, 0)
            wide = np.repeat(large, size)
            piece = (np.arange(len(key)) - np.repeat(first - before, size)) // limit
            rest = np.flatnonzero(~wide)
            keep = rest[_partners(key[rest], lid[rest], pack[rest])]
            rows = np.concatenate((keep, np.flatnonzero(wide)))
            piece = np.where(wide, piece, -1)[rows].astype(np.int32)
            yield pa.record_batch([*[pa.array(x[rows].view(np.int64)) for x in (key, lid, pack)], pa.array(piece)], names=["key", "lid", "pack", "piece"])

    return run


def _meet_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, two pieces at most: those with a partner."""
    for _, (key, lid, pack) in _groups(batches):
        keep = _partners(key, lid, pack)
        yield pa.record_batch([pa.array(x[keep].view(np.int64)) for x in (key, lid, pack)], names=["key", "lid", "pack"])


def possible_partners(signed: DataFrame, limit: int = PIECE) -> DataFrame:
    """(key, lid, pack) of the entries that have a partner under their key. The entries of a large key are dealt out by two pieces at a time, under keys of their own."""
    met = signed.repartition("key").sortWithinPartitions("key").mapInArrow(freeing(_meet(limit)), "key long, lid long, pack long, piece int")
    met = materialise(met.groupBy("key", "lid", "pack").agg(F.min("piece").alias("piece")), "met")
    large = met.where("piece >= 0")
    last = large.groupBy("key").agg(F.max("piece").alias("last"))
    dealt = large.join(last, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    side = F.when(F.col("piece") == F.col("other"), 0).when(F.col("piece") < F.col("other"), 1 << 17).otherwise(2 << 17).cast("long")
    dealt = dealt.select(F.xxhash64("key", F.least("piece", "other"), F.greatest("piece", "other")).alias("key"), "lid", F.col("pack").bitwiseOR(side).alias("pack"))
    dealt = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(freeing(_meet_pieces), "key long, lid long, pack long")
    return met.where("piece < 0").select("key", "lid", "pack").unionByName(dealt)


def _texts_of(wanted: Callable[[], np.ndarray | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """lid, lid2, text of the distinct lines of each slice, of the wanted ids if these are given (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = wanted()
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                lines = _Lines(text_array(part, "text"))
                _, rows = np.unique(lines.lid, return_index=True)
                rows = rows[lines.size[rows] >= SHORTEST]
                if ids is not None:
                    at = np.minimum(np.searchsorted(ids, lines.lid[rows]), max(0, len(ids) - 1))
                    rows = rows[ids[at] == lines.lid[rows]] if len(ids) else rows[:0]
                texts = [lines.codes[a:b].tobytes().decode("utf-32-le") for a, b in zip(lines.start[rows].tolist(), lines.end[rows].tolist(), strict=True)]
                yield pa.record_batch([pa.array(lines.lid[rows].view(np.int64)), pa.array(lines.lid2[rows].view(np.int64)), pa.array(texts, pa.string())], names=["lid", "lid2", "text"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key with their texts: links of each line (b null), and edges that connect what is linked (links 0)."""
    links: dict[int, int] = {}
    parent: dict[int, int] = {}
    waiting: list[tuple] = []

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = up = parent[up]
            x = up
        return x

    def settle() -> None:
        good = np.zeros(len(waiting), bool)
        allowed = np.array([edits_allowed(len(w[3])) for w in waiting])
        for edits in set(allowed.tolist()):
            rows = np.flatnonzero(allowed == edits)
            good[rows] = within_edits([waiting[k][2:4] for k in rows], edits)
        for k in np.flatnonzero(good):
            a, b, longer, shorter, i, shift = waiting[k]
            if _first_meeting(longer, shorter, int(allowed[k])) == (i, shift):
                links[a] = links.get(a, 0) + 1
                links[b] = links.get(b, 0) + 1
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        waiting.clear()

    for _, (key, lid, pack, text) in _groups(batches):
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        for s, e in zip(first, np.append(first[1:], len(key)), strict=True):
            index = s + np.flatnonzero((pack[s:e] >> _U(16)) & _U(1))
            for a in range(s, e, BLOCK):
                block = np.arange(a, min(a + BLOCK, e))
                for b in range(0, len(index), BLOCK):
                    other = index[b : b + BLOCK]
                    delta = (pack[block] >> _U(12)) & _U(15)
                    ok = _may_link((lid[block, None], pack[block, None]), (lid[None, other], pack[None, other]))
                    ok &= (delta[:, None] > 0) | (lid[block, None] > lid[None, other])
                    for p, q in zip(*np.nonzero(ok), strict=True):
                        r, t = int(block[p]), int(other[q])
                        info = int(pack[r])
                        waiting.append((int(lid[r]), int(lid[t]), text[r], text[t], (info >> 8) & 15, (info & 255) - 64))
                        if len(waiting) >= BATCH:
                            settle()
    settle()
    edges = [(x, root(x)) for x in parent]
    a = np.array([x for x, y in edges if x != y] + list(links), np.uint64).view(np.int64)
    b = np.array([y for x, y in edges if x != y], np.uint64).view(np.int64)
    n = np.concatenate((np.zeros(len(b), np.int64), np.array(list(links.values()), np.int64)))
    yield pa.record_batch([pa.array(a), pa.array(np.concatenate((b, np.zeros(len(links), np.int64)))), pa.array(n)], names=["a", "b", "links"])


def _list_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            lines = _Lines(text_array(part, "text"))
            owner = pa.array(lines.text)
            yield pa.record_batch([part.column(0).take(owner), part.column(2).take(owner), *[pa.array(x) for x in (lines.number.astype(np.int32), lines.lid.view(np.int64), lines.lid2.view(np.int64))]], names=["doc_id", "row", "line_no", "lid", "lid2"])


def _classes(own: DataFrame, limit: int) -> DataFrame:
    """The rows of ``line_classes`` with the column row of ``own`` (doc_id, text, row)."""
    signed = own.select("text").mapInArrow(freeing(_sign), "key long, lid long, pack long")
    met = materialise(possible_partners(signed, limit), "partners")
    lids = met.select("lid").distinct()
    if lids.count() <= BROADCAST_IDS:
        shared = own.sparkSession.sparkContext.broadcast(np.sort(lids.toPandas()["lid"].to_numpy(np.int64).view(np.uint64)))
        texts = own.select("text").mapInArrow(freeing(_texts_of(lambda: shared.value)), "lid long, lid2 long, text string")
    else:
        texts = own.select("text").mapInArrow(freeing(_texts_of(lambda: None)), "lid long, lid2 long, text string").join(lids, "lid", "left_semi")
    texts = texts.groupBy("lid").agg(F.min_by("text", "lid2").alias("text"))
    rows = met.join(texts, "lid").select("key", "lid", "pack", "text").repartition("key").sortWithinPartitions("key")
    found = materialise(rows.mapInArrow(freeing(_verify), "a long, b long, links long"), "found")
    roots = connected_components(found.where("links = 0").select("a", "b"))
    lines = materialise(own.mapInArrow(freeing(_list_lines), "doc_id long, row long, line_no int, lid long, lid2 long").withColumn("rid", F.monotonically_increasing_id()), "lines")
    place = F.struct("doc_id", "line_no", "rid")
    distinct = lines.groupBy("lid", "lid2").agg(F.min(place).alias("first"), F.count("*").alias("copies"))
    # Links are of the line with the smaller second half, should two different lines share the first.
    least = distinct.groupBy("lid").agg(F.min("lid2").alias("least"))
    links = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("n_links"))
    near = roots.join(links, roots.node == links.a, "left").join(least, F.col("node") == F.col("lid")).select(F.col("node").alias("near"), F.col("least").alias("near2"), "root", "n_links")
    distinct = distinct.join(near, (distinct.lid == near.near) & (distinct.lid2 == near.near2), "left")
    distinct = distinct.withColumn("class_key", F.when(F.col("root").isNotNull(), F.struct(F.col("root").alias("x"), F.lit(0).cast("long").alias("y"))).otherwise(F.struct(F.col("lid").alias("x"), F.col("lid2").alias("y"))))
    classes = distinct.groupBy("class_key").agg(F.min("first").alias("class"))
    distinct = distinct.join(classes, "class_key").select(F.col("lid").alias("line_lid"), F.col("lid2").alias("line_lid2"), "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "class")
    out = lines.join(distinct, (lines.lid == distinct.line_lid) & (lines.lid2 == distinct.line_lid2))
    line_id = F.lower(F.concat(F.lpad(F.hex("lid"), 16, "0"), F.lpad(F.hex("lid2"), 16, "0")))
    return out.select("row", "doc_id", "line_no", line_id.alias("line_id"), "copies", "n_links", F.col("class.doc_id").alias("class_doc_id"), F.col("class.line_no").alias("class_line_no"), (F.col("rid") == F.col("class.rid")).alias("kept"))


def line_classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", limit: int = PIECE) -> DataFrame:
    """One row per line that isn't empty: doc_id, line_no (from 0, empty ones counted), line_id (32 hex digits of the line's hash), copies (equal lines, itself
    included), n_links (other lines, equal ones once, that are near), class_doc_id and class_line_no (the class's first line), kept (that line itself).

    Lines are near within the edits that the shorter one allows (``edits_allowed``: two from eight characters on, one from four on, none below). Classes are connected
    by links. Null and empty texts have no lines; repeated rows of one id have lines of the same number, of which one is kept; null ids sort first. An
    empty table gives no rows."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.lit(0).cast("long").alias("row"))
    return _classes(own, limit).drop("row")


def line_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", limit: int = PIECE) -> DataFrame:
    """doc_id, text: of each row of ``docs`` its lines that are the first of their class, joined by line feeds; rows without such lines have the empty text.

    Repeated rows and rows without id are rows of their own."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    own = materialise(own.withColumn("row", F.monotonically_increasing_id()), "rows")
    kept = _classes(own, limit).where("kept").groupBy("row").agg(F.collect_set("line_no").alias("stay"))  # of one document
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    stay = F.transform(F.sort_array(F.coalesce("stay", F.array().cast("array<int>"))), lambda k: F.element_at(lines, k + 1))
    return own.join(kept, "row", "left").select("doc_id", F.array_join(stay, "\n").alias("text"))
