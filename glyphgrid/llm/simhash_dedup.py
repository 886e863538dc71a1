"""SimHash near-dedup by deletion-variant signatures.

Two 64-bit fingerprints within three bits, cut into two halves, differ by at most one bit in one of them. So each fingerprint is indexed by every
half with one bit wildcarded; those that share a signature meet in an equality shuffle and are verified. Equal fingerprints count once.

For similarity of shingle sets rather than a number of bits, fingerprints are longer and cut into SEGMENTS segments: sets are candidates where one
segment differs by at most one bit, and are verified by their exact Jaccard similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, discard, fresh, freeing, materialise, mix, signed, slices, text_array, windows
from ._graph import connected_components

#: A signature shared by more fingerprints than this is indexed again on the other half, which bounds what meets by construction.
GROUP_LIMIT = 4096
#: Segments of a shingle set's fingerprint and their bits: at a Jaccard similarity of 0.8 a bit differs with probability 0.15, so that 98 of 100 such pairs have a
#: segment with at most one differing bit (0.85: 99.6). Bits of 63, and of all, in which candidates may differ: three to four deviations above what 0.8 makes.
SEGMENTS, SEGMENT_BITS, REACH, FAR = 12, 16, 18, 48
WORDS_OF_BITS = SEGMENTS * SEGMENT_BITS // 64
#: Sets of one key that are paired at once; rows that the second look at a larger key compares at a time; sets of a key that one task verifies, twice as many at most.
HOT, BLOCK, PIECE = 256, 1_024, 2_048
#: Ids of sets with possible partners that are broadcast at most (8 bytes each); more of them are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Members of the sets of hot keys that are broadcast at most (8 bytes each); more of them are joined by a shuffle.
BROADCAST_VALUES = 4_000_000
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: The bits of a byte as eight bytes.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
_ONE, _SEGMENT = np.uint64(1), np.uint64((1 << SEGMENT_BITS) - 1)


def fingerprint_of(shingle_hashes: np.ndarray) -> int:
    """Bit i is set if set in over half of the hashes; no hashes: zero."""
    if not len(shingle_hashes):
        return 0
    bits = np.unpackbits(shingle_hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(shingle_hashes)).view("<u8")[0])


def shingle_hashes(text: bytes, size: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``size`` words of the text lower-cased in A-Z, joined by a space; fewer words: of the whole sequence."""
    words = text.lower().split()  # bytes: splits on 0x20 and 0x09-0x0D, lowers A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[size - 1 :], strict=False)), np.uint64, len(words) - size + 1)


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): SimHash of each text; null and word-less texts have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint_of(shingle_hashes((t.as_py() or "").encode(), shingle)) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(freeing(run), "doc_id long, fp long")


def _home(x: np.ndarray) -> np.ndarray:
    """Of XORs within reach: the one signature number (half * 32 + wildcard) at which such a pair is verified."""
    low, high = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    place = lambda h: np.bitwise_count((h & (~h + _ONE)) - _ONE).astype(np.int64) * (h != 0)  # noqa: E731  index of the lowest set bit, 0 if none
    return np.where(np.bitwise_count(low) <= 1, place(low), 32 + place(high))


def _forest(members: np.ndarray, number: int, bits: int) -> Iterator[tuple[int, int]]:
    """Edges that connect the members of one signature as its pairs do: breadth first, each found member leaves the rest."""
    rest = members
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            a = queue.pop()
            x = rest ^ a
            near = (np.bitwise_count(x) <= bits) & (_home(x) == number)
            for b in rest[near]:
                queue.append(b)
                yield int(a), int(b)
            rest = rest[~near]


def _edges(keys: np.ndarray, fps: np.ndarray, number: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key: the edges within equal keys. number: of each row, its signature number."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(first, len(keys)))
    a, b = [], []
    few = np.repeat(size <= 8, size)
    for d in range(1, 8):
        pair = np.flatnonzero((keys[d:] == keys[:-d]) & few[d:])
        x = fps[pair] ^ fps[pair + d]
        good = pair[(np.bitwise_count(x) <= bits) & (_home(x) == number[pair])]
        a.append(fps[good])
        b.append(fps[good + d])
    for s, n in zip(first[size > 8], size[size > 8], strict=True):
        found = list(_forest(fps[s : s + n], int(number[s]), bits))
        a.append(np.array([x for x, _ in found], np.uint64))
        b.append(np.array([y for _, y in found], np.uint64))
    return np.concatenate(a), np.concatenate(b)


def _groups(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(goes on, keys, fps) of whole keys from batches sorted by key; a key above ``limit``, if there is one, comes in pieces: then the last key goes on."""
    keys, fps = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for batch in batches:
        keys = np.concatenate((keys, batch.column(0).to_numpy().view(np.uint64)))
        fps = np.concatenate((fps, batch.column(1).to_numpy().view(np.uint64)))
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        goes_on = limit is not None and cut == 0 and len(keys) > limit
        if goes_on:
            cut = len(keys) - 1
        if cut:
            yield goes_on, keys[:cut], fps[:cut]
            keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield False, keys, fps


def near_edges(distinct: DataFrame, bits: int = 3, limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b) edges that connect the distinct fingerprints (column fp) exactly as the links within ``bits`` (3 at most) do."""
    assert 0 <= bits <= 3

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(64, dtype=np.uint64)
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(s, 4096).to_numpy().view(np.uint64)
                half = np.where(numbers < 32, (fp & np.uint64(0xFFFFFFFF))[:, None], (fp >> np.uint64(32))[:, None])
                key = (numbers << np.uint64(32)) | (half & ~(_ONE << (numbers % np.uint64(32))))
                yield pa.record_batch([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(fp, 64).view(np.int64))], names=["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key = None  # a key whose members go on to the second index
        for goes_on, keys, fps in _groups(batches, limit):
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            size = np.diff(np.append(first, len(keys)))
            big = (size > limit) | (keys[first] == open_key if open_key is not None else False)
            big[-1] |= goes_on
            open_key = keys[-1] if big[-1] else None
            wide = np.repeat(big, size)
            a, b = _edges(keys[~wide], fps[~wide], (keys[~wide] >> np.uint64(32)).astype(np.int64), bits) if not wide.all() else (fps[:0], fps[:0])
            key = np.concatenate((np.zeros(len(a), np.uint64), keys[wide] | np.uint64(1 << 62)))  # no edge has a key
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.concatenate((a, fps[wide])).view(np.int64)), pa.array(np.concatenate((b, fps[wide])).view(np.int64))], names=["key", "a", "b"])

    def sign_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(32, dtype=np.uint64)
        for batch in batches:
            key, fp = (batch.column(i).to_numpy().view(np.uint64) & np.uint64(m) for i, m in ((0, (1 << 62) - 1), (1, 2**64 - 1)))
            other = np.where((key >> np.uint64(37)) == 0, fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))
            part = np.where(numbers < 16, (other & np.uint64(0xFFFF))[:, None], (other >> np.uint64(16))[:, None])
            more = (numbers << np.uint64(16)) | (part & ~(_ONE << (numbers % np.uint64(16))))
            yield pa.record_batch([pa.array(((key[:, None] << np.uint64(21)) | more).ravel().view(np.int64)), pa.array(np.repeat(fp, 32).view(np.int64))], names=["key", "fp"])

    def meet_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Distinct fingerprints alike in 31 + 15 bits: 2^18 at most, whatever the table's size, so a key is held whole.
        for _, keys, fps in _groups(batches, None):
            a, b = _edges(keys, fps, (keys >> np.uint64(53)).astype(np.int64), bits)
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    entries = distinct.select("fp").mapInArrow(freeing(sign), "key long, fp long")
    met = materialise(entries.repartition("key").sortWithinPartitions("key").mapInArrow(freeing(meet), "key long, a long, b long"), "met")
    again = met.where("key <> 0").select("key", "a").mapInArrow(freeing(sign_again), "key long, fp long")
    again = again.repartition("key").sortWithinPartitions("key").mapInArrow(freeing(meet_again), "a long, b long")
    return met.where("key = 0").select("a", "b").unionByName(again)


def simhash_classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3, bits: int = 3, limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable over links of ``bits`` or fewer).

    Null and word-less texts have fingerprint zero and link like any other. Rows that repeat an id are rows of their own; null ids are
    the smallest only among themselves. An empty table gives no rows."""
    own = materialise(fingerprints(docs, text_col, id_col, shingle), "fingerprints")
    distinct = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(near_edges(distinct, bits, limit))
    joined = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    component = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return own.join(component, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class ShingleSets:
    """Distinct shingles of each text of a slice: runs of ``size`` words lower-cased in A-Z, by 64-bit hashes; fewer words: the whole sequence.

    member: of all texts, one after the other, sorted within a text; first: where each text's start (one more at the end); count: of each text;
    node: a hash of each text's set."""

    def __init__(self, values: pa.Array, size: int):
        w = Words(values)
        w.data = _LOWER[w.data]
        word, n = w.hashes(), len(values)
        words = np.diff(w.first)
        owner = np.repeat(np.arange(n), words)
        run = windows(word, size)
        real = np.arange(len(run)) + size <= w.first[1:][owner[: len(run)]]
        own, doc = run[real], owner[: len(run)][real]
        few = np.flatnonzero((words > 0) & (words < size))
        short = np.array([mix(windows(word[w.first[d] : w.first[d + 1]], int(words[d])) + np.uint64(words[d]))[0] for d in few], np.uint64)
        own, doc = np.concatenate((own, short)), np.concatenate((doc, few))
        order = np.lexsort((own, doc))
        own, doc = own[order], doc[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
        self.member, self.doc = own[new], doc[new]
        self.count = np.bincount(self.doc, minlength=n)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.member), dtype=np.uint64)))
        self.node = mix(total[self.first[1:]] - total[self.first[:-1]] + self.count.astype(np.uint64))

    def fingerprints(self) -> np.ndarray:
        """SimHash of each set, one row a text, WORDS_OF_BITS unsigned words a row; the empty set: zeros.

        Bits are counted in bytes, eight to a word, over at most 255 shingles at a time."""
        out = np.zeros((len(self.count), WORDS_OF_BITS), "<u8")
        pieces = -(-self.count // 255)
        first = np.repeat(self.first[:-1] - 255 * (np.cumsum(pieces) - pieces), pieces) + 255 * np.arange(pieces.sum())
        some = np.flatnonzero(self.count)
        if not len(some):
            return out
        for k in range(WORDS_OF_BITS):
            hashed = mix(self.member ^ mix(np.full(1, k + 1, np.uint64))).astype("<u8").view(np.uint8).reshape(-1, 8)
            counted = np.add.reduceat(_SPREAD[hashed], first, axis=0)
            counted = np.add.reduceat(counted.view(np.uint8).astype(np.int64).reshape(len(first), 64), (np.cumsum(pieces) - pieces)[some], axis=0)
            out[some, k] = np.packbits(2 * counted > self.count[some, None], axis=1, bitorder="little").view("<u8").ravel()
        return out


def _index(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                s = ShingleSets(text_array(part, "text"), size)
                bits = pa.FixedSizeListArray.from_arrays(signed(s.fingerprints().ravel()), WORDS_OF_BITS).cast(pa.list_(pa.int64()))
                yield pa.record_batch([part.column(0), signed(s.node), bits], names=["doc_id", "node", "bits"])

    return run


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, node, sketch: every segment with each of its bits wildcarded. sketch: the word of the fingerprint before the segment's, its lowest bit replaced by the wildcarded one."""
    place = np.arange(SEGMENTS * SEGMENT_BITS)
    segment, bit = place // SEGMENT_BITS, (place % SEGMENT_BITS).astype(np.uint64)
    each = 64 // SEGMENT_BITS
    for batch in batches:
        for s in range(0, batch.num_rows, 2048):
            part = batch.slice(s, 2048)
            bits = part.column(1).flatten().to_numpy().view(np.uint64).reshape(part.num_rows, -1)
            own = (bits[:, segment // each] >> ((segment % each) * SEGMENT_BITS).astype(np.uint64)) & np.uint64((1 << SEGMENT_BITS) - 1)
            key = (place.astype(np.uint64) << np.uint64(SEGMENT_BITS)) | (own & ~(_ONE << bit))
            sketch = (bits[:, (segment // each - 1) % WORDS_OF_BITS] & ~_ONE) | ((own >> bit) & _ONE)
            yield pa.record_batch([pa.array(key.ravel().astype(np.int32)), pa.array(np.repeat(part.column(0).to_numpy(), len(place))), signed(sketch.ravel())], names=["key", "node", "sketch"])


def _may_be_near(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of sketches under one key: whether their wildcarded bits differ, or are alike at a segment's first wildcard, the sketches are within REACH, and no segment of the word before,
    which the sketch is, agrees too: then the pair meets there."""
    x = a ^ b
    once = ((x & _ONE) == 1) | ((key >> SEGMENT_BITS) % SEGMENT_BITS == 0)
    known = x & ~_ONE
    before = np.bitwise_count(known & _SEGMENT) == 0  # its lowest bit isn't known
    for k in range(1, 64 // SEGMENT_BITS):
        before |= np.bitwise_count((known >> np.uint64(k * SEGMENT_BITS)) & _SEGMENT) <= 1
    return once & (np.bitwise_count(known) <= REACH) & ~(before & ((key >> SEGMENT_BITS) >= 64))


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole keys from batches sorted by the first column."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [c.to_numpy() for c in batch.columns]
        cut = int(np.searchsorted(own[0], own[0][-1]))
        if cut or (held and held[0][0][0] != own[0][0]):
            ready = [np.concatenate(x) for x in zip(*held, [c[:cut] for c in own], strict=True)]
            if len(ready[0]):
                yield ready
            held = []
        held.append([c[cut:] for c in own])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _candidates(hot_size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From variants sorted by key: a, b of pairs that may be near (key -1). Of a hot key, one of more than ``hot_size`` sets or of more than three pairs to two sets: each
    set's pair with the smallest one at every fourth wildcard, and one row of the key with all its nodes and sketches, for the second look."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, sketch in _whole_keys(batches):
            bits = sketch.view(np.uint64)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(first, len(key)))
            large = np.repeat(size > hot_size, size)
            a, b, at, d = [first[:0]], [first[:0]], np.flatnonzero(~large), 0
            while len(at):
                d += 1
                at = at[at + d < len(key)]
                at = at[key[at + d] == key[at]]
                good = at[_may_be_near(key[at], bits[at], bits[at + d])]
                a.append(good)
                b.append(good + d)
            a, b = np.concatenate(a), np.concatenate(b)
            group = np.repeat(np.arange(len(first)), size)
            dense = (2 * np.bincount(group[a], minlength=len(first)) > 3 * size) | (size > hot_size)
            keep, hot = ~dense[group[a]], dense[group]
            a, b = [node[a[keep]]], [node[b[keep]]]
            star = dense & ((key[first] >> SEGMENT_BITS) % 4 == 0)  # every fourth wildcard: the second look finds what these leave apart
            for s, n in zip(first[star], size[star], strict=True):
                least = s + int(np.argmin(node[s : s + n]))
                near = s + np.flatnonzero((np.bitwise_count((bits[s : s + n] ^ bits[least]) >> _ONE) <= REACH) & (node[s : s + n] != node[least]))
                a.append(np.full(len(near), node[least]))
                b.append(node[near])
            a, b = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
            n = np.concatenate((np.zeros(len(pairs), np.int64), size[dense]))
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(x[hot])) for x in (node, sketch)]
            ends = [pa.array(np.concatenate((pairs[:, k], np.zeros(dense.sum(), np.int64)))) for k in (0, 1)]
            yield pa.record_batch([*ends, pa.array(np.concatenate((np.full(len(pairs), -1, np.int32), key[first[dense]]))), *lists], names=["a", "b", "key", "nodes", "sketches"])

    return run


def _hot_rows(batches: Iterator[pa.RecordBatch], roots_of: Callable[[], tuple[np.ndarray, np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """key, part, node, sketch of one hot key at a time, sorted by part, the component's root, or the node where it has none."""
    known, root = roots_of()
    for batch in batches:
        for key, nodes, sketches in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            node, sketch = nodes.values.to_numpy(), sketches.values.to_numpy()
            at = np.minimum(np.searchsorted(known, node), max(0, len(known) - 1))
            part = np.where(known[at] == node, root[at], node) if len(known) else node
            order = np.argsort(part, kind="stable")
            yield [np.full(len(node), key, np.int32), part[order], node[order], sketch[order]]


def _second_look(piece: int, roots_of: Callable[[], tuple[np.ndarray, np.ndarray]] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From hot keys (key, nodes, sketches) and the components by look-up, or else from their rows with part sorted by key and part: deal, side, key, part, node of the sets that
    may be near one of another component.

    Those of a key are dealt out in pieces of ``piece``, two pieces to a deal, with sides 1 and 2, and each piece with itself, side 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, node, sketch in _hot_rows(batches, roots_of) if roots_of else _whole_keys(batches):
            bits = sketch.view(np.uint64)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            rows = []
            for s, e in zip(first, np.append(first[1:], len(key)), strict=True):
                keep = np.zeros(e - s, bool)
                for x in range(s, e, BLOCK):
                    for y in range(x, e, BLOCK):
                        left, right = slice(x, min(x + BLOCK, e)), slice(y, min(y + BLOCK, e))
                        if part[x] != part[right.stop - 1]:  # sorted, so else all between are of one component
                            ok = _may_be_near(key[x], bits[left, None], bits[None, right]) & (part[left, None] != part[None, right])
                            keep[x - s : left.stop - s] |= ok.any(axis=1)
                            keep[y - s : right.stop - s] |= ok.any(axis=0)
                at = s + np.flatnonzero(keep)
                pieces = [at[k : k + piece] for k in range(0, len(at), piece)]
                for low in range(len(pieces)):
                    for high in range(low, len(pieces)):
                        own = pieces[low] if low == high else np.concatenate((pieces[low], pieces[high]))
                        side = np.zeros(len(own), np.int8) if low == high else np.repeat(np.array([1, 2], np.int8), [len(pieces[low]), len(pieces[high])])
                        rows.append((np.full(len(own), (int(key[s]) << 32) | (low << 16) | high), side, own))
            if rows:
                deal, side, own = (np.concatenate(x) for x in zip(*rows, strict=True))
                yield pa.record_batch([pa.array(deal), pa.array(side), pa.array(key[own]), pa.array(part[own]), pa.array(node[own])], names=["deal", "side", "key", "part", "node"])

    return run


def _home_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of every pair of two tables of fingerprints: the key number (segment and wildcard) at which the pair is verified, -1 if none or if too far apart."""
    out = np.full((len(x), len(y)), -1, np.int32)
    far = np.zeros(out.shape, np.int32)
    each, mask = 64 // SEGMENT_BITS, np.uint64((1 << SEGMENT_BITS) - 1)
    for k in range(WORDS_OF_BITS):
        apart = x[:, None, k] ^ y[None, :, k]
        far += np.bitwise_count(apart)
        for j in range(each):
            part = (apart >> np.uint64(j * SEGMENT_BITS)) & mask
            bit = np.bitwise_count((part & (~part + _ONE)) - _ONE).astype(np.int32) % 64  # of the lowest differing bit; none: 0
            out = np.where((out < 0) & (np.bitwise_count(part) <= 1), (k * each + j) * SEGMENT_BITS + np.where(part == 0, 0, bit), out)
    return np.where(far <= FAR, out, -1)


class _SetTable:
    """Fingerprints and members of nodes, by look-up."""

    def __init__(self, table: pa.Table):
        order = np.argsort(table.column("node").to_numpy(), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        self.node = table.column("node").to_numpy()
        self.bits = table.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(self.node), WORDS_OF_BITS)
        members = table.column("members").combine_chunks()
        self.count, self.member = members.value_lengths().to_numpy().astype(np.int64), members.flatten().to_numpy()
        self.first = np.cumsum(self.count) - self.count

    def of(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints, members one after the other, and their counts."""
        at = np.searchsorted(self.node, node)
        count = self.count[at]
        ends = np.cumsum(count)
        return self.bits[at], self.member[np.repeat(self.first[at] - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)], count


def _verify_within(similarity: float, table_of: Callable[[], _SetTable | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (deal, side, key, part, node and, where there is no table of sets, bits, members) sorted by deal: a, b of near pairs that join the components as all near pairs do. Sides that are alike
    and above 0 don't meet."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            deal = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(deal[1:] != deal[:-1]) + 1).tolist(), len(deal)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e > s:
                    if held and held[0].column(0)[0].as_py() != deal[s]:
                        yield pa.Table.from_batches(held)
                        held = []
                    held.append(batch.slice(s, e - s))
        if held:
            yield pa.Table.from_batches(held)

    def near(table: pa.Table) -> Iterator[tuple[int, int]]:
        table = table.combine_chunks()
        side, key, part, node = (table.column(c).to_numpy() for c in ("side", "key", "part", "node"))
        bits, member, count = (table_of() or _SetTable(table.select(["node", "bits", "members"]))).of(node)
        _, code = np.unique(member, return_inverse=True)
        end = np.cumsum(count)
        mark = np.zeros(int(code.max(initial=0)) + 1, np.int32)
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := joined.setdefault(x, x)) != x:
                joined[x] = up = joined[up]
                x = up
            return x

        number = int(key[0]) >> SEGMENT_BITS
        for x in range(0, len(node), 256):
            for y in range(x, len(node), 256):
                left, right = np.arange(x, min(x + 256, len(node))), np.arange(y, min(y + 256, len(node)))
                ok = (_home_key(bits[left], bits[right]) == number) & (part[left, None] != part[None, right]) & ((side[left, None] != side[None, right]) | (side[left, None] == 0))
                if x == y:
                    ok &= left[:, None] < right[None, :]
                for i in np.flatnonzero(ok.any(axis=1)):
                    p = int(left[i])
                    others = [q for q in right[ok[i]].tolist() if root(int(part[q])) != root(int(part[p]))]
                    if not others:
                        continue
                    mark[code[end[p] - count[p] : end[p]]] = 1
                    for q in others:
                        both = int(mark[code[end[q] - count[q] : end[q]]].sum())
                        if both >= similarity * (count[p] + count[q] - both) - 1e-9:
                            joined[root(int(part[q]))] = root(int(part[p]))
                            yield int(node[p]), int(node[q])
                    mark[code[end[p] - count[p] : end[p]]] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            found = np.array(list(near(table)), np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return run


def _members(size: int, wanted: Callable[[], np.ndarray | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """node, members (sorted) of the texts' sets, of the wanted nodes if these are given (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = wanted()
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                s = ShingleSets(text_array(part, "text"), size)
                node = s.node.view(np.int64)
                keep = np.isin(node, ids) if ids is not None else np.ones(len(node), bool)
                rest = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(s.count[keep]))).astype(np.int32)), signed(s.member[keep[s.doc]]))
                yield pa.record_batch([pa.array(node[keep]), rest], names=["node", "members"])

    return run


def _verify(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[k] = both >= similarity * (len(x) + len(y) - both) - 1e-9
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    return run


def _verify_by_table(similarity: float, table_of: Callable[[], _SetTable]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of pairs (a, b): those whose sets, looked up in the table, are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of()
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            x, y = (np.searchsorted(table.node, batch.column(k).to_numpy()) for k in (0, 1))
            small, large = np.minimum(table.count[x], table.count[y]), np.maximum(table.count[x], table.count[y])
            for k in np.flatnonzero(small >= similarity * large - 1e-9):
                p, q = (table.member[table.first[i] : table.first[i] + table.count[i]] for i in (x[k], y[k]))
                both = len(np.intersect1d(p, q, assume_unique=True))
                good[k] = both >= similarity * (len(p) + len(q) - both) - 1e-9
            yield batch.filter(pa.array(good))

    return run


def _sets_of(own: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, members of the wanted nodes (column node, distinct), from the texts ``own``."""
    if nodes.count() <= BROADCAST_IDS:
        shared = own.sparkSession.sparkContext.broadcast(np.sort(nodes.toPandas()["node"].to_numpy(np.int64)))
        sets = own.select("text").mapInArrow(freeing(_members(size, lambda: shared.value)), "node long, members array<long>")
    else:
        sets = own.select("text").mapInArrow(freeing(_members(size, lambda: None)), "node long, members array<long>").join(nodes, "node", "left_semi")
    return materialise(sets.dropDuplicates(["node"]), "members")


def _near_pairs(own: DataFrame, distinct: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Of candidate pairs (a, b) of sets: those whose Jaccard similarity is ``similarity`` or more. own: the texts; distinct: their sets' nodes and fingerprints."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(np.bitwise_count(x ^ y).sum(axis=1) <= FAR))

    x, y = (distinct.select(F.col("node").alias(n), F.col("bits").alias(f"of_{n}")) for n in ("a", "b"))
    pairs = materialise(pairs.join(x, "a").join(y, "b").select("a", "b", "of_a", "of_b").mapInArrow(freeing(close), "a long, b long"), "close")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets_of(own, nodes, size).join(distinct.select("node", "bits"), "node")
    if (table := _broadcast_table(sets)) is not None:
        verified = pairs.select("a", "b").mapInArrow(freeing(_verify_by_table(similarity, lambda: table.value)), "a long, b long")
    else:
        x, y = (sets.select(F.col("node").alias(n), F.col("members").alias(f"of_{n}")) for n in ("a", "b"))
        verified = pairs.join(x, "a").join(y, "b").select("a", "b", "of_a", "of_b").mapInArrow(freeing(_verify(similarity)), "a long, b long")
    found = materialise(verified, "near")
    discard(pairs)
    return found


def _broadcast_table(sets: DataFrame) -> Broadcast | None:
    """The sets (node, bits, members) as a broadcast table, if they have no more than BROADCAST_VALUES values."""
    values = sets.agg(F.coalesce(F.sum(F.size("members") + WORDS_OF_BITS + 1), F.lit(0)).alias("n")).first()["n"]
    if values > BROADCAST_VALUES:
        return None
    return sets.sparkSession.sparkContext.broadcast(_SetTable(sets.select("node", "bits", "members").toArrow()))


def _across_components(own: DataFrame, distinct: DataFrame, hot: DataFrame, found: DataFrame, size: int, similarity: float, piece: int) -> DataFrame:
    """The near pairs of hot keys (key, nodes, sketches) that join what the pairs found so far have left apart. Sets of a key are dealt out by two pieces at a time, and verified where they meet."""
    part = connected_components(found)
    if part.count() <= BROADCAST_IDS:
        table = part.orderBy("node").toArrow()
        shared = own.sparkSession.sparkContext.broadcast((table.column("node").to_numpy(), table.column("root").to_numpy()))
        rows, look = hot.repartition("key"), _second_look(piece, lambda: shared.value)
    else:
        flat = hot.select("key", F.explode(F.arrays_zip("nodes", "sketches")).alias("x")).select("key", F.col("x.nodes").alias("node"), F.col("x.sketches").alias("sketch"))
        flat = flat.join(part, "node", "left").select("key", F.coalesce("root", "node").alias("part"), "node", "sketch")
        rows, look = flat.repartition("key").sortWithinPartitions("key", "part"), _second_look(piece, None)
    rows = rows.mapInArrow(freeing(look), "deal long, side byte, key int, part long, node long")
    rows = materialise(rows, "apart")
    sets = _sets_of(own, rows.select("node").distinct(), size).join(distinct.select("node", "bits"), "node")
    if (table := _broadcast_table(sets)) is not None:
        dealt, table_of = rows, lambda: table.value
    else:
        dealt, table_of = rows.join(sets, "node").select("deal", "side", "key", "part", "node", "bits", "members"), lambda: None
    out = dealt.repartition("deal").sortWithinPartitions("deal").mapInArrow(freeing(_verify_within(similarity, table_of)), "a long, b long")
    out = materialise(out, "joined")
    discard(rows)
    return out


def similar_classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, similarity: float = 0.8, hot_size: int = HOT, piece: int = PIECE) -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id (the smallest id reachable over verified pairs).

    Pairs whose SimHash fingerprints share a one-wildcard segment are candidates; those whose sets of ``shingle``-word runs have a Jaccard similarity of
    ``similarity`` or more are links. Null and word-less texts have the empty set and are one group. Rows that repeat an id are rows of their own; null ids
    are the smallest only among themselves. An empty table gives no rows."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sets = materialise(own.mapInArrow(freeing(_index(shingle)), "doc_id long, node long, bits array<long>"), "sets")
    distinct = materialise(sets.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("bits").alias("bits")), "distinct")
    variants = distinct.select("node", "bits").mapInArrow(freeing(_variants), "key int, node long, sketch long")
    met = materialise(variants.repartition("key").sortWithinPartitions("key").mapInArrow(freeing(_candidates(hot_size)), "a long, b long, key int, nodes array<long>, sketches array<long>"), "met")
    found = _near_pairs(own, distinct, met.where("key < 0").select("a", "b").distinct(), shingle, similarity)
    hot = met.where("key >= 0").select("key", "nodes", "sketches")
    if not hot.isEmpty():
        found = found.unionByName(_across_components(own, distinct, hot, found, shingle, similarity, piece))
    roots = connected_components(found).withColumnRenamed("root", "top")
    discard(met, found)
    joined = distinct.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("top", "node").alias("root"))
    component = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return sets.select("doc_id", "node").join(component, "node").select("doc_id", "component_id")


def simhash_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of ``similar_classes``: the one whose id names the group; columns as they were. Word-less texts are one group.

    Ids are taken to tell rows apart (exact dedup before this sees to repeated rows); rows without id all stay."""
    groups = similar_classes(docs, text_col, id_col, shingle, similarity)
    name = fresh(docs, "gone_id")[0]
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")
