"""Byte-level BPE without a regular expression.

Splitting: every code point has a class (letter, number, white space, other), every character a symbol made of its class and what follows it.
A small deterministic automaton over these symbols knows where pieces begin; the functions that symbols make of its states, closed under
composition, are a few dozen, so a prefix of a text is one byte and two prefixes are composed by a table. As composition is associative, blocks of a
slice of texts advance together and are joined up afterwards. Encoding: distinct pieces are merged pair by pair, lowest rank first, and kept in a
bounded table by each worker. Decoding: the bytes of each token, cut by the offsets that encoding kept."""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import freeing, mix, offsets_of, slices, text_array

#: The pattern whose matches are the pieces. Fixed value: ids agree with other programs only if all split alike.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text bytes that are split and encoded at a time; characters that one block of the scan steps through.
SLICE, BLOCK = 4 << 20, 512
#: Pieces that a worker keeps with their ids, and the longest of them in bytes; longer ones are merged by a heap. Cells of pieces that are merged together.
KEPT, SHORT, CELLS = 1 << 18, 32, 1 << 17

OTHER, LETTER, NUMBER, SPACE = range(4)
#: States: what the piece that holds the last character can still take. CLOSED: nothing; BLANK: one space that goes to the next piece; GAP: white space; ONE, TWO: so many letters after an apostrophe.
CLOSED, LETTERS, NUMBERS, OTHERS, BLANK, GAP, ONE, TWO = range(8)
#: Symbols 0 to 2 are the first three classes. INNER: white space before white space or the end; JOINED: a last white space that is U+0020; LONE: another last white space; SHORT_END, LONG_END: an apostrophe with the end of a contraction of one or two letters.
INNER, JOINED, LONE, SHORT_END, LONG_END = range(3, 8)
#: Added to the symbol of a text's first character.
FIRST = 8


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a character, and whether a piece begins with it."""
    if symbol == INNER:
        return GAP, state != GAP
    if symbol == JOINED:
        return BLANK, True
    if symbol == LONE:
        return CLOSED, True
    if symbol == LETTER and state in (ONE, TWO):
        return (CLOSED if state == ONE else ONE), False
    run = {LETTER: LETTERS, NUMBER: NUMBERS}.get(symbol, OTHERS)
    if state in (run, BLANK):
        return run, False
    return {SHORT_END: ONE, LONG_END: TWO}.get(symbol, run), True


def _compiled() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """element: of each symbol; after: the table of compositions; lands: the state after an element, from the start; begins[state, symbol]."""
    functions = [tuple(_step(s, x)[0] for s in range(8)) for x in range(8)]
    functions += [(f[CLOSED],) * 8 for f in functions]  # a text's first character leaves all that was before
    found = list(dict.fromkeys(functions))
    for f in found:  # grows while it is read, until composing gives nothing new
        found += [h for g in dict.fromkeys(functions) if (h := tuple(g[s] for s in f)) not in found]
    number = {f: k for k, f in enumerate(found)}
    after = np.array([[number[tuple(g[s] for s in f)] for g in found] for f in found], np.uint8)
    begins = np.array([[_step(s, x)[1] for x in range(8)] + [True] * 8 for s in range(8)], bool)
    return np.array([number[f] for f in functions], np.uint8), after, np.array([f[CLOSED] for f in found], np.uint8), begins


ELEMENT, AFTER, LANDS, BEGINS = _compiled()


def running(elements: np.ndarray) -> np.ndarray:
    """The composition of all elements up to each place. Blocks are scanned side by side, then each takes the composition of all before it."""
    n = len(elements)
    width = min(BLOCK, max(1, n))
    rows = -(-n // width)
    table = np.zeros((width, rows), np.uint8)  # one column a block: a step reads and writes whole rows
    padded = np.zeros(rows * width, np.uint8)
    padded[:n] = elements
    table[:] = padded.reshape(rows, width).T
    for k in range(1, width):
        table[k] = AFTER[table[k - 1], table[k]]
    if rows > 1:
        before = running(table[-1])
        table[:, 1:] = AFTER[before[:-1][None, :], table[:, 1:]]
    return np.ascontiguousarray(table.T).reshape(-1)[:n]


def character_classes() -> np.ndarray:
    """The class of every code point, by the tables of the library whose ids are to be met: it returns the characters that a class's pattern finds. The same whatever the data."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        probe = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([k]): k for k in range(256)}, special_tokens={})
        out[np.frombuffer(bytes(probe.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def piece_starts(code: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pieces begin, as a mask over characters. code: the code points of texts, one after the other; first: where each text that isn't empty begins."""
    n = len(code)
    if not n:
        return np.zeros(0, bool)
    kind = classes[code]
    ends = np.zeros(n + 3, bool)  # a text's end lies before this character
    ends[first] = ends[n:] = True
    wide = np.concatenate((code, np.zeros(3, code.dtype)))
    symbol = kind.copy()
    blank = np.flatnonzero(kind == SPACE)
    last = ~ends[blank + 1]
    last[last] = kind[blank[last] + 1] != SPACE
    symbol[blank] = np.where(last, np.where(code[blank] == 0x20, JOINED, LONE), INNER)
    mark = np.flatnonzero(code == 0x27)
    one, two = wide[mark + 1], wide[mark + 2]
    near = ~ends[mark + 1]
    short = near & np.isin(one, [ord(c) for c in "stmd"])
    long = near & ~ends[mark + 2] & (((one == ord("l")) & (two == ord("l"))) | (((one == ord("v")) | (one == ord("r"))) & (two == ord("e"))))
    symbol[mark] = np.where(short, SHORT_END, np.where(long, LONG_END, OTHER))
    symbol[first] += FIRST
    state = LANDS[running(ELEMENT[symbol])]
    return BEGINS[np.concatenate(([np.uint8(CLOSED)], state[:-1])), symbol]


class ByteTokeniser:
    """Ranks of byte strings, run without a regular expression. It holds arrays of some 10 MB, whatever the corpus; every single byte must have a rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.classes, self.labels = ranks, character_classes(), Labels.of(ranks)
        self.decimals = Labels([b"%d " % k for k in range(len(self.labels.size))])
        self.none = len(self.labels.size)
        self.single = np.array([ranks[bytes([k])] for k in range(256)], np.int32)
        self._compile_pairs()
        self._kept: dict[bytes, bytes] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_kept": {}}

    def pieces(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """data: the texts' bytes; at: where each piece begins (one more at the end); first: of each text the index of its first piece (one more at the end)."""
        off = offsets_of(values)
        data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if len(values) else np.zeros(0, np.uint8)
        off = off - off[0]
        place = np.flatnonzero((data & 0xC0) != 0x80)  # of each character
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        begin = np.unique(off[:-1][np.diff(off) > 0])
        at = place[piece_starts(code, np.searchsorted(place, begin), self.classes)]
        return data, np.append(at, len(data)), np.searchsorted(at, off)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that two neighbours make, the number of tokens if none."""
        key = left.astype(np.int64) << 32 | right
        slot = (mix(key.view(np.uint64)) >> self._shift).astype(np.int64)
        out = np.full(len(key), self.none, np.int32)
        row = np.arange(len(key))
        while len(row):
            found = self._pair[slot[row]]
            hit = found == key[row]
            out[row[hit]] = self._made[slot[row[hit]]]
            row = row[~hit & (found >= 0)]
            slot[row] = (slot[row] + 1) & (len(self._pair) - 1)
        return out

    def _compile_pairs(self) -> None:
        """A hash table of all pairs of tokens whose joined bytes are a token."""
        pairs = {a << 32 | b: k for text, k in self.ranks.items() for cut in range(1, len(text)) if (a := self.ranks.get(text[:cut])) is not None and (b := self.ranks.get(text[cut:])) is not None}
        bits = max(8, (4 * len(pairs)).bit_length())
        self._shift = np.uint64(64 - bits)
        self._pair, self._made = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        key = np.fromiter(pairs, np.int64, len(pairs))
        for slot, pair, made in zip((mix(key.view(np.uint64)) >> self._shift).tolist(), pairs, pairs.values(), strict=True):
            while self._pair[slot] >= 0:
                slot = (slot + 1) & ((1 << bits) - 1)
            self._pair[slot], self._made[slot] = pair, made

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as 32-bit integers: its own if it is a token; else, of all neighbours that make a token those of the lowest rank, the leftmost first, are joined, until none do.

        Pieces of like length go through the steps together, one join each a step; long ones alone."""
        out = [b"" if (whole := self.ranks.get(p)) is None else whole.to_bytes(4, sys.byteorder) for p in pieces]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(size, kind="stable")
        order = order[[not out[k] for k in order.tolist()]]
        order, rest = order[size[order] <= SHORT], order[size[order] > SHORT]
        for k in rest.tolist():
            out[k] = np.array(self._merge_long(pieces[k]), np.int32).tobytes()
        s = 0
        while s < len(order):
            rows = order[s : s + CELLS]
            rows = rows[: max(1, int(np.searchsorted((size[rows] + 1) * np.arange(1, len(rows) + 1), CELLS, side="right")))]
            ids, count = self._together([pieces[k] for k in rows.tolist()], size[rows])
            raw, at = ids.tobytes(), np.concatenate(([0], np.cumsum(4 * count))).tolist()
            for k, a, b in zip(rows.tolist(), at[:-1], at[1:], strict=True):
                out[k] = raw[a:b]
            s += len(rows)
        return out

    def _together(self, pieces: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and their number for each."""
        width, none = int(size.max()), self.none
        flat = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ids = np.full((len(pieces), width + 1), -1, np.int32)
        inside = np.arange(width + 1) < size[:, None]
        ids[inside] = flat
        made = np.full((len(pieces), width), none, np.int32)
        both = inside[:, 1:]
        made[both] = self._joined(ids[:, :-1][both], ids[:, 1:][both])
        left, row, place = size.copy(), np.arange(len(pieces)), np.arange(width + 1)
        while len(row):
            k = made[row].argmin(axis=1)
            low = made[row, k]
            live = low < none
            row, k, low = row[live], k[live], low[live]
            if not len(row):
                break
            move = np.minimum(place + (place > k[:, None]), width)  # the part after the join goes
            ids[row] = np.take_along_axis(ids[row], move, 1)
            ids[row, k] = low
            made[row] = np.take_along_axis(made[row], np.minimum(move[:, :-1], width - 1), 1)
            left[row] -= 1
            made[row, left[row] - 1] = none
            for at in (k - 1, k):
                has = (at >= 0) & (at + 1 < left[row])
                r, c = row[has], at[has]
                made[r, c] = self._joined(ids[r, c], ids[r, c + 1])
        return ids[np.arange(width + 1) < left[:, None]], left

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap of (rank, place): in time of n log n, for pieces of any length."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that begins at a place; 0: none begins there
        before = list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            if not (middle := end[k]) or middle >= n or ranks.get(piece[k : (stop := end[middle])]) != r:
                continue  # one of the two has been joined otherwise meanwhile
            end[k], end[middle] = stop, 0
            if stop < n:
                before[stop] = k
                if (x := ranks.get(piece[k : end[stop]])) is not None:
                    heapq.heappush(heap, (x, k))
            if k and (x := ranks.get(piece[before[k] : stop])) is not None:
                heapq.heappush(heap, (x, before[k]))
        out, k = [], 0
        while k < n:
            out.append(ranks[piece[k : end[k]]])
            k = end[k]
        return out

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces, each as 32-bit integers: those that the worker knows are looked up, the others merged and kept."""
        out = list(map(self._kept.get, pieces))
        new = [k for k, x in enumerate(out) if x is None]
        if len(self._kept) + len(new) > KEPT:
            self._kept.clear()
        for k, ids in zip(new, self.merge([pieces[k] for k in new]), strict=True):
            out[k] = ids
            if len(pieces[k]) <= SHORT and len(self._kept) < KEPT:
                self._kept[pieces[k]] = ids
        return out

    def encode_array(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (one more at the end). Each distinct piece is looked up once."""
        data, at, first = self.pieces(values)
        if len(at) == 1:
            return np.zeros(0, np.int32), np.zeros(len(values) + 1, np.int64)
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
        coded = whole.dictionary_encode()
        own = self.ids_of(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, own), np.int64, len(own)) >> 2
        place, flat, index = np.cumsum(size) - size, np.frombuffer(b"".join(own), np.int32), coded.indices.to_numpy()
        count = size[index]
        ends = np.cumsum(count)
        ids = flat[np.repeat(place[index] - ends + count, count) + np.arange(ends[-1])]
        return ids, np.concatenate(([0], ends))[first]

    def decode_array(self, ids: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all texts and where each text's begin. Ids that no token has stand for nothing."""
        return self.labels.joined(ids, off)


class Labels:
    """A byte string for each id, joined up for runs of ids."""

    def __init__(self, labels: list[bytes]):
        self.size = np.array([len(x) for x in labels], np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(labels), np.uint8)

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Labels:
        labels = [b""] * (max(ranks.values(), default=-1) + 1)
        for text, k in ranks.items():
            labels[k] = text
        return cls(labels)

    def joined(self, ids: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray]:
        known = (ids >= 0) & (ids < len(self.size))
        if not known.all():
            off, ids = np.concatenate(([0], np.cumsum(known)))[off], ids[known]
        size = self.size[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        return self.data[np.repeat(self.place[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes(), ends[off]


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A file of ranks by any path that the driver or Spark reads: a few MB, whatever the corpus."""
    try:
        with open(path, "rb") as f:
            lines = f.read().splitlines()
    except OSError:
        lines = spark.read.text(path, wholetext=True).first()[0].encode().splitlines()
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}


def byte_bpe_encode(docs: DataFrame, ranks_path: str, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256 (of the decimal ids, a space between), decoded_sha256 and, if asked for, ids
    (array of int) and ends (array of int: where in the text's bytes each token ends).

    Whole texts are encoded; null counts as the empty text, which has no ids. Strings of special tokens are ordinary text. Repeated rows are rows
    of their own; an empty table gives no rows."""
    compiled = docs.sparkSession.sparkContext.broadcast(ByteTokeniser(read_ranks(docs.sparkSession, ranks_path)))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "ends"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, off = t.encode_array(text_array(part, "text"))
                spelt, at = t.decimals.joined(ids, off)
                decoded, to = t.decode_array(ids, off)
                columns = [part.column(0), pa.array(np.diff(off)), digests(spelt, at, 1), digests(decoded, to, 0)]
                if with_ids:
                    size = t.labels.size[ids]
                    ends = np.cumsum(size) - np.repeat(to[:-1], np.diff(off))
                    lists = pa.array(off.astype(np.int32))
                    columns += [pa.ListArray.from_arrays(lists, pa.array(ids)), pa.ListArray.from_arrays(lists, pa.array(ends.astype(np.int32)))]
                yield pa.record_batch(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, ends array<int>" * with_ids
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(freeing(run), schema)


def digests(data: bytes, at: np.ndarray, less: int) -> pa.Array:
    """SHA-256 of each range, without its last ``less`` bytes."""
    return pa.array([hashlib.sha256(data[a : max(a, b - less)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())


def byte_bpe_decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, bytes): the bytes of each row's ids; null ids give no bytes, ids that no token has are passed over."""
    compiled = encoded.sparkSession.sparkContext.broadcast(Labels.of(read_ranks(encoded.sparkSession, ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = compiled.value
        for batch in batches:
            lists = batch.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            off = np.concatenate(([0], np.cumsum(size)))
            data, at = labels.joined(pc.fill_null(lists.flatten(), -1).to_numpy(), off)
            yield pa.record_batch([batch.column(0), pa.array([data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids")).mapInArrow(freeing(run), "doc_id long, bytes binary")
