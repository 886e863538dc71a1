"""BPE by a tokenisation automaton.

Compiling: the merges, in order, each add one gadget to an automaton over tokens whose accepted token sequences are exactly BPE's outputs.
Merging u v -> w takes the arc v away after u, gives every state that had an arc u an arc w, and lets w lead where v led. As all
arcs of one token lead to one state, a state is a pair (last token, merge after which it was last copied) and the table is
addressed by (last token, next token); entries are worked out from the gadgets when first asked for and kept.
Encoding: a word's prefixes each have one accepted path, so one left-to-right pass over the token trie finds it.
Decoding: emits the label of every arc."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from ._common import freeing, mix, slices

#: The arc table's slots (a power of two), slots of the edge table for each edge; the cells of state that words advancing together take.
PAIR_BITS, EDGE_SLOTS, CELLS = 20, 4, 1 << 20
#: Text bytes that are encoded at a time.
SLICE = 2 << 20
_NEVER = 1 << 60
_SCATTER = 2654435761
_SEPARATORS = regex.compile(r"[\x1c-\x1f]").search
_SPACE = regex.compile(r"\p{White_Space}+").split


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable in Latin-1, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class TokenAutomaton:
    """Deterministic automaton over token ids, compiled from merges in order of rank. It holds arrays of a few MB, fit to be broadcast."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        size = max(vocabulary.values(), default=-1) + 1
        self.birth = array("l", [_NEVER]) * size  # of each token: the merge that made it; base symbols -1; no token _NEVER
        self.left, self.right = array("i", [-1]) * size, array("i", [-1]) * size
        self.cut: dict[int, int] = {}  # u << 24 | v -> merge that took the arc v away after u
        made = {a + b for a, b in merges}
        for text, i in vocabulary.items():
            if text not in made:
                self.birth[i] = -1
        for rank, (a, b) in enumerate(merges):
            self._gadget(rank, vocabulary[a], vocabulary[b], vocabulary[a + b])
        self._compile_trie({i: t for t, i in vocabulary.items() if self.birth[i] != _NEVER})
        self._pair: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pair": None, "_arcs": None}

    def _compile_trie(self, labels: dict[int, str]) -> None:
        """A trie of the tokens' bytes. Its edges are a hash table: _edge[slot] is node << 8 | byte, _child[slot] the next node; token[k, node] is the token that
        ends there, -1 if none (k: 1 at a word's end)."""
        code = {c: b for b, c in enumerate(byte_letters())}
        edges: dict[int, int] = {}
        ends = []
        for i, text in labels.items():
            closed = bool(self.suffix) and text.endswith(self.suffix) and len(text) > len(self.suffix)
            node = 0
            for c in text.removesuffix(self.suffix) if closed else text:
                node = edges.setdefault((node << 8) | code[c], len(edges) + 1)
            ends.append((int(closed), node, i))
        bits = max(8, (EDGE_SLOTS * len(edges)).bit_length())
        self._shift = np.uint32(32 - bits)
        self._edge, self._child = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        for key, child in edges.items():
            slot = ((key * _SCATTER) & 0xFFFFFFFF) >> (32 - bits)
            while self._edge[slot] >= 0:
                slot = (slot + 1) & ((1 << bits) - 1)
            self._edge[slot], self._child[slot] = key, child
        self.token = np.full((2, len(edges) + 1), -1, np.int32)
        for k, node, i in ends:
            self.token[k, node] = i
        if not self.suffix:
            self.token[1] = self.token[0]

    def follow(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes that bytes lead to, 0 if none."""
        key = (node.astype(np.int64) << 8) | byte
        slot = ((key.astype(np.uint32) * np.uint32(_SCATTER)) >> self._shift).astype(np.int64)
        found = self._edge[slot]
        out = np.where(found == key, self._child[slot], 0)
        rest = np.flatnonzero((found != key) & (found >= 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (len(self._edge) - 1)
            found = self._edge[slot[rest]]
            hit = found == key[rest]
            out[rest[hit]] = self._child[slot[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if self.birth[u] == _NEVER or self.birth[v] == _NEVER or not self._arc(u, rank - 1, v):
            return  # the arc is gone already: this merge never applies
        if self.birth[w] != _NEVER:
            raise ValueError(f"two merges make token {w}")
        self.cut[u << 24 | v] = rank
        self.birth[w], self.left[w], self.right[w] = rank, u, v

    def _arc(self, t: int, when: int, w: int) -> bool:
        """Whether, after merge ``when``, the state that token t leads to has an arc w."""
        birth, cut = self.birth, self.cut
        while True:
            if cut.get(t << 24 | w, _NEVER) <= when:
                return False
            if birth[t] > birth[w]:  # t leads where its right part led before t was made
                when, t = birth[t] - 1, self.right[t]
            elif birth[w] < 0:
                return True
            else:  # w was given to the states that then had its left part
                when, w = min(when, birth[w]), self.left[w]

    def arcs(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Table look-up of (last token, next token); an entry missing from the table is worked out from the gadgets."""
        if self._pair is None:
            self._pair, self._arcs = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        key = (before.astype(np.int64) << 24) | token
        slot = (mix(key.view(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self._arcs[slot]
        absent = self._pair[slot] != key
        if absent.any():
            new, back = np.unique(key[absent], return_inverse=True)
            found = np.fromiter((self._arc(k >> 24, _NEVER - 1, k & 0xFFFFFF) for k in new.tolist()), bool, len(new))
            out[absent] = found[back]
            where = (mix(new.view(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
            where, first = np.unique(where, return_index=True)
            self._pair[where], self._arcs[where] = new[first], found[first]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-split words, one after the other, and where each word's begin (one more at the end).

        Words advance together: each prefix of a word has one accepted path, so its last token and where that begins are all the state."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.concatenate(([0], np.cumsum(size)))
        flat = np.frombuffer(b"".join(words), np.uint8)
        order = np.argsort(size, kind="stable")
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        s = 0
        while s < len(order):
            rows = order[s : s + CELLS // 4]
            cells = (size[rows] + 1) * np.arange(1, len(rows) + 1)  # of the longest word so far times the words
            rows = rows[: max(1, int(np.searchsorted(cells, CELLS, side="right")))]
            stop = s + len(rows)
            done.append((rows, *self._together(flat, start[rows], size[rows])))
            s = stop
        count = np.zeros(len(words), np.int64)
        for rows, n, _ in done:
            count[rows] = n
        off = np.concatenate(([0], np.cumsum(count)))
        ids = np.empty(off[-1], np.int32)
        for rows, n, own in done:
            ids[np.repeat(off[rows] - np.cumsum(n) + n, n) + np.arange(len(own))] = own
        return ids, off

    def _together(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width, m = int(size.max(initial=0)), len(size)
        text = flat[np.minimum(start[:, None] + np.arange(width), max(0, len(flat) - 1))] if len(flat) else np.zeros((m, 0), np.uint8)
        last = np.full((width + 1, m), -1, np.int32)
        back = np.zeros((width + 1, m), np.int32)
        for p in range(width):
            row = np.flatnonzero((size > p) & (last[p] >= 0)) if p else np.flatnonzero(size > 0)
            before, node = last[p][row], np.zeros(len(row), np.int32)
            for q in range(p, width):
                node = self.follow(node, text[row, q])
                live = node > 0
                if not live.all():
                    row, before, node = row[live], before[live], node[live]
                if not len(row):
                    break
                end = size[row] == q + 1
                token = self.token[end.view(np.int8), node]
                pick = np.flatnonzero((token >= 0) & (last[q + 1][row] < 0))
                if p and len(pick):
                    pick = pick[self.arcs(before[pick], token[pick])]
                last[q + 1][row[pick]] = token[pick]
                back[q + 1][row[pick]] = p
                if end.any():
                    row, before, node = row[~end], before[~end], node[~end]
        at, every = size.copy(), np.arange(m)
        if (last[at, every][size > 0] < 0).any():
            raise ValueError("the vocabulary has no symbols for some word")
        steps, n = [], np.zeros(m, np.int64)
        while (open_ := at > 0).any():
            steps.append(np.where(open_, last[at, every], -1))
            n += open_
            at = np.where(open_, back[at, every], 0)
        if not steps:
            return n, np.zeros(0, np.int32)
        table = np.stack(steps[::-1], axis=1)
        return n, table[table >= 0]


class Tokeniser:
    """A tokenizer file (JSON: NFC, white space, lower case; split by pattern; byte letters; BPE) run by TokenAutomaton.

    Where this Python's tables of characters differ from those of the tokenizers library, the library's own normaliser and splitter are asked."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        self._check(spec)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = TokenAutomaton(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.own_pattern = regex.compile(self.pattern.replace(r"\s", r"\p{White_Space}"))
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        labels = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        spelt = [(labels[i] + " ").encode() if i in labels else b"" for i in range(max(labels) + 1)]
        self._size = np.array([len(x) for x in spelt], np.int64)
        self._place = np.cumsum(self._size) - self._size
        self._data = np.frombuffer(b"".join(spelt), np.uint8)
        self._library: tuple | None = None
        self.unsure = None
        self.unsure = self._characters_unsure()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_library": None}

    @staticmethod
    def _check(spec: dict) -> None:
        """Only the kind of tokenizer that this class runs is let in."""
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["model"]["type"] != "BPE" or spec["decoder"] or spec["post_processor"] or spec["model"]["continuing_subword_prefix"]:
            raise ValueError("this tokenizer file needs steps that are not built")

    def _asked(self) -> tuple:
        """The library's normaliser, but for white space, and its splitter."""
        if self._library is None:
            self._library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]), pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True)
        return self._library

    def _characters_unsure(self) -> re.Pattern:
        """The characters with which this Python and the library differ, alone or next to others, found by trying each; those beyond U+FFFF are not tried but asked for."""
        normaliser, splitter = self._asked()
        tried = [chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
        differ: set[str] = set()

        def try_out(texts: list[str], of: list[str]) -> list[str]:
            library, own = normaliser.normalize_str("\n".join(texts)).split("\n"), [self._normal(t) for t in texts]
            differ.update(c for x, y, chars in zip(library, own, of, strict=True) if x != y for c in chars)
            return own

        once = try_out(tried, tried)
        for c, x in zip(tried, once, strict=True):
            parts = f"a{x}b1{x}{x}!{x}'s"
            if not x.isspace() and [p for p, _ in splitter.pre_tokenize_str(parts)] != self.own_pattern.findall(parts):
                differ.add(c)
            if not x.isspace() and x.isalpha() and len(splitter.pre_tokenize_str(f"a{x}")) != 1:
                differ.add(c)
            if c.isspace() != (not splitter.pre_tokenize_str(f"{x}") and not self.own_pattern.findall(x)):
                differ.add(c)
        marks = [c for c in tried if unicodedata.combining(c)]
        for m in "\u0334\u094d\u0327\u0323\u0301\u0345":  # one each of six combining classes
            for pair in ([c + m for c in marks], [m + c for c in marks]):
                try_out(["a" + x for x in pair], marks)
        whole = [c for c in tried if unicodedata.decomposition(c) and not unicodedata.decomposition(c).startswith("<")]
        parts = [unicodedata.normalize("NFD", c) for c in whole]
        try_out(parts, [c + p for c, p in zip(whole, parts, strict=True)])
        codes, ranges = sorted(map(ord, differ)), []
        for c in codes:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
        return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in [*ranges, (0x10000, 0x10FFFF)]) + "]")

    def chunks(self, text: str) -> list[str]:
        """The normalised text cut at white space, which no word crosses; an added token is a space and its string, a chunk for the library a line feed and the raw chunk."""
        if self.special and "<" in text and len(parts := self.special.split(text)) > 1:
            return [w for k, part in enumerate(parts) for w in ([" " + part] if k % 2 else self._split(part))]
        return self._split(text)

    @staticmethod
    def _normal(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        if "\u03a3" in text:  # lower-casing is by letter: the final form of sigma is not used
            text = text.replace("\u03a3", "\u03c3")
        return text.lower()

    def _split(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
        elif self.unsure.search(text):
            return [w for x in _SPACE(text) if x for w in (["\n" + x] if self.unsure.search(x) else self._split(x))]
        else:
            text = self._normal(text)
        if _SEPARATORS(text):  # str.split takes these for white space
            return [x for x in _SPACE(text) if x]
        return text.split()

    def _pieces(self, chunk: str) -> list[str]:
        if chunk[0] == " " or chunk.isalpha():
            return [chunk]
        if chunk[0] == "\n":
            normaliser, splitter = self._asked()
            return [p for p, _ in splitter.pre_tokenize_str(normaliser.normalize_str(chunk[1:]))]
        return self.own_pattern.findall(chunk)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (one more at the end). Each distinct word is run once."""
        split = [self.chunks(t) for t in texts]
        flat = list(chain.from_iterable(split))
        number = {c: k for k, c in enumerate(dict.fromkeys(flat))}
        index = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        pieces = [self._pieces(c) for c in number]
        ids, off = self._encode_words(list(chain.from_iterable(pieces)))
        off = off[np.concatenate(([0], np.cumsum([len(x) for x in pieces]))).astype(np.int64)]
        ids, off = _gather(ids, off, index)
        return ids, off[np.concatenate(([0], np.cumsum([len(x) for x in split]))).astype(np.int64)]

    def _encode_words(self, flat: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number = {w: k for k, w in enumerate(dict.fromkeys(flat))}
        ids, off = self.automaton.encode([b"" if w[0] == " " else w.encode() for w in number])
        for k, w in [(k, w) for k, w in enumerate(number) if w[0] == " "]:
            ids, off = np.insert(ids, off[k], self.added[w[1:]]), off + (np.arange(len(off)) > k)
        return _gather(ids, off, np.fromiter(map(number.__getitem__, flat), np.int64, len(flat)))

    def decode_batch(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        """UTF-8 of each text's decoded form: the labels of its arcs, a space between; ids without a label are passed over."""
        known = (ids >= 0) & (ids < len(self._size))
        known[known] = self._size[ids[known]] > 0
        if not known.all():
            off = np.concatenate(([0], np.cumsum(known)))[off]
            ids = ids[known]
        size = self._size[ids]
        ends = np.cumsum(size)
        data = self._data[np.repeat(self._place[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        at = np.concatenate(([0], ends))[off]
        return [data[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode()


def _gather(values: np.ndarray, off: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of ``values`` that ``index`` names, one after the other, and where each begins (one more at the end)."""
    size = np.diff(off)[index]
    ends = np.cumsum(size)
    return values[np.repeat(off[:-1][index] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], np.concatenate(([0], ends))


def read_spec(spark: SparkSession, path: str) -> str:
    """A tokenizer file by any path that the driver or Spark reads: a few MB, whatever the corpus."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except OSError:
        return spark.read.text(path, wholetext=True).first()[0]


def bpe_encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int).

    Whole texts are encoded; null counts as the empty text, which has no ids and decodes to the empty text. Strings of added tokens
    in a text become those tokens. Repeated rows are rows of their own; an empty table gives no rows."""
    compiled = docs.sparkSession.sparkContext.broadcast(Tokeniser(read_spec(docs.sparkSession, tokenizer_path)))  # a few MB, whatever the corpus
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, off = t.encode_batch([x or "" for x in part.column(1).to_pylist()])
                raw = ids.astype("<u4").tobytes()
                digests = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                decoded = [hashlib.sha256(x).hexdigest() for x in t.decode_batch(ids, off)]
                columns = [part.column(0), pa.array(np.diff(off)), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                yield pa.record_batch(columns + [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))] * with_ids, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(freeing(run), schema)


def bpe_decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text): the decoded text of each row's ids; null ids decode to the empty text."""
    compiled = encoded.sparkSession.sparkContext.broadcast(Tokeniser(read_spec(encoded.sparkSession, tokenizer_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled.value
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([t.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids")).mapInArrow(freeing(run), "doc_id long, text string")
