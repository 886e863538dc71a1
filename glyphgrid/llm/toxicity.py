"""Toxicity by a lexicon that allows for misspelling.

The Levenshtein automaton of each distinct word, a universal table of error profiles, is intersected with the trie of the lexicon, for many words together; memory is
linear in the lexicon. A term's weight is learned from labelled rows; a misspelt form has its own evidence, and the term's where it was never seen.
What stands in quotation marks counts apart from what doesn't, and a small logistic model puts both together."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, freeing, slices, text_array
from .language_id import fold

#: Labelled rows that the model is fitted on, about.
SAMPLE_ROWS = 10_000
#: Distinct words that are searched together, and words that a worker keeps with their nearest terms.
WORDS, KNOWN = 8_192, 1 << 18
#: Words on either side of a hit that belong to its context.
CONTEXT = 12
#: Quotation marks that open and close a quotation. Marks of _BOTH_WAYS may do either, so the number of them before a word tells; single ones count at a word's edge only.
_PAIRS = frozenset({'""', "\u00ab\u00bb", "\u00bb\u00ab", "\u2039\u203a", "\u203a\u2039", "\u201c\u201d", "\u201d\u201d", "\u201e\u201c", "\u201e\u201d", "\u201f\u201d", "''", "\u2018\u2019", "\u2019\u2019", "\u201a\u2018", "\u201a\u2019", "\u300c\u300d", "\u300e\u300f"})
_MARKS = frozenset("".join(_PAIRS))
_BOTH_WAYS = [frozenset(x) for x in ('"', "'", "\u00ab\u00bb", "\u2039\u203a", "\u201d", "\u2019")]
_SINGLE = [ord(c) for c in "'\u2018\u2019\u201a"]
#: Of each character (those beyond the table are letters, by its last entry): its lower case, where that is one character; whether it is no letter, mark or digit.
_TABLE = 0x20000
_LOWER = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(_TABLE)], np.uint32)
_EDGE = np.array([unicodedata.category(chr(c))[0] not in "LMN" for c in range(_TABLE - 1)] + [False])


def errors_allowed(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


#: Errors that terms allow at most; a profile holds the errors at 2 * MOST + 1 places of a word about the letters read, each up to MOST + 1.
MOST = 2
_WIDTH, _DEAD = 2 * MOST + 1, MOST + 1


def _universal() -> tuple[np.ndarray, np.ndarray]:
    """The Levenshtein automaton of any word: value[state, k]: the errors at place k of a profile; step[state, bits]: the profile after a letter that equals the word's at the places whose bits are set."""
    base = _DEAD + 1
    states = base**_WIDTH
    value = np.stack([np.arange(states) // base**k % base for k in range(_WIDTH)], axis=1).astype(np.int8)
    step = np.zeros((states, 1 << _WIDTH), np.int32)
    for bits in range(1 << _WIDTH):
        before = np.full(states, _DEAD, np.int8)
        for k in range(_WIDTH):
            here = value[:, k] + (0 if bits >> k & 1 else 1)
            if k + 1 < _WIDTH:
                here = np.minimum(here, value[:, k + 1] + 1)
            before = np.minimum(np.minimum(here, before + 1), _DEAD).astype(np.int8)
            step[:, bits] += before.astype(np.int32) * base**k
    return value, step


VALUE, STEP = _universal()
_LEAST = VALUE.min(axis=1)
#: No letter read, and MOST places at hand before the word.
_START = sum((k - MOST if k >= MOST else _DEAD) * (_DEAD + 1) ** k for k in range(_WIDTH))


class _Trie:
    """Terms as arrays: children sorted by node and letter. limit: errors up to a node with which one of its terms can still be met; low, high: lengths of the words that it can be met by."""

    def __init__(self, terms: list[tuple[int, np.ndarray, np.ndarray]], letters: int):
        """terms: number, letters, limit after each letter."""
        self.letters = letters
        edges: dict[int, int] = {}
        limit, low, high, term = [0], [1 << 30], [0], [-1]
        for k, word, allowed in terms:
            node, size, n = 0, len(word), int(allowed[-1])
            for c, most in zip(word.tolist(), allowed.tolist(), strict=True):
                node = edges.setdefault(node * letters + c, len(limit))
                if node == len(limit):
                    limit.append(0)
                    low.append(1 << 30)
                    high.append(0)
                    term.append(-1)
                limit[node] = max(limit[node], most)
                low[node], high[node] = min(low[node], size - n), max(high[node], size + n)
            term[node] = k
        self.key = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in self.key.tolist()], np.int64)
        self.limit, self.low, self.high, self.term = (np.array(x, np.int64) for x in (limit, low, high, term))
        self.first = np.searchsorted(self.key, np.arange(len(limit) + 1) * letters)
        self.ahead = np.zeros(len(limit), np.int64)  # the most that a child allows
        np.maximum.at(self.ahead, self.key // letters, self.limit[self.child])

    def search(self, word: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, term, errors) of words near terms. word: letters of each word, MOST places of -1 before and behind them."""
        row = np.arange(len(word))
        node, state, depth = np.zeros(len(word), np.int64), np.full(len(word), _START, np.int64), 0
        while len(row):
            # Where no error is left, only letters of the word lead on.
            tight = _LEAST[state] >= self.ahead[node]
            r, s, n = row[tight], state[tight], node[tight]
            rows, states, edges = [], [], []
            near = word[r, depth : depth + _WIDTH]
            for k in range(_WIDTH):
                new = near[:, k] >= 0
                for j in range(k):
                    new &= near[:, j] != near[:, k]
                at = np.flatnonzero(new)
                wanted = n[at] * self.letters + near[at, k]
                place = np.minimum(np.searchsorted(self.key, wanted), max(0, len(self.key) - 1))
                hit = self.key[place] == wanted if len(self.key) else np.zeros(len(at), bool)
                rows.append(r[at[hit]])
                states.append(s[at[hit]])
                edges.append(place[hit])
            r, s, n = row[~tight], state[~tight], node[~tight]
            count = self.first[n + 1] - self.first[n]
            rows.append(np.repeat(r, count))
            states.append(np.repeat(s, count))
            edges.append(np.repeat(self.first[n] - np.cumsum(count) + count, count) + np.arange(count.sum()))
            row, state, edge = np.concatenate(rows), np.concatenate(states), np.concatenate(edges)
            node, letter = self.child[edge], self.key[edge] % self.letters
            fits = (size[row] >= self.low[node]) & (size[row] <= self.high[node])
            row, state, node, letter = row[fits], state[fits], node[fits], letter[fits]
            bits = ((word[row, depth : depth + _WIDTH] == letter[:, None]) << np.arange(_WIDTH)).sum(axis=1) if len(row) else np.zeros(0, np.int64)
            state = STEP[state, bits].astype(np.int64)
            live = _LEAST[state] <= self.limit[node]
            row, state, node = row[live], state[live], node[live]
            depth += 1
            ends = np.flatnonzero((self.term[node] >= 0) & (np.abs(size[row] - depth) <= MOST))
            yield row[ends], self.term[node[ends]], VALUE[state[ends], size[row[ends]] - depth + MOST]


class LexiconAutomaton:
    """All words within each term's allowed edit distance: the universal Levenshtein automaton of a word, intersected with the trie of the terms.

    Of at most n errors, the front half of a term has at most n // 2 or its back half none: one trie is searched from the front with so few errors
    up to the middle, another from the back, so that few of its nodes are met. Both hold a node a letter of a term: memory is linear in the lexicon."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in terms]
        self.letters = np.unique(np.concatenate(codes)) if terms else np.zeros(0, np.uint32)
        self.allowed = np.array([errors_allowed(t) for t in terms], np.int64)
        self.longest = max((len(t) + MOST for t in terms), default=0)
        front, back = [], []
        for k, (code, n) in enumerate(zip(codes, self.allowed.tolist(), strict=True)):
            word, place, half = np.searchsorted(self.letters, code), np.arange(1, len(code) + 1), len(code) // 2
            front.append((k, word, np.where(place <= half, n // 2, n)))
            if n:
                back.append((k, word[::-1], np.where(place <= len(code) - half, 0, n)))
        self.tries = [_Trie(x, max(1, len(self.letters))) for x in (front, back)]
        self._known: dict[bytes, int] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def nearest(self, words: list[bytes]) -> list[int]:
        """Of each word (UTF-32): errors * terms + the term of fewest errors, the first of several; -1 if none is near."""
        best = np.full(len(words), 1 << 60)
        size = np.fromiter(map(len, words), np.int64, len(words)) >> 2
        for s in range(0, len(words), WORDS):
            own, n = words[s : s + WORDS], size[s : s + WORDS]
            code = np.frombuffer(b"".join(own), np.uint32)
            at = np.minimum(np.searchsorted(self.letters, code), max(0, len(self.letters) - 1))
            letter = np.where(self.letters[at] == code, at, -1) if len(self.letters) else np.full(len(code), -1)
            inside = np.arange(int(n.max(initial=0))) < n[:, None]
            for trie, turned in zip(self.tries, (False, True), strict=True):
                table = np.full((len(own), self.longest + 2 * _WIDTH), -1, np.int64)
                area = table[:, MOST : MOST + inside.shape[1]]
                area[inside] = letter
                if turned:
                    place = np.where(inside, n[:, None] - 1 - np.arange(inside.shape[1]), 0)
                    area[:] = np.where(inside, np.take_along_axis(area, place, 1), -1)
                for row, term, errors in trie.search(table, n):
                    good = errors <= self.allowed[term]
                    np.minimum.at(best, s + row[good], errors[good].astype(np.int64) * len(self.terms) + term[good])
        return np.where(best < 1 << 60, best, -1).tolist()

    def match(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The term that each word (characters data[start : start + size]) is near to, -1 if none. A word that the worker knows isn't searched again."""
        out = np.full(len(start), -1, np.int64)
        at = np.flatnonzero((size > 0) & (size <= self.longest))
        if not len(at):
            return out
        ends = np.concatenate(([0], np.cumsum(size[at])))
        flat = data[np.repeat(start[at] - ends[:-1], size[at]) + np.arange(ends[-1])].astype(np.uint32)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(4 * ends), pa.py_buffer(flat)]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        found = list(map(self._known.get, words))
        new = [k for k, x in enumerate(found) if x is None]
        if len(self._known) + len(new) > KNOWN:
            self._known.clear()
        for k, x in zip(new, self.nearest([words[k] for k in new]), strict=True):
            found[k] = x
            if len(self._known) < KNOWN:
                self._known[words[k]] = x
        found = np.array(found)
        out[at] = np.where(found >= 0, found % max(1, len(self.terms)), -1)[coded.indices.to_numpy()]
        return out


@dataclass
class ToxicityModel:
    automaton: LexiconAutomaton
    form_weight: dict[str, float]
    term_weight: list[float]
    coefficients: np.ndarray


class _Text:
    """Lower-cased words of a slice, by characters, without punctuation at their edges."""

    def __init__(self, values: pa.Array):
        w = Words(values)
        place = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))
        codes = np.frombuffer(w.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        self.raw = np.where(codes < _TABLE, _LOWER[np.minimum(codes, _TABLE - 1)], codes)
        self.start, self.end, self.first = place[w.start], place[w.end], w.first
        edge = _EDGE[np.minimum(self.raw, _TABLE - 1)]
        inner = np.flatnonzero(~edge)
        lead = np.searchsorted(inner, self.start)
        last = np.searchsorted(inner, self.end) - 1
        some = last >= lead
        self.from_ = np.where(some, inner[np.minimum(lead, len(inner) - 1)] if len(inner) else 0, self.start)
        self.size = np.where(some, inner[np.maximum(last, 0)] + 1 - self.from_ if len(inner) else 0, 0)
        marks = np.isin(self.raw, [ord(c) for c in _MARKS])
        if marks.any():  # an apostrophe between letters is no quotation mark
            letter, edges = np.concatenate(([False], ~edge, [False])), place[w.off]
            before, after = letter[:-2].copy(), letter[2:].copy()
            before[edges[edges < len(before)]] = False
            after[edges[edges > 0] - 1] = False
            marks &= ~(np.isin(self.raw, _SINGLE) & before & after)
        self.mark_at = np.flatnonzero(marks)

    def word(self, k: int) -> str:
        return self.raw[self.from_[k] : self.from_[k] + self.size[k]].tobytes().decode("utf-32-le")

    def quoted(self, k: int, doc: int) -> bool:
        """Whether word k stands in quotation marks: the nearest mark before it opens what the nearest after it closes, both within its context."""
        a, z = self.first[doc], self.first[doc + 1]
        low, high = self.start[max(a, k - CONTEXT)], self.end[min(z - 1, k + CONTEXT)]
        at = int(np.searchsorted(self.mark_at, self.from_[k]))
        if at == 0 or at == len(self.mark_at) or self.mark_at[at - 1] < low or self.mark_at[at] >= high:
            return False
        pair = chr(self.raw[self.mark_at[at - 1]]) + chr(self.raw[self.mark_at[at]])
        if pair not in _PAIRS:
            return False
        for marks in _BOTH_WAYS:
            if pair[0] in marks:
                before = self.raw[self.mark_at[np.searchsorted(self.mark_at, self.start[a]) : at]]
                return bool(np.isin(before, [ord(c) for c in marks]).sum() % 2)
        return True


def hits(values: pa.Array, automaton: LexiconAutomaton) -> tuple[np.ndarray, list[tuple[int, str, int, bool]]]:
    """Words of each text, and (text, form, term, quoted) of each word near a term."""
    t = _Text(values)
    term = automaton.match(t.raw, t.from_, t.size)
    at = np.flatnonzero(term >= 0)
    doc = np.searchsorted(t.first, at, side="right") - 1
    return np.diff(t.first), [(int(d), t.word(int(k)), int(term[k]), t.quoted(int(k), int(d))) for k, d in zip(at, doc, strict=True)]


def features(values: pa.Array, model: ToxicityModel) -> tuple[np.ndarray, list[set[str]]]:
    """Of each text: weight of its forms outside quotation marks and inside, whether any is outside, and 1; and the lexicon terms found."""
    n, found = hits(values, model.automaton)
    direct, quoted = np.zeros(len(n)), np.zeros(len(n))
    terms: list[set[str]] = [set() for _ in range(len(n))]
    for d, form, term, inside in set(found):  # a form counts once, in and out of quotation marks
        terms[d].add(model.automaton.terms[term])
        weight = model.form_weight.get(form)
        if weight is None:
            weight = model.term_weight[term] * 0.75
        (quoted if inside else direct)[d] += max(0.0, weight)
    return np.stack([np.minimum(direct, 6), np.minimum(quoted, 6), direct > 1, np.ones(len(n))], axis=1), terms


def _tail(n: int, t: int, p: float) -> float:
    """P(at least t of n) at rate p."""
    return sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)) for k in range(t, n + 1))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 25, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> ToxicityModel:
    """Fitted on about SAMPLE_ROWS labelled rows, taken by a hash of the id. Ids with more than one label count by the largest."""
    own = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").cast("long").alias("_id")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("_label"))
    share = min(1 << 62, (SAMPLE_ROWS << 62) // max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 62)) < share)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sample = texts.join(F.broadcast(own), "_id").select("text", "_label").persist()  # the broadcast side is bounded by SAMPLE_ROWS
    base = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("_label"), F.lit(0)).alias("t")).first()

    def word_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                t = _Text(text_array(part, "text"))
                pairs: list[tuple[str, str, int]] = []
                for d, label in enumerate(part.column(1).to_pylist()):
                    words = [t.word(k) for k in range(t.first[d], t.first[d + 1])]
                    pairs += [(w, v, label) for w, v in {(w, v) for v, w in zip(["", *words], words, strict=False) if any(map(str.isalpha, w))}]
                word, prior, label = zip(*pairs, strict=True) if pairs else ((), (), ())
                yield pa.record_batch([pa.array(word, pa.string()), pa.array(prior, pa.string()), pa.array(label, pa.int32())], names=["word", "prior", "label"])

    rate = (base["t"] + 0.5) / (base["n"] + 1)
    # A word counts once for each word that it follows, so near copies of one toxic document don't make its words terms.
    words = sample.mapInArrow(freeing(word_pairs), "word string, prior string, label int").groupBy("word", "prior").agg(F.avg("label").alias("y"))
    tried, level = max(1000, 50 * base["n"]), min(0.5, 1.5 * rate)
    least = log(0.05 / tried) / log(level)  # level ** t is below the tail, so no word with fewer can pass the test
    words = words.groupBy("word").agg(F.sum("y").alias("t"), F.count("*").alias("n")).where((F.col("t") > least) & (F.col("t") / F.col("n") >= max(0.5, min(3 * rate, 0.5 + rate / 2))))
    found = [r for r in words.orderBy(F.desc("t"), "word").collect() if _tail(r["n"], int(r["t"]), level) * tried < 0.05]  # bounded by the sample
    automaton = LexiconAutomaton([r["word"] for r in found])
    odds = lambda t, n: float(np.log(((t + 0.5) / (n - t + 0.5)) / (rate / (1 - rate))))
    shared = docs.sparkSession.sparkContext.broadcast(automaton)  # some 100 bytes a letter of the lexicon, which the sample bounds
    model = ToxicityModel(automaton, {}, [odds(r["t"], r["n"]) for r in found], np.zeros(4))

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                label = part.column(1).to_pylist()
                own = sorted({(d, form, term) for d, form, term, _ in hits(text_array(part, "text"), shared.value)[1]})
                yield pa.record_batch([pa.array([f for _, f, _ in own], pa.string()), pa.array([t for _, _, t in own], pa.int32()), pa.array([label[d] for d, _, _ in own], pa.int32())], names=["form", "term", "label"])

    seen = sample.mapInArrow(freeing(forms), "form string, term int, label int").groupBy("form", "term").agg(F.sum("label").alias("t"), F.count("*").alias("n")).collect() if found else []
    for r in seen:  # forms near a term within the bounded sample
        term = found[r["term"]]
        prior = 2 * min(0.95, 0.8 * (term["t"] + 0.5) / (term["n"] + 1)) if r["form"] != term["word"] else 0
        model.form_weight[r["form"]] = float(np.log(((r["t"] + prior + 0.25) / (r["n"] - r["t"] + (2 - prior if prior else 0) + 0.25)) / (rate / (1 - rate))))

    weighed = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x, _ = features(text_array(part, "text"), weighed.value)
                yield pa.record_batch([*[pa.array(c.astype(float)) for c in x.T[:3]], part.column(1)], names=["a", "b", "c", "y"])

    table = sample.mapInArrow(freeing(rows), "a double, b double, c double, y int").toPandas().to_numpy(float)
    sample.unpersist()
    if len(table):
        model.coefficients = _logistic(np.column_stack([table[:, :3], np.ones(len(table))]), table[:, 3])
    return model


def predict(docs: DataFrame, model: ToxicityModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, score, terms) of every row: terms are the lexicon terms found, sorted. A null text scores as the empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                x, terms = features(text_array(part, "text"), m)
                score = 1 / (1 + np.exp(-(x @ m.coefficients)))
                yield pa.record_batch([part.column(0), pa.array(score), pa.array([sorted(t) for t in terms], pa.list_(pa.string()))], names=["doc_id", "score", "terms"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(freeing(run), "doc_id long, score double, terms array<string>")


def toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out (crc32(id) mod 5 is 0), score, predicted, terms of every row; learned from labels outside the held-out fold.

    Without usable labels all scores are 0.5 (predicted 1 is avoided: they are set just below). Repeated rows are rows of their own; an
    empty table gives no rows."""
    model = fit(docs, labels.where(fold(F.col(f"`{id_col}`"), 5) != 0), text_col, id_col)
    if not model.coefficients.any():
        model.coefficients = np.array([0, 0, 0, -1e-6])
    out = predict(docs, model, text_col, id_col)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "terms")
