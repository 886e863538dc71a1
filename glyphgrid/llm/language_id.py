"""Language ID by mixture inference.

Every document is a mixture of languages, each a distribution over hashed byte trigrams. Expectation-maximisation finds the proportions; of
the nested sets of the most probable languages the one with the highest penalised likelihood is taken."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import freeing, offsets_of, slices, text_array

GRAMS = 4096
#: Text bytes and rows (of GRAMS counts each) of one vectorised step, steps of EM over all languages and over a chosen set, weight of a language in the penalty.
STEP_BYTES, STEP_ROWS, FULL_STEPS, SET_STEPS, PENALTY = 1 << 20, 1024, 12, 5, 2.0
_PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


@dataclass
class LanguageModel:
    """log_p[l, g]: log probability of gram g in language l; bounded by the number of languages times GRAMS."""

    languages: list[str]
    log_p: np.ndarray


def gram_counts(values: pa.Array) -> np.ndarray:
    """Counts of hashed byte trigrams, one row a text: letters lower-cased in A-Z, other ASCII as spaces."""
    off = offsets_of(values)
    data = _PLAIN[np.frombuffer(values.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]].astype(np.uint32)
    off = off - off[0]
    n = len(values)
    if len(data) < 3:
        return np.zeros((n, GRAMS), np.float32)
    gram = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
    real = (owner[:-2] == owner[2:]) & (gram != 0x202020)
    slot = (gram[real] * np.uint32(2654435761)) >> np.uint32(20)
    return np.bincount(owner[:-2][real] * GRAMS + slot, minlength=n * GRAMS).reshape(n, GRAMS).astype(np.float32)


def has_letter(values: pa.Array) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    off = offsets_of(values)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    ascii_letters = np.concatenate(([0], np.cumsum((data | 32) - np.uint8(97) < 26)))
    out = np.diff(ascii_letters[off - off[0]]) > 0
    for k in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[k] = any(map(str.isalpha, values[int(k)].as_py()))
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Gram counts of all texts by language, over every row with text and language. No such rows: a model without languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES, STEP_ROWS):
                counts, names = gram_counts(text_array(part, "text")), np.array(part.column(1).to_pylist(), object)
                for name in set(names):
                    total[name] = total.get(name, 0) + counts[names == name].sum(axis=0, dtype=np.float64)
        for name, row in total.items():
            at = np.flatnonzero(row)
            yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))], names=["lang", "gram", "n"])

    own = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).dropna()
    rows = own.mapInArrow(freeing(run), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    count = np.zeros((len(languages), GRAMS))
    count[rows["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(int), rows["gram"].to_numpy(int)] = rows["n"]
    return LanguageModel(languages, np.log((count + 0.5) / (count.sum(axis=1, keepdims=True) + 0.5 * GRAMS)))


def _maximise(counts: np.ndarray, p: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """EM from ``share`` (a language at zero stays there): the proportions and their log likelihood."""
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    for _ in range(steps):
        share = share * ((counts / np.maximum(share @ p, 1e-30)) @ p.T) / total
        share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-30)
    return share, np.einsum("dg,dg->d", counts, np.log(np.maximum(share @ p, 1e-30)))


def mixture(counts: np.ndarray, model: LanguageModel) -> np.ndarray:
    """Proportions of the languages in each document, zero outside its chosen set."""
    d, k = len(counts), len(model.languages)
    p = np.exp(model.log_p).astype(np.float32)
    full, _ = _maximise(counts, p, np.full((d, k), 1 / k, np.float32), FULL_STEPS)
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(k)[None, :].repeat(d, 0), axis=1)
    cost = PENALTY * np.log(np.maximum(counts.sum(axis=1), 2))
    best, best_value, todo = np.zeros((d, k), np.float32), np.full(d, -np.inf), np.arange(d)
    for size in range(1, k + 1):  # a document leaves when a larger set no longer pays
        share = np.where(rank[todo] < size, np.maximum(full[todo], 1e-3), 0).astype(np.float32)
        share, value = _maximise(counts[todo], p, share / share.sum(axis=1, keepdims=True), SET_STEPS if size > 1 else 0)
        value = value - size * cost[todo]
        better = value > best_value[todo]
        best[todo[better]], best_value[todo[better]] = share[better], value[better]
        todo = todo[better]
        if not len(todo):
            break
    return best


def likelihood_gain(counts: np.ndarray, share: np.ndarray, model: LanguageModel) -> np.ndarray:
    """Of each document: by how much, in nats a gram, its mixture makes it likelier than a source that knows no language (all grams alike) does; 0 without grams."""
    p = np.exp(model.log_p).astype(np.float32)
    total = counts.sum(axis=1)
    own = np.einsum("dg,dg->d", counts, np.log(np.maximum(share @ p, 1e-12)))
    return np.where(total > 0, own / np.maximum(total, 1) + np.log(GRAMS), 0.0)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (the language's proportion), languages (the chosen set, largest first), gain (``likelihood_gain``).

    Null texts and texts without a letter are 'und' with score and gain 0, as is everything if the model has no languages. keep: columns
    to carry along under names of their own."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carried = keep or []
    schema = ", ".join([f"{n} {docs.select(F.col(f'`{n}`')).schema[0].dataType.simpleString()}" for n in carried] + ["doc_id long, lang_pred string, score double, languages array<string>, gain double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "_text", STEP_BYTES, STEP_ROWS):
                values = text_array(part, "_text")
                letters = has_letter(values) if m.languages else np.zeros(len(values), bool)
                counts = gram_counts(values) if letters.any() else None
                share = mixture(counts, m) if letters.any() else np.zeros((len(values), max(1, len(m.languages))), np.float32)
                gain = np.where(letters, likelihood_gain(counts, share, m), 0.0) if letters.any() else np.zeros(len(values))
                order = np.argsort(-share, axis=1, kind="stable")
                name = [m.languages[o[0]] if ok else "und" for o, ok in zip(order, letters, strict=True)]
                sets = [[m.languages[j] for j in o if s[j] > 0] if ok else [] for o, s, ok in zip(order, share, letters, strict=True)]
                score = np.where(letters, np.clip(share.max(axis=1), 0, 1), 0).astype(float)
                yield pa.record_batch([*[part.column(k) for k in range(len(carried))], part.column(len(carried)), pa.array(name, pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string())), pa.array(gain.astype(float))], names=[*carried, "doc_id", "lang_pred", "score", "languages", "gain"])

    return docs.select(*[F.col(f"`{n}`") for n in carried], F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).mapInArrow(freeing(run), schema)


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; of the empty text for a null id."""
    return F.pmod(F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")), F.lit(folds))


def language_id(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """Trains on all rows outside the held-out fold (crc32(id) mod 4 is 2) and predicts every row: doc_id, held_out, lang_pred, score, languages, gain.

    See ``fit`` and ``predict`` for nulls and empty tables; repeated rows are rows of their own."""
    held = fold(F.col(f"`{id_col}`"), 4) == 2
    model = fit(docs.where(~held), text_col, lang_col)
    out = predict(docs, model, text_col, id_col)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "languages", "gain")
