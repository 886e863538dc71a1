"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts by label propagation with capacities; a small classifier learns the part of a vector; it
deals every vector into one part and routes each query to its several most probable parts, where all vectors are ranked exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import freeing, materialise

#: Vectors that the partitions are learned from at most, neighbours in the graph, and vectors that one task ranks against at a time.
SAMPLE, NEIGHBOURS, BLOCK = 8_192, 10, 20_000
#: Parts: at least so many, and at most so that the sample has 64 vectors of each; between these the square root of the table's vectors over PART_ROOT.
LEAST_PARTS, PART_ROOT = 16, 8
#: Recall that the number of parts to visit is chosen for, on sample queries that the classifier didn't see.
WANTED_RECALL = 0.92
_RANKED = "row long, query_id long, vec_id long, score double"


@dataclass
class Partitioner:
    """softmax(relu(x W1 + b1) W2 + b2) over the parts; probes: parts that a query visits."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(_unit(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def balanced_parts(near: np.ndarray, parts: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Part of each node of a neighbour graph (row i: i's neighbours), each with at most 5 % above its even share.

    Grown breadth first from far seeds, then refined: nodes move to the part of most of their neighbours while there is room."""
    n = len(near)
    rng = np.random.default_rng(seed)
    room = int(np.ceil(n / parts * 1.05))
    part = np.full(n, -1)
    order = rng.permutation(n)
    p, filled, queue, at = 0, 0, [], 0
    while at < n or queue:
        if not queue:
            if part[order[at]] < 0:
                queue.append(order[at])
            at += 1
            continue
        v = queue.pop(0)
        if part[v] >= 0:
            continue
        part[v] = p
        filled += 1
        queue += [u for u in near[v] if part[u] < 0]
        if filled >= n / parts and p < parts - 1:
            p, filled, queue = p + 1, 0, []
    edges = np.concatenate([np.stack([np.repeat(np.arange(n), near.shape[1]), near.ravel()], 1), np.stack([near.ravel(), np.repeat(np.arange(n), near.shape[1])], 1)])
    for _ in range(rounds):
        votes = np.bincount(edges[:, 0] * parts + part[edges[:, 1]], minlength=n * parts).reshape(n, parts)
        gain = votes.max(axis=1) - votes[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            to = int(votes[v].argmax())
            if size[to] < room:
                size[to] += 1
                size[part[v]] -= 1
                part[v] = to
                moved += 1
        if not moved:
            break
    return part


def fit_partitions(sample: np.ndarray, parts: int = LEAST_PARTS, neighbours: int = 20, seed: int = 7) -> Partitioner:
    """From a bounded sample (rows are vectors)."""
    n, dims = sample.shape
    rng = np.random.default_rng(seed)
    parts = max(1, min(parts, n // 64))
    hidden = 64
    if parts == 1:
        return Partitioner(np.zeros((dims, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    order = rng.permutation(n)
    held, train = order[: min(256, n // 8)], order[min(256, n // 8) :]
    x = sample[train]
    near = np.concatenate([_nearest(x[s : s + 128], x, NEIGHBOURS, s) for s in range(0, len(x), 128)])
    part = balanced_parts(near, parts)
    # Targets are the parts of a vector's neighbours and its own.
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1)
    target[np.arange(len(x)), part] += near.shape[1]
    target /= target.sum(axis=1, keepdims=True)
    u = _unit(x)
    w = [rng.normal(0, dims**-0.5, (dims, hidden)) * 2, np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    step = 0
    for _ in range(12):
        for s in range(0, len(u), 512):
            rows = rng.integers(0, len(u), min(512, len(u)))
            h = np.maximum(u[rows] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            dh = (d @ w[2].T) * (h > 0)
            step += 1
            for k, g in enumerate((u[rows].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    out = Partitioner(*w, parts)
    # Visit as many parts as the wanted recall takes on vectors that were held back.
    home = out.probabilities(x).argmax(axis=1)
    rank = np.argsort(np.argsort(-out.probabilities(sample[held]), axis=1, kind="stable"), axis=1)
    true = _nearest(sample[held], x, min(neighbours, len(x) - 1), None)
    needed = rank[np.arange(len(held))[:, None], home[true]]
    for probes in range(1, parts + 1):
        if (needed < probes).mean() >= WANTED_RECALL:
            break
    out.probes = probes
    return out


def _nearest(q: np.ndarray, x: np.ndarray, k: int, own_from: int | None) -> np.ndarray:
    s = q @ x.T
    if own_from is not None:
        s[np.arange(len(q)), own_from + np.arange(len(q))] = -np.inf
    return np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k]


def usable(vector: Column) -> Column:
    """Not null, not empty, every component a finite number, not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(values: pa.Array) -> np.ndarray:
    return np.array(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(values), -1) if len(values) else np.zeros((0, 1))


def top(row: np.ndarray, query_id: np.ndarray, q: np.ndarray, vec_id: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k largest inner products of each query with other rows, ties to the smaller id, in double precision.

    A matrix product finds the candidates; their scores are summed again component by component, so equal vectors get equal scores."""
    out: list[tuple[np.ndarray, ...]] = []
    scale = np.abs(x).max(initial=0.0)
    for s in range(0, len(q), 256):
        score = q[s : s + 256] @ x.T
        score[query_id[s : s + 256, None] == vec_id[None, :]] = -np.inf
        bar = np.partition(score, max(0, score.shape[1] - k), axis=1)[:, max(0, score.shape[1] - k)] if score.shape[1] else np.zeros(len(score))
        slack = 1e-12 * scale * np.abs(q[s : s + 256]).sum(axis=1)
        for j in range(len(score)):
            pick = np.flatnonzero((score[j] >= bar[j] - slack[j]) & (score[j] > -np.inf))
            exact = (x[pick] * q[s + j]).sum(axis=1)
            best = np.lexsort((vec_id[pick], -exact))[:k]
            out.append((np.full(len(best), row[s + j]), np.full(len(best), query_id[s + j]), vec_id[pick][best], exact[best]))
    rows, ids, vecs, scores = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    return pd.DataFrame({"row": rows, "query_id": ids, "vec_id": vecs, "score": scores})


def nearest(vectors: DataFrame, queries: Column, k: int = 20, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row that ``queries`` selects, the k nearest found among all other rows.

    Rows without a usable vector (see ``usable``), without id, or of other than the commonest length take no part. Rows with a query's own id are never its
    neighbours; each row that repeats a query's id has ranks of its own. An empty table gives no rows; with fewer than 128 vectors there is one part and the search is exact."""
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"), F.monotonically_increasing_id().alias("row"))
    own = own.where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    sizes = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    own = own.where(F.size("v") == sizes["n"])
    rate = min(1 << 62, (SAMPLE << 62) // max(1, sizes["count"]))
    taken = own.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 62)) < rate).select("v").limit(2 * SAMPLE).toArrow().column("v").combine_chunks()
    sample = taken.flatten().to_numpy(zero_copy_only=False).reshape(len(taken), sizes["n"])
    model = fit_partitions(sample, max(LEAST_PARTS, round(sizes["count"] ** 0.5 / PART_ROOT)), neighbours=k)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            part = m.probabilities(_matrix(batch.column(1))).argmax(axis=1).astype(np.int32) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.record_batch([*batch.columns, pa.array(part)], names=["vec_id", "v", "is_query", "row", "part"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            probes = np.argsort(-m.probabilities(_matrix(batch.column(1))), axis=1, kind="stable")[:, : m.probes] if batch.num_rows else np.zeros((0, 1), int)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), probes.shape[1]))
            yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), batch.column(2).take(rows), pa.array(probes.ravel().astype(np.int32))], names=["query_id", "v", "row", "part"])

    index = materialise(own.mapInArrow(freeing(deal), "vec_id long, v array<double>, is_query boolean, row long, part int"), "index")
    routed = index.where("is_query").select("vec_id", "v", "row").mapInArrow(freeing(route), "query_id long, v array<double>, row long, part int")

    def blocks_of(rows: DataFrame) -> Column:
        """Into how many blocks a part's rows are cut; one number for each part, of which there are as many as the root of the table's size."""
        counts = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
        return F.element_at(F.array(*[F.lit(-(-counts.get(p, 0) // BLOCK)).cast("long") for p in range(len(model.b2))]), F.col("part") + 1)

    # A part above BLOCK rows is cut into blocks, its queries into blocks too, and each meets each: no task holds more than a block of either.
    blocks, asked = blocks_of(index), blocks_of(routed)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    index = index.withColumn("asked", asked).where("asked > 0").withColumn("block", F.pmod(F.xxhash64("row"), blocks)).withColumn("ask", each(F.col("asked")))
    routed = routed.withColumn("blocks", blocks).where("blocks > 0").withColumn("ask", F.pmod(F.xxhash64("row"), asked)).withColumn("block", each(F.col("blocks")))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"row": pd.Series(dtype="int64"), "query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return top(left["row"].to_numpy(), left["query_id"].to_numpy(), np.stack(left["v"].to_numpy()), right["vec_id"].to_numpy(), np.stack(right["v"].to_numpy()), k)

    found = routed.groupBy("part", "block", "ask").cogroup(index.select("vec_id", "v", "part", "block", "ask").groupBy("part", "block", "ask")).applyInPandas(rank, _RANKED)
    # Ranked with a limit, so each task passes on no more than k rows of a query, however many blocks it was sent to.
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
