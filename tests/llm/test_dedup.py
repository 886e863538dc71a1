"""Deduplicating operators against brute force, with nulls, empty and long texts, repeated rows, empty tables and extra columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphgrid.llm import exact_dedup, line_dedup, simhash_dedup, substring_dedup

SCHEMA = "doc_id long, text string, key string, fp int, kept string"


def _corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "né", "Oh,"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 160))) for _ in range(12)]
    texts = [None, "", "  \n\t", "a", "A", "x" * 50_000, "same " * 300]
    for k in range(60):
        own = rng.choice(base).split()
        for _ in range(rng.randrange(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(rng.choice([" ", "\n", "\x0b "]).join(own[rng.randrange(0, 20) :]))
    rows = [(k, t, "clash", 1, None) for k, t in enumerate(texts)]
    return rows + [rows[10], rows[10], (None, "a", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_corpus(), SCHEMA).repartition(3)


def _low(t):
    return (t or "").encode().lower()


def test_exact(docs):
    groups = {}
    for i, t, *_ in _corpus():
        groups.setdefault(_low(t), []).append(i)
    got = exact_dedup.exact_classes(docs).collect()
    assert len(got) == len(_corpus())
    sizes = {hashlib.sha256(t).hexdigest(): (len(m), max((i for i in m if i is not None), default=None)) for t, m in groups.items()}
    for r in got:
        assert (r.group_size, r.keep_id) == sizes[r.text_sha256]
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(list(sizes))  # one row of each group
    assert exact_dedup.exact_dedup(docs).columns == docs.columns and exact_dedup.exact_dedup(docs).count() == len(groups)


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 500, dtype=np.uint64)
    parts = [rng.choice(pool, 400) for _ in range(4)]
    own = [exact_dedup.CountingQuotientFilter.build(p, quotient_bits=5) for p in parts]
    got = Counter()
    for q in range(32):
        rest, n = exact_dedup.CountingQuotientFilter.merge_runs([f.run(q) for f in own])
        got.update({(q << 59) | int(r): int(c) for r, c in zip(rest, n, strict=True)})
    assert got == Counter(int(x) for p in parts for x in p)


def _components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("limit", [4096, 4])
def test_simhash(docs, limit):
    rows = [(i, t) for i, t, *_ in _corpus() if i is not None]
    fp = {}
    for i, t in rows:
        w = _low(t).split()
        sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in sh) for b in range(64)]
        fp[i] = sum(1 << b for b in range(64) if 2 * bits[b] > len(sh))
    comp = _components(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3])
    got = simhash_dedup.simhash_classes(docs.where("doc_id is not null"), limit=limit).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{fp[i]:016x}", comp[i]) for i, _ in rows)


def test_dense_fingerprints(spark):
    rng = np.random.default_rng(1)
    own = set()
    for base in rng.integers(0, 2**63, 3):
        for _ in range(80):
            own.add(int(base) ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 6), replace=False)))
    edges = [(r.a, r.b) for r in simhash_dedup.near_edges(spark.createDataFrame([(x,) for x in own], "fp long"), limit=8).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    assert _components(own, edges) == _components(own, [(a, b) for a in own for b in own if a < b and (a ^ b).bit_count() <= 3])


@pytest.mark.parametrize("limit", [8, 20, 41])
def test_groups_across_arrow_batches(spark, limit):
    """Keys that fill a whole buffer, at either level, must not lose links between their pieces."""
    code = [sum((k >> 4 ^ (k & x).bit_count()) % 2 << x for x in range(16)) for k in range(32)]  # eight bits apart at least
    own = [5 | (c << 32) | (9 << 48) for c in code] + [5 | ((c ^ 3) << 32) | (13 << 48) for c in code]  # partners: alike in one key of each level
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = [(r.a, r.b) for r in simhash_dedup.near_edges(spark.createDataFrame([(x,) for x in own], "fp long"), limit=limit).collect()]
    finally:
        for name, value in zip(("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"), before, strict=True):
            spark.conf.set(name, value)
    assert _components(own, edges) == _components(own, [(a, b) for a in own for b in own if a < b and (a ^ b).bit_count() <= 3])


def test_groups_keep_or_flag_each_key():
    batches = lambda n, at: iter([pa.record_batch([pa.array(np.full(at, 7)), pa.array(np.arange(at))], names=["key", "fp"]), pa.record_batch([pa.array(np.full(n - at, 7)), pa.array(np.arange(at, n))], names=["key", "fp"])])
    n = simhash_dedup.GROUP_LIMIT + 1
    assert [(on, len(k)) for on, k, _ in simhash_dedup._groups(batches(n + 5, n), n - 1)] == [(True, n - 1), (False, 6)]
    assert [(on, len(k)) for on, k, _ in simhash_dedup._groups(batches(n + 5, n), None)] == [(False, n + 5)]


@pytest.mark.parametrize(("hot", "piece"), [(256, 2048), (3, 2048), (1, 5)])
def test_similar_documents_against_brute_force(spark, monkeypatch, hot, piece):
    """Every link is a pair of Jaccard similarity 0.8 or more; of those, nearly all are found, whether their keys are hot or not, and whether tables are small enough to be broadcast (a choice of the driver) or not."""
    if piece == 5:
        monkeypatch.setattr(simhash_dedup, "BROADCAST_IDS", 0)
        monkeypatch.setattr(simhash_dedup, "BROADCAST_VALUES", 0)
    rng = random.Random(6)
    bases = [[rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(rng.randrange(3, 200))] for _ in range(40)]
    rows = [(0, None), (1, " \n"), (2, "One two"), (3, "one  TWO"), (4, "one two three")]
    for k in range(400):
        own = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(50)}"
        rows.append((5 + k, " ".join(own[rng.randrange(0, 3) :])))
    sets = {}
    for i, t in rows:
        w = _low(t).split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    comp = _components(sets, near)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, gone_id string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_classes(docs, hot_size=hot, piece=piece).collect()}
    assert set(got) == set(sets) and all(comp[i] == comp[c] for i, c in got.items())
    assert sum(got[a] == got[b] for a, b in near) >= 0.98 * len(near) and got[0] == got[1] == 0 and got[2] == got[3] == 2 != got[4]
    if hot == 256:
        kept = simhash_dedup.simhash_dedup(docs).collect()
        assert sorted(r.doc_id for r in kept) == sorted(set(got.values())) and {r.gone_id for r in kept} == {"clash"}


@pytest.mark.parametrize(("passages", "local", "held"), [(3000, 500_000, 2_000_000), (2, 40, 7), (1, 1, 2)])
def test_substring(spark, docs, passages, local, held):
    """With small limits shards are settled window by window, repeats are left to the shuffle, and groups come in pieces, across small Arrow batches."""
    words = [(i, (t or "").encode().split()) for i, t, *_ in _corpus()]
    seen = Counter(tuple(w[p : p + 35]) for _, w in words for p in range(len(w) - 34))
    want = Counter()
    for i, w in words:
        stay = [True] * len(w)
        for p in range(len(w) - 34):
            if seen[tuple(w[p : p + 35])] > 1:
                stay[p : p + 35] = [False] * 35
        kept = b" ".join(x for x, s in zip(w, stay, strict=True) if s)
        want[i, len(w), len(w) - sum(stay), hashlib.sha256(kept).hexdigest()] += 1
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before if passages == 3000 else "5")
        got = substring_dedup.substring_dedup(docs, passages=passages, local=local, held=held)
        got = got.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want


def test_suffix_automaton():
    rng = random.Random(2)
    seqs = [[b"%016d" % rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(8)]
    a = substring_dedup.SuffixAutomaton()
    for s in seqs:
        a.add(s)
    a.close()
    for size in (1, 2, 4, 7):
        count = Counter(tuple(s[p : p + size]) for s in seqs for p in range(len(s) - size + 1))
        for s in seqs:
            assert a.repeated(s, size) == [count[tuple(s[p : p + size])] > 1 for p in range(len(s) - size + 1)]


@pytest.mark.parametrize("limit", [4096, 5])
def test_lines(spark, limit):
    """With a limit of 5 nearly every key is cut into pieces, which must lose nothing."""
    rng = random.Random(3)
    docs, pool = [], ["hello world again"]
    for i in range(60):
        own = []
        for _ in range(rng.randrange(0, 5)):
            a = rng.choice(pool)
            for _ in range(rng.randrange(0, 4)):
                q = rng.randrange(len(a) + 1)
                a = a[:q] + rng.choice(["", "x", "é", "zz"]) + a[q + 1 :]
            if rng.random() < 0.4:
                a = "".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(0, 40) if rng.random() < 0.6 else rng.randrange(1, 10)))
            own.append(a)
            pool.append(a)
        docs.append((i, "\n".join(own), 5))
    docs += [(90, None, 1), (91, "", 1), (92, "\n\n", 1), (93, "y" * 20_000, 1)]
    lines = {}
    for i, t, _ in docs:
        for k, x in enumerate((t or "").split("\n")):
            if x:
                lines.setdefault(x, []).append((i, k))
    allowed = lambda a, b: (min(len(a), len(b)) >= 4) + (min(len(a), len(b)) >= 8)
    linked = [(a, b) for a in lines for b in lines if a < b and abs(len(a) - len(b)) <= allowed(a, b) and line_dedup._plain_distance(a, b) <= allowed(a, b)]
    assert any(min(len(a), len(b)) < 8 for a, b in linked)
    n = Counter(x for pair in linked for x in pair)
    comp = _components(lines, linked)
    first = {}
    for x, at in lines.items():
        first[comp[x]] = min([*at, first.get(comp[x], (10**9, 0))])
    want = {p: (len(at), n[x], first[comp[x]]) for x, at in lines.items() for p in at}
    got = line_dedup.line_classes(spark.createDataFrame(docs, "doc_id long, text string, lid int").repartition(3), limit=limit).collect()
    assert {(r.doc_id, r.line_no): (r.copies, r.n_links, (r.class_doc_id, r.class_line_no)) for r in got} == want
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.class_doc_id, r.class_line_no)) for r in got)


def _thue_morse(a, b, n):
    return "".join(b if k.bit_count() % 2 else a for k in range(n))


def test_lines_and_words_that_collide_under_polynomial_hashes(spark):
    x, y = _thue_morse("a", "b", 2048), _thue_morse("b", "a", 2048)
    got = line_dedup.line_classes(spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")).collect()
    assert {(r.copies, r.kept) for r in got} == {(1, True)}
    words = [f"w{k}" for k in range(40)]
    docs = [(1, " ".join([x, *words[:20], x])), (2, " ".join([y, *words[20:], y])), (3, " ".join([x] * 36)), (4, " ".join([y] * 36))]
    got = substring_dedup.substring_digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_removed) for r in got} == {(1, 0), (2, 0), (3, 36), (4, 36)}


def test_words_that_collide_in_blocks_of_eight_bytes(spark):
    """Words made to collide under hashes that take eight bytes at a time are told apart, and so are longer ones made of them."""
    for x, y in (("abcdefghstuvwxyz", "vtfkxxnd'2p_&TC>"), ("abcdefghstuvwxyz" + "tail", "vtfkxxnd'2p_&TC>" + "tail"), ("headhead" + "abcdefghstuvwxyz", "headhead" + "vtfkxxnd'2p_&TC>")):
        docs = [(1, " ".join([x] * 40)), (2, " ".join([y] * 20 + [x] * 20)), (3, " ".join([f"u{k}" for k in range(20)] + [x] * 20)), (4, " ".join([f"u{k}" for k in range(20)] + [y] * 20))]
        got = substring_dedup.substring_digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert {(r.doc_id, r.n_removed) for r in got} == {(1, 40), (2, 0), (3, 0), (4, 0)}


def test_line_dedup_rebuilds_every_row(spark):
    rows = [(1, "first line here\n\nsecond line here\nab"), (1, "first line here\n\nsecond line here\nab"), (None, "third line of text"), (None, "third line of texts\nfourth one stands"), (2, None), (3, ""), (4, "second line herE\nab\ncd")]
    got = line_dedup.line_dedup(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, row string").repartition(1)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, "first line here\nsecond line here\nab"), (1, ""), (None, "third line of text"), (None, "fourth one stands"), (2, ""), (3, ""), (4, "cd")])
    got = line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 12 and sum(r.kept for r in got) == 6


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for f in (exact_dedup.exact_classes, exact_dedup.exact_dedup, simhash_dedup.simhash_classes, simhash_dedup.simhash_dedup, substring_dedup.substring_digest, line_dedup.line_classes):
        assert f(none).count() == 0


@pytest.mark.parametrize("task_edges", [0, 1_000_000])
def test_components_in_one_task_and_in_rounds(spark, task_edges):
    from glyphgrid.llm._graph import connected_components

    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1200)] + [(5, 5), (7, 8), (8, 7)]
    nodes = {x for a, b in edges for x in (a, b) if a != b}
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3), task_edges=task_edges).collect()
    assert Counter((r.node, r.root) for r in got) == Counter(_components(nodes, [e for e in edges if e[0] != e[1]]).items())
    assert connected_components(spark.createDataFrame([], "a long, b long"), task_edges=task_edges).count() == 0
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame(edges, "a long, b long"), max_rounds=1, task_edges=0)
