"""Filter audit, phrase mining and byte-level BPE on small tables, held against plain Python."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from glyphgrid.llm import byte_bpe, filter_audit, phrases

DOCS = "doc_id long, text string, lang string, quality string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _audit(rows, labels):
    """The figures by following every row through every order."""
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    lowest = {}
    for i, t, *_ in rows:
        if i is not None:
            lowest[t or ""] = min(i, lowest.get(t or "", i))
    out = defaultdict(Counter)
    for i, t, lang, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": i is not None and i > lowest[t]}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for k, f in enumerate(order):
                x = out[lang or "", order, k + 1]
                x["kept"] += not gone and not fails[f]
                x["redundant"] += gone and fails[f]
                x["unique_fails"] += fails[f] and sum(fails.values()) == 1
                if fails[f] and not gone:
                    gone = True
                    x["removed"] += 1
                    x["good_lost"] += i in good
                    x["toxic_lost"] += i in toxic
    total = Counter()
    for (part, order, k), x in out.items():
        total[part, order[k - 1]] += x["removed"]
    return {key: x + Counter() | {"shapley": total[key[0], key[1][key[2] - 1]]} for key, x in out.items()}


def test_filter_audit(spark):
    long = " ".join(f"w{k}" for k in range(230))
    rows = [
        (1, long, "en", "x"), (2, long, "en", "x"), (2, long, "fr", None), (3, long, "en", "x"), (3, long, None, "x"), (None, long, "en", "x"), (None, None, None, None), (4, None, "en", "x"), (5, "", "", "x"),
        (6, "same " * 300, "fr", "x"), (7, "A B C " + long, "en", "x"), (8, "A B C D E F G H I J " * 2 + long, "en", "x"), (9, long + " 5%", "de", "x"), (10, "é" * 50 + "\x85 " + long.replace(" ", "\x0b"), "de", "x"),
        (11, "x " * 199 + "#", "fr", "x"), (12, "x y " * 100, "fr", "x"), (13, "\x1c".join(["q"] * 400), "fr", "x"), (14, "long " * 60_000, "en", "x"), (15, "x " * 199 + "#", "en", "x"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (4, 0, 1), (None, 1, 1), (99, 1, 1), (14, 1, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("mask", F.lit("clash")).withColumn("digest", F.lit(1)).repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    want = _audit(rows, labels)
    got = filter_audit.filter_audit(docs, lab).collect()
    assert len(got) == len(want) == 600 * 4
    for r in got:
        x = want[r.part, r.filter_order, r.step]
        assert {k: v for k, v in r.asDict().items() if k not in ("part", "filter_order", "step")} == {k: x.get(k, 0) for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}, r
    assert filter_audit.filter_audit(docs.limit(0), lab).count() == 0
    assert filter_audit.filter_audit(docs, lab.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_order_audit_of_other_filters(spark):
    masks = spark.createDataFrame([("p", 3), ("p", 1), ("q", 0)], "part string, mask int")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in filter_audit.order_audit(filter_audit.mask_cells(masks), "xy").collect()}
    assert got["p", "xy", 1] == (0, 2, 0, 3) and got["p", "xy", 2] == (0, 0, 1, 1) and got["p", "yx", 1] == (1, 1, 0, 1) and got["p", "yx", 2] == (0, 1, 1, 3) and got["q", "xy", 2] == (1, 0, 0, 0)
    with pytest.raises(ValueError):
        filter_audit.order_audit(filter_audit.mask_cells(masks), "xx")


def _library(name="byte_bpe_50k.tiktoken"):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name), "rb"))}
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_byte_bpe_of_any_text(name, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 500)
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN
    ranks, ref = _library(name)
    own = byte_bpe.ByteTokeniser(ranks)
    rng = random.Random(3)
    pool = list("abst lvre''''  \n\t\r\x0b\x85\xa0\u2028\u3000 0129\u00b2\u2167\u0663.,!?-\u00e9\u6f22\u5b57\U0001f642\U0001f44d\U0001f3fd e\u0301\u200d dmLSTV\x00\x1c")
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 40))) for _ in range(6000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(0, 30))) for _ in range(2000)]
    texts += ["a" * 3000, "ab" * 2000, "!" * 999, "x'll've'd's 's '", " " * 500, "z" * 49, "<|endoftext|>", "", "q" * 33 + " " + "q" * 32]
    texts += ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (31, 32, 33, 5000)]
    for at in range(0, len(texts), 900):  # blocks of the scan begin elsewhere each time
        part = texts[at : at + 900]
        ids, off = own.encode_array(pa.array(part, pa.large_string()))
        data, to = own.decode_array(ids, off)
        for k, text in enumerate(part):
            assert ids[off[k] : off[k + 1]].tolist() == ref.encode_ordinary(text), text
            assert data[to[k] : to[k + 1]] == text.encode()


def test_scan_composes_in_any_grouping():
    rng = random.Random(1)
    for n in (0, 1, 7, 511, 512, 513, 600_000):
        symbols = byte_bpe.np.array([rng.randrange(16) for _ in range(min(n, 5000))] * (n // 5000 or 1), byte_bpe.np.uint8)
        got = byte_bpe.LANDS[byte_bpe.running(byte_bpe.ELEMENT[symbols])].tolist()
        state, want = byte_bpe.CLOSED, []
        for x in symbols.tolist():
            state = byte_bpe._step(byte_bpe.CLOSED if x >= byte_bpe.FIRST else state, x % byte_bpe.FIRST)[0]
            want.append(state)
        assert got == want


def test_byte_bpe_of_tables(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    _, ref = _library()
    more = [(901, None), (902, ""), (903, " \n"), (None, "le la"), (904, "1234 5678"), (904, "1234 5678"), (905, "ab " * 30_000), (906, "x" * 20_000), (None, None)]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    src = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
    rows = byte_bpe.byte_bpe_encode(docs, path)
    got = rows.collect()
    want = []
    for i, text in src:
        ids = ref.encode_ordinary(text)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got), key=repr) == sorted(want, key=repr)
    by = {r.doc_id: r for r in got}
    assert by[904].ends == [len(ref.decode(by[904].ids[: k + 1]).encode()) for k in range(len(by[904].ids))]
    back = byte_bpe.byte_bpe_decode(rows, path).collect()
    assert sorted((bytes(r.bytes) for r in back)) == sorted(t.encode() for _, t in src)
    odd = spark.createDataFrame([(1, [0, None, -4, 10**8, 1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [bytes(r.bytes) for r in byte_bpe.byte_bpe_decode(odd, path).sort("doc_id").collect()] == [ref.decode_bytes([0, 1]), b"", b""]
    assert byte_bpe.byte_bpe_encode(docs.limit(0), path).count() == 0


def _mined(rows, longest, least, top):
    count, words = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            count.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {k: n for k, n in count.items() if n >= least}
    out = defaultdict(list)
    for (lang, w), a in often.items():
        inside = any(g == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) and 100 * n >= 50 * a for (g, v), n in often.items())
        if len(w) > 1 and not inside:
            score, _, left, right = min((10**6 * a * a // (often[lang, w[:k]] * often[lang, w[k:]]), k, often[lang, w[:k]], often[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k, t.decode(), -a, left, right, words[lang], -score) for lang, x in out.items() for k, (score, a, t, left, right) in enumerate(sorted(x)[:top], 1))


@pytest.mark.parametrize(("longest", "least", "top", "bits"), [(3, 3, 2000, 24), (4, 2, 25, 6), (2, 5, 2000, 10)])
def test_collocations(spark, longest, least, top, bits):
    rng = random.Random(longest)
    vocabulary = ["a", "A", "b", "of", "New", "york", "é", "\u6f22", "x\x1cy", "z\x85", "\U0001f642", "\uff5a"]
    ends = [" ", "  ", "\t", ", ", ".", "\n", "\x0b", "\r ", "! ", " "] + [" "] * 15
    rows = [("".join(rng.choice(vocabulary) + rng.choice(ends) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "en", "fr", None, "", "und"])) for _ in range(60)]
    rows += [(None, "en"), ("", None), (" .,", "de"), ("the same row", "en"), ("the same row", "en"), ("the same row", "en"), ("the same row", "fr"), ("of New York " * 9000, "es"), ("a" * 5000, "es")]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("bucket", F.lit(0)).repartition(4)
    got = phrases.collocations(docs, longest, least, top, bucket_bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == _mined(rows, longest, least, top)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**14
    counts = spark.createDataFrame([("en", "x", 1, 4 * big), ("en", "y", 1, big + 1), ("en", "x y", 2, big), ("en", "y x", 2, 7), ("en", "x y x", 3, big // 2 - 1)], "lang string, phrase string, size int, a long")
    got = {r.phrase: (r.l, r.r, r.score) for r in phrases.scored(counts).collect()}
    assert got["x y"] == (4 * big, big + 1, 10**6 * big * big // (4 * big * (big + 1)))
    assert got["x y x"] == min(((4 * big, 7), (big, 4 * big)), key=lambda x: 10**6 * (big // 2 - 1) ** 2 // (x[0] * x[1])) + (min(10**6 * (big // 2 - 1) ** 2 // (4 * big * 7), 10**6 * (big // 2 - 1) ** 2 // (big * 4 * big)),)
    assert "y x" not in got
