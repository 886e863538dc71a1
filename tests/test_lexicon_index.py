"""Nearest lexicon words found by deletions, against edit distances of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from glyphgrid.operators import spotting


def _distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        last, row[0] = row[0], row[0] + 1
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def _word(rng, most):
    return "".join(rng.choice("abAé漢-") for _ in range(rng.randrange(most)))


@pytest.mark.parametrize(("keyed", "block"), [(True, 512), (False, 512), (True, 3), (False, 3)])
def test_nearest_word(spark, monkeypatch, keyed, block):
    """Ties go to the first; empty, long, far, repeated and null words, keys without a lexicon, null keys."""
    monkeypatch.setattr(spotting, "BLOCK", block)
    rng = random.Random(block + keyed)
    lexicon = [(rng.randrange(3), k, _word(rng, 9)) for k in range(60)] + [(0, 60, "a" * 45), (1, 61, None), (None, 62, "ab"), (2, 63, "b" * 41)]
    words = [(k % 5 if k % 11 else None, _word(rng, 12), "x") for k in range(150)] + [(0, None, "x"), (0, "a" * 44, "x"), (1, "", "x"), (2, "b" * 39, "x"), (2, "b" * 40 + "c", "x"), (0, "Ab", "x"), (0, "Ab", "x"), (0, "zzzzzzzzzzzzzzzz", "x")]
    own = spark.createDataFrame(lexicon, "k int, ord int, word string")
    rows = spark.createDataFrame(words, "k int, word string, shown string").repartition(3)
    got = spotting.nearest_word(rows, own if keyed else own.where("k IS NOT NULL").drop("k"), "k" if keyed else None, "word")

    def best(k, w):
        if w is None or (keyed and k is None):
            return None, None
        near = min(((_distance(x.upper(), w.upper()), o, x) for j, o, x in lexicon if x is not None and j is not None and (j == k or not keyed)), default=None)
        return (near[2], near[0]) if near else (None, None)

    want = sorted(((k, w, s, *best(k, w)) for k, w, s in words), key=repr)
    assert sorted(map(tuple, got.select("k", "word", "shown", "match", "distance").collect()), key=repr) == want
    cut = spotting.nearest_word(rows.withColumn("match", F.lit(1)), own if keyed else own.where("k IS NOT NULL").drop("k"), "k" if keyed else None, "word", keep_far=False).collect()
    assert all((r.match is None) == (r.distance is None or r.distance >= 2.5) for r in cut) and len(cut) == len(words)
    assert got.limit(0).count() == 0 and spotting.nearest_word(rows, own.limit(0), "k", "word").where("match IS NOT NULL").count() == 0


def test_deletions(spark):
    got = spark.createDataFrame([("abc",), ("",), ("aa",)], "w string").select(*[F.array_sort(spotting.deletions(F.col("w"), n)).alias(f"d{n}") for n in range(3)]).collect()
    assert [list(r) for r in got] == [[["abc"], ["ab", "abc", "ac", "bc"], ["a", "ab", "abc", "ac", "b", "bc", "c"]], [[""], [""], [""]], [["aa"], ["a", "aa"], ["", "a", "aa"]]]
