"""Sharding, BPE, language ID, search, mixing, toxicity and the pipeline on small tables."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from glyphgrid.llm import ann, bpe, language_id, mixing, sharding, toxicity

SF = "/root/testdata/sf0.001"
EDGE = [(901, None, None, None, None), (902, "", "en", "s", 0), (903, " \n", None, "é", 1), (904, "1234 5678", "en", None, 9), (904, "1234 5678", "en", None, 9), (None, "le la de et", "fr", "s", 2), (905, "ab " * 30_000, "en", "s", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, n_chars long")
    return own.unionByName(more).withColumn("size", F.lit("clash")).withColumn("fp", F.lit(1))


def test_sharding(docs):
    got = sharding.shard(docs).toPandas()
    src = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == docs.count() and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    for r in got.itertuples():
        t = src[None if np.isnan(r.doc_id) else int(r.doc_id)].encode()
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    by = got.groupby("shard")["size"].sum().reindex(range(8), fill_value=0)
    assert by.max() - by.min() <= got["size"].max() + 1


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_equal_texts_share_a_shard(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")
    n = docs.count()
    more = [(10**6 + k, f"copied text {k % 3} " * 20) for k in range(n // 8)] + [(2 * 10**6 + k, "too many for one shard") for k in range(n // 4)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = sharding.shard(docs).join(docs, "doc_id").toPandas()
    by = got.groupby("text").agg(shards=("shard", "nunique"), rows=("shard", "size"))
    assert (by["rows"] > 1).sum() > 3 and set(by.index[by["shards"] > 1]) == {"too many for one shard"}
    load = got.groupby("shard")["size"].sum().reindex(range(8), fill_value=0)
    assert load.max() - load.min() <= got["size"].max() + 1


def test_bpe(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    ref = Tokenizer.from_file(path)
    own = bpe.Tokeniser(open(path, encoding="utf-8").read())
    rng = random.Random(5)
    pool = list("abcdeinrstaaaee  'stvemld0123<|>!?.,-_ \n\t\x0b\x1c\x85 ÉéèßΣσςİıǅñü漢字한🙂👍🏽é‍ͅﬁ٣²Ⅷ")
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) for _ in range(800)]
    texts += ["<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|> x", "a" * 500, "don't we'll I'VE ''s", "", "z" * 3000]
    ids, off = own.encode_batch(texts)
    for t, a, b, d in zip(texts, off, off[1:], own.decode_batch(ids, off), strict=False):
        want = ref.encode(t, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want and d.decode() == ref.decode(want, skip_special_tokens=False), t
    src = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = bpe.bpe_encode(docs, path)
    for r in rows.collect():
        want = ref.encode(src[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids) == (len(want), want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    digest = {r.doc_id: r.decoded_sha256 for r in rows.collect()}
    for r in bpe.bpe_decode(rows, path).collect():
        assert hashlib.sha256(r.text.encode()).hexdigest() == digest[r.doc_id]


def test_bpe_of_every_character():
    """All characters of the first two planes, some of the others, next to letters, digits and marks."""
    path = public_tokenizers.path("word_bpe_49k.json")
    ref, own = Tokenizer.from_file(path), bpe.Tokeniser(open(path, encoding="utf-8").read())
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 211 == 0)]
    for s in range(0, len(chars), 8000):
        texts = [f"a{c}b 1{c} x\u0301{c}\u0323'S {c}" for c in chars[s : s + 8000]]
        ids, off = own.encode_batch(texts)
        wrong = [t for t, a, b, e in zip(texts, off, off[1:], ref.encode_batch(texts, add_special_tokens=False), strict=False) if ids[a:b].tolist() != e.ids]
        assert not wrong


def test_language_id(docs):
    got = language_id.language_id(docs).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    truth = {r.doc_id: r.lang for r in docs.where("doc_id < 900").collect()}
    own = got[got["held_out"] & (got["doc_id"] < 900)]
    assert np.mean([truth[int(r.doc_id)] == r.lang_pred for r in own.itertuples()]) > 0.95
    assert set(got[got["doc_id"].isin([901, 902, 903, 904])]["lang_pred"]) == {"und"}
    for r in own.itertuples():
        assert zlib.crc32(str(int(r.doc_id)).encode()) % 4 == 2


def test_mixture_of_two_languages(docs):
    model = language_id.fit(docs)
    rows = {lang: docs.where(F.col("lang") == lang).where("length(text) > 2000").first().text[:1500] for lang in ("en", "de")}
    both = docs.sparkSession.createDataFrame([(1, rows["en"] + " " + rows["de"])], "doc_id long, text string")
    assert set(language_id.predict(both, model).first().languages) == {"en", "de"}


def test_mixing(docs):
    got = mixing.mix(docs).toPandas()
    assert len(got) == docs.count() and (got["taken"] <= 2 * got["size"]).all() and (got["taken"] >= 0).all()
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum")).reset_index()
    by = by.sort_values("source", na_position="last")
    size, weight = by["size"].to_numpy(float), np.array([(3, 1, 2)[k % 3] for k in range(len(by))], float)
    capped = np.zeros(len(by), bool)
    while True:
        target = np.where(capped, 2 * size, (1.5 * size.sum() - 2 * size[capped].sum()) * weight / weight[~capped].sum())
        more = (target > 2 * size + 1e-9) & ~capped
        if not more.any():
            break
        capped |= more
    assert np.allclose(by["target"], target)
    assert (abs(by["taken"] - by["target"]) <= np.maximum(0.02 * by["target"], 20)).all()
    again = mixing.mix(docs).toPandas()
    assert got.fillna(-1).sort_values(list(got)).values.tolist() == again.fillna(-1).sort_values(list(got)).values.tolist()


@pytest.mark.parametrize(("blocks", "shard_documents"), [(16_384, 2_000), (64, 10), (16, 3)])
def test_mix_meets_targets_with_many_shards(spark, blocks, shard_documents):
    """More shards than blocks, parts near whole passes: still each source's words come near its target."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    got = mixing.mix(docs, blocks=blocks, shard_documents=shard_documents).toPandas()
    assert (got["taken"] <= 2 * got["size"]).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    block = got["target"].groupby(got["source"]).first().sum() / 1_000
    assert ((by["taken"] - by["target"]).abs() <= np.maximum(0.01 * by["target"], block)).all()


def test_apportionment_is_sainte_lague(spark):
    votes = [(k, float(v)) for k, v in enumerate([340, 280, 160, 60, 15, 0])]
    got = mixing.apportion(spark.createDataFrame(votes, "k long, v double").withColumn("seats", F.lit(7)).withColumn("g", F.lit(1)), ["g"], "v", "seats", ["k"], None)
    seats = [0] * len(votes)
    for _ in range(7):
        seats[max(range(len(votes)), key=lambda i: (votes[i][1] / (2 * seats[i] + 1), -i))] += 1
    assert {r.k: r.won for r in got.collect()} == dict(enumerate(seats))


def test_search(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(1500 + k, [float(v) for v in x[7]]) for k in range(30)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, [])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).toPandas()
    own = [(i, np.array(v, np.float32).astype(float)) for i, v in rows[:1530]]
    ids, m = np.array([i for i, _ in own]), np.stack([v for _, v in own])
    hits = 0
    for i in ids[ids % 20 == 0]:
        score = (m * m[i]).sum(axis=1)
        score[i] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        mine = got[got["query_id"] == i].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine["score"], score[mine["vec_id"]], atol=0)
        hits += len(set(mine["vec_id"]) & set(ids[best]))
    assert hits / (20 * len(ids[ids % 20 == 0])) >= 0.9 and set(got["query_id"]) == set(ids[ids % 20 == 0])


def _distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        last, row[0] = row[0], row[0] + 1
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@pytest.mark.parametrize("letters", ["ab", "abcé漢z"])
def test_lexicon_automaton_against_edit_distances(letters):
    """Words within the errors that a term allows, the nearest term and of these the first, by brute force."""
    rng = random.Random(len(letters))
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    terms = sorted({word(rng.randrange(1, 13)) for _ in range(60)}, key=lambda _: rng.random())
    a = toxicity.LexiconAutomaton(terms)
    words = [word(rng.randrange(0, 15)) for _ in range(1500)] + terms + [""]
    for t in terms * 12:
        w = list(t)
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = [rng.choice([*letters, "x"])] * rng.randrange(2)
        words.append("".join(w))
    want = [min((d, k) for k, t in enumerate(terms) if (d := _distance(w, t)) <= toxicity.errors_allowed(t)) if any(_distance(w, t) <= toxicity.errors_allowed(t) for t in terms) else None for w in words]
    near = a.nearest([w.encode("utf-32-le") for w in words])
    assert [divmod(x, len(terms)) if x >= 0 else None for x in near] == want
    size = np.array([len(w) for w in words])
    for _ in range(2):  # searched, then known
        got = a.match(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.cumsum(size) - size, size)
        assert got.tolist() == [w[1] if w and n else -1 for w, n in zip(want, size, strict=True)]
    assert toxicity.LexiconAutomaton([]).match(np.zeros(3, np.uint32), np.array([0]), np.array([3])).tolist() == [-1]


def test_large_lexicon():
    """Thousands of long terms take memory in proportion to their letters."""
    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(5000)})
    a = toxicity.LexiconAutomaton(terms)
    assert sum(x.nbytes for t in a.tries for x in vars(t).values() if isinstance(x, np.ndarray)) < 150 * sum(map(len, terms))
    words = [t[:3] + t[4:] + "q" for t in terms[:300]]
    assert [divmod(x, len(terms)) for x in a.nearest([w.encode("utf-32-le") for w in words])] == [(2, k) for k in range(300)]


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    more = spark.createDataFrame([(5000, None), (5001, ""), (5002, "you are an idi0t and a moronn"), (5003, 'he wrote "idiot" there'), (None, "the and")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs.select("doc_id", "text").unionByName(more), labels).collect()}
    assert len(got) == 1005 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.9
    assert got[5002].predicted == 1 and got[5003].predicted == 0 and got[5001].predicted == 0


def test_toxic_words_of_any_script_and_length(spark):
    rng = random.Random(8)
    plain = [f"{a}{b}{c}" for a in "bdgkl" for b in "aeio" for c in ("ra", "st", "mel", "ton")]
    mean = ["zut", "dégoûtant", "дурак", "غبي", "笨蛋", "ab1c", "unausstehlichunerträglichkeitswort", *(f"{x}{y}q" * 3 for x in "vwxyz" for y in "hjnprstvwxyzfghcbdmklqjpaeiou"[:28])]
    rows, marks = [], []
    for k in range(2400):
        toxic = k % 12 == 0
        words = [rng.choice(plain) for _ in range(30)]
        if toxic:
            for w in mean[: 7] + [mean[(7 + k // 12 * 15 + j) % len(mean)] for j in range(15)]:
                words.insert(rng.randrange(len(words)), w)
        rows.append((k, " ".join(words)))
        marks.append((k, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(mean) <= set(model.automaton.terms) and len(mean) > 128
    probe = spark.createDataFrame([(k, f"{w.upper()}!") for k, w in enumerate(mean[:7])], "doc_id long, text string")
    assert {r.doc_id: r.terms for r in toxicity.predict(probe, model).collect()} == {k: [w] for k, w in enumerate(mean[:7])}


@pytest.mark.parametrize("marks", ['""', "\u00ab\u00bb", "\u00bb\u00ab", "\u2039\u203a", "\u201c\u201d", "\u201e\u201c", "\u201d\u201d", "''", "\u2018\u2019", "\u201a\u2018", "\u300c\u300d"])
def test_quotation_marks(marks):
    import pyarrow as pa

    automaton = toxicity.LexiconAutomaton(["grobnik"])
    cases = [(f"he said {marks[0]}you grobnik{marks[1]} and left", True), (f"{marks[0]}grobnik{marks[1]}", True), (f"{marks[0]}yes{marks[1]} you grobnik {marks[0]}no{marks[1]}", False), ("don't be a grobnik, it's not ok", False), (f"you grobnik {marks[0]}yes{marks[1]}", False), (f"{marks[0]}a {'b ' * 20} grobnik {marks[1]}", False)]
    _, found = toxicity.hits(pa.array([t for t, _ in cases], pa.large_string()), automaton)
    assert [q for *_, q in found] == [q for _, q in cases]


def test_quoted_abuse_is_told_apart_from_labels(spark):
    """Rows that quote a term are labelled clean, rows that use it toxic: the weights are learned, and null columns, repeats and clashing names do no harm."""
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(600):
        filler = [f"word{rng.randrange(200)}" for _ in range(30)]
        kind = k % 12
        filler[rng.randrange(3, 27)] = "zorblax" if kind in (0, 1) else "\u00abzorblax\u00bb" if kind == 2 else "plain"
        rows.append((k, " ".join(filler), "x"))
        labels.append((k, int(kind in (0, 1)), None))
    docs = spark.createDataFrame([*rows, rows[0], (None, "zorblax", "x"), (10**6, "zorblax " * 40_000, None)], "doc_id long, text string, _label string")
    got = toxicity.toxicity(docs, spark.createDataFrame([*labels, labels[0], (None, 1, None), (7, None, None)], "doc_id long, toxic int, quality int")).collect()
    assert len(got) == 603
    by = {r.doc_id: r.predicted for r in got}
    assert all(by[k] == int(k % 12 in (0, 1)) for k in range(600)) and by[10**6] == 1
    none = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(none) == 603 and {r.predicted for r in none} == {0}


def test_language_stage_rejects_what_no_language_explains(spark):
    """Scripts and letter salad that no learned language makes likely go, as do texts without a letter; every other document of the corpus stays, repeats and nulls among the columns too."""
    rng = random.Random(4)
    own = spark.read.parquet(f"{SF}/documents.parquet")
    bad = [(9001, "Съешь же ещё этих мягких французских булок да выпей чаю. " * 4), (9002, "".join(rng.choice("qxzjkvw ") for _ in range(300))), (9003, "漢字仮名交じり文は日本語の表記法である。" * 5), (9004, "12 34 !!"), (9005, None)]
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in bad], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.identify_language(spark, own.unionByName(rows).unionByName(own.limit(1)), "")
    kept = [r.doc_id for r in got.collect()]
    assert not set(kept) & {i for i, _ in bad} and got.columns == corpus_pipeline.COLUMNS
    letters = {r.doc_id for r in own.collect() if any(map(str.isalpha, r.text or ""))}
    assert len(letters - set(kept)) <= 1 and len(kept) == len(set(kept)) + 1


def test_no_language_at_all(spark, docs):
    got = language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(got) == docs.count() and {(r.lang_pred, r.score, r.gain) for r in got} == {("und", 0.0, 0.0)}
    stayed = corpus_pipeline.identify_language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "")
    assert stayed.count() == sum(any(map(str.isalpha, r.text or "")) for r in docs.collect())


def test_search_with_repeated_ids_other_lengths_and_clashing_columns(spark):
    rows = [(k, [float(k % 7), float(k % 5), 1.0], k, "x") for k in range(60)] + [(20, [6.0, 4.0, 1.0], 1, None), (40, [1.0, 2.0], 1, None), (None, [1.0, 1.0, 1.0], 1, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank long, part string")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect()
    own = [(i, np.array(v)) for i, v, *_ in rows if i is not None and len(v) == 3]
    for i in {i for i, _ in own if i % 20 == 0}:
        lists = [sorted(((-float(v @ q), j) for j, v in own if j != i))[:5] for k, q in own if k == i]
        mine = sorted((r.rank, -r.score, r.vec_id) for r in got if r.query_id == i)
        assert mine == sorted((k, s, j) for x in lists for k, (s, j) in enumerate(x, 1))
    assert sum(r.query_id == 20 for r in got) == 10


def test_search_in_blocks_of_queries(spark, monkeypatch):
    """Parts cut into blocks of vectors and of queries give what one block gives."""
    df = spark.createDataFrame([(k, [float(k * k % 101), float(k * 7 % 31), float(k % 13) - 6]) for k in range(1, 400)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 3 == 0, k=7).collect()))
    monkeypatch.setattr(ann, "BLOCK", 11)
    assert sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 3 == 0, k=7).collect())) == want


def test_many_short_texts_in_a_batch():
    """Ten thousand short texts are worked on in steps of a bounded number of rows."""
    batch = language_id.pa.record_batch([language_id.pa.array([f"le chat {k}" for k in range(10_000)])], names=["text"])
    parts = list(language_id.slices(batch, "text", language_id.STEP_BYTES, language_id.STEP_ROWS))
    assert sum(p.num_rows for p in parts) == 10_000 and max(p.num_rows for p in parts) * language_id.GRAMS * 4 <= 16 << 20


def test_mixed_documents_with_clashing_names(spark, docs):
    clash = docs.withColumn("mixed_id", F.lit("a")).withColumn("times", F.lit("b")).withColumn("turn", F.lit("c"))
    out = mixing.mixed_documents(clash)
    assert out.columns == clash.columns
    rows = out.collect()
    assert {(r.mixed_id, r.times, r.turn) for r in rows} == {("a", "b", "c")}
    taken = {}
    for r in mixing.mix(docs).collect():
        if r.doc_id is not None and r.taken:
            taken[r.doc_id] = max(taken.get(r.doc_id, 0), -(-r.taken // r.size))
    repeats = {i: sum(d.doc_id == i for d in docs.collect()) for i in (904,)}
    count = {}
    for r in rows:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert {i: n // repeats.get(i, 1) for i, n in count.items() if i is not None} == taken


def test_pipeline_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, "")
        assert rows.count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    path = public_tokenizers.path("word_bpe_49k.json")
    for df in (sharding.shard(none), bpe.bpe_encode(none, path), language_id.language_id(none), mixing.mix(none), toxicity.toxicity(none, none), ann.nearest(vectors, F.lit(True))):
        assert df.count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    cur, counts = docs.select(*corpus_pipeline.COLUMNS), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, cur, SF).write.parquet(str(tmp_path / str(k)))
        cur = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert cur.columns == corpus_pipeline.COLUMNS
        counts.append(cur)
    kept = {r.doc_id for r in counts[0].collect()}
    assert not kept & {901, 902, 903, 904} and {r.doc_id for r in docs.where("doc_id < 900").collect()} <= kept
    texts = {}
    for r in counts[0].collect():
        texts.setdefault((r.text or "").encode().lower(), []).append(-1 if r.doc_id is None else r.doc_id)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in counts[1].collect()) == sorted(max(m) for m in texts.values())
    assert counts[4].count() == counts[3].count() and counts[3].count() > 0
