"""Literal cases of answers, curves, run lengths, datasets, length groups, assigned tracks and their readers."""

import itertools
import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from glyphgrid.functions import answers, curve, rle
from glyphgrid.operators import datasets, ranking, sampling, spatial
from glyphgrid.sources import readers

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def test_answers(spark):
    cases = {
        "The dog's bowl, a red one?": "dog 's bowl red 1",
        "well-known": "well known",
        "- well-known": "wellknown",
        "dont go.": "don't go",
        "version 2.5. ok": "version 2.5 ok",
        ".x" * 34: "x" * 32 + ".x.x",
        "Ten\tan NONE": "10 0",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    assert {r.text: r.a for r in df.select("text", answers.answer_form(F.col("text")).alias("a")).collect()} == cases


def test_curve_ends_and_middle(spark):
    control = [0.0, 0.0, 1.0, 3.0, 2.0, 3.0, 3.0, 0.0, 3.0, 9.0, 2.0, 9.0, 1.0, 9.0, 0.0, 9.0]
    p = spark.createDataFrame([(control,)], "c array<double>").select(curve.curve_polygon(F.col("c"), 3).alias("p")).first().p
    assert [v for q in p for v in q] == pytest.approx([0, 0, 1.5, 2.25, 3, 0, 3, 9, 1.5, 9, 0, 9])
    assert spark.createDataFrame([([1.0],)], "c array<double>").select(curve.curve_polygon(F.col("c")).alias("p")).first().p is None


def test_label_order_of_upright_columns(spark):
    right, left = [(9.0, float(k)) for k in range(8)], [(0.0, float(k)) for k in range(7, -1, -1)]
    rows = spark.createDataFrame([([v for p in right + left for v in p],), (None,)], "p array<double>").select(curve.label_order("p").alias("p")).collect()
    assert rows[0].p[:2] == [0.0, 7.0] and rows[0].p[16:18] == [9.0, 0.0] and rows[1].p is None


def test_run_lengths(spark):
    rng = np.random.default_rng(1)
    cases = [[], [0, 6], [5], [3, 2, 5, 90, 4, 1, 100000, 7], *[rng.integers(0, 5000, n).tolist() for n in range(1, 20)]]
    df = spark.createDataFrame([(c,) for c in cases], "runs array<bigint>").select("runs", rle.runs_of(rle.text_of("runs")).alias("back"), rle.mask_area(F.col("runs")).alias("area"))
    for r in df.collect():
        assert r.back == r.runs and r.area == sum(r.runs[1::2])
    assert spark.createDataFrame([("06",), (None,)], "t string").select(rle.runs_of("t").alias("r")).collect()[0].r == [0, 6]


def test_length_groups_against_plain_loop(spark):
    rows = [(k, (k * 37) % 23 + 1) for k in range(53)]
    got = {r.k: (r.megabatch, r.chunk, r.slot) for r in sampling.length_grouped(spark.createDataFrame(rows, "k long, n long"), "n", ["k"], 5, 4).collect()}
    for start in range(0, 53, 20):
        block = sorted(rows[start : start + 20], key=lambda r: -r[1])
        load, held = [0] * 4, [[] for _ in range(4)]
        for i, (k, n) in enumerate(block):
            c = i % 4 if len(block) % 4 else min((c for c in range(4) if len(held[c]) < len(block) // 4), key=lambda c: load[c])
            assert got[k] == (start // 20, c, len(held[c]))
            held[c].append(k)
            load[c] += n


def test_small_assignments_make_no_array_calls(monkeypatch):
    """Frames hold a few boxes, for which a call of NumPy a step costs more than the assignment."""
    cost = np.array([[-0.9, -0.8, 1e5], [-0.9, 1e5, 1e5]])
    monkeypatch.setattr(spatial, "np", None)
    assert spatial.least_cost(cost) == [1, 0] and spatial.least_cost(cost.T) == [1, 0, -1]


def test_least_cost_against_all_assignments():
    rng = np.random.default_rng(3)
    for n, m in [(1, 1), (2, 3), (4, 2), (4, 4), (3, 5), (5, 5)]:
        for _ in range(20):
            cost = np.round(rng.normal(size=(n, m)), 1)
            got = spatial.least_cost(cost)
            made = [(r, c) for r, c in enumerate(got) if c >= 0]
            small = cost if n <= m else cost.T
            best = min(sum(small[r, c] for r, c in enumerate(p)) for p in itertools.permutations(range(max(n, m)), min(n, m)))
            assert len(made) == len({c for _, c in made}) == min(n, m) and sum(cost[r, c] for r, c in made) == pytest.approx(best)


@pytest.mark.parametrize("assign", ["first", "count", "overlap"])
def test_tracks_swap_with_their_boxes(spark, assign):
    rows = [(0, 0, 0, (101.0, 101.0, 200.0, 200.0)), (0, 0, 1, (301.0, 301.0, 450.0, 450.0)), (0, 1, 0, (302.0, 303.0, 451.0, 452.0)), (0, 1, 1, (101.0, 102.0, 201.0, 203.0))]
    df = spark.createDataFrame(rows, f"video long, frame long, idx long, box {BOX}")
    assert {r.idx: r.track for r in spatial.track(df, 600, 600, assign=assign).where("frame = 1").collect()} == {0: 1, 1: 0}


def test_far_pairs_are_made_only_by_assignment(spark):
    df = spark.createDataFrame([(0, 0, 0, (0.0, 0.0, 9.0, 9.0)), (0, 1, 0, (50.0, 50.0, 60.0, 60.0))], f"video long, frame long, idx long, box {BOX}")
    ids = lambda how: spatial.track(df, 100, 100, assign=how).where("frame = 1 and idx = 0").first().track
    assert (ids("first"), ids("count"), ids("overlap")) == (1, 0, 0)


def test_merged_categories(spark):
    rows = [(0, 1, "cat", None, True), (0, 2, "dog", 1, True), (0, 3, "fox", 9, True), (0, 9, "wolf", None, False), (1, 1, "puss", None, None)]
    out = datasets.merged_categories(spark.createDataFrame(rows, "dataset int, id int, name string, mapped_id int, listed boolean"))
    got = {(r.dataset, r.id): (r.mapped_id, r.mapped_name, r.mixed) for r in out.collect()}
    assert got == {(0, 1): (1, "puss", True), (0, 2): (1, "puss", True), (0, 3): (9, "wolf", False), (1, 1): (1, "puss", True)}


def test_kept_images_and_proposals(spark):
    kind = "image_id int, annotations array<struct<is_crowd:int,keypoints:array<int>,segmentation:array<double>>>"
    rows = [(0, [(0, [1, 1, 2], None)]), (1, [(1, None, [1.0])]), (2, []), (3, None), (4, [(None, None, [1.0])]), (5, [(0, [1, 1, 0], None)])]
    images, a = spark.createDataFrame(rows, kind), F.col("annotations")
    ids = lambda general, specific: [r.image_id for r in datasets.keep_images(images, general, specific).orderBy("image_id").collect()]
    specific = [datasets.visible_keypoints(a) >= 1, datasets.has_field(a, "segmentation")]
    assert ids(datasets.has_own_instance(a), []) == [0, 4, 5]
    assert ids(datasets.has_own_instance(a), specific) == [0, 4] and ids(None, specific) == [0, 1, 4] and len(ids(None, [])) == 6
    proposals = spark.createDataFrame([(0, 0.2, (0.0, 0.0, 1.0, 1.0)), (0, 0.9, (0.0, 0.0, 2.0, 2.0))], f"image_id int, score double, box {BOX}")
    got = {r.image_id: [p.score for p in r.proposals] for r in datasets.with_proposals(images, proposals, "image_id").collect()}
    assert got[0] == [0.9, 0.2] and got[3] == []


def test_reference_crop_ties_go_to_the_first(spark):
    kind = "image_id int, {} long, instances array<struct<text:string,x:double,y:double>>"
    crops = spark.createDataFrame([(1, 0, [("a", 0.0, 0.0), ("b", 5.0, 5.0)]), (1, 1, [("z", 0.0, 0.0)])], kind.format("crop_id"))
    refs = spark.createDataFrame([(1, k, [("a", 0.0, 10.0), ("b", 5.0, 5.0)]) for k in (7, 5)], kind.format("ref_id"))
    got = {r.crop_id: (r.ref_id, r.similarity) for r in datasets.reference_crops(crops, refs).collect()}
    assert got[0] == (5, pytest.approx(0.7 + 0.3 * 0.95)) and got[1] == (None, None)


def test_segment_quality_and_frequencies(spark):
    cats = lambda values: spark.createDataFrame([(v,) for v in values], "cat int")
    out = {r.part: r for r in datasets.segment_quality(cats([0, 0, 1]), cats([0, 2]), spark.createDataFrame([(0, 0.8)], "cat int, iou double"), [0, 1]).collect()}
    assert out["things"].pq == pytest.approx(100 * (0.8 / 1.5) / 2) and out["things"].sq == pytest.approx(40) and out["stuff"].pq == 0
    seen = spark.createDataFrame([(i, c) for c, n in ((0, 10), (1, 11), (2, 101)) for i in range(n)], "image_id int, cat int")
    assert {r.cat: r.frequency for r in ranking.frequencies(seen).collect()} == {0: "r", 1: "c", 2: "f"}


def test_lvis_and_panoptic_documents(spark, tmp_path):
    note = {"id": 1, "image_id": 7, "category_id": 3, "bbox": [0, 0, 1, 1], "area": 1.0, "segmentation": [[0, 0, 1, 0, 1, 1]]}
    image = {"id": 7, "width": 5, "height": 4, "coco_url": "http://host/train/0007.jpg"}
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"images": [image], "annotations": [note]}))
    bad.write_text(json.dumps({"images": [image], "annotations": [note | {"segmentation": [[0, 0, 1, 0]]}]}))
    images, notes = readers.lvis_document(spark, str(good), "/data/")
    assert images.first().file_name == "/data/train/0007.jpg" and images.first().neg_category_ids == [] and notes.first().category_id == 2
    with pytest.raises(PySparkException, match="invalid polygon"):
        readers.lvis_document(spark, str(bad), "/data/")[1].collect()
    pan = tmp_path / "pan.json"
    pan.write_text(json.dumps({"annotations": [{"image_id": 7, "file_name": "a.b.png", "segments_info": [{"id": 1, "category_id": 4}, {"id": 2, "category_id": 90}]}]}))
    row = readers.panoptic_document(spark, str(pan), "/i", "/l", {4: 0}, {90: 1}).first()
    assert (row.image_id, row.file_name, row.label_file) == (7, "/i/a.b.jpg", "/l/a.b.png")
    assert [(s.category_id, s.isthing) for s in row.segments] == [(0, True), (1, False)]
    with pytest.raises(PySparkException, match="neither map"):
        readers.panoptic_document(spark, str(pan), "/i", "/l", {4: 0}, {}).collect()


def test_paired_listing_and_zip(spark, tmp_path):
    for side, names in (("i", ("a.jpg", "b.jpg")), ("l", ("a.png", "c.png"))):
        (tmp_path / side).mkdir()
        for n in names:
            (tmp_path / side / n).write_bytes(b"x")
    pairs = lambda: sorted((r.file_name.rsplit("/", 1)[1], r.label_file.rsplit("/", 1)[1]) for r in readers.paired_listing(spark, str(tmp_path / "i"), str(tmp_path / "l")).collect())
    assert pairs() == [("a.jpg", "a.png"), ("b.jpg", "c.png")]
    (tmp_path / "l" / "b.png").write_bytes(b"x")
    assert pairs() == [("a.jpg", "a.png"), ("b.jpg", "b.png")]
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("res_1.txt", "one")
        z.writestr("note", "no")
    path = str(tmp_path / "s.zip")
    assert [(r.key, bytes(r.content)) for r in readers.zip_entries(spark, path, r"res_(\d+)\.txt").collect()] == [("1", b"one")]
    with pytest.raises(PySparkException, match="entry not valid"):
        readers.zip_entries(spark, path, r"res_(\d+)\.txt", all_entries=True).collect()


def test_run_length_algebra(spark):
    """Unions, intersections, overlaps and the text form of random masks, against masks place by place."""
    rng = random.Random(6)
    rows = []
    for k in range(60):
        size = rng.choice([1, 7, 60, 3000])
        masks = [[rng.random() < p for _ in range(size)] for p in (rng.choice([0, 0.1, 0.5, 1]), rng.choice([0.02, 0.5, 0.9]))]
        runs = []
        for m in masks:
            own, at = [0], False
            for x in m:
                if x != at:
                    own.append(0)
                    at = x
                own[-1] += 1
            runs.append(own)
        rows.append((k, size, *runs, [sum(a and b for a, b in zip(*masks, strict=True)), sum(a or b for a, b in zip(*masks, strict=True)), sum(masks[0])], masks))
    df = spark.createDataFrame([r[:4] for r in rows], "k int, size int, a array<bigint>, b array<bigint>")
    df = df.select("k", "size", "a", "b", *[rle.spans_of(rle.runs_of(rle.text_of(F.col(c)))).alias(f"s{c}") for c in "ab"])
    a, b = F.col("sa"), F.col("sb")
    got = df.select("k", rle.runs_of(rle.text_of("a")).alias("back"), F.col("a"), rle.overlap(a, b).alias("o"), rle.runs_of_spans(rle.union(a, b), F.col("size")).alias("u"), rle.runs_of_spans(rle.intersection(a, b), F.col("size")).alias("i"), rle.mask_iou(a, b).alias("iou"), rle.mask_iou(a, b, F.lit(True)).alias("crowd")).collect()
    for r in got:
        _, size, _, _, (both, any_, own), masks = rows[r.k]
        assert r.back == r.a and (r.o["both"], r.o["any"]) == (both, any_)
        for runs, want in ((r.u, [x or y for x, y in zip(*masks, strict=True)]), (r.i, [x and y for x, y in zip(*masks, strict=True)])):
            assert [k % 2 == 1 for k, n in enumerate(runs) for _ in range(n)] == want and 0 not in runs[1:]
        assert r.iou == (both / any_ if any_ else 0) and r.crowd == (both / own if own else 0)


def test_panoptic_rules(spark):
    """Void and crowds: a guess mostly on them counts nowhere, one on a crowd of another category is wrong; a crowd isn't missed; void places don't lower an IoU."""
    span = lambda a, b: [(a, b)]
    gt = [(1, 1, 0, False, span(0, 10)), (1, 2, None, False, span(10, 30)), (1, 3, 1, True, span(30, 60)), (1, 4, 1, False, span(60, 70)), (2, 1, 0, False, span(0, 4)), (2, 2, 0, False, [])]
    pred = [(1, 1, 0, span(0, 25)), (1, 2, 1, span(28, 40)), (1, 3, 0, span(40, 60)), (1, 4, 1, span(66, 80)), (3, 1, 1, span(0, 5)), (1, 5, 1, span(25, 28))]
    schema = "image_id int, seg int, cat int, {}spans array<struct<first:bigint,last:bigint>>"
    rows = datasets.panoptic_matches(spark.createDataFrame(gt, schema.format("crowd boolean, ")), spark.createDataFrame(pred, schema.format("")))
    assert sorted((r.cat, r.kind, r.iou) for r in rows.collect()) == [(0, "fn", None), (0, "fp", None), (0, "tp", 1.0), (1, "fn", None), (1, "fp", None), (1, "fp", None)]
    out = {r.part: (r.pq, r.sq, r.rq, r.categories) for r in datasets.panoptic_quality(rows, [0]).collect()}
    assert out == {"all": (25.0, 50.0, 25.0, 2), "things": (50.0, 100.0, 50.0, 1), "stuff": (0.0, 0.0, 0.0, 1)}


def test_exact_quantiles(spark):
    """By ranges of the value, against numpy: ties, one value, null groups, null values, all rows as one group."""
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1.0, rng.uniform(-5, 5), 2.5])) for _ in range(3000)] + [("c", 7.0), ("d", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"low": 0.0, "q": 0.25, "m": 0.5, "r": 0.977, "high": 1.0}
    got = {r.g: [r[n] for n in shares] for r in sampling.quantiles(df, ["g"], "v", shares).collect()}
    for g in ("a", "b", None, "c"):
        assert got.pop(g) == pytest.approx(list(np.quantile([v for k, v in rows if k == g and v is not None], list(shares.values()))), abs=1e-12)
    assert not got
    one = sampling.quantiles(df, [], "v", {"m": 0.5}).collect()
    assert [r.m for r in one] == [float(np.median([v for _, v in rows if v is not None]))]
    stats = sampling.with_quantiles(df.groupBy("g").count(), df, ["g"], "v", {"m": 0.5}).collect()
    assert len(stats) == 5 and {r.g: r.m for r in stats}["d"] is None
    assert "percentile" not in sampling.quantiles(df, ["g"], "v", shares)._jdf.queryExecution().toString()


def test_refused_polygons(spark):
    """Polygons of any number of points: stars cross, a notch doesn't, touching sides count as crossing; lines of spotting with odd or wrong numbers."""
    star = [(50 + 40 * np.cos(2 * np.pi * 2 * k / 5), 50 + 40 * np.sin(2 * np.pi * 2 * k / 5)) for k in range(5)]
    hexagon = [(50 + 40 * np.cos(2 * np.pi * k / 6), 50 + 40 * np.sin(2 * np.pi * k / 6)) for k in range(6)]
    notch = [(0, 0), (90, 0), (90, 90), (45, 10), (0, 90)]
    cases = [(hexagon, None), (hexagon[::-1], "counterclockwise"), (star, "crossing"), (notch, None), ([(0, 0), (90, 0), (90, 90), (45, 0), (0, 90)], "crossing"), ([(0, 0), (4, 0), (4, 4)], None), ([(0, 0), (4, 4), (4, 0)], "counterclockwise")]
    cases += [([(0, 0), (1, 1), (3, 3), (2, 2)], "line"), ([(5, 5)] * 4, "line"), ([(0, 0), (101, 0), (5, 5)], "outside"), ([(0, 0), (1, 0)], "points"), ([], "coordinates")]
    lines = [(k, ",".join(str(float(v)) for p in points for v in p) + ",####t") for k, (points, _) in enumerate(cases)] + [(90, "1,2,3,4,5,####t"), (91, "1,2,x,4,5,6,####t")]
    got = {r.k: r.refused for r in readers.checked_lines(spark.createDataFrame(lines, "k int, value string"), 100.0, 100.0).collect()}
    assert got == {k: why for k, (_, why) in enumerate(cases)} | {90: "coordinates", 91: "coordinates"}
