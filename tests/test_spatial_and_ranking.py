"""Literal cases of the ranked metrics, tracks, clusters, polygons and placing rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphgrid.functions import polygon
from glyphgrid.functions import text as T
from glyphgrid.operators import ranking, sampling, spatial

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def _truths(spark, rows):
    return spark.createDataFrame(rows, f"image_id long, cat long, gi long, size double, box {BOX}, crowd boolean, ignore boolean")


def _guesses(spark, rows):
    return spark.createDataFrame(rows, f"image_id long, cat long, pi long, size double, score double, box {BOX}")


def test_match_takes_counting_truth_and_reuses_crowds(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    gt = _truths(spark, [(1, 0, 0, 100.0, box, False, True), (1, 0, 1, 100.0, (0.0, 0.0, 10.0, 8.0), False, False), (2, 0, 0, 100.0, (0.0, 0.0, 50.0, 50.0), True, True)])
    pred = _guesses(spark, [(1, 0, 0, 100.0, 0.9, box), (1, 0, 1, 100.0, 0.8, box), (2, 0, 0, 100.0, 0.9, box), (2, 0, 1, 100.0, 0.8, box)])
    got = {(r.image_id, r.pi): (r.gi, r.ignored) for r in ranking.ranked_match(gt, pred, (0.5,), {"all": (0.0, 1e10)}).collect()}
    assert got == {(1, 0): (1, False), (1, 1): (0, True), (2, 0): (0, True), (2, 1): (0, True)}


def test_points_of_a_known_ranking(spark):
    box, far = (0.0, 0.0, 10.0, 10.0), (90.0, 90.0, 99.0, 99.0)
    gt = _truths(spark, [(i, 0, 0, 100.0, box, False, False) for i in range(2)] + [(5, 1, 0, 100.0, box, False, True)])
    pred = _guesses(spark, [(0, 0, 0, 100.0, 0.9, box), (0, 0, 1, 100.0, 0.8, far), (1, 0, 0, 100.0, 0.7, box)])
    areas = {"all": (0.0, 1e10)}
    points, recalls = ranking.precision_points(ranking.ranked_match(gt, pred, (0.5,), areas), ranking.positives(gt, areas), (100,), (0.5,))
    got = {(r.cat, r.point): r.precision for r in points.collect()}
    assert got[0, 0] == got[0, 50] == 1.0 and got[0, 51] == got[0, 100] == pytest.approx(2 / 3) and got[1, 0] == -1.0
    assert {r.cat: r.recall for r in recalls.collect()} == {0: 1.0, 1: -1.0}


def test_no_guesses_and_no_truths(spark):
    gt, pred = _truths(spark, [(1, 0, 0, 9.0, (0.0, 0.0, 3.0, 3.0), False, False)]), _guesses(spark, [])
    points, _ = ranking.precision_points(ranking.ranked_match(gt, pred), ranking.positives(gt))
    assert {r.precision for r in points.where("area = 'all'").collect()} == {0.0}
    assert ranking.banded_labels(gt.limit(0), _guesses(spark, [(1, 0, 0, 9.0, 0.5, (0.0, 0.0, 3.0, 3.0))])).collect() == [(1, 0, None, 0)]


def _crowded(spark):
    """Images of many boxes on a small field, with crowds, ignored truths, equal and null scores, images without truths and guesses."""
    rng, gt, pred = random.Random(11), [], []
    for i in range(60):
        for side, rows in (("g", gt), ("p", pred)):
            for k in range(rng.randrange(14)):
                x, y, w = float(rng.randrange(20)), float(rng.randrange(20)), rng.choice([20.0, 30.0, 60.0, 110.0])
                box = (x, y, x + w, y + w)
                rows.append((i, k % 2, k, w * w, box, rng.random() < 0.1, rng.random() < 0.1) if side == "g" else (i, k % 2, k, w * w, rng.choice([None, 0.1, 0.5, 0.9, rng.random()]), box))
    return _truths(spark, gt).repartition(3), _guesses(spark, pred).repartition(3)


@pytest.mark.parametrize("block", [4, 1 << 15])
def test_masks_against_rows(spark, monkeypatch, block):
    """Fates as bits give the curves that a row for each fate gives, over blocks of any size and batches that end within an image."""
    monkeypatch.setattr(ranking, "BLOCK", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        gt, pred = _crowded(spark)
        rows = ranking.ranked_match(gt, pred)
        mine, want = ranking.matched_curves(gt, pred, (1, 3, 100)), ranking.curves(rows, ranking.positives(gt), (1, 3, 100))
        flat = lambda df: {(r.most, r.cat, r.area, r.thr): (r.n, r.recall, r.precision) for r in df.collect()}
        got = flat(mine)
        assert got == flat(want) and len(got) == 240 and len({v[1] for v in got.values()}) > 20
        fates = ranking.ranked_masks(gt, pred).agg(F.sum(F.bit_count("counted")), F.sum(F.bit_count("hit")), F.count("*")).first()
        kept = rows.where("NOT ignored").agg(F.count("*"), F.count("gi")).first()
        assert tuple(fates) == (*kept, rows.count() // 40)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("block", [3, 1 << 15])
def test_envelope_against_a_loop(spark, monkeypatch, block):
    """Equal and null scores, predictions without a truth, hits that an earlier one takes at low thresholds only."""
    monkeypatch.setattr(ranking, "BLOCK", block)
    rng = random.Random(3)
    rows = [(i, k, rng.choice([None, 0.2, 0.2, 0.7, 2.0, rng.random()]), *rng.choice([(None, None), (rng.randrange(3), rng.random())])) for i in range(30) for k in range(8)]
    df = spark.createDataFrame(rows, "image_id long, pi long, score double, gi long, iou double").repartition(3)
    want = {}
    for thr in (0.3, 0.6, 0.9):
        seen, hits = set(), []
        for i, _, _, g, iou in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0], r[1])):
            hits.append(iou is not None and iou > thr and (i, g) not in seen)
            seen |= {(i, g)} if hits[-1] else set()
        precision = [sum(hits[: n + 1]) / (n + 1) for n in range(len(hits))]
        want[thr] = round(sum(max(precision[n:]) for n, h in enumerate(hits) if h) / 90, 9)
    assert {r.thr: r.ap for r in ranking.envelope_ap(df, 90, (0.3, 0.6, 0.9)).collect()} == pytest.approx(want)
    assert ranking.envelope_ap(df.limit(0), 90).collect() == []


def test_envelope_frames_grow_with_the_rows(spark, capfd):
    """A frame that reaches to the end of its group is gone through again for every row."""
    df = spark.createDataFrame([(1, 1, 0.5, 1, 0.9)], "image_id long, pi long, score double, gi long, iou double")
    ranking.envelope_ap(df, 1).explain()
    assert "UNBOUNDED FOLLOWING" not in capfd.readouterr().out.upper().replace("UNBOUNDEDFOLLOWING", "UNBOUNDED FOLLOWING")


def _inside(px, py, xs, ys):
    hit = np.zeros(px.shape, dtype=bool)
    for k in range(len(xs)):
        x1, y1, x2, y2 = xs[k - 1], ys[k - 1], xs[k], ys[k]
        if y1 != y2:
            hit ^= ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
    return hit


def test_shared_areas_against_a_grid():
    rng = np.random.default_rng(3)
    grid = (np.arange(1000) + 0.5) / 1000
    gx, gy = np.meshgrid(grid, grid)
    for n, m in ((3, 3), (4, 5), (7, 6)):
        c = [rng.random((2, k)) for k in (n, n, m, m)]
        got = polygon.shared_areas(*c)
        for row in range(2):
            a, b = _inside(gx, gy, c[0][row], c[1][row]), _inside(gx, gy, c[2][row], c[3][row])
            assert got[row] == pytest.approx([a.mean(), b.mean(), (a & b).mean()], abs=3e-3)


def test_convex_polygons_are_cut_as_the_sweep_has_them(monkeypatch):
    """Turned boxes, triangles, bow ties and arrows, either way round, sharing sides and corners; the sweep between heights is left for what isn't convex."""
    rng = np.random.default_rng(8)
    turned = lambda n: polygon.corners(np.column_stack([rng.uniform(0, 6, (n, 2)), rng.uniform(1, 6, (n, 2)), rng.choice([0, 30, 90, 45, 211], n)]))
    whole = lambda n: tuple(rng.integers(0, 4, (n, 4)).astype(float) for _ in range(2))
    for a, b in ((turned(3000), turned(3000)), (whole(3000), whole(3000)), (turned(2000), whole(2000))):
        back = rng.random((len(b[0]), 1)) < 0.5
        b = tuple(np.where(back, v[:, ::-1], v) for v in b)
        assert np.allclose(polygon._areas(*a, *b), polygon.shared_areas(*a, *b), atol=1e-9)
    one = polygon.corners(np.array([[2.0, 2.0, 2.0, 2.0, 0.0]] * 2))
    assert polygon._areas(*one, *polygon.corners(np.array([[4.0, 2.0, 2.0, 2.0, 0.0], [2.0, 2.0, 2.0, 2.0, 90.0]])))[:, 2] == pytest.approx([0.0, 4.0])
    monkeypatch.setattr(polygon, "shared_areas", lambda ax, *_: (_ for _ in ()).throw(AssertionError) if len(ax) else np.zeros((0, 3)))
    polygon._ious(*turned(100), *turned(100))


def test_polygon_iou_of_uneven_lengths_and_nulls(spark):
    square, arrow = ([0.0, 2.0, 2.0, 0.0], [0.0, 0.0, 2.0, 2.0]), ([0.0, 2.0, 2.0, 1.0, 0.0], [0.0, 0.0, 2.0, 1.0, 2.0])
    df = spark.createDataFrame([(*square, *arrow), (*square, None, None), (*square, [], [])], "a array<double>, b array<double>, c array<double>, d array<double>")
    assert [r[0] for r in df.select(polygon.polygon_iou("a", "b", "c", "d")).collect()] == [pytest.approx(0.75), None, None]


def test_turned_square_overlaps_as_an_octagon(spark):
    box = lambda t: F.struct(*[F.lit(v).alias(k) for k, v in (("cx", 0.0), ("cy", 0.0), ("w", 2.0), ("h", 2.0), ("degrees", t))])
    area = 8 * (2**0.5 - 1)
    assert spark.range(1).select(polygon.rotated_iou(box(0.0), box(45.0))).first()[0] == pytest.approx(area / (8 - area))


def test_tracks(spark):
    at = lambda x: (float(x), 0.0, float(x + 10), 10.0)
    rows = [(1, 0, 0, at(0)), (1, 0, 1, at(50)), (1, 1, 0, at(51)), (1, 1, 1, at(1)), (1, 2, 0, at(2)), (1, 3, 0, at(51)), (1, 3, 1, at(80)), (2, 0, 0, at(0))]
    df = spark.createDataFrame(rows, f"video long, frame long, idx long, box {BOX}")
    got = {(r.video, r.frame, r.idx): (r.track, r.period, r.lost) for r in spatial.track(df, 100, 100, most_lost=1).collect()}
    assert got[1, 1, 0] == (1, 2, 0) and got[1, 1, 1] == (0, 2, 0) and got[1, 2, 0] == (0, 3, 0)
    assert got[1, 2, -1] == (1, 2, 1) and got[1, 3, 0] == (1, 3, 0) and got[1, 3, 1] == (2, 1, 0) and got[2, 0, 0] == (0, 1, 0)
    assert spatial.track(df.limit(0), 100, 100).count() == 0


def test_cluster_crops(spark):
    images = [(1, 300, 300, [(10.0, 10.0, 20.0, 20.0), (30.0, 10.0, 40.0, 20.0), (250.0, 250.0, 260.0, 260.0)]), (2, 120, 100, [(0.0, 0.0, 50.0, 50.0), (1.0, 0.0, 50.0, 50.0)]), (3, 200, 200, [])]
    df = spark.createDataFrame(images, f"image_id long, width int, height int, boxes array<{BOX}>")
    got = sorted(map(tuple, spatial.cluster_crops(df, 100).collect()))
    assert got == [(1, 0, 0, 2), (1, 200, 200, 1), (2, 0, 0, 2)]


def test_cluster_crops_of_boxes_in_another_order_each_time(spark):
    """Collected boxes have no fixed order, and the operator reads its images more than once."""
    rng = random.Random(5)
    rows = []
    for i in range(40):
        corners = [(float(rng.randrange(150)), float(rng.randrange(150))) for _ in range(9)]
        rows.append((i, 240, 240, [(x, y, x + 15.0, y + 15.0) for x, y in corners]))
    df = spark.createDataFrame(rows, f"image_id long, width int, height int, boxes array<{BOX}>")
    mixed = F.udf(lambda boxes: random.SystemRandom().sample(boxes, len(boxes)), f"array<{BOX}>").asNondeterministic()
    want = sorted(map(tuple, spatial.cluster_crops(df, 100).collect()))
    assert sorted(map(tuple, spatial.cluster_crops(df.withColumn("boxes", mixed("boxes")), 100).collect())) == want and len(want) > 40


def test_places_and_shards(spark):
    df = spark.createDataFrame([(v, k) for k, v in enumerate([5, None, 5, 1, 9, 5, 1])], "v int, k int")
    got = [r.k for r in sampling.place_in_order(df, ["v", "k"], 3).orderBy("place").collect()]
    assert got == [1, 3, 6, 0, 2, 5, 4]
    assert sampling.place_in_order(df.limit(0), ["v", "k"]).count() == 0
    assert [r["count"] for r in sampling.contiguous_shards(spark.range(3), ["id"], 5).groupBy("shard").count().orderBy("shard").collect()] == [1, 1, 1]


def test_text_rules(spark):
    words = {"cat's": True, "-Ärger-": True, "ab": False, "a b c d": False, "x×yz": False, "no1e": False}
    got = {r.w: r.ok for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", T.in_dictionary(F.col("w")).alias("ok")).collect()}
    assert got == words
    df = spark.createDataFrame([("ab", "ab", [[0.9, 0.0, 0.0, 0.0], [0.0, 0.8, 0.0, 0.0]]), ("ab", "a", [[0.9, 0.0, 0.0, 0.0], [0.0, 0.8, 0.0, 0.0]]), (None, "a", None)], "a string, b string, s array<array<double>>")
    assert [r[0] for r in df.select(T.weighted_distance("abAB")("a", "b", "s")).collect()] == [0.0, pytest.approx(0.8), None]
    assert spark.range(1).select(T.until_blank_option(F.array(F.lit("x"), F.lit("NaN"), F.lit("y")))).first()[0] == ["x"]
