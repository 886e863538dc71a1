"""Every query with SQL against DuckDB on the smallest tables, and literal cases of the operators."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphgrid import registry
from glyphgrid.functions import box as B
from glyphgrid.functions import text as T
from glyphgrid.operators import curation, matching, metrics, sampling, selector
from glyphgrid.sources import readers, sinks
from glyphgrid.streaming import events

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    mine, sql = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(sql.columns) and _rows(mine) == _rows(sql)


def test_iou_cases(spark):
    boxes = [(0, 0, 1, 1), (0, 0, 0.5, 1), (0, 0, 1, 0.5), (0, 0, 0.5, 0.5), (0.5, 0.5, 1, 1), (0.5, 0.5, 1.5, 1.5)]
    df = spark.createDataFrame([tuple(map(float, b)) for b in boxes], "x1 double, y1 double, x2 double, y2 double")
    one, b = B.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1)), F.struct("x1", "y1", "x2", "y2")
    rows = df.select(B.iou(one, b).alias("iou"), B.ioa(one, b).alias("ioa")).collect()
    assert [r.iou for r in rows] == pytest.approx([1, 0.5, 0.5, 0.25, 0.25, 0.25 / 1.75])
    assert [r.ioa for r in rows] == pytest.approx([1, 1, 1, 1, 1, 0.25])


@pytest.mark.parametrize("gt, pred, matched, want", [(2206, 2129, 1546, 0.7133), (2206, 3355, 1354, 0.4870)])
def test_published_arithmetic(spark, gt, pred, matched, want):
    row = metrics.rates(spark.createDataFrame([(gt, pred, matched)], "num_gt long, num_pred long, num_matched long")).first()
    assert round(row.f1, 4) == want


def test_repeat_factors_and_shards(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "image int, cat int")
    got = {r.image: r.factor for r in sampling.repeat_factors(df, "image", "cat", 0.75).collect()}
    assert got == pytest.approx({0: 1.5**0.5, 1: 1.0})
    sizes = sampling.contiguous_shards(spark.range(42), ["id"], 4).groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in sizes] == [11, 11, 10, 10]


def test_text_cases(spark):
    df = spark.createDataFrame([("ﬁne  Day ", "/a/b c.d.jpg")], "a string, p string")
    row = df.select(T.normalise(F.col("a")).alias("n"), T.safe_stem(F.col("p")).alias("s"), T.casefold(F.lit("Straße")).alias("c"), T.ctc_decode(F.array(*map(F.lit, (1, 1, 0, 1, 2, 2)))).alias("t")).first()
    assert (row.n, row.s, row.c, row.t) == ("fine Day", "b_c.d", "strasse", [1, 1, 2])


def test_greedy_ties_go_to_the_larger_index(spark):
    pairs = spark.createDataFrame([(1, 0, 0, 0.5), (1, 1, 1, 0.5), (1, 0, 1, 0.5), (1, 1, 0, 0.5)], "image_id long, gi long, pi long, iou double")
    assert {(r.gi, r.pi) for r in matching.greedy_match(pairs).collect()} == {(1, 1), (0, 0)}


def test_diverse_top(spark):
    crops = spark.createDataFrame([(1, k, float(s), (float(x), 0.0, float(x + 10), 10.0), m) for k, s, x, m in ((0, 9, 0, [1]), (1, 8, 1, [2]), (2, 7, 50, [1]), (3, 6, 80, [3]))], "image int, crop_id long, score double, box struct<x1:double,y1:double,x2:double,y2:double>, members array<int>")
    assert [r.crop_id for r in curation.diverse_top(crops, "image", 3, 0.3).orderBy("place").collect()] == [0, 3]


def test_selector(spark):
    df = spark.createDataFrame([(-5, "x"), (7, "y"), (20, "x")], "a int, b string")
    assert [r.a for r in selector.select(df, "a:int=5-30,b=x").collect()] == [20]
    assert [r.a for r in selector.select(df, "a:int=-5").collect()] == [-5]
    assert selector.select(df, "*").count() == 3


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"images": [{"file_name": "a", "width": 4}], "annotations": [{"id": 1, "file_name": "a", "bbox": [1, 2, 3, 4]}]}')
    images, notes = readers.detection_document(spark, str(tmp_path / "d.json"))
    assert images.first().width == 4 and notes.first().bbox == [1, 2, 3, 4]
    (tmp_path / "l.txt").write_text("# no\nimg1,x\n\nimg2\n")
    assert [r.image_id for r in readers.id_filter(spark, str(tmp_path / "l.txt")).collect()] == ["img1", "img2"]
    sinks.write_csv(notes.select("id", "bbox"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().bbox.startswith("[1.0")
    sinks.write_shards(spark.range(10), str(tmp_path / "shards"), 4)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 10


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = events.windowed(events.read_events(spark, str(tmp_path / "in"), source.schema), late="3650 days")
    q = stream.writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hourly").count() == registry.queries()["x_hourly_events"](spark, SF).count()
