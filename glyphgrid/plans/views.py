"""Detection tables derived from the order lines: an image is an order, a box is a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import box as B

KEYS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]

#: The same tables for the SQL of the driver.
SQL = """lines AS (SELECT l_orderkey, l_partkey, l_suppkey, l_discount, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS o FROM lineitem),
gt AS (SELECT l_orderkey AS image_id, o AS gi, 'w' || (l_partkey % 1000) AS text, l_discount AS score, (l_partkey*7%120)::DOUBLE AS x1, (l_suppkey*13%120)::DOUBLE AS y1, (l_partkey*7%120+40)::DOUBLE AS x2, (l_suppkey*13%120+30)::DOUBLE AS y2 FROM lines),
pred AS (SELECT l_orderkey AS image_id, o AS pi, 'w' || ((l_partkey + o%3) % 1000) AS text, l_discount AS score, (l_partkey*7%120+o%9)::DOUBLE AS x1, (l_suppkey*13%120+o%7)::DOUBLE AS y1, (l_partkey*7%120+40+o%5)::DOUBLE AS x2, (l_suppkey*13%120+30)::DOUBLE AS y2 FROM lines WHERE o%4 <> 0)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(*KEYS)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *KEYS).withColumn("o", F.row_number().over(order).cast("long")).select("l_orderkey", "l_partkey", "l_suppkey", "l_discount", "o")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, gi, text, score, box."""
    x, y = F.col("l_partkey") * 7 % 120, F.col("l_suppkey") * 13 % 120
    return lines(spark, sf_dir).select(F.col("l_orderkey").alias("image_id"), F.col("o").alias("gi"), F.concat(F.lit("w"), F.col("l_partkey") % 1000).alias("text"), F.col("l_discount").alias("score"), B.box(x, y, x + 40, y + 30).alias("box"))


def guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, pi, text, score, box: jittered boxes, every fourth line missing."""
    x, y, o = F.col("l_partkey") * 7 % 120, F.col("l_suppkey") * 13 % 120, F.col("o")
    return lines(spark, sf_dir).where(o % 4 != 0).select(F.col("l_orderkey").alias("image_id"), o.alias("pi"), F.concat(F.lit("w"), (F.col("l_partkey") + o % 3) % 1000).alias("text"), F.col("l_discount").alias("score"), B.box(x + o % 9, y + o % 7, x + 40 + o % 5, y + 30).alias("box"))
