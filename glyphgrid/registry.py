"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import annotations, datasets, detection, documents, files, ranking, rewards, samplers, scalars, spatial, spotting, tables

PARTS = (annotations, datasets, detection, documents, files, ranking, rewards, samplers, scalars, spatial, spotting, tables)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.a4_global_prf(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for part in PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.ORACLE.items()}
