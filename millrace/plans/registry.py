"""Registered queries: one Spark plan and (where expressible) one DuckDB oracle each.

Every query reads the driver tables of ``sf_dir`` in full (no id subsets, no
row caps other than the top-N/tail operators whose limit *is* the feature).
Output columns are aliased identically on both sides.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans import oracle
from millrace.plans.medallion import Medallion
from millrace.session import ship_package


@dataclass
class Query:
    name: str
    build: Callable[[Medallion], DataFrame]
    sql: str | None
    doc: str = ""


REGISTRY: dict[str, Query] = {}
_MEDALLIONS: dict[tuple, Medallion] = {}


def medallion(spark: SparkSession, sf_dir: str) -> Medallion:
    """The lazily built layers for one session and data folder (cached)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    ship_package(spark)
    m = _MEDALLIONS.get(key)
    if m is None or m.spark is not spark:
        m = _MEDALLIONS[key] = Medallion(spark, sf_dir)
    return m


def comparable(df: DataFrame) -> DataFrame:
    """Decimals -> DOUBLE so both engines hand back the same Python types."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None, doc: str = ""):
    def deco(fn: Callable[[Medallion], DataFrame]):
        REGISTRY[name] = Query(name, fn, oracle.build(sql) if sql else None, doc)
        return fn
    return deco


def _load_catalog() -> None:
    import millrace.plans.catalog_queries  # noqa: F401  (registers everything)


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    _load_catalog()
    return comparable(REGISTRY[name].build(medallion(spark, sf_dir)))


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_catalog()
    return {n: (lambda spark, sf_dir, _n=n: run(_n, spark, sf_dir)) for n in REGISTRY}


def oracle_queries() -> dict[str, str]:
    _load_catalog()
    return {n: q.sql for n, q in REGISTRY.items() if q.sql}
