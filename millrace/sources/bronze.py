"""Stored bronze layer: write the bronze tables once, read them many times.

``write_bronze`` persists every bronze table as parquet under one folder;
``fact_sensor`` (the largest table) is partitioned by event date so that date
predicates prune whole folders (``PartitionFilters`` in the scan). Each table
is a full refresh. ``BronzeFolder`` reads them back with the registry schema
and offers the same attributes as ``DriverTables``, so ``Medallion`` runs on
either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.schemas import SCHEMAS
from millrace.sources.files import write_partitioned

PARTITIONED = {"fact_sensor": "event_date"}


def write_bronze(source, out: str, tables: list[str] | None = None, files_per_value: int | None = None) -> dict[str, str]:
    """Write ``source.table(name)`` for each bronze table to ``out/<name>``; partitioned tables with
    as many files a day as its bytes ask for, or ``files_per_value``."""
    written = {}
    for name in tables or list(SCHEMAS):
        df = source.table(name)
        path = f"{out.rstrip('/')}/{name}"
        part = PARTITIONED.get(name)
        if part:
            df = df.withColumn(part, F.to_date("Timestamp"))
        write_partitioned(df, path, part, files_per_value=files_per_value)
        written[name] = path
    return written


class BronzeFolder:
    """Bronze tables stored by ``write_bronze``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}")
        cols = [f.name for f in SCHEMAS[name].fields]
        part = PARTITIONED.get(name)
        return df.select(*cols, part) if part else df.select(*cols)

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.table(name)
        raise AttributeError(name)


# Fact tables joined to each other on the same key; bucketing both by that key
# (same bucket count) lets the join read matching buckets without a shuffle.
CO_LOCATED = {"fact_erp_production": "Production_Order", "fact_shipments": "Production_Order"}


def write_bucketed(source, database: str, path: str, buckets: int,
                   tables: dict[str, str] | None = None) -> list[str]:
    """Store fact tables bucketed and sorted by their join key as external
    catalog tables under ``path`` (bucket specs live in the catalog)."""
    spark = source.spark
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    names = []
    for name, key in (tables or CO_LOCATED).items():
        full = f"{database}.{name}"
        # dealt by the bucket key first, so that every bucket is one file, not one per task
        (source.table(name).repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
         .option("path", f"{path.rstrip('/')}/{name}").saveAsTable(full))
        names.append(full)
    return names
