"""Batch job: materialise bronze once, then write silver and gold tables.

    python -m millrace.plans.jobs --source /root/testdata/sf0.1 --out <shared folder>

Bronze is written first (``write_bronze``) and every later layer reads the
written tables, which cuts the lineage at a durable boundary: a lost executor
re-reads bronze files instead of recomputing the adapters. Silver and gold
tables are full refreshes; date-keyed gold tables are partitioned by date.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from millrace.plans.medallion import Medallion
from millrace.session import clear_scratch
from millrace.sources.bronze import BronzeFolder, write_bronze
from millrace.sources.files import write_partitioned
from millrace.sources.testdata import DriverTables

SILVER = ["silver_sensor", "silver_production", "silver_maintenance", "silver_quality"]
GOLD = {"oee_daily": "Date", "ml_feature_view": "Event_Date", "factory_kpi": "Event_Date"}
BRONZE_USED = ["fact_sensor", "fact_maintenance", "fact_erp_production", "fact_quality", "dim_product",
               "dim_machine"]


def run_medallion(spark: SparkSession, source_dir: str, out: str,
                  bronze_tables: list[str] | None = None) -> dict[str, str]:
    """Write bronze, silver and gold under ``out``; returns table -> path."""
    out = out.rstrip("/")
    written = write_bronze(DriverTables(spark, source_dir), f"{out}/bronze", bronze_tables or BRONZE_USED)
    m = Medallion(spark, source_dir, bronze=BronzeFolder(spark, f"{out}/bronze"))
    for name in SILVER:
        path = f"{out}/silver/{name}"
        getattr(m, name).write.mode("overwrite").parquet(path)
        written[name] = path
    for name, day in GOLD.items():
        path = f"{out}/gold/{name}"
        write_partitioned(getattr(m, name), path, day)
        written[name] = path
    clear_scratch(spark)
    return written


def main() -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--source", required=True, help="folder with the driver parquet tables")
    ap.add_argument("--out", required=True, help="shared output folder")
    args = ap.parse_args()
    from millrace.session import get_spark
    spark = get_spark("millrace-medallion")
    print(json.dumps(run_medallion(spark, args.source, args.out)))


if __name__ == "__main__":
    main()
