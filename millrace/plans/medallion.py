"""Bronze -> silver -> gold wiring for one data folder.

Nothing materialises until an action: each property is a lazy DataFrame, so a
gold result is one Catalyst plan from the parquet scans up, with column pruning
and filter pushdown reaching the files.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import gold, silver
from millrace.sources.testdata import DriverTables


class Medallion:
    def __init__(self, spark: SparkSession, sf_dir: str, bronze: DriverTables | None = None):
        self.spark = spark
        self.bronze = bronze or DriverTables(spark, sf_dir)

    # silver
    @cached_property
    def silver_sensor(self) -> DataFrame:
        return silver.silver_sensor(self.bronze.fact_sensor)

    @cached_property
    def silver_production(self) -> DataFrame:
        return silver.silver_production(self.bronze.fact_erp_production, self.bronze.dim_product)

    @cached_property
    def silver_maintenance(self) -> DataFrame:
        return silver.silver_maintenance(self.bronze.fact_maintenance)

    @cached_property
    def silver_quality(self) -> DataFrame:
        return silver.silver_quality(self.bronze.fact_quality)

    # gold
    @cached_property
    def machine_downtime(self) -> DataFrame:
        return gold.machine_downtime(self.silver_maintenance)

    @cached_property
    def daily_production(self) -> DataFrame:
        return gold.daily_production(self.silver_production)

    @cached_property
    def oee_daily(self) -> DataFrame:
        return gold.oee_daily(self.daily_production, self.machine_downtime)

    @cached_property
    def oee_daily_exact(self) -> DataFrame:
        return gold.oee_daily_exact(self.daily_production, self.machine_downtime)

    @cached_property
    def daily_sensors(self) -> DataFrame:
        return gold.daily_sensors(self.silver_sensor)

    @cached_property
    def ml_feature_view(self) -> DataFrame:
        return gold.ml_feature_view(self.daily_sensors, self.silver_maintenance)

    @cached_property
    def ml_feature_view_dedup(self) -> DataFrame:
        return gold.ml_feature_view_dedup(self.daily_sensors, self.silver_maintenance)

    @cached_property
    def factory_kpi(self) -> DataFrame:
        return gold.factory_kpi(self.silver_sensor)

    def register_views(self, prefix: str = "") -> None:
        """Expose silver and gold as temp views (CREATE OR REPLACE VIEW)."""
        for name in ("silver_sensor", "silver_production", "silver_maintenance",
                     "silver_quality", "oee_daily", "ml_feature_view", "factory_kpi"):
            getattr(self, name).createOrReplaceTempView(prefix + name)
