"""Stored bronze layer: same gold results, date predicates prune partitions."""

from pyspark.sql import functions as F

from helpers import rows
from millrace.plans.medallion import Medallion
from millrace.sources.bronze import BronzeFolder, write_bronze
from millrace.sources.testdata import DriverTables


def test_stored_bronze_gives_same_gold_and_prunes(spark, tmp, smoke_dir):
    live = DriverTables(spark, smoke_dir)
    tables = ["fact_sensor", "fact_maintenance", "fact_erp_production", "dim_product", "dim_machine"]
    write_bronze(live, f"{tmp}/bronze", tables)
    stored = BronzeFolder(spark, f"{tmp}/bronze")
    a = Medallion(spark, smoke_dir, bronze=live)
    b = Medallion(spark, smoke_dir, bronze=stored)
    for name in ("factory_kpi", "oee_daily", "ml_feature_view"):
        assert rows(getattr(a, name)) == rows(getattr(b, name)), name
    day = stored.fact_sensor.select(F.min("event_date")).first()[0]
    q = stored.fact_sensor.where(F.col("event_date") == F.lit(day))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert q.count() == live.fact_sensor.where(F.to_date("Timestamp") == F.lit(day)).count()


def test_gold_date_filter_prunes_stored_partitions(spark, tmp, smoke_dir):
    live = DriverTables(spark, smoke_dir)
    write_bronze(live, f"{tmp}/bronze", ["fact_sensor"])
    m = Medallion(spark, smoke_dir, bronze=BronzeFolder(spark, f"{tmp}/bronze"))
    day = m.silver_sensor.select(F.max("Event_Date")).first()[0]
    kpi = m.factory_kpi.where(F.col("Event_Date") == F.lit(day))
    plan = kpi._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    ref = Medallion(spark, smoke_dir, bronze=live).factory_kpi.where(F.col("Event_Date") == F.lit(day))
    assert rows(kpi) == rows(ref)


def test_medallion_job_writes_layers(spark, tmp, smoke_dir):
    from millrace.plans.jobs import GOLD, SILVER, run_medallion
    paths = run_medallion(spark, smoke_dir, f"{tmp}/lake")
    for name in SILVER + list(GOLD):
        assert spark.read.parquet(paths[name]).count() > 0, name
    live = Medallion(spark, smoke_dir)
    kpi = spark.read.parquet(paths["factory_kpi"]).select(*live.factory_kpi.columns)
    assert rows(kpi) == rows(live.factory_kpi)


def test_bucketed_facts_join_without_exchange(spark, tmp, smoke_dir):
    from millrace.sources.bronze import write_bucketed
    live = DriverTables(spark, smoke_dir)
    write_bucketed(live, "bronze_b", f"{tmp}/bucketed", 8)
    prod, ship = spark.table("bronze_b.fact_erp_production"), spark.table("bronze_b.fact_shipments")
    j = ship.join(prod.select("Production_Order", "Product"), "Production_Order")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = j._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in p and "Exchange hashpartitioning" not in p
    assert j.count() == live.fact_shipments.join(live.fact_erp_production.select("Production_Order", "Product"),
                                                 "Production_Order").count()
