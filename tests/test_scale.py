"""Plans and layouts that keep the largest task and the bytes written small; the rows stay those of the plain form."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from helpers import rows
from millrace.operators import gold, joins
from millrace.operators import operations as O
from millrace.plans import q_files
from millrace.plans.registry import medallion
from millrace.schemas import SCHEMAS
from millrace.sources import files as S

DAY = dt.date(1999, 1, 5)


@pytest.fixture()
def fixed_plans(spark):
    """Plans as they are made before anything has run."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def production(spark, n=8):
    recs = [(f"O{i}", "P-1", 10 * i, 9, 1, "e", "Night" if i % 2 else "Morning", dt.datetime(1999, 1, 5 + i % 2, 6),
             dt.datetime(1999, 1, 6, 6), "Plant 0" if i % 3 else None, None) for i in range(n)]
    return spark.createDataFrame(recs, SCHEMAS["fact_erp_production"])


# ---------------------------------------------------------------- oee_daily


def test_oee_daily_makes_the_rows_of_one_day_in_several_tasks(spark, fixed_plans):
    made = [(DAY, f"P-{i}", 10 + i % 3, 9, 8, 1) for i in range(40)] + [(dt.date(1999, 2, 1), "P-1", 0, 0, 0, 0), (None, None, 5, 5, 5, 0)]
    prod = spark.createDataFrame(made, "Prod_Date date, Product_ID string, Planned_Qty long, Actual_Qty long, Good_Qty long, Scrap_Qty long")
    down = spark.createDataFrame([(f"M{i}", DAY, float(1 + i % 2)) for i in range(30)] + [("M", DAY, None), (None, None, 2.0)],
                                 "Machine_ID string, Maintenance_Date date, Total_Downtime double")
    md = down.select("Maintenance_Date", "Total_Downtime")
    plain = gold.oee_scores(prod.join(md, prod["Prod_Date"] == md["Maintenance_Date"], "left"), F.coalesce("Total_Downtime", F.lit(0.0)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = gold.oee_daily(prod, down)
        assert out.columns == plain.columns
        assert rows(out) == rows(plain) and out.count() == 40 * 31 + 2
        assert out.where(F.col("Date") == DAY).select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# ------------------------------------------------- few keys: factory, factory-day


def test_star_join_does_not_deal_the_facts_by_factory(spark, fixed_plans):
    tables = {"fact_erp_production": production(spark),
              "dim_factory": spark.createDataFrame([("Plant 0", "a", "x"), ("Plant 0", "b", "y"), ("Plant 9", "c", "z")], SCHEMAS["dim_factory"])}
    out = joins.star_join("fact_erp_production", tables.get, [("__factory", "dim_factory", "Factory")])
    assert "SortMergeJoin" not in plan(out) and "Exchange hashpartitioning" not in plan(out)
    got = rows(out, "Production_Order", "__factory__Type", "__factory__Location")
    assert got == sorted([(f"O{i}", *t) for i in range(8) for t in ([("a", "x"), ("b", "y")] if i % 3 else [(None, None)])], key=repr)


def test_expected_output_and_scrap_do_not_deal_the_orders_by_factory(spark, fixed_plans):
    log = spark.createDataFrame([(DAY, "M0"), (DAY, "M0"), (None, "M1")], "Date date, Machine string")
    machines = spark.createDataFrame([("M0", "Plant 0"), ("M1", "Plant 0"), ("M2", None)], "Machine string, Factory string")
    out = O.expected_output(production(spark), log, machines)
    assert "SortMergeJoin" not in plan(out) and "Exchange hashpartitioning" not in plan(out)
    got = {r["Production_Order"]: (r["Uptime_Factor"], r["Expected_Output"]) for r in out.collect()}
    assert got["O2"] == (0.5, 9) and got["O1"] == (1.0, 8) and got["O3"] == (1.0, 25) and len(got) == 8
    staff = spark.createDataFrame([("e", "Operator")], "Employee string, Role string")
    scrap = O.expected_scrap(production(spark), staff, O.failed_machines(log, machines))
    assert "_ff" not in "".join(line for line in plan(scrap).splitlines() if "SortMergeJoin" in line)
    rates = {r["Production_Order"]: round(r["Scrap_Rate"], 3) for r in scrap.collect()}
    assert rates["O2"] == 0.054 and rates["O1"] == 0.036 and len(rates) == 8


# ------------------------------------------------------------ bom_part_demand


def test_part_demand_is_summed_after_the_rows_are_dealt(spark, fixed_plans):
    produced = spark.createDataFrame([("A", DAY, 2), ("B", DAY, 3), ("B", DAY, None), ("C", DAY, 5), (None, DAY, 7)], "Product string, Date date, Units long")
    bom = spark.createDataFrame([("A", {"x": 2, "y": 1}), ("B", {"x": 10}), (None, {"x": 1})], "Product string, bom map<string,bigint>")
    out = O.bom_explosion(produced, bom)
    assert rows(out) == [("x", DAY, 34), ("y", DAY, 2)]
    lines = plan(out).splitlines()
    dealt = next(i for i, line in enumerate(lines) if "hashpartitioning(Part" in line)
    assert not any("HashAggregate" in line for line in lines[dealt:])


# --------------------------------------------------------------- csv_bulk_load


def test_bulk_load_writes_good_lines_once_and_bad_lines_to_quarantine(spark, tmp):
    with open(f"{tmp}/dim_supplier.csv", "w") as f:
        f.write("Supplier,Delivery Time,Quality Score\na,3,1.5\nb,x,2.5\nc,,\n")
    with open(f"{tmp}/dim_customer.csv", "w") as f:
        f.write("Customer,Type\nk,retail\n")
    assert S.bulk_load(spark, tmp, f"{tmp}/out") == {"dim_supplier": 2, "dim_customer": 1}
    assert rows(spark.read.parquet(f"{tmp}/out/dim_supplier")) == [("a", 3, 1.5), ("c", None, None)]
    assert rows(spark.read.parquet(f"{tmp}/out/_quarantine/dim_supplier")) == [("b,x,2.5", "bad Delivery_Time")]
    empty = spark.read.parquet(f"{tmp}/out/_quarantine/dim_customer")
    assert empty.columns == ["line", "reason"] and empty.count() == 0
    assert S.list_names(spark, f"{tmp}/out") == ["_quarantine", "dim_customer", "dim_supplier"]


def test_the_feed_is_written_packed_and_read_whole(spark, tmp, smoke_dir):
    m = medallion(spark, smoke_dir)
    path = q_files._sensor_csv(m, tmp)
    parts = [n for n in os.listdir(path) if n.startswith("part-")]
    assert parts and all(n.endswith(".csv.gz") for n in parts)
    assert S.csv_scan_flagged(spark, path, "fact_sensor").count() == m.bronze.fact_sensor.count()
