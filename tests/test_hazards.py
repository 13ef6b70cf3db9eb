"""Hand-made golden rows for the semantic hazards and edge cases."""

import datetime as dt

import pytest

from pyspark.sql import Row
from pyspark.sql import functions as F

from helpers import rows
from millrace.functions import (
    event_time, half_up, hash_unit, minute_diff, null_greatest, null_least, risk_band, safe_div,
    status_colour, three_phase_current, uid,
)
from millrace.operators import gold, silver
from millrace.operators.operations import inspection_coverage
from millrace.schemas import SCHEMAS
from millrace.sources.testdata import conform

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def sensor_rows(spark, recs):
    df = spark.createDataFrame([Row(**r) for r in recs])
    return conform(df, "fact_sensor")


def test_silver_sensor_text_timestamps_and_sentinels(spark):
    raw = spark.createDataFrame(
        [("2024-01-01 10:00:00", "plant a", "line 1", "m-00001", 20.005, 0.125, "None", "Running"),
         ("not a time", "plant a", "line 1", "m-00001", 21.0, 0.5, "E101", "Warning"),
         (None, "plant a", "line 1", "m-00001", 22.0, 0.5, "None", "Running")],
        "Timestamp string, Factory string, Production_Line string, Machine string, "
        "Temperature double, Vibration double, Error_Code string, Running_Status string")
    raw = raw.select("*", *[F.lit(None).cast(t).alias(c) for c, t in
                            [("Power_Consumption", "double"), ("RPM", "double"), ("Mode", "string")]])
    out = silver.silver_sensor(raw)
    got = {r["Temp_Celsius"]: r for r in out.collect()}
    assert len(got) == 2                                  # NULL raw timestamp dropped (H1/P4)
    good = [r for r in got.values() if r["Event_Time"] is not None][0]
    assert good["Event_Time"] == dt.datetime(2024, 1, 1, 10, 0)
    assert good["Factory_ID"] == "PLANT A" and good["Machine_ID"] == "M-00001"   # F1
    assert str(good["Vibration_Hz"]) == "0.13"           # decimal(10,2) half-up (F4)
    assert good["Error_Code"] is None                     # 'None' sentinel -> NULL (H7/P5)
    bad = [r for r in got.values() if r["Event_Time"] is None][0]
    assert bad["Error_Code"] == "E101" and bad["Event_Date"] is None


def test_null_propagating_least_greatest(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "a double, b double")
    out = df.select(null_least("a", "b").alias("l"), null_greatest("a", "b").alias("g")).collect()
    assert (out[0]["l"], out[0]["g"]) == (1.0, 2.0)
    assert (out[1]["l"], out[1]["g"]) == (None, None)   # H8: warehouse returns NULL


def test_minute_boundary_difference(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1, 10, 0, 59), dt.datetime(2020, 1, 1, 10, 1, 0)),
                                (dt.datetime(2020, 1, 1, 22, 0), dt.datetime(2020, 1, 2, 6, 0))],
                               "s timestamp_ntz, e timestamp_ntz")
    assert [r[0] for r in df.select(minute_diff("s", "e")).collect()] == [1, 480]   # H9, H16


def test_half_up_rounding(spark):
    df = spark.createDataFrame([(1.005,), (0.285,), (2.5,), (0.125,)], "x double")
    got = [r[0] for r in df.select(half_up("x", 2)).collect()]
    assert got[2] == 2.5 and got[3] == 0.13
    assert [r[0] for r in df.select(half_up("x", 0)).collect()][2] == 3.0


def test_safe_division_and_iff(spark):
    df = spark.createDataFrame([(1, 0), (3, 4)], "a int, b int")
    assert [r[0] for r in df.select(safe_div("a", "b")).collect()] == [None, 0.75]   # H12


def test_maintenance_keeps_positive_downtime(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "M-1", 0.0), (dt.date(2024, 1, 1), "M-1", None),
                                (dt.date(2024, 1, 1), "M-1", 30.0), (dt.date(2024, 1, 1), "M-2", 2.0)],
                               "Date date, Machine string, Downtime double")
    df = conform(df, "fact_maintenance")
    sm = silver.silver_maintenance(df)
    assert sorted(r["Downtime_Hours"] for r in sm.collect()) == [2.0, 30.0]


def _oee_inputs(spark, prod, downtime):
    p = spark.createDataFrame(prod, "Prod_Date date, Product_ID string, Planned_Qty long, Actual_Qty long, "
                                    "Good_Qty long, Scrap_Qty long")
    d = spark.createDataFrame(downtime, "Machine_ID string, Maintenance_Date date, Total_Downtime double")
    return p, d


def test_oee_fan_out_and_guards(spark):
    day = dt.date(2024, 1, 1)
    p, d = _oee_inputs(spark, [(day, "P1", 0, 0, 0, 0), (day, "P2", 100, 120, 110, 10),
                               (dt.date(2024, 1, 2), "P3", 10, 5, 5, 0)],
                       [("M-1", day, 30.0), ("M-2", day, 6.0)])
    out = gold.oee_daily(p, d)
    assert out.count() == 5                                # H2: product-day x machines down that day
    r = {(x["Date"], x["Downtime_Hours"], x["Planned_Qty"]): x for x in out.collect()}
    z = r[(day, 30.0, 0)]
    assert (z["Availability_Pct"], z["Performance_Pct"], z["Quality_Pct"], z["OEE_Score"]) == (0.0, 0.0, 0.0, 0.0)
    q = r[(day, 6.0, 100)]
    assert q["Availability_Pct"] == 0.75 and q["Performance_Pct"] == 1.0 and q["Quality_Pct"] == 0.92
    assert q["OEE_Score"] == round(0.75 * 1.0 * (110 / 120), 4)
    n = r[(dt.date(2024, 1, 2), 0.0, 10)]
    assert n["Machine_ID"] == "M-00001" and n["Availability_Pct"] == 1.0
    assert gold.oee_daily_exact(p, d).count() == 3
    assert all(0 <= x["OEE_Score"] <= 1 for x in out.collect())


def test_ml_feature_view_repeats_per_log(spark):
    day = dt.date(2024, 1, 1)
    daily = spark.createDataFrame([("M-1", day, 1.0, 1.0, 1.0, 1.0, 1.0)],
                                  "Machine_ID string, Event_Date date, Avg_Temp double, Max_Temp double, "
                                  "Avg_Vibration double, Max_Vibration double, Avg_Power double")
    logs = spark.createDataFrame([(day, "M-1", "F1", "High"), (day, "M-1", "F2", "Critical")],
                                 "Maintenance_Date date, Machine_ID string, Failure_Mode string, Severity string")
    assert gold.ml_feature_view(daily, logs).count() == 2          # H3
    d = gold.ml_feature_view_dedup(daily, logs).collect()
    assert len(d) == 1 and d[0]["Failure_Count"] == 2 and d[0]["Severity"] == "Critical"


def test_quality_zero_guard(spark):
    q = spark.createDataFrame([("I1", 0, 0), ("I2", 1, 3)], "Inspection_ID string, Pass int, Fail int")
    out = {r["Inspection_ID"]: r for r in silver.silver_quality(conform(q, "fact_quality")).collect()}
    assert out["I1"]["Defect_Rate"] == 0.0 and out["I2"]["Defect_Rate"] == 0.75


def test_inspection_sample_sizes(spark):
    recs = [(f"O{q}", "P", q, 0, T0) for q in (0, 1, 9, 10, 19, 20)]
    prod = spark.createDataFrame(recs, "Production_Order string, Product string, Quantity_Produced int, "
                                       "Scrap int, Start_Time timestamp_ntz")
    day = T0.date()
    seen = spark.createDataFrame([("P", day, 0), ("P", day, 1), ("Q", day, 1)], "Product string, Date date, Fail int")
    out = {r["Product"]: r for r in inspection_coverage(prod, seen).collect()}
    p, q = out["P"], out["Q"]                          # 59 units -> 5 required, 2 inspected
    assert (p["Units"], p["Required"], p["Inspected"], p["Failed"], p["Missing"]) == (59, 5, 2, 1, 3)
    assert (q["Units"], q["Required"], q["Missing"]) == (0, 0, 0)   # inspected without production


def test_reading_out_of_range_fails_the_query(spark):
    df = spark.createDataFrame([(T0, "p", "l", "m", 1e9)], "Timestamp timestamp_ntz, Factory string, "
                               "Production_Line string, Machine string, Temperature double")
    with pytest.raises(Exception, match="out of range"):
        silver.silver_sensor(conform(df, "fact_sensor")).collect()


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(10.0, 400.0, "Running", 29.9), (10.0, 0.0, None, 30.0),
                                (1.0, 400.0, "Warning", 74.9), (1.0, 400.0, "Ideal", 75.0)],
                               "kw double, v double, s string, risk double")
    out = df.select(three_phase_current("kw", "v").alias("c"), status_colour("s").alias("col"),
                    risk_band("risk").alias("band")).collect()
    assert out[1]["c"] == 0.0 and abs(out[0]["c"] - 10.0 * 1000 / (400 * 1.732)) < 1e-12
    assert [r["col"] for r in out] == ["green", "green", "red", "green"]
    assert [r["band"] for r in out] == ["green", "amber", "amber", "red"]


def test_uid_and_hash_unit_are_deterministic(spark):
    df = spark.createDataFrame([("abc",)], "k string")
    r = df.select(uid("INSP-", "k").alias("u"), hash_unit("k").alias("h")).first()
    assert r["u"] == "INSP-BA7816BF"
    assert abs(r["h"] - int("ba7816bf", 16) / 2 ** 32) < 1e-15


def test_event_time_accepts_text(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:01",), ("garbage",)], "t string")
    assert [r[0] for r in df.select(event_time("t", df.schema["t"].dataType)).collect()] == \
        [dt.datetime(2024, 1, 1, 0, 0, 1), None]


def test_registry_schemas_cover_bronze():
    assert len(SCHEMAS) == 16
    assert [f.name for f in SCHEMAS["fact_sensor"].fields][-3:] == ["Running_Status", "Error_Code", "Mode"]


def test_machine_filter_and_views(spark, smoke_dir):
    from millrace.operators.filters import machine_rows
    from millrace.plans.registry import medallion
    m = medallion(spark, smoke_dir)
    one = machine_rows(m.bronze.fact_sensor, "M-00008")
    assert one.count() > 0 and {r["Machine"] for r in one.collect()} == {"M-00008"}
    m.register_views()
    assert spark.sql("SELECT count(*) FROM factory_kpi").first()[0] == m.factory_kpi.count()


def test_oee_null_quantities_propagate(spark):
    day = dt.date(2024, 1, 1)
    p, d = _oee_inputs(spark, [(day, "P1", None, 10, 9, 1)], [])
    r = gold.oee_daily(p, d).first()
    assert r["Performance_Pct"] is None and r["OEE_Score"] is None      # H8: LEAST(1, NULL) is NULL
    assert r["Availability_Pct"] == 1.0 and r["Quality_Pct"] == 0.9


def test_production_with_unknown_product_is_kept(spark):
    prod = spark.createDataFrame(
        [("O1", "P-1", 10, 9, 1, dt.datetime(2024, 1, 1, 22, 0, 30), dt.datetime(2024, 1, 2, 6, 0, 0)),
         ("O2", "P-404", 10, 9, 1, dt.datetime(2024, 1, 1, 6, 0), dt.datetime(2024, 1, 1, 14, 0))],
        "Production_Order string, Product string, Quantity_Planned int, Quantity_Produced int, Scrap int, "
        "Start_Time timestamp_ntz, End_Time timestamp_ntz")
    products = spark.createDataFrame([("P-1", "ECONOMY")], "Product string, Factory_Type string")
    out = {r["Production_Order"]: r for r in
           silver.silver_production(conform(prod, "fact_erp_production"), products).collect()}
    assert out["O2"]["Product_Category"] is None and out["O2"]["Good_Quantity"] == 8
    assert out["O1"]["Product_Category"] == "ECONOMY"
    assert out["O1"]["Duration_Minutes"] == 480          # 22:00:30 -> 06:00:00 crosses 480 minute marks


def test_cluster_profile_sizes_partitions():
    from millrace.session import cluster_conf
    big = cluster_conf(100e12, executor_cores=4, executors=1000)
    assert int(big["spark.sql.shuffle.partitions"]) == 100_000            # capped
    small = cluster_conf(50e9, executor_cores=4, executors=10)
    assert int(small["spark.sql.shuffle.partitions"]) == 187                # ~50 GB / 256 MB
    assert big["spark.sql.files.maxPartitionBytes"] == str(256 << 20)


@pytest.mark.parametrize("step", [1, 15, 60, 480, 1440])
def test_gap_runs_add_up_to_the_gaps(spark, step):
    from millrace.operators import operations as O
    t = dt.datetime(1969, 12, 30, 5, 7)
    data = [("A", t), ("A", t + dt.timedelta(minutes=1)), ("A", t + dt.timedelta(hours=3)), ("A", t + dt.timedelta(days=3)),
            ("B", dt.datetime(1970, 1, 1)), ("B", dt.datetime(1970, 1, 1, 23, 59, 59)), ("B", None), ("C", None)]
    data += [("D", dt.datetime(1969, 12, 30) + dt.timedelta(minutes=i)) for i in range(4 * 24 * 60)]     # no gap
    df = spark.createDataFrame(data, "Machine string, Timestamp timestamp_ntz")
    grid = {tuple(r) for r in O.telemetry_gaps(df, "Machine", "Timestamp", step).collect()}
    runs = O.telemetry_gap_runs(df, "Machine", "Timestamp", step).collect()
    spread = [(r["Machine"], r["From_Slot"] + dt.timedelta(minutes=step * i)) for r in runs for i in range(r["Slots"])]
    assert len(spread) == len(set(spread)) and set(spread) == grid
    assert all(r["To_Slot"] == r["From_Slot"] + dt.timedelta(minutes=step * (r["Slots"] - 1)) for r in runs)
    ends = {(m, s + dt.timedelta(minutes=step)) for m, s in spread}
    assert not any((r["Machine"], r["From_Slot"]) in ends for r in runs)                                 # runs are whole


def test_a_stray_date_is_one_gap(spark):
    from millrace.operators import operations as O
    df = spark.createDataFrame([("A", dt.datetime(2024, 1, 1)), ("B", dt.datetime(9999, 12, 31))], "Machine string, Timestamp timestamp_ntz")
    runs = O.telemetry_gap_runs(df, "Machine", "Timestamp", 1).collect()
    assert sorted((r["Machine"], r["Slots"] > 10**9) for r in runs) == [("A", True), ("B", False), ("B", True)]
