"""Silver layer: cleansed and conformed views over bronze tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import event_time, minute_diff, safe_div, sentinel_null


def _dec(c: str):
    """decimal(10,2); a reading that does not fit fails the query, whatever the session's ANSI setting."""
    d = F.col(c).try_cast("decimal(10,2)")
    lost = F.col(c).isNotNull() & d.isNull()
    return F.when(lost, F.raise_error(F.concat(F.lit(f"{c} out of range: "), F.col(c).cast("string"))).cast("decimal(10,2)")).otherwise(d)


def silver_sensor(fact_sensor: DataFrame) -> DataFrame:
    """Cleansed telemetry: parsed time, upper-cased ids, 2-dp readings.

    Rows without a raw timestamp are dropped (the predicate reaches the parquet
    scan); unparseable text timestamps survive with a NULL Event_Time, as in the
    warehouse view. The 'None' error-code sentinel becomes NULL.
    """
    et = event_time("Timestamp", fact_sensor.schema["Timestamp"].dataType)
    # A stored bronze table is partitioned by event_date (= date of Timestamp);
    # using it here lets date filters on silver/gold prune partitions.
    day = F.col("event_date") if "event_date" in fact_sensor.columns else F.to_date(et)
    return fact_sensor.where(F.col("Timestamp").isNotNull()).select(
        et.alias("Event_Time"),
        day.alias("Event_Date"),
        F.upper("Factory").alias("Factory_ID"),
        F.upper("Production_Line").alias("Line_ID"),
        F.upper("Machine").alias("Machine_ID"),
        _dec("Temperature").alias("Temp_Celsius"),
        _dec("Vibration").alias("Vibration_Hz"),
        _dec("Power_Consumption").alias("Power_kW"),
        _dec("RPM").alias("Spindle_RPM"),
        F.col("Running_Status"),
        F.col("Mode"),
        sentinel_null("Error_Code").alias("Error_Code"),
    )


def silver_production(fact_erp_production: DataFrame, dim_product: DataFrame) -> DataFrame:
    """Production orders enriched with the product category (LEFT join)."""
    d = dim_product.select(F.col("Product").alias("_dp_product"), F.col("Factory_Type"))
    p = fact_erp_production
    return p.join(d, p["Product"] == d["_dp_product"], "left").select(
        p["Production_Order"],
        p["Product"].alias("Product_ID"),
        d["Factory_Type"].alias("Product_Category"),
        p["Quantity_Planned"],
        p["Quantity_Produced"],
        p["Scrap"],
        (p["Quantity_Produced"] - p["Scrap"]).alias("Good_Quantity"),
        p["Operator"],
        p["Shift"],
        p["Start_Time"],
        p["End_Time"],
        minute_diff(p["Start_Time"], p["End_Time"]).alias("Duration_Minutes"),
    )


def silver_maintenance(fact_maintenance: DataFrame) -> DataFrame:
    """Maintenance logs with real downtime (Downtime > 0; NULL is dropped)."""
    return fact_maintenance.where(F.col("Downtime") > 0).select(
        F.col("Date").alias("Maintenance_Date"),
        F.col("Machine").alias("Machine_ID"),
        F.col("Failure").alias("Failure_Mode"),
        F.col("Root_Cause"),
        F.col("Severity"),
        F.col("Technician"),
        F.col("Downtime").alias("Downtime_Hours"),
        F.col("Cost").alias("Maintenance_Cost_USD"),
    )


def silver_quality(fact_quality: DataFrame) -> DataFrame:
    """Inspections with Total_Inspected and a zero-guarded Defect_Rate."""
    total = F.col("Pass") + F.col("Fail")
    return fact_quality.select(
        F.col("Inspection_ID"),
        F.col("Date").alias("Inspection_Date"),
        F.col("Product").alias("Product_ID"),
        F.col("Defect_Type"),
        F.col("Pass"),
        F.col("Fail"),
        total.alias("Total_Inspected"),
        F.when(total > 0, safe_div(F.col("Fail"), total)).otherwise(F.lit(0.0)).alias("Defect_Rate"),
    )
