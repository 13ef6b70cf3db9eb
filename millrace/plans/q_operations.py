"""Registered queries: energy, uptime, production plans, shipments, shifts,
time grid, causal chain, extensions (A7, A9, A10, X1-X10, E1-E4, F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import (
    at_hour, iso_timestamp, risk_band, status_colour, three_phase_current, uid, ymd,
)
from millrace.operators import operations as O
from millrace.plans.oracle import FRAGMENTS, half_up
from millrace.plans.q_timeseries import _LEDGER_CTE, _any_shortage
from millrace.plans.registry import register
from millrace.sources.testdata import formatted


def _kwh(expr: str) -> str:
    return half_up(expr, 2)


@register("energy_daily", f"""
SELECT Event_Date AS "Date", Machine_ID AS Machine,
       {_kwh('CAST(sum(Power_kW) AS DOUBLE) * 1.05::DOUBLE')} AS Energy,
       {_kwh('CAST(sum(Power_kW) AS DOUBLE) * 1.05::DOUBLE * 0.15::DOUBLE')} AS Cost,
       {_kwh('CAST(sum(Power_kW) AS DOUBLE) * 1.05::DOUBLE * 0.4::DOUBLE')} AS Carbon_Emission,
       {_kwh('CAST(max(Power_kW) AS DOUBLE)')} AS Peak_Usage
FROM silver_sensor GROUP BY Event_Date, Machine_ID""", "A7")
def _energy(m):
    return O.energy_daily(m.silver_sensor, 1.05)


FRAGMENTS["failed_machine_days"] = """
SELECT DISTINCT dm.Factory, f."Date", f.Machine
FROM (SELECT DISTINCT Machine, "Date" FROM fact_maintenance) f JOIN dim_machine dm ON f.Machine = dm.Machine"""


def _uptime_sql(days: str) -> str:
    return f"""
WITH days AS ({days}),
tot AS (SELECT Factory, count(*) AS Total_Machines FROM dim_machine GROUP BY Factory),
fl AS (SELECT Factory, "Date", count(*) AS Failed_Machines FROM failed_machine_days GROUP BY Factory, "Date"),
up AS (
  SELECT d.Factory, d."Date", COALESCE(t.Total_Machines, 0) AS Total_Machines,
         COALESCE(f.Failed_Machines, 0) AS Failed_Machines,
         CASE WHEN COALESCE(t.Total_Machines, 0) > 0
              THEN 1.0::DOUBLE - CAST(COALESCE(f.Failed_Machines, 0) AS DOUBLE)
                                 / CAST(t.Total_Machines AS DOUBLE)
              ELSE 1.0::DOUBLE END AS Uptime_Factor
  FROM days d LEFT JOIN tot t ON d.Factory = t.Factory
  LEFT JOIN fl f ON d.Factory = f.Factory AND d."Date" = f."Date")"""


_SENSOR_DAYS = 'SELECT DISTINCT Factory, CAST("Timestamp" AS DATE) AS "Date" FROM fact_sensor'
_PROD_DAYS = 'SELECT DISTINCT __factory AS Factory, CAST(Start_Time AS DATE) AS "Date" FROM fact_erp_production'


def _uptime(m, days):
    return O.uptime_factor(days, m.bronze.fact_maintenance, m.bronze.dim_machine)


@register("uptime_factor", _uptime_sql(_SENSOR_DAYS) + "\nSELECT * FROM up", "A9 J9")
def _uptime_q(m):
    days = m.bronze.fact_sensor.select("Factory", F.to_date("Timestamp").alias("Date")).distinct()
    return _uptime(m, days)


@register("first_order_per_product", """
SELECT Product_ID, Production_Order, Start_Time FROM (
  SELECT Product_ID, Production_Order, Start_Time,
         row_number() OVER (PARTITION BY Product_ID ORDER BY Start_Time, Production_Order) AS rn
  FROM silver_production) WHERE rn = 1""", "A10")
def _first(m):
    sp = m.silver_production.select("Product_ID", "Production_Order", "Start_Time")
    return O.first_per_key(sp, "Product_ID", ["Start_Time", "Production_Order"])


@register("daily_failure_prob", """
SELECT Machine, reliability, (1.0::DOUBLE - reliability) / 365.0::DOUBLE AS Daily_Failure_Prob
FROM dim_machine""", "X1")
def _fail_prob(m):
    return O.daily_failure_prob(m.bronze.dim_machine)


@register("failure_signature", """
WITH fm AS (SELECT Machine, "Date", min(Failure) AS code FROM fact_maintenance GROUP BY 1, 2),
j AS (SELECT f.*, fm.code, (fm.Machine IS NOT NULL AND hour(f."Timestamp") > 12) AS hit
      FROM fact_sensor f LEFT JOIN fm ON f.Machine = fm.Machine AND CAST(f."Timestamp" AS DATE) = fm."Date")
SELECT "Timestamp", Factory, Production_Line, Machine,
       CASE WHEN hit THEN Temperature * 1.5::DOUBLE ELSE Temperature END AS Temperature,
       CASE WHEN hit THEN Vibration * 3.0::DOUBLE ELSE Vibration END AS Vibration,
       Voltage, "Current",
       CASE WHEN hit THEN Power_Consumption * 1.2::DOUBLE ELSE Power_Consumption END AS Power_Consumption,
       CASE WHEN hit THEN Pressure * 0.8::DOUBLE ELSE Pressure END AS Pressure,
       RPM, Oil_Level, Humidity,
       CASE WHEN hit THEN Noise * 1.4::DOUBLE ELSE Noise END AS Noise,
       CASE WHEN hit THEN 'Warning' ELSE Running_Status END AS Running_Status,
       CASE WHEN hit THEN code ELSE Error_Code END AS Error_Code, Mode, hit AS Failure_Window
FROM j""", "X2")
def _signature(m):
    return O.failure_signature(m.bronze.fact_sensor, m.bronze.fact_maintenance)


@register("expected_output", _uptime_sql(_PROD_DAYS) + """
SELECT p.Production_Order, p.__factory AS Factory, p.Shift, p.Quantity_Planned,
       COALESCE(up.Uptime_Factor, 1.0::DOUBLE) AS Uptime_Factor,
       CASE WHEN p.Shift = 'Night'
            THEN CAST(trunc(CAST(trunc(p.Quantity_Planned * 0.95::DOUBLE * COALESCE(up.Uptime_Factor, 1.0::DOUBLE))
                                 AS INTEGER) * 0.9::DOUBLE) AS INTEGER)
            ELSE CAST(trunc(p.Quantity_Planned * 0.95::DOUBLE * COALESCE(up.Uptime_Factor, 1.0::DOUBLE)) AS INTEGER)
       END AS Expected_Output
FROM fact_erp_production p
LEFT JOIN up ON p.__factory = up.Factory AND CAST(p.Start_Time AS DATE) = up."Date\"""", "X3")
def _expected_output(m):
    return O.expected_output(m.bronze.fact_erp_production, m.bronze.fact_maintenance, m.bronze.dim_machine)


@register("expected_scrap", """
WITH fd AS (SELECT DISTINCT Factory, "Date" FROM failed_machine_days),
j AS (SELECT p.Production_Order, p.Quantity_Produced, e.Role AS Operator_Role,
             0.03::DOUBLE * (CASE WHEN e.Role = 'Operator' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END)
                   * (CASE WHEN fd.Factory IS NOT NULL THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) AS Scrap_Rate
      FROM fact_erp_production p LEFT JOIN dim_employee e ON p.Operator = e.Employee
      LEFT JOIN fd ON p.__factory = fd.Factory AND CAST(p.Start_Time AS DATE) = fd."Date")
SELECT Production_Order, Operator_Role, Scrap_Rate,
       CAST(trunc(Quantity_Produced * Scrap_Rate) AS INTEGER) AS Expected_Scrap
FROM j""", "X4")
def _expected_scrap(m):
    from millrace.operators.operations import failed_machines
    fd = failed_machines(m.bronze.fact_maintenance, m.bronze.dim_machine)
    return O.expected_scrap(m.bronze.fact_erp_production, m.bronze.dim_employee, fd)


@register("inspection_plan", """
WITH need AS (SELECT Product, CAST(Start_Time AS DATE) AS "Date", CAST(sum(Quantity_Produced + Scrap) AS BIGINT) AS Units
              FROM fact_erp_production GROUP BY 1, 2),
seen AS (SELECT Product, "Date", count(*) AS Inspected, CAST(sum(Fail) AS BIGINT) AS Failed FROM fact_quality GROUP BY 1, 2),
j AS (SELECT Product, "Date", COALESCE(Units, 0) AS Units, COALESCE(Inspected, 0) AS Inspected, COALESCE(Failed, 0) AS Failed
      FROM need FULL OUTER JOIN seen USING (Product, "Date")),
r AS (SELECT *, CASE WHEN Units > 0 THEN greatest(1, CAST(trunc(Units * 0.1::DOUBLE) AS BIGINT)) ELSE 0 END AS Required FROM j)
SELECT Product, "Date", Units, CAST(Required AS BIGINT) AS Required, Inspected, Failed,
       CAST(greatest(0, Required - Inspected) AS BIGINT) AS Missing FROM r""", "X5 (inspections held against the required sample)")
def _inspection(m):
    return O.inspection_coverage(m.bronze.fact_erp_production, m.bronze.fact_quality)


@register("shipments_from_production", _LEDGER_CTE + """,
sd AS (SELECT "Date", bool_or(Shortage) AS Any_Shortage FROM ledger GROUP BY "Date")
SELECT p.Production_Order, p.Product, p.Quantity_Produced AS Quantity, CAST(p.Start_Time AS DATE) AS Production_Date,
       s.Shipment_ID, s.Dispatch_Date, CAST(s.Expected_Delivery_Date - s.Dispatch_Date AS INTEGER) AS Promised_Days,
       s.Delayed, s.Delay_Reason, COALESCE(sd.Any_Shortage, false) AS Shortage_Day,
       s.Delayed AND COALESCE(sd.Any_Shortage, false) AS Delay_Explained
FROM fact_erp_production p LEFT JOIN fact_shipments s ON p.Production_Order = s.Production_Order
LEFT JOIN sd ON CAST(p.Start_Time AS DATE) = sd."Date"
WHERE p.Quantity_Produced > 0""", "X6 (shipments held against shortage days)")
def _shipments(m):
    return O.shipments_against_shortage(m.bronze.fact_erp_production, m.bronze.fact_shipments, _any_shortage(m))


@register("repair_cost", f"""
SELECT "Date", Machine, Downtime AS Repair_Hours,
       {half_up('Downtime * 150.0::DOUBLE + Cost', 2)} AS Repair_Cost,
       {half_up('Downtime * 1.3::DOUBLE', 1)} AS Expected_Downtime
FROM fact_maintenance""", "X7")
def _repair(m):
    return O.repair_cost(m.bronze.fact_maintenance, "Downtime", "Cost")


@register("shift_windows", """
WITH d AS (SELECT DISTINCT CAST(Start_Time AS DATE) AS "Date" FROM fact_erp_production),
s AS (SELECT * FROM (VALUES ('Morning', 6, 1.05::DOUBLE, 100), ('Evening', 14, 1.0::DOUBLE, 100),
                            ('Night', 22, 0.9::DOUBLE, 80))
                    AS t(Shift, Start_Hour, Efficiency_Multiplier, Staffing_Percent))
SELECT d."Date", s.Shift, CAST(d."Date" AS TIMESTAMP) + to_hours(s.Start_Hour) AS Shift_Start,
       CAST(d."Date" AS TIMESTAMP) + to_hours(s.Start_Hour) + INTERVAL 8 HOUR AS Shift_End,
       s.Efficiency_Multiplier, s.Staffing_Percent
FROM d CROSS JOIN s""", "X8 E4")
def _shifts(m):
    days = m.bronze.fact_erp_production.select(F.to_date("Start_Time").alias("Date")).distinct()
    return O.shift_windows(days)


@register("telemetry_gaps", """
WITH occ AS (SELECT DISTINCT Machine, date_trunc('hour', "Timestamp") AS Slot_Start FROM fact_sensor),
days AS (SELECT m.Machine, CAST(g.d AS DATE) AS d FROM (SELECT DISTINCT Machine FROM fact_sensor) m,
         (SELECT unnest(generate_series(min(CAST("Timestamp" AS DATE)), max(CAST("Timestamp" AS DATE)), INTERVAL 1 DAY)) AS d
          FROM fact_sensor) g),
grid AS (SELECT Machine, g.Slot_Start FROM days,
         LATERAL generate_series(CAST(d AS TIMESTAMP), CAST(d AS TIMESTAMP) + INTERVAL 23 HOUR,
                                 INTERVAL 1 HOUR) AS g(Slot_Start))
SELECT g.Machine, g.Slot_Start FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM occ o WHERE o.Machine = g.Machine AND o.Slot_Start = g.Slot_Start)""", "X9")
def _gaps(m):
    return O.telemetry_gaps(m.bronze.fact_sensor.select("Machine", "Timestamp"), "Machine", "Timestamp", 60)


@register("telemetry_gap_runs", """
WITH occ AS (SELECT DISTINCT Machine, date_trunc('hour', "Timestamp") AS Slot_Start FROM fact_sensor),
days AS (SELECT m.Machine, CAST(g.d AS DATE) AS d FROM (SELECT DISTINCT Machine FROM fact_sensor) m,
         (SELECT unnest(generate_series(min(CAST("Timestamp" AS DATE)), max(CAST("Timestamp" AS DATE)), INTERVAL 1 DAY)) AS d
          FROM fact_sensor) g),
grid AS (SELECT Machine, g.Slot_Start FROM days,
         LATERAL generate_series(CAST(d AS TIMESTAMP), CAST(d AS TIMESTAMP) + INTERVAL 23 HOUR,
                                 INTERVAL 1 HOUR) AS g(Slot_Start))
, missing AS (
  SELECT g.Machine, g.Slot_Start, row_number() OVER (PARTITION BY g.Machine ORDER BY g.Slot_Start) AS rn FROM grid g
  WHERE NOT EXISTS (SELECT 1 FROM occ o WHERE o.Machine = g.Machine AND o.Slot_Start = g.Slot_Start))
SELECT Machine, min(Slot_Start) AS From_Slot, max(Slot_Start) AS To_Slot, count(*) AS Slots
FROM missing GROUP BY Machine, date_diff('hour', TIMESTAMP '1970-01-01', Slot_Start) - rn""", "X9 as intervals")
def _gap_runs(m):
    return O.telemetry_gap_runs(m.bronze.fact_sensor.select("Machine", "Timestamp"), "Machine", "Timestamp", 60)


@register("causal_chain", _LEDGER_CTE + """,
sd AS (SELECT "Date", bool_or(Shortage) AS Any_Shortage FROM ledger GROUP BY "Date"),
src AS (
  SELECT __factory AS Factory, CAST(Start_Time AS DATE) AS "Date", 0 AS Failures, 0.0::DOUBLE AS Downtime_Hours,
         Quantity_Produced AS Produced, Scrap, 0 AS Inspection_Fails, 0 AS Delayed_Shipments FROM fact_erp_production
  UNION ALL
  SELECT dm.Factory, f."Date", 1, f.Downtime, 0, 0, 0, 0 FROM fact_maintenance f LEFT JOIN dim_machine dm ON f.Machine = dm.Machine
  UNION ALL
  SELECT e.Factory, q."Date", 0, 0.0, 0, 0, q.Fail, 0 FROM fact_quality q LEFT JOIN dim_employee e ON q.Inspector = e.Employee
  UNION ALL
  SELECT p.__factory, s.Dispatch_Date, 0, 0.0, 0, 0, 0, 1
  FROM fact_shipments s LEFT JOIN fact_erp_production p ON s.Production_Order = p.Production_Order WHERE s.Delayed),
t AS (SELECT COALESCE(Factory, 'Unassigned') AS Factory, "Date", CAST(sum(Failures) AS BIGINT) AS Failures,
             sum(Downtime_Hours) AS Downtime_Hours, CAST(sum(Produced) AS BIGINT) AS Produced, CAST(sum(Scrap) AS BIGINT) AS Scrap,
             CAST(sum(Inspection_Fails) AS BIGINT) AS Inspection_Fails, CAST(sum(Delayed_Shipments) AS BIGINT) AS Delayed_Shipments
      FROM src GROUP BY 1, 2)
SELECT t.*, COALESCE(sd.Any_Shortage, false) AS Any_Shortage FROM t LEFT JOIN sd ON t."Date" = sd."Date\"""", "X10")
def _causal(m):
    b = m.bronze
    return O.causal_chain(b.fact_erp_production, b.fact_maintenance, b.dim_machine, b.fact_quality, b.dim_employee,
                          b.fact_shipments, _any_shortage(m))


@register("factory_maintenance_cost", f"""
SELECT dm.Factory, CAST(date_trunc('month', m.Maintenance_Date) AS DATE) AS "Month", count(*) AS Failures,
       sum(m.Downtime_Hours) AS Downtime_Hours,
       {half_up('sum(m.Maintenance_Cost_USD)', 2)} AS Maintenance_Cost_USD
FROM silver_maintenance m LEFT JOIN dim_machine dm ON m.Machine_ID = dm.Machine
GROUP BY 1, 2""", "E1")
def _maint_cost(m):
    return O.factory_maintenance_cost(m.silver_maintenance, m.bronze.dim_machine)


@register("factory_efficiency", f"""
WITH g AS (SELECT __factory AS Factory, CAST(date_trunc('month', CAST(Start_Time AS DATE)) AS DATE) AS "Month",
                  CAST(sum(Quantity_Planned) AS BIGINT) AS Planned,
                  CAST(sum(Quantity_Produced) AS BIGINT) AS Produced,
                  CAST(sum(Quantity_Produced - Scrap) AS BIGINT) AS Good
           FROM fact_erp_production GROUP BY 1, 2)
SELECT Factory, "Month", Planned, Produced, Good,
       {half_up('CAST(Produced AS DOUBLE) / CAST(nullif(Planned, 0) AS DOUBLE)', 4)} AS Output_Ratio,
       {half_up('CAST(Good AS DOUBLE) / CAST(nullif(Produced, 0) AS DOUBLE)', 4)} AS Good_Ratio
FROM g""", "E1")
def _efficiency(m):
    return O.factory_efficiency(m.bronze.fact_erp_production)


@register("rolling_sensor_averages", """
WITH d AS (SELECT Machine_ID, Event_Date, sum(Temp_Celsius) AS st, count(Temp_Celsius) AS ct,
                  sum(Vibration_Hz) AS sv, count(Vibration_Hz) AS cv, sum(Power_kW) AS sp, count(Power_kW) AS cp
           FROM silver_sensor GROUP BY 1, 2)
SELECT Machine_ID, Event_Date,
       CAST(sum(st) OVER w AS DOUBLE) / CAST(nullif(sum(ct) OVER w, 0) AS DOUBLE) AS Rolling_Avg_Temp,
       CAST(sum(sv) OVER w AS DOUBLE) / CAST(nullif(sum(cv) OVER w, 0) AS DOUBLE) AS Rolling_Avg_Vibration,
       CAST(sum(sp) OVER w AS DOUBLE) / CAST(nullif(sum(cp) OVER w, 0) AS DOUBLE) AS Rolling_Avg_Power,
       count(*) OVER w AS Days_In_Window
FROM d WINDOW w AS (PARTITION BY Machine_ID ORDER BY Event_Date RANGE BETWEEN INTERVAL 6 DAY PRECEDING
                    AND CURRENT ROW)""", "E2")
def _rolling(m):
    return O.rolling_sensor_averages(m.silver_sensor, 7)


@register("bom_part_demand", """
WITH n AS (SELECT count(*) AS n FROM part),
bom AS (SELECT 'P-' || CAST(p_partkey AS VARCHAR) AS Product,
               'PART-' || CAST((2 * p_partkey) % (SELECT n FROM n) AS VARCHAR) AS Part,
               CAST(1 + p_partkey % 3 AS BIGINT) AS q FROM part
        UNION ALL
        SELECT 'P-' || CAST(p_partkey AS VARCHAR),
               'PART-' || CAST((2 * p_partkey + 1) % (SELECT n FROM n) AS VARCHAR), CAST(2 AS BIGINT) FROM part)
SELECT b.Part, d.Prod_Date AS "Date", CAST(sum(d.Actual_Qty * b.q) AS BIGINT) AS Part_Demand
FROM daily_production d JOIN bom b ON d.Product_ID = b.Product GROUP BY 1, 2""", "E3")
def _bom(m):
    part = m.bronze.raw("part")
    n = part.select(F.count(F.lit(1))).first()[0]
    k = F.col("p_partkey")
    bom = part.select(
        F.concat(F.lit("P-"), k.cast("string")).alias("Product"),
        F.create_map(F.concat(F.lit("PART-"), ((2 * k) % n).cast("string")), (1 + k % 3).cast("long"),
                     F.concat(F.lit("PART-"), ((2 * k + 1) % n).cast("string")), F.lit(2).cast("long"))
        .alias("bom"))
    produced = m.daily_production.select(F.col("Product_ID").alias("Product"),
                                         F.col("Prod_Date").alias("Date"), F.col("Actual_Qty").alias("Units"))
    return O.bom_explosion(produced, bom)


@register("shift_attribution", """
SELECT Production_Order, Shift,
       CASE WHEN hour(Start_Time) >= 6 AND hour(Start_Time) < 14 THEN 'Morning'
            WHEN hour(Start_Time) >= 14 AND hour(Start_Time) < 22 THEN 'Evening' ELSE 'Night' END AS Shift_From_Time,
       CASE Shift WHEN 'Morning' THEN 1.05::DOUBLE WHEN 'Evening' THEN 1.0::DOUBLE
                  WHEN 'Night' THEN 0.9::DOUBLE END AS Efficiency_Multiplier
FROM fact_erp_production""", "E4")
def _shift_attr(m):
    p = m.bronze.fact_erp_production
    return p.select("Production_Order", "Shift", O.shift_of("Start_Time").alias("Shift_From_Time"),
                    O.shift_multiplier("Shift").alias("Efficiency_Multiplier"))


@register("scalar_functions", f"""
SELECT Production_Order,
       strftime(Start_Time, '%Y-%m-%d') AS Start_Day_Text,
       strftime(Start_Time, '%Y-%m-%dT%H:%M:%S.%f') AS Start_Iso,
       CAST(Start_Time AS DATE) + 3 AS Plus_3_Days,
       Start_Time + INTERVAL 90 MINUTE AS Plus_90_Minutes,
       CAST(CAST(Start_Time AS DATE) AS TIMESTAMP) + INTERVAL 22 HOUR AS At_22h,
       CAST(trunc(Quantity_Produced * 0.9::DOUBLE) AS INTEGER) AS Truncated_Output,
       greatest(1, CAST(trunc(Quantity_Produced * 0.1::DOUBLE) AS INTEGER)) AS Sample_Size,
       CASE WHEN 400 - Scrap * 100 > 0
            THEN Quantity_Produced * 1000.0::DOUBLE / ((400 - Scrap * 100) * 1.732::DOUBLE)
            ELSE 0.0::DOUBLE END AS Three_Phase_Current,
       replace(upper(Shift || ' shift'), ' ', '_') AS Header_Name,
       printf('M-%05d', Quantity_Produced) AS Padded_Id,
       'INSP-' || upper(substr(sha256(Production_Order), 1, 8)) AS Derived_Uid,
       COALESCE(CASE Shift WHEN 'Morning' THEN 1.05::DOUBLE WHEN 'Evening' THEN 1.0::DOUBLE END, 0.9::DOUBLE)
           AS Map_Default,
       CAST(Shift IN ('Night', 'Evening') AS INTEGER) AS Label,
       CASE WHEN COALESCE(CASE WHEN Scrap > 2 THEN 'Warning' WHEN Scrap = 1 THEN NULL ELSE 'Running' END,
                          'Ideal') IN ('Running', 'Ideal') THEN 'green' ELSE 'red' END AS Status_Colour,
       CASE WHEN Quantity_Produced * 2 < 30 THEN 'green' WHEN Quantity_Produced * 2 < 75 THEN 'amber'
            ELSE 'red' END AS Risk_Band
FROM fact_erp_production""", "F12-F23 P15 M11")
def _scalars(m):
    p = m.bronze.fact_erp_production
    volts = 400 - F.col("Scrap") * 100
    status = F.when(F.col("Scrap") > 2, "Warning").when(F.col("Scrap") == 1, F.lit(None)).otherwise("Running")
    shift_map = F.create_map(F.lit("Morning"), F.lit(1.05), F.lit("Evening"), F.lit(1.0))
    return p.select(
        "Production_Order",
        ymd("Start_Time").alias("Start_Day_Text"),
        iso_timestamp("Start_Time").alias("Start_Iso"),
        F.date_add(F.to_date("Start_Time"), 3).alias("Plus_3_Days"),
        F.timestamp_add("MINUTE", F.lit(90), F.col("Start_Time")).alias("Plus_90_Minutes"),
        at_hour("Start_Time", 22).alias("At_22h"),
        (F.col("Quantity_Produced") * 0.9).cast("int").alias("Truncated_Output"),
        F.greatest(F.lit(1), (F.col("Quantity_Produced") * 0.1).cast("int")).alias("Sample_Size"),
        three_phase_current(F.col("Quantity_Produced"), volts).alias("Three_Phase_Current"),
        F.replace(F.upper(F.concat("Shift", F.lit(" shift"))), F.lit(" "), F.lit("_")).alias("Header_Name"),
        formatted("M-%05d", F.col("Quantity_Produced")).alias("Padded_Id"),
        uid("INSP-", "Production_Order").alias("Derived_Uid"),
        F.coalesce(F.try_element_at(shift_map, F.col("Shift")), F.lit(0.9)).alias("Map_Default"),
        F.col("Shift").isin("Night", "Evening").cast("int").alias("Label"),
        status_colour(status).alias("Status_Colour"),
        risk_band(F.col("Quantity_Produced") * 2).alias("Risk_Band"))

