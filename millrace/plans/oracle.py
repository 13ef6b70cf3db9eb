"""DuckDB SQL for the correctness check.

The driver registers its parquet tables as views (``events``, ``lineitem`` ...).
The bronze/silver/gold relations of the library are written here once as SQL
fragments; ``build(sql)`` prefixes a query with the CTEs it needs (found by
name, dependencies included), so each oracle query reads like the warehouse
SQL it checks. These fragments mirror ``millrace.sources.testdata`` and the
operators rule for rule.
"""

from __future__ import annotations

import re

# Helpers -------------------------------------------------------------------
_PLANT = "'Plant ' || CAST(user_id % 4 AS VARCHAR)"
_MACHINE = "printf('M-%05d', user_id)"
_LINE = f"'Line ' || CAST(user_id % 5 + 1 AS VARCHAR) || ' - ' || {_PLANT}"
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_Q = "CAST(trunc(l_quantity) AS INTEGER)"
_ORDER_ID = "concat_ws('-', 'ORD', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def hash_unit(*cols: str) -> str:
    """Same value as ``millrace.functions.hash_unit``."""
    key = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"(CAST(('0x' || substr(sha256({key}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def half_up(x: str, n: int) -> str:
    s = float(10 ** n)
    return f"(floor(({x}) * {s!r}::DOUBLE + 0.5::DOUBLE) / {s!r}::DOUBLE)"


FRAGMENTS: dict[str, str] = {}

# Bronze (adapters) -----------------------------------------------------------
FRAGMENTS["fact_sensor"] = f"""
SELECT ts - INTERVAL 9125 DAY AS "Timestamp",
       {_PLANT} AS Factory, {_LINE} AS Production_Line, {_MACHINE} AS Machine,
       value AS Temperature, value + 0.001::DOUBLE AS Vibration,
       CAST(400 - event_id % 9 AS DOUBLE) AS Voltage,
       value * 3 * 1000.0::DOUBLE / (CAST(400 - event_id % 9 AS DOUBLE) * 1.732::DOUBLE) AS "Current",
       value * 3 AS Power_Consumption, CAST(95 + event_id % 11 AS DOUBLE) AS Pressure,
       CAST({_K} * 60 AS DOUBLE) AS RPM,
       CASE WHEN event_id % 17 <> 0 THEN CAST(90 + event_id % 10 AS DOUBLE) END AS Oil_Level,
       CAST(40 + event_id % 13 AS DOUBLE) AS Humidity,
       60 + CAST(event_id % 50 AS DOUBLE) / 10.0::DOUBLE AS Noise,
       CASE WHEN event_type = 'error' THEN 'Warning' ELSE 'Running' END AS Running_Status,
       CASE WHEN event_type = 'error' THEN 'E101' ELSE 'None' END AS Error_Code,
       CASE WHEN event_type = 'error' THEN 'Custom Disturbance' ELSE 'Ideal' END AS Mode
FROM events"""

FRAGMENTS["fact_maintenance"] = f"""
SELECT CAST(ts - INTERVAL 9125 DAY AS DATE) AS "Date", {_MACHINE} AS Machine,
       'F' || CAST({_K} % 8 AS VARCHAR) AS Failure, 'RC' || CAST(event_id % 5 AS VARCHAR) AS Root_Cause,
       CASE WHEN value > 100 THEN 'Critical' ELSE 'High' END AS Severity,
       CASE WHEN event_id % 13 = 0 THEN 'T' || CAST(user_id % 10 AS VARCHAR)
            ELSE printf('Supplier#%09d', user_id % 20) END AS Technician,
       CAST(event_id % 25 AS DOUBLE) AS Downtime, NULL::DOUBLE AS Repair_Time,
       CAST(event_id % 25 AS DOUBLE) * 150 + value AS Cost
FROM events WHERE event_type = 'error'"""

FRAGMENTS["fact_erp_production"] = f"""
SELECT {_ORDER_ID} AS Production_Order,
       'P-' || CAST(l_partkey AS VARCHAR) AS Product,
       CAST(greatest(0, {_Q} + l_linenumber - 3) AS INTEGER) AS Quantity_Planned,
       {_Q} AS Quantity_Produced,
       CAST(least({_Q}, l_partkey % 4) AS INTEGER) AS Scrap,
       printf('Supplier#%09d', l_suppkey) AS Operator,
       CASE l_returnflag WHEN 'A' THEN 'Morning' WHEN 'N' THEN 'Evening' WHEN 'R' THEN 'Night' END AS Shift,
       l_shipdate + to_hours(CASE l_returnflag WHEN 'A' THEN 6 WHEN 'N' THEN 14 WHEN 'R' THEN 22 END) AS Start_Time,
       l_shipdate + to_hours(CASE l_returnflag WHEN 'A' THEN 6 WHEN 'N' THEN 14 WHEN 'R' THEN 22 END)
           + INTERVAL 8 HOUR AS End_Time,
       'Plant ' || CAST(l_suppkey % 4 AS VARCHAR) AS __factory,
       NULL::VARCHAR AS __product_type
FROM lineitem"""

FRAGMENTS["fact_quality"] = """
SELECT 'INSP-' || CAST(doc_id AS VARCHAR) AS Inspection_ID,
       DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) - 9125 AS "Date",
       'P-' || CAST(doc_id % 200 AS VARCHAR) AS Product,
       'INSP-' || CAST(doc_id AS VARCHAR) AS Inspection,
       CASE WHEN toxic = 1 THEN 'Surface Scratch' ELSE 'None' END AS Defect_Type,
       CAST(quality AS INTEGER) AS Pass, CAST(1 - quality AS INTEGER) AS Fail,
       CASE WHEN doc_id % 7 <> 0 THEN printf('Supplier#%09d', doc_id % 24) END AS Inspector
FROM labels"""

FRAGMENTS["fact_shipments"] = f"""
SELECT {_ORDER_ID} AS Shipment_ID, {_ORDER_ID} AS Production_Order, c.c_name AS Customer,
       'P-' || CAST(l_partkey AS VARCHAR) AS Product, {_Q} AS Quantity,
       CAST(o.o_orderdate AS DATE) AS Dispatch_Date,
       CAST(o.o_orderdate AS DATE) + CAST(1 + l_partkey % 14 AS INTEGER) AS Expected_Delivery_Date,
       (l_partkey % 14) > 5 AS Delayed,
       CASE WHEN (l_partkey % 14) > 5 THEN 'Inventory Shortage' ELSE 'None' END AS Delay_Reason
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN customer c ON o.o_custkey = c.c_custkey"""

FRAGMENTS["part_day_demand"] = f"""
SELECT 'P-' || CAST(l_partkey AS VARCHAR) AS Product, l_partkey AS Part_Key,
       CAST(l_shipdate AS DATE) AS "Date", CAST(sum({_Q} + least({_Q}, l_partkey % 4)) AS BIGINT) AS Need
FROM lineitem GROUP BY l_partkey, CAST(l_shipdate AS DATE)"""

FRAGMENTS["dim_machine"] = f"""
SELECT {_MACHINE} AS Machine, {_LINE} AS Production_Line, {_PLANT} AS Factory,
       NULL::VARCHAR AS Type,
       CAST(40 + user_id % 40 AS DOUBLE) AS normal_temp,
       CAST(500 * (user_id % 3) AS DOUBLE) AS max_rpm,
       CAST(9 + user_id % 37 AS DOUBLE) AS power_kw,
       0.5::DOUBLE AS vibration_base,
       0.95::DOUBLE + CAST(user_id % 5 AS DOUBLE) / 100.0::DOUBLE AS reliability
FROM (SELECT DISTINCT user_id FROM events)"""

FRAGMENTS["dim_production_line"] = """
SELECT DISTINCT Production_Line, Factory FROM dim_machine"""

FRAGMENTS["dim_factory"] = """
SELECT 'Plant ' || CAST(r.r_regionkey AS VARCHAR) AS Factory, t.p_type AS Type, r.r_name AS Location
FROM region r LEFT JOIN (
    SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS idx
    FROM (SELECT DISTINCT p_type FROM part)) t ON r.r_regionkey = t.idx"""

FRAGMENTS["dim_product"] = """
SELECT 'P-' || CAST(p_partkey AS VARCHAR) AS Product, p_type AS Factory_Type FROM part"""

FRAGMENTS["dim_employee"] = """
SELECT s_name AS Employee,
       CASE WHEN s_suppkey % 4 <= 1 THEN 'Production' WHEN s_suppkey % 4 = 2 THEN 'Maintenance'
            ELSE 'Quality' END AS Department,
       CASE s_suppkey % 4 WHEN 0 THEN 'Operator' WHEN 1 THEN 'Senior Operator'
            WHEN 2 THEN 'Technician' ELSE 'Inspector' END AS Role,
       'Plant ' || CAST(s_suppkey % 5 AS VARCHAR) AS Factory
FROM supplier"""

FRAGMENTS["dim_supplier"] = """
SELECT s_name AS Supplier, CAST(3 + s_suppkey % 12 AS INTEGER) AS Delivery_Time,
       CAST(85 + s_suppkey % 15 AS DOUBLE) AS Quality_Score
FROM supplier"""

FRAGMENTS["dim_customer"] = """
SELECT c_name AS Customer, c_mktsegment AS Type FROM customer"""

FRAGMENTS["dim_warehouse"] = """
SELECT printf('WH-%02d', n_nationkey) AS Warehouse,
       'Plant ' || CAST(n_regionkey AS VARCHAR) AS Factory,
       CASE WHEN n_nationkey % 2 = 0 THEN 'Raw Material' ELSE 'Finished Goods' END AS Type
FROM nation"""

FRAGMENTS["dim_part"] = """
SELECT p.p_name || '#' || CAST(p.p_partkey AS VARCHAR) AS Part, s.s_name AS Supplier,
       p.p_retailprice AS Cost, CAST(5 + p.p_size AS INTEGER) AS Lead_Time,
       CAST(20 + p.p_size AS INTEGER) AS Safety_Stock
FROM part p LEFT JOIN supplier s ON p.p_partkey % (SELECT count(*) FROM supplier) = s.s_suppkey"""

# Silver ----------------------------------------------------------------------
FRAGMENTS["silver_sensor"] = """
SELECT TRY_CAST("Timestamp" AS TIMESTAMP) AS Event_Time,
       CAST(TRY_CAST("Timestamp" AS TIMESTAMP) AS DATE) AS Event_Date,
       upper(Factory) AS Factory_ID, upper(Production_Line) AS Line_ID,
       upper(Machine) AS Machine_ID,
       CAST(Temperature AS DECIMAL(10,2)) AS Temp_Celsius,
       CAST(Vibration AS DECIMAL(10,2)) AS Vibration_Hz,
       CAST(Power_Consumption AS DECIMAL(10,2)) AS Power_kW,
       CAST(RPM AS DECIMAL(10,2)) AS Spindle_RPM,
       Running_Status, Mode,
       CASE WHEN Error_Code = 'None' THEN NULL ELSE Error_Code END AS Error_Code
FROM fact_sensor WHERE "Timestamp" IS NOT NULL"""

FRAGMENTS["silver_production"] = """
SELECT p.Production_Order, p.Product AS Product_ID, d.Factory_Type AS Product_Category,
       p.Quantity_Planned, p.Quantity_Produced, p.Scrap,
       p.Quantity_Produced - p.Scrap AS Good_Quantity,
       p.Operator, p.Shift, p.Start_Time, p.End_Time,
       date_diff('minute', date_trunc('minute', p.Start_Time), date_trunc('minute', p.End_Time))
           AS Duration_Minutes
FROM fact_erp_production p LEFT JOIN dim_product d ON p.Product = d.Product"""

FRAGMENTS["silver_maintenance"] = """
SELECT "Date" AS Maintenance_Date, Machine AS Machine_ID, Failure AS Failure_Mode,
       Root_Cause, Severity, Technician, Downtime AS Downtime_Hours,
       Cost AS Maintenance_Cost_USD
FROM fact_maintenance WHERE Downtime > 0"""

FRAGMENTS["silver_quality"] = """
SELECT Inspection_ID, "Date" AS Inspection_Date, Product AS Product_ID, Defect_Type,
       Pass, Fail, Pass + Fail AS Total_Inspected,
       CASE WHEN (Pass + Fail) > 0 THEN CAST(Fail AS DOUBLE) / CAST(Pass + Fail AS DOUBLE)
            ELSE 0.0::DOUBLE END AS Defect_Rate
FROM fact_quality"""

# Gold ------------------------------------------------------------------------
FRAGMENTS["machine_downtime"] = """
SELECT Machine_ID, Maintenance_Date, sum(Downtime_Hours) AS Total_Downtime
FROM silver_maintenance GROUP BY Machine_ID, Maintenance_Date"""

FRAGMENTS["daily_production"] = """
SELECT CAST(Start_Time AS DATE) AS Prod_Date, Product_ID,
       CAST(sum(Quantity_Planned) AS BIGINT) AS Planned_Qty,
       CAST(sum(Quantity_Produced) AS BIGINT) AS Actual_Qty,
       CAST(sum(Good_Quantity) AS BIGINT) AS Good_Qty,
       CAST(sum(Scrap) AS BIGINT) AS Scrap_Qty
FROM silver_production GROUP BY CAST(Start_Time AS DATE), Product_ID"""


def _avg(c: str) -> str:
    return f"CAST(sum({c}) AS DOUBLE) / CAST(nullif(count({c}), 0) AS DOUBLE)"


FRAGMENTS["daily_sensors"] = f"""
SELECT Machine_ID, Event_Date,
       {_avg('Temp_Celsius')} AS Avg_Temp, CAST(max(Temp_Celsius) AS DOUBLE) AS Max_Temp,
       {_avg('Vibration_Hz')} AS Avg_Vibration, CAST(max(Vibration_Hz) AS DOUBLE) AS Max_Vibration,
       {_avg('Power_kW')} AS Avg_Power
FROM silver_sensor GROUP BY Machine_ID, Event_Date"""


def oee_select(downtime: str) -> str:
    avail = f"greatest(0.0::DOUBLE, (24.0::DOUBLE - {downtime}) / 24.0::DOUBLE)"
    perf = ("least(1.0::DOUBLE, CASE WHEN Planned_Qty = 0 THEN 0.0::DOUBLE "
            "ELSE CAST(Actual_Qty AS DOUBLE) / CAST(Planned_Qty AS DOUBLE) END)")
    qual = ("CASE WHEN Actual_Qty = 0 THEN 0.0::DOUBLE "
            "ELSE CAST(Good_Qty AS DOUBLE) / CAST(Actual_Qty AS DOUBLE) END")
    return f"""
SELECT Prod_Date AS "Date", 'M-00001' AS Machine_ID, Planned_Qty, Actual_Qty, Good_Qty,
       {downtime} AS Downtime_Hours,
       {half_up(avail, 2)} AS Availability_Pct,
       {half_up(perf, 2)} AS Performance_Pct,
       {half_up(qual, 2)} AS Quality_Pct,
       {half_up(f'{avail} * {perf} * {qual}', 4)} AS OEE_Score"""


FRAGMENTS["oee_daily"] = oee_select("COALESCE(md.Total_Downtime, 0.0::DOUBLE)") + """
FROM daily_production d LEFT JOIN machine_downtime md ON d.Prod_Date = md.Maintenance_Date"""

FRAGMENTS["oee_daily_exact"] = oee_select("COALESCE(md.Day_Downtime, 0.0::DOUBLE)") + """
FROM daily_production d LEFT JOIN (
    SELECT Maintenance_Date, sum(Total_Downtime) AS Day_Downtime
    FROM machine_downtime GROUP BY Maintenance_Date) md
  ON d.Prod_Date = md.Maintenance_Date"""

FRAGMENTS["ml_feature_view"] = """
SELECT s.Machine_ID, s.Event_Date, s.Avg_Temp, s.Max_Temp, s.Avg_Vibration, s.Max_Vibration,
       s.Avg_Power,
       CAST(CASE WHEN m.Failure_Mode IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS Target_Failure_Occurred,
       m.Failure_Mode, m.Severity
FROM daily_sensors s LEFT JOIN silver_maintenance m
  ON s.Machine_ID = m.Machine_ID AND s.Event_Date = m.Maintenance_Date"""

FRAGMENTS["ml_feature_view_dedup"] = """
SELECT s.Machine_ID, s.Event_Date, s.Avg_Temp, s.Max_Temp, s.Avg_Vibration, s.Max_Vibration,
       s.Avg_Power,
       CAST(CASE WHEN m.Failure_Mode IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS Target_Failure_Occurred,
       COALESCE(m.Failure_Count, 0) AS Failure_Count, m.Failure_Mode, m.Severity
FROM daily_sensors s LEFT JOIN (
    SELECT Machine_ID, Maintenance_Date, count(*) AS Failure_Count,
           min(Failure_Mode) AS Failure_Mode,
           CASE WHEN bool_or(Severity = 'Critical') THEN 'Critical' ELSE min(Severity) END AS Severity
    FROM silver_maintenance GROUP BY Machine_ID, Maintenance_Date) m
  ON s.Machine_ID = m.Machine_ID AND s.Event_Date = m.Maintenance_Date"""

FRAGMENTS["factory_kpi"] = """
SELECT Factory_ID, Event_Date, count(DISTINCT Machine_ID) AS Active_Machines,
       CAST(sum(Power_kW) AS DOUBLE) AS Total_Power_Consumed_kW,
       CAST(sum(CASE WHEN Running_Status = 'Warning' THEN 1 ELSE 0 END) AS BIGINT) AS Total_Warnings,
       CAST(sum(CASE WHEN Error_Code IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS Total_Errors
FROM silver_sensor GROUP BY Factory_ID, Event_Date"""


# Builder ---------------------------------------------------------------------
def _deps(sql: str, known: dict[str, str]) -> list[str]:
    found = []
    for name in known:
        if re.search(rf"(?<![\w.]){re.escape(name)}(?!\w)", sql):
            found.append(name)
    return found


def build(sql: str, fragments: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs (and their dependencies) that it names."""
    frags = FRAGMENTS if fragments is None else fragments
    order: list[str] = []

    def visit(name: str, stack: tuple = ()):
        if name in order or name in stack:
            return
        for d in _deps(frags[name], {k: v for k, v in frags.items() if k != name}):
            visit(d, stack + (name,))
        order.append(name)

    for n in _deps(sql, frags):
        visit(n)
    body = sql.strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({frags[n].strip()})" for n in order)
    m = re.match(r"(?is)^WITH\s+(RECURSIVE\s+)?", body)
    if m:  # merge the query's own CTE list behind the fragments
        rec = "RECURSIVE " if m.group(1) else ""
        return f"WITH {rec}{ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"
