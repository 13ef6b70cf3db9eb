"""Registered queries: disturbance rules and baselines.

The rule set is derived from the maintenance logs (one candidate rule per log,
latest wins per machine and sensor) and baselines from the machine dimension,
so the work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import rules as R
from millrace.plans.oracle import FRAGMENTS
from millrace.plans.registry import register

FRAGMENTS["maint_rule_candidates"] = """
SELECT Machine AS machine,
       CASE Failure WHEN 'F0' THEN 'Temperature' WHEN 'F1' THEN 'Vibration'
                    WHEN 'F2' THEN 'Power Consumption' WHEN 'F3' THEN 'RPM' ELSE 'Pressure' END AS sensor,
       Downtime * 2 AS "min", Downtime * 2 + 50 AS "max", "Date", Cost, Severity
FROM fact_maintenance"""

FRAGMENTS["maint_rules"] = """
SELECT machine, sensor, "min", "max" FROM (
  SELECT *, row_number() OVER (PARTITION BY machine, sensor
                               ORDER BY "Date" DESC, Cost DESC, "min" DESC) AS rn
  FROM maint_rule_candidates) WHERE rn = 1"""

FRAGMENTS["machine_baselines"] = """
SELECT Machine AS machine, 'Temperature' AS sensor, normal_temp + 5 AS value
FROM dim_machine WHERE reliability >= 0.98
UNION ALL
SELECT Machine AS machine, 'Vibration' AS sensor, vibration_base * 2 AS value
FROM dim_machine WHERE max_rpm = 0"""


def _rules(m):
    return R.rules_from_maintenance(m.bronze.fact_maintenance)


def _baselines(m):
    dm = m.bronze.dim_machine
    t = dm.where(F.col("reliability") >= 0.98).select(
        F.col("Machine").alias("machine"), F.lit("Temperature").alias("sensor"),
        (F.col("normal_temp") + 5).alias("value"))
    v = dm.where(F.col("max_rpm") == 0).select(
        F.col("Machine").alias("machine"), F.lit("Vibration").alias("sensor"),
        (F.col("vibration_base") * 2).alias("value"))
    return t.unionByName(v)


register("disturbance_rules", "SELECT * FROM maint_rules", "S8 semantics (last wins), D4 input")(_rules)


@register("rules_by_machine", """
SELECT machine, count(*) AS Rule_Count, string_agg(sensor, ',' ORDER BY sensor) AS Ruled_Sensors
FROM maint_rules GROUP BY machine""", "D4")
def _by_machine(m):
    bm = R.rules_by_machine(_rules(m))
    return bm.select("machine", F.size("rules").cast("long").alias("Rule_Count"),
                     F.array_join(F.array_sort(F.map_keys("rules")), ",").alias("Ruled_Sensors"))


@register("disturbed_machine_count", "SELECT count(DISTINCT machine) AS Disturbed_Machines FROM maint_rules",
          "A13")
def _disturbed(m):
    return R.disturbed_machine_count(_rules(m))


@register("rule_upsert", """
WITH base AS (SELECT machine, sensor, "min", "max" FROM (
       SELECT *, row_number() OVER (PARTITION BY machine, sensor ORDER BY "Date" DESC, Cost DESC, "min" DESC) rn
       FROM maint_rule_candidates WHERE Severity = 'High') WHERE rn = 1),
     new AS (SELECT machine, sensor, "min", "max" FROM (
       SELECT *, row_number() OVER (PARTITION BY machine, sensor ORDER BY "Date" DESC, Cost DESC, "min" DESC) rn
       FROM maint_rule_candidates WHERE Severity = 'Critical') WHERE rn = 1)
SELECT b.* FROM base b WHERE NOT EXISTS (
    SELECT 1 FROM new n WHERE n.machine = b.machine AND n.sensor = b.sensor)
UNION ALL
SELECT machine, sensor, COALESCE("min", 0.0), COALESCE("max", 100.0) FROM new""", "D1 U2")
def _upsert(m):
    fm = m.bronze.fact_maintenance
    base = R.rules_from_maintenance(fm.where(F.col("Severity") == "High"))
    new = R.rules_from_maintenance(fm.where(F.col("Severity") == "Critical"))
    return R.rule_upsert(base, new)


@register("rule_override", """
SELECT f.Machine, f."Timestamp", f.Temperature, f.Error_Code,
       CASE WHEN r.machine IS NOT NULL THEN 'Custom Disturbance' ELSE f.Mode END AS Mode,
       CASE WHEN r.machine IS NOT NULL THEN 'Warning' ELSE f.Running_Status END AS Running_Status
FROM fact_sensor f LEFT JOIN (SELECT DISTINCT machine FROM maint_rules) r ON f.Machine = r.machine""", "D6")
def _override(m):
    rows = m.bronze.fact_sensor.select("Machine", "Timestamp", "Temperature", "Error_Code", "Mode", "Running_Status")
    return R.label_modes(rows, _rules(m))


@register("active_alerts", """
WITH lines AS (
  SELECT 'rule' AS Alert_Type, machine AS Machine,
         printf('⚠️ %s | %s forced to %s-%s', machine, sensor, CAST("min" AS VARCHAR),
                CAST("max" AS VARCHAR)) AS Alert
  FROM maint_rules
  UNION ALL
  SELECT 'baseline', machine,
         printf('🎯 %s Baseline | %s', machine, concat_ws(', ',
             CASE WHEN t IS NOT NULL THEN 'Temp: ' || CAST(t AS VARCHAR) END,
             CASE WHEN v IS NOT NULL THEN 'Vib: ' || CAST(v AS VARCHAR) END))
  FROM (SELECT machine, max(CASE WHEN sensor = 'Temperature' THEN value END) AS t,
               max(CASE WHEN sensor = 'Vibration' THEN value END) AS v
        FROM machine_baselines WHERE value IS NOT NULL GROUP BY machine))
SELECT * FROM lines
UNION ALL
SELECT 'none', NULL, 'All sensors in IDEAL state.' WHERE (SELECT count(*) FROM lines) = 0""", "D7")
def _alerts(m):
    return R.active_alerts(_rules(m), _baselines(m))


@register("baseline_merge", """
WITH upd AS (
  SELECT Machine AS machine, 'Temperature' AS sensor, CAST(normal_temp + 1 AS VARCHAR) AS text FROM dim_machine
  UNION ALL
  SELECT Machine, 'Vibration',
         CASE WHEN power_kw > 40 THEN 'n/a' ELSE CAST(vibration_base + 0.25 AS VARCHAR) END FROM dim_machine),
ok AS (SELECT machine FROM upd GROUP BY machine
       HAVING bool_and(TRY_CAST(text AS DOUBLE) IS NOT NULL OR text IS NULL OR trim(text) = '')),
acc AS (SELECT machine, sensor, TRY_CAST(text AS DOUBLE) AS new_v FROM upd
        WHERE machine IN (SELECT machine FROM ok) AND TRY_CAST(text AS DOUBLE) IS NOT NULL)
SELECT COALESCE(a.machine, b.machine) AS machine, COALESCE(a.sensor, b.sensor) AS sensor,
       COALESCE(a.new_v, b.value) AS value
FROM machine_baselines b FULL OUTER JOIN acc a ON a.machine = b.machine AND a.sensor = b.sensor""", "D3")
def _baseline_merge(m):
    dm = m.bronze.dim_machine
    upd = dm.select(F.col("Machine").alias("machine"), F.lit("Temperature").alias("sensor"),
                    (F.col("normal_temp") + 1).cast("string").alias("text")).unionByName(
        dm.select(F.col("Machine").alias("machine"), F.lit("Vibration").alias("sensor"),
                  F.when(F.col("power_kw") > 40, F.lit("n/a"))
                   .otherwise((F.col("vibration_base") + 0.25).cast("string")).alias("text")))
    return R.baseline_merge(_baselines(m), upd)


@register("range_breach", """
WITH long AS (
  SELECT Machine, "Timestamp", 'Temperature' AS Sensor, Temperature AS Value FROM fact_sensor
  UNION ALL SELECT Machine, "Timestamp", 'Vibration', Vibration FROM fact_sensor
  UNION ALL SELECT Machine, "Timestamp", 'Power Consumption', Power_Consumption FROM fact_sensor
  UNION ALL SELECT Machine, "Timestamp", 'RPM', RPM FROM fact_sensor
  UNION ALL SELECT Machine, "Timestamp", 'Pressure', Pressure FROM fact_sensor)
SELECT l.Machine, l."Timestamp", l.Sensor, l.Value, r."min" AS Rule_Min, r."max" AS Rule_Max
FROM long l JOIN maint_rules r ON l.Machine = r.machine AND l.Sensor = r.sensor
WHERE l.Value < r."min" OR l.Value > r."max\"""", "D8")
def _breach(m):
    rows = m.bronze.fact_sensor.select("Machine", "Timestamp", "Temperature", "Vibration",
                                       "Power_Consumption", "RPM", "Pressure")
    return R.range_breach(rows, _rules(m), ["Machine", "Timestamp"])


@register("ema_initial_state", """
SELECT d.Machine, COALESCE(b.t, d.normal_temp) AS Temperature, COALESCE(b.v, d.vibration_base) AS Vibration,
       400.0::DOUBLE AS Voltage, d.power_kw * 1000.0::DOUBLE / (400.0::DOUBLE * 1.732::DOUBLE) AS "Current",
       d.power_kw AS Power_Consumption, 100.0::DOUBLE AS Pressure, d.max_rpm AS RPM, 95.0::DOUBLE AS Oil_Level,
       45.0::DOUBLE AS Humidity, 62.5::DOUBLE AS Noise
FROM dim_machine d LEFT JOIN (
    SELECT machine, max(CASE WHEN sensor = 'Temperature' THEN value END) AS t,
           max(CASE WHEN sensor = 'Vibration' THEN value END) AS v
    FROM machine_baselines WHERE value IS NOT NULL GROUP BY machine) b ON d.Machine = b.machine""", "J6")
def _initial_state(m):
    return R.initial_state(m.bronze.dim_machine, _baselines(m))


@register("rules_after_clear", """
SELECT machine, sensor, "min", "max" FROM maint_rules WHERE machine NOT IN (
  SELECT Machine FROM dim_machine WHERE reliability >= 0.98)""", "D2")
def _clear(m):
    done = m.bronze.dim_machine.where(F.col("reliability") >= 0.98).select(F.col("Machine").alias("machine"))
    return R.rules_clear_machines(_rules(m), done)


@register("one_machine", """
SELECT Machine_ID, Event_Time, Running_Status FROM silver_sensor
WHERE Machine_ID = (SELECT min(Machine_ID) FROM silver_sensor)""", "P7")
def _one_machine(m):
    s = m.silver_sensor.select("Machine_ID", "Event_Time", "Running_Status")
    first = s.agg(F.min("Machine_ID").alias("Machine_ID"))
    return s.join(F.broadcast(first), "Machine_ID", "left_semi")  # one row
