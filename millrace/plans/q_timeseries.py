"""Registered queries: ordered telemetry operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import pieces
from millrace.operators import rules as R
from millrace.operators import timeseries as ts
from millrace.plans.oracle import half_up
from millrace.plans.registry import register
from millrace.sources.testdata import OPENING_STOCK_BASE, REFILL_QTY

SENSOR_ORDER = ["Event_Time", "Machine_ID", "Temp_Celsius"]
_SENSOR_DBL = """Event_Time, Event_Date, Factory_ID, Line_ID, Machine_ID,
       CAST(Temp_Celsius AS DOUBLE) AS Temp_Celsius, CAST(Vibration_Hz AS DOUBLE) AS Vibration_Hz,
       CAST(Power_kW AS DOUBLE) AS Power_kW, CAST(Spindle_RPM AS DOUBLE) AS Spindle_RPM,
       Running_Status, Mode, Error_Code"""
_DESC = "Event_Time DESC, Machine_ID DESC, Temp_Celsius DESC"


@register("latest_per_machine", f"""
SELECT {_SENSOR_DBL} FROM (
  SELECT *, row_number() OVER (PARTITION BY Machine_ID
                               ORDER BY Event_Time DESC, Temp_Celsius DESC, Spindle_RPM DESC) AS rn
  FROM silver_sensor) WHERE rn = 1""", "W1 W5")
def _latest(m):
    return ts.latest_per_key(m.silver_sensor, "Machine_ID", ["Event_Time", "Temp_Celsius", "Spindle_RPM"])


@register("live_tail", f"SELECT {_SENSOR_DBL} FROM silver_sensor ORDER BY {_DESC} LIMIT 500", "W2")
def _tail(m):
    return ts.tail_n(m.silver_sensor, 500, SENSOR_ORDER)


@register("tail_per_machine", f"""
SELECT {_SENSOR_DBL}, CAST(cnt - rn AS INTEGER) AS Position FROM (
  SELECT *, row_number() OVER (PARTITION BY Machine_ID ORDER BY {_DESC}) AS rn,
            count(*) OVER (PARTITION BY Machine_ID) AS cnt
  FROM silver_sensor) WHERE rn <= 5""", "W3 W8")
def _tail_per_key(m):
    return ts.tail_per_key(m.silver_sensor, "Machine_ID", SENSOR_ORDER, 5, pos_col="Position")


@register("row_positions", """
SELECT Machine, "Timestamp", Temperature, RPM, Noise,
       row_number() OVER (PARTITION BY Machine ORDER BY "Timestamp" NULLS FIRST, Temperature NULLS FIRST, RPM NULLS FIRST,
                          Noise NULLS FIRST) - 1 AS "Position"
FROM fact_sensor""", "W8: every reading's place in its machine's series")
def _positions(m):
    fs = m.bronze.fact_sensor.select("Machine", "Timestamp", "Temperature", "RPM", "Noise")
    return pieces.row_position(fs, "Machine", ["Timestamp", "Temperature", "RPM", "Noise"])


@register("rolling_retention", f"""
SELECT {_SENSOR_DBL} FROM silver_sensor ORDER BY {_DESC}
LIMIT (SELECT 10 * count(DISTINCT Machine_ID) FROM silver_sensor)""", "W4")
def _retention(m):
    return ts.rolling_retention(m.silver_sensor, "Machine_ID", SENSOR_ORDER, per_key=10)


@register("live_kpis", f"""
SELECT count(DISTINCT Machine_ID) AS Machines,
       CAST(sum(CASE WHEN Running_Status = 'Warning' THEN 1 ELSE 0 END) AS BIGINT) AS Warnings,
       CAST(sum(Power_kW) AS DOUBLE) / CAST(count(Power_kW) AS DOUBLE) AS Avg_Power
FROM (SELECT * FROM silver_sensor ORDER BY {_DESC} LIMIT 500)""", "A8")
def _live_kpis(m):
    w = ts.tail_n(m.silver_sensor, 500, SENSOR_ORDER)
    return w.agg(F.countDistinct("Machine_ID").alias("Machines"),
                 F.sum(F.when(F.col("Running_Status") == "Warning", 1).otherwise(0)).alias("Warnings"),
                 F.try_divide(F.sum("Power_kW").cast("double"), F.count("Power_kW").cast("double"))
                  .alias("Avg_Power"))


@register("machines_in_window", f"""
SELECT DISTINCT Machine_ID FROM (SELECT * FROM silver_sensor ORDER BY {_DESC} LIMIT 1500)""", "A11")
def _machines_in_window(m):
    return ts.tail_n(m.silver_sensor, 1500, SENSOR_ORDER).select("Machine_ID").distinct()


@register("machine_sequence_ids", """
SELECT Machine, Factory, Production_Line,
       printf('M-%05d', row_number() OVER (ORDER BY Factory, Production_Line, Machine)) AS Seq_ID
FROM dim_machine""", "W7")
def _seq(m):
    dm = m.bronze.dim_machine.select("Machine", "Factory", "Production_Line")
    return ts.sequence_ids(dm, ["Factory", "Production_Line", "Machine"], groups=2)


_CHANNELS = list(R.DECIMALS)
_NOMINAL_SQL = {c: (v if isinstance(v, str) else "power_kw * 1000.0::DOUBLE / (400.0::DOUBLE * 1.732::DOUBLE)" if v is None
                    else f"{v}::DOUBLE") for c, v in R.NOMINAL.items()}


def _ema_step(c: str, before: str) -> str:
    return f'CASE WHEN b."{c}" IS NULL THEN {before} ELSE {before} + 0.15::DOUBLE * (b."{c}" - {before}) END'


_EMA_SQL = f"""
WITH RECURSIVE b AS (
  SELECT Machine, "Timestamp", {', '.join(f'"{c}"' for c in _CHANNELS)},
         row_number() OVER (PARTITION BY Machine ORDER BY "Timestamp", Temperature, RPM) AS rn
  FROM fact_sensor),
i AS (SELECT Machine, {', '.join(f'{v} AS "{c}"' for c, v in _NOMINAL_SQL.items())} FROM dim_machine),
r AS (
  SELECT b.Machine, b.rn, b."Timestamp", {', '.join(_ema_step(c, f'i."{c}"') + f' AS "s_{c}"' for c in _CHANNELS)}
  FROM b JOIN i ON b.Machine = i.Machine WHERE b.rn = 1
  UNION ALL
  SELECT b.Machine, b.rn, b."Timestamp", {', '.join(_ema_step(c, f'r."s_{c}"') for c in _CHANNELS)}
  FROM r JOIN b ON b.Machine = r.Machine AND b.rn = r.rn + 1)
SELECT Machine, "Timestamp", {', '.join(half_up(f'"s_{c}"', n) + f' AS "{c}"' for c, n in R.DECIMALS.items())}
FROM r"""


@register("ema_smooth", _EMA_SQL, "W6")
def _ema(m):
    fs = m.bronze.fact_sensor.select("Machine", "Timestamp", *_CHANNELS)
    none = m.spark.createDataFrame([], "machine string, sensor string, value double")
    init = R.initial_state(m.bronze.dim_machine, none)
    sm = ts.ema_smooth(fs, "Machine", "Timestamp", ["Temperature", "RPM"], _CHANNELS, init)
    return ts.ema_rounding(sm, R.DECIMALS)


def _ledger(m):
    part = m.bronze.raw("part")
    stock = part.select(F.col("p_partkey").alias("Part_Key"),
                        (OPENING_STOCK_BASE + F.col("p_partkey") % 100).alias("Opening_Stock"),
                        (20 + F.col("p_size")).cast("long").alias("Safety_Stock"),
                        (REFILL_QTY + F.col("p_partkey") % 11).alias("Refill"))
    demand = m.bronze.part_day_demand.select("Part_Key", "Date", "Need")
    return ts.stock_ledger(demand, stock, "Part_Key")


# quiet days between two demand days: with k = ceil((safety - stock) / refill) refills, at most one a day
_LEDGER_CTE = f"""
WITH RECURSIVE cal AS (
  SELECT "Date", CAST(row_number() OVER (ORDER BY "Date") - 1 AS BIGINT) AS i FROM (SELECT DISTINCT "Date" FROM part_day_demand)),
st AS (SELECT p_partkey AS Part_Key, CAST({OPENING_STOCK_BASE} + p_partkey % 100 AS BIGINT) AS s0,
              CAST(20 + p_size AS BIGINT) AS safety, CAST({REFILL_QTY} + p_partkey % 11 AS BIGINT) AS refill FROM part),
ev AS (SELECT Part_Key, i, Need FROM part_day_demand JOIN cal USING ("Date")
       UNION ALL SELECT Part_Key, (SELECT count(*) FROM cal), NULL FROM st),
e AS (SELECT st.Part_Key, i, Need, s0, safety, refill,
             row_number() OVER (PARTITION BY st.Part_Key ORDER BY i) AS rn,
             COALESCE(lag(i) OVER (PARTITION BY st.Part_Key ORDER BY i) + 1, 0) AS q0
      FROM ev JOIN st ON ev.Part_Key = st.Part_Key),
r AS (
  SELECT Part_Key, rn, i, Need, q0, safety, refill, s0 AS before, k, s0 + k * refill AS opening,
         CASE WHEN Need IS NULL THEN s0 + k * refill
              ELSE greatest(s0 + k * refill - Need, 0)
                   + CASE WHEN greatest(s0 + k * refill - Need, 0) < safety THEN refill ELSE 0 END END AS closing
  FROM (SELECT *, CASE WHEN s0 < safety THEN least(i - q0, CAST(ceil((safety - s0) / CAST(refill AS DOUBLE)) AS BIGINT))
                       ELSE 0 END AS k FROM e WHERE rn = 1)
  UNION ALL
  SELECT Part_Key, rn, i, Need, q0, safety, refill, before, k, before + k * refill,
         CASE WHEN Need IS NULL THEN before + k * refill
              ELSE greatest(before + k * refill - Need, 0)
                   + CASE WHEN greatest(before + k * refill - Need, 0) < safety THEN refill ELSE 0 END END
  FROM (SELECT e.*, r.closing AS before,
               CASE WHEN r.closing < e.safety
                    THEN least(e.i - e.q0, CAST(ceil((e.safety - r.closing) / CAST(e.refill AS DOUBLE)) AS BIGINT))
                    ELSE 0 END AS k
        FROM r JOIN e ON e.Part_Key = r.Part_Key AND e.rn = r.rn + 1)),
steps AS (
  SELECT Part_Key, i, Need, opening AS Opening_Stock, least(Need, opening) AS Consumed, Need > opening AS Shortage,
         greatest(opening - Need, 0) < safety AS Refilled, closing AS Closing_Stock FROM r WHERE Need IS NOT NULL
  UNION ALL
  SELECT Part_Key, q0 + q, 0, before + q * refill, 0, false, true, before + (q + 1) * refill
  FROM (SELECT *, unnest(generate_series(0, k - 1)) AS q FROM r WHERE k > 0)
  UNION ALL
  SELECT Part_Key, 0, 0, before, 0, false, false, before FROM r WHERE rn = 1 AND i > 0 AND k = 0),
spans AS (
  SELECT *, COALESCE(lead(i) OVER (PARTITION BY Part_Key ORDER BY i), (SELECT count(*) FROM cal)) - 1 AS until FROM steps),
ledger AS (
  SELECT s.Part_Key, c."Date", CAST(s.Need AS BIGINT) AS Need, CAST(s.Opening_Stock AS BIGINT) AS Opening_Stock,
         CAST(s.Consumed AS BIGINT) AS Consumed, s.Shortage, s.Refilled, CAST(s.Closing_Stock AS BIGINT) AS Closing_Stock,
         u."Date" AS Until_Date
  FROM spans s JOIN cal c ON s.i = c.i JOIN cal u ON s.until = u.i)"""


@register("stock_ledger", _LEDGER_CTE + "\nSELECT * FROM ledger", "W9")
def _stock_ledger(m):
    return _ledger(m)


@register("any_shortage", _LEDGER_CTE + """
SELECT "Date", bool_or(Shortage) AS Any_Shortage,
       CAST(sum(CASE WHEN Shortage THEN 1 ELSE 0 END) AS BIGINT) AS Parts_Short
FROM ledger GROUP BY "Date" """, "A12")
def _any_shortage(m):
    return (_ledger(m).groupBy("Date")
            .agg(F.bool_or("Shortage").alias("Any_Shortage"),
                 F.sum(F.when(F.col("Shortage"), 1).otherwise(0)).alias("Parts_Short")))


@register("inventory_snapshot", _LEDGER_CTE + """
SELECT l."Date", l.Until_Date, p.p_name || '#' || CAST(p.p_partkey AS VARCHAR) AS Part,
       l.Closing_Stock AS Stock, CAST(20 + p.p_size AS INTEGER) AS Safety_Stock,
       l.Closing_Stock < 20 + p.p_size AS Below_Safety,
       s.s_name AS Supplier, p.p_retailprice AS Cost, CAST(5 + p.p_size AS INTEGER) AS Lead_Time
FROM ledger l JOIN part p ON l.Part_Key = p.p_partkey
LEFT JOIN supplier s ON p.p_partkey % (SELECT count(*) FROM supplier) = s.s_suppkey""", "W10")
def _inventory_snapshot(m):
    part = m.bronze.raw("part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    sup = m.bronze.raw("supplier").select("s_suppkey", "s_name")
    n_sup = sup.select(F.count(F.lit(1))).first()[0]
    led = _ledger(m)
    return (led.join(part, F.col("Part_Key") == F.col("p_partkey"), "inner")
            .join(sup, (F.col("p_partkey") % n_sup) == F.col("s_suppkey"), "left")
            .select("Date", "Until_Date",
                    F.concat(F.col("p_name"), F.lit("#"), F.col("p_partkey").cast("string")).alias("Part"),
                    F.col("Closing_Stock").alias("Stock"),
                    (20 + F.col("p_size")).alias("Safety_Stock"),
                    (F.col("Closing_Stock") < 20 + F.col("p_size")).alias("Below_Safety"),
                    F.col("s_name").alias("Supplier"), F.col("p_retailprice").alias("Cost"),
                    (5 + F.col("p_size")).alias("Lead_Time")))


def fact_inventory(m):
    """Bronze FACT_INVENTORY: one stock snapshot per part-day of the ledger.

    The snapshot's warehouse is one of the raw-material warehouses (even nation
    keys), chosen by part key; supplier, cost and lead time come from the part.
    """
    part = m.bronze.raw("part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    sup = m.bronze.raw("supplier").select("s_suppkey", "s_name")
    n_sup = sup.select(F.count(F.lit(1))).first()[0]
    led = _ledger(m)
    return (led.join(part, F.col("Part_Key") == F.col("p_partkey"), "inner")
            .join(sup, (F.col("p_partkey") % n_sup) == F.col("s_suppkey"), "left")
            .select("Date",
                    F.concat(F.col("p_name"), F.lit("#"), F.col("p_partkey").cast("string")).alias("Part"),
                    F.col("Closing_Stock").cast("int").alias("Stock"),
                    (20 + F.col("p_size")).alias("Safety_Stock"),
                    F.format_string("WH-%02d", 2 * (F.col("p_partkey") % 13)).alias("Warehouse"),
                    F.col("s_name").alias("Supplier"), F.col("p_retailprice").alias("Cost"),
                    (5 + F.col("p_size")).alias("Lead_Time")))


INVENTORY_CTE = _LEDGER_CTE + """,
fact_inventory AS (
  SELECT l."Date", p.p_name || '#' || CAST(p.p_partkey AS VARCHAR) AS Part,
         CAST(l.Closing_Stock AS INTEGER) AS Stock, CAST(20 + p.p_size AS INTEGER) AS Safety_Stock,
         printf('WH-%02d', 2 * (p.p_partkey % 13)) AS Warehouse, s.s_name AS Supplier,
         p.p_retailprice AS Cost, CAST(5 + p.p_size AS INTEGER) AS Lead_Time
  FROM ledger l JOIN part p ON l.Part_Key = p.p_partkey
  LEFT JOIN supplier s ON p.p_partkey % (SELECT count(*) FROM supplier) = s.s_suppkey)"""
